"""Spark-native analytics over a typed property graph, its captures and documents."""
