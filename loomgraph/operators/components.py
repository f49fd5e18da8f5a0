"""Connected components of an undirected graph, by smallest label with shortcutting.

Each round a node takes the smallest label among itself and its neighbours (one aggregation with map-side combine, so a
hub sends one row a partition) and then the label of its label. Rounds grow with the logarithm of the diameter in
practice; each round's result is written to the shared folder, which cuts lineage and survives lost executors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.runtime import Stage, write_stage


def connected_components(links: DataFrame) -> Stage:
    """(id, label) for each id in ``links`` (a, b); label is the smallest id of the component. Null ends are no links."""
    pairs = links.select("a", "b").where("a is not null and b is not null and a <> b")
    edges = write_stage(pairs.select(F.col("a").alias("id"), F.col("b").alias("nbr")).union(pairs.select("b", "a")).distinct(), "cc-edges")
    state = write_stage(edges.df.groupBy("id").agg(F.least(F.col("id"), F.min("nbr")).alias("label")), "cc")
    while True:
        s = state.df
        offered = edges.df.join(s.select(F.col("id").alias("nbr"), F.col("label").alias("other")), "nbr").groupBy("id").agg(F.min("other").alias("offered"))
        low = s.join(offered, "id").select("id", "label", F.least("label", "offered").alias("low"))
        jumped = low.join(s.select(F.col("id").alias("low"), F.col("label").alias("far")), "low", "left").select("id", F.least("low", F.coalesce("far", "low")).alias("label"), (F.least("low", F.coalesce("far", "low")) != F.col("label")).alias("moved"))
        following = write_stage(jumped, "cc")
        state.drop()
        state = following
        if not state.df.where("moved").limit(1).count():
            break
    edges.drop()
    return state
