"""Graph algorithms as iterated joins and aggregates; every round's result is a written table.

The simple graph: live nodes, one undirected link for each pair of distinct ends, with the highest weight. Hubs only ever
send aggregated rows, and frontiers are joined as tables, so nothing is gathered on the driver but counts.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.operators.components import connected_components
from loomgraph.operators.lookup import live, symmetric
from loomgraph.runtime import Stage, ship_package, write_stage

# Meetings that are counted at a time, nodes of a block at least if there are few, tasks for pairs of blocks.
PART, LEAST_BLOCK, MOST_TASKS = 200_000, 500, 2000


def simple_links(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(a, b, weight), a < b: undirected links between live nodes, the highest weight of parallel edges, 1 if none."""
    ids = live(nodes).select("id")
    e = edges.where("source_id <> target_id").groupBy(F.least("source_id", "target_id").alias("a"), F.greatest("source_id", "target_id").alias("b")).agg(F.coalesce(F.max("weight"), F.lit(1.0)).alias("weight"))
    return e.join(ids.withColumnRenamed("id", "a"), "a", "left_semi").join(ids.withColumnRenamed("id", "b"), "b", "left_semi")


def both_ways(links: DataFrame) -> DataFrame:
    return links.select(F.col("a").alias("id"), F.col("b").alias("nbr"), "weight").unionByName(links.select(F.col("b").alias("id"), F.col("a").alias("nbr"), "weight"))


def degree_centrality(nodes: DataFrame, links: DataFrame) -> DataFrame:
    own = live(nodes).select("id")
    n = own.agg(F.count("*").alias("n"))
    deg = both_ways(links).groupBy("id").agg(F.count("*").alias("degree"))
    return own.join(deg, "id", "left").crossJoin(F.broadcast(n)).select("id", F.coalesce("degree", F.lit(0)).alias("degree"), F.round(F.coalesce("degree", F.lit(0)) / (F.col("n") - 1), 9).alias("centrality"))


def neighbourhood(edges: DataFrame, seeds: DataFrame, hops: int) -> DataFrame:
    """(id, hop): nodes within ``hops`` of the seeds, with the fewest hops. Only the new frontier is joined."""
    near = write_stage(symmetric(edges).select("node_id", "other_id").where("other_id is not null").distinct().repartition("node_id"), "bfs-links").df
    seen = write_stage(seeds.select("id", F.lit(0).alias("hop")).distinct(), "bfs")
    for h in range(1, hops + 1):
        s = seen.df
        front = s.where(F.col("hop") == h - 1).select(F.col("id").alias("node_id"))
        new = near.join(front, "node_id", "left_semi").select(F.col("other_id").alias("id")).distinct().join(s, "id", "left_anti").select("id", F.lit(h).alias("hop"))
        following = write_stage(s.unionByName(new), "bfs")
        seen.drop()
        seen = following
    return seen.df


def shortest_paths(links: DataFrame, seeds: DataFrame, max_hops: int) -> DataFrame:
    """(id, hops, path) from the seeds: breadth first, the smallest path at each node among the shortest."""
    near = write_stage(both_ways(links), "paths-links").df
    seen = write_stage(seeds.select("id", F.lit(0).alias("hops"), F.array("id").alias("path")).distinct(), "paths")
    for h in range(1, max_hops + 1):
        s = seen.df
        front = s.where(F.col("hops") == h - 1)
        step = front.join(near, "id").select(F.col("nbr").alias("id"), F.concat("path", F.array("nbr")).alias("path"))
        new = step.groupBy("id").agg(F.min("path").alias("path")).join(s.select("id"), "id", "left_anti").select("id", F.lit(h).alias("hops"), "path")
        following = write_stage(s.unionByName(new), "paths")
        seen.drop()
        seen = following
        if not seen.df.where(F.col("hops") == h).limit(1).count():
            break
    return seen.df


def _steps(links: DataFrame) -> DataFrame:
    """(id, nbr, step): links from both ends with their cost 1 / max(weight, 0.01), written once for all rounds."""
    return write_stage(both_ways(links).select("id", "nbr", (1 / F.greatest("weight", F.lit(0.01))).alias("step")), "costs-links").df


def cheapest_costs(links: DataFrame, seeds: DataFrame, without: DataFrame | None = None) -> DataFrame:
    """(id, cost) from the seeds with cost 1 / max(weight, 0.01) a link: relaxation until nothing gets cheaper. Nodes of
    ``without`` (id) are not passed."""
    near = _steps(_without(links, without))
    return _relaxed(near, seeds)


def _without(links: DataFrame, gone: DataFrame | None) -> DataFrame:
    if gone is None:
        return links
    return links.join(gone.select(F.col("id").alias("a")), "a", "left_anti").join(gone.select(F.col("id").alias("b")), "b", "left_anti").select("a", "b", "weight")


def _relaxed(near: DataFrame, seeds: DataFrame) -> DataFrame:
    state = write_stage(seeds.select("id", F.lit(0.0).alias("cost"), F.lit(True).alias("moved")).distinct(), "costs")
    while state.df.where("moved").limit(1).count():
        s = state.df
        offer = s.where("moved").join(near, "id").groupBy(F.col("nbr").alias("id")).agg(F.min(F.col("cost") + F.col("step")).alias("offer"))
        both = s.select("id", "cost").join(offer, "id", "full")
        better = F.col("cost").isNull() | (F.col("offer") < F.col("cost"))
        following = write_stage(both.select("id", F.when(better, F.col("offer")).otherwise(F.col("cost")).alias("cost"), F.coalesce(better, F.lit(False)).alias("moved")), "costs")
        state.drop()
        state = following
    return state.df.select("id", "cost")


def k_paths(links: DataFrame, source: DataFrame, target: DataFrame, k: int, max_hops: int | None = None, without: DataFrame | None = None) -> DataFrame:
    """(path, cost) of the k cheapest simple paths from source to target, of any length or of at most ``max_hops`` links;
    nodes of ``without`` (id) are not passed.

    The costs to the target tell for every path begun what it costs at least. All simple paths are grown from the source
    as long as that stays within a bound; the bound is raised until k paths are found or none was held back. A path within
    the bound is never lost, so the k cheapest are exact, and only paths nearly as cheap as they are are ever made.
    """
    near = _steps(_without(links, without))
    ahead = write_stage(_relaxed(near, target), "k-paths-ahead").df.select("id", F.col("cost").alias("rest"))
    goal = target.select(F.col("id").alias("goal")).distinct()
    least = source.select("id").join(ahead, "id").agg(F.min("rest").alias("c")).first()["c"]
    bound = (least or 0.0) * 1.2 + 1e-9
    empty = source.select(F.array("id").alias("path"), F.lit(0.0).alias("cost")).where(F.lit(False))
    if least is None:
        return empty
    while True:
        level = write_stage(source.select("id", F.array("id").alias("path"), F.lit(0.0).alias("cost")).distinct(), "k-paths")
        found, held, hops = [], 0, 0
        while max_hops is None or hops <= max_hops:
            p = level.df.crossJoin(F.broadcast(goal))
            found.append(p.where("id = goal").select("path", "cost"))
            step = p.where("id <> goal").select("id", "path", "cost").join(near, "id").where(~F.array_contains("path", F.col("nbr"))).join(ahead.withColumnRenamed("id", "nbr"), "nbr")
            step = step.select(F.col("nbr").alias("id"), F.concat("path", F.array("nbr")).alias("path"), (F.col("cost") + F.col("step")).alias("cost"), "rest")
            level = write_stage(step.withColumn("over", F.col("cost") + F.col("rest") > bound), "k-paths")
            counts = level.df.agg(F.count_if("over").alias("held"), F.count_if(~F.col("over")).alias("kept")).first()
            held, hops = held + counts["held"], hops + 1
            if not counts["kept"]:
                break
            level = write_stage(level.df.where("not over").select("id", "path", "cost"), "k-paths")
        out = write_stage(reduce(DataFrame.unionByName, found), "k-paths-found").df
        if not held or out.count() >= k:
            return out.select("path", F.round("cost", 6).alias("cost")).distinct().orderBy("cost", F.size("path"), F.concat_ws(",", "path")).limit(k)
        bound *= 1.5


def pagerank(nodes: DataFrame, edges: DataFrame, rounds: int, damping: float = 0.85) -> DataFrame:
    """(id, rank) after a fixed number of rounds; edges are directed, weighted, and bidirectional ones count both ways.

    The rank of nodes without an outgoing edge is spread over all, as one scalar a round.
    """
    ids = live(nodes).select("id")
    both = edges.select("source_id", "target_id", "weight").unionByName(edges.where("bidirectional").select(F.col("target_id").alias("source_id"), F.col("source_id").alias("target_id"), "weight"))
    links = both.where("source_id <> target_id").groupBy("source_id", "target_id").agg(F.coalesce(F.max("weight"), F.lit(1.0)).alias("w"))
    links = links.join(ids.select(F.col("id").alias("source_id")), "source_id", "left_semi").join(ids.select(F.col("id").alias("target_id")), "target_id", "left_semi")
    out = links.groupBy("source_id").agg(F.sum("w").alias("total"))
    flows = write_stage(links.join(out, "source_id").select("source_id", "target_id", (F.col("w") / F.col("total")).alias("share")), "pagerank-flows").df
    n = ids.count()
    has_out = out.select(F.col("source_id").alias("id"), F.lit(True).alias("has_out"))
    state = write_stage(ids.join(has_out, "id", "left").select("id", F.coalesce("has_out", F.lit(False)).alias("has_out"), F.lit(1.0 / max(n, 1)).alias("rank")), "pagerank")
    for _ in range(rounds):
        s = state.df
        got = flows.join(s.select(F.col("id").alias("source_id"), "rank"), "source_id").groupBy(F.col("target_id").alias("id")).agg(F.sum(F.col("rank") * F.col("share")).alias("got"))
        dangling = s.agg(F.coalesce(F.sum(F.when(~F.col("has_out"), F.col("rank"))), F.lit(0.0)).alias("lost"))
        new = s.join(got, "id", "left").crossJoin(F.broadcast(dangling)).select("id", "has_out", ((1 - damping) / n + damping * (F.coalesce("got", F.lit(0.0)) + F.col("lost") / n)).alias("rank"))
        following = write_stage(new, "pagerank")
        state.drop()
        state = following
    return state.df.select("id", "rank")


def label_propagation(links: DataFrame, rounds: int) -> DataFrame:
    """(id, label) after synchronous rounds: the most frequent label among the neighbours, the smallest of equals."""
    near = write_stage(both_ways(links).select("id", "nbr"), "lpa-links").df
    state = write_stage(near.select("id", F.col("id").alias("label")).distinct(), "lpa")
    for _ in range(rounds):
        votes = near.join(state.df.select(F.col("id").alias("nbr"), "label"), "nbr").groupBy("id", "label").agg(F.count("*").alias("n"))
        best = votes.groupBy("id").agg(F.max("n").alias("n"))
        following = write_stage(votes.join(best, ["id", "n"]).groupBy("id").agg(F.min("label").alias("label")), "lpa")
        state.drop()
        state = following
    return state.df


def components(links: DataFrame) -> DataFrame:
    return connected_components(links.select("a", "b")).df


def _meetings(x: dict, y: dict, same: bool, hub: int) -> Iterator[tuple]:
    """(place in x, place in y, number, sum of weights) of the pairs that share a neighbour but no link, sorted within each part."""
    width = len(y["id"])
    low, high = np.searchsorted(y["middle"], x["nbr"], "left"), np.searchsorted(y["middle"], x["nbr"], "right")
    near = (x["nbr"] >= y["first"]) & (x["nbr"] < y["first"] + width)
    linked = x["at"][near] * width + x["nbr"][near] - y["first"]
    met = np.bincount(x["at"], high - low, len(x["id"]))[x["at"]]
    for many in (True, False):
        own = (high > low) & ((met >= hub) == many)
        at, start, n_met, weight = x["at"][own], low[own], (high - low)[own], x["weight"][own]
        if not len(at):
            continue
        # whole nodes of x in each part
        rows, first = np.unique(at, return_index=True)
        cost = np.maximum(np.add.reduceat(n_met, first), width // 8 if many else 0)
        cuts = np.flatnonzero(np.diff(np.cumsum(cost) // PART, prepend=-1))
        for r0, r1 in zip(cuts, [*cuts[1:], len(rows)]):
            e = slice(first[r0], first[r1] if r1 < len(rows) else len(at))
            n, row = n_met[e], np.searchsorted(rows[r0:r1], at[e])
            b = y["end"][np.repeat(start[e] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
            key, w = np.repeat(row * width, n) + b, np.repeat(weight[e], n)
            if same:
                later = b > np.repeat(at[e], n)
                key, w = key[later], w[later]
            if many:
                n = np.bincount(key, minlength=(r1 - r0) * width)
                total = np.bincount(key, w, len(n))
                key = np.flatnonzero(n)
                n, total = n[key], total[key]
            else:
                order = np.argsort(key, kind="stable")
                key = key[order]
                each = np.flatnonzero(np.diff(key, prepend=-1))
                n, total = np.diff(each, append=len(key)), np.add.reduceat(w[order], each) if len(each) else w
                key = key[each]
            a, b = rows[r0 + key // width], key % width
            pair = a * width + b
            known = linked[np.searchsorted(linked, rows[r0] * width) : np.searchsorted(linked, (rows[r1 - 1] + 1) * width)]
            found = np.searchsorted(pair, known)
            inside = found < len(pair)
            found = found[inside][pair[found[inside]] == known[inside]] if len(pair) else found[:0]
            yield tuple(np.delete(c, found) for c in (a, b, n, total))


def _pair_scores(batches: Iterator[pa.RecordBatch], nodes: str, ends: str, size: int, hub: int) -> Iterator[pa.RecordBatch]:
    """The scores of pairs of blocks, numbered (0, 0), (0, 1), (1, 1), (0, 2) and so on, from the files of both."""
    kept: dict[int, dict] = {}

    def read(where: str, k: int) -> pa.Table:
        fs, path = pafs.FileSystem.from_uri(where)
        files = sorted(f.path for f in fs.get_file_info(pafs.FileSelector(f"{path}/block={k}")) if f.path.endswith(".parquet"))
        return pa.concat_tables(pq.ParquetFile(fs.open_input_file(f)).read(use_threads=False) for f in files)

    def block(k: int) -> dict:
        if k not in kept:
            n, e = read(nodes, k), read(ends, k)
            at, nbr, middle = (e[c].to_numpy() for c in ("k", "nbr", "middle"))
            at, order = at - k * size, np.argsort(nbr, kind="stable")
            weight = np.divide(1, np.log(middle), out=np.zeros(len(middle)), where=middle > 1)
            kept[k] = {"first": k * size, "id": n["id"].combine_chunks(), "degree": n["degree"].to_numpy().astype(float), "at": at, "nbr": nbr, "weight": weight, "middle": nbr[order], "end": at[order]}
        return kept[k]

    for p in (v for b in batches for v in b.column(0).to_pylist()):
        j = (math.isqrt(8 * p + 1) - 1) // 2
        i = p - j * (j + 1) // 2
        kept = {k: v for k, v in kept.items() if k == j}
        x, y = block(i), block(j)
        for a, b, n, weight in _meetings(x, y, i == j, hub):
            score = 0.6 * weight + 0.4 * n / np.maximum(np.sqrt(x["degree"][a] * y["degree"][b]), 1.0)
            yield pa.RecordBatch.from_arrays([x["id"].take(pa.array(a)), y["id"].take(pa.array(b)), pa.array(n, pa.int64()), pa.array(np.floor(score * 1e6 + 0.5) / 1e6)], names=["a", "b", "n_common", "score"])


def link_scores(links: DataFrame, block: int = 16_384, hub: int = 1000) -> DataFrame:
    """(a, b, n_common, score) of all pairs that share a neighbour but no link: 0.6 times the sum of 1 / ln(degree) over the
    common neighbours plus 0.4 times their number by the root of the degrees' product.

    Pairs are as many as the degrees squared, so no pair is shuffled or written but as a row of the result: nodes are numbered
    in the order of their ids, ``block`` of them and their links are one file of the shared folder, and a task reads the files
    of two blocks and makes all pairs between them. What is written besides the result grows as the links. A node with ``hub``
    meetings in a block counts them in an array as long as the block, others sort theirs.
    """
    spark = links.sparkSession
    ship_package(spark)
    own = write_stage(links.select("a", "b"), "scores-links")
    degree = own.df.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count("*").alias("degree"))
    part = F.shiftright("place", 33)
    placed = write_stage(degree.orderBy("id").select(F.monotonically_increasing_id().alias("place"), "id", "degree"), "scores-ids")
    before, total = [], 0
    for r in placed.df.groupBy(part.alias("part")).count().orderBy("part").collect():
        before.append((r.part, total))
        total += r["count"]
    size = min(block, max(LEAST_BLOCK, -(-total // 16)))
    index = placed.df.withColumn("part", part).join(F.broadcast(spark.createDataFrame(before, "part long, before long")), "part").select((F.col("place").bitwiseAND(F.lit((1 << 33) - 1)) + F.col("before")).alias("k"), "id", "degree")
    of = lambda s: index.select(F.col("id").alias(s), F.col("k").alias(f"k{s}"), F.col("degree").alias(f"d{s}"))
    numbered = write_stage(own.df.join(of("a"), "a").join(of("b"), "b").select("ka", "kb", "da", "db"), "scores-numbered")
    end = lambda s, t: numbered.df.select(F.col(f"k{s}").alias("k"), F.col(f"k{t}").alias("nbr"), F.col(f"d{t}").alias("middle"))
    in_blocks = lambda df, *by: df.withColumn("block", F.floor(F.col("k") / size)).repartition("block").sortWithinPartitions("block", *by)
    nodes = write_stage(in_blocks(index, "k").drop("k"), "scores-nodes", partition_by="block")
    ends = write_stage(in_blocks(end("a", "b").unionByName(end("b", "a")), "k", "nbr"), "scores-ends", partition_by="block")
    for s in (own, placed, numbered):
        s.drop()
    blocks = -(-total // size)
    pairs, of_nodes, of_ends = blocks * (blocks + 1) // 2, nodes.uri(), ends.uri()
    return spark.range(0, pairs, 1, max(1, min(pairs, MOST_TASKS))).mapInArrow(lambda b: _pair_scores(b, of_nodes, of_ends, size, hub), "a string, b string, n_common long, score double")


def structural_anomalies(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(kind, id): orphans, sure nodes with hardly a link, and nodes with far more links than the mean."""
    deg = degree_centrality(nodes, links).select("id", "degree")
    own = live(nodes).select("id", "confidence").join(deg, "id")
    mean = own.agg(F.avg("degree").alias("mean"))
    n = own.crossJoin(F.broadcast(mean))
    kinds = F.array_compact(
        F.array(
            F.when(F.col("degree") == 0, "orphan"),
            F.when((F.col("confidence") >= 0.8) & (F.col("degree") <= 1) & (F.col("degree") < 0.3 * F.col("mean")), "isolated"),
            F.when(F.col("degree") >= F.greatest(3 * F.col("mean"), F.lit(5.0)), "dense"),
        )
    )
    return n.select(F.explode(kinds).alias("kind"), "id")


def betweenness(links: DataFrame, sources: DataFrame) -> DataFrame:
    """(id, betweenness) from the sources (id): forward counts of shortest paths by level, then dependencies backward.

    All sources run in one set of joins, keyed by (source, node): the number of sources is what bounds the state.
    """
    near = write_stage(both_ways(links).select("id", "nbr"), "between-links").df
    levels = [write_stage(sources.select(F.col("id").alias("source"), "id", F.lit(1.0).alias("sigma")).distinct(), "between")]
    seen = levels[0].df.select("source", "id")
    while True:
        step = levels[-1].df.join(near, "id").groupBy("source", F.col("nbr").alias("id")).agg(F.sum("sigma").alias("sigma"))
        level = write_stage(step.join(seen, ["source", "id"], "left_anti"), "between")
        if not level.df.limit(1).count():
            break
        levels.append(level)
        seen = seen.unionByName(level.df.select("source", "id"))
    below: Stage | None = None
    total: DataFrame | None = None
    for k in range(len(levels) - 1, 0, -1):
        own = levels[k].df
        if below is None:
            delta = own.select("source", "id", "sigma", F.lit(0.0).alias("delta"))
        else:
            gain = below.df.join(near, "id").select("source", F.col("nbr").alias("id"), ((1 + F.col("delta")) / F.col("sigma")).alias("part")).groupBy("source", "id").agg(F.sum("part").alias("part"))
            delta = own.join(gain, ["source", "id"], "left").select("source", "id", "sigma", (F.col("sigma") * F.coalesce("part", F.lit(0.0))).alias("delta"))
        below = write_stage(delta, "between-delta")
        part = below.df.select("id", "delta")
        total = part if total is None else total.unionByName(part)
    if total is None:
        return sources.select("id", F.lit(0.0).alias("betweenness")).where(F.lit(False))
    return total.groupBy("id").agg(F.sum("delta").alias("betweenness"))


def normalised_betweenness(nodes: DataFrame, links: DataFrame, most: int) -> DataFrame:
    """(id, betweenness) of every live node, as a share of the pairs of other nodes: exact where there are no more than
    ``most`` nodes, else the sums of ``most`` sources (the lowest hashes) scaled to all."""
    ids = live(nodes).select("id")
    n = ids.count()
    sources = ids.orderBy(F.xxhash64("id"), "id").limit(most)
    scale = n / max(min(n, most), 1) / max((n - 1) * (n - 2), 1)
    return ids.join(betweenness(links, sources), "id", "left").select("id", (F.coalesce("betweenness", F.lit(0.0)) * scale).alias("betweenness"))


def cut_links(links: DataFrame) -> DataFrame:
    """(a, b) whose removal splits a component.

    A breadth-first tree of each component, one level a round. Every other link gets two random words of 64 bits, and a tree
    link the exclusive or of all such words at the nodes below it: a link beside the tree whose ends both lie below cancels
    out, so the word is 0 if and only if no link but this one leads up (with a chance of 2^-128 to be wrong). Only words move,
    summed by node before each join, so no component is ever gathered.
    """
    own = write_stage(links.select("a", "b"), "cuts").df
    near = write_stage(both_ways(own.withColumn("weight", F.lit(1.0))).select("id", "nbr"), "cuts-near").df
    roots = connected_components(own).df.where("id = label").select("id")
    levels = [write_stage(roots.select("id", F.lit(None).cast("string").alias("parent")), "cuts-tree")]
    seen = write_stage(roots, "cuts-seen")
    while True:
        step = near.join(levels[-1].df.select("id"), "id").groupBy(F.col("nbr").alias("id")).agg(F.min("id").alias("parent")).join(seen.df, "id", "left_anti")
        level = write_stage(step, "cuts-tree")
        if not level.df.limit(1).count():
            break
        levels.append(level)
        following = write_stage(seen.df.unionByName(level.df.select("id")), "cuts-seen")
        seen.drop()
        seen = following
    ends = lambda df: df.select(F.least("id", "parent").alias("a"), F.greatest("id", "parent").alias("b"))
    tree = reduce(DataFrame.unionByName, (ends(x.df.where("parent is not null")) for x in levels))
    words = [F.xxhash64("a", "b", F.lit(k)).alias(f"w{k}") for k in (1, 2)]
    rest = own.join(tree, ["a", "b"], "left_anti").select("a", "b", *words)
    at = F.explode(F.array("a", "b")).alias("id")
    marks = write_stage(rest.select(at, "w1", "w2").groupBy("id").agg(F.expr("bit_xor(w1)").alias("w1"), F.expr("bit_xor(w2)").alias("w2")), "cuts-words").df
    below, cuts = None, []
    for level in reversed(levels[1:]):
        parts = marks.join(level.df.select("id"), "id", "left_semi")
        if below is not None:
            parts = parts.unionByName(below.df.groupBy(F.col("parent").alias("id")).agg(F.expr("bit_xor(w1)").alias("w1"), F.expr("bit_xor(w2)").alias("w2")))
        total = parts.groupBy("id").agg(F.expr("bit_xor(w1)").alias("w1"), F.expr("bit_xor(w2)").alias("w2"))
        zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
        below = write_stage(level.df.join(total, "id", "left").select("id", "parent", zero("w1"), zero("w2")), "cuts-below")
        cuts.append(ends(below.df.where("w1 = 0 and w2 = 0")))
    return reduce(DataFrame.unionByName, cuts) if cuts else own


def chains(edges: DataFrame, seeds: DataFrame, edge_types: tuple[str, ...], max_depth: int) -> DataFrame:
    """(seed_id, id, depth, path) along directed edges of the types, each node once on a path."""
    step = edges.where(F.upper("edge_type").isin(*edge_types)).select(F.col("source_id").alias("id"), F.col("target_id").alias("nxt")).where("nxt is not null").distinct()
    level = write_stage(seeds.select(F.col("id").alias("seed_id"), "id", F.lit(0).alias("depth"), F.array("id").alias("path")), "chains")
    found = None
    for k in range(1, max_depth + 1):
        new = level.df.join(step, "id").where(~F.array_contains("path", F.col("nxt"))).select("seed_id", F.col("nxt").alias("id"), F.lit(k).alias("depth"), F.concat("path", F.array("nxt")).alias("path"))
        level = write_stage(new, "chains")
        found = level.df if found is None else found.unionByName(level.df)
    return found


def ordinal_rank(scores: DataFrame, score: str) -> DataFrame:
    """Rank by score over all rows without one sorted partition: ranks inside range partitions plus what lies above."""
    placed = scores.repartitionByRange(F.desc(score), "id").withColumn("part", F.spark_partition_id())
    placed = write_stage(placed, "ranks").df
    above = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = placed.groupBy("part").agg(F.count("*").alias("n")).select("part", F.coalesce(F.sum("n").over(above), F.lit(0)).alias("offset"))
    w = Window.partitionBy("part").orderBy(F.desc(score), "id")
    return placed.join(F.broadcast(offsets), "part").select("id", score, (F.col("offset") + F.row_number().over(w)).alias("rank"))
