"""Parent-child links to full hierarchies.

Method: connected components, co-location of each component, iterative depth-first traversal with node colouring.

1. Links are reduced to one parent for each child (the smallest id if several are stated).
2. Components: as every child has one parent, hooking is given and only shortcutting remains. Parent pointers are
   doubled until a round ends no more paths; what is left then leads into a cycle and is doubled on until the smallest
   id of its cycle is known. log2(longest path) rounds, each one equi-join of the id space; the result of a round is
   written to the shared folder, so lineage stays short and a lost executor repeats one round.
3. Each component is hashed to one partition and streamed, sorted by component, through the traversal. A traversal
   starts at the roots (or, in a component without a root, at the smallest id of its cycle) and colours nodes white,
   grey and black; an edge to a grey node is the back edge of a cycle.
4. A component above ``max_component`` nodes is never gathered in one task: its depths, counts of descendants and marks of
   cycles are made by doubling, in as many rounds as its depth has binary digits, and its paths only if they are asked
   for. The rows are the same at any limit, which is what the tests compare.

Defined cases: links with a null end are not links; a self link is a cycle of one; empty input gives no rows; link
rows stated again count once; ids are compared exactly as written; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgraph.runtime import Stage, ship_package, write_stage

CHILD_IS_SOURCE = ("PART_OF", "SUBTASK_OF")
CHILD_IS_TARGET = ("CONTAINS",)
MAX_COMPONENT = 200_000

NODE_SCHEMA = T.StructType(
    [
        T.StructField("node_id", T.StringType()),
        T.StructField("root_id", T.StringType()),
        T.StructField("depth", T.IntegerType()),
        T.StructField("path", T.ArrayType(T.StringType())),
        T.StructField("n_descendants", T.LongType()),
        T.StructField("in_cycle", T.BooleanType()),
        T.StructField("back_edge_to", T.StringType()),
    ]
)


def hierarchy_links(edges: DataFrame) -> DataFrame:
    """(child, parent), one row for each child."""
    kind = F.upper(F.trim(F.col("edge_type")))
    down = kind.isin(*CHILD_IS_TARGET)
    return (
        edges.where(kind.isin(*CHILD_IS_SOURCE, *CHILD_IS_TARGET))
        .select(F.when(down, F.col("target_id")).otherwise(F.col("source_id")).alias("child"), F.when(down, F.col("source_id")).otherwise(F.col("target_id")).alias("parent"))
        .where(F.col("child").isNotNull() & F.col("parent").isNotNull())
        .groupBy("child")
        .agg(F.min("parent").alias("parent"))
    )


def components(links: DataFrame) -> Stage:
    """(id, parent, comp, cyclic): comp is the root of a tree, or the smallest id of the cycle that a component holds.

    State of a node: ptr, its 2^k-th ancestor, or the root if that is nearer; low, the smallest id among the 2^k nodes
    from the node on.
    """
    parents = links.select(F.col("parent").alias("id")).distinct()
    base = parents.join(links.withColumnRenamed("child", "id"), "id", "full").select("id", "parent")
    state = write_stage(
        base.select("id", "parent", F.coalesce("parent", "id").alias("ptr"), F.least("id", F.coalesce("parent", "id")).alias("low"), F.col("parent").isNull().alias("done")),
        "hierarchy",
    )
    open_before, rounds, settled = None, 0, False
    while True:
        s = state.df
        n_open = s.where(~F.col("done")).count()
        if settled or open_before == n_open:
            # no path ended in the last round, so none of the open ones ever ends: their cycle's low is wanted now
            settled = True
            if n_open == 0 or 2**rounds >= n_open:
                break
        if n_open == 0:
            break
        look = s.select(F.col("id").alias("ptr"), F.col("ptr").alias("far"), F.col("low").alias("far_low"), F.col("done").alias("far_done"))
        moved = (
            s.where(~F.col("done"))
            .join(look, "ptr")
            .select("id", "parent", F.col("far").alias("ptr"), F.least("low", "far_low").alias("low"), F.col("far_done").alias("done"))
        )
        following = write_stage(s.where("done").unionByName(moved), "hierarchy")
        state.drop()
        state, open_before, rounds = following, n_open, rounds + 1
    s = state.df
    look = s.where(~F.col("done")).select(F.col("id").alias("ptr"), F.col("low").alias("cycle_low"))
    labelled = s.where("done").select("id", "parent", F.col("ptr").alias("comp"), F.lit(False).alias("cyclic"))
    cyclic = s.where(~F.col("done")).join(look, "ptr").select("id", "parent", F.col("cycle_low").alias("comp"), F.lit(True).alias("cyclic"))
    out = write_stage(labelled.unionByName(cyclic), "hierarchy-components")
    state.drop()
    return out


def traverse(comp: str, ids: list[str], parents: list[str | None], cyclic: bool, with_paths: bool = True) -> list[tuple]:
    """Depth-first traversal with an explicit stack and colours; rows of NODE_SCHEMA."""
    up = dict(zip(ids, parents, strict=True))
    children: dict[str, list[str]] = {}
    for i, p in up.items():
        if p is not None:
            children.setdefault(p, []).append(i)
    white, grey, black = 0, 1, 2
    colour = dict.fromkeys(ids, white)
    below = dict.fromkeys(ids, 0)
    depth = {comp: 0}
    back: dict[str, str] = {}
    stack = [(comp, iter(sorted(children.get(comp, ()))))]
    colour[comp] = grey
    while stack:
        node, kids = stack[-1]
        kid = next(kids, None)
        if kid is None:
            colour[node] = black
            stack.pop()
            if stack:
                below[stack[-1][0]] += below[node] + 1
        elif colour[kid] == white:
            colour[kid] = grey
            depth[kid] = depth[node] + 1
            stack.append((kid, iter(sorted(children.get(kid, ())))))
        elif colour[kid] == grey:
            back[node] = kid
    ring: set[str] = set()
    for node, head in back.items():
        while node != head:
            ring.add(node)
            node = up[node]
        ring.add(head)

    def path(i: str) -> list[str]:
        way = [i]
        while way[-1] != comp:
            way.append(up[way[-1]])
        return way[::-1]

    return [(i, comp, -1 if cyclic else depth[i], path(i) if with_paths else None, len(ids) - 1 if i in ring else below[i], i in ring, back.get(i)) for i in ids]


def _walk(batches: Iterator[pd.DataFrame], with_paths: bool) -> Iterator[pd.DataFrame]:
    """Batches sorted by comp; a component may span batches, never partitions."""
    names = [f.name for f in NODE_SCHEMA.fields]
    comp, cyclic, ids, parents = None, False, [], []
    out: list[tuple] = []
    for b in batches:
        for i, p, c, y in zip(b["id"], b["parent"], b["comp"], b["cyclic"], strict=True):
            if c != comp:
                if comp is not None:
                    out += traverse(comp, ids, parents, cyclic, with_paths)
                comp, cyclic, ids, parents = c, bool(y), [], []
            ids.append(i)
            parents.append(p if isinstance(p, str) else None)
        if len(out) > 5000:
            yield pd.DataFrame(out, columns=names)
            out = []
    if comp is not None:
        out += traverse(comp, ids, parents, cyclic, with_paths)
    if out:
        yield pd.DataFrame(out, columns=names)


def _doubled(big: DataFrame, with_paths: bool) -> DataFrame:
    """Rows of NODE_SCHEMA for components too large for one task, by doubling.

    The link into a component's head is cut, so what is left is a tree. ptr is the ancestor 2^k steps up, null beyond the
    head; dist counts the steps so far; below and closing count the nodes, and the nodes whose link was cut, among those
    less than 2^k steps down: what is 2^k steps down adds its own counts. Only counts move, whatever the depth, and a hub
    gets one row a partition. Nodes above the cut link's node are the cycle.
    """
    head = F.col("id") == F.col("comp")
    cut = big.where(head & F.col("cyclic")).select(F.col("parent").alias("id"), F.lit(1).alias("closing"))
    start = big.join(cut, "id", "left").select("id", "comp", "cyclic", F.when(~head, F.col("parent")).alias("ptr"), F.when(head, 0).otherwise(1).cast("long").alias("dist"), F.lit(1).cast("long").alias("below"), F.coalesce("closing", F.lit(0)).cast("long").alias("closing"), F.coalesce("closing", F.lit(0)).alias("cut"))
    state = write_stage(start, "hierarchy-big")
    while state.df.where("ptr is not null").limit(1).count():
        s = state.df
        gain = s.where("ptr is not null").groupBy(F.col("ptr").alias("id")).agg(F.sum("below").alias("more"), F.sum("closing").alias("more_closing"))
        look = s.select(F.col("id").alias("ptr"), F.col("ptr").alias("far"), F.col("dist").alias("far_dist"))
        moved = s.join(look, "ptr", "left").join(gain, "id", "left")
        zero = lambda c: F.coalesce(c, F.lit(0))
        following = write_stage(moved.select("id", "comp", "cyclic", F.col("far").alias("ptr"), (F.col("dist") + zero("far_dist")).alias("dist"), (F.col("below") + zero("more")).alias("below"), (F.col("closing") + zero("more_closing")).alias("closing"), "cut"), "hierarchy-big")
        state.drop()
        state = following
    size = big.groupBy("comp").agg((F.count("*") - 1).alias("others"))
    in_ring = F.col("cyclic") & (F.col("closing") > 0)
    out = state.df.join(size, "comp")
    if with_paths:
        out = out.join(_paths(big), "id")
    else:
        out = out.withColumn("path", F.lit(None).cast("array<string>"))
    return out.select(
        F.col("id").alias("node_id"),
        F.col("comp").alias("root_id"),
        F.when(F.col("cyclic"), F.lit(-1)).otherwise(F.col("dist")).cast("int").alias("depth"),
        "path",
        F.when(in_ring, F.col("others")).otherwise(F.col("below") - 1).alias("n_descendants"),
        in_ring.alias("in_cycle"),
        F.when(F.col("cut") == 1, F.col("comp")).alias("back_edge_to"),
    )


def _paths(big: DataFrame) -> DataFrame:
    """(id, path) by doubling pieces of the way up, nearest node last."""
    state = write_stage(big.select("id", F.when(F.col("id") != F.col("comp"), F.col("parent")).alias("ptr"), F.array("id").alias("path")), "hierarchy-paths")
    while state.df.where("ptr is not null").limit(1).count():
        s = state.df
        look = s.select(F.col("id").alias("ptr"), F.col("ptr").alias("far"), F.col("path").alias("far_path"))
        moved = s.where("ptr is not null").join(look, "ptr").select("id", F.col("far").alias("ptr"), F.concat("far_path", "path").alias("path"))
        following = write_stage(s.where("ptr is null").unionByName(moved), "hierarchy-paths")
        state.drop()
        state = following
    return state.df.select("id", "path")


def hierarchy(edges: DataFrame, max_component: int = MAX_COMPONENT, with_paths: bool = True) -> DataFrame:
    """One row for each id in a hierarchy link: its root, depth, path from the root, descendants and cycle marks.

    In a component with a cycle depth is -1, root_id the smallest id of the cycle and path the way from that id.
    ``with_paths=False`` leaves path null for every node: paths are as long as the trees are deep.
    """
    comps = components(hierarchy_links(edges)).df
    large = comps.groupBy("comp").count().where(F.col("count") > max_component).select("comp")
    ship_package(edges.sparkSession)
    walked = lambda d: d.repartition("comp").sortWithinPartitions("comp", "id").mapInPandas(lambda b: _walk(b, with_paths), NODE_SCHEMA)
    if not large.limit(1).count():
        return walked(comps)
    # at most rows/max_component components are large: a table as short as that
    return walked(comps.join(large, "comp", "left_anti")).unionByName(_doubled(comps.join(large, "comp"), with_paths))


def descendants(nodes: DataFrame) -> DataFrame:
    """(ancestor_id, node_id, distance) from the paths of ``hierarchy``: no shuffle, each node explodes its own path."""
    n = F.size("path")
    return nodes.where(F.col("depth") >= 0).select("node_id", n.alias("n"), F.posexplode("path").alias("at", "ancestor_id")).where(F.col("at") < F.col("n") - 1).select("ancestor_id", "node_id", (F.col("n") - 1 - F.col("at")).cast("int").alias("distance"))
