"""The weighted bidirected graph that a count table implies.

Edges are canonical k-mers, nodes canonical (k-1)-mers, both packed. Exact tables get their incidence spelt out once; lossy
tables are probed for the eight extensions of a node.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from weftgraph.functions import kmers as K

from .durable import forget, keep
from .reads import canonical_array, reverse_complement_array

U = np.uint64
_SIDES = np.array(["", "L", "R", "D"])
#: Nodes whose edges a worker spells at once, however large the session's Arrow batches are.
SPELT = 1 << 13


def incidence(edges: DataFrame, k: int) -> DataFrame:
    """(node, edge, side, w, neighbor): a row for each node of an edge; side L, R or D, w 2 for a loop. cnt comes along if edges has it."""
    own = ["edge", "cnt"] if "cnt" in edges.columns else ["edge"]
    ends = edges.select(*own, K.left_node(F.col("edge"), k).alias("l"), K.right_node(F.col("edge"), k).alias("r"))
    rows = ends.select(*own, F.explode(F.array_distinct(F.array("l", "r"))).alias("node"), "l", "r")
    other = F.when(F.col("node") == F.col("l"), F.col("r")).otherwise(F.col("l"))
    return rows.select("node", "edge", K.side(F.col("node"), F.col("edge"), k).alias("side"), F.when(F.col("l") == F.col("r"), 2).otherwise(1).alias("w"), other.alias("neighbor"), *own[1:])


def candidates(nodes: DataFrame, k: int) -> DataFrame:
    """(node, edge, side, w, neighbor): the distinct canonical edges that a node could have, eight at most, as incidence has them.

    SPELT nodes at a time in arrays: as column expressions, eight reverse complements a row and what follows take a second to
    plan each time, and walks plan one for each level.
    """
    low = U((1 << (2 * (k - 1))) - 1)

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in (batch.column(0).slice(lo, SPELT) for batch in batches for lo in range(0, batch.num_rows, SPELT)):
            node = some.to_numpy(zero_copy_only=False).view(np.uint64)
            every = [canonical_array(e, k) for b in range(4) for e in (node | U(b << (2 * (k - 1))), (node << U(2)) & U((1 << (2 * k)) - 1) | U(b))]
            edge = np.sort(np.stack(every, axis=1), axis=1)
            new = np.ones(edge.shape, bool)
            new[:, 1:] = edge[:, 1:] != edge[:, :-1]
            node, edge = np.repeat(node, new.sum(axis=1)), edge[new]
            head, tail, back = edge >> U(2), edge & low, reverse_complement_array(node, k - 1)
            side = ((tail == node) | (head == back)) + 2 * ((head == node) | (tail == back))
            l, r = canonical_array(head, k - 1), canonical_array(tail, k - 1)
            cols = [pa.array(x.view(np.int64)) for x in (node, edge, np.where(l == node, r, l))]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(_SIDES[side]), pa.array(1 + (l == r), pa.int32())], names=["node", "edge", "neighbor", "side", "w"])

    return nodes.select(F.col("node").cast("bigint")).mapInArrow(extend, "node bigint, edge bigint, neighbor bigint, side string, w int").select("node", "edge", "side", "w", "neighbor")


def probe(nodes: DataFrame, sketch: DataFrame, k: int, hash_of) -> DataFrame:
    """(node, edge, side, w, neighbor, hash, occ) of the edges that a lossy table shows at these nodes."""
    return candidates(nodes, k).withColumn("hash", hash_of(F.col("edge"))).join(sketch.select("hash", F.col("cnt").alias("occ")), "hash").select("node", "edge", "side", "w", "neighbor", "hash", "occ")


def abundance(edges: DataFrame, corrections: DataFrame) -> DataFrame:
    """(edge, cnt) less its correction, 0 at least."""
    left = F.greatest(F.col("cnt") - F.coalesce("amount", F.lit(0)), F.lit(0))
    return edges.join(corrections, "edge", "left").select("edge", left.alias("cnt"))


def by_side(inc: DataFrame, value: Column, how=F.sum) -> list[Column]:
    zero = F.lit(0).cast("bigint")
    return [F.coalesce(how(F.when(F.col("side") == s, value)), zero).alias(n) for s, n in (("L", "left"), ("R", "right"), ("D", "duplex"))]


def degrees(inc: DataFrame) -> DataFrame:
    """(node, left, right, duplex, total): distinct edges on each side."""
    return inc.groupBy("node").agg(*by_side(inc, F.lit(1).cast("bigint")), F.count("*").alias("total"))


def _with_counts(inc: DataFrame, edges: DataFrame | None) -> DataFrame:
    return inc if edges is None else inc.drop("cnt").join(edges.select("edge", "cnt"), "edge")


def side_abundance(inc: DataFrame, edges: DataFrame | None = None) -> DataFrame:
    """(node, left, right, duplex): counts of the edges on each side, a loop once. edges: counts other than those in inc."""
    return _with_counts(inc, edges).groupBy("node").agg(*by_side(inc, F.col("cnt")))


def invariant(inc: DataFrame, edges: DataFrame | None, ends: DataFrame) -> DataFrame:
    """(node, left_value, right_value, discrepancy): loops weigh 2, duplex edges nothing, ends come off. edges: counts other
    than those in inc, or None."""
    flow = _with_counts(inc, edges).groupBy("node").agg(*by_side(inc, F.col("w") * F.col("cnt")))
    both = flow.join(ends, "node", "full").select("node", *[(F.coalesce(s, F.lit(0)) - F.coalesce(f"{s}_ends", F.lit(0))).alias(f"{s}_value") for s in ("left", "right")])
    return both.withColumn("discrepancy", F.col("right_value") - F.col("left_value"))


def balance(counts: DataFrame, k: int) -> DataFrame:
    """The invariant of an exact graph straight from its counted table (is_end, key, a, b): each row goes to its nodes, edges with
    their counts and ends with what comes off, and one sum by node does the rest. No join, and one scan of the reads."""
    key, node, flow, zero = F.col("key"), F.col("node"), F.col("w") * F.col("a"), F.lit(0).cast("bigint")
    # the nodes of a key are worked out before the rows are spread, and sides after: nested, reverse complements grow without bound
    placed = counts.select("is_end", "key", "a", "b", K.left_node(key, k).alias("l"), K.right_node(key, k).alias("r"))
    nodes = F.when(F.col("is_end"), F.array("key")).otherwise(F.array_distinct(F.array("l", "r")))
    rows = placed.select("is_end", "key", "a", "b", F.explode(nodes).alias("node"), F.when(F.col("l") == F.col("r"), 2).otherwise(1).alias("w"))
    rows = rows.select("is_end", "node", "a", "b", "w", K.side(node, key, k).alias("side"))
    left, right = (F.when(F.col("is_end"), -F.col(end)).when(F.col("side") == s, flow).otherwise(zero) for s, end in (("L", "a"), ("R", "b")))
    values = rows.groupBy("node").agg(F.sum(left).alias("left_value"), F.sum(right).alias("right_value"))
    return values.withColumn("discrepancy", F.col("right_value") - F.col("left_value"))


def neighbors(inc: DataFrame) -> DataFrame:
    """(node, side, neighbor), distinct"""
    return inc.select("node", "side", "neighbor").distinct()


def leaf_nodes(inc: DataFrame) -> DataFrame:
    """(node, total) of nodes with fewer than two edges"""
    return degrees(inc).where("total < 2").select("node", "total")


def leaf_edges(inc: DataFrame) -> DataFrame:
    """(edge): either endpoint is a leaf"""
    return inc.join(leaf_nodes(inc), "node", "left_semi").select("edge").distinct()


def loops(edges: DataFrame, k: int) -> DataFrame:
    return edges.where(K.is_loop(F.col("edge"), k))


def end_nodes(ends: DataFrame) -> DataFrame:
    """(node) where a read begins or ends"""
    return ends.where("left_ends > 0 or right_ends > 0").select("node").distinct()


def ball(seeds: DataFrame, inc: DataFrame, depth: int) -> DataFrame:
    """(node, d): nodes up to `depth` steps from the seeds; seeds are there even if isolated."""
    front = seen = keep(seeds.select("node", F.lit(0).alias("d")).distinct(), "seeds")
    step = inc.select("node", "neighbor").where("node <> neighbor")
    for d in range(1, depth + 1):
        new = front.join(step, "node").select(F.col("neighbor").alias("node")).distinct().join(seen, "node", "left_anti").select("node", F.lit(d).alias("d"))
        front = keep(new, "front")
        seen = seen.unionByName(front)
    return seen


def edges_of(nodes: DataFrame, edges: DataFrame, k: int) -> DataFrame:
    """Edges whose left node is among the nodes: the traversal's own rule."""
    return edges.join(nodes.select(F.col("node").alias("__left")), K.left_node(F.col("edge"), k) == F.col("__left"), "left_semi")


def _kept_and_counted(df: DataFrame, name: str) -> tuple[DataFrame, int]:
    count = Observation()
    out = keep(df.observe(count, F.count(F.lit(1)).alias("n")), name)
    return out, count.get["n"]


def _roots(up: DataFrame) -> DataFrame:
    """(v, root) of a forest (v, up) whose roots point to themselves, by pointer jumping: each round halves what is left of the depth."""
    while True:
        count = Observation()
        over = up.select(F.col("v").alias("up"), F.col("up").alias("over"))
        new = keep(up.select("v", "up").join(over, "up").select("v", F.col("over").alias("up"), (F.col("over") != F.col("up")).alias("moved")).observe(count, F.count_if("moved").alias("n")), "jumped")
        forget(up)
        if not count.get["n"]:
            return new.select("v", F.col("up").alias("root"))
        up = new


def components(inc: DataFrame) -> DataFrame:
    """(node, component): the least packed node of the component.

    Levels of contraction: every node points to the neighbour of least hash, unless its own is less; the trees this makes become
    the nodes of the next level, with the edges between them. Of a chain, whatever the order of its nodes, some third is left at
    each level, so levels grow as the log of its length, and what they read shrinks.
    """
    edges, n = _kept_and_counted(inc.select("node", "neighbor").where("node <> neighbor").distinct().select(F.col("node").alias("a"), F.col("neighbor").alias("b")), "steps")
    levels = []
    while n:
        rank = lambda c: F.struct(F.xxhash64(F.lit(len(levels)), c).alias("rank"), F.col(c).alias("v"))  # noqa: B023, E731
        least = edges.groupBy("a").agg(F.min(rank("b")).alias("near"))
        up = keep(least.select(F.col("a").alias("v"), F.least("near", rank("a"))["v"].alias("up")), "up")
        roots = _roots(up)
        levels.append(roots)
        # a giant tree is one label on many rows of the left side, which Spark splits; the right side has a row for each node
        ends = {c: roots.select(F.col("v").alias(c), F.col("root").alias(f"{c}_root")) for c in "ab"}
        moved = edges.join(ends["a"], "a").join(ends["b"], "b").where("a_root <> b_root").select(F.col("a_root").alias("a"), F.col("b_root").alias("b"))
        next_edges, n = _kept_and_counted(moved.distinct(), "steps")
        forget(edges)
        edges = next_edges
    forget(edges)
    nodes = inc.select("node").distinct()
    if not levels:
        return nodes.select("node", F.col("node").alias("component"))
    top = levels.pop()
    while levels:
        top = levels.pop().join(top.select(F.col("v").alias("root"), F.col("root").alias("above")), "root", "left").select("v", F.coalesce("above", "root").alias("root"))
    found = nodes.join(top.withColumnRenamed("v", "node"), "node", "left").select("node", F.coalesce("root", "node").alias("root"))
    found = keep(found, "labels")
    least = found.groupBy("root").agg(F.min("node").alias("component"))
    return found.join(least, "root").select("node", "component")


def reachable_nodes(inc: DataFrame, ends: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(node) reachable from read ends.

    known: nodes that surely are, as reads.read_nodes gives them; then only what lies beyond is walked, and rounds don't
    depend on the length of reads. Without it, ends and the components that hold one; rounds grow as the log of the
    diameter.
    """
    starts = end_nodes(ends)
    if known is None:
        parts = components(inc)
        whole = parts.join(parts.join(starts, "node", "left_semi").select("component").distinct(), "component", "left_semi").select("node")
        return whole.unionByName(starts).distinct()
    step = inc.select("node", "neighbor").where("node <> neighbor")
    front = seen = keep(known.select("node").unionByName(starts).distinct(), "seen")
    rounds = 0
    while True:
        front = keep(front.join(step, "node").select(F.col("neighbor").alias("node")).distinct().join(seen, "node", "left_anti"), "front")
        if front.isEmpty():
            return seen
        seen, rounds = seen.unionByName(front), rounds + 1
        if rounds % 16 == 0:  # plans stay short
            seen = keep(seen, "seen")


def component_of(seeds: DataFrame, inc: DataFrame) -> DataFrame:
    """(node) of the components that hold a seed"""
    parts = components(inc)
    return parts.join(parts.join(seeds.select("node"), "node", "left_semi").select("component").distinct(), "component", "left_semi").select("node")


def component_edges(seeds: DataFrame, inc: DataFrame, edges: DataFrame, k: int) -> DataFrame:
    """Edges of the components that hold a seed."""
    return edges_of(component_of(seeds, inc), edges, k)


def balls(seeds: DataFrame, inc: DataFrame, depth: int) -> DataFrame:
    """(seed, node): nodes up to `depth` steps from each seed by itself."""
    step = keep(inc.select("node", "neighbor").where("node <> neighbor").distinct(), "steps")
    front = seen = seeds.select(F.col("node").alias("seed"), "node").distinct()
    for _ in range(depth):
        new = front.join(step, "node").select("seed", F.col("neighbor").alias("node")).distinct()
        front = keep(new.join(seen, ["seed", "node"], "left_anti"), "front")
        seen = seen.unionByName(front)
    return seen


def reachable_in_sketch(sketch: DataFrame, ends: DataFrame, k: int, hash_of, known: DataFrame | None = None) -> DataFrame:
    """The probed incidence of every node reachable from read ends through a lossy table, false positives included.

    A lossy graph has no list of nodes, so this walks level by level. known: nodes that surely are reachable, as
    reads.read_nodes gives them: then only false positives are walked, and rounds don't grow with the reads.
    """
    starts = end_nodes(ends)
    front = seen = keep(starts if known is None else starts.unionByName(known.select("node")).distinct(), "seen")
    found, rounds = None, 0
    while True:
        # a round is one job; a node that was walked to has the edge it was reached by, so it is among the rows found
        count = Observation()
        rows = keep(probe(front, sketch, k, hash_of).observe(count, F.count(F.lit(1)).alias("n")), "probed")
        if rounds and not count.get["n"]:
            forget(rows)
            return found
        found = rows if found is None else found.unionByName(rows)
        if rounds:
            seen = seen.unionByName(rows.select("node").distinct())
        front = rows.select(F.col("neighbor").alias("node")).distinct().join(seen, "node", "left_anti")
        rounds += 1
        if rounds % 16 == 0:  # plans stay short
            seen, found = keep(seen, "seen"), keep(found, "found")
