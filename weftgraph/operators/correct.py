"""Correction of a lossy table's too-high counts by the flow invariant and by hash collisions, in synchronous rounds.

Edges near a node out of balance, or near a node of short period, might be wrong, as might all that share a hash with
them. Every round looks at all nodes at once and settles edges by three rules; edges of one hash share its count, which
settles more (whole graphs only). Proposals for one edge combine by their minimum. A round reads only the edges that are open
and those that were just settled: what is settled moves into sums that nodes and hashes carry along, so rounds get smaller.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from weftgraph.functions import kmers as K

from . import graph as G
from .durable import keep

SHORT_PERIOD, RADIUS = 6, 3


def has_short_period(v: Column, length: int, most: int = SHORT_PERIOD) -> Column:
    """The packed string of this length has a period of `most` or less."""
    out = F.lit(length <= most)
    for p in range(1, min(most, length - 1) + 1):
        out = out | (K.packed_prefix(v, length, length - p) == K.packed_suffix(v, length - p))
    return out


def _distinct_edges(inc: DataFrame) -> DataFrame:
    return inc.select("edge", "hash", "occ").distinct()


def suspects(inc: DataFrame, ends: DataFrame, k: int, nodes: DataFrame | None = None) -> DataFrame:
    """(edge) near a node (of `nodes`, or any) that is out of balance or of short period."""
    found = G.invariant(inc.select("node", "edge", "side", "w"), _distinct_edges(inc).select("edge", F.col("occ").alias("cnt")), ends)
    if nodes is not None:
        found = found.join(nodes.select("node"), "node", "left_semi")
    seeds = found.where((F.col("discrepancy") != 0) | has_short_period(F.col("node"), k - 1)).select("node")
    near = G.ball(seeds, inc, RADIUS)
    return G.edges_of(near, _distinct_edges(inc), k).select("edge")


def correct(inc: DataFrame, ends: DataFrame, k: int, nodes: DataFrame | None = None, hash_rules: bool = True) -> DataFrame:
    """(edge, occ, cnt, amount, unresolved) of the edges of inc, as probed from a lossy table.

    amount comes off occ to give cnt. unresolved edges might still be wrong. With `nodes`, only what is near them is
    looked at, and hash rules, which need the whole graph, have to be off.
    """
    inc = keep(inc.select("node", "edge", "side", "w", "neighbor", "hash", "occ"), "incidence")
    all_edges = _distinct_edges(inc)
    maybe = keep(suspects(inc, ends, k, nodes), "suspects")
    if hash_rules:
        hashes = all_edges.join(maybe, "edge", "left_semi").select("hash").distinct()
        shared = all_edges.join(hashes, "hash", "left_semi")
        crowded = shared.groupBy("hash").agg(F.count("*").alias("n")).where("n > 1").select("hash")
        members = shared.join(crowded, "hash", "left_semi")
    else:
        members = all_edges.join(maybe, "edge", "left_semi")
    members = members.select("edge", "hash")
    table = keep(_opened(inc, members, ends), "open")
    done = []
    while True:
        # a round costs three shuffles of the edges that are still open, and of those that the last round settled
        seen = Observation()
        table = keep(_hash_round(_flow_round(table), hash_rules).observe(seen, F.count_if("moved").alias("moved")), "open")
        done.append(table)
        if not seen.get["moved"]:
            break
    settled = reduce(lambda x, y: x.unionByName(y), [t.where("not open").select("edge", "ab", "open") for t in done] + [table.where("open").select("edge", "ab", "open")])
    cnt = F.coalesce("ab", "occ")
    return all_edges.join(settled, "edge", "left").select("edge", "occ", cnt.alias("cnt"), (F.col("occ") - cnt).alias("amount"), (F.coalesce("open", F.lit(False)) & (cnt > 0)).alias("unresolved"))


#: What an edge carries of each of its nodes: `left` and `right` are the flow on each side that is settled, less the read ends.
END = ["node", "side", "w", "left", "right", "no_left_ends", "no_right_ends"]
#: What an edge carries of its own: of its hash, how much and how many edges are settled.
OWN = ["edge", "hash", "occ", "ab", "open", "spent", "settled"]


def _opened(inc: DataFrame, members: DataFrame, ends: DataFrame) -> DataFrame:
    """A row for each edge that might be wrong, with its nodes; all other edges at these nodes are in the nodes' sums."""
    marked = inc.select("node", "edge", "side", "w", "hash", "occ").join(members.select("edge", F.lit(True).alias("open")), "edge", "left").withColumn("open", F.coalesce("open", F.lit(False)))
    fixed = lambda s: F.coalesce(F.sum(F.when((F.col("side") == s) & ~F.col("open"), F.col("w") * F.col("occ"))), F.lit(0))
    nodes = marked.groupBy("node").agg(fixed("L").alias("left"), fixed("R").alias("right"), F.max("open").alias("any")).where("any").join(ends, "node", "left").na.fill(0, ["left_ends", "right_ends"])
    nodes = nodes.select("node", (F.col("left") - F.col("left_ends")).alias("left"), (F.col("right") - F.col("right_ends")).alias("right"), (F.col("left_ends") == 0).alias("no_left_ends"), (F.col("right_ends") == 0).alias("no_right_ends"))
    rows = marked.where("open").join(nodes, "node")
    zero = F.lit(0).cast("bigint")
    return rows.groupBy("edge").agg(F.first("hash").alias("hash"), F.first("occ").alias("occ"), F.collect_list(F.struct(*END)).alias("ends")).select("edge", "hash", "occ", F.col("occ").alias("ab"), F.lit(True).alias("open"), zero.alias("spent"), zero.alias("settled"), "ends")


def _flow_round(edges: DataFrame) -> DataFrame:
    """Edges still open, after every node at once has made its proposals; edges that the last round settled move into the sums of
    their nodes and are gone."""
    rows = edges.select(*OWN, F.explode("ends").alias("x")).select(*OWN, "x.*").withColumn("doubt", F.col("open") & (F.col("ab") > 0))
    side = lambda s, also=True: F.coalesce(F.sum(F.when((F.col("side") == s) & also, F.col("w") * F.col("ab"))), F.lit(0))
    doubts = lambda s: F.count_if(F.col("doubt") & (F.col("side") == s))
    per_node = rows.groupBy("node").agg(
        *[F.first(c).alias(c) for c in ("left", "right", "no_left_ends", "no_right_ends")],
        side("L").alias("own_l"),
        side("R").alias("own_r"),
        side("L", ~F.col("open")).alias("closed_l"),
        side("R", ~F.col("open")).alias("closed_r"),
        doubts("L").alias("nl"),
        doubts("R").alias("nr"),
        F.count_if("doubt").alias("n"),
        # a node has eight edges at most
        F.collect_list(F.struct(*OWN, "side", "w", "doubt")).alias("e"),
    )
    per_node = per_node.withColumns({"lv": F.col("left") + F.col("own_l"), "rv": F.col("right") + F.col("own_r")})
    per_node = per_node.withColumns({"disc": F.col("rv") - F.col("lv"), "left": F.col("left") + F.col("closed_l"), "right": F.col("right") + F.col("closed_r")})
    asked = F.col("n") > 0
    balanced = asked & (F.col("disc") == 0)
    right_empty = asked & ~balanced & (F.col("lv") == 0) & F.col("no_right_ends")
    left_empty = asked & ~balanced & ~right_empty & (F.col("rv") == 0) & F.col("no_left_ends")
    single = ~balanced & ~right_empty & ~left_empty & (F.col("n") == 1)
    each = per_node.select("*", F.explode("e").alias("x")).drop("e").select("*", "x.*").where("open")
    implied = F.when(F.col("side") == "L", F.col("disc")).when(F.col("side") == "R", -F.col("disc")).otherwise(0)
    implied = F.floor(implied / F.col("w")).cast("bigint")
    target = (
        F.when(balanced & (((F.col("nl") == 0) & (F.col("side") == "R")) | ((F.col("nl") > 0) & (F.col("nr") == 0) & (F.col("side") == "L"))), F.col("ab"))
        .when((right_empty & (F.col("side") == "R")) | (left_empty & (F.col("side") == "L")), F.lit(0))
        .when(single & F.col("doubt") & (implied < 0) & (F.col("ab") + implied >= 0), F.col("ab") + implied)
    )
    proposed = each.withColumn("target", target.cast("bigint")).groupBy("edge").agg(*[F.first(c).alias(c) for c in OWN if c not in ("edge", "open")], F.min("target").alias("target"), F.collect_list(F.struct(*END)).alias("ends"))
    moved = F.col("target").isNotNull()
    return proposed.select("edge", "hash", "occ", F.coalesce("target", "ab").alias("ab"), (~moved).alias("open"), "spent", "settled", "ends", moved.alias("moved"))


def _hash_round(edges: DataFrame, hash_rules: bool) -> DataFrame:
    if not hash_rules:
        return edges
    same = Window.partitionBy("hash")
    closed = lambda x: F.coalesce(F.sum(F.when(~F.col("open"), x)).over(same), F.lit(0))
    held = edges.withColumns({"spent": F.col("spent") + closed(F.col("ab")), "settled": F.col("settled") + closed(F.lit(1))})
    bound = F.col("open") & (F.col("settled") > 0)
    held = held.withColumn("budget", F.greatest(F.col("occ") - F.col("spent"), F.lit(0))).withColumn("new", F.when(bound, F.least("ab", "budget")).otherwise(F.col("ab")))
    closes = bound & (F.sum(F.when(F.col("open"), F.col("new"))).over(same) == F.col("budget"))
    held = held.withColumn("closes", closes)
    return held.select("edge", "hash", "occ", F.col("new").alias("ab"), (F.col("open") & ~F.col("closes")).alias("open"), "spent", "settled", "ends", (F.col("moved") | F.col("closes") | (F.col("new") != F.col("ab"))).alias("moved"))


def correct_with_high_probability(inc: DataFrame, edges: DataFrame, ends: DataFrame, k: int) -> DataFrame:
    """(edge) of which every node up to three steps from the left node is balanced, and whose own period is over 6."""
    off = G.invariant(inc, edges, ends).where("discrepancy <> 0").select("node")
    near_off = G.ball(off, inc, RADIUS).select("node")
    left = K.left_node(F.col("edge"), k)
    good = edges.where(~has_short_period(F.col("edge"), k))
    return good.join(near_off.withColumnRenamed("node", "__bad"), left == F.col("__bad"), "left_anti").select("edge")
