"""Registered queries over the test tables, and the same in SQL. Each runs over all texts as a whole."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.functions import hashes as H
from weftgraph.functions import kmers as K
from weftgraph.operators import correct as C
from weftgraph.operators import evaluate as E
from weftgraph.operators import graph as G
from weftgraph.operators import reads as R
from weftgraph.operators import tables as T
from weftgraph.operators.durable import keep, scratch
from weftgraph.operators.steps import Steps
from weftgraph.sources import dot, store

from . import sql as S
from .dna import reads

#: k of the exact queries (nodes of even length, so palindromes occur), and k and hash bits of the lossy ones.
EXACT, LOSSY, BITS = 9, 10, 20
Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}
_sql: dict[str, str] = {}


def _query(sql: str | None = None):
    def add(f: Query) -> Query:
        _queries[f.__name__] = f
        if sql:
            _sql[f.__name__] = S.once(sql)
        return f

    return add


def _edge(k: int = EXACT):
    return K.unpack(F.col("edge"), k).alias("edge")


def _node(k: int = EXACT, name: str = "node"):
    return K.unpack(F.col(name), k - 1).alias(name)


def _edges(spark: SparkSession, d: str, table: str = "documents", k: int = EXACT) -> DataFrame:
    return R.exact_counts(reads(spark, d, table), k)


def _counted(spark: SparkSession, d: str, k: int = EXACT) -> DataFrame:
    """Counts, ends and nodes of all reads in one scan, on disk apart."""
    return keep(R.counted(reads(spark, d), k, nodes=True), "counted", "is_end")


def _ends(spark: SparkSession, d: str, k: int = EXACT) -> DataFrame:
    return R.end_counts(reads(spark, d), k)


def _inc(spark: SparkSession, d: str) -> DataFrame:
    return G.incidence(_edges(spark, d), EXACT)


def _keyed(df: DataFrame) -> DataFrame:
    return df.select(F.col("edge").alias("key"), "cnt")


def _named(df: DataFrame) -> DataFrame:
    return df.select(K.unpack(F.col("key"), EXACT).alias("edge"), "cnt")


EDGES = "WITH " + S.edges(EXACT)
INC = EDGES + S.incidence(EXACT)
ALL = INC + S.ends(EXACT)
THREE = "WITH " + S.edges(EXACT) + "," + S.edges(EXACT, "benchmark", "_b") + "," + S.edges(EXACT, "conversations", "_c")
SEEDS = f"seeds AS (SELECT DISTINCT node FROM inc WHERE {S.duplex('node')})"


# generators and counts


@_query("WITH " + S.kmers(EXACT) + " SELECT read_id, frag, seq FROM frags")
def fragments(spark, d):
    return R.fragments(reads(spark, d)).select("read_id", F.col("frag").cast("bigint").alias("frag"), "seq")


@_query(EDGES + " SELECT edge, cnt FROM edges")
def kmer_count(spark, d):
    return _edges(spark, d).select(_edge(), "cnt")


@_query(EDGES + " SELECT count(*) AS n_distinct, sum(cnt)::BIGINT AS total, max(cnt) AS max_count, count(*) FILTER (cnt > 1) AS n_repeated FROM edges")
def kmer_stats(spark, d):
    return T.statistics(_edges(spark, d))


@_query(EDGES + " SELECT cnt, count(*) AS n_keys FROM edges GROUP BY cnt")
def kmer_histogram(spark, d):
    return T.histogram(_edges(spark, d))


@_query("WITH " + S.kmers(EXACT) + " SELECT read_id, count(*) AS n_kmers, count(DISTINCT edge) AS n_edges, count(*) FILTER (edge = kmer) AS n_forward FROM kmers GROUP BY read_id")
def occurrences(spark, d):
    return R.occurrence_counts(reads(spark, d), EXACT)


@_query(EDGES + S.ends(EXACT) + " SELECT * FROM ends")
def read_ends(spark, d):
    return _ends(spark, d).select(_node(), "left_ends", "right_ends")


@_query(EDGES + S.ends(EXACT) + " SELECT DISTINCT node FROM ends")
def end_nodes(spark, d):
    return G.end_nodes(_ends(spark, d)).select(_node())


# scalar functions


@_query(EDGES + f" SELECT edge, translate(edge, 'ACGT', 'TGCA') AS complement, {S.rc('edge')} AS reversed, {S.canon(S.rc('edge'))} AS canonical, left(edge, 4) AS head, right(edge, 4) AS tail, right(edge || 'GA', {EXACT}) AS in_right, left('GA' || edge, {EXACT}) AS in_left, {S.packed('edge', EXACT)} AS packed FROM edges")
def canonical_scalars(spark, d):
    e = F.col("edge")
    rows = _edges(spark, d).select(_edge(), e.alias("packed"))
    return rows.select("edge", K.complement(e).alias("complement"), K.reverse_complement(e).alias("reversed"), K.canonical(K.reverse_complement(e)).alias("canonical"), K.prefix(e, 4).alias("head"), K.suffix(e, 4).alias("tail"), K.shift_in_right(e, F.lit("GA")).alias("in_right"), K.shift_in_left(F.lit("GA"), e).alias("in_left"), K.pack(e).alias("packed"))


_PERIODS = " ".join(f"WHEN left(edge, {EXACT - p}) = right(edge, {EXACT - p}) THEN {p}" for p in range(1, EXACT))


@_query(EDGES + f" SELECT edge, CASE {_PERIODS} ELSE {EXACT} END AS period FROM edges")
def kmer_period(spark, d):
    return _edges(spark, d).select(_edge()).select("edge", K.period(F.col("edge")).alias("period"))


_STEPS = S.chain(f"SELECT edge, {S.packed('edge', EXACT)} AS v FROM edges", S.mix("v", 2 * EXACT))


@_query(EDGES + ", " + _STEPS + " SELECT edge, hash, v AS back FROM s7")
def hash64_invertible(spark, d):
    rows = _edges(spark, d).select("edge", H.mix(F.col("edge"), 2 * EXACT).alias("hash"))
    return rows.select(_edge(), "hash", H.unmix(F.col("hash"), 2 * EXACT).alias("back"))


_A = [("a1", S.multiplied("v", H.M64)), ("a2", S.multiplied("xor(a1, a1 >> 47)", H.M64)), ("a3", S.multiplied(f"xor(a2, {8 * H.M64 % 2**64}::UBIGINT)", H.M64)), ("a4", S.multiplied("xor(a3, a3 >> 47)", H.M64)), ("a5", "xor(a4, a4 >> 47)")]
_32 = lambda h: f"((({h}) * {H.M32}::UBIGINT) & 4294967295::UBIGINT)"
_B = [("k1", _32("v & 4294967295::UBIGINT")), ("k2", _32("v >> 32"))] + [(f"l{i}", _32(f"xor(k{i}, k{i} >> {H.R32})")) for i in (1, 2)]
_B += [("b1", f"xor({_32('8::UBIGINT')}, l1)"), ("b2", "xor(0::UBIGINT, l2)"), ("c1", _32("xor(b1, b2 >> 18)")), ("c2", _32("xor(b2, c1 >> 22)")), ("d1", _32("xor(c1, c2 >> 17)")), ("d2", _32("xor(c2, d1 >> 19)"))]
_MURMUR = S.chain(f"SELECT edge, {S.packed('edge', EXACT)}::UBIGINT AS v FROM edges", _A + _B)


@_query(EDGES + ", " + _MURMUR + f" SELECT edge, {S.signed('a5')} AS a, {S.signed('(d1::UHUGEINT * 4294967296 + d2)')} AS b FROM s{len(_A + _B)}")
def murmur_hashes(spark, d):
    e = F.col("edge")
    return _edges(spark, d).select(_edge(), H.murmur64a(e).alias("a"), H.murmur64b(e).alias("b"))


_W32, _W64 = (S.packed(S.rc(f"repeat('C', {n - EXACT}) || edge"), n).replace("::BIGINT", "::HUGEINT") for n in (16, 32))


@_query(EDGES + f", w AS (SELECT edge, {_W32} AS w32, {_W64} AS w64 FROM edges) SELECT edge, w32::BIGINT AS w32, {S.signed('w64')} AS w64, {S.signed('w64')} AS high, -1::BIGINT AS low FROM w")
def word_reverse_complements(spark, d):
    e = F.col("edge")
    high, low = K.wide_reverse_complement(F.lit(0).cast("bigint"), e)
    return _edges(spark, d).select(_edge(), K.word_reverse_complement(e, 32).alias("w32"), K.word_reverse_complement(e, 64).alias("w64"), high.alias("high"), low.alias("low"))


# the width of real reads


LONG = 28
WIDE = "WITH " + S.edges(LONG)


@_query(WIDE + " SELECT edge, cnt FROM edges")
def kmer_count_28(spark, d):
    return _edges(spark, d, k=LONG).select(_edge(LONG), "cnt")


# graph


@_query(INC + " SELECT node, edge, side, w FROM inc")
def edge_sides(spark, d):
    return _inc(spark, d).select(_node(), _edge(), "side", "w")


@_query(INC + " SELECT edge, cnt FROM ends2 WHERE l = r")
def loops(spark, d):
    return G.loops(_edges(spark, d), EXACT).select(_edge(), "cnt")


@_query(INC + f" SELECT DISTINCT node, {S.constant('node')} AS is_constant FROM inc WHERE {S.duplex('node')}")
def duplex_nodes(spark, d):
    nodes = _inc(spark, d).select("node").distinct().where(K.packed_can_have_duplex_edges(F.col("node"), EXACT)).select(_node())
    return nodes.select("node", K.is_constant(F.col("node")).alias("is_constant"))


DEGREES = "SELECT node, count(*) FILTER (side = 'L') AS \"left\", count(*) FILTER (side = 'R') AS \"right\", count(*) FILTER (side = 'D') AS duplex, count(*) AS total FROM inc GROUP BY node"


@_query(INC + " " + DEGREES)
def degrees(spark, d):
    return G.degrees(_inc(spark, d)).select(_node(), "left", "right", "duplex", "total")


@_query(INC + " SELECT node, count(*) AS total FROM inc GROUP BY node HAVING count(*) < 2")
def leaf_nodes(spark, d):
    return G.leaf_nodes(_inc(spark, d)).select(_node(), "total")


@_query(INC + ", leaf AS (SELECT node FROM inc GROUP BY node HAVING count(*) < 2) SELECT DISTINCT edge FROM inc WHERE node IN (SELECT node FROM leaf)")
def leaf_edges(spark, d):
    return G.leaf_edges(_inc(spark, d)).select(_edge())


@_query(INC + " SELECT node, coalesce(sum(cnt) FILTER (side = 'L'), 0)::BIGINT AS \"left\", coalesce(sum(cnt) FILTER (side = 'R'), 0)::BIGINT AS \"right\", coalesce(sum(cnt) FILTER (side = 'D'), 0)::BIGINT AS duplex FROM inc GROUP BY node")
def side_abundance(spark, d):
    return G.side_abundance(_inc(spark, d)).select(_node(), "left", "right", "duplex")


FLOW = """, flow AS (SELECT node, coalesce(sum(w * cnt) FILTER (side = 'L'), 0)::BIGINT AS lv, coalesce(sum(w * cnt) FILTER (side = 'R'), 0)::BIGINT AS rv FROM inc GROUP BY node),
inv AS (SELECT node, lv - coalesce(left_ends, 0) AS left_value, rv - coalesce(right_ends, 0) AS right_value FROM flow LEFT JOIN ends USING (node))"""


@_query(ALL + FLOW + " SELECT node, left_value, right_value, right_value - left_value AS discrepancy FROM inv")
def invariant(spark, d):
    return G.balance(R.counted(reads(spark, d), EXACT), EXACT).select(_node(), "left_value", "right_value", "discrepancy")


@_query(ALL + " SELECT 1 AS step, 'counted' AS name, (SELECT count(*) FROM edges) + (SELECT count(*) FROM (SELECT DISTINCT node FROM marked)) AS n_rows UNION ALL SELECT 2, 'incidence', count(*) FROM inc UNION ALL SELECT 3, 'degrees', count(DISTINCT node) FROM inc UNION ALL SELECT 4, 'balance', count(DISTINCT node) FROM inc")
def build_steps(spark, d):
    """Rows of each table of a graph, as noted while it was written; Steps.table has the seconds too."""
    steps = Steps(spark)
    counts = steps.keep(R.counted(reads(spark, d), EXACT), "counted", "is_end")
    inc = steps.keep(G.incidence(R.edges_in(counts), EXACT), "incidence")
    steps.keep(G.degrees(inc), "degrees")
    steps.keep(G.balance(counts, EXACT), "balance")
    return steps.table().select("step", "name", "n_rows")


@_query(INC + " SELECT DISTINCT node, side, neighbor FROM inc")
def neighbors(spark, d):
    return G.neighbors(_inc(spark, d)).select(_node(), "side", _node(name="neighbor"))


def _seeds(inc: DataFrame) -> DataFrame:
    return inc.select("node").distinct().where(K.packed_can_have_duplex_edges(F.col("node"), EXACT))


BALL = "".join(f", b{i} AS (SELECT node, min(d) AS d FROM (SELECT node, d FROM b{i - 1} UNION ALL SELECT neighbor, {i} FROM inc JOIN b{i - 1} USING (node)) GROUP BY node)" for i in range(1, 4))
NEAR = INC + ", " + SEEDS + ", b0 AS (SELECT node, 0 AS d FROM seeds)" + BALL


@_query(NEAR + " SELECT node, d FROM b3")
def nearby_nodes_3(spark, d):
    inc = keep(_inc(spark, d), "incidence")
    return G.ball(_seeds(inc), inc, 3).select(_node(), "d")


@_query(NEAR + " SELECT edge, cnt FROM ends2 WHERE l IN (SELECT node FROM b3)")
def nearby_edges_3(spark, d):
    edges = keep(_edges(spark, d), "edges")
    inc = keep(G.incidence(edges, EXACT), "incidence")
    return G.edges_of(G.ball(_seeds(inc), inc, 3), edges, EXACT).select(_edge(), "cnt")


@_query("WITH RECURSIVE " + ALL.removeprefix("WITH ") + ", step AS (SELECT DISTINCT node, neighbor FROM inc), walk AS (SELECT node FROM ends UNION SELECT step.neighbor FROM step JOIN walk USING (node)) SELECT node FROM walk")
def reachable_nodes(spark, d):
    counts = _counted(spark, d)
    return G.reachable_nodes(G.incidence(R.edges_in(counts), EXACT), R.ends_in(counts), R.nodes_in(counts)).select(_node())


@_query("WITH RECURSIVE " + ALL.removeprefix("WITH ") + ", step AS (SELECT DISTINCT node, neighbor FROM inc), walk AS (SELECT node FROM ends UNION SELECT step.neighbor FROM step JOIN walk USING (node)) SELECT edge, cnt FROM ends2 WHERE l IN (SELECT node FROM walk)")
def reachable_edges(spark, d):
    counts = _counted(spark, d)
    edges = R.edges_in(counts)
    return G.edges_of(G.reachable_nodes(G.incidence(edges, EXACT), R.ends_in(counts), R.nodes_in(counts)), edges, EXACT).select(_edge(), "cnt")


@_query("WITH RECURSIVE " + INC.removeprefix("WITH ") + f", step AS (SELECT DISTINCT {S.packed('node', EXACT - 1)} AS node, {S.packed('neighbor', EXACT - 1)} AS neighbor FROM inc), near(node, component) USING KEY (node) AS (SELECT DISTINCT node, node FROM step UNION SELECT step.neighbor, min(near.component) FROM near JOIN step ON step.node = near.node JOIN recurring.near AS known ON known.node = step.neighbor WHERE near.component < known.component GROUP BY step.neighbor) SELECT {S.unpacked('node', EXACT - 1)} AS node, {S.unpacked('component', EXACT - 1)} AS component FROM near")
def components(spark, d):
    return G.components(_inc(spark, d)).select(_node(), _node(name="component"))


@_query("WITH RECURSIVE " + INC.removeprefix("WITH ") + ", " + SEEDS + ", step AS (SELECT DISTINCT node, neighbor FROM inc), walk AS (SELECT node FROM seeds UNION SELECT step.neighbor FROM step JOIN walk USING (node)) SELECT edge, cnt FROM ends2 WHERE l IN (SELECT node FROM walk)")
def component_edges(spark, d):
    edges = keep(_edges(spark, d), "edges")
    inc = keep(G.incidence(edges, EXACT), "incidence")
    return G.component_edges(_seeds(inc), inc, edges, EXACT).select(_edge(), "cnt")


@_query(
    ALL + " SELECT node, format('  {}[ label=\"{}\\n({}, {})\", style=filled, fillcolor={}, shape={} ];', node, node, coalesce(left_ends, 0), coalesce(right_ends, 0), CASE WHEN coalesce(left_ends + right_ends, 0) > 0 THEN 'grey' ELSE 'white' END, CASE WHEN " + S.duplex("node") + " THEN 'diamond' ELSE 'ellipse' END) AS line FROM (SELECT DISTINCT node FROM inc) LEFT JOIN ends USING (node)"
)
def dot_nodes(spark, d):
    return dot.dot_nodes(_inc(spark, d), _ends(spark, d), EXACT)


@_query(INC + " SELECT e.edge, format('  {} -> {}[ label=\"({}, {})\", tailport={}, headport={} ];', l, r, e.edge, e.cnt, CASE a.side WHEN 'L' THEN 'w' WHEN 'R' THEN 'e' ELSE 's' END, CASE b.side WHEN 'L' THEN 'w' WHEN 'R' THEN 'e' ELSE 's' END) AS line FROM ends2 e JOIN inc a ON a.edge = e.edge AND a.node = e.l JOIN inc b ON b.edge = e.edge AND b.node = e.r")
def dot_edges(spark, d):
    return dot.dot_edges(_edges(spark, d), EXACT)


_LINES = ", nodes AS (" + _sql["dot_nodes"].rpartition(" SELECT node, format(")[1].strip() + _sql["dot_nodes"].rpartition(" SELECT node, format(")[2] + "), arcs AS (SELECT e.l, " + _sql["dot_edges"].rpartition(" SELECT e.edge, ")[2] + ")"
_STEPS6 = ", near0 AS (SELECT DISTINCT l AS seed, l AS node FROM ends2 WHERE l = r)" + "".join(f", near{i} AS (SELECT seed, node FROM near{i - 1} UNION SELECT seed, neighbor FROM near{i - 1} JOIN inc USING (node))" for i in range(1, 7))


@_query(ALL + _STEPS6 + _LINES + " SELECT seed, line FROM near6 JOIN nodes USING (node) UNION ALL SELECT seed, line FROM near6 JOIN arcs ON arcs.l = near6.node")
def dot_balls(spark, d):
    """What lies within six steps of each loop's node."""
    edges = keep(_edges(spark, d), "edges")
    seeds = G.loops(edges, EXACT).select(K.left_node(F.col("edge"), EXACT).alias("node"))
    return dot.dot_balls(seeds, G.incidence(edges, EXACT), edges, _ends(spark, d), EXACT).select(_node(name="seed"), "line")


# algebra of tables


@_query(THREE + " SELECT edge, sum(cnt)::BIGINT AS cnt FROM (SELECT * FROM edges UNION ALL SELECT * FROM edges_b) GROUP BY edge")
def merge_tables(spark, d):
    return _named(T.merge(_keyed(_edges(spark, d)), _keyed(_edges(spark, d, "benchmark"))))


@_query(THREE + " SELECT edge, sum(cnt)::BIGINT AS cnt FROM (SELECT * FROM edges UNION ALL SELECT * FROM edges_b UNION ALL SELECT * FROM edges_c) GROUP BY edge")
def multi_merge(spark, d):
    return _named(T.merge(*[_keyed(_edges(spark, d, t)) for t in ("documents", "benchmark", "conversations")]))


@_query(THREE + " SELECT edge, cnt - coalesce(b, 0) AS cnt FROM edges LEFT JOIN (SELECT edge, cnt AS b FROM edges_b) USING (edge) WHERE cnt > coalesce(b, 0)")
def remove_counts(spark, d):
    return _named(T.decrement(_keyed(_edges(spark, d)), _keyed(_edges(spark, d, "benchmark"))))


@_query(THREE + " SELECT edge, cnt FROM edges WHERE edge NOT IN (SELECT edge FROM edges_b)")
def delete_keys(spark, d):
    return _named(T.delete_keys(_keyed(_edges(spark, d)), _keyed(_edges(spark, d, "benchmark"))))


@_query(EDGES + f" SELECT {S.packed('edge', EXACT)} % 4096 AS key, sum(cnt)::BIGINT AS cnt FROM edges GROUP BY 1")
def replace_keys(spark, d):
    return T.replace_keys(_keyed(_edges(spark, d)), F.pmod("key", F.lit(4096)))


@_query(THREE + " SELECT coalesce(sum(a.cnt * b.cnt), 0)::BIGINT AS inner_product FROM edges a JOIN edges_b b USING (edge)")
def inner_product(spark, d):
    return T.inner_product(_keyed(_edges(spark, d)), _keyed(_edges(spark, d, "benchmark")))


@_query(EDGES + " SELECT floor(sqrt(sum(cnt * cnt)))::BIGINT AS magnitude FROM edges")
def magnitude(spark, d):
    return T.magnitude(_edges(spark, d))


@_query(THREE + " SELECT edge, coalesce(e.cnt, 0) AS cnt FROM edges_b LEFT JOIN edges e USING (edge)")
def point_lookup(spark, d):
    return _named(T.lookup(_keyed(_edges(spark, d, "benchmark")).select("key"), _keyed(_edges(spark, d))))


def _clustered(table: DataFrame) -> DataFrame:
    """The table as a clustered store in the shared folder, opened again."""
    path = scratch(table.sparkSession, "store")
    store.save_clustered(table, path, buckets=16)
    return store.open_clustered(table.sparkSession, path)


@_query(THREE + " SELECT edge, sum(cnt)::BIGINT AS cnt FROM (SELECT * FROM edges UNION ALL SELECT * FROM edges_b UNION ALL SELECT * FROM edges_c) GROUP BY edge")
def stored_merge(spark, d):
    """Three clustered tables, bucket by bucket."""
    return _named(store.merge(*[_clustered(_keyed(_edges(spark, d, t))) for t in ("documents", "benchmark", "conversations")]))


@_query(THREE + " SELECT edge, coalesce(e.cnt, 0) AS cnt FROM edges_b LEFT JOIN edges e USING (edge)")
def stored_lookup(spark, d):
    return _named(store.lookup(_keyed(_edges(spark, d, "benchmark")).select("key"), _clustered(_keyed(_edges(spark, d)))))


@_query(THREE + " SELECT edge, cnt FROM edges SEMI JOIN (SELECT edge, cnt AS less FROM edges_b) b ON b.edge = edges.edge AND less >= cnt")
def lost_edges(spark, d):
    """False negatives of a table from which the counts of other texts were taken."""
    exact = _edges(spark, d)
    left = T.decrement(exact, _edges(spark, d, "benchmark"), key="edge")
    return E.false_negatives(left, exact).select(_edge(), "cnt")


@_query(THREE + " SELECT edge, greatest(cnt - coalesce(amount, 0), 0) AS cnt FROM edges LEFT JOIN (SELECT edge, cnt AS amount FROM edges_b) USING (edge)")
def corrected_abundance(spark, d):
    """Counts less a table of corrections; here, those are the counts of other texts."""
    return G.abundance(_edges(spark, d), _edges(spark, d, "benchmark").withColumnRenamed("cnt", "amount")).select(_edge(), "cnt")


# lossy tables


def _hash(edge):
    return H.multiply_shift(edge, BITS)


@_query("WITH " + S.edges(LOSSY) + f" SELECT (({S.packed('edge', LOSSY)} * 2654435761) % 4294967296) // {1 << (32 - BITS)} AS hash, sum(cnt)::BIGINT AS cnt FROM edges GROUP BY 1")
def sketch_count(spark, d):
    return R.sketch_counts(_edges(spark, d, k=LOSSY), _hash)


def _lossy(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(exact edges, ends, reachable incidence of the lossy table)"""
    counts = _counted(spark, d, LOSSY)
    exact, ends = R.edges_in(counts), R.ends_in(counts)
    sketch = keep(R.sketch_counts(exact, _hash), "sketch")
    return exact, ends, G.reachable_in_sketch(sketch, ends, LOSSY, _hash, R.nodes_in(counts))


def _found(inc: DataFrame) -> DataFrame:
    return inc.select("edge", F.col("occ").alias("cnt")).distinct()


WALKED = "WITH RECURSIVE " + S.edges(LOSSY) + S.ends(LOSSY) + S.lossy(LOSSY, BITS)


@_query(WALKED + f" SELECT {S.unpacked('e', LOSSY)} AS edge, occ AS cnt FROM found WHERE e NOT IN (SELECT e FROM exact)")
def false_positives(spark, d):
    exact, _, inc = _lossy(spark, d)
    return E.false_positives(_found(inc), exact).select(_edge(LOSSY), "cnt")


@_query(WALKED + f" SELECT {S.unpacked('e', LOSSY)} AS edge, occ AS cnt, coalesce(cnt, 0) AS exact FROM found LEFT JOIN exact USING (e) WHERE occ <> coalesce(cnt, 0)")
def abundance_errors(spark, d):
    exact, _, inc = _lossy(spark, d)
    return E.abundance_errors(_found(inc), exact).select(_edge(LOSSY), "cnt", "exact")


@_query("WITH RECURSIVE " + (("WITH " + S.edges(LOSSY) + S.incidence(LOSSY) + S.ends(LOSSY)).removeprefix("WITH ")) + ", step AS (SELECT DISTINCT node, neighbor FROM inc), walk AS (SELECT node FROM ends UNION SELECT step.neighbor FROM step JOIN walk USING (node)) SELECT edge, cnt FROM ends2 WHERE l NOT IN (SELECT node FROM walk)")
def false_negatives(spark, d):
    exact, _, inc = _lossy(spark, d)
    return E.false_negatives(_found(inc), exact).select(_edge(LOSSY), "cnt")


@_query("WITH " + S.edges(LOSSY) + " SELECT edge, cnt FROM edges")
def correction_result(spark, d):
    """Corrected counts; here, all edges are reachable and the correction restores the exact table."""
    _, ends, inc = _lossy(spark, d)
    return C.correct(inc, ends, LOSSY).where("cnt > 0").select(_edge(LOSSY), "cnt")


@_query(WALKED + " SELECT count(*) FILTER (fixed > cnt) AS over, count(*) FILTER (fixed < cnt) AS under, count(*) FILTER (fixed > 0 AND cnt = 0) AS false_positives, count(*) FILTER (fixed = 0 AND cnt > 0) AS false_negatives FROM (SELECT coalesce(exact.cnt, 0) AS cnt, CASE WHEN found.e IS NULL THEN 0 ELSE coalesce(exact.cnt, 0) END AS fixed FROM found FULL JOIN exact USING (e))")
def correction_errors(spark, d):
    """Here, the correction settles every edge that the walk found, as correction_result says; the SQL takes that as given."""
    exact, ends, inc = _lossy(spark, d)
    return E.errors(C.correct(inc, ends, LOSSY).select("edge", "cnt"), exact)


@_query()
def local_correction(spark, d):
    _, ends, inc = _lossy(spark, d)
    probes = E.random_probes(spark, 1_000_000, LOSSY)
    centres = probes.select(K.left_node(F.col("edge"), LOSSY).alias("node")).distinct()
    near = keep(G.ball(centres, inc, C.RADIUS).select("node").distinct(), "near")
    return C.correct(inc, ends, LOSSY, near, hash_rules=False).where("amount > 0").select(_edge(LOSSY), "cnt", "amount")


PROBES = S.chain("SELECT i + 1073741824 AS v FROM range(1000000) t(i)", S.mix("v", 40)) + f", drawn AS (SELECT {S.canon_number(f'(hash >> {40 - 2 * LOSSY})', LOSSY)} AS e FROM s7)"


@_query("WITH " + S.edges(LOSSY) + ", " + PROBES + f", probes AS (SELECT {S.unpacked('e', LOSSY)} AS edge FROM drawn) SELECT edge, coalesce(cnt, 0) AS cnt FROM probes LEFT JOIN edges USING (edge)")
def random_lookups(spark, d):
    table = _keyed(_edges(spark, d, k=LOSSY))
    return T.lookup(E.random_probes(spark, 1_000_000, LOSSY).select(F.col("edge").alias("key")), table).select(K.unpack(F.col("key"), LOSSY).alias("edge"), "cnt")


WHP = ALL + FLOW + ", off AS (SELECT node FROM inv WHERE left_value <> right_value), b0 AS (SELECT node, 0 AS d FROM off)" + BALL
_SHORT = " OR ".join(f"left(edge, {EXACT - p}) = right(edge, {EXACT - p})" for p in range(1, C.SHORT_PERIOD + 1))


@_query(WHP + f" SELECT edge FROM ends2 WHERE l NOT IN (SELECT node FROM b3) AND NOT ({_SHORT})")
def whp_correct(spark, d):
    counts = _counted(spark, d)
    edges = R.edges_in(counts)
    inc = keep(G.incidence(edges, EXACT), "incidence")
    return C.correct_with_high_probability(inc, edges, R.ends_in(counts), EXACT).select(_edge())


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flow invariant and degrees of every node."""
    return invariant(spark, sf_dir).join(degrees(spark, sf_dir), "node")


def queries() -> dict[str, Query]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_sql)
