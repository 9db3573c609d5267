"""Counting, graph, correction and evaluation on small graphs."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from weftgraph.functions import hashes as H
from weftgraph.functions import kmers as K
from weftgraph.operators import correct as C
from weftgraph.operators import evaluate as E
from weftgraph.operators import graph as G
from weftgraph.operators import reads as R
from weftgraph.operators import tables as T

from .test_scalars import canon, number


def as_reads(spark, seqs):
    return spark.createDataFrame(list(enumerate(seqs)), "read_id long, seq string").repartition(2)


def build(spark, seqs, k):
    reads = as_reads(spark, seqs)
    edges, ends = R.exact_counts(reads, k).cache(), R.end_counts(reads, k).cache()
    return edges, ends, G.incidence(edges, k).cache()


def text(df, k, *names):
    return df.select(*[K.unpack(F.col(n), k if n == "edge" else k - 1).alias(n) if n in ("edge", "node", "neighbor", "component") else F.col(n) for n in names])


def rows(df, k, *names):
    return sorted(tuple(x) for x in text(df, k, *names).collect())


def test_small_graph(spark):
    k = 5
    edges, ends, inc = build(spark, ["AAAGA", "CGAATTGGA"], k)
    assert rows(edges, k, "edge", "cnt") == sorted((e, 1) for e in ["TCTTT", "ATTCG", "GAATT", "AATTG", "ATTGG", "TTGGA"])
    found = {x[0]: x[1:] for x in rows(G.degrees(inc), k, "node", "left", "right", "duplex", "total")}
    assert found[canon("TGGA")] == (1, 0, 0, 1) and found[canon("AATT")] == (0, 0, 2, 2) and found[canon("GAAT")][:3] == (1, 1, 0)
    assert found[canon("TTCG")] == (1, 0, 0, 1)
    assert {x[0] for x in rows(G.leaf_nodes(inc), k, "node")} >= {canon(x) for x in ("CGAA", "TGGA", "AAAG", "AAGA")}
    assert canon("AATT") not in {x[0] for x in rows(G.leaf_nodes(inc), k, "node")}
    assert {x[0] for x in rows(G.leaf_edges(inc), k, "edge")} == {canon(x) for x in ("CGAAT", "TTGGA", "AAAGA")}
    around = {(n, s): set() for n, s, _ in rows(G.neighbors(inc), k, "node", "side", "neighbor")}
    for n, s, m in rows(G.neighbors(inc), k, "node", "side", "neighbor"):
        around[n, s].add(m)
    assert around[canon("AATT"), "D"] == {canon("ATTG"), canon("GAAT")}
    assert around[canon("TGGA"), "L"] == {canon("TTGG")}
    assert {x[0]: x[1:] for x in rows(ends, k, "node", "left_ends", "right_ends")} == {canon("TTCG"): (1, 0), canon("TGGA"): (1, 0), canon("AAAG"): (0, 1), canon("TCTT"): (0, 1)}
    assert {x[0] for x in G.invariant(inc, edges, ends).select("discrepancy").collect()} == {0}
    assert {x[0]: x[1:] for x in rows(G.side_abundance(inc, edges), k, "node", "left", "right", "duplex")}[canon("AATT")] == (0, 0, 2)


def test_second_small_graph(spark):
    edges, ends, inc = build(spark, ["ACTGAATGC"], 5)
    assert [x[0] for x in rows(edges, 5, "edge")] == sorted(canon(x) for x in ("ACTGA", "CTGAA", "TGAAT", "GAATG", "AATGC"))
    assert {x[0] for x in rows(inc, 5, "node")} == {canon(x) for x in ("ACTG", "CTGA", "TGAA", "GAAT", "AATG", "ATGC")}
    assert sum(x[1] + x[2] for x in rows(ends, 5, "node", "left_ends", "right_ends")) == 2


def some_reads(r, n=6, long=40):
    out = []
    for _ in range(n):
        s = "".join(r.choice(r.choice(["ACGT", "AC", "A", "AT"])) for _ in range(r.randint(1, long)))
        out.append(s if r.random() < 0.7 else s[: len(s) // 2] + r.choice(["N", "NN", "a", "\r"]) + s[len(s) // 2 :])
    return out + [r.choice(out), "", "N", "A" * 30, "AC" + "G" * 30]


@pytest.mark.parametrize("k", [4, 5, 6, 7])
def test_exact_counts_balance_every_node(spark, k):
    r = random.Random(k)
    for _ in range(3):
        seqs = some_reads(r, 12)
        edges, ends, inc = build(spark, seqs, k)
        want = Counter()
        for s in seqs:
            for i in range(len(s) - k + 1):
                if set(s[i : i + k]) <= set("ACGT"):
                    want[canon(s[i : i + k])] += 1
        assert dict(rows(edges, k, "edge", "cnt")) == want
        assert G.invariant(inc, edges, ends).where("discrepancy <> 0").count() == 0


def test_n_as_a_and_fragments(spark):
    reads = as_reads(spark, ["ACGNACGT", "NNACGNN", "", "acgACG", "ACG\rT"])
    assert sorted((x.read_id, x.frag, x.seq) for x in R.fragments(reads, 3).collect()) == [(0, 0, "ACG"), (0, 1, "ACGT"), (1, 0, "ACG"), (3, 0, "ACG"), (4, 0, "ACG")]
    assert dict(rows(R.exact_counts(as_reads(spark, ["ACGNACG"]), 7, n_policy="as_a"), 7, "edge", "cnt")) == {canon("ACGAACG"): 1}
    got = R.occurrences(as_reads(spark, ["ACGNACGT"]), 3).orderBy("pos").collect()
    assert [x.pos for x in got] == [0, 4, 5] and got[0].kmer == number("ACG")


def test_traversal(spark):
    k = 5
    r = random.Random(9)
    seqs = ["".join(r.choice("ACGT") for _ in range(30)) for _ in range(4)] + ["A" * 12]
    edges, ends, inc = build(spark, seqs, k)
    step = {}
    for n, m in rows(inc, k, "node", "neighbor"):
        step.setdefault(n, set()).add(m)
    seed = sorted(step)[0]
    seen, front = {seed: 0}, [seed]
    for d in range(1, 4):
        front = [m for n in front for m in step[n] if m not in seen and not seen.update({m: d})]
    start = spark.createDataFrame([(number(seed),)], "node long")
    assert dict(rows(G.ball(start, inc, 3), k, "node", "d")) == seen
    near = {x[0] for x in rows(G.edges_of(G.ball(start, inc, 3), edges, k), k, "edge")}
    assert near == {e for (e,) in rows(edges, k, "edge") if canon(e[:-1]) in seen}
    label = {n: n for n in step}
    for _ in step:
        label = {n: min([label[n], *(label[m] for m in step[n])], key=number) for n in step}
    assert dict(rows(G.components(inc), k, "node", "component")) == label
    starts = {x[0] for x in rows(G.end_nodes(ends), k, "node")}
    reached = {n for n in step if label[n] in {label[s] for s in starts}} | starts
    assert {x[0] for x in rows(G.reachable_nodes(inc, ends), k, "node")} == reached
    # a read of one repeated base has no ends, so its component can't be reached
    assert canon("AAAA") in step and (canon("AAAA") in reached) == (label[canon("AAAA")] in {label[s] for s in starts})
    assert {x[0] for x in rows(G.component_of(start, inc), k, "node")} == {n for n in step if label[n] == label[seed]}


def test_table_algebra(spark):
    t = lambda x: spark.createDataFrame(x, "key long, cnt long")
    a, b, none = t([(1, 2), (2, 5), (0, 1)]), t([(2, 3), (3, 7)]), t([])
    get = lambda df: sorted(tuple(x) for x in df.select("key", "cnt").collect())
    assert get(T.merge(a, b)) == [(0, 1), (1, 2), (2, 8), (3, 7)] and get(T.merge(a, none)) == get(a) and get(T.merge(a, b, a)) == [(0, 2), (1, 4), (2, 13), (3, 7)]
    assert get(T.decrement(a, t([(2, 9), (1, 1), (8, 1)]))) == [(0, 1), (1, 1)]
    assert get(T.delete_keys(a, b)) == [(0, 1), (1, 2)] and get(T.replace_keys(a, F.col("key") % 2)) == [(0, 6), (1, 2)]
    assert get(T.lookup(b.select("key"), a)) == [(2, 5), (3, 0)]
    assert T.inner_product(a, b).first()[0] == 15 and T.inner_product(a, none).first()[0] == 0 and T.magnitude(a).first()[0] == 5 and T.magnitude(none).first()[0] == 0
    assert abs(T.cosine(a, a).first()[0] - 1) < 1e-9
    assert tuple(T.statistics(a).first()) == (3, 8, 5, 2) and tuple(T.statistics(none).first()) == (0, 0, 0, 0)
    assert sorted(tuple(x) for x in T.histogram(T.merge(a, b)).collect()) == [(1, 1), (2, 1), (7, 1), (8, 1)]
    assert T.count_distinct(a.union(a)).first()[0] == 3 and get(T.increment(a, b)) == get(T.merge(a, b))


@pytest.mark.parametrize("bits", [14])
def test_correction_restores_exact_counts(spark, bits):
    k, r = 9, random.Random(bits)
    genome = "".join(r.choice("ACGT") for _ in range(90))
    seqs = [genome[a : a + 20] for a in (r.randrange(70) for _ in range(12))]
    edges, ends, _ = build(spark, seqs, k)
    hash_of = lambda e: H.multiply_shift(e, bits)
    sketch = R.sketch_counts(edges, hash_of).cache()
    inc = G.reachable_in_sketch(sketch, ends, k, hash_of).cache()
    found = inc.select("edge", F.col("occ").alias("cnt")).distinct()
    # a lossy count is never too low
    assert found.join(edges.withColumnRenamed("cnt", "exact"), "edge").where("cnt < exact").count() == 0
    assert E.false_negatives(found, edges).count() == 0
    done = C.correct(inc, ends, k)
    assert tuple(E.errors(done.select("edge", "cnt"), edges).first()) == (0, 0, 0, 0)
    assert done.where("amount < 0").count() == 0
    assert E.abundance_errors(found, edges).count() >= E.false_positives(found, edges).count()
    nodes = inc.select("node").distinct()
    local = C.correct(inc, ends, k, nodes, hash_rules=False)
    assert E.errors(local.select("edge", "cnt"), edges).first()["under"] == 0
    whp = C.correct_with_high_probability(G.incidence(edges, k), edges, ends, k)
    assert whp.count() == edges.where(~C.has_short_period(F.col("edge"), k)).count()


def settled(inc, ends, k, hash_rules, radius=3, short=6):
    """The rules one node and one hash at a time, over dictionaries: {edge: (count, unresolved)}. inc: (node, edge, side, w,
    neighbor, hash, occ); ends: {node: (left, right)}."""
    at, occ, hashed, steps, left_of = {}, {}, {}, {}, {}
    for node, edge, side, w, neighbor, h, o in inc:
        at.setdefault(node, []).append((edge, side, w))
        steps.setdefault(node, set()).add(neighbor)
        occ[edge], hashed[edge] = o, h
        left_of[edge] = canon(edge[:-1])
    ab, is_open = dict(occ), {}

    def flow(node, side):
        return sum(w * ab[e] for e, s, w in at.get(node, []) if s == side) - ends.get(node, (0, 0))["LR".index(side)]

    def period(x):
        return next(p for p in range(1, len(x) + 1) if x[p:] == x[:-p] or p == len(x))

    near = {n for n in {*at, *ends} if flow(n, "L") != flow(n, "R") or period(n) <= short}
    for _ in range(radius):
        near |= {m for n in near for m in steps.get(n, ())}
    suspect = {e for e in occ if left_of[e] in near}
    if hash_rules:
        groups = {}
        for e in occ:
            groups.setdefault(hashed[e], []).append(e)
        suspect = {e for e in occ if len(groups[hashed[e]]) > 1 and any(x in suspect for x in groups[hashed[e]])}
    for e in suspect:
        is_open[e] = True
    while True:
        proposals = {}
        for node, own in at.items():
            doubts = [(e, s) for e, s, _ in own if is_open.get(e) and ab[e] > 0]
            if not doubts:
                continue
            lv, rv, (le, re_) = flow(node, "L"), flow(node, "R"), ends.get(node, (0, 0))
            nl, nr = (sum(s == x for _, s in doubts) for x in "LR")
            for e, s, w in own:
                if not is_open.get(e):
                    continue
                if lv == rv:
                    new = ab[e] if (nl == 0 and s == "R") or (nl > 0 and nr == 0 and s == "L") else None
                elif lv == 0 and re_ == 0:
                    new = 0 if s == "R" else None
                elif rv == 0 and le == 0:
                    new = 0 if s == "L" else None
                else:
                    change = {"L": rv - lv, "R": lv - rv, "D": 0}[s] // w
                    new = ab[e] + change if len(doubts) == 1 and ab[e] > 0 and change < 0 <= ab[e] + change else None
                if new is not None:
                    proposals[e] = min(new, proposals.get(e, new))
        moved = bool(proposals)
        for e, new in proposals.items():
            ab[e], is_open[e] = new, False
        if hash_rules:
            for group in groups.values():
                mine = [e for e in group if e in is_open]
                still = [e for e in mine if is_open[e]]
                if not still or len(still) == len(mine):
                    continue
                budget = max(0, occ[mine[0]] - sum(ab[e] for e in mine if not is_open[e]))
                for e in still:
                    moved |= ab[e] > budget
                    ab[e] = min(ab[e], budget)
                if sum(ab[e] for e in still) == budget:
                    moved = True
                    is_open.update(dict.fromkeys(still, False))
        if not moved:
            return {e: (ab[e], is_open.get(e, False) and ab[e] > 0) for e in occ}


@pytest.mark.parametrize(("k", "bits", "hash_rules"), [(7, 12, True), (7, 10, True), (9, 13, False)])
def test_correction_against_a_sequential_model(spark, k, bits, hash_rules):
    """Hundreds of small pieces in one graph, with loops, palindromes and tables so lossy that much can't be settled."""
    r = random.Random(k * bits)
    seqs = ["".join(r.choice("ACGT") for _ in range(r.randint(k, 3 * k))) for _ in range(220)]
    seqs += [r.choice(["AC", "ACG", "A", "AATT"]) * r.randint(3, 8) + "".join(r.choice("ACGT") for _ in range(k)) for _ in range(30)]
    seqs += [r.choice(seqs)[r.randint(0, 4) :] for _ in range(60)]
    edges, ends, _ = build(spark, seqs, k)
    hash_of = lambda e: H.multiply_shift(e, bits)
    inc = G.reachable_in_sketch(R.sketch_counts(edges, hash_of), ends, k, hash_of).cache()
    found = {e: (c, u) for e, c, u in rows(C.correct(inc, ends, k, None, hash_rules), k, "edge", "cnt", "unresolved")}
    want = settled(rows(inc, k, "node", "edge", "side", "w", "neighbor", "hash", "occ"), {n: (a, b) for n, a, b in rows(ends, k, "node", "left_ends", "right_ends")}, k, hash_rules)
    assert found == want
    exact = dict(rows(edges, k, "edge", "cnt"))
    lossy = dict(rows(inc, k, "edge", "occ"))
    assert any(lossy[e] != exact.get(e, 0) for e in lossy) and any(u for _, u in found.values()) == (bits != 12)
    assert bits == 10 or any(c != lossy[e] for e, (c, _) in found.items())


@pytest.mark.parametrize("k", [1, 33])
def test_k_outside_64_bits_is_an_error(spark, k):
    for count in (R.exact_counts, R.end_counts, R.read_nodes, R.occurrences):
        with pytest.raises(ValueError, match="from 2 to 32"):
            count(as_reads(spark, ["ACGT" * 20]), k)


def test_counts_and_ends_of_32_bases(spark):
    k, r = 32, random.Random(32)
    seqs = ["".join(r.choice("ACGT") for _ in range(90)) for _ in range(5)] + ["G" * 40]
    edges, ends, inc = build(spark, seqs, k)
    want = Counter(canon(s[i : i + k]) for s in seqs for i in range(len(s) - k + 1))
    unsigned = {(x.edge + (1 << 64)) % (1 << 64): x.cnt for x in edges.collect()}
    assert unsigned == {number(e): c for e, c in want.items()}
    assert {x[0] for x in G.invariant(inc, edges, ends).select("discrepancy").distinct().collect()} == {0}


def test_probes(spark):
    p = E.random_probes(spark, 1000, 28, 3)
    assert p.count() == 1000 and p.where((F.col("edge") < 0) | (F.col("edge") >= 1 << 56)).count() == 0
    assert p.where(F.col("edge") < K.packed_reverse_complement(F.col("edge"), 28)).count() == 0


def test_probe_queries_draw_the_whole_workload(monkeypatch):
    from weftgraph.plans import catalog

    class Drawn(Exception):
        pass

    def probes(spark, n, k, seed=1):
        raise Drawn(n)

    monkeypatch.setattr(catalog, "_lossy", lambda spark, d: (None, None, None))
    monkeypatch.setattr(catalog, "_edges", lambda *a, **k: None)
    monkeypatch.setattr(catalog, "_keyed", lambda df: None)
    monkeypatch.setattr(catalog.E, "random_probes", probes)
    for query in (catalog.local_correction, catalog.random_lookups):
        with pytest.raises(Drawn) as drawn:
            query(None, "")
        assert drawn.value.args == (1_000_000,)


def test_wide_kmers_against_brute_force(spark):
    """k = 28, the width of real reads: counts, nodes, ends, balance, and traversal from ends by both ways."""
    k, r = 28, random.Random(28)
    genome = "".join(r.choice("ACGT") for _ in range(260))
    seqs = [genome[a : a + r.randint(20, 120)] for a in (r.randrange(200) for _ in range(16))]
    seqs += ["A" * 60, "ACGTNACGT" * 9, genome[:27], genome[:28].lower(), "N".join((genome[100:140], genome[180:230]))]
    edges, ends, inc = build(spark, seqs, k)
    want = Counter(canon(f[i : i + k]) for s in seqs for f in re.findall("[ACGT]+", s) for i in range(len(f) - k + 1))
    assert rows(edges, k, "edge", "cnt") == sorted(want.items())
    nodes = {canon(e[:-1]) for e in want} | {canon(e[1:]) for e in want}
    assert {x[0] for x in rows(inc, k, "node")} == nodes
    assert {x[0] for x in G.invariant(inc, edges, ends).select("discrepancy").distinct().collect()} == {0}
    stats = T.statistics(edges).first()
    assert tuple(stats) == (len(want), sum(want.values()), max(want.values()), sum(v > 1 for v in want.values()))
    known = R.read_nodes(as_reads(spark, seqs), k)
    plain, quick = (rows(G.reachable_nodes(inc, ends, x), k, "node") for x in (None, known))
    assert plain == quick and {x[0] for x in plain} == nodes - {canon("A" * 27)}


def test_a_long_read_takes_no_more_rounds(spark, monkeypatch):
    r = random.Random(5)
    reads = as_reads(spark, ["".join(r.choice("ACGT") for _ in range(5000))])
    edges, ends = R.exact_counts(reads, 12).cache(), R.end_counts(reads, 12).cache()
    kept, real = [], G.keep
    monkeypatch.setattr(G, "keep", lambda df, name: kept.append(name) or real(df, name))
    found = G.reachable_nodes(G.incidence(edges, 12), ends, R.read_nodes(reads, 12))
    assert kept == ["seen", "front"] and found.count() == G.incidence(edges, 12).select("node").distinct().count()
    sketch = R.sketch_counts(edges, lambda e: H.multiply_shift(e, 24))
    kept.clear()
    walked = G.reachable_in_sketch(sketch, ends, 12, lambda e: H.multiply_shift(e, 24), R.read_nodes(reads, 12))
    assert len(kept) < 12 and edges.join(walked, "edge", "left_anti").count() == 0


def test_levels_of_components_grow_as_the_log_of_a_chain(spark, monkeypatch):
    n = 5000
    order = list(range(n))
    random.Random(3).shuffle(order)
    kept, real = [], G.keep
    monkeypatch.setattr(G, "keep", lambda df, name: kept.append(name) or real(df, name))
    for chain in (order, sorted(order)):
        chain = [*chain, n]
        pairs = [(a, b) for x, y in zip(chain, chain[1:]) for a, b in ((x, y), (y, x))]
        # a second component, a loop and a node alone
        inc = spark.createDataFrame([*pairs, (-7, n + 9), (n + 9, -7), (n + 5, n + 5)], "node long, neighbor long")
        kept.clear()
        got = dict(map(tuple, G.components(inc).collect()))
        assert got == {v: 0 for v in range(n + 1)} | {-7: -7, n + 9: -7, n + 5: n + 5}
        assert kept.count("steps") <= 14 and len(kept) < 60
    r = random.Random(5)
    reads = as_reads(spark, ["".join(r.choice("ACGT") for _ in range(5000))])
    edges, ends = R.exact_counts(reads, 12).cache(), R.end_counts(reads, 12).cache()
    kept.clear()
    inc = G.incidence(edges, 12).cache()
    assert G.reachable_nodes(inc, ends).count() == inc.select("node").distinct().count() and len(kept) < 60


def test_one_scan_gives_counts_ends_and_nodes(spark):
    r = random.Random(12)
    seqs = ["".join(r.choice("ACGTN" if i % 2 else "AACT") for _ in range(r.randint(0, 40))) for i in range(60)] + ["A" * 20, "ACACACACAC", None]
    for k in (4, 5):
        reads = as_reads(spark, seqs)
        counts = R.counted(reads, k, nodes=True).cache()
        pair = lambda df, *c: sorted(map(tuple, df.select(*c).collect()))
        assert pair(R.edges_in(counts), "edge", "cnt") == pair(R.exact_counts(reads, k), "edge", "cnt")
        assert pair(R.ends_in(counts), "node", "left_ends", "right_ends") == pair(R.end_counts(reads, k), "node", "left_ends", "right_ends")
        known = set(pair(R.read_nodes(reads, k), "node"))
        assert set(pair(R.nodes_in(counts), "node")) == known | set(pair(G.end_nodes(R.ends_in(counts)), "node"))
        inc = G.incidence(R.edges_in(counts), k)
        columns = "node", "left_value", "right_value", "discrepancy"
        whole = G.invariant(inc, None, R.ends_in(counts))
        plain = R.counted(reads, k)
        assert pair(G.balance(plain, k), *columns) == pair(whole, *columns) == pair(G.invariant(inc.drop("cnt"), R.edges_in(counts), R.ends_in(counts)), *columns)
        assert pair(G.side_abundance(inc), "node", "left", "right", "duplex") == pair(G.side_abundance(inc.drop("cnt"), R.edges_in(counts)), "node", "left", "right", "duplex")
        plan = G.balance(plain, k)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("MapInArrow") == 1 and "Join" not in plan


def test_abundance_component_edges_and_balls(spark, tmp_path):
    from weftgraph.sources import dot

    k = 5
    edges, ends, inc = build(spark, ["AAAGA", "CGAATTGGA", "CCCCTCCC"], k)
    less = spark.createDataFrame([(number(canon("AAAGA")), 1), (number(canon("TTGGA")), 5)], "edge long, amount long")
    got = dict(rows(G.abundance(edges, less), k, "edge", "cnt"))
    assert got[canon("AAAGA")] == 0 and got[canon("TTGGA")] == 0 and got[canon("GAATT")] == 1
    seed = spark.createDataFrame([(number(canon("TGGA")),)], "node long")
    chain = {canon(x) for x in ("CGAAT", "GAATT", "AATTG", "ATTGG", "TTGGA")}
    assert {x[0] for x in rows(G.component_edges(seed, inc, edges, k), k, "edge")} == chain
    ball = dot.dot_balls(seed, inc, edges, ends, k, depth=1)
    assert sorted(x.part for x in ball.collect()) == [1, 1, 2]
    dot.write_dot_balls(f"{tmp_path}/b", ball, k)
    lines = [x.value for x in spark.read.text(f"{tmp_path}/b/seed={canon('TGGA')}").collect()]
    assert lines[0] == f"digraph {canon('TGGA')} {{" and lines[-1] == "}" and len(lines) == 5


def test_a_walk_spells_few_nodes_at_once(spark):
    """A batch of any size was spelt at once, eight edges a node."""
    import tracemalloc
    from types import SimpleNamespace

    import numpy as np
    import pyarrow as pa

    nodes = SimpleNamespace(select=lambda c: SimpleNamespace(mapInArrow=lambda f, schema: SimpleNamespace(select=lambda *c: f)))
    spell = G.candidates(nodes, 10)
    of = lambda lo, hi: pa.RecordBatch.from_arrays([pa.array(np.arange(lo, hi))], names=["node"])
    tracemalloc.start()
    rows = sum(b.num_rows for b in spell(iter([of(0, 1 << 17)])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 30 << 20
    one = pa.Table.from_batches(spell(iter([of(0, 20_000)])))
    assert one.equals(pa.Table.from_batches([b for lo in range(0, 20_000, 1000) for b in spell(iter([of(lo, lo + 1000)]))]))
    assert rows > 7 << 17
