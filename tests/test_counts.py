"""How k-mers travel and are counted: stretches of reads, sums of tasks, sums of reads."""

import random
import tracemalloc
from collections import Counter
from types import SimpleNamespace

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from weftgraph.operators import reads as R

from .test_scalars import canon, number


def counted_by_hand(seqs, k):
    return Counter(canon(s[i : i + k]) for s in seqs for i in range(len(s) - k + 1) if not set(s[i : i + k]) - set("ACGT"))


def some_reads(seed=3):
    r = random.Random(seed)
    seqs = ["".join(r.choice("ACGTN" if i % 4 == 0 else "ACGT") for _ in range(r.randint(0, 400))) for i in range(60)]
    return seqs + ["A" * 700, "AC" * 150, "G" * 28, "", None] + seqs[:20] * 3 + ["".join({"A": "T", "C": "G"}.get(c, {"T": "A", "G": "C"}.get(c, c)) for c in s[::-1]) for s in seqs[20:40]]


@pytest.mark.parametrize("k", [12, 17, 28, 31])
@pytest.mark.parametrize(("sent", "at_once"), [(1 << 20, 4 << 20), (40, 100)])
def test_long_kmers_are_counted_from_stretches(spark, monkeypatch, k, sent, at_once):
    monkeypatch.setattr(R, "SENT", sent)
    monkeypatch.setattr(R, "COUNTED", at_once)
    monkeypatch.setattr(R, "BUCKETS", 5)
    seqs = some_reads()
    reads = spark.createDataFrame(list(enumerate(seqs)), "read_id long, seq string").repartition(3)
    found = [tuple(r) for r in R.exact_counts(reads, k).collect()]
    assert len(found) == len({e for e, _ in found})
    assert dict(found) == {number(e): c for e, c in counted_by_hand([s for s in seqs if s], k).items()}


def test_stretches_take_two_bytes_a_window(spark):
    """One row of 24 bytes for each window was sent before."""
    r = random.Random(4)
    reads = spark.createDataFrame([(i, "".join(r.choice("ACGT") for _ in range(5000))) for i in range(40)], "read_id long, seq string")
    sent = R.stretches(reads, 28, 16).agg(F.sum(F.octet_length("n") + F.octet_length("bases")).alias("bytes"), F.count("*").alias("rows")).first()
    assert sent["bytes"] < 2 * 40 * 4973
    assert sent["rows"] <= 16 * reads.rdd.getNumPartitions()


def test_stretches_that_come_again_are_sent_once(spark):
    r = random.Random(5)
    text = "".join(r.choice("ACGT") for _ in range(3000))
    reads = spark.createDataFrame([(i, text) for i in range(50)], "read_id long, seq string").coalesce(1)
    once = spark.createDataFrame([(0, text)], "read_id long, seq string")
    windows = lambda rows: rows.agg(F.sum(F.octet_length("n"))).first()[0]
    assert windows(R.stretches(reads, 28, 16)) <= 1.1 * windows(R.stretches(once, 28, 16))
    assert {r["cnt"] for r in R.exact_counts(reads, 28).collect()} == {50}


@pytest.mark.parametrize("k", [9, 31])
@pytest.mark.parametrize("repeated", [False, True])
def test_occurrences_are_counted_where_a_read_is(spark, monkeypatch, k, repeated):
    dealt = []
    real = R.keep
    monkeypatch.setattr(R, "keep", lambda df, *how: dealt.append(df.count()) or real(df, *how))
    seqs = [s for s in some_reads(6) if s is not None]
    ids = [(None if i % 7 == 0 else i % 11) if repeated else i for i in range(len(seqs))]
    windows, forward = {}, Counter()
    for i, s in zip(ids, seqs, strict=True):
        for j in range(len(s) - k + 1):
            x = s[j : j + k]
            if not set(x) - set("ACGT"):
                windows.setdefault(i, []).append(canon(x))
                forward[i] += number(canon(x)) == number(x)
    reads = spark.createDataFrame(list(zip(ids, seqs, strict=True)) + [(99, None), (100, "ACG")], "read_id long, seq string").repartition(3)
    found = {r[0]: tuple(r)[1:] for r in R.occurrence_counts(reads, k).select("read_id", "n_kmers", "n_edges", "n_forward").collect()}
    assert found == {i: (len(w), len(set(w)), forward[i]) for i, w in windows.items()}
    # a row for each id comes together, and none for each window
    assert dealt == [len(windows)]


def test_a_piece_and_a_task_hold_little(spark, monkeypatch):
    """Rows were sent for each batch, of 10,000 reads, and pieces had 4 million bases."""
    assert R.PIECE <= 1 << 20 and R.HELD <= 1 << 20
    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    r = random.Random(9)
    seqs = ["".join(r.choice("ACGT") for _ in range(300)) for _ in range(200)] * 10
    reads = spark.createDataFrame([(i, s) for i, s in enumerate(seqs)], "read_id long, seq string").coalesce(1)
    monkeypatch.setattr(R, "PIECE", 20_000)
    scanned = R.scan(reads, 5)
    assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")) <= 2 << 20
    edges = scanned.where("not is_end")
    # one row for each k-mer and task, not one for each piece
    assert edges.count() == edges.select("key").distinct().count() == len(counted_by_hand(seqs[:200], 5))
    monkeypatch.setattr(R, "HELD", 100)
    for k in (5, 14):
        got = Counter()
        for key, a in R.scan(reads.limit(200), k).where("not is_end").select("key", "a").collect():
            got[key] += a
        assert got == {number(e): c for e, c in counted_by_hand(seqs[:200], k).items()}


def in_worker(make, seqs):
    """The batches that the worker's function of make(reads) gives for one batch of reads."""
    conf = SimpleNamespace(get=lambda *x: "2m", set=lambda *x: None)
    kept = []
    plan = SimpleNamespace(distinct=lambda: None, groupBy=lambda *c: None)
    make(SimpleNamespace(sparkSession=SimpleNamespace(conf=conf), select=lambda *c: SimpleNamespace(mapInArrow=lambda f, schema: kept.append(f) or plan)))
    return kept[0](iter([pa.RecordBatch.from_arrays([pa.array(seqs, pa.string())], names=["seq"])]))


def worker_peak(make, text):
    """Bytes that Python allocates for one read, beside the read."""
    batches = in_worker(make, [text])
    tracemalloc.start()
    assert sum(b.num_rows for b in batches)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    return peak


@pytest.mark.parametrize("options", [{"nodes": True}, {"only": "edges"}, {"only": "ends"}])
def test_a_long_read_is_scanned_in_pieces(spark, options):
    """One read was one piece, however long."""
    text = "".join(random.Random(10).choices("ACGT", k=1 << 20)) * 6
    assert worker_peak(lambda reads: R.scan(reads, 10, **options), text) < 100 << 20


@pytest.mark.parametrize("k", [2, 9, 10])
def test_cut_reads_have_the_windows_ends_and_nodes_of_whole_ones(spark, monkeypatch, k):
    """A fragment may hang by an end in any of its pieces, or by none: palindromes and repeated bases at its ends, or all along."""
    hard = ["ACGT" * 30, "ACGT" * 30 + "C", "G" + "TGCA" * 25, "AT" * 50 + "N" + "AT" * 40 + "A", "A" * 90, "A" * 60 + "C" + "A" * 60, "CG" * 20 + "A" * 50 + "CG" * 20, "GNNNC" * 20]
    seqs = some_reads(11)[:6] + hard

    def scanned(policy, **options):
        out = Counter()
        for b in in_worker(lambda reads: R.scan(reads, k, n_policy=policy, **options), seqs):
            for is_end, key, left, right in zip(*b.to_pydict().values(), strict=True):
                out[is_end, key, "a"] += left
                out[is_end, key, "b"] += right
        return dict(out)

    def nodes(policy):
        return [{x for b in in_worker(lambda reads: R.read_nodes(reads, k, n_policy=policy), [s]) for x in b.column(0).to_pylist()} for s in seqs]

    def found():
        return [x for p in ("split", "as_a") for x in (nodes(p), scanned(p, nodes=True), scanned(p), scanned(p, only="edges"), scanned(p, only="ends"))]

    whole = found()
    if k == 9:
        assert [bool(x) for x in whole[0][-8:]] == [False, True, True, False, False, True, True, False]
    for piece in (3, 25):
        monkeypatch.setattr(R, "PIECE", piece)
        assert found() == whole


@pytest.mark.parametrize("k", [9, 28])
def test_counts_of_a_long_read_are_made_in_pieces(spark, monkeypatch, k):
    """Counts alone took one read as one piece too, as sums and as stretches."""
    make = (lambda reads: R.scan(reads, k, only="edges")) if k < R.STRETCHED else (lambda reads: R.stretches(reads, k, 16))
    text = "".join(random.Random(12).choices("ACGT", k=1 << 20)) * 10
    assert worker_peak(make, text) < 150 << 20
    seqs = some_reads(13)
    monkeypatch.setattr(R, "PIECE", 30)
    reads = spark.createDataFrame(list(enumerate(seqs)), "read_id long, seq string").coalesce(2)
    found = {r["edge"]: r["cnt"] for r in R.exact_counts(reads, k).collect()}
    assert found == {number(e): c for e, c in counted_by_hand([s for s in seqs if s], k).items()}
