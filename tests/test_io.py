"""FASTQ, stores, DOT, streams and the driver's entry."""

import bz2
import gzip
import os
import random
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from weftgraph.functions import kmers as K
from weftgraph.operators import graph as G
from weftgraph.operators import reads as R
from weftgraph.operators import tables as T
from weftgraph.operators.steps import Steps
from weftgraph.sources import bzip, dot, fastq, store
from weftgraph.streaming import ingest

#: A file of 125 reads, if there is one.
SAMPLE = os.environ.get("FASTQ_SAMPLE", "")
REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def made(n, seed=1, end="\n"):
    r = random.Random(seed)
    out = []
    for i in range(n):
        s = "".join(r.choice("ACGTN") for _ in range(r.randint(1, 80)))
        q = "".join(r.choice("@+I!") for _ in s)
        out.append((f"r{i} x", s, q, "" if r.random() < 0.5 else f"r{i} x"))
    text = "".join(f"@{n}{end}{s}{end}+{p}{end}{q}{end}" for n, s, q, p in out)
    return [(n, s, q) for n, s, q, _ in out], text


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_fastq_files(spark, tmp_path, end):
    rows, text = made(200, end=end)
    (tmp_path / "a.fastq").write_bytes(text.encode())
    with gzip.open(tmp_path / "b.fastq.gz", "wb") as f:
        f.write(text.encode())
    with bz2.open(tmp_path / "c.fastq.bz2", "wb") as f:
        f.write(text.encode())
    for name in ("a.fastq", "b.fastq.gz", "c.fastq.bz2"):
        for split in (1 << 20, 700):
            got = [(x.name, x.seq, x.qual) for x in fastq.read_fastq(spark, str(tmp_path / name), split=split).collect()]
            assert sorted(got) == sorted(rows), (name, split)
    assert fastq.read_fastq(spark, f"{tmp_path}/*.fastq*").count() == 600
    assert fastq.read_fastq(spark, str(tmp_path), str(tmp_path / "a.fastq")).count() == 800
    with pytest.raises(Exception, match="nothing"):
        fastq.read_fastq(spark, f"{tmp_path}/nothing.fastq").count()


@pytest.mark.parametrize("level", [1, 9])
def test_bzip2_in_ranges(spark, tmp_path, level):
    rows, text = made(20_000, seed=level)
    data = text.encode()
    # a stream of its own every 300 kB, as parallel packers write, and marks in the text that aren't blocks
    packed = b"".join(bz2.compress(data[i : i + 300_000], level) for i in range(0, len(data), 300_000))
    path = str(tmp_path / "a.fastq.bz2")
    for content in (packed, bz2.compress(data, level)):
        (tmp_path / "a.fastq.bz2").write_bytes(content)
        for split in (len(content) // 3 + 1, 9_973):
            parts = [list(fastq.records(path, a, min(len(content), a + split))) for a in range(0, len(content), split)]
            assert [x for part in parts for x in part] == rows
        assert level > 1 or sum(map(bool, parts)) > 3
        got = fastq.read_fastq(spark, path, packed_split=40_000)
        assert got.rdd.getNumPartitions() == -(-len(content) // 40_000)
        assert sorted(tuple(x) for x in got.collect()) == sorted(rows)
    (tmp_path / "a.fastq.bz2").write_bytes(bz2.compress(b""))
    assert fastq.read_fastq(spark, path).count() == 0


def test_bzip2_marks_at_every_bit():
    packed = bz2.compress(os.urandom(3_000_000), 9)
    marks = bzip._marks(packed, 0)
    assert [m for _, m in marks] == [bzip.BLOCK] * (len(marks) - 1) + [bzip.END] and len(marks) == 5
    for shift in range(8):
        value = (1 << 9 | 1) << 48 | bzip.BLOCK
        data = (value << 40 + shift).to_bytes(14, "big")
        assert [m for m in bzip._marks(data, 7) if m[1] == bzip.BLOCK] == [(8 * 7 + 8 * 14 - 40 - shift - 48, bzip.BLOCK)]


def _scanned(df):
    """Rows that the scans of a table gave, once it was run."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    plan = plan.executedPlan() if plan.getClass().getSimpleName().startswith("AdaptiveSparkPlan") else plan
    text, total, waiting = plan.toString(), 0, [plan]
    while waiting:
        node = waiting.pop()
        if node.getClass().getSimpleName().endswith("QueryStageExec"):
            waiting.append(node.plan())
        if node.getClass().getSimpleName() == "FileSourceScanExec":
            total += node.metrics().apply("numOutputRows").value()
        waiting += [node.children().apply(i) for i in range(node.children().size())]
    return total, text


def test_lookups_in_a_clustered_table_read_few_rows_and_shuffle_only_probes(spark, tmp_path):
    table = spark.range(200_000).select((F.col("id") * 7919 % 1_000_003).alias("key"), (F.col("id") % 5 + 1).alias("cnt"))
    store.save_clustered(table, f"{tmp_path}/c", buckets=4, rows_per_group=2000)
    stored = store.open_clustered(spark, f"{tmp_path}/c")
    known = {r.key: r.cnt for r in table.collect()}
    for keys in ([], [5], list(range(0, 1000, 40)), list(range(0, 1_000_000, 50_021)) * 2 + [None]):
        probes = spark.createDataFrame([(k,) for k in keys], "key long")
        found = store.lookup(probes, stored)
        assert sorted((str(k), known.get(k, 0)) for k in keys) == sorted((str(r.key), r.cnt) for r in found.collect())
        read, _ = _scanned(found)
        assert read <= 4000 * len(keys) and (len(keys) > 30 or read < 100_000)
    many = spark.range(0, 1_000_000, 9).select(F.col("id").alias("key"))
    found = store.lookup(many, stored)
    _, plan = _scanned(found)
    assert plan.count("Exchange hashpartitioning") == 1 and "Bucketed: true" in plan
    assert found.agg(F.sum("cnt")).first()[0] == sum(known.get(k, 0) for k in range(0, 1_000_000, 9))
    # another session knows the table from its folder
    spark.sql(f"DROP TABLE {store._table_name(f'{tmp_path}/c')}")
    assert store.open_clustered(spark, f"{tmp_path}/c").count() == 200_000
    with pytest.raises(Exception, match="no null keys"):
        store.save_clustered(spark.createDataFrame([(None, 1)], "key long, cnt long"), f"{tmp_path}/n")


def test_clustered_tables_merge_without_a_shuffle(spark, tmp_path):
    tables = [spark.range(i * 1000, 30_000 + i * 1000).select((F.col("id") * 7919 % 100_003).alias("key"), (F.col("id") % 5 + i).alias("cnt")) for i in range(3)]
    for i, t in enumerate(tables):
        store.save_clustered(t, f"{tmp_path}/{i}", buckets=8)
    merged = store.merge(*[store.open_clustered(spark, f"{tmp_path}/{i}") for i in range(3)])
    _, plan = _scanned(merged)
    assert "Exchange" not in plan
    assert sorted(map(tuple, merged.collect())) == sorted(map(tuple, T.merge(*tables).collect()))
    assert merged.count() == merged.select("key").count() == merged.select("key").distinct().count() == 32_000 and merged.agg(F.sum("cnt")).first()[0] == sum(t.agg(F.sum("cnt")).first()[0] for t in tables)


@pytest.mark.skipif(not os.path.exists(SAMPLE), reason="no sample file here")
def test_sample_file(spark):
    k = 28
    reads = fastq.read_fastq(spark, SAMPLE).cache()
    assert reads.count() == 125 and reads.agg(F.sum(F.length("seq"))).first()[0] == 31679
    assert R.fragments(reads.withColumn("read_id", F.lit(0)), k).count() == 127
    edges, ends = R.exact_counts(reads, k).cache(), R.end_counts(reads, k).cache()
    assert tuple(T.statistics(edges).first()) == (26259, 28206, 97, 26259 - 26063)
    assert [x.n_keys for x in T.histogram(edges).where("cnt <= 4").orderBy("cnt").collect()] == [26063, 114, 24, 13]
    assert ends.agg(F.sum((F.col("left_ends") > 0).cast("int")), F.sum("left_ends"), F.sum((F.col("right_ends") > 0).cast("int")), F.sum("right_ends")).first()[:] == (117, 117, 137, 137)
    inc = G.incidence(edges, k).cache()
    assert inc.select("node").distinct().count() == 26285 and ends.count() == 254
    assert G.invariant(inc, edges, ends).where("discrepancy <> 0").count() == 0
    assert G.loops(edges, k).count() == 0 and inc.where("side = 'D'").count() == 0


def test_store_and_dot(spark, tmp_path):
    reads = spark.createDataFrame([(0, "ACTGAATGC")], "read_id long, seq string")
    edges, ends = R.exact_counts(reads, 5), R.end_counts(reads, 5)
    store.save({"exact": edges, "ends": ends}, f"{tmp_path}/g", k=5, p=20, seed=1)
    tables, parameters = store.load(spark, f"{tmp_path}/g")
    assert parameters == {"k": 5, "p": 20, "seed": 1} and sorted(tables) == ["ends", "exact"]
    assert sorted(map(tuple, tables["exact"].collect())) == sorted(map(tuple, edges.collect()))
    nodes = G.incidence(edges, 5).select("node").distinct()
    dot.write_dot(f"{tmp_path}/d", "g", nodes, edges, ends, 5)
    lines = [x.value for x in spark.read.text(f"{tmp_path}/d").collect()]
    assert lines[0] == "digraph g {" and lines[-1] == "}" and len(lines) == 2 + 6 + 5
    assert any(x.startswith('  GCAT[ label="GCAT\\n(0, 1)", style=filled, fillcolor=grey, shape=ellipse ];') for x in lines)
    assert sum(" -> " in x for x in lines) == 5


def test_incremental_and_streaming(spark, tmp_path):
    rows, _ = made(60, 4)
    reads = spark.createDataFrame([(i, s) for i, (_, s, _) in enumerate(rows)], "read_id long, seq string")
    half = [reads.where("read_id < 30"), reads.where("read_id >= 30")]
    whole = sorted(map(tuple, ingest.insert_reads(R.scan(reads.where("false"), 6), reads, 6).collect()))
    steps = R.scan(half[0], 6)
    assert sorted(map(tuple, ingest.insert_reads(steps, half[1], 6).collect())) == whole
    source = f"{tmp_path}/in"
    half[0].write.parquet(source)
    query = ingest.start(spark.readStream.schema(reads.schema).parquet(source), 6, "counts", f"{tmp_path}/state")
    query.processAllAvailable()
    half[1].write.mode("append").parquet(source)
    query.processAllAvailable()
    query.stop()
    assert sorted(map(tuple, spark.table("counts").collect())) == whole
    query = ingest.start_into(spark.readStream.schema(reads.schema).option("maxFilesPerTrigger", 1).parquet(source), 6, f"{tmp_path}/kept", f"{tmp_path}/state2")
    query.processAllAvailable()
    query.stop()
    assert sorted(map(tuple, ingest.stored_counts(spark, f"{tmp_path}/kept").collect())) == whole


def test_every_batch_equals_a_recount_and_a_repeated_one_changes_nothing(spark, tmp_path):
    k, fan, n = 5, 3, 11
    rows, _ = made(n * 6, 8)
    reads = spark.createDataFrame([(i, s) for i, (_, s, _) in enumerate(rows)], "read_id long, seq string").cache()
    path = f"{tmp_path}/kept"
    assert ingest.stored_counts(spark, path).count() == 0
    for number in range(n):
        batch = reads.where(f"read_id div 6 = {number}")
        ingest.add_batch(batch, number, k, path, fan)
        opened = ingest.stored_counts(spark, path)
        if number == 8:  # a part that was never finished, and one whose predecessors weren't deleted yet
            R.scan(batch, k).write.parquet(f"{path}/span=0_20")
            os.remove(f"{path}/span=0_20/_SUCCESS")
        if number in (2, 7, 8):
            before = os.listdir(path), sorted(map(tuple, opened.collect()))
            ingest.add_batch(batch, number, k, path, fan)
            assert sorted(map(tuple, ingest.stored_counts(spark, path).collect())) == before[1]
        whole = R.counted(reads.where(f"read_id < {6 * (number + 1)}"), k)
        got = sorted(map(tuple, opened.collect())) if number not in (2, 7, 8) else before[1]
        assert got == sorted(map(tuple, whole.collect()))
        assert len(ingest.live_parts(spark, path)) == sum(int(x) for x in (lambda v: [v % 3, v // 3 % 3, v // 9])(number + 1))
        if number % 4 == 3:
            now = ingest.stored_counts(spark, path)
            assert G.balance(now, k).where("discrepancy <> 0").count() == 0
            assert sorted(map(tuple, R.ends_in(now).collect())) == sorted(map(tuple, R.end_counts(reads.where(f"read_id < {6 * (number + 1)}"), k).collect()))
    assert ingest.live_parts(spark, path) == [(0, 8), (9, 9), (10, 10)]
    assert not os.path.exists(f"{path}/span=0_20") and not os.path.exists(f"{path}/span=0_0")


def test_steps_tell_rows_and_seconds(spark):
    steps = Steps(spark)
    reads = steps.keep(spark.range(1000).select(F.col("id").alias("read_id"), F.lit("ACGTACGGT").alias("seq")), "reads")
    R_counts = steps.keep(R.counted(reads, 5), "counted", "is_end")
    got = steps.table().orderBy("step").collect()
    assert [(x.step, x.name, x.n_rows) for x in got] == [(1, "reads", 1000), (2, "counted", R_counts.count())]
    assert all(0 < x.seconds < 60 and x.rows_per_second > 0 for x in got)
    assert Steps(spark).table().count() == 0


def test_entry_without_the_training_data_operators(tmp_path):
    """The driver takes them away; everything else still imports."""
    for name in ("__spark_entry__.py", "weftgraph"):
        subprocess.run(["cp", "-r", f"{REPO}/{name}", str(tmp_path)], check=True)
    subprocess.run(["rm", "-rf", f"{tmp_path}/weftgraph/llm"], check=True)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'kmer_count' in q and not any(x.startswith('op') or x == 'pipeline' for x in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True)


def test_queries_and_sql_have_the_same_names():
    sys.path.insert(0, REPO)
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert K.BASES == "CATG"
