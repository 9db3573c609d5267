import base64
import hashlib
import random

import public_tokenizers
import regex
import tiktoken

from weftgraph.llm import bpe, pretoken

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
CHARS = "ab 1é\n\t\r\x1c\x85\xa0　'''sdlrvemt t٣²½Ⅷ漢字😀́.,<|endoftext|>"


def library():
    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def texts(n, seed=5):
    r = random.Random(seed)
    return ["".join(r.choice(CHARS) for _ in range(r.randint(0, 60))) for _ in range(n)]


def test_pattern_is_the_public_one():
    assert pretoken.PATTERN == public_tokenizers.PATTERN


def test_split_equals_regex():
    docs = texts(3000)
    import numpy as np

    raw = [d.encode() for d in docs]
    data, offsets = np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in raw])])
    start, end, first = pretoken.split(data, offsets)
    for i, d in enumerate(docs):
        assert [data[start[j] : end[j]].tobytes().decode() for j in range(first[i], first[i + 1])] == regex.findall(pretoken.PATTERN, d)
    slow = pretoken.split(data, offsets, pretoken.PATTERN + "|zzzz")
    assert all((a == b).all() for a, b in zip((start, end, first), slow, strict=True))


def test_against_the_library(spark, monkeypatch):
    monkeypatch.setattr(bpe, "BLOCK_BYTES", 3000)
    rows = [(i, t) for i, t in enumerate(texts(400))]
    rows += [(900, None), (901, ""), (3, rows[3][1]), (None, "null id"), (902, "x" * 50000 + " " * 3000), (903, "long text " * 20000)] + rows[:40]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    tok = library()
    got = bpe.decode(bpe.encode(df, RANKS, public_tokenizers.PATTERN), RANKS).collect()
    want = []
    for i, t in rows:
        ids = tok.encode_ordinary(t or "")
        want.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert sorted(((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got), key=str) == sorted(want, key=str)
    assert sorted(bytes(r.decoded) for r in got) == sorted((t or "").encode() for _, t in rows)


def test_empty_table_and_extra_columns(spark):
    df = spark.createDataFrame([], "block int, doc_id long, text string, ids string")
    assert bpe.encode(df, RANKS, public_tokenizers.PATTERN).collect() == []


def test_blocks_cut_long_rows_and_end_by_rows(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(bpe, "PIECE", 50)
    r = random.Random(8)
    docs = [*texts(200, 9), "", "", " ".join(r.choice(["word", "it's", "  two", "99", "\n\n x", "é", "...  "]) for _ in range(400)), "x" * 500, ""]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(docs)), pa.int64()), pa.array(docs)], names=["doc_id", "text"])
    block = next(bpe._blocks(iter([batch]), pretoken.PATTERN))
    spelt = bpe._cut(*block.spelt(bpe.np.arange(len(block.length))))
    assert len(set(spelt)) == len(spelt)
    at = 0
    for d, n in zip(docs, block.counts.tolist(), strict=True):
        assert [spelt[c].decode() for c in block.code[at : at + n]] == regex.findall(pretoken.PATTERN, d)
        at += n
    empty = [pa.RecordBatch.from_arrays([pa.array([None] * 1000, pa.int64()), pa.array([None] * 1000, pa.string())], names=["doc_id", "text"])] * 200
    assert [b.rows for b in bpe._blocks(iter(empty), pretoken.PATTERN)] == [66000] * 3 + [2000] and bpe.BLOCK_ROWS == 1 << 16


def test_many_empty_and_repeated_rows(spark):
    empty = spark.range(200_000).selectExpr("cast(null as long) as doc_id", "if(id % 2 = 0, '', null) as text")
    got = bpe.encode(empty, RANKS, public_tokenizers.PATTERN, keep_ids=False).groupBy("n_tokens", "decoded_sha256").count().collect()
    assert [(r.n_tokens, r.decoded_sha256, r["count"]) for r in got] == [(0, hashlib.sha256(b"").hexdigest(), 200_000)]
    same = spark.range(3000).selectExpr("1L as doc_id", "'the same row again' as text").repartition(6)
    got = bpe.encode(same, RANKS, public_tokenizers.PATTERN, keep_ids=False).groupBy("doc_id", "n_tokens").count().collect()
    assert [tuple(r) for r in got] == [(1, 4, 3000)]


def steps_of(monkeypatch):
    """The three functions that encode() gives to Spark: blocks, encoding of a range, assembly of a block."""
    from types import SimpleNamespace

    steps = []
    table = SimpleNamespace(sparkSession=None)
    for name in ("select", "repartition", "groupBy", "cogroup"):
        setattr(table, name, lambda *a: table)
    for name in ("mapInArrow", "applyInArrow"):
        setattr(table, name, lambda f, schema: steps.append(f) or table)
    column = type("Column", (), {"alias": lambda self, x: self, "__neg__": lambda self: self, "__rsub__": lambda self, x: self})()
    monkeypatch.setattr(bpe, "F", SimpleNamespace(col=lambda name: column))
    monkeypatch.setattr(bpe, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 3)))
    monkeypatch.setattr(bpe, "small_batches", lambda spark: None)
    monkeypatch.setattr(bpe, "block_count", lambda docs: 16)
    bpe.encode(table, RANKS, public_tokenizers.PATTERN)
    return steps


def encoded(steps, docs, cost=lambda f: f()):
    import pyarrow as pa
    import pyarrow.compute as pc

    blocks, words, assemble = steps
    batches = [pa.RecordBatch.from_arrays([pa.array(range(i, min(i + 100, len(docs)))), pa.array(docs[i : i + 100])], names=["doc_id", "text"]) for i in range(0, len(docs), 100)]
    sides = pa.Table.from_batches(list(blocks(iter(batches))))
    coded = pa.concat_tables([words((pa.scalar(p),), sides.filter(pc.equal(sides["key"], p))) for p in range(16)])
    out = []
    for key in [k for k in sides["key"].to_pylist() if k < 0]:
        both = sides.filter(pc.equal(sides["key"], key)), coded.filter(pc.equal(coded["block"], -1 - key))
        out.append(cost(lambda key=key, both=both: assemble((pa.scalar(key),), *both)))
    return pa.concat_tables(out)


def test_spellings_and_rows_in_small_parts(monkeypatch):
    monkeypatch.setattr(bpe, "PIECE", 50)
    monkeypatch.setattr(bpe, "FRESH", 40)
    monkeypatch.setattr(bpe, "SPELT", 7)
    docs = [*texts(300, 11), "", None, "long text of many words " * 40, "", "x"]
    tok = library()
    for doc, row in zip(docs, encoded(steps_of(monkeypatch), docs).to_pylist(), strict=True):
        ids = tok.encode_ordinary(doc or "")
        assert row["n_tokens"] == len(ids) and row["ids"] == b"".join(i.to_bytes(4, "little") for i in ids)
        assert row["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert row["decoded_sha256"] == hashlib.sha256((doc or "").encode()).hexdigest()


def test_assembly_holds_numbers_not_objects(monkeypatch):
    """Each pre-token of a block had its ids, digits and bytes as Python objects."""
    import tracemalloc

    r = random.Random(12)
    docs = [" ".join(f"{r.choice('abcdefgh')}{r.randint(0, 1 << 40):x}" for _ in range(100)) for _ in range(1000)]
    peaks = []

    def cost(f):
        tracemalloc.start()
        out = f()
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
        return out

    bpe._token_bytes(RANKS)
    encoded(steps_of(monkeypatch), docs[:1])
    encoded(steps_of(monkeypatch), docs, cost)
    assert max(peaks) < 11 << 20
