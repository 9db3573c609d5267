"""Repeated 200-byte strings against brute force; the cover's property; texts of every kind."""

from __future__ import annotations

import hashlib
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from weftgraph.llm import catalog, suffix_dedup


def brute(rows: list[tuple], n: int) -> list[tuple]:
    at = defaultdict(list)
    texts = [(t or "").encode() for _, t in rows]
    for r, b in enumerate(texts):
        for j in range(len(b) - n + 1):
            at[b[j : j + n]].append((r, j))
    gone = [bytearray(len(b)) for b in texts]
    for places in at.values():
        if len(places) > 1:
            for r, j in places:
                gone[r][j : j + n] = b"\1" * n
    out = []
    for (i, _), b, g in zip(rows, texts, gone, strict=True):
        edges = [j for j in range(len(b) + 1) if (g[j] if j < len(b) else 0) != (g[j - 1] if j else 0)]
        out.append((i, len(b), sum(g), tuple(zip(edges[::2], edges[1::2], strict=True)), bytes(x for x, y in zip(b, g, strict=True) if not y)))
    return sorted(out, key=repr)


def letters(seed: int, n: int) -> str:
    return "".join(random.Random(seed).choices("abcdefgh ", k=n))


def found(docs, n: int, **names) -> list[tuple]:
    rows = suffix_dedup.remove_repeats(docs, n, **names).collect()
    return sorted([(r.doc_id, r.n_bytes, r.n_removed, tuple((s.start, s.end) for s in r.spans), bytes(r.kept)) for r in rows], key=repr)


@pytest.mark.parametrize("n", [1, 5, 8, 16, 60, 200, 1000])
def test_every_difference_is_covered(n):
    v, places = suffix_dedup.cover(n)
    assert v <= max(1, n // 2)
    for d in range(v):
        assert any((p + d) % v in places for p in places.tolist())


@pytest.mark.parametrize(("n", "block"), [(1, 300), (5, 300), (8, 1 << 20), (13, 300), (40, 300), (200, 300), (200, 1 << 20)])
def test_equals_brute_force_on_texts_made_of_common_passages(spark, monkeypatch, n, block):
    monkeypatch.setattr(suffix_dedup, "BLOCK", block)
    rng = random.Random(n)
    base = ["".join(rng.choice("abé ") for _ in range(rng.randint(1, 4 * n))) for _ in range(8)]
    rows = [(None, None), (3, ""), (4, "x")]
    for i in range(60):
        rows.append((i, "".join(rng.choice(base)[rng.randint(0, n // 2) :] + "".join(rng.choice("abcdefgh") for _ in range(rng.randint(0, n))) for _ in range(rng.randint(0, 4)))))
    rows.append(rows[10])
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    want = brute(rows, n)
    assert 0 < sum(w[2] for w in want)
    assert found(docs, n) == want


def test_repeats_inside_a_text_overlaps_and_long_runs(spark):
    one = letters(1, 1500)
    rows = [(1, "z" * 5000), (2, one[:700] + "#" + one[100:420]), (3, "q" + one[420:640] + "w"), (4, one[640:839]), (5, "é" * 99 + "x"), (6, "y" + "é" * 100), (7, "x" * 199), (8, "x" * 200)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    want = brute(rows, 200)
    assert [w[2] > 0 for w in want] == [True, True, True, False, False, False, False, False]
    assert found(docs, 200) == want


def test_very_long_text_empty_table_and_clashing_columns(spark):
    long = letters(2, 3_000_000)
    rows = [(1, long, 7, "p"), (2, "!" + long[1_000_000:1_000_300] + "?", None, None), (None, None, 1, "x")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, block bigint, part string")
    got = {r[0]: r for r in found(docs, 200)}
    assert got[1][1:4] == (3_000_000, 300, ((1_000_000, 1_000_300),)) and got[2][2:] == (300, ((1, 301),), b"!?") and got[None][1:] == (0, 0, (), b"")
    assert found(docs.where("doc_id = 9"), 200) == []
    renamed = docs.select(F.col("doc_id").alias("a b"), F.col("text").alias("t.x"))
    assert len(found(renamed, 200, id_col="a b", text_col="t.x")) == 3


def test_query_equals_brute_force(spark, tmp_path):
    base = letters(3, 5000)
    rng = random.Random(4)
    rows = [(i, "".join(base[(a := rng.randint(0, 4500)) : a + rng.randint(100, 500)] + "|" for _ in range(3))) for i in range(40)]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(tuple(r) for r in catalog.op11_suffix_dedup(spark, str(tmp_path)).collect())
    assert got == sorted((i, n, gone, len(spans), hashlib.sha256(kept).hexdigest()) for i, n, gone, spans, kept in brute(rows, 200))
