"""Collocations against brute force."""

from __future__ import annotations

import random
import re
from collections import Counter

import pytest

from weftgraph.llm import phrases


def brute(rows: list[tuple], size: int = 3, least: int = 10, inside: int = 50, top: int = 2000) -> list[tuple]:
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            w = re.findall("[^ \t]+", piece)
            n[lang] += len(w)
            f.update((lang, tuple(w[i : i + k])) for k in range(1, size + 1) for i in range(len(w) - k + 1))
    candidates = {x: a for x, a in f.items() if len(x[1]) > 1 and a >= least}
    covered = {(lang, p[i : i + k]) for (lang, p), a in candidates.items() for k in range(2, len(p)) for i in range(len(p) - k + 1) if 100 * a >= inside * f[lang, p[i : i + k]]}
    found = []
    for (lang, p), a in candidates.items():
        if (lang, p) not in covered:
            score, _, l, r = min((1000000 * a * a // (f[lang, p[:k]] * f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p)))
            found.append((lang, -score, -a, " ".join(p).encode(), l, r))
    out, rank = [], Counter()
    for lang, score, a, p, l, r in sorted(found):
        rank[lang] += 1
        if rank[lang] <= top:
            out.append((lang, rank[lang], p.decode(), -a, l, r, n[lang], -score))
    return sorted(out)


def found(df, **how) -> list[tuple]:
    return sorted(tuple(r) for r in phrases.collocations(df, **how).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


@pytest.mark.parametrize("how", [{}, {"size": 4, "least": 5, "inside": 80}, {"size": 2, "least": 3, "top": 4}])
def test_equals_brute_force(spark, how, monkeypatch):
    monkeypatch.setattr(phrases, "CHUNK", 2000)
    rng = random.Random(7)
    words = ["A", "b", "ça", "Ünd", "the", "of", "x y", "\x1f", "É"]
    fixed = ["New York city", "b of the a", "ÉTÉ und"]
    rows = [(rng.choice(["en", "fr", None, "und"]), "".join(rng.choice([*words, *fixed]) + rng.choice([" ", " ", "\t", " ", "  ", ". ", "\n", ",", "?"]) for _ in range(rng.randint(0, 60)))) for _ in range(120)]
    rows += [("en", None), (None, ""), ("de", "...\n\n"), ("en", "the " * 3000)]
    df = spark.createDataFrame(rows, "lang string, text string").repartition(4)
    want = brute(rows, **how)
    assert len(want) > 8
    assert found(df, **how) == want


def test_a_full_filter_only_costs_work(spark, monkeypatch):
    monkeypatch.setattr(phrases, "LEAST_BITS", 6)
    monkeypatch.setattr(phrases, "MOST_BITS", 6)
    rng = random.Random(8)
    rows = [("en", " ".join(rng.choice([f"w{i}" for i in range(40)]) for _ in range(400))) for _ in range(30)]
    assert found(spark.createDataFrame(rows, "lang string, text string")) == brute(rows)


def test_empty_table_and_clashing_columns(spark):
    schema = "lang string, text string, phrase string, n int"
    assert found(spark.createDataFrame([], schema)) == []
    rows = [("en", "a b c. " * 20, "x", 1), ("en", "b c " * 5, None, None)]
    assert found(spark.createDataFrame(rows, schema)) == brute([r[:2] for r in rows])


def test_scores_are_exact_beyond_64_bits(spark):
    rows = [(10**14, 3 * 10**14 + 1, 10**14 + 7), (4_000_000_000, 4_000_000_000, 4_000_000_000), (10, 10, 11)]
    df = spark.createDataFrame(rows, "a bigint, l bigint, r bigint")
    got = [r[0] for r in df.select(phrases._floor_score(df.a, df.l, df.r)).collect()]
    assert got == [1000000 * a * a // (l * r) for a, l, r in rows]


def test_a_worker_holds_and_sends_little():
    """4 MB of text were counted at once, and all their phrases sent in one batch."""
    import tracemalloc
    from types import SimpleNamespace

    import numpy as np
    import pyarrow as pa

    docs = SimpleNamespace(sparkSession=SimpleNamespace(sparkContext=SimpleNamespace(broadcast=lambda x: SimpleNamespace(value=x))), mapInArrow=lambda f, schema: f)
    rng = random.Random(9)
    texts = [" ".join(f"w{rng.randint(0, 9999)}" for _ in range(300)) for _ in range(3000)]
    batches = [pa.RecordBatch.from_arrays([pa.array(["en"] * 1000), pa.array(texts[i : i + 1000])], names=["lang", "text"]) for i in range(0, 3000, 1000)]
    for size in (1, 2, 3):
        count = phrases._grams(docs, size, SimpleNamespace(has=lambda keys: np.ones(len(keys), bool)))
        tracemalloc.start()
        sent = [b.num_rows for b in count(iter(batches))]
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert sum(sent) >= 9999 and max(sent) <= 1 << 15
        assert peak < 40 << 20
