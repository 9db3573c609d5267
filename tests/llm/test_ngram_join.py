import random
import re

import pytest

from weftgraph.llm import setjoin
from weftgraph.llm.ngram_join import keep_one, near_duplicates


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    if not w:
        return set()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)}


def brute(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for x in range(len(sets)):
        for y in range(x):
            a, b = sets[x][1], sets[y][1]
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                parent[find(x)] = find(y)
    least = {}
    for x, (i, _) in enumerate(sets):
        least[find(x)] = min(least.get(find(x), i), i)
    return sorted((i, len(s), least[find(x)]) for x, (i, s) in enumerate(sets))


def corpus(seed, n=120):
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    base = [[r.choice(vocab) for _ in range(r.choice([3, 5, 8, 40, 90]))] for _ in range(12)]
    passage = [r.choice(vocab) for _ in range(30)]
    rows = []
    for i in range(n):
        kind = r.random()
        w = list(r.choice(base)) if kind < 0.6 else [r.choice(vocab) for _ in range(r.randint(1, 60))]
        for _ in range(r.choice([0, 0, 1, 2, 3])):
            w[r.randrange(len(w))] = r.choice(vocab)
        if kind > 0.8:
            w = passage + w[: r.randint(0, 8)]
        rows.append((i * 3 + 1, (" " if r.random() < 0.5 else "\n").join(x.upper() if r.random() < 0.2 else x for x in w)))
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize(("cold", "bits"), [(64, 16), (3, 16), (0, 16), (2, 9), (5, 9)])
def test_against_brute_force(spark, monkeypatch, cold, bits):
    # with 2**9 counters collisions dominate: nearly no token is told to be hot, and blocks find out
    monkeypatch.setattr(setjoin, "LEAST_BITS", bits)
    monkeypatch.setattr(setjoin, "MOST_BITS", bits)
    rows = corpus(cold) + [(1001, None), (1002, ""), (1003, " \n "), (1004, "é ü"), (1005, "É ü"), (1006, "é ü")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in near_duplicates(df, cold=cold).collect())
    assert got == brute(rows)


def test_empty_null_ids_repeats_and_clashing_columns(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, key long, a string")
    assert near_duplicates(empty).collect() == []
    rows = [(5, "a b c d e f", 1, "x"), (5, "a b c d e f", 1, "x"), (2, "A B c d e f", 9, "y"), (None, "a b c d e f", 0, "z"), (7, "q " * 30000, 0, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string, key long, a string")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in near_duplicates(df).collect()), key=str)
    assert got == sorted([(5, 2, 2), (5, 2, 2), (2, 2, 2), (None, 2, 2), (7, 1, 7)], key=str)
    kept = keep_one(df)
    assert kept.columns == df.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted([2, None, 7], key=str)


def test_keep_one_with_repeated_and_null_ids(spark):
    a, b, c = "a b c d e f g h", "k l m n o p q r", "s t u v w x y z"
    rows = [(3, a), (5, a + " i"), (5, a.upper()), (5, b), (6, c), (6, c), (6, c.upper()), (8, None), (8, None), (8, "")]
    rows += [(None, x) for x in ("only null", "Only null", "only null", "alone")]
    df = spark.createDataFrame([(*x, 1, "g", 2) for x in rows], "doc_id long, text string, __id long, __row string, __gone int").repartition(3)
    kept = keep_one(df)
    assert kept.columns == df.columns
    got = sorted(((r.doc_id, r.text and r.text.lower()) for r in kept.collect()), key=str)
    assert got == sorted([(3, a), (5, b), (6, c), (None, "only null"), (None, "alone"), (8, None), (8, None), (8, "")], key=str)
