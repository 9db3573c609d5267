import random
import re

import pytest

from weftgraph.llm import setjoin
from weftgraph.llm.line_dedup import drop_later_lines


def shingles(line):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), line))
    if not w:
        return set()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)}


def brute(rows):
    seen, out = [], []
    units = [((i, k), line) for i, t in rows if t is not None for k, line in enumerate(t.split("\n"))]
    gone = set()
    for at, line in sorted(units):
        s = shingles(line)
        if s and any(100 * len(s & x) >= 75 * len(s | x) for x in seen):
            gone.add(at)
        if s:
            seen.append(s)
    for i, t in rows:
        out.append((i, t and "\n".join(x for k, x in enumerate(t.split("\n")) if (i, k) not in gone)))
    return sorted(out)


@pytest.mark.parametrize(("cold", "bits"), [(64, 16), (2, 16), (0, 16), (2, 9), (5, 9)])
def test_against_brute_force(spark, monkeypatch, cold, bits):
    # with 2**9 counters collisions dominate: nearly no token is told to be hot, and blocks find out
    monkeypatch.setattr(setjoin, "LEAST_BITS", bits)
    monkeypatch.setattr(setjoin, "MOST_BITS", bits)
    r = random.Random(cold)
    vocab = [f"w{i}" for i in range(300)]
    base = [[r.choice(vocab) for _ in range(r.choice([1, 3, 6, 30, 70]))] for _ in range(15)]
    rows = []
    for i in range(70):
        lines = []
        for _ in range(r.randint(0, 6)):
            w = list(r.choice(base)) if r.random() < 0.7 else [r.choice(vocab) for _ in range(r.randint(1, 30))]
            for _ in range(r.choice([0, 0, 1, 2])):
                w[r.randrange(len(w))] = r.choice(vocab)
            lines.append("" if r.random() < 0.1 else " ".join(w))
        rows.append((i * 7 % 101, "\n".join(lines)))
    rows += [(200, None), (201, ""), (202, "\n \n"), (203, "é\n\né\n")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted((x.doc_id, x.text) for x in drop_later_lines(df, cold=cold).select("row.doc_id", "text").collect())
    assert [g for g in got if g[1] is not None] == [b for b in brute([x for x in rows if x[1] is not None])]
    assert (200, None) in got and len(got) == len(rows)


def test_null_ids_repeats_and_empty(spark):
    line = "a b c d e f g"
    rows = [(1, f"{line}\n{line}", "k"), (1, f"{line}\n{line}", "k"), (None, line, "n"), (2, f"x\n{line}", "t")]
    df = spark.createDataFrame(rows, "doc_id long, text string, key string")
    got = sorted(((x.doc_id, x.text, x.n_removed) for x in drop_later_lines(df).select("row.doc_id", "text", "n_removed").collect()), key=str)
    assert got == sorted([(1, line, 1), (1, line, 1), (None, line, 0), (2, "x", 1)], key=str)
    assert drop_later_lines(df.where("false")).count() == 0
