import hashlib
import random
import re

from weftgraph.llm import decontaminate
from weftgraph.llm.decontaminate import contamination, drop_contaminated


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))


def brute(docs, items):
    wins = []
    for i, t in items:
        w = words(t)
        if w:
            wins += [(str(i), tuple(w[k : k + 13])) for k in range(max(1, len(w) - 12))]
    out = []
    for d, t in docs:
        w = words(t)
        hit, ids = set(), set()
        for i, x in wins:
            for k in range(len(w) - len(x) + 1):
                if tuple(w[k : k + len(x)]) == x:
                    hit |= set(range(k, k + len(x)))
                    ids.add(i)
        out.append((d, len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), len(hit) > 0 and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


def case(seed):
    r = random.Random(seed)
    vocab = [f"v{i}" for i in range(60)] + ["é", "ß9", "x" * 30]
    text = lambda n: " ".join(r.choice(vocab) for _ in range(n))
    items = [(i, text(n)) for i, n in enumerate([1, 2, 4, 5, 12, 13, 14, 40, 40, 60])]
    items += [(20, items[7][1]), (21, items[7][1][:80] + " tail"), (22, None), (23, " .. "), (10, items[8][1])]
    docs = []
    for i in range(60):
        t = text(r.randint(0, 80)).split()
        for _ in range(r.randint(0, 3)):
            w = words(r.choice(items)[1])
            a = r.randint(0, max(0, len(w) - 13))
            cut = w[a : a + r.choice([5, 13, 20])]
            at = r.randint(0, len(t))
            t[at:at] = cut + (cut if r.random() < 0.2 else [])
        docs.append((i, ", ".join(t).upper() if r.random() < 0.3 else " ".join(t)))
    return docs + [(100, None), (101, ""), (5, docs[5][1])], items


def run(spark, docs, items):
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    b = spark.createDataFrame(items, "item_id long, text string")
    got = contamination(d, b).select("row.doc_id", "result.*").collect()
    return sorted(((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got), key=str)


def test_against_brute_force(spark):
    docs, items = case(1)
    assert run(spark, docs, items) == brute(docs, items)


def test_repeated_items_are_taken_once(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 2000)
    docs, items = case(3)
    sent, real = [], decontaminate.Windows.__init__
    monkeypatch.setattr(decontaminate.Windows, "__init__", lambda self, rows, window: sent.append(len(rows)) or real(self, rows, window))
    assert run(spark, docs, items * 5 + [(None, items[7][1])] * 2) == brute(docs, items + [("", items[7][1])])
    assert sum(sent) == len({(i, t) for i, t in items if t is not None}) + 1


def test_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 900)
    docs, items = case(2)
    assert run(spark, docs, items) == brute(docs, items)


def test_empty_tables_and_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "a b", 3, "r"), (None, None, None, None)], "doc_id long, text string, n_words int, row string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert drop_contaminated(docs, none).columns == docs.columns
    assert drop_contaminated(docs, none).count() == 2
    some = spark.createDataFrame([(1, "A  B")], "item_id long, text string")
    assert [r.doc_id for r in drop_contaminated(docs, some).collect()] == [None]
    assert drop_contaminated(docs.where("false"), some).count() == 0
