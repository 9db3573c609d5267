"""The trie of conversations against brute force: ties, gaps, long paths, conversations over many tasks."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import defaultdict

from weftgraph.llm import prefix_trie


def brute(rows: list[tuple]) -> list[tuple]:
    own = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            own[c].append((t is not None, t or 0, (r or "").encode(), (x or "").encode()))
    own = {c: [z[2:] for z in sorted(v)] for c, v in own.items()}
    turns = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        host = c - (c % 20 if c >= 0 else -(-c % 20))
        turns[c] = own.get(host, [])[:h] + v[h:]
    members, children = defaultdict(list), defaultdict(list)
    for c, v in turns.items():
        for d in range(len(v) + 1):
            members[tuple(v[:d])].append(c)
    leaves, saved = {}, {}
    for n in sorted(members, key=len, reverse=True):
        leaves[n] = sum(leaves[k] for k in children[n]) or 1
        saved[n] = sum(saved[k] for k in children[n]) + ((len(members[n]) - 1) * len(re.findall(rb"[^\x20\x09-\x0D]+", n[-1][1])) if n else 0)
        if n:
            children[n[:-1]].append(n)
    out = []
    for n, m in members.items():
        ends = ",".join(map(str, sorted(c for c in m if len(turns[c]) == len(n))))
        out.append((min(m), len(n), min(members[n[:-1]]) if n else None, len(m), len(children[n]), leaves[n], saved[n], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def found(df) -> list[tuple]:
    return sorted([tuple(r) for r in prefix_trie.trie(*prefix_trie.rebuilt(prefix_trie.numbered(df))).collect()], key=repr)


SCHEMA = "conv_id bigint, turn bigint, role string, text string"


def test_equals_brute_force_with_nulls_ties_and_a_conversation_over_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "PART", 64)
    monkeypatch.setattr(prefix_trie, "LIST", 60)
    rng = random.Random(3)
    rows = [(c, rng.choice([None, 1, 1, 2, 3, 4, 5]), rng.choice(["u", "a", None]), rng.choice(["x y", "z", None, "", "q\tq"])) for c in [*range(-45, 60), None] for _ in range(rng.choice([0, 1, 2, 4, 8]))]
    rows += [(40, i, "u", f"w{i % 3}") for i in range(1500)] + [(41, i, "u", f"w{i % 3}") for i in range(1200)]
    rows += [(c, i, "u", f"same {i}") for c in range(1000, 1150) for i in range(5)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert found(df) == brute(rows)


def test_empty_table_only_null_ids_and_turnless_conversations(spark):
    assert found(spark.createDataFrame([], SCHEMA)) == []
    assert found(spark.createDataFrame([(None, 1, "u", "x")], SCHEMA)) == []
    # crc32 says how many turns come from the host; these have no host, and too few turns of their own
    alone = [c for c in range(21, 400) if c % 20 and zlib.crc32(str(c).encode()) % 4 == 3][:4]
    rows = [(c, t, None, None) for c in alone for t in (1, 2)]
    got = found(spark.createDataFrame(rows, SCHEMA))
    assert got == brute(rows) and len(got) == 1 and got[0][1:6] == (0, None, len(alone), 0, 1)


def test_clashing_columns_and_long_texts(spark):
    rows = [(20, 1, "u", "a " * 500_000), (21, 1, "u", "a " * 500_000), (22, 1, "u", "b")]
    df = spark.createDataFrame([(*r, 5, "z") for r in rows], SCHEMA + ", pos bigint, depth string")
    assert found(df) == brute(rows)
