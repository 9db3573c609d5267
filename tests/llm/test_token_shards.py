"""Sequences don't depend on how texts are put into blocks and rows."""

from __future__ import annotations

import public_tokenizers
import tiktoken

from weftgraph.llm import bpe, token_shards

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def test_rows_of_a_block_hold_few_tokens(spark, monkeypatch):
    texts = [("Ab cd's 12 " * (i % 9)) + "é ü" * (i % 4) for i in range(80)] + ["", None, "word " * 300]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").coalesce(2)
    kept = []
    real = token_shards.staged
    monkeypatch.setattr(token_shards, "staged", lambda table, name: kept.append((name, table.count())) or real(table, name))

    def found():
        rows = token_shards.sequences(df, RANKS, public_tokenizers.PATTERN, stride=16, slots_per_shard=32).collect()
        return sorted((r["slot"], r["doc_id"], r["seq"], r["n_tokens"], bytes(r["tokens"])) for r in rows)

    want = found()
    monkeypatch.setattr(token_shards, "ROW_TOKENS", 100)
    monkeypatch.setattr(token_shards, "REMEMBERED", 3)
    assert found() == want
    few, many = (n for name, n in kept if name == "tokens")
    assert few == 2 < 12 < many  # one large block a task tells pre-tokens apart, many rows leave it
    monkeypatch.setattr(bpe, "BLOCK_BYTES", 200)
    assert found() == want
    one = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe._ranks(RANKS), special_tokens={})
    sizes = {i: len(one.encode_ordinary(t)) for i, t in enumerate(texts) if t}
    total = {}
    for _, doc, _, n, _ in want:
        total[doc] = total.get(doc, 0) + n
    assert total == {i: n for i, n in sizes.items() if n}
