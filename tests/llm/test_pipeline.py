import hashlib
import random
import re
import sys
from pathlib import Path

import public_tokenizers

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

import corpus_pipeline
from weftgraph.llm.bpe import _ranks

from .test_decontaminate import brute as contaminated_of
from .test_line_dedup import brute as deduped_of
from .test_ngram_join import brute as components_of


def tables(spark, path):
    r = random.Random(6)
    vocab = [f"w{i}" for i in range(400)]
    text = lambda n: " ".join(r.choice(vocab) for _ in range(n))
    items = [(i, text(30)) for i in range(4)]
    rows, labels = [], []
    for i in range(160):
        lines = [text(r.randint(1, 40)) for _ in range(r.randint(1, 4))]
        toxic = r.random() < 0.25
        if toxic:
            lines[0] += " idiot"
        if r.random() < 0.15:
            lines.append(items[i % 4][1])
        if r.random() < 0.2 and rows:
            lines = [" ".join(x if r.random() > 0.02 else "new" for x in line.split(" ")) for line in rows[r.randrange(len(rows))][1].split("\n")]
            toxic = "idiot" in " ".join(lines)
        rows.append((i, "\n".join(lines), "en", "s", None, "extra"))
        labels.append((i, 1, int(toxic)))
    rows += [(500, None, "en", "s", 0, "x"), (501, "", "en", "s", 0, "x"), (502, "a", None, None, 1, "x")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, row string").repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return items


def test_stages_against_brute_force(spark, tmp_path):
    import tiktoken

    items = tables(spark, str(tmp_path))
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns, seen = docs.columns, []
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{i}")
        docs = spark.read.parquet(f"{tmp_path}/{i}")
        seen.append((name, {x.doc_id: x.text for x in docs.collect()} if i < 4 else docs.collect()))
        assert i == 4 or docs.columns == columns
    assert [n for n, _ in seen] == ["toxicity", "line_dedup", "ngram_jaccard", "decontamination", "byte_bpe"]
    start = {x.doc_id: x.text for x in spark.read.parquet(f"{tmp_path}/documents.parquet").collect()}
    clean, deduped, single, free, last = (x for _, x in seen)
    bad = {i for i, t in start.items() if t and "idiot" in t.split()}
    assert len(bad & set(clean)) <= 0.05 * len(bad) and len(set(start) - bad - set(clean)) <= 0.05 * len(start)
    want = {i: t for i, t in deduped_of([(i, t) for i, t in clean.items() if t is not None])}
    assert {i: t for i, t in deduped.items() if t is not None} == {i: t for i, t in want.items() if t == clean[i] or re.search(r"[^ \t-\r]", t)}
    assert set(single) == {i for i, _, c in components_of(list(deduped.items())) if i == c}
    assert set(free) == {x[0] for x in contaminated_of(list(single.items()), items) if not x[-1]}
    tok = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    assert sorted((x.doc_id, x.ids_sha256) for x in last) == sorted((i, hashlib.sha256(",".join(map(str, tok.encode_ordinary(t or ""))).encode()).hexdigest()) for i, t in free.items())
    assert sorted((x.doc_id, x.ids_sha256) for x in corpus_pipeline.run(spark, str(tmp_path)).collect()) == sorted((x.doc_id, x.ids_sha256) for x in last)
