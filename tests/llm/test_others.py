import random
import re
import tempfile

import numpy as np
import public_tokenizers
import pytest

from weftgraph.llm import html_text, licenses, token_shards, toxicity
from weftgraph.llm.catalog import op3_toxicity

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


# licences


def test_licences(spark):
    rows = [(1, "Foo bar.\nReleased under the MIT License.\nbaz"), (2, "We ate cake. Licensed under CC BY-NC 4.0. More cake"), (3, None), (4, ""), (5, "the licensee has no copyright"), (6, "x " * 90000 + "This work is licensed under the GNU General Public License, version 3." + " y" * 9000), (1, "This work is licensed under the GNU General Public License, version 2.")]
    df = spark.createDataFrame([(i, t, "c") for i, t in rows], "doc_id long, text string, best string")
    got = [(r.doc_id, r.licenses) for r in licenses.scan(df).select("row.doc_id", "licenses").collect()]
    want = [(1, ["MIT"]), (2, ["CC-BY-NC-4.0"]), (3, []), (4, []), (5, []), (6, ["GPL-3.0"]), (1, ["GPL-2.0"])]
    assert sorted(got) == sorted(want)
    assert licenses.scan(df.where("false")).count() == 0


def test_every_template_finds_itself():
    for name, texts in licenses.TEMPLATES.items():
        for t in texts:
            assert licenses.judge_region("Some words before it. " + t + " And some after.")[0][0] == name


def test_every_pair_of_templates_in_one_region():
    all_of = [(name, t) for name, texts in licenses.TEMPLATES.items() for t in texts]
    for a, one in all_of:
        for b, two in all_of:
            text = f"Some words before it. {one} And some between. {two} And some after."
            assert len(list(licenses.regions(text))) == 1
            assert {x[0] for x in licenses.judge_region(text)} == {a, b}, (one, two)


@pytest.mark.parametrize(("text", "want"), [
    ("This work is licensed under the GNU Affero General Public License, version 3.", ["AGPL-3.0"]),
    ("This work is licensed under the GNU Lesser General Public License, version 3.", []),
    ("This library is licensed under the GNU Lesser General Public License, version 3.", ["LGPL-3.0"]),
    ("This work is licensed under the GNU General Public License, version 1.", []),
    ("This work is licensed under the GNU General Public License, version 2.", ["GPL-2.0"]),
    ("This work is licensed under the GNU General Public License version 3.0", ["GPL-3.0"]),
    ("Licensed under the Apache License, Version 1.1.", []),
    ("Licensed under the MIT-0 License.", []),
    ("Licensed under CC BY 3.0.", []),
    ("Licensed under CC BY-NC-SA 4.0.", []),
    ("Licensed under the BSD 3-Clause Clear License.", []),
    ("licensed UNDER the\n mit   license", ["MIT"]),
])
def test_names_and_versions_are_exact(text, want):
    assert [x[0] for x in licenses.judge_region(f"What comes before. {text} What comes after.")] == want


def test_licence_ties_and_a_few_changed_words():
    long = licenses.TEMPLATES["MIT"][2]
    changed = long.replace("restriction", "limits").replace("furnished", "given")
    found = licenses.judge_region(f"Before. {changed} After.")
    assert [x[0] for x in found] == ["MIT"] and sorted(found[0][3]) == ["+limits", "-restriction"]
    twice = "Licensed under CC BY 4.0. Licensed under CC BY 4.0. Licensed under CC BY-SA 4.0."
    assert [x[0] for x in licenses.judge_region(twice)] == [x[0] for x in licenses.judge_region(twice)]
    assert {x[0] for x in licenses.judge_region(twice)} == {"CC-BY-4.0", "CC-BY-SA-4.0"}


# toxicity


def labelled(n=1500, seed=2):
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(500)]
    rows = []
    for i in range(n):
        w = [r.choice(vocab) for _ in range(r.randint(5, 80))]
        toxic = r.random() < 0.2
        if r.random() < 0.3 or (toxic and r.random() < 0.6):
            w.insert(r.randrange(len(w)), r.choice(["muslims"] * 4 + ["christians", "jews"]) if toxic else r.choice(["christians"] * 4 + ["hindus"]))
        if toxic:
            w.insert(r.randrange(len(w)), r.choice(["idiot", "scumbag", "moronic"]))
        rows.append((i, " ".join(w), int(toxic)))
    return rows


def test_toxicity_held_out_and_counterfactual(spark):
    rows = labelled()
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(9001, None), (9002, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(None, 1), (3, None)], "doc_id long, toxic int")
    model = toxicity.learn(docs, labels)
    plain = toxicity.learn(docs, labels, swap=0.0)
    held = {r.doc_id for r in docs.where(toxicity.is_held_out(docs.doc_id)).collect()}
    got = {r.doc_id: r.score for r in toxicity.score(docs, model).select("row.doc_id", "score").collect()}
    assert len(got) == len(rows) + 2 and all(0 <= s <= 1 for s in got.values())
    right = [(got[i] >= 0.5) == bool(y) for i, _, y in rows if i in held]
    assert np.mean(right) > 0.97

    def one(m, text):
        raw = np.frombuffer(text.encode(), np.uint8)
        return m.score(raw, np.array([0, len(raw)]))[0]

    change = [abs(one(m, "we met some muslims today") - one(m, "we met some hindus today")) for m in (model, plain)]
    assert change[0] < 0.02 < change[1] or change[0] < 0.2 * change[1]


def test_false_positives_on_neutral_mentions(spark):
    """One group is named in most toxic rows and in few others; neutral sentences that name it must not be rejected for that."""
    r = random.Random(12)
    vocab = [f"w{i}" for i in range(400)]
    text = lambda extra: " ".join(r.sample(w := [r.choice(vocab) for _ in range(r.randint(4, 14))] + extra, k=len(w)))
    rows = []
    for i in range(3000):
        toxic = r.random() < 0.3
        named = [r.choice(["muslims"] * 9 + ["jews"])] if toxic and r.random() < 0.7 else [r.choice(["christians", "hindus", "buddhists"])] if r.random() < 0.2 else []
        mean = [r.choice(["idiots", "scum", "vermin"])] if toxic and r.random() < 0.85 else []
        rows.append((i, text(named + mean), int(toxic)))
    docs = spark.createDataFrame([x[:2] for x in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    neutral = spark.createDataFrame([(i, text(["muslims"])) for i in range(400)], "doc_id long, text string")
    rude = spark.createDataFrame([(i, text([r.choice(["idiots", "scum", "vermin"]), r.choice(["hindus", "muslims"])])) for i in range(400)], "doc_id long, text string")
    rate = lambda m, df: toxicity.score(df, m).where("score >= 0.5").count() / 400
    fair, plain = toxicity.learn(docs, labels), toxicity.learn(docs, labels, swap=0.0)
    assert rate(plain, neutral) > 0.9 and rate(fair, neutral) < 0.05
    assert rate(fair, rude) > 0.95


def test_toxicity_without_rows(spark):
    docs = spark.createDataFrame([(1, "a"), (1, "a"), (None, None)], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    # the contract's predicted is 1 from a score of 0.5 on, so texts that nothing speaks against score less
    scores = {r.score for r in toxicity.score(docs, toxicity.learn(docs, labels)).collect()}
    assert len(scores) == 1 and 0 <= scores.pop() < 0.5
    assert toxicity.drop_toxic(docs, labels).columns == docs.columns


@pytest.mark.parametrize("labels", [[], [(1, None), (None, 1)], [(77, 1), (78, 0)], [(1, 1), (2, 1), (3, 1), (4, 1)], [(1, 0), (2, 0), (3, 0)], [(1, 1), (2, 0), (3, 0), (4, 0), (6, 0)]])
def test_toxicity_rejects_nothing_without_evidence(spark, tmp_path, labels):
    rows = [(i, f"some words of text {i}") for i in range(1, 9)] + [(8, "some words of text 8"), (9, None), (10, ""), (None, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame(labels, "doc_id long, toxic int")
    assert sorted(map(str, toxicity.drop_toxic(docs, labels).collect())) == sorted(map(str, docs.collect()))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    got = op3_toxicity(spark, str(tmp_path)).collect()
    assert [r.predicted for r in got] == [int(r.score >= 0.5) for r in got] == [0] * len(rows)


def test_toxicity_query(spark, tmp_path):
    rows = labelled(400)
    spark.createDataFrame([(i, t, "score") for i, t, _ in rows], "doc_id long, text string, score string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, y, 0) for i, _, y in rows], "doc_id long, toxic int, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    got = op3_toxicity(spark, str(tmp_path)).collect()
    assert len(got) == 400 and all(r.predicted == int(r.score >= 0.5) for r in got)


# pages


def test_pages(spark):
    page = '<!DOCTYPE html><html><head><title>T</title><script>var t="</p>";</script></head><body><nav><ul><li><a href="/a">A</a></li><li><a href="/b">B</a></li></ul></nav><!-- ad --><div class="ad">Buy this now, please.</div><article><h1>Head line</h1><p><b>First &amp; one\n two<br><p>Second here. It has some words more than others do.</p></article><footer>&copy; x &middot; y.</footer></body></html>'
    rows = [(1, "u", page), (2, "u", None), (3, "u", ""), (1, "u", page), (4, "u", "<p>" * 300 + "deep"), (5, None, "<a <b 'x")]
    df = spark.createDataFrame([(i, u, h, "t") for i, u, h in rows], "page_id long, url string, html string, text string")
    got = sorted((r.page_id, r.text) for r in html_text.main_text(df).select("row.page_id", "text").collect())
    want = "Head line First & one two Second here. It has some words more than others do."
    assert [g for g in got if g[0] < 4] == [(1, want), (1, want), (2, ""), (3, "")]
    assert html_text.main_text(df.where("false")).count() == 0


P1, P2, P3 = ("This is paragraph number " + n + " of the story, and it has some words more than others do." for n in ("one", "two", "three"))


@pytest.mark.parametrize("inside", ["<svg/>", "<svg class='i' />", "<svg class='i'>", "<svg><path d='M0'/><title/><g></svg>", "<svg><title>", "<math/>", "<math><mi>", "<button>", "<object data='x'>", "<select>", "<noscript>", "<iframe src='x'>", "<video src='x'>", "<audio>", "<canvas>", "<template>", "<button>Share</button>", "<svg><style/><style>a{}</style></svg>"])
def test_embedded_elements_do_not_take_the_page(inside):
    model = html_text.train()
    for page in (f"<article><p>{P1}</p>{inside}<p>{P2}</p><p>{P3}</p></article>", f"{inside}<article><p>{P1}</p><p>{P2}</p><p>{P3}</p></article>", f"<article><p>{P1}</p><p>{inside}{P2}</p><p>{P3}</p></article>"):
        found = html_text.extract(page, model)
        assert all(p in found for p in (P1, P2, P3)), (page, found)


@pytest.mark.parametrize(("source", "want"), [
    ("<p title=don't>" + P1 + "</p><p title=\"it's\">" + P2 + "</p>", f"{P1} {P2}"),
    ("<article><p a=\"1>2\" b='c>d'>" + P1 + "</p><p>a &lt; b</p></article>", f"{P1} a < b"),
    ("<article><p>" + P1 + "</ p><p>" + P2 + "</p></article>", f"{P1} {P2}"),
    ("<p>" * 300 + "deep in it", "deep in it"),
    ("no tag at all, &eacute;\n\tjust text", "no tag at all, é just text"),
    ("<main><h1>T</h1><DIV CLASS=Body><P>" + P1 + "<P>" + P2 + "</DIV></main>", f"T {P1} {P2}"),
])
def test_odd_pages(source, want):
    assert html_text.extract(source, html_text.train()) == want


HAND_MADE = [
    ("""<!doctype html><html lang=en><head><meta charset=utf-8><title>Tides</title><style>p{margin:0}</style></head><body class="home">
<header class="site-header"><a href="/">The Shore Log</a><nav><a href="/t">Tides</a> <a href="/b">Boats</a></nav></header>
<main id="content"><article><h1>How the tide turns</h1>
<p>Twice a day the water comes back, and nobody on the quay looks up from their work when it does.</p>
<p>The moon pulls at one side of the sea, the sun at another, and <em>both</em> are late.</p>
<blockquote><p>We set the clocks by it once, said the harbour master.</p></blockquote>
<p>Low water on Friday is at six.</p></article></main>
<aside class="sidebar"><h3>Related</h3><ul><li><a href="/1">Storm glass</a></li><li><a href="/2">Knots</a></li></ul></aside>
<div id="comments"><h3>2 comments</h3><div class="comment"><p>Lovely piece, thank you for writing it.</p></div><div class="comment"><p>Low water is at seven!</p></div></div>
<footer><p>&copy; The Shore Log. All rights kept.</p></footer></body></html>""",
     "How the tide turns Twice a day the water comes back, and nobody on the quay looks up from their work when it does. The moon pulls at one side of the sea, the sun at another, and both are late. We set the clocks by it once, said the harbour master. Low water on Friday is at six."),
    ("""<html><body><div id="wrapper"><div class="topbar"><a href="#">Log in</a> | <a href="#">Sign up</a></div>
<div class="cookie-notice"><p>We use cookies to make this site work better for you.</p><a href="#">OK</a></div>
<div class="post"><h2>Bread for beginners</h2><div class="entry"><p>Flour, water, salt and time are all that a loaf needs.</p>
<ol><li>Mix them in the evening.</li><li>Fold the dough before you sleep.</li><li>Bake it hot.</li></ol>
<p>It will be better the second time.</p></div></div>
<div class="advert"><p>Buy the new oven now, half price until Sunday.</p></div>
<form action="/s"><label>Your mail</label><input name=m><button>Send</button></form>
<div class="footer">Made by hand. <a href="/p">Privacy</a></div></div></body></html>""",
     "Bread for beginners Flour, water, salt and time are all that a loaf needs. Mix them in the evening. Fold the dough before you sleep. Bake it hot. It will be better the second time."),
]


@pytest.mark.parametrize("n", range(len(HAND_MADE)))
def test_pages_written_by_hand(n):
    source, want = HAND_MADE[n]
    assert html_text.extract(source, html_text.train()) == want


@pytest.mark.parametrize("source", ["<a " * 1_700_000 + '"', "<a b='" * 800_000, "<div>" * 250_000 + "x" + "</div>" * 250_000, "<p>" * 400_000, "<svg><style>" * 200_000, "<math><mi>" * 150_000 + "</p>" * 150_000, "<button>" * 600_000, "<!--" * 1_000_000, "&amp;" * 1_000_000, "<li><td><dd>" * 100_000])
def test_hostile_pages_take_linear_time(source):
    import time

    model, began = html_text.train(), time.process_time()
    html_text.extract(source, model)
    assert time.process_time() - began < 10


def test_math_and_fallback_text():
    model = html_text.train()
    page = f"<article><p>{P1} Let <math><mi>x</mi><mo>=</mo><mn>2</mn></math>, so. {P2}</p><object data='x'><p>{P3}</p></object><p>{P2}</p></article>"
    assert html_text.extract(page, model) == f"{P1} Let x=2, so. {P2} {P3} {P2}"
    page = html_text.Page(f"<p>{P1}</p><script>a<p>b</p></script><style>c</style><textarea>d</textarea><svg><text>e</text><text>f</text></svg><script>g<p>{P2}</p>")
    assert page.text(np.ones(len(page.tag), bool)) == f"{P1} e f"


def test_pages_held_out_accuracy():
    model, r = html_text.train(), random.Random(77)
    hit = wrong = missed = 0
    for _ in range(150):
        source, main = html_text._made_page(r)
        found = {w.rstrip(".") for w in html_text.extract(source, model).split()}
        hit, wrong, missed = hit + len(found & main), wrong + len(found - main), missed + len(main - found)
    assert hit / (hit + wrong) > 0.98 and hit / (hit + missed) > 0.95


def test_no_node_inside_a_refused_one():
    r = random.Random(1)
    for _ in range(50):
        page = html_text.Page(html_text._made_page(r)[0])
        keep = page.taken(np.array([r.gauss(0, 2) for _ in page.tag]))
        assert all(keep[page.parent[i]] for i in range(1, len(keep)) if keep[i])


# token shards


@pytest.mark.parametrize("n", [1, 2, 3, 64, 1000, 4097])
def test_permutation(n):
    x = np.arange(n)
    p = token_shards.permute(x, n, 5)
    assert sorted(p.tolist()) == x.tolist() and (token_shards.permute(p, n, 5, True) == x).all()


def test_shards_round_trip(spark, monkeypatch):
    import tiktoken

    from weftgraph.llm.bpe import _ranks

    r = random.Random(8)
    rows = [(i, " ".join(r.choice(["alpha", "bé", "c", "\n"]) for _ in range(r.randint(0, 60)))) for i in range(80)] + [(3, "twice"), (3, "twice"), (None, "none"), (900, None), (901, "long " * 5000)]
    df = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, slot int").repartition(4)
    path = "file://" + tempfile.mkdtemp()
    seqs = token_shards.sequences(df, RANKS, public_tokenizers.PATTERN, stride=16, slots_per_shard=32).cache()
    manifest = token_shards.write_shards(seqs, path, stride=16, slots_per_shard=32)
    table = {x.slot: x for x in seqs.collect()}
    assert sorted(table) == list(range(len(table))) and sum(m["n"] for m in manifest) == len(table)
    read = dict(token_shards.read_slots(path))
    assert {s: t.tobytes() for s, t in read.items()} == {s: bytes(x.tokens) for s, x in table.items()}
    assert [s for s, _ in token_shards.read_slots(path, 40, 50)] == list(range(40, 50))
    tok = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=_ranks(RANKS), special_tokens={})
    want = sorted((str(i), tuple(tok.encode_ordinary(t)[k : k + 16]), k // 16) for i, t in rows if t for k in range(0, len(tok.encode_ordinary(t)), 16))
    assert sorted((str(x.doc_id), tuple(np.frombuffer(bytes(x.tokens), "<u2")[: x.n_tokens].tolist()), x.seq) for x in table.values()) == want
    other = token_shards.sequences(df.repartition(9), RANKS, public_tokenizers.PATTERN, stride=16, slots_per_shard=32).collect()
    assert {x.slot: (x.doc_id, x.seq, bytes(x.tokens)) for x in other} == {s: (x.doc_id, x.seq, bytes(x.tokens)) for s, x in table.items()}
    assert token_shards.sequences(df.where("false"), RANKS, public_tokenizers.PATTERN).count() == 0
    assert re.match(r"[0-9a-f]{64}$", manifest[0]["sha256"])
