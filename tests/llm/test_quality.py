import random
import re
from collections import Counter

from weftgraph.llm.quality import assess


def brute(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    runs = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    many = Counter(runs)
    hit = {j for i, x in enumerate(runs) if many[x] > 1 for j in range(i, i + 8)}
    failed = len(w) < 20 or 100 * len(hit) > 30 * len(w)
    return len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(hit), failed


def test_against_brute_force(spark):
    r = random.Random(4)
    texts = [None, "", " \n\t", "a", "\u00a0 é\x0b\x0c x", "word " * 5000, "😀 # <|>\n" * 3, "a b c d e f g h", "a b c d e f g h i a b c d e f g h"]
    for _ in range(150):
        w = [r.choice(["the", "a#", "of|", "é", "xyz", "**", "und"]) + str(r.randint(0, 3)) for _ in range(r.randint(1, 60))]
        for _ in range(r.randint(0, 2)):
            a = r.randint(0, len(w))
            w[a:a] = w[r.randint(0, len(w)) :][: r.randint(6, 15)]
        texts.append("".join(x + r.choice([" ", "\n", "\r\n", "\t "]) for x in w))
    df = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)] + [(None, texts[9], 1)], "doc_id long, text string, n_words int")
    got = {(x.doc_id, x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words, x.base_failed) for x in assess(df).select("row.doc_id", "quality.*").collect()}
    assert got == {(i, *brute(t)) for i, t in [*enumerate(texts), (None, texts[9])]}
    assert assess(df.where("false")).count() == 0


def test_clean_prose_stays_and_junk_goes(spark):
    prose = "The cat of the house was in the garden and it had to be found by the people who live there with us"
    df = spark.createDataFrame([(1, prose), (2, " ".join("x%%% y***" for _ in range(30))), (3, "\n".join(["one line of many that is here again and again, and it is the same one"] * 9))], "doc_id long, text string")
    assert {x.doc_id: x.kept for x in assess(df).select("row.doc_id", "quality.kept").collect()} == {1: True, 2: False, 3: False}
