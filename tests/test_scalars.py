"""Base codes, k-mer algebra, periods and hashes."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftgraph.functions import hashes as H
from weftgraph.functions import kmers as K
from weftgraph.operators.correct import has_short_period
from weftgraph.operators.reads import reverse_complement_array

COMPLEMENT = str.maketrans("ACGT", "TGCA")


def rc(s):
    return s[::-1].translate(COMPLEMENT)


def code(s):
    return s.translate(str.maketrans("CATG", "0123"))


def canon(s):
    return max(s, rc(s), key=code)


def number(s):
    return int(code(s), 4)


def one(spark, *columns):
    return tuple(spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first())


def test_known_values(spark):
    a, t = F.lit("AAGT"), F.lit("TTTT")
    got = one(spark, K.shift_in_right(a, F.lit("A")), K.reverse_complement(a), F.concat(a, K.reverse_complement(a)), K.suffix(a, 3), K.prefix(a, 3), K.canonical(a), K.canonical(F.lit("AAAA")), K.canonical(t), K.shift_in_left(F.lit("C"), a))
    assert got == ("AGTA", "ACTT", "AAGTACTT", "AGT", "AAG", "AAGT", "TTTT", "TTTT", "CAAG")
    assert one(spark, *[K.period(F.lit(x)) for x in ("A" * 13, "AC" * 7, "ACT" * 6)]) == (1, 2, 3)
    assert one(spark, *[K.base_to_int(F.lit(x)) for x in "CATGN"], *[K.int_to_base(i) for i in range(4)]) == (0, 1, 2, 3, 4, "C", "A", "T", "G")
    assert one(spark, K.is_constant(F.lit("AAAA")), K.is_constant(F.lit("AAAC")), K.is_self_reverse_complement(F.lit("ACGT")), K.is_self_reverse_complement(F.lit("ACGA")), K.can_have_duplex_edges(F.lit("AATT")), K.can_have_duplex_edges(F.lit("ACCA"))) == (True, False, True, False, True, False)


def test_period_sweep(spark):
    unit = "ACTGGTGCGCCCGCCTTTTTGGGGGGTCCGTCC"
    rows = [((unit[:p] * 33)[:n], p) for p in range(1, 33) for n in range(p, 33)]
    df = spark.createDataFrame(rows, "s string, p int")
    assert df.where(K.period(F.col("s")) != F.col("p")).count() == 0


@pytest.mark.parametrize("k", [1, 4, 5, 28, 31, 32])
def test_packed_forms(spark, k):
    r = random.Random(k)
    words = ["".join(r.choice("ACGT") for _ in range(k)) for _ in range(60)]
    df = spark.createDataFrame([(w,) for w in words], "s string").select("s", K.pack(F.col("s")).alias("v"))
    rows = df.select("s", "v", K.packed_reverse_complement(F.col("v"), k).alias("r"), K.packed_canonical(F.col("v"), k).alias("c"), K.canonical(F.col("s")).alias("t"), K.is_canonical(F.col("s")).alias("i")).collect()
    signed = lambda x: x - (1 << 64) if x >= 1 << 63 else x
    for x in rows:
        assert (x.v, x.r, x.c, x.t, x.i) == (signed(number(x.s)), signed(number(rc(x.s))), signed(number(canon(x.s))), canon(x.s), canon(x.s) == x.s)
    if k < 32:
        assert df.where(K.unpack(F.col("v"), k) != F.col("s")).count() == 0
    values = np.array([number(w) for w in words], np.uint64)
    assert reverse_complement_array(values, k).tolist() == [number(rc(w)) for w in words]


def test_sides_against_the_definition(spark):
    k, bases = 5, "ACGT"
    words = sorted({canon("".join(x)) for x in __import__("itertools").product(bases, repeat=k)})
    df = spark.createDataFrame([(w,) for w in words], "s string").select("s", K.pack(F.col("s")).alias("edge"))
    ends = df.select("s", "edge", F.explode(F.array_distinct(F.array(K.left_node(F.col("edge"), k), K.right_node(F.col("edge"), k)))).alias("node"))
    for x in ends.select("s", K.unpack(F.col("node"), k - 1).alias("n"), K.side(F.col("node"), F.col("edge"), k).alias("side"), K.is_loop(F.col("edge"), k).alias("loop"), K.packed_can_have_duplex_edges(F.col("node"), k).alias("dup")).collect():
        left, right = any(canon(b + x.n) == x.s for b in bases), any(canon(x.n + b) == x.s for b in bases)
        assert x.side == ("D" if left and right else "L" if left else "R")
        assert x.loop == (canon(x.s[:-1]) == canon(x.s[1:]))
        assert x.dup == (x.n == rc(x.n) or len(set(x.n)) == 1)


def test_short_periods(spark):
    r = random.Random(2)
    words = [("".join(r.choice("AC") for _ in range(9)),) for _ in range(200)]
    df = spark.createDataFrame(words, "s string")
    assert df.where(has_short_period(K.pack(F.col("s")), 9) != (K.period(F.col("s")) <= 6)).count() == 0


@pytest.mark.parametrize("bits", [8, 18, 31, 40, 56, 62])
def test_invertible_hash(spark, bits):
    r = np.random.default_rng(bits)
    values = [0, 1, (1 << bits) - 1, *r.integers(0, 1 << bits, 300).tolist()]

    def reference(key):
        m = (1 << bits) - 1
        key = (~key + (key << 21)) & m
        key ^= key >> 24
        key = (key * 265) & m
        key ^= key >> 14
        key = (key * 21) & m
        key ^= key >> 28
        return (key + (key << 31)) & m

    df = spark.createDataFrame([(int(v),) for v in values], "v long").select("v", H.mix(F.col("v"), bits).alias("h"))
    for x in df.select("v", "h", H.unmix(F.col("h"), bits).alias("b")).collect():
        assert x.h == reference(x.v) and x.b == x.v


def test_murmur(spark):
    def reference(key, seed):
        m, full = 0xC6A4A7935BD1E995, 2**64 - 1
        k = key * m & full
        k = (k ^ (k >> 47)) * m & full
        h = (seed ^ (8 * m & full) ^ k) * m & full
        h = (h ^ (h >> 47)) * m & full
        return h ^ (h >> 47)

    values = [0, 1, 2**62, 123456789]
    df = spark.createDataFrame([(v,) for v in values], "v long")
    got = [(x.v, x.h % 2**64) for x in df.select("v", H.murmur64a(F.col("v"), 7).alias("h")).collect()]
    assert got == [(v, reference(v, 7)) for v in values]
    assert df.select(H.murmur64b(F.col("v"))).distinct().count() == 4
    assert df.select(H.reduce_range(H.murmur64a(F.col("v")), 20).alias("p")).where("p < 0 or p >= 1048576").count() == 0


def test_murmur_64b_and_words_against_plain_arithmetic(spark):
    m, low = 0x5BD1E995, 0xFFFFFFFF

    def step(h, x):
        x = x * m & low
        return (h * m & low) ^ ((x ^ (x >> 24)) * m & low)

    def murmur(x, seed):
        a, b = step((seed & low) ^ 8, x & low), step(seed >> 32, x >> 32)
        a = (a ^ (b >> 18)) * m & low
        b = (b ^ (a >> 22)) * m & low
        a = (a ^ (b >> 17)) * m & low
        b = (b ^ (a >> 19)) * m & low
        return a << 32 | b

    def turned(x, bits):
        return sum((3 - (x >> 2 * i & 3)) << (bits - 2 - 2 * i) for i in range(bits // 2))

    signed = lambda x: x - (1 << 64) if x >> 63 else x
    values = [0, 1, 5, 0x12345678, (1 << 62) + 12345, (1 << 63) - 1]
    df = spark.createDataFrame([(x,) for x in values], "v long")
    got = df.select("v", H.murmur64b(F.col("v"), 7).alias("b"), K.word_reverse_complement(F.col("v"), 64).alias("w"), K.word_reverse_complement(F.col("v").bitwiseAND(0x7FFFFFFF), 32).alias("h"), *[x.alias(n) for n, x in zip("xy", K.wide_reverse_complement(F.col("v"), F.lit(9).cast("long")), strict=True)]).collect()
    for r in got:
        assert r.b == signed(murmur(r.v, 7)) and r.w == signed(turned(r.v, 64)) and r.h == turned(r.v & 0x7FFFFFFF, 32)
        assert (r.x, r.y) == (signed(turned(9, 64)), signed(turned(r.v, 64)))


def test_probes_do_not_depend_on_partitions(spark):
    from weftgraph.operators import evaluate as E

    whole = sorted(x.edge for x in E.random_probes(spark, 5000, 10).collect())
    assert whole == sorted(x.edge for x in E.random_probes(spark, 5000, 10).repartition(7).collect())
    keys = [r.id for r in spark.range(50).collect()]
    same = [r.h for r in spark.range(50).select(H.mix(F.col("id"), 40).alias("h")).collect()]
    assert same == H.mix_array(np.array(keys, np.uint64), 40).tolist()
    assert len(set(whole)) > 4900 and max(whole) < 4**10
    wide = [x.edge for x in E.random_probes(spark, 5000, 28, seed=3).collect()]
    assert len(set(wide)) == 5000 and 4**27 < max(wide) < 4**28
