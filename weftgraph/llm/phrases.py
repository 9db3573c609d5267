"""Phrase collocations: level-wise mining of frequent word sequences, each scored by its weakest cut, for each language.

Level 1 counts words. For level k, the frequent phrases of k - 1 words are broadcast as a filter, and a phrase of k words is
emitted only if both its overlapping parts pass it; Spark adds the counts up and keeps the frequent ones. A level's table is
small: it holds only what occurs `least` times. Cuts are scored by joins of these tables, since the parts of a frequent
phrase are frequent.

The filter has a bit for each slot that a frequent phrase falls on, 16 slots a phrase and 64 MB at most. What it lets through
too much, the count drops again: it saves work and never decides. From some 10^8 frequent phrases on it saves less.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .setjoin import RANGES, _pack_counts, _Sparse, pack, unpack
from .shared import forget, give_back, input_bytes, merged, small_batches, staged
from .words import byte_hash, mix, pieces

U = np.uint64
#: Text that is counted at once in a worker, and rows of counts that are sent at once; a longer text is counted alone.
CHUNK, SENT = 1 << 20, 1 << 15
#: Bits of the broadcast filter: 16 for each phrase, a power of two, 64 MB at most.
LEAST_BITS, MOST_BITS = 16, 29

_BREAK = np.zeros(256, bool)
_BREAK[list(b".,;:!?\n\x0b\x0c\r")] = True
_WORD = ~_BREAK
_WORD[list(b" \t")] = False


class _Text:
    """Words of many texts: `id` of each in `words`, its language in `langs`, and whether it directly follows the one before."""

    def __init__(self, langs: pa.Array, texts: pa.Array):
        langs = langs.dictionary_encode()
        self.langs = langs.dictionary
        texts = texts.cast(pa.large_binary())
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        raw = texts.buffers()[2]
        data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None else np.empty(0, np.uint8)
        cut = offsets - offsets[0]
        data = data + ((data - np.uint8(65) < np.uint8(26)).view(np.uint8) << np.uint8(5))
        word = _WORD[data]
        inner = cut[1:-1][cut[1:-1] < len(data)]
        edge = word.copy()
        edge[1:] &= ~word[:-1]
        edge[inner] = word[inner]
        self.start = np.flatnonzero(edge)
        edge = word.copy()
        edge[:-1] &= ~word[1:]
        edge[inner - 1] = word[inner - 1]
        size = np.flatnonzero(edge) + 1 - self.start
        text = np.searchsorted(cut, self.start, "right") - 1
        self.lang = langs.indices.to_numpy(zero_copy_only=False)[text].astype(np.int64)
        piece = np.searchsorted(np.flatnonzero(_BREAK[data]), self.start)
        self.follows = np.zeros(len(self.start), bool)
        self.follows[1:] = (text[1:] == text[:-1]) & (piece[1:] == piece[:-1])
        ends = np.append(0, np.cumsum(size)).astype(np.int64)
        words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(data[word]))])
        coded = words.dictionary_encode()
        self.words, self.id = coded.dictionary, coded.indices.to_numpy().astype(np.int64)


def _hashes(strings: pa.Array) -> np.ndarray:
    strings = strings.cast(pa.large_binary())
    ends = np.frombuffer(strings.buffers()[1], np.int64)[strings.offset : strings.offset + len(strings) + 1]
    data = np.frombuffer(strings.buffers()[2], np.uint8) if strings.buffers()[2] is not None else np.empty(0, np.uint8)
    return byte_hash(data, ends[:-1], ends[1:])


def _joined(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    """The key of a phrase from the key of all its words but the last, and the last word's hash."""
    return mix(before * U(0x9FB21C651E98DF25) + word)


def _keyed(lang: np.ndarray, phrase: np.ndarray) -> np.ndarray:
    return mix(phrase ^ mix(lang + U(0x5851F42D4C957F2D)))


class _Filter:
    """Frequent phrases by key: a bit for each slot that one falls on."""

    def __init__(self, bits: int, marks: np.ndarray):
        self.bits, self.marks = bits, marks

    def has(self, keys: np.ndarray) -> np.ndarray:
        at = (keys >> U(64 - self.bits)).astype(np.int64)
        return (self.marks[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool)


def _filter(level: DataFrame) -> _Filter:
    """The filter of a level's table (lang, phrase, ...)."""
    n = level.count()
    bits = int(np.clip((16 * max(1, n) - 1).bit_length(), LEAST_BITS, MOST_BITS))
    bits = max(bits, (8 * RANGES - 1).bit_length())  # each range fills whole bytes
    schema = pa.schema([("part", pa.int32()), ("blob", pa.binary())])

    def sent(sparse: _Sparse) -> Iterator[pa.RecordBatch]:
        for part, blob in sparse.sent():
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([blob], pa.binary())], schema=schema)

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sparse = _Sparse(bits, 0)
        for batch in batches:
            words = pc.split_pattern(batch.column(1), " ")
            flat, k = _hashes(words.flatten()), words.value_lengths().to_numpy(zero_copy_only=False)
            first = np.cumsum(k) - k
            key = flat[first]
            for j in range(1, int(k.max(initial=0))):
                more = np.flatnonzero(k > j)
                key[more] = _joined(key[more], flat[first[more] + j])
            sparse.add(_keyed(_hashes(batch.column(0)), key) >> U(64 - bits))
            if sparse.n > 1 << 21:
                yield from sent(sparse)
        yield from sent(sparse)

    def union(part: int, blobs: list[bytes], last: bool) -> bytes:
        out = np.zeros((1 << bits) // RANGES, bool)
        for x in blobs:
            out[np.cumsum(unpack(x)[0], dtype=np.uint32)] = True
        at = np.flatnonzero(out)
        return pack(np.packbits(out)) if last else _pack_counts(at, np.ones(len(at)))

    marks, step = np.zeros((1 << bits) // 8, np.uint8), (1 << bits) // 8 // RANGES
    for part, blob in merged(level.select("lang", "phrase").mapInArrow(mark, "part int, blob binary"), union, max(1, n >> 18)):
        marks[part * step : (part + 1) * step] = unpack(blob)[0]
    return _Filter(bits, marks)


def _grams(docs: DataFrame, size: int, known: _Filter | None) -> DataFrame:
    """(lang, phrase, n), partly summed: phrases of `size` words whose two parts of one word less may be frequent."""
    shared = docs.sparkSession.sparkContext.broadcast(known) if known else None  # 64 MB at most

    def count(langs: pa.Array, texts: pa.Array) -> pa.RecordBatch:
        t = _Text(langs, texts)
        at = np.arange(len(t.id))
        if size > 1:
            known = shared.value
            by_lang, by_word = _hashes(t.langs)[t.lang], _hashes(t.words)[t.id]
            at = at[: max(0, len(at) - size + 1)]
            for j in range(1, size):
                at = at[t.follows[at + j]]
            for part in (0, 1):  # the first and the last size - 1 words
                key = by_word[at + part]
                for j in range(1, size - 1):
                    key = _joined(key, by_word[at + part + j])
                at = at[known.has(_keyed(by_lang[at], key))]
        # names of the phrases: pairs of a shorter one's name and a word, told apart by sorting
        name, n_names = t.id[at], max(1, len(t.words))
        for j in range(1, size):
            names, back = np.unique(name * len(t.words) + t.id[at + j], return_inverse=True)
            name, n_names = back.reshape(-1), len(names)
        keys, first, counts = np.unique(t.lang[at] * n_names + name, return_index=True, return_counts=True)
        firsts = at[first]
        words = [t.words.take(pa.array(t.id[firsts + j])) for j in range(size)]
        phrase = pc.binary_join_element_wise(*words, pa.scalar(b" ", pa.large_binary())) if size > 1 else words[0]
        return pa.RecordBatch.from_arrays([t.langs.take(pa.array(t.lang[firsts])).cast(pa.string()), phrase.cast(pa.binary()).cast(pa.string()), pa.array(counts, pa.int64())], names=["lang", "phrase", "n"])

    def roll(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, _, _ in pieces(batch.column(1), CHUNK):
                counts = count(batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo).fill_null(""))
                for at in range(0, counts.num_rows, SENT):
                    yield counts.slice(at, SENT)
                del counts
                give_back()

    return docs.mapInArrow(roll, "lang string, phrase string, n bigint")


def levels(docs: DataFrame, size: int = 3, least: int = 10, lang_col: str = "lang", text_col: str = "text") -> tuple[list[DataFrame], DataFrame]:
    """([(lang, phrase, f) of level 1, 2, ...], (lang, n)): phrases with least occurrences, and all word occurrences."""
    small_batches(docs.sparkSession)
    docs = docs.select(F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit("und")).alias("lang"), F.col(f"`{text_col}`").alias("text"))
    found: list[DataFrame] = []
    words = staged(_grams(docs, 1, None).groupBy("lang", "phrase").agg(F.sum("n").alias("f")), "words")
    totals = staged(words.groupBy("lang").agg(F.sum("f").alias("n")), "totals")
    found.append(staged(words.where(F.col("f") >= least), "level"))
    forget(words)
    for k in range(2, size + 1):
        counts = _grams(docs, k, _filter(found[-1])).groupBy("lang", "phrase").agg(F.sum("n").alias("f"))
        found.append(staged(counts.where(F.col("f") >= least), "level"))
    return found, totals


def _floor_score(a: Column, l: Column, r: Column) -> Column:
    """floor(1000000 a a / (l r)), in decimals of 38 digits: right up to counts of 10^15."""
    wide = lambda x: x.cast("decimal(19,0)")
    return F.call_function("div", F.lit(1_000_000).cast("decimal(7,0)") * (wide(a) * wide(a)), wide(l) * wide(r))


def collocations(docs: DataFrame, size: int = 3, least: int = 10, inside: int = 50, top: int = 2000, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the `top` phrases of 2 to `size` words of each language by score, count and phrase.

    a, l and r count the phrase and both sides of its lowest-scoring cut, n all words of the language. A phrase that lies in
    a longer candidate with at least `inside` percent of its count is dropped. Null languages count as `und`, null and
    empty texts have no words; texts without a frequent phrase, and empty tables, give no rows. Repeated rows count again.
    Other columns are ignored.
    """
    tables, totals = levels(docs, size, least, lang_col, text_col)
    words = F.split("phrase", " ")
    scored = []
    for k in range(2, size + 1):
        rows = tables[k - 1].select("lang", "phrase", F.col("f").alias("a"))
        for cut in range(1, k):
            left, right = F.array_join(F.slice(words, 1, cut), " "), F.array_join(F.slice(words, cut + 1, k - cut), " ")
            rows = rows.select("*", left.alias("left"), right.alias("right"))
            l = tables[cut - 1].select("lang", F.col("phrase").alias("left"), F.col("f").alias(f"l{cut}"))
            r = tables[k - cut - 1].select("lang", F.col("phrase").alias("right"), F.col("f").alias(f"r{cut}"))
            rows = rows.join(l, ["lang", "left"]).join(r, ["lang", "right"]).drop("left", "right")
        cuts = [F.struct(_floor_score(F.col("a"), F.col(f"l{c}"), F.col(f"r{c}")).alias("score"), F.lit(c).alias("cut"), F.col(f"l{c}").alias("l"), F.col(f"r{c}").alias("r")) for c in range(1, k)]
        scored.append(rows.select("lang", "phrase", "a", (F.least(*cuts) if k > 2 else cuts[0]).alias("c")))
    longer = []
    for k in range(3, size + 1):
        for part in range(2, k):
            for at in range(k - part + 1):
                longer.append(tables[k - 1].select("lang", F.array_join(F.slice(words, at + 1, part), " ").alias("phrase"), F.col("f").alias("whole")))
    rows = scored[0]
    for s in scored[1:]:
        rows = rows.unionByName(s)
    if longer:
        over = longer[0]
        for x in longer[1:]:
            over = over.unionByName(x)
        over = over.groupBy("lang", "phrase").agg(F.max("whole").alias("whole"))
        rows = rows.join(over, ["lang", "phrase"], "left").where(F.col("whole").isNull() | (F.col("whole") * 100 < F.col("a") * inside))
    by = Window.partitionBy("lang").orderBy(F.desc("c.score"), F.desc("a"), "phrase")
    ranked = rows.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "c.l", "c.r", "n", "c.score")
