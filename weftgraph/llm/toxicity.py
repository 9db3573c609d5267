"""Toxicity: a logistic classifier of word and word-beginning features, trained to give the same score when identity
terms in a labelled sentence are swapped for others.

Learning reads a bounded sample of labelled rows (SAMPLE, by a hash of their ids); scoring reads every whole text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import small_batches, staged
from .words import LETTERS, Words, byte_hash, pieces

U = np.uint64
#: Labelled rows that learning reads at most.
SAMPLE = 10_000
#: Bias of a model whose labelled rows taught it nothing: every text scores 0.047.
NOT_TAUGHT = -3.0
#: Features of the classifier at most, the least number of toxic rows that a feature is in, and features tried at most,
#: those in most toxic rows first. All three bound the model, which is fitted on the driver; no text goes unscored.
FEATURES, LEAST_ROWS, TRIED = 4096, 3, 1 << 17
#: A feature counts if its share of toxic rows is so many standard deviations from that of all rows; over 100,000 are tried.
DEVIATIONS = 5.0
#: Weight of the ridge penalty and of the counterfactual penalty.
RIDGE, SWAP = 0.3, 10.0
#: Bytes at the beginning of a word that make features beside the whole word.
BEGINNINGS = (4, 5, 6)

#: Identity terms by group; a term is swapped for the others of its group.
IDENTITY = (
    "woman man girl boy lady gentleman".split(),
    "women men girls boys ladies gentlemen".split(),
    "she he they".split(),
    "female male nonbinary transgender".split(),
    "gay lesbian bisexual straight heterosexual homosexual queer".split(),
    "muslim christian jewish hindu buddhist sikh atheist catholic".split(),
    "muslims christians jews hindus buddhists sikhs atheists catholics".split(),
    "black white asian latino hispanic african european american indian arab".split(),
    "german french spanish english turkish polish russian chinese mexican".split(),
    "old young blind deaf disabled".split(),
    "frauen männer mädchen jungen".split(),
    "muslime christen juden hindus buddhisten".split(),
    "femmes hommes filles garçons".split(),
    "musulmans chrétiens juifs hindous bouddhistes".split(),
    "mujeres hombres niñas niños".split(),
    "musulmanes cristianos judíos hindúes budistas".split(),
)


@dataclass
class Model:
    """Score = logistic(bias + sum of weights of the features that a text has).

    Where the labelled rows gave it nothing to tell texts apart by (`judges` is false), no score is evidence of anything, and none
    reaches 0.5.
    """

    features: np.ndarray
    weights: np.ndarray
    bias: float
    terms: int = 0

    @property
    def judges(self) -> bool:
        return len(self.features) > 0

    def toxic(self, score: Column, threshold: float = 0.5) -> Column:
        """Whether a text with this score is to be taken as toxic; never by a model that doesn't judge."""
        return score >= threshold if self.judges else F.lit(False)

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        unit, h = _features(Words(data, offsets, LETTERS))
        return _logistic(self.bias + np.bincount(*self._hits(unit, h), minlength=len(offsets) - 1))

    def _hits(self, unit: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        row, col = _known(unit, h, self.features)
        return row, self.weights[col]


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def _features(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """(unit, hash) of every word and word beginning, with repeats."""
    units, hashes = [w.unit], [w.hash]
    length = w.end - w.start
    for n in BEGINNINGS:
        at = np.flatnonzero(length > n)
        units.append(w.unit[at])
        hashes.append(byte_hash(w.data, w.start[at], w.start[at] + n) ^ U(n * 0x9E3779B97F4A7C15 % 2**64))
    return np.concatenate(units), np.concatenate(hashes)


def _known(unit: np.ndarray, h: np.ndarray, features: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(unit, index in features) of each feature of each unit, once."""
    if not len(features):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    sieve = np.zeros(1 << 16, bool)
    sieve[(features >> U(48)).astype(np.int64)] = True
    maybe = np.flatnonzero(sieve[(h >> U(48)).astype(np.int64)])
    at = np.minimum(np.searchsorted(features, h[maybe]), len(features) - 1)
    same = features[at] == h[maybe]
    pair = np.unique(unit[maybe][same] * len(features) + at[same])
    return pair // len(features), pair % len(features)


def _term_features() -> dict[str, np.ndarray]:
    out = {}
    for term in sorted({t for g in IDENTITY for t in g}):
        raw = np.frombuffer(term.encode(), np.uint8)
        out[term] = np.unique(_features(Words(raw, np.array([0, len(raw)]), LETTERS))[1])
    return out


def is_held_out(doc_id: Column) -> Column:
    """Rows that are never learned from."""
    return F.pmod(F.crc32(F.encode(doc_id.cast("string"), "utf-8")), F.lit(5)) == 0


def training_rows(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """(toxic, text) of at most about `sample` labelled documents that aren't held out."""
    ids = labels.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), F.col(f"`{label_col}`").cast("int").alias("toxic"))
    ids = ids.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~is_held_out(F.col("doc_id")))
    chosen = ids.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    texts = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    return texts.join(F.broadcast(chosen), "doc_id").select("toxic", "text")  # at most `sample` pairs of numbers


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, swap: float = SWAP, **columns) -> Model:
    """A model of the labelled rows; without rows of both labels, one that scores all texts alike and rejects none."""
    small_batches(docs.sparkSession)
    rows = staged(training_rows(docs, labels, sample, **columns), "labelled")
    groups = [[t.encode() for t in g] for g in IDENTITY]
    term_features = _term_features()

    def toxic_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, offsets in pieces(batch.column(0)):
                unit, h = _features(Words(data, offsets, LETTERS))
                order = np.lexsort((h, unit))
                unit, h = unit[order], h[order]
                new = np.append(True, (h[1:] != h[:-1]) | (unit[1:] != unit[:-1])) if len(h) else np.empty(0, bool)
                found, count = np.unique(h[new], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(count, pa.int64())], names=["feature", "n"])

    counted = rows.where("toxic > 0").select("text").mapInArrow(toxic_features, "feature bigint, n bigint").groupBy("feature").agg(F.sum("n").alias("n"))
    wide = counted.where(F.col("n") >= LEAST_ROWS).orderBy(F.desc("n"), "feature").limit(TRIED).select("feature").toArrow()
    candidates = np.unique(wide.column(0).to_numpy().view(np.uint64))
    shared = docs.sparkSession.sparkContext.broadcast((candidates, groups))

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, groups = shared.value
        for batch in batches:
            toxic = batch.column(0).to_numpy(zero_copy_only=False)
            for lo, hi, data, offsets in pieces(batch.column(1)):
                w = Words(data, offsets, LETTERS)
                row, col = _known(*_features(w), known)
                cut = np.searchsorted(row, np.arange(hi - lo + 1))
                swaps = []
                for u in range(hi - lo):
                    own = {w.data[w.start[i] : w.end[i]].tobytes() for i in range(w.first[u], w.first[u + 1])}
                    swaps.append([t.decode() for g in groups for t in g if t in own])
                yield pa.RecordBatch.from_arrays([pa.array(toxic[lo:hi], pa.int32()), pa.array([col[a:b].astype(np.uint32).tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)], pa.binary()), pa.array(swaps, pa.list_(pa.string()))], names=["toxic", "features", "terms"])

    got = rows.mapInArrow(vectors, "toxic int, features binary, terms array<string>").toArrow()
    y = (got.column(0).to_numpy() > 0).astype(float)
    cols = [np.frombuffer(x.as_py(), np.uint32).astype(np.int64) for x in got.column(1)]
    if not len(y) or y.min() == y.max():
        return Model(np.empty(0, np.uint64), np.empty(0), NOT_TAUGHT)
    row = np.repeat(np.arange(len(y)), [len(c) for c in cols])
    col = np.concatenate(cols)
    # how far a feature's share of toxic rows is from that of all rows, in standard deviations
    seen, seen_toxic = np.bincount(col, minlength=len(candidates)), np.bincount(col, y[row], minlength=len(candidates))
    base = y.mean()
    z = (seen_toxic - seen * base) / np.sqrt(np.maximum(seen * base * (1 - base), 1e-9))
    best = np.argsort(-np.abs(z), kind="stable")[:FEATURES]
    best = best[np.abs(z[best]) > DEVIATIONS]
    identity = np.unique(np.concatenate(list(term_features.values())))
    chosen = np.unique(np.concatenate([candidates[best], np.intersect1d(identity, candidates)]))
    if not len(chosen):
        return Model(np.empty(0, np.uint64), np.empty(0), NOT_TAUGHT)
    place = np.full(len(candidates), -1)
    inside = np.isin(candidates, chosen)
    place[inside] = np.searchsorted(chosen, candidates[inside])
    keep = place[col] >= 0
    row, col = row[keep], place[col[keep]]
    # differences of features that a swap makes, once for each row and term
    swaps: dict[tuple[int, ...], float] = {}
    for terms in got.column(2).to_pylist():
        for t in terms:
            for g in IDENTITY:
                if t in g:
                    for other in g:
                        gone, new = np.setdiff1d(term_features[t], term_features[other]), np.setdiff1d(term_features[other], term_features[t])
                        delta = tuple([int(-1 - i) for i in np.flatnonzero(np.isin(chosen, gone))] + [int(1 + i) for i in np.flatnonzero(np.isin(chosen, new))])
                        if delta:
                            swaps[delta] = swaps.get(delta, 0.0) + 1.0 / len(g)
    weights, bias = _fit(row, col, y, len(chosen), swaps, swap)
    return Model(chosen, weights, bias, len(swaps))


def _fit(row, col, y, n, swaps, swap) -> tuple[np.ndarray, float]:
    """Newton steps by conjugate gradients on the mean log loss, the ridge and the squared score changes of swaps."""
    deltas = [(np.abs(np.array(d)) - 1, np.sign(np.array(d)), c * swap) for d, c in swaps.items()]
    s_row = np.concatenate([np.full(len(d[0]), i) for i, d in enumerate(deltas)]) if deltas else np.empty(0, np.int64)
    s_col = np.concatenate([d[0] for d in deltas]).astype(np.int64) if deltas else np.empty(0, np.int64)
    s_sign = np.concatenate([d[1] for d in deltas]) if deltas else np.empty(0)
    s_weight = np.array([d[2] for d in deltas])
    share = np.where(y > 0, 0.5 / max(y.sum(), 1), 0.5 / max((1 - y).sum(), 1)) * len(y)

    def forward(v):
        return np.bincount(row, v[col], len(y)) + v[n]

    def back(r):
        return np.append(np.bincount(col, r[row], n), r.sum())

    def ridge(v):
        out = np.append(RIDGE * v[:n], 0.0)
        if deltas:
            change = np.bincount(s_row, s_sign * v[s_col], len(deltas)) * s_weight
            out[:n] += np.bincount(s_col, s_sign * change[s_row], n)
        return out

    w = np.zeros(n + 1)
    for _ in range(25):
        p = _logistic(forward(w))
        grad = back(share * (p - y)) + ridge(w)
        h = share * p * (1 - p) + 1e-6
        step, r = np.zeros(n + 1), -grad
        d, rr = r.copy(), float(r @ r)
        for _ in range(60):
            if rr < 1e-10:
                break
            q = back(h * forward(d)) + ridge(d) + 1e-6 * d
            a = rr / float(d @ q)
            step, r = step + a * d, r - a * q
            new = float(r @ r)
            d, rr = r + new / rr * d, new
        w = w + step
        if np.abs(step).max() < 1e-3:
            break
    return w[:n], float(w[n])


def score(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """(row, score) for every row: all columns in `row`. Null and empty texts get the score of no features."""
    small_batches(docs.sparkSession)
    rows, column = docs.select(F.struct("*").alias("row")), docs.columns.index(text_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = rows.select("row", F.lit(0.0).alias("score")).schema

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [shared.value.score(data, offsets) for _, _, data, offsets in pieces(pc.struct_field(batch.column(0), [column]))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(out) if out else np.empty(0))], names=["row", "score"])

    return rows.mapInArrow(judge, schema)


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The rows of docs that score below the threshold, unchanged; all of them if the labels don't teach what is toxic."""
    model = learn(docs, labels)
    return score(docs, model).where(~model.toxic(F.col("score"), threshold)).select("row.*")
