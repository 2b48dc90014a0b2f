"""Reading level of each document.

Every sentence's level is classified by two regularised multinomial models, one on character n-grams and one on words
and length; the sentences' distributions are averaged over a document and calibrated on labelled documents.
The models are fitted on a bounded sample of the labelled documents and travel to the tasks; all documents are
then levelled in one narrow stage, whole texts each.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from talliflow.session import spread

#: Labelled documents that the models are fitted on, at most; they are drawn by a hash of their ids.
MAX_LABELLED = 1_500
#: Sentences of one labelled document that enter the fit, at most, evenly spread, and characters of one of them. They are cut out by the tasks, so
#: what comes to the driver is bounded. All sentences of all documents are used, whole, for levelling.
FIT_SENTENCES, FIT_CHARS = 20, 4_000
#: Hashed features of each model.
DIM = 1 << 15
#: Strength of the penalty on squared weights, steps and step length of the fit.
PENALTY, STEPS, RATE = 1e-6, 50, 0.3
#: Labelled documents from which a calibration is fitted; with fewer the mean distributions stand as they are.
CALIBRATE_FROM = 30
#: Characters that one pass of the kernel takes at most, about.
CHUNK_CHARS = 2_000_000

_HEADER = re.compile(r"^\s*\[\d[^\]\n]*\] [^:\n]{1,60}: ", re.M)
_BREAK = re.compile(r"(?<=[.!?…])[\"'»”)]*\s+|\s*[\r\n]+\s*")
_BULLET = re.compile(r"^[\s*•\-–#>]+")
_MIX = np.uint64(0x9E3779B97F4A7C15)


def sentences(text: str) -> list[str]:
    """The sentences of a text, without the headers of chat messages and bullets; none of a blank text."""
    parts = (s if s[:1].isalnum() else _BULLET.sub("", s) for s in _BREAK.split(_HEADER.sub("", text)))
    return [s for s in parts if any(c.isalnum() for c in s)]


def fit_sentences(text: str | None) -> list[str]:
    """The sentences of a labelled text that enter the fit."""
    found = sentences(text or "")
    if len(found) > FIT_SENTENCES:
        found = [found[round(j * (len(found) - 1) / (FIT_SENTENCES - 1))] for j in range(FIT_SENTENCES)]
    return [x[:FIT_CHARS] for x in found]


def _hash(x: np.ndarray) -> np.ndarray:
    x = (x.astype(np.uint64, copy=False) + np.uint64(1)) * _MIX
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x >>= np.uint64(32)
    x &= np.uint64(DIM - 1)
    return x.astype(np.int32)


class Features(NamedTuple):
    """Hashed features of sentences: ``index`` and the bounds of each sentence's part of it."""

    index: np.ndarray
    bounds: np.ndarray


class Codes(NamedTuple):
    """Code points of texts in a row, each in lower case with two blanks before and one behind, and where each ends."""

    points: np.ndarray
    ends: np.ndarray

    @classmethod
    def of(cls, texts: list[str]) -> Codes:
        low = [f"  {t.lower()} " for t in texts]
        points = np.frombuffer(("".join(low) + "   ").encode("utf-32-le", "surrogatepass"), np.uint32)
        return cls(points, np.cumsum(np.fromiter((len(t) for t in low), np.int64, len(low))))

    @property
    def starts(self) -> np.ndarray:
        return np.concatenate([[0], self.ends[:-1]])


def _grams(codes: Codes) -> tuple[np.ndarray, np.ndarray]:
    """Hashed character 3- and 4-grams at every place; digits are alike. The last places of a text reach into the next one and stand for fewer grams."""
    cp = codes.points.astype(np.uint64)
    cp[(cp >= 48) & (cp <= 57)] = 48
    three = (cp[:-3] << np.uint64(42)) + (cp[1:-2] << np.uint64(21)) + cp[2:-1]
    four = three * np.uint64(0x100000001B3)
    four += cp[3:]
    return _hash(three), _hash(four)


def char_features(codes: Codes) -> Features:
    """Character 3- and 4-grams of each text."""
    (three, four), ends = _grams(codes), codes.ends
    keep3, keep4 = np.ones(len(three), bool), np.ones(len(four), bool)
    for k in (1, 2):
        keep3[ends - k] = False
    for k in (1, 2, 3):
        keep4[ends - k] = False
    owner = np.repeat(np.arange(len(ends), dtype=np.int32), np.diff(ends, prepend=0))
    return _features(np.concatenate([three[keep3], four[keep4]]), np.concatenate([owner[keep3], owner[keep4]]), len(ends))


def char_means(weights: np.ndarray, codes: Codes) -> np.ndarray:
    """Mean weights of each text's grams, a column per class: what :func:`_means` gives of :func:`char_features`, without sorting them."""
    (three, four), ends, starts = _grams(codes), codes.ends, codes.starts
    n = np.maximum(2 * (ends - starts) - 5, 1)
    out = np.empty((len(ends), weights.shape[1]))
    for c, w in enumerate(weights.T):
        both, last = w[three], w[four]
        for k in (1, 2, 3):
            last[ends - k] = 0.0
        for k in (1, 2):
            both[ends - k] = 0.0
        both += last
        out[:, c] = np.add.reduceat(both, starts) / n
    return out


_CLASSES: np.ndarray | None = None


def _classes() -> np.ndarray:
    """For each code point 1 if it is part of a word, 2 if it is a digit, else 0."""
    global _CLASSES
    if _CLASSES is None:
        _CLASSES = np.array([2 if c.isdecimal() else 1 if c.isalnum() else 0 for c in map(chr, range(0x110000))], np.uint8)
    return _CLASSES


def _words(codes: Codes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashed words and their texts; then of each text two classes, of its number of words and their mean length, and how often these count.

    Numbers are words that are alike. The lengths weigh as much as a quarter of the words.
    """
    kind = _classes()[codes.points]
    new = np.flatnonzero((kind > 0) & (kind != np.concatenate([[0], kind[:-1]])))
    n_texts = len(codes.ends)
    if not len(new):
        none = np.zeros(0, np.int32)
        index, owner, size = none, none, none
    else:
        # a polynomial in the code points; characters between words have no part in it
        start = np.repeat(new, np.diff(new, append=len(kind)))
        powers = np.full(int(np.diff(new, append=len(kind)).max()) + 1, 0x100000001B3, np.uint64)
        powers[0] = 1
        powers = np.multiply.accumulate(powers)
        own = kind[new[0] :] > 0
        terms = np.where(own, (codes.points[new[0] :].astype(np.uint64) + np.uint64(7)) * powers[np.arange(new[0], len(kind)) - start], np.uint64(0))
        digits = kind[new] == 2
        index = _hash(np.where(digits, np.uint64(0), np.add.reduceat(terms, new - new[0])))
        size = np.where(digits, 1, np.add.reduceat(own.astype(np.int32), new - new[0]))
        owner = np.searchsorted(codes.ends, new, "right").astype(np.int32)
    n = np.bincount(owner, minlength=n_texts)
    mean = np.bincount(owner, size, n_texts) / np.maximum(n, 1)
    long = _hash(np.uint64(1 << 60) + np.minimum(n // 3, 20).astype(np.uint64))
    wide = _hash(np.uint64(2 << 60) + np.minimum((mean * 2).astype(np.int64), 30).astype(np.uint64))
    return index, owner, long, wide, 1 + n // 8


def word_features(codes: Codes) -> Features:
    """Words of each text and, as classes, how many they are and how long."""
    index, owner, long, wide, times = _words(codes)
    each = np.repeat(np.arange(len(times), dtype=np.int32), times)
    return _features(np.concatenate([index, long[each], wide[each]]), np.concatenate([owner, each, each]), len(times))


def word_means(weights: np.ndarray, codes: Codes) -> np.ndarray:
    """What :func:`_means` gives of :func:`word_features`."""
    index, owner, long, wide, times = _words(codes)
    n = np.bincount(owner, minlength=len(times)) + 2 * times
    out = np.empty((len(times), weights.shape[1]))
    for c, w in enumerate(weights.T):
        out[:, c] = (np.bincount(owner, w[index], len(times)) + times * (w[long] + w[wide])) / n
    return out


def _features(index: np.ndarray, owner: np.ndarray, n: int) -> Features:
    return Features(index[np.argsort(owner, kind="stable")], np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=n))]))


def _means(weights: np.ndarray, f: Features) -> np.ndarray:
    """Mean weights of each sentence's features, a column per class."""
    n = np.maximum(np.diff(f.bounds), 1)
    out = np.empty((len(n), weights.shape[1]))
    for c in range(weights.shape[1]):
        total = np.concatenate([[0.0], np.cumsum(weights[f.index, c])])
        out[:, c] = (total[f.bounds[1:]] - total[f.bounds[:-1]]) / n
    return out


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


class Model(NamedTuple):
    weights: np.ndarray
    bias: np.ndarray


def fit(f: Features, wanted: np.ndarray, weight: np.ndarray) -> Model:
    """Multinomial model of distributions ``wanted``, by Adam on the whole sample."""
    n = np.maximum(np.diff(f.bounds), 1)
    row = np.repeat(np.arange(len(n)), np.diff(f.bounds))
    share = (weight / weight.sum() / n)[row]
    classes = wanted.shape[1]
    index, starts = f.index.astype(np.intp), f.bounds[:-1]  # every text has features
    w, b = np.zeros((DIM, classes)), np.log(np.maximum((wanted * weight[:, None]).sum(0) / weight.sum(), 1e-3))
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, STEPS + 1):
        means = np.stack([np.add.reduceat(np.ascontiguousarray(w[:, c])[index], starts) for c in range(classes)], 1) / n[:, None]
        error = _softmax(means + b) - wanted
        g = np.stack([np.bincount(index, error[row, c] * share, DIM) for c in range(classes)], 1) + PENALTY * w
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w -= RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return Model(w, b)


class Leveller(NamedTuple):
    """Both sentence models, the levels in order and the calibration of documents' mean distributions."""

    levels: list[int]
    chars: Model
    words: Model
    slope: np.ndarray
    shift: np.ndarray

    def document_means(self, texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """Mean sentence distribution of each text, given by its sentences, and the number of sentences."""
        means = np.zeros((len(texts), len(self.levels)))
        counts = np.zeros(len(texts), np.int64)
        chunk: list[str] = []
        owner: list[int] = []
        size = 0

        def flush() -> None:
            if chunk:
                codes = Codes.of(chunk)
                p = (_softmax(char_means(self.chars.weights, codes) + self.chars.bias) + _softmax(word_means(self.words.weights, codes) + self.words.bias)) / 2
                np.add.at(means, owner, p)
                np.add.at(counts, owner, 1)
                chunk.clear()
                owner.clear()

        for i, t in enumerate(texts):
            for s in t:
                chunk.append(s)
                owner.append(i)
                size += len(s)
                if size > CHUNK_CHARS:
                    flush()
                    size = 0
        flush()
        return means / np.maximum(counts, 1)[:, None], counts

    def calibrated(self, means: np.ndarray) -> np.ndarray:
        return _softmax(np.log(np.maximum(means, 1e-4)) @ self.slope + self.shift)


def calibrate(means: np.ndarray, wanted: np.ndarray, steps: int = 400) -> tuple[np.ndarray, np.ndarray]:
    """A small regularised multinomial map from log mean distributions to documents' labels."""
    k = wanted.shape[1]
    x = np.log(np.maximum(means, 1e-4))
    slope, shift = np.eye(k), np.zeros(k)
    for _ in range(steps):
        e = _softmax(x @ slope + shift) - wanted
        slope -= 0.05 * (x.T @ e / len(x) + 0.01 * (slope - np.eye(k)))
        shift -= 0.05 * (e.mean(0) + 0.01 * shift)
    return slope, shift


def train(texts: list[list[str]], labels: list[dict[int, float]]) -> Leveller | None:
    """Models from labelled texts, given by sentences; ``labels`` are shares of raters by level. None if no text has a sentence.

    Models are fitted on either half of the documents; each half calibrates the models of the other, so the calibration sees documents as
    new as all others are. The final models are the mean of both halves'.
    """
    levels = sorted({k for x in labels for k in x})
    found = [s for t in texts for s in t]
    of = [i for i, t in enumerate(texts) for _ in t]
    if not found:
        return None
    target = np.array([[x.get(k, 0.0) for k in levels] for x in labels])
    owner = np.array(of)
    weight = 1 / np.sqrt(np.bincount(owner, minlength=len(texts)))[owner]

    def models(rows: np.ndarray) -> tuple[Model, Model]:
        part = Codes.of([found[i] for i in np.flatnonzero(rows)])
        return fit(char_features(part), target[owner[rows]], weight[rows]), fit(word_features(part), target[owner[rows]], weight[rows])

    half = owner % 2 == 0
    k = len(levels)
    means, keep = np.zeros((len(texts), k)), np.zeros(len(texts), bool)
    pairs = []
    for rows, side in ((half, 1), (~half, 0)):
        if not rows.any():
            continue
        pairs.append(models(rows))
        one = Leveller(levels, *pairs[-1], np.eye(k), np.zeros(k))
        other = list(range(side, len(texts), 2))
        got, n = one.document_means([texts[i] for i in other])
        means[other], keep[other] = got, n > 0
    slope, shift = calibrate(means[keep], target[keep]) if keep.sum() >= CALIBRATE_FROM else (np.eye(k), np.zeros(k))
    # the mean of linear models has the mean of their weights
    chars, words = (Model(np.mean([m.weights for m in ms], 0), np.mean([m.bias for m in ms], 0)) for ms in zip(*pairs))
    chars = Model(chars.weights.astype(np.float32), chars.bias)
    return Leveller(levels, chars, words, slope, shift)


@F.pandas_udf(T.ArrayType(T.StringType()))
def _fit_sentences(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in batches:
        yield s.map(fit_sentences)


def labelled_sample(documents: DataFrame, labels: DataFrame, most: int = MAX_LABELLED) -> tuple[list[list[str]], list[dict[int, float]]]:
    """Sentences and rater shares of at most ``most`` labelled documents."""
    shares = labels.where("doc_id is not null and reading_level is not null").groupBy("doc_id", "reading_level").agg(F.count("*").alias("k"))
    by_doc = shares.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("reading_level", "k"))).alias("raters"))
    chosen = by_doc.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    rows = documents.select("doc_id", "text").where("text is not null").join(chosen, "doc_id")
    rows = rows.select("doc_id", "raters", _fit_sentences("text").alias("sentences")).limit(2 * most).collect()
    rows.sort(key=lambda r: r["doc_id"])
    return [r["sentences"] for r in rows], [{a: n / sum(r["raters"].values()) for a, n in r["raters"].items()} for r in rows]


def reading_levels(documents: DataFrame, labels: DataFrame, most: int = MAX_LABELLED) -> DataFrame:
    """``doc_id, level, difficulty, n_sentences`` of every document.

    ``level`` is the likeliest level, ``difficulty`` the mean of the levels by their calibrated probabilities. Null and blank texts, texts without a
    letter or digit, and all texts where nothing is labelled have nulls. Repeated texts get the same level.
    """
    leveller = train(*labelled_sample(documents, labels, most))
    schema = "doc_id bigint, level int, difficulty double, n_sentences int"
    if leveller is None:
        return documents.select(
            "doc_id", F.lit(None).cast("int").alias("level"), F.lit(None).cast("double").alias("difficulty"), F.lit(None).cast("int").alias("n_sentences")
        )
    scale = np.array(leveller.levels, float)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            means, n = leveller.document_means([sentences(t) if t else [] for t in batch.column(1).to_pylist()])
            p = leveller.calibrated(means)
            none = n == 0
            level = pa.array(scale[p.argmax(1)].astype(np.int32), mask=none)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), level, pa.array(p @ scale, mask=none), pa.array(n.astype(np.int32), mask=none)], ["doc_id", "level", "difficulty", "n_sentences"]
            )

    return spread(documents.select(F.col("doc_id").cast("bigint"), "text")).mapInArrow(run, schema)
