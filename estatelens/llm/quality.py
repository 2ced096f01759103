"""Quality rules: fixed base rules, and a calibrated classifier of hashed word and character n-grams.

The classifier is logistic regression over the mean weight of three hashed families: words, word pairs and runs of
three bytes. It is fitted on a bounded sample of labelled documents (``SAMPLE`` per class, lowest hashes of the
doc_id); a quarter of the sample, by hash, is held out to calibrate the probability (Platt scaling). Scoring reads
every whole text in Arrow batches; a document is kept at a calibrated probability of ``KEEP`` or more.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel as K
from .common import only

#: Labelled documents per class that the fit reads.
SAMPLE = 2000
#: Slots of each family of features.
SLOTS = 1 << 16
FAMILIES = 3
#: Calibrated probability of good quality from which a document is kept.
KEEP = 0.5
MIN_WORDS = 50
#: A text fails when so many per cent of its words lie in repeated windows of three words.
MOST_REPEATED = 50
EPOCHS, RATE, RIDGE = 150, 0.2, 1e-6
#: Features that the fit looks at together.
PART = 1 << 18
SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True


def hashed_features(t: K.Texts, words: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(slot of each feature, first feature of each document) of each family, in text order."""
    slot = lambda h: (h >> K.U64(40)).astype(np.int64) % SLOTS
    pairs, valid = t.windows(words, 2)
    pair_first = np.minimum(t.first, len(pairs))
    count = np.r_[0, np.cumsum(valid)]
    b = t.buf.astype(np.uint64)
    grams = b[:-2] | b[1:-1] << K.U64(8) | b[2:] << K.U64(16) if len(b) > 2 else b[:0]
    inside = np.ones(len(grams), bool)
    for back in (1, 2):
        cut = t.offsets[1:-1] - back
        inside[cut[(cut >= 0) & (cut < len(grams))]] = False
    at = np.r_[0, np.cumsum(inside)]
    return [
        (slot(words), t.first),
        (slot(pairs[valid]) + SLOTS, count[pair_first]),
        (slot(K.mix(grams[inside])) + 2 * SLOTS, at[np.minimum(t.offsets, len(grams))]),
    ]


def _sampled_features(batches):
    """Distinct slots of each document with their shares of their family."""
    for b in K.slices(batches):
        t = K.texts(b)
        families = hashed_features(t, t.word_hashes())
        slots, shares = [], []
        for d in range(t.n):
            s, v = [], []
            for slot, first in families:
                u, c = np.unique(slot[first[d] : first[d + 1]], return_counts=True)
                s.append(u)
                v.append(c / max(1, c.sum()))
            slots.append(np.concatenate(s).astype(np.int32))
            shares.append(np.concatenate(v).astype(np.float32))
        yield pa.record_batch(
            {"doc_id": b.column("doc_id"), "good": b.column("good"), "slots": pa.array(slots, pa.list_(pa.int32())), "shares": pa.array(shares, pa.list_(pa.float32()))}
        )


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


class Model:
    """Weights, and the scale and shift that calibrate the score."""

    def __init__(self, weights: np.ndarray, bias: float, scale: float = 1.0, shift: float = 0.0):
        self.weights, self.bias, self.scale, self.shift = weights.astype(np.float32), bias, scale, shift

    def probability(self, score: np.ndarray) -> np.ndarray:
        return _sigmoid(self.scale * score + self.shift)

    def scores(self, t: K.Texts, words: np.ndarray) -> np.ndarray:
        total = np.full(t.n, self.bias)
        for slot, first in hashed_features(t, words):
            n = np.diff(first)
            total += K.sums(self.weights[slot].astype(np.float64), first) / np.maximum(n, 1)
        return total


def _adam(grad, x: np.ndarray, steps: int, rate: float) -> np.ndarray:
    m, v = np.zeros_like(x), np.zeros_like(x)
    for k in range(1, steps + 1):
        g = grad(x)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        x = x - rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-9)
    return x


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model | None:
    """Fit and calibrate on at most ``2 * sample`` labelled documents; None when a class is missing.

    Conflicting labels of one doc_id count as bad; null labels and ids take no part.
    """
    labels = only(labels, doc_id="long", quality="int").where("doc_id is not null and quality is not null")
    labels = labels.groupBy("doc_id").agg(F.min((F.col("quality") > 0).cast("int")).alias("good"))
    drawn = [labels.where(F.col("good") == g).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample) for g in (0, 1)]
    chosen = F.broadcast(drawn[0].union(drawn[1]))  # 2 * sample rows at most
    got = docs.join(chosen, "doc_id").mapInArrow(_sampled_features, "doc_id long, good int, slots array<int>, shares array<float>").toArrow()
    if not got.num_rows or len(set(got.column("good").to_pylist())) < 2:
        return None
    got = got.combine_chunks()
    got = got.take(np.argsort(got.column("doc_id").to_numpy(), kind="stable"))
    ids, y = got.column("doc_id").to_numpy(), got.column("good").to_numpy().astype(float)
    slots, shares = got.column("slots").combine_chunks(), got.column("shares").combine_chunks()
    first = slots.offsets.to_numpy().astype(np.int64)
    col, val = slots.values.to_numpy(), shares.values.to_numpy()
    cuts = np.unique(np.r_[0, np.searchsorted(first, np.arange(PART, first[-1], PART)), len(y)])
    parts = list(zip(cuts[:-1], cuts[1:], strict=True))  # documents with about PART features
    held = K.mix(ids.astype(K.U64)) % K.U64(4) == 0
    if len(set(y[held])) < 2 or len(set(y[~held])) < 2:
        held = np.zeros(len(y), bool)
    used = ~held
    weight = np.where(used, np.where(y > 0, 0.5 / max(1, y[used].sum()), 0.5 / max(1, (1 - y[used]).sum())), 0.0)
    dims = FAMILIES * SLOTS

    def score(x):
        out = np.full(len(y), x[-1])
        for a, e in parts:
            at = slice(first[a], first[e])
            out[a:e] += K.sums(x[col[at]] * val[at], first[a : e + 1] - first[a])
        return out

    def grad(x):
        err = weight * (_sigmoid(score(x)) - y)
        out = RIDGE * x
        out[-1] = err.sum()
        for a, e in parts:
            at = slice(first[a], first[e])
            out[:-1] += np.bincount(col[at], np.repeat(err[a:e], np.diff(first[a : e + 1])) * val[at], dims)
        return out

    x = _adam(grad, np.zeros(dims + 1), EPOCHS, RATE)
    model = Model(x[:-1], float(x[-1]))
    if held.any():
        s, h = score(x)[held], y[held]
        good, bad = h.sum(), (1 - h).sum()
        target = np.where(h > 0, (good + 1) / (good + 2), 1 / (bad + 2))
        w = np.where(h > 0, 0.5 / good, 0.5 / bad)

        def slope(ab):
            err = w * (_sigmoid(ab[0] * s + ab[1]) - target)
            return np.array([(err * s).sum(), err.sum()])

        model.scale, model.shift = map(float, _adam(slope, np.array([1.0, 0.0]), 400, 0.05))
    return model


def _repeat_words(windows: np.ndarray, n: int) -> int:
    """Words of a document of ``n`` words that lie in three-word windows which occur twice or more."""
    if len(windows) < 2:
        return 0
    order = np.argsort(windows, kind="stable")
    s = windows[order]
    same = s[1:] == s[:-1]
    again = order[np.r_[same, False] | np.r_[False, same]]
    cover = np.zeros(n, bool)
    for k in range(3):
        cover[again + k] = True
    return int(cover.sum())


def _rules(model):
    def run(batches):
        for b in K.slices(batches):
            t = K.texts(b)
            words = t.word_hashes()
            n_words = np.diff(t.first)
            lead = (t.buf & 0xC0) != 0x80
            triples, _ = t.windows(words, 3)
            raw, lines, repeats = t.buf.tobytes(), [], []
            for d in range(t.n):
                kept = [x for x in raw[t.offsets[d] : t.offsets[d + 1]].split(b"\n") if x.strip()]
                lines.append(len(kept) - len(set(kept)))
                a, e = t.first[d], t.first[d + 1]
                repeats.append(_repeat_words(triples[a : max(a, e - 2)], e - a))
            repeats = np.array(repeats, np.int64)
            failed = (n_words < MIN_WORDS) | (100 * repeats > MOST_REPEATED * n_words)
            good = model.value.probability(model.value.scores(t, words)) if model.value else np.ones(t.n)
            yield pa.record_batch(
                {
                    "doc_id": b.column("doc_id"),
                    "digest": pa.array([hashlib.md5(raw[x:y]).hexdigest() for x, y in zip(t.offsets[:-1], t.offsets[1:], strict=True)], pa.string()),
                    "n_words": pa.array(n_words, pa.int64()),
                    "word_chars": K.sums((lead & t.inside).astype(np.int64), t.offsets),
                    "n_symbols": K.sums(SYMBOLS[t.buf].astype(np.int64), t.offsets),
                    "n_dup_lines": pa.array(lines, pa.int64()),
                    "n_repeat_words": repeats,
                    "base_failed": failed,
                    "probability": good,
                    "kept": ~failed & (good >= KEEP),
                }
            )

    return run


SCHEMA = "doc_id long, digest string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, probability double, kept boolean"


def quality_rules(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Base counts, base verdict, calibrated probability and verdict of each row of ``docs(doc_id, text)``.

    ``labels(doc_id, quality)`` trains the classifier; without labelled documents of both classes only the base rules
    decide. ``digest`` is the md5 of the text, by which rows of one doc_id with several texts can be told apart. A null text has no words and fails the base rules. Rows repeat as they are in the input, a null doc_id
    included. Other columns take no part. An empty table gives no rows.
    """
    docs = only(docs, doc_id="long", text="string")
    model = fit(docs.where("doc_id is not null"), labels, sample)
    pa.default_memory_pool().release_unused()  # the sample is gone; the driver's memory goes back
    return docs.mapInArrow(_rules(docs.sparkSession.sparkContext.broadcast(model)), SCHEMA)
