"""Ranked lexical search of a query set over all documents, by accumulator-limited term-at-a-time evaluation.

Documents stay where they are. A first pass counts, for the terms of the queries, the documents that hold each, and
the size of the corpus. A second pass turns each slice of a task's documents into postings of the query terms and
evaluates every query on them term at a time, rarest term first. A term may create accumulators as long as the
bounds of the terms still to come could lift a new document to the k-th best score so far, in this slice or in the
slices before it; from then on terms only update the accumulators that exist, whose scores end exact. Each task
hands on its k best documents of every query, and two ranked windows take the best of all.

Queries travel in blocks of at most ``BLOCK`` terms (a query with more is a block of its own), so that what is
broadcast stays bounded at any size of the query set; the documents are read twice for each block.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import materialize
from . import kernel as K
from .common import only

#: Characters that end a term, for Spark's and for DuckDB's patterns.
SEPARATORS = r"\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F"
#: Each byte as it counts in a term; separators are blanks.
TERM = np.full(256, 0x20, np.uint8)
TERM[0x80:] = np.arange(0x80, 0x100)
TERM[0x30:0x3A] = np.arange(0x30, 0x3A)
TERM[0x61:0x7B] = np.arange(0x61, 0x7B)
TERM[0x41:0x5B] = np.arange(0x61, 0x7B)
#: Best documents of a query.
BEST = 10
#: Query terms that travel together.
BLOCK = 200_000
#: Bytes of one text that are looked at together.
PIECE = 4_000_000
#: First step of the final ranking: partial ranks of each query.
SPREAD = 32
#: Numbers of the corpus counts among the document counts of the terms.
DOCUMENTS, TERMS = -1, -2


def _eights(buf: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on, as integers."""
    padded = np.zeros(len(buf) + 8, np.uint8)
    padded[: len(buf)] = buf
    return np.ndarray((len(buf) + 1,), "<u8", padded.data, 0, (1,))


class Vocabulary:
    """The terms of a block of queries. Matches are found by hash and then compared byte by byte."""

    def __init__(self, terms: list[str]):
        raw = [t.encode() for t in terms]
        ends = np.cumsum([len(r) for r in raw])
        self.text = K.Texts(np.frombuffer(b"".join(raw), np.uint8), np.r_[0, ends].astype(np.int64))
        hashes = self.text.word_hashes()
        self.order = np.argsort(hashes, kind="stable")
        self.hashes = hashes[self.order]
        if (self.hashes[1:] == self.hashes[:-1]).any():
            raise ValueError("two query terms share a 64-bit hash; search them in separate calls")
        self.size = len(terms)

    def find(self, t: K.Texts) -> tuple[np.ndarray, np.ndarray]:
        """(word, term) of each word that is a term."""
        if not self.size or not len(t.start):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        h = t.word_hashes()
        at = np.minimum(np.searchsorted(self.hashes, h), self.size - 1)
        word = np.flatnonzero(self.hashes[at] == h)
        term = self.order[at[word]]
        here, there, length = t.start[word], self.text.start[term], t.end[word] - t.start[word]
        same = length == self.text.end[term] - there
        mine, theirs = _eights(t.buf), _eights(self.text.buf)
        rest, k = np.flatnonzero(same), 0
        while len(rest):
            mask = K._MASKS[np.minimum(length[rest] - k, 8)]
            equal = mine[here[rest] + k] & mask == theirs[there[rest] + k] & mask
            same[rest[~equal]] = False
            rest, k = rest[equal], k + 8
            rest = rest[length[rest] > k]
        return word[same], term[same]


def _pieces(raw: np.ndarray, offsets: np.ndarray):
    """One very long text in pieces that no term crosses; any other slice whole."""
    if len(offsets) > 2 or len(raw) <= 2 * PIECE:
        yield raw, offsets
        return
    at = 0
    while at < len(raw):
        to = min(at + PIECE, len(raw))
        while to < len(raw):
            cut = TERM[raw[to : to + PIECE]] == 0x20
            if cut.any():
                to += int(cut.argmax())
                break
            to = min(to + PIECE, len(raw))
        yield raw[at:to], np.array([0, to - at], np.int64)
        at = to


def _occurrences(batch: pa.RecordBatch, vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Postings (term, row, tf) in the order of terms, and the number of terms of each row."""
    raw, offsets = K.column_bytes(batch.column("text"))
    n, rows = np.zeros(batch.num_rows, np.int64), batch.num_rows
    keys, counts = [], []
    for piece, cuts in _pieces(raw, offsets):
        t = K.Texts(TERM[piece], cuts)
        n += np.diff(t.first)
        word, term = vocabulary.find(t)
        key, count = np.unique(term * rows + t.doc_of_word()[word], return_counts=True)
        keys.append(key)
        counts.append(count)
    if len(keys) == 1:
        key, tf = keys[0], counts[0]
    else:
        key, where = np.unique(np.concatenate(keys), return_inverse=True)
        tf = np.zeros(len(key), np.int64)
        np.add.at(tf, where, np.concatenate(counts))
    return key // rows, key % rows, tf.astype(np.int64), n


def _statistics(vocabulary):
    """Documents that hold each term, documents with a term, and terms in all, of one task."""

    def run(batches):
        v = vocabulary.value
        df, documents, terms = np.zeros(v.size, np.int64), 0, 0
        for b in K.slices(batches):
            term, _, _, n = _occurrences(b, v)
            df += np.bincount(term, minlength=v.size)
            documents += int((n > 0).sum())
            terms += int(n.sum())
        seen = np.flatnonzero(df)
        yield pa.record_batch({"term": pa.array(np.r_[seen, DOCUMENTS, TERMS], pa.int64()), "n": pa.array(np.r_[df[seen], documents, terms], pa.int64())})

    return run


class Query:
    """One item: its terms, rarest first, and how often it holds each."""

    def __init__(self, item_id: int | None, terms: np.ndarray, times: np.ndarray):
        self.item_id, self.terms, self.times = item_id, terms, times


class Plan:
    """What the second pass needs: vocabulary, weights of the terms, corpus size and queries."""

    def __init__(self, vocabulary: Vocabulary, df: np.ndarray, documents: int, terms: int, queries: list[Query]):
        self.vocabulary, self.documents, self.terms, self.queries = vocabulary, documents, terms, queries
        self.weight = np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * int(d) + 1))) for d in df], np.int64)


class Best:
    """The k best (score, id) so far: higher scores first, then smaller ids, rows without an id last."""

    def __init__(self, k: int):
        self.k = k
        self.score, self.none, self.id = np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64)

    @property
    def least(self) -> int:
        """The score that a further document must at least have."""
        return int(self.score[-1]) if len(self.score) == self.k else 1

    def add(self, score: np.ndarray, none: np.ndarray, ids: np.ndarray) -> None:
        score, none, ids = np.r_[self.score, score], np.r_[self.none, none], np.r_[self.id, ids]
        top = np.lexsort((ids, none, -score))[: self.k]
        self.score, self.none, self.id = score[top], none[top], ids[top]


def evaluate(terms: np.ndarray, times: np.ndarray, start: np.ndarray, row: np.ndarray, part: np.ndarray, most: np.ndarray, rows: int, k: int, least: int) -> np.ndarray:
    """Scores of the rows of one slice for one query; 0 for rows that cannot reach the k best.

    Postings of term t are ``row`` and ``part`` from ``start[t]`` to ``start[t + 1]``, ``most[t]`` its largest part.
    ``terms`` come rarest first. A row gets an accumulator only while the bounds of the terms left are no less than
    the k-th partial score (or than ``least``, the score to beat from elsewhere).
    """
    score = np.zeros(rows, np.int64)
    bound = times * most[terms]
    held = bound > 0
    terms, times, bound = terms[held], times[held], bound[held]
    left = np.cumsum(bound[::-1])[::-1]
    alive = None
    for j, t in enumerate(terms):
        if alive is None:
            goal = least
            if rows >= k and left[j] < left[0] - left[j]:  # else no partial score exceeds what is left
                goal = max(goal, int(np.partition(score, rows - k)[rows - k]))
            if left[j] < goal:
                alive = score > 0
                if not alive.any():
                    break
        at = slice(start[t], start[t + 1])
        if alive is None:
            score[row[at]] += times[j] * part[at]
        else:
            kept = alive[row[at]]
            score[row[at][kept]] += times[j] * part[at][kept]
    return score


def _ranked(plan, k):
    """The k best documents of each query in one task."""

    def run(batches):
        p = plan.value
        best = [Best(k) for _ in p.queries]
        for b in K.slices(batches):
            term, row, tf, n = _occurrences(b, p.vocabulary)
            if not len(term):
                continue
            ids = b.column("doc_id")
            none, ids = np.array(ids.is_null()), ids.fill_null(0).to_numpy()
            m = 25 + (75 * n * p.documents) // p.terms
            part = p.weight[term] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[row]))
            start = np.searchsorted(term, np.arange(p.vocabulary.size + 1))
            most = np.zeros(p.vocabulary.size, np.int64)
            there = np.flatnonzero(start[1:] > start[:-1])
            most[there] = np.maximum.reduceat(part, start[there])
            for q, top in zip(p.queries, best, strict=True):
                score = evaluate(q.terms, q.times, start, row, part, most, b.num_rows, k, top.least)
                goal = top.least
                if b.num_rows > k:
                    goal = max(goal, int(np.partition(score, b.num_rows - k)[b.num_rows - k]))
                hits = np.flatnonzero(score >= goal)
                if len(hits):
                    top.add(score[hits], none[hits], ids[hits])
        size = [len(t.score) for t in best]
        if sum(size):
            yield pa.record_batch(
                {
                    "query": pa.array(np.repeat(np.arange(len(best)), size), pa.int32()),
                    "item_id": pa.array([q.item_id for q, s in zip(p.queries, size, strict=True) for _ in range(s)], pa.int64()),
                    "doc_id": pa.array(np.concatenate([t.id for t in best]), pa.int64(), mask=np.concatenate([t.none for t in best])),
                    "score": pa.array(np.concatenate([t.score for t in best]), pa.int64()),
                }
            )

    return run


def item_terms(items: DataFrame) -> DataFrame:
    """(item_id, digest, term, times): the terms of each distinct item."""
    low = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    terms = F.regexp_extract_all(low, F.lit(f"([^{SEPARATORS}]+)"), F.lit(1))
    one = only(items, item_id="long", text="string").distinct()
    return one.select("item_id", F.xxhash64("text").alias("digest"), F.explode(terms).alias("term")).groupBy("item_id", "digest", "term").agg(F.count(F.lit(1)).alias("times"))


def _block(spark: SparkSession, docs: DataFrame, got: pd.DataFrame, k: int) -> DataFrame:
    terms = sorted(got["term"].unique(), key=str.encode)
    number = {t: i for i, t in enumerate(terms)}
    vocabulary = Vocabulary(terms)
    sent = spark.sparkContext.broadcast(vocabulary)
    counts = docs.select("text").mapInArrow(_statistics(sent), "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toPandas()
    n = dict(zip(counts["term"], counts["n"], strict=True))
    sent.destroy()
    df = np.array([n.get(i, 0) for i in range(len(terms))], np.int64)
    queries = []
    for (item_id, _), one in got.sort_values(["item_id", "digest", "term"]).groupby(["item_id", "digest"], dropna=False, sort=False):
        at = np.array([number[t] for t in one["term"]], np.int64)
        order = np.lexsort((at, df[at]))
        queries.append(Query(None if pd.isna(item_id) else int(item_id), at[order], one["times"].to_numpy(np.int64)[order]))
    plan = spark.sparkContext.broadcast(Plan(vocabulary, df, int(n.get(DOCUMENTS, 0)), int(n.get(TERMS, 0)), queries))
    found = docs.mapInArrow(_ranked(plan, k), "query int, item_id long, doc_id long, score long")
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    salt = F.pmod(F.xxhash64("doc_id"), F.lit(SPREAD))
    found = found.withColumn("rank", F.row_number().over(Window.partitionBy("query", salt).orderBy(*order))).where(F.col("rank") <= k)
    found = found.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(*order))).where(F.col("rank") <= k)
    out = materialize(found.select("item_id", "rank", "doc_id", "score"), "search").df
    plan.destroy()
    return out


def ranked_search(docs: DataFrame, items: DataFrame, k: int = BEST, block: int = BLOCK) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` best rows of ``docs(doc_id, text)`` for each of ``items(item_id, text)``.

    Scores are the integers described in the query's contract. Equal scores rank by ascending doc_id, rows without
    one last. A null, empty or termless text never scores; very long texts are read whole, in pieces that no term
    crosses. Each row of ``docs`` is a document of its own, repeats included. Items that repeat with the same text
    count once; with different texts, each is ranked on its own under the same item_id; a null item_id is kept.
    Items without terms, and an empty table on either side, give no rows. Other columns take no part.
    """
    spark = docs.sparkSession
    docs = only(docs, doc_id="long", text="string")
    terms = materialize(item_terms(items), "search-terms")
    blocks = max(1, math.ceil(terms.rows / block))
    part = F.pmod(F.xxhash64("item_id", "digest"), F.lit(blocks))
    out = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    for b in range(blocks):
        got = terms.df.where(part == b).toPandas()
        if len(got):
            got["item_id"] = got["item_id"].astype("Int64")
            done = _block(spark, docs, got, k)
            out = done if blocks == 1 else out.union(done)
    terms.drop()
    return out
