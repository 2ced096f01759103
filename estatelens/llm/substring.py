"""Substring deduplication by fixed-block anchors.

A window is ``WINDOW`` = 13 consecutive words. Each document is cut into non-overlapping reference blocks of
``BLOCK`` = 7 words; any window of 13 words holds a whole block of its document. The blocks are the index, and every
rolling 7-word window of every document probes it. A probe that meets a block of another document is an anchor. From
an anchor the repeat is extended word by word while the rolling windows go on to occur in other documents; the 13-word
windows that fit into it are then compared exactly. Maximal repeats come out as runs of equal windows: a repeat of
L >= 13 words is L - 12 of them.

Index and probes travel as packed hash arrays, dealt by hash slice, so that sorting in numpy replaces a row for each
word. Equal windows within a task are combined before they are sent. Which probes were anchors, and which occur in
several documents, comes back as two filters of a fixed number of bits (``FILTER_BITS``); their false positives only
add windows to the exact comparison, which is a minimum per window and a join whose hot keys AQE splits.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from . import kernel as K
from .common import IdFilter, only

WINDOW, BLOCK = 13, 7
#: Size of each of the two filters; 8 MB at any data size.
FILTER_BITS = 1 << 26
#: Text bytes whose hashes meet in one slice.
SLICE_BYTES = 16_000_000
#: Text bytes that a task packs at a time.
PACK_BYTES = 6_000_000
_LOW = (1 << 48) - 1


def _slice_of(h: np.ndarray, n: int) -> np.ndarray:
    return ((h >> K.U64(48)) * K.U64(n) >> K.U64(16)).astype(np.int64)


def _bits_of(h: np.ndarray, per_slice: int) -> tuple[np.ndarray, np.ndarray]:
    low = h & K.U64(_LOW & ~3)
    return (K.mix(low) % K.U64(per_slice)).astype(np.int64), (K.mix(low ^ K.U64(0xA5A5A5A5A5A4)) % K.U64(per_slice)).astype(np.int64)


def _probes(t: K.Texts) -> tuple[np.ndarray, np.ndarray]:
    """Rolling windows of BLOCK words, valid or not, and whether each is a reference block."""
    h, valid = t.windows(t.word_hashes(), BLOCK)
    place = np.arange(len(h)) - np.repeat(t.first[:-1], np.diff(t.first))[: len(h)]
    return h, valid, valid & (place % BLOCK == 0)


def _combined(h: np.ndarray, flag: np.ndarray) -> np.ndarray:
    """Sorted different hashes; the low bits say: bit 0, a block; bit 1, seen in several documents."""
    order = np.argsort(h, kind="stable")
    h, flag = h[order], flag[order]
    new = np.r_[True, h[1:] != h[:-1]]
    at = np.flatnonzero(new)
    block = np.bitwise_or.reduceat(flag & K.U64(1), at)
    several = np.bitwise_or.reduceat(flag & K.U64(2), at) | (np.diff(np.r_[at, len(h)]) > 1).astype(K.U64) * K.U64(2)
    return h[at] | block | several


def _packed(heads, n_slices: int):
    """Packed probes and blocks of each hash slice: one row per slice and PACK_BYTES of text."""

    def run(batches):
        for b in K.slices(batches, PACK_BYTES):
            b = b.filter(pa.array(heads.value(b.column("doc_id").to_numpy())))
            if not b.num_rows:
                continue
            t = K.texts(b)
            h, valid, block = _probes(t)
            flag, parts = block.astype(K.U64), []
            for d in range(t.n):  # once for each document, so that its own repeats do not count
                a, e = t.first[d], min(t.first[d + 1], len(h))
                own, f = h[a:e][valid[a:e]] & ~K.U64(3), flag[a:e][valid[a:e]]
                if len(own):
                    s = _combined(own, f)
                    parts.append(s & ~K.U64(2))
            if not parts:
                continue
            all_ = np.concatenate(parts)
            s = _combined(all_ & ~K.U64(3), all_ & K.U64(3))
            cuts = np.searchsorted(_slice_of(s, n_slices), np.arange(n_slices + 1))
            raw = s.view(np.uint8).reshape(-1, 8)[:, :6]
            full = np.flatnonzero(np.diff(cuts))
            yield pa.record_batch({"slice": full.astype(np.int32), "packed": pa.array([raw[cuts[i] : cuts[i + 1]].tobytes() for i in full], pa.binary())})

    return run


def _filters(per_slice: int):
    """The part of both filters that belongs to one slice."""

    def bits(hits: np.ndarray) -> bytes:
        out = np.zeros(per_slice // 8, np.uint8)
        for at in _bits_of(hits, per_slice):
            np.bitwise_or.at(out, at >> 3, np.left_shift(1, at & 7).astype(np.uint8))
        return out.tobytes()

    def run(group: pa.Table) -> pa.Table:
        raw = np.frombuffer(b"".join(group.column("packed").to_pylist()), np.uint8).reshape(-1, 6)
        h = np.zeros((len(raw), 8), np.uint8)
        h[:, :6] = raw
        h = np.sort(h.view(K.U64).ravel())
        s = _combined(h & ~K.U64(3), h & K.U64(3))
        anchors, several = bits(s[(s & K.U64(3)) == 3]), bits(s[(s & K.U64(2)) == 2])
        part = pa.array(group.column("slice")[:1].to_pylist(), pa.int32())
        return pa.table({"slice": part, "anchors": pa.array([anchors], pa.binary()), "several": pa.array([several], pa.binary())})

    return run


def _candidates(heads, filters, n_slices: int, per_slice: int):
    """(w, c, doc_id): 13-word windows of repeats around an anchor; w and c are two hashes of the window."""

    def run(batches):
        for b in K.slices(batches):
            b = b.filter(pa.array(heads.value(b.column("doc_id").to_numpy())))
            if not b.num_rows:
                continue
            t = K.texts(b)
            words = t.word_hashes()
            h, valid = t.windows(words, BLOCK)
            base = _slice_of(h, n_slices) * per_slice
            places = [at + base for at in _bits_of(h, per_slice)]
            anchor, several = (
                np.r_[0, np.cumsum(valid & np.logical_and.reduce([(bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1 for at in places]))]
                for bits in filters.value
            )
            w, whole = t.windows(words, WINDOW)
            if not len(w):
                continue
            span = WINDOW - BLOCK + 1  # blocks' places in a window
            start = np.arange(len(w))
            take = np.flatnonzero(whole & (anchor[start + span] > anchor[start]) & (several[start + span] - several[start] == span))
            c = t.windows(words[::-1] * K.U64(0x9E3779B97F4A7C15), WINDOW)[0][::-1]
            ids = b.column("doc_id").to_numpy()[t.doc_of_word()[take]]
            yield pa.record_batch({"w": w[take].view(np.int64), "c": (c[take] >> K.U64(32)).astype(np.uint32).view(np.int32), "doc_id": ids})

    return run


def _kept(batches):
    """Words that stay, and the removed spans, of documents joined with their removed windows."""
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    for b in K.slices(batches):
        t = K.texts(b)
        w, whole = t.windows(t.word_hashes(), WINDOW)
        copies, removed = b.column("copy").to_pylist(), b.column("removed")
        raw, n_words, n_removed, kept, spans = t.buf.tobytes(), [], [], [], []
        for d in range(t.n):
            a, e = t.first[d], t.first[d + 1]
            gone = np.zeros(e - a + 1, np.int64)
            if e - a >= WINDOW:
                if copies[d]:
                    gone[0] += 1
                    gone[-1] -= 1
                elif removed[d].is_valid:
                    own = np.flatnonzero(np.isin(w[a : e - WINDOW + 1].view(np.int64), removed[d].values.to_numpy(zero_copy_only=False)))
                    np.add.at(gone, own, 1)
                    np.add.at(gone, own + WINDOW, -1)
            gone = np.cumsum(gone)[:-1] > 0
            words = raw[t.offsets[d] : t.offsets[d + 1]].split()
            edge = np.flatnonzero(np.diff(np.r_[False, gone, False].astype(np.int8)))
            n_words.append(e - a)
            n_removed.append(int(gone.sum()))
            kept.append(b" ".join([x for x, g in zip(words, gone, strict=True) if not g] if len(edge) else words).decode())
            spans.append([{"start": int(x), "end": int(y)} for x, y in edge.reshape(-1, 2)])
        yield pa.record_batch(
            {
                "doc_id": b.column("doc_id"),
                "n_words": pa.array(n_words, pa.int64()),
                "n_removed": pa.array(n_removed, pa.int64()),
                "kept": pa.array(kept, pa.string()),
                "removed": pa.array(spans, span),
            }
        )


def repeated_windows(docs: DataFrame, heads: DataFrame) -> DataFrame:
    """(doc_id, w): windows of the ``heads`` that also start in a head with a smaller doc_id."""
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_slices = min(1 << 16, max(8, -(-size // SLICE_BYTES)))
    per_slice = FILTER_BITS // n_slices // 8 * 8
    wanted = spark.sparkContext.broadcast(IdFilter(heads, "doc_id"))
    packed = docs.mapInArrow(_packed(wanted, n_slices), "slice int, packed binary")
    parts = packed.groupBy("slice").applyInArrow(_filters(per_slice), "slice int, anchors binary, several binary")
    parts = materialize(parts, "substring-filters")
    filters = np.zeros((2, n_slices * per_slice // 8), np.uint8)
    for row in parts.df.toLocalIterator():  # 2 * FILTER_BITS at most
        at = row["slice"] * per_slice // 8
        for bits, name in zip(filters, ("anchors", "several"), strict=True):
            bits[at : at + per_slice // 8] = np.frombuffer(row[name], np.uint8)
    parts.drop()
    filters = spark.sparkContext.broadcast(filters)
    rows = materialize(docs.mapInArrow(_candidates(wanted, filters, n_slices, per_slice), "w long, c int, doc_id long"), "substring-windows").df
    first = rows.groupBy("w", "c").agg(F.min("doc_id").alias("_a"), F.max("doc_id").alias("_b")).where("_a < _b")
    first = materialize(first.select("w", "c", "_a"), "substring-first").df  # its own table, so that AQE can split hot windows
    return materialize(rows.join(first, ["w", "c"]).where("doc_id > _a").select("doc_id", "w"), "substring-removed").df


def substring_dedup(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_removed, kept, removed) of each row of ``docs(doc_id, text)``.

    A word goes if it lies in a window of 13 words that also starts in a document with a smaller doc_id; windows are
    judged on the input. ``kept`` has the other words joined by one space, ``removed`` the word spans that went (end
    exclusive). Exact copies of a text are settled by their digest: all words of later copies go, if they are 13 or more.
    A null text has no words. Texts of fewer than 13 words stay whole. A repeated doc_id is not smaller than itself:
    its rows do not remove each other's words. Rows with a null doc_id are left out. Other columns take no part; an
    empty table gives no rows.
    """
    docs = only(docs, doc_id="long", text="string").where("doc_id is not null")
    member = docs.select("doc_id", F.md5(F.col("text").cast("binary")).alias("key")).where("key is not null")
    head = member.groupBy("key").agg(F.min("doc_id").alias("head"), F.count(F.lit(1)).alias("n")).where("n > 1")
    head = materialize(head.select("key", "head"), "substring-heads").df
    keyed = member.join(head, "key", "left").withColumn("head", F.coalesce("head", "doc_id"))
    keyed = materialize(keyed, "substring-copies").df
    removed = repeated_windows(docs, keyed.select(F.col("head").alias("doc_id")).distinct())
    removed = removed.groupBy("doc_id").agg(F.collect_set("w").alias("removed"))  # at most the windows of one document
    later = keyed.where("head < doc_id").groupBy("doc_id").agg(F.collect_set("key").alias("copies"))
    joined = docs.join(removed.join(later, "doc_id", "full"), "doc_id", "left")
    copy = F.coalesce(F.array_contains("copies", F.md5(F.col("text").cast("binary"))), F.lit(False))
    joined = joined.select("doc_id", "text", copy.alias("copy"), "removed")
    return joined.mapInArrow(_kept, "doc_id long, n_words long, n_removed long, kept string, removed array<struct<start:long,end:long>>")
