"""Token ids packed into fixed rows by best-fit decreasing, and their binary form.

Documents are dealt into shards of bounded size by a hash of their id. Within a shard the texts are tokenised (byte
pair encoding), each document is followed by an end mark, documents longer than a row are cut into full rows and a
remainder without losing a token, and the pieces, longest first, go to the fullest row that still has room. A segment
tree over capacities finds that row in logarithmic time. A packed row carries its ids as little-endian integers, the
cumulative lengths of its segments, the document and token offset of each segment, and the places where positions
start over.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import only

RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the published split pattern of this vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Ids of a packed row.
ROW = 2048
#: Text bytes of a shard.
SHARD_BYTES = 8_000_000
#: Words whose ids a worker remembers before it starts over.
REMEMBERED = 800_000
SCHEMA = "shard long, row int, n_tokens int, ids binary, cu_seqlens array<int>, doc_ids array<long>, offsets array<long>, resets array<int>"


class Capacities:
    """Segment tree over capacities 0..n: which free capacities exist, to find the least that is large enough."""

    def __init__(self, n: int):
        self.size = 1 << n.bit_length()
        self.count = [0] * (2 * self.size)

    def add(self, capacity: int, step: int = 1) -> None:
        node = self.size + capacity
        while node:
            self.count[node] += step
            node >>= 1

    def least(self, need: int) -> int:
        """Smallest capacity of ``need`` or more that exists, or -1."""
        node = self.size + need
        if self.count[node]:
            return need
        while node > 1:
            if not node & 1 and self.count[node + 1]:
                node += 1
                while node < self.size:
                    node = 2 * node if self.count[2 * node] else 2 * node + 1
                return node - self.size
            node >>= 1
        return -1


def best_fit_decreasing(lengths: list[int], row: int) -> list[list[int]]:
    """Rows of piece numbers; every length is at most ``row``. Equal lengths keep their order."""
    rows: list[list[int]] = []
    free: list[list[int]] = [[] for _ in range(row + 1)]
    tree = Capacities(row)
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        room = tree.least(lengths[i])
        if room < 0:
            at, room = len(rows), row
            rows.append([])
        else:
            at = free[room].pop()
            tree.add(room, -1)
        rows[at].append(i)
        left = room - lengths[i]
        if left:
            free[left].append(at)
            tree.add(left)
    return rows


class Tokens:
    """Byte pair encoding with remembered words.

    The split pattern never joins across a single space between two other characters, so a text may be cut before
    each such space and the parts encoded on their own.
    """

    _cut = re.compile(r"(?<=\S) (?=\S)")

    def __init__(self, ranks: dict[bytes, int]):
        self.encoding = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.flat, self.start, self.size = np.zeros(1 << 16, np.uint16), [0], 0

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.known) > REMEMBERED:
            self.clear()
        known, before, number, counts = self.known, len(self.known), [], []
        for text in texts:
            if "  " in text or "\n" in text or "\t" in text:
                parts = self._cut.sub("\0 ", text).split("\0") if "\0" not in text else [text]
            else:
                parts = text.split(" ")
                parts[1:] = [" " + p for p in parts[1:]]
            counts.append(len(parts))
            number += [known.setdefault(p, len(known)) for p in parts]
        fresh = list(known)[before:] if len(known) > before else []
        if fresh:
            ids = [self.encoding.encode_ordinary(p) for p in fresh]
            sizes = np.array([len(x) for x in ids])
            need = self.size + int(sizes.sum())
            if need > len(self.flat):
                self.flat = np.concatenate([self.flat[: self.size], np.zeros(max(need, 2 * self.size) - self.size, np.uint16)])
            self.flat[self.size : need] = [y for x in ids for y in x]
            self.start = np.concatenate([self.start, self.size + np.cumsum(sizes)])
            self.size = need
        number, start = np.array(number, np.int64), np.asarray(self.start)
        size = start[number + 1] - start[number]
        ends = np.cumsum(size)
        flat = self.flat[np.repeat(start[number] - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)]
        edges = np.r_[0, ends][np.cumsum(counts)] if counts else []
        return np.split(flat, edges[:-1]) if counts else []


_last: list[tuple[str, Tokens]] = []


def _tokens(name: str, ranks: dict[bytes, int]) -> Tokens:
    """The worker's tokeniser of the vocabulary ``name``; it outlives the task, and goes when another one is asked for."""
    if not _last or _last[0][0] != name:
        _last[:] = [(name, Tokens(ranks))]
    return _last[0][1]


def pack(ids: list[np.ndarray], names: list[int], row: int) -> list[dict]:
    """Packed rows of id sequences named by their documents."""
    pieces = [(d, at) for d, x in enumerate(ids) for at in range(0, len(x), row)]
    lengths = [min(row, len(ids[d]) - at) for d, at in pieces]
    out = []
    for members in best_fit_decreasing(lengths, row):
        ends = np.cumsum([lengths[i] for i in members])
        out.append(
            {
                "n_tokens": int(ends[-1]),
                "ids": np.concatenate([ids[pieces[i][0]][pieces[i][1] : pieces[i][1] + lengths[i]] for i in members]).astype("<u2").tobytes(),
                "cu_seqlens": [0, *ends.tolist()],
                "doc_ids": [names[pieces[i][0]] for i in members],
                "offsets": [pieces[i][1] for i in members],
                "resets": [0, *ends[:-1].tolist()],
            }
        )
    return out


def _pack_shard(name: str, ranks, end: int, row: int) -> Callable:
    schema = pa.schema(
        [("shard", pa.int64()), ("row", pa.int32()), ("n_tokens", pa.int32()), ("ids", pa.binary()), ("cu_seqlens", pa.list_(pa.int32())),
         ("doc_ids", pa.list_(pa.int64())), ("offsets", pa.list_(pa.int64())), ("resets", pa.list_(pa.int32()))]
    )

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by([("doc_id", "ascending"), ("text", "ascending")])
        tokens, mark = _tokens(name, ranks.value), np.array([end], np.uint16)
        texts = group.column("text").to_pylist()
        ids = [np.r_[x, mark] for k in range(0, len(texts), 1000) for x in tokens.encode(texts[k : k + 1000])]
        shard = group.column("shard")[0].as_py()
        rows = pack(ids, group.column("doc_id").to_pylist(), row)
        return pa.Table.from_pylist([{"shard": shard, "row": i, **r} for i, r in enumerate(rows)], schema)

    return run


def packed_tokens(docs: DataFrame, ranks_path: str = RANKS, row: int = ROW, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Packed rows of ``docs(doc_id, text)``: shard, row, n_tokens, ids, cu_seqlens, doc_ids, offsets, resets.

    A null text reads as empty and an empty text is its end mark alone. Rows with a null doc_id keep it. Repeated rows
    are packed each. Other columns take no part; an empty table gives no rows. ``offsets`` are the token offsets of
    the segments in their documents, so that :func:`unpacked` restores every document.
    """
    docs = only(docs, doc_id="long", text="string").withColumn("text", F.coalesce("text", F.lit("")))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(1, -(-size // shard_bytes))
    spark = docs.sparkSession
    with open(ranks_path, "rb") as f:
        raw = f.read()
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines())}
    end = max(ranks.values()) + 1  # the end mark follows the vocabulary
    if end > 0xFFFF:
        raise ValueError(f"{end + 1} ids do not fit two bytes")
    dealt = docs.withColumn("shard", F.pmod(F.xxhash64("doc_id", "text"), F.lit(shards)))
    return dealt.groupBy("shard").applyInArrow(_pack_shard(hashlib.sha256(raw).hexdigest(), spark.sparkContext.broadcast(ranks), end, row), SCHEMA)


def unpacked(packed: DataFrame) -> DataFrame:
    """(doc_id, offset, ids) of the segments of packed rows: the inverse of the packing, piece by piece."""

    def run(batches):
        for b in batches:
            out: dict[str, list] = {"doc_id": [], "offset": [], "ids": []}
            for r in b.to_pylist():
                ids = np.frombuffer(r["ids"], "<u2").astype(np.int32)
                for name, at, x, y in zip(r["doc_ids"], r["offsets"], r["cu_seqlens"][:-1], r["cu_seqlens"][1:], strict=True):
                    out["doc_id"].append(name)
                    out["offset"].append(at)
                    out["ids"].append(ids[x:y])
            yield pa.record_batch(out, pa.schema([("doc_id", pa.int64()), ("offset", pa.int64()), ("ids", pa.list_(pa.int32()))]))

    return packed.select("ids", "doc_ids", "offsets", "cu_seqlens").mapInArrow(run, "doc_id long, offset long, ids array<int>")
