"""SentencePiece encoding and decoding by a batched Viterbi search in numpy.

The units of a batch that the task has not met yet are sorted by length, and units of equal length advance together:
rolling hashes of all their substrings probe the sorted keys of the pieces, and the best score at each position is a
maximum over piece lengths, whose winner is stored as a backpointer. Sums are exact in double precision for the
integer scores of the models here.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import kernel as K
from .common import only
from .pieces import BYTE, MODEL, NORMAL, SPACE, USER, Pieces

#: Units that a task remembers before it starts over.
REMEMBERED = 800_000
#: Cells of a group's lattice that are held at a time.
CELLS = 1_000_000
_BASE = K.U64(0x9E3779B97F4A7C55)
_FILTER_BITS = 20


class Encoder:
    """Encodes units, and remembers them, for one model in one worker."""

    def __init__(self, model: Pieces):
        self.model = model
        self.longest = max(map(len, model.match), default=0)
        keys = np.array([self._key(p) for p in model.match], K.U64)
        order = np.argsort(keys)
        self.keys = keys[order]
        if len(np.unique(self.keys)) != len(keys):
            raise ValueError("two pieces have one hash")
        self.ids = np.array([i for i, _ in model.match.values()], np.int32)[order]
        self.scores = np.array([s for _, s in model.match.values()], np.float64)[order]
        self.maybe = np.zeros(1 << _FILTER_BITS, bool)
        self.maybe[self.keys >> K.U64(64 - _FILTER_BITS)] = True
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.flat, self.size = np.zeros(1 << 16, np.int32), 0
        self.start = np.zeros(1, np.int64)

    def _key(self, piece: str) -> np.uint64:
        h = np.zeros(1, K.U64)
        for c in piece:
            h = h * _BASE + K.U64(ord(c) + 1)
        return K.mix(h ^ K.U64(len(piece)))[0]

    def _group(self, chars: np.ndarray) -> list[np.ndarray]:
        """Piece ids of equally long units; a character without a piece is ``-1 - code point``."""
        n_units, n = chars.shape
        most = min(self.longest, n)
        code = chars.T.astype(K.U64) + K.U64(1)  # by position, so that each step reads one run of memory
        score, which = [None], [None]
        h = np.zeros((n + 1, n_units), K.U64)
        for size in range(1, most + 1):
            h = h[: n - size + 1] * _BASE + code[size - 1 :]
            key = K.mix(h ^ K.U64(size)).ravel()
            at = np.flatnonzero(self.maybe[key >> K.U64(64 - _FILTER_BITS)])
            found = np.minimum(np.searchsorted(self.keys, key[at]), len(self.keys) - 1)
            hit = self.keys[found] == key[at]
            s, w = np.full(key.shape, -np.inf), np.zeros(key.shape, np.int64)
            s[at[hit]], w[at[hit]] = self.scores[found[hit]], self.ids[found[hit]]
            s, w = s.reshape(h.shape), w.reshape(h.shape)
            if size == 1:
                none = s == -np.inf
                s[none], w[none] = self.model.unknown_score, -1 - chars.T[none].astype(np.int64)
            score.append(s)
            which.append(w)
        best = np.zeros((n + 1, n_units))
        back = np.zeros((n + 1, n_units), np.int16)
        piece = np.zeros((n + 1, n_units), np.int64)
        units = np.arange(n_units)
        for end in range(1, n + 1):
            sizes = range(min(end, most), 0, -1)  # earliest start first: of equal sums argmax takes the first
            sums = np.stack([best[end - size] + score[size][end - size] for size in sizes])
            pick = sums.argmax(axis=0)
            best[end], back[end] = sums[pick, units], sizes[0] - pick
            piece[end] = np.stack([which[size][end - size] for size in sizes])[pick, units]
        out, count, at = np.zeros((n_units, n), np.int64), np.zeros(n_units, np.int64), np.full(n_units, n)
        rows = units
        while len(rows):
            out[rows, count[rows]] = piece[at[rows], rows]
            count[rows] += 1
            at[rows] -= back[at[rows], rows]
            rows = rows[at[rows] > 0]
        return [out[i, : count[i]][::-1] for i in range(n_units)]

    def _learn(self, units: list[str]) -> None:
        """Encode new units, which are already numbered, in their order."""
        if not units:
            return
        lengths = np.array([len(u) for u in units])
        results: list = [None] * len(units)
        for n in np.unique(lengths):
            members = np.flatnonzero(lengths == n)
            step = max(1, CELLS // int(n * min(n, self.longest)))
            for k in range(0, len(members), step):
                part = members[k : k + step]
                joined = "".join([units[i] for i in part]).encode("utf-32-le", "surrogatepass")
                for i, ids in zip(part, self._group(np.frombuffer(joined, np.uint32).reshape(len(part), n)), strict=True):
                    if ids.min() < 0:
                        ids = np.array([y for x in ids for y in (self.model.unknown_ids(chr(-1 - x)) if x < 0 else (x,))])
                    results[i] = ids
        sizes = np.array([len(r) for r in results])
        need = self.size + int(sizes.sum())
        if need > len(self.flat):
            self.flat = np.concatenate([self.flat[: self.size], np.zeros(max(need, 2 * self.size) - self.size, np.int32)])
        self.flat[self.size : need] = np.concatenate(results)
        self.start = np.concatenate([self.start, self.size + np.cumsum(sizes)])
        self.size = need

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after the other, and where each text's begin."""
        if len(self.known) > REMEMBERED:
            self.clear()
        known, before, number, counts = self.known, len(self.known), [], []
        for text in texts:
            units = self.model.units(text)
            counts.append(len(units))
            number += [known.setdefault(u, len(known)) for u in units]
        self._learn(list(known)[before:] if len(known) > before else [])
        number = np.array(number, np.int64)
        size = self.start[number + 1] - self.start[number]
        ends = np.cumsum(size)
        flat = self.flat[np.repeat(self.start[number] - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)]
        edges = np.r_[0, ends][np.r_[0, np.cumsum(counts)].astype(np.int64)]
        return flat, edges


class Decoder:
    """Texts of id sequences: the inverse of the encoder for texts without the space mark itself."""

    def __init__(self, model: Pieces):
        parts = []
        for p, t in zip(model.pieces, model.types, strict=True):
            real = t in (NORMAL, USER)
            parts.append(p.replace(SPACE, " ").encode() if real else bytes([int(p[1:-1], 16)]) if t == BYTE else b"")
        self.size = np.array([len(p) for p in parts])
        self.end = np.cumsum(self.size)
        self.bytes = np.frombuffer(b"".join(parts), np.uint8)

    def decode(self, flat: np.ndarray, edges: np.ndarray) -> list[bytes]:
        size = self.size[flat]
        ends = np.cumsum(size)
        raw = self.bytes[np.repeat(self.end[flat] - ends, size) + np.arange(ends[-1] if len(ends) else 0)].tobytes()
        at = np.r_[0, ends][edges]
        out = [raw[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]
        return [x[1:] if x[:1] == b" " else x for x in out]


_last: list[tuple[tuple, Encoder]] = []


def encoder(model: Pieces) -> Encoder:
    """The worker's encoder of a model; it outlives the task, and so do the units it remembers."""
    key = (tuple(model.pieces), tuple(model.scores))
    if not _last or _last[0][0] != key:
        _last[:] = [(key, Encoder(model))]
    return _last[0][1]


def _encode(model):
    def run(batches):
        enc, dec = encoder(model.value), Decoder(model.value)
        for b in K.slices(batches):
            texts = b.column("text").to_pylist()
            flat, edges = enc.encode([x or "" for x in texts])
            back = dec.decode(flat, edges)
            ids = pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(flat, pa.int32()))
            yield pa.record_batch(
                {
                    "doc_id": b.column("doc_id"),
                    "ids": ids,
                    "exact": pa.array([x is None or x.encode() == y for x, y in zip(texts, back, strict=True)]),
                }
            )

    return run


def encode(docs: DataFrame, model_path: str = MODEL) -> DataFrame:
    """(doc_id, ids, exact) of each row of ``docs(doc_id, text)``; ``exact`` says that decoding gives the text again.

    A null or empty text has no ids. A text that holds the space mark U+2581 itself decodes to spaces, as the format
    has it, and is not exact. Rows repeat as they are in the input. Other columns take no part; an empty table gives
    no rows. The driver reads the model file; tasks get its pieces.
    """
    docs = only(docs, doc_id="long", text="string")
    model = docs.sparkSession.sparkContext.broadcast(Pieces.load(model_path))
    return docs.mapInArrow(_encode(model), "doc_id long, ids array<int>, exact boolean")


def _decode(model):
    def run(batches):
        dec = Decoder(model.value)
        for b in batches:
            for k in range(0, b.num_rows, 512):
                part = b.slice(k, 512)
                ids = part.column("ids").fill_null([])
                flat = ids.flatten().fill_null(0).to_numpy(zero_copy_only=False)
                edges = ids.offsets.to_numpy().astype(np.int64)
                texts = dec.decode(flat, edges - edges[0])
                yield pa.record_batch({"doc_id": part.column("doc_id"), "text": pa.array([x.decode("utf-8", "replace") for x in texts], pa.string())})

    return run


def decode(encoded: DataFrame, model_path: str = MODEL) -> DataFrame:
    """(doc_id, text) of each row of ``encoded(doc_id, ids)``.

    Null ids give an empty text; ids of control pieces and nulls within ids give nothing; bytes that are no UTF-8
    become U+FFFD.
    """
    encoded = only(encoded, doc_id="long", ids="array<int>")
    model = encoded.sparkSession.sparkContext.broadcast(Pieces.load(model_path))
    return encoded.mapInArrow(_decode(model), "doc_id long, text string")
