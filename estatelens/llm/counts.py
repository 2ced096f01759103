"""Token counts without tokens: a count-only Viterbi search over Aho-Corasick matches.

The automaton of the vocabulary lists all pieces that end at each position of a unit, longest first. The search
carries only the best score and its number of pieces. Of equal scores the earliest start of the last piece wins, as
in the encoder, so the count is the length of the encoding.
"""

from __future__ import annotations

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from . import kernel as K
from .common import only
from .pieces import MODEL, Pieces

#: Units whose counts a worker remembers before it starts over.
REMEMBERED = 800_000


class Counter:
    def __init__(self, model: Pieces):
        self.model, self.known = model, {}
        self.automaton = ahocorasick.Automaton()
        for piece, (_, score) in model.match.items():
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.single = {p for p in model.match if len(p) == 1}

    def count(self, unit: str) -> int:
        """Pieces of the best segmentation of a unit."""
        n = len(unit)
        best, pieces = [float("-inf")] * (n + 1), [0] * (n + 1)
        best[0] = 0.0
        if self.single.issuperset(unit):  # every position is reached by a match
            for last, (size, score) in self.automaton.iter(unit):
                got = best[last + 1 - size] + score
                if got > best[last + 1]:
                    best[last + 1], pieces[last + 1] = got, pieces[last + 1 - size] + 1
            return pieces[n]
        ending: list[list] = [[] for _ in range(n)]
        for last, match in self.automaton.iter(unit):
            ending[last].append(match)
        for end in range(1, n + 1):
            steps = [(size, score, 1) for size, score in ending[end - 1]]
            if unit[end - 1] not in self.single:
                steps.append((1, self.model.unknown_score, len(self.model.unknown_ids(unit[end - 1]))))
            for size, score, n_ids in steps:
                got = best[end - size] + score
                if got > best[end]:
                    best[end], pieces[end] = got, pieces[end - size] + n_ids
        return pieces[n]

    def text(self, text: str) -> int:
        known, total = self.known, 0
        if len(known) > REMEMBERED:
            known.clear()
        for unit in self.model.units(text):
            n = known.get(unit)
            if n is None:
                n = known[unit] = self.count(unit)
            total += n
        return total


_last: list[tuple[tuple, Counter]] = []


def counter(model: Pieces) -> Counter:
    """The worker's counter of a model; it outlives the task."""
    key = (tuple(model.pieces), tuple(model.scores))
    if not _last or _last[0][0] != key:
        _last[:] = [(key, Counter(model))]
    return _last[0][1]


def _count(model):
    def run(batches):
        c = counter(model.value)
        for b in K.slices(batches):
            texts = b.column("text").to_pylist()
            yield pa.record_batch(
                {
                    "doc_id": b.column("doc_id"),
                    "n_chars": pa.array([len(x or "") for x in texts], pa.int64()),
                    "n_tokens": pa.array([c.text(x) if x else 0 for x in texts], pa.int64()),
                }
            )

    return run


def token_counts(docs: DataFrame, model_path: str = MODEL) -> DataFrame:
    """(doc_id, n_chars, n_tokens) of each row of ``docs(doc_id, text)``.

    A null or empty text counts nothing. Rows repeat as they are in the input. Other columns take no part; an empty
    table gives no rows.
    """
    docs = only(docs, doc_id="long", text="string")
    model = docs.sparkSession.sparkContext.broadcast(Pieces.load(model_path))
    return docs.mapInArrow(_count(model), "doc_id long, n_chars long, n_tokens long")
