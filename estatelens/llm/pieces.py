"""SentencePiece model files: pieces, scores, and the units into which a text may be cut."""

from __future__ import annotations

import re
import struct

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
#: The unknown character costs so much more than the worst piece (fixed value of the format).
UNKNOWN_PENALTY = 10.0


def _fields(raw: bytes):
    """(field number, value) of one protocol-buffer message."""

    def varint(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            value |= (raw[at] & 127) << shift
            at, shift = at + 1, shift + 7
            if raw[at - 1] < 128:
                return value, at

    at = 0
    while at < len(raw):
        tag, at = varint(at)
        kind = tag & 7
        if kind == 0:
            value, at = varint(at)
        elif kind == 2:
            size, at = varint(at)
            value, at = raw[at : at + size], at + size
        else:
            size = 8 if kind == 1 else 4
            value, at = raw[at : at + size], at + size
        yield tag >> 3, value


class Pieces:
    """A model's vocabulary, read as a unigram lattice: a text's pieces are those with the highest sum of scores.

    Of equal sums the one whose last piece starts first wins, and so on to the front. A character without a piece
    costs the worst score less UNKNOWN_PENALTY and is written as its UTF-8 bytes.
    """

    def __init__(self, raw: bytes):
        self.pieces, self.scores, self.types = [], [], []
        for field, value in _fields(raw):
            if field == 1:
                own = dict(_fields(value))
                self.pieces.append(own.get(1, b"").decode())
                self.scores.append(struct.unpack("<f", own[2])[0] if 2 in own else 0.0)
                self.types.append(own.get(3, NORMAL))
        real = [i for i, t in enumerate(self.types) if t in (NORMAL, USER)]
        #: piece -> (id, score) of the pieces that can match text
        self.match = {self.pieces[i]: (i, self.scores[i]) for i in reversed(real)}
        self.byte = {int(p[1:-1], 16): i for i, (p, t) in enumerate(zip(self.pieces, self.types, strict=True)) if t == BYTE}
        self.unknown = next((i for i, t in enumerate(self.types) if t == UNKNOWN), 0)
        self.unknown_score = min((self.scores[i] for i in real), default=0.0) - UNKNOWN_PENALTY
        if any(SPACE in p.lstrip(SPACE) for p in self.match):
            raise ValueError("a piece goes on after a space mark: units cannot be cut there")
        many = set("".join(p for p in self.match if len(p) > 1))
        alone = "".join(c for c in "\n\r\t" if c not in many)
        self._unit = re.compile(f"{SPACE}*[^{SPACE}{alone}]+|{SPACE}+" + (f"|[{alone}]" if alone else ""))

    @classmethod
    def load(cls, path: str = MODEL) -> Pieces:
        with open(path, "rb") as f:
            return cls(f.read())

    def units(self, text: str) -> list[str]:
        """Parts of a text that no piece crosses. The text gets a leading space mark, as the format asks."""
        return self._unit.findall(SPACE + text.replace(" ", SPACE)) if text else []

    def unknown_ids(self, char: str) -> list[int]:
        """Ids of a character without a piece."""
        return [self.byte[b] for b in char.encode()] if len(self.byte) == 256 else [self.unknown]
