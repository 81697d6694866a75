"""A SentencePiece vocabulary as plain lists, ready to be sent to the executors."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import cached_property
from itertools import chain

import ahocorasick
import numpy as np
import sentencepiece

#: Where a text may be cut without changing any segmentation: no piece holds a space after another character, and a line
#: break is in no piece.
SEGMENTS = re.compile(" *[^ \n]+|\n| +")
MODEL = "/opt/tokenizers/piece_bpe_32k.model"


@dataclass(frozen=True)
class Vocabulary:
    """pieces: (text with spaces, id, score) of the ordinary pieces; bytes_: the ids of the 256 byte pieces."""

    pieces: tuple[tuple[str, int, float], ...]
    byte_ids: tuple[int, ...]
    unknown_score: float
    size: int
    key: str = field(default="")

    @cached_property
    def automaton(self) -> ahocorasick.Automaton:
        found = ahocorasick.Automaton()
        for text, i, score in self.pieces:
            found.add_word(text, (len(text), i, score))
        found.make_automaton()
        return found

    @cached_property
    def id_automaton(self) -> ahocorasick.Automaton:
        """As automaton, of the pieces of two or more characters, with bare ids for matches."""
        found = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for text, i, _ in self.pieces:
            if len(text) > 1:
                found.add_word(text, i)
        found.make_automaton()
        return found

    @cached_property
    def characters(self) -> np.ndarray:
        """The id of the piece that is one character, by code point, or -1; the last place stands for all greater code points."""
        single = {ord(text): i for text, i, _ in self.pieces if len(text) == 1}
        found = np.full(max(single, default=0) + 2, -1, np.int32)
        found[list(single)] = list(single.values())
        return found

    def matches(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """(place of the last character, id) of each piece in the text: those of several characters by place, the longest of one place
        first, then all of one character by place."""
        known = self.id_automaton.kind == ahocorasick.AHOCORASICK
        flat = np.fromiter(chain.from_iterable(self.id_automaton.iter(text)) if known else (), np.int32).reshape(-1, 2)
        points = np.frombuffer(text.encode("utf-32-le"), "<u4")
        single = self.characters[np.minimum(points, len(self.characters) - 1)]
        at = np.flatnonzero(single >= 0)
        return np.concatenate([flat[:, 0], at.astype(np.int32)]), np.concatenate([flat[:, 1], single[at]])

    @cached_property
    def ring(self) -> int:
        """The least power of two that is greater than the characters of the longest piece."""
        return 1 << max(len(text) for text, _, _ in self.pieces).bit_length()

    @cached_property
    def piece_bytes(self) -> list[bytes]:
        out = [b""] * self.size
        for text, i, _ in self.pieces:
            out[i] = text.encode()
        for b, i in enumerate(self.byte_ids):
            out[i] = bytes([b])
        return out


def load_vocabulary(path: str = MODEL, floor: float = -50_000.0) -> Vocabulary:
    """The pieces of a model file with a space prefix, identity normalisation and byte fallback. Its scores are read as
    unigram log weights, those below `floor` as that: pieces that the model never makes have -1e9, which leaves no digits for the
    rest of a sum. An unknown character has the least score less 10, as in the library."""
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    n = sp.get_piece_size()
    ordinary = [i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
    pieces = tuple((sp.id_to_piece(i).replace("▁", " "), i, max(sp.get_score(i), floor)) for i in ordinary)
    if any(" " in p.lstrip(" ") or "\n" in p for p, _, _ in pieces):
        raise ValueError("a piece holds a space after another character, or a line break")
    if not sp.is_byte(sp.piece_to_id("<0x00>")):
        raise ValueError("the model has no byte pieces")
    byte_ids = tuple(sp.piece_to_id(f"<0x{b:02X}>") for b in range(256))
    return Vocabulary(pieces, byte_ids, min(s for _, _, s in pieces) - 10, n, path)
