"""A fixed public vocabulary of word pieces: where its pieces occur in a text, sums and best paths over segmentations."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import chain

import numpy as np

MARK = "▁"  # stands for a space in the vocabulary
DEFAULT_MODEL = "/opt/tokenizers/piece_bpe_32k.model"


def read_vocabulary(path: str = DEFAULT_MODEL) -> tuple[list[str], list[float], list[int]]:
    """Pieces, scores and kinds (0 ordinary, 1 unknown or control, 2 byte) of a vocabulary file; read by the driver."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = range(model.get_piece_size())
    kinds = [2 if model.is_byte(i) else 1 if model.is_control(i) or model.is_unknown(i) else 0 for i in ids]
    return [model.id_to_piece(i) for i in ids], [model.get_score(i) for i in ids], kinds


class Matcher:
    """Every occurrence of every piece in a list of units, by an Aho-Corasick automaton."""

    def __init__(self, pieces: Sequence[str]):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        self.lengths = np.array([len(p) for p in pieces], np.int64)
        for i, p in enumerate(pieces):
            if p:
                self.automaton.add_word(p, i)
        self.automaton.make_automaton()

    def find(self, units: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """unit, start, end (exclusive, in the unit) and piece of each occurrence, by unit and end, longest first.

        Units are searched end to end; an occurrence that crosses units is left out.
        """
        lengths = np.array([len(u) for u in units], np.int64)
        found = np.fromiter(chain.from_iterable(self.automaton.iter("".join(units))), np.int64)
        last, piece = found.reshape(-1, 2).T
        stops = np.cumsum(lengths)
        unit = np.searchsorted(stops, last, "right")
        begin = stops[unit] - lengths[unit]
        end = last + 1 - begin
        start = end - self.lengths[piece]
        inside = start >= 0
        return unit[inside], start[inside], end[inside], piece[inside]


def length_classes(units: Sequence[str], most: int = 1 << 19) -> list[np.ndarray]:
    """Indices of units of like length, so that a table of (units x length) stays small."""
    lengths = np.array([len(u) for u in units], np.int64)
    order = np.argsort(lengths, kind="stable")
    out, at = [], 0
    while at < len(order):
        end = at + 1
        while end < len(order) and lengths[order[end]] <= max(8, 2 * lengths[order[at]]) and (end - at) * lengths[order[end]] < most:
            end += max(1, min(256, len(order) - end - 1))
        end = min(end, len(order))
        out.append(order[at:end])
        at = end
    return out


def with_unknown(
    unit: np.ndarray, start: np.ndarray, end: np.ndarray, piece: np.ndarray, lengths: np.ndarray, unknown: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Add piece ``unknown`` at each character that no piece of one character covers, and sort by end, unit and start."""
    offset = np.cumsum(lengths) - lengths
    single = np.zeros(int(lengths.sum()), bool)
    one = end - start == 1
    single[offset[unit[one]] + start[one]] = True
    bare = np.flatnonzero(~single)
    if len(bare):  # the shortest piece to its end, so the last there
        owner = np.searchsorted(offset + lengths, bare, "right")
        place = bare - offset[owner]
        at = np.searchsorted(offset[unit] + end, bare + 1, "right")
        unit, start = np.insert(unit, at, owner), np.insert(start, at, place)
        end, piece = np.insert(end, at, place + 1), np.insert(piece, at, unknown)
    narrow = end.astype(np.uint16) if lengths.max() < 1 << 16 else end
    order = np.argsort(narrow, kind="stable")  # units and starts are in order already
    return unit[order], start[order], end[order], piece[order]


class Kept:
    """Values of units met lately, of at most about ``size``: two generations, the younger of which holds what was used since."""

    def __init__(self, size: int):
        self.size, self.young, self.old = size, {}, {}

    def missing(self, units: Sequence[str]) -> list[str]:
        """Those of the distinct ``units`` without a value; the others stay for the next look-up."""
        if len(self.young) > self.size // 2:
            self.young, self.old = {}, self.young
        out = []
        for u in units:
            if u not in self.young:
                if u in self.old:
                    self.young[u] = self.old[u]
                else:
                    out.append(u)
        return out
