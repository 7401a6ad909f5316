"""Texts cut, at places where no token can cross, into pieces; each distinct piece is encoded once while it is remembered."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: A space beside other white space is no safe place to cut.
_UNSAFE = re.compile(r"\s | \s|^ | $")
_SAFE_CUT = re.compile(r"(?<=\S) (?=\S)")
#: Distinct pieces that a worker remembers; then it starts afresh.
REMEMBERED = 900_000
#: What a piece is like: ends with no letter or number, begins with a comma or full stop, begins with a space, is a line
#: end, or has white space at an end (or nothing at all) so that it may not stand alone.
ENDS_OTHER, BEGINS_STOP, BEGINS_SPACE, LINE_END, BAD = 1, 2, 4, 8, 16


def cut(text: str) -> list[str]:
    """Pieces of the text without the single spaces between them; each but the first is preceded by a space."""
    own = text.split(" ")
    if own == text.split():  # no white space but single spaces between words
        return own
    return _SAFE_CUT.split(text) if _UNSAFE.search(text) else own


def cut_spaced(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Distinct pieces, which of them make up the texts in a row, and how many each text has.

    Texts are cut before spaces, commas and full stops and around line ends: for patterns that let a space begin a word, and
    part words, numbers and other signs. PieceTable.documents() finds texts in which such a place is none to cut at, and
    cuts them by spaces alone.
    """
    for sign in (" ", ",", "."):
        texts = pc.replace_substring(texts, sign, "\0" + sign)
    own = pc.split_pattern(pc.replace_substring(texts, "\n", "\0\n\0"), "\0")
    found = own.flatten().dictionary_encode()
    return found.dictionary.to_numpy(zero_copy_only=False).tolist(), np.asarray(found.indices), np.asarray(pc.list_value_length(own)).astype(np.int64)


def code_points(pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all pieces in a row, and where each piece ends in them."""
    return np.frombuffer("".join(pieces).encode("utf-32-le"), "<u4"), np.cumsum(np.fromiter(map(len, pieces), np.int64, len(pieces)))


def _are(test: Callable[[str], bool], codes: np.ndarray) -> np.ndarray:
    """The test of each character; distinct ones are tested once."""
    table = np.zeros(int(codes.max(initial=0)) + 1, bool)
    for c in np.flatnonzero(np.bincount(codes)).tolist():
        table[c] = test(chr(c))
    return table[codes]


def kinds(codes: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The kind of each piece, from code_points()."""
    sizes = np.diff(ends, prepend=0)
    out = np.full(len(ends), BAD, np.uint8)
    some = np.flatnonzero(sizes)
    first, last, sizes = codes[(ends - sizes)[some]], codes[ends[some] - 1], sizes[some]
    spaced = first == ord(" ")
    core = np.where(spaced & (sizes > 1), codes[np.minimum(ends[some] - sizes + 1, len(codes) - 1)], first)
    good = ~_are(str.isspace, core) & ~_are(str.isspace, last)
    kind = ENDS_OTHER * ~_are(str.isalnum, last) | BEGINS_STOP * (~spaced & ((core == ord(",")) | (core == ord(".")))) | BEGINS_SPACE * spaced
    out[some] = np.where(good, kind, np.where((sizes == 1) & (first == ord("\n")), LINE_END | ENDS_OTHER, BAD))
    return out


class PieceTable:
    """Ids of pieces: a flat array, and a slice of it for each piece.

    encode: distinct pieces to ids of each, or to all ids in a row, where each piece's begin, and their numbers.
    """

    def __init__(self, encode: Callable[[list[str]], Sequence[Sequence[int]] | tuple], remembered: int = REMEMBERED):
        self.encode, self.remembered, self.spaced = encode, remembered, False
        self.clear()

    def clear(self) -> None:
        self.index: dict[str, int] = {}
        self.flat, self.used = np.empty(1 << 16, np.uint32), 0
        self.starts, self.counts, self.kinds = np.empty(1 << 14, np.int32), np.empty(1 << 14, np.int32), np.empty(1 << 14, np.uint8)

    def _room(self, pieces: int, ids: int) -> None:
        while len(self.flat) < self.used + ids:
            self.flat = np.concatenate((self.flat, np.empty_like(self.flat)))
        while len(self.starts) < len(self.index) + pieces:
            self.starts, self.counts, self.kinds = (np.concatenate((x, np.empty_like(x))) for x in (self.starts, self.counts, self.kinds))

    def _learn(self, new: list[str]) -> None:
        got = self.encode(new)
        if isinstance(got, tuple):
            flat, starts, counts = got
        else:
            counts = np.fromiter(map(len, got), np.int64, len(got))
            starts = np.cumsum(counts) - counts
            flat = np.fromiter((x for y in got for x in y), np.uint32, int(counts.sum()))
        self._room(len(new), len(flat))
        at = len(self.index)
        self.starts[at : at + len(new)], self.counts[at : at + len(new)] = starts + self.used, counts
        if self.spaced:
            self.kinds[at : at + len(new)] = kinds(*code_points(new))
        self.flat[self.used : self.used + len(flat)] = flat
        self.used += len(flat)
        self.index.update(zip(new, range(at, at + len(new))))

    def numbers(self, pieces: list[str]) -> np.ndarray:
        at = np.fromiter(map(self.index.get, pieces, repeat(-1)), np.int32, len(pieces))
        if len(unknown := np.flatnonzero(at < 0)):
            missing = [pieces[i] for i in unknown.tolist()]
            self._learn(list(dict.fromkeys(missing)))
            at[unknown] = np.fromiter(map(self.index.__getitem__, missing), np.int32, len(missing))
        return at

    def documents(self, texts: Sequence[str] | pa.Array, spaced: bool) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and how many each text has; spaced: the space before a piece belongs to it.

        Texts that are cut with their spaces come as an Arrow array without nulls: only distinct pieces become Python's.
        """
        if len(self.index) > self.remembered or spaced != self.spaced:
            self.clear()
        self.spaced = spaced
        if spaced:
            texts = texts.cast(pa.large_string())
            pieces, own, per_text = cut_spaced(texts)
            at, per_text = self._recut(texts, self.numbers(pieces)[own], per_text)
        else:
            pieces, per_text = [], np.empty(len(texts), np.int64)
            for i, text in enumerate(texts):
                own = cut(text)
                pieces += own
                per_text[i] = len(own)
            at = self.numbers(pieces)
        counts = self.counts[at]
        ends = np.cumsum(counts, dtype=np.int64)
        where = np.repeat(self.starts[at] - ends + counts, counts)
        where += np.arange(len(where))
        bounds = np.concatenate(([0], ends))[np.concatenate(([0], np.cumsum(per_text)))]
        return self.flat[where], np.diff(bounds)

    def _recut(self, texts: pa.Array, at: np.ndarray, per_text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Texts in which a piece may not stand alone, or not where it does, are cut by spaces alone."""
        k = self.kinds[at]
        ends = np.cumsum(per_text)
        bad = k >= BAD
        bad[1:] |= ((k[:-1] & ENDS_OTHER) > 0) & ((k[1:] & BEGINS_STOP) > 0) | ((k[:-1] & LINE_END) > 0) & ((k[1:] & (BEGINS_SPACE | LINE_END)) > 0)
        again = set(np.searchsorted(ends, np.flatnonzero(bad), "right").tolist()) | set(np.flatnonzero(np.asarray(pc.match_substring(texts, "\0"))).tolist())
        if not again:
            return at, per_text
        parts = np.split(at, ends[:-1])
        for i in again:
            own = cut(texts[i].as_py())
            parts[i] = self.numbers([own[0], *(" " + x for x in own[1:])])
        return np.concatenate(parts), np.fromiter(map(len, parts), np.int64, len(parts))
