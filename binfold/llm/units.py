"""Independent pieces of a text for byte-level BPE, encoded once each.

A space that follows a non-space always starts a new pre-token, so a text cut there can be encoded piece by piece
with equal ids. Pieces repeat, so a worker keeps the ids of pieces it has met (a cache of bounded size that is
emptied when full; it decides nothing).
"""

from __future__ import annotations

import re
from array import array

import numpy as np
import regex
from public_tokenizers import PATTERN
from public_tokenizers import path as tokenizer_path
from tokenizers import Tokenizer

DEFAULT = "byte_bpe_50k.json"
_CUT = re.compile(r"(?<=\S)(?= )")
_PATTERN = regex.compile(PATTERN)
MAX_CACHED = 550_000


def _byte_letters() -> dict[int, str]:
    """Byte-level alphabet: printable bytes stand for themselves, the others follow from code point 256 on, in order."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(rest)}


_BYTES = _byte_letters()


def _room(a: np.ndarray, n: int) -> np.ndarray:
    """``a`` grown by doubling until it holds n entries."""
    while len(a) < n:
        a = np.concatenate((a, np.zeros_like(a)))
    return a


def split_units(text: str) -> list[str]:
    """Cut before every space that follows a non-space; joined, the units give the text again."""
    return _CUT.split(text) if text else []


class _Numbers(dict):
    """Unit to number; new units get the next number and wait in ``new``."""

    def __init__(self) -> None:
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, unit: str) -> int:
        self.new.append(unit)
        self[unit] = n = len(self)
        return n


class UnitEncoder:
    """Ids of whole texts, equal to encoding each text at once with the tokenizer file.

    A unit met for the first time is cut by the tokenizer's own pattern and its pre-tokens go through the library's
    merges one by one; a unit that holds one of the tokenizer's added strings is encoded as a text.
    """

    def __init__(self, file: str | None = None, max_cached: int = MAX_CACHED):
        self.tokenizer = Tokenizer.from_file(file or tokenizer_path(DEFAULT))
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.merges = self.tokenizer.model.tokenize
        self.max_cached = max_cached
        self._reset()

    def _reset(self) -> None:
        self.after_space, self.other = _Numbers(), _Numbers()  # keys without their leading space; whole units
        self.pieces: dict[str, bytes] = {}  # ids of pre-tokens, four bytes each
        self.start, self.size, self.flat, self.used = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64), np.zeros(1 << 18, np.uint32), 0
        self.blank_end = np.zeros(1 << 16, bool)
        self.where = [np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)]
        self.known = 0

    def _ids(self, unit: str) -> bytes:
        if unit[1:].isalpha() and unit[0] == " ":  # letters after a space are one pre-token
            return self._piece(unit)
        for a in self.added:
            if a in unit:
                return array("I", self.tokenizer.encode(unit, add_special_tokens=False).ids).tobytes()
        return b"".join([self._piece(piece) for piece in _PATTERN.findall(unit)])

    def _piece(self, piece: str) -> bytes:
        ids = self.pieces.get(piece)
        if ids is None:
            letters = "\u0120" + piece[1:] if piece.isascii() and piece[0] == " " and piece[1:].isalpha() else piece.encode("utf-8", "replace").decode("latin-1").translate(_BYTES)
            self.pieces[piece] = ids = array("I", [t.id for t in self.merges(letters)]).tobytes()
        return ids

    def _learn(self) -> None:
        for which, numbers in enumerate((self.after_space, self.other)):
            if not numbers.new:
                continue
            first, count = len(numbers) - len(numbers.new), len(numbers.new)
            self.where[which] = _room(self.where[which], len(numbers))
            self.where[which][first : len(numbers)] = np.arange(self.known, self.known + count)
            ids = [self._ids(" " + u) for u in numbers.new] if which == 0 else [self._ids(u) for u in numbers.new]
            size = np.fromiter(map(len, ids), np.int64, count) // 4
            self.start, self.size, self.blank_end = (_room(x, self.known + count) for x in (self.start, self.size, self.blank_end))
            new = slice(self.known, self.known + count)
            self.start[new] = self.used + np.cumsum(size) - size
            self.size[new] = size
            self.blank_end[new] = [not u or u[-1].isspace() for u in numbers.new]
            total = int(size.sum())
            self.flat = _room(self.flat, self.used + total)
            self.flat[self.used : self.used + total] = np.frombuffer(b"".join(ids), np.uint32)
            self.used += total
            self.known += count
            numbers.new = []

    def rows(self, texts: list[str]) -> list[np.ndarray]:
        """Per text the places of its units in ``start`` and ``size``, in order.

        A text is first cut at every space. Where a piece other than the last ends in white space, or is empty, a
        space did not follow a non-space, and the text is cut again by the rule.
        """
        if max(self.known, len(self.pieces)) > self.max_cached:
            self._reset()
        spaced, plain = self.after_space.__getitem__, self.other.__getitem__
        numbered = []
        for text in texts:
            words = text.split(" ")
            numbered.append((plain(words[0]), np.fromiter(map(spaced, words[1:]), np.int64, len(words) - 1)))
        self._learn()
        out, again = [], []
        for i, (first, rest) in enumerate(numbered):
            at = np.concatenate((self.where[1][first : first + 1], self.where[0][rest]))
            blank = self.blank_end[at[:-1]]
            if blank.any() and (blank[1:].any() or texts[i][0] != " "):
                units = split_units(texts[i])
                again.append((i, [(True, spaced(u[1:])) if u[0] == " " else (False, plain(u)) for u in units]))
            out.append(at)
        self._learn()
        for i, units in again:
            out[i] = np.array([self.where[0 if s else 1][n] for s, n in units], np.int64)
        return out

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        out = []
        for at in self.rows(texts):
            size = self.size[at]
            end = np.cumsum(size)
            out.append(self.flat[np.repeat(self.start[at] - end + size, size) + np.arange(int(end[-1]) if len(end) else 0)])
        return out


_ENCODERS: dict[str | None, UnitEncoder] = {}


def encoder(file: str | None = None) -> UnitEncoder:
    """The worker's own encoder of a tokenizer file; its cache lasts as long as the worker."""
    if file not in _ENCODERS:
        _ENCODERS[file] = UnitEncoder(file)
    return _ENCODERS[file]
