"""Encoding by safely cut pieces, each of which is encoded once and remembered in a bounded cache.

A text is cut at single spaces. For the byte-level vocabulary a cut is safe where both neighbours of the space are no
white space: its pre-tokenizer lets a space only begin a word there, so no token crosses the cut. For the word-end
vocabulary white space never is in a token and every space is safe. Special tokens hold no space, so that none is cut.
byte_cuts() does the same for many texts at once in their bytes, and cuts at punctuation and line ends as well.
"""

from __future__ import annotations

import re
import string
from collections.abc import Callable, Iterable
from typing import Any

import numpy as np

_SAFE = re.compile(r"(?<=\S) (?=\S)")
_LOOSE = re.compile(r" \s|\s ")
_RARE = [c for c in map(chr, range(0x3001)) if c.isspace() and c not in " \n"]


LONG, MEAN = 64, 16  # characters beyond which a piece is no word and is not remembered; of the pieces that are, on average


class PieceCache(dict):
    """Piece -> value. Two generations bound the memory: when the young one is full, by its entries or by MEAN characters for
    each of these, the old one goes. Pieces longer than LONG (whole texts of scripts without spaces) are encoded whenever
    they come and forgotten with their batch."""

    def __init__(self, encode: Callable[[list[str]], Iterable[Any]], entries: int, strict: bool):
        super().__init__()
        self.encode, self.entries, self.strict = encode, entries, strict
        self.old: dict = {}
        self.passing: list[str] = []  # long pieces of the last batch
        self.characters = 0

    def look(self, texts: list[list[str]]) -> list[list[Any]]:
        """The values of the pieces of each text; what is new is encoded in one batch."""
        for piece in self.passing:
            self.pop(piece, None)
        self.passing = []
        if len(self) >= self.entries or self.characters >= MEAN * self.entries:
            self.old = dict(self)
            self.clear()
            self.characters = 0
        get = self.get
        found = [list(map(get, pieces)) for pieces in texts]
        gaps = [(pieces, values, [i for i, v in enumerate(values) if v is None]) for pieces, values in zip(texts, found, strict=True) if None in values]
        fresh = []
        old = self.old
        for piece in {pieces[i] for pieces, _, at in gaps for i in at}:
            value = old.get(piece)
            if value is None:
                fresh.append(piece)
            else:
                self[piece] = value
                self.characters += len(piece)
        if fresh:
            self.update(zip(fresh, self.encode(fresh), strict=True))
            self.passing = [piece for piece in fresh if len(piece) > LONG]
            self.characters += sum(map(len, fresh)) - sum(map(len, self.passing))
        for pieces, values, at in gaps:
            for i in at:
                values[i] = self[pieces[i]]
        return found


def cut_loose(text: str) -> list[str]:
    """Every space is a safe boundary."""
    return text.split(" ")


def cut_strict(text: str) -> list[str]:
    """Cuts only at spaces between two characters that are no white space; the space stays with the piece after it, which
    the caller restores: all pieces but the first stand for " " + piece."""
    return _SAFE.split(text) if _has_loose_space(text) else text.split(" ")


def _has_loose_space(text: str) -> bool:
    """Is there a space at an end or beside white space?"""
    if not text or text[0] == " " or text[-1] == " " or "  " in text or "\n " in text or " \n" in text:
        return True
    return any(c in text for c in _RARE) and _LOOSE.search(text) is not None


def _byte_table(held: Iterable[int]) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(held)] = True
    return out


_WHITE = _byte_table(c for c in range(128) if chr(c).isspace())
_LETTER = _byte_table(map(ord, string.ascii_letters))
_WHITE_LEADS = _byte_table([0xC2, 0xE1, 0xE2, 0xE3])  # first bytes of white space beyond ASCII
WHITE_ENDS = frozenset(c.encode()[-1] for c in map(chr, range(0x3001)) if c.isspace())  # last bytes of white space
PUNCTUATION = _byte_table(map(ord, string.punctuation))


def byte_cuts(data: np.ndarray, marks: np.ndarray) -> np.ndarray:
    """The places in UTF-8 bytes where the byte-level pre-tokenizer begins a token whatever comes before and after, in no order:
    a space after no white space, one of the marks (a table of ASCII punctuation) after a letter, a line end after no white
    space, and what follows such a line end if it is no white space. Where beyond ASCII that is uncertain there is no cut."""
    stops = marks.copy()
    stops[[0x20, 0x0A]] = True
    at = np.flatnonzero(stops[data[1:]]) + 1
    here, last = data[at], data[at - 1]
    white, letter = _WHITE[last], _LETTER[last]
    wide = np.flatnonzero(last >= 0x80)
    end, lead, first = last[wide], data[at[wide] - 2], data[at[wide] - 3]
    white[wide] = (
        (lead == 0xC2) & ((end == 0x85) | (end == 0xA0))
        | (lead == 0x80) & (first == 0xE2) & ((end < 0x90) | (end >= 0xA8) & (end < 0xB0))
        | (lead == 0x81) & (first == 0xE2)
        | (lead == 0x80) & (first == 0xE3)
        | ((lead == 0x9A) | (lead == 0xA0)) & (first == 0xE1)
    )
    letter[wide] = (lead == 0xC3) & (end != 0x97) & (end != 0xB7)  # U+00C0 to U+00FF without the two signs
    lines = at[(here == 0x0A) & ~white] + 1
    lines = lines[lines < len(data)]
    lines = lines[~(_WHITE | _WHITE_LEADS)[data[lines]]]
    return np.concatenate([at[np.where((here == 0x20) | (here == 0x0A), ~white, letter)], lines])
