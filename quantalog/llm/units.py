"""Splitting text for byte-level BPE, with a bounded store of what was worked out before.

The split pattern never matches across a single space that stands between two non-space characters: the space opens the
next match. So a text falls apart there into units that can be encoded alone, and a unit met before needs no new work.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import chain

import numpy as np
import regex

from quantalog.llm.shared import spread

INNER_SPACE = regex.compile(r"(?<=\S) (?=\S)")

#: After a word, each of these is a piece of its own when it ends the unit.
SINGLE = set('.,;:!?|)(-"#$%&*+/<=>@[]^_`{}~')

# Keys of the store. A unit after a space is its own key; the others carry a mark that such a unit can't start with.
FIRST, SPLIT_FIRST, SPLIT_NEXT = "\n", "\r", "\t"
#: Where a text has one of these, what str.split leaves after the space would pass for a key with a mark.
MARKED = tuple(f" {mark}" for mark in (FIRST, SPLIT_FIRST, SPLIT_NEXT))


def unit_text(key: str) -> str:
    mark = key[:1]
    if mark in (FIRST, SPLIT_FIRST):
        return key[1:]
    return f" {key[1:]}" if mark == SPLIT_NEXT else f" {key}"


def _sure(key: str) -> bool:
    """Whether a unit from str.split stands between spaces that really are single ones between non-space characters."""
    if key[:1] == FIRST:
        return len(key) > 1 and not key[1].isspace() and not key[-1].isspace()
    return bool(key) and not key[0].isspace() and not key[-1].isspace()


def _parts(text: str) -> list[str]:
    """The keys of a text that is cut only where a single space stands between two non-space characters."""
    parts = INNER_SPACE.split(text)
    return [SPLIT_FIRST + parts[0], *(SPLIT_NEXT + p for p in parts[1:])]


def piece_starts(texts: list[str], data: list[bytes], find: Callable[[str], list[str]]) -> tuple[np.ndarray, np.ndarray]:
    """(text number, byte offset) of every piece that isn't its text's first. data: the texts in UTF-8."""
    rows, offsets = [], []
    odd = [i for i, text in enumerate(texts) if not (text[1:].isalpha() and (text[0] == " " or text[0].isalpha()))]
    for i in odd:
        text = texts[i]
        word = text[1:] if text[:1] == " " else text
        if word.isalpha():
            continue
        if word[-1:] in SINGLE and word[:-1].isalpha():
            rows.append(i), offsets.append(len(data[i]) - 1)
            continue
        at = 0
        for piece in find(text)[:-1]:
            at += len(piece.encode())
            rows.append(i), offsets.append(at)
    return np.array(rows, np.int64), np.array(offsets, np.int64)


class UnitStore:
    """For each unit an integer array, worked out in bulk by `fill(texts) -> (values, lengths)`, held in one flat array.

    Beyond `limit` units or `most` values the store is emptied before more go in. That costs time and changes no result.
    """

    def __init__(self, fill: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], dtype, limit: int = 400_000, most: int = 1 << 23):
        self.fill, self.dtype, self.limit, self.most = fill, dtype, limit, most
        self.clear()

    def clear(self) -> None:
        self.slot: dict[str, int] = {}
        self.flat = np.zeros(1 << 16, self.dtype)
        self.starts = np.zeros(1 << 12, np.int64)
        self.lengths = np.zeros(1 << 12, np.int64)
        self.used = 0

    def _add(self, keys: list[str]) -> None:
        values, lengths = self.fill([unit_text(k) for k in keys])
        n, total = len(self.slot), len(values)
        if self.used + total > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros(max(len(self.flat), total), self.dtype)])
        if n + len(keys) > len(self.starts):
            more = np.zeros(max(len(self.starts), len(keys)), np.int64)
            self.starts, self.lengths = np.concatenate([self.starts, more]), np.concatenate([self.lengths, more])
        self.starts[n : n + len(keys)] = self.used + np.cumsum(lengths) - lengths
        self.lengths[n : n + len(keys)] = lengths
        self.flat[self.used : self.used + total] = values
        self.used += total
        self.slot.update(zip(keys, range(n, n + len(keys)), strict=True))

    def index(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of the units of all texts one after the other, and how many units each text has."""
        lists = []
        for text in texts:
            if any(m in text for m in MARKED):
                lists.append(_parts(text))
            else:
                units = text.split(" ")
                units[0] = FIRST + units[0]
                lists.append(units)
        flat = list(chain.from_iterable(lists))
        got = list(map(self.slot.get, flat))
        gaps = [i for i, n in enumerate(got) if n is None]
        new = {flat[i] for i in gaps}
        if unsure := {k for k in new if not _sure(k)}:
            for i, units in enumerate(lists):
                if not unsure.isdisjoint(units):
                    lists[i] = _parts(texts[i])
            flat = list(chain.from_iterable(lists))
            got = list(map(self.slot.get, flat))
            gaps = [i for i, n in enumerate(got) if n is None]
            new = {flat[i] for i in gaps}
        if self.slot and (len(self.slot) + len(new) > self.limit or self.used > self.most):
            self.clear()
            new, gaps = set(flat), range(len(flat))
        if new:
            self._add(list(new))
            slot = self.slot
            for i in gaps:
                got[i] = slot[flat[i]]
        return np.array(got, np.int64), np.fromiter(map(len, lists), np.int64, len(lists))

    def values(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The values of the units of all texts one after the other, and how many values each text has."""
        every, number = self.index(texts)
        lengths = self.lengths[every]
        ends = np.concatenate([np.zeros(1, np.int64), np.cumsum(lengths)])
        stops = np.cumsum(number)
        return self.flat[spread(self.starts[every], lengths)], ends[stops] - ends[stops - number]


def byte_of_letter() -> dict[str, int]:
    """The usual alphabet of byte-level vocabularies: printable bytes stand for themselves, the rest for U+0100 and on."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in kept]
    return {chr(b): b for b in kept} | {chr(256 + i): b for i, b in enumerate(rest)}


class IntMap:
    """Hashed lookup of non-negative 63-bit keys for whole numpy arrays: open addressing, linear probing."""

    FREE = np.int64(-1)

    def __init__(self, keys=(), values=(), bits: int = 12):
        self.bits = bits
        self.keys = np.full(1 << bits, self.FREE)
        self.values = np.zeros(1 << bits, np.int32)
        self.n = 0
        self.put(np.asarray(keys, np.int64), np.asarray(values, np.int32))

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def put(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Adds keys that aren't there yet and don't repeat."""
        if (self.n + len(keys)) * 4 > len(self.keys):
            held = self.keys != self.FREE
            old_keys, old_values = self.keys[held], self.values[held]
            while (self.n + len(keys)) * 4 > 1 << self.bits:
                self.bits += 1
            self.keys, self.values, self.n = np.full(1 << self.bits, self.FREE), np.zeros(1 << self.bits, np.int32), 0
            self.put(old_keys, old_values)
        self.n += len(keys)
        at, mask = self._slots(keys), len(self.keys) - 1
        while len(keys):
            free = self.keys[at] == self.FREE
            self.keys[at[free]] = keys[free]  # of several keys for one slot the last wins; the others move on
            self.values[at[free]] = values[free]
            lost = self.keys[at] != keys
            keys, values, at = keys[lost], values[lost], (at[lost] + 1) & mask

    def get(self, keys: np.ndarray) -> np.ndarray:
        """The values; -1 for keys that aren't there."""
        shape, keys = keys.shape, keys.ravel()
        at, mask = self._slots(keys), len(self.keys) - 1
        there = self.keys[at]
        out = np.where(there == keys, self.values[at], np.int32(-1))
        left = np.flatnonzero((there != keys) & (there != self.FREE))
        while len(left):
            at[left] = (at[left] + 1) & mask
            there = self.keys[at[left]]
            hit = there == keys[left]
            out[left[hit]] = self.values[at[left[hit]]]
            left = left[~hit & (there != self.FREE)]
        return out.reshape(shape)
