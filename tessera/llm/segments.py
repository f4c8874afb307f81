"""Texts cut before white space, and the numbers of their distinct segments, for whole arrays at once.

A segment starts at a blank or a line end that follows a character which is white space by no definition. No pattern or
vocabulary that joins white space only to what comes after it sees across such a place; callers verify theirs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Zero bytes that a buffer needs behind its texts, so that eight bytes can be read anywhere.
PAD = 24
#: Bytes of text in a slice of a batch: what is worked on at once.
SLICE = 1 << 22

#: 1: a plain letter; 2: any other plain sign.
_KIND = np.array([0 if not 33 <= c < 127 else 1 if chr(c).isalpha() else 2 for c in range(256)], np.uint8)
_KEEP = np.array([(1 << 8 * i) - 1 for i in range(8)] + [0xFFFFFFFFFFFFFFFF], "<u8")


def join(texts: list[bytes], before: bytes = b"") -> tuple[bytes, np.ndarray]:
    """One buffer of the texts, each after `before`, with PAD, and where each starts (one more: the end)."""
    size = np.fromiter((len(t) for t in texts), np.int64, len(texts)) + len(before)
    return b"".join([x for t in texts for x in (before, t)] if before else texts) + bytes(PAD), np.concatenate([[0], np.cumsum(size)])


def cut(buffer: bytes, bounds: np.ndarray, words: bool = False) -> np.ndarray:
    """Where segments start: at every text that is not empty, and at blanks and line ends after what is no white space.

    With words also where plain letters end before a sign or digit, for patterns that never join what follows letters to them.
    """
    data = np.frombuffer(buffer, np.uint8)[: int(bounds[-1])]
    if not len(data):
        return np.zeros(0, np.int64)
    mark = np.zeros(len(data), bool)
    mark[1:] = ((data[1:] == 32) | (data[1:] == 10)) & (data[:-1] > 32)
    high = np.flatnonzero(mark[1:] & (data[:-1] >= 128)) + 1
    if len(high):  # white space of two or three bytes begins with C2, E1, E2 or E3; no cut behind anything that does
        third = data[np.maximum(high - 3, 0)]
        mark[high[(data[np.maximum(high - 2, 0)] == 0xC2) | ((third >= 0xE1) & (third <= 0xE3))]] = False
    if words:
        kind = _KIND[data]
        mark[1:] |= (kind[:-1] == 1) & (kind[1:] == 2)
    mark[bounds[:-1][np.diff(bounds) > 0]] = True
    return np.flatnonzero(mark)


def slices(batch: pa.RecordBatch, column: int, size: int = SLICE) -> Iterator[tuple[int, list[bytes]]]:
    """The texts of a batch as bytes, null as empty, some `size` bytes at a time, each with the row of its first."""
    first, held, total = 0, [], 0
    for i, x in enumerate(batch.column(column).cast(pa.binary())):
        held.append(x.as_py() or b"")
        total += len(held[-1])
        if total >= size:
            yield first, held
            first, held, total = i + 1, [], 0
    if held:
        yield first, held


class Numbers:
    """A growing table of distinct segments. Those of up to 16 bytes are found by their bytes, all at once; longer ones in a dict."""

    def __init__(self, bits: int = 16) -> None:
        self.size, self.bits = 0, bits
        self.slot = np.full(1 << bits, -1, np.int32)
        self.low, self.high, self.length = np.zeros(1 << bits, "<u8"), np.zeros(1 << bits, "<u8"), np.zeros(1 << bits, np.uint8)
        self.short = 0
        self.long: dict[bytes, int] = {}

    def __len__(self) -> int:
        return self.size

    @staticmethod
    def keys(buffer: bytes, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.ndarray((len(buffer) - 7,), "<u8", buffer, strides=(1,))
        return at[starts] & _KEEP[np.minimum(lengths, 8)], at[starts + 8] & _KEEP[np.clip(lengths - 8, 0, 8)]

    def first_slot(self, low: np.ndarray, high: np.ndarray, length: np.ndarray) -> np.ndarray:
        h = low * np.uint64(0x9E3779B97F4A7C15) ^ (high + length.astype("<u8")) * np.uint64(0xC2B2AE3D27D4EB4F)
        h ^= h >> np.uint64(32)
        return (h * np.uint64(0xFF51AFD7ED558CCD) >> np.uint64(64 - self.bits)).astype(np.int64)

    def look(self, low: np.ndarray, high: np.ndarray, length: np.ndarray) -> np.ndarray:
        """The numbers, -1 for what the table does not hold."""
        found, at, open_ = np.full(len(low), -1, np.int32), self.first_slot(low, high, length), np.arange(len(low))
        while len(open_):
            slot = at[open_]
            got = self.slot[slot]
            used = got >= 0
            same = used & (self.low[slot] == low[open_]) & (self.high[slot] == high[open_]) & (self.length[slot] == length[open_])
            found[open_[same]] = got[same]
            open_ = open_[used & ~same]
            at[open_] = (at[open_] + 1) & (len(self.slot) - 1)
        return found

    def put(self, low: np.ndarray, high: np.ndarray, length: np.ndarray, numbers: np.ndarray) -> None:
        """Enters distinct keys that the table does not hold."""
        self.short += len(low)
        if self.short * 2 > len(self.slot):
            used = np.flatnonzero(self.slot >= 0)
            low, high, length, numbers = (np.concatenate([old[used], new]) for old, new in ((self.low, low), (self.high, high), (self.length, length), (self.slot, numbers)))
            self.bits = max(self.bits + 1, int(len(low) * 4 - 1).bit_length())
            self.slot = np.full(1 << self.bits, -1, np.int32)
            self.low, self.high, self.length = np.zeros(1 << self.bits, "<u8"), np.zeros(1 << self.bits, "<u8"), np.zeros(1 << self.bits, np.uint8)
        at, open_ = self.first_slot(low, high, length), np.arange(len(low))
        while len(open_):
            free = open_[self.slot[at[open_]] < 0]
            self.slot[at[free]] = free  # of several for one slot the last stays
            won = free[self.slot[at[free]] == free]
            place = at[won]
            self.slot[place], self.low[place], self.high[place], self.length[place] = numbers[won], low[won], high[won], length[won]
            lost = np.ones(len(low), bool)
            lost[won] = False
            open_ = open_[lost[open_]]
            at[open_] = (at[open_] + 1) & (len(self.slot) - 1)

    def number(self, buffer: bytes, starts: np.ndarray, ends: np.ndarray, grow: bool = True) -> tuple[np.ndarray, list[bytes]]:
        """The number of each segment, and the segments that are new here, in the order of their numbers.

        Without grow the table stays, and what it does not hold is numbered from len(self) on, in this call alone.
        """
        lengths, old = ends - starts, self.size
        out, short = np.full(len(starts), -1, np.int32), np.flatnonzero(lengths <= 16)
        size = lengths[short].astype(np.uint8)
        low, high = self.keys(buffer, starts[short], lengths[short])
        got = self.look(low, high, size)
        rest, fresh = np.flatnonzero(got < 0), []
        while len(rest):  # those of one hash are almost always one key; the others take another turn
            mixed = low[rest] * np.uint64(0x9E3779B97F4A7C15) ^ high[rest] * np.uint64(0xC2B2AE3D27D4EB4F) ^ size[rest]
            _, one, back = np.unique(mixed, return_index=True, return_inverse=True)
            lead = rest[one]
            same = (low[lead][back] == low[rest]) & (high[lead][back] == high[rest]) & (size[lead][back] == size[rest])
            numbers = np.arange(old + len(fresh), old + len(fresh) + len(lead), dtype=np.int32)
            if grow:
                self.put(low[lead], high[lead], size[lead], numbers)
            fresh += [buffer[a:b] for a, b in zip(starts[short[lead]].tolist(), ends[short[lead]].tolist())]
            got[rest[same]] = numbers[back[same]]
            rest = rest[~same]
        out[short] = got
        mine: dict[bytes, int] = self.long if grow else {}
        for i in np.flatnonzero(lengths > 16).tolist():
            word = buffer[starts[i] : ends[i]]
            n = self.long.get(word, -1)
            if n < 0 and (n := mine.get(word, -1)) < 0:
                n = mine[word] = old + len(fresh)
                fresh.append(word)
            out[i] = n
        if grow:
            self.size = old + len(fresh)
        return out, fresh


def spread(numbers: np.ndarray, begins: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For entries numbered so, whose items are at begins[number] and sizes[number] long: the place of every item, and the items before each entry."""
    size = sizes[numbers]
    before = np.concatenate([[0], np.cumsum(size)])
    return np.repeat(begins[numbers] - before[:-1], size) + np.arange(int(before[-1])), before
