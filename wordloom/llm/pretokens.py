"""Byte-level BPE pre-tokens of many texts at once, and a cache of their ids."""

from __future__ import annotations

import sys
import types
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np

from wordloom.llm import vectext as vt

U64 = np.uint64
LETTER, NUMBER, WHITE, OTHER = 0, 1, 2, 3
#: The code points with the Unicode property White_Space.
WHITE_SPACE = [0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
#: The endings that the public pattern cuts off after an apostrophe.
ENDINGS = ["s", "t", "re", "ve", "m", "ll", "d"]
END_OF_TEXT = "<|endoftext|>"


def stash(name: str, make: Callable):
    """A value that lives as long as the Python worker."""
    held = sys.modules.setdefault("_wordloom_stash", types.ModuleType("_wordloom_stash"))
    if not hasattr(held, name):
        setattr(held, name, make())
    return getattr(held, name)


def _classes() -> np.ndarray:
    kind = {"L": LETTER, "N": NUMBER}
    table = np.array([kind.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)], np.uint8)
    table[WHITE_SPACE] = WHITE
    return table


def starts(points: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Where pre-tokens start. points: code points of all texts in a row; edges: the first place of each text, and the end."""
    n = len(points)
    kind = stash("classes", _classes)[points]
    edge = np.zeros(n + 1, bool)
    edge[edges] = True
    head, tail = edge[:-1], edge[1:]
    white = kind == WHITE
    new = np.empty(n, bool)
    new[:1], new[1:] = True, kind[1:] != kind[:-1]
    new |= head
    # the last white character before a word stands alone; if it is a space, it joins the word
    last = np.zeros(n, bool)
    last[:-1] = white[:-1] & ~white[1:] & ~tail[:-1]
    new |= last
    glued = np.flatnonzero(last & (points == 32)) + 1
    new[glued] = False
    # endings after an apostrophe that starts a pre-token
    quote = np.flatnonzero((points == 39) & new)
    if len(quote):
        stop = edges[np.searchsorted(edges, quote, "right")]
        padded = np.append(points, [0, 0, 0])
        for ending in ENDINGS:
            k = len(ending)
            hit = quote + k < stop
            for i, c in enumerate(ending, 1):
                hit &= padded[quote + i] == ord(c)
            at = quote[hit]
            new[at + 1] = False
            after = at + k + 1
            new[after[after < n]] = True
    return np.flatnonzero(new)


class Ids:
    """Ids of pre-tokens by the hash of their bytes; a large sorted part and a small one that is merged into it at times."""

    MOST = 1_500_000

    def __init__(self, encode: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]]):
        self.encode = encode  # words -> all their ids in a row, ids of each
        self.clear()

    def clear(self) -> None:
        self.parts = [(np.zeros(0, U64), np.zeros(0, np.int64), np.zeros(0, np.int32))] * 2
        self.pool, self.used = np.zeros(1 << 20, np.int32), 0

    def find(self, keys: np.ndarray, word: Callable[[int], bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Start in the pool and number of ids, for sorted distinct keys."""
        if sum(len(p[0]) for p in self.parts) > self.MOST:
            self.clear()
        start, size = np.full(len(keys), -1, np.int64), np.zeros(len(keys), np.int32)
        for known, at, count in self.parts:
            if len(known):
                i = np.minimum(np.searchsorted(known, keys), len(known) - 1)
                hit = known[i] == keys
                start[hit], size[hit] = at[i[hit]], count[i[hit]]
        missing = np.flatnonzero(start < 0)
        if len(missing):
            ids, counts = self.encode([word(i) for i in missing])
            if self.used + len(ids) > len(self.pool):
                self.pool = np.concatenate([self.pool[: self.used], np.zeros(max(len(self.pool), len(ids)), np.int32)])
            self.pool[self.used : self.used + len(ids)] = ids
            start[missing] = self.used + np.cumsum(counts) - counts
            size[missing] = counts
            self.used += len(ids)
            fresh = (keys[missing], start[missing], size[missing])
            small = [np.concatenate(x) for x in zip(self.parts[1], fresh, strict=True)]
            if len(small[0]) * 4 > len(self.parts[0][0]) + 100_000:
                small = [np.concatenate(x) for x in zip(self.parts[0], small, strict=True)]
                order = np.argsort(small[0])
                self.parts = [tuple(x[order] for x in small), tuple(x[:0] for x in small)]
            else:
                order = np.argsort(small[0])
                self.parts = [self.parts[0], tuple(x[order] for x in small)]
        return start, size


def spread(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[0], start[0]+1, ... size[0] of them, then the same for the next."""
    first = np.cumsum(size) - size
    return np.arange(int(size.sum())) + np.repeat(start - first, size)


def encode_texts(column, ids: Ids, end_id: int | None) -> Iterator[np.ndarray]:
    """The ids of each text of an Arrow string column; END_OF_TEXT in a text becomes end_id (ordinary text if None)."""
    mark = np.frombuffer(END_OF_TEXT.encode(), np.uint8)
    for _, _, data, offsets in vt.texts(column):
        cuts = np.zeros(0, np.int64)
        if end_id is not None and len(data) >= len(mark):
            cuts = np.flatnonzero((data[: len(data) - len(mark) + 1] == mark[0]) & (data[len(mark) - 1 :] == mark[-1]))
            cuts = np.array([c for c in cuts if data[c : c + len(mark)].tobytes() == mark.tobytes() and offsets[np.searchsorted(offsets, c, "right")] >= c + len(mark)], np.int64)
        edges = np.unique(np.concatenate([offsets, cuts, cuts + len(mark)]))
        points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
        width = 1 + (points > 0x7F).astype(np.int8) + (points > 0x7FF) + (points > 0xFFFF)
        at = np.cumsum(width, dtype=np.int64) - width
        first = at[starts(points, np.searchsorted(at, edges))] if len(points) else np.zeros(0, np.int64)
        if len(cuts):
            # a mark is one pre-token
            covered = np.searchsorted(cuts, first, "right") - 1
            inside = (covered >= 0) & (first > cuts[covered]) & (first < cuts[covered] + len(mark))
            first = first[~inside]
        last = np.append(first[1:], len(data)) if len(first) else first
        keys, where, back = np.unique(vt.hashes(data, first, last), return_index=True, return_inverse=True)
        at_key, size_key = ids.find(keys, lambda i: data[first[where[i]] : last[where[i]]].tobytes())
        start, size = at_key[back], size_key[back]
        flat = ids.pool[spread(start, size)]
        if len(cuts):
            # each mark's ids give way to the one id
            tokens = np.searchsorted(first, cuts)
            begin = np.cumsum(size) - size
            keep = np.ones(len(flat), bool)
            for t in tokens:
                flat[begin[t]] = end_id
                keep[begin[t] + 1 : begin[t] + size[t]] = False
            size = size.copy()
            size[tokens] = 1
            flat = flat[keep]
        ends = np.append(0, np.cumsum(size))[np.searchsorted(first, offsets)]
        for a, b in zip(ends[:-1], ends[1:], strict=True):
            yield flat[a:b]
