"""Byte-level BPE, encoded by batched numpy merge rounds and decoded from a flat byte table.

Symbols of many words lie in one flat array. A round forms all neighbouring pairs, finds their ranks by binary search over
the sorted pair keys, takes each word's lowest rank and merges that pair everywhere in the word, left to right. A merge's
product only occurs in pairs of higher rank, so this equals merging one occurrence at a time. Words that have no pair left
drop out. Distinct pre-tokens are encoded once and held in a bounded cache. A word of more than LONG bytes has rounds of its own,
which look only at the places of the lowest rank.

Defined cases: null text counts as empty (no ids, empty decoded text); texts of any length are encoded whole; the vocabulary's
special token in a text is one id, as the library does; rows pass one by one, so repeated rows, null ids and ties need no
rule; an empty table gives no rows; other columns pass unused.
"""

from __future__ import annotations

import hashlib
import heapq
import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from wordloom.llm.common import ship, small_batches
from wordloom.llm.pretokens import END_OF_TEXT, Ids, encode_texts, spread, stash

#: Bytes from which a word is encoded on its own.
LONG = 2_000


def byte_letters() -> list[str]:
    """The printable stand-in of each byte: itself where printable, else the next code points from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class Bpe:
    """Vocabulary and merges of a byte-level BPE file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        vocab = dict(model["model"]["vocab"])
        for x in model["added_tokens"]:
            vocab[x["content"]] = x["id"]
        self.end_id = vocab.get(END_OF_TEXT)
        letters = byte_letters()
        value = {c: b for b, c in enumerate(letters)}
        self.first = np.array([vocab[c] for c in letters], np.int64)
        self.n = max(vocab.values()) + 1
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["model"]["merges"]]
        keys = np.array([vocab[a] * self.n + vocab[b] for a, b in merges], np.int64)
        order = np.argsort(keys)
        self.keys, self.ranks, self.made = keys[order], order.astype(np.int64), np.array([vocab[a + b] for a, b in merges], np.int64)
        pieces = [b""] * self.n
        for token, i in vocab.items():
            pieces[i] = bytes(value[c] for c in token)
        self.size = np.array([len(p) for p in pieces], np.int64)
        self.at = np.cumsum(self.size) - self.size
        self.bytes = np.frombuffer(b"".join(pieces), np.uint8)

    def encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, and how many each word has."""
        long = [i for i, w in enumerate(words) if len(w) > LONG]
        if not long:
            return self._encode_short(words)
        own = {i: self._encode_long(words[i]) for i in long}
        ids, sizes = self._encode_short([b"" if i in own else w for i, w in enumerate(words)])
        ends = np.cumsum(sizes)
        parts, at = [], 0
        for i in long:
            parts += [ids[at : ends[i]], own[i]]
            at, sizes[i] = ends[i], len(own[i])
        return np.concatenate([*parts, ids[at:]]), sizes

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The merge rank of each pair of symbols; the number of merges where there is none."""
        key = left * self.n + right
        i = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[i] == key, self.ranks[i], len(self.ranks))

    def _encode_long(self, word: bytes) -> np.ndarray:
        """The ids of one long word: a round takes all places of the lowest rank, and only their neighbours get new ranks."""
        symbols = self.first[np.frombuffer(word, np.uint8)]
        n, none = len(symbols), len(self.ranks)
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        rank = np.append(self._ranks(symbols[:-1], symbols[1:]), none)
        alive = np.ones(n, bool)
        waiting: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def queue(at: np.ndarray) -> None:
            at = at[rank[at] < none]
            order = np.argsort(rank[at], kind="stable")
            at = at[order]
            cut = np.flatnonzero(np.append(True, np.diff(rank[at]) != 0)) if len(at) else []
            for a, b in zip(cut, [*cut[1:], len(at)], strict=False):
                r = int(rank[at[a]])
                if r not in waiting:
                    waiting[r] = []
                    heapq.heappush(heap, r)
                waiting[r].append(at[a:b])

        queue(np.arange(n))
        while heap:
            r = heapq.heappop(heap)
            at = np.unique(np.concatenate(waiting.pop(r)))
            at = at[alive[at] & (rank[at] == r)]
            if not len(at):
                continue
            # in a run of overlapping pairs every second one counts
            run = np.append(True, after[at[:-1]] != at[1:])
            place = np.arange(len(at)) - np.flatnonzero(run)[np.cumsum(run) - 1]
            at = at[place % 2 == 0]
            gone = after[at]
            symbols[at], alive[gone] = self.made[r], False
            after[at] = after[gone]
            inner = after[at] < n
            before[after[at][inner]] = at[inner]
            changed = np.unique(np.concatenate([at, before[at][before[at] >= 0]]))
            rank[changed] = none
            paired = changed[after[changed] < n]
            rank[paired] = self._ranks(symbols[paired], symbols[after[paired]])
            queue(paired)
        return symbols[alive]

    def _encode_short(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        symbols = self.first[np.frombuffer(b"".join(words), np.uint8)]
        owner = np.repeat(np.arange(len(words)), [len(w) for w in words])
        done_at, done = [], []
        none = len(self.ranks)
        while len(symbols):
            rank = np.full(len(symbols), none, np.int64)
            if len(symbols) > 1:
                key = symbols[:-1] * self.n + symbols[1:]
                i = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
                hit = (self.keys[i] == key) & (owner[:-1] == owner[1:])
                rank[:-1][hit] = self.ranks[i[hit]]
            first = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            lowest = np.repeat(np.minimum.reduceat(rank, first), np.diff(np.append(first, len(symbols))))
            over = lowest == none
            if over.any():
                done_at.append(owner[over])
                done.append(symbols[over])
            merge = (rank == lowest) & ~over
            at = np.flatnonzero(merge)
            if len(at) > 1 and (np.diff(at) == 1).any():
                # in a run of overlapping pairs every second one counts
                run = np.append(True, (np.diff(at) != 1) | (owner[at[1:]] != owner[at[:-1]]))
                place = np.arange(len(at)) - np.flatnonzero(run)[np.cumsum(run) - 1]
                at = at[place % 2 == 0]
            symbols[at] = self.made[rank[at]]
            keep = ~over
            keep[at + 1] = False
            symbols, owner = symbols[keep], owner[keep]
        at, ids = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (done_at, done))
        order = np.argsort(at, kind="stable")
        return ids[order], np.bincount(at, minlength=len(words))

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids; bytes that are not UTF-8 become U+FFFD."""
        size = self.size[ids]
        return self.bytes[spread(self.at[ids], size)].tobytes().decode("utf-8", "replace")


def codec(path: str) -> tuple[Bpe, Ids]:
    """The worker's codec for the file at path, with its cache."""

    def make():
        bpe = Bpe(path)
        return bpe, Ids(bpe.encode_words)

    return stash(f"bpe {path}", make)


def encode_frame(docs: DataFrame, path: str, *keep: str) -> DataFrame:
    """keep columns and ids(array<int>) of docs(text): the operator's plain form."""
    ship(docs.sparkSession)
    small_batches(docs.sparkSession)
    schema = docs.select(*keep).schema.add("ids", T.ArrayType(T.IntegerType()))

    def run(batches):
        bpe, ids = codec(path)
        for batch in batches:
            got = [x.astype(np.int32) for x in encode_texts(batch.column("text"), ids, bpe.end_id)]
            sizes = np.cumsum([0, *map(len, got)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(sizes), pa.array(np.concatenate([*got, np.zeros(0, np.int32)])))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), lists], [*keep, "ids"])

    return docs.select(*keep, "text").mapInArrow(run, schema)


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of docs(doc_id, text)."""
    ship(docs.sparkSession)
    small_batches(docs.sparkSession)

    def run(batches):
        bpe, ids = codec(path)
        digest = lambda raw: hashlib.sha256(raw).hexdigest()
        for batch in batches:
            sizes, one, two = [], [], []
            for x in encode_texts(batch.column("text"), ids, bpe.end_id):
                sizes.append(len(x))
                one.append(digest(x.astype("<u4").tobytes()))
                two.append(digest(bpe.decode(x).encode("utf-8")))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(one, pa.string()), pa.array(two, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
