"""Language identification by segmentation-marginalised unigrams.

Each language has a probability for every piece of a fixed public vocabulary, pieces of every length (all single bytes are
among them, so every word can be segmented). A word's probability is the sum over all its segmentations, found by a forward
pass over many words at once; the probabilities come from expectation maximisation, whose expected piece counts use the
forward and backward sums. Sums are scaled or kept as logarithms, so words of any length count. A text's score for a language
is the sum of its words' log probabilities; the answer is the best language and its posterior under equal priors.

Words are the text's runs between white space, with A-Z lower-cased and a space before each. Training uses a sample bounded per
language. Distinct words are scored once and held in a bounded cache.

Defined cases: null text, or text without a letter, is `und` with score 0; training rows need a non-null text, lang and doc_id;
without training rows everything is `und`; equal scores go to the first language by code point; words of any length are scored
whole; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import base64
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordloom.llm import vectext as vt
from wordloom.llm.common import saved, ship, small_batches

U64 = np.uint64
#: Training documents per language (about; by hash), passes of expectation maximisation, weight of unseen pieces.
SAMPLE_DOCS, PASSES, FLOOR = 250, 2, 0.02
#: Pieces of up to so many bytes are looked for at every place, longer ones listed where they occur; places between two rescalings.
PIECE, RESCALE = 6, 16
UNKNOWN = "und"
LETTER = re.compile(r"[^\W\d_]")
CACHE = 1_000_000


_BASE = U64(0x9E3779B97F4A7C15)


def vocabulary(path: str) -> list[np.ndarray]:
    """Pieces of a public rank file by length, as sorted numbers: their bytes, little-endian, or a hash of more than eight."""
    found: dict[int, set[int]] = {1: set(range(256))}
    with open(path, "rb") as f:
        for line in f:
            if line.strip():
                piece = base64.b64decode(line.split()[0])
                if len(piece) <= 8:
                    value = int.from_bytes(piece, "little")
                else:
                    value = 0
                    for byte in piece:
                        value = (value * int(_BASE) + byte + 1) % 2**64
                found.setdefault(len(piece), set()).add(value)
    return [np.array(sorted(found.get(n, ())), U64) for n in range(max(found) + 1)]


class Lattice:
    """Words of one length bucket as a byte matrix, with the piece number of every place and length.

    Pieces of up to PIECE bytes have a matrix of numbers by the place where they begin (-1: none); longer ones are lists of
    (length, words, numbers) by the place where they end.
    """

    def __init__(self, words: list[bytes], pieces: list[np.ndarray], first: np.ndarray):
        self.size = np.array([len(w) for w in words])
        top = self.top = int(self.size.max())
        text = np.zeros((len(words), top + 8), U64)
        for i, w in enumerate(words):
            text[i, : len(w)] = np.frombuffer(w, np.uint8)
        self.piece: list[np.ndarray | None] = [None]
        self.long: list[list[tuple[int, np.ndarray, np.ndarray]]] = [[] for _ in range(top + 1)]
        place = np.arange(top)[None, :]
        key = np.zeros((len(words), top), U64)
        sums = None
        for n in range(1, min(len(pieces) - 1, max(top, PIECE)) + 1):
            known = pieces[n]
            if n <= 8:
                key = key | (text[:, n - 1 : n - 1 + top] << U64(8 * (n - 1)))
                value = key
            elif len(known):
                if sums is None:
                    sums = np.zeros((len(words), top + 1), U64)
                    for t in range(top):
                        sums[:, t + 1] = sums[:, t] * _BASE + text[:, t] + U64(1)
                factor = U64(pow(int(_BASE), n, 2**64))
                value = np.zeros((len(words), top), U64)
                value[:, : top - n + 1] = sums[:, n:] - sums[:, : top - n + 1] * factor
            if not len(known):
                if n <= PIECE:
                    self.piece.append(np.full(key.shape, -1, np.int64))
                continue
            i = np.minimum(np.searchsorted(known, value), len(known) - 1)
            fits = (known[i] == value) & (place + n <= self.size[:, None])
            if n <= PIECE:
                self.piece.append(np.where(fits, first[n] + i, -1))
                continue
            at, rows = np.nonzero(fits.T)
            if len(at):
                cut = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
                for a, b in zip(cut, [*cut[1:], len(at)], strict=True):
                    t = int(at[a])
                    self.long[t + n].append((n, rows[a:b], first[n] + i[rows[a:b], t]))

    def log_probability(self, p: np.ndarray) -> np.ndarray:
        """Log of the sum over all segmentations, by word and language; p: piece probabilities by language, 0 last."""
        n, longest = len(self.size), max([PIECE, *(k for ends in self.long for k, _, _ in ends)])
        alpha = np.zeros((self.top + 1, n, p.shape[1]))
        alpha[0] = 1.0
        log = np.zeros((n, p.shape[1]))
        for t in range(1, self.top + 1):
            total = alpha[t]
            for k in range(1, min(t, PIECE) + 1):
                total += alpha[t - k] * p[self.piece[k][:, t - k]]
            for k, rows, ids in self.long[t]:
                total[rows] += alpha[t - k, rows] * p[ids]
            if t % RESCALE == 0:
                # the sums that later ones still need share the new scale; those of words that have ended stay
                top = np.where((self.size >= t)[:, None] & (total > 0), total, 1.0)
                alpha[max(0, t - longest + 1) : t + 1] /= top
                log += np.log(top)
        with np.errstate(divide="ignore"):
            return np.log(alpha[self.size, np.arange(n)]) + log

    def expected(self, p: np.ndarray, weight: np.ndarray, pieces: int) -> np.ndarray:
        """Expected piece counts for one language (p with one column), from the logs of forward and backward sums."""
        n = len(self.size)
        with np.errstate(divide="ignore"):
            logs = np.log(p[:, 0])
        ahead = np.full((self.top + 1, n), -np.inf)
        ahead[0] = 0.0
        for t in range(1, self.top + 1):
            for k in range(1, min(t, PIECE) + 1):
                ahead[t] = np.logaddexp(ahead[t], ahead[t - k] + logs[self.piece[k][:, t - k]])
            for k, rows, ids in self.long[t]:
                ahead[t, rows] = np.logaddexp(ahead[t, rows], ahead[t - k, rows] + logs[ids])
        behind = np.full((self.top + 1, n), -np.inf)
        behind[self.size, np.arange(n)] = 0.0
        for t in range(self.top, 0, -1):
            # what ends at t is complete: later ends have been handed back
            for k in range(1, min(t, PIECE) + 1):
                behind[t - k] = np.logaddexp(behind[t - k], behind[t] + logs[self.piece[k][:, t - k]])
            for k, rows, ids in self.long[t]:
                behind[t - k, rows] = np.logaddexp(behind[t - k, rows], behind[t, rows] + logs[ids])
        whole = ahead[self.size, np.arange(n)]
        out = np.zeros(pieces + 1)
        share = lambda start, end, rows, ids: np.exp(ahead[start, rows] + logs[ids] + behind[end, rows] - whole[rows]) * weight[rows]
        every = np.arange(n)
        for t in range(1, self.top + 1):
            for k, rows, ids in [*((k, every, self.piece[k][:, t - k]) for k in range(1, min(t, PIECE) + 1)), *self.long[t]]:
                fine = np.flatnonzero((ids >= 0) & np.isfinite(behind[t, rows]) & np.isfinite(whole[rows]))
                if len(fine):
                    out += np.bincount(ids[fine], share(t - k, t, rows[fine], ids[fine]), minlength=pieces + 1)
        return out[:pieces]


def lattices(words: list[bytes], pieces: list[np.ndarray], first: np.ndarray, cells: int = 60_000):
    """(indices, lattice) over words in buckets of similar length, each of about so many places."""
    order = np.argsort([len(w) for w in words], kind="stable")
    a = 0
    while a < len(order):
        b = a + 1
        while b < len(order) and (b - a) * len(words[order[b]]) < cells:
            b += 1
        yield order[a:b], Lattice([words[i] for i in order[a:b]], pieces, first)
        a = b


@dataclass
class Model:
    """Piece probabilities by language; a last row of zeros stands for no piece."""

    languages: list[str]
    pieces: list[np.ndarray]
    p: np.ndarray

    @property
    def first(self) -> np.ndarray:
        return np.cumsum([0, *map(len, self.pieces)])[:-1]

    def word_scores(self, words: list[bytes]) -> np.ndarray:
        out = np.zeros((len(words), len(self.languages)))
        for at, lattice in lattices(words, self.pieces, self.first):
            out[at] = lattice.log_probability(self.p)
        return out


def _word_bytes(data: np.ndarray, a: int, b: int) -> bytes:
    return b" " + data[a:b].tobytes()


def _counted(docs: DataFrame) -> DataFrame:
    """lang, word, count of docs(lang, text)."""

    def run(batches):
        for batch in batches:
            langs, count = batch.column("lang").to_pylist(), {}
            for i, _, data, offsets in vt.texts(batch.column("text")):
                data = vt.LOWER[data]
                for a, b, d in zip(*vt.bounds(data, offsets), strict=True):
                    key = (langs[i + d], _word_bytes(data, a, b))
                    count[key] = count.get(key, 0) + 1
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in count], pa.string()), pa.array([k[1] for k in count], pa.binary()), pa.array(list(count.values()), pa.int64())], ["lang", "word", "count"])

    return docs.select("lang", "text").mapInArrow(run, "lang string, word binary, count long").groupBy("lang", "word").agg(F.sum("count").alias("count"))


def learn(docs: DataFrame, path: str) -> Model:
    """A model from docs(doc_id, text, lang), all of them training rows, over the vocabulary file at path."""
    ship(docs.sparkSession)
    small_batches(docs.sparkSession, 200)
    pieces = vocabulary(path)
    first, n = np.cumsum([0, *map(len, pieces)])[:-1], sum(map(len, pieces))
    docs = docs.filter("lang is not null and text is not null and doc_id is not null")
    sizes = {r["lang"]: r["count"] for r in docs.groupBy("lang").count().collect()}  # one row a language
    languages = sorted(sizes)
    if not languages:
        return Model([], pieces, np.zeros((n + 1, 0)))
    parts = F.coalesce(*[F.when(F.col("lang") == x, max(1, sizes[x] // SAMPLE_DOCS)) for x in languages])
    words = saved(_counted(docs.filter(F.pmod(F.xxhash64("doc_id", F.lit("lang")), parts) == 0)).repartition("word"), "words")
    p = np.full((n + 1, len(languages)), 1.0 / n)
    p[n] = 0
    for _ in range(PASSES):

        def run(batches, p=p):
            total = np.zeros((n, len(languages)))
            number = {x: i for i, x in enumerate(languages)}
            for batch in batches:
                langs, found, counts = (batch.column(i).to_pylist() for i in range(3))
                for lang in set(langs):
                    own = [i for i, x in enumerate(langs) if x == lang]
                    weight = np.array([counts[i] for i in own], float)
                    for at, lattice in lattices([found[i] for i in own], pieces, first) if own else ():
                        total[:, number[lang]] += lattice.expected(p[:, [number[lang]]], weight[at], n)
            piece, lang = np.nonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(lang, pa.int64()), pa.array(piece, pa.int64()), pa.array(total[piece, lang], pa.float64())], ["lang", "piece", "c"])

        counts = words.mapInArrow(run, "lang long, piece long, c double").groupBy("lang", "piece").agg(F.sum("c").alias("c"))
        rows = counts.toArrow()  # at most pieces x languages
        expected = np.zeros((n, len(languages)))
        expected[rows["piece"].to_numpy(), rows["lang"].to_numpy()] = rows["c"].to_numpy()
        p = np.zeros((n + 1, len(languages)))
        p[:n] = (1 - FLOOR) * expected / np.maximum(expected.sum(axis=0), 1e-9) + FLOOR / n
    return Model(languages, pieces, p)


def predict(docs: DataFrame, model: Model, *keep: str) -> DataFrame:
    """keep columns, lang_pred and score of docs(text)."""
    ship(docs.sparkSession)
    small_batches(docs.sparkSession, 500)
    held = docs.sparkSession.sparkContext.broadcast(model)  # vocabulary x languages

    def run(batches):
        model = held.value
        known, scores = np.zeros(0, U64), np.zeros((0, len(model.languages)))
        for batch in batches:
            pred, best = [], []
            texts = batch.column(len(keep))
            plain = texts.to_pylist()
            for i, j, data, offsets in vt.texts(texts):
                data = vt.LOWER[data]
                starts, ends, _ = vt.bounds(data, offsets)
                keys, where, back = np.unique(vt.hashes(data, starts, ends), return_index=True, return_inverse=True)
                at = np.minimum(np.searchsorted(known, keys), max(len(known) - 1, 0))
                hit = known[at] == keys if len(known) else np.zeros(len(keys), bool)
                own = np.zeros((len(keys), len(model.languages)))
                own[hit] = scores[at[hit]]
                new = np.flatnonzero(~hit)
                if len(new) and model.languages:
                    own[new] = model.word_scores([_word_bytes(data, starts[where[k]], ends[where[k]]) for k in new])
                    if len(known) > CACHE:
                        known, scores = known[:0], scores[:0]
                    order = np.argsort(np.concatenate([known, keys[new]]))
                    known, scores = np.concatenate([known, keys[new]])[order], np.concatenate([scores, own[new]])[order]
                total = np.concatenate([np.zeros((1, own.shape[1])), np.cumsum(own[back], axis=0)])
                cut = np.searchsorted(starts, offsets)
                total = total[cut[1:]] - total[cut[:-1]]
                for k in range(j - i):
                    if not model.languages or not plain[i + k] or not LETTER.search(plain[i + k]):
                        pred.append(UNKNOWN)
                        best.append(0.0)
                        continue
                    top = int(np.argmax(total[k]))
                    pred.append(model.languages[top])
                    best.append(float(1 / np.exp(total[k] - total[k][top]).sum()))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), pa.array(pred, pa.string()), pa.array(best, pa.float64())], [*keep, "lang_pred", "score"])

    schema = docs.select(*keep).schema.add("lang_pred", "string").add("score", "double")
    return docs.select(*keep, F.col("text").alias("_text")).mapInArrow(run, schema)
