"""LM scoring by Katz backoff over n-grams: bigrams by packed tables, any order by relational ones.

p(w | h) = d(c) c(h w) / (c(h) + 1) for bigrams seen in training, else alpha(h) p(w); p(w) = d'(c) c(w) / N for seen words, and what
that leaves for the one unknown word. d and d' are Good-Turing discounts of counts up to K. The one in c(h) + 1 keeps mass for
unseen words after histories whose counts all exceed K; alpha(h) = (1 - sum of seen p(. | h)) / (1 - sum of their p) makes every
history's distribution sum to one exactly.

Counts live in hash-partitioned tables. Words are 64-bit hashes. Each task sends, for every bucket of words, one packed array of
its distinct words, the histories of each, and the documents and counts of each pair; a bucket then knows c(w), c(h w) and every
document's occurrences, and returns per document only sums, per history its classes of counts and mass of p, and the held-out
pairs it has not seen. Histories meet in buckets of their own for alpha.

Hot keys: words with more than one in HOT of all tokens are hot (fewer than HOT of them), and so is the start of a text. A hot
word is spread by its histories. Pairs of a hot word after a hot history, at most HOT * HOT of them, are counted beforehand and
scored where their text is read. Unseen pairs of a hot history go by document, and its alpha, one number, is handed to them.

Defined cases: null or empty text is the single end token; a null doc_id is neither held out nor learned from; words are split
by bytes, of any length; repeated rows count and are scored each; without training rows every score is 0 tokens times
log10(1 / 1) = 0; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wordloom.llm import vectext as vt
from wordloom.llm.common import give_back, release, saved, ship, small_batches

U64 = np.uint64
K, HOT = 5, 256
#: Tokens in a bucket (about), tokens and documents after which a task sends what it has gathered.
BUCKET_TOKENS, SEND_TOKENS, SEND_DOCS = 3_500_000, 400_000, 60_000
#: Bytes of text split at once, bytes (about) of a batch that a worker returns, rows of histories or documents merged at once.
TEXT_BYTES, BATCH_BYTES, MERGE_ROWS = 500_000, 1_000_000, 400_000
#: A bucket is worked off in 2 ** SLICE_BITS slices of its words, so that one slice's arrays are in memory at a time.
SLICE_BITS = 4
END, START = (vt.splitmix(np.array([x]))[0] for x in (424242, 434343))


def discounts(n: list[int]) -> list[float]:
    """d(1) .. d(K) from n, the numbers of types with counts 1 .. K + 1; counts above K keep their value.

    Good-Turing as Katz gives it, with the largest K for which all factors lie in (0, 1); else one absolute discount.
    """
    for k in range(K, 0, -1):
        if any(n[r] <= 0 for r in range(k + 1)):
            continue
        cut = (k + 1) * n[k] / n[0]
        d = [((r + 1) * n[r] / (r * n[r - 1]) - cut) / (1 - cut) if cut != 1 else 2.0 for r in range(1, k + 1)]
        if all(0 < x < 1 for x in d):
            return d + [1.0] * (K - k)
    part = n[0] / (n[0] + 2 * n[1]) if n[0] and n[1] else 0.5
    return [(r - part) / r for r in range(1, K + 1)]


def _tokens(batch_text):
    """For each chunk: first text, hashes of all tokens with an end after each text, and where texts begin."""
    for i, j, data, offsets in vt.texts(batch_text, TEXT_BYTES):
        words, first = vt.word_hashes(data, offsets)
        n = j - i
        begin = first + np.arange(n + 1)
        out = np.full(len(words) + n, END, U64)
        at = np.ones(len(out), bool)
        at[begin[1:] - 1] = False
        out[at] = words
        yield i, out, begin


def _unigrams(docs: DataFrame) -> DataFrame:
    def run(batches):
        words, counts, waiting = [], [], 0

        def merged():
            w, back = np.unique(np.concatenate(words), return_inverse=True)
            return w, np.bincount(back, np.concatenate(counts)).astype(np.int64)

        def rows():
            w, c = merged()
            return pa.RecordBatch.from_arrays([pa.array(w.view(np.int64)), pa.array(c)], ["w", "c"])

        for batch in batches:
            for _, tokens, _ in _tokens(batch.column("text")):
                w, c = np.unique(tokens, return_counts=True)
                words.append(w)
                counts.append(c)
                waiting += len(w)
            if waiting > 500_000:
                yield rows()
                words, counts, waiting = [], [], 0
        if words:
            yield rows()
        give_back()

    return docs.select("text").mapInArrow(run, "w long, c long").groupBy("w").agg(F.sum("c").alias("c"))


def _bytes(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed string, after its size."""
    raw = np.array([len(a) for a in arrays], "<i8").tobytes() + b"".join(a.tobytes() for a in arrays)
    return len(raw).to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True)


def _opened(packed: pa.Buffer) -> pa.Buffer:
    return pa.decompress(packed.slice(8), int.from_bytes(packed.slice(0, 8).to_pybytes(), "little"), "zstd")


def _views(raw: pa.Buffer, *kinds: str) -> list[np.ndarray]:
    sizes, at, out = np.frombuffer(raw, "<i8", len(kinds)), 8 * len(kinds), []
    for n, kind in zip(sizes, kinds, strict=True):
        out.append(np.frombuffer(raw, kind, int(n), at))
        at += int(n) * np.dtype(kind).itemsize
    return out


def _arrays(packed: pa.Buffer, *kinds: str) -> list[np.ndarray]:
    return _views(_opened(packed), *kinds)


PAIRS = ("<u8", "<u4", "<u8", "<u4", "<u2", "<u1", "<u1", "<i8")
#: Kinds of packed rows.
DOC, HISTORY, UNSEEN, TYPES, META, PART, HOT_HISTORY, HOT_UNSEEN, FIX = range(9)
DOC_KINDS = ("<u8", "<f8", "<f8", "<u4", "<u4")
HISTORY_KINDS = ("<u8", "<u4", "<f8", "<f4")
UNSEEN_KINDS = ("<u8", "<u8", "<u4")
META_KINDS = ("<u8", "<i8", "<u1", "<i8")
ROWS = "kind int, group long, part binary"


def _batches(rows):
    """Record batches of about BATCH_BYTES of (kind, group, part) rows."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[2])
        if size > BATCH_BYTES:
            yield _batch(held)
            held, size = [], 0
    if held:
        yield _batch(held)


def _batch(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    kinds, groups, parts = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(kinds, pa.int32()), pa.array(groups, pa.int64()), pa.array(parts, pa.binary())], ["kind", "group", "part"])


def _histories(tokens: np.ndarray, begin: np.ndarray) -> np.ndarray:
    history = np.append(START, tokens[:-1])
    history[begin[:-1]] = START
    return history


def _pair_key(w: np.ndarray, h: np.ndarray) -> np.ndarray:
    return vt.splitmix(w ^ (h * U64(3)))


def _hot_pairs(docs: DataFrame, hot: np.ndarray) -> DataFrame:
    """w, h, c of pairs of a hot word after a hot history or the start of a text, of docs(text): at most HOT * HOT rows."""
    histories = np.sort(np.append(hot, START))

    def run(batches):
        count = np.zeros(len(hot) * len(histories), np.int64)
        for batch in batches:
            for _, tokens, begin in _tokens(batch.column("text")):
                history = _histories(tokens, begin)
                i, j = np.minimum(np.searchsorted(hot, tokens), len(hot) - 1), np.minimum(np.searchsorted(histories, history), len(histories) - 1)
                own = (hot[i] == tokens) & (histories[j] == history)
                count += np.bincount(i[own] * len(histories) + j[own], minlength=len(count))
        at = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(hot[at // len(histories)].view(np.int64)), pa.array(histories[at % len(histories)].view(np.int64)), pa.array(count[at])], ["w", "h", "c"])

    return docs.select("text").mapInArrow(run, "w long, h long, c long").groupBy("w", "h").agg(F.sum("c").alias("c"))


class Hot:
    """Hot words with their counts, and counts of the pairs of a hot word after a hot history."""

    def __init__(self, words: np.ndarray, counts: np.ndarray, pairs: np.ndarray, histories: np.ndarray, pair_counts: np.ndarray):
        self.words, self.counts, self.histories = words, counts, np.sort(np.append(words, START))
        key = _pair_key(pairs, histories)
        order = np.argsort(key)
        self.key, self.pair_counts, self.pair_words, self.pair_histories = key[order], pair_counts[order], pairs[order], histories[order]

    def word_counts(self, w: np.ndarray) -> np.ndarray:
        return self.counts[np.searchsorted(self.words, w)] if len(self.words) else np.zeros(len(w), np.int64)

    def of_pairs(self, w: np.ndarray, h: np.ndarray) -> np.ndarray:
        if not len(self.key):
            return np.zeros(len(w), np.int64)
        key = _pair_key(w, h)
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        return np.where(self.key[at] == key, self.pair_counts[at], 0)


def _pairs(docs: DataFrame, buckets: int, uni: Unigrams, hot: Hot) -> DataFrame:
    """kind, group, part: packed (word, history, document) counts of a stretch of documents by bucket of words, the documents
    themselves, and what pairs of hot words and hot histories say of them."""

    def run(batches):
        base, docs_done = TaskContext.get().partitionId() << 33, 0
        words, before, owner, held, ids, sizes, tokens_held = [], [], [], [], [], [], 0

        def send():
            n, uid = len(held), base + docs_done
            flags = np.array(held, "<u1")
            own = (np.arange(n) + uid).astype(U64)
            meta = (own, np.array(ids, "<i8"), flags, np.array(sizes, "<i8"))
            for g, at in _by_group(_home(own, buckets)):
                yield META, g, _bytes(*(x[at] for x in meta))
            w, h, d = (np.concatenate(x) for x in (words, before, owner))
            for x in (words, before, owner):
                x.clear()
            order = np.lexsort((d, h, w))
            w, h, d = w[order], h[order], d[order]
            at = np.flatnonzero(np.append(True, (w[1:] != w[:-1]) | (h[1:] != h[:-1]) | (d[1:] != d[:-1]))) if len(w) else np.zeros(0, np.int64)
            count = np.diff(np.append(at, len(w)))
            w, h, d = w[at], h[at], d[at]
            is_hot = np.isin(w, hot.words)
            both = is_hot & np.isin(h, hot.histories)
            if both.any():
                w1, h1, d1, c1 = w[both], h[both], d[both] + uid, count[both]
                count_p = hot.of_pairs(w1, h1)
                yield from _document_rows(_document_sums(w1, d1, c1, hot.word_counts(w1), count_p, uni), buckets)
                miss = count_p == 0
                if miss.any():
                    yield HOT_UNSEEN, int(_home(own[:1], buckets)[0]), _bytes(h1[miss], d1[miss].astype(U64), c1[miss].astype("<u4"))
                w, h, d, count, is_hot = w[~both], h[~both], d[~both], count[~both], is_hot[~both]
            # counts over 255 become several entries
            times = (count + 254) // 255
            part = np.repeat(np.arange(len(w)), times)
            small = np.full(len(part), 255, np.int64)
            small[np.cumsum(times) - 1] = count - 255 * (times - 1)
            w, h, d, is_hot = w[part], h[part], d[part].astype("<u2"), is_hot[part]
            key = (np.where(is_hot, _pair_key(w, h), w) % U64(buckets)).astype(np.int64)
            by_bucket = np.argsort(key, kind="stable")
            edges = np.searchsorted(key[by_bucket], np.arange(buckets + 1))
            for b in range(buckets):
                own = by_bucket[edges[b] : edges[b + 1]]
                if not len(own):
                    continue
                w1, h1 = w[own], h[own]
                pair = np.append(True, (w1[1:] != w1[:-1]) | (h1[1:] != h1[:-1]))
                word = np.append(True, w1[1:] != w1[:-1])
                pair_at, word_at = np.flatnonzero(pair), np.flatnonzero(word)
                per_word = np.diff(np.append(np.searchsorted(pair_at, word_at), len(pair_at))).astype("<u4")
                per_pair = np.diff(np.append(pair_at, len(w1))).astype("<u4")
                yield PART, b, _bytes(w1[word_at], per_word, h1[pair_at], per_pair, d[own], small[own].astype("<u1"), flags, np.array([uid, n], "<i8"))

        for batch in batches:
            flag = batch.column("held").to_pylist()
            doc = batch.column("doc_id").fill_null(0).to_pylist()
            null = batch.column("doc_id").is_null().to_pylist()
            for i, tokens, begin in _tokens(batch.column("text")):
                n = len(begin) - 1
                words.append(tokens)
                before.append(_histories(tokens, begin))
                owner.append(np.repeat(np.arange(n) + len(held), np.diff(begin)))
                # 0: training, 1: held out, 2: neither (no id)
                held += [2 if null[i + k] else int(flag[i + k]) for k in range(n)]
                ids += doc[i : i + n]
                sizes += np.diff(begin).tolist()
                tokens_held += len(tokens)
                if tokens_held >= SEND_TOKENS or len(held) >= SEND_DOCS:
                    yield from _batches(send())
                    docs_done += len(held)
                    held, ids, sizes, tokens_held = [], [], [], 0
        if held:
            yield from _batches(send())
        give_back()

    return docs.select("doc_id", "text", "held").mapInArrow(run, ROWS)


def _summed(key: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct keys and each value's sums."""
    if not len(key):
        return (key, *(v[:0] for v in values))
    order = np.argsort(key, kind="stable")
    key = key[order]
    at = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    return (key[at], *(np.add.reduceat(v[order], at) for v in values))


class Unigrams:
    """p(w) and the base probability from a word's count."""

    def __init__(self, n: int, types: int, classes: list[int]):
        self.n, self.types, self.d = n, types, discounts(classes)
        kept = sum(d * r * c for r, (d, c) in enumerate(zip(self.d, classes[:K], strict=True), 1)) + n - sum(r * c for r, c in enumerate(classes[:K], 1))
        # words of which none is rare would leave the unknown word nothing
        self.scale = n / (n + 1) if n and kept >= n * (1 - 1e-12) else 1.0
        self.unknown = 1 - self.scale * kept / n if n else 1.0

    def p(self, c: np.ndarray) -> np.ndarray:
        factor = np.append([0.0, *self.d], 1.0)[np.minimum(c, K + 1)]
        return np.where(c > 0, self.scale * factor * c / max(self.n, 1), self.unknown)

    def base(self, c: np.ndarray) -> np.ndarray:
        return np.log10((c + 1) / (self.n + self.types + 1))


def _slice(raw, k: int) -> tuple[np.ndarray, ...]:
    """Word, history, document, count and fold flag of a part's entries whose words fall in slice k."""
    word, per_word, h, per_pair, d, c, flags, place = _views(raw, *PAIRS)
    a, b = (int(np.searchsorted(word, U64(x << (64 - SLICE_BITS)))) if x < 1 << SLICE_BITS else len(word) for x in (k, k + 1))
    p0 = int(per_word[:a].sum(dtype=np.int64))
    p1 = p0 + int(per_word[a:b].sum(dtype=np.int64))
    e0 = int(per_pair[:p0].sum(dtype=np.int64))
    e1 = e0 + int(per_pair[p0:p1].sum(dtype=np.int64))
    sizes = per_pair[p0:p1]
    return np.repeat(np.repeat(word[a:b], per_word[a:b]), sizes), np.repeat(h[p0:p1], sizes), d[e0:e1].astype(np.int64) + place[0], c[e0:e1], flags[d[e0:e1]]


def _document_sums(w, doc, c, count_w, count_p, uni: Unigrams) -> tuple[np.ndarray, ...]:
    """Documents and their sums: base score, the part of the model's score known here, known tokens, tokens by class of pair count."""
    part = np.where(count_p > 0, np.where(count_p > K, np.log10(np.maximum(count_p, 1)), 0.0), np.log10(uni.p(count_w)))
    # every word is a history once for each of its occurrences; the end is none
    part = part - np.where((count_w > 0) & (w != END), np.log10(count_w + 1.0), 0.0)
    classes = [np.where(count_p == r, c, 0) for r in range(1, K + 1)]
    return _summed(doc.astype(U64), uni.base(count_w) * c, part * c, np.where(count_w > 0, c, 0), *classes)


def _home(doc: np.ndarray, groups: int) -> np.ndarray:
    """The group of each document."""
    return (vt.splitmix(doc) % U64(groups)).astype(np.int64)


def _document_rows(sums: tuple[np.ndarray, ...], groups: int):
    doc, base, known_part, known, *by_class = sums
    for g, own in _by_group(_home(doc, groups)):
        yield DOC, g, _bytes(doc[own], base[own], known_part[own], known[own].astype("<u4"), np.concatenate([x[own] for x in by_class]).astype("<u4"))


def _small(sums: tuple[np.ndarray, ...]) -> tuple[np.ndarray, ...]:
    """Document sums with counts of half the width."""
    return (*sums[:3], *(x.astype(np.uint32) for x in sums[3:]))


def _bucket(parts: list, uni: Unigrams, hot: Hot, groups: int):
    """kind, group, part: what one bucket of words knows of documents, histories and unseen pairs."""
    sums, histories, waiting = [], [], 0
    for k in range(1 << SLICE_BITS):
        columns = [np.concatenate(x) for x in zip(*(_slice(raw, k) for raw in parts), strict=True)]
        if len(columns[0]):
            yield from _worked_off(columns, uni, hot, groups, sums, histories)
            waiting += len(histories[-1][0])
        del columns
        if waiting > MERGE_ROWS or k == (1 << SLICE_BITS) - 1:
            yield from _history_rows(histories, hot, groups)
            histories, waiting = [], 0
        if sum(len(x[0]) for x in sums[1:]) > MERGE_ROWS:
            sums = [_small(_summed(*(np.concatenate(x) for x in zip(*sums, strict=True))))]
    yield from _document_rows(_summed(*(np.concatenate(x) for x in zip(*sums, strict=True))), groups)


def _by_group(group: np.ndarray):
    """Each group with the places of its members."""
    order = np.argsort(group, kind="stable")
    at = np.flatnonzero(np.append(True, np.diff(group[order]) != 0)) if len(group) else []
    for a, b in zip(at, [*at[1:], len(group)], strict=False):
        yield int(group[order[a]]), order[a:b]


def _history_rows(histories: list, hot: Hot, groups: int):
    """Histories: pairs by class, tokens above the classes, mass of p, summed over slices."""
    if not histories:
        return
    hist, above, mass, *by_class = _summed(*(np.concatenate(x) for x in zip(*histories, strict=True)))
    hot_history = np.isin(hist, hot.histories)
    group = np.where(hot_history, -1, (vt.splitmix(hist) % U64(groups)).astype(np.int64))
    for g, at in _by_group(group):
        yield HISTORY if g >= 0 else HOT_HISTORY, max(g, 0), _bytes(hist[at], np.concatenate([x[at] for x in by_class]).astype("<u4"), above[at].astype("<f8"), mass[at].astype("<f4"))


def _worked_off(columns: list[np.ndarray], uni: Unigrams, hot: Hot, groups: int, sums: list, histories: list):
    """The rows of one slice; its documents' sums and its histories are added to those lists."""
    w, h, d, c, f = columns
    columns.clear()
    order = np.lexsort((h, w))
    w, h, d, c, f = w[order], h[order], d[order], c[order].astype(np.int64), f[order]
    learned = np.where(f == 0, c, 0)
    new_word = np.append(True, w[1:] != w[:-1])
    new_pair = new_word | np.append(True, h[1:] != h[:-1])
    word_at, pair_at = np.flatnonzero(new_word), np.flatnonzero(new_pair)
    c_word = np.add.reduceat(learned, word_at)
    is_hot = np.isin(w[word_at], hot.words)
    if is_hot.any():
        c_word[is_hot] = hot.word_counts(w[word_at][is_hot])
    c_pair = np.add.reduceat(learned, pair_at)
    count_w = np.repeat(c_word, np.diff(np.append(word_at, len(w))))
    count_p = np.repeat(c_pair, np.diff(np.append(pair_at, len(w))))
    sums.append(_small(_document_sums(w, d, c, count_w, count_p, uni)))
    own = c_pair > 0
    pair_h, pair_c, pair_p = h[pair_at][own], c_pair[own], uni.p(count_w[pair_at])[own]
    classes = [(pair_c == r).astype(np.int64) for r in range(1, K + 1)]
    hist, above, mass, *by_class = _summed(pair_h, np.where(pair_c > K, pair_c, 0), pair_p, *classes)
    histories.append((hist, above.astype(np.int64), mass, *(x.astype(np.int32) for x in by_class)))
    missing = np.flatnonzero(count_p == 0)
    if len(missing):
        h, d, c = h[missing], d[missing].astype(U64), c[missing].astype("<u4")
        hot_history = np.isin(h, hot.histories)
        for kind, of, key in ((UNSEEN, ~hot_history, h), (HOT_UNSEEN, hot_history, d)):
            places = np.flatnonzero(of)
            for g, at in _by_group((vt.splitmix(key[places]) % U64(groups)).astype(np.int64)):
                yield kind, g, _bytes(h[places[at]], d[places[at]], c[places[at]])
    yield TYPES, 0, np.bincount(np.minimum(pair_c, K + 2), minlength=K + 3)[1 : K + 2].astype("<i8").tobytes()


def _factors(d: np.ndarray, classes: list[np.ndarray], above: np.ndarray, mass: np.ndarray) -> np.ndarray:
    """log10 of (c(h) + 1) alpha(h), which undoes the denominator that every token was given."""
    weights = np.arange(1, K + 1)
    count = sum(r * x for r, x in zip(weights, classes, strict=True)) + above
    taken = sum(f * r * x for f, r, x in zip(d, weights, classes, strict=True)) + above
    return np.log10((count + 1 - taken) / np.maximum(1 - mass, 1e-300))


def score(docs: DataFrame, held_out: Column, order: int = 2) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of docs(doc_id, text); the others are learned from.

    order is the length of the longest n-grams; the packed tables below are those of bigrams.
    """
    if order < 1:
        raise ValueError("n-grams have one word at least")
    if order != 2:
        return score_by_tables(docs, held_out, order)
    spark = docs.sparkSession
    ship(spark)
    small_batches(spark, 1000)
    rows = docs.select("doc_id", "text", F.coalesce(held_out, F.lit(False)).alias("held"))
    train = rows.filter(~F.col("held") & F.col("doc_id").isNotNull())
    table = saved(_unigrams(train), "unigrams")
    release(spark)
    total = table.agg(F.sum("c").alias("n"), F.count("*").alias("v")).first()
    n, v = total["n"] or 0, total["v"]
    by = {r["c"]: r["count"] for r in table.filter(F.col("c") <= K + 1).groupBy("c").count().collect()}
    uni = Unigrams(n, v, [by.get(r, 0) for r in range(1, K + 2)])
    frequent = table.filter(F.col("c") * HOT > n).collect()  # fewer than HOT rows
    hot = np.array([r["w"] for r in frequent], np.int64).view(U64)
    order = np.argsort(hot)
    hot, hot_counts = hot[order], np.array([r["c"] for r in frequent], np.int64)[order]
    train_docs = table.filter(F.col("w") == int(np.array([END]).view(np.int64)[0])).agg(F.sum("c")).first()[0] or 0
    buckets = max(1, round(n / BUCKET_TOKENS))
    known = _hot_pairs(train, hot).collect() if len(hot) else []  # at most HOT * HOT rows
    hot = Hot(hot, hot_counts, *(np.array([r[k] for r in known], np.int64).view(U64) for k in ("w", "h")), np.array([r["c"] for r in known], np.int64))

    pairs = _pairs(rows, buckets, uni, hot).repartitionById(buckets, F.col("group").cast("int"))

    def by_word(batches):
        parts = []  # a partition holds one bucket
        for batch in batches:
            for kind, g, part in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                if kind == PART:
                    parts.append(_opened(part.as_buffer()))
                else:
                    yield _batch([(kind, g, part.as_buffer().to_pybytes())])
        if parts:
            yield from _batches(_bucket(parts, uni, hot, buckets))
        parts.clear()
        give_back()

    found = saved(pairs.mapInArrow(by_word, ROWS), "katz")
    del pairs
    release(spark)
    types = np.zeros(K + 1, np.int64)

    def counted(batches):
        for batch in batches:
            found = np.array([np.frombuffer(part.as_buffer(), "<i8") for part in batch.column(0)]).reshape(-1, K + 1).sum(axis=0)
            yield pa.RecordBatch.from_arrays([pa.array([int(x)]) for x in found], [f"x{i}" for i in range(K + 1)])

    names = [f"x{i}" for i in range(K + 1)]
    r = found.filter(F.col("kind") == TYPES).select("part").mapInArrow(counted, ", ".join(f"{x} long" for x in names)).agg(*[F.sum(x).alias(x) for x in names]).first()
    types += np.array([r[x] or 0 for x in names])
    types += np.bincount(np.minimum(hot.pair_counts, K + 2), minlength=K + 3)[1 : K + 2]
    d = np.array(discounts(types.tolist()))

    def unpacked(batches):
        for batch in batches:
            for part in batch.column(0):
                hist, classes, above, mass = _arrays(part.as_buffer(), *HISTORY_KINDS)
                yield pa.RecordBatch.from_arrays([pa.array(hist.view(np.int64)), *(pa.array(x.astype(np.int64)) for x in classes.reshape(K, -1)), pa.array(above), pa.array(mass.astype(np.float64))], ["h", *(f"c{r}" for r in range(1, K + 1)), "above", "mass"])

    summed = [*(f"c{r}" for r in range(1, K + 1)), "above", "mass"]
    few = found.filter(F.col("kind") == HOT_HISTORY).select("part").mapInArrow(unpacked, "h long, " + ", ".join(f"c{r} long" for r in range(1, K + 1)) + ", above double, mass double")
    few = few.groupBy("h").agg(*[F.sum(c).alias(c) for c in summed]).collect()  # at most HOT rows
    release(spark)  # what the last job used is only let go when another has run
    hot_pair_p = uni.p(hot.word_counts(hot.pair_words))
    hist = np.concatenate([np.array([r["h"] for r in few], np.int64).view(U64), hot.pair_histories])
    parts = [np.concatenate([np.array([r[c] for r in few], float), x]) for c, x in zip(summed, [*((hot.pair_counts == r).astype(float) for r in range(1, K + 1)), np.where(hot.pair_counts > K, hot.pair_counts, 0).astype(float), hot_pair_p], strict=True)]
    hist, *parts = _summed(hist, *parts)
    hot_known, hot_factor = hist, _factors(d, parts[:K], parts[K], parts[K + 1]) if len(hist) else np.zeros(0)

    def fixed(hist, factor, unseen: list):
        """Documents' corrections for unseen pairs, by document group."""
        if not unseen:
            return
        h, doc, c = (np.concatenate(x) for x in zip(*unseen, strict=True))
        i = np.minimum(np.searchsorted(hist, h), max(len(hist) - 1, 0))
        doc, fix = _summed(doc, np.where(hist[i] == h, factor[i], 0.0) * c if len(hist) else np.zeros(len(h)))
        for g, at in _by_group(_home(doc, buckets)):
            yield FIX, g, _bytes(doc[at], fix[at])

    def by_history(batches):
        # a partition holds one group
        held = {HISTORY: [], UNSEEN: []}
        for batch in batches:
            for kind, part in zip(batch.column(0).to_pylist(), batch.column(2), strict=True):
                held[kind].append(_arrays(part.as_buffer(), *(HISTORY_KINDS if kind == HISTORY else UNSEEN_KINDS)))
        hist, factor = np.zeros(0, U64), np.zeros(0)
        if held[HISTORY]:
            hist, above, mass = (np.concatenate([x[k] for x in held[HISTORY]]) for k in (0, 2, 3))
            classes = np.concatenate([x[1].reshape(K, -1) for x in held[HISTORY]], axis=1).astype(np.int64)
            hist, above, mass, *classes = _summed(hist, above, mass, *classes)
            factor = _factors(d, classes, above, mass)
        yield from _batches(fixed(hist, factor, held[UNSEEN]))
        held.clear()
        give_back()

    def by_hot_history(batches):
        held, size = [], 0
        for batch in batches:
            for part in batch.column(0):
                held.append(_arrays(part.as_buffer(), *UNSEEN_KINDS))
                size += len(held[-1][0])
                if size > MERGE_ROWS:
                    yield from _batches(fixed(hot_known, hot_factor, held))
                    held, size = [], 0
        yield from _batches(fixed(hot_known, hot_factor, held))

    fixes = found.filter(F.col("kind").isin(HISTORY, UNSEEN)).repartitionById(buckets, F.col("group").cast("int")).mapInArrow(by_history, ROWS)
    fixes = fixes.union(found.filter(F.col("kind") == HOT_UNSEEN).select("part").mapInArrow(by_hot_history, ROWS))
    start = -math.log10(train_docs + 1) if train_docs else 0.0
    log_d = np.log10(d * np.arange(1, K + 1))

    def by_document(batches):
        # a partition holds one group of documents
        meta, sums = [], []
        for batch in batches:
            for kind, part in zip(batch.column(0).to_pylist(), batch.column(2), strict=True):
                raw = part.as_buffer()
                if kind == META:
                    meta.append(_arrays(raw, *META_KINDS))
                elif kind == FIX:
                    doc, fix = _arrays(raw, "<u8", "<f8")
                    sums.append((doc, np.zeros(len(doc)), fix, np.zeros(len(doc), np.int64)))
                else:
                    doc, base, known_part, known, classes = _arrays(raw, *DOC_KINDS)
                    sums.append((doc, base, known_part + log_d @ classes.reshape(K, -1), known.astype(np.int64)))
            if sum(len(x[0]) for x in sums[1:]) > MERGE_ROWS:
                sums = [_summed(*(np.concatenate(x) for x in zip(*sums, strict=True)))]
        if not meta:
            return
        uid, ids, flags, sizes = (np.concatenate(x) for x in zip(*meta, strict=True))
        doc, base, part, known = _summed(*(np.concatenate(x) for x in zip(*sums, strict=True)))
        at = np.searchsorted(doc, uid)  # every document has an end token, and so a sum
        for a in range(0, len(uid), 20_000):
            own = slice(a, a + 20_000)
            k = at[own]
            yield pa.RecordBatch.from_arrays([pa.array(ids[own], mask=flags[own] == 2), pa.array(flags[own] == 1), pa.array(sizes[own]), pa.array(known[k]), pa.array(base[k]), pa.array(part[k] + start)], ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"])

    parts = found.filter(F.col("kind").isin(DOC, META)).union(fixes).repartitionById(buckets, F.col("group").cast("int"))
    out = parts.mapInArrow(by_document, "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score")


def _grams(docs: DataFrame, order: int) -> DataFrame:
    """uid, doc_id, flag, w, h1 .. of every token: its word and its histories of 1 .. order - 1 words, as hashes."""
    names = [f"h{k}" for k in range(1, order)]

    def run(batches):
        base, done = TaskContext.get().partitionId() << 33, 0
        for batch in batches:
            ids, held = batch.column("doc_id"), np.asarray(batch.column("held").to_numpy(zero_copy_only=False))
            null = np.asarray(ids.is_null().to_numpy(zero_copy_only=False))
            for i, tokens, begin in _tokens(batch.column("text")):
                size = np.diff(begin)
                owner = np.repeat(np.arange(len(size)), size)
                place = np.arange(len(tokens)) - begin[owner]
                history, out = np.zeros(len(tokens), U64), []
                for k in range(1, order):
                    before = np.where(place >= k, tokens[np.maximum(np.arange(len(tokens)) - k, 0)], START)
                    history = before if k == 1 else vt.splitmix(history + before * U64(2 * k + 1))
                    out.append(pa.array(history.view(np.int64)))
                flag = np.where(null, 2, held.astype(np.int64))[i : i + len(size)]
                columns = [pa.array(base + done + owner), ids.take(pa.array(i + owner)), pa.array(flag[owner]), pa.array(tokens.view(np.int64)), *out]
                yield pa.RecordBatch.from_arrays(columns, ["uid", "doc_id", "flag", "w", *names])
                done += len(size)

    return docs.select("doc_id", "text", "held").mapInArrow(run, "uid long, doc_id long, flag long, w long" + "".join(f", {h} long" for h in names))


def score_by_tables(docs: DataFrame, held_out: Column, order: int) -> DataFrame:
    """score() for n-grams of any order, over one table of counts and one of backoff weights for each length of history.

    p(w | h) is looked up from the longest history down: where h w was seen its discounted share, else alpha(h) times
    p(w | h without its first word); a history never seen has alpha 1.
    """
    spark = docs.sparkSession
    ship(spark)
    small_batches(spark, 1000)
    rows = docs.select("doc_id", "text", F.coalesce(held_out, F.lit(False)).alias("held"))
    tokens = saved(_grams(rows, order), "tokens")
    train = tokens.filter("flag = 0")

    def classes(table: DataFrame) -> list[int]:
        by = {r["c"]: r["count"] for r in table.filter(F.col("c") <= K + 1).groupBy("c").count().collect()}
        return [by.get(r, 0) for r in range(1, K + 2)]

    words = saved(train.groupBy("w").agg(F.count("*").alias("c")), "unigrams")
    total = words.agg(F.sum("c").alias("n"), F.count("*").alias("v")).first()
    n, v = total["n"] or 0, total["v"]
    uni = Unigrams(n, v, classes(words))
    factor = lambda d: F.coalesce(F.get(F.array(*[F.lit(float(x)) for x in d]), F.col("c").cast("int") - 1), F.lit(1.0))
    lower = words.select("w", (F.lit(uni.scale / max(n, 1)) * factor(uni.d) * F.col("c")).alias("p"))
    known = words.select("w", F.lit(True).alias("known"), F.log10((F.col("c") + 1) / F.lit(float(n + v + 1))).alias("base"))
    out = tokens.join(known, "w", "left").join(lower.select("w", F.log10("p").alias("logp")), "w", "left")
    out = out.withColumn("base", F.coalesce("base", F.log10(F.lit(1 / (n + v + 1))))).withColumn("logp", F.coalesce("logp", F.lit(math.log10(uni.unknown) if uni.unknown > 0 else 0.0)))
    below = ["w"]
    for k in range(1, order):
        key = [f"h{k}", "w"]
        # a history's shorter form is the same for all of its occurrences
        counts = train.groupBy(*key).agg(F.count("*").alias("c"), *[F.min(c).alias(c) for c in below if c not in key])
        counts = saved(counts, f"grams{k}")
        sizes = counts.groupBy(f"h{k}").agg((F.sum("c") + 1).alias("total"))
        seen = counts.join(sizes, f"h{k}").withColumn("own", factor(discounts(classes(counts))) * F.col("c") / F.col("total")).join(lower, below)
        seen = saved(seen.select(*key, "own", "p"), f"shares{k}")
        alpha = seen.groupBy(f"h{k}").agg(F.log10((1 - F.sum("own")) / F.greatest(1 - F.sum("p"), F.lit(1e-300))).alias("alpha"))
        out = out.join(seen.select(*key, F.log10("own").alias("found")), key, "left").join(alpha, f"h{k}", "left")
        out = out.withColumn("logp", F.coalesce("found", F.coalesce("alpha", F.lit(0.0)) + F.col("logp"))).drop("found", "alpha")
        lower, below = seen.select(*key, F.col("own").alias("p")), key
    out = out.groupBy("uid").agg(F.max("doc_id").alias("doc_id"), F.max("flag").alias("flag"), F.count("*").alias("n_tokens"), F.count("known").alias("n_known"), F.sum("base").alias("base_score"), F.sum("logp").alias("score"))
    return out.select("doc_id", (F.col("flag") == 1).alias("held_out"), "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score")
