"""Operators over whole tables, against brute force: search, token files, Katz, Jaccard join, mixing, pipeline."""

import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from tests.llm.conftest import SCHEMA, fold, words
from wordloom.llm import jaccard_join, katz, mixing, queries, token_files, topk_search
from wordloom.llm.components import components

PATH = public_tokenizers.path("byte_bpe_50k.json")


def test_top_k_equals_brute_force(spark, sf, monkeypatch):
    monkeypatch.setattr(topk_search, "VECTORS", 40)
    monkeypatch.setattr(topk_search, "QUERIES", 5)
    e = pd.read_parquet(f"{sf}/embeddings.parquet")
    x, ids = np.floor(64 * np.stack([np.asarray(v, float) for v in e.embedding])).astype(int), e.vec_id.values
    found = queries.op5_topk_search(spark, sf).toPandas().sort_values(["query_id", "rank"])
    assert found.query_id.nunique() == (ids % 20 == 0).sum()
    for q, g in found.groupby("query_id"):
        score, other = x @ x[np.flatnonzero(ids == q)[0]], ids != q
        order = np.lexsort((ids[other], -score[other]))[:20]
        assert g.vec_id.tolist() == ids[other][order].tolist() and g.score.tolist() == score[other][order].tolist() and g["rank"].tolist() == list(range(1, len(g) + 1))


def test_top_k_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.5]), (3, None), (4, [nan, 1.0]), (5, [None, 1.0]), (6, [inf, 0.0]), (None, [1.0, 1.0]), (7, []), (8, [1.0]), (1, [1.0, 0.0]), (9, [1e10, 0.0]), (40, [0.0]), (40, [0.0])]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, units string")
    found = topk_search.top_k(df, F.col("vec_id") % 20 == 0, 20).orderBy("query_id", "rank").collect()
    # rows that share an id are rows of their own: only the query's own row is no candidate
    first = [(0, 1, 9, 64 * 64 * 10**10), (0, 2, 1, 4096), (0, 3, 1, 4096), (0, 4, 2, 4096)]
    assert [(r.query_id, r.rank, r.vec_id, r.score) for r in found if r.query_id == 0] == first
    assert Counter((r.rank, r.vec_id, r.score) for r in found if r.query_id == 40) == Counter([(1, 8, 0), (2, 40, 0)] * 2)
    huge = spark.createDataFrame([(0, [1e300, 1.0]), (1, [1e300, 0.0]), (2, [-1e300, 0.0])], "vec_id long, embedding array<double>")
    assert [(r.vec_id, r.score) for r in topk_search.top_k(huge, F.col("vec_id") == 0).orderBy("rank").collect()] == [(1, 2**63 - 1), (2, -(2**63))]
    assert topk_search.top_k(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


@pytest.mark.parametrize("spread,dims", [(1, 16), (5, 16), (40, 64), (3000, 16), (10**6, 4), (2**31, 3), (2**56, 3)])
def test_search_stops_only_on_proof(spread, dims):
    r = np.random.default_rng(3)
    units = (spread * r.standard_normal((400, dims))).astype(np.int64)
    ids = r.permutation(400) // 2
    index = topk_search.Index(np.arange(400) * 3, ids, units)
    q, v, s = index.search(units[:150], np.arange(150) * 3, 7)
    for i in range(0, 150, 7):
        full = [min(max(int(x), -(2**63)), 2**63 - 1) for x in (units[i].astype(object) * units.astype(object)).sum(axis=1)]
        want = sorted((-full[j], ids[j]) for j in range(400) if j != i)[:7]
        assert [(-int(a), b) for a, b in zip(s[q == i], ids[v[q == i]], strict=True)] == want


def test_search_skips_segments():
    """Few large components and many small ones: the proof comes before the small segments are taken."""
    r = np.random.default_rng(4)
    units = r.integers(-1, 2, (3000, 200))
    units[np.arange(3000), r.integers(0, 5, 3000)] = r.integers(2000, 9000, 3000)
    index = topk_search.Index(np.arange(3000), np.arange(3000), units)
    assert index.bands[-1][2] == 0 and sum(len(x[2]) for x in index.bands[0][0]) <= 3000
    q, v, s = index.search(units[:40], np.arange(40), 5)
    full = units[:40] @ units.T
    for i in range(40):
        other = np.delete(np.arange(3000), i)
        assert v[q == i].tolist() == other[np.lexsort((other, -full[i][other]))][:5].tolist()


def test_token_files(spark, sf, odd, nothing):
    tokenizer = Tokenizer.from_file(PATH)
    for docs in (spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text"), odd.filter("doc_id is not null")):
        rows = sorted(((r["doc_id"], tokenizer.encode(r["text"] or "", add_special_tokens=False).ids + [0]) for r in docs.collect()), key=lambda r: r[0])
        start, want = 0, Counter()
        for doc, ids in rows:
            want[(doc, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))] += 1
            start += len(ids)
        assert Counter(tuple(r) for r in token_files.read(token_files.write(docs, PATH)).collect()) == want
    assert token_files.read(token_files.write(nothing, PATH)).count() == 0
    first = token_files.read(token_files.write(odd, PATH)).orderBy("start").first()
    assert first.doc_id is None and first.start == 0


@pytest.mark.parametrize("vocabulary", [2, 3, 100, 256, 50257, 70000])
def test_bit_packing(vocabulary):
    r = np.random.default_rng(vocabulary)
    ids = r.integers(0, vocabulary, 10_000)
    bits = token_files.width(vocabulary)
    raw = token_files.write_container(ids, bits)
    held = token_files.Container(raw)
    assert len(raw) <= 10_000 * bits / 8 + 200 and (held.read(0, 10_000) == ids).all() and (held.read(4000, 8200) == ids[4000:8200]).all() and len(held.read(5, 5)) == 0


def katz_by_hand(rows):
    docs = [(i, [w.encode() for w in words(t, True)] + [None], i is not None and fold(i, 7) == 2) for i, t in rows]
    uni, pairs, starts = Counter(), Counter(), 0
    for i, t, held in docs:
        if i is not None and not held:
            starts += 1
            uni.update(t)
            pairs.update(zip(["<s>", *t], t, strict=False))
    n, v = sum(uni.values()), len(uni)
    du, dp = (katz.discounts([sum(c == r for c in x.values()) for r in range(1, 7)]) for x in (uni, pairs))
    cut = lambda d, c: (d[c - 1] if c <= 5 else 1) * c
    unknown = 1 - sum(cut(du, c) for c in uni.values()) / n if n else 1
    p = lambda w: cut(du, uni[w]) / n if uni[w] else unknown
    after = defaultdict(list)
    for (h, w), c in pairs.items():
        after[h].append((w, c))
    total = {h: sum(c for _, c in x) for h, x in after.items()}
    alpha = {h: (1 - sum(cut(dp, c) for _, c in x) / (total[h] + 1)) / (1 - sum(p(w) for w, _ in x)) for h, x in after.items()}
    one = lambda h, w: cut(dp, pairs[h, w]) / (total[h] + 1) if pairs[h, w] else p(w) * alpha.get(h, 1)
    for h in list(after)[:20]:
        assert math.isclose(sum(one(h, w) for w in [*uni, "never"]), 1)
    return Counter((i, held, len(t), sum(uni[w] > 0 for w in t), n, round(sum(math.log10((uni[w] + 1) / (n + v + 1)) for w in t), 5), round(sum(math.log10(one(h, w)) for h, w in zip(["<s>", *t], t, strict=False)), 5)) for i, t, held in docs)


def test_katz(spark, sf, odd, nothing, monkeypatch):
    """Also with a hot pair, a hot history with many rare followers, and more tokens than a task sends at once."""
    monkeypatch.setattr(katz, "BUCKET_TOKENS", 20_000)
    monkeypatch.setattr(katz, "SEND_TOKENS", 7_000)
    held = lambda: F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2
    r = np.random.default_rng(6)
    hot = spark.createDataFrame([(i, " ".join(x for k in range(40) for x in ("of", "the", f"w{r.integers(3000)}", "the"))) for i in range(300)] + [(i, "the " * 300 + "of") for i in range(300, 320)], "doc_id long, text string")
    for docs in (spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text"), odd, hot):
        want = katz_by_hand([(r["doc_id"], r["text"]) for r in docs.collect()])
        found = Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5), round(r.score, 5)) for r in katz.score(docs, held()).collect())
        near = lambda c: sorted((str(k[0]), *k[1:5], round(k[5], 3), round(k[6], 3)) for k in c.elements())
        assert near(found) == near(want)
    assert katz.score(nothing, held()).count() == 0


def katz_of_any_order(rows, order):
    """Recursive Katz probabilities over dictionaries of counts, straight from the definition."""
    docs = [(i, [w.encode() for w in words(t, True)] + [None], i is not None and fold(i, 7) == 2) for i, t in rows]
    padded = lambda t, at, k: tuple(t[j] if j >= 0 else "<s>" for j in range(at - k, at))
    counts = [Counter() for _ in range(order)]
    for i, t, held in docs:
        if i is not None and not held:
            for at, w in enumerate(t):
                for k in range(order):
                    counts[k][padded(t, at, k), w] += 1
    d = [katz.discounts([sum(c == r for c in x.values()) for r in range(1, 7)]) for x in counts]
    cut = lambda k, c: (d[k][c - 1] if c <= 5 else 1) * c
    n = sum(counts[0].values())
    unknown = 1 - sum(cut(0, c) for c in counts[0].values()) / n
    after = defaultdict(list)
    for k in range(1, order):
        for (h, w), c in counts[k].items():
            after[h].append((w, c))
    total = {h: sum(c for _, c in x) + 1 for h, x in after.items()}

    def p(h, w):
        k = len(h)
        if k == 0:
            return cut(0, counts[0][h, w]) / n if counts[0][h, w] else unknown
        if counts[k][h, w]:
            return cut(k, counts[k][h, w]) / total[h]
        return alpha(h) * p(h[1:], w)

    def alpha(h):
        if h not in after:
            return 1.0
        return (1 - sum(cut(len(h), c) for _, c in after[h]) / total[h]) / (1 - sum(p(h[1:], w) for w, _ in after[h]))

    for h in [h for h in after if len(h) == order - 1][:5]:
        assert math.isclose(sum(p(h, w) for w in [*{w for _, w in counts[0]}, "never"]), 1)
    return {i: (len(t), sum(math.log10(p(padded(t, at, order - 1), w)) for at, w in enumerate(t))) for i, t, _ in docs}


def test_katz_of_any_order(spark, odd):
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2
    r = np.random.default_rng(9)
    rows = [(i, " ".join(f"w{x}" for x in r.zipf(1.6, 60) if x < 50)) for i in range(150)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    packed = {x.doc_id: x for x in katz.score(docs, held).collect()}
    for order in (1, 2, 3, 4):
        want = katz_of_any_order(rows, order)
        for x in katz.score_by_tables(docs, held, order).collect():
            assert (x.n_tokens, round(x.score, 6)) == (want[x.doc_id][0], round(want[x.doc_id][1], 6))
            assert math.isclose(x.base_score, packed[x.doc_id].base_score) and x.n_known == packed[x.doc_id].n_known and x.train_tokens == packed[x.doc_id].train_tokens
            assert order != 2 or math.isclose(x.score, packed[x.doc_id].score, rel_tol=1e-6)
    assert katz.score(odd, held, 3).count() == odd.count() and katz.score(odd.limit(0), held, 3).count() == 0
    with pytest.raises(ValueError):
        katz.score(docs, held, 0)


def jaccard_by_hand(rows, percent=80):
    sets = []
    for _, t in rows:
        w = words(t, True)
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set()))
    group = list(range(len(rows)))

    def find(i):
        while group[i] != i:
            i = group[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                group[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[find(i)] = min(doc, least.get(find(i), doc))
    return Counter((doc, len(s), least.get(find(i))) for i, ((doc, _), s) in enumerate(zip(rows, sets, strict=True)))


def test_jaccard_join(spark, odd, nothing):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    for d in (docs, odd):
        want = jaccard_by_hand([(r["doc_id"], r["text"]) for r in d.collect()])
        assert Counter(tuple(r) for r in jaccard_join.jaccard_components(d).collect()) == want
    assert jaccard_join.jaccard_components(nothing).count() == 0


def test_jaccard_families(spark):
    """Chains of edits, whose ends are far apart, and texts that share a passage; edges of the threshold."""
    import random

    r = random.Random(5)
    word = lambda: f"w{r.randrange(10_000)}"
    rows, passage = [], [word() for _ in range(60)]
    for f in range(6):
        text = [word() for _ in range(r.choice([8, 40, 150]))]
        for k in range(25):
            rows.append((1000 * f + k, " ".join(text)))
            text = list(text)
            text[r.randrange(len(text))] = word()
    rows += [(9000 + k, " ".join([*(word() for _ in range(100)), *passage, *(word() for _ in range(100))])) for k in range(30)]
    r.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert Counter(tuple(x) for x in jaccard_join.jaccard_components(docs).collect()) == jaccard_by_hand(rows)
    kept = {x.doc_id for x in jaccard_join.keep_one(docs).collect()}
    assert kept == {c for _, _, c in jaccard_by_hand(rows)}


@pytest.mark.parametrize("percent", [45, 60, 95])
def test_jaccard_of_other_limits(spark, percent):
    r = np.random.default_rng(percent)
    rows = []
    for f in range(8):
        text = [f"w{x}" for x in r.integers(0, 5000, 40)]
        for k in range(14):
            rows.append((100 * f + k, " ".join(text)))
            text = list(text)
            text[r.integers(len(text))] = f"w{r.integers(5000)}"
    found = jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), percent=percent)
    assert Counter(tuple(x) for x in found.collect()) == jaccard_by_hand(rows, percent)


def test_jaccard_of_a_large_group(spark, monkeypatch):
    """Near copies by the thousand, some linked with few others or none, met in many blocks."""
    monkeypatch.setattr(jaccard_join, "BLOCK_CLASSES", 64)
    r = np.random.default_rng(12)
    base, rows = [f"b{i}" for i in range(110)], []
    for i in range(1600):
        text = list(base)
        for _ in range(r.integers(0, 7)):
            text[r.integers(len(text))] = f"e{r.integers(40)}"
        rows.append((i, " ".join(text)))
    rows += [(5000 + i, " ".join(f"x{k}" for k in r.integers(0, 9000, 60))) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    sets = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in (t.split() for _, t in rows)]
    number = {s: i for i, s in enumerate(sorted(set().union(*sets)))}
    there = np.zeros((len(sets), len(number)), np.float32)
    for i, s in enumerate(sets):
        there[i, [number[x] for x in s]] = 1
    both, size = there @ there.T, there.sum(axis=1)
    linked = 100 * both >= 80 * (size[:, None] + size[None, :] - both)
    root = np.arange(len(sets))
    while True:
        least = np.array([root[linked[i]].min() for i in range(len(sets))])
        if (least[least] == root).all():
            break
        root = least[least]
    want = {rows[i][0]: rows[root[i]][0] for i in range(len(rows))}
    assert {x.doc_id: x.component_id for x in jaccard_join.jaccard_components(docs).collect()} == want
    assert 100 < len(set(want.values()) - {i for i, _ in rows[1600:]}) < 1500


def test_jaccard_of_phrases_shared_by_chance(spark, monkeypatch):
    """Phrases that unrelated texts share, and no sample shows, bring sets to no more regions as a table grows."""
    monkeypatch.setattr(jaccard_join, "COMMON_IN_SAMPLE", 10**6)
    joined, met = jaccard_join._joined, []

    def seen(own, guests, *rest):
        if guests is None:
            met.append((own.count(), own.select("cid").distinct().count()))
        return joined(own, guests, *rest)

    monkeypatch.setattr(jaccard_join, "_joined", seen)
    r = np.random.default_rng(3)
    rows = []
    for f in range(60):
        for k in range(4):
            text, size = [f"f{f}w{i}" for i in range(400)], r.integers(1, 20)
            at = r.integers(0, 380)
            text[at : at + size] = [f"f{f}k{k}w{i}" for i in range(size)]
            for x in r.choice(120, 6, replace=False):
                text += [f"x{x}w{i}" for i in range(5)]
            rows.append((100 * f + k, " ".join(text)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    want = jaccard_by_hand(rows)
    assert Counter(tuple(x) for x in jaccard_join.jaccard_components(docs).collect()) == want
    assert 60 < len({c for _, _, c in want}) < 240
    [(members, classes)] = met
    assert classes > 60 and members < 2 * classes


def test_components(spark):
    links = [(i, i + 1) for i in range(1, 40)] + [(100, 101), (101, 100), (7, 7), (200, 150)]
    found = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert found == {**{i: 1 for i in range(1, 41)}, 100: 100, 101: 100, 200: 150, 150: 150}


def targets_by_hand(sizes):
    names = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    free, left, out = set(names), 1.5 * sum(sizes.values()), {}
    while free:
        share = left / sum(weight[s] for s in free)
        over = {s for s in free if share * weight[s] >= 2 * sizes[s]}
        if not over:
            return out | {s: share * weight[s] for s in free}
        out |= {s: 2 * sizes[s] for s in over}
        left -= sum(2 * sizes[s] for s in over)
        free -= over
    return out


def test_mixing(spark, sf, odd, nothing):
    for docs in (spark.read.parquet(f"{sf}/documents.parquet"), odd):
        rows = [r.asDict() for r in docs.select("doc_id", "text", "source").collect()]
        sizes = Counter()
        for r in rows:
            sizes[r["source"]] += len(words(r["text"]))
        want = targets_by_hand(dict(sizes))
        found = mixing.mix(docs, "doc_id", "text", "source").collect()
        again = mixing.mix(docs.repartition(7), "doc_id", "text", "source").collect()
        assert Counter(map(str, found)) == Counter(map(str, again)) and len(found) == len(rows)
        taken = Counter()
        for r in found:
            taken[r.source] += r.taken
            assert r["size"] == len(words(r["text"])) and r.source_size == sizes[r.source] and math.isclose(r.target, want[r.source], abs_tol=1e-6) and 0 <= r.taken <= 2 * r["size"]
        for s, n in want.items():
            assert abs(taken[s] - n) <= 2 * mixing.BLOCK
    assert mixing.mix(nothing, "doc_id").count() == 0 and mixing.mixed_documents(nothing).count() == 0
    out = mixing.mixed_documents(odd)
    assert out.columns == odd.columns and out.count() > 0


def test_mixed_documents_meet_targets(spark):
    """Long documents too: each goes out taken / size times, rounded either way, and a source's words stay near its target."""
    rows = [(1000 * k + i, "w " * n, s) for k, s in enumerate(("a", "b", "c", "d", "e", "f")) for i in range(400) for n in [65 + 37 * i % 1500]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = mixing.mixed_documents(docs)
    copies = Counter(r.doc_id for r in out.select("doc_id").collect())
    assert copies == Counter(r.doc_id for r in mixing.mixed_documents(docs.repartition(7)).select("doc_id").collect())
    emitted, spread, target = Counter(), Counter(), {}
    for r in mixing.mix(docs, "doc_id", "source").collect():
        rest = r.taken % r["size"]
        assert copies[r.doc_id] in {r.taken // r["size"], r.taken // r["size"] + (rest > 0)}
        emitted[r.source] += copies[r.doc_id] * r["size"]
        spread[r.source] += rest * (r["size"] - rest)
        target[r.source] = r.target
    for s, t in target.items():
        assert abs(emitted[s] - t) <= 2 * mixing.BLOCK + 4 * math.sqrt(spread[s]) < 0.15 * t


def test_permutation(spark):
    for n in (1, 2, 7, 64, 1000):
        image = spark.range(n).select(mixing.permuted(F.col("id"), F.lit(n).cast("long"), F.lit(3)).alias("x")).collect()
        assert sorted(r.x for r in image) == list(range(n))
    assert [r.x for r in image] != list(range(1000))


def test_slots_by_hand(spark, monkeypatch):
    """Every source's slots, over all shards, take each of its blocks as often as any other, but for the last pass."""
    monkeypatch.setattr(mixing, "TASK_SLOTS", 30)
    monkeypatch.setattr(mixing, "SHARD_SLOTS", 50)
    given = [(0, 64 * 100, 9000.0), (1, 64 * 7, 64 * 14.0), (2, 10, 20.0), (3, 6400, 0.0), (4, 0, 0.0)]
    found = mixing.slots(spark.createDataFrame(given, "number int, source_size long, target double")).collect()
    used = {n: Counter(r.block for r in found if r.number == n) for n, _, _ in given}
    assert sum(used[0].values()) == round(9000 / 64) and set(used[0]) == set(range(100)) and set(used[0].values()) == {1, 2}
    assert used[1] == Counter({b: 2 for b in range(7)}) and used[2] == Counter({0: 2}) and not used[3] and not used[4]
    assert 2 <= len({r.shard for r in found}) <= 4


def test_pipeline_stages_take_effect(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    sizes = [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        if name != "bpe":
            assert out.columns == docs.columns
        if name == "ngram_jaccard_join":
            rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
            assert {r["doc_id"] for r in out.collect()} == {c for _, _, c in jaccard_by_hand(rows)}
        docs = corpus_pipeline.saved(out, name)
        sizes.append(docs.count())
    assert sizes[0] > sizes[1] > sizes[2] > sizes[3] and sizes[4] == sizes[5]
    assert corpus_pipeline.run(spark, sf).count() == sizes[5]


def test_empty_pipeline(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_pipeline_of_odd_rows(spark, odd, tmp_path):
    """Nulls, empty and very long texts, ties, repeated rows and clashing columns, from end to end."""
    odd.write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(4, 1, 0, "x"), (5, 0, 0, None), (6, 0, 1, None), (11, 0, 1, None), (None, 0, 1, None), (7, None, None, None), (9, 7, 7, None)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int, kept string").write.parquet(f"{tmp_path}/labels.parquet")
    docs = odd
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.saved(stage(spark, docs, str(tmp_path)), name)
        assert docs.columns == odd.columns
        left = docs.collect()
        if name == "toxicity":
            assert not any(r.doc_id == 11 for r in left)
        if name == "quality_rules":
            # texts of fewer than 50 words, null and empty ones among them, and such as repeat themselves go
            assert all(r.text and len(words(r.text)) >= 50 for r in left)
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and out.count() == docs.count()


def test_shared_folder_of_a_cluster():
    from types import SimpleNamespace

    from wordloom.llm import common

    unset = SimpleNamespace(get=lambda *_: None, set=lambda *_: None)
    context = lambda master: SimpleNamespace(conf=unset, sparkContext=SimpleNamespace(master=master, getConf=lambda: unset))
    with pytest.raises(ValueError):
        common.shared_dir(context("yarn"))
    with pytest.raises(ValueError):
        common.shared_dir(context("local-cluster[2,1,1024]"))
    assert common.shared_dir(context("local[2]"))


def test_schema_of_odd_rows_has_clashing_names():
    assert {"n", "size", "score", "cid", "kept", "evidence"} <= {x.split()[0] for x in SCHEMA.split(", ")}
