"""N-gram Jaccard join: an exact metric-space join of documents on their word-shingle sets.

Jaccard distance d = 1 - J is a metric; two documents link when d <= r (r = 0.2 in production). The join works on classes
of equal sets, in rounds over the classes that are still open:

1. Sight. Order all shingles once, the same way everywhere (a bounded list of shingles common in a sample goes last, the rest
   follow their hash). Sets nearer than r + c share a shingle among the first n - ceil((1 - r - c) n) + 1 of each, where c is
   the cover radius, min(r, (1 - r) / 2). Unrelated texts all lie at distance 1, where no pivot tells them apart, so only
   classes that share such an anchor see each other. Classes without a possible partner drop out before sets are fetched:
   partners share at least m of their first n - ceil((1 - r) n) + m shingles, and m grows with n.
2. Pivots and Voronoi regions. A class that is the smallest at all of its anchors is a pivot; no two pivots share an anchor,
   so a group of near copies has about one. Every class that sees a pivot is measured against it, and those within the cover
   radius of one go to the region of the nearest. Links to pivots give components.
3. Windows. A region's own classes all link to its pivot, so they need no comparison with one another. A class at distance
   d(x, p) <= r + c from the pivot of another region is replicated there if d(x, p) <= d(x, its own pivot) + r (triangle
   inequality: of two linked classes one lies in the window of the other's region); classes without a region are guests of
   every pivot that near. Guests of the pivot's component drop out; the rest meet the region's own classes where their
   distances to the pivot differ by at most r.
4. Recursion. Classes with a region have then met all their partners and leave; the others get new pivots, for as long as a
   fifth of them finds a region. What is left lies in no ball: there the classes that share anchors with the same smallest
   class form a region, and all pairs across components meet inside it. Linked classes share more than (1 - r - (1 - r - c)) n
   anchors, n the smaller size; so each may leave out regions to which anchors below half that number bring it. Anchors shared by
   chance, which every class has more of the larger the table is, bring it nowhere then.

Inside a region classes meet in blocks of bounded number and bytes: a pair of blocks is compared at once, first by sizes, roots,
distances to the pivot and counts of shingles in SLOTS hash classes (which bound the distance from below: SLOTS disjoint
pivots), then exactly, so only links come out. Nothing is capped or sampled out; every possible pair is compared or excluded.

Defined cases: null or wordless text has an empty set, n_shingles 0, and stands alone; fewer words than n make one shingle
of the whole sequence; repeated rows are equal sets; rows with a null doc_id take part, but a component is named by its
smallest non-null doc_id (null if it has none); an empty table gives no rows. Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wordloom.llm import vectext as vt
from wordloom.llm.common import release, saved, ship, small_batches
from wordloom.llm.components import components

U64 = np.uint64
#: Ids of up to so many documents are broadcast (8 bytes each); more are joined by a shuffle.
BROADCAST_IDS = 2_000_000
#: Documents sampled to find common shingles, how often one must occur among them, and how many are listed at most.
SAMPLE_DOCS, COMMON_IN_SAMPLE, COMMON_MOST = 16_000, 3, 65_536
#: Anchors are dealt out by hash and meet in so many turns, and only the shuffle files of one turn are on disk.
TURNS = 4
#: Hash classes whose counts bound a distance; classes and bytes (about) in a block.
SLOTS, BLOCK_CLASSES, BLOCK_BYTES = 256, 256, 1_000_000


def shingles(hashes: np.ndarray, firsts: np.ndarray, width: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    factors = vt.splitmix(np.arange(width) + 77) | U64(1)
    n = len(hashes)
    window = np.zeros(max(0, n - width + 1), U64)
    for k in range(width):
        window += hashes[k : n - width + 1 + k] * factors[k] if len(window) else window
    window = vt.splitmix(window)
    for a, b in zip(firsts[:-1], firsts[1:], strict=True):
        if b - a >= width:
            yield np.unique(window[a : b - width + 1])
        elif b > a:
            part = hashes[a:b] * factors[: b - a]
            yield vt.splitmix(part.sum(dtype=U64, keepdims=True) + U64(int(b - a)))
        else:
            yield np.zeros(0, U64)


def _needed(n):
    """Anchors that a set of n shingles must share with another to be near it."""
    return 1 + n // 16


def class_key(s: np.ndarray) -> tuple[int, int]:
    """Two 64-bit numbers that equal sets share."""
    a = int(np.add.reduce(vt.splitmix(s + U64(len(s)))) if len(s) else 0)
    b = int(np.add.reduce(vt.splitmix(s ^ U64(0x5DEECE66D))) if len(s) else 0)
    return a, b


def _signed(values) -> pa.Array:
    return pa.array(np.array(values, U64).view(np.int64))


def _sets(batch, width: int):
    for i, _, data, offsets in vt.texts(batch.column("text")):
        hashes, firsts = vt.word_hashes(data, offsets)
        for k, s in enumerate(shingles(hashes, firsts, width)):
            yield i + k, s


def _common(docs: DataFrame, width: int) -> np.ndarray:
    """Shingles common in a sample, most common last; bounded by COMMON_MOST."""
    total = docs.count()
    if not total:
        return np.zeros(0, U64)
    parts = max(1, total // SAMPLE_DOCS)

    def count(batches):
        for batch in batches:
            found = [s for _, s in _sets(batch, width)]
            values, counts = np.unique(np.concatenate(found) if found else np.zeros(0, U64), return_counts=True)
            yield pa.RecordBatch.from_arrays([_signed(values), pa.array(counts.astype(np.int64))], ["s", "c"])

    sample = docs.filter(F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(parts)) == 0)
    top = sample.select("text").mapInArrow(count, "s long, c long").groupBy("s").agg(F.sum("c").alias("c"))
    rows = top.filter(F.col("c") >= COMMON_IN_SAMPLE).orderBy(F.desc("c"), "s").limit(COMMON_MOST).collect()
    return np.array([r.s for r in reversed(rows)], np.int64).view(U64)


def _ordered(s: np.ndarray, by_value: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """A sorted set in the global order: listed shingles last, the most common at the end."""
    if not len(by_value) or not len(s):
        return s
    at = np.minimum(np.searchsorted(by_value, s), len(by_value) - 1)
    late = by_value[at] == s
    return np.concatenate([s[~late], s[late][np.argsort(rank[at[late]], kind="stable")]]) if late.any() else s


def _scan(docs: DataFrame, width: int, percent: int, held) -> DataFrame:
    """doc_id, n, a, b (class key), anchors."""

    def scan(batches):
        by_value, rank = held.value
        for batch in batches:
            size, one, two, anchors, lengths = [], [], [], [], [0]
            for _, s in _sets(batch, width):
                n = len(s)
                size.append(n)
                a, b = class_key(s)
                one.append(a)
                two.append(b)
                s = _ordered(s, by_value, rank)[: n - (percent * n + 99) // 100 + _needed(n)] if n else s
                anchors.append(s)
                lengths.append(lengths[-1] + len(s))
            flat = np.concatenate(anchors) if anchors else np.zeros(0, U64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(np.array(size, np.int64)), _signed(one), _signed(two), pa.ListArray.from_arrays(pa.array(np.array(lengths, np.int32)), _signed(flat))],
                ["doc_id", "n", "a", "b", "anchors"],
            )

    return docs.select("doc_id", "text").mapInArrow(scan, "doc_id long, n long, a long, b long, anchors array<long>")


def _set_table(docs: DataFrame, width: int, sight: int, held) -> DataFrame:
    """cid, its set as bytes, its counts and the anchors within which it sees classes of similarity sight % and more."""

    def scan(batches):
        by_value, rank = held.value
        for batch in batches:
            one, two, size, sets, counts, anchors, lengths = [], [], [], [], [], [], [0]
            for _, s in _sets(batch, width):
                a, b = class_key(s)
                one.append(a)
                two.append(b)
                size.append(len(s))
                sets.append(s.tobytes())
                counts.append(np.minimum(np.bincount((s >> U64(20)) % U64(SLOTS), minlength=SLOTS), 255).astype(np.uint8).tobytes())
                s = _ordered(s, by_value, rank)[: len(s) - (sight * len(s) + 99) // 100 + 1] if len(s) else s
                anchors.append(s)
                lengths.append(lengths[-1] + len(s))
            flat = np.concatenate(anchors) if anchors else np.zeros(0, U64)
            seen = pa.ListArray.from_arrays(pa.array(np.array(lengths, np.int32)), _signed(flat))
            yield pa.RecordBatch.from_arrays([pa.array(np.array(size, np.int64)), _signed(one), _signed(two), pa.array(sets, pa.binary()), pa.array(counts, pa.binary()), seen], ["n", "a", "b", "shingles", "counts", "anchors"])

    rows = docs.select("text").mapInArrow(scan, "n long, a long, b long, shingles binary, counts binary, anchors array<long>")
    return rows.select(_cid().alias("cid"), "n", "shingles", "counts", "anchors")


def _cid():
    """One number for a class: equal for equal sets."""
    return F.xxhash64("n", "a", "b")


def _measure(pairs: DataFrame) -> DataFrame:
    """p, x, set_p, set_x -> p, x, inter, uni (sizes of intersection and union)."""

    def measure(batches):
        for batch in batches:
            inter, uni = [], []
            for a, b in zip(batch.column("set_p"), batch.column("set_x"), strict=True):
                s, t = np.frombuffer(a.as_buffer(), U64), np.frombuffer(b.as_buffer(), U64)
                if len(s) > len(t):
                    s, t = t, s
                same = int((t[np.minimum(np.searchsorted(t, s), len(t) - 1)] == s).sum()) if len(s) else 0
                inter.append(same)
                uni.append(len(s) + len(t) - same)
            yield pa.RecordBatch.from_arrays([batch.column("p"), batch.column("x"), pa.array(inter, pa.int64()), pa.array(uni, pa.int64())], ["p", "x", "inter", "uni"])

    return pairs.select("p", "x", "set_p", "set_x").mapInArrow(measure, "p long, x long, inter long, uni long")


def _meeting(rows: DataFrame) -> DataFrame:
    """Anchors at which different classes meet."""
    return rows.groupBy("anchor").agg(F.min("cid").alias("low"), F.max("cid").alias("high")).filter("low <> high").select("anchor")


def _members(spread: DataFrame) -> DataFrame:
    """The distinct rows of spread(anchor, cid, n) at anchors where different classes meet."""
    found = None
    for turn in range(TURNS):
        part = spread.filter(F.pmod("anchor", F.lit(TURNS)) == turn)
        part = saved(part.join(_meeting(part), "anchor").distinct(), "members")
        release(spread.sparkSession)
        found = part if found is None else found.union(part)
    return found


def jaccard_components(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of docs(doc_id, text); links need 100 * intersection >= percent * union."""
    spark = docs.sparkSession
    ship(spark)
    small_batches(spark)
    common = _common(docs, width)
    order = np.argsort(common)
    held = spark.sparkContext.broadcast((common[order], order))  # at most COMMON_MOST values
    release(spark)
    scan = saved(_scan(docs, width, percent, held), "jaccard")
    classes = scan.filter("n > 0").groupBy(_cid().alias("cid")).agg(F.min("doc_id").alias("first"))
    spread = scan.filter("n > 0").select(F.explode("anchors").alias("anchor"), _cid().alias("cid"), "n")
    members = _members(spread)
    # a partner has at least t n shingles, and so shares at least _needed(t n) anchors
    least = 1 + F.floor(F.ceil(F.col("n") * percent / 100) / 16)
    able = members.groupBy("cid", "n").agg(F.count("*").alias("met")).filter(F.col("met") >= least).select("cid")
    members = saved(members.join(able, "cid"), "members")
    members = members.join(_meeting(members), "anchor")
    able = members.groupBy("cid", "n").agg(F.count("*").alias("met")).filter(F.col("met") >= least).select("cid")
    wanted = saved(able, "wanted")
    release(spark)
    ids = saved(wanted.join(classes, "cid").select(F.col("first")).distinct(), "ids")
    ids = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    again = docs.select("doc_id", "text").join(ids, F.col("doc_id").eqNullSafe(F.col("first")), "left_semi")
    cover = min(100 - percent, percent // 2)
    sets = _set_table(again, width, percent - cover, held).join(wanted, "cid", "left_semi").dropDuplicates(["cid"])
    sets = saved(sets, "sets")
    release(spark)
    roots = _link(sets, percent, cover)
    release(spark)

    named = classes
    if roots is not None:
        named = classes.join(roots.withColumnRenamed("node", "cid"), "cid", "left")
        least = named.filter("root is not null").groupBy("root").agg(F.min("first").alias("least"))
        named = named.join(least, "root", "left").select("cid", F.coalesce("least", "first").alias("first"))
    out = scan.withColumn("cid", F.when(F.col("n") > 0, _cid())).select("doc_id", "n", "cid")
    out = out.join(named, "cid", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("first")).otherwise(F.col("doc_id")).alias("component_id"))


def _apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Shingles in which sets differ at least, by their counts."""
    return np.abs(a.astype(np.int16) - b.astype(np.int16)).sum(axis=-1, dtype=np.int64)


def _near(pairs: DataFrame, percent: int) -> DataFrame:
    """p, x of pairs(p, x, np, nx, counts_p, counts_x) that their counts do not rule out."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint8).reshape(-1, SLOTS) for k in ("counts_p", "counts_x"))
            apart = _apart(a, b)
            both = np.asarray(batch.column("np")) + np.asarray(batch.column("nx"))
            yield batch.select(["p", "x"]).filter(pa.array(100 * (both - apart) >= percent * (both + apart)))

    return pairs.select("p", "x", "np", "nx", "counts_p", "counts_x").mapInArrow(run, "p long, x long")


def _compared(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """p, x, inter, uni for those pairs(p, x) that may be near. Joins are written out on their own, so skewed sides can be split."""
    side = lambda k, *columns: sets.select(F.col("cid").alias(k), *[F.col(c).alias(f"{c}_{k}") for c in columns])
    held = pairs.join(side("x", "n", "counts"), "x").join(side("p", "n", "counts"), "p").withColumnsRenamed({"n_p": "np", "n_x": "nx"})
    near = _near(held.filter(_alike(percent)), percent)
    held = near.join(side("x", "shingles"), "x").join(side("p", "shingles"), "p")
    return saved(_measure(held.withColumnsRenamed({"shingles_x": "set_x", "shingles_p": "set_p"})), "measured")


def _alike(percent: int):
    return F.least("np", "nx") * 100 >= F.greatest("np", "nx") * percent


def _dealt(members: DataFrame, sets: DataFrame, name: str) -> DataFrame:
    """p, cid, root, d, block, blocks: a region's members(p, cid, root, d) dealt out to blocks of bounded number and bytes."""
    sized = members.join(sets.select("cid", "n"), "cid")
    total = sized.groupBy("p").agg(F.greatest(F.ceil(F.count("*") / BLOCK_CLASSES), F.ceil(F.sum("n") * 8 / BLOCK_BYTES)).alias("blocks"))
    return sized.join(total, "p").select("p", "cid", "root", "d", F.pmod(F.xxhash64("cid", F.lit(name)), F.col("blocks")).alias("block"), "blocks")


def _blocks(dealt: DataFrame, sets: DataFrame, name: str) -> DataFrame:
    """p, block, name: members dealt out to blocks, with their sets."""
    # blocks are numbered before sets are fetched, and a region's blocks are built by different tasks
    dealt = dealt.select("p", "cid", "root", "d", "block").join(sets.select("cid", "n", "counts", "shingles"), "cid").repartition("p", "block")
    row = F.struct("cid", "root", "n", "d", "counts", "shingles")
    return dealt.groupBy("p", "block").agg(F.sort_array(F.collect_list(row)).alias(name))


class _Block:
    """The classes of one block as arrays."""

    def __init__(self, rows: pa.StructArray):
        self.cid, self.root, self.n, self.d = (np.asarray(rows.field(k)) for k in ("cid", "root", "n", "d"))
        self.counts = np.frombuffer(b"".join(rows.field("counts").to_pylist()), np.uint8).reshape(-1, SLOTS)
        self.sets = [np.frombuffer(x.as_buffer(), U64) for x in rows.field("shingles")]


def _met(one: _Block, two: _Block, reach: float, percent: int, same: bool) -> list[tuple[int, int]]:
    """Links across the components of two blocks, as few as say the same: a link joins its ends' components for the rest."""
    out = []
    left = one.root.copy()
    right = left if same else two.root.copy()
    for i in range(len(one.cid)):
        fits = (right != left[i]) & (np.abs(two.d - one.d[i]) <= reach + 1e-9)
        fits &= np.minimum(two.n, one.n[i]) * 100 >= np.maximum(two.n, one.n[i]) * percent
        if same:
            fits[: i + 1] = False
        at = np.flatnonzero(fits)
        if len(at):
            apart, both = _apart(two.counts[at], one.counts[i]), two.n[at] + one.n[i]
            near = 100 * (both - apart) >= percent * (both + apart)
            at = at[near][np.argsort(apart[near], kind="stable")]
        for j in at:
            if right[j] == left[i]:
                continue
            s, t = one.sets[i], two.sets[j]
            if len(s) > len(t):
                s, t = t, s
            inter = int((t[np.minimum(np.searchsorted(t, s), len(t) - 1)] == s).sum())
            if 100 * inter >= percent * (len(s) + len(t) - inter):
                out.append((one.cid[i], two.cid[j]))
                old, new = right[j], left[i]
                left[left == old] = new
                right[right == old] = new
    return out


def _joined(own: DataFrame, guests: DataFrame | None, sets: DataFrame, reach: float, percent: int) -> DataFrame:
    """a, b: links within regions, of own(p, cid, root, d) with guests, or of own with own where guests is None."""

    def run(batches):
        last, held = None, None
        for batch in batches:
            for p, block, same, own, guests in zip(*(batch.column(k) for k in range(5)), strict=True):
                if (p.as_py(), block.as_py()) != last:
                    last, held = (p.as_py(), block.as_py()), _Block(own.values)
                found = _met(held, held if same.as_py() else _Block(guests.values), reach, percent, same.as_py())
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.int64())], ["a", "b"])

    met = lambda pairs, same: saved(pairs.select("p", "block", same.alias("same"), "own", "guests").mapInArrow(run, "a long, b long"), "links")
    mine = _dealt(own, sets, "own")
    if guests is not None:
        two = _blocks(_dealt(guests, sets, "guests"), sets, "guests").toDF("p", "other", "guests")
        return met(_blocks(mine, sets, "own").join(two, "p"), F.lit(False))
    # nearly all regions are one block, which needs no partner and so no further shuffle of sets
    mine = saved(mine, "dealt")
    alone = _blocks(mine.filter("blocks = 1"), sets, "own")
    links = met(alone.withColumn("guests", F.slice("own", 1, 0)), F.lit(True))
    large = mine.filter("blocks > 1")
    if not large.limit(1).count():
        return links
    one = _blocks(large, sets, "own")
    pairs = one.join(one.toDF("p", "other", "guests"), "p").filter("block <= other")
    return met(pairs, F.col("block") == F.col("other")).union(links)


def _roots(links: DataFrame) -> DataFrame:
    """node, root: a node that is linked with it, directly or over others; nodes of one root are in one component.

    Two steps towards the smallest node reachable: enough to know most pairs that need no comparison.
    """
    both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct()
    first = both.groupBy("a").agg(F.least(F.min("b"), F.min("a")).alias("root"))
    over = both.join(first.select(F.col("a").alias("b"), F.col("root").alias("far")), "b").groupBy("a").agg(F.min("far").alias("far"))
    return saved(first.join(over, "a").select(F.col("a").alias("node"), F.least("root", "far").alias("root")), "roots")


def _led(rows: DataFrame) -> DataFrame:
    """p, cid, shared: at how many anchors of a class in rows(cid, anchor) another, or itself, is the smallest class."""
    low = rows.groupBy("anchor").agg(F.min("cid").alias("p"))
    return rows.join(low, "anchor").groupBy("p", "cid").agg(F.count("*").alias("shared"))


def _needful(led: DataFrame, sets: DataFrame, percent: int, sight: int) -> DataFrame:
    """p, cid of led(p, cid, shared) without regions that classes can miss, those first to which the fewest anchors bring them.

    With similarities t = percent % and s = sight %, linked classes share more than (t - s) m anchors, m the smaller size. A class of n
    shingles leaves out (t - s) t n / 2 anchors at most, two linked ones (t - s) m: one anchor at least brings both to one region.
    """
    w = Window.partitionBy("cid").orderBy("shared", "p").rowsBetween(Window.unboundedPreceding, 0)
    held = led.join(sets.select("cid", "n"), "cid").withColumn("out", F.sum("shared").over(w))
    return held.filter(F.col("out") * 20_000 > F.col("n") * ((percent - sight) * percent)).select("p", "cid")


def _link(sets: DataFrame, percent: int, cover: int) -> DataFrame | None:
    """Component roots of the classes in sets(cid, n, shingles, counts, anchors); None if there are none."""
    reach, cover, tiny = 1 - percent / 100, cover / 100, 1e-9
    sight = percent - round(100 * cover)
    rows = sets.select("cid", "n", F.explode("anchors").alias("anchor"))
    # partners share at least so many anchors; one that shares fewer with all classes has none
    least = F.ceil(F.col("n") * percent / 100) - F.ceil(F.col("n") * sight / 100) + 1
    able = rows.join(_meeting(rows), "anchor").groupBy("cid", "n").agg(F.count("*").alias("met")).filter(F.col("met") >= least).select("cid")
    able = saved(able, "able")
    release(sets.sparkSession)
    rows = rows.join(able, "cid", "left_semi").select("cid", "anchor")
    links = roots = None
    more = True
    while True:
        rows = saved(rows.join(_meeting(rows), "anchor"), "open")
        release(sets.sparkSession)
        led = saved(_led(rows), "led")
        release(sets.sparkSession)
        left = rows.select("cid").distinct().count()
        if not left:
            break
        if not more:
            named = _needful(led, sets, percent, sight)
            named = named if roots is None else named.join(roots.withColumnRenamed("node", "cid"), "cid", "left")
            named = named.select("p", "cid", (F.lit(None).cast("long") if roots is None else F.col("root")).alias("root"), F.lit(0.0).alias("d")).withColumn("root", F.coalesce("root", "cid"))
            mixed = named.groupBy("p").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low <> high").select("p")
            links = _joined(named.join(mixed, "p", "left_semi"), None, sets, reach, percent).union(links)
            break
        pivots = led.groupBy("cid").agg(F.min("p").alias("p"), F.max("p").alias("high")).filter("cid = p and p = high").select("p")
        found = _compared(led.join(pivots, "p", "left_semi").filter("p <> cid").select("p", F.col("cid").alias("x")), sets, sight)
        near = found.filter(F.col("inter") * 100 >= F.col("uni") * percent).select(F.col("p").alias("a"), F.col("x").alias("b"))
        links = near if links is None else links.union(near)
        roots = _roots(links)
        distance = found.select("p", F.col("x").alias("cid"), (1 - F.col("inter") / F.col("uni")).alias("d"))
        close = distance.filter(F.col("d") <= cover + tiny).groupBy("cid").agg(F.min(F.struct("d", "p")).alias("home")).select("cid", F.col("home.p").alias("home"), F.col("home.d").alias("dh"))
        close = saved(close, "homes")
        guests = distance.filter(F.col("d") <= reach + cover + tiny).join(close, "cid", "left").filter("home is null or home <> p").filter(F.col("home").isNull() | (F.col("d") <= F.col("dh") + reach + tiny))
        of = lambda k: roots.select(F.col("node").alias(k), F.col("root").alias(f"root_{k}"))
        guests = guests.join(of("cid"), "cid", "left").join(of("p"), "p", "left")
        guests = guests.select("p", "cid", F.coalesce("root_cid", "cid").alias("root"), F.coalesce("root_p", "p").alias("root_p"), "d").filter("root <> root_p").drop("root_p")
        guests = saved(guests, "guests")
        release(sets.sparkSession)
        own = close.select(F.col("home").alias("p"), "cid", F.col("dh").alias("d")).join(roots.withColumnRenamed("node", "cid"), "cid").select("p", "cid", "root", "d").join(guests.select("p").distinct(), "p", "left_semi")
        links = links.union(_joined(own, guests, sets, reach, percent))
        more = close.count() * 5 >= left
        rows = rows.join(close.select("cid").union(pivots).distinct(), "cid", "left_anti")
    return None if links is None else components(links)


def keep_one(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs whose doc_id names their component, one row for each doc_id and set; rows with a null doc_id stay.

    Documents without words link with nothing and stay.
    """
    found = jaccard_components(docs.select("doc_id", "text"), width, percent)
    chosen = found.filter("doc_id = component_id").select("doc_id").distinct()
    kept = docs.join(chosen, "doc_id", "left_semi").union(docs.filter("doc_id is null"))
    repeated = docs.filter("doc_id is not null").groupBy("doc_id").count().filter("count > 1").select("doc_id")
    if repeated.limit(1).count():
        again = kept.join(repeated, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
        kept = kept.join(repeated, "doc_id", "left_anti").select(*docs.columns).union(again.select(*docs.columns))
    return kept.select(*docs.columns)
