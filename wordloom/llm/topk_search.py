"""Exact top-k inner-product search over an impact-ordered, score-at-a-time index.

Vectors are numbers of whole units (floor of a scaled component). The index holds them in blocks. A block quantises every
component to an impact (a whole multiple of the block's step, at most LEVELS of them) and keeps one posting segment per
dimension and impact: the sorted places of the vectors that have it. A block of queries takes the segments in descending
size of impact, adding query weight times impact to the accumulators of a segment's vectors. After a level of impacts,
Cauchy-Schwarz bounds what the segments not yet taken and the rounding can still change: a query's k-th best lower bound then
proves which vectors may belong to its result. Processing stops when scoring those exactly costs less than the segments
left; possible members are scored exactly, in whole numbers. With a step of one unit and no segment left the accumulators are
the scores. Blocks' results merge by rank.

Every block of queries (the stated query set) meets every block of vectors once, by an equality join on the block number;
nothing is broadcast.

Defined cases: vectors that are null or empty or hold null or non-finite components take no part, nor do rows with a null id;
rows with one id are rows of their own, as queries and as candidates, and only the query's own row is no candidate; vectors of
other lengths than the query's are no candidates; equal scores rank by the smaller id; fewer than k candidates give them all;
units and scores beyond 64 bits are held at the largest 64-bit number of their sign; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wordloom.llm.common import saved, ship, small_batches

#: Vectors and queries in a block (about; by hash), impacts a component may have, accumulators (queries) of one pass.
VECTORS, QUERIES, LEVELS, PASS = 8192, 512, 128, 128
#: Cost of scoring a possible member exactly, per component, and of a look at all bounds, in postings.
RESCORE, LOOK = 6, 16


def _units(embedding: Column, scale: int) -> Column:
    """Whole units of each component, or null where the vector takes no part."""
    value = F.transform(embedding, lambda x: x.cast("double") * scale)
    # NaN counts as larger than any number here; what overflows when scaled is still finite before
    fine = F.forall(embedding, lambda x: F.coalesce(F.abs(x.cast("double")) < float("inf"), F.lit(False)))
    return F.when((F.size(embedding) > 0) & fine, F.transform(value, lambda x: F.floor(x)))


def _pack(rows: DataFrame, block: Column, name: str) -> DataFrame:
    """One row a block and length: rows' numbers, ids and units as bytes."""
    grouped = rows.groupBy(block.alias(name), F.size("units").alias("dims")).agg(F.collect_list(F.struct("row", "vec_id", "units")).alias("rows"))

    def run(batches):
        for batch in batches:
            numbers, ids, units = [], [], []
            for found in batch.column(2):
                values = found.values
                numbers.append(np.asarray(values.field("row")).astype("<i8").tobytes())
                ids.append(np.asarray(values.field("vec_id")).astype("<i8").tobytes())
                units.append(np.asarray(values.field("units").flatten()).astype("<i8").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(x, pa.binary()) for x in (numbers, ids, units))], [name, "dims", "numbers", "ids", "units"])

    return grouped.mapInArrow(run, f"{name} long, dims int, numbers binary, ids binary, units binary")


def _kind(most: float) -> type:
    """The smallest type that holds sums up to most."""
    return np.int16 if most < 2**15 else np.int32 if most < 2**31 else np.int64 if most < 2**62 else object


class Index:
    """One block of vectors: posting segments by size of impact, and the norms of what is left after each size."""

    def __init__(self, numbers: np.ndarray, ids: np.ndarray, units: np.ndarray):
        self.numbers, self.ids, self.units = numbers, ids, units
        self.norm = float(np.sqrt((units.astype(np.float64) ** 2).sum(axis=1)).max(initial=0.0))
        most = max(1, *(abs(int(x)) for x in (units.min(), units.max()))) if units.size else 1
        step = 1
        while 2 * (most // step) + 1 > LEVELS:
            step *= 2
        level = np.floor_divide(units, step)
        impact = level * step + step // 2
        # sizes are powers of two of the step: 0 for no impact, which needs no posting
        size = np.ceil(np.log2(np.abs(impact).astype(np.float64) / step + 1)).astype(np.int64)
        rest = units.astype(np.float64)
        self.bands: list[tuple[list[tuple[int, int, np.ndarray]], np.ndarray, int]] = []
        for band in range(int(size.max(initial=0)), 0, -1):
            own = size == band
            rest = np.where(own, units.astype(np.float64) - impact, rest)
            segments = []
            for dim in range(units.shape[1]):
                at = np.flatnonzero(own[:, dim])
                if not len(at):
                    continue
                value = impact[at, dim]
                order = np.argsort(value, kind="stable")
                at, value = at[order], value[order]
                cut = np.flatnonzero(np.append(True, value[1:] != value[:-1]))
                segments += [(dim, int(value[a]), at[a:b]) for a, b in zip(cut, [*cut[1:], len(at)], strict=True)]
            left = int((size < band).sum() - (size == 0).sum())
            self.bands.append((segments, np.sqrt((rest * rest).sum(axis=1)), left))

    def search(self, queries: np.ndarray, own: np.ndarray, k: int):
        """Query places, vector places and scores of each query's k best; own: the queries' row numbers, which are no candidates."""
        parts = [self._pass(queries[a : a + PASS], own[a : a + PASS], k) for a in range(0, len(queries), PASS)]
        return (np.concatenate([p[0] + PASS * i for i, p in enumerate(parts)]), *(np.concatenate([p[j] for p in parts]) for j in (1, 2)))

    def _pass(self, queries: np.ndarray, own: np.ndarray, k: int):
        n, norm = len(self.ids), np.sqrt((queries.astype(np.float64) ** 2).sum(axis=1)) * (1 + 1e-9)
        most = (self.norm + (self.bands[0][1].max(initial=0.0) if self.bands else 0.0)) * float(norm.max(initial=0.0))
        kind = _kind(most + 1)
        weight = np.ascontiguousarray(queries.T.astype(kind))
        sums = np.zeros((n, len(queries)), kind)
        order = np.argsort(self.numbers, kind="stable")
        at = np.minimum(np.searchsorted(self.numbers, own, sorter=order), n - 1)
        mine = np.flatnonzero(self.numbers[order[at]] == own)
        place = order[at[mine]]
        possible = None
        for segments, rest, left in self.bands:
            for dim, impact, vectors in segments:
                sums[vectors] += weight[dim] * kind(impact) if kind is not object else weight[dim] * impact
            exact = not left and not rest.any()
            # a look pays only when it may spare more than it costs; at the end it is needed unless all is exact
            if n <= k or exact or kind is object or (left and left / n < LOOK) or (left and 8 * rest.mean() > self.norm):
                continue
            possible = self._possible(sums, rest, norm, mine, place, k, 1e-6 + 1e-14 * most)
            if left and possible.sum() * queries.shape[1] * RESCORE <= left * len(queries):
                break
        else:
            if not self.bands or (not left and not rest.any()):
                return self._best(sums, mine, place, k)
        if possible is None:
            possible = np.ones((n, len(queries)), bool)
            possible[place, mine] = False
        v, q = np.nonzero(possible)
        score = np.empty(len(q), object if kind is object else np.int64)
        for a in range(0, len(q), 65_536):
            part = slice(a, a + 65_536)
            if kind is object:
                score[part] = (queries[q[part]].astype(object) * self.units[v[part]].astype(object)).sum(axis=1)
            else:
                score[part] = np.einsum("ij,ij->i", queries[q[part]], self.units[v[part]])
        return self._ranked(q, v, score, k)

    def _possible(self, sums, rest, norm, mine, place, k: int, rounding: float) -> np.ndarray:
        """Which vectors may be among a query's k best, by what can still be added or taken."""
        margin = rest[:, None] * norm[None, :] + rounding
        seen = sums.astype(np.float64)
        low = seen - margin
        low[place, mine] = -np.inf
        n = len(low)
        kth = np.partition(low, n - k, axis=0)[n - k]
        out = seen + margin >= kth[None, :]
        out[place, mine] = False
        return out

    def _best(self, sums, mine, place, k: int):
        """The k best of sums that are the scores."""
        n = len(sums)
        if n > k + 1 and sums.dtype != object:
            sums = sums.T.copy()
            low = np.iinfo(sums.dtype).min
            sums[mine, place] = low
            kth = np.partition(sums, n - k, axis=1)[:, n - k]
            q, v = np.nonzero((sums >= kth[:, None]) & (sums > low))
            return self._ranked(q, v, sums[q, v].astype(np.int64), k)
        fine = np.ones(sums.shape, bool)
        fine[place, mine] = False
        v, q = np.nonzero(fine)
        return self._ranked(q, v, sums[v, q] if sums.dtype == object else sums[v, q].astype(np.int64), k)

    def _ranked(self, q, v, score, k: int):
        if score.dtype == object:
            score = np.array([min(max(int(x), -(2**63)), 2**63 - 1) for x in score], np.int64)
        order = np.lexsort((self.ids[v], ~score, q))
        q, v, score = q[order], v[order], score[order]
        keep = np.arange(len(q)) - np.searchsorted(q, q) < k
        return q[keep], v[keep], score[keep]


def top_k(vectors: DataFrame, is_query: Column, k: int = 20, scale: int = 64) -> DataFrame:
    """query_id, rank, vec_id, score: the k best of vectors(vec_id, embedding) for each row where is_query holds."""
    ship(vectors.sparkSession)
    small_batches(vectors.sparkSession, 4)
    rows = vectors.filter("vec_id is not null").select("vec_id", _units(F.col("embedding"), scale).alias("units")).filter("units is not null")
    rows = saved(rows.withColumn("row", F.monotonically_increasing_id()), "vectors")
    queries = rows.filter(is_query)
    blocks, heads = max(1, round(rows.count() / VECTORS)), max(1, round(queries.count() / QUERIES))
    hashed = lambda n: F.pmod(F.xxhash64("row", "vec_id"), F.lit(n)).cast("long")
    index = _pack(rows, hashed(blocks), "block")
    asked = _pack(queries, hashed(heads), "head").select("dims", F.col("numbers").alias("q_numbers"), F.col("ids").alias("q_ids"), F.col("units").alias("q_units"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block"))
    pairs = index.join(asked, ["block", "dims"]).select("block", "dims", "numbers", "ids", "units", "q_numbers", "q_ids", "q_units")

    def run(batches):
        last, held = None, None
        for batch in batches:
            for block, dims, *found in zip(*(batch.column(i) for i in range(8)), strict=True):
                numbers, ids, units, q_numbers, q_ids, q_units = (np.frombuffer(x.as_buffer(), "<i8") for x in found)
                shape = (-1, dims.as_py())
                if (block.as_py(), shape) != last:
                    last = (block.as_py(), shape)
                    held = Index(numbers, ids, units.reshape(shape))
                q, v, score = held.search(q_units.reshape(shape), q_numbers, k)
                yield pa.RecordBatch.from_arrays([pa.array(q_numbers[q]), pa.array(q_ids[q]), pa.array(held.ids[v]), pa.array(score)], ["query", "query_id", "vec_id", "score"])

    found = pairs.mapInArrow(run, "query long, query_id long, vec_id long, score long")
    order = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
