"""Mixing sources to target weights: blocks of tokens, drawn per output shard and joined by index.

Every source's documents form one stream of words, cut into blocks of a fixed length. A source fills as many slots as its
target holds of its blocks. The slots are thrown over the output shards, a multinomial draw of source counts per shard
given the totals (so totals stay exact); slot j of a source is mapped to a block by a swap-or-not permutation of its block
numbers, a new one for every pass over them; slots and blocks join by that number. Everything is DataFrame functions, seeded
by hashes alone, so reruns agree however rows are dealt out.

Stream offsets are sums over hashed buckets of a source, as many as its documents need, then over its buckets, so a source
with a third of all rows is never sorted in one task. Balls are drawn and slots made from short stretches dealt over as many
tasks as their number needs. No block is used more than twice, so no document exceeds twice its size.

Defined cases: null or wordless text has size 0 and takes 0; null is a source of its own, last; sources without words have
target 0; rows with null or repeated ids count as separate documents; an empty table gives no rows; further columns do not matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wordloom.llm.common import SPACES, packed, saved

#: Words in a block, slots in an output shard (about), documents in a bucket (about), rounds of a permutation, slots made by a task (about).
BLOCK, SHARD_SLOTS, BUCKET_DOCS, ROUNDS, TASK_SLOTS = 64, 4_096, 1_024, 20, 50_000
WEIGHTS, SHARE, MOST = (5, 2, 1), 1.5, 2
SEED = 20


def n_words(text: Column) -> Column:
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(trimmed == "", 0).otherwise(F.size(F.split(trimmed, "[ \\t-\\r]+"))).cast("long")


def targets(sizes: DataFrame) -> DataFrame:
    """source, source_size -> and number (from 0), weight, target: weights share SHARE of all words, none above MOST times its size.

    One row a source; sources are few. Those whose cap lies under their share are full; the level is what the others get a weight.
    """
    everything = Window.partitionBy()
    order = Window.orderBy(F.col("source").asc_nulls_last())
    named = sizes.withColumn("number", F.row_number().over(order) - 1)
    named = named.withColumn("weight", F.get(F.array(*map(F.lit, WEIGHTS)), F.col("number") % len(WEIGHTS)).cast("double"))
    named = named.withColumn("cap", (MOST * F.col("source_size")).cast("double"))
    before = Window.orderBy(F.col("cap") / F.col("weight"), "number").rowsBetween(Window.unboundedPreceding, -1)
    level = (SHARE * F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    # in this order all sources before the first that is not full are full; its level holds for the rest
    named = named.withColumn("level", level).withColumn("order", F.struct((F.col("cap") / F.col("weight")).alias("at"), "number", "level"))
    named = named.withColumn("level", F.min(F.when(F.col("cap") > F.col("level") * F.col("weight"), F.col("order"))).over(everything)["level"])
    named = named.withColumn("full", F.coalesce(F.col("cap") <= F.col("level") * F.col("weight"), F.lit(True)))
    return named.select(*sizes.columns, "number", F.when(F.col("full"), F.col("cap")).otherwise(F.col("level") * F.col("weight")).alias("target"))


def permuted(x: Column, n: Column, *seed: Column) -> Column:
    """x's image under a pseudorandom permutation of 0..n-1 (swap-or-not: each round pairs x with k - x and a hash decides).

    Rounds are one fold: as projections, one on another, they would have the optimiser expand every earlier round.
    """

    def step(at: Column, r: Column) -> Column:
        other = F.pmod(F.pmod(F.xxhash64(F.lit(SEED), r, *seed), n) - at, n)
        return F.when(F.xxhash64(r, F.greatest(at, other), *seed) % 2 == 0, other).otherwise(at)

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), x.cast("long"), step)


def _offsets(rows: DataFrame) -> DataFrame:
    """rows(row, number, size, tie, docs...) with at: words of the same source before the row; docs: rows of the source."""
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "tie"), F.ceil(F.col("docs") / BUCKET_DOCS)))
    inside = Window.partitionBy("number", "bucket").orderBy("doc_id", "tie", "row").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    whole = rows.groupBy("number", "bucket").agg(F.sum("size").alias("words"))
    ahead = Window.partitionBy("number").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    whole = whole.select("number", "bucket", F.coalesce(F.sum("words").over(ahead), F.lit(0)).alias("ahead"))
    return rows.join(whole, ["number", "bucket"]).withColumn("at", F.col("inside") + F.col("ahead"))


def slots(sources: DataFrame) -> DataFrame:
    """number, shard, block for every slot of every source(number, source_size, target)."""
    blocks = F.ceil(F.col("source_size") / BLOCK)
    fill = F.least(F.round(F.col("target") * blocks / F.col("source_size")), MOST * blocks).cast("long")
    own = sources.filter("source_size > 0").select("number", blocks.alias("blocks"), fill.alias("fill")).filter("fill > 0")
    total = own.agg(F.sum("fill")).first()[0] or 0
    shards, tasks = max(1, -(-total // SHARD_SLOTS)), max(1, -(-total // TASK_SLOTS))
    step = 4096
    # stretches of balls are dealt over the tasks before they are thrown
    balls = own.withColumn("first", F.explode(F.sequence(F.lit(0).cast("long"), F.col("fill") - 1, F.lit(step).cast("long")))).repartition(tasks, "number", "first")
    balls = balls.withColumn("ball", F.explode(F.sequence("first", F.least(F.col("first") + step - 1, F.col("fill") - 1))))
    drawn = balls.withColumn("shard", F.pmod(F.xxhash64(F.lit(SEED), "number", "ball"), F.lit(shards))).groupBy("number", "blocks", "shard").agg(F.count("*").alias("count"))
    before = Window.partitionBy("number").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    drawn = saved(drawn.withColumn("before", F.coalesce(F.sum("count").over(before), F.lit(0)).cast("long")), "shards")
    # a source that fills most of a shard holds no more than about SHARD_SLOTS of its slots
    slot = drawn.repartition(tasks, "number", "shard").withColumn("slot", F.explode(F.sequence("before", F.col("before") + F.col("count") - 1)))
    return slot.select("number", "shard", permuted(F.col("slot") % F.col("blocks"), F.col("blocks"), F.col("number"), F.floor(F.col("slot") / F.col("blocks"))).alias("block"))


def _mixed(docs: DataFrame, *keep: str) -> DataFrame:
    """mix() with number, at: a row's source and place in its source's stream, null where size is 0."""
    columns = list(dict.fromkeys(["doc_id", "source", *keep]))
    rows = saved(docs.select(*columns, n_words(F.col("text")).alias("size"), F.xxhash64("text").alias("tie"), F.monotonically_increasing_id().alias("row")), "mix")
    counted = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("docs"))
    sources = saved(targets(counted), "targets")
    bare = rows.select("row", "doc_id", "source", "size", "tie").filter("size > 0")
    named = bare.join(sources.select(F.col("source").alias("s"), "number", "docs"), F.col("source").eqNullSafe(F.col("s"))).select("row", "doc_id", "size", "tie", "number", "docs")
    placed = _offsets(named).select("row", "number", "at", "size")
    first, end = F.floor(F.col("at") / BLOCK), F.col("at") + F.col("size")
    pieces = placed.withColumn("block", F.explode(F.sequence(first, F.floor((end - 1) / BLOCK))))
    pieces = pieces.select("row", "number", "block", "at", (F.least(end, (F.col("block") + 1) * BLOCK) - F.greatest("at", F.col("block") * BLOCK)).alias("words"))
    # both come out of explode, whose rows Spark does not foresee: without the hints it would broadcast them
    used = slots(sources).groupBy("number", "block").agg(F.count("*").alias("times")).hint("merge")
    taken = pieces.join(used, ["number", "block"]).groupBy("row").agg(F.sum(F.col("words") * F.col("times")).alias("taken"), F.min("at").alias("at")).hint("merge")
    out = rows.join(taken, "row", "left").join(sources.select(F.col("source").alias("s"), "number", "source_size", "target"), F.col("source").eqNullSafe(F.col("s")))
    return out.select(*keep, "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "number", "at")


def mix(docs: DataFrame, *keep: str) -> DataFrame:
    """keep columns of docs(doc_id, text, source), size, source_size, target, taken."""
    return _mixed(docs, *keep).drop("number", "at")


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The rows of docs, each taken / size times (0, 1 or 2): rounded down, and up with the fraction as probability.

    A hash of the row's place in its source's stream decides, so sources meet their targets on average, whatever their documents' sizes.
    """
    out = _mixed(packed(docs, "doc_id", "text", "source"), "_row")
    more = F.pmod(F.xxhash64(F.lit(SEED), "number", "at"), F.col("size")) < F.col("taken") % F.col("size")
    copies = F.when(F.col("taken") > 0, F.floor(F.col("taken") / F.col("size")) + more.cast("int")).otherwise(0)
    return out.withColumn("copy", F.explode(F.array_repeat(F.lit(1), copies.cast("int")))).select("_row.*")
