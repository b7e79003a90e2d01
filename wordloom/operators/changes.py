"""Snapshots, their differences and approval gates (ST-*, AG-16, JN-8)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def set_hash(column: str):
    """SHA-256 over the sorted lines of a group (AG-16)."""
    return F.sha2(F.concat(F.array_join(F.array_sort(F.collect_list(column)), "\n"), F.lit("\n")), 256)


def canonical(*columns: str):
    """JSON with fields in name order (ST-9)."""
    return F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"})


def difference(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """key, kind (added, removed, changed), before, after as canonical JSON, compared null-safely (ST-1, ST-2)."""
    rest = [c for c in before.columns if c != key]
    a = before.select(key, canonical(*rest).alias("before"))
    b = after.select(key, canonical(*rest).alias("after"))
    rows = a.join(b, key, "full").filter(~F.col("before").eqNullSafe(F.col("after")))
    kind = F.when(F.col("before").isNull(), "added").when(F.col("after").isNull(), "removed").otherwise("changed")
    return rows.select(key, kind.alias("kind"), "before", "after")


def gate(changes: DataFrame, allowed: DataFrame, key: str) -> DataFrame:
    """key, problem: changes nobody approved, approvals nothing needs, and repeated approvals (ST-3); empty means pass."""
    both = [key, "before", "after"]
    on = lambda a, b: a.join(b, [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in both], "left_anti")
    a, b = changes.select(*both), allowed.select(*both)
    unapproved = on(a.alias("a"), b.alias("b")).select(key, F.lit("unapproved").alias("problem"))
    stale = on(b.alias("a"), a.alias("b")).select(key, F.lit("stale").alias("problem"))
    again = b.groupBy(*both).count().filter("count > 1").select(key, F.lit("duplicate").alias("problem"))
    return unapproved.union(stale).union(again)


def wrong_transitions(rows: DataFrame) -> DataFrame:
    """Rows(form, before, after, remove, add) where (before - remove) + add is not after (ST-4)."""
    expected = F.array_sort(F.array_union(F.array_except("before", "remove"), F.col("add")))
    return rows.filter(expected != F.array_sort("after"))


def invalid_points(snapshot: DataFrame) -> DataFrame:
    """form, problem of a snapshot(form, points): out of range, out of order, repeated forms (ST-5)."""
    outside = snapshot.filter(F.exists("points", lambda p: (p < 1) | (p >= F.length("form")))).select("form", F.lit("range").alias("problem"))
    order = snapshot.filter(F.array_sort(F.array_distinct("points")) != F.col("points")).select("form", F.lit("order").alias("problem"))
    again = snapshot.groupBy("form").count().filter("count > 1").select("form", F.lit("repeated").alias("problem"))
    return outside.union(order).union(again)


def conflicting_labels(labels: DataFrame, key: str, label: str) -> DataFrame:
    """Keys with more than one label (SNK-7)."""
    return labels.groupBy(key).agg(F.count_distinct(label).alias("n"), F.array_sort(F.collect_set(label)).alias("labels")).filter("n > 1").select(key, "labels")


def routing_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """Counts of a routing diff(form, language, human): gained, lost, changed and lost against the human (ST-7)."""
    rows = before.select("form", F.col("language").alias("a"), "human").join(after.select("form", F.col("language").alias("b")), "form", "full")
    return rows.agg(
        F.count_if(F.col("a").isNull() & F.col("b").isNotNull()).alias("gained"),
        F.count_if(F.col("a").isNotNull() & F.col("b").isNull()).alias("lost"),
        F.count_if(F.col("a") != F.col("b")).alias("changed"),
        F.count_if((F.col("a") == F.col("human")) & ~F.col("b").eqNullSafe(F.col("human"))).alias("lost_human"),
    )
