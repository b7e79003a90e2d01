"""Connected components of a link table, without gathering it anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordloom.llm.common import saved


def components(links: DataFrame) -> DataFrame:
    """links(a, b) -> (node, root): root is the smallest node reachable.

    Every round gives each node the smallest root of its neighbourhood and then that root's own root, which doubles the reach
    of a chain; each round is written to the shared folder, so lineage stays short. Roots only fall, so an unchanged sum means
    that none has changed. A node's links are only ever pre-aggregated minima, so a node with very many links is no hot spot.
    """
    both = saved(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct(), "links")
    now = saved(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.min("a")).alias("root")), "roots")
    total = None
    while True:
        before, total = total, now.agg(F.sum(F.col("root").cast("decimal(38,0)"))).first()[0]
        if before == total:
            return now
        around = both.join(now, F.col("b") == F.col("node")).groupBy("a").agg(F.min("root").alias("near"))
        low = now.join(around, F.col("node") == F.col("a")).select("node", F.least("root", "near").alias("low"))
        now = saved(low.join(now.select(F.col("node").alias("at"), F.col("root").alias("far")), F.col("low") == F.col("at"), "left").select("node", F.coalesce(F.least("far", "low"), "low").alias("root")), "roots")
