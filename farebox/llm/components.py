"""Connected components of a large link table by alternating star rounds, each a few shuffles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from farebox.session import cut


def _star(links: DataFrame, large: bool) -> DataFrame:
    """Point neighbours at the least node around each node: those above it (large), or those below and itself.

    `links` holds each pair once with a > b. The least neighbour is found with a partial step in each task; a hub's
    links are then joined to it, which Spark may split over tasks. Files of links can be far smaller than their rows, so
    neither side is left to be broadcast for its file's size.
    """
    around = links.union(links.select("b", "a")) if large else links
    least = around.groupBy("a").agg(F.min("b").alias("least")).hint("merge")
    if large:
        pointed = around.join(least, "a").select(F.col("b").alias("a"), F.least("a", "least").alias("b"), F.col("a").alias("mid"))
        pointed = pointed.where("a > mid").select("a", "b")
    else:
        pointed = links.join(least, "a").select(F.col("b").alias("a"), F.col("least").alias("b")).union(least)
    return pointed.where("a > b").distinct()


def components(pairs: DataFrame) -> DataFrame:
    """`node, root` for every node of `a, b`: root is the least node reachable. Null ends and self links say nothing.

    Every round is written to the shared folder and read back; it ends when a round changes no link.
    """
    a, b = pairs.columns
    links = cut(
        pairs.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b"))
        .where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("a") > F.col("b"))).distinct(),
        "links",
    )
    state = None
    while True:
        seen = links.agg(
            F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.min("a"), F.max("b")
        ).first()
        if seen == state or not seen[0]:
            break
        state = seen
        links = cut(_star(_star(links, True), False), "links")
    return links.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
        links.select("b", "b").distinct().toDF("node", "root")
    )
