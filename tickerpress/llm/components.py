"""Connected components of a link table, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickerpress.session import write_through


def components(links: DataFrame) -> DataFrame:
    """(node, component) for all nodes of ``links`` (a, b); component is the smallest node reachable.

    A round hangs the larger neighbours of every node on its smallest neighbour, then
    the smaller ones; rounds grow with the logarithm of a component's length, and no
    component is ever collected.  Links are aggregated per node before they are
    joined, and both join sides are written tables, so a node with very many links
    is split by adaptive execution.  Self-links and repeated links are harmless; no
    links give no rows.
    """
    state, mark = _settle(links.where("a <> b").select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    while True:
        # Large star: every neighbour above u hangs on the least of u's neighbourhood.
        both = state.unionByName(state.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large, _ = _settle(_hang(both, state).where("b > a").select(F.col("b").alias("a"), "least")
                           .withColumnRenamed("least", "b").distinct(), "large-star")
        # Small star: the neighbours below u, and u itself, hang on the least of them.
        least = write_through(large.groupBy("a").agg(F.min("b").alias("least")), "least")
        small = (large.join(least, "a").where("b <> least").select(F.col("b").alias("a"), F.col("least").alias("b"))
                 .unionByName(least.select("a", F.col("least").alias("b"))).distinct())
        state, now = _settle(small, "small-star")
        if now == mark:
            break
        mark = now
    return state.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        state.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def _hang(both: DataFrame, state: DataFrame) -> DataFrame:
    least = write_through(both.groupBy("a").agg(F.min("b").alias("least"))
                          .select("a", F.least("a", "least").alias("least")), "least")
    return both.join(least, "a")


def _settle(links: DataFrame, name: str) -> tuple[DataFrame, tuple]:
    """The links as a written table, and a mark that changes with them."""
    links = write_through(links, name)
    return links, tuple(links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
