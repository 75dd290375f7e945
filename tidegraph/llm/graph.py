"""Connected components of a graph given as links, by alternating large-star and small-star steps on DataFrames.

Each step is a grouped minimum (combined before the shuffle) and a join that Spark may split where a node has very many
links; every round is kept in the shared folder, so lineage stays short. No links, empty input: no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegraph.llm.common import collect_garbage, drop_written, written


def components(links: DataFrame, a: str = "a", b: str = "b", files: int | None = None) -> DataFrame:
    """node, root of every node that has a link to another; root: the smallest node that can be reached. files: of a round's table at most."""
    edges = written(links.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where("a > b").distinct(), files=files)
    before, rounds = None, 0
    while True:
        rounds += 1
        if rounds % 3 == 0:
            collect_garbage(links.sparkSession)
        after = written(_small_star(_large_star(edges)), files=files)
        drop_written(edges)
        edges = after
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = now


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a > b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a").where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionAll(least.select("a", F.col("m").alias("b"))).distinct()
