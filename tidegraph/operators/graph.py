"""Graph kernels on an edge table with a day column: every snapshot is computed in the same plan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidegraph.operators.ordering import with_position
from tidegraph.sources.shared import drop_written, written

LOOK = 5  # rounds of PageRank between two looks at its movement


def check_edges(edges: DataFrame, n_nodes: int | None = None) -> DataFrame:
    """GR7: edges, where a self-loop, a null end or an end outside 0..n_nodes-1 is an error."""
    bad = F.col("src").isNull() | F.col("dst").isNull() | (F.col("src") == F.col("dst"))
    if n_nodes is not None:
        bad = bad | (F.least("src", "dst") < 0) | (F.greatest("src", "dst") >= n_nodes)
    return edges.withColumn("src", F.when(bad, F.raise_error(F.lit("a self-loop, or a node out of range"))).otherwise(F.col("src")))


def node_stats(edges: DataFrame, weight: str = "w_norm") -> DataFrame:
    """AGG2-AGG5: degrees (distinct counterparties), strengths and transaction counts of each active node, by one grouping of both ends."""
    sides = edges.select("day_idx", weight, "tx_count", F.explode(F.array(F.struct(F.col("src").alias("node"), F.lit(True).alias("out")), F.struct(F.col("dst").alias("node"), F.lit(False).alias("out")))).alias("end"))
    own = lambda x, out: F.sum(F.when(F.col("end.out") == out, x).otherwise(0))
    return sides.groupBy("day_idx", F.col("end.node").alias("node")).agg(
        own(F.lit(1), True).alias("out_degree"), own(F.lit(1), False).alias("in_degree"),
        own(F.col(weight), True).cast("double").alias("out_strength"), own(F.col(weight), False).cast("double").alias("in_strength"),
        own(F.col("tx_count"), True).alias("out_tx"), own(F.col("tx_count"), False).alias("in_tx"),
    )


def active_nodes(edges: DataFrame) -> DataFrame:
    """AGG5: day_idx, node of the nodes with an edge."""
    return edges.select("day_idx", F.explode(F.array("src", "dst")).alias("node")).distinct()


def undirected(edges: DataFrame, weight: str = "w_norm") -> DataFrame:
    """GR4: a < b with the summed weight of both directions."""
    return edges.groupBy("day_idx", F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.sum(weight).alias("weight"))


def neighbour_pairs(edges: DataFrame) -> DataFrame:
    """GR5: node, other of every two adjacent nodes, each way once."""
    return edges.select("day_idx", F.explode(F.array(F.struct(F.col("src").alias("node"), F.col("dst").alias("other")), F.struct(F.col("dst").alias("node"), F.col("src").alias("other")))).alias("p")).select("day_idx", "p.*").distinct()


def neighbours(edges: DataFrame, node: int, direction: str = "out") -> DataFrame:
    """GR6: the counterparties of one node."""
    ends = {"out": [("src", "dst")], "in": [("dst", "src")], "all": [("src", "dst"), ("dst", "src")]}[direction]
    parts = [edges.where(F.col(a) == node).select("day_idx", F.col(b).alias("other")) for a, b in ends]
    return (parts[0] if len(parts) == 1 else parts[0].unionAll(parts[1])).distinct()


def pagerank(edges: DataFrame, n_nodes: int, damping: float = 0.85, weight: str | None = "w_norm", rounds: int | None = None, tolerance: float = 1e-12, most: int = 200) -> DataFrame:
    """GR1: day_idx, node, rank over a node space of n_nodes, dangling mass spread evenly. rounds: a fixed number of them, else until no rank moves more than the tolerance.

    A node whose out-edges weigh 0 in all dangles like one without any. Only active nodes are held: every dormant node has the rank of one without in-edges, which is a number a day.
    Whether ranks still move is looked at every few rounds."""
    w = F.lit(1.0) if weight is None else F.col(weight).cast("double")
    weighted = edges.select("day_idx", "src", "dst", w.alias("w"))
    out = weighted.groupBy("day_idx", "src").agg(F.sum("w").alias("total")).where("total <> 0")
    share = written(weighted.join(out, ["day_idx", "src"]).select("day_idx", "src", "dst", (F.col("w") / F.col("total")).alias("share")))
    nodes = written(active_nodes(edges).join(out.select("day_idx", F.col("src").alias("node"), F.lit(False).alias("dangles")), ["day_idx", "node"], "left").withColumn("dangles", F.coalesce("dangles", F.lit(True))))
    n = float(n_nodes)
    ranks = written(nodes.withColumn("rank", F.lit(1 / n)).withColumn("idle", F.lit(1 / n)))
    for k in range(rounds or most):
        lost = ranks.groupBy("day_idx").agg(((F.sum(F.when(F.col("dangles"), F.col("rank")).otherwise(0.0)) + (n - F.count("*")) * F.first("idle")) / n).alias("lost"))
        got = share.join(ranks.select("day_idx", F.col("node").alias("src"), "rank"), ["day_idx", "src"]).groupBy("day_idx", F.col("dst").alias("node")).agg(F.sum(F.col("rank") * F.col("share")).alias("got"))
        base = (1 - damping) / n + damping * F.col("lost")
        after = ranks.withColumnRenamed("rank", "before").drop("idle").join(got, ["day_idx", "node"], "left").join(lost, "day_idx")
        after = written(after.select("day_idx", "node", "dangles", (base + damping * F.coalesce("got", F.lit(0.0))).alias("rank"), base.alias("idle"), "before"))
        looked_at = not rounds and k % LOOK == LOOK - 1
        moved = (after.agg(F.max(F.abs(F.col("rank") - F.col("before")))).first()[0] or 0.0) if looked_at else None
        drop_written(ranks)
        ranks = after.drop("before")
        if moved is not None and moved <= tolerance:
            break
    return ranks.select("day_idx", "node", "rank")


def rank_percent(ranks: DataFrame) -> DataFrame:
    """WIN4: adds rank_pct, the position by rank (ties by node) over the number of active nodes less one. Positions are those in the order of all days, less the day's first; no task holds a day."""
    placed = with_position(ranks, ["day_idx", "rank", "node"], "at")
    days = placed.groupBy("day_idx").agg(F.min("at").alias("first"), F.greatest(F.count("*") - 1, F.lit(1)).alias("others"))  # a row a day
    return placed.join(F.broadcast(days), "day_idx").withColumn("rank_pct", (F.col("at") - F.col("first")) / F.col("others")).drop("at", "first", "others")


def sampled_subgraph(edges: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """GR9: n edges by the order of a keyed hash, with nodes numbered anew by their order."""
    chosen = edges.orderBy(F.xxhash64(F.lit(seed), "src", "dst"), "src", "dst").limit(n)
    names = chosen.select(F.explode(F.array("src", "dst")).alias("node")).distinct().withColumn("id", F.row_number().over(W.orderBy("node")) - 1)  # 2 n rows at most
    return chosen.join(names.select(F.col("node").alias("src"), F.col("id").alias("a")), "src").join(names.select(F.col("node").alias("dst"), F.col("id").alias("b")), "dst").select("src", "dst", "a", "b")


def ego_edges(edges: DataFrame, node: int, most: int) -> DataFrame:
    """GR10: the counterparties of a node with the most transactions in each direction, and how many are hidden."""
    both = edges.where((F.col("src") == node) | (F.col("dst") == node)).select(
        "day_idx", F.when(F.col("src") == node, "out").otherwise("in").alias("direction"), F.when(F.col("src") == node, F.col("dst")).otherwise(F.col("src")).alias("other"), "tx_count"
    )
    side = W.partitionBy("day_idx", "direction")
    ranked = both.withColumn("rn", F.row_number().over(side.orderBy(F.desc("tx_count"), "other"))).withColumn("hidden", F.greatest(F.count("*").over(side) - most, F.lit(0)))
    return ranked.where(F.col("rn") <= most).drop("rn")


def partition_agreement(a: DataFrame, b: DataFrame, pairs: DataFrame) -> DataFrame:
    """GR11: share of the given node pairs on which two partitions (node, community) agree about being together."""
    of = lambda p, end, name: p.select(F.col("node").alias(end), F.col("community").alias(name))
    joined = pairs.join(of(a, "x", "ax"), "x").join(of(a, "y", "ay"), "y").join(of(b, "x", "bx"), "x").join(of(b, "y", "by"), "y")
    return joined.agg(F.avg(((F.col("ax") == F.col("ay")) == (F.col("bx") == F.col("by"))).cast("double")).alias("agreement"), F.count("*").alias("n_pairs"))
