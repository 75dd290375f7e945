"""Daily graph snapshots as one edge table: (day_idx, src, dst, w_amount, w_norm, tx_count, last_ts)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegraph.functions.scalars import cents

WEIGHTS = {"amount": "w_amount", "amount_norm": "w_norm", "tx_count": "tx_count"}


def weights(edges: DataFrame, kind: str) -> DataFrame:
    """PRJ7: day_idx, src, dst and the weight of that kind."""
    if kind not in WEIGHTS:
        raise ValueError(f"no weight {kind}; there are {sorted(WEIGHTS)}")
    return edges.select("day_idx", "src", "dst", F.col(WEIGHTS[kind]).cast("double").alias("weight"))


def graph_rows(tx: DataFrame, max_day: int | None = None) -> DataFrame:
    """FLT1, FLT2: what may become an edge: not a self-loop, within the modelling window."""
    rows = tx.where(~F.col("is_self_loop"))
    return rows if max_day is None else rows.where(F.col("day_idx") <= max_day)


def currency_medians(rows: DataFrame, unit: str = "currency_paid", accuracy: int | None = None) -> DataFrame:
    """AGG6: the median amount of each currency, if it is above 0. accuracy: of an approximate one, for amounts of very many distinct values."""
    middle = F.median("amount_paid") if accuracy is None else F.percentile_approx("amount_paid", 0.5, accuracy)
    return rows.groupBy(F.col(unit).alias("currency")).agg(middle.cast("double").alias("median")).where("median > 0")


def normalised(rows: DataFrame, medians: DataFrame, unit: str = "currency_paid") -> DataFrame:
    """PRJ6: adds amount_norm; a currency without a median has scale 1. One row a currency is joined."""
    return rows.join(medians, rows[unit] == medians["currency"], "left").withColumn("amount_norm", F.col("amount_paid") / F.coalesce("median", F.lit(1.0))).drop("currency", "median")


def collapse_edges(rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    """AGG1: one row for each ordered pair (and by): summed amount, summed normalised amount, count, latest time."""
    keys = [*(by or []), "src", "dst"]
    named = rows.withColumnsRenamed({"src_node": "src", "dst_node": "dst"})
    return named.groupBy(*keys).agg((F.sum(cents(F.col("amount_paid"))) / 100).alias("w_amount"), F.sum("amount_norm").alias("w_norm"), F.count("*").alias("tx_count"), F.max("secs").alias("last_ts"))


def window_days(day: Column, first: int, last: int, lookback: int | None) -> Column:
    """JN16: the days whose snapshot (D - lookback + 1 .. D, all days so far if None) holds a row of this day."""
    if lookback is not None and lookback < 1:
        raise ValueError("a lookback is one day at least")
    until = F.lit(last) if lookback is None else F.least(F.lit(last), day + lookback - 1)
    return F.when(day <= last, F.sequence(F.greatest(day, F.lit(first)), until)).otherwise(F.array().cast("array<int>"))


def snapshots(tx: DataFrame, max_day: int = 9, lookback: int | None = None, unit: str = "currency_paid") -> DataFrame:
    """GR8: edges of every day's snapshot at once. Rows are collapsed by day first; only these sums are dealt to the days that see them."""
    rows = graph_rows(tx, max_day)
    daily = collapse_edges(normalised(rows, currency_medians(rows, unit), unit), ["day_idx"])
    seen = daily.withColumn("day_idx", F.explode(window_days(F.col("day_idx"), 0, max_day, lookback)))
    return seen.groupBy("day_idx", "src", "dst").agg((F.sum(cents(F.col("w_amount"))) / 100).alias("w_amount"), F.sum("w_norm").alias("w_norm"), F.sum("tx_count").alias("tx_count"), F.max("last_ts").alias("last_ts"))


def summary(edges: DataFrame) -> DataFrame:
    """AGG10: rows, edges, active nodes and collapse ratio of each day's snapshot."""
    ends = edges.select("day_idx", F.explode(F.array("src", "dst")).alias("node")).distinct().groupBy("day_idx").agg(F.count("*").alias("n_active"))
    sums = edges.groupBy("day_idx").agg(F.sum("tx_count").alias("n_rows"), F.count("*").alias("n_edges"))
    return sums.join(ends, "day_idx").withColumn("collapse_ratio", F.round(F.col("n_rows") / F.col("n_edges"), 2))
