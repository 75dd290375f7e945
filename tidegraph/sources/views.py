"""Canonical transactions over the test tables.

Both views have the columns CANONICAL; ``txn_events`` is rich in time, ``txn_sales`` large. Money sums are taken in
whole cents further on, so that they don't depend on the order of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegraph.operators.ordering import with_position

# The families of annotated patterns, and the bucket of positives outside them.
FAMILIES = ["FAN-OUT", "FAN-IN", "CYCLE", "SCATTER-GATHER", "GATHER-SCATTER", "BIPARTITE", "STACK", "RANDOM"]
UNANNOTATED = "UNANNOTATED"

CANONICAL = [
    "tx_id", "ts", "secs", "day_idx", "src_node", "dst_node", "amount_paid", "amount_received", "currency_paid", "currency_received",
    "payment_format", "is_self_loop", "is_cross_currency", "is_cross_bank", "label",
]
MAX_DAY = 9


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def flags(tx: DataFrame) -> DataFrame:
    """PRJ3: adds is_self_loop, is_cross_currency and, where banks are known, is_cross_bank."""
    tx = tx.withColumn("is_self_loop", F.col("src_node") == F.col("dst_node")).withColumn("is_cross_currency", F.col("currency_paid") != F.col("currency_received"))
    return tx.withColumn("is_cross_bank", F.col("src_bank") != F.col("dst_bank") if "src_bank" in tx.columns else F.lit(False))


def day_index(ts: Column, origin: str) -> Column:
    """PRJ2: whole days since the origin; earlier times are an error."""
    days = F.datediff(ts.cast("date"), F.lit(origin).cast("date"))
    return F.when(days < 0, F.raise_error(F.lit(f"a transaction is earlier than {origin}"))).otherwise(days)


def family(number: Column) -> Column:
    return F.get(F.array(*map(F.lit, FAMILIES)), number.cast("int"))


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """txn_events as a stream of the table's files."""
    path = f"{sf_dir}/events.parquet"
    # As a pattern, because a stream takes a plain path for a folder.
    return events_as_transactions(spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{sf_dir}/event[s].parquet"))


def txn_events(spark: SparkSession, sf_dir: str, max_day: int | None = MAX_DAY) -> DataFrame:
    return events_as_transactions(table(spark, sf_dir, "events"), max_day)


def events_as_transactions(e: DataFrame, max_day: int | None = MAX_DAY) -> DataFrame:
    tx = e.select(
        F.col("event_id").alias("tx_id"), "ts", F.unix_timestamp(F.col("ts").cast("timestamp_ntz")).alias("secs"), day_index(F.col("ts"), "2024-01-01").alias("day_idx"),
        F.col("user_id").alias("src_node"), F.get_json_object("props", "$.k").cast("long").alias("dst_node"), F.col("value").alias("amount_paid"), F.col("value").alias("amount_received"),
        F.lit("USD").alias("currency_paid"), F.lit("USD").alias("currency_received"), F.col("event_type").alias("payment_format"),
        ((F.col("event_type") == "error") & (F.col("value") >= 20)).cast("int").alias("label"),
    )
    tx = flags(tx).select(*CANONICAL)
    return tx if max_day is None else tx.where(F.col("day_idx") <= max_day)


def txn_sales(spark: SparkSession, sf_dir: str, numbered: bool = True) -> DataFrame:
    """Line items as transactions: tx_id is the position in time, ties in the order of the other columns. Numbering sorts and writes the table; without it there is no tx_id."""
    read = lambda name: table(spark, sf_dir, name)
    n_customers = read("customer").agg(F.count("*").alias("n_customers"))  # one row
    lines = (
        read("lineitem")
        .join(read("orders"), F.col("l_orderkey") == F.col("o_orderkey"))
        .join(read("customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
        .join(read("supplier").select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
        .join(read("nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_regionkey").alias("c_region")), "c_nationkey")
        .join(read("nation").select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_regionkey").alias("s_region")), "s_nationkey")
        .join(F.broadcast(n_customers))
    )
    tx = lines.select(
        F.col("l_shipdate").alias("ts"), F.unix_timestamp(F.col("l_shipdate").cast("timestamp_ntz")).alias("secs"),
        F.expr("datediff(cast(l_shipdate as date), date'1995-01-01') div 250").cast("int").alias("day_idx"),
        F.col("o_custkey").alias("src_node"), (F.col("l_partkey") % F.col("n_customers")).alias("dst_node"),
        F.col("l_extendedprice").alias("amount_paid"), (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("amount_received"),
        F.col("c_region").cast("string").alias("currency_paid"), F.col("s_region").cast("string").alias("currency_received"), F.col("o_orderpriority").alias("payment_format"),
        F.col("c_nationkey").alias("src_bank"), F.col("s_nationkey").alias("dst_bank"),
        ((F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "F") & (F.col("l_quantity") >= 45)).cast("int").alias("label"),
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice",
    )
    if numbered:
        tx = with_position(tx, ["ts", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"], "tx_id")
    return flags(tx).select(*CANONICAL[0 if numbered else 1 :], "src_bank", "dst_bank", "l_orderkey")


def node_space(tx: DataFrame) -> int:
    """How many node ids there are: one more than the largest."""
    return (tx.agg(F.max(F.greatest("src_node", "dst_node"))).first()[0] or 0) + 1


def event_typology(tx: DataFrame) -> DataFrame:
    """The typology map of txn_events: tx_id, attempt_id, typology of annotated positives."""
    return tx.where("label = 1 AND tx_id % 3 <> 0").select(
        "tx_id", (F.col("src_node") * 4 + F.expr("(day_idx + 1) div 3")).alias("attempt_id"), family(F.col("src_node") % 8).alias("typology")
    )


def event_scores(tx: DataFrame) -> DataFrame:
    """Predictions with a deterministic score that has ties: tx_id, day_idx, split, score, label."""
    score = ((F.col("tx_id") * 7919 + F.col("src_node") * 104729) % 1000) / 1000
    return tx.select("tx_id", "day_idx", "src_node", split_of(F.col("day_idx")).alias("split"), score.alias("score"), "label")


def split_of(day: Column, train=(0, 5), val=(6, 6), test=(7, 9)) -> Column:
    """FLT4: the split a day belongs to."""
    return F.when(day.between(*train), "train").when(day.between(*val), "val").when(day.between(*test), "test")
