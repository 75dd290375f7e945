"""Interning of endpoints, linking of annotated rows to transactions, and dataset validation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidegraph.functions.scalars import cents
from tidegraph.operators.ordering import with_position
from tidegraph.sources.views import UNANNOTATED

KEY = ["secs", "src_node", "dst_node", "cents", "currency_paid", "payment_format"]


def node_index(endpoints: DataFrame, key: list[str]) -> DataFrame:
    """WIN3: node_id of every distinct key, in the order of keys, whatever the order of rows."""
    return with_position(endpoints.select(*key).distinct(), key, "node_id").select("node_id", *key)


def endpoints(tx: DataFrame, src: list[str], dst: list[str], names: list[str]) -> DataFrame:
    """SET1: the distinct keys at either end."""
    side = lambda cols: tx.select(*(F.col(c).alias(n) for c, n in zip(cols, names, strict=True)))
    return side(src).unionAll(side(dst)).distinct()


def encode(df: DataFrame, index: DataFrame, on: list[str], name: str) -> DataFrame:
    """JN2: df and the node id of its key; -1 where the index has none."""
    key = [c for c in index.columns if c != "node_id"]
    side = index.select(*(F.col(k).alias(c) for k, c in zip(key, on, strict=True)), F.col("node_id").alias(name))
    return df.join(side, on, "left").withColumn(name, F.coalesce(name, F.lit(-1)))


def decode(df: DataFrame, index: DataFrame, column: str) -> DataFrame:
    """JN3: df and the key of a node id; an unknown id is an error."""
    known = index.withColumn("__known", F.lit(True))
    joined = df.join(known, F.col(column) == F.col("node_id"), "left")
    return joined.withColumn("node_id", F.when(F.col("__known"), F.col("node_id")).otherwise(F.raise_error(F.lit("unknown node id")))).drop("__known")


def aligned_codes(df: DataFrame, columns: list[str]) -> DataFrame:
    """SET7: value, code of the values of several columns in one code space."""
    values = df.select(F.explode(F.array(*(F.col(c) for c in columns))).alias("value")).where("value IS NOT NULL").distinct()
    return with_position(values, ["value"], "code").select("value", "code")


def link(patterns: DataFrame, tx: DataFrame) -> DataFrame:
    """JN5: the k-th annotated row of a natural key is the k-th positive transaction of that key.

    patterns: pattern_row and the columns KEY. Returns pattern_row and its tx_id, null where there is none."""
    ranked = lambda df, by: df.withColumn("occ", F.row_number().over(W.partitionBy(*KEY).orderBy(by)))
    positives = with_key(tx.where("label = 1")).join(patterns.select(*KEY).distinct(), KEY, "left_semi")
    return ranked(patterns, "pattern_row").join(ranked(positives, "tx_id").select(*KEY, "occ", "tx_id"), [*KEY, "occ"], "left")


def with_key(tx: DataFrame) -> DataFrame:
    return tx.withColumn("cents", cents(F.col("amount_paid")))


def ambiguous(patterns: DataFrame, tx: DataFrame) -> DataFrame:
    """JN6: keys with more positive transactions than annotated rows."""
    n_pat = patterns.groupBy(*KEY).agg(F.count("*").alias("n_pattern"))
    n_tx = with_key(tx.where("label = 1")).groupBy(*KEY).agg(F.count("*").alias("n_tx"))
    return n_pat.join(n_tx, KEY, "left").withColumn("n_tx", F.coalesce("n_tx", F.lit(0))).where("n_tx > n_pattern")


def licit_collisions(patterns: DataFrame, tx: DataFrame) -> DataFrame:
    """JN7: annotated rows whose key a negative transaction has, too."""
    return patterns.join(with_key(tx.where("label = 0")).select(*KEY).distinct(), KEY, "left_semi")


def attach_typology(tx: DataFrame, typology: DataFrame) -> DataFrame:
    """JN8: adds typology; a positive outside the map is UNANNOTATED, a negative null."""
    joined = tx.join(typology.select("tx_id", "attempt_id", "typology"), "tx_id", "left")
    return joined.withColumn("typology", F.coalesce("typology", F.when(F.col("label") == 1, F.lit(UNANNOTATED))))


def assert_unique(df: DataFrame, key: str) -> DataFrame:
    """AGG26: the keys that occur more than once; none is right."""
    return df.groupBy(key).count().where("count > 1")


def validate(tx: DataFrame, expected: dict[str, int] | None = None) -> DataFrame:
    """AGG7: one row of facts about the dataset; a fact that isn't as expected is an error. Columns that must not be null are checked."""
    nodes = tx.select(F.col("src_node").alias("n")).unionAll(tx.select(F.col("dst_node").alias("n"))).agg(F.countDistinct("n").alias("n_nodes"))
    facts = tx.agg(
        F.count("*").alias("n_rows"), F.sum("label").alias("n_illicit"), F.count_if("is_self_loop").alias("n_self_loops"), F.count_if("is_cross_currency").alias("n_cross_currency"),
        F.count_if("is_cross_bank").alias("n_cross_bank"), F.count_if(F.col("is_self_loop") & (F.col("label") == 1)).alias("n_self_loop_illicit"),
        F.min("secs").alias("first_secs"), F.max("secs").alias("last_secs"), F.count_if(F.col("src_node").isNull() | F.col("dst_node").isNull() | F.col("amount_paid").isNull() | F.col("ts").isNull()).alias("n_null_rows"),
    ).join(F.broadcast(nodes))
    for name, value in (expected or {}).items():
        facts = facts.withColumn(name, F.when(F.col(name) == value, F.col(name)).otherwise(F.raise_error(F.concat(F.lit(f"{name}: expected {value}, found "), F.col(name).cast("string")))))
    return facts


def profile(tx: DataFrame) -> DataFrame:
    """AGG7: facts of the summary by name: distinct banks, days, rows of each payment format and of each day. name, value; a few rows."""
    banks = tx.select(F.explode(F.array("src_bank", "dst_bank")).alias("b")).agg(F.countDistinct("b").alias("n"))
    days = tx.agg((F.max("day_idx") + 1).cast("long").alias("n"))
    by = lambda c, prefix: tx.groupBy(F.concat(F.lit(prefix), F.col(c).cast("string")).alias("name")).agg(F.count("*").alias("value"))
    one = lambda df, name: df.select(F.lit(name).alias("name"), F.col("n").alias("value"))
    return one(banks, "banks").unionAll(one(days, "days")).unionAll(by("payment_format", "format ")).unionAll(by("day_idx", "day "))


def coverage(patterns: DataFrame, tx: DataFrame, linked: DataFrame, typology: DataFrame) -> DataFrame:
    """AGG8: name, value of every fact about the linking of annotated rows. patterns: pattern_row, KEY; linked: pattern_row, tx_id; typology: tx_id, attempt_id, typology."""
    count = lambda df, name, x=F.count("*"): df.agg(x.cast("double").alias("value")).select(F.lit(name).alias("name"), "value")
    illicit, annotated = F.sum("label"), F.count("tx_id")
    both = tx.agg(illicit.alias("i")).join(linked.agg(annotated.alias("a")))
    ratio_of = F.when(F.col("i") > 0, F.col("a") / F.col("i")).otherwise(0.0)
    whole = lambda name, x: both.select(F.lit(name).alias("name"), x.cast("double").alias("value"))
    by = lambda prefix, x: typology.groupBy(F.concat(F.lit(prefix), "typology").alias("name")).agg(x.cast("double").alias("value"))
    parts = [
        count(patterns, "pattern_rows"), count(typology, "attempts", F.countDistinct("attempt_id")), count(linked, "matched", annotated), count(linked, "unmatched", F.count_if(F.col("tx_id").isNull())),
        count(patterns, "unknown_node_rows", F.count_if((F.col("src_node") < 0) | (F.col("dst_node") < 0))), count(ambiguous(patterns, tx), "ambiguous_keys"), count(licit_collisions(patterns, tx), "licit_collisions"),
        whole("illicit", F.col("i")), whole("annotated", F.col("a")), whole("unannotated", F.col("i") - F.col("a")), whole("coverage", ratio_of),
        by("rows ", F.count("*")), by("attempts ", F.countDistinct("attempt_id")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out


def backwards(tx: DataFrame) -> DataFrame:
    """FLT8: how many rows are earlier than the one before, by tx_id; 0 is right. Rows are compared within ranges of ids and across their borders."""
    block = F.expr("tx_id div 100000")
    within = tx.withColumn("b", block).withColumn("back", F.lag("secs").over(W.partitionBy("b").orderBy("tx_id")) > F.col("secs"))
    ends = within.groupBy("b").agg(F.count_if("back").alias("back"), F.min_by("secs", "tx_id").alias("first"), F.max_by("secs", "tx_id").alias("last"))
    across = F.lag("last").over(W.orderBy("b")) > F.col("first")
    return ends.withColumn("across", across.cast("int")).agg((F.coalesce(F.sum("back"), F.lit(0)) + F.coalesce(F.sum("across"), F.lit(0))).alias("n_backwards"))
