"""Temporal splits, purging, sampling and walk-forward blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegraph.sources.views import split_of


def assign(tx: DataFrame, train=(0, 5), val=(6, 6), test=(7, 9)) -> DataFrame:
    """FLT4: adds split; rows outside every window go. Windows that overlap or run backwards are an error."""
    if not train[0] <= train[1] < val[0] <= val[1] < test[0] <= test[1]:
        raise ValueError("windows must follow each other: train, val, test")
    return tx.withColumn("split", split_of(F.col("day_idx"), train, val, test)).where("split IS NOT NULL")


def purge(split: DataFrame, typology: DataFrame, later: Column | None = None) -> DataFrame:
    """JN11: split without the training rows whose attempt reaches into val or test; rows without an attempt stay, val and test are never touched."""
    later = F.col("split").isin("val", "test") if later is None else later
    attempts = split.join(typology.select("tx_id", "attempt_id"), "tx_id", "left")
    reaching = attempts.where(later & F.col("attempt_id").isNotNull()).select(F.col("attempt_id").alias("reaching")).distinct()
    kept = attempts.join(reaching, (F.col("attempt_id") == F.col("reaching")) & (F.col("split") == "train"), "left_anti")
    return kept.drop("attempt_id")


def report(before: DataFrame, after: DataFrame) -> DataFrame:
    """AGG16: rows and positives of each split, before and after the purge."""
    count = lambda df, suffix: df.groupBy("split").agg(F.count("*").alias(f"n_rows_{suffix}"), F.sum("label").alias(f"n_positive_{suffix}"))
    return count(before, "before").join(count(after, "after"), "split", "left").na.fill(0)


def check_contract(split: DataFrame) -> None:
    """SP2: every split has rows and positives, they follow each other in time, and no transaction is in two."""
    facts = {r["split"]: r for r in split.groupBy("split").agg(F.min("day_idx").alias("lo"), F.max("day_idx").alias("hi"), F.sum("label").alias("pos")).collect()}
    for name in ("train", "val", "test"):
        if name not in facts or not facts[name]["pos"]:
            raise ValueError(f"{name} has no rows or no positives")
    if not facts["train"]["hi"] < facts["val"]["lo"] or not facts["val"]["hi"] < facts["test"]["lo"]:
        raise ValueError("splits overlap in time")
    if not split.groupBy("tx_id").count().where("count > 1").isEmpty():
        raise ValueError("a transaction is in two splits")


def span_counts(tx: DataFrame, typology: DataFrame, first_days: list[int]) -> DataFrame:
    """AGG21: for each boundary, given by the first day after it: attempts that have rows on both sides of it."""
    spans = typology.join(tx.select("tx_id", "day_idx"), "tx_id").groupBy("attempt_id").agg(F.min("day_idx").alias("first"), F.max("day_idx").alias("last"))
    at = F.explode(F.array(*map(F.lit, first_days))).alias("boundary")
    return spans.select("*", at).groupBy("boundary").agg(F.count_if((F.col("first") < F.col("boundary")) & (F.col("last") >= F.col("boundary"))).alias("n_straddling"), F.count("*").alias("n_attempts"))


def straddling(split: DataFrame, typology: DataFrame) -> DataFrame:
    """SP3: attempts in train and in val or test; none is right after the purge."""
    attempts = split.join(typology.select("tx_id", "attempt_id"), "tx_id")
    return attempts.where("split = 'train'").select("attempt_id").intersect(attempts.where("split <> 'train'").select("attempt_id"))


def subsample_negatives(train: DataFrame, ratio: float, seed: int = 42) -> DataFrame:
    """SP4: all positives and exactly min(N-, ratio N+) negatives, in the order of a keyed hash. Only of the train split."""
    if ratio < 1:
        raise ValueError("the ratio is 1 at least")
    facts = train.agg(F.sum("label").alias("pos"), F.count_if(F.col("split") != "train").alias("other")).first()
    if facts["other"]:
        raise ValueError("only the train split may be sampled")
    if not facts["pos"]:
        raise ValueError("the train split has no positives")
    negatives = train.where("label = 0").orderBy(sampling_key(F.col("tx_id"), seed), "tx_id").limit(int(ratio * facts["pos"]))
    return train.where("label = 1").unionByName(negatives)


def stratified_sample(rows: DataFrame, size: int, seed: int = 42) -> DataFrame:
    """SP6: all positives and negatives in the order of a keyed hash, up to size rows."""
    n = rows.where("label = 1").count()
    return rows.where("label = 1").unionByName(rows.where("label = 0").orderBy(sampling_key(F.col("tx_id"), seed), "tx_id").limit(max(size - n, 0)))


def sampling_key(tx_id: Column, seed: int) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), tx_id.cast("string")).cast("binary"))


def positive_weight(train: DataFrame) -> DataFrame:
    """SP5: negatives over positives, 1 without positives."""
    return train.agg(F.coalesce(F.count_if(F.col("label") == 0) / F.when(F.sum("label") > 0, F.sum("label")), F.lit(1.0)).alias("weight"))


def blocks(tx: DataFrame, size: int = 2, n: int = 5) -> DataFrame:
    """SP7: adds block, of size days each, for the first n."""
    return tx.withColumn("block", F.expr(f"day_idx div {int(size)}").cast("int")).where(F.col("block") < n)
