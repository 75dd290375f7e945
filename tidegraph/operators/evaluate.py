"""Ranking metrics, recall by family, alert budgets and walk-forward verdicts, as plans.

Curves run over distinct scores, of which there may be as many as rows. Their running sums have two levels: scores are
dealt to ranges, sums of ranges are added up (one row a range), and the sum within a range goes on top.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidegraph.functions.scalars import wilson
from tidegraph.sources.views import UNANNOTATED

# The families that structure should help, and the control.
STRUCTURED = ["CYCLE", "FAN-OUT", "FAN-IN", "SCATTER-GATHER", "GATHER-SCATTER", "BIPARTITE"]
CONTROL = "RANDOM"
RANGES = 256


def running(rows: DataFrame, order: str, by: list[str], sums: dict[str, str], low: float = 0.0, high: float = 1.0) -> DataFrame:
    """rows and, for each name: column, the sum of the column over this and all rows with a larger order, within by. order is unique within by."""
    where = F.least(F.lit(RANGES - 1), F.greatest(F.lit(0), F.floor((F.col(order) - low) / (high - low) * RANGES))).alias("range")
    dealt = rows.withColumn("range", where)
    totals = dealt.groupBy(*by, "range").agg(*(F.sum(c).alias(f"{n}__of") for n, c in sums.items()))
    above = W.partitionBy(*by).orderBy(F.desc("range")).rowsBetween(W.unboundedPreceding, -1)
    totals = totals.select(*by, "range", *(F.coalesce(F.sum(f"{n}__of").over(above), F.lit(0)).alias(f"{n}__above") for n in sums))
    within = W.partitionBy(*by, "range").orderBy(F.desc(order)).rowsBetween(W.unboundedPreceding, 0)
    placed = dealt.join(totals, [*by, "range"])
    return placed.select(*rows.columns, *((F.sum(c).over(within) + F.col(f"{n}__above")).alias(n) for n, c in sums.items()))


def curve(scored: DataFrame, by: list[str] | None = None) -> DataFrame:
    """WIN6: tp, fp of every threshold, which are the distinct scores; and the number of positives."""
    by = by or []
    steps = scored.groupBy(*by, "score").agg(F.sum("label").alias("pos"), (F.count("*") - F.sum("label")).alias("neg"))
    n = scored.groupBy(*by).agg(F.sum("label").alias("n_pos"), F.count("*").alias("n_rows"))
    run = running(steps, "score", by, {"tp": "pos", "fp": "neg"})
    return run.join(F.broadcast(n), by) if by else run.join(F.broadcast(n))


def average_precision(scored: DataFrame, by: list[str] | None = None) -> DataFrame:
    """EV1: sum of precision times the step in recall; null without positives."""
    by = by or []
    area = F.sum(F.col("pos") * F.col("tp") / (F.col("tp") + F.col("fp"))) / F.max(F.when(F.col("n_pos") > 0, F.col("n_pos")))
    return curve(scored, by).groupBy(*by).agg(area.alias("average_precision"))


def roc_auc(scored: DataFrame, by: list[str] | None = None) -> DataFrame:
    """EV2: the share of positive-negative pairs in order, ties half."""
    by = by or []
    c = curve(scored, by)
    pairs = F.max(F.col("n_pos") * (F.col("n_rows") - F.col("n_pos")))
    won = F.sum(F.col("neg") * (F.col("tp") - F.col("pos")) + F.col("neg") * F.col("pos") / 2)
    return c.groupBy(*by).agg((won / F.when(pairs > 0, pairs)).alias("roc_auc"))


def threshold_at_recall(scored: DataFrame, target: float) -> DataFrame:
    """EV3: the highest threshold with that recall, else the lowest score."""
    reached = F.max(F.when(F.col("tp") / F.col("n_pos") >= target, F.col("score")))
    return curve(scored).agg(F.coalesce(reached, F.min("score")).alias("threshold"))


def alerts_per_day(scored: DataFrame, threshold: DataFrame, n_days: int) -> DataFrame:
    """EV4. threshold: one row."""
    if n_days <= 0:
        raise ValueError("a number of days above 0 is needed")
    return scored.join(F.broadcast(threshold)).agg((F.count_if(F.col("score") >= F.col("threshold")) / n_days).alias("alerts_per_day"))


def evaluate_split(scored: DataFrame, threshold: DataFrame, n_days: int) -> DataFrame:
    """EV6: one row of facts about a split at a threshold."""
    flagged = (F.col("score") >= F.col("threshold")).cast("int")
    rows = scored.join(F.broadcast(threshold))
    caught = F.sum(flagged * F.col("label"))
    facts = rows.agg(
        F.count("*").alias("n_rows"), F.sum("label").alias("n_positives"), (F.sum("label") / F.count("*")).alias("prevalence"), F.max("threshold").alias("threshold"), F.sum(flagged).alias("n_flagged"),
        caught.alias("n_detected"), (caught / F.when(F.sum("label") > 0, F.sum("label"))).alias("recall"), (caught / F.when(F.sum(flagged) > 0, F.sum(flagged))).alias("precision"),
        (F.sum(flagged) / n_days).alias("alerts_per_day"), ((F.sum(flagged) - caught) / n_days).alias("false_alerts_per_day"),
    )
    return facts.join(average_precision(scored)).join(roc_auc(scored))


def pr_curve(scored: DataFrame, most: int = 2000) -> DataFrame:
    """EV7, WIN10: threshold, recall, precision at every k-th of the thresholds by falling score, so that at most ``most`` remain, and the last."""
    c = curve(scored)
    steps = running(c.withColumn("one", F.lit(1)), "score", [], {"place": "one"})
    n = F.broadcast(c.agg(F.count("*").alias("n")))
    step = F.ceil(F.col("n") / most)
    return steps.join(n).where(((F.col("place") - 1) % step == 0) | (F.col("place") == F.col("n"))).select("score", (F.col("tp") / F.col("n_pos")).alias("recall"), (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"))


def bootstrap(scored: DataFrame, replicates: int = 200, alpha: float = 0.05, seed: int = 42) -> DataFrame:
    """EV5: percentile interval of the average precision. Each distinct score's positives and negatives get a Poisson(1) weight per row and replicate, by a keyed hash."""
    u = (F.pmod(F.xxhash64(F.lit(seed), "replicate", "tx_id"), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    cumulative, p, steps = 0.0, 0.36787944117144233, []  # exp(-1)
    for k in range(1, 12):
        cumulative += p
        p /= k
        steps.append(cumulative)
    weight = sum((u > c).cast("int") for c in steps)
    rows = scored.withColumn("replicate", F.explode(F.sequence(F.lit(1), F.lit(replicates)))).withColumn("w", weight).where("w > 0")
    grouped = rows.groupBy("replicate", "score").agg(F.sum(F.col("w") * F.col("label")).alias("pos"), F.sum(F.col("w") * (1 - F.col("label"))).alias("neg"))
    run = running(grouped, "score", ["replicate"], {"tp": "pos", "fp": "neg"})
    each = run.groupBy("replicate").agg((F.sum(F.col("pos") * F.col("tp") / (F.col("tp") + F.col("fp"))) / F.when(F.sum("pos") > 0, F.sum("pos"))).alias("ap")).where("ap IS NOT NULL")
    return each.agg(F.percentile("ap", alpha / 2).alias("lo"), F.percentile("ap", 1 - alpha / 2).alias("hi"), F.count("*").alias("n"))


def kth_score(scored: DataFrame, k: int) -> DataFrame:
    """TOP2: the k-th largest score, k cut to the number of rows; rows that tie with it may go beyond the budget."""
    if k <= 0:
        raise ValueError("a budget above 0 is needed")
    return scored.select("score").orderBy(F.desc("score")).limit(k).agg(F.min("score").alias("threshold"))


def typology_recall(scored: DataFrame, typology: DataFrame, threshold: DataFrame) -> DataFrame:
    """AGG13: of each family's positives at a threshold: number, detected, recall with its interval, distinct attempts."""
    rows = scored.where("label = 1").join(typology.select("tx_id", "attempt_id", "typology"), "tx_id", "left").withColumn("typology", F.coalesce("typology", F.lit(UNANNOTATED)))
    found = rows.join(F.broadcast(threshold)).groupBy("typology").agg(F.count("*").alias("n_positives"), F.count_if(F.col("score") >= F.col("threshold")).alias("n_detected"), F.countDistinct("attempt_id").alias("n_attempts"))
    lo, hi = wilson(F.col("n_detected"), F.col("n_positives"))
    return found.withColumn("recall", F.col("n_detected") / F.col("n_positives")).withColumn("recall_lo", lo).withColumn("recall_hi", hi)


def presented(recalls: DataFrame) -> DataFrame:
    """TOP4: families in the order they are shown: by size, the positives outside all families last. One row a family."""
    order = W.orderBy((F.col("typology") == UNANNOTATED).cast("int"), F.desc("n_positives"), "typology")
    return recalls.withColumn("place", F.row_number().over(order))


def compare_at_budget(arms: dict[str, DataFrame], typology: DataFrame, budget: int) -> DataFrame:
    """EV9: typology_recall of every arm at its own threshold for one budget of alerts."""
    parts = [typology_recall(s, typology, kth_score(s, budget)).withColumn("arm", F.lit(arm)) for arm, s in arms.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def compare_arms(arms: dict[str, tuple[DataFrame, DataFrame]], typology: DataFrame) -> DataFrame:
    """EV8: typology_recall of every arm (scores, threshold) at its own threshold."""
    parts = [typology_recall(s, typology, t).withColumn("arm", F.lit(arm)) for arm, (s, t) in arms.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def asymmetry(comparison: DataFrame, baseline: str, graph: str) -> DataFrame:
    """EV10, AGG14: does the graph arm help structured families more than the control? One row; no verdict unless the intervals are apart."""
    structured = F.col("typology").isin(STRUCTURED)
    pool = lambda arm, which, c: F.coalesce(F.sum(F.when((F.col("arm") == arm) & which, F.col(c))), F.lit(0))
    control = F.col("typology") == CONTROL
    s = comparison.agg(
        pool(baseline, structured, "n_detected").alias("struct_base"), pool(graph, structured, "n_detected").alias("struct_graph"), pool(graph, structured, "n_positives").alias("struct_n"),
        pool(baseline, control, "n_detected").alias("rand_base"), pool(graph, control, "n_detected").alias("rand_graph"), pool(graph, control, "n_positives").alias("rand_n"),
    )
    for name in ("struct", "rand"):
        n = F.col(f"{name}_n")
        lo, hi = wilson(F.col(f"{name}_graph"), n)
        s = s.withColumn(f"{name}_delta", (F.col(f"{name}_graph") - F.col(f"{name}_base")) / F.when(n > 0, n)).withColumn(f"{name}_lo", lo).withColumn(f"{name}_hi", hi)
    apart = F.coalesce((F.col("struct_lo") > F.col("rand_hi")) | (F.col("rand_lo") > F.col("struct_hi")), F.lit(False))
    verdict = F.when(~apart, "inconclusive").when(F.col("struct_delta") > F.col("rand_delta"), "supports mechanism").otherwise("leak alarm")
    return s.withColumn("verdict", verdict)


def family_delta(comparison: DataFrame, baseline: str, graph: str) -> DataFrame:
    """RSH2: recall of both arms by family, side by side, and the difference."""
    wide = comparison.groupBy("typology").pivot("arm", [baseline, graph]).agg(F.avg("recall"))
    return wide.withColumn("delta", F.col(graph) - F.col(baseline))


def budget_curve(scored: DataFrame, n_days: int, points: int = 3000) -> DataFrame:
    """WIN7: alerts per day and recall at every threshold, thinned to about so many points."""
    c = curve(scored)
    steps = running(c.withColumn("one", F.lit(1)), "score", [], {"place": "one"})
    n = F.broadcast(c.agg(F.count("*").alias("n")))
    step = F.greatest(F.lit(1), F.floor(F.col("n") / points))
    return steps.join(n).where((F.col("place") - 1) % step == 0).select("score", ((F.col("tp") + F.col("fp")) / n_days).alias("alerts_per_day"), (F.col("tp") / F.col("n_pos")).alias("recall"))


def alert_table(scored: DataFrame, tx: DataFrame, typology: DataFrame, threshold: DataFrame, top: int, sample: int, seed: int = 42) -> DataFrame:
    """EV13, TOP3, WIN5: the top alerts and a hash-ordered sample of the rest, enriched, with the rank within the table and over all rows (ties by tx_id)."""
    ordered = scored.orderBy(F.desc("score"), "tx_id").limit(top)
    rest = scored.join(ordered.select("tx_id"), "tx_id", "left_anti").orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("tx_id").cast("string")).cast("binary")), "tx_id").limit(sample)
    chosen = ordered.unionByName(rest).select("tx_id", "score", "label").join(F.broadcast(threshold))
    rich = chosen.join(tx.select("tx_id", "secs", "src_node", "dst_node", "amount_paid", "payment_format"), "tx_id", "left").join(typology.select("tx_id", "typology"), "tx_id", "left")
    return rich.withColumn("is_alert", (F.col("score") >= F.col("threshold")).cast("int")).withColumn("rank", F.row_number().over(W.orderBy(F.desc("score"), "tx_id"))).drop("threshold")


def walk_forward_verdict(results: DataFrame) -> DataFrame:
    """EV11, WIN9: results (block, arm retrained or frozen, auprc, auprc_lo, auprc_hi) to one row. A frozen arm decays only if its last interval lies below its first."""
    arm = lambda name, c: F.max(F.when(F.col("arm") == name, F.col(c))).alias(f"{name}_{c}")
    wide = results.groupBy("block").agg(*(arm(a, c) for a in ("retrained", "frozen") for c in ("auprc", "auprc_lo", "auprc_hi")))
    apart = (F.col("retrained_auprc_lo") > F.col("frozen_auprc_hi")) | (F.col("frozen_auprc_lo") > F.col("retrained_auprc_hi"))
    s = wide.agg(
        F.avg(F.col("retrained_auprc") - F.col("frozen_auprc")).alias("mean_gap"), F.count_if(apart).alias("blocks_with_separation"), F.count("*").alias("n_blocks"),
        F.min_by("frozen_auprc", "block").alias("frozen_first"), F.max_by("frozen_auprc", "block").alias("frozen_last"), (F.max_by("frozen_auprc_hi", "block") < F.min_by("frozen_auprc_lo", "block")).alias("frozen_declined"),
    )
    return s.withColumn("verdict", F.when(F.col("blocks_with_separation") == 0, "no separation").when(F.col("frozen_declined"), "decay").otherwise("not decay"))


def shares(attributions: DataFrame, groups: DataFrame) -> DataFrame:
    """AGG15: attributions (tx_id, feature, value) and groups (feature, block): mean absolute value of each feature and its share, and its block's."""
    each = attributions.groupBy("feature").agg(F.avg(F.abs("value")).alias("mean_abs")).join(F.broadcast(groups), "feature")
    total, block = F.sum("mean_abs").over(W.partitionBy()), F.sum("mean_abs").over(W.partitionBy("block"))
    return each.withColumn("share", F.col("mean_abs") / F.when(total > 0, total)).withColumn("block_share", block / F.when(total > 0, total))


