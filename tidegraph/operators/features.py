"""The feature blocks: row-local, account state, structure and motifs. Each is tx -> (tx_id, columns...)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidegraph.functions.scalars import cents, ratio, signed_log1p, trailing_zeros
from tidegraph.operators.graph import neighbour_pairs, node_stats, pagerank, rank_percent

REPORTING_LIMIT = 10_000
BAND = (9_000, 10_000)
HOURS = (8, 18)
COUNTERPARTY_CAP = 512
ENDS = {"src": "src_node", "dst": "dst_node"}


# Row-local features -----------------------------------------------------------------------------------------------------


CODED = {"currency_paid": "currency_paid_code", "currency_received": "currency_received_code", "payment_format": "payment_format_code"}
ROW_LOCAL = [
    "log_amount_paid", "log_amount_received", "amount_mismatch_ratio", "currency_paid_code", "currency_received_code", "payment_format_code", "is_cross_currency", "is_cross_bank", "is_self_loop", "hour_of_day",
    "day_of_week", "is_off_hours", "is_round_100", "is_round_1000", "trailing_zero_count", "threshold_distance", "below_threshold_band",
]


def row_local() -> dict[str, Column]:
    """TB1-TB3, TB7-TB17: the columns that a row gives by itself."""
    paid, received, hour = F.col("amount_paid"), F.col("amount_received"), F.hour("ts")
    flag = lambda c: F.col(c).cast("int")
    return {
        "log_amount_paid": F.log1p(paid), "log_amount_received": F.log1p(received), "amount_mismatch_ratio": ratio(received, paid),
        "is_cross_currency": flag("is_cross_currency"), "is_cross_bank": flag("is_cross_bank"), "is_self_loop": flag("is_self_loop"),
        "hour_of_day": hour, "day_of_week": F.weekday("ts"), "is_off_hours": ((hour < HOURS[0]) | (hour >= HOURS[1])).cast("int"),
        "is_round_100": (cents(paid) % 10_000 == 0).cast("int"), "is_round_1000": (cents(paid) % 100_000 == 0).cast("int"),
        "trailing_zero_count": trailing_zeros(paid), "threshold_distance": signed_log1p(paid - REPORTING_LIMIT), "below_threshold_band": ((paid >= BAND[0]) & (paid < BAND[1])).cast("int"),
    }


def coded(tx: DataFrame) -> DataFrame:
    """TB4-TB6: adds the position of each value among the sorted distinct values of its column. The alphabets of currencies and formats are one row."""
    alphabets = tx.agg(*(F.array_sort(F.collect_set(c)).alias(f"__{c}") for c in CODED))
    joined = tx.crossJoin(F.broadcast(alphabets))
    return joined.withColumns({name: F.array_position(f"__{c}", F.col(c)) - 1 for c, name in CODED.items()}).drop(*(f"__{c}" for c in CODED))


def tabular(tx: DataFrame, keep: list[str] | None = None, columns: list[str] | None = None) -> DataFrame:
    """TB1-TB17, or some of them, beside the columns to keep (tx_id): one projection, and one row joined if codes are asked for."""
    wanted = ROW_LOCAL if columns is None else columns
    own = row_local()
    rows = coded(tx) if set(CODED.values()) & set(wanted) else tx
    return rows.select(*(keep or ["tx_id"]), *((own[c].alias(c) if c in own else F.col(c)) for c in wanted))


# Account state ----------------------------------------------------------------------------------------------------------


def account_events(tx: DataFrame) -> DataFrame:
    """Every transaction as an event of either end: node, tx_id, secs, dir, other, amount, currency, payment_format."""
    end = lambda direction, node, other: F.struct(F.lit(direction).alias("dir"), F.col(node).alias("node"), F.col(other).alias("other"))
    sides = F.explode(F.array(end("out", "src_node", "dst_node"), end("in", "dst_node", "src_node"))).alias("e")
    return tx.select("tx_id", "secs", F.col("amount_paid").alias("amount"), F.col("currency_paid").alias("currency"), "payment_format", sides).select("e.*", "tx_id", "secs", "amount", "currency", "payment_format")


def account_state(tx: DataFrame, cap: int = COUNTERPARTY_CAP) -> DataFrame:
    """ST1-ST16 of both ends before each transaction. A frame ends before the row's own tx_id, so a self-loop, whose two
    events share it, doesn't see itself. Events are dealt by node; frames are running sums, and nothing is collected.

    Sums of amounts are of whole cents, exact in any order; squares are summed as doubles."""
    node = W.partitionBy("node").orderBy("tx_id")
    before = node.rangeBetween(W.unboundedPreceding, -1)
    e = account_events(tx).repartition("node")  # serves all windows below, whose keys begin with the node
    # First occurrences: the row that brings a new counterparty, currency or format to the node.
    first = lambda *key: F.row_number().over(W.partitionBy("node", *key).orderBy("tx_id", "dir")) == 1
    e = e.withColumn("new_other", first("dir", "other").cast("int")).withColumn("new_currency", first("currency").cast("int")).withColumn("new_format", first("payment_format").cast("int"))
    of = lambda direction, x: F.when(F.col("dir") == direction, x)
    e = e.withColumn("gap", of("out", F.col("secs") - F.max(of("in", F.col("secs"))).over(before)))
    run = lambda x: F.coalesce(F.sum(x).over(before), F.lit(0))
    hundredths = cents(F.col("amount"))
    s = e.select(
        "tx_id", "dir", "secs", "amount",
        run(of("in", F.lit(1))).alias("tx_count_in"), run(of("out", F.lit(1))).alias("tx_count_out"),
        (run(of("in", hundredths)) / 100).alias("volume_in"), (run(of("out", hundredths)) / 100).alias("volume_out"),
        F.max(of("in", F.col("secs"))).over(before).alias("last_in"), F.max(of("out", F.col("secs"))).over(before).alias("last_out"),
        F.last("gap", ignorenulls=True).over(before).alias("turnover_latency"),
        F.least(run(of("in", F.col("new_other"))), F.lit(cap)).alias("distinct_counterparties_in"), F.least(run(of("out", F.col("new_other"))), F.lit(cap)).alias("distinct_counterparties_out"),
        run(F.col("new_currency")).alias("unique_currencies_seen"), run(F.col("new_format")).alias("unique_formats_seen"),
        F.count("*").over(before).alias("n"), (run(hundredths) / 100).alias("total"), F.coalesce(F.sum(F.col("amount") * F.col("amount")).over(before), F.lit(0.0)).alias("squares"),
        F.min("secs").over(before).alias("first_secs"),
    )
    mean, count = F.col("total") / F.col("n"), F.col("n")
    variance = F.col("squares") / F.when(count > 0, count) - F.when(count > 0, mean) * F.when(count > 0, mean)
    zscore = F.when(count >= 2, F.when(variance <= 1e-12, F.lit(0.0)).otherwise((F.col("amount") - F.col("total") / F.when(count > 0, count)) / F.sqrt(F.greatest(variance, F.lit(1e-12)))))
    values = {
        "tx_count_in": F.col("tx_count_in"), "tx_count_out": F.col("tx_count_out"), "volume_in": F.col("volume_in"), "volume_out": F.col("volume_out"),
        "inout_volume_ratio": ratio(F.col("volume_in"), F.col("volume_out")), "secs_since_last_in": F.col("secs") - F.col("last_in"), "secs_since_last_out": F.col("secs") - F.col("last_out"),
        "turnover_latency": F.col("turnover_latency"), "distinct_counterparties_in": F.col("distinct_counterparties_in"), "distinct_counterparties_out": F.col("distinct_counterparties_out"),
        "unique_currencies_seen": F.col("unique_currencies_seen"), "unique_formats_seen": F.col("unique_formats_seen"),
        "mean_amount_in": F.try_divide(F.col("volume_in"), F.col("tx_count_in")), "mean_amount_out": F.try_divide(F.col("volume_out"), F.col("tx_count_out")),
        "amount_zscore_vs_own_history": zscore, "account_age_secs": F.coalesce(F.col("secs") - F.col("first_secs"), F.lit(0)),
    }
    s = s.select("tx_id", "dir", F.struct(*(v.alias(k) for k, v in values.items())).alias("v"))
    both = s.groupBy("tx_id").agg(F.max(F.when(F.col("dir") == "out", F.col("v"))).alias("src"), F.max(F.when(F.col("dir") == "in", F.col("v"))).alias("dst"))
    return both.select("tx_id", *(F.col(f"{end}.{k}").alias(f"{end}_{k}") for k in values for end in ENDS))


# Structure and motifs of the day before ---------------------------------------------------------------------------------


def lagged(tx: DataFrame, stats: DataFrame, columns: list[str]) -> DataFrame:
    """JN12: a transaction of day D with what its ends were in the snapshot of D - 1; null where an end was dormant then. The only way snapshots reach a transaction."""
    out = tx
    for end, node in ENDS.items():
        side = stats.select((F.col("day_idx") + 1).alias("day_idx"), F.col("node").alias(node), *(F.col(c).alias(f"{end}_{c}") for c in columns))
        out = out.join(side, ["day_idx", node], "left")
    return out


def ego(edges: DataFrame, ranks: DataFrame | None = None) -> DataFrame:
    """AGG12: undirected degree of each node, mean and largest degree of its neighbours, and their mean rank."""
    pairs = neighbour_pairs(edges)
    degree = pairs.groupBy("day_idx", F.col("node").alias("other")).agg(F.count("*").alias("degree"))
    if ranks is not None:
        degree = degree.join(ranks.select("day_idx", F.col("node").alias("other"), "rank"), ["day_idx", "other"])
    near = pairs.join(degree, ["day_idx", "other"]).groupBy("day_idx", "node")
    stats = [F.count("*").alias("ego_size"), F.avg("degree").alias("ego_mean_degree"), F.max("degree").alias("ego_max_degree")]
    return near.agg(*stats, *([F.avg("rank").alias("neighbour_pagerank_mean")] if ranks is not None else []))


def centrality(stats: DataFrame) -> DataFrame:
    """SC3, SC4: degrees over the number of active nodes less one."""
    days = stats.groupBy("day_idx").agg(F.greatest(F.count("*") - 1, F.lit(1)).alias("others"))  # a row a day
    others = F.col("others")
    return stats.join(F.broadcast(days), "day_idx").select("day_idx", "node", (F.col("in_degree") / others).alias("in_degree_centrality"), (F.col("out_degree") / others).alias("out_degree_centrality"))


def community_stats(edges: DataFrame, communities: DataFrame) -> DataFrame:
    """AGG11: day_idx, node, community, its size and density (undirected edges inside over possible ones, 0 below two nodes)."""
    size = communities.groupBy("day_idx", "community").agg(F.count("*").alias("community_size"))
    of = lambda end, name: communities.select("day_idx", F.col("node").alias(end), F.col("community").alias(name))
    pairs = neighbour_pairs(edges).where("node < other")
    inside = pairs.join(of("node", "community"), ["day_idx", "node"]).join(of("other", "c2"), ["day_idx", "other"]).where("community = c2").groupBy("day_idx", "community").agg(F.count("*").alias("inside"))
    s = F.col("community_size")
    dense = size.join(inside, ["day_idx", "community"], "left").withColumn("community_density", F.when(s < 2, F.lit(0.0)).otherwise(F.coalesce("inside", F.lit(0)) / (s * (s - 1) / 2))).drop("inside")
    return communities.join(dense, ["day_idx", "community"])


STRUCTURE = ["pagerank", "pagerank_rank_pct", "in_degree_centrality", "out_degree_centrality", "community_size", "community_density", "ego_size", "ego_mean_degree", "ego_max_degree", "neighbour_pagerank_mean"]


def structural(tx: DataFrame, edges: DataFrame, n_nodes: int, communities: DataFrame, rounds: int | None = None) -> DataFrame:
    """SC1-SC12."""
    ranks = pagerank(edges, n_nodes, rounds=rounds)
    stats = rank_percent(ranks).select("day_idx", "node", F.col("rank").alias("pagerank"), F.col("rank_pct").alias("pagerank_rank_pct"))
    stats = stats.join(centrality(node_stats(edges)), ["day_idx", "node"]).join(ego(edges, ranks), ["day_idx", "node"]).join(community_stats(edges, communities), ["day_idx", "node"])
    joined = lagged(tx, stats, [*STRUCTURE, "community"])
    same = (F.col("src_community") == F.col("dst_community")).cast("int").alias("same_community")
    return joined.select("tx_id", *(f"{end}_{c}" for c in STRUCTURE for end in ENDS), same, (F.col("day_idx") == 0).cast("int").alias("is_cold_start"))


def two_paths(edges: DataFrame) -> DataFrame:
    """JN14: day_idx, src, dst, paths of two steps. Counted before the shuffle; a hub's pairs are in + out rows joined on the hub, which Spark may split."""
    a = edges.select("day_idx", F.col("src").alias("i"), F.col("dst").alias("m"))
    b = edges.select("day_idx", F.col("src").alias("m"), F.col("dst").alias("j"))
    return a.join(b, ["day_idx", "m"]).groupBy("day_idx", "i", "j").agg(F.count("*").alias("paths"))


def closed_walks(edges: DataFrame, paths: DataFrame | None = None) -> DataFrame:
    """MT1-MT3: closed walks of 2, 3 and 4 steps from each node that has any."""
    paths = two_paths(edges) if paths is None else paths
    back = edges.select("day_idx", F.col("dst").alias("i"), F.col("src").alias("j"))
    walk = lambda df, name, n: df.groupBy("day_idx", F.col("i").alias("node")).agg(F.sum(n).alias("n")).select("day_idx", "node", F.lit(name).alias("walk"), "n")
    two = walk(edges.select("day_idx", F.col("src").alias("i"), F.col("dst").alias("j")).join(back, ["day_idx", "i", "j"]), "cycle_2hop", F.lit(1))
    three = walk(paths.join(back, ["day_idx", "i", "j"]), "cycle_3hop", F.col("paths"))
    reverse = paths.select("day_idx", F.col("j").alias("i"), F.col("i").alias("j"), F.col("paths").alias("back"))
    four = walk(paths.join(reverse, ["day_idx", "i", "j"]), "cycle_4hop", F.col("paths") * F.col("back"))
    found = two.unionAll(three).unionAll(four).groupBy("day_idx", "node")
    return found.agg(*(F.sum(F.when(F.col("walk") == k, F.col("n")).otherwise(0)).alias(k) for k in ("cycle_2hop", "cycle_3hop", "cycle_4hop")))


def bursts(stats: DataFrame) -> DataFrame:
    """MT4-MT6: growth of the degrees since the day before; null on the first day that has a snapshot at all, or after a day without."""
    before = stats.select((F.col("day_idx") + 1).alias("day_idx"), "node", F.col("out_degree").alias("out_before"), F.col("in_degree").alias("in_before"))
    days = stats.select((F.col("day_idx") + 1).alias("day_idx"), F.lit(True).alias("had")).distinct()
    joined = stats.join(before, ["day_idx", "node"], "left").join(days, "day_idx", "left")
    grown = lambda now, then: F.when(F.col("had"), F.col(now) - F.coalesce(then, F.lit(0)))
    both = joined.select("day_idx", "node", grown("out_degree", "out_before").alias("fanout_burst"), grown("in_degree", "in_before").alias("fanin_burst"))
    return both.withColumn("gather_scatter_score", F.col("fanout_burst") * F.col("fanin_burst"))


MOTIFS = ["cycle_2hop", "cycle_3hop", "cycle_4hop", "fanout_burst", "fanin_burst", "gather_scatter_score", "amount_conservation"]


def common_neighbours(tx: DataFrame, edges: DataFrame) -> DataFrame:
    """MT8: tx_id, common_neighbours in the undirected graph of the day before, null unless both ends were active then. Driven by the distinct pairs that transactions ask for."""
    pairs = neighbour_pairs(edges)
    day = (F.col("day_idx") - 1).alias("day_idx")
    asked = tx.select(day, F.col("src_node").alias("a"), F.col("dst_node").alias("b")).distinct()
    of = lambda end, other: pairs.select("day_idx", F.col("node").alias(end), F.col("other").alias(other))
    met = asked.join(of("a", "o"), ["day_idx", "a"]).join(of("b", "o"), ["day_idx", "b", "o"]).groupBy("day_idx", "a", "b").agg(F.count("*").alias("common_neighbours"))
    active = pairs.select("day_idx", "node").distinct()
    both = asked.join(active.select("day_idx", F.col("node").alias("a")), ["day_idx", "a"], "left_semi").join(active.select("day_idx", F.col("node").alias("b")), ["day_idx", "b"], "left_semi")
    answers = both.join(met, ["day_idx", "a", "b"], "left").select((F.col("day_idx") + 1).alias("day_idx"), F.col("a").alias("src_node"), F.col("b").alias("dst_node"), F.coalesce("common_neighbours", F.lit(0)).alias("common_neighbours"))
    return tx.join(answers, ["day_idx", "src_node", "dst_node"], "left").select("tx_id", "common_neighbours")


def motif_stats(edges: DataFrame) -> DataFrame:
    stats = node_stats(edges)
    kept = stats.select("day_idx", "node", ratio(F.col("out_strength"), F.col("in_strength")).alias("amount_conservation"))
    walks = closed_walks(edges)
    joined = kept.join(bursts(stats), ["day_idx", "node"]).join(walks, ["day_idx", "node"], "left")
    return joined.select("day_idx", "node", *(F.coalesce(c, F.lit(0)).alias(c) if c.startswith("cycle") else F.col(c) for c in MOTIFS))


def motifs(tx: DataFrame, edges: DataFrame) -> DataFrame:
    """MT1-MT8."""
    joined = lagged(tx, motif_stats(edges), MOTIFS).select("tx_id", *(f"{end}_{c}" for c in MOTIFS for end in ENDS))
    return joined.join(common_neighbours(tx, edges), "tx_id")


