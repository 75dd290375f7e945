"""The engine's queries over the test tables, by inventory id, each with its oracle where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidegraph.functions.scalars import alphabet_mask, cents, mask_size, wilson
from tidegraph.operators import evaluate as ev
from tidegraph.operators import features as feats
from tidegraph.operators import backends, graph, ingest, models, splits
from tidegraph.operators import snapshots as snap
from tidegraph.operators.louvain import communities
from tidegraph.plans import assemble as asm
from tidegraph.plans import oracle as o
from tidegraph.plans.config import Config
from tidegraph.sources.views import event_scores, event_stream, event_typology, family, node_space, table, txn_events, txn_sales
from tidegraph.streaming import account_stream as st

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
UNIT = "payment_format"  # the unit of account of the event graph, of which there are several


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c).cast("double"), 6) for c in columns})


def edges(s: SparkSession, d: str, lookback: int | None = None) -> DataFrame:
    return snap.snapshots(txn_events(s, d), 9, lookback, UNIT)


def test_scores(s: SparkSession, d: str, split: str = "test") -> DataFrame:
    return event_scores(txn_events(s, d)).where(F.col("split") == split)


def arms(s: SparkSession, d: str) -> dict[str, DataFrame]:
    scored = test_scores(s, d)
    other = ((F.col("tx_id") * 104729 + F.col("src_node") * 7919 + F.col("label") * 300) % 1000) / 1000
    return {"E1": scored, "E2": scored.withColumn("score", other)}


ARMS_SQL = f"""{o.EVENTS}, {o.TYPOLOGY}, {o.SCORES}, ar AS (SELECT 'E1' AS arm, tx_id, score, label FROM sc WHERE split = 'test'
  UNION ALL SELECT 'E2', tx_id, ((tx_id * 104729 + src_node * 7919 + label * 300) % 1000) / 1000.0::DOUBLE, label FROM sc WHERE split = 'test'),
  th AS (SELECT arm, min(score) AS t FROM (SELECT arm, score, row_number() OVER (PARTITION BY arm ORDER BY score DESC) AS k FROM ar) WHERE k <= 100 GROUP BY arm),
  re AS (SELECT ar.arm, coalesce(typology, 'UNANNOTATED') AS typology, count(*) AS n_positives, count(*) FILTER (score >= t) AS n_detected, count(DISTINCT attempt_id) AS n_attempts
    FROM ar JOIN th USING (arm) LEFT JOIN ty USING (tx_id) WHERE label = 1 GROUP BY ALL)"""


# Ingest -----------------------------------------------------------------------------------------------------------------


@query("prj2_day_idx", f"WITH {o.ALL_EVENTS} SELECT tx_id, day_idx, secs FROM ev_all")
def _(s, d):
    return txn_events(s, d, None).select("tx_id", "day_idx", "secs")


@query("prj3_flags", f"WITH {o.SALES} SELECT tx_id, src_node = dst_node AS is_self_loop, currency_paid <> currency_received AS is_cross_currency, src_bank <> dst_bank AS is_cross_bank FROM sa")
def _(s, d):
    return txn_sales(s, d).select("tx_id", "is_self_loop", "is_cross_currency", "is_cross_bank")


@query("prj5_cents", f"WITH {o.EVENTS} SELECT tx_id, cents FROM ev")
def _(s, d):
    return txn_events(s, d).select("tx_id", cents(F.col("amount_paid")).alias("cents"))


@query("flt1_window", f"WITH {o.EVENTS} SELECT day_idx, count(*) AS n FROM ev GROUP BY day_idx")
def _(s, d):
    return txn_events(s, d).groupBy("day_idx").agg(F.count("*").alias("n"))


@query("flt2_no_self_loops", f"WITH {o.EVENTS} SELECT tx_id, src_node, dst_node FROM ev WHERE NOT self")
def _(s, d):
    return snap.graph_rows(txn_events(s, d), 9).select("tx_id", "src_node", "dst_node")


@query("flt8_backwards", f"WITH {o.EVENTS} SELECT count(*) FILTER (back) AS n_backwards FROM (SELECT lag(secs) OVER (ORDER BY tx_id) > secs AS back FROM ev)")
def _(s, d):
    return ingest.backwards(txn_events(s, d))


@query("win1_tx_id", f"WITH {o.SALES} SELECT tx_id, secs, l_orderkey, src_node, dst_node FROM sa")
def _(s, d):
    return txn_sales(s, d).select("tx_id", "secs", "l_orderkey", "src_node", "dst_node")


@query("win3_node_ids", f"WITH {o.SALES}, {o.BANKS} SELECT row_number() OVER (ORDER BY bank, acct) - 1 AS node_id, bank, acct FROM bk")
def _(s, d):
    return ingest.node_index(_accounts(s, d), ["bank", "acct"])


def _accounts(s: SparkSession, d: str) -> DataFrame:
    return ingest.endpoints(txn_sales(s, d, False), ["src_bank", "src_node"], ["dst_bank", "dst_node"], ["bank", "acct"])


@query("set1_distinct_nodes", f"WITH {o.SALES}, {o.BANKS} SELECT bank, acct FROM bk")
def _(s, d):
    return _accounts(s, d)


@query(
    "jn2_encode_unknown",
    f"WITH {o.SALES}, {o.BANKS}, ix AS (SELECT row_number() OVER (ORDER BY bank, acct) - 1 AS node_id, bank, acct FROM bk) SELECT c_custkey, coalesce(node_id, -1) AS node FROM customer LEFT JOIN ix ON c_nationkey + 1 = bank AND c_custkey = acct",
)
def _(s, d):
    index = ingest.node_index(_accounts(s, d), ["bank", "acct"])
    asked = table(s, d, "customer").select("c_custkey", (F.col("c_nationkey") + 1).alias("b"), F.col("c_custkey").alias("a"))
    return ingest.encode(asked, index, ["b", "a"], "node").select("c_custkey", "node")


@query("jn1_intern", f"WITH {o.SALES}, {o.BANKS}, ix AS (SELECT row_number() OVER (ORDER BY bank, acct) - 1 AS node_id, bank, acct FROM bk) SELECT tx_id, a.node_id AS src, b.node_id AS dst FROM sa JOIN ix a ON src_bank = a.bank AND src_node = a.acct JOIN ix b ON dst_bank = b.bank AND dst_node = b.acct")
def _(s, d):
    tx = txn_sales(s, d)
    index = ingest.node_index(ingest.endpoints(tx, ["src_bank", "src_node"], ["dst_bank", "dst_node"], ["bank", "acct"]), ["bank", "acct"])
    return ingest.encode(ingest.encode(tx, index, ["src_bank", "src_node"], "src"), index, ["dst_bank", "dst_node"], "dst").select("tx_id", "src", "dst")


@query("jn3_decode", "SELECT s_suppkey, s_nationkey AS bank, s_suppkey AS acct FROM supplier")
def _(s, d):
    index = ingest.node_index(table(s, d, "supplier").select(F.col("s_nationkey").alias("bank"), F.col("s_suppkey").alias("acct")), ["bank", "acct"])
    known = index.select(F.col("acct").alias("s_suppkey"), F.col("node_id").alias("n"))
    return ingest.decode(known, index, "n").select("s_suppkey", "bank", "acct")


@query("set7_shared_codes", f"WITH {o.SALES} SELECT value, row_number() OVER (ORDER BY value) - 1 AS code FROM (SELECT currency_paid AS value FROM sa UNION SELECT currency_received FROM sa)")
def _(s, d):
    return ingest.aligned_codes(txn_sales(s, d, False), ["currency_paid", "currency_received"])


@query(
    "agg7_validate",
    f"""WITH {o.SALES} SELECT count(*) AS n_rows, sum(label)::BIGINT AS n_illicit, count(*) FILTER (src_node = dst_node) AS n_self_loops, count(*) FILTER (currency_paid <> currency_received) AS n_cross_currency,
    count(*) FILTER (src_bank <> dst_bank) AS n_cross_bank, count(*) FILTER (src_node = dst_node AND label = 1) AS n_self_loop_illicit, min(secs) AS first_secs, max(secs) AS last_secs, 0 AS n_null_rows,
    (SELECT count(*) FROM (SELECT src_node FROM sa UNION SELECT dst_node FROM sa)) AS n_nodes FROM sa""",
)
def _(s, d):
    return ingest.validate(txn_sales(s, d, False))


# Annotated rows ---------------------------------------------------------------------------------------------------------


def patterns(s: SparkSession, d: str) -> DataFrame:
    """The annotated positives as pattern rows; every 50th has another amount, so that it finds no transaction."""
    rows = txn_events(s, d).where("label = 1 AND tx_id % 3 <> 0").withColumn("cents", cents(F.col("amount_paid")) + F.when(F.expr("tx_id % 50 = 1"), 1).otherwise(0))
    from tidegraph.operators.ordering import with_position

    return with_position(rows, ["tx_id"], "at").select((F.col("at") + 1).alias("pattern_row"), *ingest.KEY)


KEY_SQL = "secs, src_node, dst_node, cents, currency_paid, payment_format"
ILLICIT = "il AS (SELECT tx_id, secs, src_node, dst_node, cents, 'USD' AS currency_paid, fmt AS payment_format, label FROM ev)"


@query("win2_cumcount", f"WITH {o.EVENTS} SELECT tx_id, row_number() OVER (PARTITION BY src_node, fmt ORDER BY tx_id) - 1 AS occ FROM ev WHERE label = 1")
def _(s, d):
    tx = txn_events(s, d).where("label = 1")
    return tx.select("tx_id", (F.row_number().over(W.partitionBy("src_node", "payment_format").orderBy("tx_id")) - 1).cast("long").alias("occ"))


@query(
    "jn5_rank_join",
    f"""WITH {o.EVENTS}, {o.PATTERNS}, {ILLICIT}, p AS (SELECT *, row_number() OVER (PARTITION BY {KEY_SQL} ORDER BY pattern_row) AS occ FROM pa), t AS (SELECT *, row_number() OVER (PARTITION BY {KEY_SQL} ORDER BY tx_id) AS occ FROM il WHERE label = 1)
    SELECT p.pattern_row, t.tx_id FROM p LEFT JOIN t USING ({KEY_SQL}, occ)""",
)
def _(s, d):
    return ingest.link(patterns(s, d), txn_events(s, d)).select(F.col("pattern_row").cast("long").alias("pattern_row"), "tx_id")


@query("jn6_ambiguity", f"WITH {o.EVENTS}, {o.PATTERNS}, {ILLICIT} SELECT count(*) AS n_ambiguous FROM (SELECT {KEY_SQL}, count(*) AS n FROM pa GROUP BY ALL) p JOIN (SELECT {KEY_SQL}, count(*) AS m FROM il WHERE label = 1 GROUP BY ALL) t USING ({KEY_SQL}) WHERE m > n")
def _(s, d):
    return ingest.ambiguous(patterns(s, d), txn_events(s, d)).agg(F.count("*").alias("n_ambiguous"))


@query("jn7_collisions", f"WITH {o.EVENTS}, {o.PATTERNS}, {ILLICIT} SELECT count(*) AS n_collisions FROM pa WHERE EXISTS (SELECT 1 FROM il WHERE label = 0 AND il.secs = pa.secs AND il.src_node = pa.src_node AND il.dst_node = pa.dst_node AND il.cents = pa.cents AND il.payment_format = pa.payment_format)")
def _(s, d):
    return ingest.licit_collisions(patterns(s, d), txn_events(s, d)).agg(F.count("*").alias("n_collisions"))


@query("jn8_attach_typology", f"WITH {o.EVENTS}, {o.TYPOLOGY} SELECT ev.tx_id, attempt_id, coalesce(typology, CASE WHEN label = 1 THEN 'UNANNOTATED' END) AS typology FROM ev LEFT JOIN ty USING (tx_id)")
def _(s, d):
    tx = txn_events(s, d)
    return ingest.attach_typology(tx, event_typology(tx)).select("tx_id", "attempt_id", "typology")


@query("agg8_link_coverage", f"WITH {o.EVENTS}, {o.TYPOLOGY} SELECT count(*) FILTER (label = 1) AS n_illicit, count(ty.tx_id) AS n_annotated, round(count(ty.tx_id) / count(*) FILTER (label = 1)::DOUBLE, 6) AS coverage, count(DISTINCT attempt_id) AS n_attempts FROM ev LEFT JOIN ty USING (tx_id)")
def _(s, d):
    tx = txn_events(s, d)
    joined = tx.join(event_typology(tx), "tx_id", "left")
    return rounded(joined.agg(F.sum("label").alias("n_illicit"), F.count("typology").alias("n_annotated"), (F.count("typology") / F.sum("label")).alias("coverage"), F.countDistinct("attempt_id").alias("n_attempts")), "coverage")


@query("agg9_attempts_per_family", f"WITH {o.EVENTS}, {o.TYPOLOGY} SELECT typology, count(DISTINCT attempt_id) AS n_attempts FROM ty GROUP BY typology")
def _(s, d):
    return event_typology(txn_events(s, d)).groupBy("typology").agg(F.countDistinct("attempt_id").alias("n_attempts"))


@query("agg26_duplicate_keys", "SELECT l_orderkey, count(*) AS count FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1".replace("l_orderkey, count", "l_orderkey * 100 + l_linenumber AS key, count"))
def _(s, d):
    keys = table(s, d, "lineitem").select((F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("key"))
    return ingest.assert_unique(keys, "key")


# Snapshots and graph ----------------------------------------------------------------------------------------------------


EDGE_SQL = "SELECT day_idx, src, dst, round(w_amount, 6) AS w_amount, round(w_norm, 6) AS w_norm, tx_count, last_ts FROM ed"


@query("agg1_edges_cumulative", f"WITH {o.GRAPH} {EDGE_SQL}")
def _(s, d):
    return rounded(edges(s, d), "w_amount", "w_norm")


@query("agg1_edges_lookback3", f"WITH {o.EVENTS}, {o.EDGES.format(first='d - 2')} {EDGE_SQL}")
def _(s, d):
    return rounded(edges(s, d, 3), "w_amount", "w_norm")


@query("agg1_edges_lookback1", f"WITH {o.EVENTS}, {o.EDGES.format(first='d')} {EDGE_SQL}")
def _(s, d):
    return rounded(edges(s, d, 1), "w_amount", "w_norm")


@query("agg1_sales_collapse", f"WITH {o.SALES} SELECT src_node AS src, dst_node AS dst, sum(cents)::BIGINT / 100 AS w_amount, count(*) AS tx_count, max(secs) AS last_ts FROM sa WHERE src_node <> dst_node GROUP BY ALL")
def _(s, d):
    rows = snap.graph_rows(txn_sales(s, d, False)).withColumn("amount_norm", F.lit(1.0))
    return snap.collapse_edges(rows).drop("w_norm")


@query("agg2_degrees", f"WITH {o.GRAPH}, {o.STATS} SELECT day_idx, node, out_degree, in_degree FROM st")
def _(s, d):
    return graph.node_stats(edges(s, d)).select("day_idx", "node", "out_degree", "in_degree")


@query("agg3_strengths", f"WITH {o.GRAPH}, {o.STATS} SELECT day_idx, node, round(out_strength, 6) AS out_strength, round(in_strength, 6) AS in_strength FROM st")
def _(s, d):
    return rounded(graph.node_stats(edges(s, d)).select("day_idx", "node", "out_strength", "in_strength"), "out_strength", "in_strength")


@query("agg4_tx_counts", f"WITH {o.GRAPH}, {o.STATS} SELECT day_idx, node, out_tx, in_tx FROM st")
def _(s, d):
    return graph.node_stats(edges(s, d)).select("day_idx", "node", "out_tx", "in_tx")


@query("agg5_active", f"WITH {o.GRAPH} SELECT day_idx, count(*) AS n_active FROM (SELECT day_idx, src FROM ed UNION SELECT day_idx, dst FROM ed) GROUP BY day_idx")
def _(s, d):
    return graph.active_nodes(edges(s, d)).groupBy("day_idx").agg(F.count("*").alias("n_active"))


@query("agg6_medians", f"WITH {o.EVENTS} SELECT fmt AS currency, median(amount) AS median FROM ev WHERE NOT self GROUP BY fmt HAVING median(amount) > 0")
def _(s, d):
    return snap.currency_medians(snap.graph_rows(txn_events(s, d)), UNIT)


@query("prj6_norm_amount", f"WITH {o.GRAPH} SELECT tx_id, round(norm, 6) AS amount_norm FROM gr")
def _(s, d):
    rows = snap.graph_rows(txn_events(s, d))
    return rounded(snap.normalised(rows, snap.currency_medians(rows, UNIT), UNIT).select("tx_id", "amount_norm"), "amount_norm")


@query("agg10_snapshot_summary", f"WITH {o.GRAPH} SELECT day_idx, n_rows, n_edges, n_active, round(n_rows / n_edges, 2) AS collapse_ratio FROM (SELECT day_idx, sum(tx_count)::BIGINT AS n_rows, count(*) AS n_edges FROM ed GROUP BY day_idx) JOIN (SELECT day_idx, count(*) AS n_active FROM (SELECT day_idx, src FROM ed UNION SELECT day_idx, dst FROM ed) GROUP BY day_idx) USING (day_idx)")
def _(s, d):
    return snap.summary(edges(s, d))


@query("jn16_window_membership", f"WITH {o.EVENTS}, days AS (SELECT unnest(range(0, 10))::INTEGER AS d) SELECT d AS day_idx, count(*) AS n FROM days JOIN ev ON day_idx BETWEEN d - 2 AND d GROUP BY d")
def _(s, d):
    seen = txn_events(s, d).select(F.explode(snap.window_days(F.col("day_idx"), 0, 9, 3)).alias("day_idx"))
    return seen.groupBy("day_idx").agg(F.count("*").alias("n"))


@query("gr4_undirected", f"WITH {o.GRAPH} SELECT day_idx, least(src, dst) AS a, greatest(src, dst) AS b, round(sum(w_norm), 6) AS weight FROM ed GROUP BY ALL")
def _(s, d):
    return rounded(graph.undirected(edges(s, d)), "weight")


@query("gr5_adjacency", f"WITH {o.GRAPH}, {o.PAIRS} SELECT day_idx, count(*) AS n FROM un GROUP BY day_idx")
def _(s, d):
    return graph.neighbour_pairs(edges(s, d)).groupBy("day_idx").agg(F.count("*").alias("n"))


@query("gr6_neighbours", f"WITH {o.GRAPH} SELECT day_idx, src AS other FROM ed WHERE dst = 1 UNION SELECT day_idx, dst FROM ed WHERE src = 1")
def _(s, d):
    return graph.neighbours(edges(s, d), 1, "all")


@query("gr7_checked_edges", f"WITH {o.GRAPH} SELECT count(*) AS n, sum(src)::BIGINT AS src FROM ed")
def _(s, d):
    return graph.check_edges(edges(s, d), node_space(txn_events(s, d))).agg(F.count("*").alias("n"), F.sum("src").alias("src"))


@query("gr9_sampled_subgraph")
def _(s, d):
    return graph.sampled_subgraph(edges(s, d).where("day_idx = 9"), 200)


@query("gr10_ego_top_k", f"""WITH {o.GRAPH}, x AS (SELECT day_idx, 'out' AS direction, dst AS other, tx_count FROM ed WHERE src = 1 UNION ALL SELECT day_idx, 'in', src, tx_count FROM ed WHERE dst = 1)
  SELECT day_idx, direction, other, tx_count, greatest(n - 5, 0) AS hidden FROM (SELECT *, row_number() OVER (PARTITION BY day_idx, direction ORDER BY tx_count DESC, other) AS rn, count(*) OVER (PARTITION BY day_idx, direction) AS n FROM x) WHERE rn <= 5""")
def _(s, d):
    return graph.ego_edges(edges(s, d), 1, 5)


@query("gr1_pagerank_k20", f"WITH {o.GRAPH}, {o.pagerank(20)} SELECT day_idx, node, round(rank, 9) AS rank FROM r20")
def _(s, d):
    return graph.pagerank(edges(s, d), node_space(txn_events(s, d)), rounds=20).withColumn("rank", F.round("rank", 9))


@query("gr1_pagerank_converged")
def _(s, d):
    return graph.pagerank(edges(s, d), node_space(txn_events(s, d)))


@query("win4_rank_pct", f"WITH {o.GRAPH}, {o.STATS} SELECT day_idx, node, round((row_number() OVER (PARTITION BY day_idx ORDER BY in_tx, node) - 1) / greatest(count(*) OVER (PARTITION BY day_idx) - 1, 1)::DOUBLE, 6) AS rank_pct FROM st")
def _(s, d):
    stats = graph.node_stats(edges(s, d)).select("day_idx", "node", F.col("in_tx").alias("rank"))
    return rounded(graph.rank_percent(stats).select("day_idx", "node", "rank_pct"), "rank_pct")


@query("sc3_4_centrality", f"WITH {o.GRAPH}, {o.STATS} SELECT day_idx, node, round(in_degree / greatest(n - 1, 1)::DOUBLE, 6) AS in_degree_centrality, round(out_degree / greatest(n - 1, 1)::DOUBLE, 6) AS out_degree_centrality FROM (SELECT *, count(*) OVER (PARTITION BY day_idx) AS n FROM st)")
def _(s, d):
    return rounded(feats.centrality(graph.node_stats(edges(s, d))), "in_degree_centrality", "out_degree_centrality")


@query("sc7_10_ego", f"WITH {o.GRAPH}, {o.PAIRS}, dg AS (SELECT day_idx, node, count(*) AS k FROM un GROUP BY ALL) SELECT un.day_idx, un.node, count(*) AS ego_size, round(avg(k), 6) AS ego_mean_degree, max(k) AS ego_max_degree FROM un JOIN dg ON un.day_idx = dg.day_idx AND un.other = dg.node GROUP BY ALL")
def _(s, d):
    return rounded(feats.ego(edges(s, d)), "ego_mean_degree")


@query("gr3_louvain")
def _(s, d):
    return communities(edges(s, d))


@query("agg11_community", f"""WITH {o.GRAPH}, {o.PAIRS}, cm AS (SELECT DISTINCT day_idx, node, node % 4 AS community FROM un),
  sz AS (SELECT day_idx, community, count(*) AS z FROM cm GROUP BY ALL), ins AS (SELECT a.day_idx, a.community, count(*) AS k FROM un JOIN cm a ON un.day_idx = a.day_idx AND un.node = a.node JOIN cm b ON un.day_idx = b.day_idx AND un.other = b.node WHERE a.community = b.community AND un.node < un.other GROUP BY ALL)
  SELECT cm.day_idx, node, cm.community, z AS community_size, round(CASE WHEN z < 2 THEN 0 ELSE coalesce(k, 0) / (z * (z - 1) / 2) END, 6) AS community_density FROM cm JOIN sz USING (day_idx, community) LEFT JOIN ins USING (day_idx, community)""")
def _(s, d):
    e = edges(s, d)
    given = graph.active_nodes(e).withColumn("community", F.col("node") % 4)
    return rounded(feats.community_stats(e, given), "community_density").select("day_idx", "node", "community", "community_size", "community_density")


@query("jn12_lagged_degree", f"WITH {o.GRAPH}, {o.STATS} SELECT ev.tx_id, ev.day_idx, a.out_degree AS src_out_degree, a.in_degree AS src_in_degree, b.out_degree AS dst_out_degree, b.in_degree AS dst_in_degree FROM ev LEFT JOIN st a ON a.day_idx = ev.day_idx - 1 AND a.node = ev.src_node LEFT JOIN st b ON b.day_idx = ev.day_idx - 1 AND b.node = ev.dst_node")
def lagged_degree(s, d):
    joined = feats.lagged(txn_events(s, d), graph.node_stats(edges(s, d)), ["out_degree", "in_degree"])
    return joined.select("tx_id", "day_idx", *(f"{e}_{c}" for e in feats.ENDS for c in ("out_degree", "in_degree")))


@query("gr11_rank_agreement", f"WITH {o.GRAPH}, {o.STATS}, x AS (SELECT * FROM st WHERE day_idx = 9) SELECT round(corr(out_degree, in_degree), 6) AS correlation, (SELECT count(*) FROM (SELECT node FROM x ORDER BY out_tx DESC, node LIMIT 20) INNER JOIN (SELECT node FROM x ORDER BY in_tx DESC, node LIMIT 20) USING (node)) AS top_overlap FROM x")
def _(s, d):
    x = graph.node_stats(edges(s, d)).where("day_idx = 9")
    top = lambda c: x.orderBy(F.desc(c), "node").limit(20).select("node")
    return rounded(x.agg(F.corr("out_degree", "in_degree").alias("correlation")).join(top("out_tx").intersect(top("in_tx")).agg(F.count("*").alias("top_overlap"))), "correlation")


# Motifs -----------------------------------------------------------------------------------------------------------------

LAST = f"{o.GRAPH}, {o.STATS}"


@query("mt1_cycle2", f"WITH {LAST} SELECT a.day_idx, a.src AS node, count(*) AS n FROM ed a JOIN ed b ON a.day_idx = b.day_idx AND a.src = b.dst AND a.dst = b.src GROUP BY ALL")
def _(s, d):
    return feats.closed_walks(edges(s, d)).where("cycle_2hop > 0").select("day_idx", "node", F.col("cycle_2hop").alias("n"))


@query("mt2_cycle3", f"WITH {LAST} SELECT a.day_idx, a.src AS node, count(*) AS n FROM ed a JOIN ed b ON a.day_idx = b.day_idx AND a.dst = b.src JOIN ed c ON c.day_idx = b.day_idx AND b.dst = c.src AND c.dst = a.src GROUP BY ALL")
def _(s, d):
    return feats.closed_walks(edges(s, d)).where("cycle_3hop > 0").select("day_idx", "node", F.col("cycle_3hop").alias("n"))


@query("mt3_cycle4", f"WITH {LAST}, p2 AS (SELECT a.day_idx, a.src AS i, b.dst AS j, count(*) AS n FROM ed a JOIN ed b ON a.day_idx = b.day_idx AND a.dst = b.src GROUP BY ALL) SELECT x.day_idx, x.i AS node, sum(x.n * y.n)::BIGINT AS n FROM p2 x JOIN p2 y ON x.day_idx = y.day_idx AND x.i = y.j AND x.j = y.i GROUP BY ALL")
def _(s, d):
    return feats.closed_walks(edges(s, d)).where("cycle_4hop > 0").select("day_idx", "node", F.col("cycle_4hop").alias("n"))


@query("jn14_two_paths", f"WITH {LAST} SELECT a.day_idx, count(*) AS n_walks, count(DISTINCT a.src * 10000 + b.dst) AS n_pairs FROM ed a JOIN ed b ON a.day_idx = b.day_idx AND a.dst = b.src GROUP BY a.day_idx")
def _(s, d):
    return feats.two_paths(edges(s, d)).groupBy("day_idx").agg(F.sum("paths").alias("n_walks"), F.count("*").alias("n_pairs"))


@query("mt4_6_bursts", f"WITH {LAST} SELECT st.day_idx, st.node, CASE WHEN st.day_idx > 0 THEN st.out_degree - coalesce(p.out_degree, 0) END AS fanout_burst, CASE WHEN st.day_idx > 0 THEN st.in_degree - coalesce(p.in_degree, 0) END AS fanin_burst, CASE WHEN st.day_idx > 0 THEN (st.out_degree - coalesce(p.out_degree, 0)) * (st.in_degree - coalesce(p.in_degree, 0)) END AS gather_scatter_score FROM st LEFT JOIN st p ON p.day_idx = st.day_idx - 1 AND p.node = st.node")
def _(s, d):
    return feats.bursts(graph.node_stats(edges(s, d)))


@query("mt7_conservation", f"WITH {LAST} SELECT day_idx, node, round(CASE WHEN in_strength > 0 THEN out_strength / in_strength END, 6) AS amount_conservation FROM st")
def _(s, d):
    from tidegraph.functions.scalars import ratio

    return rounded(graph.node_stats(edges(s, d)).select("day_idx", "node", ratio(F.col("out_strength"), F.col("in_strength")).alias("amount_conservation")), "amount_conservation")


@query("mt8_common_neighbours", f"""WITH {o.GRAPH}, {o.PAIRS}, ac AS (SELECT DISTINCT day_idx, node FROM un)
  SELECT ev.tx_id, CASE WHEN a.node IS NOT NULL AND b.node IS NOT NULL THEN (SELECT count(*) FROM un x JOIN un y ON x.day_idx = y.day_idx AND x.other = y.other WHERE x.day_idx = ev.day_idx - 1 AND x.node = ev.src_node AND y.node = ev.dst_node) END AS common_neighbours
  FROM ev LEFT JOIN ac a ON a.day_idx = ev.day_idx - 1 AND a.node = ev.src_node LEFT JOIN ac b ON b.day_idx = ev.day_idx - 1 AND b.node = ev.dst_node""")
def _(s, d):
    return feats.common_neighbours(txn_events(s, d), edges(s, d))


@query("mt_lagged_motifs", f"""WITH {LAST}, c2 AS (SELECT a.day_idx, a.src AS node, count(*) AS n FROM ed a JOIN ed b ON a.day_idx = b.day_idx AND a.src = b.dst AND a.dst = b.src GROUP BY ALL),
  c3 AS (SELECT a.day_idx, a.src AS node, count(*) AS n FROM ed a JOIN ed b ON a.day_idx = b.day_idx AND a.dst = b.src JOIN ed c ON c.day_idx = b.day_idx AND b.dst = c.src AND c.dst = a.src GROUP BY ALL),
  m AS (SELECT st.day_idx, st.node, coalesce(c2.n, 0) AS two, coalesce(c3.n, 0) AS three, CASE WHEN st.day_idx > 0 THEN st.out_degree - coalesce(p.out_degree, 0) END AS burst
    FROM st LEFT JOIN c2 ON c2.day_idx = st.day_idx AND c2.node = st.node LEFT JOIN c3 ON c3.day_idx = st.day_idx AND c3.node = st.node LEFT JOIN st p ON p.day_idx = st.day_idx - 1 AND p.node = st.node)
  SELECT ev.tx_id, a.two AS src_cycle_2hop, b.two AS dst_cycle_2hop, a.three AS src_cycle_3hop, b.three AS dst_cycle_3hop, a.burst AS src_fanout_burst, b.burst AS dst_fanout_burst
  FROM ev LEFT JOIN m a ON a.day_idx = ev.day_idx - 1 AND a.node = ev.src_node LEFT JOIN m b ON b.day_idx = ev.day_idx - 1 AND b.node = ev.dst_node""")
def _(s, d):
    joined = feats.lagged(txn_events(s, d), feats.motif_stats(edges(s, d)), ["cycle_2hop", "cycle_3hop", "fanout_burst"])
    return joined.select("tx_id", *(f"{e}_{c}" for c in ("cycle_2hop", "cycle_3hop", "fanout_burst") for e in feats.ENDS))


@query("sc_lagged_structure", f"""WITH {LAST}, {o.PAIRS}, c AS (SELECT day_idx, node, out_degree / greatest(count(*) OVER (PARTITION BY day_idx) - 1, 1)::DOUBLE AS oc FROM st), dg AS (SELECT day_idx, node, count(*) AS k FROM un GROUP BY ALL),
  x AS (SELECT c.day_idx, c.node, oc, k FROM c JOIN dg USING (day_idx, node))
  SELECT ev.tx_id, round(a.oc, 6) AS src_out_degree_centrality, round(b.oc, 6) AS dst_out_degree_centrality, a.k AS src_ego_size, b.k AS dst_ego_size, (ev.day_idx = 0)::INTEGER AS is_cold_start
  FROM ev LEFT JOIN x a ON a.day_idx = ev.day_idx - 1 AND a.node = ev.src_node LEFT JOIN x b ON b.day_idx = ev.day_idx - 1 AND b.node = ev.dst_node""")
def _(s, d):
    e = edges(s, d)
    stats = feats.centrality(graph.node_stats(e)).join(feats.ego(e), ["day_idx", "node"])
    joined = feats.lagged(txn_events(s, d), stats, ["out_degree_centrality", "ego_size"])
    columns = [f"{end}_{c}" for c in ("out_degree_centrality", "ego_size") for end in feats.ENDS]
    return rounded(joined.select("tx_id", *columns, (F.col("day_idx") == 0).cast("int").alias("is_cold_start")), "src_out_degree_centrality", "dst_out_degree_centrality")


# Row-local features -----------------------------------------------------------------------------------------------------


@query("tb_amounts", f"WITH {o.SALES} SELECT tx_id, round(ln(1 + paid), 6) AS log_amount_paid, round(ln(1 + received), 6) AS log_amount_received, round(CASE WHEN paid > 0 THEN received / paid END, 6) AS amount_mismatch_ratio FROM sa")
def _(s, d):
    return rounded(feats.tabular(txn_sales(s, d), columns=["log_amount_paid", "log_amount_received", "amount_mismatch_ratio"]), "log_amount_paid", "log_amount_received", "amount_mismatch_ratio")


@query("tb_codes", f"WITH {o.SALES} SELECT tx_id, dense_rank() OVER (ORDER BY currency_paid) - 1 AS currency_paid_code, dense_rank() OVER (ORDER BY currency_received) - 1 AS currency_received_code, dense_rank() OVER (ORDER BY fmt) - 1 AS payment_format_code FROM sa")
def _(s, d):
    return feats.tabular(txn_sales(s, d), columns=["currency_paid_code", "currency_received_code", "payment_format_code"])


@query("tb_calendar", f"WITH {o.EVENTS} SELECT tx_id, hour(ts) AS hour_of_day, (isodow(ts) - 1) AS day_of_week, (hour(ts) < 8 OR hour(ts) >= 18)::INTEGER AS is_off_hours FROM ev")
def _(s, d):
    return feats.tabular(txn_events(s, d), columns=["hour_of_day", "day_of_week", "is_off_hours"])


@query("tb_flags", f"WITH {o.SALES} SELECT tx_id, (src_node = dst_node)::INTEGER AS is_self_loop, (currency_paid <> currency_received)::INTEGER AS is_cross_currency, (src_bank <> dst_bank)::INTEGER AS is_cross_bank FROM sa")
def _(s, d):
    return feats.tabular(txn_sales(s, d), columns=["is_self_loop", "is_cross_currency", "is_cross_bank"])


@query("tb_round_numbers", f"WITH {o.SALES} SELECT tx_id, (cents % 10000 = 0)::INTEGER AS is_round_100, (cents % 100000 = 0)::INTEGER AS is_round_1000, CASE WHEN floor(abs(paid)) = 0 THEN 0 ELSE least(6, length(floor(abs(paid))::BIGINT::VARCHAR) - length(rtrim(floor(abs(paid))::BIGINT::VARCHAR, '0'))) END AS trailing_zero_count FROM sa")
def _(s, d):
    return feats.tabular(txn_sales(s, d), columns=["is_round_100", "is_round_1000", "trailing_zero_count"])


@query("tb_threshold", f"WITH {o.SALES} SELECT tx_id, round(sign(paid - 10000) * ln(1 + abs(paid - 10000)), 6) AS threshold_distance, (paid >= 9000 AND paid < 10000)::INTEGER AS below_threshold_band FROM sa")
def _(s, d):
    return rounded(feats.tabular(txn_sales(s, d), columns=["threshold_distance", "below_threshold_band"]), "threshold_distance")


# Account state ----------------------------------------------------------------------------------------------------------


def _state(name: str, columns: list[str], sql: str, round_to: tuple[str, ...] = (), sales: bool = True) -> None:
    source, currency, amount = ("sa", "currency_paid", "paid") if sales else ("ev", "'USD'", "amount")
    base = o.SALES if sales else o.EVENTS
    view = txn_sales if sales else txn_events

    @query(name, f"WITH {base}, {o.state(source, currency, sql, amount)} SELECT tx_id, {o.ends(columns)} FROM s GROUP BY tx_id")
    def _(s, d):
        df = feats.account_state(view(s, d)).select("tx_id", *(f"{e}_{c}" for c in columns for e in feats.ENDS))
        return rounded(df, *(f"{e}_{c}" for c in round_to for e in feats.ENDS))


N_IN, N_OUT = "count(*) FILTER (dir = 'in') OVER b", "count(*) FILTER (dir = 'out') OVER b"
V_IN, V_OUT = "coalesce(sum(cents) FILTER (dir = 'in') OVER b, 0)::BIGINT / 100", "coalesce(sum(cents) FILTER (dir = 'out') OVER b, 0)::BIGINT / 100"
_state("st1_4_counts_volumes", ["tx_count_in", "tx_count_out", "volume_in", "volume_out"], f"{N_IN} AS tx_count_in, {N_OUT} AS tx_count_out, {V_IN} AS volume_in, {V_OUT} AS volume_out", ("volume_in", "volume_out"))
_state("st5_ratio", ["inout_volume_ratio"], f"round(CASE WHEN {V_OUT} > 0 THEN ({V_IN}) / ({V_OUT}) END, 6) AS inout_volume_ratio", ("inout_volume_ratio",))
_state("st6_7_recency", ["secs_since_last_in", "secs_since_last_out"], "secs - max(secs) FILTER (dir = 'in') OVER b AS secs_since_last_in, secs - max(secs) FILTER (dir = 'out') OVER b AS secs_since_last_out", sales=False)
_state("st8_turnover", ["turnover_latency"], "last_value(gap IGNORE NULLS) OVER b AS turnover_latency", sales=False)
_state("st9_10_counterparties", ["distinct_counterparties_in", "distinct_counterparties_out"], "least(512, count(DISTINCT CASE WHEN dir = 'in' THEN other END) OVER b) AS distinct_counterparties_in, least(512, count(DISTINCT CASE WHEN dir = 'out' THEN other END) OVER b) AS distinct_counterparties_out", sales=False)
_state("st11_12_alphabets", ["unique_currencies_seen", "unique_formats_seen"], "count(DISTINCT cur) OVER b AS unique_currencies_seen, count(DISTINCT fmt) OVER b AS unique_formats_seen")
_state("st13_14_means", ["mean_amount_in", "mean_amount_out"], f"round(({V_IN}) / nullif({N_IN}, 0), 6) AS mean_amount_in, round(({V_OUT}) / nullif({N_OUT}, 0), 6) AS mean_amount_out", ("mean_amount_in", "mean_amount_out"))
_state("st15_zscore", ["amount_zscore_vs_own_history"], """round(CASE WHEN count(*) OVER b < 2 THEN NULL WHEN sum(amount * amount) OVER b / count(*) OVER b - power(sum(cents) OVER b / 100 / count(*) OVER b, 2) <= 1e-12 THEN 0.0
  ELSE (amount - sum(cents) OVER b / 100 / count(*) OVER b) / sqrt(greatest(sum(amount * amount) OVER b / count(*) OVER b - power(sum(cents) OVER b / 100 / count(*) OVER b, 2), 1e-12)) END, 4) AS amount_zscore_vs_own_history""", sales=False)  # fmt: skip
_state("st16_age", ["account_age_secs"], "coalesce(secs - min(secs) OVER b, 0) AS account_age_secs")


_plain_zscore = QUERIES["st15_zscore"]
QUERIES["st15_zscore"] = lambda s, d: _plain_zscore(s, d).withColumns({f"{e}_amount_zscore_vs_own_history": F.round(f"{e}_amount_zscore_vs_own_history", 4) for e in feats.ENDS})


# Splits and sampling ----------------------------------------------------------------------------------------------------

SPLIT = """sp AS (SELECT ev.tx_id, ev.day_idx, ev.label, attempt_id, CASE WHEN day_idx <= 5 THEN 'train' WHEN day_idx = 6 THEN 'val' ELSE 'test' END AS split FROM ev LEFT JOIN ty USING (tx_id)),
  pu AS (SELECT * FROM sp WHERE NOT (split = 'train' AND attempt_id IS NOT NULL AND attempt_id IN (SELECT attempt_id FROM sp WHERE split <> 'train' AND attempt_id IS NOT NULL)))"""


def split_tx(s, d, purged: bool = True) -> DataFrame:
    tx = txn_events(s, d)
    out = splits.assign(tx)
    return splits.purge(out, event_typology(tx)) if purged else out


@query("sp1_split_report", f"WITH {o.EVENTS}, {o.TYPOLOGY}, {SPLIT} SELECT split, a.n AS n_rows_before, a.p AS n_positive_before, b.n AS n_rows_after, b.p AS n_positive_after FROM (SELECT split, count(*) AS n, sum(label)::BIGINT AS p FROM sp GROUP BY split) a JOIN (SELECT split, count(*) AS n, sum(label)::BIGINT AS p FROM pu GROUP BY split) b USING (split)")
def _(s, d):
    return splits.report(split_tx(s, d, False), split_tx(s, d))


@query("jn11_purge", f"WITH {o.EVENTS}, {o.TYPOLOGY}, {SPLIT} SELECT tx_id, split FROM pu")
def _(s, d):
    return split_tx(s, d).select("tx_id", "split")


@query("sp3_straddle", f"WITH {o.EVENTS}, {o.TYPOLOGY}, {SPLIT} SELECT attempt_id FROM sp WHERE split = 'train' AND attempt_id IS NOT NULL INTERSECT SELECT attempt_id FROM sp WHERE split <> 'train'")
def _(s, d):
    return splits.straddling(split_tx(s, d, False), event_typology(txn_events(s, d)))


@query("sp4_subsample", f"WITH {o.EVENTS}, {o.TYPOLOGY}, {SPLIT}, tr AS (SELECT * FROM pu WHERE split = 'train') SELECT tx_id, label FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5('42:' || tx_id), tx_id) AS k, (SELECT sum(label) FROM tr) AS p FROM tr) WHERE label = 1 OR k <= 3 * p")
def _(s, d):
    return splits.subsample_negatives(split_tx(s, d).where("split = 'train'"), 3).select("tx_id", "label")


@query("sp5_pos_weight", f"WITH {o.EVENTS}, {o.TYPOLOGY}, {SPLIT} SELECT round((count(*) - sum(label)) / sum(label), 6) AS weight FROM pu WHERE split = 'train'")
def _(s, d):
    return rounded(splits.positive_weight(split_tx(s, d).where("split = 'train'")), "weight")


@query("sp6_stratified", f"WITH {o.EVENTS} SELECT tx_id, label FROM (SELECT tx_id, label, row_number() OVER (PARTITION BY label ORDER BY md5('42:' || tx_id), tx_id) AS k, (SELECT sum(label) FROM ev) AS p FROM ev) WHERE label = 1 OR k <= greatest(1000 - p, 0)")
def _(s, d):
    return splits.stratified_sample(txn_events(s, d), 1000).select("tx_id", "label")


@query("sp7_blocks", f"WITH {o.EVENTS} SELECT (day_idx // 2)::INTEGER AS block, count(*) AS n, sum(label)::BIGINT AS positives FROM ev GROUP BY 1")
def _(s, d):
    return splits.blocks(txn_events(s, d)).groupBy("block").agg(F.count("*").alias("n"), F.sum("label").alias("positives"))


# Evaluation -------------------------------------------------------------------------------------------------------------

TEST = f"{o.EVENTS}, {o.SCORES}, te AS (SELECT * FROM sc WHERE split = 'test'), {o.CURVE.format(rows='te')}"
VAL = f"{o.EVENTS}, {o.SCORES}, va AS (SELECT * FROM sc WHERE split = 'val'), {o.CURVE.format(rows='va')}"
AP_SQL = "sum(pos * tp / (tp + fp)) / max(np)"
AUC_SQL = "sum(neg * (tp - pos) + neg * pos / 2) / max(np * (n - np))"


@query("ev1_average_precision", f"WITH {TEST} SELECT round({AP_SQL}, 6) AS average_precision FROM cv")
def _(s, d):
    return rounded(ev.average_precision(test_scores(s, d)), "average_precision")


@query("ev2_roc_auc", f"WITH {TEST} SELECT round({AUC_SQL}, 6) AS roc_auc FROM cv")
def _(s, d):
    return rounded(ev.roc_auc(test_scores(s, d)), "roc_auc")


@query("ev3_threshold", f"WITH {VAL} SELECT coalesce(max(score) FILTER (tp / np >= 0.9), min(score)) AS threshold FROM cv")
def _(s, d):
    return ev.threshold_at_recall(test_scores(s, d, "val"), 0.9)


@query("ev4_alerts_per_day", f"WITH {VAL}, th AS (SELECT coalesce(max(score) FILTER (tp / np >= 0.9), min(score)) AS t FROM cv) SELECT round(count(*) FILTER (score >= t) / 3, 6) AS alerts_per_day FROM sc, th WHERE split = 'test'")
def _(s, d):
    return rounded(ev.alerts_per_day(test_scores(s, d), ev.threshold_at_recall(test_scores(s, d, "val"), 0.9), 3), "alerts_per_day")


@query(
    "ev6_split_metrics",
    f"""WITH {TEST}, v AS (SELECT * FROM sc WHERE split = 'val'), c2 AS (SELECT score, sum(sum(label)) OVER (ORDER BY score DESC) / sum(sum(label)) OVER () AS r FROM v GROUP BY score),
  th AS (SELECT coalesce(max(score) FILTER (r >= 0.9), min(score)) AS t FROM c2), f AS (SELECT count(*) AS n, sum(label)::BIGINT AS p, max(t) AS t, count(*) FILTER (score >= t) AS k, count(*) FILTER (score >= t AND label = 1) AS c FROM te, th)
  SELECT n AS n_rows, p AS n_positives, round(p / n, 6) AS prevalence, t AS threshold, k AS n_flagged, c AS n_detected, round(c / p, 6) AS recall, round(c / k, 6) AS precision, round(k / 3, 6) AS alerts_per_day, round((k - c) / 3, 6) AS false_alerts_per_day,
    (SELECT round({AP_SQL}, 6) FROM cv) AS average_precision, (SELECT round({AUC_SQL}, 6) FROM cv) AS roc_auc FROM f""",
)
def _(s, d):
    found = ev.evaluate_split(test_scores(s, d), ev.threshold_at_recall(test_scores(s, d, "val"), 0.9), 3)
    return rounded(found, "prevalence", "recall", "precision", "alerts_per_day", "false_alerts_per_day", "average_precision", "roc_auc")


@query("ev7_pr_curve", f"WITH {TEST} SELECT score, round(tp / np, 6) AS recall, round(tp / (tp + fp), 6) AS precision FROM cv WHERE (place - 1) % ceil(steps / 100)::BIGINT = 0 OR place = steps")
def _(s, d):
    return rounded(ev.pr_curve(test_scores(s, d), 100), "recall", "precision")


@query("win7_budget_curve", f"WITH {TEST} SELECT score, round((tp + fp) / 3, 6) AS alerts_per_day, round(tp / np, 6) AS recall FROM cv WHERE (place - 1) % greatest(1, steps // 300) = 0")
def _(s, d):
    return rounded(ev.budget_curve(test_scores(s, d), 3, 300), "alerts_per_day", "recall")


@query("top2_kth_score", f"WITH {o.EVENTS}, {o.SCORES} SELECT min(score) AS threshold FROM (SELECT score FROM sc WHERE split = 'test' ORDER BY score DESC LIMIT 100)")
def _(s, d):
    return ev.kth_score(test_scores(s, d), 100)


LO, HI = o.wilson("n_detected", "n_positives")


@query("agg13_typology_recall", f"WITH {ARMS_SQL} SELECT typology, n_positives, n_detected, n_attempts, round(n_detected / n_positives, 6) AS recall, round({LO}, 6) AS recall_lo, round({HI}, 6) AS recall_hi FROM re WHERE arm = 'E1'")
def _(s, d):
    scored = test_scores(s, d)
    return rounded(ev.typology_recall(scored, event_typology(txn_events(s, d)), ev.kth_score(scored, 100)), "recall", "recall_lo", "recall_hi")


def comparison(s, d) -> DataFrame:
    return ev.compare_at_budget(arms(s, d), event_typology(txn_events(s, d)), 100)


@query("ev9_budget_recall", f"WITH {ARMS_SQL} SELECT arm, typology, n_positives, n_detected, n_attempts, round(n_detected / n_positives, 6) AS recall FROM re")
def _(s, d):
    return rounded(comparison(s, d).drop("recall_lo", "recall_hi"), "recall")


@query("ev8_compare_arms", f"WITH {ARMS_SQL} SELECT ar.arm, coalesce(typology, 'UNANNOTATED') AS typology, count(*) AS n_positives, count(*) FILTER (score >= CASE ar.arm WHEN 'E1' THEN 0.9 ELSE 0.8 END) AS n_detected, count(DISTINCT attempt_id) AS n_attempts FROM ar LEFT JOIN ty USING (tx_id) WHERE label = 1 GROUP BY ALL")
def _(s, d):
    own = {"E1": 0.9, "E2": 0.8}
    limits = {a: s.range(1).select(F.lit(t).alias("threshold")) for a, t in own.items()}
    return ev.compare_arms({a: (x, limits[a]) for a, x in arms(s, d).items()}, event_typology(txn_events(s, d))).drop("recall", "recall_lo", "recall_hi")


POOL = "coalesce(sum({c}) FILTER (arm = '{a}' AND typology {t}), 0)::BIGINT AS {n}"
STRUCT = "IN ('CYCLE','FAN-OUT','FAN-IN','SCATTER-GATHER','GATHER-SCATTER','BIPARTITE')"
SLO, SHI = o.wilson("struct_graph", "struct_n")
RLO, RHI = o.wilson("rand_graph", "rand_n")


@query(
    "ev10_asymmetry",
    f"""WITH {ARMS_SQL}, pl AS (SELECT {POOL.format(c='n_detected', a='E1', t=STRUCT, n='struct_base')}, {POOL.format(c='n_detected', a='E2', t=STRUCT, n='struct_graph')}, {POOL.format(c='n_positives', a='E2', t=STRUCT, n='struct_n')},
    {POOL.format(c='n_detected', a='E1', t="= 'RANDOM'", n='rand_base')}, {POOL.format(c='n_detected', a='E2', t="= 'RANDOM'", n='rand_graph')}, {POOL.format(c='n_positives', a='E2', t="= 'RANDOM'", n='rand_n')} FROM re),
  q AS (SELECT *, (struct_graph - struct_base) / nullif(struct_n, 0) AS sd, (rand_graph - rand_base) / nullif(rand_n, 0) AS rd, {SLO} AS slo, {SHI} AS shi, {RLO} AS rlo, {RHI} AS rhi FROM pl)
  SELECT struct_base, struct_graph, struct_n, rand_base, rand_graph, rand_n, round(sd, 6) AS struct_delta, round(rd, 6) AS rand_delta,
    CASE WHEN NOT coalesce(slo > rhi OR rlo > shi, false) THEN 'inconclusive' WHEN sd > rd THEN 'supports mechanism' ELSE 'leak alarm' END AS verdict FROM q""",
)
def _(s, d):
    return rounded(ev.asymmetry(comparison(s, d), "E1", "E2").drop("struct_lo", "struct_hi", "rand_lo", "rand_hi"), "struct_delta", "rand_delta")


@query("rsh2_pivot", f"WITH {ARMS_SQL}, w AS (SELECT typology, max(n_detected / n_positives) FILTER (arm = 'E1') AS E1, max(n_detected / n_positives) FILTER (arm = 'E2') AS E2 FROM re GROUP BY typology) SELECT typology, round(E1, 6) AS E1, round(E2, 6) AS E2, round(E2 - E1, 6) AS delta FROM w")
def _(s, d):
    return rounded(ev.family_delta(comparison(s, d), "E1", "E2"), "E1", "E2", "delta")


WLO, WHI = o.wilson("k", "n")


@query("ev16_wilson", f"WITH {o.EVENTS}, w AS (SELECT src_node, sum(label)::BIGINT AS k, count(*) AS n FROM ev GROUP BY src_node) SELECT src_node, round({WLO}, 6) AS lo, round({WHI}, 6) AS hi FROM w")
def _(s, d):
    w = txn_events(s, d).groupBy("src_node").agg(F.sum("label").alias("k"), F.count("*").alias("n"))
    lo, hi = wilson(F.col("k"), F.col("n"))
    return rounded(w.select("src_node", lo.alias("lo"), hi.alias("hi")), "lo", "hi")


@query(
    "ev13_alert_table",
    f"""WITH {o.EVENTS}, {o.TYPOLOGY}, {o.SCORES}, te AS (SELECT * FROM sc WHERE split = 'test'), tp AS (SELECT tx_id FROM te ORDER BY score DESC, tx_id LIMIT 50),
  rs AS (SELECT tx_id FROM te WHERE tx_id NOT IN (SELECT tx_id FROM tp) ORDER BY md5('42:' || tx_id), tx_id LIMIT 20), ch AS (SELECT te.* FROM te JOIN (SELECT * FROM tp UNION ALL SELECT * FROM rs) USING (tx_id))
  SELECT ch.tx_id, ch.score, ch.label, ev.secs, ev.src_node, ev.dst_node, ev.amount AS amount_paid, ev.fmt AS payment_format, typology, (ch.score >= 0.9)::INTEGER AS is_alert, row_number() OVER (ORDER BY ch.score DESC, ch.tx_id) AS rank FROM ch JOIN ev USING (tx_id) LEFT JOIN ty USING (tx_id)""",
)
def _(s, d):
    tx = txn_events(s, d)
    limit = s.range(1).select(F.lit(0.9).alias("threshold"))
    return ev.alert_table(test_scores(s, d), tx, event_typology(tx), limit, 50, 20)


@query("ev15_headline", f"WITH {ARMS_SQL}, h AS (SELECT arm, count(*) FILTER (score >= t) AS alerts FROM ar JOIN th USING (arm) GROUP BY arm) SELECT round(1 - max(alerts) FILTER (arm = 'E2') / max(alerts) FILTER (arm = 'E1'), 6) AS reduction FROM h")
def _(s, d):
    a = arms(s, d)
    counts = [x.join(F.broadcast(ev.kth_score(x, 100))).agg(F.count_if(F.col("score") >= F.col("threshold")).alias(f"n_{k}")) for k, x in a.items()]
    return rounded(counts[0].join(counts[1]).select((1 - F.col("n_E2") / F.col("n_E1")).alias("reduction")), "reduction")


@query(
    "win9_walk_forward_verdict",
    f"""WITH {o.EVENTS}, {o.SCORES}, bl AS (SELECT day_idx // 2 AS block, 'retrained' AS arm, score, label FROM sc UNION ALL SELECT day_idx // 2, 'frozen', ((tx_id * 104729 + src_node * 7919 + label * 300) % 1000) / 1000.0::DOUBLE, label FROM sc),
  cu AS (SELECT block, arm, score, sum(label)::BIGINT AS pos, count(*) AS n FROM bl GROUP BY ALL),
  cv AS (SELECT *, sum(pos) OVER w AS tp, sum(n) OVER w AS flagged, sum(pos) OVER (PARTITION BY block, arm) AS np FROM cu WINDOW w AS (PARTITION BY block, arm ORDER BY score DESC)),
  ap AS (SELECT block, arm, sum(pos * tp / flagged) / max(np) AS ap FROM cv GROUP BY block, arm),
  wd AS (SELECT r.block, r.ap AS r, f.ap AS f FROM ap r JOIN ap f USING (block) WHERE r.arm = 'retrained' AND f.arm = 'frozen'),
  su AS (SELECT avg(r - f) AS gap, count(*) FILTER (r - 0.01 > f + 0.01 OR f - 0.01 > r + 0.01) AS apart, count(*) AS n, arg_min(f, block) AS first, arg_max(f, block) AS last FROM wd)
  SELECT round(gap, 6) AS mean_gap, apart AS blocks_with_separation, n AS n_blocks, round(first, 6) AS frozen_first, round(last, 6) AS frozen_last, last + 0.01 < first - 0.01 AS frozen_declined,
    CASE WHEN apart = 0 THEN 'no separation' WHEN last + 0.01 < first - 0.01 THEN 'decay' ELSE 'not decay' END AS verdict FROM su""",
)
def _(s, d):
    scored = splits.blocks(event_scores(txn_events(s, d)))
    other = ((F.col("tx_id") * 104729 + F.col("src_node") * 7919 + F.col("label") * 300) % 1000) / 1000
    both = scored.select("block", F.lit("retrained").alias("arm"), "score", "label").unionAll(scored.select("block", F.lit("frozen"), other, "label"))
    each = ev.average_precision(both, ["block", "arm"]).withColumnRenamed("average_precision", "auprc")
    found = ev.walk_forward_verdict(each.withColumn("auprc_lo", F.col("auprc") - 0.01).withColumn("auprc_hi", F.col("auprc") + 0.01))
    return rounded(found, "mean_gap", "frozen_first", "frozen_last")


# Presentation and exploration -------------------------------------------------------------------------------------------


@query("rsh1_unpivot", f"WITH {o.GRAPH}, {o.STATS} SELECT day_idx, node, feature, value FROM (SELECT day_idx, node, out_degree, in_degree, out_tx, in_tx FROM st) UNPIVOT (value FOR feature IN (out_degree, in_degree, out_tx, in_tx))")
def _(s, d):
    return graph.node_stats(edges(s, d)).unpivot(["day_idx", "node"], ["out_degree", "in_degree", "out_tx", "in_tx"], "feature", "value")


@query("agg15_shares", f"WITH {o.GRAPH}, {o.STATS}, l AS (SELECT feature, avg(abs(value)) AS m FROM (SELECT day_idx, node, out_degree, in_degree, out_tx, in_tx FROM st) UNPIVOT (value FOR feature IN (out_degree, in_degree, out_tx, in_tx)) GROUP BY feature) SELECT feature, round(m, 6) AS mean_abs, round(m / sum(m) OVER (), 6) AS share, round(sum(m) OVER (PARTITION BY substr(feature, -2)) / sum(m) OVER (), 6) AS block_share FROM l")
def _(s, d):
    long = graph.node_stats(edges(s, d)).unpivot(["day_idx", "node"], ["out_degree", "in_degree", "out_tx", "in_tx"], "feature", "value")
    groups = s.createDataFrame([("out_degree", "ee"), ("in_degree", "ee"), ("out_tx", "tx"), ("in_tx", "tx")], "feature string, block string")
    return rounded(ev.shares(long, groups).drop("block"), "mean_abs", "share", "block_share")


@query("agg17_null_rates", f"WITH {o.GRAPH}, {o.STATS}, j AS (SELECT a.out_degree AS src, b.out_degree AS dst FROM ev LEFT JOIN st a ON a.day_idx = ev.day_idx - 1 AND a.node = ev.src_node LEFT JOIN st b ON b.day_idx = ev.day_idx - 1 AND b.node = ev.dst_node) SELECT 'src_out_degree' AS \"column\", round(1 - count(src) / count(*), 6) AS null_rate, 0 AS n_infinite FROM j UNION ALL SELECT 'dst_out_degree', round(1 - count(dst) / count(*), 6), 0 FROM j")
def _(s, d):
    return rounded(asm.null_rates(lagged_degree(s, d), ["src_out_degree", "dst_out_degree"]), "null_rate")


@query("agg20_daily", f"WITH {o.EVENTS}, x AS (SELECT day_idx, count(*) AS n, sum(label)::BIGINT AS illicit FROM ev GROUP BY day_idx) SELECT day_idx, n, illicit, round(illicit / n, 6) AS rate, round(100 * sum(n) OVER (ORDER BY day_idx) / sum(n) OVER (), 6) AS cumulative_pct FROM x")
def _(s, d):
    x = txn_events(s, d).groupBy("day_idx").agg(F.count("*").alias("n"), F.sum("label").alias("illicit"))
    run = F.sum("n").over(W.orderBy("day_idx"))
    return rounded(x.withColumn("rate", F.col("illicit") / F.col("n")).withColumn("cumulative_pct", 100 * run / F.sum("n").over(W.partitionBy())), "rate", "cumulative_pct")


@query("agg21_attempt_span", f"WITH {o.EVENTS}, {o.TYPOLOGY} SELECT attempt_id, min(day_idx) AS first_day, max(day_idx) AS last_day, count(*) AS n, arg_min(typology, tx_id) AS typology FROM ty JOIN ev USING (tx_id) GROUP BY attempt_id")
def _(s, d):
    tx = txn_events(s, d)
    joined = event_typology(tx).join(tx.select("tx_id", "day_idx"), "tx_id")
    return joined.groupBy("attempt_id").agg(F.min("day_idx").alias("first_day"), F.max("day_idx").alias("last_day"), F.count("*").alias("n"), F.min_by("typology", "tx_id").alias("typology"))


@query("agg22_rate_by", f"WITH {o.EVENTS} SELECT fmt AS payment_format, count(*) AS n, sum(label)::BIGINT AS illicit, round(sum(label) / count(*), 6) AS rate, round(sum(label) / count(*) / (SELECT sum(label) / count(*) FROM ev), 6) AS lift FROM ev GROUP BY fmt")
def _(s, d):
    tx = txn_events(s, d)
    base = tx.agg((F.sum("label") / F.count("*")).alias("base"))
    x = tx.groupBy("payment_format").agg(F.count("*").alias("n"), F.sum("label").alias("illicit")).withColumn("rate", F.col("illicit") / F.col("n"))
    return rounded(x.join(F.broadcast(base)).withColumn("lift", F.col("rate") / F.when(F.col("base") > 0, F.col("base"))).drop("base"), "rate", "lift")


@query("agg23_degree_percentiles", f"WITH {o.GRAPH}, {o.STATS} SELECT day_idx, round(avg(out_degree), 6) AS mean, max(out_degree) AS max, round(quantile_cont(out_degree, 0.5), 6) AS p50, round(quantile_cont(out_degree, 0.9), 6) AS p90, round(quantile_cont(out_degree, 0.99), 6) AS p99, round(quantile_cont(out_degree, 0.999), 6) AS p999 FROM st GROUP BY day_idx")
def _(s, d):
    x = graph.node_stats(edges(s, d)).groupBy("day_idx").agg(F.avg("out_degree").alias("mean"), F.max("out_degree").alias("max"), *(F.percentile("out_degree", p).alias(name) for name, p in (("p50", 0.5), ("p90", 0.9), ("p99", 0.99), ("p999", 0.999))))
    return rounded(x, "mean", "p50", "p90", "p99", "p999")


@query("agg24_histogram", f"WITH {o.EVENTS} SELECT floor(log10(amount) * 10)::BIGINT AS bin, label, count(*) AS n FROM ev WHERE amount > 0 GROUP BY ALL")
def _(s, d):
    return txn_events(s, d).where("amount_paid > 0").groupBy(F.floor(F.log10("amount_paid") * 10).alias("bin"), "label").agg(F.count("*").alias("n"))


@query("agg24_ccdf", f"WITH {o.GRAPH}, {o.STATS}, x AS (SELECT out_degree AS k, count(*) AS n FROM st WHERE day_idx = 9 GROUP BY 1) SELECT k, n, round(1 - coalesce(sum(n) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / sum(n) OVER (), 6) AS ccdf FROM x")
def _(s, d):
    x = graph.node_stats(edges(s, d)).where("day_idx = 9").groupBy(F.col("out_degree").alias("k")).agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(W.orderBy("k").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return rounded(x.withColumn("ccdf", 1 - before / F.sum("n").over(W.partitionBy())), "ccdf")


@query("agg25_split_typology", f"WITH {o.EVENTS}, {o.TYPOLOGY}, {SPLIT} SELECT split, typology, count(*) AS n, count(DISTINCT sp.attempt_id) AS n_attempts FROM sp JOIN ty USING (tx_id) GROUP BY ALL")
def _(s, d):
    tx = txn_events(s, d)
    return splits.assign(tx).join(event_typology(tx), "tx_id").groupBy("split", "typology").agg(F.count("*").alias("n"), F.countDistinct("attempt_id").alias("n_attempts"))


@query("prj14_alert_filter", f"WITH {o.EVENTS}, {o.SCORES} SELECT tx_id, score FROM sc WHERE split = 'test' AND score >= 0.9 AND label = 1")
def _(s, d):
    return test_scores(s, d).where("score >= 0.9 AND label = 1").select("tx_id", "score")


@query("top6_top_features", f"WITH {o.GRAPH}, {o.STATS} SELECT feature, value FROM (SELECT day_idx, node, out_degree, in_degree, out_tx, in_tx FROM st WHERE day_idx = 9 AND node = 1) UNPIVOT (value FOR feature IN (out_degree, in_degree, out_tx, in_tx)) ORDER BY abs(value) DESC, feature LIMIT 3")
def _(s, d):
    one = graph.node_stats(edges(s, d)).where("day_idx = 9 AND node = 1")
    return one.unpivot(["day_idx"], ["out_degree", "in_degree", "out_tx", "in_tx"], "feature", "value").orderBy(F.desc(F.abs("value")), "feature").limit(3).select("feature", "value")


@query("set2_family_names", f"SELECT k, ({o.FAMILIES})[k + 1] AS typology FROM (SELECT unnest(range(0, 8)) AS k)")
def _(s, d):
    return s.range(8).select(F.col("id").alias("k"), family(F.col("id")).alias("typology"))


@query("win_tumbling_days", f"WITH {o.EVENTS} SELECT epoch(date_trunc('day', ts) + INTERVAL 1 DAY)::BIGINT AS window_end, src_node AS src, dst_node AS dst, count(*) AS tx_count, sum(cents)::BIGINT / 100 AS w_amount FROM ev WHERE NOT self GROUP BY ALL")
def _(s, d):
    rows = snap.graph_rows(txn_events(s, d))
    g = rows.groupBy(F.window("ts", "1 day").alias("w"), F.col("src_node").alias("src"), F.col("dst_node").alias("dst"))
    return g.agg(F.count("*").alias("tx_count"), (F.sum(cents(F.col("amount_paid"))) / 100).alias("w_amount")).select(F.unix_timestamp(F.col("w.end").cast("timestamp_ntz")).alias("window_end"), "src", "dst", "tx_count", "w_amount")


# Assembly and models (rows only) ----------------------------------------------------------------------------------------


def small_config(**more) -> Config:
    return Config({"models": {"random_forest": {"n_estimators": 20}, "gbt": {"n_estimators": 20, "learning_rate": 0.1}, "logistic_regression": {"max_iter": 100}}, "evaluate": {"bootstrap_iterations": 50}, **more})


def matrix(s, d, groups: list[str]) -> tuple[DataFrame, list[str]]:
    config = small_config(features={"enabled_groups": groups})
    out, declared = asm.assemble(txn_events(s, d), config, node_space(txn_events(s, d)), unit=UNIT)
    return out, [x["column"] for x in declared]


@query("as1_feature_matrix")  # as1_matrix_fixed has SQL; this one has Louvain's communities and PageRank until it converges
def feature_matrix(s, d):
    return matrix(s, d, ["tabular", "streaming", "structural", "motif"])[0]


PLAIN_ZSCORE = """CASE WHEN count(*) OVER b < 2 THEN NULL WHEN sum(amount * amount) OVER b / count(*) OVER b - power(sum(cents) OVER b / 100 / count(*) OVER b, 2) <= 1e-12 THEN 0.0
  ELSE (amount - sum(cents) OVER b / 100 / count(*) OVER b) / sqrt(greatest(sum(amount * amount) OVER b / count(*) OVER b - power(sum(cents) OVER b / 100 / count(*) OVER b, 2), 1e-12)) END"""
STATE_SQL = {
    "tx_count_in": N_IN, "tx_count_out": N_OUT, "volume_in": V_IN, "volume_out": V_OUT, "inout_volume_ratio": f"CASE WHEN {V_OUT} > 0 THEN ({V_IN}) / ({V_OUT}) END",
    "secs_since_last_in": "secs - max(secs) FILTER (dir = 'in') OVER b", "secs_since_last_out": "secs - max(secs) FILTER (dir = 'out') OVER b", "turnover_latency": "last_value(gap IGNORE NULLS) OVER b",
    "distinct_counterparties_in": "least(512, count(DISTINCT CASE WHEN dir = 'in' THEN other END) OVER b)", "distinct_counterparties_out": "least(512, count(DISTINCT CASE WHEN dir = 'out' THEN other END) OVER b)",
    "unique_currencies_seen": "count(DISTINCT cur) OVER b", "unique_formats_seen": "count(DISTINCT fmt) OVER b", "mean_amount_in": f"({V_IN}) / nullif({N_IN}, 0)", "mean_amount_out": f"({V_OUT}) / nullif({N_OUT}, 0)",
    "amount_zscore_vs_own_history": PLAIN_ZSCORE, "account_age_secs": "coalesce(secs - min(secs) OVER b, 0)",
}
ROW_SQL = {
    "log_amount_paid": "ln(1 + amount)", "log_amount_received": "ln(1 + amount)", "amount_mismatch_ratio": "CASE WHEN amount > 0 THEN 1.0 END", "currency_paid_code": "0", "currency_received_code": "0",
    "payment_format_code": "dense_rank() OVER (ORDER BY fmt) - 1", "is_cross_currency": "0", "is_cross_bank": "0", "is_self_loop": "self::INTEGER", "hour_of_day": "hour(ts)", "day_of_week": "isodow(ts) - 1",
    "is_off_hours": "(hour(ts) < 8 OR hour(ts) >= 18)::INTEGER", "is_round_100": "(cents % 10000 = 0)::INTEGER", "is_round_1000": "(cents % 100000 = 0)::INTEGER",
    "trailing_zero_count": "CASE WHEN floor(abs(amount)) = 0 THEN 0 ELSE least(6, length(floor(abs(amount))::BIGINT::VARCHAR) - length(rtrim(floor(abs(amount))::BIGINT::VARCHAR, '0'))) END",
    "threshold_distance": "sign(amount - 10000) * ln(1 + abs(amount - 10000))", "below_threshold_band": "(amount >= 9000 AND amount < 10000)::INTEGER",
}
E3_SQL = f"""{o.state("ev", "'USD'", ", ".join(f"{x} AS {c}" for c, x in STATE_SQL.items()))},
  ac AS (SELECT tx_id, {o.ends(list(STATE_SQL))} FROM s GROUP BY tx_id), ro AS (SELECT tx_id, {", ".join(f"{x} AS {c}" for c, x in ROW_SQL.items())} FROM ev)"""
FIXED_ROUNDS = 10
GRAPH_SQL = f"""{o.PAIRS}, {o.pagerank(FIXED_ROUNDS)}, cm AS (SELECT DISTINCT day_idx, node, node % 4 AS community FROM un), sz AS (SELECT day_idx, community, count(*) AS z FROM cm GROUP BY ALL),
  ins AS (SELECT a.day_idx, a.community, count(*) AS k FROM un JOIN cm a ON un.day_idx = a.day_idx AND un.node = a.node JOIN cm b ON un.day_idx = b.day_idx AND un.other = b.node WHERE a.community = b.community AND un.node < un.other GROUP BY ALL),
  dg AS (SELECT day_idx, node, count(*) AS k FROM un GROUP BY ALL),
  eg AS (SELECT un.day_idx, un.node, count(*) AS ego_size, avg(dg.k) AS ego_mean_degree, max(dg.k) AS ego_max_degree, avg(r.rank) AS neighbour_pagerank_mean FROM un JOIN dg ON un.day_idx = dg.day_idx AND un.other = dg.node
    JOIN r{FIXED_ROUNDS} r ON un.day_idx = r.day_idx AND un.other = r.node GROUP BY ALL),
  p2 AS (SELECT a.day_idx, a.src AS i, b.dst AS j, count(*) AS n FROM ed a JOIN ed b ON a.day_idx = b.day_idx AND a.dst = b.src GROUP BY ALL),
  c2 AS (SELECT a.day_idx, a.src AS node, count(*) AS n FROM ed a JOIN ed b ON a.day_idx = b.day_idx AND a.src = b.dst AND a.dst = b.src GROUP BY ALL),
  c3 AS (SELECT p2.day_idx, p2.i AS node, sum(p2.n) AS n FROM p2 JOIN ed ON p2.day_idx = ed.day_idx AND p2.j = ed.src AND p2.i = ed.dst GROUP BY ALL),
  c4 AS (SELECT x.day_idx, x.i AS node, sum(x.n * y.n)::BIGINT AS n FROM p2 x JOIN p2 y ON x.day_idx = y.day_idx AND x.i = y.j AND x.j = y.i GROUP BY ALL),
  nd AS (SELECT st.day_idx, st.node, r.rank AS pagerank, (row_number() OVER (PARTITION BY st.day_idx ORDER BY r.rank, st.node) - 1) / greatest(count(*) OVER (PARTITION BY st.day_idx) - 1, 1)::DOUBLE AS pagerank_rank_pct,
    st.in_degree / greatest(count(*) OVER (PARTITION BY st.day_idx) - 1, 1)::DOUBLE AS in_degree_centrality, st.out_degree / greatest(count(*) OVER (PARTITION BY st.day_idx) - 1, 1)::DOUBLE AS out_degree_centrality,
    z AS community_size, CASE WHEN z < 2 THEN 0 ELSE coalesce(ins.k, 0) / (z * (z - 1) / 2) END AS community_density, ego_size, ego_mean_degree, ego_max_degree, neighbour_pagerank_mean, cm.community,
    coalesce(c2.n, 0) AS cycle_2hop, coalesce(c3.n, 0) AS cycle_3hop, coalesce(c4.n, 0) AS cycle_4hop, CASE WHEN st.day_idx > 0 THEN st.out_degree - coalesce(p.out_degree, 0) END AS fanout_burst,
    CASE WHEN st.day_idx > 0 THEN st.in_degree - coalesce(p.in_degree, 0) END AS fanin_burst, CASE WHEN st.day_idx > 0 THEN (st.out_degree - coalesce(p.out_degree, 0)) * (st.in_degree - coalesce(p.in_degree, 0)) END AS gather_scatter_score,
    CASE WHEN st.in_strength > 0 THEN st.out_strength / st.in_strength END AS amount_conservation
    FROM st JOIN r{FIXED_ROUNDS} r USING (day_idx, node) JOIN cm USING (day_idx, node) JOIN sz ON sz.day_idx = cm.day_idx AND sz.community = cm.community LEFT JOIN ins ON ins.day_idx = cm.day_idx AND ins.community = cm.community
    JOIN eg USING (day_idx, node) LEFT JOIN c2 ON c2.day_idx = st.day_idx AND c2.node = st.node LEFT JOIN c3 ON c3.day_idx = st.day_idx AND c3.node = st.node LEFT JOIN c4 ON c4.day_idx = st.day_idx AND c4.node = st.node
    LEFT JOIN st p ON p.day_idx = st.day_idx - 1 AND p.node = st.node),
  aa AS (SELECT DISTINCT day_idx, src_node AS a, dst_node AS b FROM ev WHERE day_idx > 0),
  cn AS (SELECT aa.day_idx, aa.a, aa.b, count(*) AS n FROM aa JOIN un x ON x.day_idx = aa.day_idx - 1 AND x.node = aa.a JOIN un y ON y.day_idx = x.day_idx AND y.node = aa.b AND y.other = x.other GROUP BY ALL)"""


def _four(columns: list[str]) -> str:
    """Columns of the matrix are single floats."""
    return ", ".join(f"round(({c})::FLOAT::DOUBLE, 4) AS {c.rsplit('.', 1)[-1]}" for c in columns)


_LAGGED = [*feats.STRUCTURE, *feats.MOTIFS]
FIXED_SQL = f"""SELECT ev.tx_id, ev.day_idx, ev.label, ev.src_node, {_four([f"ac.{c}" for c in asm.both_ends(asm.STATE)])}, {_four([f"ro.{c}" for c in feats.ROW_LOCAL])},
  {", ".join(f"round({e[0]}.{c}::FLOAT::DOUBLE, 4) AS {e}_{c}" for c in _LAGGED for e in feats.ENDS)}, (s.community = d.community)::INTEGER::DOUBLE AS same_community, (ev.day_idx = 0)::INTEGER::DOUBLE AS is_cold_start,
  CASE WHEN s.node IS NOT NULL AND d.node IS NOT NULL THEN coalesce(cn.n, 0) END::DOUBLE AS common_neighbours
  FROM ev JOIN ac USING (tx_id) JOIN ro USING (tx_id) LEFT JOIN nd s ON s.day_idx = ev.day_idx - 1 AND s.node = ev.src_node LEFT JOIN nd d ON d.day_idx = ev.day_idx - 1 AND d.node = ev.dst_node
  LEFT JOIN cn ON cn.day_idx = ev.day_idx AND cn.a = ev.src_node AND cn.b = ev.dst_node"""


def in_four(m: DataFrame) -> DataFrame:
    return m.select(*asm.PASSTHROUGH, *(F.round(F.col(c).cast("double"), 4).alias(c) for c in m.columns[len(asm.PASSTHROUGH) :]))


@query("as1_arm_e3", f"WITH {o.EVENTS}, {E3_SQL} SELECT ev.tx_id, ev.day_idx, ev.label, ev.src_node, {_four([f'ac.{c}' for c in asm.both_ends(asm.STATE)])}, {_four([f'ro.{c}' for c in feats.ROW_LOCAL])} FROM ev JOIN ac USING (tx_id) JOIN ro USING (tx_id)")
def _(s, d):
    return in_four(matrix(s, d, ["tabular", "streaming"])[0])


@query("as1_matrix_fixed", f"WITH {o.GRAPH}, {o.STATS}, {E3_SQL}, {GRAPH_SQL} {FIXED_SQL}")
def _(s, d):
    """All 86 columns, with fixed rounds of PageRank and given communities, which SQL can follow."""
    given = lambda job: graph.active_nodes(job.edges).withColumn("community", F.col("node") % 4)
    blocks = asm.BLOCKS.blocks | {"structural": asm.structural_block(FIXED_ROUNDS, given)}
    return in_four(asm.assemble(txn_events(s, d), Config(), node_space(txn_events(s, d)), unit=UNIT, blocks=blocks)[0])


@query("as2_keys_kept", f"WITH {o.EVENTS} SELECT count(*) AS n_rows, count(DISTINCT tx_id) AS n_keys, 0::BIGINT AS n_lost FROM ev")
def _(s, d):
    m, tx = matrix(s, d, ["tabular", "streaming"])[0], txn_events(s, d)
    lost = tx.select("tx_id").exceptAll(m.select("tx_id")).agg(F.count("*").alias("n_lost"))
    return m.agg(F.count("*").alias("n_rows"), F.countDistinct("tx_id").alias("n_keys")).join(F.broadcast(lost))


@query("agg19_manifest_counts", "SELECT * FROM (VALUES ('tabular', 'row', 17::BIGINT, 1::BIGINT), ('streaming', 'state', 32, 14), ('structural', 'snapshot', 21, 21), ('structural', 'row', 1, 0), ('motif', 'snapshot', 15, 15)) t(block, source, n_columns, n_nullable)")
def _(s, d):
    return asm.manifest_counts(asm.manifest_frame(s, asm.BLOCKS.blocks))


@query("top5_null_rates", f"WITH {o.GRAPH}, {o.STATS}, j AS (SELECT a.out_degree AS src_out_degree, b.out_degree AS dst_out_degree, a.in_degree AS src_in_degree, ev.day_idx FROM ev LEFT JOIN st a ON a.day_idx = ev.day_idx - 1 AND a.node = ev.src_node LEFT JOIN st b ON b.day_idx = ev.day_idx - 1 AND b.node = ev.dst_node), r AS (SELECT unnest(['src_out_degree', 'dst_out_degree', 'src_in_degree', 'day_idx']) AS \"column\", unnest([1 - count(src_out_degree) / count(*), 1 - count(dst_out_degree) / count(*), 1 - count(src_in_degree) / count(*), 1 - count(day_idx) / count(*)]) AS null_rate FROM j) SELECT \"column\", round(null_rate, 6) AS null_rate, 0::BIGINT AS n_infinite, place::INTEGER AS place FROM (SELECT *, row_number() OVER (ORDER BY round(null_rate, 9) DESC, \"column\") AS place FROM r) WHERE place <= 3")
def _(s, d):
    rates = asm.null_rates(lagged_degree(s, d), ["src_out_degree", "dst_out_degree", "src_in_degree", "day_idx"])
    return rounded(asm.largest(rates.withColumn("null_rate", F.round("null_rate", 9)), "null_rate", "column", 3), "null_rate")


@query("as4_manifest")
def _(s, d):
    return asm.manifest_frame(s, asm.BLOCKS.blocks)


def split_matrix(s, d) -> tuple[DataFrame, list[str]]:
    from tidegraph.sources.shared import written

    m, columns = matrix(s, d, ["tabular", "streaming"])
    return written(splits.purge(splits.assign(m), event_typology(txn_events(s, d)))), columns


def _model(key: str, name: str) -> None:
    @query(key)
    def _(s, d):
        rows, columns = split_matrix(s, d)
        return models.train_and_score(name, rows, columns, small_config())[2]


for _key, _name in (("ml1_logreg", "logistic_regression"), ("ml2_tree", "decision_tree"), ("ml3_forest", "random_forest"), ("ml4_gbt", "gbt")):
    _model(_key, _name)


@query("ev5_bootstrap")
def _(s, d):
    return ev.bootstrap(test_scores(s, d), 50)


@query("ev11_walkforward")
def _(s, d):
    tx = txn_events(s, d)
    from tidegraph.sources.shared import written

    m, columns = matrix(s, d, ["tabular"])
    results = written(models.walk_forward(written(m), event_typology(tx), columns, small_config()))
    return ev.walk_forward_verdict(results)


@query("ev12_attribution")
def _(s, d):
    rows, columns = split_matrix(s, d)
    config = small_config()
    model = models.fit("random_forest", rows.where("split = 'train'"), columns, config)
    sample = splits.stratified_sample(rows.where("split = 'test'"), 2000)
    groups = s.createDataFrame(asm.block_columns(["tabular", "streaming"]), "feature string, block string")
    return ev.shares(models.attributions(model, sample, columns), groups)


# More facts, agreement, presentation ------------------------------------------------------------------------------------


@query("prj7_weights", f"WITH {o.GRAPH} SELECT day_idx, kind, round(sum(w), 4) AS total, count(*) AS n_edges FROM (SELECT day_idx, 'amount' AS kind, w_amount::DOUBLE AS w FROM ed UNION ALL SELECT day_idx, 'amount_norm', w_norm FROM ed UNION ALL SELECT day_idx, 'tx_count', tx_count FROM ed) GROUP BY ALL")
def _(s, d):
    e = edges(s, d)
    parts = [snap.weights(e, k).groupBy("day_idx").agg(F.round(F.sum("weight"), 4).alias("total"), F.count("*").alias("n_edges")).withColumn("kind", F.lit(k)) for k in snap.WEIGHTS]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("agg7_profile", f"WITH {o.SALES} SELECT 'banks' AS name, count(*) AS value FROM (SELECT src_bank FROM sa UNION SELECT dst_bank FROM sa) UNION ALL SELECT 'days', max(day_idx) + 1 FROM sa UNION ALL SELECT 'format ' || fmt, count(*) FROM sa GROUP BY fmt UNION ALL SELECT 'day ' || day_idx, count(*) FROM sa GROUP BY day_idx")
def _(s, d):
    return ingest.profile(txn_sales(s, d, False))


@query(
    "agg8_link_facts",
    f"""WITH {o.EVENTS}, {o.TYPOLOGY}, {o.PATTERNS}, {ILLICIT}, p AS (SELECT *, row_number() OVER (PARTITION BY {KEY_SQL} ORDER BY pattern_row) AS occ FROM pa), t AS (SELECT *, row_number() OVER (PARTITION BY {KEY_SQL} ORDER BY tx_id) AS occ FROM il WHERE label = 1),
    li AS (SELECT p.pattern_row, t.tx_id FROM p LEFT JOIN t USING ({KEY_SQL}, occ)), i AS (SELECT sum(label)::DOUBLE AS i FROM ev), a AS (SELECT count(tx_id)::DOUBLE AS a FROM li)
    SELECT name, round(value, 6) AS value FROM (
      SELECT 'pattern_rows' AS name, count(*)::DOUBLE AS value FROM pa UNION ALL SELECT 'attempts', count(DISTINCT attempt_id) FROM ty UNION ALL SELECT 'matched', a FROM a UNION ALL SELECT 'unmatched', count(*) FROM li WHERE tx_id IS NULL
      UNION ALL SELECT 'unknown_node_rows', count(*) FROM pa WHERE src_node < 0 OR dst_node < 0
      UNION ALL SELECT 'ambiguous_keys', count(*) FROM (SELECT {KEY_SQL}, count(*) AS n FROM pa GROUP BY ALL) x JOIN (SELECT {KEY_SQL}, count(*) AS m FROM il WHERE label = 1 GROUP BY ALL) y USING ({KEY_SQL}) WHERE m > n
      UNION ALL SELECT 'licit_collisions', count(*) FROM pa WHERE EXISTS (SELECT 1 FROM il WHERE label = 0 AND {" AND ".join(f"il.{k.strip()} = pa.{k.strip()}" for k in KEY_SQL.split(","))})
      UNION ALL SELECT 'illicit', i FROM i UNION ALL SELECT 'annotated', a FROM a UNION ALL SELECT 'unannotated', i - a FROM i, a UNION ALL SELECT 'coverage', a / i FROM i, a
      UNION ALL SELECT 'rows ' || typology, count(*) FROM ty GROUP BY typology UNION ALL SELECT 'attempts ' || typology, count(DISTINCT attempt_id) FROM ty GROUP BY typology)""",
)
def _(s, d):
    p, tx = patterns(s, d), txn_events(s, d)
    return rounded(ingest.coverage(p, tx, ingest.link(p, tx), event_typology(tx)), "value")


@query("agg21_straddling", f"WITH {o.EVENTS}, {o.TYPOLOGY}, sp AS (SELECT attempt_id, min(day_idx) AS a, max(day_idx) AS z FROM ty JOIN ev USING (tx_id) GROUP BY attempt_id) SELECT boundary, count(*) FILTER (a < boundary AND z >= boundary) AS n_straddling, count(*) AS n_attempts FROM sp, (SELECT unnest([6, 7])::INTEGER AS boundary) GROUP BY boundary")
def _(s, d):
    tx = txn_events(s, d)
    return splits.span_counts(tx, event_typology(tx), [6, 7])


@query("agg25_split_facts", f"WITH {o.EVENTS}, {o.TYPOLOGY} SELECT CASE WHEN day_idx <= 5 THEN 'train' WHEN day_idx = 6 THEN 'val' ELSE 'test' END AS split, count(*) AS n, round(count(*) FILTER (self) / count(*), 6) AS self_loop_share, round(count(ty.tx_id) / sum(label), 6) AS coverage FROM ev LEFT JOIN ty USING (tx_id) GROUP BY 1")
def _(s, d):
    tx = splits.assign(txn_events(s, d)).join(event_typology(txn_events(s, d)).select("tx_id", "attempt_id"), "tx_id", "left")
    facts = tx.groupBy("split").agg(F.count("*").alias("n"), (F.count_if("is_self_loop") / F.count("*")).alias("self_loop_share"), (F.count("attempt_id") / F.sum("label")).alias("coverage"))
    return rounded(facts, "self_loop_share", "coverage")


@query("win4_pagerank_pct", f"WITH {o.GRAPH}, {o.pagerank(10)} SELECT day_idx, node, round(rank, 9) AS rank, round((row_number() OVER (PARTITION BY day_idx ORDER BY round(rank, 9), node) - 1) / greatest(count(*) OVER (PARTITION BY day_idx) - 1, 1)::DOUBLE, 6) AS rank_pct FROM r10")
def _(s, d):
    ranks = graph.pagerank(edges(s, d), node_space(txn_events(s, d)), rounds=10).withColumn("rank", F.round("rank", 9))
    return rounded(graph.rank_percent(ranks).select("day_idx", "node", "rank", "rank_pct"), "rank_pct")


@query("gr2_backend_agreement", f"WITH {o.GRAPH} SELECT day_idx, count(*) AS n_nodes, 0.0::DOUBLE AS max_difference, 1.0::DOUBLE AS rank_correlation, least(100, count(*)) AS top_overlap, 1::BIGINT AS hub_place FROM (SELECT day_idx, src FROM ed UNION SELECT day_idx, dst FROM ed) GROUP BY day_idx")
def _(s, d):
    e, n = edges(s, d), node_space(txn_events(s, d))
    return rounded(backends.rank_agreement(*(backends.kernels(k).pagerank(e, n, 20) for k in ("plans", "arrays"))), "max_difference", "rank_correlation")


@query(
    "gr11_pagerank_and_degree",
    f"""WITH {o.GRAPH}, {o.STATS}, {o.pagerank(10)}, x AS (SELECT day_idx, node, round(rank, 9) AS a, row_number() OVER (PARTITION BY day_idx ORDER BY round(rank, 9) DESC, node) AS pa FROM r10),
  y AS (SELECT day_idx, node, in_degree AS b, row_number() OVER (PARTITION BY day_idx ORDER BY in_degree DESC, node) AS pb FROM st)
  SELECT day_idx, count(*) AS n_nodes, round(max(abs(a - b)), 6) AS max_difference, round(corr(pa, pb), 6) AS rank_correlation, count(*) FILTER (pa <= 100 AND pb <= 100) AS top_overlap, max(pb) FILTER (pa = 1) AS hub_place FROM x JOIN y USING (day_idx, node) GROUP BY day_idx""",
)
def _(s, d):
    e = edges(s, d)
    ranks = graph.pagerank(e, node_space(txn_events(s, d)), rounds=10).withColumn("rank", F.round("rank", 9))
    degrees = graph.node_stats(e).select("day_idx", "node", F.col("in_degree").cast("double").alias("rank"))
    return rounded(backends.rank_agreement(ranks, degrees), "max_difference", "rank_correlation")


@query("gr11_partition_agreement", f"WITH {o.GRAPH}, x AS (SELECT DISTINCT node FROM (SELECT src AS node FROM ed UNION SELECT dst FROM ed)), p AS (SELECT a.node AS x, b.node AS y FROM x a JOIN x b ON b.node = a.node + 1) SELECT round(avg(((x % 4 = y % 4) = (x // 2 = y // 2))::INTEGER), 6) AS agreement, count(*) AS n_pairs FROM p")
def _(s, d):
    nodes = graph.active_nodes(edges(s, d)).select("node").distinct()
    pairs = nodes.select(F.col("node").alias("x"), (F.col("node") + 1).alias("y")).join(nodes.select(F.col("node").alias("y")), "y", "left_semi").select("x", "y")
    return rounded(graph.partition_agreement(nodes.withColumn("community", F.col("node") % 4), nodes.withColumn("community", F.expr("node div 2")), pairs), "agreement")


@query("top4_pinned_families", f"WITH {ARMS_SQL} SELECT typology, n_positives, n_detected, row_number() OVER (ORDER BY (typology = 'UNANNOTATED')::INTEGER, n_positives DESC, typology)::INTEGER AS place FROM re WHERE arm = 'E1'")
def _(s, d):
    scored = test_scores(s, d)
    return ev.presented(ev.typology_recall(scored, event_typology(txn_events(s, d)), ev.kth_score(scored, 100))).select("typology", "n_positives", "n_detected", "place")


@query("top5_attributions", f"WITH {o.GRAPH}, {o.STATS}, l AS (SELECT feature, avg(abs(value)) AS m FROM (SELECT day_idx, node, out_degree, in_degree, out_tx, in_tx FROM st) UNPIVOT (value FOR feature IN (out_degree, in_degree, out_tx, in_tx)) GROUP BY feature) SELECT feature, round(m, 6) AS mean_abs, round(m / (SELECT sum(m) FROM l), 6) AS share, place::INTEGER AS place FROM (SELECT *, row_number() OVER (ORDER BY round(m, 9) DESC, feature) AS place FROM l) WHERE place <= 2")
def _(s, d):
    long = graph.node_stats(edges(s, d)).unpivot(["day_idx", "node"], ["out_degree", "in_degree", "out_tx", "in_tx"], "feature", "value")
    groups = s.createDataFrame([("out_degree", "ee"), ("in_degree", "ee"), ("out_tx", "tx"), ("in_tx", "tx")], "feature string, block string")
    found = ev.shares(long, groups).select("feature", F.round("mean_abs", 9).alias("mean_abs"), "share")
    return rounded(asm.largest(found, "mean_abs", "feature", 2), "mean_abs", "share")


@query("jn17_named_alerts", f"SELECT t.*, src_node % 7 AS src_bank, 'A' || src_node AS src_acct, dst_node % 7 AS dst_bank, 'A' || dst_node AS dst_acct FROM ({ORACLES['ev13_alert_table']}) t")
def _(s, d):
    from tidegraph.plans.stages import named

    nodes = s.range(node_space(txn_events(s, d))).select(F.col("id").alias("node_id"), (F.col("id") % 7).alias("bank"), F.concat(F.lit("A"), F.col("id").cast("string")).alias("acct"))
    return named(QUERIES["ev13_alert_table"](s, d), nodes)


@query("fn_bits", f"WITH {o.EVENTS}, c AS (SELECT src_node, dense_rank() OVER (ORDER BY fmt) - 1 AS code FROM ev) SELECT src_node, bit_or(1::BIGINT << code::INTEGER) AS formats, bit_count(bit_or(1::BIGINT << code::INTEGER))::INTEGER AS n_formats FROM c GROUP BY src_node")
def _(s, d):
    masks = feats.coded(txn_events(s, d)).groupBy("src_node").agg(F.bit_or(alphabet_mask(F.col("payment_format_code"))).alias("formats"))
    return masks.withColumn("n_formats", mask_size(F.col("formats")).cast("int"))


# Streams over the events' files, run until they have read all -----------------------------------------------------------

DAILY = "epoch(date_trunc('day', ts))::BIGINT"


def _windows(s, d, days: int) -> DataFrame:
    found = st.run_available(st.stream_windows(event_stream(s, d), days), "complete")
    return found.select(F.unix_timestamp("window_end").alias("window_end"), "src", "dst", "w_amount", "tx_count", "last_ts")


@query("str_tumbling", f"WITH {o.EVENTS} SELECT {DAILY} + 86400 AS window_end, src_node AS src, dst_node AS dst, sum(cents)::BIGINT / 100 AS w_amount, count(*) AS tx_count, max(secs) AS last_ts FROM ev WHERE NOT self GROUP BY ALL")
def _(s, d):
    return _windows(s, d, 1)


@query("str_sliding", f"WITH {o.EVENTS} SELECT {DAILY} + 86400 * k AS window_end, src_node AS src, dst_node AS dst, sum(cents)::BIGINT / 100 AS w_amount, count(*) AS tx_count, max(secs) AS last_ts FROM ev, (SELECT unnest([1, 2, 3]) AS k) WHERE NOT self GROUP BY ALL")
def _(s, d):
    return _windows(s, d, 3)


@query("str_cumulative", f"WITH {o.EVENTS} SELECT src_node AS src, dst_node AS dst, sum(cents)::BIGINT / 100 AS w_amount, count(*) AS tx_count, max(secs) AS last_ts FROM ev WHERE NOT self GROUP BY ALL")
def _(s, d):
    return st.run_available(st.stream_totals(event_stream(s, d)), "complete")


@query("str_session", f"""WITH {o.EVENTS}, x AS (SELECT *, epoch_us(ts) AS us FROM ev), g AS (SELECT *, CASE WHEN us - lag(us) OVER w > 7200000000 OR lag(us) OVER w IS NULL THEN 1 ELSE 0 END AS fresh FROM x WINDOW w AS (PARTITION BY src_node ORDER BY us, tx_id)),
  h AS (SELECT *, sum(fresh) OVER (PARTITION BY src_node ORDER BY us, tx_id) AS k FROM g) SELECT src_node, min(secs) AS first_secs, floor(max(us) / 1000000)::BIGINT + 7200 AS end_secs, count(*) AS tx_count, sum(cents)::BIGINT / 100 AS amount FROM h GROUP BY src_node, k""")
def _(s, d):
    return st.run_available(st.stream_sessions(event_stream(s, d)), "complete")


@query("str_account_state", f"WITH {o.EVENTS}, {o.state('ev', chr(39) + 'USD' + chr(39), 'node, ' + ', '.join(f'{x} AS {c}' for c, x in STATE_SQL.items()))} SELECT tx_id, dir, node, {', '.join(f'round({c}, {4 if c[0] == chr(97) else 6}) AS {c}' if c in ('volume_in', 'volume_out', 'inout_volume_ratio', 'mean_amount_in', 'mean_amount_out', 'amount_zscore_vs_own_history') else c for c in STATE_SQL)} FROM s")
def _(s, d):
    found = st.run_available(st.stream_account_state(event_stream(s, d)))
    found = rounded(found, "volume_in", "volume_out", "inout_volume_ratio", "mean_amount_in", "mean_amount_out")
    return found.withColumn("amount_zscore_vs_own_history", F.round("amount_zscore_vs_own_history", 4))


@query("str_asof_lag", ORACLES["jn12_lagged_degree"])
def _(s, d):
    stats = graph.node_stats(edges(s, d))
    found = st.run_available(st.stream_lagged(event_stream(s, d), stats, ["out_degree", "in_degree"]))
    return found.select("tx_id", "day_idx", *(f"{e}_{c}" for e in feats.ENDS for c in ("out_degree", "in_degree")))
