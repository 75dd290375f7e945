"""Hand-derived fixtures and metamorphic checks of the engine."""

import math
import time

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tidegraph.operators import evaluate as ev
from tidegraph.operators import features as feats
from tidegraph.operators import backends, graph, ingest, splits
from tidegraph.operators import models as ladder
from tidegraph.operators import snapshots as snap
from tidegraph.operators.louvain import communities, partition
from tidegraph.operators.ordering import with_position
from tidegraph.plans.assemble import BLOCKS, Block, assemble, check_matrix, declared
from tidegraph.plans.config import Config, merge
from tidegraph.sources.files import RAW_HEADER, StageStore, read_blocks, read_transactions

TX = "tx_id long, secs long, day_idx int, src_node long, dst_node long, amount_paid double, currency_paid string"


def transactions(spark, rows):
    """rows: (day, src, dst, amount, currency, seconds)."""
    data = [(i, t, d, s, r, float(a), c) for i, (d, s, r, a, c, t) in enumerate(rows)]
    df = spark.createDataFrame(data, TX)
    return df.withColumns({
        "ts": F.timestamp_seconds("secs").cast("timestamp_ntz"), "amount_received": F.col("amount_paid"), "currency_received": F.col("currency_paid"), "payment_format": F.lit("Wire"),
        "is_self_loop": F.col("src_node") == F.col("dst_node"), "is_cross_currency": F.lit(False), "is_cross_bank": F.lit(False), "label": F.lit(0),
    })


def edge_table(spark, rows):
    return spark.createDataFrame([(0, a, b, float(w), float(w), n, 0) for a, b, w, n in rows], "day_idx int, src long, dst long, w_amount double, w_norm double, tx_count long, last_ts long")


#: Two rings of four with chords, heavy inside, and one light edge from 3 to 4. src, dst, weight, transactions; node 8 of the space of 9 has no edge.
RINGS = [
    (0, 1, 8, 1), (1, 2, 8, 2), (2, 3, 8, 1), (3, 0, 8, 1), (0, 2, 8, 1), (1, 3, 8, 1), (3, 4, 1, 1),
    (4, 5, 8, 3), (5, 6, 8, 1), (6, 7, 8, 1), (7, 4, 8, 1), (4, 6, 8, 1), (5, 7, 8, 1),
]


class TestAccountState:
    ROWS = [(0, 5, 8, 40, "USD", 10), (0, 8, 6, 15, "USD", 70), (0, 5, 8, 60, "EUR", 200), (0, 8, 5, 30, "USD", 260)]

    def state(self, spark, rows):
        return {r["tx_id"]: r for r in feats.account_state(transactions(spark, rows)).collect()}

    def test_registers(self, spark):
        s = self.state(spark, self.ROWS)
        new = s[0]
        assert (new.src_tx_count_out, new.src_volume_out, new.dst_tx_count_in, new.src_account_age_secs, new.src_unique_currencies_seen) == (0, 0.0, 0, 0, 0)
        assert new.src_mean_amount_out is None and new.src_turnover_latency is None and s[1].src_turnover_latency is None
        sender = s[2]  # of 40 at second 10; its receiver 8 has had 40 and passed 15 on
        assert (sender.src_tx_count_out, sender.src_volume_out, sender.src_tx_count_in, sender.src_account_age_secs) == (1, 40.0, 0, 190)
        assert (sender.dst_distinct_counterparties_in, sender.dst_distinct_counterparties_out) == (1, 1)
        r = s[3]  # node 8: 40 and 60 in, 15 out
        assert (r.src_tx_count_in, r.src_volume_in, r.src_tx_count_out, r.src_volume_out, r.src_mean_amount_in) == (2, 100.0, 1, 15.0, 50.0)
        assert math.isclose(r.src_inout_volume_ratio, 100 / 15) and r.src_unique_currencies_seen == 2
        assert (r.src_secs_since_last_in, r.src_secs_since_last_out, r.src_turnover_latency) == (60, 190, 60)

    def test_self_loop_sees_neither_side_of_itself(self, spark):
        s = self.state(spark, [(0, 0, 1, 100, "USD", 0), (0, 0, 0, 50, "USD", 100)])
        assert (s[1].src_tx_count_out, s[1].dst_tx_count_out, s[1].src_volume_out, s[1].dst_volume_out) == (1, 1, 100.0, 100.0)

    def test_the_future_changes_nothing(self, spark):
        rows = [(0, i % 3, (i * 7 + 1) % 4, 10 * i + 1, "USD", 50 * i) for i in range(30)]
        whole, cut = self.state(spark, rows), self.state(spark, rows[:17])
        assert all(whole[i] == cut[i] for i in cut)

    def test_counterparties_are_capped(self, spark):
        rows = [(0, 0, i + 1, 1, "USD", i) for i in range(6)]
        last = feats.account_state(transactions(spark, rows), cap=3).where("tx_id = 5").first()
        assert last.src_distinct_counterparties_out == 3 and last.src_tx_count_out == 5

    def test_stream_equals_batch(self, spark, tmp_path):
        from tidegraph.streaming.account_stream import stream_account_state

        tx = transactions(spark, [(0, i % 3, (i * 5 + 1) % 4, 10 * i + 1, "USD", 50 * i) for i in range(20)])
        for k in (0, 1):
            tx.where(F.col("tx_id") < 10 if k == 0 else F.col("tx_id") >= 10).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        source = spark.readStream.schema(tx.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        q = stream_account_state(source).writeStream.format("memory").queryName("state").option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination(120)
        got = {(r.tx_id, r.dir): (r.tx_count_in, r.tx_count_out, r.volume_in, r.volume_out, r.secs_since_last_in, r.turnover_latency, r.account_age_secs) for r in spark.table("state").collect()}
        batch = feats.account_state(tx).collect()
        for r in batch:
            for end, direction in (("src", "out"), ("dst", "in")):
                of = [r[f"{end}_{c}"] for c in ("tx_count_in", "tx_count_out", "volume_in", "volume_out", "secs_since_last_in", "turnover_latency", "account_age_secs")]
                assert got[r.tx_id, direction] == tuple(of)


    def test_a_late_event_is_an_error(self, spark, tmp_path):
        from tidegraph.streaming.account_stream import run_available, stream_account_state

        tx = transactions(spark, [(0, 1, 2, 10, "USD", 50 * i) for i in range(4)])
        for ids in ((2, 3), (0, 1)):
            tx.where(F.col("tx_id").isin(*ids)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
            time.sleep(1.1)
        source = spark.readStream.schema(tx.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        with pytest.raises(Exception, match="comes after"):
            run_available(stream_account_state(source))

    def test_windows_and_sessions_of_a_stream(self, spark, tmp_path):
        from tidegraph.streaming.account_stream import stream_sessions, stream_windows

        tx = transactions(spark, [(0, i % 3, (i * 5 + 1) % 4, 10 * i + 1, "USD", 9000 * i) for i in range(40)])
        tx.coalesce(1).write.parquet(str(tmp_path / "in"))
        source = spark.readStream.schema(tx.schema).parquet(str(tmp_path / "in"))
        for name, make in (("w", lambda t: stream_windows(t, 2)), ("s", stream_sessions)):
            q = make(source).writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).outputMode("complete").trigger(availableNow=True).start()
            q.awaitTermination(120)
        rows = [r for r in tx.collect() if r.src_node != r.dst_node]
        expected = {}
        for r in rows:
            for end in (r.secs // 86400 + 1, r.secs // 86400 + 2):
                key = (end * 86400, r.src_node, r.dst_node)
                expected[key] = expected.get(key, 0) + r.amount_paid
        got = {(int(r.window_end.timestamp()), r.src, r.dst): r.w_amount for r in spark.table("w").collect()}
        assert got == {k: pytest.approx(v) for k, v in expected.items()}
        assert sum(r.tx_count for r in spark.table("s").collect()) == 40


class TestTabular:
    def test_formulas(self, spark):
        amounts = [100, 250, 1000, 1234.56, 1, 50, 500, 50000, 8000, 9500, 9999, 10000, 10500, 0]
        t = {r.tx_id: r for r in feats.tabular(transactions(spark, [(0, 0, 1, a, "USD", 3600 * (i % 24)) for i, a in enumerate(amounts)])).collect()}
        assert [t[i].is_round_100 for i in range(4)] == [1, 0, 1, 0] and [t[i].is_round_1000 for i in range(4)] == [0, 0, 1, 0]
        assert [t[i].trailing_zero_count for i in (4, 5, 6, 7, 3)] == [0, 1, 2, 4, 0]
        assert [t[i].below_threshold_band for i in (8, 9, 10, 11, 12)] == [0, 1, 1, 0, 0]
        assert t[13].amount_mismatch_ratio is None and t[13].trailing_zero_count == 0
        assert [t[i].is_off_hours for i in (3, 9)] == [1, 0]
        assert t[11].threshold_distance == 0 and math.isclose(t[12].threshold_distance, math.log(501))

    def test_codes_follow_values_not_rows(self, spark):
        rows = [(0, 0, 1, 1, c, i) for i, c in enumerate(["EUR", "USD", "BTC"])]
        forward = sorted(r.currency_paid_code for r in feats.tabular(transactions(spark, rows)).collect())
        backward = {r.tx_id: r.currency_paid_code for r in feats.tabular(transactions(spark, rows[::-1])).collect()}
        assert forward == [0, 1, 2] and backward == {0: 0, 1: 2, 2: 1}


class TestSnapshots:
    ROWS = [(0, 4, 7, 30, "USD", 50), (0, 4, 7, 90, "USD", 20), (1, 7, 9, 60, "USD", 10), (2, 9, 9, 500, "USD", 5), (3, 9, 4, 2, "BTC", 8), (3, 7, 4, 600, "USD", 9)]

    def test_collapse(self, spark):
        edges = snap.snapshots(transactions(spark, self.ROWS), 3)
        day0 = edges.where("day_idx = 0").collect()
        assert len(day0) == 1 and (day0[0].tx_count, day0[0].w_amount, day0[0].last_ts) == (2, 120.0, 50)
        assert edges.where("day_idx = 3").count() == 4 and edges.where("src = dst").count() == 0
        assert snap.snapshots(transactions(spark, self.ROWS), 3, 1).where("day_idx = 1").collect()[0].w_amount == 60.0
        assert snap.snapshots(transactions(spark, self.ROWS), 3, 1).where("day_idx = 2").count() == 0

    def test_medians_and_normalised_weights(self, spark):
        rows = snap.graph_rows(transactions(spark, self.ROWS))
        assert {r.currency: r.median for r in snap.currency_medians(rows).collect()} == {"USD": 75.0, "BTC": 2.0}
        e = {(r.src, r.dst): r for r in snap.snapshots(transactions(spark, self.ROWS), 3).where("day_idx = 3").collect()}
        assert (e[7, 4].w_norm, e[9, 4].w_norm, e[4, 7].w_norm) == (8.0, 1.0, 1.6)

    def test_weights_by_kind(self, spark):
        edges = snap.snapshots(transactions(spark, self.ROWS), 0)
        assert [snap.weights(edges, k).first().weight for k in ("amount", "amount_norm", "tx_count")] == [120.0, 2.0, 2.0]
        with pytest.raises(ValueError):
            snap.weights(edges, "colour")

    @pytest.mark.parametrize("day, lookback, days", [(5, 3, [3, 4, 5]), (5, 1, [5]), (9, 7, list(range(3, 10))), (1, 7, [0, 1]), (5, None, list(range(6)))])
    def test_windows(self, spark, day, lookback, days):
        seen = spark.range(10).select(F.col("id").cast("int").alias("day_idx")).withColumn("d", F.explode(snap.window_days(F.col("day_idx"), 0, 9, lookback)))
        assert sorted(r.day_idx for r in seen.where(F.col("d") == day).collect()) == days

    def test_bad_lookback(self):
        with pytest.raises(ValueError):
            snap.window_days(F.lit(1), 0, 9, 0)

    def test_empty(self, spark):
        assert snap.snapshots(transactions(spark, self.ROWS).limit(0), 3).count() == 0


class TestGraph:
    def test_stats(self, spark):
        s = {r.node: r for r in graph.node_stats(edge_table(spark, RINGS)).collect()}
        assert [s[i].out_degree for i in range(8)] == [2, 2, 1, 2, 2, 2, 1, 1] and [s[i].in_degree for i in range(8)] == [1, 1, 2, 2, 2, 1, 2, 2]
        assert [s[i].out_strength for i in range(8)] == [16, 16, 8, 9, 16, 16, 8, 8] and [s[i].in_tx for i in range(8)] == [1, 1, 3, 2, 2, 3, 2, 2]
        assert 8 not in s

    @pytest.mark.parametrize("edges", [RINGS, [(0, 1, 3, 1), (2, 1, 1, 1), (1, 3, 2, 1)]])
    def test_pagerank(self, spark, edges):
        """Against power iteration on the whole matrix, with nodes that dangle in the second graph."""
        e = edge_table(spark, edges)
        p = {r.node: r["rank"] for r in graph.pagerank(e, 9).collect()}
        matrix = np.zeros((9, 9))
        for a, b, w, _ in edges:
            matrix[b, a] += w
        total = matrix.sum(0)
        matrix = np.where(total > 0, matrix / np.where(total > 0, total, 1), 1 / 9)
        x = np.full(9, 1 / 9)
        for _ in range(300):
            x = 0.15 / 9 + 0.85 * matrix @ x
        assert all(math.isclose(p[i], x[i], abs_tol=1e-9) for i in p)
        for rounds in (1, 6):
            a, b = ({r.node: r["rank"] for r in backends.kernels(k).pagerank(e, 9, rounds).collect()} for k in ("plans", "arrays"))
            assert a.keys() == b.keys() and all(math.isclose(a[i], b[i], rel_tol=1e-12) for i in a)

    def test_pagerank_of_weightless_edges(self, spark):
        """A node whose out-edges weigh 0 dangles, in both kernels; another whose edges weigh 0 in part does not."""
        weightless, without = (edge_table(spark, [(0, 1, 3, 1), (2, 1, 1, 1), *more]) for more in ([(1, 0, 0, 1), (1, 2, 0, 1), (2, 0, 0, 1)], []))
        expected = {r.node: r["rank"] for r in graph.pagerank(without, 9, rounds=6).collect()}
        for kernel in ("plans", "arrays"):
            got = {r.node: r["rank"] for r in backends.kernels(kernel).pagerank(weightless, 9, 6).collect()}
            assert got.keys() == expected.keys() and all(math.isclose(got[i], expected[i], rel_tol=1e-12) for i in got)
        assert {r.node for r in graph.pagerank(weightless, 9).collect()} == {0, 1, 2}

    def test_weights_matter(self, spark):
        e = edge_table(spark, RINGS)
        weighted, plain = ({r.node: r["rank"] for r in graph.pagerank(e, 9, weight=w, rounds=12).collect()} for w in ("w_norm", None))
        assert plain[4] > weighted[4] + 1e-3  # the light edge counts as much as the others

    def test_kernels_by_name(self):
        with pytest.raises(ValueError):
            backends.kernels("nope")
        with pytest.raises(ValueError):
            backends.register("plans", backends.kernels("arrays"))

    def test_self_loops_are_rejected(self, spark):
        with pytest.raises(PySparkException):
            graph.check_edges(edge_table(spark, [(1, 1, 1, 1)])).collect()
        with pytest.raises(PySparkException):
            graph.check_edges(edge_table(spark, [(1, 9, 1, 1)]), 5).collect()

    def test_communities(self, spark):
        c = {r.node: r.community for r in communities(edge_table(spark, RINGS)).collect()}
        assert c[0] == c[1] == c[2] == c[3] != c[4] == c[5] == c[6] == c[7]
        assert partition(np.array([0]), np.array([1]), np.array([1.0])).tolist() in ([0, 0], [1, 1])
        agree = graph.partition_agreement(*(spark.createDataFrame(list(c.items()), "node long, community long") for _ in "ab"), spark.createDataFrame([(0, 1), (1, 4)], "x long, y long")).first()
        assert (agree.agreement, agree.n_pairs) == (1.0, 2)

    def test_ego(self, spark):
        e = edge_table(spark, [*((0, i, 1, 1) for i in range(1, 6)), (6, 0, 1, 1)])
        assert graph.ego_edges(e, 0, 10).count() == 6 and graph.ego_edges(e, 7, 10).count() == 0
        cut = graph.ego_edges(e, 0, 2).collect()
        assert len(cut) == 3 and {r.hidden for r in cut if r.direction == "out"} == {3}


class TestLag:
    ROWS = [(0, 0, 1), (0, 1, 0), (1, 2, 3), (1, 3, 4), (1, 4, 2), (2, 0, 2), (2, 5, 1)]

    def test_structure_and_motifs(self, spark):
        tx = transactions(spark, [(d, a, b, 100, "USD", i) for i, (d, a, b) in enumerate(self.ROWS)])
        edges = snap.snapshots(tx, 2, 1)
        m = {r.tx_id: r for r in feats.motifs(tx, edges).collect()}
        s = {r.tx_id: r for r in feats.structural(tx, edges, 6, communities(edges), rounds=20).collect()}
        assert s[0].is_cold_start == 1 and s[0].src_pagerank is None and s[1].same_community is None and s[1].src_community_size is None
        assert s[2].src_pagerank is None and s[2].src_out_degree_centrality is None and m[2].src_cycle_2hop is None
        assert all(s[i].is_cold_start == 0 for i in range(2, 7))
        cumulative = snap.snapshots(tx, 2)
        m = {r.tx_id: r for r in feats.motifs(tx, cumulative).collect()}
        s = {r.tx_id: r for r in feats.structural(tx, cumulative, 6, communities(cumulative), rounds=20).collect()}
        assert s[5].src_out_degree_centrality == 0.25
        assert (m[5].src_cycle_2hop, m[5].dst_cycle_3hop, m[5].dst_fanout_burst, m[5].src_amount_conservation, m[5].common_neighbours) == (1, 1, 1, 1.0, 0)
        assert m[6].src_cycle_2hop is None and m[6].dst_cycle_2hop == 1 and m[2].src_fanout_burst is None

    def test_closed_walks_by_matrix(self, spark):
        rng = np.random.default_rng(1)
        a = np.triu(rng.random((8, 8)) < 0.4, 1).astype(int) + np.tril(rng.random((8, 8)) < 0.4, -1).astype(int)
        e = edge_table(spark, [(int(i), int(j), 1, 1) for i, j in zip(*np.nonzero(a), strict=True)])
        got = {r.node: (r.cycle_2hop, r.cycle_3hop, r.cycle_4hop) for r in feats.closed_walks(e).collect()}
        for n in range(8):
            expected = tuple(int(np.linalg.matrix_power(a, k)[n, n]) for k in (2, 3, 4))
            assert got.get(n, (0, 0, 0)) == expected


class TestSplits:
    ROWS = [(0, 1), (0, 1), (1, 1), (1, 0), (2, 1), (2, 0), (3, 1), (3, 0)]
    ATTEMPTS = {0: 0, 1: 1, 2: 1, 4: 2, 6: 0}

    def test_purge(self, spark):
        tx = spark.createDataFrame([(i, d, y) for i, (d, y) in enumerate(self.ROWS)], "tx_id long, day_idx int, label int")
        typology = spark.createDataFrame(list(self.ATTEMPTS.items()), "tx_id long, attempt_id long")
        split = splits.assign(tx, (0, 1), (2, 2), (3, 3))
        kept = splits.purge(split, typology)
        assert sorted(r.tx_id for r in kept.collect()) == [1, 2, 3, 4, 5, 6, 7]
        assert splits.straddling(split, typology).count() == 1 and splits.straddling(kept, typology).count() == 0
        splits.check_contract(kept)
        with pytest.raises(ValueError):
            splits.check_contract(kept.where("split <> 'val'"))

    def test_sampling(self, spark):
        train = spark.range(100).select(F.col("id").alias("tx_id"), (F.col("id") < 5).cast("int").alias("label"), F.lit("train").alias("split"))
        once, again = ({r.tx_id for r in splits.subsample_negatives(train, 3).collect()} for _ in "ab")
        assert once == again and len(once) == 20 and set(range(5)) <= once
        assert splits.subsample_negatives(train, 50).count() == 100
        with pytest.raises(ValueError):
            splits.subsample_negatives(train.withColumn("split", F.lit("val")), 3)
        with pytest.raises(ValueError):
            splits.subsample_negatives(train, 0.5)


def scored(spark, scores, labels):
    return spark.createDataFrame([(i, float(s), y) for i, (s, y) in enumerate(zip(scores, labels, strict=True))], "tx_id long, score double, label int")


class TestEvaluate:
    def test_metrics(self, spark):
        perfect = scored(spark, [0.9, 0.8, 0.7, 0.6, 0.5, 0.4], [1, 1, 0, 0, 0, 0])
        assert ev.average_precision(perfect).first()[0] == 1.0 and ev.roc_auc(perfect).first()[0] == 1.0
        t = ev.threshold_at_recall(perfect, 1.0)
        assert t.first().threshold == 0.8 and ev.evaluate_split(perfect, t, 2).first().n_flagged == 2
        rng = np.random.default_rng(2)
        s, y = np.round(rng.random(400), 2), (rng.random(400) < 0.2).astype(int)
        df = scored(spark, s.tolist(), y.tolist())
        order = np.argsort(-s, kind="stable")
        steps = np.flatnonzero(np.diff(s[order], append=-1))
        tp, n = np.cumsum(y[order])[steps], steps + 1
        expected = float((np.diff(tp, prepend=0) / y.sum() * tp / n).sum())
        assert math.isclose(ev.average_precision(df).first()[0], expected, rel_tol=1e-9)
        wins = (s[y == 1][:, None] > s[y == 0]).sum() + 0.5 * (s[y == 1][:, None] == s[y == 0]).sum()
        assert math.isclose(ev.roc_auc(df).first()[0], wins / (y.sum() * (1 - y).sum()), rel_tol=1e-9)
        low = ev.bootstrap(df, 40).first()
        assert low.lo < expected < low.hi

    def test_no_positives(self, spark):
        assert ev.average_precision(scored(spark, [0.1, 0.2], [0, 0])).first()[0] is None

    def test_budget(self, spark):
        df = scored(spark, range(100), [0] * 100)
        assert df.join(ev.kth_score(df, 10)).where("score >= threshold").count() == 10
        assert ev.kth_score(scored(spark, [5, 4], [0, 0]), 999).first().threshold == 4
        with pytest.raises(ValueError):
            ev.kth_score(df, 0)
        with pytest.raises(ValueError):
            ev.alerts_per_day(df, ev.kth_score(df, 1), 0)

    @pytest.mark.parametrize("frozen, verdict", [([0.07, 0.066, 0.066, 0.067], "not decay"), ([0.5, 0.4, 0.3, 0.2], "decay"), ([0.07, 0.42, 0.49, 0.49], "no separation")])
    def test_walk_forward(self, spark, frozen, verdict):
        rows = [(b + 1, a, v, v - 0.01, v + 0.01) for a, vs in (("retrained", [0.07, 0.42, 0.49, 0.49]), ("frozen", frozen)) for b, v in enumerate(vs)]
        df = spark.createDataFrame(rows, "block int, arm string, auprc double, auprc_lo double, auprc_hi double")
        assert ev.walk_forward_verdict(df).first().verdict == verdict

    def test_asymmetry_needs_intervals_apart(self, spark):
        rows = [(arm, t, 3, d) for arm, ds in (("A", (3, 0)), ("B", (3, 2))) for t, d in zip(("RANDOM", "CYCLE"), ds, strict=True)]
        df = spark.createDataFrame(rows, "arm string, typology string, n_positives long, n_detected long")
        assert ev.asymmetry(df, "A", "B").first().verdict == "inconclusive"


class TestFiles:
    ROWS = ["2022/09/01 10:00,001,A1,002,B1,100.00,US Dollar,100.00,US Dollar,Wire,1", "2022/09/01 09:00,001,A1,001,A1,5.00,US Dollar,5.00,US Dollar,Wire,0", "2022/09/03 09:00,002,A1,001,A1,7.00,Euro,8.00,US Dollar,Wire,1"]

    def test_csv(self, spark, tmp_path):
        path = tmp_path / "t.csv"
        path.write_text("\n".join([",".join(RAW_HEADER), *self.ROWS]) + "\n")
        rows = read_transactions(spark, str(path), "2022-09-01").orderBy("tx_id").collect()
        assert [(r.tx_id, r.day_idx, r.src_bank, r.label) for r in rows] == [(0, 0, "001", 0), (1, 0, "001", 1), (2, 2, "002", 1)]
        path.write_text("a,b\n1,2\n")
        with pytest.raises(ValueError):
            read_transactions(spark, str(path), "2022-09-01")

    def block(self, spark, tmp_path, lines):
        path = tmp_path / "p.txt"
        path.write_text("\n".join(lines) + "\n")
        return read_blocks(spark, str(path)).orderBy("pattern_row").collect()

    def test_blocks(self, spark, tmp_path):
        r = [x.replace(",0", ",1") if x.endswith(",0") else x for x in self.ROWS]
        got = self.block(spark, tmp_path, ["BEGIN LAUNDERING ATTEMPT - FAN-OUT:  Max 16-degree Fan-Out", r[0], r[2], "END LAUNDERING ATTEMPT - FAN-OUT", "", "BEGIN LAUNDERING ATTEMPT - CYCLE", r[0], "END LAUNDERING ATTEMPT - CYCLE"])
        assert [(x.attempt_id, x.typology, x.typology_param) for x in got] == [(0, "FAN-OUT", 16), (0, "FAN-OUT", 16), (1, "CYCLE", None)]

    @pytest.mark.parametrize("lines", [["BEGIN LAUNDERING ATTEMPT - CYCLE", "row"], ["BEGIN LAUNDERING ATTEMPT - CYCLE", "BEGIN LAUNDERING ATTEMPT - CYCLE"], ["END LAUNDERING ATTEMPT - CYCLE"], ["BEGIN LAUNDERING ATTEMPT - CYCLE", "END LAUNDERING ATTEMPT - STACK"], ["1,2,3"], ["BEGIN LAUNDERING ATTEMPT - CYCLE"]])
    def test_bad_blocks(self, spark, tmp_path, lines):
        with pytest.raises(ValueError):
            self.block(spark, tmp_path, lines)

    def test_unknown_family(self, spark, tmp_path):
        with pytest.raises(PySparkException):
            self.block(spark, tmp_path, ["BEGIN LAUNDERING ATTEMPT - OTHER", self.ROWS[0], "END LAUNDERING ATTEMPT - OTHER"])

    def test_store(self, spark, tmp_path):
        store = StageStore(spark, f"file://{tmp_path}", "graph", Config().key_for("graph"))
        with pytest.raises(FileNotFoundError):
            store.read_frame("edges")
        built = []
        for _ in range(2):
            assert store.cached_frame("edges", lambda: built.append(1) or spark.range(3)).count() == 3
        assert built == [1]
        store.write_json("meta.json", {"b": 1, "a": [2]})
        assert store.read_json("meta.json") == {"a": [2], "b": 1}


class TestIngest:
    def test_link_by_rank(self, spark):
        tx = transactions(spark, [(0, 0, 1, 10, "USD", 5), (0, 0, 1, 10, "USD", 5), (0, 2, 1, 10.01, "USD", 5)]).withColumn("label", F.when(F.col("tx_id") == 0, 0).otherwise(1))
        p = spark.createDataFrame([(1, 5, 0, 1, 1000, "USD", "Wire"), (2, 5, 2, 1, 1000, "USD", "Wire")], "pattern_row int, secs long, src_node long, dst_node long, cents long, currency_paid string, payment_format string")
        assert {r.pattern_row: r.tx_id for r in ingest.link(p, tx).collect()} == {1: 1, 2: None}
        assert ingest.licit_collisions(p, tx).count() == 1 and ingest.ambiguous(p, tx).count() == 0

    def test_unknown_id_and_drift_are_errors(self, spark):
        index = spark.createDataFrame([(0, "a")], "node_id long, acct string")
        with pytest.raises(PySparkException):
            ingest.decode(spark.createDataFrame([(7,)], "n long"), index, "n").collect()
        with pytest.raises(PySparkException):
            ingest.validate(transactions(spark, TestSnapshots.ROWS), {"n_rows": 7}).collect()
        assert ingest.validate(transactions(spark, TestSnapshots.ROWS), {"n_rows": 6}).first().n_self_loops == 1

    def test_backwards(self, spark):
        assert ingest.backwards(transactions(spark, [(0, 0, 1, 1, "USD", t) for t in (5, 5, 4, 9)])).first()[0] == 1

    def test_positions(self, spark):
        df = spark.range(1000).select(((F.col("id") * 7919) % 1000).alias("v")).repartition(7)
        assert sorted((r.v, r.at) for r in with_position(df, ["v"], "at").collect()) == [(i, i) for i in range(1000)]
        assert with_position(df.limit(0), ["v"], "at").count() == 0


class TestAssembly:
    def test_config(self):
        assert merge({"a": {"b": 1, "c": [1, 2]}}, {"a": {"c": [3]}}) == {"a": {"b": 1, "c": [3]}}
        with pytest.raises(KeyError):
            Config({"graph": {"nope": 1}})
        with pytest.raises(ValueError):
            Config({"time": {"val_days": [5, 6]}})
        assert Config().key_for("graph") != Config({"graph": {"pagerank_damping": 0.9}}).key_for("graph")
        assert Config().key_for("graph") == Config({"seed": 7}).key_for("graph")

    def test_matrix(self, spark):
        tx = transactions(spark, [(i // 4, i % 4, (i * 3 + 1) % 5, 10 * i + 5, "USD", i * 60) for i in range(24)])
        config = Config({"features": {"enabled_groups": ["tabular", "streaming"]}})
        m, manifest = assemble(tx, config, 5)
        assert len(manifest) == 49
        check_matrix(m, tx, manifest)
        with pytest.raises(AssertionError):
            check_matrix(m.limit(3), tx, manifest)
        with pytest.raises(ValueError):
            assemble(tx, Config({"features": {"enabled_groups": []}}), 5)

    def test_registry(self):
        with pytest.raises(ValueError):
            BLOCKS.add("tabular", Block(declared([], "row")))
        with pytest.raises(ValueError):
            declared(["x"], "row", "sometimes")
        with pytest.raises(ValueError):
            declared(["x"], "hearsay")
        with pytest.raises(KeyError):
            ladder.chosen(["nope"])
        assert ladder.chosen(["gbt", "decision_tree"]) == ["decision_tree", "gbt"]
