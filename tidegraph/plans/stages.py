"""The stages, from raw files to the viewer's bundle. Each reads the artifacts of those before it from the store and is skipped
where its own are there, unless forced; keys cover the settings a stage depends on, so arms don't overwrite each other."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegraph.operators import evaluate as ev
from tidegraph.operators import features as feats
from tidegraph.operators import graph, ingest, models, splits
from tidegraph.operators import snapshots as snap
from tidegraph.plans import assemble as asm
from tidegraph.plans.config import ARMS, CODE_VERSION, Config
from tidegraph.sources.files import StageStore, read_blocks, read_transactions
from tidegraph.sources.views import CANONICAL, flags

GRAPH = ("dataset", "time", "graph")
FEATURES = (*GRAPH, "features")
MODELS = (*FEATURES, "sampling", "models", "seed")


class Stages:
    def __init__(self, spark: SparkSession, config: Config, root: str, force: bool = False) -> None:
        self.spark, self.config, self.root, self.force = spark, config, root, force

    def store(self, stage: str, *sections: str) -> StageStore:
        """CACHE1: the stage's folder, with a file that names the settings its key is made of."""
        key = self.config.key_for(*sections)
        store = StageStore(self.spark, self.root, stage, key)
        if not store.exists("settings.json"):
            store.write_json("settings.json", {"key": key, "code": CODE_VERSION, "settings": {s: self.config[s] for s in sorted(sections)}})
        return store

    def summarise(self, stage: str, facts: dict, seconds: float, sections: tuple[str, ...]) -> dict:
        """SNK7: what a stage found and how long it took, beside its artifacts."""
        summary = {"stage": stage, "seconds": round(seconds, 3), "facts": facts}
        self.store(stage, *sections).write_json("summary.json", summary)
        return summary

    def _kept(self, store: StageStore, name: str, build) -> DataFrame:
        return store.cached_frame(name, build, self.force)

    # 0: raw files to canonical tables

    def ingest(self, transactions: str, patterns: str | None = None) -> dict[str, DataFrame]:
        store, data = self.store("ingest", "dataset"), self.config["dataset"]

        def canonical() -> DataFrame:
            raw = read_transactions(self.spark, transactions, data["origin_date"])
            ends = ingest.endpoints(raw, ["src_bank", "src_acct"], ["dst_bank", "dst_acct"], ["bank", "acct"])
            store.write_frame("nodes", ingest.node_index(ends, ["bank", "acct"]))
            index = store.read_frame("nodes")
            coded = ingest.encode(ingest.encode(raw, index, ["src_bank", "src_acct"], "src_node"), index, ["dst_bank", "dst_acct"], "dst_node")
            return flags(coded).select(*CANONICAL, "src_bank", "dst_bank")

        tx = self._kept(store, "transactions", canonical)
        nodes = store.read_frame("nodes")
        facts = ingest.validate(tx, data["expected"]).first().asDict()
        report = {"facts": facts}
        empty = self.spark.createDataFrame([], "tx_id long, attempt_id int, typology string, typology_param short")
        if patterns:

            def linked() -> DataFrame:
                rows = read_blocks(self.spark, patterns).withColumn("secs", F.unix_timestamp("ts"))
                coded = ingest.encode(ingest.encode(rows, nodes, ["src_bank", "src_acct"], "src_node"), nodes, ["dst_bank", "dst_acct"], "dst_node")
                return ingest.link(ingest.with_key(coded), tx).select("pattern_row", "tx_id", "attempt_id", "typology", "typology_param")

            rows = self._kept(store, "pattern_rows", linked)
            typology = self._kept(store, "typology", lambda: rows.where("tx_id IS NOT NULL").drop("pattern_row"))
            if not ingest.assert_unique(typology, "tx_id").isEmpty():
                raise ValueError("a transaction is linked to two annotated rows")
            report["link"] = rows.agg(F.count("*").alias("n_rows"), F.count("tx_id").alias("n_matched"), F.countDistinct("attempt_id").alias("n_attempts")).first().asDict()
        else:
            typology = self._kept(store, "typology", lambda: empty)
        store.write_json("report.json", report)
        return {"transactions": tx, "nodes": nodes, "typology": typology}

    # 1: daily snapshots

    def graph(self, tx: DataFrame) -> DataFrame:
        store, time = self.store("graph", *GRAPH), self.config["time"]
        build = lambda: snap.snapshots(tx, time["max_day"], time["lookback_days"])
        if self.force or not store.has("edges"):
            store.write_frame("edges", build(), ["day_idx"])  # a day's snapshot is a partition
        edges = store.read_frame("edges")
        summary = [r.asDict() for r in snap.summary(edges).orderBy("day_idx").collect()]
        if time["lookback_days"] is None and any(a["n_edges"] > b["n_edges"] for a, b in zip(summary, summary[1:], strict=False)):
            raise AssertionError("cumulative snapshots lose edges")
        store.write_json("meta.json", {"lookback_days": time["lookback_days"], "days": summary})
        return edges

    def snapshot(self, day: int) -> DataFrame:
        """One day's edges; only its partition is read."""
        return self.store("graph", *GRAPH).read_frame("edges").where(F.col("day_idx") == day)

    # 2: feature matrix

    def features(self, tx: DataFrame, n_nodes: int, edges: DataFrame | None = None) -> DataFrame:
        store = self.store("features", *FEATURES)
        rows = tx.where(F.col("day_idx") <= self.config["time"]["max_day"])
        manifest = asm.manifest(asm.BLOCKS.chosen(self.config["features"]["enabled_groups"]))
        build = lambda: asm.assemble(rows, self.config, n_nodes, edges if self.config.needs_snapshots else None)[0]
        matrix = self._kept(store, "matrix", build)
        asm.check_matrix(matrix, rows, manifest)
        store.write_json("manifest.json", manifest)
        return matrix

    @property
    def columns(self) -> list[str]:
        return [column for column, _ in asm.block_columns(self.config["features"]["enabled_groups"])]

    def split(self, matrix: DataFrame, typology: DataFrame) -> DataFrame:
        time = self.config["time"]
        split = splits.assign(matrix, time["train_days"], time["val_days"], time["test_days"])
        out = splits.purge(split, typology) if time["purge_straddling_attempts"] else split
        splits.check_contract(out.select("tx_id", "day_idx", "label", "split"))
        if time["purge_straddling_attempts"] and not splits.straddling(out, typology).isEmpty():
            raise AssertionError("an attempt is in train and in a later split")
        return out

    # 3: models

    def train(self, matrix: DataFrame, typology: DataFrame, names: list[str] | None = None) -> DataFrame:
        store, split = self.store("train", *MODELS), self.split(matrix, typology)
        metrics = None
        for name in models.chosen(names):
            if self.force or not store.has(f"{name}/predictions"):
                model, predictions, found = models.train_and_score(name, split, self.columns, self.config)
                model.write().overwrite().save(f"{store.folder}/{name}/model")
                store.write_frame(f"{name}/predictions", predictions)
                store.write_frame(f"{name}/metrics", found)
            found = store.read_frame(f"{name}/metrics")
            metrics = found if metrics is None else metrics.unionByName(found)
        return metrics

    def predictions(self, name: str) -> DataFrame:
        return self.store("train", *MODELS).read_frame(f"{name}/predictions")

    def model(self, name: str) -> PipelineModel:
        return PipelineModel.load(f"{self.store('train', *MODELS).folder}/{name}/model")

    # 4: evaluation of several arms

    @staticmethod
    def evaluate(arms: dict[str, Stages], typology: DataFrame, name: str = "gbt", baseline: str = "E1", graph_arm: str = "E2") -> dict[str, DataFrame]:
        """Tidy tables behind the figures: curves, average precision by model, recall by family at the graph arm's budget, alert budgets, verdict."""
        scored = {a: s.predictions(name).where("split = 'test'") for a, s in arms.items()}
        budget = arms[graph_arm].store("train", *MODELS).read_frame(f"{name}/metrics").where("split = 'test'").first()["n_flagged"]
        comparison = ev.compare_at_budget(scored, typology, max(1, int(budget)))
        label = lambda df, arm: df.withColumn("arm", F.lit(arm))

        def union(make) -> DataFrame:
            parts = [label(make(a), a) for a in arms]
            out = parts[0]
            for p in parts[1:]:
                out = out.unionByName(p)
            return out

        days = {a: s.config["time"]["test_days"] for a, s in arms.items()}
        return {
            "pr_curves": union(lambda a: ev.pr_curve(scored[a])),
            "average_precision": union(lambda a: ev.average_precision(scored[a])),
            "recall_by_family": comparison,
            "budget_curves": union(lambda a: ev.budget_curve(scored[a], days[a][1] - days[a][0] + 1)),
            "asymmetry": ev.asymmetry(comparison, baseline, graph_arm),
            "family_delta": ev.family_delta(comparison, baseline, graph_arm),
        }

    def attribution(self, matrix: DataFrame, typology: DataFrame, name: str = "gbt", size: int = 20_000) -> DataFrame:
        """EV12: mean absolute attribution of each feature, and the shares of features and blocks, over a sample of the test split."""
        split = self.split(matrix, typology)
        sample = splits.stratified_sample(split.where("split = 'test'"), size, self.config["seed"])
        blocks = asm.block_columns(self.config["features"]["enabled_groups"])
        return ev.shares(models.attributions(self.model(name), sample, self.columns), self.spark.createDataFrame(blocks, "feature string, block string"))

    # 5: walk-forward

    def walk_forward(self, matrix: DataFrame, typology: DataFrame, name: str = "gbt") -> tuple[DataFrame, DataFrame]:
        store = self.store("walkforward", *MODELS, "evaluate")
        results = self._kept(store, f"{name}", lambda: models.walk_forward(matrix, typology, self.columns, self.config, name))
        return results, ev.walk_forward_verdict(results)

    # 6: the viewer's bundle

    def bundle(self, tx: DataFrame, nodes: DataFrame, typology: DataFrame, matrix: DataFrame, name: str = "gbt", top: int = 500, sample: int = 500) -> dict[str, DataFrame]:
        store = self.store("bundle", *MODELS)
        predictions = self.predictions(name)
        threshold = ev.threshold_at_recall(predictions.where("split = 'val'"), self.config["models"]["recall_target"])
        plain = self._kept(store, "alerts", lambda: named(ev.alert_table(predictions.where("split = 'test'"), tx, typology, threshold, top, sample, self.config["seed"]), nodes))
        reasons = self._kept(store, "reasons", lambda: alert_reasons(self.model(name), matrix, plain, self.columns))
        return {"alerts": plain, "reasons": reasons}


def named(alerts: DataFrame, nodes: DataFrame) -> DataFrame:
    """JN17: alerts with bank and account of either end. A bundle has few rows; nodes are joined as their size says."""
    out = alerts
    for end in feats.ENDS:
        side = nodes.select(F.col("node_id").alias(f"{end}_node"), F.col("bank").alias(f"{end}_bank"), F.col("acct").alias(f"{end}_acct"))
        out = out.join(side, f"{end}_node", "left")
    return out


def alert_reasons(model: PipelineModel, matrix: DataFrame, alerts: DataFrame, columns: list[str]) -> DataFrame:
    """EV14, JN18: tx_id, feature, value, raw: what each feature adds to each alert, beside the feature's own value."""
    rows = matrix.join(alerts.select("tx_id"), "tx_id", "left_semi")
    raw = rows.select("tx_id", *(F.col(c).cast("double").alias(c) for c in columns)).unpivot(["tx_id"], columns, "feature", "raw")
    return models.attributions(model, rows, columns).join(raw, ["tx_id", "feature"], "left")


def ego(stages: Stages, node: int, most: int = 25) -> DataFrame:
    """GR10 on the last snapshot."""
    return graph.ego_edges(stages.snapshot(stages.config["time"]["max_day"]), node, most)


def run_arms(spark: SparkSession, root: str, transactions: str, patterns: str | None = None, settings: dict | None = None, names: list[str] | None = None) -> dict[str, Stages]:
    """Every stage up to the models for the three arms of the ablation."""
    arms = {}
    for arm, groups in ARMS.items():
        stages = arms[arm] = Stages(spark, Config({**(settings or {}), "features": {"enabled_groups": groups}}), root)
        tables = stages.ingest(transactions, patterns)
        edges = stages.graph(tables["transactions"]) if stages.config.needs_snapshots else None
        matrix = stages.features(tables["transactions"], tables["nodes"].count(), edges)
        stages.train(matrix, tables["typology"], names)
    return arms
