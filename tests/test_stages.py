"""The stages end to end on a small raw file."""

import json
import random

import pytest
from pyspark.sql import functions as F

from tidegraph.plans import cli
from tidegraph.plans.config import Config
from tidegraph.plans.stages import Stages, ego, run_arms
from tidegraph.sources.files import RAW_HEADER

SETTINGS = {"dataset": {"origin_date": "2022-09-01"}, "models": {"gbt": {"n_estimators": 3, "min_samples_leaf": 1}, "decision_tree": {"min_samples_leaf": 1}}, "evaluate": {"bootstrap_iterations": 20}}


@pytest.fixture(scope="module")
def files(tmp_path_factory):
    folder = tmp_path_factory.mktemp("raw")
    rng = random.Random(1)
    rows, blocks = [], []
    for i in range(600):
        day, a, b = i // 60 + 1, rng.randint(0, 15), rng.randint(0, 15)
        label = int(rng.random() < 0.2)
        amount = f"{9000 + rng.randint(0, 900) if label else rng.randint(1, 500)}.{i % 100:02}"
        rows.append(f"2022/09/{day:02} {i % 24:02}:{i % 60:02},{a % 3:03},A{a},{b % 3:03},A{b},{amount},US Dollar,{amount},US Dollar,{rng.choice(['Wire', 'Cash'])},{label}")
        if label and i % 2:
            blocks += [f"BEGIN LAUNDERING ATTEMPT - {'CYCLE:  Max 3 hops' if i % 3 else 'RANDOM'}", rows[-1], f"END LAUNDERING ATTEMPT - {'CYCLE' if i % 3 else 'RANDOM'}"]
    (folder / "tx.csv").write_text("\n".join([",".join(RAW_HEADER), *rows]) + "\n")
    (folder / "patterns.txt").write_text("\n".join(blocks) + "\n")
    return str(folder / "tx.csv"), str(folder / "patterns.txt")


def test_all_stages(spark, files, tmp_path):
    root = f"file://{tmp_path}"
    arms = run_arms(spark, root, *files, SETTINGS, ["gbt"])
    stages = arms["E2"]
    t = stages.ingest(*files)
    report = stages.store("ingest", "dataset").read_json("report.json")
    assert report["facts"]["n_rows"] == 600 and report["link"]["n_rows"] == report["link"]["n_matched"] > 20
    assert t["nodes"].count() == report["facts"]["n_nodes"]
    matrix = stages.features(t["transactions"], t["nodes"].count())
    assert len(matrix.columns) == 90 and matrix.count() == 600 and len(arms["E1"].columns) == 17
    found = Stages.evaluate(arms, t["typology"])
    assert found["average_precision"].count() == 3 and found["asymmetry"].first().verdict in ("inconclusive", "supports mechanism", "leak alarm")
    assert found["average_precision"].agg(F.min("average_precision")).first()[0] > 0.5
    assert {r.typology for r in found["recall_by_family"].collect()} <= {"CYCLE", "RANDOM", "UNANNOTATED"} and found["pr_curves"].count() > 3 and found["budget_curves"].count() > 3
    b = stages.bundle(t["transactions"], t["nodes"], t["typology"], matrix, top=5, sample=4)
    alerts = b["alerts"].orderBy("rank").collect()
    assert len(alerts) == 9 and [a.score for a in alerts] == sorted((a.score for a in alerts), reverse=True) and all(a.src_acct for a in alerts)
    assert b["reasons"].count() == 9 * 86
    shares = stages.attribution(matrix, t["typology"], size=60)
    assert abs(shares.agg(F.sum("share")).first()[0] - 1) < 1e-6
    node = alerts[0].src_node
    assert ego(stages, node, 2).groupBy("direction").count().agg(F.max("count")).first()[0] <= 2


def test_walk_forward(spark, files, tmp_path):
    stages = Stages(spark, Config({**SETTINGS, "features": {"enabled_groups": ["tabular"]}}), f"file://{tmp_path}")
    t = stages.ingest(*files)
    matrix = stages.features(t["transactions"], 48)
    results, verdict = stages.walk_forward(matrix, t["typology"], "decision_tree")
    assert results.count() == 8 and verdict.first().n_blocks == 4


def test_command_line(spark, files, tmp_path, capsys):
    settings = tmp_path / "settings.yaml"
    settings.write_text("dataset:\n  origin_date: '2022-09-01'\nmodels:\n  decision_tree:\n    min_samples_leaf: 1\n")
    options = ["--root", f"file://{tmp_path}/out", "--transactions", files[0], "--patterns", files[1], "--config", str(settings), "--arm", "E1", "--model", "decision_tree"]
    cli.main(["train", *options])
    ingest, graph, features, train = (json.loads(line) for line in capsys.readouterr().out.splitlines() if line.startswith("{"))
    assert ingest["facts"]["n_rows"] == features["facts"]["n_rows"] == 600 and features["facts"]["n_columns"] == 17 and "skipped" in graph["facts"]
    assert set(train["facts"]["average_precision"]) == {"decision_tree val", "decision_tree test"}
    stages = Stages(spark, cli.settings(cli.parser().parse_args(["train", *options])), f"file://{tmp_path}/out")
    store = stages.store("features", *cli.FEATURES)
    assert store.read_json("summary.json")["stage"] == "features" and set(store.read_json("settings.json")["settings"]) == set(cli.FEATURES)
    with pytest.raises(SystemExit):
        cli.parser().parse_args(["nonsense", *options])
