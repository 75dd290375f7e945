"""The stages from a shell: ``python -m tidegraph.plans.cli all --root FOLDER --transactions FILE``.

A stage builds what it needs of those before it, unless their artifacts are in the store. Each writes a summary of what it
found and how long it took beside its artifacts, and prints it as a line of JSON.
"""

from __future__ import annotations

import argparse
import json
import time

from pyspark.sql import DataFrame, SparkSession

from tidegraph.operators import models
from tidegraph.plans.config import ARMS, Config
from tidegraph.plans.stages import FEATURES, GRAPH, MODELS, Stages

STAGES = ["ingest", "graph", "features", "train", "walkforward", "bundle"]
SECTIONS = {"ingest": ("dataset",), "graph": GRAPH, "features": FEATURES, "train": MODELS, "walkforward": (*MODELS, "evaluate"), "bundle": MODELS}


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tidegraph")
    p.add_argument("stage", choices=[*STAGES, "all"], help="the last stage to run")
    p.add_argument("--root", required=True, help="folder of the artifacts, in any file system that Spark reads")
    p.add_argument("--transactions", required=True, help="CSV files of raw transactions")
    p.add_argument("--patterns", help="block file of annotated patterns")
    p.add_argument("--config", nargs="*", default=[], help="YAML files, each an overlay on the one before")
    p.add_argument("--arm", choices=sorted(ARMS), help="feature groups of an arm of the ablation")
    p.add_argument("--model", nargs="*", help="models to train, all if not given")
    p.add_argument("--lookback-days", type=int, help="days of a snapshot, all so far if not given")
    p.add_argument("--force", action="store_true", help="build artifacts that are there already")
    return p


def settings(args: argparse.Namespace) -> Config:
    more: dict = {}
    if args.arm:
        more["features"] = {"enabled_groups": ARMS[args.arm]}
    if args.lookback_days is not None:
        more["time"] = {"lookback_days": args.lookback_days}
    return Config.load(*args.config, overrides=more)


def run(spark: SparkSession, args: argparse.Namespace) -> list[dict]:
    """The summaries of the stages, in order."""
    stages = Stages(spark, settings(args), args.root, args.force)
    names = models.chosen(args.model)
    last = STAGES.index(STAGES[-1] if args.stage == "all" else args.stage)
    made: dict[str, DataFrame] = {}
    found = []

    def facts(stage: str) -> dict:
        if stage == "ingest":
            made.update(stages.ingest(args.transactions, args.patterns))
            return {"n_rows": made["transactions"].count(), "n_nodes": made["nodes"].count(), "n_annotated": made["typology"].count()}
        if stage == "graph":
            if not stages.config.needs_snapshots:
                return {"skipped": "no feature group needs snapshots"}
            made["edges"] = stages.graph(made["transactions"])
            return {"edges_by_day": {str(r["day_idx"]): r["count"] for r in made["edges"].groupBy("day_idx").count().orderBy("day_idx").collect()}}
        if stage == "features":
            made["matrix"] = stages.features(made["transactions"], made["nodes"].count(), made.get("edges"))
            return {"n_rows": made["matrix"].count(), "n_columns": len(stages.columns)}
        if stage == "train":
            metrics = stages.train(made["matrix"], made["typology"], names)
            return {"average_precision": {f"{r['model']} {r['split']}": r["average_precision"] for r in metrics.select("model", "split", "average_precision").collect()}}
        if stage == "walkforward":
            return {n: stages.walk_forward(made["matrix"], made["typology"], n)[1].first().asDict() for n in names[-1:]}
        return {n: t.count() for n, t in stages.bundle(made["transactions"], made["nodes"], made["typology"], made["matrix"], names[-1]).items()}

    for stage in STAGES[: last + 1]:
        began = time.perf_counter()
        found.append(stages.summarise(stage, facts(stage), time.perf_counter() - began, SECTIONS[stage]))
    return found


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    for summary in run(SparkSession.builder.appName("tidegraph").getOrCreate(), args):
        print(json.dumps(summary, sort_keys=True, default=str))


if __name__ == "__main__":
    main()
