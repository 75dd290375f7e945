"""Configuration: a fixed tree of settings, overlays that merge into it, and a key for stage artifacts."""

from __future__ import annotations

import copy
import hashlib
import json
from pathlib import Path

CODE_VERSION = "1"  # part of every key: a change of code that changes results must change it
DEFAULTS: dict = {
    "seed": 42,
    "dataset": {"origin_date": "2024-01-01", "expected": {}},
    "time": {"lookback_days": None, "max_day": 9, "train_days": [0, 5], "val_days": [6, 6], "test_days": [7, 9], "purge_straddling_attempts": True},
    "graph": {"exclude_self_loops": True, "pagerank_damping": 0.85, "pagerank_weighted": True},
    "features": {"enabled_groups": ["tabular", "streaming", "structural", "motif"], "max_tracked_counterparties": 512},
    "sampling": {"negative_ratio": 50},
    "models": {"recall_target": 0.90, "logistic_regression": {"max_iter": 1000, "C": 1.0}, "decision_tree": {"max_depth": 8, "min_samples_leaf": 50}, "random_forest": {"n_estimators": 300, "min_samples_leaf": 5}, "gbt": {"n_estimators": 500, "learning_rate": 0.05, "min_samples_leaf": 50}},
    "evaluate": {"bootstrap_iterations": 200, "walkforward_blocks": 5, "walkforward_block_days": 2},
}
GROUPS = ["tabular", "streaming", "structural", "motif"]
ARMS = {"E1": ["tabular"], "E3": ["tabular", "streaming"], "E2": GROUPS}


def merge(base: dict, overlay: dict, at: str = "") -> dict:
    """base with the overlay's values: mappings merge, anything else is replaced. A key that base doesn't have is an error."""
    out = copy.deepcopy(base)
    for key, value in overlay.items():
        if key not in out:
            raise KeyError(f"unknown setting {at}{key}")
        free = at + key == "dataset.expected"
        out[key] = merge(out[key], value, f"{at}{key}.") if isinstance(out[key], dict) and isinstance(value, dict) and not free else copy.deepcopy(value)
    return out


class Config:
    def __init__(self, values: dict | None = None) -> None:
        self.values = merge(DEFAULTS, values or {})
        t = self["time"]
        if not t["train_days"][0] <= t["train_days"][1] < t["val_days"][0] <= t["val_days"][1] < t["test_days"][0] <= t["test_days"][1] <= t["max_day"]:
            raise ValueError("windows must follow each other and end by max_day")
        if t["lookback_days"] is not None and t["lookback_days"] < 1:
            raise ValueError("a lookback is one day at least")
        unknown = set(self["features"]["enabled_groups"]) - set(GROUPS)
        if unknown:
            raise ValueError(f"unknown feature groups: {sorted(unknown)}")
        if self["sampling"]["negative_ratio"] < 1:
            raise ValueError("the ratio is 1 at least")

    @classmethod
    def load(cls, *paths: str, overrides: dict | None = None) -> Config:
        """SRC7: YAML files, each an overlay on the one before, then overrides."""
        import yaml

        values = copy.deepcopy(DEFAULTS)
        for path in paths:
            values = merge(values, yaml.safe_load(Path(path).read_text()) or {})
        return cls(merge(values, overrides or {}))

    def __getitem__(self, section: str):
        return self.values[section]

    @property
    def needs_snapshots(self) -> bool:
        return bool({"structural", "motif"} & set(self["features"]["enabled_groups"]))

    def key_for(self, *sections: str) -> str:
        """CACHE3: 12 hexadecimal digits for these sections and the code version."""
        data = {s: self.values[s] for s in sorted(sections)} | {"code": CODE_VERSION}
        return hashlib.sha256(json.dumps(data, sort_keys=True).encode()).hexdigest()[:12]
