"""GR3: Louvain communities of each day's undirected graph, seeded and deterministic.

A snapshot is one group; only its collapsed undirected edges go to the task. Labels are the smallest node of a community.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from tidegraph.operators.graph import undirected
from tidegraph.sources.shared import ship


def partition(a: np.ndarray, b: np.ndarray, weight: np.ndarray, seed: int = 42) -> np.ndarray:
    """Community of each of the nodes 0..n-1 that the edges a-b join; moves until modularity no longer grows, level by level."""
    n = int(max(a.max(initial=-1), b.max(initial=-1))) + 1
    label = np.arange(n)
    rng = np.random.default_rng(seed)
    while True:
        near: list[dict[int, float]] = [{} for _ in range(n)]
        loops = np.zeros(n)
        for x, y, w in zip(a.tolist(), b.tolist(), weight.tolist(), strict=True):
            if x == y:
                loops[x] += w
            else:
                near[x][y] = near[x].get(y, 0.0) + w
                near[y][x] = near[y].get(x, 0.0) + w
        degree = np.array([sum(d.values()) for d in near]) + 2 * loops
        total = degree.sum()
        if total <= 0:
            return label
        community, mass = np.arange(n), degree.copy()
        moved_at_all, moved = False, True
        while moved:
            moved = False
            for x in rng.permutation(n).tolist():
                own = int(community[x])
                links: dict[int, float] = {own: 0.0}
                for y, w in near[x].items():
                    c = int(community[y])
                    links[c] = links.get(c, 0.0) + w
                mass[own] -= degree[x]
                gain = {c: w - mass[c] * degree[x] / total for c, w in links.items()}
                best = max(sorted(gain), key=gain.__getitem__)
                if gain[best] <= gain[own] + 1e-12:
                    best = own
                mass[best] += degree[x]
                if best != own:
                    community[x] = best
                    moved = moved_at_all = True
        if not moved_at_all:
            return label
        _, community = np.unique(community, return_inverse=True)
        label = community[label]
        x, y = np.minimum(community[a], community[b]), np.maximum(community[a], community[b])
        n = int(community.max()) + 1
        keys, at = np.unique(x * n + y, return_inverse=True)
        weight = np.bincount(at, weights=weight)
        a, b = keys // n, keys % n


def communities(edges: DataFrame, seed: int = 42, weight: str = "w_norm") -> DataFrame:
    """day_idx, node, community of every active node."""

    def solve(pairs: pd.DataFrame) -> pd.DataFrame:
        pairs = pairs.sort_values(["a", "b"])
        nodes, ids = np.unique(np.concatenate([pairs["a"], pairs["b"]]), return_inverse=True)
        label = partition(ids[: len(pairs)], ids[len(pairs) :], pairs["weight"].to_numpy(float), seed)
        smallest = pd.Series(nodes).groupby(label).transform("min")
        return pd.DataFrame({"day_idx": pairs["day_idx"].iloc[0], "node": nodes, "community": smallest.to_numpy()})

    ship(edges.sparkSession)
    return undirected(edges, weight).groupBy("day_idx").applyInPandas(solve, "day_idx int, node long, community long")
