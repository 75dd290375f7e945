"""Graph kernels by name, so that one can be held against another.

``plans`` is what the engine uses: DataFrames, whatever a day's size. ``arrays`` solves a day's collapsed graph in one task
with NumPy, up to ARRAY_EDGES edges a day, and is there to check the other.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegraph.operators import graph
from tidegraph.operators.louvain import communities
from tidegraph.operators.ordering import with_position

ARRAY_EDGES = 5_000_000


@dataclass(frozen=True)
class Kernels:
    """pagerank: (edges, n_nodes, rounds) to day_idx, node, rank; communities: (edges, seed) to day_idx, node, community."""

    pagerank: Callable[[DataFrame, int, int], DataFrame]
    communities: Callable[[DataFrame, int], DataFrame]


def array_pagerank(edges: DataFrame, n_nodes: int, rounds: int, damping: float = 0.85, weight: str = "w_norm") -> DataFrame:
    """PageRank of each day by dense vectors over the node space; a day beyond ARRAY_EDGES is an error."""

    def solve(rows: pd.DataFrame) -> pd.DataFrame:
        src, dst, w = rows["src"].to_numpy(), rows["dst"].to_numpy(), rows["w"].to_numpy(np.float64)
        out = np.bincount(src, weights=w, minlength=n_nodes)
        share = np.divide(w, out[src], out=np.zeros(len(w)), where=out[src] != 0)
        x = np.full(n_nodes, 1 / n_nodes)
        for _ in range(rounds):
            x = (1 - damping) / n_nodes + damping * (np.bincount(dst, weights=share * x[src], minlength=n_nodes) + x[out == 0].sum() / n_nodes)
        nodes = np.unique(np.concatenate([src, dst]))
        return pd.DataFrame({"day_idx": rows["day_idx"].iloc[0], "node": nodes, "rank": x[nodes]})

    sizes = edges.groupBy("day_idx").agg(F.count("*").alias("n_edges"))
    fits = F.when(F.col("n_edges") > ARRAY_EDGES, F.raise_error(F.lit("a day has too many edges for arrays"))).otherwise(F.col("day_idx"))
    held = edges.join(F.broadcast(sizes), "day_idx").select(fits.cast("int").alias("day_idx"), "src", "dst", F.col(weight).cast("double").alias("w"))
    return held.groupBy("day_idx").applyInPandas(solve, "day_idx int, node long, rank double")


KERNELS: dict[str, Kernels] = {}


def register(name: str, kernels: Kernels) -> None:
    if name in KERNELS:
        raise ValueError(f"kernels {name} are there already")
    KERNELS[name] = kernels


def kernels(name: str) -> Kernels:
    if name not in KERNELS:
        raise ValueError(f"no kernels {name}; there are {sorted(KERNELS)}")
    return KERNELS[name]


register("plans", Kernels(lambda edges, n, rounds: graph.pagerank(edges, n, rounds=rounds), lambda edges, seed: communities(edges, seed)))
register("arrays", Kernels(array_pagerank, lambda edges, seed: communities(edges, seed)))


def rank_agreement(a: DataFrame, b: DataFrame, top: int = 100) -> DataFrame:
    """GR2, GR11: of two rankings (day_idx, node, rank) by day: nodes, largest difference, correlation of positions, how many of the top are in both, and the place of a's first node in b."""
    places = []
    for ranks, name in ((a, "a"), (b, "b")):
        placed = with_position(ranks.select("day_idx", "node", F.round("rank", 12).alias("rank")), ["day_idx", F.desc("rank"), "node"], "at")
        first = placed.groupBy("day_idx").agg(F.min("at").alias("first"))  # a row a day
        places.append(placed.join(F.broadcast(first), "day_idx").select("day_idx", "node", F.col("rank").alias(f"rank_{name}"), (F.col("at") - F.col("first")).alias(f"at_{name}")))
    both = places[0].join(places[1], ["day_idx", "node"])
    return both.groupBy("day_idx").agg(
        F.count("*").alias("n_nodes"), F.max(F.abs(F.col("rank_a") - F.col("rank_b"))).alias("max_difference"), F.corr("at_a", "at_b").alias("rank_correlation"),
        F.count_if((F.col("at_a") < top) & (F.col("at_b") < top)).alias("top_overlap"), F.max(F.when(F.col("at_a") == 0, F.col("at_b") + 1)).alias("hub_place"),
    )
