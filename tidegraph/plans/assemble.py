"""Registry of feature blocks, and the assembly of the feature matrix with its manifest and checks.

A block declares its columns as a Spark schema; what is known about a column (where its values come from, and when it may
be null) travels as metadata of its field, into the matrix and into the files that are written of it.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType, StructField, StructType

from tidegraph.operators import features as feats
from tidegraph.operators.louvain import communities
from tidegraph.operators.snapshots import snapshots
from tidegraph.plans.config import Config

PASSTHROUGH = ["tx_id", "day_idx", "label", "src_node"]
SOURCES = ("row", "state", "snapshot")  # what a column is made of: its own row, rows before it, the snapshot of the day before
NULLS = ("never", "cold_start", "dormant", "guarded")  # when a column may be null


def declared(names: list[str], source: str, nulls: str = "never", but: dict[str, str] | None = None) -> StructType:
    """Fields of these columns; but: columns with another null policy."""
    fields = []
    for name in names:
        policy = (but or {}).get(name, nulls)
        if source not in SOURCES or policy not in NULLS:
            raise ValueError(f"{name}: no source {source} or null policy {policy}")
        fields.append(StructField(name, FloatType(), policy != "never", {"source": source, "nulls": policy}))
    return StructType(fields)


@dataclass(frozen=True)
class Job:
    """What blocks are computed from."""

    tx: DataFrame
    config: Config
    n_nodes: int
    edges: DataFrame | None = None


@dataclass(frozen=True)
class Block:
    """make: tx_id and the columns of the schema from a Job. A block of row-local columns gives ``own`` instead: it adds its columns to the transactions, and nothing is joined."""

    schema: StructType
    make: Callable[[Job], DataFrame] | None = None
    own: Callable[[DataFrame, list[str]], DataFrame] | None = None
    snapshots: bool = False


@dataclass
class Registry:
    blocks: dict[str, Block] = field(default_factory=dict)

    def add(self, name: str, block: Block) -> None:
        if name in self.blocks:
            raise ValueError(f"block {name} is there already")
        self.blocks[name] = block

    def chosen(self, names: list[str]) -> dict[str, Block]:
        if not names or not set(names) <= set(self.blocks):
            raise ValueError(f"no such feature groups: {sorted(set(names) - set(self.blocks))}" if names else "no feature group is enabled")
        return {n: self.blocks[n] for n in sorted(names)}


BLOCKS = Registry()


def manifest(blocks: dict[str, Block]) -> list[dict]:
    """Column, block, source, type and null policy of every column of the matrix, in order."""
    return [{"column": f.name, "block": name, "source": f.metadata["source"], "type": f.dataType.simpleString(), "nulls": f.metadata["nulls"]} for name, b in blocks.items() for f in b.schema]


def manifest_frame(spark: SparkSession, blocks: dict[str, Block]) -> DataFrame:
    return spark.createDataFrame([tuple(x.values()) for x in manifest(blocks)], "column string, block string, source string, type string, nulls string")


def manifest_counts(rows: DataFrame) -> DataFrame:
    """AGG19: how many columns of the manifest come from each source, by block."""
    return rows.groupBy("block", "source").agg(F.count("*").alias("n_columns"), F.count_if(F.col("nulls") != "never").alias("n_nullable"))


def block_columns(names: list[str]) -> list[tuple[str, str]]:
    """(column, block) of every column of these blocks."""
    return [(x["column"], x["block"]) for x in manifest(BLOCKS.chosen(names))]


def assemble(tx: DataFrame, config: Config, n_nodes: int, edges: DataFrame | None = None, unit: str = "currency_paid", blocks: dict[str, Block] | None = None) -> tuple[DataFrame, list[dict]]:
    """AS1: the feature matrix (floats) and its manifest."""
    blocks = BLOCKS.chosen(config["features"]["enabled_groups"]) if blocks is None else blocks
    if edges is None and any(b.snapshots for b in blocks.values()):
        edges = snapshots(tx, config["time"]["max_day"], config["time"]["lookback_days"], unit)
    job = Job(tx, config, n_nodes, edges)
    typed = lambda f: F.col(f.name).cast(f.dataType).alias(f.name, metadata=f.metadata)
    local = [f for b in blocks.values() if b.own for f in b.schema]
    out = tx.select(*PASSTHROUGH)
    for b in blocks.values():
        if b.own:
            out = b.own(tx, PASSTHROUGH) if len(local) == len(b.schema) else out.join(b.own(tx, ["tx_id"]), "tx_id")
    out = out.select(*PASSTHROUGH, *map(typed, local))
    for name, b in blocks.items():
        if b.make:
            frame = b.make(job)
            if frame.columns != ["tx_id", *b.schema.names]:
                raise AssertionError(f"block {name} gives {sorted(set(frame.columns) ^ {'tx_id', *b.schema.names})} against its schema")
            out = out.join(frame.select("tx_id", *map(typed, b.schema)), "tx_id")
    return out.select(*PASSTHROUGH, *(n for b in blocks.values() for n in b.schema.names)), manifest(blocks)


def null_rates(matrix: DataFrame, columns: list[str]) -> DataFrame:
    """AGG17, AGG18: column, share of nulls, number of infinite values; one pass, then one row a column."""
    infinite = lambda c: F.count_if(F.abs(F.col(c).cast("double")) == F.lit(float("inf")))
    row = matrix.agg(F.array(*(F.struct(F.lit(c).alias("column"), (F.count_if(F.col(c).isNull()) / F.count("*")).alias("null_rate"), infinite(c).alias("n_infinite")) for c in columns)).alias("x"))
    return row.select(F.explode("x").alias("x")).select("x.*")


def largest(rows: DataFrame, value: str, name: str, k: int) -> DataFrame:
    """TOP5: the k rows with the largest value, ties by name, and their place."""
    top = rows.orderBy(F.desc(value), name).limit(k)  # k rows
    return top.withColumn("place", F.row_number().over(W.orderBy(F.desc(value), name)))


def check_matrix(matrix: DataFrame, tx: DataFrame, rows: list[dict]) -> None:
    """AS2, AS3: the transactions of tx, once each; the columns of the manifest; no null where none may be; nothing infinite."""
    columns = [d["column"] for d in rows]
    if matrix.columns != [*PASSTHROUGH, *columns]:
        raise AssertionError("columns differ from the manifest")
    if not matrix.select("tx_id").exceptAll(tx.select("tx_id")).isEmpty() or not tx.select("tx_id").exceptAll(matrix.select("tx_id")).isEmpty():
        raise AssertionError("the set of transactions changed")
    rates = {r["column"]: r for r in null_rates(matrix, columns).collect()}
    wrong = [d["column"] for d in rows if d["nulls"] == "never" and rates[d["column"]]["null_rate"] or rates[d["column"]]["n_infinite"]]
    if wrong:
        raise AssertionError(f"nulls or infinite values in {wrong}")


# Names of the account-state columns, which come once for each end of a transaction.
STATE = [
    "tx_count_in", "tx_count_out", "volume_in", "volume_out", "inout_volume_ratio", "secs_since_last_in", "secs_since_last_out", "turnover_latency", "distinct_counterparties_in",
    "distinct_counterparties_out", "unique_currencies_seen", "unique_formats_seen", "mean_amount_in", "mean_amount_out", "amount_zscore_vs_own_history", "account_age_secs",
]
#: Null until an account has been seen, or seen on that side.
COLD = ["inout_volume_ratio", "secs_since_last_in", "secs_since_last_out", "turnover_latency", "mean_amount_in", "mean_amount_out", "amount_zscore_vs_own_history"]


def both_ends(names: list[str]) -> list[str]:
    return [f"{end}_{n}" for n in names for end in feats.ENDS]


def structural_block(rounds: int | None = None, partition: Callable[[Job], DataFrame] | None = None) -> Block:
    """rounds: of PageRank, None: until it converges. partition: the communities, Louvain's if None."""
    partition = partition or (lambda job: communities(job.edges, job.config["seed"]))
    columns = declared([*both_ends(feats.STRUCTURE), "same_community"], "snapshot", "dormant")
    schema = StructType([*columns, *declared(["is_cold_start"], "row")])
    return Block(schema, lambda job: feats.structural(job.tx, job.edges, job.n_nodes, partition(job), rounds), snapshots=True)


BLOCKS.add("tabular", Block(declared(feats.ROW_LOCAL, "row", but={"amount_mismatch_ratio": "guarded"}), own=feats.tabular))
BLOCKS.add("streaming", Block(declared(both_ends(STATE), "state", but=dict.fromkeys(both_ends(COLD), "cold_start")), lambda job: feats.account_state(job.tx, job.config["features"]["max_tracked_counterparties"])))
BLOCKS.add("structural", structural_block())
BLOCKS.add("motif", Block(declared([*both_ends(feats.MOTIFS), "common_neighbours"], "snapshot", "dormant"), lambda job: feats.motifs(job.tx, job.edges), snapshots=True))
