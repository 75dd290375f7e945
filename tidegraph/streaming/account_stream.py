"""Structured Streaming: account state per node before each event, and windowed snapshot edges."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import astuple, dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidegraph.functions.scalars import cents
from tidegraph.operators.features import COUNTERPARTY_CAP, account_events, lagged
from tidegraph.sources.shared import shared_folder

STATE = """last_id long, tx_count_in long, tx_count_out long, cents_in long, cents_out long, last_in long, last_out long, turnover long, first_secs long, squares double,
    others_in array<long>, others_out array<long>, currencies array<string>, formats array<string>"""
OUT = """tx_id long, dir string, node long, tx_count_in long, tx_count_out long, volume_in double, volume_out double, inout_volume_ratio double, secs_since_last_in long, secs_since_last_out long,
    turnover_latency long, distinct_counterparties_in long, distinct_counterparties_out long, unique_currencies_seen long, unique_formats_seen long, mean_amount_in double, mean_amount_out double,
    amount_zscore_vs_own_history double, account_age_secs long"""
COLUMNS = [c.split()[0] for c in OUT.split(",")]
NULLABLE = ["secs_since_last_in", "secs_since_last_out", "turnover_latency"]


@dataclass
class Registers:
    """What is kept of an account; the fields of STATE."""

    last_id: int = -1
    tx_count_in: int = 0
    tx_count_out: int = 0
    cents_in: int = 0
    cents_out: int = 0
    last_in: int | None = None
    last_out: int | None = None
    turnover: int | None = None
    first_secs: int | None = None
    squares: float = 0.0
    others_in: list = field(default_factory=list)
    others_out: list = field(default_factory=list)
    currencies: list = field(default_factory=list)
    formats: list = field(default_factory=list)

    def row(self, now: int, amount: float) -> tuple:
        """The 16 quantities before an event."""
        n, total = self.tx_count_in + self.tx_count_out, (self.cents_in + self.cents_out) / 100
        volume_in, volume_out = self.cents_in / 100, self.cents_out / 100
        since = lambda then: None if then is None else now - then
        zscore = None
        if n >= 2:
            variance = self.squares / n - (total / n) * (total / n)
            zscore = 0.0 if variance <= 1e-12 else (amount - total / n) / variance**0.5
        return (
            self.tx_count_in, self.tx_count_out, volume_in, volume_out, volume_in / volume_out if self.cents_out else None, since(self.last_in), since(self.last_out), self.turnover,
            len(self.others_in), len(self.others_out), len(self.currencies), len(self.formats), volume_in / self.tx_count_in if self.tx_count_in else None,
            volume_out / self.tx_count_out if self.tx_count_out else None, zscore, since(self.first_secs) or 0,
        )

    def take(self, e, gap: int | None, cap: int) -> None:
        out = e.dir == "out"
        others = self.others_out if out else self.others_in
        for seen, value, most in ((others, e.other, cap), (self.currencies, e.currency, cap), (self.formats, e.payment_format, cap)):
            if value not in seen and len(seen) < most:
                seen.append(value)
        if out:
            self.tx_count_out, self.cents_out, self.last_out = self.tx_count_out + 1, self.cents_out + int(e.cents), int(e.secs)
            self.turnover = self.turnover if gap is None else gap
        else:
            self.tx_count_in, self.cents_in, self.last_in = self.tx_count_in + 1, self.cents_in + int(e.cents), int(e.secs)
        self.squares += e.amount * e.amount
        self.first_secs = int(e.secs) if self.first_secs is None else self.first_secs


def stream_account_state(tx: DataFrame, cap: int = COUNTERPARTY_CAP) -> DataFrame:
    """The 16 quantities of every account, emitted as they were before each event and then advanced. tx: a stream with the canonical columns.
    Within a batch the events of a node are put in order of tx_id; one that is not later than what the node has seen is an error, not folded in. Both events of a
    self-loop read before either advances."""

    def advance(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        r = Registers(*(list(v) if isinstance(v, list | tuple | np.ndarray) else v for v in state.get)) if state.exists else Registers()
        rows, made = pd.concat(list(frames)).sort_values(["tx_id", "dir"]), []
        for tx_id, events in rows.groupby("tx_id", sort=True):
            if tx_id <= r.last_id:
                raise ValueError(f"transaction {tx_id} of node {key[0]} comes after {r.last_id}")
            both = list(events.itertuples(index=False))
            gap = None if r.last_in is None else int(both[0].secs) - r.last_in
            made += [(tx_id, e.dir, key[0], *r.row(int(e.secs), e.amount)) for e in both]
            for e in both:
                r.take(e, gap, cap)
            r.last_id = int(tx_id)
        state.update(astuple(r))
        yield pd.DataFrame(made, columns=COLUMNS).astype(dict.fromkeys(NULLABLE, "Int64"))

    events = account_events(tx).select("node", "tx_id", "dir", "other", "secs", "amount", "currency", "payment_format", cents(F.col("amount")).alias("cents"))
    return events.groupBy("node").applyInPandasWithState(advance, OUT, STATE, "append", GroupStateTimeout.NoTimeout)


def stream_lagged(tx: DataFrame, stats: DataFrame, columns: list[str]) -> DataFrame:
    """Transactions of a stream with what their ends were in the snapshot of the day before: a stream joined with a table, null where an end was dormant."""
    return lagged(tx, stats, columns)


def stream_totals(tx: DataFrame) -> DataFrame:
    """Cumulative edges: of each ordered pair all that has come so far, to be written in complete mode."""
    rows = tx.where(~F.col("is_self_loop"))
    return rows.groupBy(F.col("src_node").alias("src"), F.col("dst_node").alias("dst")).agg((F.sum(cents(F.col("amount_paid"))) / 100).alias("w_amount"), F.count("*").alias("tx_count"), F.max("secs").alias("last_ts"))


def run_available(stream: DataFrame, mode: str = "append") -> DataFrame:
    """All that the source has now, run through the stream into a table of the shared folder. mode: append, or complete, where the last batch replaces the rest."""
    folder = f"{shared_folder(stream.sparkSession)}/stream-{uuid.uuid4().hex}"
    keep = "overwrite" if mode == "complete" else "append"
    query = stream.writeStream.foreachBatch(lambda batch, _: batch.write.mode(keep).parquet(f"{folder}/table")).option("checkpointLocation", f"{folder}/state").outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    if query.exception():
        raise query.exception()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/table")


def stream_windows(tx: DataFrame, lookback_days: int = 1, delay: str = "1 day") -> DataFrame:
    """Edges of tumbling (1 day) or sliding windows of days over event time; rows later than the watermark are dropped by Spark."""
    timed = tx.withColumn("at", F.col("ts").cast("timestamp")).where(~F.col("is_self_loop")).withWatermark("at", delay)
    span = F.window("at", f"{lookback_days} days", "1 day")
    edges = timed.groupBy(span.alias("w"), F.col("src_node").alias("src"), F.col("dst_node").alias("dst")).agg(
        (F.sum(cents(F.col("amount_paid"))) / 100).alias("w_amount"), F.count("*").alias("tx_count"), F.max("secs").alias("last_ts")
    )
    return edges.select(F.col("w.end").alias("window_end"), "src", "dst", "w_amount", "tx_count", "last_ts")


def stream_sessions(tx: DataFrame, gap: str = "2 hours", delay: str = "1 day") -> DataFrame:
    """Sessions of each sending account: spans of activity without a gap."""
    timed = tx.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", delay)
    s = timed.groupBy(F.session_window("at", gap).alias("w"), "src_node").agg(F.count("*").alias("tx_count"), (F.sum(cents(F.col("amount_paid"))) / 100).alias("amount"))
    return s.select("src_node", F.unix_timestamp("w.start").alias("first_secs"), F.unix_timestamp("w.end").alias("end_secs"), "tx_count", "amount")
