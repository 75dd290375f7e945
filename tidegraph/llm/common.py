"""What the text operators share: reading tables, byte-wise words, and the shared folder of the engine."""

from __future__ import annotations

import ctypes

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegraph.sources.shared import collect_garbage, drop_written, shared_folder, ship, shrink_executors, written

__all__ = ["collect_garbage", "drop_written", "shared_folder", "ship", "shrink_executors", "written"]

#: Maps A-Z to a-z and leaves every other byte of a UTF-8 text alone.
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
#: As LOWER, and every ASCII byte that is neither a digit nor a letter becomes a space.
LOWER_ALNUM = bytes(c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(spark: SparkSession, most: str = "4m") -> None:
    """Texts go to Python in batches of so many bytes, not of 64 MB, each of which every worker holds twice; unless the session says otherwise."""
    if _BATCH not in spark.conf.getAll:
        spark.conf.set(_BATCH, most)


def give_back() -> None:
    """Returns what a worker has freed to the system: it waits for the next task, beside other workers of the same executor."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError, TypeError):  # not glibc
        return


def word_count(text: Column) -> Column:
    """Number of words between white space (U+0020, U+0009 to U+000D); 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def text_bytes(text: str | None) -> bytes:
    return b"" if text is None else text.encode("utf-8", "surrogatepass")
