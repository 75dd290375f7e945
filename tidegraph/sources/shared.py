"""The folder that driver and executors share, tables without lineage in it, and the package itself on the executors."""

from __future__ import annotations

import atexit
import gc
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or a folder of our own where it is unset and Spark runs in this process alone (tests); on a cluster that is an error."""
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not folder:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='tidegraph-')}"
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(folder)
    return folder


_made: list[str] = []


def written(df: DataFrame, codec: str = "zstd", files: int | None = None) -> DataFrame:
    """The same rows as a Parquet table in the shared folder: no lineage, a size the planner knows. Goes as the application ends.

    files: at most so many, for tables of few rows after shuffles of many partitions. On a local file system Hadoop starts three processes
    for each file, and an executor's memory counts twice while it does.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/tidegraph-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    (df.coalesce(files) if files else df).write.option("compression", codec).parquet(path)
    _made.append(path)
    atexit.register(_remove, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def tables_made() -> int:
    """How many tables written() has made: a mark for tables_since()."""
    return len(_made)


def tables_since(mark: int) -> list[str]:
    return _made[mark:]


def release(spark: SparkSession, paths: list[str]) -> None:
    """Deletes tables of written() that nothing reads any more, and lets Spark find the shuffle files and broadcasts of plans that are gone."""
    for path in paths:
        _remove(spark, path)
    if paths:
        collect_garbage(spark)


def collect_garbage(spark: SparkSession) -> None:
    """Between rounds: Spark deletes shuffle files and broadcasts only of plans that Python and then the driver have collected; the driver's heap shrinks, too."""
    gc.collect()
    spark._jvm.System.gc()


def shrink_executors(spark: SparkSession) -> None:
    """Lets every executor collect its garbage, after which its heap shrinks: the pages of many small sorts make it grow to its limit, and it stays there."""
    sc = spark.sparkContext
    if sc.master != "local" and not sc.master.startswith("local["):
        n = sc.defaultParallelism
        spark.range(0, n, 1, n).select(F.java_method(F.lit("java.lang.System"), F.lit("gc"))).collect()


def drop_written(df: DataFrame) -> None:
    """Deletes the files of a table that written() made and nothing reads any more."""
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        _remove(df.sparkSession, path)


def _remove(spark: SparkSession, path: str) -> None:
    try:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the session has ended: its folder goes with it
        return


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once an application, so that they need not have it installed."""
    sc = spark.sparkContext
    if sc.applicationId not in _shipped:
        package = Path(__file__).resolve().parents[1]
        archive = Path(tempfile.mkdtemp(prefix="tidegraph-")) / f"{package.name}.zip"
        with zipfile.ZipFile(archive, "w") as out:
            for source in sorted(package.rglob("*.py")):
                out.write(source, source.relative_to(package.parent))
        sc.addPyFile(str(archive))
        _shipped.add(sc.applicationId)
