"""Raw transaction CSV, annotated block files, and the stage store of Parquet and JSON artifacts."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidegraph.operators.ordering import with_position
from tidegraph.sources.views import FAMILIES, day_index

# The header of the raw file, by position (two columns are called Account), and names and types given to it.
RAW_HEADER = ["Timestamp", "From Bank", "Account", "To Bank", "Account", "Amount Received", "Receiving Currency", "Amount Paid", "Payment Currency", "Payment Format", "Is Laundering"]
RAW_SCHEMA = "timestamp string, src_bank string, src_acct string, dst_bank string, dst_acct string, amount_received double, currency_received string, amount_paid double, currency_paid string, payment_format string, label tinyint"
TIME_FORMAT = "yyyy/MM/dd HH:mm"
# How blocks of annotated rows begin and end.
BEGIN, END = "BEGIN LAUNDERING ATTEMPT", "END LAUNDERING ATTEMPT"
BLOCK_FIELDS = 11


def read_transactions(spark: SparkSession, path: str, origin: str) -> DataFrame:
    """SRC1: the raw file with tx_id, its position in time, ties in the order of the file. Another header, and a time that doesn't parse, are errors."""
    header = spark.read.text(path).limit(1).collect()
    found = header[0][0].strip().split(",") if header else []
    if found != RAW_HEADER:
        raise ValueError(f"header {found}; expected {RAW_HEADER}")
    rows = spark.read.schema(RAW_SCHEMA).option("header", True).option("enforceSchema", True).option("mode", "FAILFAST").csv(path)
    rows = rows.withColumn("ts", F.to_timestamp_ntz("timestamp", F.lit(TIME_FORMAT))).drop("timestamp").withColumn("secs", F.unix_timestamp("ts"))
    placed = with_position(rows.withColumn("place", F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id())), ["ts", "place"], "tx_id")
    return placed.drop("place").withColumn("day_idx", day_index(F.col("ts"), origin))


def parse_header(line):
    """SRC3: family and first whole number of a BEGIN line: struct(family, param). An unknown family is an error."""
    rest = F.split(line, " - ", 2)[1]
    name = F.upper(F.trim(F.split(rest, ":", 2)[0]))
    number = F.regexp_extract(F.coalesce(F.get(F.split(rest, ":", 2), F.lit(1)), F.lit("")), r"(\d+)", 1)
    checked = F.when(name.isin(FAMILIES), name).otherwise(F.raise_error(F.concat(F.lit("unknown family: "), F.coalesce(name, F.lit("")))))
    return F.struct(checked.alias("typology"), F.when(number != "", number.cast("short")).alias("typology_param"))


def read_blocks(spark: SparkSession, path: str) -> DataFrame:
    """SRC2: a row for each transaction between BEGIN and END, with attempt_id (by block) and its header's family and number. A block within
    a block, an END without a BEGIN or of another family, a row outside, a row of other than 11 fields, an open block at the end and a
    row that isn't labelled 1 are errors. The file is one annotation list: its lines are put in order in one task."""
    lines = spark.read.text(path).where(F.trim("value") != "").withColumn("n", F.monotonically_increasing_id())
    order = W.orderBy("n")
    begins, ends = F.col("value").startswith(BEGIN), F.col("value").startswith(END)
    marked = lines.withColumn("kind", F.when(begins, 1).when(ends, -1).otherwise(0))
    marked = marked.withColumn("depth", F.sum("kind").over(order)).withColumn("attempt_id", F.sum(begins.cast("int")).over(order) - 1)
    marked = marked.withColumn("header", F.last(F.when(begins, F.col("value")), ignorenulls=True).over(order)).withColumn("last", F.lead("n").over(order).isNull())
    family = lambda c: F.upper(F.trim(F.split(F.split(c, " - ", 2)[1], ":", 2)[0]))
    fields = F.split(F.col("value"), ",")
    problem = (
        F.when(F.col("depth") > 1, "a block begins within a block").when(F.col("depth") < 0, "an END without a BEGIN").when((F.col("kind") == 0) & (F.col("depth") != 1), "a row outside a block")
        .when((F.col("kind") == -1) & (family(F.col("value")) != family(F.col("header"))), "an END of another family").when((F.col("kind") == 0) & (F.size(fields) != BLOCK_FIELDS), "a row of other than 11 fields")
        .when((F.col("kind") == 0) & (F.trim(F.element_at(fields, -1)) != "1"), "a row that isn't labelled 1").when(F.col("last") & (F.col("depth") != 0), "a block that doesn't end")
    )
    first = marked.withColumn("problem", problem).where("problem IS NOT NULL").orderBy("n").select("problem", "value").limit(1).collect()
    if first:
        raise ValueError(f"{first[0]['problem']}: {first[0]['value']}")
    rows = marked.where("kind = 0").withColumn("h", parse_header(F.col("header"))).withColumn("f", fields)
    names = [x.split()[0] for x in RAW_SCHEMA.split(", ")]
    typed = [F.trim(F.col("f")[i]).cast("double" if n.startswith("amount") else "tinyint" if n == "label" else "string").alias(n) for i, n in enumerate(names)]
    return rows.select(F.row_number().over(order).alias("pattern_row"), "attempt_id", "h.*", *typed).withColumn("ts", F.to_timestamp_ntz("timestamp", F.lit(TIME_FORMAT))).drop("timestamp")


class StageStore:
    """Artifacts of one stage under root/stage/key, in any file system that Spark reads. key covers configuration and code version."""

    def __init__(self, spark: SparkSession, root: str, stage: str, key: str) -> None:
        self.spark, self.folder, self.stage = spark, f"{root}/{stage}/{key}", stage

    def _path(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def exists(self, name: str) -> bool:
        path, fs = self._path(name)
        return fs.exists(path)

    def has(self, name: str) -> bool:
        path, fs = self._path(f"{name}/_SUCCESS")
        return fs.exists(path)

    def write_frame(self, name: str, df: DataFrame, partition_by: list[str] | None = None) -> None:
        """SNK1: Parquet, published as a whole by the output committer."""
        df.write.mode("overwrite").option("compression", "snappy").parquet(f"{self.folder}/{name}", partitionBy=partition_by)

    def read_frame(self, name: str, columns: list[str] | None = None) -> DataFrame:
        """SRC4: columns of an artifact; a missing one is an error that names the stage to run."""
        if not self.has(name):
            raise FileNotFoundError(f"{name} is missing: run stage {self.stage} first ({self.folder})")
        df = self.spark.read.parquet(f"{self.folder}/{name}")
        return df.select(*columns) if columns else df

    def write_json(self, name: str, value: object) -> None:
        """SNK2: sorted keys, indented."""
        path, fs = self._path(name)
        out = fs.create(path, True)
        try:
            out.write(bytearray(json.dumps(value, sort_keys=True, indent=2, default=str).encode()))
        finally:
            out.close()

    def read_json(self, name: str) -> object:
        """SRC5."""
        return json.loads("\n".join(r[0] for r in self.spark.read.option("wholetext", True).text(f"{self.folder}/{name}").collect()))

    def cached_frame(self, name: str, build: Callable[[], DataFrame], force: bool = False) -> DataFrame:
        """CACHE2: the artifact, built only where it is missing."""
        if force or not self.has(name):
            self.write_frame(name, build())
        return self.read_frame(name)
