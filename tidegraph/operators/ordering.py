"""Positions in a total order without one task that holds every row.

Rows are dealt to tasks by ranges of the order, sorted there, and numbered; a task's first number is the sum of the sizes
of the ranges before it, of which the driver holds one count a task.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegraph.sources.shared import written


def with_position(df: DataFrame, order: list[str | Column], name: str) -> DataFrame:
    """df and its 0-based position in the order (WIN1); rows that tie are numbered in any order."""
    numbered = written(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id()))
    task = F.shiftright("__at", 33)
    sizes = sorted((r[0], r[1]) for r in numbered.groupBy(task.alias("task")).count().collect())
    if not sizes:
        return numbered.withColumnRenamed("__at", name)
    before = dict(zip((t for t, _ in sizes), accumulate((n for _, n in sizes), initial=0), strict=False))
    offset = F.element_at(F.create_map(*(F.lit(x) for pair in before.items() for x in pair)), task)
    return numbered.withColumn(name, (offset + F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))).cast("long")).drop("__at")
