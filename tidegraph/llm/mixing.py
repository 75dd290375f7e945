"""Mixing sources to target weights by Efraimidis-Spirakis sampling, with DataFrame functions only.

Every document gets the key -ln(u) / quality weight, where u is a keyed hash of its id; sorted by it, the documents of a
source are a weighted sample without replacement of any length. A source's target fills complete epochs first; of what is
left, documents are taken in the order of their keys as far as the prefix sum of words goes (a document is taken where
over half of it fits, so a source ends within half a document of its target).

The prefix sum has three levels, so that a source with a third of all rows is not one task: keys fall into buckets of about
``per_bucket`` documents, and buckets onto shelves, about as many as buckets on each. Sums are added up over the shelves of a source,
over the buckets of a shelf, and within a bucket: no task has more than the square root of a source's buckets. Sources are one row each. Nothing is
broadcast but what Spark itself finds small.

Null text has size 0; a null source is a source, the last one; a null id hashes as the word null; a document without a
quality gets weight 1. Rows that are alike tie, and which of them is taken last makes no difference to the result. An empty
table gives an empty result. Columns of the input other than those named are kept by ``mixed()`` and never read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidegraph.llm.common import word_count, written

MAX_EPOCHS = 3
#: Quality 1, 0 and unknown. Within (LEAST, 4 * LEAST], so that buckets of keys are even to a factor of 4.
WEIGHTS = {1: 2.0, 0: 0.5}
LEAST = 0.5


def uniform(doc_id: Column, seed: int) -> Column:
    """A number within (0, 1) by the MD5 of seed and id."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null"))).cast("binary"))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(1 << 52))


def source_targets(sizes: DataFrame, per_bucket: int) -> DataFrame:
    """source, source_size, target, buckets of each source. sizes: source, size, a row a document."""
    everything = W.partitionBy()
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    named = by_source.withColumn("weight", ((F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1) % 3 + 1).cast("double"))
    # Those whose limit is low for their weight stop first; level: what a weight of 1 gets once all before have stopped.
    before = W.orderBy((F.col("source_size") / F.col("weight")), F.col("source").asc_nulls_last()).rowsBetween(W.unboundedPreceding, -1)
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum(MAX_EPOCHS * F.col("source_size")).over(before), F.lit(0))
    shared = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    level = F.max("level").over(everything)  # it rises while sources stop, then falls
    return (
        named.withColumn("level", left / shared)
        .withColumn("target", F.least(F.lit(float(MAX_EPOCHS)) * F.col("source_size"), level * F.col("weight")))
        .select("source", "source_size", "target", F.ceil(F.col("n_docs") / per_bucket).alias("buckets"))
    )


def mix(docs: DataFrame, quality: DataFrame | None = None, seed: int = 42, per_bucket: int = 200, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """doc_id, size, source_size, target, taken of each row of docs. quality: doc_id, quality (the largest counts)."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), word_count(F.col(text)).alias("size"))
    return _taken(rows, quality, seed, per_bucket).select("doc_id", "size", "source_size", "target", "taken")


def mixed(docs: DataFrame, quality: DataFrame | None = None, seed: int = 42, per_bucket: int = 200, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The rows of docs that the mix takes, with size, taken and copies (a column of docs that has one of these names stays instead); a document without words has a copy for each complete epoch."""
    rid = "__rid"
    while rid in docs.columns:
        rid += "_"
    held = written(docs.withColumn(rid, F.monotonically_increasing_id()))
    rows = held.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), word_count(F.col(text)).alias("size"), F.col(rid).alias("row"))
    taken = _taken(rows, quality, seed, per_bucket).where("copies > 0").select(F.col("row").alias(rid), "size", "taken", "copies")
    new = [c for c in ("size", "taken", "copies") if c not in docs.columns]
    return held.join(taken.select(rid, *new), rid).select(*docs.columns, *new)


def _taken(rows: DataFrame, quality: DataFrame | None, seed: int, per_bucket: int) -> DataFrame:
    """rows (doc_id, source, size, ...) and source_size, target, taken, copies."""
    if quality is not None:
        best = quality.groupBy(F.col("doc_id").alias("of")).agg(F.max("quality").alias("quality"))
        rows = rows.join(best, F.col("doc_id") == F.col("of"), "left").drop("of")
        weight = F.coalesce(*(F.when(F.col("quality") == q, F.lit(w)) for q, w in WEIGHTS.items()), F.lit(1.0))
    else:
        weight = F.lit(1.0)
    sizes = written(rows.withColumn("key", -F.log(uniform(F.col("doc_id"), seed)) / weight).drop("quality"))
    targets = written(source_targets(sizes, per_bucket).coalesce(1))
    keyed = sizes.alias("d").join(targets.alias("t"), F.col("d.source").eqNullSafe(F.col("t.source"))).select("d.*", "source_size", "target", "buckets")
    keyed = keyed.withColumn("bucket", F.floor(F.col("buckets") * (1 - F.exp(-LEAST * F.col("key")))))
    sums = keyed.groupBy("source", "bucket", F.floor(F.col("bucket") / F.ceil(F.sqrt("buckets"))).alias("shelf")).agg(F.sum("size").alias("words"))
    before_in = lambda *key: W.partitionBy(*key[:-1]).orderBy(key[-1]).rowsBetween(W.unboundedPreceding, -1)
    earlier = lambda window: F.coalesce(F.sum("words").over(window), F.lit(0))
    shelves = sums.groupBy("source", "shelf").agg(F.sum("words").alias("words")).select("source", "shelf", earlier(before_in("source", "shelf")).alias("under"))
    on_shelf = sums.select("source", "shelf", "bucket", earlier(before_in("source", "shelf", "bucket")).alias("beside"))
    below = on_shelf.alias("o").join(shelves.alias("s"), F.col("o.source").eqNullSafe(F.col("s.source")) & (F.col("o.shelf") == F.col("s.shelf"))).select("o.source", "bucket", (F.col("under") + F.col("beside")).alias("below"))
    near = W.partitionBy("source", "bucket").orderBy("key", "doc_id", "size").rowsBetween(W.unboundedPreceding, -1)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    rest = F.when(F.col("epochs") < MAX_EPOCHS, F.col("target") - F.col("epochs") * F.col("source_size")).otherwise(0.0)
    placed = (
        keyed.alias("k")
        .join(below.alias("b"), F.col("k.source").eqNullSafe(F.col("b.source")) & (F.col("k.bucket") == F.col("b.bucket")))
        .select("k.*", "below")
        .withColumn("before", F.col("below") + F.coalesce(F.sum("size").over(near), F.lit(0)))
        .withColumn("epochs", epochs)
    )
    copies = F.col("epochs") + (2 * F.col("before") + F.col("size") <= 2 * rest).cast("long")
    return placed.withColumn("copies", copies.cast("long")).withColumn("taken", (F.col("size") * F.col("copies")).cast("long"))


ORACLE = r"""
WITH q AS (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY doc_id),
d AS (
  SELECT d.doc_id, d.source, coalesce(len(regexp_extract_all(d.text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
    -ln((('0x' || substr(md5('42:' || coalesce(d.doc_id::VARCHAR, 'null')), 1, 13))::UBIGINT::DOUBLE + 0.5) / 4503599627370496.0)
      / CASE q.quality WHEN 1 THEN 2.0 WHEN 0 THEN 0.5 ELSE 1.0 END AS key
  FROM documents d LEFT JOIN q ON d.doc_id = q.doc_id),
s AS (SELECT source, sum(size)::BIGINT AS source_size, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::DOUBLE AS weight FROM d GROUP BY source),
l AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER b, 0))::DOUBLE / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0)) AS level
  FROM s WINDOW b AS (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT source, source_size, least(3.0 * source_size, max(level) OVER () * weight) AS target FROM l),
p AS (
  SELECT d.doc_id, d.size, t.source_size, t.target,
    CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size) ELSE 0 END AS epochs,
    coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
  (size * (epochs + CASE WHEN 2 * before + size <= 2 * CASE WHEN epochs < 3 THEN target - epochs * source_size ELSE 0 END THEN 1 ELSE 0 END))::BIGINT AS taken
FROM p
"""
