"""Mixing sources to target weights: capped water-filling, and seeded whole and fractional repetitions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import SPACE, apart, hot_join, scratch, table, together

#: Sources whose plan is broadcast whole (some 100 bytes each); with more of them only hot ones are.
MOST_BROADCAST = 200_000
BLANK = (" ", "\t", "\n", "\x0b", "\x0c", "\r")


def word_count(text: Column) -> Column:
    """How many words a text has (long); null: 0. Splitting leaves an empty end where the text starts or ends blank."""
    t = F.coalesce(text, F.lit(""))
    head = F.when((t == "") | F.left(t, F.lit(1)).isin(*BLANK), 1).otherwise(0)
    tail = F.when(F.right(t, F.lit(1)).isin(*BLANK), 1).otherwise(0)
    return (F.size(F.split(t, SPACE)) - head - tail).cast("long")


def source_key(source: Column) -> Column:
    """A source as a join key that a null has too."""
    return F.when(source.isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), source))


def dealt(doc_id: Column, seed: int) -> Column:
    """A document's place in the seeded order of its source: 32 hexadecimal digits."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null"))))


def water_filled(sources: DataFrame, budget: float, most_epochs: float) -> DataFrame:
    """sources (source_size, weight) with `target`: shares by weight of budget times all sizes, none above its cap.

    Each round clamps the sources whose share passes most_epochs times their size and deals what is left to the others
    by weight; the level only rises, so the clamped set only grows and the rounds end. A round is one aggregate over
    one row a source.
    """
    cap = F.col("source_size") * F.lit(float(most_epochs))
    total = float(budget) * (sources.agg(F.sum("source_size")).first()[0] or 0)
    level, clamped = 0.0, None
    while True:
        full = cap < F.col("weight") * F.lit(level)
        used, weight, n = sources.agg(F.sum(F.when(full, cap)), F.sum(F.when(~full, F.col("weight"))), F.count_if(full)).first()
        if n == clamped or not weight:
            break
        level, clamped = (total - (used or 0.0)) / weight, n
    return sources.withColumn("target", F.least(cap, F.col("weight") * F.lit(level)))


def mixture(sizes: DataFrame, weights: Sequence[float] = (5.0, 2.0, 1.0), budget: float = 1.5, most_epochs: float = 2.0, seed: int = 7) -> DataFrame:
    """One row a source: key, source_size, target, whole (repetitions of every document) and cut.

    sizes: (doc_id, source, size). Sources by code point, null last, weigh the given weights in turn. A document is
    taken `whole` times, and once more if its place in the seeded order of its source is up to `cut`: the place whose
    running size comes nearest to what is missing. Places are first summed by their first three digits, so that a source
    of any size is summed in 4096 parts and only its part with the cut is sorted.
    A source without words has target 0 and is taken never; an empty table gives no row. Rows with the same doc_id
    share a place and stand or fall together.
    """
    df = sizes.select(source_key(F.col("source")).alias("key"), "source", F.col("size").cast("long").alias("size"), dealt(F.col("doc_id"), seed).alias("place"))
    parts = df.groupBy("key", F.substring("place", 1, 3).alias("part")).agg(F.first("source").alias("source"), F.sum("size").alias("part_size"))
    parts = scratch(sizes.sparkSession, parts, "mixture-parts")
    sources = parts.groupBy("key").agg(F.first("source").alias("source"), F.sum("part_size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    sources = sources.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (rank % len(weights) + 1).cast("int")))
    sources = scratch(sizes.sparkSession, sources.drop("source"), "mixture-sources")
    filled = water_filled(sources, budget, most_epochs)
    filled = filled.withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    filled = filled.withColumn("missing", F.col("target") - F.col("whole") * F.col("source_size"))
    running = F.sum("part_size").over(Window.partitionBy("key").orderBy("part"))
    at = parts.join(filled.select("key", "missing"), "key").withColumn("before", running - F.col("part_size"))
    at = at.filter("before < missing and before + part_size > missing").select("key", "part", "before", "missing")
    near = df.join(at, (df.key == at.key) & (F.substring(df.place, 1, 3) == at.part)).select(df.key, "place", "size", "part", "before", "missing")
    units = near.groupBy("key", "part", "place", "before", "missing").agg(F.sum("size").alias("size"))
    running = F.sum("size").over(Window.partitionBy("key", "part").orderBy("place")) - F.col("size") + F.col("before")
    taken = units.withColumn("before", running).filter("before + size / 2.0D <= missing").groupBy("key").agg(F.max("place").alias("last"))
    # without a part that holds the cut, the running size meets what is missing at the end of a part
    ends = parts.join(filled.select("key", "missing"), "key").withColumn("after", running_parts()).filter("after <= missing")
    ends = ends.groupBy("key").agg(F.max("part").alias("last_part"))
    out = filled.join(taken, "key", "left").join(at.select("key", "part"), "key", "left").join(ends, "key", "left")
    cut = F.coalesce("last", "part", F.concat("last_part", F.lit("g")), F.lit(""))
    return scratch(sizes.sparkSession, out.select("key", "source_size", "target", "whole", cut.alias("cut")), "mixture")


def running_parts() -> Column:
    return F.sum("part_size").over(Window.partitionBy("key").orderBy("part"))


def with_copies(docs: DataFrame, plan: DataFrame, doc_id: str, source: str, seed: int = 7) -> DataFrame:
    """docs with source_size, target and `copies`, how many times the mix takes the document; they replace columns of
    those names, and of whole, cut and _key."""
    plan = plan.withColumnRenamed("key", "_key")
    df = docs.drop("source_size", "target", "copies", "whole", "cut").withColumn("_key", source_key(F.col(source)))
    # documents don't travel for a plan of one row a source
    out = df.join(F.broadcast(plan), "_key") if plan.count() <= MOST_BROADCAST else hot_join(df, plan, "_key", "source_size", "inner")
    out = out.withColumn("copies", F.col("whole") + (dealt(F.col(doc_id), seed) <= F.col("cut")).cast("long"))
    return out.drop("_key", "whole", "cut")


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    sizes = scratch(spark, docs.select("doc_id", "source", word_count(F.col("text")).alias("size")), "mixing-sizes")
    out = with_copies(sizes, mixture(sizes), "doc_id", "source")
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as the mix takes it."""
    sizes = scratch(spark, docs.select("doc_id", "source", word_count(F.col("text")).alias("size")), "mixing-sizes")
    out = with_copies(apart(docs, "doc_id", "source"), mixture(sizes), "doc_id", "source").filter("copies > 0")
    out = out.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return together(out, docs, "doc_id", "source")


OP7_SQL = """
WITH d AS (
  SELECT doc_id, source, md5('7:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS place,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size
  FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight
  FROM d GROUP BY source
), o AS (
  SELECT *, source_size * 2.0::DOUBLE AS cap, 1.5::DOUBLE * sum(source_size) OVER () AS total,
         row_number() OVER (ORDER BY source_size * 2.0::DOUBLE / weight, source NULLS LAST) AS k
  FROM s
), p AS (
  SELECT *, coalesce(sum(cap) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE) AS used,
         sum(weight) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS free
  FROM o
), l AS (
  SELECT (total - used) / free AS level FROM p WHERE cap >= weight * ((total - used) / free) ORDER BY k LIMIT 1
), t AS (
  SELECT s.source, source_size, least(source_size * 2.0::DOUBLE, weight * level) AS target FROM s, l
), w AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole FROM t
), u AS (
  SELECT source, place, sum(size) AS unit, sum(sum(size)) OVER (PARTITION BY source ORDER BY place) - sum(size) AS before FROM d GROUP BY source, place
)
SELECT d.doc_id, d.size, w.source_size, w.target,
       CAST(d.size * (w.whole + CASE WHEN u.before + u.unit / 2.0::DOUBLE <= w.target - w.whole * w.source_size THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM d JOIN w ON d.source IS NOT DISTINCT FROM w.source JOIN u ON d.source IS NOT DISTINCT FROM u.source AND d.place = u.place
"""
