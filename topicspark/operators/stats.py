"""Quality statistics: latencies, failure rates and completeness, per topic."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topicspark.operators.ordered import running


def latencies(timing: DataFrame, budget_ms: int = 90_000) -> DataFrame:
    """A4, A5: nearest-rank percentiles of successful calls (none: 0), failure rate, and whether p90 is over budget."""
    good = F.expr("CASE WHEN outcome = 'success' THEN ms END")
    p = lambda q: F.coalesce(F.expr(f"percentile_disc({q}) WITHIN GROUP (ORDER BY CASE WHEN outcome = 'success' THEN ms END)"), F.lit(0)).cast("long")
    df = timing.groupBy("topic").agg(p(0.5).alias("p50"), p(0.9).alias("p90"), p(0.99).alias("p99"), F.count("*").alias("calls"), F.count(good).alias("good"))
    rate = F.when(F.col("calls") > 0, (F.col("calls") - F.col("good")) / F.col("calls")).otherwise(0.0)
    return df.withColumn("failure_rate", rate).withColumn("over_budget", F.col("p90") > budget_ms).drop("good")


def latency_histogram(timing: DataFrame) -> DataFrame:
    """(topic, ms, n): how many successful calls took ms; a null ms has all other calls."""
    return timing.groupBy("topic", F.when(F.col("outcome") == "success", F.col("ms")).alias("ms")).agg(F.count("*").alias("n"))


def histogram_latencies(histogram: DataFrame, budget_ms: int = 90_000) -> DataFrame:
    """A4, A5 from histograms (latency_histogram's, or sums of them): the same as latencies of the calls themselves.

    The nearest rank of p is the first value up to which p hundredths of the calls lie, found along running sums of the
    counts, which a hot topic has spread over many tasks (ordered.py).
    """
    total = histogram.groupBy("topic").agg(F.sum("n").alias("calls"), F.coalesce(F.sum(F.when(F.col("ms").isNotNull(), F.col("n"))), F.lit(0)).alias("good"))
    along = running(histogram.filter("ms IS NOT NULL"), ["topic"], ["ms"], {"upto": ("sum", F.col("n"))}).join(total, "topic")
    at = lambda p: F.min(F.when(F.col("upto") * 100 >= p * F.col("good"), F.col("ms"))).alias(f"p{p}")
    df = total.join(along.groupBy("topic").agg(at(50), at(90), at(99)), "topic", "left")
    df = df.withColumns({f"p{p}": F.coalesce(f"p{p}", F.lit(0)).cast("long") for p in (50, 90, 99)})
    rate = F.when(F.col("calls") > 0, (F.col("calls") - F.col("good")) / F.col("calls")).otherwise(0.0)
    return df.select("topic", "p50", "p90", "p99", "calls", rate.alias("failure_rate"), (F.col("p90") > budget_ms).alias("over_budget"))


def of_topics(rows: DataFrame, topics: DataFrame) -> DataFrame:
    """The rows of a set of topics."""
    return rows.join(topics.select("topic").distinct(), "topic", "left_semi")


def completeness(topics: DataFrame, facts: DataFrame, scores: DataFrame, timing: DataFrame) -> DataFrame:
    """has_timing, has_extract (a fact), has_score (a score table), has_validate (any visited topic)."""
    df = topics.select("topic")
    for name, rows in (("has_timing", timing), ("has_extract", facts), ("has_score", scores)):
        df = df.join(rows.select("topic").distinct().withColumn(name, F.lit(True)), "topic", "left")
    return df.select("topic", *[F.coalesce(c, F.lit(False)).alias(c) for c in ("has_timing", "has_extract", "has_score")], F.lit(True).alias("has_validate"))


# The kinds of issues that a report counts, zero or not.
ISSUES = ["schema_error", "lineage_error", "hand_edited", "mock_source"]


def issue_counts(issues: DataFrame) -> DataFrame:
    """(topic, one count a kind)."""
    return issues.groupBy("topic").agg(*[F.count_if(F.col("type") == k).alias(k) for k in ISSUES])
