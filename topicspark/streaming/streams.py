"""Incremental forms: metrics of a growing log, facts new since a topic's last run, and resumable ingestion."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from topicspark import schemas as S
from topicspark.operators import triage as TI
from topicspark.shared import written
from topicspark.sources.versioned import VersionedTable


def metric_stream(spark: SparkSession, folder: str, schema: str = S.TIMING) -> DataFrame:
    """T-S1: calls and failures by topic of a growing JSON-lines log; write it with outputMode complete or update."""
    log = spark.readStream.schema(schema).json(folder)
    return log.groupBy("topic").agg(F.count("*").alias("calls"), F.count_if(F.col("outcome") == "failure").alias("failures"))


def folder(number: int) -> str:
    return f"batch-{number:09d}"


def cursor_table(spark: SparkSession, path: str) -> VersionedTable:
    """The state of new_fact_sink: for each (topic, fact_key) the last run that had it; for each topic (fact_key null) its last
    run and the one before."""
    return VersionedTable(spark, path, "topic string, fact_key string, seen bigint, before bigint", ["topic", "fact_key"])


def new_fact_sink(cursor: str, reports: str, run: str | None = None) -> Callable[[DataFrame, int], None]:
    """T-S2: a foreachBatch that reports the facts (topic, fact_key, ...) that are new in their topic's run: which the topic's
    run before it lacked. A fact that goes and comes back is new again.

    run: a bigint column that tells a topic's runs apart and grows. A run may be spread over many batches: it is judged
    by the topic's whole run before it, each of its facts is reported once, and it becomes the snapshot for the next
    run when a row of that one comes. A row without fact_key only says that the run took place (a topic that has no facts
    any more). Rows of a run that is over are told with `late` and change nothing. Without run each batch is a run.

    A batch writes in proportion to itself: keys' last runs are upserted by (topic, fact_key). The report comes first, and a
    batch that is run again after a crash at any point reads the state before it, and so gives the same report.
    """

    def one(batch: DataFrame, number: int) -> None:
        spark, state = batch.sparkSession, cursor_table(batch.sparkSession, cursor)
        rows = batch.withColumn("_run", F.lit(number).cast("long") if run is None else F.col(run).cast("long"))
        rows = written(rows, "batch")
        known = state.read(number)
        topics = known.filter("fact_key IS NULL").select("topic", F.col("seen").alias("_last"), F.col("before").alias("_before"))
        now = rows.select("topic", "_run").distinct().join(topics, "topic", "left")
        now = now.withColumn("late", F.coalesce(F.col("_run") < F.col("_last"), F.lit(False)))
        runs = now.filter("NOT late").select("topic", F.col("_run").alias("r")).unionByName(now.select("topic", F.explode(F.array("_last", "_before")).alias("r")).filter("r IS NOT NULL")).distinct()
        earlier = now.join(runs, "topic", "left").groupBy("topic", "_run", "late").agg(F.max(F.when(F.col("r") < F.col("_run"), F.col("r"))).alias("_previous"))
        earlier = written(earlier, "runs")
        keyed = rows.filter("fact_key IS NOT NULL").join(earlier, ["topic", "_run"])
        had = keyed.filter("NOT late").select("topic", "fact_key", F.col("_run").alias("_previous")).distinct().withColumn("_had", F.lit(True))
        seen = known.filter("fact_key IS NOT NULL").select("topic", "fact_key", "seen")
        each = keyed.dropDuplicates(["topic", "fact_key", "_run"]).join(had, ["topic", "fact_key", "_previous"], "left").join(seen, ["topic", "fact_key"], "left")
        old = F.coalesce("_had", F.lit(False)) | F.coalesce(F.col("seen").isin(F.col("_previous"), F.col("_run")), F.lit(False))
        each.filter(F.col("late") | ~old).select(*batch.columns, "late").write.mode("overwrite").parquet(f"{reports}/{folder(number)}")
        last = keyed.filter("NOT late").groupBy("topic", "fact_key").agg(F.max("_run").alias("seen")).withColumn("before", F.lit(None).cast("long"))
        two = F.sort_array(F.collect_set("r"), asc=False)
        ends = runs.join(earlier.filter("NOT late").select("topic").distinct(), "topic", "left_semi").groupBy("topic").agg(two.alias("t"))
        ends = ends.select("topic", F.lit(None).cast("string").alias("fact_key"), F.get("t", F.lit(0)).alias("seen"), F.get("t", F.lit(1)).alias("before"))
        state.upsert(last.unionByName(ends), number)
        state.compact()
        state.vacuum(number)

    return one


def manifest_table(spark: SparkSession, path: str) -> VersionedTable:
    return VersionedTable(spark, path, "hash string, status string", ["hash"])


def ingest_sink(manifest: str) -> Callable[[DataFrame, int], None]:
    """T-S3: a foreachBatch over files (path, hash): done hashes are skipped, failed ones tried again, and the batch's
    outcomes are upserted by hash, in proportion to the batch. A batch that is run again reads the manifest before it."""

    def run(batch: DataFrame, number: int) -> None:
        table = manifest_table(batch.sparkSession, manifest)
        rows = TI.triaged(batch, table.read(number)).filter("outcome IN ('processed', 'failed')").select("hash", "status")
        table.upsert(rows, number)
        table.compact()
        table.vacuum(number)

    return run


def started(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Run a stream over what there is now."""
    return stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
