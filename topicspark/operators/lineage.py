"""Hash-chained operation logs: building and checking chains, and score content against its last operation."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from topicspark.functions import text as T

GENESIS = "GENESIS"


def built(operations: DataFrame) -> DataFrame:
    """(topic, seq, op, payload, hash), each hash over the one before and the payload.

    A chain is sequential by its nature, topics are not: rows are dealt by topic, sorted by Spark, and streamed through tasks
    that carry nothing but the last hash, so that a topic of any length takes time in proportion and no memory. A null
    payload gives no hash from there on. Operations of one seq follow each other by op and payload.
    """
    df = operations.select("topic", F.col("seq").cast("int").alias("seq"), "op", "payload")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        topic, last = object(), GENESIS
        for batch in batches:
            hashes = []
            for of, payload in zip(batch.column(0).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if of != topic:
                    topic, last = of, GENESIS
                last = None if last is None or payload is None else hashlib.sha256((last + payload).encode()).hexdigest()
                hashes.append(last)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(hashes, type=pa.string())], ["topic", "seq", "op", "payload", "hash"])

    dealt = df.repartition("topic").sortWithinPartitions("topic", "seq", "op", "payload")
    return dealt.mapInArrow(run, "topic string, seq int, op string, payload string, hash string")


def checked(operations: DataFrame, heads: DataFrame) -> DataFrame:
    """For each topic whether its chain holds: valid, and the first operation (`broken_at`) whose hash doesn't follow
    from the recorded one before, or the last one if only the head differs."""
    before = F.lag("hash", 1, GENESIS).over(Window.partitionBy("topic").orderBy("seq"))
    df = operations.withColumn("good", T.chained_hash(before, F.col("payload")) == F.col("hash"))
    df = df.groupBy("topic").agg(F.min(F.when(~F.col("good"), F.col("seq"))).alias("broken"), F.max("seq").alias("last"), F.max_by("hash", "seq").alias("last_hash"))
    df = df.join(heads.select("topic", F.col("hash").alias("head")), "topic", "full")
    agrees = F.coalesce("last_hash", F.lit(GENESIS)) == F.coalesce("head", F.lit(GENESIS))
    at = F.coalesce("broken", F.when(~agrees, F.col("last")))
    return df.select("topic", (F.col("broken").isNull() & agrees).alias("valid"), F.when(at.isNotNull(), F.format_string("OP-%04d", at)).alias("broken_at"))


def hand_edited(operations: DataFrame, contents: DataFrame) -> DataFrame:
    """Topics whose content (topic, content_hash) isn't what the last SCORE operation recorded, or that have none.

    operations: (topic, seq, op, content_hash); a recorded null is accepted.
    """
    last = operations.filter("op = 'SCORE'").groupBy("topic").agg(F.max_by(F.struct(F.col("content_hash").alias("h")), "seq").alias("recorded"))
    df = contents.join(last, "topic", "left")
    return df.filter("recorded IS NULL OR recorded.h <> content_hash").select("topic", F.lit("hand_edited").alias("type"))
