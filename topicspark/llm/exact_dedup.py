"""Exact dedup by Grace hashing: records are dealt into buckets, again and again until a bucket's distinct contents fit an
open-addressing table, which compares complete contents."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import SPACE, hot_join, scratch, small_batches, table

#: Bytes of distinct contents that a table holds.
TABLE_BYTES = 48 << 20


class ContentTable:
    """An open-addressing hash table from complete contents to the tags of their first rows.

    Slots are probed one after the other from the hash's place; a slot answers only if the whole content is the same.
    Contents lie one after the other in one buffer. At half full the slots are doubled.
    """

    def __init__(self) -> None:
        self.clear()

    def clear(self) -> None:
        self.slots = [-1] * 1024
        self.hashes: list[int] = []
        self.tags: list[int] = []
        self.ends = [0]
        self.held = bytearray()

    def first(self, hash_: int, content: bytes, tag: int) -> int:
        """The tag that the content came with first; now, if it is new."""
        mask = len(self.slots) - 1
        at = hash_ & mask
        while (k := self.slots[at]) >= 0:
            if self.hashes[k] == hash_ and self.held[self.ends[k] : self.ends[k + 1]] == content:
                return self.tags[k]
            at = (at + 1) & mask
        self.slots[at] = len(self.tags)
        self.hashes.append(hash_)
        self.tags.append(tag)
        self.held += content
        self.ends.append(len(self.held))
        if 2 * len(self.tags) > len(self.slots):
            self.grow()
        return tag

    def grow(self) -> None:
        mask = 2 * len(self.slots) - 1
        self.slots = [-1] * (mask + 1)
        for k, hash_ in enumerate(self.hashes):
            at = hash_ & mask
            while self.slots[at] >= 0:
                at = (at + 1) & mask
            self.slots[at] = k


def combined(rows: DataFrame, table_bytes: int) -> DataFrame:
    """rows (row, hash, content, ...) with `first`, the row of the same task that had the content first; content stays
    only where that is the row itself. A table that has table_bytes starts anew, so later copies get a first of their own."""
    names = rows.columns
    r, h, c = (names.index(x) for x in ("row", "hash", "content"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = ContentTable()
        for batch in batches:
            row = batch.column(r).to_pylist()
            first = []
            for tag, hash_, content in zip(row, batch.column(h).to_pylist(), batch.column(c), strict=True):
                first.append(seen.first(hash_, content.as_buffer().to_pybytes(), tag))
                if len(seen.held) > table_bytes:
                    seen.clear()
            own = pa.array(np.array(row, dtype=np.int64) == np.array(first, dtype=np.int64))
            columns = list(batch.columns)
            columns[c] = pc.if_else(own, columns[c], pa.scalar(None, columns[c].type))
            yield pa.RecordBatch.from_arrays([*columns, pa.array(first, pa.int64())], [*names, "first"])

    return rows.mapInArrow(run, StructType([*rows.schema.fields, StructField("first", LongType())]))


def bucket_of(hash_: Column, level: int, fan: Column) -> Column:
    return F.pmod(F.xxhash64(F.lit(level), hash_), fan)


def with_buckets(kept: DataFrame, table_bytes: int) -> DataFrame:
    """kept (hash, size, ...: one row a content and task that had it) with `bucket`, an array of numbers, one a level.

    Level 0 deals all hashes into buckets of half a table on average. Buckets whose distinct hashes still hold more than a
    table are dealt again by another seed into as many as they need, level by level; a bucket of one hash is left, as its
    contents are one (or as many as share 64 bits). The levels are decided on hashes and sizes alone, so that the contents
    themselves move once, to the shuffle files of their last bucket. Only the numbers of oversized buckets come to the
    plan, as a table that is joined.
    """
    sizes = scratch(kept.sparkSession, kept.groupBy("hash").agg(F.max("size").alias("size")), "sizes")
    total = sizes.agg(F.sum("size")).first()[0] or 0
    level, fan = 0, max(1, -(-2 * total // table_bytes))
    deal = lambda df: df.withColumn("bucket", F.array(bucket_of(F.col("hash"), 0, F.lit(fan))))
    sizes, out = deal(sizes), deal(kept)
    while True:
        level += 1
        over = sizes.groupBy("bucket").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).filter((F.col("bytes") > table_bytes) & (F.col("n") > 1))
        over = scratch(kept.sparkSession, over.select("bucket", F.ceil(2 * F.col("bytes") / F.lit(table_bytes)).alias("fan")), "oversized")
        if over.isEmpty():
            return out
        deeper = F.when(F.col("fan").isNotNull(), F.concat("bucket", F.array(bucket_of(F.col("hash"), level, F.col("fan"))))).otherwise(F.col("bucket"))
        again = lambda df, how: df.join(over, "bucket", how).withColumn("bucket", deeper).drop("fan")  # noqa: B023, E731
        sizes, out = again(sizes, "inner"), again(out, "left")


def compared(dealt: DataFrame) -> DataFrame:
    """dealt (bucket, hash, first, content) as (first, class): rows of equal content share a class, the first of one of them.

    A task reads its buckets one after the other and holds one table; copies of a content are read but not held.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, last = ContentTable(), None
        for batch in batches:
            out = []
            for bucket, hash_, first, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3), strict=True):
                if bucket != last:
                    seen.clear()
                    last = bucket
                out.append(seen.first(hash_, content.as_buffer().to_pybytes(), first))
            yield pa.RecordBatch.from_arrays([batch.column(2), pa.array(out, pa.int64())], ["first", "class"])

    ordered = dealt.select("bucket", "hash", "first", "content").repartition("bucket").sortWithinPartitions("bucket", "hash")
    return ordered.mapInArrow(run, "first long, class long")


def exact_dedup(docs: DataFrame, content: Column, order: Column, carry: list[str], table_bytes: int = TABLE_BYTES) -> DataFrame:
    """One row a row of docs: its columns named in `carry` as the struct `_row`, `size` (bytes), `keep` (the kept row's
    order), `group_size` and `kept`.

    Rows are equal when their contents (a string column, null: empty) are the same bytes. Of equal rows the one with the
    smallest `order` stays; nulls come last, and of rows that tie the one read first stays. Tasks first join equal rows of
    their own, so that a content with a third of all rows is shuffled once a task and table; see with_buckets for the rest.
    A table holds at most table_bytes, or one content if that alone is larger; a single content must fit a worker. The
    joined rows, with contents where they came first, are written once to the shared folder. An empty table gives an empty one;
    columns may have any names.
    """
    spark = docs.sparkSession
    small_batches(spark)
    text = F.coalesce(content, F.lit(""))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in carry], F.lit(0).alias("_")).alias("_row"), order.alias("order"), F.monotonically_increasing_id().alias("row"), F.encode(text, "UTF-8").alias("content"))
    rows = rows.select("_row", "order", "row", F.octet_length("content").cast("long").alias("size"), F.xxhash64("content").alias("hash"), "content")
    records = scratch(spark, combined(rows, table_bytes), "records")
    kept = records.filter(F.col("content").isNotNull()).select("hash", "size", "first", "content")
    class_ = compared(with_buckets(kept, table_bytes))
    members = records.select("_row", "order", "row", "size", "first").join(class_, "first")
    members = scratch(spark, members.drop("first"), "members")
    least = F.min(F.struct(F.col("order").isNull().alias("none"), F.col("order").alias("order"), F.col("row").alias("row")))
    groups = members.groupBy("class").agg(least.alias("least"), F.count("*").alias("group_size"))
    groups = scratch(spark, groups.select("class", F.col("least.order").alias("keep"), F.col("least.row").alias("keep_row"), "group_size"), "groups")
    df = hot_join(members, groups, "class", "group_size", "inner")
    return df.select("_row", "size", "keep", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"))


def normalised(text: Column) -> Column:
    """Each run of ASCII white space as one space; null as the empty text."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " ")


def op13_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the one that stays of those with its normalised text."""
    docs = table(spark, sf_dir, "documents").select("doc_id", normalised(F.col("text")).alias("content"))
    docs = docs.withColumn("text_sha256", F.sha2("content", 256))
    df = exact_dedup(docs, F.col("content"), F.col("doc_id"), ["doc_id", "text_sha256"])
    return df.select("_row.doc_id", F.col("keep").alias("keep_id"), "group_size", "kept", "_row.text_sha256")


OP13_SQL = r"""
WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS content FROM documents),
g AS (SELECT content, min(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY content)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(d.content) AS text_sha256 FROM d JOIN g ON d.content = g.content"""
