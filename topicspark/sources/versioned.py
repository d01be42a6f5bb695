"""Tables that are replaced or updated by key in batches: written in proportion to a batch, read whole at any time.

A table is a folder with segments (Parquet, dealt into folders by a hash of the key) and versions. A version is one small
JSON file that lists its segments in order; it is written after its segments, under a new name, so that it is there or
not: nothing is renamed, replaced or removed that a reader of the newest version needs, on object stores as well. One
writer at a time.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Segments after which a table is compacted even if they are small.
MOST_SEGMENTS = 32


class VersionedTable:
    """A table at `path` with key columns `keys`; rows of a key have the last batch's values.

    schema: the columns as DDL, keys among them; keys may be null. buckets: into how many folders the keys are dealt.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, keys: list[str], buckets: int = 64) -> None:
        self.spark, self.path, self.keys, self.buckets = spark, path.rstrip("/"), keys, buckets
        self.schema = spark.createDataFrame([], schema).schema
        self.names = self.schema.names
        jvm = spark.sparkContext._jvm
        self.to_path = jvm.org.apache.hadoop.fs.Path
        self.fs = self.to_path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def versions(self) -> list[str]:
        """The names of all versions, oldest first."""
        at = self.to_path(f"{self.path}/versions")
        return sorted(x.getPath().getName() for x in self.fs.listStatus(at)) if self.fs.exists(at) else []

    def segments(self, version: str | None) -> list[dict]:
        """Folder, number and rows of each segment of a version, oldest first; a version that isn't there has none."""
        if version is None:
            return []
        stream = self.fs.open(self.to_path(f"{self.path}/versions/{version}"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def version_before(self, batch: int | None = None) -> str | None:
        """The newest version, of the batches before that number if one is given."""
        found = [v for v in self.versions() if batch is None or v < name_of(batch)]
        return found[-1] if found else None

    def commit(self, version: str, segments: list[dict]) -> None:
        out = self.fs.create(self.to_path(f"{self.path}/versions/{version}"), False)
        out.write(bytearray(json.dumps(segments).encode()))
        out.close()

    def segment(self, df: DataFrame, number: int) -> dict:
        """Write a segment: a file or a few for each bucket."""
        folder = f"segment-{number:09d}-{uuid.uuid4().hex}"
        held = df.withColumn("_bucket", self.bucket())
        held.repartition("_bucket").write.partitionBy("_bucket").parquet(f"{self.path}/{folder}")
        return {"folder": folder, "number": number, "rows": self.stored(folder).count()}

    def stored(self, folder: str) -> DataFrame:
        fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in self.schema)
        return self.spark.read.schema(f"{fields}, `_gone` boolean, `_bucket` int").parquet(f"{self.path}/{folder}")

    def merged(self, segments: list[dict], only: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
        """The rows of the segments, the newest of each key, without those that are gone."""
        parts = [only(self.stored(s["folder"])).withColumn("_number", F.lit(k)) for k, s in enumerate(segments)]
        if not parts:
            return self.spark.createDataFrame([], self.schema)
        df = parts[0]
        for p in parts[1:]:
            df = df.unionByName(p)
        if len(parts) > 1:
            others = [c for c in [*self.names, "_gone"] if c not in self.keys]
            df = df.groupBy(*self.keys).agg(F.max_by(F.struct(*others), "_number").alias("_last")).select(*self.keys, "_last.*")
        return df.filter("NOT _gone").select(*self.names)

    def read(self, before: int | None = None) -> DataFrame:
        """The table as of its newest version, or of the newest before a batch."""
        return self.merged(self.segments(self.version_before(before)))

    def lookup(self, wanted: DataFrame) -> DataFrame:
        """The rows whose key is among wanted's. Only the folders of the wanted keys' buckets are read: their numbers, no more
        than there are buckets, come to the plan."""
        keys = wanted.select(*self.keys).distinct()
        numbers = [r[0] for r in keys.select(self.bucket()).distinct().collect()]
        found = self.merged(self.segments(self.version_before()), lambda df: df.filter(F.col("_bucket").isin(numbers)))
        return found.join(keys, self.keys, "left_semi")

    def upsert(self, df: DataFrame, batch: int | None = None, gone: Column | None = None) -> str:
        """Add or replace the rows of df's keys (each key once in df; rows where `gone` holds are removed), as batch number
        `batch` (without one: the next). A batch that is committed already isn't again. Returns the version's name."""
        last = self.versions()
        batch = (number_of(last[-1]) + 1 if last else 0) if batch is None else batch
        done = [v for v in last if number_of(v) == batch]
        if done:
            return done[-1]
        before = self.segments(self.version_before(batch))
        rows = df.select(*self.names, (F.lit(False) if gone is None else F.coalesce(gone, F.lit(False))).alias("_gone"))
        self.commit(name_of(batch), [*before, self.segment(rows, batch)])
        return name_of(batch)

    def replace(self, df: DataFrame, batch: int | None = None) -> str:
        """Replace the whole table by df, which may be read from it; readers see the old rows or the new ones."""
        last = self.versions()
        batch = (number_of(last[-1]) + 1 if last else 0) if batch is None else batch
        done = [v for v in last if number_of(v) == batch]
        if done:
            return done[-1]
        self.commit(name_of(batch), [self.segment(df.select(*self.names, F.lit(False).alias("_gone")), batch)])
        return name_of(batch)

    def compact(self, force: bool = False) -> bool:
        """Merge the newest version's segments into one, as a version of its own, once the later ones hold as many rows as the
        first (so that each row is rewritten a few times in all) or there are too many of them."""
        version = self.version_before()
        parts = self.segments(version)
        later = sum(s["rows"] for s in parts[1:])
        if len(parts) < 2 or not (force or later >= parts[0]["rows"] or len(parts) > MOST_SEGMENTS):
            return False
        number = number_of(version)
        self.commit(f"{name_of(number)}-compact-{uuid.uuid4().hex[:8]}", [self.segment(self.merged(parts).withColumn("_gone", F.lit(False)), number)])
        return True

    def vacuum(self, batch: int) -> None:
        """Remove versions that neither batch `batch`, if it is run again, nor a later one reads, and segments that no version
        lists: those of tries that died, too. Readers of older versions must have ended."""
        keep = [v for v in self.versions() if v >= (self.version_before(batch) or "")]
        listed = {s["folder"] for v in keep for s in self.segments(v)}
        for v in self.versions():
            if v not in keep:
                self.fs.delete(self.to_path(f"{self.path}/versions/{v}"), False)
        for x in list(self.fs.listStatus(self.to_path(self.path))):
            name = x.getPath().getName()
            if name.startswith("segment-") and name not in listed:
                self.fs.delete(x.getPath(), True)


def name_of(batch: int) -> str:
    return f"v{batch:012d}"


def number_of(version: str) -> int:
    return int(version[1:13])
