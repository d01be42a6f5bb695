"""What the operators of this subpackage share: tables, word splitting, chunks, components."""

from __future__ import annotations

import ctypes
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: One run of the six ASCII white-space characters; words are what stands between.
SPACE = r"[\x20\x09-\x0D]+"
#: A-Z to a-z for bytes.translate; other bytes stay.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    """Words between runs of ASCII white space; a null text has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a local master takes a new
    folder of its machine; on a cluster that is an error, as each executor would write to its own disk."""
    sc = spark.sparkContext
    told = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not told:
        set_dir = sc._jsc.sc().getCheckpointDir()
        if set_dir.isDefined():
            told = set_dir.get()
        elif sc.master.startswith("local"):
            told = tempfile.mkdtemp(prefix="topicspark-")  # one machine: any folder of it is shared
        else:
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(told)
    return told


def stored(df: DataFrame) -> DataFrame:
    """Cut the lineage of df: written to the shared folder and read again."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def new_folder(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def scratch(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """df written as a Parquet table in the shared folder and read again (its plan starts at the files)."""
    path = new_folder(spark, name)
    df.write.parquet(path)
    return spark.read.parquet(path)


def with_row(df: DataFrame, name: str) -> DataFrame:
    """df with a long column that tells its rows apart, the same whenever it is read.

    A plain scan of Parquet files takes a hash of file and row number; anything else is numbered in a written table.
    """
    plan = df._jdf.queryExecution().analyzed()
    while plan.getClass().getSimpleName() in ("Project", "SubqueryAlias"):
        plan = plan.child()
    if plan.getClass().getSimpleName() == "LogicalRelation" and "_metadata" not in df.columns:
        try:
            return df.select("*", F.xxhash64("_metadata.file_path", "_metadata.row_index").alias(name))
        except AnalysisException:  # not of Parquet files, or its columns are computed anew
            pass
    return scratch(df.sparkSession, df.select("*", F.monotonically_increasing_id().alias(name)), "rows")


#: A key that holds more than this share of all rows is hot; so at most HOT keys are.
HOT = 1000


def hot_join(left: DataFrame, right: DataFrame, key: str, count: str, how: str) -> DataFrame:
    """left joined (inner or left) with right's one row a key, of which `count` rows of left have it, or might.

    Keys with more than a HOT-th of all counts, and so at most HOT of them, meet left by a broadcast, the others by a
    shuffle in which no key is large. left is read twice and right three times: they should be tables or plain scans.
    """
    total = right.agg(F.sum(count)).first()[0] or 0
    hot, rest = F.broadcast(right.filter(F.col(count) * HOT > total)), right.filter(F.col(count) * HOT <= total)
    return left.join(hot, key).unionByName(left.join(hot, key, "left_anti").join(rest, key, how), allowMissingColumns=True)


def in_chunks(df: DataFrame, key: Column, size: Column, chunk_bytes: int) -> tuple[DataFrame, int]:
    """df with an int column `chunk`: rows dealt by a hash of key so that a chunk holds about chunk_bytes of size."""
    total = df.agg(F.sum(size)).first()[0] or 0
    n = max(1, -(-int(total) // chunk_bytes))
    return df.withColumn("chunk", F.pmod(F.xxhash64(F.lit("chunk"), key), F.lit(n)).cast("int")), n


def local_components(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Smallest node reachable from each of the nodes 0..n-1 by the edges (a, b)."""
    label = np.arange(n)
    while len(a):
        la, lb = label[a], label[b]
        open_ = la != lb
        if not open_.any():
            break
        a, b, la, lb = a[open_], b[open_], la[open_], lb[open_]
        low, high = np.minimum(la, lb), np.maximum(la, lb)
        np.minimum.at(label, high, low)
        while True:
            up = label[label]
            if np.array_equal(up, label):
                break
            label = up
    return label


def components(edges: DataFrame) -> DataFrame:
    """Connected components of edges (a, b): node -> component (the smallest node reachable).

    Large-star and small-star rounds in turn; each round keeps at most one edge a node and star, so that a hub costs
    no more than its degree. A round's edges are written to the shared folder, which cuts the lineage.
    Null ends are dropped; without an edge the result is empty.
    """
    e = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct()
    e, last = stored(e), None
    while True:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.filter("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.filter("a <> b").distinct()
        # small star: each node's smaller neighbours, and the node itself, to the smallest of them
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
        e = stored(small.filter("a <> b").distinct())
        now = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == last:
            return e.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
        last = now


def apart(docs: DataFrame, *needed: str) -> DataFrame:
    """The needed columns, and all others packed in one column `_row`, so that no name of theirs can clash."""
    others = [F.col(f"`{c}`") for c in docs.columns if c not in needed]
    return docs.select(*needed, F.struct(*others, F.lit(0).alias("_")).alias("_row"))


def together(df: DataFrame, docs: DataFrame, *needed: str) -> DataFrame:
    """The columns of docs again, in their order."""
    return df.select(*[F.col(c) if c in needed else F.col("_row").getField(c).alias(c) for c in docs.columns])


#: An odd base of polynomial hashes modulo 2^64, and its inverse.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 2**64)
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0, 1, ... n - 1 modulo 2^64; the longest run so far is kept."""
    if base not in _powers or len(_powers[base]) < n:
        run = np.full(max(n, 1 << 20), np.uint64(base))
        run[0] = 1
        _powers[base] = np.cumprod(run)
    return _powers[base][:n]


def prefix_sums(buf: np.ndarray, base: int = BASE) -> np.ndarray:
    """Sums of (byte + 1) * base ** place over the first 0, 1, ... len(buf) bytes, modulo 2^64."""
    out = np.zeros(len(buf) + 1, dtype=np.uint64)
    np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * powers(base, len(buf)), out=out[1:])
    return out


def span_hash(sums: np.ndarray, first: np.ndarray, last: np.ndarray, inverse: int = INVERSE) -> np.ndarray:
    """The polynomial hash of the bytes from first to before last: equal for equal strings wherever they stand."""
    return (sums[last] - sums[first]) * powers(inverse, len(sums))[first]


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread a 64-bit hash over all its bits."""
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def give_back() -> None:
    """Give what a reused Python worker has freed back to the system, so that the next stage doesn't start on top of it."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library: freed memory stays with the worker
        pass


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Let Arrow batches of whole documents hold fewer rows than Spark's default, so that workers stay small."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, str(rows))
