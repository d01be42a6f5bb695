"""Numbers and running totals along the rows of a key, also of a key that has a large share of all rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from topicspark.shared import estimated_bytes, written

#: A key is hot if it has more rows than this and more than one of SHARE of all rows; so at most SHARE keys are.
MOST, SHARE = 1_000_000, 10_000
#: Frames that Spark estimates at no more than this aren't searched for hot keys: any key of theirs fits a task.
SMALL = 64 << 20

#: How totals of parts add up: the aggregate of rows, and the same over parts.
ADD = {"count": (lambda c: F.count(F.lit(1)), F.sum), "sum": (F.sum, F.sum), "xor": (F.bit_xor, F.bit_xor), "max": (F.max, F.max)}


def running(df: DataFrame, keys: list[str], order: list[str | Column], totals: dict[str, tuple[str, Column | None]], most: int = MOST, small: int = SMALL) -> DataFrame:
    """df with running totals (name: (count, sum, xor or max; what of)) over the rows of each key in order, the row itself
    included. Keys may be null; rows that tie in order are taken in any order, so order should tell them apart.

    Keys that aren't hot are totalled by a window. Rows of hot keys are dealt by ranges of (keys, order) into parts, which are
    written to the shared folder, so that the ranges stay what they are; each part is totalled by a window of its own, and
    what the earlier parts of its key add up to, a row a part and so a small table, is joined to its rows. No task holds
    more than a part.
    """
    by = [F.col(c) if isinstance(c, str) else c for c in order]
    plain = lambda rows, *at: rows.select("*", *[ADD[how][0](what).over(Window.partitionBy(*at).orderBy(*by).rowsBetween(Window.unboundedPreceding, 0)).alias(name) for name, (how, what) in totals.items()])
    if estimated_bytes(df) <= small:
        return plain(df, *keys)
    sizes = df.groupBy(*keys).agg(F.count("*").alias("_n"))
    total = sizes.agg(F.sum("_n")).first()[0] or 0
    hot = [r.asDict() for r in sizes.filter(F.col("_n") > max(most, total // SHARE)).drop("_n").collect()]  # at most SHARE rows
    if not hot:
        return plain(df, *keys)
    hot = F.broadcast(df.sparkSession.createDataFrame([tuple(r[k] for k in keys) for r in hot], df.select(*keys).schema))
    same = reduce(lambda a, b: a & b, [F.col(f"_l.{k}").eqNullSafe(F.col(f"_r.{k}")) for k in keys])
    cold = df.alias("_l").join(hot.alias("_r"), same, "left_anti")
    dealt = df.alias("_l").join(hot.alias("_r"), same, "left_semi").repartitionByRange(max(2, -(-total // most)), *keys, *by)
    parts = written(dealt.withColumn("_part", F.spark_partition_id()), "ordered")
    parts = plain(parts, *keys, "_part")
    own = parts.groupBy(*keys, "_part").agg(*[F.max(name).alias(name) if how in ("count", "max") else ADD[how][0](what).alias(name) for name, (how, what) in totals.items()])
    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = own.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_part").alias("_p"), *[ADD[how][1](name).over(earlier).alias(f"_before_{name}") for name, (how, _) in totals.items()])
    here = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]) & (F.col("_part") == F.col("_p"))
    both = parts.join(F.broadcast(before), here)

    def whole(name: str, how: str) -> Column:
        a, b = F.col(name), F.col(f"_before_{name}")
        if how == "max":
            return F.greatest(a, b)
        joined = a.bitwiseXOR(b) if how == "xor" else a + b
        return F.coalesce(joined, a, b)  # a part without a value adds nothing

    return cold.transform(plain, *keys).unionByName(both.select(*df.columns, *[whole(name, how).alias(name) for name, (how, _) in totals.items()]))


def numbered(df: DataFrame, keys: list[str], order: list[str | Column], name: str, most: int = MOST, small: int = SMALL) -> DataFrame:
    """df with an int column: the rows of each key numbered from 1 in order, by running()."""
    return running(df, keys, order, {name: ("count", None)}, most, small).withColumn(name, F.col(name).cast("int"))


#: A page holds no more rows than this, and rows of no more bytes than this besides its last.
PAGE_ROWS, PAGE_BYTES = 10_000, 8 << 20


def paged(df: DataFrame, keys: list[str], order: list[str | Column], columns: list[str | Column], name: str, size: Column | None = None, rows: int = PAGE_ROWS, page_bytes: int = PAGE_BYTES, most: int = MOST, small: int = SMALL) -> DataFrame:
    """The rows of each key as pages: (keys, page, name, n): an array of the columns, in order, of n rows.

    A page ends after so many rows, and where the sizes of its key's rows (size, in bytes; null counts as 0) pass a multiple
    of page_bytes. So no row of the result grows with a key, and pages are grouped by (keys, page), each by a task of its
    choice. Pages rise with the order; numbers are skipped where both limits, or a row of several times page_bytes, end
    one. Order should tell the rows of a key apart. df has no columns _row and _bytes.
    """
    totals = {"_row": ("count", None)} | ({"_bytes": ("sum", F.coalesce(size, F.lit(0)).cast("long"))} if size is not None else {})
    page = F.floor((F.col("_row") - 1) / rows)
    if size is not None:
        page = page + F.floor((F.col("_bytes") - F.coalesce(size, F.lit(0))) / page_bytes)
    numbered_rows = running(df, keys, order, totals, most, small)
    item = F.struct("_row", F.struct(*columns).alias("_item"))
    pages = numbered_rows.groupBy(*keys, page.cast("long").alias("page")).agg(F.array_sort(F.collect_list(item)).alias("_items"), F.count("*").alias("n"))
    return pages.select(*keys, "page", F.transform("_items", lambda x: x["_item"]).alias(name), "n")
