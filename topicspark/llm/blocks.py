"""Pairs within groups of any size, found in tasks of bounded size.

Rows of a key are dealt into parts of at most about `limit` rows, and every pair of parts becomes a block of its own, so
that the pairs of a large group are spread over many tasks and no task holds more than two parts of a group. Blocks are
read as sorted streams of Arrow batches.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dealt_blocks(rows: DataFrame, key: str, spread: Column, limit: int, few: bool = False) -> DataFrame:
    """rows of the keys that hold two rows or more, with key, part, i and j: once for each block (i, j) of their key.

    Block (i, i) holds part i; block (i, j), i < j, holds parts i and j, whose pairs across count.
    spread: what deals the rows of a key evenly (a row's identity). few: the keys are of a bounded number, and broadcast.
    """
    sizes = rows.groupBy(key).agg(F.count("*").alias("_n")).filter("_n > 1")
    df = rows.join(F.broadcast(sizes) if few else sizes, key).withColumn("_parts", F.ceil(F.col("_n") / F.lit(limit)).cast("int"))
    df = df.withColumn("part", F.pmod(F.xxhash64(F.lit("part"), spread), F.col("_parts")).cast("int"))
    others = F.transform(F.sequence(F.lit(0), F.col("_parts") - 1), lambda o: F.struct(F.least(o, "part").alias("i"), F.greatest(o, "part").alias("j")))
    return df.withColumn("_b", F.explode(others)).select(*rows.columns, "part", "_b.i", "_b.j")


def in_blocks(blocks: DataFrame, key: str, run: Callable[[pa.Table, np.ndarray], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """run(table, group) over streams of whole blocks: group numbers the blocks' rows, 0 0 1 1 1 2 ..."""
    dealt = blocks.repartition(key, "i", "j").sortWithinPartitions(key, "i", "j")
    k, i, j = (blocks.columns.index(c) for c in (key, "i", "j"))

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not len(batch):
                continue
            held.append(batch)
            all_ = pa.Table.from_batches(held)
            starts = block_starts(all_, k, i, j)
            last = int(starts[-1])
            if last:
                yield from run(all_.slice(0, last), numbered(starts[:-1], last))
                held = all_.slice(last).combine_chunks().to_batches()
        if held:
            all_ = pa.Table.from_batches(held)
            yield from run(all_, numbered(block_starts(all_, k, i, j), len(all_)))

    return dealt.mapInArrow(stream, schema)


def block_starts(rows: pa.Table, *columns: int) -> np.ndarray:
    new = np.zeros(len(rows), dtype=bool)
    new[0] = True
    for c in columns:
        v = rows.column(c).to_numpy()
        new[1:] |= v[1:] != v[:-1]
    return np.flatnonzero(new)


def numbered(starts: np.ndarray, n: int) -> np.ndarray:
    group = np.zeros(n, dtype=np.int64)
    group[starts[1:]] = 1
    return np.cumsum(group)


def pair_steps(group: np.ndarray, part: np.ndarray, cross: np.ndarray, most: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs (a, b), a before b, of rows of one block, in arrays; of blocks of two parts only pairs across."""
    a = np.arange(len(group))
    step = 1
    while True:
        a = a[a + step < len(group)]
        a = a[group[a] == group[a + step]]
        if not len(a):
            return
        for lo in range(0, len(a), most):
            x = a[lo : lo + most]
            y = x + step
            ok = ~cross[x] | (part[x] != part[y])
            if ok.any():
                yield x[ok], y[ok]
        step += 1
