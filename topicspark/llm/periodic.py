"""Periodic run detection: recursive frequency splitting leaves few stretches of words, which a lag scan searches exactly."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import BASE, INVERSE, mixed, powers, table, words

#: A run repeats its period at least so often, and has at least so many words.
LEAST_TIMES, LEAST_WORDS = 4, 6
#: Segments of up to so many words are scanned lag by lag in whole; longer ones by anchors first.
SHORT = 256


def stretches(on: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First places and ends of the maximal stretches of True."""
    edge = np.flatnonzero(np.diff(np.concatenate(([False], on, [False])).view(np.int8)))
    return edge[::2], edge[1::2]


def split_by_frequency(ids: np.ndarray, times: int = LEAST_TIMES, least: int = LEAST_WORDS) -> list[tuple[int, int]]:
    """The segments [first, end) of a text of word numbers that can hold runs.

    A run holds each of its words `times` times or more. So a word that occurs less often in its segment lies in no run
    of it and splits it; pieces below `least` words go, and the rest are split again by their own counts until none
    changes. All segments of a round are counted together; words outside them are not looked at again. Words that are
    too rare in the whole text come as -1, so that the first round is made already.
    """
    first, end = stretches(ids >= 0)
    large = end - first >= least
    if not large.any():
        return []
    at = np.concatenate([np.arange(a, b) for a, b in zip(first[large], end[large], strict=True)])
    segment = np.repeat(np.arange(large.sum()), (end - first)[large])
    width = int(ids.max()) + 1
    while len(at):
        _, inverse, counts = np.unique(segment * width + ids[at], return_inverse=True, return_counts=True)
        often = counts[inverse] >= times
        first = np.flatnonzero(np.concatenate(([True], (np.diff(at) > 1) | (np.diff(segment) > 0))))
        if often.all() and (np.diff(np.append(first, len(at))) >= least).all():
            return [(int(at[a]), int(at[b - 1]) + 1) for a, b in zip(first, np.append(first[1:], len(at)), strict=True)]
        at, segment = at[often], segment[often]
        if not len(at):
            break
        new = np.concatenate(([0], np.cumsum((np.diff(at) > 1) | (np.diff(segment) > 0))))
        large = np.bincount(new)[new] >= least
        at, segment = at[large], new[large]
    return []


class Anchors:
    """Tells the lags of a long segment that may hold a run, in n * log(n) steps for all of them.

    A run of period q and 4 * q words has period q in the 3 * q words from some multiple of q on. These stretches are
    compared by hashes of their words; what they propose is then searched by the words themselves.
    """

    def __init__(self, ids: np.ndarray, times: int) -> None:
        self.n, self.times = len(ids), times
        self.sums = np.zeros(self.n + 1, dtype=np.uint64)
        np.cumsum(mixed(ids.astype(np.uint64) + np.uint64(1)) * powers(BASE, self.n), out=self.sums[1:])
        self.back = powers(INVERSE, self.n + 1)

    def propose(self, q: int, found: list[tuple[int, int, int]]) -> bool:
        """Whether some stretch has period q that isn't part of a run found before whose period divides q."""
        a = np.arange(0, self.n - (self.times - 1) * q + 1, q)
        span, s, back = (self.times - 2) * q, self.sums, self.back
        a = a[(s[a + span] - s[a]) * back[a] == (s[a + q + span] - s[a + q]) * back[a + q]]
        for start, length, period in found:
            if not len(a):
                break
            if q % period == 0 and length >= span + q:
                a = a[(a < start) | (a + span + q > start + length)]
        return len(a) > 0


def scanned(ids: np.ndarray, times: int = LEAST_TIMES, least: int = LEAST_WORDS) -> list[tuple[int, int, int]]:
    """All runs (start, length, period) of one segment, by lags in ascending order.

    Two words q apart are equal throughout a stretch of period q. A stretch of four periods that also has a smaller period
    has one that divides q, which gives the very same stretch: it was found before and isn't taken again.
    """
    n, seen, out = len(ids), set(), []
    anchors = Anchors(ids, times) if n > SHORT else None
    for q in range(1, n // times + 1):
        if anchors and not anchors.propose(q, out):
            continue
        first, end = stretches(ids[q:] == ids[:-q])
        long = end - first + q >= max(least, times * q)
        for a, b in zip(first[long].tolist(), (end[long] + q).tolist(), strict=True):
            if (a, b) not in seen:
                seen.add((a, b))
                out.append((a, b - a, q))
    return out


def runs_of(text: bytes, times: int = LEAST_TIMES, least: int = LEAST_WORDS) -> tuple[list[bytes], list[tuple[int, int, int]]]:
    """The words of a text and all its runs (start, length, period), by start, then period."""
    found = text.split()  # bytes split at the six ASCII white-space characters
    if len(found) < least:
        return found, []
    number = {w: k for k, (w, n) in enumerate(Counter(found).items()) if n >= times}
    if not number:
        return found, []
    ids = np.fromiter(map(number.get, found, repeat(-1)), dtype=np.int64, count=len(found))
    out = [(a + s, n, q) for a, b in split_by_frequency(ids, times, least) for s, n, q in scanned(ids[a:b], times, least)]
    return found, sorted(out, key=lambda r: (r[0], r[2]))


def collapsed(found: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words joined by one space, without those that some run holds after its first period."""
    if not runs:
        return b" ".join(found)
    edge = np.zeros(len(found) + 1, dtype=np.int64)
    for s, n, q in runs:
        edge[s + q] += 1
        edge[s + n] -= 1
    kept = np.cumsum(edge[:-1]) == 0
    return b" ".join(w for w, k in zip(found, kept.tolist(), strict=True) if k)


def periodic_runs(docs: DataFrame, text: str = "text", times: int = LEAST_TIMES, least: int = LEAST_WORDS) -> DataFrame:
    """docs with `runs` (array of start, length, period: all periodic runs of words) and `collapsed` (the text without
    their repeats).

    A run is a stretch of consecutive words with smallest period q and at least max(least, times * q) words that no
    neighbouring word extends; times below 4 is refused. Each document is searched alone and whole, in tasks of rows as they are read; nothing is
    shuffled. A text takes some tens of bytes a word while it is searched, n log n steps to propose lags and n steps a
    lag that holds. Null and empty texts have no run and an empty collapsed text; runs that overlap or share a start are
    all given; repeated rows and null ids are rows of their own; other columns stay, whatever their names, but `runs` and
    `collapsed`, which are replaced. An empty table gives an empty one.
    """
    if times < 4:
        raise ValueError("runs of fewer than four periods aren't told apart by their stretches")
    kinds = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
    rest = docs.drop("runs", "collapsed")
    place = rest.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            runs, kept = [], []
            for value in batch.column(place):
                found, own = runs_of(value.as_py().encode() if value.is_valid else b"", times, least)
                runs.append([{"start": s, "length": n, "period": q} for s, n, q in own])
                kept.append(collapsed(found, own).decode())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(runs, kinds), pa.array(kept, pa.string())], [*batch.schema.names, "runs", "collapsed"])

    found = StructType.fromDDL("runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed string")
    return rest.mapInArrow(run, StructType([*rest.schema.fields, *found.fields]))


def planted(text: Column, key: Column) -> Column:
    """text with a periodic end in about a tenth of the rows, as a hash of key says; the others stay as they are.

    With h = crc32 of the key in decimals, g = floor(h / 10) and n words: where h % 10 = 0 and n > 0, the words from
    a = g % n on repeat the p = 1 + floor((n - a) / (3 + g % 8)) words that stand there. A null key plants nothing.
    """
    h = F.crc32(key.cast("string").cast("binary"))
    g, w = F.floor(h / 10), words(text)
    n = F.size(w)
    a = (g % n).cast("int")
    p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
    times = F.floor((n - a) / p).cast("int")
    block = F.slice(w, a + 1, p)
    changed = F.concat_ws(" ", F.slice(w, F.lit(1), a), F.flatten(F.array_repeat(block, times)), F.slice(block, F.lit(1), (n - a) - times * p))
    return F.when((h % 10 == 0) & (n > 0), changed).otherwise(text)


def op12_periodic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All runs of every document, its best run, and digests of the runs and of the collapsed text."""
    docs = table(spark, sf_dir, "documents").select("doc_id", planted(F.col("text"), F.col("doc_id")).alias("text"))
    df = periodic_runs(docs)
    # the greatest length / period by whole numbers: a before b if a.length * b.period is greater
    a, b = "a.length * b.period", "b.length * a.period"
    best = F.expr(f"aggregate(runs, CAST(NULL AS struct<start:bigint,length:bigint,period:bigint>), (b, a) -> CASE WHEN b IS NULL OR {a} > {b} OR ({a} = {b} AND (a.start, a.period) < (b.start, b.period)) THEN a ELSE b END)")
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    lines = F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise("")
    df = df.withColumn("best", best)
    return df.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "best.start",
        "best.length",
        "best.period",
        F.expr("(1000 * best.length) div best.period").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
