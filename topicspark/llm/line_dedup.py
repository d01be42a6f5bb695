"""Line dedup: a segment-partition edit join over the distinct lines of a corpus.

A line within edit distance t of another of length l has one of l's t + 1 segments as a substring near its place. Each
line looks itself up by (length, segment, substring) for the lengths l, l - 1, ... l - t that may hold a partner;
lines that share such a key are compared by a banded bit-parallel edit distance.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .blocks import dealt_blocks, in_blocks, pair_steps
from .common import apart, hot_join, mixed, prefix_sums, scratch, small_batches, span_hash, table, together, with_row

LAST = 2**63 - 1
#: A line with anything but ASCII white space.
FILLED = r"[^\x20\x09-\x0D]"


def segment_keys(lines: list[str], distance: int) -> np.ndarray:
    """(lines, keys): the keys under which each line looks for partners of its length and of up to `distance` less.

    The places tried for a segment are those that some alignment within the distance leaves, counted from either end.
    """
    points = np.frombuffer("".join(lines).encode("utf-32-le"), dtype=np.uint32)
    size = np.array([len(x) for x in lines], dtype=np.int64)
    start = np.cumsum(size) - size
    sums = prefix_sums(points)
    out = []
    for less in range(distance + 1):
        other = size - less
        short, longer = other // (distance + 1), other % (distance + 1)
        for i in range(distance + 1):
            extra = np.maximum(0, i - (distance + 1 - longer))
            place, length = i * short + extra, short + (i >= distance + 1 - longer)
            for shift in range(max(-i, less - (distance - i)), min(i, less + distance - i) + 1):
                at = np.clip(place + shift, 0, size - length)
                h = span_hash(sums, start + at, start + at + length)
                out.append(mixed(h + mixed((other * (distance + 1) + i).astype(np.uint64))).view(np.int64))
    return np.stack(out, axis=1) if lines else np.empty((0, 0), dtype=np.int64)


def within(a: list[str], b: list[str], distance: int) -> np.ndarray:
    """Which pairs are within an edit distance (3 at most): for each error count a byte of bits, one a diagonal of the band.

    Bit d + distance of word e: having read j characters of b, j + d of a can be matched with e errors. Pairs without a
    bit left are out and leave the arrays.
    """
    k, band = distance, 2 * distance + 1
    if not 0 <= k <= 3:
        raise ValueError("distance is 0 to 3")
    n = np.array([len(x) for x in b])
    gap = np.array([len(x) for x in a]) - n
    width = int(max(n.max(), (n + gap).max())) + 1
    s = np.zeros((width + 2 * band, len(a)), dtype=np.uint32)
    t = np.zeros((width, len(a)), dtype=np.uint32)
    for row, (x, y) in enumerate(zip(a, b, strict=True)):
        s[k : k + len(x), row] = np.frombuffer(x.encode("utf-32-le"), dtype=np.uint32) + 1
        t[: len(y), row] = np.frombuffer(y.encode("utf-32-le"), dtype=np.uint32) + 1
    full, one = np.uint8((1 << band) - 1), np.uint8(1)
    out, rows = np.zeros(len(a), dtype=bool), np.arange(len(a))
    state = [np.full(len(a), sum(1 << (k + d) for d in range(e + 1)), dtype=np.uint8) for e in range(k + 1)]

    def settle(ended: np.ndarray) -> None:
        r = rows[ended]
        place = np.clip(gap[r] + k, 0, band - 1).astype(np.uint8)
        out[r] = (np.abs(gap[r]) <= k) & ((state[k][ended] >> place) & one).astype(bool)

    for j in range(int(n.max()) + 1):
        if (ended := n[rows] == j).any():
            settle(ended)
        if ended.any() or j % 16 == 0:
            stay = (n[rows] > j) & (np.bitwise_or.reduce(state) > 0)
            if 2 * stay.sum() <= len(rows):
                rows, state, s, t = rows[stay], [v[stay] for v in state], s[:, stay], t[:, stay]
                if not len(rows):
                    break
        if j == len(t):
            break
        match, before = np.packbits(s[j : j + band] == t[j], axis=0, bitorder="little")[0], None
        for e in range(k + 1):
            now = state[e] & match
            if e:
                now |= before | (before >> one) | ((state[e - 1] << one) & full)
            before, state[e] = state[e], now
    return out


def line_keys(docs: DataFrame, distance: int, least_chars: int, text: str) -> DataFrame:
    """(key, id) of every line of at least least_chars characters; id: xxhash64 of the line."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = {x for t in batch.column(0) if t.is_valid for x in t.as_py().split("\n") if len(x) >= least_chars}
            lines, part, size = sorted(found), [], 0
            for k, line in enumerate(lines):
                part.append(line)
                size += len(line)
                if size >= 1 << 19 or k == len(lines) - 1:
                    keys = segment_keys(part, distance)
                    ids = np.array([xxhash.xxh64_intdigest(x.encode(), 42) for x in part], dtype=np.uint64).view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(keys.reshape(-1)), pa.array(np.repeat(ids, keys.shape[1]))], ["key", "id"])
                    part, size = [], 0

    return docs.select(text).mapInArrow(run, "key long, id long")


def runs(order: np.ndarray, size: np.ndarray, most: int = 1 << 21) -> Iterator[np.ndarray]:
    """order in pieces of which each has at most so many characters, padded to its longest (its last) line."""
    lo = 0
    while lo < len(order):
        hi = lo + 1
        while hi < len(order) and (hi - lo) * size[order[hi]] < most and hi - lo < 8192:
            hi += 1
        yield order[lo:hi]
        lo = hi


def line_links(keyed: DataFrame, firsts: DataFrame, distance: int, limit: int) -> DataFrame:
    """(id, n, doc, no, row): how many other distinct lines are near, and the first place of one of them; rows are partial.

    firsts: (id, doc, no, row, line). A pair that shares several keys counts under the smallest.
    """
    rows = dealt_blocks(keyed, "key", F.col("id"), limit).join(firsts, "id").select("key", "id", "part", "i", "j", "doc", "no", "row", "line")

    def run(rows: pa.Table, group: np.ndarray) -> Iterator[pa.RecordBatch]:
        lines, inverse = np.unique(np.array(rows.column(8).to_pylist(), dtype=object), return_inverse=True)
        texts = list(lines)
        own = segment_keys(texts, distance)
        size = np.array([len(x) for x in texts])
        count = np.zeros((len(texts), 32), dtype=np.int16)
        for k, x in enumerate(texts):
            count[k] = np.minimum(np.bincount(np.frombuffer(x.encode("utf-32-le"), dtype=np.uint32) & 31, minlength=32), 30000)
        key = rows.column(0).to_numpy()
        cross = rows.column(3).to_numpy() != rows.column(4).to_numpy()
        out = []
        for a, b in pair_steps(group, rows.column(2).to_numpy(), cross, 1 << 15):
            x, y = inverse[a], inverse[b]
            ok = (x != y) & (np.abs(size[x] - size[y]) <= distance)
            a, x, y, b = a[ok], x[ok], y[ok], b[ok]
            ok = np.abs(count[x] - count[y]).sum(axis=1) <= 2 * distance  # an edit changes two counts at most
            a, x, y, b = a[ok], x[ok], y[ok], b[ok]
            order = np.argsort(size[x], kind="stable")
            for o in runs(order, size[x]):
                yes = o[within([texts[k] for k in x[o]], [texts[k] for k in y[o]], distance)]
                shared = np.array([min(set(own[p]) & set(own[q])) for p, q in zip(x[yes], y[yes], strict=True)], dtype=np.int64)
                yes = yes[shared == key[a[yes]]]
                out += [(a[yes], b[yes]), (b[yes], a[yes])]
        if out:
            me, other = (np.concatenate(v) for v in zip(*out, strict=True))
            if len(me):
                ids, doc, no, row = (rows.column(c).to_numpy() for c in (1, 5, 6, 7))
                order = np.lexsort([row[other], no[other], doc[other], ids[me]])
                me, other = me[order], other[order]
                at = np.flatnonzero(np.append(True, ids[me][1:] != ids[me][:-1]))
                n = np.diff(np.append(at, len(me)))
                yield pa.RecordBatch.from_arrays([pa.array(ids[me[at]]), pa.array(n), pa.array(doc[other[at]]), pa.array(no[other[at]]), pa.array(row[other[at]])], ["id", "n", "doc", "no", "row"])

    return in_blocks(rows, "key", run, "id long, n long, doc long, no int, row long")


def repeated_lines(docs: DataFrame, distance: int = 2, least_chars: int = 30, limit: int = 512, text: str = "text", doc_id: str = "doc_id", row: str | None = None, least_equal: int | None = None) -> DataFrame:
    """(doc_id, row, lines, links): of each document with such lines, the numbers (from 0) of the lines to remove, sorted.

    A line of at least least_chars characters goes if an equal line, or one within the edit distance, stands at a
    smaller (doc_id, line number, row); it is judged on the input, so that it goes even if that line goes too. links: near
    distinct lines, summed over the removed lines. A shorter line goes if it is not blank, has least_equal characters or more
    (default: least_chars, so that none goes) and an equal line stands earlier; other lines always stay. Null texts have no line; null ids come
    last. row: a long column that tells rows apart (common.with_row); without it doc_id has to. Exact repeats are found by 64-bit hashes.
    """
    spark = docs.sparkSession
    df = docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(LAST)).alias("doc"), F.col(row or doc_id).cast("long").alias("row"), F.col(text).alias("text"))
    keyed = line_keys(df, distance, least_chars, "text")
    shared = keyed.groupBy("key").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).filter("lo < hi").select("key")
    keyed = scratch(spark, keyed.join(shared, "key", "left_semi").distinct(), "line-keys")
    lines = df.select("doc", F.coalesce("row", F.lit(LAST)).alias("row"), F.posexplode(F.split("text", "\n", -1)).alias("no", "line")).filter((F.length("line") >= (least_chars if least_equal is None else least_equal)) & ((F.length("line") >= least_chars) | F.col("line").rlike(FILLED))).withColumn("id", F.xxhash64("line"))
    first = lines.filter(F.length("line") >= least_chars).join(keyed.select("id").distinct(), "id", "left_semi").groupBy("id").agg(F.min(F.struct("doc", "no", "row", "line")).alias("f")).select("id", "f.doc", "f.no", "f.row", "f.line")
    near = line_links(keyed, first, distance, limit).groupBy("id").agg(F.sum("n").alias("n"), F.min(F.struct("doc", "no", "row")).alias("near"))
    near = scratch(spark, near, "line-links")
    places = scratch(spark, lines.select("id", "doc", "no", "row"), "line-places")
    all_ = places.groupBy("id").agg(F.min(F.struct("doc", "no", "row")).alias("f"), F.count("*").alias("k")).join(near, "id", "left").filter("k > 1 OR near IS NOT NULL")
    best = scratch(spark, all_.select("id", "k", F.least("f", "near").alias("best"), F.coalesce("n", F.lit(0)).alias("n")), "line-best")
    gone = hot_join(places, best, "id", "k", "inner").filter("struct(doc, no, row) > best")
    return gone.groupBy("doc", "row").agg(F.sort_array(F.collect_set("no")).alias("lines"), F.sum("n").alias("links")).select(F.col("doc").alias("doc_id"), "row", "lines", "links")


def without_lines(docs: DataFrame, gone: DataFrame, text: str = "text", doc_id: str = "doc_id", row: str | None = None) -> DataFrame:
    """docs without those lines, with n_removed and n_links (long); row: as given to repeated_lines."""
    gone = gone.select(F.col("row").alias("_doc"), F.col("lines").alias("_gone"), F.col("links").alias("_links"))
    df = docs.withColumn("_doc", F.coalesce(F.col(row or doc_id).cast("long"), F.lit(LAST))).join(gone, "_doc", "left")
    kept = F.filter(F.split(text, "\n", -1), lambda x, i: ~F.array_contains("_gone", i))
    df = df.withColumn(text, F.when(F.col("_gone").isNull(), F.col(text)).otherwise(F.array_join(kept, "\n")))
    return df.withColumns({"n_removed": F.coalesce(F.size("_gone"), F.lit(0)).cast("long"), "n_links": F.coalesce("_links", F.lit(0)).cast("long")}).drop("_doc", "_gone", "_links")


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    docs = with_row(table(spark, sf_dir, "documents").select("doc_id", "text"), "row")
    out = without_lines(docs.withColumn("n_lines", F.coalesce(F.size(F.split("text", "\n", -1)), F.lit(0)).cast("long")), repeated_lines(docs, row="row", least_equal=1), row="row")
    return out.select("doc_id", "n_lines", F.when(F.col("n_removed") < 0, 0).otherwise(F.col("n_removed")).alias("n_removed"), "n_links", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without repeated lines; one whose lines all go (all repeated elsewhere before) goes too."""
    small_batches(spark)
    key = next(k for k in (f"_key{n}" for n in range(len(docs.columns) + 1)) if k not in docs.columns)
    rows = with_row(docs, key)
    out = without_lines(apart(rows, "doc_id", "text", key), repeated_lines(rows, row=key, least_equal=1), row=key)
    return together(out.filter((F.col("n_removed") <= 0) | F.col("text").rlike(FILLED)), docs, "doc_id", "text")
