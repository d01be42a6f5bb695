"""SimHash near-dedup: fingerprints of word shingles, a byte-position inverted index with count filtering, components.

near_duplicates links 64-bit fingerprints within a few bits, exactly. similar_documents finds documents by the Jaccard
similarity of their shingles: a fingerprint of 64 bits is too coarse for 0.8, so it indexes the bytes of a wide one,
made of several seeded fingerprints, tallies shared positional bytes, and verifies on the exact sets.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .blocks import dealt_blocks, in_blocks, pair_steps
from .common import LOWER, components, give_back, hot_join, local_components, mixed, scratch, small_batches, table, with_row

SEED = 42
#: The wide fingerprint's words of 64 bits that are indexed; one more tells most strangers of a list apart.
WORDS = 16
#: Lists of the wide index that a document stands in: how many, and how many positional bytes each joins.
LISTS, TAKE = 256, 3
#: Differing bits of the last word up to which two documents of a list are candidates: at a similarity of 0.8 ten are
#: expected and more than 22 come once in 30,000 pairs.
STRANGE = 22
#: Documents whose lists a task sorts at once, list entries in a bucket, and in a message (20 bytes each: messages are
#: kept small, as Spark reads thousands of rows at a time).
HELD, BUCKET, MESSAGE = 512, 1 << 18, 512


def fingerprint(text: bytes, shingle: int) -> int:
    """64 bits, each set if it is in over half of the shingles' XXH64; repeats count; no words: 0."""
    w = text.translate(LOWER).split()
    if not w:
        return 0
    if len(w) < shingle:
        return xxhash.xxh64_intdigest(b" ".join(w), SEED)
    n, bits = len(w) - shingle + 1, np.zeros(64, dtype=np.int64)
    for lo in range(0, n, 1 << 15):
        hi = min(n, lo + (1 << 15))
        grams = map(b" ".join, zip(*(w[lo + k : hi + k] for k in range(shingle)), strict=True))
        h = np.fromiter((xxhash.xxh64_intdigest(g, SEED) for g in grams), dtype=np.uint64, count=hi - lo)
        bits += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * bits > n, bitorder="little").view(np.uint64)[0])


def simhash(docs: DataFrame, shingle: int, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, fp): the fingerprint of every whole text as a signed 64-bit integer; null counts as empty: 0."""
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1)
            fp = np.fromiter((fingerprint(t.as_buffer().to_pybytes() if t.is_valid else b"", shingle) for t in texts), dtype=np.uint64, count=len(texts))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("binary").alias("text")).mapInArrow(run, f"doc_id {kind}, fp long")


def postings(fps: DataFrame, bits: int, positions: int) -> DataFrame:
    """(key, fp): the lists of the byte-position index that a fingerprint stands in.

    Two fingerprints that differ in at most `bits` bits differ in at most that many bytes, so among any `positions` of
    the eight they share at least positions - bits positional bytes. A list of one byte holds a 256th of all
    fingerprints; lists of that many positional bytes together lose no pair and stay short.
    """
    take = positions - bits
    if not 1 <= take <= 7 or positions > 8:
        raise ValueError("positions must leave 1 to 7 bytes to share")

    def byte(p: int) -> Column:
        return F.shiftrightunsigned("fp", 8 * p).bitwiseAND(F.lit(255))

    keys = []
    for k, chosen in enumerate(combinations(range(positions), take)):
        key = F.lit(k).cast("long")
        for p in chosen:
            key = F.shiftleft(key, 8).bitwiseOR(byte(p))
        keys.append(key)
    return fps.select(F.explode(F.array(*keys)).alias("key"), "fp")


def fingerprint_links(fps: DataFrame, bits: int = 2, positions: int = 6, limit: int = 1024) -> DataFrame:
    """(a, b): edges that connect distinct fingerprints exactly as pairs of at most `bits` differing bits do.

    Each list tallies the shared positional bytes of its pairs, keeps those with 8 - bits or more, verifies the bits,
    and gives a spanning forest of what it found: no more rows than list entries, however large a group of near copies.
    """
    dealt = dealt_blocks(postings(fps, bits, positions), "key", F.col("fp"), limit)

    def run(rows: pa.Table, group: np.ndarray) -> Iterator[pa.RecordBatch]:
        fp = rows.column(1).to_numpy().view(np.uint64)
        part, cross = rows.column(2).to_numpy(), rows.column(3).to_numpy() != rows.column(4).to_numpy()
        ends = []
        for a, b in pair_steps(group, part, cross):
            differ = fp[a] ^ fp[b]
            tally = (differ.view(np.uint8).reshape(-1, 8) == 0).sum(axis=1)
            ok = np.flatnonzero(tally >= 8 - bits)
            ok = ok[np.bitwise_count(differ[ok]) <= bits]
            ends.append((a[ok], b[ok]))
        if ends:
            a, b = (np.concatenate(x) for x in zip(*ends, strict=True))
            nodes, at = np.unique(fp, return_inverse=True)
            root = local_components(at[a], at[b], len(nodes))
            far = np.flatnonzero(root != np.arange(len(nodes)))
            if len(far):
                yield pa.RecordBatch.from_arrays([pa.array(nodes[far].view(np.int64)), pa.array(nodes[root[far]].view(np.int64))], ["a", "b"])

    return in_blocks(dealt, "key", run, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, shingle: int = 3, bits: int = 2, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, fp, component_id): fingerprint and smallest doc_id of the documents reachable by links, itself included.

    Documents with equal fingerprints are one node, so that exact copies cost one row in the index. Null and empty
    texts have fingerprint zero and link like any other; null doc_ids never stand for a component (one of null ids only
    has a null component_id); repeated rows give a row each; an empty table gives no row.
    """
    small_batches(docs.sparkSession)
    spark = docs.sparkSession
    marked = scratch(spark, simhash(docs, shingle, text, doc_id), "simhash")
    fps = marked.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n"))
    linked = components(scratch(spark, fingerprint_links(fps.select("fp"), bits), "simhash-links"))
    named = fps.join(linked.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    least = named.groupBy("component").agg(F.min("first_id").alias("component_id"))
    by_fp = scratch(spark, named.join(least, "component").select("fp", "n", "component_id"), "simhash-named")
    return hot_join(marked, by_fp, "fp", "n", "inner").select("doc_id", "fp", "component_id")


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def shingles(text: bytes, width: int) -> np.ndarray:
    """Sorted distinct XXH64 of the runs of width words (of all words, if they are fewer); no words: none."""
    w = text.translate(LOWER).split()
    grams = map(b" ".join, zip(*(w[k:] for k in range(width)), strict=False)) if len(w) > width else [b" ".join(w)] if w else []
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(g, SEED) for g in grams), dtype=np.uint64))


def wide(found: np.ndarray, words: int = WORDS + 1) -> np.ndarray:
    """8 * words bytes: a seeded fingerprint of a set of shingles a word; a bit is 1 if set in over half of them."""
    times = mixed(np.arange(1, words + 1, dtype=np.uint64)) | np.uint64(1)
    total = np.zeros(64 * words, dtype=np.int64)
    for lo in range(0, len(found), 255):  # as many as a byte can count
        bits = np.unpackbits(mixed(found[lo : lo + 255, None] * times).view(np.uint8), axis=1, bitorder="little")
        total += np.add.reduce(bits, axis=0, dtype=np.uint8)
    return np.packbits(2 * total > len(found), bitorder="little")


def lists(seed: int = 3) -> np.ndarray:
    """(LISTS, TAKE): the positions whose bytes make each list's key, seeded and distinct."""
    rng, found = np.random.default_rng(seed), set()
    while len(found) < LISTS:
        found.add(tuple(sorted(rng.choice(8 * WORDS, TAKE, replace=False).tolist())))
    return np.array(sorted(found))


def leaders(key: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, left) of entries in the order of their keys: within each key the first entry that is left leads, the others
    within STRANGE bits of its word follow it and leave, until none is left; left: the leaders."""
    a, b, left = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    rows = np.arange(len(key))
    while len(rows):
        first = np.append(True, key[rows[1:]] != key[rows[:-1]])
        lead = rows[np.flatnonzero(first)][np.cumsum(first) - 1]
        left.append(rows[first])
        near = np.bitwise_count(word[rows] ^ word[lead]) <= STRANGE
        follow = near & ~first
        a.append(lead[follow])
        b.append(rows[follow])
        rows = rows[~near]
    return np.concatenate(a), np.concatenate(b), np.sort(np.concatenate(left))


def wide_links(nodes: DataFrame) -> DataFrame:
    """(a, b): edges that connect the candidates among nodes (node, wide).

    Two documents of similarity s differ in a share of acos(2s / (1 + s)) / pi of their bits: at 0.8 15 %, so that they share
    a byte with probability 0.27 and some list with 0.970 (at 0.85 with 0.997, at 0.9 with 0.99998). A task first lets the
    documents that it holds follow their lists' leaders and sends on leaders alone, under the name of the group that
    they connect, sorted arrays a bucket: lists of a large group of near copies shrink before they are shuffled. Tasks and
    buckets give a spanning forest of what they found. A message holds an entry at least, so that there are no
    more messages than entries.
    """
    places = lists()
    salt = (np.arange(LISTS, dtype=np.uint64) + np.uint64(1)) << np.uint64(8 * TAKE)
    buckets = max(1, -(-nodes.count() * LISTS // BUCKET))

    def sent(node: np.ndarray, fp: np.ndarray) -> Iterator[tuple[int, bytes]]:
        value = np.zeros((len(node), LISTS), dtype=np.uint64)
        for k in range(TAKE):
            value = value << np.uint64(8) | fp[:, places[:, k]]
        key = mixed(value | salt).reshape(-1)
        at = np.repeat(np.arange(len(node)), LISTS)
        word = np.ascontiguousarray(fp[:, 8 * WORDS :]).view(np.uint64)[:, 0]
        order = np.argsort(key, kind="stable")
        key, at = key[order], at[order]
        a, b, left = leaders(key, word[at])
        root = local_components(at[a], at[b], len(node))
        far = np.flatnonzero(root != np.arange(len(node)))
        pairs = node[np.stack([far, root[far]])]
        for lo in range(0, pairs.shape[1], MESSAGE):
            yield -1 - int(far[lo] % buckets), pairs[:, lo : lo + MESSAGE].tobytes()
        # a list's leader speaks for its whole group, under the group's name, and once
        key, at = key[left], at[left]
        order = np.lexsort([root[at], key])
        key, at = key[order], at[order]
        one = np.append(True, (key[1:] != key[:-1]) | (root[at[1:]] != root[at[:-1]]))
        key, at = key[one], at[one]
        bucket = (key >> np.uint64(32)) % np.uint64(buckets)
        order = np.argsort(bucket, kind="stable")
        key, at, bucket = key[order].astype(np.uint32), at[order], bucket[order].astype(np.int64)
        starts = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
        for first, end in zip(starts.tolist(), np.append(starts[1:], len(bucket)).tolist(), strict=True):
            for lo in range(first, end, MESSAGE):
                hi = min(end, lo + MESSAGE)
                yield int(bucket[lo]), key[lo:hi].tobytes() + word[at[lo:hi]].tobytes() + node[root[at[lo:hi]]].tobytes()

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def flush() -> pa.RecordBatch:
            rows = pa.Table.from_batches(held)
            fp = np.frombuffer(b"".join(v.as_buffer() for v in rows.column(1)), dtype=np.uint8).reshape(len(rows), -1)
            return pa.RecordBatch.from_arrays([pa.array(v, type=t) for v, t in zip(zip(*sent(rows.column(0).to_numpy(), fp), strict=True), (pa.int32(), pa.binary()), strict=True)], ["bucket", "data"])

        for batch in batches:
            for lo in range(0, len(batch), HELD):
                held.append(batch.slice(lo, HELD))
                if sum(map(len, held)) >= HELD:
                    yield flush()
                    held = []
        if held:
            yield flush()
        give_back()

    def run(rows: pa.Table) -> pa.Table:
        if rows.column("bucket")[0].as_py() < 0:  # groups that a task found
            pairs = np.concatenate([np.frombuffer(data.as_buffer(), dtype=np.int64).reshape(2, -1) for data in rows.column("data")], axis=1)
            return pa.table({"a": pa.array(pairs[0]), "b": pa.array(pairs[1])})
        columns: tuple[list, list, list] = ([], [], [])
        for data in rows.column("data"):
            raw = data.as_buffer()
            n = len(raw) // 20
            for column, v in zip(columns, (np.frombuffer(raw, np.uint32, n), np.frombuffer(raw, np.uint64, n, 4 * n), np.frombuffer(raw, np.int64, n, 12 * n)), strict=True):
                column.append(v)
        key, word, node = map(np.concatenate, columns)
        order = np.lexsort([node, key])
        key, word, node = key[order], word[order], node[order]
        a, b, _ = leaders(key, word)
        nodes_, at = np.unique(node[np.append(a, b)], return_inverse=True)
        root = local_components(at[: len(a)], at[len(a) :], len(nodes_))
        far = np.flatnonzero(root != np.arange(len(nodes_)))
        return pa.table({"a": pa.array(nodes_[far]), "b": pa.array(nodes_[root[far]])})

    return nodes.select("node", "wide").mapInArrow(post, "bucket int, data binary").groupBy("bucket").applyInArrow(run, "a long, b long")


def alike(sets: list[np.ndarray], fp: np.ndarray, least: float) -> tuple[list[int], list[int]]:
    """A spanning forest of the pairs that share TAKE positional bytes or more and have a Jaccard similarity of least or
    more; a set once reached isn't compared again."""
    size = np.array([len(s) for s in sets])
    starts = np.cumsum(size) - size
    _, ids = np.unique(np.concatenate(sets), return_inverse=True)
    flag, unseen, a, b = np.zeros(len(ids), dtype=bool), np.ones(len(sets), dtype=bool), [], []
    for first in range(len(sets)):
        queue = [first] if unseen[first] else []
        unseen[first] = False
        while queue:
            x = queue.pop()
            open_ = unseen & (np.minimum(size, size[x]) / np.maximum(size, size[x]) >= least)
            open_[open_] = (fp[open_] == fp[x]).sum(axis=1) >= TAKE
            at = np.flatnonzero(open_)
            if not len(at):
                continue
            own = ids[starts[x] : starts[x] + size[x]]
            flag[own] = True
            if 4 * size[at].sum() > len(ids):
                both = np.add.reduceat(flag[ids], starts, dtype=np.int64)[at]
            else:
                both = np.array([flag[ids[starts[k] : starts[k] + size[k]]].sum() for k in at])
            flag[own] = False
            hit = at[both / (size[at] + size[x] - both) >= least].tolist()
            unseen[hit] = False
            queue += hit
            a += [x] * len(hit)
            b += hit
    return a, b


def similar_documents(docs: DataFrame, shingle: int = 5, least: float = 0.8, limit: int = 512, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """docs with one row of each group connected by pairs of a Jaccard similarity of least or more of their sets of word
    shingles: that with the smallest doc_id (of several, one of them).

    Equal sets are one node. Rows of one doc_id are judged each by its own text. Null texts and those without words are one group; rows
    without a doc_id link others and stay; an empty table gives no row. Lists of the wide index name candidates
    (wide_links); their components are dealt into blocks of bounded size, where each pair's shared positional bytes are
    tallied, pairs that reach TAKE are retained and judged on the exact sets.
    """
    spark = docs.sparkSession
    key = next(k for k in (f"_key{n}" for n in range(len(docs.columns) + 1)) if k not in docs.columns)
    all_ = with_row(docs, key)
    texts = all_.select(F.col(key).alias("row"), F.col(text).cast("binary").alias("text"))
    kind = docs.schema[doc_id].dataType.simpleString()

    def sets_of(column: pa.Array) -> Iterator[np.ndarray]:
        return (shingles(t.as_buffer().to_pybytes() if t.is_valid else b"", shingle) for t in column)

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(xxhash.xxh64_intdigest(s.tobytes(), SEED), wide(s).tobytes() if len(s) else None) for s in sets_of(batch.column(2))]
            nodes = np.array([n for n, _ in found], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(nodes), pa.array([f for _, f in found], type=pa.binary())], ["row", "doc_id", "node", "wide"])
        give_back()

    marked = all_.select(F.col(key).alias("row"), F.col(doc_id).alias("doc_id"), F.col(text).cast("binary").alias("text"))
    marked = scratch(spark, marked.mapInArrow(mark, f"row long, doc_id {kind}, node long, wide binary"), "wide-marked")
    groups = scratch(spark, marked.groupBy("node").agg(F.min("row").alias("row"), F.count("*").alias("n")), "wide-groups")
    nodes = scratch(spark, marked.filter("wide IS NOT NULL").join(groups.select("row"), "row", "left_semi").select("node", "row", "wide"), "wide-nodes")
    together = components(scratch(spark, wide_links(nodes).distinct(), "wide-candidates"))
    members = nodes.join(together, "node")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array([s.tobytes() for s in sets_of(batch.column(3))], type=pa.binary())], ["component", "node", "wide", "found"])

    found = texts.join(members, "row").select("component", "node", "wide", "text").mapInArrow(sets, "component long, node long, wide binary, found binary")

    def run(rows: pa.Table, group: np.ndarray) -> Iterator[pa.RecordBatch]:
        node, column = rows.column(1).to_numpy(), rows.column(3)
        fp = np.frombuffer(b"".join(v.as_buffer() for v in rows.column(2)), dtype=np.uint8).reshape(len(rows), -1)[:, : 8 * WORDS]
        ends = np.append(np.flatnonzero(group[1:] != group[:-1]) + 1, len(group))
        for lo, hi in zip(np.append(0, ends[:-1]), ends, strict=True):
            a, b = alike([np.frombuffer(column[k].as_py(), dtype=np.uint64) for k in range(lo, hi)], fp[lo:hi], least)
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(node[lo:hi][a]), pa.array(node[lo:hi][b])], ["a", "b"])

    dealt = dealt_blocks(scratch(spark, found, "wide-sets"), "component", F.col("node"), limit)
    linked = components(scratch(spark, in_blocks(dealt, "component", run, "a long, b long"), "wide-links"))
    known = groups.join(linked, "node", "left").select("node", "n", F.coalesce("component", "node").alias("group"))
    named = hot_join(marked.filter("doc_id IS NOT NULL").select("row", "doc_id", "node"), scratch(spark, known, "wide-named"), "node", "n", "inner").select("row", "doc_id", "group")
    named = scratch(spark, named, "wide-rows")
    first = named.groupBy("group").agg(F.min(F.struct("doc_id", "row")).alias("first"), F.count("*").alias("n")).filter("n > 1")
    gone = hot_join(named, scratch(spark, first, "wide-first"), "group", "n", "inner").filter("struct(doc_id, row) > first").select(F.col("row").alias(key))
    return all_.join(gone, key, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity of 0.8 or more): that with the smallest
    doc_id. Rows without a doc_id can't be named and stay."""
    small_batches(spark)
    return similar_documents(docs)
