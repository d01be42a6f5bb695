"""Suffix-array dedup: repeated 50-byte strings by depth-limited radix passes over the corpus's suffixes.

Suffixes need an order only through their first `length` bytes: suffixes that agree so far are exactly the repeated
windows. The passes go from coarse to fine, and a suffix that stands alone in its group leaves:
1. Windows are grouped by their minimizer, the least hash of the strings of `anchor` bytes within; equal windows have equal
   minimizers, so this pass loses none. Only minimizers (about one in twelve bytes) are sent, as 31 bits of a hash; those
   found in one document only leave.
2. Neighbouring windows of one minimizer are sent as one run of text, so that a window costs about six bytes. Within a
   minimizer, suffixes are ordered by their own bytes, most significant first, eight a pass; after each pass groups of one
   document leave. What is left after byte `length` is equal, byte by byte, and knows its smallest document.
The corpus is dealt into chunks of whole documents; a chunk sends sorted arrays, one a radix bucket, and gets back which
minimizers go on, then a bit for each window that it sent. A chunk sends equal runs once, with their smallest document, so
that a hot passage costs a bucket no more than a run a chunk; a message holds an entry at least, so messages are never more
than entries. Exact copies of a document are set aside first by a grouping of text digests.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import INVERSE, hot_join, in_chunks, mixed, powers, prefix_sums, scratch, small_batches, span_hash, table, with_row

LAST = 2**63 - 1
#: Bytes of text in a chunk, in a part of it handled at once, and sent to one radix bucket.
CHUNK, PART, BUCKET = 8 << 20, 1 << 19, 24 << 20
#: Windows that a bucket orders at once (more if one minimizer has more).
WINDOWS = 1 << 20
SENT = "bucket int, chunk int, data binary"
#: kind: 0 row keys of exact copies, -1 - bucket minimizers that go on, 1 + bucket a bit for each window sent.
REPLY = "chunk int, kind int, data binary"


def slide(a: np.ndarray, width: int, op) -> np.ndarray:
    """op over every run of width elements, by doubling."""
    span = 1
    while 2 * span <= width:
        a = op(a[:-span], a[span:])
        span *= 2
    return op(a[: len(a) - (width - span)], a[width - span :]) if span < width else a


class Part:
    """Some texts end to end: their minimizers, and hashes of their windows."""

    def __init__(self, texts: list[bytes], length: int, anchor: int):
        self.length, self.anchor = length, anchor
        pad = b"\0" * length  # so that every byte has a window to look at; windows over an end don't count
        self.buf = np.frombuffer(b"".join(texts) + pad, dtype=np.uint8)
        self.sizes = np.array([len(t) for t in texts], dtype=np.int64)
        self.n = int(self.sizes.sum())
        self.doc = np.repeat(np.arange(len(texts)), self.sizes)
        ends = np.repeat(np.cumsum(self.sizes), self.sizes)
        self.whole = np.arange(self.n) + length <= ends
        self.sums = prefix_sums(self.buf)
        count = self.n + length - anchor + 1
        self.hash = mixed((self.sums[anchor : anchor + count] - self.sums[:count]) * powers(INVERSE, count))
        self.least = slide(self.hash, length - anchor + 1, np.minimum)[: self.n]

    def minimizers(self) -> np.ndarray:
        """Places of the strings that are the least of some whole window."""
        width = self.length - self.anchor + 1
        held = np.where(self.whole, self.least, np.uint64(0))
        edge = np.zeros(width - 1, dtype=np.uint64)
        most = slide(np.concatenate([edge, held, edge]), width, np.maximum)[: len(self.hash)]
        return np.flatnonzero((most == self.hash[: len(most)]) & (most > 0))

    def open_windows(self, left: np.ndarray, buckets: int) -> np.ndarray:
        """Places of the whole windows whose minimizer is among left (sorted places of buckets)."""
        at = self.minimizers()
        stays = np.full(len(self.hash), np.uint64(2**64 - 1))
        yes = at[isin(bucketed(self.hash[at], buckets), left)]
        stays[yes] = self.hash[yes]
        best = slide(stays, self.length - self.anchor + 1, np.minimum)[: self.n]
        return np.flatnonzero(self.whole & (best == self.least) & (best < np.uint64(2**64 - 1)))

    def runs(self, left: np.ndarray, buckets: int) -> tuple[np.ndarray, ...]:
        """Runs of neighbouring open windows with one minimizer: place, windows, document, bucketed minimizer, a hash."""
        at = self.open_windows(left, buckets)
        least, doc = self.least[at], self.doc[at]
        new = np.append(True, (at[1:] != at[:-1] + 1) | (least[1:] != least[:-1]) | (doc[1:] != doc[:-1]))[: len(at)]
        first = np.flatnonzero(new)
        size = np.diff(np.append(first, len(at)))
        start = at[first]
        return start, size, doc[first], bucketed(least[first], buckets), span_hash(self.sums, start, start + size + (self.length - 1))


def bucketed(h: np.ndarray, buckets: int) -> np.ndarray:
    """bucket * 2^31 + 31 other bits of a hash."""
    return ((h >> np.uint64(32)) % np.uint64(buckets)) << np.uint64(31) | (h & np.uint64(2**31 - 1))


def isin(values: np.ndarray, among: np.ndarray) -> np.ndarray:
    if not len(among):
        return np.zeros(len(values), dtype=bool)
    at = np.searchsorted(among, values)
    at[at == len(among)] = 0
    return among[at] == values


def parts(rows: pa.Table, copies: set[int], length: int, anchor: int) -> Iterator[tuple[np.ndarray, Part]]:
    """The documents' places in rows and texts, a part at a time, without exact copies and texts shorter than a window."""
    places, texts, size = [], [], 0
    for k, (row, text) in enumerate(zip(rows.column("row").to_pylist(), rows.column("text"), strict=True)):
        t = text.as_buffer().to_pybytes()
        if len(t) < length or row in copies:
            continue
        places.append(k)
        texts.append(t)
        size += len(t)
        if size >= PART:
            yield np.array(places), Part(texts, length, anchor)
            places, texts, size = [], [], 0
    if texts:
        yield np.array(places), Part(texts, length, anchor)


def ids_of(rows: pa.Table) -> np.ndarray:
    return rows.column("doc_id").to_numpy() if len(rows) else np.empty(0, np.int64)


def replies(rows: pa.Table) -> dict[int, bytes]:
    """A chunk's replies by kind; a kind's parts one after another."""
    out: dict[int, bytes] = {}
    for k, d in zip(rows.column("kind").to_pylist(), rows.column("data"), strict=True) if len(rows) else ():
        out[k] = out.get(k, b"") + d.as_py()
    return out


def copies_of(found: dict[int, bytes]) -> set[int]:
    return set(np.frombuffer(found.get(0, b""), dtype=np.int64).tolist())


def left_of(found: dict[int, bytes]) -> np.ndarray:
    """The sorted places of the minimizers that go on."""
    kept = [np.frombuffer(d, dtype=np.uint32).astype(np.uint64) | np.uint64((-1 - k) << 31) for k, d in found.items() if k < 0]
    return np.sort(np.concatenate([np.empty(0, np.uint64), *kept]))


def smallest(keys: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys, the smallest document of each, and whether it has several."""
    order = np.lexsort([docs, keys])
    keys, docs = keys[order], docs[order]
    at = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.empty(0, dtype=np.int64)
    last = np.append(at[1:], len(keys)) - 1 if len(at) else at
    return keys[at], docs[at], docs[last] != docs[at]


def sent_minimizers(length: int, anchor: int, buckets: int):
    def run(rows: pa.Table, right: pa.Table) -> pa.Table:
        copies, keys, docs, several = copies_of(replies(right)), [np.empty(0, np.uint64)], [np.empty(0, np.int64)], [np.empty(0, bool)]
        ids = ids_of(rows)
        for places, part in parts(rows, copies, length, anchor) if len(rows) else ():
            at = part.minimizers()
            k, d, more = smallest(bucketed(part.hash[at], buckets), ids[places][part.doc[np.minimum(at, part.n - 1)]])
            keys.append(k)
            docs.append(d)
            several.append(more)
        keys, docs, several = np.concatenate(keys), np.concatenate(docs), np.concatenate(several)
        one, _, more = smallest(keys, docs)
        more[np.searchsorted(one, keys[several])] = True
        data = ((one & np.uint64(2**31 - 1)) << np.uint64(1) | more.astype(np.uint64)).astype(np.uint32)
        return sent(rows, (one >> np.uint64(31)).astype(np.int64), lambda a, b: data[a:b].tobytes())

    return run


def sent(rows: pa.Table, bucket: np.ndarray, data) -> pa.Table:
    """A row a bucket (in order) with data(from, to)."""
    at = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])) if len(bucket) else np.empty(0, dtype=np.int64)
    ends = np.append(at[1:], len(bucket)) if len(at) else at
    chunk = rows.column("chunk")[0].as_py() if len(rows) else 0
    return pa.table({"bucket": pa.array(bucket[at].astype(np.int32)), "chunk": pa.array(np.full(len(at), chunk, dtype=np.int32)), "data": pa.array([data(a, b) for a, b in zip(at, ends, strict=True)], type=pa.binary())})


def answered(found: dict[int, bytes], kind: int) -> pa.Table:
    return pa.table({"chunk": pa.array(list(found), type=pa.int32()), "kind": pa.array([kind] * len(found), type=pa.int32()), "data": pa.array(list(found.values()), type=pa.binary())})


def shared_minimizers(rows: pa.Table) -> pa.Table:
    """Which minimizers of a bucket stand in two documents or more, told to each chunk that has them."""
    each = {c.as_py(): np.frombuffer(d.as_py(), dtype=np.uint32) for c, d in zip(rows.column("chunk"), rows.column("data"), strict=True)}
    all_ = np.concatenate(list(each.values()))
    keys, n = np.unique(all_ >> 1, return_counts=True)
    left = np.union1d(keys[n > 1], all_[(all_ & 1) == 1] >> 1)
    return answered({c: (v >> 1)[isin(v >> 1, left)].tobytes() for c, v in each.items()}, -1 - rows.column("bucket")[0].as_py())


class Runs:
    """The distinct runs of a chunk, each with its smallest document."""

    def __init__(self, length: int):
        self.length, self.number = length, {}
        self.doc: list[int] = []
        self.columns: tuple[list, list, list] = ([], [], [])

    def add(self, part: Part, ids: np.ndarray, start: np.ndarray, size: np.ndarray, doc: np.ndarray, key: np.ndarray, h: np.ndarray) -> np.ndarray:
        """The numbers of a part's runs; ids: the document of each text of the part."""
        raw, number, least, new = part.buf.tobytes(), self.number, self.doc, []
        out = np.empty(len(start), dtype=np.int64)
        for k, (lo, hi, d) in enumerate(zip(start.tolist(), (start + size + (self.length - 1)).tolist(), ids[doc].tolist(), strict=True)):
            text = raw[lo:hi]
            n = number.setdefault(text, len(least))
            if n == len(least):
                least.append(d)
                new.append(k)
            elif d < least[n]:
                least[n] = d
            out[k] = n
        for column, v in zip(self.columns, (size, key, h), strict=True):
            column.append(v[new])
        return out

    def ordered(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
        """(order, doc, size, key, texts): order sorts the runs by bucket, document, hash and text, whatever order they came in."""
        size, key, h = (np.concatenate([np.empty(0, kind), *v]) for kind, v in zip((np.int64, np.uint64, np.uint64), self.columns, strict=True))
        doc, texts, bucket = np.array(self.doc, dtype=np.int64), list(self.number), key >> np.uint64(31)
        order = np.lexsort([h, doc, bucket])
        tie = np.flatnonzero((h[order[1:]] == h[order[:-1]]) & (doc[order[1:]] == doc[order[:-1]]) & (bucket[order[1:]] == bucket[order[:-1]]))
        if len(tie):
            order = np.array(sorted(order.tolist(), key=lambda k: (int(bucket[k]), int(doc[k]), int(h[k]), texts[k])))
        return order, doc, size, key, texts


def chunk_runs(rows: pa.Table, found: dict[int, bytes], length: int, anchor: int, buckets: int, runs: Runs):
    """(documents' places in rows, sizes, documents, places, windows, run numbers) of each part; fills runs."""
    left, ids = left_of(found), ids_of(rows)
    for places, part in parts(rows, copies_of(found), length, anchor) if len(rows) and len(left) else ():
        start, size, doc, key, h = part.runs(left, buckets)
        yield places, part.sizes, doc, start, size, runs.add(part, ids[places], start, size, doc, key, h)


def sent_runs(length: int, anchor: int, buckets: int):
    def run(rows: pa.Table, right: pa.Table) -> pa.Table:
        runs = Runs(length)
        for _ in chunk_runs(rows, replies(right), length, anchor, buckets, runs):
            pass
        order, doc, size, key, texts = runs.ordered()
        doc, size, key = doc[order], size[order].astype(np.uint32), key[order]

        def data(a: int, b: int) -> bytes:
            """How many documents and runs; the documents, how many runs each has; the runs' minimizers, windows and texts."""
            at = np.flatnonzero(np.append(True, doc[a + 1 : b] != doc[a : b - 1]))
            head = np.concatenate([[len(at), b - a], doc[a:b][at], np.diff(np.append(at, b - a))]).astype(np.int64)
            return b"".join([head.tobytes(), (key[a:b] & np.uint64(2**31 - 1)).astype(np.uint32).tobytes(), size[a:b].tobytes(), *(texts[k] for k in order[a:b].tolist())])

        return sent(rows, (key >> np.uint64(31)).astype(np.int64), data)

    return run


def repeated(buf: np.ndarray, key: np.ndarray, at: np.ndarray, doc: np.ndarray, length: int) -> np.ndarray:
    """Which of the windows at those places of buf also stand in a smaller document; key: their minimizers, sorted.

    One pass for every eight bytes: the windows of each group are ordered by their next bytes, equal ones make the new
    groups, and groups of a single document leave.
    """
    digits = np.lib.stride_tricks.sliding_window_view(buf, 8)
    out, rows, group = np.zeros(len(at), dtype=bool), np.arange(len(at)), key.astype(np.uint64)
    for depth in range(0, length, 8):
        digit = np.ascontiguousarray(digits[at[rows] + depth]).view(">u8")[:, 0].astype(np.uint64)
        if depth + 8 > length:
            digit >>= np.uint64(8 * (depth + 8 - length))
        order = np.lexsort([digit, group])
        rows, group, digit = rows[order], group[order], digit[order]
        first = np.flatnonzero(np.append(True, (group[1:] != group[:-1]) | (digit[1:] != digit[:-1])))
        d = doc[rows]
        several = np.minimum.reduceat(d, first) < np.maximum.reduceat(d, first)
        sizes = np.diff(np.append(first, len(rows)))
        stay = np.repeat(several, sizes)
        rows, group = rows[stay], np.repeat(np.arange(several.sum(), dtype=np.uint64), sizes[several])
        if not len(rows):
            return out
    first = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
    least = np.repeat(np.minimum.reduceat(doc[rows], first), np.diff(np.append(first, len(rows))))
    out[rows[doc[rows] > least]] = True
    return out


def earlier_windows(length: int):
    def run(rows: pa.Table) -> pa.Table:
        """Which windows of a bucket stand in a document smaller than any that a chunk has their run in: a bit for each it sent."""
        number: dict[bytes, int] = {}
        keys: list[int] = []
        sizes: list[int] = []
        each = {}
        for c, data in zip(rows.column("chunk").to_pylist(), rows.column("data"), strict=True):
            raw = data.as_py()
            docs, n = np.frombuffer(raw, np.int64, 2).tolist()
            named, counts = np.frombuffer(raw, np.int64, 2 * docs, 16).reshape(2, -1)
            at = 16 + 16 * docs
            key, size = np.frombuffer(raw, np.uint32, 2 * n, at).reshape(2, -1)
            ends = at + 8 * n + np.cumsum(size.astype(np.int64) + (length - 1))
            mine = np.empty(n, dtype=np.int64)
            lo = at + 8 * n
            for k, (hi, m, s) in enumerate(zip(ends.tolist(), key.tolist(), size.tolist(), strict=True)):
                g = number.setdefault(raw[lo:hi], len(keys))
                if g == len(keys):
                    keys.append(m)
                    sizes.append(s)
                mine[k] = g
                lo = hi
            each[c] = mine, np.repeat(named, counts)
        key, size = np.array(keys, dtype=np.int64), np.array(sizes, dtype=np.int64)
        least = np.full(len(key), LAST)
        for mine, doc in each.values():
            np.minimum.at(least, mine, doc)
        # windows of a minimizer whose runs all have the same smallest document are not repeats of a smaller one
        low, high = np.full(len(key), LAST), np.full(len(key), -(2**63))
        _, same = np.unique(key, return_inverse=True)
        np.minimum.at(low, same, least)
        np.maximum.at(high, same, least)
        open_ = np.flatnonzero(low[same] < high[same])
        open_ = open_[np.argsort(key[open_], kind="stable")]
        bits = np.zeros(int(size.sum()), dtype=bool)
        start = np.cumsum(size) - size
        buf = np.frombuffer(b"".join(number) + b"\0" * 8, dtype=np.uint8)
        place = np.cumsum(size + (length - 1)) - (size + (length - 1))
        lo = 0
        total = np.cumsum(size[open_])
        while lo < len(open_):
            hi = int(np.searchsorted(total, (total[lo - 1] if lo else 0) + WINDOWS, side="right"))
            hi = max(hi, lo + 1)
            while hi < len(open_) and key[open_[hi]] == key[open_[hi - 1]]:  # whole minimizers
                hi += 1
            g = open_[lo:hi]
            n = size[g]
            step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            bits[np.repeat(start[g], n) + step] = repeated(buf, np.repeat(key[g], n), np.repeat(place[g], n) + step, np.repeat(least[g], n), length)
            lo = hi
        told = {}
        for c, (mine, doc) in each.items():
            n = size[mine]
            step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            told[c] = np.packbits(bits[np.repeat(start[mine], n) + step] | np.repeat(least[mine] < doc, n)).tobytes()
        return answered(told, 1 + rows.column("bucket")[0].as_py())

    return run


def removed(kind: str, length: int, anchor: int, buckets: int):
    def run(rows: pa.Table, right: pa.Table) -> pa.Table:
        told = replies(right)
        copies, ids, runs = copies_of(told), ids_of(rows), Runs(length)
        kept_parts = list(chunk_runs(rows, told, length, anchor, buckets, runs))
        order, least, size, key, _ = runs.ordered()
        bucket = (key[order] >> np.uint64(31)).astype(np.int64)
        starts = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])[: len(bucket)])
        first, flags, at = np.zeros(len(order), dtype=np.int64), [np.empty(0, bool)], 0
        for lo, hi in pairwise(np.append(starts, len(bucket))):
            n = size[order[lo:hi]]
            first[order[lo:hi]] = at + np.cumsum(n) - n
            flags.append(np.unpackbits(np.frombuffer(told[1 + int(bucket[lo])], dtype=np.uint8), count=int(n.sum())).astype(bool))
            at += int(n.sum())
        flags = np.concatenate(flags)
        cover: dict[int, np.ndarray] = {}
        for places, sizes, doc, start, n, number in kept_parts:
            step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            gone = flags[np.repeat(first[number], n) + step] | np.repeat(least[number] < ids[places][doc], n)
            window = (np.repeat(start, n) + step)[gone]
            doc = np.repeat(doc, n)[gone]
            starts = np.cumsum(sizes) - sizes
            edges = np.flatnonzero(np.append(True, doc[1:] != doc[:-1])[: len(doc)])
            for lo, hi in pairwise(np.append(edges, len(doc))):
                cover[int(places[doc[lo]])] = window[lo:hi] - starts[doc[lo]]
        out: dict[str, list] = {"doc_id": [], "n_bytes": [], "n_removed": [], "n_spans": [], "kept": []}
        for at, (doc, row, text) in enumerate(zip(ids.tolist(), rows.column("row").to_pylist(), rows.column("text"), strict=True) if len(rows) else ()):
            t = text.as_buffer().to_pybytes()
            gone = np.zeros(len(t) + 1, dtype=np.int32)
            if row in copies and len(t) >= length:
                gone[:-1] = 1
            elif at in cover:
                np.add.at(gone, cover[at], 1)
                np.subtract.at(gone, cover[at] + length, 1)
                gone = np.cumsum(gone)
            mask = gone[:-1] > 0
            spans = int(np.count_nonzero(np.diff(mask.view(np.int8), prepend=np.int8(0)) == 1))
            kept = np.frombuffer(t, dtype=np.uint8)[~mask].tobytes() if mask.any() else t
            for name, v in zip(out, (doc, len(t), int(mask.sum()), spans, kept), strict=True):
                out[name].append(v)
        types = {"kept": pa.binary()}
        if kind == "digest":
            out["kept"] = [hashlib.sha256(k).hexdigest() for k in out["kept"]]
            types = {"kept": pa.string()}
        return pa.table({k: pa.array(v, type=types.get(k, pa.int64())) for k, v in out.items()})

    return run


def substring_dedup(docs: DataFrame, length: int = 50, anchor: int = 28, text: str = "text", doc_id: str = "doc_id", digest: bool = False) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept): texts without each byte covered by a `length`-byte string that also
    starts in a document with a smaller doc_id; strings are judged on the input. kept: the remaining bytes (or, with
    digest, their SHA-256).

    Null texts are empty; a null doc_id is larger than any other and comes back null; rows with the same doc_id don't
    count against each other, but each is judged by its own text; repeated rows give a row each; an empty table gives none.
    """
    rows = with_row(docs.select(doc_id, text), "row")
    rows = rows.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(LAST)).alias("doc_id"), "row", F.coalesce(F.col(text).cast("binary"), F.lit(b"")).alias("text"))
    rows, n = in_chunks(rows, F.col("row"), F.length("text") + 64, CHUNK)
    buckets = max(1, -(-n * CHUNK // BUCKET))
    named = scratch(docs.sparkSession, rows.select("doc_id", "row", "chunk", F.md5("text").alias("digest")), "substring-digests")
    first = named.groupBy("digest").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("k")).filter("k > 1")
    copies = hot_join(named, scratch(docs.sparkSession, first, "substring-copies"), "digest", "k", "inner").filter("doc_id > first_id")
    copies = copies.groupBy("chunk").agg(F.collect_set("row").alias("rows")).mapInArrow(packed, REPLY)
    rows = rows.repartition(n, "chunk")
    grouped = rows.groupBy("chunk")
    first_pass = grouped.cogroup(copies.groupBy("chunk")).applyInArrow(sent_minimizers(length, anchor, buckets), SENT)
    left = copies.unionByName(first_pass.groupBy("bucket").applyInArrow(shared_minimizers, REPLY))
    second = grouped.cogroup(left.groupBy("chunk")).applyInArrow(sent_runs(length, anchor, buckets), SENT)
    left = left.unionByName(second.groupBy("bucket").applyInArrow(earlier_windows(length), REPLY))
    out = "doc_id long, n_bytes long, n_removed long, n_spans long, kept " + ("string" if digest else "binary")
    found = grouped.cogroup(left.groupBy("chunk")).applyInArrow(removed("digest" if digest else "bytes", length, anchor, buckets), out)
    return found.withColumn("doc_id", F.nullif("doc_id", F.lit(LAST)))


def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data = [np.array(x.as_py(), dtype=np.int64).tobytes() for x in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([0] * len(batch), type=pa.int32()), pa.array(data, type=pa.binary())], ["chunk", "kind", "data"])


def op9_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return substring_dedup(table(spark, sf_dir, "documents"), digest=True).withColumnRenamed("kept", "kept_sha256")
