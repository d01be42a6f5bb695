"""Byte-level BPE encoding and decoding by rank files, with padded numpy matrices."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import give_back, small_batches, table

NONE = np.int32(2**31 - 1)
#: Characters of text handled at once, and pieces remembered in a task before it starts afresh: they bound memory.
SLICE, REMEMBERED = 1 << 19, 300_000


class Known:
    """Pieces that a task has encoded: the place of each, and their ids in one array."""

    def __init__(self) -> None:
        self.place: dict[str, int] = {}
        self.flat, self.starts, self.sizes = np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0, np.int64)

    def add(self, pieces: list[str], sizes: np.ndarray, ids: np.ndarray) -> None:
        """pieces: none of them known, each once; ids: theirs, one piece after another."""
        self.place.update(zip(pieces, range(len(self.place), len(self.place) + len(pieces)), strict=True))
        self.starts = np.concatenate([self.starts, len(self.flat) + np.cumsum(sizes) - sizes])
        self.sizes, self.flat = np.concatenate([self.sizes, sizes]), np.concatenate([self.flat, ids])


class Ranks:
    """A vocabulary of byte strings by rank, and a hash table from pairs of ranks to the rank of their concatenation."""

    def __init__(self, data: bytes, pattern: str):
        pairs = (line.split() for line in data.splitlines() if line.strip())
        by_bytes = {base64.b64decode(a): int(b) for a, b in pairs}
        self.size = max(by_bytes.values(), default=-1) + 1
        self.tokens: list[bytes | None] = [None] * self.size
        for b, r in by_bytes.items():
            self.tokens[r] = b
        self.by_bytes = by_bytes
        self.single = np.array([by_bytes.get(bytes([b]), -1) for b in range(256)], dtype=np.int32)
        # Rust's \s is the White_Space property; the regex module's own \s also has four control characters
        self.pieces = regex.compile(pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")).findall
        self.lengths = np.array([len(t or b"") for t in self.tokens], dtype=np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)])[:-1]
        self.flat = np.frombuffer(b"".join(t or b"" for t in self.tokens), dtype=np.uint8)
        keys, vals = [], []
        for token, rank in by_bytes.items():
            for i in range(1, len(token)):
                a, b = by_bytes.get(token[:i]), by_bytes.get(token[i:])
                if a is not None and b is not None:
                    keys.append(a << 32 | b)
                    vals.append(rank)
        self.fill(np.array(keys, dtype=np.uint64), np.array(vals, dtype=np.int32))

    def fill(self, keys: np.ndarray, vals: np.ndarray) -> None:
        """Open addressing: every key takes the first free slot after its own; of those that meet at one, the first."""
        bits = max(4, int(len(keys) * 2.5).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.slot_key = np.full(1 << bits, np.uint64(2**64 - 1))
        self.slot_val = np.full(1 << bits, NONE)
        at, self.probes = self.slot(keys), 0
        while len(keys):
            self.probes += 1
            free = np.flatnonzero(self.slot_val[at] == NONE)
            places, first = np.unique(at[free], return_index=True)
            won = free[first]
            self.slot_key[places], self.slot_val[places] = keys[won], vals[won]
            left = np.ones(len(keys), dtype=bool)
            left[won] = False
            keys, vals, at = keys[left], vals[left], (at[left] + 1) & self.mask

    def slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of each pair's concatenation, NONE where it has none (or an end is padding)."""
        keys = (a.astype(np.uint64) << np.uint64(32)) | b.astype(np.uint64)
        out = np.full(keys.shape, NONE)
        open_ = np.flatnonzero((a >= 0) & (b >= 0))
        flat, keys = out.reshape(-1), keys.reshape(-1)[open_]
        at = self.slot(keys)
        for _ in range(self.probes):
            hit = self.slot_key[at] == keys
            flat[open_[hit]] = self.slot_val[at[hit]]
            go = ~hit & (self.slot_val[at] != NONE)
            if not go.any():
                break
            open_, keys, at = open_[go], keys[go], (at[go] + 1) & self.mask
        return out

    def merge(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Which piece, how many ids it has, and the ids one after another, in the order in which pieces are done. Pieces of
        like length share a padded matrix; each round every row merges its leftmost pair of least rank, and rows without
        one leave the matrix, which so loses a column a round."""
        whole = np.array([self.by_bytes.get(p, -1) for p in pieces], dtype=np.int32)
        one = np.flatnonzero(whole >= 0)
        out = [(one, np.ones(len(one), dtype=np.int64), whole[one])]
        buckets: dict[int, list[int]] = {}
        for k in np.flatnonzero(whole < 0).tolist():
            buckets.setdefault((len(pieces[k]) - 1).bit_length(), []).append(k)
        for members in buckets.values():
            width = max(len(pieces[k]) for k in members)
            step = max(1, (1 << 20) // width)
            for lo in range(0, len(members), step):
                rows = np.array(members[lo : lo + step])
                raw = np.frombuffer(b"".join(pieces[k].ljust(width, b"\0") for k in rows), dtype=np.uint8).reshape(len(rows), width)
                size = np.array([len(pieces[k]) for k in rows])
                ids = np.where(np.arange(width) < size[:, None], self.single[raw], -1)
                if (self.single[raw] < 0)[np.arange(width) < size[:, None]].any():
                    raise ValueError("the vocabulary lacks a byte")
                self.rounds(ids, rows, out)
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))

    def rounds(self, ids: np.ndarray, rows: np.ndarray, out: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> None:
        rank = self.ranks(ids[:, :-1], ids[:, 1:])
        while True:
            if ids.shape[1] > 1:
                at = rank.argmin(axis=1)
                best = rank[np.arange(len(rows)), at]
                done = best == NONE
            else:
                done = np.ones(len(rows), dtype=bool)
            if done.any():
                ended = ids[done]
                real = ended >= 0
                out.append((rows[done], real.sum(axis=1), ended[real]))
                if done.all():
                    return
                ids, rank, rows, at, best = ids[~done], rank[~done], rows[~done], at[~done], best[~done]
            n = np.arange(len(rows))
            keep = np.arange(ids.shape[1] - 1)
            ids[n, at] = best
            ids = np.take_along_axis(ids, keep + (keep > at[:, None]), axis=1)
            keep = keep[:-1]
            rank = np.take_along_axis(rank, keep + (keep >= at[:, None]), axis=1)
            if ids.shape[1] > 1:
                for off in (-1, 0):  # only the pairs beside the merged token are new
                    place = at + off
                    ok = np.flatnonzero((place >= 0) & (place < rank.shape[1]))
                    rank[ok, place[ok]] = self.ranks(ids[ok, place[ok]], ids[ok, place[ok] + 1])

    def encode(self, texts: list[str], known: Known) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after another, and how many each text has."""
        split = [self.pieces(t) for t in texts]
        new = list(set().union(*split).difference(known.place))
        which, sizes, ids = self.merge([p.encode() for p in new])
        known.add([new[k] for k in which.tolist()], sizes, ids)
        count = np.array([len(s) for s in split], dtype=np.int64)
        at = np.fromiter(map(known.place.__getitem__, chain.from_iterable(split)), dtype=np.int64, count=int(count.sum()))
        size = known.sizes[at]
        ends = np.concatenate([[0], np.cumsum(size)])
        ids = known.flat[np.arange(ends[-1]) + np.repeat(known.starts[at] - ends[:-1], size)]
        return ids, np.diff(ends[np.concatenate([[0], np.cumsum(count)])])

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of a run of ids, gathered from the vocabulary's concatenation; an unknown id is an error."""
        if len(ids) and (ids.min() < 0 or ids.max() >= self.size or not self.lengths[ids].all()):
            raise ValueError("an id that the vocabulary lacks")
        size = self.lengths[ids]
        ends = np.cumsum(size)
        place = np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.starts[ids] - (ends - size), size)
        return self.flat[place].tobytes()


_loaded: dict[int, Ranks] = {}


def loaded(data: bytes, pattern: str) -> Ranks:
    """One table a worker process."""
    key = hash((data, pattern))
    if key not in _loaded:
        _loaded[key] = Ranks(data, pattern)
    return _loaded[key]


def sliced(texts: list[str]) -> Iterator[list[str]]:
    part, size = [], 0
    for t in texts:
        part.append(t)
        size += len(t)
        if size >= SLICE:
            yield part
            part, size = [], 0
    if part:
        yield part


def bpe_encode(docs: DataFrame, vocabulary: str, pattern: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """docs with `ids` (array<int>): the tokens of each whole text; a null text counts as an empty one.

    vocabulary: a rank file (base64 bytes and rank a line), read once by the driver and sent to the workers: its size
    is the tokenizer's, whatever the input. Each match of pattern is encoded by itself, without special tokens.
    Repeated rows are encoded each; other columns stay, but for one named like ids, which is replaced.
    """
    with open(vocabulary, "rb") as f:
        shipped = docs.sparkSession.sparkContext.broadcast(f.read())
    docs = docs.drop(ids)
    schema = docs.withColumn(ids, F.array().cast("array<int>")).schema
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        ranks, known = loaded(shipped.value, pattern), Known()
        for batch in batches:
            column = batch.column(names.index(text))
            lo = 0
            for part in sliced([t or "" for t in column.to_pylist()]):
                if len(known.place) > REMEMBERED:
                    known = Known()
                found, sizes = ranks.encode(part, known)
                ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
                values = pa.ListArray.from_arrays(pa.array(ends), pa.array(found, type=pa.int32()))
                rows = batch.slice(lo, len(part))
                yield pa.RecordBatch.from_arrays([*rows.columns, values], [*names, ids])
                lo += len(part)

    return docs.mapInArrow(run, schema)


def bpe_decode(docs: DataFrame, vocabulary: str, pattern: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """docs with `decoded` (binary): the bytes of the tokens; null ids give null, an id outside the vocabulary an error."""
    with open(vocabulary, "rb") as f:
        shipped = docs.sparkSession.sparkContext.broadcast(f.read())
    docs = docs.drop(decoded)
    schema = docs.withColumn(decoded, F.lit(b"")).schema
    schema[decoded].nullable = True
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = loaded(shipped.value, pattern)
        for batch in batches:
            column = batch.column(names.index(ids))
            for lo in range(0, len(batch), 64):
                rows = batch.slice(lo, 64)
                out = [None if not x.is_valid else ranks.decode(x.values.to_numpy(zero_copy_only=False)) for x in column.slice(lo, 64)]
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(out, type=pa.binary())], [*names, decoded])

    return docs.mapInArrow(run, schema)


def digested(docs: DataFrame) -> DataFrame:
    import public_tokenizers

    small_batches(docs.sparkSession)
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    out = bpe_decode(bpe_encode(docs.select("doc_id", "text"), path, public_tokenizers.PATTERN).drop("text"), path, public_tokenizers.PATTERN)
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join("ids", " "), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digested(table(spark, sf_dir, "documents"))


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of each document: the corpus as it would be packed."""
    return digested(docs)
