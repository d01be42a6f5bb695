"""Context-tree weighting over bytes: a model of the corpus, and the log-probability of every text under it.

A byte is eight binary decisions, each at one of the 255 inner nodes of a byte's binary tree. For every node there is a
tree of contexts, the last 0 to `depth` bytes; each context holds a Krichevsky-Trofimov (KT) estimate from its zeros
and ones, and the weighted probability mixes the estimates of all depths:
    Pw(context) = 1/2 KT(context) + 1/2 product of Pw(longer contexts).
The tree is a table by (context, node), summed from the deepest contexts up and turned into predictions from the root
down, one grouping or join a depth. No task and no broadcast holds the model: the corpus is counted in one pass;
for scoring it is dealt into chunks, and a chunk asks for the n-grams that it has and gets the code lengths of just those.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BASE, LOWER, give_back, in_chunks, mixed, prefix_sums, scratch, small_batches, span_hash, table, with_row

#: Bytes that UTF-8 never has: before a text's start, and after its end.
PAD, END = b"\xfe", b"\xff"
#: The key of the end as a token; words have negative keys, n-grams of bytes others.
END_KEY = -1
#: Bytes of text that a chunk holds, and that a task turns into n-grams at once.
CHUNK, PART = 32 << 20, 1 << 20
#: Keys that a task of the first pass sums before it sends them on, and new ones that wait before they are sorted in.
MOST_KEYS, WAITING = 3 << 20, 1 << 18
#: What no key is: an empty slot.
NO_KEY = -(2**63)


def trains(doc_id: object, folds: int, fold: int) -> bool:
    """Whether the model learns from a document: crc32 of its id as text mod folds is not fold; a null id: the empty text."""
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % folds != fold


def word_keys(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """A negative key of each word of each text, one after another, and how many words each text has.

    A key is the low 62 bits of a mixed polynomial hash of the word's bytes (and so of its length).
    """
    buf = np.frombuffer(b" ".join(texts) + b" ", dtype=np.uint8)
    blank = (buf == 32) | ((buf >= 9) & (buf <= 13))
    edge = np.diff(blank.view(np.int8), prepend=np.int8(1))
    first, last = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    sums = prefix_sums(buf)
    h = mixed(span_hash(sums, first, last))
    keys = -2 - (h >> np.uint64(2)).astype(np.int64)
    ends = np.cumsum([len(t) + 1 for t in texts])
    return keys, np.diff(np.searchsorted(first, ends), prepend=0)


def grams(texts: list[bytes], depth: int) -> np.ndarray:
    """The packed (depth + 1)-byte strings that end at each byte of each text and at its end; texts one after another."""
    buf = np.frombuffer(b"".join(PAD * depth + t + END for t in texts), dtype=np.uint8)
    n = len(buf) - depth
    v = np.zeros(n, dtype=np.int64)
    for k in range(depth + 1):
        v <<= 8
        v |= buf[k : k + n]
    return v[buf[depth:] != PAD[0]]


def parts_of(texts: pa.ChunkedArray, most: int | None = None) -> Iterator[tuple[int, list[bytes]]]:
    part, size, lo = [], 0, 0
    for k, t in enumerate(texts):
        part.append((t.as_buffer().to_pybytes() if t.is_valid else b"").translate(LOWER))
        size += len(part[-1])
        if size >= (most or PART):
            yield lo, part
            part, size, lo = [], 0, k + 1
    if part:
        yield lo, part


def merged(found: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and the sums of their counts."""
    keys, n = np.concatenate([k for k, _ in found]), np.concatenate([n for _, n in found])
    order = np.argsort(keys, kind="stable")  # quick on the sorted runs that these are
    keys, n = keys[order], n[order]
    starts = np.flatnonzero(np.diff(keys, prepend=keys[0] - 1))
    return keys[starts], np.add.reduceat(n, starts)


class Tally:
    """Sums of counts by key. Keys that are there already are looked up, so that only new ones are sorted in."""

    def __init__(self) -> None:
        self.keys, self.n = np.empty(0, np.int64), np.empty(0, np.int64)
        self.new: list[tuple[np.ndarray, np.ndarray]] = []
        self.waiting = 0

    def add(self, keys: np.ndarray, n: np.ndarray) -> None:
        """keys: distinct and ascending."""
        if len(self.keys):
            at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
            there = self.keys[at] == keys
            self.n[at[there]] += n[there]
            keys, n = keys[~there], n[~there]
        self.new.append((keys, n))
        self.waiting += len(keys)
        if self.waiting > max(WAITING, len(self.keys) // 4):
            self.settle()

    def settle(self) -> None:
        if self.waiting:
            self.keys, self.n = merged([(self.keys, self.n), *self.new])
        self.new, self.waiting = [], 0


class Lookup:
    """Values of distinct keys by hash tables in which a key has one slot: one that another has put out stands in the next table."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.tables: list[tuple[np.uint64, np.uint64, np.ndarray, np.ndarray]] = []
        while len(keys):
            bits = max(1, len(keys).bit_length())
            factor, shift = np.uint64(pow(BASE, 2 * len(self.tables) + 1, 2**64)), np.uint64(64 - bits)
            at = self.slots(keys, factor, shift)
            held, value = np.full(1 << bits, NO_KEY), np.zeros(1 << bits)
            held[at] = keys
            won = held[at] == keys
            value[at[won]] = values[won]
            self.tables.append((factor, shift, held, value))
            keys, values = keys[~won], values[~won]

    @staticmethod
    def slots(keys: np.ndarray, factor: np.uint64, shift: np.uint64) -> np.ndarray:
        return ((keys.view(np.uint64) * factor) >> shift).view(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The value of each key; one that isn't there is an error."""
        out, open_ = np.empty(len(keys)), None
        for factor, shift, held, value in self.tables:
            asked = keys if open_ is None else keys[open_]
            at = self.slots(asked, factor, shift)
            left = np.flatnonzero(held[at] != asked)
            if open_ is None:
                out, open_ = value[at], left
            else:
                out[open_] = value[at]
                open_ = open_[left]
            if not len(open_):
                return out
        if len(keys):
            raise KeyError("a key without a value")
        return out


def keys_of(texts: list[bytes], depth: int) -> list[tuple[np.ndarray, np.ndarray]]:
    return [np.unique(keys, return_counts=True) for keys in (grams(texts, depth), word_keys(texts)[0])]


def counted(docs: DataFrame, depth: int, folds: int, fold: int) -> DataFrame:
    """(key, n): every n-gram and word of the corpus with its count in training texts (0: in none)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        found = Tally()

        def sent() -> pa.RecordBatch:
            found.settle()
            return pa.RecordBatch.from_arrays([pa.array(found.keys), pa.array(found.n)], ["key", "n"])

        for rows in batches:
            learn = [trains(x, folds, fold) for x in rows.column(0).to_pylist()]
            found.add(np.array([END_KEY]), np.array([sum(learn)]))
            for lo, texts in parts_of(rows.column(1)):
                for yes in (True, False):
                    chosen = [t for k, t in enumerate(texts, lo) if learn[k] == yes]
                    for k, n in keys_of(chosen, depth) if chosen else []:
                        found.add(k, n if yes else np.zeros_like(n))
                if len(found.keys) > MOST_KEYS:
                    yield sent()
                    found = Tally()
        found.add(np.array([END_KEY]), np.array([0]))
        yield sent()

    rows = docs.select("doc_id", "text").mapInArrow(run, "key long, n long")
    return rows.groupBy("key").agg(F.sum("n").alias("n"))


def wanted(docs: DataFrame, depth: int) -> DataFrame:
    """(key, chunk): every n-gram and word that a chunk has."""

    def run(rows: pa.Table) -> pa.Table:
        give_back()
        found = Tally()
        found.add(np.array([END_KEY]), np.array([0]))
        for _, texts in parts_of(rows.column("text")):
            for k, n in keys_of(texts, depth):
                found.add(k, n)
        found.settle()
        keys = found.keys
        return pa.table({"key": keys, "chunk": np.full(len(keys), rows.column("chunk")[0].as_py(), dtype=np.int32)})

    return docs.groupBy("chunk").applyInArrow(run, "key long, chunk int")


def log_gamma(x: Column) -> Column:
    """ln Gamma(x) for x >= 1/2: Stirling's series at x + 8."""
    y = x + 8.0
    rising = x
    for k in range(1, 8):
        rising = rising * (x + float(k))
    series = 1.0 / (12.0 * y) - 1.0 / (360.0 * F.pow(y, 3)) + 1.0 / (1260.0 * F.pow(y, 5)) - 1.0 / (1680.0 * F.pow(y, 7))
    return (y - 0.5) * F.log(y) - y + 0.5 * math.log(2 * math.pi) + series - F.log(rising)


def kt(zeros: Column, ones: Column) -> Column:
    """ln of the KT probability of a run with so many zeros and ones."""
    return log_gamma(zeros + 0.5) + log_gamma(ones + 0.5) - log_gamma(zeros + ones + 1.0) - math.log(math.pi)


#: The eight decisions of a byte: node (1 and the bits so far) and bit, from a column `byte`.
STEPS = "transform(sequence(0, 7), k -> struct(shiftright(byte + 256, 8 - k) AS node, shiftright(byte, 7 - k) & 1 AS bit))"


def code_lengths(counts: DataFrame, depth: int) -> DataFrame:
    """(key, value): log10 of the model's probability of each n-gram's last byte after the bytes before.

    counts: (key, n) of all n-grams of the corpus; those without training count take the estimate of the longest
    context that training has reached, so that every context's predictions sum to one.
    """
    spark = counts.sparkSession
    byte = F.col("key").bitwiseAND(F.lit(255)).cast("int").alias("byte")
    # dealt by context before the eight decisions of each byte multiply the rows
    grams_ = counts.select("key", "n", F.shiftright("key", 8).alias("ctx"), byte).repartition("ctx")
    one = grams_.select("n", "ctx", F.explode(F.expr(STEPS)).alias("s")).select("n", "ctx", "s.node", "s.bit")
    level = one.groupBy("ctx", "node").agg(F.sum(F.when(F.col("bit") == 0, F.col("n")).otherwise(0)).cast("double").alias("c0"), F.sum(F.col("n") * F.col("bit")).cast("double").alias("c1"))
    level = level.withColumn("le", kt(F.col("c0"), F.col("c1"))).withColumn("lw", F.col("le")).withColumn("w", F.lit(1.0))
    levels = [scratch(spark, level, "ctw-level")]
    for d in range(depth - 1, -1, -1):
        shorter = F.col("ctx").bitwiseAND(F.lit((1 << 8 * d) - 1).cast("long"))
        level = levels[-1].groupBy(shorter.alias("ctx"), "node").agg(F.sum("c0").alias("c0"), F.sum("c1").alias("c1"), F.sum("lw").alias("lc"))
        level = level.withColumn("le", kt(F.col("c0"), F.col("c1")))
        most = F.greatest("le", "lc")
        level = level.withColumn("lw", most + F.log(F.exp(F.col("le") - most) + F.exp(F.col("lc") - most)) - math.log(2))
        levels.append(scratch(spark, level.withColumn("w", 1.0 / (1.0 + F.exp(F.col("lc") - F.col("le")))).drop("lc"), "ctw-level"))
    levels.reverse()
    # s: the mix so far; r: the weight left for longer contexts; v: the prediction if nothing longer is known
    estimate = (F.col("c1") + 0.5) / (F.col("c0") + F.col("c1") + 1.0)
    down = levels[0].select("ctx", "node", (F.col("w") * estimate).alias("s"), (1.0 - F.col("w")).alias("r"), estimate.alias("v"))
    for d in range(1, depth + 1):
        up = down.select(F.col("ctx").alias("up"), "node", F.col("s").alias("ps"), F.col("r").alias("pr"), F.col("v").alias("pv"))
        now = levels[d].withColumn("up", F.col("ctx").bitwiseAND(F.lit((1 << 8 * (d - 1)) - 1).cast("long"))).join(up, ["up", "node"])
        seen = F.col("c0") + F.col("c1") > 0
        down = now.select(
            "ctx",
            "node",
            (F.col("ps") + F.col("pr") * F.col("w") * estimate).alias("s"),
            (F.col("pr") * (1.0 - F.col("w"))).alias("r"),
            F.when(seen, F.col("ps") + F.col("pr") * estimate).otherwise(F.col("pv")).alias("v"),
        )
    # a context's predictions, at most 255, meet its n-grams in one row
    known = down.groupBy("ctx").agg(F.map_from_entries(F.collect_list(F.struct("node", "v"))).alias("m"))
    joined = grams_.select("key", "ctx", "byte").join(known, "ctx")
    p = lambda s: F.when(s["bit"] == 1, F.element_at("m", s["node"])).otherwise(1.0 - F.element_at("m", s["node"]))
    return joined.select("key", F.aggregate(F.expr(STEPS), F.lit(0.0), lambda acc, s: acc + F.log10(p(s))).alias("value"))


def scored(docs: DataFrame, replies: DataFrame, depth: int, folds: int, fold: int) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, logs, score): logs sums log10(c + 1) over a text's tokens."""

    def run(rows: pa.Table, reply: pa.Table) -> pa.Table:
        give_back()
        keys, values = reply.column("key").to_numpy(), reply.column("value").to_numpy()
        known = Lookup(keys, np.where(keys < 0, np.log10(np.where(keys < 0, values, 0.0) + 1), values))
        del reply, keys, values
        end = known.find(np.array([END_KEY]))[0] if len(rows) else 0.0
        ids = rows.column("doc_id").to_pylist() if len(rows) else []
        tokens, hits, logs, scores = [], [], [], []
        for _, texts in parts_of(rows.column("text"), PART // 4) if len(rows) else ():
            per_byte = known.find(grams(texts, depth))
            scores.append(np.add.reduceat(per_byte, np.cumsum([0] + [len(t) + 1 for t in texts])[:-1]))
            words, n = word_keys(texts)
            each = known.find(words)
            ends = np.cumsum(n)
            sums, seen = np.append(0.0, np.cumsum(each)), np.append(0, np.cumsum(each > 0))
            tokens.append(n + 1)
            logs.append(sums[ends] - sums[ends - n] + end)
            hits.append(seen[ends] - seen[ends - n] + int(end > 0))
        held = [not trains(x, folds, fold) for x in ids]
        columns = {"n_tokens": (tokens, np.int64), "n_known": (hits, np.int64), "logs": (logs, np.float64), "score": (scores, np.float64)}
        columns = {k: np.concatenate([np.empty(0, kind), *v]).astype(kind) for k, (v, kind) in columns.items()}
        return pa.table({"doc_id": pa.array(ids, type=rows.schema.field("doc_id").type), "held_out": pa.array(held, type=pa.bool_()), **columns})

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, logs double, score double"
    return docs.groupBy("chunk").cogroup(replies.groupBy("chunk")).applyInArrow(run, schema)


def ctw_scores(docs: DataFrame, depth: int = 5, folds: int = 7, fold: int = 2, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Each document's log10 probability under the corpus's context-tree model, and under a word model as a base.

    Texts are lower-cased (A-Z) and end with an end symbol; the model learns from documents outside the held-out fold
    and scores all. base_score: add-one word frequencies; the end counts as a token. Null and empty texts are their
    end alone; repeated rows each count and are scored; null ids count as the empty id; without training texts every
    bit has probability 1/2; an empty table gives no row. Word counts are kept by 62-bit hashes.
    """
    if not 1 <= depth <= 6:
        raise ValueError("depth is 1 to 6")
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("binary").alias("text"))
    spark = docs.sparkSession
    counts = scratch(spark, counted(rows, depth, folds, fold), "ctw-counts")
    values = code_lengths(counts.filter("key >= 0"), depth).unionByName(counts.filter("key < 0").select("key", F.col("n").cast("double").alias("value")))
    values = scratch(spark, values, "ctw-values")
    # by row, not by doc_id: rows that share an id, or have none, don't meet in one chunk
    rows, n = in_chunks(with_row(rows, "_dealt"), F.col("_dealt"), F.coalesce(F.length("text"), F.lit(0)) + 64, CHUNK)
    rows = rows.drop("_dealt").repartition(n, "chunk")
    out = scored(rows, wanted(rows, depth).join(values, "key"), depth, folds, fold)
    totals = counts.filter("key < 0").agg(F.struct(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count_if(F.col("n") > 0).alias("v")).alias("t")).scalar()
    out = out.withColumn("_t", totals).withColumn("train_tokens", F.col("_t.n"))
    return out.withColumn("base_score", F.col("logs") - F.col("n_tokens") * F.log10((F.col("_t.n") + F.col("_t.v") + 1).cast("double"))).drop("_t", "logs")


def op1_ctw(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    out = ctw_scores(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
