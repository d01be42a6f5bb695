"""Quality classifier: a linear-chain conditional random field labels every line of a text good or bad.

A line's features are shares of character classes, lengths and repetitions, with those of the lines beside it. The
document's score is the mean of its lines' marginal probabilities of being good, weighted by their lengths in bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import mixed, prefix_sums, small_batches, span_hash, table


def byte_classes() -> np.ndarray:
    """(classes, 256): which bytes each class counts."""
    sets = [b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\x0b\x0c\r", b".", b",;:", b"!", b"?", b"#*$%&|<>", b"@/\\_=+~^`", b"()[]{}\"'-", bytes(range(128, 256))]
    out = np.zeros((len(sets), 256), dtype=np.uint8)
    for k, s in enumerate(sets):
        out[k, list(s)] = 1
    return out


CLASSES = byte_classes()
#: Roots of class shares; log length; words a byte; share of words equal to the one before; repeated line; blank line.
FEATURES = len(CLASSES) + 5
PART = 1 << 19


def line_features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(lines, FEATURES) of all lines of the texts, the lines' lengths in bytes, and how many lines each text has."""
    buf = np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)
    ends = np.flatnonzero(buf == 10)
    starts = np.append(0, ends[:-1] + 1)
    size = ends - starts
    n = np.diff(np.searchsorted(ends, np.cumsum([len(t) + 1 for t in texts]) - 1, side="right"), prepend=0)
    x = np.zeros((len(ends), FEATURES), dtype=np.float32)
    long = np.maximum(size, 1)
    for k in range(len(CLASSES)):
        x[:, k] = np.sqrt(np.add.reduceat(CLASSES[k][buf], starts, dtype=np.int64) / long)
    at = len(CLASSES)
    sums = prefix_sums(buf)
    blank = (buf == 32) | ((buf >= 9) & (buf <= 13))
    edge = np.diff(blank.view(np.int8), prepend=np.int8(1))
    first, last = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    h = mixed(span_hash(sums, first, last))
    line = np.searchsorted(ends, first)
    words = np.bincount(line, minlength=len(ends))
    same = np.zeros(len(h))
    same[1:] = (h[1:] == h[:-1]) & (line[1:] == line[:-1])
    x[:, at] = np.log1p(size) / 8
    x[:, at + 1] = words / long
    x[:, at + 2] = np.bincount(line, weights=same, minlength=len(ends)) / np.maximum(words, 1)
    doc = np.repeat(np.arange(len(texts)), n)
    key = mixed(span_hash(sums, starts, ends) + doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    _, firsts = np.unique(key, return_index=True)
    again = np.ones(len(ends), dtype=bool)
    again[firsts] = False
    x[:, at + 3] = again & (words > 0)
    x[:, at + 4] = words == 0
    return x, size, n


def chains(x: np.ndarray, first: np.ndarray, last: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(chains, lines, 3 * FEATURES + 1), padded: `size` lines from line `start` on, each with its neighbours in its text
    (lines first to before last of x) and a one; and the mask."""
    width = int(size.max())
    f = np.zeros((len(start), width + 2, FEATURES), dtype=np.float32)
    line = start[:, None] + np.arange(-1, width + 1)
    rows, cols = np.nonzero((line >= first[:, None]) & (line < last[:, None]) & (np.arange(width + 2) < size[:, None] + 2))
    f[rows, cols] = x[line[rows, cols]]
    mask = np.arange(width) < size[:, None]
    one = np.ones((len(start), width, 1), dtype=np.float32)
    return np.concatenate([f[:, :-2], f[:, 1:-1], f[:, 2:], one], axis=2), mask


def log_sum(a: np.ndarray, axis: int) -> np.ndarray:
    m = a.max(axis=axis, keepdims=True)
    return (m + np.log(np.exp(a - m).sum(axis=axis, keepdims=True))).squeeze(axis)


def forward_backward(good: np.ndarray, mask: np.ndarray, steps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marginals of label good (docs, lines), and expected counts of label pairs (2, 2), for scores `good` of that label."""
    b, t = good.shape
    e = np.stack([np.zeros_like(good), good], axis=2)
    forward, backward = np.zeros((t, b, 2)), np.zeros((t, b, 2))
    forward[0] = e[:, 0]
    for k in range(1, t):
        go = log_sum(forward[k - 1][:, :, None] + steps, 1) + e[:, k]
        forward[k] = np.where(mask[:, k, None], go, forward[k - 1])
    for k in range(t - 2, -1, -1):
        go = log_sum(steps + (e[:, k + 1] + backward[k + 1])[:, None, :], 2)
        backward[k] = np.where(mask[:, k + 1, None], go, 0)
    total = log_sum(forward[-1], 1)
    marginal = 1 / (1 + np.exp(np.clip((forward + backward)[:, :, 0] - (forward + backward)[:, :, 1], -700, 700)))
    pairs = np.zeros((2, 2))
    if t > 1:
        p = forward[:-1, :, :, None] + steps + (e.transpose(1, 0, 2)[1:] + backward[1:])[:, :, None, :] - total[:, None, None]
        pairs = (np.exp(np.minimum(p, 0)) * mask.T[1:, :, None, None]).sum(axis=(0, 1))
    return marginal.T, pairs


def fit(x: np.ndarray, n: np.ndarray, labels: np.ndarray, updates: int = 720, batch: int = 256, window: int = 64, rate: float = 0.05, decay: float = 1e-4, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Weights and label-pair scores by Adam on the conditional log-likelihood; every line has its document's label.

    A text is learnt in windows of at most `window` lines, all of its lines in one of them, each line with its true
    neighbours. Lines count by 1 / their text's lines, so that long texts don't outweigh others. The number of updates
    is fixed; each sees `batch` windows, dealt from seeded permutations.
    """
    rng = np.random.default_rng(seed)
    w, steps = np.zeros(3 * FEATURES + 1), np.zeros((2, 2))
    params = [w, steps]
    mean, square = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    ends = np.cumsum(n)
    pieces = -(-n // window)
    doc = np.repeat(np.arange(len(n)), pieces)
    start = (ends - n)[doc] + window * (np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces))
    size = np.minimum(window, ends[doc] - start)
    order = np.empty(0, dtype=np.int64)
    for k in range(1, updates + 1 if len(doc) else 1):
        while len(order) < min(batch, len(doc)):
            order = np.append(order, rng.permutation(len(doc)))
        some, order = order[:batch], order[batch:]
        f, mask = chains(x, (ends - n)[doc[some]], ends[doc[some]], start[some], size[some])
        y = labels[doc[some]][:, None] * mask
        marginal, pairs = forward_backward(f @ w, mask, steps)
        share = (size / n[doc])[some]
        gw = np.einsum("bt,btf->f", (y - marginal) * mask / n[doc[some]][:, None], f) / share.sum() - decay * w
        both = mask[:, 1:] & mask[:, :-1]
        ones, lines = (both.sum(axis=1) * labels[doc[some]]).sum(), max(1, both.sum())
        gs = (np.diag([both.sum() - ones, ones]) - pairs) / lines - decay * steps
        for p, g, m, v in zip(params, (gw, gs), mean, square, strict=True):
            m *= 0.9
            m += 0.1 * g
            v *= 0.99
            v += 0.01 * g * g
            p += rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)
    return w, steps


def scores(texts: list[bytes], w: np.ndarray, steps: np.ndarray) -> np.ndarray:
    x, size, n = line_features(texts)
    starts = np.cumsum(n) - n
    out = np.zeros(len(texts))
    order = np.argsort(n, kind="stable")
    lo = 0
    while lo < len(order):
        hi = lo + 1
        while hi < len(order) and (hi - lo) * n[order[hi]] < 20_000:
            hi += 1
        docs = order[lo:hi]
        f, mask = chains(x, starts[docs], starts[docs] + n[docs], starts[docs], n[docs])
        marginal, _ = forward_backward(f @ w, mask, steps)
        weight = np.zeros(mask.shape)
        rows, cols = np.nonzero(mask)
        weight[rows, cols] = size[starts[docs[rows]] + cols] + 1
        out[docs] = (marginal * weight).sum(axis=1) / weight.sum(axis=1)
        lo = hi
    return out


def texts_of(column: pa.Array) -> Iterator[list[bytes]]:
    part, size = [], 0
    for t in column:
        part.append(t.as_buffer().to_pybytes() if t.is_valid else b"")
        size += len(part[-1])
        if size >= PART:
            yield part
            part, size = [], 0
    if part:
        yield part


def fold_of(doc_id: str, folds: int):
    return F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")), F.lit(folds))


def fitted(docs: DataFrame, labels: DataFrame, folds: int, most_labelled: int) -> tuple[np.ndarray, np.ndarray]:
    """The model from at most most_labelled labelled documents outside fold 0, chosen by a hash of their ids.

    Only the features of their lines, of all of them, reach the driver: 68 bytes a line, whatever the corpus holds. Of rows
    that repeat a labelled doc_id, as of all, most_labelled are used at most. Labels without a document or an id count for nothing; without
    any, or with an empty table, all weights are 0.
    """
    chosen = labels.filter("quality IS NOT NULL AND doc_id IS NOT NULL").filter(fold_of("doc_id", folds) != 0)
    chosen = chosen.groupBy("doc_id").agg(F.max("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_labelled)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(len(batch)):
                text = batch.column(1)[row]
                x, _, _ = line_features([text.as_buffer().to_pybytes() if text.is_valid else b""])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, 1), pa.array([x.tobytes()])], ["quality", "x"])

    found = docs.select("doc_id", F.col("text").cast("binary").alias("text")).join(F.broadcast(chosen), "doc_id").select(F.col("quality").cast("int"), "text").mapInArrow(run, "quality int, x binary")
    found = found.orderBy(F.xxhash64("x"), "quality").limit(most_labelled).toArrow()
    x = [np.frombuffer(v.as_py(), dtype=np.float32).reshape(-1, FEATURES) for v in found.column(1)]
    y = np.array(found.column(0).to_pylist(), dtype=np.float64)
    order = np.lexsort([[len(v) for v in x], [float(v.sum()) for v in x], y]) if x else np.empty(0, dtype=int)
    x, y = [x[k] for k in order], y[order]
    return fit(np.concatenate([np.zeros((0, FEATURES), np.float32), *x]), np.array([len(v) for v in x], dtype=np.int64), y)


def quality_scores(docs: DataFrame, labels: DataFrame, folds: int = 5, most_labelled: int = 6000, threshold: float = 0.3) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document; learnt from labels of documents outside fold 0.

    Null and empty texts are one blank line and have a score too; without labels every score is 1/2; rows with the same
    doc_id are scored each (their label is the largest given); an empty table gives no row.
    """
    w, steps = fitted(docs, labels, folds, most_labelled)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [scores(part, w, steps) for part in texts_of(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate([np.empty(0), *found]))], ["doc_id", "score"])

    out = docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(run, f"doc_id {kind}, score double")
    return out.select("doc_id", (fold_of("doc_id", folds) == 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
