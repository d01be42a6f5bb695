"""Embedding near-dedup: a subspace pigeonhole join over blocks of rotated vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .blocks import dealt_blocks, in_blocks
from .common import components, hot_join, local_components, scratch, table

#: Slack of a block's distance budget, of the single-precision test before it, and of the cosine of rotated vectors before the
#: cosine of the vectors as they came, which decides.
SLACK, COARSE, ROUNDING = 1e-6, 1e-4, 1e-9
#: Most coordinates of a block that its cells cut, and the share of pair tests that a cut may leave at most to be made.
CUTS, WORTH = 3, 0.75
#: The key of the one cell that all blocks without a cut share.
UNCUT = -1


def rotation(dims: int, seed: int = 11) -> np.ndarray:
    """A seeded orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dims, dims)))
    return q * np.sign(np.diag(r))


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1)[:, None]  # so that no square over- or underflows
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


def evened(x: np.ndarray) -> np.ndarray:
    """Rows divided by a power of two, so that no square over- or underflows; no digit of a component changes."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1))[1][:, None])


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, from the vectors as they came: the product over the root of the product of the squares, which is exact where
    these are whole numbers."""
    return np.einsum("ij,ij->i", a, b) / np.sqrt(np.einsum("ij,ij->i", a, a) * np.einsum("ij,ij->i", b, b))


def packed(z: np.ndarray) -> pa.Array:
    """Rows of doubles as binary values."""
    offsets = np.arange(len(z) + 1, dtype=np.int32) * (8 * z.shape[1])
    return pa.Array.from_buffers(pa.binary(), len(z), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(z))])


def unpacked(column: pa.ChunkedArray | pa.Array, dims: int) -> np.ndarray:
    return np.frombuffer(b"".join(v.as_buffer() for v in column), dtype=np.float64).reshape(-1, dims)


class Blocks:
    """The blocks of `dims` rotated coordinates, their budgets, and the cells of those that are worth cutting.

    A pair of cosine c has squared distance 2 - 2c between unit vectors, so for c >= least some block of k of the dims
    coordinates has at most k / dims of 2 - 2 * least. A coordinate's cells are twice that budget's root wide, so that a
    vector reaches two of them.
    """

    def __init__(self, dims: int, least: float, blocks: int):
        self.edges = np.linspace(0, dims, blocks + 1).astype(int)
        self.budget = (2 - 2 * least) * np.diff(self.edges) / dims + SLACK
        self.reach = np.repeat(np.sqrt(self.budget), np.diff(self.edges))
        self.cuts: dict[int, list[int]] = {}

    def own(self, z: np.ndarray, c: int) -> np.ndarray:
        return np.floor(z[:, c] / (2 * self.reach[c])).astype(np.int64)

    def cut(self, home: dict[int, dict[int, int]], near: dict[int, dict[int, int]], n: int) -> None:
        """Choose the cuts from how many vectors each coordinate's cells hold, and how many reach them."""
        left = {c: sum(k * near[c][cell] for cell, k in home[c].items()) / n**2 for c in home}
        for b in range(len(self.budget)):
            best = sorted((left[c], c) for c in range(self.edges[b], self.edges[b + 1]) if left[c] <= WORTH)
            if best:
                self.cuts[b] = [c for _, c in best[:CUTS]]

    def uncut(self) -> list[int]:
        return [b for b in range(len(self.budget)) if b not in self.cuts]


def counted(nodes: DataFrame, dims: int, blocks: Blocks) -> tuple[dict, dict, int]:
    """How many vectors are in, and reach, each cell of each coordinate (a few cells a coordinate), and how many there are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            z = unpacked(batch.column(0), dims)
            found: list[tuple[int, int, int, int]] = [(-1, 0, len(z), 0)]
            for c in range(dims):
                own, (lo, hi) = blocks.own(z, c), (blocks.own(z + s * blocks.reach[c], c) for s in (-1, 1))
                low, high = int(lo.min()), int(hi.max())
                reach = np.cumsum(np.bincount(lo - low, minlength=high - low + 2) - np.bincount(hi - low + 1, minlength=high - low + 2))
                home = np.bincount(own - low, minlength=high - low + 2)
                found += [(c, low + k, int(home[k]), int(reach[k])) for k in range(high - low + 1)]
            yield pa.RecordBatch.from_arrays([pa.array(v) for v in zip(*found, strict=True)], ["c", "cell", "home", "near"])

    rows = nodes.select("z").mapInArrow(run, "c long, cell long, home long, near long").groupBy("c", "cell").agg(F.sum("home").alias("home"), F.sum("near").alias("near")).collect()
    home, near = ({c: {r.cell: r[name] for r in rows if r.c == c} for c in range(dims)} for name in ("home", "near"))
    return home, near, sum(r.home for r in rows if r.c == -1)


def placed(nodes: DataFrame, dims: int, blocks: Blocks) -> DataFrame:
    """(key, node, home): each vector in its own cell of every cut block and in the cells that its budget reaches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            z = unpacked(batch.column(1), dims)
            keys, rows, homes = [], [], []
            for b, cuts in blocks.cuts.items():
                reach = np.sqrt(blocks.budget[b])
                width, x = 2 * reach, z[:, cuts]
                own = np.floor(x / width).astype(np.int64)
                for step in np.ndindex(*([3] * len(cuts))):
                    cell = own + (np.array(step) - 1)
                    gap = np.maximum(0, np.maximum(cell * width - x, x - (cell + 1) * width))
                    near = np.flatnonzero((gap * gap).sum(axis=1) <= reach * reach)
                    key = np.full(len(near), b, dtype=np.int64)
                    for c in range(CUTS):
                        key = key * 65536 + (cell[near, c] + 32768 if c < len(cuts) else 0)
                    keys.append(key)
                    rows.append(near)
                    homes.append(np.full(len(near), all(s == 1 for s in step)))
            at = pa.array(np.concatenate(rows))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), batch.column(0).take(at), pa.array(np.concatenate(homes))], ["key", "node", "home"])

    return nodes.select("node", "z").mapInArrow(run, "key long, node long, home boolean")


def sides(home: np.ndarray, part: np.ndarray, cross: bool) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """(rows, rows, whether they are the same) to test against each other: every pair of a block with a vector at home, once."""
    ours, guests = np.flatnonzero(home), np.flatnonzero(~home)
    if not cross:
        yield ours, ours, True
        yield ours, guests, False
    else:
        one = part == part.min()
        yield ours[one[ours]], np.flatnonzero(~one), False
        yield ours[~one[ours]], guests[one[guests]], False


def tested(z: np.ndarray, x_: np.ndarray, node: np.ndarray, home: np.ndarray, part: np.ndarray, cross: bool, mine: list[int], blocks: Blocks, least: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The pairs of one block of rows with cosine >= least whose first block within its budget is one of mine. z: the rotated
    unit vectors, which propose; x_: the vectors themselves, which decide.

    One matrix product a block and tile: with (z, -|z|^2/2, 1) and (z, 1, -|z|^2/2) it is minus half the squared distance.
    """
    sided = []
    for b in mine:
        s = z[:, blocks.edges[b] : blocks.edges[b + 1]]
        half, one = -(s * s).sum(axis=1)[:, None] / 2, np.ones((len(s), 1))
        sided.append((np.hstack([s, half, one]).astype(np.float32), np.hstack([s, one, half]).astype(np.float32), np.float32(-blocks.budget[b] / 2 - COARSE)))
    for p, q, same in sides(home, part, cross):
        for lo in range(0, len(p), 512):
            a = p[lo : lo + 512]
            for at in range(lo if same else 0, len(q), 4096):
                c = q[at : at + 4096]
                near = np.zeros((len(a), len(c)), dtype=bool)
                for left, right, most in sided:
                    near |= left[a] @ right[c].T >= most
                x, y = np.divmod(np.flatnonzero(near), len(c))
                x, y = a[x], c[y]
                # two vectors at home meet once by place; one at home and a guest may meet in either's cell, so by number
                ok = np.where(home[y], x < y if same else True, node[x] < node[y])
                x, y = x[ok], y[ok]
                for m in range(0, len(x), 1 << 15):
                    i, j = x[m : m + (1 << 15)], y[m : m + (1 << 15)]
                    yes = np.einsum("ij,ij->i", z[i], z[j]) >= least - ROUNDING
                    i, j = i[yes], j[yes]
                    yes = cosine(x_[i], x_[j]) >= least
                    i, j = i[yes], j[yes]
                    gaps = (z[i] - z[j]) ** 2
                    met = np.add.reduceat(gaps, blocks.edges[:-1], axis=1) <= blocks.budget
                    first = np.isin(met.argmax(axis=1), mine) & met.any(axis=1)
                    yield i[first], j[first]


def links(nodes: DataFrame, dims: int, least: float, blocks: Blocks, limit: int, total: int) -> DataFrame:
    """(node, n, root): for each vector and block of pairs how many rows of other vectors with cosine >= least were found
    there, and a vector it is connected to by them."""
    parts = max(1, -(-total // limit))
    cells = []
    if blocks.uncut():
        dense = nodes.select(F.lit(UNCUT).cast("long").alias("key"), "node", F.lit(True).alias("home"), F.pmod(F.xxhash64(F.lit("part"), "node"), F.lit(parts)).cast("int").alias("part"))
        others = F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), lambda o: F.struct(F.least(o, "part").alias("i"), F.greatest(o, "part").alias("j")))
        cells.append(dense.withColumn("_b", F.explode(others)).select("key", "node", "home", "part", "_b.i", "_b.j"))
    if blocks.cuts:
        cells.append(dealt_blocks(scratch(nodes.sparkSession, placed(nodes, dims, blocks), "vector-cells"), "key", F.col("node"), limit, few=True))
    dealt = cells[0] if len(cells) == 1 else cells[0].unionByName(cells[1])
    dealt = dealt.join(nodes, "node").select("key", "node", "n", "z", "home", "part", "i", "j", "x")

    def run(rows: pa.Table, group: np.ndarray) -> Iterator[pa.RecordBatch]:
        key, nodes_, n = (rows.column(c).to_numpy() for c in (0, 1, 2))
        z, x_ = unpacked(rows.column(3), dims), unpacked(rows.column(8), dims)
        home, part = rows.column(4).to_numpy(zero_copy_only=False).astype(bool), rows.column(5).to_numpy()
        cross = rows.column(6).to_numpy() != rows.column(7).to_numpy()
        starts = np.flatnonzero(np.diff(group, prepend=-1))
        for lo, hi in zip(starts, np.append(starts[1:], len(group)), strict=True):
            s = slice(lo, hi)
            mine = blocks.uncut() if key[lo] == UNCUT else [int(key[lo] >> 16 * CUTS)]
            count, label = np.zeros(hi - lo, dtype=np.int64), np.arange(hi - lo)
            for a, b in tested(z[s], x_[s], nodes_[s], home[s], part[s], bool(cross[lo]), mine, blocks, least):
                count += np.bincount(a, weights=n[s][b], minlength=hi - lo).astype(np.int64) + np.bincount(b, weights=n[s][a], minlength=hi - lo).astype(np.int64)
                a, b = label[a], label[b]
                if (a != b).any():
                    label = local_components(np.append(a, np.arange(hi - lo)), np.append(b, label), hi - lo)
            some = np.flatnonzero(count)
            if len(some):
                yield pa.RecordBatch.from_arrays([pa.array(nodes_[s][some]), pa.array(count[some]), pa.array(nodes_[s][label[some]])], ["node", "n", "root"])

    return in_blocks(dealt, "key", run, "node long, n long, root long")


def prepared(vectors: DataFrame, dims: int) -> DataFrame:
    """(id, digest, z, x): every vector of that length as its unit vector, rotated, once, and as it came but for a power of
    two; vectors of equal components have equal digests."""
    turn = rotation(dims)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                x = evened(batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dims))
                # -0.0 and 0.0 are one component
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([xxhash.xxh3_128_digest(r.tobytes()) for r in x + 0.0]), packed(unit(x) @ turn), packed(x)], ["id", "digest", "z", "x"])

    return vectors.mapInArrow(run, "id long, digest binary, z binary, x binary").withColumn("row", F.monotonically_increasing_id())


def near_vectors(vectors: DataFrame, least: float = 0.9, blocks: int | None = None, limit: int = 16384, embedding: str = "embedding", vec_id: str = "vec_id") -> DataFrame:
    """(vec_id, n_links, component_id, kept): links are pairs of cosine >= least in double precision.

    blocks: of the rotated coordinates, by default one for every 16 (two at least). Rotated vectors
    propose pairs, with some slack for rounding; the cosine of the vectors as they came decides, so that pairs at the very
    threshold are links. Vectors that are null, empty, zero, or hold null or non-finite components link with
    nothing, as do vectors of different lengths. Every row is a vector of its own, whatever ids it shares; rows
    without an id link like others, but never name a component (then null; they are kept). Equal vectors are one node with
    a count; a hot vector's cells are split into parts (blocks.py), and a task gives one row a vector, not one a pair. An
    empty table gives no row.
    """
    spark = vectors.sparkSession
    v = vectors.select(F.col(vec_id).cast("long").alias("id"), F.col(embedding).cast("array<double>").alias("embedding"))
    whole = F.coalesce(F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0), F.lit(False))
    alone = v.filter(~whole).select(F.col("id").alias("vec_id"), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    for (dims,) in v.filter(whole).select(F.size("embedding")).distinct().collect():
        rows = scratch(spark, prepared(v.filter(whole & (F.size("embedding") == dims)), dims), "vectors")
        groups = scratch(spark, rows.groupBy("digest").agg(F.min("row").alias("node"), F.count("*").alias("n"), F.min("id").alias("first_id")), "vector-groups")
        nodes = scratch(spark, rows.join(groups.select("node", "n"), F.col("row") == F.col("node")).select("node", "n", "z", "x"), "vector-nodes")
        cut = Blocks(dims, least, min(dims, blocks or max(2, dims // 16)))
        home, near, total = counted(nodes, dims, cut)
        cut.cut(home, near, total)
        found = scratch(spark, links(nodes, dims, least, cut, limit, total), "vector-links")
        counts = found.groupBy("node").agg(F.sum("n").alias("links"))
        named = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
        known = groups.join(counts, "node", "left").join(named, "node", "left").withColumn("component", F.coalesce("component", "node"))
        known = scratch(spark, known, "vector-known")
        least_id = known.groupBy("component").agg(F.min("first_id").alias("component_id"))
        known = known.join(least_id, "component").select("digest", "n", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component_id")
        out = hot_join(rows.select("id", "digest"), scratch(spark, known, "vector-answers"), "digest", "n", "inner")
        kept = F.coalesce(F.col("id") == F.col("component_id"), F.col("component_id").isNull())
        alone = alone.unionByName(out.select(F.col("id").alias("vec_id"), F.col("n_links").cast("long"), "component_id", kept.alias("kept")))
    return alone


def op2_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


OP2_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
), l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.9
), r AS (
  SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a
), c AS (SELECT a AS vec_id, min(b) AS component_id FROM r GROUP BY a)
SELECT c.vec_id, (SELECT count(*) FROM l WHERE l.a = c.vec_id) AS n_links, component_id, c.vec_id = component_id AS kept FROM c
"""
