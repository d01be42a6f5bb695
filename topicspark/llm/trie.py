"""The prefix trie of conversations, and totals over its subtrees by parallel tree contraction."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from topicspark.operators.ordered import numbered, running

from .common import hot_join, scratch, table

#: Ids in a string that the digest of a long list of ids is made of.
PACK = 4096
#: Nodes that a task of contracted() holds: about so many while there are fewer tasks than partitions of a shuffle, and at most.
BLOCK, MOST = 8192, 1 << 18


def subtree_totals(nodes: DataFrame, values: list[str]) -> DataFrame:
    """(id, one total a value): the sums of `values` over the subtree of each node of a forest, the node itself included.

    nodes: (id, parent, values...), ids of any comparable type, each once; a node whose parent is null or not among the ids is a
    root. Null values count as 0. A cycle of parents is an error. An empty forest gives an empty table.

    Parallel tree contraction, in rounds of two kinds in turn. In joins: rake takes away all leaves and adds what they hold
    to their parents; compress takes away nodes with one child left that win a toss which their parents lose (so no two
    neighbours go at once), hands the child over to the parent, and lets the child carry what the node held. In tasks
    (contracted()): what is left is dealt by ranges of ids, and each task rakes and compresses as far as the nodes that it
    holds allow, so that chains whose ids lie side by side go in one round. A leaf's total is final when it is raked.
    Contracted nodes are re-expanded in reverse: what the node held plus the total of the child that it handed over. Rounds
    are about as many as the logarithm of the nodes at most, whatever the depth and the order of ids, and shrink
    geometrically; each is written to the shared folder. Sums to a parent are pre-aggregated in tasks, and children of a
    parent with more than a thousandth of all nodes meet no join by it.
    """
    spark = nodes.sparkSession
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    ids = nodes.select("id", "parent", *[zero(v).alias(v) for v in values], *[F.lit(0).cast("long").alias(f"edge_{v}") for v in values])
    kids = ids.filter("parent IS NOT NULL").groupBy(F.col("parent").alias("id")).agg(F.count("*").alias("kids"))
    live = scratch(spark, ids.join(kids, "id", "left").withColumn("kids", F.coalesce("kids", F.lit(0))), "trie")
    rounds: list[DataFrame] = []
    left = live.count()
    while left:
        r, joins = len(rounds), len(rounds) % 2 == 0
        out = scratch(spark, joined_round(live, values, r, left) if joins else contracted(live, values, left), "trie")
        counts = dict(out.groupBy("state").count().collect())
        if joins and not counts.get("raked"):
            raise ValueError("parents form a cycle")
        rounds.append(out)
        live, left = out.filter("state = 'live'").drop("state"), counts.get("live", 0)
    totals = None
    for out in reversed(rounds):
        now = out.filter("state = 'raked'").select("id", *values)
        if totals is not None:
            child = totals.select(F.col("id").alias("parent"), *[F.col(v).alias(f"_{v}") for v in values])
            freed = out.filter("state = 'compressed'").select("id", "parent", *values).join(child, "parent")
            now = totals.unionByName(now).unionByName(freed.select("id", *[(F.col(v) + F.col(f"_{v}")).alias(v) for v in values]))
            now = scratch(spark, now, "trie")
        totals = now
    return nodes.select("id", *[zero(v).alias(v) for v in values]) if totals is None else totals


def joined_round(live: DataFrame, values: list[str], r: int, left: int) -> DataFrame:
    """live after one rake and one compress in joins, with what re-expansion needs (state: live, raked or compressed)."""
    toss = lambda c: F.xxhash64(F.lit(r), c) % 2 == 0
    leaf = F.col("kids") == 0
    up = live.filter(leaf & F.col("parent").isNotNull()).groupBy(F.col("parent").alias("id")).agg(F.count("*").alias("_gone"), *[F.sum(F.col(v) + F.col(f"edge_{v}")).alias(f"_{v}") for v in values])
    rest = live.filter(~leaf).join(up, "id", "left").withColumns({v: F.col(v) + F.coalesce(f"_{v}", F.lit(0)) for v in values} | {"kids": F.col("kids") - F.coalesce("_gone", F.lit(0))})
    rest = rest.select(*live.columns)
    only = (F.col("kids") == 1) & F.col("parent").isNotNull() & toss(F.col("id")) & ~toss(F.col("parent"))
    taken = rest.filter(only).select(F.col("id").alias("parent"), F.col("parent").alias("_above"), *[F.col(v).alias(f"_{v}") for v in values], *[F.col(f"edge_{v}").alias(f"_edge_{v}") for v in values])
    # only the children of nodes that might be taken are looked up: not those of a parent with many children
    many = F.broadcast(rest.filter((F.col("kids") > 1) & (F.col("kids") * 1000 > left)).select(F.col("id").alias("parent")))
    under = rest.filter(~F.coalesce(only, F.lit(False)))
    apart = under.join(many, "parent", "left_semi")
    moved = under.join(many, "parent", "left_anti").join(taken, "parent", "left")
    went = F.col("_above").isNotNull()
    live_next = moved.select(
        F.lit("live").alias("state"), "id", F.when(went, F.col("_above")).otherwise(F.col("parent")).alias("parent"), *values,
        *[(F.col(f"edge_{v}") + F.coalesce(F.col(f"_{v}") + F.col(f"_edge_{v}"), F.lit(0))).alias(f"edge_{v}") for v in values], "kids",
    )
    # what re-expansion needs: the node that went, the child that it handed over, and what it held beside it
    held = moved.filter(went).select(F.lit("compressed").alias("state"), F.col("parent").alias("id"), F.col("id").alias("parent"), *[(F.col(f"_{v}") + F.col(f"edge_{v}")).alias(v) for v in values])
    raked = live.filter(leaf).select(F.lit("raked").alias("state"), "id", "parent", *values)
    apart = apart.select(F.lit("live").alias("state"), *live.columns)
    return live_next.unionByName(apart).unionByName(held, allowMissingColumns=True).unionByName(raked, allowMissingColumns=True)


def contracted(live: DataFrame, values: list[str], left: int) -> DataFrame:
    """live after tasks have raked and compressed what they hold, with what re-expansion needs, as joined_round gives it.

    Nodes are dealt by ranges of ids, some BLOCK to a task or as many as shuffles have partitions, and a task takes at most
    MOST at a time. A leaf whose parent lies elsewhere stays for the next round in joins, and so do nodes with children there.
    """
    schema = StructType([StructField("state", StringType()), *live.schema.fields])
    most = MOST

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += len(batch)
            if n >= most:
                yield from contract(pa.Table.from_batches(held), values).to_batches()
                held, n = [], 0
        if n:
            yield from contract(pa.Table.from_batches(held), values).to_batches()

    shuffled = int(live.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = max(-(-left // most), min(-(-left // BLOCK), shuffled))
    return live.repartitionByRange(parts, "id").sortWithinPartitions("id").mapInArrow(run, schema)


def hashable(ids: pa.Array) -> list:
    """Equal ids as equal Python keys; None for null. Ids that differ here though Spark takes them as equal only wait for a round in joins."""
    if pa.types.is_struct(ids.type):
        fields = zip(*map(hashable, ids.flatten()), strict=True)
        return [x if ok else None for x, ok in zip(fields, ids.is_valid().to_pylist(), strict=True)]
    return [repr(x) if isinstance(x, (list, dict)) else x for x in ids.to_pylist()]


def contract(rows: pa.Table, values: list[str]) -> pa.Table:
    """The rows with their state after all rakes and compressions that need no row beside them."""
    id_, parent = rows.column("id").combine_chunks(), rows.column("parent").combine_chunks()
    parents, kids, n = hashable(parent), rows.column("kids").to_pylist(), len(rows)
    place = {x: k for k, x in enumerate(hashable(id_))}
    up = [-1 if x is None else place.get(x, -1) for x in parents]
    sums = [(rows.column(v).to_pylist(), rows.column(f"edge_{v}").to_pylist()) for v in values]
    state, source = ["live"] * n, list(range(n))
    leaves = [k for k in range(n) if kids[k] == 0]
    for k in leaves:  # grows on the way
        a = up[k]
        if a < 0 and parents[k] is not None:
            continue
        state[k] = "raked"
        if a >= 0:
            kids[a] -= 1
            for v, e in sums:
                v[a] += v[k] + e[k]
            if kids[a] == 0:
                leaves.append(a)
    here = [0] * n
    for k in range(n):
        if state[k] == "live" and up[k] >= 0:
            here[up[k]] += 1
    goes = [state[k] == "live" and kids[k] == here[k] == 1 and parents[k] is not None for k in range(n)]
    for k in [k for k in range(n) if state[k] == "live" and not goes[k]]:
        a = up[k]
        while a >= 0 and goes[a]:
            state[a], goes[a], source[k], source[a] = "compressed", False, a, n + k
            for v, e in sums:
                v[a], e[k] = v[a] + e[k], e[k] + v[a] + e[a]
            a = up[a]
    columns = {"id": id_, "parent": pa.concat_arrays([parent, id_]).take(pa.array(source, type=pa.int64())), "kids": pa.array(kids, type=pa.int64())}
    for name, (v, e) in zip(values, sums, strict=True):
        columns |= {name: pa.array(v, type=pa.int64()), f"edge_{name}": pa.array(e, type=pa.int64())}
    return pa.table({"state": pa.array(state), **{c: columns[c] for c in rows.column_names}})


def in_order(turns: DataFrame) -> DataFrame:
    """turns (conv_id, turn, role, text) with their place `pos` from 1: by turn (null first), then role, then text. Null
    roles and texts are empty; rows without a conv_id belong to no conversation and are left out."""
    empty = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    rows = turns.filter("conv_id IS NOT NULL").select("conv_id", "turn", empty("role"), empty("text"))
    return numbered(rows, ["conv_id"], [F.asc_nulls_first("turn"), "role", "text"], "pos").select("conv_id", "pos", "role", "text")


def prefix_trie(turns: DataFrame, conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, ends) of the trie of all conversations (conv_id, each once) by their turns (conv_id, pos from 1, role, text).

    nodes: one row for each distinct sequence of first turns, the root (depth 0) among them: conv_id (the smallest member),
    depth, parent_conv_id, role and text of the last turn (null at the root), n_convs (members), n_children, n_leaves (childless nodes of its
    subtree) and saved_chars (over its subtree, (n_convs - 1) times the code points of a node's last text: what sharing the
    node saves). ends: (conv_id, end_conv_id, depth): the node at which each conversation ends.

    A prefix is told by its depth and two running XORs of 64-bit hashes of (place, role, text), 128 bits in all. Members
    are pre-aggregated before they meet. A conversation of any length is spread by running(); conversations without turns
    end at the root; without conversations there is no node.
    """
    spark = turns.sparkSession
    own = lambda seed: F.xxhash64(F.lit(seed), F.col("pos"), F.length("role"), "role", "text")
    rows = turns.select("conv_id", "pos", "role", "text", own(11).alias("h1"), own(29).alias("h2"))
    rows = running(rows, ["conv_id"], ["pos"], {"k1": ("xor", F.col("h1")), "k2": ("xor", F.col("h2"))})
    rows = scratch(spark, rows.withColumnRenamed("pos", "depth"), "prefixes")
    key, above = ["depth", "k1", "k2"], ["depth", "u1", "u2"]
    grouped = rows.groupBy(*key).agg(
        F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.min_by(F.struct("role", "text", "h1", "h2"), "conv_id").alias("last"),
    )
    root = conversations.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).filter("n_convs > 0")
    root = root.select(F.lit(0).alias("depth"), F.lit(0).cast("long").alias("k1"), F.lit(0).cast("long").alias("k2"), "conv_id", "n_convs")
    nodes = grouped.select(*key, "conv_id", "n_convs", "last.role", "last.text", F.col("k1").bitwiseXOR(F.col("last.h1")).alias("u1"), F.col("k2").bitwiseXOR(F.col("last.h2")).alias("u2"))
    nodes = scratch(spark, nodes.unionByName(root, allowMissingColumns=True), "nodes")
    children = nodes.filter("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("u1").alias("k1"), F.col("u2").alias("k2")).agg(F.count("*").alias("n_children"))
    nodes = scratch(spark, nodes.join(children, key, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))), "nodes")
    # the parent of a node with its smallest member: parents of many are few and broadcast
    parents = nodes.filter("n_children > 0").select(F.struct((F.col("depth") + 1).alias("depth"), F.col("k1").alias("u1"), F.col("k2").alias("u2")).alias("up"), F.col("conv_id").alias("parent_conv_id"), F.col("n_children").alias("_n"))
    below = hot_join(nodes.filter("depth > 0").withColumn("up", F.struct(*above)), parents, "up", "_n", "inner")
    nodes = scratch(spark, below.drop("up", "_n").unionByName(nodes.filter("depth = 0"), allowMissingColumns=True), "nodes")
    saved = (F.col("n_convs") - 1) * F.coalesce(F.char_length("text"), F.lit(0))
    id_ = F.struct("conv_id", "depth")
    up = F.when(F.col("depth") > 0, F.struct(F.col("parent_conv_id").alias("conv_id"), (F.col("depth") - 1).alias("depth")))
    forest = nodes.select(id_.alias("id"), up.alias("parent"), (F.col("n_children") == 0).cast("long").alias("n_leaves"), saved.cast("long").alias("saved_chars"))
    totals = subtree_totals(forest, ["n_leaves", "saved_chars"])
    full = nodes.join(totals.select("id.*", "n_leaves", "saved_chars"), ["conv_id", "depth"])
    last = rows.groupBy("conv_id").agg(F.max_by(F.struct(*key), "depth").alias("end"))
    last = conversations.join(last, "conv_id", "left").select("conv_id", *[F.coalesce(F.col(f"end.{c}"), F.lit(0)).alias(c) for c in key])
    sizes = nodes.filter("n_convs > 0").select(F.struct(*key).alias("end"), F.col("conv_id").alias("end_conv_id"), F.col("n_convs").alias("_n"))
    ends = hot_join(last.withColumn("end", F.struct(*key)), sizes, "end", "_n", "inner").select("conv_id", "end_conv_id", "depth")
    return full.select("conv_id", "depth", "parent_conv_id", "role", "text", "n_convs", "n_children", "n_leaves", "saved_chars"), ends


def id_digests(rows: DataFrame, keys: list[str], id_: str, pack: int = PACK) -> DataFrame:
    """keys and ids_sha256: the SHA-256 of each key's ids in decimals, ascending, joined by commas.

    The digest takes the ids one after the other, so a key's ids end in one task, but as strings of up to `pack` of them,
    packed where ranges of (keys, id) lie sorted, and streamed: the task holds one string.
    """
    ranged = rows.select(*keys, id_).repartitionByRange(*keys, id_).sortWithinPartitions(*keys, id_)
    key_fields = [f"{c} {t}" for c, t in rows.select(*keys).dtypes]

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, out = None, [], []
        for batch in batches:
            for *now, x in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if now != key or len(held) >= pack:
                    if held:
                        out.append((*key, held[0], ",".join(map(str, held))))
                    key, held = now, []
                held.append(x)
            yield from told(out, schema_packed)
            out = []
        if held:
            yield from told([(*key, held[0], ",".join(map(str, held)))], schema_packed)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, h = None, None
        for batch in batches:
            out = []
            columns = [c.to_pylist() for c in batch.columns]
            for *now, _, text in zip(*columns, strict=True):
                if now != key:
                    if h:
                        out.append((*key, h.hexdigest()))
                    key, h = now, hashlib.sha256()
                else:
                    h.update(b",")
                h.update(text.encode())
            yield from told(out, schema_digest)
        if h:
            yield from told([(*key, h.hexdigest())], schema_digest)

    kinds = [pa.int64() if t == "bigint" else pa.int32() for _, t in rows.select(*keys).dtypes]
    schema_packed = pa.schema([*zip(keys, kinds, strict=True), ("first", pa.int64()), ("ids", pa.string())])
    schema_digest = pa.schema([*zip(keys, kinds, strict=True), ("ids_sha256", pa.string())])
    strings = ranged.mapInArrow(packed, ", ".join([*key_fields, "first long", "ids string"]))
    dealt = strings.repartition(*keys).sortWithinPartitions(*keys, "first")
    return dealt.mapInArrow(digest, ", ".join([*key_fields, "ids_sha256 string"]))


def told(rows: list[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def rebuilt(turns: DataFrame, group: int = 100, most: int = 6) -> tuple[DataFrame, DataFrame]:
    """(turns, conversations) where each conversation c starts with the first h turns of conversation c - c % group, with h =
    crc32 of c in decimals % most, and goes on with its own turns after its first h. turns: as in_order gives them.

    Only the first turns of every group-th conversation are looked up, at most `most` - 1 rows for each of `group` others.
    """
    convs = turns.select("conv_id").distinct()
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).cast("int")
    base = F.col("conv_id") - F.col("conv_id") % group
    heads = turns.filter((F.col("conv_id") % group == 0) & (F.col("pos") < most)).select(F.col("conv_id").alias("base"), "pos", "role", "text")
    begun = convs.withColumns({"h": h, "base": base}).join(heads, "base").filter("pos <= h").select("conv_id", "pos", "role", "text")
    taken = heads.groupBy("base").agg(F.max("pos").alias("have"))
    shift = F.least(F.col("h"), F.coalesce("have", F.lit(0))) - F.col("h")
    own = turns.withColumns({"h": h, "base": base}).filter("pos > h").join(taken, "base", "left").select("conv_id", (F.col("pos") + shift).alias("pos"), "role", "text")
    return begun.unionByName(own), convs


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of the trie of the rebuilt conversations, with a digest of the conversations that end there."""
    turns = scratch(spark, in_order(table(spark, sf_dir, "conversations")), "turns")
    new, convs = rebuilt(turns)
    nodes, ends = prefix_trie(scratch(spark, new, "rebuilt"), scratch(spark, convs, "convs"))
    digests = id_digests(ends.select(F.col("end_conv_id"), F.col("depth").cast("long").alias("depth"), "conv_id"), ["end_conv_id", "depth"], "conv_id")
    digests = digests.select(F.col("end_conv_id").alias("conv_id"), "depth", F.col("ids_sha256").alias("ends_sha256"))
    df = nodes.withColumn("depth", F.col("depth").cast("long")).join(digests, ["conv_id", "depth"], "left")
    none = F.sha2(F.lit(""), 256)
    return df.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", F.col("saved_chars").alias("saved_tokens"), F.coalesce("ends_sha256", none).alias("ends_sha256"))


def sql_crc32(text: str) -> str:
    """Unsigned CRC-32 of a text of ASCII characters, bit by bit."""
    step = "xor(xor(a, x) >> 1, 3988292384 * (xor(a, x) & 1))"
    bits = f"flatten(list_transform(string_split({text}, ''), lambda c: [CAST(ascii(c) AS BIGINT), 0, 0, 0, 0, 0, 0, 0]))"
    return f"xor(list_reduce({bits}, lambda a, x: {step}, CAST(4294967295 AS BIGINT)), 4294967295)"


OP11_SQL = f"""
WITH o AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos FROM conversations WHERE conv_id IS NOT NULL),
cs AS (SELECT conv_id, conv_id - conv_id % 100 AS base, {sql_crc32("CAST(conv_id AS VARCHAR)")} % 6 AS h FROM (SELECT DISTINCT conv_id FROM o)),
re AS (SELECT cs.conv_id, o.pos, role, text FROM cs JOIN o ON o.conv_id = cs.base AND o.pos <= cs.h
  UNION ALL SELECT cs.conv_id, 1000000 + o.pos, role, text FROM cs JOIN o ON o.conv_id = cs.conv_id AND o.pos > cs.h),
n AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY pos) AS depth, role, text FROM re),
k AS (SELECT conv_id, depth, text, list({{'r': role, 't': text}}) OVER (PARTITION BY conv_id ORDER BY depth) AS key FROM n UNION ALL SELECT conv_id, 0, '', [] FROM cs),
g AS (SELECT depth, key, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(length(text)) AS chars FROM k GROUP BY depth, key),
m AS (SELECT k.conv_id AS member, k.depth, g.conv_id, g.n_convs, g.chars FROM k JOIN g ON k.depth = g.depth AND k.key = g.key),
t AS (SELECT conv_id, depth, n_convs, chars FROM m WHERE member = conv_id),
p AS (SELECT t.conv_id, t.depth, t.n_convs, t.chars, m.conv_id AS parent_conv_id FROM t LEFT JOIN m ON m.member = t.conv_id AND m.depth = t.depth - 1),
c AS (SELECT p.*, coalesce(n, 0) AS n_children FROM p LEFT JOIN (SELECT parent_conv_id AS i, depth - 1 AS d, count(*) AS n FROM p WHERE depth > 0 GROUP BY ALL) x ON p.conv_id = i AND p.depth = d),
s AS (SELECT m.conv_id, m.depth, count(*) FILTER (c.n_children = 0) AS n_leaves, CAST(sum((c.n_convs - 1) * c.chars) AS BIGINT) AS saved_tokens FROM c JOIN m ON m.member = c.conv_id AND m.depth <= c.depth GROUP BY ALL),
e AS (SELECT m.conv_id, m.depth, sha256(string_agg(CAST(member AS VARCHAR), ',' ORDER BY member)) AS sha FROM m JOIN (SELECT conv_id, max(depth) AS last FROM k GROUP BY conv_id) l ON l.conv_id = m.member AND l.last = m.depth GROUP BY ALL)
SELECT c.conv_id, CAST(c.depth AS BIGINT) AS depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, coalesce(sha, sha256('')) AS ends_sha256
FROM c JOIN s ON c.conv_id = s.conv_id AND c.depth = s.depth LEFT JOIN e ON c.conv_id = e.conv_id AND c.depth = e.depth"""
