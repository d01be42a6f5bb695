"""Periodic runs, the prefix trie and Grace dedup against brute force, with nulls, ties, repeats, long texts and empty tables."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import duckdb
import pytest
from pyspark.sql import functions as F

from topicspark.llm import exact_dedup as D
from topicspark.llm import periodic as P
from topicspark.llm import queries, trie

DATA = "/root/testdata/sf0.001"


def brute_runs(w, times=4, least=6):
    n, out = len(w), []
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            s = w[i : j + q]
            if j > i and len(s) >= max(least, times * q) and not any(q % p == 0 and s[p:] == s[:-p] for p in range(1, q)):
                out.append((i, len(s), q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def brute_op12(doc_id, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(w), None if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = w[:a] + [w[a + (i - a) % p] for i in range(a, n)]
    runs = brute_runs(w)
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if runs else (None, None, None)
    gone = {i for s, m, q in runs for i in range(s + q, s + m)}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return len(runs), *best, 1000 * best[1] // best[2] if runs else None, sha("".join(f"{s},{m},{q}\n" for s, m, q in runs)), sha(" ".join(x for i, x in enumerate(w) if i not in gone))


@pytest.mark.parametrize("short", [256, 3])
def test_runs(monkeypatch, short):
    monkeypatch.setattr(P, "SHORT", short)
    rng, n_runs = random.Random(short), 0
    for k in range(700):
        w = [rng.choice("abcdef"[: rng.randint(1, 6)]) for _ in range(rng.randint(0, 60))]
        if k % 2 and w:
            a, p = rng.randrange(len(w)), rng.randint(1, 7)
            w = [x if i < a + p else w[a + (i - a) % p] for i, x in enumerate(w)]
        found, runs = P.runs_of(" ".join(w).encode())
        assert runs == brute_runs(w), w
        n_runs += len(runs)
    assert n_runs > 100


def test_periodic_query(spark, tmp_path):
    rng = random.Random(4)
    rows = [(k, " ".join(rng.choice("a b c d é \x85 the".split(" ")) for _ in range(rng.randint(0, 80))), "x", k) for k in range(300)]
    rows += [(None, None, None, None), (300, "", "x", 0), (301, None, "x", 0), (302, "z\t" * 9, "x", 0), (303, "long " * 3000 + "tail", "x", 0), (304, "p q r " * 700, "x", 0), rows[0]]
    df = spark.createDataFrame(rows, "doc_id long, text string, runs string, collapsed long")
    df.coalesce(2).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(str, map(tuple, P.op12_periodic(spark, str(tmp_path)).collect())))
    assert got == sorted(str((d, *brute_op12(d, t))) for d, t, *_ in rows)
    assert P.periodic_runs(df.filter("false")).count() == 0
    with pytest.raises(ValueError):
        P.periodic_runs(df, times=3)


def test_queries_against_sql(spark):
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    for name in ("op11_prefix_trie", "op13_exact_dedup"):
        df = queries.QUERIES[name](spark, DATA)
        want = con.execute(f"SELECT {', '.join(df.columns)} FROM ({queries.ORACLES[name]})").fetchall()
        assert sorted(map(str, map(tuple, df.collect()))) == sorted(map(str, want))


@pytest.mark.parametrize("shape", ["random", "chain", "star", "forest", "long legs"])
def test_subtree_totals(spark, shape):
    rng, n = random.Random(7), 90
    up = {"random": lambda k: rng.randrange(k), "chain": lambda k: k - 1, "star": lambda k: 0, "forest": lambda k: None if k % 7 == 0 else rng.randrange(k), "long legs": lambda k: max(0, k - 9)}[shape]
    parent = {k: up(k) if k else None for k in range(n)}
    value = {k: rng.choice([None, 0, 5, -3, 2**33]) for k in range(n)}
    want = {k: (value[k] or 0) for k in range(n)}
    for k in reversed(range(n)):
        if parent[k] is not None:
            want[parent[k]] += want[k]
    nodes = spark.createDataFrame([(k, parent[k], value[k], 1) for k in range(n)], "id long, parent long, v long, one int")
    got = {r.id: r.v for r in trie.subtree_totals(nodes, ["v", "one"]).collect()}
    assert got == want


@pytest.mark.parametrize("block", [8192, 7])
def test_contraction_in_tasks(spark, monkeypatch, block):
    """A deep chain with side branches is contracted in few tables, whatever the blocks, and ids may be structs."""
    monkeypatch.setattr(trie, "BLOCK", block)
    monkeypatch.setattr(trie, "MOST", 3 * block)
    written, scratch = [], trie.scratch
    monkeypatch.setattr(trie, "scratch", lambda s, df, name: written.append(name) or scratch(s, df, name))
    n, rng = 400, random.Random(block)
    parent = {k: (k - 1 if k % 10 else max(0, k - 10 - rng.randrange(10))) if k else None for k in range(n)}
    value = {k: rng.choice([None, 0, 5, -3, 2**33]) for k in range(n)}
    want = {k: value[k] or 0 for k in range(n)}
    for k in reversed(range(1, n)):
        want[parent[k]] += want[k]
    pair = lambda k: None if k is None else (k // 50, f"{k:03}")
    nodes = spark.createDataFrame([(pair(k), pair(parent[k]), value[k]) for k in range(n)], "id struct<a:long,b:string>, parent struct<a:long,b:string>, v long")
    got = {int(r.id.b): r.v for r in trie.subtree_totals(nodes, ["v"]).collect()}
    assert got == want
    assert len(written) <= 12


def test_forest_edges(spark):
    kinds = "id long, parent long, v long"
    assert trie.subtree_totals(spark.createDataFrame([], kinds), ["v"]).count() == 0
    assert trie.subtree_totals(spark.createDataFrame([(1, 99, 4)], kinds), ["v"]).collect() == [(1, 4)]  # an unknown parent
    with pytest.raises(ValueError):
        trie.subtree_totals(spark.createDataFrame([(1, 2, 0), (2, 1, 0), (3, 1, 0)], kinds), ["v"])


def brute_trie(rows):
    by = {}
    for c, t, role, text in rows:
        if c is not None:
            by.setdefault(c, []).append((t is not None, t or 0, role or "", text or ""))
    own = {c: [(r, x) for _, _, r, x in sorted(v)] for c, v in by.items()}
    new = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 6
        new[c] = own.get(c - c % 100, [])[:h] + own[c][h:]
    members = {}
    for c, v in new.items():
        for d in range(len(v) + 1):
            members.setdefault(tuple(v[:d]), []).append(c)
    kids, out = {}, []
    for key in members:
        if key:
            kids.setdefault(key[:-1], []).append(key)
    def totals(key):
        below = [totals(k) for k in kids.get(key, [])]
        saved = (len(members[key]) - 1) * (len(key[-1][1]) if key else 0)
        t = (sum(x[0] for x in below) or 1, saved + sum(x[1] for x in below))
        ends = ",".join(str(c) for c in sorted(c for c, v in new.items() if tuple(v) == key))
        out.append((min(members[key]), len(key), min(members[key[:-1]]) if key else None, len(members[key]), len(below), *t, hashlib.sha256(ends.encode()).hexdigest()))
        return t
    if members:
        totals(())
    return out


def test_trie(spark, tmp_path):
    rng = random.Random(9)
    rows = []
    for c in [*range(0, 40), *range(95, 130), 201, 202, 305]:
        rows += [(c, rng.choice([None, t, t]), rng.choice(["user", "", None]), rng.choice(["hi", "ho é🙂", None, "hi " * 500])) for t in range(rng.randint(1, 7))]
    rows += [(5, 1, "user", "same"), (5, 1, "user", "same"), (None, 3, "user", "nobody's"), (7, 2, "us", "erx"), (8, 2, "use", "rx")]
    kinds = "conv_id long, turn long, role string, text string"
    for name, part in (("a", rows), ("b", [])):
        spark.createDataFrame(part, kinds).coalesce(2).write.parquet(f"{tmp_path}/{name}/conversations.parquet")
        got = trie.op11_prefix_trie(spark, f"{tmp_path}/{name}").collect()
        assert sorted(map(str, map(tuple, got))) == sorted(map(str, brute_trie(part)))


@pytest.mark.parametrize("pack", [2, 4096])
def test_id_digests(spark, pack):
    rows = spark.createDataFrame([(k % 3, x) for k, x in enumerate(range(-20, 40))], "k long, x long")
    want = {k: hashlib.sha256(",".join(str(x) for j, x in enumerate(range(-20, 40)) if j % 3 == k).encode()).hexdigest() for k in range(3)}
    assert dict(map(tuple, trie.id_digests(rows, ["k"], "x", pack).collect())) == want


def test_content_table():
    t = D.ContentTable()
    for k in range(3000):  # one hash for all: only complete contents tell them apart
        assert t.first(7 if k < 60 else k, b"c%d" % k, k) == k
    assert [t.first(7 if k < 60 else k, b"c%d" % k, -1) for k in range(3000)] == list(range(3000))


@pytest.mark.parametrize("table_bytes", [200, 48 << 20])
def test_exact_dedup(spark, table_bytes):
    rng = random.Random(1)
    texts = [f"text {k} " + "x" * rng.randint(0, 60) for k in range(60)] + ["", None, "w" * 5000, "é́", "é́ "]
    rows = [(rng.choice([None, k, k, k // 2]), "hot text" if k % 3 == 0 else rng.choice(texts), k) for k in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, hash long").repartition(3)
    got = D.exact_dedup(df, F.col("text"), F.col("doc_id"), ["doc_id", "text", "hash"], table_bytes).select("_row.*", "keep", "group_size", "kept").collect()
    assert len(got) == 400
    groups = {}
    for r in got:
        groups.setdefault(r.text or "", []).append(r)
    assert len(groups) == len({t or "" for _, t, _ in rows})
    for g in groups.values():
        ids = [r.doc_id for r in g if r.doc_id is not None]
        keep = min(ids) if ids else None
        assert {(r.keep, r.group_size) for r in g} == {(keep, len(g))}
        assert [r.doc_id for r in g if r.kept] == [keep]
    assert D.exact_dedup(df.filter("false"), F.col("text"), F.col("doc_id"), ["doc_id"]).count() == 0


def test_buckets_fit(spark):
    kept = spark.range(500).select(F.xxhash64("id").alias("hash"), F.when(F.col("id") == 3, 5000).otherwise(10).cast("long").alias("size"))
    out = D.with_buckets(kept, 100).groupBy("bucket").agg(F.sum("size").alias("s"), F.count("*").alias("n")).collect()
    assert sum(r.n for r in out) == 500 and all(r.s <= 100 or r.n == 1 for r in out) and max(len(r.bucket) for r in out) > 1
