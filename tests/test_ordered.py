"""Running totals along hot keys against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from topicspark.operators import ordered as O
from topicspark.operators import stats as ST


@pytest.mark.parametrize("most, small", [(50, 0), (10**6, 0), (50, 10**12)])
def test_running(spark, most, small):
    rng = random.Random(5)
    keys = ["hot"] * 400 + [None] * 120 + [f"k{k % 30}" for k in range(200)]
    rows = [(k, n // 2, n, rng.choice([None, 3, -7, 2**40])) for n, k in enumerate(keys)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "key string, at int, id int, value long").repartition(5)
    totals = {"n": ("count", None), "s": ("sum", F.col("value")), "x": ("xor", F.col("value")), "m": ("max", F.col("value"))}
    got = {r.id: r for r in O.running(df, ["key"], ["at", F.desc("id")], totals, most, small).collect()}
    assert len(got) == len(rows)
    for key in set(keys):
        s = x = m = None
        for n, (_, _, id_, v) in enumerate(sorted((r for r in rows if r[0] == key), key=lambda r: (r[1], -r[2])), 1):
            if v is not None:
                s, x, m = (s or 0) + v, (x or 0) ^ v, v if m is None else max(m, v)
            r = got[id_]
            assert (r.n, r.s, r.x, r.m) == (n, s, x, m), (key, n)


def test_hot_key_is_spread(spark):
    df = spark.range(5000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("key"), "id")
    out = O.numbered(df, ["key"], ["id"], "n", most=200, small=0)
    tasks = out.filter("key = 'hot'").groupBy(F.spark_partition_id()).count().collect()
    assert out.agg(F.max("n")).first()[0] == 1667 and max(r["count"] for r in tasks) < 1667
    assert O.numbered(df.filter("false"), ["key"], ["id"], "n", small=0).count() == 0


def test_latencies_from_histograms(spark):
    """Histograms, split and added again, give what the calls themselves give."""
    rng = random.Random(3)
    rows = [(rng.choice(["a", "a", "a", "b", "c"]), rng.choice([None, *range(30)]), rng.choice(["success", "success", "failure", None])) for _ in range(500)] + [("d", 5, "failure")]
    calls = spark.createDataFrame(rows, "topic string, ms bigint, outcome string")
    parts = [ST.latency_histogram(calls.filter(F.col("ms") % 2 == 0)), ST.latency_histogram(calls.filter(~F.coalesce(F.col("ms") % 2 == 0, F.lit(False))))]
    added = parts[0].unionByName(parts[1]).groupBy("topic", "ms").agg(F.sum("n").alias("n"))
    want = {r.topic: r.asDict() for r in ST.latencies(calls).collect()}
    assert {r.topic: r.asDict() for r in ST.histogram_latencies(added).collect()} == want and len(want) == 4


@pytest.mark.parametrize("most, small", [(20, 0), (10**6, 10**12)])
def test_pages(spark, most, small):
    """Pages of hot, null and one-row keys against a plain loop: bounded rows and bytes, nothing lost, order kept."""
    rng = random.Random(8)
    rows = [(rng.choice(["hot", "hot", None, f"k{n % 40}"]), n, None if n % 17 == 0 else "x" * rng.randrange(30) + ("y" * 500 if n % 91 == 0 else "")) for n in range(700)]
    df = spark.createDataFrame(rows, "key string, id int, text string").repartition(6)
    got = O.paged(df, ["key"], ["id"], ["id", "text"], "items", F.octet_length("text"), 15, 200, most, small).collect()
    want = {}
    for key in {r[0] for r in rows}:
        before = 0
        for at, (_, id_, text) in enumerate(sorted((r for r in rows if r[0] == key), key=lambda r: r[1])):
            want.setdefault((key, at // 15 + before // 200), []).append((id_, text))
            before += len(text or "")
    assert {(r.key, r.page): [tuple(x) for x in r["items"]] for r in got} == want
    assert all(r.n == len(r["items"]) <= 15 and sum(len(x.text or "") for x in r["items"][:-1]) <= 200 for r in got)
    assert O.paged(df.filter("false"), ["key"], ["id"], ["id"], "items", small=small).count() == 0
