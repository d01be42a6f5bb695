"""E10 whole: what a sync reads and how often, and what becomes of the cursor."""

import time

from pyspark.sql import functions as F

from topicspark.functions import text as T
from topicspark.operators import matching as MA
from topicspark.plans import jobs

CLAIMS = "id string, claim string, categories array<string>, keywords array<string>"


def test_parts_of_a_sync(spark):
    """Each kind of topic: new and known facts, colliding keys, keys that are gone, topics without facts."""
    rows = [("a", "S", "Red blue", 1), ("a", "S", "green", 2), ("b", "S", "same", 3), ("b", "S", "Same!", 4), ("b", "S", "other", 5), ("e", "S", "red", 6)]
    facts = spark.createDataFrame(rows, "topic string, source_id string, text string, n int").withColumn("categories", F.array(F.lit("x")))
    key = lambda text: spark.range(1).select(T.fact_key(F.lit("S"), F.lit(text))).first()[0]
    cursor = spark.createDataFrame([("a", key("green")), ("a", "gone"), ("b", "gone"), ("b", key("other")), ("c", "gone"), ("c", "gone")], "topic string, fact_key string")
    s = jobs.sync_claims(facts, spark.createDataFrame([("V-1", "red", ["x"], ["red"])], CLAIMS), cursor)
    assert s.new.columns == [*facts.columns, "fact_key"]
    assert sorted((r.topic, r.n, r.fact_key) for r in s.new.collect()) == [("a", 1, key("red blue")), ("e", 6, key("red"))]
    assert [tuple(r) for r in s.skipped.collect()] == [("b", "fact keys collide")]
    assert sorted(tuple(r) for r in s.cursor.collect()) == sorted([("a", key("red blue")), ("a", key("green")), ("b", "gone"), ("b", key("other")), ("c", "gone"), ("e", key("red"))])
    assert sorted((r.topic, r.id, r.score) for r in s.matches.collect()) == [("a", "V-1", 0.7), ("e", "V-1", 1.0)]


def test_facts_are_keyed_once(spark, tmp_path):
    """All frames of a sync together read and key the facts once."""
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def told(text):
        seen.add(1)
        return text

    rows = [(f"t{k % 7}", "S", f"red word{k}") for k in range(50)]
    spark.createDataFrame(rows, "topic string, source_id string, text string").write.parquet(f"{tmp_path}/facts")
    facts = spark.read.parquet(f"{tmp_path}/facts").withColumns({"text": told.asNondeterministic()("text"), "categories": F.array(F.lit("x"))})
    s = jobs.sync_claims(facts, spark.createDataFrame([("V-1", "red", ["x"], ["red"])], CLAIMS), spark.createDataFrame([], "topic string, fact_key string"))
    assert [df.count() for df in s] == [50, 50, 0, 50]
    assert seen.value == 50


def shuffled(spark):
    """Bytes that the session's tasks have written to shuffles so far."""
    time.sleep(1)  # the status store is brought up to date now and then
    return spark.sparkContext._jsc.sc().statusStore().executorList(False).head().totalShuffleWrite()


def test_pairs_are_not_shuffled(spark):
    """Every text shares its words with every claim: what moves grows with the texts, not with the pairs."""
    words = ["red", "blue", "green"]
    facts = spark.range(400).select(F.col("id").alias("k"), F.concat(F.lit("red blue green "), F.md5(F.col("id").cast("string"))).alias("text"), F.array(F.lit("x")).alias("categories")).cache()
    claims = spark.createDataFrame([(f"V-{k:03d}", f"red blue green {'own' * (k % 7)}{k}", ["x"], words) for k in range(500)], CLAIMS)
    facts.count()
    before = shuffled(spark)
    best = MA.match_claims(facts, claims, ["k"]).collect()
    moved = shuffled(spark) - before
    assert sorted((r.k, r["rank"], r.id) for r in best) == [(k, n, f"V-{n - 1:03d}") for k in range(400) for n in (1, 2, 3)]
    assert 0 < moved < 10 * 400 * 500, moved
