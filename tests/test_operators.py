"""Literal cases of the operators' semantics."""

import pytest
from pyspark.sql import functions as F

from topicspark.functions import text as T
from topicspark.operators import facts as FA
from topicspark.operators import lineage as LI
from topicspark.operators import matching as MA
from topicspark.operators import quality as QU
from topicspark.operators import routing as RO
from topicspark.operators import stats as ST
from topicspark.operators import tree as TR
from topicspark.operators import triage as TI
from topicspark.plans import jobs


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


SCALARS = [
    lambda: (T.normalise_fact(F.lit("  Sorensen, C.E.!!  visits  Willow Run.  ")), "sorensen ce visits willow run"),
    lambda: (T.normalise_fact(F.lit("ouè")), "ou"),
    lambda: (T.tokens(F.lit("the the fleet and consolidated fleet")), ["fleet", "consolidated"]),
    lambda: (T.normalise_path(F.lit("intake/dump/Helene_I-photos\\scan.JPG")), "intake dump helene i photos scan.jpg"),
    lambda: (T.contains_words(F.lit("incubator reports"), F.lit("cuba")), False),
    lambda: (T.contains_words(F.lit("écuba libre"), F.lit("cuba")), True),
    lambda: (T.node_type(F.lit("cuba/industry/automotive")), "subtopic"),
    lambda: (T.parent_path(F.lit("cuba")), None),
    lambda: (T.version_bump(F.lit("1.2.3"), "minor"), "1.3.0"),
    lambda: (T.html_text(F.lit('<script>var x="<p>";</script><p>&quot;best&quot; of&nbsp;times &amp;lt;</p>')), '"best" of times <'),
    lambda: (T.clock(F.lit(6_001_000)), "100:01"),
    lambda: (T.frame_times(F.lit(9000), F.lit(1)), [4500.0]),
    lambda: (T.frame_times(F.lit(25000), F.lit(3)), [0.0, 10000.0, 20000.0]),
    lambda: (T.compact_timestamp(F.lit("2026-01-02T03:04:05.678Z")), "20260102T030405"),
    lambda: (T.escape_html(F.lit("<a & 'b'>")), "&lt;a &amp; &#39;b&#39;&gt;"),
    lambda: (T.extension(F.lit("a.b/scan.JPG")), ".jpg"),
    lambda: (T.extension(F.lit("a.b/scan")), ""),
    lambda: (T.image_format(F.unhex(F.lit("89504E470D0A1A0A"))), "png"),
    lambda: (T.image_format(F.unhex(F.lit("52494646AABBCCDD57454250"))), "webp"),
    lambda: (RO.resolved(F.lit("intake/a/../b/./c")), "intake/b/c"),
    lambda: (RO.resolved(F.lit("../x")), None),
    lambda: (TI.geometry_kind(F.lit(1000), F.lit(1300))["kind"], "text-doc"),
    lambda: (TI.geometry_kind(F.lit(1000), F.lit(1299))["kind"], "photo"),
    lambda: (TI.geometry_kind(F.lit(0), F.lit(5))["confidence"], 0.0),
    lambda: (QU.valid_actor(F.lit("ACTOR-12")), False),
]


@pytest.mark.parametrize("case", SCALARS)
def test_scalar(spark, case):
    column, want = case()
    assert one(spark, column) == want


def test_fact_key_falls_back_to_the_raw_text(spark):
    df = spark.createDataFrame([('"',), ("реакто",), ("%",)], "text string")
    assert df.select(T.fact_key(F.lit("SRC-001"), F.col("text"))).distinct().count() == 3


def test_matching(spark):
    facts = spark.createDataFrame([(1, "Sorensen and Fleet discuss the San Diego bomber contract.", ["biography", "industry"]), (2, "zzz", ["history"])], "k int, text string, categories array<string>")
    claims = spark.createDataFrame(
        [("V-1", "Sorensen and Fleet negotiate the San Diego bomber deal.", ["biography", "industry"], ["fleet", "san", "diego", "bomber"])] + [(f"V-{k}", "other words", ["history"], None) for k in (9, 8, 7, 6, 5)],
        "id string, claim string, categories array<string>, keywords array<string>",
    )
    got = {(r.k, r["rank"]): r for r in MA.match_claims(facts, claims, ["k"]).collect()}
    assert got[1, 1].id == "V-1" and got[1, 1].score > 0.6 and got[1, 1].bucket == "high"
    assert [(got[2, r].id, got[2, r].score, got[2, r].bucket) for r in (1, 2, 3)] == [("V-5", 0.4, "medium"), ("V-6", 0.4, "medium"), ("V-7", 0.4, "medium")]
    assert (2, 4) not in got


def test_scores(spark):
    df = spark.createDataFrame([(0.92, ["history", "genealogy"]), (0.95, ["history", "genealogy"])], "confidence double, categories array<string>")
    a, b = FA.scores(df).orderBy("confidence").collect()
    assert (a.relevance, a.genealogy, a.historical, a.novelty) == (92.0, 80.0, 80.0, 50.0)
    assert b.promoted and not FA.scores(df, 100.0).filter("promoted").count()


def test_routing(spark):
    routing = spark.createDataFrame([("helene", 0, "helene", 0), ("helene-i", 1, "helene i", 0), ("a", 2, "mfm", 0), ("b", 3, "mfm", 0), ("c", 4, "c++ notes", 0)], "topic string, topic_ord int, keyword string, keyword_ord int")
    paths = spark.createDataFrame([("intake/dump/Helene I photos/scan.jpg",), ("x/mfm.txt",), ("x/Incubator",), ("x/my c++ notes.txt",)], "path string")
    got = {r.path: (r.topic, r.keyword, r.ambiguous) for r in RO.classified(paths, routing).collect()}
    assert got["intake/dump/Helene I photos/scan.jpg"] == ("helene-i", "helene i", False)
    assert got["x/mfm.txt"] == (None, None, True)
    assert got["x/Incubator"] == (None, None, False)
    assert got["x/my c++ notes.txt"] == ("c", "c++ notes", False)


def test_latency(spark):
    df = spark.createDataFrame([("t", 1000, "success"), ("t", 95000, "failure")], "topic string, ms bigint, outcome string")
    r = ST.latencies(df).first()
    assert (r.p50, r.over_budget, r.failure_rate) == (1000, False, 0.5)


def test_lineage(spark):
    ops = LI.built(spark.createDataFrame([("t", 1, "CREATE", "{}"), ("t", 2, "INGEST", '{"a":1}')], "topic string, seq int, op string, payload string"))
    heads = ops.groupBy("topic").agg(F.max_by("hash", "seq").alias("hash"))
    assert LI.checked(ops, heads).first().valid
    broken = ops.withColumn("hash", F.when(F.col("seq") == 1, "x").otherwise(F.col("hash")))
    r = LI.checked(broken, heads).first()
    assert (r.valid, r.broken_at) == (False, "OP-0001")


def test_tree_and_rollup(spark):
    nodes = TR.expanded(spark.createDataFrame([("cuba/industry/automotive", ["x"])], "path string, tags array<string>"))
    got = {r.path: r for r in nodes.collect()}
    assert got["cuba"].children == ["industry"] and got["cuba/industry"].parent == "cuba" and got["cuba/industry"].node_type == "topic"
    scores = spark.createDataFrame([("cuba/industry/automotive", 1.0), ("cuba", 2.0)], "topic string, s double")
    assert {(r.ancestor, r.descendant) for r in jobs.score_rollup(scores, nodes).scores.collect()} == {("cuba", "cuba/industry/automotive"), ("cuba/industry", "cuba/industry/automotive")}


def test_labels(spark):
    df = spark.createDataFrame([(1, "Homepage", 0.9), (2, "Documents", 0.8), (3, "A letter", 0.4)], "image int, description string, score double")
    got = {r.image: (r.kind, round(r.confidence, 6)) for r in TI.label_kinds(df).collect()}
    assert got == {1: ("photo", 1.0), 2: ("text-doc", 0.8), 3: ("photo", 0.6)}


def test_sync_skips_colliding_topics_and_replaces_the_cursor(spark):
    facts = spark.createDataFrame([("a", "SRC-001", "Same fact."), ("a", "SRC-001", "same FACT"), ("b", "SRC-001", "one"), ("b", "SRC-001", "two")], "topic string, source_id string, text string").withColumn("categories", F.array().cast("array<string>"))
    claims = spark.createDataFrame([("V-1", "two words", [], [])], "id string, claim string, categories array<string>, keywords array<string>")
    key = T.fact_key(F.lit("SRC-001"), F.lit("one"))
    cursor = spark.range(1).select(F.lit("b").alias("topic"), key.alias("fact_key")).union(spark.createDataFrame([("c", "k")], "topic string, fact_key string"))
    s = jobs.sync_claims(facts, claims, cursor)
    assert [r.topic for r in s.skipped.collect()] == ["a"]
    assert [r.text for r in s.new.collect()] == ["two"]
    assert s.matches.count() == 1
    assert {r.topic: r.n for r in s.cursor.groupBy("topic").agg(F.count("*").alias("n")).collect()} == {"b": 2, "c": 1}
    again = jobs.sync_claims(facts, claims, s.cursor)
    assert again.new.count() == 0


def test_reruns_skip_done_and_retry_failed(spark):
    files = spark.createDataFrame([("a/1.txt", "h1"), ("a/2.txt", "h1"), ("a/3.txt", "h2")], "path string, hash string")
    prior = spark.createDataFrame([("h1", "done"), ("h2", "failed")], "hash string, status string")
    assert {r.path: r.outcome for r in TI.triaged(files, prior).collect()} == {"a/1.txt": "skipped", "a/2.txt": "duplicate", "a/3.txt": "processed"}
