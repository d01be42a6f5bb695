"""End-to-end jobs over small frames."""

from pyspark.sql import functions as F

from topicspark.operators import facts as FA
from topicspark.operators import lineage as LI
from topicspark.plans import jobs


def test_create_ingest_score_validate(spark):
    none = spark.createDataFrame([], "path string")
    nodes, ops = jobs.create_topics(spark.createDataFrame([("cuba/sugar", ["trade"]), ("cuba/rum", ["trade", "x"])], "path string, tags array<string>"), none, "ACTOR-001")
    assert {r.path: r.node_type for r in nodes.collect()} == {"cuba": "project", "cuba/sugar": "topic", "cuba/rum": "topic"}
    log = jobs.logged(spark.createDataFrame([], "topic string, seq int, op string, payload string"), ops, "op")

    new = spark.createDataFrame([("cuba/sugar", "A", "o", "one\n\n two ", "1"), ("cuba/sugar", "B", "o", "three", "2")], "topic string, title string, origin string, text string, added_at string")
    sources, more = jobs.register_sources(new, spark.createDataFrame([("cuba/sugar",)], "topic string"))
    assert [r.source_id for r in sources.orderBy("added_at").collect()] == ["SRC-002", "SRC-003"]
    log = jobs.logged(log, more, "payload")
    heads = log.groupBy("topic").agg(F.max_by("hash", "seq").alias("hash"))
    assert {r.topic: r.n for r in log.groupBy("topic").agg(F.count("*").alias("n")).collect()} == {"cuba": 1, "cuba/sugar": 3, "cuba/rum": 1}
    assert LI.checked(log, heads).filter("NOT valid").count() == 0

    facts, summaries = jobs.extract(sources.drop("text"), sources.select("topic", "source_id", "text").withColumn("kind", F.lit("text")))
    assert [(r.fact_id, r.text) for r in facts.orderBy("fact_id").collect()] == [("FCT-001", "one"), ("FCT-002", "two"), ("FCT-003", "three")]
    assert summaries.first().summary == "Extracted 2 fact(s) from A.\n\nExtracted 1 fact(s) from B."
    facts = facts.withColumn("categories", F.array(F.lit("history")))

    envelopes = sources.select("topic", "source_id", (F.col("title") == "A").alias("mock"))
    broken = log.withColumn("payload", F.when(F.col("topic") == "cuba/rum", F.lit("{}")).otherwise(F.col("payload")))
    got = {r.topic: (r.valid, r.errors, r.warnings) for r in jobs.validate(nodes, facts, broken, heads, envelopes).collect()}
    assert got == {"cuba": (True, [], []), "cuba/sugar": (True, [], ["mock_source"]), "cuba/rum": (False, ["lineage_error"], [])}

    timing = spark.createDataFrame([("cuba/sugar", 10, "success"), ("cuba/rum", 20, "failure"), ("cuba/rum", 30, "success")], "topic string, ms bigint, outcome string")
    record = {r.path: r for r in jobs.feedback(nodes, facts, sources.withColumn("kind", F.lit("text")), timing).collect()}
    assert (record["cuba"].facts, record["cuba"].medium, record["cuba"].calls, round(record["cuba"].failure_rate, 6)) == (3, 3, 3, 0.333333)
    assert record["cuba/sugar"].density == 3 / (record["cuba/sugar"].bytes / 1024)
    assert {r.topic: r.p90 for r in jobs.latency_record(timing, nodes).collect()} == {"cuba": 30, "cuba/sugar": 10, "cuba/rum": 30}

    issues = spark.createDataFrame([("cuba/rum", "mock_source"), ("cuba/rum", "schema_error"), ("cuba/sugar", "mock_source")], "topic string, type string")
    scored = facts.withColumn("promoted", F.lit(True)).filter("topic = 'cuba/sugar'")
    whole = {r.path: r for r in jobs.quality_records(nodes, facts, sources.withColumn("kind", F.lit("text")), scored, timing, issues).collect()}
    cuba, rum = whole["cuba"], whole["cuba/rum"]
    assert (cuba.extract.facts, cuba.latency.p90, cuba.issues.mock_source, cuba.issues.schema_error, cuba.issues.hand_edited) == (3, 30, 2, 1, 0)
    assert cuba.score.promoted == scored.count() and cuba.extract.density == record["cuba"].density and cuba.completeness.has_score
    assert (rum.score.promoted, rum.completeness.has_score, rum.completeness.has_timing, rum.completeness.has_validate) == (0, False, True, True)
    bare = jobs.quality_records(nodes, facts.limit(0), sources.limit(0).withColumn("kind", F.lit("text")), scored.limit(0), timing.limit(0), issues.limit(0)).collect()
    assert len(bare) == len(whole) and all(r.extract.categories == {} and r.extract.density == 0.0 and not r.completeness.has_extract and r.completeness.has_validate for r in bare)

    bundles, groups, register = jobs.report(sources, facts)
    assert bundles.first().fact_count == 3 and groups.first().category == "history" and register.count() == 2

    bumped, _ = jobs.bump_versions(nodes, "minor")
    assert {r.version for r in bumped.collect()} == {"0.2.0"}
    edges, _ = jobs.crosslink(spark.createDataFrame([("cuba/sugar", "cuba/rum")], "topic string, related_topic string"), nodes)
    assert edges.first().strength == 0.5


def test_ingest_batch_and_route(spark):
    files = spark.createDataFrame([("t", "in/a.txt", "x\ny", None), ("t", "in/b.txt", "x\ny", None), ("t", "in/c.xyz", None, "unsupported"), ("t", "in/d.txt", "done", None)], "topic string, path string, text string, error string")
    done = spark.sql("SELECT 't' AS topic, sha2('done', 256) AS hash, 'done' AS status")
    out = jobs.ingest_batch(files, done)
    assert out.facts.count() == 2
    assert tuple(out.summary.first()) == (2, 1, 1, 1)
    assert jobs.ingest_batch(files, done, force=True).facts.count() == 3

    rows, manifest, summary = jobs.triage(spark.createDataFrame([("in/cuba/a.txt", "h"), ("in/b/a2.txt", "h"), ("in/c.xyz", "k")], "path string, hash string"), spark.createDataFrame([], "hash string, status string"))
    assert summary.first().duplicate == 1 and manifest.count() == 2
    routing = spark.createDataFrame([("cuba", 0, "cuba", 0)], "topic string, topic_ord int, keyword string, keyword_ord int")
    routed = jobs.route(manifest.withColumn("status", F.lit("done")), routing, spark.createDataFrame([("x",)], "path string"))
    assert [r.name for r in routed.staged.collect()] == ["a.txt"]
    assert {r.topic: r.n for r in routed.counts.collect()} == {"cuba": 1, "unsorted": 2}
    assert [r.topic for r in routed.missing.collect()] == ["cuba"]


def test_user_extractor(spark):
    inputs = spark.createDataFrame([("t", "SRC-001", "T", "a b"), ("t", "SRC-002", "U", "")], "topic string, source_id string, title string, text string")
    got = FA.extracted_by(inputs, lambda title, text: [(w, 0.7, ["history"]) for w in text.split()]).collect()
    assert [(r.source_id, r.pos, r.text) for r in got] == [("SRC-001", 0, "a"), ("SRC-001", 1, "b")]


def test_extraction_function(spark):
    inputs = spark.createDataFrame([("t", "SRC-001", "T", "a b"), ("t", "SRC-002", "U", ""), ("u", "SRC-001", "V", None)], "topic string, source_id string, title string, text string")

    def runner(title, text):
        for w in text.split():  # fails on the null text
            yield w, 0.7, ["history"]

    facts, failures = FA.extracted_or_failed(inputs, runner)
    assert sorted((r.topic, r.source_id, r.pos, r.text) for r in facts.collect()) == [("t", "SRC-001", 0, "a"), ("t", "SRC-001", 1, "b")]
    assert [(r.topic, r.source_id, r.error.split(":")[0]) for r in failures.collect()] == [("u", "SRC-001", "AttributeError")]
    spark.udtf.register("extract_words", FA.extraction_function(runner))
    inputs.createOrReplaceTempView("inputs")
    assert spark.sql("SELECT * FROM extract_words(TABLE(inputs) PARTITION BY (topic, source_id)) WHERE error IS NULL").count() == 2
