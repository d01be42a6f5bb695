"""Scans, sinks and streams over small files."""

import json

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from topicspark.sources import readers as R
from topicspark.sources import writers as W
from topicspark.sources.versioned import VersionedTable
from topicspark.streaming import streams as ST


@pytest.fixture()
def root(tmp_path):
    for topic, facts in (("cuba", [{"id": "FCT-001", "text": "a", "source_id": "SRC-001", "confidence": 0.5, "categories": ["history"]}]), ("cuba/sugar", "broken"), ("cuba/rum", [{"id": "F", "text": "a", "source_id": "SRC-001", "confidence": 2, "categories": []}])):
        d = tmp_path / "vault" / topic
        d.mkdir(parents=True, exist_ok=True)
        (d / "topic.json").write_text(json.dumps({"topic": topic, "path": topic, "children": [], "tags": ["x"], "status": "active"}))
        (d / "extract.json").write_text("{" if facts == "broken" else json.dumps({"facts": facts, "summary": "s"}, indent=1))
        (d / "metadata.json").write_text(json.dumps({"sources": [{"id": "SRC-001", "title": "T", "origin": "O"}]}))
    (tmp_path / "vault/cuba/lineage.json").write_text(json.dumps({"hash": "h", "operations": [{"id": "OP-0001", "op": "CREATE", "hash": "h", "payload": "{}"}]}))
    (tmp_path / "vault/cuba/raw-SRC-001.json").write_text(json.dumps({"sourceId": "SRC-001", "kind": "text", "text": "x"}))
    (tmp_path / "vault/cuba/manifest.json").write_text(json.dumps({"entries": {"abc": {"sourcePath": "p", "status": "done"}}}))
    return str(tmp_path / "vault")


def test_scans(spark, root, tmp_path):
    topics = R.read_topics(spark, root)
    assert {r.path for r in topics.collect()} == {"cuba", "cuba/sugar", "cuba/rum"}
    facts, skipped = R.read_facts_or_skip(spark, root, topics.unionByName(topics.limit(1).withColumn("path", F.lit("cuba/none"))))
    assert [r.topic for r in facts.collect()] == ["cuba"]
    assert {r.topic: r.reason.split(":")[0] for r in skipped.collect()} == {"cuba/rum": "invalid", "cuba/sugar": "unparseable", "cuba/none": "missing"}
    ops, heads = R.read_lineage(spark, root, topics)
    assert [(r.topic, r.seq, r.op_id) for r in ops.collect()] == [("cuba", 1, "OP-0001")]
    assert {r.topic: r.hash for r in heads.collect()} == {"cuba": "h", "cuba/sugar": "GENESIS", "cuba/rum": "GENESIS"}
    assert R.read_sources(spark, root).count() == 3
    assert R.read_envelopes(spark, root).first().source_id == "SRC-001"
    assert R.read_entries(spark, root, "manifest.json").first().hash == "abc"
    assert {r.path for r in R.discover_topics(topics, "cuba").collect()} == {"cuba/sugar", "cuba/rum"}
    (tmp_path / "routing.json").write_text(json.dumps({"b": ["x", "y"], "a": ["z"]}))
    assert [tuple(r) for r in R.read_routing(spark, str(tmp_path / "routing.json")).orderBy("topic_ord", "keyword_ord").collect()] == [("b", 0, "x", 0), ("b", 0, "y", 1), ("a", 1, "z", 0)]
    (tmp_path / "claims.json").write_text(json.dumps({"version": 1, "items": [{"id": "V-1", "beat": "b", "claim": "c"}]}))
    assert R.read_claims(spark, str(tmp_path / "claims.json")).first().id == "V-1"


def test_files(spark, tmp_path):
    d = tmp_path / "in"
    d.mkdir()
    for name, text in (("a.txt", "hello"), ("b.md", "  \n"), ("c.xyz", "x"), ("d e+f%41.txt", ""), ("e.txt", "")):
        (d / name).write_text(text)
    got = {r.path.rsplit("/", 1)[1]: (r.text, r.error) for r in R.read_texts(spark, str(d)).collect()}
    assert got == {"a.txt": ("hello", None), "b.md": ("  \n", "no text"), "c.xyz": (None, "unsupported file type: .xyz"), "d e+f%41.txt": ("", "no text"), "e.txt": ("", "no text")}
    hashed = W.with_hashes(R.list_files(spark, str(d)))
    assert hashed.select("content_hash").distinct().count() == 4 and hashed.filter("size_bytes = 0").count() == 2


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), ("b", 2)], "topic string, n int")
    path = str(tmp_path / "t")
    W.overwrite(df, path, by_topic=True)
    W.overwrite(df.filter("topic = 'a'").withColumn("n", F.lit(9)), path, by_topic=True)
    assert {r.topic: r.n for r in spark.read.parquet(path).collect()} == {"a": 9, "b": 2}
    with pytest.raises(AnalysisException):
        W.write_once(df, path)
    W.append_log(df, str(tmp_path / "log"))
    W.append_log(df, str(tmp_path / "log"))
    assert spark.read.json(str(tmp_path / "log")).count() == 4
    texts = spark.createDataFrame([("a", "SRC-001", "x"), ("a", "SRC-002", "y")], "topic string, source_id string, text string")
    done, skipped = W.envelopes_of(texts, texts.limit(1))
    assert done.count() == skipped.count() == 1


def test_streams(spark, tmp_path):
    log = tmp_path / "log"
    log.mkdir()
    (log / "1.json").write_text('{"topic":"a","outcome":"failure"}\n\n{"topic":"a","outcome":"success"}\n')
    q = ST.metric_stream(spark, str(log)).writeStream.outputMode("complete").format("memory").queryName("metrics").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c0")).start()
    q.awaitTermination()
    assert [tuple(r) for r in spark.table("metrics").collect()] == [("a", 2, 1)]

    facts, schema = tmp_path / "facts", "topic string, fact_key string"
    sink = ST.new_fact_sink(str(tmp_path / "cursor"), str(tmp_path / "reports"))

    def feed(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(facts))
        ST.started(spark.readStream.schema(schema).parquet(str(facts)), sink, str(tmp_path / "c1")).awaitTermination()

    feed([("a", "1"), ("a", "2")])
    feed([("a", "2"), ("a", "3"), ("b", "1")])
    feed([("a", "1")])
    got = [sorted(tuple(r) for r in spark.read.schema(schema).parquet(str(p)).collect()) for p in sorted((tmp_path / "reports").iterdir())]
    assert got == [[("a", "1"), ("a", "2")], [("a", "3"), ("b", "1")], [("a", "1")]]  # a fact that went and came back is new

    files, fschema = tmp_path / "files", "path string, hash string"
    isink = ST.ingest_sink(str(tmp_path / "manifest"))
    for rows in ([("x/a.txt", "h1"), ("x/b.xyz", "h2")], [("y/a.txt", "h1"), ("y/b.txt", "h2")]):
        spark.createDataFrame(rows, fschema).coalesce(1).write.mode("append").parquet(str(files))
        ST.started(spark.readStream.schema(fschema).parquet(str(files)), isink, str(tmp_path / "c2")).awaitTermination()
    last = ST.manifest_table(spark, str(tmp_path / "manifest")).read()
    assert {r.hash: r.status for r in last.collect()} == {"h1": "done", "h2": "done"}


def replay(spark, tmp_path, run, rows_of):
    """The reports of batches of which each is run again after its state was written and after its version was lost."""
    schema = "topic string, fact_key string, run bigint"
    cursor, reports = tmp_path / "cursor", tmp_path / "reports"
    sink = ST.new_fact_sink(str(cursor), str(reports), run)
    table = ST.cursor_table(spark, str(cursor))
    state = lambda n: sorted(map(str, table.merged(table.segments(sorted(v for v in table.versions() if v[:13] == f"v{n:012d}")[-1])).collect()))
    read = lambda n: sorted(tuple(r)[:2] for r in spark.read.parquet(str(reports / f"batch-{n:09d}")).filter("NOT late").collect())
    out = []
    for n, rows in enumerate(rows_of):
        batch = spark.createDataFrame(rows, schema)
        sink(batch, n)
        once = read(n), state(n)
        sink(batch, n)  # died after the version was written
        assert (read(n), state(n)) == once
        for v in (cursor / "versions").glob(f"v{n:012d}*"):
            v.unlink()  # died before
        for v in (cursor / "versions").glob(f".v{n:012d}*"):
            v.unlink()
        sink(batch, n)
        assert (read(n), state(n)) == once
        out.append(once[0])
    return out, table


def test_replayed_batches(spark, tmp_path):
    batches = [[(t, k, 0) for t, k in b] for b in ([("a", "1"), ("a", "2")], [("a", "2"), ("a", "3")], [("b", "1")], [("b", "1"), ("b", "2")])]
    got, _ = replay(spark, tmp_path, None, batches)
    assert got == [[("a", "1"), ("a", "2")], [("a", "3")], [("b", "1")], [("b", "2")]]

    manifest = tmp_path / "manifest"
    ingest = ST.ingest_sink(str(manifest))
    files = spark.createDataFrame([("x/a.txt", "h1"), ("x/b.xyz", "h2")], "path string, hash string")
    for _ in range(2):
        ingest(files, 0)
        assert {r.hash: r.status for r in ST.manifest_table(spark, str(manifest)).read().collect()} == {"h1": "done", "h2": "failed"}


def test_runs_over_several_batches(spark, tmp_path):
    """A topic's run is spread over batches: its facts are judged by the whole run before, and told once."""
    batches = [
        [("a", "k1", 1), ("b", "x", 1)],
        [("a", "k2", 1), ("a", "k2", 1)],
        [("a", "k1", 1)],  # the same run again: told before
        [("a", "k2", 2), ("a", "k3", 2)],
        [("a", "k1", 2), ("a", "k2", 2), ("b", None, 2)],  # k1 was in run 1; b has no facts any more
        [("a", "k9", 1), ("b", "x", 3), ("a", "k4", 3), ("a", "k4", 4), ("a", "k3", 4)],  # late; back again; two runs in one batch
    ]
    got, table = replay(spark, tmp_path, "run", batches)
    assert got == [[("a", "k1"), ("b", "x")], [("a", "k2")], [], [("a", "k3")], [], [("a", "k3"), ("a", "k4"), ("b", "x")]]
    late = spark.read.parquet(str(tmp_path / "reports" / "batch-000000005")).filter("late").collect()
    assert [tuple(r)[:3] for r in late] == [("a", "k9", 1)]
    assert len(table.versions()) <= 4


def test_versioned_table(spark, tmp_path):
    kinds = "k long, v string"
    t = VersionedTable(spark, str(tmp_path / "t"), kinds, ["k"], 16)
    rows = lambda *r: spark.createDataFrame(list(r), kinds)
    read = lambda *a: sorted((tuple(r) for r in t.read(*a).collect()), key=str)
    assert read() == [] and t.lookup(rows((1, "x"))).count() == 0
    t.upsert(rows(*[(k, "old") for k in range(500)], (None, "null")))
    before = sum(s["rows"] for s in t.segments(t.version_before()))
    t.upsert(rows((1, "new"), (2, "gone"), (900, "more"), (None, "null again")), gone=F.col("v") == "gone")
    assert sum(s["rows"] for s in t.segments(t.version_before())) == before + 4  # in proportion to the batch
    want = sorted([(k, "old") for k in range(500) if k not in (1, 2)] + [(1, "new"), (900, "more"), (None, "null again")], key=str)
    assert read() == want and read(1) == sorted([(k, "old") for k in range(500)] + [(None, "null")], key=str)
    with pytest.raises(Exception):  # a batch that fails leaves the table as it was, and no reader sees it
        t.upsert(spark.range(3).selectExpr("id AS k", "CAST(assert_true(id < 1) AS string) AS v"))
    assert read() == want
    assert not t.compact() and t.compact(force=True) and read() == want and len(t.segments(t.version_before())) == 1
    t.vacuum(2)
    assert len([p for p in (tmp_path / "t").iterdir() if p.name.startswith("segment-")]) == 1 and read() == want
    t.replace(t.read().filter("k < 5"))
    assert [k for k, _ in read()] == [0, 1, 3, 4]


def test_payload_lookup_prunes_files(spark, tmp_path):
    table = W.payload_table(spark, str(tmp_path / "p"), "content_hash string, body string", 64)
    table.upsert(spark.range(2000).select(F.sha2(F.col("id").cast("string"), 256).alias("content_hash"), F.col("id").cast("string").alias("body")))
    wanted = spark.range(3).select(F.sha2(F.col("id").cast("string"), 256).alias("content_hash")).union(spark.createDataFrame([("no such",)], "content_hash string"))
    df = table.lookup(wanted)
    assert sorted(r.body for r in df.collect()) == ["0", "1", "2"]
    folder = table.segments(table.version_before())[0]["folder"]
    files = len(list((tmp_path / "p" / folder).glob("_bucket=*/*.parquet")))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert files >= 60 and "PartitionFilters: [" in plan and "_bucket" in plan.split("PartitionFilters: [")[1].split("]")[0]
    read = table.merged(table.segments(table.version_before()), lambda d: d.filter(F.col("_bucket").isin([r[0] for r in wanted.select(table.bucket()).distinct().collect()])))
    assert len({r[0] for r in read.select(F.input_file_name()).collect()}) <= 4


@pytest.mark.parametrize("relative", [False, True])
def test_topic_folders(spark, tmp_path, monkeypatch, relative):
    """A file's topic is its folder under the root, wherever the root's name recurs, and with characters of patterns."""
    monkeypatch.chdir(tmp_path)
    names = ["history-vault/t", "va ult+1/vault", "vault", "a.b/vaultx/c"]
    root = tmp_path / "vault" / "my.vault" / "vault"
    for name in names:
        (root / name).mkdir(parents=True)
        (root / name / "topic.json").write_text(json.dumps({"id": "x"}))
    (root / "topic.json").write_text(json.dumps({"id": "x"}))
    found = R.read_topics(spark, f"file://{root}" if relative else str(root))
    assert sorted(r.path for r in found.collect()) == sorted([*names, ""])


def test_overwrite_is_whole(spark, tmp_path):
    """A job that fails leaves the table as it was; a table may be replaced by what is read from it."""
    path = str(tmp_path / "t")
    W.overwrite(spark.range(5), path)
    with pytest.raises(Exception):
        W.overwrite(spark.range(5).selectExpr("assert_true(id < 3), id"), path)
    assert spark.read.parquet(path).count() == 5
    W.overwrite(spark.read.parquet(path).filter("id > 1"), path)
    assert sorted(r.id for r in spark.read.parquet(path).collect()) == [2, 3, 4]
    assert [p.name for p in tmp_path.iterdir()] == ["t"]


def test_more_scans(spark, tmp_path):
    """Facts, scores and logs, with blank lines, empty lists and topics without a file."""
    for topic, facts, scores in (("a/b", [{"id": "FCT-001", "text": "x", "source_id": "SRC-001", "confidence": 0.5, "categories": ["history"], "flags": ["f"]}, {"id": "FCT-002", "text": "y", "source_id": "SRC-002", "confidence": 1, "categories": []}], [{"fact_id": "FCT-001", "promotion_score": 81.5, "promoted": True}]), ("c", [], [])):
        (tmp_path / "v" / topic).mkdir(parents=True)
        (tmp_path / "v" / topic / "extract.json").write_text(json.dumps({"facts": facts}, indent=1))
        (tmp_path / "v" / topic / "score.json").write_text(json.dumps({"scores": scores}, indent=1))
    (tmp_path / "v" / "none").mkdir()
    root = str(tmp_path / "v")
    assert [(r.topic, r.pos, r.fact_id, r.confidence, r.flags) for r in R.read_facts(spark, root).orderBy("pos").collect()] == [("a/b", 0, "FCT-001", 0.5, ["f"]), ("a/b", 1, "FCT-002", 1.0, None)]
    assert [(r.topic, r.fact_id, r.promotion_score, r.promoted, r.novelty) for r in R.read_scores(spark, root).collect()] == [("a/b", "FCT-001", 81.5, True, None)]
    (tmp_path / "log.jsonl").write_text('{"topic":"a","ms":3,"outcome":"success"}\n\n   \n{"topic":"b","outcome":"failure","extra":1}\n')
    assert sorted((r.topic, r.ms, r.outcome) for r in R.read_log(spark, str(tmp_path / "log.jsonl")).collect()) == [("a", 3, "success"), ("b", None, "failure")]
