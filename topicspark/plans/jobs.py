"""End-to-end jobs as compositions of operators. None writes: each returns its frames (the sinks are separate calls)."""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topicspark.functions import text as T
from topicspark.operators import facts as FA
from topicspark.operators import lineage as LI
from topicspark.operators import matching as MA
from topicspark.operators import ordered as OR
from topicspark.operators import quality as QU
from topicspark.operators import routing as RO
from topicspark.operators import stats as ST
from topicspark.operators import tree as TR
from topicspark.operators import triage as TI
from topicspark.shared import written


class Sync(NamedTuple):
    matches: DataFrame
    new: DataFrame
    skipped: DataFrame
    cursor: DataFrame


def sync_claims(facts: DataFrame, claims: DataFrame, cursor: DataFrame) -> Sync:
    """Matches of the facts that the cursor lacks; topics with colliding keys are skipped whole and keep their cursor.

    Facts are keyed and meet the cursor once: a table in the shared folder holds each (topic, fact_key) of either with the
    number of its facts, one of them, and whether the cursor has it; all four frames read it. A topic that isn't skipped
    has one fact a key. Keys move and lie there as the 32 bytes that they are; a cursor's other keys stay texts.
    """
    at = ["topic", "fact_key"]
    columns = [c for c in facts.columns if c not in at]
    told = lambda k: F.lower(F.hex(k))
    keyed = facts.select("topic", F.unhex(T.fact_key(F.col("source_id"), F.col("text"))).alias("_k"), F.struct(*columns).alias("_fact"), F.lit(False).alias("_known"))
    known = cursor.select("topic", F.when(told(F.unhex("fact_key")) == F.col("fact_key"), F.unhex("fact_key")).alias("_k"), "fact_key")
    known = known.select("topic", "_k", F.when(F.col("_k").isNull(), F.col("fact_key")).alias("_other"), F.lit(True).alias("_known"))
    both = keyed.unionByName(known, allowMissingColumns=True).groupBy("topic", "_k", "_other")
    keys = written(both.agg(F.count("_fact").alias("_n"), F.any_value("_fact", True).alias("_fact"), F.bool_or("_known").alias("_known")), "keys")
    keys = keys.select("topic", F.coalesce(told(F.col("_k")), "_other").alias("fact_key"), "_n", "_fact", "_known")
    skipped = written(keys.filter("_n > 1").select("topic").distinct(), "skipped")
    without = lambda rows, topics, how="left_anti": rows.alias("_l").join(topics.alias("_r"), F.col("_l.topic").eqNullSafe(F.col("_r.topic")), how)
    new = without(keys.filter("_n > 0 AND (NOT _known OR fact_key IS NULL)"), skipped).select("topic", *[F.col(f"_fact.`{c}`") for c in columns], "fact_key").select(*facts.columns, "fact_key")
    matches = MA.match_claims(new, claims, ["topic", "source_id", "fact_key"])
    gone = without(keys.filter("_n = 0"), skipped)  # known keys without a fact stay where the topic has no facts at all
    kept = [without(keys.filter("_n > 0"), skipped), without(keys.filter("_known"), skipped, "left_semi"), without(gone, keys.filter("_n > 0").select("topic").distinct())]
    return Sync(matches, new, skipped.withColumn("reason", F.lit("fact keys collide")), reduce(DataFrame.unionByName, [df.select(*at) for df in kept]))


class Rollup(NamedTuple):
    scores: DataFrame
    paths: DataFrame


def score_rollup(scores: DataFrame, nodes: DataFrame) -> Rollup:
    """E5: scores of all descendants of each node (without its own), tagged with their path, and the contributing paths."""
    below = TR.closure(nodes, with_self=False)
    rows = below.join(scores.withColumnRenamed("topic", "descendant"), "descendant")
    return Rollup(rows, rows.groupBy("ancestor").agg(F.sort_array(F.collect_set("descendant")).alias("paths")))


class Routed(NamedTuple):
    staged: DataFrame
    counts: DataFrame
    missing: DataFrame


def route(manifest: DataFrame, routing: DataFrame, topics: DataFrame, existing: DataFrame | None = None) -> Routed:
    """Where each physical path of the done entries would go, counts by topic, and topics that have no node.

    staged: (topic, path, hash, name, clash, status). existing: the paths (path) that are still there; a routed file that isn't is
    `missing` and takes no name, the others are `staged`.
    """
    paths = TI.physical_paths(manifest.filter("status = 'done'"))
    routed = RO.classified(paths, routing)
    files = routed.filter("topic IS NOT NULL").select("topic", "path", "hash")
    there = files if existing is None else files.join(existing.select("path"), "path", "left_semi")
    staged = RO.staged_names(there.select("topic", "path", "hash")).withColumn("status", F.lit("staged"))
    if existing is not None:
        gone = files.join(existing.select("path"), "path", "left_anti").select("topic", "path", "hash", F.lit("missing").alias("status"))
        staged = staged.unionByName(gone, allowMissingColumns=True)
    return Routed(staged, RO.routing_counts(routed), RO.missing_topics(routed, topics))


def extract(sources: DataFrame, envelopes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Numbered line facts and a joined summary of each topic, from text and video envelopes (with text)."""
    inputs = FA.extract_inputs(sources, envelopes.select("topic", "source_id", "kind", "text"))
    return FA.numbered(FA.line_facts(inputs)), FA.joined_summaries(inputs)


def logged(existing: DataFrame, new: DataFrame, order: str) -> DataFrame:
    """The chains of `existing` operations (topic, seq, op, payload) followed by new ones (topic, op, payload), hashed."""
    last = existing.groupBy("topic").agg(F.max("seq").alias("_last"))
    more = OR.numbered(new, ["topic"], [order], "_n").join(last, "topic", "left").withColumn("seq", (F.col("_n") + F.coalesce("_last", F.lit(0))).cast("int"))
    columns = ["topic", "seq", "op", "payload"]
    return LI.built(existing.select(columns).unionByName(more.select(columns)))


def create_topics(leaves: DataFrame, existing: DataFrame, actor: str) -> tuple[DataFrame, DataFrame]:
    """The nodes that the paths (path, tags) need and that don't exist, and a CREATE operation for each."""
    nodes = TR.expanded(leaves).join(existing.select("path"), "path", "left_anti")
    nodes = nodes.withColumns({"status": F.lit("container"), "version": F.lit("0.1.0"), "actors": F.array(F.lit(actor))})
    return nodes, nodes.select(F.col("path").alias("topic"), F.lit("CREATE").alias("op"), T.canonical_json(topic=F.col("path")).alias("payload"))


def register_sources(new: DataFrame, existing: DataFrame) -> tuple[DataFrame, DataFrame]:
    """New sources (topic, title, origin, text, added_at) numbered after the topic's existing ones, and INGEST operations."""
    have = existing.groupBy("topic").agg(F.count("*").alias("_have"))
    df = OR.numbered(new, ["topic"], ["added_at", "title"], "_n").join(have, "topic", "left")
    df = df.withColumn("source_id", F.format_string("SRC-%03d", F.col("_n") + F.coalesce("_have", F.lit(0)))).drop("_have", "_n")
    return df, df.select("topic", F.lit("INGEST").alias("op"), T.canonical_json(source_id=F.col("source_id")).alias("payload"))


class Ingested(NamedTuple):
    facts: DataFrame
    manifest: DataFrame
    summary: DataFrame


def ingest_batch(files: DataFrame, manifest: DataFrame, force: bool = False) -> Ingested:
    """Text files (topic, path, text, error) not yet done, once a content hash: their facts, manifest rows and summary."""
    df = files.withColumn("hash", T.content_hash(F.coalesce("text", F.col("path"))))
    df = OR.numbered(TI.to_ingest(df, manifest, force), ["topic", "hash"], [T.basename(F.col("path")), "path"], "_n")
    df = df.withColumn("outcome", F.when(F.col("_n") > 1, "duplicate").when(F.col("error").isNotNull(), "failed").otherwise("processed"))
    good = df.filter("outcome = 'processed'").select("topic", F.col("path").alias("source_id"), F.col("path").alias("title"), "text")
    rows = df.filter("outcome <> 'duplicate'").select("topic", "hash", F.col("path").alias("source_path"), F.when(F.col("outcome") == "failed", "failed").otherwise("done").alias("status"), "error")
    return Ingested(FA.numbered(FA.line_facts(good)), rows, TI.ingest_summary(df))


def crosslink(edges: DataFrame, topics: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges with their strength (a given one wins), and CROSSLINK operations."""
    df = MA.tag_overlap(edges, topics)
    return df, df.select("topic", F.lit("CROSSLINK").alias("op"), T.canonical_json(related_topic=F.col("related_topic")).alias("payload"))


def bump_versions(topics: DataFrame, part: str) -> tuple[DataFrame, DataFrame]:
    """Topics with the next version, and VERSION operations."""
    df = topics.withColumn("version", T.version_bump(F.col("version"), part))
    return df, df.select(F.col("path").alias("topic"), F.lit("VERSION").alias("op"), T.canonical_json(version=F.col("version")).alias("payload"))


def validate(topics: DataFrame, facts: DataFrame, operations: DataFrame, heads: DataFrame, envelopes: DataFrame) -> DataFrame:
    """A report for each topic (path) from schema errors, broken chains and mock sources."""
    schema = QU.fact_errors(facts).select("topic", F.lit("schema_error").alias("type"))
    chains = LI.checked(operations, heads).filter("NOT valid").select("topic", F.lit("lineage_error").alias("type"))
    return QU.node_reports(topics.select(F.col("path").alias("topic")), QU.all_issues(schema, chains), QU.mock_warnings(envelopes))


def feedback(nodes: DataFrame, facts: DataFrame, sources: DataFrame, timing: DataFrame) -> DataFrame:
    """Each node's subtree in one flat row: facts by confidence, bytes and density, calls and failures (quality_records has all)."""
    per = FA.confidence_histogram(facts, "topic").join(FA.fact_density(sources, facts), "topic", "left")
    per = per.join(timing.groupBy("topic").agg(F.count("*").alias("calls"), F.count_if(F.col("outcome") == "failure").alias("failures")), "topic", "full")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    df = TR.rollup(nodes, per.withColumnRenamed("topic", "path").drop("density"), *[total(c) for c in ("high", "medium", "low", "facts", "bytes", "calls", "failures")])
    df = df.withColumn("density", F.when(F.col("bytes") > 0, F.col("facts") / (F.col("bytes") / F.lit(1024.0))).otherwise(0.0))
    return df.withColumn("failure_rate", F.when(F.col("calls") > 0, F.col("failures") / F.col("calls")).otherwise(0.0))


def latency_record(timing: DataFrame, nodes: DataFrame, budget_ms: int = 90_000) -> DataFrame:
    """Percentiles over each node's subtree, exactly: topics' histograms of calls go up the tree and are added there, so that
    no call is copied to its ancestors and no node's calls meet in a task."""
    below = TR.closure(nodes).join(ST.latency_histogram(timing).withColumnRenamed("topic", "descendant"), "descendant")
    return ST.histogram_latencies(below.groupBy(F.col("ancestor").alias("topic"), "ms").agg(F.sum("n").alias("n")), budget_ms)


def quality_records(nodes: DataFrame, facts: DataFrame, sources: DataFrame, scores: DataFrame, timing: DataFrame, issues: DataFrame, budget_ms: int = 90_000) -> DataFrame:
    """One nested row a node over its subtree, itself included: latency, extract, score, issues, completeness.

    Facts, scores (facts with `promoted`) and issues (topic, type) are counted by topic before they go up the tree. Nodes
    without any rows below them have zeros, an empty map of categories and only has_validate.
    """
    counts = FA.confidence_histogram(facts, "topic").join(FA.fact_density(sources, facts).drop("density"), "topic", "left")
    counts = counts.join(FA.promotion_counts(scores, "topic"), "topic", "full").join(ST.issue_counts(issues), "topic", "full")
    sums = [F.sum(c).alias(c) for c in counts.columns if c != "topic"]
    sums = TR.rollup(nodes, counts.withColumnRenamed("topic", "path"), *sums, (F.count("promoted") > 0).alias("has_score"))
    kinds = FA.category_histogram(facts, "topic").withColumnRenamed("topic", "descendant").join(TR.closure(nodes), "descendant")
    kinds = kinds.groupBy(F.col("ancestor").alias("path"), "category").agg(F.sum("n").alias("n"))
    kinds = kinds.groupBy("path").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("category", "n")))).alias("categories"))
    slow = latency_record(timing, nodes, budget_ms).withColumnRenamed("topic", "path")
    df = nodes.select("path").join(sums, "path", "left").join(kinds, "path", "left").join(slow, "path", "left")
    n = lambda *names: [F.coalesce(c, F.lit(0)).alias(c) for c in names]
    flag = lambda c, name: F.coalesce(c, F.lit(False)).alias(name)
    density = F.when(F.col("bytes") > 0, F.col("facts") / (F.col("bytes") / F.lit(1024.0))).otherwise(0.0)
    categories = F.coalesce("categories", F.create_map().cast("map<string,bigint>"))
    return df.select(
        "path",
        F.struct(*n("p50", "p90", "p99"), F.coalesce("failure_rate", F.lit(0.0)).alias("failure_rate"), F.lit(budget_ms).alias("budget_ms"), flag(F.col("over_budget"), "over_budget")).alias("latency"),
        F.struct(*n("facts", "high", "medium", "low"), categories.alias("categories"), density.alias("density")).alias("extract"),
        F.struct(*n("promoted", "rejected")).alias("score"),
        F.struct(*n(*ST.ISSUES)).alias("issues"),
        F.struct(F.col("calls").isNotNull().alias("has_timing"), flag(F.col("facts") > 0, "has_extract"), flag(F.col("has_score"), "has_score"), F.lit(True).alias("has_validate")).alias("completeness"),
    )


def triage(files: DataFrame, prior: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, manifest, summary) of an intake dump."""
    rows = TI.triaged(files, prior)
    return rows, TI.intake_manifest(files), TI.triage_summary(rows)


def report(sources: DataFrame, facts: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(bundles, category groups, evidence register); facts are cited by citations()."""
    return FA.bundles(sources, facts), FA.by_first_category(facts), FA.evidence_register(sources)


def paged_report(sources: DataFrame, facts: DataFrame) -> tuple[tuple[DataFrame, DataFrame, DataFrame], DataFrame, DataFrame]:
    """E13 for topics of any size: (bundle pages, category groups, evidence register)."""
    return FA.bundle_pages(sources, facts), FA.by_first_category(facts), FA.evidence_register(sources)
