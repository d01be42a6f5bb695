"""All queries over the given tables, and the DuckDB SQL that must give the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from topicspark.functions import text as T
from topicspark.operators import facts as FA
from topicspark.operators import lineage as LI
from topicspark.operators import matching as MA
from topicspark.operators import quality as QU
from topicspark.operators import routing as RO
from topicspark.operators import shapes as SH
from topicspark.operators import stats as ST
from topicspark.operators import tree as TR
from topicspark.operators import triage as TI
from topicspark.plans import jobs as JO
from topicspark.plans import views as V
from topicspark.plans.views import sql_normal, sql_tokens, with_views
from topicspark.shared import new_folder, shared_folder, written
from topicspark.sources import trees as TT
from topicspark.sources import writers as W
from topicspark.sources.versioned import VersionedTable

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, *views: str):
    """Register a query under its function's name, with its oracle."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = with_views(sql, *views) if views else sql
        return f

    return add


def jac(a: str, b: str) -> str:
    return f"CASE WHEN len({a}) = 0 OR len({b}) = 0 THEN 0.0::DOUBLE ELSE len(list_intersect({a}, {b}))::DOUBLE / len(list_distinct(list_concat({a}, {b}))) END"


MATCH_CTES = f"""f AS (SELECT doc_id, pos, categories, {sql_tokens("text")} AS words FROM v_sents),
u AS (SELECT DISTINCT words, categories FROM f),
e AS (SELECT DISTINCT words, categories, unnest(list_concat(list_transform(words, lambda x: 'w:' || x), list_transform(categories, lambda x: 'c:' || x))) AS w FROM u),
ce AS (SELECT DISTINCT id, unnest(list_concat(list_transform(list_concat(keywords, tokens), lambda x: 'w:' || x), list_transform(categories, lambda x: 'c:' || x))) AS w FROM v_claims),
p AS (SELECT DISTINCT e.words, e.categories, ce.id FROM e JOIN ce ON e.w = ce.w),
s AS (SELECT p.words, p.categories, p.id, floor((0.4::DOUBLE * ({jac("p.categories", "c.categories")}) + 0.3::DOUBLE * ({jac("p.words", "c.keywords")}) + 0.3::DOUBLE * ({jac("p.words", "c.tokens")})) * 1000.0::DOUBLE + 0.5::DOUBLE) / 1000.0::DOUBLE AS score FROM p JOIN v_claims c ON p.id = c.id),
r AS (SELECT *, row_number() OVER (PARTITION BY words, categories ORDER BY score DESC, id) AS rank FROM s WHERE score >= 0.1)"""
MATCH_SQL = f"""WITH {MATCH_CTES}
SELECT f.doc_id, f.pos, r.id, r.score, CASE WHEN score >= 0.6 THEN 'high' WHEN score >= 0.3 THEN 'medium' ELSE 'low' END AS bucket, CAST(rank AS INT) AS rank
FROM f JOIN r ON f.words = r.words AND f.categories = r.categories WHERE rank <= 3"""


@query(MATCH_SQL, "v_sents", "v_claims")
def e10_claim_matching(spark, d):
    """The three best claims of every sentence, by categories and words."""
    return MA.match_claims(V.sentences(spark, d), V.claims(spark, d), ["doc_id", "pos"])


KEYS_SQL = f"""SELECT doc_id, pos, {sql_normal("text")} AS normal, len({sql_tokens("text")}) AS n_tokens,
sha256(source_id || '|' || CASE WHEN {sql_normal("text")} = '' THEN text ELSE {sql_normal("text")} END) AS fact_key FROM v_sents"""


@query(KEYS_SQL, "v_sents")
def f1_fact_keys(spark, d):
    """normalised text, tokens and stable keys."""
    s = V.sentences(spark, d).withColumn("normal", T.normalise_fact(F.col("text")))
    n = F.col("normal")
    return s.select("doc_id", "pos", "normal", F.size(T.tokens_of(n)).cast("long").alias("n_tokens"), T.key_of(F.col("source_id"), n, F.col("text")).alias("fact_key"))


@query(
    """SELECT doc_id, trim(regexp_replace(translate(lower(path), '_-/\\', '    '), '\\s+', ' ', 'g')) AS normal, string_split(path, '/')[-1] AS base,
    lower(regexp_extract(string_split(path, '/')[-1], '^.+(\\.[^.]*)$', 1)) AS ext, string_split(path, '/')[2] AS batch,
    CASE WHEN ends_with(path, '.txt') OR ends_with(path, '.md') THEN 'text' WHEN ends_with(path, '.pdf') THEN 'extractable' WHEN ends_with(path, '.png') OR ends_with(path, '.HEIC') THEN 'image' ELSE 'unsupported' END AS class,
    starts_with(path, 'intake/src1/') AS in_scope FROM v_intake""",
    "v_intake",
)
def f6_intake_paths(spark, d):
    """Path text, names, classes and scope."""
    p = F.col("path")
    return V.intake(spark, d).select("doc_id", T.normalise_path(p).alias("normal"), T.basename(p).alias("base"), T.extension(p).alias("ext"), T.batch_of(p).alias("batch"), TI.file_class(p).alias("class"), RO.within(p, "intake/src1").alias("in_scope"))


@query(
    """, n AS (SELECT DISTINCT array_to_string(p[1:k], '/') AS path FROM (SELECT p, unnest(range(1, len(p) + 1)) AS k FROM (SELECT string_split(path, '/') AS p FROM v_leaves)))
    SELECT path, CASE WHEN len(string_split(path, '/')) > 1 THEN array_to_string(string_split(path, '/')[1:len(string_split(path, '/')) - 1], '/') END AS parent, string_split(path, '/')[-1] AS leaf,
    CASE len(string_split(path, '/')) WHEN 1 THEN 'project' WHEN 2 THEN 'topic' ELSE 'subtopic' END AS node_type,
    (SELECT count(*) FROM n c WHERE starts_with(c.path, n.path || '/') AND len(string_split(c.path, '/')) = len(string_split(n.path, '/')) + 1) AS n_children, replace(path, '/', '-') AS slug FROM n""",
    "v_leaves",
)
def g3_tree(spark, d):
    """The tree under the given leaves."""
    t = TR.expanded(V.leaves(spark, d))
    return t.select("path", "parent", T.leaf(F.col("path")).alias("leaf"), "node_type", F.size("children").cast("long").alias("n_children"), T.topic_slug(F.col("path")).alias("slug"))


@query("SELECT c_custkey, (c_custkey % 5) || '.' || (c_custkey % 7) || '.' || (c_custkey % 11 + 1) AS patch, (c_custkey % 5) || '.' || (c_custkey % 7 + 1) || '.0' AS minor, (c_custkey % 5 + 1) || '.0.0' AS major FROM customer")
def f9_versions(spark, d):
    """F9, E7."""
    v = F.concat_ws(".", *[(F.col("c_custkey") % m).cast("string") for m in (5, 7, 11)])
    return V.table(spark, d, "customer").select("c_custkey", *[T.version_bump(v, p).alias(p) for p in ("patch", "minor", "major")])


SCORED = """s AS (SELECT *, floor(confidence * 100.0::DOUBLE + 0.5::DOUBLE) AS relevance, CASE WHEN list_contains(categories, 'genealogy') THEN 80.0::DOUBLE ELSE 20.0::DOUBLE END AS genealogy,
 CASE WHEN list_contains(categories, 'history') THEN 80.0::DOUBLE ELSE 20.0::DOUBLE END AS historical FROM v_facts),
t AS (SELECT *, relevance * 0.3::DOUBLE + genealogy * 0.1::DOUBLE + historical * 0.2::DOUBLE + relevance * 0.3::DOUBLE + 50.0::DOUBLE * 0.1::DOUBLE AS raw FROM s)"""


@query(f", {SCORED} SELECT topic, source_id, pos, relevance, genealogy, historical, floor(raw * 10.0::DOUBLE + 0.5::DOUBLE) / 10.0::DOUBLE AS promotion_score, raw >= 80 AS promoted FROM t", "v_facts")
def f10_scores(spark, d):
    """Promotion scores of all facts."""
    return FA.scored_by(V.facts(spark, d)).select("topic", "source_id", "pos", "relevance", "genealogy", "historical", "promotion_score", "promoted")


@query(f", {SCORED} SELECT topic, count(*) FILTER (raw >= 80) AS promoted, count(*) FILTER (raw < 80) AS rejected FROM t GROUP BY topic", "v_facts")
def a3_promotions(spark, d):
    """A3."""
    return FA.promotion_counts(FA.scores(V.facts(spark, d)), "topic")


HTML = r"regexp_replace(html, '(?is)<script\b[^>]*>.*?</script>', ' ', 'g')"
HTML = f"regexp_replace({HTML}, '<[^>]*>', ' ', 'g')"
for _name, _char in T.ENTITIES:
    HTML = f"replace({HTML}, '{_name}', '{_char.replace(chr(39), chr(39) * 2)}')"
HTML = rf"regexp_replace(regexp_replace({HTML}, '[ \t]+', ' ', 'g'), '[ \t]*\n[ \t]*', chr(10), 'g')"
HTML = rf"regexp_replace(regexp_replace({HTML}, '\n{{3,}}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g')"


@query(f"SELECT page_id, {HTML} AS text FROM pages")
def f13_html_text(spark, d):
    """the text of every page."""
    return V.table(spark, d, "pages").select("page_id", T.html_text(F.col("html")).alias("text"))


@query(
    r"""SELECT conv_id, turn, replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#39;') AS html,
    regexp_replace(text, '([|`])', '\\\1', 'g') AS inline, array_to_string(list_transform(string_split(text, chr(10)), lambda x: '    ' || x), chr(10)) AS block FROM conversations"""
)
def f15_escapes(spark, d):
    """F15, F16."""
    t = F.col("text")
    return V.table(spark, d, "conversations").select("conv_id", "turn", T.escape_html(t).alias("html"), T.escape_inline(t).alias("inline"), T.indent_block(t).alias("block"))


@query(
    """SELECT event_id, CAST(ms AS BIGINT) AS ms, lpad(CAST(ms // 60000 AS VARCHAR), CAST(greatest(2, len(CAST(ms // 60000 AS VARCHAR))) AS INT), '0') || ':' || lpad(CAST(ms // 1000 % 60 AS VARCHAR), 2, '0') AS clock,
    list_transform(range(event_id % 4), lambda k: CASE WHEN ms < 10000 THEN ms / 2.0::DOUBLE WHEN ms < 300000 THEN k * 10000.0::DOUBLE ELSE k * (ms / 30.0::DOUBLE) END) AS frames,
    CASE WHEN event_type = 'error' THEN 'no-audio' WHEN event_type = 'view' THEN 'empty' ELSE 'transcribed' END AS transcript FROM (SELECT *, CAST(floor(abs(value) * 5000) AS BIGINT) AS ms FROM events)"""
)
def f17_video_times(spark, d):
    """clocks, frame times and transcript status of clips as long as the events' values say."""
    e = V.table(spark, d, "events").withColumn("ms", F.floor(F.abs("value") * 5000).cast("long"))
    said = F.when(F.col("event_type") == "view", "  ").otherwise(F.col("event_type"))
    frames = F.transform(T.frame_times(F.col("ms"), F.col("event_id") % 4), lambda x: x.cast("double"))
    return e.select("event_id", "ms", T.clock(F.col("ms")).alias("clock"), frames.alias("frames"), T.transcript_status(F.col("event_type") != "error", said).alias("transcript"))


@query(
    """SELECT conv_id, string_agg('[frame @ ' || lpad(CAST(turn * 7 // 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(turn * 7 % 60 AS VARCHAR), 2, '0') || '] labels: ' || role, chr(10) ORDER BY turn, role) AS text FROM conversations GROUP BY conv_id"""
)
def f19_frame_lines(spark, d):
    """one text from a clip's labelled frames in time order."""
    c = V.table(spark, d, "conversations")
    return FA.frame_texts(c.select("conv_id", (F.col("turn") * 7000).alias("ms"), F.col("role").alias("labels")), "conv_id")


@query(
    """SELECT p_partkey, CASE WHEN w > 0 AND h * 1.0::DOUBLE / w >= 1.3 THEN 'text-doc' ELSE 'photo' END AS kind, CASE WHEN w > 0 AND h IS NOT NULL THEN NULL ELSE 0.0::DOUBLE END AS confidence,
    CASE WHEN NOT (w > 0) THEN 'unsure' WHEN h * 1.0::DOUBLE / w >= 1.3 THEN 'doc-photo' ELSE 'exhibit-photo' END AS type FROM (SELECT p_partkey, p_partkey % 50 AS w, p_size AS h FROM part)"""
)
def f22_image_geometry(spark, d):
    """kinds of images of given sizes."""
    p = V.table(spark, d, "part").withColumn("k", TI.geometry_kind(F.col("p_partkey") % 50, F.col("p_size")))
    return p.select("p_partkey", "k.kind", "k.confidence", TI.classified_type(F.col("k.kind"), F.lit("aspect-ratio"), F.coalesce("k.confidence", F.lit(1.0))).alias("type"))


@query(
    """WITH l AS (SELECT doc_id, w, (len(w) % 10) / 10.0::DOUBLE AS score FROM (SELECT doc_id, unnest(string_split(text, ' ')) AS w FROM documents)),
    b AS (SELECT doc_id, coalesce(max(score) FILTER (regexp_matches(w, '(?i)(^|[^A-Za-z0-9_])(document|text|paper|letter|receipt|book|newspaper|page|handwriting)s?($|[^A-Za-z0-9_])')), 0.0::DOUBLE) AS best FROM l GROUP BY doc_id)
    SELECT doc_id, CASE WHEN best >= 0.5 THEN 'text-doc' ELSE 'photo' END AS kind, CASE WHEN best >= 0.5 THEN best ELSE 1 - best END AS confidence FROM b"""
)
def f23_label_kinds(spark, d):
    """kinds of images by their labels (here: a document's words are an image's labels)."""
    w = V.table(spark, d, "documents").select(F.col("doc_id").alias("image"), F.explode(F.split("text", " ", -1)).alias("description"))
    return TI.label_kinds(w.withColumn("score", (F.length("description") % 10) / F.lit(10.0))).withColumnRenamed("image", "doc_id")


@query(
    """, l AS (SELECT doc_id, w, (len(w) % 10) / 10.0::DOUBLE AS score FROM (SELECT doc_id, unnest(string_split(text, ' ')) AS w FROM documents)),
    b AS (SELECT doc_id, coalesce(max(score) FILTER (regexp_matches(w, '(?i)(^|[^A-Za-z0-9_])(der|die|the|la)s?($|[^A-Za-z0-9_])')), 0.0::DOUBLE) AS best FROM l GROUP BY doc_id)
    SELECT doc_id, best FROM b""".replace(", l AS", "WITH l AS", 1)
)
def f23_best_labels(spark, d):
    """The best score of a text's words that match some whole words."""
    w = V.table(spark, d, "documents").select("doc_id", F.explode(F.split("text", " ", -1)).alias("w"))
    hit = F.col("w").rlike("(?i)(?<![A-Za-z0-9_])(der|die|the|la)s?(?![A-Za-z0-9_])")
    return w.groupBy("doc_id").agg(F.coalesce(F.max(F.when(hit, (F.length("w") % 10) / F.lit(10.0))), F.lit(0.0)).alias("best"))


@query("SELECT topic, source_id, pos, text, 'FCT-' || lpad(CAST(n AS VARCHAR), CAST(greatest(3, len(CAST(n AS VARCHAR))) AS INT), '0') AS fact_id FROM (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY source_id, pos) AS n FROM v_facts)", "v_facts")
def g1_line_facts(spark, d):
    """Line facts numbered through each topic."""
    return FA.numbered(V.facts(spark, d)).select("topic", "source_id", "pos", "text", "fact_id")


def responses(spark, d):
    """A response for each document with its whole text, one fact a line; some are fenced, cut, failed or invalid."""
    docs = V.table(spark, d, "documents")
    category = F.when(F.col("doc_id") % 9 == 0, "unknown").otherwise("history")
    each = F.transform(F.split("text", "\n", -1), lambda x: F.struct(x.alias("text"), (F.col("doc_id") % 120 / F.lit(100.0)).alias("confidence"), F.array(category).alias("categories")))
    inner = F.to_json(F.struct(each.alias("facts"), F.lit("s").alias("summary")))
    k = F.col("doc_id") % 5
    result = F.when(k == 1, F.concat(F.lit("```json\n"), inner, F.lit("\n```"))).when(k == 2, F.concat(F.lit("Here:\n```json\n"), inner, F.lit("\n```\nDone"))).when(k == 4, F.substring(inner, 1, 25)).otherwise(inner)
    return docs.select("doc_id", F.to_json(F.struct((k == 3).alias("is_error"), result.alias("result"))).alias("response"))


@query(
    """SELECT doc_id, e AS error, CAST(CASE WHEN e IS NULL THEN len(string_split(text, chr(10))) ELSE 0 END AS BIGINT) AS n_facts, CASE WHEN e IS NULL THEN sha256(text) END AS facts_sha256 FROM (SELECT doc_id, text, CASE WHEN doc_id % 5 = 3 THEN 'model reported an error' WHEN doc_id % 5 = 4 THEN 'result is not JSON'
    WHEN len(list_filter(string_split(text, chr(10)), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g') = '')) > 0 OR doc_id % 120 > 100 OR doc_id % 9 = 0 THEN 'invalid fact' END AS e FROM documents)"""
)
def g2_responses(spark, d):
    """Parsing of model responses, with the error of each bad one and all texts of the good ones."""
    p = FA.parsed_responses(responses(spark, d))
    texts = F.array_join(F.transform("facts", lambda f: f["text"]), "\n")
    return p.select("doc_id", "error", F.greatest(F.coalesce(F.size("facts"), F.lit(0)), F.lit(0)).cast("long").alias("n_facts"), F.when(F.col("error").isNull(), F.sha2(texts, 256)).alias("facts_sha256"))


@query("SELECT topic, count(*) FILTER (confidence >= 0.8) AS high, count(*) FILTER (confidence >= 0.5 AND confidence < 0.8) AS medium, count(*) FILTER (confidence < 0.5) AS low FROM v_facts GROUP BY topic", "v_facts")
def a1_confidence(spark, d):
    """A1."""
    return FA.confidence_histogram(V.facts(spark, d), "topic")


@query("SELECT topic, category, count(*) AS n FROM (SELECT topic, unnest(categories) AS category FROM v_facts) GROUP BY ALL", "v_facts")
def a2_categories(spark, d):
    """A2."""
    return FA.category_histogram(V.facts(spark, d), "topic")


@query(
    """SELECT topic, CAST(coalesce(quantile_disc(ms, 0.5) FILTER (outcome = 'success'), 0) AS BIGINT) AS p50, CAST(coalesce(quantile_disc(ms, 0.9) FILTER (outcome = 'success'), 0) AS BIGINT) AS p90, CAST(coalesce(quantile_disc(ms, 0.99) FILTER (outcome = 'success'), 0) AS BIGINT) AS p99,
    count(*) AS calls, count(*) FILTER (outcome = 'failure') * 1.0::DOUBLE / count(*) AS failure_rate, coalesce(quantile_disc(ms, 0.9) FILTER (outcome = 'success'), 0) > 90000 AS over_budget FROM v_timing WHERE topic <> 'src0' GROUP BY topic""",
    "v_timing",
)
def a4_latency(spark, d):
    """Latencies of a set of topics."""
    t = V.timing(spark, d)
    return ST.latencies(ST.of_topics(t, t.select("topic").filter("topic <> 'src0'")))


@query(
    """SELECT f.topic, f.facts, coalesce(s.bytes, 0) AS bytes, CASE WHEN coalesce(s.bytes, 0) > 0 THEN f.facts / (s.bytes / 1024.0::DOUBLE) ELSE 0.0::DOUBLE END AS density
    FROM (SELECT topic, count(*) AS facts FROM v_facts GROUP BY topic) f LEFT JOIN (SELECT topic, CAST(sum(octet_length(encode(text))) AS BIGINT) AS bytes FROM v_sources WHERE kind <> 'image' GROUP BY topic) s ON f.topic = s.topic""",
    "v_sources",
    "v_facts",
)
def a6_density(spark, d):
    """A6."""
    return FA.fact_density(V.sources(spark, d), V.facts(spark, d))


@query(
    """SELECT topic, bool_or(k = 't') AS has_timing, bool_or(k = 'f') AS has_extract, bool_or(k = 's') AS has_score, true AS has_validate FROM (
    SELECT topic, 't' AS k FROM v_timing UNION ALL SELECT topic, 'f' FROM v_facts UNION ALL SELECT topic, 's' FROM v_facts WHERE confidence >= 0.99 UNION ALL SELECT topic, 'x' FROM v_sources) GROUP BY topic""",
    "v_sources", "v_facts", "v_timing",
)
def a8_completeness(spark, d):
    """Which parts each topic has."""
    f, t, s = V.facts(spark, d), V.timing(spark, d), V.sources(spark, d)
    topics = s.select("topic").union(t.select("topic")).distinct()
    return ST.completeness(topics, f, f.filter("confidence >= 0.99"), t)


ROUTED = """m AS (SELECT i.path, r.* FROM v_intake i JOIN v_routing r ON regexp_matches(trim(regexp_replace(translate(lower(i.path), '_-/', '   '), '\\s+', ' ', 'g')), '(^|[^a-z0-9_])' || translate(r.keyword, '/', ' ') || '($|[^a-z0-9_])')),
b AS (SELECT *, len(string_split(translate(keyword, '/', ' '), ' ')) AS words FROM m),
t AS (SELECT *, row_number() OVER (PARTITION BY path, topic ORDER BY words DESC, len(keyword) DESC, keyword_ord) AS r FROM b),
k AS (SELECT *, rank() OVER (PARTITION BY path ORDER BY words DESC, len(keyword) DESC) AS q FROM t WHERE r = 1),
g AS (SELECT path, count(*) AS n, any_value(topic) AS topic, any_value(keyword) AS keyword FROM k WHERE q = 1 GROUP BY path),
routed AS (SELECT i.doc_id, i.path, i.hash, CASE WHEN n = 1 THEN topic END AS topic, CASE WHEN n = 1 THEN keyword END AS keyword, coalesce(n > 1, false) AS ambiguous FROM v_intake i LEFT JOIN g ON i.path = g.path)"""


@query(f", {ROUTED} SELECT doc_id, topic, keyword, ambiguous FROM routed", "v_intake", "v_routing")
def j7_routing(spark, d):
    """The topic of every file by its path."""
    return RO.classified(V.intake(spark, d), V.routing(spark)).select("doc_id", "topic", "keyword", "ambiguous")


@query(
    f", {ROUTED} SELECT topic, CAST(sum(n) AS BIGINT) AS n, CAST(sum(a) AS BIGINT) AS n_ambiguous FROM (SELECT coalesce(topic, 'unsorted') AS topic, 1 AS n, CAST(ambiguous AS INT) AS a FROM routed UNION ALL SELECT 'unsorted', 0, 0) GROUP BY topic",
    "v_intake", "v_routing",
)
def a9_routing_counts(spark, d):
    """A9."""
    return RO.routing_counts(RO.classified(V.intake(spark, d), V.routing(spark)))


@query(f", {ROUTED} SELECT DISTINCT topic FROM routed WHERE topic IS NOT NULL AND topic NOT IN (SELECT source FROM documents) AND topic <> 'english'", "v_intake", "v_routing")
def j8_missing_topics(spark, d):
    """Matched topics without a node."""
    nodes = V.table(spark, d, "documents").select(F.col("source").alias("path")).distinct().union(spark.createDataFrame([("english",)], "path string"))
    return RO.missing_topics(RO.classified(V.intake(spark, d), V.routing(spark)), nodes)


@query(
    """WITH RECURSIVE h AS (SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN repeat('f', 64) ELSE sha256(text) END AS hash FROM documents),
    f AS (SELECT h.doc_id, 't' || h.doc_id % 4 AS topic, h.hash, 'doc' || h.doc_id % 10 AS stem, CASE WHEN h.doc_id % 3 = 0 THEN coalesce('-' || o.hash[1:8], '') ELSE '' END AS tail FROM h LEFT JOIN h o ON o.doc_id = h.doc_id - 20),
    p AS (SELECT topic, topic || '/' || lpad(CAST(doc_id AS VARCHAR), 9, '0') || '/' || stem || tail || '.txt' AS path, stem || tail || '.txt' AS base, stem || tail || '-' || hash[1:8] || '.txt' AS other, row_number() OVER (PARTITION BY topic ORDER BY doc_id) AS n FROM f),
    r AS (SELECT topic, n, path, base AS name, [base] AS used FROM p WHERE n = 1 UNION ALL
      SELECT p.topic, p.n, p.path, CASE WHEN list_contains(used, base) THEN other ELSE base END, list_append(used, CASE WHEN list_contains(used, base) THEN other ELSE base END) FROM r JOIN p ON p.topic = r.topic AND p.n = r.n + 1)
    SELECT topic, path, name, count(*) OVER (PARTITION BY topic, name) > 1 AS clash FROM r"""
)
def w9_staged_names(spark, d):
    """Staged names of files whose base names collide with each other and with suffixed names; some hashes are equal."""
    id_ = F.col("doc_id")
    h = V.table(spark, d, "documents").select("doc_id", F.when(id_ % 11 == 0, "f" * 64).otherwise(F.sha2("text", 256)).alias("hash"))
    other = h.select((id_ + 20).alias("doc_id"), F.concat(F.lit("-"), F.substring("hash", 1, 8)).alias("tail"))
    base = F.concat(F.lit("doc"), (id_ % 10).cast("string"), F.when(id_ % 3 == 0, F.coalesce("tail", F.lit(""))).otherwise(""), F.lit(".txt"))
    topic = F.concat(F.lit("t"), (id_ % 4).cast("string"))
    files = h.join(other, "doc_id", "left").select(topic.alias("topic"), F.concat_ws("/", topic, F.lpad(id_.cast("string"), 9, "0"), base).alias("path"), "hash")
    return RO.staged_names(files).select("topic", "path", "name", "clash")


TRIAGED = """o AS (SELECT *, row_number() OVER (PARTITION BY hash ORDER BY string_split(path, '/')[-1], path) AS k, doc_id % 7 AS e FROM v_intake),
pr AS (SELECT hash, bool_or(doc_id % 2 = 0) AS done FROM v_intake WHERE doc_id % 3 = 0 GROUP BY hash),
tr AS (SELECT o.*, CASE WHEN e < 3 THEN 'text' ELSE 'unsure' END AS type, CASE WHEN k > 1 THEN 'duplicate' WHEN coalesce(done, false) THEN 'skipped' WHEN e >= 5 THEN 'failed' ELSE 'processed' END AS outcome FROM o LEFT JOIN pr ON o.hash = pr.hash)"""


def triaged(spark, d):
    i = V.intake(spark, d)
    prior = i.filter("doc_id % 3 = 0").select("hash", F.when(F.col("doc_id") % 2 == 0, "done").otherwise("failed").alias("status"))
    return TI.triaged(i, prior)


@query(f", {TRIAGED} SELECT doc_id, k > 1 AS is_dup, type AS classified_type, outcome FROM tr", "v_intake")
def w5_triage(spark, d):
    """Duplicates, resumed files and outcomes of a dump."""
    return triaged(spark, d).select("doc_id", "is_dup", "classified_type", "outcome")


@query(
    f""", {TRIAGED} SELECT count(*) AS total, count(*) FILTER (outcome = 'processed') AS processed, count(*) FILTER (outcome = 'skipped') AS skipped, count(*) FILTER (outcome = 'duplicate') AS duplicate, count(*) FILTER (outcome = 'failed') AS failed,
    count(*) FILTER (type = 'text' AND outcome IN ('processed', 'duplicate')) AS type_text, 0::BIGINT AS type_doc_photo, 0::BIGINT AS type_exhibit_photo, count(*) FILTER (type = 'unsure' AND outcome IN ('processed', 'duplicate')) AS type_unsure FROM tr""",
    "v_intake",
)
def a10_triage_summary(spark, d):
    """A10."""
    return TI.triage_summary(triaged(spark, d))


@query(f", {TRIAGED} SELECT count(*) FILTER (outcome IN ('processed', 'failed')) AS total_processed, count(*) FILTER (outcome = 'processed') AS success, count(*) FILTER (outcome = 'failed') AS failure, count(*) FILTER (outcome = 'duplicate') AS duplicates FROM tr", "v_intake")
def a11_ingest_summary(spark, d):
    """A11, E3."""
    return TI.ingest_summary(triaged(spark, d))


@query(
    """, c AS (SELECT hash, arg_min(path, string_split(path, '/')[-1] || chr(1) || path) AS source_path, list(DISTINCT path) AS ps FROM v_intake GROUP BY hash)
    SELECT hash, source_path, list_sort(list_filter(ps, lambda p: p <> source_path)) AS dup_paths FROM c""",
    "v_intake",
)
def a13_manifest(spark, d):
    """One row a content hash with its duplicate paths."""
    return TI.intake_manifest(V.intake(spark, d))


@query("SELECT hash, path FROM v_intake", "v_intake")
def u4_physical_paths(spark, d):
    """U4."""
    return TI.physical_paths(TI.intake_manifest(V.intake(spark, d)))


KEYED = f"""k AS (SELECT topic, doc_id, pos, sha256(source_id || '|' || CASE WHEN {sql_normal("text")} = '' THEN text ELSE {sql_normal("text")} END) AS fact_key FROM v_sents),
cu AS (SELECT DISTINCT topic, fact_key FROM k WHERE doc_id % 3 <> 0 AND pos % 2 = 0)"""


def keyed(spark, d):
    s = V.sentences(spark, d)
    # texts and sources are never null here: a key that can't be null needs no filter that computes it once more
    k = s.select("topic", "doc_id", "pos", F.coalesce(T.fact_key(F.col("source_id"), F.col("text")), F.lit("")).alias("fact_key"))
    return k, k.filter("doc_id % 3 <> 0 AND pos % 2 = 0").select("topic", "fact_key").distinct()


@query(f", {KEYED} SELECT DISTINCT topic FROM (SELECT topic FROM k GROUP BY topic, fact_key HAVING count(*) > 1)", "v_sents")
def a14_collisions(spark, d):
    """A14."""
    return MA.collisions(keyed(spark, d)[0])


@query(f", {KEYED} SELECT topic, doc_id, pos, fact_key FROM k WHERE NOT EXISTS (SELECT 1 FROM cu WHERE cu.topic = k.topic AND cu.fact_key = k.fact_key)", "v_sents")
def j4_new_facts(spark, d):
    """J4."""
    return MA.new_facts(*keyed(spark, d)).select("topic", "doc_id", "pos", "fact_key")


@query(f", {KEYED} SELECT topic, count(*) AS n FROM k WHERE NOT EXISTS (SELECT 1 FROM cu WHERE cu.topic = k.topic AND cu.fact_key = k.fact_key) GROUP BY topic", "v_sents")
def a12_new_by_topic(spark, d):
    """A12."""
    return MA.new_facts(*keyed(spark, d)).groupBy("topic").agg(F.count("*").alias("n"))


@query(f", {KEYED} SELECT DISTINCT topic FROM ((SELECT topic, fact_key FROM k EXCEPT SELECT * FROM cu) UNION ALL (SELECT * FROM cu EXCEPT SELECT topic, fact_key FROM k))", "v_sents")
def u2_changed_topics(spark, d):
    """U2."""
    return MA.changed_topics(*keyed(spark, d))


@query(f", {KEYED} SELECT topic, pos, fact_key, CAST(row_number() OVER (PARTITION BY topic ORDER BY fact_key, pos) AS INT) AS report_no FROM k", "v_sents")
def w10_report_order(spark, d):
    """The order of facts in a report."""
    s = V.sentences(spark, d)
    return FA.report_order(s.select("topic", "source_id", "pos", T.fact_key(F.col("source_id"), F.col("text")).alias("fact_key"))).select("topic", "pos", "fact_key", "report_no")


@query(f", {KEYED} SELECT DISTINCT topic, fact_key FROM k", "v_sents")
def u5_next_cursor(spark, d):
    """U5."""
    return MA.next_cursor(*keyed(spark, d))


@query(
    """, g AS (SELECT topic, coalesce(categories[1], 'Uncategorized') AS category, count(*) AS n, min(source_id || chr(1) || lpad(CAST(pos AS VARCHAR), 9, '0')) AS seen FROM v_facts GROUP BY ALL)
    SELECT topic, category, n, CAST(row_number() OVER (PARTITION BY topic ORDER BY seen) AS INT) AS group_no FROM g""",
    "v_facts",
)
def a15_category_groups(spark, d):
    """Report groups."""
    return FA.by_first_category(V.facts(spark, d))


@query("SELECT topic, string_agg('Extracted ' || n || ' fact(s) from ' || title || '.', chr(10) || chr(10) ORDER BY source_id) AS summary FROM (SELECT topic, source_id, title, len(list_filter(string_split(text, chr(10)), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g') <> '')) AS n FROM v_sources WHERE kind = 'text') GROUP BY topic", "v_sources")
def a16_summaries(spark, d):
    """Summaries of sources in order."""
    return FA.joined_summaries(V.sources(spark, d).filter("kind = 'text'"))


CLOSED = """nodes AS (SELECT DISTINCT array_to_string(p[1:k], '/') AS path FROM (SELECT p, unnest(range(1, len(p) + 1)) AS k FROM (SELECT string_split(path, '/') AS p FROM v_leaves)))"""


@query(f", {CLOSED} SELECT n.path, count(*) AS customers, min(c_acctbal) AS least, max(c_acctbal) AS most FROM nodes n JOIN v_leaves l ON l.path = n.path OR starts_with(l.path, n.path || '/') GROUP BY n.path", "v_leaves")
def a18_rollup(spark, d):
    """Measures over every subtree, itself included."""
    leaves = V.leaves(spark, d)
    return TR.rollup(TR.expanded(leaves), leaves.select("path", "c_acctbal"), F.count("*").alias("customers"), F.min("c_acctbal").alias("least"), F.max("c_acctbal").alias("most"))


@query(f", {CLOSED} SELECT n.path, count(*) AS descendants FROM nodes n JOIN nodes m ON starts_with(m.path, n.path || '/') GROUP BY n.path", "v_leaves")
def j9_descendants(spark, d):
    """Descendants without the node itself."""
    return TR.closure(TR.expanded(V.leaves(spark, d)), with_self=False).groupBy(F.col("ancestor").alias("path")).agg(F.count("*").alias("descendants"))


@query(
    f""", {CLOSED},
    k AS (SELECT * FROM nodes WHERE NOT regexp_matches(path, '^[^/]*/[a-h][^/]*$')),
    ch AS (SELECT path AS parent, path || '/' || name AS child FROM (SELECT k.path, unnest(list_concat((SELECT coalesce(list(string_split(m.path, '/')[-1]), []) FROM nodes m WHERE starts_with(m.path, k.path || '/') AND len(string_split(m.path, '/')) = len(string_split(k.path, '/')) + 1
      AND NOT regexp_matches(m.path, '[37]$')), CASE WHEN k.path NOT LIKE '%/%' THEN ['nowhere', 'france/customer-3', 'france/customer-6'] ELSE [] END)) AS name FROM k)),
    w AS (SELECT parent AS ancestor, child AS descendant FROM ch WHERE child IN (SELECT path FROM k) UNION SELECT w.ancestor, ch.child FROM w JOIN ch ON ch.parent = w.descendant WHERE ch.child IN (SELECT path FROM k))
    SELECT ancestor, count(*) AS descendants, min(descendant) AS first, max(descendant) AS last FROM w GROUP BY ancestor""",
    "v_leaves",
)
def j9_listed_walk(spark, d):
    """What a walk through children reaches where some nodes are missing (nations from a to h), some aren't named (paths
    that end in 3 or 7), and regions name a child that isn't there and ones two levels below."""
    nodes = TR.expanded(V.leaves(spark, d)).filter(~F.col("path").rlike("^[^/]*/[a-h][^/]*$"))
    named = F.filter("children", lambda c: ~c.rlike("[37]$"))
    more = F.when(~F.col("path").contains("/"), F.array(F.lit("nowhere"), F.lit("france/customer-3"), F.lit("france/customer-6"))).otherwise(F.array().cast("array<string>"))
    pairs = TR.closure(nodes.select("path", F.concat(named, more).alias("children")), with_self=False)
    return pairs.groupBy("ancestor").agg(F.count("*").alias("descendants"), F.min("descendant").alias("first"), F.max("descendant").alias("last"))


@query("SELECT DISTINCT actor, true AS valid FROM v_leaves", "v_leaves")
def a19_actors(spark, d):
    """A19, V9."""
    return V.leaves(spark, d).select("actor").distinct().withColumn("valid", QU.valid_actor(F.col("actor")))


@query(f", {CLOSED} SELECT path, CASE WHEN c_custkey IS NULL THEN 'container' ELSE 'active' END AS status, CASE WHEN c_custkey IS NULL THEN ['ACTOR-000'] ELSE list_distinct(['ACTOR-000', actor])[1:9] END AS actors FROM (SELECT n.path, l.c_custkey, l.actor FROM nodes n LEFT JOIN v_leaves l ON n.path = l.path)".replace("list_distinct(['ACTOR-000', actor])[1:9]", "CASE WHEN actor = 'ACTOR-000' THEN ['ACTOR-000'] ELSE ['ACTOR-000', actor] END"), "v_leaves")
def g4_activation(spark, d):
    """Nodes with an ingest become active."""
    leaves = V.leaves(spark, d)
    nodes = TR.expanded(leaves).select("path", F.lit("container").alias("status"), F.array(F.lit("ACTOR-000")).alias("actors"))
    return TR.activated(nodes, leaves.select("path", "actor"))


@query(
    """SELECT f.topic, f.source_id, f.pos, CASE WHEN s.doc_id IS NULL THEN '[Unknown Source]' ELSE s.title || ' (' || s.lang || ')' END AS citation FROM v_facts f LEFT JOIN (SELECT * FROM v_sources WHERE kind = 'text') s ON f.topic = s.topic AND f.source_id = s.source_id""",
    "v_sources", "v_facts",
)
def j1_citations(spark, d):
    """Facts with what they cite (image sources aren't registered here)."""
    s = V.sources(spark, d).filter("kind = 'text'").withColumn("origin", F.col("lang"))
    return FA.citations(V.facts(spark, d), s).select("topic", "source_id", "pos", "citation")


@query(
    """SELECT coalesce(f.topic, s.topic) AS topic, coalesce(fact_count, 0) AS fact_count, coalesce(source_count, 0) AS source_count, first_fact, first_source FROM (SELECT topic, count(*) AS fact_count, arg_min(text, source_id || chr(1) || lpad(CAST(pos AS VARCHAR), 9, '0')) AS first_fact FROM v_facts GROUP BY topic) f FULL JOIN (SELECT topic, count(*) AS source_count, arg_min(title, source_id) AS first_source FROM v_sources GROUP BY topic) s ON f.topic = s.topic""",
    "v_sources", "v_facts",
)
def p1_bundles(spark, d):
    """Report bundles."""
    b = FA.bundles(V.sources(spark, d), V.facts(spark, d))
    return b.select("topic", "fact_count", "source_count", F.col("facts")[0]["statement"].alias("first_fact"), F.col("sources")[0]["title"].alias("first_source"))


@query("SELECT topic, source_id, CAST(row_number() OVER (PARTITION BY topic ORDER BY source_id) AS INT) AS evidence_no FROM v_sources", "v_sources")
def w11_evidence(spark, d):
    """W11."""
    return FA.evidence_register(V.sources(spark, d)).select("topic", "source_id", "evidence_no")


@query("SELECT topic, source_id, title FROM v_sources WHERE kind <> 'image' AND doc_id % 4 <> 0", "v_sources")
def j2_extract_inputs(spark, d):
    """Sources with a text envelope."""
    s = V.sources(spark, d)
    return FA.extract_inputs(s.select("topic", "source_id", "title"), s.filter("doc_id % 4 <> 0").select("topic", "source_id", "kind")).select("topic", "source_id", "title")


MANIFEST = """ev AS (SELECT 'user-' || user_id AS topic, props AS hash, CASE WHEN event_type = 'error' THEN 'failed' ELSE 'done' END AS status, ts, event_id FROM events),
la AS (SELECT *, row_number() OVER (PARTITION BY topic, hash ORDER BY ts DESC, event_id DESC) AS n FROM ev)"""


def manifest_events(spark, d):
    e = V.table(spark, d, "events")
    return e.select(F.concat(F.lit("user-"), F.col("user_id").cast("string")).alias("topic"), F.col("props").alias("hash"), F.when(F.col("event_type") == "error", "failed").otherwise("done").alias("status"), "ts", "event_id")


@query(f"WITH {MANIFEST} SELECT topic, hash, status, event_id FROM la WHERE n = 1")
def w6_latest_entries(spark, d):
    """The manifest as the last event a key."""
    return TI.latest_entries(manifest_events(spark, d)).select("topic", "hash", "status", "event_id")


@query(f"WITH {MANIFEST}, p AS (SELECT props, count(*) AS n_views FROM events WHERE event_type = 'view' AND event_id % 3 = 0 GROUP BY props) SELECT topic, hash, event_id, n_views FROM la JOIN p ON la.hash = p.props WHERE n = 1 AND status = 'done'")
def j3_done_payloads(spark, d):
    """Done entries with their hash's payload, looked up in a payload table; those without one are skipped."""
    payloads = V.table(spark, d, "events").filter("event_type = 'view' AND event_id % 3 = 0").groupBy(F.col("props").alias("content_hash")).agg(F.count("*").alias("n_views"))
    table = W.payload_table(spark, f"{shared_folder(spark)}/payloads-{uuid.uuid4().hex}", "content_hash string, n_views bigint", 16)
    table.upsert(payloads)
    entries = TI.latest_entries(manifest_events(spark, d))
    found = table.lookup(entries.filter("status = 'done'").select(F.col("hash").alias("content_hash")))
    return TI.done_payloads(entries, found).select("topic", "hash", "event_id", "n_views")


@query(
    """WITH b AS (SELECT 'user-' || user_id AS topic, props AS hash, CASE WHEN event_type = 'error' THEN 'failed' ELSE 'done' END AS status, event_id, event_id % 3 AS batch FROM events),
    o AS (SELECT *, row_number() OVER (PARTITION BY batch, topic, hash ORDER BY event_id DESC) AS n, row_number() OVER (PARTITION BY topic, hash ORDER BY batch DESC, event_id DESC) AS last FROM b)
    SELECT topic, hash, status, event_id FROM o WHERE last = 1 AND NOT (batch = 2 AND event_id % 5 = 0)"""
)
def w6_upserted_batches(spark, d):
    """W6, K1, T-S3: a keyed table after three batches, each replayed; the third removes some of its keys."""
    e = manifest_events(spark, d).select("topic", "hash", "status", F.col("event_id").alias("id"))
    table = VersionedTable(spark, f"{shared_folder(spark)}/upserts-{uuid.uuid4().hex}", "topic string, hash string, status string, event_id bigint", ["topic", "hash"], 8)
    for k in range(3):
        batch = e.filter(F.col("id") % 3 == k).groupBy("topic", "hash").agg(F.max_by("status", "id").alias("status"), F.max("id").alias("event_id"))
        for _ in range(2):
            table.upsert(batch, k, F.lit(k == 2) & (F.col("event_id") % 5 == 0))
        table.compact()
        table.vacuum(k)
    return table.read()


@query(f"WITH {MANIFEST} SELECT topic, hash, event_id FROM la WHERE n = 1 AND status = 'failed'")
def j12_retries(spark, d):
    """What a retry run takes."""
    return TI.failed_entries(manifest_events(spark, d)).select("topic", "hash", "event_id")


@query(f"WITH {MANIFEST} SELECT e.topic, e.hash, count(*) AS n FROM ev e WHERE NOT EXISTS (SELECT 1 FROM la WHERE n = 1 AND la.status = 'done' AND la.topic = e.topic AND la.hash = e.hash) GROUP BY ALL")
def j5_to_ingest(spark, d):
    """What isn't done yet."""
    e = manifest_events(spark, d)
    return TI.to_ingest(e, TI.latest_entries(e)).groupBy("topic", "hash").agg(F.count("*").alias("n"))


@query(
    """SELECT a.c_custkey AS a, b.c_custkey AS b, len(list_intersect(a.tags, b.tags))::DOUBLE / len(list_distinct(list_concat(a.tags, b.tags))) AS strength FROM v_leaves a JOIN v_leaves b ON b.c_custkey = a.c_custkey + 1""",
    "v_leaves",
)
def j10_tag_overlap(spark, d):
    """Tag overlap of linked topics."""
    leaves = V.leaves(spark, d)
    nxt = leaves.select((F.col("c_custkey") - 1).alias("c_custkey"), F.col("path").alias("related_topic"))
    edges = leaves.join(nxt, "c_custkey").select(F.col("path").alias("topic"), "related_topic", F.col("c_custkey").alias("a"), (F.col("c_custkey") + 1).alias("b"))
    return MA.tag_overlap(edges, leaves).select("a", "b", "strength")


CHAIN = """WITH RECURSIVE o AS (SELECT 'user-' || user_id AS topic, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq, upper(event_type) AS op, '{"event_id":' || event_id || ',"event_type":"' || event_type || '"}' AS payload FROM events),
c AS (SELECT topic, seq, op, sha256('GENESIS' || payload) AS hash FROM o WHERE seq = 1 UNION ALL SELECT o.topic, o.seq, o.op, sha256(c.hash || o.payload) FROM c JOIN o ON o.topic = c.topic AND o.seq = c.seq + 1)"""


@query(f"{CHAIN} SELECT topic, CAST(seq AS INT) AS seq, op, hash FROM c")
def w8_hash_chain(spark, d):
    """A hash chain of every user's events."""
    return LI.built(V.operations(spark, d)).select("topic", "seq", "op", "hash")


@query("SELECT 'user-' || user_id AS topic, user_id % 5 <> 0 AS valid, CASE WHEN user_id % 5 = 0 THEN 'OP-' || lpad(CAST(least(3, count(*)) AS VARCHAR), 4, '0') END AS broken_at FROM events GROUP BY user_id")
def w7_chain_check(spark, d):
    """Chains of which every fifth has a changed operation."""
    ops = written(LI.built(V.operations(spark, d)), "chains")  # built once, read for heads and for the check
    last = Window.partitionBy("topic")
    ops = ops.withColumn("bad", (F.split("topic", "-")[1].cast("int") % 5 == 0) & (F.col("seq") == F.least(F.lit(3), F.max("seq").over(last))))
    heads = ops.groupBy("topic").agg(F.max_by("hash", "seq").alias("hash"))
    return LI.checked(ops.withColumn("payload", F.when(F.col("bad"), F.lit("{}")).otherwise(F.col("payload"))), heads)


@query(
    """SELECT topic, 'hand_edited' AS type FROM (SELECT 'user-' || user_id AS topic, arg_max(event_id, ts) FILTER (event_type = 'purchase') AS last, max(event_id) AS now, count(*) FILTER (event_type = 'purchase') AS n FROM events GROUP BY user_id) WHERE n = 0 OR last <> now"""
)
def v6_hand_edited(spark, d):
    """Content against the last recorded operation (purchases stand for scores)."""
    e = V.table(spark, d, "events").withColumn("topic", F.concat(F.lit("user-"), F.col("user_id").cast("string")))
    ops = e.select("topic", F.col("ts").alias("seq"), F.when(F.col("event_type") == "purchase", "SCORE").otherwise("OTHER").alias("op"), F.col("event_id").cast("string").alias("content_hash"))
    return LI.hand_edited(ops, e.groupBy("topic").agg(F.max("event_id").cast("string").alias("content_hash")))


@query(
    """SELECT doc_id, unnest(list_filter([CASE WHEN doc_id % 11 = 0 THEN 'fact_id: pattern' END, CASE WHEN pos % 13 = 5 THEN 'text: not empty' END, CASE WHEN confidence > 0.95 THEN 'confidence: 0 to 1' END, CASE WHEN lang = 'es' THEN 'categories: vocabulary' END], lambda x: x IS NOT NULL)) AS error, pos FROM v_facts""",
    "v_facts",
)
def v1_schema_errors(spark, d):
    """Every broken rule of facts (some are spoilt here)."""
    f = V.facts(spark, d)
    f = f.withColumns({"fact_id": F.when(F.col("doc_id") % 11 == 0, "F-1").otherwise("FCT-001"), "text": F.when(F.col("pos") % 13 == 5, "").otherwise(F.col("text")), "confidence": F.when(F.col("confidence") > 0.95, 1.5).otherwise(F.col("confidence")), "categories": F.when(F.col("lang") == "es", F.array(F.lit("other"))).otherwise(F.col("categories"))})
    return QU.fact_errors(f).select("doc_id", "pos", "error")


DICTIONARY = """k AS (SELECT CASE c_custkey % 6 WHEN 0 THEN 'a/b' || c_custkey % 4 WHEN 1 THEN 'a--b' || c_custkey % 4 WHEN 2 THEN 'Topic ' || c_custkey % 3 ELSE 't' || c_custkey % 40 END AS topic,
 CASE WHEN c_custkey % 7 = 0 THEN NULL WHEN c_custkey % 7 = 1 THEN ' ' || chr(9) WHEN c_custkey % 7 = 2 THEN NULL ELSE c_mktsegment || '_' || c_custkey % 90 END AS keyword, CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_custkey % 3 END AS keyword_ord FROM customer),
 n AS (SELECT *, trim(regexp_replace(translate(lower(keyword), '_-/', '   '), '\\s+', ' ', 'g')) AS needle FROM k)"""


@query(
    f"""WITH {DICTIONARY} SELECT topic, 'invalid topic name' AS error FROM n WHERE NOT regexp_matches(topic, '^[a-z0-9-]+$') UNION SELECT topic, 'no keywords' FROM n WHERE keyword_ord IS NULL
    UNION SELECT topic, 'blank keyword' FROM n WHERE keyword_ord IS NOT NULL AND coalesce(needle, '') = ''
    UNION SELECT topic, 'keyword of two topics: ' || needle FROM n WHERE needle IN (SELECT needle FROM n WHERE needle <> '' GROUP BY needle HAVING count(DISTINCT topic) > 1)"""
)
def v2_routing_errors(spark, d):
    """V2: a routing dictionary that breaks all four rules, checked."""
    k = F.col("c_custkey")
    text = lambda c: c.cast("string")
    topic = F.when(k % 6 == 0, F.concat(F.lit("a/b"), text(k % 4))).when(k % 6 == 1, F.concat(F.lit("a--b"), text(k % 4))).when(k % 6 == 2, F.concat(F.lit("Topic "), text(k % 3))).otherwise(F.concat(F.lit("t"), text(k % 40)))
    keyword = F.when(k % 7 == 1, F.lit(" \t")).when(k % 7 > 2, F.concat_ws("_", "c_mktsegment", text(k % 90)))
    return RO.routing_errors(V.table(spark, d, "customer").select(topic.alias("topic"), keyword.alias("keyword"), F.when(k % 7 > 0, k % 3).alias("keyword_ord")))


@query("SELECT id, error FROM (SELECT id, unnest(CASE WHEN len(claim) < 20 THEN ['claim: not empty'] ELSE [] END) AS error FROM v_claims UNION ALL SELECT id[1:5], 'id: not unique' FROM v_claims WHERE false)", "v_claims")
def v3_claim_errors(spark, d):
    """V3: claims checked (short ones are blanked here)."""
    c = V.claims(spark, d)
    return QU.claim_errors(c.withColumn("claim", F.when(F.length("claim") < 20, "").otherwise(F.col("claim"))))


@query("""SELECT event_id, CASE event_id % 4 WHEN 1 THEN 'version' WHEN 2 THEN 'keys' WHEN 3 THEN 'bad JSON or types' END AS reset_reason, CAST(CASE WHEN event_id % 4 = 0 THEN 1 ELSE 0 END AS BIGINT) AS n_keys FROM events""")
def v4_cursors(spark, d):
    """V4: cursors with the reason for a reset."""
    e = V.table(spark, d, "events")
    k = F.col("event_id") % 4
    body = F.when(k == 0, F.concat(F.lit('{"cursorVersion":1,"lastSyncedFactKeys":["'), F.col("event_type"), F.lit('"]}'))).when(k == 1, F.lit('{"cursorVersion":9,"lastSyncedFactKeys":[]}')).when(k == 2, F.lit('{"cursorVersion":1}')).otherwise(F.lit('{"cursorVersion":'))
    return QU.cursor_keys(e.select("event_id", F.col("user_id").cast("string").alias("topic"), body.alias("body"))).select("event_id", "reset_reason", F.size("keys").cast("long").alias("n_keys"))


@query(
    """SELECT topic, count(*) FILTER (confidence > 0.99) = 0 AS valid, list_sort(list(CASE WHEN confidence > 0.99 THEN 'schema_error' END) FILTER (confidence > 0.99)) AS errors, list_sort(list('mock_source') FILTER (pos = 20)) AS warnings FROM v_facts GROUP BY topic""".replace("list_sort(list(CASE", "coalesce(list_sort(list(CASE").replace("FILTER (confidence > 0.99)) AS errors", "FILTER (confidence > 0.99)), []) AS errors").replace("list_sort(list('mock", "coalesce(list_sort(list('mock").replace("(pos = 20))", "(pos = 20)), [])"),
    "v_facts",
)
def v8_node_reports(spark, d):
    """Reports of topics from error and warning rows."""
    f = V.facts(spark, d)
    envelopes = f.select("topic", "source_id", (F.col("pos") == 20).alias("mock"))
    errors = QU.all_issues(f.filter("confidence > 0.99").select("topic", F.lit("schema_error").alias("type")))
    return QU.node_reports(f.select("topic").distinct(), errors, QU.mock_warnings(envelopes))


@query("SELECT topic, count(*) FILTER (confidence > 0.9) AS schema_error, 0::BIGINT AS lineage_error, 0::BIGINT AS hand_edited, count(*) FILTER (confidence < 0.1) AS mock_source FROM v_facts WHERE confidence > 0.9 OR confidence < 0.1 GROUP BY topic", "v_facts")
def a7_issue_counts(spark, d):
    """Issue counts by kind, zero filled."""
    f = V.facts(spark, d).filter("confidence > 0.9 OR confidence < 0.1")
    return ST.issue_counts(f.select("topic", F.when(F.col("confidence") > 0.9, "schema_error").otherwise("mock_source").alias("type")))


QUALITY_SQL = f""", {SCORED},
p AS (SELECT lang || '/' || topic AS path FROM v_sources UNION SELECT 'en/' || topic FROM v_timing),
nodes AS (SELECT path FROM p WHERE path IS NOT NULL UNION SELECT string_split(path, '/')[1] FROM p WHERE path IS NOT NULL),
below AS (SELECT n.path AS node, m.path FROM nodes n JOIN nodes m ON m.path = n.path OR starts_with(m.path, n.path || '/')),
x AS (SELECT *, lang || '/' || topic AS path FROM t),
a AS (SELECT node, count(*) AS facts, count(*) FILTER (confidence >= 0.8) AS high, count(*) FILTER (confidence >= 0.5 AND confidence < 0.8) AS medium, count(*) FILTER (confidence < 0.5) AS low,
 count(*) FILTER (list_contains(categories, 'history')) AS history, count(*) FILTER (list_contains(categories, 'genealogy')) AS genealogy,
 count(*) FILTER (raw >= 80 AND lang <> 'de') AS promoted, count(*) FILTER (raw < 80 AND lang <> 'de') AS rejected,
 count(*) FILTER (confidence > 0.9) AS schema_error, count(*) FILTER (confidence < 0.1) AS mock_source FROM below JOIN x ON x.path = below.path GROUP BY node),
b AS (SELECT node, sum(octet_length(encode(text))) AS bytes FROM below JOIN v_sources v ON v.lang || '/' || v.topic = below.path WHERE kind <> 'image' AND below.path IN (SELECT path FROM x) GROUP BY node),
c AS (SELECT node, quantile_disc(ms, 0.5) FILTER (outcome = 'success') AS p50, quantile_disc(ms, 0.9) FILTER (outcome = 'success') AS p90, quantile_disc(ms, 0.99) FILTER (outcome = 'success') AS p99,
 count(*) AS calls, count(*) FILTER (outcome = 'failure') AS failures FROM below JOIN v_timing v ON 'en/' || v.topic = below.path GROUP BY node)
SELECT n.path, CAST(coalesce(p50, 0) AS BIGINT) AS p50, CAST(coalesce(p90, 0) AS BIGINT) AS p90, CAST(coalesce(p99, 0) AS BIGINT) AS p99, coalesce(failures * 1.0::DOUBLE / calls, 0.0::DOUBLE) AS failure_rate, coalesce(p90, 0) > 90000 AS over_budget,
 coalesce(facts, 0) AS facts, coalesce(high, 0) AS high, coalesce(medium, 0) AS medium, coalesce(low, 0) AS low, coalesce(history, 0) AS history, coalesce(genealogy, 0) AS genealogy,
 CASE WHEN bytes > 0 THEN facts / (bytes / 1024.0::DOUBLE) ELSE 0.0::DOUBLE END AS density, coalesce(promoted, 0) AS promoted, coalesce(rejected, 0) AS rejected,
 coalesce(schema_error, 0) AS schema_error, coalesce(mock_source, 0) AS mock_source, calls IS NOT NULL AS has_timing, coalesce(facts > 0, false) AS has_extract, coalesce(promoted + rejected > 0, false) AS has_score
FROM nodes n LEFT JOIN a ON a.node = n.path LEFT JOIN b ON b.node = n.path LEFT JOIN c ON c.node = n.path"""


@query(QUALITY_SQL, "v_sources", "v_facts", "v_timing")
def e9_quality_records(spark, d):
    """The whole quality record of each language and of each source below it; German facts have no scores."""
    below = F.concat("lang", F.lit("/"), "topic")
    f, s = (df.withColumn("topic", below) for df in (V.facts(spark, d), V.sources(spark, d)))
    timing = V.timing(spark, d).withColumn("topic", F.concat(F.lit("en/"), "topic"))
    issues = f.filter("confidence > 0.9 OR confidence < 0.1").select("topic", F.when(F.col("confidence") > 0.9, "schema_error").otherwise("mock_source").alias("type"))
    paths = s.select("topic").union(timing.select("topic")).distinct().filter("topic IS NOT NULL")
    nodes = TR.expanded(paths.select(F.col("topic").alias("path"), F.array().cast("array<string>").alias("tags")))
    r = JO.quality_records(nodes, f, s, FA.scores(f.filter("lang <> 'de'")), timing, issues)
    kind = lambda c: F.coalesce(F.try_element_at("extract.categories", F.lit(c)), F.lit(0)).alias(c)
    latency = [f"latency.{c}" for c in ("p50", "p90", "p99", "failure_rate", "over_budget")]
    extract = [f"extract.{c}" for c in ("facts", "high", "medium", "low", "density")]
    return r.select("path", *latency, *extract, kind("history"), kind("genealogy"), "score.*", "issues.schema_error", "issues.mock_source", *[f"completeness.{c}" for c in ("has_timing", "has_extract", "has_score")])


@query(
    f""", {CLOSED} SELECT path AS topic, CASE len(string_split(path, '/')) WHEN 1 THEN 'project' WHEN 2 THEN 'topic' ELSE 'subtopic' END AS node_type, 'container' AS status, '0.1.0' AS version,
    1 AS seq, 'CREATE' AS op, sha256('GENESIS' || '{{"topic":"' || path || '"}}') AS hash FROM nodes WHERE path NOT IN (SELECT path FROM v_leaves WHERE c_custkey % 3 = 0)""",
    "v_leaves",
)
def e1_created_topics(spark, d):
    """The nodes that the leaves' paths need beside the third of them that exists, each with its first logged operation."""
    leaves = V.leaves(spark, d)
    nodes, ops = JO.create_topics(leaves, leaves.filter("c_custkey % 3 = 0"), "ACTOR-001")
    log = JO.logged(ops.select("topic", F.lit(0).alias("seq"), "op", "payload").filter("false"), ops, "op")
    return nodes.select(F.col("path").alias("topic"), "node_type", "status", "version").join(log.select("topic", "seq", "op", "hash"), "topic")


@query(
    """WITH h AS (SELECT source, count(*) AS have FROM documents WHERE doc_id % 4 = 0 GROUP BY source),
    x AS (SELECT d.source AS topic, 'doc-' || doc_id AS title, CAST(row_number() OVER (PARTITION BY d.source ORDER BY doc_id) + coalesce(have, 0) AS VARCHAR) AS n FROM documents d LEFT JOIN h ON d.source = h.source WHERE doc_id % 4 <> 0),
    y AS (SELECT topic, title, 'SRC-' || lpad(n, CAST(greatest(3, len(n)) AS INT), '0') AS source_id FROM x)
    SELECT topic, title, source_id, NULL::VARCHAR AS op, NULL::VARCHAR AS payload FROM y UNION ALL SELECT topic, NULL, NULL, 'INGEST', '{"source_id":"' || source_id || '"}' FROM y"""
)
def e2_registered_sources(spark, d):
    """Three quarters of the documents numbered after the quarter that is registered, and their INGEST operations."""
    s = V.sources(spark, d)
    new = s.filter("doc_id % 4 <> 0").select("topic", "title", F.col("lang").alias("origin"), "text", F.format_string("%015d", "doc_id").alias("added_at"))
    rows, ops = JO.register_sources(new, s.filter("doc_id % 4 = 0"))
    return rows.select("topic", "title", "source_id").unionByName(ops, allowMissingColumns=True)


@query(
    f"""WITH f AS (SELECT source AS topic, doc_id, 'in/doc-' || doc_id || '.txt' AS path, text, sha256(coalesce(text, 'in/doc-' || doc_id || '.txt')) AS hash FROM documents),
    done AS (SELECT topic, hash FROM f WHERE doc_id % 6 = 0),
    k AS (SELECT *, row_number() OVER (PARTITION BY topic, hash ORDER BY path) AS n FROM f WHERE NOT EXISTS (SELECT 1 FROM done WHERE done.topic = f.topic AND done.hash = f.hash))
    SELECT topic, hash, path AS source_path, CASE WHEN doc_id % 10 = 9 THEN 'failed' ELSE 'done' END AS status, CASE WHEN doc_id % 10 = 9 THEN 'unsupported' END AS error,
    CASE WHEN doc_id % 10 = 9 THEN 0 ELSE coalesce(len(list_filter(string_split(text, chr(10)), lambda x: {V.TRIM.format("x")} <> '')), 0) END AS n_facts FROM k WHERE n = 1"""
)
def e3_ingested_batch(spark, d):
    """Files not yet done, once a content: their manifest rows with the number of facts of each."""
    path = F.concat(F.lit("in/"), F.col("title"), F.lit(".txt"))
    files = V.sources(spark, d).select("topic", path.alias("path"), "text", F.when(F.col("doc_id") % 10 == 9, "unsupported").alias("error"), "doc_id")
    done = files.filter("doc_id % 6 = 0").select("topic", T.content_hash(F.coalesce("text", "path")).alias("hash"), F.lit("done").alias("status"))
    out = JO.ingest_batch(files, done)
    per = out.facts.groupBy(F.col("source_id").alias("source_path")).agg(F.count("*").alias("n"))
    return out.manifest.join(per, "source_path", "left").select("topic", "hash", "source_path", "status", "error", F.coalesce("n", F.lit(0)).cast("long").alias("n_facts"))


@query("SELECT topic, source_id, pos, text, 'FCT-' || lpad(CAST(n AS VARCHAR), CAST(greatest(3, len(CAST(n AS VARCHAR))) AS INT), '0') AS fact_id FROM (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY source_id, pos) AS n FROM v_facts WHERE doc_id % 4 <> 0 AND doc_id % 10 <> 9)", "v_facts")
def e4_extracted_facts(spark, d):
    """Numbered facts of the sources that have a text envelope; images and sources without one give none."""
    s = V.sources(spark, d)
    return JO.extract(s.select("topic", "source_id", "title"), s.filter("doc_id % 4 <> 0"))[0].select("topic", "source_id", "pos", "text", "fact_id")


@query(f", {CLOSED} SELECT n.path AS ancestor, count(*) AS n_scores, min(c_acctbal) AS least, max(c_acctbal) AS most, list_sort(list(l.path)) AS paths FROM nodes n JOIN v_leaves l ON starts_with(l.path, n.path || '/') GROUP BY n.path", "v_leaves")
def e5_score_rollup(spark, d):
    """E5: the scores below each node, its own left out, and the paths that they come from."""
    leaves = V.leaves(spark, d)
    r = JO.score_rollup(leaves.select(F.col("path").alias("topic"), "c_acctbal"), TR.expanded(leaves))
    return r.scores.groupBy("ancestor").agg(F.count("*").alias("n_scores"), F.min("c_acctbal").alias("least"), F.max("c_acctbal").alias("most")).join(r.paths, "ancestor")


@query(
    """, x AS (SELECT a.path AS topic, b.path AS related_topic, len(list_intersect(a.tags, b.tags))::DOUBLE / len(list_distinct(list_concat(a.tags, b.tags))) AS strength FROM v_leaves a JOIN v_leaves b ON b.c_custkey = a.c_custkey + 1)
    SELECT topic, related_topic, strength, NULL::VARCHAR AS op, NULL::VARCHAR AS payload FROM x UNION ALL SELECT topic, NULL, NULL, 'CROSSLINK', '{"related_topic":"' || related_topic || '"}' FROM x""",
    "v_leaves",
)
def e6_crosslinks(spark, d):
    """Each customer linked to the next one with their strength, and the CROSSLINK operations."""
    leaves = V.leaves(spark, d)
    nxt = leaves.select((F.col("c_custkey") - 1).alias("c_custkey"), F.col("path").alias("related_topic"))
    edges, ops = JO.crosslink(leaves.join(nxt, "c_custkey").select(F.col("path").alias("topic"), "related_topic"), leaves)
    return edges.select("topic", "related_topic", "strength").unionByName(ops, allowMissingColumns=True)


@query("""SELECT path AS topic, 'VERSION' AS op, '{"version":"' || c_custkey % 5 || '.' || (c_custkey % 7 + 1) || '.0"}' AS payload FROM v_leaves""", "v_leaves")
def e7_version_bumps(spark, d):
    """The VERSION operation of every topic's next minor version."""
    parts = [(F.col("c_custkey") % k).cast("string") for k in (5, 7, 11)]
    return JO.bump_versions(V.leaves(spark, d).withColumn("version", F.concat_ws(".", *parts)), "minor")[1]


@query(
    """, f AS (SELECT 'user-' || doc_id % 50 AS topic, count(*) FILTER (confidence > 0.99) AS bad, count(*) FILTER (pos = 20) AS mocks FROM v_facts GROUP BY ALL),
    u AS (SELECT DISTINCT 'user-' || user_id AS topic, user_id % 5 = 0 AS broken FROM events)
    SELECT u.topic, NOT broken AND coalesce(bad, 0) = 0 AS valid, list_concat(CASE WHEN broken THEN ['lineage_error'] ELSE [] END, list_transform(range(coalesce(bad, 0)), lambda i: 'schema_error')) AS errors,
    list_transform(range(coalesce(mocks, 0)), lambda i: 'mock_source') AS warnings FROM u LEFT JOIN f ON u.topic = f.topic""",
    "v_facts",
)
def e8_validated(spark, d):
    """Each topic's report from facts out of range, chains of which every fifth is broken, and mock sources."""
    f = V.facts(spark, d).withColumns({"topic": F.concat(F.lit("user-"), (F.col("doc_id") % 50).cast("string")), "fact_id": F.lit("FCT-001"), "confidence": F.when(F.col("confidence") > 0.99, 1.5).otherwise(F.col("confidence"))})
    log = written(LI.built(V.operations(spark, d)), "chains")
    heads = log.groupBy("topic").agg(F.max_by("hash", "seq").alias("hash"))
    spoilt = (F.split("topic", "-")[1].cast("int") % 5 == 0) & (F.col("seq") == 1)
    broken = log.withColumn("payload", F.when(spoilt, F.lit("{}")).otherwise(F.col("payload")))
    return JO.validate(heads.select(F.col("topic").alias("path")), f, broken, heads, f.select("topic", "source_id", (F.col("pos") == 20).alias("mock")))


@query(
    f""", {ROUTED}, r AS (SELECT coalesce(topic, 'unsorted') AS topic, count(*) AS n, count(*) FILTER (ambiguous) AS n_ambiguous, count(topic) AS n_staged FROM routed WHERE hash NOT LIKE '0%' GROUP BY ALL UNION ALL SELECT 'unsorted', 0, 0, 0)
    SELECT topic, CAST(sum(n) AS BIGINT) AS n, CAST(sum(n_ambiguous) AS BIGINT) AS n_ambiguous, CAST(sum(n_staged) AS BIGINT) AS n_staged, topic <> 'unsorted' AND topic <> 'english' AND topic NOT IN (SELECT source FROM documents WHERE source IS NOT NULL) AS missing FROM r GROUP BY topic""",
    "v_intake", "v_routing",
)
def e12_routed(spark, d):
    """Where the files of done manifest entries go: counts, staged names and whether the topic lacks a node."""
    manifest = TI.intake_manifest(V.intake(spark, d)).withColumn("status", F.when(F.col("hash").startswith("0"), "failed").otherwise("done"))
    nodes = V.table(spark, d, "documents").select(F.col("source").alias("path")).distinct().union(spark.createDataFrame([("english",)], "path string"))
    r = JO.route(manifest, V.routing(spark), nodes)
    staged = r.staged.groupBy("topic").agg(F.countDistinct("name").alias("n_staged"))
    df = r.counts.join(staged, "topic", "left").join(r.missing.withColumn("lacks", F.lit(True)), "topic", "left")
    return df.select("topic", "n", "n_ambiguous", F.coalesce("n_staged", F.lit(0)).alias("n_staged"), F.coalesce("lacks", F.lit(False)).alias("missing"))


@query(
    f""", {ROUTED} SELECT topic, path, CASE WHEN doc_id % 13 <> 0 THEN string_split(path, '/')[-1] END AS name, CASE WHEN doc_id % 13 <> 0 THEN 'staged' ELSE 'missing' END AS status FROM routed WHERE topic IS NOT NULL""",
    "v_intake", "v_routing",
)
def e12_staged(spark, d):
    """Every routed file with its staged name, or that it no longer exists."""
    i = V.intake(spark, d)
    manifest = TI.intake_manifest(i).withColumn("status", F.lit("done"))
    staged = JO.route(manifest, V.routing(spark), i.select("path"), i.filter("doc_id % 13 <> 0").select("path")).staged
    return staged.select("topic", "path", "name", "status")


@query(
    f""", {KEYED}, {MATCH_CTES}, bad AS (SELECT DISTINCT topic FROM (SELECT topic FROM k GROUP BY topic, fact_key HAVING count(*) > 1)),
    good AS (SELECT * FROM k WHERE topic NOT IN (SELECT topic FROM bad)), fresh AS (SELECT * FROM good WHERE NOT EXISTS (SELECT 1 FROM cu WHERE cu.topic = good.topic AND cu.fact_key = good.fact_key))
    SELECT 'skipped' AS part, topic, NULL::VARCHAR AS fact_key, NULL::VARCHAR AS id, NULL::DOUBLE AS score, NULL::INT AS rank FROM bad UNION ALL SELECT 'new', topic, fact_key, NULL, NULL, NULL FROM fresh
    UNION ALL SELECT 'match', fresh.topic, fresh.fact_key, r.id, r.score, r.rank FROM fresh JOIN f ON f.doc_id = fresh.doc_id AND f.pos = fresh.pos JOIN r ON f.words = r.words AND f.categories = r.categories WHERE r.rank <= 3
    UNION ALL SELECT 'cursor', topic, fact_key, NULL, NULL, NULL FROM (SELECT topic, fact_key FROM good UNION SELECT topic, fact_key FROM cu WHERE topic NOT IN (SELECT topic FROM good))""",
    "v_sents", "v_claims",
)
def e10_synced(spark, d):
    """E10 whole: topics that are skipped because of colliding keys, new facts, their best claims, and the cursor after the run;
    skipped topics keep their cursor."""
    s = JO.sync_claims(V.sentences(spark, d), V.claims(spark, d), keyed(spark, d)[1])
    part = lambda df, name: df.select(F.lit(name).alias("part"), *[c for c in ("topic", "fact_key", "id", "score", "rank") if c in df.columns])
    return QU.all_issues(part(s.matches, "match"), part(s.skipped.drop("reason"), "skipped"), part(s.new, "new"), part(s.cursor, "cursor"))


@query(
    """, o AS (SELECT *, row_number() OVER (PARTITION BY hash ORDER BY string_split(path, '/')[-1], path) AS k, doc_id % 7 AS e, doc_id % 50 AS w, doc_id * 7 % 90 AS h, count(*) OVER (PARTITION BY hash) AS n FROM v_intake),
    pr AS (SELECT hash, bool_or(doc_id % 2 = 0) AS done FROM v_intake WHERE doc_id % 3 = 0 GROUP BY hash),
    tr AS (SELECT o.*, CASE WHEN e < 3 THEN 'text' WHEN e > 4 OR w = 0 THEN 'unsure' WHEN h * 1.0::DOUBLE / w >= 1.3 THEN 'doc-photo' ELSE 'exhibit-photo' END AS type,
      CASE WHEN k > 1 THEN 'duplicate' WHEN coalesce(done, false) THEN 'skipped' WHEN e >= 5 THEN 'failed' ELSE 'processed' END AS outcome FROM o LEFT JOIN pr ON o.hash = pr.hash)
    SELECT 'file' AS part, t.path AS name, outcome, type, CASE WHEN e >= 5 THEN 'failed' ELSE 'done' END AS status, c.path AS source_path, t.n AS n FROM tr t JOIN (SELECT hash, path FROM tr WHERE k = 1) c ON t.hash = c.hash
    UNION ALL SELECT 'summary', 'total', NULL, NULL, NULL, NULL, count(*) FROM tr UNION ALL SELECT 'summary', x, NULL, NULL, NULL, NULL, (SELECT count(*) FROM tr WHERE outcome = x) FROM (SELECT unnest(['processed', 'skipped', 'duplicate', 'failed']) AS x)
    UNION ALL SELECT 'summary', 'type_' || replace(x, '-', '_'), NULL, NULL, NULL, NULL, (SELECT count(*) FROM tr WHERE outcome IN ('processed', 'duplicate') AND type = x) FROM (SELECT unnest(['text', 'doc-photo', 'exhibit-photo', 'unsure']) AS x)""",
    "v_intake",
)
def e11_triaged(spark, d):
    """E11 whole: every file of a dump with its outcome, kind, canonical path and number of copies, and all counts of the summary."""
    i = V.intake(spark, d).withColumns({"width": F.col("doc_id") % 50, "height": F.col("doc_id") * 7 % 90})
    prior = i.filter("doc_id % 3 = 0").select("hash", F.when(F.col("doc_id") % 2 == 0, "done").otherwise("failed").alias("status"))
    rows, manifest, summary = JO.triage(i, prior)
    copies = manifest.select("hash", "source_path", (F.size("dup_paths") + 1).cast("long").alias("n"))
    files = rows.join(copies, "hash").select(F.lit("file").alias("part"), F.col("path").alias("name"), "outcome", F.col("classified_type").alias("type"), "status", "source_path", "n")
    counts = summary.select(F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).alias("n")) for c in summary.columns])).alias("c"))
    return files.unionByName(counts.select(F.lit("summary").alias("part"), "c.name", "c.n"), allowMissingColumns=True)


@query(
    """, g AS (SELECT topic, coalesce(categories[1], 'Uncategorized') AS category, count(*) AS n, min(source_id || chr(1) || lpad(CAST(pos AS VARCHAR), 9, '0')) AS seen FROM v_facts GROUP BY ALL)
    SELECT 'fact' AS part, topic, source_id, CAST(pos AS BIGINT) AS n, text FROM v_facts UNION ALL SELECT 'source', topic, source_id, NULL, title FROM v_sources
    UNION ALL SELECT 'evidence', topic, source_id, row_number() OVER (PARTITION BY topic ORDER BY source_id), NULL FROM v_sources
    UNION ALL SELECT 'counts', coalesce(a.topic, b.topic), CAST(coalesce(a.n, 0) AS VARCHAR), coalesce(b.n, 0), NULL FROM (SELECT topic, count(*) AS n FROM v_facts GROUP BY topic) a FULL JOIN (SELECT topic, count(*) AS n FROM v_sources GROUP BY topic) b ON a.topic = b.topic
    UNION ALL SELECT 'group', topic, category, row_number() OVER (PARTITION BY topic ORDER BY seen), CAST(n AS VARCHAR) FROM g""",
    "v_sources", "v_facts",
)
def e13_report(spark, d):
    """E13, P1 whole: all facts and sources of the bundles, their counts, the category groups and the evidence register."""
    (totals, source_pages, fact_pages), groups, register = JO.paged_report(V.sources(spark, d), V.facts(spark, d))
    long_ = lambda c: F.col(c).cast("long").alias("n")
    row = lambda df, part, *columns: df.select(F.lit(part).alias("part"), "topic", *columns)
    facts = row(fact_pages.select("topic", F.inline("facts")), "fact", "source_id", long_("pos"), F.col("statement").alias("text"))
    sources = row(source_pages.select("topic", F.inline("sources")), "source", "source_id", F.col("title").alias("text"))
    counts = row(totals, "counts", F.col("fact_count").cast("string").alias("source_id"), long_("source_count"))
    evidence = row(register, "evidence", "source_id", long_("evidence_no"))
    kinds = row(groups, "group", F.col("category").alias("source_id"), long_("group_no"), F.col("n").cast("string").alias("text"))
    return QU.all_issues(facts, sources, counts, evidence, kinds)


#: Raw documents of the six kinds by a number k, and the rules that they break, in SQL that both engines read.
RAW = {
    "topic": (
        """'{"topic":"t","path":"p","parent":null,"children":[],"version":"1","created_at":"","updated_at":"","actors":["a"],"description":"","status":"' || CASE WHEN k % 5 = 0 THEN 'open' ELSE 'active' END || '","node_type":"topic"' || CASE WHEN k % 3 = 0 THEN '' ELSE ',"tags":["x"]' END || CASE WHEN k % 7 = 0 THEN ',"x":1' ELSE '' END || '}'""",
        {"status: type or value": "k % 5 = 0", "tags: missing": "k % 3 = 0", "unknown keys: x": "k % 7 = 0"},
    ),
    "metadata": ("""'{"sources":[{"id":"S","type":"t","title":"t","origin":"o","added_at":"a","actor":"b"' || CASE WHEN k % 2 = 0 THEN ',"url":"u"' ELSE '' END || '}]}'""", {"sources[]: url: missing": "k % 2 = 1"}),
    "extract": (
        """'{"facts":[{"id":"FCT-001","text":"x","source_id":"SRC-001","confidence":' || CASE WHEN k % 4 = 0 THEN '1.5' ELSE '0.5' END || ',"categories":["' || CASE WHEN k % 3 = 0 THEN 'sport' ELSE 'history' END || '"]}]' || CASE WHEN k % 11 = 0 THEN ',"q":1' ELSE '' END || '}'""",
        {"facts[]: confidence: type or value": "k % 4 = 0", "facts[]: categories: type or value": "k % 3 = 0", "unknown keys: q": "k % 11 = 0"},
    ),
    "score": (
        """'{"scores":[{"fact_id":"f","relevance":1,"genealogy":2.5,"historical":0,"confidence":1,"novelty":' || CASE WHEN k % 8 = 3 THEN '"high"' ELSE '50' END || ',"promotion_score":1,"promoted":' || CASE WHEN k % 3 = 1 THEN '"yes"' ELSE 'true' END || '}]}'""",
        {"scores[]: novelty: type or value": "k % 8 = 3", "scores[]: promoted: type or value": "k % 3 = 1"},
    ),
    "lineage": ("""'{"topic":"t"' || CASE WHEN k % 4 = 1 THEN '' ELSE ',"hash":"h"' END || ',"operations":[{"id":"1","op":"A","hash":"h","actor":"a","timestamp":"t","more":' || k || '}]}'""", {"hash: missing": "k % 4 = 1"}),
    "related_topics": ("""CASE WHEN k % 13 = 0 THEN '{' ELSE '{"related":[{"topic":"a","relationship":"r","strength":' || k % 6 || '}]}' END""", {"not JSON": "k % 13 = 0", "related[]: strength: type or value": "k % 13 <> 0 AND k % 6 > 1"}),
}


@query(" UNION ALL ".join(f"SELECT '{kind}' AS kind, c_custkey AS k, '{error}' AS error FROM customer WHERE {rule.replace('k %', 'c_custkey %')}" for kind, (_, rules) in RAW.items() for error, rule in rules.items()))
def v1_six_kinds(spark, d):
    """V1: every broken rule of raw documents of all six kinds."""
    c = V.table(spark, d, "customer").select(F.col("c_custkey").alias("k"))
    return QU.all_issues(*[SH.document_errors(c.withColumn("raw", F.expr(raw)), kind).select(F.lit(kind).alias("kind"), "k", "error") for kind, (raw, _) in RAW.items()])


@query(
    """, c AS (SELECT CASE WHEN CAST(beat AS INT) % 7 = 3 THEN '' ELSE id[1:7] END AS id, CASE WHEN len(claim) % 5 = 0 THEN '' ELSE beat END AS beat, CASE WHEN len(claim) < 30 THEN '' ELSE claim END AS claim FROM v_claims)
    SELECT id, 'id: not empty' AS error FROM c WHERE id = '' UNION ALL SELECT id, 'beat: not empty' FROM c WHERE beat = '' UNION ALL SELECT id, 'claim: not empty' FROM c WHERE claim = '' UNION ALL SELECT id, 'id: not unique' FROM c GROUP BY id HAVING count(*) > 1""",
    "v_claims",
)
def v3_claim_rules(spark, d):
    """V3: claims that break each rule: empty and repeated ids, empty beats, empty claims."""
    c = V.claims(spark, d)
    size = F.length("claim")
    return QU.claim_errors(c.select(F.when(F.col("beat").cast("int") % 7 == 3, "").otherwise(F.substring("id", 1, 7)).alias("id"), F.when(size % 5 == 0, "").otherwise(F.col("beat")).alias("beat"), F.when(size < 30, "").otherwise(F.col("claim")).alias("claim")))


def line_runner(title: str, text: str):
    """Lines as facts; some sources can't be extracted."""
    if title.endswith("7"):
        raise ValueError(f"can't extract {title}")
    for line in (text or "").split("\n"):
        if line.strip():
            yield line.strip(), 0.5, [title]


@query(
    """SELECT topic, source_id, pos, text, title AS category, NULL::VARCHAR AS error FROM v_facts WHERE title NOT LIKE '%7' UNION ALL
    SELECT topic, source_id, NULL, NULL, NULL, 'ValueError: can''t extract ' || title FROM v_sources WHERE title LIKE '%7'""",
    "v_sources", "v_facts",
)
def x2_extracted(spark, d):
    """Facts by a user's runner as a table function, several a source, with the sources on which it fails."""
    facts, failures = FA.extracted_or_failed(V.sources(spark, d), line_runner)
    return QU.all_issues(facts.select("topic", "source_id", "pos", "text", F.get("categories", F.lit(0)).alias("category")), failures)


#: Small pages, so that the given tables fill many.
PAGE_ROWS, PAGE_BYTES = 40, 3000
PAGE = f"CAST(floor((nr - 1) / {PAGE_ROWS}) + floor((size_so_far - own_size) / {PAGE_BYTES}) AS BIGINT)"


def numbered_sql(view: str, key: str, order: str, text: str) -> str:
    """SQL that numbers a view's rows along a key and adds up the sizes of a text."""
    size = f"octet_length(encode({text}))"
    return f"(SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY {order}) AS nr, {size} AS own_size, sum({size}) OVER (PARTITION BY {key} ORDER BY {order} ROWS UNBOUNDED PRECEDING) AS size_so_far FROM {view})"


@query(
    f"""SELECT 'totals' AS part, coalesce(a.topic, b.topic) AS topic, NULL::BIGINT AS page, coalesce(a.n, 0) AS n, CAST(coalesce(b.n, 0) AS VARCHAR) AS content FROM (SELECT topic, count(*) AS n FROM v_facts GROUP BY topic) a FULL JOIN (SELECT topic, count(*) AS n FROM v_sources GROUP BY topic) b ON a.topic = b.topic
    UNION ALL SELECT 'facts', topic, {PAGE}, count(*), string_agg(source_id || ' ' || pos || ' ' || text, chr(10) ORDER BY nr) FROM {numbered_sql("v_facts", "topic", "source_id, pos", "text")} GROUP BY topic, {PAGE}
    UNION ALL SELECT 'sources', topic, {PAGE}, count(*), string_agg(source_id || ' ' || title, chr(10) ORDER BY nr) FROM {numbered_sql("v_sources", "topic", "source_id", "title")} GROUP BY topic, {PAGE}""",
    "v_sources", "v_facts",
)
def p1_pages(spark, d):
    """The whole content of every bundle, in pages of bounded rows and bytes, with the counts."""
    totals, sources, facts = FA.bundle_pages(V.sources(spark, d), V.facts(spark, d), PAGE_ROWS, PAGE_BYTES)
    joined = lambda items, line: F.array_join(F.transform(items, line), "\n").alias("content")
    return QU.all_issues(
        totals.select(F.lit("totals").alias("part"), "topic", F.col("fact_count").alias("n"), F.col("source_count").cast("string").alias("content")),
        facts.select(F.lit("facts").alias("part"), "topic", "page", "n", joined("facts", lambda x: F.concat_ws(" ", x["source_id"], x["pos"], x["statement"]))),
        sources.select(F.lit("sources").alias("part"), "topic", "page", "n", joined("sources", lambda x: F.concat_ws(" ", x["source_id"], x["title"]))),
    )


@query(
    f""", m AS (SELECT topic, source_id, 'Extracted ' || len(list_filter(string_split(text, chr(10)), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g') <> '')) || ' fact(s) from ' || title || '.' AS summary FROM v_sources WHERE kind = 'text')
    SELECT topic, {PAGE} AS page, string_agg(summary, chr(10) || chr(10) ORDER BY nr) AS summary FROM {numbered_sql("m", "topic", "source_id", "summary")} GROUP BY topic, {PAGE}""",
    "v_sources",
)
def a16_summary_pages(spark, d):
    """The summaries of topics of any size, in pages."""
    return FA.summary_pages(V.sources(spark, d).filter("kind = 'text'"), PAGE_ROWS, PAGE_BYTES)


@query(
    f""", o AS (SELECT DISTINCT CASE WHEN size_bytes % 3 = 0 THEN 'empty' ELSE hash END AS hash, path FROM v_intake),
    c AS (SELECT hash, arg_min(path, string_split(path, '/')[-1] || chr(1) || path) AS source_path FROM o GROUP BY hash),
    p AS (SELECT hash, {PAGE} AS page, list(path ORDER BY path) AS paths FROM {numbered_sql("o", "hash", "path", "path")} GROUP BY hash, {PAGE})
    SELECT hash, page, source_path, array_to_string(dup, chr(10)) AS dup_paths, CAST(len(dup) AS BIGINT) AS n FROM (SELECT *, list_filter(paths, lambda x: x <> source_path) AS dup FROM p JOIN c USING (hash)) WHERE page = 0 OR len(dup) > 0""",
    "v_intake",
)
def a13_manifest_pages(spark, d):
    """Duplicate paths in pages, where a third of all files are of one hash."""
    i = V.intake(spark, d).withColumn("hash", F.when(F.col("size_bytes") % 3 == 0, "empty").otherwise(F.col("hash")))
    return TI.manifest_pages(i, PAGE_ROWS, PAGE_BYTES).withColumn("dup_paths", F.array_join("dup_paths", "\n"))


#: A topic tree by a customer's number: the documents of RAW where its kind isn't left out, and an envelope for each topic.
LEFT_OUT = {"extract": "k % 9 = 0", "score": "k % 10 = 0"}
ENVELOPE = """CASE WHEN k % 12 = 0 THEN '[1]' ELSE '{"kind":"text","text":"x"' || CASE WHEN k % 5 = 1 THEN '' ELSE ',"sourceId":"SRC-001"' END || '}' END"""
TREE = RAW | {"envelope": (ENVELOPE, {"not JSON": "k % 12 = 0", "sourceId: missing": "k % 12 <> 0 AND k % 5 = 1"})}
#: What a sound document of each kind gives.
SOUND = {"topic": "active", "metadata": "S t", "extract": "FCT-001 x", "score": "f 50", "lineage": "1 1 A", "related_topics": "a r", "envelope": "SRC-001 x"}


def tree_sql() -> str:
    parts = []
    for kind, (_, rules) in TREE.items():
        there = f"NOT ({LEFT_OUT[kind]})" if kind in LEFT_OUT else "true"
        reasons = f"array_to_string(list_sort(list_filter([{', '.join(f"CASE WHEN {rule} THEN '{error}' END" for error, rule in rules.items())}], lambda x: x IS NOT NULL)), '; ')"
        parts.append(f"SELECT '{kind}' AS kind, path AS topic, CASE WHEN reason = '' THEN 'row' ELSE 'skipped' END AS part, CASE WHEN reason = '' THEN '{SOUND[kind]}' ELSE reason END AS content FROM (SELECT path, {reasons} AS reason FROM l WHERE {there})")
    parts += [f"SELECT '{kind}', path, 'skipped', 'missing' FROM l WHERE {rule}" for kind, rule in LEFT_OUT.items()]
    return ", l AS (SELECT path, c_custkey AS k FROM v_leaves) " + " UNION ALL ".join(parts)


@query(tree_sql(), "v_leaves")
def s1_tree_scan(spark, d):
    """A topic tree of seven kinds written as files and read back in one scan, bad documents with their reasons."""
    nodes = V.leaves(spark, d).select(F.col("path").alias("topic"), F.col("c_custkey").alias("k"))
    there = lambda kind: nodes.filter(f"NOT ({LEFT_OUT[kind]})") if kind in LEFT_OUT else nodes
    documents = QU.all_issues(*[there(kind).select("topic", F.lit(kind).alias("kind"), F.lit("SRC-001").alias("source_id"), F.expr(raw).alias("text")) for kind, (raw, _) in TREE.items()])
    root = new_folder(spark, "topics")
    W.write_files(W.tree_files(documents), root)
    tree = TT.read_tree(spark, root, required=tuple(LEFT_OUT))
    W.delete_folders(nodes.select(F.col("topic").alias("path")), root)  # the rows are in a table now
    rows = lambda df, kind, *columns: df.select(F.lit(kind).alias("kind"), F.col("path" if kind == "topic" else "topic").alias("topic"), F.lit("row").alias("part"), F.concat_ws(" ", *columns).alias("content"))
    return QU.all_issues(
        tree.skipped.select("kind", "topic", F.lit("skipped").alias("part"), F.col("reason").alias("content")),
        rows(tree.topics, "topic", "status"),
        rows(tree.sources, "metadata", "source_id", "title"),
        rows(tree.facts, "extract", "fact_id", "text"),
        rows(tree.scores, "score", "fact_id", F.col("novelty").cast("int")),
        rows(tree.operations, "lineage", "seq", "op_id", "op"),
        rows(tree.related, "related_topics", "related", "relationship"),
        rows(tree.envelopes, "envelope", "source_id", "text"),
    )
