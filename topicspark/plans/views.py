"""The library's entities derived from the given tables (topics, sources, facts, claims, logs), each in Spark and as SQL.

SQL holds the same views for DuckDB, as common table expressions by name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from topicspark.functions import text as T
from topicspark.operators import facts as facts_ops


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sources(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "documents")
    n = F.row_number().over(Window.partitionBy("source").orderBy("doc_id"))
    return df.select(
        F.col("source").alias("topic"),
        F.format_string("SRC-%03d", n).alias("source_id"),
        F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("title"),
        "lang",
        "text",
        F.sha2("text", 256).alias("content_hash"),
        F.when(F.col("doc_id") % 10 == 9, "image").otherwise("text").alias("kind"),
        "doc_id",
    )


def categories_of(lang: Column) -> Column:
    return F.when(lang == "en", F.array(F.lit("history"))).when(lang == "fr", F.array(F.lit("genealogy"))).when(lang == "de", F.array(F.lit("history"), F.lit("genealogy"))).otherwise(F.array().cast("array<string>"))


def facts(spark: SparkSession, d: str) -> DataFrame:
    """Line facts with a confidence and categories that follow from the document."""
    lines = facts_ops.line_facts(sources(spark, d))
    return lines.withColumns(
        {
            "confidence": ((F.col("doc_id") * 7 + F.col("pos") * 13) % 101) / F.lit(100.0),
            "categories": categories_of(F.col("lang")),
        }
    )


def sentences(spark: SparkSession, d: str) -> DataFrame:
    """Sentence facts of each document as a topic of its own."""
    parts = F.transform(F.split("text", r"[.\n]"), lambda x, i: F.struct(i.alias("pos"), T.trimmed(x).alias("text")))
    df = table(spark, d, "documents").select("doc_id", "lang", F.inline(F.filter(parts, lambda s: s["text"] != "")))
    return df.select("doc_id", "pos", F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("topic"), F.lit("SRC-001").alias("source_id"), "text", categories_of(F.col("lang")).alias("categories"))


def claims(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "benchmark").select("item_id", F.posexplode(F.split("text", r"[.\n]")).alias("pos", "claim"))
    df = df.withColumn("claim", T.trimmed(F.col("claim"))).filter("claim <> ''")
    categories = F.when(F.col("item_id") % 3 == 0, F.array(F.lit("history"))).when(F.col("item_id") % 3 == 1, F.array(F.lit("genealogy"))).otherwise(F.array(F.lit("industry"), F.lit("history")))
    return df.select(F.format_string("V-%03d-%02d", "item_id", "pos").alias("id"), F.col("item_id").cast("string").alias("beat"), "claim", F.slice(T.tokens(F.col("claim")), 1, 5).alias("keywords"), categories.alias("categories"))


def timing(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return e.select(F.concat(F.lit("src"), (F.col("user_id") % 20).cast("string")).alias("topic"), F.col("event_id").cast("string").alias("file"), F.floor(F.col("value") * 1000).cast("long").alias("ms"), F.when(F.col("event_type") == "error", "failure").otherwise("success").alias("outcome"))


def operations(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    seq = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return e.select(F.concat(F.lit("user-"), F.col("user_id").cast("string")).alias("topic"), seq.alias("seq"), F.upper("event_type").alias("op"), F.concat(F.lit('{"event_id":'), F.col("event_id").cast("string"), F.lit(',"event_type":"'), F.col("event_type"), F.lit('"}')).alias("payload"))


def leaves(spark: SparkSession, d: str) -> DataFrame:
    """The paths of the third level: region / nation / customer, with tags."""
    slug = lambda c: F.lower(F.translate(c, " _", "--"))
    c, n, r = (table(spark, d, x) for x in ("customer", "nation", "region"))
    df = c.join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    return df.select(F.concat_ws("/", slug(F.col("r_name")), slug(F.col("n_name")), F.concat(F.lit("customer-"), F.col("c_custkey").cast("string"))).alias("path"), F.array(slug(F.col("c_mktsegment")), slug(F.col("n_name"))).alias("tags"), F.concat(F.lit("ACTOR-"), F.lpad((F.col("c_custkey") % 7).cast("string"), 3, "0")).alias("actor"), "c_custkey", "c_acctbal")


EXTENSIONS = [".txt", ".md", ".pdf", ".png", ".HEIC", ".xyz", ""]


def intake(spark: SparkSession, d: str) -> DataFrame:
    """Files of an intake dump: path, content hash, size."""
    df = table(spark, d, "documents")
    ext = F.element_at(F.array(*[F.lit(e) for e in EXTENSIONS]), (F.col("doc_id") % 7 + 1).cast("int"))
    return df.select("doc_id", F.concat(F.lit("intake/"), F.col("source"), F.lit("/"), F.col("lang"), F.lit("/doc-"), F.col("doc_id").cast("string"), ext).alias("path"), F.sha2("text", 256).alias("hash"), F.octet_length("text").cast("long").alias("size_bytes"))


# A routing dictionary with nested keywords and one keyword of two topics.
ROUTING = [("english", 0, "en", 0), ("english", 0, "src1/en", 1), ("french", 1, "fr", 0), ("french", 1, "src2/fr", 1), ("first", 2, "src1", 0), ("third", 3, "src3", 0), ("thirdly", 4, "src3", 0)]


def routing(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ROUTING, "topic string, topic_ord int, keyword string, keyword_ord int")


TRIM = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"
STOPS = "[" + ", ".join(f"'{w}'" for w in T.STOP_WORDS) + ", '']"


def sql_normal(x: str) -> str:
    return rf"trim(regexp_replace(regexp_replace(lower({x}), '[^a-z0-9\s]', '', 'g'), '\s+', ' ', 'g'))"


def sql_tokens(x: str) -> str:
    """In order of first occurrence."""
    words = f"list_filter(string_split({sql_normal(x)}, ' '), lambda w: NOT list_contains({STOPS}, w))"
    return f"list_transform(list_filter(list_zip({words}, range(len({words}))), lambda z: list_position({words}, z[1]) = z[2] + 1), lambda z: z[1])"


SQL = {
    "v_sources": """SELECT source AS topic, 'SRC-' || lpad(CAST(row_number() OVER (PARTITION BY source ORDER BY doc_id) AS VARCHAR), CAST(greatest(3, len(CAST(row_number() OVER (PARTITION BY source ORDER BY doc_id) AS VARCHAR))) AS INT), '0') AS source_id,
      'doc-' || doc_id AS title, lang, text, sha256(text) AS content_hash, CASE WHEN doc_id % 10 = 9 THEN 'image' ELSE 'text' END AS kind, doc_id FROM documents""",
    "v_lines": f"""SELECT *, unnest(lines) AS line, generate_subscripts(lines, 1) - 1 AS pos FROM (
      SELECT *, list_filter(list_transform(string_split(text, chr(10)), lambda x: {TRIM.format("x")}), lambda x: x <> '') AS lines FROM v_sources)""",
    "v_facts": """SELECT topic, source_id, title, doc_id, lang, CAST(pos AS INT) AS pos, line AS text, ((doc_id * 7 + pos * 13) % 101) / 100.0::DOUBLE AS confidence,
      CASE lang WHEN 'en' THEN ['history'] WHEN 'fr' THEN ['genealogy'] WHEN 'de' THEN ['history', 'genealogy'] ELSE [] END AS categories FROM v_lines""",
    "v_sents": f"""SELECT doc_id, CAST(pos AS INT) AS pos, 'doc-' || doc_id AS topic, 'SRC-001' AS source_id, {TRIM.format("t")} AS text, CASE lang WHEN 'en' THEN ['history'] WHEN 'fr' THEN ['genealogy'] WHEN 'de' THEN ['history', 'genealogy'] ELSE [] END AS categories FROM (
      SELECT doc_id, lang, unnest(p) AS t, generate_subscripts(p, 1) - 1 AS pos FROM (SELECT doc_id, lang, regexp_split_to_array(text, '[.\\n]') AS p FROM documents)) WHERE {TRIM.format("t")} <> ''""",
    "v_claims": f"""SELECT 'V-' || lpad(CAST(item_id AS VARCHAR), 3, '0') || '-' || lpad(CAST(pos AS VARCHAR), 2, '0') AS id, CAST(item_id AS VARCHAR) AS beat, claim, ({sql_tokens("claim")})[1:5] AS keywords, {sql_tokens("claim")} AS tokens,
      CASE item_id % 3 WHEN 0 THEN ['history'] WHEN 1 THEN ['genealogy'] ELSE ['industry', 'history'] END AS categories FROM (
      SELECT item_id, pos, {TRIM.format("t")} AS claim FROM (SELECT item_id, unnest(p) AS t, generate_subscripts(p, 1) - 1 AS pos FROM (SELECT item_id, regexp_split_to_array(text, '[.\\n]') AS p FROM benchmark))) WHERE claim <> ''""",
    "v_timing": "SELECT 'src' || (user_id % 20) AS topic, CAST(event_id AS VARCHAR) AS file, CAST(floor(value * 1000) AS BIGINT) AS ms, CASE WHEN event_type = 'error' THEN 'failure' ELSE 'success' END AS outcome FROM events",
    "v_ops": """SELECT 'user-' || user_id AS topic, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INT) AS seq, upper(event_type) AS op,
      '{"event_id":' || event_id || ',"event_type":"' || event_type || '"}' AS payload FROM events""",
    "v_leaves": """SELECT lower(translate(r_name, ' _', '--')) || '/' || lower(translate(n_name, ' _', '--')) || '/customer-' || c_custkey AS path,
      [lower(translate(c_mktsegment, ' _', '--')), lower(translate(n_name, ' _', '--'))] AS tags, 'ACTOR-' || lpad(CAST(c_custkey % 7 AS VARCHAR), 3, '0') AS actor, c_custkey, c_acctbal
      FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
    "v_intake": "SELECT doc_id, 'intake/' || source || '/' || lang || '/doc-' || doc_id || (['.txt', '.md', '.pdf', '.png', '.HEIC', '.xyz', ''])[doc_id % 7 + 1] AS path, sha256(text) AS hash, CAST(octet_length(encode(text)) AS BIGINT) AS size_bytes FROM documents",
    "v_routing": "SELECT * FROM (VALUES " + ", ".join(str(r) for r in ROUTING) + ") t(topic, topic_ord, keyword, keyword_ord)",
}
NEEDS = {"v_lines": ["v_sources"], "v_facts": ["v_lines"]}


def with_views(sql: str, *names: str) -> str:
    """sql after a WITH that defines the named views and those that they need."""
    order: list[str] = []

    def add(name: str) -> None:
        for n in NEEDS.get(name, []):
            add(n)
        if name not in order:
            order.append(name)

    for name in names:
        add(name)
    head = ",\n".join(f"{n} AS ({SQL[n]})" for n in order)
    body = sql.strip()
    return f"WITH RECURSIVE {head},\n{body[5:]}" if body[:5].upper() == "WITH " else f"WITH RECURSIVE {head}\n{body}"
