"""Facts: extraction from lines and from model responses, numbering, scoring, histograms, density, report groups."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf
from pyspark.sql.udtf import UserDefinedTableFunction
from pyspark.sql.window import Window

from topicspark.functions import text as T
from topicspark.operators import ordered as O

# The closed vocabulary of fact categories.
CATEGORIES = ["aviation", "biography", "genealogy", "history", "industry"]


def line_facts(sources: DataFrame) -> DataFrame:
    """G1: one fact for each non-blank trimmed line of a source's text, with its place `pos` (from 0) in the source."""
    lines = F.filter(F.transform(F.split("text", "\n", -1), T.trimmed), lambda x: x != "")
    others = [c for c in sources.columns if c != "text"]
    return sources.select(*others, F.posexplode(lines).alias("pos", "text")).withColumn("confidence", F.lit(0.5))


def source_summaries(sources: DataFrame) -> DataFrame:
    """G1: `Extracted N fact(s) from <title>.` for each source."""
    n = F.size(F.filter(F.split("text", "\n", -1), lambda x: T.trimmed(x) != ""))
    return sources.withColumn("summary", F.concat(F.lit("Extracted "), F.coalesce(n, F.lit(0)).cast("string"), F.lit(" fact(s) from "), F.col("title"), F.lit(".")))


def numbered(facts: DataFrame) -> DataFrame:
    """fact_id FCT-NNN across a topic's sources, in source and fact order; a hot topic's facts are spread (ordered.py)."""
    return O.numbered(facts, ["topic"], ["source_id", "pos"], "fact_id").withColumn("fact_id", F.format_string("FCT-%03d", "fact_id"))


def joined_summaries(sources: DataFrame) -> DataFrame:
    """Each topic's summaries in source order with a blank line between."""
    rows = F.array_sort(F.collect_list(F.struct("source_id", "summary")))
    return source_summaries(sources).groupBy("topic").agg(F.array_join(F.transform(rows, lambda x: x["summary"]), "\n\n").alias("summary"))


def summary_pages(sources: DataFrame, rows: int = O.PAGE_ROWS, page_bytes: int = O.PAGE_BYTES) -> DataFrame:
    """A16 for topics of any size: (topic, page, summary): joined by blank lines, in order, the pages give the topic's summary."""
    pages = O.paged(source_summaries(sources), ["topic"], ["source_id"], ["summary"], "summaries", F.octet_length("summary"), rows, page_bytes)
    return pages.select("topic", "page", F.array_join(F.col("summaries.summary"), "\n\n").alias("summary"))


def parsed_responses(responses: DataFrame, column: str = "response") -> DataFrame:
    """Model responses to facts. Adds error (null if good) and facts (array of struct text, confidence, categories).

    The outer JSON has is_error and result; the result is JSON, perhaps inside a code fence. The first error found is told.
    """
    outer = F.from_json(column, "is_error boolean, result string, _bad string", {"columnNameOfCorruptRecord": "_bad"})
    df = responses.withColumn("_o", outer)
    fenced = F.regexp_extract("_o.result", r"(?s)```(?:json)?\s*\n(.*?)\n?```", 1)
    df = df.withColumn("_inner", F.when(fenced != "", fenced).otherwise(F.col("_o.result")))
    shape = "facts array<struct<text string, confidence double, categories array<string>>>, summary string, _bad string"
    df = df.withColumn("_i", F.from_json("_inner", shape, {"columnNameOfCorruptRecord": "_bad"}))
    bad_fact = F.exists("_i.facts", lambda f: f["text"].isNull() | (T.trimmed(f["text"]) == "") | f["confidence"].isNull() | (f["confidence"] < 0) | (f["confidence"] > 1) | F.exists(F.coalesce(f["categories"], F.array().cast("array<string>")), lambda c: ~c.isin(*CATEGORIES)))
    error = (
        F.when(F.col("_o").isNull() | F.col("_o._bad").isNotNull(), "response is not JSON")
        .when(F.col("_o.is_error"), "model reported an error")
        .when(F.col("_i").isNull() | F.col("_i._bad").isNotNull(), "result is not JSON")
        .when(F.col("_i.facts").isNull(), "facts missing")
        .when(bad_fact, "invalid fact")
    )
    return df.withColumn("error", error).withColumn("facts", F.when(F.col("error").isNull(), F.col("_i.facts"))).drop("_o", "_inner", "_i")


def scores(facts: DataFrame, threshold: float = 80.0) -> DataFrame:
    """five components, the rounded promotion score, and promotion by the unrounded one."""
    confidence = F.floor(F.col("confidence") * 100.0 + 0.5).cast("double")
    has = lambda c: F.when(F.array_contains("categories", c), 80.0).otherwise(20.0)
    df = facts.withColumns({"relevance": confidence, "genealogy": has("genealogy"), "historical": has("history"), "confidence_score": confidence, "novelty": F.lit(50.0)})
    raw = F.lit(0.0)
    weights = {"relevance": 0.3, "genealogy": 0.1, "historical": 0.2, "confidence_score": 0.3, "novelty": 0.1}
    terms = [F.col(c) * F.lit(w) for c, w in weights.items()]
    raw = terms[0]
    for t in terms[1:]:
        raw = raw + t
    return df.withColumn("promotion_score", T.round_half_up(raw, 10)).withColumn("promoted", raw >= threshold)


def scored_by(facts: DataFrame, adapter: Callable[[DataFrame, float], DataFrame] = scores, threshold: float = 80.0) -> DataFrame:
    """Scores by any adapter that maps facts and a threshold to facts with the score columns."""
    return facts.transform(adapter, threshold)


def confidence_histogram(facts: DataFrame, *keys: str) -> DataFrame:
    """A1: high from 0.8, medium from 0.5, low; zero filled."""
    c = F.col("confidence")
    return facts.groupBy(*keys).agg(F.count_if(c >= 0.8).alias("high"), F.count_if((c >= 0.5) & (c < 0.8)).alias("medium"), F.count_if(c < 0.5).alias("low"))


def category_histogram(facts: DataFrame, *keys: str) -> DataFrame:
    """A2: each category of a fact counts."""
    return facts.select(*keys, F.explode("categories").alias("category")).groupBy(*keys, "category").agg(F.count("*").alias("n"))


def promotion_counts(scored: DataFrame, *keys: str) -> DataFrame:
    """A3."""
    return scored.groupBy(*keys).agg(F.count_if("promoted").alias("promoted"), F.count_if(~F.col("promoted")).alias("rejected"))


def fact_density(sources: DataFrame, facts: DataFrame) -> DataFrame:
    """Facts per KiB of UTF-8 text, over topics with a fact; image sources give no bytes; 0 bytes: 0."""
    n = facts.groupBy("topic").agg(F.count("*").alias("facts"))
    size = sources.filter("kind <> 'image'").groupBy("topic").agg(F.sum(F.octet_length("text")).alias("bytes"))
    df = n.join(size, "topic", "left").withColumn("bytes", F.coalesce("bytes", F.lit(0)).cast("long"))
    return df.withColumn("density", F.when(F.col("bytes") > 0, F.col("facts") / (F.col("bytes") / F.lit(1024.0))).otherwise(0.0))


def by_first_category(facts: DataFrame) -> DataFrame:
    """Groups of facts under their first category, else Uncategorized, in first-seen order within the topic."""
    first = F.coalesce(F.try_element_at("categories", F.lit(1)), F.lit("Uncategorized"))
    df = facts.withColumn("category", first).groupBy("topic", "category").agg(F.count("*").alias("n"), F.min(F.struct("source_id", "pos")).alias("seen"))
    return df.withColumn("group_no", F.row_number().over(Window.partitionBy("topic").orderBy("seen"))).drop("seen")


def citations(facts: DataFrame, sources: DataFrame) -> DataFrame:
    """`title (origin)` of the cited source, or [Unknown Source]."""
    s = sources.select("topic", "source_id", F.concat(F.col("title"), F.lit(" ("), F.col("origin"), F.lit(")")).alias("citation"))
    return facts.join(s, ["topic", "source_id"], "left").withColumn("citation", F.coalesce("citation", F.lit("[Unknown Source]")))


def bundles(sources: DataFrame, facts: DataFrame) -> DataFrame:
    """A report row for each topic with its sources and facts nested in order, and their counts. A topic is
    one row here: where topics may have millions of facts, take bundle_pages()."""
    f = facts.groupBy("topic").agg(F.array_sort(F.collect_list(F.struct("source_id", "pos", F.col("text").alias("statement")))).alias("facts"), F.count("*").alias("fact_count"))
    s = sources.groupBy("topic").agg(F.array_sort(F.collect_list(F.struct("source_id", "title"))).alias("sources"), F.count("*").alias("source_count"))
    df = s.join(f, "topic", "full")
    return df.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("fact_count", "source_count")})


def bundle_pages(sources: DataFrame, facts: DataFrame, rows: int = O.PAGE_ROWS, page_bytes: int = O.PAGE_BYTES) -> tuple[DataFrame, DataFrame, DataFrame]:
    """P1, A17 for topics of any size: (totals, source pages, fact pages).

    totals: (topic, fact_count, source_count). Source pages: (topic, page, sources, n), in source order, and fact pages:
    (topic, page, facts, n), by source and place; their arrays hold what bundles() nests in one row, a page at a time.
    """
    f, s = (df.groupBy("topic").agg(F.count("*").alias(name)) for df, name in ((facts, "fact_count"), (sources, "source_count")))
    totals = s.join(f, "topic", "full").select("topic", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("fact_count", "source_count")])
    source_pages = O.paged(sources, ["topic"], ["source_id"], ["source_id", "title"], "sources", F.octet_length("title"), rows, page_bytes)
    fact_pages = O.paged(facts, ["topic"], ["source_id", "pos"], ["source_id", "pos", F.col("text").alias("statement")], "facts", F.octet_length("text"), rows, page_bytes)
    return totals, source_pages, fact_pages


def evidence_register(sources: DataFrame) -> DataFrame:
    """Sources numbered from 1 in ingest order."""
    return O.numbered(sources, ["topic"], ["source_id"], "evidence_no")


def report_order(facts: DataFrame) -> DataFrame:
    """A topic's facts numbered from 1 in the order of a report: by source, then fact key, then place."""
    return O.numbered(facts, ["topic"], ["source_id", "fact_key", "pos"], "report_no")


def extract_inputs(sources: DataFrame, envelopes: DataFrame) -> DataFrame:
    """Sources with an envelope that isn't an image's."""
    return sources.join(envelopes.filter("kind <> 'image'"), ["topic", "source_id"])


def extracted_by(inputs: DataFrame, runner: Callable[[str, str], Iterable[tuple[str, float, list[str]]]]) -> DataFrame:
    """Facts by a user's function of (title, text) that yields (text, confidence, categories); pos is their order.

    The function runs in Python workers over Arrow batches of sources; a source that yields nothing gives no row.
    """
    names = ["topic", "source_id", "title", "text"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(r.topic, r.source_id, pos, *fact) for r in batch.itertuples() for pos, fact in enumerate(runner(r.title, r.text))]
            yield pd.DataFrame(rows, columns=["topic", "source_id", "pos", "text", "confidence", "categories"])

    return inputs.select(*names).mapInPandas(run, "topic string, source_id string, pos int, text string, confidence double, categories array<string>")


def frame_texts(frames: DataFrame, clip: str) -> DataFrame:
    """(clip, text): one line for each frame (clip, ms, labels) in time order; a clip has a few dozen frames at most."""
    line = F.concat(F.lit("[frame @ "), T.clock(F.col("ms")), F.lit("] labels: "), F.col("labels"))
    rows = F.array_sort(F.collect_list(F.struct("ms", "labels", line.alias("line"))))
    return frames.groupBy(clip).agg(F.array_join(F.transform(rows, lambda x: x["line"]), "\n").alias("text"))


def extraction_function(runner: Callable[[str, str], Iterable[tuple[str, float, list[str]]]]) -> UserDefinedTableFunction:
    """A table function of sources (topic, source_id, title, text) by a user's runner of (title, text) that yields (text,
    confidence, categories). Call it on a table argument, or register it for SQL: SELECT * FROM f(TABLE(t) PARTITION BY (topic, source_id)).

    A source gives its facts with their pos from 0, or, if the runner fails, one row that has the error alone: one source
    can't end the job, and none is half extracted. A source's facts are held until its runner is through.
    """

    class Extract:
        def eval(self, row: Row) -> Iterator[tuple]:
            at = (row["topic"], row["source_id"])
            try:
                found = [(*at, pos, *fact, None) for pos, fact in enumerate(runner(row["title"], row["text"]))]
            except Exception as e:  # whatever a user's code may raise
                found = [(*at, None, None, None, None, f"{type(e).__name__}: {e}")]
            yield from found

    return udtf(Extract, returnType="topic string, source_id string, pos int, text string, confidence double, categories array<string>, error string")


def extracted_or_failed(inputs: DataFrame, runner: Callable[[str, str], Iterable[tuple[str, float, list[str]]]]) -> tuple[DataFrame, DataFrame]:
    """(facts, failures): what a runner makes of each source, dealt by source, and (topic, source_id, error) of those on which it
    failed. The runner goes over each source once for each of the two that is used."""
    named = inputs.select("topic", "source_id", "title", "text")
    out = extraction_function(runner)(named.asTable().partitionBy("topic", "source_id"))
    return out.filter("error IS NULL").drop("error"), out.filter("error IS NOT NULL").select("topic", "source_id", "error")
