"""Routing files to topics by keywords in their paths, staging names, and checks of the dictionary and of paths."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from topicspark.functions import text as T
from topicspark.operators.ordered import numbered
from topicspark.shared import written


def run_of(words: Column, n: int) -> Callable[[Column], Column]:
    return lambda i: F.array_join(F.slice(words, i, F.lit(n)), " ")


def classified(paths: DataFrame, routing: DataFrame) -> DataFrame:
    """Paths (path) with topic, keyword and ambiguous.

    The keyword with the most words wins, then the longest, then the dictionary's first within a topic; if two topics
    are equal at the best, the path is ambiguous and gets none. Candidates meet in one equi-join on an anchor, and the
    pattern is tried on them alone. The anchor of a keyword of letters and digits is the keyword, a run of the path's words.
    One with punctuation has its longest word as anchor: all its words are whole words of a path that contains it. One of
    punctuation alone must stand between two words, so it is what lies between two words of the path.
    """
    k = routing.withColumn("needle", T.normalise_path(F.col("keyword"))).filter("needle <> ''")
    longest = F.array_sort(F.array_remove(F.split("needle", "[^A-Za-z0-9_]+", -1), ""), lambda a, b: F.length(b) - F.length(a))
    plain = F.col("needle").rlike("^[a-z0-9]+( [a-z0-9]+)*$")
    anchor = F.when(plain, F.col("needle")).otherwise(F.coalesce(F.try_element_at(longest, F.lit(1)), F.col("needle")))
    k = k.withColumns({"words": F.size(F.split("needle", " ")), "chars": F.length("needle"), "anchor": anchor})
    most = k.agg(F.coalesce(F.max(F.when(plain, F.col("words"))), F.lit(1))).first()[0]
    p = paths.select("path").distinct().withColumn("normal", T.normalise_path(F.col("path")))
    words = F.split(F.regexp_replace("normal", "[^A-Za-z0-9_]+", " "), " ")
    runs = F.flatten(F.array(*[F.transform(F.sequence(F.lit(1), F.size(words)), run_of(words, n)) for n in range(1, most + 1)]))
    between = F.array_remove(F.split("normal", "[A-Za-z0-9_]+", -1), "")
    hits = p.select("path", "normal", F.explode(F.array_distinct(F.concat(runs, between))).alias("anchor")).join(k, "anchor")
    columns = ["path", "normal", "needle", "topic", "topic_ord", "keyword", "keyword_ord", "words", "chars"]
    hits = hits.select(columns).filter(T.contains_words(F.col("normal"), F.col("needle")))
    order = [F.desc("words"), F.desc("chars")]
    best = hits.withColumn("r", F.row_number().over(Window.partitionBy("path", "topic").orderBy(*order, "keyword_ord"))).filter("r = 1")
    best = best.withColumn("rank", F.rank().over(Window.partitionBy("path").orderBy(*order))).filter("rank = 1")
    best = best.groupBy("path").agg(F.count("*").alias("n"), F.first("topic").alias("topic"), F.first("keyword").alias("keyword"))
    one = F.col("n") == 1
    found = best.select("path", F.when(one, F.col("topic")).alias("topic"), F.when(one, F.col("keyword")).alias("keyword"), (~one).alias("ambiguous"))
    return paths.join(found, "path", "left").withColumn("ambiguous", F.coalesce("ambiguous", F.lit(False)))


def routing_counts(routed: DataFrame) -> DataFrame:
    """Files by topic, `unsorted` always there, and how many are ambiguous."""
    df = routed.groupBy(F.coalesce("topic", F.lit("unsorted")).alias("topic")).agg(F.count("*").alias("n"), F.count_if("ambiguous").alias("n_ambiguous"))
    zero = routed.sparkSession.range(1).select(F.lit("unsorted").alias("topic"), F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("n_ambiguous"))
    return df.unionByName(zero).groupBy("topic").agg(F.sum("n").alias("n"), F.sum("n_ambiguous").alias("n_ambiguous"))


def missing_topics(routed: DataFrame, topics: DataFrame) -> DataFrame:
    """Matched topics without a node."""
    return routed.filter("topic IS NOT NULL").select("topic").distinct().join(topics.select(F.col("path").alias("topic")), "topic", "left_anti")


def staged_names(files: DataFrame) -> DataFrame:
    """Files (topic, path, hash) with their staged name. In the order of a topic's paths, a file whose base name is used
    already gets -<hash8> before its extension, and the name that it gets is used from then on; `clash` tells a name that
    still occurs twice (suffixed names aren't tried again).

    A name is used if an earlier file has that base name, or if it is an earlier file's suffixed name. The latter can
    only be said of a base name that ends like a suffixed one, so such files alone are looked at again, in joins by
    (topic, name), until none changes: a suffixed name is nine characters longer than its base name, so that rounds are
    as few as the suffixes that a name holds. No topic is gathered.
    """
    base, stem = T.basename(F.col("path")), T.stem(F.col("path"))
    suffixed = F.concat(stem, F.lit("-"), F.substring("hash", 1, 8), F.substring(base, F.length(stem) + 1, F.lit(1 << 20)))
    df = written(numbered(files.withColumns({"_base": base, "_suffixed": suffixed}), ["topic", "_base"], ["path", "hash"], "_n"), "names")
    later = df.filter("_n > 1").select("topic", "path", "_suffixed")
    odd = df.filter((F.col("_n") == 1) & F.col("_base").rlike(r"-[^/]{0,8}(\.[^.]*)?$")).select("topic", "path", "_base", "_suffixed")
    late = None
    if not odd.isEmpty():
        odd, found = written(odd, "names"), later
        while True:
            since = found.groupBy("topic", F.col("_suffixed").alias("_base")).agg(F.min("path").alias("_since"))
            now = written(odd.join(since, ["topic", "_base"]).filter("_since < path").select("topic", "path", "_suffixed"), "names")
            if now.count() == (late.count() if late is not None else 0):
                break
            late, found = now, later.unionByName(now)
    if late is None:
        df = df.withColumn("_late", F.lit(None).cast("boolean"))
    else:
        df = df.join(late.select("topic", "path", F.lit(True).alias("_late")), ["topic", "path"], "left")
    df = df.withColumn("name", F.when((F.col("_n") > 1) | F.coalesce("_late", F.lit(False)), F.col("_suffixed")).otherwise(F.col("_base")))
    twice = df.groupBy("topic", "name").agg(F.count("*").alias("_same")).filter("_same > 1").select("topic", "name", F.lit(True).alias("clash"))
    return df.join(twice, ["topic", "name"], "left").select(*files.columns, "name", F.coalesce("clash", F.lit(False)).alias("clash"))


# What a topic's name in a routing dictionary must look like.
SLUG = "^[a-z0-9-]+$"


def routing_errors(routing: DataFrame) -> DataFrame:
    """V2: (topic, error), each once, of a dictionary as read_routing gives it: bad topic names, topics without a keyword (a row
    without keyword_ord), blank or missing keywords, and normalised keywords of two topics."""
    k = routing.withColumn("needle", T.normalise_path(F.col("keyword")))
    no_list = F.col("keyword_ord").isNull() if "keyword_ord" in routing.columns else F.lit(False)
    bad = k.filter(~F.coalesce(F.col("topic").rlike(SLUG), F.lit(False))).select("topic", F.lit("invalid topic name").alias("error"))
    none = k.filter(no_list).select("topic", F.lit("no keywords").alias("error"))
    blank = k.filter(~no_list & (T.trimmed(F.coalesce("keyword", F.lit(""))) == "")).select("topic", F.lit("blank keyword").alias("error"))
    shared = k.filter("needle <> ''").groupBy("needle").agg(F.countDistinct("topic").alias("n")).filter("n > 1")
    twice = k.join(shared, "needle", "left_semi").select("topic", F.concat(F.lit("keyword of two topics: "), F.col("needle")).alias("error"))
    return bad.unionByName(none).unionByName(blank).unionByName(twice).distinct()


def resolved(path: Column) -> Column:
    """P5: the path without . and .. segments; null if it leads out of its root."""
    step = lambda acc, s: F.when(acc.isNull(), acc).when((s == ".") | (s == ""), acc).when((s == "..") & (F.size(acc) == 0), F.lit(None).cast("array<string>")).when(s == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(s)))
    return F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step, lambda acc: F.array_join(acc, "/"))


def within(path: Column, scope: str) -> Column:
    """Whether the resolved path is the scope or lies in it."""
    at = resolved(path)
    return F.coalesce((at == scope) | at.startswith(f"{scope}/"), F.lit(False))
