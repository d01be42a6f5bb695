"""Matching facts to claims: a weighted set-similarity join by an inverted index of rare words first, with the best claims of each fact."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from topicspark.functions import text as T
from topicspark.operators.ordered import numbered
from topicspark.shared import written

#: Between the categories of a set.
SEP = "\u0002"


#: Copies of the claims' words against which the words of texts are dealt, so that a word of most texts is spread.
SALTS = 8


def by_salt(rows: DataFrame, of: Column) -> DataFrame:
    return rows.withColumn("_salt", F.pmod(F.xxhash64(of), F.lit(SALTS)))


def salted(rows: DataFrame) -> DataFrame:
    return rows.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))


def score_of(shared_categories: Column, words: Column, shared_keywords: Column, keywords: Column, shared_words: Column, of_words: Column) -> Column:
    """F5 from a category overlap and from counts of distinct words: its own value, or a bound where the shared are bounds."""
    part = lambda shared, a, b: F.when((a == 0) | (b == 0), F.lit(0.0)).otherwise(shared.cast("double") / (a + b - shared))
    return T.round_half_up(F.lit(0.4) * shared_categories + F.lit(0.3) * part(shared_keywords, words, keywords) + F.lit(0.3) * part(shared_words, words, of_words), 1000)


class Matching(NamedTuple):
    texts: DataFrame
    claims: DataFrame
    postings: DataFrame
    sets: DataFrame
    firsts: DataFrame


def prepared(facts: DataFrame, claims: DataFrame, top: int) -> Matching:
    """texts (_t, _set, words, xs, most), claims (c, id, _cset, keywords, of_words, ks, ws, us), postings (x, c, _cset,
    keywords, of_words), sets (_set, _cset, overlap) and firsts (_set, c, overlap, keywords, of_words, ks, ws).

    Claims are numbered in the order of their ids, and their words from the rarest, so that xs, the text's words that occur
    in claims, is a sorted array of numbers, as are a claim's ks, ws and us, all of both; words, keywords and of_words count
    distinct words. Pairs of category sets are all there are of both, with their Jaccard overlap: sets are combinations of a
    closed vocabulary, so few, and only those that share a category. firsts are the `top` best claims of a set by categories
    alone; most is the best overlap of a text's set.

    Texts are dealt by _t as short arrays of numbers, and stay so: what is grouped or joined by _t from them moves no more.
    """
    none = F.array().cast("array<string>")
    c = claims.filter("claim IS NOT NULL").select("id", F.array_distinct(F.coalesce("keywords", none)).alias("k"), F.coalesce("categories", none).alias("a"), T.tokens(F.col("claim")).alias("w"))
    c = written(numbered(c.withColumn("_cset", F.array_join("a", SEP)).withColumn("_all", F.lit(0)), ["_all"], ["id"], "c").drop("_all"), "claims")
    per = c.select("c", F.explode(F.array_union("k", "w")).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    every = F.lit(SEP)  # in all texts and in no claim: texts without a claim's word keep a row by it
    vocabulary = numbered(per.withColumn("_all", F.lit(0)), ["_all"], ["n", "word"], "x").select("word", "x")
    vocabulary = written(vocabulary.unionByName(c.sparkSession.range(1).select(every.alias("word"), F.lit(0).alias("x"))), "vocabulary")
    coded = lambda words: c.select("c", F.explode(words).alias("word")).join(vocabulary, "word").groupBy("c").agg(F.sort_array(F.collect_list("x")).alias(words + "s"))
    numbers = F.array().cast("array<int>")
    c = c.select("c", "id", "_cset", "a", F.size("k").alias("keywords"), F.size("w").alias("of_words")).join(coded("k"), "c", "left").join(coded("w"), "c", "left")
    c = c.withColumns({n: F.coalesce(n, numbers) for n in ("ks", "ws")})
    c = written(c.withColumn("us", F.array_union("ks", "ws")), "claims")

    a = facts.groupBy("_set").agg(F.any_value("categories").alias("a"))
    b = c.groupBy("_cset").agg(F.any_value("a").alias("b"))
    shared = a.select("_set", "a", F.explode(F.array_distinct("a")).alias("e")).join(b.select("_cset", "b", F.explode(F.array_distinct("b")).alias("e")), "e").drop("e").distinct()
    sets = written(shared.select("_set", "_cset", T.jaccard(F.col("a"), F.col("b")).alias("overlap")), "sets")
    most = sets.groupBy("_set").agg(F.max("overlap").alias("most"))
    by_set = sets.join(c.select("c", "_cset"), "_cset").select("_set", "c", "overlap", T.round_half_up(F.lit(0.4) * F.col("overlap"), 1000).alias("score"))
    firsts = written(best_of(by_set, "_set", top).select("_set", "c", "overlap").join(c.select("c", "keywords", "of_words", "ks", "ws"), "c"), "firsts")
    postings = written(c.select(F.explode("us").alias("x"), "c", "_cset", "keywords", "of_words"), "postings")

    f = facts.select("_t", "_set", F.explode(F.array(T.tokens(F.col("text")))).alias("w"))  # exploded: tokens are found once
    f = f.select("_t", "_set", F.size("w").alias("words"), F.explode(F.array_append("w", every)).alias("word"))
    found = by_salt(f, F.col("_t")).join(salted(vocabulary), ["word", "_salt"]).groupBy("_t")
    texts = found.agg(F.any_value("_set").alias("_set"), F.any_value("words").alias("words"), F.array_remove(F.sort_array(F.collect_set("x")), 0).alias("xs"))
    texts = texts.join(F.broadcast(most), "_set", "left").withColumn("most", F.coalesce("most", F.lit(0.0)))
    return Matching(texts, c.drop("a"), postings, sets, firsts)


def candidates(m: Matching, rows: DataFrame) -> DataFrame:
    """(_t, c, and what scored() needs), each pair once, of the rows (_t, _set, words, xs, at, x, left, least): those whose x a claim has
    and whose bound is least or more.

    at: how many of xs are rarer than x; a claim that has one of these is left to its rarest. left: how many of the text's
    words that occur in claims come from x on, in order of rarity. A pair whose rarest shared word is x shares no
    more, and no more than the claim has; that bounds its score.
    """
    met = by_salt(rows, F.col("_t")).join(salted(m.postings), ["x", "_salt"]).join(m.sets, ["_set", "_cset"], "left").withColumn("overlap", F.coalesce("overlap", F.lit(0.0)))
    most = lambda n: F.least(F.col("left"), F.col(n))
    bound = score_of(F.col("overlap"), F.col("words"), most("keywords"), F.col("keywords"), most("of_words"), F.col("of_words"))
    met = met.filter(bound >= F.col("least")).join(m.claims.select("c", "ks", "ws", "us"), "c")
    return met.filter((F.col("at") == 0) | ~F.arrays_overlap(F.slice("xs", F.lit(1), F.col("at")), "us"))


def scored(pairs: DataFrame) -> DataFrame:
    """(_t, c, score) of pairs, exactly."""
    shared = F.struct(F.size(F.array_intersect("xs", "ks")).alias("k"), F.size(F.array_intersect("xs", "ws")).alias("w"))
    # inlined, so that each overlap is counted once, though the score, and filters on it, name it often
    df = pairs.select("_t", "c", "overlap", "words", "keywords", "of_words", F.inline(F.array(shared)))
    return df.select("_t", "c", score_of(F.col("overlap"), F.col("words"), F.col("k"), F.col("keywords"), F.col("w"), F.col("of_words")).alias("score"))


def best_of(rows: DataFrame, key: str, top: int) -> DataFrame:
    n = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("score"), "c"))
    return rows.withColumn("rank", n).filter(F.col("rank") <= top)


def lists_of(best: DataFrame, name: str) -> DataFrame:
    """The best claims of each text as one array (of -score and c) in order."""
    return best.groupBy("_t").agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), "c"))).alias(name))


def merged(top: int) -> Column:
    """The best of the lists top and more."""
    lists = [F.coalesce(x, F.array().cast("array<struct<s double, c int>>")) for x in ("top", "more")]
    return F.slice(F.sort_array(F.array_distinct(F.concat(*lists))), 1, top)


def match_claims(facts: DataFrame, claims: DataFrame, key: list[str], top: int = 3, least: float = 0.1, first: int = 2) -> DataFrame:
    """For each fact (by key) its best claims by score, ties by id, with bucket and rank. Null texts and claims match
    nothing; claims' ids are unique.

    A score of `least` or more needs a shared category, keyword or word. By categories alone the `top` best claims of a
    fact's category set come first of those that share no word. By words: a text's words are looked up from the
    rarest. The `first` rarest give claims that are scored exactly; the top-th score so found (or least) is what a
    further claim must reach. A claim whose rarest shared word is the n-th can only share the words from there on, so
    the lookup of a text ends where even all of these would not reach it: common words are mostly never looked up. No
    claim is lost: bounds are upper bounds of the rounded score, and ties are kept. Distinct texts are matched once.

    Pairs are met, scored and ranked where their text lies: texts move, as arrays of numbers and with no more than `top`
    claims each, and pairs do only where the claims are too many to be broadcast.
    """
    none = F.array().cast("array<string>")
    f = facts.filter("text IS NOT NULL").select(*key, F.col("text"), F.coalesce("categories", none).alias("categories")).withColumn("_set", F.array_join("categories", SEP))
    # never null, so that joins need no filter on it, and the texts are the same to Spark on both sides of them
    f = f.withColumn("_t", F.coalesce(F.unhex(F.md5(F.concat_ws("\u0001", "text", "_set"))), F.lit(b"")))
    m = prepared(f, claims, top)
    n = F.size("xs")
    rare = m.texts.select("*", F.posexplode(F.slice("xs", 1, first)).alias("at", "x")).withColumns({"left": n - F.col("at"), "least": F.lit(least)})
    by_words = lists_of(best_of(scored(candidates(m, rare)).filter(F.col("score") >= least), "_t", top), "top")
    by_set = lists_of(scored(m.texts.join(m.firsts, "_set")).filter(F.col("score") >= least), "more")
    texts = m.texts.join(by_words, "_t", "left").join(by_set, "_t", "left").withColumn("top", merged(top)).drop("more")
    texts = texts.withColumn("least", F.when(F.size("top") == top, -F.get("top", F.lit(top - 1))["s"]).otherwise(F.lit(least)))

    def whole(left: Column) -> Column:
        return score_of(F.col("most"), F.col("words"), left, left, left, left)

    open_ = (n > first) & (whole(n - first) >= F.col("least"))  # others have all that they can reach
    texts = written(texts.withColumn("xs", F.when(open_, F.col("xs"))).select("_t", "_set", "words", "xs", "most", "least", "top"), "texts").repartition("_t")
    late = texts.filter("xs IS NOT NULL").select("*", F.posexplode("xs").alias("at", "x")).withColumn("left", n - F.col("at"))
    late = late.filter((F.col("at") >= first) & (whole(F.col("left")) >= F.col("least")))
    more = lists_of(best_of(scored(candidates(m, late)).filter(F.col("score") >= least), "_t", top), "more")
    best = texts.select("_t", "top").join(more, "_t", "left").select("_t", merged(top).alias("best")).filter(F.size("best") > 0)
    rows = f.select(*key, "_t").join(best, "_t").select(*key, F.posexplode("best").alias("at", "b"))
    score = -F.col("b.s")
    rows = rows.select(*key, F.col("b.c").alias("c"), score.alias("score"), T.match_bucket(score).alias("bucket"), (F.col("at") + 1).alias("rank"))
    return rows.join(m.claims.select("c", "id"), "c").select(*key, "id", "score", "bucket", "rank")


def tag_overlap(edges: DataFrame, topics: DataFrame) -> DataFrame:
    """Jaccard strength of given topic pairs (topic, related_topic); a given strength wins."""
    a = topics.select(F.col("path").alias("topic"), F.col("tags").alias("_a"))
    b = topics.select(F.col("path").alias("related_topic"), F.col("tags").alias("_b"))
    strength = T.jaccard(F.col("_a"), F.col("_b"))
    if "strength" in edges.columns:
        strength = F.coalesce("strength", strength)
    return edges.join(a, "topic").join(b, "related_topic").withColumn("strength", strength).drop("_a", "_b")


def collisions(facts: DataFrame) -> DataFrame:
    """Topics with a fact key that two of their facts share."""
    return facts.groupBy("topic", "fact_key").agg(F.count("*").alias("n")).filter("n > 1").select("topic").distinct()


def new_facts(facts: DataFrame, cursor: DataFrame) -> DataFrame:
    """Facts whose (topic, fact_key) isn't in the last snapshot."""
    return facts.join(cursor.select("topic", "fact_key"), ["topic", "fact_key"], "left_anti")


def changed_topics(facts: DataFrame, cursor: DataFrame) -> DataFrame:
    """Topics whose key set differs from the snapshot's."""
    now = facts.select("topic", "fact_key").distinct().withColumn("now", F.lit(1))
    was = cursor.select("topic", "fact_key").distinct().withColumn("was", F.lit(1))
    return now.join(was, ["topic", "fact_key"], "full").filter("now IS NULL OR was IS NULL").select("topic").distinct()


def next_cursor(facts: DataFrame, cursor: DataFrame) -> DataFrame:
    """The snapshot after a run: the current keys of topics that have facts; other topics keep theirs."""
    now = facts.select("topic", "fact_key").distinct()
    return now.unionByName(cursor.select("topic", "fact_key").join(now.select("topic").distinct(), "topic", "left_anti"))
