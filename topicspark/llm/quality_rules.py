"""Quality rules: counts of a text, and a hashed n-gram log-likelihood ratio between trusted and raw text.

Only DataFrame functions on the main path.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import apart, table, together, words

#: The characters that n_symbols counts.
SYMBOLS = "#*$%&|<>"


def joined(grams: str, width: int) -> Column:
    """The hashes of grams twice as long: each with the one `width` places on, by itself at the end."""
    return F.transform(grams, lambda h, i: F.xxhash64(h, F.get(F.col(grams), i + F.lit(width))))


def bucket_counts(docs: DataFrame, text: str, trusted: str, orders: Sequence[int], buckets: int) -> DataFrame:
    """(bucket, raw, target): how many word n-grams of all texts, and of those with a true `trusted`, fall in each bucket."""
    df = docs.select(F.col(trusted).alias("t"), F.transform(words(F.col(text)), lambda x: F.xxhash64(x)).alias("h"))
    grams = df.select("t", F.explode(ngrams("h", orders)).alias("g")).select("t", F.pmod("g", F.lit(buckets)).cast("int").alias("bucket"))
    return grams.groupBy("bucket").agg(F.count("*").alias("raw"), F.count_if("t").alias("target"))


def ngrams(hashes: str, orders: Sequence[int]) -> Column:
    """The hash of each n-gram: of one word its own, of two xxhash64 of both words' hashes."""
    if not set(orders) <= {1, 2} or not orders:
        raise ValueError("orders are 1 and 2")
    parts = [F.col(hashes) if n == 1 else F.slice(joined(hashes, 1), 1, F.greatest(F.size(hashes) - 1, F.lit(0))) for n in orders]
    return parts[0] if len(parts) == 1 else F.concat(*parts)


def ratio_weights(counts: DataFrame, buckets: int, alpha: float) -> DataFrame:
    """One row: weights, an array of log p_target - log p_raw by bucket (buckets doubles: that is its size bound).

    The raw counts are scaled to the target's total before both get alpha: an n-gram that the target lacks because it is
    rare everywhere then says little, however small the target is.
    """
    everywhere = counts.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket")).join(counts, "bucket", "left")
    pairs = everywhere.agg(
        F.array_sort(F.collect_list(F.struct("bucket", F.coalesce("raw", F.lit(0)).alias("r"), F.coalesce("target", F.lit(0)).alias("t")))).alias("p"),
        F.coalesce(F.sum("raw"), F.lit(0)).alias("nr"),
        F.coalesce(F.sum("target"), F.lit(0)).alias("nt"),
    )
    a, share = F.lit(float(alpha)), F.when(F.col("nr") > 0, F.col("nt") / F.col("nr")).otherwise(0.0)
    return pairs.select(F.transform("p", lambda x: F.log((x["t"] + a) / (x["r"] * share + a))).alias("weights"))


def text_statistics(docs: DataFrame, text: str, window: int = 8) -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words (long) of the whole text, _h and _h2.

    n_repeat_words: words in a window of `window` words (a power of two) found twice or more in the text. A window's
    hash is built by doubling, log2(window) hashes a word; only texts with an equal pair of windows go on to sort
    them. _h: xxhash64 of each word, _h2: of each with the next, at the end of it alone. A null text counts as an empty one.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    bare = t
    for c in SYMBOLS:
        bare = F.replace(bare, F.lit(c), F.lit(""))
    lines = F.filter(F.split(t, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    df = docs.withColumns({"_words": words(F.col(text)), "_lines": lines, "n_symbols": (F.length(t) - F.length(bare)).cast("long")})
    df = df.withColumns(
        {
            "_h": F.transform("_words", lambda x: F.xxhash64(x)),
            "word_chars": F.length(F.array_join("_words", "")).cast("long"),
            "n_words": F.size("_words").cast("long"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        }
    ).drop("_words", "_lines")
    width, last = 1, "_h"
    while width < window:
        name = f"_h{2 * width}"
        df = df.withColumn(name, joined(last, width)).drop(*([last] if width > 2 else []))
        last, width = name, 2 * width
    windows = F.slice(last, 1, F.greatest(F.size("_h") - (window - 1), F.lit(0)))
    df = df.withColumn("_w", windows).drop(*([last] if width > 2 else []))
    placed = F.sort_array(F.transform("_w", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    df = df.withColumn("_p", F.when(F.size(F.array_distinct("_w")) < F.size("_w"), placed)).drop("_w")
    again = F.filter("_p", lambda x, i: (F.get(F.col("_p"), i + 1)["h"] == x["h"]) | ((i > 0) & (F.get(F.col("_p"), i - 1)["h"] == x["h"])))
    df = df.withColumn("_p", F.sort_array(F.transform(again, lambda x: x["i"])))
    step = F.transform("_p", lambda at, k: F.least(F.lit(window), F.coalesce(F.get(F.col("_p"), k + 1) - at, F.lit(window))))
    covered = F.aggregate(step, F.lit(0).cast("long"), lambda s, x: s + x.cast("long"))
    return df.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0).cast("long"))).drop("_p")


def quality_rules(
    docs: DataFrame,
    trusted: str = "trusted",
    text: str = "text",
    orders: Sequence[int] = (1, 2),
    buckets: int = 1 << 16,
    alpha: float = 5.0,
    least_ratio: float = -0.2,
    least_words: int = 20,
    most_repeated_pct: int = 30,
) -> DataFrame:
    """docs with their counts, base_failed, ratio (mean log-likelihood ratio of an n-gram) and kept.

    trusted: a boolean column; the texts of its true rows are the trusted target. The word n-grams of all docs make
    the raw multinomial, those of the trusted rows the target's, both over hash buckets and smoothed by alpha counts. A
    document stays if it passes the count rules and its ratio, the mean over its n-grams of
    log(p_target / p_raw), is at least least_ratio.
    Null or empty texts have no words and fail; a text without any n-gram has ratio 0; a null flag is not trusted;
    without trusted rows all ratios are 0. Repeated rows are judged each;
    columns of docs stay as they are, but for those with a result's name, which the result replaces.
    """
    weights = ratio_weights(bucket_counts(docs, text, trusted, orders, buckets), buckets, alpha).scalar()
    out = text_statistics(docs, text).withColumn("_m", weights)
    # a word's weight and its pair's are summed in one go; the last word has no pair
    look = lambda h: F.get("_m", F.pmod(h, F.lit(buckets)).cast("int"))
    each = {(1,): lambda h, _: look(h), (2,): lambda _, g: F.coalesce(look(g), F.lit(0.0)), (1, 2): lambda h, g: look(h) + F.coalesce(look(g), F.lit(0.0))}[tuple(sorted(orders))]
    n = sum((F.greatest(F.col("n_words") - (k - 1), F.lit(0)) for k in orders), start=F.lit(0))
    total = F.aggregate(F.zip_with("_h", F.slice("_h2", 1, F.greatest(F.size("_h2") - 1, F.lit(0))), each), F.lit(0.0), lambda s, x: s + x)
    out = out.withColumn("ratio", F.when(n > 0, total / n).otherwise(F.lit(0.0))).drop("_h", "_h2", "_m")
    failed = (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > most_repeated_pct * F.col("n_words"))
    # the row number, never negative, keeps filters on the verdicts above the counts: pushed below them, they would repeat
    # every window's hashes inside the others
    here = F.monotonically_increasing_id() >= 0
    out = out.withColumn("base_failed", failed & here)
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("ratio") >= least_ratio) & here)


#: Most ids of trusted documents that are broadcast (8 bytes each); more of them meet the texts by a shuffle.
MOST_BROADCAST = 4_000_000


def with_trusted(spark: SparkSession, docs: DataFrame, sf_dir: str, most_broadcast: int = MOST_BROADCAST) -> DataFrame:
    """docs with `trusted`: whether `labels` marks the document as of good quality. The ids are counted first: texts are
    not shuffled for a flag as long as most_broadcast ids hold them."""
    good = table(spark, sf_dir, "labels").filter("quality = 1 AND doc_id IS NOT NULL").select("doc_id").distinct()
    good = F.broadcast(good) if good.count() <= most_broadcast else good.hint("shuffle_hash")
    return docs.drop("trusted").join(good.withColumn("trusted", F.lit(True)), "doc_id", "left")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    judged = quality_rules(with_trusted(spark, docs, sf_dir))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "ratio")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the rules keep."""
    judged = quality_rules(with_trusted(spark, apart(docs, "doc_id", "text"), sf_dir))
    return together(judged.filter("kept"), docs, "doc_id", "text")
