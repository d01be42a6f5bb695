"""Triage of incoming files: kinds, duplicates, resuming, manifests and their summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from topicspark.functions import text as T
from topicspark.operators import ordered as O

# Extensions by how a file is read.
TEXT = [".txt", ".md", ".json"]
EXTRACTABLE = [".pdf", ".docx", ".epub"]
IMAGE = [".jpg", ".jpeg", ".png", ".webp", ".gif", ".heic"]
# Whole words (an s may follow) of a label that tell a document.
DOCUMENT_WORDS = ["document", "text", "paper", "letter", "receipt", "book", "newspaper", "page", "handwriting"]


def file_class(path: Column) -> Column:
    """Text, extractable, image or unsupported by extension."""
    ext = T.extension(path)
    return F.when(ext.isin(*TEXT), "text").when(ext.isin(*EXTRACTABLE), "extractable").when(ext.isin(*IMAGE), "image").otherwise("unsupported")


def geometry_kind(width: Column, height: Column) -> Column:
    """struct kind, confidence (0 where the size is unknown, else null)."""
    known = width.isNotNull() & height.isNotNull() & (width > 0)
    doc = known & (height.cast("double") / F.when(width > 0, width) >= 1.3)
    return F.struct(F.when(doc, "text-doc").otherwise("photo").alias("kind"), F.when(~known, F.lit(0.0)).alias("confidence"))


def label_kinds(labels: DataFrame) -> DataFrame:
    """(image, description, score) to kind and confidence for each image."""
    word = "(?i)(?<![A-Za-z0-9_])(" + "|".join(DOCUMENT_WORDS) + ")s?(?![A-Za-z0-9_])"
    df = labels.groupBy("image").agg(F.coalesce(F.max(F.when(F.col("description").rlike(word), F.col("score"))), F.lit(0.0)).alias("best"))
    doc = F.col("best") >= 0.5
    return df.select("image", F.when(doc, "text-doc").otherwise("photo").alias("kind"), F.when(doc, F.col("best")).otherwise(1 - F.col("best")).alias("confidence"))


def classified_type(kind: Column, source: Column, confidence: Column) -> Column:
    """of an image: unsure if only its unknown geometry spoke, else doc-photo or exhibit-photo."""
    return F.when((source == "aspect-ratio") & (confidence == 0), "unsure").when(kind == "text-doc", "doc-photo").otherwise("exhibit-photo")


def duplicates_marked(files: DataFrame) -> DataFrame:
    """Files (path, hash): the first path of a hash, by basename then path, is canonical, the others are duplicates."""
    return O.numbered(files, ["hash"], [T.basename(F.col("path")), "path"], "is_dup").withColumn("is_dup", F.col("is_dup") > 1)


def intake_manifest(files: DataFrame) -> DataFrame:
    """One row a hash: canonical path and the sorted other paths."""
    first = F.min(F.struct(T.basename(F.col("path")).alias("b"), F.col("path").alias("p")))["p"]
    df = files.groupBy("hash").agg(first.alias("source_path"), F.collect_set("path").alias("all"))
    return df.select("hash", "source_path", F.array_sort(F.array_except("all", F.array("source_path"))).alias("dup_paths"))


def manifest_pages(files: DataFrame, rows: int = O.PAGE_ROWS, page_bytes: int = O.PAGE_BYTES) -> DataFrame:
    """A13 for hashes of any number of paths (all empty files): (hash, page, source_path, dup_paths, n).

    Pages hold the other paths in order; the canonical path is the least of partial aggregates and stands on each page, and
    n counts a page's paths. A hash has at least one page, of no duplicates if its path is the only one.
    """
    paths = files.select("hash", "path").distinct()
    first = paths.groupBy("hash").agg(F.min(F.struct(T.basename(F.col("path")).alias("b"), F.col("path").alias("p")))["p"].alias("source_path"))
    pages = O.paged(paths, ["hash"], ["path"], ["path"], "_paths", F.octet_length("path"), rows, page_bytes)
    # a page a row here, so that no hash is hot in this join
    df = pages.join(first, "hash").select("hash", "page", "source_path", F.array_remove(F.col("_paths.path"), F.col("source_path")).alias("dup_paths"))
    return df.withColumn("n", F.size("dup_paths").cast("long")).filter("page = 0 OR n > 0")


def physical_paths(manifest: DataFrame) -> DataFrame:
    """U4: one row a path, canonical and duplicates."""
    return manifest.select("hash", F.explode(F.concat(F.array("source_path"), F.coalesce("dup_paths", F.array().cast("array<string>")))).alias("path"))


def triaged(files: DataFrame, prior: DataFrame) -> DataFrame:
    """Files (path, hash[, width, height]) with class, outcome, classified_type and status.

    prior: (hash, status) of earlier runs. Done ones are skipped (on the canonical path), failed ones are processed
    again; a further path of a hash in this run is a duplicate.
    """
    df = duplicates_marked(files).join(prior.groupBy("hash").agg(F.max(F.col("status") == "done").alias("done")), "hash", "left")
    kind = file_class(F.col("path"))
    shape = geometry_kind(F.col("width"), F.col("height")) if "width" in files.columns else geometry_kind(F.lit(None).cast("int"), F.lit(None).cast("int"))
    type_ = F.when(kind.isin("text", "extractable"), "text").when(kind == "image", classified_type(shape["kind"], F.lit("aspect-ratio"), shape["confidence"])).otherwise("unsure")
    outcome = F.when(F.col("is_dup"), "duplicate").when(F.coalesce("done", F.lit(False)), "skipped").when(kind == "unsupported", "failed").otherwise("processed")
    return df.withColumns({"class": kind, "outcome": outcome, "classified_type": type_, "status": F.when(kind == "unsupported", "failed").otherwise("done")}).drop("done")


def triage_summary(rows: DataFrame) -> DataFrame:
    """A10: one row of counts."""
    each = [F.count_if(F.col("outcome") == o).alias(o) for o in ("processed", "skipped", "duplicate", "failed")]
    types = [F.count_if(F.col("outcome").isin("processed", "duplicate") & (F.col("classified_type") == t)).alias("type_" + t.replace("-", "_")) for t in ("text", "doc-photo", "exhibit-photo", "unsure")]
    return rows.agg(F.count("*").alias("total"), *each, *types)


def ingest_summary(rows: DataFrame) -> DataFrame:
    """processed = success + failure, without duplicates and skips."""
    good, bad = F.count_if(F.col("outcome") == "processed"), F.count_if(F.col("outcome") == "failed")
    return rows.agg((good + bad).alias("total_processed"), good.alias("success"), bad.alias("failure"), F.count_if(F.col("outcome") == "duplicate").alias("duplicates"))


def latest_entries(events: DataFrame) -> DataFrame:
    """The last event of each (topic, hash) by ts, then event_id; tasks keep the last of their own before they meet."""
    others = [c for c in events.columns if c not in ("topic", "hash")]
    last = F.max_by(F.struct(*others), F.struct("ts", "event_id"))
    return events.groupBy("topic", "hash").agg(last.alias("_last")).select(*[f"_last.{c}" if c in others else c for c in events.columns])


def failed_entries(events: DataFrame) -> DataFrame:
    """What to retry: entries whose last status is failed."""
    return latest_entries(events).filter("status = 'failed'")


def to_ingest(files: DataFrame, manifest: DataFrame, force: bool = False) -> DataFrame:
    """Files that no done entry has; force takes all."""
    if force:
        return files
    return files.join(manifest.filter("status = 'done'").select("topic", "hash"), ["topic", "hash"], "left_anti")


def done_payloads(entries: DataFrame, payloads: DataFrame) -> DataFrame:
    """Done manifest entries with the payload of their hash (content_hash, ...); entries without one are skipped."""
    return entries.filter("status = 'done'").join(payloads.withColumnRenamed("content_hash", "hash"), "hash")
