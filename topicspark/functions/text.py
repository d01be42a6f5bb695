"""Text, path, hash and JSON scalar functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as the data's producers see it: ASCII and the Unicode spaces.
SPACES = r"[\s\x0B   -     　﻿]"

#: The same characters, one by one.
SPACE_CHARS = "\t\n\x0b\x0c\r \u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"

# Words that carry no topic.
STOP_WORDS = (
    "a an and are as at be but by for from has have he her his i in is it its of on or she that the their they this to was were will with you your"
).split()

# HTML entities in the order in which they are decoded.
ENTITIES = [("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'")]


def trimmed(text: Column) -> Column:
    """Without white space at either end."""
    return F.btrim(text, F.lit(SPACE_CHARS))


def normalise_fact(text: Column) -> Column:
    """lower case, only a-z, 0-9 and single spaces."""
    bare = F.regexp_replace(F.lower(text), r"[^a-z0-9\s\x0B   -     　﻿]", "")
    return F.trim(F.regexp_replace(bare, f"{SPACES}+", " "))


def tokens(text: Column) -> Column:
    """the distinct words of the normalised text, in order, without stop words."""
    return tokens_of(normalise_fact(text))


def tokens_of(normal: Column) -> Column:
    """F2 of a text that is normalised already."""
    return F.array_except(F.split(normal, " "), F.array(*[F.lit(w) for w in [*STOP_WORDS, ""]]))


def fact_key(source_id: Column, text: Column) -> Column:
    """SHA-256 of source and normalised text; texts without a letter or digit keep their own trimmed form."""
    # a lambda over one element: the text is normalised once, whatever the optimizer does with the column
    own = F.transform(F.array(normalise_fact(text)), lambda normal: F.when(normal == "", trimmed(text)).otherwise(normal))
    return F.sha2(F.concat(source_id, F.lit("|"), F.get(own, F.lit(0))), 256)


def key_of(source_id: Column, normal: Column, text: Column) -> Column:
    """F3 of a text whose normalised form is a column already."""
    return F.sha2(F.concat(source_id, F.lit("|"), F.when(normal == "", trimmed(text)).otherwise(normal)), 256)


def jaccard(a: Column, b: Column) -> Column:
    """shared over all distinct elements; 0 if a side is empty."""
    shared = F.size(F.array_intersect(a, b)).cast("double")
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(shared / F.size(F.array_union(a, b)))


def round_half_up(x: Column, scale: int) -> Column:
    """floor(x * scale + 1/2) / scale on doubles."""
    return F.floor(x * F.lit(float(scale)) + F.lit(0.5)) / F.lit(float(scale))


def match_score(categories: Column, keywords: Column, words: Column, of_categories: Column, of_words: Column) -> Column:
    """0.4 category + 0.3 keyword + 0.3 claim overlap, to three places. Keywords are compared as they are."""
    score = F.lit(0.4) * jaccard(categories, of_categories) + F.lit(0.3) * jaccard(words, keywords) + F.lit(0.3) * jaccard(words, of_words)
    return round_half_up(score, 1000)


def match_bucket(score: Column) -> Column:
    """high from 0.6, medium from 0.3, low from 0.1 of the rounded score, else null."""
    return F.when(score >= 0.6, "high").when(score >= 0.3, "medium").when(score >= 0.1, "low")


def normalise_path(path: Column) -> Column:
    """lower case, separators as single spaces; other punctuation stays."""
    return F.trim(F.regexp_replace(F.translate(F.lower(path), "_-/\\", "    "), f"{SPACES}+", " "))


def contains_words(text: Column, needle: Column) -> Column:
    """needle stands in text between ASCII word boundaries.

    At a needle's edge that is itself a word character the neighbour must not be one; at another edge it must be.
    """
    escaped = F.regexp_replace(needle, r"([\\.*+?^${}()|\[\]])", r"\\$1")
    before = F.when(needle.rlike(r"^[A-Za-z0-9_]"), r"(?<![A-Za-z0-9_])").otherwise(r"(?<=[A-Za-z0-9_])")
    after = F.when(needle.rlike(r"[A-Za-z0-9_]$"), r"(?![A-Za-z0-9_])").otherwise(r"(?=[A-Za-z0-9_])")
    return F.regexp_like(text, F.concat(before, escaped, after))


def path_parts(path: Column) -> Column:
    return F.split(path, "/")


def valid_path(path: Column) -> Column:
    """F8: every segment is a slug: lower-case letters and digits in groups joined by single hyphens."""
    return F.forall(path_parts(path), lambda s: s.rlike(r"^[a-z0-9]+(-[a-z0-9]+)*$"))


def parent_path(path: Column) -> Column:
    parts = path_parts(path)
    return F.when(F.size(parts) > 1, F.array_join(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), "/"))


def leaf(path: Column) -> Column:
    return F.element_at(path_parts(path), -1)


def node_type(path: Column) -> Column:
    """project, topic or subtopic by depth."""
    depth = F.size(path_parts(path))
    return F.when(depth == 1, "project").when(depth == 2, "topic").otherwise("subtopic")


def topic_slug(path: Column) -> Column:
    return F.replace(path, F.lit("/"), F.lit("-"))


def version_bump(version: Column, part: str) -> Column:
    """the next major, minor or patch version."""
    n = [F.element_at(F.split(version, r"\."), k).cast("int") for k in (1, 2, 3)]
    chosen = {"major": [n[0] + 1, F.lit(0), F.lit(0)], "minor": [n[0], n[1] + 1, F.lit(0)], "patch": [n[0], n[1], n[2] + 1]}[part]
    return F.concat_ws(".", *[c.cast("string") for c in chosen])


def canonical_json(**fields: Column) -> Column:
    """JSON with keys in order; doubles must come formatted."""
    return F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)]))


def chained_hash(previous: Column, payload: Column) -> Column:
    """SHA-256 of the previous hash and the canonical payload."""
    return F.sha2(F.concat(previous, payload), 256)


def content_hash(content: Column) -> Column:
    """F12."""
    return F.sha2(content.cast("binary"), 256)


def html_text(html: Column) -> Column:
    """scripts dropped, tags as spaces, six entities in order, white space tidied."""
    t = F.regexp_replace(html, r"(?is)<script\b[^>]*>.*?</script>", " ")
    t = F.regexp_replace(t, r"<[^>]*>", " ")
    for name, char in ENTITIES:
        t = F.replace(t, F.lit(name), F.lit(char))
    t = F.regexp_replace(F.regexp_replace(t, r"[ \t]+", " "), r"[ \t]*\n[ \t]*", "\n")
    return trimmed(F.regexp_replace(t, r"\n{3,}", "\n\n"))


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def extension(path: Column) -> Column:
    """lower case, with its dot; empty without one or for a name that starts with its only dot."""
    return F.lower(F.regexp_extract(basename(path), r"^.+(\.[^.]*)$", 1))


def stem(path: Column) -> Column:
    name = basename(path)
    return F.substring(name, F.lit(1), F.length(name) - F.length(extension(path)))


def batch_of(path: Column, root: str = "intake") -> Column:
    """the first segment under the intake root."""
    return F.element_at(F.split(F.substring(path, len(root) + 2, 1 << 20), "/"), 1)


def escape_html(text: Column) -> Column:
    """five characters, & first."""
    for char, name in [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")]:
        text = F.replace(text, F.lit(char), F.lit(name))
    return text


def escape_inline(text: Column) -> Column:
    """pipes and backticks with a backslash."""
    return F.regexp_replace(text, r"([|`])", r"\\$1")


def indent_block(text: Column) -> Column:
    """F16: every line four spaces in."""
    return F.array_join(F.transform(F.split(text, "\n", -1), lambda x: F.concat(F.lit("    "), x)), "\n")


def compact_timestamp(ts: Column) -> Column:
    """F16: 2026-01-02T03:04:05.678Z as 20260102T030405."""
    return F.substring(F.regexp_replace(ts, r"[-:]", ""), 1, 15)


def clock(ms: Column) -> Column:
    """mm:ss, minutes unbounded."""
    seconds = F.floor(ms / F.lit(1000))
    return F.format_string("%02d:%02d", F.floor(seconds / 60), seconds % 60)


def frame_times(duration_ms: Column, frames: Column, most: int = 30) -> Column:
    """times of so many frames: the midpoint of a clip under 10 s, every 10 s under 300 s, else every 1 / most of it."""
    half = duration_ms.cast("double") / 2
    step = F.when(duration_ms < 300000, F.lit(10000.0)).otherwise(duration_ms.cast("double") / most)
    at = F.transform(F.sequence(F.lit(0), F.greatest(frames, F.lit(1)).cast("int") - 1), lambda k: F.when(duration_ms < 10000, half).otherwise(k * step))
    return F.slice(at, F.lit(1), frames.cast("int"))


def transcript_status(has_audio: Column, transcript: Column) -> Column:
    """F20."""
    return F.when(~has_audio, "no-audio").when(trimmed(F.coalesce(transcript, F.lit(""))) != "", "transcribed").otherwise("empty")


def image_format(content: Column) -> Column:
    """jpeg, png, gif or webp by the first bytes, else null."""
    head = F.hex(F.substring(content, 1, 12))
    return F.when(head.startswith("FFD8FF"), "jpeg").when(head.startswith("89504E47"), "png").when(head.startswith("474946"), "gif").when(head.startswith("52494646") & (F.substring(head, 17, 8) == "57454250"), "webp")


def png_size(content: Column) -> Column:
    """Width and height of a PNG (null if it isn't one)."""
    number = lambda at: F.conv(F.hex(F.substring(content, at, 4)), 16, 10).cast("long")
    return F.when(image_format(content) == "png", F.struct(number(17).alias("width"), number(21).alias("height")))
