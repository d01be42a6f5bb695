"""Recall of the pipeline's near-dedup at its threshold, measured on planted pairs."""

import random

from pyspark.sql import functions as F

from topicspark.llm import simhash


def test_recall_at_the_threshold(spark):
    """600 pairs of a five-word Jaccard similarity between 0.80 and 0.85, from 45 to 366 shingles, dealt over 16 tasks.

    A pair with t words changed, five words apart or more, out of s shingles has similarity (s - 5t) / (s + 5t).
    """
    rng, rows, pairs = random.Random(11), [], 600
    for pair in range(pairs):
        t = rng.randint(1, 6)
        s = rng.randint(45 * t, 61 * t)
        words = [f"w{rng.getrandbits(40):x}" for _ in range(s + 4)]
        other = list(words)
        for at in range(t):
            place = 4 + at * (s // t) + rng.randint(0, s // t - 6)
            other[place] = f"c{pair}x{at}"
        sets = [{tuple(x[k : k + 5]) for k in range(s)} for x in (words, other)]
        assert 0.8 <= len(sets[0] & sets[1]) / len(sets[0] | sets[1]) <= 0.86
        rows += [(2 * pair, " ".join(words)), (2 * pair + 1, " ".join(other))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(16, F.xxhash64("doc_id"))
    kept = {r.doc_id for r in simhash.simhash_stage(spark, docs, "").select("doc_id").collect()}
    found = sum(2 * pair + 1 not in kept for pair in range(pairs))
    assert all(2 * pair in kept for pair in range(pairs))
    print(f"recall {found / pairs:.3f}")
    assert found / pairs >= 0.95
