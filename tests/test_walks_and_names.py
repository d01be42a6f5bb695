"""Walks through children, staged names, routing rules and anchors, and the lookups of claim matching."""

import json
import random
import re

from pyspark.sql import functions as F

from topicspark.functions import text as T
from topicspark.operators import matching as MA
from topicspark.operators import routing as RO
from topicspark.operators import tree as TR
from topicspark.plans import views as V
from topicspark.sources import readers as R

DATA = "/root/testdata/sf0.001"


def test_walk_follows_children(spark):
    nodes = spark.createDataFrame([("a", ["x", "z", "x", "", None, "q/r"]), ("a/x/y", []), ("a/z", ["w"]), ("a/z/w", ["v"]), ("a/z/w/v", None), ("a/z/u", ["t"]), ("a/z/u/t", []), ("a/q/r", ["s"]), ("a/q/r/s", [])], "path string, children array<string>")
    got = {(r.ancestor, r.descendant) for r in TR.closure(nodes, with_self=False).collect()}
    below_a = {"a/z", "a/z/w", "a/z/w/v", "a/q/r", "a/q/r/s"}
    assert got == {("a", x) for x in below_a} | {("a/z", "a/z/w"), ("a/z", "a/z/w/v"), ("a/z/w", "a/z/w/v"), ("a/z/u", "a/z/u/t"), ("a/q/r", "a/q/r/s")}
    assert TR.closure(nodes).count() == len(got) + 9
    assert [tuple(r) for r in TR.dangling_children(nodes).collect()] == [("a", "a/x")]
    assert TR.closure(nodes.filter("false")).count() == 0


def test_walk_is_logarithmic(spark):
    path = "/".join(["n"] * 20)
    nodes = TR.expanded(spark.createDataFrame([(path, [])], "path string, tags array<string>"))
    assert TR.closure(nodes).count() == 20 * 21 // 2


def names_in_order(files):
    """The fold itself, one topic after the other."""
    out, used = {}, {}
    for topic, path, hash_ in sorted(files):
        base = path.rsplit("/", 1)[-1]
        if base in used.setdefault(topic, set()):
            m = re.fullmatch(r"(.+?)(\.[^.]*)?", base)
            base = f"{m[1]}-{hash_[:8]}{m[2] or ''}"
        used[topic].add(base)
        out[topic, path] = base
    return out


def test_staged_names_are_a_fold(spark):
    rng = random.Random(2)
    files = [("t", "1/a.txt", "1" * 64), ("t", "2/a.txt", "2" * 64), ("t", "3/a-22222222.txt", "3" * 64), ("t", "4/a-22222222-33333333.txt", "4" * 64), ("u", "3/a-22222222.txt", "5" * 64)]
    for k in range(300):
        base = "b" + "".join(f"-{rng.choice('123') * 8}" for _ in range(rng.randint(0, 3))) + rng.choice([".txt", ""])
        files.append((rng.choice("tu"), f"{k:04d}/{base}", rng.choice("123") * 64))
    got = RO.staged_names(spark.createDataFrame(files, "topic string, path string, hash string")).collect()
    want = names_in_order(files)
    assert {(r.topic, r.path): r.name for r in got} == want and len(got) == len(files)
    assert [want["t", p] for p in ("1/a.txt", "2/a.txt", "3/a-22222222.txt")] == ["a.txt", "a-22222222.txt", "a-22222222-33333333.txt"]
    for r in got:
        assert r.clash == ([(t, n) for (t, _), n in want.items()].count((r.topic, r.name)) > 1)
    assert RO.staged_names(spark.createDataFrame([], "topic string, path string, hash string")).count() == 0


def test_dictionary_rules(spark, tmp_path):
    (tmp_path / "r.json").write_text(json.dumps({"a/b": ["x"], "a--b": ["y"], "Bad": ["z"], "none": [], "blank": ["  ", "ok"], "one": ["same key"], "two": ["Same_Key"]}))
    got = {tuple(r) for r in RO.routing_errors(R.read_routing(spark, str(tmp_path / "r.json"))).collect()}
    assert got == {("a/b", "invalid topic name"), ("Bad", "invalid topic name"), ("none", "no keywords"), ("blank", "blank keyword"), ("one", "keyword of two topics: same key"), ("two", "keyword of two topics: same key")}


def test_keywords_with_punctuation(spark):
    rng = random.Random(6)
    bits = ["c++", "c", "notes", "+", "#1", "a.b", "x", "(y)", "é", "über", "$", "..", "willow run"]
    words = lambda n: " ".join(rng.choice(bits) for _ in range(n)) if rng.random() < 0.7 else "".join(rng.choice(bits) for _ in range(n))
    keywords = sorted({words(rng.randint(1, 3)) for _ in range(120)})
    routing = spark.createDataFrame([(f"t{k % 9}", k % 9, w, k) for k, w in enumerate(keywords)], "topic string, topic_ord int, keyword string, keyword_ord int")
    paths = sorted({f"in/{words(rng.randint(1, 5))}.txt" for _ in range(200)})
    df = RO.classified(spark.createDataFrame([(p,) for p in paths], "path string"), routing)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    normal = lambda x: re.sub(r"\s+", " ", re.sub(r"[_\-/\\]", " ", x.lower())).strip()
    edge = lambda c, inside, outside: inside if re.match("[A-Za-z0-9_]", c) else outside
    hits = 0
    for r in df.collect():
        found = []
        for k, w in enumerate(keywords):
            n = normal(w)
            pattern = edge(n[0], "(?<![A-Za-z0-9_])", "(?<=[A-Za-z0-9_])") + re.escape(n) + edge(n[-1], "(?![A-Za-z0-9_])", "(?=[A-Za-z0-9_])")
            if re.search(pattern, normal(r.path)):
                found.append((n.count(" ") + 1, len(n), f"t{k % 9}"))
        best = {t for a, b, t in found if (a, b) == max(x[:2] for x in found)}
        assert (r.topic, r.ambiguous) == (next(iter(best)) if len(best) == 1 else None, len(best) > 1), r
        hits += bool(found)
    assert hits > 50


def test_few_claims_are_looked_up(spark, monkeypatch):
    looked = []
    plain = MA.candidates

    def counted(m, rows):
        looked.append(plain(m, rows).count())
        return plain(m, rows)

    monkeypatch.setattr(MA, "candidates", counted)
    facts, claims = V.sentences(spark, DATA), V.claims(spark, DATA)
    assert MA.match_claims(facts, claims, ["doc_id", "pos"]).count() > 0
    words = facts.select("text", "categories").distinct().select("text", "categories", F.explode(T.tokens(F.col("text"))).alias("e"))
    of = claims.select("id", F.explode(F.array_union("keywords", T.tokens(F.col("claim")))).alias("e"))
    pairs = words.join(of, "e").select("text", "categories", "id").distinct().count()
    assert 0 < sum(looked) < 0.6 * pairs, (looked, pairs)


def test_matching_edges(spark):
    claims = spark.createDataFrame([("V-1", "red blue", ["history"], ["red", "red", "Blue"]), ("V-2", None, ["history"], ["red"]), ("V-3", "", [], []), ("V-4", "red", None, None)], "id string, claim string, categories array<string>, keywords array<string>")
    facts = spark.createDataFrame([(1, "Red, blue!", ["history", "history"]), (2, None, ["history"]), (3, "", []), (4, "red", None), (4, "red", None)], "k int, text string, categories array<string>")
    got = sorted(tuple(r) for r in MA.match_claims(facts, claims, ["k"]).select("k", "id", "score", "rank").collect())
    assert got == [(1, "V-1", 0.8, 1), (1, "V-4", 0.15, 2), (4, "V-1", 0.3, 1), (4, "V-1", 0.3, 1), (4, "V-4", 0.3, 2), (4, "V-4", 0.3, 2)]
    assert MA.match_claims(facts.filter("false"), claims, ["k"]).count() == MA.match_claims(facts, claims.filter("false"), ["k"]).count() == 0
