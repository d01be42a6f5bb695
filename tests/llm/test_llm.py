"""The training-data operators against brute force, over small tables with nulls, empty and long texts, ties and repeats."""

import base64
import hashlib
import math
import random
import re
import time
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from topicspark.llm import bpe, common, crf, ctw, embeddings, line_dedup, mixing, quality_rules, simhash, substrings, warc

DATA = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def make(spark, rows):
    return spark.createDataFrame([(d, t, "en", s, len(t or "")) for d, t, s in rows], DOCS)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    words = "the of and Fleet bomber, San diego é### über 12 %%% x".split()
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 90))) for _ in range(40)]
    texts = [t.replace(" and ", "\n") if k % 2 else t for k, t in enumerate(texts)]
    copies = [texts[k] for k in (3, 3, 5, 7)] + [texts[5] + " tail", "lead " + texts[9], None, None, "", "a", "\x0b\t  ", "w" * 3000, ("long " * 4000).strip()]
    out = [(k, t, rng.choice(["s1", "s2", "s3", None])) for k, t in enumerate(texts + copies)]
    return out + [out[0], (None, texts[4], "s1")]


def parquet(tmp_path_factory, spark, **tables):
    path = tmp_path_factory.mktemp("data")
    for name, df in tables.items():
        df.coalesce(1).write.parquet(f"{path}/{name}.parquet")
    return str(path)


def words_of(text, lower=False):
    b = (text or "").encode()
    if lower:
        b = bytes(c + 32 if 65 <= c <= 90 else c for c in b)
    return re.findall(rb"[^\x20\x09-\x0D]+", b)


@pytest.mark.parametrize("orders, target", [((1, 2), True), ((1,), True), ((2,), True), ((1, 2), False)])
def test_quality_rules(spark, rows, orders, target):
    docs = make(spark, rows).withColumn("trusted", (F.col("doc_id") % 2 == 0) & F.lit(target))
    has_target, got = target, {}
    for r in quality_rules.quality_rules(docs, orders=orders, buckets=64, least_ratio=-0.1).collect():
        got.setdefault(r.doc_id, r)
    raw, target = np.zeros(64), np.zeros(64)

    def buckets(t):
        h = [xxhash.xxh64_intdigest(w, 42) for w in words_of(t)]
        pairs = [xxhash.xxh64_intdigest(b.to_bytes(8, "little"), xxhash.xxh64_intdigest(a.to_bytes(8, "little"), 42)) for a, b in zip(h, h[1:], strict=False)]
        return [((x + 2**63) % 2**64 - 2**63) % 64 for n in orders for x in (h if n == 1 else pairs)]

    for d, t, _ in rows:
        for b in buckets(t):
            raw[b] += 1
            target[b] += has_target and d is not None and d % 2 == 0
    weight = np.log((target + 5) / (raw * target.sum() / raw.sum() + 5))
    for d, t, _ in rows:
        w, r = words_of(t), got[d]
        seen = {}
        for k in range(len(w) - 7):
            seen.setdefault(tuple(w[k : k + 8]), []).append(k)
        cover = {p for at in seen.values() if len(at) > 1 for k in at for p in range(k, k + 8)}
        lines = [x for x in (t or "").split("\n") if words_of(x)]
        ratio = float(np.mean([weight[b] for b in buckets(t)])) if buckets(t) else 0.0
        assert (r.n_words, r.word_chars, r.n_symbols) == (len(w), sum(len(x.decode()) for x in w), sum(c in "#*$%&|<>" for c in t or ""))
        assert (r.n_dup_lines, r.n_repeat_words) == (len(lines) - len(set(lines)), len(cover))
        assert r.ratio == pytest.approx(ratio, abs=1e-9)
        assert r.base_failed == (len(w) < 20 or 100 * len(cover) > 30 * len(w)) and r.kept == (not r.base_failed and ratio >= -0.1)


@pytest.mark.parametrize("name, view", [("op7_mixing", mixing), ("op5_warc", warc), ("op2_embeddings", embeddings)])
def test_sql(spark, name, view):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    sql = getattr(view, name.split("_")[0].upper() + "_SQL")
    df = getattr(view, name)(spark, DATA)
    want = con.execute(f"SELECT {', '.join(df.columns)} FROM ({sql})").fetchall()
    assert sorted(map(str, map(tuple, df.collect()))) == sorted(map(str, want))


def test_mixing(spark, rows):
    docs = make(spark, rows)
    sizes = docs.select("doc_id", "source", mixing.word_count(F.col("text")).alias("size"))
    out = mixing.with_copies(sizes, mixing.mixture(sizes), "doc_id", "source").collect()
    assert len(out) == len(rows)
    by = {}
    for r in out:
        assert r["size"] == len(words_of(dict((d, t) for d, t, _ in rows)[r.doc_id])) and 0 <= r.copies <= 2
        v = by.setdefault(r.source, [0, r.target, r.source_size, 0])
        v[0] += r["size"] * r.copies
        v[3] = max(v[3], r["size"])
    total = sum(v[2] for v in by.values())
    assert sum(v[1] for v in by.values()) == pytest.approx(1.5 * total)
    for taken, target, size, most in by.values():
        assert target <= 2 * size and abs(taken - target) <= most
    assert mixing.mixture(sizes.filter("false")).count() == 0


def test_bpe(spark, rows, tmp_path):
    tiktoken, P = pytest.importorskip("tiktoken"), pytest.importorskip("public_tokenizers")
    path = P.path("byte_bpe_50k.tiktoken")
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    extra = [(900, "it's  12345 <|endoftext|> \x1c\x85 x 漢字 🙂 \r\n\n  end ", "s"), (901, "ab" * 700, "s")]
    docs = make(spark, rows + extra).withColumn("ids", F.lit(1))
    out = bpe.bpe_decode(bpe.bpe_encode(docs, path, P.PATTERN), path, P.PATTERN).collect()
    assert len(out) == len(rows) + len(extra)
    for r in out:
        assert list(r.ids) == enc.encode_ordinary(r.text or "") and bytes(r.decoded) == (r.text or "").encode()
    with pytest.raises(Exception, match="vocabulary"):
        bpe.bpe_decode(spark.sql("SELECT array(999999) AS ids"), path, P.PATTERN).collect()


def test_bpe_known_pieces():
    """Texts are gathered from the ids of known pieces, and a piece is merged once, also over several calls."""
    tokens = [bytes([b]) for b in range(256)] + [b"ab", b"abab", b"ba", b" a", b"bb", b" ab"]
    ranks = bpe.Ranks(b"\n".join(base64.b64encode(t) + b" %d" % k for k, t in enumerate(tokens)), r" ?\w+|\s+|[^\w\s]+")

    def brute(piece):
        ids = [bytes([b]) for b in piece.encode()]
        while pairs := [(tokens.index(a + b), k) for k, (a, b) in enumerate(zip(ids, ids[1:], strict=False)) if a + b in tokens]:
            k = min(pairs)[1]
            ids[k : k + 2] = [ids[k] + ids[k + 1]]
        return [tokens.index(t) for t in ids]

    rng, known, merged, merge = random.Random(2), bpe.Known(), [], ranks.merge
    ranks.merge = lambda pieces: merged.extend(pieces) or merge(pieces)
    texts = ["", "ab", " "] + ["".join(rng.choice("aabbb  é,") for _ in range(rng.randint(0, 60))) for _ in range(200)]
    for part in (texts[:90], texts[60:], [""], [], texts):
        ids, sizes = ranks.encode(part, known)
        assert sizes.tolist() == [sum(len(brute(p)) for p in ranks.pieces(t)) for t in part]
        assert ids.tolist() == [x for t in part for p in ranks.pieces(t) for x in brute(p)]
    assert len(merged) == len(set(merged)) == len(known.place) > 100


def components(n, links):
    at = list(range(n))

    def find(k):
        while at[k] != k:
            k = at[k]
        return k

    for a, b in links:
        a, b = find(a), find(b)
        at[max(a, b)] = min(a, b)
    return [find(k) for k in range(n)]


def test_components(spark):
    rng = random.Random(1)
    edges = [(k, k + 1) for k in range(40)] + [(100, 100 + k) for k in range(1, 30)] + [(rng.randrange(200, 300), rng.randrange(200, 300)) for _ in range(70)] + [(7, 7)]
    want = components(301, edges)
    got = {r.node: r.component for r in common.components(spark.createDataFrame(edges + edges[:5], "a long, b long")).collect()}
    assert all(got.get(k, k) == want[k] for k in range(301))
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_fingerprint_links(spark):
    rng = random.Random(2)
    fps = [rng.getrandbits(64) for _ in range(40)]
    fps += [f ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for f in fps for _ in range(4)] + [0]
    fps += [fps[0] ^ (1 << k) for k in range(40)]
    fps = sorted(set(fps))
    want = components(len(fps), [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 2])
    signed = [f - 2**64 if f >= 2**63 else f for f in fps]
    for limit in (4, 1000):
        edges = simhash.fingerprint_links(spark.createDataFrame([(f,) for f in signed], "fp long"), limit=limit).collect()
        assert components(len(fps), [(signed.index(r.a), signed.index(r.b)) for r in edges]) == want


def test_simhash(spark, rows):
    def fp(t):
        w = words_of(t, lower=True)
        grams = [b" ".join(w[k : k + 3]) for k in range(max(1, len(w) - 2))] if w else []
        h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    named = [(d, fp(t)) for d, t, _ in rows]
    got = simhash.near_duplicates(make(spark, rows)).collect()
    assert sorted((str(r.doc_id), r.fp % 2**64) for r in got) == sorted((str(d), f) for d, f in named)
    want = components(len(named), [(i, j) for i in range(len(named)) for j in range(i) if (named[i][1] ^ named[j][1]).bit_count() <= 2])
    least = {}
    for (d, _), c in zip(named, want, strict=True):
        if d is not None:
            least[c] = min(d, least.get(c, d))
    assert sorted((str(r.doc_id), str(r.component_id)) for r in got) == sorted((str(d), str(least.get(c))) for (d, _), c in zip(named, want, strict=True))


def test_near_dedup(spark):
    """Near copies of 0.8 and more of five-word shingles leave the pipeline's stage, by exact sets, whatever the blocks' size."""
    import corpus_pipeline

    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(5))
    base = [[word() for _ in range(rng.randint(60, 200))] for _ in range(14)]
    rows = [(k, " ".join(w)) for k, w in enumerate(base)]
    for k in range(70):
        w = list(base[k % 7 if k < 40 else 0])
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(len(w))] = word()
        rows.append((100 + k, " ".join(w)))
    rows += [(200, "a b c"), (201, "A  b\nc"), (202, "a b d"), (203, ""), (204, None), (13, " ".join(base[1][:30])), (13, " ".join(base[13])), (None, rows[0][1])]
    found = [set(map(int, simhash.shingles((t or "").encode(), 5))) for _, t in rows]
    assert found[0] == {xxhash.xxh64_intdigest(" ".join(base[0][k : k + 5]).encode(), 42) for k in range(len(base[0]) - 4)}
    want = components(len(rows), [(i, j) for i in range(len(rows)) for j in range(i) if found[i] == found[j] or len(found[i] & found[j]) / len(found[i] | found[j]) >= 0.8])
    least = {}
    for (d, _), c in zip(rows, want, strict=True):
        if d is not None:
            least[c] = min(d, least.get(c, d))
    assert len(least) < len(rows) - 30
    df = spark.createDataFrame(rows, "doc_id long, text string")
    stage = dict(corpus_pipeline.STAGES)["simhash near-dedup"]
    for out in (stage(spark, df, ""), simhash.similar_documents(df, limit=4)):
        assert sorted(str(r.doc_id) for r in out.collect()) == sorted([*map(str, least.values()), "None"])


def edit(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_edit_distance_and_keys():
    rng = random.Random(1)
    a = ["".join(rng.choice("abé") for _ in range(rng.randint(0, 9))) for _ in range(800)]
    b = []
    for x in a:
        y = list(x)
        for _ in range(rng.randint(0, 4)):
            k = rng.randint(0, len(y))
            y[k : k + rng.randint(0, 1)] = [rng.choice("abé")] * rng.randint(0, 1)
        b.append("".join(y))
    for k in (1, 2, 3):
        assert line_dedup.within(a, b, k).tolist() == [edit(x, y) <= k for x, y in zip(a, b, strict=True)]
        for x, y in zip(a, b, strict=True):
            if len(x) > k and len(y) > k and edit(x, y) <= k:
                keys = line_dedup.segment_keys([x, y], k)
                assert set(keys[0]) & set(keys[1])


@pytest.mark.parametrize("limit", [4, 512])
def test_line_dedup(spark, limit):
    rng = random.Random(1)
    base = ["".join(rng.choice("abcdefgh ") for _ in range(rng.randint(28, 60))) for _ in range(25)]
    rows = []
    for d in range(60):
        lines = []
        for _ in range(rng.randint(0, 5)):
            y = list(rng.choice(base))
            for _ in range(rng.randint(0, 3)):
                y[rng.randrange(len(y))] = rng.choice("abc")
            lines.append("".join(y))
        rows.append((d, "\n".join(lines) if d % 20 else None))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.lines for r in line_dedup.repeated_lines(df, limit=limit).collect()}
    all_ = [(d, i, x) for d, t in rows if t is not None for i, x in enumerate(t.split("\n")) if len(x) >= 30]
    want = {}
    for d, i, x in all_:
        if any((e, j) < (d, i) and edit(x, y) <= 2 for e, j, y in all_):
            want.setdefault(d, []).append(i)
    assert got == want
    out = {r.doc_id: r for r in line_dedup.without_lines(df, line_dedup.repeated_lines(df)).collect()}
    for d, t in rows:
        assert out[d].text == (None if t is None else "\n".join(x for i, x in enumerate(t.split("\n")) if i not in want.get(d, [])))


def test_line_dedup_rows_apart(spark, tmp_path):
    """Null and repeated ids: only a row's own repeats go, and equal lines of two such rows count as repeats."""
    line = lambda k: f"line number {k} " + chr(97 + k) * 30
    rows = [(1, [line(0), line(1)]), (None, [line(2), line(0), line(3)]), (None, [line(4), line(5), line(6)]), (9, [line(7), line(1)]), (9, [line(8), line(9)]), (None, [line(10), line(11)]), (None, [line(10), line(12)])]
    df = spark.createDataFrame([(d, "\n".join(x)) for d, x in rows], "doc_id long, text string")
    df.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    read = spark.read.parquet(f"{tmp_path}/documents.parquet")
    assert "_metadata" in common.with_row(read, "row")._jdf.queryExecution().analyzed().toString()
    for docs in (df, read):
        out = [(r.doc_id, r.text) for r in line_dedup.line_dedup_stage(spark, docs, "").collect()]
        kept = sorted(x for _, t in out for x in t.split("\n"))
        assert kept == sorted(map(line, range(13)))
        assert (9, line(7)) in out and (9, "\n".join(map(line, (8, 9)))) in out and (None, "\n".join(map(line, (4, 5, 6)))) in out
    assert sorted(r.n_removed for r in line_dedup.op3_line_dedup(spark, str(tmp_path)).collect()) == [0, 0, 0, 0, 1, 1, 1]


def test_short_lines(spark, tmp_path):
    """Short lines go as exact repeats, but not for being near; blank lines stay."""
    own = [f"own line {k} of this document " + chr(97 + k) * 9 for k in range(4)]
    rows = [(1, f"{own[0]}\nAll rights reserved.\n\n ok"), (2, f"All rights reserved.\n\n{own[1]}\n ok"), (3, f"All rights reserved!\n{own[2]}\n}}"), (4, "All rights reserved.\n\n}"), (None, f"{own[3]}\n}}")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = {r.doc_id: r.text for r in line_dedup.line_dedup_stage(spark, docs, "").collect()}
    assert out == {1: rows[0][1], 2: f"\n{own[1]}", 3: rows[2][1], None: own[3]}
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.n_lines, r.n_removed) for r in line_dedup.op3_line_dedup(spark, str(tmp_path)).collect()}
    assert got == {1: (4, 0), 2: (4, 2), 3: (3, 0), 4: (3, 2), None: (2, 1)}


def test_warc(spark, tmp_path):
    pages = [(1, "u", "x" * 90000), (2, "v v", "x" * 90000), (3, None, None), (None, "q", "y" * 2000), (2, "v", "x" * 90000), (7, "z", "é" * 30000), (8, "z", "y" * 999), (9, "z", "y" * 999)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    folder = f"file://{tmp_path}/warc"
    back = warc.read_warc(spark, folder, warc.write_warc(df, folder)).collect()
    got = sorted((str(r.page_id), r.type, str(r.refers_to), None if r.payload is None else bytes(r.payload)) for r in back)
    want = [(str(p), "response" if p != 1 else "revisit", "2" if p == 1 else "None", (h or "").encode() if p != 1 else None) for p, _, h in pages]
    assert got == sorted(want)
    assert warc.dechunked(warc.chunked(b"z" * 20000)) == b"z" * 20000
    with pytest.raises(ValueError):
        warc.dechunked(b"5\r\nab")
    one = warc.member([("WARC-Type", "response"), ("WARC-Record-ID", "<1>")], b"x" * 90000)
    assert [r["block"] for r in warc.parsed(one * 3)] == [b"x" * 90000] * 3
    with pytest.raises(ValueError):
        list(warc.parsed(one + one[:-3]))


def test_warc_edges(spark, tmp_path):
    """A hot payload and an empty table, through the query; twice as many records take about twice as long to parse."""
    pages = [(k, "u", "hot " * 400) for k in range(3000)] + [(None, "u", "hot " * 400), (4000, None, None), (4001, "u", "é" * 600)]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r.page_id: r for r in warc.op5_warc(spark, str(tmp_path)).collect()}
    assert len(got) == len(pages) and all((got[k].record_type, got[k].refers_to, got[k].payload_bytes) == ("revisit", 2999, 1600) for k in range(2999))
    assert got[2999].record_type == got[None].record_type == "response" and got[4000].payload_digest == hashlib.sha1(b"").hexdigest()
    assert (got[4001].payload_bytes, got[4001].payload_digest) == (1200, hashlib.sha1("é".encode() * 600).hexdigest())
    spark.createDataFrame([], "page_id long, url string, html string").write.parquet(f"{tmp_path}/none/pages.parquet")
    assert warc.op5_warc(spark, f"{tmp_path}/none").count() == 0
    seconds = []
    for n in (4000, 8000):
        archive = b"".join(warc.member([("WARC-Type", "response"), ("WARC-Record-ID", f"<{k}>")], b"line %d " % k * 150) for k in range(n))
        began = time.process_time()
        assert sum(1 for _ in warc.parsed(archive)) == n
        seconds.append(time.process_time() - began)
    assert seconds[1] < 3.5 * seconds[0]


def test_ctw_tables(monkeypatch):
    """Keys that come again are looked up, not sorted again; every key is found, also where many share a slot."""
    monkeypatch.setattr(ctw, "WAITING", 50)
    sizes, merged = [], ctw.merged
    monkeypatch.setattr(ctw, "merged", lambda found: sizes.append(sum(len(k) for k, _ in found)) or merged(found))
    rng, want, tally = np.random.default_rng(3), Counter(), ctw.Tally()
    for _ in range(200):
        keys, n = np.unique(rng.integers(-60, 60, 90) * 2**40, return_counts=True)
        tally.add(keys, n)
        want.update(dict(zip(keys.tolist(), n.tolist(), strict=True)))
    tally.settle()
    assert dict(zip(tally.keys.tolist(), tally.n.tolist(), strict=True)) == want and (np.diff(tally.keys) > 0).all()
    assert sum(sizes) <= 5 * len(want)  # the 200 parts have more than a hundred times that
    keys = np.concatenate([rng.integers(0, 2**48, 5000), np.arange(300), -1 - np.arange(300) * 2**50, [2**48 - 1]])
    found = ctw.Lookup(keys, np.arange(len(keys)) / 3)
    some = rng.permutation(np.arange(len(keys)))
    assert (found.find(keys[some]) == some / 3).all() and not len(found.find(keys[:0]))
    with pytest.raises(KeyError):
        found.find(np.array([keys[0], 2**50]))
    assert not len(ctw.Lookup(keys[:0], np.zeros(0)).find(keys[:0]))


def test_ctw(spark, monkeypatch, rows):
    monkeypatch.setattr(ctw, "CHUNK", 4000)
    some = [(d, t if t is None else t[:120], s) for d, t, s in rows]
    got = ctw.ctw_scores(make(spark, some), depth=2).collect()
    texts = {d: bytes(c + 32 if 65 <= c <= 90 else c for c in (t or "").encode()) for d, t, _ in some}
    learn = [(d, texts[d]) for d, _, _ in some if ctw.trains(d, 7, 2)]
    counts, kids = {}, {}
    for _, t in learn:
        s = b"\xfe\xfe" + t + b"\xff"
        for e in range(2, len(s)):
            for depth in range(3):
                context, node = s[e - depth : e], 1
                for k in range(7, -1, -1):
                    bit = s[e] >> k & 1
                    counts.setdefault((context, node), [0, 0])[bit] += 1
                    if depth:
                        kids.setdefault((context[1:], node), set()).add(context)
                    node = 2 * node + bit
    lg = math.lgamma
    kt = lambda a, b: lg(a + 0.5) + lg(b + 0.5) - lg(a + b + 1) - math.log(math.pi)
    memo = {}

    def weighted(context, node):
        if (context, node) not in memo:
            own = kt(*counts[context, node])
            if len(context) == 2:
                memo[context, node] = own
            else:
                below = sum(weighted(c, node) for c in kids[context, node])
                memo[context, node] = math.log(0.5) + max(own, below) + math.log(math.exp(own - max(own, below)) + math.exp(below - max(own, below)))
        return memo[context, node]

    def predict(context, node, depth=0):
        c = context[len(context) - depth :]
        if (c, node) not in counts:
            return None
        zero, ones = counts[c, node]
        own = (ones + 0.5) / (zero + ones + 1)
        longer = predict(context, node, depth + 1) if depth < 2 else None
        if longer is None:
            return own
        stop = math.exp(math.log(0.5) + kt(zero, ones) - weighted(c, node))
        return stop * own + (1 - stop) * longer

    for r in got[:12]:
        s, total = b"\xfe\xfe" + texts[r.doc_id] + b"\xff", 0.0
        for e in range(2, len(s)):
            node = 1
            for k in range(7, -1, -1):
                bit, p = s[e] >> k & 1, predict(s[e - 2 : e], node)
                p = 0.5 if p is None else p
                total += math.log10(p if bit else 1 - p)
                node = 2 * node + bit
        assert r.score == pytest.approx(total, rel=1e-6)
    c, n = {}, 0
    for _, t in learn:
        for w in [*t.split(), None]:
            c[w], n = c.get(w, 0) + 1, n + 1
    for r in got:
        w = [*texts[r.doc_id].split(), None]
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (len(w), sum(x in c for x in w), n, not ctw.trains(r.doc_id, 7, 2))
        assert r.base_score == pytest.approx(sum(math.log10((c.get(x, 0) + 1) / (n + len(c) + 1)) for x in w))
    assert len(got) == len(rows)


def test_substrings(spark, monkeypatch, rows):
    monkeypatch.setattr(substrings, "CHUNK", 30_000)
    monkeypatch.setattr(substrings, "BUCKET", 40_000)
    monkeypatch.setattr(substrings, "PART", 3_000)
    monkeypatch.setattr(substrings, "WINDOWS", 500)
    rows = [r for r in rows if r[0] is not None]
    got = {r.doc_id: r for r in substrings.substring_dedup(make(spark, rows)).collect()}
    data = {d: (t or "").encode() for d, t, _ in rows}
    first = {}
    for d in sorted(data):
        for k in range(len(data[d]) - 49):
            first.setdefault(data[d][k : k + 50], d)
    for d, b in data.items():
        mask = np.zeros(len(b), dtype=bool)
        for k in range(len(b) - 49):
            if first[b[k : k + 50]] < d:
                mask[k : k + 50] = True
        kept = np.frombuffer(b, dtype=np.uint8)[~mask].tobytes()
        r = got[d]
        assert (r.n_bytes, r.n_removed, bytes(r.kept)) == (len(b), int(mask.sum()), kept)
        assert r.n_spans == int((np.diff(mask.astype(int), prepend=0) == 1).sum())


def test_substrings_rows_apart(spark, monkeypatch, tmp_path):
    """Null and repeated ids with different texts: each row is judged by its own text, read from files or not."""
    monkeypatch.setattr(substrings, "CHUNK", 3_000)
    rng = random.Random(6)
    text = lambda n: "".join(rng.choice("abcdefghijklmnop ") for _ in range(n))
    base = [text(200) for _ in range(6)]
    rows = [(k, t) for k, t in enumerate(base)] + [(None, base[0]), (None, text(150)), (None, text(40) + base[1][:80]), (None, text(60)), (None, None)]
    rows += [(7, base[2]), (7, text(300)), (7, base[3][20:90] + text(9)), (8, text(90) + base[4][100:]), (8, text(70)), (None, base[0]), (0, text(80))]
    big = 2**63 - 1
    first = {}
    for d, t in rows:
        b = (t or "").encode()
        for k in range(len(b) - 49):
            first[b[k : k + 50]] = min(first.get(b[k : k + 50], big), big if d is None else d)
    want = []
    for d, t in rows:
        b = (t or "").encode()
        mask = np.zeros(len(b), dtype=bool)
        for k in range(len(b) - 49):
            mask[k : k + 50] |= first[b[k : k + 50]] < (big if d is None else d)
        want.append((str(d), len(b), int(mask.sum()), np.frombuffer(b, dtype=np.uint8)[~mask].tobytes()))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    df.repartition(3).write.parquet(f"{tmp_path}/docs")
    for docs in (df, spark.read.parquet(f"{tmp_path}/docs")):
        got = substrings.substring_dedup(docs).collect()
        assert sorted((str(r.doc_id), r.n_bytes, r.n_removed, bytes(r.kept)) for r in got) == sorted(want)


def test_embeddings(spark):
    rng = np.random.default_rng(4)
    base = rng.standard_normal((12, 16))
    x = np.concatenate([base, base + 0.25 * rng.standard_normal((12, 16)), np.repeat(base[:1], 30, axis=0) + 0.1 * rng.standard_normal((30, 16)), base[:2]])
    far = rng.standard_normal((60, 16)) * np.append([9.0] * 3, [1.0] * 13)  # cut into cells
    turned = np.concatenate([far, far + 0.3 * rng.standard_normal((60, 16))]) @ embeddings.rotation(16).T
    x = np.concatenate([x, turned])
    x[40] = x[41] * 2
    rows = [(k, [float(v) for v in row]) for k, row in enumerate(x)]
    rows += [(900, None), (901, [0.0] * 16), (902, [float("nan")] * 16), (903, [1.0, None] * 8), (904, []), (905, [1.0] * 3), (None, None)]
    rows += [(906, [1e200, 1e199]), (907, [1e200, 1e199]), (908, [1e-200, 0.0]), (909, [2e-200, 0.0]), (910, [0.0, -1.0]), (910, [0.0, -3.0]), (None, [0.01, -3.0])]
    u = x / np.sqrt((x * x).sum(axis=1))[:, None]
    near = (u @ u.T >= 0.9) & ~np.eye(len(x), dtype=bool)
    comp = components(len(x), list(zip(*np.nonzero(near), strict=True)))
    for limit, blocks in ((8, 4), (20000, None), (30, 3)):
        out = embeddings.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), limit=limit, blocks=blocks).collect()
        got = {r.vec_id: r for r in out}
        assert len(out) == len(rows)
        for k in range(len(x)):
            assert (got[k].n_links, got[k].component_id, got[k].kept) == (int(near[k].sum()), comp[k], comp[k] == k)
        assert all((got[k].n_links, got[k].component_id) == (0, k) for k in range(900, 906))
        assert sorted((str(r.vec_id), r.n_links, r.component_id, r.kept) for r in out if r.vec_id is None or r.vec_id > 905) == sorted(
            [(str(k), n, c, k == c) for k, n, c in ((906, 3, 906), (907, 3, 906), (908, 3, 906), (909, 3, 906), (910, 2, 910), (910, 2, 910))] + [("None", 2, 910, False), ("None", 0, None, True)]
        )
    assert embeddings.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_embeddings_wide(spark):
    """64 coordinates, several parts, a hot cluster, copies and planted links, over cut and uncut blocks."""
    rng = np.random.default_rng(5)
    base = rng.standard_normal((400, 64))
    hot = base[:1] + 0.25 * rng.standard_normal((300, 64))
    x = np.concatenate([base, base[:200] + 0.4 * rng.standard_normal((200, 64)), hot, np.repeat(base[7:8], 90, axis=0)]).astype(np.float32).astype(np.float64)
    u = x / np.sqrt((x * x).sum(axis=1))[:, None]
    near = (u @ u.T >= 0.9) & ~np.eye(len(x), dtype=bool)
    assert near.sum() > 50_000
    comp = components(len(x), list(zip(*np.nonzero(near), strict=True)))
    df = spark.createDataFrame([(k, [float(v) for v in row]) for k, row in enumerate(x)], "vec_id long, embedding array<float>")
    out = embeddings.near_vectors(df, limit=150).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in out) == [(k, int(near[k].sum()), comp[k], comp[k] == k) for k in range(len(x))]


def test_crf(spark):
    rng = random.Random(5)
    rows, labels = [], []
    for d in range(240):
        good = d % 4 > 0
        lines = [" ".join(rng.choice(["river", "stone", "light", "walk"]) + ("" if good else "%%% ###") for _ in range(8)) + "." for _ in range(rng.randint(1, 6))]
        rows.append((d, "\n".join(lines), "s"))
        labels.append((d, int(good), 0))
    rows += [(900, None, "s"), (901, "", "s")]
    out = crf.quality_scores(make(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    assert len(out) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in out)
    held = [r for r in out if r.held_out and r.doc_id < 900]
    assert held and [r for r in held if r.predicted != int(r.doc_id % 4 > 0)] == []


def plain_features(lines):
    """The features of a text's lines, one line and one word at a time."""
    out, seen = [], set()
    for line in lines:
        b = line.encode()
        long = max(len(b), 1)
        w = b.split()
        row = [math.sqrt(sum(bool(c[x]) for x in b) / long) for c in crf.CLASSES]
        row += [math.log1p(len(b)) / 8, len(w) / long, sum(x == y for x, y in zip(w, w[1:], strict=False)) / max(len(w), 1), float(bool(w) and line in seen), float(not w)]
        seen.add(line)
        out.append(row)
    return out


def test_crf_scores():
    """Features, neighbours and the length-weighted score by brute force over all labellings; training sees every line."""
    rng = np.random.default_rng(2)
    texts = ["One line, 12 words words %%", "", "a\n\nA b B b\na", "\u00fcber %% ##\nx x x\n", "end\nend\n\t\nend"]
    w, steps = 0.5 * rng.standard_normal(3 * crf.FEATURES + 1), rng.standard_normal((2, 2))
    x, size, n = crf.line_features([t.encode() for t in texts])
    assert np.allclose(x, np.concatenate([plain_features(t.split("\n")) for t in texts]), atol=1e-6)
    assert n.tolist() == [len(t.split("\n")) for t in texts] and size.tolist() == [len(x.encode()) for t in texts for x in t.split("\n")]
    got = crf.scores([t.encode() for t in texts], w, steps)
    for t, g in zip(texts, got, strict=True):
        rows = [[0.0] * crf.FEATURES, *plain_features(t.split("\n")), [0.0] * crf.FEATURES]
        good = [float(np.dot(w, [*rows[k - 1], *rows[k], *rows[k + 1], 1.0])) for k in range(1, len(rows) - 1)]
        total, marginal = 0.0, np.zeros(len(good))
        for y in np.ndindex(*[2] * len(good)):
            p = math.exp(sum(good[k] * y[k] for k in range(len(good))) + sum(steps[y[k], y[k + 1]] for k in range(len(good) - 1)))
            total += p
            marginal += p * np.array(y)
        long = np.array([len(line.encode()) + 1 for line in t.split("\n")])
        assert g == pytest.approx(float((marginal / total * long).sum() / long.sum()), abs=1e-5)
    # texts whose junk begins after line 100 teach as much as others
    lines = lambda junk: "\n".join(["river stone light"] * 120 + (["%%% ### $$$"] * 100 if junk else ["walk light river"] * 100)).encode()
    x, _, n = crf.line_features([lines(k % 2) for k in range(20)])
    found = crf.scores([lines(0), lines(1)], *crf.fit(x, n, np.array([1.0 - k % 2 for k in range(20)])))
    assert found[0] > found[1] + 0.2


def test_forward_backward():
    rng = np.random.default_rng(0)
    good, steps = rng.standard_normal((1, 4)), rng.standard_normal((2, 2))
    marginal, pairs = crf.forward_backward(good, np.ones((1, 4), dtype=bool), steps)
    total, m, p = 0.0, np.zeros(4), np.zeros((2, 2))
    for y in np.ndindex(2, 2, 2, 2):
        w = math.exp(sum(good[0, k] * y[k] for k in range(4)) + sum(steps[y[k], y[k + 1]] for k in range(3)))
        total += w
        m += w * np.array(y)
        for k in range(3):
            p[y[k], y[k + 1]] += w
    assert np.allclose(marginal[0], m / total) and np.allclose(pairs, p / total)


def test_extra_columns(spark, tmp_path_factory, rows):
    """Columns whose names the operators use themselves come through each stage, and an empty table does too."""
    import corpus_pipeline

    docs = make(spark, rows)
    for name in ("doc", "id", "key", "chunk", "target", "copies", "cut", "_h", "_doc", "_gone", "trusted", "component_id", "fp", "n_words"):
        docs = docs.withColumn(name, F.col("doc_id"))
    d = parquet(tmp_path_factory, spark, documents=docs, labels=spark.createDataFrame([(2, 1, 0)], "doc_id long, quality int, toxic int"))
    for df in (docs, docs.filter("false")):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, df, d)
            assert out.columns == docs.columns
            assert out.filter("NOT (key <=> doc_id AND copies <=> doc_id AND _h <=> doc_id AND fp <=> doc_id)").count() == 0


def test_pipeline(spark, tmp_path_factory):
    import corpus_pipeline

    rng = random.Random(8)
    vocabulary = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 8))) for _ in range(400)]
    text = lambda n: "\n".join(" ".join(rng.choice(vocabulary) for _ in range(12)) for _ in range(n))
    clean = [(k, text(5), f"s{k % 3}") for k in range(30)]
    rows = clean + [(100, clean[0][1], "s1"), (101, clean[1][1] + "\n" + text(1), "s2"), (102, "a b c", "s1"), (103, None, None), (104, "spam spam " * 40, "s1")]
    d = parquet(tmp_path_factory, spark, documents=make(spark, rows), labels=spark.createDataFrame([(k, 1, 0) for k in range(0, 30, 2)], "doc_id long, quality int, toxic int"))
    docs, left = spark.read.parquet(f"{d}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        docs = common.scratch(spark, stage(spark, docs, d), "t")
        left[name] = sorted(r.doc_id for r in docs.select("doc_id").collect())
    assert left["quality rules"] == [*range(30), 100, 101]
    assert left["line dedup"] == [*range(30), 101]
    assert left["simhash near-dedup"] == [*range(30), 101]
    assert set(left["mixing to target weights"]) <= {*range(30), 101} and len(left["mixing to target weights"]) > 31
    assert left["bpe encoding"] == left["mixing to target weights"]
