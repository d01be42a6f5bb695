"""The query functions themselves, with production parameters, over a small table: digests, digits and column sets."""

import base64
import hashlib
import math
import random
import re
import zlib

import pytest
import xxhash

from topicspark.llm import queries

KINDS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = re.compile(rb"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def docs():
    rng = random.Random(8)
    words = "the of and Fleet bomber, San diego é über 12 $5 x # long".split()
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 120))) for _ in range(50)]
    texts = [t.replace(" and ", "\n") if k % 2 else t for k, t in enumerate(texts)]
    texts += [texts[3], texts[3], texts[5] + " tail", "lead " + texts[9], texts[7][:200] + texts[8], None, "", "\x0b\t ", "A", "w" * 3000, ("long " * 2000).strip(), "The same line\nThe same line\nThe same line " + texts[11]]
    return {k: t for k, t in enumerate(texts)}


@pytest.fixture(scope="module")
def run(spark, docs, tmp_path_factory):
    path = tmp_path_factory.mktemp("docs")
    spark.createDataFrame([(d, t, "en", "s", 0) for d, t in docs.items()], KINDS).coalesce(2).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(d, int(d % 3 > 0), 0) for d in range(0, 50, 2)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")

    def rows(name):
        got = {r.doc_id: r for r in queries.QUERIES[name](spark, str(path)).collect()}
        assert set(got) == set(docs)
        return got

    return rows


def test_op4(run, docs):
    tiktoken, P = pytest.importorskip("tiktoken"), pytest.importorskip("public_tokenizers")
    with open(P.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for d, r in run("op4_bpe").items():
        ids = enc.encode_ordinary(docs[d] or "")
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256((docs[d] or "").encode()).hexdigest()


def lowered(text):
    return bytes(b + 32 if 65 <= b <= 90 else b for b in (text or "").encode())


def test_op6(run, docs):
    prints = {}
    for d, t in docs.items():
        w = WORDS.findall(lowered(t))
        shingles = [b" ".join(w[k : k + 3]) for k in range(len(w) - 2)] or ([b" ".join(w)] if w else [])
        h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
        prints[d] = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    label = {d: d for d in docs}
    for _ in docs:
        label = {d: min(label[e] for e in docs if (prints[d] ^ prints[e]).bit_count() <= 2) for d in docs}
    for d, r in run("op6_simhash").items():
        assert (r.fingerprint, r.component_id) == (f"{prints[d]:016x}", label[d])


def test_op9(run, docs):
    seen, want = set(), {}
    for d in sorted(docs):
        b = (docs[d] or "").encode()
        own = [b[k : k + 50] for k in range(len(b) - 49)]
        gone = [False] * len(b)
        for k, s in enumerate(own):
            if s in seen:
                gone[k : k + 50] = [True] * 50
        seen.update(own)
        spans = sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone))
        want[d] = (len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest())
    got = run("op9_substrings")
    assert {d: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for d, r in got.items()} == want
    assert sum(w[1] for w in want.values()) > 200


def test_op10(run, docs):
    for d, r in run("op10_quality_rules").items():
        t = docs[d] or ""
        w = WORDS.findall(t.encode())
        at = {}
        for k in range(len(w) - 7):
            at.setdefault(tuple(w[k : k + 8]), []).append(k)
        repeats = {p for ks in at.values() if len(ks) > 1 for k in ks for p in range(k, k + 8)}
        lines = [x for x in t.split("\n") if WORDS.search(x.encode())]
        want = (len(w), sum(len(x.decode()) for x in w), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(repeats))
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (len(w) < 20 or 100 * len(repeats) > 30 * len(w)) and not (r.base_failed and r.kept)


def test_op1(run, docs):
    held = {d: zlib.crc32(str(d).encode()) % 7 == 2 for d in docs}
    tokens = {d: [*WORDS.findall(lowered(t)), None] for d, t in docs.items()}
    counts = {}
    for d, t in tokens.items():
        for x in t if not held[d] else ():
            counts[x] = counts.get(x, 0) + 1
    n = sum(counts.values())
    for d, r in run("op1_ctw").items():
        base = sum(math.log10((counts.get(x, 0) + 1) / (n + len(counts) + 1)) for x in tokens[d])
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[d], len(tokens[d]), sum(x in counts for x in tokens[d]), n)
        assert r.base_score == pytest.approx(base, rel=1e-9) and math.isfinite(r.score) and r.score < 0
