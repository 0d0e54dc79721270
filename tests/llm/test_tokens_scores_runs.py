"""Byte-level BPE, hard negatives and periodic runs against brute force, with nulls, empty and very long texts, ties and repeated rows."""

import base64
import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from tidewave.llm import byte_bpe, hard_negatives, licenses, periodic_runs, queries

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


# ---- byte-level BPE ----


@pytest.fixture(scope="module")
def ranks():
    with open(PATH, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@pytest.fixture(scope="module")
def library(ranks):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def ids(raw):
    return np.frombuffer(raw, np.int32).tolist()


PARTS = ["a", "b", "'", "s", "l", "ll", "'re", " ", "  ", "\n", "\t", "é", "1", "23", "…", "!", "?!", "the", " the", "日本", "x" * 9, "ing", "-", "--", "\U0001f600", "S'", "\x1c", " ", " ", "<|endoftext|>"]


def test_pattern():
    assert byte_bpe.PATTERN == public_tokenizers.PATTERN


@pytest.mark.parametrize("chunk", [1, 2, 3, 7, 1 << 14])
@pytest.mark.parametrize("leaf", [1, 2, 5, 64])
def test_any_tree_gives_the_same_ids(ranks, library, chunk, leaf):
    rng = random.Random(chunk * 100 + leaf)
    encoder = byte_bpe.Encoder(ranks, chunk, leaf)
    texts = ["".join(rng.choice(PARTS) for _ in range(rng.randrange(40))) for _ in range(400)]
    texts += ["".join(rng.choice("abcdefghijklmnopqrstuvwxyzéß") * rng.choice([1, 1, 1, 7]) for _ in range(rng.randrange(1, 200))) for _ in range(50)]
    for text in texts:
        spans, parts = encoder.encode(text)
        want = library.encode_ordinary(text)
        assert "".join(spans) == text
        assert ids(b"".join(parts)) == want == ids(encoder.ids(text)), text
        assert encoder.text(want) == text.encode()


def test_joining_is_associative(ranks, library):
    encoder, rng = byte_bpe.Encoder(ranks, 4, 4), random.Random(5)
    for _ in range(200):
        a, b, c = ("".join(rng.choice(PARTS) for _ in range(rng.randrange(8))) for _ in range(3))
        x, y, z = map(encoder.encode, (a, b, c))
        left, right = encoder.join(encoder.join(x, y), z), encoder.join(x, encoder.join(y, z))
        assert b"".join(left[1]) == b"".join(right[1])
        assert ids(b"".join(left[1])) == library.encode_ordinary(a + b + c)


@pytest.mark.parametrize("text", ["x" * 50_001, "ab" * 20_000, " " * 30_001, "é" * 9_999, "\n \n" * 5_000 + "a", "!" * 20_000 + "'ll"], ids=lambda t: repr(t[:3]))
def test_very_long_pieces(ranks, library, text):
    encoder = byte_bpe.Encoder(ranks)
    assert ids(encoder.ids(text)) == library.encode_ordinary(text)
    assert ids(byte_bpe.Encoder(ranks, 999).ids(text)) == library.encode_ordinary(text)


def test_the_table_of_pieces_is_bounded(ranks, library, monkeypatch):
    monkeypatch.setattr(byte_bpe, "CACHE", 10)
    encoder = byte_bpe.Encoder(ranks)
    text = " ".join(f"word{i % 37}" for i in range(500)) + " " + "y" * 100
    assert ids(encoder.ids(text)) == library.encode_ordinary(text)
    assert len(encoder.pieces) <= 10


def test_encoding_and_decoding_rows(spark, library):
    texts = ["", None, "one", " two  three\n", "It's déjà vu; they'll see 12,345 €", "z" * 300_000, "word " * 60_000, "one"]
    rows = [(i, t, "clash", "clash", b"clash") for i, t in enumerate(texts)] + [(None, "null id", "", "", b""), (3, "an id again", "", "", b"")]
    df = spark.createDataFrame(rows, "doc_id long, text string, id string, ids string, decoded binary").repartition(2)
    ranks = byte_bpe.read_ranks(spark, f"file://{PATH}")
    got = byte_bpe.decode(byte_bpe.encode(df, ranks), ranks).collect()
    want = Counter((d, tuple(library.encode_ordinary(t or "")), (t or "").encode()) for d, t, *_ in rows)
    assert Counter((r.doc_id, tuple(r.ids), bytes(r.decoded)) for r in got) == want
    none = byte_bpe.decode(byte_bpe.encode(df.limit(0), ranks), ranks)
    assert none.columns == ["doc_id", "ids", "decoded"] and none.count() == 0
    odd = spark.createDataFrame([(1, None), (2, [])], "k int, ids array<int>")
    assert [bytes(r.decoded) for r in byte_bpe.decode(odd, ranks).collect()] == [b"", b""]
    with pytest.raises(Exception, match="99999999 is not in the vocabulary"):
        byte_bpe.decode(spark.createDataFrame([(1, [99999999])], "k int, ids array<int>"), ranks).collect()


def test_a_vocabulary_needs_every_byte(spark, tmp_path):
    (tmp_path / "few").write_text("YQ== 0\n\nYg== 1\n")
    with pytest.raises(ValueError, match="no token for the single bytes"):
        byte_bpe.read_ranks(spark, str(tmp_path / "few"))


def test_bpe_query(spark, library, tmp_path):
    texts = [None, "", "Hello, world!", "  spaces   and\ttabs\n\n", "x" * 1000]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    for r in queries.op11_byte_bpe(spark, str(tmp_path)).collect():
        text = texts[r.doc_id] or ""
        want = library.encode_ordinary(text)
        assert r.n_tokens == len(want)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, want)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


# ---- hard negatives ----


@pytest.mark.parametrize("size", [1, 200, 10**4, 10**8])
def test_residues_give_exact_scores(size):
    rng = np.random.default_rng(size)
    for width in (1, 3, 64, 500):
        a, b = (rng.integers(-size, size + 1, (n, width)) for n in (5, 7))
        a[0], b[0], b[1] = size, size, -size
        primes = hard_negatives.primes_for(width * size * size)
        want = a.astype(object) @ b.T.astype(object)
        assert (hard_negatives.exact_scores(a, b, primes).astype(object) == want).all()


def test_enough_primes():
    assert len(hard_negatives.primes_for(0)) == 1 and len(hard_negatives.primes_for(125)) == 1 and len(hard_negatives.primes_for(126)) == 2
    edge = (1 << 63) - 1
    primes = hard_negatives.primes_for(edge)
    x = np.array([[edge, -edge, 0, 1, -1, edge - 1]])
    assert (hard_negatives.recombine([x % p for p in primes], primes) == x).all()
    with pytest.raises(ValueError, match="64 bits"):
        hard_negatives.primes_for(1 << 63)


def mined(rows, positives=5, negatives=3, low=50, high=95):
    """By brute force, from (id, vector, label) as the query takes them."""
    ok = [(i, [int(np.floor(256 * float(x))) for x in v], (y + 1) % 10 if i % 7 == 0 else y) for i, v, y in rows if i is not None and v is not None and y is not None and all(x is not None and np.isfinite(x) for x in v)]
    score = lambda u, v: sum(a * b for a, b in zip(u, v, strict=False))
    out = Counter()
    for k, (i, u, y) in enumerate(ok):
        if i % 50:
            continue
        others = sorted((-score(u, v), j, z) for m, (j, v, z) in enumerate(ok) if m != k)
        for p, j, _ in [o for o in others if o[2] == y][:positives]:
            inside = [o for o in others if o[2] != y and low * -p <= 100 * -o[0] <= high * -p][:negatives]
            for rank, (s, n, _) in enumerate(inside, 1):
                out[i, j, rank, n, -p, -s] += 1
    return out


VECTORS = "vec_id long, embedding array<float>, label int, row string, block int, anchor string"


def vectors(seed=2):
    rng = np.random.default_rng(seed)
    centre = rng.standard_normal((4, 8))
    rows = [(i, (centre[i % 4] + 0.8 * rng.standard_normal(8)).astype(np.float32).tolist(), int(i % 4)) for i in range(0, 420)]
    rows += [(i, rows[50][1], int(i % 4)) for i in range(1000, 1100)]  # copies: ties in every score
    rows += [(5000, None, 1), (5050, rows[0][1], None), (5100, [1.0, None], 1), (5150, [float("nan")], 1), (5200, [float("inf")], 1), (None, rows[0][1], 1), (5250, [], 1), (5300, rows[3][1][:3], 2), (5350, [0.0] * 8, 3)]
    return rows + [rows[100], rows[100], rows[7]]  # repeated rows, one of them an anchor


@pytest.mark.parametrize("blocks", [(1 << 14, 1 << 14), (64, 3)])
def test_hard_negatives(spark, blocks):
    df = spark.createDataFrame([(*r, "clash", 1, "clash") for r in vectors()], VECTORS).repartition(3)
    label = F.expr("case when vec_id % 7 = 0 then (label + 1) % 10 else label end")
    got = hard_negatives.hard_negatives(df, F.expr("vec_id % 50 = 0"), label, rows=blocks[0], anchors=blocks[1]).collect()
    assert Counter((r.anchor_id, r.positive_id, r.rank, r.negative_id, r.positive_score, r.negative_score) for r in got) == mined(vectors())


def test_hard_negatives_of_little(spark):
    for rows in ([], [(1, [1.0], 0)], [(50, [1.0], 0)], [(50, [1.0], 0), (51, [1.0], 0)], [(50, [1.0], 0), (51, [1.0], 0), (52, [0.9], 1)], [(50, [-1.0], 0), (51, [1.0], 0), (52, [1.0], 1)]):
        df = spark.createDataFrame([(*r, "", 0, "") for r in rows], VECTORS)
        got = hard_negatives.hard_negatives(df, F.expr("vec_id % 50 = 0"), F.expr("case when vec_id % 7 = 0 then (label + 1) % 10 else label end"))
        assert dict(got.dtypes) == {"anchor_id": "bigint", "positive_id": "bigint", "rank": "int", "negative_id": "bigint", "positive_score": "bigint", "negative_score": "bigint"}
        assert Counter(tuple(r[c] for c in ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")) for r in got.collect()) == mined(rows)
    huge = spark.createDataFrame([(50, [1e30], 0, "", 0, "")], VECTORS)
    with pytest.raises(ValueError, match="64 bits"):
        hard_negatives.hard_negatives(huge, F.lit(True), F.col("label"))


# ---- periodic runs ----


def lyndon_by_hand(s):
    """The longest substring at each place that is smaller than all of its own ends."""
    return [max(j - i for j in range(i + 1, len(s) + 1) if all(s[i:j] < s[k:j] for k in range(i + 1, j))) for i in range(len(s))]


def runs_by_hand(s, least):
    found = []
    for p in range(1, len(s) // 2 + 1):
        i = 0
        while i + p < len(s):
            j = i
            while j + p < len(s) and s[j] == s[j + p]:
                j += 1
            w = s[i : j + p]
            if len(w) >= max(least, 2 * p) and not any(w[q:] == w[:-q] for q in range(1, p)):
                found.append((i, len(w), p))
            i = max(j, i + 1)
    return sorted(found, key=lambda r: (r[0], r[2]))


def test_lyndon_arrays():
    rng = random.Random(1)
    for _ in range(600):
        k = rng.choice([1, 2, 3, 6])
        s = [rng.randrange(k) for _ in range(rng.randrange(1, 28))]
        kinds, ranks = np.unique(s, return_inverse=True)
        assert periodic_runs.lyndon_lengths(ranks, kinds.size).tolist() == lyndon_by_hand(s)


def test_runs_of_strings():
    rng = random.Random(2)
    for _ in range(600):
        k, least = rng.choice([1, 2, 3, 6]), rng.choice([2, 5, 12])
        s = [rng.randrange(k) for _ in range(rng.randrange(0, 60))]
        assert list(zip(*(x.tolist() for x in periodic_runs.runs_of(np.array(s, np.int64), least=least)), strict=True)) == runs_by_hand(s, least)


def repetitive(rng, n):
    w = []
    while len(w) < n:
        w += [f"w{rng.randrange(5)}" for _ in range(rng.randrange(1, 9))] * rng.randrange(1, 5)
    return w[:n]


def collapsed(words, runs):
    return " ".join(w for i, w in enumerate(words) if not any(s + q <= i < s + n for s, n, q in runs))


def test_find_runs(spark):
    rng = random.Random(3)
    texts = [" ".join(repetitive(rng, rng.randrange(0, 120))) for _ in range(80)]
    texts += ["", None, " \n\t", "one", "a " * 11, "a " * 12, "a\x0bb\x0c" * 6, "é ß " * 13, "A a " * 6, " ".join(map(str, range(3000))), "go on " * 20_000, "x" * 200_000]
    rows = [(i, t, "clash", "clash") for i, t in enumerate(texts)] + [(None, texts[0], "", ""), (5, texts[5], "", ""), (5, texts[6], "", "")]
    df = spark.createDataFrame(rows, "doc_id long, text string, id string, runs string").repartition(3)
    want = Counter()
    for d, t, *_ in rows:
        words = [w.decode() for w in (t or "").encode().split()]
        runs = [(0, 40_000, 2)] if len(words) == 40_000 else runs_by_hand(words, 12)
        want[d, len(words), tuple(runs), "go on" if len(words) == 40_000 else collapsed(words, runs)] += 1
    got = periodic_runs.find_runs(df).collect()
    assert Counter((r.doc_id, r.n_words, tuple((x.start, x.length, x.period) for x in r.runs), r.collapsed) for r in got) == want
    none = periodic_runs.find_runs(df.limit(0))
    assert none.columns == ["doc_id", "n_words", "runs", "collapsed"] and none.count() == 0


def test_slices_of_documents_give_the_same(spark, monkeypatch):
    rng = random.Random(4)
    words = [[w.encode() for w in repetitive(rng, rng.randrange(0, 90))] for _ in range(60)]
    whole = list(zip(*(x.tolist() for x in periodic_runs.document_runs(words)), strict=True))
    assert whole == [(i, *r) for i, w in enumerate(words) for r in runs_by_hand(w, 12)]


def test_runs_query(spark, tmp_path):
    rng = random.Random(6)
    texts = [" ".join(f"v{rng.randrange(40)}" for _ in range(rng.randrange(0, 150))) for _ in range(120)] + [None, "", "   "]
    rows = [*enumerate(texts), (None, texts[1]), (3, texts[3])]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want, planted = Counter(), 0
    for d, t in rows:
        w = [x.decode() for x in (t or "").encode().split()]
        n, h = len(w), zlib.crc32(str(d).encode()) if d is not None else 1
        if h % 10 == 0 and n:
            planted += 1
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        runs = runs_by_hand(w, 12)
        best = min(((-n, s, q) for s, n, q in runs), default=None)
        row = (best[1], -best[0], best[2], 1000 * -best[0] // best[2]) if best else (None,) * 4
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        want[d, len(runs), *row, sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(collapsed(w, runs))] += 1
    assert planted > 5
    got = queries.op13_periodic_runs(spark, str(tmp_path)).collect()
    assert Counter((r.doc_id, r.n_runs, r.start, r.length, r.period, r.exponent_milli, r.runs_sha256, r.collapsed_sha256) for r in got) == want


# ---- license names ----


def test_every_notice_written_out_is_found(spark):
    """The names and notices of the SQL, written out apart from the operator's own."""
    by_name = defaultdict(set)
    for name, text in queries.NOTICES:
        by_name[name].add(text)
    rows = [(i, f"some words before it. {text} And after", name) for i, (name, text) in enumerate(queries.NOTICES)]
    found = licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string, name string")).collect()
    names = {r.doc_id: r.licenses for r in found}
    assert all(name in names[i] for i, _, name in rows)
    assert {name: set(texts) for name, texts in (licenses.TEMPLATES | licenses.SHORT).items()} == by_name
