"""Byte-level BPE, hard-negative mining and periodic runs against libraries and brute force, and on edge cases."""

import base64
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from cellweave.llm import byte_bpe, hard_negatives, periodic_runs, queries

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
EDGE = [(1, None), (2, ""), (3, "x"), (4, " \n "), (4, " \n "), (None, "one two"), (6, "Ünïcode ▁ \0 text 日本"), (7, "a" * 5000), (8, "don't we'll ''s 's I'M you've\t\t x  y 　 z1²½ " * 3), (9, "lu " * 20000)]


def table(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for c in ("id", "ids", "bytes", "row", "runs", "collapsed", "start", "w", "n", "a", "p", "g"):
        df = df.withColumn(c, F.lit("clash"))
    return df


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def random_texts(n):
    r = random.Random(1)
    parts = [*" '\n\t stredvml  aZ09.,!-é日 　🙂½", "'s", "'re", "'ll", " '", "the", " Haus"]
    out = ["".join(r.choices(parts, k=r.randint(0, 60))) for _ in range(n)]
    return out + ["".join(chr(r.choice([r.randrange(32, 0x2000), r.randrange(0x2000, 0xD800), r.randrange(0xE000, 0x20000)])) for _ in range(r.randint(0, 30))) for _ in range(n)]


def test_the_pattern_is_the_public_one():
    assert byte_bpe.PATTERN == public_tokenizers.PATTERN


def test_byte_bpe_equals_the_library(spark, library):
    rows = EDGE + [(100 + i, t) for i, t in enumerate([*random_texts(2000), "ab" * 5000, " " * 3000 + "x"])]
    out = byte_bpe.encode(table(spark, rows), RANKS)
    got = sorted(((r.doc_id or 0, list(r.ids)) for r in out.collect()))
    assert got == sorted((i or 0, library.encode_ordinary(t or "")) for i, t in rows)
    back = sorted((r.doc_id or 0, bytes(r.bytes)) for r in byte_bpe.decode(out, RANKS).collect())
    assert back == sorted((i or 0, (t or "").encode()) for i, t in rows)


def test_byte_bpe_decodes_odd_ids_and_empty_tables(spark):
    rows = spark.createDataFrame([(1, None), (2, []), (3, [15, None, 10**6, -4, 16])], "doc_id long, ids array<int>")
    v = byte_bpe.load(RANKS)
    assert {r.doc_id: bytes(r.bytes) for r in byte_bpe.decode(rows, RANKS).collect()} == {1: b"", 2: b"", 3: v.tokens[15] + v.tokens[16]}
    assert byte_bpe.encode(table(spark, []), RANKS).collect() == []


def test_the_perfect_hash_is_minimal():
    v = byte_bpe.load(RANKS)
    assert sorted(v.slot_id.tolist()) == [i for i, t in enumerate(v.tokens) if t]
    e = byte_bpe.Encoder(v)
    for i in range(0, len(v.tokens), 97):  # every token is found at its slot
        raw = np.frombuffer(v.tokens[i], np.uint8)
        h = byte_bpe.hashes(raw, np.array([0]), np.array([len(raw)]), byte_bpe.powers(len(raw) + 1, byte_bpe.BASE), byte_bpe.powers(len(raw) + 1, pow(byte_bpe.BASE, -1, 1 << 64)))
        assert e.v.slot_id[byte_bpe.placed(h, v.shift[(h % np.uint64(len(v.shift))).astype(np.int64)], len(v.slot_id))][0] == i


def test_pre_tokens_of_one_hash_stay_apart(library, monkeypatch):
    e = byte_bpe.Encoder(byte_bpe.load(RANKS))
    monkeypatch.setattr(byte_bpe, "hashes", lambda flat, start, end, up, down: np.full(len(start), 5, np.uint64))
    for texts in (["zqx zqy zqxx", "zqy"], ["zqxx brackl", "zqx"]):
        ids, many = e.encode(texts)
        assert ids.tolist() == [i for t in texts for i in library.encode_ordinary(t)] and many.tolist() == [len(library.encode_ordinary(t)) for t in texts]


def test_op11_digests(spark, library, tmp_path):
    rows = EDGE[:9]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = []
    for i, t in rows:
        ids = library.encode_ordinary(t or "")
        want.append((i or 0, len(ids), sha(",".join(map(str, ids)).encode()), sha((t or "").encode())))
    got = [(r.doc_id or 0, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in queries.op11_byte_bpe(spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted(want)


@pytest.mark.parametrize("shape", [(1, 1, 1), (3, 70, 5), (65, 33, 129), (100, 64, 37), (0, 4, 3)])
def test_strassen_is_exact(shape):
    r = np.random.default_rng(3)
    m, k, n = shape
    for most in (300, 1 << 40):  # sums beyond 64 bits wrap alike
        a, b = r.integers(-most, most, (m, k)), r.integers(-most, most, (k, n))
        assert (hard_negatives.strassen(a, b, 4) == a @ b).all()


def brute_negatives(rows, step, positives, negatives):
    good = sorted({(i, lab, tuple(int(np.floor(256.0 * x)) for x in v)) for i, lab, v in rows if i is not None and lab is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)})
    width, out = max([len(g[2]) for g in good], default=0), []
    good = [(i, lab, np.array([*v, *[0] * (width - len(v))], object)) for i, lab, v in good]
    for a, (i, lab, v) in enumerate(good):
        if i % step:
            continue
        score = [sum(v * w) if width else 0 for _, _, w in good]
        order = sorted((k for k in range(len(good)) if k != a), key=lambda k: (-score[k], k))
        for p in [k for k in order if good[k][1] == lab][:positives]:
            fit = [k for k in order if good[k][1] != lab and 80 * score[p] <= 100 * score[k] <= 100 * score[p]][:negatives]
            out += [(i, good[p][0], r + 1, good[k][0], score[p], score[k]) for r, k in enumerate(fit)]
    return sorted(out)


@pytest.mark.parametrize("blocks", [(512, 2048, 8), (3, 16, 2)])
def test_hard_negatives_equal_brute_force(spark, monkeypatch, blocks):
    for name, value in zip(("ANCHORS", "CANDIDATES", "GROUP"), blocks, strict=True):
        monkeypatch.setattr(hard_negatives, name, value)
    r = np.random.default_rng(7)
    rows = [(int(i), int(r.integers(0, 4)), (r.integers(0, 4, 5) / 7 + 0.3).tolist()) for i in range(150)]  # many ties
    rows += [(200, 1, None), (210, None, [1.0]), (None, 1, [1.0] * 5), (220, 1, [1.0, None]), (230, 2, [float("nan")]), (240, 2, [float("inf"), 1.0]), (250, 3, []), (260, 3, [0.5, -0.25]), (270, 0, [-1.0] * 5), (280, 1, [1e6, 1.0])]
    rows += [(10, 2, [0.9] * 5), (10, 2, [0.9] * 5), rows[20], rows[20]]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    for c in ("id", "v", "block", "at", "a", "s", "rank", "score", "wins", "anchor"):
        df = df.withColumn(c, F.lit("clash"))
    got = sorted(tuple(x) for x in hard_negatives.mine(df.repartition(3), F.col("id") % 10 == 0).collect())
    assert got == brute_negatives(rows, 10, 5, 5) and got


def test_hard_negatives_of_nothing(spark):
    kind = "vec_id long, label int, embedding array<double>"
    for rows in ([], [(1, 1, [1.0]), (2, 2, [1.0])], [(10, 1, [1.0]), (2, 2, [1.0])], [(10, 1, None)]):
        assert hard_negatives.mine(spark.createDataFrame(rows, kind), F.col("id") % 10 == 0).collect() == []


def brute_runs(w):
    n, out = len(w), []
    for q in range(1, n // 4 + 1):
        x = 0
        while x + q < n:
            if w[x] != w[x + q]:
                x += 1
                continue
            s = x
            while x + q < n and w[x] == w[x + q]:
                x += 1
            e = x + q
            if e - s >= max(6, 4 * q) and not any(all(w[i] == w[i + d] for i in range(s, e - d)) for d in range(1, q)):
                out.append((s, e - s, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def brute_collapsed(w, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def random_words(r):
    k, w = r.choice([1, 2, 3, 6, 40]), []
    while len(w) < r.randint(0, 150):
        if r.random() < 0.5:
            w += [str(r.randrange(k)) for _ in range(r.randint(1, 8))]
        else:
            unit = [str(r.randrange(k)) for _ in range(r.choice([1, 1, 2, 3, 5, 8, 13, 21]))]
            many = r.randint(2, 9)
            w += (unit * many)[: len(unit) * many - r.randint(0, len(unit) - 1)]
            if r.random() < 0.3:
                w += w[-r.randint(1, 30) :] * r.randint(1, 5)
    return w[:400]


def run_texts():
    r = random.Random(5)
    texts = [random_words(r) for _ in range(500)]
    nested, fib = ["a"], (["a"], ["a", "b"])
    for k in range(4):
        nested = nested * 5 + [f"b{k}"]
    while len(fib[1]) < 400:
        fib = fib[1], fib[1] + fib[0]
    return texts + [nested[:700], (nested[:90] * 5)[:440], fib[1][:400], ["z"] * 5, ["z"] * 6, ["x", "y"] * 3, ["x", "y"] * 4]


def test_runs_equal_brute_force(spark):
    words = run_texts()
    gaps = [" ", "\n", "\t ", "\x0b", " \r\n\x0c"]
    rows = [(i, gaps[i % 5].join(w)) for i, w in enumerate(words)] + [(-1, None), (-2, ""), (-3, " \n"), (None, "a b " * 9), (None, "a b " * 9), (-4, "é x é x " * 8)]
    got = sorted((r.doc_id or 0, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in periodic_runs.detect(table(spark, rows).repartition(3)).collect())
    want = []
    for i, t in rows:
        w = [x.decode() for x in (t or "").encode().split()]
        runs = brute_runs(w)
        want.append((i or 0, len(w), runs, brute_collapsed(w, runs)))
    assert got == sorted(want)


def test_runs_of_long_texts_and_none(spark):
    r = random.Random(9)
    unit = [str(r.randrange(900)) for _ in range(3000)]
    w = ["s"] * 7 + unit * 4 + unit[:500] + ["e", "f"] * 2000 + [str(i) for i in range(3000)]
    row = periodic_runs.detect(table(spark, [(1, " ".join(w))])).first()
    # of the last unit's part and "e f" neither extends the other's run
    assert [tuple(x) for x in row.runs] == [(0, 7, 1), (7, 12500, 3000), (12507, 4000, 2)]
    assert row.collapsed.split() == ["s"] + unit + ["e", "f"] + [str(i) for i in range(3000)]
    assert periodic_runs.detect(table(spark, [])).collect() == []


def test_op13_columns(spark, tmp_path):
    r = random.Random(2)
    rows = [(i, " ".join(random_words(r) or ["only"])) for i in range(150)] + [(1000, None), (1001, ""), (1002, "  ")] + [(2000 + i, " ".join(str(r.randrange(50)) for _ in range(60))) for i in range(100)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want, sha, moved = [], lambda s: hashlib.sha256(s.encode()).hexdigest(), 0
    for i, t in rows:
        w, h = (t or "").split(), zlib.crc32(str(i).encode())
        g, n = h // 10, len((t or "").split())
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[x] if x < a else w[a + (x - a) % p] for x in range(n)]
            moved += 1
        runs = brute_runs(w)
        top = min(runs, key=lambda x: (-x[1] / x[2], x[0], x[2]), default=None)
        want.append((i, len(runs), *(top or (None,) * 3), top and 1000 * top[1] // top[2], sha("".join(f"{a},{b},{c}\n" for a, b, c in runs)), sha(brute_collapsed(w, runs))))
    got = [(x.doc_id, x.n_runs, x.start, x.length, x.period, x.exponent_milli, x.runs_sha256, x.collapsed_sha256) for x in queries.op13_periodic_runs(spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted(want) and moved > 10
