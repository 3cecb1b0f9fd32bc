"""Operators against brute force, exact round trips or held-out accuracy, and on edge cases."""

import hashlib
import math
import random
import re
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellweave.llm import common, decontaminate, embedding_dedup, lang_id, lattice_lm, ngram_jaccard, secret_scan, sentencepiece_codec, suffix_dedup, toxicity, url_filter

RNG = random.Random(3)
WORDS = ["ba", "ko", "lumi", "tera", "voss", "quil", "dran", "esto", "fi", "go", "hil", "jun"]
#: Nulls, empty and one-character texts, repeats, and columns whose names clash with the operators' own.
EDGE = [(1, None), (2, ""), (3, "x"), (4, " \n "), (4, " \n "), (None, "one two"), (6, "Ünïcode ▁ \0 text 日本"), (7, "a" * 5000)]


def prose(n):
    return " ".join("".join(RNG.choices(WORDS, k=RNG.randint(1, 3))) for _ in range(n))


def table(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for c in ("id", "key", "h", "n", "score", "spans", "word", "a", "b", "label"):
        df = df.withColumn(c, F.lit("clash"))
    return df


def near_copies():
    rows = []
    for k in range(12):
        base = prose(60).split()
        for _ in range(5):
            w = list(base)
            for _ in range(RNG.randint(0, 4)):
                w[RNG.randrange(len(w))] = prose(1)
            rows.append((len(rows) + 10, " ".join(w)))
    return rows + EDGE


def components(pairs, ids):
    parent = {i: i for i in ids}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in pairs:
        parent[max(root(a), root(b))] = min(root(a), root(b))
    return {i: root(i) for i in ids}


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, i) for i in range(101, 140)] + [(7, 7), (200, 200)]
    got = {r.id: r.component_id for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == components(edges, {x for e in edges for x in e})


def test_components_of_nothing(spark):
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("n,percent", [(4, 85), (5, 80), (1, 50)])
def test_ngram_jaccard_equals_brute_force(spark, n, percent):
    rows = near_copies()
    got = ngram_jaccard.link(table(spark, rows), n, percent).collect()

    def shingles(t):
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if x]
        return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()

    texts = [(i, shingles(t)) for i, t in rows if i is not None]
    linked = lambda a, b: bool(a and b) and 100 * len(a & b) >= percent * len(a | b)
    want = components([(i, j) for (i, a), (j, b) in combinations(texts, 2) if linked(a, b)], {i for i, _ in texts})
    assert len(got) == len(rows)
    expected = [(want.get(i), len(shingles(t)), sum(linked(shingles(t), b) for _, b in texts) - bool(shingles(t)) if i is not None else 0) for i, t in rows]
    order = lambda r: tuple(x or 0 for x in r)
    assert sorted(((r.component_id, r.n_shingles, r.n_links) for r in got), key=order) == sorted(expected, key=order)


def test_ngram_jaccard_ids_with_several_texts(spark, monkeypatch):
    a, b, c = prose(60), prose(60), prose(60)
    rows = [(5, a), (5, b), (3, a + " end"), (4, b + " end"), (9, c), (9, c)]
    out = ngram_jaccard.link(table(spark, rows)).collect()
    assert sorted((r.doc_id, r.component_id, r.n_links) for r in out) == [(3, 3, 1), (4, 3, 1), (5, 3, 1), (5, 3, 1), (9, 9, 1), (9, 9, 1)]


def test_ngram_jaccard_large_clusters_meet_by_buckets(spark, monkeypatch):
    base = prose(60).split()
    rows = [(i, " ".join([*base[:i], "x" * i, *base[i + 1 :]])) for i in range(40)]
    one = sorted(map(tuple, ngram_jaccard.link(table(spark, rows)).collect()))
    assert {r[2] for r in one} == {0} and min(r[3] for r in one) > 0
    monkeypatch.setattr(ngram_jaccard, "CLUSTER", 7)
    assert one == sorted(map(tuple, ngram_jaccard.link(table(spark, rows)).collect()))
    monkeypatch.setattr(ngram_jaccard, "SHINGLES", 300)
    monkeypatch.setattr(ngram_jaccard, "SMALL", 1)
    assert one == sorted(map(tuple, ngram_jaccard.link(table(spark, rows)).collect()))


def test_ngram_jaccard_tree_finds_what_the_bound_allows():
    sizes = np.array(sorted(RNG.randint(5, 200) for _ in range(150)))
    sets = [np.array(RNG.sample(range(10**6), int(k)), np.uint64) for k in sizes]
    sets = [s if i % 3 or not i else np.append(sets[i - 1][: len(s) - 1], s[:1])[: len(s)] for i, s in enumerate(sets)]
    sets = sorted(sets, key=len)  # a changed set may be smaller than drawn
    sizes, vecs = np.array([len(s) for s in sets]), []
    for s in sets:
        g = max(16, 1 << (len(s) // 8).bit_length())
        vecs.append(np.bincount((s & np.uint64(g - 1)).astype(int), minlength=g).astype("u1").tobytes())
    tree = ngram_jaccard.RTree(sizes, vecs, 80)
    for i in range(len(sets)):
        linked = {j for j in range(i + 1, len(sets)) if 100 * len(both := set(sets[i]) & set(sets[j])) >= 80 * (len(sets[i]) + len(sets[j]) - len(both))}
        assert linked <= set(tree.search(i).tolist())


def test_ngram_jaccard_hot_key_is_cut_into_blocks(spark, monkeypatch):
    monkeypatch.setattr(ngram_jaccard, "HOT", 6)
    rows = [(i, " ".join(["same line of words here", prose(6)])) for i in range(40)] + [(100, "same line of words here"), (101, "same line of words here now")]
    docs = table(spark, rows)
    one = sorted(map(tuple, ngram_jaccard.link(docs, 2, 60).collect()))
    monkeypatch.setattr(ngram_jaccard, "HOT", 10**6)
    assert one == sorted(map(tuple, ngram_jaccard.link(docs, 2, 60).collect()))


def test_decontamination_finds_phrases(spark):
    passage = prose(20)
    short = "zig zag zug"
    docs = [(21, f"{prose(30)} {passage} {prose(5)}"), (22, prose(40)), (23, passage.upper()), (24, f"{prose(300)} {short.title()}!"), (25, "Zig-zag")] + EDGE
    items = [(7, passage), (10, short), (11, None), (12, "")]
    out = {r.doc_id: r for r in decontaminate.judge(table(spark, docs), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert (out[21].n_hit, out[21].item_ids, out[21].contaminated) == (20, ["7"], True)
    assert (out[22].n_hit, out[22].item_ids, out[22].contaminated) == (0, [], False)
    assert (out[23].n_hit, out[23].n_words) == (20, 20)
    assert (out[24].n_hit, out[24].item_ids, out[24].contaminated) == (3, ["10"], False)
    assert out[25].n_hit == 0 and out[21].n_words == 55 and len(out) == len({i for i, _ in docs})


def edited(text, item):
    """Whether item stands in text with at most one word put in, left out or changed, by trying every edit."""
    n = len(item)
    for s in range(len(text) + 1):
        for size in (n - 1, n, n + 1):
            part = text[s : s + size]
            if len(part) != size:
                continue
            if size == n and sum(x != y for x, y in zip(part, item, strict=True)) <= 1:
                return True
            if size == n + 1 and any(part[:k] + part[k + 1 :] == item for k in range(n + 1)):
                return True
            if size == n - 1 and any(item[:k] + item[k + 1 :] == part for k in range(n)):
                return True
    return False


def close_windows(text, items, size=13):
    windows = {tuple(w[i : i + size]) for w in items for i in range(max(1, len(w) - size + 1)) if w}
    return sum(edited(text, list(w)) for w in windows if len(set(w)) >= 3)


def test_decontamination_finds_every_edit_of_one_word(spark):
    item = [f"q{i}" for i in range(13)]
    docs, want = {0: item}, {}
    for k in range(13):
        docs[100 + k] = [*item[:k], "changed", *item[k + 1 :]]
        docs[200 + k] = item[:k] + item[k + 1 :]
        docs[300 + k] = [*item[:k], "more", *item[k:]]
        docs[400 + k] = [*item[:k], "more", "and", *item[k:]]  # two words put in
    around = {i: ["a", "b", *w, "c", "d"] for i, w in docs.items()}
    for rows in ({i: w for i, w in docs.items() if i}, around):  # without and with an exact copy in the corpus
        out = decontaminate.judge(table(spark, [(i, " ".join(w)) for i, w in rows.items()]), spark.createDataFrame([(1, " ".join(item))], "item_id long, text string"))
        got = {r.doc_id: r.n_close for r in out.collect()}
        want = {i: close_windows(w, [item]) for i, w in rows.items()}
        assert got == want and all(n for i, n in got.items() if i < 400)


@pytest.mark.parametrize("seed", range(2))
def test_decontamination_proximity_equals_brute_force(spark, seed):
    g = random.Random(seed)
    some = lambda n, k: [f"t{g.randrange(k)}" for _ in range(n)]
    items = [some(g.randint(1, 9), 7) for _ in range(25)]
    texts = {}
    for i in range(60):
        w = some(g.randint(0, 6), 9)
        for _ in range(g.randint(0, 2)):
            part = list(g.choice(items))
            k = g.randrange(len(part))
            part = g.choice([part, part[:k] + part[k + 1 :], [*part[:k], "new", *part[k:]], [*part[:k], g.choice(["t1", "old"]), *part[k + 1 :]]])
            w += part + some(g.randint(0, 2), 9)
        texts[i] = w
    rows = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id long, text string")
    out = decontaminate.judge(table(spark, [(i, " ".join(w)) for i, w in texts.items()]), rows, size=5)
    got = {r.doc_id: r.n_close for r in out.collect()}
    assert got == {i: close_windows(w, items, 5) for i, w in texts.items()} and sum(got.values()) > 20


@pytest.mark.parametrize("seed", range(2))
def test_decontamination_equals_brute_force(spark, seed):
    g = random.Random(seed)
    draw = lambda n: [g.choice("abcdef") for _ in range(n)]
    docs = [(i, " ".join(draw(g.randint(0, 40)))) for i in range(40)] + EDGE[:4]
    items = [(i, " ".join(draw(g.choice([1, 2, 3, 4, 6])))) for i in range(12)]
    out = decontaminate.judge(table(spark, docs), spark.createDataFrame(items, "item_id long, text string"), size=4).collect()
    want = []
    for i, t in docs:
        doc, hit, ids = (t or "").split(), set(), set()
        for k, item in items:
            w = item.split()
            for win in {tuple(w[j : j + 4]) for j in range(max(1, len(w) - 3))} if w else ():
                for s in range(len(doc) - len(win) + 1):
                    if tuple(doc[s : s + len(win)]) == win:
                        hit |= set(range(s, s + len(win)))
                        ids.add(str(k))
        want.append((i, len(doc), len(hit), sorted(ids)))
    assert sorted((r.doc_id, r.n_words, r.n_hit, r.item_ids) for r in out) == sorted(want)


def test_decontamination_without_items(spark):
    out = decontaminate.judge(table(spark, [(1, "a b")]), spark.createDataFrame([], "item_id long, text string")).collect()
    assert [(r.n_words, r.n_hit, r.contaminated) for r in out] == [(2, 0, False)]


def spans_by_re(text):
    rules = [("assign", r"(?:(?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 1, 6), ("access", "AKIA[A-Z0-9]+", 0, 20), ("hex", "[0-9a-f]+", 0, 24)]
    found = [(m.start(), k, m.end(), kind) for k, (kind, rx, g, least) in enumerate(rules) for m in re.finditer(rx, text or "") if len(m[g]) >= least]
    return [f"{kind}:{s}:{e}" for s, _, e, kind in sorted(found)]


def test_secret_scan_equals_re(spark):
    rows = [(10, 'Secret = "abcdefgh" secret=ab:token=xyz12345 é password: zz'), (11, "AKIA" + "A" * 20 + " AKIAshort " + "0a" * 15), (12, "secret=token:abcdefg TOKEN='ABCDEF'"), (13, "-----BEGIN RSA PRIVATE KEY-----"), (14, "api_key:q1w2e3r4 apikey=......1")] + EDGE
    out = secret_scan.scan(table(spark, rows)).select("doc_id", "text", secret_scan.listed(F.filter("spans", lambda s: s["rank"] < 3)).alias("s"), F.size("spans").alias("n"), secret_scan.redact(F.col("text"), F.col("spans")).alias("clean")).collect()
    assert len(out) == len(rows)
    for r in out:
        assert r.s == ",".join(spans_by_re(r.text))
    by = {r.doc_id: r for r in out}
    assert by[13].n == 1 and by[13].clean == "[SECRET]" and by[3].clean == "x"
    assert "abcdefgh" not in by[10].clean and by[10].clean.startswith("[SECRET]")


def test_trigram_queries_hold_for_every_match():
    g = random.Random(5)
    forms = [("ab(cd|ce)f?gh+", "abcdefgh"), ("(xyz|xyw)[0-9]{2,}end", "xyzw0123end"), ("a?bcd(ef)*ghi", "abcdefghi"), ("(?i:Key|Lock)=x{3}y", "keylocKEYLOC=xy"), ("[ab]cd[ef]", "abcdef"), ("q|rst", "qrst")]
    for regex, letters in forms:
        clauses = secret_scan.mandatory(regex)
        for _ in range(20_000):
            t = "".join(g.choices(letters, k=g.randint(1, 14)))
            if m := re.search(regex, t):
                assert all(any(w in m[0].lower() for w in c) for c in clauses), (regex, m[0], clauses)
    assert secret_scan.mandatory("q|rst") == [] and secret_scan.mandatory("[0-9a-f]{24,}") == []


def test_secret_scan_of_a_text_with_many_spans(spark):
    token = "0123456789abcdef01234567"
    text = " é ".join([token] * 20_000)
    out = secret_scan.scan(table(spark, [(1, text), (2, "x" * 1_000_000)])).collect()
    by = {r.doc_id: r.spans for r in out}
    assert [(x.start, x.end) for x in by[1]] == [(27 * k, 27 * k + 24) for k in range(20_000)] and by[2] == []


def test_redaction_joins_overlapping_spans(spark):
    df = spark.createDataFrame([("abcdefghij", [(0, 2), (1, 4), (6, 7), (7, 9)]), ("abc", []), ("x" * 2000, [(2 * k, 2 * k + 1) for k in range(900)])], "text string, spans array<struct<start:int,end:int>>")
    got = [r[0] for r in df.select(secret_scan.redact(F.col("text"), F.col("spans"), "*")).collect()]
    assert got[:2] == ["*ef**j", "abc"]
    assert got[2] == "*x" * 900 + "x" * 200


def test_sentencepiece_equals_the_library_and_round_trips(spark):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_codec.VOCABULARY)
    rows = [(10, prose(200)), (11, "The  quick brown\nfox, jumps!! 12345 naïve 東京 😀"), (12, "   "), (13, "x " * 300)] + EDGE
    docs = table(spark, rows)
    coded = sentencepiece_codec.encode(docs)
    got = coded.collect()
    assert len(got) == len(rows) and all(r.round_trip for r in got)
    for r in got:
        t = dict(rows)[r.doc_id]
        if t and "▁" not in t and "\0" not in t:
            assert r.ids == sp.encode(t)
    back = {r.doc_id: r.text for r in sentencepiece_codec.decode(coded).collect()}
    assert back == dict(rows)


def test_suffix_dedup_equals_brute_force(spark, monkeypatch):
    shared = [prose(80) for _ in range(4)]
    rows = [(i + 10, f"{prose(RNG.randint(0, 60))} {shared[i % 4][: RNG.randint(150, 400)]} {prose(RNG.randint(0, 40))}") for i in range(24)]
    rows += [(50, rows[0][1]), (51, rows[3][1][:-5]), (52, "ab" * 400), (53, "x" + prose(4000)), (54, "abcdefg" * 90)] + EDGE
    rows += [(55, rows[-len(EDGE) - 2][1][900:1600])]
    texts = [(t or "").encode() for _, t in rows]
    starts = {}
    for k, b in enumerate(texts):
        for i in range(len(b) - 199):
            starts.setdefault(b[i : i + 200], []).append((k, i))
    want = []
    for k, b in enumerate(texts):
        gone = np.zeros(len(b) + 2, bool)
        for i in range(len(b) - 199):
            if len(starts[b[i : i + 200]]) > 1:
                gone[i + 1 : i + 201] = True
        kept = bytes(x for x, g in zip(b, gone[1:-1]) if not g)
        want.append((rows[k][0] or -1, len(b), int(gone.sum()), int((gone[1:] & ~gone[:-1]).sum()), hashlib.sha256(kept).hexdigest()))
    for hot in (4096, 2):
        monkeypatch.setattr(suffix_dedup, "HOT", hot)
        got = suffix_dedup.remove_repeats(table(spark, rows)).collect()
        assert sorted((r.doc_id or -1, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == sorted(want)


def test_suffix_dedup_deals_no_hot_group(spark, monkeypatch):
    passage = prose(80)[:300]
    rows = [(i, f"{prose(25)} {passage} {prose(25)}") for i in range(60)]
    monkeypatch.setattr(suffix_dedup, "HOT", 8)
    covered, groups = suffix_dedup.spans(suffix_dedup.keyed(table(spark, rows), "doc_id", "text"), 200)
    assert all(n <= 8 for (n,) in groups.groupBy("group").count().select("count").collect()) and covered.select("key").distinct().count() == 60
    got = {r.doc_id: r for r in suffix_dedup.remove_repeats(table(spark, rows)).collect()}
    for i, t in rows:
        assert (got[i].n_spans, passage.encode() in got[i].kept) == (1, False) and got[i].n_removed >= 300


def test_maximal_repeats_lists_all_occurrences():
    a, b = prose(60).encode(), prose(60).encode()
    cuts = [b"1" + a + b"x", b"2" + a + b"y" + b, b"3" + a[:250] + b"z"]
    groups = suffix_dedup.maximal_repeats([1, 2, 3], [0, 0, 0], cuts, 200)
    by = {length: sorted(zip(k.tolist(), o.tolist())) for length, k, o in groups}
    assert by[len(a)] == [(0, 1), (1, 1)] and by[250] == [(0, 1), (1, 1), (2, 1)]


def test_maximal_repeats_of_equal_cuts_take_little_memory():
    import tracemalloc

    cut = bytes(RNG.randrange(256) for _ in range(336))
    tracemalloc.start()
    groups = [(length, len(k)) for length, k, _ in suffix_dedup.maximal_repeats(list(range(3000)), [0] * 3000, [cut] * 3000, 200)]
    assert groups == [(336, 3000)] and tracemalloc.get_traced_memory()[1] < 300e6
    cuts = [bytes([k % 251]) + cut[:60] + bytes([k // 251]) + cut[61:] for k in range(1500)]
    groups = [(length, len(k)) for length, k, _ in suffix_dedup.maximal_repeats(list(range(1500)), [0] * 1500, cuts, 200)]
    assert (275, 1500) in groups and tracemalloc.get_traced_memory()[1] < 300e6
    tracemalloc.stop()


def test_language_id_on_held_out_rows(spark):
    kinds = {"aa": ["the", "ing", "tion", "er"], "bb": ["sch", "ung", "lich", "ei"], "cc": ["eau", "oi", "que", "re"]}
    rows = [(i, lang, " ".join("".join(RNG.choices(kinds[lang], k=2)) for _ in range(20))) for i, lang in enumerate(RNG.choices(list(kinds), k=300))]
    docs = spark.createDataFrame([*rows, (900, None, "123 !!"), (901, "aa", None), (902, None, "")], "doc_id long, lang string, text string")
    model = lang_id.fit(docs, common.remainder("doc_id", 3) != 1)
    out = {r.doc_id: r for r in lang_id.predict(docs, model).collect()}
    right = [out[i].lang_pred == lang for i, lang, _ in rows]
    assert np.mean(right) > 0.97 and all(0 <= r.score <= 1 for r in out.values())
    assert [out[i].lang_pred for i in (900, 901, 902)] == ["und"] * 3 and all(out[i].rejected for i in (900, 901, 902))
    assert sum(r.rejected for i, r in out.items() if i < 900) < 6


def test_language_id_learns_every_language_and_knows_letters(spark):
    rows = [(1000 * k + i, f"l{k:03d}", " ".join([f"{chr(0x4E00 + k)}{chr(0x5E00 + k)}"] * 5)) for k in range(300) for i in range(4)]
    docs = spark.createDataFrame([*rows, (900_001, None, "² ½ ① Ⅷ"), (900_002, None, "́ 1")], "doc_id long, lang string, text string")
    model = lang_id.fit(docs, F.lit(True), lang_id.Params(epochs=3, buckets=1 << 12))
    assert len(model.languages) == 300
    out = {r.doc_id: r for r in lang_id.predict(docs, model).collect()}
    assert all(out[i].lang_pred == "und" and out[i].rejected and out[i].score == 0 for i in (900_001, 900_002))
    assert all(out[i].lang_pred in model.languages for i, *_ in rows)


def test_language_id_scores_equal_direct_averaging(spark):
    rows = [(i, "aa" if i % 2 else "bb", ("ox en " if i % 2 else "zu ki ") * (1 + i % 4)) for i in range(60)]
    docs = spark.createDataFrame([*rows, (99, None, "Ox éa " * 50_000)], "doc_id long, lang string, text string")
    model = lang_id.fit(docs, F.lit(True), lang_id.Params(buckets=1 << 10, epochs=2))
    for r in lang_id.predict(docs, model).collect():
        text = next(t for i, _, t in [*rows, (99, None, "Ox éa " * 50_000)] if i == r.doc_id)
        ids = np.concatenate(lang_id.grams([text], model.buckets)[0])
        z = model.table[ids].astype(float).mean(0) + model.bias
        p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
        assert r.lang_pred == model.languages[int(p.argmax())] and r.score == pytest.approx(p.max(), abs=1e-6)


def test_language_id_with_nothing_to_learn_from(spark):
    docs = table(spark, EDGE).withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in lang_id.predict(docs, lang_id.fit(docs, F.lit(True))).collect()} == {"und"}


def test_lattice_marginal_sums_all_segmentations():
    m = lattice_lm.Lattice(["▁", "a", "b", "▁a", "ab", "▁ab", "ba"], np.log([0.1, 0.1, 0.1, 0.2, 0.1, 0.1, 0.1, 0.001, 0.1]))

    def brute(s):
        if not s:
            return 1.0
        return sum(math.exp(m.log_p[i]) * brute(s[len(p) :]) for i, p in enumerate(m.pieces) if s.startswith(p)) + (math.exp(len(s[0].encode()) * m.log_p[-2]) * brute(s[1:]) if s[0] not in "▁ab" else 0)

    for w in ("▁aba", "▁babab", "▁ab", "▁aéb"):
        total, expected = m.recursions([w], np.ones(1))
        assert math.exp(total[0]) == pytest.approx(brute(w))
    assert expected[-2] == pytest.approx(2)


def test_lattice_holds_vocabularies_of_any_size():
    signs = [chr(0x4E00 + i) for i in range(66)]
    pieces = [a + b + c for a in signs for b in signs for c in signs]  # 287,496 pieces, more than the least table has slots
    m = lattice_lm.Lattice(pieces, np.zeros(len(pieces) + 2))
    for i in (0, 1, 65, 70_000, len(pieces) - 1):
        _, found, lone, _ = m.edges([pieces[i]])
        assert {span: ids.tolist() for span, (_, ids) in found.items()} == {(0, 3): [i]} and lone.all()


def test_lattice_scores_and_base(spark):
    rows = [(i, prose(15)) for i in range(40)] + EDGE + [(60, "UPPER Upper upper")]
    docs = table(spark, rows)
    train = common.remainder("doc_id", 10) != 0
    for frequent in (5, 10_000):
        got = lattice_lm.score(docs, train, rounds=1, frequent=frequent).collect()
        assert len(got) == len(rows)
        import zlib
        from collections import Counter

        def tokens(t):
            return [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if w]

        learnt = [t for i, t in rows if zlib.crc32(("" if i is None else str(i)).encode()) % 10]
        c = Counter(w for t in learnt for w in tokens(t))
        n, v = sum(c.values()) + len(learnt), len(c) + 1
        want = sorted((i or -1, len(w := tokens(t)) + 1, sum(c[x] > 0 for x in w) + 1, n, round(sum(math.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w) + math.log10((len(learnt) + 0.1) / (n + 0.1 * (v + 1))), 6)) for i, t in rows)
        assert sorted((r.doc_id or -1, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
        assert all(r.score < 0 and math.isfinite(r.score) for r in got)


def test_url_rules_and_segmentation(spark):
    rules = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]
    urls = ["http://A.Example.com/en/1?x#y", "https://www.example.com/en/2", "http://x.com", "http://x.net/es/1", "nothing", None, "ftp://goldmine.org/fr/a", "http://example.com/de/", "http://notexample.com/en/1", "x://h?q=1/2", ""]
    pages = spark.createDataFrame([(i, u, "<p>gold mine gold mine red</p>") for i, u in enumerate(urls)], "page_id long, url string, html string").withColumn("host", F.lit(1)).withColumn("rule", F.lit(2))
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(pages, rules).collect()}
    assert got[0] == ("a.example.com", "/en/1", "example.com/en/", "block")
    assert got[1] == ("www.example.com", "/en/2", "www.example.com/en/", "allow")
    assert got[2][:3] == ("x.com", "", None) and got[3] == ("x.net", "/es/1", "net/es/", "block")
    assert got[4][:3] == ("", "", None) and got[5][:3] == ("", "", None) and got[10][:3] == ("", "", None)
    assert got[6][:3] == ("goldmine.org", "/fr/a", None) and got[9][:3] == ("h", "", None)
    assert got[7] == ("example.com", "/de/", "com/", "allow") and got[8][2:] == ("com/", "allow")
    assert all(v[3] in ("allow", "block") for v in got.values()) and len(got) == len(urls)
    assert url_filter.best_split("goldmine", {"gold": math.log(0.4), "mine": math.log(0.4)}, 10.0) == ["gold", "mine"]


def test_url_verdicts_equal_naive_bayes_by_hand(spark):
    from collections import Counter

    rules = [("good.org", "/", "allow"), ("bad.org", "/", "block")]
    g = random.Random(2)
    urls = [f"http://{h}.good.org/{g.choice(['news', 'daily'])}/{k}" for k, h in enumerate(["redcat", "catred", "cat"])] + [f"http://{h}.bad.org/{g.choice(['win', 'spin'])}/{10 * k}" for k, h in enumerate(["goldwin", "goldcat", "win"])]
    urls += ["http://goldred.net/win/1", "http://cat.net/daily/22", "http://unseen.net/", "http://" + "gold" * 60 + ".net/x", None, ""]
    html = "<p>red cat gold win red cat gold win org net good bad</p>"
    pages = spark.createDataFrame([(i, u, html) for i, u in enumerate([*urls, *urls[:2]])] + [(None, "http://cat.net/daily/22", None)], "page_id long, url string, html string")
    for c in ("name", "words", "word", "n", "token", "known", "score", "hit"):
        pages = pages.withColumn(c, F.lit("clash"))
    out = url_filter.judge(pages, rules).collect()
    assert len(out) == pages.count()
    vocabulary = {w: 1.0 for w in ("red", "cat", "gold", "win", "org", "net", "good", "bad", "p")}

    def tokens(u):
        m = re.match(r"http://([^/]*)(.*)", u or "")
        if not m:
            return []
        logs = {w: math.log(1 / 10) for w in vocabulary}
        host = [x for name in m[1].split(".") if name for x in url_filter.best_split(name, logs, 10.0)]
        return host + ["#" + str(len(t)) if t.isdigit() else "/" + t for t in m[2].split("/") if t]

    known = [(u, "allow" if "good.org" in u else "block") for u in [r.url for r in pages.select("url").collect()] if u and (".good.org" in u or ".bad.org" in u)]
    seen = {v: Counter(t for u, k in known if k == v for t in tokens(u)) for v in ("allow", "block")}
    v = len(set(seen["allow"]) | set(seen["block"]))
    prior = {k: sum(x == k for _, x in known) + 1 for k in seen}
    for r in out:
        u = next(x.url for x in pages.collect() if x.page_id == r.page_id)
        if r.rule is None:
            z = {k: math.log(prior[k]) + sum(math.log((c[t] + 1) / (sum(c.values()) + v + 1)) for t in tokens(u)) for k, c in seen.items()}
            unseen = [t for t in tokens(u) if not seen["allow"][t] and not seen["block"][t]]
            z = {k: z[k] - sum(math.log(1 / (sum(c.values()) + v + 1)) for _ in unseen) for k, c in seen.items()}
            assert r.verdict == ("block" if z["block"] > z["allow"] else "allow"), u


def test_label_model_posterior_equals_enumeration():
    g = np.random.default_rng(1)
    patterns = np.unique(g.integers(0, 1 << toxicity.VOTERS, 40))
    counts, told = g.integers(1, 50, len(patterns)).astype(float), g.integers(0, 3, (2, len(patterns))).astype(float)
    m = toxicity.LabelModel(patterns, counts, told, np.full(len(patterns), 0.3), 5)
    x = (patterns[:, None] >> np.arange(toxicity.VOTERS)) & 1
    assert sum(p < 0 for p in m.parent) == 1
    for row, got in zip(x, m.posterior(x)):
        p = [float(m.prior[c]) for c in (0, 1)]
        for c in (0, 1):
            for i, j in enumerate(m.parent):
                f = m.fires[c, i, row[j] if j >= 0 else 0]
                p[c] *= f if row[i] else 1 - f
        assert got == pytest.approx(p[1] / sum(p), rel=1e-6)


def brute_links(vectors, cosine):
    ok = {i: np.array(v, float) for i, v in vectors if v is not None and len(v) and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    width = max(map(len, ok.values()))
    unit = {i: np.pad(v, (0, width - len(v))) / np.linalg.norm(v) for i, v in ok.items()}
    return [(a, b) for a, b in combinations(unit, 2) if unit[a] @ unit[b] >= cosine]


def test_url_segmentation_takes_whole_names(spark):
    counts = spark.createDataFrame([("gold", 5), ("mine", 5), ("red", 2)], "word string, n long")
    name = "goldmine" * 10 + "red"
    got = url_filter.segmented(spark.createDataFrame([(name,), ("goldxyred",)], "name string"), counts).collect()
    assert {r["name"]: r["words"] for r in got} == {name: ["gold", "mine"] * 10 + ["red"], "goldxyred": ["gold", "xy", "red"]}
    assert "".join(url_filter.best_split("q" * 20000, {}, 12.0)) == "q" * 20000


def test_url_filter_takes_names_and_words_of_any_length(spark):
    letters = "abcdefghijklmnopqrstuvwxyz"
    host, word = "".join(RNG.choices(letters, k=20000)), "".join(RNG.choices(letters, k=20000))
    pages = spark.createDataFrame([(1, f"http://{host}.org/x", f"<p>{word} gold mine</p>"), (2, "http://goldmine.org/", "gold gold mine mine"), (3, f"http://{word[:3000]}gold.com/", f"{word[:3000]} {word[:3000]}")], "page_id long, url string, html string")
    out = {r.page_id: r for r in url_filter.judge(pages, [("com", "/", "allow")]).collect()}
    assert len(out) == 3 and out[1].host == f"{host}.org" and out[3].rule == "com/"
    counts = spark.createDataFrame([("gold", 4), (word[:3000], 5), (word[:2000], 1), (word, 2)], "word string, n long")
    got = {r.name: r.words for r in url_filter.segmented(spark.createDataFrame([(word + "gold",), (word[:3000] + "gold",), ("xgold",)], "name string"), counts).collect()}
    assert got == {word + "gold": [word, "gold"], word[:3000] + "gold": [word[:3000], "gold"], "xgold": ["x", "gold"]}


@pytest.mark.parametrize("seed", range(2))
def test_url_filter_segments_as_all_splits(spark, seed, monkeypatch):
    monkeypatch.setattr(url_filter, "PIECE", 3)  # so that words are met by their beginnings too
    g = random.Random(seed)
    words = {"".join(g.choices("ab", k=g.randint(1, 6))): g.randint(1, 50) for _ in range(12)}
    total = sum(words.values())
    names = ["".join(g.choices("abc", k=g.randint(1, 9))) for _ in range(30)]

    def value(parts):
        return sum(math.log(words[p] / total) if p in words else -math.log(total) - len(p) * math.log(10) for p in parts)

    def splits(n):
        return [[n]] + [[n[:k], *rest] for k in range(1, len(n)) for rest in splits(n[k:])]

    got = {r.name: r.words for r in url_filter.segmented(spark.createDataFrame([(n,) for n in names], "name string"), spark.createDataFrame(list(words.items()), "word string, n long")).collect()}
    assert set(got) == set(names)
    for n in names:
        assert "".join(got[n]) == n and abs(value(got[n]) - max(map(value, splits(n)))) < 1e-9


def test_embedding_dedup_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "BLOCK", 32)
    monkeypatch.setattr(embedding_dedup, "LEAF", 8)
    g = np.random.default_rng(2)
    centers = g.normal(size=(9, 12))
    rows = [(i, (centers[i % 9] * (i % 5 + 1) + g.normal(size=12) * 0.25).tolist()) for i in range(200)]
    rows += [(300, rows[0][1]), (301, rows[0][1]), (302, None), (303, []), (304, [0.0] * 12), (305, [1.0, None] + [0.0] * 10), (306, [float("nan")] * 12), (307, [float("inf")] * 12), (308, centers[0][:5].tolist())]
    got = {r.vec_id: r for r in embedding_dedup.link(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), 0.9).collect()}
    pairs = brute_links(rows, 0.9)
    want = components(pairs, [i for i, _ in rows])
    for i, _ in rows:
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (sum(i in p for p in pairs), want[i], want[i] == i)


def test_embedding_dedup_tells_rows_of_one_id_apart(spark):
    rows = [(1, [1.0, 0.0]), (2, [0.0, 1.0]), (2, [1.0, 0.1]), (2, [1.0, 0.1]), (5, [0.1, 1.0]), (None, [0.0, 2.0]), (None, [-1.0, 0.0]), (None, None), (7, [-1.0, 0.01])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for c in ("id", "m", "v", "own", "rep", "least", "n", "c", "reached"):
        df = df.withColumn(c, F.lit("clash"))
    got = sorted(((r.vec_id or 0, r.n_links, r.component_id, r.kept) for r in embedding_dedup.link(df, 0.9).collect()), key=str)
    want = [(1, 2, 1, True), (2, 2, 1, False), (2, 2, 1, False), (2, 2, 2, True), (5, 2, 2, False), (0, 2, 2, False), (0, 1, 7, False), (0, 0, None, True), (7, 1, 7, True)]
    assert got == sorted(want, key=str)


def test_embedding_dedup_of_nothing(spark):
    assert embedding_dedup.link(spark.createDataFrame([(1, None)], "vec_id long, embedding array<float>")).collect()[0].kept
    assert embedding_dedup.link(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_toxicity_on_held_out_rows(spark):
    bad = ["grobnak", "vilsten", "idiot"]
    rows, labels = [], []
    for i in range(600):
        toxic = int(RNG.random() < 0.3)
        w = prose(25).split()
        if toxic:
            for _ in range(3):
                w.insert(RNG.randrange(len(w)), RNG.choice(bad))
        rows.append((i, " ".join(w)))
        labels.append((i, toxic))
    docs, known = table(spark, rows + [(900 + i, t) for i, t in EDGE if i]).drop("label"), spark.createDataFrame([*labels, (900, None)], "doc_id long, toxic int")
    model = toxicity.fit(docs, known, common.remainder("doc_id", 5) != 0)
    out = {r.doc_id: r for r in toxicity.predict(docs, model).collect()}
    import zlib

    held = [(i, t) for i, t in labels if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([out[i].predicted == t for i, t in held]) > 0.95
    assert all(0 <= r.score <= 1 for r in out.values()) and out[901].predicted == 0


def test_toxicity_without_labels(spark):
    docs = table(spark, [(1, "you idiot and moron"), (2, "a calm day"), *[(i, prose(9)) for i in range(3, 60)]])
    model = toxicity.fit(docs, spark.createDataFrame([], "doc_id long, toxic int"), F.lit(True))
    assert toxicity.predict(docs, model).count() == 59


def test_pipeline_on_a_small_corpus(spark, tmp_path):
    import corpus_pipeline

    passage = prose(30)
    rows = [(i, prose(50), "en", "s", 1) for i in range(20)]
    rows += [(30, rows[0][1] + " end", "en", "s", 1), (31, passage, "en", "s", 1), (32, "%%% 123", "en", "s", 1), (33, prose(40) + " password=hunter2222", "en", "s", 1)]
    rows += [(None, prose(45) + " token: abcdef123", None, None, None), (40, None, "en", "s", None), (41, "", None, "s", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert set(out) == {*range(20), 33, None} and all(r.round_trip for r in out.values())
    text = sentencepiece_codec.decode(spark.createDataFrame([(33, out[33].ids)], "doc_id long, ids array<int>")).first().text
    assert text.endswith("[SECRET]")


@pytest.mark.parametrize("empty", [[], [(1, None)]])
def test_empty_tables(spark, empty):
    docs = table(spark, empty)
    n = len(empty)
    assert ngram_jaccard.link(docs).count() == n and suffix_dedup.remove_repeats(docs).count() == n and secret_scan.scan(docs).count() == n
    tagged = docs.withColumn("lang", F.lit(None).cast("string")).withColumn("toxic", F.lit(0))
    assert lang_id.predict(docs, lang_id.fit(tagged, F.lit(True))).count() == n
    assert toxicity.predict(docs, toxicity.fit(docs, tagged.select("doc_id", "toxic"), F.lit(True))).count() == n
    assert decontaminate.judge(docs, spark.createDataFrame([(1, "a b")], "item_id long, text string")).count() == n
    pages = docs.select(F.col("doc_id").alias("page_id"), F.col("text").alias("url"), F.col("text").alias("html"))
    assert url_filter.judge(pages, [("com", "/", "allow")]).count() == n
    assert sentencepiece_codec.encode(docs).count() == n and lattice_lm.score(docs, F.lit(True)).count() == n


def test_pipeline_of_empty_tables(spark, tmp_path):
    import corpus_pipeline

    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_texts_of_twenty_thousand_words_are_handled_whole(spark):
    """What stands at the very end of a text of 20,000 words is found by each operator."""
    long, passage = prose(20000).split(), prose(13)
    tail = f"{passage} password: hunter2secret"
    rows = [(1, " ".join(long) + " " + tail), (2, " ".join([*long[:500], "other", *long[501:]]) + " " + tail), (3, "zu " * 400 + "end")]
    docs = table(spark, rows)
    hit = {r.doc_id: r for r in decontaminate.judge(docs, spark.createDataFrame([(5, passage)], "item_id long, text string")).collect()}
    assert [(hit[i].n_hit, hit[i].n_words) for i in (1, 2)] == [(13, 20015)] * 2 and hit[3].n_hit == 0
    found = {r.doc_id: r for r in secret_scan.scan(docs).collect()}
    assert all(max(s["end"] for s in found[i].spans) == len(rows[i - 1][1]) for i in (1, 2))
    assert {r.doc_id: r.component_id for r in ngram_jaccard.link(docs, 4, 85).collect()} == {1: 1, 2: 1, 3: 3}
    assert all(r.round_trip for r in sentencepiece_codec.encode(docs).collect())
    left = {r.doc_id: r for r in suffix_dedup.remove_repeats(docs, least=200).collect()}
    assert left[1].n_removed > 0.9 * left[1].n_bytes and left[2].n_spans == 2
    score = {r.doc_id: r for r in lattice_lm.score(docs, F.lit(True)).collect()}
    assert score[1].n_tokens == 20016 and score[1].n_known == 20016


def test_embedding_intervals_meet_once_and_are_not_shuffled_with_each_pair(spark):
    rng = np.random.default_rng(2)
    low = rng.uniform(-1, 1, (25, 2))
    high = low + rng.uniform(0, 0.5, low.shape)
    rows = [((k % 3 << 32) + k, b"i", b"m", b"v", low[k].tolist(), high[k].tolist()) for k in range(25)]
    cut = spark.createDataFrame(rows, "block long, ids binary, m binary, v binary, lo array<double>, hi array<double>")
    pairs = embedding_dedup.block_pairs(cut, 0.4, 2)
    got = [tuple(sorted((r.a & 0xFFFF, r.b & 0xFFFF))) for r in pairs.collect()]
    gap = lambda i, j: np.linalg.norm(np.maximum(np.maximum(low[i] - high[j], low[j] - high[i]), 0))
    assert sorted(got) == [(i, j) for i in range(25) for j in range(i, 25) if gap(i, j) <= 0.4] and len(got) < 325
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "hashpartitioning" not in plan  # vectors were shuffled with each pair
