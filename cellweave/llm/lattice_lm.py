"""Language-model scoring by subword lattice likelihood.

A text is its words (runs without 0x20, 0x09-0x0D; A-Z lower-cased) and one end. A word, with the space mark in front, is
written by any of its segmentations into pieces of a given vocabulary; the word's probability is the sum over all
segmentations, found by a forward recursion in log space, and a text's is the product over its words and the end. As no
piece crosses the mark this is the marginal probability of the whole text under a unigram model of pieces.

The pieces' weights start from the existing vocabulary's stored scores (for a vocabulary that stores ranks, Zipf weights of
the ranks) and are re-estimated on the training words by ``rounds`` of expectation-maximisation with the start as a prior:
expected counts come from forward and backward recursions over the table of distinct words, weighted by the corpus count
of each, and are summed by Spark, so only one number a piece reaches the driver. A character that is no piece
is written as bytes of equal weight.

The base is a word unigram with 0.1 added to each count. Word counts stay in a Spark table. Scoring looks up
the ``FREQUENT`` most frequent words (a fixed number) in a broadcast; the other words of each text join the table by word, which
no frequent word can skew.

Defined results: null texts count as empty and consist of the end alone. With no training row the counts are zero and
the start weights are used. Rows with equal id and text are scored alike, each in a row of its own, null ids included; an empty table gives
an empty one. Texts and words have any length; a word takes time in proportion to its letters, about a millisecond a letter for one of
thousands. Only the id and text columns are read, so others may clash.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellweave.llm.common import stored

MARK = "▁"
VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
FREQUENT = 150_000
PRIOR = 2000.0  # weight of the vocabulary's own scores, in pieces
KEPT = 400_000  # distinct words that a task counts before it gives them away
BITS = 18  # of a slot in the table of pieces' beginnings, at least; more where the vocabulary needs them


def words(text: bytes) -> list[bytes]:
    """A text's words: of bytes only A-Z are lower-cased, and they are split at white space of ASCII, which is 0x20 and 0x09-0x0D."""
    return text.lower().split()


@dataclass
class Lattice:
    """Log weights of pieces; the last two entries are a byte of a character that is no piece, and the end of a text."""

    pieces: list[str]
    log_p: np.ndarray

    def __post_init__(self):
        alphabet = {c: i + 1 for i, c in enumerate(sorted(set("".join(self.pieces))))}
        self.lut = np.zeros(0x110000, np.uint64)
        for c, i in alphabet.items():
            self.lut[ord(c)] = i
        self.longest = max(map(len, self.pieces))
        places: dict[int, int] = {}
        with np.errstate(over="ignore"):
            for i, p in enumerate(self.pieces):  # all beginnings of pieces, so that a span that begins none ends its search
                h = np.uint64(0)
                for n, c in enumerate(p, 1):
                    h = h * BASE + np.uint64(alphabet[c])
                    places[int(h)] = max(i if n == len(p) else BEGINNING, places.get(int(h), BEGINNING))
        hashes = np.array(list(places), np.uint64)
        self.bits = max(BITS, (2 * len(places)).bit_length())  # at most half full
        self.hash, self.id = np.zeros(1 << self.bits, np.uint64), np.full(1 << self.bits, EMPTY)
        for h, k, i in zip(places, self.slot(hashes).tolist(), places.values(), strict=True):
            while self.id[k] != EMPTY:
                k = (k + 1) % len(self.id)
            self.hash[k], self.id[k] = h, i
        self.single = np.zeros(0x110000, bool)
        self.single[[ord(p) for p in self.pieces if len(p) == 1]] = True

    def slot(self, h: np.ndarray) -> np.ndarray:
        return ((h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Ids of the pieces with these hashes; BEGINNING: of pieces' beginnings only; EMPTY: none."""
        k = self.slot(h)
        out = self.id[k]
        left = np.flatnonzero((out != EMPTY) & (self.hash[k] != h))
        while len(left):
            k[left] = (k[left] + 1) % len(self.id)
            out[left] = self.id[k[left]]
            left = left[(out[left] != EMPTY) & (self.hash[k[left]] != h[left])]
        return out

    def edges(self, units: list[str]):
        """For units of one length: (from, to, ids) for each span that is a piece in some unit, and bytes of lone characters."""
        chars = np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(units), -1)
        code, n = self.lut[chars], chars.shape[1]
        lone = ~self.single[chars]
        width = np.where(chars < 0x80, 1, np.where(chars < 0x800, 2, np.where(chars < 0x10000, 3, 4)))
        found = {}
        for s in range(n):
            rows = np.flatnonzero(code[:, s])  # those whose span from s still begins a piece
            h = np.zeros(len(rows), np.uint64)
            for e in range(s + 1, min(n, s + self.longest) + 1):
                h = h * BASE + code[rows, e - 1]
                ids = self.find(h)
                if len(use := np.flatnonzero(ids >= 0)):
                    found[s, e] = rows[use], ids[use]
                go = ids != EMPTY
                rows, h = rows[go], h[go]
                if not len(rows):
                    break
        return n, found, lone, width

    @staticmethod
    def summed(first: np.ndarray, others: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """Log of the sum of exponentials of one value a unit and of further values of some units."""
        if not others:
            return first
        top = first.copy()
        for rows, v in others:
            top[rows] = np.maximum(top[rows], v)
        base = np.where(np.isfinite(top), top, 0.0)
        out = np.exp(first - base)
        for rows, v in others:
            out[rows] += np.exp(v - base[rows])
        with np.errstate(divide="ignore"):
            return np.log(out) + base

    def forward(self, units: list[str]) -> np.ndarray:
        return self.recursions(units, None)[0]

    def recursions(self, units: list[str], weights: np.ndarray | None):
        """Natural log of each unit's marginal probability and, with weights, the expected count of each piece."""
        n, found, lone, width = self.edges(units)
        byte = self.log_p[-2]
        a = np.full((n + 1, len(units)), -np.inf)
        a[0] = 0.0
        by_end, by_start = [[] for _ in range(n + 1)], [[] for _ in range(n + 1)]
        for (s, e), (rows, ids) in found.items():
            by_end[e].append((s, rows, self.log_p[ids]))
            by_start[s].append((e, rows, self.log_p[ids]))
        lone_log = np.where(lone, width * byte, -np.inf).T
        for e in range(1, n + 1):
            a[e] = self.summed(a[e - 1] + lone_log[e - 1], [(rows, a[s, rows] + p) for s, rows, p in by_end[e]])
        total = a[n]
        if weights is None:
            return total, None
        b = np.full((n + 1, len(units)), -np.inf)
        b[n] = 0.0
        for s in range(n - 1, -1, -1):
            b[s] = self.summed(lone_log[s] + b[s + 1], [(rows, p + b[e, rows]) for e, rows, p in by_start[s]])
        expected = np.zeros(len(self.log_p))
        for (s, e), (rows, ids) in found.items():
            share = np.exp(a[s, rows] + self.log_p[ids] + b[e, rows] - total[rows]) * weights[rows]
            expected += np.bincount(ids, share, len(self.log_p))
        for s in range(n):
            use = np.flatnonzero(lone[:, s])
            expected[-2] += (np.exp(a[s, use] + lone_log[s, use] + b[s + 1, use] - total[use]) * width[use, s] * weights[use]).sum()
        return total, expected


BASE = np.uint64(0x9E3779B97F4A7C15)
BEGINNING, EMPTY = -1, -2


def start(path: str = VOCABULARY) -> Lattice:
    """Weights from the vocabulary's stored scores: used as log probabilities if they sum to about one, else as ranks."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = [i for i in range(sp.get_piece_size()) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
    scores = np.array([sp.get_score(i) for i in ids], float)
    p = np.exp(scores) if 0.5 < np.exp(scores).sum() < 2 else 1 / (2 + np.argsort(np.argsort(-scores, kind="stable"), kind="stable"))
    p = p / p.sum() * 0.98
    return Lattice([sp.id_to_piece(i) for i in ids], np.log(np.append(p, [0.01 / 256, 0.01])))


def batched(values: list[str], limit: int = 20_000):
    """Positions of values of equal length, at most limit characters (or one value) at a time."""
    by: dict[int, list[int]] = {}
    for i, w in enumerate(values):
        by.setdefault(len(w), []).append(i)
    for n, at in by.items():
        step = max(1, limit * 10 // max(n, 1))
        for k in range(0, len(at), step):
            yield at[k : k + step]


def _expect(shared):
    def run(batches):
        m = shared.value
        total = np.zeros(len(m.log_p))
        for b in batches:
            w, c = [MARK + x for x in b.column(0).to_pylist()], b.column(1).to_numpy().astype(float)
            for at in batched(w):
                total += m.recursions([w[i] for i in at], c[at])[1]
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["piece", "n"])

    return run


def estimated(counts: DataFrame, texts: int, path: str = VOCABULARY, rounds: int = 2) -> Lattice:
    """counts: word, c. texts: number of training texts, each with an end."""
    model = start(path)
    prior = np.exp(model.log_p)
    prior[-2] *= 256
    prior /= prior.sum()
    for _ in range(rounds):
        shared = counts.sparkSession.sparkContext.broadcast(model)
        rows = counts.where("c > 0").select("word", "c").mapInArrow(_expect(shared), "piece long, n double").groupBy("piece").agg(F.sum("n").alias("n")).collect()
        n = PRIOR * prior
        n[-1] += texts
        for r in rows:
            n[r["piece"]] += r["n"]
        p = n / n.sum()
        p[-2] /= 256
        model = Lattice(model.pieces, np.log(p))
    return model


def _marginals(shared):
    def run(batches):
        m = shared.value
        for b in batches:
            w = [MARK + x for x in b.column("word").to_pylist()]
            out = np.zeros(len(w))
            for at in batched(w):
                out[at] = m.forward([w[i] for i in at])
            yield pa.RecordBatch.from_arrays([b.column("word"), b.column("c"), pa.array(out / np.log(10))], ["word", "c", "m"])

    return run


def _count(batches):
    """Rows (word, c, seen) of a task's texts, counted in parts: in training texts, and in all."""
    train, other = Counter(), Counter()

    def out():
        each = list(train | other)
        c = np.array([train[w] for w in each], np.int64)
        return pa.RecordBatch.from_arrays([pa.array(each, pa.binary()).cast(pa.string()), pa.array(c), pa.array(c + np.array([other[w] for w in each], np.int64))], ["word", "c", "seen"])

    for b in batches:
        for t, mine in zip(b.column(0).cast(pa.binary()).to_pylist(), b.column(1).to_pylist(), strict=True):
            (train if mine else other).update(words(t))
            if len(train) + len(other) > KEPT:
                yield out()
                train, other = Counter(), Counter()
    if train or other:
        yield out()


def _look_up(shared):
    """One row a text with the sums over its frequent words, and a row for each other word with its count."""
    names = ["id", "h", "word", "n", "rows", "n_tokens", "n_known", "base", "score"]

    def run(batches):
        index, known, base, score = shared.value
        for b in batches:
            ids, h, w = b.column("id"), b.column("h"), b.column("text").cast(pa.binary()).to_pylist()
            at, rare, many, sums = [], [], [], np.zeros((len(w), 4))
            for i, t in enumerate(w):
                tokens = words(t)
                met = [index.get(x, -1) for x in tokens]
                k = np.array(met, np.int64)
                if -1 in met:
                    for x, n in Counter(x for x, j in zip(tokens, met, strict=True) if j < 0).items():
                        at.append(i)
                        rare.append(x)
                        many.append(n)
                    k = k[k >= 0]
                sums[i] = len(tokens), known[k].sum(), base[k].sum(), score[k].sum()
            n, r = len(w), len(at)
            take = pa.array([*range(n), *at])
            number = lambda x, kind: pa.array(np.append(x, np.zeros(r)).astype(kind))
            yield pa.RecordBatch.from_arrays([ids.take(take), h.take(take), pa.array([None] * n + rare, pa.binary()).cast(pa.string()), pa.array([0] * n + many, pa.int64()), number(np.ones(n), np.int64), number(sums[:, 0], np.int64), number(sums[:, 1], np.int64), number(sums[:, 2], float), number(sums[:, 3], float)], names)

    return run


def score(docs: DataFrame, train: Column, path: str = VOCABULARY, rounds: int = 2, frequent: int = FREQUENT, id_col="doc_id", text_col="text") -> DataFrame:
    """Rows (id_col, n_tokens, n_known, train_tokens, base_score, score), one for each row of docs; logs are decimal."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("h"), text.alias("text"), F.coalesce(train, F.lit(False)).alias("train"))
    counted = rows.select("text", "train").mapInArrow(_count, "word string, c long, seen long")
    counts = stored(counted.groupBy("word").agg(F.sum("c").alias("c"), F.sum("seen").alias("seen")))
    texts = rows.where("train").count()
    got = counts.agg(F.sum("c").alias("n"), F.count(F.when(F.col("c") > 0, 1)).alias("v")).first()
    n_all, v = (got["n"] or 0) + texts, (got["v"] or 0) + (1 if texts else 0)
    model = estimated(counts, texts, path, rounds)
    shared = counts.sparkSession.sparkContext.broadcast(model)
    marginal = counts.select("word", "c").mapInArrow(_marginals(shared), "word string, c long, m double")
    table = stored(marginal)

    def base(c: Column) -> Column:
        return F.log10((c + 0.1) / F.lit(n_all + 0.1 * (v + 1)))

    top = counts.orderBy(F.desc("seen"), "word").limit(frequent).select("word")
    known = table.join(top, "word").select("word", (F.col("c") > 0).alias("k"), base(F.col("c")).alias("b"), "m").toPandas()
    lookup = counts.sparkSession.sparkContext.broadcast(({w.encode(): i for i, w in enumerate(known["word"])}, known["k"].to_numpy(float), known["b"].to_numpy(float), known["m"].to_numpy(float)))
    parts = rows.select("id", "h", "text").mapInArrow(_look_up(lookup), f"id {rows.schema['id'].dataType.simpleString()}, h long, word string, n long, rows long, n_tokens long, n_known long, base double, score double")
    parts = stored(parts)
    rare = parts.where("word IS NOT NULL").select("id", "h", "word", "n").join(table, "word")
    rare = rare.select("id", "h", F.lit(0).cast("long").alias("rows"), F.lit(0).cast("long").alias("n_tokens"), F.when(F.col("c") > 0, F.col("n")).otherwise(0).alias("n_known"), (F.col("n") * base(F.col("c"))).alias("base"), (F.col("n") * F.col("m")).alias("score"))
    both = parts.where("word IS NULL").drop("word", "n").unionByName(rare)
    out = both.groupBy("id", "h").agg(*[F.sum(c).alias(c) for c in ("rows", "n_tokens", "n_known", "base", "score")])
    end = float(model.log_p[-1] / np.log(10))
    each = out.select("*", F.explode(F.sequence(F.lit(1), F.col("rows").cast("int"))))
    per = lambda c: F.col(c) / F.col("rows")
    return each.select(
        F.col("id").alias(id_col), (per("n_tokens") + 1).cast("long").alias("n_tokens"), (per("n_known") + int(texts > 0)).cast("long").alias("n_known"), F.lit(n_all).cast("long").alias("train_tokens"),
        (per("base") + base(F.lit(float(texts)))).alias("base_score"), (per("score") + end).alias("score"),
    )
