"""Toxicity by weak supervision.

1. Voters. ``induce`` counts words and word beginnings on a bounded sample of labelled training rows (``Params.labelled`` a class)
   and deals those that mark toxic texts into lexicon voters; a public lexicon of insults and patterns (repeated
   exclamation marks, words in capitals, several lexicon words) vote too. A voter fires or abstains.
2. Label model. Every training row votes; Spark counts the vote patterns (at most 2 ** VOTERS of them, whatever the
   corpus). A generative model P(class) * prod P(vote | class, parent vote), the parents being the
   maximum-weight tree of the votes' correlations within the classes, is fitted to these counts by expectation-maximisation,
   which estimates each voter's accuracies and the correlations of pairs; labelled training rows keep their class in it.
3. Classifier. A bounded sample of training rows (``Params.sample``), spread over likely and unlikely posteriors, trains a logistic
   model on the posterior labels: weights of hashed words and word beginnings, counted once per distinct word.

A text's score is the logistic of bias plus the weights of its distinct words, over the whole text; the weights have a
fixed size and are broadcast. Labels, language, source and id are never inputs of a score.

Defined results: null and empty texts score the logistic of the bias; an empty table gives an empty one. Rows with a null id are
scored and not learnt from. Texts are scored whole, whatever their length. Only the named columns are read, so others may clash. With no labelled training row the public lexicon and
patterns alone vote. Of several labels of one row the greatest counts. Repeated rows are scored each.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = re.compile(r"[^\W\d_]+")
SHOUT = re.compile(r"!!|\?!|!\?")
# A public lexicon of common English insults, a voter of its own.
INSULTS = ["idiot", "stupid", "moron", "loser", "pathetic", "trash", "scum", "worthless", "disgusting", "clown", "dumb", "jerk", "fool", "imbecile", "freak", "bastard", "crap", "shit", "fuck", "bitch"]
SHARDS = 8
MEMORY = 300_000  # words whose votes or weights a task remembers
VOTERS = SHARDS + 4  # the shards, the public lexicon, shouting, capitals, several lexicon words


@dataclass(frozen=True)
class Params:
    labelled: int = 4000  # labelled rows a class that lexicons are induced from
    least: int = 3  # toxic sample texts that a mark must stand in
    odds: float = 12.0  # times likelier in toxic texts, at least
    evidence: float = 10.0  # log-likelihood that a mark's toxic texts aren't chance, at least
    sample: int = 3000  # rows for the classifier on each side of the posterior
    buckets: int = 1 << 18
    epochs: int = 10
    rate: float = 0.3
    penalty: float = 3e-3
    gain: float = 8.0  # log-likelihood gain that a bucket must bring to have a weight
    rounds: int = 30
    seed: int = 5


def marks(word: str) -> list[str]:
    """A word and its beginnings, as features."""
    return [word, *(f"{word[:n]}*" for n in (4, 5, 6) if len(word) > n)]


def distinct(text: str | None) -> set[str]:
    return set(WORD.findall((text or "").lower()))


def _counts(batches):
    total: Counter = Counter()
    for b in batches:
        for text, toxic in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            total.update((m, toxic) for m in {m for w in distinct(text) for m in marks(w)})
    rows = list(total.items())
    yield pa.RecordBatch.from_arrays([pa.array([k[0] for k, _ in rows], pa.string()), pa.array([k[1] for k, _ in rows], pa.int32()), pa.array([n for _, n in rows], pa.int64())], ["mark", "toxic", "n"])


def induce(rows: DataFrame, labels: DataFrame, params: Params) -> tuple[list[str], float]:
    """Marks of toxic texts, best first, and the labelled share of toxic rows. rows: id, text; labels: id, toxic. All marks that pass the
    tests are kept; there are no more of them than the bounded sample of labelled texts holds."""
    sizes = {r["toxic"]: r["n"] for r in labels.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if len(sizes) < 2:
        return [], 0.1
    draw = F.pmod(F.xxhash64("id", F.lit(params.seed)), F.lit(1_000_003)) / F.lit(1_000_003.0)
    share = F.when(F.col("toxic") == 1, min(1.0, params.labelled / sizes[1])).otherwise(min(1.0, params.labelled / sizes[0]))
    chosen = labels.where(draw < share).limit(4 * params.labelled)
    sample = rows.join(F.broadcast(chosen), "id").select("text", "toxic")  # at most 4 * labelled ids
    seen = sample.mapInArrow(_counts, "mark string, toxic int, n long").groupBy("mark").agg(F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).alias("p"), F.sum(F.when(F.col("toxic") == 0, F.col("n")).otherwise(0)).alias("q"))
    pos, neg = min(params.labelled, sizes[1]), min(params.labelled, sizes[0])
    odds = (F.col("p") / pos) / ((F.col("q") + 0.5) / neg)
    evidence = F.col("p") * F.log(F.col("p") / (F.col("p") + F.col("q")) * ((pos + neg) / pos))
    top = seen.where((F.col("p") >= params.least) & (odds >= params.odds) & (evidence >= params.evidence)).orderBy(F.desc("p"), "mark")
    return [r["mark"] for r in top.collect()], sizes[1] / (sizes[0] + sizes[1])


class Voters:
    def __init__(self, lexicon: list[str]):
        self.bit: dict[str, int] = {}
        for k, m in enumerate(lexicon):
            self.bit[m] = 1 << (k % SHARDS)
        self.public = set(INSULTS)
        self.known: dict[str, int] = {}  # votes of words met, cleared when it holds MEMORY words

    def of(self, word: str) -> int:
        """The lexicon voters that a word fires."""
        fired = 1 << SHARDS if word in self.public else 0
        for m in marks(word):
            fired |= self.bit.get(m, 0)
        if len(self.known) >= MEMORY:
            self.known.clear()
        self.known[word] = fired
        return fired

    def vote(self, text: str | None) -> int:
        out = hits = 0
        text = text or ""
        for w in distinct(text):
            fired = self.known.get(w)
            if fired is None:
                fired = self.of(w)
            if fired:
                out |= fired
                hits += 1
        if SHOUT.search(text):
            out |= 1 << SHARDS + 1
        parts = text.split()
        upper = sum(map(str.isupper, parts))  # short words too: more than those in capitals, and cheap
        if upper * 10 > len(parts) and sum(w.isupper() and len(w) > 2 for w in parts) * 10 > len(parts):
            out |= 1 << SHARDS + 2
        return out | (hits > 1) << SHARDS + 3


def _votes(shared):
    def run(batches):
        v = Voters(shared.value)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([v.vote(t) for t in b.column(1).to_pylist()], pa.int32())], ["id", "votes"])

    return run


class LabelModel:
    """P(toxic) and, for each voter, P(fires | class, whether its parent fires), over a tree of correlations."""

    def __init__(self, patterns: np.ndarray, counts: np.ndarray, told: np.ndarray, first: np.ndarray, rounds: int):
        """counts: rows of each pattern without a label; told: rows labelled 0 and 1, whose class is given."""
        x = (patterns[:, None] >> np.arange(VOTERS)) & 1
        post = first
        for _ in range(rounds):
            weights = np.stack([counts * (1 - post), counts * post]) + told
            self.fit(x, weights)
            post = self.posterior(x)
        self.by_pattern = dict(zip(patterns.tolist(), post.tolist(), strict=True))

    def fit(self, x: np.ndarray, weights: np.ndarray) -> None:
        self.prior = (weights.sum(1) + 1) / (weights.sum() + 2)
        info = np.zeros((VOTERS, VOTERS))
        for w in weights:  # conditional mutual information of each pair of votes
            n = w.sum() + 4
            p = ((x * w[:, None]).sum(0) + 2) / n
            both = ((x.T * w) @ x + 1) / n
            for joint, a, b in ((both, p[:, None], p[None]), (p[:, None] - both, p[:, None], 1 - p[None]), (p[None] - both, 1 - p[:, None], p[None]), (1 - p[:, None] - p[None] + both, 1 - p[:, None], 1 - p[None])):
                joint = np.maximum(joint, 1e-12)
                info += n / max(weights.sum(), 1.0) * joint * np.log(joint / np.maximum(a * b, 1e-12))
        self.parent, inside = [-1] * VOTERS, {0}
        while len(inside) < VOTERS:
            j, i = max(((j, i) for j in inside for i in range(VOTERS) if i not in inside), key=lambda e: (info[e], -e[0], -e[1]))
            self.parent[i] = j
            inside.add(i)
        self.fires = np.zeros((2, VOTERS, 2))  # class, voter, parent's vote
        for c, w in enumerate(weights):
            for i, j in enumerate(self.parent):
                up = x[:, j] if j >= 0 else np.zeros(len(x), int)
                for u in (0, 1):
                    use = w * (up == u)
                    self.fires[c, i, u] = ((use * x[:, i]).sum() + 0.1) / (use.sum() + 0.2 + (10 if j >= 0 and u else 0))

    def posterior(self, x: np.ndarray) -> np.ndarray:
        logs = np.log(self.prior)[:, None] + np.zeros((2, len(x)))
        for i, j in enumerate(self.parent):
            up = x[:, j] if j >= 0 else np.zeros(len(x), int)
            p = self.fires[:, i, :][:, up]
            logs += np.where(x[:, i], np.log(p), np.log1p(-p))
        return 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -500, 500)))


def buckets_of(words: set[str], size: int) -> tuple[np.ndarray, np.ndarray]:
    return np.unique([zlib.crc32(m.encode("utf-8", "surrogatepass")) & (size - 1) for w in words for m in marks(w)], return_counts=True) if words else (np.zeros(0, int), np.zeros(0, int))


def _features(size: int):
    def run(batches):
        for b in batches:
            for text, p in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                at, n = buckets_of(distinct(text), size)
                yield pa.RecordBatch.from_arrays([pa.array([at.astype("<i4").tobytes()], pa.binary()), pa.array([n.astype("<f4").tobytes()], pa.binary()), pa.array([p])], ["at", "n", "p"])

    return run


def train(x: list, y: np.ndarray, params: Params) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels by stochastic gradient descent with per-weight rates and an absolute-value penalty.
    Buckets whose split over the labels has a log-likelihood gain under `gain` keep weight zero."""
    rng = np.random.default_rng(params.seed)
    p, q, mean = np.zeros(params.buckets), np.zeros(params.buckets), float(y.mean()) if len(y) else 0.5
    for (at, _), v in zip(x, y.tolist(), strict=True):
        p[at] += v
        q[at] += 1 - v
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = np.nan_to_num(p * np.log(p / (p + q) / mean)) + np.nan_to_num(q * np.log(q / (p + q) / (1 - mean)))
    use = (gain >= params.gain) & (p + q > 0)
    x = [(at[use[at]], np.minimum(n[use[at]], 3)) for at, n in x]
    w, seen, bias, bias_seen = np.zeros(params.buckets), np.full(params.buckets, 1e-2), 0.0, 1e-2
    for _ in range(params.epochs):
        for i in rng.permutation(len(y)):
            at, n = x[i]
            g = 1 / (1 + np.exp(-np.clip(bias + n @ w[at], -30, 30))) - y[i]
            seen[at] += (g * n) ** 2
            rate = params.rate / np.sqrt(seen[at])
            now = w[at] - rate * g * n
            w[at] = np.sign(now) * np.maximum(np.abs(now) - rate * params.penalty, 0)
            bias_seen += g * g
            bias -= params.rate * g / np.sqrt(bias_seen)
    return w.astype(np.float32), float(bias)


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    bias: float


def fit(docs: DataFrame, labels: DataFrame, train_rows: Column, params: Params = Params(), id_col="doc_id", text_col="text", label_col="toxic") -> Model:
    rows = docs.where(train_rows & F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    known = labels.where(train_rows & F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).alias("id")).agg(F.max(F.col(label_col).cast("int")).alias("toxic"))
    lexicon, share = induce(rows, known, params)
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(lexicon)
    votes = rows.mapInArrow(_votes(shared), f"id {rows.schema['id'].dataType.simpleString()}, votes int")
    counted = votes.join(known, "id", "left").groupBy("votes").agg(F.count("*").alias("n"), F.sum(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("p"), F.sum(F.when(F.col("toxic") == 0, 1).otherwise(0)).alias("q")).orderBy("votes").collect()
    patterns = np.array([r["votes"] for r in counted], np.int64)
    n, p, q = (np.array([r[c] for r in counted], float) for c in ("n", "p", "q"))
    first = (p + share) / (p + q + 1) if len(lexicon) else np.where(patterns >> SHARDS & 1, 0.9, 0.05)
    label_model = LabelModel(patterns, n - p - q, np.stack([q, p]), first, params.rounds)
    return classifier(rows, shared, label_model, dict(zip(patterns.tolist(), n.tolist(), strict=True)), params)


def classifier(rows: DataFrame, shared, label_model: LabelModel, sizes: dict[int, float], params: Params) -> Model:
    side = {v: p > 0.5 for v, p in label_model.by_pattern.items()}
    total = {s: sum(n for v, n in sizes.items() if side[v] == s) for s in (False, True)}
    keep = {s: min(1.0, params.sample / max(total[s], 1)) for s in total}
    posterior, seed = label_model.by_pattern, params.seed

    def chosen(batches):
        v = Voters(shared.value)
        for b in batches:
            at, p = [], []
            for i, (t, draw) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)):
                if draw < max(keep.values()):
                    pattern = v.vote(t)
                    if draw < keep[side[pattern]]:
                        at.append(i)
                        p.append(posterior[pattern])
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), pa.array(p, pa.float64())], ["text", "p"])

    draw = F.pmod(F.xxhash64("id", F.lit(seed + 1)), F.lit(1_000_003)) / F.lit(1_000_003.0)
    sample = rows.select("text", draw.alias("draw")).mapInArrow(chosen, "text string, p double").mapInArrow(_features(params.buckets), "at binary, n binary, p double").limit(4 * params.sample)
    got = sorted(((bytes(r["at"]), bytes(r["n"]), r["p"]) for r in sample.collect()))
    x = [(np.frombuffer(a, "<i4"), np.frombuffer(n, "<f4").astype(float)) for a, n, _ in got]
    y = np.array([p for *_, p in got])
    w, bias = train(x, y, params)
    return Model(w, bias)


def _score(shared, size: int):
    def run(batches):
        model, known = shared.value, {}
        w, bias = model.weights, model.bias
        for b in batches:
            out = []
            for text in b.column(1).to_pylist():
                words = distinct(text)
                total = Counter()
                z = bias
                for x in words:
                    f = known.get(x)
                    if f is None:
                        if len(known) >= MEMORY:
                            known.clear()
                        f = known[x] = tuple(k for m in marks(x) if w[k := zlib.crc32(m.encode("utf-8", "surrogatepass")) & (size - 1)])
                    if f:
                        total.update(f)
                for k, n in total.items():
                    z += float(w[k]) * min(n, 3)
                out.append(1 / (1 + np.exp(-max(-60.0, min(60.0, z)))))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.float64())], ["id", "score"])

    return run


def predict(docs: DataFrame, model: Model, id_col="doc_id", text_col="text") -> DataFrame:
    """Rows (id_col, score, predicted), one for each row of docs."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    out = rows.mapInArrow(_score(shared, len(model.weights)), f"id {rows.schema['id'].dataType.simpleString()}, score double")
    return out.select(F.col("id").alias(id_col), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
