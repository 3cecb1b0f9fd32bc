"""Language identification: averaged hashed subword embeddings, a linear softmax, SGD in numpy, calibrated rejection.

A text is lower-cased and cut into character 1-, 2- and 3-grams; each n-gram is hashed to one of ``buckets`` embedding
rows, the rows are averaged over the text and a linear softmax gives the languages' probabilities. The model is trained on
a bounded sample of labelled rows (about ``Params.sample`` rows a language, and ``Params.rows`` in all, spread by a hash of the id); of
that sample a fifth is kept back to fit the softmax temperature and the rejection threshold. Because averaging and the linear layer commute,
the trained embedding times the output matrix is one small table of bucket scores, which is broadcast
(buckets x languages floats: every language that a row to learn from names is learnt, so its size is set by how many
languages there are, not by the corpus) and summed over each whole text.

A letter is a character of Unicode's general category L, in training and prediction alike.

Defined results: a null text, or one without a letter, gives ``und`` with score 0.0 and is rejected; with no labelled row
to learn from every text does. Ties go to the first language in sorted order. Repeated rows are scored each on their own; ids may be null. Very long texts
are averaged whole, a few at a time. An empty table gives an empty one.
Only the id and text columns are read for a prediction; other columns of the input never clash with the output.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

UND = "und"
LETTER = r"\p{L}"


@dataclass(frozen=True)
class Params:
    buckets: int = 1 << 15
    dim: int = 16
    sample: int = 1200  # labelled rows a language at most
    rows: int = 400_000  # labelled rows in all, about
    epochs: int = 6
    rate: float = 0.5
    keep: float = 0.999  # share of the calibration rows' true languages that rejection must leave
    floor: float = 0.5  # no threshold above this
    seed: int = 7


@dataclass(frozen=True)
class Model:
    languages: list[str]
    table: np.ndarray  # buckets x languages, temperature applied
    bias: np.ndarray
    threshold: float
    buckets: int


def grams(texts: list[str], buckets: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Bucket ids of the 1-, 2- and 3-grams that start at each character, and where each text starts."""
    padded = [f" {t.lower()} \0\0" for t in texts]
    code = np.frombuffer("".join(padded).encode("utf-32-le", "surrogatepass"), np.uint32)
    starts = np.cumsum([0, *map(len, padded)])[:-1]
    h, out, mask = code * np.uint32(2654435761), [], np.uint32(buckets - 1)
    nxt = h
    for n in range(3):
        if n:
            nxt = np.append(nxt[1:], np.uint32(0))
            h = (h ^ (h >> np.uint32(15))) * np.uint32(2246822519) + nxt * np.uint32(n + 1)
        out.append(((h ^ (h >> np.uint32(13))) * np.uint32(3266489917) >> np.uint32(9)) & mask)
    return out, starts


def _features(params: Params):
    def run(batches):
        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids, n = np.unique(np.concatenate(grams([text], params.buckets)[0]), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([ids.astype("<i4").tobytes()], pa.binary()), pa.array([(n / n.sum()).astype("<f4").tobytes()], pa.binary())], ["lang", "ids", "share"])

    return run


def fit(docs: DataFrame, train, params: Params = Params(), id_col="doc_id", text_col="text", lang_col="lang") -> Model:
    """train: a column that says which rows may be learnt from. A sampled row reaches the driver as at most `buckets` counts."""
    rows = docs.where(train & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text")).where(F.col("text").rlike(LETTER))
    counts = rows.groupBy("lang").agg(F.count("*").alias("n")).collect()  # a row a language
    langs = sorted(r["lang"] for r in counts)
    if not langs:
        return Model([], np.zeros((params.buckets, 0)), np.zeros(0), 0.0, params.buckets)
    most = min(params.sample, max(20, params.rows // len(langs)))
    shares = docs.sparkSession.createDataFrame([(r["lang"], min(1.0, most / r["n"])) for r in counts], "lang string, share double")
    draw = F.pmod(F.xxhash64("id", F.lit(params.seed)), F.lit(1_000_003)) / F.lit(1_000_003.0)
    sample = rows.join(F.broadcast(shares), "lang").where(draw < F.col("share")).select("lang", "text").limit(2 * most * len(langs))  # a row a language is broadcast
    got = sorted(sample.mapInArrow(_features(params), "lang string, ids binary, share binary").collect(), key=lambda r: (r["lang"], bytes(r["ids"]), bytes(r["share"])))
    x = [(np.frombuffer(r["ids"], "<i4"), np.frombuffer(r["share"], "<f4").astype(float)) for r in got]
    place = {lang: k for k, lang in enumerate(langs)}
    y = np.array([place[r["lang"]] for r in got])
    return train_model(x, y, langs, params)


def train_model(x: list, y: np.ndarray, langs: list[str], params: Params) -> Model:
    rng = np.random.default_rng(params.seed)
    emb = rng.normal(0, 0.5, (params.buckets, params.dim))
    out, bias = rng.normal(0, 0.1, (params.dim, len(langs))), np.zeros(len(langs))
    order = rng.permutation(len(y))
    held, learn = order[: len(y) // 5], order[len(y) // 5 :]
    steps, done = max(1, params.epochs * len(learn)), 0
    for _ in range(params.epochs):
        for i in rng.permutation(learn):
            ids, share = x[i]
            mean = share @ emb[ids]
            z = mean @ out + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y[i]] -= 1
            rate = params.rate * (1 - done / steps)
            back = out @ p
            out -= rate * np.outer(mean, p)
            bias -= rate * 0.1 * p
            emb[ids] -= (rate * 20 * share)[:, None] * back
            done += 1
    z = np.array([x[i][1] @ (emb[x[i][0]] @ out) + bias for i in held]).reshape(len(held), len(langs))

    def probs(t):
        p = np.exp(z / t - (z / t).max(1, keepdims=True))
        return p / p.sum(1, keepdims=True)

    temps = np.geomspace(0.1, 10, 41)
    best = min(temps, key=lambda t: -np.log(probs(t)[np.arange(len(held)), y[held]] + 1e-12).sum()) if len(held) else 1.0
    right = probs(best)[np.arange(len(held)), y[held]] if len(held) else np.ones(1)
    threshold = min(params.floor, float(np.quantile(right, 1 - params.keep)))
    return Model(langs, (emb @ out / best).astype(np.float32), bias / best, threshold, params.buckets)


def _score(model: Model):
    def part(texts: list[str], known: np.ndarray) -> tuple[list[str], np.ndarray]:
        k, n = len(model.languages), len(texts)
        ids, starts = grams(texts, model.buckets)
        total = 3 * np.diff([*starts, len(ids[0])])
        z = np.empty((n, k))
        for c in range(k):
            col = np.ascontiguousarray(model.table[:, c])
            z[:, c] = sum(np.add.reduceat(col[h], starts, dtype=np.float64) for h in ids) / total + model.bias[c]
        if not k:
            return [UND] * n, np.zeros(n)
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        lang = [model.languages[i] if ok else UND for i, ok in zip(p.argmax(1), known, strict=True)]
        return lang, np.where(known, p.max(1), 0.0)

    def run(batches):
        for b in batches:
            ids, texts, known = b.column(0), [t or "" for t in b.column(1).to_pylist()], b.column(2).to_numpy(zero_copy_only=False)
            lang, score, lo, size = [], [], 0, 0
            for i, t in enumerate(texts):
                size += len(t)
                if size > 1_000_000 or i == len(texts) - 1:
                    a, s = part(texts[lo : i + 1], known[lo : i + 1])
                    lang += a
                    score.append(s)
                    lo, size = i + 1, 0
            s = np.concatenate(score) if score else np.zeros(0)
            keep = [a != UND and v >= model.threshold for a, v in zip(lang, s, strict=True)]
            yield pa.RecordBatch.from_arrays([ids, pa.array(lang, pa.string()), pa.array(s), pa.array([not k for k in keep], pa.bool_())], ["id", "lang_pred", "score", "rejected"])

    return run


def predict(docs: DataFrame, model: Model, id_col="doc_id", text_col="text") -> DataFrame:
    """Rows (id_col, lang_pred, score, rejected), one a row of docs."""
    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text"), F.coalesce(text.rlike(LETTER), F.lit(False)).alias("letters"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(_score(model), f"id {kind}, lang_pred string, score double, rejected boolean").withColumnRenamed("id", id_col)
