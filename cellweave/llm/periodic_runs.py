"""Detection of periodic runs of words by string synchronising sets.

A run is a stretch of consecutive words with smallest period q and at least max(``LEAST``, ``TIMES`` * q) words that no neighbouring word extends
keeping period q. Runs are found in order of scale; at scale t = 1, 2, 4, ... those of periods from t to 2t - 1:

1. Each stretch of t words gets an identifier, a hash of the identifiers of its halves.
2. Stretches inside a run of a period of at most t / 4 are the highly periodic regions. Such runs have been detected at smaller scales, and
   supply the periods that are left out here.
3. Place i is in the synchronising set if the least identifier of the stretches that start from i to i + t, highly periodic ones apart, is
   that of i's or of i + t's stretch. Membership depends on the 2t words from i alone (its context), so a period repeats it; and of any
   t neighbouring places one is in the set, unless a highly periodic region holds them with their contexts.
4. A place of the set and the next one with an equal context, t to 2t - 1 words on, propose their distance as a period. A run of period
   q has at least 4q words, so one of its first t places is in the set and its context stands again q places on, inside the run;
   no nearer place has that context, since q is the smallest period.
5. Proposals of one period whose contexts touch are joined and extended by identifiers of halving length. What is long enough
   is compared word by word, and kept if no divisor of q is a period.

Every word is compared before a run is reported. A run could be missed only if two different stretches had one 64-bit identifier.

Texts go to tasks whole and are handled in batches; a text of n words takes n log n steps. Defined results: null and empty texts have no words and no
runs, and collapse to an empty text; repeated rows are judged each, null ids included; empty tables give empty ones; texts are
processed whole, whatever their length. Only the id and text columns are read, so others may clash.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEAST = 6
TIMES = 4  # at least 4, which step 4 needs
BATCH = 2_000_000  # characters handled at once


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def least_of(v: np.ndarray, width: int) -> np.ndarray:
    """The least of v[i:i + width] for each i that has so many: least values from both ends of blocks of that width."""
    n = len(v)
    rows = -(-n // width)
    block = np.full(rows * width, np.iinfo(np.uint64).max, np.uint64)
    block[:n] = v
    block = block.reshape(rows, width)
    ahead = np.minimum.accumulate(block, 1).ravel()
    back = np.minimum.accumulate(block[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(back[: n - width + 1], ahead[width - 1 : n])


def extended(ids: list[np.ndarray], x: np.ndarray, q: np.ndarray, forward: bool) -> np.ndarray:
    """How far beyond x (or before it) each place's word stays equal to that q on. ids: of stretches of 1, 2, 4, ... words."""
    far = np.zeros(len(x), np.int64)
    for level in range(len(ids) - 1, -1, -1):
        h, t, open_ = ids[level], 1 << level, np.arange(len(x))
        while len(open_):
            at = x[open_] + far[open_] if forward else x[open_] - far[open_] - t
            ok = (at >= 0) & (at + q[open_] < len(h))
            open_, at = open_[ok], at[ok]
            open_ = open_[h[at] == h[at + q[open_]]]
            far[open_] += t
            if level < len(ids) - 1:
                break
    return far


def smallest(words: np.ndarray, s: int, e: int, q: int) -> bool:
    """Whether words[s:e], of period q, has no smaller one, which would divide q."""
    left, p = q, 2
    while left > 1:
        if p * p > left:
            p = left
        if left % p == 0:
            d = q // p
            if (words[s : e - d] == words[s + d : e]).all():
                return False
            while left % p == 0:
                left //= p
        p += 1
    return True


def runs_of(words: np.ndarray, most: int) -> np.ndarray:
    """Rows (start, end, period) of all runs with TIMES periods in an array of whole numbers in which every text ends with a number of its
    own, so that no run crosses it; `most` is the longest text's length."""
    found = np.zeros((0, 3), np.int64)
    n, t = len(words), 1
    ids = [mixed(words.astype(np.uint64))]
    while TIMES * t <= most:
        h = ids[-1]  # of stretches of t words
        if n < 2 * t + 1:
            break
        masked = h.copy()
        if len(known := found[(found[:, 2] * 4 <= t) & (found[:, 1] - found[:, 0] >= t)]):
            inside = np.zeros(len(h) + 1, np.int64)
            np.add.at(inside, known[:, 0], 1)
            np.add.at(inside, known[:, 1] - t + 1, -1)
            masked[np.cumsum(inside[:-1]) > 0] = np.iinfo(np.uint64).max
        low = least_of(masked, t + 1)
        here = np.flatnonzero(((low == masked[: len(low)]) | (low == masked[t : t + len(low)])) & (low < np.iinfo(np.uint64).max))
        context = mixed(h[:-t] ^ (mixed(h[t:] + np.uint64(0x9E3779B97F4A7C15 + t)) << np.uint64(1)))
        by = np.argsort(context[here], kind="stable")
        place, same = here[by], context[here[by]]
        gap = np.diff(place)
        pair = np.flatnonzero((same[1:] == same[:-1]) & (gap >= t) & (gap < 2 * t))
        if len(pair):
            q, i = gap[pair], place[pair]
            by = np.lexsort((i, q))
            q, i = q[by], i[by]
            first = np.append(True, (q[1:] != q[:-1]) | (i[1:] > i[:-1] + 2 * t))
            lo, hi, q = i[first], i[np.append(np.flatnonzero(first)[1:] - 1, len(i) - 1)] + 2 * t, q[first]
            lo, hi = lo - extended(ids, lo, q, False), hi + extended(ids, hi, q, True) + q
            long = np.flatnonzero(hi - lo >= TIMES * q)
            rows = np.unique(np.column_stack([lo, hi, q])[long], axis=0)
            good = [(words[s : e - p] == words[s + p : e]).all() and smallest(words, s, e, p) for s, e, p in rows.tolist()]
            found = np.concatenate([found, rows[np.array(good, bool)]])
        ids.append(context)
        t *= 2
    return found[np.lexsort((found[:, 2], found[:, 0]))]


def dropped(runs: np.ndarray, n: int) -> np.ndarray:
    """Whether each word stands in a run after its first period."""
    inside = np.zeros(n + 1, np.int64)
    np.add.at(inside, runs[:, 0] + runs[:, 2], 1)
    np.add.at(inside, runs[:, 1], -1)
    return np.cumsum(inside[:-1]) > 0


def judged(texts: list[bytes]) -> list[tuple[int, np.ndarray, bytes]]:
    """(number of words, runs (start, end, period), collapsed text) of each text."""
    index: dict[bytes, int] = {}
    split = [t.split() for t in texts]  # bytes are split at white space of ASCII: x20 and x09-x0D
    # texts whose longest scale is the same go together, so that all their places matter at every scale
    size = [(len(w) // TIMES).bit_length() for w in split]
    out: list = [None] * len(texts)
    for k in set(size):
        mine = [i for i, s in enumerate(size) if s == k]
        many = np.array([len(split[i]) for i in mine])
        begin = np.cumsum(many + 1) - many - 1
        numbers = np.empty(int((many + 1).sum()), np.int64)
        for i, b, n in zip(mine, begin.tolist(), many.tolist(), strict=True):
            numbers[b : b + n] = [index.setdefault(w, len(index)) for w in split[i]]
        numbers[begin + many] = -1 - np.arange(len(mine))
        runs = runs_of(numbers, int(many.max()))
        runs = runs[runs[:, 1] - runs[:, 0] >= LEAST]
        gone = dropped(runs, len(numbers))
        cut = np.searchsorted(runs[:, 0], [*begin.tolist(), len(numbers)])
        for j, (i, b, n) in enumerate(zip(mine, begin.tolist(), many.tolist(), strict=True)):
            own, w = runs[cut[j] : cut[j + 1]], split[i]
            if len(own):
                w = [w[x] for x in np.flatnonzero(~gone[b : b + n]).tolist()]
            out[i] = (n, own - [b, b, 0], b" ".join(w))
    return out


RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def _detect(batches):
    for b in batches:
        texts = [t or b"" for t in b.column(1).cast(pa.binary()).to_pylist()]
        lo = size = 0
        for i, t in enumerate(texts):
            size += len(t)
            if size < BATCH and i < len(texts) - 1:
                continue
            rows = judged(texts[lo : i + 1])
            runs = np.concatenate([r for _, r, _ in rows])
            at = np.append(0, np.cumsum([len(r) for _, r, _ in rows])).astype(np.int32)
            flat = pa.StructArray.from_arrays([pa.array(runs[:, 0]), pa.array(runs[:, 1] - runs[:, 0]), pa.array(runs[:, 2])], ["start", "length", "period"])
            yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, len(rows)), pa.array([n for n, _, _ in rows], pa.int64()), pa.ListArray.from_arrays(pa.array(at), flat), pa.array([c for _, _, c in rows], pa.binary()).cast(pa.string())], ["id", "n_words", "runs", "collapsed"])
            lo, size = i + 1, 0


def detect(docs: DataFrame, id_col="doc_id", text_col="text") -> DataFrame:
    """Rows (id_col, n_words, runs array<struct<start,length,period>> by start and period, collapsed), one for each row of docs; collapsed: the
    words that no run holds after its first period, joined by blanks."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(_detect, f"id {kind}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string").withColumnRenamed("id", id_col)
