"""Hard-negative mining: Strassen products of whole-number tiles, then mergeable heaps.

1. Components become whole numbers (floor(scale * x)); rows are sorted by id and cut into blocks by a range partitioning, candidates and
   anchors alike, stored as matrices of the narrowest type that holds them.
2. Every block of anchors meets every block of candidates (a stated query set against all rows, in blocks), some neighbouring blocks a
   cogroup; a task multiplies two blocks by Strassen's recursion on int64 tiles padded with zeros, whose additions are exact.
3. Positives: of a tile each anchor keeps its best rows of the same label; these short lists are heaps that are merged over the tiles of
   a cogroup, and over cogroups by rank.
4. Windows: the tiles are multiplied again, and of each the rows of another label whose scores lie in a positive's window give its best
   few; these lists are merged in the same way.

No score matrix is stored or shuffled: what leaves a cogroup is at most ``positives`` * ``negatives`` rows an anchor. A cogroup holds one block of
anchors and GROUP blocks of candidates or so (blocks are dealt by hash), whatever the number of rows.

Defined results: rows with a null id or label, or a null vector, or a vector with a null or non-finite component take no part; an empty
vector counts as zeros, and of vectors of different lengths the shorter is padded with zeros. Rows alike in id, label and vector count as
one; rows that share an id but differ are each their own row and anchor. Ties go by id, then label, then vector. Scores are exact while
they fit in 64 bits (all sums are modulo 2^64, floors beyond 64 bits are clamped). Without anchors or positives the result is empty, and so it is for
an empty table. Only the id, label and vector columns are read, so others may clash.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from cellweave.llm.common import stored

ANCHORS = 512  # rows of a block of anchors
CANDIDATES = 2048
GROUP = 8  # blocks of candidates a cogroup, on average
LEAF = 32  # a side at which tiles are multiplied plainly
NONE = np.iinfo(np.int64).min


def strassen(a: np.ndarray, b: np.ndarray, leaf: int = LEAF) -> np.ndarray:
    """a @ b of int64, modulo 2^64: seven products of halves a level, odd sides padded by a zero row or column."""
    if min(a.shape[0], a.shape[1], b.shape[1]) <= leaf:
        return a @ b
    rows, columns = a.shape[0], b.shape[1]
    odd = [s % 2 for s in (*a.shape, columns)]
    if any(odd):
        a, b = np.pad(a, ((0, odd[0]), (0, odd[1]))), np.pad(b, ((0, odd[1]), (0, odd[2])))
    m, k, n = a.shape[0] // 2, a.shape[1] // 2, b.shape[1] // 2
    a11, a12, a21, a22 = a[:m, :k], a[:m, k:], a[m:, :k], a[m:, k:]
    b11, b12, b21, b22 = b[:k, :n], b[:k, n:], b[k:, :n], b[k:, n:]
    p1, p2 = strassen(a11 + a22, b11 + b22, leaf), strassen(a21 + a22, b11, leaf)
    p3, p4 = strassen(a11, b12 - b22, leaf), strassen(a22, b21 - b11, leaf)
    p5, p6, p7 = strassen(a11 + a12, b22, leaf), strassen(a21 - a11, b11 + b12, leaf), strassen(a12 - a22, b21 + b22, leaf)
    return np.block([[p1 + p4 - p5 + p7, p3 + p5], [p2 + p4, p1 - p2 + p3 + p6]])[:rows, :columns]


def narrow(x: np.ndarray) -> bytes:
    """The matrix in the narrowest type that holds it; its first byte says how many bytes a number has."""
    for kind in (np.int8, np.int16, np.int32):
        if not x.size or (x.min() >= np.iinfo(kind).min and x.max() <= np.iinfo(kind).max):
            return bytes([np.dtype(kind).itemsize]) + x.astype(kind).tobytes()
    return bytes([8]) + x.tobytes()


def wide(raw: bytes, rows: int) -> np.ndarray:
    return np.frombuffer(raw, f"<i{raw[0]}", offset=1).reshape(rows, -1).astype(np.int64)


def longs(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, "<i8")


def raw_longs(*columns) -> list[pa.Array]:
    return [pa.array([np.asarray(c).astype("<i8").tobytes()], pa.binary()) for c in columns]


def matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """Lists of whole numbers as rows, with zeros up to width."""
    flat = column.combine_chunks()
    n = flat.value_lengths().to_numpy(zero_copy_only=False)
    x = np.zeros((len(n), width), np.int64)
    x[np.repeat(np.arange(len(n)), n), np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)] = flat.flatten().to_numpy(zero_copy_only=False)
    return x


def _cut(width: int, size: int):
    """Blocks of `size` rows of a sorted partition; its last may be short."""

    def block(part: int, k: int, t: pa.Table):
        columns = raw_longs(t.column("id").to_numpy(), t.column("label").to_numpy(), t.column("anchor").to_numpy())
        return pa.RecordBatch.from_arrays([pa.array([(part << 32) + k]), *columns, pa.array([narrow(matrix(t.column("v"), width))], pa.binary())], ["block", "ids", "labels", "anchors", "v"])

    def run(batches):
        part, k, left = TaskContext.get().partitionId(), 0, None
        for b in batches:
            t = pa.Table.from_batches([b])
            left = t if left is None else pa.concat_tables([left, t])
            while left.num_rows >= size:
                yield block(part, k, left.slice(0, size))
                left, k = left.slice(size), k + 1
        if left is not None and left.num_rows:
            yield block(part, k, left)

    return run


def _anchors(batches):
    """A row for each anchor of the candidates' blocks, with its place there."""
    for b in batches:
        for r in b.to_pylist():
            ids, at = longs(r["ids"]), np.flatnonzero(longs(r["anchors"]))
            v = wide(r["v"], len(ids))[at]
            columns = [np.full(len(at), r["block"]), at, ids[at], longs(r["labels"])[at]]
            yield pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.array([narrow(x) for x in v], pa.binary())], ["a_block", "a_at", "anchor_id", "a_label", "av"])


def _gathered(key, t):
    """The anchors of one block as matrices, and their windows as rows (anchor's row, score, block and place of the positive)."""
    wins = [(row, *w) for row, of in enumerate(t.column("wins").to_pylist()) for w in ((x["score"], x["block"], x["at"]) for x in of or [])]
    v = np.concatenate([wide(x, 1) for x in t.column("av").to_pylist()])
    columns = raw_longs(t.column("a_label").to_numpy(), t.column("a_block").to_numpy(), t.column("a_at").to_numpy(), np.array(wins, np.int64).reshape(-1, 4))
    return pa.table([pa.array([key[0].as_py()], pa.int64()), *columns, pa.array([narrow(v)], pa.binary())], ["a", "a_labels", "a_blocks", "a_ats", "wins", "av"])


def best(score: np.ndarray, keep: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of each row's `most` highest scores where keep, in order; the earlier column on ties."""
    order = np.argsort(~np.where(keep, score, NONE), axis=1, kind="stable")[:, :most]
    row = np.repeat(np.arange(len(score)), order.shape[1])
    column = order.ravel()
    ok = keep[row, column]
    return row[ok], column[ok]


def merged(a: np.ndarray, b: np.ndarray, keys: int, most: int) -> np.ndarray:
    """Two heaps as one: of each key the `most` rows of highest score, then first in order. Rows: key..., score, block, place, id."""
    rows = np.concatenate([a, b])
    if not len(rows):
        return rows
    rows = rows[np.lexsort((rows[:, keys + 2], rows[:, keys + 1], ~rows[:, keys], *[rows[:, j] for j in range(keys - 1, -1, -1)]))]
    begin = np.flatnonzero(np.append(True, (rows[1:, :keys] != rows[:-1, :keys]).any(1)))
    rank = np.arange(len(rows)) - np.repeat(begin, np.diff(np.append(begin, len(rows))))
    return rows[rank < most]


def positives_of(score: np.ndarray, r: dict, a: dict, most: int) -> np.ndarray:
    """Each anchor's best other rows of its label in a tile."""
    ids, blocks, ats = longs(r["ids"]), longs(a["a_blocks"]), longs(a["a_ats"])
    own = (blocks[:, None] == r["block"]) & (ats[:, None] == np.arange(len(ids)))
    i, j = best(score, (longs(a["a_labels"])[:, None] == longs(r["labels"])) & ~own, most)
    return np.column_stack([blocks[i], ats[i], score[i, j], np.full(len(i), r["block"]), j, ids[j]])


def window(positive: int, low: int, high: int, base: int) -> tuple[int, int]:
    """The least and greatest s with low * positive <= base * s <= high * positive."""
    return -(-low * positive // base), high * positive // base


def negatives_of(score: np.ndarray, r: dict, a: dict, most: int, low: int, high: int, base: int) -> np.ndarray:
    """For each window the best rows of another label in a tile."""
    ids, labels, a_labels, blocks, ats = longs(r["ids"]), longs(r["labels"]), longs(a["a_labels"]), longs(a["a_blocks"]), longs(a["a_ats"])
    order, found, now = np.argsort(~score, axis=1, kind="stable"), [np.zeros((0, 8), np.int64)], None
    for row, positive, p_block, p_at in longs(a["wins"]).reshape(-1, 4).tolist():
        if row != now:
            now, line = row, order[row][labels[order[row]] != a_labels[row]]
            s = score[row, line]
        least, greatest = window(positive, low, high, base)
        j = line[np.flatnonzero((s >= least) & (s <= greatest))[:most]]
        found.append(np.column_stack([np.tile([blocks[row], ats[row], p_block, p_at], (len(j), 1)), score[row, j], np.full(len(j), r["block"]), j, ids[j]]))
    return np.concatenate(found)


def _tiles(pick, names: list[str], keys: int, most: int):
    def run(candidates, anchors):
        heap = np.zeros((0, len(names)), np.int64)
        for a in anchors.to_pylist():
            left = wide(a["av"], len(a["a_ats"]) // 8)
            for r in candidates.to_pylist():
                right = np.ascontiguousarray(wide(r["v"], len(r["ids"]) // 8).T)
                heap = merged(heap, pick(strassen(left, right), r, a), keys, most)
        return pa.table([pa.array(np.ascontiguousarray(heap[:, j])) for j in range(len(names))], names)

    return run


def mine(vectors: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100, base: int = 100, scale: int = 256, id_col="vec_id", vec_col="embedding", label_col="label") -> DataFrame:
    """Rows (anchor_id, positive_id, rank, negative_id, positive_score, negative_score). is_anchor: a condition on the column id. A negative fits
    a positive if low * positive_score <= base * negative_score <= high * positive_score."""
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.col(vec_col).cast("array<double>").alias("v"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    good = rows.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & ~bad)
    whole = F.transform("v", lambda x: F.floor(x * scale).cast("long"))
    good = stored(good.select("id", "label", whole.alias("v"), F.coalesce(is_anchor, F.lit(False)).cast("long").alias("anchor")).distinct())
    n, width, n_anchors = good.agg(F.count("*"), F.max(F.size("v")), F.sum("anchor")).first()
    width, m, s = max(1, width or 0), max(1, math.ceil((n_anchors or 0) / ANCHORS)), max(1, math.ceil(n / CANDIDATES / GROUP))
    order = ["id", "label", "v"]
    sorted_ = good.repartitionByRange(max(1, math.ceil(n / CANDIDATES / GROUP)), *order).sortWithinPartitions(*order)
    cut = stored(sorted_.mapInArrow(_cut(width, CANDIDATES), "block long, ids binary, labels binary, anchors binary, v binary"))
    one = stored(cut.mapInArrow(_anchors, "a_block long, a_at long, anchor_id long, a_label long, av binary"))
    tasks = min(m * s, 10 * int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = cut.withColumn("s", F.pmod(F.xxhash64("block"), F.lit(s))).withColumn("a", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(m - 1).cast("long"))))
    dealt = dealt.select("a", "s", "block", "ids", "labels", "v").repartition(tasks, "a", "s")

    def met(wins: DataFrame | None, pick, names: list[str], keys: int, most: int) -> DataFrame:
        """What pick gives, merged over the tiles of each cogroup and then of all."""
        kind = "array<struct<score:long,block:long,at:long>>"
        with_wins = one.withColumn("wins", F.lit(None).cast(kind)) if wins is None else one.join(wins, ["a_block", "a_at"])
        by_a = with_wins.withColumn("a", F.pmod(F.xxhash64("a_block", "a_at"), F.lit(m))).groupBy("a")
        blocks = by_a.applyInArrow(_gathered, "a long, a_labels binary, a_blocks binary, a_ats binary, wins binary, av binary")
        every = blocks.withColumn("s", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(s - 1).cast("long")))).repartition(tasks, "a", "s")
        found = dealt.groupBy("a", "s").cogroup(every.groupBy("a", "s")).applyInArrow(_tiles(pick, names, keys, most), ", ".join(f"{c} long" for c in names))
        of = W.partitionBy(*names[:keys]).orderBy(F.desc("score"), "block", "at")
        return stored(found.withColumn("rank", F.row_number().over(of)).where(F.col("rank") <= most))

    key = ["a_block", "a_at"]
    found = met(None, lambda score, r, a: positives_of(score, r, a, positives), [*key, "score", "block", "at", "id"], 2, positives)
    wins = found.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("score", "block", "at"))).alias("wins"))  # `positives` at most
    near = met(wins, lambda score, r, a: negatives_of(score, r, a, negatives, low, high, base), [*key, "p_block", "p_at", "score", "block", "at", "id"], 4, negatives)
    chosen = found.select(*key, F.col("block").alias("p_block"), F.col("at").alias("p_at"), F.col("score").alias("positive_score"), F.col("id").alias("positive_id"))
    out = near.join(chosen, [*key, "p_block", "p_at"]).join(one.select(*key, "anchor_id"), key)
    return out.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
