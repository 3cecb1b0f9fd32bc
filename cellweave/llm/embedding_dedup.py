"""Embedding near-dedup by an epsilon grid order join.

Vectors of one direction at cosine c lie within eps = sqrt(2 - 2c) of each other once scaled to length one. The steps:

1. Equal vectors become one point with a weight. The second moments of all points are summed by Spark and their
   leading eigenvectors give ``dims`` projections, which never lengthen a distance.
2. Points are sorted by their grid cells (side eps) on these dimensions, in epsilon grid order, by a range partitioning, and
   the sorted sequence is cut into intervals of ``BLOCK`` points, each stored with its bounds.
3. Intervals are dealt to at most ``SIDE`` parts, and a task meets the intervals of two parts, which are read from what was dealt once: vectors are
   not shuffled with each pair. Of each pair one order counts, and it stays only if the bounds are within eps on all projected dimensions.
4. In a task, a pair of intervals is joined by recursion: sequences are halved and halves whose bounds are provably
   farther apart than eps are skipped. What is left at ``LEAF`` points is compared by ``FILTER`` projections, which again
   never lengthen a distance, and what passes exactly, in double precision.
   A pair of intervals gives each point's weighted number of links and a spanning forest of its links, so dense groups never
   expand into all their pairs.

Defined results: a vector that is null, empty, zero or holds a null or non-finite component links with nothing
(n_links 0, its own component, kept). Vectors of different lengths are compared as if the shorter were padded with zeros.
Rows that share an id but not the vector are told apart, each with links of its own; repeated rows link with each other. A null id keeps
a null component unless its vector links, and then it has the least id reached. An empty table gives an empty one. Only the id and vector columns
are read, so others may clash.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellweave.llm.common import components, stored

BLOCK = 2048
LEAF = 512
SIDE, LEAST = 128, 3  # parts of intervals at most, and intervals of a part at least; tasks are the square of the parts
FILTER = 24  # projections by which points of two leaves are first compared
SLACK = 1e-6  # on distances of projections, against rounding


def padded(column: pa.Array, width: int) -> np.ndarray:
    """The vectors as rows, with zeros up to width."""
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy().astype(np.float64)
    if (sizes == width).all():
        return flat.reshape(-1, width)
    x = np.zeros((len(sizes), width))
    row = np.repeat(np.arange(len(sizes)), sizes)
    x[row, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return x


def scaled(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def units(column: pa.Array, width: int) -> np.ndarray:
    """Rows of length one in double precision; the vectors are valid."""
    return scaled(padded(column, width))


def _moments(width: int):
    def run(batches):
        total = np.zeros((width, width))
        for b in batches:
            u = units(b.column(0), width)
            total += u.T @ u
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(width * width)), pa.array(total.ravel())], ["k", "v"])

    return run


def directions(points: DataFrame, width: int, dims: int) -> np.ndarray:
    rows = points.select("v").mapInArrow(_moments(width), "k long, v double").groupBy("k").agg(F.sum("v").alias("v")).collect()
    m = np.zeros(width * width)
    for r in rows:
        m[r["k"]] = r["v"]
    return np.linalg.eigh(m.reshape(width, width))[1][:, ::-1][:, :dims]


def _cells(width: int, axes: np.ndarray, eps: float):
    def run(batches):
        for b in batches:
            u = units(b.column("v"), width)
            y = u @ axes
            cell = np.floor(y / eps).astype(np.int32)
            cols = [b.column("id"), b.column("m"), pa.array([r.tobytes() for r in padded(b.column("v"), width)], pa.binary()), *[pa.array(cell[:, k]) for k in range(axes.shape[1])], pa.array(y[:, 0])]
            yield pa.RecordBatch.from_arrays(cols, ["id", "m", "v", *[f"c{k}" for k in range(axes.shape[1])], "y0"])

    return run


def _cut(width: int, axes: np.ndarray):
    def block(part: int, k: int, t: pa.Table):
        v = np.frombuffer(b"".join(t.column("v").to_pylist())).reshape(-1, width)
        y = scaled(v) @ axes
        with np.errstate(over="ignore"):
            short = v.astype("<f4")
        ids, m = t.column("id").to_numpy().astype("<i8"), t.column("m").to_numpy().astype("<i8")
        rows = [[(part << 32) + k], [ids.tobytes()], [m.tobytes()], [(short if (short == v).all() else v).tobytes()], [y.min(0).tolist()], [y.max(0).tolist()]]
        return pa.RecordBatch.from_arrays([pa.array(r, type=k) for r, k in zip(rows, (pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.float64()), pa.list_(pa.float64())), strict=True)], ["block", "ids", "m", "v", "lo", "hi"])

    def run(batches):
        part, k, left = TaskContext.get().partitionId(), 0, None
        for b in batches:
            t = pa.Table.from_batches([b.select(["id", "m", "v"])])
            left = t if left is None else pa.concat_tables([left, t])
            while left.num_rows >= BLOCK:
                yield block(part, k, left.slice(0, BLOCK))
                left, k = left.slice(BLOCK), k + 1
        if left is not None and left.num_rows:
            yield block(part, k, left)

    return run


def blocks(points: DataFrame, width: int, axes: np.ndarray, eps: float) -> DataFrame:
    """points: id, m, v. Rows (block, ids, m, v, lo, hi): the intervals of the sequence in epsilon grid order."""
    dims = axes.shape[1]
    cells = [f"c{k}" for k in range(dims)]
    placed = points.mapInArrow(_cells(width, axes, eps), "id long, m long, v binary, " + ", ".join(f"{c} int" for c in cells) + ", y0 double")
    ordered = placed.repartitionByRange(*cells, "y0", "id").sortWithinPartitions(*cells, "y0", "id")
    return ordered.mapInArrow(_cut(width, axes), "block long, ids binary, m binary, v binary, lo array<double>, hi array<double>")


def block_pairs(cut: DataFrame, eps: float, dims: int) -> DataFrame:
    """Rows (a, b, ia, ib, ma, mb, va, vb) of the pairs of intervals that aren't provably distant, each in one order and each interval with itself.

    Every part of the intervals meets every part, whatever the pairs: what is written is the intervals once for each side, so disk grows with them and
    not with their square, and a task holds two parts."""
    n = cut.count()
    parts = -(-n // max(LEAST, -(-n // SIDE))) or 1
    side = lambda s: cut.select(F.col("block").alias(s), F.col("ids").alias(f"i{s}"), F.col("m").alias(f"m{s}"), F.col("v").alias(f"v{s}"), F.col("lo").alias(f"lo{s}"), F.col("hi").alias(f"hi{s}")).repartition(parts)
    gap = sum((F.pow(F.greatest(F.col("loa")[k] - F.col("hib")[k], F.col("lob")[k] - F.col("hia")[k], F.lit(0.0)), 2) for k in range(dims)), F.lit(0.0))
    once = (F.col("a") == F.col("b")) | ((F.col("a") < F.col("b")) == ((F.col("a") + F.col("b")) % 2 == 0))  # so that parts have equal work
    met = side("a").join(side("b").hint("shuffle_replicate_nl"), once & (gap <= (eps + SLACK) ** 2))
    return met.select("a", "b", "ia", "ib", "ma", "mb", "va", "vb")


def linked(u: np.ndarray, v: np.ndarray, axes: np.ndarray, dims: int, cosine: float, eps: float) -> np.ndarray:
    """Which rows of u and v are at the cosine, by recursion over two sequences in epsilon grid order."""
    out = np.zeros((len(u), len(v)), bool)
    pu, pv = u @ axes, v @ axes
    yu, yv = pu[:, :dims], pv[:, :dims]
    # half the squared distance of projections is hu + hv - pu . pv: one product of rows that carry it
    fu = np.column_stack([pu, -(pu * pu).sum(1) / 2, -np.ones(len(u))]).astype(np.float32)
    fv = np.column_stack([pv, np.ones(len(v)), (pv * pv).sum(1) / 2]).astype(np.float32)
    least = -(eps * eps) / 2 - 1e-4

    def join(a: int, b: int, c: int, d: int) -> None:
        gap = np.maximum(np.maximum(yu[a:b].min(0) - yv[c:d].max(0), yv[c:d].min(0) - yu[a:b].max(0)), 0)
        if (gap * gap).sum() > (eps + SLACK) ** 2:
            return
        if b - a <= LEAF and d - c <= LEAF:
            i, j = np.nonzero(fu[a:b] @ fv[c:d].T >= least)
            for k in range(0, len(i), 100_000):
                x, y = i[k : k + 100_000], j[k : k + 100_000]
                out[a + x, c + y] = np.einsum("ij,ij->i", u[a + x], v[c + y]) >= cosine
        elif b - a >= d - c:
            join(a, (a + b) // 2, c, d)
            join((a + b) // 2, b, c, d)
        else:
            join(a, b, c, (c + d) // 2)
            join(a, b, (c + d) // 2, d)

    join(0, len(u), 0, len(v))
    return out


def forest(link: np.ndarray, ids_a: np.ndarray, ids_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row or column with a link, the least id that it reaches through the links of this matrix."""
    far = np.iinfo(np.int64).max
    i, j = np.nonzero(link)
    la, lb = ids_a.copy(), ids_b.copy()
    while True:
        na, nb = la.copy(), lb.copy()
        np.minimum.at(nb, j, na[i])
        np.minimum.at(na, i, nb[j])
        if (na == la).all() and (nb == lb).all():
            break
        la, lb = na, nb
    la[~link.any(1)], lb[~link.any(0)] = far, far
    ids, roots = np.append(ids_a, ids_b), np.append(la, lb)
    return ids[roots != far], roots[roots != far]


def _join(width: int, axes: np.ndarray, dims: int, cosine: float, eps: float):
    def run(batches):
        for b in batches:
            for r in b.to_pylist():
                ia, ib, ma, mb = (np.frombuffer(r[c], "<i8") for c in ("ia", "ib", "ma", "mb"))
                u, v = (scaled(np.frombuffer(r[c], "<f8" if len(r[c]) == 8 * width * len(i) else "<f4").reshape(-1, width).astype(float)) for c, i in (("va", ia), ("vb", ib)))
                link = linked(u, v, axes, dims, cosine, eps)
                same = r["a"] == r["b"]
                if same:
                    np.fill_diagonal(link, False)
                ids, n = [ia], [link @ mb]
                if not same:
                    ids.append(ib)
                    n.append(ma @ link)
                ids, n = np.concatenate(ids), np.concatenate(n)
                node, root = forest(link, ia, ib)
                out = [np.append(ids[n > 0], node), np.append(n[n > 0], np.zeros(len(node), np.int64)), np.append(ids[n > 0], root)]
                yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in out], ["id", "n", "to"])

    return run


def link(vectors: DataFrame, cosine: float = 0.9, dims: int = 8, id_col="vec_id", vec_col="embedding") -> DataFrame:
    """Rows (vec_id, n_links, component_id, kept), one for each row of vectors."""
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    good = rows.where((F.size("v") > 0) & ~bad & F.exists("v", lambda x: x != 0))
    width = good.agg(F.max(F.size("v"))).first()[0]
    if not width:
        return rows.select(F.col("id").alias("vec_id"), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    eps = math.sqrt(max(0.0, 2 - 2 * cosine)) + 1e-9
    distinct = good.groupBy("v").agg(F.min("id").alias("least"), F.count("*").alias("m"))
    named = stored(distinct.select(F.monotonically_increasing_id().alias("id"), "v", "least", "m"))  # written once, so numbers stay
    points = named.select("id", "m", "v")
    axes = np.ascontiguousarray(directions(points, width, min(max(dims, FILTER), width)))
    dims = min(dims, width)
    grid = np.ascontiguousarray(axes[:, :dims])
    cut = stored(blocks(points, width, grid, eps))
    found = stored(block_pairs(cut, eps, dims).mapInArrow(_join(width, axes, dims, cosine, eps), "id long, n long, to long"))
    counts = found.groupBy("id").agg(F.sum("n").alias("n"))
    group = components(found.where("id <> to").select(F.col("id").alias("a"), F.col("to").alias("b"))).join(named.select("id", "least"), "id")
    group = stored(group)
    least = group.groupBy("component_id").agg(F.min("least").alias("reached"))
    reached = group.join(least, "component_id").select("id", "reached")
    point = named.join(counts, "id", "left").join(reached, "id", "left").select("v", (F.coalesce("n", F.lit(0)) + F.col("m") - 1).alias("n"), F.coalesce("reached", "least").alias("c"))
    out = rows.join(point, "v", "left")
    c = F.coalesce("c", "id")
    return out.select(F.col("id").alias("vec_id"), F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), c.alias("component_id"), F.col("id").eqNullSafe(c).alias("kept"))
