"""Exact areas of overlaid polygons, and clipping to a box.

Pairs of polygons come from an equi-join on grid cells; each is met once, in the cell that holds the lower corner of what their
boxes share. Areas are measured by slabs: between neighbouring x of vertices and crossings every outline is a straight line, so the length
of a cut through any combination of polygons is linear there, and its value in the middle times the slab's width is the area. That
holds for outlines of any shape, convex or not, and for unions of any number of them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from cellweave.functions import scalars as S
from cellweave.operators.spatial import CELL, covered, flat_rings
from cellweave.sources.scratch import stored

CUTS = 1 << 20  # crossings of cuts with outlines looked at together


def _edges(rings: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Edges (x1, y1, x2, y2) with x1 < x2 of all rings, and the ring of each; upright ones bound no slab from above or below."""
    edges = np.concatenate([np.column_stack([r, np.roll(r, -1, 0)]) for r in rings])
    owner = np.repeat(np.arange(len(rings)), [len(r) for r in rings])
    back = edges[:, 0] > edges[:, 2]
    edges[back] = edges[back][:, [2, 3, 0, 1]]
    slanted = edges[:, 0] < edges[:, 2]
    return edges[slanted], owner[slanted]


def _crossings(e: np.ndarray) -> np.ndarray:
    """The x at which edges cross."""
    d = e[:, 2:] - e[:, :2]
    out = []
    for i in range(len(e) - 1):
        f, df = e[i + 1 :], d[i + 1 :]
        det = d[i, 0] * df[:, 1] - d[i, 1] * df[:, 0]
        with np.errstate(divide="ignore", invalid="ignore"):
            w = f[:, :2] - e[i, :2]
            t = (w[:, 0] * df[:, 1] - w[:, 1] * df[:, 0]) / det
            u = (w[:, 0] * d[i, 1] - w[:, 1] * d[i, 0]) / det
        out.append((e[i, 0] + t * d[i, 0])[(t > 0) & (t < 1) & (u > 0) & (u < 1)])
    return np.concatenate(out) if out else np.zeros(0)


def combined_areas(layers: list[list[np.ndarray]]) -> np.ndarray:
    """The area that lies in exactly each combination of layers: entry b of the result is that of the layers whose bits are set in b. A layer is
    the union of its rings; a ring (n x 2) holds what an odd number of its edges enclose."""
    rings = [r for layer in layers for r in layer if len(r) > 2]
    layer_of = np.array([k for k, layer in enumerate(layers) for r in layer if len(r) > 2], np.int64)
    total = np.zeros(1 << len(layers))
    if not rings:
        return total
    e, owner = _edges(rings)
    xs = np.unique(np.concatenate([*[r[:, 0] for r in rings], _crossings(e)]))
    if len(xs) < 2 or not len(e):
        return total
    slope = (e[:, 3] - e[:, 1]) / (e[:, 2] - e[:, 0])
    step = max(1, CUTS // (len(e) * len(rings)))
    for lo in range(0, len(xs) - 1, step):
        left, right = xs[lo : lo + step + 1][:-1], xs[lo : lo + step + 1][1:]
        mid = (left + right) / 2
        y = np.where((e[:, 0] < mid[:, None]) & (mid[:, None] < e[:, 2]), e[:, 1] + (mid[:, None] - e[:, 0]) * slope, np.inf)
        by = np.argsort(y, 1)
        y = np.take_along_axis(y, by, 1)
        inside = np.cumsum(owner[by][:, :, None] == np.arange(len(rings)), 1) % 2 == 1
        code = np.zeros(y.shape, np.int64)
        for k in range(len(layers)):
            code |= inside[:, :, layer_of == k].any(2).astype(np.int64) << k
        real = np.isfinite(y[:, 1:])
        length = np.where(real, y[:, 1:], 0) - np.where(real, y[:, :-1], 0)
        total += np.bincount(code[:, :-1].ravel(), (length * (right - left)[:, None]).ravel(), len(total))
    total[0] = 0.0
    return total


WIDE = 96  # points of a row's rings up to which rows are measured many at a time


def _spans(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of n numbers each, one after the other."""
    return np.arange(n.sum()) + np.repeat(start - np.cumsum(n) + n, n)


def _padded(of: np.ndarray, rows: int, *values: np.ndarray) -> list[np.ndarray]:
    """Values as matrices with a line for each row, filled up with nan; of: the row of each value, ascending."""
    n = np.bincount(of, minlength=rows)
    at = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
    out = []
    for v in values:
        out.append(np.full((rows, n.max(initial=0)), np.nan))
        out[-1][of, at] = v
    return out


def _areas_together(rows: int, points: np.ndarray, n: np.ndarray, row: np.ndarray, layer: np.ndarray, layers: int) -> np.ndarray:
    """combined_areas of many rows with few points each, a line a row. n, row and layer: of each ring, ascending by row."""
    count = np.bincount(row, minlength=rows)
    place = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    bits = np.zeros((rows, count.max(initial=0)), np.int64)
    bits[row, place] = 1 << layer
    after = np.arange(1, n.sum() + 1)
    after[np.cumsum(n) - 1] = np.cumsum(n) - n
    e, of, ring = np.column_stack([points, points[after]]), np.repeat(row, n), np.repeat(place, n)
    back = e[:, 0] > e[:, 2]
    e[back] = e[back][:, [2, 3, 0, 1]]
    slanted = e[:, 0] < e[:, 2]
    (vertex,) = _padded(of, rows, points[:, 0])
    x1, y1, x2, y2, owner = _padded(of[slanted], rows, *e[slanted].T, ring[slanted])
    total = np.zeros((rows, 1 << layers))
    if not x1.size:
        return total
    dx, dy = x2 - x1, y2 - y1
    i, j = np.triu_indices(x1.shape[1], 1)
    with np.errstate(divide="ignore", invalid="ignore"):
        slope = dy / dx
        det = dx[:, i] * dy[:, j] - dy[:, i] * dx[:, j]
        wx, wy = x1[:, j] - x1[:, i], y1[:, j] - y1[:, i]
        t, u = (wx * dy[:, j] - wy * dx[:, j]) / det, (wx * dy[:, i] - wy * dx[:, i]) / det
        met = np.where((t > 0) & (t < 1) & (u > 0) & (u < 1), x1[:, i] + t * dx[:, i], np.nan)
    xs = np.sort(np.concatenate([vertex, met], 1), 1)  # nan comes last
    new = np.isfinite(xs)
    new[:, 1:] &= xs[:, 1:] != xs[:, :-1]
    (xs,) = _padded(np.nonzero(new)[0], rows, xs[new])
    left, right = xs[:, :-1], xs[:, 1:]
    step = max(1, CUTS // max(1, left.shape[1] * x1.shape[1]))
    for lo in range(0, rows if left.size else 0, step):
        s = slice(lo, lo + step)
        mid, line = ((left[s] + right[s]) / 2)[:, :, None], lambda v: v[s][:, None, :]  # noqa: E731, B023
        cut = (line(x1) < mid) & (mid < line(x2))
        y = np.where(cut, line(y1) + (mid - line(x1)) * line(slope), np.inf)
        by = np.argsort(y, 2)[:, :, : max(int(cut.sum(2).max()), 1)]  # the edges that the slab crosses come first
        y = np.take_along_axis(y, by, 2)
        own = np.take_along_axis(np.broadcast_to(line(owner), cut.shape), by, 2)
        code = np.zeros(y.shape, np.int64)
        for k in range(bits.shape[1]):
            code |= np.where(np.cumsum(own == k, 2) % 2 == 1, bits[s, k][:, None, None], 0)
        real = np.isfinite(y[:, :, 1:])
        area = np.where(real, np.where(real, y[:, :, 1:], 0) - np.where(real, y[:, :, :-1], 0), 0) * np.where(real.any(2), right[s] - left[s], 0)[:, :, None]
        at = np.arange(len(y))[:, None, None] * (1 << layers) + code[:, :, :-1]
        total[s] += np.bincount(at.ravel(), area.ravel(), len(y) << layers).reshape(len(y), -1)
    total[:, 0] = 0.0
    return total


def areas_of_rows(columns: list[pa.Array]) -> np.ndarray:
    """combined_areas of each row, a line a row; columns: the layers. Rows of few points are measured together, as many as CUTS bounds."""
    flat = [flat_rings(c) for c in columns]
    points, n, row = (np.concatenate(v) for v in zip(*flat, strict=True))
    layer = np.repeat(np.arange(len(columns)), [len(f[1]) for f in flat])
    start, ring = np.cumsum(n) - n, n > 2
    start, n, row, layer = start[ring], n[ring], row[ring], layer[ring]
    by = np.argsort(row, kind="stable")
    start, n, row, layer = start[by], n[by], row[by], layer[by]
    rows = len(columns[0])
    out, size = np.zeros((rows, 1 << len(columns))), np.bincount(row, n, rows).astype(np.int64)
    first, rings = np.searchsorted(row, np.arange(rows)), np.bincount(row, minlength=rows)
    for r in np.flatnonzero(size > WIDE):
        own = range(first[r], first[r] + rings[r])
        out[r] = combined_areas([[points[start[g] : start[g] + n[g]] for g in own if layer[g] == k] for k in range(len(columns))])
    few = np.argsort(size, kind="stable")
    few = few[(size[few] > 0) & (size[few] <= WIDE)]
    while len(few):  # those of most points first, so that the first one bounds the others
        many = max(1, CUTS // int(size[few[-1]]) ** 2)
        few, now = few[:-many], np.sort(few[-many:])
        own = _spans(first[now], rings[now])
        out[now] = _areas_together(len(now), points[_spans(start[own], n[own])], n[own], np.repeat(np.arange(len(now)), rings[now]), layer[own], len(columns))
    return out


def _measured(layers: int):
    def run(batches):
        for b in batches:
            areas = areas_of_rows([b.column(1 + k) for k in range(layers)])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(list(areas), pa.list_(pa.float64()))], ["row", "areas"])

    return run


def measured(rows: DataFrame, layers: list[str], keep: list[str]) -> DataFrame:
    """keep's columns and `areas`: by combination of layers (bit k: the k-th), the area that lies in exactly these. A layer's column has a ring,
    an array of rings, or null."""
    packed = rows.select(F.struct(*keep).alias("row"), *[F.col(c).alias(f"_{k}") for k, c in enumerate(layers)])
    kind = packed.schema["row"].dataType.simpleString()
    return packed.mapInArrow(_measured(len(layers)), f"row {kind}, areas array<double>").select("row.*", "areas")


def held(areas: str, layers: int, test) -> Column:
    """The sum of areas of the combinations for which test(set of layers) holds."""
    picked = [b for b in range(1, 1 << layers) if test({k for k in range(layers) if b >> k & 1})]
    return S.total([F.col(areas)[b] for b in picked])


def pairs(a: DataFrame, b: DataFrame, a_id: str, b_id: str, cell: float = CELL) -> DataFrame:
    """Rows (a_id, b_id, ring_a, ring_b) of polygons (id, ring) whose boxes meet."""
    side = lambda t, key, s: covered(t.select(key, F.col("ring").alias("ring")), 0.0, cell).select(F.col(key), F.col("ring").alias(f"ring_{s}"), "_gx", "_gy", *[F.col(f"_{c}").alias(f"_{c}_{s}") for c in ("xmin", "xmax", "ymin", "ymax")])
    x, y = F.greatest("_xmin_a", "_xmin_b"), F.greatest("_ymin_a", "_ymin_b")
    met = side(a, a_id, "a").join(side(b, b_id, "b"), ["_gx", "_gy"])
    boxes = (x < F.least("_xmax_a", "_xmax_b")) & (y < F.least("_ymax_a", "_ymax_b"))
    return met.where(boxes & (F.floor(x / cell) == F.col("_gx")) & (F.floor(y / cell) == F.col("_gy"))).select(a_id, b_id, "ring_a", "ring_b")


def intersections(a: DataFrame, b: DataFrame, a_id: str, b_id: str, threshold: float = 0.0) -> DataFrame:
    """Rows (a_id, b_id, overlap, union_area) of polygons that share more area than the threshold."""
    out = measured(pairs(a, b, a_id, b_id), ["ring_a", "ring_b"], [a_id, b_id])
    return out.select(a_id, b_id, held("areas", 2, lambda s: s == {0, 1}).alias("overlap"), held("areas", 2, bool).alias("union_area")).where(F.col("overlap") > threshold)


def differences(a: DataFrame, b: DataFrame, a_id: str, b_id: str) -> DataFrame:
    """Rows (a_id, area, outside): each polygon's area and what of it the union of all polygons of b leaves. The polygons of b that meet one
    of a are gathered with it: as many as overlap there."""
    met = pairs(a, b, a_id, b_id).groupBy(a_id).agg(F.collect_list("ring_b").alias("rings_b"))
    rows = a.select(a_id, "ring").join(met, a_id, "left")
    out = measured(rows, ["ring", "rings_b"], [a_id])
    return out.select(a_id, held("areas", 2, lambda s: 0 in s).alias("area"), held("areas", 2, lambda s: s == {0}).alias("outside"))


def best_overlap(a: DataFrame, b: DataFrame, a_id: str, b_id: str, threshold: float) -> DataFrame:
    """Rows (a_id, b_id, overlap, union_area): for each polygon of a the one of b that shares most area with it, over the threshold; the
    least id where areas are equal to nine decimals."""
    met = intersections(a, b, a_id, b_id, threshold)
    best = F.row_number().over(W.partitionBy(a_id).orderBy(F.desc(F.round("overlap", 9)), b_id))
    return met.withColumn("_r", best).where("_r = 1").drop("_r")


def nuclear_prior_benchmark(truth: DataFrame, method: DataFrame, nuclei: DataFrame, in_truth: DataFrame, in_method: DataFrame, in_nuclei: DataFrame, threshold: float = 1.0) -> DataFrame:
    """A row for each truth cell: how well the method's segment of largest overlap, joined with the nucleus of largest overlap, matches it.

    truth: truth_id, ring; method: segment_id, ring; nuclei: nucleus_id, ring; in_...: the same id with transcript_id. Areas, their ratio and the
    transcripts of the cell count only for cells that a nucleus overlaps; segment_id is -1 without a segment, whose errors are
    counted together. n_confused: a segment's transcripts of other cells than its own; n_background: of none. Cells whose segment has no
    transcript at all are left out."""
    rows = truth.join(best_overlap(truth, method, "truth_id", "segment_id", threshold).select("truth_id", "segment_id"), "truth_id", "left")
    rows = stored(rows.join(best_overlap(truth, nuclei, "truth_id", "nucleus_id", threshold).select("truth_id", "nucleus_id"), "truth_id", "left"))
    rings = rows.join(method.select("segment_id", F.col("ring").alias("ring_m")), "segment_id", "left").join(nuclei.select("nucleus_id", F.col("ring").alias("ring_n")), "nucleus_id", "left")
    areas = measured(rings.where("nucleus_id IS NOT NULL"), ["ring", "ring_m", "ring_n"], ["truth_id"])
    areas = areas.select("truth_id", held("areas", 3, lambda s: 0 in s and len(s) > 1).alias("intersection_area"), held("areas", 3, bool).alias("union_area"))

    ids = rows.select("truth_id", "segment_id", "nucleus_id")
    found = ids.join(in_method, "segment_id").select("truth_id", "segment_id", "transcript_id").union(ids.join(in_nuclei, "nucleus_id").select("truth_id", "segment_id", "transcript_id"))
    found = stored(found.distinct())
    true = stored(ids.where("nucleus_id IS NOT NULL").select("truth_id").join(in_truth, "truth_id").select("truth_id", "transcript_id"))

    met = found.select(F.col("truth_id").alias("matching"), "segment_id", "transcript_id").join(true, "transcript_id", "full")
    none = lambda c: F.coalesce(F.col(c), F.lit(-1)).alias(c)
    each = stored(met.select(none("segment_id"), none("matching"), none("truth_id")).groupBy("segment_id", "truth_id").agg(F.count("*").alias("n"), F.max("matching").alias("matching")))
    own = each.groupBy("segment_id").agg(F.max("matching").alias("own"))
    count = lambda c, name: F.sum(F.when(c, F.col("n")).otherwise(0)).alias(name)
    of, mine = F.col("truth_id"), F.col("own")
    errors = each.join(own, "segment_id").groupBy("segment_id").agg(count((of != -1) & (of != mine), "n_confused"), count(of == -1, "n_background"), F.sum("n").alias("n_transcripts"))

    shared = found.join(true, ["truth_id", "transcript_id"]).groupBy("truth_id").agg(F.count("*").alias("shared"))
    sizes = found.groupBy("truth_id").agg(F.count("*").alias("_m")).join(true.groupBy("truth_id").agg(F.count("*").alias("_t")), "truth_id")
    both = sizes.join(shared, "truth_id", "left").select("truth_id", F.coalesce("shared", F.lit(0)).alias("jaccard_intersection"), (F.col("_m") + F.col("_t") - F.coalesce("shared", F.lit(0))).alias("jaccard_union"))
    both = both.withColumn("jaccard_index", F.col("jaccard_intersection") / F.col("jaccard_union"))
    out = ids.select("truth_id", none("segment_id")).join(areas, "truth_id", "left").join(both, "truth_id", "left").join(errors, "segment_id")
    return out.withColumn("iou", F.col("intersection_area") / F.col("union_area"))


def _cut(axis: str, bound: float, sign: float):
    """A function that cuts a ring at a half-plane: its points inside, and the crossings."""
    other = "y" if axis == "x" else "x"
    point = lambda v, w: F.struct(*[c.cast("double").alias(n) for n, c in sorted([(axis, v), (other, w)], key=lambda n: n[0])])

    def added(e: Column) -> Column:
        p, q, po, qo = e[f"{axis}1"], e[f"{axis}2"], e[f"{other}1"], e[f"{other}2"]
        p_in, q_in, end = sign * (p - bound) >= 0, sign * (q - bound) >= 0, point(q, qo)
        cross = point(F.lit(bound), po + (bound - p) * (qo - po) / F.nullif(q - p, F.lit(0.0)))
        return F.when(p_in & q_in, F.array(end)).when(q_in, F.array(cross, end)).when(p_in, F.array(cross)).otherwise(F.array().cast("array<struct<x:double,y:double>>"))

    return lambda ring: F.flatten(F.transform(S.ring_edges(ring), added))


def clipped(polygons: DataFrame, x1: float, y1: float, x2: float, y2: float) -> DataFrame:
    """polygons (with ring) cut by the box, a half-plane at a time; those without area inside are left out."""
    b, ring = S.ring_bounds(F.col("ring")), F.col("ring")
    out = polygons.where((b["xmin"] < x2) & (b["xmax"] > x1) & (b["ymin"] < y2) & (b["ymax"] > y1))
    for axis, bound, sign in (("x", x1, 1.0), ("x", x2, -1.0), ("y", y1, 1.0), ("y", y2, -1.0)):
        # what is cut so far is named by a lambda, so that it stands in the expression once
        ring = F.transform(F.array(ring), _cut(axis, float(bound), sign))[0]
    return out.withColumn("ring", ring).where((F.size("ring") > 2) & (S.ring_area(F.col("ring")) > 0))


def to_raster_space(polygons: DataFrame, x1: float, y1: float, x2: float, y2: float, resolution: float) -> DataFrame:
    """polygons clipped to the box, in pixels from its corner."""
    moved = F.transform("ring", lambda p: F.struct(S.to_raster(p["x"], x1, resolution).alias("x"), S.to_raster(p["y"], y1, resolution).alias("y")))
    return clipped(polygons, x1, y1, x2, y2).withColumn("ring", moved)
