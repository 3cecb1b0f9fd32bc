"""Spatial joins. Every join is an equi-join on grid cells that the geometries cover, then an exact test."""

from __future__ import annotations

from itertools import groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from cellweave.functions import scalars as S
from cellweave.operators.grid import dictionary
from cellweave.sources.scratch import stored

CELL = 16.0  # side of a grid cell


def covered(polygons: DataFrame, margin: float = 0.0, cell: float = CELL) -> DataFrame:
    """polygons (with ring), a row for each cell that their box, grown by margin, touches."""
    b = S.ring_bounds(F.col("ring"))
    boxed = polygons.select("*", *[c.alias(f"_{n}") for n, c in b.items()])
    span = lambda lo, hi: F.sequence(F.floor((F.col(lo) - margin) / cell), F.floor((F.col(hi) + margin) / cell))
    return boxed.withColumn("_gx", F.explode(span("_xmin", "_xmax"))).withColumn("_gy", F.explode(span("_ymin", "_ymax")))


def points_in_polygons(polygons: DataFrame, points: DataFrame, x: str, y: str, cell: float = CELL) -> DataFrame:
    """Each point with each polygon that holds it, the outline included."""
    at = points.withColumn("_gx", F.floor(F.col(x) / cell)).withColumn("_gy", F.floor(F.col(y) / cell))
    met = at.join(covered(polygons, 0.0, cell), ["_gx", "_gy"])
    near = F.col(x).between(F.col("_xmin"), F.col("_xmax")) & F.col(y).between(F.col("_ymin"), F.col("_ymax"))
    return met.where(near & S.in_ring(F.col("ring"), F.col(x), F.col(y))).drop("_gx", "_gy", "_xmin", "_ymin", "_xmax", "_ymax")


def assign_points_first(polygons: DataFrame, points: DataFrame, id_col: str, point: str, x: str, y: str) -> DataFrame:
    """Rows (point, id_col): the polygon of least id that holds each point."""
    return points_in_polygons(polygons.select(id_col, "ring"), points, x, y).groupBy(point).agg(F.min(id_col).alias(id_col))


def points_counted_first(polygons: DataFrame, points: DataFrame, id_col: str, point: list[str], x: str, y: str) -> DataFrame:
    """Rows (*point, id_col, n): the polygon of least id that holds each point, and how many equal rows the point has. point: columns that tell
    points apart and are wanted later; they travel with the point, so nothing is joined back, and only points inside a polygon are grouped."""
    held = points_in_polygons(polygons.select(id_col, "ring"), points.select(*point, x, y), x, y).select(*point, id_col).repartition(*point)
    each = held.groupBy(*point, id_col).agg(F.count("*").alias("_n"))
    return each.groupBy(*point).agg(F.min_by("_n", id_col).alias("n"), F.min(id_col).alias(id_col)).select(*point, id_col, "n")


def _flat(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each range of n places, one after the other."""
    return np.repeat(start - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))


def _nearest_polygon(id_col: str, point: list[str], x: str, y: str, most: float, block: int):
    """The nearest polygon within `most` of each point of one block."""
    side = block + 2  # cells that a point of the block may lie in, and one more each way

    def run(key, points, polygons):
        points = points.group_by(point, use_threads=False).aggregate([(x, "min"), (y, "min"), ([], "count_all")])
        times = points.column("count_all").to_numpy()
        px, py = (points.column(f"{c}_min").cast(pa.float64()).to_numpy(zero_copy_only=False) for c in (x, y))
        best, near = np.full(len(px), -1), np.full(len(px), np.nan)
        if polygons.num_rows and not np.isnan(px).all():
            polygons = polygons.take(pc.sort_indices(polygons, [(id_col, "ascending")], null_placement="at_start"))
            flat, n, _ = flat_rings(polygons.column("ring").combine_chunks())
            first = np.cumsum(n) - n
            low, high = np.minimum.reduceat(flat, first) - most, np.maximum.reduceat(flat, first) + most
            corner = np.array([k.as_py() for k in key]) * block - 1
            cells = lambda v: np.clip(np.floor(v / CELL).astype(np.int64) - corner, 0, side - 1)
            placed = np.flatnonzero(~(np.isnan(px) | np.isnan(py)))
            at = cells(np.column_stack([px, py])[placed]) @ [side, 1]
            order = placed[np.argsort(at, kind="stable")]
            count = np.bincount(at, minlength=side * side)
            start = np.cumsum(count) - count
            a, b = cells(low), cells(high)
            wide, tall = (b - a + 1).T
            q = np.repeat(np.arange(len(n)), wide * tall)  # a polygon for each cell of its grown box
            k = _flat(np.zeros(len(n), np.int64), wide * tall)
            cell = (a[q, 0] + k // tall[q]) * side + a[q, 1] + k % tall[q]
            i, q = order[_flat(start[cell], count[cell])], np.repeat(q, count[cell])
            some = (px[i] >= low[q, 0]) & (px[i] <= high[q, 0]) & (py[i] >= low[q, 1]) & (py[i] <= high[q, 1])
            i, q = i[some], q[some]
            d = distances_to(flat[_flat(first[q], n[q])], n[q], px[i], py[i], times[i])
            some = d <= most
            i, q, d = i[some], q[some], d[some]
            by = np.lexsort((q, d, i))  # polygons are in order of their ids
            i, q, d = i[by], q[by], d[by]
            head = np.append(True, i[1:] != i[:-1])[: len(i)]
            best[i[head]], near[i[head]] = q[head], d[head]
        ids = polygons.column(id_col).take(pa.array(best, mask=best < 0))
        return pa.table([*[points.column(c) for c in point], ids, pa.array(near, mask=np.isnan(near))], [*point, id_col, "distance"])

    return run


def nearest_polygon(polygons: DataFrame, points: DataFrame, id_col: str, point: list[str], x: str, y: str, most: float, block: int = 16) -> DataFrame:
    """Rows (*point, id_col, distance): the nearest polygon within `most`; the least id on ties; null if there is none.

    The points of a square block of `block` cells a side and the polygons that come within `most` of it meet in one task, of a size that the area
    bounds, where a point meets the polygons whose grown box holds it; points are shuffled once and edges never. point: columns that tell points
    apart; of a point that comes several times each row counts the edges that are crossed, as the statement has it. Points without a place are dealt by
    a hash."""
    side = block * CELL
    own = lambda c: F.coalesce(F.floor(F.col(c) / side), F.pmod(F.xxhash64(*point), F.lit(1024)))
    rows = points.select(*point, F.col(x).cast("double").alias(x), F.col(y).cast("double").alias(y))
    dealt = rows.withColumn("_gx", own(x)).withColumn("_gy", own(y)).groupBy("_gx", "_gy")
    around = covered(polygons.select(id_col, "ring"), most, side).select(id_col, "ring", "_gx", "_gy").groupBy("_gx", "_gy")
    kinds = [f"{c} {rows.schema[c].dataType.simpleString()}" for c in point] + [f"{id_col} {polygons.schema[id_col].dataType.simpleString()}", "distance double"]
    return dealt.cogroup(around).applyInArrow(_nearest_polygon(id_col, point, x, y, most, block), ", ".join(kinds))


def chunk_by_position(segments: DataFrame, id_col: str, x: str, y: str, size: int) -> DataFrame:
    """Rows (id_col, chunk): segments in order of x, y and id, `size` to a chunk. Places are numbered by ranges, not in one task."""
    placed = segments.select(F.struct(x, y, id_col).alias("_k"))
    return dictionary(placed, "_k", "_at").select(F.col(f"_k.{id_col}").alias(id_col), F.floor(F.col("_at") / size).cast("long").alias("chunk"))


def _dense(k: int, radius: int, block: int):
    """The pixels of one block with k places in and around it nearer than radius."""
    side = block + 2 * radius
    offsets = [(i, j) for i in range(-radius, radius + 1) for j in range(-radius, radius + 1) if i * i + j * j < radius * radius]

    def run(key, pixels, places):
        x0, y0 = (v.as_py() * block - radius for v in key)
        x, y = (pixels.column(c).to_numpy() for c in ("x", "y"))
        held = np.zeros(len(x), bool)
        if len(x) and places.num_rows >= k:
            n = np.bincount((places.column("_px").to_numpy() - x0) * side + places.column("_py").to_numpy() - y0, minlength=side * side).reshape(side, side)
            total = sum(n[radius + i : side - radius + i, radius + j : side - radius + j] for i, j in offsets)
            held = total[x - x0 - radius, y - y0 - radius] >= k
        return pa.table([pa.array(x[held]), pa.array(y[held])], ["x", "y"])

    return run


def dense_near(pixels: DataFrame, tx: DataFrame, k: int, radius: int, x: str, y: str, block: int = 256) -> DataFrame:
    """Rows (x, y) of pixels whose k-th nearest floored transcript is nearer than radius. A square block of pixels and the places of transcripts in and
    around it meet in one task, of a size that the area bounds, so both are shuffled once and no place is spread over pixels."""
    around = lambda c: F.explode(F.sequence(F.floor((F.col(c) - radius) / block), F.floor((F.col(c) + radius) / block)))
    places = tx.select(F.floor(x).alias("_px"), F.floor(y).alias("_py")).where("_px IS NOT NULL AND _py IS NOT NULL")
    dealt = places.withColumn("_gx", around("_px")).withColumn("_gy", around("_py")).groupBy("_gx", "_gy")
    spots = pixels.select(F.col("x").cast("long").alias("x"), F.col("y").cast("long").alias("y")).where("x IS NOT NULL AND y IS NOT NULL")
    cells = spots.withColumn("_gx", F.floor(F.col("x") / block)).withColumn("_gy", F.floor(F.col("y") / block)).groupBy("_gx", "_gy")
    return cells.cogroup(dealt).applyInArrow(_dense(k, radius, block), "x long, y long")


def nearest_points(sites: DataFrame, points: DataFrame, point: str, most: float | None = None, first: float = CELL) -> DataFrame:
    """Rows (point, site, distance) of the nearest site, within `most` if that is given; the least site on ties. sites: site, sx, sy; points:
    point (a key), x, y.

    Points meet the sites of neighbouring cells, and those without a site within a cell's side meet cells of twice the side, so
    only sparse regions look far."""
    good = lambda df, x, y: df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    sites, left = good(sites.select("site", "sx", "sy"), "sx", "sy"), good(points.select(point, "x", "y"), "x", "y")
    empty = left.select(point, F.lit(None).cast(sites.schema["site"].dataType).alias("site"), F.lit(None).cast("double").alias("distance")).limit(0)
    if most is None:
        sites, left = stored(sites), stored(left)
        a, b = sites.agg(*[f(c) for c in ("sx", "sy") for f in (F.min, F.max)]).first(), left.agg(*[f(c) for c in ("x", "y") for f in (F.min, F.max)]).first()
        if a[0] is None or b[0] is None:
            return empty
        far = max(a[1], b[1]) - min(a[0], b[0]) + max(a[3], b[3]) - min(a[2], b[2])
    else:
        far = most
    around = lambda c, r: F.explode(F.sequence(F.floor(F.col(c) / r) - 1, F.floor(F.col(c) / r) + 1))
    dx, dy = F.col("x") - F.col("sx"), F.col("y") - F.col("sy")
    out, r = None, first if most is None else min(first, most)
    while True:
        at = left.withColumn("_gx", F.floor(F.col("x") / r)).withColumn("_gy", F.floor(F.col("y") / r))
        placed = sites.withColumn("_hx", around("sx", r)).withColumn("_hy", around("sy", r))
        near = F.sqrt(dx * dx + dy * dy)
        met = at.join(placed, (F.col("_gx") == F.col("_hx")) & (F.col("_gy") == F.col("_hy")) & (near <= r), "left")
        best = F.min(F.when(F.col("_hx").isNotNull(), F.struct(near.alias("distance"), F.col("site"))))
        each = met.groupBy(point).agg(best.alias("_b"), F.first("x").alias("x"), F.first("y").alias("y"))
        if r >= far and out is None:
            return each.where("_b IS NOT NULL").select(point, "_b.site", "_b.distance")
        each = stored(each)  # what was found and what is left in one pass
        found = each.where("_b IS NOT NULL").select(point, "_b.site", "_b.distance")
        out = found if out is None else out.unionByName(found)
        if r >= far:
            return out
        left = each.where("_b IS NULL").select(point, "x", "y")
        if left.isEmpty():
            return out
        r = 2 * r if most is None else min(2 * r, most)


def _nearest(r: float, reach: int, block: int):
    """Of one block of `block` cells a side, the distance of each of its points to the nearest of the sites in and `reach` cells around it; null where
    none is within `reach` cells."""
    side = block + 2 * reach

    def run(key, points, sites):
        x0, y0 = (k.as_py() * block - reach for k in key)
        cells = lambda t, x, y: (t.column(x).to_numpy(), t.column(y).to_numpy())
        at = lambda x, y: ((np.floor(x / r) - x0) * side + np.floor(y / r) - y0).astype(np.int64)
        sx, sy = cells(sites, "sx", "sy")
        own = at(sx, sy)
        order = np.argsort(own, kind="stable")
        n = np.bincount(own, minlength=side * side)
        slot = np.arange(len(own)) - np.repeat(np.cumsum(n) - n, n)
        deep = int(n.max(initial=0))
        tx, ty = (np.full((deep, side * side), np.inf) for _ in range(2))
        tx[slot, own[order]], ty[slot, own[order]] = sx[order], sy[order]
        px, py = cells(points, "x", "y")
        here, best, left = at(px, py), np.full(len(px), np.inf), np.arange(len(px))
        for k in range(reach + 1):
            if k:  # what lies within k cells has been looked at once the ring of cells k away has
                left = left[best[left] > ((k - 1) * r) ** 2]
            for d in [i * side + j for i in range(-k, k + 1) for j in range(-k, k + 1) if max(abs(i), abs(j)) == k]:
                c = here[left] + d
                for a, b in zip(tx, ty, strict=True):
                    dx, dy = px[left] - a[c], py[left] - b[c]
                    best[left] = np.minimum(best[left], dx * dx + dy * dy)
        distance = np.sqrt(best)
        none = distance > reach * r
        kept = [points.column(c) for c in points.column_names if c not in ("x", "y", "_gx", "_gy")]
        rest = [pa.array(v, mask=~none) for v in (px, py)]
        return pa.table([*kept, *rest, pa.array(distance, mask=none)], [*[c for c in points.column_names if c not in ("x", "y", "_gx", "_gy")], "x", "y", "distance"])

    return run


def nearest_distances(sites: DataFrame, points: DataFrame, keys: list[str], reach: int = 2, block: int = 16, cell: float = CELL) -> DataFrame:
    """Rows (*keys, distance): of each row of points (*keys, x, y) the distance to the nearest site (sx, sy), however far. Points without a place are
    left out; no site, no rows.

    The points of a square block and the sites in and around it meet in one task, of a size that the area bounds, so points are shuffled once and
    pairs never; a point looks at the cells around its own until no nearer site can come. Points with no site near meet larger blocks of larger cells."""
    good = lambda df, *at: df.where(" AND ".join(f"{c} IS NOT NULL AND NOT isnan({c})" for c in at))
    whole = lambda c: F.col(c).cast("double").alias(c)
    sites = stored(good(sites.select(whole("sx"), whole("sy")), "sx", "sy").distinct())
    left, out, r = good(points.select(*keys, whole("x"), whole("y")), "x", "y"), None, cell
    carried = ", ".join(f"{k} {left.schema[k].dataType.simpleString()}" for k in keys)
    if sites.isEmpty():
        return left.select(*keys, F.lit(None).cast("double").alias("distance")).limit(0)
    while True:
        one = lambda c, r=r: F.floor(F.floor(F.col(c) / r) / block)
        all_ = lambda c, r=r: F.explode(F.sequence(F.floor((F.floor(F.col(c) / r) - reach) / block), F.floor((F.floor(F.col(c) / r) + reach) / block)))
        dealt = left.withColumn("_gx", one("x")).withColumn("_gy", one("y")).groupBy("_gx", "_gy")
        around = sites.withColumn("_gx", all_("sx")).withColumn("_gy", all_("sy")).groupBy("_gx", "_gy")
        each = stored(dealt.cogroup(around).applyInArrow(_nearest(r, reach, block), f"{carried}, x double, y double, distance double"))
        found = each.where("distance IS NOT NULL").select(*keys, "distance")
        out = found if out is None else out.unionByName(found)
        left = each.where("distance IS NULL").select(*keys, "x", "y")
        if left.isEmpty():
            return out
        r *= 2


def _kth(k: int, reach: int, block: int):
    """The k-th nearest of the places in and around one block for each of its pixels; null if it lies beyond `reach`."""
    offsets = [(i * i + j * j, i, j) for i in range(-reach, reach + 1) for j in range(-reach, reach + 1) if i * i + j * j <= reach * reach]
    rings = [(d, [(i, j) for _, i, j in own]) for d, own in groupby(sorted(offsets), itemgetter(0))]
    side = block + 2 * reach

    def run(key, pixels, places):
        x0, y0 = (v.as_py() * block - reach for v in key)
        at = np.unique((pixels.column("x").to_numpy() - x0) * side + pixels.column("y").to_numpy() - y0)
        n, d2 = np.zeros(side * side, np.int64), np.full(len(at), -1)
        n[(places.column("_px").to_numpy() - x0) * side + places.column("_py").to_numpy() - y0] = places.column("_n").to_numpy()
        open_, held = np.arange(len(at)), np.zeros(len(at), np.int64)
        for d, own in rings:
            held += sum(n[at[open_] + i * side + j] for i, j in own)
            more = held < k
            d2[open_[~more]] = d
            open_, held = open_[more], held[more]
            if not len(open_):
                break
        distance = pa.array(np.sqrt(np.maximum(d2, 0)), mask=d2 < 0)
        return pa.table([pa.array(at // side + x0), pa.array(at % side + y0), distance], ["x", "y", "distance"])

    return run


def kth_distance(pixels: DataFrame, tx: DataFrame, k: int, x: str, y: str, first: int = 32, block: int = 128) -> DataFrame:
    """Rows (x, y, distance): from each pixel to its k-th nearest floored transcript, infinity where there are fewer than k.

    Transcripts are counted a place. A square block of pixels and the places in and `first` around it meet in one task, of a size that the
    area bounds, which reads the places of each pixel ring by ring until k are found, so pixels and places are shuffled once and pairs never.
    Pixels without k within `first` meet the places of neighbouring cells, of twice the radius a round, so only sparse regions look far."""
    places = stored(tx.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(F.floor(x).alias("_px"), F.floor(y).alias("_py")).agg(F.count("*").alias("_n")))
    spots = pixels.select(F.col("x").cast("long").alias("x"), F.col("y").cast("long").alias("y")).where("x IS NOT NULL AND y IS NOT NULL")
    a = places.agg(F.sum("_n"), F.min("_px"), F.max("_px"), F.min("_py"), F.max("_py")).first()
    b = spots.agg(F.min("x"), F.max("x"), F.min("y"), F.max("y")).first()
    if b[0] is None or (a[0] or 0) < k:
        return spots.distinct().withColumn("distance", F.lit(float("inf")))
    far = max(a[2], b[1]) - min(a[1], b[0]) + max(a[4], b[3]) - min(a[3], b[2])
    near = places.where(F.col("_px").between(b[0] - first, b[1] + first) & F.col("_py").between(b[2] - first, b[3] + first))
    blocks = lambda c: F.explode(F.sequence(F.floor((F.col(c) - first) / block), F.floor((F.col(c) + first) / block)))
    dealt = near.withColumn("_gx", blocks("_px")).withColumn("_gy", blocks("_py")).groupBy("_gx", "_gy")
    cells = spots.withColumn("_gx", F.floor(F.col("x") / block)).withColumn("_gy", F.floor(F.col("y") / block)).groupBy("_gx", "_gy")
    each = stored(cells.cogroup(dealt).applyInArrow(_kth(k, first, block), "x long, y long, distance double"))
    out, left = each.where("distance IS NOT NULL"), each.where("distance IS NULL").select("x", "y")
    around = lambda c, r: F.explode(F.sequence(F.floor(F.col(c) / r) - 1, F.floor(F.col(c) / r) + 1))
    d2 = (F.col("x") - F.col("_px")) * (F.col("x") - F.col("_px")) + (F.col("y") - F.col("_py")) * (F.col("y") - F.col("_py"))
    r = first
    while r <= far and not left.isEmpty():
        r *= 2
        placed = places.withColumn("_gx", around("_px", r)).withColumn("_gy", around("_py", r))
        met = left.withColumn("_gx", F.floor(F.col("x") / r)).withColumn("_gy", F.floor(F.col("y") / r)).join(placed, ["_gx", "_gy"])
        rings = met.select("x", "y", d2.alias("_d"), "_n").where(F.col("_d") <= r * r).groupBy("x", "y", "_d").agg(F.sum("_n").alias("_n"))
        held = rings.withColumn("_n", F.sum("_n").over(W.partitionBy("x", "y").orderBy("_d"))).where(F.col("_n") >= k)
        found = stored(held.groupBy("x", "y").agg(F.sqrt(F.min("_d")).alias("distance")))
        out = out.unionByName(found)
        left = stored(left.join(found, ["x", "y"], "left_anti"))
    return out


def uniformity_p(sums: DataFrame, trials: int, exact: bool) -> DataFrame:
    """sums: gene_id, trial (0: as observed, then the uniform ones), s. Rows (gene_id, p): the share of trials whose sum is no more than the
    observed one, or the normal approximation to it from the trials' mean and deviation. A sum that lacks counts as 0."""
    seen = F.coalesce(F.max(F.when(F.col("trial") == 0, F.col("s"))), F.lit(0.0))
    null = F.collect_list(F.when(F.col("trial") > 0, F.col("s")))  # at most `trials` values
    each = sums.groupBy("gene_id").agg(seen.alias("t"), null.alias("n")).withColumn("n", F.concat("n", F.array_repeat(F.lit(0.0), F.lit(trials) - F.size("n"))))
    if exact:
        return each.select("gene_id", (F.size(F.filter("n", lambda v: v <= F.col("t"))) / trials).alias("p"))
    mean = F.aggregate("n", F.lit(0.0), lambda a, v: a + v) / trials
    var = F.aggregate("n", F.lit(0.0), lambda a, v: a + (v - F.col("m")) * (v - F.col("m"))) / trials
    z = each.withColumn("m", mean).withColumn("sd", F.sqrt(var))
    return z.select("gene_id", S.normal_cdf(F.when(F.col("sd") > 0, (F.col("t") - F.col("m")) / F.col("sd"))).alias("p"))


def flat_rings(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Points (n x 2) of the rings of a column, the rings' lengths and their rows. A value is a ring, a list of rings or null."""
    size = lambda a: pc.fill_null(pc.list_value_length(a), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    row = np.arange(len(column))
    if pa.types.is_list(column.type.value_type):
        row, column = np.repeat(row, size(column)), column.flatten()
    x, y = column.flatten().flatten()[:2]
    return np.column_stack([c.cast(pa.float64()).to_numpy(zero_copy_only=False) for c in (x, y)]), size(column), row


def distances_to(points: np.ndarray, n: np.ndarray, x: np.ndarray, y: np.ndarray, times: np.ndarray | int = 1) -> np.ndarray:
    """S.ring_distance of points (x, y), each with the ring of the next n of `points`; nan where n is 0. times: how often an edge that is crossed counts."""
    out = np.full(len(n), np.nan)
    some, start = n > 0, np.cumsum(n) - n
    if not some.any():
        return out
    after = np.arange(1, len(points) + 1)
    after[(start + n - 1)[some]] = start[some]
    (x1, y1), (x2, y2) = points.T, points[after].T
    px, py = np.repeat(x, n), np.repeat(y, n)
    dx, dy = x2 - x1, y2 - y1
    with np.errstate(divide="ignore", invalid="ignore"):
        across = px < x1 + (py - y1) * dx / dy
        t = np.where((dx != 0) | (dy != 0), np.clip(((px - x1) * dx + (py - y1) * dy) / (dx * dx + dy * dy), 0.0, 1.0), 1.0)
    crossed = ((y1 > py) != (y2 > py)) & across
    on = (dx * (py - y1) == dy * (px - x1)) & (px >= np.minimum(x1, x2)) & (px <= np.maximum(x1, x2)) & (py >= np.minimum(y1, y2)) & (py <= np.maximum(y1, y2))
    ex, ey = x1 + t * dx - px, y1 + t * dy - py
    d = np.sqrt(np.minimum.reduceat(ex * ex + ey * ey, start[some]))
    crossings = np.add.reduceat(crossed.astype(np.int64), start[some]) * np.broadcast_to(times, n.shape)[some]
    inside = (crossings % 2 == 1) | np.logical_or.reduceat(on, start[some])
    out[some] = np.where(inside, 0.0, d)
    return out


def ring_distances(ring: pa.Array, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """S.ring_distance of many points and rings, nan where a ring is null or empty."""
    points, n, _ = flat_rings(ring)
    return distances_to(points, n, x, y)


def _distances(batches):
    for b in batches:
        d = ring_distances(b.column(1), *(b.column(k).cast(pa.float64()).to_numpy(zero_copy_only=False) for k in (2, 3)))
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(d, mask=np.isnan(d))], ["row", "d"])


def tile_ownership(polygons: DataFrame, tiles: DataFrame, id_col: str) -> DataFrame:
    """Rows (id_col, tile_id): the tile whose centre is nearest to the polygon, the least on ties. Polygons meet the centres in the cells of a
    tile's side that they come near; one without a centre within that side meets cells of twice the side, and so on."""
    centers = stored(tiles.select("tile_id", ((F.col("x1") + F.col("x2")) / 2).alias("tx"), ((F.col("y1") + F.col("y2")) / 2).alias("ty"), (F.col("x2") - F.col("x1")).alias("_side")))
    left = stored(polygons.select(id_col, "ring"))
    ends = centers.agg(F.max("_side"), F.min("tx"), F.max("tx"), F.min("ty"), F.max("ty")).first()
    b = S.ring_bounds(F.col("ring"))
    box = left.agg(F.min(b["xmin"]), F.max(b["xmax"]), F.min(b["ymin"]), F.max(b["ymax"])).first()
    if ends[0] is None or box[0] is None:
        return left.select(id_col, F.lit(None).cast("long").alias("tile_id")).limit(0)
    far, r, out = max(ends[2], box[1]) - min(ends[1], box[0]) + max(ends[4], box[3]) - min(ends[3], box[2]), float(ends[0]), None
    away = lambda low, v, high: F.greatest(F.col(low) - F.col(v), F.lit(0.0), F.col(v) - F.col(high))
    apart = F.hypot(away("_xmin", "tx", "_xmax"), away("_ymin", "ty", "_ymax"))  # of the box, so the polygon isn't nearer
    while True:
        placed = centers.withColumn("_gx", F.floor(F.col("tx") / r)).withColumn("_gy", F.floor(F.col("ty") / r))
        near = covered(left, r, r).join(placed, ["_gx", "_gy"]).where(apart <= r + 1e-6).select(F.struct(id_col, "tile_id").alias("row"), "ring", "tx", "ty")
        measured = near.mapInArrow(_distances, f"row {near.schema['row'].dataType.simpleString()}, d double")
        met = measured.select("row.*", F.round("d", 9).alias("d")).where(F.col("d") <= r)
        found = stored(met.groupBy(id_col).agg(F.min(F.struct("d", "tile_id")).alias("_b")).select(id_col, F.col("_b.tile_id").alias("tile_id")))
        out = found if out is None else out.unionByName(found)
        left = stored(left.join(found.select(id_col), id_col, "left_anti"))
        if r >= far or left.isEmpty():
            return out
        r *= 2


def seen_by_tiles(polygons: DataFrame, tiles: DataFrame, id_col: str, size: int) -> DataFrame:
    """Rows (tile_id, id_col, ring): each polygon with every tile that its box meets, in the tile's coordinates; one that meets no tile goes with the
    tile of the nearest centre. A pair is met once, in the cell of the common corner of polygon and tile."""
    cell = lambda c: F.floor(F.col(c) / size)
    boxed = covered(polygons.select(id_col, "ring"), 0.0, size)
    placed = tiles.withColumn("_gx", F.explode(F.sequence(cell("x1"), cell("x2")))).withColumn("_gy", F.explode(F.sequence(cell("y1"), cell("y2"))))
    corner = (F.col("_gx") == F.greatest(cell("_xmin"), cell("x1"))) & (F.col("_gy") == F.greatest(cell("_ymin"), cell("y1")))
    met = boxed.join(placed, ["_gx", "_gy"]).where(corner & (F.col("_xmin") < F.col("x2")) & (F.col("_xmax") > F.col("x1")) & (F.col("_ymin") < F.col("y2")) & (F.col("_ymax") > F.col("y1")))
    met = stored(met.select("tile_id", id_col, "ring", "x1", "y1"))
    lone = polygons.select(id_col, "ring").join(met.select(id_col), id_col, "left_anti")
    near = lone.join(tile_ownership(lone, tiles, id_col), id_col).join(tiles.select("tile_id", "x1", "y1"), "tile_id")
    local = F.transform("ring", lambda q: F.struct((q["x"] - F.col("x1")).alias("x"), (q["y"] - F.col("y1")).alias("y")))
    return met.unionByName(near).select("tile_id", id_col, local.alias("ring"))


def pixel_overlaps(a: DataFrame, b: DataFrame, a_col: str, b_col: str) -> DataFrame:
    """Rows (a_col, b_col, overlap) of two pixel tables (x, y, id): an equi-join on pixels."""
    return a.join(b, ["x", "y"]).groupBy(a_col, b_col).agg(F.count("*").alias("overlap"))


def max_overlap(overlaps: DataFrame, key: str, other: str, threshold: float) -> DataFrame:
    """For each key the other of largest overlap over the threshold, the least id on ties."""
    best = F.row_number().over(W.partitionBy(key).orderBy(F.desc("overlap"), other))
    return overlaps.where(F.col("overlap") > threshold).withColumn("_r", best).where("_r = 1").drop("_r")


def ray_hits(pixels: DataFrame, polygons: DataFrame, id_col: str, most: float) -> DataFrame:
    """Rows (x, y, id_col, distance): the first polygon edge that the ray from a pixel's centre along its angle meets within `most`."""
    ox, oy, dx, dy = F.col("x") + 0.5, F.col("y") + 0.5, F.cos("angle"), F.sin("angle")
    at = pixels.select("x", "y", "angle", F.floor(ox / CELL).alias("_gx"), F.floor(oy / CELL).alias("_gy"))
    edges = polygons.select(id_col, F.explode(S.ring_edges(F.col("ring"))).alias("e")).select(id_col, "e.*")
    span = lambda a, b: F.explode(F.sequence(F.floor((F.least(a, b) - most) / CELL), F.floor((F.greatest(a, b) + most) / CELL)))
    placed = edges.withColumn("_gx", span("x1", "x2")).withColumn("_gy", span("y1", "y2"))
    ex, ey = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    det = dx * ey - dy * ex
    safe = F.when(F.abs(det) > 1e-10, det)
    t = ((F.col("x1") - ox) * ey - (F.col("y1") - oy) * ex) / safe
    u = ((F.col("x1") - ox) * dy - (F.col("y1") - oy) * dx) / safe
    met = at.join(placed, ["_gx", "_gy"]).select("x", "y", id_col, t.alias("t"), u.alias("u")).where((F.col("t") >= 0) & (F.col("t") <= most) & F.col("u").between(0, 1))
    return met.groupBy("x", "y").agg(F.min(F.struct("t", id_col)).alias("_b")).select("x", "y", F.col(f"_b.{id_col}").alias(id_col), F.col("_b.t").alias("distance"))
