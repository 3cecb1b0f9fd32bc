"""What is done in blocks or in batches: the same results as the plain way, and no more work than that."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from test_overlay import arrays, star
from test_spatial import box

from cellweave.functions import scalars as S
from cellweave.operators import celltypes, expand, overlay, shapes, spatial
from cellweave.plans import queries, queries_jobs, queries_reports  # noqa: F401

SMALL = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_pixels_and_predictions_are_made_together(spark):
    t = queries.Tables(spark, SMALL)
    joined = t.pixels.select("x", "y", "label").join(t.pred.select("x", "y", "angle", "foreground"), ["x", "y"], "left").fillna(0.0, ["angle", "foreground"])
    made = queries._with_pred(t)
    assert joined.exceptAll(made).isEmpty() and made.count() == joined.count()
    assert plan(made).count("Range (") == 1  # one raster, not two that are joined


def test_growth_deals_pixels_only_to_blocks_of_the_raster(spark):
    width, height = 40, 90
    px = spark.range(width * height).select((F.col("id") % width).alias("x"), F.expr(f"id div {width}").alias("y"), F.lit(-1).cast("long").alias("label"), F.lit(0.0).alias("angle"), F.lit(1.0).alias("foreground"))
    seen = []
    apply = type(px.groupBy("x")).applyInArrow
    try:
        type(px.groupBy("x")).applyInArrow = lambda self, f, schema: seen.append(self._df) or apply(self, f, schema)
        out = expand.grown(px, width, height, 3, block=32)
    finally:
        type(px.groupBy("x")).applyInArrow = apply
    assert {tuple(r) for r in seen[0].select("bx", "by").distinct().collect()} == {(i, j) for i in range(2) for j in range(3)}
    assert out.count() == width * height


@pytest.mark.parametrize("wide", [96, 20, 0])
def test_areas_of_many_rows_equal_those_of_one(wide, monkeypatch):
    monkeypatch.setattr(overlay, "WIDE", wide)
    monkeypatch.setattr(overlay, "CUTS", 5000)  # several rounds of rows and slabs
    r = random.Random(wide)
    near = lambda k, n: [star(r, n, r.uniform(-4, 4), r.uniform(-4, 4)) for _ in range(k)]
    bow, flat, square = [(0, 0), (2, 2), (2, 0), (0, 2)], [(0, 0), (1, 1), (2, 2)], box(0, 0, 3, 3)
    whole = [*near(40, 8), None, square, bow, flat, [], [(0, 0), (1, 1)], square, square]
    lists = [*[near(r.randrange(4), r.randrange(3, 12)) for _ in range(40)], [square, box(2, 2, 5, 5)], None, [bow], [square], [], [flat, square], [square, square], [square]]
    third = [*near(40, 5), square, *[None] * 6, box(1, -1, 2, 9)]
    point = pa.struct([("x", pa.float64()), ("y", pa.float64())])
    as_points = lambda ring: None if ring is None else [{"x": float(x), "y": float(y)} for x, y in ring]
    columns = [
        pa.array([as_points(v) for v in whole], pa.list_(point)),
        pa.array([None if v is None else [as_points(q) for q in v] for v in lists], pa.list_(pa.list_(point))),
        pa.array([as_points(v) for v in third], pa.list_(point)),
    ]
    want = [overlay.combined_areas([arrays(*([a] if a else [])), arrays(*(b or [])), arrays(*([c] if c else []))]) for a, b, c in zip(whole, lists, third, strict=True)]
    for lo, hi in ((0, 48), (7, 45), (41, 44)):  # slices of a batch too
        got = overlay.areas_of_rows([c[lo:hi] for c in columns])
        assert np.allclose(got, want[lo:hi], atol=1e-9)
    assert overlay.areas_of_rows([c[:0] for c in columns]).shape == (0, 8)


def test_a_row_of_few_points_is_not_measured_by_itself(monkeypatch):
    monkeypatch.setattr(overlay, "combined_areas", None)
    ring = [{"x": float(x), "y": float(y)} for x, y in box(0, 0, 3, 3)]
    kind = pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())]))
    assert next(overlay._measured(2)([pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array([ring, None], kind), pa.array([ring, ring], kind)], ["row", "_0", "_1"])])).column(1).to_pylist() == [[0, 0, 0, 9], [0, 0, 9, 0]]


def test_distances_of_many_points_equal_those_of_one(spark):
    r = random.Random(5)
    rings = [*[star(r, r.randrange(3, 12), r.uniform(-3, 3), r.uniform(-3, 3)) for _ in range(200)], box(0, 0, 4, 4), [(0, 0), (4, 0), (4, 0), (4, 4), (0, 4)], None, []]
    at = [*[(r.uniform(-8, 8), r.uniform(-8, 8)) for _ in range(200)], (4.0, 2.0), (4.0, 9.0), (0.0, 0.0), (0.0, 0.0)]
    made = [(k, None if ring is None else [(float(x), float(y)) for x, y in ring], *p) for k, (ring, p) in enumerate(zip(rings, at, strict=True))]
    df = spark.createDataFrame(made, "k long, ring array<struct<x:double,y:double>>, x double, y double").coalesce(1)
    want = [v.d for v in df.where("size(ring) > 0").orderBy("k").select(S.ring_distance(F.col("ring"), F.col("x"), F.col("y")).alias("d")).collect()]
    t = df.orderBy("k").toArrow().combine_chunks()
    got = spatial.ring_distances(t.column("ring").chunk(0), t.column("x").to_numpy(), t.column("y").to_numpy())
    assert np.allclose(got[:202], want, atol=1e-12) and np.isnan(got[202:]).all() and (got == 0).sum() > 10
    tiles = spark.createDataFrame([(0, 0, 0, 8, 8), (1, 6, 0, 14, 8)], "tile_id long, x1 long, y1 long, x2 long, y2 long")
    owned = spatial.tile_ownership(df.where("k < 202").select("k", "ring"), tiles, "k")
    assert owned.count() == 202


def test_increments_are_made_once_and_of_the_raster_only(spark):
    t = queries.Tables(spark, SMALL)
    made = plan(queries_reports._increments(t))
    assert "Range (" in made and "<= 159" in made
    assert "Range (" not in plan(celltypes.confidence_trace(queries_reports._increments(t), *queries._start(t), 4))  # what is read twice was written


@pytest.mark.parametrize("block", [4, 192])
def test_outlines_that_leave_their_blocks_equal_outlines_in_one(spark, block):
    r = random.Random(3)
    cells = {(x, y): 1 + (x // 7) + 3 * (y // 9) for x in range(21) for y in range(18) if r.random() < 0.8}  # with holes and corners that touch
    cells |= {(x, y): 99 for x in range(30, 60) for y in range(20) if 0 < x % 15 < 13 or y == 0}
    segments = spark.createDataFrame([(s, x, y) for (x, y), s in cells.items()], "segment_id long, x long, y long")
    edges = shapes.boundary_edges(segments, block)
    around = {(s, *(v + d for v, d in zip((x, y, x, y), ends, strict=True))) for (x, y), s in cells.items() for (i, j), ends in shapes._SIDES if cells.get((x + i, y + j)) != s}
    found = [tuple(e) for e in edges.collect()]
    assert set(found) == around and len(found) == len(around)
    used = []
    for s, k, points in shapes.chained(edges, block).collect():
        ring = [(int(p.x), int(p.y)) for p in points]
        assert ring[0] == min(ring)
        used += [(s, *p, *q) for p, q in zip(ring, ring[1:] + ring[:1], strict=True)]
    assert sorted(used) == sorted(around)
    first = {}
    for s, k, points in shapes.chained(edges, block).collect():
        first.setdefault(s, []).append((k, (points[0].x, points[0].y)))
    assert all([k for k, _ in sorted(v)] == list(range(len(v))) and [p for _, p in sorted(v)] == sorted(p for _, p in v) for v in first.values())


def test_rings_within_a_block_take_no_part_in_rounds(spark, monkeypatch):
    segments = spark.createDataFrame([(k, 5 * k + i, j) for k in range(20) for i in range(3) for j in range(3)], "segment_id long, x long, y long")
    sizes = []
    monkeypatch.setattr(shapes, "stored", lambda df: sizes.append(df.count()) or df.localCheckpoint())
    assert shapes.chained(shapes.boundary_edges(segments)).count() == 20
    assert sizes[-2:] == [0, 0] and len(sizes) == 5
