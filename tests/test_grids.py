"""Outlines, nearest neighbours, tile scoring and combination against brute force."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_spatial import box

from cellweave.functions import scalars as S
from cellweave.operators import grid, predictions, shapes, spatial
from cellweave.plans import jobs


def segments(spark, cells):
    return spark.createDataFrame([(s, x, y) for s, pixels in cells.items() for x, y in pixels], "segment_id long, x long, y long")


def walked(pixels):
    """Rings of a set of pixels by walking its edges, a left turn first at corners that two pixels touch."""
    out = {}
    for x, y in pixels:
        for near, a, b in (((x, y - 1), (x, y), (x + 1, y)), ((x + 1, y), (x + 1, y), (x + 1, y + 1)), ((x, y + 1), (x + 1, y + 1), (x, y + 1)), ((x - 1, y), (x, y + 1), (x, y))):
            if near not in pixels:
                out.setdefault(a, []).append(b)
    rings = []
    while out:
        at = start = min(out)
        ring, came = [], None
        while True:
            ring.append(at)
            ways = out[at]
            if came and len(ways) > 1:
                ways.sort(key=lambda w: -(came[0] * (w[1] - at[1]) - came[1] * (w[0] - at[0])))
            to = ways.pop(0)
            if not ways:
                del out[at]
            came, at = (to[0] - at[0], to[1] - at[1]), to
            if at == start:
                break
        rings.append(ring)
    return rings


def test_outlines_with_holes_and_touching_corners(spark):
    r = random.Random(3)
    cells = {k: {(x, y) for x in range(9) for y in range(9) if r.random() < 0.6} for k in range(6)}
    cells[10] = {(x, y) for x in range(40) for y in range(3)}  # a long ring
    cells[11] = {(x, y) for x in range(5) for y in range(5)} - {(2, 2)}
    cells[12] = {(0, 0), (1, 1)}
    cells[13] = {(7, 7)}
    got = {}
    for row in shapes.chained(shapes.boundary_edges(segments(spark, cells))).collect():
        got.setdefault(row.segment_id, []).append((row.ring, [(p.x, p.y) for p in row.points]))
    assert got.keys() == cells.keys()
    for k, pixels in cells.items():
        rings = [ring for _, ring in sorted(got[k])]
        assert [i for i, _ in sorted(got[k])] == list(range(len(rings)))
        assert sorted(map(tuple, rings)) == sorted(tuple((float(x), float(y)) for x, y in ring) for ring in walked(pixels)), k
    assert len(got[11]) == 2 and len(got[12]) == 2


def test_signed_areas_take_holes_off(spark):
    cells = {1: {(x, y) for x in range(5) for y in range(5)} - {(2, 2), (2, 3)}}
    rings = shapes.chained(shapes.boundary_edges(segments(spark, cells)))
    assert rings.agg(F.sum(S.ring_area_signed(F.col("points")))).first()[0] == 23
    assert shapes.chained(shapes.boundary_edges(segments(spark, {}))).count() == 0


@pytest.mark.parametrize("most", [None, 30.0])
def test_nearest_points_however_far(spark, most):
    r = random.Random(1)
    sites = [(i, r.uniform(0, 200), r.uniform(0, 200)) for i in range(30)] + [(50, 10.0, 10.0), (49, 10.0, 10.0), (60, None, 1.0)]
    points = [(i, r.uniform(-50, 250), r.uniform(-50, 250)) for i in range(100)] + [(200, 5000.0, -3000.0), (201, 10.0, 10.0), (202, None, 3.0)]
    got = {x.p: (x.site, x.distance) for x in spatial.nearest_points(spark.createDataFrame(sites, "site long, sx double, sy double"), spark.createDataFrame(points, "p long, x double, y double"), "p", most).collect()}
    want = {}
    for i, x, y in points:
        if x is not None:
            d, s = min((math.sqrt((x - a) * (x - a) + (y - b) * (y - b)), s) for s, a, b in sites if a is not None)
            if most is None or d <= most:
                want[i] = (s, d)
    assert got.keys() == want.keys() and (most or len(got) == 102)
    for i, (s, d) in want.items():
        assert got[i] == (s, pytest.approx(d))


def test_nearest_points_of_nothing(spark):
    sites, points = spark.createDataFrame([], "site long, sx double, sy double"), spark.createDataFrame([(1, 2.0, 3.0)], "p long, x double, y double")
    assert spatial.nearest_points(sites, points, "p").count() == 0
    assert spatial.nearest_points(sites.unionByName(spark.createDataFrame([(1, 0.0, 0.0)], sites.schema)), points.limit(0), "p").count() == 0


def test_a_scorer_sees_whole_tiles(spark, monkeypatch):
    monkeypatch.setattr(predictions, "TILES_AT_ONCE", 2)
    tiles = grid.tile_grid(spark, 20, 12, 8, 0.25)
    r = random.Random(2)
    cells = {(x, y): (float(r.randint(1, 9)), r.random()) for x in range(20) for y in range(12) if r.random() < 0.3}
    pixels = spark.createDataFrame([(x, y, *v) for (x, y), v in cells.items()], "x long, y long, a double, b double")

    def score(batch, model):
        total = batch.sum((1, 2))[:, None, None, :]  # over the tile, so that padding and neighbours would show
        return np.stack([batch[..., 0] * model[0] + total[..., 1], batch[..., 1] + model[1] + 0 * total[..., 0]], -1)

    got = {(q.tile_id, q.x, q.y): (q.u, q.v) for q in predictions.score_tiles(pixels, tiles, 8, ["a", "b"], score, (3.0, 0.5), ["u", "v"]).collect()}
    want = {}
    for t in tiles.collect():
        inside = {(x, y): cells.get((x, y), (0.0, 0.0)) for x in range(t.x1, t.x2) for y in range(t.y1, t.y2)}
        total = sum(v[1] for v in inside.values())
        want |= {(t.tile_id, *p): (3 * v[0] + total, v[1] + 0.5) for p, v in inside.items()}
    assert got.keys() == want.keys()
    for k, v in want.items():
        assert got[k] == pytest.approx(v)


def test_combined_tiles_keep_one_copy_of_each_segment(spark):
    tiles = grid.tile_grid(spark, 20, 20, 10, 0.5)
    spots = [(4, 4), (14, 14), (7, 7), (1, 13), (12, 4)]
    rows, corner = [], {t.tile_id: (t.x1, t.y1, t.x2, t.y2) for t in tiles.collect()}
    for t, (x1, y1, x2, y2) in corner.items():
        seen = [(x, y) for x, y in spots if x1 <= x and x + 2 <= x2 and y1 <= y and y + 2 <= y2]
        rows += [(t, k, [{"x": float(a - x1), "y": float(b - y1)} for a, b in box(x, y, x + 2, y + 2)]) for k, (x, y) in enumerate(seen)]
    assert len(rows) > len(spots)  # overlapping tiles see some twice
    out = jobs.combined(spark.createDataFrame(rows, "tile_id long, local_id long, ring array<struct<x:double,y:double>>"), tiles).collect()
    assert sorted(min((p.x, p.y) for p in r.ring) for r in out) == sorted((float(x), float(y)) for x, y in spots)
    order = sorted((r.tile_id, r.local_id, r.global_id) for r in out)
    assert [g for _, _, g in order] == list(range(len(spots)))
    for r in out:  # no other centre is nearer
        x, y = (sum(p[c] for p in r.ring) / 4 for c in ("x", "y"))
        near = lambda t: math.dist((x, y), ((corner[t][0] + corner[t][2]) / 2, (corner[t][1] + corner[t][3]) / 2))  # noqa: E731, B023
        assert near(r.tile_id) <= min(map(near, corner)) + 1.5


def test_pixels_are_made_by_many_tasks_and_not_taken_for_few(spark, monkeypatch):
    """The derived raster is split by lattice cells, and the optimizer doesn't hold it for small enough to broadcast whatever its size."""
    import duckdb
    from cellweave.plans import fixtures

    data = "/root/testdata/sf0.001"
    monkeypatch.setattr(fixtures, "CELLS_A_PART", 5, raising=False)
    df = fixtures.table(spark, data, "pixels")
    assert df.select("x").rdd.getNumPartitions() > 4
    rows = sorted(map(tuple, df.collect()), key=lambda r: r[:2])
    real = len(rows) * len(df.columns) * 8
    for name in ("pixels", "pred"):
        assert int(fixtures.table(spark, data, name)._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()) > real
    con = duckdb.connect()
    con.execute(f"CREATE VIEW customer AS SELECT * FROM '{data}/customer.parquet'")
    assert rows == sorted(con.sql(fixtures.duckdb("SELECT * FROM {pixels}")).fetchall(), key=lambda r: r[:2])


def test_tile_grid_is_a_range_of_the_tiles_starts(spark):
    for width, height, size, overlap in ((160, 640, 64, 0.2), (50, 300, 64, 0.25), (64, 64, 64, 0.2), (65, 117, 64, 0.2)):
        xs, ys = grid.tile_starts(width, size, overlap), grid.tile_starts(height, size, overlap)
        out = grid.tile_grid(spark, width, height, size, overlap)
        assert out._jdf.queryExecution().analyzed().toString().count("Range (") == 1  # not a list that the driver holds
        assert sorted(map(tuple, out.collect())) == [(i * len(ys) + j, x, y, x + size, y + size) for i, x in enumerate(xs) for j, y in enumerate(ys)]


def test_a_folder_is_written_by_the_task_that_has_its_rows(spark, tmp_path):
    """Many tasks and folders: a file a folder, not one for each task that met it."""
    from cellweave.sources import io

    points = spark.range(4000).repartition(8).select("id", (F.col("id") * 37 % 256).cast("double").alias("x_location"), (F.col("id") * 91 % 256).cast("double").alias("y_location"))
    tiles = grid.tile_grid(spark, 256, 256, 64, 0.2)
    io.write_transcript_tiles(points, tiles, str(tmp_path / "t"), 64)
    io.write_grid(points.select(F.col("x_location").cast("long").alias("x"), F.col("y_location").cast("long").alias("y"), "id"), str(tmp_path / "g"))
    for name, depth in (("t", "*"), ("g", "*/*")):
        folders = list((tmp_path / name).glob(f"{depth}=*"))
        assert len(folders) > 11 and all(len(list(f.glob("*.parquet"))) == 1 for f in folders)
        assert spark.read.parquet(str(tmp_path / name)).select("id").distinct().count() == 4000


def test_points_left_over_are_not_joined_with_those_found(spark, tmp_path, monkeypatch):
    """A round of nearest neighbours writes what it found and what is left at once: points meet sites and are folded, nothing else."""
    plans = []
    monkeypatch.setattr(spatial, "stored", lambda df: plans.append(df._jdf.queryExecution().analyzed().toString()) or df.localCheckpoint())
    sites = spark.createDataFrame([(1, 0.0, 0.0), (2, 100.0, 0.0)], "site long, sx double, sy double")
    points = spark.createDataFrame([(1, 3.0, 4.0), (2, 60.0, 0.0), (3, 400.0, 0.0)], "p long, x double, y double")
    out = spatial.nearest_points(sites, points, "p").collect()
    assert sorted((r.p, r.site, r.distance) for r in out) == [(1, 1, 5.0), (2, 2, 40.0), (3, 2, 300.0)]
    assert not any("LeftAnti" in p for p in plans) and any("LeftOuter" in p for p in plans)


def test_pixels_are_made_without_a_broadcast(spark):
    """Beside broadcast cells the tasks that scan the nuclei, one for a small file, would make all pixels."""
    from cellweave.plans import fixtures

    for name in ("pixels", "pred"):
        rows = fixtures.table(spark, "/root/testdata/sf0.01", name).where("x >= 0").select("x", "y")
        for df in (rows, fixtures.table(spark, "/root/testdata/sf0.01", "pixels").where("dx IS NOT NULL").select("x", "y", "dx")):
            assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()
        assert rows.count() == spark.read.parquet("/root/testdata/sf0.01/customer.parquet").where("c_custkey % 40 < 8").count() * 400 or name == "pixels"
