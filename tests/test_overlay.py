"""Overlaid polygons against boxes, golden cases and sampled points."""

import random

import numpy as np
import pytest
from test_spatial import box, polygons, rows

from cellweave.functions import scalars as S
from cellweave.operators import overlay, spatial


def star(r, n, cx=0.0, cy=0.0):
    """A ring that is hardly ever convex."""
    return [(cx + (d := r.uniform(1, 5)) * np.cos(2 * np.pi * k / n), cy + d * np.sin(2 * np.pi * k / n)) for k in range(n)]


def inside(ring, x, y):
    """Even-odd rule for many points."""
    out = np.zeros(len(x), bool)
    for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1], strict=True):
        out ^= ((y1 > y) != (y2 > y)) & (x < x1 + (y - y1) * (x2 - x1) / ((y2 - y1) or 1))
    return out


def area(ring):
    return abs(sum(a * d - b * c for (a, b), (c, d) in zip(ring, ring[1:] + ring[:1], strict=True))) / 2


def arrays(*rings):
    return [np.array(r, float) for r in rings]


def test_areas_of_boxes_are_exact():
    a, b, c = box(0, 0, 4, 4), box(1, 1, 6, 3), box(3, -1, 5, 2)
    got = overlay.combined_areas([arrays(a), arrays(b), arrays(c)])
    both = lambda *bits: sum(v for k, v in enumerate(got) if all(k >> i & 1 for i in bits))
    assert (both(0), both(1), both(2)) == pytest.approx((16, 10, 6))
    assert (both(0, 1), both(0, 2), both(1, 2), both(0, 1, 2)) == pytest.approx((6, 2, 2, 1))


def test_a_layer_is_the_union_of_its_rings():
    got = overlay.combined_areas([arrays(box(0, 0, 10, 10)), arrays(box(1, 1, 5, 5), box(3, 3, 7, 7), box(3, 3, 7, 7), box(20, 0, 21, 1))])
    assert got.tolist() == pytest.approx([0, 100 - 28, 1, 28])


def test_crossed_and_flat_rings():
    bow = [(0, 0), (2, 2), (2, 0), (0, 2)]  # crosses itself
    assert overlay.combined_areas([arrays(bow)])[1] == pytest.approx(2)
    assert overlay.combined_areas([arrays([(0, 0), (1, 1), (2, 2)]), []]).tolist() == pytest.approx([0, 0, 0, 0])
    assert overlay.combined_areas([[], []]).tolist() == [0, 0, 0, 0]


@pytest.mark.parametrize("seed", range(3))
def test_areas_of_stars_agree_with_sampled_points(seed, monkeypatch):
    monkeypatch.setattr(overlay, "CUTS", 500)  # several rounds of slabs
    r, g = random.Random(seed), np.random.default_rng(seed)
    layers = [[star(r, 9)], [star(r, 12, 1.5, 0.5), star(r, 7, -1, 1)], [star(r, 15, 0, -1)]]
    got = overlay.combined_areas([arrays(*layer) for layer in layers])
    x, y = g.uniform(-7, 7, (2, 400_000))
    code = sum(np.any([inside(ring, x, y) for ring in layer], 0).astype(int) << k for k, layer in enumerate(layers))
    want = np.bincount(code, minlength=8) / len(x) * 14 * 14
    assert got[1:] == pytest.approx(want[1:], abs=0.25)
    assert sum(v for k, v in enumerate(got) if k & 1) == pytest.approx(area(layers[0][0]))


def test_pairs_are_met_once_and_equal_all_pairs(spark):
    r = random.Random(4)
    a = [(i, star(r, 8, r.uniform(-40, 40), r.uniform(-40, 40))) for i in range(40)] + [(100, box(-60, -60, 60, 60))]
    b = [(i, star(r, 6, r.uniform(-40, 40), r.uniform(-40, 40))) for i in range(40)]
    got = {(p, q): (o, u) for p, q, o, u in rows(overlay.intersections(polygons(spark, a, "a"), polygons(spark, b, "b"), "a", "b", 1e-9))}
    want = {}
    for i, p in a:
        for j, q in b:
            c = overlay.combined_areas([arrays(p), arrays(q)])
            if c[3] > 1e-9:
                want[i, j] = (c[3], c[1] + c[2] + c[3])
    assert got.keys() == want.keys() and len(got) == len(overlay.intersections(polygons(spark, a, "a"), polygons(spark, b, "b"), "a", "b", 1e-9).collect())
    for k in want:
        assert got[k] == pytest.approx(want[k])
    left = {i: (s, o) for i, s, o in rows(overlay.differences(polygons(spark, a, "a"), polygons(spark, b, "b"), "a", "b"))}
    for i, p in a:
        c = overlay.combined_areas([arrays(p), arrays(*[q for _, q in b])])
        assert left[i] == pytest.approx((area(p), c[1]))


def test_intersection_over_union(spark):
    a = polygons(spark, [(1, box(3, 3, 4, 4)), (2, box(6, 6, 7, 7))], "a")
    b = polygons(spark, [(1, box(3, 3, 5, 5)), (2, box(6, 6, 7, 7))], "b")
    assert {round(r.overlap / r.union_area, 9) for r in overlay.best_overlap(a, b, "a", "b", 0.01).collect()} == {0.25, 1.0}


def test_equal_overlaps_go_to_the_least_id(spark):
    a, b = polygons(spark, [(1, box(0, 0, 4, 2))], "a"), polygons(spark, [(8, box(2, 0, 5, 2)), (5, box(-1, 0, 2, 2)), (9, box(0, 0, 1, 1))], "b")
    assert [r.b for r in overlay.best_overlap(a, b, "a", "b", 1.0).collect()] == [5]
    assert overlay.best_overlap(a, b, "a", "b", 4.0).count() == 0


def members(spark, table, key, points):
    p = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(points)], "transcript_id long, x double, y double")
    return spatial.points_in_polygons(table, p, "x", "y").select(key, "transcript_id")


def test_nuclear_prior_benchmark_by_hand(spark):
    truth = polygons(spark, [(1, box(0, 0, 4, 4)), (2, box(4, 0, 8, 4)), (3, box(20, 0, 24, 4)), (4, box(40, 0, 44, 4))], "truth_id")
    method = polygons(spark, [(10, box(1, 0, 5, 4)), (30, box(21, 0, 25, 4)), (40, box(40, 0, 42, 4))], "segment_id")
    nuclei = polygons(spark, [(7, box(0, 0, 2, 2)), (8, box(5, 1, 7, 3)), (9, box(22, 0, 24, 2))], "nucleus_id")
    points = [(0.5, 0.5), (3, 1), (4.5, 1), (6, 2), (7.5, 3.5), (23, 1), (24.5, 1), (41, 1), (60, 60)]
    tables = {"truth_id": truth, "segment_id": method, "nucleus_id": nuclei}
    out = {r.truth_id: r for r in overlay.nuclear_prior_benchmark(*tables.values(), *[members(spark, t, k, points) for k, t in tables.items()]).collect()}
    # cell 1: segment 10 with nucleus 7 covers 12 + 2 of it and 4 outside
    assert (out[1].segment_id, out[1].intersection_area, out[1].union_area) == (10, pytest.approx(14), pytest.approx(20))
    # transcripts 0, 1 and 2 are in the segment or its nucleus, 0 and 1 in the cell
    assert (out[1].jaccard_intersection, out[1].jaccard_union) == (2, 3)
    # cell 2 shares 4 with segment 10 too, and has nucleus 8: 4 + 4 inside, 12 outside
    assert (out[2].segment_id, out[2].intersection_area, out[2].union_area) == (10, pytest.approx(8), pytest.approx(28))
    # errors of segment 10 are counted over both cells, the greater id being its own: 0, 1 and again 1 are cell 1's
    assert {(out[i].n_transcripts, out[i].n_confused, out[i].n_background) for i in (1, 2)} == {(6, 3, 0)}
    assert (out[3].iou, out[3].n_background) == (pytest.approx(12 / 20), 1)
    assert out[4].segment_id == 40 and out[4].iou is None and out[4].jaccard_index is None  # no nucleus overlaps it


def test_clipped_rings(spark):
    p = polygons(spark, [(0, box(0, 0, 1, 1)), (1, box(10, 10, 11, 11)), (2, box(4, 4, 6, 7)), (3, box(-5, -5, 50, 50)), (4, box(20, 5, 30, 9))])
    got = {r.segment_id: r.ring for r in overlay.to_raster_space(p, 5, 5, 20, 20, 0.5).collect()}
    assert got.keys() == {1, 2, 3}
    flat = lambda ring: [(q.x, q.y) for q in ring]
    assert area(flat(got[1])) == pytest.approx(4) and sorted(flat(got[1])) == [(10, 10), (10, 12), (12, 10), (12, 12)]
    assert area(flat(got[2])) == pytest.approx(2 * 4) and area(flat(got[3])) == pytest.approx(900)


def test_clipped_stars_equal_their_share_of_the_box(spark):
    r = random.Random(8)
    stars = [(i, star(r, 11, r.uniform(-6, 6), r.uniform(-6, 6))) for i in range(40)]
    got = {q.segment_id: q.a for q in overlay.clipped(polygons(spark, stars), -3, -2, 4, 3).select("segment_id", S.ring_area("ring").alias("a")).collect()}
    for i, ring in stars:
        want = overlay.combined_areas([arrays(ring), arrays(box(-3, -2, 4, 3))])[3]
        assert got.get(i, 0.0) == pytest.approx(want, abs=1e-9)
