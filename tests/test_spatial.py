"""Golden fixtures of the spatial operators."""

import math
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellweave.functions import scalars as S
from cellweave.operators import celltypes, counts, expand, grid, predictions, shapes, spatial, typefit
from cellweave.sources import io


def box(x0, y0, x1, y1):
    return [(x0, y0), (x1, y0), (x1, y1), (x0, y1)]


def polygons(spark, rows, key="segment_id"):
    return spark.createDataFrame([(i, [{"x": float(x), "y": float(y)} for x, y in ring]) for i, ring in rows], f"{key} bigint, ring array<struct<x:double,y:double>>")


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def raster(spark, text):
    return spark.createDataFrame([(x, y, v) for x, row in enumerate(text) for y, v in enumerate(row)], "x bigint, y bigint, label bigint")


def array(df, nx, ny):
    at = {(r.x, r.y): r.label for r in df.collect()}
    return [[at[x, y] for y in range(ny)] for x in range(nx)]


def test_gene_counts_of_two_squares(spark):
    p = polygons(spark, [(0, box(0, 0, 1, 1)), (1, box(1, 0, 3, 1))])
    tx = spark.createDataFrame([(0, 0.5, 0.5, "a"), (1, 2.0, 0.5, "a"), (2, 2.0, 0.5, "b")], "pt long, x double, y double, gene string")
    owned = spatial.assign_points_first(p, tx, "segment_id", "pt", "x", "y").join(tx, "pt")
    assert rows(counts.gene_counts(owned, "segment_id", "gene")) == [(0, "a", 1), (1, "a", 1), (1, "b", 1)]


def test_outline_counts_as_inside_and_lowest_id_wins(spark):
    p = polygons(spark, [(0, box(0, 0, 1, 1)), (1, box(1, 0, 3, 1))])
    tx = spark.createDataFrame([(0, 1.0, 0.5), (1, 3.0, 1.0), (2, 3.1, 0.5)], "pt long, x double, y double")
    assert rows(spatial.assign_points_first(p, tx, "segment_id", "pt", "x", "y")) == [(0, 0), (1, 1)]


def test_background_frequencies(spark):
    labels = raster(spark, [[0, 0, 1], [0, -1, 1], [1, 1, 1]])
    px = spark.createDataFrame([(0, 0, 1), (0, 0, 1), (0, 1, 2), (2, 2, 2)], "x long, y long, gene_id long")
    genes = spark.createDataFrame([(0,), (1,), (2,)], "gene_id long")
    got = {r.gene_id: r.frequency for r in counts.background(px, labels, genes).collect()}
    assert got[0] == pytest.approx(0, abs=1e-9) and got[1] == pytest.approx(2 / 3) and got[2] == pytest.approx(1 / 3)


def test_class_frequencies(spark):
    classes = raster(spark, [[0, 1, 1], [1, 1, 1], [2, 2, 2]]).withColumnRenamed("label", "class").withColumn("label", F.lit(1))
    px = spark.createDataFrame([(0, 0, 1), (0, 0, 1), (0, 1, 2), (0, 1, 2), (2, 2, 2)], "x long, y long, gene_id long")
    genes = spark.createDataFrame([(1,), (2,)], "gene_id long")
    got = {(r["class"], r.gene_id): r.frequency for r in counts.class_frequencies(px, classes, genes).collect()}
    assert got[1, 2] == pytest.approx(0.2) and got[2, 2] == pytest.approx(1 / 3) and got[1, 1] < 1e-9


@pytest.mark.parametrize("extent,size,overlap,n", [((10, 20), (5, 10), 0.25, 9), ((20, 20), (10, 10), 0.5, 9), ((10, 10), (5, 5), 0.2, 9)])
def test_tile_counts(extent, size, overlap, n):
    assert len(grid.tile_starts(extent[0], size[0], overlap)) * len(grid.tile_starts(extent[1], size[1], overlap)) == n


def test_last_tile_is_flush(spark):
    last = grid.tile_grid(spark, 10, 10, 5, 0.2).orderBy("tile_id").collect()[8]
    assert (last.x1, last.y1, last.x2, last.y2) == (5, 5, 10, 10)


def test_expansion_steps(spark):
    start = spark.createDataFrame([(x, 0, v, math.pi * 0, 1.0) for x, v in enumerate([0, -1, -1, 1])], "x long, y long, label long, angle double, foreground double")
    one = array(expand.greedy_expansion(start, 4, 1, 1), 4, 1)
    two = array(expand.greedy_expansion(start, 4, 1, 2), 4, 1)
    assert [v[0] for v in one] == [0, -1, 1, 1] and [v[0] for v in two] == [0, 1, 1, 1]


def test_fill_islands(spark):
    got = array(expand.filled(raster(spark, [[1, 1, 1], [1, -1, 1], [1, 1, 1]])), 3, 3)
    assert got[1][1] == 1


def test_flow_components_drop_small_ones(spark):
    cells = [(x, y, 1.0 if x < 3 else 0.0, 0.0) for x in range(5) for y in range(3)]
    df = spark.createDataFrame(cells, "x long, y long, foreground double, angle double")
    got = array(expand.flow_components(df, 5, 3, least=3), 5, 3)
    assert got[0] == [1, 2, 3] and got[2] == [1, 2, 3] and got[4] == [0, 0, 0]
    assert array(expand.flow_components(df, 5, 3, least=4), 5, 3) == [[0] * 3] * 5


def test_cull_keeps_transcripts_and_priors(spark):
    labels = raster(spark, [[0, 0, 0, 0, 0], [0, 1, 1, 1, 0], [0, 1, 1, 1, 0], [0, 1, 1, 1, 0], [0, 0, 0, 0, 0]])
    tx = spark.createDataFrame([(1, 1)], "x long, y long")
    prior = spark.createDataFrame([(2, 2)], "x long, y long")
    got = array(expand.cull_empty_pixels(labels, tx, prior), 5, 5)
    assert [(x, y) for x in range(5) for y in range(5) if got[x][y]] == [(1, 1), (2, 2)]


def test_outline_of_a_block_and_of_touching_corners(spark):
    cells = [(1, x, y) for x in range(1, 4) for y in range(1, 4)] + [(2, 10, 10), (2, 11, 11)]
    rings = shapes.chained(shapes.boundary_edges(spark.createDataFrame(cells, "segment_id long, x long, y long")))
    got = rings.groupBy("segment_id").agg(F.sum(S.ring_area(F.col("points"))).alias("area"))
    assert rows(got) == [(1, 9.0), (2, 2.0)]


def test_pixel_iou(spark):
    a = spark.createDataFrame([(3, 3, 0), (6, 6, 1)], "x long, y long, a_id long")
    b = spark.createDataFrame([(3, 3, 0), (3, 4, 0), (4, 3, 0), (4, 4, 0), (6, 6, 1)], "x long, y long, b_id long")
    assert {r.a_id: r.iou for r in shapes.pixel_iou(a, b, "a_id", "b_id", 0.01).collect()} == {0: 0.25, 1: 1.0}


def test_jaccard(spark):
    a = spark.createDataFrame([(0, 1), (1, 3)], "a long, m long")
    b = spark.createDataFrame([(0, 1), (0, 2), (1, 3)], "b long, m long")
    pairs = spark.createDataFrame([(0, 0), (1, 1)], "a long, b long")
    assert {r.a: r.jaccard for r in shapes.jaccard_of_members(a, b, pairs, "a", "b", "m").collect()} == {0: 0.5, 1: 1.0}


def test_posterior_prefers_the_marked_type(spark):
    n = spark.createDataFrame([(0, 0, 3), (1, 1, 3)], "cell long, gene_id long, n long")
    profiles = spark.createDataFrame([(0, 0, 0.999), (0, 1, 0.001), (1, 0, 0.001), (1, 1, 0.999)], "celltype int, gene_id long, prob double")
    priors = spark.createDataFrame([(0, 0.6), (1, 0.4)], "celltype int, prior double")
    assert rows(celltypes.hard_types(celltypes.posterior(n, profiles, priors)).select("cell", "celltype")) == [(0, 0), (1, 1)]


def test_planted_types_are_found(spark):
    n = spark.createDataFrame([(c, g, 10 + (c * 7 + g) % 5 if g // 4 == c % 3 else 1) for c in range(60) for g in range(12)], "cell long, gene_id long, n long")
    genes = n.select("gene_id").distinct()
    bic = {}
    for k in (2, 3):
        best = []
        for seed in (1, 2, 3):
            model = celltypes.fit(n, genes, *celltypes.initial(spark, genes, k, seed), steps=8)
            best.append(celltypes.model_scores(n, *model).first()["bic"])
        bic[k] = min(best)
    assert bic[3] < bic[2]


def test_metrics(spark):
    df = spark.createDataFrame([(1, 1, 1.0, 0.99, 0.01, 1), (1, 0, 0.2, 0.5, 0.1, 2)], "tile int, label int, foreground double, angle double, true_angle double, predicted int").withColumn("class", F.lit(1))
    assert predictions.angle_accuracy(df, ["tile"]).first()["angle_accuracy"] == pytest.approx(0.98)
    assert predictions.celltype_accuracy(df, ["tile"]).first()["celltype_accuracy"] == pytest.approx(1.0)
    assert predictions.foreground_accuracy(df, ["tile"]).first()["foreground_accuracy"] == pytest.approx(1.0)
    assert predictions.angle_accuracy(df.where("label = 0"), ["tile"]).first()["angle_accuracy"] is None


def test_ray_hits_the_first_edge(spark):
    px = spark.createDataFrame([(0, 0, 0.0), (0, 5, math.pi)], "x long, y long, angle double")
    p = polygons(spark, [(7, box(3, 0, 4, 1)), (8, box(6, 0, 7, 1))])
    assert rows(spatial.ray_hits(px, p, "segment_id", 10.0)) == [(0, 0, 7, 2.5)]


def test_polygon_files_drop_short_rings(spark, tmp_path):
    path = str(tmp_path / "shapes")
    io.polygon_json(polygons(spark, [(1, box(0, 0, 1, 1)), (2, [(0, 0), (1, 1)])]), "segment_id").write.json(path)
    assert [r.cell for r in io.scan_polygon_json(spark, path).collect()] == [1]


def test_tile_ownership_keeps_one_owner(spark):
    tiles = grid.tile_grid(spark, 20, 20, 10, 0.5)
    p = polygons(spark, [(0, box(4, 4, 6, 6)), (1, box(14, 14, 16, 16))])
    assert rows(spatial.tile_ownership(p, tiles, "segment_id")) == [(0, 0), (1, 8)]


def test_tile_ownership_of_far_and_wide_polygons(spark):
    box = lambda x, y, w, h: [{"x": float(a), "y": float(b)} for a, b in ((x, y), (x + w, y), (x + w, y + h), (x, y + h))]
    polygons = spark.createDataFrame([(1, box(500, 10, 2, 2)), (2, box(1, 1, 2, 2)), (3, box(-150, 9, 205, 2))], "id long, ring array<struct<x double, y double>>")
    tiles = spark.createDataFrame([(0, 0, 0, 10, 10), (1, 10, 0, 20, 10), (2, 50, 0, 60, 10)], "tile_id long, x1 long, y1 long, x2 long, y2 long")
    assert {r.id: r.tile_id for r in spatial.tile_ownership(polygons, tiles, "id").collect()} == {1: 2, 2: 0, 3: 0}


def test_growth_to_its_end_equals_brute_force(spark, monkeypatch):
    from cellweave.plans import queries_jobs, queries_reports  # noqa: F401
    from cellweave.plans.queries import QUERIES

    width, height, toward = 24, 7, math.pi + 0.6
    label = {(x, y): 5 if x < 3 and y < 4 else 0 if x > 20 else -1 for x in range(width) for y in range(height)}
    angle = {p: toward if (p[0] + p[1]) % 5 else math.pi for p in label}
    on = {p: 1.0 if (p[0] * 7 + p[1] * 3) % 11 else 0.2 for p in label}
    df = spark.createDataFrame([(*p, label[p], angle[p], on[p]) for p in label], "x long, y long, label long, angle double, foreground double")
    flow = {(r.x, r.y): ((r.fx, r.fy), (r.gx, r.gy)) for r in expand.with_targets(df, width, height).collect()}
    want, last = dict(label), -1
    for step in range(expand.STEPS):
        now = dict(want)
        for (x, y), v in want.items():
            if v == -1 and on[x, y] >= 0.5:
                f = want[flow[x, y][0]] if step == 0 else max(want[flow[x, y][0]], want[flow[x, y][1]])
                corners = [(min(max(x + i, 0), width - 1), min(max(y + j, 0), height - 1)) for i, j in expand.DIAGONALS]
                if f != -1 and f in [want[c] for c in corners]:
                    now[x, y] = f
        full = dict(now)
        for (x, y), v in now.items():
            around = {now.get((x + i, y + j)) for i, j in ((1, 0), (-1, 0), (0, 1), (0, -1))}
            if v == -1 and len(around) == 1 and (s := around.pop()) is not None and s > 0:
                full[x, y] = s
        changed, want = full != want, full
        last = step + 1 if changed else last
        if step and not changed:
            break
    for block in (expand.BLOCK, 5):  # one block, and blocks smaller than the margin
        out = expand.grown(df, width, height, expand.STEPS, block=block).collect()
        assert {(r.x, r.y): r.label for r in out} == want and len(out) == len(want)
        assert max(r.step for r in out) == last > 3 and {(r.x, r.y) for r in out if r.step} == {p for p in want if want[p] != label[p]}

    asked = []
    for name in ("greedy_expansion", "early_stopped"):
        monkeypatch.setattr(expand, name, lambda *a, **k: asked.append(next(x for x in reversed(a) if isinstance(x, int))) or spark.createDataFrame([], "x long, y long, label long"))
    for name in ("job_segment", "expand_early_stop", "cull_empty_pixels", "greedy_expansion_whole"):
        QUERIES[name](spark, "/root/testdata/sf0.001")
    assert asked == [15] * 4


def grid_of(spark, rng, n=14):
    rows = [(x, y, float(rng.uniform(-3.1, 3.1)), float(rng.random())) for x in range(n) for y in range(n)]
    return rows, spark.createDataFrame(rows, "x long, y long, angle double, foreground double")


def test_flow_components_equal_brute_force(spark):
    import numpy as np

    n, least = 14, 3
    rows, df = grid_of(spark, np.random.default_rng(4), n)
    up = list(range(n * n))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    on = set()
    for x, y, angle, foreground in rows:
        if foreground >= 0.5:
            on.add(x * n + y)
            fx, fy = (int(min(max(np.floor(v + 0.5 + d * np.sqrt(2)), 0), n - 1)) for v, d in ((x, np.cos(angle)), (y, np.sin(angle))))
            a, b = root(x * n + y), root(fx * n + fy)
            up[max(a, b)] = min(a, b)
    size = {r: sum(root(i) == r for i in on) for r in {root(i) for i in on}}
    names = {r: k + 1 for k, r in enumerate(sorted(r for r in size if size[r] >= least))}
    want = {i: names.get(root(i), 0) if i in on else 0 for i in range(n * n)}
    for i, v in dict(want).items():
        x, y = divmod(i, n)
        if not v and 0 < x < n - 1 and 0 < y < n - 1 and len(s := {want[i - 1], want[i + 1], want[i - n], want[i + n]}) == 1 and s != {0}:
            want[i] = -s.pop()  # marked, so that it fills no other
    got = {r.x * n + r.y: r.label for r in expand.flow_components(df, n, n, least).collect()}
    assert got == {i: abs(v) for i, v in want.items()}


def test_islands_take_background_too_and_sparse_grids_have_none(spark):
    cells = [(x, y, 0) for x in range(3) for y in range(3) if (x, y) != (1, 1)] + [(1, 1, -1)]
    assert {(r.x, r.y): r.label for r in expand.filled(spark.createDataFrame(cells, "x long, y long, label long")).collect()}[(1, 1)] == 0
    sparse = [(0, 2, 5), (4, 2, 5), (2, 0, 5), (2, 4, 5), (2, 2, -1)]
    assert {(r.x, r.y): r.label for r in expand.filled(spark.createDataFrame(sparse, "x long, y long, label long")).collect()}[(2, 2)] == -1


def test_stopped_segments_still_fill_islands(spark):
    n = 5
    labels = spark.createDataFrame([(x, y, -1 if (x, y) == (2, 2) or x == 4 else 7) for x in range(n) for y in range(n)], "x long, y long, label long")
    pixels = labels.selectExpr("x", "y", "label", "3.14159D AS angle", "1D AS foreground")
    stops = spark.createDataFrame([(7, 0)], "label long, step long")
    out = {(r.x, r.y): r.label for r in expand.greedy_expansion(pixels, n, n, 3, stops=stops).collect()}
    assert out[(2, 2)] == 7 and all(out[(4, y)] == -1 for y in range(n))
    free = {(r.x, r.y): r.label for r in expand.greedy_expansion(pixels, n, n, 3).collect()}
    assert any(free[(4, y)] == 7 for y in range(n))


def test_dictionary_numbers_keys_in_order(spark):
    from cellweave.operators import grid

    for keys, kind in (([f"cell_1{k}" for k in range(500)], "string"), (list(range(0, 90_000, 7)), "long"), ([], "string")):
        got = sorted((r[1], r[0]) for r in grid.dictionary(spark.createDataFrame([(k,) for k in [*keys, None]], f"k {kind}"), "k", "n", 3).collect())
        assert got == list(enumerate(sorted(keys), 3))


def test_multiclass_dice_equals_the_mean_over_groups_and_classes(spark):
    rows = [(0, 1, 1), (0, 1, 2), (0, 2, 2), (0, 0, 3), (1, 3, 3), (1, 3, 3), (1, 0, 0)]
    got = predictions.multiclass_dice(spark.createDataFrame(rows, "tile_id long, truth int, predicted int"), ["tile_id"], 3).first()[0]
    want = []
    for tile in (0, 1):
        for c in (1, 2, 3):
            a, b = [r[1] == c for r in rows if r[0] == tile], [r[2] == c for r in rows if r[0] == tile]
            both, size = 2 * sum(x and y for x, y in zip(a, b)), sum(a) + sum(b)
            want.append((both + 1e-6) / ((size or both) + 1e-6))
    assert got == pytest.approx(sum(want) / len(want))


def test_chunks_by_position(spark):
    rows = [(k, float((k * 7) % 10), float((k * 3) % 5)) for k in range(53)]
    got = {r.id: r.chunk for r in spatial.chunk_by_position(spark.createDataFrame(rows, "id long, x double, y double"), "id", "x", "y", 10).collect()}
    assert got == {k: i // 10 for i, (_, _, k) in enumerate(sorted((x, y, k) for k, x, y in rows))}


def test_fit_job_chooses_the_planted_number_of_types(spark):
    from cellweave.plans import jobs

    planted = [(c, g, 10 + (c * 7 + g) % 5 if g // 4 == c % 3 else 1) for c in range(60) for g in range(12)]
    planted += [(c, 0, 1) for c in range(100, 110)] + [(c, g, 500) for c in (200, 201) for g in range(12)]  # too few transcripts; outside
    n = spark.createDataFrame(planted, "cell long, gene_id long, n long")
    area = spark.range(150).withColumnRenamed("id", "cell")
    for warm in (False, True):
        models = jobs.fit_celltypes(n, n.select("gene_id").distinct(), area, [2, 3, 4], 3, warm=warm, seed=5)
        out = typefit.scores(spark, models).collect()
        assert len(out) == 9 and {r.cells for r in out} == {60}
        assert min(out, key=lambda r: r.bic).k == 3 and min(out, key=lambda r: r.aic).k == 3
    few = jobs.sampled_cells(n, area, 0.0, 20, 1).select("cell").distinct()
    assert few.count() == 20 and rows(few) == rows(jobs.sampled_cells(n.repartition(3), area, 0.0, 20, 1).select("cell").distinct())


def test_models_stepped_together_equal_plain_em(spark):
    n = [(c, g, 1 + (c * 7 + g) % 5 + (9 if g // 3 == c % 2 else 0)) for c in range(24) for g in range(6) if (c + g) % 4]
    x = np.zeros((24, 6))
    for c, g, v in n:
        x[c, g] = v
    cells = typefit.packed(spark.createDataFrame(n, "cell long, gene_id long, n long").repartition(3))
    starts = {(k, c): typefit.cold(k, 6, np.random.default_rng([k, c])) for k in (2, 3) for c in (0, 1)}
    together = typefit.fit(cells, 6, starts, 6, 0.05)  # some settle earlier
    for key, start in starts.items():
        p, q = start.profiles, start.priors
        for step in range(6):
            e = np.exp(x @ np.log(p).T) * q
            post = e / e.sum(1, keepdims=True)
            was, p = p, post.T @ x + 1
            p, q = p / p.sum(1, keepdims=True), (post.sum(0) + 1) / (24 + len(q))
            if np.linalg.norm(p - was) <= 0.05 * np.linalg.norm(was):
                break
        m = together[key]
        assert m.profiles == pytest.approx(p) and m.priors == pytest.approx(q) and m.steps == step + 1
        assert m.loglik == pytest.approx(np.log((np.exp(x @ np.log(p).T) * q).sum(1)).sum())
    profiles, priors = typefit.tables(spark, together)
    for r in typefit.scores(spark, together).collect():
        own = [t.where((F.col("k") == r.k) & (F.col("chain") == r.chain)).drop("k", "chain") for t in (profiles, priors)]
        score = celltypes.model_scores(spark.createDataFrame(n, "cell long, gene_id long, n long"), *own).first()
        assert (score.loglik, score.aic, score.bic) == pytest.approx((r.loglik, r.aic, r.bic))


def test_split_halves_the_dominant_type():
    m = typefit.Model(np.array([[0.5, 0.5], [0.9, 0.1]]), np.array([0.3, 0.7]))
    out = typefit.split(m, np.random.default_rng(1))
    assert out.priors.sum() == pytest.approx(1) and out.priors[0] == 0.3 and out.priors[1] + out.priors[2] == pytest.approx(0.7)
    assert (out.profiles[:2] == m.profiles).all() and out.profiles[2].sum() == pytest.approx(1)


def test_kth_distance_against_all_pairs(spark):
    spots = [(i * 7 % 50, i * i % 37) for i in range(30)] + [(90, 4)] * 3 + [(None, 1)]
    tx = spark.createDataFrame([(None if a is None else a + 0.25, b + 0.75) for a, b in spots], "px double, py double")
    pixels = spark.createDataFrame([(x, y) for x in (0, 3, 20, 49, 95, 400) for y in (-5, 0, 18, 36)] + [(0, 0)], "x bigint, y bigint")
    got = {(r.x, r.y): r.distance for r in spatial.kth_distance(pixels, tx, 4, "px", "py").collect()}
    for (x, y), d in got.items():
        assert d == pytest.approx(sorted(math.dist((x, y), s) for s in spots if s[0] is not None)[3])
    assert len(got) == 24
    assert {r.distance for r in spatial.kth_distance(pixels, tx, 34, "px", "py").collect()} == {math.inf}
    assert spatial.kth_distance(pixels.limit(0), tx, 4, "px", "py").count() == 0


def test_uniformity_p(spark):
    sums = {1: [5.0, 4.0, 6.0, 5.0, 9.0], 2: [0.5, 4.0, 6.0, 5.0], 3: [None, 1.0, 2.0, 3.0, 4.0], 4: [2.0, 2.0, 2.0, 2.0, 2.0]}
    data = spark.createDataFrame([(g, i, v) for g, s in sums.items() for i, v in enumerate(s) if v is not None], "gene_id long, trial int, s double")
    exact, normal = (dict(rows(spatial.uniformity_p(data, 4, e))) for e in (True, False))
    assert exact == {1: 0.5, 2: 0.25, 3: 0.0, 4: 1.0}  # the trial that gene 2 lacks is 0
    for g, s in sums.items():
        null = (s[1:] + [0.0])[:4]
        sd = statistics.pstdev(null)
        assert normal[g] is None if sd == 0 else normal[g] == pytest.approx(statistics.NormalDist(statistics.fmean(null), sd).cdf(s[0] or 0.0))


def test_flow_components_meet_across_blocks(spark):
    import numpy as np

    n = 14
    _, df = grid_of(spark, np.random.default_rng(5), n)
    want = sorted(expand.flow_components(df, n, n, 3).collect())
    assert sorted(expand.flow_components(df, n, n, 3, block=4).collect()) == want and max(r.label for r in want) > 3
    line = spark.createDataFrame([(x, y, 0.0, 1.0) for x in range(40) for y in range(2)], "x long, y long, angle double, foreground double")
    assert {r.label for r in expand.flow_components(line, 40, 2, 3, block=4).where("y = 0").collect()} == {1}
    assert {r.label for r in expand.flow_components(line.withColumn("foreground", F.lit(0.0)), 40, 2, 3).collect()} == {0}


def test_kth_distance_in_blocks_and_beyond_their_reach(spark):
    spots = [(i * 7 % 50, i * i % 37) for i in range(60)] + [(200, 4)] * 3
    tx = spark.createDataFrame([(a + 0.25, b + 0.75) for a, b in spots], "px double, py double")
    pixels = spark.createDataFrame([(x, y) for x in range(-9, 60, 6) for y in range(-7, 40, 5)] + [(199, 3), (300, 80)], "x bigint, y bigint")
    for first, block in ((32, 128), (4, 8), (1, 3)):
        got = {(r.x, r.y): r.distance for r in spatial.kth_distance(pixels, tx, 4, "px", "py", first, block).collect()}
        assert got == {(r.x, r.y): pytest.approx(sorted(math.dist((r.x, r.y), s) for s in spots)[3]) for r in pixels.collect()}


def test_preprocessed_pixels_outside_of_segments_meet_nothing_by_their_label(spark, monkeypatch):
    """Labels 0 and -1 are most of a slide, so a join on them would bring those pixels to one task."""
    from cellweave.plans import queries_jobs
    from cellweave.plans.queries import QUERIES

    many = spark.range(4000).selectExpr("id AS x", "0L AS y", "CASE WHEN id < 5 THEN 1L WHEN id % 2 = 0 THEN 0L ELSE -1L END AS label")
    monkeypatch.setattr(queries_jobs, "_labelled", lambda t: many)
    out = QUERIES["job_preprocess"](spark, "/root/testdata/sf0.001")
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Join LeftOuter, ((x#" not in plan and out.count() == 4000
    assert {(r.label, r.angle is None) for r in out.select("label", "angle").distinct().collect()} >= {(0, True), (-1, True), (1, False)}


def keyed_tables(spark, path, orders):
    """customer, and a lineitem row of each order key."""
    spark.range(80).selectExpr("id AS c_custkey", "id % 25 AS c_nationkey").write.parquet(f"{path}/customer.parquet")
    rows = [(k, 7 + i, 3 + i, 1 + i % 7, 20.0 + i) for i, k in enumerate(orders)]
    spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double").coalesce(1).write.parquet(f"{path}/lineitem.parquet")
    return [((k * 100_000 + p) * 10_000 + s) * 10 + n for k, p, s, n, _ in rows], [int(q) for *_, q in rows]


def test_transcript_ids_beyond_64_bits_are_whole_numbers(spark, tmp_path):
    """Order keys of 6 GB; the plain product stopped the queries that read transcript_id."""
    from cellweave.plans.queries import QUERIES, Tables

    path = str(tmp_path)
    number, quantity = keyed_tables(spark, path, [0, 149_999, 14_411_000, 14_412_000, 28_900_000, 53_999_999])
    exact = [n * 64 + q for n, q in zip(number, quantity, strict=True)]
    assert sum(v >= 1 << 63 for v in exact) == 3
    got = Tables(spark, path).tx.select("qv", "transcript_id").collect()
    assert {r.qv: r.transcript_id for r in got} == {float(q): v % (1 << 63) for q, v in zip(quantity, exact, strict=True)}
    assert QUERIES["points_to_tiles"](spark, path).where("transcript_id < 0 OR transcript_id IS NULL").count() == 0


def test_external_outlines_of_overlapping_tiles_are_stitched(spark, monkeypatch):
    """Stitching had one copy of each outline to choose from and so changed nothing."""
    from cellweave.plans import queries_reports
    from cellweave.plans.queries import QUERIES

    given, combined = [], queries_reports.jobs.combined
    monkeypatch.setattr(queries_reports.jobs, "combined", lambda results, tiles: given.append(results) or combined(results, tiles))
    out = QUERIES["job_postprocess_external"](spark, "/root/testdata/sf0.001").collect()
    copies = [r["count"] for r in given[0].groupBy("local_id").count().collect()]
    assert max(copies) >= 4 and sum(copies) > 1.2 * len(copies)
    assert len({r.segment_id for r in out}) == len(out) > 100


def test_tiles_see_what_their_box_meets(spark):
    tiles = spark.createDataFrame([(0, 0, 0, 10, 10), (1, 8, 0, 18, 10), (2, 0, 8, 10, 18)], "tile_id long, x1 long, y1 long, x2 long, y2 long")
    shapes_ = polygons(spark, [(1, box(1, 1, 2, 2)), (2, box(8.5, 1, 9.5, 2)), (3, box(9, 9, 9.5, 12)), (4, box(40, 2, 41, 3)), (5, box(10, 1, 11, 2))])
    got = {(r.tile_id, r.segment_id): min(p.x for p in r.ring) for r in spatial.seen_by_tiles(shapes_, tiles, "segment_id", 10).collect()}
    assert got == {(0, 1): 1, (0, 2): 8.5, (1, 2): 0.5, (0, 3): 9, (1, 3): 1, (2, 3): 9, (1, 4): 32, (1, 5): 2}


def test_nearest_distances_against_all_pairs(spark):
    sites = [(i * 7 % 50 + 0.5, i * i % 37 + 0.25) for i in range(30)] + [(0.5, 0.25), (400.0, 9.0), (None, 1.0), (3.0, float("nan"))]
    points = [(i, i % 3, i * 13 % 61 - 5.0, i * i % 43 - 3.5) for i in range(80)] + [(1, 0, 300.0, 2.0), (7, 1, 9000.0, -70.0), (7, 1, 9000.0, -70.0), (8, 1, None, 2.0)]
    s, p = spark.createDataFrame(sites, "sx double, sy double"), spark.createDataFrame(points, "k long, g int, x double, y double")
    want = sorted((k, g, round(min(math.dist((x, y), q) for q in sites if q[0] is not None and q[1] == q[1]), 9)) for k, g, x, y in points if x is not None)
    for reach, block, cell in ((2, 16, 16.0), (1, 1, 3.0), (3, 2, 1.0)):
        got = spatial.nearest_distances(s, p, ["k", "g"], reach, block, cell).collect()
        assert sorted((r.k, r.g, round(r.distance, 9)) for r in got) == want
    assert spatial.nearest_distances(s.limit(0), p, ["k"]).count() == 0 == spatial.nearest_distances(s, p.limit(0), ["k"]).count()


def test_uniformity_test_gives_p_values_of_points_drawn_anew(spark):
    """It had no p-value, and the points of a trial were those of another, moved."""
    from cellweave.plans import queries_reports
    from cellweave.plans.queries import QUERIES

    out = QUERIES["uniformity_test"](spark, "/root/testdata/sf0.001").collect()
    for r in out:
        assert r.p_exact in {0.0, 0.333333, 0.666667, 1.0}
        assert r.p_normal == pytest.approx(statistics.NormalDist(r.null_mean, r.null_sd).cdf(r.total), abs=1e-5)
    ids = spark.range(500).selectExpr("id * 640064 AS transcript_id", "explode(sequence(1, 2)) AS trial")
    for text, name in queries_reports._drawn("div"):
        ids = ids.withColumn(name, F.expr(text))
    u, v = (np.array([[r[c] for r in ids.where(f"trial = {k}").orderBy("transcript_id").collect()] for k in (1, 2)]) / queries_reports.MERSENNE for c in "uv")
    assert 0 <= min(u.min(), v.min()) and max(u.max(), v.max()) < 1 and len(np.unique((u[0] - u[1]).round(6) % 1)) > 400
    assert max(abs(np.corrcoef(a, b)[0, 1]) for a, b in ((u[0], u[1]), (v[0], v[1]), (u[0], v[0]))) < 0.2


def test_nearest_polygon_in_blocks(spark):
    """Points with more than one polygon near, on edges, on ties, without a place and twice, against the distance of every pair."""
    from cellweave.functions import scalars

    shapes_ = polygons(spark, [(7, box(0, 0, 4, 4)), (3, box(6, 0, 9, 4)), (9, [(30, 30), (40, 31), (33, 44)]), (5, box(-20, -9, -18, 60)), (4, box(6, 6, 9, 9))])
    places = [(i, j, i * 1.5 - 24, j * 1.25 - 12) for i in range(46) for j in range(50)]
    points = spark.createDataFrame([*places, (90, 0, 5.0, 2.0), (90, 0, 5.0, 2.0), (91, 0, None, 2.0), (92, 0, 4.0, 1.0)], "i int, j int, x double, y double")
    d = scalars.ring_distance(F.col("ring"), F.col("x"), F.col("y"))
    every = points.where("x IS NOT NULL").crossJoin(shapes_.select("segment_id", "ring")).select("i", "j", d.alias("d"), "segment_id").where("d <= 5")
    want = {(r.i, r.j): tuple(r.b) for r in every.groupBy("i", "j").agg(F.min(F.struct("d", "segment_id")).alias("b")).collect()}
    for block in (16, 1):
        got = spatial.nearest_polygon(shapes_, points, "segment_id", ["i", "j"], "x", "y", 5.0, block).collect()
        assert len(got) == len(places) + 3
        assert {(r.i, r.j): (r.distance, r.segment_id) for r in got if r.segment_id is not None} == {k: (pytest.approx(v[0], abs=1e-12), v[1]) for k, v in want.items()}
    assert want[90, 0] == (1.0, 3) and want[92, 0] == (0.0, 7)
    inside = spark.createDataFrame([(1, 2.0, 2.0), (2, 2.0, 2.5), (2, 2.0, 2.5), (3, 4.0, 2.0), (3, 4.0, 2.0)], "i int, x double, y double")
    got = spatial.nearest_polygon(shapes_, inside, "segment_id", ["i"], "x", "y", 5.0).collect()
    assert {r.i: (r.distance, r.segment_id) for r in got} == {1: (0.0, 7), 2: (1.5, 7), 3: (0.0, 7)}  # rows of one point count its crossings together
    assert spatial.nearest_polygon(shapes_.limit(0), points, "segment_id", ["i", "j"], "x", "y", 5.0).where("distance IS NULL").count() == len(places) + 3
    plan = spatial.nearest_polygon(shapes_, points, "segment_id", ["i", "j"], "x", "y", 5.0)._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate explode" in plan and "Join" not in plan and plan.count("Aggregate") <= 1  # that of the rings; edges gave a row each and were shuffled


def test_dense_pixels_in_blocks(spark):
    spots = [(i * 7 % 30, i * i % 23) for i in range(150)] + [(40, 4)] * 6
    tx = spark.createDataFrame([(a + 0.25, b + 0.75) for a, b in spots] + [(None, 1.0)], "px double, py double")
    pixels = spark.createDataFrame([(x, y) for x in range(-3, 48) for y in range(-5, 28)] + [(41, 4), (None, 2)], "x long, y long")
    want = sorted((r.x, r.y) for r in pixels.where("x IS NOT NULL").collect() if sum(math.dist((r.x, r.y), p) < 4 for p in spots) >= 5)
    for block in (256, 8, 3):
        df = spatial.dense_near(pixels, tx, 5, 4, "px", "py", block)
        assert sorted((r.x, r.y) for r in df.collect()) == want and want.count((41, 4)) == 2
    assert "Generate explode(array" not in df._jdf.queryExecution().optimizedPlan().toString()  # each place was spread over 45 pixels
    assert spatial.dense_near(pixels, tx.limit(0), 5, 4, "px", "py").count() == 0


def test_cull_in_blocks_equals_one_block(spark):
    """Segments longer than a margin, whose peeling goes through several blocks, in few rounds that are written."""
    rng = np.random.default_rng(3)
    n = 40
    label = np.ones((n, n), int)
    label[:, 25:] = 2
    label[rng.random((n, n)) < 0.02] = 0
    label[3, :] = -1
    hold = {(int(a), int(b)) for a, b in rng.integers(0, n, (12, 2))}
    want = label.copy()
    while True:
        wide = np.pad(want, 1)
        same = sum(wide[1 + i : n + 1 + i, 1 + j : n + 1 + j] == want for i, j in ((0, 1), (0, -1), (1, 0), (-1, 0)))
        gone = [(x, y) for x in range(n) for y in range(n) if want[x, y] > 0 and same[x, y] < 4 and (x, y) not in hold]
        if not gone:
            break
        for p in gone:
            want[p] = 0
    df = spark.createDataFrame([(x, y, int(label[x, y])) for x in range(n) for y in range(n)], "x long, y long, label long")
    marks = spark.createDataFrame(sorted(hold), "x long, y long")
    for block, margin in ((192, 16), (8, 3), (5, 1)):
        out = expand.cull_empty_pixels(df, marks.limit(5), marks, block, margin).collect()
        assert len(out) == n * n and {(r.x, r.y): r.label for r in out} == {(x, y): int(want[x, y]) for x in range(n) for y in range(n)}
    rounds, stored = [], expand.stored
    expand.stored = lambda d: rounds.append(1) or stored(d)
    try:
        expand.cull_empty_pixels(df, marks, marks)
    finally:
        expand.stored = stored
    assert len(rounds) == 2  # the labels, and one round; each pixel deep was a round of the whole slide
