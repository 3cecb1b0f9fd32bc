"""Registered queries: confidence traces, ray and early-stopped segmentation, uniformity, and the jobs that report on them."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import functions as F

from cellweave.functions import scalars as S
from cellweave.operators import celltypes, counts, expand, grid, overlay, predictions, spatial
from cellweave.plans import jobs
from cellweave.plans.queries import _W, GENES, NUCLEUS, PX, TILES, _encoded, _members, _memberships, _start, _with_pred, query, r6, slide_tiles_of, tiles_of
from cellweave.plans.queries_jobs import (
    _CHUNKS, _SCORES, _SMOOTH, FILTER, FIT_STEPS, _fits, _met_sql, _owner_sql, _polys_sql, _slabs_sql, benchmarked, filtered, prior_sql,
)
from cellweave.sources import io
from cellweave.sources.scratch import scratch, stored

STEPS = 4
_STEP = f"CAST(least(abs(dx) + abs(dy), {STEPS}) AS INTEGER)"


def _increments(t):
    """Transcripts of each lattice cell by how far from its centre they are, as if each step added a ring. Those beside the raster, most of the
    slide's, meet no pixel and are left out before they are shuffled."""
    width, height = t.size()
    px = _encoded(t)[0].where(F.col("x").between(0, width - 1) & F.col("y").between(0, height - 1))
    step = F.least(F.abs("dx") + F.abs("dy"), F.lit(float(STEPS))).cast("int")
    met = px.join(t.pixels.where("dx IS NOT NULL").select("x", "y", F.col("lattice").alias("segment_id"), step.alias("step")), ["x", "y"])
    return met.groupBy("segment_id", "step", "gene_id").agg(F.count("*").alias("n"))


_TRACE = f"""{GENES}, px AS (SELECT CAST(floor(x_location) AS BIGINT) AS x, CAST(floor(y_location) AS BIGINT) AS y, gene_id FROM prep JOIN genes USING (feature_name)),
inc AS (SELECT lattice AS segment_id, {_STEP} AS step, gene_id, count(*) AS n FROM px JOIN {{pixels}} USING (x, y) WHERE dx IS NOT NULL GROUP BY ALL),
ad AS (SELECT segment_id, step, celltype, sum(n*ln(prob)) AS s FROM inc JOIN {{init_profiles}} USING (gene_id) GROUP BY ALL),
ev AS (SELECT segment_id, celltype, CAST(step AS INTEGER) AS step FROM (SELECT DISTINCT segment_id FROM inc) CROSS JOIN (SELECT DISTINCT celltype FROM {{init_profiles}}) CROSS JOIN (SELECT unnest(generate_series(0, {STEPS})) AS step)),
jo AS (SELECT segment_id, step, celltype, ln(1.0E0/3) + sum(coalesce(s, 0)) OVER (PARTITION BY segment_id, celltype ORDER BY step) AS j FROM ev LEFT JOIN ad USING (segment_id, step, celltype)),
po AS (SELECT segment_id, step, celltype, exp(j - mj)/sum(exp(j - mj)) OVER (PARTITION BY segment_id, step) AS p FROM (SELECT *, max(j) OVER (PARTITION BY segment_id, step) AS mj FROM jo)),
tr AS (SELECT a.segment_id, a.step, sqrt(sum((a.p + b.p)*(a.p + b.p)/4)) - sqrt(sum(b.p*b.p)) AS gain FROM po a JOIN po b ON b.segment_id = a.segment_id AND b.celltype = a.celltype AND b.step = 0 GROUP BY a.segment_id, a.step)"""


@query(f"WITH {_TRACE} SELECT segment_id, step, round(gain, 6) + 0.0 AS gain FROM tr")
def confidence_trace(t):
    return celltypes.confidence_trace(_increments(t), *_start(t), STEPS).select("segment_id", "step", r6(F.col("gain")).alias("gain"))


@query(None)
def expand_early_stop(t):
    px, _ = _encoded(t)
    return expand.early_stopped(_with_pred(t), px, *_start(t), *t.size(), expand.STEPS)


_RAY = f"""{NUCLEUS}, r AS (SELECT x, y, x + 0.5E0 AS ox, y + 0.5E0 AS oy, cos(angle) AS dx, sin(angle) AS dy FROM {{pred}} JOIN {{pixels}} USING (x, y) WHERE label <= 0),
c AS (SELECT r.*, b.id FROM r JOIN box b ON ox BETWEEN xmin - 8 AND xmax + 8 AND oy BETWEEN ymin - 8 AND ymax + 8),
h AS (SELECT x, y, c.id, ((x1 - ox)*(y2 - y1) - (y1 - oy)*(x2 - x1))/(dx*(y2 - y1) - dy*(x2 - x1)) AS t, ((x1 - ox)*dy - (y1 - oy)*dx)/(dx*(y2 - y1) - dy*(x2 - x1)) AS u FROM c JOIN edges e ON e.id = c.id WHERE abs(dx*(y2 - y1) - dy*(x2 - x1)) > 1e-10),
rh AS (SELECT x, y, arg_min(id, (t, id)) AS id, min(t) AS t FROM h WHERE t >= 0 AND t <= 8 AND u BETWEEN 0 AND 1 GROUP BY x, y)"""


@query(f"WITH {_RAY} SELECT p.x, p.y, CASE WHEN p.label = -1 AND d.foreground >= 0.5E0 AND t <= 1 + rh.id % 3 THEN rh.id + 1 WHEN p.label > 0 THEN p.label ELSE 0 END AS label FROM {{pixels}} p LEFT JOIN {{pred}} d ON d.x = p.x AND d.y = p.y LEFT JOIN rh ON rh.x = p.x AND rh.y = p.y")
def ray_segmentation(t):
    rays = t.pixels.where("label <= 0").select("x", "y").join(t.pred.select("x", "y", "angle"), ["x", "y"])
    hits = spatial.ray_hits(rays, t.polygons("nucleus_vertices", "cell_id"), "cell_id", 8.0).select("x", "y", (F.col("cell_id") + 1).alias("segment_id"), "distance")
    best = t.nuclei.select((F.col("cell_id") + 1).alias("segment_id"), (1 + F.col("cell_id") % 3).alias("step"))
    return expand.ray_segmentation(_with_pred(t), hits, best)


_BY_K = f"{_SCORES}, s AS (SELECT k, min(aic) AS aic, min(bic) AS bic FROM scores GROUP BY k), lo AS (SELECT arg_min(k, (bic, k)) AS least_bic, arg_min(k, (aic, k)) AS least_aic FROM s)"


def _by_k(t):
    return _fits(t)[3].groupBy("k").agg(F.min("aic").alias("aic"), F.min("bic").alias("bic"))


@query(f"WITH {_BY_K} SELECT least_bic, least_aic FROM lo")
def best_k_criteria(t):
    return _by_k(t).agg(F.min_by("k", F.struct("bic", "k")).alias("least_bic"), F.min_by("k", F.struct("aic", "k")).alias("least_aic"))


@query(f"""WITH {_BY_K}, u AS (SELECT k, 1 - (bic - min(bic) OVER ())/(max(bic) OVER () - min(bic) OVER ()) - CAST(k - min(k) OVER () AS DOUBLE)/(max(k) OVER () - min(k) OVER ()) AS d, 2.0E0/(count(*) OVER () - 1) AS fall FROM s),
pk AS (SELECT *, d > lag(d) OVER (ORDER BY k) AND d >= lead(d) OVER (ORDER BY k) AS peak FROM u), kn AS (SELECT min(a.k) AS knee FROM pk a WHERE a.peak AND EXISTS (SELECT 1 FROM pk b WHERE b.k > a.k AND b.d < a.d - a.fall AND NOT EXISTS (SELECT 1 FROM pk c WHERE c.peak AND c.k > a.k AND c.k <= b.k)))
SELECT CASE WHEN least_bic = least_aic THEN least_bic ELSE coalesce(knee, least_bic) END AS k, CASE WHEN least_bic = least_aic THEN 'both' WHEN knee IS NOT NULL THEN 'knee' ELSE 'bic' END AS rule FROM lo CROSS JOIN kn""")
def bic_elbow(t):
    return celltypes.best_k(_by_k(t))


@query(f"WITH {TILES}, p AS (SELECT tile_id, x1, y1, x2, y2, label AS segment_id, count(*) AS n, count(*) FILTER (x >= x1 + 6 AND x < x2 - 6 AND y >= y1 + 6 AND y < y2 - 6) AS core FROM {{pixels}} JOIN tiles ON x >= x1 AND x < x2 AND y >= y1 AND y < y2 WHERE label > 0 GROUP BY ALL) SELECT tile_id, segment_id, n, core FROM p WHERE 2*core > n")
def tile_core_filter(t):
    """Segments with more than half of their pixels in a tile's core."""
    placed = grid.points_to_tiles(t.pixels.where("label > 0").select("x", "y", F.col("label").alias("segment_id")), tiles_of(t), 64)
    core = (F.col("x") >= F.col("x1") + 6) & (F.col("x") < F.col("x2") - 6) & (F.col("y") >= F.col("y1") + 6) & (F.col("y") < F.col("y2") - 6)
    return placed.groupBy("tile_id", "segment_id").agg(F.count("*").alias("n"), F.count(F.when(core, 1)).alias("core")).where("2 * core > n")


@query(f"WITH ta AS ({_members('truth_vertices', 'cell_id', 'truth_id')}), mb AS ({_members('method_vertices', 'segment_id', 'segment_id')}) SELECT coalesce(ta.transcript_id, mb.transcript_id) AS transcript_id, coalesce(truth_id, -1) AS truth_id, coalesce(segment_id, -1) AS segment_id FROM ta FULL JOIN mb ON ta.transcript_id = mb.transcript_id")
def benchmark_merge(t):
    truth, method, _ = _memberships(t)
    return truth.join(method, "transcript_id", "full").select("transcript_id", F.coalesce("truth_id", F.lit(-1)).alias("truth_id"), F.coalesce("segment_id", F.lit(-1)).alias("segment_id"))


TRIALS = 3


def _observed(t):
    """Rows (transcript_id, gene_id, d) of transcripts with the distance to the nearest cell, each once, and the places of cells."""
    tx = counts.encode_genes(counts.prepared(t.tx)).select("transcript_id", "gene_id", F.col("x_location").alias("x"), F.col("y_location").alias("y"))
    sites = t.cell_metadata.select(F.col("x_centroid").alias("sx"), F.col("y_centroid").alias("sy"))
    near = spatial.nearest_distances(sites, tx, ["transcript_id", "gene_id"])
    return stored(near.groupBy("transcript_id", "gene_id").agg(F.min("distance").alias("d"))), sites


def _null_sums(t, trials):
    """Rows (gene_id, trial, s): summed distances to the nearest cell; trial 0 as observed, the others of points hashed from transcript ids.

    What the hash makes of an id depends on its remainder only, so a remainder's points are placed once and count as often as a gene has it."""
    _, height = t.size()
    seen, sites = _observed(t)
    n = stored(seen.groupBy("gene_id", (F.col("transcript_id") % 1000003).alias("m")).agg(F.count("*").alias("n")))
    spots = n.select("m").distinct().withColumn("trial", F.explode(F.sequence(F.lit(1), F.lit(trials))))
    x = ((F.col("m") * 7919 + F.col("trial") * 104729) % 80000).cast("double") / 100
    y = ((F.col("m") * 15485863 + F.col("trial") * 1299709) % (height * 100)).cast("double") / 100
    far = spatial.nearest_distances(sites, spots.select("m", "trial", x.alias("x"), y.alias("y")), ["m", "trial"])
    each = far.groupBy("m").agg(*[F.max(F.when(F.col("trial") == k, F.col("distance"))).alias(f"d{k}") for k in range(1, trials + 1)])
    sums = n.join(each, "m").groupBy("gene_id").agg(*[F.sum(F.col("n") * F.col(f"d{k}")).alias(f"d{k}") for k in range(1, trials + 1)])
    null = sums.select("gene_id", F.explode(F.array(*[F.struct(F.lit(k).alias("trial"), F.col(f"d{k}").alias("s")) for k in range(1, trials + 1)])).alias("r")).select("gene_id", "r.*")
    return seen.groupBy("gene_id").agg(F.sum("d").alias("s")).select("gene_id", F.lit(0).alias("trial"), "s").unionByName(null)


#: s(gene_id, trial, s): the distances from pts to the nearest cell, summed.
_SUMS = f"""dn AS (SELECT trial, transcript_id, any_value(gene_id) AS gene_id, min(sqrt((x_centroid - px)*(x_centroid - px) + (y_centroid - py)*(y_centroid - py))) AS d FROM pts JOIN {{cell_metadata}} ON abs(x_centroid - px) <= 30 AND abs(y_centroid - py) <= 30 GROUP BY trial, transcript_id),
dw AS (SELECT trial, transcript_id, any_value(gene_id) AS gene_id, min(sqrt((x_centroid - px)*(x_centroid - px) + (y_centroid - py)*(y_centroid - py))) AS d FROM (SELECT * FROM pts ANTI JOIN (SELECT trial, transcript_id FROM dn WHERE d <= 30) USING (trial, transcript_id)) CROSS JOIN {{cell_metadata}} GROUP BY trial, transcript_id),
s AS (SELECT gene_id, trial, sum(d) AS s FROM (SELECT * FROM dn WHERE d <= 30 UNION ALL SELECT * FROM dw) GROUP BY ALL)"""


def _null_sums_sql(trials):
    return f"""{GENES}, tr AS (SELECT CAST(k AS INTEGER) AS trial FROM (SELECT unnest(generate_series(0, {trials})) AS k)),
pts AS (SELECT trial, transcript_id, gene_id, CASE WHEN trial = 0 THEN x_location ELSE CAST((transcript_id % 1000003 * 7919 + trial * 104729) % 80000 AS DOUBLE)/100 END AS px,
  CASE WHEN trial = 0 THEN y_location ELSE CAST((transcript_id % 1000003 * 15485863 + trial * 1299709) % (n_rows*2000) AS DOUBLE)/100 END AS py FROM prep JOIN genes USING (feature_name) CROSS JOIN tr CROSS JOIN {{slide}}),
{_SUMS}"""


P_TRIALS = 10
#: The integral of exp(-u * u / 2) from 0 to z by Simpson's rule in 200 pieces, over z.
_simpson = "(exp(-(z*k/200)*(z*k/200)/2) + 4*exp(-(z*(k + 0.5E0)/200)*(z*(k + 0.5E0)/200)/2) + exp(-(z*(k + 1)/200)*(z*(k + 1)/200)/2))/1200"


MERSENNE = (1 << 31) - 1  # a prime p for which u^5 mod p puts 0 .. p - 1 in another order


def _fifth(u):
    """u^5 modulo MERSENNE as text, of a column that is less; no product passes 64 bits."""
    return f"({u}*{u} % {MERSENNE})*({u}*{u} % {MERSENNE}) % {MERSENNE}*{u} % {MERSENNE}"


def _drawn(div):
    """Columns (text, name) up to u and v, numbers below MERSENNE drawn for a transcript in a trial: fifth powers, one after the other, of id and trial."""
    start = f"(transcript_id % {MERSENNE} + transcript_id {div} {MERSENNE} % {MERSENNE} + trial*CAST(104729 AS BIGINT)) % {MERSENNE}"
    return [(start, "a"), (f"({_fifth('a')} + 12345) % {MERSENNE}", "b"), (_fifth("b"), "u"), (f"(u + 67890) % {MERSENNE}", "c"), (_fifth("c"), "v")]


def _drawn_sql():
    """v_, the transcripts of each trial with those columns."""
    steps = _drawn("//")
    return ", ".join(f"{n}_ AS (SELECT *, {e} AS {n} FROM {f'{steps[k - 1][1]}_' if k else 'prep JOIN genes USING (feature_name) CROSS JOIN tr'})" for k, (e, n) in enumerate(steps))


@query(f"""WITH {GENES}, tr AS (SELECT CAST(k AS INTEGER) AS trial FROM (SELECT unnest(generate_series(0, {TRIALS})) AS k)),
bx AS (SELECT min(x_centroid) AS x0, max(x_centroid) - min(x_centroid) AS w, min(y_centroid) AS y0, max(y_centroid) - min(y_centroid) AS h FROM {{cell_metadata}}), {_drawn_sql()},
pts AS (SELECT trial, transcript_id, gene_id, CASE WHEN trial = 0 THEN x_location ELSE x0 + w*(CAST(u AS DOUBLE)/{MERSENNE}) END AS px, CASE WHEN trial = 0 THEN y_location ELSE y0 + h*(CAST(v AS DOUBLE)/{MERSENNE}) END AS py FROM v_ CROSS JOIN bx),
{_SUMS},
g AS (SELECT gene_id, max(s) FILTER (trial = 0) AS total, avg(s) FILTER (trial > 0) AS null_mean, stddev_pop(s) FILTER (trial > 0) AS null_sd FROM s GROUP BY gene_id),
e AS (SELECT gene_id, 1 - CAST(count(*) FILTER (trial > 0 AND s > total) AS DOUBLE)/{TRIALS} AS p FROM s JOIN g USING (gene_id) GROUP BY gene_id),
z AS (SELECT *, (total - null_mean)/nullif(null_sd, 0) AS z FROM g)
SELECT gene_id, round(total, 6) AS total, round(null_mean, 6) AS null_mean, round(null_sd, 6) AS null_sd, round(p, 6) AS p_exact,
 round(CASE WHEN abs(z) > 9 THEN CASE WHEN z > 0 THEN 1.0 ELSE 0.0 END ELSE 0.5E0 + z/sqrt(2*pi())*list_sum(list_transform(range(0, 200), lambda k: {_simpson})) END, 6) + 0.0 AS p_normal FROM z JOIN e USING (gene_id)""")
def uniformity_test(t):
    """Per gene the summed distance to the nearest cell, the mean and deviation of that sum over trials, and its p-value, exact and by the normal
    approximation. In a trial each transcript is drawn anew, uniformly over the box of the cells' centres, by a hash of its id and the trial."""
    seen, sites = _observed(t)
    x0, x1, y0, y1 = t.cell_metadata.agg(*[f(c).cast("double") for c in ("x_centroid", "y_centroid") for f in (F.min, F.max)]).first()
    spots = seen.select("transcript_id", "gene_id", F.explode(F.sequence(F.lit(1), F.lit(TRIALS))).alias("trial"))
    for text, name in _drawn("div"):
        spots = spots.withColumn(name, F.expr(text))
    within = lambda c, low, high: F.lit(low).cast("double") + (F.lit(high).cast("double") - F.lit(low).cast("double")) * (F.col(c).cast("double") / MERSENNE)
    placed = spots.select("gene_id", "trial", within("u", x0, x1).alias("x"), within("v", y0, y1).alias("y"))
    null = spatial.nearest_distances(sites, placed, ["gene_id", "trial"]).groupBy("gene_id", "trial").agg(F.sum("distance").alias("s"))
    sums = stored(seen.groupBy("gene_id").agg(F.sum("d").alias("s")).select("gene_id", F.lit(0).alias("trial"), "s").unionByName(null))
    s = F.when(F.col("trial") > 0, F.col("s"))
    each = sums.groupBy("gene_id").agg(F.max(F.when(F.col("trial") == 0, F.col("s"))).alias("total"), F.avg(s).alias("null_mean"), F.stddev_pop(s).alias("null_sd"))
    exact, normal = (spatial.uniformity_p(sums, TRIALS, e).withColumnRenamed("p", n) for n, e in (("p_exact", True), ("p_normal", False)))
    return each.join(exact, "gene_id").join(normal, "gene_id").select("gene_id", *[r6(F.col(c)).alias(c) for c in ("total", "null_mean", "null_sd", "p_exact", "p_normal")])


@query(f"""WITH {_null_sums_sql(P_TRIALS)}, t AS (SELECT gene_id, coalesce(max(s) FILTER (trial = 0), 0) AS total FROM s GROUP BY 1)
SELECT gene_id, round(1 - CAST(count(*) FILTER (trial > 0 AND s > total) AS DOUBLE)/{P_TRIALS}, 6) AS p FROM s JOIN t USING (gene_id) GROUP BY gene_id""")
def uniformity_exact(t):
    return spatial.uniformity_p(_null_sums(t, P_TRIALS), P_TRIALS, True).select("gene_id", r6(F.col("p")).alias("p"))


@query(f"""WITH {_null_sums_sql(P_TRIALS)}, g AS (SELECT DISTINCT gene_id FROM s), al AS (SELECT gene_id, trial, coalesce(s, 0) AS s FROM g CROSS JOIN tr LEFT JOIN s USING (gene_id, trial)),
z AS (SELECT gene_id, (max(s) FILTER (trial = 0) - avg(s) FILTER (trial > 0))/nullif(stddev_pop(s) FILTER (trial > 0), 0) AS z FROM al GROUP BY gene_id)
SELECT gene_id, round(CASE WHEN abs(z) > 9 THEN CASE WHEN z > 0 THEN 1.0 ELSE 0.0 END ELSE 0.5E0 + z/sqrt(2*pi())*list_sum(list_transform(range(0, 200), lambda k: {_simpson})) END, 6) + 0.0 AS p FROM z""")
def uniformity_normal(t):
    return spatial.uniformity_p(_null_sums(t, P_TRIALS), P_TRIALS, False).select("gene_id", r6(F.col("p")).alias("p"))


@query(f"""WITH {_SCORES}, bc AS (SELECT chain FROM scores ORDER BY round(bic, 6), chain, k LIMIT 1), hd AS (SELECT k, cell, arg_min(celltype, (-round(p, 9), celltype)) AS celltype FROM fp{FIT_STEPS} JOIN bc USING (chain) GROUP BY k, cell),
sz AS (SELECT k, celltype, count(*) AS cells FROM hd GROUP BY ALL), sn AS (SELECT k, celltype, gene_id, sum(n) AS v FROM cnt JOIN hd USING (cell) GROUP BY ALL),
rl AS (SELECT z.k, z.celltype, g.gene_id, CAST(coalesce(v, 0) AS DOUBLE)/cells/greatest(CASE WHEN a > cells THEN CAST(coalesce(t, 0) - coalesce(v, 0) AS DOUBLE)/(a - cells) ELSE 0 END, 0.01E0) AS r
 FROM sz z JOIN (SELECT k, sum(cells) AS a FROM sz GROUP BY k) w USING (k) CROSS JOIN genes g LEFT JOIN sn ON sn.k = z.k AND sn.celltype = z.celltype AND sn.gene_id = g.gene_id LEFT JOIN (SELECT k, gene_id, sum(v) AS t FROM sn GROUP BY ALL) q ON q.k = z.k AND q.gene_id = g.gene_id),
mk AS (SELECT k, celltype, gene_id, r, CAST(row_number() OVER (PARTITION BY k, celltype ORDER BY round(r, 9) DESC, gene_id) AS INTEGER) AS rank FROM rl QUALIFY rank <= 10)
SELECT section, k, CAST(NULL AS INTEGER) AS celltype, CAST(NULL AS BIGINT) AS gene_id, CAST(NULL AS INTEGER) AS rank, round(value, 3) AS value FROM (SELECT 'aic_low' AS section, k, min(aic) AS value FROM scores GROUP BY k UNION ALL SELECT 'aic_high', k, max(aic) FROM scores GROUP BY k UNION ALL SELECT 'bic_low', k, min(bic) FROM scores GROUP BY k UNION ALL SELECT 'bic_high', k, max(bic) FROM scores GROUP BY k)
UNION ALL SELECT 'prior', k, CAST(celltype AS INTEGER), NULL, NULL, round(prior, 3) FROM q{FIT_STEPS} JOIN bc USING (chain) UNION ALL SELECT 'marker', k, CAST(celltype AS INTEGER), gene_id, rank, round(r, 3) FROM mk""")
def job_model_report(t):
    """Score ranges by number of types, and of the best chain the priors and marker genes."""
    n, genes, models, scored = _fits(t)
    out = jobs.model_report(n, models, scored, genes)
    return out.withColumn("value", F.round("value", 3) + 0.0)


METHODS = {"method": "method_vertices", "moved": "moved_vertices"}


@query(f"WITH bm AS ({' UNION ALL '.join(f'SELECT {chr(39)}{m}{chr(39)} AS method, * FROM ({prior_sql(v)})' for m, v in METHODS.items())}), ow AS ({'WITH ' + _owner_sql('truth_vertices', 'cell_id', _CHUNKS)}) SELECT bm.*, ow.tile_id AS chunk FROM bm JOIN ow ON ow.cell_id = bm.truth_id")
def job_benchmark(t):
    """The benchmark of several methods: a row for each method and truth cell, with the chunk of the slide that the cell belongs to. Equi-joins on
    cells of the grid take the place of a loop over chunks, so no segment is cut off where chunks meet."""
    each = benchmarked(t, *[t.polygons(v, "segment_id") for v in METHODS.values()])
    parts = [out.withColumn("method", F.lit(m)) for m, out in zip(METHODS, each, strict=True)]
    height = math.ceil(t.size()[1] / 100) * 100
    chunks = spatial.tile_ownership(t.polygons("truth_vertices", "cell_id"), grid.tile_grid(t.spark, 800, height, 100, 0.0), "cell_id").select(F.col("cell_id").alias("truth_id"), F.col("tile_id").alias("chunk"))
    return parts[0].unionByName(parts[1]).join(chunks, "truth_id")


@query(f"""WITH {GENES}, m AS ({_members('method_vertices', 'segment_id', 'segment_id')}), {_polys_sql((0, '{method_vertices}', 'segment_id'), (1, '{nucleus_vertices}', 'cell_id'))}, {_met_sql('mn', 0, 1)}, {_slabs_sql('mn', (0, 1))},
kp AS (SELECT a_id AS segment_id, max(a01) AS area FROM mn_a JOIN mn_c USING (g) WHERE a01 > 2 GROUP BY 1), cs AS (SELECT segment_id, gene_id, count(*) AS n FROM m JOIN kp USING (segment_id) JOIN prep USING (transcript_id) JOIN genes USING (feature_name) GROUP BY ALL),
js AS (SELECT segment_id, celltype, sum(n*ln(prob)) + ln(1.0E0/3) AS j FROM cs JOIN {{init_profiles}} USING (gene_id) GROUP BY ALL), ps AS (SELECT segment_id, celltype, exp(j - mj)/sum(exp(j - mj)) OVER (PARTITION BY segment_id) AS p FROM (SELECT *, max(j) OVER (PARTITION BY segment_id) AS mj FROM js)),
hs AS (SELECT segment_id, arg_min(celltype, (-round(p, 9), celltype)) AS celltype FROM ps GROUP BY segment_id)
SELECT kp.segment_id, round(area, 6) AS nucleus_overlap_area, coalesce(t.n, 0) AS transcripts, celltype FROM kp LEFT JOIN (SELECT segment_id, CAST(sum(n) AS BIGINT) AS n FROM cs GROUP BY 1) t USING (segment_id) LEFT JOIN hs USING (segment_id)""")
def job_postprocess_external(t):
    """External outlines, of which every tile gives those it saw in its own coordinates, read as a polygon collection and stitched: of the copies
    that overlapping tiles give the one of the tile whose centre is nearest stays. Then outlines are kept where they share more than two units of
    area with a nucleus, counted and typed."""
    path, tiles = scratch(t.spark), slide_tiles_of(t)
    found = spatial.seen_by_tiles(t.polygons("method_vertices", "segment_id"), tiles, "segment_id", 64)
    io.polygon_json(found, "segment_id", "tile_id").write.json(path)
    seen = io.scan_polygon_json(t.spark, path, "tile_id bigint").withColumnRenamed("cell", "local_id")
    segments = stored(jobs.combined(seen, tiles).select(F.col("local_id").alias("segment_id"), "ring"))
    nuclear = overlay.intersections(segments, t.polygons("nucleus_vertices", "cell_id"), "segment_id", "cell_id", 2.0).groupBy("segment_id").agg(F.max("overlap").alias("area"))
    kept = stored(segments.join(nuclear, "segment_id"))
    tx = counts.encode_genes(counts.prepared(t.tx)).select("transcript_id", "gene_id", "x_location", "y_location")
    n = stored(counts.gene_counts(spatial.points_in_polygons(kept.select("segment_id", "ring"), tx, "x_location", "y_location"), "segment_id").withColumnRenamed("segment_id", "cell"))
    types = celltypes.hard_types(celltypes.posterior(n, *_start(t))).select(F.col("cell").alias("segment_id"), "celltype")
    totals = n.groupBy(F.col("cell").alias("segment_id")).agg(F.sum("n").alias("transcripts"))
    out = kept.join(totals, "segment_id", "left").join(types, "segment_id", "left")
    return out.select("segment_id", r6(F.col("area")).alias("nucleus_overlap_area"), F.coalesce("transcripts", F.lit(0)).alias("transcripts"), "celltype")


_LOGIT = {"foreground": (0.5, -1.0), "angle": (0.1, 0.0)}  # slope and height of each logit over the smoothed transcripts


def scorer(batch, model):
    """Smoothed transcripts to the logits of foreground and angle."""
    weights, lines = model
    return np.concatenate([a * filtered(batch, weights) + b for a, b in lines], -1)


@query(f"""WITH {PX}, {TILES}, {_SMOOTH}, lo AS (SELECT x, y, {_W.format(c='x', o='x1')}*{_W.format(c='y', o='y1')} AS w, 1/(1 + exp(-(0.5E0*s - 1))) AS f, {2 * math.pi!r}/(1 + exp(-0.1E0*s)) - {math.pi!r} AS a FROM sm)
SELECT x, y, round(sum(w*f)/sum(w), 6) AS foreground, round(atan2(sum(w*sin(a))/sum(w), sum(w*cos(a))/sum(w)), 6) + 0.0 AS angle FROM lo GROUP BY x, y""")
def job_predict(t):
    """Tile batches scored by a function with weights, decoded and stitched over overlapping tiles."""
    px, _ = _encoded(t)
    counted = px.groupBy("x", "y").agg(F.count("*").cast("double").alias("n"))
    scored = predictions.score_tiles(counted, tiles_of(t), 64, ["n"], scorer, (np.array(FILTER), list(_LOGIT.values())), ["l0", "l1"])
    fg, angle, _ = S.decode_logits(F.array("l0", "l1", F.lit(0.0)), 1)
    rows = scored.join(t.pixels.select("x", "y"), ["x", "y"], "left_semi").select("x", "y", "x1", "y1", fg.alias("foreground"), angle.alias("angle"), F.array(F.lit(1.0)).alias("probs"))
    out = predictions.stitch(rows, 64, 0.2, 1)
    return out.select("x", "y", r6(F.col("foreground")).alias("foreground"), r6(F.col("angle")).alias("angle"))
