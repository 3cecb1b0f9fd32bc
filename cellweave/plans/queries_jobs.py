"""More registered queries: sinks, overlays, sampling, reports and jobs."""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from cellweave.functions import scalars as S
from cellweave.operators import celltypes, counts, expand, grid, overlay, predictions, shapes, spatial, typefit
from cellweave.plans import jobs
from cellweave.plans.queries import (
    IN_TILE, SLIDE_TILES,
    _A, _DIST, _HARD, _J, _JOINED, _PROBS, CELL_COUNTS, NUCLEUS, PREP, PX, TILES, _cell_counts, _encoded, _judged, _members, _memberships, _soft, _start, _with_pred,
    edges_sql, inside_sql, query, r6, slide_tiles_of, tiles_of,
)
from cellweave.sources import io
from cellweave.sources.scratch import scratch, stored

# --- sinks and reads -------------------------------------------------------------------------------------------------------


@query("SELECT x - 32 AS x, y - 40 AS y, CASE WHEN label > 0 THEN k ELSE label END AS label FROM (SELECT x, y, label FROM {pixels} WHERE x >= 32 AND x < 96 AND y >= 40 AND y < 104) LEFT JOIN (SELECT label, row_number() OVER (ORDER BY label) AS k FROM (SELECT DISTINCT label FROM {pixels} WHERE label > 0 AND x >= 32 AND x < 96 AND y >= 40 AND y < 104)) USING (label)")
def read_dataset_tile(t):
    path = scratch(t.spark)
    io.write_grid(t.pixels.select("x", "y", "label"), path)
    tile = io.read_grid(t.spark, path, 32, 40, 96, 104).withColumn("tile_id", F.lit(0))
    return counts.relabel_within_tile(tile).select("x", "y", F.col("tile_label").cast("long").alias("label"))


@query("SELECT x - 32 AS x, y - 40 AS y, round(foreground, 6) AS foreground FROM {pred} WHERE x >= 32 AND x < 96 AND y >= 40 AND y < 104")
def read_predictions_tile(t):
    path = scratch(t.spark)
    io.write_grid(t.pred.select("x", "y", "foreground"), path)
    return io.read_grid(t.spark, path, 32, 40, 96, 104).select("x", "y", r6(F.col("foreground")).alias("foreground"))


@query("SELECT x, y, label AS segment_id FROM {pixels} WHERE label > 0")
def write_segmentation(t):
    path = scratch(t.spark)
    io.write_grid(t.pixels.where("label > 0").select("x", "y", F.col("label").alias("segment_id")), path)
    return t.spark.read.parquet(path).select("x", "y", "segment_id")


@query(f"WITH {CELL_COUNTS}, k AS (SELECT celltype FROM (SELECT DISTINCT celltype FROM {{init_profiles}})) SELECT 0 AS chain, celltype, gene_id, round(prob, 6) AS prob FROM {{init_profiles}} UNION ALL SELECT 1, celltype, gene_id, round(1.0E0/(SELECT count(*) FROM genes), 6) FROM k CROSS JOIN genes")
def read_celltype_models(t):
    """Two chains, written a folder each and read as one table."""
    path = scratch(t.spark)
    _, genes = _cell_counts(t)
    flat = t.init_profiles.select("celltype").distinct().crossJoin(F.broadcast(genes.select("gene_id").withColumn("prob", F.lit(1.0 / genes.count()))))
    t.init_profiles.select("celltype", "gene_id", "prob").write.parquet(f"{path}/chain=0")
    flat.write.parquet(f"{path}/chain=1")
    return t.spark.read.parquet(path).select("chain", "celltype", "gene_id", r6(F.col("prob")).alias("prob"))


@query(f"WITH {CELL_COUNTS} SELECT cell, gene_id, n FROM cnt")
def write_counts(t):
    path = scratch(t.spark)
    n, genes = _cell_counts(t)
    n.write.parquet(f"{path}/counts")
    genes.write.parquet(f"{path}/var")
    return t.spark.read.parquet(f"{path}/counts").select("cell", "gene_id", "n")


@query(f"WITH {NUCLEUS} SELECT id AS cell_id, count(*) AS n, round(abs(sum(x1*y2 - x2*y1))/2, 6) AS area FROM edges GROUP BY id")
def write_shapes(t):
    path = scratch(t.spark)
    t.polygons("nucleus_vertices", "cell_id").write.parquet(path)
    return t.spark.read.parquet(path).select("cell_id", F.size("ring").cast("long").alias("n"), r6(S.ring_area(F.col("ring"))).alias("area"))


@query(f"WITH t AS ({_members('truth_vertices', 'cell_id', 'segment_id')}), m AS ({_members('method_vertices', 'segment_id', 'segment_id')}) SELECT 'truth' AS method, segment_id, count(*) AS n FROM t GROUP BY segment_id UNION ALL SELECT 'method', segment_id, count(*) FROM m GROUP BY segment_id")
def write_benchmarks(t):
    truth, method, _ = _memberships(t)
    path = scratch(t.spark)
    one = truth.groupBy(F.col("truth_id").alias("segment_id")).agg(F.count("*").alias("n")).withColumn("method", F.lit("truth"))
    two = method.groupBy("segment_id").agg(F.count("*").alias("n")).withColumn("method", F.lit("method"))
    one.unionByName(two).write.partitionBy("method").parquet(path)
    return t.spark.read.parquet(path).select("method", "segment_id", "n")


@query("SELECT cell_id, 'nucleus' AS method FROM {nuclei} UNION ALL SELECT DISTINCT segment_id, 'method' FROM {method_vertices}")
def concat_shapes(t):
    a = t.polygons("nucleus_vertices", "cell_id").select("cell_id", "ring", F.lit("nucleus").alias("method"))
    b = t.polygons("method_vertices", "segment_id").select(F.col("segment_id").alias("cell_id"), "ring", F.lit("method").alias("method"))
    return a.unionByName(b).select("cell_id", "method")


# --- joins and overlays ------------------------------------------------------------------------------------------------------


def _owner_sql(table: str, key: str, starts: str) -> str:
    return f"""{edges_sql(table, key)}, {starts}, c AS (SELECT tile_id, (x1 + x2)/2.0E0 AS px, (y1 + y2)/2.0E0 AS py FROM tiles),
near AS (SELECT b.id, c.tile_id, px, py FROM box b JOIN c ON abs(xmin - px) <= 200 AND abs(ymin - py) <= 200),
d AS (SELECT n.id, n.tile_id, sqrt(min((x1 + {_DIST}*(x2-x1) - px)*(x1 + {_DIST}*(x2-x1) - px) + (y1 + {_DIST}*(y2-y1) - py)*(y1 + {_DIST}*(y2-y1) - py))) AS dist,
  sum(CASE WHEN (y1 > py) <> (y2 > py) AND px < x1 + (py - y1)*(x2 - x1)/(y2 - y1) THEN 1 ELSE 0 END) % 2 = 1 AS inside FROM near n JOIN edges e ON e.id = n.id GROUP BY n.id, n.tile_id, px, py)
SELECT id AS {key}, arg_min(tile_id, (CASE WHEN inside THEN 0 ELSE round(dist, 9) END, tile_id)) AS tile_id FROM d GROUP BY id"""


@query(f"WITH {_owner_sql('nucleus_vertices', 'cell_id', SLIDE_TILES)}")
def tile_ownership(t):
    return spatial.tile_ownership(t.polygons("nucleus_vertices", "cell_id"), slide_tiles_of(t), "cell_id")


_CHUNKS = "cx0 AS (SELECT unnest(generate_series(0, 700, 100)) AS s), cy0 AS (SELECT unnest(generate_series(0, CAST(ceil(n_rows*20/100.0E0) AS BIGINT)*100 - 100, 100)) AS s FROM {slide}), tiles AS (SELECT row_number() OVER (ORDER BY a.s, b.s) - 1 AS tile_id, a.s AS x1, b.s AS y1, a.s + 100 AS x2, b.s + 100 AS y2 FROM cx0 a CROSS JOIN cy0 b)"


@query(f"WITH {_owner_sql('truth_vertices', 'cell_id', _CHUNKS)}")
def chunk_segments(t):
    height = math.ceil(t.size()[1] / 100) * 100
    return spatial.tile_ownership(t.polygons("truth_vertices", "cell_id"), grid.tile_grid(t.spark, 800, height, 100, 0.0), "cell_id")


def _polys_sql(*parts: tuple[int, str, str]) -> str:
    """polys(role, id, x1, y1, x2, y2), the edges of polygons of several tables, and their boxes."""
    out = []
    for role, table, key in parts:
        w = f"(PARTITION BY {key} ORDER BY k)"
        out.append(f"""SELECT {role} AS role, {key} AS id, vertex_x AS x1, vertex_y AS y1, coalesce(lead(vertex_x) OVER {w}, first_value(vertex_x) OVER {w}) AS x2,
  coalesce(lead(vertex_y) OVER {w}, first_value(vertex_y) OVER {w}) AS y2 FROM {table}""")
    return f"polys AS ({' UNION ALL '.join(out)}), boxes AS (SELECT role, id, min(x1) AS xmin, max(x1) AS xmax, min(y1) AS ymin, max(y1) AS ymax FROM polys GROUP BY role, id)"


def _met_sql(name: str, a: int, b: int) -> str:
    """name_g(g, role, id): the pairs of polygons of two roles whose boxes meet."""
    return f"""{name}_c AS (SELECT row_number() OVER (ORDER BY a.id, b.id) AS g, a.id AS a_id, b.id AS b_id FROM boxes a JOIN boxes b ON a.role = {a} AND b.role = {b} AND a.xmin < b.xmax AND b.xmin < a.xmax AND a.ymin < b.ymax AND b.ymin < a.ymax),
{name}_g AS (SELECT g, {a} AS role, a_id AS id FROM {name}_c UNION ALL SELECT g, {b}, b_id FROM {name}_c)"""


def _slabs_sql(name: str, roles: tuple[int, ...]) -> str:
    """name_a(g, ...): areas of convex polygons of a group, a<roles> of what those roles share, by slabs between vertices and crossings."""
    both = [c for n in range(1, len(roles) + 1) for c in combinations(roles, n)]
    det = "((a.x2 - a.x1)*(b.y2 - b.y1) - (a.y2 - a.y1)*(b.x2 - b.x1))"
    lows = ", ".join(f"min(y) FILTER (role = {r}) AS l{r}, max(y) FILTER (role = {r}) AS h{r}" for r in roles)
    areas = ", ".join(
        f"coalesce(sum((xb - xa)*greatest(least({', '.join(f'h{r}' for r in c)}) - greatest({', '.join(f'l{r}' for r in c)}), 0)) FILTER ({' AND '.join(f'h{r} IS NOT NULL' for r in c)}), 0) AS a{''.join(map(str, c))}" for c in both
    )
    return f"""{name}_e AS (SELECT g, role, x1, y1, x2, y2 FROM {name}_g JOIN polys USING (role, id)),
{name}_x AS (SELECT g, x1 AS x FROM {name}_e UNION SELECT g, x1 + t*(x2 - x1) FROM (SELECT a.g, a.x1, a.x2, ((b.x1 - a.x1)*(b.y2 - b.y1) - (b.y1 - a.y1)*(b.x2 - b.x1))/{det} AS t,
  ((b.x1 - a.x1)*(a.y2 - a.y1) - (b.y1 - a.y1)*(a.x2 - a.x1))/{det} AS u FROM {name}_e a JOIN {name}_e b ON a.g = b.g AND a.role < b.role WHERE {det} <> 0) WHERE t BETWEEN 0 AND 1 AND u BETWEEN 0 AND 1),
{name}_s AS (SELECT g, x AS xa, lead(x) OVER (PARTITION BY g ORDER BY x) AS xb FROM {name}_x),
{name}_y AS (SELECT s.g, xa, xb, role, y1 + ((xa + xb)/2 - x1)*(y2 - y1)/(x2 - x1) AS y FROM {name}_s s JOIN {name}_e e ON e.g = s.g WHERE xb IS NOT NULL AND x1 <> x2 AND (xa + xb)/2 BETWEEN least(x1, x2) AND greatest(x1, x2)),
{name}_b AS (SELECT g, xa, xb, {lows} FROM {name}_y GROUP BY g, xa, xb),
{name}_a AS (SELECT g, {areas} FROM {name}_b GROUP BY g)"""


_PAIRED = f"{_polys_sql((0, '{truth_vertices}', 'cell_id'), (1, '{method_vertices}', 'segment_id'))}, {_met_sql('tm', 0, 1)}, {_slabs_sql('tm', (0, 1))}, o AS (SELECT a_id AS truth_id, b_id AS segment_id, a01 AS overlap, a0 + a1 - a01 AS union_area FROM tm_a JOIN tm_c USING (g) WHERE a01 > 0)"


def _truth(t):
    return t.polygons("truth_vertices", "cell_id").withColumnRenamed("cell_id", "truth_id")


def _method(t):
    return t.polygons("method_vertices", "segment_id")


@query(f"WITH {_PAIRED} SELECT truth_id, segment_id, round(overlap, 6) AS overlap FROM o WHERE overlap > 1e-6")
def overlay_area(t):
    out = overlay.intersections(_truth(t), _method(t), "truth_id", "segment_id", 1e-6)
    return out.select("truth_id", "segment_id", r6(F.col("overlap")).alias("overlap"))


@query(f"WITH {_A} SELECT a_id, b_id, count(*) AS overlap FROM a JOIN b USING (x, y) GROUP BY ALL")
def overlay_pixels(t):
    return spatial.pixel_overlaps(*_shifted(t), "a_id", "b_id")


def _shifted(t):
    on = t.pixels.where("label > 0")
    return on.select("x", "y", F.col("label").alias("a_id")), on.select((F.col("x") + 1).alias("x"), (F.col("y") + 1).alias("y"), F.col("label").alias("b_id"))


@query(f"WITH {_PAIRED} SELECT truth_id, segment_id, round(overlap, 6) AS overlap FROM o WHERE overlap > 1 QUALIFY row_number() OVER (PARTITION BY truth_id ORDER BY round(overlap, 9) DESC, segment_id) = 1")
def max_overlap_join(t):
    out = overlay.best_overlap(_truth(t), _method(t), "truth_id", "segment_id", 1.0)
    return out.select("truth_id", "segment_id", r6(F.col("overlap")).alias("overlap"))


@query(f"WITH {_polys_sql((0, '{method_vertices}', 'segment_id'), (1, '{nucleus_vertices}', 'cell_id'))}, {_met_sql('mn', 0, 1)}, {_slabs_sql('mn', (0, 1))} SELECT a_id AS segment_id, round(max(a01), 6) AS nucleus_overlap_area FROM mn_a JOIN mn_c USING (g) WHERE a01 > 2 GROUP BY 1")
def filter_by_nucleus_overlap(t):
    met = overlay.intersections(_method(t), t.polygons("nucleus_vertices", "cell_id"), "segment_id", "cell_id", 2.0)
    return met.groupBy("segment_id").agg(r6(F.max("overlap")).alias("nucleus_overlap_area"))


@query(f"WITH {_PAIRED} SELECT truth_id, segment_id, round(overlap, 6) AS intersection, round(union_area, 6) AS union_area, round(overlap/union_area, 6) AS iou FROM o WHERE overlap > 2 QUALIFY row_number() OVER (PARTITION BY truth_id ORDER BY round(overlap, 9) DESC, segment_id) = 1")
def average_iou(t):
    out = overlay.best_overlap(_truth(t), _method(t), "truth_id", "segment_id", 2.0)
    return out.select("truth_id", "segment_id", r6(F.col("overlap")).alias("intersection"), r6(F.col("union_area")).alias("union_area"), r6(F.col("overlap") / F.col("union_area")).alias("iou"))


_BOX = "SELECT 9 AS role, 0 AS id, unnest([100.0E0, 500, 500, 100]) AS x1, unnest([50.0E0, 50, 600, 600]) AS y1, unnest([500.0E0, 500, 100, 100]) AS x2, unnest([50.0E0, 600, 600, 50]) AS y2"


def _clipped_sql(*parts: tuple[int, str, str], box: str = _BOX) -> str:
    """in_area(role, id, area): what of polygons lies in a box, by default that from (100, 50) to (500, 600)."""
    edges = _polys_sql(*parts).split(", boxes AS")[0].replace("polys AS (", "polys0 AS (", 1)
    roles = [r for r, _, _ in parts]
    slabs = ", ".join(f"{_met_sql(f'c{r}', r, 9)}, {_slabs_sql(f'c{r}', (r, 9))}" for r in roles)
    found = " UNION ALL ".join(f"SELECT {r} AS role, a_id AS id, a{r}9 AS area FROM c{r}_a JOIN c{r}_c USING (g)" for r in roles)
    return f"{edges}, polys AS (SELECT * FROM polys0 UNION ALL {box}), boxes AS (SELECT role, id, min(x1) AS xmin, max(x1) AS xmax, min(y1) AS ymin, max(y1) AS ymax FROM polys GROUP BY role, id), {slabs}, in_area AS (SELECT * FROM ({found}) WHERE area > 1e-9)"


@query(f"WITH {_clipped_sql((0, '{nucleus_vertices}', 'cell_id'))} SELECT id AS cell_id, round(area/0.25E0, 6) AS area FROM in_area")
def polygons_to_raster_space(t):
    """Nuclei clipped to an area, in pixels of half a unit."""
    rings = overlay.to_raster_space(t.polygons("nucleus_vertices", "cell_id"), 100.0, 50.0, 500.0, 600.0, 0.5)
    return rings.select("cell_id", S.ring_area(F.col("ring")).alias("a")).where("a > 4e-9").select("cell_id", r6(F.col("a")).alias("area"))


#: Nuclei, and the same moved by (3, 2): they overlap each other, so that what they leave of a cell isn't a sum over pairs.
_MOVED = "(SELECT cell_id, k, vertex_x + 3 AS vertex_x, vertex_y + 2 AS vertex_y FROM {nucleus_vertices})"
_LEFT = f"{_polys_sql((0, '{truth_vertices}', 'cell_id'), (1, '{nucleus_vertices}', 'cell_id'), (2, _MOVED, 'cell_id'))}, lf_g AS (SELECT id AS g, 0 AS role, id FROM boxes WHERE role = 0 UNION ALL SELECT a.id, b.role, b.id FROM boxes a JOIN boxes b ON a.role = 0 AND b.role > 0 AND a.xmin < b.xmax AND b.xmin < a.xmax AND a.ymin < b.ymax AND b.ymin < a.ymax), {_slabs_sql('lf', (0, 1, 2))}, left_ AS (SELECT g AS segment_id, a0 AS cell_area, a0 - a01 - a02 + a012 AS cytoplasm_area FROM lf_a)"
_CYTO2 = f"tr AS ({_members('truth_vertices', 'cell_id', 'segment_id')}), nu AS ({_members('nucleus_vertices', 'cell_id', 'cell_id')} UNION ALL SELECT id AS cell_id, transcript_id FROM (WITH {PREP}, {edges_sql('nucleus_vertices', 'cell_id').replace('vertex_x', '(vertex_x + 3)').replace('vertex_y', '(vertex_y + 2)')}, {inside_sql('prep', 'transcript_id', 'x_location', 'y_location')} SELECT * FROM hit))"


def _doubled_nuclei(t):
    """Nuclei, and the same moved by (3, 2)."""
    n = t.polygons("nucleus_vertices", "cell_id").select(F.col("cell_id").alias("nucleus_id"), "ring")
    moved = F.transform("ring", lambda p: F.struct((p["x"] + 3).alias("x"), (p["y"] + 2).alias("y")))
    return n.unionByName(n.select((-1 - F.col("nucleus_id")).alias("nucleus_id"), moved.alias("ring")))


def _cytoplasm(t):
    tx = counts.prepared(t.tx).select("transcript_id", "x_location", "y_location")
    cells, nuclei = t.polygons("truth_vertices", "cell_id").withColumnRenamed("cell_id", "segment_id"), _doubled_nuclei(t)
    truth = spatial.points_in_polygons(cells, tx, "x_location", "y_location").select("segment_id", "transcript_id")
    nuclear = spatial.points_in_polygons(nuclei, tx, "x_location", "y_location").select("transcript_id").distinct()
    return truth, nuclear, overlay.differences(cells, nuclei, "segment_id", "nucleus_id")


@query(f"WITH {_CYTO2}, {_LEFT} SELECT segment_id, transcript_id, round(cytoplasm_area, 6) AS cytoplasm_area FROM tr JOIN left_ USING (segment_id) WHERE transcript_id NOT IN (SELECT transcript_id FROM nu)")
def cytoplasm_overlay(t):
    """Transcripts of cells outside of all nuclei, and the area of what nuclei leave of the cell."""
    truth, nuclear, areas = _cytoplasm(t)
    return truth.join(nuclear, "transcript_id", "left_anti").join(areas, "segment_id").select("segment_id", "transcript_id", r6(F.col("outside")).alias("cytoplasm_area"))


@query(f"WITH {_CYTO2}, {_LEFT} SELECT segment_id, count(*) AS segmentation_count, count(*) FILTER (transcript_id NOT IN (SELECT transcript_id FROM nu)) AS cytoplasm_count, round(max(cell_area), 6) AS cell_area, round(max(cytoplasm_area), 6) AS cytoplasm_area FROM tr JOIN left_ USING (segment_id) GROUP BY segment_id HAVING count(*) FILTER (transcript_id NOT IN (SELECT transcript_id FROM nu)) > 0")
def cyto_proportion(t):
    """Counts and areas of cells and of their cytoplasm, for cells with a transcript there."""
    truth, nuclear, areas = _cytoplasm(t)
    marked = truth.join(nuclear.withColumn("nuclear", F.lit(1)), "transcript_id", "left")
    n = marked.groupBy("segment_id").agg(F.count("*").alias("segmentation_count"), F.count(F.when(F.col("nuclear").isNull(), 1)).alias("cytoplasm_count"))
    return n.where("cytoplasm_count > 0").join(areas, "segment_id").select("segment_id", "segmentation_count", "cytoplasm_count", r6(F.col("area")).alias("cell_area"), r6(F.col("outside")).alias("cytoplasm_area"))


def _max_sql(name: str, other: str) -> str:
    return f"{name}_m AS (SELECT a_id AS truth_id, b_id AS {other} FROM {name}_a JOIN {name}_c USING (g) WHERE a0{'1' if name == 'tm' else '2'} > 1 QUALIFY row_number() OVER (PARTITION BY a_id ORDER BY round(a0{'1' if name == 'tm' else '2'}, 9) DESC, b_id) = 1)"


def prior_sql(table: str) -> str:
    """Truth cells against the segments of a table joined with nuclei, a row a cell."""
    return f"""WITH tr AS ({_members('truth_vertices', 'cell_id', 'truth_id')}), mb AS ({_members(table, 'segment_id', 'segment_id')}), nb AS ({_members('nucleus_vertices', 'cell_id', 'nucleus_id')}),
{_polys_sql((0, '{truth_vertices}', 'cell_id'), (1, '{' + table + '}', 'segment_id'), (2, '{nucleus_vertices}', 'cell_id'))},
{_met_sql('tm', 0, 1)}, {_slabs_sql('tm', (0, 1))}, {_met_sql('tn', 0, 2)}, {_slabs_sql('tn', (0, 2))}, {_max_sql('tm', 'segment_id')}, {_max_sql('tn', 'nucleus_id')},
ids AS (SELECT b.id AS truth_id, segment_id, nucleus_id FROM boxes b LEFT JOIN tm_m ON tm_m.truth_id = b.id LEFT JOIN tn_m ON tn_m.truth_id = b.id WHERE b.role = 0),
al_g AS (SELECT truth_id AS g, 0 AS role, truth_id AS id FROM ids WHERE nucleus_id IS NOT NULL UNION ALL SELECT truth_id, 1, segment_id FROM ids WHERE nucleus_id IS NOT NULL AND segment_id IS NOT NULL UNION ALL SELECT truth_id, 2, nucleus_id FROM ids WHERE nucleus_id IS NOT NULL),
{_slabs_sql('al', (0, 1, 2))}, found AS (SELECT truth_id, segment_id, transcript_id FROM ids JOIN mb USING (segment_id) UNION SELECT truth_id, segment_id, transcript_id FROM ids JOIN nb USING (nucleus_id)),
tru AS (SELECT truth_id, transcript_id FROM tr WHERE truth_id IN (SELECT truth_id FROM ids WHERE nucleus_id IS NOT NULL)),
met AS (SELECT coalesce(f.segment_id, -1) AS segment_id, coalesce(f.truth_id, -1) AS matching, coalesce(t.truth_id, -1) AS of FROM found f FULL JOIN tru t ON f.transcript_id = t.transcript_id),
err AS (SELECT segment_id, CAST(count(*) FILTER (of <> -1 AND of <> own) AS BIGINT) AS n_confused, CAST(count(*) FILTER (of = -1) AS BIGINT) AS n_background, CAST(count(*) AS BIGINT) AS n_transcripts FROM (SELECT *, max(matching) OVER (PARTITION BY segment_id) AS own FROM met) GROUP BY segment_id),
sh AS (SELECT truth_id, count(*) AS n FROM found JOIN tru USING (truth_id, transcript_id) GROUP BY truth_id),
jc AS (SELECT truth_id, coalesce(n, 0) AS jaccard_intersection, m + t - coalesce(n, 0) AS jaccard_union FROM (SELECT truth_id, count(*) AS m FROM found GROUP BY 1) JOIN (SELECT truth_id, count(*) AS t FROM tru GROUP BY 1) USING (truth_id) LEFT JOIN sh USING (truth_id))
SELECT ids.truth_id, coalesce(ids.segment_id, -1) AS segment_id, round(a01 + a02 - a012, 6) AS intersection_area, round(a0 + a1 + a2 - a01 - a02 - a12 + a012, 6) AS union_area,
 round((a01 + a02 - a012)/(a0 + a1 + a2 - a01 - a02 - a12 + a012), 6) AS iou, jaccard_intersection, jaccard_union, round(CAST(jaccard_intersection AS DOUBLE)/jaccard_union, 6) AS jaccard_index, n_confused, n_background, n_transcripts, segmentation_method
FROM ids JOIN err ON err.segment_id = coalesce(ids.segment_id, -1) LEFT JOIN al_a ON al_a.g = ids.truth_id LEFT JOIN jc ON jc.truth_id = ids.truth_id JOIN {{cell_metadata}} c ON c.cell_id = ids.truth_id"""


def benchmarked(t, *methods):
    """For each method, truth cells against its segments joined with nuclei: areas, transcripts and errors in one row a cell. Transcripts are
    prepared once, and those of truth cells and nuclei are found once for all methods."""
    tx = stored(counts.prepared(t.tx).select("transcript_id", "x_location", "y_location"))
    found = lambda polygons, key: stored(spatial.points_in_polygons(polygons, tx, "x_location", "y_location").select(key, "transcript_id"))
    truth, nuclei = stored(_truth(t)), stored(t.polygons("nucleus_vertices", "cell_id").withColumnRenamed("cell_id", "nucleus_id"))
    in_truth, in_nuclei = found(truth, "truth_id"), found(nuclei, "nucleus_id")
    kind = t.cell_metadata.select(F.col("cell_id").alias("truth_id"), "segmentation_method")
    rounded = [r6(F.col(c)).alias(c) for c in ("intersection_area", "union_area", "iou", "jaccard_index")]
    for method in map(stored, methods):
        out = overlay.nuclear_prior_benchmark(truth, method, nuclei, in_truth, found(method, "segment_id"), in_nuclei)
        yield out.join(kind, "truth_id").select("truth_id", "segment_id", *rounded, "jaccard_intersection", "jaccard_union", "n_confused", "n_background", "n_transcripts", "segmentation_method")


@query(prior_sql("method_vertices"))
def benchmark_nuclear_prior(t):
    return next(benchmarked(t, _method(t)))


@query(f"WITH {edges_sql('truth_vertices', 'cell_id')}, {inside_sql('{cell_metadata}', 'cell_id', 'x_centroid', 'y_centroid')} SELECT h.id AS truth_id, m.cell_id, segmentation_method FROM hit h JOIN {{cell_metadata}} m USING (cell_id)")
def truth_with_metadata(t):
    return spatial.points_in_polygons(t.polygons("truth_vertices", "cell_id").withColumnRenamed("cell_id", "truth_id"), t.cell_metadata, "x_centroid", "y_centroid").select("truth_id", "cell_id", "segmentation_method")


@query(f"""WITH {NUCLEUS}, r AS (SELECT x, y, x + 0.5E0 AS ox, y + 0.5E0 AS oy, cos(angle) AS dx, sin(angle) AS dy FROM {{pred}} JOIN {{pixels}} USING (x, y) WHERE label <= 0),
c AS (SELECT r.*, b.id FROM r JOIN box b ON ox BETWEEN xmin - 8 AND xmax + 8 AND oy BETWEEN ymin - 8 AND ymax + 8),
h AS (SELECT x, y, c.id, ((x1 - ox)*(y2 - y1) - (y1 - oy)*(x2 - x1))/(dx*(y2 - y1) - dy*(x2 - x1)) AS t, ((x1 - ox)*dy - (y1 - oy)*dx)/(dx*(y2 - y1) - dy*(x2 - x1)) AS u FROM c JOIN edges e ON e.id = c.id WHERE abs(dx*(y2 - y1) - dy*(x2 - x1)) > 1e-10)
SELECT x, y, arg_min(id, (t, id)) AS cell_id, round(min(t), 6) + 0.0 AS distance FROM h WHERE t >= 0 AND t <= 8 AND u BETWEEN 0 AND 1 GROUP BY x, y""")
def ray_polygon_hit(t):
    rays = t.pixels.where("label <= 0").select("x", "y").join(t.pred.select("x", "y", "angle"), ["x", "y"])
    return spatial.ray_hits(rays, t.polygons("nucleus_vertices", "cell_id"), "cell_id", 8.0).select("x", "y", "cell_id", r6(F.col("distance")).alias("distance"))


@query(f"WITH {_PROBS} SELECT x, y, label AS segment_id, round(p0, 6) AS p0, round(p1, 6) AS p1 FROM {{pixels}} JOIN soft USING (x, y) WHERE label > 0")
def mean_prob_lookup(t):
    met = t.pixels.where("label > 0").select("x", "y", F.col("label").alias("segment_id")).join(_soft(t), ["x", "y"])
    return met.select("x", "y", "segment_id", r6(F.col("probs")[0]).alias("p0"), r6(F.col("probs")[1]).alias("p1"))


@query(f"WITH {_HARD} SELECT n.cell_id, celltype FROM {{nuclei}} n LEFT JOIN hard h ON h.cell = n.cell_id")
def celltype_attach(t):
    types = celltypes.hard_types(celltypes.posterior(_cell_counts(t)[0], *_start(t))).select(F.col("cell").alias("cell_id"), "celltype")
    return t.nuclei.select("cell_id").join(types, "cell_id", "left")


@query("SELECT p.x, p.y, i.intensity FROM {pixels} p JOIN {image} i ON i.x = CAST(round_even(p.x*0.5E0 + 3, 0) AS BIGINT) AND i.y = CAST(round_even(p.y*0.5E0 + 7, 0) AS BIGINT)")
def affine_pixel_map(t):
    at = t.pixels.select("x", "y", F.rint(F.col("x") * 0.5 + 3).cast("long").alias("sx"), F.rint(F.col("y") * 0.5 + 7).cast("long").alias("sy"))
    return at.join(t.image.withColumnRenamed("x", "sx").withColumnRenamed("y", "sy"), ["sx", "sy"]).select("x", "y", "intensity")


@query(f"WITH {CELL_COUNTS}, g AS (SELECT cell, n FROM cnt JOIN genes USING (gene_id) WHERE feature_name = 'gene_05') SELECT n.cell_id, round(ln(1 + coalesce(g.n, 0)), 6) AS value FROM {{nuclei}} n LEFT JOIN g ON g.cell = n.cell_id")
def log1p_expression(t):
    n, genes = _cell_counts(t)
    one = n.join(genes.where("feature_name = 'gene_05'"), "gene_id").select(F.col("cell").alias("cell_id"), "n")
    return t.nuclei.select("cell_id").join(one, "cell_id", "left").select("cell_id", r6(F.log1p(F.coalesce("n", F.lit(0)))).alias("value"))


@query(f"WITH {_HARD} SELECT celltype, CAST(cell % 3 AS INTEGER) AS class, celltype = cell % 3 AS agrees, count(*) AS n FROM hard GROUP BY ALL")
def agreement_class(t):
    types = celltypes.hard_types(celltypes.posterior(_cell_counts(t)[0], *_start(t)))
    kind = (F.col("cell") % 3).cast("int")
    return types.groupBy("celltype", kind.alias("class"), (F.col("celltype") == kind).alias("agrees")).agg(F.count("*").alias("n"))


# --- aggregates and reports ----------------------------------------------------------------------------------------------------


@query(f"WITH {PX}, b AS (SELECT gene_id, count(*) AS n FROM px JOIN {{pixels}} USING (x, y) WHERE label = 0 GROUP BY gene_id) SELECT gene_id, coalesce(n, 0) + 1 AS pseudocount FROM genes LEFT JOIN b USING (gene_id)")
def background_pseudocounts(t):
    px, genes = _encoded(t)
    return counts.background(px, t.pixels, genes).select("gene_id", "pseudocount")


@query(f"WITH {CELL_COUNTS} SELECT cell, CAST(sum(n) AS BIGINT) AS total FROM cnt GROUP BY cell HAVING sum(n) >= 5")
def min_molecules_filter(t):
    return counts.cell_gene_table(_cell_counts(t)[0], "cell", 5).select("cell", "total").distinct()


@query(f"WITH {_HARD}, a AS (SELECT id AS cell, abs(sum(x1*y2 - x2*y1))/2 AS area FROM edges GROUP BY id) SELECT celltype, count(*) AS cells, round(sum(area), 6) AS area, round(quantile_cont(area, 0.25), 6) AS q1, round(quantile_cont(area, 0.75), 6) AS q3 FROM hard JOIN a USING (cell) GROUP BY celltype")
def celltype_summary(t):
    types = celltypes.hard_types(celltypes.posterior(_cell_counts(t)[0], *_start(t)))
    area = t.polygons("nucleus_vertices", "cell_id").select(F.col("cell_id").alias("cell"), S.ring_area(F.col("ring")).alias("area"))
    out = types.join(area, "cell").groupBy("celltype").agg(F.count("*").alias("cells"), F.sum("area").alias("a"), F.percentile("area", F.lit(0.25)).alias("q1"), F.percentile("area", F.lit(0.75)).alias("q3"))
    return out.select("celltype", "cells", r6(F.col("a")).alias("area"), r6(F.col("q1")).alias("q1"), r6(F.col("q3")).alias("q3"))


FIT_STEPS = 2


def _fits_sql() -> str:
    """Models of several numbers of types and chains after FIT_STEPS steps from given starts, and their scores."""
    of = "k, chain, celltype"
    out = [f"{CELL_COUNTS}, f0 AS (SELECT * FROM {{starts}}), q0 AS (SELECT DISTINCT {of}, 1.0E0/k AS prior FROM f0)"]
    for s in range(FIT_STEPS + 1):
        out.append(f"fj{s} AS (SELECT k, chain, cell, celltype, sum(n*ln(prob)) + ln(max(prior)) AS j FROM cnt JOIN f{s} USING (gene_id) JOIN q{s} USING ({of}) GROUP BY ALL)")
        out.append(f"fp{s} AS (SELECT k, chain, cell, celltype, j, mj, exp(j - mj)/sum(exp(j - mj)) OVER (PARTITION BY k, chain, cell) AS p FROM (SELECT *, max(j) OVER (PARTITION BY k, chain, cell) AS mj FROM fj{s}))")
        if s < FIT_STEPS:
            out.append(f"fv{s} AS (SELECT {of}, g.gene_id, coalesce(v, 0) + 1 AS v FROM q{s} CROSS JOIN genes g LEFT JOIN (SELECT {of}, gene_id, sum(p*n) AS v FROM cnt JOIN fp{s} USING (cell) GROUP BY ALL) s USING ({of}, gene_id))")
            out.append(f"f{s + 1} AS (SELECT {of}, gene_id, v/sum(v) OVER (PARTITION BY {of}) AS prob FROM fv{s})")
            out.append(f"q{s + 1} AS (SELECT {of}, (sum(p) + 1)/(count(*) + k) AS prior FROM fp{s} GROUP BY {of})")
    out.append(f"fl AS (SELECT k, chain, cell, max(mj) + ln(sum(exp(j - mj))) AS ll FROM fp{FIT_STEPS} GROUP BY ALL)")
    out.append("scores AS (SELECT k, chain, sum(ll) AS loglik, 2*(k*47 + k - 1) - 2*sum(ll) AS aic, (k*47 + k - 1)*ln(count(*)) - 2*sum(ll) AS bic FROM fl GROUP BY k, chain)")
    return ", ".join(out)


_SCORES = _fits_sql()


def _fits(t):
    """(counts, genes, models, scores) of the same fits."""
    n, genes = _cell_counts(t)
    n = stored(n)
    starts: dict = {}
    for r in t.starts.orderBy("k", "chain", "celltype", "gene_id").collect():  # numbers of types x chains x types x genes
        starts.setdefault((r["k"], r["chain"]), {}).setdefault(r["celltype"], []).append(r["prob"])
    models = {key: typefit.Model(np.array([p[c] for c in sorted(p)]), np.full(len(p), 1 / len(p))) for key, p in starts.items()}
    models = typefit.fit(typefit.packed(n), genes.count(), models, FIT_STEPS, 0.0)
    return n, genes, models, typefit.scores(t.spark, models)


@query(f"WITH {_SCORES} SELECT k, chain, round(loglik, 3) AS loglik, round(aic, 3) AS aic, round(bic, 3) AS bic FROM scores")
def fit_scores(t):
    return _fits(t)[3].select("k", "chain", *[F.round(c, 3).alias(c) for c in ("loglik", "aic", "bic")])


@query(f"WITH {_SCORES} SELECT k, round(min(bic), 3) AS low, round(avg(bic), 3) AS mean, round(max(bic), 3) AS high, round(min(aic), 3) AS aic_low FROM scores GROUP BY k")
def score_ranges(t):
    return _fits(t)[3].groupBy("k").agg(*[F.round(f(c), 3).alias(n) for f, c, n in ((F.min, "bic", "low"), (F.avg, "bic", "mean"), (F.max, "bic", "high"), (F.min, "aic", "aic_low"))])


@query(f"WITH {_SCORES} SELECT chain, k, round(bic, 3) AS bic FROM scores ORDER BY round(scores.bic, 6), chain, k LIMIT 1")
def best_chain(t):
    return _fits(t)[3].orderBy(F.round("bic", 6), "chain", "k").limit(1).select("chain", "k", F.round("bic", 3).alias("bic"))


@query(None)
def job_fit_celltypes(t):
    """Cells of an area with enough transcripts, fitted for 2 to 4 types from two seeded starts each, to the tolerance."""
    n, genes = _cell_counts(t)
    inside = t.cell_metadata.where("x_centroid > 50 AND y_centroid > 50").select(F.col("cell_id").alias("cell"))
    return typefit.scores(t.spark, jobs.fit_celltypes(n, genes, inside, [2, 3, 4], 2, seed=1))


@query(f"WITH {_JOINED} SELECT round((2*sum(CASE WHEN label > 0 THEN foreground ELSE 0 END) + 1e-6)/(sum(foreground) + count(*) FILTER (label > 0) + 1e-6), 6) AS dice FROM j")
def dice(t):
    truth = F.when(F.col("label") > 0, 1.0).otherwise(0.0)
    return _judged(t).agg(r6(predictions.dice(F.col("foreground"), truth)).alias("dice"))


@query(f"""WITH {_JOINED}, c3 AS (SELECT unnest(generate_series(1, 3)) AS c),
per AS (SELECT tile_id, c, 2*count(*) FILTER (class = c AND k = c) AS i, count(*) FILTER (class = c) + count(*) FILTER (k = c) AS s FROM j CROSS JOIN c3 GROUP BY tile_id, c)
SELECT round(avg((i + 1e-6)/(CASE WHEN s = 0 THEN i ELSE s END + 1e-6)), 6) AS multiclass_dice FROM per""")
def multiclass_dice(t):
    out = predictions.multiclass_dice(_judged(t).withColumnRenamed("class", "truth"), ["tile_id"], 3)
    return out.select(r6(F.col("multiclass_dice")).alias("multiclass_dice"))


@query(f"WITH {_JOINED} SELECT round(1 - (2*sum(CASE WHEN label > 0 THEN foreground ELSE 0 END) + 1e-6)/(sum(foreground) + count(*) FILTER (label > 0) + 1e-6), 6) AS dice_loss FROM j")
def dice_loss(t):
    truth = F.when(F.col("label") > 0, 1.0).otherwise(0.0)
    return _judged(t).agg(r6(predictions.dice_loss(F.col("foreground"), truth)).alias("dice_loss"))


@query("SELECT cell_id, CAST(floor(CAST(row_number() OVER (ORDER BY x_centroid, y_centroid, cell_id) - 1 AS DOUBLE)/100) AS BIGINT) AS chunk FROM {cell_metadata}")
def chunk_by_position(t):
    return spatial.chunk_by_position(t.cell_metadata, "cell_id", "x_centroid", "y_centroid", 100)


@query(f"""WITH {_JOINED}, m AS (SELECT tile_id, (2*sum(CASE WHEN label > 0 THEN foreground ELSE 0 END) + 1e-6)/(sum(CASE WHEN label > 0 THEN foreground ELSE 0 END) + count(*) FILTER (label > 0) + 1e-6) AS f,
 1 - avg(sqrt(least((a-b)*(a-b), (a-b-1)*(a-b-1), (a-b+1)*(a-b+1)))) FILTER (label > 0) AS g, (2*count(*) FILTER (label > 0 AND class = k) + 1e-6)/(2*count(*) FILTER (label > 0) + 1e-6) AS c FROM j GROUP BY tile_id HAVING count(*) FILTER (label > 0) > 0)
SELECT round(avg(f), 6) AS foreground_accuracy, round(avg(g), 6) AS angle_accuracy, round(avg(c), 6) AS celltype_accuracy, round((avg(f) + avg(g) + avg(c))/3, 6) AS val_accuracy FROM m""")
def validation_summary(t):
    rows = _judged(t)
    names = ["foreground_accuracy", "angle_accuracy", "celltype_accuracy"]
    with_nucleus = rows.where("label > 0").select("tile_id").distinct()
    met = with_nucleus
    for name in names:
        met = met.join(getattr(predictions, name)(rows, ["tile_id"]), "tile_id")
    means = met.agg(*[F.avg(n).alias(n) for n in names])
    return means.select(*[r6(F.col(n)).alias(n) for n in names], r6(S.total([F.col(n) for n in names]) / 3).alias("val_accuracy"))


@query(f"""WITH {PX}, {_PROBS}, u AS (SELECT px.x, px.y, gene_id FROM px JOIN {{pixels}} p ON p.x = px.x AND p.y = px.y WHERE p.label = -1),
b AS (SELECT gene_id, count(*) AS n FROM px JOIN {{pixels}} USING (x, y) WHERE label = 0 GROUP BY gene_id), bf AS (SELECT gene_id, coalesce(CAST(n AS DOUBLE)/(SELECT sum(n) FROM b), 1e-10) AS bg FROM genes LEFT JOIN b USING (gene_id)),
c AS (SELECT class, count(*) AS pixels FROM {{pixels}} WHERE class > 0 GROUP BY class), s AS (SELECT class, gene_id, count(*) AS n FROM (SELECT DISTINCT x, y, gene_id FROM px) JOIN {{pixels}} USING (x, y) WHERE class > 0 GROUP BY ALL),
cf AS (SELECT g.gene_id, max(CASE WHEN c.class = 1 THEN coalesce(CAST(n AS DOUBLE)/pixels, 1e-10) END) AS f1, max(CASE WHEN c.class = 2 THEN coalesce(CAST(n AS DOUBLE)/pixels, 1e-10) END) AS f2, max(CASE WHEN c.class = 3 THEN coalesce(CAST(n AS DOUBLE)/pixels, 1e-10) END) AS f3 FROM c CROSS JOIN genes g LEFT JOIN s ON s.class = c.class AND s.gene_id = g.gene_id GROUP BY g.gene_id)
SELECT round(-avg(ln(foreground*(f1*p0 + f2*p1 + f3*p2) + (1 - foreground)*bg)), 6) AS loss, count(*) AS n FROM u JOIN soft USING (x, y) JOIN bf USING (gene_id) JOIN cf USING (gene_id)""")
def transcript_likelihood(t):
    px, genes = _encoded(t)
    open_ = px.join(t.pixels.where("label = -1").select("x", "y"), ["x", "y"], "left_semi")
    out = predictions.transcript_likelihood(open_, _soft(t), counts.class_frequencies(px, t.pixels, genes), counts.background(px, t.pixels, genes))
    return out.select(r6(F.col("loss")).alias("loss"), "n")


@query("WITH tr AS (SELECT l_orderkey % 997 AS segment_id, CAST(l_linenumber AS BIGINT) AS step, max(CAST(l_partkey * 31 % 97 AS DOUBLE)) AS gain FROM {lineitem} GROUP BY 1, 2) SELECT segment_id, step, gain FROM tr QUALIFY row_number() OVER (PARTITION BY segment_id ORDER BY gain DESC, step DESC) = 1")
def best_step(t):
    trace = t.lineitem.groupBy((F.col("l_orderkey") % 997).alias("segment_id"), F.col("l_linenumber").cast("long").alias("step")).agg(F.max((F.col("l_partkey") * 31 % 97).cast("double")).alias("gain"))
    return expand.best_step(trace)


@query(f"WITH {TILES} SELECT tile_id, x1, y1 FROM tiles")
def tile_index(t):
    """The number of a tile from its place: column times rows plus row."""
    xs, ys = grid.tile_starts(160, 64, 0.2), grid.tile_starts(t.size()[1], 64, 0.2)
    tiles = tiles_of(t)
    place = lambda c, starts: F.array_position(F.array(*[F.lit(s).cast("long") for s in starts]), F.col(c)) - 1
    return tiles.select((place("x1", xs) * len(ys) + place("y1", ys)).cast("long").alias("tile_id"), "x1", "y1")


@query("SELECT cell_id FROM {nuclei} ORDER BY cell_id * 7919 % 10007, cell_id LIMIT 100")
def sample_cells(t):
    return t.nuclei.orderBy(F.col("cell_id") * 7919 % 10007, "cell_id").limit(100).select("cell_id")


@query(f"WITH {TILES}, r AS (SELECT tile_id, row_number() OVER (ORDER BY tile_id * 7919 % 10007, tile_id) AS k FROM tiles) SELECT tile_id, CASE WHEN k <= greatest(CAST(floor((SELECT count(*) FROM tiles)*0.2E0) AS BIGINT), 1) THEN 'validation' ELSE 'train' END AS fold FROM r")
def split_train_val(t):
    tiles = tiles_of(t)
    n = max(int(tiles.count() * 0.2), 1)
    held = tiles.orderBy(F.col("tile_id") * 7919 % 10007, "tile_id").limit(n).select("tile_id", F.lit("validation").alias("fold"))
    return tiles.select("tile_id").join(held, "tile_id", "left").select("tile_id", F.coalesce("fold", F.lit("train")).alias("fold"))


_TILE_LABELS = f"{TILES}, tl AS (SELECT DISTINCT tile_id, label FROM {{pixels}} JOIN tiles ON x >= x1 AND x < x2 AND y >= y1 AND y < y2 WHERE label > 0)"


def _tile_labels(t):
    return grid.points_to_tiles(t.pixels.where("label > 0").select("x", "y", "label"), tiles_of(t), 64).select("tile_id", "label").distinct()


@query(f"WITH {_TILE_LABELS} SELECT tile_id, label FROM (SELECT *, row_number() OVER (PARTITION BY tile_id ORDER BY label * 7919 % 10007, label) AS k, count(*) OVER (PARTITION BY tile_id) AS n FROM tl) WHERE k <= greatest(floor(n*0.3E0), 1)")
def reveal_prior_segments(t):
    w = W.partitionBy("tile_id")
    ranked = _tile_labels(t).withColumn("k", F.row_number().over(w.orderBy(F.col("label") * 7919 % 10007, "label"))).withColumn("n", F.count("*").over(w))
    return ranked.where(F.col("k") <= F.greatest(F.floor(F.col("n") * 0.3), F.lit(1))).select("tile_id", "label")


@query(f"WITH {_TILE_LABELS}, c AS (SELECT tile_id, count(*) AS nuclei FROM tl GROUP BY tile_id), m AS (SELECT nuclei AS m FROM c QUALIFY row_number() OVER (ORDER BY nuclei, tile_id) - 1 = CAST(floor(count(*) OVER ()/2) AS BIGINT)) SELECT min(tile_id) AS tile_id, max(nuclei) AS nuclei FROM c JOIN m ON nuclei = m")
def select_roi(t):
    return counts.upper_median_tile(_tile_labels(t).groupBy("tile_id").agg(F.count("*").alias("nuclei")), "nuclei")


# --- set operations --------------------------------------------------------------------------------------------------------------


@query("SELECT cell_id, cx, NULL AS method FROM {nuclei} UNION ALL SELECT cell_id, NULL, segmentation_method FROM {cell_metadata}")
def concat_outer(t):
    return t.nuclei.select("cell_id", "cx").unionByName(t.cell_metadata.select("cell_id", F.col("segmentation_method").alias("method")), allowMissingColumns=True)


@query(f"WITH {TILES} SELECT DISTINCT tile_id FROM {{pixels}} JOIN tiles ON x >= x1 AND x < x2 AND y >= y1 AND y < y2 WHERE label > 0 INTERSECT SELECT DISTINCT tile_id FROM {{tx}} JOIN tiles ON x_location >= x1 AND x_location < x2 AND y_location >= y1 AND y_location < y2 WHERE qv >= 45")
def common_tiles(t):
    a = grid.points_to_tiles(t.pixels.where("label > 0"), tiles_of(t), 64).select("tile_id")
    b = grid.points_to_tiles(t.tx.where("qv >= 45"), tiles_of(t), 64, "x_location", "y_location").select("tile_id")
    return a.intersect(b)


@query("SELECT CAST(floor(x_location) AS BIGINT) AS x, CAST(floor(y_location) AS BIGINT) AS y, min(transcript_id) AS transcript_id FROM {tx} GROUP BY 1, 2")
def distinct_rows(t):
    return t.tx.groupBy(F.floor("x_location").alias("x"), F.floor("y_location").alias("y")).agg(F.min("transcript_id").alias("transcript_id"))


@query(f"WITH {_J}, ga AS (SELECT truth_id, list(DISTINCT feature_name) AS g FROM ta JOIN {{tx}} USING (transcript_id) GROUP BY 1), gb AS (SELECT segment_id, list(DISTINCT feature_name) AS g FROM mb JOIN {{tx}} USING (transcript_id) GROUP BY 1) SELECT b.truth_id, b.segment_id, len(list_intersect(ga.g, gb.g)) AS both, len(list_distinct(list_concat(ga.g, gb.g))) AS either FROM best b JOIN ga USING (truth_id) JOIN gb USING (segment_id)")
def transcript_sets(t):
    truth, method, best = _memberships(t)
    names = t.tx.select("transcript_id", "feature_name")
    a = truth.join(names, "transcript_id").groupBy("truth_id").agg(F.collect_set("feature_name").alias("ga"))  # at most all genes
    b = method.join(names, "transcript_id").groupBy("segment_id").agg(F.collect_set("feature_name").alias("gb"))
    met = best.select("truth_id", "segment_id").join(a, "truth_id").join(b, "segment_id")
    return met.select("truth_id", "segment_id", F.size(F.array_intersect("ga", "gb")).cast("long").alias("both"), F.size(F.array_union("ga", "gb")).cast("long").alias("either"))


# --- cell types with noise, rasters, jobs -----------------------------------------------------------------------------------------


@query(f"""WITH {CELL_COUNTS}, tot AS (SELECT cell, sum(n) AS total FROM cnt GROUP BY cell), sh AS (SELECT avg(CASE WHEN total < 3 THEN 1.0E0 ELSE 0 END) AS share FROM tot),
pr AS (SELECT 0 AS celltype, gene_id, 1.0E0/(SELECT count(*) FROM genes) AS prob FROM genes UNION ALL SELECT celltype + 1, gene_id, prob FROM {{init_profiles}}),
jn AS (SELECT cell, celltype, sum(n*ln(prob)) + ln(CASE WHEN celltype = 0 THEN max(share) ELSE (1 - max(share))/3 END) AS j FROM cnt JOIN pr USING (gene_id) CROSS JOIN sh GROUP BY cell, celltype)
SELECT cell, CAST(celltype AS INTEGER) AS celltype, round(exp(j - mj)/sum(exp(j - mj)) OVER (PARTITION BY cell), 6) AS p FROM (SELECT *, max(j) OVER (PARTITION BY cell) AS mj FROM jn)""")
def predict_celltypes_noise(t):
    n, genes = _cell_counts(t)
    totals = n.groupBy("cell").agg(F.sum("n").alias("total"))
    profiles, priors = celltypes.with_noise(*_start(t), totals, genes, 3)
    return celltypes.posterior(n, profiles, priors).select("cell", "celltype", r6(F.col("p")).alias("p"))


@query("SELECT x, y, CASE WHEN label > 0 THEN CASE WHEN (label - 1) % 3 = 0 THEN 1 ELSE 2 END ELSE 0 END AS class FROM {pixels}")
def class_labels(t):
    types = t.nuclei.select((F.col("cell_id") + 1).alias("label"), F.when(F.col("cell_id") % 3 == 0, 1).otherwise(2).alias("class"))
    return t.pixels.select("x", "y", "label").join(types, "label", "left").select("x", "y", F.coalesce("class", F.lit(0)).alias("class"))


def _labelled(t):
    pts = t.pixels.select("x", "y", (F.col("x") + 0.5).alias("px"), (F.col("y") + 0.5).alias("py"))
    near = spatial.nearest_polygon(t.polygons("nucleus_vertices", "cell_id"), pts, "cell_id", ["x", "y"], "px", "py", 4.0)
    return counts.label_rule(near.select("x", "y", (F.col("cell_id") + 1).alias("label"), "distance"), spatial.dense_near(t.pixels, t.tx, 5, 4, "x_location", "y_location"), 1.0, 3.0)


_NEAR = f"""{NUCLEUS}, pts AS (SELECT x*100000 + y AS pt, x, y, x + 0.5E0 AS cx, y + 0.5E0 AS cy FROM {{pixels}}), {inside_sql('pts', 'pt', 'cx', 'cy')},
near AS (SELECT b.id, pt, cx AS px, cy AS py FROM pts JOIN box b ON cx BETWEEN xmin - 4 AND xmax + 4 AND cy BETWEEN ymin - 4 AND ymax + 4),
dd AS (SELECT n.id, n.pt, CASE WHEN max(h.id) IS NOT NULL THEN 0 ELSE sqrt(min((x1 + {_DIST}*(x2-x1) - px)*(x1 + {_DIST}*(x2-x1) - px) + (y1 + {_DIST}*(y2-y1) - py)*(y1 + {_DIST}*(y2-y1) - py))) END AS dist FROM near n JOIN edges e ON e.id = n.id LEFT JOIN hit h ON h.id = n.id AND h.pt = n.pt GROUP BY n.id, n.pt),
f AS (SELECT pt, arg_min(id, (dist, id)) AS cell_id, min(dist) AS dist FROM dd WHERE dist <= 4 GROUP BY pt),
cc AS (SELECT CAST(floor(x_location) AS BIGINT) AS x, CAST(floor(y_location) AS BIGINT) AS y, count(*) AS n FROM {{tx}} GROUP BY 1, 2),
oo AS (SELECT i, j FROM (SELECT unnest(generate_series(-4, 4)) AS i) CROSS JOIN (SELECT unnest(generate_series(-4, 4)) AS j) WHERE i*i + j*j < 16),
dn AS (SELECT x + i AS x, y + j AS y FROM cc CROSS JOIN oo GROUP BY 1, 2 HAVING sum(n) >= 5)"""


@query(f"WITH {_NEAR} SELECT pts.x, pts.y, CASE WHEN dist <= 1 THEN cell_id + 1 WHEN (dist IS NULL OR dist > 3) AND dn.x IS NULL THEN 0 ELSE -1 END AS label FROM pts LEFT JOIN f USING (pt) LEFT JOIN dn ON dn.x = pts.x AND dn.y = pts.y")
def label_pixels(t):
    return _labelled(t)


@query(f"WITH {PX}, {TILES} SELECT tile_id, count(*) AS n, CAST(sum((x - x1) * (gene_id + 1) + (y - y1)) AS BIGINT) AS mark FROM px JOIN tiles ON x >= x1 AND x < x2 AND y >= y1 AND y < y2 GROUP BY tile_id")
def tile_batches(t):
    px, _ = _encoded(t)
    batches = counts.tile_batches(px, tiles_of(t), 64)
    mark = F.aggregate("transcripts", F.lit(0).cast("long"), lambda a, r: a + r["x"] * (r["gene_id"] + 1) + r["y"])
    return batches.select("tile_id", F.size("transcripts").cast("long").alias("n"), mark.alias("mark"))


@query(None)
def flow_components(t):
    return expand.flow_components(_with_pred(t).select("x", "y", "angle", "foreground"), *t.size(), 20)


@query(None)
def cull_empty_pixels(t):
    grown = expand.greedy_expansion(_with_pred(t), *t.size(), expand.STEPS)
    tx = t.tx.select(F.floor("x_location").alias("x"), F.floor("y_location").alias("y"))
    return expand.cull_empty_pixels(grown, tx, t.pixels.where("label > 0").select("x", "y"))


_NOISY = """tot AS (SELECT cell, sum(n) AS total FROM cnt GROUP BY cell), sh AS (SELECT avg(CASE WHEN total < 3 THEN 1.0E0 ELSE 0 END) AS share FROM tot),
pr AS (SELECT 0 AS celltype, gene_id, 1.0E0/(SELECT count(*) FROM genes) AS prob FROM genes UNION ALL SELECT celltype + 1, gene_id, prob FROM {init_profiles}),
jz AS (SELECT cell, celltype, sum(n*ln(prob)) + ln(CASE WHEN celltype = 0 THEN max(share) ELSE (1 - max(share))/3 END) AS j FROM cnt JOIN pr USING (gene_id) CROSS JOIN sh GROUP BY cell, celltype),
pz AS (SELECT cell, celltype, exp(j - mj)/sum(exp(j - mj)) OVER (PARTITION BY cell) AS p FROM (SELECT *, max(j) OVER (PARTITION BY cell) AS mj FROM jz)),
hz AS (SELECT cell, arg_min(celltype, (-round(p, 9), celltype)) AS celltype FROM pz GROUP BY cell),
cz AS (SELECT cell, celltype, sx/(3*a) AS zx, sy/(3*a) AS zy FROM hz JOIN (SELECT cell_id AS id, sum(c) AS a, sum(ax*c) AS sx, sum(ay*c) AS sy FROM (SELECT cell_id, x1*y2 - x2*y1 AS c, x1 + x2 AS ax, y1 + y2 AS ay FROM (SELECT cell_id, vertex_x AS x1, vertex_y AS y1,
 coalesce(lead(vertex_x) OVER w, first_value(vertex_x) OVER w) AS x2, coalesce(lead(vertex_y) OVER w, first_value(vertex_y) OVER w) AS y2 FROM {nucleus_vertices} WINDOW w AS (PARTITION BY cell_id ORDER BY k))) GROUP BY cell_id) g ON g.id = hz.cell),
kz AS (SELECT n.cell_id, arg_min(celltype, (round(sqrt((zx - cx)*(zx - cx) + (zy - cy)*(zy - cy)), 9), cell)) AS class FROM {nuclei} n CROSS JOIN cz GROUP BY n.cell_id)"""


@query(f"WITH nt AS (SELECT * FROM (WITH {CELL_COUNTS}, {_NOISY} SELECT cell_id, class FROM kz)), {_NEAR}, lb AS (SELECT pts.x, pts.y, CASE WHEN dist <= 1 THEN cell_id + 1 WHEN (dist IS NULL OR dist > 3) AND dn.x IS NULL THEN 0 ELSE -1 END AS label FROM pts LEFT JOIN f USING (pt) LEFT JOIN dn ON dn.x = pts.x AND dn.y = pts.y), ct AS (SELECT label, avg(x) AS mx, avg(y) AS my FROM lb WHERE label > 0 GROUP BY label) SELECT lb.x, lb.y, lb.label, CASE WHEN lb.label > 0 THEN CAST(class AS INTEGER) ELSE 0 END AS class, round((atan2(my - lb.y, mx - lb.x) + {math.pi!r})/{2 * math.pi!r}, 6) AS angle FROM lb LEFT JOIN ct ON ct.label = lb.label LEFT JOIN nt ON nt.cell_id = lb.label - 1")
def job_preprocess(t):
    """Labels, angles to the centroid and classes of all pixels; a nucleus has the type of the nearest cell that was typed, 0 for noise."""
    labels = stored(_labelled(t))
    n, genes = _cell_counts(t)
    n = stored(n)
    profiles, priors = celltypes.with_noise(*_start(t), n.groupBy("cell").agg(F.sum("n").alias("total")), genes, 3)
    typed = celltypes.hard_types(celltypes.posterior(n, profiles, priors)).select("cell", "celltype")
    cx, cy = S.ring_centroid(F.col("ring"))
    sites = t.polygons("nucleus_vertices", "cell_id").select(F.col("cell_id").alias("cell"), cx.alias("sx"), cy.alias("sy")).join(typed, "cell")
    points = t.nuclei.select((F.col("cell_id") + 1).alias("label"), F.col("cx").cast("double").alias("x"), F.col("cy").cast("double").alias("y"))
    near = spatial.nearest_points(sites.select(F.struct("cell", "celltype").alias("site"), "sx", "sy"), points, "label").select("label", F.col("site.celltype").cast("int").alias("class"))
    inside = counts.angles_to_centroid(labels).join(near, "label", "left").select("x", "y", "label", "class", r6(F.col("angle")).alias("angle"))
    # the labels of what is outside are hot keys, so these pixels take no part in joins
    outside = labels.where("label IS NULL OR label <= 0").select("x", "y", "label", F.lit(0).alias("class"), F.lit(None).cast("double").alias("angle"))
    return inside.unionByName(outside)


@query(f"WITH ow AS ({'WITH ' + _owner_sql('method_vertices', 'segment_id', SLIDE_TILES)}) SELECT tile_id, segment_id, row_number() OVER (ORDER BY tile_id, segment_id) - 1 AS global_id FROM ow")
def job_combine(t):
    """Outlines that every tile gives, in its own coordinates and numbers, put together: a segment that several tiles saw stays with the tile
    whose centre is nearest to it; then segments are numbered over all tiles."""
    tiles, rings = slide_tiles_of(t), t.polygons("method_vertices", "segment_id")
    b = S.ring_bounds(F.col("ring"))
    cell = lambda c: F.floor(c / 64)
    cover = lambda lo, hi: F.explode(F.sequence(cell(F.col(lo)), cell(F.col(hi) - 1)))
    placed = tiles.withColumn("_gx", cover("x1", "x2")).withColumn("_gy", cover("y1", "y2"))
    boxed = rings.select("segment_id", "ring", *[c.alias(f"_{n}") for n, c in b.items()]).withColumn("_gx", F.explode(F.sequence(cell(F.col("_xmin")), cell(F.col("_xmax"))))).withColumn("_gy", F.explode(F.sequence(cell(F.col("_ymin")), cell(F.col("_ymax")))))
    seen = boxed.join(placed, ["_gx", "_gy"]).where("_xmin < x2 AND _xmax > x1 AND _ymin < y2 AND _ymax > y1").dropDuplicates(["tile_id", "segment_id"])
    local = F.transform("ring", lambda q: F.struct((q["x"] - F.col("x1")).alias("x"), (q["y"] - F.col("y1")).alias("y")))
    results = stored(seen.select("tile_id", F.col("segment_id").alias("local_id"), local.alias("ring")))
    return jobs.combined(results, tiles).select("tile_id", F.col("local_id").alias("segment_id"), "global_id")


@query("WITH s AS (SELECT 'ours' AS method, p.label, i.intensity FROM {pixels} p JOIN {image} i USING (x, y) WHERE p.label > 0 UNION ALL SELECT 'shifted', p.label, i.intensity FROM {pixels} p JOIN {image} i ON i.x = p.x + 2 AND i.y = p.y WHERE p.label > 0) SELECT method, label, round(avg(intensity), 6) AS mean_intensity, count(*) AS size FROM s GROUP BY ALL")
def job_if_benchmark(t):
    """Mean image intensity of the segments of two masks."""
    masks = {"ours": t.pixels, "shifted": t.pixels.withColumn("x", F.col("x") + 2)}
    parts = [m.where("label > 0").join(t.image, ["x", "y"]).groupBy("label").agg(r6(F.avg("intensity")).alias("mean_intensity"), F.count("*").alias("size")).withColumn("method", F.lit(k)) for k, m in masks.items()]
    return parts[0].unionByName(parts[1])


def _roi_sql() -> str:
    """roi, the tile of median nuclei, and what of segments (0), nuclei (1) and truth (2) lies in it."""
    roi = f"{_TILE_LABELS}, c AS (SELECT tile_id, count(*) AS nuclei FROM tl GROUP BY tile_id), m AS (SELECT nuclei AS m FROM c QUALIFY row_number() OVER (ORDER BY nuclei, tile_id) - 1 = CAST(floor(count(*) OVER ()/2) AS BIGINT)), roi AS (SELECT tiles.* FROM tiles WHERE tile_id = (SELECT min(tile_id) FROM c JOIN m ON nuclei = m))"
    sides = "SELECT 9 AS role, 0 AS id, unnest([x1, x2, x2, x1])::DOUBLE AS x1, unnest([y1, y1, y2, y2])::DOUBLE AS y1, unnest([x2, x2, x1, x1])::DOUBLE AS x2, unnest([y1, y2, y2, y1])::DOUBLE AS y2 FROM roi"
    return f"{roi}, {_clipped_sql((0, '{method_vertices}', 'segment_id'), (1, '{nucleus_vertices}', 'cell_id'), (2, '{truth_vertices}', 'cell_id'), box=sides)}"


@query(f"""WITH {_roi_sql()} SELECT CASE role WHEN 0 THEN 'segments' WHEN 1 THEN 'nuclei' ELSE 'truth' END AS layer, count(*) AS n, round(sum(area), 4) AS size FROM in_area GROUP BY 1
UNION ALL SELECT 'pixels', count(*), CAST(count(*) FILTER (label > 0) AS DOUBLE) FROM {{pixels}} JOIN roi ON x >= x1 AND x < x2 AND y >= y1 AND y < y2
UNION ALL SELECT 'predictions', count(*), CAST(count(*) FILTER (foreground >= 0.5E0) AS DOUBLE) FROM {{pred}} JOIN roi ON x >= x1 AND x < x2 AND y >= y1 AND y < y2
UNION ALL SELECT 'transcripts', count(*), CAST(count(DISTINCT feature_name) AS DOUBLE) FROM {{tx}} JOIN roi ON {IN_TILE}""")
def job_roi_layers(t):
    """Six layers restricted to the region of interest: outlines clipped to it, with the area that is left, pixels with those labelled, predictions
    with those of foreground, and transcripts with their genes."""
    roi = counts.upper_median_tile(_tile_labels(t).groupBy("tile_id").agg(F.count("*").alias("nuclei")), "nuclei").select("tile_id")
    tile = tiles_of(t).join(roi, "tile_id")
    box = tile.first()  # one tile
    layers = []
    for name, table, key in (("segments", "method_vertices", "segment_id"), ("nuclei", "nucleus_vertices", "cell_id"), ("truth", "truth_vertices", "cell_id")):
        area = overlay.clipped(t.polygons(table, key), box["x1"], box["y1"], box["x2"], box["y2"]).select(S.ring_area(F.col("ring")).alias("a")).where("a > 1e-9")
        layers.append(area.agg(F.count("*").alias("n"), (F.round(F.coalesce(F.sum("a"), F.lit(0.0)), 4) + 0.0).alias("size")).where("n > 0").withColumn("layer", F.lit(name)))
    of = lambda rows, name, size, x="x", y="y": grid.points_to_tiles(rows, tile, 64, x, y).agg(F.count("*").alias("n"), size.cast("double").alias("size")).withColumn("layer", F.lit(name))
    layers.append(of(t.pixels.select("x", "y", "label"), "pixels", F.count(F.when(F.col("label") > 0, 1))))
    layers.append(of(t.pred.select("x", "y", "foreground"), "predictions", F.count(F.when(F.col("foreground") >= 0.5, 1))))
    layers.append(of(t.tx.select("x_location", "y_location", "feature_name"), "transcripts", F.count_distinct("feature_name"), "x_location", "y_location"))
    out = layers[0]
    for more in layers[1:]:
        out = out.unionByName(more)
    return out.select("layer", "n", "size")


@query(f"WITH {_clipped_sql((0, '{truth_vertices}', 'cell_id'), (1, '{method_vertices}', 'segment_id'))} SELECT CASE WHEN role = 1 THEN 'method' ELSE segmentation_method END AS layer, count(*) AS n, round(sum(area), 4) AS area FROM in_area LEFT JOIN {{cell_metadata}} c ON role = 0 AND c.cell_id = in_area.id GROUP BY 1")
def job_comparison_layers(t):
    """Truth polygons by the method of their cell beside another method's polygons, clipped to the area that is compared."""
    truth = t.polygons("truth_vertices", "cell_id").join(t.cell_metadata.select("cell_id", F.col("segmentation_method").alias("layer")), "cell_id").select("layer", "ring")
    other = t.polygons("method_vertices", "segment_id").select(F.lit("method").alias("layer"), "ring")
    inside = overlay.clipped(truth.unionByName(other), 100.0, 50.0, 500.0, 600.0).select("layer", S.ring_area(F.col("ring")).alias("area")).where("area > 1e-9")
    return inside.groupBy("layer").agg(F.count("*").alias("n"), (F.round(F.sum("area"), 4) + 0.0).alias("area"))


@query(f"WITH {SLIDE_TILES}, a AS (SELECT tile_id, count(*) AS transcripts FROM {{tx}} JOIN tiles ON {IN_TILE} GROUP BY tile_id), b AS (SELECT tile_id, count(DISTINCT cell_id) AS nuclei FROM {{nucleus_vertices}} JOIN tiles ON vertex_x >= x1 AND vertex_x < x2 AND vertex_y >= y1 AND vertex_y < y2 GROUP BY tile_id) SELECT tile_id, transcripts, coalesce(nuclei, 0) AS nuclei FROM a LEFT JOIN b USING (tile_id)")
def job_tile_slide(t):
    """Transcripts and nuclei of the whole slide, written a folder a tile and read again."""
    path, tiles = scratch(t.spark), slide_tiles_of(t)
    io.write_transcript_tiles(t.tx.select("transcript_id", "x_location", "y_location"), tiles, f"{path}/transcripts", 64)
    io.write_transcript_tiles(t.nucleus_vertices.select("cell_id", F.col("vertex_x").alias("x_location"), F.col("vertex_y").alias("y_location")), tiles, f"{path}/nuclei", 64)
    tx, nuclei = (t.spark.read.parquet(f"{path}/{n}").groupBy(F.col("tile_id").cast("long").alias("tile_id")) for n in ("transcripts", "nuclei"))
    return tx.agg(F.count("*").alias("transcripts")).join(nuclei.agg(F.count_distinct("cell_id").alias("nuclei")), "tile_id", "left").fillna(0, ["nuclei"])


@query(None)
def job_segment(t):
    """Grow segments, outline them, count their genes and type them: the outline of most area, how many rings there are, transcripts, the type
    and its probability."""
    labels = expand.greedy_expansion(_with_pred(t), *t.size(), expand.STEPS)
    segments = stored(labels.where("label > 0").select("x", "y", F.col("label").alias("segment_id")))
    rings = shapes.chained(shapes.boundary_edges(segments))
    outer = rings.groupBy("segment_id").agg(F.count("*").alias("rings"), F.max_by("points", S.ring_area_signed(F.col("points"))).alias("outline"))
    px, _ = _encoded(t)
    n = counts.gene_counts(px.join(segments, ["x", "y"]), "segment_id").withColumnRenamed("segment_id", "cell")
    totals = n.groupBy(F.col("cell").alias("segment_id")).agg(F.sum("n").alias("transcripts"))
    types = celltypes.hard_types(celltypes.posterior(n, *_start(t))).select(F.col("cell").alias("segment_id"), "celltype", r6(F.col("p")).alias("p"))
    return shapes.pixel_areas(segments).join(outer, "segment_id").join(totals, "segment_id", "left").join(types, "segment_id", "left")


_SMOOTH = """ct AS (SELECT x, y, count(*) AS n FROM px GROUP BY x, y), tp AS (SELECT tile_id, p.x, p.y, x1, y1, x2, y2 FROM {pixels} p JOIN tiles ON p.x >= x1 AND p.x < x2 AND p.y >= y1 AND p.y < y2),
nb AS (SELECT i, j, (2 - abs(i))*(2 - abs(j))/16.0E0 AS k FROM (SELECT unnest([-1, 0, 1]) AS i) CROSS JOIN (SELECT unnest([-1, 0, 1]) AS j)),
sm AS (SELECT tile_id, tp.x, tp.y, any_value(x1) AS x1, any_value(y1) AS y1, sum(k*coalesce(n, 0)) AS s FROM tp CROSS JOIN nb LEFT JOIN ct ON ct.x = tp.x + i AND ct.y = tp.y + j AND tp.x + i >= x1 AND tp.x + i < x2 AND tp.y + j >= y1 AND tp.y + j < y2 GROUP BY tile_id, tp.x, tp.y)"""

#: A binomial filter over neighbouring pixels; outside of a tile there is nothing.
FILTER = [[1 / 16, 2 / 16, 1 / 16], [2 / 16, 4 / 16, 2 / 16], [1 / 16, 2 / 16, 1 / 16]]


def filtered(batch: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """A scorer: tiles (n, side, side, channels) filtered by weights (3, 3), zeros beyond their edges."""
    wide = np.pad(batch, ((0, 0), (1, 1), (1, 1), (0, 0)))
    side = batch.shape[1]
    return sum(weights[i, j] * wide[:, i : i + side, j : j + side] for i in range(3) for j in range(3))


def _tile_scores(t):
    px, _ = _encoded(t)
    counted = px.groupBy("x", "y").agg(F.count("*").cast("double").alias("n"))
    return predictions.score_tiles(counted, tiles_of(t), 64, ["n"], filtered, np.array(FILTER), ["score"])


@query(f"WITH {PX}, {TILES}, {_SMOOTH} SELECT tile_id, x, y, round(s, 6) AS score FROM sm WHERE s > 0")
def score_tiles(t):
    """A user's function with weights over batches of whole tiles: transcripts a pixel, smoothed."""
    out = _tile_scores(t).where("score > 0").join(t.pixels.select("x", "y"), ["x", "y"], "left_semi")
    return out.select("tile_id", "x", "y", r6(F.col("score")).alias("score"))
