"""Scans and sinks of transcripts, boundary vertices, polygons and tiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellweave.functions import scalars as S
from cellweave.operators import grid

TRANSCRIPT_COLUMNS = ["transcript_id", "feature_name", "x_location", "y_location", "qv", "cell_id", "overlaps_nucleus"]


def scan_transcripts(tx: DataFrame, area: tuple[float, float, float, float] | None = None) -> DataFrame:
    """The transcript columns, within an area open at its low and closed at its high sides; the filter reaches the scan."""
    if area:
        x0, y0, x1, y1 = area
        tx = tx.where((F.col("x_location") > x0) & (F.col("y_location") > y0) & (F.col("x_location") <= x1) & (F.col("y_location") <= y1))
    return tx.select(TRANSCRIPT_COLUMNS)


def scan_boundaries(vertices: DataFrame, area: tuple[float, float, float, float], tolerance: float = 100.0) -> DataFrame:
    x0, y0, x1, y1 = area
    return vertices.where((F.col("vertex_x") > x0 - tolerance) & (F.col("vertex_y") > y0 - tolerance) & (F.col("vertex_x") <= x1 + tolerance) & (F.col("vertex_y") <= y1 + tolerance))


def assemble_polygons(vertices: DataFrame, id_col: str) -> DataFrame:
    """Rows (id_col, ring) of ids with more than two vertices, in the order of k."""
    ring = F.transform(F.sort_array(F.collect_list(F.struct("k", F.col("vertex_x").alias("x"), F.col("vertex_y").alias("y")))), lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y")))
    return vertices.groupBy(id_col).agg(ring.alias("ring")).where(F.size("ring") > 2)


def slide_extent(tx: DataFrame) -> DataFrame:
    return tx.agg(F.ceil(F.max("x_location")).alias("width"), F.ceil(F.max("y_location")).alias("height"))


def polygon_json(polygons: DataFrame, id_col: str, *more: str) -> DataFrame:
    """One row: the polygon collection that external segmenters write. more: columns that stand beside the geometry, such as its tile."""
    shape = F.struct(F.array(F.transform("ring", lambda p: F.array(p["x"], p["y"]))).alias("coordinates"), F.lit("Polygon").alias("type"), F.col(id_col).alias("cell"))
    return polygons.select(*more, shape.alias("geometry"))


def scan_polygon_json(spark: SparkSession, path: str, more: str = "") -> DataFrame:
    """Rows (cell, ring) of a polygon collection, one geometry a line; rings of three points or fewer are left out. more: the schema of columns beside
    the geometry, which come first."""
    rows = spark.read.schema(f"{more}{', ' * bool(more)}geometry struct<coordinates:array<array<array<double>>>,type:string,cell:bigint>").json(path)
    ring = F.transform(F.col("geometry.coordinates")[0], lambda p: F.struct(p[0].alias("x"), p[1].alias("y")))
    return rows.select(*rows.columns[:-1], F.col("geometry.cell").alias("cell"), ring.alias("ring")).where(F.size("ring") > 3)


def scan_assignment_csv(spark: SparkSession, path: str) -> DataFrame:
    """Rows (transcript_id, cell_id, cluster) of a segmenter's transcript table; cell is a name that ends in -<number>."""
    rows = spark.read.option("header", True).schema("transcript_id bigint, cell string, cluster int").csv(path)
    return rows.select("transcript_id", F.substring_index("cell", "-", -1).cast("long").alias("cell_id"), "cluster")


TILES_A_PART = 128  # tiles that one task writes; their files, not their rows, are what takes time


def by_tile(points: DataFrame, tiles: DataFrame, size: int, x: str, y: str) -> DataFrame:
    """points_to_tiles with the rows of a tile in one task, to be written a folder a tile. Few rows would be put in few tasks, so their number is given."""
    return grid.points_to_tiles(points, tiles, size, x, y).repartition(max(-(-tiles.count() // TILES_A_PART), 1), "tile_id")


def write_transcript_tiles(tx: DataFrame, tiles: DataFrame, path: str, size: int, fmt: str = "parquet") -> None:
    """One folder a tile; a point in the overlap of tiles goes to each."""
    by_tile(tx, tiles, size, "x_location", "y_location").write.partitionBy("tile_id").format(fmt).save(path)


def tile_id_of_path(path=None):
    return F.regexp_extract(path if path is not None else F.col("_metadata.file_path"), r"tile_(?:id=)?(\d+)", 1).cast("int")


def load_nuclei(vertices: DataFrame, area: tuple[float, float, float, float]) -> DataFrame:
    """Polygons wholly inside the area with nucleus_label 1..n in order of cell_id and their centroid."""
    x0, y0, x1, y1 = area
    rings = assemble_polygons(vertices, "cell_id")
    b = S.ring_bounds(F.col("ring"))
    inside = rings.where((b["xmin"] >= x0) & (b["ymin"] >= y0) & (b["xmax"] <= x1) & (b["ymax"] <= y1))
    cx, cy = S.ring_centroid(F.col("ring"))
    return grid.numbered(inside, "cell_id", "nucleus_label", 1).select("cell_id", "nucleus_label", "ring", cx.alias("cx"), cy.alias("cy"))


BASE_TILE = 64


def write_grid(pixels: DataFrame, path: str) -> None:
    """A pixel table laid out by base tile, so that reading one area prunes to its folders. A folder's rows are brought together, so that it
    gets a file and not one a task."""
    at = lambda c: F.floor(F.col(c) / BASE_TILE).cast("int")
    placed = pixels.withColumn("bx", at("x")).withColumn("by", at("y"))
    placed.hint("rebalance", "bx", "by").write.partitionBy("bx", "by").parquet(path)


def read_grid(spark: SparkSession, path: str, x1: int, y1: int, x2: int, y2: int) -> DataFrame:
    """Pixels of the half-open box, in coordinates of its corner."""
    folders = F.col("bx").between(x1 // BASE_TILE, (x2 - 1) // BASE_TILE) & F.col("by").between(y1 // BASE_TILE, (y2 - 1) // BASE_TILE)
    inside = (F.col("x") >= x1) & (F.col("x") < x2) & (F.col("y") >= y1) & (F.col("y") < y2)
    rows = spark.read.parquet(path).where(folders & inside).drop("bx", "by")
    return rows.withColumn("x", F.col("x") - x1).withColumn("y", F.col("y") - y1)
