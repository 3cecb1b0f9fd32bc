"""Pixels, tiles and dictionaries."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from cellweave.sources.scratch import stored


def dictionary(df: DataFrame, key: str, name: str, first: int = 0) -> DataFrame:
    """Rows (key, name): the distinct keys numbered first, first + 1, ... in their order.

    Keys are range-partitioned, each range is ranked on its own and shifted by the sizes of the ranges before it, so no task holds
    all keys and no bucket is hot, whatever the keys look like. Only one row a range is gathered."""
    keys = stored(df.select(key).where(F.col(key).isNotNull()).distinct().repartitionByRange(key).withColumn("_b", F.spark_partition_id()))
    before = keys.groupBy("_b").agg(F.count("*").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(W.orderBy("_b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    rank = F.row_number().over(W.partitionBy("_b").orderBy(key)) + F.col("_before") - 1 + first
    return keys.join(before, "_b").select(key, rank.cast("long").alias(name))


def numbered(df: DataFrame, key: str, name: str, first: int = 0) -> DataFrame:
    return df.join(dictionary(df, key, name, first), key)


def pixel_grid(spark: SparkSession, width: int, height: int, resolution: float = 1.0) -> DataFrame:
    """Every pixel with its centre in slide units."""
    nx, ny = math.ceil(width / resolution), math.ceil(height / resolution)
    rows = spark.range(nx).select(F.col("id").alias("x"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(ny - 1).cast("long"))).alias("y"))
    return rows.select("x", "y", ((F.col("x") + 0.5) * resolution).alias("center_x"), ((F.col("y") + 0.5) * resolution).alias("center_y"))


def tile_starts(extent: int, size: int, overlap: float) -> list[int]:
    """Starts 0, stride, ... and a last tile flush with the end."""
    if size >= extent:
        return [0]
    stride = math.ceil(round(size * (1 - overlap), 9))
    return [*range(0, extent - size, stride), extent - size]


def tile_grid(spark: SparkSession, width: int, height: int, size: int, overlap: float) -> DataFrame:
    """Overlapping tiles, numbered x outer, y inner."""
    nx, ny = len(tile_starts(width, size, overlap)), len(tile_starts(height, size, overlap))
    stride = math.ceil(round(size * (1 - overlap), 9))
    start = lambda at, extent: F.least(at * stride, F.lit(max(extent - size, 0)).cast("long"))  # noqa: E731  tile_starts, of a row
    rows = spark.range(nx * ny).select(F.col("id").alias("tile_id"), start(F.expr(f"id div {ny}"), width).alias("x1"), start(F.col("id") % ny, height).alias("y1"))
    return rows.select("tile_id", "x1", "y1", (F.col("x1") + size).alias("x2"), (F.col("y1") + size).alias("y2"))


def tiles_for_bbox(tiles: DataFrame, x0: float, y0: float, x1: float, y1: float) -> DataFrame:
    return tiles.where((F.col("x1") <= x1) & (F.col("x2") >= x0) & (F.col("y1") <= y1) & (F.col("y2") >= y0))


def points_to_tiles(points: DataFrame, tiles: DataFrame, size: int, x: str = "x", y: str = "y") -> DataFrame:
    """Each point with each tile whose half-open box holds it: an equi-join on cells of a tile's size, then the exact test."""
    cover = lambda lo, hi: F.sequence(F.floor(F.col(lo) / size), F.floor((F.col(hi) - 1) / size))
    placed = tiles.withColumn("_gx", F.explode(cover("x1", "x2"))).withColumn("_gy", F.explode(cover("y1", "y2")))
    at = points.withColumn("_gx", F.floor(F.col(x) / size)).withColumn("_gy", F.floor(F.col(y) / size))
    inside = (F.col(x) >= F.col("x1")) & (F.col(x) < F.col("x2")) & (F.col(y) >= F.col("y1")) & (F.col(y) < F.col("y2"))
    return at.join(placed, ["_gx", "_gy"]).where(inside).drop("_gx", "_gy")


def split_tiles(tiles: DataFrame, jobs: int) -> DataFrame:
    """Contiguous near-equal ranges of tiles, the first ones larger. Tiles are numbered by ranges and not in one task."""
    placed = dictionary(tiles, "tile_id", "_at")
    n = placed.count()
    size, more = n // jobs, n % jobs  # the first `more` jobs have one tile more
    at, edge = F.col("_at"), more * (size + 1)
    job = F.when(at < edge, F.floor(at / (size + 1))).otherwise(more + F.floor((at - edge) / max(size, 1)))
    return placed.select("tile_id", job.cast("int").alias("job"))


def neighbour_edges(pixels: DataFrame, width: int, height: int) -> DataFrame:
    """Undirected edges to the right and to the upper neighbour."""
    right = pixels.where(F.col("x") < width - 1).select("x", "y", (F.col("x") + 1).alias("x2"), F.col("y").alias("y2"))
    up = pixels.where(F.col("y") < height - 1).select("x", "y", F.col("x").alias("x2"), (F.col("y") + 1).alias("y2"))
    return right.unionAll(up)


def shared_around(labels: DataFrame, of: DataFrame | None = None) -> DataFrame:
    """labels: x, y, label. Rows (x, y, shared) of the pixels of `of` (x, y; default all) whose four neighbours exist and share a label.

    Each pixel tells its neighbours its label, so pixels that lie together are folded before the one shuffle."""
    sides = F.array(*[F.struct((F.col("x") + i).alias("x"), (F.col("y") + j).alias("y")) for i, j in ((-1, 0), (1, 0), (0, -1), (0, 1))])
    told = labels.select(F.explode(sides).alias("_p"), "label").select("_p.x", "_p.y", "label", F.lit(0).alias("_of"))
    asked = (labels if of is None else of).select("x", "y", F.lit(None).cast(labels.schema["label"].dataType).alias("label"), F.lit(1).alias("_of"))
    four = told.unionByName(asked).groupBy("x", "y").agg(F.count("label").alias("_n"), F.min("label").alias("shared"), F.max("label").alias("_hi"), F.max("_of").alias("_of"))
    return four.where("_of = 1 AND _n = 4 AND shared = _hi").select("x", "y", "shared")
