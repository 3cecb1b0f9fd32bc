"""Model predictions a pixel: stitching of tiles, and quality metrics."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellweave.functions import scalars as S
from cellweave.operators import grid

EPS = 1e-6
TILES_AT_ONCE = 32


def ramp(at: Column, size: int, border: float) -> Column:
    """Blend weight along one side of a tile: rising over the border, 1 inside."""
    from_edge = F.least(at + 0.5, F.lit(float(size)) - at - 0.5)
    return F.least(F.lit(1.0), from_edge / F.lit(max(border, 0.5)))


def _scored(size: int, channels: int, score: Callable, shared, k: int):
    def run(batches):
        model = shared.value
        for b in batches:
            for lo in range(0, b.num_rows, TILES_AT_ONCE):
                part = b.slice(lo, TILES_AT_ONCE)
                n, lists = part.num_rows, part.column("cells")
                sizes, cells = lists.value_lengths().to_numpy(zero_copy_only=False), lists.flatten()
                x = np.zeros((n, size, size, channels))
                at = np.repeat(np.arange(n), sizes), cells.field(0).to_numpy(zero_copy_only=False), cells.field(1).to_numpy(zero_copy_only=False)
                for c in range(channels):
                    x[(*at, c)] = cells.field(2 + c).to_numpy(zero_copy_only=False)
                y = np.asarray(score(x, model), float).reshape(n, size, size, k)
                i, j = np.indices((size, size)).reshape(2, -1)
                one = lambda name: np.repeat(part.column(name).to_numpy(), size * size)  # noqa: B023, E731
                x1, y1 = one("x1"), one("y1")
                yield pa.RecordBatch.from_arrays([pa.array(v) for v in (one("tile_id"), x1, y1, x1 + np.tile(i, n), y1 + np.tile(j, n), *(np.ascontiguousarray(y[..., c]).ravel() for c in range(k)))], ["tile_id", "x1", "y1", "x", "y", *[f"s{c}" for c in range(k)]])

    return run


def score_tiles(pixels: DataFrame, tiles: DataFrame, size: int, channels: list[str], score: Callable, model, names: list[str]) -> DataFrame:
    """Rows (tile_id, x1, y1, x, y, *names): score(batch, model) over batches of whole tiles, a row for each pixel of each tile.

    pixels: x, y, *channels, one row a pixel; what a tile lacks is 0. score takes an array (tiles, size, size, channels) and gives one of
    (tiles, size, size, names). The model is broadcast; a tile is size x size pixels at most, and a task scores many tiles at once."""
    placed = grid.points_to_tiles(pixels.select("x", "y", *channels), tiles.select("tile_id", "x1", "y1", "x2", "y2"), size)
    cell = F.struct((F.col("x") - F.col("x1")).cast("int").alias("i"), (F.col("y") - F.col("y1")).cast("int").alias("j"), *[F.col(c).cast("double").alias(f"c{k}") for k, c in enumerate(channels)])
    rows = tiles.select("tile_id", "x1", "y1").join(placed.groupBy("tile_id").agg(F.collect_list(cell).alias("cells")), "tile_id", "left")
    rows = rows.withColumn("cells", F.coalesce("cells", F.array().cast(rows.schema["cells"].dataType)))
    shared = pixels.sparkSession.sparkContext.broadcast(model)
    kinds = ", ".join(f"{c} long" for c in ("tile_id", "x1", "y1", "x", "y")) + "".join(f", s{k} double" for k in range(len(names)))
    out = rows.mapInArrow(_scored(size, len(channels), score, shared, len(names)), kinds)
    return out.select("tile_id", "x1", "y1", "x", "y", *[F.col(f"s{k}").alias(n) for k, n in enumerate(names)])


def stitch(tiles: DataFrame, size: int, overlap: float, classes: int) -> DataFrame:
    """tiles: x1, y1, x, y (slide pixels), foreground, angle, probs array. Weighted means a pixel; angles by their unit vectors."""
    border = size * overlap
    w = ramp(F.col("x") - F.col("x1"), size, border) * ramp(F.col("y") - F.col("y1"), size, border)
    rows = tiles.withColumn("w", w)
    mean = lambda v: F.sum(F.col("w") * v) / F.sum("w")
    out = rows.groupBy("x", "y").agg(mean(F.col("foreground")).alias("foreground"), mean(F.cos("angle")).alias("c"), mean(F.sin("angle")).alias("s"), *[mean(F.col("probs")[k]).alias(f"p{k}") for k in range(classes)])
    return out.select("x", "y", "foreground", F.atan2("s", "c").alias("angle"), F.array(*[F.col(f"p{k}") for k in range(classes)]).alias("probs"))


def dice(a: Column, b: Column) -> Column:
    return (2 * F.sum(a * b) + EPS) / (F.sum(a) + F.sum(b) + EPS)


def multiclass_dice(rows: DataFrame, by: list[str], k: int) -> DataFrame:
    """rows: *by, truth, predicted (classes 1 .. k; others count for none). One row (multiclass_dice): the mean of the Dice of each class in
    each group, a class that neither side has counting as 1. Counts are gathered a group and pair of classes first."""
    pairs = rows.groupBy(*by, "truth", "predicted").agg(F.count("*").alias("_n"))
    each = pairs.select(*by, "_n", "truth", "predicted", F.explode(F.sequence(F.lit(1), F.lit(k))).alias("_c"))
    a, b = F.col("truth") == F.col("_c"), F.col("predicted") == F.col("_c")
    both, size = 2 * F.sum(F.when(a & b, F.col("_n")).otherwise(0)), F.sum(F.col("_n") * (F.coalesce(a, F.lit(False)).cast("int") + F.coalesce(b, F.lit(False)).cast("int")))
    per = each.groupBy(*by, "_c").agg(both.alias("_i"), size.alias("_s"))
    return per.agg(F.avg((F.col("_i") + EPS) / (F.when(F.col("_s") == 0, F.col("_i")).otherwise(F.col("_s")) + EPS)).alias("multiclass_dice"))


def dice_loss(a: Column, b: Column) -> Column:
    """1 less the Dice of a whole batch."""
    return 1 - dice(a, b)


def foreground_accuracy(rows: DataFrame, by: list[str]) -> DataFrame:
    """rows: label, foreground. Dice of foreground over nuclei with nuclei."""
    nucleus = F.when(F.col("label") > 0, 1.0).otherwise(0.0)
    return rows.groupBy(*by).agg(dice(F.col("foreground") * nucleus, nucleus).alias("foreground_accuracy"))


def angle_accuracy(rows: DataFrame, by: list[str]) -> DataFrame:
    """rows: label, angle, true_angle, both in [0, 1]. Null where no pixel is labelled."""
    off = F.when(F.col("label") > 0, F.sqrt(S.angle_difference_sq(F.col("angle"), F.col("true_angle"))))
    return rows.groupBy(*by).agg((1 - F.avg(off)).alias("angle_accuracy"))


def celltype_accuracy(rows: DataFrame, by: list[str]) -> DataFrame:
    """rows: label, class, predicted. 1 where no pixel is labelled."""
    n = F.sum(F.when(F.col("label") > 0, 1).otherwise(0))
    hits = F.sum(F.when((F.col("label") > 0) & (F.col("class") == F.col("predicted")), 1).otherwise(0))
    return rows.groupBy(*by).agg(((2 * hits + EPS) / (2 * n + EPS)).alias("celltype_accuracy"))


def score_segmentation(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """pairs: x, y, nucleus, label. A row a nucleus (share labelled, share of the main label, several labels?), a row a label (its nuclei)."""
    n = pairs.where("nucleus > 0").groupBy("nucleus", "label").agg(F.count("*").alias("n"))
    got = F.when(F.col("label") > 0, F.col("n"))
    per = n.groupBy("nucleus").agg((F.coalesce(F.sum(got), F.lit(0)) / F.sum("n")).alias("labelled"), (F.coalesce(F.max(got), F.lit(0)) / F.sum("n")).alias("dominant"), (F.count(got) > 1).alias("several"))
    return per, n.where("label > 0").groupBy("label").agg(F.count("*").alias("nuclei"))


def transcript_likelihood(px: DataFrame, pred: DataFrame, class_freq: DataFrame, background: DataFrame) -> DataFrame:
    """Mean of -log(p_fg * sum_c p(gene | c) p(c) + (1 - p_fg) p(gene | background)) over transcripts in unlabelled pixels.

    px: x, y, gene_id of those transcripts; pred: x, y, foreground, probs. Frequency tables have types x genes rows."""
    met = px.join(pred, ["x", "y"]).join(F.broadcast(background.select("gene_id", F.col("frequency").alias("bg"))), "gene_id")
    lists = class_freq.groupBy("gene_id").agg(F.sort_array(F.collect_list(F.struct("class", "frequency"))).alias("f"))  # one entry a class
    met = met.join(F.broadcast(lists), "gene_id")
    fg = F.aggregate(F.zip_with("probs", F.transform("f", lambda r: r["frequency"]), lambda p, q: p * q), F.lit(0.0), lambda a, v: a + v)
    return met.agg((-F.avg(F.log(F.col("foreground") * fg + (1 - F.col("foreground")) * F.col("bg")))).alias("loss"), F.count("*").alias("n"))


def segment_class_probs(segments: DataFrame, pred: DataFrame, classes: int) -> DataFrame:
    """segments: x, y, segment_id. Mean class probabilities and the first greatest."""
    met = segments.join(pred.select("x", "y", "probs"), ["x", "y"])
    means = met.groupBy("segment_id").agg(*[F.avg(F.col("probs")[k]).alias(f"p{k}") for k in range(classes)], F.count("*").alias("pixels"))
    every = F.array(*[F.round(f"p{k}", 9) for k in range(classes)])
    return means.withColumn("class", F.array_position(every, F.array_max(every)))
