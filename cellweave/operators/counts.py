"""Counts and frequencies of genes, labels and classes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from cellweave.functions import scalars as S
from cellweave.operators import grid
from cellweave.sources.scratch import stored

FLOOR = 1e-10
BROADCAST = 100_000  # names of genes, counted, up to which their dictionary is broadcast


def filter_quality(tx: DataFrame, least: float = 20.0) -> DataFrame:
    return tx.where(F.col("qv") >= least)


def filter_controls(tx: DataFrame) -> DataFrame:
    return tx.where(~S.is_control(F.col("feature_name")))


def prepared(tx: DataFrame, least: float = 20.0) -> DataFrame:
    return filter_controls(filter_quality(tx, least))


def gene_dictionary(tx: DataFrame) -> DataFrame:
    """Rows (feature_name, gene_id), 0 .. G-1 in order of name."""
    return grid.dictionary(tx, "feature_name", "gene_id")


def good_genes(fair: DataFrame) -> DataFrame:
    """The dictionary of prepared transcripts, from those that passed the quality filter only: names are made distinct and stored first, so that
    each is tested once and not with every transcript. An inner join with it leaves out the controls."""
    return stored(gene_dictionary(filter_controls(stored(fair.select("feature_name").distinct()))))


def named(tx: DataFrame, genes: DataFrame) -> DataFrame:
    """tx with its gene_id; what the dictionary doesn't have is left out. Names are few and hot, so transcripts are not dealt by them."""
    return tx.join(F.broadcast(genes) if genes.count() <= BROADCAST else genes, "feature_name")


def encode_genes(tx: DataFrame) -> DataFrame:
    return tx.join(gene_dictionary(tx), "feature_name")


def encode_cells(tx: DataFrame) -> DataFrame:
    """cell_number: 1 .. n in order of cell_id, 0 for UNASSIGNED."""
    named = grid.dictionary(tx.where("cell_id <> 'UNASSIGNED'"), "cell_id", "cell_number", 1)
    return tx.join(named, "cell_id", "left").withColumn("cell_number", F.coalesce("cell_number", F.lit(0)))


def pixel_transcripts(tx: DataFrame) -> DataFrame:
    """Rows (x, y, gene_id) of encoded transcripts."""
    return tx.select(F.floor("x_location").alias("x"), F.floor("y_location").alias("y"), "gene_id")


def pixel_counts(tx: DataFrame) -> DataFrame:
    return tx.groupBy(F.floor("x_location").alias("x"), F.floor("y_location").alias("y")).agg(F.count("*").alias("n"))


def background(px: DataFrame, labels: DataFrame, genes: DataFrame) -> DataFrame:
    """Rows (gene_id, n, pseudocount, frequency) over transcripts in pixels of label 0."""
    inside = px.join(labels.where("label = 0").select("x", "y"), ["x", "y"], "left_semi")
    n = genes.select("gene_id").join(inside.groupBy("gene_id").agg(F.count("*").alias("n")), "gene_id", "left").select("gene_id", F.coalesce("n", F.lit(0)).alias("n"))
    total = n.agg(F.sum("n").alias("total"))
    share = F.when(F.col("n") > 0, F.col("n") / F.col("total")).otherwise(F.lit(FLOOR))
    return n.crossJoin(F.broadcast(total)).select("gene_id", "n", (F.col("n") + 1).alias("pseudocount"), share.alias("frequency"))  # total is one row


def class_frequencies(px: DataFrame, labels: DataFrame, genes: DataFrame) -> DataFrame:
    """Rows (class, gene_id, frequency): distinct (pixel, gene) of a class by the pixels of that class, at least FLOOR."""
    classes = labels.where("class > 0").groupBy("class").agg(F.count("*").alias("pixels"))
    seen = px.distinct().join(labels.where("class > 0").select("x", "y", "class"), ["x", "y"]).groupBy("class", "gene_id").agg(F.count("*").alias("n"))
    every = classes.select("class", "pixels").crossJoin(F.broadcast(genes.select("gene_id")))  # classes are a handful of types
    return every.join(seen, ["class", "gene_id"], "left").select("class", "gene_id", F.coalesce(F.col("n") / F.col("pixels"), F.lit(FLOOR)).alias("frequency"))


def gene_counts(assigned: DataFrame, key: str, gene: str = "gene_id") -> DataFrame:
    return assigned.groupBy(key, gene).agg(F.count("*").alias("n"))


def cell_gene_table(counts: DataFrame, key: str, least: int) -> DataFrame:
    """counts of cells with at least `least` transcripts."""
    total = counts.groupBy(key).agg(F.sum("n").alias("total")).where(F.col("total") >= least)
    return counts.join(total, key)


def percentile_cutoff(totals: DataFrame, share: float = 0.25) -> DataFrame:
    return totals.agg(F.floor(F.percentile("total", F.lit(share))).alias("cutoff"))


def tile_class_histogram(pixels: DataFrame, tiles: DataFrame, size: int, classes: int) -> DataFrame:
    """A row for each tile: pixels of class -1 (unlabelled), 0, 1 .. classes."""
    kind = F.when(F.col("label") == -1, -1).otherwise(F.col("class"))
    placed = grid.points_to_tiles(pixels.withColumn("kind", kind), tiles, size)
    return placed.groupBy("tile_id").agg(*[F.sum((F.col("kind") == k).cast("long")).alias(f"n{k}" if k >= 0 else "n_none") for k in range(-1, classes + 1)])


def class_weights(histogram: DataFrame, columns: list[str]) -> DataFrame:
    """Rows (class, weight): the mean over all entries by the class's mean; 1e-6 where that isn't finite."""
    means = histogram.agg(*[F.avg(c).alias(c) for c in columns])
    overall = S.total([F.col(c) for c in columns]) / len(columns)
    return means.select(F.explode(F.array(*[F.struct(F.lit(k).alias("class"), F.when(F.col(c) > 0, overall / F.col(c)).otherwise(F.lit(1e-6)).alias("weight")) for k, c in enumerate(columns)])).alias("r")).select("r.*")


def label_centroids(pixels: DataFrame) -> DataFrame:
    return pixels.where("label > 0").groupBy("label").agg((F.avg("x") + 0.5).alias("cx"), (F.avg("y") + 0.5).alias("cy"))


def angles_to_centroid(pixels: DataFrame) -> DataFrame:
    """Rows (x, y, label, angle in [0, 1]) from a labelled pixel's centre to its label's centroid."""
    met = pixels.where("label > 0").join(label_centroids(pixels), "label")
    return met.select("x", "y", "label", S.normalize_angle(F.atan2(F.col("cy") - F.col("y") - 0.5, F.col("cx") - F.col("x") - 0.5)).alias("angle"))


def relabel_within_tile(placed: DataFrame) -> DataFrame:
    """Labels > 0 renumbered 1 .. n inside each tile, in their order."""
    names = placed.where("label > 0").select("tile_id", "label").distinct().withColumn("tile_label", F.dense_rank().over(W.partitionBy("tile_id").orderBy("label")))
    return placed.join(names, ["tile_id", "label"], "left").withColumn("tile_label", F.when(F.col("label") > 0, F.col("tile_label")).otherwise(F.col("label")))


def renumber_segments(segments: DataFrame) -> DataFrame:
    """(tile_id, segment_id) -> global_id from 0, in order of tile and segment, numbered by ranges and not in one task."""
    keys = segments.select(F.struct("tile_id", "segment_id").alias("_k"))
    return grid.dictionary(keys, "_k", "global_id").select("_k.*", "global_id")


def segment_intensity(pixels: DataFrame, image: DataFrame, most: int = 4000) -> DataFrame:
    """Mean intensity and size of the first `most` segments by id: a limit of the report itself."""
    return pixels.where("label > 0").join(image, ["x", "y"]).groupBy("label").agg(F.avg("intensity").alias("mean_intensity"), F.count("*").alias("size")).orderBy("label").limit(most)


def histogram(values: DataFrame, column: str, low: float, high: float, bins: int = 100) -> DataFrame:
    at = F.least(F.greatest(F.floor((F.col(column) - low) / ((high - low) / bins)), F.lit(0)), F.lit(bins - 1))
    return values.groupBy(at.alias("bin")).agg(F.count("*").alias("n"))


def label_rule(nearest: DataFrame, dense: DataFrame, inner: float, outer: float) -> DataFrame:
    """Training labels: the nucleus within `inner`, 0 beyond `outer` (or near none) unless transcripts are dense, else -1.

    nearest: x, y, label, distance (null if none is near); dense: x, y."""
    near = nearest.join(dense.withColumn("dense", F.lit(True)), ["x", "y"], "left")
    far = F.col("distance").isNull() | (F.col("distance") > outer)
    return near.select("x", "y", F.when(F.col("distance") <= inner, F.col("label")).when(far & F.col("dense").isNull(), F.lit(0)).otherwise(F.lit(-1)).cast("long").alias("label"))


def tile_batches(px: DataFrame, tiles: DataFrame, size: int) -> DataFrame:
    """A row a tile: its transcripts (x, y, gene_id) in tile coordinates, in order. A tile's transcripts are bounded by its area."""
    placed = grid.points_to_tiles(px, tiles, size)
    item = F.struct((F.col("x") - F.col("x1")).alias("x"), (F.col("y") - F.col("y1")).alias("y"), "gene_id")
    return placed.groupBy("tile_id").agg(F.sort_array(F.collect_list(item)).alias("transcripts"))


def upper_median_tile(per_tile: DataFrame, count: str) -> DataFrame:
    """The first tile whose count equals the upper median of the counts. Tiles are added up by count first, so that what is put in order is
    as long as there are different counts."""
    sizes = per_tile.groupBy(count).agg(F.count("*").alias("_n"), F.min("tile_id").alias("tile_id"))
    n = per_tile.count()
    upto = sizes.withColumn("_upto", F.sum("_n").over(W.orderBy(count)))  # a row for each different count
    return upto.where(F.col("_upto") > n // 2).agg(F.min(F.struct(count, "tile_id")).alias("_b")).select("_b.tile_id", f"_b.{count}")
