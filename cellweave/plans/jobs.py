"""End-to-end jobs: compositions of operators, one function each."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellweave.operators import celltypes, counts, grid, spatial, typefit
from cellweave.sources import io
from cellweave.sources.scratch import stored


def nuclear_counts(tx: DataFrame, vertices: DataFrame, least_qv: float = 20.0, least_molecules: int = 1) -> tuple[DataFrame, DataFrame]:
    """(counts (cell, gene_id, n), genes (feature_name, gene_id)): transcripts of good quality, each in the first nucleus that holds it.
    transcript_id tells transcripts apart; equal rows count as often as they are there."""
    fair = counts.filter_quality(tx, least_qv)
    genes = counts.good_genes(fair)
    polygons = io.assemble_polygons(vertices, "cell_id")
    points = counts.named(fair.select("transcript_id", "feature_name", "x_location", "y_location"), genes)
    owned = spatial.points_counted_first(polygons, points, "cell_id", ["transcript_id", "gene_id"], "x_location", "y_location")
    n = owned.groupBy(F.col("cell_id").alias("cell"), "gene_id").agg(F.sum("n").alias("n"))
    if least_molecules > 1:
        n = counts.cell_gene_table(n, "cell", least_molecules).select("cell", "gene_id", "n")
    return n, genes


def sampled_cells(found: DataFrame, area: DataFrame | None, share: float, most: int, seed: int) -> DataFrame:
    """The rows of `found` (cell, gene_id, n) of cells inside an area (cell; null: everywhere) with no fewer transcripts than the `share` percentile
    of totals there; of more than `most` cells a sample, drawn by a seeded hash. Only the fit reads this sample; prediction reads all cells."""
    inside = stored(found if area is None else found.join(area.select("cell"), "cell", "left_semi"))
    totals = inside.groupBy("cell").agg(F.sum("n").alias("total"))
    kept = totals.crossJoin(F.broadcast(counts.percentile_cutoff(totals, share))).where("total >= cutoff")  # one row is broadcast
    drawn = kept.orderBy(F.xxhash64("cell", F.lit(seed)), "cell").limit(most).select("cell")
    return inside.join(drawn, "cell", "left_semi")


def fit_celltypes(found: DataFrame, genes: DataFrame, area: DataFrame | None, ks: list[int], chains: int, share: float = 0.25, most: int = 20_000, steps: int = 100, tolerance: float = 1e-4, warm: bool = False, seed: int = 0) -> typefit.Models:
    """Models by (number of types, chain): the sampled cells fitted for each number of types from `chains` starts."""
    cells = typefit.packed(sampled_cells(found, area, share, most, seed))
    return typefit.fit_chains(cells, genes.count(), ks, chains, steps, tolerance, warm, seed)


def model_report(found: DataFrame, models: typefit.Models, scores: DataFrame, genes: DataFrame, markers: int = 10) -> DataFrame:
    """Rows (section, k, celltype, gene_id, rank, value): the least and greatest score of each number of types over chains, and of the chain
    of least BIC the priors and the marker genes of every number of types. Numbers of types are few."""
    spark = found.sparkSession
    best = scores.select("chain", F.round("bic", 6).alias("bic"), "k").orderBy("bic", "chain", "k").first()["chain"]
    none, ends = F.lit(None), {"low": F.min, "high": F.max}
    shown = lambda df, section, celltype=none, gene=none, rank=none: df.select(F.lit(section).alias("section"), F.col("k").cast("long").alias("k"), celltype.cast("int").alias("celltype"), gene.cast("long").alias("gene_id"), rank.cast("int").alias("rank"), F.col("value").cast("double").alias("value"))
    parts = [shown(scores.groupBy("k").agg(f(c).alias("value")), f"{c}_{end}") for c in ("aic", "bic") for end, f in ends.items()]
    chosen = {key: m for key, m in models.items() if key[1] == best}
    profiles, priors = typefit.tables(spark, chosen)
    parts.append(shown(priors.withColumn("value", F.col("prior")), "prior", F.col("celltype")))
    for k, _ in sorted(chosen):
        own = lambda df, k=k: df.where(F.col("k") == k).drop("k", "chain")
        types = celltypes.hard_types(celltypes.posterior(found, own(profiles), own(priors)))
        top = celltypes.top_markers(celltypes.relative_expression(found, types, genes), markers).withColumn("k", F.lit(k)).withColumn("value", F.col("relative_expression"))
        parts.append(shown(top, "marker", F.col("celltype"), F.col("gene_id"), F.col("rank")))
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out


def combined(results: DataFrame, tiles: DataFrame) -> DataFrame:
    """Rows (tile_id, local_id, ring, global_id): the segments of overlapping tiles as one segmentation.

    results: tile_id, local_id, ring in the tile's coordinates. A segment stays if its own tile's centre is nearest to it, so what
    several tiles saw is kept once; numbers follow tile and local id and are given by ranges."""
    moved = F.transform("ring", lambda q: F.struct((q["x"] + F.col("x1")).alias("x"), (q["y"] + F.col("y1")).alias("y")))
    placed = stored(results.join(tiles.select("tile_id", "x1", "y1"), "tile_id").select(F.struct("tile_id", "local_id").alias("seen"), moved.alias("ring")))
    owner = spatial.tile_ownership(placed, tiles, "seen").where(F.col("seen.tile_id") == F.col("tile_id")).select("seen")
    named = grid.dictionary(owner, "seen", "global_id")
    return placed.join(named, "seen").select("seen.*", "ring", "global_id")
