"""Fits of the cell-type mixture over numbers of types and chains, one pass over the counts a step for all of them.

Cells are stored once as sparse rows, many in a block of bytes, so that a step reads blocks and converts no lists. A step sends the
models (types x genes numbers each, bounded by the parameters) to the tasks; a task multiplies its cells with all profiles at once and
adds up, over its cells, what each type takes of each gene. These sums are added by Spark and only they, as large as the models, come back. So a step costs one pass whatever the number of models, and
models that no longer move take no part in it.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellweave.sources.scratch import stored

ROWS = 2048  # cells multiplied at once
SUMS = 1 << 14  # sums of the models that one task adds up over the tasks of a pass


@dataclass
class Model:
    profiles: np.ndarray  # types x genes
    priors: np.ndarray
    loglik: float = float("nan")
    cells: int = 0
    steps: int = 0

    def dof(self) -> int:
        k, g = self.profiles.shape
        return k * (g - 1) + k - 1

    def aic(self) -> float:
        return 2 * self.dof() - 2 * self.loglik

    def bic(self) -> float:
        return self.dof() * float(np.log(self.cells)) - 2 * self.loglik


Models = dict[tuple[int, int], Model]  # by number of types and chain


def _blocks(batches):
    """Rows (genes, n) of cells, up to ROWS of them as one row of bytes."""
    for b in batches:
        for lo in range(0, b.num_rows, ROWS):
            genes, n = b.slice(lo, ROWS).columns
            sizes = genes.value_lengths().to_numpy(zero_copy_only=False)
            parts = [sizes.astype(np.int32), genes.flatten().to_numpy().astype(np.int32), n.flatten().to_numpy()]
            yield pa.RecordBatch.from_arrays([pa.array([v.tobytes()], pa.binary()) for v in parts], ["sizes", "genes", "n"])


def packed(counts: DataFrame) -> DataFrame:
    """counts: cell, gene_id, n. Rows (sizes, genes, n) of up to ROWS cells each, as bytes: how many entries a cell has (int32), at most as many
    as genes, and one cell's after the other's genes (int32) and counts (double)."""
    one = counts.groupBy("cell").agg(F.collect_list(F.struct("gene_id", F.col("n").cast("double").alias("n"))).alias("c"))
    lists = one.select(F.col("c.gene_id").alias("genes"), F.col("c.n").alias("n"))
    return stored(lists.mapInArrow(_blocks, "sizes binary, genes binary, n binary"))


def _pass(models: list[tuple[np.ndarray, np.ndarray]], genes: int):
    """Adds up over a task's cells: rows (row, gene, v), row the type counted over all models; gene -1: how many cells it takes, -2: the
    model's log likelihood, at its first type; row -1: the number of cells."""
    logs = np.concatenate([np.log(p) for p, _ in models]).T
    prior = np.concatenate([np.log(q) for _, q in models])
    first = np.cumsum([0, *[len(q) for _, q in models]])

    def run(batches):
        taken, cells, loglik, n = np.zeros((len(prior), genes)), np.zeros(len(prior)), np.zeros(len(models)), 0
        for b in batches:
            for block in zip(*b.columns, strict=True):
                sizes, at, v = (np.frombuffer(c.as_buffer(), t) for c, t in zip(block, (np.int32, np.int32, np.float64), strict=True))
                x = np.zeros((len(sizes), genes))
                x[np.repeat(np.arange(len(sizes)), sizes), at] = v
                joint = x @ logs + prior
                for k in range(len(models)):
                    own = slice(first[k], first[k + 1])
                    top = joint[:, own].max(1, keepdims=True)
                    e = np.exp(joint[:, own] - top)
                    whole = e.sum(1, keepdims=True)
                    loglik[k] += (top + np.log(whole)).sum()
                    joint[:, own] = e / whole
                taken += joint.T @ x
                cells += joint.sum(0)
                n += len(sizes)
        row, gene = np.nonzero(taken)
        rows = [row, np.arange(len(cells)), first[:-1], [-1]]
        kinds = [gene, np.full(len(cells), -1), np.full(len(loglik), -2), [0]]
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(rows).astype(np.int32)), pa.array(np.concatenate(kinds).astype(np.int32)), pa.array(np.concatenate([taken[row, gene], cells, loglik, [float(n)]]))], ["row", "gene", "v"])

    return run


def swept(cells: DataFrame, models: list[Model], genes: int) -> list[tuple[np.ndarray, np.ndarray, float, int]]:
    """For each model (what types take of genes, cells of types, log likelihood, number of cells), from one pass."""
    each = cells.mapInArrow(_pass([(m.profiles, m.priors) for m in models], genes), "row int, gene int, v double")
    parts = -(-sum(m.profiles.size for m in models) // SUMS)  # by the models' size: a shuffle file for each of the default partitions costs more than the pass
    sums = each.repartition(parts, "row").groupBy("row", "gene").agg(F.sum("v").alias("v"))
    t = sums.toArrow()  # as large as the models
    row, gene, v = (t.column(c).to_numpy() for c in ("row", "gene", "v"))
    k = sum(len(m.priors) for m in models)
    table = np.zeros((k + 1, genes + 2))
    table[row, gene] = v  # row -1 and genes -1 and -2 stand at the ends
    out, at = [], 0
    for m in models:
        end = at + len(m.priors)
        out.append((table[at:end, :genes], table[at:end, -1], float(table[at, -2]), int(table[-1, 0])))
        at = end
    return out


def fit(cells: DataFrame, genes: int, models: Models, steps: int = 100, tolerance: float = 1e-4) -> Models:
    """Expectation-maximisation of every model until its profiles move by no more than the tolerance (relative norm), in `steps` steps at
    most, then the log likelihood of what came out. One is added to every count."""
    models, open_ = {k: Model(m.profiles, m.priors) for k, m in models.items()}, list(models)
    for step in range(steps):
        if not open_:
            break
        left = []
        for key, (taken, held, _, n) in zip(open_, swept(cells, [models[k] for k in open_], genes), strict=True):
            was = models[key].profiles
            raw = taken + 1
            models[key] = Model(raw / raw.sum(1, keepdims=True), (held + 1) / (n + len(held)), steps=step + 1)
            if np.linalg.norm(was - models[key].profiles) > tolerance * np.linalg.norm(was):
                left.append(key)
        open_ = left
    for m, (_, _, loglik, n) in zip(models.values(), swept(cells, list(models.values()), genes), strict=True):
        m.loglik, m.cells = loglik, n
    return models


def cold(k: int, genes: int, rng: np.random.Generator) -> Model:
    """Dirichlet(1) profiles, equal priors."""
    return Model(rng.dirichlet(np.ones(genes), k), np.full(k, 1 / k))


def split(m: Model, rng: np.random.Generator) -> Model:
    """A start of one more type: the dominant one is split at a random share, the new half's profile mixed with a random one."""
    top, share = int(np.argmax(m.priors)), rng.random()
    priors = np.append(m.priors, m.priors[top] * share)
    priors[top] *= 1 - share
    new = m.profiles[top] * share + (1 - share) * rng.dirichlet(np.ones(m.profiles.shape[1]))
    return Model(np.vstack([m.profiles, new]), priors)


def fit_chains(cells: DataFrame, genes: int, ks: list[int], chains: int, steps: int = 100, tolerance: float = 1e-4, warm: bool = False, seed: int = 0) -> Models:
    """Fits of all numbers of types from `chains` starts each, seeded. Cold starts take their steps all together; warm ones go on from the
    chain's fit of one type fewer, so numbers of types (neighbours) follow each other and only chains go together."""
    draw = lambda k, chain: np.random.default_rng([seed, chain, k])
    if not warm:
        return fit(cells, genes, {(k, c): cold(k, genes, draw(k, c)) for k in ks for c in range(chains)}, steps, tolerance)
    out: Models = {}
    for k in range(min(ks), max(ks) + 1):
        starts = {(k, c): cold(k, genes, draw(k, c)) if k == min(ks) else split(out[k - 1, c], draw(k, c)) for c in range(chains)}
        out |= fit(cells, genes, starts, steps, tolerance)
    return out


def scores(spark, models: Models) -> DataFrame:
    """Rows (k, chain, loglik, aic, bic, cells, steps), one a model."""
    rows = [(k, c, float(m.loglik), float(m.aic()), float(m.bic()), m.cells, m.steps) for (k, c), m in models.items()]
    return spark.createDataFrame(rows, "k long, chain long, loglik double, aic double, bic double, cells long, steps long")


def tables(spark, models: Models) -> tuple[DataFrame, DataFrame]:
    """Rows (k, chain, celltype, gene_id, prob) and (k, chain, celltype, prior) of all models."""
    each: Callable = lambda value: [(k, c, t, *rest) for (k, c), m in models.items() for t in range(k) for rest in value(m, t)]
    profiles = each(lambda m, t: [(g, float(p)) for g, p in enumerate(m.profiles[t])])
    priors = each(lambda m, t: [(float(m.priors[t]),)])
    return spark.createDataFrame(profiles, "k long, chain long, celltype int, gene_id long, prob double"), spark.createDataFrame(priors, "k long, chain long, celltype int, prior double")
