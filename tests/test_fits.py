"""What fits of cell types read and send."""

import re
from collections import Counter

import numpy as np

from cellweave.operators import typefit
from cellweave.plans import jobs


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_nuclear_counts_read_transcripts_once_and_equal_brute_force(spark, tmp_path):
    nuclei = {1: (0, 0, 10, 10), 2: (5, 5, 20, 20), 3: (40, 40, 44, 44)}
    tx = [(k, f"gene_{k % 4:02}" if k % 9 else "BLANK_0001", float(k * 7 % 50), float(k * 11 % 47), 30.0 if k % 5 else 10.0) for k in range(300)]
    tx += [r for r in tx if r[0] % 10 == 3] * 2  # equal rows
    spark.createDataFrame(tx, "transcript_id long, feature_name string, x_location double, y_location double, qv double").repartition(3).write.parquet(f"{tmp_path}/tx")
    corners = [(c, k, float(x), float(y)) for c, (a, b, d, e) in nuclei.items() for k, (x, y) in enumerate(((a, b), (d, b), (d, e), (a, e)))]
    vertices = spark.createDataFrame(corners, "cell_id long, k long, vertex_x double, vertex_y double")
    n, genes = jobs.nuclear_counts(spark.read.parquet(f"{tmp_path}/tx"), vertices)
    assert plan(n).count("x_location#") > 0 and len(re.findall(r"FileScan parquet \[[^]]*feature_name[^]]*qv", plan(n))) == 1
    want = Counter()
    for _, g, x, y, qv in tx:
        owner = min((c for c, (a, b, d, e) in nuclei.items() if a <= x <= d and b <= y <= e), default=None)
        if qv >= 20 and g.startswith("gene") and owner:
            want[owner, g] += 1
    got = {(r.cell, r.feature_name): r.n for r in n.join(genes, "gene_id").collect()}
    assert got == want and {c for c, _ in want} == {1, 2, 3}
    assert [(r.feature_name, r.gene_id) for r in genes.orderBy("gene_id").collect()] == [(f"gene_{g:02}", g) for g in range(4)]


def test_cells_are_packed_in_blocks_and_sums_shuffled_by_their_size(spark, monkeypatch):
    n = [(c, g, 1 + (c * 7 + g) % 5) for c in range(5000) for g in range(4) if (c + g) % 3]
    x = np.zeros((5000, 4))
    for c, g, v in n:
        x[c, g] = v
    cells = typefit.packed(spark.createDataFrame(n, "cell long, gene_id long, n long").repartition(2))
    assert cells.count() <= 4 + 5000 // typefit.ROWS  # as many blocks as tasks may be left unfilled
    models = [typefit.cold(k, 4, np.random.default_rng(k)) for k in (2, 3)]
    frame, seen = type(cells), []
    was = frame.toArrow
    monkeypatch.setattr(frame, "toArrow", lambda self: seen.append(plan(self)) or was(self))
    out = typefit.swept(cells, models, 4)
    assert "Exchange SinglePartition" in seen[0] and "hashpartitioning" not in seen[0]  # one partition, not the session's number
    for m, (taken, held, loglik, size) in zip(models, out, strict=True):
        joint = np.exp(x @ np.log(m.profiles).T) * m.priors
        post = joint / joint.sum(1, keepdims=True)
        assert size == 5000 and np.allclose(taken, post.T @ x) and np.allclose(held, post.sum(0)) and np.isclose(loglik, np.log(joint.sum(1)).sum())
