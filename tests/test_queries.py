"""Registered queries against their DuckDB statements, and the entry without the llm folders."""

import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

from cellweave.plans import queries_jobs, queries_reports  # noqa: F401
from cellweave.plans.queries import ORACLE, QUERIES

ROOT = Path(__file__).resolve().parent.parent
DATA = "/root/testdata/sf0.001"
NAMES = ["job_nuclear_counts", "assemble_polygons", "encode_genes", "tile_grid", "points_to_tiles", "write_transcript_tiles", "celltype_posterior", "celltype_mstep", "fit_celltypes", "model_scores", "greedy_expansion", "jaccard_index", "label_pixels", "stitch_predictions", "confidence_trace", "uniformity_test"]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in ("customer", "lineitem", "embeddings"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


def rows(records, columns):
    shown = lambda v: "null" if v is None or v != v else f"{v:.8g}" if isinstance(v, float) else str(v)
    return sorted(tuple(shown(r[c]) for c in columns) for r in records)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_its_statement(spark, con, name):
    df = QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    got = rows([r.asDict() for r in df.collect()], columns)
    answer = con.sql(ORACLE[name])
    assert sorted(answer.columns) == columns
    assert got == rows([dict(zip(answer.columns, r, strict=True)) for r in answer.fetchall()], columns) and got


def test_answers_do_not_depend_on_partitions(spark):
    was = spark.conf.get("spark.sql.shuffle.partitions")
    got = []
    for n in ("1", "13"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        got.append(sorted(map(tuple, QUERIES["job_nuclear_counts"](spark, DATA).collect())))
    spark.conf.set("spark.sql.shuffle.partitions", was)
    assert got[0] == got[1]


def test_slide_tiles_lose_nothing(spark):
    from cellweave.plans.queries import Tables

    t = Tables(spark, DATA)
    cells, transcripts = t.nuclei.count(), t.tx.select("transcript_id").distinct().count()
    placed = QUERIES["points_to_tiles"](spark, DATA)
    assert placed.select("transcript_id").distinct().count() == transcripts
    assert sum(r.transcripts for r in QUERIES["job_tile_slide"](spark, DATA).collect()) == placed.count()
    owned = QUERIES["tile_ownership"](spark, DATA).collect()
    assert len(owned) == len({r.cell_id for r in owned}) == cells


def test_statements_belong_to_queries():
    assert ORACLE.keys() <= QUERIES.keys()


def test_entry_without_llm(tmp_path):
    shutil.copytree(ROOT / "cellweave", tmp_path / "cellweave", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"], cwd=tmp_path, capture_output=True, text=True, check=True)
    assert said.stdout.split() == [str(len(QUERIES)), str(len(ORACLE))]


def test_the_other_tests_run_without_llm(tmp_path):
    """The rest has its tests, and they run, with both folders of the training-data operators and the pipeline gone."""
    for name in ("cellweave", "tests"):
        shutil.copytree(ROOT / name, tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    said = subprocess.run([sys.executable, "-m", "pytest", "-q", "-x", "tests", "-k", "boxes_are_exact or split_halves or crossed_and_flat or belong_to_queries"], cwd=tmp_path, capture_output=True, text=True, check=False)
    assert said.returncode == 0 and "4 passed" in said.stdout, said.stdout[-800:]


def test_whole_fit_agrees_with_long_steps(spark):
    """One query's fit, in passes over packed cells, against the steps over long tables."""
    from cellweave.operators import celltypes
    from cellweave.plans.queries import Tables, _cell_counts, _start

    t = Tables(spark, DATA)
    n, genes = _cell_counts(t)
    whole = {(r.celltype, r.gene_id): r.prob for r in QUERIES["fit_celltypes_whole"](spark, DATA).collect()}
    profiles = spark.createDataFrame([(c, g, p) for (c, g), p in whole.items()], "celltype int, gene_id long, prob double")
    priors = celltypes.mstep(n, celltypes.posterior(n, profiles, _start(t)[1]), genes)[1]
    again = celltypes.mstep(n, celltypes.posterior(n, profiles, priors), genes)[0].collect()
    assert len(whole) == 144 and max(abs(r.prob - whole[r.celltype, r.gene_id]) for r in again) < 5e-3  # a fixed point
