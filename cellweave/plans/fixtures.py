"""Spatial input tables derived from the given tables by integer arithmetic; one SQL text serves Spark and DuckDB."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_OCTAGON = "(VALUES (0,2,1),(1,1,2),(2,-1,2),(3,-2,1),(4,-2,-1),(5,-1,-2),(6,1,-2),(7,2,-1)) AS o(k,dx,dy)"

#: name -> SQL; {other} names a fixture or a given table, SERIES(a, b) is a row for each whole number from a to b.
SQL: dict[str, str] = {
    "slide": "SELECT CAST(floor(CAST(count(*) + 39 AS DOUBLE) / 40) AS BIGINT) AS n_rows FROM {customer}",
    "tx": """
WITH h AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, n_rows,
  l_orderkey*7919 + l_partkey*104729 + l_suppkey*1299709 + l_linenumber*15485863 AS h FROM {lineitem} CROSS JOIN {slide}),
p AS (SELECT *, h % 80000 AS xi, (h*31 + l_partkey*613) % (n_rows*2000) AS yi FROM h),
q AS (SELECT *, CAST(floor(CAST(yi AS DOUBLE)/2000) AS BIGINT)*40 + CAST(floor(CAST(xi AS DOUBLE)/2000) AS BIGINT) AS lattice FROM p)
SELECT (((l_orderkey*100000 + l_partkey)*10000 + l_suppkey)*10 + l_linenumber)*64 + CAST(l_quantity AS BIGINT) AS transcript_id,
  CAST(xi AS DOUBLE)/100 AS x_location, CAST(yi AS DOUBLE)/100 AS y_location, CAST(l_quantity AS DOUBLE) AS qv,
  CASE WHEN l_partkey % 53 = 0 THEN 'NegControlProbe_0001' WHEN l_partkey % 59 = 0 THEN 'BLANK_0006' WHEN l_partkey % 61 = 0 THEN 'antisense_X'
    ELSE concat('gene_', lpad(CAST(CASE WHEN l_partkey % 4 < 3 THEN (lattice % 3)*16 + (l_partkey*7 + l_linenumber) % 16
      ELSE (l_partkey*7 + l_linenumber) % 48 END AS VARCHAR(9)), 2, '0')) END AS feature_name,
  CASE WHEN h % 5 = 0 THEN 'UNASSIGNED' ELSE concat('cell_', CAST(lattice AS VARCHAR(9))) END AS cell_id, (h % 3 = 0) AS overlaps_nucleus
FROM q""",
    "nuclei": """
SELECT c_custkey AS cell_id, (c_custkey % 40)*20 + 10 + (c_nationkey % 5) - 2 AS cx,
  CAST(floor(CAST(c_custkey AS DOUBLE)/40) AS BIGINT)*20 + 10 + (c_nationkey % 3) - 1 AS cy, 3 + c_custkey % 3 AS r FROM {customer}""",
    "nucleus_vertices": f"SELECT cell_id, k, CAST(2*cx + r*dx AS DOUBLE)/2 AS vertex_x, CAST(2*cy + r*dy AS DOUBLE)/2 AS vertex_y FROM {{nuclei}} CROSS JOIN {_OCTAGON}",
    "truth_vertices": f"SELECT cell_id, k, CAST(2*cx + (r+2)*dx AS DOUBLE)/2 AS vertex_x, CAST(2*cy + (r+2)*dy AS DOUBLE)/2 AS vertex_y FROM {{nuclei}} CROSS JOIN {_OCTAGON}",
    "method_vertices": f"SELECT cell_id + 1000000 AS segment_id, k, CAST(2*cx + 3 + (r+2)*dx AS DOUBLE)/2 AS vertex_x, CAST(2*cy + (r+2)*dy AS DOUBLE)/2 AS vertex_y FROM {{nuclei}} CROSS JOIN {_OCTAGON} WHERE cell_id % 11 <> 0",
    "moved_vertices": "SELECT cell_id + 2000000 AS segment_id, k, vertex_x + 1 AS vertex_x, vertex_y - 1 AS vertex_y FROM {truth_vertices} WHERE cell_id % 7 <> 0",
    "cell_metadata": """
SELECT cell_id, CAST(cx AS DOUBLE) AS x_centroid, CAST(cy AS DOUBLE) AS y_centroid,
  CASE WHEN cell_id % 3 = 0 THEN 'boundary' WHEN cell_id % 3 = 1 THEN 'interior' ELSE 'expansion' END AS segmentation_method FROM {nuclei}""",
    "pixels": """
WITH xs AS (SELECT SERIES(0, 159) AS x), ys AS (SELECT SERIES(0, n_rows*20-1) AS y FROM {slide}),
g AS (SELECT x, y, CAST(floor(CAST(y AS DOUBLE)/20) AS BIGINT)*40 + CAST(floor(CAST(x AS DOUBLE)/20) AS BIGINT) AS lattice FROM xs CROSS JOIN ys),
d AS (SELECT g.x, g.y, g.lattice, n.cell_id, n.r, n.cx - (g.x + 0.5E0) AS dx, n.cy - (g.y + 0.5E0) AS dy FROM g LEFT JOIN {nuclei} n ON n.cell_id = g.lattice)
SELECT x, y, lattice, dx, dy, dx*dx + dy*dy AS d2,
  CASE WHEN cell_id IS NULL OR dx*dx + dy*dy >= 100 THEN 0 WHEN dx*dx + dy*dy <= r*r THEN cell_id + 1 ELSE -1 END AS label,
  CASE WHEN dx*dx + dy*dy <= r*r THEN lattice % 3 + 1 ELSE 0 END AS class FROM d""",
    "pred": """
SELECT x, y, 1/(1 + exp(-(49 - d2)/8)) AS foreground, atan2(dy, dx) AS angle,
  CASE WHEN lattice % 3 = 0 THEN 2 ELSE CAST((x*31 + y*17) % 10 AS DOUBLE)/10 END AS logit0,
  CASE WHEN lattice % 3 = 1 THEN 2 ELSE CAST((x*31 + y*17 + 7) % 10 AS DOUBLE)/10 END AS logit1,
  CASE WHEN lattice % 3 = 2 THEN 2 ELSE CAST((x*31 + y*17 + 14) % 10 AS DOUBLE)/10 END AS logit2 FROM {pixels} WHERE d2 IS NOT NULL""",
    "image": "SELECT x, y, CAST((x*37 + y*91) % 256 + CASE WHEN label > 0 THEN 64 ELSE 0 END AS DOUBLE) AS intensity FROM {pixels}",
    "init_profiles": """
SELECT t AS celltype, g AS gene_id, CAST(1 + (t*31 + g*17) % 7 AS DOUBLE) / sum(1 + (t*31 + g*17) % 7) OVER (PARTITION BY t) AS prob
FROM (SELECT SERIES(0, 2) AS t) a CROSS JOIN (SELECT SERIES(0, 47) AS g) b""",
    "starts": """
SELECT k, chain, t AS celltype, g AS gene_id, v / sum(v) OVER (PARTITION BY k, chain, t) AS prob FROM (
  SELECT k, chain, t, g, CAST(1 + (t*31 + g*17 + chain*13 + k*5 + (t + 1)*(g % (3 + chain))) % 7 AS DOUBLE) AS v
  FROM (SELECT SERIES(2, 5) AS k) a CROSS JOIN (SELECT SERIES(0, 1) AS chain) b CROSS JOIN (SELECT SERIES(0, 4) AS t) c CROSS JOIN (SELECT SERIES(0, 47) AS g) d WHERE t < k)""",
}


def _needs(sql: str) -> list[str]:
    return list(dict.fromkeys(re.findall(r"\{(\w+)\}", sql)))


CELLS_A_PART = 1 << 10  # lattice cells, of 400 pixels each, that one task makes


def _pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of `pixels`: the lattice cells meet their nuclei, then each is exploded to its pixels.

    The statement's own grid comes from one row, so one task would make all pixels and the optimizer would hold them for a few bytes and
    broadcast them. Cells come from a range, which is split and whose size is known, and only cells are shuffled. Neither side of their join is
    broadcast: the nuclei would be held by the driver, and beside broadcast cells the few tasks that scan the nuclei would make all pixels."""
    n = 8 * int(table(spark, sf_dir, "slide").first()[0])  # the raster is 160 pixels, 8 cells, wide
    parts = max(-(-n // CELLS_A_PART), 1)
    cells = spark.range(0, n, 1, parts).select((F.col("id") % 8).alias("_i"), F.expr("id div 8").alias("_j")).withColumn("lattice", F.col("_j") * 40 + F.col("_i"))
    nuclei = table(spark, sf_dir, "nuclei").where("cell_id % 40 < 8")  # those of the raster
    met = cells.repartition(parts, "lattice").hint("merge").join(nuclei, nuclei["cell_id"] == F.col("lattice"), "left")
    each = met.withColumn("_k", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(399).cast("long"))))
    rows = each.withColumn("x", F.col("_i") * 20 + F.expr("_k div 20")).withColumn("y", F.col("_j") * 20 + F.col("_k") % 20)
    centred = rows.select("x", "y", "lattice", "cell_id", "r", F.expr("cx - (x + 0.5E0)").alias("dx"), F.expr("cy - (y + 0.5E0)").alias("dy"))
    return spark.sql(SQL["pixels"][SQL["pixels"].index("SELECT x, y, lattice, dx"):].replace("FROM d", "FROM {d}"), d=centred)


def pixels_with_pred(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pixel (x, y, label) with what `pred` has for it, null where it has no row. Each row of `pred` comes from one of `pixels`, so they are
    made together: a join of the two would make the raster twice and shuffle and sort it on both sides."""
    sql = SQL["pred"].replace("SELECT x, y,", "SELECT x, y, label,").replace("FROM {pixels} WHERE d2 IS NOT NULL", "FROM {p}")
    rows = spark.sql(sql, p=table(spark, sf_dir, "pixels"))
    made = F.col("foreground").isNotNull()  # as d2 is
    return rows.select("x", "y", "label", *[F.when(made, F.col(c)).alias(c) for c in rows.columns[3:]])


_ID = "(((l_orderkey*100000 + l_partkey)*10000 + l_suppkey)*10 + l_linenumber)*64 + CAST(l_quantity AS BIGINT)"
#: The same number on Spark. From 14.4 million orders on it may not fit in 64 bits, where the plain one would stop the query: such an id is taken
#: modulo 2^63, so that it stays a whole number that isn't negative. Ids that fit are as the statement has them.
_ANY_ID = (
    "coalesce(try_add(try_multiply(try_add(try_multiply(try_add(try_multiply(try_add(try_multiply(l_orderkey, 100000L), l_partkey), 10000L), l_suppkey), 10L), l_linenumber), 64L), CAST(l_quantity AS BIGINT)), "
    f"CAST(({_ID.replace('l_orderkey', 'CAST(l_orderkey AS DECIMAL(38,0))')}) % 9223372036854775808 AS BIGINT))"
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A fixture, or a given table, as a DataFrame."""
    if name not in SQL:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    if name == "pixels":
        return _pixels(spark, sf_dir)
    sql = re.sub(r"SERIES\(([^,]+), ([^)]+)\)", r"explode(sequence(CAST(\1 AS BIGINT), CAST(\2 AS BIGINT)))", SQL[name]).replace(_ID, _ANY_ID)
    return spark.sql(sql, **{n: table(spark, sf_dir, n) for n in _needs(sql)})


def duckdb(sql: str) -> str:
    """A DuckDB statement: {fixture} names in sql become common table expressions in front of it."""
    done: dict[str, str] = {}

    def visit(text: str) -> None:
        for n in _needs(text):
            if n in SQL and n not in done:
                visit(SQL[n])
                done[n] = re.sub(r"SERIES\(([^,]+), ([^)]+)\)", r"unnest(generate_series(CAST(\1 AS BIGINT), CAST(\2 AS BIGINT)))", re.sub(r"\{(\w+)\}", r"\1", SQL[n]))

    visit(sql)
    body = re.sub(r"\{(\w+)\}", r"\1", sql).strip()
    head = ",\n".join(f"{n} AS MATERIALIZED ({s})" for n, s in done.items())
    if not head:
        return body
    if re.match(r"WITH RECURSIVE\b", body, re.I):
        return f"WITH RECURSIVE {head},\n{body[14:].lstrip()}"
    return f"WITH {head},\n{body[4:].lstrip()}" if re.match(r"WITH\b", body, re.I) else f"WITH {head}\n{body}"
