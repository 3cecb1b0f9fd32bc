"""Helpers shared by the operators of this subpackage: scratch tables, hashing of ids, connected components."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BITMAP = 1 << 22


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def scratch(spark: SparkSession) -> str:
    """A new folder in the shared folder the cluster names; a temporary one only where none is set, as in tests."""
    top = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    return f"{top or tempfile.mkdtemp(prefix='spark-')}/{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage, survives lost executors."""
    path = scratch(df.sparkSession)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remainder(id_col, modulus: int):
    """crc32 of the id as text, modulo modulus; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % modulus


def bitmap(ids: DataFrame, size: int) -> np.ndarray:
    """Bits of the hashed ids: a fixed number of words, whatever the number of ids."""
    at = F.pmod(F.xxhash64("id"), F.lit(size))
    words = ids.select(F.floor(at / 32).cast("int").alias("w"), F.call_function("shiftleft", F.lit(1).cast("long"), (at % 32).cast("int")).alias("bit")).groupBy("w").agg(F.bit_or("bit").alias("bits"))
    out = np.zeros(size // 32, np.uint32)
    for r in words.toLocalIterator():
        out[r["w"]] = r["bits"]
    return out


def _needed(bits: np.ndarray):
    def run(batches):
        set_ = np.unpackbits(bits.view(np.uint8), bitorder="little").view(bool)
        for b in batches:
            yield b.select(["id", "text"]).filter(pa.array(set_[b.column("at").to_numpy()]))

    return run


def texts_of(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows (id long, text) that a later join with ids can need: a bitmap of the hashed ids, BITMAP bits whatever their number,
    spares most other texts the shuffle. Rows of other ids may pass."""
    at = F.pmod(F.xxhash64("id"), F.lit(BITMAP)).cast("int")
    return rows.select("id", "text").withColumn("at", at).mapInArrow(_needed(bitmap(ids, BITMAP)), "id long, text string")


def components(edges: DataFrame) -> DataFrame:
    """Connected components of edges (a, b): rows (id, component_id), component_id the least id of the component.

    Each round maps every node to the neighbour (or itself) that comes first in a hash order drawn anew, and
    relabels the edges by that map, so the graph shrinks by a constant share whatever its shape. Ids that no edge
    touches aren't returned; self-loops and repeated edges are allowed. All state stays in Spark tables.
    """
    spark = edges.sparkSession
    first = edges.where("a IS NOT NULL AND b IS NOT NULL").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    left, maps, turn = stored(first), [], 0
    nodes = left.select(F.col("a").alias("id")).union(left.select("b")).distinct()
    left = left.where("a <> b")
    while not left.isEmpty():
        order = lambda c, t=turn: F.struct(F.xxhash64(F.col(c), F.lit(t)).alias("h"), F.col(c).alias("v"))
        both = left.union(left.select("b", "a"))
        step = stored(both.groupBy("a").agg(F.min(order("b")).alias("m")).select(F.col("a").alias("id"), F.least(order("a"), "m")["v"].alias("to")))
        maps.append(step)
        for c in ("a", "b"):
            left = left.join(step.withColumnRenamed("id", c), c).drop(c).withColumnRenamed("to", c)
        left = stored(left.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
        turn += 1
    found = nodes.withColumn("root", F.col("id"))
    for step in maps:
        found = found.join(step.select(F.col("id").alias("root"), "to"), "root", "left").select("id", F.coalesce("to", "root").alias("root"))
    found = stored(found)
    least = found.groupBy("root").agg(F.min("id").alias("component_id"))
    return found.join(least, "root").select("id", "component_id")
