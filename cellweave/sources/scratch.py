"""Tables written to the shared folder to cut lineage between the steps of an iteration."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch(spark: SparkSession) -> str:
    """A new path in the folder that spark.checkpoint.dir names; in a temporary one only where it is unset, as in tests."""
    top = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    return f"{top or tempfile.mkdtemp(prefix='spark-')}/{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
