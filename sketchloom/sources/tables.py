"""Work tables: intermediate results as Parquet in a folder that all machines share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def new_path(spark: SparkSession, name: str) -> str:
    """A new path in ``spark.checkpoint.dir``; where that is unset, in the warehouse."""
    base = spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/work-tables"
    return f"{base.rstrip('/')}/sketchloom/{uuid.uuid4().hex}-{name}"


def table(df: DataFrame, name: str) -> DataFrame:
    """``df`` written and read again: nothing before it is computed twice, or lost with an executor."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
