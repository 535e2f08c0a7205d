"""Helpers shared by the operators: written intermediate tables and input columns."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.session import shared_dir


def state_path(spark: SparkSession, name: str) -> str:
    """A new path in the application's part of the shared folder."""
    return shared_dir(spark, f"{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}")


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder and read back: later plans start from
    files that all executors see, so a lost executor recomputes nothing before it. The
    tables of one application lie in one folder, to be removed after it has ended."""
    spark = df.sparkSession
    path = state_path(spark, name)
    schema = df.schema
    df.write.parquet(path)
    return spark.read.schema(schema).parquet(path)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def byte_length(text: str | Column) -> Column:
    """UTF-8 bytes of a text; null counts as empty."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")
