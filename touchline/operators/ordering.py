"""The place of every row in a global order, without sorting everything in one task."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from touchline.session import shared_dir

_FILE, _ROW, _START = "_order_file", "_order_row", "_order_start"


def ranked(df: DataFrame, order: list[str | Column], name: str = "place") -> DataFrame:
    """``df`` with the place of each row from 1 on, as a column ``name``.

    The sort cuts the rows into ranges and writes them, one file or more per range. A row's
    place is its place in the file plus the rows of the files before, so only one count
    per file meets in one task. The order must leave no ties, else tied rows are placed
    in any order.
    """
    spark = df.sparkSession
    path = shared_dir(spark, f"ordered/{uuid.uuid4().hex}")
    df.orderBy(*order).write.parquet(path)
    rows = spark.read.schema(df.schema).parquet(path).select(
        "*", F.col("_metadata.file_name").alias(_FILE), F.col("_metadata.row_index").alias(_ROW)
    )
    # file names carry the number of the range first
    number = F.regexp_extract(_FILE, r"part-(\d+)", 1).cast("long")
    before = Window.orderBy("_number", _FILE).rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy(_FILE).agg(F.count(F.lit(1)).alias("_rows"))
    starts = counts.withColumn("_number", number).select(
        _FILE, F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias(_START)
    )
    return rows.join(starts, _FILE).select(*df.columns, (F.col(_START) + F.col(_ROW) + 1).alias(name))
