"""Sharding: contiguous shards of near equal bytes from global prefix sums.

The rows are ordered by range partitioning. Each partition's total size and count are
summed up over the partitions before it, which gives every row its place on the line
of all bytes; cuts at equal targets give the shards. Only the per-partition totals,
one row per partition, meet in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from touchline.llm.tables import staged

OWN = ["shard", "slot"]


def contiguous_shards(
    rows: DataFrame, size: str, order_by: list[str | Column], n_shards: int
) -> DataFrame:
    """The rows with ``shard`` (0 to ``n_shards`` - 1) and ``slot`` (place in the shard,
    gapless from 0).

    A row goes to the shard in which the middle of its bytes falls, so each shard is
    off its equal target by at most half of the largest row at either end. Shards
    follow the order: no row of a shard comes before a row of an earlier one. A row
    larger than a target leaves neighbours empty. Null and negative sizes count as 0;
    if all sizes are 0, all rows go to shard 0. Rows that tie in the order are placed
    by the hash of the whole row, equal rows in any order. Columns ``shard`` and
    ``slot`` of the input are replaced. An empty table gives an empty result.
    """
    rows = rows.drop(*OWN)
    columns = rows.columns
    keys = [F.col(c) if isinstance(c, str) else c for c in order_by]
    keyed = rows.select(
        "*",
        F.greatest(F.coalesce(F.col(size), F.lit(0)), F.lit(0)).cast("long").alias("_tl_size"),
        F.xxhash64(*columns).alias("_tl_tie"),
        *[key.alias(f"_tl_key{i}") for i, key in enumerate(keys)],
    )
    order = [f"_tl_key{i}" for i in range(len(keys))] + ["_tl_tie"]
    # Written once: the bounds of the ranges come from a sample, and totals and rows
    # must see the same ranges.
    ranged = staged(
        keyed.repartitionByRange(*order).withColumn("_tl_part", F.spark_partition_id()), "shards"
    )
    totals = ranged.groupBy("_tl_part").agg(
        F.sum("_tl_size").alias("_tl_bytes"), F.count("*").alias("_tl_rows")
    )
    earlier = Window.orderBy("_tl_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(
        "_tl_part",
        F.coalesce(F.sum("_tl_bytes").over(earlier), F.lit(0)).alias("_tl_from"),
        F.coalesce(F.sum("_tl_rows").over(earlier), F.lit(0)).alias("_tl_nth"),
        F.sum("_tl_bytes").over(Window.partitionBy()).alias("_tl_all"),
    )
    local = Window.partitionBy("_tl_part").orderBy(*order)
    before = local.rowsBetween(Window.unboundedPreceding, -1)
    placed = (
        ranged.withColumns(
            {
                "_tl_before": F.coalesce(F.sum("_tl_size").over(before), F.lit(0)),
                "_tl_row": F.row_number().over(local) - 1,
            }
        )
        .join(starts, "_tl_part")
        .withColumn(
            "shard",
            F.expr(
                f"cast(case when _tl_all = 0 then 0 else least({n_shards - 1}, "
                f"(2 * (_tl_from + _tl_before) + _tl_size) * {n_shards} div (2 * _tl_all)) end as int)"
            ),
        )
        .withColumn("_tl_index", F.col("_tl_nth") + F.col("_tl_row"))
    )
    firsts = placed.groupBy("shard").agg(F.min("_tl_index").alias("_tl_first"))
    return placed.join(firsts, "shard").select(
        *[F.col(f"`{c}`") for c in columns],
        "shard",
        (F.col("_tl_index") - F.col("_tl_first")).alias("slot"),
    )
