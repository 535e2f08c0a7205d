"""Running totals that do not put a whole key into one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from touchline.operators.selection import same_columns

_CHUNK = "_chunk"
# Ids per chunk. A chunk of one key and one step holds at most this many rows,
# because (key, id) is unique.
CHUNK_WIDTH = 1 << 22


def running_totals(
    rows: DataFrame,
    key: str,
    step: str,
    unique_id: str,
    totals: dict[str, str],
    chunk_width: int = CHUNK_WIDTH,
) -> DataFrame:
    """Add running sums per ``key`` in order of (``step``, ``unique_id``).

    ``totals`` maps new column -> summed column. Every row is its own frame step,
    also when two rows share a ``step``. ``unique_id`` is a whole-number id that is
    unique within ``key``.

    The order is cut into blocks (key, step, range of ids). Rows are summed within
    their block, block totals are summed over the key, and each block gets the sum
    of the blocks before it. Both levels are windows of bounded size however many
    rows one key has. Rows without a key, step or id are left out. The rows are placed once by block; both uses take the same columns
    from that exchange, so it is computed once.
    """
    block = [key, step, _CHUNK]
    chunked = rows.withColumn(_CHUNK, F.floor(F.col(unique_id) / F.lit(chunk_width)))
    placed = chunked.filter(" and ".join(f"{name} is not null" for name in block)).repartition(*block)

    inside = (
        Window.partitionBy(*block)
        .orderBy(unique_id)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    earlier = (
        Window.partitionBy(key)
        .orderBy(step, _CHUNK)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    sums = [F.sum(source).alias(f"_sum_{name}") for name, source in totals.items()]
    blocks = same_columns(placed.groupBy(*block), rows.columns, *sums)
    offsets = blocks.select(
        *block,
        *[
            F.coalesce(F.sum(f"_sum_{name}").over(earlier), F.lit(0)).alias(f"_before_{name}")
            for name in totals
        ],
    )
    local = placed.withColumns({name: F.sum(source).over(inside) for name, source in totals.items()})
    return local.join(offsets, block).select(
        *rows.columns,
        *[
            F.when(
                F.col(source).isNotNull(),
                F.col(f"_before_{name}") + F.coalesce(F.col(name), F.lit(0)),
            ).alias(name)
            for name, source in totals.items()
        ],
    )
