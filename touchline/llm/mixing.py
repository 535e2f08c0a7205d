"""Mixing sources to target weights by Pfair scheduling.

Each source's documents, in a seeded order, are cut into blocks. Block ``i`` of a
source with weight ``w`` is released at slot ``floor(i / w)`` and due at slot
``ceil((i + 1) / w)``; the earliest deadline among the released blocks takes the next
slot. Weights are whole shares of their sum, so the schedule repeats after as many
slots as the shares add up to. That one period is computed by an SQL fold and joined
to the blocks by source; everything else is arithmetic on counts.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

OWN = ["mix_source", "block", "mix_slot", "position"]
MAX_PERIOD = 10_000
HASH_BITS = 60


def period(spark: SparkSession, shares: dict[str, int]) -> DataFrame:
    """One row per source: ``slots`` it gets in a period, in order, and for each of
    these the blocks of every source that come ``before`` it, in the order of
    ``shares``."""
    total, n = sum(shares.values()), len(shares)
    if min(shares.values()) < 1 or total > MAX_PERIOD:
        raise ValueError(f"shares must be whole, at least 1, and add up to at most {MAX_PERIOD}")
    names = list(shares)
    given = spark.range(1).select(
        F.array(*[F.lit(name) for name in names]).alias("names"),
        F.array(*[F.lit(share).cast("long") for share in shares.values()]).alias("w"),
    )
    ready = (
        f"transform(sequence(0, {n - 1}), i -> if((acc.done[i] * {total}L) div w[i] <= t, "
        f"struct(((acc.done[i] + 1) * {total}L + w[i] - 1) div w[i] as due, i as source), null))"
    )
    step = (
        f"transform(array({ready}), r -> struct("
        "transform(acc.done, (d, i) -> if(i = array_min(r).source, d + 1L, d)) as done, "
        "concat(acc.picked, array(struct(array_min(r).source as source, t as slot, acc.done as before))) as picked"
        "))[0]"
    )
    start = (
        f"struct(array_repeat(0L, {n}) as done, "
        "cast(array() as array<struct<source:int,slot:bigint,before:array<bigint>>>) as picked)"
    )
    folded = given.selectExpr(
        "names",
        f"aggregate(sequence(0L, {total - 1}L), {start}, (acc, t) -> {step}, acc -> acc.picked) as picked",
    )
    return (
        folded.selectExpr("names", "inline(picked)")
        .groupBy(F.expr("names[source]").alias("mix_source"))
        .agg(F.sort_array(F.collect_list(F.struct("slot", "before"))).alias("turns"))
    )


def mixed(
    docs: DataFrame,
    shares: dict[str, int],
    rest: int,
    block_docs: int = 16,
    seed: str = "mix",
    source_col: str = "source",
    id_col: str = "doc_id",
    rows_per_bucket: int = 100_000,
) -> DataFrame:
    """The rows with ``mix_source``, ``block``, ``mix_slot`` and ``position``.

    ``shares`` are the target weights of named sources as whole numbers; ``rest`` is
    the share of all other sources together, a null source included, under the name
    ``*``. While no source is used up, the blocks of a source in the first ``T`` slots
    differ from its share of ``T`` by less than one, at every ``T``. The slots of a
    source that is used up stay empty and the others keep their proportions.
    ``position`` is the gapless place of the row in the mix, from 0. No row is dropped
    or repeated.

    Within a source rows follow the hash of ``seed`` and id, then the id; rows of one
    id in any order. Null ids share one hash. Columns of the input named like the new
    ones are replaced. An empty table gives an empty result.
    """
    docs = docs.drop(*OWN)
    columns = [F.col(f"`{c}`") for c in docs.columns]
    shares = {**shares, "*": rest}
    names, total = list(shares), sum(shares.values())
    spark = docs.sparkSession

    # Buckets of the hash: a source of any size is numbered by many tasks.
    buckets = max(1, math.ceil(docs.count() / rows_per_bucket))
    width = math.ceil(2**HASH_BITS / buckets)
    digest = F.md5(F.concat(F.lit(seed), F.lit(":"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))))
    named = F.col(source_col).isin(*[name for name in names if name != "*"])
    keyed = docs.select(
        *columns,
        F.when(named, F.col(source_col)).otherwise(F.lit("*")).alias("mix_source"),
        F.conv(F.substring(digest, 1, HASH_BITS // 4), 16, 10).cast("long").alias("_tl_hash"),
    ).withColumn("_tl_bucket", F.expr(f"_tl_hash div {width}"))

    counts = keyed.groupBy("mix_source", "_tl_bucket").agg(F.count("*").alias("_tl_n"))
    earlier = Window.partitionBy("mix_source").orderBy("_tl_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        "mix_source", "_tl_bucket", F.coalesce(F.sum("_tl_n").over(earlier), F.lit(0)).alias("_tl_from")
    )
    sizes = F.map_from_entries(F.collect_list(F.struct("mix_source", "n")))
    held = F.transform(F.array(*[F.lit(n) for n in names]), lambda s: F.coalesce(F.col("m")[s], F.lit(0)))
    totals = (
        keyed.groupBy("mix_source").agg(F.count("*").alias("n")).agg(sizes.alias("m")).select(held.alias("held"))
    )
    turns = period(spark, shares).withColumn("_tl_held", totals.scalar())

    own = Window.partitionBy("mix_source", "_tl_bucket").orderBy("_tl_hash", id_col)
    nth = keyed.withColumn("_tl_row", F.row_number().over(own) - 1).join(
        offsets, ["mix_source", "_tl_bucket"]
    )
    in_period = F.size("turns")
    return (
        nth.join(turns, "mix_source")
        .withColumn("_tl_index", F.col("_tl_from") + F.col("_tl_row"))
        .withColumn("block", F.expr(f"_tl_index div {block_docs}"))
        .withColumn("_tl_cycle", F.expr("block div size(turns)"))
        .withColumn("_tl_turn", F.expr("turns[cast(block % size(turns) as int)]"))
        .select(
            *columns,
            "mix_source",
            "block",
            (F.col("_tl_cycle") * total + F.col("_tl_turn.slot")).alias("mix_slot"),
            (_before(shares, block_docs) + F.expr(f"_tl_index % {block_docs}")).alias("position"),
        )
    )


def _before(shares: dict[str, int], block_docs: int) -> Column:
    """Rows of all sources in the slots before the row's: a source gives as many full
    blocks as it has slots there, and at most the rows it holds."""
    each = [
        f"least(_tl_held[{i}], {block_docs}L * (_tl_cycle * {share}L + _tl_turn.before[{i}]))"
        for i, share in enumerate(shares.values())
    ]
    return F.expr(" + ".join(each))
