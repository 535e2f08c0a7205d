"""A training corpus from ``documents`` in five stages.

Each stage takes the documents its predecessor kept, written as Parquet and read again,
and returns those it keeps with the columns of ``documents``; the last one returns the
shard and slot of each document.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from touchline.llm import decontamination, mixing, near_duplicates, quality, sharding
from touchline.llm.queries import N_SHARDS, REST, SHARES
from touchline.llm.tables import byte_length, read, staged

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: The labels come from a trained field and the index search has no SQL form; the
#: pipeline is tested against brute force instead.
ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that fail the base rules or are mostly boilerplate lines.
    Null, empty and blank texts fail; repeated rows are judged alike."""
    field = quality.train(docs, read(spark, sf_dir, "labels"))
    return quality.with_quality(docs, field, only_kept=True)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group of near-duplicates: five-word
    shingles with a similarity of 0.8. Of rows that repeat an id and text one stays. Texts
    without words are near nothing and stay; so do rows without an id, unless their text
    is that of a row that stays."""
    found = near_duplicates.near_duplicates(docs).filter("kept")
    keys = {"_tl_id": F.coalesce("doc_id", F.lit(-(2**63))), "_tl_null": F.col("doc_id").isNull()}
    kept = found.withColumns(keys).select(*keys, F.col("text_hash").alias("_tl_hash"), "n_shingles").distinct()
    kept = kept.withColumnRenamed("n_shingles", "_tl_size")
    rows = docs.withColumns({**keys, "_tl_hash": F.xxhash64("text")})
    on = [*keys, "_tl_hash"]
    # A merge join at every size, since both sides grow with the documents.
    joined = rows.join(kept.hint("merge"), on)
    nth = F.row_number().over(Window.partitionBy(*on).orderBy(F.xxhash64(*docs.columns)))
    return joined.withColumn("_tl_nth", nth).filter("_tl_nth = 1 or _tl_size = 0").select(*docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that hold a benchmark item. Null and empty texts stay."""
    items = decontamination.question_and_answer(read(spark, sf_dir, "benchmark"))
    return decontamination.clean(docs, items)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, written in the order of the mix of their sources: the files, and the
    rows in them, follow the position."""
    rows = docs.select("doc_id", "source", F.struct(*docs.columns).alias("_tl_doc"))
    mixed = mixing.mixed(rows, SHARES, REST)
    ordered = mixed.repartitionByRange("position").sortWithinPartitions("position")
    return ordered.select(*[F.col("_tl_doc")[name].alias(name) for name in docs.columns])


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contiguous shards of near equal bytes in the order in which the documents are
    written. Documents that don't come from files are taken in the order of their id."""
    try:
        written = [
            F.regexp_extract("_metadata.file_name", r"part-(\d+)", 1).try_cast("long"),
            F.col("_metadata.file_name"),
            F.col("_metadata.row_index"),
        ]
        keyed = docs.select("*", *[c.alias(f"_tl_at{i}") for i, c in enumerate(written)])
        _ = keyed.schema
        order = ["_tl_at0", "_tl_at1", "_tl_at2"]
    except AnalysisException:
        keyed, order = docs, ["doc_id"]
    rows = keyed.select("doc_id", "source", (byte_length("text") + 8).alias("size"), *[c for c in order if c != "doc_id"])
    placed = sharding.contiguous_shards(rows, "size", order, N_SHARDS)
    return placed.select("doc_id", "source", "size", "shard", "slot")


STAGES: list[tuple[str, Stage]] = [
    ("quality rules", quality_rules),
    ("near-duplicates", near_dedup),
    ("decontamination", decontaminate),
    ("mixing", mix),
    ("sharding", shard),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
