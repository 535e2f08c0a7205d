"""Incremental load: files that land are merged as they come.

Each run takes everything that is new (``availableNow``) and ends. The name of a batch is
written with the commit of its rows, so a batch that is replayed after a failure is
recognised. Records that a batch can't take are written beside the table, under
``rejects/<table>/<stream>/batch=<n>``, replaced when the batch is replayed.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from touchline.operators.contract import ContractError, accepted, rejects, validate
from touchline.operators.integrity import require_references
from touchline.operators.merge import key_counts, latest_per_key
from touchline.plans.load import stage, without_settled_text
from touchline.session import released_shuffles, shared_dir
from touchline.sources import landing
from touchline.sources.schemas import KEYS, REFERENCES, column_names
from touchline.sources.store import TableStore, remove

FACTS = "player_gameweek_stats"


def upsert_stream(
    stream: DataFrame, store: TableStore, entity: str, name: str,
    to_rows: Callable[[DataFrame, str, int], DataFrame],
) -> StreamingQuery:
    """Merge ``to_rows(batch, staging path, batch id)`` into the table, batch by batch, each
    once.

    Progress is kept in the shared folder of the session, under ``name``.
    """

    def apply(batch: DataFrame, batch_id: int) -> None:
        store_here = replace(store, spark=batch.sparkSession)
        label = f"{name}/{batch_id}"
        if store_here.applied(entity, label):
            return
        staging = f"{store.root}/staging/{name}/batch={batch_id}"
        with released_shuffles(batch.sparkSession):
            rows = to_rows(batch, staging, batch_id)
        store_here.upsert(entity, rows, batch=label)
        remove(batch.sparkSession, staging)

    return (
        stream.writeStream.queryName(name)
        .option("checkpointLocation", shared_dir(stream.sparkSession, f"streams/{name}"))
        .trigger(availableNow=True)
        .foreachBatch(apply)
        .start()
    )


def rejects_path(store: TableStore, name: str) -> str:
    return f"{store.root}/rejects/{FACTS}/{name}"


def batch_rejects(checked: DataFrame, entity: str) -> DataFrame:
    """Failures of the contract, and records with fields that no table has."""
    known = F.array(*[F.lit(name) for name in column_names(entity)])
    unknown = F.array_sort(F.array_except(F.json_object_keys("_record"), known))
    good = checked.filter("errors = '' and table_errors = ''").withColumn("_unknown", unknown)
    new = good.filter(F.size("_unknown") > 0).select(
        F.lit(entity).alias("label"),
        F.col("_doc").alias("doc"),
        F.col("_pos").alias("row"),
        F.coalesce(F.get_json_object("_record", "$.id"), F.lit("?")).alias("id"),
        F.concat(F.lit("unknown fields: "), F.array_join("_unknown", ", ")).alias("reasons"),
    )
    return rejects(checked, entity).unionByName(new)


def latest_rows(rows: DataFrame, keys: list[str], order: list[str], staging: str) -> DataFrame:
    """``latest_per_key`` of rows of which few or none repeat a key. The keys that do are
    written first, and only their rows are put together; if there are any, the result is
    staged. Keys have no nulls."""
    key_counts(rows, keys).filter("n > 1").select(*keys).write.mode("overwrite").parquet(f"{staging}/repeated")
    repeated = rows.sparkSession.read.schema(rows.select(*keys).schema).parquet(f"{staging}/repeated")
    several = rows.join(repeated, keys, "left_semi").select(*rows.columns)
    single = rows.join(repeated, keys, "left_anti").select(*rows.columns)
    latest = single.unionByName(latest_per_key(several, keys, F.struct(*order)))
    return latest if repeated.isEmpty() else stage(latest, f"{staging}/latest")


def load_histories(
    store: TableStore, path: str, name: str = "histories", lines: bool = False, keep_going: bool = False, references: bool = True,
) -> StreamingQuery:
    """Match records of landed history documents. If a player's document landed more than
    once in a batch, the later file wins.

    A batch with rejects fails before anything is merged; with ``keep_going`` its other
    records are merged. ``references`` requires the rows that records refer to in the
    store.
    """

    def checked_rows(batch: DataFrame, staging: str, batch_id: int) -> DataFrame:
        spark = batch.sparkSession
        checked = stage(without_settled_text(validate(landing.history_records(batch), FACTS), FACTS), f"{staging}/checked")
        sink = f"{rejects_path(store, name)}/batch={batch_id}"
        batch_rejects(checked, FACTS).write.mode("overwrite").parquet(sink)
        refused = spark.read.parquet(sink)
        if not keep_going and not refused.isEmpty():
            first = refused.orderBy("doc", "row").first()
            raise ContractError(f"{refused.count()} records refused, see {sink}; the first, record {first.row} of {first.doc}: {first.reasons}")
        columns = column_names(FACTS)
        rows = accepted(checked, FACTS, "_landed_at", "_doc", "_pos").join(
            refused.select(F.col("doc").alias("_doc"), F.col("row").alias("_pos")), ["_doc", "_pos"], "left_anti"
        )
        rows = latest_rows(rows, KEYS[FACTS], ["_landed_at", "_doc", "_pos"], staging).select(*columns)
        if references:
            here = replace(store, spark=spark)
            parents = {parent for child, _, parent in REFERENCES if child == FACTS}
            nothing = {parent: here.read(parent).limit(0) for parent in parents}
            require_references({**nothing, FACTS: rows}, {parent: here.read(parent) for parent in parents})
        return rows

    stream = landing.stream_documents(store.spark, path, lines)
    return upsert_stream(stream, store, FACTS, name, checked_rows)


def load_rows(
    stream: DataFrame, store: TableStore, entity: str, name: str,
    to_rows: Callable[[DataFrame], DataFrame],
) -> StreamingQuery:
    """Merge an already tabular stream, reshaped by ``to_rows``, staged per batch."""
    return upsert_stream(
        stream, store, entity, name, lambda batch, staging, _: stage(to_rows(batch), staging)
    )
