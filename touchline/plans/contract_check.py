"""Contract check: runs before the load, writes nothing but (on request) snapshots.

Types and required fields are checked for every record of every landed document; keys
are compared with the snapshot. Histories may be empty early in a season.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from touchline.operators.contract import rejects, require_valid, validate
from touchline.operators.drift import new_field_report, require_known, write_snapshot
from touchline.plans.load import LandingPaths, landed_records, union_all


def _all_rejects(records: dict[str, DataFrame]) -> DataFrame:
    return union_all([rejects(validate(frame, entity), entity) for entity, frame in records.items()])


def contract_findings(records: dict[str, DataFrame], snapshots: dict[str, DataFrame] | None = None) -> DataFrame:
    """What ``check_contract`` would raise for, as rows (``label``, ``id``, ``finding``): one per
    refused record, with its id as given, and one per new field."""
    example = "coalesce(concat(', as in ', example), '')"
    return (
        _all_rejects(records)
        .selectExpr("label", "id", "reasons as finding")
        .unionByName(
            new_field_report(records, snapshots).selectExpr(
                "label", "cast(null as string) as id", f"concat('new field ', field, {example}) as finding"
            )
        )
    )


def check_contract(
    spark: SparkSession, paths: LandingPaths, snapshots: dict[str, DataFrame] | None = None
) -> None:
    """Raise on invalid records, then on new fields."""
    records = landed_records(spark, paths)
    require_valid(_all_rejects(records))
    require_known(records, snapshots)


def refresh_snapshots(spark: SparkSession, paths: LandingPaths, root: str) -> None:
    """Accept the present keys: one sorted list per entity under ``root``."""
    for entity, frame in landed_records(spark, paths).items():
        write_snapshot(frame, f"{root}/{entity}")
