"""The run log: append-only events of loads that opened and closed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latest_state(events: DataFrame) -> DataFrame:
    """One row per run: when it first opened and when it last closed, null while it is open.
    Events of a run may come in any order and more than once."""
    return events.groupBy("id").agg(F.min("started_at").alias("started_at"), F.max("finished_at").alias("finished_at"))
