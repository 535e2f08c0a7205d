"""The test mapping reads whole tables; plans drop unplayed matches themselves."""

from __future__ import annotations

import re

import pytest
from touchline.plans import player_history as hist
from touchline.operators import integrity
from touchline.plans.player_stats import player_stats
from touchline.session import shared_dir
from touchline.sources import driver_tables as data
from touchline.sources.schemas import column_names

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("facts", ["measures", "opponents", "full"])
def test_every_line_reaches_the_fact(spark, facts):
    lines = data.read(spark, SF, "lineitem").select("l_partkey", "l_orderkey").distinct().count()
    assert data.tables(spark, SF, facts).player_gameweek_stats.count() == lines


def test_unplayed_matches_reach_the_plans_and_are_dropped(spark):
    whole, played = data.tables(spark, SF, "measures"), data.tables(spark, SF, "measures", sql_rows=True)
    unplayed = whole.player_gameweek_stats.exceptAll(played.player_gameweek_stats)
    assert unplayed.count() > 0
    assert unplayed.join(whole.fixtures.filter("finished"), unplayed["fixture"] == whole.fixtures["id"]).count() == 0
    assert player_stats(whole).exceptAll(player_stats(played)).count() == 0


@pytest.mark.parametrize(
    "build",
    [
        lambda t: hist.player_history(t, last_n=3),
        lambda t: hist.player_history(t, last_n=3, include_current=False),
        lambda t: hist.points_breakdown(t, "Per Game", last_n=8),
        lambda t: hist.involvement(t),
        lambda t: hist.cumulative_long(hist.involvement(t)),
        lambda t: integrity.foreign_key_audit(t.named()),
    ],
)
def test_the_fact_is_read_once(spark, build):
    """Counted in the plan that isn't adaptive, where reused exchanges are shown as such."""
    kept = {key: spark.conf.get(key) for key in ("spark.sql.adaptive.enabled", "spark.sql.maxMetadataStringLength")}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.maxMetadataStringLength", "500")
    try:
        plan = build(data.tables(spark, SF, "opponents"))._jdf.queryExecution().executedPlan().toString()
    finally:
        for key, value in kept.items():
            spark.conf.set(key, value)
    assert len(re.findall(r"FileScan parquet[^\n]*lineitem\.parquet", plan)) == 1


@pytest.mark.parametrize("entity", ["teams", "gameweeks", "players", "fixtures"])
def test_full_width_adds_to_the_mapping(spark, entity):
    mapped = data.tables(spark, SF).named()[entity]
    full = data.full_width(mapped, entity)
    assert set(full.columns) == set(column_names(entity))
    assert full.select(*mapped.columns).exceptAll(mapped).isEmpty()
    added = full.select([c for c in full.columns if c not in mapped.columns])
    assert all(added.filter(f"{c} is not null").count() for c in added.columns)


def test_a_cluster_has_to_name_its_shared_folder():
    class Session:
        def __init__(self, **settings):
            self.conf = {key.replace("_", "."): value for key, value in settings.items()}

    assert shared_dir(Session(spark_checkpoint_dir="/s", spark_master="yarn"), "a") == "/s/a"
    local = Session(spark_sql_warehouse_dir="/w", spark_master="local[2]")
    assert shared_dir(local, "a") == "/w/touchline-state/a"
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(Session(spark_sql_warehouse_dir="/w", spark_master="spark://h:1"), "a")
