"""The five raw tables derived from the star-schema test tables.

Roles: customer -> team, ``o_orderkey % 38`` -> gameweek, orders -> fixture,
part -> player, lineitem grouped by (part, order) -> fact. Keys are 0-based and
dense. Columns that are not derived here are left out; ``schemas.conform`` adds
them with their table defaults, ``full_width`` with values made from the key.
"""

from __future__ import annotations

import os
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from touchline.operators.views import PLAYER_NUMERIC
from touchline.plans.tables import RawTables
from touchline.sources.schemas import fields

GAMEWEEKS = 38
FINISHED_GAMEWEEKS = 30


_SCHEMAS: dict[str, StructType] = {}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A test table. Its schema is read from the files once per path: every later
    read skips the job that infers it."""
    path = os.path.join(sf_dir, f"{name}.parquet")
    if path not in _SCHEMAS:
        _SCHEMAS[path] = spark.read.parquet(path).schema
    return spark.read.schema(_SCHEMAS[path]).parquet(path)


def _with_team_count(spark: SparkSession, sf_dir: str, df: DataFrame) -> DataFrame:
    """Adds the number of teams, as a scalar subquery."""
    teams = read(spark, sf_dir, "customer").agg(F.count(F.lit(1))).scalar()
    return df.withColumn("team_count", teams)


def raw_teams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "customer").selectExpr(
        "c_custkey + 1 as id",
        "c_custkey * 3 + 100 as code",
        "c_name as name",
        "concat('T', lpad(c_custkey + 1, greatest(6, length(c_custkey + 1)), '0')) as short_name",
        "cast(c_custkey % 5 + 1 as int) as strength",
    )


def raw_gameweeks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At most 38 rows by construction (the group key is ``% 38``), which is the
    proven bound behind the broadcast hint; the planner could only see the size of
    the orders below the aggregate."""
    weeks = (
        read(spark, sf_dir, "orders")
        .groupBy(F.expr(f"cast(o_orderkey % {GAMEWEEKS} as int) as week"))
        .agg(F.min("o_orderdate").alias("deadline_time"))
    )
    return F.broadcast(
        weeks.selectExpr(
            "week + 1 as id",
            "concat('Gameweek ', week + 1) as name",
            "deadline_time",
            f"week < {FINISHED_GAMEWEEKS} as finished",
            f"week = {FINISHED_GAMEWEEKS - 1} as is_previous",
            f"week = {FINISHED_GAMEWEEKS} as is_current",
            f"week = {FINISHED_GAMEWEEKS + 1} as is_next",
        )
    )


def raw_fixtures(
    spark: SparkSession, sf_dir: str, orders: DataFrame | None = None
) -> DataFrame:
    """``orders`` may be given instead of read, e.g. a batch of a stream."""
    if orders is None:
        orders = read(spark, sf_dir, "orders")
    week = f"o_orderkey % {GAMEWEEKS}"
    scheduled = "o_orderkey % 97 <> 5"
    played = f"({scheduled} and {week} < {FINISHED_GAMEWEEKS})"
    current = f"({scheduled} and {week} = {FINISHED_GAMEWEEKS} and o_orderkey % 4 = 0)"
    return _with_team_count(spark, sf_dir, orders).selectExpr(
        "o_orderkey + 1 as id",
        "o_orderkey * 7 + 1 as code",
        f"case when {scheduled} then cast({week} + 1 as int) end as event",
        "o_orderdate as kickoff_time",
        f"{played} or {current} as finished",
        "o_custkey + 1 as team_h",
        "(o_custkey + 1 + o_orderkey % 17) % team_count + 1 as team_a",
        f"case when {played} then cast(o_orderkey % 5 as int) end as team_h_score",
        f"case when {played} then cast(o_orderkey % 3 as int) end as team_a_score",
        "cast(o_custkey % 5 + 1 as int) as team_h_difficulty",
        "cast(o_orderkey % 4 + 2 as int) as team_a_difficulty",
    )


def raw_players(spark: SparkSession, sf_dir: str) -> DataFrame:
    others = [name for name in PLAYER_NUMERIC if name != "selected_by_percent"]
    return _with_team_count(spark, sf_dir, read(spark, sf_dir, "part")).selectExpr(
        "p_partkey + 1 as id",
        "cast(p_partkey % 4 + 1 as int) as element_type",
        "p_partkey % team_count + 1 as team",
        "p_brand as first_name",
        "p_type as second_name",
        "p_name as web_name",
        "p_size + 40 as now_cost",
        "concat(p_size, '.', p_partkey % 10) as selected_by_percent",
        *[
            f"concat(p_partkey * {step} % 89, '.', p_partkey % 10) as {name}"
            for step, name in enumerate(others, start=3)
        ],
    )


def _match_base(spark: SparkSession, sf_dir: str, sql_rows: bool) -> DataFrame:
    """One row per (part, order). The aggregate pre-combines map-side and its key is
    the pair, so neither a hot part nor a hot order ends up in one task.

    ``sql_rows``: without orders that have no gameweek or one after the current, the
    rows that the SQL of the queries showing single rows of the fact has.
    """
    lines = read(spark, sf_dir, "lineitem")
    if sql_rows:
        lines = lines.filter(f"l_orderkey % 97 <> 5 and l_orderkey % {GAMEWEEKS} <= {FINISHED_GAMEWEEKS}")
    return (
        lines.groupBy("l_partkey", "l_orderkey")
        .agg(
            F.expr("cast(max(l_quantity) as int) as q"),
            F.expr("cast(round(max(l_discount) * 100) as int) as d"),
            F.expr("cast(round(max(l_tax) * 100) as int) as t"),
            F.expr("max(l_linenumber) as ln"),
            F.expr("max(l_shipdate) as ship"),
        )
        .selectExpr("l_partkey + 1 as element", "l_orderkey + 1 as fixture", "q", "d", "t", "ln", "ship")
    )


def _hundredths(value: str) -> str:
    """Whole hundredths as decimal text: 45 -> ``0.45``."""
    return f"concat(({value}) div 100, '.', lpad(({value}) % 100, 2, '0'))"


def _measures(base: DataFrame, *looked_up: str) -> DataFrame:
    """The measures of the rows of ``_match_base``, then the columns of a lookup. A projection
    only: it stands above the joins, so that these move the few columns of the base."""

    def flag(condition: str) -> str:
        return f"case when {condition} then 1 else 0 end"

    goals = "case when ln >= 6 then ln - 5 else 0 end"
    return (
        base
        .selectExpr(
            "*",
            "case when q <= 10 then 0 when q <= 45 then q * 2 else 90 end as minutes",
            "case when q % 25 = 7 then null else d * t * 3 end as xg",
            "d * 11 as xa",
            "t * 40 + d * 3 as xgc",
        )
        .selectExpr(
            "element",
            "fixture",
            f"cast((fixture - 1) % {GAMEWEEKS} + 1 as int) as round",
            "ln % 2 = 1 as was_home",
            "ship as kickoff_time",
            "minutes",
            f"{flag('minutes >= 60')} as starts",
            f"{goals} as goals_scored",
            f"{flag('d >= 9')} as assists",
            f"{flag('minutes >= 60 and t % 5 = 0')} as clean_sheets",
            "t % 5 as goals_conceded",
            f"{flag('d = 10 and t = 3')} as own_goals",
            f"{flag('ln = 7 and t = 1')} as penalties_saved",
            f"{flag('ln = 7 and t = 2')} as penalties_missed",
            f"{flag('t = 8')} as yellow_cards",
            f"{flag('t = 7 and d = 0')} as red_cards",
            "d as saves",
            "(q + d) % 4 as bonus",
            "q + d as bps",
            "q % 16 as defensive_contribution",
            "case when minutes >= 60 then 2 when minutes >= 1 then 1 else 0 end"
            f" + (q + d) % 4 + {goals} * 4 + {flag('d >= 9')} * 3 as total_points",
            f"{_hundredths('xg')} as expected_goals",
            f"{_hundredths('xa')} as expected_assists",
            f"{_hundredths('coalesce(xg, 0) + xa')} as expected_goal_involvements",
            f"{_hundredths('xgc')} as expected_goals_conceded",
            "concat(q, '.', t) as influence",
            "concat(d, '.', t) as creativity",
            "concat(t, '.', d % 10) as threat",
            "concat(ln, '.', t) as ict_index",
            *looked_up,
        )
    )


def match_measures(spark: SparkSession, sf_dir: str, sql_rows: bool = False) -> DataFrame:
    """The fact without the columns that come from a lookup (opponent, scores, value).

    Enough for every per-player aggregate, which then shuffles the fact only to
    group it and to test its fixture.
    """
    return _measures(_match_base(spark, sf_dir, sql_rows))


def _looked_up(spark: SparkSession, sf_dir: str, price: bool, sql_rows: bool) -> tuple[DataFrame, list[str]]:
    """The base with opponent and scores from the fixture and, with ``price``, the player's
    value, and the names of these columns. The player is looked up first, so that a later
    fixture join of the plan finds the rows placed by fixture already."""
    rows = _match_base(spark, sf_dir, sql_rows)
    if price:
        part = read(spark, sf_dir, "part")
        rows = rows.join(part.selectExpr("p_partkey + 1 as element", "p_size + 40 as value"), "element")
    match = raw_fixtures(spark, sf_dir).selectExpr(
        "id as fixture", "team_h", "team_a", "team_h_score", "team_a_score"
    )
    rows = rows.join(match, "fixture").selectExpr(
        "*", "case when ln % 2 = 1 then team_a else team_h end as opponent_team"
    )
    return rows.drop("team_h", "team_a"), [*(["value"] if price else []), "team_h_score", "team_a_score", "opponent_team"]


def raw_player_gameweek_stats(
    spark: SparkSession, sf_dir: str, price: bool = True, sql_rows: bool = False
) -> DataFrame:
    """The fact with opponent and scores from the fixture and, with ``price``, the
    player's value."""
    rows, looked_up = _looked_up(spark, sf_dir, price, sql_rows)
    return _measures(rows, *looked_up).selectExpr("fixture", "element", "* except (fixture, element)")


#: Values of a column that the mapping lacks, by type, from a whole number ``n``.
MADE = {
    "int": "cast(n % 97 as int)",
    "bigint": "cast(n as bigint)",
    "boolean": "n % 3 = 0",
    "string": "concat('text ', n % 50)",
    "decimal(18,4)": "cast((n % 977) / 100 as decimal(18,4))",
    "timestamp": "cast(date_add(date'2024-01-01', cast(n % 900 as int)) as timestamp_ntz)",
    "date": "date_add(date'1980-01-01', cast(n % 9000 as int))",
}


def full_width(rows: DataFrame, entity: str, key: str = "id") -> DataFrame:
    """The rows with all columns of ``entity``. Those that they lack are made from the key
    times the column's place; a column that may be null is so where that leaves 3 by 7."""
    made = []
    for place, field in enumerate(fields(entity), start=1):
        if field.name not in rows.columns:
            n = f"({key} * {place})"
            value = re.sub(r"\bn\b", n, MADE[field.type.simpleString()])
            made.append(f"{value if field.not_null else f'case when {n} % 7 <> 3 then {value} end'} as {field.name}")
    return rows.selectExpr("*", *made)


def raw_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Run log stand-in: an event of type ``error`` is a run that never finished."""
    return read(spark, sf_dir, "events").selectExpr(
        "event_id as id",
        "ts as started_at",
        "case when event_type <> 'error' then ts end as finished_at",
    )


def tables(spark: SparkSession, sf_dir: str, facts: str = "full", sql_rows: bool = False) -> RawTables:
    """``facts``: ``measures`` (no lookups), ``opponents`` (fixture lookup) or ``full``."""
    if facts == "measures":
        matches = match_measures(spark, sf_dir, sql_rows)
    else:
        matches = raw_player_gameweek_stats(spark, sf_dir, price=facts == "full", sql_rows=sql_rows)
    return RawTables(
        teams=raw_teams(spark, sf_dir),
        gameweeks=raw_gameweeks(spark, sf_dir),
        players=raw_players(spark, sf_dir),
        fixtures=raw_fixtures(spark, sf_dir),
        player_gameweek_stats=matches,
        etl_runs=raw_runs(spark, sf_dir),
    )
