"""Renamed and typed views over the raw tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.functions import scoring as S
from touchline.functions.rounding import numeric
from touchline.sources.schemas import column_names

# Renamed columns and text columns that hold numbers.
PLAYER_RENAMES = {"second_name": "last_name", "team": "team_id"}
PLAYER_NUMERIC = [
    "price_change_percent", "ep_next", "ep_this", "form", "points_per_game",
    "selected_by_percent", "value_form", "value_season", "influence", "creativity",
    "threat", "ict_index", "expected_goals", "expected_assists",
    "expected_goal_involvements", "expected_goals_conceded",
]
FIXTURE_RENAMES = {"event": "gameweek_id", "team_a": "team_a_id", "team_h": "team_h_id"}
MATCH_RENAMES = {
    "element": "player_id", "fixture": "fixture_id",
    "opponent_team": "opponent_team_id", "round": "gameweek_id",
}
MATCH_NUMERIC = [
    "influence", "creativity", "threat", "ict_index", "expected_goals",
    "expected_assists", "expected_goal_involvements", "expected_goals_conceded",
]


def _project(
    df: DataFrame, entity: str, renames: dict[str, str], numbers: list[str],
    derived: dict[str, str],
) -> DataFrame:
    """Columns of ``entity`` that ``df`` has, renamed and cast; each derived
    column follows the column it is named after."""
    have = set(df.columns)
    columns = []
    for name in column_names(entity):
        if name in have:
            value = numeric(name) if name in numbers else f"`{name}`"
            columns.append(f"{value} as `{renames.get(name, name)}`")
            if name in derived:
                columns.append(derived[name])
    return df.selectExpr(*columns)


def teams(raw: DataFrame) -> DataFrame:
    return _project(raw, "teams", {}, [], {})


def gameweeks(raw: DataFrame) -> DataFrame:
    return _project(raw, "gameweeks", {}, [], {})


def price(tenths: str) -> str:
    return f"cast({tenths} / 10 as decimal(12,1))"


def players(raw: DataFrame) -> DataFrame:
    derived = {"now_cost": f"{price('now_cost')} as price"}
    return _project(raw, "players", PLAYER_RENAMES, PLAYER_NUMERIC, derived)


def fixtures(raw: DataFrame) -> DataFrame:
    return _project(raw, "fixtures", FIXTURE_RENAMES, [], {})


def match_rows(raw: DataFrame) -> DataFrame:
    """The fact, renamed and cast, before any lookup."""
    derived = {"value": f"{price('value')} as match_price"}
    return _project(raw, "player_gameweek_stats", MATCH_RENAMES, MATCH_NUMERIC, derived)


def with_units(rows: DataFrame) -> DataFrame:
    """Adds the expected values as whole numbers, the form the scoring model takes."""
    return rows.selectExpr("*", *[f"{sql} as {name}" for name, sql in S.expected_units().items()])


def player_gameweek_stats(
    raw_matches: DataFrame, raw_fixtures: DataFrame, raw_players: DataFrame
) -> DataFrame:
    """The fact with difficulty from the player's side and expected points.

    No join hints: a small dimension is broadcast by its measured size, a large
    one is sort-merge joined and a hot key is split by the adaptive planner.
    """
    matches = match_rows(raw_matches)
    difficulty = raw_fixtures.selectExpr(
        "id as fixture_id", "team_h_difficulty as _home", "team_a_difficulty as _away"
    )
    positions = raw_players.selectExpr("id as player_id", "element_type as _position")
    joined = with_units(matches).join(difficulty, "fixture_id").join(positions, "player_id")
    return joined.selectExpr(
        *matches.columns,
        f"{S.fixture_difficulty('_home', '_away')} as fdr",
        f"{S.as_points(S.expected_points('_position'))} as xpts",
    )


def team_names(raw_teams: DataFrame) -> DataFrame:
    return raw_teams.selectExpr("id as team_id", "short_name")


def team_list(raw_teams: DataFrame) -> DataFrame:
    """Short names for the team selector, sorted."""
    return raw_teams.select("short_name").orderBy("short_name")


def etl_last_updated(runs: DataFrame) -> DataFrame:
    """Finish time of the latest completed load, at most one row."""
    return (
        runs.select("finished_at")
        .filter(F.col("finished_at").isNotNull())
        .orderBy(F.desc("finished_at"))
        .limit(1)
    )
