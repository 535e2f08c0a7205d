"""Match history of players: one row per finished match, the window of newest
gameweeks, the points breakdown and the running involvement totals.

Every function covers all players at once; ``player_id`` narrows to one and is
pushed into the fact scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.functions import scoring as S
from touchline.functions.labels import outcome, score_text, venue, versus
from touchline.functions.rounding import float_round
from touchline.operators import aggregates as A
from touchline.operators.ordering import ranked
from touchline.operators.running import running_totals
from touchline.operators.selection import (
    finished_matches,
    newest_gameweeks_per_player,
    next_gameweek,
)
from touchline.operators.views import match_rows, with_units
from touchline.plans.tables import RawTables

# Column order of the history and of the displayed history.
HISTORY_COLUMNS = [
    "gameweek_id", "opponent", "opponent_code", "was_home", "home_score", "away_score",
    "pts", "starts", "minutes", "goals_scored", "assists", "xg", "xa", "xgi", "cs",
    "goals_conceded", "xgc", "own_goals", "penalties_saved", "penalties_missed",
    "yellow_cards", "red_cards", "saves", "bonus", "bps", "defensive_contribution",
    "influence", "creativity", "threat", "ict_index", "xpts",
]
DISPLAY_COLUMNS = {
    "GW": "gameweek_id", "Opponent": "_opponent", "Score": "_score", "Pts": "pts",
    "xPts": "xpts", "ST": "starts", "MP": "minutes", "GS": "goals_scored", "A": "assists",
    "xG": "xg", "xA": "xa", "xGI": "xgi", "CS": "cs", "GC": "goals_conceded", "xGC": "xgc",
    "OG": "own_goals", "PS": "penalties_saved", "PM": "penalties_missed",
    "YC": "yellow_cards", "RC": "red_cards", "S": "saves", "B": "bonus", "BPS": "bps",
    "I": "influence", "C": "creativity", "T": "threat", "ICT": "ict_index",
}
# Breakdown categories, in display order.
CATEGORIES = ["Goals", "Assists", "Defensive", "Bonus", "Appearance", "Saves", "Deductions"]
MIN_DELTA = 0.5

_KEY = ["player_id", "fixture_id", "gameweek_id"]
# Columns of the fact behind the history, and behind the points breakdown and the running
# totals. The rows of a window are used twice, so only what is needed is placed.
_HISTORY_SOURCES = [
    *_KEY, "opponent_team_id", "was_home", "total_points", "starts", "minutes", "goals_scored", "assists",
    "expected_goals", "expected_assists", "expected_goal_involvements", "expected_goals_conceded",
    "clean_sheets", "goals_conceded", "own_goals", "penalties_saved", "penalties_missed", "yellow_cards",
    "red_cards", "saves", "bonus", "bps", "defensive_contribution", "influence", "creativity", "threat", "ict_index",
]
_BREAKDOWN_SOURCES = [
    *_KEY, "minutes", "goals_scored", "assists", "clean_sheets", "goals_conceded", "defensive_contribution",
    "bonus", "saves", "yellow_cards", "red_cards", "own_goals", "penalties_missed",
]
_INVOLVEMENT_SOURCES = [*_KEY, "goals_scored", "assists", "expected_goal_involvements"]


def history_rows(
    tables: RawTables,
    player_id: int | None = None,
    last_n: int | None = None,
    include_current: bool = True,
    columns: list[str] | None = None,
) -> DataFrame:
    """Fact rows of finished matches in the window, before any lookup; all columns or some.

    The window is the N newest gameweeks of the player's own history. Leaving out
    the current one means ids below the next gameweek, which still admits a
    current gameweek just before it; that is the rule as it stands.
    """
    rows = match_rows(tables.player_gameweek_stats)
    rows = rows.select(*(columns or rows.columns))
    if player_id is not None:
        rows = rows.filter(F.col("player_id") == player_id)
    return _window(finished_matches(rows, tables.fixtures), tables, last_n, include_current)


def _window(rows: DataFrame, tables: RawTables, last_n: int | None, include_current: bool) -> DataFrame:
    if last_n is None:
        return rows
    before = None if include_current else next_gameweek(tables.gameweeks)
    return newest_gameweeks_per_player(rows, last_n, before)


def player_history(
    tables: RawTables,
    player_id: int | None = None,
    last_n: int | None = None,
    include_current: bool = True,
) -> DataFrame:
    """One row per finished match with opponent, result and the match counts;
    ``newest_first`` puts them in display order. ``player_id`` and ``fixture_id`` come first as the row's key."""
    results = tables.fixtures.filter("finished").selectExpr(
        "id as fixture_id", "team_h_score as home_score", "team_a_score as away_score"
    )
    rows = match_rows(tables.player_gameweek_stats).select(*_HISTORY_SOURCES)
    if player_id is not None:
        rows = rows.filter(F.col("player_id") == player_id)
    # the fixture that admits a row also brings its score
    rows = _window(rows.join(results, "fixture_id"), tables, last_n, include_current)
    positions = tables.players.selectExpr("id as player_id", "element_type")
    opponents = tables.teams.selectExpr(
        "id as opponent_team_id", "short_name as opponent", "code as opponent_code"
    )
    joined = (
        with_units(rows)
        .join(positions, "player_id")
        .join(opponents, "opponent_team_id")
    )
    rounded = {
        "xg": "expected_goals", "xa": "expected_assists", "xgi": "expected_goal_involvements",
        "xgc": "expected_goals_conceded", "influence": "influence", "creativity": "creativity",
        "threat": "threat", "ict_index": "ict_index",
    }
    values = {alias: f"round({source}, 2)" for alias, source in rounded.items()}
    values["xpts"] = S.as_points(S.expected_points("element_type"))
    values["pts"] = "total_points"
    values["cs"] = "clean_sheets"
    return joined.selectExpr(
        "player_id", "fixture_id", *[f"{values.get(name, name)} as {name}" for name in HISTORY_COLUMNS]
    )


def newest_first(history: DataFrame) -> DataFrame:
    """Display order: per player, latest gameweek first. A sort of everything is a
    shuffle of everything, so it is a step of its own, for the rows that are shown."""
    return history.orderBy("player_id", F.desc("gameweek_id"), "fixture_id")


def history_table(history: DataFrame) -> DataFrame:
    """The displayed history: opponent and score as text, short column names."""
    texts = {"_opponent": versus("opponent", venue()), "_score": score_text()}
    return history.selectExpr(
        "player_id",
        "fixture_id",
        *[f"{texts.get(source, source)} as `{label}`" for label, source in DISPLAY_COLUMNS.items()],
    )


def history_outcomes(history: DataFrame) -> DataFrame:
    return history.selectExpr("player_id", "fixture_id", "gameweek_id", f"{outcome()} as outcome")


def points_breakdown(
    tables: RawTables,
    mode: str = "Per 90",
    player_id: int | None = None,
    last_n: int | None = None,
    include_current: bool = True,
) -> DataFrame:
    """Points per scoring category over the window, one row per player and category.

    ``Total`` keeps the sums, ``Per Game`` divides by matches played and ``Per 90``
    by minutes / 90. Players without minutes have no rows; only goalkeepers have
    a row for saves. The sums need no lookup but the position, so each player is
    one row before the join.
    """
    rows = history_rows(tables, player_id, last_n, include_current, _BREAKDOWN_SOURCES)
    sums = A.player_sums(rows, A.MATCH_COUNTS).filter("mp <> 0 and gp <> 0")
    positions = tables.players.selectExpr("id as player_id", "element_type")
    divisor = {"Total": "1D", "Per Game": "cast(gp as double)", "Per 90": "(mp / 90D)"}[mode]
    totals = [
        A.goal_total("element_type"),
        A.assist_total(),
        A.defensive_total("element_type", other_front=True),
        "bonus_pts",
        "appearance_pts",
        A.save_total("element_type", "null"),
        "deduction_pts",
    ]
    entries = ", ".join(
        f"'{category}', {float_round(f'cast({total} as double) / {divisor}')}"
        for category, total in zip(CATEGORIES, totals)
    )
    return (
        sums.join(positions, "player_id")
        .selectExpr("player_id", f"stack({len(CATEGORIES)}, {entries}) as (category, value)")
        .filter("value is not null")
    )


def involvement(
    tables: RawTables,
    player_id: int | None = None,
    last_n: int | None = None,
    include_current: bool = True,
) -> DataFrame:
    """Goal involvements against expectation per match, with running totals.

    The running totals are exact decimals of the rounded match values; a match
    without an expected value has no running expected value, and later ones go on.
    """
    rows = _involvement_rows(history_rows(tables, player_id, last_n, include_current, _INVOLVEMENT_SOURCES))
    return running_totals(
        rows, "player_id", "gameweek_id", "fixture_id", {"cum_gi": "gi", "cum_xgi": "xgi"}
    )


def chart_order(totals: DataFrame) -> DataFrame:
    """The running totals in the order of the chart, with the place of each row."""
    return ranked(totals, ["player_id", "gameweek_id", "fixture_id"])


def display_order(history: DataFrame) -> DataFrame:
    """The history in display order (``newest_first``), with the place of each row."""
    return ranked(history, ["player_id", F.desc("gameweek_id"), "fixture_id"])


def involvement_deltas(
    tables: RawTables, player_id: int | None = None, last_n: int | None = None,
    include_current: bool = True,
) -> DataFrame:
    """Delta per match only; needs no running totals and no shuffle for them."""
    return _involvement_rows(history_rows(tables, player_id, last_n, include_current, _INVOLVEMENT_SOURCES))


def _involvement_rows(rows: DataFrame) -> DataFrame:
    return rows.selectExpr(
        "player_id",
        "fixture_id",
        "gameweek_id",
        "goals_scored + assists as gi",
        "round(expected_goal_involvements, 2) as xgi",
    ).selectExpr("*", f"{float_round('cast(gi as double) - cast(xgi as double)')} as gi_delta")


def delta_bounds(deltas: DataFrame) -> DataFrame:
    """Largest absolute delta per player, at least 0.5."""
    return deltas.groupBy("player_id").agg(
        F.greatest(F.max(F.abs("gi_delta")), F.lit(MIN_DELTA)).alias("delta_max")
    )


def cumulative_long(totals: DataFrame) -> DataFrame:
    """Running totals in long form: one row per match and line of the chart."""
    return totals.select(
        "player_id",
        "fixture_id",
        "gameweek_id",
        F.col("cum_gi").cast("double").alias("GI"),
        F.col("cum_xgi").cast("double").alias("xGI"),
    ).unpivot(
        ["player_id", "fixture_id", "gameweek_id"], ["GI", "xGI"], "variable", "value"
    )
