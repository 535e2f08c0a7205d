"""Per-player sums shared by the player table and the points breakdown.

The sums are taken over the fact alone, before any player lookup. Position is
the only player attribute the scoring needs, and it has four outcomes, so the
position-dependent sums are kept in a form that can be finished afterwards:
expected points once per position, threshold counts once per threshold. That
way the fact is pre-aggregated map-side to one row per player and only those
rows are joined to the players; a player with a third of all rows costs one row
per task in the shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.functions import scoring as S
from touchline.operators.views import with_units

_XPTS = {1: "xpts_gk", 2: "xpts_def", 3: "xpts_mid", 4: "xpts_fwd"}

# Sums for the points breakdown.
MATCH_COUNTS = {
    "gp": "case when minutes > 0 then 1 else 0 end",
    "mp": "minutes",
    "gs": "goals_scored",
    "a": "assists",
    "cs": "clean_sheets",
    "conceded_pairs": S.conceded_pairs(),
    "dc_back": S.defensive_step(S.DEFENSIVE_THRESHOLD_BACK),
    "dc_front": S.defensive_step(S.DEFENSIVE_THRESHOLD_FRONT),
    "bonus_pts": "bonus",
    "appearance_pts": S.appearance_points(),
    "save_pts": S.save_points(),
    "deduction_pts": S.deduction_points(),
}

# Further sums for the player table; expected values in whole units, expected points
# in whole hundredths.
SEASON_SUMS = {
    "match_rows": "1",
    "st": "starts",
    "pts": "total_points",
    **{name: name for name in S.EXPECTED},
    **{alias: S.expected_points(str(code)) for code, alias in _XPTS.items()},
}


def player_sums(rows: DataFrame, *groups: dict[str, str]) -> DataFrame:
    """The named sums per player. Sums of expected values need their columns."""
    sums = {name: sql for group in groups for name, sql in group.items()}
    return (
        (with_units(rows) if set(SEASON_SUMS) & set(sums) else rows)
        .groupBy("player_id")
        .agg(*[F.expr(f"sum({sql}) as {name}") for name, sql in sums.items()])
    )


def expected_points_total(position: str) -> str:
    """Sum of expected points for the player's position, in hundredths."""
    whens = " ".join(f"when {code} then {alias}" for code, alias in _XPTS.items() if code < 4)
    return f"(case {position} {whens} else {_XPTS[4]} end)"


def goal_total(position: str) -> str:
    return f"gs * {S.goal_points(position)}"


def assist_total() -> str:
    return f"a * {S.ASSIST_POINTS}"


def defensive_total(position: str, other_front: bool) -> str:
    """Clean sheets, conceded deduction and threshold points together.

    A position code outside 1..4 counts as a front player in the breakdown
    (``other_front``) but scores no threshold points in the player table.
    """
    back = S.is_back(position)
    front = "true" if other_front else f"{position} in (3, 4)"
    return (
        f"cs * {S.clean_sheet_points(position)}"
        f" - case when {back} then conceded_pairs else 0 end"
        f" + {S.DEFENSIVE_POINTS}"
        f" * case when {back} then dc_back when {front} then dc_front else 0 end"
    )


def save_total(position: str, other: str) -> str:
    """Save points of goalkeepers, ``other`` for everybody else."""
    return f"case when {position} = 1 then save_pts else {other} end"
