"""The scoring model as SQL expressions over the renamed match columns.

Every function returns expression text for ``selectExpr`` or ``F.expr``. Where the
position matters it is an argument: a column name, or a literal code such as
``"1"``. With a literal the ``case`` folds away at planning time, which is how the
aggregates evaluate the model for each position before they know the player.
"""

from __future__ import annotations

# Points per event and thresholds of the scoring model.
POSITIONS = {1: "GK", 2: "DEF", 3: "MID"}
OTHER_POSITION = "FWD"
GOAL_POINTS = {1: 6, 2: 6, 3: 5}
OTHER_GOAL_POINTS = 4
CLEAN_SHEET_POINTS = {1: 4, 2: 4, 3: 1}
OTHER_CLEAN_SHEET_POINTS = 0
ASSIST_POINTS = 3
CONCEDED_PER_POINT = 2
SAVES_PER_POINT = 3
YELLOW_POINTS = -1
RED_POINTS = -3
OWN_GOAL_POINTS = -2
PENALTY_SAVED_POINTS = 5
PENALTY_MISSED_POINTS = -2
DEFENSIVE_POINTS = 2
DEFENSIVE_THRESHOLD_BACK = 10
DEFENSIVE_THRESHOLD_FRONT = 12
FULL_APPEARANCE_MINUTES = 60

# Expected values have up to four decimals and are summed as whole ten-thousandths;
# the parts of one match's expected points are added as whole trillionths and
# rounded to whole hundredths. Decimals of more than 18 digits would be an object
# per value; 64-bit numbers stay in registers and are as exact.
UNITS = 10_000
_ONE = 1_000_000_000_000
_PER_UNIT = _ONE // UNITS
_PER_HUNDREDTH = _ONE // 100

EXPECTED = {
    "xg_units": "expected_goals",
    "xa_units": "expected_assists",
    "xgi_units": "expected_goal_involvements",
    "xgc_units": "expected_goals_conceded",
}


def _by_position(position: str, table: dict[int, int], other: int) -> str:
    whens = " ".join(f"when {code} then {value}" for code, value in table.items())
    return f"(case {position} {whens} else {other} end)"


def position_label(position: str) -> str:
    whens = " ".join(f"when {code} then '{label}'" for code, label in POSITIONS.items())
    return f"(case {position} {whens} else '{OTHER_POSITION}' end)"


def goal_points(position: str) -> str:
    return _by_position(position, GOAL_POINTS, OTHER_GOAL_POINTS)


def clean_sheet_points(position: str) -> str:
    return _by_position(position, CLEAN_SHEET_POINTS, OTHER_CLEAN_SHEET_POINTS)


def is_back(position: str) -> str:
    """Goalkeepers and defenders."""
    return f"({position} in (1, 2))"


def fixture_difficulty(home: str, away: str) -> str:
    """Difficulty from the player's own side."""
    return f"case when was_home then {home} else {away} end"


def appearance_points() -> str:
    return f"(case when minutes >= {FULL_APPEARANCE_MINUTES} then 2 when minutes >= 1 then 1 else 0 end)"


def conceded_pairs() -> str:
    """Whole pairs of goals conceded in one match; the floor is taken per match."""
    return f"cast(floor(goals_conceded / {CONCEDED_PER_POINT}) as int)"


def save_points() -> str:
    return f"cast(floor(saves / {SAVES_PER_POINT}) as int)"


def deduction_points() -> str:
    return (
        f"({YELLOW_POINTS} * yellow_cards + {RED_POINTS} * red_cards"
        f" + {OWN_GOAL_POINTS} * own_goals + {PENALTY_MISSED_POINTS} * penalties_missed)"
    )


def defensive_step(threshold: int) -> str:
    """1 when the actual count reaches the threshold."""
    return f"(case when defensive_contribution >= {threshold} then 1 else 0 end)"


def expected_units() -> dict[str, str]:
    """Expected values of a match row as whole ten-thousandths, null where unknown."""
    return {name: f"cast({source} * {UNITS} as bigint)" for name, source in EXPECTED.items()}


def expected_points(position: str) -> str:
    """Expected points of one match row with ``expected_units``, in whole hundredths.

    Expected values stand in for goals, assists, clean sheets and goals conceded;
    everything else counts as it happened. The 60-minute gate holds for the
    clean sheet only, and the defensive part grows linearly up to its cap.
    """
    conceded = "coalesce(xgc_units, 0)"
    back, front = DEFENSIVE_THRESHOLD_BACK, DEFENSIVE_THRESHOLD_FRONT
    defensive = (
        f"case when {is_back(position)} then defensive_contribution * {DEFENSIVE_POINTS * _ONE // back}"
        f" else (defensive_contribution * {DEFENSIVE_POINTS * _ONE} + {front // 2}) div {front} end"
    )
    counted = (
        f"{appearance_points()} + case when {position} = 1 then {save_points()} else 0 end"
        f" + {deduction_points()} + {PENALTY_SAVED_POINTS} * penalties_saved + bonus"
        f" - case when {is_back(position)} then cast(floor({conceded} / {CONCEDED_PER_POINT * UNITS}) as bigint)"
        " else 0 end"
    )
    clean_sheet = (
        f"case when minutes >= {FULL_APPEARANCE_MINUTES}"
        f" then cast(rint(exp(-{conceded} / {UNITS}) * {_ONE}) as bigint)"
        f" * {clean_sheet_points(position)} else 0 end"
    )
    total = (
        f"({counted}) * {_ONE}"
        f" + coalesce(xg_units, 0) * {goal_points(position)} * {_PER_UNIT}"
        f" + coalesce(xa_units, 0) * {ASSIST_POINTS * _PER_UNIT}"
        f" + {clean_sheet} + least({defensive}, {DEFENSIVE_POINTS * _ONE})"
    )
    half = _PER_HUNDREDTH // 2
    return f"(cast(sign({total}) as bigint) * ((abs({total}) + {half}) div {_PER_HUNDREDTH}))"


def as_points(hundredths: str) -> str:
    return f"cast({hundredths} / 100 as decimal(18,2))"
