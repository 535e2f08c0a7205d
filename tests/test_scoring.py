"""Hand-checked scoring rules and the two rounding rules."""

from __future__ import annotations

from decimal import Decimal
from math import exp

import pytest
from league import fixture, league, match, player

from touchline.functions.rounding import float_round, rate
from touchline.operators import views
from touchline.plans import player_history as hist
from touchline.plans import player_stats as stats


def xpts(spark, element_type: int, **row) -> Decimal:
    tables = league(spark, [player(1, element_type)], [fixture(1, 1)], [match(1, 1, **row)])
    view = views.player_gameweek_stats(tables.player_gameweek_stats, tables.fixtures, tables.players)
    return view.first()["xpts"]


def two(value: float) -> Decimal:
    return Decimal(repr(round(value, 2))).quantize(Decimal("0.01"))


@pytest.mark.parametrize("minutes, points", [(0, 0), (1, 1), (59, 1), (60, 2), (90, 2)])
def test_appearance(spark, minutes, points):
    assert xpts(spark, 4, minutes=minutes) == points


def test_clean_sheet_needs_sixty_minutes(spark):
    row = {"expected_goals_conceded": "0.50"}
    assert xpts(spark, 1, minutes=59, **row) == 1
    assert xpts(spark, 2, minutes=60, **row) == two(2 + 4 * exp(-0.5))
    assert xpts(spark, 3, minutes=60, **row) == two(2 + exp(-0.5))
    assert xpts(spark, 4, minutes=60, **row) == 2


@pytest.mark.parametrize("xgc, deduction", [("1.99", 0), ("2.00", 1), ("4.10", 2), (None, 0)])
def test_expected_conceded(spark, xgc, deduction):
    assert xpts(spark, 2, minutes=1, expected_goals_conceded=xgc) == 1 - deduction
    assert xpts(spark, 3, minutes=1, expected_goals_conceded=xgc) == 1


@pytest.mark.parametrize("element_type, each", [(1, 6), (2, 6), (3, 5), (4, 4), (5, 4)])
def test_expected_goals_and_assists(spark, element_type, each):
    got = xpts(spark, element_type, minutes=0, expected_goals="0.37", expected_assists="0.11")
    assert got == two(0.37 * each + 0.33)
    assert xpts(spark, element_type, minutes=0, expected_goals=None, expected_assists="0.11") == two(0.33)


@pytest.mark.parametrize("saves, points", [(2, 0), (3, 1), (5, 1), (6, 2)])
def test_saves_are_for_goalkeepers(spark, saves, points):
    assert xpts(spark, 1, saves=saves) == points
    assert xpts(spark, 2, saves=saves) == 0


@pytest.mark.parametrize("count", [9, 10, 11, 12, 30])
def test_expected_defensive_is_linear_and_capped(spark, count):
    assert xpts(spark, 2, defensive_contribution=count) == two(min(count / 10 * 2, 2))
    assert xpts(spark, 3, defensive_contribution=count) == two(min(count / 12 * 2, 2))
    assert xpts(spark, 5, defensive_contribution=count) == two(min(count / 12 * 2, 2))


def test_cards_penalties_bonus(spark):
    row = {"yellow_cards": 1, "red_cards": 1, "own_goals": 1, "penalties_saved": 1,
           "penalties_missed": 1, "bonus": 3}
    assert xpts(spark, 4, **row) == -1 - 3 - 2 + 5 - 2 + 3


def test_half_rounds_away_from_zero(spark):
    assert xpts(spark, 4, expected_assists="0.0050") == Decimal("0.02")  # 0.015
    assert xpts(spark, 4, yellow_cards=1, expected_assists="0.0050") == Decimal("-0.99")  # -0.985


def test_two_rounding_rules(spark):
    one = spark.range(1)
    assert one.selectExpr(f"{rate('2675', 1, '1000', 2)} as x").first().x == Decimal("2.68")
    assert one.selectExpr(f"{rate('-125', 1, '1000', 2)} as x").first().x == Decimal("-0.13")
    assert one.selectExpr(f"{rate('1', 1, '0', 2)} as x").first().x is None
    assert one.selectExpr(f"{float_round('2.665D')} as x").first().x == 2.66
    assert one.selectExpr(f"{float_round('0.125D')} as x").first().x == 0.12


def season(spark, element_type: int, *matches: dict) -> dict:
    fixtures = [fixture(i, 1) for i in range(1, len(matches) + 1)]
    facts = [match(1, i, **row) for i, row in enumerate(matches, start=1)]
    tables = league(spark, [player(1, element_type)], fixtures, facts)
    return stats.player_stats(tables).first().asDict()


def test_conceded_floor_is_per_match(spark):
    once = {"minutes": 90, "goals_conceded": 1}
    assert season(spark, 2, once, once)["defensive_pp90"] == 0
    assert season(spark, 2, {"minutes": 90, "goals_conceded": 2})["defensive_pp90"] == -1
    assert season(spark, 3, {"minutes": 90, "goals_conceded": 2})["defensive_pp90"] == 0


@pytest.mark.parametrize(
    "element_type, count, points", [(2, 9, 0), (2, 10, 2), (3, 11, 0), (4, 12, 2), (5, 30, 0)]
)
def test_actual_defensive_is_a_step(spark, element_type, count, points):
    got = season(spark, element_type, {"minutes": 90, "defensive_contribution": count})
    assert got["defensive_pp90"] == points


def test_unknown_position_counts_as_forward_label_and_goals(spark):
    got = season(spark, 5, {"minutes": 90, "goals_scored": 1, "total_points": 6})
    assert (got["pos"], got["goals_pp90"], got["saves_pp90"]) == ("FWD", 4, 0)


def test_breakdown_leaves_out_saves_of_outfield_players(spark):
    row = {"minutes": 90, "saves": 6, "yellow_cards": 1, "penalties_saved": 1}
    tables = league(
        spark, [player(1, 1), player(2, 2), player(3, 4)], [fixture(1, 1)],
        [match(1, 1, **row), match(2, 1, **row), match(3, 1, minutes=0)],
    )
    got = {(r.player_id, r.category): r.value for r in hist.points_breakdown(tables, "Total").collect()}
    assert got[1, "Saves"] == 2 and (2, "Saves") not in got
    assert got[1, "Deductions"] == -1
    assert not [key for key in got if key[0] == 3]  # no minutes, no rows
