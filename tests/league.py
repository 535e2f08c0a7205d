"""A small hand-made season: raw tables from short row descriptions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from touchline.plans.tables import RawTables
from touchline.sources.schemas import fields, schema

MATCH_DEFAULTS = {"opponent_team": 2, "was_home": True, "round": 1}


def rows(spark: SparkSession, entity: str, items: list[dict]) -> DataFrame:
    """Rows of a raw table; columns not given get the table default or null."""
    plain = {"0": 0, "false": False}
    base = {f.name: plain.get(f.default) for f in fields(entity)}
    names = [f.name for f in fields(entity)]
    data = [tuple({**base, **item}[name] for name in names) for item in items]
    return spark.createDataFrame(data, schema(entity))


def team(i: int, name: str) -> dict:
    return {"id": i, "code": 100 + i, "name": name, "short_name": name}


def gameweek(i: int, **extra) -> dict:
    return {"id": i, "name": f"Gameweek {i}", **extra}


def player(i: int, element_type: int, team_id: int = 1, **extra) -> dict:
    return {
        "id": i, "code": i, "element_type": element_type, "team": team_id, "web_name": f"p{i}",
        "first_name": "f", "second_name": "s", "status": "a", "now_cost": 55,
        "selected_by_percent": "7.5", **extra,
    }


def fixture(i: int, event: int | None, home: int = 1, away: int = 2, **extra) -> dict:
    return {
        "id": i, "code": i, "event": event, "team_h": home, "team_a": away, "finished": True,
        "team_h_difficulty": 2, "team_a_difficulty": 4, **extra,
    }


def match(element: int, fixture_id: int, **extra) -> dict:
    return {"element": element, "fixture": fixture_id, **MATCH_DEFAULTS, **extra}


def league(spark, players, fixtures, matches, gameweeks=None, teams=None) -> RawTables:
    return RawTables(
        teams=rows(spark, "teams", teams or [team(1, "AAA"), team(2, "BBB"), team(3, "CCC")]),
        gameweeks=rows(spark, "gameweeks", gameweeks or [gameweek(1, finished=True), gameweek(2)]),
        players=rows(spark, "players", players),
        fixtures=rows(spark, "fixtures", fixtures),
        player_gameweek_stats=rows(spark, "player_gameweek_stats", matches),
    )
