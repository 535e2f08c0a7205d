"""Fixture difficulty: the team x gameweek matrix and the strip of upcoming fixtures."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchline.functions.labels import versus
from touchline.operators.ordering import ranked
from touchline.operators.selection import gameweek_info, next_gameweek, window_end
from touchline.operators.views import team_names
from touchline.plans.tables import RawTables

MATRIX_GAMEWEEKS = 8
STRIP_GAMEWEEKS = 8


def team_fixtures(raw_fixtures: DataFrame, raw_teams: DataFrame) -> DataFrame:
    """Each fixture as two rows, one per side, with own opponent, venue and difficulty.

    Names are looked up on the single fixture row before it is doubled, so the
    lookups move half the rows; the doubling itself is one pass without a union.
    """
    names = team_names(raw_teams)
    named = (
        raw_fixtures.selectExpr(
            "id as fixture_id", "event as gameweek_id", "finished", "team_h as home_id",
            "team_a as away_id", "team_h_difficulty", "team_a_difficulty",
        )
        .join(names.toDF("home_id", "home_name"), "home_id", "left")
        .join(names.toDF("away_id", "away_name"), "away_id", "left")
    )
    sides = (
        "stack(2,"
        " home_id, home_name, away_id, away_name, 'H', team_h_difficulty,"
        " away_id, away_name, home_id, home_name, 'A', team_a_difficulty)"
        " as (team_id, team, opponent_id, opponent, venue, fdr)"
    )
    long = named.selectExpr("fixture_id", "gameweek_id", "finished", sides)
    return long.selectExpr("*", f"{versus('opponent', 'venue')} as fragment")


def in_gameweeks(raw_fixtures: DataFrame, start: Column | int, end: Column | int) -> DataFrame:
    """Fixtures in a gameweek range; an unscheduled fixture is in none."""
    return raw_fixtures.filter((F.col("event") >= start) & (F.col("event") <= end))


def upcoming(tables: RawTables, length: int) -> DataFrame:
    """Fixtures from the next gameweek on. The bounds are scalar subqueries, so
    they reach the fixture scan as a filter."""
    return in_gameweeks(
        tables.fixtures, next_gameweek(tables.gameweeks), window_end(tables.gameweeks, length)
    )


#: Fixture ids per part of a cell's text.
TEXT_WIDTH = 1 << 16


def _cell_texts(long: DataFrame, separator: str, width: int = TEXT_WIDTH) -> DataFrame:
    """One row per team and gameweek: the fragments as one text, home fixtures first, then by
    fixture id, and the highest difficulty.

    A cell is cut into parts by side and range of fixture ids; the fragments of a part,
    at most ``width``, are joined first, and then the texts of the parts. The text of a
    cell is the cell's value, so its size is that of the result.
    """

    def joined(*order: str) -> Column:
        in_order = F.array_sort(F.collect_list(F.struct(*order)))
        return F.array_join(F.transform(in_order, lambda e: e[order[-1]]), separator)

    cell = ["team_id", "team", "gameweek_id"]
    parts = (
        long.withColumns({"_side": F.col("venue") == "A", "_range": F.floor(F.col("fixture_id") / F.lit(width))})
        .groupBy(*cell, "_side", "_range")
        .agg(joined("fixture_id", "fragment").alias("_text"), F.max("fdr").alias("fdr"))
    )
    return parts.groupBy(*cell).agg(joined("_side", "_range", "_text").alias("_text"), F.max("fdr").alias("fdr"))


def difficulty_cells(long: DataFrame) -> DataFrame:
    """One row per team and gameweek that has a fixture, with the highest difficulty."""
    known = long.filter(F.col("team").isNotNull())
    return known.groupBy("team_id", "team", "gameweek_id").agg(F.max("fdr").alias("fdr")).drop("team_id")


def fixture_cells(long: DataFrame) -> DataFrame:
    """One row per team and gameweek that has a fixture: the fragments joined
    directly, a space and the highest difficulty."""
    return _cell_texts(long.filter(F.col("team").isNotNull()), "").select(
        "team",
        "gameweek_id",
        F.concat("_text", F.lit(" "), F.col("fdr").cast("string")).alias("display"),
        "fdr",
    )


@dataclass(frozen=True)
class MatrixRange:
    start: int
    end: int

    def gameweeks(self) -> list[int]:
        return list(range(self.start, self.end + 1))


def default_range(gameweeks: DataFrame, length: int = MATRIX_GAMEWEEKS) -> MatrixRange:
    """The range the matrix opens with. Column names must be known when the plan is
    made, so this reads one row."""
    info = gameweek_info(gameweeks).first()
    return MatrixRange(info["next_gw"], min(info["next_gw"] + length - 1, info["max_gw"]))


def _matrix(cells: DataFrame, value: str, blank: str | int, span: MatrixRange) -> DataFrame:
    """Cells spread over one column per gameweek of the range, easiest teams first.

    One conditional aggregate per column is the pivot with a listed set of values;
    written out, the same pass also yields the average that orders the rows. The
    average is over cells that have a difficulty.
    """
    columns = [
        F.coalesce(F.max(F.when(F.col("gameweek_id") == gw, F.col(value))), F.lit(blank)).alias(str(gw))
        for gw in span.gameweeks()
    ]
    return (
        cells.groupBy(F.col("team").alias("Team"))
        .agg(*columns, F.avg(F.when(F.col("fdr") != 0, F.col("fdr"))).alias("_average"))
        .orderBy(F.asc_nulls_last("_average"), "Team")
        .drop("_average")
    )


def fdr_matrix_text(cells: DataFrame, span: MatrixRange) -> DataFrame:
    return _matrix(cells, "display", "", span)


def fdr_matrix_value(cells: DataFrame, span: MatrixRange) -> DataFrame:
    return _matrix(cells, "fdr", 0, span)


def average_difficulty(cells: DataFrame) -> DataFrame:
    return cells.groupBy("team").agg(
        F.avg(F.when(F.col("fdr") != 0, F.col("fdr"))).alias("avg_fdr")
    )


def matrix_cells(tables: RawTables, span: MatrixRange | None = None, texts: bool = True) -> DataFrame:
    """Cells of the matrix, for a given range or the default one; ``texts=False`` leaves out
    the text."""
    if span is None:
        chosen = upcoming(tables, MATRIX_GAMEWEEKS)
    else:
        chosen = in_gameweeks(tables.fixtures, span.start, span.end)
    long = team_fixtures(chosen, tables.teams)
    return fixture_cells(long) if texts else difficulty_cells(long)


def team_order(cells: DataFrame) -> DataFrame:
    """Teams with the place of each in the matrix, the lowest average difficulty first."""
    return ranked(average_difficulty(cells), [F.asc_nulls_last("avg_fdr"), "team"])


def fixture_strip(
    tables: RawTables, team: str | None = None, length: int = STRIP_GAMEWEEKS
) -> DataFrame:
    """Unfinished fixtures per team from the next gameweek on: one row per gameweek,
    blank where the team has none. An unknown team gives no rows."""
    clubs = team_names(tables.teams)
    if team is not None:
        clubs = clubs.filter(F.col("short_name") == team)
    open_fixtures = upcoming(tables, length).filter(~F.col("finished"))
    long = team_fixtures(open_fixtures, tables.teams)
    if team is not None:
        long = long.filter(F.col("team") == team)
    cells = _cell_texts(long, " ").selectExpr("team_id", "gameweek_id as gw", "_text as opponents", "fdr")
    weeks = F.sequence(next_gameweek(tables.gameweeks), window_end(tables.gameweeks, length))
    slots = clubs.select("team_id", F.col("short_name").alias("team"), F.explode(weeks).alias("gw"))
    return (
        slots.join(cells, ["team_id", "gw"], "left")
        .select(
            "team",
            "gw",
            F.coalesce("opponents", F.lit("")).alias("opponents"),
            F.coalesce("fdr", F.lit(0)).alias("fdr"),
        )
        .orderBy("team", "gw")
    )
