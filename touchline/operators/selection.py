"""Gameweek selection. Gameweek ids are the time axis; a window is a range or a
top-N over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, GroupedData
from pyspark.sql import functions as F


def gameweek_info(gameweeks: DataFrame) -> DataFrame:
    """One row: lowest id, highest id, and the next gameweek (else the highest)."""
    highest = F.max("id")
    return gameweeks.agg(
        F.min("id").alias("min_gw"),
        highest.alias("max_gw"),
        F.coalesce(F.min(F.when(F.col("is_next"), F.col("id"))), highest).alias("next_gw"),
    )


def next_gameweek(gameweeks: DataFrame) -> Column:
    """The next gameweek id as a scalar subquery: it is computed inside the job
    and adds neither a join nor a driver round trip."""
    return gameweek_info(gameweeks).select("next_gw").scalar()


def window_end(gameweeks: DataFrame, length: int) -> Column:
    """Last id of a window of ``length`` gameweeks from the next one, capped at the season's end."""
    return (
        gameweek_info(gameweeks)
        .select(F.least(F.col("next_gw") + F.lit(length - 1), F.col("max_gw")).alias("end_gw"))
        .scalar()
    )


def in_selection(
    rows: DataFrame,
    gameweeks: DataFrame,
    gw_from: int | None = None,
    gw_to: int | None = None,
    last_n: int | None = None,
    include_current: bool = True,
) -> DataFrame:
    """Rows whose ``gameweek_id`` is selected.

    ``last_n`` takes the N highest finished gameweeks, plus the current one when
    ``include_current``, and overrides the range. Without ``include_current`` a
    range keeps finished gameweeks only.
    """
    if last_n is not None:
        if last_n < 0:
            raise ValueError("last_n must not be negative")
        chosen = (
            gameweeks.filter("finished").select("id").orderBy(F.desc("id")).limit(last_n)
        )
        if include_current:
            chosen = chosen.union(gameweeks.filter("is_current").select("id"))
        return _keep(rows, chosen)

    if gw_from is not None:
        rows = rows.filter(F.col("gameweek_id") >= gw_from)
    if gw_to is not None:
        rows = rows.filter(F.col("gameweek_id") <= gw_to)
    if not include_current:
        rows = _keep(rows, gameweeks.filter("finished").select("id"))
    return rows


def _keep(rows: DataFrame, ids: DataFrame) -> DataFrame:
    return rows.join(ids.withColumnRenamed("id", "gameweek_id"), "gameweek_id", "left_semi")


def finished_matches(rows: DataFrame, raw_fixtures: DataFrame) -> DataFrame:
    """Match rows of finished fixtures. The flag is per fixture, so the finished
    matches of a running gameweek count."""
    done = raw_fixtures.filter("finished").select(F.col("id").alias("fixture_id"))
    return rows.join(done, "fixture_id", "left_semi")


def newest_gameweeks_per_player(
    rows: DataFrame, n: int, before: Column | None = None
) -> DataFrame:
    """Rows in each player's own N newest gameweeks.

    The rows are placed once by player and gameweek, so a player with very many rows is
    not one task. The gameweeks of a player are few: the pairs of both are found where
    the rows lie, the N newest of each player come from an aggregate over the pairs, and
    they meet the rows where these lie. The rows are moved once, and both uses read that
    one exchange.
    """
    keyed = rows.filter("player_id is not null and gameweek_id is not null")
    if before is not None:
        keyed = keyed.filter(F.col("gameweek_id") < before)
    placed = keyed.repartition("player_id", "gameweek_id")
    pairs = same_columns(placed.groupBy("player_id", "gameweek_id"), rows.columns)
    newest = F.sort_array(F.collect_list("gameweek_id"), asc=False)
    chosen = pairs.groupBy("player_id").agg(F.slice(newest, 1, n).alias("_newest")).select(
        "player_id", F.explode("_newest").alias("gameweek_id")
    )
    # each pair comes once; a semi join would be moved below the exchange, which it then changes
    return placed.join(chosen, ["player_id", "gameweek_id"]).select(*rows.columns)


def same_columns(grouped: GroupedData, columns: list[str], *aggregates: Column) -> DataFrame:
    """An aggregate that reads all ``columns`` of its input, though it needs only some. With
    fewer, the exchange below it would differ from that of another use of the rows, and
    the rows would be computed twice. For the same reason a filter that a join on keys
    implies belongs below that exchange."""
    whole = F.bit_xor(F.xxhash64(*columns))
    return grouped.agg(*aggregates, whole.alias("_whole")).filter("_whole is not null").drop("_whole")
