"""The set of raw tables the plans read."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame


@dataclass(frozen=True)
class RawTables:
    teams: DataFrame
    gameweeks: DataFrame
    players: DataFrame
    fixtures: DataFrame
    player_gameweek_stats: DataFrame
    etl_runs: DataFrame | None = None

    def named(self) -> dict[str, DataFrame]:
        tables = {
            "teams": self.teams,
            "gameweeks": self.gameweeks,
            "players": self.players,
            "fixtures": self.fixtures,
            "player_gameweek_stats": self.player_gameweek_stats,
        }
        if self.etl_runs is not None:
            tables["etl_runs"] = self.etl_runs
        return tables
