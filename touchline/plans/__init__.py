"""Entry points: player table, match history, fixture grids, load and contract jobs."""
