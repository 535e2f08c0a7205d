"""Selection, history, grids and running totals on small hand-made seasons."""

from __future__ import annotations

import pytest
from league import fixture, gameweek, league, match, player, team

from touchline.functions.labels import age_label
from touchline.operators import selection, views
from touchline.operators.running import running_totals
from touchline.plans import fixtures_grid as grid
from touchline.plans import player_history as hist
from touchline.plans import player_stats as stats


@pytest.fixture(scope="module")
def season(spark):
    """Gameweeks 1-3 finished, 4 current and part played, 5 next. Player 1 plays twice in 2."""
    gameweeks = [
        gameweek(1, finished=True), gameweek(2, finished=True), gameweek(3, finished=True),
        gameweek(4, is_current=True), gameweek(5, is_next=True), gameweek(6), gameweek(7),
    ]
    fixtures = [
        fixture(1, 1, team_h_score=2, team_a_score=0), fixture(2, 2), fixture(3, 2, 1, 3),
        fixture(4, 3), fixture(5, 4), fixture(6, 4, 1, 3, finished=False),
        fixture(7, 5, 1, 2, finished=False), fixture(8, 5, 3, 1, finished=False, team_a_difficulty=5),
        fixture(9, None, finished=False), fixture(10, 6, 2, 3, finished=False),
    ]
    facts = [
        match(1, f, round=r, minutes=90, total_points=p, goals_scored=1, expected_goal_involvements=x)
        for f, r, p, x in [
            (1, 1, 1, "0.25"), (2, 2, 10, "0.10"), (3, 2, 20, None), (4, 3, 100, "0.40"),
            (5, 4, 1000, "1.10"), (6, 4, 9999, "5.00"),
        ]
    ] + [match(2, 1, round=1, minutes=0)]
    return league(spark, [player(1, 3), player(2, 4)], fixtures, facts, gameweeks)


def points(season, **selected):
    return {r.player_id: r.pts for r in stats.player_stats(season, **selected).collect()}


def test_selection_of_gameweeks(season):
    assert points(season) == {1: 1131}  # open fixture 6 never counts, player 2 has no minutes
    assert points(season, include_current=False) == {1: 131}
    assert points(season, last_n=1) == {1: 1100}
    assert points(season, last_n=1, include_current=False) == {1: 100}
    assert points(season, last_n=0) == {1: 1000}
    assert points(season, last_n=0, include_current=False) == {}
    assert points(season, last_n=99) == {1: 1131}
    assert points(season, gw_from=2, gw_to=3) == {1: 130}
    assert points(season, gw_from=3) == {1: 1100}
    assert points(season, gw_to=1, last_n=1) == {1: 1100}  # last_n wins
    with pytest.raises(ValueError):
        stats.player_stats(season, last_n=-1)


def test_gameweek_info_without_next(spark, season):
    assert tuple(selection.gameweek_info(season.gameweeks).first()) == (1, 7, 5)
    plain = league(spark, [player(1, 1)], [fixture(1, 1)], [match(1, 1)])
    assert tuple(selection.gameweek_info(plain.gameweeks).first()) == (1, 2, 2)


def test_history_window_is_the_players_own(season):
    def fixtures(**window):
        return sorted(r.fixture_id for r in hist.player_history(season, 1, **window).collect())

    assert fixtures() == [1, 2, 3, 4, 5]
    assert fixtures(last_n=2) == [4, 5]  # the current gameweek uses a slot
    assert fixtures(last_n=3) == [2, 3, 4, 5]
    # leaving out the current one means ids below the next: gameweek 4 still counts
    assert fixtures(last_n=2, include_current=False) == [4, 5]


def test_history_text(season):
    history = hist.player_history(season, 1)
    table = {r.fixture_id: r for r in hist.history_table(history).collect()}
    assert (table[1]["Opponent"], table[1]["Score"]) == ("BBB (H)", "2-0")
    assert table[2]["Score"] == "-"
    outcomes = {r.fixture_id: r.outcome for r in hist.history_outcomes(history).collect()}
    assert (outcomes[1], outcomes[2]) == ("W", "?")
    first = hist.newest_first(history).first()
    assert first.gameweek_id == 4
    assert history.columns[2:] == hist.HISTORY_COLUMNS


def test_running_totals_step_by_row_and_skip_unknown(season):
    got = {r.fixture_id: (r.cum_gi, r.cum_xgi) for r in hist.involvement(season, 1).collect()}
    assert {f: gi for f, (gi, _) in got.items()} == {1: 1, 2: 2, 3: 3, 4: 4, 5: 5}
    assert {f: None if x is None else float(x) for f, (_, x) in got.items()} == {
        1: 0.25, 2: 0.35, 3: None, 4: 0.75, 5: 1.85,
    }
    bounds = hist.delta_bounds(hist.involvement_deltas(season, 1)).first()
    assert bounds.delta_max == 0.9
    lines = hist.cumulative_long(hist.involvement(season, 1)).groupBy("variable").count().collect()
    assert {r.variable: r["count"] for r in lines} == {"GI": 5, "xGI": 5}


@pytest.mark.parametrize("width", [1, 3, 1000])
def test_running_totals_over_many_chunks(spark, width):
    """One key holds almost all rows; blocks of any width give the plain running sum."""
    rows = [("hot", i % 5, i, (i * 7) % 11) for i in range(200)] + [("cold", 0, 3, 4)]
    frame = spark.createDataFrame(rows, "k string, step int, id bigint, v bigint")
    got = running_totals(frame, "k", "step", "id", {"total": "v"}, chunk_width=width).collect()
    expected, total = {("cold", 3): 4}, 0
    for k, _, i, v in sorted(rows, key=lambda r: (r[1], r[2])):
        if k == "hot":
            total += v
            expected[k, i] = total
    assert {(r.k, r.id): r.total for r in got} == expected


def test_cells_matrix_and_strip(season):
    cells = {(r.team, r.gameweek_id): (r.display, r.fdr) for r in grid.matrix_cells(season).collect()}
    assert cells == {
        ("AAA", 5): ("BBB (H)CCC (A) 5", 5), ("BBB", 5): ("AAA (A) 4", 4), ("CCC", 5): ("AAA (H) 2", 2),
        ("BBB", 6): ("CCC (H) 2", 2), ("CCC", 6): ("BBB (A) 4", 4),
    }
    span = grid.default_range(season.gameweeks)
    text = [r.asDict() for r in grid.fdr_matrix_text(grid.matrix_cells(season), span).collect()]
    assert [r["Team"] for r in text] == ["BBB", "CCC", "AAA"]  # averages 3, 3, 5
    assert list(text[0]) == ["Team", "5", "6", "7"] and text[0]["7"] == ""
    values = {r["Team"]: (r["5"], r["6"], r["7"]) for r in grid.fdr_matrix_value(grid.matrix_cells(season), span).collect()}
    assert values == {"AAA": (5, 0, 0), "BBB": (4, 2, 0), "CCC": (2, 4, 0)}
    strip = [(r.gw, r.opponents, r.fdr) for r in grid.fixture_strip(season, "AAA").collect()]
    assert strip == [(5, "BBB (H) CCC (A)", 5), (6, "", 0), (7, "", 0)]
    assert grid.fixture_strip(season, "nobody").count() == 0


def test_table_modes_and_filters(spark):
    facts = [
        match(1, 1, minutes=80, goals_scored=2, total_points=9, expected_goals="0.77"),
        match(1, 2, minutes=0), match(2, 1, minutes=90, total_points=2),
    ]
    tables = league(
        spark, [player(1, 4, now_cost=70), player(2, 2, 2)], [fixture(1, 1), fixture(2, 1)], facts
    )
    table = stats.player_stats(tables)
    assert table.columns == stats.PLAYER_STATS_COLUMNS
    total = stats.stats_table(table, "Total").first()
    assert (total["Pts"], total["GS"], total["Pts Split"][0]) == (9, 2, 8.0)
    per_game = stats.stats_table(table).first()
    assert (per_game["Pts"], per_game["GS"], float(per_game["xG"])) == (9, 2.0, 0.77)
    assert total["Team"].endswith("shirt_101-66.webp")
    ids = lambda df: [r.player_id for r in df.collect()]
    assert ids(stats.filter_players(table, min_mp_pct=50)) == [2]
    assert ids(stats.filter_players(table, max_price=5.5)) == [2]
    assert ids(stats.filter_players(table, team="AAA", pos="FWD")) == [1]
    assert tuple(stats.price_bounds(table).first()) == (5.5, 7.0)
    assert tuple(stats.price_bounds(table.filter("false")).first()) == (3.0, 16.0)


def test_views_keep_every_column(spark, season):
    assert len(views.teams(season.teams).columns) == 21
    assert len(views.gameweeks(season.gameweeks).columns) == 29
    seen = views.players(season.players)
    assert len(seen.columns) == 106 and {"last_name", "team_id", "price"} <= set(seen.columns)
    assert dict(seen.dtypes)["form"] == "decimal(18,4)"
    assert "gameweek_id" in views.fixtures(season.fixtures).columns
    view = views.player_gameweek_stats(season.player_gameweek_stats, season.fixtures, season.players)
    assert len(view.columns) == 44
    assert views.team_list(season.teams).collect()[0].short_name == "AAA"


def test_bad_numeric_text_raises(spark):
    tables = league(spark, [player(1, 1, form="n/a")], [fixture(1, 1)], [match(1, 1)])
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        views.players(tables.players).collect()


@pytest.mark.parametrize(
    "seconds, label",
    [(0, "just now"), (59, "just now"), (60, "1m ago"), (3599, "59m ago"), (3600, "1h ago"),
     (86399, "23h ago"), (86400, "1d ago"), (200000, "2d ago")],
)
def test_age_label(spark, seconds, label):
    assert spark.sql(f"select 1 as t, {seconds}L as s").selectExpr(f"{age_label('t', 's')} as x").first().x == label
