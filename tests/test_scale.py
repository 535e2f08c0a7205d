"""What moves and what is staged: plans and files, on rows of their own."""

from __future__ import annotations

import datetime
import json
import re
from decimal import Decimal
from types import SimpleNamespace

from league import fixture, league, match, player, rows as league_rows

from touchline.operators import contract, integrity, merge, selection
from touchline.plans.load import without_settled_text
from touchline.session import SETTINGS, compile_wide_rows, released_shuffles
from touchline.sources import driver_tables as data
from touchline.sources import landing
from touchline.sources.schemas import column_names, conform
from touchline.sources.store import TableStore
from touchline.streaming.landing_stream import latest_rows

FACTS = "player_gameweek_stats"


def exchanged(df, column: str) -> int:
    """Shuffles of a plan, without broadcasts and reused ones, that move a column."""
    conf = df.sparkSession.conf
    old = {k: conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    conf.set("spark.sql.adaptive.enabled", "false")
    conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = df.select("*")._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    finally:
        for key, value in old.items():
            conf.set(key, value)
    return len(re.findall(rf"\) Exchange\nInput \[\d+\]: \[[^\n]*\b{column}#", plan))


def test_a_window_of_newest_gameweeks_moves_rows_once(spark):
    rows = spark.range(100).selectExpr("id % 3 as player_id", "cast(id % 10 as int) as gameweek_id", "id as payload")
    newest = selection.newest_gameweeks_per_player(rows, 3)
    assert {(r.player_id, r.gameweek_id) for r in newest.collect()} == {(p, g) for p in range(3) for g in (7, 8, 9)}
    assert newest.count() == 30
    odd = spark.createDataFrame([(1, 2, 1), (1, 2, 1), (1, None, 2), (None, 3, 3), (2, 1, 4)], "player_id int, gameweek_id int, payload int")
    assert sorted(tuple(r) for r in selection.newest_gameweeks_per_player(odd, 5).collect()) == [(1, 2, 1), (1, 2, 1), (2, 1, 4)]
    assert exchanged(newest, "payload") == 1


def test_lookups_of_the_mapping_move_no_measures(spark, tmp_path):
    day = datetime.date(2024, 1, 1)
    made = {
        "customer": ([(c, f"c{c}") for c in range(3)], "c_custkey bigint, c_name string"),
        "part": ([(p, 5) for p in range(2)], "p_partkey bigint, p_size int"),
        "orders": ([(o, o % 3, day) for o in range(4)], "o_orderkey bigint, o_custkey bigint, o_orderdate date"),
        "lineitem": (
            [(o, p, Decimal(20 + o), Decimal("0.05"), Decimal("0.02"), 1 + p, day) for o in range(4) for p in range(2)],
            "l_orderkey bigint, l_partkey bigint, l_quantity decimal(12,2), l_discount decimal(12,2), l_tax decimal(12,2), l_linenumber int, l_shipdate date",
        ),
    }
    for name, (rows, ddl) in made.items():
        spark.createDataFrame(rows, ddl).write.parquet(f"{tmp_path}/{name}.parquet")
    facts = data.raw_player_gameweek_stats(spark, str(tmp_path))
    got = {(r.element, r.fixture): (r.bps, r.ict_index, r.value, r.opponent_team) for r in facts.collect()}
    assert len(got) == 8
    assert got[(1, 1)] == (25, "1.2", 45, 2)  # at home: the other team of order 0
    assert got[(2, 3)] == (27, "2.2", 45, 3)  # away: the home team of order 2
    assert exchanged(facts, "ict_index") == 0 and exchanged(facts, "q") > 0


def test_a_first_load_compares_and_stages_nothing(spark, tmp_path, monkeypatch):
    def compared(*_):
        raise AssertionError("compared with an empty table")

    monkeypatch.setattr(TableStore, "_changed", compared)
    store = TableStore(spark, str(tmp_path / "store"), rows_per_bucket=2)
    facts = [match(p, f, round=f) for p in range(1, 4) for f in (1, 2)]
    rows = conform(spark.createDataFrame([(m["element"], m["fixture"], m["round"]) for m in facts], "element bigint, fixture bigint, round int"), FACTS)
    assert store.upsert(FACTS, rows) == 1
    assert sorted((r.element, r.fixture) for r in store.read(FACTS).collect()) == sorted((m["element"], m["fixture"]) for m in facts)
    assert not (tmp_path / "store/staging").exists()


def test_settled_records_leave_their_text(spark):
    good = match(1, 1)
    records = [good, {**good, "fixture": 2, "minutes": "n/a"}, {**good, "fixture": 3, "referee": None}]
    landed = spark.createDataFrame([("d", i, json.dumps(r)) for i, r in enumerate(records)] + [("d", 3, None)], "doc string, pos int, record string")
    checked = contract.validate(landed, FACTS)
    kept = {r._pos: (r._record is not None, r.errors) for r in without_settled_text(checked, FACTS).collect()}
    assert {pos: text for pos, (text, _) in kept.items()} == {0: False, 1: True, 2: True, 3: False}
    assert {pos: e for pos, (_, e) in kept.items()} == {r._pos: r.errors for r in checked.collect()}
    assert set(column_names(FACTS)) < set(checked.columns)


def optimized(df) -> str:
    df.sparkSession.conf.set("spark.sql.debug.maxToStringFields", "10000")
    try:
        return df._jdf.queryExecution().optimizedPlan().toString()
    finally:
        df.sparkSession.conf.unset("spark.sql.debug.maxToStringFields")


def test_only_shown_columns_of_a_record_are_worked_out(spark):
    good = match(1, 1)
    records = [good, {**good, "minutes": "n/a"}, {**good, "minutes": "7"}, {**good, "influence": 3}]
    landed = spark.createDataFrame([("d", i, json.dumps(r)) for i, r in enumerate(records)], "doc string, pos int, record string")
    checked = contract.validate(landed, FACTS)
    plan = optimized(checked.select("element", "minutes"))
    assert "not a valid" not in plan and "null in a not-null column" not in plan
    assert [(r._pos, r.minutes, r.errors) for r in checked.orderBy("_pos").collect()] == [
        (0, 0, ""),
        (1, None, "minutes: not a valid int: n/a"),
        (2, 7, ""),
        (3, 0, "influence: not a valid str: 3"),
    ]


def test_a_document_is_parsed_once(spark):
    docs = spark.createDataFrame(
        [("a", '{"history": [{"x": 1}, {"x": 2}]}'), ("b", '{"history": []}'), ("c", '{"other": 1}'), ("d", '{"history": [{"x": 1}]} more'), ("e", None)],
        "doc string, value string",
    )
    records = landing.history_records(docs)
    got = sorted((r.doc, r.pos, r.record) for r in records.collect())
    assert got == [("a", 0, '{"x":1}'), ("a", 1, '{"x":2}'), ("d", 0, None), ("e", 0, None)]
    assert len(re.findall(r"from_json\(", optimized(records))) == 1


def test_wide_rows_are_compiled_in_any_session():
    class Conf(dict):
        def set(self, key, value):
            self[key] = value

    limit = "spark.sql.codegen.hugeMethodLimit"
    foreign = SimpleNamespace(conf=Conf({limit: "65535", "spark.executor.extraJavaOptions": "-Xss4m"}))
    compile_wide_rows(foreign)
    assert foreign.conf[limit] == "8000"
    own = SimpleNamespace(conf=Conf({limit: "65535", **SETTINGS}))
    compile_wide_rows(own)
    assert own.conf[limit] == "65535"


def test_small_buckets_are_not_cut_by_round(spark, tmp_path):
    store = TableStore(spark, str(tmp_path / "store"), rows_per_bucket=10)
    facts = [match(p, f, round=f) for p in range(1, 6) for f in range(1, 9)]
    files = lambda: list((tmp_path / f"store/data/{FACTS}").rglob("*.parquet"))
    store.upsert(FACTS, league_rows(spark, FACTS, facts))
    assert 1 < len({p.parent.parent.name for p in files()}) <= 4 and len(files()) <= 4  # one per bucket, 8 rounds in each
    moved = [{**m, "round": 9} for m in facts if m["fixture"] == 3]
    assert store.upsert(FACTS, league_rows(spark, FACTS, [*facts[:2], *moved])) == 2 and len(files()) <= 8
    want = sorted((m["element"], m["fixture"], 9 if m["fixture"] == 3 else m["round"]) for m in facts)
    assert sorted((r.element, r.fixture, r.round) for r in store.read(FACTS).collect()) == want


def test_a_row_that_moves_leaves_its_slice(spark, tmp_path):
    store = TableStore(spark, str(tmp_path / "store"))
    facts = [match(p, f, round=f) for p in range(1, 4) for f in (1, 2)]
    store.upsert(FACTS, league_rows(spark, FACTS, facts))
    slices = {p.parent.name for p in (tmp_path / f"store/data/{FACTS}/v=1").rglob("*.parquet")}
    assert len(slices) == 2  # a round has its own where a bucket has rows for it
    assert store.upsert(FACTS, league_rows(spark, FACTS, [{**facts[0], "round": 30}])) == 2
    assert {p.parent.name for p in (tmp_path / f"store/data/{FACTS}/v=2").rglob("*.parquet")} == {"_slice=1", "_slice=30"}
    got = sorted((r.element, r.fixture, r.round) for r in store.read(FACTS).collect())
    assert got == sorted([(1, 1, 30), *[(m["element"], m["fixture"], m["round"]) for m in facts[1:]]])
    assert store.upsert(FACTS, league_rows(spark, FACTS, [match(9, 9, round=25)])) == 3  # a cell that isn't there yet
    assert store.read(FACTS).count() == 7


def test_a_table_cut_by_round_stays_so(spark, tmp_path):
    store = TableStore(spark, str(tmp_path / "store"))
    facts = [match(p, f, round=f) for p in (1, 2) for f in (1, 2)]
    old = store._prepared(FACTS, league_rows(spark, FACTS, facts), 2, None).localCheckpoint()
    old.write.partitionBy("_bucket", "round").parquet(f"{store.root}/data/{FACTS}/v=1")
    cells = {(str(r.round), r._bucket) for r in old.collect()}
    spark.createDataFrame(
        [(1, part, bucket, True, 2, None) for part, bucket in cells],
        "version bigint, partition string, bucket int, has_rows boolean, buckets int, batch string",
    ).write.json(f"{store.root}/commits/{FACTS}")
    assert store.read(FACTS).count() == 4
    assert store.upsert(FACTS, league_rows(spark, FACTS, [{**facts[0], "round": 7}, facts[1], match(3, 1, saves=2)])) == 2
    assert (tmp_path / f"store/data/{FACTS}/v=2").exists() and not list((tmp_path / "store/data").rglob("_slice=*"))
    want = [(1, 1, 7, 0), (1, 2, 2, 0), (2, 1, 1, 0), (2, 2, 2, 0), (3, 1, 1, 2)]
    assert sorted((r.element, r.fixture, r.round, r.saves) for r in store.read(FACTS).collect()) == want


def test_placed_merge_keeps_what_merge_keeps(spark):
    ddl = "k bigint, j bigint, cell int, v string"
    target = spark.createDataFrame([(1, 1, 0, "a"), (2, 1, 0, "b"), (3, 1, 1, "c"), (None, 1, 0, "n"), (4, 1, 1, "d"), (4, 1, 1, "e")], ddl)
    source = spark.createDataFrame([(1, 1, 0, "A"), (2, 1, 1, "B"), (None, 1, 0, "N"), (5, 1, 1, "F")], ddl)
    left = spark.createDataFrame([(2, 1, 0)], "k bigint, j bigint, cell int")
    want = sorted(map(str, merge.merge(target, source, ["k", "j"]).collect()))
    for parts in (1, 3):
        placed = merge.merge_placed(target, source, left, ["k", "j"], ["cell"], parts)
        assert sorted(map(str, placed.collect())) == want
    assert exchanged(placed, "v") == 1


def test_shuffles_of_a_load_are_released(spark, tmp_path):
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    seen, old = [], spark.conf.get(name, None)
    store = TableStore(spark, str(tmp_path / "store"))
    store.upsert(FACTS, league_rows(spark, FACTS, [match(1, 1)]).filter("fixture > 0"))
    with released_shuffles(spark):
        seen.append(spark.conf.get(name))
    assert seen == ["true"] and spark.conf.get(name, None) == old
    kept = spark._jvm.org.apache.spark.SparkEnv.get().mapOutputTracker()
    before = kept.shuffleStatuses().size()
    store.upsert(FACTS, league_rows(spark, FACTS, [match(1, 1, saves=1), match(2, 1)]))
    assert kept.shuffleStatuses().size() <= before


def test_only_keys_that_repeat_in_a_batch_are_put_together(spark, tmp_path):
    ddl = "k bigint, j bigint, at int, v string"
    once = spark.createDataFrame([(1, 1, 0, "a"), (1, 2, 0, "b"), (2, 1, 5, "c")], ddl)
    got = latest_rows(once, ["k", "j"], ["at"], str(tmp_path / "once"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, once.collect())) and not (tmp_path / "once/latest").exists()
    # the plan that ran moved no row
    assert "Exchange hashpartitioning" not in got._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    more = once.union(spark.createDataFrame([(1, 1, 2, "d"), (1, 1, 1, "e"), (2, 1, 4, "f")], ddl))
    got = latest_rows(more, ["k", "j"], ["at"], str(tmp_path / "more"))
    assert sorted((r.k, r.j, r.v) for r in got.collect()) == [(1, 1, "d"), (1, 2, "b"), (2, 1, "c")]
    assert (tmp_path / "more/latest").exists()


def test_references_are_grouped_by_numbers(spark):
    tables = league(spark, [player(1, 1), player(2, 1, 9)], [fixture(1, None), fixture(2, 77)], [match(1, 1), match(5, 1), match(5, 2)]).named()
    used = integrity._used_values(tables, {})
    assert {f.name: f.dataType.simpleString() for f in used.schema.fields if f.name in ("parent", "value")} == {"parent": "int", "value": "bigint"}
    found = sorted((r.child, r.child_column, r.parent, r.reference, r.orphan_rows) for r in integrity.foreign_key_orphans(tables).collect())
    assert found == [("fixtures", "event", "gameweeks", 77, 1), ("player_gameweek_stats", "element", "players", 5, 2), ("players", "team", "teams", 9, 1)]
