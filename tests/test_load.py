"""Landed documents, contract, drift, merge, audits, load job and stream."""

from __future__ import annotations

import copy
import json
from datetime import datetime, timezone

import pytest
from pyspark.sql.functions import col, spark_partition_id
from league import fixture, gameweek, league, match, player, rows, team

from touchline.operators import contract, drift, integrity, merge, views
from touchline.plans import contract_check
from touchline.plans.load import LandingPaths, close_run, landed_records, open_run, run_load, runs
from touchline.plans.player_stats import player_stats
from touchline.sources import landing
from touchline.sources.schemas import column_names
from touchline.sources.store import TableStore
from touchline.streaming.landing_stream import load_histories

BOOTSTRAP = {
    "teams": [team(1, "AAA"), team(2, "BBB")],
    "events": [
        {**gameweek(1), "deadline_time": "2025-08-15T17:30:00Z", "finished": True, "chip_plays": [{"n": 1}]},
        {**gameweek(2), "deadline_time": "2025-08-22T17:30:00Z", "is_next": True},
    ],
    "elements": [player(1, 1), player(2, 3), player(3, 4)],
}
FIXTURES = [
    {**fixture(1, 1), "kickoff_time": "2025-08-16T14:00:00Z"},
    {**fixture(2, 2), "finished": False, "kickoff_time": None},
]
HISTORY = {1: [match(1, 1, minutes=90, total_points=6)], 2: [match(2, 1, minutes="45", bonus=2.0)], 3: []}


class Landing:
    def __init__(self, root):
        self.root = root
        self.paths = LandingPaths.under(str(root))

    def write(self, bootstrap=BOOTSTRAP, fixtures=FIXTURES, history=HISTORY):
        documents = {"bootstrap-static/all.json": bootstrap, "fixtures/all.json": fixtures}
        for i, items in history.items():
            documents[f"element-summary/{i}.json"] = {"history": items}
        for name, body in documents.items():
            path = self.root / name
            path.parent.mkdir(parents=True, exist_ok=True)
            path.write_text(json.dumps(body))
        return self


@pytest.fixture
def landed(tmp_path):
    return Landing(tmp_path / "landing").write()


@pytest.fixture
def store(spark, tmp_path):
    return TableStore(spark, str(tmp_path / "store"))


def records(spark, *items):
    data = [("doc", i, item if isinstance(item, str) else json.dumps(item)) for i, item in enumerate(items)]
    return spark.createDataFrame(data, "doc string, pos int, record string")


def reasons(spark, entity, *items):
    checked = contract.validate(records(spark, *items), entity)
    return {r.row: r.reasons for r in contract.rejects(checked, entity).collect()}


def test_contract_kinds(spark):
    good = match(1, 1)
    found = reasons(
        spark, "player_gameweek_stats",
        good,
        {**good, "minutes": "7", "bonus": 7.0, "saves": True, "was_home": "yes", "modified": None},
        {k: v for k, v in good.items() if k != "was_home"},
        {**good, "was_home": None},
        {**good, "minutes": 7.5},
        {**good, "minutes": "x", "round": None},
        {**good, "expected_goals": 0.5},
        {**good, "expected_goals": None, "value": None, "new_key": {"minutes": "n/a"}},
        {**good, "kickoff_time": "soon"},
        "not json",
        [1],
        {**good, "minutes": "true"},
    )
    assert found == {
        1: "modified: null in a not-null column",
        2: "was_home: field required",
        3: "was_home: null is not a valid bool",
        4: "minutes: not a valid int: 7.5",
        5: "round: null is not a valid int; minutes: not a valid int: x",
        6: "expected_goals: not a valid str: 0.5",
        8: "kickoff_time: cannot be stored as timestamp",
        9: "not a JSON object",
        10: "not a JSON object",
        11: "minutes: not a valid int: true",
    }


def test_repeated_keys_and_text_after_a_record(spark):
    good = json.dumps(match(1, 1))
    found = reasons(
        spark, "player_gameweek_stats",
        good[:-1] + ', "minutes": 12}', good[:-1] + ', "minutes": "x"}', good[:-1] + ', "minutes": "x", "minutes": 4}',
        good + " late", good + "}", good + good, good + "  ", '{"x": {"expected_goals": 1, "bonus": null}, ' + good[1:],
        good[:-1] + ', "bonus": null}', good[:-1] + ', "\\u0062onus": null}',
    )
    assert found == {
        1: "minutes: not a valid int: x", 3: "not a JSON object", 4: "not a JSON object", 5: "not a JSON object",
        8: "bonus: null is not a valid int", 9: "bonus: null is not a valid int",
    }
    checked = contract.validate(records(spark, good[:-1] + ', "minutes": 12}', good[:-1] + ', "minutes": "x", "minutes": 4}'), "player_gameweek_stats")
    assert [r.minutes for r in checked.orderBy("_pos").collect()] == [12, 4]


def test_contract_values_defaults_and_open_records(spark):
    item = {**match(1, 1), "minutes": "7", "bonus": 7.0, "saves": True, "extra": 5, "form": [1, {"saves": None}]}
    row = contract.validate(records(spark, item), "player_gameweek_stats").first()
    assert (row.minutes, row.bonus, row.saves, row.starts, row.modified) == (7, 7, 1, 0, False)
    assert row.value is None and json.loads(row._record)["extra"] == 5
    one = contract.validate(records(spark, {**gameweek(1), "deadline_time": None}), "gameweeks")
    # optional in the contract, not null in the table
    assert contract.rejects(one, "gameweeks").first().reasons == "deadline_time: null in a not-null column"


def test_drift(spark):
    frame = records(spark, {"id": 1, "a": None, "b": 1}, {"id": 2, "a": "x", "c": None}, {"a": "y", "b": 2})
    known = spark.createDataFrame([("id",), ("gone",)], "field string")
    assert {r.field for r in drift.new_fields(frame, known).collect()} == {"a", "b", "c"}
    report = [tuple(r) for r in drift.drift_report(frame, known).collect()]
    assert report == [("a", "x"), ("b", "1"), ("c", None)]


def test_snapshot_refresh(spark, landed, tmp_path):
    contract_check.refresh_snapshots(spark, landed.paths, str(tmp_path / "snapshots"))
    kept = drift.read_snapshot(spark, str(tmp_path / "snapshots/teams"))
    assert [r.field for r in kept.collect()] == sorted(BOOTSTRAP["teams"][0])


def test_contract_check(spark, landed):
    contract_check.check_contract(spark, landed.paths)
    changed = copy.deepcopy(BOOTSTRAP)
    changed["elements"][1]["mood"] = "good"
    landed.write(bootstrap=changed)
    with pytest.raises(contract.ContractError, match="players: mood, as in good"):
        contract_check.check_contract(spark, landed.paths)
    changed["teams"][0]["id"] = "one"
    landed.write(bootstrap=changed)
    with pytest.raises(contract.ContractError, match="id: not a valid int: one"):
        contract_check.check_contract(spark, landed.paths)


def test_findings_are_what_the_check_raises_for(spark, landed):
    assert contract_check.contract_findings(landed_records(spark, landed.paths)).collect() == []
    changed = copy.deepcopy(BOOTSTRAP)
    changed["elements"][1]["mood"] = "good"
    changed["teams"][0]["id"] = "one"
    del changed["events"][1]["name"]
    landed.write(bootstrap=changed, fixtures="no list")
    found = contract_check.contract_findings(landed_records(spark, landed.paths)).collect()
    assert {tuple(r) for r in found} == {
        ("teams", "one", "id: not a valid int: one"), ("gameweeks", "2", "name: field required"),
        ("fixtures", "?", "document without a readable list of records"), ("players", None, "new field mood, as in good"),
    }


def test_check_reads_all_histories(spark, landed, store):
    landed.write(
        bootstrap={**BOOTSTRAP, "elements": [player(i, 1) for i in range(1, 9)]},
        history={i: [{**match(i, 1), **({"mood": "good"} if i == 8 else {})}] for i in range(1, 9)},
    )
    docs = landing.documents(spark, landed.paths.bootstrap)
    assert [r.id for r in landing.sample_players(docs).collect()] == [1, 2, 3, 4, 5]
    for check in (lambda: contract_check.check_contract(spark, landed.paths), lambda: run_load(store, landed.paths)):
        with pytest.raises(contract.ContractError, match="player_gameweek_stats: mood"):
            check()
    assert store.read("teams").count() == 0


@pytest.mark.parametrize(
    "name,text",
    [
        ("element-summary/2.json", '{"history": [{"element": 2'),
        ("element-summary/2.json", '{"history": {"element": 2}}'),
        ("element-summary/2.json", "late"),
        ("element-summary/2.json", '{"history": []} late'),
        ("fixtures/all.json", "[]]"),
        ("fixtures/all.json", '[{"id": 1'),
        ("fixtures/all.json", '{"detail": "err"}'),
        ("bootstrap-static/all.json", '{"events": [], "elements": []}'),
    ],
)
def test_unreadable_documents_are_rejected(spark, landed, store, name, text):
    (landed.root / name).write_text(text)
    with pytest.raises(contract.ContractError, match="document without a readable list of records"):
        run_load(store, landed.paths)
    assert store.read("fixtures").count() == 0


def test_deeply_nested_values(spark):
    deep = {"a": {"b": {"c": {"d": {"minutes": None}}}}, "z": 1}
    good = match(1, 1)
    found = reasons(spark, "player_gameweek_stats", {**good, "x": deep}, {**good, "x": deep, "minutes": None})
    assert found == {1: "minutes: null is not a valid int"}


def test_empty_histories(spark, landed, store):
    docs = spark.createDataFrame([("d", '{"history": []}'), ("e", "{}")], "doc string, value string")
    assert landing.history_records(docs).columns == ["doc", "pos", "record"]
    assert landing.history_records(docs).count() == 0
    landed.write(history={1: [], 2: [], 3: []})
    run_load(store, landed.paths)
    facts = store.read("player_gameweek_stats")
    assert facts.count() == 0 and facts.columns == column_names("player_gameweek_stats")


def test_load_twice_and_correct(spark, landed, store, tmp_path):
    clock = iter(datetime(2025, 8, 20, hour, tzinfo=timezone.utc) for hour in range(24)).__next__
    one = run_load(store, landed.paths, clock)
    first = sorted(map(tuple, store.read("player_gameweek_stats").collect()))
    files = sorted(p.name for p in (tmp_path / "store/data").rglob("*.parquet"))
    assert run_load(store, landed.paths, clock) > one
    # nothing changed, so no data file is written
    assert sorted(p.name for p in (tmp_path / "store/data").rglob("*.parquet")) == files
    assert sorted(map(tuple, store.read("player_gameweek_stats").collect())) == first
    assert len(first) == 2
    week = store.read("gameweeks").filter("id = 1").first()
    assert json.loads(week.chip_plays) == [{"n": 1}] and week.deadline_time.hour == 17
    assert [r.pts for r in player_stats(store.tables()).collect()] == [6, 0]
    assert views.etl_last_updated(runs(store)).first().finished_at.hour == 3

    landed.write(history={**HISTORY, 1: [match(1, 1, minutes=90, total_points=9)]})
    run_load(store, landed.paths, clock)
    assert [r.pts for r in player_stats(store.tables()).collect()] == [9, 0]


def test_rejected_load_writes_nothing(spark, landed, store):
    landed.write(history={1: [match(1, 1, minutes="x")], 2: [{"element": 2}]})
    with pytest.raises(contract.ContractError, match="refused: 2"):
        run_load(store, landed.paths)
    assert store.read("teams").count() == 0 and runs(store).count() == 0


def test_unfinished_run_is_not_seen(store):
    at = lambda hour: datetime(2025, 8, 20, hour, tzinfo=timezone.utc)
    first, second = open_run(store, at(1)), open_run(store, at(2))
    assert first < second and runs(store).count() == 2
    assert views.etl_last_updated(runs(store)).count() == 0
    close_run(store, first, at(1), at(5))
    assert {r.id: (r.started_at.hour, r.finished_at and r.finished_at.hour) for r in runs(store).collect()} == {first: (1, 5), second: (2, None)}
    assert views.etl_last_updated(runs(store)).first().finished_at.hour == 5


def test_moved_fixture_leaves_no_old_row(spark, store):
    name = "player_gameweek_stats"
    store.upsert(name, rows(spark, name, [match(1, 1), match(2, 1), match(1, 2, round=2)]))
    store.upsert(name, rows(spark, name, [match(1, 1, round=3), match(2, 1, round=3)]))
    got = sorted((r.element, r.fixture, r.round) for r in store.read(name).collect())
    assert got == [(1, 1, 3), (1, 2, 2), (2, 1, 3)]
    assert store.read(name).filter("round = 1").count() == 0


def test_uncommitted_version_is_not_read(spark, store):
    store.upsert("teams", rows(spark, "teams", [team(1, "AAA")]))
    rows(spark, "teams", [team(2, "BBB")]).write.parquet(f"{store.root}/data/teams/v=2/_bucket=0")
    assert [r.short_name for r in store.read("teams").collect()] == ["AAA"]
    store.upsert("teams", rows(spark, "teams", [team(3, "CCC")]))
    assert sorted(r.short_name for r in store.read("teams").collect()) == ["AAA", "CCC"]


def test_repeated_key_in_one_load(spark, store):
    with pytest.raises(merge.DuplicateKeyError):
        store.upsert("teams", rows(spark, "teams", [team(1, "AAA"), team(1, "BBB")]))
    assert store.upsert("teams", rows(spark, "teams", [])) is None


def test_stream_takes_new_files_once(spark, landed, store):
    path = landed.paths.histories
    load_histories(store, path, "stream-test", references=False).awaitTermination()
    assert store.read("player_gameweek_stats").count() == 2
    (landed.root / "element-summary/1-later.json").write_text(
        json.dumps({"history": [match(1, 1, minutes=10), match(1, 2, round=2)]})
    )
    load_histories(store, path, "stream-test", references=False).awaitTermination()
    got = sorted((r.element, r.fixture, r.minutes) for r in store.read("player_gameweek_stats").collect())
    assert got == [(1, 1, 10), (1, 2, 0), (2, 1, 45)]


def test_a_load_rewrites_only_changed_buckets(spark, store, tmp_path):
    store, name = TableStore(spark, store.root, rows_per_bucket=2), "player_gameweek_stats"
    facts = [match(p, f, round=f) for p in range(1, 6) for f in (1, 2)]
    store.upsert(name, rows(spark, name, facts))
    files = lambda: {p for p in (tmp_path / "store/data").rglob("*.parquet")}
    before = files()
    assert len({p.parent.parent.name for p in before}) > 2  # buckets
    assert store.upsert(name, rows(spark, name, facts[:7])) is None and files() == before
    # one row changes, one moves, one is the same
    version = store.upsert(name, rows(spark, name, [{**facts[0], "saves": 3}, {**facts[3], "round": 9}, facts[5]]))
    added = {p.relative_to(tmp_path / f"store/data/{name}/v={version}").parent.as_posix() for p in files() - before}
    assert len({a.split("/")[0] for a in added}) <= 2
    want = sorted((*(m[k] for k in ("element", "fixture", "round")), 0) for m in facts)
    want[0], want[3] = (1, 1, 1, 3), (2, 2, 9, 0)
    assert sorted((r.element, r.fixture, r.round, r.saves) for r in store.read(name).collect()) == sorted(want)
    # a value that becomes null is a change
    assert store.upsert(name, rows(spark, name, [{**facts[0], "saves": 3, "value": 5}])) and store.upsert(name, rows(spark, name, [{**facts[0], "saves": 3}]))


def test_a_batch_is_applied_once(spark, store):
    old, new = [team(1, "AAA")], [team(1, "BBB")]
    assert store.upsert("teams", rows(spark, "teams", old), batch="s/0") == 1
    assert store.upsert("teams", rows(spark, "teams", old), batch="s/1") is None  # nothing new, but noted
    assert store.upsert("teams", rows(spark, "teams", new), batch="s/2") == 2
    for replayed in ("s/0", "s/1", "s/2"):
        assert store.upsert("teams", rows(spark, "teams", old), batch=replayed) is None
    assert store.read("teams").first().name == "BBB"


def test_orphans_fail_the_load(spark, landed, store):
    landed.write(history={1: [match(1, 1), match(77, 1)], 2: [match(2, 99, opponent_team=88)]})
    with pytest.raises(integrity.OrphanError, match="element = 77: 1 row"):
        run_load(store, landed.paths)
    assert store.read("teams").count() == 0 and runs(store).count() == 0
    landed.write()
    run_load(store, landed.paths)
    # later documents may refer to stored rows
    landed.write(bootstrap={**BOOTSTRAP, "teams": [], "events": [], "elements": []}, fixtures=[], history={2: [match(2, 1, minutes=3)]})
    run_load(store, landed.paths)
    assert store.read("player_gameweek_stats").filter("element = 2").first().minutes == 3


def test_stream_rejects_and_references(spark, landed, store):
    run_load(store, landed.paths)
    path = landed.root / "lines"
    path.mkdir()
    documents = [{"history": [match(1, 1, minutes=8), {**match(2, 1), "mood": 1}]}, {"history": [match(3, 1, minutes="x")]}]
    (path / "a.json").write_text("\n".join(map(json.dumps, documents)) + "\nnot json")
    with pytest.raises(Exception, match="3 records refused"):
        load_histories(store, str(path), "strict", lines=True).awaitTermination()
    assert store.read("player_gameweek_stats").filter("minutes = 8").count() == 0
    load_histories(store, str(path), "lax", lines=True, keep_going=True).awaitTermination()
    refused = spark.read.parquet(f"{store.root}/rejects/player_gameweek_stats/lax")
    assert sorted(r.reasons for r in refused.collect()) == [
        "document without a readable list of records", "minutes: not a valid int: x", "unknown fields: mood",
    ]
    assert sorted((r.element, r.minutes) for r in store.read("player_gameweek_stats").collect()) == [(1, 8), (2, 45)]
    (path / "b.json").write_text(json.dumps({"history": [match(66, 1)]}))
    with pytest.raises(Exception, match="element = 66"):
        load_histories(store, str(path), "lax", lines=True).awaitTermination()


def test_records_of_one_document_are_checked_by_many_tasks(spark):
    many = json.dumps([{**fixture(i, 1)} for i in range(20_000)])
    docs = spark.createDataFrame([("d", many)], "doc string, value string")
    records = landing.fixture_records(docs)
    assert records.select(spark_partition_id()).distinct().count() > 1
    assert records.count() == 20_000


def test_column_audit(spark):
    tables = league(spark, [player(1, 1), player(2, 1)], [fixture(1, None)], [match(1, 1), match(1, 2)]).named()
    del tables["gameweeks"]
    tables["teams"] = tables["teams"].drop("name").selectExpr("*", "1 as extra").withColumn("win", col("win").cast("string"))
    tables["player_gameweek_stats"] = tables["player_gameweek_stats"].selectExpr("* except (bps)", "nullif(element, element) as bps")
    found = {tuple(r) for r in integrity.column_audit(tables).collect()}
    assert found == {
        ("etl_runs", None, "missing table", None), ("gameweeks", None, "missing table", None), ("teams", "name", "missing column", None),
        ("teams", "win", "string instead of int", None), ("player_gameweek_stats", "bps", "bigint instead of int", None),
        ("player_gameweek_stats", "bps", "null", 2),
    }


def test_audits(spark):
    tables = league(
        spark, [player(1, 1), player(2, 1, 9)], [fixture(1, None), fixture(2, 77)],
        [match(1, 1), match(1, 1), match(5, 1), match(5, 2)],
    )
    named = tables.named()
    keys = {r.table_name: (r.duplicate_keys, r.extra_rows) for r in integrity.primary_key_audit(named).collect()}
    assert keys["player_gameweek_stats"] == (1, 1) and keys["teams"] == (0, 0)
    references = {
        (r.child, r.child_column): (r.orphan_values, r.orphan_rows)
        for r in integrity.foreign_key_audit(named).collect()
    }
    assert len(references) == 8
    assert references["players", "team"] == (1, 1)
    assert references["fixtures", "event"] == (1, 1)  # null refers to nothing
    assert references["player_gameweek_stats", "element"] == (1, 2)
    nulls = {r.column_name: r.nulls for r in integrity.null_audit(tables.gameweeks, "gameweeks").collect()}
    assert nulls["deadline_time"] == 2 and nulls["finished"] == 0
