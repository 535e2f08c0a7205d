"""

Every query reads whole test tables through ``touchline.sources.driver_tables``.
Decimals are handed out as doubles and arrays as text, so that values compare
across engines.
"""

from __future__ import annotations

import os
import sys
from collections.abc import Callable
from dataclasses import replace

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import Column, DataFrame, SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402
from pyspark.sql import types as T  # noqa: E402

import oracle  # noqa: E402
from touchline.functions.labels import age_label  # noqa: E402
from touchline.operators import contract, drift, integrity, merge, runs, selection, views  # noqa: E402
from touchline.plans import fixtures_grid as grid  # noqa: E402
from touchline.plans import player_history as hist  # noqa: E402
from touchline.plans import player_stats as stats  # noqa: E402
from touchline.plans.contract_check import contract_findings  # noqa: E402
from touchline.plans.load import LandingPaths, run_load  # noqa: E402
from touchline.session import released_shuffles, shared_dir  # noqa: E402
from touchline.sources import driver_tables as data  # noqa: E402
from touchline.sources import landing  # noqa: E402
from touchline.sources.schemas import conform  # noqa: E402
from touchline.sources.store import TableStore  # noqa: E402
from touchline.streaming.landing_stream import load_histories, load_rows  # noqa: E402

#: The training-data operators and their pipeline stand apart; without them the rest works.
try:
    import corpus_pipeline
    from touchline.llm import queries as llm_queries

    WITH_LLM = True
except ImportError:
    WITH_LLM = False
if WITH_LLM:
    from pyspark import cloudpickle

    import touchline

    # Functions go to the executors with their code, so these need no copy of the package.
    cloudpickle.register_pickle_by_value(touchline)

Query = Callable[[SparkSession, str], DataFrame]

FLAGSHIP_DIR = "/root/testdata/sf0.001"
LAST_N = 8
RANGE = (5, 20)
#: Narrow forms: one player, one team, a range of gameweeks, and a next gameweek that has
#: finished matches after it.
ONE_PLAYER, ONE_TEAM, OWN_RANGE, EARLY_NEXT = 7, "T000003", (3, 9), 21
FILTERS = {"pos": "MID", "max_price": 7.5, "min_mp_pct": 45.0}


def portable(df: DataFrame) -> DataFrame:
    """Decimals as doubles, arrays of numbers as text with two decimals."""

    def plain(field: T.StructField) -> Column:
        column = F.col(f"`{field.name}`")
        if isinstance(field.dataType, T.DecimalType):
            column = column.cast("double")
        elif isinstance(field.dataType, T.ArrayType):
            column = F.array_join(
                F.transform(column, lambda x: x.cast("decimal(18,2)").cast("string")), ";"
            )
        return column.alias(field.name)

    return df.select(*[plain(field) for field in df.schema.fields])


def _over(facts: str, build: Callable[..., DataFrame], sql_rows: bool = False) -> Query:
    return lambda spark, sf: portable(build(data.tables(spark, sf, facts, sql_rows)))


# --- player table ---------------------------------------------------------------


def _player_stats(**selected) -> Query:
    return _over("measures", lambda t: stats.player_stats(t, **selected))


def _stats_table(mode: str) -> Query:
    return _over("measures", lambda t: stats.stats_table(stats.player_stats(t, last_n=LAST_N), mode))


# --- landed documents and records derived from the tables -----------------------


def _chunked_documents(rows: DataFrame, chunk: Column, array: str | None) -> DataFrame:
    """Rows as landed documents of at most 64 records: the chunk is a range of 64
    values of an id that is unique in the group."""
    collected = F.collect_list(F.struct(*rows.columns))
    body = collected if array is None else F.struct(collected.alias(array))
    return rows.groupBy(chunk.alias("chunk")).agg(F.to_json(body).alias("value")).select(
        F.col("chunk").cast("string").alias("doc"), "value"
    )


def ingest_teams(spark: SparkSession, sf: str) -> DataFrame:
    teams = data.raw_teams(spark, sf)
    docs = _chunked_documents(teams, F.floor(F.col("id") / F.lit(64)), "teams")
    records = landing.bootstrap_records(docs, "teams")
    rows = contract.accepted(contract.validate(records, "teams"), "teams")
    return rows.select(*teams.columns, "draw", "unavailable")


def ingest_worklist(spark: SparkSession, sf: str) -> DataFrame:
    people = data.raw_players(spark, sf).select("id", "web_name")
    docs = _chunked_documents(people, F.floor(F.col("id") / F.lit(64)), "elements")
    return landing.player_ids(docs).select("id")


def sample_players(spark: SparkSession, sf: str) -> DataFrame:
    people = data.raw_players(spark, sf).select("id")
    docs = people.select(
        F.lpad(F.col("id").cast("string"), 20, "0").alias("doc"),
        F.to_json(F.struct(F.array(F.struct("id")).alias("elements"))).alias("value"),
    )
    return landing.sample_players(docs).select("id")


def ingest_fixtures(spark: SparkSession, sf: str) -> DataFrame:
    matches = data.raw_fixtures(spark, sf)
    docs = _chunked_documents(matches, F.floor(F.col("id") / F.lit(64)), None)
    records = landing.fixture_records(docs)
    rows = contract.accepted(contract.validate(records, "fixtures"), "fixtures")
    return rows.select(*matches.columns)


def ingest_bad_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Fixture documents of which some, by rule of their number, have text after the list,
    end early, are an object or are empty: every row, and every document without any."""
    matches = data.raw_fixtures(spark, sf)
    docs = _chunked_documents(matches, F.floor(F.col("id") / F.lit(64)), None)
    broken = docs.selectExpr(
        "doc",
        "case cast(doc as bigint) % 10 when 1 then concat(value, ' trailing') when 2 then left(value, length(value) - 1)"
        " when 3 then concat('{\"fixtures\":', value, '}') when 4 then '' else value end as value",
    )
    checked = contract.validate(landing.fixture_records(broken), "fixtures")
    good = contract.accepted(checked, "fixtures", "_doc").selectExpr("_doc as doc", "cast(id as string) as id", "'' as reasons")
    return good.unionByName(contract.rejects(checked, "fixtures").select("doc", "id", "reasons"))


def contract_report(spark: SparkSession, sf: str) -> DataFrame:
    """The contract check over landed records of all entities, with faults by rule of the
    ids; keys are left out of a record where their value is null."""
    edits = {
        "teams": (data.raw_teams(spark, sf), {"short_name": "if(id % 9 = 1, null, short_name)", "stadium": "if(id % 7 = 3, 'north', null)"}),
        "gameweeks": (data.raw_gameweeks(spark, sf), {"name": "if(id % 9 = 2, null, name)"}),
        "players": (_people(spark, sf), {"now_cost": "if(id % 20 = 2, 'dear', cast(now_cost as string))"}),
        "fixtures": (
            data.raw_fixtures(spark, sf),
            {"team_a": "if(id % 50 = 3, null, team_a)", "team_h_difficulty": "if(id % 50 = 3, 'hard', cast(team_h_difficulty as string))"},
        ),
    }
    by_id = F.floor(F.col("id") / F.lit(64))
    docs = {
        name: _chunked_documents(rows.withColumns({c: F.expr(sql) for c, sql in faults.items()}), by_id, landing.BOOTSTRAP_ARRAYS.get(name))
        for name, (rows, faults) in edits.items()
    }
    records = {name: landing.bootstrap_records(docs[name], name) for name in landing.BOOTSTRAP_ARRAYS}
    records["fixtures"] = landing.fixture_records(docs["fixtures"])
    records["player_gameweek_stats"] = _landed(match_records(spark, sf))
    return contract_findings(records)


MATCH_FIELDS = [
    "element", "fixture", "round", "was_home", "minutes", "total_points", "expected_goals",
    "expected_assists", "saves", "bonus",
]


def ingest_flatten_history(spark: SparkSession, sf: str, sql_rows: bool = True) -> DataFrame:
    """Players' documents, cut to at most 64 fixtures each, and one empty document
    per team, back to match rows."""
    rows = data.match_measures(spark, sf, sql_rows=sql_rows).select(*MATCH_FIELDS)
    empty = data.raw_teams(spark, sf).select(
        F.col("short_name").alias("doc"), F.lit('{"history": []}').alias("value")
    )
    records = landing.history_records(_history_documents(rows).unionByName(empty))
    return records.select(F.from_json("record", rows.schema).alias("r")).select("r.*")


def _history_documents(rows: DataFrame) -> DataFrame:
    chunk = F.concat_ws("/", "element", F.floor(F.col("fixture") / F.lit(64)))
    return _chunked_documents(rows, chunk, "history")


def ingest_gameweeks(spark: SparkSession, sf: str) -> DataFrame:
    weeks = data.raw_gameweeks(spark, sf)
    docs = _chunked_documents(weeks, F.floor(F.col("id") / F.lit(64)), "events")
    checked = contract.validate(landing.bootstrap_records(docs, "gameweeks"), "gameweeks")
    return contract.accepted(checked, "gameweeks").select(*weeks.columns, "highest_score", "data_checked")


def _people(spark: SparkSession, sf: str) -> DataFrame:
    """Players with all that the contract requires."""
    return data.raw_players(spark, sf).selectExpr("*", "id * 2 as code", "'a' as status")


def ingest_players(spark: SparkSession, sf: str) -> DataFrame:
    """Players through the contract; by rule of the id some lack their status, their form,
    or have a text for a price."""
    people = _people(spark, sf)
    faulty = people.selectExpr(
        "* except (now_cost, status, form)",
        "case when id % 20 = 1 then null else status end as status",
        "case when id % 20 = 2 then 'dear' else cast(now_cost as string) end as now_cost",
        "case when id % 20 <> 3 then form end as form",
    )
    docs = _chunked_documents(faulty, F.floor(F.col("id") / F.lit(64)), "elements")
    checked = contract.validate(landing.bootstrap_records(docs, "players"), "players")
    return checked.select(*people.columns, "errors")


def match_records(spark: SparkSession, sf: str, sql_rows: bool = False) -> DataFrame:
    """Match rows as JSON records, some of them faulty by rule of the fixture id."""
    rows = data.raw_player_gameweek_stats(spark, sf, sql_rows=sql_rows)
    variant = F.col("fixture") % 50
    edited = ["was_home", "minutes", "total_points", "expected_goals"]
    base = F.to_json(F.struct(*[name for name in rows.columns if name not in edited]))
    text = lambda name: F.col(name).cast("string")

    def entry(name: str, value: Column) -> Column:
        return F.concat(F.lit(f'"{name}":'), value)

    quoted = lambda value: F.concat(F.lit('"'), value, F.lit('"'))
    entries = [
        F.when(variant != 1, entry("was_home", text("was_home"))),
        entry(
            "minutes",
            F.when(variant == 2, F.lit('"n/a"'))
            .when(variant == 4, quoted(text("minutes")))
            .otherwise(text("minutes")),
        ),
        entry(
            "total_points", F.when(variant == 3, F.lit("null")).otherwise(text("total_points"))
        ),
        entry(
            "expected_goals",
            F.when(variant == 5, F.lit("true")).otherwise(
                F.coalesce(quoted(F.col("expected_goals")), F.lit("null"))
            ),
        ),
        F.when(variant == 6, entry("expected_cards", (F.col("fixture") * 10).cast("string"))),
        F.when(variant == 7, entry("expected_cards", F.lit("null"))),
        F.when(variant == 8, entry("referee", F.lit("null"))),
    ]
    body = F.concat_ws(",", *entries)
    # cut as bytes: a cut by characters counts them twice
    opened = F.expr("cast(substring(cast(_base as binary), 1, octet_length(_base) - 1) as string)")
    return rows.withColumn("_base", base).select(
        F.lpad(F.col("element").cast("string"), 12, "0").alias("doc"),
        F.col("fixture").alias("pos"),
        F.concat(opened, F.lit(","), body, F.lit("}")).alias(
            "record"
        ),
    )


def _landed(records: DataFrame) -> DataFrame:
    """Landed records come out of a generator; it keeps a filter on the text from
    building the text again."""
    return records.selectExpr("inline(array(struct(doc, pos, record)))")


def validate_rejects(spark: SparkSession, sf: str, sql_rows: bool = True) -> DataFrame:
    checked = contract.validate(match_records(spark, sf, sql_rows=sql_rows), "player_gameweek_stats")
    return contract.rejects(checked, "player_gameweek_stats")


def validated_rows(spark: SparkSession, sf: str, sql_rows: bool = True) -> DataFrame:
    checked = contract.validate(match_records(spark, sf, sql_rows=sql_rows), "player_gameweek_stats")
    rows = contract.accepted(checked, "player_gameweek_stats")
    return rows.select(*MATCH_FIELDS, "opponent_team", "value", "modified", "transfers_in")


def open_records(spark: SparkSession, sf: str, sql_rows: bool = True) -> DataFrame:
    """Unknown keys stay with the record."""
    checked = contract.validate(match_records(spark, sf, sql_rows=sql_rows), "player_gameweek_stats")
    extra = F.get_json_object("_record", "$.expected_cards").cast("bigint")
    return checked.select("element", "fixture", extra.alias("expected_cards")).filter(
        F.col("expected_cards").isNotNull()
    )


def field_drift(spark: SparkSession, sf: str) -> DataFrame:
    known = drift.default_snapshot(spark, "player_gameweek_stats")
    return drift.new_fields(_landed(match_records(spark, sf)), known)


def field_drift_report(spark: SparkSession, sf: str, sql_rows: bool = True) -> DataFrame:
    known = drift.default_snapshot(spark, "player_gameweek_stats")
    return drift.drift_report(_landed(match_records(spark, sf, sql_rows=sql_rows)), known)


def snapshot_keys(spark: SparkSession, sf: str) -> DataFrame:
    return drift.field_names(data.read(spark, sf, "events").select(F.col("props").alias("record")))


# --- merge and audits -----------------------------------------------------------

MERGE_FIELDS = ["element", "fixture", "round", "minutes", "total_points"]


def upsert_stats(spark: SparkSession, sf: str, sql_rows: bool = True) -> DataFrame:
    """Corrections for some matches and new rows for others."""
    target = data.match_measures(spark, sf, sql_rows=sql_rows).select(*MERGE_FIELDS)
    corrected = target.filter(F.col("fixture") % 7 == 0).withColumn(
        "total_points", F.col("total_points") + 1
    )
    added = target.filter(F.col("fixture") % 13 == 0).withColumn("fixture", -F.col("fixture"))
    return merge.merge(target, corrected.unionByName(added), ["element", "fixture"])


def upsert_reschedule(spark: SparkSession, sf: str, sql_rows: bool = True) -> DataFrame:
    """Some fixtures move to the following gameweek."""
    target = data.match_measures(spark, sf, sql_rows=sql_rows).select(*MERGE_FIELDS)
    moved = target.filter(F.col("fixture") % 11 == 0).withColumn(
        "round", F.col("round") % data.GAMEWEEKS + 1
    )
    return merge.merge(target, moved, ["element", "fixture"])


def upsert_latest(spark: SparkSession, sf: str) -> DataFrame:
    """Of several rows with one key the latest wins."""
    events = data.read(spark, sf, "events").select("user_id", "event_id", "ts", "event_type", "value")
    return merge.latest_per_key(events, ["user_id"], F.struct("ts", "event_id"))


def _new_store(spark: SparkSession, name: str, **options: int) -> TableStore:
    return TableStore(spark, shared_dir(spark, f"{name}-{os.urandom(6).hex()}"), **options)


def store_upsert(spark: SparkSession, sf: str) -> DataFrame:
    """The whole fact loaded into a store, then all of it again with corrections, moved
    fixtures and added rows among unchanged ones."""
    store, name = _new_store(spark, "store-upsert", rows_per_bucket=20_000), "player_gameweek_stats"
    rows = conform(data.match_measures(spark, sf), name)
    store.upsert(name, rows)
    again = rows.withColumns(
        {
            "total_points": F.col("total_points") + F.when(F.col("fixture") % 7 == 0, 1).otherwise(0),
            "round": F.when(F.col("fixture") % 11 == 0, F.col("round") % data.GAMEWEEKS + 1).otherwise(F.col("round")),
        }
    )
    added = rows.filter(F.col("fixture") % 13 == 0).withColumn("fixture", -F.col("fixture"))
    store.upsert(name, again.unionByName(added))
    return store.read(name).select(*MERGE_FIELDS)


def load_orphans(spark: SparkSession, sf: str) -> DataFrame:
    """References that a load would refuse: by rule of the ids some rows refer to nothing."""
    tables = data.tables(spark, sf, "opponents").named()
    players, fixtures, facts = (tables[name] for name in ("players", "fixtures", "player_gameweek_stats"))
    tables["players"] = players.withColumn("team", F.expr("case when id % 41 = 0 then -id else team end"))
    tables["fixtures"] = fixtures.withColumn("event", F.expr("case when id % 43 = 0 then 90 else event end")).withColumn(
        "team_h", F.expr("case when id % 47 = 0 then 0 else team_h end")
    )
    tables["player_gameweek_stats"] = facts.withColumn("element", F.expr("case when fixture % 53 = 0 then -1 else element end")).withColumn(
        "opponent_team", F.expr("case when fixture % 59 = 0 then null when fixture % 61 = 0 then -2 else opponent_team end")
    )
    return integrity.foreign_key_orphans(tables)


def pk_audit_seeded(spark: SparkSession, sf: str) -> DataFrame:
    """Key audit over tables in which some rows come twice."""
    tables = data.tables(spark, sf, "measures").named()
    twice = {"teams": "id % 10 = 0", "fixtures": "id % 17 = 0", "player_gameweek_stats": "fixture % 19 = 0"}
    for name, rule in twice.items():
        tables[name] = tables[name].selectExpr("*", f"explode(sequence(1, if({rule}, 2, 1))) as _copy").drop("_copy")
    return integrity.primary_key_audit(tables)


def column_audit(spark: SparkSession, sf: str) -> DataFrame:
    """Column audit over the six tables, with faults by rule of the ids."""
    tables = {name: conform(df, name) for name, df in data.tables(spark, sf, "opponents").named().items()}
    tables["teams"] = tables["teams"].drop("draw")
    tables["players"] = tables["players"].withColumn("now_cost", F.col("now_cost").cast("string"))
    nulls = {
        "teams": ("win", "id % 3 = 0"), "gameweeks": ("finished", "id % 5 = 0"), "fixtures": ("team_a", "id % 40 = 1"),
        "player_gameweek_stats": ("bps", "fixture % 29 = 0"), "etl_runs": ("started_at", "id % 10 = 3"),
    }
    for name, (column, rule) in nulls.items():
        tables[name] = tables[name].withColumn(column, F.expr(f"case when not ({rule}) then {column} end"))
    return integrity.column_audit(tables)


def run_log(spark: SparkSession, sf: str) -> DataFrame:
    """Events as the opening and, but for errors, the closing of a run per user."""
    opened = data.read(spark, sf, "events").selectExpr("user_id as id", "ts as started_at", "cast(null as timestamp) as finished_at")
    closed = data.read(spark, sf, "events").filter("event_type <> 'error'")
    return runs.latest_state(opened.unionByName(closed.selectExpr("user_id as id", "ts as started_at", "cast(ts as timestamp) as finished_at")))


def _land(docs: DataFrame, path: str) -> None:
    with released_shuffles(docs.sparkSession):
        docs.select("value").write.mode("append").option("compression", "gzip").text(path)


def load_job(spark: SparkSession, sf: str) -> DataFrame:
    """Documents of all tables landed, one load, and the season aggregate over the store."""
    store = _new_store(spark, "load-job")
    paths = LandingPaths.under(f"{store.root}/landing", lines=True)
    arrays = {"teams": data.raw_teams(spark, sf), "events": data.raw_gameweeks(spark, sf), "elements": _people(spark, sf)}
    for name, rows in arrays.items():
        body = F.struct(*[(F.collect_list(F.struct(*rows.columns)) if a == name else F.array()).alias(a) for a in arrays])
        _land(rows.groupBy(F.floor(F.col("id") / F.lit(64))).agg(F.to_json(body).alias("value")), paths.bootstrap)
    _land(_chunked_documents(data.raw_fixtures(spark, sf), F.floor(F.col("id") / F.lit(64)), None), paths.fixtures)
    _land(_history_documents(data.raw_player_gameweek_stats(spark, sf)), paths.histories)
    run_load(store, paths)
    return portable(stats.player_stats(store.tables()))


def stream_two_batches(spark: SparkSession, sf: str) -> DataFrame:
    """Match documents streamed into a store that has the rows they refer to; a second run
    takes documents with corrections that landed later."""
    store, name = _new_store(spark, "stream-batches"), f"two-batches-{os.urandom(6).hex()}"
    tables = data.tables(spark, sf)
    for entity in ("teams", "gameweeks", "players", "fixtures"):
        store.upsert(entity, conform(tables.named()[entity], entity))
    rows, path = tables.player_gameweek_stats, f"{store.root}/landing"
    _land(_history_documents(rows), path)
    load_histories(store, path, name, lines=True).awaitTermination()
    corrected = rows.filter(F.col("fixture") % 7 == 0).withColumn("total_points", F.col("total_points") + 1)
    _land(_history_documents(corrected), path)
    load_histories(store, path, name, lines=True).awaitTermination()
    return store.read("player_gameweek_stats").select(*MERGE_FIELDS)


def pk_audit(spark: SparkSession, sf: str) -> DataFrame:
    return integrity.primary_key_audit(data.tables(spark, sf, "measures").named())


def pk_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    lines = data.read(spark, sf, "lineitem")
    return integrity.duplicate_keys(lines, ["l_orderkey", "l_partkey"])


def fk_audit(spark: SparkSession, sf: str) -> DataFrame:
    return integrity.foreign_key_audit(data.tables(spark, sf, "opponents").named())


def fk_orphans(spark: SparkSession, sf: str) -> DataFrame:
    documents, labels = data.read(spark, sf, "documents"), data.read(spark, sf, "labels")
    return integrity.orphans(documents, "doc_id", labels, "doc_id")


def null_audit(spark: SparkSession, sf: str) -> DataFrame:
    tables = data.tables(spark, sf).named()
    parts = [integrity.null_audit(tables[name], name) for name in ("fixtures", "player_gameweek_stats")]
    return parts[0].unionByName(parts[1])


def run_age_label(spark: SparkSession, sf: str) -> DataFrame:
    runs = data.raw_runs(spark, sf)
    now = runs.agg(F.max("started_at")).scalar()
    seconds = "(unix_micros(cast(now as timestamp)) - unix_micros(cast(finished_at as timestamp))) div 1000000"
    aged = runs.withColumn("now", now).selectExpr("*", f"{seconds} as age_seconds")
    return aged.selectExpr("id", f"{age_label('finished_at', 'age_seconds')} as age")


def stream_fixtures(spark: SparkSession, sf: str) -> DataFrame:
    """Fixtures merged from a stream of order files into a stored table, read back."""
    root = shared_dir(spark, f"stream-fixtures-{os.urandom(6).hex()}")
    store = TableStore(spark, root)
    orders = data.read(spark, sf, "orders")
    stream = spark.readStream.schema(orders.schema).parquet(os.path.join(sf, "orders*.parquet"))

    def to_rows(batch: DataFrame) -> DataFrame:
        return conform(data.raw_fixtures(batch.sparkSession, sf, batch), "fixtures")

    load_rows(stream, store, "fixtures", os.path.basename(root), to_rows).awaitTermination()
    return store.read("fixtures").select(*data.raw_fixtures(spark, sf).columns)


# --- fixtures -------------------------------------------------------------------


def _cells(t) -> DataFrame:
    return grid.matrix_cells(t)


def _matrix(build: Callable[..., DataFrame]) -> Query:
    return _over("measures", lambda t: build(_cells(t), grid.default_range(t.gameweeks)))


# --- registry -------------------------------------------------------------------


def entry(spark: SparkSession) -> DataFrame:
    """Season aggregate of every player."""
    return _player_stats()(spark, FLAGSHIP_DIR)


def queries() -> dict[str, Query]:
    history = lambda t, **k: hist.player_history(t, **k)
    whole = lambda query: lambda spark, sf: query(spark, sf, sql_rows=False)
    early = lambda t: replace(t, gameweeks=t.gameweeks.withColumn("is_next", F.col("id") == EARLY_NEXT))
    own = {
        "raw_teams": data.raw_teams,
        "raw_gameweeks": data.raw_gameweeks,
        "raw_fixtures": data.raw_fixtures,
        "raw_players": data.raw_players,
        "raw_player_gameweek_stats": lambda spark, sf: data.raw_player_gameweek_stats(spark, sf, sql_rows=True),
        "teams_view": _over("measures", lambda t: views.teams(t.teams)),
        "gameweeks_view": _over("measures", lambda t: views.gameweeks(t.gameweeks)),
        "fixtures_view": _over("measures", lambda t: views.fixtures(t.fixtures)),
        "players_view": _over("measures", lambda t: views.players(t.players)),
        "player_gameweek_view": _over(
            "full",
            lambda t: views.player_gameweek_stats(t.player_gameweek_stats, t.fixtures, t.players),
            sql_rows=True,
        ),
        "player_stats_season": _player_stats(),
        "player_stats_range": _player_stats(gw_from=RANGE[0], gw_to=RANGE[1]),
        "player_stats_range_finished_only": _player_stats(gw_from=RANGE[1], include_current=False),
        "player_stats_last_n": _player_stats(last_n=LAST_N),
        "player_stats_last_n_finished_only": _player_stats(last_n=LAST_N, include_current=False),
        "stats_table_per90": _stats_table("Per 90"),
        "stats_table_per_game": _stats_table("Per Game"),
        "stats_table_total": _stats_table("Total"),
        "stats_filtered": _over(
            "measures", lambda t: stats.filter_players(stats.player_stats(t, last_n=LAST_N), **FILTERS)
        ),
        "stats_derived": _over("measures", lambda t: stats.with_derived_metrics(stats.player_stats(t))),
        "price_bounds": _over("measures", lambda t: stats.price_bounds(stats.player_stats(t))),
        "gameweek_info": _over("measures", lambda t: selection.gameweek_info(t.gameweeks)),
        "team_list": _over("measures", lambda t: views.team_list(t.teams)),
        "player_history": _over("opponents", history),
        "history_last_n": _over("opponents", lambda t: history(t, last_n=3)),
        "history_last_n_finished_only": _over(
            "opponents", lambda t: history(t, last_n=3, include_current=False)
        ),
        "history_table": _over("opponents", lambda t: hist.history_table(history(t))),
        "history_outcomes": _over("opponents", lambda t: hist.history_outcomes(history(t))),
        "points_breakdown_total": _over("measures", lambda t: hist.points_breakdown(t, "Total")),
        "points_breakdown_per_game": _over(
            "measures", lambda t: hist.points_breakdown(t, "Per Game", last_n=LAST_N)
        ),
        "points_breakdown_per90": _over("measures", lambda t: hist.points_breakdown(t, "Per 90")),
        "gi_delta": _over("measures", hist.involvement_deltas),
        "gi_delta_bounds": _over("measures", lambda t: hist.delta_bounds(hist.involvement_deltas(t))),
        "cumulative_gi": _over("measures", hist.involvement),
        "cumulative_gi_long": _over("measures", lambda t: hist.cumulative_long(hist.involvement(t))),
        "team_fixtures_long": _over(
            "measures", lambda t: grid.team_fixtures(t.fixtures, t.teams)
        ),
        "fixture_cells": _over("measures", _cells),
        "fixture_average_difficulty": _over("measures", lambda t: grid.average_difficulty(_cells(t))),
        "fdr_matrix_text": _matrix(grid.fdr_matrix_text),
        "fdr_matrix_value": _matrix(grid.fdr_matrix_value),
        "fixture_strip": _over("measures", grid.fixture_strip),
        "ingest_teams": ingest_teams,
        "ingest_fixtures": ingest_fixtures,
        "ingest_worklist": ingest_worklist,
        "ingest_flatten_history": ingest_flatten_history,
        "sample_players": sample_players,
        "validate_rejects": validate_rejects,
        "validated_rows": validated_rows,
        "open_records": open_records,
        "field_drift": field_drift,
        "field_drift_report": field_drift_report,
        "snapshot_keys": snapshot_keys,
        "upsert_stats": upsert_stats,
        "upsert_reschedule": upsert_reschedule,
        "upsert_latest": upsert_latest,
        "pk_audit": pk_audit,
        "pk_duplicates": pk_duplicates,
        "fk_audit": fk_audit,
        "fk_orphans": fk_orphans,
        "null_audit": null_audit,
        "etl_last_updated": lambda spark, sf: views.etl_last_updated(data.raw_runs(spark, sf)),
        "run_age_label": run_age_label,
        "stream_fixtures": stream_fixtures,
        "matches_view": _over(
            "full", lambda t: views.player_gameweek_stats(t.player_gameweek_stats, t.fixtures, t.players)
        ),
        "teams_full": _over("measures", lambda t: views.teams(data.full_width(t.teams, "teams"))),
        "gameweeks_full": _over("measures", lambda t: views.gameweeks(data.full_width(t.gameweeks, "gameweeks"))),
        "fixtures_full": _over("measures", lambda t: views.fixtures(data.full_width(t.fixtures, "fixtures"))),
        "players_full": _over("measures", lambda t: views.players(data.full_width(t.players, "players"))),
        "matches_full": _over(
            "full",
            lambda t: views.player_gameweek_stats(
                data.full_width(t.player_gameweek_stats, "player_gameweek_stats", "(element * 31 + fixture)"), t.fixtures, t.players
            ),
        ),
        "ingest_bad_documents": ingest_bad_documents,
        "contract_findings": contract_report,
        "flatten_history_all": whole(ingest_flatten_history),
        "validate_all_rejects": whole(validate_rejects),
        "validate_all_rows": whole(validated_rows),
        "open_records_all": whole(open_records),
        "drift_report_all": whole(field_drift_report),
        "upsert_stats_all": whole(upsert_stats),
        "upsert_reschedule_all": whole(upsert_reschedule),
        "store_upsert": store_upsert,
        "load_orphans": load_orphans,
        "pk_audit_seeded": pk_audit_seeded,
        "column_audit": column_audit,
        "run_log": run_log,
        "load_job": load_job,
        "stream_two_batches": stream_two_batches,
        "ingest_gameweeks": ingest_gameweeks,
        "ingest_players": ingest_players,
        "history_before_next": _over("opponents", lambda t: history(early(t), last_n=3, include_current=False)),
        "player_stats_placed": _over("measures", lambda t: stats.points_order(stats.player_stats(t)).select("player_id", "pts", "place")),
        "stats_table_placed": _over(
            "measures", lambda t: stats.points_order(stats.player_stats(t, last_n=LAST_N), "Per 90").select("player_id", "p90", "place")
        ),
        "history_placed": _over(
            "opponents", lambda t: hist.display_order(history(t)).select("player_id", "fixture_id", "gameweek_id", "place")
        ),
        "chart_placed": _over(
            "measures", lambda t: hist.chart_order(hist.involvement(t)).select("player_id", "fixture_id", "cum_gi", "place")
        ),
        "teams_placed": _over("measures", lambda t: grid.team_order(grid.matrix_cells(t, texts=False))),
        "one_player_history": _over("opponents", lambda t: history(t, player_id=ONE_PLAYER)),
        "one_team_stats": _over("measures", lambda t: stats.filter_players(stats.player_stats(t), team=ONE_TEAM)),
        "one_team_strip": _over("measures", lambda t: grid.fixture_strip(t, ONE_TEAM)),
        "own_range_cells": _over("measures", lambda t: grid.matrix_cells(t, grid.MatrixRange(*OWN_RANGE))),
    }
    if WITH_LLM:
        own |= llm_queries.QUERIES | {"pipeline": corpus_pipeline.run}
    return own


def oracle_sql() -> dict[str, str]:
    own = oracle.statements()
    if WITH_LLM:
        own |= llm_queries.ORACLE_SQL
        if corpus_pipeline.ORACLE_SQL:
            own["pipeline"] = corpus_pipeline.ORACLE_SQL
    return own
