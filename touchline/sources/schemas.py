"""Record layouts: column types, table rules and the input contract.

Each line of a layout is ``column | type | table rule | contract``.

* table rule: ``null``, ``not null`` or ``default <value>`` (which implies not null)
* contract: ``open`` (not part of the contract, kept as it comes) or a kind
  (``int``, ``str``, ``bool``, ``any``) with ``required``, ``optional`` or
  ``default <value>``

Entity ids and references to them are 64-bit: the ids of players, fixtures and
teams must not run out on large data. Gameweek ids stay 32-bit.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Column names, types, defaults and contracts of the input records.
TEAMS = """
id | bigint | not null | int required
code | bigint | null | int required
draw | int | default 0 | int default 0
form | string | null | open
loss | int | default 0 | int default 0
name | string | not null | str required
played | int | default 0 | int default 0
points | int | default 0 | int default 0
position | int | null | int optional
short_name | string | not null | str required
strength | int | null | int optional
team_division | string | null | str optional
unavailable | boolean | default false | bool default false
win | int | default 0 | int default 0
strength_overall_home | int | null | int optional
strength_overall_away | int | null | int optional
strength_attack_home | int | null | int optional
strength_attack_away | int | null | int optional
strength_defence_home | int | null | int optional
strength_defence_away | int | null | int optional
pulse_id | int | null | int optional
"""

GAMEWEEKS = """
id | int | not null | int required
name | string | not null | str required
deadline_time | timestamp | not null | str optional
release_time | timestamp | null | open
average_entry_score | int | null | int optional
finished | boolean | default false | bool default false
data_checked | boolean | default false | bool default false
highest_scoring_entry | int | null | int optional
deadline_time_epoch | bigint | null | int optional
deadline_time_game_offset | int | default 0 | int default 0
highest_score | int | null | int optional
is_previous | boolean | default false | bool default false
is_current | boolean | default false | bool default false
is_next | boolean | default false | bool default false
cup_leagues_created | boolean | default false | bool default false
h2h_ko_matches_created | boolean | default false | bool default false
can_enter | boolean | default false | bool default false
can_manage | boolean | default false | bool default false
released | boolean | default false | bool default false
ranked_count | int | null | int optional
most_selected | int | null | int optional
most_transferred_in | int | null | int optional
top_element | int | null | int optional
transfers_made | int | default 0 | int default 0
most_captained | int | null | int optional
most_vice_captained | int | null | int optional
overrides | string | null | any optional
chip_plays | string | null | any optional
top_element_info | string | null | any optional
"""

PLAYERS = """
id | bigint | not null | int required
code | bigint | null | int required
can_transact | boolean | null | open
can_select | boolean | null | bool optional
chance_of_playing_next_round | int | null | open
chance_of_playing_this_round | int | null | open
cost_change_event | int | default 0 | open
cost_change_event_fall | int | default 0 | open
cost_change_start | int | default 0 | open
cost_change_start_fall | int | default 0 | open
price_change_percent | string | null | str optional
dreamteam_count | int | default 0 | open
element_type | int | not null | int required
ep_next | string | null | str optional
ep_this | string | null | str optional
event_points | int | default 0 | open
first_name | string | not null | str required
form | string | null | str optional
in_dreamteam | boolean | default false | open
news | string | null | open
news_added | timestamp | null | open
now_cost | int | not null | int required
photo | string | null | open
points_per_game | string | null | str optional
removed | boolean | default false | bool default false
second_name | string | not null | str required
selected_by_percent | string | null | str optional
special | boolean | default false | open
squad_number | int | null | open
status | string | not null | str required
team | bigint | not null | int required
team_code | int | null | open
total_points | int | default 0 | int default 0
transfers_in | int | default 0 | open
transfers_in_event | int | default 0 | open
transfers_out | int | default 0 | open
transfers_out_event | int | default 0 | open
value_form | string | null | str optional
value_season | string | null | str optional
web_name | string | not null | str required
known_name | string | null | open
region | int | null | open
team_join_date | date | null | open
birth_date | date | null | open
has_temporary_code | boolean | default false | open
opta_code | string | null | open
minutes | int | default 0 | int default 0
goals_scored | int | default 0 | int default 0
assists | int | default 0 | int default 0
clean_sheets | int | default 0 | int default 0
goals_conceded | int | default 0 | open
own_goals | int | default 0 | int default 0
penalties_saved | int | default 0 | int default 0
penalties_missed | int | default 0 | int default 0
yellow_cards | int | default 0 | int default 0
red_cards | int | default 0 | int default 0
saves | int | default 0 | int default 0
bonus | int | default 0 | int default 0
bps | int | default 0 | open
influence | string | null | str optional
creativity | string | null | str optional
threat | string | null | str optional
ict_index | string | null | str optional
clearances_blocks_interceptions | int | default 0 | open
recoveries | int | default 0 | open
tackles | int | default 0 | open
defensive_contribution | int | default 0 | open
starts | int | default 0 | open
expected_goals | string | null | str optional
expected_assists | string | null | str optional
expected_goal_involvements | string | null | str optional
expected_goals_conceded | string | null | str optional
corners_and_indirect_freekicks_order | int | null | open
corners_and_indirect_freekicks_text | string | null | open
direct_freekicks_order | int | null | open
direct_freekicks_text | string | null | open
penalties_order | int | null | open
penalties_text | string | null | open
influence_rank | int | null | open
influence_rank_type | int | null | open
creativity_rank | int | null | open
creativity_rank_type | int | null | open
threat_rank | int | null | open
threat_rank_type | int | null | open
ict_index_rank | int | null | open
ict_index_rank_type | int | null | open
expected_goals_per_90 | decimal(18,4) | null | open
saves_per_90 | decimal(18,4) | null | open
expected_assists_per_90 | decimal(18,4) | null | open
expected_goal_involvements_per_90 | decimal(18,4) | null | open
expected_goals_conceded_per_90 | decimal(18,4) | null | open
goals_conceded_per_90 | decimal(18,4) | null | open
now_cost_rank | int | null | open
now_cost_rank_type | int | null | open
form_rank | int | null | open
form_rank_type | int | null | open
points_per_game_rank | int | null | open
points_per_game_rank_type | int | null | open
selected_rank | int | null | open
selected_rank_type | int | null | open
starts_per_90 | decimal(18,4) | null | open
clean_sheets_per_90 | decimal(18,4) | null | open
defensive_contribution_per_90 | decimal(18,4) | null | open
scout_risks | string | null | open
scout_news_link | string | null | open
"""

FIXTURES = """
id | bigint | not null | int required
code | bigint | null | int required
event | int | null | int optional
finished | boolean | default false | bool default false
finished_provisional | boolean | default false | bool default false
kickoff_time | timestamp | null | str optional
minutes | int | default 0 | int default 0
provisional_start_time | boolean | default false | bool default false
started | boolean | null | bool optional
team_a | bigint | not null | int required
team_a_score | int | null | int optional
team_h | bigint | not null | int required
team_h_score | int | null | int optional
stats | string | null | open
team_h_difficulty | int | null | int required
team_a_difficulty | int | null | int required
pulse_id | int | null | open
"""

PLAYER_GAMEWEEK_STATS = """
element | bigint | not null | int required
fixture | bigint | not null | int required
opponent_team | bigint | not null | int required
total_points | int | default 0 | int default 0
was_home | boolean | not null | bool required
kickoff_time | timestamp | null | open
team_h_score | int | null | open
team_a_score | int | null | open
round | int | not null | int required
modified | boolean | default false | open
minutes | int | default 0 | int default 0
goals_scored | int | default 0 | int default 0
assists | int | default 0 | int default 0
clean_sheets | int | default 0 | int default 0
goals_conceded | int | default 0 | int default 0
own_goals | int | default 0 | int default 0
penalties_saved | int | default 0 | int default 0
penalties_missed | int | default 0 | int default 0
yellow_cards | int | default 0 | int default 0
red_cards | int | default 0 | int default 0
saves | int | default 0 | int default 0
bonus | int | default 0 | int default 0
bps | int | default 0 | int default 0
influence | string | null | str optional
creativity | string | null | str optional
threat | string | null | str optional
ict_index | string | null | str optional
clearances_blocks_interceptions | int | default 0 | open
recoveries | int | default 0 | open
tackles | int | default 0 | open
defensive_contribution | int | default 0 | open
starts | int | default 0 | int default 0
expected_goals | string | null | str optional
expected_assists | string | null | str optional
expected_goal_involvements | string | null | str optional
expected_goals_conceded | string | null | str optional
value | int | null | int optional
transfers_balance | int | default 0 | open
selected | int | null | int optional
transfers_in | int | default 0 | open
transfers_out | int | default 0 | open
"""

ETL_RUNS = """
id | bigint | not null | open
started_at | timestamp | default now | open
finished_at | timestamp | null | open
"""

# Keys and references of the tables.
KEYS = {
    "etl_runs": ["id"],
    "teams": ["id"],
    "gameweeks": ["id"],
    "players": ["id"],
    "fixtures": ["id"],
    "player_gameweek_stats": ["element", "fixture"],
}

# (child table, child column, parent table); parents are referenced by id.
REFERENCES = [
    ("players", "team", "teams"),
    ("fixtures", "event", "gameweeks"),
    ("fixtures", "team_a", "teams"),
    ("fixtures", "team_h", "teams"),
    ("player_gameweek_stats", "element", "players"),
    ("player_gameweek_stats", "fixture", "fixtures"),
    ("player_gameweek_stats", "opponent_team", "teams"),
    ("player_gameweek_stats", "round", "gameweeks"),
]

# Parents are written before their children.
LOAD_ORDER = ["teams", "gameweeks", "players", "fixtures", "player_gameweek_stats"]

_LAYOUTS = {
    "teams": TEAMS,
    "gameweeks": GAMEWEEKS,
    "players": PLAYERS,
    "fixtures": FIXTURES,
    "player_gameweek_stats": PLAYER_GAMEWEEK_STATS,
    "etl_runs": ETL_RUNS,
}


_TYPES = {
    "int": T.IntegerType(),
    "bigint": T.LongType(),
    "boolean": T.BooleanType(),
    "string": T.StringType(),
    "decimal(18,4)": T.DecimalType(18, 4),
    "timestamp": T.TimestampType(),
    "date": T.DateType(),
}


@dataclass(frozen=True)
class Field:
    name: str
    type: T.DataType
    not_null: bool
    default: str | None
    kind: str | None
    required: bool
    optional: bool
    contract_default: str | None

    def default_value(self) -> Column:
        if self.default == "now":
            return F.current_timestamp()
        return F.lit(self.default).cast(self.type)


@lru_cache(maxsize=None)
def fields(entity: str) -> tuple[Field, ...]:
    out = []
    for line in _LAYOUTS[entity].strip().splitlines():
        name, ddl, rule, contract = (part.strip() for part in line.split("|"))
        kind, _, need = contract.partition(" ")
        out.append(
            Field(
                name=name,
                type=_TYPES[ddl],
                not_null=rule != "null",
                default=rule.removeprefix("default ") if rule.startswith("default ") else None,
                kind=None if kind == "open" else kind,
                required=need == "required",
                optional=need == "optional",
                contract_default=need.removeprefix("default ") if need.startswith("default ") else None,
            )
        )
    return tuple(out)


def schema(entity: str) -> T.StructType:
    """Declared type of the raw table. Columns are nullable as read; the audits
    in ``operators.integrity`` report missing values."""
    return T.StructType([T.StructField(f.name, f.type, True) for f in fields(entity)])


def column_names(entity: str) -> list[str]:
    return [f.name for f in fields(entity)]


def conform(df: DataFrame, entity: str) -> DataFrame:
    """Shape ``df`` as the raw table: columns it lacks get the table default or null."""
    have = set(df.columns)
    columns = []
    for f in fields(entity):
        if f.name in have:
            value = F.col(f.name).cast(f.type)
        elif f.default is not None:
            value = f.default_value()
        else:
            value = F.lit(None).cast(f.type)
        columns.append(value.alias(f.name))
    return df.select(*columns)
