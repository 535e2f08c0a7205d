"""Chat formatting by schema fingerprints.

A record's nested field paths are hashed; the hash selects a declarative mapping that
turns the record into canonical turns (role, text). The turns are written in one
template, with a loss mask over the assistant's texts. All of it is SQL expressions.
"""

from __future__ import annotations

import itertools
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURNS = "array<struct<role:string,text:string>>"
#: Bytes from which the field paths are taken from a record's skeleton. Below, neither
#: the 20,000,000 characters of a string nor the 128 MB of a variant can be reached.
LONG_BYTES = 15_000_000
#: ``from_json`` without its own limit for one string.
READ = "map('maxStringLen', '2147483647')"
#: Each time, equal neighbours in an array are halved in number.
HALVINGS = 12


@dataclass(frozen=True)
class Mapping:
    """How records with ``paths``, and any of the ``optional`` ones, become turns.
    ``shape`` is the schema they are read with as ``r``; ``turns`` builds the turns."""

    name: str
    paths: tuple[str, ...]
    shape: str
    turns: str
    optional: tuple[str, ...] = ()

    def path_sets(self) -> list[list[str]]:
        some = [c for n in range(len(self.optional) + 1) for c in itertools.combinations(self.optional, n)]
        return [sorted({*self.paths, *extra}) for extra in some]


def _turn(role: str, text: str) -> str:
    return f"struct('{role}' as role, {text} as text)"


_SYSTEM = f"if(r.system is null, array(), array({_turn('system', 'r.system')}))"
MAPPINGS = [
    Mapping(
        "messages",
        ("messages[]", "messages[].content", "messages[].role"),
        "messages array<struct<role:string,content:string>>",
        "transform(r.messages, m -> struct(m.role as role, m.content as text))",
        ("id",),
    ),
    Mapping("messages_empty", ("messages[]",), "messages array<string>", f"cast(array() as {TURNS})", ("id",)),
    Mapping(
        "conversations",
        ("conversations[]", "conversations[].from", "conversations[].value"),
        "conversations array<struct<`from`:string,value:string>>",
        "transform(r.conversations, m -> struct(case m.`from` when 'human' then 'user' "
        "when 'gpt' then 'assistant' else m.`from` end as role, m.value as text))",
        ("id",),
    ),
    Mapping(
        "prompt_response",
        ("prompt", "response"),
        "system string, prompt string, response string",
        f"concat({_SYSTEM}, array({_turn('user', 'r.prompt')}, {_turn('assistant', 'r.response')}))",
        ("id", "system"),
    ),
    Mapping(
        "prompt_completion",
        ("completion", "prompt"),
        "system string, prompt string, completion string",
        f"concat({_SYSTEM}, array({_turn('user', 'r.prompt')}, {_turn('assistant', 'r.completion')}))",
        ("id", "system"),
    ),
    Mapping(
        "instruction",
        ("instruction", "output"),
        "system string, instruction string, input string, output string",
        f"concat({_SYSTEM}, array({_turn('user', 'concat_ws(chr(10), r.instruction, nullif(r.input, ``))')}, "
        f"{_turn('assistant', 'r.output')}))".replace("``", "''"),
        ("id", "input", "system"),
    ),
]


def skeleton(record: str) -> str:
    """SQL text for a JSON text with all string values emptied, so of the same field
    paths. Neighbours in an array that are alike then are merged, since only what
    differs adds paths."""
    # With backslashes and quotes in texts written as numbers, a quote is always an end.
    plain = rf"""replace(replace({record}, r'\\', r'\u005c'), r'\"', r'\u0022')"""
    text = rf"""regexp_replace({plain}, r'("[^"]*+"\s*+:)|(")[^"]*+(")', '$1$2$3')"""
    for _ in range(HALVINGS):
        text = rf"""regexp_replace({text}, r'(\{{"[^{{}}]*+\}})\s*+,\s*+\1', '$1')"""
    return text


def field_paths(record: str) -> str:
    """SQL text for the sorted field paths of a JSON object: names, ``name.inner`` for
    objects, ``name[]`` and ``name[].inner`` for arrays. Null if it isn't an object."""
    keys = lambda v: f"coalesce(map_keys(try_variant_get({v}, '$', 'map<string,variant>')), array())"
    inner = (
        f"concat(array(concat(e.key, '[]')), flatten(transform(try_variant_get(e.value, '$', 'array<variant>'), "
        f"x -> transform({keys('x')}, k -> concat(e.key, '[].', k)))))"
    )
    kind = "schema_of_variant(e.value)"
    each = (
        f"case when startswith({kind}, 'ARRAY<') then {inner} "
        f"when startswith({kind}, 'OBJECT<') then transform({keys('e.value')}, k -> concat(e.key, '.', k)) "
        "else array(e.key) end"
    )
    top = f"map_entries(try_variant_get(try_parse_json({record}), '$', 'map<string,variant>'))"
    return f"array_sort(array_distinct(flatten(transform({top}, e -> {each}))))"


def fingerprint(paths: Column) -> Column:
    return F.sha2(F.to_json(paths), 256)


def canonical_turns(records: DataFrame, record_col: str = "record", mappings: list[Mapping] = MAPPINGS) -> DataFrame:
    """The rows with ``fingerprint``, ``layout`` (the mapping's name) and ``turns``.

    Records that are null, no JSON object, or of field paths that no mapping declares
    have a null layout and null turns. A null role or text becomes an empty one; fields
    that a mapping doesn't declare make another fingerprint, so nothing is lost unseen.
    The length of a text or record decides nothing. A record whose skeleton still is
    of ``LONG_BYTES`` and cannot be read raises an error.
    Columns of the input named like the new ones are replaced.
    """
    columns = [F.col(f"`{c}`") for c in records.columns if c not in ("fingerprint", "layout", "turns")]
    known = [(m, F.array(*[F.lit(p) for p in paths])) for m in mappings for paths in m.path_sets()]
    lookup = F.create_map(*[x for m, paths in known for x in (fingerprint(paths), F.lit(m.name))])
    # The skeleton lacks the texts, so that these are well-formed is seen by reading the whole.
    broken = "from_json(_tl_record, '_tl_none string, _tl_broken string', map('maxStringLen', '2147483647', 'columnNameOfCorruptRecord', '_tl_broken'))._tl_broken"
    long = f"octet_length(_tl_record) >= {LONG_BYTES}"
    unread = F.raise_error(F.lit("a record's field paths cannot be read: it is too large or no JSON"))
    rows = (
        records.select(*columns, F.col(record_col).alias("_tl_record"))
        .withColumn("_tl_json", F.expr(f"case when not {long} then _tl_record when {broken} is null then {skeleton('_tl_record')} end"))
        .withColumn("fingerprint", fingerprint(F.expr(field_paths("_tl_json"))))
        .withColumn(
            "fingerprint",
            F.when(F.col("fingerprint").isNull() & F.expr(f"octet_length(_tl_json) >= {LONG_BYTES}"), unread).otherwise(F.col("fingerprint")),
        )
        .withColumn("layout", lookup[F.col("fingerprint")])
    )
    turns = F.lit(None).cast(TURNS)
    for m in mappings:
        read = F.expr(re.sub(r"\br\.", f"from_json(_tl_record, '{m.shape}', {READ}).", m.turns))
        turns = F.when(F.col("layout") == m.name, read.cast(TURNS)).otherwise(turns)
    plain = F.transform(
        turns,
        lambda t: F.struct(F.coalesce(t["role"], F.lit("")).alias("role"), F.coalesce(t["text"], F.lit("")).alias("text")),
    )
    return rows.select(*columns, "fingerprint", "layout", plain.alias("turns"))


# Template: <turn ROLE>TEXT</turn> and a line end. In roles and texts the backslash, < and >
# are written as \b, \l and \g, so a < or > in the output is always a marker.
OPEN, CLOSE = "<turn ", "</turn>\n"


def escaped(text: Column) -> Column:
    for char, code in (("\\", "\\b"), ("<", "\\l"), (">", "\\g")):
        text = F.replace(text, F.lit(char), F.lit(code))
    return text


def unescaped(text: Column) -> Column:
    for char, code in ((">", "\\g"), ("<", "\\l"), ("\\", "\\b")):
        text = F.replace(text, F.lit(code), F.lit(char))
    return text


def formatted(rows: DataFrame, learned: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """The rows with ``formatted`` (all turns in the template) and ``loss_spans``, the
    code point ranges (start, end) of the escaped texts whose role is in ``learned``.
    Null turns give nulls, no turns an empty text. Columns of those names are replaced."""
    rows = rows.drop("formatted", "loss_spans")
    parts = F.transform(
        "turns",
        lambda t: F.struct(
            F.concat(F.lit(OPEN), escaped(t["role"]), F.lit(">")).alias("head"),
            escaped(t["text"]).alias("body"),
            t["role"].isin(*learned).alias("learned"),
        ),
    )
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))

    def add(acc: Column, part: Column) -> Column:
        first = acc["at"] + F.length(part["head"])
        last = first + F.length(part["body"])
        span = F.array(F.struct(first.alias("start"), last.alias("end")))
        return F.struct(
            (last + len(CLOSE)).alias("at"),
            F.when(part["learned"], F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"),
        )

    return (
        rows.withColumn("_tl_parts", parts)
        .withColumns(
            {
                "formatted": F.array_join(
                    F.transform("_tl_parts", lambda p: F.concat(p["head"], p["body"], F.lit(CLOSE))), ""
                ),
                "loss_spans": F.aggregate("_tl_parts", start, add, lambda acc: acc["spans"]),
            }
        )
        .drop("_tl_parts")
    )


def parsed(text: str = "formatted") -> Column:
    """The turns of a formatted text, read back from it alone."""
    found = F.split(text, OPEN)
    pieces = F.slice(found, F.lit(2), F.greatest(F.size(found) - 1, F.lit(0)))

    def turn(piece: Column) -> Column:
        role = F.substring_index(piece, ">", 1)
        body = F.substring(piece, F.length(role) + 2, F.length(piece) - F.length(role) - 1 - len(CLOSE))
        return F.struct(unescaped(role).alias("role"), unescaped(body).alias("text"))

    return F.transform(pieces, turn)


def masked(text: str = "formatted", spans: str = "loss_spans") -> Column:
    """The unescaped texts under the loss mask."""
    return F.transform(
        spans, lambda s: unescaped(F.substring(F.col(text), s["start"] + 1, s["end"] - s["start"]))
    )


def records_from_turn_rows(rows: DataFrame, id_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """One JSON record per conversation from rows by turn, in the layout that its roles
    fit: prompt and response, instruction with a system text, from/value pairs for those
    that end with the user, messages for all others. Null roles and texts are empty;
    turns that tie follow role and text."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in (role_col, text_col))
    grouped = (
        rows.select(F.col(id_col).alias("id"), F.struct(F.col(turn_col).alias("turn"), role.alias("role"), text.alias("text")).alias("t"))
        .groupBy("id")
        .agg(F.array_sort(F.collect_list("t")).alias("ts"))
        .withColumn("roles", F.transform("ts", lambda t: t["role"]))
    )
    at = lambda i: F.col("ts")[i]["text"]
    roles = lambda *names: F.col("roles") == F.array(*[F.lit(n) for n in names])
    sender = lambda r: F.when(r == "user", "human").when(r == "assistant", "gpt").otherwise(r)
    known = F.forall("roles", lambda r: r.isin("system", "user", "assistant"))
    record = (
        F.when(roles("user", "assistant"), F.to_json(F.struct(at(0).alias("prompt"), at(1).alias("response"))))
        .when(
            roles("system", "user", "assistant"),
            F.to_json(F.struct(at(0).alias("system"), at(1).alias("instruction"), at(2).alias("output"))),
        )
        .when(
            known & (F.element_at("roles", -1) == "user"),
            F.to_json(
                F.struct(
                    F.transform(
                        "ts", lambda t: F.struct(sender(t["role"]).alias("from"), t["text"].alias("value"))
                    ).alias("conversations")
                )
            ),
        )
        .otherwise(
            F.to_json(
                F.struct(
                    F.transform("ts", lambda t: F.struct(t["role"], t["text"].alias("content"))).alias("messages")
                )
            )
        )
    )
    return grouped.select(F.col("id").alias(id_col), record.alias("record"))
