"""Input contract: typed records, defaults, and every failure of every record.

Kinds are checked leniently, as the contract does: whole numbers may come as text
or as ``7.0``, flags as 0/1 or ``"true"``, but text must be text. A default fills a
missing key only; an explicit null passes only where the field is optional.

Two texts are kept apart: ``errors`` (the contract) and ``table_errors`` (what the
table would refuse: null in a not-null column, a value of the wrong type). Both are
empty for a good record.

One typed parse with a corrupt-record marker settles the good records: every value has
the JSON kind of its column, nothing required is absent, and no null stands where a
default would. Only the other records are looked at key by key, for the reasons or for
what the contract lets through (text for a number, ``7.0``). Of a repeated key the last
value counts; text after the record makes it unreadable. A value the contract already
refused is not reported again for the table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from touchline.session import compile_wide_rows
from touchline.sources.schemas import Field, fields

# Texts that count as a flag.
TRUE_TEXTS = ["1", "true", "t", "yes", "y", "on"]
FALSE_TEXTS = ["0", "false", "f", "no", "n", "off"]
_ZERO_FRACTION = r"\\.0+\\s*$"


class ContractError(ValueError):
    """Raised once for a whole load, after all records were checked."""


def _listed(texts: list[str]) -> str:
    return "(" + ", ".join(f"'{text}'" for text in texts) + ")"


class _Key:
    """SQL about one key of a record: its text, whether it was given, its JSON kind.

    ``_kinds`` lists the keys of a record with their JSON kinds: `` id: BIGINT, ...,``.
    Two flags per record save looking into it for almost every key: ``_has_nulls``
    (some key is null) and ``_has_flips`` (some text field is not text).
    """

    def __init__(self, field: Field):
        self.field = field
        self.name = field.name
        self.text = f"`_text_{field.name}`"
        # used for an absent text only, where a listed key can only be a null
        self.listed = f"(_has_nulls and contains(_kinds, ' {field.name}: VOID,'))"

    def is_kind(self, kind: str) -> str:
        return f"contains(_kinds, ' {self.name}: {kind},')"

    def typed(self) -> str:
        """Value in the table's type, null if it has none."""
        ddl = self.field.type.simpleString()
        if isinstance(self.field.type, T.StringType):
            return self.text
        if isinstance(self.field.type, T.BooleanType):
            return (
                f"case when lower({self.text}) in {_listed(TRUE_TEXTS)} then true"
                f" when lower({self.text}) in {_listed(FALSE_TEXTS)} then false"
                f" when {self.text} = '1.0' and not {self.is_kind('STRING')} then true"
                f" when {self.text} = '0.0' and not {self.is_kind('STRING')} then false end"
            )
        if isinstance(self.field.type, (T.IntegerType, T.LongType)):
            # plain digits first; then a flag, or whole text such as 7.0
            return (
                f"coalesce(try_cast({self.text} as {ddl}), case when {self.is_kind('BOOLEAN')}"
                f" then if({self.text} = 'true', 1, 0)"
                f" else try_cast(regexp_replace({self.text}, '{_ZERO_FRACTION}', '') as {ddl}) end)"
            )
        return f"try_cast({self.text} as {ddl})"

    def value(self) -> str:
        default = self.field.default
        if default is None:
            return f"{self.typed()} as `{self.name}`"
        ddl = self.field.type.simpleString()
        filled = "current_timestamp()" if default == "now" else f"cast('{default}' as {ddl})"
        return (
            f"case when {self.text} is null and not {self.listed} then {filled}"
            f" else {self.typed()} end as `{self.name}`"
        )

    def contract_error(self) -> str | None:
        """What is wrong with the key, null if nothing. For numbers and flags the
        typed value says whether the text was a valid one."""
        field = self.field
        if field.kind is None or field.kind == "any":
            return None
        wrong = f"_has_flips and not {self.is_kind('STRING')}" if field.kind == "str" else f"`{self.name}` is null"
        cases = [
            f"when {self.text} is not null then case when {wrong}"
            f" then concat('{self.name}: not a valid {field.kind}: ', {self.text}) end"
        ]
        if not field.optional:
            cases.append(f"when {self.listed} then '{self.name}: null is not a valid {field.kind}'")
            if field.required:
                cases.append(f"else '{self.name}: field required'")
        return f"case {' '.join(cases)} end"

    def table_error(self) -> str | None:
        """Why the table would refuse what the contract lets through, null if it
        would not."""
        field = self.field
        settled = field.kind in ("int", "bool")
        cases = []
        if not (settled or isinstance(field.type, T.StringType)):
            stored = f"{self.name}: cannot be stored as {field.type.simpleString()}"
            cases.append(
                f"when {self.text} is not null then case when `{self.name}` is null then '{stored}' end"
            )
        if field.not_null and (field.kind is None or field.optional):
            absent = f"{self.text} is null"
            if field.default is not None:
                absent = f"{absent} and {self.listed}"
            cases.append(f"when {absent} then '{self.name}: null in a not-null column'")
        return f"case {' '.join(cases)} end" if cases else None


def _joined(errors: list[str | None]) -> str:
    found = [error for error in errors if error is not None]
    return f"concat_ws('; ', {', '.join(found)})" if found else "''"


# The kinds of a record come as ``OBJECT<id: BIGINT, name: STRING, ...>``; the kinds
# inside nested values are cut out, innermost first.
_KINDS = "schema_of_variant(try_parse_json(_rest))"
_NESTED = "<[^<>]*>"
_TOP_LEVEL = (
    f"case when {{0}} like 'OBJECT<%<%' then regexp_replace(regexp_replace(regexp_replace("
    f"substr({{0}}, 8), '{_NESTED}', ''), '{_NESTED}', ''), '{_NESTED}', '')"
    f" when {{0}} like 'OBJECT<%' then substr({{0}}, 8) end"
)
# Deeper records, which are rare, have their keys looked at one by one.
_ONE_BY_ONE = (
    "concat(concat_ws(', ', transform(map_entries(cast(try_parse_json(_rest) as map<string, variant>)),"
    " e -> concat(e.key, ': ', substring_index(schema_of_variant(e.value), '<', 1)))), '>')"
)


def strictly(text: str, fields_ddl: str) -> str:
    """SQL that parses one whole JSON text as the field ``r`` of a struct of the DDL; text
    after the value, which the parser itself would pass over, leaves the field ``e``
    without the text's hash."""
    return (
        f"from_json(concat('{{\"r\":', {text}, ',\"e\":', xxhash64({text}), '}}'), 'r {fields_ddl}, e bigint, c string',"
        " map('columnNameOfCorruptRecord', 'c', 'allowSingleQuotes', 'false',"
        " 'allowNonNumericNumbers', 'false', 'maxStringLen', '2147483647'))"
    )


_PLAIN = (T.IntegerType, T.LongType, T.BooleanType)


class _Parsed:
    """SQL about one field of the typed parse: its value, and whether it is settled."""

    def __init__(self, field: Field):
        self.field = field
        self.plain = isinstance(field.type, _PLAIN)
        # a text field keeps its JSON kind
        self.kept = field.kind == "str"
        given = f"_p.r.`{field.name}`"
        self.raw = f"cast({given} as string)" if self.kept else given
        self.kind = f"coalesce(schema_of_variant({given}), 'VOID') in ('STRING', 'VOID')"
        # of a text field its kind says so, without building the text
        self.given = f"schema_of_variant({given}) = 'STRING'" if self.kept else f"{given} is not null"
        parsed_as = "variant" if self.kept else field.type.simpleString() if self.plain else "string"
        self.ddl = f"`{field.name}`: {parsed_as}"

    def stored(self) -> str:
        if self.plain or isinstance(self.field.type, T.StringType):
            return self.raw
        return f"try_cast({self.raw} as {self.field.type.simpleString()})"

    def value(self) -> str:
        default = self.field.default
        if default is None:
            return self.stored()
        ddl = self.field.type.simpleString()
        filled = "current_timestamp()" if default == "now" else f"cast('{default}' as {ddl})"
        return f"coalesce({self.stored()}, {filled})"

    def filled_when_missing(self) -> bool:
        """Whether a missing key is fine but a null is not."""
        field = self.field
        refuses_null = field.kind not in (None, "any") and not (field.optional or field.required)
        return refuses_null or field.default is not None

    def settled(self) -> list[str]:
        conditions = [self.kind] if self.kept else []
        if self.field.required or (self.field.not_null and self.field.default is None):
            conditions.append(self.given if self.stored() == self.raw else f"{self.stored()} is not null")
        elif self.stored() != self.raw:
            conditions.append(f"({self.raw} is null or {self.stored()} is not null)")
        return conditions


def _all(conditions: list[str]) -> str:
    """Whether all conditions hold; an unknown one doesn't. A chain of cases: the planner
    compares long conjunctions in every order."""
    return "case" + "".join(f" when ({c}) is not true then false" for c in conditions) + " else true end"


def _good(parsed: list[_Parsed]) -> str:
    """Whether the typed parse settles the record. The pattern looks for a null in place of
    a default; a match inside a nested value only sends a good record the longer way.
    Escapes could hide a name from it."""
    gaps = [p for p in parsed if p.filled_when_missing()]
    conditions = ["_p.c is null", "_p.e = _h", "_p.r is not null", *[c for p in parsed for c in p.settled()]]
    if gaps:
        given = _all([p.given for p in gaps])
        names = "|".join(p.field.name for p in gaps)
        unclear = "contains(_record, 'null') and (contains(_record, chr(92)) or _record rlike"
        conditions.append(f"{given} or not ({unclear} '\"({names})\"\\\\s*:\\\\s*null'))")
    return _all(conditions)


def validate(records: DataFrame, entity: str) -> DataFrame:
    """Typed columns of ``entity`` beside the record, its place and its failures.

    Nothing is dropped: ``accepted`` and ``rejects`` pick from the result.
    """
    compile_wide_rows(records.sparkSession)
    records.sparkSession.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    keys = [_Key(field) for field in fields(entity)]
    parsed = [_Parsed(field) for field in fields(entity)]
    place = [f"_{name}" for name in records.columns]
    as_texts = "struct<" + ", ".join(f"`{key.name}`: string" for key in keys) + ">"
    all_texts = _all([p.kind for p in parsed if p.kept])
    typed_ddl = f"struct<{', '.join(p.ddl for p in parsed)}>"
    once = f"inline(array(struct({strictly('_record', typed_ddl)} as _p, xxhash64(_record) as _h)))"
    settled = [
        "coalesce(_p.e = _h, false) as _whole",
        f"{_good(parsed)} as _good",
    ]
    rest = [
        "case when _whole and not _good then _record end as _rest",
        f"case when _whole and not _good then not {all_texts} end as _has_flips",
    ]
    carried = [*place, "_p", "_whole", "_good"]
    shown = [*carried, "_has_flips"]
    # The parse is the output of a generator, so that it is computed once. The steps above it
    # are projections: a plan needs only those of the columns that it shows, and they are
    # compiled, where a generator over as many columns evaluates its row one node at a time.
    extracted = (
        records.toDF(*place)
        .selectExpr(*place, once)
        .selectExpr(*place, "_p", *settled)
        .selectExpr(*carried, *rest)
        .selectExpr(*shown, "_rest", f"{_KINDS} as _schema")
        .selectExpr(*shown, "_rest", f"{_TOP_LEVEL.format('_schema')} as _top")
        .selectExpr(*shown, "_rest", f"case when contains(_top, '<') then {_ONE_BY_ONE} else _top end as _top")
        .selectExpr(*shown, "_rest", "concat(' ', rtrim('>', _top), ',') as _kinds")
        .selectExpr(
            *shown,
            "_rest",
            "_kinds",
            "contains(_kinds, ': VOID,') as _has_nulls",
        )
        .selectExpr(*shown, "_kinds", "_has_nulls", f"{strictly('_rest', as_texts)} as _t")
        .selectExpr(*shown, "_kinds", "_has_nulls", *[f"_t.r.`{key.name}` as `_text_{key.name}`" for key in keys])
    )
    typed = extracted.selectExpr("*", *[key.value() for key in keys])
    errors = _joined([key.contract_error() for key in keys])
    table_errors = _joined([key.table_error() for key in keys])
    checked = [
        "case when _good then ''"
        " when _record is null then 'document without a readable list of records'"
        f" when _kinds is null then 'not a JSON object' else {errors} end as errors",
        f"case when _good or _kinds is null then '' else {table_errors} end as table_errors",
    ]
    values = [f"case when _good then {p.value()} else `{p.field.name}` end as `{p.field.name}`" for p in parsed]
    return typed.selectExpr(*place, *values, *checked)


def _judged(validated: DataFrame) -> DataFrame:
    """With the failures as the output of a generator, where they are computed once: a filter
    on them is not pushed down and computed again there."""
    return validated.selectExpr("* except (errors, table_errors)", "inline(array(struct(errors, table_errors)))")


def accepted(validated: DataFrame, entity: str, *place: str) -> DataFrame:
    """Typed rows of records without failures, with columns of their place if named."""
    return _judged(validated).filter("errors = '' and table_errors = ''").select(
        *[f.name for f in fields(entity)], *place
    )


def rejects(validated: DataFrame, label: str) -> DataFrame:
    """One row per failing record: label, place, id as given and all reasons."""
    return _judged(validated).filter("errors <> '' or table_errors <> ''").selectExpr(
        f"'{label}' as label",
        "_doc as doc",
        "_pos as row",
        "coalesce(get_json_object(_record, '$.id'), '?') as id",
        "concat_ws('; ', nullif(errors, ''), nullif(table_errors, '')) as reasons",
    )


def require_valid(rejected: DataFrame, shown: int = 20) -> None:
    """Raise once if anything was rejected. The message shows some of the records;
    all of them are in the rejects frame."""
    sample = rejected.orderBy("label", "doc", "row").limit(shown).collect()
    if not sample:
        return
    lines = [f"{r.label}, record {r.row} (id {r.id}) of {r.doc}: {r.reasons}" for r in sample]
    raise ContractError("\n".join([f"records refused: {rejected.count()}, of which", *lines]))
