"""Secret scans: fixed patterns, and the guess cost of values in a credential context.

The patterns give spans of three kinds. Beyond them, a value that follows a credential
word is a secret if guessing it is expensive. Its cost, in bits, is the least over all
ways to cut it into words, dates, repeats, keyboard walks or runs, and brute-force
characters, found by dynamic programming over its places.

How common a word is comes from all texts: the words of the corpus are counted, without
those inside credential values, and a word costs ``log2(all words / its count)``. Only words
that occur in some value are of use, so those are gathered first and joined with the counts.
Each task drops the words that a bitmap of fixed size rules out, before they are shuffled.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from math import comb, log2

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from touchline.llm.hashing import INVERSE, LOWER, Texts, mix, prefixes_at, stretch_hashes, words
from touchline.llm.tables import staged

# The patterns. The first runs over text with A-Z lowered.
ASSIGN = re.compile(rb"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([a-z0-9+/_.=-]+)""")
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 6, 20, 24
KINDS = ["assign", "access", "hex", "guess"]

# A credential word, something that assigns, and a value; over text with A-Z lowered.
CONTEXT = re.compile(
    rb"""(?:pass(?:word|wd|phrase|code)?|pwd|secret|token|(?:api|access|private|client|auth)[_\-\x20]?key|credentials?|authorization)"""
    rb"""["']?\x20*(?::=|=>|->|[:=])\x20*["'`]?(?:bearer\x20+|basic\x20+)?([^\x00-\x20"'`,;<>()\[\]{}|]{6,})"""
)
LIMIT_BITS = log2(10**10)
LEAST_WORD, MOST_WORD = 3, 20
BITMAP_BITS = 1 << 23

NOT_HEX = np.ones(256, bool)
NOT_HEX[[*b"0123456789abcdef"]] = False
NOT_LETTER = np.ones(256, bool)
NOT_LETTER[[*b"abcdefghijklmnopqrstuvwxyz", *range(0x80, 0x100)]] = False

# --- guess cost -----------------------------------------------------------------

LEET = str.maketrans("4@3015$7", "aaeolsst")
LOWERED = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
# The rows of a keyboard, each shifted against the one above.
KEYBOARD = ["`1234567890-=", " qwertyuiop[]", " asdfghjkl;'", " zxcvbnm,./"]
KEYS = {key: (x, y) for y, row in enumerate(KEYBOARD) for x, key in enumerate(row) if key != " "}
CLASSES = [("a", "z", 26), ("A", "Z", 26), ("0", "9", 10), ("\x20", "\x7e", 33)]
YEARS = (1900, 2050)
DATES = [
    re.compile(rf"(?P<{a}>{p})(?P<sep>[-/._]?)(?P<{b}>{q})(?P=sep)(?P<{c}>{r})")
    for a, p, b, q, c, r in [
        ("y", r"\d{4}", "m", r"\d\d", "d", r"\d\d"),
        ("d", r"\d\d", "m", r"\d\d", "y", r"\d{4}"),
        ("m", r"\d\d", "d", r"\d\d", "y", r"\d{4}"),
    ]
]
YEAR = re.compile(r"\d{4}")
#: Bits for choosing a kind of segment over single characters.
CHOICE = 1.0


def alphabet_bits(value: str) -> float:
    """Bits of a brute-force character: the classes of characters that the value has."""
    size = 0
    for low, high, n in CLASSES[:3]:
        size += n if any(low <= c <= high for c in value) else 0
    if any("\x20" <= c <= "\x7e" and not c.isalnum() for c in value):
        size += CLASSES[3][2]
    if any(c > "\x7e" for c in value):
        size += 256
    return log2(max(size, 10))


def _date_ends(value: str, at: int) -> Iterator[tuple[int, float]]:
    years = YEARS[1] - YEARS[0]
    found = YEAR.match(value, at)
    if found and YEARS[0] <= int(found[0]) < YEARS[1]:
        yield found.end(), log2(years)
    for pattern in DATES:
        m = pattern.match(value, at)
        if m and YEARS[0] <= int(m["y"]) < YEARS[1] and 1 <= int(m["m"]) <= 12 and 1 <= int(m["d"]) <= 31:
            yield m.end(), log2(years * 365) + (2 if m["sep"] else 0)


def _runs(value: str, step: int) -> list[int]:
    """For each place the end of the longest stretch from it that repeats its first ``step``
    characters."""
    n = len(value)
    ends = [min(i + step, n) for i in range(n)]
    for i in range(n - step - 1, -1, -1):
        if value[i] == value[i + step]:
            ends[i] = max(ends[i + 1], i + step + 1)
    return ends


def _walk_ends(low: str, at: int) -> Iterator[tuple[int, float]]:
    """Walks over neighbouring keys, with bits for the start and each turn, and runs of
    neighbouring characters such as ``abc`` or ``321``; of three characters or more."""
    end, turns, way = at + 1, 0, None
    while end < len(low) and low[end] in KEYS and low[end - 1] in KEYS:
        (x, y), (u, v) = KEYS[low[end - 1]], KEYS[low[end]]
        step = (u - x, v - y)
        if step == (0, 0) or max(abs(step[0]), abs(step[1])) > 1:
            break
        turns, way = turns + (step != way), step
        end += 1
        if end - at >= 3 and end - at <= MOST_WORD:
            yield end, log2(len(KEYS)) + turns * log2(5) + log2(end - at)
    if end - at > MOST_WORD:
        yield end, log2(len(KEYS)) + turns * log2(5) + log2(end - at)
    end = at + 2
    if end <= len(low) and low[at].isalnum() and abs(ord(low[at + 1]) - ord(low[at])) == 1:
        step = ord(low[at + 1]) - ord(low[at])
        while end < len(low) and ord(low[end]) - ord(low[end - 1]) == step:
            end += 1
        if end - at >= 3:
            yield end, log2(36) + 1 + log2(end - at)


def _case_bits(piece: str) -> float:
    upper = sum("A" <= c <= "Z" for c in piece)
    if upper == 0:
        return 0.0
    if upper == len(piece) or (upper == 1 and "A" <= piece[0] <= "Z"):
        return 1.0
    return log2(comb(len(piece), upper)) + 1


def guess_bits(value: str, word_bits: dict[str, float]) -> float:
    """The least cost of any segmentation of the whole value. ``word_bits`` has the cost of
    the corpus words that occur in it, in lower case."""
    low = value.translate(LOWERED)
    plain = low.translate(LEET)
    single = alphabet_bits(value)
    repeats = [(step, _runs(value, step)) for step in (1, 2, 3, 4)]
    best = [0.0] + [float("inf")] * len(value)

    def reach(end: int, cost: float) -> None:
        if cost < best[end]:
            best[end] = cost

    for i in range(len(value)):
        here = best[i]
        reach(i + 1, here + single)
        for end in range(i + LEAST_WORD, min(i + MOST_WORD, len(value)) + 1):
            for text in (low[i:end], plain[i:end]):
                bits = word_bits.get(text)
                if bits is not None:
                    swapped = len({a for a, b in zip(low[i:end], text) if a != b})
                    reach(end, here + CHOICE + bits + swapped + _case_bits(value[i:end]))
        for end, bits in (*_date_ends(value, i), *_walk_ends(low, i)):
            reach(end, here + CHOICE + bits)
        for step, ends in repeats:
            times = (ends[i] - i) // step
            if times >= 3 or (times == 2 and step > 2):
                reach(i + times * step, here + CHOICE + step * single + log2(times))
    return best[-1]


# --- scan -----------------------------------------------------------------------

SPAN = T.StructType([T.StructField("start", T.LongType()), T.StructField("kind", T.IntegerType()), T.StructField("end", T.LongType())])
VALUE = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("value", T.StringType())])
SCANNED = [
    *[T.StructField(f"n_{kind}", T.LongType()) for kind in KINDS[:3]],
    T.StructField("base_sha256", T.StringType()),
    T.StructField("base", T.ArrayType(SPAN)),
    T.StructField("values", T.ArrayType(VALUE)),
]


def _code_points(data: np.ndarray, at: list[int]) -> dict[int, int]:
    """The number of code points before each byte place."""
    places, out, count = sorted(set(at)), {}, 0
    for before, place in zip([0, *places], places):
        count += int(np.count_nonzero((data[before:place] & 0xC0) != 0x80))
        out[place] = count
    return out


def spans_text(spans: list[tuple[int, int, int]]) -> str:
    """``kind:start:end`` of (start, kind number, end), in order, joined by commas."""
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in sorted(spans))


def _scan_text(data: np.ndarray, hexes: list[tuple[int, int]]) -> tuple[list, list]:
    """(base spans, credential values) of one text, in code points."""
    raw = data.tobytes()
    low = raw.lower()
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(low) if m.end(1) - m.start(1) >= ASSIGN_LEAST]
    if b"AKIA" in raw:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(raw) if m.end() - m.start() >= ACCESS_LEAST]
    found += [(start, 2, end) for start, end in hexes]
    values = [m.span(1) for m in CONTEXT.finditer(low)]
    if not found and not values:
        return [], []
    at = _code_points(data, [p for start, _, end in found for p in (start, end)] + [p for span in values for p in span])
    base = sorted((at[start], kind, at[end]) for start, kind, end in found)
    return base, [(at[start], at[end], raw[start:end].decode()) for start, end in values]


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = Texts(batch.column("_text"))
        base, values = [], []
        for first, last in texts.runs():
            data, offsets = texts.part(first, last)
            starts, ends, owner = words(data, offsets, NOT_HEX)
            long = np.flatnonzero(ends - starts >= HEX_LEAST)
            hexes: dict[int, list[tuple[int, int]]] = {}
            for i in long.tolist():
                begin = int(offsets[owner[i]])
                hexes.setdefault(int(owner[i]), []).append((int(starts[i]) - begin, int(ends[i]) - begin))
            for i in range(last - first):
                b, v = _scan_text(data[offsets[i] : offsets[i + 1]], hexes.get(i, []))
                base.append(b)
                values.append(v)
        counts = [[sum(kind == k for _, kind, _ in b) for b in base] for k in range(3)]
        digests = [hashlib.sha256(spans_text(b).encode()).hexdigest() for b in base]
        kinds = [T.ArrayType(SPAN), T.ArrayType(VALUE)]
        structs = [
            pa.array([[dict(zip(kind.elementType.names, s)) for s in row] for row in rows], arrow_type(kind))
            for kind, rows in zip(kinds, (base, values))
        ]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("_id"),
                *[pa.array(c, pa.int64()) for c in counts],
                pa.array(digests, pa.string()),
                *structs,
            ],
            names=["id", *[f.name for f in SCANNED]],
        )


def arrow_type(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


# --- words of the corpus ---------------------------------------------------------


def _value_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(value, word, bit) of the stretches of a value that may be words, some at a time."""
    for batch in batches:
        out: list[tuple[str, str, int]] = []
        for value in batch.column(0).to_pylist():
            low = value.translate(LOWERED)
            for text in dict.fromkeys((low, low.translate(LEET))):
                for run in re.finditer(r"[a-z\x80-\U0010ffff]+", text):
                    for part in _stretches(run[0]):
                        out += [(value, word, bit) for word, bit in part]
                        if len(out) > 50_000:
                            yield _rows(out)
                            out = []
        yield _rows(out)


def _rows(out: list[tuple[str, str, int]]) -> pa.RecordBatch:
    columns = list(zip(*out)) or [(), (), ()]
    arrays = [pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.string(), pa.int64()))]
    return pa.RecordBatch.from_arrays(arrays, names=["value", "word", "bit"])


def _stretches(run: str) -> Iterator[list[tuple[str, int]]]:
    """All stretches of a run of letters, of the length of a word, by start."""
    sizes = np.array([len(c.encode()) for c in run])
    at = np.concatenate([[0], np.cumsum(sizes)])
    sums = prefixes_at(np.frombuffer(run.encode(), np.uint8), at)
    back = [pow(INVERSE, int(p), 1 << 64) for p in at]
    for i in range(len(run) - LEAST_WORD + 1):
        ends = np.arange(i + LEAST_WORD, min(i + MOST_WORD, len(run)) + 1)
        hashes = mix((sums[ends] - sums[i]) * np.uint64(back[i]) + (at[ends] - at[i]).astype(np.uint64))
        yield [(run[i:e], int(h) % BITMAP_BITS) for e, h in zip(ends, hashes)]


def _bitmap(needed: DataFrame) -> np.ndarray:
    """The bits of the needed words: one megabyte, however many there are."""
    number = F.col("bit") + 1  # buckets and places count from one
    bits = needed.groupBy(F.bitmap_bucket_number(number).alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(number)).alias("part")
    )
    out = np.zeros(BITMAP_BITS, bool)
    for row in bits.collect():
        part = np.unpackbits(np.frombuffer(bytes(row.part), np.uint8), bitorder="little")
        start = (row.bucket - 1) * len(part)
        take = min(len(part), BITMAP_BITS - start)
        out[start : start + take] = part[:take]
    return out


def _word_counts(docs: DataFrame, bitmap: np.ndarray) -> DataFrame:
    """(word, n) per part of a task for the words whose bit is set, and the number of all
    words under null."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = Texts(batch.column(0))
            for first, last in texts.runs():
                data, offsets = texts.part(first, last)
                data = LOWER[data]
                starts, ends, _ = words(data, offsets, NOT_LETTER)
                hashes = stretch_hashes(data, starts, ends)
                wanted = np.flatnonzero(bitmap[(hashes % np.uint64(BITMAP_BITS)).astype(np.int64)])
                _, at, n = np.unique(hashes[wanted], return_index=True, return_counts=True)
                at = wanted[at]
                texts_of = [data[s:e].tobytes().decode() for s, e in zip(starts[at], ends[at])]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([*texts_of, None], pa.string()), pa.array([*n.tolist(), len(starts)], pa.int64())], names=["word", "n"]
                )

    return docs.select("_text").mapInArrow(count, "word string, n long")


def _value_costs(values: DataFrame, docs: DataFrame) -> DataFrame:
    """(value, bits) of all distinct values. ``values`` has one row per occurrence."""
    distinct = values.groupBy("value").agg(F.count(F.lit(1)).alias("copies"))
    distinct = staged(distinct, "secret-values")
    parts = staged(distinct.select("value").mapInArrow(_value_words, "value string, word string, bit long").distinct(), "secret-words")
    counted = staged(_word_counts(docs, _bitmap(parts)).groupBy("word").agg(F.sum("n").alias("n")), "secret-counts")
    total = counted.filter("word is null").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first().n
    inside = F.regexp_extract_all(F.translate("value", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(r"[a-z\x{80}-\x{10ffff}]+"), F.lit(0))
    in_values = distinct.select(F.explode(inside).alias("word"), "copies").groupBy("word").agg(F.sum("copies").alias("hidden"))
    net = (
        counted.join(in_values, "word", "left")
        .select("word", (F.col("n") - F.coalesce("hidden", F.lit(0))).alias("n"))
        .filter("n > 0")
    )
    known = (
        parts.join(net, "word")
        .groupBy("value")
        .agg(F.collect_list(F.struct("word", "n")).alias("known"))
    )

    def cost(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = [
                guess_bits(value, {w["word"]: log2(max(total, w["n"]) / w["n"]) for w in found or []})
                for value, found in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bits, pa.float64())], names=["value", "bits"])

    return distinct.select("value").join(known, "value", "left").select("value", "known").mapInArrow(cost, "value string, bits double")


def secrets(
    docs: DataFrame, limit_bits: float = LIMIT_BITS, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per input row: the id, ``n_assign``, ``n_access``, ``n_hex``, ``base_sha256``
    over the spans of the patterns, ``n_guess``, and ``found``, all spans as an array of
    (start, kind number, end) in code points, end exclusive, by start and kind.

    A value of a credential context whose cost is ``limit_bits`` or more is a span of kind
    ``guess``, also where a pattern covers it; spans of the patterns always stay. Null and empty
    texts have no spans. Texts are scanned whole, however long; words count up to 20
    letters. A null id stays null and repeated rows are answered each; a value gets the same
    answer everywhere. An empty table gives an empty result. Other columns of the input are
    not read, whatever their names.
    """
    source = docs.select(docs[id_col].alias("_id"), docs[text_col].alias("_text"))
    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), *SCANNED])
    scanned = staged(source.mapInArrow(_scan, schema).withColumn("row", F.monotonically_increasing_id()), "secret-scan")
    own = [f"n_{kind}" for kind in KINDS[:3]] + ["base_sha256"]
    none = scanned.filter(F.size("values") == 0).select(
        F.col("id").alias(id_col), *own, F.lit(0).cast("long").alias("n_guess"), F.col("base").alias("found")
    )
    some = scanned.filter(F.size("values") > 0)
    if some.isEmpty():
        return none
    each = some.select("row", F.explode("values").alias("v")).select("row", "v.start", "v.end", "v.value")
    costs = _value_costs(each.select("value"), source)
    guessed = (
        each.join(costs.filter(F.col("bits") >= limit_bits).select("value"), "value")
        .groupBy("row")
        .agg(F.collect_list(F.struct("start", F.lit(KINDS.index("guess")).alias("kind"), "end")).alias("guessed"))
    )
    empty = F.array().cast(T.ArrayType(SPAN))
    added = F.coalesce(F.col("guessed").cast(T.ArrayType(SPAN)), empty)
    with_values = some.join(guessed, "row", "left").select(
        F.col("id").alias(id_col), *own, F.size(added).cast("long").alias("n_guess"), F.array_sort(F.concat("base", added)).alias("found")
    )
    return none.unionByName(with_values)


def as_text(spans: str) -> Column:
    """The spans as ``kind:start:end``, joined by commas."""
    kinds = F.array(*[F.lit(kind) for kind in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", kinds[s["kind"]], s["start"], s["end"])), ",")
