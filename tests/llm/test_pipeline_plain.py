"""Every stage of the pipeline, and its whole run, row for row against plain Python.

The plain versions share no code with the operators. Only the weights of the trained
field are taken over: which lines they mark is computed here again.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

import pytest
from test_texts import base_facts, clusters, held_items

import corpus_pipeline
from touchline.llm import decontamination, quality, queries
from touchline.llm.tables import staged

SF = "/root/testdata/sf0.001"
SPACES = "\x20\x09\x0a\x0b\x0c\x0d"


def plain_line_features(text):
    """[(features in the order of ``quality.FEATURES``, characters)] of the lines with a word."""
    out, seen = [], set()
    for line in text.split("\n"):
        words = re.findall(r"[^\x20\x09-\x0D]+", line)
        if not words:
            continue
        n, chars = len(words), [c for c in line if c not in SPACES]
        share = lambda hold, of=chars: sum(map(hold, of)) / len(of)
        symbols = share(lambda c: c in "#*$%&|<>")
        upper = share(lambda c: "A" <= c <= "Z" or "\xc0" <= c <= "\xde")
        digits = share(lambda c: "0" <= c <= "9")
        stutter = sum(a == b for a, b in zip(words, words[1:], strict=False)) / n
        mean = len(chars) / n
        out.append(
            (
                [
                    True, symbols > 0.02, symbols > 0.1, symbols > 0.3, line.count("|") / n > 0.2,
                    upper > 0.3, upper > 0.6, line.count("!") / n > 0.3, stutter > 0.1, stutter > 0.4,
                    n < 3, n < 6, n > 15, line in seen, digits > 0.2, digits > 0.5, mean > 12, mean < 2.5,
                ],
                len(chars),
            )
        )
        seen.add(line)
    return out


def plain_content_share(text, field):
    """Share of characters in the lines that the best labelling marks as content, from a
    table of best scores filled from the last line to the first; ties go to content."""
    lines = plain_line_features(text)
    if not lines:
        return 0.0
    gain = [sum(w for w, on in zip(field.weights.tolist(), on_line, strict=True) if on) for on_line, _ in lines]
    steps = field.steps.tolist()
    rest = [(0.0, 0.0)]  # by label of the line before
    for i in range(len(lines) - 1, 0, -1):
        rest.append(tuple(max(steps[a][0] + rest[-1][0], steps[a][1] + gain[i] + rest[-1][1]) for a in (0, 1)))
    rest.reverse()
    first = field.first.tolist()
    label = int(first[1] + gain[0] + rest[0][1] >= first[0] + rest[0][0])
    held = lines[0][1] * label
    for i in range(1, len(lines)):
        label = int(steps[label][1] + gain[i] + rest[i][1] >= steps[label][0] + rest[i][0])
        held += lines[i][1] * label
    return held / sum(chars for _, chars in lines)


def plain_quality(rows, field):
    return [r for r in rows if not base_facts(r["text"])[-1] and plain_content_share(r["text"], field) >= 0.5]


def plain_near(rows):
    """Texts with an id are linked pairwise; texts without one join equal texts only."""
    named = [(r["doc_id"], r["text"]) for r in rows if r["doc_id"] is not None]
    judged = clusters(named, 5, 80)
    least = {}
    for (i, text), (_, size, component) in zip(named, judged, strict=True):
        if size:
            least[text] = min(component, least.get(text, component))
    out, seen = [], set()
    for r in rows:
        key = (r["doc_id"], r["text"])
        if not (r["text"] or "").strip(SPACES):
            out.append(r)
        elif key not in seen and least.get(r["text"]) == r["doc_id"]:
            seen.add(key)
            out.append(r)
    return out


def plain_clean(rows, items):
    return [r for r in rows if not held_items(r["text"], items)]


def plain_mix(rows):
    """The order of the mix, by simulation slot by slot."""
    shares = {**queries.SHARES, "*": queries.REST}
    total = sum(shares.values())
    waiting = {name: [] for name in shares}
    for r in rows:
        waiting[r["source"] if r["source"] in queries.SHARES else "*"].append(r)
    place = lambda r: int(hashlib.md5(f"mix:{'' if r['doc_id'] is None else r['doc_id']}".encode()).hexdigest()[:15], 16)
    for rows_of in waiting.values():
        rows_of.sort(key=lambda r: (place(r), r["doc_id"] is not None, r["doc_id"] or 0))
    out, given, slot = [], Counter(), 0
    while any(waiting.values()):
        due = {
            name: math.ceil((given[name] + 1) * total / share)
            for name, share in shares.items()
            if given[name] * total // share <= slot
        }
        slot += 1
        if due:
            name = min(due, key=due.get)
            given[name] += 1
            out += waiting[name][:16]
            del waiting[name][:16]
    return out


def plain_shards(rows):
    size = [len((r["text"] or "").encode()) + 8 for r in rows]
    out, before, slots = [], 0, Counter()
    for r, n in zip(rows, size, strict=True):
        # The shard in whose stretch of bytes the middle of the row falls.
        shard = min(queries.N_SHARDS - 1, (2 * before + n) * queries.N_SHARDS // (2 * sum(size)))
        out.append((r["doc_id"], r["source"], n, shard, slots[shard]))
        slots[shard] += 1
        before += n
    return out


def as_rows(df):
    return [r.asDict() for r in df.collect()]


def bag(rows):
    return Counter(tuple(r.values()) for r in rows)


@pytest.fixture(scope="module")
def league_dir(spark, tmp_path_factory):
    """The smallest tables with odd and planted rows among the documents."""
    path = str(tmp_path_factory.mktemp("corpus"))
    for table in ("labels", "benchmark"):
        spark.read.parquet(f"{SF}/{table}.parquet").write.parquet(f"{path}/{table}.parquet")
    documents = spark.read.parquet(f"{SF}/documents.parquet")
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").limit(4).collect()]
    prose = lambda tag, n: ". ".join(" ".join(f"{tag}{i + j}" for j in range(9)) for i in range(0, n, 9))
    long = prose("word", 396)
    rows = [
        (9000, None, None, None, None), (9001, "", "en", "src0", 0), (9002, long, "en", "src0", 1), (9003, long, "en", None, 1),
        (9003, long, "en", None, 1), (9004, long + " more", "en", "srcX", 1), (9004, long.upper(), "en", "srcX", 1),
        (None, prose("none", 90), "de", "src1", 1), (None, prose("none", 90), "de", "src1", 1), (None, long, "de", "src1", 1),
        (9006, "same " * 500, "en", "src0", 1), (9007, prose("unique", 60_000), "en", "src0", 1), (9008, "| 1 | 2 | 3 |\n" * 40, "en", "src2", 1),
        (9009, prose("a", 90) + "\n" + "\n".join(f"# {i} || ** {i}" for i in range(60)), "en", "src3", 1),
        (9010, f"Ü {prose('ä', 90)}\n\n!! ÀÉ !!\n \t\n{prose('é', 45)}", "fr", "src4", 1), (9011, "tiny text", "en", None, 1),
    ]
    rows += [(9100 + i, f"{prose(f'b{i}x', 180)}\n{item} {prose(f'c{i}x', 90)}", "en", f"src{i}", 1) for i, item in enumerate(items)]
    documents.unionByName(spark.createDataFrame(rows, documents.schema)).repartition(3).write.parquet(f"{path}/documents.parquet")
    return path


@pytest.fixture(scope="module")
def judged_by(spark, league_dir):
    """The trained field and the items, from the documents as they are."""
    docs = spark.read.parquet(f"{league_dir}/documents.parquet")
    field = quality.train(docs, spark.read.parquet(f"{league_dir}/labels.parquet"))
    assert field.weights.any()
    items = decontamination.question_and_answer(spark.read.parquet(f"{league_dir}/benchmark.parquet"))
    return field, [(r.item_id, r.question, r.answer) for r in items.collect()]


def test_each_stage_as_plain_python(spark, league_dir, judged_by):
    field, items = judged_by
    docs = spark.read.parquet(f"{league_dir}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    plain = {
        "quality rules": lambda rows: plain_quality(rows, field),
        "near-duplicates": plain_near,
        "decontamination": lambda rows: plain_clean(rows, items),
        "mixing": plain_mix,
    }
    for name, alike in plain.items():
        rows = as_rows(docs)
        docs = staged(stages[name](spark, docs, league_dir), "test")
        got, want = as_rows(docs), alike(rows)
        assert bag(got) == bag(want), name
        # Every stage before the mix has something to drop.
        assert len(got) == len(rows) if name == "mixing" else 0 < len(got) < len(rows), name
    assert [r["doc_id"] for r in got] == [r["doc_id"] for r in want]
    placed = stages["sharding"](spark, docs, league_dir)
    assert placed.columns == ["doc_id", "source", "size", "shard", "slot"]
    assert sorted(map(tuple, placed.collect()), key=lambda r: r[3:]) == plain_shards(got)


def test_run_as_plain_python(spark, league_dir, judged_by):
    field, items = judged_by
    rows = plain_clean(plain_near(plain_quality(as_rows(spark.read.parquet(f"{league_dir}/documents.parquet")), field)), items)
    got = corpus_pipeline.run(spark, league_dir).collect()
    assert sorted(map(tuple, got), key=lambda r: r[3:]) == plain_shards(plain_mix(rows))
