"""Substring dedup, decontamination, near-duplicates and quality rules against brute force."""

from __future__ import annotations

import itertools
import math
import random
import re
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from touchline.llm import decontamination as deco
from touchline.llm import hashing, quality
from touchline.llm import near_duplicates as near
from touchline.llm import substring_dedup as sub

WORDS = "alpha beta gamma delta eps zeta eta theta iota kappa lam mu nu xi omi pi rho sig tau ups".split()


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", ",", "."]) for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(5)
    shared = [sentence(rng, 25) for _ in range(4)]
    rows = [(i, sentence(rng, rng.randint(0, 60)) + rng.choice(["", " ", "\n"]) + rng.choice(["", *shared])) for i in range(60)]
    rows += [(100 + i, "é" * 30 + shared[i % 2] + "ü" * i) for i in range(4)]
    rows += [(200, None), (201, ""), (202, " \n\t "), (203, "ab" * 400), (204, "ab" * 300), (205, shared[0] * 3)]
    rows += [(7, rows[7][1]), (7, shared[1]), (300, rows[3][1]), (301, rows[3][1] + " tail"), (None, shared[2]), (None, shared[2])]
    return rows


# --- substrings -----------------------------------------------------------------


def removed(rows, length):
    """What is left of each row: [(id, spans, kept)]."""
    key = lambda i: math.inf if i is None else i
    first: dict[bytes, float] = {}
    texts = [(i, (t or "").encode()) for i, t in rows]
    for i, t in texts:
        for p in range(len(t) - length + 1):
            s = t[p : p + length]
            first[s] = min(first.get(s, math.inf), key(i))
    out = []
    for i, t in texts:
        gone = [False] * len(t)
        for p in range(len(t) - length + 1):
            if first[t[p : p + length]] < key(i):
                gone[p : p + length] = [True] * length
        edges = [p for p in range(len(t) + 1) if (p > 0 and gone[p - 1]) != (p < len(t) and gone[p])]
        out.append((i, list(zip(edges[::2], edges[1::2], strict=True)), bytes(c for c, g in zip(t, gone, strict=True) if not g)))
    return sorted(out, key=str)


@pytest.mark.parametrize("block_bytes", [700, 1 << 20])
def test_substrings_as_brute_force(documents, corpus, block_bytes):
    docs = documents(corpus, ["spans", "kept", "block"])
    rows = sub.without_repeats(docs, length=50, block_bytes=block_bytes).collect()
    got = [(r.doc_id, [(s.start, s.end) for s in r.spans], bytes(r.kept)) for r in rows]
    assert sorted(got, key=str) == removed(corpus, 50)
    assert {r.n_bytes for r in rows if r.doc_id in (200, 201)} == {0}


@pytest.mark.parametrize("ids", [[None], [7], [None, 7], [3, 7, None]])
def test_substrings_of_rows_that_share_an_id(documents, ids):
    rng = random.Random(9)
    shared = sentence(rng, 20)
    rows = [(ids[i % len(ids)], f"{sentence(rng, 12)} {shared} {sentence(rng, 12)}") for i in range(60)]
    got = sub.without_repeats(documents(rows), block_bytes=1500).collect()
    found = [(r.doc_id, [(s.start, s.end) for s in r.spans], bytes(r.kept)) for r in got]
    assert sorted(found, key=str) == removed(rows, 50)
    assert any(spans for _, spans, _ in found) == (len(ids) > 1)


def test_substrings_of_an_empty_table(documents):
    assert sub.without_repeats(documents([])).collect() == []


def test_suffix_sort_and_collisions(monkeypatch):
    rng = np.random.default_rng(1)
    data = rng.integers(97, 99, 400, dtype=np.uint8)
    at = rng.integers(0, 380, 90)
    start, size = np.array([0, 1, 4, 50]), np.array([1, 3, 46, 40])
    want = [(g, bytes(data[p : p + 12])) for g, (s, n) in enumerate(zip(start, size, strict=True)) for p in at[s : s + n]]
    for broken in (False, True):
        suffixes = sub.Suffixes(data, 12)
        if broken:  # every hash collides: only the bytes tell
            monkeypatch.setattr(suffixes, "hash", lambda a, n: np.zeros(len(a), np.uint64))
        order, same = sub.sorted_equal(suffixes, at, start, size)
        got = [(int(np.searchsorted(start, i, "right")) - 1, bytes(data[at[o] : at[o] + 12])) for i, o in enumerate(order)]
        assert got == sorted(want)
        assert same.tolist() == [i > 0 and got[i] == got[i - 1] for i in range(len(got))]


@pytest.mark.parametrize("back", [False, True])
@pytest.mark.parametrize("broken", [False, True])
def test_shared_bytes_of_sorted_strings(monkeypatch, back, broken):
    rng = np.random.default_rng(6)
    data = rng.integers(97, 99, 500, dtype=np.uint8)
    at, reach = rng.integers(20, 480, 120), rng.integers(0, 13, 120)
    start, size = np.array([0, 1, 5, 70]), np.array([1, 4, 65, 50])
    text = [bytes(data[p - n : p][::-1] if back else data[p : p + n]) for p, n in zip(at, reach, strict=True)]
    suffixes = sub.Suffixes(data, 12)
    if broken:
        monkeypatch.setattr(suffixes, "hash", lambda a, n: np.zeros(len(a), np.uint64))
    order, shared = sub.sorted_shared(suffixes, at, reach, start, size, back)
    for s, n in zip(start, size, strict=True):
        got = [text[i] for i in order[s : s + n]]
        assert got == sorted(text[s : s + n]) and shared[s] == -1
        alike = [next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b))) for a, b in itertools.pairwise(got)]
        assert shared[s + 1 : s + n].tolist() == alike


# --- decontamination ------------------------------------------------------------


def test_wand_as_exhaustive_scoring():
    rng = random.Random(3)
    entries = [deco.Entry(i, deco._terms_of(" ".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 14)))), 1) for i in range(60)]
    index = deco.Index(entries).build(0.6)
    for _ in range(300):
        query = sorted(rng.sample(range(len(index.vocabulary)), rng.randint(1, len(index.vocabulary))))
        scores = [0.0] * len(entries)
        for t in query:
            for block in index.in_block:
                for i, impact in zip(*block.get(t, ([], []))[:2], strict=True):
                    scores[i] += impact
        want = [i for i, s in enumerate(scores) if s >= index.needed[i] - 1e-9]
        assert [i for k in range(len(index.in_block)) for i, _ in index.search(query, k)] == want


def test_decontamination(spark, documents):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    text = lambda n: " ".join(word() for _ in range(n))
    items = {i: text(20) + ". " + text(8) + "." for i in range(12)}
    items[12] = text(700) + ". " + text(5)
    rows = [(i, text(150)) for i in range(30)]
    rows += [(50 + i, text(200) + "\n" + t.upper() + "\n" + text(90)) for i, t in items.items()]
    rows += [(80, items[0].rpartition(". ")[0]), (81, items[1]), (81, items[1]), (82, None), (83, ""), (84, "word " * 9000), (None, items[2])]
    table = spark.createDataFrame([*items.items(), (90, None), (91, " "), (92, items[3])], "item_id long, text string")
    qa = deco.question_and_answer(table)
    found = deco.contaminated(documents(rows, ["item_id", "score"]), qa).collect()
    want = sorted([*((50 + i, i) for i in items), (81, 1), (81, 1), (None, 2), (53, 92)], key=str)
    assert sorted(((r.doc_id, r.item_id) for r in found), key=str) == want  # 80 holds a question only
    left = {r.doc_id for r in deco.clean(documents(rows), qa).collect()}
    assert left == {i for i, _ in rows} - {i for i, _ in want}
    assert deco.contaminated(documents([]), qa).collect() == []
    assert deco.contaminated(documents(rows), qa.limit(0)).collect() == []
    assert deco.clean(documents(rows), qa.limit(0)).count() == len(rows)


@pytest.mark.parametrize("n", [257, 300, 511, 513, 705])
def test_long_items_are_verified_whole(spark, documents, n):
    rng = random.Random(n)
    text = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(n))
    question, answer = text(n - 5), text(5)
    item = f"{question}. {answer}"
    inserted = item.split(" ")
    inserted[100:100] = text(40).split(" ")
    rows = [(1, f"{text(150)} {item.split(' ')[-1]} {text(150)}"), (2, f"{text(90)} {answer} {text(400)}"), (3, f"{text(70)} {question} {text(300)}")]
    rows += [(4, f"{text(33)} {item} {text(500)}"), (5, item), (6, " ".join(inserted)), (7, " ".join(item.split(" ")[n // 2 :])), (8, text(900) + " " + item)]
    qa = deco.question_and_answer(spark.createDataFrame([(0, item), (1, text(20) + ". " + text(8))], "item_id long, text string"))
    found = deco.contaminated(documents(rows), qa).collect()
    assert sorted((r.doc_id, r.item_id) for r in found) == [(4, 0), (5, 0), (6, 0), (8, 0)]
    assert all(r.question_overlap == r.answer_overlap == 1.0 for r in found if r.doc_id != 6)
    assert {r.doc_id for r in deco.clean(documents(rows), qa).collect()} == {1, 2, 3, 7}
    assert min(len(e.part) for e in deco.index_of(qa, 0, 1, 0.6, 0.8).entries if e.item == 0) > deco.ITEM_WORDS // 2 - 1


def held_items(text, items):
    """Items of at most 256 words held by a text, tried in each window."""
    split = lambda t: re.findall(r"[a-z0-9\u0080-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    grams = lambda w, n: {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}
    words, out = split(text), {}
    windows: dict[tuple[int, int], list[set]] = {}
    for item, question, answer in items:
        parts = [split(question), split(answer)]
        size = len(parts[0]) + len(parts[1])
        size += 2 * max(32, size // 4)
        if not any(parts):
            continue
        starts = range(0, max(0, -(-(len(words) - size) // 32)) * 32 + 1, 32)
        shares = []
        for part in parts:
            n = min(3, len(part))
            if (size, n) not in windows:
                windows[size, n] = [grams(words[a : a + size], n) for a in starts]
            own = grams(part, n)
            shares.append([len(own & there) / len(own) if part else 1.0 for there in windows[size, n]])
        good = [(q + a, (q, a)) for q, a in zip(*shares, strict=True) if q >= 0.8 and a >= 0.8]
        if good:
            out[item] = max(good)[1]
    return out


def test_decontamination_as_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    qa = deco.question_and_answer(spark.read.parquet(f"{sf}/benchmark.parquet"))
    items = [tuple(r) for r in qa.collect()]
    rng = random.Random(4)
    rows = []
    for i, (_, question, answer) in enumerate(items):
        words = f"{question} {answer}".split()
        for k in range(4):  # copies with words changed, left out and put in between
            edited = [w for w in words if rng.random() > 0.02 * k for w in ([w, "new"] if rng.random() < 0.02 * k else [w])]
            rows.append((10_000 + 10 * i + k, " ".join(["pad"] * rng.randint(0, 70) + edited + ["end"] * rng.randint(0, 70))))
    docs = docs.select("doc_id", "text").union(spark.createDataFrame(rows, "doc_id long, text string"))
    want = {(r.doc_id, i): o for r in docs.collect() for i, o in held_items(r.text, items).items()}
    got = {(r.doc_id, r.item_id): (r.question_overlap, r.answer_overlap) for r in deco.contaminated(docs, qa).collect()}
    assert got.keys() == want.keys() and len(got) > len(items)
    assert all(sum(got[k]) == pytest.approx(sum(want[k])) for k in want)


def test_items_are_judged_alone(spark, documents, monkeypatch):
    rng = random.Random(8)
    text = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(n))
    asked, answer = text(20), text(8)
    rows = [(i, f"{text(40)} {asked} {text(gap)} {answer} {text(300)}") for i, gap in enumerate(range(0, 160, 20))]
    common = [(100 + i, " ".join(asked.split()[:16]) + " " + text(4), text(8)) for i in range(40)]  # make the item's words cheap
    long = [(200 + i, text(245), text(5 + 200 * i)) for i in range(3)]
    one = [(1, asked, answer)]
    held = None
    for others in ([], long, common, common + long):
        for size in (32 << 20, 2000):
            monkeypatch.setattr(deco, "INDEX_BYTES", size)
            items = spark.createDataFrame(one + others, "item_id long, question string, answer string")
            assert size > 2000 or not others or deco.n_parts(items) > 1
            found = {r.doc_id for r in deco.contaminated(documents(rows), items).collect() if r.item_id == 1}
            held = found if held is None else held
            assert found == held and {0, 1} <= held < {i for i, _ in rows}
            if others is long:
                assert {r.doc_id for r in deco.clean(documents(rows), items).collect()} == {i for i, _ in rows} - held


def test_question_and_answer(spark):
    table = spark.createDataFrame([(1, "What? One two. Three four."), (2, "a b c d e f g h"), (3, None), (4, "One.")], "item_id long, text string")
    got = {r.item_id: (r.question, r.answer) for r in deco.question_and_answer(table).collect()}
    assert got == {1: ("What? One two. ", "Three four."), 2: ("a b c d e f ", "g h"), 3: ("", ""), 4: ("One.", "")}


# --- near-duplicates ------------------------------------------------------------


def clusters(rows, k, percent):
    sets = []
    for _, t in rows:
        w = (t or "").translate({c: c + 32 for c in range(65, 91)}).encode().split()
        sets.append(frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset())
    label = list(range(len(rows)))
    for a, b in itertools.combinations(range(len(rows)), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
            x, y = label[a], label[b]
            label = [x if v == y else v for v in label]
    least = {}
    for (i, _), v in zip(rows, label, strict=True):
        ids = [j for (j, _), u in zip(rows, label, strict=True) if u == v and j is not None]
        least[v] = min(ids) if ids else None
    return [(i, len(s), least[v] if s else i) for (i, _), s, v in zip(rows, sets, label, strict=True)]


@pytest.mark.parametrize(("k", "percent", "block"), [(3, 85, 1500), (5, 80, 3)])
def test_near_duplicates_as_brute_force(documents, monkeypatch, k, percent, block):
    monkeypatch.setattr(near, "BLOCK", block)
    monkeypatch.setattr(near, "BLOCK_BYTES", block * 2000)
    rng = random.Random(11)
    rows = []
    for base in range(5):
        text = sentence(rng, 120).split(" ")
        for copy in range(14):  # chains of small changes as well as stars
            if rng.random() < 0.6:
                text = list(text)
            changed = list(text)
            for _ in range(rng.randint(0, 3)):
                changed[rng.randrange(len(changed))] = rng.choice(WORDS).upper()
            text = changed if copy % 3 == 0 else text
            rows.append((base * 100 + 50 - copy, " ".join(changed)))
    rows += [(i + 900, sentence(rng, 40)) for i in range(20)]
    rows += [(1000, None), (1001, ""), (1002, " \t"), (1003, "one"), (1004, "ONE"), (1005, "one two"), (1006, "alpha " * 3000), (None, rows[0][1]), (None, "alone here today my friend")]
    rows += [rows[3], (1007, rows[3][1])]
    got = near.near_duplicates(documents(rows, ["component_id", "id", "kept"]), k, percent).collect()
    want = clusters(rows, k, percent)
    assert sorted([(r.doc_id, r.n_shingles, r.component_id) for r in got], key=str) == sorted(want, key=str)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_near_duplicates_of_an_empty_table(documents):
    assert near.near_duplicates(documents([])).collect() == []


def test_components_of_a_long_chain_and_a_star(spark):
    links = [(i, i + 1) for i in range(100, 140)] + [(500, i) for i in range(501, 540)] + [(139, 20)]
    got = {r.node: r.component for r in near.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert {got.get(i, i) for i in range(100, 141)} == {20}
    assert {got.get(i, i) for i in range(500, 540)} == {500}


def test_words_and_hashes_across_slices(monkeypatch):
    text = ("x" * 70 + " yy\t" + "z" * 5 + "\x0b") * 40
    data = np.frombuffer(text.encode(), np.uint8)
    offsets = np.array([0, 0, 400, 400, len(data)])
    starts, ends, owner = hashing.words(data, offsets)
    parts = [text[a:b].split() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
    assert [text[a:b] for a, b in zip(starts, ends, strict=True)] == [w for p in parts for w in p]
    assert owner.tolist() == [i for i, p in enumerate(parts) for _ in p]
    whole = hashing.stretch_hashes(data, starts, ends)
    monkeypatch.setattr(hashing, "SLICE", 64)
    assert (hashing.stretch_hashes(data, starts, ends) == whole).all()


# --- quality --------------------------------------------------------------------


def base_facts(text):
    import re

    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    places = {}
    for i in range(len(words) - 4):
        places.setdefault(tuple(words[i : i + 5]), []).append(i)
    repeated = {i + j for p in places.values() if len(p) > 1 for i in p for j in range(5)}
    return (
        len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(repeated),
        len(words) < 10 or 100 * len(repeated) > 20 * len(words),
    )


def test_quality_facts_as_brute_force(documents, corpus):
    rows = [*corpus, (400, "a b c d e\n" * 5), (401, "line one\n\nline one\nline one \n"), (402, "é|| ü **\n" * 30 + "x" * 5000), (403, "\n\n"), (404, "w " * 20000)]
    df = quality.with_quality(documents(rows, ["n_words", "kept"]), quality.Field.neutral())
    assert df.columns.count("kept") == 1
    got = [(r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in df.collect()]
    assert sorted(got, key=str) == sorted([(i, *base_facts(t)) for i, t in rows], key=str)
    assert all(r.kept == (not r.base_failed) for r in df.collect())  # nothing learned: all lines are content
    kept = quality.with_quality(documents(rows, ["kept"]), quality.Field.neutral(), only_kept=True)
    assert kept.columns == documents(rows, ["kept"]).columns
    assert kept.count() == df.filter("kept").count()
    assert quality.with_quality(documents([]), quality.Field.neutral()).collect() == []


def test_facts_across_slices(corpus, monkeypatch):
    texts = hashing.Texts(pa.array([t for _, t in corpus] + ["a b c d e\n" * 50, "x", "a b c d e", "a b c d e"]))
    whole = quality.described(*texts.part(0, len(texts)))
    for size in (1, 3, 64):
        monkeypatch.setattr(quality, "SLICE", size)
        facts, *rest = quality.described(*texts.part(0, len(texts)))
        assert all((facts[c] == whole[0][c]).all() for c in quality.FACTS)
        assert all((a == b).all() for a, b in zip(rest, whole[1:], strict=True))


def test_memory_of_a_very_long_text():
    text = ("word1 other words here, and sum more of them\n" * 500_000 + "x").encode()
    rng = np.random.default_rng(1)
    data = np.where(np.frombuffer(text, np.uint8) > 32, rng.integers(97, 123, len(text), dtype=np.uint8), np.frombuffer(text, np.uint8))
    del text
    tracemalloc.start()
    facts, *_ = quality.described(data, np.array([0, len(data)]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert facts["n_words"][0] == 4_500_001 and peak < 15 * len(data)


def test_viterbi_as_enumeration(monkeypatch):
    rng = np.random.default_rng(2)
    for _ in range(60):
        field = quality.Field(np.zeros(1), rng.normal(size=2), rng.normal(size=(2, 2)))
        scores = rng.normal(size=int(rng.integers(1, 8)))
        monkeypatch.setattr(quality, "SLICE", int(rng.integers(1, 9)))

        def total(labels, field=field, scores=scores):
            steps = sum(field.steps[a, b] for a, b in itertools.pairwise(labels))
            return field.first[labels[0]] + steps + sum(s for s, y in zip(scores, labels, strict=True) if y)

        best = max(itertools.product((0, 1), repeat=len(scores)), key=total)
        assert total(quality.viterbi(scores, field)) == pytest.approx(total(best))


def test_quality_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    field = quality.train(docs, labels.filter("doc_id % 2 = 0"))
    judged = quality.with_quality(docs, field, keep=["doc_id"]).join(labels.filter("doc_id % 2 = 1"), "doc_id")
    share = {r.quality: r.kept for r in judged.filter("not base_failed").groupBy("quality").agg({"kept": "count"}).withColumnRenamed("count(kept)", "kept").collect()}
    kept = {r.quality: r["count"] for r in judged.filter("kept").groupBy("quality").count().collect()}
    assert kept.get(0, 0) <= 0.1 * share[0]
    assert kept[1] >= 0.99 * share[1]


def test_training_without_both_labels(spark, documents):
    none = spark.createDataFrame([(1, None), (2, 1)], "doc_id long, quality long")
    assert (quality.train(documents([(1, "a b"), (2, "c d")]), none).weights == quality.Field.neutral().weights).all()




def test_components_take_few_tasks_for_few_links(spark, monkeypatch):
    links = [(i, i + 1) for i in range(100, 140)] + [(141, i) for i in range(120, 130)] + [(7, 7), (3, 900), (900, 3), (900, 3)]
    table = spark.createDataFrame(links, "a long, b long")
    written = []
    monkeypatch.setattr(near, "staged", lambda df, name, f=near.staged: written.append(f(df, name)) or written[-1])
    held = {key: spark.conf.get(key) for key in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    context = spark.sparkContext
    try:
        for key, value in zip(held, ("40", "false"), strict=True):
            spark.conf.set(key, value)
        context.setJobGroup("components", "")
        found = near.components(table)
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
        for key, value in held.items():
            spark.conf.set(key, value)
    tracker = context.statusTracker()
    stages = {s for job in tracker.getJobIdsForGroup("components") for s in tracker.getJobInfo(job).stageIds}
    tasks = sum(info.numCompletedTasks for s in stages if (info := tracker.getStageInfo(s)))
    assert tasks < 3 * 40 * len(written)
    assert all(len(df.inputFiles()) <= context.defaultParallelism for df in written)
    rows = [(r.node, r.component) for r in found.collect()]
    assert sorted(rows) == [(i, 100) for i in range(101, 142)] + [(900, 3)]
