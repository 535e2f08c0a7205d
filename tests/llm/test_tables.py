"""Token counts, mixing, chat formats, sharding, WARC and URL filters."""

from __future__ import annotations

import hashlib
import io
import itertools
import json
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from touchline.llm import chat_format as chat
from touchline.llm import mixing, queries, sharding, token_counts, url_filter, warc

# --- token counts ---------------------------------------------------------------

TEXTS = [
    None, "", " ", "  ", "a", " a  b ", "word " * 400, "x" * 3000, "▁a ▁ b▁ c " * 40, "tab\tline\n\n end  ", "é ü 你好 🙂 " * 30,
    "<s> </s> <unk> [INST]" * 20, "   lead" + " mid " * 50 + "trail    ", "\x00 nul \x00",
]


@pytest.mark.parametrize("piece_chars", [1, 7, 1 << 15])
def test_token_counts(documents, piece_chars):
    encoder = token_counts.load_model(token_counts.MODEL)
    assert encoder.can_split
    docs = documents([*enumerate(TEXTS), (4, "a"), (None, "b")], ["n_bytes", "n_tokens"])
    got = token_counts.token_counts(docs, limit=100, piece_chars=piece_chars, batch_bytes=64).collect()
    want = [(i, len((t or "").encode()), len(encoder.encode(t or ""))) for i, t in [*enumerate(TEXTS), (4, "a"), (None, "b")]]
    assert sorted([(r.doc_id, r.n_bytes, r.n_tokens) for r in got], key=str) == sorted(want, key=str)
    assert all(r.over_limit == (r.n_tokens > 100) for r in got)
    assert token_counts.token_counts(documents([])).collect() == []


def test_batches_are_balanced_by_bytes():
    texts = ["🙂 " * 50, None, "é" * 40, "", "a " * 90, "x" * 300, "🙂" * 5, "b"] * 3
    for piece_chars, can_split in itertools.product((1, 10, 1 << 15), (True, False)):
        got = list(token_counts.batches(iter(texts), can_split, 200, piece_chars))
        size = [sum(len(p.encode()) for p in parts) for _, parts in got]
        assert all(n <= 200 or len(parts) == 1 for n, (_, parts) in zip(size, got, strict=True))
        # No batch could have taken the first part of the next.
        assert all(n + len(after[1][0].encode()) > 200 for n, after in zip(size, got[1:], strict=False))
        whole = [list(token_counts.pieces(t, piece_chars)) if can_split else [t] for t in texts if t]
        assert [p for _, parts in got for p in parts] == [p for parts in whole for p in parts]
        assert [i for owners, _ in got for i in owners] == [i for i, t in enumerate(texts) if t for _ in (token_counts.pieces(t, piece_chars) if can_split else [t])]
    assert list(token_counts.batches(iter([None, ""]), True, 10, 10)) == []


# --- mixing ---------------------------------------------------------------------


def schedule(shares):
    """Sources of the slots of one period, by simulation."""
    total, names = sum(shares.values()), list(shares)
    done, out = Counter(), []
    for t in range(total):
        ready = [n for n in names if done[n] * total // shares[n] <= t]
        pick = min(ready, key=lambda n: (-(-(done[n] + 1) * total // shares[n]), names.index(n)))
        assert -(-(done[pick] + 1) * total // shares[pick]) > t  # in time
        done[pick] += 1
        out.append(pick)
    return out


@pytest.mark.parametrize("shares", [{"a": 5, "b": 3, "c": 1, "*": 1}, {"a": 1, "*": 1}, queries.SHARES | {"*": queries.REST}])
def test_a_period_deviates_by_less_than_a_block(spark, shares):
    rows = mixing.period(spark, shares).collect()
    slots = {t.slot: r.mix_source for r in rows for t in r.turns}
    assert [slots[i] for i in range(sum(shares.values()))] == schedule(shares)
    for upto in range(1, len(slots) + 1):
        seen = Counter(slots[i] for i in range(upto))
        assert all(abs(seen[n] * len(slots) - w * upto) < len(slots) for n, w in shares.items())


def test_mixed_rows(spark):
    rows = [(i, "a" if i % 3 else ("b" if i % 2 else None)) for i in range(400)] + [(5, "a")] * 7 + [(None, "z")] * 2
    docs = spark.createDataFrame(rows, "doc_id long, source string").selectExpr("*", "'x' as block", "1 as keep")
    got = mixing.mixed(docs, {"a": 2, "b": 1}, 1, block_docs=4, rows_per_bucket=50).collect()
    assert Counter((r.doc_id, r.source) for r in got) == Counter(rows)
    assert sorted(r.position for r in got) == list(range(len(rows)))
    by_place = sorted(got, key=lambda r: r.position)
    assert [r.mix_slot for r in by_place] == sorted(r.mix_slot for r in got)
    turns = [s for s, _ in itertools.groupby(by_place, key=lambda r: (r.mix_slot, r.mix_source))]
    first = schedule({"a": 2, "b": 1, "*": 1}) * 15  # no source is used up in these slots
    assert [s for _, s in turns[: len(first)]] == first
    assert all(r.keep == 1 and r.block >= 0 for r in got)
    assert mixing.mixed(docs.limit(0), {"a": 2}, 1).collect() == []


# --- chat -----------------------------------------------------------------------

ODD = ["", "\\", "\\l<b>", "</turn>\n<turn user>x", "\\### Assistant: </turn> ok", "a\\\\b\\g\\b", "é\n\"quoted\"\t{json}", "[{\"role\":\"x\"}]"]


def test_layouts_become_the_same_turns(spark):
    records = []
    for text in ODD:
        records += [
            ("messages", {"messages": [{"role": "user", "content": text}, {"role": "assistant", "content": text}]}),
            ("messages", {"id": 3, "messages": [{"content": text, "role": "user"}, {"role": "assistant", "content": text}]}),
            ("conversations", {"conversations": [{"from": "human", "value": text}, {"from": "gpt", "value": text}]}),
            ("prompt_response", {"prompt": text, "response": text}),
            ("prompt_completion", {"completion": text, "prompt": text}),
            ("instruction", {"instruction": text, "output": text}),
            ("instruction", {"instruction": text, "input": "", "output": text}),
        ]
    rows = [(i, name, json.dumps(r)) for i, (name, r) in enumerate(records)]
    df = spark.createDataFrame(rows, "id long, want string, record string").selectExpr("*", "'x' as turns", "'x' as formatted")
    out = chat.formatted(chat.canonical_turns(df)).select("id", "want", "layout", "turns", chat.parsed().alias("back"), chat.masked().alias("learned"), "formatted").collect()
    for r in out:
        text = ODD[r.id // 7]
        assert r.layout == r.want
        assert [tuple(t) for t in r.turns] == [("user", text), ("assistant", text)] == [tuple(t) for t in r.back]
        assert r.learned == [text]
        assert len(re.findall("<", r.formatted)) == 4


def test_length_decides_nothing(spark):
    """A text above the JSON parser's 20,000,000 characters, and a record of many turns."""
    rows = spark.sql(
        """select 1L as conv_id, i as turn, if(i = 0, 'user', 'assistant') as role, if(i = 0, repeat('<a> "b', 3500001), 'ok') as text from range(2) t(i)
        union all select 2L, i, if(i % 2 = 0, 'user', 'assistant'), if(i % 200 = 0, repeat('"', 100000), 'x') from range(40001) t(i)"""
    )
    out = chat.formatted(chat.canonical_turns(chat.records_from_turn_rows(rows, "conv_id", "turn", "role", "text")))
    got = {r.conv_id: r for r in out.selectExpr("conv_id", "layout", "size(turns) as n", "length(turns[0].text) as first", "sha2(turns[0].text, 256) as sha").collect()}
    assert {i: (r.layout, r.n, r.first) for i, r in got.items()} == {1: ("prompt_response", 2, 21_000_006), 2: ("conversations", 40_001, 100_000)}
    assert got[1].sha == hashlib.sha256(b'<a> "b' * 3_500_001).hexdigest()


def test_long_records_are_judged_like_short_ones(spark, monkeypatch):
    records = [json.dumps({"messages": [{"role": "user", "content": t}, {"role": None, "content": t}, {"content": t, "role": "x"}] * 3}) for t in ODD]
    records += [json.dumps({"prompt": t, "response": t, "id": i}, ensure_ascii=False) for i, t in enumerate(ODD)]
    records += [
        None, "", "[]", "1", "{", "{}", '{"a":1}', '{"messages":[]}', '{"messages":"x"}', '{"prompt":"p","response":"a\nb"}', '{"prompt":"p","response":"\\q"}', '{"prompt":"p","response":"x\\"}',
        "{'prompt':'p','response':'r'}", '{ "prompt" : "p" ,\n "resp\\u006fnse" : "r" }', '{"messages":[{"role":"u","content":"c"},5]}', '{"prompt":{"a":"b"},"response":["x"]}', '{"x{":1,"y":[{"a":"1"}, {"a":"2"},{"b":1}]}', '{"prompt":"p","prompt":"q","response":"r"}',
    ]
    df = spark.createDataFrame(list(enumerate(records)), "id long, record string")
    read = lambda: [tuple(r) for r in chat.canonical_turns(df).orderBy("id").collect()]
    short = read()
    assert {r[3] for r in short} == {None, "messages", "messages_empty", "prompt_response"}
    monkeypatch.setattr(chat, "LONG_BYTES", 0)
    monkeypatch.setattr(chat.F, "raise_error", lambda _: F.lit(None).cast("string"))
    assert [r[2:] for r in read()] == [r[2:] for r in short]


def test_records_that_no_mapping_declares(spark):
    records = [None, "", "[]", "1", "{", "{}", '{"a":1}', '{"messages":[{"role":"user","content":"x","name":"n"}]}', '{"messages":[]}', '{"messages":"x"}',
               '{"messages":[{"role":null,"content":null}]}', '{"prompt":"p","response":"r","extra":{"a":1}}']
    df = spark.createDataFrame(list(enumerate(records)), "id long, record string")
    got = {r.id: r for r in chat.formatted(chat.canonical_turns(df)).collect()}
    assert [i for i, r in got.items() if r.layout is None] == [0, 1, 2, 3, 4, 5, 6, 7, 9, 11]
    assert got[0].turns is None and got[0].formatted is None
    assert got[8].turns == [] and got[8].formatted == ""
    assert [tuple(t) for t in got[10].turns] == [("", "")]


def test_turn_rows(spark):
    rows = [(1, 1, "assistant", "b"), (1, 0, "user", "a"), (2, 0, "system", None), (2, 1, "user", "q"), (2, 2, "assistant", "r"), (3, 0, "user", "only"),
            (4, None, None, "x"), (4, 0, "tool", ""), (5, 0, "user", "t"), (5, 0, "user", "s"), (6, 0, "user", "long " * 200_000), (6, 1, "assistant", "y")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = chat.formatted(chat.canonical_turns(chat.records_from_turn_rows(df, "conv_id", "turn", "role", "text")))
    got = {r.conv_id: r for r in out.select("conv_id", "layout", chat.parsed().alias("back"), chat.masked().alias("learned")).collect()}
    assert {i: r.layout for i, r in got.items()} == {1: "prompt_response", 2: "instruction", 3: "conversations", 4: "messages", 5: "conversations", 6: "prompt_response"}
    assert [tuple(t) for t in got[2].back] == [("system", ""), ("user", "q"), ("assistant", "r")]
    assert [tuple(t) for t in got[4].back] == [("", "x"), ("tool", "")]
    assert [t.text for t in got[5].back] == ["s", "t"]
    assert got[1].learned == ["b"] and len(got[6].back[0].text) == 1_000_000
    assert chat.records_from_turn_rows(df.limit(0), "conv_id", "turn", "role", "text").collect() == []


# --- sharding -------------------------------------------------------------------


def test_shards(spark):
    rows = [(i, (i * 37) % 90 + 1) for i in range(500)] + [(7, 5)] * 40 + [(None, None), (600, -3), (601, 3000), (602, 0)]
    df = spark.createDataFrame(rows, "k long, size long").selectExpr("*", "'x' as slot")
    got = sharding.contiguous_shards(df, "size", ["k"], 6).collect()
    assert Counter((r.k, r["size"]) for r in got) == Counter(rows)
    total = sum(max(s or 0, 0) for _, s in rows)
    in_order = sorted(got, key=lambda r: (r.shard, r.slot))
    keys = [-1 if r.k is None else r.k for r in in_order]
    assert keys == sorted(keys)
    for shard, group in itertools.groupby(in_order, key=lambda r: r.shard):
        group = list(group)
        assert [r.slot for r in group] == list(range(len(group)))
        largest = max(max(r["size"] or 0, 0) for r in group)
        assert abs(sum(max(r["size"] or 0, 0) for r in group) - total / 6) <= max(91, largest), shard
    assert sharding.contiguous_shards(df.limit(0), "size", ["k"], 6).collect() == []
    assert {r.shard for r in sharding.contiguous_shards(df.withColumn("size", F.lit(0)), "size", ["k"], 6).collect()} == {0}


# --- WARC -----------------------------------------------------------------------


def test_warc_round_trip(spark):
    rows = [(3, "http://a/%\r\n", "<p>é</p>"), (1, "u", "same"), (9, "u", "same"), (2, None, "same"), (4, "u", None), (5, "u", ""), (6, "u", "\r\n\r\nWARC/1.1\r\n" * 9000), (1, "u", "same"), (None, "u", "same")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as first", "'x' as digest").repartition(3)
    manifest = warc.write_archives(pages, archive_bytes=200)
    assert manifest.agg(F.sum("n_records")).first()[0] == len(rows)
    got = warc.read_archives(manifest, with_payload=True).collect()
    texts = Counter((i, len((t or "").encode()), warc.base32_sha1((t or "").encode())) for i, _, t in rows)
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest) for r in got) == texts
    refers = {r.page_id: r.refers_to for r in got}
    assert refers == {3: None, 1: None, 9: 1, 2: 1, 4: None, 5: 4, 6: None, None: None}
    assert all((r.record_type == "revisit") == (r.refers_to is not None) == (r.payload is None) for r in got)
    assert {bytes(r.payload).decode() for r in got if r.page_id in (3, 6)} == {rows[0][2], rows[6][2]}
    small = warc.read_archives(warc.write_archives(pages, min_bytes=5)).collect()
    assert {r.record_type for r in small} == {"response"}
    assert warc.read_archives(warc.write_archives(pages.limit(0))).collect() == []


@pytest.mark.parametrize("most", [0, 1 << 18])
def test_warc_first_pages_with_and_without_broadcast(spark, monkeypatch, most):
    monkeypatch.setattr(warc, "MOST_REPEATED", most)
    html = [None, "", "hot"] * 40 + [f"own {i}" for i in range(30)] + ["twice"] * 2
    rows = [(i if i % 11 else None, "u", t) for i, t in enumerate(html)] + [(1, "u", "other text of page 1")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)
    for least in (0, 4):
        first: dict[str, int] = {}
        for i, _, t in rows:
            if i is not None and len(t or "") >= least:
                first[t or ""] = min(i, first.get(t or "", i))
        want = [(i, t or "", first.get(t or "") if i is not None and first.get(t or "") != i else None) for i, _, t in rows]
        found = warc.with_first_page(pages, "page_id", "html", least).collect()
        got = [(r.id, r.payload, r["first"] if r.id is not None and r["first"] != r.id else None) for r in found]
        assert Counter(got) == Counter(want)


def test_warc_payloads_stay_out_of_the_shuffle(spark):
    pages = spark.createDataFrame([(1, "u", "a"), (2, "u", "a")], "page_id long, url string, html string")
    plan = warc.with_first_page(pages, "page_id", "html", 0)._jdf.queryExecution().toString().partition("== Physical Plan ==")[2]
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan


def test_warc_reader_refuses_broken_archives():
    good = [warc.record_bytes(i, "u", b"payload %d" % i) for i in range(3)]
    pack = lambda records: b"".join(map(warc.gzip_member, records))
    read = lambda data: list(warc.read_records(io.BytesIO(data), chunk=7))
    assert [r.payload for r in read(pack(good))] == [b"payload 0", b"payload 1", b"payload 2"]
    broken = [
        pack([good[0].replace(b"payload 0", b"payload X")]),
        pack([good[0].replace(b"Content-Length: 9", b"Content-Length: 8")]),
        pack([good[0].replace(b"Content-Length: ", b"Content-Lengths: ")]),
        pack([good[0] + b"more"]),
        pack(good)[:-9],
    ]
    for data in broken:
        with pytest.raises(ValueError):
            read(data)


# --- URLs -----------------------------------------------------------------------

URLS = [
    None, "", "no scheme", "http://", "HTTP://WWW.Example.COM/en/x?q=/en/#f", "https://example.com/en/", "https://example.com", "http://a.example.com/en/a",
    "http://com/", "http://net/es/1", "http://x.net/es", "http://x.net/fr/?a", "http://notexample.com/en/", "http://É.com/é", "a://b://c/d", "http://x.com?y/z", "http://x.org#://", "http://x\n.com/\n?",
]


def judged_by_hand(url):
    rest = url.partition("://")[2] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h + p), h + p, a) for a, h, p in queries.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, max(fits)[1:] if fits else None


def test_rules(spark):
    df = spark.createDataFrame(list(enumerate([*URLS, "x" * 300_000 + "://h.net/es/"])), "page_id long, url string").selectExpr("*", "'x' as host", "'x' as rawPrediction")
    got = url_filter.judged(df, queries.RULES, None).collect()
    assert len(got) == len(URLS) + 1
    for r in got:
        host, path, rule = judged_by_hand(r.url)
        assert (r.host, r.path, r.rule, r.verdict) == (host, path, rule and rule[0], rule[1] if rule else "allow")
    assert url_filter.judged(df.limit(0), queries.RULES, None).collect() == []
    assert {r.rule for r in url_filter.judged(df, [], None).collect()} == {None}


def test_trees_on_held_out_urls(spark):
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet")
    labelled = queries.labelled_urls(pages)
    half = F.xxhash64("url") % 2 == 0
    model = url_filter.train(labelled.filter(half), max_rows=2000)
    rows = model.block(labelled.filter(~half), "url").select("bad", "_tl_block").collect()
    right = sum(r.bad == r._tl_block for r in rows) / len(rows)
    assert right >= 0.97
    assert sum(r._tl_block for r in rows if r.bad) >= 0.9 * sum(r.bad for r in rows)
    odd = spark.createDataFrame([(u,) for u in URLS], "url string")
    assert url_filter.judged(odd, queries.RULES, model).count() == len(URLS)
    assert url_filter.train(labelled.filter("bad")) is None
    assert url_filter.train(labelled.limit(0)) is None
