"""Secret scans against plain Python, and the guess cost of known values."""

from __future__ import annotations

import hashlib
import re
import string
from math import log2

import pytest

from touchline.llm import secrets

ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
HEX = "0123456789abcdef" * 2


def plain_base(text):
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[1]) >= 6]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(found)


def as_text(spans):
    return ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in spans)


TEXTS = [
    None, "", " ", "PassWord = 'abc123-_./+='x", "ſecret=abcdefg secret=abcdefg toKen:abcdefg", "api_key:abcde apikey=abcdef api__key=abcdefg",
    f"é{HEX}é 🙂{HEX[:24]} {HEX[:23]} {HEX.upper()}", "AKIA" + "Z" * 16 + " AKIA" + "9" * 15 + " xAKIAAKIA" + "A0" * 9 + "é",
    f"token=token=token={HEX}", f'"secret" : "{HEX}"', "passwordpassword==abcdef", "token\t=abcdefg token=\nabcdefg", f"{HEX}" * 500,
    "é" * 3000 + "token: qX7vR2mK9p " * 40 + "🙂" * 50,
]


def test_patterns(documents):
    rows = [*enumerate(TEXTS), (3, "x"), (None, "token=abcdefgh")]
    docs = documents(rows, ["base", "values", "row", "found", "id", "_text"])
    got = secrets.secrets(docs).withColumn("spans", secrets.as_text("found")).collect()
    assert len(got) == len(rows)
    want = {(i, as_text(plain_base(t or ""))) for i, t in rows}
    seen = set()
    for r in got:
        base = [(s.start, s.kind, s.end) for s in r.found if s.kind < 3]
        assert hashlib.sha256(as_text(base).encode()).hexdigest() == r.base_sha256
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(k == n for _, k, _ in base) for n in range(3)]
        assert r.n_guess == sum(s.kind == 3 for s in r.found) and r.spans == as_text((s.start, s.kind, s.end) for s in r.found)
        assert [(s.start, s.kind) for s in r.found] == sorted((s.start, s.kind) for s in r.found)
        seen.add((r.doc_id, as_text(base)))
    assert seen == want
    assert secrets.secrets(documents([])).collect() == []
    assert [r.n_guess for r in secrets.secrets(documents([(1, "no value"), (2, None)])).collect()] == [0, 0]


def test_words_of_the_corpus_make_a_value_cheap(documents):
    prose = "the umbrella of the élan lies under a mountain " * 300
    values = {
        "umbrellaMountain": False, "Umbre11a-élan": False, "qzxwvkjhgfpm": True, "rT7#kQ2!vX9m": True,
        "qwertyuiop12": False, "aaaaaaaaaaaaaaaa": False, "1987-03-21": False, "abcdefghijkl": False,
        "hiddenhidden7Rq": True,  # its words are in values only
    }
    contexts = ["DB_PASSWD={}", "passphrase => '{}' ", "Authorization: Bearer {}\n", 'private-key := "{}", '] * 3
    rows = [(i, f"é {c.format(v)}.") if "'" not in c else (i, c.format(v)) for i, (v, c) in enumerate(zip(values, contexts))]
    found = {r.doc_id: r for r in secrets.secrets(documents([*rows, (100, prose), (101, "secret: hidden_x, token= hiddenhidden")])).collect()}
    for (i, text), (value, costly) in zip(rows, values.items()):
        spans = [text[s.start : s.end].rstrip(".") for s in found[i].found if s.kind == 3]
        assert spans == ([value] if costly else []), value
    # without the prose the same words are dear
    alone = {r.doc_id: r.n_guess for r in secrets.secrets(documents(rows)).collect()}
    assert alone[0] == 1


def plain_bits(value, word_bits):
    """The same segments, by recursion over all cuts."""
    low, plain, single = value.translate(secrets.LOWERED), value.translate(secrets.LOWERED).translate(secrets.LEET), secrets.alphabet_bits(value)
    memo = {len(value): 0.0}
    for i in range(len(value) - 1, -1, -1):
        costs = [single + memo[i + 1]]
        for end in range(i + 3, min(len(value), i + 20) + 1):
            for text in {low[i:end], plain[i:end]}:
                if text in word_bits:
                    swaps = len({a for a, b in zip(low[i:end], text) if a != b})
                    costs.append(1 + word_bits[text] + swaps + secrets._case_bits(value[i:end]) + memo[end])
        for end, bits in [*secrets._date_ends(value, i), *secrets._walk_ends(low, i)]:
            costs.append(1 + bits + memo[end])
        for step in (1, 2, 3, 4):
            times = 1
            while value[i : i + step] == value[i + times * step : i + (times + 1) * step] and len(value[i : i + step]) == step:
                times += 1
            if times >= 3 or (times == 2 and step > 2):
                costs.append(1 + step * single + log2(times) + memo[i + times * step])
        memo[i] = min(costs)
    return memo[0]


VALUES = [
    "x", "password1987", "P@ssw0rd", "aaaaaaaaaaaa", "abababab7", "qwerty", "zxcvbnm,./", "2019-12-31x", "31122019", "abcabcabc", "987654",
    "MONKEYmonkey", "é🙂é🙂é🙂", "1q2w3e4r5t", string.ascii_letters, "a" * 500, "k9$Zp!7w" * 30,
]


@pytest.mark.parametrize("value", VALUES)
def test_least_cost_segmentation(value):
    word_bits = {"password": 5.0, "pass": 7.0, "word": 6.0, "monkey": 9.0, "key": 4.0}
    assert secrets.guess_bits(value, word_bits) == pytest.approx(plain_bits(value, word_bits))


def test_costs_are_in_order():
    words = {"password": 5.0}
    bits = [secrets.guess_bits(v, words) for v in ("password", "Password", "P4ssword", "P4ssword1987", "P4sswordk7Zq", "x8Kq#vPz!m3T")]
    assert bits == sorted(bits) and bits[0] < 7 and bits[2] < secrets.LIMIT_BITS < bits[-1]
    assert secrets.guess_bits("a" * 40, {}) < secrets.guess_bits("a" * 4 + "kqzx", {})
    assert secrets.guess_bits("24121985", {}) < secrets.guess_bits("24821385", {})
    assert len(VALUES[-1]) == 240 and secrets.guess_bits("k9$Zp!7w", {}) > secrets.LIMIT_BITS
