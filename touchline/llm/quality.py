"""Quality rules: counts per text, and line labels from a linear-chain CRF.

Every line with a word gets features of its shape. A conditional random field over the
lines of a text, decoded by Viterbi, labels each as content or boilerplate; the text is
kept if enough of its characters lie in content lines.

The field is trained from documents with a quality label, whose lines all take that
label: the features then learn what lines of poor documents look like, and the
transitions that neighbours mostly agree.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from touchline.llm import hashing

SYMBOLS = np.zeros(256, bool)
SYMBOLS[[ord(c) for c in "#*$%&|<>"]] = True
DIGITS = np.zeros(256, bool)
DIGITS[48:58] = True
UPPER = np.zeros(256, bool)
UPPER[65:91] = True
FEATURES = [
    "bias", "symbols>.02", "symbols>.1", "symbols>.3", "pipes>.2", "upper>.3", "upper>.6", "bangs>.3",
    "stutter>.1", "stutter>.4", "words<3", "words<6", "words>15", "copy of a line", "digits>.2",
    "digits>.5", "long words", "short words",
]
SLICE = 1 << 17  # words or lines looked at together
FACTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


@dataclass
class Field:
    """Weights of content against boilerplate for the features, of the first label and
    of the steps from label to label (0 boilerplate, 1 content)."""

    weights: np.ndarray
    first: np.ndarray
    steps: np.ndarray

    @classmethod
    def neutral(cls) -> Field:
        """Without anything learned every line is content."""
        weights = np.zeros(len(FEATURES))
        weights[0] = 1.0
        return cls(weights, np.zeros(2), np.zeros((2, 2)))


def described(data: np.ndarray, offsets: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """Facts per text; and for the lines with a word their features, code points and text.

    Memory is some bytes per byte and some 50 per word: characters are added up by line,
    words are hashed and compared a slice at a time."""
    n = len(offsets) - 1
    starts, ends, text = hashing.words(data, offsets)
    text = text.astype(np.int32)
    each = _hashes(data, starts, ends)
    del ends

    # Lines.
    breaks = np.unique(np.concatenate([offsets, np.flatnonzero(data == 10) + 1]))
    at = np.searchsorted(breaks, starts, "right") - 1
    del starts
    first_word = np.flatnonzero(np.concatenate([at[:1] >= 0, at[1:] != at[:-1]]))
    line, owner = at[first_word], text[first_word]
    words_in = np.diff(first_word, append=len(at))
    begin, end = breaks[line], breaks[np.minimum(line + 1, len(breaks) - 1)]
    end = end - (data[np.maximum(end - 1, 0)] == 10) if len(data) else end
    counts = {name: _line_sums(data, of, begin, end) for name, of in CHARACTERS.items()}
    copies = _seen_before(owner, _hashes(data, begin, end))

    # Words in windows of five that occur twice or more in their text.
    covered = np.zeros(len(each), bool)
    twice = _repeated_windows(each, text, 5)
    for i in range(5 if len(twice) else 0):
        covered[i : i + len(twice)] |= twice
    total = lambda of, values: np.bincount(of, values, n).astype(np.int64)
    facts = {
        "n_words": np.bincount(text, minlength=n),
        # Space is in no line's count, and a line without a word is all space.
        "word_chars": total(owner, counts["points"]),
        "n_symbols": total(owner, counts["symbols"]),
        "n_dup_lines": np.bincount(owner[copies], minlength=n),
        "n_repeat_words": np.bincount(text[covered], minlength=n),
    }

    points = counts["points"]
    stutter = np.zeros(len(line))
    if len(each) > 1:
        twin = np.concatenate([[False], (each[1:] == each[:-1]) & (at[1:] == at[:-1])])
        stutter = np.add.reduceat(twin, first_word, dtype=np.int64) / words_in
    ratio = {name: counts[name] / np.maximum(points, 1) for name in ("symbols", "digits", "upper")}
    per_word = {name: counts[name] / words_in for name in ("pipes", "bangs")}
    mean = points / np.maximum(words_in, 1)
    features = np.stack(
        [
            np.ones(len(line), bool),
            ratio["symbols"] > 0.02, ratio["symbols"] > 0.1, ratio["symbols"] > 0.3, per_word["pipes"] > 0.2,
            ratio["upper"] > 0.3, ratio["upper"] > 0.6, per_word["bangs"] > 0.3, stutter > 0.1, stutter > 0.4,
            words_in < 3, words_in < 6, words_in > 15, copies, ratio["digits"] > 0.2,
            ratio["digits"] > 0.5, mean > 12, mean < 2.5,
        ],
        1,
    )
    return facts, features, points, owner


def _hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """``hashing.stretch_hashes`` a slice of the stretches at a time."""
    out = np.empty(len(starts), np.uint64)
    for i in range(0, len(starts), SLICE):
        a, b = starts[i : i + SLICE], ends[i : i + SLICE]
        out[i : i + SLICE] = hashing.stretch_hashes(data[a[0] : b[-1]], a - a[0], b - a[0])
    return out


def _line_sums(data: np.ndarray, mask, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """How often ``mask`` holds in each ``data[begin:end]``, ascending; from prefix sums of
    a slice of the bytes at a time. A mask may look one byte ahead."""
    edges = np.stack([begin, end], 1).ravel()
    out = np.empty(len(edges), np.int64)
    carry = 0
    for first in range(0, len(data) + 1, SLICE):
        sums = np.zeros(min(SLICE, len(data) - first) + 1, np.int64)
        np.cumsum(mask(data[first : first + SLICE + 1])[:SLICE], out=sums[1:])
        lo, hi = np.searchsorted(edges, [first, first + SLICE])
        out[lo:hi] = sums[edges[lo:hi] - first] + carry
        carry += int(sums[-1])
    return out[1::2] - out[::2]


def _repeated_windows(each: np.ndarray, text: np.ndarray, size: int) -> np.ndarray:
    """For each place whether the window of ``size`` words from there on lies within a
    text and occurs in it elsewhere too."""
    n = max(0, len(each) - size + 1)
    keys, whole, twice = np.empty(n, np.uint64), np.empty(n, bool), np.zeros(n, bool)
    slices = [slice(i, min(i + SLICE, n)) for i in range(0, n, SLICE)]
    for part in slices:
        own, later = text[part], text[part.start + size - 1 : part.stop + size - 1]
        total = hashing.mix(own.astype(np.uint64) + np.uint64(1))
        for i in range(size):
            total += each[part.start + i : part.stop + i] * hashing.PLACE[i]
        keys[part], whole[part] = hashing.mix(total), own == later
    ordered = np.sort(keys[whole])
    more = ordered[1:][ordered[1:] == ordered[:-1]]
    del ordered
    if len(more):
        for part in slices:
            at = np.minimum(np.searchsorted(more, keys[part]), len(more) - 1)
            twice[part] = (more[at] == keys[part]) & whole[part]
    return twice


def _latin_upper(data: np.ndarray) -> np.ndarray:
    out = np.zeros(len(data), bool)
    out[:-1] = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E)
    return out


#: Masks of the bytes that count for a line; upper-case letters are those of one byte and
#: those of Latin-1 in two.
CHARACTERS = {
    "points": lambda data: ((data & 0xC0) != 0x80) & ~hashing.SPACE[data],
    "symbols": lambda data: SYMBOLS[data],
    "pipes": lambda data: data == ord("|"),
    "bangs": lambda data: data == ord("!"),
    "digits": lambda data: DIGITS[data],
    "upper": lambda data: UPPER[data] | _latin_upper(data),
}


def _seen_before(owner: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Whether the same key occurs earlier with the same owner."""
    out = np.zeros(len(key), bool)
    if len(key):
        order = np.lexsort((np.arange(len(key)), key, owner))
        out[order[1:]] = (key[order][1:] == key[order][:-1]) & (owner[order][1:] == owner[order][:-1])
    return out


def viterbi(scores: np.ndarray, field: Field) -> np.ndarray:
    """The most likely labels of lines with these scores for content over boilerplate;
    ties go to content. A byte per line holds where its two labels come from."""
    (s00, s01), (s10, s11) = field.steps.tolist()
    best0, best1 = 0.0, 0.0
    back = np.zeros(len(scores), np.uint8)
    for i in range(0, len(scores), SLICE):
        came = bytearray()
        for score in scores[i : i + SLICE].tolist():
            if i == 0 and not came:
                best0, best1 = field.first.tolist()
                best1 += score
                came.append(0)
                continue
            stay0, from1 = best0 + s00, best1 + s10
            from0, stay1 = best0 + s01, best1 + s11
            came.append((from1 >= stay0) + 2 * (stay1 >= from0))
            best0, best1 = max(stay0, from1), max(from0, stay1) + score
        back[i : i + SLICE] = np.frombuffer(came, np.uint8)
    label = int(best1 >= best0)
    out = np.zeros(len(scores), np.uint8)
    for stop in range(len(scores), 0, -SLICE):
        begin = max(0, stop - SLICE)
        labels = bytearray()
        for pair in back[begin:stop][::-1].tobytes():
            labels.append(label)
            label = pair >> label & 1
        out[begin:stop] = np.frombuffer(labels, np.uint8)[::-1]
    return out


def trained(sequences: list[tuple[np.ndarray, int]], rounds: int = 120, rate: float = 0.5, ridge: float = 1e-3) -> Field:
    """Maximum likelihood by gradient steps. Each sequence is a feature matrix and the
    label of all its lines; sequences are cut at 64 lines. Both labels weigh the same in
    total. Neutral if a label is missing."""
    cut = [(m[i : i + 64], label) for m, label in sequences for i in range(0, len(m), 64)]
    if len({label for _, label in cut}) < 2:
        return Field.neutral()
    size = np.array([len(m) for m, _ in cut])
    label = np.array([y for _, y in cut])
    x = np.zeros((len(cut), size.max(), len(FEATURES)), np.float32)
    for i, (m, _) in enumerate(cut):
        x[i, : len(m)] = m
    real = np.arange(size.max()) < size[:, None]
    lines = np.array([size[label == y].sum() for y in (0, 1)])
    heavy = (size.sum() / 2 / lines)[label] / size.sum()
    field = Field(np.zeros(len(FEATURES)), np.zeros(2), np.zeros((2, 2)))
    seen = [np.zeros_like(p) for p in (field.weights, field.first, field.steps)]
    for _ in range(rounds):
        unary = np.stack([np.zeros(real.shape), x @ field.weights], 2)
        alpha, beta = np.zeros_like(unary), np.zeros_like(unary)
        alpha[:, 0] = field.first + unary[:, 0]
        for t in range(1, unary.shape[1]):
            step = np.logaddexp.reduce(alpha[:, t - 1, :, None] + field.steps, axis=1) + unary[:, t]
            alpha[:, t] = np.where(real[:, t, None], step, alpha[:, t - 1])
        for t in range(unary.shape[1] - 2, -1, -1):
            step = np.logaddexp.reduce(field.steps + (unary[:, t + 1] + beta[:, t + 1])[:, None, :], axis=2)
            beta[:, t] = np.where(real[:, t + 1, None], step, 0)
        total = np.logaddexp.reduce(alpha[:, -1], axis=1)
        belief = np.exp(alpha + beta - total[:, None, None]) * real[:, :, None]
        target = np.zeros_like(belief)
        target[np.arange(len(cut)), :, label] = real
        miss = (target - belief) * heavy[:, None, None]
        pair = np.exp(
            alpha[:, :-1, :, None] + field.steps + (unary[:, 1:] + beta[:, 1:])[:, :, None, :] - total[:, None, None, None]
        ) * real[:, 1:, None, None]
        steps = -(pair * heavy[:, None, None, None]).sum((0, 1))
        for y in (0, 1):
            steps[y, y] += (heavy * (size - 1))[label == y].sum()
        grads = (
            np.einsum("nt,ntf->f", miss[:, :, 1], x) - ridge * field.weights,
            miss[:, 0].sum(0) - ridge * field.first,
            steps - ridge * field.steps,
        )
        for value, grad, past in zip((field.weights, field.first, field.steps), grads, seen, strict=True):
            past += grad * grad
            value += rate * grad / (np.sqrt(past) + 1e-9)
    return field


def train(docs: DataFrame, labels: DataFrame, max_docs: int = 1500, max_bytes: int = 20_000) -> Field:
    """The field from documents (``doc_id``, ``text``) with a ``quality`` of 0 or 1 in
    ``labels``: of each label at most ``max_docs`` of at most ``max_bytes``, chosen by the
    hash of their id. Only features reach the driver. An id with both labels is left out."""
    short = docs.filter(F.octet_length("text") <= max_bytes)
    known = (
        labels.filter("quality in (0, 1)")
        .groupBy("doc_id")
        .agg(F.min("quality").alias("quality"), F.max("quality").alias("most"))
        .filter("quality = most")
        .join(short.select("doc_id"), "doc_id", "left_semi")
    )
    chosen = [
        known.filter(f"quality = {y}").orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_docs).select("doc_id", "quality")
        for y in (0, 1)
    ]
    # At most 2 * max_docs ids, so the small side of this join is bounded.
    sample = short.select("doc_id", "text").join(F.broadcast(chosen[0].union(chosen[1])), "doc_id")
    sample = sample.select("doc_id", "text", F.col("quality").cast("int").alias("quality"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = hashing.Texts(batch.column(1))
            for begin, end in texts.runs():
                _, features, _, owner = described(*texts.part(begin, end))
                cuts = np.searchsorted(owner, np.arange(end - begin + 1))
                packed = [np.packbits(features[a:b]).tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[begin:end], batch.column(2)[begin:end], pa.array(np.diff(cuts), pa.int32()), pa.array(packed, pa.binary())],
                    names=["doc_id", "quality", "lines", "features"],
                )

    rows = sorted(sample.mapInArrow(run, "doc_id long, quality int, lines int, features binary").collect())
    wide = len(FEATURES)
    unpacked = [
        (np.unpackbits(np.frombuffer(r.features, np.uint8))[: r.lines * wide].reshape(r.lines, wide), r.quality)
        for r in rows
        if r.lines
    ]
    return trained(unpacked)


def with_quality(
    docs: DataFrame,
    field: Field,
    text_col: str = "text",
    keep: list[str] | None = None,
    min_words: int = 10,
    max_repeat_percent: int = 20,
    min_content: float = 0.5,
    only_kept: bool = False,
) -> DataFrame:
    """The rows (columns ``keep``, default all) with ``n_words``, ``word_chars``,
    ``n_symbols``, ``n_dup_lines``, ``n_repeat_words``, ``base_failed``,
    ``content_share`` and ``kept``; with ``only_kept`` just the rows that are kept, as
    they came.

    A null text counts as empty; an empty or blank text has no words and fails the base
    rules. ``content_share`` is the share of the characters in words that lie in content
    lines, 0 without words. A text of any length is judged whole, by itself; its task then
    needs about 12 times its bytes with words of five bytes, and up to 60 times where
    words have one letter and lines two words. Each row is judged alone, so ties and repeated rows are judged
    alike. Columns of the input named like the new ones are replaced, unless
    ``only_kept``. An empty table gives an empty result.
    """
    new = T.StructType(
        [T.StructField(c, T.LongType()) for c in FACTS]
        + [T.StructField("base_failed", T.BooleanType()), T.StructField("content_share", T.DoubleType()), T.StructField("kept", T.BooleanType())]
    )
    names = [c for c in (docs.columns if keep is None else keep) if only_kept or c not in new.names]
    source = docs.select(*[F.col(f"`{c}`") for c in names], F.col(f"`{text_col}`").alias("_tl_text"))
    fields = [docs.schema[c] for c in names]
    schema = T.StructType(fields if only_kept else fields + new.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = hashing.Texts(batch.column(len(names)))
            for begin, end in texts.runs():
                facts, features, points, owner = described(*texts.part(begin, end))
                scores = np.concatenate([features[i : i + SLICE] @ field.weights for i in range(0, max(1, len(features)), SLICE)])
                cuts = np.searchsorted(owner, np.arange(end - begin + 1))
                share = np.zeros(end - begin)
                for i, (a, b) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)):
                    if b > a:
                        marks = viterbi(scores[a:b], field) == 1
                        share[i] = points[a:b][marks].sum() / points[a:b].sum()
                failed = (facts["n_words"] < min_words) | (
                    100 * facts["n_repeat_words"] > max_repeat_percent * facts["n_words"]
                )
                kept = ~failed & (share >= min_content)
                own = [batch.column(i)[begin:end] for i in range(len(names))]
                if only_kept:
                    yield pa.RecordBatch.from_arrays([c.filter(pa.array(kept)) for c in own], names=names)
                    continue
                own += [pa.array(facts[c], pa.int64()) for c in FACTS]
                own += [pa.array(failed), pa.array(share), pa.array(kept)]
                yield pa.RecordBatch.from_arrays(own, names=[*names, *new.names])

    return source.mapInArrow(run, schema)
