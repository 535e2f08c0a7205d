"""Benchmark decontamination: a BM25 index of the test items, searched by block-max WAND.

An index holds test items up to a size; more items take a pass over the texts for each
index. Every text is cut into overlapping passages, and every passage is a query: all
items are retrieved that score what an item scores at least wherever it can be verified.
Each is then verified in windows that depend on the item and the text only, by the share
of the question's and of the answer's word n-grams that a window holds. So the items
that share an index decide how fast a text is searched, and not what is found. Long items
are retrieved by stretches of equal length and verified whole, in the words around.

Items are kept in the order of the score they need and cut into blocks. Passages that
cannot reach any item of any block are ruled out for many passages at once: the block
maxima of their terms, added up, bound every score in the block, the bound that
block-max WAND tests. The others go through the postings with pivots and block maxima.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.llm import hashing
from touchline.llm.tables import staged

K1, B = 1.2, 0.75
BETWEEN = np.ones(256, bool)
BETWEEN[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
ITEM_WORDS = 256
BLOCK_ITEMS, MOST_BLOCKS = 8, 32
PASSAGES = 1024  # bounded at once
STRIDE = 32
GRAM = 3
#: Bytes of item texts in one index; the driver and the tasks hold one index at a time.
INDEX_BYTES = 32 << 20


def terms(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text) of the words of letters and digits, A-Z lower-cased."""
    data = hashing.LOWER[data]
    starts, ends, text = hashing.words(data, offsets, BETWEEN)
    return hashing.stretch_hashes(data, starts, ends), text


def span(n: int) -> int:
    """Words of the windows in which ``n`` words of an item are looked for."""
    return n + 2 * max(STRIDE, n // 4)


def _terms_of(text: str) -> np.ndarray:
    data = np.frombuffer(text.encode(), np.uint8)
    return terms(data, np.array([0, len(data)]))[0]


@dataclass
class Entry:
    """An item's terms, of which those from ``answer`` on belong to the answer. It is
    retrieved by the terms from ``first`` to ``last``, all of them by default."""

    item: int
    words: np.ndarray
    answer: int
    first: int = 0
    last: int | None = None

    @property
    def part(self) -> np.ndarray:
        return self.words[self.first : self.last]

    @property
    def whole(self) -> bool:
        return len(self.part) == len(self.words)

    def unneeded(self, weight: dict[int, float], overlap: float) -> float:
        """No less than the weight of the terms that a window may lack while it holds
        ``overlap`` of the n-grams of question and answer (for a stretch: of the stretch).
        Without a term all n-grams with it are gone, and an n-gram has at most n terms;
        so the terms fill a knapsack, and a share of one may fill its rest."""
        total = 0.0
        for words in (self.words[: self.answer], self.words[self.answer :]) if self.whole else (self.part,):
            n = min(GRAM, len(words))
            if n == 0:
                continue
            at = np.unique(hashing.windows(words, np.zeros(len(words), np.int64), n)[0], return_index=True)[1].tolist()
            grams = Counter(term for p in at for term in set(words[p : p + n].tolist()))
            gone = math.floor((1 - overlap) * len(at) + 1e-9)
            room = gone * n
            for term, size in sorted(grams.items(), key=lambda g: -weight[g[0]] / g[1]):
                if size <= gone and room > 0:
                    total += weight[term] * min(1.0, room / size)
                    room -= size
        return total


@dataclass
class Index:
    entries: list[Entry]
    vocabulary: np.ndarray = field(init=False)
    #: By block and term: entries, their scores, the highest of them.
    in_block: list[dict[int, tuple[list[int], list[float], float]]] = field(init=False)
    needed: list[float] = field(init=False)
    block: int = field(init=False)  # items of a block
    block_bounds: np.ndarray = field(init=False)  # highest impact by term (the last: unknown) and block
    block_needs: np.ndarray = field(init=False)

    def build(self, share: float, overlap: float = 0.8) -> Index:
        """An item needs ``share`` of its own best score, or less if a window that holds
        ``overlap`` of it can have less."""
        size = [len(e.part) for e in self.entries]
        mean = sum(size) / len(size)
        self.vocabulary = np.unique(np.concatenate([e.part for e in self.entries]))
        counts: dict[int, dict[int, int]] = defaultdict(dict)
        for i, e in enumerate(self.entries):
            ids, n = np.unique(np.searchsorted(self.vocabulary, e.part), return_counts=True)
            for term, tf in zip(ids.tolist(), n.tolist(), strict=True):
                counts[term][i] = tf
        total = len(self.entries)
        idf = [math.log(1 + (total - len(counts[t]) + 0.5) / (len(counts[t]) + 0.5)) for t in range(len(self.vocabulary))]
        impact = lambda t, i, tf: idf[t] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * size[i] / mean))
        weights: list[dict[int, float]] = [{} for _ in range(total)]
        for term, found in counts.items():
            for i, tf in found.items():
                weights[i][int(self.vocabulary[term])] = impact(term, i, tf)
        own = [sum(w.values()) for w in weights]
        needed = [min(share * o, o - e.unneeded(w, overlap)) for o, e, w in zip(own, self.entries, weights, strict=True)]
        order = sorted(range(total), key=lambda i: (needed[i], i))
        place = {i: p for p, i in enumerate(order)}
        self.needed = [needed[i] for i in order]
        self.block = max(BLOCK_ITEMS, -(-total // MOST_BLOCKS))
        n = -(-total // self.block)
        self.in_block = [{} for _ in range(n)]
        self.block_bounds = np.zeros((len(self.vocabulary) + 1, n), np.float32)
        for term in range(len(self.vocabulary)):
            for p, score in sorted((place[i], impact(term, i, tf)) for i, tf in counts[term].items()):
                entries, scores, best = self.in_block[p // self.block].get(term, ([], [], 0.0))
                self.in_block[p // self.block][term] = ([*entries, p], [*scores, score], max(best, score))
                self.block_bounds[term, p // self.block] = max(best, score)
        self.entries = [self.entries[i] for i in order]
        self.block_needs = np.array([min(self.needed[k * self.block : (k + 1) * self.block]) for k in range(n)])
        return self

    def search(self, query: list[int], block: int) -> list[tuple[int, float]]:
        """(entry, score) of the block's entries that reach what they need for a passage of
        these distinct terms: WAND over the block's postings in entry order, where a term's
        bound is its maximum in the block."""
        own = self.in_block[block]
        lists = [own[t] for t in query if t in own]
        least = self.block_needs[block] - 1e-9
        at = [0] * len(lists)
        live = list(range(len(lists)))
        out = []
        while live:
            live.sort(key=lambda i: lists[i][0][at[i]])
            bound, pivot = 0.0, -1
            for k, i in enumerate(live):
                bound += lists[i][2]
                if bound >= least:
                    pivot = k
                    break
            if pivot < 0:
                break
            target = lists[live[pivot]][0][at[live[pivot]]]
            while pivot + 1 < len(live) and lists[live[pivot + 1]][0][at[live[pivot + 1]]] == target:
                pivot += 1
            # Lists behind the pivot skip to it; once all stand there the entry is scored.
            beyond = target
            if lists[live[0]][0][at[live[0]]] == target:
                score = sum(lists[i][1][at[i]] for i in live[: pivot + 1])
                if score >= self.needed[target] - 1e-9:
                    out.append((target, score))
                beyond = target + 1
            for i in live[: pivot + 1]:
                entries, p = lists[i][0], at[i]
                while p < len(entries) and entries[p] < beyond:
                    p += 1
                at[i] = p
            live = [i for i in live if at[i] < len(lists[i][0])]
        return out


def _grams(words: np.ndarray, n: int) -> set[int]:
    n = min(n, len(words))
    if n == 0:
        return set()
    return set(hashing.windows(words, np.zeros(len(words), np.int64), n)[0].tolist())


def _share(part: np.ndarray, own: set[int], passage: np.ndarray) -> float:
    return len(own & _grams(passage, min(GRAM, len(part)) or GRAM)) / len(own) if own else 1.0


def overlaps(entry: Entry, passage: np.ndarray) -> tuple[float, float]:
    """Shares of the question's and the answer's word n-grams that the passage holds; a
    part without words is held wholly."""
    asked, answered = entry.words[: entry.answer], entry.words[entry.answer :]
    return _share(asked, _grams(asked, GRAM), passage), _share(answered, _grams(answered, GRAM), passage)


def n_parts(items: DataFrame) -> int:
    """How many indexes of about ``INDEX_BYTES`` of text each hold the items."""
    size = F.coalesce(F.octet_length("question"), F.lit(0)) + F.coalesce(F.octet_length("answer"), F.lit(0))
    return max(1, math.ceil((items.agg(F.sum(size)).first()[0] or 0) / INDEX_BYTES))


def index_of(items: DataFrame, k: int, n: int, share: float, overlap: float) -> Index | None:
    """The index over the ``k``-th of ``n`` parts of (``item_id``, ``question``,
    ``answer``), dealt by the hash of the id; null texts are empty and items without words
    are left out. Items of over ``ITEM_WORDS`` words are entered by stretches of equal
    length, more than half of that each."""
    rows = items.filter(F.pmod(F.xxhash64("item_id"), F.lit(n)) == k).select("item_id", "question", "answer").collect()
    entries = []
    for item, question, answer in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] or "", r[2] or "")):
        asked = _terms_of(question or "")
        found = np.concatenate([asked, _terms_of(answer or "")])
        parts = -(-len(found) // ITEM_WORDS)
        cuts = [len(found) * i // parts for i in range(parts + 1)] if parts else []
        entries += [Entry(item, found, len(asked), *cut) for cut in pairwise(cuts)]
    return Index(entries).build(share, overlap) if entries else None


def _reachable(index: Index, term: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """(passage, block) where the passage, ``first`` to ``last`` word, may reach an item of
    the block: the block maxima of its terms, each term once, add up to what the block's
    items need at least."""
    out = []
    for k in range(0, len(first), PASSAGES):
        a, b = first[k : k + PASSAGES], last[k : k + PASSAGES]
        start = int(a[0])
        own = term[start : int(b[-1])]
        a, b = a - start, b - start
        # Bounds with each occurrence counted are cheap and come first.
        sums = np.zeros((len(own) + 1, len(index.block_needs)))
        np.cumsum(index.block_bounds[own], axis=0, out=sums[1:])
        near = np.flatnonzero((sums[b] - sums[a] >= index.block_needs - 1e-3).any(1))
        if not len(near):
            continue
        order = np.argsort(own, kind="stable")
        previous = np.full(len(own), -1)
        same = own[order][1:] == own[order][:-1]
        previous[order[1:][same]] = order[:-1][same]
        for part in np.array_split(near, -(-len(near) // 128)):
            place = a[part][:, None] + np.arange(int((b[part] - a[part]).max()))
            inside = place < b[part][:, None]
            place = np.minimum(place, len(own) - 1)
            once = inside & (previous[place] < a[part][:, None])
            bounds = np.einsum("pw,pwb->pb", once.astype(np.float32), index.block_bounds[own[place]])
            passage, block = np.nonzero(bounds >= index.block_needs - 1e-3)
            out.append(np.stack([part[passage] + k, block], 1))
    return np.concatenate(out) if out else np.zeros((0, 2), np.int64)


def _surroundings(entry: Entry, a: int, begin: int, stop: int) -> tuple[int, int]:
    """The words, of the text from ``begin`` to ``stop``, that hold the whole item if its
    stretch is in the window from ``a`` on, with a quarter of the item's length to spare on
    both sides. They begin on a grid, so that the stretches of one copy share them."""
    size = len(entry.words)
    step = max(STRIDE, size // 4)
    at = begin + (a - begin - entry.first) // step * step
    return max(begin, at - step), min(stop, at + size + span(len(entry.part)) + 2 * step)


def _verified(entry: Entry, words: np.ndarray, a: int, begin: int, stop: int, overlap: float) -> tuple[float, float] | None:
    """Question and answer overlap in the window of the entry from ``a`` on, for a stretch
    that the window holds in the words around it; none if one is too low."""
    window = words[a : min(a + span(len(entry.part)), stop)]
    if not entry.whole:
        if _share(entry.part, _grams(entry.part, GRAM), window) < overlap:
            return None
        window = words[slice(*_surroundings(entry, a, begin, stop))]
    found = overlaps(entry, window)
    return found if min(found) >= overlap else None


def _hits(index: Index, data: np.ndarray, offsets: np.ndarray, overlap: float) -> dict[tuple[int, int], tuple[float, float, float]]:
    """(text, item): best score, and the question and answer overlap of the window with
    the most of both."""
    words, text = terms(data, offsets)
    out: dict[tuple[int, int], tuple[float, float, float]] = {}
    if not len(words):
        return out
    term = np.searchsorted(index.vocabulary, words)
    term[term == len(index.vocabulary)] = 0
    known = index.vocabulary[term] == words
    term = np.where(known, term, len(index.vocabulary))
    length = max(span(len(e.part)) for e in index.entries)
    begin = np.searchsorted(text, np.arange(len(offsets) - 1))
    stop = np.searchsorted(text, np.arange(len(offsets) - 1), "right")
    # Passages start every STRIDE words of a text, up to the one that reaches its end.
    n = np.where(stop > begin, np.maximum(0, -(-(stop - begin - length) // STRIDE)) + 1, 0)
    first = np.repeat(begin - STRIDE * (np.cumsum(n) - n), n) + STRIDE * np.arange(n.sum())
    last = np.minimum(first + length, np.repeat(stop, n))
    query, of = [], -1
    verified: dict[tuple[int, int], tuple[float, float] | None] = {}
    for p, block in _reachable(index, term, first, last).tolist():
        a, b = int(first[p]), int(last[p])
        lo, hi = int(begin[text[a]]), int(stop[text[a]])
        if p != of:
            query, of = np.unique(term[a:b][known[a:b]]).tolist(), p
        for i, score in index.search(query, block):
            entry = index.entries[i]
            size = span(len(entry.part))
            # The entry's windows start every STRIDE words too: all those in this passage.
            for at in range(a, max(a, b - size if b < hi else b - size + STRIDE - 1) + 1, STRIDE):
                if (i, at) not in verified:
                    verified[i, at] = _verified(entry, words, at, lo, hi, overlap)
                found = verified[i, at]
                if found:
                    key = (int(text[a]), entry.item)
                    best = out.get(key, (0.0, *found))
                    out[key] = (max(score, best[0]), *max(found, best[1:], key=lambda o: (sum(o), o)))
    return out


def contaminated(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    share: float = 0.6,
    overlap: float = 0.8,
) -> DataFrame:
    """A row per document and test item that it holds: id, ``item_id``, ``score`` (BM25 of
    the best passage among the items of one index, for a long item against the part of it
    found there), ``question_overlap`` and ``answer_overlap``, both over the whole item.

    A document holds an item if a window of it holds ``overlap`` of the word trigrams of
    the question and as many of the answer. Windows start every ``STRIDE`` words and are
    half as long again as the item, and 64 words longer at least. Of an item of over
    ``ITEM_WORDS`` words a window must hold that of a stretch, and the words around it that
    of the item. Which other items there are changes the score only.

    ``items`` has ``item_id`` (long), ``question`` and ``answer``. Null and empty texts
    hold nothing; a text of any length is searched whole. Items without words are never
    found. Repeated rows are reported each, items of equal text each. Without items or
    documents the result is empty. Other columns are not read. Where the items take several
    indexes, the rows found with each are written before the next is built.
    """
    schema = "id long, item_id long, score double, question_overlap double, answer_overlap double"
    source = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"))

    def found(index: Index | None) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches if index else ():
                texts = hashing.Texts(batch.column(1))
                for begin, end in texts.runs():
                    rows = [(*key, *hit) for key, hit in sorted(_hits(index, *texts.part(begin, end), overlap).items(), key=_by_key)]
                    ids = batch.column(0)[begin:end].take(pa.array([r[0] for r in rows], pa.int64()))
                    columns = [ids, *[pa.array([r[i] for r in rows], kind) for i, kind in ((1, pa.int64()), *((i, pa.float64()) for i in (2, 3, 4)))]]
                    yield pa.RecordBatch.from_arrays(columns, names=["id", "item_id", "score", "question_overlap", "answer_overlap"])

        return source.mapInArrow(run, schema).withColumnRenamed("id", id_col)

    n = n_parts(items)
    if n == 1:
        return found(index_of(items, 0, 1, share, overlap))
    return reduce(DataFrame.union, [staged(found(index_of(items, k, n, share, overlap)), "items-found") for k in range(n)])


def _by_key(hit) -> tuple:
    (text, item), _ = hit
    return text, item is None, item or 0


def clean(docs: DataFrame, items: DataFrame, text_col: str = "text", share: float = 0.6, overlap: float = 0.8) -> DataFrame:
    """The rows that hold no test item, as they came. Where the items take several indexes,
    the rows left by each are written before the next is built."""
    names = docs.columns

    def left(rows: DataFrame, index: Index | None) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                texts = hashing.Texts(batch.column(len(names)))
                for begin, end in texts.runs():
                    keep = np.ones(end - begin, bool)
                    for row, _ in _hits(index, *texts.part(begin, end), overlap) if index else ():
                        keep[row] = False
                    own = [batch.column(i)[begin:end].filter(pa.array(keep)) for i in range(len(names))]
                    yield pa.RecordBatch.from_arrays(own, names=names)

        source = rows.select(*[F.col(f"`{c}`") for c in names], F.col(f"`{text_col}`").alias("_tl_text"))
        return source.mapInArrow(run, docs.schema)

    n = n_parts(items)
    for k in range(n):
        docs = left(docs, index_of(items, k, n, share, overlap))
        if k < n - 1:
            docs = staged(docs, "items-left")
    return docs


def question_and_answer(items: DataFrame, text_col: str = "text") -> DataFrame:
    """(``item_id``, ``question``, ``answer``) of items that are one text: the last
    sentence is the answer, or the last quarter of the words of a single sentence."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    last = F.regexp_extract(text, r"(?s)^.*[.!?]\s+(\S.*)$", 1)
    words = F.split(F.trim(text), r"\s+")
    tail = F.array_join(F.slice(words, F.size(words) - F.floor(F.size(words) / 4).cast("int") + 1, F.greatest(F.floor(F.size(words) / 4).cast("int"), F.lit(0))), " ")
    answer = F.when(last != "", last).otherwise(tail)
    rows = items.select(F.col("item_id").cast("long").alias("item_id"), text.alias("t"), answer.alias("a"))
    return rows.selectExpr("item_id", "substring(t, 1, length(t) - length(a)) as question", "a as answer")
