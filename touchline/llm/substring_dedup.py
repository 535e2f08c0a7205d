"""Repeated substrings removed by a hash-compared suffix sort.

A byte is removed if a string of ``length`` bytes that covers it also starts in a
document with a smaller id. All such strings ("windows") of a corpus are too many to
be moved, so they are found through anchors: a window's anchor is the smallest hashed
``anchor``-byte string in it, which equal windows share at the same place. A document
has one anchor for about every sixteen bytes.

1. Documents are dealt to blocks of bounded size; a block tells the different anchors
   it has. Only anchors of two or more documents go on.
2. For those, a block sends the stretch of text around each anchor, once for equal
   stretches of several of its documents, so text that every document has costs one
   stretch per block.
3. The stretches of an anchor from all blocks are suffix-sorted, from the anchor on and
   back from it: merge sorts, vectorised over all anchors of a task, whose comparisons
   find the common extension of two suffixes by binary search over prefix polynomial
   hashes. Neighbours' order and common bytes are verified byte by byte. These lengths
   tell which windows are equal; those not of the smallest document are marked.
4. The blocks join the marks with their texts.

Only strings around shared anchors are ever shuffled besides the texts themselves.
"""

from __future__ import annotations

import math
from os.path import commonprefix

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.llm import hashing

LAST_ID = np.iinfo(np.int64).max  # stands for a null id, behind all others
CHUNK_WINDOWS = 1 << 20
CODEC = "zstd"  # stretches overlap; the shuffle's own compression finds less of it
_HEAD = np.dtype([("anchor", "<u8"), ("id", "<i8"), ("at", "<i4"), ("before", "u1"), ("windows", "u1")])


class Block:
    """The texts of a block in the order of (id, text), as one run of bytes, and their
    stretches: consecutive windows (first to last start) that share their anchor."""

    def __init__(self, table: pa.Table, length: int, anchor: int):
        table = table.sort_by([("id", "ascending"), ("text", "ascending")]).combine_chunks()
        column = table.column("text")
        column = column.chunk(0) if column.num_chunks else pa.array([], pa.string())
        texts = hashing.Texts(column)
        self.ids = table.column("id")
        self.data, self.offsets = texts.data, texts.offsets
        self.id_of = self.ids.fill_null(LAST_ID).to_numpy().astype(np.int64)
        self.length = length
        parts = list(self._stretches(length, anchor))
        self.first, self.last, self.place, self.anchor = (
            np.concatenate([p[i] for p in parts]) if parts else np.zeros(0, np.uint64 if i == 3 else np.int64) for i in range(4)
        )
        self.doc = np.searchsorted(self.offsets, self.first, "right") - 1
        self.id = self.id_of[self.doc] if len(self.doc) else np.zeros(0, np.int64)

    def _stretches(self, length: int, k: int):
        n = len(self.data)
        whole = np.ones(n, bool)
        for a, b in zip(self.offsets[:-1].tolist(), self.offsets[1:].tolist(), strict=True):
            whole[max(a, b - length + 1) : b] = False
        wide = length - k + 1
        for begin in range(0, n - length + 1, hashing.SLICE // 2):
            end = min(begin + hashing.SLICE // 2, n - length + 1)
            part = self.data[begin : end + length - 1]
            sums = np.zeros(len(part) + 1, np.uint64)
            np.cumsum(hashing.BYTE[part] * hashing.POWER[: len(part)], out=sums[1:])
            best = hashing.mix((sums[k:] - sums[:-k]) * hashing.POWER_BACK[: len(part) - k + 1])
            # The low six bits count how far into the window the smallest hash lies.
            best &= ~np.uint64(63)
            step = 1
            while 2 * step <= wide:
                best = np.minimum(best[:-step], best[step:] + np.uint64(step))
                step *= 2
            if rest := wide - step:
                best = np.minimum(best[:-rest], best[rest:] + np.uint64(rest))
            start = np.flatnonzero(whole[begin:end])
            if not len(start):
                continue
            best = best[start]
            start = start + begin
            place = start + (best & np.uint64(63)).astype(np.int64)
            new = np.ones(len(start), bool)
            new[1:] = (place[1:] != place[:-1]) | (start[1:] != start[:-1] + 1)
            at = np.flatnonzero(new)
            to = np.append(at[1:], len(start)) - 1
            yield start[at], start[to], place[at], best[at] >> np.uint64(6)

    def shared_here(self) -> tuple[np.ndarray, np.ndarray]:
        """The different anchors, and which of them several documents have."""
        order = np.argsort(self.anchor, kind="stable")
        anchor, ids = self.anchor[order], self.id[order]
        if not len(anchor):
            return anchor, np.zeros(0, bool)
        at = np.flatnonzero(np.append(True, anchor[1:] != anchor[:-1]))
        return anchor[at], np.minimum.reduceat(ids, at) != np.maximum.reduceat(ids, at)

    def repeats(self) -> np.ndarray:
        """Stretches equal to one of a document of the block with a smaller id."""
        out = np.zeros(len(self.first), bool)
        if len(self.first) < 2:
            return out
        end = self.last + self.length
        size = (end - self.first).astype(np.uint64)
        key = hashing.stretch_hashes(self.data, self.first, end) + hashing.mix(
            self.anchor * np.uint64(64) + (self.place - self.first).astype(np.uint64)
        ) + size
        order = np.argsort(key, kind="stable")
        same = np.append(False, key[order][1:] == key[order][:-1])
        leader = np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))
        mine, other = order[same], order[leader[same]]
        likely = (self.id[mine] > self.id[other]) & (size[mine] == size[other])
        mine, other = mine[likely], other[likely]
        for begin in range(0, len(mine), 1 << 14):
            m, o = mine[begin : begin + (1 << 14)], other[begin : begin + (1 << 14)]
            n = size[m].astype(np.int64)
            equal = self.data[_ranges(self.first[m], n)] == self.data[_ranges(self.first[o], n)]
            out[m] = np.logical_and.reduceat(equal, np.cumsum(n) - n)
        return out


def _own_anchors(block: Block, number: int, buckets: int) -> pa.Table:
    anchor, several = block.shared_here()
    bucket = (anchor % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
    rows = []
    for k in np.flatnonzero(np.diff(cuts)).tolist():
        part = order[cuts[k] : cuts[k + 1]]
        rows.append((k, number, anchor[part[~several[part]]].tobytes(), anchor[part[several[part]]].tobytes()))
    names, kinds = ["bucket", "block", "single", "several"], [pa.int64(), pa.int64(), pa.binary(), pa.binary()]
    return pa.table([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], names=names)


def _shared_anchors(rows: pa.Table) -> pa.Table:
    single = [np.frombuffer(x, np.uint64) for x in rows.column("single").to_pylist()]
    several = [np.frombuffer(x, np.uint64) for x in rows.column("several").to_pylist()]
    every = np.sort(np.concatenate(single + several))
    shared = np.unique(np.concatenate([every[1:][every[1:] == every[:-1]], *several]))
    if not len(shared):
        return pa.table({"block": pa.array([], pa.int64()), "anchors": pa.array([], pa.binary())})
    out = []
    for a, b in zip(single, several, strict=True):
        at = np.minimum(np.searchsorted(shared, a), len(shared) - 1)
        out.append(np.concatenate([a[shared[at] == a], b]).tobytes())
    return pa.table({"block": rows.column("block"), "anchors": pa.array(out, pa.binary())})


def _stretches_to_sort(block: Block, number: int, shared: np.ndarray, buckets: int) -> pa.Table:
    shared = np.sort(shared)
    if len(shared) and len(block.anchor):
        at = np.minimum(np.searchsorted(shared, block.anchor), len(shared) - 1)
        chosen = np.flatnonzero((shared[at] == block.anchor) & ~block.repeats())
    else:
        chosen = np.zeros(0, np.int64)
    head = np.zeros(len(chosen), _HEAD)
    head["anchor"], head["id"], head["at"] = block.anchor[chosen], block.id[chosen], block.first[chosen]
    head["before"] = block.place[chosen] - block.first[chosen]
    head["windows"] = block.last[chosen] - block.first[chosen] + 1
    bucket = ((head["anchor"] >> np.uint64(20)) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
    size = head["windows"].astype(np.int64) + block.length - 1
    rows = []
    for k in np.flatnonzero(np.diff(cuts)).tolist():
        part = order[cuts[k] : cuts[k + 1]]
        text = block.data[_ranges(block.first[chosen[part]], size[part])]
        rows.append((k, number, head[part].tobytes(), pa.compress(text, CODEC, asbytes=True)))
    names, kinds = ["bucket", "block", "heads", "bytes"], [pa.int64(), pa.int64(), pa.binary(), pa.binary()]
    return pa.table([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], names=names)


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each range, one after the other."""
    total = int(size.sum())
    first = np.cumsum(size) - size
    return np.repeat(start - first, size) + np.arange(total)


class Suffixes:
    """Strings of at most ``length`` bytes that run from a place of ``data`` on, or back from
    it (the byte before the place first), compared by prefix polynomial hashes."""

    def __init__(self, data: np.ndarray, length: int):
        self.data, self.length = data, length
        n = len(data) + 1
        power = np.full(n, hashing.BASE, np.uint64)
        self.back = np.full(n, hashing.INVERSE, np.uint64)
        power[0] = self.back[0] = 1
        power, self.back = np.cumprod(power, dtype=np.uint64), np.cumprod(self.back, dtype=np.uint64)
        self.sums = np.zeros(n, np.uint64)
        np.cumsum(hashing.BYTE[data] * power[:-1], out=self.sums[1:])

    def hash(self, at: np.ndarray, size) -> np.ndarray:
        return (self.sums[at + size] - self.sums[at]) * self.back[at]

    def common(self, a: np.ndarray, b: np.ndarray, most: np.ndarray, back: bool) -> np.ndarray:
        """Length of the common extension of the strings at ``a`` and ``b``, up to ``most``, by
        binary search."""
        low, high = np.zeros(len(a), np.int64), most.copy()
        for _ in range(self.length.bit_length()):
            middle = (low + high + 1) // 2
            if back:
                same = self.hash(a - middle, middle) == self.hash(b - middle, middle)
            else:
                same = self.hash(a, middle) == self.hash(b, middle)
            low = np.where(same, middle, low)
            high = np.where(same, high, middle - 1)
        return low

    def following(self, at: np.ndarray, n: np.ndarray, back: bool) -> np.ndarray:
        """The byte after the first ``n`` of each string; any byte where it ends there."""
        return self.data[np.clip(at - n - 1 if back else at + n, 0, len(self.data) - 1)]

    def less(self, a, reach_a, b, reach_b, or_equal: np.ndarray, back: bool) -> np.ndarray:
        """Whether the strings at ``a`` sort before those at ``b``; equal ones answer
        ``or_equal``."""
        most = np.minimum(reach_a, reach_b)
        size = self.common(a, b, most, back)
        ended = np.where(reach_a == reach_b, or_equal, reach_a < reach_b)
        return np.where(size == most, ended, self.following(a, size, back) < self.following(b, size, back))

    def sort(self, at: np.ndarray, reach: np.ndarray, group_start: np.ndarray, group_size: np.ndarray, back: bool) -> np.ndarray:
        """Order that sorts the strings ``at``, of ``reach`` bytes, within their groups:
        bottom-up merge sort of all groups at once, where an element's place in a merge is its
        place in its own run plus the number of elements of the sibling run that come before it."""
        order = np.arange(len(at))
        run = 1
        largest = int(group_size.max(initial=0))
        while run < largest:
            live = np.flatnonzero(group_size > run)
            where = _ranges(group_start[live], group_size[live])
            base, size = np.repeat(group_start[live], group_size[live]), np.repeat(group_size[live], group_size[live])
            inner = where - base
            mine = inner // run
            right = mine % 2 == 1
            sibling = np.minimum((mine ^ 1) * run, size)
            low, high = np.zeros(len(where), np.int64), np.minimum(sibling + run, size) - sibling
            own = order[where]
            while len(todo := np.flatnonzero(low < high)):
                middle = (low[todo] + high[todo]) // 2
                other, self_ = order[base[todo] + sibling[todo] + middle], own[todo]
                # A left element counts smaller ones of the right run, a right one also equal ones.
                before = self.less(at[other], reach[other], at[self_], reach[self_], right[todo], back)
                low[todo] = np.where(before, middle + 1, low[todo])
                high[todo] = np.where(before, high[todo], middle)
            target = base + (mine // 2) * 2 * run + (inner - mine * run) + low
            order[target] = order[where]
            run *= 2
        return order

    def verified(self, at: np.ndarray, reach: np.ndarray, shared: np.ndarray, back: bool) -> bool:
        """Whether, byte by byte, each string but the first of a group has exactly ``shared``
        bytes in common with the one before and does not sort before it."""
        inside = np.flatnonzero(shared >= 0)
        for first in range(0, len(inside), 1 << 16):
            i = inside[first : first + (1 << 16)]
            a, b, n = at[i - 1], at[i], shared[i]
            most = np.minimum(reach[i - 1], reach[i])
            in_order = np.where(n == most, reach[i - 1] <= reach[i], self.following(a, n, back) < self.following(b, n, back))
            equal = self.data[_ranges(a - n if back else a, n)] == self.data[_ranges(b - n if back else b, n)]
            if not (in_order.all() and equal.all()):
                return False
        return True


def sorted_shared(
    suffixes: Suffixes, at: np.ndarray, reach: np.ndarray, start: np.ndarray, size: np.ndarray, back: bool = False
) -> tuple[np.ndarray, np.ndarray]:
    """The strings' order within their groups, and how many bytes each shares with the one
    before (-1 for the first of a group). If a hash collision shows, both are made again
    from the bytes themselves."""
    order = suffixes.sort(at, reach, start, size, back)
    shared = np.full(len(at), -1, np.int64)
    inside = np.ones(len(at), bool)
    inside[start] = False
    later = np.flatnonzero(inside)
    a, b = order[later - 1], order[later]
    shared[later] = suffixes.common(at[a], at[b], np.minimum(reach[a], reach[b]), back)
    if not suffixes.verified(at[order], reach[order], shared, back):
        data = suffixes.data
        text = [data[p - n : p][::-1].tobytes() if back else data[p : p + n].tobytes() for p, n in zip(at.tolist(), reach.tolist(), strict=True)]
        group = np.repeat(np.arange(len(start)), size)
        order = np.array(sorted(range(len(at)), key=lambda i: (group[i], text[i], i)))
        shared[later] = [len(commonprefix([text[a], text[b]])) for a, b in zip(order[later - 1], order[later], strict=True)]
    return order, shared


def sorted_equal(suffixes: Suffixes, at: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order, within their groups, of the strings of full length, and which are equal to
    the one before."""
    order, shared = sorted_shared(suffixes, at, np.full(len(at), suffixes.length), start, size)
    return order, shared == suffixes.length


def _marked(rows: pa.Table, length: int) -> pa.Table:
    heads = [np.frombuffer(x, _HEAD) for x in rows.column("heads").to_pylist()]
    owner = np.repeat(rows.column("block").to_numpy(), [len(h) for h in heads])
    head = np.concatenate(heads)
    size = head["windows"].astype(np.int64) + length - 1
    packed = rows.column("bytes").to_pylist()
    sizes = [int(h["windows"].sum(dtype=np.int64)) + (length - 1) * len(h) for h in heads]
    data = b"".join(pa.decompress(x, n, CODEC, asbytes=True) for x, n in zip(packed, sizes, strict=True))
    data = np.frombuffer(data, np.uint8)
    base = np.cumsum(size) - size
    order = np.argsort(head["anchor"], kind="stable")
    anchor = head["anchor"][order]
    total = np.cumsum(head["windows"][order].astype(np.int64))
    bounds = np.flatnonzero(np.append(anchor[1:] != anchor[:-1], True)) + 1
    found, first = [], 0
    while first < len(order):
        # Whole anchors, of about CHUNK_WINDOWS windows together.
        most = (total[first - 1] if first else 0) + CHUNK_WINDOWS
        i = max(np.searchsorted(total[bounds - 1], most, "right") - 1, np.searchsorted(bounds, first, "right"))
        last = int(bounds[min(i, len(bounds) - 1)])
        chosen = order[first:last]
        found.append(_marks_of(head[chosen], owner[chosen], data[_ranges(base[chosen], size[chosen])], length))
        first = last
    block, start = (np.concatenate([f[i] for f in found]) for i in range(2))
    return _packed(block, start, length)


def _marks_of(head: np.ndarray, owner: np.ndarray, data: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(block, start) of the windows that a smaller document has too; ``head`` is sorted by
    anchor.

    The stretches of an anchor are sorted twice: by their bytes from the anchor on and by
    those back from it. The windows that begin ``o`` bytes before the anchor are equal in two
    stretches that share ``length - o`` bytes from the anchor on and ``o`` back from it,
    and in either order such stretches are neighbours."""
    nothing = np.zeros(0, np.int64), np.zeros(0, np.int64)
    n, before = head["windows"].astype(np.int64), head["before"].astype(np.int64)
    size = n + length - 1
    place = np.cumsum(size) - size + before
    cuts = np.flatnonzero(np.append(True, head["anchor"][1:] != head["anchor"][:-1]))
    count = np.diff(np.append(cuts, len(head)))
    several = np.flatnonzero(np.repeat(count > 1, count))
    if not len(several):
        return nothing
    n, before, size, place, owner, head = (x[several] for x in (n, before, size, place, owner, head))
    count = count[count > 1]
    start = np.cumsum(count) - count
    suffixes = Suffixes(data, length)
    onward, shared_on = sorted_shared(suffixes, place, size - before, start, count)
    backward, shared_back = sorted_shared(suffixes, place, before, start, count, back=True)
    ids, at, least = head["id"], head["at"].astype(np.int64), before - n + 1
    alike_on, alike_back = np.zeros(len(head), np.int64), np.zeros(len(head), np.int64)
    found = [nothing]
    for o in range(int(least.min()), int(before.max()) + 1):
        # Stretches with a window there, by classes of equal bytes in both directions.
        alike_on[onward] = np.cumsum(shared_on < length - o)
        alike_back[backward] = np.cumsum(shared_back < o)
        which = np.flatnonzero((least <= o) & (o <= before))
        key = (alike_on * (len(head) + 1) + alike_back)[which]
        order = np.argsort(key, kind="stable")
        which, key = which[order], key[order]
        run = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else key
        if len(run) == len(which):
            continue
        smallest = np.repeat(np.minimum.reduceat(ids[which], run), np.diff(np.append(run, len(which))))
        later = which[ids[which] > smallest]
        found.append((owner[later], at[later] + before[later] - o))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _packed(block: np.ndarray, start: np.ndarray, length: int) -> pa.Table:
    """A row per block with the marked windows merged to (start, end) pairs."""
    order = np.lexsort((start, block))
    block, start = block[order], start[order]
    new = np.append(True, (block[1:] != block[:-1]) | (start[1:] != start[:-1] + 1)) if len(block) else np.zeros(0, bool)
    at = np.flatnonzero(new)
    to = np.append(at[1:], len(start)) - 1 if len(at) else at
    spans = np.stack([start[at], start[to] + length], 1) if len(at) else np.zeros((0, 2), np.int64)
    owners = block[at]
    cuts = np.flatnonzero(np.append(True, owners[1:] != owners[:-1])) if len(at) else at
    parts = np.split(spans, cuts[1:]) if len(cuts) else []
    return pa.table(
        {"block": pa.array(owners[cuts], pa.int64()), "spans": pa.array([p.astype(np.int64).tobytes() for p in parts], pa.binary())}
    )


def _removed(block: Block, marks: list[bytes], id_col: str) -> pa.Table:
    """Every document with its spans and what is left of it."""
    change = np.zeros(len(block.data) + 1, np.int32)
    repeats = block.repeats()
    spans = [np.frombuffer(m, np.int64).reshape(-1, 2) for m in marks]
    spans.append(np.stack([block.first[repeats], block.last[repeats] + block.length], 1))
    for pair in spans:
        np.add.at(change, pair[:, 0], 1)
        np.add.at(change, pair[:, 1], -1)
    gone = np.cumsum(change)[:-1] > 0
    n_bytes, kept, all_spans = [], [], []
    for a, b in zip(block.offsets[:-1].tolist(), block.offsets[1:].tolist(), strict=True):
        mask = gone[a:b]
        n_bytes.append(b - a)
        if not mask.any():
            kept.append(block.data[a:b].tobytes())
            all_spans.append([])
            continue
        kept.append(block.data[a:b][~mask].tobytes())
        edge = np.flatnonzero(np.diff(np.concatenate([[False], mask, [False]]).astype(np.int8)))
        all_spans.append([{"start": s, "end": e} for s, e in edge.reshape(-1, 2).tolist()])
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    return pa.table(
        [block.ids, pa.array(n_bytes, pa.int64()), pa.array(all_spans, span), pa.array(kept, pa.binary())],
        names=[id_col, "n_bytes", "spans", "kept"],
    )


def without_repeats(
    docs: DataFrame,
    length: int = 50,
    anchor: int = 20,
    id_col: str = "doc_id",
    text_col: str = "text",
    block_bytes: int = 4 << 20,
) -> DataFrame:
    """One row per input row: the id, ``n_bytes``, ``spans`` (maximal removed runs, start and
    end in bytes) and ``kept`` (binary, the bytes that are left).

    Null and empty texts have no bytes; texts shorter than ``length`` stay whole. Rows that
    repeat an id don't take from each other. A null id counts as larger than all others.
    Strings are judged on the input, not on what is left. An empty table gives an empty
    result; other columns are not read. A text of any length is searched whole, in the task
    of its block; rows that agree in id and text share a block.
    """
    if not 0 < length - anchor < 64:
        raise ValueError("anchor must be shorter than length, by less than 64 bytes")
    source = docs.select(
        F.col(f"`{id_col}`").cast("long").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text")
    )
    total = source.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, math.ceil(total / block_bytes))
    buckets, sort_buckets = max(1, blocks // 4), blocks
    # With the text, rows that share an id, or have none, are dealt over the blocks too.
    texts = source.withColumn("block", F.pmod(F.xxhash64("id", "text"), F.lit(blocks)).cast("long")).groupBy("block")

    def number(table: pa.Table) -> int:
        return table.column("block")[0].as_py()

    def own_anchors(table: pa.Table) -> pa.Table:
        return _own_anchors(Block(table, length, anchor), number(table), buckets)

    def to_sort(table: pa.Table, replies: pa.Table) -> pa.Table:
        shared = [np.frombuffer(x, np.uint64) for x in replies.column("anchors").to_pylist()]
        block = Block(table, length, anchor)
        return _stretches_to_sort(block, number(table), np.concatenate([np.zeros(0, np.uint64), *shared]), sort_buckets)

    def removed(table: pa.Table, marks: pa.Table) -> pa.Table:
        return _removed(Block(table, length, anchor), marks.column("spans").to_pylist(), id_col)

    anchors = texts.applyInArrow(own_anchors, "bucket long, block long, single binary, several binary")
    shared = anchors.groupBy("bucket").applyInArrow(_shared_anchors, "block long, anchors binary")
    stretches = texts.cogroup(shared.groupBy("block")).applyInArrow(
        to_sort, "bucket long, block long, heads binary, bytes binary"
    )
    marks = stretches.groupBy("bucket").applyInArrow(lambda t: _marked(t, length), "block long, spans binary")
    return texts.cogroup(marks.groupBy("block")).applyInArrow(
        removed, f"`{id_col}` long, n_bytes long, spans array<struct<start:long,end:long>>, kept binary"
    )
