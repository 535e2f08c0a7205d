"""Hard negatives by threshold joins over an inverted index that leaves out dimensions.

Rows and anchors are cut into blocks of bounded size, and every pair of an anchor block and
a row block is one group: the anchors are a stated query set, and no group grows with
the data. Inside a group the dimensions are ordered by their weight in the block. For a threshold, a
row enters the lists of its leading dimensions only: the rest is left out as soon as its
norm times the anchor's is below the threshold, because such a rest can't lift a row
that shares nothing in the lists. Partial scores are accumulated list by list, a pair is
dropped when its partial score plus the product of both remaining norms stays below the
anchor's threshold, and the pairs that are left get their exact score in whole numbers.

The first join looks for positives (the best rows of the anchor's label), the second for
negatives (the best rows of other labels in the window below a positive's score). Both
begin with a high threshold per anchor. Anchors whose lists or windows aren't full are
joined again with a lower one, and in the last round with the lowest that any result can
have, so the result doesn't depend on the thresholds.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from touchline.llm.tables import staged
from touchline.llm.vectors import finite, matrix, whole

ROOM = 1e-9
#: Dimensions per step of the accumulation, and rows and anchors per tile of partial scores.
STEP, TILE_ROWS, TILE_ANCHORS = 8, 4096, 256
#: Share of pairs below which the rest is scored pair by pair.
FEW = 0.02
ROWS_PER_BLOCK, ANCHORS_PER_BLOCK = 1 << 16, 1 << 14
#: Thresholds of the rounds before the last: for positives as a share of the largest score
#: an anchor can have, for negatives as a share of the lowest upper window end.
POSITIVE_ROUNDS, NEGATIVE_ROUNDS = (0.75, 0.5), (0.9, 0.75)


def surviving_pairs(rows: np.ndarray, anchors: np.ndarray, at_least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, anchor, score) of all pairs whose inner product is the anchor's ``at_least`` or
    more. Whole numbers throughout; the bounds are floating and have room for rounding."""
    empty = (np.zeros(0, np.int64),) * 3
    if not len(rows) or not len(anchors):
        return empty
    order = np.argsort(-(rows.astype(np.float64) ** 2).sum(0), kind="stable")
    rows, anchors = rows[:, order], anchors[:, order]
    width = rows.shape[1]
    found = []
    anchor_rest = _rest_norms(anchors)
    for first in range(0, len(rows), TILE_ROWS):
        part = rows[first : first + TILE_ROWS]
        rest = _rest_norms(part)
        for left in range(0, len(anchors), TILE_ANCHORS):
            probe, limit = anchors[left : left + TILE_ANCHORS], at_least[left : left + TILE_ANCHORS].astype(np.float64)
            probe_rest = anchor_rest[left : left + TILE_ANCHORS]
            for r, a in _tile(part, rest, probe, probe_rest, limit, width):
                scores = np.einsum("ij,ij->i", part[r], probe[a])
                good = scores >= at_least[left + a]
                found.append((first + r[good], left + a[good], scores[good]))
    return tuple(np.concatenate(x) for x in zip(*found)) if found else empty


def _rest_norms(vectors: np.ndarray) -> np.ndarray:
    """[vector, p]: norm of the components from the p-th on."""
    squares = np.cumsum((vectors.astype(np.float64) ** 2)[:, ::-1], 1)[:, ::-1]
    return np.sqrt(np.concatenate([squares, np.zeros((len(vectors), 1))], 1))


def _tile(part, rest, probe, probe_rest, limit, width) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of one tile that no bound excludes, some at a time."""
    norms = probe_rest[:, 0]
    room = ROOM * (1 + rest[:, 0].max() * norms.max())
    # a row's lists end where its rest, times any anchor's norm, is below that anchor's limit
    if (limit > 0).all():
        reach = (norms / limit).max()
        n_lists = (rest * reach >= 1 - ROOM).sum(1)
    else:
        n_lists = np.full(len(part), width)
    by_lists = np.argsort(-n_lists, kind="stable")
    part, rest, n_lists = part[by_lists].astype(np.float64), rest[by_lists], n_lists[by_lists]
    probe = probe.astype(np.float64)
    listed = np.searchsorted(-n_lists, 0, "left")  # rows with any list
    kept, sums = np.arange(listed), np.zeros((listed, len(probe)))
    for begin in range(0, width, STEP):
        end = min(begin + STEP, width)
        # rows are in order of their number of lists, so the lists of a step are a prefix
        n = np.searchsorted(-n_lists[kept], -begin, "left")
        sums[:n] += part[kept[:n], begin:end] @ probe[:, begin:end].T
        upto = np.minimum(-(-n_lists[kept] // STEP) * STEP, end)
        remaining = np.where(upto < end, rest[kept, np.minimum(upto, width)], rest[kept, end])
        # a row out of its lists has its whole rest ahead, on the anchor's side too
        ahead = np.where((upto < end)[:, None], probe_rest[:, np.minimum(upto, width)].T, probe_rest[:, end][None, :])
        alive = sums + remaining[:, None] * ahead >= limit - room
        some = alive.any(1)
        kept, sums, alive = kept[some], sums[some], alive[some]
        if not len(kept):
            return
        if end == width or alive.mean() < FEW:
            r, a = np.nonzero(alive)
            for first in range(0, len(r), 1 << 16):
                yield by_lists[kept[r[first : first + (1 << 16)]]], a[first : first + (1 << 16)]
            return


def best(group: np.ndarray, scores: np.ndarray, ids: np.ndarray, no_id: np.ndarray, n: int) -> np.ndarray:
    """Places of the ``n`` best entries of each group: higher scores first, smaller ids on
    ties, entries without an id after the others."""
    order = np.lexsort((ids, no_id, -scores, group))
    ranked = group[order]
    starts = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]])) if len(ranked) else np.zeros(0, np.int64)
    place = np.arange(len(order)) - np.repeat(starts, np.diff(np.append(starts, len(order))))
    return order[place < n]


ROWS = "id long, label int, v array<int>, block int"
HITS = "anchor string, slot long, row_id long, score long"


def usable_rows(df: DataFrame, scale: int, id_col: str, vector_col: str, label: Column) -> DataFrame:
    """Distinct (id, label, whole vector), with a key of the row."""
    vector = df[vector_col]
    rows = df.filter(label.isNotNull() & finite(vector)).select(
        df[id_col].cast("long").alias("id"), label.cast("int").alias("label"), whole(vector, scale).alias("v")
    )
    return rows.distinct()


def _blocks(n_rows: int, per_block: int, spread: int) -> int:
    return max(1, -(-n_rows // per_block), min(spread, n_rows // 1024))


def _joined(
    anchors: DataFrame, rows: DataFrame, n_anchor_blocks: int, n_row_blocks: int, width: int, search: Callable
) -> DataFrame:
    """``search`` over every pair of an anchor block and a row block. Both tables have a
    ``block`` column; each row is sent to the pairs of its block."""
    to_pairs = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = anchors.withColumnRenamed("block", "i").withColumn("j", to_pairs(n_row_blocks))
    right = rows.withColumnRenamed("block", "j").withColumn("i", to_pairs(n_anchor_blocks))

    def pair(some_anchors: pa.Table, some_rows: pa.Table) -> pa.Table:
        columns = [[], [], [], []]
        if some_anchors.num_rows and some_rows.num_rows:
            columns = search(some_anchors.combine_chunks(), some_rows.combine_chunks(), width)
        names, kinds = zip(*[part.split() for part in HITS.split(", ")])
        as_arrow = {"string": pa.string(), "long": pa.int64()}
        return pa.table([pa.array(c, as_arrow[k]) for c, k in zip(columns, kinds)], names=list(names))

    return left.groupBy("i", "j").cogroup(right.groupBy("i", "j")).applyInArrow(pair, HITS)


def _plain(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).fill_null(0).to_numpy()


def _hits(anchors: pa.Table, rows: pa.Table, anchor_at, slot, row_at, scores) -> list[pa.Array]:
    return [
        anchors.column("anchor").take(pa.array(anchor_at)).combine_chunks(),
        slot,
        rows.column("id").take(pa.array(row_at)).combine_chunks(),
        scores,
    ]


def _each_label(anchors: pa.Table) -> Iterator[tuple[int, np.ndarray]]:
    labels = _plain(anchors, "label")
    for label in np.unique(labels):
        yield label, np.flatnonzero(labels == label)


def _positive_search(n: int) -> Callable:
    def search(anchors: pa.Table, rows: pa.Table, width: int) -> list:
        a_v, r_v = (matrix(t.column("v").combine_chunks(), width) for t in (anchors, rows))
        ids, no_id, r_label = _plain(rows, "id"), rows.column("id").is_null().to_numpy(), _plain(rows, "label")
        a_ids, limit = _plain(anchors, "id"), _plain(anchors, "at_least")
        out = []
        for label, at in _each_label(anchors):
            mine = np.flatnonzero(r_label == label)
            r, a, scores = surviving_pairs(r_v[mine], a_v[at], limit[at])
            r, a = mine[r], at[a]
            other = (ids[r] != a_ids[a]) | no_id[r]
            r, a, scores = r[other], a[other], scores[other]
            top = best(a, scores, ids[r], no_id[r], n)
            out.append((a[top], r[top], scores[top]))
        a, r, scores = (np.concatenate(x) for x in zip(*out))
        return _hits(anchors, rows, a, np.zeros(len(a), np.int64), r, scores)

    return search


def _negative_search(n: int) -> Callable:
    def search(anchors: pa.Table, rows: pa.Table, width: int) -> list:
        a_v, r_v = (matrix(t.column("v").combine_chunks(), width) for t in (anchors, rows))
        ids, no_id, r_label = _plain(rows, "id"), rows.column("id").is_null().to_numpy(), _plain(rows, "label")
        limit = _plain(anchors, "at_least")
        windows = anchors.column("windows").to_pylist()
        n_slots = max(len(w) for w in windows)
        # an anchor's windows as rows of a matrix; a missing one is empty
        low, high, score = (np.full((len(windows), n_slots), fill, np.int64) for fill in (1, 0, 0))
        for i, w in enumerate(windows):
            for s, window in enumerate(w):
                low[i, s], high[i, s], score[i, s] = window["low"], window["high"], window["positive_score"]
        out = []
        for label, at in _each_label(anchors):
            others = np.flatnonzero(r_label != label)
            r, a, scores = surviving_pairs(r_v[others], a_v[at], limit[at])
            r, a = others[r], at[a]
            for s in range(n_slots):
                inside = np.flatnonzero((low[a, s] <= scores) & (scores <= high[a, s]))
                top = inside[best(a[inside], scores[inside], ids[r[inside]], no_id[r[inside]], n)]
                out.append((a[top], score[a[top], s], r[top], scores[top]))
        a, slot, r, scores = (np.concatenate(x) for x in zip(*out))
        return _hits(anchors, rows, a, slot, r, scores)

    return search


def _merged(hits: DataFrame, n: int) -> DataFrame:
    """The ``n`` best hits of each (anchor, slot) with their rank; each task first keeps its
    own best."""
    by_score = Window.partitionBy("anchor", "slot").orderBy(F.desc("score"), F.asc_nulls_last("row_id"))
    return hits.withColumn("rank", F.row_number().over(by_score)).filter(F.col("rank") <= n)


def _rounds(
    anchors: DataFrame,
    rows: DataFrame,
    blocks: tuple[int, int],
    width: int,
    search: Callable,
    n: int,
    wanted: Column,
    at_least: list[Column],
    name: str,
) -> DataFrame:
    """The best ``n`` rows of each slot of each anchor. A round joins the anchors that are
    open with its threshold; those whose ``wanted`` rows are there are closed."""
    done, left = None, anchors
    for number, threshold in enumerate(at_least):
        last = number == len(at_least) - 1
        asked = left.withColumn("at_least", threshold)
        hits = staged(_merged(_joined(asked, rows, *blocks, width, search), n), f"{name}-{number}")
        if last:
            return hits if done is None else done.unionByName(hits)
        held = hits.groupBy("anchor").agg(F.count(F.lit(1)).alias("held"))
        judged = staged(
            left.join(held, "anchor", "left").withColumn("open", F.coalesce("held", F.lit(0)) < wanted).drop("held"),
            f"{name}-left-{number}",
        )
        full = judged.filter(~F.col("open")).select("anchor")
        closed = hits.join(full, "anchor", "left_semi")
        done = closed if done is None else done.unionByName(closed)
        left = judged.filter("open").drop("open")
        if left.isEmpty():
            return done


def hard_negatives(
    df: DataFrame,
    is_anchor: Column,
    scale: int = 256,
    n_positives: int = 5,
    n_negatives: int = 3,
    window: tuple[int, int] = (50, 95),
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label: Column | None = None,
) -> DataFrame:
    """For each anchor and each of its positives the first ``n_negatives`` rows of other
    labels whose score lies between ``window`` percent of the positive's score:
    ``anchor_id``, ``positive_id``, ``rank``, ``negative_id``, ``positive_score``,
    ``negative_score``.

    ``is_anchor`` is a condition on ``id``; ``label`` an expression (the column ``label`` by
    default). Rows with a null label, a null or empty vector or a null or non-finite
    component take no part; all vectors must have the same number of components, else the
    job fails. Rows that agree in id, label and vector count once. Rows that share an id but
    differ are rows of their own, except that an anchor's positives never have its id. Rows
    without an id are no anchors and come last on ties. A positive without a row in its window
    gives none; an empty table gives none. Other columns aren't read, whatever their names.
    """
    spark = df.sparkSession
    names = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    source = usable_rows(df, scale, id_col, vector_col, df["label"] if label is None else label).filter(F.size("v") > 0)
    rows = staged(source, "negatives-rows")
    sizes = rows.agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(is_anchor).alias("anchors"),
        F.min(F.size("v")).alias("least"), F.max(F.size("v")).alias("most"),
        F.max(F.aggregate("v", F.lit(0.0), lambda t, x: t + x.cast("double") * x)).alias("square"),
    ).first()
    if not sizes.anchors:
        return spark.createDataFrame([], names)
    if sizes.least != sizes.most:
        raise ValueError(f"vectors of {sizes.least} and of {sizes.most} components")
    width = sizes.most
    n_row_blocks, n_anchor_blocks = _blocks(sizes.rows, ROWS_PER_BLOCK, 64), _blocks(sizes.anchors, ANCHORS_PER_BLOCK, 1)
    blocks = (n_anchor_blocks, n_row_blocks)
    key = F.xxhash64("id", "label", "v")
    placed = rows.withColumn("block", F.pmod(key, F.lit(n_row_blocks)).cast("int"))
    # the row itself is its key: hashes of many rows may meet
    exact_key = F.sha2(F.concat_ws(",", "id", "label", F.array_join("v", " ")), 256)
    anchors = rows.filter(is_anchor).select(
        exact_key.alias("anchor"), "*", F.pmod(key, F.lit(n_anchor_blocks)).cast("int").alias("block")
    )
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda t, x: t + x.cast("double") * x))
    largest = norm * F.lit(float(np.sqrt(sizes.square)))
    never = F.lit(-(2**62)).cast("long")
    positives = _rounds(
        anchors, placed, blocks, width, _positive_search(n_positives), n_positives, F.lit(n_positives),
        [*[F.ceil(largest * F.lit(share)).cast("long") for share in POSITIVE_ROUNDS], never], "positives",
    )
    positives = positives.select("anchor", F.col("row_id").alias("positive_id"), F.col("score").alias("positive_score"))
    least, most = window
    # a window below zero is empty: its lower end is above its upper one
    low = F.ceil(F.col("positive_score") * least / F.lit(100).cast("decimal(20,0)")).cast("long")
    high = F.floor(F.col("positive_score") * most / F.lit(100).cast("decimal(20,0)")).cast("long")
    windows = (
        positives.select("anchor", "positive_score", low.alias("low"), high.alias("high"))
        .filter("low <= high")
        .distinct()
        .groupBy("anchor")
        .agg(F.collect_list(F.struct("low", "high", "positive_score")).alias("windows"))
    )
    asking = staged(anchors.join(windows, "anchor"), "negatives-windows")
    ends = lambda name: F.array_min(F.transform("windows", lambda w: w[name]))
    negatives = _rounds(
        asking, placed, blocks, width, _negative_search(n_negatives), n_negatives, F.size("windows") * n_negatives,
        [*[F.greatest(F.ceil(ends("high") * F.lit(share)).cast("long"), ends("low")) for share in NEGATIVE_ROUNDS], ends("low")],
        "negatives",
    )
    found = negatives.withColumnRenamed("slot", "positive_score")
    ids = anchors.select("anchor", F.col("id").alias("anchor_id"))
    return (
        positives.join(found, ["anchor", "positive_score"])
        .join(ids, "anchor")
        .select("anchor_id", "positive_id", "rank", F.col("row_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
    )
