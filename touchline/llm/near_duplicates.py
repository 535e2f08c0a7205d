"""Near-duplicate documents by min-max hashing, confirmed on full shingle sets.

Every permutation of the shingle hashes gives two values of a set, its minimum and its
maximum, so the signature needs half as many hash evaluations. Bands of the signature
bring similar sets together. Documents of equal sets count as one, their smallest id.

Within a band's group nobody is compared with everybody:

1. each document is confirmed against the smallest id of each of its groups;
2. groups whose members are not yet in one component are compared by signature, in
   blocks of bounded size. Of the pairs in different components whose signatures allow a
   link, a block gives only a forest that connects their ends, at most one row per member;
3. the documents that the forests connect are a cloud. Its full sets are dealt into blocks
   of bounded bytes, and each pair of blocks is compared there, over the documents that
   hold each shingle; a block gives only a forest of the links.

So every pair that shares a band ends up linked, confirmed as no link, or known to be
in one component, and no step writes the pairs of a group. With 60 bands of six values a pair at 0.8 shares no band with a chance
of 1e-8; 40 bands do that for 0.85.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from touchline.llm import hashing
from touchline.llm.tables import staged

#: Members of a band's group, and bytes of the full sets of a cloud, in one block.
BLOCK = 1500
BLOCK_BYTES = 16 << 20
#: Entries of a block's posting lists that are read at a time.
POSTINGS = 1 << 20
#: Links that a task writes in a round of stars.
LINKS = 1 << 17
#: Signatures of pairs at the threshold fall below it by more than this once in 1e8.
MARGIN = 0.14
_random = np.random.default_rng(77)
FLIP = _random.integers(0, 2**32, 4096, dtype=np.uint32)
TIMES = _random.integers(0, 2**31, 4096, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
PAIR = "a long, b long"


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text) of the distinct shingles, sorted by text and hash: ``k`` words, or all
    words of a text that has fewer."""
    data = hashing.LOWER[data]
    starts, ends, text = hashing.words(data, offsets)
    each = hashing.stretch_hashes(data, starts, ends)
    shingle, owner = hashing.windows(each, text, k)
    n_words = np.bincount(text, minlength=len(offsets) - 1)
    short = np.flatnonzero((n_words > 0) & (n_words < k))
    if len(short):
        first = np.searchsorted(text, short)
        total = np.zeros(len(short), np.uint64)
        for i in range(k - 1):
            more = n_words[short] > i
            total[more] += each[first[more] + i] * hashing.PLACE[i]
        shingle = np.concatenate([shingle, hashing.mix(total + n_words[short].astype(np.uint64) * hashing.PLACE[-1])])
        owner = np.concatenate([owner, short])
    order = np.lexsort((shingle, owner))
    shingle, owner = shingle[order], owner[order]
    if len(shingle) > 1:
        new = np.ones(len(shingle), bool)
        new[1:] = (shingle[1:] != shingle[:-1]) | (owner[1:] != owner[:-1])
        shingle, owner = shingle[new], owner[new]
    return shingle, owner


def signatures(shingle: np.ndarray, first: np.ndarray, n_values: int) -> np.ndarray:
    """One row per set that starts at ``first``: minimum and maximum under each of
    ``n_values / 2`` permutations."""
    low = (shingle >> np.uint64(32)).astype(np.uint32)
    out = np.empty((len(first), n_values), np.uint32)
    moved = np.empty_like(low)
    for i in range(n_values // 2):
        np.bitwise_xor(low, FLIP[i], out=moved)
        np.multiply(moved, TIMES[i], out=moved)
        out[:, 2 * i] = np.minimum.reduceat(moved, first)
        out[:, 2 * i + 1] = np.maximum.reduceat(moved, first)
    return out


def _signature_table(docs: DataFrame, id_col: str, text_col: str, k: int, bands: int, rows: int) -> DataFrame:
    schema = "id long, text_hash long, n_shingles long, set1 long, set2 long, bands array<long>, signature binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = hashing.Texts(batch.column(1))
            for begin, end in texts.runs():
                shingle, owner = shingle_sets(*texts.part(begin, end), k)
                n = end - begin
                count = np.bincount(owner, minlength=n)
                full = np.flatnonzero(count)
                first = np.searchsorted(owner, full)
                digests = np.zeros((2, n), np.uint64)
                keys = [None] * n
                packed = [None] * n
                if len(full):
                    for i in range(2):
                        digests[i, full] = np.add.reduceat(hashing.mix(shingle + hashing.PLACE[i]), first)
                    values = signatures(shingle, first, bands * rows)
                    grouped = values.reshape(len(full), bands, rows).astype(np.uint64)
                    key = hashing.mix((grouped * hashing.PLACE[:rows]).sum(2, dtype=np.uint64) + hashing.PLACE[rows : rows + bands])
                    low = (values & np.uint32(255)).astype(np.uint8)
                    for i, doc in enumerate(full):
                        keys[doc], packed[doc] = key[i].view(np.int64), low[i].tobytes()
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0)[begin:end],
                        batch.column(2)[begin:end],
                        pa.array(count, pa.int64()),
                        pa.array(digests[0].view(np.int64)),
                        pa.array(digests[1].view(np.int64)),
                        pa.array(keys, pa.list_(pa.int64())),
                        pa.array(packed, pa.binary()),
                    ],
                    names=["id", "text_hash", "n_shingles", "set1", "set2", "bands", "signature"],
                )

    source = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text")).withColumn(
        "text_hash", F.xxhash64("text")
    )
    return staged(source.mapInArrow(run, schema), "signatures")


def _full_sets(docs: DataFrame, ids: DataFrame, id_col: str, text_col: str, k: int) -> DataFrame:
    """(id, set) of the documents of ``ids``: the sorted 64-bit shingle hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = hashing.Texts(batch.column(1))
            for begin, end in texts.runs():
                shingle, owner = shingle_sets(*texts.part(begin, end), k)
                cut = np.searchsorted(owner, np.arange(end - begin + 1))
                sets = [shingle[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0)[begin:end], pa.array(sets, pa.binary())], names=["id", "set"])

    source = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"))
    # A merge join at every size, since the ids grow with the documents.
    found = source.join(ids.hint("merge"), "id", "left_semi").mapInArrow(run, "id long, set binary")
    return staged(found, "sets")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs with 100 * intersection >= percent * union on the full sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, left, right = batch.columns
            keep = []
            for x, y in zip(left, right, strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([a.filter(mask), b.filter(mask)], names=["a", "b"])

    one = sets.select(F.col("id").alias("a"), F.col("set").alias("left"))
    two = sets.select(F.col("id").alias("b"), F.col("set").alias("right"))
    joined = pairs.join(one.hint("merge"), "a").join(two.hint("merge"), "b").select("a", "b", "left", "right")
    return staged(joined.mapInArrow(run, PAIR), "links")


def _unlike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The links (u, v), without those that repeat one of the same batch."""
    for batch in batches:
        u, v = (c.to_numpy() for c in batch.columns)
        order = np.lexsort((v, u))
        u, v = u[order], v[order]
        new = np.ones(len(u), bool)
        new[1:] = (u[1:] != u[:-1]) | (v[1:] != v[:-1])
        yield pa.RecordBatch.from_arrays([pa.array(u[new]), pa.array(v[new])], names=["u", "v"])


def components(links: DataFrame) -> DataFrame:
    """(node, component) of the nodes of the links (a, b); the component is its smallest
    node. A round is a large and a small star in one written step: the lesser end of a link
    becomes its own least neighbour, then a node's lesser ends are linked to the least of
    them. No round has more links than the one before. A round that moves nothing has one
    link from every node to its component, and is the last. Least neighbours are summed
    up before they are shuffled and repeated links dropped; the links of a centre, two
    numbers each, meet in one join task only where the least neighbours are too many to be
    broadcast. The tasks that write a round follow the number of links, not that of the session's
    shuffle partitions, which is set for whole texts."""
    links = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u > v")
    tasks = max(links.sparkSession.sparkContext.defaultParallelism, math.ceil(links.count() / LINKS))
    by_node = Window.partitionBy("u").orderBy("m", F.desc("moved"))
    while True:
        both = links.union(links.select("v", "u"))
        least = both.groupBy(F.col("u").alias("v")).agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = links.mapInArrow(_unlike, "u long, v long").join(least, "v").select("u", "m", (F.col("m") < F.col("v")).alias("moved"))
        # A node's first row links it to the least of its lesser ends, the others link those.
        small = large.select(
            F.row_number().over(by_node).alias("place"),
            F.lag("m").over(by_node).alias("before"),
            F.min("m").over(by_node).alias("least"),
            "u", "m", "moved",
        ).filter("place = 1 or m > before")
        stars = small.select(F.expr("if(place = 1, u, m) as u"), F.col("least").alias("v"), F.expr("place > 1 or moved as moved"))
        links = staged(stars.coalesce(tasks), "stars")
        moved = links.filter("moved")
        links = links.drop("moved")
        if moved.isEmpty():
            return links.toDF("node", "component")


def _labelled(nodes: DataFrame, labels: DataFrame) -> DataFrame:
    return nodes.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))


def _grouped(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple[int, ...], pa.Table]]:
    """(key, rows) of the groups of rows that follow one another with equal ``keys``."""
    held: list[pa.Table] = []
    last: tuple[int, ...] | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        columns = np.stack([table.column(c).to_numpy() for c in keys], 1)
        cuts = np.concatenate([[0], np.flatnonzero((columns[1:] != columns[:-1]).any(1)) + 1, [len(columns)]])
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            key = tuple(columns[a].tolist())
            if last is not None and key != last:
                yield last, pa.concat_tables(held).combine_chunks()
                held = []
            last = key
            held.append(table.slice(a, b - a))
    if last is not None:
        yield last, pa.concat_tables(held).combine_chunks()


def _pair_batch(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    a, b = zip(*pairs, strict=True) if pairs else ((), ())
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _in_blocks(members: DataFrame, group: str) -> DataFrame:
    """The members of each ``group`` dealt by hash into its ``blocks``, once for every pair
    (i, j) of blocks that holds their own; ordered by group and pair within a partition."""
    return (
        members.withColumn("own", F.pmod(F.xxhash64("node"), "blocks").cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other")})
        .drop("other", "blocks")
        .repartition(group, "i", "j")
        .sortWithinPartitions(group, "i", "j", "node")
    )


def _forest(label: np.ndarray, p: int, partners: np.ndarray) -> list[int]:
    """One of the ``partners`` per tree that is not yet that of ``p``; their trees join it."""
    trees, first = np.unique(label[partners], return_index=True)
    new = trees != label[p]
    label[np.isin(label, trees[new])] = label[p]
    return partners[first[new]].tolist()


def _alike(shared: DataFrame, labels: DataFrame, facts: DataFrame, percent: int) -> DataFrame:
    """A forest over the pairs of a band's group that lie in different components and whose
    sizes and signatures allow a link, each in the first band that it shares."""
    members = _labelled(shared, labels)
    apart = (
        members.groupBy("band")
        .agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("n"))
        .filter("lo <> hi")
        .select("band", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    )

    def edges(band: int, i: int, j: int, table: pa.Table) -> list[tuple[int, int]]:
        node, component, size, own = (table.column(c).to_numpy() for c in ("node", "component", "n_shingles", "own"))
        signature = np.frombuffer(b"".join(table.column("signature").to_pylist()), np.uint8).reshape(len(node), -1)
        bands = np.concatenate([c.flatten().to_numpy() for c in table.column("bands").chunks]).reshape(len(node), -1)
        theirs = np.flatnonzero(own == j)
        label = np.arange(len(node))
        out = []
        for p in np.flatnonzero(own == i):
            q = theirs[theirs > p] if i == j else theirs
            q = q[component[q] != component[p]]
            q = q[label[q] != label[p]]
            q = q[100 * np.minimum(size[q], size[p]) >= percent * np.maximum(size[q], size[p])]
            q = q[(signature[q] == signature[p]).mean(1) >= percent / 100 - MARGIN]
            if len(q):
                q = q[bands[p][(bands[q] == bands[p]).argmax(1)] == band]
                out += [(node[p], node[x]) for x in _forest(label, p, q)]
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, table in _grouped(batches, ["band", "i", "j"]):
            if table.num_rows > 1:
                yield _pair_batch(edges(*key, table))

    return _in_blocks(members.join(apart, "band").join(facts, "node"), "band").mapInArrow(run, PAIR)


def _compared(clouds: DataFrame, sets: DataFrame, facts: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """A forest of the links between the documents of each cloud (node, cloud) that lie in
    different components, found on the full sets."""
    n_bytes = F.sum(8 * F.col("n_shingles"))
    blocks = clouds.join(facts, "node").groupBy("cloud").agg(F.ceil(n_bytes / BLOCK_BYTES).cast("int").alias("blocks"))
    # The sets come last and by document, so that only a block's share of them meets.
    members = _labelled(clouds, labels).join(blocks, "cloud").join(sets.select(F.col("id").alias("node"), "set").hint("merge"), "node")

    def links(i: int, j: int, table: pa.Table) -> list[tuple[int, int]]:
        node, component, own = (table.column(c).to_numpy() for c in ("node", "component", "own"))
        sets = table.column("set").to_pylist()
        size = np.array([len(x) // 8 for x in sets])
        doc = np.repeat(np.arange(len(node)), size)
        # The shingles as whole numbers from 0, and the documents that hold each.
        _, shingle = np.unique(np.frombuffer(b"".join(sets), np.uint64), return_inverse=True)
        del sets
        at = np.concatenate([[0], np.cumsum(size)])
        holders = doc[np.argsort(shingle, kind="stable")]
        n_holders = np.bincount(shingle)
        begin = np.concatenate([[0], np.cumsum(n_holders)])
        label = np.unique(component, return_inverse=True)[1]
        out = []
        for p in np.flatnonzero(own == i):
            able = (own == j) & (label != label[p])
            able &= 100 * np.minimum(size, size[p]) >= percent * np.maximum(size, size[p])
            if i == j:
                able[: p + 1] = False
            if not able.any():
                continue
            mine = shingle[at[p] : at[p + 1]]
            mine = mine[n_holders[mine] > 1]
            both = np.zeros(len(node), np.int64)
            read = np.cumsum(n_holders[mine]) // POSTINGS
            for part in np.split(mine, np.flatnonzero(np.diff(read)) + 1):
                n = n_holders[part]
                entry = np.arange(n.sum()) + np.repeat(begin[part] - np.cumsum(n) + n, n)
                both += np.bincount(holders[entry], minlength=len(node))
            q = np.flatnonzero(able & (100 * both >= percent * (size + size[p] - both)))
            if len(q):
                out += [(node[p], node[x]) for x in _forest(label, p, q)]
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, i, j), table in _grouped(batches, ["cloud", "i", "j"]):
            yield _pair_batch(links(i, j, table))

    return staged(_in_blocks(members, "cloud").mapInArrow(run, PAIR), "links")


def near_duplicates(
    docs: DataFrame,
    words: int = 5,
    percent: int = 80,
    id_col: str = "doc_id",
    text_col: str = "text",
    bands: int = 60,
    rows: int = 6,
) -> DataFrame:
    """One row per input row: the id, ``n_shingles`` (distinct), ``component_id`` (the
    smallest id reachable over links, its own included), ``kept`` (id = component_id) and
    ``text_hash`` (xxhash64 of the text, to find the row again where ids repeat).

    Words are runs of other characters than ASCII white space, with A-Z lower-cased; a
    document's set holds its shingles of ``words`` words, or all its words as one if it has
    fewer. Sets with 100 * intersection >= ``percent`` * union are linked. A null, empty
    or blank text has an empty set and is linked with nothing. Rows that repeat an id are
    judged each by their own text; texts that share their smallest id count as linked. Rows
    without id join their equals only (component null
    if none of them has an id). Texts are read whole; an empty table gives an empty
    result. Other columns are not read.
    """
    table = _signature_table(docs, id_col, text_col, words, bands, rows)
    smallest = F.min(F.struct(F.col("id").isNull().alias("last"), "id", "n_shingles", "signature", "bands"))
    facts = staged(
        table.filter("n_shingles > 0")
        .groupBy("set1", "set2")
        .agg(smallest.alias("s"))
        .select("set1", "set2", F.col("s.id").alias("node"), "s.n_shingles", "s.signature", "s.bands"),
        "representatives",
    )
    each = facts.filter("node is not null").select("node", F.explode("bands").alias("band"))
    groups = each.groupBy("band").agg(F.min("node").alias("pivot"), F.count("*").alias("n")).filter("n > 1").select("band", "pivot")
    shared = staged(each.join(groups, "band"), "shared-bands")
    full = _full_sets(docs, shared.select(F.col("node").alias("id")).distinct(), id_col, text_col, words)

    short = facts.select("node", "n_shingles", "signature", "bands")
    first = shared.filter("node <> pivot").select(F.col("pivot").alias("a"), F.col("node").alias("b")).distinct()
    labels = components(_confirmed(first, full, percent))
    edges = staged(_alike(shared.select("node", "band"), labels, short, percent), "alike")
    if not edges.isEmpty():
        clouds = components(edges)
        clouds = clouds.unionAll(clouds.select("component", "component").distinct()).toDF("node", "cloud")
        links = _compared(clouds, full, short, labels, percent)
        labels = components(labels.toDF("a", "b").unionAll(links))

    labelled = _labelled(facts.select("set1", "set2", "node"), labels).select("set1", "set2", "component")
    return table.select("id", "text_hash", "n_shingles", "set1", "set2").join(labelled, ["set1", "set2"], "left").select(
        F.col("id").alias(id_col),
        "n_shingles",
        F.when(F.col("n_shingles") > 0, F.col("component")).otherwise(F.col("id")).alias("component_id"),
        F.when(F.col("n_shingles") > 0, F.col("id").eqNullSafe(F.col("component"))).otherwise(F.lit(True)).alias("kept"),
        "text_hash",
    )
