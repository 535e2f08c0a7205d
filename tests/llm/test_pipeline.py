"""The pipeline's stages against brute force, each on rows with odd values."""

from __future__ import annotations

from collections import Counter

import corpus_pipeline
from touchline.llm import queries
from touchline.llm.tables import staged

SF = "/root/testdata/sf0.001"
LONG = " ".join(f"word{i}" for i in range(400))


def odd_rows(spark):
    documents = spark.read.parquet(f"{SF}/documents.parquet")
    item = spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").first().text
    rows = [
        (9000, None, None, None, None), (9001, "", "en", "src0", 0), (9002, LONG, "en", "src0", 1), (9003, LONG, "en", None, 1),
        (9003, LONG, "en", None, 1), (9004, LONG + " more", "en", "srcX", 1), (None, f"{LONG} {item}", "de", "src1", 1), (None, "short", "de", "src1", 1),
        (9005, " ".join(f"a{i}" for i in range(300)) + "\n" + item, "en", "src2", 1), (9006, "same " * 500, "en", "src0", 1),
        (9007, " ".join(f"u{i}" for i in range(60_000)), "en", "src0", 1),
    ]
    return documents.unionByName(spark.createDataFrame(rows, documents.schema)).selectExpr("*", "'x' as shard", "'y' as block")


def test_stages_on_odd_rows(spark):
    docs = odd_rows(spark)
    columns = docs.columns
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        out = staged(stage(spark, docs, SF), "test")
        seen[name] = [r.asDict() for r in out.collect()]
        if name != "sharding":
            assert out.columns == columns
            docs = out
    ids = {name: Counter(r["doc_id"] for r in rows) for name, rows in seen.items()}
    quality = ids["quality rules"]
    assert not {9000, 9001, 9006} & set(quality) and quality[9003] == 2 and quality[9002] == quality[9007] == 1
    near = ids["near-duplicates"]
    assert near[9002] == 1 and not near[9003] and not near[9004] and near[9007] == near[9005] == 1
    clean = ids["decontamination"]
    assert not clean[9005] and clean[9007] == 1 and not clean[None]
    assert ids["mixing"] == clean == ids["sharding"]
    shards = seen["sharding"]
    assert {r["shard"] for r in shards} <= set(range(queries.N_SHARDS))
    for k in {r["shard"] for r in shards}:
        slots = sorted(r["slot"] for r in shards if r["shard"] == k)
        assert slots == list(range(len(slots)))


def test_near_duplicate_stage_keeps_a_row_of_each_text(spark):
    rows = [(1, LONG), (1, LONG), (1, "another text"), (2, LONG), (None, LONG), (None, "alone " * 3), (None, "alone " * 3), (5, ""), (5, ""), (6, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = Counter((r.doc_id, r.text) for r in corpus_pipeline.near_dedup(spark, docs, SF).collect())
    assert got == Counter({(1, LONG): 1, (1, "another text"): 1, (None, "alone " * 3): 1, (5, ""): 2, (6, None): 1})


def test_shards_follow_the_mix(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    mixed = staged(corpus_pipeline.mix(spark, docs, SF), "test")
    order = [r.doc_id for r in mixed.collect()]
    placed = sorted(corpus_pipeline.shard(spark, mixed, SF).collect(), key=lambda r: (r.shard, r.slot))
    assert [r.doc_id for r in placed] == order
    assert corpus_pipeline.shard(spark, docs.limit(0), SF).collect() == []
    in_memory = spark.createDataFrame([(2, "b", "s"), (1, "a", "s")], "doc_id long, text string, source string")
    assert {r.doc_id for r in corpus_pipeline.shard(spark, in_memory, SF).collect()} == {1, 2}


def test_empty_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        out = staged(stage(spark, docs, SF), "test")
        assert out.count() == 0, name
        docs = out if name != "sharding" else docs
