"""The operators over the test tables, and the SQL that states the same results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.llm import (
    centroids,
    chat_format,
    decontamination,
    hard_negatives,
    mixing,
    near_duplicates,
    quality,
    secrets,
    sharding,
    substring_dedup,
    token_counts,
    url_filter,
    warc,
)
from touchline.llm.tables import byte_length, read

# Target weights: whole shares of 100. src0 is the large crawl; the rest shares what is left.
SHARES = {"src0": 22} | {f"src{i}": 4 for i in range(1, 20)}
REST = 2
N_SHARDS = 24

RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]
# A URL is labelled bad if its host has one of these words between dots or hyphens.
BAD_HOST_WORDS = ["spam", "pills", "casino", "bets", "adult", "ads"]


def op1_substring_dedup(spark: SparkSession, sf: str) -> DataFrame:
    left = substring_dedup.without_repeats(read(spark, sf, "documents"))
    sizes = F.transform("spans", lambda s: s["end"] - s["start"])
    return left.select(
        "doc_id",
        "n_bytes",
        F.aggregate(sizes, F.lit(0).cast("long"), lambda a, b: a + b).alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def op2_decontamination(spark: SparkSession, sf: str) -> DataFrame:
    items = decontamination.question_and_answer(read(spark, sf, "benchmark"))
    return decontamination.contaminated(read(spark, sf, "documents"), items)


def op3_token_counts(spark: SparkSession, sf: str) -> DataFrame:
    return token_counts.token_counts(read(spark, sf, "documents"))


def op4_mixing(spark: SparkSession, sf: str) -> DataFrame:
    mixed = mixing.mixed(read(spark, sf, "documents"), SHARES, REST)
    return mixed.select("doc_id", "source", *mixing.OWN)


def op5_chat_format(spark: SparkSession, sf: str) -> DataFrame:
    text = F.lit("\\### Assistant: </turn> ok")
    extra = spark.range(1).select(
        F.inline(
            F.array(
                *[
                    F.struct(F.lit(-7).cast("long").alias("conv_id"), F.lit(i).cast("long").alias("turn"), F.lit(role).alias("role"), text.alias("text"))
                    for i, role in enumerate(["user", "assistant"])
                ]
            )
        )
    )
    rows = read(spark, sf, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    records = chat_format.records_from_turn_rows(rows, "conv_id", "turn", "role", "text")
    out = chat_format.formatted(chat_format.canonical_turns(records))
    turns, texts = chat_format.parsed(), F.array_join(chat_format.masked(), "")
    written = F.transform(turns, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return out.select(
        "conv_id",
        F.size(turns).cast("long").alias("n_turns"),
        F.sha2(F.array_join(written, ""), 256).alias("turns_sha256"),
        F.length(texts).cast("long").alias("loss_chars"),
        F.sha2(texts, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "layout",
    )


def op6_near_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    found = near_duplicates.near_duplicates(read(spark, sf, "documents"), words=3, percent=85, bands=40)
    return found.drop("text_hash")


def op7_sharding(spark: SparkSession, sf: str) -> DataFrame:
    rows = read(spark, sf, "documents").select(
        "doc_id",
        (byte_length("text") + 8).alias("size"),
        F.coalesce(F.crc32(F.col("text").cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
    )
    placed = sharding.contiguous_shards(rows, "size", ["doc_id"], N_SHARDS)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op8_quality(spark: SparkSession, sf: str) -> DataFrame:
    docs = read(spark, sf, "documents").select("doc_id", "text")
    return quality.with_quality(docs, quality.train(docs, read(spark, sf, "labels")), keep=["doc_id"])


def op9_warc(spark: SparkSession, sf: str) -> DataFrame:
    return warc.read_archives(warc.write_archives(read(spark, sf, "pages")))


def labelled_urls(pages: DataFrame) -> DataFrame:
    host, _ = url_filter.host_and_path("url")
    words = F.split(host, "[.\\-]")
    return pages.select("url", F.arrays_overlap(words, F.array(*[F.lit(w) for w in BAD_HOST_WORDS])).alias("bad"))


def op10_url_filter(spark: SparkSession, sf: str) -> DataFrame:
    pages = read(spark, sf, "pages").select("page_id", "url")
    return url_filter.judged(pages, RULES, url_filter.train(labelled_urls(pages))).drop("url")


def op11_secret_scan(spark: SparkSession, sf: str) -> DataFrame:
    found = secrets.secrets(read(spark, sf, "documents"))
    return found.withColumn("spans", secrets.as_text("found")).drop("found")


def op12_centroid_clustering(spark: SparkSession, sf: str) -> DataFrame:
    found, model = centroids.clustered(read(spark, sf, "embeddings"))
    columns = ["cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    return centroids.with_totals(found, model).select(F.col("id").alias("vec_id"), *columns)


def op13_hard_negatives(spark: SparkSession, sf: str) -> DataFrame:
    vectors = read(spark, sf, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.hard_negatives(vectors, F.col("id") % 50 == 0, label=moved)


QUERIES = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_decontamination": op2_decontamination,
    "op3_token_counts": op3_token_counts,
    "op4_mixing": op4_mixing,
    "op5_chat_format": op5_chat_format,
    "op6_near_duplicates": op6_near_duplicates,
    "op7_sharding": op7_sharding,
    "op8_quality": op8_quality,
    "op9_warc": op9_warc,
    "op10_url_filter": op10_url_filter,
    "op11_secret_scan": op11_secret_scan,
    "op12_centroid_clustering": op12_centroid_clustering,
    "op13_hard_negatives": op13_hard_negatives,
}



def _clustering_sql(k: int = 16, rounds: int = 3, size: int = 64) -> str:
    """The rounds written out: assignment by the smallest distance, then floored means."""
    parts = [
        f"""kept as materialized (
            select vec_id, list_transform(embedding, lambda x: floor(64 * x::double)::bigint) as v from embeddings
            where len(embedding) = {size} and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = {size})""",
        f"""c0 as materialized (
            select row_number() over (order by sha256('1:' || vec_id), v) - 1 as c, v as m
            from kept qualify c < {k})""",
    ]
    for n in range(rounds + 1):
        parts.append(f"""a{n} as materialized (
            select vec_id, v, min(struct_pack(d, c)) as best from (
                select vec_id, v, c, list_sum(list_transform(list_zip(v, m), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::bigint as d
                from kept, c{n}) group by vec_id, v)""")
        if n < rounds:
            parts.append(f"""s{n} as materialized (
                select c, i, sum(x)::bigint as s, count(*) as n from (
                    select best.c as c, unnest(v) as x, unnest(range({size})) as i from a{n}) group by c, i)""")
            parts.append(f"""c{n + 1} as materialized (
                select o.c, coalesce(w.m, o.m) as m from c{n} o left join (
                    select c, list((s - ((s % n) + n) % n) // n order by i) as m from s{n} group by c) w on w.c = o.c)""")
    return "with " + ", ".join(parts) + f"""
        select vec_id, best.c::int as cluster, best.d::bigint as distance,
               sum(best.d) over (partition by best.c)::bigint as cluster_inertia, sum(best.d) over ()::bigint as inertia,
               sha256(array_to_string(m, ',')) as centroid_sha256
        from a{rounds} join c{rounds} f on f.c = best.c"""


_ESCAPED = r"replace(replace(replace({}, '\', '\b'), '<', '\l'), '>', '\g')"
_SHARES = ", ".join(f"('{name}', {i}, {share})" for i, (name, share) in enumerate({**SHARES, "*": REST}.items()))
_WEIGHTS = f"[{', '.join(str(n) for n in [*SHARES.values(), REST])}]"
_PERIOD = sum(SHARES.values()) + REST

ORACLE_SQL = {
    "op12_centroid_clustering": _clustering_sql(),
    "op13_hard_negatives": """
        with kept as materialized (
            select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
                   list_transform(embedding, lambda x: floor(256 * x::double)) as v
            from embeddings
            where label is not null and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = len(embedding)),
        scores as materialized (
            select a.vec_id as anchor_id, r.vec_id as id, a.label = r.label as same,
                   list_inner_product(a.v, r.v)::bigint as score
            from kept a join kept r on a.vec_id <> r.vec_id where a.vec_id % 50 = 0),
        positives as (
            select anchor_id, id as positive_id, score as positive_score from scores where same
            qualify row_number() over (partition by anchor_id order by score desc, id) <= 5)
        select p.anchor_id, positive_id,
               (row_number() over (partition by p.anchor_id, positive_id order by score desc, id))::int as rank,
               id as negative_id, positive_score, score as negative_score
        from positives p join scores s on s.anchor_id = p.anchor_id and not s.same
             and 50 * positive_score <= 100 * score and 100 * score <= 95 * positive_score
        qualify rank <= 3
    """,
    "op1_substring_dedup": """
        with texts as (
            select doc_id, hex(encode(coalesce(text, ''))) as hx from documents),
        windows as (
            select doc_id, i, substr(hx, 2 * i + 1, 100) as s
            from (select doc_id, hx, unnest(range(greatest(len(hx) // 2 - 49, 0))) as i from texts)),
        firsts as (select s, min(doc_id) as first from windows group by s),
        marked as (select w.doc_id, w.i from windows w join firsts f on f.s = w.s and f.first < w.doc_id),
        stepped as (
            select doc_id, i, case when i - lag(i) over (partition by doc_id order by i) <= 50 then 0 else 1 end as new
            from (select distinct doc_id, i from marked)),
        runs as (
            select doc_id, min(i) as a, max(i) + 50 as b
            from (select doc_id, i, sum(new) over (partition by doc_id order by i) as run from stepped)
            group by doc_id, run),
        gaps as (
            select doc_id, a, b, lag(b, 1, 0::bigint) over (partition by doc_id order by a) as until from runs),
        kept as (
            select t.doc_id, t.hx, coalesce(sum(g.b - g.a), 0) as n_removed, count(g.a) as n_spans,
                   coalesce(string_agg(substr(t.hx, 2 * g.until + 1, 2 * (g.a - g.until)), '' order by g.a), '')
                   || substr(t.hx, 2 * coalesce(max(g.b), 0) + 1) as left_over
            from texts t left join gaps g on g.doc_id = t.doc_id group by t.doc_id, t.hx)
        select doc_id, (len(hx) // 2)::bigint as n_bytes, n_removed::bigint as n_removed, n_spans::bigint as n_spans,
               sha256(unhex(left_over)) as kept_sha256
        from kept
    """,
    "op6_near_duplicates": r"""
        with recursive texts as (
            select doc_id, regexp_extract_all(
                translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[^\x20\x09-\x0D]+') as w from documents),
        sets as (
            select doc_id, list_distinct(case
                when len(w) = 0 then []
                when len(w) < 3 then [array_to_string(w, ' ')]
                else list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i+2], ' ')) end) as s from texts),
        counted as (select doc_id, len(s)::bigint as n from sets),
        owned as (select doc_id, unnest(s) as x from sets),
        links as (
            select a.doc_id as a, b.doc_id as b
            from owned a join owned b on a.x = b.x and a.doc_id < b.doc_id
            join counted ca on ca.doc_id = a.doc_id join counted cb on cb.doc_id = b.doc_id
            group by a.doc_id, b.doc_id, ca.n, cb.n
            having 100 * count(*) >= 85 * (ca.n + cb.n - count(*))),
        both_ways as (select a, b from links union all select b, a from links),
        reach(a, b) as (
            select doc_id, doc_id from documents
            union
            select r.a, l.b from reach r join both_ways l on l.a = r.b)
        select c.doc_id, c.n as n_shingles, min(r.b) as component_id, c.doc_id = min(r.b) as kept
        from counted c join reach r on r.a = c.doc_id group by c.doc_id, c.n
    """,
    "op4_mixing": f"""
        with recursive given(name, i, share) as (values {_SHARES}),
        sched(t, done, pick) as (
            select -1, list_transform({_WEIGHTS}, lambda x: 0), 0
            union all
            select t + 1, list_transform(range(1, len(done) + 1), lambda i: done[i] + case when i = p then 1 else 0 end), p
            from (
                select t, done, list_position(due, list_min(due)) as p
                from (
                    select t, done, list_transform(range(1, len(done) + 1), lambda i:
                        case when (done[i] * {_PERIOD}) // ({_WEIGHTS})[i] <= t + 1
                        then ((done[i] + 1) * {_PERIOD} + ({_WEIGHTS})[i] - 1) // ({_WEIGHTS})[i] end) as due
                    from sched where t < {_PERIOD - 1}))),
        slots as (
            select pick - 1 as i, t as slot, row_number() over (partition by pick order by t) - 1 as nth
            from sched where t >= 0),
        docs as (
            select d.*, coalesce(g.name, '*') as mix_source,
                   ('0x' || substr(md5('mix:' || coalesce(doc_id::varchar, '')), 1, 15))::bigint as h
            from documents d left join given g on g.name = d.source and g.name <> '*'),
        ranked as (
            select *, row_number() over (partition by mix_source order by h, doc_id) - 1 as k from docs),
        slotted as (
            select r.*, k // 16 as block, (k // 16) // g.share * {_PERIOD} + s.slot as mix_slot
            from ranked r join given g on g.name = mix_source
            join slots s on s.i = g.i and s.nth = (k // 16) % g.share)
        select doc_id, source, mix_source, block, mix_slot,
               row_number() over (order by mix_slot, k) - 1 as position
        from slotted
    """,
    "op5_chat_format": rf"""
        with rows as (
            select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
            union all
            select -7, i, r, '\### Assistant: </turn> ok' from (values (0, 'user'), (1, 'assistant')) v(i, r)),
        convs as (
            select conv_id, count(*) as n_turns,
                   sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
                   coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '') as learned,
                   sum(length('<turn ' || {_ESCAPED.format("role")} || '>' || {_ESCAPED.format("text")} || '</turn>' || chr(10)))
                       as formatted_chars,
                   list(role order by turn, role, text) as roles
            from rows group by conv_id)
        select conv_id, n_turns::bigint as n_turns, turns_sha256, length(learned)::bigint as loss_chars,
               sha256(learned) as loss_sha256, formatted_chars::bigint as formatted_chars,
               case when roles = ['user', 'assistant'] then 'prompt_response'
                    when roles = ['system', 'user', 'assistant'] then 'instruction'
                    when roles[-1] = 'user' and len(list_filter(roles, lambda r: r not in ('system', 'user', 'assistant'))) = 0
                    then 'conversations' else 'messages' end as layout
        from convs
    """,
}
