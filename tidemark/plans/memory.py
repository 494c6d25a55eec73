"""Queries over the long-term tier."""

from __future__ import annotations

import dataclasses

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.config import DEFAULTS
from tidemark.functions.hashing import hash_embedding
from tidemark.operators import cache, memories
from tidemark.session import tables

AS_OF = "2026-04-01 00:00:00"
ZONE = "America/New_York"
NEAR = 0.35  # inner product at which two test vectors of one label count as near


def _query(spark: SparkSession, sf: str) -> list[float]:
    return list(tables(spark, sf, "embeddings").where("vec_id = 0").select("embedding").first()[0])  # one vector


def _scored(df: DataFrame) -> DataFrame:
    return df.select("id", F.round("cosine_similarity", 6).alias("cosine_similarity"), F.round("decay_multiplier", 6).alias("decay_multiplier"), F.round("score", 6).alias("score"))


def _search(**filters: object):  # noqa: ANN202
    return lambda spark, sf: _scored(memories.search(tables(spark, sf, "memory_vectors"), _query(spark, sf), AS_OF, top_k=20, **filters))


def memory_topk_many(spark: SparkSession, sf: str) -> DataFrame:
    queries = tables(spark, sf, "embeddings").where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    return memories.search_many(tables(spark, sf, "memory_vectors"), queries, AS_OF, top_k=5).select("query_id", "rank", "id", F.round("score", 6).alias("score"))


def memory_list_recent(spark: SparkSession, sf: str) -> DataFrame:
    return memories.list_recent(tables(spark, sf, "memory_vectors"), AS_OF, limit=200).select("id", "namespace", "category", F.round("age_days", 6).alias("age_days"), F.round("decay_multiplier", 6).alias("decay_multiplier"))


def memory_nearest_open(spark: SparkSession, sf: str) -> DataFrame:
    return memories.nearest_open(tables(spark, sf, "memory_vectors"), _query(spark, sf)).select("namespace", "category", "id", F.round("similarity", 6).alias("similarity"))


def memory_preview_writes(spark: SparkSession, sf: str) -> DataFrame:
    rows = tables(spark, sf, "memory_vectors")
    writes = rows.where("valid_at is not null and embedding is not null").select(F.col("id").alias("write_id"), "namespace", "category", "embedding", (F.col("id") % 2 == 0).alias("supersede"))
    found = memories.preview_writes(rows, writes)
    return found.select("write_id", F.when(F.col("similarity").isNotNull() & (F.col("action") != "inserted"), F.col("nearest_id")).alias("nearest_id"), F.round("similarity", 6).alias("similarity"), "action")


def _labelled(spark: SparkSession, sf: str) -> DataFrame:
    return tables(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "embedding", F.col("label").cast("string").alias("category"), F.lit(None).cast("timestamp").alias("valid_at"))


def memory_duplicate_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return memories.duplicate_pairs(_labelled(spark, sf), NEAR).select("a", "b", F.round("similarity", 6).alias("similarity"))


def memory_greedy_merge(spark: SparkSession, sf: str) -> DataFrame:
    return memories.greedy_merge(_labelled(spark, sf), NEAR)


def memory_sequential_writes(spark: SparkSession, sf: str) -> DataFrame:
    prefs = tables(spark, sf, "extracted_preferences")
    rows = tables(spark, sf, "memory_vectors").withColumn("embedding", hash_embedding(F.col("content"), 64))
    at = F.to_timestamp(F.col("entry_date"))
    writes = prefs.where("entry_date is not null").select((F.col("pref_id") + 1).alias("write_id"), at.alias("written_at"), F.lit("operational").alias("namespace"), "category", "content", hash_embedding(F.col("content"), 64).alias("embedding"), F.lit(True).alias("supersede"))
    return memories.write_events(rows, writes).select("event", "seq", "id", "other")


def memory_timeline(spark: SparkSession, sf: str) -> DataFrame:
    return memories.timeline(tables(spark, sf, "memory_vectors"), "2026-02-15", ZONE).select("id", "wrote_that_day")


def memory_replacements(spark: SparkSession, sf: str) -> DataFrame:
    return memories.replacements(tables(spark, sf, "memory_vectors")).select("id", "superseded_by", "replaced_by_content", "replacement_open")


def memory_chains(spark: SparkSession, sf: str) -> DataFrame:
    return memories.supersession_chains(spark, tables(spark, sf, "memory_vectors"))


def memory_counts(spark: SparkSession, sf: str) -> DataFrame:
    return memories.counts(tables(spark, sf, "memory_vectors"))


def _cache(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    rows = tables(spark, sf, "embeddings")
    queries = rows.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("label").alias("fingerprint"), "embedding")
    entries = rows.where("vec_id % 100 != 0").select(F.col("vec_id").alias("entry_id"), F.col("label").alias("fingerprint"), "embedding", F.lit("2027-01-01").cast("timestamp").alias("expires_at"))
    return queries, entries


def cache_decision(spark: SparkSession, sf: str) -> DataFrame:
    settings = dataclasses.replace(DEFAULTS, cache_threshold=0.3, cache_margin=0.02)
    found = cache.decide(*_cache(spark, sf), AS_OF, settings)
    return found.select("query_id", "outcome", "served_id", F.round("best_similarity", 6).alias("best_similarity"), F.round("runner_up", 6).alias("runner_up"), "candidates")


def _questions(spark: SparkSession, sf: str) -> DataFrame:
    rows = tables(spark, sf, "eval_items")
    return rows.select(F.col("suite").alias("query_group"), F.col("item_text").alias("query"), hash_embedding(F.col("item_text"), 64).alias("embedding"), F.array("item_id").alias("result_ids"))


def cache_sweep(spark: SparkSession, sf: str) -> DataFrame:
    return cache.sweep(_questions(spark, sf))


def cache_separability(spark: SparkSession, sf: str) -> DataFrame:
    return cache.separability(cache.query_pairs(_questions(spark, sf)))


QUERIES = {
    "memory_topk_decay": _search(),
    "memory_topk_include_closed": _search(include_closed=True),
    "memory_topk_window": _search(within_days=30),
    "memory_topk_by_category": _search(categories=("coding_style", "schedule")),
    "memory_topk_by_namespace": _search(namespaces=("reflective",)),
} | {
    f.__name__: f
    for f in (memory_topk_many, memory_list_recent, memory_nearest_open, memory_preview_writes, memory_duplicate_pairs, memory_greedy_merge, memory_sequential_writes, memory_timeline, memory_replacements, memory_chains, memory_counts, cache_decision, cache_sweep, cache_separability)
}

_Q = "(select embedding::double[] from embeddings where vec_id = 0)"
_AGE = f"((epoch_us(timestamptz '{AS_OF}+00') - epoch_us(created_at)) / 86400e6)"
_MULT = f"(exp(-0.01 * decay_factor::double * {_AGE}) * case when valid_at is null then 1.0 else 0.25 end)"
_USABLE = "embedding is not null and len(embedding) = 64 and list_sum(list_transform(embedding::double[], lambda x: x * x)) > 0"


def _sql(where: str) -> str:
    return f"""
        select id, round(c, 6) as cosine_similarity, round(m, 6) as decay_multiplier, round(c * m, 6) as score
        from (select id, list_cosine_similarity(embedding::double[], {_Q}) as c, {_MULT} as m from memory_vectors where {_USABLE} and {where})
        order by c * m desc, id limit 20"""


ORACLES = {
    "memory_topk_decay": _sql("valid_at is null"),
    "memory_topk_include_closed": _sql("true"),
    "memory_topk_window": _sql(f"valid_at is null and created_at >= timestamptz '{AS_OF}+00' - interval 30 days"),
    "memory_topk_by_category": _sql("valid_at is null and category in ('coding_style', 'schedule')"),
    "memory_topk_by_namespace": _sql("valid_at is null and namespace in ('reflective')"),
    "memory_topk_many": f"""
        with s as (select q.vec_id as query_id, m.id, list_cosine_similarity(m.embedding::double[], q.embedding::double[]) * {_MULT} as score
                   from memory_vectors m, embeddings q where q.vec_id % 100 = 0 and valid_at is null and {_USABLE.replace('embedding', 'm.embedding')})
        select query_id, rank::int as rank, id, round(score, 6) as score
        from (select *, row_number() over (partition by query_id order by score desc, id) as rank from s) where rank <= 5""",
    "memory_list_recent": f"select id, namespace, category, round({_AGE}, 6) as age_days, round({_MULT}, 6) as decay_multiplier from memory_vectors order by created_at desc, id desc limit 200",
    "memory_nearest_open": f"""
        select namespace, category, id, round(c, 6) as similarity from (
          select *, row_number() over (partition by namespace, category order by c desc, id) as k
          from (select namespace, category, id, list_cosine_similarity(embedding::double[], {_Q}) as c from memory_vectors where valid_at is null and {_USABLE})) where k = 1""",
    "memory_preview_writes": f"""
        with w as (select id as write_id, namespace, category, embedding, id % 2 = 0 as s from memory_vectors where valid_at is not null and embedding is not null),
        o as (select * from memory_vectors where valid_at is null and embedding is not null and list_sum(list_transform(embedding::double[], lambda x: x * x)) > 0),
        p as (select write_id, s, id, case when list_sum(list_transform(w.embedding::double[], lambda x: x * x)) > 0
                then list_cosine_similarity(w.embedding::double[], o.embedding::double[]) else 0.0 end as c
              from w join o on w.namespace = o.namespace and w.category = o.category and len(w.embedding) = len(o.embedding)),
        b as (select *, row_number() over (partition by write_id order by c desc, id) as k from p)
        select w.write_id, case when b.c >= 0.8 or (w.s and b.c >= 0.75) then b.id end as nearest_id, round(b.c, 6) as similarity,
               case when b.c >= 0.8 then 'refreshed' when w.s and b.c >= 0.75 then 'superseded' else 'inserted' end as action
        from w left join (select * from b where k = 1) b on w.write_id = b.write_id""",
    "memory_duplicate_pairs": f"""
        select a.vec_id as a, b.vec_id as b, round(list_inner_product(a.embedding::double[], b.embedding::double[]), 6) as similarity
        from embeddings a join embeddings b on a.label = b.label and a.vec_id < b.vec_id
        where list_inner_product(a.embedding::double[], b.embedding::double[]) >= {NEAR}""",
    "memory_timeline": f"""
        select id, (created_at at time zone '{ZONE}')::date = date '2026-02-15' as wrote_that_day
        from memory_vectors where (created_at at time zone '{ZONE}')::date <= date '2026-02-15'""",
    "memory_replacements": """
        select a.id, a.superseded_by, b.content as replaced_by_content, case when b.id is not null then b.valid_at is null end as replacement_open
        from memory_vectors a left join memory_vectors b on a.superseded_by = b.id where a.superseded_by is not null""",
    "memory_chains": """
        with recursive c as (
          select id, superseded_by as last_id, 1 as steps from memory_vectors where superseded_by is not null
          union all
          select c.id, m.superseded_by, c.steps + 1 from c join memory_vectors m on c.last_id = m.id where m.superseded_by is not null and c.steps < 100)
        select id, last_id, steps from (select *, row_number() over (partition by id order by steps desc) as k from c) where k = 1""",
    "memory_counts": "select namespace, count(*) as total, count(*) filter (valid_at is null) as open from memory_vectors group by namespace",
    "cache_decision": """
        with p as (select q.vec_id as query_id, e.vec_id as entry_id, list_inner_product(q.embedding::double[], e.embedding::double[]) as s
                   from embeddings q join embeddings e on q.label = e.label where q.vec_id % 100 = 0 and e.vec_id % 100 <> 0),
        r as (select *, row_number() over (partition by query_id order by s desc, entry_id) as k, lead(s) over (partition by query_id order by s desc, entry_id) as n,
                     count(*) over (partition by query_id) as c from p),
        d as (select q.vec_id as query_id, r.s, r.n, r.entry_id, coalesce(r.c, 0) as c,
                     case when r.s is null then 'no_candidates' when r.s < 0.3 then 'below_threshold'
                          when r.n is not null and r.s - r.n < 0.02 then 'ambiguous' else 'served' end as outcome
              from embeddings q left join (select * from r where k = 1) r on q.vec_id = r.query_id where q.vec_id % 100 = 0)
        select query_id, outcome, case when outcome = 'served' then entry_id end as served_id, round(s, 6) as best_similarity, round(n, 6) as runner_up, c as candidates from d""",
}
