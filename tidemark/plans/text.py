"""Queries over documents, extraction results, attempts and preferences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.hashing import hash_embedding, stable_position
from tidemark.functions.redaction import redact
from tidemark.functions.text import token_estimate, unfence
from tidemark.functions.validation import FEELINGS, PAST_VERBS, TASK_MARKERS, TASK_OPENINGS, claims_feeling, is_transient
from tidemark.operators import evaluation, extraction
from tidemark.session import tables
from tidemark.sources import cursors

PRICES = {"quill-large": (3.0, 15.0), "quill-small-3b": (0.1, 0.4)}


def redact_documents(spark: SparkSession, sf: str) -> DataFrame:
    docs = tables(spark, sf, "documents").where("text is not null").select("doc_id", redact(F.col("text")).alias("m"))
    return docs.select("doc_id", "m.redactions", F.md5("m.text").alias("masked_md5"))


def token_counts(spark: SparkSession, sf: str) -> DataFrame:
    docs = tables(spark, sf, "documents").where("text is not null").select("source", token_estimate(F.col("text")).alias("t"))
    return docs.groupBy("source").agg(F.count("*").alias("documents"), F.sum("t").alias("tokens"), F.max("t").alias("most"))


def hash_embeddings(spark: SparkSession, sf: str) -> DataFrame:
    return tables(spark, sf, "memory_vectors").select("id", hash_embedding(F.col("content"), 64).alias("e")).select("id", F.round(F.aggregate("e", F.lit(0.0), lambda a, x: a + x * x), 4).alias("length"))


def validation_flags(spark: SparkSession, sf: str) -> DataFrame:
    return tables(spark, sf, "extracted_preferences").select("pref_id", is_transient(F.col("content")).alias("transient"), claims_feeling(F.col("content")).alias("feeling"))


def draft_validation(spark: SparkSession, sf: str) -> DataFrame:
    rows = extraction.validated(tables(spark, sf, "attempts").select("attempt_id", "raw"))
    return rows.select("attempt_id", "valid", "unfenced", F.array_join("violations", ",").alias("violations"))


def unfenced_replies(spark: SparkSession, sf: str) -> DataFrame:
    rows = tables(spark, sf, "attempts").where("raw is not null").select("attempt_id", unfence(F.col("raw")).alias("u"))
    return rows.select("attempt_id", "u.unfenced", F.length("u.text").alias("chars"))


def compliance_by_version(spark: SparkSession, sf: str) -> DataFrame:
    return extraction.compliance(tables(spark, sf, "extraction_results"), tables(spark, sf, "attempts"))


def failure_fields(spark: SparkSession, sf: str) -> DataFrame:
    return extraction.failure_fields(tables(spark, sf, "attempts"))


def first_attempt_confusion(spark: SparkSession, sf: str) -> DataFrame:
    return evaluation.confusion(tables(spark, sf, "extraction_results"), F.col("ok"), F.col("first_attempt_valid"))


def token_cost(spark: SparkSession, sf: str) -> DataFrame:
    rows = tables(spark, sf, "attempts").join(tables(spark, sf, "extraction_results").select("result_id", "model"), "result_id")
    return evaluation.token_cost(rows, PRICES).select("model", "input_tokens", "output_tokens", F.round("cost", 6).alias("cost"))


def last_extractions(spark: SparkSession, sf: str) -> DataFrame:
    rows = tables(spark, sf, "extraction_results")
    best = F.max_by("result_id", F.struct("extracted_at", "result_id"))
    return rows.groupBy("entry_date", "session_id").agg(best.alias("result_id"), F.count("*").alias("runs"))


def confident_preferences(spark: SparkSession, sf: str) -> DataFrame:
    rows = tables(spark, sf, "extracted_preferences").where("confidence >= 0.6")
    return rows.groupBy("category").agg(F.count("*").alias("preferences"), F.round(F.avg("confidence"), 6).alias("mean_confidence"))


def date_split(spark: SparkSession, sf: str) -> DataFrame:
    dates = tables(spark, sf, "extraction_results").select("entry_date").distinct()
    return dates.select("entry_date", F.when(stable_position(F.col("entry_date")) < 0.2, "holdout").otherwise("train").alias("part"))


def cursor_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Cursors as they stand after one file for each session of the delivered turns."""
    files = tables(spark, sf, "parsed_turns").groupBy("source", F.col("session_id").alias("path")).agg(F.sum(F.octet_length("text")).alias("bytes_read"), F.count("*").alias("turns_ingested"), F.max("arrived_at").alias("updated_at"))
    return cursors.summary(files).select("source", "files", "bytes_read", "turns", F.unix_micros("updated_at").alias("updated_us"))


QUERIES = {
    f.__name__: f
    for f in (redact_documents, token_counts, hash_embeddings, validation_flags, draft_validation, unfenced_replies, compliance_by_version, failure_fields, first_attempt_confusion, token_cost, last_extractions, confident_preferences, date_split, cursor_summary)
}


def _masks() -> str:
    from tidemark.functions.redaction import PATTERNS

    steps, text = [], "text"
    total = []
    for i, (_, pattern, to) in enumerate(PATTERNS):
        quoted = pattern.replace("'", "''")
        steps.append(f"t{i + 1} as (select *, regexp_replace(x{i}, '{quoted}', '{to.replace('$1', chr(92) + '1')}', 'g') as x{i + 1}, len(regexp_extract_all(x{i}, '{quoted}')) as n{i} from t{i})")
        total.append(f"n{i}")
    n = len(PATTERNS)
    return f"with t0 as (select doc_id, {text} as x0 from documents where text is not null), {', '.join(steps)} select doc_id, ({' + '.join(total)})::int as redactions, md5(x{n}) as masked_md5 from t{n}"


def _contains(col: str, parts: tuple[str, ...]) -> str:
    return "(" + " or ".join(f"contains({col}, '{p}')" for p in parts) + ")"


_VERBS = ", ".join(f"'{v}'" for v in PAST_VERBS)
_FENCED = r"regexp_full_match(raw, '(?s)\s*```(?:json)?\s*.*?\s*```\s*')"

ORACLES = {
    "redact_documents": _masks(),
    "token_counts": "select source, count(*) as documents, sum(t)::bigint as tokens, max(t) as most from (select source, greatest(1, ceil(length(text) / 3.0))::int as t from documents where text is not null) group by source",
    "validation_flags": rf"""
        select pref_id, ({" or ".join(f"starts_with(l, '{o}')" for o in TASK_OPENINGS)}
            or regexp_matches(l, '^(you\s+are|you''re|they\s+are|user\s+is)\s+\w+ing\b')
            or regexp_extract(l, '^(?:you|the user|user)\s+(\w+)\b', 1) in ({_VERBS}) or {_contains('content', TASK_MARKERS)}) as transient,
          {_contains('lower(content)', FEELINGS)} as feeling
        from (select *, trim(lower(content)) as l from extracted_preferences)""",
    "unfenced_replies": rf"""
        select attempt_id, {_FENCED} as unfenced,
          length(case when {_FENCED} then regexp_extract(raw, '(?s)^\s*```(?:json)?\s*(.*?)\s*```\s*$', 1) else raw end)::int as chars from attempts where raw is not null""",
    "compliance_by_version": """
        with a as (select result_id, count(*) as n, count(*) filter (unfenced) as f, coalesce(sum(input_tokens), 0) as i, coalesce(sum(output_tokens), 0) as o from attempts group by result_id)
        select coalesce(prompt_version, 'v1-unversioned') as prompt_version, count(*) as results, count(*) filter (first_attempt_valid) as first_ok, count(*) filter (ok) as eventual_ok,
          round(count(*) filter (first_attempt_valid) / count(*), 4) as first_attempt_rate, round(count(*) filter (ok) / count(*), 4) as eventual_rate,
          coalesce(sum(n), 0)::bigint as attempts_total, round(coalesce(sum(n), 0) / count(*), 3) as attempts_per_result, coalesce(sum(f), 0)::bigint as fenced,
          coalesce(sum(i), 0)::bigint as input_tokens, coalesce(sum(o), 0)::bigint as output_tokens
        from extraction_results r left join a on r.result_id = a.result_id group by 1""",
    "failure_fields": """
        select field, count(*) as n from (
          select trim(regexp_replace(string_split(line, ':')[1], '^- ', '')) as field from (select unnest(string_split(errors, chr(10))) as line from attempts where errors is not null))
        where field <> '' group by field order by n desc, field limit 8""",
    "first_attempt_confusion": """
        with c as (select count(*) filter (ok and first_attempt_valid) as tp, count(*) filter (not ok and first_attempt_valid) as fp,
                          count(*) filter (ok and not first_attempt_valid) as fn, count(*) filter (not ok and not first_attempt_valid) as tn from extraction_results)
        select tp, fp, fn, tn, round((tp + tn) / nullif(tp + fp + fn + tn, 0), 4) as accuracy, round(tp / nullif(tp + fp, 0), 4) as "precision", round(tp / nullif(tp + fn, 0), 4) as recall from c""",
    "token_cost": """
        select model, coalesce(sum(input_tokens), 0)::bigint as input_tokens, coalesce(sum(output_tokens), 0)::bigint as output_tokens,
          round(case model when 'quill-large' then sum(input_tokens) / 1e6 * 3.0 + sum(output_tokens) / 1e6 * 15.0 when 'quill-small-3b' then sum(input_tokens) / 1e6 * 0.1 + sum(output_tokens) / 1e6 * 0.4 end, 6) as cost
        from attempts join extraction_results using (result_id) group by model""",
    "last_extractions": "select entry_date, session_id, arg_max(result_id, (extracted_at, result_id)) as result_id, count(*) as runs from extraction_results group by 1, 2",
    "confident_preferences": "select category, count(*) as preferences, round(avg(confidence), 6) as mean_confidence from extracted_preferences where confidence >= 0.6 group by category",
    "cursor_summary": """
        select source, count(*) as files, sum(b)::bigint as bytes_read, sum(n)::bigint as turns, epoch_us(max(u)) as updated_us
        from (select source, session_id, sum(octet_length(encode(text))) as b, count(*) as n, max(arrived_at) as u from parsed_turns group by 1, 2) group by source""",
}
