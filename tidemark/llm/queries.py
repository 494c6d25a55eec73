"""The queries of this package: each runs over the whole tables that TESTDATA.md names for its problem."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from secrets import token_hex

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import conversations, leakage, near_dup, neighbours, packing, personal, replies, secrets, shared_spans
from tidemark.session import cut, tables

TEXTS = (("session_turns", "id", "content"), ("parsed_turns", "delivery_id", "text"))
STATEMENTS = (("memory_vectors", "id"), ("extracted_preferences", "pref_id"))


def _each(spark: SparkSession, sf: str, which: tuple, run: Callable[..., DataFrame]) -> DataFrame:
    """The union of one operator's rows over several tables, with the table's name."""

    def part(name: str, *cols: str) -> DataFrame:
        return run(tables(spark, sf, name), *cols).select(F.lit(name).alias("record_table"), "*")

    # Steps that cut their lineage run at once; the tables then share the executors instead of waiting for each other.
    with ThreadPoolExecutor(len(which)) as pool:
        first, *rest = pool.map(lambda x: part(*x), which)
    for more in rest:
        first = first.unionByName(more)
    return first


def _names(spark: SparkSession, sf: str) -> list[str]:
    """The given names that both tables show."""
    first, second = (tables(spark, sf, name).select(F.col(text).alias("text")) for name, _, text in TEXTS)
    return personal.learn_names(first.unionByName(second), "text")


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    names = _names(spark, sf)
    return _each(spark, sf, TEXTS, lambda df, key, text: personal.find_personal(df, key, text, names=names))


def p1_redacted(spark: SparkSession, sf: str) -> DataFrame:
    """Under the key that the session names in ``spark.tidemark.pseudonym.key``, or one that is forgotten with it."""
    names, secret = _names(spark, sf), spark.conf.get("spark.tidemark.pseudonym.key", None) or token_hex(32)

    def run(df: DataFrame, key: str, text: str) -> DataFrame:
        return personal.redact_personal(df.select(F.col(key).alias("record_id"), F.col(text).alias("text")), "text", secret, names=names).select("record_id", "text_redacted", F.size("pii_found").alias("n_found"))

    return _each(spark, sf, TEXTS, run)


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return _each(spark, sf, STATEMENTS, lambda df, key: near_dup.similar_pairs(df, key, "content"))


def p2_groups(spark: SparkSession, sf: str) -> DataFrame:
    return _each(spark, sf, STATEMENTS, lambda df, key: near_dup.groups(df, key, "content", threshold=0.7))


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return replies.broken_pairs(tables(spark, sf, "attempts"), tables(spark, sf, "extraction_results"), tables(spark, sf, "documents"))


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return _each(spark, sf, TEXTS, lambda df, key, text: secrets.find_secrets(df, key, text).select("record_id", "line_no").dropDuplicates(["record_id", "line_no"]))


def p5_masked(spark: SparkSession, sf: str) -> DataFrame:
    def run(df: DataFrame, key: str, text: str) -> DataFrame:
        return secrets.mask_secrets(df.select(F.col(key).alias("record_id"), F.col(text).alias("text")), "text").select("record_id", "text_masked", "secrets_masked")

    return _each(spark, sf, TEXTS, run)


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    return conversations.broken_sessions(tables(spark, sf, "session_turns")).select("session_id")


def p6_conversations(spark: SparkSession, sf: str) -> DataFrame:
    return _talk(conversations.conversations(tables(spark, sf, "session_turns"), roles=conversations.TALK))


def p6_all_roles(spark: SparkSession, sf: str) -> DataFrame:
    return _talk(conversations.conversations(tables(spark, sf, "session_turns")))


def _talk(rows: DataFrame) -> DataFrame:
    return rows.select("session_id", "position", "role", "content", F.unix_micros("created_at").alias("created_us"), "id")


def p6_split_at_gaps(spark: SparkSession, sf: str) -> DataFrame:
    turns = tables(spark, sf, "session_turns")
    gap = conversations.calibrated_gap(conversations.clean_rows(turns))
    return conversations.conversations(turns, gap_seconds=gap).select("session_id", "part", "position", "role", "id")


def p6_roles(spark: SparkSession, sf: str) -> DataFrame:
    return conversations.infer_roles(tables(spark, sf, "session_turns"))


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    near = neighbours.nearest(tables(spark, sf, "memory_vectors"), "id", "embedding")
    return near.select(F.least("id", "neighbour").alias("id_a"), F.greatest("id", "neighbour").alias("id_b")).distinct()


def p7_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    return neighbours.nearest(tables(spark, sf, "memory_vectors"), "id", "embedding")


def p8_containers(spark: SparkSession, sf: str) -> DataFrame:
    return packing.pack(tables(spark, sf, "documents"), "doc_id", "text")


def p8_totals(spark: SparkSession, sf: str) -> DataFrame:
    """What must hold of any packing: every text is there once and whole, and no container holds more than it can."""
    docs = tables(spark, sf, "documents")
    placed = cut(packing.pack(docs, "doc_id", "text"))
    tokens = packing.token_counts(docs, "doc_id", "text").where("n_tokens > 0")
    whole = placed.groupBy("doc_id").agg(F.sum("size").alias("n"), F.count("*").alias("pieces"), F.sum(F.when(F.col("start") % 2048 == 0, 0).otherwise(1)).alias("odd"))
    docs_ok = whole.join(tokens, "doc_id", "full").agg(F.count("*").alias("texts"), F.count_if(~F.col("n").eqNullSafe(F.col("n_tokens")) | (F.col("pieces") != F.ceil(F.col("n_tokens") / 2048)) | (F.col("odd") > 0)).alias("texts_not_whole"))
    over = placed.groupBy("container", "capacity").agg(F.sum("size").alias("n")).agg(F.count_if(F.col("n") > F.col("capacity")).alias("containers_overfull"), (F.sum("n") < 0.98 * F.sum("capacity")).cast("long").alias("wasteful"))
    return docs_ok.crossJoin(F.broadcast(over))  # one row each


def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    return leakage.leaks(tables(spark, sf, "documents"), "doc_id", "text", tables(spark, sf, "eval_items"), "item_id", "item_text").select("doc_id", "item_id").distinct()


def p9_edited(spark: SparkSession, sf: str) -> DataFrame:
    return leakage.leaks(tables(spark, sf, "documents"), "doc_id", "text", tables(spark, sf, "eval_items"), "item_id", "item_text", q=8, edits=2)


def p10_found(spark: SparkSession, sf: str) -> DataFrame:
    return shared_spans.shared_spans(tables(spark, sf, "documents"), "doc_id", "text")


def p10_amounts(spark: SparkSession, sf: str) -> DataFrame:
    return shared_spans.shared_amounts(tables(spark, sf, "documents"), "doc_id", "text")


def p10_lines(spark: SparkSession, sf: str) -> DataFrame:
    return shared_spans.line_duplicates(tables(spark, sf, "documents"), "doc_id", "text", least_chars=1)


def p10_deduplicated(spark: SparkSession, sf: str) -> DataFrame:
    return shared_spans.without_later_lines(tables(spark, sf, "documents"), "doc_id", "text").select("doc_id", "text_kept")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (p1_found, p1_redacted, p2_found, p2_groups, p4_found, p5_found, p5_masked, p6_found, p6_conversations, p6_all_roles, p6_split_at_gaps, p6_roles, p7_found, p7_neighbours, p8_containers, p8_totals, p9_found, p9_edited, p10_found, p10_amounts, p10_lines, p10_deduplicated)
}
