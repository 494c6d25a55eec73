"""Logs of flat envelopes: the working directory and the tool calls stand in records of their own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.hashing import short_digest
from tidemark.functions.redaction import redact
from tidemark.functions.text import base_name, session_from_stem, strip, token_estimate
from tidemark.functions.timez import parse_iso
from tidemark.sources.lines import carried, records, text_at
from tidemark.sources.nested_log import _blocks, iso

CALLS = ("function_call", "custom_tool_call", "local_shell_call")


def flatten(v: Column, path: str) -> Column:
    def part(b: Column) -> Column:
        said = strip(text_at(b, "$.text"))
        return F.when(text_at(b, "$.type").isin("input_text", "output_text", "text") & (said != ""), said)

    return F.coalesce(strip(text_at(v, path)), strip(F.array_join(F.array_compact(F.transform(_blocks(v, path), part)), "\n")), F.lit(""))


def parse(lines: DataFrame, source: str = "flat-log") -> tuple[DataFrame, DataFrame]:
    """Turns and per-file metrics of the lines of flat logs.

    The directory of the last context record holds for the messages after it. Tools called since the last accepted
    assistant message belong to the next one, as lines below its text too; tools after the last one are dropped. Keys are
    made of session, time, role and a number among equal ones, not of the text. Files are read whole.
    """
    def fields(v: Column) -> list[Column]:
        return [
            text_at(v, "$.type").alias("type"),
            text_at(v, "$.payload.type").alias("kind"),
            text_at(v, "$.payload.role").alias("role"),
            F.nullif(text_at(v, "$.payload.cwd"), F.lit("")).alias("cwd"),
            F.coalesce(F.nullif(text_at(v, "$.payload.name"), F.lit("")), text_at(v, "$.payload.tool_name")).alias("tool"),
            parse_iso(text_at(v, "$.timestamp")).alias("created_at"),
            flatten(v, "$.payload.content").alias("text"),
            F.schema_of_variant(F.try_variant_get(v, "$.payload", "variant")).startswith("OBJECT").alias("payload"),
        ]

    rows, metrics = records(lines, fields)
    context = F.coalesce(F.col("type") == "turn_context", F.lit(False))
    call = ~context & F.coalesce(F.col("kind").isin(*CALLS), F.lit(False))
    said = ~context & (F.col("kind") == "message") & F.col("role").isin("user", "assistant") & (F.col("text") != "") & F.col("created_at").isNotNull()
    rows = rows.withColumn("said", F.coalesce(said, F.lit(False))).withColumn("call", call)
    answer = F.when(F.col("said") & (F.col("role") == "assistant"), F.col("n"))
    # The directory in force, and the answer that came last before a record: calls after it belong to the next one.
    rows = carried(rows, here=(F.when(context, F.col("cwd")), True), turn_no=(answer, False)).withColumn("turn_no", F.coalesce("turn_no", F.lit(-1).cast("long")))
    tools = rows.where("call and tool is not null").groupBy("path", "turn_no").agg(F.array_sort(F.collect_list(F.struct("n", "tool"))).alias("t"))  # the calls of one answer
    tools = tools.select("path", "turn_no", F.transform("t", lambda x: x["tool"]).alias("names"))
    turns = rows.where("said").join(tools, ["path", "turn_no"], "left")
    turns = turns.withColumn("names", F.when(F.col("role") == "assistant", F.coalesce("names", F.array().cast("array<string>"))).otherwise(F.array().cast("array<string>")))
    masked = redact(F.col("text"))
    turns = turns.withColumn("_m", masked)
    full = F.concat(F.col("_m.text"), F.when(F.size("names") > 0, F.concat(F.lit("\n"), F.array_join(F.transform("names", lambda x: F.concat(F.lit("[tool:"), x, F.lit("]"))), "\n"))).otherwise(""))
    turns = turns.withColumn("session_id", session_from_stem(F.col("path"))).withColumn("full", F.translate(full, "\0", ""))
    turns = turns.withColumn("identity", F.concat_ws("|", "session_id", iso(F.col("created_at")), "role"))
    seq = F.row_number().over(Window.partitionBy("path", "identity").orderBy("n")) - 1
    turns = turns.withColumn("key", F.concat_ws("|", "identity", seq.cast("string")))
    out = turns.select(
        F.lit(source).alias("source"), "session_id", F.concat(F.lit(f"{source}:"), short_digest("key")).alias("source_key"), "role", F.col("full").alias("text"), "created_at",
        token_estimate(F.col("full")).alias("token_count"), F.lit("local").alias("token_source"), F.col("names").alias("tool_names"), F.col("here").alias("cwd"), base_name(F.col("here")).alias("project"),
        F.lit(None).cast("string").alias("git_branch"), F.col("_m.redactions").cast("int").alias("redactions"), "path", F.col("n").alias("line_no"),
    )
    quiet = F.col("said") | F.col("call") | (F.col("payload") & (context | F.coalesce(F.col("kind").isin("reasoning", "function_call_output", "custom_tool_call_output"), F.lit(False))))
    skipped = rows.where(~quiet).groupBy("path").agg(F.count("*").alias("lines_skipped"))
    out_metrics = metrics.join(skipped, "path", "left").withColumn("lines_skipped", F.coalesce("lines_skipped", F.lit(0).cast("long")))
    return out, out_metrics
