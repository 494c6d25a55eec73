"""Logs of nested records: one response may be spread over several adjacent records that share a message id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.redaction import redact
from tidemark.functions.text import base_name, strip, token_estimate
from tidemark.functions.timez import parse_iso
from tidemark.sources.lines import carried, records, text_at

TOOL_IO_CHARS = 600


def _blocks(v: Column, path: str) -> Column:
    found = F.try_variant_get(v, path, "variant")
    return F.when(F.schema_of_variant(found).startswith("ARRAY"), F.try_variant_get(v, path, "array<variant>"))


def flatten(v: Column, path: str, *, tool_io: bool, thinking: bool) -> tuple[Column, Column]:
    """The text of a content field, and the names of the tools it calls."""

    def part(b: Column) -> Column:
        kind = text_at(b, "$.type")
        said, thought = strip(text_at(b, "$.text")), strip(text_at(b, "$.thinking"))
        out = F.when((kind == "text") & (said != ""), said)
        if thinking:
            out = out.when((kind == "thinking") & (thought != ""), F.concat(F.lit("[thinking] "), thought))
        out = out.when(kind == "tool_use", F.concat(F.lit("[tool:"), text_at(b, "$.name"), F.lit("]")))
        if tool_io:
            inner = F.transform(F.filter(_blocks(b, "$.content"), lambda x: text_at(x, "$.type") == "text"), lambda x: text_at(x, "$.text"))
            result = F.coalesce(strip(text_at(b, "$.content")), strip(F.array_join(F.filter(inner, lambda x: x != ""), "\n")))
            out = out.when((kind == "tool_result") & (result != ""), F.concat(F.lit("[tool_result] "), F.substring(result, 1, TOOL_IO_CHARS)))
        return out.when(kind == "image", "[image]")

    blocks = _blocks(v, path)
    text = F.coalesce(strip(text_at(v, path)), strip(F.array_join(F.array_compact(F.transform(blocks, part)), "\n")), F.lit(""))
    tools = F.array_compact(F.transform(F.filter(blocks, lambda b: text_at(b, "$.type") == "tool_use"), lambda b: text_at(b, "$.name")))
    return text, F.coalesce(tools, F.array().cast("array<string>"))


def iso(ts: Column) -> Column:
    """An instant as ISO-8601 with an offset; microseconds only where there are any."""
    return F.when(F.unix_micros(ts) % 1_000_000 == 0, F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'+00:00'")).otherwise(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'"))


def parse(lines: DataFrame, source: str = "nested-log", *, tool_io: bool = False, thinking: bool = False, sidechains: bool = False, strict_parity: bool = True) -> tuple[DataFrame, DataFrame]:
    """Turns (the schema of parsed turns) and per-file metrics of the lines of nested logs.

    Adjacent assistant records with one message id are one turn: texts and tools in order, usage and identity of the first.
    Blank lines and values that aren't objects don't part them, any other record does. A group whose first record alone
    is no turn is lost. In a hot file the last group is held back, and its file is read up to that group. With
    ``strict_parity`` the masks of the first record are counted again in a merged group; without it they aren't.
    """
    def fields(v: Column) -> list[Column]:
        text, tools = flatten(v, "$.message.content", tool_io=tool_io, thinking=thinking)
        return [
            text_at(v, "$.type").alias("type"),
            text_at(v, "$.message.role").alias("role"),
            F.when(text_at(v, "$.type") == "assistant", text_at(v, "$.message.id")).alias("mid"),
            F.coalesce(F.try_variant_get(v, "$.isMeta", "boolean"), F.lit(False)).alias("meta"),
            F.coalesce(F.try_variant_get(v, "$.isSidechain", "boolean"), F.lit(False)).alias("side"),
            parse_iso(text_at(v, "$.timestamp")).alias("created_at"),
            F.coalesce(F.nullif(F.try_variant_get(v, "$.sessionId", "string"), F.lit("")), F.lit("unknown")).alias("session_id"),
            F.nullif(text_at(v, "$.uuid"), F.lit("")).alias("uuid"),
            F.nullif(text_at(v, "$.cwd"), F.lit("")).alias("cwd"),
            F.nullif(text_at(v, "$.gitBranch"), F.lit("")).alias("git_branch"),
            F.try_variant_get(v, "$.message.usage.output_tokens", "int").alias("used"),
            text.alias("text"), tools.alias("tools"),
        ]

    rows, metrics = records(lines, fields)
    ok = F.col("type").isin("user", "assistant") & ~F.col("meta") & F.col("role").isin("user", "assistant") & (F.col("text") != "") & F.col("created_at").isNotNull()
    if not sidechains:
        ok = ok & ~F.col("side")
    # A record begins a group unless the one before it in the file bears the same message id; a group is named by its place.
    rows = carried(rows.withColumn("ok", ok), _before=(F.struct("mid"), False))
    fresh = F.col("mid").isNull() | F.col("_before.mid").isNull() | (F.col("_before.mid") != F.col("mid"))
    rows = carried(rows.withColumn("_fresh", F.when(fresh, F.col("n"))), island=(F.col("_fresh"), True))
    first = F.min_by(F.struct("ok", "role", "created_at", "session_id", "uuid", "cwd", "git_branch", "used", "text", "hot", "mid"), "n")
    groups = rows.groupBy("path", "island").agg(
        first.alias("f"), F.count("*").alias("records"), F.min("n").alias("n"), F.min("start").alias("start"),
        F.array_sort(F.collect_list(F.struct("n", "text", "tools"))).alias("parts"),  # the records of one response
    )
    last = groups.groupBy("path").agg(F.max("island").alias("island"))
    held = groups.where("f.hot and f.mid is not null").join(last, ["path", "island"], "left_semi").select("path", "island", F.col("start").alias("held"))
    kept = groups.join(held.select("path", "island"), ["path", "island"], "left_anti").where("f.ok")
    merged = strip(F.array_join(F.filter(F.transform("parts", lambda p: p["text"]), lambda t: t != ""), "\n"))
    own = redact(F.col("f.text"))
    both = redact(merged)
    one = F.col("records") == 1
    extra = own["redactions"] if strict_parity else F.lit(0)
    turns = kept.select(
        F.lit(source).alias("source"),
        F.col("f.session_id").alias("session_id"),
        F.coalesce(F.concat(F.lit(f"{source}:"), F.col("f.uuid")), F.concat_ws(":", F.lit(source), F.col("f.session_id"), iso(F.col("f.created_at")))).alias("source_key"),
        F.col("f.role").alias("role"),
        F.translate(F.when(one, own["text"]).otherwise(both["text"]), "\0", "").alias("text"),
        F.col("f.created_at").alias("created_at"),
        F.coalesce("f.used", token_estimate(own["text"])).alias("token_count"),
        F.when(F.col("f.used").isNotNull(), "provider").otherwise("local").alias("token_source"),
        F.flatten(F.transform("parts", lambda p: p["tools"])).alias("tool_names"),
        F.col("f.cwd").alias("cwd"),
        base_name(F.col("f.cwd")).alias("project"),
        F.col("f.git_branch").alias("git_branch"),
        F.when(one, own["redactions"]).otherwise(both["redactions"] + extra).cast("int").alias("redactions"),
        "path",
        F.col("n").alias("line_no"),
    )
    skipped = groups.where("not f.ok and f.mid is null").groupBy("path").agg(F.count("*").alias("lines_skipped"))
    out = metrics.join(held.select("path", "held"), "path", "left").join(skipped, "path", "left")
    return turns, out.select("path", F.coalesce("held", "bytes_read").alias("bytes_read"), "lines_read", F.coalesce("lines_skipped", F.lit(0).cast("long")).alias("lines_skipped"), "malformed_lines", "restarted")
