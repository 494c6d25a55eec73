"""Prompts packed into a budget, replies validated and repaired, and what the attempts show."""

from __future__ import annotations

import json
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.text import one_line, token_estimate, unfence
from tidemark.functions.validation import draft_violations
from tidemark.schemas import DRAFT

UNVERSIONED = "v1-unversioned"
TOOL_ONLY = r"^(\[tool:[^\]]+\]\s*)+$"


def pack_prompts(turns: DataFrame, facts: DataFrame, keys: list[str], *, system_tokens: int, max_input_tokens: int = 12_000, per_turn_chars: int = 400) -> DataFrame:
    """The turns of each group that fit into its prompt: ``keys``, ``kind``, ``pos``, ``text``, ``cost``.

    User turns come first, up to all but 35 % of the budget if there is anything else; other turns are sampled evenly, at
    most about 40 of them, with what is left. Each list ends at the first turn that doesn't fit. ``facts`` has a ``facts``
    array for each group. Sums run over at most ``budget / 5`` turns of a group, since every turn costs five tokens.
    """
    flat = one_line(F.col("content"), per_turn_chars)
    role = F.when(F.col("role") == "user", "user").otherwise("assistant")
    rows = turns.withColumn("text", flat).where("text != ''").withColumn("kind", role)
    rows = rows.where((F.col("kind") == "user") | ~F.col("text").rlike(TOOL_ONLY)).withColumn("cost", token_estimate(F.col("text")) + 4)
    w = Window.partitionBy(*keys, "kind").orderBy("created_at", "id")
    rows = rows.withColumn("pos", F.row_number().over(w) - 1)
    n = rows.groupBy(*keys).agg(F.count_if(F.col("kind") == "assistant").alias("n_assistant"))
    fact_tokens = token_estimate(F.array_join("facts", "\n"))
    budget = (F.lit(max_input_tokens - system_tokens - 200) - fact_tokens).cast("int")
    per_group = n.join(facts, keys).withColumn("budget", budget).withColumn("reserve", F.when(F.col("n_assistant") > 0, (F.col("budget") * 0.35).cast("int")).otherwise(0))
    most = max_input_tokens // 5 + 1
    user = rows.where(F.col("kind") == "user").where(F.col("pos") < most).join(per_group.select(*keys, (F.col("budget") - F.col("reserve")).alias("room"), "reserve"), keys)
    running = F.sum("cost").over(Window.partitionBy(*keys).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
    user = user.withColumn("sum", running).where(F.col("sum") <= F.col("room"))
    spent = user.groupBy(*keys).agg(F.sum("cost").alias("spent"))
    other = rows.where(F.col("kind") == "assistant").join(per_group.join(spent, keys, "left").select(*keys, "n_assistant", (F.col("budget") - F.coalesce("spent", F.lit(0))).alias("room")), keys)
    stride = F.greatest(F.lit(1).cast("long"), F.floor(F.col("n_assistant") / 40))
    other = other.where(F.col("pos") % stride == 0).withColumn("sum", running).where((F.col("sum") <= F.col("room")) & (F.col("room") > 0))
    cols = [*keys, "kind", "pos", "text", "cost"]
    return user.select(*cols).unionByName(other.select(*cols))


def render(packed: DataFrame, facts: DataFrame, keys: list[str]) -> DataFrame:
    """``keys``, ``sampled``, ``prompt``: the user message of each group."""
    # What is gathered fits into the prompt's budget.
    lines = packed.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct((F.col("kind") != "user").alias("o"), "pos", F.concat(F.when(F.col("kind") == "user", "[you] ").otherwise("[assistant] "), F.col("text")).alias("t")))).alias("l"))
    head = F.concat_ws("\n", F.lit("FACTS:"), F.array_join(F.transform("facts", lambda f: F.concat(F.lit("- "), f)), "\n"))
    body = F.array_join(F.transform("l", lambda x: x["t"]), "\n")
    return facts.join(lines, keys, "left").select(*keys, F.coalesce(F.size("l"), F.lit(0)).alias("sampled"), F.concat(head, F.lit("\n\nTRANSCRIPT SAMPLE:\n"), F.coalesce(body, F.lit(""))).alias("prompt"))


def validated(replies: DataFrame, raw: str = "raw") -> DataFrame:
    """``replies`` with ``draft``, ``unfenced``, ``violations`` and ``valid``.

    A reply that isn't a JSON object of the right types violates ``json``; keys beyond the four are a violation too.
    """
    out = replies.withColumn("_u", unfence(F.col(raw)))
    keys = F.json_object_keys("_u.text")
    out = out.withColumn("draft", F.from_json("_u.text", DRAFT, {"mode": "PERMISSIVE"})).withColumn("_k", keys)
    broken = F.col("_k").isNull() | F.col("draft").isNull()
    found = F.when(broken, F.array(F.lit("json"))).otherwise(draft_violations(F.col("draft"), F.col("_k")))
    return out.withColumn("unfenced", F.col("_u.unfenced")).withColumn("violations", found).withColumn("valid", F.size("violations") == 0).drop("_u", "_k")


Provider = Callable[[list[dict[str, str]]], str]
ATTEMPTS = T.StructType([T.StructField("id", T.LongType()), T.StructField("attempt_index", T.IntegerType()), T.StructField("raw", T.StringType())])


def ask(prompts: DataFrame, make_provider: Callable[[], Provider], check: Callable[[str], str | None], *, max_attempts: int = 3) -> DataFrame:
    """Asks a provider for each prompt (``id``, ``system``, ``user``), at most ``max_attempts`` times until ``check`` finds no fault.

    The provider is made once in each Python worker; a fault is sent back with the reply. Every attempt is a row.
    """

    def run(batches):  # noqa: ANN001, ANN202
        provider = make_provider()
        for pdf in batches:
            rows = []
            for p in pdf.itertuples(index=False):
                messages = [{"role": "system", "content": p.system}, {"role": "user", "content": p.user}]
                for i in range(1, max_attempts + 1):
                    raw = provider(messages)
                    rows.append((p.id, i, raw))
                    fault = check(raw)
                    if fault is None:
                        break
                    messages += [{"role": "assistant", "content": raw}, {"role": "user", "content": f"The reply doesn't fit the schema.\n\nReply:\n{raw[:2000]}\n\nErrors:\n{fault}\n\nAnswer with the corrected JSON object only."}]
            yield pd.DataFrame(rows, columns=["id", "attempt_index", "raw"])

    return prompts.select("id", "system", "user").mapInPandas(run, ATTEMPTS)


class Scripted:
    """A provider that gives prepared replies in turn, the last one for ever."""

    def __init__(self, replies: list[str]) -> None:
        self.replies, self.at = replies, 0

    def __call__(self, messages: list[dict[str, str]]) -> str:
        reply = self.replies[min(self.at, len(self.replies) - 1)]
        self.at += 1
        return reply


def is_object(raw: str) -> str | None:
    """A cheap check for :func:`ask`: None if the reply is a JSON object, else what is wrong."""
    try:
        return None if isinstance(json.loads(raw), dict) else "- (root): not an object"
    except ValueError as e:
        return f"- (root): Invalid JSON: {e}"


def compliance(results: DataFrame, attempts: DataFrame) -> DataFrame:
    """For each prompt version: results, first attempts and results that were valid, rates, attempts, fences and tokens."""
    version = F.coalesce("prompt_version", F.lit(UNVERSIONED)).alias("prompt_version")
    per = attempts.groupBy("result_id").agg(F.count("*").alias("n"), F.count_if("unfenced").alias("f"), F.coalesce(F.sum("input_tokens"), F.lit(0)).alias("i"), F.coalesce(F.sum("output_tokens"), F.lit(0)).alias("o"))
    rows = results.select(version, "result_id", "ok", "first_attempt_valid").join(per, "result_id", "left")
    return rows.groupBy("prompt_version").agg(
        F.count("*").alias("results"),
        F.count_if("first_attempt_valid").alias("first_ok"),
        F.count_if("ok").alias("eventual_ok"),
        F.round(F.count_if("first_attempt_valid") / F.count("*"), 4).alias("first_attempt_rate"),
        F.round(F.count_if("ok") / F.count("*"), 4).alias("eventual_rate"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("attempts_total"),
        F.round(F.coalesce(F.sum("n"), F.lit(0)) / F.count("*"), 3).alias("attempts_per_result"),
        F.coalesce(F.sum("f"), F.lit(0)).alias("fenced"),
        F.coalesce(F.sum("i"), F.lit(0)).alias("input_tokens"),
        F.coalesce(F.sum("o"), F.lit(0)).alias("output_tokens"),
    )


def failure_fields(attempts: DataFrame, most: int = 8) -> DataFrame:
    """The fields named most often in schema errors; ties by name."""
    line = F.explode(F.split("errors", r"\r?\n"))
    field = F.trim(F.regexp_replace(F.substring_index(F.col("line"), ":", 1), r"^- ", ""))
    named = attempts.where("errors is not null").select(line.alias("line")).select(field.alias("field")).where("field != ''")
    return named.groupBy("field").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "field").limit(most)
