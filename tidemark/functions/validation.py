"""Rules for what may be written: a column of the rules a row violates, empty for a sound row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.config import CATEGORIES

# Openings, verbs and markers of a passing task, and claims about feelings.
TASK_OPENINGS = ("fix ", "debug ", "finish ", "today ", "continue ")
PAST_VERBS = (
    "added", "created", "updated", "implemented", "wrote", "built", "changed", "removed", "deleted",
    "renamed", "moved", "installed", "configured", "deployed", "ran", "tested", "fixed", "refactored",
)
TASK_MARKERS = ("下一步的", "下一步要", "接下来要", "当前最重要", "待办", "尚未完成", "还没做完", "正在调试", "正在跑")
FEELINGS = (
    "you felt", "you were feeling", "you seemed", "you appeared", "frustrated",
    "anxious", "stressed", "burnt out", "burned out", "exhausted",
)


def _any_of(text: Column, parts: tuple[str, ...]) -> Column:
    found = F.contains(text, F.lit(parts[0]))
    for p in parts[1:]:
        found = found | F.contains(text, F.lit(p))
    return found


def is_transient(content: Column) -> Column:
    """Whether a preference describes a task of the day rather than a habit."""
    low = F.trim(F.lower(content))
    opening = F.startswith(low, F.lit(TASK_OPENINGS[0]))
    for o in TASK_OPENINGS[1:]:
        opening = opening | F.startswith(low, F.lit(o))
    going_on = low.rlike(r"^(you\s+are|you're|they\s+are|user\s+is)\s+\w+ing\b")
    done = F.regexp_extract(low, r"^(?:you|the user|user)\s+(\w+)\b", 1).isin(*PAST_VERBS)
    return opening | going_on | done | _any_of(content, TASK_MARKERS)


def claims_feeling(narrative: Column) -> Column:
    return _any_of(F.lower(narrative), FEELINGS)


def _violations(rules: dict[str, Column]) -> Column:
    return F.array_compact(F.array(*[F.when(F.coalesce(broken, F.lit(True)), F.lit(name)) for name, broken in rules.items()]))


def memory_violations(*, namespace: Column, category: Column, content: Column, decay_factor: Column, confirmed: Column) -> Column:
    allowed = F.lit(False)
    for name, categories in CATEGORIES.items():
        allowed = allowed | ((namespace == name) & category.isin(*categories))
    return _violations(
        {
            "namespace": ~namespace.isin(*CATEGORIES),
            "category": ~allowed,
            "confirmation": (namespace == "reflective") & ~F.coalesce(confirmed, F.lit(False)),
            "content": F.length(F.trim(content)) == 0,
            "decay_factor": decay_factor <= 0,
        }
    )


def candidate_violations(*, description: Column, evidence: Column, contexts: Column, confidence: Column) -> Column:
    """At least three and at most ten evidences of two dates and more, a context, a description of 10 to 500 characters."""
    return _violations(
        {
            "description": ~F.length(F.trim(description)).between(10, 500),
            "too_little_evidence": F.size(evidence) < 3,
            "too_much_evidence": F.size(evidence) > 10,
            "dates": F.size(F.array_distinct(F.transform(evidence, lambda e: e["source_date"]))) < 2,
            "contexts": F.size(F.filter(contexts, lambda c: F.trim(c) != "")) < 1,
            "confidence": ~confidence.between(0, 1),
        }
    )


def decision_violations(*, decision: Column, confirmed_content: Column) -> Column:
    return _violations(
        {
            "decision": ~decision.isin("confirm", "edit", "reject"),
            "wording": (decision == "edit") & ~F.coalesce(F.length(F.trim(confirmed_content)).between(10, 500), F.lit(False)),
            "length": confirmed_content.isNotNull() & ~F.length(F.trim(confirmed_content)).between(10, 500),
        }
    )


def draft_violations(draft: Column, keys: Column | None = None) -> Column:
    """Rules of an extracted diary entry; ``keys`` are the keys that the reply really had."""
    prefs = draft["preferences"]

    def blank(items: Column) -> Column:
        return F.exists(items, lambda x: x.isNull() | (F.trim(x) == ""))

    rules = {
        "narrative": draft["narrative"].isNull() | ~F.length(draft["narrative"]).between(40, 900),
        "feelings": claims_feeling(F.coalesce(draft["narrative"], F.lit(""))),
        "highlights": draft["highlights"].isNull() | ~F.size(draft["highlights"]).between(1, 6) | F.coalesce(blank(draft["highlights"]), F.lit(False)),
        "open_threads": draft["open_threads"].isNull() | (F.size(draft["open_threads"]) > 5) | F.coalesce(blank(draft["open_threads"]), F.lit(False)),
        "preferences": prefs.isNull() | (F.size(prefs) > 5),
        "preference_content": F.coalesce(F.exists(prefs, lambda p: p["content"].isNull() | ~F.length(p["content"]).between(4, 200)), F.lit(False)),
        "preference_transient": F.coalesce(F.exists(prefs, lambda p: is_transient(p["content"])), F.lit(False)),
        "preference_category": F.coalesce(F.exists(prefs, lambda p: p["category"].isNull() | ~p["category"].isin(*CATEGORIES["operational"])), F.lit(False)),
        "preference_confidence": F.coalesce(F.exists(prefs, lambda p: p["confidence"].isNull() | ~p["confidence"].between(0, 1)), F.lit(False)),
        "preference_evidence": F.coalesce(F.exists(prefs, lambda p: p["evidence"].isNull() | ~F.length(p["evidence"]).between(4, 400)), F.lit(False)),
    }
    if keys is not None:
        rules["extra_keys"] = F.size(F.array_except(keys, F.array(*map(F.lit, ("narrative", "highlights", "preferences", "open_threads"))))) > 0
    return _violations(rules)


def require_width(embedding: Column, dim: int) -> Column:
    """The embedding; a run fails on one of another width. Nulls pass."""
    right = embedding.isNull() | (F.size(embedding) == dim)
    error = F.raise_error(F.concat(F.lit(f"embedding must have {dim} numbers, not "), F.size(embedding).cast("string")))
    return F.when(right, embedding).otherwise(error.cast("array<float>"))
