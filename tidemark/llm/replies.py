"""Prompt and response pairs that are unusable, and why (problem 4).

Three small models are shipped whole: a naive Bayes classifier on character n-grams, whose posteriors for the prompt's
transcript and the reply's narrative are compared, and a classifier of sentences that decline a task, both fitted on a
bounded sample of labelled texts; and an end-of-text model, counted over all replies, which says how likely a text ends on
its last n-gram. Replies and prompts meet in one join on the result's id; the rest is a pass over
the rows.
"""

from __future__ import annotations

import json
import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.refusals import IDENTIFIER, fit_refusals, refused
from tidemark.operators.sampling import hash_sample

DEFECTS = ("empty", "refusal", "copied_prompt", "truncated", "other_language")
LANGUAGES = ("en", "de", "es", "zh")

SAYS_NOTHING = {"", "n/a", "na", "none", "null", "nil", "nothing", "empty", "undefined", "todo", "tbd", "no answer", "no response"}
LETTERS = re.compile(r"[^\W\d_]+")
FENCE = re.compile(r"^\s*```[\w-]*[ \t]*\r?\n?(.*?)\s*(?:```\s*)?$", re.DOTALL)
SPEAKER = re.compile(r"^\s*(?:[-*•]\s+|\[\w+\]\s*)")


def grams(text: str, most: int = 3) -> Iterator[str]:
    """The character n-grams of the words, without what reads as an identifier, path or number."""
    for word in LETTERS.findall(IDENTIFIER.sub(" ", text)):
        w = f" {word.lower()} "
        for n in range(1, most + 1):
            for i in range(len(w) - n + 1):
                yield w[i : i + n]


@dataclass
class Models:
    """The language model (gram -> log probability by language), the end-of-text model ((seen, at the end) by gram) and the
    weights of what declines a task."""

    languages: dict[str, tuple[float, ...]] = field(default_factory=dict)
    ends: dict[str, tuple[int, int]] = field(default_factory=dict)
    refusals: dict[str, float] = field(default_factory=dict)

    def posterior(self, text: str) -> tuple[str | None, float]:
        """The likeliest language and its posterior; none for a text without words."""
        total, any_ = [0.0] * len(LANGUAGES), False
        for g in grams(text):
            p = self.languages.get(g)
            if p is not None:
                any_ = True
                for i, x in enumerate(p):
                    total[i] += x
        if not any_:
            return None, 0.0
        top = max(total)
        weights = [math.exp(max(-700.0, x - top)) for x in total]
        best = weights.index(1.0)
        return LANGUAGES[best], 1.0 / sum(weights)

    def end_likelihood(self, text: str, least: int = 25) -> float:
        """How often texts end on the last n-gram of this one, for the longest n-gram that was seen often enough."""
        text = text.rstrip()
        for n in (3, 2, 1):
            seen, ended = self.ends.get(text[-n:], (0, 0)) if len(text) >= n else (0, 0)
            if seen >= least:
                return ended / seen
        return 1.0


def fit(labelled: list[tuple[str, str]], replies: Iterable[str] = (), *, ends: dict[str, tuple[int, int]] | None = None, features: int = 20_000) -> Models:
    """Models from (text, language) rows and from the counts of :func:`end_counts`, or of the given replies instead."""
    if ends is None:
        seen, ended = end_grams(read_reply(raw).text for raw in replies)
        ends = {g: (c, ended[g]) for g, c in seen.items()}
    counts = {x: Counter() for x in LANGUAGES}
    for text, lang in labelled:
        counts[lang].update(grams(text))
    total = Counter()
    for c in counts.values():
        total.update(c)
    kept = [g for g, _ in sorted(total.items(), key=lambda x: (-x[1], x[0]))[:features]]
    sums = {x: sum(counts[x][g] for g in kept) + 0.5 * len(kept) for x in LANGUAGES}
    languages = {g: tuple(math.log((counts[x][g] + 0.5) / sums[x]) for x in LANGUAGES) for g in kept}
    return Models(languages, ends, fit_refusals(t for t, _ in labelled))


def end_grams(texts: Iterable[str]) -> tuple[Counter, Counter]:
    """How often each n-gram of one to three signs stands in the texts, and how often at the end."""
    seen, ended = Counter(), Counter()
    for text in texts:
        text = text.rstrip()
        for n in (1, 2, 3):
            seen.update(map("".join, zip(*(text[i:] for i in range(n)))))
            if len(text) >= n:
                ended[text[-n:]] += 1
    return seen, ended


def end_counts(attempts: DataFrame, *, least: int = 25) -> dict[str, tuple[int, int]]:
    """(seen, at the end) of the n-grams that stand in all replies ``least`` times and at an end at least once.

    Every reply counts, whole. A partition adds up its own before anything is shuffled; what comes back is bounded by the
    signs of the languages, not by the replies.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen, ended = end_grams(read_reply(raw).text for raw in batch.column(0).to_pylist())
            keys = [*seen]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([seen[k] for k in keys], pa.int64()), pa.array([ended[k] for k in keys], pa.int64())], names=["gram", "seen", "ended"])

    counted = attempts.where("raw is not null").select("raw").mapInArrow(run, "gram string, seen long, ended long").groupBy("gram").agg(F.sum("seen").alias("seen"), F.sum("ended").alias("ended"))
    return {r["gram"]: (r["seen"], r["ended"]) for r in counted.where((F.col("seen") >= least) & (F.col("ended") > 0)).collect()}


@dataclass(frozen=True)
class Reply:
    text: str  # the narrative, or the whole reply if it has none
    kind: str  # "object", "json", "broken" or "prose"
    says: bool  # whether it says anything
    open_: bool = False  # whether brackets or strings are left open at the end


def _strings(x: object) -> Iterator[str]:
    if isinstance(x, str):
        yield x
    elif isinstance(x, dict):
        for v in x.values():
            yield from _strings(v)
    elif isinstance(x, list):
        for v in x:
            yield from _strings(v)
    elif x is not None and not isinstance(x, bool):
        yield str(x)


def _meaning(s: str) -> bool:
    plain = "".join(c for c in s if c.isalnum() or c in " /").strip().lower()
    return any(c.isalnum() for c in plain) and plain not in SAYS_NOTHING


def _left_open(s: str) -> bool:
    depth, inside, escaped = 0, False, False
    for c in s:
        if inside:
            if escaped:
                escaped = False
            elif c == "\\":
                escaped = True
            elif c == '"':
                inside = False
        elif c == '"':
            inside = True
        elif c in "{[":
            depth += 1
        elif c in "}]":
            depth -= 1
    return inside or depth > 0


def read_reply(raw: str | None) -> Reply:
    """What a reply says: fences are taken off, and JSON is read if it is JSON."""
    if raw is None:
        return Reply("", "prose", False)
    body = raw.strip().lstrip("﻿")
    fenced = FENCE.match(body) if body.startswith("```") else None
    if fenced:
        body = fenced[1].strip()
    try:
        value = json.loads(body)
    except ValueError:
        if body.startswith(("{", "[")):
            return Reply(body, "broken", _meaning(body), _left_open(body))
        return Reply(raw.strip(), "prose", _meaning(raw))
    says = any(_meaning(s) for s in _strings(value))
    if isinstance(value, dict):
        told = value.get("narrative")
        if isinstance(told, str) and _meaning(told):
            return Reply(told, "object", says)
        return Reply("\n".join(_strings(value)), "json", says)
    return Reply("\n".join(_strings(value)), "json", says)


def transcript(user: str) -> str:
    """The transcript in a user message, without speakers; the whole message if none is marked."""
    at = re.search(r"^.*TRANSCRIPT[^\n]*:[ \t]*$", user, re.MULTILINE)
    return "\n".join(SPEAKER.sub("", x) for x in (user[at.end() :] if at else user).split("\n"))


def copied_share(text: str, user: str) -> float:
    """The share of a text that is made of whole lines of the user message, in any case and order."""
    plain = " ".join(text.lower().replace("…", " ").split())
    if not plain:
        return 0.0
    lines = {" ".join(SPEAKER.sub("", x).lower().replace("…", " ").split()) for x in user.split("\n")} | {" ".join(x.lower().replace("…", " ").split()) for x in user.split("\n")}
    covered = bytearray(len(plain))
    for line in lines:
        if len(line) >= 8:
            at = plain.find(line)
            while at >= 0:
                covered[at : at + len(line)] = b"\1" * len(line)
                at = plain.find(line, at + len(line))
    return sum(covered) / len(plain)


def defect(raw: str | None, user: str | None, models: Models, *, copied: float = 0.5, end: float = 0.04, sure: float = 0.99) -> str | None:
    """The one defect of a reply to a user message, the first of ``DEFECTS`` that applies; none if it is sound."""
    reply = read_reply(raw)
    if not reply.says:
        return "empty"
    if reply.kind != "broken" and refused(reply.text, models.refusals):
        return "refusal"
    if user and copied_share(reply.text, user) >= copied:
        return "copied_prompt"
    if reply.kind == "broken":
        return "truncated" if reply.open_ else None
    if models.end_likelihood(reply.text) < end:
        return "truncated"
    if user:
        asked, p = models.posterior(transcript(user))
        told, q = models.posterior(reply.text)
        if asked and told and asked != told and p >= sure and q >= sure:
            return "other_language"
    return None


def training_texts(docs: DataFrame, *, per_language: int = 400, least: int = 200, most: int = 6000) -> list[tuple[str, str]]:
    """At most ``per_language`` labelled documents of each language, of ``least`` to ``most`` characters, first by a hash of their id."""
    lang = F.lower(F.trim("lang"))
    fit_ = docs.select("doc_id", lang.alias("lang")).where(F.col("n_chars").between(least, most) if "n_chars" in docs.columns else F.length("text").between(least, most))
    fit_ = fit_.where(F.col("lang").isin(*LANGUAGES))
    counts = {r["lang"]: r["count"] for r in fit_.groupBy("lang").count().collect()}
    ids: dict[int, str] = {}
    for x in sorted(counts):
        for r in hash_sample(fit_.where(F.col("lang") == x), ["doc_id"], per_language, total=counts[x]).select("doc_id").collect():
            ids[r["doc_id"]] = x
    if not ids:
        return []
    rows = docs.where(F.col("doc_id").isin([*ids])).select("doc_id", "text").collect()
    return [(r["text"], ids[r["doc_id"]]) for r in rows if r["text"]]


def broken_pairs(attempts: DataFrame, results: DataFrame, docs: DataFrame) -> DataFrame:
    """``result_id``, ``attempt_index``, ``defect``: a row for each attempt that is unusable.

    An attempt whose prompt is unknown or has no user message is judged by itself; the last user message counts. Null and
    blank replies are empty; a repeated attempt is judged each time; empty tables give no row. Other columns, also
    ``ok`` and ``errors``, aren't read.
    """
    models = docs.sparkSession.sparkContext.broadcast(fit(training_texts(docs), ends=end_counts(attempts)))  # bounded by the samples, the features and the signs
    users = F.filter("prompt_messages", lambda m: m["role"] == "user")
    prompts = results.select("result_id", F.when(F.size(users) > 0, F.element_at(users, -1)["content"]).alias("user")).where("result_id is not null").dropDuplicates(["result_id"])
    rows = attempts.select("result_id", F.col("attempt_index").cast("int"), "raw").join(prompts, "result_id", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = models.value
        for batch in batches:
            cols = [batch.column(i).to_pylist() for i in range(4)]
            out = [(r, i, d) for r, i, raw, user in zip(*cols, strict=True) if (d := defect(raw, user, known))]
            parts = list(zip(*out, strict=True)) or [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(parts[0], pa.int64()), pa.array(parts[1], pa.int32()), pa.array(parts[2], pa.string())], names=["result_id", "attempt_index", "defect"])

    return rows.select("result_id", "attempt_index", "raw", "user").mapInArrow(run, "result_id long, attempt_index int, defect string")
