"""Conversations from message rows: order them, and drop those that are broken, empty or lack replies (problem 6).

All rows are sorted once by (channel, time, id) into range partitions, which cut a channel of any size at any row. A
partition then needs one thing from those before it: what their last rows left behind. That is one row for each
partition, carried forward on the driver, and the partitions are read a second time with their carry. So no task holds a
channel, whatever its share of all rows; the verdict of a channel is an aggregate with map-side combining.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext

from tidemark.session import cut

# White space, separators, control and format signs, and the letters that show nothing.
BLANK = r"^[\s\p{Z}\p{C}ᅟᅠ⠀ㅤﾠ]*$"
TALK = ("user", "assistant")  # the roles on which a conversation is judged
EDGES = r"^[\s\p{Z}\p{C}]+|[\s\p{Z}\p{C}]+$"


def is_blank(text: Column) -> Column:
    return text.isNull() | text.rlike(BLANK)


def plain_role(role: Column) -> Column:
    """The role trimmed and lower-cased; null where nothing is left."""
    return F.nullif(F.lower(F.regexp_replace(role, EDGES, "")), F.lit(""))


def clean_rows(turns: DataFrame) -> DataFrame:
    """The rows that count: of one source_key the lowest id, a channel, and something to read; role as :func:`plain_role`."""
    keep = ["id", "session_id", "role", "content", "created_at"]
    key = F.coalesce(F.concat(F.lit("k"), F.col("source_key")), F.concat(F.lit("i"), F.col("id").cast("string")))
    first = turns.select(key.alias("_key"), F.struct(*keep).alias("_row")).groupBy("_key").agg(F.min_by("_row", F.col("_row.id")).alias("_row"))
    rows = first.select("_row.*").where(F.col("session_id").isNotNull() & ~is_blank(F.col("content")))
    return rows.withColumn("role", plain_role(F.col("role")))


def _walk(channels: list, asked: np.ndarray, times: np.ndarray, gap_us: int | None, carry: tuple | None) -> tuple[dict[str, np.ndarray], tuple | None]:
    """For sorted rows: position and part within the channel, the pause before a row (-1 for a channel's first), the last
    ``asked`` of :data:`TALK` before it in its part, and whether a user row follows a user row.

    ``asked`` is 1 for a user's row, 0 for an assistant's and -1 for others, which are passed over. ``carry`` is (channel,
    rows so far, parts so far, last time, ``asked`` of the part's last row of :data:`TALK`) of the row before.
    """
    n = len(channels)
    if n == 0:
        none = np.zeros(0, np.int64)
        return {"part": none, "position": none, "pause": none, "before": none, "doubled": none.astype(bool)}, carry
    at, names = np.arange(n), np.array(channels, object)
    fresh = np.concatenate([[carry is None or carry[0] != names[0]], names[1:] != names[:-1]]).astype(bool)
    pause = np.diff(times, prepend=times[0] if fresh[0] else carry[3])
    split = ~fresh & (pause > gap_us) if gap_us is not None else np.zeros(n, bool)
    begun = np.maximum.accumulate(np.where(fresh | split, at, -1))  # where the part of a row began; -1: before these rows
    opened = np.maximum.accumulate(np.where(fresh, at, -1))
    splits = np.cumsum(split)
    position = np.where(begun >= 0, at - begun, at + (carry[1] if carry else 0))
    part = np.where(opened >= 0, splits - splits[np.maximum(opened, 0)], splits + (carry[2] if carry else 0))
    talk = np.concatenate([[-1], np.maximum.accumulate(np.where(asked >= 0, at, -1))[:-1]])
    kept = carry[4] if carry else -1
    before = np.where((talk >= 0) & (talk >= begun), asked[np.maximum(talk, 0)], np.where((begun < 0) & (talk < 0), kept, -1))
    last = (channels[-1], int(position[-1]) + 1, int(part[-1]), int(times[-1]), int(asked[-1] if asked[-1] >= 0 else before[-1]))
    return {"part": part, "position": position, "pause": np.where(fresh, -1, pause), "before": before, "doubled": (asked == 1) & (before == 1)}, last


def ordered_rows(rows: DataFrame, *, gap_seconds: float | None = None, partitions: int | None = None, roles: tuple[str, ...] | None = TALK, unknown: bool = False) -> DataFrame:
    """The rows of :func:`clean_rows` of the given roles (none: of any role, also without one if ``unknown``) with ``part``,
    ``position`` (from 0 in each part), ``pause`` (microseconds), ``before`` and ``doubled`` as :func:`_walk` gives them.

    With ``gap_seconds``, a channel is split where nothing was said for longer than that.
    """
    kept = F.lit(True) if unknown else F.col("role").isNotNull() if roles is None else F.col("role").isin(*roles)
    talk = rows.where(kept & F.col("created_at").isNotNull())
    n = partitions or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by = ["session_id", "created_at", "id"]
    ordered = cut(talk.select("session_id", "created_at", "id", "role", "content").repartitionByRange(n, *by).sortWithinPartitions(*by))
    gap_us = None if gap_seconds is None else int(gap_seconds * 1e6)

    def columns(batch: pa.RecordBatch) -> tuple[list, np.ndarray, np.ndarray]:
        return batch.column(0).to_pylist(), np.array([{"user": 1, "assistant": 0}.get(x, -1) for x in batch.column(3).to_pylist()], np.int64), np.array(batch.column(1).cast(pa.int64()))

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # What a partition leaves behind, counted from its own first row; whether it began where that channel began.
        first, first_time, last, n_splits = None, 0, None, 0
        for batch in batches:
            channels, asked, times = columns(batch)
            if not channels:
                continue
            if first is None:
                first, first_time = channels[0], int(times[0])
            _, last = _walk(channels, asked, times, gap_us, last)
        if first is not None:
            yield pa.RecordBatch.from_pydict({"at": [TaskContext.get().partitionId()], "first": [first], "first_time": [first_time], "last": [last[0]], "n": [last[1]], "part": [last[2]], "time": [last[3]], "asked": [last[4]]})

    thin = ordered.select("session_id", "created_at", "id", "role")
    schema = "at long, first string, first_time long, last string, n long, part long, time long, asked long"
    carries: dict[int, tuple] = {}
    carry: tuple | None = None
    for s in sorted(thin.mapInArrow(summarise, schema).collect(), key=lambda r: r["at"]):  # one row for each partition
        carries[s["at"]] = carry
        n_rows, part, asked = s["n"], s["part"], s["asked"]
        if carry is not None and s["first"] == s["last"] == carry[0]:
            split = gap_us is not None and s["first_time"] - carry[3] > gap_us
            if part == 0 and not split:
                n_rows += carry[1]
                asked = carry[4] if asked < 0 else asked
            part += carry[2] + int(split)
        carry = (s["last"], n_rows, part, s["time"], asked)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = carries.get(TaskContext.get().partitionId())
        for batch in batches:
            found, last = _walk(*columns(batch), gap_us, last)
            yield pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, found.values())], names=[*batch.schema.names, *found])

    return ordered.mapInArrow(number, "session_id string, created_at timestamp, id long, role string, content string, part long, position long, pause long, before long, doubled boolean")


def calibrated_gap(rows: DataFrame, *, quantile: float = 0.99, factor: float = 4.0, apart: float = 0.8) -> float:
    """Seconds of silence that end a conversation: ``factor`` times a high quantile of the pauses within conversations.

    Pauses of all channels count, over any hour and day. Where their logarithms fall into two classes (the best division
    explains at least ``apart`` of their variance; of one bell-shaped class it explains 0.64), only the shorter ones are
    pauses within conversations. Infinite without pauses.
    """
    pauses = cut(ordered_rows(rows.withColumn("content", F.lit("")), roles=None).where("pause >= 0").select((F.col("pause") / 1e6).alias("p")))
    counted = pauses.groupBy(F.floor(F.log2(F.greatest("p", F.lit(1e-6))) * 16).cast("int").alias("b")).count().collect()  # a few hundred at most
    if not counted:
        return float("inf")
    x = np.array(sorted((r["b"], r["count"]) for r in counted), float)
    n, total = x[:, 1], x[:, 1].sum()
    mean = (x[:, 0] * n).sum() / total
    spread = (((x[:, 0] - mean) ** 2) * n).sum()
    below, moment = np.cumsum(n)[:-1], np.cumsum(x[:, 0] * n)[:-1]
    between = below * (moment / below - mean) ** 2 + (total - below) * ((mean * total - moment) / (total - below) - mean) ** 2
    if len(between) and spread and between.max() >= apart * spread:
        pauses = pauses.where(F.floor(F.log2(F.greatest("p", F.lit(1e-6))) * 16) <= int(x[int(between.argmax()), 0]))
    return factor * float(pauses.agg(F.percentile_approx("p", quantile, 10_000)).first()[0])


# Other names of the two roles that talk.
ROLE_NAMES = {"human": "user", "customer": "user", "prompter": "user", "you": "user", "me": "user", "ai": "assistant", "bot": "assistant", "model": "assistant", "agent": "assistant", "gpt": "assistant", "chatbot": "assistant"}


def infer_roles(turns: DataFrame) -> DataFrame:
    """``id``, ``session_id``, ``role``, ``told_by``: the role of every row that has something to read, a channel and a time.

    Written roles stay (``written``), other names of them are replaced (``name``). A row without a role that names tools is
    the assistant's (``tools``). Any other answers whoever spoke last before it in its channel (``turn``): the assistant
    after a user, else the user. Blank rows and later copies of a source_key are left out as in :func:`clean_rows`.
    """
    other = F.create_map(*[F.lit(x) for pair in ROLE_NAMES.items() for x in pair])
    named = clean_rows(turns).withColumn("written", F.col("role"))
    tools = turns.where(F.size("tool_names") > 0).select("id", F.lit(True).alias("has_tools")).distinct()
    named = named.join(tools, "id", "left")
    role = F.coalesce(other[F.col("role")], F.col("role"), F.when(F.col("has_tools"), F.lit("assistant")))
    # What is known already comes along in the place of the text, which takes no part here.
    how = F.when(other[F.col("written")].isNotNull(), "name").when(F.col("written").isNotNull(), "written").when(F.col("has_tools"), "tools").otherwise("turn")
    rows = ordered_rows(named.withColumn("content", how).withColumn("role", role), roles=None, unknown=True)
    answer = F.when(F.col("before") == 1, "assistant").otherwise("user")
    return rows.select("id", "session_id", F.coalesce("role", answer).alias("role"), F.col("content").alias("told_by"))


def broken_sessions(turns: DataFrame) -> DataFrame:
    """``session_id`` and ``reason`` of each conversation to drop.

    Reasons, the first that holds: ``incomplete_row`` (a row without role or time), ``empty``, ``no_question`` (it doesn't
    begin with a user's row), ``no_reply`` (a user's row without an assistant's before the next or the end). Rows without
    session_id belong to none; rows of one source_key count once; ties in time go by id; an empty table gives no row.
    """
    channels = turns.where(F.col("session_id").isNotNull()).groupBy("session_id").agg(F.max(plain_role(F.col("role")).isNull() | F.col("created_at").isNull()).alias("incomplete"))
    at = F.struct("created_at", "id")
    talk = (
        ordered_rows(clean_rows(turns).withColumn("content", F.lit("")))
        .groupBy("session_id")
        .agg(F.max("doubled").alias("doubled"), F.min_by("role", at).alias("first"), F.max_by("role", at).alias("last"))
    )
    reason = (
        F.when(F.col("incomplete"), "incomplete_row")
        .when(F.col("first").isNull(), "empty")
        .when(F.col("first") != "user", "no_question")
        .when(F.col("doubled") | (F.col("last") == "user"), "no_reply")
    )
    return channels.join(talk, "session_id", "left").select("session_id", reason.alias("reason")).where("reason is not null")


def conversations(turns: DataFrame, *, gap_seconds: float | None = None, roles: tuple[str, ...] | None = None) -> DataFrame:
    """``session_id``, ``part``, ``position``, ``role``, ``content``, ``created_at``, ``id`` of the sound conversations.

    Without ``gap_seconds`` a channel is one conversation; with it, each part is judged alone: it must begin with a user's
    row and answer every one. Only the rows of :data:`TALK` are judged, but all readable rows (tools, system) are numbered
    and returned, unless ``roles`` names those to keep.
    """
    rows = ordered_rows(clean_rows(turns), gap_seconds=gap_seconds, roles=roles)
    bad_rows = turns.where(F.col("session_id").isNotNull() & (plain_role(F.col("role")).isNull() | F.col("created_at").isNull())).select("session_id").distinct()
    at = F.when(F.col("role").isin(*TALK), F.col("position"))
    verdict = rows.groupBy("session_id", "part").agg(F.max("doubled").alias("d"), F.min_by("role", at).alias("f"), F.max_by("role", at).alias("l"))
    sound = verdict.where("not d and f = 'user' and l = 'assistant'").select("session_id", "part")
    return rows.join(sound, ["session_id", "part"]).join(bad_rows, "session_id", "left_anti").select("session_id", "part", "position", "role", "content", "created_at", "id")
