"""T3: decayed search, listing, nearest open memory, sequential writes and the event log behind them."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.config import DEFAULTS, Settings
from tidemark.functions.decay import age_days, instant, multiplier
from tidemark.functions.timez import local_date
from tidemark.functions.vectors import cosine
from tidemark.operators.graph import components
from tidemark.session import cut


def filtered(memories: DataFrame, as_of: Column, *, include_closed: bool = False, within_days: int | None = None, namespaces: Sequence[str] | None = None, categories: Sequence[str] | None = None) -> DataFrame:
    """An absent or empty filter lets everything pass."""
    if not include_closed:
        memories = memories.where(F.col("valid_at").isNull())
    if within_days is not None:
        memories = memories.where(F.col("created_at") >= as_of - F.make_dt_interval(F.lit(within_days)))
    if namespaces:
        memories = memories.where(F.col("namespace").isin(*namespaces))
    if categories:
        memories = memories.where(F.col("category").isin(*categories))
    return memories


def decayed(memories: DataFrame, as_of: Column, settings: Settings = DEFAULTS) -> DataFrame:
    """With ``age_days`` and ``decay_multiplier``."""
    aged = memories.withColumn("age_days", age_days(F.col("created_at"), as_of))
    return aged.withColumn("decay_multiplier", multiplier(F.col("age_days"), F.col("decay_factor"), F.col("valid_at"), per_day=settings.decay_per_day, closed_penalty=settings.closed_penalty))


def search(memories: DataFrame, query: Sequence[float], as_of: dt.datetime | str, *, top_k: int = 5, settings: Settings = DEFAULTS, **filters: object) -> DataFrame:
    """The ``top_k`` memories by cosine times decay; ties go to the lower id. Zero and wrongly sized vectors have no score."""
    if not 1 <= top_k <= 50:
        raise ValueError("top_k must be 1 to 50")
    at = instant(as_of)
    vector = F.array(*[F.lit(float(x)) for x in query])
    rows = filtered(memories, at, **filters).withColumn("cosine_similarity", cosine(F.col("embedding"), vector))
    rows = decayed(rows, at, settings).withColumn("score", F.col("cosine_similarity") * F.col("decay_multiplier"))
    return rows.where("score is not null").orderBy(F.desc("score"), "id").limit(top_k)


def search_many(memories: DataFrame, queries: DataFrame, as_of: dt.datetime | str, *, top_k: int = 5, settings: Settings = DEFAULTS, **filters: object) -> DataFrame:
    """:func:`search` for every row (``query_id``, ``vector``) of a small table, which is sent to the memories in blocks of 256.

    Within a partition of memories a query keeps its ``top_k``; so what is ranked at the end is bounded by the partitions.
    """
    at = instant(as_of)
    rows = decayed(filtered(memories, at, **filters), at, settings).select("id", "embedding", "decay_multiplier")
    block: list = []
    out: DataFrame | None = None

    def score(block: list) -> DataFrame:
        ids = np.array([r["query_id"] for r in block], np.int64)
        q = np.array([r["vector"] for r in block], np.float64)
        q /= np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-300)

        def run(batches):  # noqa: ANN001, ANN202
            for pdf in batches:
                pdf = pdf[[v is not None and len(v) == q.shape[1] and bool(np.any(v)) for v in pdf["embedding"]]]
                if pdf.empty:
                    continue
                x = np.stack(pdf["embedding"].to_numpy()).astype(np.float64)
                s = (q @ (x / np.linalg.norm(x, axis=1, keepdims=True)).T) * pdf["decay_multiplier"].to_numpy()
                order = np.lexsort((np.broadcast_to(pdf["id"].to_numpy(), s.shape), -s), axis=1)[:, :top_k]
                yield pd.DataFrame({"query_id": np.repeat(ids, order.shape[1]), "id": pdf["id"].to_numpy()[order].ravel(), "score": np.take_along_axis(s, order, 1).ravel()})

        return rows.mapInPandas(run, "query_id long, id long, score double")

    for r in queries.select("query_id", "vector").toLocalIterator():
        block.append(r)
        if len(block) == 256:
            out = score(block) if out is None else out.unionByName(score(block))
            block = []
    if block:
        out = score(block) if out is None else out.unionByName(score(block))
    if out is None:
        return memories.sparkSession.createDataFrame([], "query_id long, id long, score double, rank int")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top_k)


def list_recent(memories: DataFrame, as_of: dt.datetime | str, *, limit: int = 50, include_closed: bool = True, namespaces: Sequence[str] | None = None, settings: Settings = DEFAULTS) -> DataFrame:
    """The newest memories with their decay."""
    if not 1 <= limit <= 200:
        raise ValueError("limit must be 1 to 200")
    at = instant(as_of)
    return decayed(filtered(memories, at, include_closed=include_closed, namespaces=namespaces), at, settings).orderBy(F.desc("created_at"), F.desc("id")).limit(limit)


def nearest_open(memories: DataFrame, query: Sequence[float]) -> DataFrame:
    """For each namespace and category the open memory most similar to a vector; ties go to the lowest id."""
    sim = cosine(F.col("embedding"), F.array(*[F.lit(float(x)) for x in query]))
    scored = memories.where("valid_at is null").select("namespace", "category", "id", sim.alias("similarity")).where("similarity is not null")
    best = F.max_by(F.struct("id", "similarity"), F.struct("similarity", (-F.col("id")).alias("i")))
    return scored.groupBy("namespace", "category").agg(best.alias("b")).select("namespace", "category", "b.id", "b.similarity")


def classify(similarity: Column, *, supersede: Column, settings: Settings = DEFAULTS) -> Column:
    """What a write does next to its nearest open memory: refresh it, supersede it, or stand beside it."""
    return (
        F.when(similarity >= settings.dedup_threshold, "refreshed")
        .when(supersede & (similarity >= settings.conflict_threshold), "superseded")
        .otherwise("inserted")
    )


def preview_writes(memories: DataFrame, writes: DataFrame, settings: Settings = DEFAULTS, *, block: int = 20_000) -> DataFrame:
    """``write_id``, ``nearest_id``, ``similarity``, ``action`` of each write against the store as it stands.

    Writes meet the open memories of their own namespace and category only. Both sides of a category are compared block by
    block; a write keeps the best of each block, so one row for each block is all that is shuffled.
    """
    key = F.concat_ws("|", "namespace", "category").alias("_k")
    open_ = memories.where("valid_at is null").select(key, "id", "embedding")
    sizes = open_.groupBy("_k").agg(F.ceil(F.count("*") / block).alias("_n"))
    spread = open_.join(sizes, "_k").withColumn("_b", F.pmod(F.xxhash64("id"), F.col("_n"))).drop("_n")
    copied = writes.select(key, "write_id", F.col("embedding").alias("_v")).join(sizes, "_k")
    copied = copied.withColumn("_b", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1))).drop("_n")

    def best(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"write_id": pd.Series(dtype="int64"), "nearest_id": pd.Series(dtype="int64"), "similarity": pd.Series(dtype="float64")})
        if left.empty or right.empty:
            return empty
        widths = left["_v"].map(len)
        parts = []
        for width in widths.unique():
            a = left[widths == width]
            b = right[right["embedding"].map(lambda v, w=width: v is not None and len(v) == w and bool(np.any(v)))].sort_values("id")
            if b.empty:
                continue
            x, y = np.stack(a["_v"]).astype(np.float64), np.stack(b["embedding"]).astype(np.float64)
            s = (x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)) @ (y / np.linalg.norm(y, axis=1, keepdims=True)).T
            at = s.argmax(axis=1)
            parts.append(pd.DataFrame({"write_id": a["write_id"].to_numpy(), "nearest_id": b["id"].to_numpy()[at], "similarity": s[np.arange(len(a)), at]}))
        return pd.concat(parts) if parts else empty

    found = copied.groupBy("_k", "_b").cogroup(spread.groupBy("_k", "_b")).applyInPandas(best, "write_id long, nearest_id long, similarity double")
    top = found.groupBy("write_id").agg(F.max_by(F.struct("nearest_id", "similarity"), F.struct("similarity", (-F.col("nearest_id")).alias("i"))).alias("b"))
    out = writes.select("write_id", F.coalesce("supersede", F.lit(False)).alias("_s")).join(top, "write_id", "left")
    sim = F.col("b.similarity")
    return out.select("write_id", F.col("b.nearest_id").alias("nearest_id"), sim.alias("similarity"), F.coalesce(classify(sim, supersede=F.col("_s")), F.lit("inserted")).alias("action"))


EVENTS = "event string, event_ts timestamp, seq long, id long, other long, namespace string, category string, content string, embedding array<float>, decay_factor float"


def block_pairs(rows: DataFrame, threshold: float, *, unit: bool, block: int = 2000, negative_only: bool = False) -> DataFrame:
    """``a`` < ``b``, ``similarity`` of the rows (``k``, ``id``, ``embedding``) of one key that are similar enough.

    Keys are cut into blocks by a hash of the id and each pair of blocks is one task of bounded size. With ``unit``,
    vectors are brought to unit length first; rows without a direction or of another width have no pairs. With
    ``negative_only``, rows of negative ids are compared with all rows and the others not among themselves: blocks hold
    one kind, and a pair of blocks without a negative one is no task.
    """
    usable = rows.where(F.col("embedding").isNotNull() & F.exists("embedding", lambda x: x != 0))
    if negative_only:
        # Blocks of negative rows come first; a block of the others meets those alone.
        kinds = usable.groupBy("k").agg(F.ceil(F.count_if(F.col("id") < 0) / block).alias("m"), F.ceil(F.count_if(F.col("id") >= 0) / block).alias("n")).where("m > 0")
        cells = usable.join(kinds, "k").withColumn("mine", F.when(F.col("id") < 0, F.pmod(F.xxhash64("id"), F.col("m"))).otherwise(F.col("m") + F.pmod(F.xxhash64("id"), F.greatest(F.col("n"), F.lit(1)))))
        others = F.sequence(F.lit(0).cast("long"), F.when(F.col("id") < 0, F.col("m") + F.col("n")).otherwise(F.col("m")) - 1)
    else:
        sizes = usable.groupBy("k").agg(F.greatest(F.lit(1).cast("long"), F.ceil(F.count("*") / block)).alias("n"))
        cells = usable.join(sizes, "k").withColumn("mine", F.pmod(F.xxhash64("id"), F.col("n")))
        others = F.sequence(F.lit(0).cast("long"), F.col("n") - 1)
    tasks = cells.withColumn("o", F.explode(others)).select("k", F.least("mine", "o").alias("x"), F.greatest("mine", "o").alias("y"), "mine", "id", "embedding")

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        parts = [pd.DataFrame({"a": pd.Series(dtype="int64"), "b": pd.Series(dtype="int64"), "similarity": pd.Series(dtype="float64")})]
        widths = pdf["embedding"].map(len)
        for width in widths.unique():
            p = pdf[widths == width]
            ids, mine = p["id"].to_numpy(), p["mine"].to_numpy()
            v = np.stack(p["embedding"]).astype(np.float64)
            if unit:
                v /= np.linalg.norm(v, axis=1, keepdims=True)
            s = v @ v.T
            i, j = np.nonzero((s >= threshold) & (ids[:, None] < ids[None, :]) & ((mine[:, None] != mine[None, :]) | (key[1] == key[2])))
            parts.append(pd.DataFrame({"a": ids[i], "b": ids[j], "similarity": s[i, j]}))
        return pd.concat(parts)

    return tasks.groupBy("k", "x", "y").applyInPandas(run, "a long, b long, similarity double")


def write_events(memories: DataFrame, writes: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """The events of writing ``writes`` one after the other (by ``written_at``, ``write_id``) onto the open memories.

    The order matters only among rows that are similar enough to refresh or supersede each other. So the similar pairs of
    a namespace and category are found block by block, and each connected set of them is played through by itself; a
    write that is like nothing is an insertion. A new memory gets the id ``-write_id``.
    """
    key = F.concat_ws("|", "namespace", "category").alias("k")
    nodes = memories.where("valid_at is null and id >= 0").select(key, "id", "embedding").unionByName(writes.select(key, (-F.col("write_id")).alias("id"), "embedding"))
    pairs = cut(block_pairs(nodes, min(settings.conflict_threshold, settings.dedup_threshold), unit=True, negative_only=True).where("a < 0"))
    label = components(pairs)
    facts = writes.select((-F.col("write_id")).alias("node"), "written_at", F.coalesce("supersede", F.lit(False)).alias("supersede"))
    linked = label.join(facts, "node", "left").select("component", F.struct("node", "written_at", "supersede").alias("w"))
    people = linked.groupBy("component").agg(F.collect_list("w").alias("nodes"))  # one connected set
    ties = pairs.join(label.select(F.col("node").alias("a"), "component"), "a").groupBy("component").agg(F.collect_list(F.struct("a", "b", "similarity")).alias("ties"))

    def play(batches):  # noqa: ANN001, ANN202
        for pdf in batches:
            rows = []
            for nodes_, ties_ in zip(pdf["nodes"], pdf["ties"], strict=True):
                near: dict[int, list[tuple[float, int]]] = {}
                for t in ties_:
                    near.setdefault(t["a"], []).append((t["similarity"], t["b"]))
                    near.setdefault(t["b"], []).append((t["similarity"], t["a"]))
                alive = {n["node"] for n in nodes_ if n["node"] >= 0}
                for n in sorted((n for n in nodes_ if n["node"] < 0), key=lambda n: (n["written_at"], -n["node"])):
                    # Of equal similarity the older memory counts: stored ones by id, then new ones in order of writing.
                    found = [(-s, o < 0, abs(o), o) for s, o in near.get(n["node"], ()) if o in alive]
                    best = min(found) if found else None
                    if best and -best[0] >= settings.dedup_threshold:
                        rows.append((n["node"], "refreshed", best[3], None))
                        continue
                    rows.append((n["node"], "inserted", n["node"], None))
                    alive.add(n["node"])
                    if best and n["supersede"] and -best[0] >= settings.conflict_threshold:
                        rows.append((n["node"], "superseded", best[3], n["node"]))
                        alive.discard(best[3])
            yield pd.DataFrame(rows, columns=["node", "event", "id", "other"]).astype({"other": "Int64"})

    played = people.join(ties, "component").select("nodes", "ties").mapInPandas(play, "node long, event string, id long, other long")
    alone = writes.select((-F.col("write_id")).alias("node")).join(label, "node", "left_anti").select("node", F.lit("inserted").alias("event"), F.col("node").alias("id"), F.lit(None).cast("long").alias("other"))
    out = played.unionByName(alone).join(writes.withColumn("node", -F.col("write_id")), "node")
    new = F.col("event") == "inserted"
    return out.select("event", F.col("written_at").alias("event_ts"), F.col("write_id").alias("seq"), "id", "other", "namespace", "category", F.when(new, F.col("content")).alias("content"), F.when(new, F.col("embedding")).alias("embedding"), F.when(new, F.lit(1.0).cast("float")).alias("decay_factor"))


def fold(memories: DataFrame, events: DataFrame, as_of: dt.datetime | str | None = None) -> DataFrame:
    """The state after an event log, or as it was at an instant.

    A refresh counts an access and reopens the memory, but keeps its pointer; a supersession closes an open memory, and
    so does archiving it, without a pointer.
    """
    if as_of is not None:
        events = events.where(F.col("event_ts") <= instant(as_of))
    events = cut(events)
    inserted = events.where("event = 'inserted'").select("id", "content", "namespace", "category", "embedding", F.col("event_ts").alias("created_at"), F.lit(None).cast("timestamp").alias("valid_at"), F.lit(None).cast("long").alias("superseded_by"), F.lit(0).alias("access_count"), "decay_factor", F.lit(None).cast("timestamp").alias("last_accessed_at"))
    order = F.struct("event_ts", "seq")
    state = F.col("event").isin("refreshed", "superseded", "archived")
    changes = events.where("event != 'inserted'").groupBy("id").agg(
        F.count_if(F.col("event").isin("refreshed", "accessed")).alias("_hits"),
        F.max(F.when(F.col("event").isin("refreshed", "accessed"), F.col("event_ts"))).alias("_seen"),
        F.max_by(F.struct("event", "event_ts"), F.when(state, order)).alias("_last"),
        F.max_by("other", F.when(F.col("event") == "superseded", order)).alias("_by"),
    )
    everyone = memories.unionByName(inserted.select(*memories.columns)).join(changes, "id", "left")  # one change row an id
    return everyone.select(
        *[
            (
                {
                    "valid_at": F.when(F.col("_last.event").isin("superseded", "archived"), F.coalesce("valid_at", F.col("_last.event_ts"))).when(F.col("_last.event") == "refreshed", F.lit(None)).otherwise(F.col("valid_at")),
                    "superseded_by": F.coalesce("_by", "superseded_by"),
                    "access_count": (F.coalesce("access_count", F.lit(0)) + F.coalesce("_hits", F.lit(0))).cast("int"),
                    "last_accessed_at": F.greatest("last_accessed_at", "_seen"),
                }.get(c, F.col(c))
            ).alias(c)
            for c in memories.columns
        ]
    )


def access_events(hits: DataFrame, at: dt.datetime | str, event: str = "accessed") -> DataFrame:
    """What a search leaves in the log: one access for each memory it returned."""
    nulls = {"other": "long", "namespace": "string", "category": "string", "content": "string", "embedding": "array<float>", "decay_factor": "float"}
    return hits.select(F.lit(event).alias("event"), instant(at).alias("event_ts"), F.lit(0).cast("long").alias("seq"), "id", *[F.lit(None).cast(t).alias(c) for c, t in nulls.items()])


def timeline(memories: DataFrame, day: str, tz: str) -> DataFrame:
    """Memories known by a local day, with ``wrote_that_day``."""
    d = local_date(F.col("created_at"), tz)
    return memories.where(d <= F.lit(day).cast("date")).withColumn("wrote_that_day", d == F.lit(day).cast("date"))


def replacements(memories: DataFrame) -> DataFrame:
    """Closed memories with the content that replaced them."""
    new = memories.select(F.col("id").alias("superseded_by"), F.col("content").alias("replaced_by_content"), F.col("valid_at").isNull().alias("replacement_open"))
    return memories.where("superseded_by is not null").join(new, "superseded_by", "left")


def supersession_chains(spark: SparkSession, memories: DataFrame) -> DataFrame:
    """``id``, ``last_id``, ``steps``: the memory at the end of each chain of replacements, whatever its length.

    A chain that runs into a cycle ends on the last memory before one is met again.
    """
    edges = cut(memories.where("superseded_by is not null").select("id", F.col("superseded_by").alias("next")))
    reach = edges.select("id", F.col("next").alias("last_id"), F.lit(1).alias("steps"))
    further, before = edges.select(F.col("id").alias("last_id"), "next"), -1
    # Pointers double: after k rounds a chain of 2^k steps is followed to its end. A round that ends none leaves only cycles.
    while (left := reach.join(further, "last_id", "left_semi").count()) not in (0, before):
        jumps = reach.select(F.col("id").alias("last_id"), F.col("last_id").alias("next"), F.col("steps").alias("d"))
        reach = cut(reach.join(jumps, "last_id", "left").select("id", F.coalesce("next", "last_id").alias("last_id"), (F.col("steps") + F.coalesce("d", F.lit(0))).alias("steps")))
        before = left
    if left == 0:
        return reach
    found = reach.join(further, "last_id", "left_anti").select("id", "last_id", "steps")
    walk = cut(reach.join(further, "last_id", "left_semi").select("id", F.col("id").alias("last_id"), F.array("id").alias("path")))
    while not walk.isEmpty():
        ahead = cut(walk.join(further, "last_id"))
        met = F.array_contains("path", F.col("next"))
        found = found.unionByName(ahead.where(met).select("id", "last_id", (F.size("path") - 1).alias("steps")))
        walk = ahead.where(~met).select("id", F.col("next").alias("last_id"), F.concat("path", F.array("next")).alias("path"))
    return found


def counts(memories: DataFrame) -> DataFrame:
    return memories.groupBy("namespace").agg(F.count("*").alias("total"), F.count_if(F.col("valid_at").isNull()).alias("open"))


def duplicate_pairs(memories: DataFrame, threshold: float, *, key: str = "category") -> DataFrame:
    """``a`` < ``b``, ``similarity`` of the open memories of one category whose inner product reaches the threshold."""
    return block_pairs(memories.where("valid_at is null").select(F.col(key).cast("string").alias("k"), "id", "embedding"), threshold, unit=False)


def greedy_merge(memories: DataFrame, threshold: float, *, key: str = "category") -> DataFrame:
    """``id`` -> ``canonical``: scanning open memories by id, each unclaimed one claims the later unclaimed ones near it.

    A claimed memory claims nothing, so this isn't a connected component. The scan runs in rounds over the similar pairs:
    a memory is decided as soon as its smaller neighbours leave no choice.
    """
    pairs = cut(duplicate_pairs(memories, threshold, key=key).select("a", "b"))
    state = cut(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct().withColumn("canonical", F.lit(None).cast("long")))
    while not state.where("canonical is null").isEmpty():
        near = pairs.join(state.withColumnRenamed("canonical", "_c").withColumnRenamed("id", "a"), "a")
        head = F.min(F.when(F.col("_c") == F.col("a"), F.col("a")))
        waits = F.min(F.when(F.col("_c").isNull(), F.col("a")))
        seen = near.groupBy(F.col("b").alias("id")).agg(head.alias("_head"), waits.alias("_waits"))
        choice = F.when(F.col("_head").isNotNull() & (F.col("_waits").isNull() | (F.col("_head") < F.col("_waits"))), F.col("_head")).when(F.col("_head").isNull() & F.col("_waits").isNull(), F.col("id"))
        state = cut(state.join(seen, "id", "left").select("id", F.coalesce("canonical", choice).alias("canonical")))
    return state.where("canonical != id")


def apply_merge(memories: DataFrame, merged: DataFrame, at: dt.datetime | str) -> DataFrame:
    """Claimed memories closed and pointed at their canonical one, which counts an access for each."""
    hits = merged.groupBy(F.col("canonical").alias("id")).agg(F.count("*").alias("_h"))
    out = memories.join(merged, "id", "left").join(hits, "id", "left")
    when = F.col("canonical").isNotNull()
    changed = {
        "valid_at": F.when(when, instant(at)).otherwise(F.col("valid_at")),
        "superseded_by": F.when(when, F.col("canonical")).otherwise(F.col("superseded_by")),
        "access_count": (F.coalesce("access_count", F.lit(0)) + F.coalesce("_h", F.lit(0))).cast("int"),
    }
    return out.select(*[changed.get(c, F.col(c)).alias(c) for c in memories.columns])

