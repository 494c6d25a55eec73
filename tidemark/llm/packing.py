"""Fill containers of fixed capacity with texts of varying length (problem 8).

Sizes are whole numbers up to the capacity, so a histogram of at most ``capacity`` entries says all there is to know for
packing. Variable-capacity best fit decreasing runs on that histogram on the driver, on groups of equal containers; its
plan has a few thousand lines, whatever the number of texts. Each text then finds its place by its rank among the texts
of its size, which is made of two parts (a slot by hash, a rank within the slot). A size has as many slots as its number of
texts asks for, so no task ranks more than about ``SLOT_ROWS`` of them.
"""

from __future__ import annotations

import base64
import bisect
from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.vocabulary import tokenizer_path
from tidemark.session import cut

SLOT_ROWS = 100_000


@dataclass(frozen=True)
class Group:
    """``count`` containers that hold the same sizes: (size, how many of it in each) pairs."""

    capacity: int
    count: int
    contents: tuple[tuple[int, int], ...]

    @property
    def used(self) -> int:
        return sum(s * n for s, n in self.contents)


def best_fit(histogram: dict[int, int], choose: Callable[[int, int, int], int]) -> list[Group]:
    """Best fit decreasing over groups of equal containers.

    Where no open container has room, ``choose`` (size, how many of it are left, tokens in smaller sizes) says which
    capacity is opened for as many of that size as it holds.
    """
    free: dict[int, list[tuple[int, int, tuple]]] = defaultdict(list)  # room left -> groups of (capacity, count, contents)
    rooms: list[int] = []
    smaller = sum(s * n for s, n in histogram.items())

    def put(room: int, capacity: int, count: int, contents: tuple) -> None:
        if count:
            if not free[room]:
                bisect.insort(rooms, room)
            free[room].append((capacity, count, contents))

    for size in sorted(histogram, reverse=True):
        left = histogram[size]
        smaller -= size * left
        while left:
            at = bisect.bisect_left(rooms, size)
            if at < len(rooms):
                room = rooms[at]
                capacity, count, contents = free[room].pop()
                if not free[room]:
                    rooms.pop(at)
            else:
                room = capacity = choose(size, left, smaller)
                count, contents = max(1, left // (capacity // size)), ()  # what remains of this size is opened for anew
            each = room // size
            full = min(count, left // each)
            put(room - each * size, capacity, full, (*contents, (size, each)))
            left -= full * each
            count -= full
            if count and left:
                put(room - left * size, capacity, 1, (*contents, (size, left)))
                left, count = 0, count - 1
            if contents:
                put(room, capacity, count, contents)
    return [Group(capacity, count, contents) for groups in free.values() for capacity, count, contents in groups]


def plan(histogram: dict[int, int], capacities: tuple[int, ...]) -> list[Group]:
    """The cheapest packing over the permitted capacities; cost is the sum of the capacities used.

    A container is opened at the least cost: the capacity that wastes least on the texts at hand, given that smaller ones
    may fill its room, the largest of equal ones. The same with each single capacity to open where it fits is tried too,
    and at the end of each trial every container is downsized to the least capacity that holds its contents.
    """
    caps = sorted(capacities)
    sizes = {s: n for s, n in histogram.items() if n}
    if sizes and max(sizes) > caps[-1]:
        raise ValueError("a size exceeds the largest capacity")

    def downsized(groups: list[Group]) -> list[Group]:
        return [Group(caps[bisect.bisect_left(caps, g.used)], g.count, g.contents) for g in groups]

    def least_cost(size: int, left: int, smaller: int) -> int:
        def waste(c: int) -> float:
            each = min(c // size, left)
            room = c - each * size
            return max(0, room - smaller) / (each * size)

        return min((c for c in caps if c >= size), key=lambda c: (waste(c), -c))

    def mostly(opened: int) -> Callable[[int, int, int], int]:
        return lambda size, left, smaller: opened if size <= opened else caps[bisect.bisect_left(caps, size)]

    options = [downsized(best_fit(sizes, how)) for how in (least_cost, *(mostly(c) for c in caps))]
    return min(options, key=lambda groups: (sum(g.capacity * g.count for g in groups), sum(g.count for g in groups)))


def _encoder(path: str):  # noqa: ANN202
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(docs: DataFrame, doc_id: str, text: str, path: str | None = None) -> DataFrame:
    """``doc_id`` (long) and ``n_tokens``; null and empty texts have none. Other columns aren't read."""
    where = path or tokenizer_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(where)
        for batch in batches:
            counts = [len(encoder.encode_ordinary(t)) if t else 0 for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64())], names=["doc_id", "n_tokens"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, "doc_id long, n_tokens long")


def pieces(counts: DataFrame, capacity: int) -> DataFrame:
    """``doc_id``, ``piece``, ``start``, ``size``: a document within the capacity whole, a longer one in full pieces and a rest."""
    at = F.posexplode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n_tokens") - 1) / capacity).cast("long")))
    cut_up = counts.where("n_tokens > 0").select("doc_id", "n_tokens", at.alias("piece", "_k"))
    start = F.col("_k") * capacity
    return cut_up.select("doc_id", "piece", start.alias("start"), F.least(F.lit(capacity).cast("long"), F.col("n_tokens") - start).alias("size"))


def pack(docs: DataFrame, doc_id: str, text: str, *, capacities: tuple[int, ...] = (512, 1024, 1536, 2048), path: str | None = None) -> DataFrame:
    """``doc_id``, ``piece``, ``start`` and ``size`` (in tokens), ``container`` (long) and its ``capacity``.

    Documents beyond the largest capacity, and only they, are split. Null and empty texts take no room and appear in no
    container; repeated rows are packed once each (pieces of a repeated doc_id differ in container only); ties of size are
    ranked by hash and id; an empty table gives an empty one.
    """
    largest = max(capacities)
    items = cut(pieces(token_counts(docs, doc_id, text, path), largest))
    per_size = items.groupBy("size").agg(F.ceil(F.count("*") / SLOT_ROWS).cast("int").alias("slots"))  # at most ``largest`` rows
    items = items.join(F.broadcast(per_size), "size").withColumn("slot", F.pmod(F.xxhash64("doc_id", "piece"), F.col("slots")).cast("int")).drop("slots")
    counted = items.groupBy("size", "slot").count().collect()  # a row for each size, and one for each SLOT_ROWS texts
    by_size: dict[int, np.ndarray] = {}
    for r in sorted(counted, key=lambda r: -r["slot"]):
        by_size.setdefault(r["size"], np.zeros(r["slot"] + 1, np.int64))[r["slot"]] = r["count"]
    groups = plan({s: int(n.sum()) for s, n in by_size.items()}, tuple(capacities))

    starts = {s: np.concatenate([[0], np.cumsum(n)[:-1]]) for s, n in by_size.items()}
    lines: dict[int, list[tuple[int, int, int, int]]] = defaultdict(list)  # size -> (first rank, first container, in each, capacity)
    taken: dict[int, int] = defaultdict(int)
    container = 0
    for g in groups:
        for size, each in g.contents:
            lines[size].append((taken[size], container, each, g.capacity))
            taken[size] += g.count * each
        container += g.count
    table = {s: np.array(x, dtype=np.int64) for s, x in lines.items()}

    @F.pandas_udf("struct<container: long, capacity: int>")
    def place(sizes: pd.Series, slots: pd.Series, ranks: pd.Series) -> pd.DataFrame:
        out = np.zeros((len(sizes), 2), np.int64)
        s, slot, r = sizes.to_numpy(), slots.to_numpy(), ranks.to_numpy()
        for size in np.unique(s):
            m = s == size
            rank = r[m] + starts[size][slot[m]]
            line = table[size][np.searchsorted(table[size][:, 0], rank, side="right") - 1]
            out[m, 0] = line[:, 1] + (rank - line[:, 0]) // line[:, 2]
            out[m, 1] = line[:, 3]
        return pd.DataFrame({"container": out[:, 0], "capacity": out[:, 1].astype(np.int32)})

    rank = F.row_number().over(Window.partitionBy("size", "slot").orderBy("doc_id", "piece")) - 1
    placed = items.withColumn("_rank", rank.cast("long")).withColumn("_p", place("size", "slot", "_rank"))
    return placed.select("doc_id", "piece", "start", "size", "_p.container", "_p.capacity")
