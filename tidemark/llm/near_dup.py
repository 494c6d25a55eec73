"""Records that say nearly the same: one-permutation hashing, banded buckets, star-shaped edges (problem 2).

A record is the set of its distinct words; records with the same set are one class, so copies cost one row. A class is
hashed once: its words fall into ``bands * rows`` bins, each bin keeps its least hash, and an empty bin borrows from the
first filled bin on its own random walk (optimal densification). ``rows`` successive bins make a bucket key, and there are
as many bands as two sets at the threshold need to share a bucket but for one case in ten million.

A bucket is an aggregate: how many members it has, and its hub, the least of them. Its edges are a star, from each member to
the hub, so they are as many as the members. A star says all about a bucket of two. The members of larger buckets are
compared among themselves exactly, by the rarest words in common, in blocks of bounded size: no pair of a bucket is lost,
however large it is. Every edge is checked on the words themselves.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.graph import components
from tidemark.session import cut

LOSS = 1e-7  # the share of pairs exactly at the threshold that may share no bucket
MOST_BANDS = 64


def banding(threshold: float, loss: float = LOSS) -> tuple[int, int]:
    """Bands and rows of a band: the most rows with which few enough bands let sets at the threshold meet but for ``loss``."""
    rows = 1
    while math.log(loss) / math.log1p(-(threshold ** (rows + 1))) <= MOST_BANDS:
        rows += 1
    return math.ceil(math.log(loss) / math.log1p(-(threshold**rows))), rows


def words(text: Column) -> Column:
    """The distinct words, longest runs of letters and digits in lower case, in order."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))))


class OnePermutation:
    """Signature of ``bins`` entries of a set of 64-bit word hashes."""

    def __init__(self, bins: int, seed: int = 42) -> None:
        rng = np.random.default_rng(seed)
        self.bins = bins
        self.walk = np.argsort(np.argsort(rng.random((bins, bins)), axis=1), axis=1).astype(np.int32) + 1
        np.fill_diagonal(self.walk, 0)  # a filled bin keeps its own value

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        h = hashes.astype(np.int64).view(np.uint64)
        bins = (h % np.uint64(self.bins)).astype(np.int64)
        order = np.lexsort((h, bins))
        first = np.concatenate([[True], np.diff(bins[order]) != 0])
        filled, least = bins[order][first], h[order][first]
        return least[np.argmin(self.walk[:, filled], axis=1)]


def bucket_keys(bands: int, rows: int):  # noqa: ANN201
    """A function of an array of word hashes: the keys of its ``bands`` buckets."""

    @F.pandas_udf("array<long>")
    def keys(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        sign = OnePermutation(bands * rows)
        mix = np.random.default_rng(7).integers(1, 2**63, (rows,), dtype=np.uint64) | np.uint64(1)
        salt = np.arange(bands, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        for hashes in batches:
            if not len(hashes):
                yield pd.Series([], dtype=object)
                continue
            with np.errstate(over="ignore"):
                s = np.stack([sign(np.asarray(h)) for h in hashes]).reshape(len(hashes), bands, rows)
                s = (s ^ (s >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
                yield pd.Series(list(((s * mix).sum(axis=2, dtype=np.uint64) ^ salt).view(np.int64)))

    return keys


def word_classes(df: DataFrame, record_id: str, text: str) -> tuple[DataFrame, DataFrame]:
    """Classes (``cls``, ``words``, ``n``) of records with the same words, and members (``cls``, ``id``); wordless records have none."""
    rows = df.select(F.col(record_id).cast("long").alias("id"), words(F.col(text)).alias("words")).where(F.size("words") > 0)
    classes = rows.groupBy("words").agg(F.min("id").alias("cls"), F.count("*").alias("copies"))
    classes = cut(classes.withColumn("n", F.size("words")))
    copied = classes.where("copies > 1").select("words", "cls")
    members = rows.join(copied, "words").select("cls", "id")
    alone = classes.where("copies = 1").select("cls", F.col("cls").alias("id"))
    return classes.select("cls", "words", "n"), alone.unionByName(members)


def _check(pairs: DataFrame, classes: DataFrame, least: float) -> DataFrame:
    """``a``, ``b``, ``sim`` of the pairs (``a`` < ``b``, without repetition) of at least ``least`` Jaccard similarity."""
    hashed = classes.select("cls", F.transform("words", lambda w: F.xxhash64(w)).alias("h"), "n")
    left = hashed.select(F.col("cls").alias("a"), F.col("h").alias("ha"), F.col("n").alias("na"))
    right = hashed.select(F.col("cls").alias("b"), F.col("h").alias("hb"), F.col("n").alias("nb"))
    both = F.size(F.array_intersect("ha", "hb"))
    return pairs.join(left, "a").join(right, "b").withColumn("_i", both).select("a", "b", (F.col("_i") / (F.col("na") + F.col("nb") - F.col("_i"))).alias("sim")).where(F.col("sim") >= least - 1e-12)


def buckets(classes: DataFrame, *, threshold: float) -> tuple[DataFrame, DataFrame]:
    """The stars of buckets of two classes (``a`` the hub, ``b``), and the classes of larger buckets (``cls``)."""
    bands, rows = banding(threshold)
    keyed = cut(classes.select("cls", bucket_keys(bands, rows)(F.transform("words", lambda w: F.xxhash64(w))).alias("keys")))
    spread = keyed.select("cls", F.explode("keys").alias("bucket"))
    several = cut(spread.groupBy("bucket").agg(F.count("*").alias("n"), F.min("cls").alias("a"), F.max("cls").alias("b")).where("n > 1"))
    crowd = spread.join(several.where("n > 2").select("bucket"), "bucket", "left_semi").select("cls").distinct()
    return several.where("n = 2").select("a", "b").distinct(), crowd


def links(classes: DataFrame, *, threshold: float) -> DataFrame:
    """``a`` < ``b``: the linked pairs of classes, each once."""
    stars, crowd = buckets(classes, threshold=threshold)
    among = compared(classes.join(crowd, "cls", "left_semi"), threshold=threshold, pairs=True)
    return _check(stars, classes, threshold).select("a", "b").union(among).distinct()


def similar_pairs(df: DataFrame, record_id: str, text: str, *, threshold: float = 0.7) -> DataFrame:
    """``id_a`` < ``id_b``: all pairs of records whose words are at least ``threshold`` similar (Jaccard).

    Copies are paired too, so the output is as large as that; :func:`groups` is the form whose output is linear. Null,
    empty and wordless texts are similar to nothing, a repeated id isn't paired with itself, ties don't matter, an empty
    table gives an empty result; other columns aren't read.
    """
    classes, members = word_classes(df, record_id, text)
    found = links(classes, threshold=threshold)
    left, right = members.select(F.col("cls").alias("a"), F.col("id").alias("x")), members.select(F.col("cls").alias("b"), F.col("id").alias("y"))
    between = found.join(left, "a").join(right, "b").select("x", "y")
    several = members.join(members.groupBy("cls").count().where("count > 1").select("cls"), "cls", "left_semi")
    within = several.select("cls", F.col("id").alias("x")).join(several.select("cls", F.col("id").alias("y")), "cls").where("x < y").select("x", "y")
    return between.unionByName(within).select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b")).where("id_a < id_b").distinct()


BLOCK = 512  # classes of a key that one task compares at a time
LONGEST = 64  # words of a set up to which pairs of words are keys; the keys of longer ones are single words


def ranked(classes: DataFrame) -> DataFrame:
    """``cls`` and ``w``: the words as whole numbers in order, the rarest word of all classes being 0."""
    rows = classes.where("cls is not null").select("cls", F.xxhash64("words").alias("h"), F.explode("words").alias("word"))
    # Sorted by ranges, so that the number of the partition and the place in it keep the order.
    placed = cut(rows.groupBy("word").agg(F.count("*").alias("df")).orderBy("df", "word").select("word", F.monotonically_increasing_id().alias("at")))
    starts, total = [F.lit(0), F.lit(0)], 0
    for r in sorted(placed.groupBy(F.shiftright("at", 33).cast("int").alias("p")).count().collect()):  # one row for each partition
        starts = (starts if total else []) + [F.lit(r["p"]), F.lit(total)]
        total += r["count"]
    rank = (F.col("at").bitwiseAND(F.lit((1 << 33) - 1)) + F.create_map(*starts)[F.shiftright("at", 33).cast("int")]).cast("int")
    return rows.join(placed.select("word", rank.alias("rank")), "word").groupBy("cls", "h").agg(F.sort_array(F.collect_list("rank")).alias("w")).select("cls", "w")


def _linked(key: tuple[int, int, int, int], block: np.ndarray, sets: list[np.ndarray], threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """The linked pairs of rows whose first words in common are those of the key, so that no other key counts them too."""
    one, two, i, j = key
    upto, first = (one, 1) if two < 0 else (two, 2)
    n = np.array([len(s) for s in sets])
    if len(sets) <= 16:
        members = [set(s.tolist()) for s in sets]
        pairs = []
        for a in range(len(sets)):
            for b in range(a + 1, len(sets)):
                both = members[a] & members[b]
                pairs.append((a, b, len(both), sum(x <= upto for x in both)))
        a, b, common, low = np.array(pairs, dtype=np.int64).reshape(-1, 4).T
    else:
        owner, flat = np.repeat(np.arange(len(sets)), n), np.concatenate(sets)
        words_, at = np.unique(flat, return_inverse=True)
        shared, below = np.zeros((len(sets), len(sets)), np.float32), np.zeros((len(sets), len(sets)), np.float32)
        for start in range(0, len(words_), 4096):
            here = (at >= start) & (at < start + 4096)
            hot = np.zeros((len(sets), min(4096, len(words_) - start)), np.float32)
            hot[owner[here], at[here] - start] = 1
            shared += hot @ hot.T
            least = hot[:, words_[start : start + 4096] <= upto]
            below += least @ least.T
        a, b = np.triu_indices(len(sets), 1)
        common, low = shared[a, b], below[a, b]
    keep = (low == first) & (common >= (threshold - 1e-12) * (n[a] + n[b] - common))
    if two < 0:
        keep &= (np.maximum(n[a], n[b]) > LONGEST) | (common == 1)  # the others have keys of two words
    if i != j:
        keep &= block[a] != block[b]
    return a[keep], b[keep]


def compared(classes: DataFrame, *, threshold: float, pairs: bool = False) -> DataFrame:
    """``cls``, ``n_links``, ``label``: links of a class found by one task, and the least class it is linked with there.

    With ``pairs``, the linked pairs instead (``a`` < ``b``), each found by one task.

    Exact: of two sets that are similar enough, each holds their first ``k`` common words among its first
    ``n - ceil(threshold * n) + k``, in any order that is the same for all. Those ``k`` words are the key; with the
    rarest words first, few sets share one. The members of a key are compared in pairs of blocks. Unless pairs are asked
    for, a task gives a row for each of its members and none for a pair, so that a key may have any number of links.
    """
    n = F.size("w")
    most = n - F.ceil(n * F.lit(threshold) - 1e-9).cast("int")

    def prefix(k: int) -> Column:
        return F.slice("w", F.lit(1), F.least(n, most + k))

    # A key is a number: the first word in its upper half, the second or none (all bits) in the lower.
    none, high = F.lit((1 << 32) - 1), F.lit(1 << 32)
    ones = F.transform(prefix(1), lambda x: x.cast("long") * high + none)
    twos = F.flatten(F.transform(prefix(2), lambda x: F.transform(F.filter(prefix(2), lambda y: y > x), lambda y: x.cast("long") * high + y)))
    empty = F.array().cast("array<long>")
    # A set takes the keys that any set similar to it may need: single words if either may be long, or only one is in common.
    keys = F.concat(F.when(n <= LONGEST, twos).otherwise(empty), F.when((n > threshold * LONGEST - 1e-9) | (n <= 1 / threshold + 1e-9), ones).otherwise(empty))
    whole = cut(ranked(classes))
    keyed = whole.select("cls", F.explode(keys).alias("key"))
    # Most keys belong to one set alone; only sets that meet another are sent, and their words with them.
    shared = keyed.groupBy("key").count().where("count > 1").select("key", F.ceil(F.col("count") / BLOCK).cast("int").alias("blocks"))
    live = keyed.join(shared, "key").withColumn("block", F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    live = live.select("key", (F.least("block", "other").cast("long") * high + F.greatest("block", "other")).alias("cell"), "block", "cls")
    rows = live.join(whole, "cls").select("key", "cell", "block", "cls", "w")
    by = ["key", "cell"]

    def parted(key: int, cell: int) -> tuple[int, int, int, int]:
        low = (1 << 32) - 1
        return key >> 32, -1 if key & low == low else key & low, cell >> 32, cell & low

    def task(key: tuple[int, int], held: list[tuple[int, int, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
        cls = np.array([c for _, c, _ in held], dtype=np.int64)
        a, b = _linked(parted(*key), np.array([x for x, _, _ in held]), [s for *_, s in held], threshold)
        if not len(a):
            return None
        if pairs:
            return np.minimum(cls[a], cls[b]), np.maximum(cls[a], cls[b])
        label = cls.copy()
        while True:
            least, before = np.minimum(label[a], label[b]), label.copy()
            np.minimum.at(label, a, least)
            np.minimum.at(label, b, least)
            if (label == before).all():
                break
        count = np.bincount(np.concatenate([a, b]), minlength=len(cls))
        return cls[count > 0], count[count > 0], label[count > 0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple | None = None
        held: list = []

        def rows_of(parts: list) -> pa.RecordBatch:
            names = ["a", "b"] if pairs else ["cls", "n_links", "label"]
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate([p[k] for p in parts])) for k in range(len(names))], names=names)

        for batch in batches:
            out = []
            offsets, flat = np.array(batch.column(4).offsets), np.array(batch.column(4).values)
            cols = [batch.column(k).to_pylist() for k in range(4)]
            for r, (*key, block, cls) in enumerate(zip(*cols, strict=True)):
                if tuple(key) != last:
                    if len(held) > 1 and (got := task(last, held)):
                        out.append(got)
                    last, held = tuple(key), []
                held.append((block, cls, flat[offsets[r] : offsets[r + 1]]))
            if out:
                yield rows_of(out)
        if len(held) > 1 and (got := task(last, held)):
            yield rows_of([got])

    return rows.repartition(*by).sortWithinPartitions(*by).mapInArrow(run, "a long, b long" if pairs else "cls long, n_links long, label long")


def groups(df: DataFrame, record_id: str, text: str, *, threshold: float = 0.8) -> DataFrame:
    """``id``, ``group_id`` (the least id linked to it, over any number of steps) and ``n_links``: the classes its class is linked to.

    The classes that share a bucket are compared exactly, see :func:`compared`; all links of a class are counted, none
    twice. One row for each record that has words; no pair is written out, so a group may hold any share of the records.
    """
    classes, members = word_classes(df, record_id, text)
    stars, crowd = buckets(classes, threshold=threshold)
    met = stars.select(F.col("a").alias("cls")).union(stars.select("b")).union(crowd).distinct()
    counted = cut(compared(classes.join(met, "cls", "left_semi"), threshold=threshold))
    label = components(counted.where("label != cls").select(F.col("label").alias("a"), F.col("cls").alias("b")))
    degree = counted.groupBy("cls").agg(F.sum("n_links").alias("n_links"))
    found = members.join(label.withColumnRenamed("node", "cls"), "cls", "left").join(degree, "cls", "left")
    return found.select("id", F.coalesce("component", "cls").alias("group_id"), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"))
