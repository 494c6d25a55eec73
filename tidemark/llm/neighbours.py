"""The most similar vectors of every vector by a permutation index (problem 7).

A vector is represented by the order of its nearest pivots and posted in the inverted files of the first of them. Pivots form
a hierarchy: each level has a bounded number of them under every file of the level before, drawn from the vectors of that
file, and there are as many levels as the number of vectors asks for. A vector goes to its nearest pivots of a level and
from there to the nearest ones below, so that it has about ``postings`` copies whatever the size of the table, and files
stay near ``file_size`` because pivots are as dense as the vectors are.

Within a file, vectors are ranked by the footrule distance between their permutations of the file's own pivots; the
cosines of the ``candidates`` nearest ones, and of no others, are computed and give the neighbours. A file that is still
much too long (vectors too close to be parted) is compared block by block. Vectors that are exactly equal are one entry of
the index. The pivots of the first level, of a bounded number, are all that reaches the driver.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.sampling import hash_sample
from tidemark.session import cut

BRANCH = 1024  # pivots under one file at most, and all pivots of the first level
CHUNK = 4096  # vectors of a file that one task takes to the next level
LOCAL = 48  # pivots of a file by whose order its vectors are ranked


def usable(df: DataFrame, id_col: str, vector: str, dim: int) -> DataFrame:
    """``id`` and ``vec`` of the vectors that have the right width, no null or NaN, and are not all zero."""
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")).where(F.size("v") == dim)
    rows = rows.where(~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))))
    rows = rows.withColumn("n", F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))).where("n > 0")
    return rows.select("id", F.transform("v", lambda x: (x / F.col("n")).cast("float")).alias("vec"))


def levels_for(n: int, postings: int, file_size: int) -> tuple[int, list[int]]:
    """Pivots under each file, and to how many of them a vector goes on each level; the products are the files and about ``postings``."""
    files = max(postings + 4, n * postings // file_size)
    depth = max(1, math.ceil(math.log(files) / math.log(BRANCH) - 1e-9))
    branch = min(BRANCH, math.ceil(files ** (1 / depth)))
    # The first levels decide between far more distant regions, so they get the larger factors.
    go, left = [], postings
    for level in range(depth, 0, -1):
        go.append(max(1, math.ceil(left ** (1 / level) - 1e-9)))
        left = math.ceil(left / go[-1])
    return branch, go


def _nearest(x: np.ndarray, pivots: np.ndarray, n: int) -> np.ndarray:
    s = x @ pivots.T
    n = min(n, s.shape[1])
    return np.argpartition(-s, n - 1, axis=1)[:, :n] if n < s.shape[1] else np.broadcast_to(np.arange(n), s.shape)


def _packed(x: np.ndarray) -> list[bytes]:
    """Unit vectors as whole numbers of 16 bits, scaled to the largest component: half the size, and cosines right to 1e-5."""
    return [v.tobytes() for v in np.round(x / np.abs(x).max(axis=1, keepdims=True) * 32767).astype(np.int16)]


def _unpacked(raw: list[bytes]) -> np.ndarray:
    x = np.frombuffer(b"".join(raw), np.int16).reshape(len(raw), -1).astype(np.float32)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _footrule(ranks: np.ndarray, rows: slice) -> np.ndarray:
    """The footrule distances of some permutations to all: the sums of the differences of ranks."""
    out = np.zeros((len(ranks[rows]), len(ranks)), np.int16)
    apart = np.empty(out.shape, np.int8)  # ranks are fewer than 128
    for column in np.ascontiguousarray(ranks.T):
        np.subtract(column[rows, None], column[None, :], out=apart)
        np.abs(apart, out=apart)
        out += apart
    return out


def _search(ids: np.ndarray, vecs: np.ndarray, blocks: np.ndarray, k: int, candidates: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Within one file: query ids, neighbour ids and cosines, at most ``k`` of each query."""
    n = len(ids)
    order = np.argsort((ids * np.int64(-7046029254386353131)).view(np.uint64), kind="stable")[:LOCAL]
    ranks = np.argsort(np.argsort(-(vecs @ vecs[order].T), axis=1), axis=1).astype(np.int8)
    mixed = len(set(blocks.tolist())) > 1
    out = []
    for at in range(0, n, 256):
        rows = slice(at, min(n, at + 256))
        far = _footrule(ranks, rows)
        far[np.arange(len(far)), np.arange(rows.start, rows.stop)] = np.iinfo(np.int16).max
        if mixed:
            far[blocks[rows, None] == blocks[None, :]] = np.iinfo(np.int16).max  # seen in the file of that block alone
        take = min(candidates, n)
        near = np.argpartition(far, take - 1, axis=1)[:, :take] if take < n else np.broadcast_to(np.arange(n), far.shape)
        cosine = np.einsum("qd,qcd->qc", vecs[rows], vecs[near])
        cosine[np.take_along_axis(far, near, 1) == np.iinfo(np.int16).max] = -2
        best = np.argpartition(-cosine, min(k, take) - 1, axis=1)[:, : min(k, take)]
        found = np.take_along_axis(cosine, best, 1)
        r, c = np.nonzero(found > -2)
        out.append((ids[rows][r], ids[np.take_along_axis(near, best, 1)[r, c]], found[r, c]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def nearest(df: DataFrame, id_col: str, vector: str, *, dim: int = 64, k: int = 5, postings: int = 10, candidates: int = 128, file_size: int = 600) -> DataFrame:
    """``id``, ``neighbour``, ``cosine``: the ``k`` most similar other vectors of each usable vector, a small loss allowed.

    Vectors that are null, of another width, all zero, or hold null or NaN take no part. Equal vectors are neighbours of
    each other at cosine 1, lowest ids first, and ties elsewhere go to the lower id too; fewer than ``k`` others give
    fewer rows; an empty table gives none. An id that occurs twice is one vector (the least). Other columns aren't read.
    Cosines are exact to 1e-5.
    """
    rows = usable(df, id_col, vector, dim).groupBy("id").agg(F.min("vec").alias("vec"))
    classes = cut(rows.groupBy("vec").agg(F.min("id").alias("id"), F.count("*").alias("copies")))
    found = _nearest_classes(classes.select("id", "vec"), k, postings, candidates, file_size)
    best = found.groupBy("id").agg(F.slice(F.array_sort(F.array_distinct(F.collect_list(F.struct((-F.col("cosine")).alias("d"), "neighbour")))), 1, k).alias("near"))  # at most k for each file of an id
    pairs = best.select("id", F.explode("near").alias("n")).select("id", F.col("n.neighbour").alias("neighbour"), (-F.col("n.d")).alias("cosine"))
    if classes.where("copies > 1").isEmpty():
        return pairs
    return _with_copies(rows, classes, pairs, k)


def _first_level(vectors: DataFrame, n: int, branch: int, go: int) -> DataFrame:
    """``file``, ``id``, ``vec``: the vectors in the files of their nearest pivots of the first level."""
    sample = hash_sample(vectors, ["id"], branch, total=n).collect()  # at most BRANCH
    pivots = np.array([r["vec"] for r in sample], np.float32)

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 2000):
                batch = whole.slice(at, 2000)
                ids, x = np.array(batch.column(0)), np.array(batch.column(1).flatten(), np.float32).reshape(batch.num_rows, -1)
                near = _nearest(x, pivots, go)
                packed = np.array(_packed(x), object)
                times = near.shape[1]
                yield pa.RecordBatch.from_arrays([pa.array(near.ravel().astype(np.int64)), pa.array(np.repeat(ids, times)), pa.array(np.repeat(packed, times), pa.binary())], names=["file", "id", "vec"])

    return vectors.mapInArrow(post, "file long, id long, vec binary")


def _next_level(posted: DataFrame, branch: int, go: int) -> DataFrame:
    """The vectors of each file in the files of the nearest pivots under it.

    The pivots under a file are the ``branch`` of its vectors with the least hash; they are sent to each of the chunks into
    which the file is cut, so no task takes a whole file.
    """
    place = F.xxhash64("id", "file")
    parts = posted.groupBy("file").agg(F.ceil(F.count("*") / CHUNK).alias("chunks"))
    few = posted.join(parts, "file").withColumn("_p", F.pmod(place, F.col("chunks")))
    salted = Window.partitionBy("file", "_p").orderBy(place)
    few = few.withColumn("_r", F.row_number().over(salted)).where(F.col("_r") <= branch).withColumn("_r", F.row_number().over(Window.partitionBy("file").orderBy(place))).where(F.col("_r") <= branch)
    pivots = few.select(F.col("file").alias("under"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("part"), F.col("_r").alias("at"), F.col("vec").alias("pivot"))
    rows = posted.join(parts, "file").withColumn("chunk", F.pmod(F.xxhash64("id"), F.col("chunks"))).drop("chunks")

    def post(_key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame({"file": np.array([], np.int64), "id": np.array([], np.int64), "vec": np.array([], object)})
        right = right.sort_values("at")
        near = _nearest(_unpacked(list(left["vec"])), _unpacked(list(right["pivot"])), go)
        times = near.shape[1]
        return pd.DataFrame({"file": (left["file"].to_numpy()[:, None] * BRANCH + near).ravel(), "id": np.repeat(left["id"].to_numpy(), times), "vec": np.repeat(left["vec"].to_numpy(), times)})

    return rows.groupBy("file", "chunk").cogroup(pivots.groupBy("under", "part")).applyInPandas(post, "file long, id long, vec binary")


def _nearest_classes(vectors: DataFrame, k: int, postings: int, candidates: int, file_size: int) -> DataFrame:
    schema = "id long, neighbour long, cosine double"
    n = vectors.count()
    if n < 2:
        return vectors.sparkSession.createDataFrame([], schema)
    branch, go = levels_for(n, postings, file_size)
    posted = _first_level(vectors, n, branch, go[0])
    for times in go[1:]:
        posted = _next_level(cut(posted), branch, times)
    most = 4 * file_size
    if len(go) > 1:
        posted = cut(posted)
    # Files much longer than planned are compared in pairs of blocks; there are few, and their sizes stay on the executors.
    long = posted.groupBy("file").count().where(F.col("count") > most).select("file", F.ceil(F.col("count") / most).cast("int").alias("blocks"))
    rows = posted.join(long, "file", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    rows = rows.withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("file", F.least("own", "other").alias("one"), F.greatest("own", "other").alias("two"), "own", "id", "vec")

    def search(_key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        if len(pdf) < 2:
            return pd.DataFrame({"id": np.array([], np.int64), "neighbour": np.array([], np.int64), "cosine": np.array([], float)})
        a, b, c = _search(pdf["id"].to_numpy(), _unpacked(list(pdf["vec"])), pdf["own"].to_numpy(), k, candidates)
        return pd.DataFrame({"id": a, "neighbour": b, "cosine": np.minimum(c.astype(float), 1.0)})

    return rows.groupBy("file", "one", "two").applyInPandas(search, schema)


def _with_copies(rows: DataFrame, classes: DataFrame, pairs: DataFrame, k: int) -> DataFrame:
    """Neighbours of all ids, where some vectors occur under several ids."""
    members = rows.join(classes.where("copies > 1").select("vec", F.col("id").alias("head")), "vec").select("head", "id")
    salted = Window.partitionBy("head", F.pmod(F.xxhash64("id"), F.lit(64))).orderBy("id")
    few = members.withColumn("r", F.row_number().over(salted)).where(F.col("r") <= k + 1)
    few = few.withColumn("r", F.row_number().over(Window.partitionBy("head").orderBy("id"))).where(F.col("r") <= k + 1)
    firsts = few.groupBy("head").agg(F.array_sort(F.collect_list("id")).alias("firsts"))  # k + 1 of each
    near = pairs.join(firsts, pairs["neighbour"] == firsts["head"], "left").select(pairs["id"], "cosine", F.explode(F.coalesce("firsts", F.array("neighbour"))).alias("neighbour"))
    known = near.groupBy("id").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("cosine")).alias("d"), "neighbour"))), 1, k).alias("near"))  # k (k + 1) of each at most
    heads = classes.select(F.col("id").alias("head")).join(known.withColumnRenamed("id", "head"), "head", "left").join(firsts, "head", "left")
    own = F.transform(F.coalesce("firsts", F.array()), lambda x: F.struct(F.lit(-1.0).alias("d"), x.alias("neighbour")))
    heads = heads.select("head", F.concat(own, F.coalesce("near", F.array().cast("array<struct<d:double,neighbour:bigint>>"))).alias("near"))
    everyone = classes.where("copies = 1").select(F.col("id").alias("head"), "id").unionByName(members)
    out = everyone.join(heads, "head").select("id", F.explode(F.slice(F.array_sort(F.filter("near", lambda x: x["neighbour"] != F.col("id"))), 1, k)).alias("n"))
    return out.select("id", F.col("n.neighbour").alias("neighbour"), (-F.col("n.d")).alias("cosine"))
