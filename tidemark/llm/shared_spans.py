"""Long exact spans shared between records (problem 10).

:func:`line_duplicates` is line hashing: normalised lines are grouped by digest over all records, the earliest occurrence
stays and the others are reported with their offsets in the original text.

Lines can't promise every span: a shared stretch may begin and end inside lines. :func:`shared_spans` therefore hashes
windows of ``WINDOW`` characters and keeps those that winnowing selects, so that two texts that share ``least``
characters always share a kept digest. The rest is as with lines: digests are grouped over all records, the earliest
record of a digest is its hub, and every other record gets an edge to the hub alone. Edges are extended to the longest
equal stretch on the texts themselves. Two records of one hub share what their stretches have in common there, and
beyond it what their own context shows; so no pair is lost although only star-shaped edges are written.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.textscan import code_points, window_hashes, winnow
from tidemark.session import cut

GRID = 100


def line_duplicates(docs: DataFrame, doc_id: str, text: str, *, least_chars: int = 1) -> DataFrame:
    """``doc_id``, ``line_no``, ``start``, ``length`` (code points, of the line in the text), ``first_doc``, ``first_line``.

    A row for each line that stands, up to white space, in an earlier record or earlier in the same one; lines of fewer
    than ``least_chars`` signs are left alone. The order of records is that of ``doc_id``. Null texts have no lines.
    """
    norm: Column = F.regexp_replace(F.regexp_replace(F.col("line"), r"(?U)^\s+|\s+$", ""), r"(?U)\s+", " ")
    lines = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.split(F.col(text), "\n", -1).alias("ls")).where("ls is not null")

    def offsets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs_, numbers, starts, parts = [], [], [], []
            for doc, ls in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                at = 0
                for k, line in enumerate(ls):
                    docs_.append(doc)
                    numbers.append(k + 1)
                    starts.append(at)
                    parts.append(line)
                    at += len(line) + 1
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip((docs_, numbers, starts, parts), kinds, strict=True)], names=["doc_id", "line_no", "start", "line"])

    rows = lines.mapInArrow(offsets, "doc_id long, line_no int, start int, line string").withColumn("n", norm)
    rows = cut(rows.where(F.length("n") >= least_chars).select("doc_id", "line_no", "start", F.length("line").alias("length"), F.xxhash64("n").alias("d1"), F.hash("n").alias("d2")))
    firsts = rows.groupBy("d1", "d2").agg(F.min(F.struct("doc_id", "line_no")).alias("f"), F.count("*").alias("c")).where("c > 1").drop("c")
    found = rows.join(firsts, ["d1", "d2"]).where("doc_id != f.doc_id or line_no != f.line_no")
    return found.select("doc_id", "line_no", "start", "length", F.col("f.doc_id").alias("first_doc"), F.col("f.line_no").alias("first_line"))


def without_later_lines(docs: DataFrame, doc_id: str, text: str, *, least_chars: int = 1) -> DataFrame:
    """``doc_id``, ``text_kept``, ``kept``: each text without the lines that stand earlier (:func:`line_duplicates`).

    ``kept`` holds the stretches of the given text that are left (``start``, ``length`` in code points), line by line; they
    are joined by line feeds. A null text stays null; a text of which nothing is left is empty. A doc_id that occurs
    twice is one document.
    """
    again = line_duplicates(docs, doc_id, text, least_chars=least_chars)
    gone = again.groupBy("doc_id").agg(F.collect_set("line_no").alias("gone"))  # lines of one text
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("t")).dropDuplicates(["doc_id"]).join(gone, "doc_id", "left")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, spans = [], []
            for t, removed in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                left, at, out = set(removed or ()), 0, []
                lines = [] if t is None else t.split("\n")
                for k, line in enumerate(lines):
                    if k + 1 not in left:
                        out.append((at, len(line)))
                    at += len(line) + 1
                texts.append(None if t is None else "\n".join(t[s : s + n] for s, n in out))
                spans.append([{"start": s, "length": n} for s, n in out])
            kind = pa.list_(pa.struct([("start", pa.int32()), ("length", pa.int32())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array(spans, kind)], names=["doc_id", "text_kept", "kept"])

    return rows.select("doc_id", "t", "gone").mapInArrow(keep, "doc_id long, text_kept string, kept array<struct<start: int, length: int>>")


def _text_classes(docs: DataFrame, doc_id: str, text: str, least: int) -> tuple[DataFrame, DataFrame]:
    """Texts of enough characters, one of each (``doc``, ``text``), and all who bear one (``doc``, ``id``)."""
    rows = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).cast("string").alias("text")).where(F.col("id").isNotNull() & (F.length("text") >= least))
    keyed = rows.select("id", F.md5("text").alias("m"), F.length("text").alias("n"))
    heads = keyed.groupBy("m", "n").agg(F.min("id").alias("doc"), F.count("*").alias("c"))
    several = cut(keyed.join(heads.where("c > 1"), ["m", "n"]).select("doc", "id"))
    surplus = several.where("doc != id").select("id").distinct()
    texts = rows.join(surplus, "id", "left_anti").select(F.col("id").alias("doc"), "text")
    members = several.union(texts.select("doc", F.col("doc").alias("id"))).distinct()
    return texts, members


def _stretches(a: np.ndarray, b: np.ndarray, pairs: list[tuple[int, int]], width: int) -> list[tuple[int, int, int]]:
    """The longest equal stretches (start in a, start in b, length) around equal windows at the given offsets."""
    out, seen = [], {}
    for i, j in sorted(pairs):
        d = i - j
        if seen.get(d, -1) >= i + width:
            continue
        lo, hi = max(0, d), min(len(a), len(b) + d)
        if not 0 <= i - lo or i + width > hi or not np.array_equal(a[i : i + width], b[j : j + width]):
            continue
        left = np.flatnonzero(a[lo:i][::-1] != b[lo - d : j][::-1])
        right = np.flatnonzero(a[i + width : hi] != b[j + width : hi - d])
        start = i - (int(left[0]) if len(left) else i - lo)
        end = i + width + (int(right[0]) if len(right) else hi - i - width)
        seen[d] = end
        out.append((start, start - d, end - start))
    return out


def edges(texts: DataFrame, *, least: int = 300, window: int = 241) -> DataFrame:
    """``hub``, ``doc``, ``hub_start``, ``doc_start``, ``length``, ``left``, ``right``: stretches shared with hubs.

    Stretches have at least ``window`` characters; ``left`` and ``right`` are the characters beside them in ``doc`` that
    a pair of records needs in order to reach ``least``.
    """
    beside = least - window

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, digests, starts = [], [], []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                h = window_hashes(code_points(text), window)
                at = winnow(h, beside + 1)
                docs.append(np.full(len(at), doc, np.int64))
                digests.append(h[at].view(np.int64))
                starts.append(at.astype(np.int32))
            if docs:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (digests, docs, starts)], names=["digest", "doc", "start"])

    marks = cut(texts.select("doc", "text").mapInArrow(scan, "digest long, doc long, start int"))
    shared = marks.groupBy("digest").agg(F.min(F.struct("doc", "start")).alias("h"), F.count("*").alias("c")).where("c > 1").select("digest", "h")
    star = marks.join(shared, "digest").where("doc != h.doc or start != h.start")
    spokes = star.groupBy(F.col("h.doc").alias("hub"), "doc").agg(F.collect_set(F.struct(F.col("h.start").alias("i"), F.col("start").alias("j"))).alias("at"))  # at most the marks of one text
    both = spokes.join(texts.select(F.col("doc").alias("hub"), F.col("text").alias("hub_text")), "hub").join(texts, "doc")

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for hub, doc, at, hub_text, text in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                for i, j, n in _stretches(code_points(hub_text), code_points(text), [(x["i"], x["j"]) for x in at], window):
                    out.append((hub, doc, i, j, n, text[max(0, j - beside) : j], text[j + n : j + n + beside]))
            cols = list(zip(*out, strict=True)) or [()] * 7
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["hub", "doc", "hub_start", "doc_start", "length", "left", "right"])

    return both.select("hub", "doc", "at", "hub_text", "text").mapInArrow(extend, "hub long, doc long, hub_start int, doc_start int, length int, left string, right string")


def _beyond(a: str, b: str, from_end: bool) -> int:
    n = 0
    for x, y in zip(reversed(a) if from_end else a, reversed(b) if from_end else b, strict=False):
        if x != y:
            break
        n += 1
    return n


def _spoke_pairs(star: DataFrame, least: int, window: int) -> DataFrame:
    """``doc_a``, ``doc_b``, ``start_a``, ``start_b``, ``length`` of what two records of one hub share, if it is enough."""
    ends = star.withColumn("end", F.col("hub_start") + F.col("length"))
    # Stretches that have a window in common hold a common point of the grid, which is finer than a window.
    cells = F.sequence(F.ceil(F.col("hub_start") / GRID), F.floor((F.col("end") - 1) / GRID))
    cols = ["hub", "doc", "hub_start", "doc_start", "end", "left", "right"]
    celled = ends.select(*cols, F.explode(cells).alias("cell"))
    a = celled.select("hub", "cell", *[F.col(c).alias(f"a_{c}") for c in cols[1:]])
    b = celled.select("hub", "cell", *[F.col(c).alias(f"b_{c}") for c in cols[1:]])
    lo, hi = F.greatest("a_hub_start", "b_hub_start"), F.least("a_end", "b_end")
    pairs = a.join(b, ["hub", "cell"]).where("a_doc < b_doc").where(hi - lo >= window).where(F.col("cell") == F.ceil(lo / GRID))
    pairs = pairs.where((hi - lo >= least) | (F.col("a_hub_start") == F.col("b_hub_start")) | (F.col("a_end") == F.col("b_end")))
    sure = pairs.where(hi - lo >= least).select(F.col("a_doc").alias("doc_a"), F.col("b_doc").alias("doc_b"), (F.col("a_doc_start") + lo - F.col("a_hub_start")).alias("start_a"), (F.col("b_doc_start") + lo - F.col("b_hub_start")).alias("start_b"), (hi - lo).alias("length"))
    open_ = pairs.where(hi - lo < least)

    def more(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                low, high = max(r["a_hub_start"], r["b_hub_start"]), min(r["a_end"], r["b_end"])
                left = _beyond(r["a_left"], r["b_left"], True) if r["a_hub_start"] == r["b_hub_start"] else 0
                right = _beyond(r["a_right"], r["b_right"], False) if r["a_end"] == r["b_end"] else 0
                if high - low + left + right >= least:
                    out.append((r["a_doc"], r["b_doc"], r["a_doc_start"] + low - r["a_hub_start"] - left, r["b_doc_start"] + low - r["b_hub_start"] - left, high - low + left + right))
            cols_ = list(zip(*out, strict=True)) or [()] * 5
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols_, kinds, strict=True)], names=["doc_a", "doc_b", "start_a", "start_b", "length"])

    return sure.unionByName(open_.drop("hub", "cell").mapInArrow(more, "doc_a long, doc_b long, start_a int, start_b int, length int"))


def shared_spans(docs: DataFrame, doc_id: str, text: str, *, least: int = 300, window: int = 241) -> DataFrame:
    """``doc_a`` < ``doc_b``: every two records that have at least ``least`` consecutive characters in common.

    Copies are paired too. Null texts and those of fewer characters share nothing; a repeated doc_id isn't paired with
    itself; an empty table gives an empty result; other columns aren't read.
    """
    texts, members = _text_classes(docs, doc_id, text, least)
    star = cut(edges(texts, least=least, window=window))
    direct = star.where((F.col("length") >= least) & (F.col("hub") != F.col("doc"))).select(F.least("hub", "doc").alias("a"), F.greatest("hub", "doc").alias("b"))
    found = direct.union(_spoke_pairs(star, least, window).select(F.col("doc_a"), F.col("doc_b"))).distinct()
    left, right = members.select(F.col("doc").alias("a"), F.col("id").alias("x")), members.select(F.col("doc").alias("b"), F.col("id").alias("y"))
    between = found.join(left, "a").join(right, "b").select("x", "y")
    several = members.join(members.groupBy("doc").count().where("count > 1").select("doc"), "doc", "left_semi")
    within = several.select("doc", F.col("id").alias("x")).join(several.select("doc", F.col("id").alias("y")), "doc").where("x < y").select("x", "y")
    return between.union(within).select(F.least("x", "y").alias("doc_a"), F.greatest("x", "y").alias("doc_b")).where("doc_a < doc_b").distinct()


def _fringes(texts: DataFrame, spans: DataFrame, least: int, beside: int) -> DataFrame:
    """``doc``, ``s``, ``e`` of the stretches of ``least`` characters that reach beyond a span and stand in another text too.

    A stretch that two texts share holds a mark, so it lies within ``beside`` characters of a span of each; only those
    few around each end of a span are hashed and counted.
    """
    at = spans.groupBy("doc").agg(F.collect_set(F.struct("s", "e")).alias("spans"))  # the distinct spans of one text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, starts, hashes = [], [], []
            for doc, around, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                h = window_hashes(code_points(text), least)
                near: set[int] = set()
                for one in around:
                    s, e = one["s"], one["e"]
                    first, last = max(0, s - beside), min(len(h) - 1, e + beside - least)
                    near.update(i for i in range(first, last + 1) if i < s or i + least > e)
                if near:
                    i = np.array(sorted(near), np.int32)
                    docs.append(np.full(len(i), doc, np.int64))
                    starts.append(i)
                    hashes.append(h[i].view(np.int64))
            if docs:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (docs, starts, hashes)], names=["doc", "s", "h"])

    hashed = cut(at.join(texts, "doc").select("doc", "spans", "text").mapInArrow(run, "doc long, s int, h long"))
    twice = hashed.groupBy("h").agg(F.min("doc").alias("a"), F.max("doc").alias("b")).where("a != b").select("h")
    return hashed.join(twice, "h", "left_semi").select("doc", "s", (F.col("s") + least).alias("e"))


def shared_amounts(docs: DataFrame, doc_id: str, text: str, *, least: int = 300, window: int = 241) -> DataFrame:
    """``doc_id``, ``n_chars``, ``shared_chars``: how much of each record also stands in another, in spans of at least ``least``.

    A record of which copies exist is shared as a whole if it has ``least`` characters. Records without text have 0 of 0.
    No pair of records is written out but the edges to hubs.
    """
    texts, members = _text_classes(docs, doc_id, text, least)
    star = cut(edges(texts, least=least, window=window))
    sides = star.select("doc", F.col("doc_start").alias("s"), (F.col("doc_start") + F.col("length")).alias("e"), (F.col("hub") != F.col("doc")).alias("other"))
    sides = sides.union(star.select("hub", "hub_start", F.col("hub_start") + F.col("length"), F.col("hub") != F.col("doc"))).distinct()
    spans = sides.where(F.col("other") & (F.col("e") - F.col("s") >= least)).select("doc", "s", "e")
    spans = spans.union(_fringes(texts, sides.select("doc", "s", "e").distinct(), least, least - window)).distinct()
    before = F.max("e").over(Window.partitionBy("doc").orderBy("s", "e").rowsBetween(Window.unboundedPreceding, -1))
    covered = spans.withColumn("b", F.coalesce(before, F.lit(0))).select("doc", F.greatest(F.lit(0), F.col("e") - F.greatest("s", "b")).alias("n")).groupBy("doc").agg(F.sum("n").alias("shared"))
    copies = members.groupBy("doc").agg(F.count("*").alias("c"))
    per_id = members.join(copies, "doc").join(covered, "doc", "left").select(F.col("id").alias("doc_id"), "c", "shared")
    base = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.length(text), F.lit(0)).alias("n_chars"))
    return base.join(per_id, "doc_id", "left").select("doc_id", "n_chars", F.when(F.col("c") > 1, F.col("n_chars").cast("long")).otherwise(F.coalesce("shared", F.lit(0).cast("long"))).alias("shared_chars"))
