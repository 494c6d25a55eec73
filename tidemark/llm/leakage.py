"""Evaluation passages inside training documents: q-gram lemma, unedited pieces, alignment of words (problem 9).

The items' character q-grams (over words in lower case with single spaces) are the only thing shipped, in blocks of
bounded size: a further block is a further pass over the documents. A document is read once per pass, in place: its
q-grams are looked up, and the words around each stretch that is as long a piece of an item as the edits must leave whole
are kept if they hold as many q-grams as a passage within the edit budget must share. They are aligned word by word.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.textscan import folded, window_hashes

FILTER_BITS = 24


def longest_aligned(item: list[str], doc: list[str], edits: int, band: tuple[int, int] | None = None) -> int:
    """The most consecutive words of ``item`` that stand in ``doc`` with at most ``edits`` words changed, added or left out.

    An alignment starts and ends with an equal word. With ``band``, only cells on its diagonals (place in ``doc`` less place
    in ``item``, from and to) are looked at.
    """
    best, width = 0, len(doc) + 1
    low, high = band if band else (-len(item), len(doc))
    prev = [[-1] * width for _ in range(edits + 1)]
    for i, word in enumerate(item):
        rows = [[-1] * width for _ in range(edits + 1)]
        for j in range(max(1, i + low + 1), min(width, i + high + 2)):
            same = word == doc[j - 1]
            for e in range(edits + 1):
                if same:
                    n = max(prev[e][j - 1], 0) + 1
                    if n > best:
                        best = n
                elif e:
                    over = prev[e - 1]
                    n = max(over[j - 1] + 1 if over[j - 1] > 0 else -1, over[j] + 1 if over[j] > 0 else -1, rows[e - 1][j - 1])
                else:
                    continue
                rows[e][j] = n
        prev = rows
    return best


class _Index:
    """The q-grams of a block of items."""

    def __init__(self, items: list[tuple[int, str]], min_words: int, q: int, edits: int) -> None:
        self.q, self.min_words, self.edits = q, min_words, edits
        self.words: dict[int, list[str]] = {}
        self.spaces: dict[int, np.ndarray] = {}
        self.need: dict[int, int] = {}  # q-grams that a passage must share in all
        self.run: dict[int, int] = {}  # and in one piece
        hashes, owner, at = [], [], []
        for item, text in items:
            x = folded(text)
            words = "".join(map(chr, x)).split()
            if len(words) < min_words:
                continue
            self.words[item] = words
            self.spaces[item] = np.flatnonzero(x == 32)
            ends = np.cumsum([0, *(len(w) + 1 for w in words)])
            least = int((ends[min_words:] - ends[:-min_words]).min()) + 1
            # An edit of a word destroys the q-grams that touch it; between the edits one run of words stays whole.
            self.need[item] = max(1, least + 1 - q - edits * (q + max(map(len, words))))
            whole = -(-(min_words - edits) // (edits + 1))
            self.run[item] = max(1, int((ends[whole:] - ends[:-whole]).min()) + 2 - q)
            h = window_hashes(x, q)
            hashes.append(h)
            owner.append(np.full(len(h), item, np.int64))
            at.append(np.arange(len(h), dtype=np.int64))
        joined = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        order = np.argsort(joined, kind="stable")
        self.hashes = joined[order]
        self.owner = (np.concatenate(owner) if owner else np.zeros(0, np.int64))[order]
        self.at = (np.concatenate(at) if at else np.zeros(0, np.int64))[order]
        self.filter = np.zeros(1 << FILTER_BITS, dtype=bool)
        self.filter[(self.hashes >> np.uint64(64 - FILTER_BITS)).astype(np.int64)] = True

    def found(self, text: str) -> list[tuple[int, int]]:
        """(item, words in common) of the items that the text gives away."""
        x = folded(text)
        h = window_hashes(x, self.q)
        maybe = np.flatnonzero(self.filter[(h >> np.uint64(64 - FILTER_BITS)).astype(np.int64)])
        if not len(maybe):
            return []
        lo, hi = np.searchsorted(self.hashes, h[maybe], "left"), np.searchsorted(self.hashes, h[maybe], "right")
        n = hi - lo
        pos = np.repeat(maybe, n)
        if not len(pos):
            return []
        index = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(len(pos))
        item, diagonal = self.owner[index], pos - self.at[index]
        pieces = self._pieces(item, diagonal, pos)
        if not pieces:
            return []
        spaces = np.flatnonzero(x == 32)
        order = np.lexsort((pos, item))
        item, pos = item[order], pos[order]
        out = []
        for one, found in pieces.items():
            words = self.words[one]
            hits = pos[np.searchsorted(item, one, "left") : np.searchsorted(item, one, "right")]
            # A piece says on which diagonal of words it lies, and the edits of a passage leave it by no more than themselves.
            starts = {int(np.searchsorted(spaces, low, "right")) - int(np.searchsorted(self.spaces[one], at, "right")) for low, at in found}
            best = 0
            for d in sorted(starts):
                first, last = max(0, d - self.edits), min(len(spaces) - 1, d + len(words) + self.edits)
                start, end = spaces[first], spaces[last]
                if np.searchsorted(hits, end, "right") - np.searchsorted(hits, start, "left") >= self.need[one]:
                    around = "".join(map(chr, x[start : end + 1])).split()
                    best = max(best, longest_aligned(words, around, self.edits, (d - first - self.edits, d - first + self.edits)))
                if best == len(words):
                    break
            if best >= self.min_words:
                out.append((one, best))
        return out

    def _pieces(self, item: np.ndarray, diagonal: np.ndarray, pos: np.ndarray) -> dict[int, list[tuple[int, int]]]:
        """For each item the stretches of the text that are long enough pieces of it: where they begin in the text and in the item."""
        order = np.lexsort((pos, diagonal, item))
        i, d, p = item[order], diagonal[order], pos[order]
        starts = np.flatnonzero(np.concatenate([[True], (i[1:] != i[:-1]) | (d[1:] != d[:-1]) | (p[1:] != p[:-1] + 1)]))
        lengths = np.diff(np.concatenate([starts, [len(i)]]))
        out: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for one, low, diag, n in zip(i[starts].tolist(), p[starts].tolist(), d[starts].tolist(), lengths.tolist(), strict=True):
            if n >= self.run[one]:
                out[one].append((low, low - diag))
        return out


def _blocks(items: DataFrame, most: int) -> Iterator[list[tuple[int, str]]]:
    """The items in blocks of at most ``most`` characters (or one item); the driver holds one block at a time."""
    block: list[tuple[int, str]] = []
    size = 0
    for r in items.where("i is not null and t is not null").toLocalIterator():
        if size + len(r["t"]) > most and block:
            yield block
            block, size = [], 0
        block.append((r["i"], r["t"]))
        size += len(r["t"])
    yield block


def leaks(docs: DataFrame, doc_id: str, text: str, items: DataFrame, item_id: str, item_text: str, *, min_words: int = 12, q: int = 16, edits: int = 0, block_chars: int = 4_000_000) -> DataFrame:
    """``doc_id``, ``item_id`` and ``n_words``: documents that hold at least ``min_words`` consecutive words of an item.

    ``edits`` words may be changed, added or left out in between. Words are runs of letters and digits in lower case.
    Null and empty texts and items, and items of fewer words, give nothing; each pair occurs once for each row of the
    document; whole texts are read whatever their length; other columns aren't read. Items are held by the driver and
    shipped ``block_chars`` characters at a time.
    """
    schema = "doc_id long, item_id long, n_words int"
    rows = docs.select(F.col(doc_id).cast("long"), F.col(text).cast("string"))
    out: DataFrame | None = None
    for block in _blocks(items.select(F.col(item_id).cast("long").alias("i"), F.col(item_text).alias("t")), block_chars):
        sent = docs.sparkSession.sparkContext.broadcast(block)  # at most block_chars characters, or one item

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
            index = _Index(sent.value, min_words, q, edits)
            for batch in batches:
                found = [(i, item, n) for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) if t for item, n in index.found(t)]
                cols = list(zip(*found, strict=True)) or [(), (), ()]
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int32())], names=["doc_id", "item_id", "n_words"])

        part = rows.mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    return out
