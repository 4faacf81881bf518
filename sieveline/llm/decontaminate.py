"""Benchmark decontamination by spaced seeds.

Words are lower-cased, without outer punctuation.  A seed hashes the
words at the fixed places of a mask, so substitutions at the other places do
not matter.  Seeds of the benchmark and of the documents are joined; around
each hit the item is laid over the document without shifting, and the overlap
counts if in some ``SPAN`` consecutive words of the item (all words of shorter
ones), or in all of them, at least 80 % equal the document's.  The masks find every such overlap:
among any four substitutions in 20 words one of them still fits.

Items of 8 to 11 words may differ in one word, items of 5 to 7 in none; items
with fewer than five words identify nothing and are left out: no document is contaminated by them.

The benchmark goes to the tasks in blocks of at most ``BLOCK`` bytes of text,
each met with all documents in one pass, one behind the other.  Within a task a bit table and sorted
hashes serve as the join; no document is sent anywhere.

Defined cases: null or empty texts are clean; rows with null item_id or text are
left out of the benchmark; equal items are all reported; repeated rows each get
a row; an empty benchmark leaves all documents clean; an empty table gives an
empty table; further columns of the input are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import prepare, written
from .text import Flat, U, folded, mix, slices
from .toxicity import tokens

SPAN, PERCENT = 20, 80
BLOCK = 8 << 20
# Places of the words that a seed takes.
MASKS = ((0, 1, 2, 3, 5, 6), (0, 1, 2, 4, 8, 9), (0, 1, 3, 7, 10, 11), (0, 1, 2, 3, 4))
#: For items below twelve words.
SHORT = (0, 1, 3, 4)
_TABLE = 1 << 22


def needed(n: int) -> tuple[int, int]:
    """Window and equal words that an item of n words needs (0, 0: left out)."""
    if n < 5:
        return 0, 0
    if n < 12:
        return n, n - (n >= 8)
    w = min(n, SPAN)
    return w, math.ceil(PERCENT * w / 100)


def seeds(h: np.ndarray, mask: tuple[int, ...]) -> np.ndarray:
    """The hash of each place of a mask over all words of a slice (also across documents: hits are verified)."""
    n = len(h) - mask[-1]
    if n <= 0:
        return np.zeros(0, U)
    out = np.full(n, len(mask), U)
    for p in mask:
        out = out * U(0x9E3779B97F4A7C15) + h[p : p + n]
    return mix(out)


@dataclass
class Index:
    """Seeds of some items: for each mask sorted hashes with item and place."""

    ids: np.ndarray
    words: list[np.ndarray]
    parts: list[tuple[tuple[int, ...], np.ndarray, np.ndarray, np.ndarray]]

    @staticmethod
    def of(ids: list[int], texts: list[str]) -> Index:
        words = []
        for t in texts:
            h, _, _ = tokens(next(slices(folded(pa.array([t])), most=1 << 62))[1])
            words.append(h[:, 0].view(U))
        parts = []
        for mask in (*MASKS, SHORT):
            found = [(seeds(w, mask), i) for i, w in enumerate(words) if needed(len(w))[0] and (mask is not SHORT or len(w) < 12)]
            found = [(s, i) for s, i in found if len(s)]
            if found:
                s = np.concatenate([x for x, _ in found])
                item = np.concatenate([np.full(len(x), i) for x, i in found])
                at = np.concatenate([np.arange(len(x)) for x, _ in found])
                order = np.argsort(s, kind="stable")
                parts.append((mask, s[order], item[order], at[order]))
        return Index(np.array(ids, np.int64), words, parts)

    @cached_property
    def tables(self) -> list[np.ndarray]:
        """For each mask which upper bits of hashes occur; made where the index is used."""
        out = []
        for _, s, _, _ in self.parts:
            table = np.zeros(_TABLE, bool)
            table[(s >> U(42)).astype(np.int64)] = True
            out.append(table)
        return out

    def overlaps(self, f: Flat) -> dict[int, dict[int, int]]:
        """For each contaminated document of a slice its items with the most equal words in a window."""
        h = tokens(f)[0][:, 0].view(U)
        tried: list[np.ndarray] = []
        for (mask, s, item, at), table in zip(self.parts, self.tables, strict=True):
            d = seeds(h, mask)
            place = np.flatnonzero(table[(d >> U(42)).astype(np.int64)])
            lo, hi = (np.searchsorted(s, d[place], side) for side in ("left", "right"))
            n = hi - lo
            k = np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())
            place = np.repeat(place, n)
            tried.append(np.stack([f.doc[place], item[k], place - at[k]], axis=1))
        out: dict[int, dict[int, int]] = {}
        if not tried:
            return out
        for doc, item, begin in np.unique(np.concatenate(tried), axis=0).tolist():
            w = self.words[item]
            window, least = needed(len(w))
            lo, hi = max(begin, f.first[doc]), min(begin + len(w), f.first[doc + 1])
            same = np.zeros(len(w) + 1, np.int64)
            same[1:][lo - begin : hi - begin] = h[lo:hi] == w[lo - begin : hi - begin]
            sums = np.cumsum(same)
            best = int((sums[window:] - sums[: len(sums) - window]).max())
            if best >= least or 100 * sums[-1] >= PERCENT * len(w) and len(w) >= SPAN:
                got = out.setdefault(doc, {})
                key = int(self.ids[item])
                got[key] = max(best, got.get(key, 0))
        return out


def _n_blocks(benchmark: DataFrame) -> int:
    size = _items(benchmark).agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return math.ceil(2 * size / BLOCK) if size > BLOCK else 1


def _items(benchmark: DataFrame) -> DataFrame:
    return benchmark.where(F.col("item_id").isNotNull() & F.col("text").isNotNull()).select(F.col("item_id").cast("long").alias("item_id"), "text")


def _blocks(benchmark: DataFrame) -> Iterator[Index]:
    """The benchmark's blocks one behind the other: the driver holds one at a time."""
    n = _n_blocks(benchmark)
    for i in range(n):
        part = _items(benchmark).where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == i).orderBy("item_id", "text").toArrow()
        yield Index.of(part.column("item_id").to_pylist(), part.column("text").to_pylist())


def _hits(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """row, item_ids, equal_words of the contaminated rows over all blocks, one or more rows each; docs: row and text, written."""
    found = None
    for index in _blocks(benchmark):
        part = docs.mapInArrow(_match(index), "row long, item_ids array<bigint>, equal_words int").where(F.size("item_ids") > 0)
        part = written(part, "contaminated")
        found = part if found is None else found.unionByName(part)
    return found


def _match(index: Index):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for rows, f in slices(folded(b.column(b.num_columns - 1))):
                found = index.overlaps(f)
                items = [sorted(found.get(i, ())) for i in range(len(f))]
                best = [max(found[i].values()) if i in found else 0 for i in range(len(f))]
                part = b.slice(rows.start, len(f))
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:-1], pa.array(items, pa.list_(pa.int64())), pa.array(best, pa.int32())], [*part.schema.names[:-1], "item_ids", "equal_words"]
                )

    return run


def find_contamination(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """Per row: doc_id, whether it is contaminated, the items and the most equal words in a window."""
    prepare(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    if _n_blocks(benchmark) == 1:
        out = docs.select("doc_id", text).mapInArrow(_match(next(_blocks(benchmark))), f"doc_id {kind}, item_ids array<bigint>, equal_words int")
    else:
        # The row's number is stable because the rows are written first; only contaminated rows are gathered.
        rows = written(docs.select("doc_id", F.monotonically_increasing_id().alias("row"), F.col(text).alias("text")), "to-match")
        hits = _hits(rows.select("row", "text"), benchmark).groupBy("row").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("item_ids")))).alias("item_ids"), F.max("equal_words").alias("equal_words"))
        out = rows.select("doc_id", "row").join(hits, "row", "left")
        out = out.select("doc_id", F.coalesce("item_ids", F.array().cast("array<bigint>")).alias("item_ids"), F.coalesce("equal_words", F.lit(0)).alias("equal_words"))
    return out.select("doc_id", (F.size("item_ids") > 0).alias("contaminated"), "item_ids", "equal_words")


def _clean(index: Index, text: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for rows, f in slices(folded(b.column(text))):
                found = index.overlaps(f)
                yield b.slice(rows.start, len(f)).filter(pa.array([i not in found for i in range(len(f))], pa.bool_()))

    return run


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """The clean rows of docs, all columns."""
    prepare(docs.sparkSession)
    if _n_blocks(benchmark) == 1:
        return docs.mapInArrow(_clean(next(_blocks(benchmark)), text), docs.schema)
    rows = written(docs.withColumn("__row", F.monotonically_increasing_id()), "to-match")
    hits = _hits(rows.select(F.col("__row").alias("row"), F.col(text).alias("text")), benchmark).select("row").distinct()
    return rows.join(hits, F.col("__row") == F.col("row"), "left_anti").drop("__row")
