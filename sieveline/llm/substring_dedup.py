"""Removal of passages that an earlier document has.

A word goes if it lies in a window of 50 words whose sequence also starts in a
document with a smaller doc_id.

1. Each window picks an anchor: the smallest hash of its 8-word runs.  Equal
   windows pick the same one, and neighbouring windows mostly share it, so a
   document has about one anchor for 22 windows.  An anchor that no second
   document has cannot lie in a repeated window.
2. For the other anchors, the passage of the windows around them is cut out.
   Equal passages of one anchor become one with the smallest doc_id before they are searched; every
   other occurrence of it is covered as a whole.
3. Passages are dealt by anchor into shards.  A shard gets a compressed FM-index
   over a wavelet matrix; its documents' passages stream through backward search, which follows the
   matching statistics against documents with a smaller doc_id, and places
   with 50 words or more are windows that start earlier.
4. An anchor with more than ``HOT_PASSAGES`` different passages, as a common phrase has, is not
   dealt as one: its passages pick further anchors among their 24-word runs and,
   where one of these is hot too, single windows, which are told apart by content alone.  So no shard grows with a phrase.
5. Covered windows go back to their documents.

Defined cases: null or empty text has no words; texts below 50 words lose
none; rows with one doc_id do not count against each other; rows with null
doc_id neither lose words nor count; repeated rows get equal results; an empty
table gives an empty table; further columns of the input are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .fm_index import FMIndex
from .store import prepare, remove, written
from .text import Flat, rolled, slices

U64 = np.uint64
WINDOW = 50
#: Words of the runs that anchors are picked from, on each level.
RUNS = (8, 24, WINDOW)
#: Symbols that one FM-index holds; a shard of whole anchors may be somewhat larger.
SHARD = 250_000
#: An anchor with more different passages than this is split by further anchors.
HOT_PASSAGES = 300


def anchors(f: Flat, run: int) -> tuple[np.ndarray, ...]:
    """For each row of windows with one anchor, at most as many as have one place of the anchor in common: document, anchor, first window, windows."""
    none, span = np.zeros(0, np.int64), WINDOW - run + 1
    n = len(f.doc) - WINDOW + 1
    inside = np.flatnonzero(f.doc[:n] == f.doc[WINDOW - 1 :]) if n > 0 else none
    if not len(inside):
        return none, none, none, none
    v = rolled(f.word_hash, run)
    step = 1
    while step < span:  # minima of 1, 2, 4, ... runs, at last of all of a window
        by = min(step, span - step)
        v = np.minimum(v[:-by], v[by:])
        step += by
    v, doc = v[inside].view(np.int64), f.doc[inside]
    new = np.ones(len(inside), bool)
    new[1:] = (v[1:] != v[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(new)
    place = np.arange(len(inside)) - np.repeat(first, np.diff(np.append(first, len(inside))))
    first = np.flatnonzero(place % span == 0)  # repeated words can keep an anchor for longer
    return doc[first], v[first], inside[first] - f.first[doc[first]], np.diff(np.append(first, len(inside)))


def _anchors(run: int):
    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for rows, f in slices(b.column(2)):
                doc, anchor, window, many = anchors(f, run)
                part = b.slice(rows.start, rows.stop - rows.start).select([0, 1]).take(pa.array(doc))
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(anchor), pa.array(window.astype(np.int32)), pa.array(many.astype(np.int32))],
                    ["doc_id", "key", "anchor", "window", "many"],
                )

    return rows_of


def _passages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cuts out the words of each run of windows, once where repeated rows come behind each other."""
    last = None
    for b in batches:
        for d, k, t, runs in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), b.column(3), strict=True):
            if (d, k) == last:
                continue
            last = d, k
            words = t.as_py()
            words = (words.encode() if isinstance(words, str) else words).split()
            r = runs.values.flatten()
            anchor, window, many = r[0], r[1].to_numpy(), r[2].to_numpy()
            cut = [b" ".join(words[w : w + m + WINDOW - 1]) for w, m in zip(window.tolist(), many.tolist(), strict=True)]
            n = len(cut)
            yield pa.RecordBatch.from_arrays(
                [pa.array([d] * n, pa.int64()), pa.array([k] * n, pa.int64()), anchor, r[1], r[2], pa.array(cut, pa.binary())],
                ["doc_id", "key", "anchor", "window", "many", "words"],
            )


def _symbols(passages: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of passages behind each other, a separator 0 behind each; the place of each one's first, and at last the end."""
    hashes, counts = [], []
    for _, f in slices(pa.array(passages, pa.binary())):
        hashes.append(f.word_hash)
        counts.append(np.diff(f.first))
    count = np.concatenate(counts)
    owner = np.repeat(np.arange(len(count)), count)
    ids = np.unique(np.concatenate(hashes), return_inverse=True)[1]
    symbols = np.zeros(len(ids) + len(count), np.int64)
    symbols[np.arange(len(ids)) + owner] = ids + 1
    return symbols, np.concatenate([[0], np.cumsum(count + 1)])


def earlier_windows(passages: list[bytes], docs: np.ndarray) -> list[int]:
    """For each passage, bit w says that its window w also starts in a passage with a smaller document."""
    symbols, place = _symbols(passages)
    docs = np.unique(docs, return_inverse=True)[1]
    index = FMIndex(symbols, np.repeat(docs, np.diff(place)), 2 * WINDOW)
    k, at = index.statistics(symbols, place[:-1], place[1:] - 1, docs, WINDOW)
    masks = np.zeros(len(passages), U64)
    np.bitwise_or.at(masks, k, U64(1) << at.astype(U64))
    return masks.view(np.int64).tolist()


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Builds and searches the indexes of one partition, which comes ordered by anchor."""

    def done(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        if not rows:
            return
        masks = earlier_windows([r[2] for r in rows], np.array([r[3] for r in rows], np.int64))
        found = [(r[0], r[1], m) for r, m in zip(rows, masks, strict=True) if m]
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], ["anchor", "content", "mask"])

    rows: list[tuple] = []
    size = 0
    for b in batches:
        for r in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if size > SHARD and r[0] != rows[-1][0]:
                yield from done(rows)
                rows, size = [], 0
            rows.append(r)
            size += r[4] + WINDOW
    yield from done(rows)


def _search(variants: DataFrame, runs: tuple[int, ...], made: list[DataFrame]) -> DataFrame:
    """anchor, content, mask of the passages of which some windows start earlier in another passage. made: takes the tables that the result reads."""
    n = written(variants.groupBy("anchor").agg(F.count("*").alias("variants")).where("variants > 1"), "varied")
    varied = variants.join(n, "anchor").select("anchor", "content", "words", "doc_id", "many", "variants")
    made.append(n)
    few = (varied.where(F.col("variants") <= HOT_PASSAGES) if runs else varied).drop("variants")
    found = few.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(_shards, "anchor long, content long, mask long")
    if not runs or n.where(F.col("variants") > HOT_PASSAGES).isEmpty():
        return found
    hot = written(varied.where(F.col("variants") > HOT_PASSAGES).select("anchor", "content", F.xxhash64("anchor", "content").alias("key"), "doc_id", F.col("words").alias("text")), "hot-passages")
    made.append(hot)
    inner = _covered(hot.select("doc_id", "key", "text"), made, runs).groupBy("doc_id", "key").agg(F.bit_or(F.expr("shiftleft(mask, window)")).alias("mask"))
    return found.unionByName(hot.select("doc_id", "key", "anchor", "content").join(inner, ["doc_id", "key"]).select("anchor", "content", "mask"))


def _covered(units: DataFrame, made: list[DataFrame], runs: tuple[int, ...] = RUNS) -> DataFrame:
    """doc_id, key, window, mask: bit w of the mask says that window + w starts earlier. units: doc_id, key of the text, text."""
    rows = written(units.mapInArrow(_anchors(runs[0]), "doc_id long, key long, anchor long, window int, many int"), "anchors")
    # Written, here and below, so that a join deals it anew and can split hot anchors.
    twice = written(rows.groupBy("anchor").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").select("anchor"), "recurring")
    # A set, so that repeated rows are one. Merged at every size: the recurring anchors grow with the documents.
    lists = rows.join(twice.hint("merge"), "anchor").groupBy("doc_id", "key").agg(F.collect_set(F.struct("anchor", "window", "many")).alias("runs"))
    passages = units.join(lists, ["doc_id", "key"]).select("doc_id", "key", "text", "runs")
    passages = passages.mapInArrow(_passages, "doc_id long, key long, anchor long, window int, many int, words binary")
    passages = written(passages.withColumn("content", F.xxhash64("words")), "passages")
    remove(rows, twice)
    variants = written(passages.groupBy("anchor", "content", "words", "many").agg(F.min("doc_id").alias("doc_id")), "variants")
    inner: list[DataFrame] = []
    masks = written(_search(variants, runs[1:], inner), "masks")
    remove(*inner)
    least = variants.select("anchor", "content", F.col("doc_id").alias("least")).join(masks, ["anchor", "content"], "left")
    least = written(least, "least")
    remove(variants, masks)
    made += [passages, least]
    full = F.expr("shiftleft(1L, many) - 1")  # many is at most 43
    found = passages.drop("words").join(least, ["anchor", "content"])
    found = found.withColumn("mask", F.when(F.col("doc_id") > F.col("least"), full).otherwise(F.col("mask"))).where(F.col("mask") != 0)
    return found.select("doc_id", "key", "window", "mask")


def find_repeats(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, key (hash of the text) and the covered windows as a list of (window, mask), for documents that have any."""
    prepare(docs.sparkSession)
    source = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("key"), F.col(text).alias("text"))
    made: list[DataFrame] = []
    found = _covered(source.where(F.octet_length("text") >= 2 * WINDOW - 1), made)
    covered = written(found.groupBy("doc_id", "key").agg(F.collect_set(F.struct("window", "mask")).alias("covered")), "covered")
    remove(*made)
    return covered


def covered_words(n: int, covered: list[dict]) -> np.ndarray:
    """Which of n words lie in a covered window."""
    edge = np.zeros(n + 1, np.int64)
    for c in covered:
        m, w = c["mask"], c["window"]
        while m:
            low = (m & -m).bit_length() - 1
            run = ((m >> low) + 1 & ~(m >> low)).bit_length() - 1  # consecutive ones
            edge[w + low] += 1
            edge[w + low + run - 1 + WINDOW] -= 1
            m &= ~(((1 << run) - 1) << low)
    return np.cumsum(edge[:-1]) > 0


def with_repeats(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows of docs with a column __covered (null: nothing found)."""
    covered = find_repeats(docs, text).select(F.col("doc_id").alias("__id"), F.col("key").alias("__key"), F.col("covered").alias("__covered"))
    return docs.join(covered, (docs["doc_id"] == F.col("__id")) & (F.xxhash64(docs[text]) == F.col("__key")), "left").drop("__id", "__key")


def repeat_digests(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed and the digest of the kept words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, gone, digest = [], [], []
            for t, c in zip(b.column(1), b.column(2), strict=True):
                words = (t.as_py() or "").encode().split()
                n.append(len(words))
                if c.is_valid:
                    out = covered_words(len(words), c.as_py())
                    words = [w for w, o in zip(words, out.tolist(), strict=True) if not o]
                gone.append(n[-1] - len(words))
                digest.append(hashlib.sha256(b" ".join(words)).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(digest, pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return with_repeats(docs.select("doc_id", text), text).select("doc_id", text, "__covered").mapInArrow(run, f"doc_id {kind}, n_words long, n_removed long, kept_sha256 string")


def cut_words(text: str, out: np.ndarray) -> str:
    """The text without the marked words and the white space behind each; the rest stays as it is."""
    f = Flat.of([text])
    start, end = f.words
    keep = np.ones(len(f.buf), bool)
    nxt = np.append(start[1:], len(f.buf))
    for i in np.flatnonzero(out):
        keep[start[i] : nxt[i]] = False
    return f.buf[keep].tobytes().decode().strip()


def remove_repeats(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows of docs, all columns, without the covered words; texts without any stay as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, covered = b.schema.get_field_index(text), b.column(b.num_columns - 1)
            rest = b.select(range(b.num_columns - 1))
            if covered.null_count < len(b):
                texts = b.column(at).to_pylist()
                for i, c in enumerate(covered):
                    if c.is_valid:
                        texts[i] = cut_words(texts[i], covered_words(len(texts[i].encode().split()), c.as_py()))
                rest = rest.set_column(at, rest.schema.field(at), pa.array(texts, rest.schema.field(at).type))
            yield rest

    return with_repeats(docs, text).mapInArrow(run, docs.schema)
