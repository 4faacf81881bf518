"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics come from the whole text.  Trees grow level by level on histograms
of at most ``BINS`` quantile bins and end up in three arrays (feature, cut and
leaf value of each node of complete trees), which numpy walks for all rows of a
batch at once.

The trees are fitted on the driver to a bounded sample of labelled rows:
``sample`` rows (30,000 unless told otherwise) with the smallest hashes of
their doc_id.  Everything else covers all rows.

Defined cases: null counts as empty, and empty texts get a score like others;
a null doc_id is not held out and never a training row; repeated labels of a
document count once (the largest); without any labelled row all scores are
0.5; repeated rows each get a row; further columns of the input are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .quality_rules import SYMBOLS, counts
from .store import prepare, written
from .text import Flat, in_groups, per_doc, slices

BINS = 64
FEATURES = (
    "log_bytes", "log_words", "word_length", "upper", "digits", "punctuation", "exclamation", "symbols", "symbol_words", "non_ascii", "newlines",
    "caps_words", "ended_words", "distinct_words", "top_word", "dup_lines", "repeat_words", "repeat_grams", "line_length", "last_byte_is_stop",
)


def _table(chars: bytes) -> np.ndarray:
    t = np.zeros(256, bool)
    t[list(chars)] = True
    return t


_UPPER = _table(bytes(range(65, 91)))
_LOWER = _table(bytes(range(97, 123)))
_DIGIT = _table(b"0123456789")
_PUNCT = _table(b"!\"'(),-./:;?@[]_`{}~^\\+=")
_SYMBOL = _table(SYMBOLS)
_END = _table(b".!?,;:")


def statistics(f: Flat) -> np.ndarray:
    """A row of FEATURES for each document."""
    c = counts(f)
    n_bytes = np.maximum(np.diff(f.off), 1)
    n_words = np.maximum(c["n_words"], 1)
    start, end = f.words
    buf = f.buf
    last = buf[end - 1] if len(end) else buf[:0]
    upper = np.zeros(len(buf) + 1, np.int64)
    np.cumsum(_UPPER[buf], out=upper[1:])
    lower = np.zeros(len(buf) + 1, np.int64)
    np.cumsum(_LOWER[buf] | (buf >= 128), out=lower[1:])
    caps = (upper[end] - upper[start] > 1) & (lower[end] == lower[start])
    order, new = in_groups(f.doc, f.word_hash)
    distinct = np.bincount(f.doc[order][new], minlength=len(f))
    top = np.zeros(len(f), np.int64)
    run = np.flatnonzero(new)
    np.maximum.at(top, f.doc[order][run], np.diff(np.append(run, len(order))))
    g, at = f.grams(3)
    o3, n3 = in_groups(f.doc[at], g)
    repeat = np.bincount(f.doc[at][o3][~n3], minlength=len(f))
    newlines = f.count(buf == 10)
    final = np.zeros(len(f))
    filled = np.flatnonzero(c["n_words"])
    final[filled] = _END[last[f.first[1:][filled] - 1]]
    cols = (
        np.log1p(np.diff(f.off)), np.log1p(c["n_words"]), c["word_chars"] / n_words, f.count(_UPPER[buf]) / n_bytes, f.count(_DIGIT[buf]) / n_bytes,
        f.count(_PUNCT[buf]) / n_bytes, f.count(buf == 33) / n_words, c["n_symbols"] / n_words, per_doc(_SYMBOL[last], f.first) / n_words,
        f.count(buf >= 128) / n_bytes, newlines / n_words, per_doc(caps, f.first) / n_words, per_doc(_END[last], f.first) / n_words,
        distinct / n_words, top / n_words, c["n_dup_lines"] / (newlines + 1), c["n_repeat_words"] / n_words, repeat / n_words, n_bytes / (newlines + 1), final,
    )
    return np.stack(cols, axis=1).astype(np.float32)


@dataclass
class Trees:
    """Complete trees of one depth; node k has children 2k+1 and 2k+2."""

    base: float
    feature: np.ndarray
    cut: np.ndarray
    leaf: np.ndarray

    def margin(self, x: np.ndarray) -> np.ndarray:
        trees, inner = self.feature.shape
        row, tree = np.arange(len(x))[:, None], np.arange(trees)[None, :]
        at = np.zeros((len(x), trees), np.int64)
        for _ in range(int(np.log2(inner + 1))):
            at = 2 * at + 1 + (x[row, self.feature[tree, at]] > self.cut[tree, at])
        return self.base + self.leaf[tree, at - inner].sum(axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, rate: float = 0.12, l2: float = 5.0, least: int = 20) -> Trees:
    """Logistic boosting on histograms."""
    n, m = x.shape
    inner = 2**depth - 1
    out = Trees(0.0, np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf, np.float32), np.zeros((trees, inner + 1)))
    if not n or y.min() == y.max():
        out.base = 0.0 if not n else (3.0 if y[0] else -3.0)
        return out
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1]).astype(np.float32)) for j in range(m)]
    binned = np.stack([np.searchsorted(cuts[j], x[:, j]) for j in range(m)], axis=1)  # a value at a cut stays left
    out.base = float(np.log(y.mean() / (1 - y.mean())))
    margin = np.full(n, out.base)
    offset = np.arange(m) * BINS
    for t in range(trees):
        p = 1 / (1 + np.exp(-margin))
        grad, hess = y - p, p * (1 - p)
        node = np.zeros(n, np.int64)
        for level in range(depth):
            width, first = 2**level, 2**level - 1
            key = ((node - first)[:, None] * (m * BINS) + offset + binned).ravel()
            size = width * m * BINS
            sums = [np.bincount(key, np.repeat(v, m), size).reshape(width, m, BINS).cumsum(axis=2) for v in (grad, hess, np.ones(n))]
            g, h, c = (s[:, :, :-1] for s in sums)
            G, H, C = (s[:, :, -1:] for s in sums)
            gain = g**2 / (h + l2) + (G - g) ** 2 / (H - h + l2) - G**2 / (H + l2)
            gain[(c < least) | (C - c < least)] = -1
            for j in range(m):
                gain[:, j, len(cuts[j]) :] = -1
            best = gain.reshape(width, -1).argmax(axis=1)
            for k in range(width):
                if gain[k].flat[best[k]] > 1e-6:
                    j, b = divmod(int(best[k]), BINS - 1)
                    out.feature[t, first + k], out.cut[t, first + k] = j, cuts[j][b]
            node = 2 * node + 1 + (x[np.arange(n), out.feature[t, node]] > out.cut[t, node])
        end = node - inner
        G, H = np.bincount(end, grad, inner + 1), np.bincount(end, hess, inner + 1)
        out.leaf[t] = rate * G / (H + l2)
        margin += out.leaf[t][end]
    return out


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for rows, f in slices(b.column(1)):
            x = statistics(f)
            flat = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float32()))
            yield pa.RecordBatch.from_arrays([b.column(0).slice(rows.start, len(f)), flat], ["doc_id", "x"])


def _rows(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), len(FEATURES))


def labelled(labels: DataFrame, label: str, folds: int, held: int) -> DataFrame:
    """id, y: labels outside the held-out fold."""
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(folds))
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & (fold != held))
    return known.groupBy(F.col("doc_id").alias("id")).agg(F.max(label).cast("int").alias("y"))


def held_out(folds: int, held: int):
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(folds))
    return F.coalesce(fold == held, F.lit(False))


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id and the statistics x of each row."""
    prepare(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", text).mapInArrow(_measure, f"doc_id {kind}, x array<float>")


def sampled(labels: DataFrame, sample: int) -> DataFrame:
    """id, y of the bounded sample of labelled rows outside the held-out fold."""
    return labelled(labels, "quality", 4, 2).orderBy(F.xxhash64("id"), "id").limit(sample)


def train(stats: DataFrame, chosen: DataFrame, sample: int) -> Trees:
    """Trees from the sampled rows."""
    rows = stats.join(chosen, F.col("doc_id") == F.col("id")).select("id", "y", "x").orderBy(F.xxhash64("id"), "id").limit(sample).toArrow()
    y = rows.column("y").to_numpy().astype(float)
    x = np.concatenate([_rows(c) for c in rows.column("x").chunks]) if len(y) else np.zeros((0, len(FEATURES)), np.float32)
    order = np.argsort(rows.column("id").to_numpy(), kind="stable")
    return fit(x[order], y[order])


def scored(stats: DataFrame, trees: Trees, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score and predicted. The model is a few thousand numbers and travels with the tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = np.concatenate([trees.score(_rows(b.column(1).slice(i, 2000))) for i in range(0, len(b), 2000)]) if len(b) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s)], ["doc_id", "score"])

    kind = stats.schema["doc_id"].dataType.simpleString()
    out = stats.select("doc_id", "x").mapInArrow(run, f"doc_id {kind}, score double")
    return out.select("doc_id", held_out(4, 2).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def classify_quality(docs: DataFrame, labels: DataFrame, sample: int = 30_000, threshold: float = 0.7) -> DataFrame:
    stats = written(measured(docs), "statistics")
    return scored(stats, train(stats, sampled(labels, sample), sample), threshold)


def keep_good(docs: DataFrame, labels: DataFrame, sample: int = 30_000, threshold: float = 0.7) -> DataFrame:
    """The rows of docs, all columns, that the classifier accepts."""
    prepare(docs.sparkSession)
    chosen = written(sampled(labels, sample), "quality-sample")
    # At most ``sample`` ids, so they can be sent to every task.
    trees = train(measured(docs.select("doc_id", "text").join(F.broadcast(chosen.select("id")), F.col("doc_id") == F.col("id"), "left_semi")), chosen, sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for rows, f in slices(b.column("text")):
                yield b.slice(rows.start, len(f)).filter(pa.array(trees.score(statistics(f)) >= threshold))

    return docs.mapInArrow(run, docs.schema)
