"""A token classifier behind a small interface: hashed context features and multinomial logistic regression.

It stands in for a pretrained encoder, which is not available here; its scores
say nothing about that encoder's.  Any object with ``transform`` that adds
``prediction`` and ``probability`` to token rows can take its place; what
``train`` fits is applied text by text with numpy.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import asdict, dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vocab as V
from ..sources.files import stored
from . import windows as W

KEY = ("repo", "path", "window")


@dataclass(frozen=True)
class Config:
    max_tokens: int = 512
    features: int = 1 << 14
    epochs: int = 30
    l2: float = 1e-4
    seed: int = 20260925


def featured(tokens: DataFrame, texts: DataFrame, key: tuple[str, ...] = KEY) -> DataFrame:
    """Adds words: the token, its shape and length class, and its neighbours', as strings to hash."""
    t = tokens.join(texts.select(*key, "text"), list(key)).withColumn("tok", F.substring("text", F.col("tok_start") + 1, F.col("tok_end") - F.col("tok_start"))).drop("text")
    shape = F.regexp_replace(F.regexp_replace(F.regexp_replace("tok", "[A-Z]+", "A"), "[a-z]+", "a"), "[0-9]+", "9")
    t = t.withColumn("shape", shape)
    w = Window.partitionBy(*key).orderBy("idx")
    words = [F.concat(F.lit("w="), F.lower("tok")), F.concat(F.lit("s="), "shape"), F.concat(F.lit("n="), F.least(F.length("tok"), F.lit(40)).cast("string"))]
    for off in NEAR:
        words += [F.concat(F.lit(f"{off}w="), F.coalesce(F.lower(F.lag("tok", -off).over(w)), F.lit("-"))), F.concat(F.lit(f"{off}s="), F.coalesce(F.lag("shape", -off).over(w), F.lit("-")))]
    return t.withColumn("words", F.array(*words))


def weighted(aligned: DataFrame, class_weights: DataFrame) -> DataFrame:
    """Adds loss_weight: the span's weight times the label's. Ignored tokens go."""
    ids = F.create_map(*[F.lit(x) for n, i in W.LABEL_ID.items() for x in (n, i)])
    c = class_weights.select(ids[F.col("label")].alias("label_id"), F.col("weight").alias("class_weight"))
    return aligned.where("label_id <> -100").join(F.broadcast(c), "label_id").withColumn("loss_weight", F.col("weight") * F.col("class_weight"))  # 13 rows


def train(rows: DataFrame, config: Config = Config()):
    """A fitted model from featured, weighted token rows (words, label_id, loss_weight)."""
    hashing = HashingTF(inputCol="words", outputCol="features", numFeatures=config.features, binary=True)
    lr = LogisticRegression(labelCol="label_id", weightCol="loss_weight", maxIter=config.epochs, regParam=config.l2, family="multinomial")
    return Pipeline(stages=[hashing, lr]).fit(rows.withColumn("label_id", F.col("label_id").cast("double")))


def predict(model, rows: DataFrame) -> DataFrame:
    """Token rows with label_id and the probability of the label taken."""
    out = model.transform(rows)
    return out.withColumn("label_id", F.col("prediction").cast("int")).withColumn("p", F.array_max(vector_to_array("probability"))).drop("rawPrediction", "probability", "prediction", "features")


def murmur3(data: bytes, seed: int = 42) -> int:
    """The signed 32-bit hash that HashingTF takes of a word."""
    h, full = seed, len(data) & ~3
    mix = lambda k: (((k * 0xCC9E2D51) & 0xFFFFFFFF) << 15 | ((k * 0xCC9E2D51) & 0xFFFFFFFF) >> 17) * 0x1B873593 & 0xFFFFFFFF
    for i in range(0, full, 4):
        h ^= mix(int.from_bytes(data[i : i + 4], "little"))
        h = ((h << 13 | h >> 19) * 5 + 0xE6546B64) & 0xFFFFFFFF
    if full < len(data):
        h ^= mix(int.from_bytes(data[full:], "little"))
    h ^= len(data)
    h = ((h ^ h >> 16) * 0x85EBCA6B) & 0xFFFFFFFF
    h = ((h ^ h >> 13) * 0xC2B2AE35) & 0xFFFFFFFF
    h ^= h >> 16
    return h - (1 << 32) if h >> 31 else h


#: Neighbours that ``featured`` looks at.
NEAR = (-3, -2, -1, 1, 2, 3)


@lru_cache(1 << 17)
def _hashes(tok: str | None, size: int) -> tuple[int, ...]:
    """Places of a token's words: its own three, then two for each distance at which it stands as a neighbour; None: beyond the text."""
    shape = "-" if tok is None else re.sub("[0-9]+", "9", re.sub("[a-z]+", "a", re.sub("[A-Z]+", "A", tok)))
    low = "-" if tok is None else tok.lower()
    words = [f"w={low}", f"s={shape}", f"n={min(len(tok or ''), 40)}", *[w for off in NEAR for w in (f"{off}w={low}", f"{off}s={shape}")]]
    return tuple(murmur3(w.encode()) % size for w in words)


@dataclass(frozen=True)
class Linear:
    """What ``train`` fits, as numbers: a row of weights for each place of a hashed word (a last one of zeros), and a start for each label."""

    weights: np.ndarray
    start: np.ndarray

    @classmethod
    def of(cls, model) -> Linear | None:
        """None if the model is something else."""
        stages = getattr(model, "stages", [])
        if [type(x) for x in stages] != [HashingTF, LogisticRegressionModel] or not stages[0].getBinary() or stages[1].interceptVector.size < 3 or stages[1].isDefined("thresholds"):
            return None
        w = stages[1].coefficientMatrix.toArray().T
        return cls(np.vstack([w, np.zeros((1, w.shape[1]))]), stages[1].interceptVector.toArray())

    def labels(self, texts: list[str]) -> tuple[np.ndarray, ...]:
        """Number of the text, number in it, start, end, label and its probability of each token."""
        row, idx, start, end = W.find_tokens(texts)
        size, known = len(self.weights) - 1, {}
        ids = np.fromiter((known.setdefault(texts[r][x:y], len(known)) for r, x, y in zip(row.tolist(), start.tolist(), end.tolist())), np.int64, len(row))
        table = np.array([_hashes(t, size) for t in [*known, None]], np.int64)
        label, p = np.zeros(len(row), np.int64), np.zeros(len(row))
        for lo in range(0, len(row), 1 << 14):
            at = np.arange(lo, min(lo + (1 << 14), len(row)))
            cols = [table[ids[at], k] for k in range(3)]
            for k, off in enumerate(NEAR):
                to = np.clip(at + off, 0, len(row) - 1)
                near = np.where((to == at + off) & (row[to] == row[at]), ids[to], len(known))
                cols += [table[near, 3 + 2 * k], table[near, 4 + 2 * k]]
            of = np.sort(np.stack(cols, 1), 1)
            of[:, 1:][of[:, 1:] == of[:, :-1]] = size  # a word counts once
            raw = np.tile(self.start, (len(at), 1))
            for k in range(of.shape[1]):
                raw += self.weights[of[:, k]]
            label[at] = raw.argmax(1)
            p[at] = 1 / np.exp(raw - raw.max(1, keepdims=True)).sum(1)
        return row, idx, start, end, label, p

    def spans(self, texts: list[str]) -> list[tuple[int, int, int, str, float]]:
        """Number of the text, start, end, entity of each decoded span, and the probability of the first token that it keeps."""
        row, idx, start, end, label, p = self.labels(texts)
        out, island = [], []

        def close() -> None:
            if island:
                r, name, lo, hi = island[0][0], V.LABELS[island[0][4]][2:], island[0][2], island[-1][3]
                piece = texts[r][lo:hi]
                lo, hi = lo + len(piece) - len(piece.lstrip(W.TRIM)), hi - len(piece) + len(piece.rstrip(W.TRIM))
                if hi > lo:
                    out.append((r, lo, hi, name, next(t[5] for t in island if t[3] > lo)))
                island.clear()

        hit = label > 0
        for t in zip(*(c[hit].tolist() for c in (row, idx, start, end, label, p))):
            name = V.LABELS[t[4]]
            if not island or name.startswith("B") or island[-1][:2] != (t[0], t[1] - 1) or V.LABELS[island[-1][4]][2:] != name[2:]:
                close()
            island.append(t)
        close()
        return out


def linear_spans(model: Linear, win: DataFrame) -> DataFrame:
    """repo, path, start and end in the file, label and p of spans in windows (repo, path, base, text), text by text: no row of a token is moved."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, base = b.column(3).to_pylist(), b.column(2).to_pylist()
            for lo, hi in W._slices(texts):
                rows, starts, ends, names, ps = zip(*found) if (found := model.spans(texts[lo:hi])) else [()] * 5
                off = [base[lo + r] for r in rows]
                keys = W._keyed(b, 2, lo, np.array(rows, np.int64))
                places = [pa.array([o + x for o, x in zip(off, c)], pa.int32()) for c in (starts, ends)]
                yield pa.RecordBatch.from_arrays([*keys, *places, pa.array(names, pa.string()), pa.array(ps, pa.float64())], ["repo", "path", "start", "end", "label", "p"])

    return win.select("repo", "path", "base", "text").mapInArrow(run, "repo string, path string, start int, end int, label string, p double")


def any_spans(model, win: DataFrame) -> DataFrame:
    """The same for any model."""
    toks = predict(model, featured(W.tokens(win, KEY), win))
    spans = W.decode(toks, KEY, win)
    opens = spans.join(toks.select(*KEY, "idx", "tok_start", "tok_end", "p"), list(KEY)).where("tok_end > start and tok_start < end")
    spans = opens.groupBy(*KEY, "start", "end", "label").agg(F.min_by("p", "idx").alias("p")).join(win.select(*KEY, "base"), list(KEY))
    return spans.select("repo", "path", (F.col("base") + F.col("start")).alias("start"), (F.col("base") + F.col("end")).alias("end"), "label", "p")


def scan(model, files: DataFrame, min_confidence: float = 0.0) -> DataFrame:
    """Findings of a model over files: windows, decoding, confidence of the token that opens a span, the best at each place."""
    win = W.scan_windows(files, ("repo", "path")).withColumnRenamed("start", "base").withColumnRenamed("chunk", "text")
    spans = linear_spans(known, win) if (known := Linear.of(model)) else any_spans(model, win)
    spans = spans.withColumn("confidence", F.round("p", 3)).where(F.col("confidence") >= min_confidence)
    # Written, as the order below reads its input twice.
    best = stored(spans.groupBy("repo", "path", "start", "end", F.col("label").alias("entity")).agg(F.max("confidence").alias("confidence")))
    best = best.join(files.select("repo", "path", "text"), ["repo", "path"])
    before = F.substring("text", F.lit(1), F.col("start"))
    line = F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit(""))) + 1
    out = best.withColumn("line", line).withColumn("col", F.length(F.substring_index(before, "\n", -1)) + 1).withColumn("value", F.substring("text", F.col("start") + 1, F.col("end") - F.col("start")))
    return out.withColumn("detector", F.lit("model")).drop("text").orderBy("path", "start")


def history(config: Config, metrics: list[dict]) -> dict:
    """What a run writes down: its settings as text, and the measures of each round."""
    return {"config": {k: str(v) for k, v in asdict(config).items()}, "rounds": metrics}


def labels() -> tuple[str, ...]:
    return V.LABELS
