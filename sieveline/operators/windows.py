"""Windows of text and tokens: scan windows, training windows, BIO alignment and decoding.

Scan windows follow from each other within a text, so they run as a loop over
one text at a time in Arrow batches. Tokens and their labels are made for many
texts at once with numpy; all else is columns and joins.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vocab as V

SIZE, OVERLAP, PAD = 1400, 250, 300
TRIM = " \t\r\n\"'`"
LABEL_ID = {label: i for i, label in enumerate(V.LABELS)}


def snap(text: Column, pos: Column, forward: bool) -> Column:
    """The line boundary at or after a position (behind the next newline), or the start of the position's line."""
    if forward:
        at = F.locate("\n", text, 1) if isinstance(pos, int) else F.instr(F.substring(text, pos + 1, F.length(text)), "\n")
        return F.when(at == 0, F.length(text)).otherwise(pos + at)
    return pos - F.length(F.substring_index(F.substring(text, F.lit(1), pos), "\n", -1))


def cut(text: str, size: int = SIZE, overlap: int = OVERLAP) -> list[tuple[int, int]]:
    """Start and end of overlapping windows that end behind a newline where there is one."""
    ends = [m.end() for m in re.finditer("\n", text)]

    def stop(start: int) -> int:
        """The last line's end within reach, from the second character on."""
        if start + size >= len(text):
            return len(text)
        below = bisect_right(ends, start + size)
        return ends[below - 1] if below and ends[below - 1] >= start + 2 else start + size

    windows = [(0, stop(0))]
    while windows[-1][1] < len(text):
        start = max(windows[-1][0] + 1, windows[-1][1] - overlap)
        windows.append((start, stop(start)))
    return windows


def scan_windows(texts: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    """The columns ``keep``, and number, start, end and chunk of each window of the column text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row, n, lo, hi, chunk = [], [], [], [], []
            for i, t in enumerate(b.column(b.num_columns - 1).to_pylist()):
                for k, (x, y) in enumerate(cut(t or "")):
                    row.append(i), n.append(k), lo.append(x), hi.append(y), chunk.append((t or "")[x:y])
            cols = [c.take(pa.array(row, pa.int64())) for c in b.columns[:-1]]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(n, pa.int32()), pa.array(lo, pa.int32()), pa.array(hi, pa.int32()), pa.array(chunk, pa.string())], [*keep, "window", "start", "end", "chunk"])

    return texts.select(*keep, "text").mapInArrow(run, f"{_schema(texts, keep)}, window int, start int, end int, chunk string")


def training_windows(examples: DataFrame, size: int = SIZE) -> DataFrame:
    """Line-aligned windows around clusters of the spans and distractors of examples, one row each with the columns of examples.

    A cluster takes in the next mark while the text from its first mark's start
    to that one's end leaves room for ``PAD`` on both sides.  Only marks that lie in a window
    as a whole go along, and windows without any are left out.
    """
    mark = "struct<first:int,last:int>"

    def join(done: Column, m: Column) -> Column:
        open_ = F.get(done, F.size(done) - 1)
        wider = F.struct(open_["first"].alias("first"), m["end"].alias("last")).cast(mark)
        alone = F.struct(m["start"].alias("first"), m["end"].alias("last")).cast(mark)
        fits = m["end"] - open_["first"] <= size - 2 * PAD
        return F.when(fits, F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(wider))).otherwise(F.concat(done, F.array(alone)))

    marks = F.array_sort(F.transform(F.concat("spans", "distractors"), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))))
    clusters = F.aggregate(marks, F.array().cast(f"array<{mark}>"), join)
    others = [c for c in examples.columns if c not in ("text", "spans", "distractors")]
    w = examples.select(*others, F.col("text").alias("all"), "spans", "distractors", F.explode(clusters).alias("c"))
    w = w.withColumn("lo", snap(F.col("all"), F.greatest(F.col("c.first") - PAD, F.lit(0)), False))
    w = w.withColumn("hi", snap(F.col("all"), F.least(F.col("c.last") + PAD, F.length("all")), True))
    w = w.withColumn("hi", F.when(F.col("hi") - F.col("lo") > size, snap(F.col("all"), F.col("lo") + size, False)).otherwise(F.col("hi")))
    moved = lambda s: s.withField("start", s["start"] - F.col("lo")).withField("end", s["end"] - F.col("lo"))
    inside = [F.transform(F.filter(c, lambda s: (s["start"] >= F.col("lo")) & (s["end"] <= F.col("hi"))), moved).alias(c) for c in ("spans", "distractors")]
    w = w.select(*others, F.substring("all", F.col("lo") + 1, F.col("hi") - F.col("lo")).alias("text"), *inside).where(F.size("spans") + F.size("distractors") > 0)
    return w.select(*examples.columns)


def marker(path: Column) -> Column:
    """The line that tells a model where a window comes from."""
    test = F.lower(path).contains("_test.go") | F.lower(path).contains("/testdata/")
    return F.concat(F.lit("[go] [path:"), path, F.lit("] [test:"), F.when(test, "yes").otherwise("no"), F.lit("]\n"))


#: Kinds of characters: white space, of words, marks (all from code point 128 on are marks).
_WHITE, _WORD, _MARK = 0, 1, 2
_KIND = np.array([_WORD if chr(c).isalnum() or c == 95 else _WHITE if chr(c) in " \t\n\r\f\v" else _MARK for c in range(128)] + [_MARK], np.uint8)
#: Characters whose tokens are found at once.
SLICE = 1 << 18


def find_tokens(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Number of the text, number in it, start and end of each match of ``[A-Za-z0-9_]+|[^A-Za-z0-9_\\s]``, in order."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    first = np.concatenate([[0], np.cumsum(sizes)])
    kind = _KIND[np.minimum(np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32), 128)]
    edge = np.zeros(len(kind) + 1, bool)
    edge[first] = True
    word, mark = kind == _WORD, kind == _MARK
    joined = np.zeros(len(kind) + 1, bool)  # at each place: whether one word stands on both sides
    joined[1:-1] = word[1:] & word[:-1]
    joined &= ~edge
    starts, ends = np.flatnonzero(mark | (word & ~joined[:-1])), np.flatnonzero(mark | (word & ~joined[1:])) + 1
    row = np.searchsorted(first, starts, "right") - 1
    before = np.searchsorted(starts, first[:-1])
    return row, np.arange(len(row)) - before[row], starts - first[row], ends - first[row]


def _slices(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Runs of texts with some ``SLICE`` characters each."""
    lo = n = 0
    for i, t in enumerate(texts):
        n += len(t)
        if n >= SLICE:
            yield lo, i + 1
            lo, n = i + 1, 0
    if lo < len(texts):
        yield lo, len(texts)


def _keyed(b: pa.RecordBatch, n: int, at: int, row: np.ndarray) -> list[pa.Array]:
    """The first n columns, a line for each row number counted from ``at``."""
    rows = pa.array(row + at, pa.int64())
    return [c.take(rows) for c in b.columns[:n]]


def _schema(df: DataFrame, keep: tuple[str, ...]) -> str:
    return ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep)


def tokens(texts: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    """Words and single marks of the column text, with offsets: the built-in stand-in for a model's tokenizer."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            all_ = [t or "" for t in b.column(len(keep)).to_pylist()]
            for lo, hi in _slices(all_):
                row, *places = find_tokens(all_[lo:hi])
                yield pa.RecordBatch.from_arrays([*_keyed(b, len(keep), lo, row), *[pa.array(x, pa.int32()) for x in places]], [*keep, "idx", "tok_start", "tok_end"])

    return texts.select(*keep, "text").mapInArrow(run, f"{_schema(texts, keep)}, idx int, tok_start int, tok_end int")


def with_spans(texts: DataFrame, spans: DataFrame, key: tuple[str, ...], how: str = "left") -> DataFrame:
    """Texts with their spans (key, start, end, label) as an array; with ``how`` inner only texts that have some."""
    mine = spans.groupBy(*key).agg(F.collect_set(F.struct(F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"), F.col("label").cast("string").alias("label"))).alias("spans"))
    return texts.select(*key, "text").join(mine.hint("shuffle_hash"), list(key), how)


def labelled(texts: DataFrame, key: tuple[str, ...], longest: int = 512, marked: bool = False) -> DataFrame:
    """What ``align`` says of the ``tokens`` of texts (key, text, spans: array of start, end and label, or null), text by text, so that no row of a token is moved.

    With ``marked`` only tokens of spans, which is all that ``decode`` reads.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            all_ = [t or "" for t in b.column(len(key)).to_pylist()]
            spans = b.column(len(key) + 1).to_pylist()
            for lo, hi in _slices(all_):
                row, idx, start, end = find_tokens(all_[lo:hi])
                near = idx < longest
                row, idx, start, end = row[near], idx[near], start[near], end[near]
                label, weight = np.zeros(len(row), np.int32), np.ones(len(row))
                edges = np.searchsorted(row, np.arange(hi - lo + 1))
                for i, of in enumerate(spans[lo:hi]):
                    x, y = edges[i], edges[i + 1]
                    for s, e, name in sorted({(s["start"], s["end"], s["label"]) for s in of or () if s["label"] in V.ENTITIES}):
                        # Tokens of a text are in order, so those over a span follow each other; the later span overwrites.
                        p, q = x + np.searchsorted(end[x:y], s, "right"), x + np.searchsorted(start[x:y], e, "left")
                        if p < q:
                            label[p:q], label[p], weight[p:q] = LABEL_ID[f"I-{name}"], LABEL_ID[f"B-{name}"], 1 / (q - p)
                if marked:
                    hit = label > 0
                    row, idx, start, end, label, weight = (c[hit] for c in (row, idx, start, end, label, weight))
                yield pa.RecordBatch.from_arrays(
                    [*_keyed(b, len(key), lo, row), *[pa.array(c, pa.int32()) for c in (idx, start, end, label)], pa.array(weight, pa.float64())], [*key, "idx", "tok_start", "tok_end", "label_id", "weight"]
                )

    return texts.select(*key, "text", "spans").mapInArrow(run, f"{_schema(texts, key)}, idx int, tok_start int, tok_end int, label_id int, weight double")


def align(toks: DataFrame, spans: DataFrame, key: tuple[str, ...], longest: int = 512) -> DataFrame:
    """BIO labels and weights of any tokenizer's tokens. spans: key, start, end, label. Of two spans over a token the later one counts. For ``tokens`` see ``labelled``."""
    t = toks.where(F.col("idx") < longest)
    wide = t.where("tok_end > tok_start").join(spans.where(F.col("label").isin(*V.ENTITIES)), list(key)).where("tok_end > start and tok_start < end")
    span = Window.partitionBy(*key, "start", "end", "label")
    wide = wide.withColumn("rank", F.row_number().over(span.orderBy("idx"))).withColumn("weight", 1 / F.count("*").over(span))
    last = Window.partitionBy(*key, "idx").orderBy(F.col("start").desc(), F.col("end").desc(), F.col("label").desc())
    wide = wide.withColumn("n", F.row_number().over(last)).where("n = 1")
    tagged = wide.select(*key, "idx", F.concat(F.when(F.col("rank") == 1, "B-").otherwise("I-"), "label").alias("tag"), "weight")
    ids = F.create_map(*[F.lit(x) for p in LABEL_ID.items() for x in p])
    empty = F.col("tok_end") <= F.col("tok_start")
    out = t.join(tagged, [*key, "idx"], "left")
    label = F.when(empty, -100).otherwise(F.coalesce(ids[F.col("tag")], F.lit(0)))
    return out.select(*key, "idx", "tok_start", "tok_end", label.cast("int").alias("label_id"), F.when(empty, 0.0).otherwise(F.coalesce("weight", F.lit(1.0))).alias("weight"))


def decode(aligned: DataFrame, key: tuple[str, ...], texts: DataFrame | None = None) -> DataFrame:
    """Spans of BIO labels: key, start, end, label; with texts, edges are trimmed of white space and quotes.

    Tokens outside of spans are dropped before anything is moved: their numbers are missing in the sequence, which ends a span as they do.
    """
    names = F.create_map(*[F.lit(x) for n, i in LABEL_ID.items() for x in (i, n)])
    w = Window.partitionBy(*key).orderBy("idx")
    # Ignored tokens end no span, so they stay until the runs are numbered.
    t = aligned.select(*key, "idx", "tok_start", "tok_end", "label_id").where("label_id <> 0 or tok_end <= tok_start").withColumn("run", F.col("idx") - F.row_number().over(w))
    t = t.where("tok_end > tok_start and label_id <> -100").withColumn("tag", names[F.col("label_id")]).withColumn("kind", F.substring("tag", 3, 20))
    t = t.withColumn("before", F.lag(F.struct("run", "kind")).over(w))
    opens = F.col("tag").startswith("B") | F.col("before").isNull() | (F.col("before.run") != F.col("run")) | (F.col("before.kind") != F.col("kind"))
    t = t.withColumn("island", F.sum(opens.cast("int")).over(w))
    out = t.groupBy(*key, "island").agg(F.min("tok_start").alias("start"), F.max("tok_end").alias("end"), F.first("kind").alias("label")).drop("island")
    if texts is None:
        return out
    out = out.join(texts.select(*key, "text"), list(key))
    piece = F.substring("text", F.col("start") + 1, F.col("end") - F.col("start"))
    edge = "[ \\t\\r\\n\"'`]*"
    left, right = F.length(F.regexp_extract(piece, f"^{edge}", 0)), F.length(F.regexp_extract(piece, f"{edge}\\z", 0))
    return out.select(*key, (F.col("start") + left).alias("start"), (F.col("end") - right).alias("end"), "label").where("end > start")


def misaligned(aligned: DataFrame, spans: DataFrame, key: tuple[str, ...]) -> DataFrame:
    """Spans that begin inside the window but have no B of their label or are not covered by it: should be none."""
    names = F.create_map(*[F.lit(x) for n, i in LABEL_ID.items() for x in (i, n)])
    a = aligned.where("tok_end > tok_start").withColumn("tag", names[F.col("label_id")]).withColumn("kind", F.substring("tag", 3, 20))
    last = a.groupBy(*key).agg(F.max("tok_end").alias("last"))
    hull = a.where("tag <> 'O'").groupBy(*key, F.col("kind").alias("label")).agg(F.min("tok_start").alias("lo"), F.max("tok_end").alias("hi"), F.bool_or(F.col("tag").startswith("B")).alias("b"))
    s = spans.where(F.col("label").isin(*V.ENTITIES)).join(last, list(key)).where("start < last").join(hull, [*key, "label"], "left")
    return s.where(F.col("b").isNull() | ~F.col("b") | (F.col("lo") > F.col("start")) | (F.col("hi") < F.least("end", "last")))


def score_window(text: Column, start: Column, end: Column, reach: int = 700) -> tuple[Column, Column]:
    """Text around a gold span, its lower edge moved back to a line start, and the span's offset in it."""
    low = snap(text, F.greatest(start - reach, F.lit(0)), False)
    return F.substring(text, low + 1, F.least(end + reach, F.length(text)) - low), start - low


def round_trip_failures(windows: DataFrame, key: tuple[str, ...]) -> DataFrame:
    """Spans of labelled windows that labelling and decoding do not bring back (cut-off tokens aside): should be none. windows: key, text, spans."""
    spans = windows.select(*key, F.explode("spans").alias("s")).select(*key, "s.start", "s.end", "s.label").where(F.col("label").isin(*V.ENTITIES))
    labels = labelled(windows, key)
    found = decode(labels, key, windows).select(*[F.col(k).alias(f"_{k}") for k in key], F.col("start").alias("lo"), F.col("end").alias("hi"), F.col("label").alias("kind"))
    last = labels.groupBy(*key).agg(F.max("tok_end").alias("last"))
    inside = spans.join(last, list(key)).where("end <= last")
    on = [F.col(k) == F.col(f"_{k}") for k in key] + [F.col("label") == F.col("kind"), F.col("lo") <= F.col("start"), F.col("hi") >= F.col("end")]
    return inside.join(found, on, "left_anti")
