"""Labelled examples: synthetic values put into the sites of real files, cut into windows, split by file."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.files import stored
from .generate import Draws, Value, generate
from .golang import find_places
from .windows import training_windows

INJECTABLE = ("string", "raw_string", "comment")
_SPAN = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("label", pa.string()), ("text", pa.string())]))
SPAN = "array<struct<start:int,end:int,label:string,text:string>>"
EXAMPLE = f"repo string, path string, text string, spans {SPAN}, distractors {SPAN}"


def places(text: str) -> list[tuple[int, int, str]]:
    """Start, end and kind of the sites that values can be put into."""
    return [p for p in find_places(text) if p[2] in INJECTABLE]


def inject(repo: str, path: str, text: str, seed: object, split: str, most: int = 4, negative_rate: float = 0.4, sites: list[tuple[int, int, str]] | None = None) -> dict | None:
    """One file with up to ``most`` sites replaced; None if nothing fits, which no file with a string meets. sites: those of the text, if known."""
    d = Draws(seed, repo, path)
    free = d.shuffled(places(text) if sites is None else sites)
    chosen: list[tuple[int, int, str, Value]] = []
    for lo, hi, kind in free:
        if len(chosen) == most:
            break
        if any(lo < e and hi > s for s, e, _, _ in chosen):
            continue
        value = next((v for v in (generate(d, split, negative_rate) for _ in range(6)) if kind in v.kinds), None)
        if value:
            chosen.append((lo, hi, kind, value))
    if not chosen:
        # A string takes most kinds of values, so going on ends soon: files with strings always give an example.
        first = next((p for p in free if p[2] == "string"), None)
        if not first:
            return None
        value = next(v for v in iter(lambda: generate(d, split, negative_rate), None) if "string" in v.kinds)
        chosen.append((*first, value))
    pieces, at, size, marks = [], 0, 0, []
    for lo, hi, kind, v in sorted(chosen, key=lambda c: c[0]):
        lead = "// " if kind == "comment" else ""
        pieces += [text[at:lo], lead, v.text]
        size += lo - at + len(lead)
        start = size + v.label_start
        marks.append((v.entity is not None, {"start": start, "end": start + len(v.labeled), "label": v.entity or v.why, "text": v.labeled}))
        size += len(v.text)
        at = hi
    return {"repo": repo, "path": path, "text": "".join([*pieces, text[at:]]), "spans": [m for p, m in marks if p], "distractors": [m for p, m in marks if not p]}


def faults(ex: dict) -> list[str]:
    """What is wrong with an example: marks out of range, without their value, or over the next one."""
    marks = sorted([*ex["spans"], *ex["distractors"]], key=lambda m: (m["start"], m["end"]))
    out = []
    for m, after in zip(marks, [*marks[1:], None]):
        if not 0 <= m["start"] < m["end"] <= len(ex["text"]):
            out.append("range")
        elif ex["text"][m["start"] : m["end"]] != m["text"]:
            out.append("value")
        if after and after["start"] < m["end"]:
            out.append("overlap")
    return out


def _batch(rows: list[dict]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.string(), pa.string(), _SPAN, _SPAN)
    names = ("repo", "path", "text", "spans", "distractors")
    return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], k) for n, k in zip(names, kinds, strict=True)], list(names))


def may_have_sites(text: Column) -> Column:
    """Whether a text has a character that a site begins with: others need not be read in Python."""
    return text.contains('"') | text.contains("`") | text.contains("//") | text.contains("/*")


def inject_files(files: DataFrame, split: str, seed: int = 20260925, first: int = 0, passes: int = 1) -> DataFrame:
    """Examples from files, only those that hold what was put into them. Each pass over the files, counted from ``first``, draws anew."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for repo, path, text in zip(*(c.to_pylist() for c in b.columns[:3]), strict=True):
                sites = places(text or "")
                for n in range(first, first + passes if sites else first):
                    if (ex := inject(repo, path, text or "", f"{seed}:{n}", split, sites=sites)) and not faults(ex):
                        out.append(ex)
                    if len(out) == 200:
                        yield _batch(out)
                        out = []
            yield _batch(out)

    return files.select("repo", "path", "text").where(may_have_sites(F.col("text"))).mapInArrow(run, EXAMPLE)


def broken_examples(examples: DataFrame) -> DataFrame:
    """Spans that are out of range, do not hold their value, or overlap the next of their example: should be none."""
    e = examples.select("repo", "path", F.col("text").alias("all"), F.array_sort(F.concat("spans", "distractors")).alias("marks"))
    e = e.select("*", F.posexplode("marks").alias("i", "s")).withColumn("next", F.get("marks", F.col("i") + 1)["start"])
    s = e.select("repo", "path", "all", "next", "s.*")
    held = F.substring("all", F.col("start") + 1, F.col("end") - F.col("start")) == F.col("text")
    return s.where((F.col("start") < 0) | (F.col("end") <= F.col("start")) | (F.col("end") > F.length("all")) | ~held | (F.col("next") < F.col("end"))).drop("all", "next")


def split_files(files: DataFrame, seed: int = 20260925, val_fraction: float = 0.1) -> DataFrame:
    """repo, path, split: an exact share of the files, in the order of a hash, is for validation.

    Ranks are counted in 256 ranges of the hash and the ranges' running totals,
    so no task sorts all files.
    """
    f = files.select("repo", "path", _file_hash(seed).alias("h")).withColumn("range", F.substring("h", 1, 2))
    totals = f.groupBy("range").agg(F.count("*").alias("n"))
    all_ranges = Window.partitionBy(F.lit(0)).orderBy("range")
    totals = totals.withColumn("before", F.sum("n").over(all_ranges.rowsBetween(Window.unboundedPreceding, -1))).withColumn("total", F.sum("n").over(Window.partitionBy(F.lit(0))))
    f = f.join(F.broadcast(totals.select("range", F.coalesce("before", F.lit(0)).alias("before"), "total")), "range")  # 256 rows at most
    rank = F.col("before") + F.row_number().over(Window.partitionBy("range").orderBy("h", "repo", "path"))
    return f.select("repo", "path", F.when(rank <= F.floor(F.col("total") * F.lit(1 - val_fraction)), "train").otherwise("val").alias("split"))


def last_train(files: DataFrame, seed: int, val_fraction: float) -> tuple[str, str | None, str | None] | None:
    """Hash, repo and path of the last file for training, as ``split_files`` deals them; None if there is none.

    Files are counted in 65,536 ranges of the hash, and only those of one range are put in order.
    """
    f = files.select(_file_hash(seed).alias("h"), "repo", "path")
    counts = sorted(f.groupBy(F.substring("h", 1, 4).alias("range")).count().collect())  # 65,536 rows at most
    left = math.floor(sum(n for _, n in counts) * (1 - val_fraction))
    for at, n in counts:
        if 0 < left <= n:
            return tuple(f.where(F.substring("h", 1, 4) == at).orderBy("h", "repo", "path").limit(left).collect()[-1])
        left -= n
    return None


def _file_hash(seed: int) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), "repo", "path"))


def _lowest(w: DataFrame, n: int) -> DataFrame:
    """The n rows that are lowest by the column order, a hash. Whole ranges of it are kept as they are, and only the rest of one is sorted."""
    counts = sorted(w.groupBy(F.substring("order", 1, 3).alias("range")).count().collect())  # 4,096 rows at most
    below, edge = 0, None
    for at, k in counts:
        if below + k > n:
            edge = at
            break
        below += k
    if edge is None:
        return w
    of = F.substring("order", 1, 3)
    return w.where(of < edge).unionByName(w.where(of == edge).orderBy("order").limit(n - below))


def build(files: DataFrame, target: int = 30_000, seed: int = 20260925, val_fraction: float = 0.1) -> DataFrame:
    """split and windows of a dataset: ``target`` training windows and a share of that for validation.

    Validation draws from the held-out vocabulary. Passes over the files go on,
    twice as many each time, until the quota is met; a corpus of which no pass
    gives a window has an empty part. Files with sites are written once, without the others, and so are the windows of each pass.
    """
    files = files.select("repo", "path", "text")
    last = last_train(files, seed, val_fraction)
    place = F.struct(_file_hash(seed).alias("h"), "repo", "path")
    train = place <= F.struct(*[F.lit(x).cast("string").alias(c) for c, x in zip(("h", "repo", "path"), last, strict=True)]) if last else F.lit(False)
    parts = stored(files.where(may_have_sites(F.col("text"))).withColumn("train", train))
    out = None
    for split, vocab, quota, s in (("train", "train", target, seed), ("val", "eval", max(1, int(target * val_fraction)), seed + 1)):
        part, w = parts.where("train" if split == "train" else "not train"), None
        order = F.md5(F.concat_ws("|", F.lit(str(s)), "repo", "path", "text"))
        passes, have, first = 1, 0, 0
        while have < quota:
            more = stored(training_windows(inject_files(_spread(part, passes), vocab, s, first, passes)).withColumn("order", order))
            n = more.count()
            # Of the last passes only as many as the quota lacks, in the order of a hash.
            more = _lowest(more, quota - have) if n > quota - have else more
            w = more if w is None else w.unionByName(more)
            if not n:
                break
            have, first = min(quota, have + n), first + passes
            passes = max(passes, -(-(quota - have) // max(1, have // first)))
        w = w.drop("order").withColumn("split", F.lit(split))
        out = w if out is None else out.unionByName(w)
    return out


def _spread(part: DataFrame, passes: int) -> DataFrame:
    """Few files with many passes each are dealt to all cores."""
    return part.repartition(part.sparkSession.sparkContext.defaultParallelism, "repo", "path") if passes > 1 else part


def label_counts(dataset: DataFrame) -> DataFrame:
    """split, label, n over spans and distractors, most frequent first."""
    s = dataset.select("split", F.explode(F.concat("spans", "distractors")).alias("s"))
    return s.groupBy("split", F.col("s.label").alias("label")).agg(F.count("*").alias("n")).orderBy("split", F.col("n").desc(), "label")


def write_dataset(dataset: DataFrame, path: str) -> None:
    """train and val as JSON lines, and a summary."""
    dataset.write.mode("overwrite").partitionBy("split").json(f"{path}/windows")
    label_counts(dataset).write.mode("overwrite").json(f"{path}/summary")


def refuse_eval(set_name: str) -> None:
    """Training data never come from the evaluation set."""
    if set_name == "eval":
        raise ValueError("the eval set is for measuring only")
