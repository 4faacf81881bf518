"""Host-level quality rules.

Each text gets four counts and a base verdict.  Failures are then summed by
host, each host's failure rate is shrunk towards the others' by a beta prior
fitted to all hosts by moments, and the host's verdict is joined back: a
document stays if it passes itself and its host's shrunk rate is at most
``max_host_rate``.

Defined cases: a null or empty text has no words and fails; a null host is a
host of its own; repeated rows count each; an empty table gives an empty
table; further columns of the input are not read, so they cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import prepare, written
from .text import Flat, in_groups, per_doc, slices

#: Characters that count as symbols.
SYMBOLS = b"#*$%&|<>"
WINDOW = 5
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(SYMBOLS)] = True
COUNTS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


def counts(f: Flat) -> dict[str, np.ndarray]:
    """The rule counts of each document of a slice."""
    out = {
        "n_words": np.diff(f.first),
        "word_chars": f.count(~f._space & ((f.buf & 0xC0) != 0x80)),
        "n_symbols": f.count(_SYMBOL[f.buf]),
    }
    # Lines: cut behind each \n and at the ends of documents.
    cut = np.unique(np.concatenate([f.off, np.flatnonzero(f.buf == 10) + 1]))
    start, end = cut[:-1], cut[1:]
    filled = per_doc(~f._space, cut) > 0
    start, end = start[filled], end[filled]
    end = end - (f.buf[end - 1] == 10) if len(end) else end
    doc = np.searchsorted(f.off, start, "right") - 1
    order, new = in_groups(doc, f.hashes(start, end))
    out["n_dup_lines"] = np.bincount(doc[order][~new], minlength=len(f))
    g, at = f.grams(WINDOW)
    order, new = in_groups(f.doc[at], g)
    again = ~new
    again[:-1] |= ~new[1:]
    edge = np.zeros(len(f.doc) + 1, np.int64)
    hit = at[order[again]]
    np.add.at(edge, hit, 1)
    np.add.at(edge, hit + WINDOW, -1)
    out["n_repeat_words"] = per_doc(np.cumsum(edge[:-1]) > 0, f.first)
    return out


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for rows, f in slices(b.column(2)):
            part = b.slice(rows.start, rows.stop - rows.start)
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), *(pa.array(v, pa.int64()) for v in counts(f).values())],
                ["doc_id", "host", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"],
            )


def beta_prior(hosts: DataFrame) -> tuple[float, float]:
    """Parameters of the beta prior, by moments of the hosts' failure rates.

    A host of n documents has a rate of variance between-host + m(1-m)/n, so
    the mean of m(1-m)/n is taken off before matching.  Only one row of sums
    comes to the driver.
    """
    r = hosts.select((F.col("n_failed") / F.col("n_docs")).alias("r"), "n_docs").agg(
        F.count("*").alias("k"), F.avg("r").alias("m"), F.var_pop("r").alias("v"), F.avg(1 / F.col("n_docs")).alias("i")
    ).first()
    if not r.k or r.m <= 0 or r.m >= 1:
        return 1.0, 1.0
    between = max(r.v - r.m * (1 - r.m) * r.i, 1e-4 * r.m * (1 - r.m))
    strength = max(r.m * (1 - r.m) / between - 1, 2.0)
    return r.m * strength, (1 - r.m) * strength


def host_rules(docs: DataFrame, host: str = "source", text: str = "text", min_words: int = 10, max_repeat_pct: int = 20, max_host_rate: float = 0.5) -> DataFrame:
    """Counts, base verdict, the host's shrunk rate and the final verdict of each row."""
    prepare(docs.sparkSession)
    measured = docs.select("doc_id", F.col(host).cast("string").alias("host"), F.col(text).alias("text")).mapInArrow(
        _measure, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, host string, {COUNTS}"
    )
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_pct * F.col("n_words"))
    measured = written(measured.withColumn("base_failed", failed), "rules")
    hosts = measured.groupBy("host").agg(F.count("*").alias("n_docs"), F.sum(F.col("base_failed").cast("long")).alias("n_failed"))
    a, b = beta_prior(hosts)
    hosts = hosts.select(F.col("host").alias("of"), ((F.col("n_failed") + F.lit(a)) / (F.col("n_docs") + F.lit(a + b))).alias("host_rate"))
    return (
        measured.join(hosts, F.col("host").eqNullSafe(F.col("of")), "left")
        .withColumn("kept", ~F.col("base_failed") & (F.col("host_rate") <= F.lit(max_host_rate)))
        .drop("of")
    )
