"""Span precision, recall and F1; class weights; scoring of gold spans by a model."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vocab as V


def exact_matches(pred: DataFrame, gold: DataFrame, key: tuple[str, ...]) -> DataFrame:
    """label, tp, fp, fn of spans equal in place and label; repeated spans pair up one to one."""
    span = [*key, "label", "start", "end"]
    w = Window.partitionBy(*span).orderBy(F.lit(0))
    p = pred.where(F.col("label").isin(*V.ENTITIES)).withColumn("n", F.row_number().over(w)).withColumn("p", F.lit(1))
    g = gold.where(F.col("label").isin(*V.ENTITIES)).withColumn("n", F.row_number().over(w)).withColumn("g", F.lit(1))
    both = p.select(*span, "n", "p").join(g.select(*span, "n", "g"), [*span, "n"], "full")
    hit, lone = F.col("p").isNotNull() & F.col("g").isNotNull(), F.col("g").isNull()
    return both.groupBy("label").agg(F.count_if(hit).alias("tp"), F.count_if(lone).alias("fp"), F.count_if(F.col("p").isNull()).alias("fn"))


def overlap_matches(pred: DataFrame, gold: DataFrame, key: tuple[str, ...]) -> DataFrame:
    """label, tp, fp, fn of spans that overlap and agree in label; predictions in order each take the first free gold span.

    The order decides, so a window's spans (a few) are matched together.
    """
    both = pred.select(*key, "label", "start", "end", F.lit(0).alias("side")).unionByName(gold.select(*key, "label", "start", "end", F.lit(1).alias("side")))
    both = both.where(F.col("label").isin(*V.ENTITIES)).groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("start", "end", "label", "side"))).alias("all"))

    def match(spans: list[dict], counts: dict[str, list[int]]) -> None:
        free = [g for g in spans if g["side"]]
        for p in spans:
            if not p["side"]:
                hit = next((i for i, g in enumerate(free) if g["label"] == p["label"] and p["end"] > g["start"] and p["start"] < g["end"]), None)
                counts[p["label"]][hit is None] += 1
                if hit is not None:
                    del free[hit]
        for g in free:
            counts[g["label"]][2] += 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts = defaultdict(lambda: [0, 0, 0])
            for spans in b.column(0).to_pylist():
                match(spans, counts)
            yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), *[pa.array([c[i] for c in counts.values()], pa.int64()) for i in range(3)]], ["label", "tp", "fp", "fn"])

    return both.select("all").mapInArrow(run, "label string, tp long, fp long, fn long").groupBy("label").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")])


def scores(matches: DataFrame) -> DataFrame:
    """Precision, recall and F1 of every entity, 0 where there is nothing to divide by."""
    names = matches.sparkSession.createDataFrame([(e,) for e in V.ENTITIES], "label string")
    m = names.join(matches, "label", "left").na.fill(0)
    p = F.when(F.col("tp") + F.col("fp") > 0, F.col("tp") / (F.col("tp") + F.col("fp"))).otherwise(0.0)
    r = F.when(F.col("tp") + F.col("fn") > 0, F.col("tp") / (F.col("tp") + F.col("fn"))).otherwise(0.0)
    m = m.withColumn("p", p).withColumn("r", r).withColumn("f1", F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0))
    return m.select("label", "tp", "fp", "fn", *[F.round(c, 6).alias(c) for c in ("p", "r", "f1")])


def macro_f1(scores_: DataFrame) -> DataFrame:
    return scores_.agg(F.round(F.avg("f1"), 6).alias("macro_f1"))


def class_weights(windows: DataFrame) -> DataFrame:
    """label, weight: inverse square root of estimated token counts, mean 1. windows: text, spans array<struct<label, text>>."""
    quarter = lambda c: F.floor(F.length(c) / 4)
    o = windows.agg(F.sum(F.greatest(F.lit(1), quarter("text"))).alias("c")).select(F.lit("O").alias("label"), "c")
    s = windows.select(F.explode("spans").alias("s")).where(F.col("s.label").isin(*V.ENTITIES))
    pair = F.array(F.struct(F.concat(F.lit("B-"), "s.label").alias("label"), F.lit(1).cast("long").alias("c")), F.struct(F.concat(F.lit("I-"), "s.label").alias("label"), F.greatest(F.lit(0), quarter("s.text") - 1).alias("c")))
    counts = o.unionByName(s.select(F.explode(pair).alias("x")).select("x.*")).groupBy("label").agg(F.sum("c").alias("c"))
    names = windows.sparkSession.createDataFrame([(n,) for n in V.LABELS], "label string")
    every = Window.partitionBy(F.lit(0))  # 13 rows
    w = names.join(counts, "label", "left").withColumn("total", F.greatest(F.sum("c").over(every), F.lit(1)))
    w = w.withColumn("w", F.when(F.col("c") > 0, F.sqrt(F.col("total") / F.col("c"))).otherwise(1.0))
    return w.select("label", F.round(F.col("w") / F.avg("w").over(every), 6).alias("weight"))


def gold_hits(gold: DataFrame, pred: DataFrame, key: tuple[str, ...]) -> DataFrame:
    """Each gold row with the label of the first predicted span over it (entity need not agree), null if there is none."""
    g = gold.select(*key, "start", "end", "entity", "detector", "label", "stratum")
    p = pred.select(*key, F.col("start").alias("ps"), F.col("end").alias("pe"), F.col("label").alias("predicted"))
    on = [g[k] == p[k] for k in key] + [F.col("pe") > F.col("start"), F.col("ps") < F.col("end")]
    first = Window.partitionBy(*[g[k] for k in key], "start", "end", "entity", "detector").orderBy(F.col("ps").asc_nulls_last(), "pe")
    return g.join(p, on, "left").withColumn("n", F.row_number().over(first)).where("n = 1").select(*[g[k] for k in key], "start", "end", "entity", "detector", "label", "stratum", "predicted")


def rescored(gold: DataFrame, files: DataFrame, pred: DataFrame, key: tuple[str, ...], survivors_only: bool = False) -> DataFrame:
    """Each gold row that can be scored with the label of the first predicted span over it, as ``gold_hits``, and a column kind.

    kind: skipped (an unsure verdict, no such file, or a span beyond its text's end), positive (sensitive, if only in part), negative.
    With ``survivors_only`` rows that the gates drop are left out.
    """
    sizes = files.select(*[F.col(k).alias(f"_{k}") for k in key], F.length("text").alias("n_chars"))
    g = gold.where(F.col("stratum").endswith("|kept")) if survivors_only else gold
    g = g.join(sizes, [g[k] == F.col(f"_{k}") for k in key], "left").drop(*[f"_{k}" for k in key])
    skip = (F.col("label") == "UNSURE") | F.col("n_chars").isNull() | (F.col("end") > F.col("n_chars"))
    kind = F.when(skip, "skipped").when(F.col("label").isin("TRUE", "WRONG_SPAN"), "positive").otherwise("negative")
    g = g.withColumn("kind", kind)
    hits = gold_hits(g.where("kind <> 'skipped'"), pred, key)
    skipped = g.where("kind = 'skipped'").select(*[c for c in hits.columns if c != "predicted"], F.lit(None).cast("string").alias("predicted"), "kind")
    return hits.withColumn("kind", F.when(F.col("label").isin("TRUE", "WRONG_SPAN"), "positive").otherwise("negative")).unionByName(skipped)


def rescore_summary(rows: DataFrame) -> DataFrame:
    """For each kind: rows, and how many a predicted span covers."""
    return rows.groupBy("kind").agg(F.count("*").alias("n"), F.count_if(F.col("predicted").isNotNull()).alias("flagged"))


def negatives_by_detector(hits: DataFrame) -> DataFrame:
    """Of surviving candidates that are no sensitive data, how many a model still flags. Unsure verdicts are left out."""
    no = hits.where(F.col("stratum").endswith("|kept") & F.col("label").isin("FALSE", "WRONG_ENTITY"))
    out = no.groupBy("detector").agg(F.count_if(F.col("predicted").isNotNull()).alias("flagged"), F.count("*").alias("total"))
    return out.withColumn("suppressed", F.round((F.col("total") - F.col("flagged")) / F.greatest("total", F.lit(1)), 6)).orderBy(F.col("flagged").desc(), "detector")
