"""Span-level precision by stratum and, reweighted to the population, by entity."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.predicates import wilson

REPORTABLE = 10


def _right():
    return F.col("label").isin("TRUE", "WRONG_SPAN")


def stratum_precision(gold: DataFrame) -> DataFrame:
    """stratum, entity, n (sure verdicts), k (right entity), unsure, wrong_span, precision and its interval.

    A stratum's entity is that of its first row by the candidate's key.
    """
    s = gold.groupBy("stratum").agg(
        F.min_by("entity", F.struct("repo", "path", "start", "end", "entity")).alias("entity"), F.count_if(F.col("label") != "UNSURE").alias("n"), F.count_if(_right()).alias("k"),
        F.count_if(F.col("label") == "UNSURE").alias("unsure"), F.count_if(F.col("label") == "WRONG_SPAN").alias("wrong_span"),
    )
    lo, hi = wilson("k", "n")
    return s.withColumn("precision", F.when(F.col("n") > 0, F.round(F.col("k") / F.col("n"), 6))).withColumn("low", F.round(lo, 6)).withColumn("high", F.round(hi, 6))


def entity_precision(strata: DataFrame, populations: DataFrame) -> DataFrame:
    """Precision of survivors, each stratum weighted by its population; below ten verdicts only the interval."""
    s = strata.where(F.col("stratum").endswith("|kept") & (F.col("n") > 0)).join(populations, "stratum", "left")
    weight = F.coalesce("population", F.lit(0))
    e = s.groupBy("entity").agg(F.sum(weight * F.col("k") / F.col("n")).alias("num"), F.sum(weight).alias("population"), F.sum("k").alias("k"), F.sum("n").alias("n"))
    lo, hi = wilson("k", "n")
    shown = F.when((F.col("n") >= REPORTABLE) & (F.col("population") > 0), F.round(F.col("num") / F.col("population"), 6))
    return e.select("entity", "population", "k", "n", shown.alias("precision"), F.round(lo, 6).alias("low"), F.round(hi, 6).alias("high"))


def overall(strata: DataFrame) -> DataFrame:
    """k / n over all survivors; null without any."""
    kept = strata.where(F.col("stratum").endswith("|kept"))
    return kept.agg(F.sum("k").alias("k"), F.sum("n").alias("n"), F.round(F.when(F.sum("n") > 0, F.sum("k") / F.sum("n")), 6).alias("precision"))
