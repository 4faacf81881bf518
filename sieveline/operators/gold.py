"""Gold-set sampling: candidates, strata, equal allocation, sampling, resuming, label statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import vocab as V
from . import detect as D

KEY = ["repo", "path", "start", "end", "entity", "detector"]
_TEXT = ("detector", "entity", "stratum", "label", "line_sha256", "corrected_entity", "labeler", "notes")
GOLD = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("repo", "path")]
    + [T.StructField(n, T.IntegerType()) for n in ("line", "col", "start", "end", "span_len", "corrected_start", "corrected_end", "latency_ms")]
    + [T.StructField(n, T.StringType()) for n in _TEXT]
    + [T.StructField(n, T.BooleanType()) for n in ("survives_suppression", "is_foil")]
)
#: What a person needs to see of a candidate, beside what gold keeps.
CANDIDATE = T.StructType([*GOLD.fields, *(T.StructField(n, T.StringType()) for n in ("context", "value"))])
PRELABEL = T.StructType([*(f for f in GOLD.fields if f.name in (*KEY, "label", "is_foil")), T.StructField("reason", T.StringType())])


def stratum_of(detector: Column, survives: Column) -> Column:
    base = F.when(detector.isin(*V.PROVIDER_DETECTORS), "provider-key").otherwise(detector)
    return F.concat(base, F.when(survives, "|kept").otherwise("|dropped"))


def context(text: Column, line: Column, width: int = 2) -> Column:
    """The lines around one, each behind its number."""
    lines = F.split(text, "\n")
    first = F.greatest(line - width, F.lit(1))
    n = F.least(line + width, F.size(lines)) - first + 1
    numbered = F.transform(F.slice(lines, first, n), lambda x, i: F.concat(F.lpad((first + i).cast("string"), 6, " "), F.lit(" | "), x))
    return F.array_join(numbered, "\n")


def collect(files: DataFrame, with_context: bool = False) -> DataFrame:
    """All raw candidates with their survival, stratum and the digest of their line. Values and context only if asked for."""
    c = D.survivors(D.candidates(files)).withColumn("confidence", F.col("base"))
    c = c.withColumn("stratum", stratum_of(F.col("detector"), F.col("survives"))).withColumn("span_len", F.col("end") - F.col("start"))
    texts = files.select(F.col("repo").alias("r"), F.col("path").alias("p"), "text")
    c = c.join(texts, (F.col("repo") == F.col("r")) & (F.col("path") == F.col("p"))).drop("r", "p")
    line = F.element_at(F.split("text", "\n"), F.col("line"))
    c = c.withColumn("line_sha256", F.sha2(line, 256))
    return (c.withColumn("context", context(F.col("text"), F.col("line"))) if with_context else c.drop("value")).drop("text", "base", "suppressed_by", "passes", "rank")


def populations(candidates: DataFrame) -> DataFrame:
    return candidates.groupBy("stratum").agg(F.count("*").alias("population"))


def allocate(populations: DataFrame, budget: int) -> DataFrame:
    """Equal quotas with what small strata leave over going to the others; remainders by name.

    With strata in order of size, all of population up to a level are taken
    whole and the others share the rest: the level is found by running sums,
    without a loop over strata.
    """
    up = Window.partitionBy(F.lit(0)).orderBy("population", "stratum")  # one row for each stratum: a few dozen
    s = populations.withColumn("before", F.sum("population").over(up.rowsBetween(Window.unboundedPreceding, -1)))
    s = s.withColumn("left", F.lit(budget) - F.coalesce("before", F.lit(0))).withColumn("n", F.count("*").over(Window.partitionBy(F.lit(0))) - F.row_number().over(up) + 1)
    s = s.withColumn("whole", F.col("population") * F.col("n") <= F.col("left"))
    # Once a stratum is not taken whole, no larger one is.
    s = s.withColumn("whole", F.min(F.col("whole").cast("int")).over(up.rowsBetween(Window.unboundedPreceding, 0)) == 1)
    rest = Window.partitionBy("whole")
    by_name = Window.partitionBy("whole").orderBy("stratum")
    s = s.withColumn("share", F.max("left").over(rest)).withColumn("k", F.count("*").over(rest)).withColumn("nth", F.row_number().over(by_name))
    quota = F.when(F.col("whole"), F.col("population")).otherwise(F.floor(F.col("share") / F.col("k")) + (F.col("nth") <= F.pmod("share", "k")).cast("long"))
    return s.select("stratum", "population", quota.cast("long").alias("quota")).where("quota > 0")


def order_key(seed: int, *cols: str) -> Column:
    """A shuffle that does not depend on partitioning."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in cols]))


def sample(candidates: DataFrame, quotas: DataFrame, seed: int = 7) -> DataFrame:
    """Without replacement, ``quota`` rows of each stratum, in shuffled order."""
    w = Window.partitionBy("stratum").orderBy("shuffle")
    c = candidates.withColumn("shuffle", order_key(seed, *KEY)).withColumn("nth", F.row_number().over(w))
    return c.join(F.broadcast(quotas.select("stratum", "quota")), "stratum").where("nth <= quota").drop("nth", "quota")  # strata: a few dozen rows


def unlabelled(candidates: DataFrame, gold: DataFrame, limit: int | None = None) -> DataFrame:
    """Candidates still to label, in shuffled order."""
    todo = candidates.join(gold.select(*KEY), KEY, "left_anti")
    return todo.orderBy("shuffle").limit(limit) if limit else todo


def with_prelabels(candidates: DataFrame, prelabels: DataFrame) -> DataFrame:
    """Adds label and reason of the last prelabel (column seq) of each candidate."""
    foil = F.col("is_foil") if "is_foil" in prelabels.columns else F.lit(False)
    last = prelabels.groupBy(*KEY).agg(F.max_by(F.struct("label", "reason", F.coalesce(foil, F.lit(False)).alias("is_foil")), "seq").alias("pre"))
    out = candidates.drop("is_foil").join(last, KEY, "left")
    return out.withColumn("prelabel", F.col("pre.label")).withColumn("prelabel_reason", F.col("pre.reason")).withColumn("is_foil", F.coalesce("pre.is_foil", F.lit(False))).drop("pre")


def append_verdicts(gold: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Gold with new verdicts; a later verdict of the same candidate replaces the earlier one."""
    kept = gold.join(verdicts.select(*KEY), KEY, "left_anti").select(*gold.columns)
    return kept.unionByName(verdicts, allowMissingColumns=True)


def corrected_span(text: Column, line: Column, fragment: Column) -> tuple[Column, Column]:
    """Offsets of a fragment within a line of the text (not within its numbered context), null if it is not there."""
    lines = F.split(text, "\n")
    base = F.length(F.array_join(F.slice(lines, 1, line - 1), "\n")) + (line > 1).cast("int")
    at = F.instr(F.element_at(lines, line), fragment)
    start = F.when(at > 0, base + at - 1)
    return start, start + F.length(fragment)


def label_summary(gold: DataFrame) -> DataFrame:
    """One row: labels, median latency (upper of two), verdicts below a second, foils and whether they were caught often enough."""
    caught = F.count_if(F.col("is_foil") & ~F.col("label").isin("TRUE", "WRONG_SPAN"))
    foils = F.count_if(F.col("is_foil"))
    # Counts of the different latencies are kept, not the latencies; descending, the lower middle is the upper one.
    median = F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY latency_ms DESC)")
    return gold.agg(
        F.count("*").alias("n"), *[F.count_if(F.col("label") == x).alias(f"n_{x.lower()}") for x in ("TRUE", "WRONG_SPAN", "WRONG_ENTITY", "FALSE", "UNSURE")],
        median.cast("long").alias("median_ms"), F.count_if(F.col("latency_ms") < 1000).alias("fast"), foils.alias("foils"),
        F.round(F.when(foils > 0, caught / foils), 6).alias("catch_rate"), F.when(foils > 0, caught >= 0.8 * foils).alias("reliable"),
    )
