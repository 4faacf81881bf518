"""Licences are told by reading a text once."""

from pyspark.sql import functions as F

from sieveline.functions import predicates as P
from sieveline.functions import vocab as V


def test_white_space_is_evened_once_for_all_phrases(spark):
    df = spark.createDataFrame([("x",)], "text string").select(P.license_of("text").alias("license")).where(F.col("license").isin("MIT", "X11"))
    assert df._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace") <= 2  # in the filter and in the result


def test_phrases_over_line_ends_and_in_capitals(spark):
    rows, want = [(0, None), (1, ""), (2, "a license of some\nsoftware, permission granted")], {0: None, 1: None, 2: None}
    for name, phrases in V.LICENSES:
        rows.append((len(rows), "  \n".join(p.upper().replace(" ", " \t\n ") for p in reversed(phrases))))
        want[rows[-1][0]] = name
        rows.append((len(rows), "".join(p.replace(" ", "") for p in phrases)))
        want[rows[-1][0]] = None
    got = {r.id: r.license for r in spark.createDataFrame(rows, "id long, text string").select("id", P.license_of("text").alias("license")).collect()}
    assert got == want
