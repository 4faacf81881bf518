"""The fitted model applied with numpy against the same model applied by Spark."""

from pyspark.sql import functions as F

from sieveline.operators import model as M
from sieveline.operators import windows as W

TEXTS = ["", "a", "mail kim@web.de, \"bo\" 9.9.9.9 \"X1y\"", "é😀b_1  c d", "kim " * 30 + "'bo'", "-- -- bo"]


def test_spans_are_those_of_the_model_in_spark(spark):
    win = spark.createDataFrame([("r", f"p{i}", 0, 10 * i, t) for i, t in enumerate(TEXTS)], "repo string, path string, window int, base int, text string").persist()
    toks = M.featured(W.tokens(win, M.KEY), win)
    h = F.abs(F.hash("path", F.floor(F.col("idx") / 2))) % 10
    rows = toks.withColumn("label_id", F.when(h < 2, F.lit(1)).when(h < 4, F.lit(2)).when(h < 6, F.lit(7)).otherwise(0)).withColumn("loss_weight", F.lit(1.0))
    model = M.train(rows, M.Config(features=256, epochs=20))
    key = lambda df: sorted((r.repo, r.path, r.start, r.end, r.label, round(r.p, 9)) for r in df.collect())
    want, fast = key(M.any_spans(model, win)), M.linear_spans(M.Linear.of(model), win)
    assert key(fast) == want and len(want) > 5 and len({r[4] for r in want}) > 1
    assert "Window" not in fast._jdf.queryExecution().optimizedPlan().toString() and M.Linear.of(object()) is None
