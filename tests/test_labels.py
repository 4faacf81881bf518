"""Tokens and labels made text by text against the joins and plain loops that say the same."""

import re

from pyspark.sql import functions as F

from sieveline.operators import metrics
from sieveline.operators import windows as W
from sieveline.plans import queries as Q

DATA = "/root/testdata/sf0.001"
TEXTS = ["", None, "a", "é😀b_1  c d\t\x0be", "x" * 30, "mail kim@web.de, \"bo\" 9.9.9.9", " \n ", "\x1ca\x85b", "end_", "_next", "😀"]
SPANS = [(5, 5, 15, "EMAIL"), (5, 5, 8, "NAME"), (5, 9, 12, "KEY"), (5, 18, 20, "other"), (5, 22, 22, "IP"), (5, 23, 23, "IP"), (5, 22, 29, "IP"), (3, 0, 99, "KEY"), (10, 0, 1, "NAME"), (4, 3, 4, "PASSWORD"), (6, 0, 2, "IP")]


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_tokens_of_many_texts():
    texts = [t or "" for t in TEXTS]
    want = [(i, n, *m.span()) for i, t in enumerate(texts) for n, m in enumerate(re.finditer(r"[A-Za-z0-9_]+|[^A-Za-z0-9_\s]", t, re.A))]
    assert [tuple(map(int, r)) for r in zip(*W.find_tokens(texts))] == want
    assert [len(c) for c in W.find_tokens(["", ""])] == [0, 0, 0, 0]


def test_labels_text_by_text_are_those_of_the_joins(spark, monkeypatch):
    monkeypatch.setattr(W, "SLICE", 20)
    t = spark.createDataFrame(list(enumerate(TEXTS)), "id long, text string")
    s = spark.createDataFrame(SPANS, "id long, start int, end int, label string")
    both = W.with_spans(t, s, ("id",))
    for longest in (4, 512):
        want = sorted(map(tuple, W.align(W.tokens(t, ("id",)), s, ("id",), longest).collect()))
        assert sorted(map(tuple, W.labelled(both, ("id",), longest).collect())) == want and len({r[4] for r in want}) > 3
        assert sorted(map(tuple, W.labelled(both, ("id",), longest, marked=True).collect())) == [r for r in want if r[4]]
    assert not re.search("Window|Generate", plan(W.labelled(both, ("id",))))


def test_tokens_outside_of_spans_are_dropped_before_decoding_moves_any(spark):
    tags = [("I-IP", 1), ("O", 1), ("I-IP", 1), ("O", 0), (None, 1), ("I-IP", 1), ("I-KEY", 1), ("B-KEY", 1), ("O", 1), ("O", 1), ("I-KEY", 1)]
    rows = [(1, i, 2 * i, 2 * i + n, -100 if x is None else W.LABEL_ID[x]) for i, (x, n) in enumerate(tags)]
    a = spark.createDataFrame(rows, "id long, idx int, tok_start int, tok_end int, label_id int")
    want = [(0, 1, "IP"), (4, 11, "IP"), (12, 13, "KEY"), (14, 15, "KEY"), (20, 21, "KEY")]
    assert sorted((r.start, r.end, r.label) for r in W.decode(a, ("id",)).collect()) == want
    assert "Filter" in plan(W.decode(a, ("id",))).rsplit("Window", 1)[1]


def test_verified_and_matched_windows_need_no_token_outside_of_them(spark):
    held, spans, labels = Q.bio_docs(spark, DATA)
    every = W.labelled(W.with_spans(*Q.windows_docs(spark, DATA), Q.KEYS), Q.KEYS, W.SIZE)
    assert sorted(map(str, W.decode(labels, Q.KEYS, held).collect())) == sorted(map(str, W.decode(every, Q.KEYS, Q.windows_docs(spark, DATA)[0]).collect()))
    assert Q.verified(spans, every).first() == Q.bio_verify_docs(spark, DATA).first()
    assert labels.count() < every.count() / 20


def test_overlaps_are_matched_without_a_data_frame_for_each_text(spark):
    rows = [(i, 0, 5, "KEY") for i in range(50)] + [(i, 3, 9, "KEY") for i in range(50)]
    gold = spark.createDataFrame(rows, "id long, start int, end int, label string")
    over = metrics.overlap_matches(gold.withColumn("end", F.col("end") + 1), gold.where("start = 3"), ("id",))
    assert [tuple(r) for r in over.collect()] == [("KEY", 50, 50, 0)] and "FlatMapGroupsInPandas" not in plan(over)
