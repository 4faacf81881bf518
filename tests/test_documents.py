"""BIO labels of documents against plain loops."""

import re

from sieveline.operators import detect as D
from sieveline.operators import windows as W
from sieveline.plans import queries as Q

DATA = "/root/testdata/sf0.001"


def test_bio_labels_of_documents(spark):
    texts = {(r.repo, f"{r.path}#{n}"): r.text[a:b] for r in Q.both(spark, DATA).collect() for n, (a, b) in enumerate(W.cut(r.text or ""))}
    files = spark.createDataFrame([(*k, t) for k, t in texts.items()], "repo string, path string, text string")
    spans = {(r.repo, r.path, r.start, r.end, r.entity) for r in D.candidates(files).where("passes").collect()}
    by_file = {}
    for *k, a, b, label in spans:
        by_file.setdefault(tuple(k), []).append((a, b, label))
    want = []
    for k, t in texts.items():
        toks = [m.span() for m in re.finditer(r"[A-Za-z0-9_]+|[^A-Za-z0-9_\s]", t, re.A)]
        out = [(0, 1.0)] * len(toks)
        for a, b, label in sorted(by_file.get(k, [])):
            hit = [i for i, (x, y) in enumerate(toks) if y > a and x < b]
            for n, i in enumerate(hit):
                out[i] = (W.LABEL_ID[("I-" if n else "B-") + label], round(1 / len(hit), 6))
        want += [(*k, i, *toks[i], *o) for i, o in enumerate(out)]
    got = sorted(tuple(r) for r in Q.bio_align_docs(spark, DATA).select("repo", "path", "idx", "tok_start", "tok_end", "label_id", "weight").collect())
    assert got == sorted(want) and len({r[1] for r in got if r[5]} - {r[1] for r in got if "doc_" not in r[1]}) > 0
