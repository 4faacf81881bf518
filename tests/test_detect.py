"""Detection against a plain scan with Python's own matcher, gates, masks and survival."""

import re

import pytest
from pyspark.sql import functions as F

from sieveline.functions import predicates as P
from sieveline.functions import vocab as V
from sieveline.operators import detect as D
from sieveline.plans import fixtures as X


def plain(text):
    """(detector, entity, start, end, value) of each raw match, without Spark."""
    out, dsn = [], []
    quoted = re.compile(r'"([^"\n\\]*(?:\\[^\n][^"\n\\]*)*)"|`([^`]*)`')
    for name, entity, pattern, kind, _, _ in V.DETECTORS:
        if kind == "quad":
            for m in re.finditer(r"(?<![\d.])(?:\d{1,3}\.){3}\d{1,3}(?![\d.])", text):
                if all(int(x) < 256 for x in m.group().split(".")):
                    out.append((name, entity, m.start(), m.end()))
            continue
        for m in re.finditer(pattern.replace("{q}", ""), text):
            if kind == "whole":
                a, b = m.span()
            elif kind == "quoted":
                q = quoted.search(text, m.start())
                a, b = q.span(1) if q.group(1) is not None else q.span(2)
            elif kind.startswith("dsn"):
                dsn.append(m.span())
                n = re.match(r"[^:]*://([^:]*):([^@]*)@", m.group()).span(2 if kind == "dsn-password" else 1)
                a, b = m.start() + n[0], m.start() + n[1]
            elif kind == "handle":
                a, b = m.start() + m.group().index("@") + 1, m.end()
            else:
                n = re.search(V._NAME + r"\Z", m.group())
                a, b = m.start() + n.start(), m.end()
            if name != "email" or not any(m.start() < e and m.end() > s for s, e in dsn):
                out.append((name, entity, a, b))
    return sorted((*x, text[x[2] : x[3]]) for x in out)


@pytest.fixture(scope="module")
def found(spark):
    return D.candidates(spark.createDataFrame(X.FILES, "repo string, path string, text string")).persist()


def test_places_and_values(found):
    got = {}
    for r in found.collect():
        got.setdefault(r.path, []).append((r.detector, r.entity, r.start, r.end, r.value))
    assert {d for x in got.values() for d, *_ in x} == {d[0] for d in V.DETECTORS}
    for _, path, text in X.FILES:
        assert sorted(got.get(path, [])) == plain(text), path
    for r in found.collect():
        text = next(t for _, p, t in X.FILES if p == r.path)
        assert (text.count("\n", 0, r.start) + 1, r.start - text.rfind("\n", 0, r.start)) == (r.line, r.col)


def test_documents_too(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select(F.col("source").alias("repo"), F.col("doc_id").cast("string").alias("path"), "text")
    got = {}
    for r in D.candidates(docs).collect():
        got.setdefault(r.path, []).append((r.detector, r.entity, r.start, r.end, r.value))
    for r in docs.collect():
        assert sorted(got.get(r.path, [])) == plain(r.text)


@pytest.mark.parametrize(
    ("path", "line", "why", "confidence"),
    [
        ("main.go", 2, None, 0.95), ("keys_test.go", 2, None, 0.70), ("keys_test.go", 3, "test-path", 0.95), ("keys_test.go", 4, "test-path", 0.75), ("pkg/auth.go", 1, None, 0.60),
        ("pkg/auth.go", 2, "implausible-key", 0.60), ("pkg/auth.go", 4, "non-secret-shape", 0.60), ("db/pw.go", 2, "placeholder", 0.75), ("db/pw.go", 3, "url", 0.75), ("db/pw.go", 4, None, 0.75),
        ("net/ip.go", 2, "reserved-range", 0.80), ("net/ip.go", 4, "version-line", 0.80), ("net/ip.go", 7, None, 0.80), ("mail.go", 2, "noreply", 0.90), ("sql/q.go", 1, "sql-variable", 0.45),
        ("sql/q.go", 2, None, 0.45), ("pkg/testdata/ip.go", 1, None, 0.55), ("tests/ip.go", 1, None, 0.80),
    ],
)
def test_gates(found, path, line, why, confidence):
    r = found.where((F.col("path") == path) & (F.col("line") == line)).orderBy("rank").first()
    assert (r.suppressed_by, r.confidence) == (why, confidence)


def test_connection_strings(found):
    rows = found.where("path = 'db/dsn.go' and detector = 'dsn-credentials'").collect()
    assert len(rows) == 6 and found.where("path = 'db/dsn.go' and entity = 'EMAIL'").count() == 0
    assert {(r.value, r.suppressed_by) for r in rows if r.line == 3} == {("changeme", "placeholder"), ("cache", "placeholder-password")}


def test_dedupe_and_survival(found):
    both = D.survivors(found).where("path = 'cmd/run.go' and line = 5").collect()
    assert {r.detector for r in both} == {"anthropic-key", "openai-key"} and all(r.survives for r in both)
    kept = D.deduped(found).where("path = 'cmd/run.go' and line = 5").collect()
    assert [r.detector for r in kept] == ["anthropic-key"]


def test_masks_hide_values(found):
    for r in found.withColumn("m", P.mask("entity", "value")).collect():
        assert r.value not in r.m
    assert "value" not in D.masked(found).columns and "value" not in D.report(found).columns
    one = lambda e, v: found.sparkSession.range(1).select(P.mask(F.lit(e), F.lit(v))).first()[0]
    assert one("EMAIL", "nina@mail.host.net") == "n***@m***.net" and one("IP", "8.8.4.4") == "8.x.x.x" and one("NAME", "Ann Bea Cid Dee") == "A*** B*** C***"
    assert one("PASSWORD", "abc") == "…[3 chars]" and one("KEY", "zz" + "y" * 8) == "zz…[10 chars]" and one("USERNAME", "kim") == "k***"


def test_raw_scan_and_report(spark, found):
    files = spark.createDataFrame(X.FILES, "repo string, path string, text string")
    raw, kept = D.scan(files, suppress=False), D.scan(files)
    assert raw.count() > kept.count() and raw.where("path = 'keys_test.go' and detector = 'aws-access-key'").first().confidence == 0.95
    assert D.scan(files, min_confidence=0.9).agg(F.min("confidence")).first()[0] >= 0.9
    assert {r.entity: r.rotate for r in D.summary(kept).collect()}["KEY"] and D.report_json(kept).count() == kept.count()


def test_many_escapes_do_not_overflow(spark):
    text = 'apiKey := "' + "\\n" * 20_000 + '"'
    r = D.candidates(spark.createDataFrame([("r", "p", text), ("r", "q", None), ("r", "e", "")], "repo string, path string, text string")).collect()
    assert len(r) == 1 and r[0].end - r[0].start == 40_000


@pytest.mark.parametrize(
    ("text", "n"),
    [('password := getenv("PW")', 0), ("password := 'single'", 0), ('if password == "x1y2z3"', 0), ('var password string = "abc"', 0), ('passwordHash = "k2l3"', 1), ("password=`a\nb`", 1), ('m["password"] = "q"', 0)],
)
def test_assignments(spark, text, n):
    c = D.candidates(spark.createDataFrame([("r", "p", text)], "repo string, path string, text string"), ("password-assignment",))
    assert c.count() == n


def test_version_far_behind_an_address(spark):
    """The gate reads the whole line, and nothing of the next."""
    far = "x" * 2_000
    texts = [f"a 8.8.4.4 {far} version 3\nb", f"a 8.8.4.4 {far} v2\nb", f"a 8.8.4.4 {far}\nversion 3", f"a 8.8.4.4 {far} end"]
    files = spark.createDataFrame([("r", f"{i}.go", t) for i, t in enumerate(texts)], "repo string, path string, text string")
    got = {r.path: r.suppressed_by for r in D.candidates(files, ("ipv4",)).collect()}
    assert got == {"0.go": "version-line", "1.go": "version-line", "2.go": None, "3.go": None}


def test_many_matches_in_one_text(spark):
    """Places of very many matches, on one line and on many, in seconds."""
    import time

    for sep in (" ", "\n", " é\n"):
        text = sep.join(f"a{i}@mail.host.net" for i in range(50_000))
        began = time.perf_counter()
        got = D.candidates(spark.createDataFrame([("r", "p", text)], "repo string, path string, text string"), ("email",)).select("start", "end", "line", "col").toPandas()
        assert time.perf_counter() - began < 30
        want = [m.span() for m in re.finditer(r"a\d+@mail\.host\.net", text, re.A)]
        assert list(zip(got.start, got.end)) == want
        assert list(zip(got.line, got.col)) == [(1, a + 1) if sep == " " else (i + 1, 1) for i, (a, _) in enumerate(want)]


def test_keywords_before_and_behind_handles(spark):
    texts = ["declare @one as int", "x @set @two", "x @re-set @two", "set\n@one", "@one\tas  varchar @two", "EXEC   @one", "resets @one", "@a1 @b2 as table @c3", "into\n\n @one"]
    files = spark.createDataFrame([("r", f"{i}", t) for i, t in enumerate(texts)], "repo string, path string, text string")
    got = {}
    for r in D.candidates(files, ("at-handle",)).orderBy("path", "start").collect():
        got.setdefault(int(r.path), []).append((r.value, r.suppressed_by))
    left, right = re.compile(r"\b(?:declare|set|into|exec|output)\s+\Z", re.I), re.compile(V.SQL_VAR_RIGHT)
    for i, t in enumerate(texts):
        want = []
        for m in re.finditer(r"(?:^|\s)@([A-Za-z0-9][A-Za-z0-9_\-]{2,38})\b", t):
            line = t[: m.start(1) - 1].rsplit("\n", 1)[-1]
            want.append((m[1], "sql-variable" if left.search(line) or right.search(t[m.end() : m.end() + 40]) else None))
        assert got.get(i, []) == want, t
