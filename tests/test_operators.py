"""Gold sampling, evaluation, windows, labels, Go sites, injection, sources and streaming."""

import json
import math
import random

import pytest
from pyspark.sql import functions as F

from sieveline.functions import predicates as P
from sieveline.functions import vocab as V
from sieveline.operators import detect, evaluate, generate, gold, golang, inject, metrics
from sieveline.operators import windows as W
from sieveline.plans import fixtures as X
from sieveline.sources import files as S
from sieveline.streaming import detect as stream


def shares(pop, budget):
    """Water filling, one unit at a time over names in order."""
    quota = dict.fromkeys(pop, 0)
    while budget:
        free = [s for s in sorted(pop) if quota[s] < pop[s]]
        if not free:
            break
        each = budget // len(free)
        if each == 0:
            for s in free[:budget]:
                quota[s] += 1
            break
        for s in free:
            take = min(each, pop[s] - quota[s])
            quota[s] += take
            budget -= take
    return {s: q for s, q in quota.items() if q}


@pytest.mark.parametrize("seed", range(6))
def test_allocation(spark, seed):
    rng = random.Random(seed)
    pop = {f"s{i}": rng.choice([1, 3, 20, 5000]) for i in range(rng.randrange(1, 9))}
    budget = rng.choice([1, 7, 40, 100_000])
    got = {r.stratum: r.quota for r in gold.allocate(spark.createDataFrame(list(pop.items()), "stratum string, population long"), budget).collect()}
    assert sum(got.values()) == min(budget, sum(pop.values())) and all(q <= pop[s] for s, q in got.items())
    assert sorted(got.values()) == sorted(shares(pop, budget).values())


def test_small_strata_get_as_much_as_large_ones(spark):
    got = gold.allocate(spark.createDataFrame([("a", 5000), ("b", 20)], "stratum string, population long"), 40).collect()
    assert {r.stratum: r.quota for r in got} == {"a": 20, "b": 20}


def test_sampling_and_resuming(spark):
    files = spark.createDataFrame(X.FILES, "repo string, path string, text string")
    c = gold.collect(files).persist()
    assert "value" not in c.columns and "text" not in c.columns
    quotas = gold.allocate(gold.populations(c), 12)
    s = gold.sample(c, quotas).persist()
    assert s.count() == 12 and {r.stratum: r.n for r in s.groupBy("stratum").agg(F.count("*").alias("n")).collect()} == {r.stratum: r.quota for r in quotas.collect()}
    assert sorted(map(tuple, s.select(*gold.KEY).collect())) == sorted(map(tuple, gold.sample(c.repartition(7), quotas).select(*gold.KEY).collect()))
    done = s.orderBy("shuffle").limit(5).withColumn("label", F.lit("TRUE"))
    assert gold.unlabelled(s, done).count() == 7 and gold.unlabelled(s, done, 3).count() == 3
    changed = done.limit(2).withColumn("label", F.lit("FALSE"))
    both = gold.append_verdicts(done, changed)
    assert both.count() == 5 and both.where("label = 'FALSE'").count() == 2


def test_corrected_spans_are_offsets_in_the_text(spark):
    t = spark.createDataFrame([("ab\nx key = v1\n", 2, "v1"), ("ab", 1, "zz")], "text string, line int, part string")
    s, e = gold.corrected_span(F.col("text"), F.col("line"), F.col("part"))
    assert [tuple(r) for r in t.select(s, e).collect()] == [(11, 13), (None, None)]


@pytest.mark.parametrize(("k", "n"), [(0, 0), (0, 11), (3, 56), (10, 10), (1, 2)])
def test_wilson(spark, k, n):
    lo, hi = spark.range(1).select(*P.wilson(F.lit(k), F.lit(n))).first()
    if not n:
        assert (lo, hi) == (0.0, 1.0)
    else:
        p, z = k / n, 1.96
        mid, half = p + z * z / (2 * n), z * math.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
        assert lo == pytest.approx(max(0, (mid - half) / (1 + z * z / n))) and hi == pytest.approx(min(1, (mid + half) / (1 + z * z / n)))


def test_precision(spark):
    rows = [("r", "p", i, i + 1, "EMAIL", "email", "email|kept", x) for i, x in enumerate(["TRUE"] * 6 + ["WRONG_SPAN"] * 2 + ["FALSE"] * 4 + ["UNSURE"])]
    rows += [("r", "q", i, i + 1, "EMAIL", "x", "x|kept", "FALSE") for i in range(3)] + [("r", "z", 1, 2, "IP", "ipv4", "ipv4|dropped", "TRUE")]
    g = spark.createDataFrame(rows, "repo string, path string, start int, end int, entity string, detector string, stratum string, label string")
    s = evaluate.stratum_precision(g)
    one = s.where("stratum = 'email|kept'").first()
    assert (one.n, one.k, one.unsure, one.wrong_span) == (12, 8, 1, 2)
    pops = spark.createDataFrame([("email|kept", 30), ("x|kept", 10)], "stratum string, population long")
    e = evaluate.entity_precision(s, pops).collect()
    assert len(e) == 1 and e[0].precision == pytest.approx(30 * 8 / 12 / 40, abs=1e-6)
    assert evaluate.overall(s.where("n < 0")).first().precision is None


def test_scan_windows():
    rng = random.Random(1)
    for _ in range(40):
        text = "".join(rng.choice(["a" * rng.randrange(300), "\n"]) for _ in range(rng.randrange(60)))
        got = W.cut(text)
        assert got[0][0] == 0 and got[-1][1] == len(text)
        for (a, b), (c, _) in zip(got, got[1:]):
            assert c == max(a + 1, b - 250)
            lines = text[a + 1 : a + 1400]
            assert (text[b - 1] == "\n" and "\n" not in text[b : a + 1400]) if "\n" in lines else b == a + 1400


def test_training_windows(spark):
    text = "".join(f"line {i} " + "x" * 40 + "\n" for i in range(200))
    span = lambda a, n: {"start": a, "end": a + n, "label": "KEY", "text": text[a : a + n]}

    def windows(spans, distractors):
        return [r.asDict(True) for r in W.training_windows(spark.createDataFrame([("r", "p", text, spans, distractors)], inject.EXAMPLE)).collect()]

    far, close = [span(100, 5), span(6000, 9)], [span(3000, 5), span(3300, 9)]
    assert len(windows(far, [])) == 2 and len(windows(close, [])) == 1
    for w in windows(far, close):
        assert len(w["text"]) <= 1400 and (w["text"].endswith("\n")) and w["text"].startswith("line")
        assert all(w["text"][s["start"] : s["end"]] == s["text"] for s in w["spans"] + w["distractors"])
    assert windows([], []) == []
    edges = [span(0, 3), span(790, 10), span(801, 4), span(len(text) - 6, 5)]  # the second still fits with the first, the third does not
    got = windows(edges, [])
    assert [[(s["end"] - s["start"]) for s in w["spans"]] for w in got] == [[3, 10, 4], [10, 4], [5]] and [w["text"] in text for w in got] == [True] * 3
    assert windows([span(300, 1500)], []) == []  # longer than a window


def test_bio_round_trip(spark):
    text = 'x := "nina@gmx.net" // 8.8.4.4 and "q w"'
    t = spark.createDataFrame([(1, text)], "id long, text string")
    spans = [(1, 6, 18, "EMAIL"), (1, 23, 30, "IP"), (1, 36, 39, "PASSWORD"), (1, 0, 1, "OTHER"), (1, 500, 510, "KEY")]
    s = spark.createDataFrame(spans, "id long, start int, end int, label string")
    a = W.align(W.tokens(t, ("id",)), s, ("id",)).persist()
    assert sorted((r.start, r.end, r.label) for r in W.decode(a, ("id",), t).collect()) == sorted(x[1:] for x in spans[:3])
    assert W.misaligned(a, s, ("id",)).count() == 0
    email = a.where("tok_start >= 6 and tok_end <= 18").orderBy("idx").collect()
    assert email[0].label_id == W.LABEL_ID["B-EMAIL"] and {r.label_id for r in email[1:]} == {W.LABEL_ID["I-EMAIL"]} and sum(r.weight for r in email) == pytest.approx(1)
    assert W.misaligned(a.withColumn("label_id", F.lit(0)), s, ("id",)).count() == 3
    labels = spark.createDataFrame([(1, i, i, i + 1, W.LABEL_ID[x]) for i, x in enumerate(["I-IP", "I-IP", "B-IP", "O", "I-KEY", "I-IP"])], "id long, idx int, tok_start int, tok_end int, label_id int")
    assert sorted((r.start, r.end, r.label) for r in W.decode(labels, ("id",)).collect()) == [(0, 2, "IP"), (2, 3, "IP"), (4, 5, "KEY"), (5, 6, "IP")]


def test_label_ids():
    assert V.LABELS[0] == "O" and V.LABELS[1:5] == ("B-EMAIL", "I-EMAIL", "B-IP", "I-IP") and len(V.LABELS) == 13


def test_span_scores(spark):
    cols = "id long, start int, end int, label string"
    gold_ = spark.createDataFrame([(1, 0, 5, "KEY"), (1, 0, 5, "KEY"), (1, 10, 15, "IP"), (2, 0, 4, "NAME")], cols)
    pred = spark.createDataFrame([(1, 0, 5, "KEY"), (1, 11, 16, "IP"), (2, 0, 4, "EMAIL")], cols)
    exact = {r.label: (r.tp, r.fp, r.fn) for r in metrics.exact_matches(pred, gold_, ("id",)).collect()}
    over = {r.label: (r.tp, r.fp, r.fn) for r in metrics.overlap_matches(pred, gold_, ("id",)).collect()}
    assert exact == {"KEY": (1, 0, 1), "IP": (0, 1, 1), "NAME": (0, 0, 1), "EMAIL": (0, 1, 0)} and over["IP"] == (1, 0, 0) and over["KEY"] == (1, 0, 1)
    s = metrics.scores(metrics.exact_matches(pred, gold_, ("id",)))
    assert s.count() == 6 and metrics.macro_f1(s).first()[0] == pytest.approx(2 / 3 / 6, abs=1e-6)


GO = '''package main
import "fmt"
// top: é😀
type T struct {
\tName string `json:"name"`
\tN []int `x:"y"`
}
const greeting = "hi there"
func (t *T) Run(a string) error {
\tuser := "kim" // trailing
\tq := `SELECT
1`
\tfmt.Println("out", 'x', "")
\treturn T{Name: "bo"}
}
var m = map[string]string{"k": "v"}
/* block
"not" */
'''


def test_go_sites():
    got = [(GO[s["start"] : s["end"]], s["kind"], s["func"]) for s in golang.find_sites(GO)]
    assert [g[:2] for g in got] == [
        ("fmt", "string"), ("// top: é😀", "comment"), ('json:"name"', "struct_tag"), ('x:"y"', "struct_tag"), ("hi there", "string"), ("kim", "string"), ("// trailing", "comment"),
        ("SELECT\n1", "raw_string"), ("out", "string"), ("bo", "string"), ("k", "string"), ("v", "string"), ('/* block\n"not" */', "comment"),
    ]
    assert {g[0]: g[2] for g in got}["kim"] == "Run" and {g[0]: g[2] for g in got}["v"] is None
    names = {GO[s["start"] : s["end"]]: s["ident"] for s in golang.find_sites(GO)}
    assert names["kim"] == "user" and names["hi there"] == "greeting" and names["bo"] == "Name" and names["out"] == "Println"
    for bad in ('"open', "`open", "/* open", "func {{{ )))", "'", '"a\\', ""):
        golang.find_sites(bad)


def test_generated_values():
    values = [generate.generate(generate.Draws("s", i), "train") for i in range(4000)]
    assert 0.36 < sum(v.entity is None for v in values) / len(values) < 0.44
    assert {v.why for v in values if v.entity is None} == set(generate.NEGATIVES) and len(generate.NEGATIVES) == 21 and {v.entity for v in values if v.entity} == set(V.ENTITIES)
    assert [generate.generate(generate.Draws("s", i), "train") for i in range(50)] == values[:50]
    for v in values:
        if v.why == "email-in-attribution":
            assert v.labeled.count("@") == 1 and " " not in v.labeled and v.kinds == ("comment",)
    for field in generate.VOCAB["train"]:
        assert not set(generate.VOCAB["train"][field]) & set(generate.VOCAB["eval"][field])


def test_public_addresses_are_public(spark):
    ips = [(generate.public_ip(generate.Draws("ip", i)),) for i in range(300)]
    assert spark.createDataFrame(ips, "ip string").where(P.is_reserved_ip("ip")).count() == 0


def test_injection(spark):
    for seed in range(60):
        ex = inject.inject("r", "p.go", GO, seed, "train")
        marks = sorted(ex["spans"] + ex["distractors"], key=lambda s: s["start"])
        assert 0 < len(marks) <= 4 and all(ex["text"][s["start"] : s["end"]] == s["text"] for s in marks)
        assert all(a["end"] <= b["start"] for a, b in zip(marks, marks[1:])) and '`json:"name"`' in ex["text"]
        assert all(s["label"] in V.ENTITIES for s in ex["spans"]) and all(s["label"] in generate.NEGATIVES for s in ex["distractors"])
    assert inject.inject("r", "p.go", "package x", 1, "train") is None
    files = spark.createDataFrame([("r", f"f{i}.go", GO) for i in range(20)], "repo string, path string, text string")
    ex = inject.inject_files(files, "train")
    assert ex.count() == 20 and inject.broken_examples(ex).count() == 0
    shifted = ex.withColumn("spans", F.transform("spans", lambda s: s.withField("start", s["start"] + 1)))
    assert inject.broken_examples(shifted).count() > 0


def test_dataset_goes_on_until_the_quota_is_met(spark):
    files = spark.createDataFrame([("r", "f.go", GO), ("r", "g.go", GO), ("r", "none.go", "package x")] * 1 + [("r", f"none{i}.go", "") for i in range(9)], "repo string, path string, text string")
    n = {r.split: r.n for r in inject.build(files, target=100, val_fraction=0.5).groupBy("split").agg(F.count("*").alias("n")).collect()}
    assert n.get("train", 0) in (0, 100) and n.get("val", 0) in (0, 50) and n
    assert inject.build(files.where("text not like '%import%'"), target=100).count() == 0
    ex = inject.inject("r", "p.go", GO, 1, "train")
    assert inject.faults(ex) == []
    ex["spans"] = [{"start": 0, "end": 3, "label": "KEY", "text": "abc"}, {"start": 2, "end": 10**6, "label": "KEY", "text": ""}]
    assert set(inject.faults(ex)) == {"value", "overlap", "range"}


def test_dataset(spark, tmp_path):
    files = spark.createDataFrame([("r", f"f{i}.go", GO) for i in range(30)] + [("r", "none.go", "package x")], "repo string, path string, text string")
    split = inject.split_files(files)
    assert split.where("split = 'train'").count() == int(31 * 0.9) and split.count() == 31
    data = inject.build(files, target=40).persist()
    n = {r.split: r.n for r in data.groupBy("split").agg(F.count("*").alias("n")).collect()}
    assert n["train"] == 40 and n["val"] == 4
    inject.write_dataset(data, str(tmp_path / "d"))
    assert spark.read.json(str(tmp_path / "d/windows")).count() == 44
    assert inject.build(files.where("path = 'none.go'"), target=5).count() == 0
    with pytest.raises(ValueError):
        inject.refuse_eval("eval")


def test_tree(spark, tmp_path):
    def put(path, data):
        p = tmp_path / "repo" / path
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(data)

    put("a.go", b"\xef\xbb\xbfx := 1\r\ny\rz\n"), put("b/c.go", b"bad \xff\xfe end"), put("b-d.go", b"ok"), put("vendor/v.go", b"v"), put("x/node_modules/n.go", b"n")
    put("gen.go", b"// Code generated by tool. DO NOT EDIT.\nx"), put("big.go", b"x" * 2_000_001), put("edge.go", b"x" * 2_000_000), put("skip/me.go", b"s"), put("skip/keep.go", b"k"), put("t.txt", b"t")
    put(".gitignore", b"# c\n/skip/*\n!skip/keep.go\n*.tmp\n")
    root = f"file://{tmp_path}/repo"
    got = {r.path: r.text for r in S.read_tree(spark, root, "r").collect()}
    assert set(got) == {"a.go", "b/c.go", "b-d.go", "edge.go", "skip/keep.go"}
    assert got["a.go"] == "x := 1\ny\nz\n" and got["b/c.go"] == b"bad \xff\xfe end".decode(errors="replace")
    assert "gen.go" in {r.path for r in S.read_tree(spark, root, "r", skip_generated=False).collect()}
    assert [r.path for r in S.in_path_order(spark.createDataFrame([("b-d.go",), ("b/c.go",), ("a.go",)], "path string")).collect()] == ["a.go", "b/c.go", "b-d.go"]


@pytest.mark.parametrize(
    ("rules", "path", "out"),
    [("*.go", "x/y.go", True), ("/y.go", "x/y.go", False), ("build/", "a/build/f.go", True), ("build/", "build", False), ("a/**/z.go", "a/b/c/z.go", True), ("!x.go\nx.go", "x.go", True), ("x.go\n!x.go", "x.go", False), ("f?.go", "fa.go", True), ("[ab].go", "c.go", False), ("doc/*.go", "doc/a/b.go", False)],
)
def test_ignore_rules(spark, rules, path, out):
    assert spark.createDataFrame([(path,)], "p string").select(S.ignored(F.col("p"), S.ignore_rules(rules))).first()[0] == out


def test_json_lines_and_lockfiles(spark, tmp_path):
    df = spark.createDataFrame([("r", "p", 1, None), ("é", "q", None, "x")], "repo string, path string, line int, notes string")
    S.write_jsonl(df, str(tmp_path / "g"))
    lines = [x for f in (tmp_path / "g").glob("part*") for x in f.read_text().splitlines()]
    assert all(set(json.loads(x)) == {"repo", "path", "line", "notes"} for x in lines)
    (tmp_path / "g" / "part-blank.txt").write_text("\n\n")
    assert S.read_jsonl(spark, str(tmp_path / "g"), gold.GOLD).count() == 2
    lock = {"set": "eval", "fetched_at": "t", "scan_config": {"a": "b"}, "repos": [{"name": "x", "license": "MIT", "go_files": 3}, {"name": "y", "license": None, "go_files": 4}], "rejected": []}
    (tmp_path / "l.json").write_text(json.dumps(lock, indent=1))
    repos = S.locked_repos(S.read_lock(spark, str(tmp_path / "l.json")))
    yes, no = S.accepted(repos, spark.createDataFrame([("MIT",)], "license string"))
    assert [r.name for r in yes.collect()] == ["x"] and [r.name for r in no.collect()] == ["y"] and S.file_totals(repos).first().go_files == 7


def test_licences(spark):
    files = spark.createDataFrame([("r", "COPYING", X.LICENCES[0][1]), ("r", "LICENSE", X.LICENCES[1][1]), ("s", "README", "x")], "repo string, path string, text string")
    assert [(r.repo, r.license) for r in S.find_license(files).collect()] == [("r", "MIT")]
    got = spark.createDataFrame(X.LICENCES, "id string, text string").select("id", P.license_of("text").alias("l")).collect()
    assert {r.id: r.l for r in got} == {"r1": "Apache-2.0", "r2": "MIT", "r3": "BSD-3-Clause", "r4": "BSD-2-Clause", "r5": "MPL-2.0", "r6": None, "r7": "X11"}


def test_streamed_findings_equal_those_of_a_batch(spark, tmp_path):
    docs = spark.createDataFrame([(i, f'password := "vR7!kd9{i}mQ"\n8.8.4.{i}', "en", "s", 1) for i in range(6)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "in"))
    q = stream.write_findings(stream.findings(stream.stream_documents(spark, str(tmp_path / "in"))), str(tmp_path / "out"), str(tmp_path / "ck"))
    q.processAllAvailable()
    q.stop()
    want = detect.masked(detect.candidates(S.documents_as_files(docs)).where("passes"))
    got = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(map(str, got.select("path", "start", "masked").collect())) == sorted(map(str, want.select("path", "start", "masked").collect())) and got.count() > 6
