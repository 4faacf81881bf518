"""Commands: python -m sieveline scan|sample|label|evaluate|generate|train|score-gold. Values are shown masked only."""

from __future__ import annotations

import argparse
import json
import sys
from functools import reduce
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import detect as D
from .operators import evaluate, gold, inject, labelling, metrics
from .operators import windows as W
from .sources import files as S


def corpus(spark: SparkSession, root: str, set_name: str) -> DataFrame:
    """All files of the repositories that a set's lockfile names."""
    lock = S.read_lock(spark, f"{root}/{set_name}.lock.json")
    names = [r.name for r in S.locked_repos(lock).select("name").collect()]  # a lockfile has a few entries
    if not names:
        raise SystemExit("the lockfile names no repository")
    return reduce(DataFrame.unionByName, (S.read_tree(spark, f"{root}/{set_name}/{n}", n) for n in names))


def scan(spark: SparkSession, a: argparse.Namespace) -> int:
    if not Path(a.path).is_dir():
        print(f"{a.path} is not a directory", file=sys.stderr)
        return 2
    path = str(Path(a.path).resolve())
    files = S.read_tree(spark, f"file://{path}", S.name_of(path))
    if a.model:
        from pyspark.ml import PipelineModel

        from .operators import model

        found = model.scan(PipelineModel.load(a.model), files, a.min_confidence)
    else:
        found = D.scan(files, suppress=not a.raw, min_confidence=a.min_confidence)
    found = found.persist()
    rows = [r.asDict() for r in D.report(found).toLocalIterator()]
    if a.json:
        print(json.dumps(rows, indent=2, ensure_ascii=False))
        return 0
    for r in rows:
        print(f"{r['entity']:<9} {r['masked']:<44} {r['path']}:{r['line']}:{r['column']:<6} {r['detector']:<20} {r['confidence']:.2f}")
    counts = D.summary(found).collect()
    print(f"{len(rows)} findings in {files.count()} files: " + "  ".join(f"{r.entity} {r.n}" for r in counts))
    if any(r.rotate for r in counts):
        print("High-confidence credentials found. Replace any that is real, and do not paste it anywhere.")
    return 0


def sample(spark: SparkSession, a: argparse.Namespace) -> int:
    c = gold.collect(corpus(spark, a.root, a.set), with_context=True).persist()
    quotas = gold.allocate(gold.populations(c), a.budget)
    S.write_jsonl(gold.sample(c, quotas, a.seed), a.out)
    quotas.orderBy("stratum").show(100, False)
    return 0


def label(spark: SparkSession, a: argparse.Namespace) -> int:
    """Adds verdicts from a file or, without one, asks a person for those that are missing."""
    known = S.read_jsonl(spark, a.gold, gold.GOLD).collect() if Path(a.gold).exists() else []  # as many rows as people have labelled
    known = spark.createDataFrame(known, gold.GOLD)

    def save(verdicts: DataFrame) -> None:
        S.write_jsonl(gold.append_verdicts(known, verdicts), a.gold)

    if a.verdicts:
        save(S.read_jsonl(spark, a.verdicts, gold.GOLD))
    else:
        todo = S.read_jsonl(spark, a.candidates, gold.CANDIDATE).withColumn("shuffle", gold.order_key(7, *gold.KEY))
        if a.prelabels:
            todo = gold.with_prelabels(todo, S.read_jsonl(spark, a.prelabels, gold.PRELABEL).withColumn("seq", F.monotonically_increasing_id()))
        todo = gold.unlabelled(todo, known, a.limit)
        # What JSON leaves out is null.
        as_rows = lambda done: [tuple(d.get(n) for n in gold.GOLD.names) for d in done]
        labelling.session((r.asDict() for r in todo.orderBy("shuffle").toLocalIterator()), lambda done: save(spark.createDataFrame(as_rows(done), gold.GOLD)))
    gold.label_summary(S.read_jsonl(spark, a.gold, gold.GOLD)).show(1, False, True)
    return 0


def evaluate_(spark: SparkSession, a: argparse.Namespace) -> int:
    rows = S.read_jsonl(spark, a.gold, gold.GOLD)
    populations = gold.populations(gold.collect(corpus(spark, a.root, a.set))).persist()
    strata = evaluate.stratum_precision(rows).persist()
    strata.where(F.col("stratum").endswith("|kept")).orderBy("stratum").show(100, False)
    evaluate.entity_precision(strata, populations).orderBy("entity").show(100, False)
    evaluate.overall(strata).show()
    return 0


def generate(spark: SparkSession, a: argparse.Namespace) -> int:
    inject.refuse_eval(a.set)
    data = inject.build(corpus(spark, a.root, a.set), a.target, a.seed).persist()
    inject.write_dataset(data, a.out)
    inject.label_counts(data).show(100, False)
    some = data.limit(a.verify).withColumn("id", F.monotonically_increasing_id())
    failed = W.round_trip_failures(some, ("id",)).count()
    print(f"{failed} spans do not survive labelling and decoding")
    return int(failed > 0)


def _windows(spark: SparkSession, path: str) -> DataFrame:
    data = spark.read.schema(f"{inject.EXAMPLE}, split string").json(f"{path}/windows")
    return data.withColumn("window", F.xxhash64("repo", "path", "text")).dropDuplicates(["repo", "path", "window"])


def train(spark: SparkSession, a: argparse.Namespace) -> int:
    from .operators import model as M

    config = M.Config(epochs=a.epochs)
    data = _windows(spark, a.data).persist()
    part = {s: data.where(F.col("split") == s) for s in ("train", "val")}
    spans = {s: d.select(*M.KEY, F.explode("spans").alias("s")).select(*M.KEY, "s.start", "s.end", "s.label") for s, d in part.items()}
    rows = M.weighted(W.align(W.tokens(part["train"], M.KEY), spans["train"], M.KEY, config.max_tokens), metrics.class_weights(part["train"]))
    fitted = M.train(M.featured(rows, part["train"]), config)
    toks = M.predict(fitted, M.featured(W.tokens(part["val"], M.KEY), part["val"]))
    exact = metrics.scores(metrics.exact_matches(W.decode(toks, M.KEY, part["val"]), spans["val"], M.KEY)).persist()
    exact.show()
    fitted.write().overwrite().save(a.out)
    macro = metrics.macro_f1(exact).first().macro_f1
    Path(a.history).write_text(json.dumps(M.history(config, [{"macro_f1": macro, "exact": [r.asDict() for r in exact.collect()]}]), indent=2))
    print(f"macro F1 {macro}")
    return 0


def score_gold(spark: SparkSession, a: argparse.Namespace) -> int:
    from pyspark.ml import PipelineModel

    from .operators import model as M

    rows = S.read_jsonl(spark, a.gold, gold.GOLD)
    files = corpus(spark, a.root, a.set).join(rows.select("repo", "path").distinct(), ["repo", "path"], "left_semi")
    found = M.scan(PipelineModel.load(a.model), files).select("repo", "path", "start", "end", F.col("entity").alias("label"))
    scored = metrics.rescored(rows, files, found, ("repo", "path"), a.survivors_only).persist()
    metrics.rescore_summary(scored).orderBy("kind").show()
    metrics.negatives_by_detector(scored.where("kind <> 'skipped'")).show(100, False)
    places = F.concat_ws("/", "repo", "path").alias("path")
    scored.where("kind = 'positive'").select(F.when(F.col("predicted").isNull(), "MISSED").otherwise("FOUND").alias("recall"), "entity", "predicted", places).orderBy("path", "entity").show(1000, False)
    return 0


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="sieveline")
    sub = p.add_subparsers(dest="command", required=True)

    def command(name: str, run, *options: tuple) -> None:
        c = sub.add_parser(name)
        for o, kw in options:
            c.add_argument(o, **kw)
        c.set_defaults(run=run)

    root, set_ = ("--root", {"default": "data/corpus"}), ("--set", {"default": "eval"})
    gold_ = ("--gold", {"default": "data/gold"})
    command("scan", scan, ("path", {}), ("--json", {"action": "store_true"}), ("--raw", {"action": "store_true"}), ("--min-confidence", {"type": float, "default": 0.0}), ("--model", {}))
    command("sample", sample, root, set_, ("--budget", {"type": int, "default": 150}), ("--seed", {"type": int, "default": 7}), ("--out", {"default": "data/candidates"}))
    command("label", label, gold_, ("verdicts", {"nargs": "?"}), ("--candidates", {"default": "data/candidates"}), ("--prelabels", {}), ("--limit", {"type": int}))
    command("evaluate", evaluate_, root, set_, gold_)
    command("generate", generate, root, ("--set", {"default": "train"}), ("--target", {"type": int, "default": 30_000}), ("--seed", {"type": int, "default": 20260925}), ("--verify", {"type": int, "default": 500}), ("--out", {"default": "data/synth"}))
    command("train", train, ("--data", {"default": "data/synth"}), ("--epochs", {"type": int, "default": 30}), ("--out", {"default": "data/model"}), ("--history", {"default": "data/history.json"}))
    command("score-gold", score_gold, root, set_, gold_, ("--model", {"default": "data/model"}), ("--survivors-only", {"action": "store_true"}))
    return p


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(args)
    spark = spark or SparkSession.builder.appName("sieveline").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    return a.run(spark, a)


if __name__ == "__main__":
    sys.exit(main())
