"""The commands from end to end on a small corpus."""

import json

import pytest

from sieveline.__main__ import main
from sieveline.plans import fixtures as X
from sieveline.sources.files import read_jsonl

from .test_operators import GO


@pytest.fixture(scope="module")
def corpus(tmp_path_factory):
    root = tmp_path_factory.mktemp("corpus")
    for set_name in ("eval", "train"):
        repos = sorted({r for r, _, _ in X.FILES})
        (root / f"{set_name}.lock.json").write_text(json.dumps({"set": set_name, "repos": [{"name": r, "license": "MIT", "go_files": 1} for r in repos], "rejected": []}))
        for r, path, text in [*X.FILES, *[(r, f"more{i}.go", GO) for r in repos for i in range(8)]]:
            at = root / set_name / r / path
            at.parent.mkdir(parents=True, exist_ok=True)
            at.write_text(text)
    return root


def test_scan(spark, corpus, capsys):
    assert main(["scan", str(corpus / "nothing")], spark) == 2
    assert main(["scan", str(corpus / "eval" / "alpha"), "--json"], spark) == 0
    rows = json.loads(capsys.readouterr().out)
    assert rows and set(rows[0]) == {"entity", "masked", "path", "line", "column", "detector", "confidence"} and rows == sorted(rows, key=lambda r: (-r["confidence"], r["path"], r["line"]))
    assert not any(k in json.dumps(rows) for k in X.KEYS.values())
    main(["scan", str(corpus / "eval" / "alpha"), "--raw", "--min-confidence", "0.9"], spark)
    out = capsys.readouterr().out
    assert "keys_test.go:3" in out and "High-confidence" in out


def test_gold(spark, corpus, tmp_path, capsys):
    main(["sample", "--root", str(corpus), "--budget", "20", "--out", str(tmp_path / "cand")], spark)
    rows = [json.loads(x) for f in (tmp_path / "cand").glob("part*") for x in f.read_text().splitlines()]
    assert len(rows) == 20 and all(r["context"] for r in rows)
    verdicts = [{k: r[k] for k in ("repo", "path", "line", "col", "start", "end", "entity", "detector", "stratum", "span_len", "line_sha256")} | {"label": "TRUE" if i % 2 else "FALSE", "latency_ms": 500 * i, "is_foil": False} for i, r in enumerate(rows)]
    (tmp_path / "v.jsonl").write_text("\n".join(map(json.dumps, verdicts)))
    main(["label", str(tmp_path / "v.jsonl"), "--gold", str(tmp_path / "gold")], spark)
    main(["label", str(tmp_path / "v.jsonl"), "--gold", str(tmp_path / "gold")], spark)
    from sieveline.operators.gold import GOLD

    stored = read_jsonl(spark, str(tmp_path / "gold"), GOLD)
    assert stored.count() == 20 and "value" not in stored.columns
    capsys.readouterr()
    main(["evaluate", "--root", str(corpus), "--gold", str(tmp_path / "gold")], spark)
    assert "|kept" in capsys.readouterr().out


def test_generate_train_and_score(spark, corpus, tmp_path, capsys):
    with pytest.raises(ValueError):
        main(["generate", "--root", str(corpus), "--set", "eval"], spark)
    assert main(["generate", "--root", str(corpus), "--target", "60", "--out", str(tmp_path / "synth")], spark) == 0
    assert main(["train", "--data", str(tmp_path / "synth"), "--epochs", "5", "--out", str(tmp_path / "model"), "--history", str(tmp_path / "h.json")], spark) == 0
    assert json.loads((tmp_path / "h.json").read_text())["config"]["epochs"] == "5"
    capsys.readouterr()
    main(["scan", str(corpus / "eval" / "beta"), "--model", str(tmp_path / "model"), "--json"], spark)
    assert all(r["detector"] == "model" for r in json.loads(capsys.readouterr().out))


def test_labelling_session():
    from sieveline.operators import labelling as L

    text = "a\nkey := secret, secret // end\nb\nc"
    context = "\n".join(f"{i:6} | {x}" for i, x in enumerate(text.split("\n"), 1))
    row = {"repo": "r", "path": "p.go", "line": 2, "col": 16, "start": 17, "end": 23, "entity": "KEY", "detector": "d", "stratum": "d|kept", "survives_suppression": True, "line_sha256": "x", "span_len": 6, "context": context, "value": "secret"}
    assert text[17:23] == "secret" and L.corrected(row, "secret") == (17, 23) and L.corrected(row, "key") == (2, 5) and L.corrected(row, "gone") == (None, None) and L.corrected(row, "") == (None, None)
    typed = iter(["x", "t", "e", "9", "2", "s", "key", "u", "q", "t"])
    told, saved, ticks = [], [], iter(range(100))
    rows = iter([row | {"prelabel": "TRUE", "is_foil": True}, row, row, row, row, row])
    got = L.session(rows, lambda done: saved.append(len(done)), lambda _: next(typed), told.append, lambda: next(ticks))
    assert [r["label"] for r in got] == ["TRUE", "WRONG_ENTITY", "WRONG_SPAN", "UNSURE"] and saved == [4]
    assert got[0]["is_foil"] and got[0]["notes"] == "proposed TRUE" and got[1]["corrected_entity"] == sorted(L.V.ENTITIES)[1] and (got[2]["corrected_start"], got[2]["corrected_end"]) == (2, 5)
    assert all("value" not in r and "context" not in r and r["latency_ms"] == 1000 for r in got) and L.HELP in told
    # Saved after every few, and at the end of the input or of the rows.
    saved.clear()
    L.session(iter([row] * 25), lambda done: saved.append(len(done)), lambda _: "f", told.append)
    assert saved == [10, 20, 25]

    def closed(_):
        raise EOFError

    assert L.session(iter([row]), lambda done: saved.append(len(done)), closed, told.append) == [] and saved[-1] == 0


def test_label_by_hand(spark, corpus, tmp_path, capsys, monkeypatch):
    from sieveline.operators.gold import GOLD

    main(["sample", "--root", str(corpus), "--budget", "6", "--out", str(tmp_path / "cand")], spark)
    typed = iter(["t", "f", "q", "u", "u", "u", "u", "u", "u"])
    monkeypatch.setattr("builtins.input", lambda _: next(typed))
    main(["label", "--candidates", str(tmp_path / "cand"), "--gold", str(tmp_path / "gold")], spark)
    assert sorted(r.label for r in read_jsonl(spark, str(tmp_path / "gold"), GOLD).collect()) == ["FALSE", "TRUE"]
    main(["label", "--candidates", str(tmp_path / "cand"), "--gold", str(tmp_path / "gold"), "--limit", "3"], spark)
    stored = read_jsonl(spark, str(tmp_path / "gold"), GOLD).collect()
    assert sorted(r.label for r in stored) == ["FALSE", "TRUE", "UNSURE", "UNSURE", "UNSURE"] and len({(r.path, r.start, r.detector, r.entity) for r in stored}) == 5
