"""Sites in Go sources where a value can stand: string bodies, raw strings, struct tags and comments.

A small lexer by hand; names of the enclosing function and the nearest
identifier follow from the tokens before a site, so they approximate what a
full parser would say.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import predicates as P

# What holds sites or hides quotes from them. No other token holds a character that can begin one of these.
_HOLDS = r"""(?P<comment>//[^\n]*|/\*.*?(?:\*/|\Z))|(?P<string>"(?:[^"\n\\]|\\[^\n])*(?:"|(?=\n)|\Z))|(?P<raw>`[^`]*(?:`|\Z))|(?P<rune>'(?:[^'\n\\]|\\.)+')"""
_HOLDER = re.compile(_HOLDS, re.S)
_TOKEN = re.compile(_HOLDS + r"|(?P<name>[^\W\d]\w*)|(?P<number>\d[\w.]*)|(?P<op>:=|[^\s\w])", re.S)
SITE = "array<struct<start:int,end:int,kind:string,ident:string,func:string>>"


def find_sites(text: str) -> list[dict]:
    """Sites in order, offsets in code points; malformed text never raises."""
    out: list[dict] = []
    func, depth, func_depth, pending = None, 0, -1, None
    structs: list[int] = []
    ident: str | None = None
    calls: list[str | None] = []
    last: list[str] = []  # the tokens before, newest last
    line_end = 0
    for m in _TOKEN.finditer(text):
        kind, tok = m.lastgroup, m.group()
        if "\n" in text[line_end : m.start()] and not calls:
            ident = None
        line_end = m.end()
        if kind == "comment":
            out.append({"start": m.start(), "end": m.end(), "kind": "comment", "ident": None, "func": func})
            continue
        if kind in ("string", "raw"):
            closed = len(tok) > 1 and tok[-1] == tok[0]
            lo, hi = m.start() + 1, m.end() - closed
            tag = kind == "raw" and structs and structs[-1] == depth and last and (re.match(r"\w|\]|\}|\*", last[-1]) is not None)
            if hi > lo:
                name = ident or next((c for c in reversed(calls) if c), None)
                out.append({"start": lo, "end": hi, "kind": "struct_tag" if tag else "raw_string" if kind == "raw" else "string", "ident": name, "func": func})
            if kind == "string":
                last.append(tok.strip('"'))
                continue
        elif kind == "name":
            if len(last) > 1 and last[-1] == "func" and depth == 0:
                pending = tok
            elif last and last[-1] == "func" and depth == 0:
                pending = tok
            elif last and last[-1] == ")" and pending == "" and depth == 0:
                pending = tok
            if last and last[-1] in ("const", "var"):
                ident = tok
        elif kind == "op":
            if tok in (":=", "=", ":") and last and re.match(r"\w", last[-1] or "_"):
                ident = last[-1] if last[-1] not in ("case", "default") else ident
            elif tok == "(":
                if last and last[-1] == "func" and depth == 0:
                    pending = ""  # a method: its name comes behind the receiver
                calls.append(last[-1] if last and re.match(r"[^\W\d]\w*\Z", last[-1]) else None)
            elif tok == ")":
                if calls:
                    calls.pop()
            elif tok == "{":
                if pending and depth == 0:
                    func, func_depth, pending = pending, depth, None
                depth += 1
                if last and last[-1] == "struct":
                    structs.append(depth)
            elif tok == "}":
                if structs and structs[-1] == depth:
                    structs.pop()
                depth = max(0, depth - 1)
                if func is not None and depth == func_depth:
                    func, func_depth = None, -1
        last.append(tok)
        del last[:-4]
    return out


def find_places(text: str) -> list[tuple[int, int, str]]:
    """Start, end and kind of the sites, without their names: only a text with the word struct can have struct tags, so others are read for quotes and comments alone."""
    if "struct" in text:
        return [(s["start"], s["end"], s["kind"]) for s in find_sites(text)]
    out = []
    for m in _HOLDER.finditer(text):
        kind, lo, hi = m.lastgroup, *m.span()
        if kind == "comment":
            out.append((lo, hi, kind))
        elif kind != "rune":
            lo, hi = lo + 1, hi - (hi - lo > 1 and text[hi - 1] == text[lo])
            if hi > lo:
                out.append((lo, hi, "raw_string" if kind == "raw" else kind))
    return out


def sites(files: DataFrame) -> DataFrame:
    """repo, path, in_test and the sites of each file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string()), ("ident", pa.string()), ("func", pa.string())]))
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([find_sites(t or "") for t in b.column(2).to_pylist()], kind)], ["repo", "path", "sites"])

    out = files.select("repo", "path", "text").mapInArrow(run, f"repo string, path string, sites {SITE}")
    return out.withColumn("in_test", P.in_test_path("path"))


def exploded(found: DataFrame) -> DataFrame:
    return found.select("repo", "path", "in_test", F.explode("sites").alias("s")).select("repo", "path", "in_test", "s.*")


def broken_sites(files: DataFrame, found: DataFrame) -> DataFrame:
    """Sites out of range, or strings over a line's end: should be none."""
    s = exploded(found).join(files.select("repo", "path", "text"), ["repo", "path"])
    piece = F.substring("text", F.col("start") + 1, F.col("end") - F.col("start"))
    return s.where((F.col("start") < 0) | (F.col("end") <= F.col("start")) | (F.col("end") > F.length("text")) | ((F.col("kind") == "string") & piece.contains("\n"))).drop("text")
