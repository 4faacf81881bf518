"""Candidates of sensitive data in texts: spans, gates, confidence, survival, deduplication.

One pass over the text column: for each detector the pieces between matches
and the matches themselves give places; the arrays of all detectors are joined
and exploded once.  Offsets are code points from 0, ends exclusive; lines and
columns count from 1.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import predicates as P
from ..functions import vocab as V


def java(pattern: str) -> str:
    """The pattern in Java's dialect: possessive where {q} marks it, '.' and '^' as elsewhere."""
    return pattern.replace("{q}", "+")


#: Matches whose places are counted from one stored place.
STEP = 16
_PLACE = "struct<at:int,line:int,col:int>"


def _newlines(s: Column) -> Column:
    return F.length(s) - F.length(F.replace(s, F.lit("\n"), F.lit("")))


def _behind(place: Column, piece: Column) -> Column:
    """Offset, line and column (all from 0) behind a piece of text, of which length, newlines and length of the last line are known."""
    col = F.when(piece["lines"] > 0, piece["tail"]).otherwise(place["col"] + piece["n"])
    return F.struct((place["at"] + piece["n"]).alias("at"), (place["line"] + piece["lines"]).alias("line"), col.alias("col")).cast(_PLACE)


def matches(text: Column, patterns: list[tuple[int, str, Column | None]]) -> Column:
    """array<struct<rank, place, m, gap, last, next>>: of each match of each pattern its number, place, text, the text since
    the match before, that match, and the text up to the next. patterns: number, pattern, and whether a text may have it (None: always).

    No pattern may match the empty string. Only the pieces between matches and the matches are read, each a few times, so the work follows the length of
    the text and not the square of its matches: the places of every ``STEP``th match are stored, the others are counted from there.
    """
    each = []
    for rank, pattern, sign in patterns:
        found = F.struct(F.lit(rank).alias("rank"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"), F.split(text, pattern, -1).alias("g"))
        each.append(F.when(text.isNotNull() if sign is None else sign, found))
    # Each step binds what the next one reads, so that nothing is made again for each match.
    every = F.filter(F.array(*each), lambda s: s.isNotNull())
    before = lambda s: F.zip_with(F.slice(s["g"], 1, F.size(s["m"])), F.concat(F.array(F.lit("")), F.slice(s["m"], 1, F.greatest(F.size(s["m"]) - 1, F.lit(0)))), lambda g, m: F.concat(m, g))
    measure = lambda t: F.struct(F.length(t).alias("n"), _newlines(t).alias("lines"), F.length(F.substring_index(t, "\n", -1)).alias("tail"))
    every = F.transform(every, lambda s: F.struct(s["rank"].alias("rank"), s["m"].alias("m"), s["g"].alias("g"), F.transform(before(s), measure).alias("p")))
    zero = F.struct(F.lit(0).alias("at"), F.lit(0).alias("line"), F.lit(0).alias("col")).cast(_PLACE)

    def stored(p: Column) -> Column:
        steps = F.sequence(F.lit(0), F.floor(F.size(p) / STEP).cast("int"))
        return F.aggregate(steps, F.array(zero), lambda done, k: F.concat(done, F.array(F.aggregate(F.slice(p, k * STEP + 1, F.lit(STEP)), F.get(done, k), _behind))))

    every = F.transform(every, lambda s: F.struct(*[s[c].alias(c) for c in ("rank", "m", "g", "p")], stored(s["p"]).alias("known")))

    def match(s: Column, x: Column, i: Column) -> Column:
        near = F.floor(i / STEP).cast("int")
        place = F.aggregate(F.slice(s["p"], near * STEP + 1, i - near * STEP + 1), F.get(s["known"], near), _behind)
        return F.struct(s["rank"].alias("rank"), place.alias("place"), x.alias("m"), F.get(s["g"], i).alias("gap"), F.get(s["m"], i - 1).alias("last"), F.get(s["g"], i + 1).alias("next"))

    return F.flatten(F.transform(every, lambda s: F.transform(s["m"], lambda x, i: match(s, x, i))))


def spans(text: Column, pattern: str) -> Column:
    """The matches of one pattern."""
    return matches(text, [(0, pattern, None)])


def _value(kind: str, m: Column) -> tuple[Column, Column]:
    """Offset of the value within a match, and the value."""
    if kind in ("whole", "quad"):
        return F.lit(0), m
    if kind == "quoted":
        at = F.length(F.regexp_extract(m, "^[^\"`]*", 0)) + 1
        return at, F.substring(m, at + 1, F.length(m) - at - 1)
    if kind == "dsn-password":
        v = F.regexp_extract(m, "://[^:]*:([^@]*)@\\z", 1)
        return F.length(m) - 1 - F.length(v), v
    if kind == "dsn-user":
        v = F.regexp_extract(m, "://([^:]*):", 1)
        return F.length(F.regexp_extract(m, "^[^:]*://", 0)), v
    v = F.regexp_extract(m, "@(.*)\\z", 1) if kind == "handle" else F.regexp_extract(m, f"({V._NAME})\\z", 1)
    return F.length(m) - F.length(v), v


def signed(text: Column, name: str) -> Column:
    """Whether a text may hold a match of a detector: by literals, and by a pattern only where these are there."""
    literals, pattern = V.SIGNS[name]
    sign = text.contains(literals[0])
    for x in literals[1:]:
        sign = sign | text.contains(x)
    return F.coalesce(sign & text.rlike(pattern) if pattern else sign, F.lit(False))


#: Numbers of the detectors that need more than a match.
_PASSWORD, _USER, _EMAIL, _IP, _HANDLE = (next(i for i, d in enumerate(V.DETECTORS) if d[3] == k or d[0] == k) for k in ("dsn-password", "dsn-user", "email", "ipv4", "at-handle"))


def candidates(files: DataFrame, only: tuple[str, ...] = ()) -> DataFrame:
    """One row for each raw match of each detector (or of some). files: repo, path, text."""
    text = F.col("text")
    ranks = [i for i, d in enumerate(V.DETECTORS) if not only or d[0] in only]
    # Connection strings have two detectors, and no email address is a part of one.
    run = sorted({_PASSWORD if i in (_USER, _EMAIL) else i for i in ranks} | set(ranks) - {_USER})
    found = matches(text, [(i, java(V.DETECTORS[i][2]), signed(text, V.DETECTORS[i][0])) for i in run])
    # A line with a version makes every address on it one.
    versions = F.when(signed(text, "ipv4"), F.transform(F.split(text, "\n", -1), lambda x: x.rlike(V.VERSION_LINE))) if _IP in ranks else F.lit(None).cast("array<boolean>")
    bound = F.transform(F.array(F.struct(found.alias("f"), versions.alias("v"))), lambda b: F.struct(b["f"].alias("f"), b["v"].alias("v"), F.filter(b["f"], lambda x: x["rank"] == _PASSWORD).alias("dsn")))

    def stays(b: Column, x: Column) -> Column:
        begin, end = x["place"]["at"], x["place"]["at"] + F.length(x["m"])
        clear = ~F.exists(b["dsn"], lambda d: (begin < d["place"]["at"] + F.length(d["m"])) & (end > d["place"]["at"]))
        # Whole runs of digits and dots, so that no neighbour is one.
        quad = x["m"].rlike("^(?:\\d{1,3}\\.){3}\\d{1,3}\\z") & ~F.exists(P.octets(x["m"]), lambda o: o > 255)
        return F.when(x["rank"] == _EMAIL, clear).when(x["rank"] == _IP, quad).otherwise(F.lit(True))

    def rows(b: Column, x: Column) -> Column:
        twice = F.when(x["rank"] == _PASSWORD, F.array(F.lit(_PASSWORD), F.lit(_USER))).otherwise(F.array(x["rank"]))
        versioned = F.when(x["rank"] == _IP, F.get(b["v"], x["place"]["line"])).otherwise(F.lit(False))
        return F.transform(twice, lambda r: F.struct(r.alias("rank"), x["place"].alias("place"), *[x[c].alias(c) for c in ("m", "gap", "last", "next")], versioned.alias("versioned")))

    picked = F.flatten(F.flatten(F.transform(bound, lambda b: F.transform(F.filter(b["f"], lambda x: stays(b, x)), lambda x: rows(b, x)))))
    c = files.select("repo", "path", F.explode(picked).alias("f")).select("repo", "path", "f.*").where(F.col("rank").isin(*ranks))
    return gated(_valued(c))


def _valued(c: DataFrame) -> DataFrame:
    """Matches with their value, its place, and what the gates read of its surroundings."""
    kinds: dict[str, list[int]] = {}
    for i, d in enumerate(V.DETECTORS):
        kinds.setdefault(d[3], []).append(i)
    m, rank = F.col("m"), F.col("rank")
    off, value = F.lit(0), m
    for kind, of in kinds.items():
        if kind not in ("whole", "quad"):
            at, v = _value(kind, m)
            off, value = F.when(rank.isin(*of), at).otherwise(off), F.when(rank.isin(*of), v).otherwise(value)
    field = lambda k, t: F.get(F.array(*[F.lit(d[k]).cast(t) for d in V.DETECTORS]), rank)
    handle = rank == _HANDLE
    c = c.withColumn("off", off).withColumn("value", value).withColumn("lead", F.substring("m", F.lit(1), F.col("off")))
    c = c.withColumn("lines", _newlines(F.col("lead")))
    col = F.when(F.col("lines") > 0, F.length(F.substring_index("lead", "\n", -1))).otherwise(F.col("place.col") + F.col("off"))
    start = F.col("place.at") + F.col("off")
    # A keyword before a handle stands in the gap or is itself the handle before: both end at a word's end.
    left = F.substring_index(F.concat(F.coalesce("last", F.lit("")), "gap", "lead"), "\n", -1)
    return c.select(
        "repo", "path", field(0, "string").alias("detector"), field(1, "string").alias("entity"), rank.cast("int").alias("rank"), start.cast("int").alias("start"), (start + F.length("value")).cast("int").alias("end"),
        (F.col("place.line") + F.col("lines") + 1).cast("int").alias("line"), (col + 1).cast("int").alias("col"), "value", F.when(handle, left).alias("left"), F.when(handle, F.substring("next", 1, 40)).alias("right"),
        "versioned", F.when(rank == _USER, _value("dsn-password", m)[1]).alias("other"), field(4, "double").alias("base"), field(5, "double").alias("in_test"),
    )


def gated(c: DataFrame) -> DataFrame:
    """Adds in_test_path, suppressed_by (first gate that drops the candidate, else null), passes and confidence."""
    v, d, test = F.col("value"), F.col("detector"), P.in_test_path("path")
    assigned = d.isin("key-assignment", "password-assignment", "username-assignment")
    domain = F.lower(F.substring_index(v, "@", -1))
    gates = [
        ("placeholder-domain", (d == "email") & domain.isin(*V.PLACEHOLDER_DOMAINS)),
        ("placeholder", (d != "ipv4") & P.is_placeholder(v)),
        ("placeholder-password", F.col("other").isNotNull() & P.is_placeholder("other")),
        ("non-secret-shape", assigned & P.is_non_secret_shape(v)),
        ("implausible-key", (d == "key-assignment") & ~P.is_plausible_key(v)),
        ("not-random", (d == "key-assignment") & ~P.looks_random(v)),
        ("long-or-multiline", (d == "password-assignment") & (v.contains("\n") | (F.length(v) > 100))),
        ("url", (d == "password-assignment") & P.is_url(v)),
        ("noreply", (d == "email") & P.is_noreply(v)),
        ("reserved-range", (d == "ipv4") & P.is_reserved_ip(v)),
        ("version-line", (d == "ipv4") & F.col("versioned")),
        ("handle-word", (d == "at-handle") & F.lower(v).isin(*V.HANDLE_WORDS)),
        ("sql-variable", (d == "at-handle") & (F.regexp_replace("left", "@\\z", "").rlike(V.SQL_VAR_LEFT.replace("$", "\\z")) | F.col("right").rlike(V.SQL_VAR_RIGHT))),
        ("organization", (F.col("entity") == "NAME") & P.is_organization(v)),
        ("test-path", test & F.col("in_test").isNull()),
    ]
    why = F
    for name, test_ in gates:
        why = why.when(test_, F.lit(name))
    return (
        c.withColumn("in_test_path", test)
        .withColumn("suppressed_by", why)
        .withColumn("passes", F.col("suppressed_by").isNull())
        .withColumn("confidence", F.when(test & F.col("passes"), F.col("in_test")).otherwise(F.col("base")))
        .drop("left", "right", "versioned", "other", "in_test")
    )


def survivors(c: DataFrame) -> DataFrame:
    """Adds survives: some detector keeps this entity at this span."""
    w = Window.partitionBy("repo", "path", "entity", "start", "end")
    return c.withColumn("survives", F.max("passes").over(w))


def deduped(c: DataFrame) -> DataFrame:
    """The most confident candidate of each entity and span; ties go to the earlier detector."""
    w = Window.partitionBy("repo", "path", "entity", "start", "end").orderBy(F.col("confidence").desc(), "rank")
    return c.withColumn("n", F.row_number().over(w)).where("n = 1").drop("n")


def scan(files: DataFrame, suppress: bool = True, min_confidence: float = 0.0) -> DataFrame:
    """Findings of a scan: deduplicated, with a raw mode that skips all gates."""
    c = candidates(files)
    c = c.where("passes") if suppress else c.withColumn("confidence", F.col("base"))
    return deduped(c).where(F.col("confidence") >= min_confidence)


def masked(findings: DataFrame) -> DataFrame:
    """Findings fit to leave the engine: values are replaced by masks."""
    return findings.withColumn("masked", P.mask("entity", "value")).drop("value")


def report(findings: DataFrame) -> DataFrame:
    """Rows of the report, most confident first."""
    return masked(findings).select("entity", "masked", "path", "line", F.col("col").alias("column"), "detector", F.round("confidence", 2).alias("confidence")).orderBy(F.col("confidence").desc(), "path", "line")


def report_json(findings: DataFrame) -> DataFrame:
    return report(findings).select(F.to_json(F.struct("*")).alias("json"))


def summary(findings: DataFrame) -> DataFrame:
    """Counts by entity, and whether there is a credential of high confidence among them."""
    high = F.col("entity").isin("KEY", "PASSWORD") & (F.col("confidence") >= 0.85)
    return findings.groupBy("entity").agg(F.count("*").alias("n"), F.bool_or(high).alias("rotate")).orderBy("entity")
