"""SQL for DuckDB that says the same as the operators, written out for each query."""

from __future__ import annotations

from ..functions import vocab as V
from . import fixtures as X


def lit(s: str | None) -> str:
    return "NULL" if s is None else "'" + s.replace("'", "''") + "'"


def words(items: tuple[str, ...]) -> str:
    return "(" + ", ".join(map(lit, items)) + ")"


def values(rows: list[tuple], names: str) -> str:
    return f"(SELECT * FROM (VALUES {', '.join('(' + ', '.join(lit(x) if isinstance(x, str) or x is None else str(x) for x in r) + ')' for r in rows)}) t({names}))"


DOCS = "(SELECT source AS repo, CASE WHEN doc_id % 5 = 0 THEN 'pkg/testdata/doc_' ELSE 'doc_' END || doc_id || '.go' AS path, text FROM documents)"
FIXTURES = values(X.FILES, "repo, path, text")
ALL = f"(SELECT * FROM {DOCS} UNION ALL SELECT * FROM {FIXTURES})"


def re2(pattern: str) -> str:
    return lit((pattern[:-1] + "\\z" if pattern.endswith("$") else pattern).replace("{q}", ""))


def any_of(x: str, items: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"contains({x}, {lit(i)})" for i in items) + ")"


def trimmed(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+\\z', '', 'g')"


def low_variety(x: str) -> str:
    return f"(length({x}) = 0 OR len(list_distinct(string_split({x}, ''))) <= greatest(2, length({x}) // 8))"


def sequential(x: str) -> str:
    steps = f"list_distinct(list_transform(range(1, length({x})), lambda i: unicode({x}[i + 1:i + 1]) - unicode({x}[i:i])))"
    return f"(length({x}) >= 8 AND ({steps} = [1] OR {steps} = [-1]))"


def shannon(x: str) -> str:
    return (
        f"CASE WHEN length({x}) = 0 THEN 0.0 ELSE 0.0 - list_sum(list_transform(list_distinct(string_split({x}, '')), lambda c: "
        f"((length({x}) - length(replace({x}, c, ''))) / length({x})) * log2((length({x}) - length(replace({x}, c, ''))) / length({x})))) END"
    )


def looks_random(x: str) -> str:
    floor = f"CASE WHEN regexp_matches({x}, '^[0-9a-fA-F]+\\z') THEN 3.0 WHEN regexp_matches({x}, '^[A-Za-z0-9+/_\\-=]+\\z') THEN 3.8 ELSE 4.0 END"
    return f"(length({x}) >= 16 AND {shannon(x)} >= {floor})"


def placeholder(x: str) -> str:
    low = f"lower({trimmed(x)})"
    template = "'" + V.TEMPLATE_REF.replace("'", "''")[:-1] + "\\z'"
    return f"({low} IN {words(V.PLACEHOLDER_EXACT)} OR regexp_matches({trimmed(x)}, {template}) OR {any_of(low, V.PLACEHOLDER_SUBSTRINGS)} OR regexp_matches({low}, '^[*x•.]+\\z') OR {low_variety(x)} OR {sequential(x)})"


def non_secret(x: str) -> str:
    return "(" + " OR ".join(f"regexp_matches({x}, {re2(p)})" for p in (V.GIT_SHA, V.UUID, V.ENV_VAR_NAME, V.GO_SUM_HASH)) + ")"


def plausible_key(x: str) -> str:
    return f"(NOT regexp_matches({x}, {re2(V.URL_VALUE)}) AND NOT regexp_matches({x}, {re2(V.SNAKE_WORDS)}) AND NOT regexp_matches({x}, '\\s') AND length({x}) BETWEEN 16 AND 200)"


def organization(x: str) -> str:
    w = f"regexp_split_to_array(lower({trimmed(x)}), '\\s+')"
    return f"({w}[1] = 'the' OR list_has_any(list_transform({w}, lambda z: regexp_replace(z, '^[.,]+|[.,]+\\z', '', 'g')), [{', '.join(map(lit, V.ORG_NAME_MARKERS))}]))"


def test_path(x: str) -> str:
    return any_of(f"lower(replace({x}, '\\', '/'))", V.TEST_PATH_MARKERS)


def reserved_ip(x: str) -> str:
    a, b, c = (f"split_part({x}, '.', {i})::INT" for i in (1, 2, 3))
    return (
        f"({a} IN (0, 10, 127) OR {a} >= 224 OR ({a} = 172 AND {b} BETWEEN 16 AND 31) OR ({a} = 192 AND {b} = 168) OR ({a} = 169 AND {b} = 254) OR ({a} = 192 AND {b} = 0 AND {c} = 2)"
        f" OR ({a} = 198 AND {b} = 51 AND {c} = 100) OR ({a} = 203 AND {b} = 0 AND {c} = 113) OR ({a} = 198 AND {b} BETWEEN 18 AND 19))"
    )


def mask(e: str, v: str) -> str:
    size = f"'…[' || length({v}) || ' chars]'"
    prefix = f"regexp_extract({v}, {lit('^(?:' + V.PROVIDER_PREFIXES + ')')})"
    domain = f"substr({v}, position('@' IN {v}) + 1)"
    return (
        f"CASE {e} WHEN 'KEY' THEN CASE WHEN starts_with({v}, '-----BEGIN') THEN '-----BEGIN …PRIVATE KEY----- [PEM block]' ELSE (CASE WHEN {prefix} <> '' THEN {prefix} ELSE substr({v}, 1, 2) END) || {size} END"
        f" WHEN 'PASSWORD' THEN {size} WHEN 'EMAIL' THEN substr({v}, 1, 1) || '***@' || substr(regexp_extract({domain}, '^(.*)\\.', 1), 1, 1) || '***.' || split_part({domain}, '.', -1)"
        f" WHEN 'IP' THEN split_part({v}, '.', 1) || '.x.x.x' WHEN 'NAME' THEN array_to_string(list_transform(regexp_split_to_array({v}, '\\s+')[1:3], lambda w: substr(w, 1, 1) || '***'), ' ')"
        f" ELSE substr({v}, 1, 1) || '***' END"
    )


_VALUE = {
    "whole": ("0", "m"), "quad": ("0", "m"),
    "quoted": ("length(regexp_extract(m, '^[^\"`]*')) + 1", "substr(m, length(regexp_extract(m, '^[^\"`]*')) + 2, length(m) - length(regexp_extract(m, '^[^\"`]*')) - 2)"),
    "dsn-password": ("length(m) - 1 - length(regexp_extract(m, '://[^:]*:([^@]*)@\\z', 1))", "regexp_extract(m, '://[^:]*:([^@]*)@\\z', 1)"),
    "dsn-user": ("length(regexp_extract(m, '^[^:]*://'))", "regexp_extract(m, '://([^:]*):', 1)"),
    "handle": ("length(m) - length(regexp_extract(m, '@(.*)\\z', 1))", "regexp_extract(m, '@(.*)\\z', 1)"),
}
_VALUE["name"] = (f"length(m) - length(regexp_extract(m, {lit('(' + V._NAME + ')' + chr(92) + 'z')}, 1))", f"regexp_extract(m, {lit('(' + V._NAME + ')' + chr(92) + 'z')}, 1)")


def matches(source: str, pattern: str, more: str = "") -> str:
    """repo, path, text, nth (from 1), pos, m of each match."""
    p = re2(pattern)
    return (
        f"(SELECT repo, path, text, i AS nth, ms[i] AS m, (coalesce(list_sum(list_transform(gs[1:i], lambda g: length(g))), 0) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda g: length(g))), 0))::BIGINT AS pos"
        f" FROM (SELECT repo, path, text, regexp_extract_all(text, {p}) AS ms, regexp_split_to_array(text, {p}) AS gs FROM {source} WHERE regexp_matches(text, {p})), unnest(range(1, len(ms) + 1)) u(i) {more})"
    )


def candidates(source: str, only: tuple[str, ...] = ()) -> str:
    """The CTE body cand: all raw matches with gates, as operators.detect.candidates has them."""
    parts = []
    for rank, (name, entity, pattern, kind, base, in_test) in enumerate(V.DETECTORS):
        if only and name not in only:
            continue
        at, value = _VALUE[kind]
        other = _VALUE["dsn-password"][1] if kind == "dsn-user" else "NULL"
        cond = "TRUE"
        if kind == "quad":
            cond = "regexp_matches(m, '^(\\d{1,3}\\.){3}\\d{1,3}\\z') AND len(list_filter(string_split(m, '.'), lambda o: TRY_CAST(o AS INT) > 255)) = 0"
        if name == "email":
            dsn = matches(source, V.DETECTORS[13][2])
            cond = f"NOT EXISTS (SELECT 1 FROM {dsn} d WHERE d.repo = x.repo AND d.path = x.path AND x.pos < d.pos + length(d.m) AND x.pos + length(x.m) > d.pos)"
        parts.append(
            f"SELECT repo, path, text, {lit(name)} AS detector, {lit(entity)} AS entity, {rank} AS rank, (pos + {at})::BIGINT AS start, {value} AS value, {other} AS other, {base} AS base, {in_test if in_test else 'NULL'} AS in_test"
            f" FROM {matches(source, pattern)} x WHERE {cond}"
        )
    v, d = "value", "detector"
    gates = (
        ("placeholder-domain", f"{d} = 'email' AND lower(split_part({v}, '@', -1)) IN {words(V.PLACEHOLDER_DOMAINS)}"), ("placeholder", f"{d} <> 'ipv4' AND {placeholder(v)}"),
        ("placeholder-password", f"other IS NOT NULL AND {placeholder('other')}"), ("non-secret-shape", f"{d} LIKE '%-assignment' AND {non_secret(v)}"),
        ("implausible-key", f"{d} = 'key-assignment' AND NOT {plausible_key(v)}"), ("not-random", f"{d} = 'key-assignment' AND NOT {looks_random(v)}"),
        ("long-or-multiline", f"{d} = 'password-assignment' AND (contains({v}, chr(10)) OR length({v}) > 100)"), ("url", f"{d} = 'password-assignment' AND regexp_matches({v}, {re2(V.URL_VALUE)})"),
        ("noreply", f"{d} = 'email' AND (regexp_matches(lower({v}), '^(noreply|no-reply|donotreply)@') OR contains(lower(split_part({v}, '@', -1)), 'noreply.') OR starts_with(lower(split_part({v}, '@', -1)), 'noreply'))"),
        ("reserved-range", f"CASE WHEN {d} = 'ipv4' THEN {reserved_ip(v)} ELSE FALSE END"), ("version-line", f"{d} = 'ipv4' AND regexp_matches(lft || {v} || split_part(rgt, chr(10), 1), {re2(V.VERSION_LINE)})"),
        ("handle-word", f"{d} = 'at-handle' AND lower({v}) IN {words(V.HANDLE_WORDS)}"),
        ("sql-variable", f"{d} = 'at-handle' AND (regexp_matches(regexp_replace(lft, '@\\z', ''), {lit(V.SQL_VAR_LEFT[:-1] + chr(92) + 'z')}) OR regexp_matches(substr(rgt, 1, 40), {re2(V.SQL_VAR_RIGHT)}))"),
        ("organization", f"entity = 'NAME' AND {organization(v)}"), ("test-path", "in_test_path AND in_test IS NULL"),
    )
    case = "CASE " + " ".join(f"WHEN {test} THEN {lit(name)}" for name, test in gates) + " END"
    return (
        f"raw AS ({' UNION ALL '.join(parts)}), placed AS (SELECT *, start + length(value) AS \"end\", length(substr(text, 1, start)) - length(replace(substr(text, 1, start), chr(10), '')) + 1 AS line,"
        f" split_part(substr(text, 1, start), chr(10), -1) AS lft, substr(text, start + length(value) + 1) AS rgt, {test_path('path')} AS in_test_path FROM raw),"
        f" judged AS (SELECT *, length(lft) + 1 AS col, {case} AS suppressed_by FROM placed),"
        f" cand AS (SELECT repo, path, text, detector, entity, rank, start, \"end\", line, col, value, base, in_test_path, suppressed_by, suppressed_by IS NULL AS passes,"
        f" CASE WHEN in_test_path AND suppressed_by IS NULL THEN in_test ELSE base END::DOUBLE AS confidence,"
        f" max(suppressed_by IS NULL) OVER (PARTITION BY repo, path, entity, start, \"end\") AS survives FROM judged)"
    )
