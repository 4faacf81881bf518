"""Scalar tests on values, as column expressions (no UDFs)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import vocab as V


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def like(c: Column, pattern: str) -> Column:
    """A pattern whose last $ means the end of the value only (Java's also stands before a last newline)."""
    return c.rlike(pattern[:-1] + "\\z" if pattern.endswith("$") else pattern)


def chars(c: Column | str) -> Column:
    return F.split(col(c), "")


def shannon(c: Column | str) -> Column:
    """Bits per character; 0 for the empty string."""
    c = col(c)
    n = F.length(c).cast("double")
    p = lambda ch: (F.length(c) - F.length(F.replace(c, ch, F.lit("")))) / n
    h = F.aggregate(F.array_distinct(chars(c)), F.lit(0.0), lambda acc, ch: acc - p(ch) * F.log2(p(ch)))
    return F.when(F.length(c) == 0, F.lit(0.0)).otherwise(h)


def is_hex(c: Column | str) -> Column:
    return col(c).rlike("^[0-9a-fA-F]+\\z")


def is_base64ish(c: Column | str) -> Column:
    return col(c).rlike("^[A-Za-z0-9+/_\\-=]+\\z")


def looks_random(c: Column | str) -> Column:
    """Entropy over a floor that depends on the alphabet; short values never."""
    c = col(c)
    floor = F.when(is_hex(c), 3.0).when(is_base64ish(c), 3.8).otherwise(4.0)
    return (F.length(c) >= 16) & (shannon(c) >= floor)


def has_low_variety(c: Column | str) -> Column:
    c = col(c)
    return (F.length(c) == 0) | (F.size(F.array_distinct(chars(c))) <= F.greatest(F.lit(2), F.floor(F.length(c) / 8).cast("int")))


def is_sequential(c: Column | str) -> Column:
    """Eight or more characters, each the next code point after the one before, or each the previous."""
    c = col(c)
    points = F.transform(chars(c), F.ascii)
    steps = F.array_distinct(F.zip_with(F.slice(points, 2, F.greatest(F.length(c) - 1, F.lit(0))), F.slice(points, 1, F.greatest(F.length(c) - 1, F.lit(0))), lambda a, b: a - b))
    return (F.length(c) >= 8) & ((steps == F.array(F.lit(1))) | (steps == F.array(F.lit(-1))))


def contains_any(c: Column, words: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | c.contains(w)
    return out


def stripped(c: Column | str) -> Column:
    return F.regexp_replace(col(c), "^\\s+|\\s+\\z", "")


def is_placeholder(c: Column | str) -> Column:
    c = col(c)
    s = stripped(c)
    low = F.lower(s)
    return (
        low.isin(*V.PLACEHOLDER_EXACT) | like(s, V.TEMPLATE_REF) | contains_any(low, V.PLACEHOLDER_SUBSTRINGS) | low.rlike("^[*x•.]+\\z")
        | has_low_variety(c) | is_sequential(c)
    )


def is_non_secret_shape(c: Column | str) -> Column:
    c = col(c)
    return like(c, V.GIT_SHA) | like(c, V.UUID) | like(c, V.ENV_VAR_NAME) | like(c, V.GO_SUM_HASH)


def is_url(c: Column | str) -> Column:
    return col(c).rlike(V.URL_VALUE)


def is_plausible_key(c: Column | str) -> Column:
    c = col(c)
    return ~is_url(c) & ~like(c, V.SNAKE_WORDS) & ~c.rlike("\\s") & F.length(c).between(16, 200)


def is_organization(c: Column | str) -> Column:
    words = F.split(F.lower(stripped(c)), "\\s+")
    bare = F.transform(words, lambda w: F.regexp_replace(w, "^[.,]+|[.,]+\\z", ""))
    return (words[0] == "the") | F.arrays_overlap(bare, F.lit(list(V.ORG_NAME_MARKERS)))


def in_test_path(c: Column | str) -> Column:
    return contains_any(F.lower(F.replace(col(c), F.lit("\\"), F.lit("/"))), V.TEST_PATH_MARKERS)


def octets(ip: Column | str) -> Column:
    return F.transform(F.split(col(ip), "\\."), lambda x: x.cast("int"))


def is_reserved_ip(ip: Column | str) -> Column:
    """Private, loopback, link-local, multicast, reserved and documentation ranges."""
    o = octets(ip)
    a, b, c = o[0], o[1], o[2]
    return (
        a.isin(0, 10, 127) | (a >= 224) | ((a == 172) & b.between(16, 31)) | ((a == 192) & (b == 168)) | ((a == 169) & (b == 254))
        | ((a == 192) & (b == 0) & (c == 2)) | ((a == 198) & (b == 51) & (c == 100)) | ((a == 203) & (b == 0) & (c == 113)) | ((a == 198) & b.between(18, 19))
    )


def is_noreply(email: Column | str) -> Column:
    low = F.lower(col(email))
    domain = F.substring_index(low, "@", -1)
    return low.rlike("^(?:noreply|no-reply|donotreply)@") | domain.contains("noreply.") | domain.startswith("noreply")


def wilson(k: Column | str, n: Column | str, z: float = 1.96) -> tuple[Column, Column]:
    """Bounds of the score interval; (0, 1) without trials."""
    k, n = col(k).cast("double"), col(n).cast("double")
    p, zz = k / n, z * z
    mid, half = p + zz / (2 * n), z * F.sqrt(p * (1 - p) / n + zz / (4 * n * n))
    low, high = (mid - half) / (1 + zz / n), (mid + half) / (1 + zz / n)
    return F.when(n == 0, 0.0).otherwise(F.greatest(F.lit(0.0), low)), F.when(n == 0, 1.0).otherwise(F.least(F.lit(1.0), high))


def license_of(text: Column | str) -> Column:
    """Licence id by its phrases, null if none fits."""

    def first(t: Column) -> Column:
        out = F
        for name, phrases in V.LICENSES:
            test = F.lit(True)
            for p in phrases:
                test = test & t.contains(p)
            out = out.when(test, F.lit(name))
        return out

    # Each step is bound, so that it is done once and not for each phrase; white space is evened only in texts with a word of some licence.
    bound = lambda x, f: F.get(F.transform(F.array(x), f), F.lit(0))
    words = sorted({max(phrases[0].split(), key=len) for _, phrases in V.LICENSES})
    named = lambda t: reduce(lambda a, b: a | b, [t.contains(w) for w in words])
    return bound(F.lower(col(text)), lambda t: F.when(named(t), bound(F.trim(F.regexp_replace(t, "\\s+", " ")), first)))


def mask(entity: Column | str, value: Column | str) -> Column:
    """What may be shown of a value."""
    e, v = col(entity), col(value)
    size = F.concat(F.lit("…["), F.length(v).cast("string"), F.lit(" chars]"))
    prefix = F.regexp_extract(v, f"^(?:{V.PROVIDER_PREFIXES})", 0)
    domain = F.substring(v, F.instr(v, "@") + 1, F.length(v))
    host = F.regexp_extract(domain, "^(.*)\\.", 1)
    first = lambda c: F.substring(c, 1, 1)
    key = F.when(v.startswith("-----BEGIN"), "-----BEGIN …PRIVATE KEY----- [PEM block]").otherwise(F.concat(F.when(prefix != "", prefix).otherwise(F.substring(v, 1, 2)), size))
    return (
        F.when(e == "KEY", key)
        .when(e == "PASSWORD", size)
        .when(e == "EMAIL", F.concat(first(v), F.lit("***@"), first(host), F.lit("***."), F.substring_index(domain, ".", -1)))
        .when(e == "IP", F.concat(F.substring_index(v, ".", 1), F.lit(".x.x.x")))
        .when(e == "NAME", F.array_join(F.transform(F.slice(F.split(v, "\\s+"), 1, 3), lambda w: F.concat(first(w), F.lit("***"))), " "))
        .otherwise(F.concat(first(v), F.lit("***")))
    )
