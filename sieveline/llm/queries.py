"""The queries of this subpackage, one for each operator, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import new_path


def _docs(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html_extract import extract_pages

    return extract_pages(_docs(spark, sf_dir, "pages"))


def op2_quality_gbt(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_gbt import classify_quality

    return classify_quality(_docs(spark, sf_dir), _docs(spark, sf_dir, "labels"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_rules import host_rules

    return host_rules(_docs(spark, sf_dir)).drop("host", "host_rate")


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import assign_shards

    return assign_shards(_docs(spark, sf_dir))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .token_counts import count_tokens

    # A cache of its own for each call, so that a result never rests on an earlier run.
    return count_tokens(_docs(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"), new_path(spark, "token-cache"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import score_toxicity

    return score_toxicity(_docs(spark, sf_dir), _docs(spark, sf_dir, "labels"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substring_dedup import repeat_digests

    return repeat_digests(_docs(spark, sf_dir))


def op8_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .minhash import near_duplicates

    return near_duplicates(_docs(spark, sf_dir), k=3, percent=85)


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .bpe import encode_table

    return encode_table(_docs(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import find_contamination

    found = find_contamination(_docs(spark, sf_dir), _docs(spark, sf_dir, "benchmark"))
    return found.withColumn("item_ids", F.array_join("item_ids", ",")).withColumn("equal_words", F.col("equal_words").cast("long"))


QUERIES = {f.__name__: f for f in (op1_html_extract, op2_quality_gbt, op3_quality_rules, op4_sharding, op5_token_counts, op6_toxicity, op7_substring_dedup, op8_minhash, op9_byte_bpe, op10_decontaminate)}
# SQL for what SQL can say; the other operators' results are held against plain versions in the tests.
_SPACE = "[\\x20\\x09-\\x0D]"
_WORDS = f"list_filter(regexp_split_to_array(coalesce(text, ''), '{_SPACE}+'), lambda x: x <> '')"

_RULES = f"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text, {_WORDS} AS ws, list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\\x20\\x09-\\x0D]')) AS lines FROM documents),
g AS (SELECT doc_id, i, array_to_string(ws[i:i + 4], ' ') AS g FROM d, unnest(range(1, len(ws) - 3)) u(i)),
twice AS (SELECT doc_id, i FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
rep AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS p FROM twice) GROUP BY doc_id),
c AS (SELECT doc_id, source, len(ws)::BIGINT AS n_words, coalesce(list_sum(list_transform(ws, lambda w: length(w))), 0)::BIGINT AS word_chars,
  (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words
  FROM d LEFT JOIN rep USING (doc_id)),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM c),
h AS (SELECT source, count(*) AS n, count(*) FILTER (base_failed) AS f FROM b GROUP BY source),
m AS (SELECT avg(f / n) AS m, greatest(var_pop(f / n) - avg(f / n) * (1 - avg(f / n)) * avg(1 / n), 1e-4 * avg(f / n) * (1 - avg(f / n))) AS v FROM h),
p AS (SELECT CASE WHEN m <= 0 OR m >= 1 THEN 1.0 ELSE m * greatest(m * (1 - m) / v - 1, 2.0) END AS a, CASE WHEN m <= 0 OR m >= 1 THEN 1.0 ELSE (1 - m) * greatest(m * (1 - m) / v - 1, 2.0) END AS b FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND (f + p.a) / (n + p.a + p.b) <= 0.5 AS kept
FROM b JOIN h ON b.source IS NOT DISTINCT FROM h.source, p
"""

_REPEATS = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
w AS (SELECT doc_id, i, md5(array_to_string(ws[i:i + 49], ' ')) AS g FROM d, unnest(range(1, len(ws) - 48)) u(i)),
hit AS (SELECT doc_id, i FROM w QUALIFY min(doc_id) OVER (PARTITION BY g) < doc_id),
cov AS (SELECT doc_id, list(DISTINCT p) AS ps FROM (SELECT doc_id, unnest(range(i, i + 50)) AS p FROM hit) GROUP BY doc_id),
k AS (SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(len(ps), 0)::BIGINT AS n_removed, CASE WHEN ps IS NULL THEN ws ELSE list_filter(ws, lambda x, i: NOT list_contains(ps, i)) END AS kept FROM d LEFT JOIN cov USING (doc_id))
SELECT doc_id, n_words, n_removed, sha256(array_to_string(kept, ' ')) AS kept_sha256 FROM k
"""

_NEAR = f"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_SPACE}+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, md5_number_lower(array_to_string(ws[i:i + 2], ' ')) AS g FROM d, unnest(range(1, greatest(len(ws) - 1, least(len(ws), 1) + 1))) u(i)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM pairs JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * k >= 85 * (p.n + q.n - k)),
edges AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT a, b FROM edges UNION SELECT r.a, e.b FROM reach r JOIN edges e ON r.b = e.a),
comp AS (SELECT a AS doc_id, min(b) AS c FROM reach GROUP BY a)
SELECT doc_id, coalesce(n, 0) AS n_shingles, least(coalesce(c, doc_id), doc_id) AS component_id, least(coalesce(c, doc_id), doc_id) = doc_id AS kept FROM d LEFT JOIN n USING (doc_id) LEFT JOIN comp USING (doc_id)
"""

_BARE = "list_transform(list_filter(regexp_split_to_array(lower({t}), '[\\x20\\x09-\\x0D]+'), lambda x: x <> ''), lambda w: CASE WHEN regexp_matches(w, '[^!-/:-@\\[-`{{-~]') THEN regexp_replace(w, '^[!-/:-@\\[-`{{-~]+|[!-/:-@\\[-`{{-~]+\\z', '', 'g') ELSE w END)"
_LEAKS = f"""
WITH d AS (SELECT doc_id, {_BARE.format(t="text")} AS ws FROM documents), b AS (SELECT item_id, {_BARE.format(t="text")} AS ws FROM benchmark),
dw AS (SELECT doc_id, i, ws[i] AS w FROM d, unnest(range(1, len(ws) + 1)) u(i)), bw AS (SELECT item_id, len(ws) AS n, i, ws[i] AS w FROM b, unnest(range(1, len(ws) + 1)) u(i)),
m AS (SELECT doc_id, item_id, n, dw.i - bw.i AS diag, bw.i AS p FROM dw JOIN bw USING (w) WHERE n >= 5 QUALIFY count(*) OVER (PARTITION BY doc_id, item_id, diag) >= least(ceil(0.8 * n), 16) - 1),
r AS (SELECT doc_id, item_id, n, count(*) OVER (PARTITION BY doc_id, item_id, diag ORDER BY p RANGE BETWEEN CURRENT ROW AND 19 FOLLOWING) AS best, count(*) OVER (PARTITION BY doc_id, item_id, diag) AS total FROM m),
f AS (SELECT doc_id, item_id, max(best) AS best FROM r WHERE best >= CASE WHEN n < 8 THEN n WHEN n < 12 THEN n - 1 ELSE ceil(0.8 * least(n, 20)) END OR (n >= 20 AND 100 * total >= 80 * n) GROUP BY 1, 2),
x AS (SELECT doc_id, list_sort(list(item_id)) AS items, max(best) AS best FROM f GROUP BY doc_id)
SELECT doc_id, items IS NOT NULL AS contaminated, array_to_string(coalesce(items, []), ',') AS item_ids, coalesce(best, 0)::BIGINT AS equal_words FROM d LEFT JOIN x USING (doc_id)
"""

ORACLE: dict[str, str] = {"op3_quality_rules": _RULES, "op7_substring_dedup": _REPEATS, "op8_minhash": _NEAR, "op10_decontaminate": _LEAKS}
