"""Balanced label propagation: documents into shards of even row counts.

Documents with equal texts are linked.  They start in the shard that their
hash names; each round joins every linked document to its neighbours' shard
counts, and those outside the shard where most neighbours are ask to move
there.  The moves asked for between each pair of shards are cut down until no
shard exceeds its capacity quota, and as many are let through, whole groups
together unless a group is too large for a shard.  Last, rows above a shard's
exact size (documents without links first) fill the gaps of the others, which
leaves all counts at most one apart: the law is ``rows``.

Ranks come from small buckets and the buckets' running totals, so no task
holds a shard.  Only shard-to-shard counts reach the driver.

Defined cases: null text has size 8, is linked with nothing and counts as
empty in the checksum; repeated rows are rows of their own; an empty table
gives an empty table; further columns of the input are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import prepare, written


def quotas(asked: dict[tuple[int, int], int], sizes: list[int], capacity: float) -> dict[tuple[int, int], float]:
    """For each pair of shards the share of the moves asked for that fits the capacities."""
    share = dict.fromkeys(asked, 1.0)
    for _ in range(30):
        after = list(map(float, sizes))
        came = [0.0] * len(sizes)
        for (i, j), n in asked.items():
            after[i] -= n * share[i, j]
            after[j] += n * share[i, j]
            came[j] += n * share[i, j]
        if all(x <= max(capacity, s) + 1e-6 for x, s in zip(after, sizes, strict=True)):
            break
        for i, j in asked:
            if after[j] > capacity and came[j]:
                share[i, j] *= max(0.0, 1 - (after[j] - capacity) / came[j])
    return share


def _table(values: list[float], at):
    """The value at a place of a short list (a constant array in the plan)."""
    return F.element_at(F.lit(list(map(float, values))), at.cast("int") + 1)


def _unit(*cols):
    """A number from 0 to 1 from a hash."""
    return (F.xxhash64(*cols) / F.lit(2.0**64)) + F.lit(0.5)


#: What tells rows apart: repeated rows are numbered.
ROW = ("doc_id", "group", "nth")
#: Repeated rows that one task numbers at a time.
CHUNK = 10_000


def numbered(docs: DataFrame, text: str) -> DataFrame:
    """doc_id, size, text_crc32, group (the text's digest, null for null) and number among equal rows.

    Rows are counted first and the numbers made from the counts, so they do not depend on files and
    partitions, and a row repeated very often is one row on its way.
    """
    content = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(
        "doc_id", (F.octet_length(content) + 8).cast("long").alias("size"), F.crc32(content.cast("binary")).alias("text_crc32"), F.unhex(F.sha2(F.col(text).cast("binary"), 256)).alias("group"),
    )
    counted = rows.groupBy("doc_id", "size", "text_crc32", "group").agg(F.count("*").alias("n"))
    chunks = counted.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / CHUNK)))).repartition("doc_id", "group", "chunk")
    first = F.col("chunk") * CHUNK
    nth = F.explode(F.sequence(first, F.least(first + CHUNK, F.col("n")) - 1))
    return written(chunks.select("doc_id", "size", "text_crc32", "group", nth.alias("nth")), "shard-rows")


def cut_edges(assigned: DataFrame) -> DataFrame:
    """One row: the pairs of rows with equal texts (size and checksum), and how many of these pairs two shards cut."""
    each = assigned.groupBy("size", "text_crc32", "shard").agg(F.count("*").cast("double").alias("n"))
    groups = each.groupBy("size", "text_crc32").agg(F.sum("n").alias("all"), F.sum(F.col("n") * F.col("n")).alias("same"))
    return groups.agg((F.sum(F.col("all") * (F.col("all") - 1)) / 2).alias("edges"), (F.sum(F.col("all") * F.col("all") - F.col("same")) / 2).alias("cut"))


def assign_shards(docs: DataFrame, shards: int = 24, rounds: int = 6, slack: float = 0.25, text: str = "text", bucket_rows: int = 4000) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of each row."""
    prepare(docs.sparkSession)
    rows = numbered(docs, text)
    groups = rows.where(F.col("group").isNotNull()).groupBy("group").agg(F.count("*").alias("members")).where(F.col("members") > 1)
    groups = written(groups, "shard-groups")  # so that the join deals it anew and can split a hot group
    start = F.pmod(F.xxhash64(*ROW), F.lit(shards)).cast("int")
    rows = written(rows.join(groups, "group", "left").withColumn("shard", start), "shard-start")

    linked = rows.where(F.col("members").isNotNull())
    alone = {r.shard: r.n for r in rows.where(F.col("members").isNull()).groupBy("shard").agg(F.count("*").alias("n")).collect()}
    n = rows.count()
    capacity = math.ceil(n / shards) * (1 + slack)
    large = F.col("members") > F.lit(capacity / 3)
    for turn in range(rounds):
        near = linked.groupBy("group", "shard").agg(F.count("*").alias("n"))
        # Most neighbours first, ties to the smaller shard number.
        best = near.groupBy("group").agg(F.max(F.struct("n", (-F.col("shard")).alias("s"))).alias("b")).select("group", (-F.col("b.s")).alias("to"))
        wish = written(linked.join(written(best, "shard-best"), "group"), "shard-wish")
        flows = {(r.shard, r.to, r.large): r.n for r in wish.groupBy("shard", "to", large.alias("large")).agg(F.count("*").alias("n")).collect()}
        sizes = [alone.get(s, 0) + sum(k for (i, _, _), k in flows.items() if i == s) for s in range(shards)]
        if all(i == j for i, j, _ in flows):
            break
        shares = []
        for kind in (False, True):  # groups that fit go first
            asked = {(i, j): k for (i, j, x), k in sorted(flows.items()) if x == kind and i != j}
            share = quotas(asked, sizes, capacity)
            for (i, j), k in asked.items():
                sizes[i] -= round(k * share[i, j])
                sizes[j] += round(k * share[i, j])
            shares.append(_table([share.get((i, j), 0.0) for i in range(shards) for j in range(shards)], F.col("shard") * shards + F.col("to")))
        move = F.when(large, _unit(*ROW, F.lit(turn)) <= shares[1]).otherwise(_unit("group", F.lit(turn)) <= shares[0])
        linked = wish.withColumn("shard", F.when((F.col("shard") != F.col("to")) & move, F.col("to")).otherwise(F.col("shard"))).drop("to")
    rows = rows.where(F.col("members").isNull()).unionByName(linked)
    return settle(rows, n, shards, bucket_rows)


def settle(rows: DataFrame, n: int, shards: int, bucket_rows: int) -> DataFrame:
    """Exact sizes and gapless slots: rows over a shard's size go to the shards that lack some."""
    buckets = max(1, math.ceil(n / shards / bucket_rows))
    by_group = F.pmod(F.xxhash64("group"), F.lit(buckets))
    by_row = F.pmod(F.xxhash64(*ROW), F.lit(buckets))
    hot = F.col("members") > F.lit(bucket_rows)
    # Small linked groups first, parts of large ones next, documents without links last.
    bucket = F.when(F.col("members").isNull(), 2 * buckets + by_row).when(hot, buckets + by_row).otherwise(by_group)
    rows = written(rows.withColumn("bucket", bucket), "shard-end")
    counts = rows.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    before = counts.withColumn("before", F.sum("n").over(Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)))
    before = before.select("shard", "bucket", F.coalesce("before", F.lit(0)).alias("before"))
    have = {r.shard: r.n for r in counts.groupBy("shard").agg(F.sum("n").alias("n")).collect()}
    want = {s: n // shards + (s < n % shards) for s in range(shards)}
    over, gaps, o, g = [], [], 0, 0
    for s in range(shards):
        extra = have.get(s, 0) - want[s]
        over.append(o)
        if extra > 0:
            o += extra
        elif extra < 0:
            gaps.append((g, g - extra, s))
            g -= extra
    ranked = rows.join(before, ["shard", "bucket"]).withColumn(
        "rank", F.col("before") + F.row_number().over(Window.partitionBy("shard", "bucket").orderBy("group", "doc_id", "nth")) - 1
    )
    quota = _table([want[s] for s in range(shards)], F.col("shard"))
    moved = (_table(over, F.col("shard")) + F.col("rank") - quota).cast("long")
    ranked = ranked.withColumn("gap", F.when(F.col("rank") >= quota, moved))
    shard, slot = F.col("shard"), F.col("rank")
    for lo, hi, s in gaps:
        here = (F.col("gap") >= lo) & (F.col("gap") < hi)
        shard = F.when(here, F.lit(s)).otherwise(shard)
        slot = F.when(here, F.col("gap") - lo + have.get(s, 0)).otherwise(slot)
    return ranked.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), shard.cast("int").alias("shard"), slot.cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
