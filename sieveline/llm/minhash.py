"""Near-duplicate documents: MinHash bands, sequential Bayesian verification, exact confirmation.

1. A document's set holds the hashes of its distinct word shingles.  Rows with
   equal sets are one class, so copies and repeated rows are one from here on.
2. Bands of minimum hashes give buckets of classes.  The number of bands
   follows from the miss probability wanted at the threshold.  Of each class
   that shares a bucket, one row gives a second signature of ``VALUES``
   one-byte values and the full set.
3. In each bucket every class is compared with a central one, which shares
   most buckets with others.  Signatures are compared a batch at a time; a pair
   goes as soon as the posterior probability that its similarity reaches the
   threshold, under a uniform prior, is below ``miss``.  Survivors are
   confirmed on the full sets: a class's set is sent once for each of its pairs
   to where the central class's is, so a group of any size is linear.
4. Links join classes into components.  Buckets that still hold several
   components compare the classes outside their largest component with all
   others, in blocks of ``BLOCK`` classes and without giving the pairs out.  A class goes to at most
   ``BLOCKS`` blocks: a bucket with more is dealt anew by bands of twice as many rows,
   which classes that merely share a phrase do not share, up to ``MOST_ROWS`` rows; two classes that
   share such a band alone are compared as a pair.  So no link between
   different components is lost and a group of copies never gives all its pairs.

Defined cases: ASCII letters are lower-cased; a text with fewer words than a
shingle has its whole sequence as one; null texts and texts without words have
an empty set, are linked with nothing and are their own component; rows with
null doc_id take their class's component and are not kept; repeated rows share
a component and are all kept or all not; rows with one doc_id and different
texts are one document, linked by whichever text fits (its classes are linked); an empty table gives an empty table;
further columns of the input are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .store import prepare, remove, written
from .text import Flat, U, in_groups, mix, rolled, slices

ROWS, MOST_ROWS, BATCH, VALUES = 4, 16, 32, 256
#: Members of a bucket in one block of comparisons, and up to how many blocks of a bucket meet each other.
BLOCK, BLOCKS = 500, 32
#: Sets up to this size are compared within a block by 32 bits of their hashes; pairs with larger ones are confirmed on the full sets only.
LONG = 20_000


def n_bands(threshold: float, miss: float, rows: int = ROWS) -> int:
    return math.ceil(math.log(miss) / math.log(1 - threshold**rows))


def least_matches(threshold: float, miss: float, n: int) -> list[int]:
    """For 1 to n compared values, the fewest matches at which a posterior share of ``miss`` still reaches the threshold."""
    s = (np.arange(20_000) + 0.5) / 20_000
    same = s + (1 - s) / 256  # different values may share their byte
    log_s, log_d = np.log(same), np.log1p(-same)
    out, m = [0], 0
    for k in range(1, n + 1):
        while m <= k:
            log = m * log_s + (k - m) * log_d
            p = np.exp(log - log.max())
            if p[s >= threshold].sum() / p.sum() >= miss:
                break
            m += 1
        out.append(m)
    return out


def shingle_sets(f: Flat, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Document and hash of each distinct shingle, ordered by both."""
    g, at = f.grams(k)
    doc = f.doc[at]
    words = np.diff(f.first)
    for n in range(1, k):  # short texts: the whole sequence
        short = np.flatnonzero(words == n)
        if len(short):
            g = np.concatenate([g, rolled(f.word_hash, n)[f.first[short]] + U(n)])
            doc = np.concatenate([doc, short])
    order, new = in_groups(doc, g)
    return doc[order][new], g[order][new]


def minima(doc: np.ndarray, g: np.ndarray, n_docs: int, n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """The set sizes, and n minimum hashes of each document (0 for empty sets)."""
    size = np.bincount(doc, minlength=n_docs)
    filled = np.flatnonzero(size)
    first = np.searchsorted(doc, filled)
    salts = mix(np.arange(1, 2 * n + 1, dtype=U) * U(0x2545F4914F6CDD1D) + U(seed))
    out = np.zeros((n_docs, n), np.uint32)
    if len(filled):
        for j in range(n):
            h = (g ^ salts[2 * j]) * (salts[2 * j + 1] | U(1))
            out[filled, j] = np.minimum.reduceat((h >> U(32)).astype(np.uint32), first)
    return size, out


def band_keys(low: np.ndarray, bands: int, rows: int = ROWS) -> np.ndarray:
    low = low.reshape(len(low), bands, rows)
    key = np.broadcast_to(np.arange(1, bands + 1, dtype=U), (len(low), bands))
    for r in range(rows):
        key = mix(key * U(0x9E3779B97F4A7C15) + low[:, :, r])
    return key


def _sum_by(doc: np.ndarray, v: np.ndarray, n: int) -> np.ndarray:
    s = np.zeros(len(v) + 1, U)
    np.cumsum(v, out=s[1:])
    off = np.searchsorted(doc, np.arange(n + 1))
    return (s[off[1:]] - s[off[:-1]]).view(np.int64)


def _binary(a: np.ndarray) -> pa.Array:
    """One binary value for each row of a 2-d array."""
    width = a.shape[1] * a.itemsize
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(width), len(a), [None, pa.py_buffer(np.ascontiguousarray(a))]).cast(pa.binary())


def _sums(doc: np.ndarray, g: np.ndarray, n: int) -> list[np.ndarray]:
    """Two numbers that name a set."""
    return [_sum_by(doc, mix(g ^ U(c)), n) for c in (0x51ED270B, 0xB492B66F)]


def _sign(k: int, bands: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for rows, f in slices(b.column(2), lower=True):
                doc, g = shingle_sets(f, k)
                size, low = minima(doc, g, len(f), bands * ROWS, 0)
                part = b.slice(rows.start, len(f))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(size.astype(np.int64)), *map(pa.array, _sums(doc, g, len(f))), _binary(band_keys(low, bands))],
                    ["doc_id", "h", "n_shingles", "k1", "k2", "keys"],
                )

    return run


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each band key of a class."""
    for b in batches:
        size = b.column(1).cast(pa.binary())
        n = np.diff(np.frombuffer(size.buffers()[1], np.int32)[size.offset : size.offset + len(b) + 1]) // 8
        keys = np.frombuffer(b"".join(size.to_pylist()), np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(np.repeat(b.column(0).to_numpy(), n))], ["bucket", "cid"])


def _second(k: int):
    """Set size, second signature and set of each class, once where its rows come behind each other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for b in batches:
            cid = b.column(0).to_numpy()
            fresh = np.ones(len(cid), bool)
            fresh[1:] = cid[1:] != cid[:-1]
            if len(cid):
                fresh[0] = cid[0] != last
                last = cid[-1]
            b = b.filter(pa.array(fresh))
            for rows, f in slices(b.column(3), lower=True):
                part = b.slice(rows.start, len(f))
                doc, g = shingle_sets(f, k)
                size, low = minima(doc, g, len(f), VALUES, 0x1B873593)
                same = np.all([x == part.column(i).to_numpy() for i, x in zip((1, 2), _sums(doc, g, len(f)))], axis=0)  # else another text with the same hash
                off = np.searchsorted(doc, np.arange(len(f) + 1))
                sets = pa.array([g[i:j].tobytes() for i, j in zip(off[:-1], off[1:], strict=True)], pa.binary())
                out = pa.RecordBatch.from_arrays([part.column(0), pa.array(size.astype(np.int64)), _binary((low & 0xFF).astype(np.uint8)), sets], ["cid", "n", "sig", "hashes"])
                yield out.filter(pa.array(same))

    return run


def _deal(k_bands: int, rows: int):
    """Band keys of more rows from full sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, len(b), 64):
                part = b.slice(i, 64)
                sets = [np.frombuffer(x, U) for x in part.column(1).to_pylist()]
                doc = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
                _, low = minima(doc, np.concatenate(sets), len(sets), k_bands * rows, 0x7FEB352D + rows)
                yield pa.RecordBatch.from_arrays([part.column(0), _binary(band_keys(low, k_bands, rows))], ["cid", "keys"])

    return run


def _shortened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The last column's sets as sorted 32-bit hashes, none for very long ones."""
    for b in batches:
        sets = [np.unique((np.frombuffer(x, U) >> U(32)).astype(np.uint32)).tobytes() if len(x) <= 8 * LONG else b"" for x in b.column(b.num_columns - 1).to_pylist()]
        yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(sets, pa.binary())], b.schema.names)


def _matching(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray, least: list[int], percent: int) -> np.ndarray:
    """Which pairs survive: sizes may allow the threshold, and so may every batch of the signatures."""
    alive = np.flatnonzero(100 * np.minimum(na, nb) >= percent * np.maximum(na, nb))
    matches = np.zeros(len(b), np.int64)
    for lo in range(0, VALUES, BATCH):
        if not len(alive):
            break
        x = a[alive, lo : lo + BATCH] if len(a) == len(b) else a[:, lo : lo + BATCH]
        matches[alive] += (x == b[alive, lo : lo + BATCH]).sum(axis=1)
        alive = alive[matches[alive] >= least[lo + BATCH]]
    return alive


def _signs(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, VALUES)


def _prune(least: list[int], percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, len(b), 20_000):
                part = b.slice(i, 20_000)
                alive = _matching(_signs(part.column(2)), _signs(part.column(4)), part.column(3).to_numpy(), part.column(5).to_numpy(), least, percent)
                yield part.select([0, 1]).take(pa.array(alive))

    return run


def _cross(least: list[int], percent: int):
    """Pairs of different components between the queries and the targets of a block, by signatures and then by 32-bit hashes.

    As many hashes may be missing from an intersection as collide in the query's set, so pairs just below the threshold pass too; they are confirmed on the full sets.
    """

    def alike(q: np.ndarray, n: int, sets: list[np.ndarray], sizes: np.ndarray) -> np.ndarray:
        flat = np.concatenate(sets)
        at = np.minimum(np.searchsorted(q, flat), len(q) - 1)
        both = np.add.reduceat(q[at] == flat, np.cumsum([0] + [len(x) for x in sets[:-1]])) + (n - len(q))
        return 100 * both >= percent * (n + sizes - both)

    def block(rows: list[tuple]) -> tuple[list[int], list[int]]:
        bucket = rows[0][0]
        query = np.array([r[2] for r in rows]) == 1
        v, c, n = (np.array([r[i] for r in rows]) for i in (3, 4, 6))  # class, component, set size
        sig = np.frombuffer(b"".join(r[5] for r in rows), np.uint8).reshape(len(rows), -1)
        keys = np.frombuffer(b"".join(r[7] for r in rows), np.int64).reshape(len(rows), -1)
        targets = np.flatnonzero(~query)
        a, b = [], []
        for q in np.flatnonzero(query):
            other = targets[c[targets] != c[q]]
            if not len(other):
                continue
            x = other[_matching(sig[q : q + 1], sig[other], n[q], n[other], least, percent)]
            shared = keys[x] == keys[q]
            x = x[keys[q][shared.argmax(axis=1)] == bucket]  # else another bucket has the pair
            if len(rows[q][8]):
                sure = np.array([len(rows[i][8]) > 0 for i in x], bool)
                some = x[sure]
                if len(some):
                    some = some[alike(np.frombuffer(rows[q][8], np.uint32), n[q], [np.frombuffer(rows[i][8], np.uint32) for i in some], n[some])]
                x = np.concatenate([some, x[~sure]])
            a += np.minimum(v[q], v[x]).tolist()
            b += np.maximum(v[q], v[x]).tolist()
        return a, b

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        a: list[int] = []
        b: list[int] = []
        for batch in batches:
            for r in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if rows and r[:2] != rows[0][:2]:
                    more = block(rows)
                    a += more[0]
                    b += more[1]
                    rows = []
                    if len(a) > 20_000:
                        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["one", "other"])
                        a, b = [], []
                rows.append(r)
        if rows:
            more = block(rows)
            yield pa.RecordBatch.from_arrays([pa.array(a + more[0], pa.int64()), pa.array(b + more[1], pa.int64())], ["one", "other"])

    return run


def _confirm(percent: int):
    """Pairs whose full sets reach the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sure = []
            for x, y in zip(b.column(2), b.column(3), strict=True):
                p, q = np.frombuffer(x.as_buffer(), U), np.frombuffer(y.as_buffer(), U)
                both = np.count_nonzero(q[np.minimum(np.searchsorted(q, p), len(q) - 1)] == p)
                sure.append(100 * both >= percent * (len(p) + len(q) - both))
            yield b.select([0, 1]).filter(pa.array(sure, pa.bool_()))

    return run


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (one, other) that are links, as a and b. The sets of ``one`` go to those of ``other``, which may be in very many pairs."""
    one, other = (sets.select(F.col("cid").alias(c), F.col("hashes").alias(f"{c}_set")) for c in ("one", "other"))
    joined = pairs.join(one, "one").join(other, "other").select(F.least("one", "other").alias("a"), F.greatest("one", "other").alias("b"), "one_set", "other_set")
    return written(joined.mapInArrow(_confirm(percent), "a long, b long"), "links")


def _alike(pairs: DataFrame, sets: DataFrame, least: list[int], percent: int) -> DataFrame:
    """The pairs (one, other) that may be links by their signatures."""
    a, b = (sets.select(*(F.col(x).alias(f"{x}{i}") for x in ("cid", "sig", "n"))) for i in "ab")
    joined = pairs.join(a, F.col("one") == F.col("cida")).join(b, F.col("other") == F.col("cidb"))
    return joined.select("one", "other", "siga", "na", "sigb", "nb").mapInArrow(_prune(least, percent), "one long, other long")


def _distinct_pairs(pairs: DataFrame) -> DataFrame:
    """Each pair (one, other) once, whichever way round."""
    once = pairs.groupBy(F.least("one", "other").alias("a"), F.greatest("one", "other").alias("b")).agg(F.min("one").alias("one"))
    return once.select("one", (F.when(F.col("one") == F.col("a"), F.col("b")).otherwise(F.col("a"))).alias("other"))


def _cross_pairs(members: DataFrame, keys: DataFrame, sets: DataFrame, label: DataFrame, links: DataFrame, threshold: float, percent: int, miss: float, least: list[int]) -> DataFrame:
    """Links between different components of a bucket; members: bucket, cid; keys: cid and the band keys of the members' level."""
    rows, found = ROWS, None
    while True:
        m = members.join(label, F.col("cid") == F.col("v"), "left").select("bucket", "cid", F.coalesce("c", "cid").alias("c"))
        parts = m.groupBy("bucket", "c").agg(F.count("*").alias("n"))
        parts = parts.groupBy("bucket").agg(F.max(F.struct("n", "c")).alias("top"), F.sum("n").alias("m"), F.count("*").alias("parts")).where("parts > 1")
        parts = written(parts.select("bucket", F.col("top.c").alias("main"), "m", F.col("top.n").alias("top")), "parts")
        mixed = written(m.join(parts, "bucket"), "mixed")
        large = F.col("m") > BLOCK * BLOCKS
        last = rows == MOST_ROWS
        near = mixed if last else mixed.where(~large)
        # Two classes alone have no need of blocks; on the first level their bucket's central class was one of them.
        two = near.where("m = 2").groupBy("bucket").agg(F.min("cid").alias("one"), F.max("cid").alias("other"))
        two = _alike(two.select("one", "other").distinct(), sets, least, percent)
        near = near.where("m > 2").withColumn("queries", F.ceil((F.col("m") - F.col("top")) / BLOCK)).withColumn("targets", F.ceil(F.col("m") / BLOCK))
        place = lambda n: F.pmod(F.xxhash64("cid"), F.col(n))
        asked = near.where("c <> main").withColumn("t", F.explode(F.sequence(F.lit(0).cast("long"), F.col("targets") - 1))).withColumn("q", place("queries")).withColumn("query", F.lit(1))
        seen = near.withColumn("q", F.explode(F.sequence(F.lit(0).cast("long"), F.col("queries") - 1))).withColumn("t", place("targets")).withColumn("query", F.lit(0))
        blocks = asked.unionByName(seen).select("bucket", (F.col("q") * F.col("targets") + F.col("t")).alias("block"), "query", "cid", "c").join(sets, "cid").join(keys, "cid")
        blocks = blocks.select("bucket", "block", "query", "cid", "c", "sig", "n", "keys", "hashes")
        blocks = blocks.mapInArrow(_shortened, blocks.schema).repartition("bucket", "block").sortWithinPartitions("bucket", "block")
        more = blocks.mapInArrow(_cross(least, percent), "one long, other long")
        more = written((more if rows == ROWS else more.unionByName(two)).distinct(), "cross-pairs")
        if not more.isEmpty():
            sure = _confirmed(more, sets, percent)
            if not sure.isEmpty():
                found = sure if found is None else found.unionByName(sure)
        remove(parts, mixed if last else None, more)
        if last:
            return found
        again = mixed.where(large).select("cid").distinct()
        if again.isEmpty():
            remove(mixed)
            return found
        if found is not None:
            label = components(links.unionByName(found))
        rows = min(2 * rows, MOST_ROWS)
        bands = n_bands(threshold, miss, rows)
        keys = written(sets.join(again, "cid").select("cid", "hashes").mapInArrow(_deal(bands, rows), "cid long, keys binary"), "deeper-keys")
        remove(mixed)
        members = keys.mapInArrow(_bands, "bucket long, cid long")


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, miss: float = 1e-6, text: str = "text", made: list[DataFrame] | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of each row. made: takes the tables that the result reads, to be deleted after it."""
    prepare(docs.sparkSession)
    threshold = percent / 100
    bands = n_bands(threshold, miss)
    least = least_matches(threshold, miss, VALUES)
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("h"), F.col(text).alias("text"))
    signed = written(source.mapInArrow(_sign(k, bands), "doc_id long, h long, n_shingles long, k1 long, k2 long, keys binary"), "signatures")
    same = ["k1", "k2", "n_shingles"]
    filled = signed.where("n_shingles > 0")
    classes = filled.groupBy(*same, "keys").agg(F.min("doc_id").alias("v"), F.min_by("h", "doc_id").alias("h")).where(F.col("v").isNotNull())
    # Written, so that the numbers stay.
    classes = written(classes.withColumn("cid", F.monotonically_increasing_id()), "classes")

    members = classes.select("cid", "keys").mapInArrow(_bands, "bucket long, cid long")
    sizes = written(members.groupBy("bucket").agg(F.count("*").alias("m")).where("m > 1"), "buckets")
    members = written(members.join(sizes, "bucket"), "members")
    central = written(members.groupBy("cid").agg(F.sum("m").alias("central")), "central")
    center = members.join(central, "cid").groupBy("bucket").agg((-F.max(F.struct("central", (-F.col("cid")).alias("cid")))["cid"]).alias("center"))
    centers = written(center, "centers")
    pairs = _distinct_pairs(members.join(centers, "bucket").where("cid <> center").select(F.col("cid").alias("one"), F.col("center").alias("other")))

    # The texts are dealt out once, one row for each class that shares a bucket, and in the same way whatever the sizes.
    chosen = classes.join(central.select("cid"), "cid").select(F.col("v").alias("doc_id"), "h", "cid", "k1", "k2")
    sets = source.where(F.col("doc_id").isNotNull()).join(chosen.hint("merge"), ["doc_id", "h"]).select("cid", "k1", "k2", "text").mapInArrow(_second(k), "cid long, n long, sig binary, hashes binary")
    stored = written(sets.withColumn("row", F.monotonically_increasing_id()), "sets")
    sets = _one_each(stored)
    pairs = written(_alike(pairs, sets, least, percent), "pairs")
    links = _confirmed(pairs, sets, percent)
    # A document with several texts links their classes.
    several = filled.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(*[f(c).alias(f"{f.__name__}_{c}") for c in same for f in (F.min, F.max)]).where(" or ".join(f"min_{c} <> max_{c}" for c in same))
    several = written(several.select("doc_id"), "several-texts")
    if not several.isEmpty():
        own = filled.join(several, "doc_id").select("doc_id", *same).distinct().join(classes.select(*same, "cid"), same).select("doc_id", "cid")
        first = own.groupBy("doc_id").agg(F.min("cid").alias("first"))
        links = written(links.unionByName(own.join(first, "doc_id").where("cid <> first").select(F.col("first").alias("a"), F.col("cid").alias("b")).distinct()), "all-links")
    label = components(links)

    more = _cross_pairs(members.where("m > 2").select("bucket", "cid"), classes.select("cid", "keys"), sets, label, links, threshold, percent, miss, least)
    if more is not None:
        label = components(links.unionByName(more))
    remove(sizes, members, central, centers, stored, pairs, several)

    names = label.withColumnRenamed("v", "cid").join(classes.select("cid", F.col("v").alias("name")), "cid")
    named = names.groupBy("c").agg(F.min("name").alias("component_id"))
    names_table = written(names.select("cid", "c").join(named, "c").select("cid", "component_id"), "names")
    remove(links)
    named = classes.select(*same, "cid", "v").join(names_table, "cid", "left").select(*(F.col(c).alias(f"of_{c}") for c in same), F.coalesce("component_id", "v").alias("c"))
    if made is not None:
        made += [signed, classes, names_table]
    joined = signed.drop("keys", "h").join(named, [F.col(c) == F.col(f"of_{c}") for c in same], "left")
    return joined.select("doc_id", "n_shingles", F.coalesce("c", "doc_id").alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))


def _one_each(sets: DataFrame) -> DataFrame:
    """One row for each class. Rows that came from several tasks, of which a class has a few if one of its texts is in very many rows, are the exception."""
    again = written(sets.groupBy("cid").agg(F.min("row").alias("first"), F.count("*").alias("rows")).where("rows > 1").select(F.col("cid").alias("of"), "first"), "sets-again")
    if not again.isEmpty():
        sets = written(sets.join(again, F.col("cid") == F.col("of"), "left").where(F.col("first").isNull() | (F.col("row") == F.col("first"))).drop("of", "first"), "sets-once")
    return sets.drop("row")


def drop_near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, miss: float = 1e-6, text: str = "text") -> DataFrame:
    """The rows of docs, all columns, with one document of each component. Rows with null doc_id stay: nothing names them."""
    made: list[DataFrame] = []
    verdict = written(near_duplicates(docs, k, percent, miss, text, made), "verdicts").where(F.col("doc_id").isNotNull())
    remove(*made)
    gone = written(verdict.where(~F.col("kept")).select(F.col("doc_id").alias("__gone")).distinct(), "gone")
    out = docs.join(gone, F.col("doc_id") == F.col("__gone"), "left_anti")
    again = written(verdict.groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias("__again")), "repeated-ids")
    if again.isEmpty():
        return out
    repeated = F.col("doc_id") == F.col("__again")
    return out.join(again, repeated, "left_anti").unionByName(out.join(again, repeated, "left_semi").dropDuplicates(["doc_id"]))
