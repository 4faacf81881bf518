"""Token counts through a digest cache.

A text's digest is the SHA-256 of its normalised content: for a file whose
tokenizer provably drops white space (``drops_space``), runs of ASCII white space become one space and
the ends are trimmed; for all others the content stays as it is.  Digests are joined to the counts stored for
this tokenizer (its file and the library's version have a digest too); only
distinct misses are encoded and then appended to the cache, a Parquet folder.

Within the encoding step a worker remembers counts of white-space separated
chunks if the tokenizer drops white space: a text's count is then the sum of
its chunks' counts, each as the library gives it.  Texts for other files are encoded whole.

Defined cases: null counts as empty (0 tokens, 0 bytes); repeated rows each get
a row, encoded once; an empty table gives an empty table; an absent cache is
created; further columns of the input are not read.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import prepare, written

CACHE = "tokenizer string, digest binary, n_tokens long"
#: Chunks that a worker remembers at most.
MEMO = 400_000
_WHITE = "[\\t\\n\\x0B\\f\\r ]+"


# What a tokenizer file may hold without seeing white space. Normalizers that work on letters and their marks;
# steps that cut at white space and drop it; patterns of words that do the same, no match of which can hold any.
LOCAL_NORMALIZERS = frozenset(("NFC", "NFD", "NFKC", "NFKD", "Lowercase", "StripAccents"))
SPLITTERS = frozenset(("Whitespace", "WhitespaceSplit", "BertPreTokenizer"))
WORD_PATTERNS = frozenset((r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+",))


def _steps(part: dict | None, name: str) -> list[dict]:
    """The steps of a normalizer or pre-tokenizer, sequences laid flat."""
    if part is None:
        return []
    return [x for p in part[name] for x in _steps(p, name)] if part["type"] == "Sequence" else [part]


def drops_space(file: bytes) -> bool:
    """Whether a tokenizer file counts a text as the sum of its white-space separated chunks; False wherever that is not sure."""
    spec = json.loads(file)
    for n in _steps(spec.get("normalizer"), "normalizers"):
        folds = n["type"] == "Replace" and n["pattern"] == {"Regex": "\\s+"} and n["content"] == " "
        if n["type"] not in LOCAL_NORMALIZERS and not folds:
            return False
    first = (_steps(spec.get("pre_tokenizer"), "pretokenizers") or [{"type": None}])[0]
    words = first["type"] == "Split" and first["behavior"] == "Removed" and first["invert"] and first["pattern"].get("Regex") in WORD_PATTERNS
    plain = all(not (t["lstrip"] or t["rstrip"] or t["single_word"]) and not re.search(r"\s", t["content"]) for t in spec.get("added_tokens", []))
    return (words or first["type"] in SPLITTERS) and plain


class TextCounter:
    """Counts the tokens of whole texts as ``tokenizers`` does."""

    def __init__(self, file: bytes):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(file.decode())
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()

    def count(self, text: str) -> int:
        return len(self.tokenizer.encode(text, add_special_tokens=False).ids)


class WordCounter(TextCounter):
    """The same by chunks, for a file whose tokenizer drops white space."""

    def __init__(self, file: bytes):
        super().__init__(file)
        self.memo: dict[bytes, int] = {}
        self.old: dict[bytes, int] = {}

    def count(self, text: str) -> int:
        chunks = text.encode().split()
        try:
            return sum(map(self.memo.__getitem__, chunks))
        except KeyError:
            pass
        if len(self.memo) > MEMO:
            self.old, self.memo = self.memo, {}
        memo, new, extra = self.memo, [], {}
        for c in set(chunks):
            if c not in memo:
                if (n := self.old.get(c)) is None:
                    new.append(c)
                else:
                    memo[c] = n
        for c, e in zip(new, self.tokenizer.encode_batch_fast([c.decode() for c in new], add_special_tokens=False), strict=True):
            (memo if len(c) <= 64 else extra)[c] = len(e)
        return sum(memo[c] if c in memo else extra[c] for c in chunks)


_loaded: dict[str, TextCounter] = {}


def loaded(key: str, file: bytes) -> TextCounter:
    if key not in _loaded:
        _loaded[key] = (WordCounter if drops_space(file) else TextCounter)(file)
    return _loaded[key]


def tokenizer_digest(file: bytes) -> str:
    import tokenizers

    return hashlib.sha256(tokenizers.__version__.encode() + b"\0" + file).hexdigest()


class Recent:
    """A set that forgets the older half once it holds ``MEMO`` entries, so a task's memory does not grow with its rows."""

    def __init__(self) -> None:
        self.now: set[bytes] = set()
        self.old: set[bytes] = set()

    def add(self, x: bytes) -> bool:
        """Whether x is new, as far as remembered."""
        if x in self.now or x in self.old:
            return False
        if len(self.now) >= MEMO // 2:
            self.now, self.old = set(), self.now
        self.now.add(x)
        return True


def _first_of_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Drops what this task has seen of late before the shuffle, so that a hot text is sent once a task."""
    seen = Recent()
    for b in batches:
        yield b.take(pa.array([i for i, d in enumerate(b.column(0).to_pylist()) if seen.add(d)], pa.int64()))


def count_tokens(docs: DataFrame, tokenizer: str, cache: str, text: str = "text", limit: int = 2048) -> DataFrame:
    """Per row: doc_id, n_bytes, n_tokens and whether there are more than ``limit`` tokens."""
    spark = docs.sparkSession
    prepare(spark)
    with open(tokenizer, "rb") as f:
        file = f.read()
    key, sent = tokenizer_digest(file), spark.sparkContext.broadcast(file)  # as large as the tokenizer's file

    content = F.coalesce(F.col(text), F.lit(""))
    seen = F.trim(F.regexp_replace(content, _WHITE, " ")) if drops_space(file) else content
    digested = docs.select("doc_id", F.octet_length(content).cast("long").alias("n_bytes"), F.unhex(F.sha2(seen.cast("binary"), 256)).alias("digest"), content.alias("content"))
    rows = written(digested.drop("content"), "token-keys")
    spark.createDataFrame([], CACHE).write.mode("append").parquet(cache)
    known = spark.read.schema(CACHE).parquet(cache).where(F.col("tokenizer") == key)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter, done = loaded(key, sent.value), Recent()
        for b in batches:
            digests, n = [], []
            for d, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                if done.add(d):
                    digests.append(d)
                    n.append(counter.count(t.as_py()))
            yield pa.RecordBatch.from_arrays([pa.array([key] * len(n), pa.string()), pa.array(digests, pa.binary()), pa.array(n, pa.int64())], ["tokenizer", "digest", "n_tokens"])

    misses = digested.select("digest", "content")
    if not known.isEmpty():
        misses = misses.join(known.select("digest").distinct(), "digest", "left_anti")
    misses = misses.mapInArrow(_first_of_task, misses.schema).repartition("digest")
    misses.mapInArrow(encode, CACHE).write.mode("append").parquet(cache)

    counts = spark.read.schema(CACHE).parquet(cache).where(F.col("tokenizer") == key).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))
    # Written, so that the join deals it anew and can split the rows of a hot digest.
    return rows.join(written(counts, "token-counts"), "digest").select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
