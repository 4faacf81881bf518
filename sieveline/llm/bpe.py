"""Byte-level BPE encoding and decoding.

Bytes are mapped to Latin-1 so that an Aho-Corasick automaton (pyahocorasick)
can hold the vocabulary.  A piece is encoded by a walk over longest matches: a
token may follow another only if merging their joined bytes gives just these
two tokens again, which is looked up in a memo; where no token fits, the walk
steps back to the next shorter match.  Ends from which no way led on are
remembered, so each position is left at most once and the time is linear.  A
sequence all of whose neighbours are compatible is the one that the merges
give.

Defined cases: null counts as empty; an empty text has no ids; repeated rows
stay; pieces of any length work; further columns of the input are not read.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from itertools import accumulate

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from .store import prepare

#: Entries that a worker's memos of pieces and of token pairs hold at most; older ones are computed anew.
MEMO = 200_000


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class Bpe:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.pattern = regex.compile(pattern)
        self.ids = {k.decode("latin-1"): v for k, v in ranks.items()}
        self.bytes = {v: k for k, v in ranks.items()}
        self.text = {v: k for k, v in self.ids.items()}
        self.trie = ahocorasick.Automaton(ahocorasick.STORE_LENGTH)
        for k in self.ids:
            self.trie.add_word(k)
        self.longest = max(map(len, self.ids))
        self.shorter: dict[int, int] = {}
        self.pairs: dict[tuple[int, int], bool] = {}
        self.memo: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def match(self, s: str, at: int) -> int:
        """The longest token at a position; every single byte is one."""
        n = self.trie.longest_prefix(s[at : at + self.longest])
        while s[at : at + n] not in self.ids:  # the walk in the trie may end between tokens
            n -= 1
            if n <= 0:
                raise ValueError(f"no token for byte {ord(s[at])}")
        return self.ids[s[at : at + n]]

    def next_shorter(self, token: int) -> int:
        """The longest token that is a proper prefix of this one, else -1."""
        got = self.shorter.get(token)
        if got is None:
            s = self.text[token]
            got = next((self.ids[s[:n]] for n in range(len(s) - 1, 0, -1) if s[:n] in self.ids), -1)
            self.shorter[token] = got
        return got

    def merged(self, s: str) -> list[str]:
        """Plain merging by rank, for the few bytes of a pair of tokens."""
        parts = list(s)
        while len(parts) > 1:
            rank, k = min((self.ids.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
            if rank == 1 << 60:
                break
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return parts

    def compatible(self, a: int, b: int) -> bool:
        got = self.pairs.get((a, b))
        if got is None:
            if len(self.pairs) > MEMO:
                self.pairs.clear()
            x, y = self.text[a], self.text[b]
            got = self.pairs[a, b] = self.merged(x + y) == [x, y]
        return got

    def encode_piece(self, s: str) -> list[int]:
        """Ids of a piece given as Latin-1."""
        if (whole := self.ids.get(s)) is not None:
            return [whole]
        out: list[int] = []
        starts: list[int] = []
        dead: set[int] = set()
        at, end = 0, len(s)
        token = self.match(s, 0)
        while True:
            to = at + len(self.text[token])
            if to not in dead and (not out or self.compatible(out[-1], token)):
                out.append(token)
                starts.append(at)
                if to == end:
                    return out
                at = to
                token = self.match(s, at)
                continue
            token = self.next_shorter(token)
            while token < 0:
                dead.add(at)
                at = starts.pop()
                token = self.next_shorter(out.pop())

    def packed(self, text: str) -> bytes:
        """Ids of a text as little-endian 32-bit integers."""
        pieces = self.pattern.findall(text)
        try:
            return b"".join(map(self.memo.__getitem__, pieces))
        except KeyError:
            pass
        if len(self.memo) > MEMO:
            self.old, self.memo = self.memo, {}
        extra: dict[str, bytes] = {}  # pieces of this text, held apart so that a text of any size fits
        memo, old = self.memo, self.old
        for p in set(pieces):
            if p not in memo:
                got = old.get(p)
                if got is None:
                    got = b"".join(i.to_bytes(4, "little") for i in self.encode_piece(p.encode().decode("latin-1")))
                if len(p) <= 64:
                    memo[p] = got
                else:
                    extra[p] = got
        if extra:
            return b"".join(memo[p] if p in memo else extra[p] for p in pieces)
        return b"".join(map(memo.__getitem__, pieces))

    def encode(self, text: str) -> list[int]:
        return memoryview(self.packed(text)).cast("I").tolist()

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids))


_loaded: dict[str, Bpe] = {}


def loaded(key: str, ranks: dict[bytes, int], pattern: str) -> Bpe:
    """One per worker process and vocabulary."""
    if key not in _loaded:
        _loaded[key] = Bpe(ranks, pattern)
    return _loaded[key]


def with_bpe(spark: SparkSession, path: str, pattern: str):
    """A function that gives the encoder on an executor. The broadcast is as large as the vocabulary file, not as the data."""
    ranks = read_ranks(path)
    sent = spark.sparkContext.broadcast(ranks)
    key = hashlib.sha256(repr((sorted(ranks.items()), pattern)).encode()).hexdigest()
    return lambda: loaded(key, sent.value, pattern)


def encode_table(docs: DataFrame, path: str, pattern: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), ids: bool = False) -> DataFrame:
    """Per row: the columns ``keep``, the number of ids, digests of ids and of the decoded bytes, and the ids if asked for."""
    prepare(docs.sparkSession)
    get = with_bpe(docs.sparkSession, path, pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = get()
        for batch in batches:
            for at in range(0, len(batch), 256):
                b = batch.slice(at, 256)
                n, of_ids, of_bytes, all_ids = [], [], [], []
                for x in b.column(b.num_columns - 1):
                    packed = bpe.packed(x.as_py() or "")
                    n.append(len(packed) // 4)
                    of_ids.append(hashlib.sha256(packed).hexdigest())
                    of_bytes.append(hashlib.sha256(bpe.decode(memoryview(packed).cast("I").tolist())).hexdigest())
                    if ids:
                        all_ids.append(packed)
                cols = [*b.columns[:-1], pa.array(n, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_bytes, pa.string())]
                names = [*b.schema.names[:-1], "n_tokens", "ids_sha256", "decoded_sha256"]
                if ids:
                    flat = pa.Array.from_buffers(pa.int32(), sum(n), [None, pa.py_buffer(b"".join(all_ids))])
                    cols.append(pa.ListArray.from_arrays(pa.array(list(accumulate(n, initial=0)), pa.int32()), flat))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(cols, names)

    kept = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    more = ", ids array<int>" if ids else ""
    return docs.select(*keep, docs[text].alias("__text")).mapInArrow(run, f"{kept}, n_tokens long, ids_sha256 string, decoded_sha256 string{more}")


def decode_table(encoded: DataFrame, path: str, pattern: str, ids: str = "ids", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Per row: the columns ``keep`` and the bytes that the ids stand for (null ids: null)."""
    get = with_bpe(encoded.sparkSession, path, pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = get()
        for b in batches:
            out = [None if x is None else bpe.decode(x) for x in b.column(b.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(out, pa.binary())], [*b.schema.names[:-1], "decoded"])

    kept = ", ".join(f"`{c}` {encoded.schema[c].dataType.simpleString()}" for c in keep)
    return encoded.select(*keep, encoded[ids].alias("__ids")).mapInArrow(run, f"{kept}, decoded binary")
