"""Word kernels, rules, token counts, byte-level BPE and toxicity against plain versions."""

import base64
import hashlib
import itertools
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sieveline.llm import bpe, quality_rules, toxicity
from sieveline.llm.store import new_path
from sieveline.llm.text import Flat, slices
from sieveline.llm.token_counts import count_tokens

from .conftest import doc, rows

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TEXT = st.text(alphabet=st.sampled_from(list("ab #|\n\t é😀.")), max_size=60)


def rules(t):
    w = WORD.findall(t or "")
    seen, dup = set(), 0
    for line in (t or "").split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    g = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    cover = {j for i in range(len(w) - 4) if g[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    return [len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), dup, len(cover)]


@settings(deadline=None, max_examples=60)
@given(st.lists(st.one_of(st.none(), TEXT), min_size=1, max_size=8))
def test_rule_counts(texts):
    got = []
    for _, f in slices(pa.array(texts, pa.string()), most=40):
        got += [list(x) for x in zip(*(v.tolist() for v in quality_rules.counts(f).values()), strict=True)]
    assert got == [rules(t) for t in texts]


def test_hashes_tell_words_apart():
    f = Flat.of(["ab ba ab", "ab", "a b"])
    h = f.word_hash.tolist()
    assert h[0] == h[2] == h[3] and len(set(h)) == 4


def test_host_rules(spark, odd, none):
    got = {r.doc_id: r for r in quality_rules.host_rules(odd).collect() if r.doc_id}
    assert got[3].n_words == 0 and got[3].base_failed and got[11].base_failed and not got[1].base_failed
    assert quality_rules.host_rules(odd).count() == odd.count() and quality_rules.host_rules(none).count() == 0
    good = "the quick brown fox jumps over a lazy dog and runs far away home"
    many = [doc(i, good + f" {i}", "good") for i in range(40)] + [doc(100 + i, "bad", "bad") for i in range(39)] + [doc(139, good, "bad")]
    verdict = {r.doc_id: r for r in quality_rules.host_rules(spark.createDataFrame(many, odd.schema)).collect()}
    assert all(verdict[i].kept for i in range(40)) and not verdict[139].base_failed and not verdict[139].kept


@pytest.fixture(scope="module")
def coder():
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    ranks = bpe.read_ranks(path)
    import tiktoken

    return bpe.Bpe(ranks, public_tokenizers.PATTERN), tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@settings(deadline=None, max_examples=200)
@given(text=st.one_of(st.text(max_size=40), st.text(alphabet="abeinrst", max_size=60), st.text(alphabet=" \n\t!?a1", max_size=30)))
def test_bpe_is_exact(coder, text):
    mine, theirs = coder
    ids = mine.encode(text)
    assert ids == theirs.encode_ordinary(text) and mine.decode(ids) == text.encode()


@pytest.mark.parametrize("text", ["a" * 3000, "antidisestablishmentarianism" * 80, "日本語" * 200, " " * 500, "\x00\x7f", "👩‍👩‍👧‍👦"])
def test_bpe_on_hard_texts(coder, text):
    assert coder[0].encode(text) == coder[1].encode_ordinary(text)


def test_bpe_tables(spark, odd, none, coder):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    out = bpe.encode_table(odd, path, public_tokenizers.PATTERN, ids=True)
    for r in out.join(odd.select("doc_id", "text").distinct(), "doc_id").collect():
        t = (r.text or "").encode()
        assert r.ids == coder[1].encode_ordinary(t.decode()) and r.n_tokens == len(r.ids) and r.decoded_sha256 == hashlib.sha256(t).hexdigest()
        assert r.ids_sha256 == hashlib.sha256(np.array(r.ids, "<u4").tobytes()).hexdigest()
    assert out.count() == odd.count() and bpe.encode_table(none, path, public_tokenizers.PATTERN).count() == 0
    back = bpe.decode_table(out, path, public_tokenizers.PATTERN).join(odd.select("doc_id", "text").distinct(), "doc_id").collect()
    assert all(bytes(r.decoded) == (r.text or "").encode() for r in back)
    assert base64.b64encode(coder[0].bytes[0]) and len(coder[0].ids) == 50_256


def test_token_counts(spark, odd, none):
    from tokenizers import Tokenizer

    path, cache = public_tokenizers.path("word_bpe_49k.json"), new_path(spark, "test-cache")
    library = Tokenizer.from_file(path)
    more = spark.createDataFrame([doc(50, "İstanbul ΣΑΣ ﬁ <|endoftext|>x é a b\x1cc d"), doc(51, " one  two\nthree four five six seven eight nine ten eleven "), doc(52, "don't 123 !!! 日本")], odd.schema)
    docs = odd.unionByName(more)
    want = sorted((r.doc_id is None, r.doc_id or 0, len((r.text or "").encode()), n := len(library.encode(r.text or "", add_special_tokens=False).ids), n > 2048) for r in docs.collect())
    for _ in range(2):  # without and with a filled cache
        got = sorted((r.doc_id is None, r.doc_id or 0, r.n_bytes, r.n_tokens, r.over_limit) for r in count_tokens(docs, path, cache).collect())
        assert got == want
    stored = spark.read.parquet(cache)
    assert stored.count() == stored.select("digest").distinct().count() < docs.count()
    assert count_tokens(none, path, new_path(spark, "test-cache")).count() == 0


def test_token_counts_of_tokenizers_that_keep_white_space(spark, odd):
    """A byte-level file sees white space, so texts are encoded whole and digests are those of the raw texts."""
    from tokenizers import Tokenizer

    from sieveline.llm.token_counts import drops_space

    path, words = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
    assert drops_space(open(words, "rb").read()) and not drops_space(open(path, "rb").read())
    library = Tokenizer.from_file(path)
    docs = odd.unionByName(spark.createDataFrame([doc(50, "a  b"), doc(51, "a b"), doc(52, " a b\n\n"), doc(53, "a <|endoftext|>b")], odd.schema))
    got = {(r.doc_id, r.n_bytes, r.n_tokens) for r in count_tokens(docs, path, new_path(spark, "test-cache")).collect()}
    assert got == {(r.doc_id, len((r.text or "").encode()), len(library.encode(r.text or "", add_special_tokens=False).ids)) for r in docs.collect()}


def test_what_a_task_remembers_is_bounded(monkeypatch):
    from sieveline.llm import token_counts

    monkeypatch.setattr(token_counts, "MEMO", 10)
    r = token_counts.Recent()
    assert [r.add(x) for x in (b"a", b"a", b"b")] == [True, False, True]
    for i in range(100):
        r.add(b"%d" % i)
    assert len(r.now) + len(r.old) <= 10 and r.add(b"a")


def test_marginals_are_exact():
    rng = np.random.default_rng(0)
    f = toxicity.Field(np.array([1, 2, 3]), np.array([2.0, -1.0, 0.5]), -1.5, rng.normal(size=(2, 2)))
    for _ in range(20):
        n = int(rng.integers(1, 8))
        h = rng.integers(1, 7, n)
        w = [(f.weight[x - 1] if x < 4 else f.rest) + f.rest for x in h]
        z, p = 0.0, np.zeros(n)
        for y in itertools.product((0, 1), repeat=n):
            s = np.exp(sum(w[i] * y[i] for i in range(n)) + sum(f.step[y[i], y[i + 1]] for i in range(n - 1)))
            z, p = z + s, p + s * np.array(y)
        at, got = f.marginals(np.stack([h, h + 100], axis=1), np.array([0, n]))
        assert np.allclose(got, p[at] / z)


def test_toxicity(spark, odd, none):
    rng = np.random.default_rng(3)
    plain = [f"{a}{b}{c}" for a in "bdfgk" for b in "aeiou" for c in "lmnr"]
    data, labels = [], []
    for i in range(600):
        w = list(rng.choice(plain, 30))
        if i % 3 == 0:
            for _ in range(3):
                w.insert(int(rng.integers(31)), str(rng.choice(["idiot", "Moron,", "scum"])))
        data.append(doc(1000 + i, " ".join(w)))
        labels.append((1000 + i, 1, int(i % 3 == 0)))
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    docs = odd.unionByName(spark.createDataFrame(data, odd.schema))
    out = toxicity.score_toxicity(docs, table).collect()
    assert len(out) == docs.count() and all(0 <= r.score <= 1 for r in out)
    truth = {i: t for i, _, t in labels}
    assert all(r.predicted == truth[r.doc_id] for r in out if r.doc_id in truth)
    text = {d[0]: d[1] for d in data}
    for r in out:
        if truth.get(r.doc_id):
            assert {text[r.doc_id][s.start : s.end].lower() for s in r.spans} <= {"idiot", "moron", "scum"} and r.spans
    assert toxicity.score_toxicity(none, table).count() == 0
    assert {r.score < 0.01 for r in toxicity.score_toxicity(odd, table.limit(0)).collect()} == {True}
    assert rows(toxicity.score_toxicity(odd, table).select("doc_id")) == rows(odd.select("doc_id"))


def test_one_huge_text_leaves_the_rest_of_the_sample(spark, odd):
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(200)], "doc_id long, quality int, toxic int")
    known = toxicity.labelled(labels, "toxic", 5, 0).orderBy(toxicity.F.xxhash64("id")).first().id
    texts = [doc(i, "word " * 9_000 if i == known else "plain words " * 5 + ("scum" if i % 2 else "")) for i in range(200)]
    field = toxicity.train(spark.createDataFrame(texts, odd.schema), labels, most_words=5_000)
    assert field.doc[0] != -30  # as without any row
