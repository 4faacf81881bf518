"""Toxic spans by a linear-chain conditional random field.

Tokens are words without their outer punctuation, lower-cased.  Labels
are given for documents only, so token labels for training come from them:
words that occur in a far larger share of toxic than of other documents are
tagged in the toxic ones, all other tokens are not.  The field has two tags,
a weight for each word and each prefix of four characters that it learned (all
others share one) and the four transitions; it is fitted to windows around learned words and to plain
windows by gradient ascent on the likelihood, gradients coming from
forward-backward marginals.

Scoring is exact over whole texts: tokens without a weight of their own all
have the same factor, so a stretch of them is a power of one 2 x 2 matrix, in
closed form, and only the other tokens are stepped through.  A document's
score is a logistic function of its marginals (their sum, largest, and share
of the words).

The field is fitted on the driver to a bounded sample of labelled rows:
``sample`` (6,000 unless told otherwise; of at most ``most_words`` words
together), half of them toxic where there are so many, with the smallest hashes
of doc_id.  From these, at most ``most_weights`` words and as many prefixes get weights
and at most ``most_windows`` windows are fitted to.  Everything else covers all rows.

Defined cases: null counts as empty, and empty texts get a score like others;
a null doc_id is not held out and never a training row; repeated labels of a
document count once (the largest); without labelled rows of both kinds all
scores are the toxic share, 0 if there are none; repeated rows each get a row;
further columns of the input are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .quality_gbt import held_out, labelled
from .store import prepare, written
from .text import Flat, U, folded, mix, rolled, slices

HALF, PREFIX = 6, 4
_INNER = np.ones(256, bool)
_INNER[list(b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~ \t\n\v\f\r")] = False


def tokens(f: Flat) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes (of the word, and of its prefix), start and end of each word, without outer punctuation (a word of nothing else stays whole)."""
    start, end = f.words
    inner = _INNER[f.buf]
    places = np.append(np.flatnonzero(inner), len(f.buf))
    a = places[np.searchsorted(places, start)]
    back = np.flatnonzero(inner)
    k = np.searchsorted(back, end) - 1
    b = np.where(k >= 0, back[np.maximum(k, 0)] + 1 if len(back) else 0, 0)
    plain = (a >= end) | (b <= start)
    a, b = np.where(plain, start, a), np.where(plain, end, b)
    first = (f.buf & 0xC0) != 0x80  # of code points
    starts = np.append(np.flatnonzero(first), [len(f.buf)] * PREFIX)
    count = np.zeros(len(f.buf) + 1, np.int64)
    np.cumsum(first, out=count[1:])
    c = np.minimum(starts[np.minimum(count[a] + PREFIX, len(starts) - 1)], b)
    return np.stack([f.hashes(a, b), f.hashes(a, c) ^ U(0x5DEECE66D)], axis=1).view(np.int64), a, b


@dataclass
class Field:
    """words: sorted hashes; weight: their emission towards the toxic tag; rest: that of all other words; step: log transitions."""

    words: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    weight: np.ndarray = field(default_factory=lambda: np.zeros(0))
    rest: float = -3.0
    step: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))
    doc: np.ndarray = field(default_factory=lambda: np.zeros(5))

    def known(self, h: np.ndarray) -> np.ndarray:
        """Numbers of the hashes in ``words``, or -1."""
        if not len(self.words):
            return np.full(h.shape, -1)
        k = np.minimum(np.searchsorted(self.words, h), len(self.words) - 1)
        return np.where(self.words[k] == h, k, -1)

    def power(self, gap: np.ndarray) -> np.ndarray:
        """M**gap up to a factor, for M = transition times the factor of an unknown word."""
        m = np.exp(self.step) * np.array([1.0, np.exp(2 * self.rest)])
        mean, det = (m[0, 0] + m[1, 1]) / 2, m[0, 0] * m[1, 1] - m[0, 1] * m[1, 0]
        root = np.sqrt(max(mean * mean - det, 1e-300))
        l1, l2 = mean + root, mean - root
        first = (m - l2 * np.eye(2)) / (l1 - l2)
        return first + (l2 / l1) ** gap[:, None, None] * (np.eye(2) - first)

    def marginals(self, h: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the known words and the toxic tag's marginal at each; off: first token of each document."""
        k = self.known(h)
        at = np.flatnonzero((k >= 0).any(axis=1))
        if not len(at):
            return at, np.zeros(0)
        weight = np.append(self.weight, self.rest)  # an unknown hash has the place -1
        e = np.stack([np.ones(len(at)), np.exp(weight[k[at]].sum(axis=1))], axis=1)
        doc = np.searchsorted(off, at, "right") - 1
        first = np.searchsorted(at, off)
        before = np.diff(at, prepend=0) - 1
        start = np.zeros(len(at), bool)
        start[first[:-1][first[:-1] < first[1:]]] = True
        before[start] = at[start] - off[doc[start]]
        after = off[doc + 1] - 1 - at
        move = np.exp(self.step)
        n = np.diff(first)
        deep = np.argsort(-n, kind="stable")  # documents in step with each other, those with most known words first
        n, head, tail = n[deep], first[:-1][deep], first[1:][deep]
        alpha, beta = np.ones((len(at), 2)), np.ones((len(at), 2))
        unknown = np.array([1.0, np.exp(2 * self.rest)])
        # The first token has no transition; a stretch before the first known word starts with an unknown one.
        lead = np.where((before == 0)[:, None], 1.0, np.einsum("j,njk,kl->nl", unknown, self.power(np.maximum(before - 1, 0)), move))
        through = np.einsum("njk,kl->njl", self.power(before), move)
        ends = self.power(after).sum(axis=2)
        for i in range(int(n[0])):
            live = int(np.searchsorted(-n, -i, "left"))
            p = head[:live] + i
            a = lead[p] if i == 0 else np.einsum("nj,njk->nk", alpha[p - 1], through[p])
            a = a * e[p]
            alpha[p] = a / a.sum(axis=1, keepdims=True)
        for i in range(int(n[0])):
            live = int(np.searchsorted(-n, -i, "left"))
            p = tail[:live] - 1 - i
            if i == 0:
                b = ends[p]
            else:
                b = np.einsum("njk,nk->nj", through[p + 1], e[p + 1] * beta[p + 1])
            beta[p] = b / b.sum(axis=1, keepdims=True)
        both = alpha * beta
        return at, both[:, 1] / both.sum(axis=1)

    def summary(self, h: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Per document: 1, log of the summed marginals, the largest, log of the words, share of toxic words."""
        at, p = self.marginals(h, off)
        doc = np.searchsorted(off, at, "right") - 1
        n = len(off) - 1
        total, top = np.bincount(doc, p, n), np.zeros(n)
        np.maximum.at(top, doc, p)
        words = np.diff(off)
        return np.stack([np.ones(n), np.log1p(total), top, np.log1p(words) / 10, 10 * total / (words + 10)], axis=1)

    def score(self, h: np.ndarray, off: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.summary(h, off) @ self.doc, -30, 30)))


def _distinct(k: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Places of one of each pair (k, v)."""
    return np.unique(mix(k.astype(U) * U(0x9E3779B97F4A7C15) ^ mix(v)), return_index=True)[1]


def lexicon(h: np.ndarray, near: np.ndarray, off: np.ndarray, toxic: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes that get a weight of their own, and which of them tag tokens in toxic documents. near: hashes of each word with its neighbours."""
    doc = np.repeat(np.arange(len(off) - 1), np.diff(off))
    words, k = np.unique(h, return_inverse=True)
    kind = toxic[doc] > 0
    # A word counts once a document and once with the same neighbours, so copies add nothing.
    by_doc = _distinct(k, doc.astype(U) * U(2) + kind)
    by_near = _distinct(k, (near << U(1)) | kind.astype(U))
    a, b = (np.minimum(np.bincount(k[by_doc[kind[by_doc] == t]], minlength=len(words)), np.bincount(k[by_near[kind[by_near] == t]], minlength=len(words))) for t in (True, False))
    n, share = a + b, a.sum() / max(a.sum() + b.sum(), 1)
    # Evidence that a word prefers one kind of document: the log likelihood ratio of its counts.
    log = lambda k, e: np.where(k > 0, k * np.log(np.maximum(k, 1) / e), 0.0)
    sure = log(a, n * share) + log(b, n * (1 - share))
    enough = np.log(max(len(words), 2))
    use = np.flatnonzero(sure > enough)
    use = np.sort(use[np.argsort(-sure[use], kind="stable")[:most]])
    return words[use], (a[use] > 2 * share / (1 + share) * n[use]) & (sure[use] > enough + 3)


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Ridge logistic regression by Newton's method with step halving."""
    loss = lambda t: np.logaddexp(0, -(2 * y - 1) * (x @ t)).sum() + ridge / 2 * t @ t
    theta = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
        move = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(theta)), x.T @ (y - p) - ridge * theta)
        step, now = 1.0, loss(theta)
        while step > 1e-4 and loss(theta + step * move) > now:
            step /= 2
        theta = theta + step * move
        if np.abs(step * move).max() < 1e-6:
            break
    return theta


def fit_field(h: np.ndarray, off: np.ndarray, toxic: np.ndarray, steps: int = 80, most_weights: int = 4_000, most_windows: int = 20_000) -> Field:
    """Gradient ascent (Adam) on the likelihood of tagged windows; then the logistic function of documents.

    most_weights: words, and as many prefixes, that get a weight of their own; most_windows: windows that are fitted to, half of them around tagged words.
    """
    out = Field()
    share = toxic.mean() if len(toxic) else 0.0
    if share in (0.0, 1.0):
        out.doc = np.array([30.0 if share else -30.0, 0, 0, 0, 0])
        return out
    near = rolled(np.concatenate([[0], h[:, 0], [0]]).view(U), 3)
    found = [lexicon(h[:, i], near, off, toxic, most_weights) for i in (0, 1)]
    words, bad = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.argsort(words)
    out.words, bad = words[order], bad[order]
    k = out.known(h)
    doc = np.repeat(np.arange(len(off) - 1), np.diff(off))
    tag = np.append(bad, False)[k].any(axis=1) & (toxic[doc] > 0)
    rng = np.random.default_rng(7)
    tagged, known = np.flatnonzero(tag), np.flatnonzero((k >= 0).any(axis=1) & ~tag)
    mid = np.concatenate([rng.permutation(tagged)[: most_windows // 2], rng.permutation(known)[: most_windows // 4], rng.integers(0, len(h), min(len(h), most_windows // 4))]) if len(h) else np.zeros(0, np.int64)
    if len(mid) and len(out.words):
        place = mid[:, None] + np.arange(-HALF, HALF + 1)
        inside = (place >= off[doc[mid]][:, None]) & (place < off[doc[mid] + 1][:, None])
        place = np.clip(place, 0, len(h) - 1)
        word, y = np.where(inside[:, :, None], k[place], -2), np.where(inside, tag[place], False).astype(int)
        _ascend(out, word, y, steps)
    x = out.summary(h, off)
    out.doc = logistic(x, toxic)
    return out


def _ascend(out: Field, word: np.ndarray, y: np.ndarray, steps: int) -> None:
    n, width, _ = word.shape
    m = len(out.words)
    theta = np.concatenate([np.zeros(m), [-2.0], np.zeros(4)])
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    inside = word[:, :, 0] >= -1
    slot = np.where(word >= 0, word, m)
    pair = inside[:, 1:] & inside[:, :-1]
    for t in range(1, steps + 1):
        e = np.where(inside, theta[slot].sum(axis=2), 0.0)
        move = np.exp(theta[m + 1 :].reshape(2, 2))
        f = np.stack([np.ones_like(e), np.exp(e)], axis=2)
        alpha, beta = np.empty_like(f), np.ones_like(f)
        for i in range(width):
            a = f[:, i] if i == 0 else np.where(pair[:, i - 1, None], alpha[:, i - 1] @ move, 1.0) * f[:, i]
            alpha[:, i] = a / a.sum(axis=1, keepdims=True)
        for i in range(width - 2, -1, -1):
            b = np.where(pair[:, i, None], (f[:, i + 1] * beta[:, i + 1]) @ move.T, 1.0)
            beta[:, i] = b / b.sum(axis=1, keepdims=True)
        p = alpha * beta
        p = (p[:, :, 1] / p.sum(axis=2)) * inside
        grad = np.zeros_like(theta)
        grad[: m + 1] = np.bincount(slot[inside].ravel(), np.repeat((y - p)[inside], 2), m + 1)
        joint = alpha[:, :-1, :, None] * move * (f[:, 1:] * beta[:, 1:])[:, :, None, :]
        joint /= joint.sum(axis=(2, 3), keepdims=True)
        seen = np.array([[(pair & (y[:, :-1] == i) & (y[:, 1:] == j)).sum() for j in (0, 1)] for i in (0, 1)])
        grad[m + 1 :] = (seen - joint[pair].sum(axis=0)).ravel()
        grad = grad / n - 2e-5 * theta
        first = 0.9 * first + 0.1 * grad
        second = 0.99 * second + 0.01 * grad**2
        theta += 0.2 * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.99**t)) + 1e-6)
    out.weight, out.rest, out.step = theta[:m], float(theta[m]), theta[m + 1 :].reshape(2, 2)


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """id, y and the token hashes of whole texts, for the sample."""
    for b in batches:
        for rows, f in slices(folded(b.column(2))):
            h, _, _ = tokens(f)
            lists = pa.ListArray.from_arrays(pa.array((2 * f.first).astype(np.int32)), pa.array(h.ravel()))
            part = b.slice(rows.start, len(f))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), lists], ["id", "y", "h"])


def train(docs: DataFrame, labels: DataFrame, sample: int = 6_000, text: str = "text", most_words: int = 3_000_000, **bounds: int) -> Field:
    """A field from the sampled rows, in the order of their hashes each that still fits into ``most_words`` words together. bounds: of ``fit_field``."""
    known = labelled(labels, "toxic", 5, 0)
    half = [known.where(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(sample // 2) for y in (0, 1)]
    chosen = half[0].union(half[1])
    rows = docs.select("doc_id", text).join(chosen, F.col("doc_id") == F.col("id")).select(F.col("id").cast("long").alias("id"), "y", text)
    rows = written(rows.mapInArrow(_hashes, "id long, y int, h array<long>"), "toxic-sample")
    sizes = rows.groupBy("id").agg(F.sum(F.size("h")).alias("n")).orderBy(F.xxhash64("id"), "id").collect()  # of the sample only
    left, fitting = 2 * most_words, []
    for r in sizes:  # what does not fit goes, and nothing behind it
        if r.n <= left:
            left -= r.n
            fitting.append((r.id,))
    got = rows.join(F.broadcast(docs.sparkSession.createDataFrame(fitting, "id long")), "id", "left_semi").toArrow().combine_chunks()
    if not got.num_rows:
        return fit_field(np.zeros((0, 2), np.int64), np.zeros(1, np.int64), np.zeros(0))
    got = got.sort_by("id")
    h = got.column("h").combine_chunks()
    h = h.chunk(0) if isinstance(h, pa.ChunkedArray) else h
    return fit_field(h.flatten().to_numpy().reshape(-1, 2), np.concatenate([[0], np.cumsum(h.value_lengths().to_numpy() // 2)]).astype(np.int64), got.column("y").to_numpy().astype(float), **bounds)


def score_toxicity(docs: DataFrame, labels: DataFrame, sample: int = 6_000, threshold: float = 0.5, text: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted and the toxic spans (code point offsets and marginals) of each row."""
    prepare(docs.sparkSession)
    crf = train(docs, labels, sample, text)  # some thousand weights, whatever the data's size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for rows, f in slices(folded(b.column(1))):
                h, start, end = tokens(f)
                at, p = crf.marginals(h, f.first)
                hit = at[p >= 0.5]
                doc = f.doc[hit]
                points = np.zeros(len(f.buf) + 1, np.int32)
                np.cumsum((f.buf & 0xC0) != 0x80, out=points[1:])
                base = points[f.off[doc]]
                spans = pa.StructArray.from_arrays([pa.array(points[start[hit]] - base), pa.array(points[end[hit]] - base), pa.array(p[p >= 0.5])], ["start", "end", "p"])
                lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(doc, np.arange(len(f) + 1)).astype(np.int32)), spans)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(rows.start, len(f)), pa.array(crf.score(h, f.first)), lists], ["doc_id", "score", "spans"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    out = docs.select("doc_id", text).mapInArrow(run, f"doc_id {kind}, score double, spans array<struct<start int, end int, p double>>")
    return out.select("doc_id", held_out(5, 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "spans")
