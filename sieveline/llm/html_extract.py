"""Main text of web pages by wrapper induction.

1. Each page is parsed leniently into a tree; its skeleton keeps labels, parents
   and 64-bit hashes of own texts.
2. Of a host's pages with text, one of the shape that the most different
   contents have is the host's reference (of as frequent ones, the shape whose
   size is nearest to the host's median).  Every page's tree is aligned with it by simple tree matching: the order-preserving
   matching of children with the most nodes.  Equal first and last subtrees are
   matched at once, which loses nothing; the rest takes dynamic programming,
   whatever its size.
3. Over all pages of a host, a text that most pages have at the same place is
   template; the other texts fill slots.  A place is a node of the reference or,
   for a node that has none there (an optional block, a second layout), the
   lowest aligned node above it and the labels from there down.  Pages count once
   for each different content (all texts outside of chrome), so copies of an
   article do not make it a template.  A place that fewer than ``LEAST_PAGES``
   different contents have tells nothing, so smaller hosts have no template.
   A place where at least ``MENU_PAGES`` different contents share few texts, at most
   ``MENU_TEXTS`` of their number, is filled from a list (menus, notices, adverts that take turns)
   and template whatever its text, but only outside of the article or main part that a page has.
4. Slots in menus, headers, footers, sidebars, notices, adverts, forms and
   reader comments are dropped: by their tags, or by class words, which only
   mark a region beside the content: not one that holds most of the page's
   slots together with its heading or article, nor, on a page without these, one that holds nearly all of
   them in paragraphs.  A class that says what a page has or lacks (``no-comments``) marks nothing.  All other slots are
   the content; on a page with a main part, those in it and in articles.  On a
   page without either, single-word blocks beside the container that holds
   most of the text are labels and go.

Host references and templates are broadcast only while their size is below
``BROADCAST`` bytes, else pages are joined to them by host.

Defined cases: null html gives an empty text; a null url or one without host
makes a page a host of its own without template; pages cut off in the middle
give what is there; repeated rows each get a row; an empty table gives an empty
table; further columns of the input are not read.
"""

from __future__ import annotations

import html as entities
import re
import sys
from collections.abc import Iterator
from hashlib import blake2b
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import prepare, written

BROADCAST = 64 << 20
#: Of the alignment, none of which changes its result: children up to which rows are lists, places of a table that is kept whole, weights kept, frames.
SHORT, WHOLE, MEMO, DEPTH = 24, 1 << 20, 1 << 19, 1_000_000
#: A text is template if this share of at least so many different pages has it at a place.
SHARE, LEAST_PAGES = 0.6, 5
#: A place is filled from a list if so many different pages have at most this share of different texts there.
MENU_PAGES, MENU_TEXTS = 10, 0.5

# Element names of HTML.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark math mi mn mo mrow ms msub msup mtext nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = "script|style|noscript|template|textarea|title|iframe|svg|object|canvas|audio|video|select"
CHROME = frozenset("head nav footer aside form button dialog menu input option optgroup datalist".split())
#: Words in class, id and role that mark chrome.
CHROME_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion nav navbar navigation menu menubar breadcrumb breadcrumbs "
    "header masthead topbar footer contentinfo sidebar aside complementary widget related recommended cookie cookies consent gdpr notice alert popup modal overlay "
    "newsletter subscribe subscription signup login search share sharing social comments comment commentlist reply replies respond disqus pagination pager toolbar copyright "
    "skip hidden".split()
)
#: Words of these that also name the head of an article: they mark nothing that has a heading.
HEADS = frozenset("header masthead topbar".split())
#: First words of classes that say what a page has, lacks or is.
STATES = frozenset("no has have with without is not hide hides show shows".split())
#: What an opening tag closes, if it is the innermost of these up to a barrier.
CLOSES = {"li": {"li"}, "p": {"p"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"tr", "td", "th"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}}
BLOCKS_CLOSE_P = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
BARRIER = frozenset("ul ol table tr td th dl article section div body main aside nav footer header form html blockquote".split())

_TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<(?P<raw>{RAW})\b[^>]*>(?:.*?</(?P=raw)\s*>|.*\Z)|<(?P<end>/?)(?P<tag>[a-z][^\s/>]*)(?P<rest>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+|[^>]*+)>|<[!?/][^>]*>|<(?:[a-z/!?][^<>]*)\Z",
    re.S | re.I,
)
_NAMES = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_HIDDEN = re.compile(r"(?:^|\s)hidden(?=[\s=/]|$)|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none", re.I)
_WORD = re.compile(r"[a-z]+")


#: What marks a node as chrome.
NOT, BY_TAG, BY_WORD, BY_HEAD = range(4)


def _word_mark(names: list[str]) -> int:
    """What the classes, ids and roles of a node say."""
    found = NOT
    for name in names:
        words = _WORD.findall(name)
        if words and words[0] not in STATES:
            hit = CHROME_WORDS.intersection(words)
            if hit - HEADS:
                return BY_WORD
            if hit:
                found = BY_HEAD
    return found


class Tree:
    """label, parent and chrome mark of each node; items: (node, text) in page order, text None for a block's edge."""

    def __init__(self, page: str):
        self.label: list[str] = ["#root"]
        self.parent: list[int] = [-1]
        self.mark: list[int] = [NOT]
        self.items: list[tuple[int, str | None]] = []
        stack, at = [0], 0
        tags = ["#root"]
        items = self.items
        for m in _TOKEN.finditer(page):
            if m.start() > at:
                items.append((stack[-1], page[at : m.start()]))
            at = m.end()
            tag = m["tag"]
            if not tag:
                continue
            tag = tag.lower()
            if tag not in INLINE:
                items.append((stack[-1], None))
            if m["end"]:
                for k in range(len(stack) - 1, 0, -1):
                    if tags[stack[k]] == tag:
                        del stack[k:]
                        break
                    if tag in INLINE and tags[stack[k]] in BARRIER:
                        break
                continue
            self._close(stack, tags, tag)
            up = stack[-1]
            rest = m["rest"]
            names, mark = "", BY_WORD if tag == "form" else BY_TAG if tag in CHROME else NOT
            if rest:
                found: list[str] = []
                for n in _NAMES.finditer(rest):
                    words = (n[2] or n[3] or n[4] or "").lower()
                    names += " " + words
                    found += words.split()
                mark = mark or _word_mark(found)
                if _HIDDEN.search(rest):
                    mark = BY_TAG
            if tag == "header" and not any(tags[k] in ("article", "main") for k in stack):
                mark = BY_TAG
            if tag in ("body", "html"):
                mark = NOT
            self.label.append(tag + names)
            tags.append(tag)
            self.parent.append(up)
            self.mark.append(mark)
            if tag not in VOID and not rest.rstrip().endswith("/"):
                stack.append(len(tags) - 1)
        if at < len(page):
            items.append((stack[-1], page[at:]))
        self.tags = tags

    @staticmethod
    def _close(stack: list[int], tags: list[str], tag: str) -> None:
        shut = CLOSES.get(tag)
        if shut is None:
            if tag not in BLOCKS_CLOSE_P:
                return
            shut = {"p"}
        for k in range(len(stack) - 1, 0, -1):
            t = tags[stack[k]]
            if t in shut:
                del stack[k:]
                if tag != "tr":
                    return
            elif t in BARRIER and not (tag == "tr" and t in ("td", "th")):
                return

    def own_texts(self) -> dict[int, str]:
        out: dict[int, str] = {}
        for node, t in self.items:
            if t is not None and (t := " ".join(entities.unescape(t).split())):
                out[node] = f"{out[node]} {t}" if node in out else t
        return out

    def skeleton(self) -> bytes:
        """Parent, label, and both halves of the text's hash (0: no text) of each node."""
        n = len(self.label)
        out = np.zeros((n, 4), np.uint32)
        out[:, 0] = np.array(self.parent, np.int64).astype(np.uint32)
        out[:, 1] = [crc32(x.encode()) for x in self.label]
        for node, t in self.own_texts().items():
            h = _hash(t.encode()) | 1
            out[node, 2:] = h & 0xFFFFFFFF, h >> 32 & 0xFFFFFFFF
        return out.tobytes()

    def inside_article(self) -> list[bool]:
        """Which nodes lie in the article or main part; on a page without either, all."""
        out = [t in ("article", "main") for t in self.tags]
        if not any(out):
            return [True] * len(out)
        for i in range(1, len(out)):
            out[i] = out[i] or out[self.parent[i]]
        return out

    def chrome(self, drop: set[int] = frozenset()) -> list[bool]:
        """Which nodes lie in menus, sidebars and the like; drop: template texts, which weigh nothing."""
        n, tags, parent = len(self.label), self.tags, self.parent
        size = [0] * n
        for node, t in self.items:
            if t is not None and node not in drop:
                size[node] += len(t.strip())
        out = [False] * n
        heads, titles, paragraphs = ([int(t in of) for t in tags] for of in (("h1", "article", "main"), ("h1", "h2", "h3"), ("p",)))
        for i in range(1, n):
            out[i] = out[parent[i]] or self.mark[i] == BY_TAG
            if out[i]:
                size[i] = heads[i] = titles[i] = paragraphs[i] = 0
        for i in range(n - 1, 0, -1):
            for v in (size, heads, titles, paragraphs):
                v[parent[i]] += v[i]
        for i in range(1, n):
            mark = self.mark[i]
            if out[i] or out[parent[i]]:
                out[i] = True
            elif mark == BY_WORD or (mark == BY_HEAD and not titles[i]):
                most = 2 * size[i] >= size[0] and heads[i]
                out[i] = not (most or (10 * size[i] >= 9 * size[0] and not heads[0] and paragraphs[i] > 1))
        return out


def _kids(s: np.ndarray) -> list[list[int]]:
    parent = s[:, 0].astype(np.int32).tolist()
    kids: list[list[int]] = [[] for _ in parent]
    for i in range(1, len(parent)):
        kids[parent[i]].append(i)
    return kids


def _children(s: np.ndarray) -> tuple[list[list[int]], list[int], list[int]]:
    """Children, shape and size of each node's subtree."""
    kids, shapes = _kids(s), _Shapes()
    shape = shapes.of(s, kids)
    return kids, shape, [shapes.size[x] for x in shape]


class _Shapes:
    """Subtrees by shape, numbered over both trees, and the weights of pairs of them."""

    def __init__(self) -> None:
        self.number: dict[tuple, int] = {}
        self.label: list[int] = []
        self.kids: list[tuple[int, ...]] = []
        self.size: list[int] = []
        self.memo: dict[tuple[int, int], int] = {}

    def of(self, s: np.ndarray, kids: list[list[int]]) -> list[int]:
        """The shape of each node's subtree."""
        label, shape = s[:, 1].tolist(), [0] * len(s)
        for i in range(len(s) - 1, -1, -1):
            below = tuple([shape[k] for k in kids[i]])
            n = self.number.setdefault((label[i], below), len(self.label))
            if n == len(self.label):
                self.label.append(label[i])
                self.kids.append(below)
                self.size.append(1 + sum(self.size[k] for k in below))
            shape[i] = n
        return shape

    def weight(self, a: int, b: int) -> int:
        """Nodes in the largest matching of two subtrees that has their roots."""
        if self.label[a] != self.label[b]:
            return 0
        if a == b:
            return self.size[a]
        x, y = self.kids[a], self.kids[b]
        if not x or not y:
            return 1
        if (w := self.memo.get((a, b))) is None:
            lo, hi = _ends(x, y)
            w = 1
            for k in x[:lo] + x[len(x) - hi :]:
                w += self.size[k]
            x, y = x[lo : len(x) - hi], y[lo : len(y) - hi]
            if x and y:
                for row in self.rows(x, y):
                    pass
                w += int(row[-1])
            if len(self.memo) >= MEMO:
                self.memo.clear()
            self.memo[a, b] = w
        return w

    def rows(self, x: tuple[int, ...], y: tuple[int, ...], row: list[int] | np.ndarray | None = None) -> Iterator[list[int] | np.ndarray]:
        """For each of x the next row of the table of best matchings: its last place has that of all of y."""
        if len(y) <= SHORT:
            row = [0] * (len(y) + 1) if row is None else row
            for a in x:
                new, last, la = [0], 0, self.label[a]
                for j, b in enumerate(y):
                    if (above := row[j + 1]) > last:
                        last = above
                    if la == self.label[b] and (here := row[j] + self.weight(a, b)) > last:
                        last = here
                    new.append(last)
                row = new
                yield row
            return
        kinds, place = np.unique(np.array(y), return_inverse=True)
        alike: dict[int, list[tuple[int, int]]] = {}
        for k, b in enumerate(kinds.tolist()):
            alike.setdefault(self.label[b], []).append((k, b))
        row = np.zeros(len(y) + 1, np.int64) if row is None else row
        before, w = -1, row
        for a in x:
            if a != before:
                w = np.zeros(len(kinds), np.int64)
                for k, b in alike.get(self.label[a], ()):
                    w[k] = self.weight(a, b)
                before, w = a, w[place]
            # The best to the left in the same row is the largest so far.
            row = np.append(0, np.maximum.accumulate(np.maximum(row[1:], np.where(w > 0, row[:-1] + w, 0))))
            yield row

    def matched(self, x: tuple[int, ...], y: tuple[int, ...]) -> list[tuple[int, int]]:
        """Places of the matched children. Of the table every so manieth row is kept and those between are made again."""
        step = max(1, int(len(x) ** 0.5)) if len(x) * len(y) > WHOLE else len(x)
        starts: list[list[int] | np.ndarray] = [[0] * (len(y) + 1) if len(y) <= SHORT else np.zeros(len(y) + 1, np.int64)]
        if step < len(x):
            starts += [row for i, row in enumerate(self.rows(x, y), 1) if i % step == 0]
        out, i, j = [], len(x), len(y)
        while i and j:
            first = (i - 1) // step * step
            t = [starts[first // step], *self.rows(x[first:i], y, starts[first // step])]
            while i > first and j:
                if t[i - first][j] == t[i - first - 1][j]:
                    i -= 1
                elif t[i - first][j] == t[i - first][j - 1]:
                    j -= 1
                else:
                    i, j = i - 1, j - 1
                    out.append((i, j))
        return out


def _ends(x: tuple[int, ...], y: tuple[int, ...]) -> tuple[int, int]:
    """Numbers of equal first and equal last subtrees."""
    lo, hi, m = 0, 0, min(len(x), len(y))
    while lo < m and x[lo] == y[lo]:
        lo += 1
    while hi < m - lo and x[-1 - hi] == y[-1 - hi]:
        hi += 1
    return lo, hi


def align(page: np.ndarray, ref: np.ndarray) -> np.ndarray:
    """For each node of a page's skeleton the matched node of the reference, or -1: simple tree matching, exact at every size."""
    if sys.getrecursionlimit() < DEPTH:
        sys.setrecursionlimit(DEPTH)  # weights go as deep as the pages
    ka, kb = _kids(page), _kids(ref)
    shapes = _Shapes()
    sa, sb = shapes.of(page, ka), shapes.of(ref, kb)
    out = np.full(len(page), -1)
    todo = [(0, 0)]
    while todo:
        a, b = todo.pop()
        out[a] = b
        x, y = ka[a], kb[b]
        p, q = shapes.kids[sa[a]], shapes.kids[sb[b]]
        lo, hi = _ends(p, q)
        todo += zip(x[:lo], y[:lo])
        if hi:
            todo += zip(x[-hi:], y[-hi:])
        p, q = p[lo : len(p) - hi], q[lo : len(q) - hi]
        if len(p) == len(q) == 1:
            if shapes.label[p[0]] == shapes.label[q[0]]:
                todo.append((x[lo], y[lo]))
        elif p and q:
            todo += [(x[lo + i], y[lo + j]) for i, j in shapes.matched(p, q)]
    return out


def places(page: np.ndarray, ref: np.ndarray) -> list[int]:
    """For each node of a page its place: the reference's node, or below 0 a hash of the lowest aligned node above and the labels since."""
    out = align(page, ref).tolist()
    parent, label = page[:, 0].astype(np.int32).tolist(), page[:, 1].tolist()
    for i, at in enumerate(out):
        if at < 0:
            up = out[parent[i]]
            out[i] = -1 - (int.from_bytes(blake2b(b"%d %d" % (up, label[i]), digest_size=8).digest()) >> 2)
    return out


def _skeleton(b: bytes) -> np.ndarray:
    return np.frombuffer(b, np.uint32).reshape(-1, 4)


def _texts(s: np.ndarray) -> np.ndarray:
    """The text hash of each node of a skeleton, 0 where there is none."""
    return (s[:, 2].astype(np.uint64) | s[:, 3].astype(np.uint64) << np.uint64(32)).view(np.int64)


def content_root(tree: Tree, kept: list[bool]) -> tuple[set[int], set[int]]:
    """Nodes below which the content lies, the main parts and articles or without a main part the whole page, and the labels in it.

    Labels are blocks of a single word beside the container that holds most of
    a page without article: no heading, paragraph, list or cell. All other text stays.
    """
    n = len(tree.label)
    size, words = [0] * n, [0] * n
    for node, t in tree.items:
        if t is not None and kept[node]:
            size[node] += len(t.strip())
            words[node] += len(t.split())
    for i in range(n - 1, 0, -1):
        size[tree.parent[i]] += size[i]
        words[tree.parent[i]] += words[i]
    found = {w: {i for i in range(n) if kept[i] and tree.tags[i] == w and size[i]} for w in ("article", "main")}
    if found["main"]:
        return found["main"] | found["article"], set()
    if found["article"]:
        return {0}, set()
    labels: set[int] = set()
    at = 0
    kids: dict[int, list[int]] = {}
    for i in range(1, n):
        kids.setdefault(tree.parent[i], []).append(i)
    while True:
        best = max(kids.get(at, []), key=lambda k: size[k], default=None)
        if best is None or size[best] < 0.7 * size[at] or tree.tags[best] in INLINE or tree.tags[best] in ("p", "h1", "h2", "li", "td"):
            return {0}, labels
        for k in kids[at]:
            if k != best and words[k] == 1 and tree.tags[k] in ("div", "section") and not any(tree.tags[j] not in ("div", "section") and tree.tags[j] not in INLINE for j in kids.get(k, ())):
                labels.add(k)
        at = best


def extract(page: str | None, ref: bytes | None = None, template: set[tuple[int, int]] = frozenset()) -> str:
    """The main text of a page, with what is known of its host."""
    if not page:
        return ""
    tree = Tree(page)
    n = len(tree.label)
    drop: set[int] = set()
    if ref is not None and template:
        s = _skeleton(tree.skeleton())
        at = places(s, _skeleton(ref))
        inside = tree.inside_article()
        drop = {i for i, (r, h) in enumerate(zip(at, _texts(s).tolist(), strict=True)) if h and ((r, h) in template or (not inside[i] and (r, 0) in template))}
    kept = [not c for c in tree.chrome(drop)]
    roots, labels = content_root(tree, kept)
    inside = [False] * n
    for i in range(n):
        inside[i] = kept[i] and i not in labels and (i in roots or (i > 0 and inside[tree.parent[i]]))
    blocks: list[str] = []
    parts: list[str] = []
    for node, t in tree.items:
        if t is None:
            if parts:
                blocks.append("".join(parts))
                parts = []
        elif inside[node] and node not in drop:
            parts.append(entities.unescape(t))
    blocks.append("".join(parts))
    return " ".join(w for b in blocks if (w := " ".join(b.split())))


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """host, page_id, skeleton, hashes of the page's content and shape, and nodes of each page with text."""
    for b in batches:
        out = []
        for h, i, t in zip(*(b.column(k) for k in range(3)), strict=True):
            tree = Tree(t.as_py() or "")
            texts = tree.own_texts()
            if texts:
                chrome = tree.chrome()
                content = "\n".join(sorted(x for n, x in texts.items() if not chrome[n]))
                s = tree.skeleton()
                out.append((h, i, s, _hash(content.encode()), _hash(_skeleton(s)[:, :2].tobytes()), len(tree.label)))
        kinds = (b.schema.field(0).type, b.schema.field(1).type, pa.binary(), pa.int64(), pa.int64(), pa.int32())
        names = ["host", "page_id", "skeleton", "content", "shape", "nodes"]
        yield pa.RecordBatch.from_arrays([pa.array([x[k].as_py() if k < 2 else x[k] for x in out], kind) for k, kind in enumerate(kinds)], names)


def _hash(b: bytes) -> int:
    return int.from_bytes(blake2b(b, digest_size=8).digest(), signed=True)


def _slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """host, content, place and text hash of each text."""
    for b in batches:
        host, content, node, text = [], [], [], []
        for h, c, s, r in zip(*(x.to_pylist() for x in b.columns), strict=True):
            s = _skeleton(s)
            at = places(s, _skeleton(r))
            texts = _texts(s)
            hit = np.flatnonzero(texts)
            host += [h] * len(hit)
            content += [c] * len(hit)
            node += [at[i] for i in hit.tolist()]
            text += texts[hit].tolist()
        yield pa.RecordBatch.from_arrays([pa.array(host, pa.string()), pa.array(content, pa.int64()), pa.array(node, pa.int64()), pa.array(text, pa.int64())], ["host", "content", "node", "text"])


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = [extract(p.as_py(), r, {(x["node"], x["text"]) for x in t or ()}) for p, r, t in zip(b.column(2), b.column(3).to_pylist(), b.column(4).to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])


def _sized(df: DataFrame, *columns: str) -> DataFrame:
    """The frame, marked for broadcast if its rows' known size is small. An array's element counts with 24 bytes."""
    size = sum((F.coalesce(24 * F.size(c) if df.schema[c].dataType.typeName() == "array" else F.octet_length(c), F.lit(0)) for c in columns), F.lit(64))
    n = df.agg(F.sum(size).alias("n")).first().n or 0
    return F.broadcast(df) if n <= BROADCAST else df


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of each row."""
    prepare(pages.sparkSession)
    host = F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]+)", 1))
    source = pages.select("page_id", "url", F.when(host != "", host).alias("host"), "html")
    kind = pages.schema["page_id"].dataType.simpleString()
    parsed = source.where(F.col("host").isNotNull()).select("host", "page_id", "html").mapInArrow(_parse, f"host string, page_id {kind}, skeleton binary, content long, shape long, nodes int")
    parsed = written(parsed, "skeletons")
    shapes = parsed.groupBy("host", "shape", "content").agg(F.count("*").alias("rows"), F.min("nodes").alias("nodes"))
    shapes = shapes.groupBy("host", "shape").agg(F.count("*").alias("contents"), F.sum("rows").alias("rows"), F.min("nodes").alias("nodes"))
    # The size of the middle row of each host, from its counts of sizes.
    sizes = shapes.groupBy("host", "nodes").agg(F.sum("rows").alias("rows"))
    middle = sizes.groupBy("host").agg(F.percentile("nodes", 0.5, F.col("rows")).alias("middle"), F.sum("rows").alias("n"))
    best = shapes.join(middle.where(F.col("n") >= LEAST_PAGES), "host").groupBy("host").agg(F.min_by("shape", F.struct(-F.col("contents"), F.abs(F.col("nodes") - F.col("middle")), "shape")).alias("shape"))
    refs = parsed.join(best, ["host", "shape"]).groupBy("host").agg(F.min_by("skeleton", F.struct("page_id", "content")).alias("ref"))
    refs = written(refs, "references")
    slots = parsed.join(_sized(refs, "ref"), "host").select("host", "content", "skeleton", "ref").mapInArrow(_slots, "host string, content long, node long, text long")
    # Exact counts of different contents, in two steps: for each text at a place, and for each place.
    slots = written(slots.distinct(), "slots")
    at_node = slots.select("host", "node", "content").distinct().groupBy("host", "node").agg(F.count("*").alias("pages"))
    same = slots.groupBy("host", "node", "text").agg(F.count("*").alias("same"))
    constant = same.join(at_node.where(F.col("pages") >= LEAST_PAGES), ["host", "node"]).where((F.col("same") >= LEAST_PAGES) & (F.col("same") >= SHARE * F.col("pages")))
    texts = same.groupBy("host", "node").agg(F.count("*").alias("texts"))
    lists = at_node.join(texts, ["host", "node"]).where((F.col("pages") >= MENU_PAGES) & (F.col("texts") <= MENU_TEXTS * F.col("pages")))
    constant = constant.select("host", "node", "text").unionByName(lists.select("host", "node", F.lit(0).cast("long").alias("text")))  # 0: any text
    templates = constant.groupBy("host").agg(F.collect_list(F.struct("node", "text")).alias("template"))
    known = written(refs.join(templates, "host"), "templates").withColumnRenamed("host", "of")
    joined = source.join(_sized(known, "ref", "template"), F.col("host") == F.col("of"), "left").select("page_id", "url", "html", "ref", "template")
    return joined.mapInArrow(_extract, f"page_id {kind}, url string, text string, n_chars long")
