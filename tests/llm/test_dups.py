"""Near-dedup, substring dedup, decontamination, sharding, quality, extraction and the pipeline."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from sieveline.llm import decontaminate, html_extract, minhash, quality_gbt, sharding, substring_dedup
from sieveline.llm.fm_index import BlockMin, FMIndex
from sieveline.llm.text import folded, slices

from .conftest import doc

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def near(table, k, percent):
    sets, up = {}, {}
    for i, t in table:
        w = WORD.findall((t or "").translate(LOWER))
        sets.setdefault(i, set()).add(frozenset(tuple(w[j : j + k]) for j in range(len(w) - k + 1)) or frozenset([tuple(w)] if w else []))
        up[i] = i
    find = lambda a: a if up[a] == a else find(up[a])
    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if any(x and y and 100 * len(x & y) >= percent * len(x | y) for x in sets[a] for y in sets[b]):
                up[max(find(a), find(b))] = min(find(a), find(b))
    return {i: find(i) for i in ids}


def test_near_duplicates(spark, odd, none):
    rng = random.Random(5)
    words = [f"t{i}" for i in range(400)]
    data = []
    for g in range(12):
        base = [rng.choice(words) for _ in range(rng.randrange(20, 200))]
        for c in range(8):
            w = [rng.choice(words) if rng.random() < rng.choice([0, 0.01, 0.03, 0.06]) else x for x in base]
            data.append(doc(100 + g * 10 + c, " ".join(w).upper() if c % 2 else " ".join(w)))
    docs = odd.unionByName(spark.createDataFrame(data, odd.schema))
    for k, percent in ((3, 85), (5, 80)):
        want = near([(r.doc_id, r.text) for r in docs.collect() if r.doc_id is not None], k, percent)
        out = minhash.near_duplicates(docs, k, percent).collect()
        assert len(out) == docs.count()
        for r in out:
            if r.doc_id is not None:
                assert r.component_id == want[r.doc_id] and r.kept == (want[r.doc_id] == r.doc_id)
    assert minhash.near_duplicates(none).count() == 0
    left = minhash.drop_near_duplicates(docs, 5, 80)
    assert left.columns == docs.columns
    ids = Counter(r.doc_id for r in left.collect())
    assert ids.pop(None) == 2 and set(ids.values()) == {1} and set(ids) == {i for i, c in want.items() if i == c}


@pytest.fixture
def tables(monkeypatch):
    """Rows of each table that the operators write."""
    from sieveline.llm import components, store

    found = {}

    def count(df, what):
        out = store.written(df, what)
        found[what] = max(found.get(what, 0), out.count())
        return out

    for m in (minhash, substring_dedup, components):
        monkeypatch.setattr(m, "written", count)
    return found


def test_repeated_rows_of_near_copies(spark, odd, tables):
    base = " ".join(f"w{i}" for i in range(200))
    data = [doc(1, base), doc(2, base + " tail")] * 1000 + [doc(3, "x " + base), doc(4, "all other words stand here"), doc(2, base + " other tail")]
    docs = spark.createDataFrame(data, odd.schema)
    out = minhash.near_duplicates(docs, 3, 85).collect()
    assert len(out) == len(data) and all(r.component_id == (4 if r.doc_id == 4 else 1) and r.kept == (r.doc_id in (1, 4)) for r in out)
    assert tables.pop("signatures") == len(data) and max(tables.values()) < 500
    assert sorted(r.doc_id for r in minhash.drop_near_duplicates(docs).collect()) == [1, 4]


@pytest.mark.parametrize(("block", "blocks"), [(3, 1), (3, 32), (500, 32)])
def test_classes_that_share_a_phrase(spark, odd, monkeypatch, block, blocks):
    """Buckets of many classes in many components: links between them are found in blocks and on every level of bands."""
    monkeypatch.setattr(minhash, "BLOCK", block)
    monkeypatch.setattr(minhash, "BLOCKS", blocks)
    rng = random.Random(21)
    phrase = [f"same{i}" for i in range(60)]
    data = []
    for g in range(40):
        own = [f"o{g}_{i}" for i in range(rng.choice([5, 10, 30]))]
        for c in range(rng.choice([1, 1, 2])):
            w = phrase + own
            if c:
                w[rng.randrange(len(w))] = "changed"
            data.append(doc(100 + 10 * g + c, " ".join(w)))
    data += [doc(3, "p q r s t u"), doc(5, "p q r s t u"), doc(5, "a b c d e f g"), doc(2, "a b c d e f g")]  # one document with two texts
    want = near([(d[0], d[1]) for d in data], 3, 85)
    out = minhash.near_duplicates(spark.createDataFrame(data, odd.schema), 3, 85).collect()
    assert {r.doc_id: r.component_id for r in out} == want and want[3] == want[5] == 2


@pytest.mark.parametrize(("block", "blocks"), [(3, 1), (500, 32)])
def test_links_of_two_classes_on_deeper_levels(spark, odd, monkeypatch, block, blocks):
    """Pairs within a family of classes just below the threshold: of the bands of more rows, many are shared by the two alone."""
    monkeypatch.setattr(minhash, "BLOCK", block)
    monkeypatch.setattr(minhash, "BLOCKS", blocks)
    family = [f"same{i}" for i in range(400)]
    data = [doc(2 * g + c, " ".join(family + [f"o{g}_{i}" for i in range(20)] + [f"o{g}_{c}_{i}" for i in range(30)])) for g in range(60) for c in range(2)]
    want = near([(d[0], d[1]) for d in data], 3, 85)
    out = minhash.near_duplicates(spark.createDataFrame(data, odd.schema), 3, 85).collect()
    assert {r.doc_id: r.component_id for r in out} == want == {i: i // 2 * 2 for i in range(120)}


def test_hashes_that_collide_in_blocks():
    """Equal sets of ten shingles that share five values of 32 bits: of the intersection, half is counted."""
    hashes = (np.arange(10, dtype=np.uint64) % np.uint64(5) << np.uint64(32)) + np.arange(10, dtype=np.uint64)
    rows = [{"bucket": 7, "block": 0, "query": q, "cid": c, "c": c, "sig": bytes(minhash.VALUES), "n": 10, "keys": np.int64(7).tobytes(), "hashes": np.sort(hashes).tobytes()} for q, c in ((1, 1), (0, 2))]
    short = minhash._shortened(iter([pa.RecordBatch.from_pylist(rows)]))
    found = [r for b in minhash._cross(minhash.least_matches(0.85, 1e-6, minhash.VALUES), 85)(short) for r in b.to_pylist()]
    assert found == [{"one": 1, "other": 2}]


def test_pruning_keeps_what_may_be_similar():
    least = minhash.least_matches(0.85, 1e-6, 256)
    assert least[256] < 0.8 * 256 and all(a <= b for a, b in zip(least, least[1:]))
    assert minhash.n_bands(0.85, 1e-6) * minhash.ROWS < 100


def repeats(table):
    least, words = {}, [(i, (t or "").encode().split()) for i, t in table]
    for i, w in words:
        for k in range(len(w) - 49):
            if i is not None:
                key = tuple(w[k : k + 50])
                least[key] = min(least.get(key, i), i)
    out = []
    for i, w in words:
        c = {j for k in range(len(w) - 49) if i is not None and least[tuple(w[k : k + 50])] < i for j in range(k, k + 50)}
        out.append((str(i), len(w), len(c), hashlib.sha256(b" ".join(x for j, x in enumerate(w) if j not in c)).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("hot", [1_000, 1])
def test_repeats(spark, odd, none, monkeypatch, hot):
    monkeypatch.setattr(substring_dedup, "HOT_PASSAGES", hot)
    rng = random.Random(2)
    base = [f"p{rng.randrange(30)}" for _ in range(300)]
    data = [doc(900 + i, "  ".join(base[:i]) + "\n" + " ".join(["same"] * (2 * i))) for i in (40, 49, 50, 51, 120)]
    for i in range(40):
        a, n = rng.randrange(220), rng.randrange(30, 120)
        w = [f"u{i}"] * rng.randrange(3) + base[a : a + n] + [f"z{i}"]
        if rng.random() < 0.5:
            w[rng.randrange(len(w))] = "changed"
        data.append(doc(200 + rng.randrange(60), " ".join(w)))
    docs = odd.unionByName(spark.createDataFrame(data, odd.schema))
    out = substring_dedup.repeat_digests(docs).collect()
    assert sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in out) == repeats([(r.doc_id, r.text) for r in docs.collect()])
    assert substring_dedup.repeat_digests(none).count() == 0
    cut = substring_dedup.remove_repeats(docs)
    assert cut.columns == docs.columns and cut.count() == docs.count()
    kept = sorted((str(r.doc_id), hashlib.sha256(b" ".join((r.text or "").encode().split())).hexdigest()) for r in cut.collect())
    assert kept == sorted((a, d) for a, _, _, d in repeats([(r.doc_id, r.text) for r in docs.collect()]))


def test_minima_and_nearest_smaller_values():
    rng = np.random.default_rng(1)
    for n in [1, 2, 7, 8, 9, 60, 300, 2000]:
        v = rng.integers(0, 60, n).astype(np.uint8)
        v[0] = v[-1] = 0
        m = BlockMin(v)
        lo = rng.integers(0, n, 50)
        hi = np.array([rng.integers(a, n + 1) for a in lo])
        x = rng.integers(1, 60, 50).astype(np.uint8)
        assert m.over(lo, hi).tolist() == [int(v[a:b].min()) if b > a else 255 for a, b in zip(lo, hi)]
        assert m.next_below(lo, x).tolist() == [next((j for j in range(a, n) if v[j] < y), n) for a, y in zip(lo, x)]
        assert m.last_below(lo, x).tolist() == [next((j for j in range(a, -1, -1) if v[j] < y), -1) for a, y in zip(lo, x)]


def test_matching_statistics():
    """Matches of enough symbols in an earlier document, against looking at all of them."""
    rng = np.random.default_rng(1)
    for t in range(150):
        least, sigma = int(rng.integers(1, 8)), int(rng.integers(2, 5))
        texts = [rng.integers(1, sigma, rng.integers(1, 30)) for _ in range(rng.integers(1, 12))]
        if t % 2:
            texts = [np.concatenate([p, texts[0][:9]]) for p in texts]
        docs = np.unique(rng.integers(0, 6, len(texts)), return_inverse=True)[1]
        symbols = np.concatenate([np.append(p, 0) for p in texts])
        place = np.concatenate([[0], np.cumsum([len(p) + 1 for p in texts])])
        index = FMIndex(symbols, np.repeat(docs, np.diff(place)), 64)
        found = list(zip(*(x.tolist() for x in index.statistics(symbols, place[:-1], place[1:] - 1, docs, least))))
        runs = [{tuple(p[i : i + least].tolist()) for i in range(len(p) - least + 1)} for p in texts]
        want = {(k, i) for k, p in enumerate(texts) for i in range(len(p) - least + 1) if any(docs[o] < docs[k] and tuple(p[i : i + least].tolist()) in r for o, r in enumerate(runs))}
        assert len(found) == len(set(found)) and set(found) == want


def test_repeated_rows_of_one_text(spark, odd, tables):
    base = [f"w{i}" for i in range(300)]
    data = [doc(7, " ".join(base))] * 1000 + [doc(9, " ".join(base[:200] + ["x"]))] * 1000 + [doc(8, " ".join(base[100:]))]
    docs = spark.createDataFrame(data, odd.schema)
    out = {(r.doc_id, r.n_removed) for r in substring_dedup.repeat_digests(docs).collect()}
    assert out == {(7, 0), (8, 200), (9, 200)}
    assert tables["anchors"] < 30 * len(data) and all(n < 200 for k, n in tables.items() if k != "anchors")


def test_contamination(spark, odd, none):
    rng = random.Random(8)
    items = [(i, " ".join(f"{rng.choice('bcdf')}{rng.choice('aeiou')}{rng.randrange(40)}" for _ in range(n))) for i, n in enumerate([4, 5, 9, 15, 18, 25, 40, 60])]
    bench = spark.createDataFrame([*items, (None, "x"), (99, None)], "item_id long, text string")
    data, want = [], {}
    for n in range(120):
        i, t = rng.choice(items[1:])
        w = t.split()
        bad = {5: 0, 9: 1}.get(len(w), len(w) // 5)
        if n % 3 == 0 and len(w) >= 12:  # too many changes
            bad = len(w)
        for j in rng.sample(range(len(w)), bad):
            w[j] = f"new{j}"
        fill = [f"f{rng.randrange(500)}" for _ in range(40)]
        at = rng.randrange(41)
        t = " ".join(fill[:at] + w + fill[at:])
        data.append(doc(300 + n, t.upper() if n % 2 else "(" + t + ")!"))
        want[300 + n] = i if bad < len(w) else None
    docs = odd.unionByName(spark.createDataFrame(data, odd.schema))
    out = {r.doc_id: r for r in decontaminate.find_contamination(docs, bench).collect()}
    for i, item in want.items():
        assert out[i].contaminated == (item is not None) and (item is None or item in out[i].item_ids)
    assert not any(out[i].contaminated for i in range(1, 12))
    clean = decontaminate.drop_contaminated(docs, bench)
    assert clean.columns == docs.columns and {r.doc_id for r in clean.collect()} == {i for i, r in out.items() if not r.contaminated}
    assert decontaminate.find_contamination(none, bench).count() == 0 and not any(r.contaminated for r in decontaminate.find_contamination(docs, bench.limit(0)).collect())


def test_contamination_in_blocks(spark, odd, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK", 60)
    bench = spark.createDataFrame([(i, f"a{i} b{i} c{i} d{i} e{i} f{i}") for i in range(9)], "item_id long, text string")
    docs = spark.createDataFrame([doc(i, f"x a{i} b{i} c{i} d{i} e{i} f{i} y") for i in range(12)], odd.schema)
    got = {r.doc_id: r.item_ids for r in decontaminate.find_contamination(docs, bench).collect()}
    assert got == {i: [i] if i < 9 else [] for i in range(12)}
    assert sorted(r.doc_id for r in decontaminate.drop_contaminated(docs, bench).collect()) == [9, 10, 11]


def test_masks_find_all_tolerated_changes():
    from itertools import combinations

    for n in range(12, 21):
        for gone in combinations(range(n), n - -(-80 * n // 100)):
            same = [i not in gone for i in range(n)]
            assert any(all(same[s + p] for p in m) for m in decontaminate.MASKS for s in range(n - m[-1])), (n, gone)
        if n == 15:
            continue


def test_sharding(spark, odd, none):
    data = [doc(1000 + i, f"text {i % 40 if i < 400 else i}") for i in range(900)] + [doc(5000 + i, "hot") for i in range(500)]
    docs = odd.unionByName(spark.createDataFrame(data, odd.schema))
    assigned = sharding.assign_shards(docs, bucket_rows=50).persist()
    out = assigned.collect()
    n = docs.count()
    assert len(out) == n and {r.law for r in out} == {"rows"} and all(r.grown_shard is None for r in out)
    slots = {}
    for r in out:
        slots.setdefault(r.shard, []).append(r.slot)
    assert set(slots) == set(range(24)) and max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    import zlib

    text = {r.doc_id: r.text for r in docs.collect()}
    for r in out:
        t = (text[r.doc_id] or "").encode()
        if r.doc_id is not None:
            assert r.size == len(t) + 8 and r.text_crc32 == zlib.crc32(t)
    groups = {}
    for r in out:
        if r.doc_id is not None and 1000 <= r.doc_id < 1400:
            groups.setdefault(text[r.doc_id], set()).add(r.shard)
    assert np.mean([len(s) for s in groups.values()]) < 2
    assert sharding.assign_shards(none).count() == 0
    # The cut, against counting pairs and against a random start.
    each = Counter((r.size, r.text_crc32) for r in out)
    apart = Counter((r.size, r.text_crc32, r.shard) for r in out)
    edges, cut = sharding.cut_edges(assigned).first()
    pairs = lambda c: sum(v * (v - 1) // 2 for v in c.values())
    assert edges == pairs(each) and cut == pairs(each) - pairs(apart) and cut < edges
    small = docs.where("doc_id between 1000 and 1399")
    e, c = sharding.cut_edges(sharding.assign_shards(small, bucket_rows=50)).first()
    # 40 groups of ten in 24 shards of 17 rows: not all groups can stay whole.
    assert c < 0.75 * e and 0.9 * e < sharding.cut_edges(sharding.assign_shards(small, bucket_rows=50, rounds=0)).first().cut
    # Other files and another order of rows give the same shards.
    key = lambda rows: sorted((str(r.doc_id), r.size, r.text_crc32, r.shard, r.slot) for r in rows)
    assert key(sharding.assign_shards(docs.repartition(7, "text").sortWithinPartitions("source", "text"), bucket_rows=50).collect()) == key(out)


def plain_boosting(x, y, trees, depth, rate, l2, least):
    """Logistic boosting by looking at each cut of each feature with plain sums; trees as nested tuples."""
    cuts = [sorted(set(np.quantile(x[:, j], np.linspace(0, 1, quality_gbt.BINS + 1)[1:-1]).astype(np.float32).tolist())) for j in range(x.shape[1])]
    base = float(np.log(y.mean() / (1 - y.mean())))
    margin, out = np.full(len(y), base), []

    def grow(rows, grad, hess, left):
        G, H = grad[rows].sum(), hess[rows].sum()
        best = (1e-6, None, None)
        for j in range(x.shape[1]) if left else ():
            for c in cuts[j]:
                lo = rows[x[rows, j] <= c]
                if len(lo) >= least and len(rows) - len(lo) >= least:
                    g, h = grad[lo].sum(), hess[lo].sum()
                    gain = g**2 / (h + l2) + (G - g) ** 2 / (H - h + l2) - G**2 / (H + l2)
                    if gain > best[0] + 1e-9:
                        best = (gain, j, c)
        if best[1] is None:
            return rate * G / (H + l2)
        _, j, c = best
        return j, c, grow(rows[x[rows, j] <= c], grad, hess, left - 1), grow(rows[x[rows, j] > c], grad, hess, left - 1)

    def walk(tree, row):
        while isinstance(tree, tuple):
            tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
        return tree

    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        tree = grow(np.arange(len(y)), y - p, p * (1 - p), depth)
        out.append(tree)
        margin += np.array([walk(tree, r) for r in x])
    return lambda rows: base + np.array([sum(walk(t, r) for t in out) for r in rows])


def test_boosting_and_flat_trees_against_plain_ones():
    rng = np.random.default_rng(11)
    x = np.round(rng.normal(size=(400, 5)), 1).astype(np.float32)
    y = ((x[:, 0] > 0.2) ^ (x[:, 3] > 0.5) | (rng.random(400) < 0.1)).astype(float)
    fitted = quality_gbt.fit(x, y, trees=6, depth=3)
    plain = plain_boosting(x, y, 6, 3, 0.12, 5.0, 20)
    new = np.round(rng.normal(size=(300, 5)), 1).astype(np.float32)
    for rows in (x, new):
        assert np.allclose(fitted.margin(rows), plain(rows), atol=1e-5)


def test_quality(spark, odd, none):
    rng = random.Random(4)
    good = lambda: " ".join(rng.choice(["river", "stone", "the", "over", "light", "of", "tree"]) + rng.choice(["", "s", ","]) for _ in range(60)) + "."
    bad = lambda: " ".join(rng.choice(["BUY!!", "$$$", "NOW***", "x#x"]) for _ in range(60))
    data = [doc(2000 + i, good() if i % 3 else bad()) for i in range(600)]
    labels = spark.createDataFrame([(d[0], int(i % 3 > 0), 0) for i, d in enumerate(data)], "doc_id long, quality int, toxic int")
    docs = odd.unionByName(spark.createDataFrame(data, odd.schema))
    out = quality_gbt.classify_quality(docs, labels).collect()
    assert len(out) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in out)
    held = [r for r in out if r.held_out and r.doc_id >= 2000]
    assert held and all(r.predicted == int((r.doc_id - 2000) % 3 > 0) for r in held)
    kept = quality_gbt.keep_good(docs, labels)
    assert kept.columns == docs.columns and sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(r.doc_id) for r in out if r.predicted)
    assert quality_gbt.classify_quality(none, labels).count() == 0 and {r.score for r in quality_gbt.classify_quality(odd, labels.limit(0)).collect()} == {0.5}


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var x="</p>";</script></head><body><header>Site</header><nav><ul><li><a href=/a>Home</a></ul></nav>
<div class="ad banner">Buy</div><article><h1>A &amp; B</h1><p>First <b>bo</b>ld<br>next&nbsp;line<p>Second &lt;x&gt; &#233;</p><aside>side</aside><form><input>f</form><section class=comments><p>nice</section></article>
<aside>more</aside><div id="cookie-notice">ok</div><footer>&copy; x</footer></body></html>"""


def test_extraction():
    assert html_extract.extract(PAGE) == "A & B First bold next line Second <x> é"
    assert html_extract.extract(PAGE[: PAGE.index("Second") + 6]) == "A & B First bold next line Second"
    assert html_extract.extract(None) == "" and html_extract.extract("") == "" and html_extract.extract("<<<>>") is not None
    assert html_extract.extract("<div class=menu>m</div><div><div><p>One two three four five.</p><ul><li>a<li>b</ul></div></div><div>s</div>") == "One two three four five. a b"
    assert html_extract.extract("<p>a</p>" * 5000).count("a") == 5000 and html_extract.extract("<div>" * 3000 + "deep") == "deep"


def test_nothing_beside_the_content_is_lost():
    body, lead = "body words " * 30, "lead words " * 8
    for page in (
        f"<div><h1>Title</h1><div>{lead}</div><div>{body}</div></div>", f"<main><h1>Title</h1><p>{lead}</p><article>{body}</article></main>", f"<h1>Title</h1><div>{lead}</div><article>{body}</article>",
        f"<div><h1 class=main-title>Title</h1><div>{lead}</div><div><div>{body}</div></div></div>", f"<nav>n</nav><div><div><h1>Title</h1></div><div><p>{lead}</p></div><div>{body}</div></div>",
    ):
        assert html_extract.extract(page) == " ".join(f"Title {lead} {body}".split())


def brute_match(a, b):
    """Simple tree matching by its plain recursion."""
    (ka, _, _), (kb, _, _) = html_extract._children(a), html_extract._children(b)

    def w(x, y):
        if a[x, 1] != b[y, 1]:
            return 0
        m = [[0] * (len(kb[y]) + 1) for _ in range(len(ka[x]) + 1)]
        for i, p in enumerate(ka[x], 1):
            for j, q in enumerate(kb[y], 1):
                m[i][j] = max(m[i - 1][j], m[i][j - 1], m[i - 1][j - 1] + w(p, q))
        return 1 + m[-1][-1]

    return w(0, 0)


def test_alignment_has_the_most_nodes():
    rng = random.Random(6)
    for _ in range(60):
        make = lambda: "".join(f"<{t}><i>{rng.randrange(3)}</i>{'<b>x</b>' * rng.randrange(3)}</{t}>" for t in rng.choices(["div", "span", "ul"], k=rng.randrange(1, 6)))
        a, b = (html_extract._skeleton(html_extract.Tree(make()).skeleton()) for _ in range(2))
        at = html_extract.align(a, b)
        assert (at >= 0).sum() == brute_match(a, b)
        assert all(a[i, 1] == b[j, 1] for i, j in enumerate(at) if j >= 0)


def test_alignment_of_long_and_deep_pages(monkeypatch):
    tree = lambda page: html_extract._skeleton(html_extract.Tree(page).skeleton())
    # 150 rows of ids of their own around a template block, more than 10,000 pairs of children.
    long = lambda k: "".join(f"<p id=a{k}_{i}>x</p>" for i in range(150)) + "<div class=share>Share</div>" + "".join(f"<p id=b{k}_{i}>x</p>" for i in range(150))
    at = html_extract.align(tree(long(1)), tree(long(2)))
    assert at[151] == 151 and (at >= 0).sum() == 2
    # Behind node 20,000.
    at = html_extract.align(tree("<p>x</p>" * 21_000 + "<div>end</div>"), tree("<div>end</div>"))
    assert at[21_001] == 1
    # Deep, and different at the bottom and beside it.
    at = html_extract.align(tree("<i></i>" + "<div>" * 2_000 + "<p>a</p><ul></ul>"), tree("<b></b>" + "<div>" * 2_000 + "<ol></ol><p>a</p>"))
    assert (at >= 0).sum() == 2_002
    rng = random.Random(8)
    for whole, short in ((1 << 20, 24), (20, 24), (20, 2), (1 << 20, 2)):
        monkeypatch.setattr(html_extract, "WHOLE", whole)
        monkeypatch.setattr(html_extract, "SHORT", short)
        monkeypatch.setattr(html_extract, "MEMO", 3 if short == 2 else 1 << 19)
        for _ in range(20):
            make = lambda: "".join(f"<{t}>{'<b>x</b>' * rng.randrange(3)}{'<u><s></s></u>' * rng.randrange(2)}</{t}>" for t in rng.choices(["div", "span", "ul"], k=rng.randrange(1, 12)))
            a, b = tree(make()), tree(make())
            at = html_extract.align(a, b)
            assert (at >= 0).sum() == brute_match(a, b)


def test_wrapper_induction(spark):
    rng = random.Random(9)
    text = lambda: " ".join(rng.choice("alpha beta gamma delta epsilon".split()) for _ in range(30))
    bodies = [text() for _ in range(12)]
    data = [(i, "https://h.example/p", f"<html><body><article><p>Share this story today</p><p>{b}</p></article></body></html>") for i, b in enumerate(bodies)]
    data += [(100, None, PAGE), (101, "no host", None), (102, "https://other.example/", PAGE), (100, None, PAGE)]
    out = html_extract.extract_pages(spark.createDataFrame(data, "page_id long, url string, html string")).collect()
    got = {r.page_id: r for r in out}
    assert len(out) == len(data) and [got[i].text for i in range(12)] == bodies and got[102].text.startswith("A & B") and got[101].text == "" and got[101].n_chars == 0
    assert html_extract.extract_pages(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_templates_whatever_the_first_page(spark):
    """Empty, null and cut-off first pages, blocks that some pages have, a second layout, and contents of short texts."""
    box = lambda t: f"<div class=x><div>{t}</div></div>"
    one = lambda i: f"<body><article><p>text {i}</p>{box('Sent from our desk') if i % 2 else ''}<div>Ask us anything</div></article>"
    two = lambda i: f"<body><section id=b><div><article><h2>Daily letter</h2><p>other {i}</p></article></div></section>"
    pages = [None, "", "<bo", "<body><article>"] + [one(i) for i in range(30)] + [two(i) for i in range(12)]
    for first in (0, None):
        data = [(i if i else first, "https://h.example/p", p) for i, p in enumerate(pages)]
        out = html_extract.extract_pages(spark.createDataFrame(data, "page_id long, url string, html string")).collect()
        assert sorted(r.text for r in out) == sorted(["", "", "", ""] + [f"text {i}" for i in range(30)] + [f"other {i}" for i in range(12)])


def test_copies_of_an_article_are_no_template(spark):
    data = [(i, "https://h.example/p", f"<body><article><p>{'same words in all of these pages ' * 6}</p></article><footer>{i}</footer>") for i in range(9)]
    out = html_extract.extract_pages(spark.createDataFrame(data, "page_id long, url string, html string")).collect()
    assert all(r.text.startswith("same words") for r in out)


def test_class_words_mark_no_content():
    """Classes that say what a page has or lacks, heads of articles, and regions that hold the content."""
    extract = html_extract.extract
    assert extract('<body><article class="post has-sidebar"><p>Body text here</p></article>') == "Body text here"
    assert extract('<body><div class="site-content no-comments"><p>Body text here</p></div>') == "Body text here"
    assert extract('<body><div class="content-header"><h1>Title</h1></div><article><p>Body text</p></article>') == "Title Body text"
    assert extract('<body><div class="sidebar-layout"><article><p>Body text here</p></article><div class="sidebar">More</div></div>') == "Body text here"
    assert extract('<body><form id="aspnet"><h1>Title</h1><p>Body text here</p><div class="login-box">Name</div></form>') == "Title Body text here"
    assert extract('<body><div class="widget-page"><p>Body text of some length</p><p>goes on and on</p></div><div class="ad">Buy</div></body>') == "Body text of some length goes on and on"
    assert extract('<body><nav>n</nav><div class="ad">Cut off here') == "" and extract('<body><div class="ad">Buy a lot of it</div><article><h1>T</h1>') == "T"
    assert extract(f'<body><article><p>Short.</p><div class="comments">{"long comment " * 50}</div></article>') == "Short."
    assert extract("<article><p>Let <math>x = 1</math> be</p></article>").split() == ["Let", "x", "=", "1", "be"]


def plain_pages(pages):
    """Texts of pages, the whole way by plain loops: templates from brute-force matching and counting, then the text."""
    H, out, hosts = html_extract, {}, {}
    for i, (_, url, page) in enumerate(pages):
        m = re.match(r"[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]+)", url or "")
        hosts.setdefault(m[1].lower() if m else ("no host", i), []).append(i)
    for host, members in hosts.items():
        trees = {i: H.Tree(pages[i][2] or "") for i in members}
        known = {}
        for i in members if isinstance(host, str) else ():
            texts, chrome = trees[i].own_texts(), trees[i].chrome()
            if texts:
                known[i] = (frozenset(texts.items()), tuple(sorted(t for n, t in texts.items() if not chrome[n])), (tuple(trees[i].parent), tuple(trees[i].label)))
        drop = {i: set() for i in members}
        if len(known) >= H.LEAST_PAGES:
            shapes = {}
            for _, content, shape in known.values():
                shapes.setdefault(shape, set()).add(content)
            best = max(shapes, key=lambda x: len(shapes[x]))
            assert sum(len(x) == len(shapes[best]) for x in shapes.values()) == 1  # the test's pages leave no choice
            ref = trees[min(i for i in known if known[i][2] == best)]
            at = {i: plain_places(trees[i], ref) for i in known}
            seen, same = {}, {}
            for i, (texts, content, _) in known.items():
                for n, t in texts:
                    seen.setdefault(at[i][n], set()).add(content)
                    same.setdefault((at[i][n], t), set()).add(content)
            template = {k for k, c in same.items() if len(c) >= H.LEAST_PAGES and len(c) >= H.SHARE * len(seen[k[0]])}
            listed = {k for k, c in seen.items() if len(c) >= H.MENU_PAGES and len({t for p, t in same if p == k}) <= H.MENU_TEXTS * len(c)}
            drop = {i: set() for i in members}
            for i in known:
                main = {n for n, t in enumerate(trees[i].tags) if t in ("article", "main")}
                for n, t in known[i][0]:
                    up = {n}
                    while (k := min(up)) > 0:
                        up.add(trees[i].parent[k])
                    if (at[i][n], t) in template or (main and not main & up and at[i][n] in listed):
                        drop[i].add(n)
        for i in members:
            tree, chrome = trees[i], trees[i].chrome(drop[i])
            blocks = [""]
            for n, t in tree.items:
                if t is None:
                    blocks.append("")
                elif not chrome[n] and n not in drop[i]:
                    blocks[-1] += html_extract.entities.unescape(t)
            out[i] = " ".join(" ".join(b.split()) for b in blocks if b.strip())
    return out


def plain_places(a, b):
    """The place of each node: its partner in a best matching by plain recursion, or the way from the lowest matched node above."""
    kids = [[[j for j in range(1, len(t.parent)) if t.parent[j] == i] for i in range(len(t.parent))] for t in (a, b)]

    def match(x, y):
        if a.label[x] != b.label[y]:
            return 0, {}
        p, q = kids[0][x], kids[1][y]
        best = {(i, j): (0, {}) for i in range(len(p) + 1) for j in range(len(q) + 1) if not i * j}
        for i in range(1, len(p) + 1):
            for j in range(1, len(q) + 1):
                w, pairs = match(p[i - 1], q[j - 1])
                both = (best[i - 1, j - 1][0] + w, best[i - 1, j - 1][1] | pairs)
                best[i, j] = max(both, best[i - 1, j], best[i, j - 1], key=lambda v: v[0])
        w, pairs = best[len(p), len(q)]
        return w + 1, pairs | {x: y}

    pairs = match(0, 0)[1]
    out = []
    for n in range(len(a.label)):
        way = ()
        while n not in pairs:
            way, n = (a.label[n], *way), a.parent[n]
        out.append((pairs[n], way))
    return out


def test_extraction_against_plain_loops(spark):
    """Hosts with templates in blocks without any telling tag or class, optional blocks, a second layout, and few pages."""
    rng = random.Random(31)
    text = lambda n: " ".join(rng.choice("alpha beta gamma delta epsilon zeta".split()) + str(rng.randrange(90)) for _ in range(n))
    notes = [text(12) for _ in range(3)]

    def page(i, layout):
        body = "".join(f"<p>{text(15)}</p>" for _ in range(3 if i % 7 == 0 else 2))
        if layout == 0:
            extra = f"<section><b>{notes[0]}</b></section>" if i % 3 == 0 else ""
            return f"<body><div class=x1><i>{notes[1]}</i></div><div class=x2><h1>{text(4)}</h1>{body}</div>{extra}<ul><li>{notes[2]}</li><li>{text(2)}</li></ul><nav>{text(3)}</nav></body>"
        return f"<body><table><tr><td>{notes[1]}</td></tr></table><div class=x3>{body}</div></body>"

    pages = [(i, f"https://one.example/{i}", page(i, i % 5 == 4)) for i in range(45)]
    pages += [(100 + i, f"https://few.example/{i}", page(i, 0)) for i in range(4)] + [(200, None, page(1, 0)), (None, "https://one.example/x", page(3, 0)), (201, "https://one.example/y", None)]
    # Menus, notices and adverts that take turns, with nothing that tells them from the article but its tag.
    turns = [[text(6) for _ in range(4)] for _ in range(4)]
    for i in range(40):
        a, b, c, d = turns[i % 4]
        pages.append((300 + i, f"https://turns.example/{i}", f"<body><p>{a}</p><article><h1>{text(3)}</h1><h2>{turns[i % 3][0]}</h2><p>{text(14)}</p></article><div><b>{b}</b></div><p>{c}</p><p>{text(5)}</p></body>"))
    want = plain_pages(pages)
    docs = spark.createDataFrame([(*p, f"t{p[0]}", "h", "s", 1) for p in pages], "page_id long, url string, html string, text string, host string, shape string, node int")
    got = {(r.page_id, r.url): r for r in html_extract.extract_pages(docs).collect()}
    for i, (k, url, _) in enumerate(pages):
        assert got[k, url].text == want[i], (k, url)
        assert got[k, url].n_chars == len(want[i])
    plain = [html_extract.extract(p[2]) for p in pages]
    assert sum(plain[i] != want[i] for i in range(45)) == 45 and all(plain[i] == want[i] for i in range(45, 49))  # the template decides, where there is one
    assert all(n not in want[i] for i in range(45) for n in notes)
    for i, (k, _, p) in enumerate(pages):
        if k is not None and k >= 300:  # of texts that take turns only the one in the article stays
            assert [len(x.split()) for x in re.findall(r"<(?:h1|h2|p)>([^<]*)<", p)] == [6, 3, 6, 14, 6, 5] and len(want[i].split()) == 3 + 6 + 14 + 5


def test_folding_keeps_places():
    import pyarrow as pa

    (_, f), = slices(folded(pa.array(["ÉÑ Straße"])))
    assert f.buf.tobytes().decode() == "éñ straße"


def test_pipeline(spark, tmp_path, odd):
    import corpus_pipeline as pipeline

    rng = random.Random(12)
    words = "river stone light tree cloud road field house water night".split()
    text = lambda n: " ".join(rng.choice(words) + str(rng.randrange(300)) for _ in range(n))
    leak, shared = text(25), text(70)
    base = text(120)
    data = [doc(3000 + i, text(80) + ".") for i in range(200)] + [doc(3200 + i, " ".join(rng.choice(["BUY!!", "$$$", "NOW***"]) for _ in range(60))) for i in range(100)]
    planted = [doc(4000, base), doc(4001, base + " end"), doc(4002, f"{text(30)} {leak} {text(30)}"), doc(4003, f"{text(60)} {shared} {text(60)}"), doc(4004, f"{text(60)}\n{shared}\n{text(60)}")]
    labels = [(d[0], int(d[0] < 3200), 0) for d in data]
    spark.createDataFrame([*data, *planted], odd.schema).select("doc_id", "text", "lang", "source", "n_chars").unionByName(odd.select("doc_id", "text", "lang", "source", "n_chars")).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = {r.doc_id: r for r in pipeline.run(spark, str(tmp_path)).collect()}
    assert 4000 in out and not {4001, 4002} & set(out) and not any(3200 <= (i or 0) < 3300 for i in out)
    assert {3000 + i for i in range(200)} <= set(out) and out[4003].n_tokens - out[4004].n_tokens > 70
    assert [n for n, _ in pipeline.STAGES] == ["quality", "near_dedup", "substring_dedup", "decontamination", "byte_bpe"]


def test_pipeline_of_odd_tables(spark, tmp_path, odd, none):
    """Nulls in all columns, empty tables, repeated rows, and further columns with names that stages use."""
    import corpus_pipeline as pipeline

    more = odd.withColumn("text2", odd["text"]).withColumn("component_id", odd["id"]).withColumn("score2", odd["score"])
    labels = spark.createDataFrame([(1, 1, 0, "t"), (1, 0, 0, "t"), (None, 1, 0, "t"), (6, None, None, None)], "doc_id long, quality int, toxic int, text string")
    bench = spark.createDataFrame([(1, None, 1), (None, "one two three four five", 1), (2, "x y", 1)], "item_id long, text string, doc_id long")
    for name, docs, table, items in (("odd", more, labels, bench), ("empty", none, labels.limit(0), bench.limit(0))):
        at = f"{tmp_path}/{name}"
        docs.write.parquet(f"{at}/documents.parquet"), table.write.parquet(f"{at}/labels.parquet"), items.write.parquet(f"{at}/benchmark.parquet")
        now = spark.read.parquet(f"{at}/documents.parquet")
        for stage, f in pipeline.STAGES[:-1]:
            now = f(spark, now, at)
            assert now.columns == docs.columns, stage
            if name == "empty" and stage == "quality":
                # Without labels all scores are 0.5, so the classifier lets nothing through.
                assert f(spark, more, at).count() == 0
        assert pipeline.run(spark, at).count() == now.count()
