"""Ranked search, embedding near-duplicates and vector codes against brute force."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from trailframe.llm import codes, lexical, neardup


def words_of(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", low)


def brute_ranking(docs, items, k=10):
    held = [(i, Counter(words_of(t)), len(words_of(t))) for i, t in docs]
    n, total = sum(c > 0 for _, _, c in held), sum(c for _, _, c in held)
    df = Counter(w for _, c, _ in held for w in c)
    weight = {w: math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) for w in df}
    out = []
    for item, text in items:
        scored = []
        for i, c, size in held:
            m = 25 + (75 * size * n) // total if total else 0
            s = sum(weight[w] * ((10**9 * c[w]) // (1000 * c[w] + 8 * m)) for w in words_of(text) if w in c)
            if s > 0:
                scored.append((-s, i is None, i if i is not None else 0))
        out += [(item, r, None if none else i, -s) for r, (s, none, i) in enumerate(sorted(scored)[:k], 1)]
    return out


def ordered(rows):
    return sorted(rows, key=lambda r: tuple((x is None, x or 0) for x in r))


def texts(seed, n):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    share = [1 / (i + 1) for i in range(400)]
    out = [(i, " ".join(rng.choices(vocabulary, share, k=rng.randint(1, 120)))) for i in range(n)]
    out += [(n, None), (n + 1, ""), (n + 2, "?! --"), (n + 3, "Ünïcode ΣΑΣ w1 W1 w1_w2 x\x7fy"), (None, "w1 w2"), (5, "w1 w2"), (5, "w1 w2"), (n + 4, "w1 " * 50_000 + "w399")]
    items = [(i, " ".join(rng.choices(vocabulary, share, k=rng.randint(1, 60)))) for i in range(12)]
    items += [(1, items[0][1]), (None, "w1 w2 w2"), (77, "nowhere"), (78, None), (79, "?"), (80, "ünïcode Ünïcode σας")]
    passage = rng.choices(vocabulary, k=40)
    return [*out, *((1000 + i, " ".join(passage)) for i in range(15))], [*items, (99, " ".join(passage))]


@pytest.mark.parametrize(("block", "postings", "docs"), [(128, 2_000_000, 16_384), (2, 300, 60), (1, 5000, 7)])
def test_ranking_equals_brute_force(spark, monkeypatch, block, postings, docs):
    monkeypatch.setattr(lexical, "BLOCK", block)
    monkeypatch.setattr(lexical, "SEGMENT_POSTINGS", postings)
    monkeypatch.setattr(lexical, "SEGMENT_DOCS", docs)
    monkeypatch.setattr(lexical, "RAISE", 2)
    rows, items = texts(block, 300)
    table = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, term string").repartition(3)
    found = lexical.ranked_search(table, spark.createDataFrame(items, "item_id long, text string"))
    assert ordered((r.item_id, r.rank, r.doc_id, r.score) for r in found.collect()) == ordered(brute_ranking(rows, items))


def test_ranking_in_blocks_of_items_and_on_empty_tables(spark, monkeypatch):
    monkeypatch.setattr(lexical, "ITEM_CHARS", 500)
    rows, items = texts(9, 80)
    docs, asked = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = lexical.ranked_search(docs, asked, k=3).collect()
    assert ordered((r.item_id, r.rank, r.doc_id, r.score) for r in got) == ordered(brute_ranking(rows, items, 3))
    assert lexical.ranked_search(docs.limit(0), asked).count() == 0
    assert lexical.ranked_search(docs, asked.limit(0)).count() == 0
    assert lexical.ranked_search(docs.where("text is null or text = ''"), asked).count() == 0


def test_blocks_below_the_threshold_stay_closed():
    """A segment with one long list of a common term: blocks without a document that can reach the threshold aren't opened."""
    rows = [(i, np.array([7] * (1 if i % 1000 else 40) + ([9] if i in (3, 4000) else []), np.uint64)) for i in range(8192)]
    held = lexical.Segment()
    for i, h in rows:
        held.add(np.array([i]), h, np.array([len(h)]))
    segment = lexical.opened(list(held.rows(0, 8192, sum(len(h) for _, h in rows))))
    found, score = segment.best(np.array([7, 9]), np.array([10, 5000]), 2, 1)
    assert sorted(found[np.argsort(-score)][:2].tolist()) == [3, 4000]
    opened = (~segment.closed).sum()
    found, _ = segment.best(np.array([7, 9]), np.array([10, 5000]), 2, int(np.sort(score)[-2]))
    assert set(found.tolist()) >= {3, 4000}
    fresh = lexical.opened(list(held.rows(0, 8192, sum(len(h) for _, h in rows))))
    fresh.best(np.array([7, 9]), np.array([10, 5000]), 2, int(np.sort(score)[-2]))
    assert (~fresh.closed).sum() <= 3 < opened


def test_packed_numbers_come_back():
    values = np.array([0, 1, 127, 128, 16_383, 16_384, 2**31, 2**40, 5])
    data, at = lexical.packed(values)
    assert lexical.unpacked(data).tolist() == values.tolist()
    assert lexical.unpacked(data[at[3] : at[5]]).tolist() == [128, 16_383]


def brute_links(rows, threshold):
    def fine(v, label):
        return label is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)

    n, links = len(rows), [0] * len(rows)
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(n):
        for b in range(a):
            (_, v, k), (_, w, j) = rows[a], rows[b]
            if not (fine(v, k) and fine(w, j) and k == j and len(v) == len(w)):
                continue
            v, w = (np.array(x) / np.abs(x).max() for x in (v, w))
            if (v @ w) / math.sqrt((v @ v) * (w @ w)) >= threshold:
                links[a] += 1
                links[b] += 1
                root[find(a)] = find(b)
    low = {}
    for a in range(n):
        ids = [rows[b][0] for b in range(n) if find(b) == find(a) and rows[b][0] is not None]
        low[a] = min(ids, default=None)
    return ordered((rows[a][0], links[a], low[a], rows[a][0] == low[a]) for a in range(n))


def vectors(seed, dims, groups, noise=0.1):
    rng = np.random.default_rng(seed)
    rows, i = [], 100
    for g in range(groups):
        base = rng.normal(size=dims)
        base /= np.linalg.norm(base)
        for _ in range(int(rng.integers(1, 12))):
            d = rng.normal(size=dims)
            rows.append((i, (base + noise * rng.random() * 2 * d / np.linalg.norm(d)).astype(np.float32).astype(float).tolist(), g % 3))
            i += 1
    same = rows[0][1]
    rows += [(3, same, 0), (3, same, 0), (None, same, 0), (4, same, 1), (5, same, None), (6, None, 0), (7, [0.0] * dims, 0), (8, [float("nan")] * dims, 0), (9, [None] * dims, 0)]
    return [*rows, (10, [], 0), (11, same[:-1], 0), (12, same[:-1], 0), (13, [x * 3 for x in same], 0), (14, [x * 1e200 for x in same], 0), (15, [-x for x in same], 0)]


@pytest.mark.parametrize(("dims", "tables", "block", "sigmas"), [(64, None, 2048, None), (64, (3, 24), 4, None), (17, (2, 16), 3, None), (2, None, 5, None), (64, (4, 40), 2048, 6.0)])
def test_near_duplicates_equal_brute_force(spark, monkeypatch, dims, tables, block, sigmas):
    monkeypatch.setattr(neardup, "BLOCK_ROWS", block)
    rows = vectors(dims, dims, 30)
    table = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, label int, key string").repartition(3)
    got = neardup.near_duplicates(table, sigmas=sigmas, tables=tables).collect()
    assert ordered((r.vec_id, r.n_links, r.component_id, r.kept) for r in got) == brute_links(rows, 0.98)
    assert neardup.near_duplicates(table.limit(0)).count() == 0


def test_estimates_are_unbiased_and_bounds_hold():
    rng = np.random.default_rng(5)
    u = neardup.unit_rows(rng.normal(size=(400, 64)))
    code, factor, lost, low, step, _ = neardup.encoded(u, 1)
    signs = (np.unpackbits(code, axis=1) * 2.0 - 1) / 8
    turned = u @ neardup.rotations(64, 1)
    true, estimate = u @ u.T, (turned @ signs.T) / factor
    off = ~np.eye(400, dtype=bool)
    assert abs((estimate - true)[off].mean()) < 0.002
    spread = np.sqrt(1 - factor**2) / factor * np.sqrt(np.maximum(0, 1 - true**2)) / math.sqrt(63)
    z = (estimate - true)[off] / spread[off]
    assert 0.9 < z.std() < 1.1 and np.abs(z).max() <= math.sqrt(63) + 1e-6
    bits, tables = neardup.tables_for(10**9, 0.98)
    assert (1 - (1 - math.acos(0.98) / math.pi) ** bits) ** tables <= 1e-6


def brute_codes(rows, parts=8, entries=16, rounds=6):
    kept = [(i, [math.floor(4096 * x) for x in v], k) for i, v, k in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    size = -(-len(kept[0][1]) // parts)
    kept = [(i, v + [0] * (parts * size - len(v)), k) for i, v, k in kept]
    out, books = [[0, []] for _ in kept], []
    for p in range(parts):
        own = [tuple(v[p * size : (p + 1) * size]) for _, v, _ in kept]
        book = list(own[:entries])

        def nearest(x, book):
            return min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), j) for j, c in enumerate(book))

        for _ in range(rounds):
            groups = {}
            for x in own:
                groups.setdefault(nearest(x, book)[1], []).append(x)
            book = [tuple(sum(c) // len(groups[j]) for c in zip(*groups[j], strict=True)) if j in groups else c for j, c in enumerate(book)]
        books += book
        for o, x in zip(out, own, strict=True):
            far, j = nearest(x, book)
            o[0] += far
            o[1].append(f"{j:02x}")
    total = Counter()
    for (_, _, k), (far, _) in zip(kept, out, strict=True):
        total[k] += far
    digest = hashlib.sha256(",".join(str(c) for b in books for c in b).encode()).hexdigest()
    return ordered((i, "".join(code), far, total[k]) for (i, _, k), (far, code) in zip(kept, out, strict=True)), digest


@pytest.mark.parametrize(("n", "dims", "grid"), [(300, 64, 0), (300, 64, 3), (9, 16, 0), (150, 20, 2)])
def test_codes_equal_brute_force(spark, n, dims, grid):
    """grid: components from few values, so that many distances are equal."""
    rng = np.random.default_rng(n + dims)
    x = rng.normal(size=(n, dims)) / 8 if not grid else rng.integers(0, grid, size=(n, dims)) / 4096
    rows = [(int(i) * 3, v.tolist(), None if i % 7 == 0 else int(i % 4)) for i, v in enumerate(x.astype(np.float32))]
    rows += [(rows[1][0], rows[1][1], 2), (None, rows[2][1], 2), (1, None, 0), (2, [None] * dims, 0), (4, [float("inf")] * dims, 0), (5, [0.0] * dims, 1)]
    table = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, label int, code string").repartition(3)
    coded, books = codes.compress(table)
    got = ordered((r.vec_id, r.code, r.error, r.label_error) for r in codes.with_label_errors(coded).collect())
    assert (got, codes.digest(books)) == brute_codes(rows)


def test_codes_of_few_rows_and_of_large_components(spark):
    schema = "vec_id long, embedding array<double>, label int"
    assert codes.compress(spark.createDataFrame([], schema))[0].count() == 0
    table = spark.createDataFrame([(1, [1e300] * 8, 0), (2, [4e4] * 8, 0), (3, [1.0] * 7, 0)], schema)
    assert [r.vec_id for r in codes.compress(table)[0].collect()] == [2]
    big = np.array([[2**27 - 1] * 8, [-(2**27)] * 8, [2**27 - 2] * 8])
    entry, far = codes.nearest_entries(big, np.array([[2**27 - 2] * 8, [2**27 - 1] * 8]))
    assert entry.tolist() == [1, 0, 0] and far[1] == 8 * (2**28 - 2) ** 2
