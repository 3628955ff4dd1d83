"""Operators that compare rows: Jaccard join, neighbours, decontamination; language ID and the pipeline."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from trailframe.llm import ann, decontam, jaccard, langid, words


def brute_components(rows, percent=80, width=5):
    """Smallest id reachable, from all pairs of sets."""
    sets = {}
    for i, text in rows:
        words = (text or "").encode().lower().split()
        n = len(words)
        s = frozenset(tuple(words[k : k + width]) for k in range(max(1, n - width + 1))) if n else frozenset()
        sets.setdefault(i, []).append(s)
    flat = [(i, s) for i, found in sets.items() for s in found]
    root = list(range(len(flat)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(flat)):
        for b in range(a):
            x, y = flat[a][1], flat[b][1]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                root[find(a)] = find(b)
    low = {}
    for a, (i, _) in enumerate(flat):
        low[find(a)] = min(low.get(find(a), i), i)
    return sorted((i, len(s), low[find(a)]) for a, (i, s) in enumerate(flat))


def edited(rng, words, times):
    words = list(words)
    for _ in range(times):
        words[rng.randrange(len(words))] = f"e{rng.random()}"
    return words


def test_jaccard_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "HOT_MORE", 3)
    monkeypatch.setattr(jaccard, "HOT_TIMES", 0)
    monkeypatch.setattr(jaccard, "BLOCK_ROWS", 8)
    rng = random.Random(2)
    vocabulary = [f"w{i}" for i in range(800)]
    texts = [None, "", " \n ", "one two", "One TWO", "a b c d e", "é É ß x y z", "word " * 30_000]
    shared = rng.choices(vocabulary, k=60)
    for size in (6, 20, 63, 70, 78, 250, 270, 318, 600, 1100):
        base = rng.choices(vocabulary, k=size)
        texts += [" ".join(base)] * 2
        texts += [" ".join(edited(rng, base, rng.randint(1, max(1, size // 25)))) for _ in range(6)]
        texts += [" ".join(base[: max(1, int(size * f))]) for f in (0.8, 0.83, 0.9)]
        texts += [" ".join(rng.choices(vocabulary, k=size // 3) + shared)]
    base = rng.choices(vocabulary, k=140)
    texts += [" ".join(edited(rng, base, 4)) for _ in range(40)]  # many near copies, a part of them over the bound
    rows = [(1000 - i, t) for i, t in enumerate(texts)] + [(1000, None), (995, "a b c d e"), (None, "a b c d e")]
    df = spark.createDataFrame([(i, t, "x", 0) for i, t in rows], "doc_id long, text string, cls string, n int").repartition(5)
    got = jaccard.jaccard_join(df).collect()
    assert sum(r.doc_id is None for r in got) == 1 and len(got) == len(rows)
    ids = [r for r in rows if r[0] is not None]
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got if r.doc_id is not None) == brute_components(ids)
    assert jaccard.jaccard_join(df.limit(0)).count() == 0


def test_sketches_bound_the_difference():
    rng = np.random.default_rng(1)
    counts = rng.integers(0, 50, jaccard.LEAST_CELLS)
    for size in (5, 64, 79, 300, 1500):
        for _ in range(20):
            s = np.unique(rng.integers(0, 1 << 63, size, np.uint64) * np.uint64(2))
            far = len(s) // 4 * 4 // 5
            t = np.unique(np.r_[s[far // 2 :], rng.integers(0, 1 << 63, far - far // 2, np.uint64) * np.uint64(2)])
            flat, off = np.r_[s, t], np.array([0, len(s), len(s) + len(t)])
            x, y = jaccard.sketches(flat, off).view(np.uint64)
            assert int(np.bitwise_count(x ^ y).sum()) <= len(np.setxor1d(s, t))
            sig, _, owner = jaccard.signatures(flat, off, counts, 80)
            if 100 * len(np.intersect1d(s, t)) >= 80 * len(np.union1d(s, t)):
                assert np.intersect1d(sig[owner == 0], sig[owner == 1]).size


def test_word_hashes_know_words_and_texts():
    texts = [b"", b"One  two\t", b"one\x0btwo", "é É x\u3000y".encode(), b"\x00", b"   ", b"t" * 3000, b"two one"]
    hasher = words.Hasher(jaccard.GAPS)
    data, begin = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
    h, at = hasher(data, begin)
    split = [t.lower().split() for t in texts]
    assert np.diff(at).tolist() == [len(w) for w in split]
    flat = [w for t in split for w in t]
    assert [[a == b for b in h] for a in h] == [[a == b for b in flat] for a in flat]
    import pyarrow as pa

    column = pa.array([b"zz", *texts, None], pa.binary()).slice(1)
    assert [(i, j) for i, j, *_ in words.slices(column, 8)][-1][1] == 9 and b"".join(d.tobytes() for _, _, d, _ in words.slices(column, 8)) == b"".join(texts)


def test_neighbours_reach_the_recall(spark):
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(10, 64))
    x = (0.3 * centres[rng.integers(0, 10, 3000)] + rng.normal(size=(3000, 64))).astype(np.float32)
    x[5] = x[6] = x[700] = x[100]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    bad = [(3000, None), (3100, [0.0] * 64), (3200, [float("nan")] * 64), (3300, [None] + [1.0] * 63), (3400, [1.0] * 3), (3500, [])]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows + bad], "vec_id long, embedding array<float>, rank int")
    got = ann.nearest(df, df.where("vec_id % 100 = 0"), slabs=16, reach=1, orderings=12).collect()
    found = {}
    for r in sorted(got, key=lambda r: (r.query_id, r.rank)):
        found.setdefault(r.query_id, []).append(r.vec_id)
    full = x.astype(np.float64)
    truth = ann.brute_force(full, np.arange(3000), np.arange(0, 3000, 100), 10)
    assert found.keys() == truth.keys() and all(len(v) == 10 for v in found.values())
    assert np.mean([len({*found[q]} & {*truth[q]}) / 10 for q in truth]) >= 0.9
    assert found[100][:3] == [5, 6, 700]
    for r in got[:50]:
        assert r.score == pytest.approx(float(np.sqrt(((full[r.query_id] - full[r.vec_id]) ** 2).sum())), rel=1e-12)
    few = ann.nearest(df.where("vec_id < 4"), df.where("vec_id = 0"), orderings=4, slabs=4, reach=4).collect()
    assert sorted((r.rank, r.vec_id) for r in few) == sorted((i, v) for i, v in enumerate(ann.brute_force(full[:4], np.arange(4), [0], 3)[0], 1))
    assert ann.nearest(df.limit(0), df.limit(0)).count() == 0


def touched(x, curves, reach):
    """The mean share of the rows in the merged windows of a query."""
    rows = np.zeros((len(x) // 100, len(x)), bool)
    for t in range(len(curves.bounds)):
        slab = curves.slabs(x, t)
        rows |= np.abs(slab[None, :] - slab[::100][: len(rows), None]) <= reach
    return rows.mean()


def recall(spark, x, **settings):
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    found = {}
    for r in ann.nearest(df, df.where("vec_id % 100 = 0"), **settings).collect():
        found.setdefault(r.query_id, set()).add(r.vec_id)
    truth = ann.brute_force(x.astype(np.float64), np.arange(len(x)), np.arange(0, len(x), 100), 10)
    return np.mean([len(found.get(q, set()) & {*truth[q]}) / 10 for q in truth])


def test_registered_setting_reaches_the_recall_without_clusters(spark):
    x = np.random.default_rng(5).normal(size=(3000, 64))
    assert recall(spark, (x / np.linalg.norm(x, axis=1)[:, None]).astype(np.float32)) >= 0.9


def test_clustered_vectors_touch_a_fifth_of_the_rows(spark):
    rng = np.random.default_rng(6)
    x = (rng.normal(size=(60, 64))[rng.integers(0, 60, 6000)] + 0.25 * rng.normal(size=(6000, 64))).astype(np.float32)
    assert touched(x.astype(np.float64), ann.fit(x.astype(np.float64), 5, 64), 1) <= 0.2
    assert recall(spark, x, orderings=5, slabs=64, reach=1) >= 0.9


def test_repeated_and_null_ids(spark):
    rows = [(1, [1.0, 0.0])] * 30 + [(2, [1.0, 0.1]), (3, [0.9, 0.0]), (None, [1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = ann.nearest(df, df.where("vec_id = 2"), k=5, orderings=2, slabs=2, reach=2).collect()
    assert sorted((r.query_id, r.rank, r.vec_id) for r in got) == [(2, 1, 1), (2, 2, 3)]


def test_many_equal_vectors_are_dealt(spark, monkeypatch):
    monkeypatch.setattr(ann, "CHUNK_ROWS", 50)
    df = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(400)] + [(400, [5.0, 5.0])], "vec_id long, embedding array<float>")
    got = ann.nearest(df, df.where("vec_id = 100"), k=3, orderings=2, slabs=4, reach=1).collect()
    assert sorted((r.rank, r.vec_id, r.score) for r in got) == [(1, 0, 0.0), (2, 1, 0.0), (3, 2, 0.0)]


def word_edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, old = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
    return row[-1]


def test_edits_within_equal_brute_force():
    rng = random.Random(4)
    for _ in range(60):
        item, text = [[rng.randrange(4) for _ in range(n)] for n in (rng.randint(1, 7), rng.randint(0, 9))]
        want = min(word_edits(item, text[i:j]) for i in range(len(text) + 1) for j in range(i, len(text) + 1))
        assert decontam.edits_within(np.array(item, np.uint64), np.array(text, np.uint64))[0] == want


def test_decontamination_finds_edited_items(spark, monkeypatch):
    rng = random.Random(6)
    vocabulary = [f"w{i}" for i in range(3000)]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.randint(10, 60)))) for i in range(60)] + [(60, None), (61, ""), (62, "tiny item")]
    docs, want = [(0, None), (1, ""), (2, "x " * 50_000), (3, "Tiny, ITEM!")], {(3, 62)}
    for d in range(4, 400):
        words = rng.choices(vocabulary, k=rng.randint(5, 200))
        if d % 2:
            i = rng.randrange(60)
            item = items[i][1].split()
            item = [w.upper() + "," if rng.random() < 0.5 else w for w in (edited(rng, item, len(item) // 20) if d % 3 else item)]
            at = rng.randrange(len(words))
            words[at:at] = item
            want.add((d, i))
        docs.append((d, " ".join(words)))
    df = spark.createDataFrame([(i, t, "own") for i, t in docs], "doc_id long, text string, item_id string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontam.find_items(df, bench).collect()
    pairs = {(r.doc_id, r.item_id) for r in got}
    assert pairs <= want and len(pairs) >= 0.97 * len(want)
    exact = {(d, i) for d, i in want if d % 3 == 0 and d != 3} | {(3, 62)}
    assert exact <= pairs
    for r in got[:40]:
        assert r.edits <= r.item_words // 5 and abs(r.end_word - r.first_word - r.item_words) <= r.edits
    kept = decontam.remove_contaminated(df, bench)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {d for d, _ in docs} - {d for d, _ in pairs}
    monkeypatch.setattr(decontam, "BLOCK_CHARS", 4000)  # several passes
    assert {(r.doc_id, r.item_id) for r in decontam.find_items(df, bench).collect()} >= exact
    assert decontam.find_items(df, bench.limit(0)).count() == 0 and decontam.find_items(df.limit(0), bench).count() == 0


@pytest.mark.parametrize("n", [1, 2, 4, 5, 7, 8, 9, 10, 11, 16, 25, 40, 60, 100])
def test_decontamination_reaches_the_recall_at_every_length(n):
    """Planted items with 5, 10, 15 and 20 % of their words edited; an exhaustive edit search is the truth."""
    rng = random.Random(n)
    vocabulary = [f"w{i}" for i in range(400)]
    items = [(i, " ".join(rng.choices(vocabulary, k=n))) for i in range(40)]
    matcher, hasher = decontam.Matcher(items, 20), decontam.Hasher(decontam.GAPS)
    for percent in (0, 5, 10, 15, 20):
        edits, texts = n * percent // 100, []
        for _, item in items:
            w = item.split()
            for _ in range(edits):
                at, kind = rng.randrange(len(w)), rng.random()
                w[at : at + (kind < 0.75)] = [] if kind < 0.25 else [rng.choice(vocabulary)]
            texts.append(" ".join(rng.choices(vocabulary, k=30) + w + rng.choices(vocabulary, k=30)).encode())
        data, begin = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
        found = {(t, i): e for t, i, e, *_ in matcher.find(data, begin, hasher)}
        flat, at = hasher(data, begin)
        truth = {
            (t, i): e
            for t in range(0, 40, 4)
            for i, (_, w) in enumerate(matcher.items)
            if (e := decontam.edits_within(w, flat[at[t] : at[t + 1]])[0]) <= n // 5
        }
        assert all((i, i) in truth for i in range(0, 40, 4))
        assert sum(found.get(k) == e for k, e in truth.items()) >= 0.9 * len(truth)
        assert {k for k in found if k[0] % 4 == 0} <= truth.keys() and sum((i, i) in found for i in range(40)) >= 36


def test_decontamination_tells_the_first_of_equal_places(spark):
    df = spark.createDataFrame([(1, "a b c d x a b c d", 1), (1, "a b c d x a b c d", 1)], "doc_id long, text string, edits int")
    items = spark.createDataFrame([(1, "a b c d"), (2, "A, b; C d")], "item_id long, text string")
    assert sorted((r.item_id, r.first_word, r.end_word) for r in decontam.find_items(df, items).collect()) == [(1, 0, 4)] * 2 + [(2, 0, 4)] * 2


WORDS = {"en": "the of and that with this from have", "fr": "le les des que pour avec dans être", "de": "der die und nicht mit für über schön"}


def test_language_id_on_held_out_rows(spark):
    rng = random.Random(8)
    rows = [(i, " ".join(rng.choices(WORDS[lang := rng.choice([*WORDS])].split(), k=rng.randint(3, 120))), lang, "s") for i in range(900)]
    rows += [(900, None, "en", "s"), (901, "", "en", "s"), (902, "123 !?", "en", "s"), (903, "the of that " * 20_000, None, "s"), (None, "le les des que", "fr", "s")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string").repartition(4)
    got = {r.doc_id: r for r in langid.identify(df).collect()}
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got.values())
    held = [(i, lang) for i, _, lang, _ in rows[:900] if zlib.crc32(str(i).encode()) % 3 == 1]
    assert all(got[i].held_out for i, _ in held) and sum(r.held_out for r in got.values()) == len(held) + sum(zlib.crc32(str(i).encode()) % 3 == 1 for i in range(900, 904))
    assert np.mean([got[i].lang_pred == lang for i, lang in held]) > 0.95
    assert [got[i].lang_pred for i in (900, 901, 902, 903, None)] == ["und", "und", "und", "en", "fr"]
    kept = langid.keep_identified(df)
    assert kept.columns == df.columns and kept.where("doc_id in (900, 901, 902)").count() == 0 and kept.count() >= 890
    assert langid.identify(df.limit(0)).count() == 0
    assert {r.lang_pred for r in langid.identify(df.withColumn("lang", df.lang.substr(9, 9)).withColumn("lang", df.score.substr(9, 1))).collect()} <= {"und", ""}


def test_held_out_rows_teach_nothing(spark):
    rows = [(i, "only held out words", "xx") for i in range(50) if zlib.crc32(str(i).encode()) % 3 == 1]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert {r.lang_pred for r in langid.identify(df).collect()} == {"und"}


def test_pipeline_on_a_fixture(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(9)
    item = " ".join(rng.choices(WORDS["en"].split() + ["item"], k=20))
    docs = [(i, " ".join(rng.choices(WORDS["en"].split(), k=40)) + f" a{i}.b@c.example.com", "en", f"s{i % 3}", 0) for i in range(60)]
    docs += [(60, docs[3][1], "en", "s0", 0), (61, docs[4][1] + " more", "en", "s0", 0), (62, item + " and", "en", "s1", 0), (63, None, None, None, None), (64, "", "en", "s1", 0), (65, "1 2 3", None, "s1", 0)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    ids = {r.doc_id for r in out}
    assert ids and not ids & {60, 61, 62, 63, 64, 65}
    assert not any(f"a{r.doc_id}.b@c.example.com" in r.text for r in out if r.doc_id > 9)
    current = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns = current.columns
    for _, stage in corpus_pipeline.STAGES[:-1]:
        current = stage(spark, current, str(tmp_path))
        assert current.columns == columns
    assert current.count() == 60 and corpus_pipeline.STAGES[-1][1](spark, current.limit(0), str(tmp_path)).count() == 0


def test_near_copies_go_by_row(spark):
    import corpus_pipeline

    one, two, three = (" ".join(f"{w}{i}" for i in range(60)) for w in "abc")
    rows = [(1, one), (5, one), (5, two), (7, three), (7, three), (None, three), (None, one), (9, "")]
    docs = spark.createDataFrame(rows + rows[-1:], "doc_id long, text string")
    got = [tuple(r) for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect()]
    assert sorted(got) == [(1, one), (5, two), (7, three), (9, ""), (9, "")]


def test_stages_take_empty_tables_and_clashing_names(spark, tmp_path):
    import corpus_pipeline

    spark.createDataFrame([(0, "an item of some words that stands here")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    clash = ("row", "other", "_r", "_id", "_row", "_kept", "n", "component_id", "found", "made", "held_out", "h", "most")
    rows = [(i, " ".join(WORDS["en"].split() * (1 + i)), "en", "s", 0) for i in range(6)] + [(None, None, None, None, None), (9, "the of and " * 30_000, "en", "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumns({c: F.lit(c) for c in clash})
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
        out = stage(spark, docs, str(tmp_path))
        assert out.columns[: len(docs.columns)] == docs.columns and (name == "mix" or out.columns == docs.columns)
        assert out.where(" or ".join(f"{c} <> '{c}'" for c in clash)).count() == 0


def test_sample_is_the_rows_with_the_smallest_hashes(spark, monkeypatch):
    monkeypatch.setattr(ann, "SAMPLE", 100)
    rows = spark.range(3000).selectExpr("id", "array(cast(id as double)) as v").repartition(5)
    want = [r.v for r in rows.orderBy(F.xxhash64("id")).limit(100).collect()]
    assert [r.v for r in ann.sampled(rows)] == want
    assert len(ann.sampled(rows.where("id < 50"))) == 50
    assert len(ann.sampled(rows.selectExpr("7L as id", "v"))) == 100
