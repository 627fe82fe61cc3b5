"""Inputs of which an operator once did only a part."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from palimpsest.llm import ann, decontaminate, linedup, simhash, urlfilter


def _similar(a, b):
    return len(a & b) >= 0.8 * len(a | b)


def test_near_dedup_finds_a_truncated_copy_whatever_its_shingles_hash_to(spark):
    pairs = []
    for seed in range(400):
        rng = random.Random(seed)
        words = [f"w{rng.randrange(10**6)}" for _ in range(144)]
        a, b = " ".join(words), " ".join(words[:116])
        x, y = (set(simhash.shingle_hashes(t, 5)) for t in (a, b))
        sampled = {h for h in x if h % 16 == 0}
        if sampled and _similar(x, y) and len(sampled & y) < 0.5 * len(sampled):
            pairs += [(2 * seed, a), (2 * seed + 1, b)]
    assert len(pairs) >= 4
    left = simhash.keep_one(spark.createDataFrame(pairs, "doc_id long, text string")).collect()
    assert sorted(r.doc_id for r in left) == [i for i, _ in pairs[::2]]


def test_similar_sets_share_bands_as_often_as_their_similarity_says():
    rng = np.random.default_rng(3)
    for n, kept, similarity in ((200, 160, 0.8), (100, 85, 0.85), (50, 45, 0.9)):  # the second set lies within the first
        sets = []
        for _ in range(1500):
            a = rng.integers(1 << 63, size=n, dtype=np.uint64) * np.uint64(2)
            sets += [a, a[:kept]]
        sizes = np.array([len(x) for x in sets])
        keys = simhash.band_keys(np.concatenate(sets), np.cumsum(sizes) - sizes)
        same = keys[::2] == keys[1::2]
        assert abs(same.mean() - similarity**simhash.BAND) < 0.01 and same.any(axis=1).all()


@pytest.mark.parametrize("bucket", [2048, 30])
def test_near_dedup_does_not_depend_on_how_buckets_are_dealt(spark, monkeypatch, bucket):
    rng = random.Random(8)
    base = [f"w{rng.randrange(5000)}" for _ in range(120)]
    texts = []
    for n in range(260):
        copy = list(base)
        for at in rng.sample(range(120), 1 if n % 2 else 3):
            copy[at] = f"w{rng.randrange(5000)}"
        texts.append(" ".join(copy))
    monkeypatch.setattr(simhash, "BUCKET", bucket)
    sets = [set(simhash.shingle_hashes(t, 5)) for t in texts]
    reached: set[int] = set()
    want = []
    for i in range(len(texts)):
        if i not in reached:
            want.append(i)
            todo = [i]
            while todo:
                x = todo.pop()
                if x not in reached:
                    reached.add(x)
                    todo += [y for y in range(len(texts)) if y not in reached and _similar(sets[x], sets[y])]
    left = simhash.keep_one(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert 1 < len(want) < 200 and sorted(r.doc_id for r in left) == want


def test_links_of_crowds_are_found_by_further_masks(spark):
    rng = random.Random(4)
    prints = {sum(1 << k for k in rng.sample(range(64), rng.randint(0, 7))) for _ in range(400)}
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    df = spark.createDataFrame([(signed(p),) for p in prints], "fingerprint long")
    groups = []
    for bucket in (2048, 12):
        stars = {r.node: r.root for r in simhash.connected(simhash.links(df, bucket=bucket)).collect()}
        of = {}
        for p in prints:
            of.setdefault(stars.get(signed(p), signed(p)), set()).add(p)
        groups.append({frozenset(g) for g in of.values()})
    assert groups[0] == groups[1] and len(groups[0]) > 1


def test_near_dedup_of_crowds_is_that_of_brute_force(spark):
    rng = random.Random(5)
    texts = []
    for _ in range(3):
        base = [f"w{rng.randrange(5000)}" for _ in range(150)]
        for _ in range(200):
            copy = list(base)
            for at in rng.sample(range(150), 2):
                copy[at] = f"w{rng.randrange(5000)}"
            texts.append(" ".join(copy))
    sets = [set(simhash.shingle_hashes(t, 5)) for t in texts]
    root = list(range(len(texts)))

    def of(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if of(i) != of(j) and _similar(sets[i], sets[j]):
                root[max(of(i), of(j))] = min(of(i), of(j))
    left = simhash.keep_one(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert sorted(r.doc_id for r in left) == [i for i in range(len(texts)) if of(i) == i]


@pytest.mark.parametrize(("most_words", "worker_words"), [(300_000, 300_000), (12, 10**6), (4, 10**6), (100, 100), (20, 100)])
def test_decontamination_is_the_same_for_any_number_of_automata_and_passes(spark, most_words, worker_words):
    rng = random.Random(9)
    items = [[f"i{k}x{n}" for n in range(25)] for k in range(8)]
    items += [items[0][5:10] + [f"o{n}" for n in range(10)], [f"o{n}" for n in range(5, 10)] + items[1][:12]]
    texts = []
    for _ in range(60):
        parts = [[f"f{rng.randrange(1000)}" for _ in range(rng.randrange(40))]]
        for _ in range(rng.randrange(1, 5)):
            item = rng.choice(items)
            at = rng.randrange(len(item) - 9)
            parts += [item[at : at + rng.randrange(10, 26)], [f"f{rng.randrange(1000)}" for _ in range(rng.randrange(12))]]
        texts.append(" ".join(w for p in parts for w in p))
    nested = items[2][:5] + items[3][:12] + items[2][5:]  # what a cut joins is a window of another item
    texts += [" ".join([*nested, *(f"g{n}" for n in range(60))]), " ".join(items[0][:6] + items[8] + [f"g{n}" for n in range(60)])]
    windows = {tuple(i[k : k + 10]) for i in items for k in range(len(i) - 9)}

    def hit(words):
        return {k + d for k in range(len(words) - 9) if tuple(words[k : k + 10]) in windows for d in range(10)}

    want = {}
    for n, text in enumerate(texts):
        words = text.split()
        if len(hit(words)) <= 0.5 * len(words):
            while gone := hit(words):
                words = [w for k, w in enumerate(words) if k not in gone]
            want[n] = words
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame([(n, " ".join(i)) for n, i in enumerate(items)], "item_id long, text string")
    got = {r.doc_id: r.text.split() for r in decontaminate.decontaminate(docs, bench, most_words=most_words, worker_words=worker_words).collect()}
    assert 0 < len(want) < len(texts) and got == want


@pytest.mark.parametrize("broadcast_lines", [100, 0])
def test_pipeline_takes_shared_lines_from_texts_that_they_dominate(spark, broadcast_lines):
    menu = "home about contact privacy terms of use and licence"
    rows = [(n, f"{menu}\nown {n}", f"site{n}", 0) for n in range(12)] + [(20, f"{menu}\n\n{menu}", "site1", 0), (21, None, "site2", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long")
    want = {n: f"own {n}" for n in range(12)} | {20: f"{menu}\n\n{menu}", 21: None}
    bad = linedup.boilerplate(docs)
    assert {r.doc_id: r.text for r in linedup.remove_lines(docs, bad, broadcast_lines=broadcast_lines).collect()} == want
    assert {r.doc_id: r.text for r in corpus_pipeline.line_dedup(spark, docs, "").collect()} == want


@pytest.mark.parametrize("step", [0.0, 1e-6])
def test_many_rows_of_one_id_leave_room_for_the_other_neighbours(spark, step):
    rng = np.random.default_rng(2)
    vectors = rng.normal(size=(60, 8))
    vectors[7] = 3 * vectors[0]
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)] + [(7, (vectors[7] * (1 - step * k)).tolist()) for k in range(40)]
    got = ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") == 0).orderBy("rank").collect()
    score = vectors @ vectors[0]
    assert [r.vec_id for r in got] == [i for i in np.argsort(-score).tolist() if i != 0][:20]


def test_queries_of_a_small_group_far_away_find_as_many_as_they_want(spark):
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(size=(3000, 8)) * 0.05 + 1, rng.normal(size=(6, 8)) * 0.05 - 9, rng.normal(size=(7, 8)) * 0.01 + 30 * np.eye(8)[0]])
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(3000, x[3000].tolist())] * 30
    got = ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") >= 2990, list_size=20).collect()
    for q in range(2990, len(x)):
        score = x @ x[q]
        want = set([i for i in np.argsort(-score).tolist() if i != q][:20])
        mine = [r for r in got if r.query_id == q]
        assert sorted(r["rank"] for r in mine) == list(range(1, 21)) and len({r.vec_id for r in mine}) == 20
        if 3000 <= q < 3006:
            assert {i for i in want if 3000 <= i < 3006} <= {r.vec_id for r in mine}


def test_equal_vectors_score_alike_in_all_lists_and_blocks(spark):
    rng = np.random.default_rng(6)
    base = rng.normal(size=(40, 24))
    x = np.repeat(base, 50, axis=0)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = ann.search(df, F.col("vec_id") % 20 == 0, list_size=50, list_cap=70).collect()
    by = {}
    for r in got:
        by.setdefault(r.query_id, []).append(r)
    for q, found in by.items():
        group = int(np.argmax(base @ x[q]))
        want = [i for i in range(group * 50, group * 50 + 50) if i != q][:20]
        assert [r.vec_id for r in sorted(found, key=lambda r: r["rank"])] == want and len({r.score for r in found}) == 1
    assert len(by) == 100


@pytest.mark.parametrize("broadcast_intervals", [100, 0])
def test_list_entries_of_any_depth_cover_captures(spark, broadcast_intervals):
    entries = [("example.com/a/b/c", "three", "add", "2024-01-01"), ("example.com/a/b/c/d/e", "five", "add", "2024-01-01"), ("example.com/a/b", "two", "add", "2024-01-01")]
    urls = ["http://www.example.com/a/b/c", "http://example.com/a/b/c/d/e/f?x=/y", "http://example.com/a/b/cc", "http://example.com/a", "http://example.com", None]
    pages = spark.createDataFrame([(n, u, "2024-02-01 00:00:00") for n, u in enumerate(urls)], "page_id long, url string, fetched_at string")
    list_ = spark.createDataFrame(entries, "pattern string, category string, action string, dated string")
    got = {r.page_id: r.categories for r in urlfilter.evaluate(pages, list_, broadcast_intervals=broadcast_intervals).collect()}
    assert got == {0: "three,two", 1: "five,three,two", 2: "two", 3: "", 4: "", 5: ""}


@pytest.mark.parametrize("worker_words", [1000, 10])
def test_decontamination_leaves_columns_whose_names_clash(spark, worker_words):
    words = {c: " ".join(f"{c}{i}" for i in range(12)) for c in "abc"}
    docs = spark.createDataFrame([(1, words["a"] + " " + "z " * 40, "u"), (2, None, "v"), (3, "q r s", "x"), (4, words["b"], "x")], "doc_id long, text string, hits string")
    docs = docs.select("*", docs.hits.alias("HITS"), docs.doc_id.alias("n_words"))
    items = spark.createDataFrame([(i, t) for i, t in enumerate(words.values())], "item_id long, text string")
    got = decontaminate.decontaminate(docs, items, most_words=10, worker_words=worker_words)
    assert got.columns == docs.columns
    assert sorted(tuple(r) for r in got.collect()) == [(1, " " + "z " * 40, "u", "u", 1), (2, None, "v", "v", 2), (3, "q r s", "x", "x", 3)]


def test_covering_masks_alone_find_similar_texts_within_the_radius(spark):
    """Bands are made such that no two texts share one; then links are those of the fingerprints, as far as the shingles agree."""
    rng, rows = random.Random(4), []
    while len(rows) < 12:
        words = [f"w{rng.randrange(10**6)}" for _ in range(200)]
        rows += [" ".join(words), " ".join(words + ["more"])]
    rows += ["alone " + " ".join(f"v{i}" for i in range(50)), ""]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(rows))), pa.array(range(len(rows))), pa.array(rows)], names=["doc_id", "text_hash", "text"])
    made = pa.Table.from_batches(list(simhash._measured(iter([batch]), 5))).to_pylist()
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    hashes = {r.doc_id: r.h for r in docs.select("doc_id", F.xxhash64("text").alias("h")).collect()}
    texts = [(m["doc_id"], (m["doc_id"], hashes[m["doc_id"]]), m["n"], *(m[f"f{k}"] for k in range(4)), [m["doc_id"] * 100 + k for k in range(simhash.BANDS)] if m["n"] else []) for m in made]
    texts = spark.createDataFrame(texts, "t long, winner struct<doc_id long, text_hash long>, n int, f0 long, f1 long, f2 long, f3 long, keys array<long>")
    near = {(i, i + 1) for i in range(0, 12, 2) if ((made[i]["f0"] ^ made[i + 1]["f0"]) & (1 << 64) - 1).bit_count() <= simhash.RADIUS}
    assert len(near) >= 3
    found = simhash.similar_links(docs, texts, id_col="doc_id", text_col="text", words=5, similarity=0.8)
    assert {(r.a, r.b) for r in found.collect()} == near
    none = simhash.similar_links(docs, texts, id_col="doc_id", text_col="text", words=5, similarity=0.9999)
    assert none.count() == 0
    same = texts.withColumn("f0", F.lit(7).cast("long"))  # one fingerprint for all: the shingles decide
    found = simhash.similar_links(docs, same, id_col="doc_id", text_col="text", words=5, similarity=0.8)
    assert {(r.a, r.b) for r in found.collect()} == {(i, i + 1) for i in range(0, 12, 2)}
