"""The pipeline's stages one after another, over a table with odd rows, each judged on its own input."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from palimpsest.llm import decontaminate, quality, simhash

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    """Name: (input, output) of each stage, written and read again."""
    home = tmp_path_factory.mktemp("stages")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = [(None, None, None, None, None), (9001, "", None, "src1", 0), (9002, "word " * 3000, "en", None, 5), (9003, None, "en", "src2", None), (9004, " \n ", "en", "src3", 3)]
    docs = docs.union(spark.createDataFrame(odd, docs.schema)).union(docs.limit(3))
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(f"{home}/{name}")
        out[name] = (docs, spark.read.parquet(f"{home}/{name}"))
        docs = out[name][1]
    return out


def test_stages_are_the_five_in_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "line_dedup", "near_dedup", "decontamination", "packing"]


def test_columns_stay_and_n_chars_follows(steps):
    for name, (before, after) in list(steps.items())[:-1]:
        assert after.columns == before.columns, name
        assert after.count() <= before.count()
    for name in ("line_dedup", "decontamination"):
        assert steps[name][1].where("n_chars <> length(text)").count() == 0


def test_quality_keeps_what_is_labelled_good(steps, spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    before, after = steps["quality"]
    judged = before.join(labels, "doc_id").select("doc_id", "quality").distinct().join(after.select("doc_id", F.lit(1).alias("kept")).distinct(), "doc_id", "left")
    share = {r.quality: r.share for r in judged.groupBy("quality").agg(F.avg(F.coalesce("kept", F.lit(0))).alias("share")).collect()}
    assert share[1] > 0.95 and share[0] < 0.2
    model = quality.fit(before, labels.where(~quality.held_out()))
    want = Counter(r[0] for r in quality.score(before, model).where("score >= 0.5").select("doc_id").collect())
    assert Counter(r[0] for r in after.select("doc_id").collect()) == want


def test_near_dedup_leaves_no_similar_pair_and_loses_no_group(steps):
    before, after = ([(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()] for df in steps["near_dedup"])
    sets = {t: frozenset(simhash.shingle_hashes(t, 5)) for _, t in before + after}
    similar = lambda a, b: a == b or len(a & b) >= 0.8 * len(a | b)
    left = [sets[t] for _, t in after]
    assert not any(similar(a, b) for i, a in enumerate(left) for b in left[i + 1 :])
    links = {}
    distinct = list(set(sets.values()))
    for i, a in enumerate(distinct):
        links[a] = {b for b in distinct if b != a and similar(a, b)}
    reached, todo = set(), list(left)
    while todo:
        a = todo.pop()
        if a not in reached:
            reached.add(a)
            todo += links[a]
    assert reached == set(distinct)


def test_decontamination_leaves_no_window(steps, spark):
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    before, after = steps["decontamination"]
    assert decontaminate.find_contamination(after, items).where("n_hit > 0").count() == 0
    clean = decontaminate.find_contamination(before, items).where("n_hit = 0").select("doc_id").collect()
    kept = {r.doc_id: r.text for r in after.collect()}
    texts = {r.doc_id: r.text for r in before.collect()}
    assert all(kept[r.doc_id] == texts[r.doc_id] for r in clean)


def test_packing_covers_every_token(steps):
    before, after = steps["packing"]
    rows = after.collect()
    assert {r.doc_id for r in rows} == {r.doc_id for r in before.select("doc_id").collect()}
    covered, whole = {}, {}
    for r in rows:
        covered[r.doc_id] = covered.get(r.doc_id, 0) + r.length
        whole[r.doc_id] = r.doc_tokens
    repeated = {i for i, n in Counter(r.doc_id for r in before.select("doc_id").collect()).items() if n > 1}
    assert all(covered[i] == whole[i] for i in covered if i not in repeated)
    fill = {}
    for r in rows:
        fill[r.sequence_id] = fill.get(r.sequence_id, 0) + r.length
    assert max(fill.values()) <= 2048 and np.mean(list(fill.values())) > 100


def test_run_chains_the_stages_and_empty_input_passes(spark, tmp_path):
    assert corpus_pipeline.run(spark, SF).count() > 0
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        assert docs.count() == 0, name
