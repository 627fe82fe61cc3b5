"""Files, tables, streams, SQL, and the registered queries."""

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from palimpsest import Scrubber, Token, TokenMap
from palimpsest.plans import catalogue
from palimpsest.sources import findings_json, findings_tsv, read_text_files, read_tokens, write_cleaned, write_tokens
from palimpsest.sql import clean_view, findings_view, register_table_function
from palimpsest.streaming import clean_stream, findings_per_window, number_stream, stream_tokens

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def test_files_and_tables(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/b.txt").write_bytes(b"b: x@y.io\r\nnext")
    (tmp_path / "in/a.txt").write_text("a: a@b.io")
    docs = read_text_files(spark, str(tmp_path / "in"))
    assert [(r.document.rpartition("/")[2], r.text) for r in docs.orderBy("doc_ord").collect()] == [("a.txt", "a: a@b.io"), ("b.txt", "b: x@y.io\nnext")]
    result = Scrubber(renderer=Token(include_count=True), tokens=TokenMap(keep_originals=True)).scrub_documents(docs)
    write_cleaned(result.documents, f"{tmp_path}/out")
    assert sorted(r.text for r in spark.read.parquet(f"{tmp_path}/out").collect()) == ["a: {{EMAIL-0}}", "b: {{EMAIL-1}}\nnext"]
    write_tokens(result.tokens, f"{tmp_path}/tokens")
    assert not (tmp_path / "tokens/originals").exists()
    assert {r.key: r["index"] for r in read_tokens(spark, f"{tmp_path}/tokens").counts.collect()} == {"email:a@b.io": 0, "email:x@y.io": 1}
    write_tokens(result.tokens, f"{tmp_path}/more", include_originals=True)
    assert read_tokens(spark, f"{tmp_path}/more", originals=True).original_of("{{EMAIL-1}}") == "x@y.io"
    assert findings_tsv(result.findings).count() == findings_json(result.findings).count() == 2
    assert "a@b.io" not in "".join(r.value for r in findings_json(result.findings).collect())


def test_null_texts_and_names(spark):
    docs = spark.createDataFrame([("a", 0, None), (None, 1, "x@y.io"), ("c", 2, "")], "document string, doc_ord long, text string")
    for renderer in (Token(), Token(include_count=True)):
        out = {r.doc_ord: r.text for r in Scrubber(renderer=renderer).clean_documents(docs).collect()}
        assert out[0] is None and out[2] == "" and out[1].startswith("{{EMAIL")


@pytest.fixture
def arriving(spark, tmp_path):
    """Three files, each a batch."""
    for i, text in enumerate(["x a@b.io", "y c@d.io a@b.io", "z c@d.io e@f.io"]):
        spark.createDataFrame([(str(i), i, text, f"2024-01-01 00:{5 * i:02d}:00")], "document string, doc_ord long, text string, at string").withColumn("at", F.to_timestamp("at")).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    return spark.readStream.schema("document string, doc_ord long, text string, at timestamp").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")


def test_a_stream_is_cleaned_like_a_table(spark, arriving, tmp_path):
    query = clean_stream(Scrubber(), arriving.drop("at")).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/log").trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted(r.text for r in spark.read.parquet(f"{tmp_path}/out").collect()) == ["x {{EMAIL}}", "y {{EMAIL}} {{EMAIL}}", "z {{EMAIL}} {{EMAIL}}"]
    with pytest.raises(ValueError):
        clean_stream(Scrubber(renderer=Token(include_count=True)), arriving)


def test_a_stream_counts_findings_by_window(spark, arriving, tmp_path):
    query = findings_per_window(Scrubber(), arriving, "at", "10 minutes").writeStream.format("memory").queryName("found").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted((r.pii_type, r["count"]) for r in spark.table("found").collect()) == [("email", 2), ("email", 3)]


def test_a_stream_is_numbered_from_batch_to_batch(spark, arriving, tmp_path):
    number_stream(Scrubber(renderer=Token(include_count=True)), arriving.drop("at"), f"{tmp_path}/out", f"{tmp_path}/tokens", f"{tmp_path}/log").awaitTermination()
    texts = [r.text for r in spark.read.parquet(f"{tmp_path}/out").collect()]
    numbers = {}
    for text in texts:
        for word in text.split()[1:]:
            numbers[word] = numbers.get(word, 0) + 1
    assert sorted(numbers) == ["{{EMAIL-0}}", "{{EMAIL-1}}", "{{EMAIL-2}}"] and sorted(numbers.values()) == [1, 2, 2]
    added = {b: {r.key for r in spark.read.parquet(f"{tmp_path}/tokens/counts/batch={b}").collect()} for b in range(3)}
    assert sum(map(len, added.values())) == 3 and set.union(*added.values()) == {"email:a@b.io", "email:c@d.io", "email:e@f.io"}
    assert len(stream_tokens(spark, f"{tmp_path}/tokens")) == 3 and not (tmp_path / "tokens/originals").exists()


def test_a_stream_keeps_originals_that_undo_it(spark, arriving, tmp_path):
    scrubber = Scrubber(renderer=Token(include_count=True), tokens=TokenMap(keep_originals=True))
    number_stream(scrubber, arriving.drop("at"), f"{tmp_path}/out", f"{tmp_path}/tokens", f"{tmp_path}/log", trigger={"availableNow": True}).awaitTermination()
    tokens = stream_tokens(spark, f"{tmp_path}/tokens", originals=True)
    undone = set()
    for r in spark.read.parquet(f"{tmp_path}/out").collect():
        undone.add(" ".join(tokens.original_of(w) if w.startswith("{{") else w for w in r.text.split()))
    assert undone == {"x a@b.io", "y c@d.io a@b.io", "z c@d.io e@f.io"}


def test_a_token_map_goes_back_where_it_came_from(spark, tmp_path):
    for text, keys in (("a@b.io", {"email:a@b.io": 0}), ("c@d.io a@b.io", {"email:a@b.io": 0, "email:c@d.io": 1}), ("a@b.io", {"email:a@b.io": 0, "email:c@d.io": 1})):
        path = f"{tmp_path}/tokens"
        before = read_tokens(spark, path, originals=True) if (tmp_path / "tokens").exists() else TokenMap(keep_originals=True)
        result = Scrubber(renderer=Token(include_count=True), tokens=before).scrub_documents(spark.createDataFrame([("d", 0, text)], "document string, doc_ord long, text string"))
        write_tokens(result.tokens, path, include_originals=True, mode="overwrite")
        assert {r.key: r["index"] for r in read_tokens(spark, path).counts.collect()} == keys
        assert result.documents.head()["text"] == " ".join(f"{{{{EMAIL-{keys['email:' + w]}}}}}" for w in text.split())  # the old map is gone by now


def test_sql(spark):
    spark.createDataFrame([(1, "to a@b.io"), (2, None)], "id long, text string").createOrReplaceTempView("inbox")
    clean_view(spark, "inbox", "outbox")
    assert [tuple(r) for r in spark.sql("select * from outbox order by id").collect()] == [(1, "to {{EMAIL}}"), (2, None)]
    findings_view(spark, "inbox", "found_in_inbox", id_col="id")
    assert [tuple(r) for r in spark.sql("select document, beg, end, pii_type from found_in_inbox").collect()] == [("1", 3, 9, "email")]
    from palimpsest.plans.catalogue import PythonBadge

    register_table_function(spark, [PythonBadge()], "badges_in")
    assert [tuple(r) for r in spark.sql("select f.beg, f.text from values ('badge EMP-123456'), (null) as t(x), lateral badges_in(t.x) f").collect()] == [(6, "EMP-123456")]


def test_narrow_plans_do_not_shuffle(spark):
    docs = spark.createDataFrame([("a", 0, "x@y.io")], "document string, doc_ord long, text string")
    plan = Scrubber().scrub_documents(docs).documents._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan
    assert plan.count("regexp_extract_all") <= 4 * len(Scrubber().detectors) + 20


def test_the_flagship_runs(spark):
    df = __spark_entry__.entry(spark)
    assert df.columns == ["doc_id", "text", "n_findings"] and df.count() == 200


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_queries_equal_their_sql(spark, name):
    con = duckdb.connect()
    con.sql("set TimeZone = 'UTC'")
    for t in TABLES:
        con.sql(f"create view {t} as select * from '/root/testdata/sf0.001/{t}.parquet'")
    df = __spark_entry__.queries()[name](spark, "/root/testdata/sf0.001")
    want = con.sql(__spark_entry__.oracle_sql()[name])
    assert sorted(df.columns) == sorted(want.columns)
    columns = ", ".join(f'"{c}"' for c in df.columns)
    shown = lambda rows: sorted(repr(tuple(round(v, 9) if isinstance(v, float) else v for v in r)) for r in rows)
    assert shown(tuple(r) for r in df.collect()) == shown(want.select(columns).fetchall())


@pytest.mark.parametrize("files", [0, 1, 3])
def test_a_stream_reads_documents_of_one_file_or_a_folder_of_any(spark, tmp_path, files):
    rows = [(i, f"mail a{i}@b.io" if i % 2 else None) for i in range(6)] if files else []
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(max(files, 1))
    docs.write.parquet(f"{tmp_path}/folder/documents.parquet")
    docs.coalesce(1).write.parquet(f"{tmp_path}/made")
    (tmp_path / "file").mkdir()
    next((tmp_path / "made").glob("part-*")).rename(tmp_path / "file/documents.parquet")
    for form in ("folder", "file"):
        docs.write.parquet(f"{tmp_path}/{form}/documents_old.parquet")
        cleaned = catalogue.stream_clean(spark, f"{tmp_path}/{form}")
        assert sorted(tuple(r) for r in cleaned.collect()) == [(i, t and "mail {{EMAIL}}") for i, t in rows]


@pytest.mark.parametrize("name", ["resolve_highest_score", "resolve_longest", "resolve_priority", "resolve_nested"])
def test_findings_that_tie_in_all_are_settled_by_their_place_in_the_table(spark, tmp_path, name):
    flags = [("R", "O"), ("A", "O"), ("N", "O"), ("A", "O")]
    rows = [(order, 3, 5, 2, flag, status, 0.05) for order in range(40) for flag, status in flags[order % 3 :] + flags[: order % 3]]
    spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_returnflag string, l_linestatus string, l_discount double").coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    con = duckdb.connect(config={"threads": 1})
    con.sql(f"create view lineitem as select * from '{tmp_path}/lineitem.parquet/*.parquet'")
    got = sorted(tuple(r) for r in catalogue.QUERIES[name](spark, str(tmp_path)).collect())
    assert got == sorted(con.sql(catalogue.ORACLES[name]).fetchall())
    assert [r[3] for r in got] == [flags[order % 3][0] for order in range(40)]
