"""The registered queries: each operator with production parameters over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm import ann, decontaminate, langid, linedup, packing, quality, secrets, simhash, substrings, urlfilter
from palimpsest.llm.common import crc_bucket, table


def public_tokenizer() -> tuple[str, str, str]:
    """Paths of the public 50k byte-level vocabulary in both forms, and its splitting pattern."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every secret candidate of documents with the forest's score; texts leave as digests."""
    found = secrets.scan(table(spark, sf_dir, "documents"), secrets.fit(secrets.labelled_findings(spark)), path_col="source")
    return found.select("doc_id", "start", F.length("candidate").cast("long").alias("length"), F.sha2("candidate", 256).alias("candidate_sha256"), "score", "is_secret")


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document; rows with crc32(doc_id) mod 4 = 2 are held out."""
    docs = table(spark, sf_dir, "documents")
    held_out = crc_bucket("doc_id", 4) == 2
    found = langid.identify(docs, langid.fit(docs.where(~held_out)))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document; rows with crc32(doc_id) mod 3 = 1 are held out."""
    docs = table(spark, sf_dir, "documents")
    model = quality.fit(docs, table(spark, sf_dir, "labels").where(~quality.held_out()))
    scored = quality.score(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", quality.held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op4_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest found of every row of embeddings whose vec_id is divisible by 20."""
    return ann.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 2048 tokens."""
    pieces = packing.pack(table(spark, sf_dir, "documents"), *public_tokenizer())
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


#: A dated list to judge the pages by: pattern, category, action, date.
URL_LIST = [
    ("casino-win.example.net", "gambling", "add", "2024-01-10"), ("casino-win.example.net", "gambling", "remove", "2024-03-01"), ("casino-win.example.net", "gambling", "add", "2024-06-15"),
    ("casino-win.example.com", "gambling", "add", "2024-02-01"), ("casino-win.example.org", "gambling", "add", "2024-02-01"),
    ("free-bets.example.net", "gambling", "add", "2024-01-05"), ("free-bets.example.com", "gambling", "add", "2024-04-01"), ("free-bets.example.org", "gambling", "add", "2024-04-01"), ("free-bets.example.net", "gambling", "remove", "2024-09-01"),
    ("adult-x.example.com", "adult", "add", "2023-12-01"), ("adult-x.example.com/en", "adult_en", "add", "2024-05-01"), ("adult-x.example.net", "adult", "add", "2024-05-01"), ("adult-x.example.org", "adult", "add", "2024-05-01"),
    ("spam-farm.example.org", "spam", "add", "2024-02-20"), ("www.spam-farm.example.org", "spam_host", "add", "2024-07-01"), ("spam-farm.example.org", "spam", "remove", "2024-11-01"), ("spam-farm.example.com", "spam", "add", "2024-02-20"), ("spam-farm.example.net", "spam", "add", "2024-02-20"),
    ("cheap-pills.example.net", "pharma", "add", "2024-03-03"), ("cheap-pills.example.com", "pharma", "add", "2024-03-03"), ("cheap-pills.example.org", "pharma", "add", "2024-03-03"),
    ("ads-track.example.com", "tracking", "add", "2024-01-01"), ("ads-track.example.com", "tracking", "remove", "2024-02-01"), ("ads-track.example.com", "tracking", "add", "2024-02-01"), ("ads-track.example.com", "ads", "add", "2024-08-08"),
    ("tionsh.example.net/de", "regional", "add", "2024-10-01"), ("tionsh.example.net/de", "regional", "remove", "2024-10-15"), ("EXAMPLE.ORG", "all_org", "add", "2024-12-20"),
]


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page judged by the entries of URL_LIST that were active on the day it was fetched.

    The table has no fetch times: page n counts as fetched n mod 366 days after the first of January 2024.
    """
    pages = table(spark, sf_dir, "pages").select("page_id", "url", F.expr("timestamp '2024-01-01 00:00:00' + make_dt_interval(cast(page_id % 366 as int))").alias("fetched_at"))
    entries = spark.createDataFrame(URL_LIST, "pattern string, category string, action string, dated string")
    return urlfilter.evaluate(pages, entries).withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("fetched_at", "listed_since")})


OP6_SQL = f"""
with entries(pattern, category, action, dated) as (values {", ".join(repr(e) for e in URL_LIST)}),
known as (
    select lower(split_part(pattern, '/', 1)) as host, rtrim(regexp_extract(pattern, '/.*$'), '/') as path, category, cast(dated as timestamp) as since, max(action) as action
    from entries group by all),
active as (
    select host, path, category, since, until from (select *, lead(since) over (partition by host, path, category order by since) as until from known) where action = 'add'),
captures as (
    select page_id, lower(regexp_extract(url, '^[a-z]+://([^/?#:]*)', 1)) as host, regexp_extract(url, '^[a-z]+://[^/?#]*(/[^?#]*)', 1) as path, timestamp '2024-01-01' + to_days(cast(page_id % 366 as integer)) as fetched_at from pages)
select page_id, c.host, fetched_at, count(a.host) > 0 as blocked, count(a.host) as n_entries,
    coalesce(array_to_string(list_sort(list_distinct(list(a.category) filter (a.category is not null))), ','), '') as categories, min(since) as listed_since
from captures c left join active a on (c.host = a.host or c.host like '%.' || a.host)
    and (a.path = '' or c.path = a.path or c.path like a.path || '/%')
    and fetched_at >= since and (until is null or fetched_at < until)
group by page_id, c.host, fetched_at
"""


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every document."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without lines that occur on at least ten sites: how many lines it had and lost, and what is left.

    nearly_empty marks those of which less than half is left, in characters.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source", F.size(F.split("text", "\n", -1)).alias("had"), F.length("text").alias("long"))
    kept = linedup.strip_boilerplate(docs)
    lines = F.when(F.col("text").isNull(), 0).otherwise(F.col("had")).cast("long")
    return kept.select(
        "doc_id", lines.alias("n_lines"), F.col("_removed").alias("n_removed"), F.length("text").cast("long").alias("n_chars_kept"), F.sha2("text", 256).alias("kept_sha256"),
        (F.coalesce(2 * F.length("text") < F.col("long"), F.lit(False))).alias("nearly_empty"),
    )


OP8_SQL = """
with lines as (
    select doc_id, source, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as place
    from documents where text is not null),
shared as (
    select line from lines where line <> '' group by line having count(distinct source) >= 10),
marked as (
    select doc_id, lines.line, place, shared.line is not null as bad from lines left join shared on lines.line = shared.line),
judged as (
    select doc_id, count(*) as n_lines, count(*) filter (bad) as n_bad, count(*) filter (bad) > 0 and count(*) filter (not bad and line <> '') > 0 as cut
    from marked group by doc_id),
kept as (
    select doc_id, string_agg(line, chr(10) order by place) as text from marked join judged using (doc_id) where not (cut and bad) group by doc_id)
select documents.doc_id, coalesce(n_lines, 0) as n_lines, case when cut then n_bad else 0 end as n_removed,
    length(kept.text) as n_chars_kept, sha256(kept.text) as kept_sha256, coalesce(2 * length(kept.text) < length(documents.text), false) as nearly_empty
from documents left join judged using (doc_id) left join kept using (doc_id)
"""


def op9_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the bytes that 200-byte strings cover which also start elsewhere."""
    kept = substrings.remove_repeats(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that windows of benchmark items cover, and those items."""
    found = decontaminate.find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    names = F.array_join(F.array_sort(F.transform("item_ids", lambda i: i.cast("string"))), ",")
    return found.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), F.sha2(names, 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


OP10_SQL = """
with texts as (
    select 'd' as kind, doc_id as id, text from documents union all select 'i', item_id, text from benchmark where item_id is not null and text is not null),
words as (
    select kind, id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as w from texts),
windows as (
    select distinct id as item_id, least(10, len(w)) as n, array_to_string(w[k:k + least(10, len(w)) - 1], ' ') as s
    from words, lateral (select unnest(range(1, greatest(len(w) - 9, 1) + 1)) as k) where kind = 'i' and len(w) > 0),
places as (
    select id as doc_id, n, k, array_to_string(w[k:k + n - 1], ' ') as s
    from words, (select distinct n from windows) as sizes, lateral (select unnest(range(1, len(w) - n + 2)) as k) where kind = 'd'),
hits as (
    select doc_id, item_id, k, n from places join windows using (n, s)),
covered as (
    select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(k, k + n)) as p from hits) group by doc_id),
named as (
    select doc_id, count(*) as n_items, string_agg(name, ',' order by name) as names from (select distinct doc_id, cast(item_id as varchar) as name from hits) group by doc_id)
select words.id as doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(names, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from words left join covered on words.id = covered.doc_id left join named on words.id = named.doc_id where kind = 'd'
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_secrets": op1_secrets,
    "op2_language": op2_language,
    "op3_quality": op3_quality,
    "op4_neighbours": op4_neighbours,
    "op5_packing": op5_packing,
    "op6_url_filter": op6_url_filter,
    "op7_simhash": op7_simhash,
    "op8_line_dedup": op8_line_dedup,
    "op9_substrings": op9_substrings,
    "op10_decontamination": op10_decontamination,
}

ORACLES: dict[str, str] = {
    "op6_url_filter": OP6_SQL,
    "op8_line_dedup": OP8_SQL,
    "op10_decontamination": OP10_SQL,
}
