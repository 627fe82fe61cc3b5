"""Queries over the test tables, one or more for each operator, and the same in DuckDB's SQL.

The two sides are written apart: DuckDB's regular expressions know no lookaround, so boundaries are
consumed and given back, and places come from what lies between matches.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.functions import validators
from palimpsest.limits import Limits
from palimpsest.operators.detectors import CreditCardDetector, EmailDetector, PythonRegexDetector, RegexDetector
from palimpsest.operators.numbering import TokenMap
from palimpsest.operators.registry import default_registry
from palimpsest.operators.render import Mask, Remove, Renderer, Token
from palimpsest.operators.resolve import resolve_rows
from palimpsest.plans.engine import Scrubber, as_documents
from palimpsest.plans.lineage import shared_folder
from palimpsest.sources.reports import detector_table, findings_json, findings_tsv

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    def add(function: Query) -> Query:
        key = name or function.__name__
        QUERIES[key] = function
        if sql is not None:
            ORACLES[key] = sql
        return function

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _spread(docs: DataFrame) -> DataFrame:
    """Deal documents out before the patterns run, but only where the input has fewer splits than there are cores:
    a small file with one row group is one task. Inputs of many splits are not shuffled."""
    cores = docs.sparkSession.sparkContext.defaultParallelism
    return docs.repartition(cores) if docs.rdd.getNumPartitions() < cores else docs


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_documents(_spread(_table(spark, sf_dir, "documents").select("doc_id", "text")), id_col="doc_id")


# The fixtures that the tables lack: the same text from the same keys in both engines.

_FIXTURES = {
    "uuids": ("orders", "o_orderkey", "concat('id ', substr({h}, 1, 8), '-', substr({h}, 9, 4), '-', substr({h}, 13, 4), '-', substr({h}, 17, 4), case when o_orderkey % 5 = 0 then '' else concat('-', substr({h}, 21, 12)) end, ' of user ', o_custkey)", "md5(cast(o_orderkey as {string}))"),
    "ipv6s": ("orders", "o_orderkey", "concat('from ', substr({h}, 1, 4), case o_orderkey % 4 when 0 then concat('::', substr({h}, 5, 4)) when 1 then concat(':', substr({h}, 5, 4), ':0:0:0:0:', substr({h}, 9, 4), ':', substr({h}, 13, 4)) when 2 then concat(':', substr({h}, 5, 4), ':1:2:3:4:5:6:', substr({h}, 9, 4)) else concat(':', substr({h}, 5, 2), '::', substr({h}, 7, 3), '::1') end, ' at 12:30:45')", "md5(cast(o_orderkey as {string}))"),
    "ibans": ("customer", "c_custkey", "concat('pay ', {h}, case when c_custkey % 3 = 0 then '' else ' by' end, ' today')", "concat('GB', lpad(cast(98 - {mod} as {string}), 2, '0'), 'WEST', lpad(cast(c_custkey * 7919 % 1000000 as {string}), 6, '0'), lpad(cast((c_custkey + case when c_custkey % 7 = 0 then 1 else 0 end) as {string}), 8, '0'))"),
    "keys": ("customer", "c_custkey", "concat('use ', case c_custkey % 4 when 0 then concat('AKIA', upper(substr({h}, 1, 16))) when 1 then concat('ghp_', {h}, substr({h}, 1, 4)) when 2 then concat('eyJ', substr({h}, 1, 12), '.eyJ', substr({h}, 3, 12), '.', substr({h}, 5, 20)) else concat('AKIA', upper(substr({h}, 1, 12))) end, ' now')", "md5(cast(c_custkey as {string}))"),
    "long_keys": ("customer", "c_custkey", "case c_custkey % 3 when 0 then concat('auth eyJ', substr({h}, 1, 12), '.eyJ', repeat({h}, 200), '.', {h}, ' end') when 1 then concat('see -----BEGIN RSA PRIVATE KEY-----', chr(10), repeat(concat({h}, chr(10)), 350), '-----END RSA PRIVATE KEY----- end') else concat('password = \"', repeat({h}, 350), '\" end') end", "md5(cast(c_custkey as {string}))"),
    "badges": ("orders", "o_orderkey", "concat('badge EMP-', lpad(cast(o_orderkey % 1000000 as {string}), 6, '0'), ' or EMP-', o_custkey, '.')", ""),
    "addresses": ("pages", "page_id", "concat('see ', url, '. (', url, ')')", ""),
}
# The check digits of GBkk WEST nnnnnn nnnnnnnn: 98 less the number with W=32 E=14 S=28 T=29 and G=16 B=11, modulo 97, taken in parts.
_MOD = "(((((32142829 % 97) * 1000000 + c_custkey * 7919 % 1000000) % 97) * 100000000 + c_custkey) % 97 * 1000000 + 161100) % 97"


def _fixture_sql(name: str, string: str) -> str:
    source, key, text, inner = _FIXTURES[name]
    inner = inner.format(string=string, mod=_MOD)
    return f"select {key} as doc_id, {text.format(h=inner, string=string)} as text from {source}"


def _fixture(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    source = _FIXTURES[name][0]
    rows = spark.sql(_fixture_sql(name, "string").replace(f"from {source}", "from {source}"), source=_table(spark, sf_dir, source))
    return as_documents(_spread(rows), id_col="doc_id")


def _rows(found: DataFrame, *more: str) -> DataFrame:
    return found.select(F.col("doc_ord").alias("doc_id"), "beg", "end", F.col("text").alias("found"), *more)


def _q(text: str) -> str:
    return text.replace("'", "''")


def _located(source: str, pattern: str, group: int = 0) -> str:
    """SQL for (doc_id, beg, end, found) of a pattern whose group ends where the whole match ends."""
    p = _q(pattern)
    return f"""
    select doc_id, cast(stop - length(found) as integer) as beg, cast(stop as integer) as "end", found from (
        select doc_id, groups[i] as found, list_sum(list_transform(gaps[1:i], lambda g: length(g))) + list_sum(list_transform(whole[1:i], lambda m: length(m))) as stop
        from (select doc_id, regexp_extract_all(text, '{p}') as whole, regexp_extract_all(text, '{p}', {group}) as groups, string_split_regex(text, '{p}') as gaps from ({source})) as matched,
            lateral (select unnest(range(1, len(whole) + 1)) as i))"""


_DOCS = "select doc_id, text from documents"
_EMAIL = r"(?i)[a-z0-9!#$%'*+^_`{|}~.-]*[a-z0-9!#$%'*+^_`{|}~-]@[a-z0-9-]+(?:\.[a-z0-9-]*[a-z0-9])+"
_IPV4 = r"(?:^|[^\pL\pN_.])((?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])(?:\.(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])){3})"
_PASSWORD = r"""(?i)(?:^|[^A-Za-z0-9])["']?[\pL\pN_-]{0,40}(?:password|passwd|pwd|secret|token|api_key)[\pL\pN_-]{0,40}["']?\s{0,8}(?:=>|[:=])\s{0,8}["']?([^\s"'&,;{}\[\]]+)"""
_LUHN = "list_sum(list_transform(range(1, length({d}) + 1), lambda k: case when k % 2 = 1 then cast(substr({d}, length({d}) - k + 1, 1) as integer) else [0, 2, 4, 6, 8, 1, 3, 5, 7, 9][cast(substr({d}, length({d}) - k + 1, 1) as integer) + 1] end)) % 10 = 0"
_DIGITS = "replace(replace({m}, ' ', ''), '-', '')"


# Spaces are doubled first, so that one between two numbers can end the first and begin the second.
_CARD = r"(?:^|[^\pL\pN_-])([0-9](?:(?:  |-)?[0-9]){11,18})(?:$|[^\pL\pN_-])"
_CARDS = f"""
    select doc_id, cast(beg as integer) as beg, cast(beg + length(found) as integer) as "end", found from (
        select doc_id, replace(groups[i], '  ', ' ') as found, length(replace(substr(text, 1, stop - length(whole[i]) + strpos(whole[i], groups[i]) - 1), '  ', ' ')) as beg from (
            select *, cast(list_sum(list_transform(gaps[1:i], lambda g: length(g))) + list_sum(list_transform(whole[1:i], lambda m: length(m))) as bigint) as stop
            from (select doc_id, text, regexp_extract_all(text, '{_CARD}') as whole, regexp_extract_all(text, '{_CARD}', 1) as groups, string_split_regex(text, '{_CARD}') as gaps
                from (select doc_id, replace(text, ' ', '  ') as text from documents)) as matched, lateral (select unnest(range(1, len(whole) + 1)) as i)))"""


def _valid_card(match: str) -> str:
    digits = _DIGITS.format(m=match)
    return f"(length({digits}) between 13 and 19 and {_LUHN.format(d=digits)})"


# Detectors


@query(_located(_DOCS, _EMAIL))
def find_email(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rows(Scrubber(detectors=["email"]).find_documents(_documents(spark, sf_dir)))


@query(f"select f.* from ({_located(_DOCS, _IPV4, 1)}) f join documents d using (doc_id) where not regexp_matches(coalesce(substr(d.text, f.\"end\" + 1, 1), ''), '[\\pL\\pN_.]')")
def find_ipv4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rows(Scrubber(detectors=["ip"]).find_documents(_documents(spark, sf_dir)).where("context['version'] = '4'"))


@query(f"select * from ({_CARDS}) where {_valid_card('found')}")
def find_credit_card(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rows(Scrubber(detectors=["credit_card"]).find_documents(_documents(spark, sf_dir)))


@query(f"select * from ({_located(_DOCS, _PASSWORD, 1)}) where lower(found) not in ('redacted', 'none', 'null')")
def find_password(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rows(Scrubber(detectors=["password"]).find_documents(_documents(spark, sf_dir)))


_TRAILING = ".,;:!?)]}>''\"`"


@query(f"select doc_id, beg, cast(beg + length(bare) as integer) as \"end\", bare as found from (select *, rtrim(found, '{_TRAILING}') as bare from ({_located(_fixture_sql('addresses', 'varchar'), '(?i)https?://[^\\s<>\"\'`\\]\\[{}]+')}))")
def find_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rows(Scrubber(detectors=["url"]).find_documents(_fixture(spark, sf_dir, "addresses")))


@query("select page_id as doc_id, count(*) as n_found from (select page_id, unnest(regexp_extract_all(html, '(?i)(?:^|[^\\pL\\pN_])(?:(?:https?|ftps?|sftp)://[^\\s<>\"''`\\]\\[{}]+|www\\.[a-z0-9-]+(?:\\.[a-z0-9-]+)+)')) from pages) group by page_id")
def find_url_in_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = as_documents(_spread(_table(spark, sf_dir, "pages").select("page_id", "html")), id_col="page_id", text_col="html")
    return Scrubber(detectors=["url"]).find_documents(pages).groupBy(F.col("doc_ord").alias("doc_id")).agg(F.count("*").alias("n_found"))


@query(_located(_fixture_sql("uuids", "varchar"), "[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}"))
def find_uuid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rows(Scrubber(detectors=["uuid"]).find_documents(_fixture(spark, sf_dir, "uuids")))


_V6 = "(?:^|[^\\pL\\pN_:.])([0-9a-f]{0,4}(?::[0-9a-f]{0,4}){2,7})(?:$|[^\\pL\\pN_:])"


@query(f"""select doc_id, found from (select doc_id, unnest(regexp_extract_all(text, '{_V6}', 1)) as found from ({_fixture_sql('ipv6s', 'varchar')}))
    where case when contains(found, ':::') then false when len(string_split(found, '::')) = 1 then len(string_split(found, ':')) = 8 and not regexp_matches(found, '^:|:$')
        else len(string_split(found, '::')) = 2 and len(list_filter(string_split(found, ':'), lambda g: g <> '')) <= 7 and not regexp_matches(found, '^:[^:]|[^:]:$') end""")
def find_ipv6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rows(Scrubber(detectors=["ip"]).find_documents(_fixture(spark, sf_dir, "ipv6s"))).select("doc_id", "found")


def _mod97(account: str) -> str:
    compact = f"upper(replace({account}, ' ', ''))"
    digits = f"list_transform(string_split(substr({compact}, 5) || substr({compact}, 1, 4), ''), lambda c: case when c between '0' and '9' then cast(c as bigint) else ascii(c) - 55 end)"
    return f"list_reduce({digits}, lambda r, d: (r * (case when d > 9 then 100 else 10 end) + d) % 97) = 1"


@query(f"select * from ({_located(_fixture_sql('ibans', 'varchar'), '[A-Z]{2}[0-9]{2}(?:[ ]?[A-Z0-9]{1,4}){2,8}')}) where length(replace(found, ' ', '')) between 15 and 34 and {_mod97('found')}")
def find_iban(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rows(Scrubber(detectors=["iban"]).find_documents(_fixture(spark, sf_dir, "ibans")))


_KEY = "AKIA[A-Z0-9]{16}|ghp_[A-Za-z0-9]{36}|eyJ[A-Za-z0-9_-]+\\.eyJ[A-Za-z0-9_-]+\\.[A-Za-z0-9_-]+"


@query(f"select *, case left(found, 3) when 'AKI' then 'aws_access_key' when 'ghp' then 'github_token' else 'jwt' end as kind from ({_located(_fixture_sql('keys', 'varchar'), _KEY)})")
def find_secret(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = Scrubber(detectors=["secret"]).find_documents(_fixture(spark, sf_dir, "keys"))
    return _rows(found.withColumn("kind", F.col("context")["kind"]), "kind")


_LONG = _fixture_sql("long_keys", "varchar")
_LONG_KEYS = (("jwt", "eyJ[A-Za-z0-9_-]+\\.eyJ[A-Za-z0-9_-]+\\.[A-Za-z0-9_-]+", 0), ("private_key_block", "-----BEGIN RSA PRIVATE KEY-----[^-]*-----END RSA PRIVATE KEY-----", 0), ("password", 'password = "([^"]+)', 1))


@query(" union all ".join(f"select doc_id, beg, \"end\", md5(found) as found, '{kind}' as kind from ({_located(_LONG, pattern, group)})" for kind, pattern, group in _LONG_KEYS))
def find_long_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys, tokens and passwords of thousands of characters are found whole."""
    found = Scrubber(detectors=["secret", "password"]).find_documents(_fixture(spark, sf_dir, "long_keys"))
    return found.select(F.col("doc_ord").alias("doc_id"), "beg", "end", F.md5("text").alias("found"), F.coalesce(F.col("context")["kind"], "detector").alias("kind"))


class Badge(RegexDetector):
    """A detector of one's own: an employee number after its label."""

    name, pii_type, pattern, group, before = "badge", "employee_id", r"(badge )(EMP-[0-9]{6})(?![0-9])", 2, 1


class PythonBadge(PythonRegexDetector):
    """The same in Python's syntax, run in batches on the executors."""

    name, pii_type, pattern, group = "badge", "employee_id", re.compile(r"badge (?P<id>EMP-[0-9]{6})(?![0-9])"), "id"


_BADGES = _located(_fixture_sql("badges", "varchar"), "badge (EMP-[0-9]{6})", 1)


@query(_BADGES)
def find_custom_regex(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rows(Scrubber(detectors=[Badge()]).find_documents(_fixture(spark, sf_dir, "badges")))


@query(_BADGES)
def find_python_regex(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rows(Scrubber(detectors=[PythonBadge()]).find_documents(_fixture(spark, sf_dir, "badges")))


@query(_BADGES)
def find_table_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    from palimpsest.sql import register_table_function

    register_table_function(spark, [PythonBadge()], "find_badges")
    return spark.sql("select d.doc_ord as doc_id, f.beg, f.end, f.text as found from {docs} d, lateral find_badges(d.text) f", docs=_fixture(spark, sf_dir, "badges"))


# Validators


@query(f"select o_orderkey as id, {_LUHN.format(d='s')} as valid from (select o_orderkey, cast(o_orderkey * 7919 + o_custkey as varchar) as s from orders)")
def validate_luhn(spark: SparkSession, sf_dir: str) -> DataFrame:
    digits = (F.col("o_orderkey") * 7919 + F.col("o_custkey")).cast("string")
    return _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), validators.luhn(digits).alias("valid"))


@query(f"select doc_id as id, length(a) between 15 and 34 and {_mod97('a')} as valid from (select doc_id, regexp_extract(text, 'GB[0-9A-Z]+') as a from ({_fixture_sql('ibans', 'varchar')}))")
def validate_mod97(spark: SparkSession, sf_dir: str) -> DataFrame:
    account = F.regexp_extract("text", "GB[0-9A-Z]+", 0)
    return _fixture(spark, sf_dir, "ibans").select(F.col("doc_ord").alias("id"), validators.mod97(account).alias("valid"))


@query("select p_partkey as id, p_size % 7 <> 0 and p_partkey % 300 < 256 as valid from part")
def validate_ipv4(spark: SparkSession, sf_dir: str) -> DataFrame:
    address = F.concat_ws(".", F.lit("10"), F.when(F.col("p_size") % 7 == 0, "01").otherwise("1"), (F.col("p_partkey") % 300).cast("string"), F.lit("9"))
    return _table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), validators.ipv4(address).alias("valid"))


# Selection and thresholds


@query(f"select doc_id, f.beg, f.\"end\", f.found from ({ORACLES['find_credit_card']}) f")
def filter_min_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    scrubber = Scrubber(detectors=[EmailDetector(score=0.4), CreditCardDetector()], min_score=0.5)
    return _rows(scrubber.find_documents(_documents(spark, sf_dir)))


@query("select * from (values (cast(0 as bigint), 'uuid'), (cast(1 as bigint), 'email'), (cast(2 as bigint), 'ip')) t(position, name)")
def select_named(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen = default_registry(plugins=False).select("en_US", ["uuid", "email", "ip"])
    return spark.createDataFrame([(i, e.name) for i, e in enumerate(chosen)], "position long, name string")


@query("select * from (values ('de_DE', 'any'), ('de_DE', 'german'), ('de_AT', 'any'), ('de_AT', 'german'), ('de_AT', 'austrian'), ('en_US', 'any')) t(locale, name)")
def select_locale(spark: SparkSession, sf_dir: str) -> DataFrame:
    from palimpsest.operators.registry import Entry, Registry

    registry = Registry([Entry("any", Badge), Entry("german", Badge, locales=frozenset({"de"})), Entry("austrian", Badge, locales=frozenset({"de_AT"}))])
    return spark.createDataFrame([(x, e.name) for x in ("de_DE", "de_AT", "en_US") for e in registry.select(x)], "locale string, name string")


@query("select * from (values ('credit_card', true), ('email', true), ('iban', true), ('ip', true), ('password', true), ('secret', true), ('url', true), ('uuid', false)) t(name, autoload)")
def list_detectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detector_table(spark)[0].where("not plugin and name <> 'phone'").select("name", F.col("default").alias("autoload"))


# Overlap resolution, on spans made of lineitem: an order is a document, its lines are findings

_SPANS = """select l_orderkey as document, l_linenumber as n, cast(l_partkey % 40 as integer) as beg, cast(l_partkey % 40 + 1 + l_suppkey % 12 as integer) as "end",
    l_returnflag as pii_type, l_linestatus as detector, l_discount as score from lineitem"""


def _spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The spans with ``place``, which puts them in order: by n, and where lines of an order share it as they lie in the table."""
    lines = _table(spark, sf_dir, "lineitem").select("*", F.struct(F.col("l_linenumber").isNull(), "l_linenumber", "_metadata.file_path", "_metadata.row_index").alias("place"))
    return spark.sql(_SPANS.replace('"end"', "end").replace("from lineitem", ", place from {lineitem}"), lineitem=lines)


def _greedy_sql(order: str) -> str:
    return f"""
    with spans as ({_SPANS}), ranked as (
        select document, list({{'beg': beg, 'end': "end", 'pii_type': pii_type, 'detector': detector, 'score': score}} order by {order}, beg, n) as f from spans group by document)
    select document, s.beg as beg, s."end" as "end", s.pii_type as pii_type, s.detector as detector, s.score as score from (
        select document, unnest(list_reduce(list_transform(f, lambda x: [x]), lambda acc, x: case when len(list_filter(acc, lambda a: a.beg < x[1]."end" and x[1].beg < a."end")) > 0 then acc else list_concat(acc, x) end)) as s from ranked)"""


_CLUSTERS = f"""select *, sum(opens) over (partition by document order by beg, "end" desc, n rows unbounded preceding) as cluster from (
    select *, case when beg < max("end") over (partition by document order by beg, "end" desc, n rows between unbounded preceding and 1 preceding) then 0 else 1 end as opens from ({_SPANS}))"""


@query(_greedy_sql('score desc, "end" - beg desc'))
def resolve_highest_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve_rows(_spans(spark, sf_dir), "highest_score", order="place")


@query(_greedy_sql('"end" - beg desc, score desc'))
def resolve_longest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve_rows(_spans(spark, sf_dir), "longest", order="place")


@query(_greedy_sql("score desc, \"end\" - beg desc, case detector when 'F' then 2 when 'O' then 1 else 0 end desc"))
def resolve_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve_rows(_spans(spark, sf_dir), "highest_score", {"F": 2, "O": 1}, order="place")


@query(f"""select document, min(beg) as beg, max("end") as "end", array_to_string(list_sort(list(distinct pii_type)), '+') as pii_type, array_to_string(list_sort(list(distinct detector)), '+') as detector, max(score) as score
    from ({_CLUSTERS}) group by document, cluster""")
def resolve_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve_rows(_spans(spark, sf_dir), "merge")


@query(f'select document, beg, "end", pii_type, detector, score from ({_SPANS})')
def resolve_keep_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve_rows(_spans(spark, sf_dir), "keep_all")


@query(f"select document, cast(count(distinct cluster) as bigint) as clusters from ({_CLUSTERS}) group by document")
def resolve_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from palimpsest.operators.resolve import clusters

    return clusters(_spans(spark, sf_dir)).groupBy("document").agg(F.countDistinct("cluster").alias("clusters"))


@query(_greedy_sql('score desc, "end" - beg desc'))
def resolve_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The column form, on arrays of findings."""
    from palimpsest.operators.resolve import resolve

    one = F.struct("place", "beg", "end", "pii_type", "detector", "score")
    nested = _spans(spark, sf_dir).groupBy("document").agg(F.array_sort(F.collect_list(one)).alias("f"))
    return nested.select("document", F.explode(resolve(F.col("f"))).alias("f")).select("document", "f.beg", "f.end", "f.pii_type", "f.detector", "f.score")


# Rendering: emails of documents


def _rendered_sql(replacement: str) -> str:
    return f"""select doc_id, case when len(found) = 0 then text else array_to_string(list_transform(range(1, len(found) + 1), lambda i: gaps[i] || {replacement}), '') || gaps[len(found) + 1] end as text
    from (select doc_id, text, regexp_extract_all(text, '{_q(_EMAIL)}') as found, string_split_regex(text, '{_q(_EMAIL)}') as gaps from documents)"""


def _render(name: str, renderer: Callable[[], Renderer], replacement: str) -> None:
    @query(_rendered_sql(replacement), name)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        cleaned = Scrubber(detectors=["email"], renderer=renderer()).clean_documents(_documents(spark, sf_dir))
        return cleaned.select(F.col("doc_ord").alias("doc_id"), "text")


_render("render_token", Token, "'{{EMAIL}}'")
_render("render_token_custom", lambda: Token(prefix="<", suffix=">", uppercase=False), "'<email>'")
_render("render_mask", Mask, "repeat('*', length(found[i]))")
_render("render_mask_keep_last", lambda: Mask("#", keep_last=4), "repeat('#', length(found[i]) - 4) || right(found[i], 4)")
_render("render_mask_fixed", lambda: Mask(fixed_length=5), "'*****'")
_render("render_remove", Remove, "''")


@query()
def render_token_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = Scrubber(detectors=["email"], renderer=Token(include_hash=True, salt="pepper")).clean_documents(_documents(spark, sf_dir))
    return cleaned.select(F.col("doc_ord").alias("doc_id"), "text")


# Numbering

_MENTIONS = f"select doc_id, beg, found, 'email:' || lower(found) as key from ({_located(_DOCS, _EMAIL)})"
def _index(order: str) -> str:
    return f"select key, row_number() over (order by first) - 1 as index from (select key, min({{'doc': {order}, 'beg': beg, 'key': key}}) as first from ({_MENTIONS}) group by key)"


_INDEX = _index("doc_id")


def _numbered_sql(index: str) -> str:
    return f"""
    with mentions as ({_MENTIONS}), indexes as ({index}),
    tokens as (select doc_id, list('{{{{EMAIL-' || index || '}}}}' order by beg) as token from mentions join indexes using (key) group by doc_id),
    parts as (select doc_id, text, string_split_regex(text, '{_q(_EMAIL)}') as gaps from documents)
    select doc_id, case when token is null then text else array_to_string(list_transform(range(1, len(token) + 1), lambda i: gaps[i] || token[i]), '') || gaps[len(token) + 1] end as text from parts left join tokens using (doc_id)"""


@query(_numbered_sql(_INDEX))
def render_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = Scrubber(detectors=["email"], renderer=Token(include_count=True)).clean_documents(_documents(spark, sf_dir))
    return cleaned.select(F.col("doc_ord").alias("doc_id"), "text")


@query(f"select doc_id // 3 as id, text from ({_numbered_sql(_index('doc_id // 3'))})")
def render_count_repeated_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three rows share an id; each is a document of its own."""
    docs = _spread(_table(spark, sf_dir, "documents").select(F.expr("doc_id div 3").alias("id"), "text"))
    cleaned = Scrubber(detectors=["email"], renderer=Token(include_count=True)).clean_documents(docs, id_col="id")
    return cleaned.select(F.col("doc_ord").alias("id"), "text")


@query(f"select 'd' || doc_id as id, text from ({_numbered_sql(_index("'d' || doc_id"))})")
def render_count_string_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _spread(_table(spark, sf_dir, "documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("id"), "text"))
    cleaned = Scrubber(detectors=["email"], renderer=Token(include_count=True)).clean_documents(docs, id_col="id")
    return cleaned.select(F.col("document").alias("id"), "text")


@query(f"select key, 'email' as pii_type, index from ({_INDEX})")
def tokens_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Scrubber(detectors=["email"], renderer=Token(include_count=True)).scrub_documents(_documents(spark, sf_dir)).tokens.counts


# An earlier run saw every entity whose address ends in "1...", by a rule that both sides can state, and numbered it 1000 plus its number here.
_EARLIER = f"select key, 1000 + index as index from ({_INDEX}) where index % 3 = 0"
_CARRIED = f"select * from ({_EARLIER}) union all select key, (select max(index) from ({_EARLIER})) + row_number() over (order by first) as index from (select key, min({{'doc': doc_id, 'beg': beg}}) as first from ({_MENTIONS}) group by key) where key not in (select key from ({_EARLIER}))"


@query(_numbered_sql(_CARRIED))
def tokens_carry_over(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    earlier = Scrubber(detectors=["email"], renderer=Token(include_count=True)).scrub_documents(docs).tokens.counts
    known = earlier.where("index % 3 = 0").withColumn("index", F.col("index") + 1000)
    cleaned = Scrubber(detectors=["email"], renderer=Token(include_count=True), tokens=TokenMap(counts=known)).clean_documents(docs)
    return cleaned.select(F.col("doc_ord").alias("doc_id"), "text")


@query(f"select '{{{{EMAIL-' || index || '}}}}' as token, arg_max(found, {{'doc': doc_id, 'beg': beg}}) as original from ({_MENTIONS}) join ({_INDEX}) using (key) group by index")
def tokens_originals(spark: SparkSession, sf_dir: str) -> DataFrame:
    scrubber = Scrubber(detectors=["email"], renderer=Token(include_count=True), tokens=TokenMap(keep_originals=True))
    return scrubber.scrub_documents(_documents(spark, sf_dir)).tokens.originals


# Everything together

_AWS = "(?:^|[^A-Za-z0-9])(AKIA[A-Z0-9]{16})"
_ALL = " union all ".join(
    f"select doc_id, beg, \"end\", found, '{kind}' as pii_type, '{name}' as detector from ({sql})"
    for kind, name, sql in (("email", "email", ORACLES["find_email"]), ("ip", "ip", ORACLES["find_ipv4"]), ("credit_card", "credit_card", ORACLES["find_credit_card"]), ("secret", "secret", _located(_DOCS, _AWS, 1)), ("credential", "password", ORACLES["find_password"]))
)
_CLEAN = f"""
with found as ({_ALL}), tokens as (select doc_id, list({{'beg': beg, 'end': "end", 'token': '{{{{' || upper(pii_type) || '}}}}'}} order by beg) as t from found group by doc_id)
select doc_id, case when t is null then text else array_to_string(list_transform(range(1, len(t) + 1), lambda i: substr(text, case when i = 1 then 1 else t[i - 1]."end" + 1 end, t[i].beg - case when i = 1 then 0 else t[i - 1]."end" end) || t[i].token), '') || substr(text, t[len(t)]."end" + 1) end as text,
    cast(coalesce(len(t), 0) as integer) as n_findings
from documents left join tokens using (doc_id)"""


@query(_CLEAN)
def clean_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: every default detector, overlaps settled, tokens in place."""
    cleaned = Scrubber().scrub_documents(_documents(spark, sf_dir)).documents
    return cleaned.select(F.col("doc_ord").alias("doc_id"), "text", F.size("findings").alias("n_findings"))


@query(f"select doc_id, text from ({_CLEAN})")
def clean_sql_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    from palimpsest.sql import clean_view

    _spread(_table(spark, sf_dir, "documents").select("doc_id", "text")).createOrReplaceTempView("documents_to_clean")
    clean_view(spark, "documents_to_clean", "cleaned_documents")
    return spark.sql("select doc_id, text from cleaned_documents")


@query(f"select doc_id, '{{\"beg\":' || beg || ',\"end\":' || \"end\" || ',\"pii_type\":\"email\",\"detector\":\"email\",\"score\":1.0,\"locale\":\"en_US\",\"document\":\"' || doc_id || '\"}}' as value from ({ORACLES['find_email']})")
def findings_audit_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = Scrubber(detectors=["email"]).find_documents(_documents(spark, sf_dir))
    lines = findings_json(found)
    return lines.select(F.get_json_object("value", "$.document").cast("long").alias("doc_id"), "value")


@query(f"select doc_id || ':' || beg || '-' || \"end\" || chr(9) || 'email' || chr(9) || '1.00' || chr(9) || 'email' || chr(9) || found as value from ({ORACLES['find_email']})")
def findings_report_tsv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings_tsv(Scrubber(detectors=["email"]).find_documents(_documents(spark, sf_dir)), include_text=True)


@query(f"select pii_type, count(*) as n, count(distinct doc_id) as docs from ({_ALL}) group by pii_type")
def findings_by_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Scrubber().find_documents(_documents(spark, sf_dir)).groupBy("pii_type").agg(F.count("*").alias("n"), F.countDistinct("doc_ord").alias("docs"))


@query(f"select lang, source, count(*) as n from ({ORACLES['find_email']}) join documents using (doc_id) group by cube (lang, source)")
def findings_by_lang_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    found = Scrubber(detectors=["email"]).find_documents(_documents(spark, sf_dir)).select(F.col("doc_ord").alias("doc_id"))
    return found.join(docs.select("doc_id", "lang", "source"), "doc_id").cube("lang", "source").agg(F.count("*").alias("n"))


@query(f"select doc_id, count(*) as n from ({_ALL}) group by doc_id order by n desc, doc_id limit 20")
def top_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = Scrubber().find_documents(_documents(spark, sf_dir)).groupBy(F.col("doc_ord").alias("doc_id")).agg(F.count("*").alias("n"))
    return counts.orderBy(F.desc("n"), "doc_id").limit(20)


@query("select cast(max({'n': length(text), 'd': cast(doc_id as varchar)}).d as varchar) as longest, max(length(text)) as chars, cast(sum(length(text)) as bigint) as total_chars from documents")
def limits_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Limits.measure(_documents(spark, sf_dir))


@query("select toxic, quality, count(distinct f.doc_id) as docs, count(*) as n from labels join (" + ORACLES["find_email"] + ") f using (doc_id) group by toxic, quality")
def findings_by_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = Scrubber(detectors=["email"]).find_documents(_documents(spark, sf_dir)).select(F.col("doc_ord").alias("doc_id"))
    return _table(spark, sf_dir, "labels").join(found, "doc_id").groupBy("toxic", "quality").agg(F.countDistinct("doc_id").alias("docs"), F.count("*").alias("n"))


@query(_rendered_sql("'{{EMAIL}}'"))
def stream_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same over a stream of files, run until what is there is done."""
    from palimpsest.streaming import clean_stream

    schema = _table(spark, sf_dir, "documents").schema
    docs = spark.readStream.schema(schema).parquet(f"{sf_dir}/documents.[p]arquet")  # a pattern may meet a file or a folder; a plain path of a stream only a folder
    cleaned = clean_stream(Scrubber(detectors=["email"]), as_documents(docs.select("doc_id", "text"), id_col="doc_id"))
    home = shared_folder(spark)
    out = f"{home}/stream-{uuid.uuid4()}"
    cleaned.writeStream.format("parquet").option("path", f"{out}/data").option("checkpointLocation", f"{out}/log").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(cleaned.schema).parquet(f"{out}/data").select(F.col("doc_ord").alias("doc_id"), "text")
