"""URL filters: a temporal join of captures against dated list entries.

A list is a history: entries (pattern, category, action, dated), where ``add`` puts a pattern on the list
and ``remove`` takes it off. The history becomes validity intervals, and a capture is judged by the
entries that were active when it was fetched.

A pattern is a host with or without a path prefix of any number of segments ("ads.example.com",
"example.com/ads"); it covers its subdomains. Each capture is looked up under every suffix of its host,
with every prefix of its path that is no deeper than the list's deepest, so the join is by equality.

Everything here is DataFrame operations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.llm.common import cut_lineage

#: Intervals that may be broadcast, a few hundred bytes each; beyond this the join deals out both sides.
BROADCAST_INTERVALS = 100_000
#: Names of one label (such as a top-level domain) that a list may hold for captures to be asked about only those.
TOP_NAMES = 2_000


def host_of(url: Column) -> Column:
    """The lower-cased host of a URL without user, port or final dot; empty if it has none."""
    return F.regexp_replace(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), r"\.+$", "")


def _segments(url: Column, deepest: int | None) -> Column:
    """The first ``deepest`` segments of the path, as given; all if that is None."""
    path = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*(/[^?#]*)", 1)
    found = F.filter(F.split(path, "/"), lambda s: s != "")
    return found if deepest is None else F.slice(found, 1, deepest)


def lookup_keys(url: Column, deepest: int | None = None) -> Column:
    """Every pattern of up to ``deepest`` segments that would cover the URL: suffixes of its host times prefixes of its path."""
    labels = F.split(host_of(url), r"\.")
    hosts = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    paths = F.transform(F.sequence(F.lit(0), F.size(_segments(url, deepest))), lambda n: F.array_join(F.transform(F.slice(_segments(url, deepest), 1, n), lambda s: F.concat(F.lit("/"), s)), ""))
    return F.when(host_of(url) != "", F.flatten(F.transform(hosts, lambda h: F.transform(paths, lambda p: F.concat(h, p)))))


def intervals(entries: DataFrame) -> DataFrame:
    """(pattern, category, since, until) of a list's history; until is null while an entry is active.

    Entries with a null pattern, category, action or date take no part. Host names compare in lower case.
    Of several entries for one pattern and category at one time a removal wins; repeats change nothing.
    """
    host, path = F.lower(F.substring_index("pattern", "/", 1)), F.regexp_extract("pattern", "/.*$", 0)
    known = entries.select(F.concat(host, F.rtrim(path, F.lit("/"))).alias("pattern"), "category", "action", F.col("dated").cast("timestamp").alias("since")).dropna()
    state = known.groupBy("pattern", "category", "since").agg(F.max("action").alias("action"))
    history = Window.partitionBy("pattern", "category").orderBy("since")
    return state.withColumn("until", F.lead("since").over(history)).where(F.col("action") == "add").drop("action")


def evaluate(captures: DataFrame, entries: DataFrame, *, id_col: str = "page_id", url_col: str = "url", fetched_col: str = "fetched_at", broadcast_intervals: int = BROADCAST_INTERVALS) -> DataFrame:
    """Of each capture (id_col, host, fetched_at): blocked, n_entries (active ones that cover it), categories, listed_since (the earliest).

    A null or malformed URL, or a null time, is covered by nothing. Repeated rows come back as often as they
    occur; an empty list blocks nothing; other columns are ignored.
    """
    list_ = cut_lineage(intervals(entries))
    size, deepest = list_.agg(F.count("*"), F.coalesce(F.max(F.size(F.split("pattern", "/"))) - 1, F.lit(0))).head()
    if size <= broadcast_intervals:
        list_ = F.broadcast(list_)
    rows = captures.select(F.col(id_col).alias("page_id"), F.coalesce(host_of(F.col(url_col)), F.lit("")).alias("host"), F.col(fetched_col).cast("timestamp").alias("fetched_at"), F.col(url_col).alias("url"), F.monotonically_increasing_id().alias("row"))
    keys = lookup_keys(F.col("url"), deepest)
    if size > broadcast_intervals:  # else every capture would meet under its top-level domain, which lists hardly hold
        tops = [r[0] for r in list_.select(F.substring_index("pattern", "/", 1).alias("host")).where("host not like '%.%'").distinct().limit(TOP_NAMES + 1).collect()]
        if len(tops) <= TOP_NAMES:
            keys = F.filter(keys, lambda k: F.substring_index(k, "/", 1).contains(".") | F.substring_index(k, "/", 1).isin(tops))
    asked = rows.select("row", "page_id", "host", "fetched_at", F.explode_outer(keys).alias("key"))
    if size > broadcast_intervals:  # captures without a key are dealt out, too
        asked = asked.withColumn("key", F.coalesce("key", F.concat(F.lit("\u0000"), F.col("row").cast("string"))))
    active = (F.col("key") == F.col("pattern")) & (F.col("fetched_at") >= F.col("since")) & (F.col("until").isNull() | (F.col("fetched_at") < F.col("until")))
    judged = asked.join(list_, active, "left").groupBy("row", "page_id", "host", "fetched_at").agg(
        F.count("pattern").alias("n_entries"),
        F.array_join(F.array_sort(F.collect_set("category")), ",").alias("categories"),
        F.min("since").alias("listed_since"),
    )
    return judged.select("page_id", "host", "fetched_at", (F.col("n_entries") > 0).alias("blocked"), "n_entries", "categories", "listed_since")
