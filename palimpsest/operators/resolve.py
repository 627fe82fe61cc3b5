"""Overlapping findings: which of them stay.

The nested form works on a document's array of findings without a shuffle; the row form does the same for
tables with a row for each finding, and for documents with very many of them, by windows.
"""

from __future__ import annotations

from collections.abc import Mapping
from enum import StrEnum

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


class Strategy(StrEnum):
    HIGHEST_SCORE = "highest_score"
    LONGEST = "longest"
    MERGE = "merge"
    KEEP_ALL = "keep_all"


def overlaps(a: Column, b: Column) -> Column:
    """Whether two spans share a character; touching ones do not."""
    return (a["beg"] < b["end"]) & (b["beg"] < a["end"])


def _weight(detector: Column, priority: Mapping[str, int]) -> Column:
    weight = F.lit(0)
    for name, value in sorted(priority.items()):
        weight = F.when(detector == name, F.lit(int(value))).otherwise(weight)
    return weight


def _ordered(findings: Column, key) -> Column:
    """The array sorted by a struct of each element and its place; maps within elements are never compared."""
    keyed = F.transform(findings, lambda f, i: F.struct(*key(f), i.alias("_at")))
    return F.transform(F.array_sort(keyed), lambda k: F.get(findings, k["_at"]))


def by_position(findings: Column) -> Column:
    return _ordered(findings, lambda f: [f["beg"], -f["end"]])


def _greedy(findings: Column, strategy: Strategy, priority: Mapping[str, int]) -> Column:
    """Take the best, then the next best that overlaps none taken. Clusters do not meet, so one pass does all."""

    def key(f: Column) -> list[Column]:
        size = f["end"] - f["beg"]
        first = [-size, -f["score"]] if strategy is Strategy.LONGEST else [-f["score"], -size]
        return [*first, -_weight(f["detector"], priority), f["beg"]]

    ranked = _ordered(findings, key)
    taken = F.aggregate(ranked, F.slice(findings, 1, 0), lambda kept, f: F.when(F.exists(kept, lambda k: overlaps(k, f)), kept).otherwise(F.array_append(kept, f)))
    return by_position(taken)


def _merged(findings: Column) -> Column:
    """Every cluster of findings connected by overlap becomes one finding."""
    ordered = by_position(findings)

    def step(groups: Column, f: Column) -> Column:
        last = F.get(groups, F.size(groups) - 1)
        joins = (F.size(groups) > 0) & (f["beg"] < F.array_max(F.transform(last, lambda g: g["end"])))
        grown = F.concat(F.slice(groups, 1, F.greatest(F.size(groups) - 1, F.lit(0))), F.array(F.array_append(last, f)))
        return F.when(joins, grown).otherwise(F.array_append(groups, F.array(f)))

    def fuse(group: Column) -> Column:
        first = F.get(group, F.lit(0))
        names = lambda field: F.array_join(F.array_sort(F.array_distinct(F.transform(group, lambda g: g[field]))), "+")
        grown = F.aggregate(group, first["text"], lambda t, g: F.concat(t, F.right(g["text"], F.greatest(g["end"] - first["beg"] - F.length(t), F.lit(0)))))
        one = F.struct(
            first["beg"].alias("beg"), F.array_max(F.transform(group, lambda g: g["end"])).alias("end"), grown.alias("text"), names("pii_type").alias("pii_type"), names("detector").alias("detector"),
            F.array_max(F.transform(group, lambda g: g["score"])).alias("score"), first["locale"].alias("locale"), first["document"].alias("document"),
            F.create_map(F.lit("merged"), F.size(group).cast("string")).alias("context"),
        )
        return F.when(F.size(group) == 1, first).otherwise(one)

    none = F.slice(F.array(findings), 1, 0)
    return F.transform(F.aggregate(ordered, none, step), fuse)


def resolve(findings: Column, strategy: Strategy | str = Strategy.HIGHEST_SCORE, priority: Mapping[str, int] | None = None) -> Column:
    """Ordered findings; disjoint ones unless all are kept. Equals go to the one that came first in the array."""
    strategy = Strategy(strategy)
    if strategy is Strategy.KEEP_ALL:
        return by_position(findings)
    settled = _merged(findings) if strategy is Strategy.MERGE else _greedy(findings, strategy, priority or {})
    return F.when(F.size(findings) > 1, settled).otherwise(findings)


def clusters(rows: DataFrame, by: str = "document") -> DataFrame:
    """Rows with ``cluster``, numbered from 0 within each document: findings connected by overlap share one."""
    order = Window.partitionBy(by).orderBy("beg", F.desc("end"))
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    opens = (reach.isNull() | (F.col("beg") >= reach)).cast("int")
    return rows.withColumn("_opens", opens).withColumn("cluster", F.sum("_opens").over(order.rowsBetween(Window.unboundedPreceding, 0)) - 1).drop("_opens")


def resolve_rows(rows: DataFrame, strategy: Strategy | str = Strategy.HIGHEST_SCORE, priority: Mapping[str, int] | None = None, by: str = "document", order: str | None = None) -> DataFrame:
    """The row form: rows have ``by``, beg, end, pii_type, detector, score, and maybe ``order`` to settle equals.

    Merging is aggregation. The greedy choice is made cluster by cluster: an array holds one cluster, never
    a whole document. Returns by, beg, end, pii_type, detector, score.
    """
    strategy = Strategy(strategy)
    fields = ["beg", "end", "pii_type", "detector", "score"]
    if strategy is Strategy.KEEP_ALL:
        return rows.select(by, *fields)
    grouped = clusters(rows, by).groupBy(by, "cluster")
    if strategy is Strategy.MERGE:
        names = lambda field: F.array_join(F.array_sort(F.collect_set(field)), "+").alias(field)
        return grouped.agg(F.min("beg").alias("beg"), F.max("end").alias("end"), names("pii_type"), names("detector"), F.max("score").alias("score")).drop("cluster")
    first = F.col(order) if order else F.lit(0)
    gathered = grouped.agg(F.array_sort(F.collect_list(F.struct(first.alias("_order"), *fields))).alias("f"))
    return gathered.select(by, F.explode(resolve(F.col("f"), strategy, priority)).alias("f")).select(by, *(f"f.{c}" for c in fields))
