"""Entity numbers that hold across documents and runs: the one stage that shuffles.

Each kind counts its entities from 0 in the order of their first mention. A token map is a small table
(key, pii_type, index); a later run carries on from it. Keys are aggregated before anything is ranked.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palimpsest.operators.render import group_key

COUNTS = "key string, pii_type string, index long"
ORIGINALS = "token string, original string"


@dataclass
class TokenMap:
    """Numbers known from earlier runs, how entities are told apart, and whether originals are kept.

    counts: None or a table (key, pii_type, index). originals: None or (token, original), as sensitive as
    the documents.
    """

    group_key: Callable[[Column], Column] = group_key
    keep_originals: bool = False
    counts: DataFrame | None = None
    originals: DataFrame | None = field(default=None, repr=False)

    def __len__(self) -> int:
        return 0 if self.counts is None else self.counts.count()

    def original_of(self, token: str) -> str | None:
        if self.originals is None:
            return None
        row = self.originals.where(F.col("token") == token).head()
        return row["original"] if row else None

    def to_dict(self, include_originals: bool = False) -> dict[str, Any]:
        """For interchange; whole maps are written as tables (``palimpsest.sources.write_tokens``)."""
        payload: dict[str, Any] = {"counts": {} if self.counts is None else {r["key"]: r["index"] for r in self.counts.collect()}}
        if include_originals and self.originals is not None:
            kept = {r["token"]: r["original"] for r in self.originals.collect()}
            payload |= {"originals": kept} if kept else {}
        return payload

    def to_json(self, include_originals: bool = False) -> str:
        return json.dumps(self.to_dict(include_originals), sort_keys=True)

    @classmethod
    def from_dict(cls, spark: SparkSession, payload: Mapping[str, Any], key: Callable[[Column], Column] = group_key) -> TokenMap:
        counts = [(k, k.split(":", 1)[0], i) for k, i in (payload.get("counts") or {}).items()]
        originals = list((payload.get("originals") or {}).items())
        return cls(key, bool(originals), spark.createDataFrame(counts, COUNTS), spark.createDataFrame(originals, ORIGINALS) if originals else None)


def _ranked(new: DataFrame, rows_per_task: int) -> DataFrame:
    """(key, pii_type, rank), ranks from 0 by first mention within each kind.

    A kind may have most of the entities: they are dealt out by range, ranked within each range, and moved
    up by how many the ranges before hold. Only those counts, a few for each range, meet in one place.
    """
    from palimpsest.plans.lineage import cut_lineage

    new = cut_lineage(new)
    ranges = -(-new.count() // rows_per_task)
    if ranges <= 1:
        return new.select("key", "pii_type", (F.row_number().over(Window.partitionBy("pii_type").orderBy("first")) - 1).alias("rank"))
    dealt = cut_lineage(new.repartitionByRange(ranges, "pii_type", "first").withColumn("range", F.spark_partition_id()))
    inside = F.row_number().over(Window.partitionBy("range", "pii_type").orderBy("first")) - 1
    sizes = dealt.groupBy("range", "pii_type").count()
    before = F.sum("count").over(Window.partitionBy("pii_type").orderBy("range").rowsBetween(Window.unboundedPreceding, -1))
    moved = sizes.select("range", "pii_type", F.coalesce(before, F.lit(0)).alias("before"))
    return dealt.withColumn("inside", inside).join(moved, ["range", "pii_type"]).select("key", "pii_type", (F.col("inside") + F.col("before")).alias("rank"))


def newly_numbered(mentions: DataFrame, known: DataFrame | None = None, rows_per_task: int = 1_000_000) -> DataFrame:
    """Entities (key, pii_type, index) of mentions (key, pii_type, doc_ord, beg) that are not known yet.

    An entity that several kinds claim (by a key of one's own) has the kind of its first mention.
    """
    first = mentions.groupBy("key").agg(F.min(F.struct("doc_ord", "beg", "pii_type", "key")).alias("first"))  # ends with the key: no two are equal
    new = first if known is None else first.join(known.select("key"), "key", "left_anti")
    ranked = _ranked(new.select("key", "first.pii_type", "first"), rows_per_task)
    if known is None:
        return ranked.select("key", "pii_type", F.col("rank").cast("long").alias("index"))
    offset = known.groupBy(F.substring_index("key", ":", 1).alias("pii_type")).agg((F.max("index") + 1).alias("next"))
    numbered = ranked.join(F.broadcast(offset), "pii_type", "left")  # a row for each kind
    return numbered.select("key", "pii_type", (F.col("rank") + F.coalesce("next", F.lit(0))).cast("long").alias("index"))


def all_known(known: DataFrame | None, new: DataFrame) -> DataFrame:
    return new if known is None else known.select("key", "pii_type", F.col("index").cast("long")).union(new)


def number(mentions: DataFrame, known: DataFrame | None = None, rows_per_task: int = 1_000_000) -> DataFrame:
    """All entities (key, pii_type, index) after mentions (key, pii_type, doc_ord, beg)."""
    return all_known(known, newly_numbered(mentions, known, rows_per_task))
