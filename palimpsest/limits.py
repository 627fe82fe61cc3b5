"""Bounds on what one call may process, checked by one aggregate over the input."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.errors import LimitExceededError


@dataclass(frozen=True)
class Limits:
    max_chars: int = 10_000_000
    max_total_chars: int = 100_000_000
    max_findings: int = 1_000_000

    def __post_init__(self) -> None:
        for field in fields(self):
            if getattr(self, field.name) <= 0:
                raise ValueError(f"{field.name} is {getattr(self, field.name)}; it must be positive")

    @staticmethod
    def measure(docs: DataFrame) -> DataFrame:
        """One row: the longest document, its length, and the length of all."""
        size = F.coalesce(F.length("text"), F.lit(0)).cast("long")
        return docs.agg(F.max_by("document", F.struct(size, F.col("document"))).alias("longest"), F.coalesce(F.max(size), F.lit(0)).alias("chars"), F.coalesce(F.sum(size), F.lit(0)).alias("total_chars"))

    def check_documents(self, docs: DataFrame) -> None:
        row = self.measure(docs).head()
        if row["chars"] > self.max_chars:
            raise LimitExceededError("input length" if row["longest"] is None else f"length of document {row['longest']!r}", row["chars"], self.max_chars)
        if row["total_chars"] > self.max_total_chars:
            raise LimitExceededError("length of all documents", row["total_chars"], self.max_total_chars)

    def check_count(self, findings: int) -> None:
        if findings > self.max_findings:
            raise LimitExceededError("number of findings", findings, self.max_findings)

    def quarantine(self, docs: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Documents within max_chars, and those beyond: for jobs that set oversized ones aside instead of failing."""
        fits = F.coalesce(F.length("text"), F.lit(0)) <= self.max_chars
        return docs.where(fits), docs.where(~fits)
