"""Findings, and the detectors that there are, as tables and lines of text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.locales import DEFAULT_LOCALE
from palimpsest.operators.registry import default_registry, plugin_entries


def tsv_line(include_text: bool = False) -> Column:
    """document:beg-end, kind, score, detector and, if asked for, the text; separated by tabs."""
    where = F.format_string("%s:%d-%d", F.coalesce("document", F.lit("None")), "beg", "end")
    fields = [where, F.col("pii_type"), F.format_string("%.2f", "score"), F.col("detector")]
    return F.concat_ws("\t", *fields, *([F.col("text")] if include_text else []))


def findings_tsv(findings: DataFrame, include_text: bool = False) -> DataFrame:
    return findings.select(tsv_line(include_text).alias("value"))


def findings_json(findings: DataFrame, include_text: bool = False) -> DataFrame:
    """One object a line; fields that are null are left out, and the text unless it is asked for."""
    fields = ["beg", "end", "pii_type", "detector", "score", "locale", "document", "context", *(["text"] if include_text else [])]
    return findings.select(F.to_json(F.struct(*fields)).alias("value"))


def detector_table(spark: SparkSession, locale: str = DEFAULT_LOCALE) -> tuple[DataFrame, list[str]]:
    """(position, name, default, locales, extra, plugin) of every detector, and the plugins whose names were taken."""
    registry = default_registry(plugins=False)
    plugins = registry.add_plugins()
    runs = registry.select(locale)
    rows = [(i, e.name, e in runs, sorted(e.locales) if e.locales else None, e.extra, e.name in plugins) for i, e in enumerate(registry)]
    table = spark.createDataFrame(rows, "position int, name string, default boolean, locales array<string>, extra string, plugin boolean")
    return table, sorted({e.name for e in plugin_entries()}.difference(plugins))


def detector_lines(table: DataFrame) -> DataFrame:
    """A line for each detector, in order: its name and what is to be said of it, separated by tabs."""
    marks = [F.when(F.col("default"), "default").otherwise("opt-in"), F.concat(F.lit("extra="), "extra"), F.when(F.col("plugin"), "plugin"), F.array_join("locales", ",")]
    return table.orderBy("position").select(F.concat_ws("\t", "name", *marks).alias("value"))
