"""Files and tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.operators.numbering import TokenMap
from palimpsest.plans.lineage import cut_lineage


def read_text_files(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(document, doc_ord, text): a document for each file, named and ordered by its path.

    Line ends become line feeds, as in Python's text mode.
    """
    path = F.input_file_name()
    return spark.read.text(paths, wholetext=True).select(path.alias("document"), path.alias("doc_ord"), F.regexp_replace("value", "\r\n?", "\n").alias("text"))


def write_cleaned(documents: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Cleaned documents as Parquet, without findings."""
    documents.select("document", "doc_ord", "text").write.mode(mode).parquet(path)


def write_tokens(tokens: TokenMap, path: str, include_originals: bool = False, mode: str = "errorifexists") -> None:
    """The token map as tables; originals undo the scrubbing and are withheld unless asked for.

    With ``overwrite`` both are checkpointed before either is written: they may come from the tables that go.
    """
    tables = {"counts": tokens.counts, "originals": tokens.originals if include_originals else None}
    ready = {name: cut_lineage(t) if mode == "overwrite" else t for name, t in tables.items() if t is not None}
    for name, t in ready.items():
        t.write.mode(mode).parquet(f"{path}/{name}")


def read_tokens(spark: SparkSession, path: str, originals: bool = False) -> TokenMap:
    return TokenMap(counts=spark.read.parquet(f"{path}/counts"), keep_originals=originals, originals=spark.read.parquet(f"{path}/originals") if originals else None)
