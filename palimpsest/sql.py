"""The scrubber in SQL.

Views carry the native plan: ``clean_view`` and ``findings_view`` make a table's cleaned texts and its
findings available by name, and the optimizer sees through them. For texts that come out of other SQL
expressions there is a table function, ``find_pii(text)``, for LATERAL joins; it runs Python detectors
(``re`` patterns given as PythonRegexDetector, or any other) on the executors.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from palimpsest.operators.detectors import PythonDetector
from palimpsest.plans.engine import Scrubber, as_documents, explode_findings


def clean_view(spark: SparkSession, table: str, view: str, scrubber: Scrubber | None = None, text_col: str = "text") -> None:
    """A temporary view of the table with its texts cleaned."""
    (scrubber or Scrubber()).clean_table(spark.table(table), text_col).createOrReplaceTempView(view)


def findings_view(spark: SparkSession, table: str, view: str, scrubber: Scrubber | None = None, text_col: str = "text", id_col: str | None = None) -> None:
    """A temporary view with a row for each finding in the table's texts."""
    docs = as_documents(spark.table(table), text_col=text_col, id_col=id_col)
    explode_findings((scrubber or Scrubber()).annotate(docs)).createOrReplaceTempView(view)


def register_table_function(spark: SparkSession, detectors: Sequence[PythonDetector], name: str = "find_pii") -> None:
    """``SELECT f.* FROM t, LATERAL find_pii(t.text) f``."""
    running = list(detectors)

    class FindPii:
        def eval(self, text: str | None) -> Iterator[tuple]:
            for detector in running if text is not None else ():
                for f in detector.find(text):
                    yield f.beg, f.end, f.text, f.pii_type, f.detector, float(f.score)

    spark.udtf.register(name, F.udtf(FindPii, returnType="beg int, end int, text string, pii_type string, detector string, score double"))
