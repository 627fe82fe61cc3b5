"""Quality classifier: a sparse rule ensemble over text statistics.

Boosted trees are grown on the statistics of a bounded sample of labelled documents. Each path to a
node becomes a conjunctive rule; a logistic model with an L1 penalty keeps a few rules with weights;
those are compiled into one Spark column expression over the statistics.
"""

from __future__ import annotations

import operator
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.llm import trees
from palimpsest.llm.common import crc_bucket, fraction_of, free_name, text_batches, tidied

#: Labelled documents that a fit uses at most (about; they are drawn by a hash).
SAMPLE = 10_000
PENALTY = 0.002

STATISTICS = ["chars", "words", "word_length", "distinct_words", "repeated_next", "upper", "digits", "symbols", "bars", "exclamations", "punctuation", "not_ascii", "spaces", "line_words"]
_PREFIX = "_stat_"

_UPPER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_DIGITS = b"0123456789"
_SYMBOLS = b"#$%&*+/<=>@[\\]^_`{}~"
_PUNCTUATION = b".,;:?'\"()-"
_HIGH = bytes(range(128, 256))
_SPACES = b" \t\r\n\x0b\x0c"


def statistics(text: str | None) -> list[float]:
    """The statistics of a whole text, in the order of STATISTICS; null and empty texts have zeros."""
    if not text:
        return [0.0] * len(STATISTICS)
    raw, words = text.encode("utf-8", "surrogatepass"), text.split()
    n, k = len(raw), max(1, len(words))
    share = lambda of: (n - len(raw.translate(None, of))) / n
    return [
        float(len(text)), float(len(words)), sum(map(len, words)) / k, len(set(words)) / k, sum(map(operator.eq, words, words[1:])) / k,
        share(_UPPER), share(_DIGITS), share(_SYMBOLS), share(b"|"), share(b"!"), share(_PUNCTUATION), share(_HIGH), share(_SPACES), len(words) / (1 + text.count("\n")),
    ]


def with_statistics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows with one column more for each statistic: ``free_name(docs, _PREFIX)`` and its name."""
    text_batches(docs.sparkSession)
    place, prefix = docs.columns.index(text_col), free_name(docs, _PREFIX)
    schema = T.StructType(docs.schema.fields + [T.StructField(prefix + s, T.DoubleType()) for s in STATISTICS])

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = np.array([statistics(t) for t in batch.column(place).to_pylist()], np.float64).reshape(-1, len(STATISTICS))
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(np.ascontiguousarray(c)) for c in rows.T)], names=schema.names)

    return docs.mapInArrow(tidied(measured), schema)


@dataclass
class RuleEnsemble:
    """Weighted conjunctive rules; ``column`` compiles them."""

    rules: list[tuple[trees.Condition, ...]]
    weights: list[float]
    intercept: float

    def column(self, prefix: str = _PREFIX) -> Column:
        """Probability of label 1, as an expression over the statistics' columns."""
        features = [prefix + s for s in STATISTICS]
        terms = [f"if({trees.rule_sql(rule, features)}, {weight!r}D, 0D)" for rule, weight in zip(self.rules, self.weights, strict=True)]
        return F.expr(f"1 / (1 + exp(-({' + '.join([f'{self.intercept!r}D', *terms])})))")

    def __str__(self) -> str:
        said = [" and ".join(f"{STATISTICS[f]} {'<=' if m else '>'} {t:.4g}" for f, m, t in rule) for rule in self.rules]
        return "\n".join([f"{self.intercept:+.3f}", *(f"{w:+.3f} if {s}" for w, s in zip(self.weights, said, strict=True))])


def fit_rules(x: np.ndarray, y: np.ndarray, penalty: float = PENALTY) -> RuleEnsemble:
    """Rules of boosted trees with lasso weights; with labels of one kind, or none, a constant."""
    if len(y) == 0 or y.min() == y.max():
        ones = (y.sum() + 1) / (len(y) + 2)
        return RuleEnsemble([], [], float(np.log(ones / (1 - ones))))
    rules = list(dict.fromkeys(rule for tree in trees.boosted(x, y) for rule in trees.paths(tree)))
    covered = np.stack([trees.holds(rule, x) for rule in rules], axis=1).astype(np.float32)
    weights, intercept = trees.lasso_logistic(covered, y.astype(np.float32), penalty)
    kept = np.flatnonzero(np.abs(weights) > 1e-6)
    return RuleEnsemble([rules[i] for i in kept], [float(weights[i]) for i in kept], float(intercept))


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE, penalty: float = PENALTY) -> RuleEnsemble:
    """Learn from labelled documents: ``labels`` has id_col and label_col (0 or 1).

    Null labels and ids take no part; of several labels of one document the smallest counts. The statistics
    of about ``sample`` labelled documents come to the driver, never texts.
    """
    marked = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_y")).where("_id is not null and _y in (0, 1)").groupBy("_id").agg(F.min("_y").alias("_y"))
    count = marked.count()
    drawn = marked.where(fraction_of([F.col("_id")]) < F.lit(min(1.0, sample / max(1, count))))
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text")).join(F.broadcast(drawn), "_id").select("_y", "text")
    table = with_statistics(rows).drop("text").toPandas()
    return fit_rules(table[[_PREFIX + s for s in STATISTICS]].to_numpy(float), table["_y"].to_numpy(float), penalty)


def held_out(column: str = "doc_id") -> Column:
    return crc_bucket(column, 3) == 1


def score(docs: DataFrame, model: RuleEnsemble, *, text_col: str = "text") -> DataFrame:
    """The rows with ``score``, the probability of label 1, in the place of any column of that name; null and empty texts get a score as well."""
    prefix = free_name(docs, _PREFIX)
    return with_statistics(docs, text_col).withColumn("score", model.column(prefix)).drop(*(prefix + s for s in STATISTICS))


def keep_good(docs: DataFrame, model: RuleEnsemble, *, text_col: str = "text", least: float = 0.5) -> DataFrame:
    """The documents that the model does not reject, with the columns they had."""
    return with_statistics(docs, text_col).where(model.column(free_name(docs, _PREFIX)) >= F.lit(least)).select(*docs.columns)
