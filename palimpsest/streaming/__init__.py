"""Scrubbing streams of documents."""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from palimpsest.operators.numbering import COUNTS, ORIGINALS, TokenMap
from palimpsest.plans.engine import Scrubber, explode_findings


def clean_stream(scrubber: Scrubber, docs: DataFrame) -> DataFrame:
    """Cleaned documents of a stream, without state; not for renderers that number entities."""
    if scrubber.renderer.needs_index:
        raise ValueError("numbers need state that lasts; use number_stream")
    return scrubber.scrub_documents(docs).documents.drop("findings")


def findings_per_window(scrubber: Scrubber, docs: DataFrame, time_col: str, window: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """Findings by kind and window of an event time; documents later than ``late`` are not counted."""
    found = scrubber.annotate(docs.withWatermark(time_col, late))
    rows = found.select(time_col, F.explode("findings").alias("f"))
    return rows.groupBy(F.window(time_col, window), F.col("f.pii_type").alias("pii_type")).count()


def number_stream(scrubber: Scrubber, docs: DataFrame, out: str, tokens: str, checkpoint: str, trigger: Mapping[str, Any] | None = None) -> StreamingQuery:
    """Write cleaned documents with numbered entities, batch after batch.

    Each batch reads the entities that the batches before it were the first to mention, and writes only
    those that it adds itself, in a folder of its own: one that is run again sees the same map and
    overwrites its own output. Numbers follow the order in which batches arrive. Originals are written
    too where the scrubber's token map keeps them; ``stream_tokens`` reads both. ``trigger`` as in
    ``DataStreamWriter.trigger``; what is there by now, unless it says otherwise.
    """

    def one(batch: DataFrame, batch_id: int) -> None:
        known = _written(batch.sparkSession, f"{tokens}/counts", COUNTS).where(F.col("batch") < batch_id).drop("batch") if batch_id else None
        numbered = Scrubber(
            scrubber.locale, [*scrubber.detectors], scrubber.registry, scrubber.min_score, scrubber.strategy, scrubber.priority, scrubber.renderer,
            TokenMap(scrubber.tokens.group_key, scrubber.tokens.keep_originals, known), scrubber.limits, scrubber.on_detector_error,
        )
        result = numbered.scrub_documents(batch)
        new = result.new_entities if result.new_entities is not None else batch.sparkSession.createDataFrame([], COUNTS)
        new.hint("rebalance").write.mode("overwrite").parquet(f"{tokens}/counts/batch={batch_id}")
        if result.tokens.originals is not None:
            result.tokens.originals.hint("rebalance").write.mode("overwrite").parquet(f"{tokens}/originals/batch={batch_id}")
        result.documents.drop("findings").write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    return docs.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def stream_tokens(spark: SparkSession, tokens: str, originals: bool = False) -> TokenMap:
    """The token map of a numbered stream; an original that several batches wrote is that of the last one."""
    counts = _written(spark, f"{tokens}/counts", COUNTS).drop("batch")
    kept = _written(spark, f"{tokens}/originals", ORIGINALS).groupBy("token").agg(F.max_by("original", "batch").alias("original")) if originals else None
    return TokenMap(counts=counts, keep_originals=originals, originals=kept)


def _written(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(f"{schema}, batch long").parquet(path)


__all__ = ["clean_stream", "explode_findings", "findings_per_window", "number_stream", "stream_tokens"]
