"""Cross-site boilerplate: lines that many sites share, found by HyperLogLog sketches per line.

A line's spread is the number of distinct sites (values of ``source``) it occurs on. Lines that occur less
often than the threshold cannot reach it and get no sketch. For the others a HyperLogLog sketch of the
sites is built for each line hash in every partition and merged by aggregation. Lines whose estimate is
near the threshold get exact distinct counts; the rest is decided by the estimate.

A document of which every line with text is shared is a copy rather than a page with boilerplate: it is left
as it is, for near-duplicate detection to judge. Whatever has other lines as well loses the shared ones, however
little is left.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.llm.common import cut_lineage, free_name, text_batches, tidied

SITES = 10
#: log2 of a sketch's registers; its relative standard error is 1.04 / sqrt(4096) = 1.6 %.
SKETCH = 12
#: Line hashes in a broadcast, 8 bytes each: 16 MB. Beyond this many the lines are joined instead.
BROADCAST_LINES = 2_000_000


def _lines(docs: DataFrame, text_col: str, site_col: str) -> DataFrame:
    hashes = F.transform(F.split(F.col(text_col), "\n", -1), lambda line: F.xxhash64(line))
    return docs.select(F.explode(hashes).alias("line"), F.col(site_col).cast("string").alias("site"))


def boilerplate(docs: DataFrame, *, text_col: str = "text", site_col: str = "source", sites: int = SITES) -> DataFrame:
    """The hashes (xxhash64) of lines that occur on at least ``sites`` distinct sites.

    A null site is none; the empty line never counts; repeated rows add nothing, since sites are counted.
    """
    lines = _lines(docs, text_col, site_col).where(F.col("site").isNotNull() & (F.col("line") != F.xxhash64(F.lit(""))))
    often = lines.groupBy("line").count().where(F.col("count") >= sites).select("line")
    often = cut_lineage(often)
    if often.count() <= BROADCAST_LINES // 4:  # then the hottest line is not dealt to one task
        often = F.broadcast(often)
    seen = cut_lineage(lines.join(often, "line", "left_semi"))
    spread = seen.groupBy("line").agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", SKETCH)).alias("about"))
    margin = max(1.0, 4 * 1.04 / (1 << SKETCH) ** 0.5 * sites)
    spread = cut_lineage(spread.where(F.col("about") >= sites - margin))
    near = spread.where(F.col("about") <= sites + margin).select("line")
    if spread.count() <= BROADCAST_LINES // 4:
        near = F.broadcast(near)
    exact = seen.join(near, "line", "left_semi").distinct().groupBy("line").count().where(F.col("count") >= sites)
    return spread.where(F.col("about") > sites + margin).select("line").union(exact.select("line"))


def _cut(text: str, bad: np.ndarray) -> tuple[str, int]:
    """The text without lines whose hash is in ``bad`` (sorted, not empty), and how many those were."""
    lines = text.split("\n")
    hashes = np.array([xxhash.xxh64_intdigest(line.encode("utf-8", "surrogatepass"), 42) for line in lines], np.uint64)
    drop = bad[np.minimum(np.searchsorted(bad, hashes), len(bad) - 1)] == hashes
    if not drop.any() or not any(line and not d for line, d in zip(lines, drop, strict=True)):
        return text, 0
    return "\n".join(line for line, d in zip(lines, drop, strict=True) if not d), int(drop.sum())


def remove_lines(docs: DataFrame, bad: DataFrame, *, text_col: str = "text", removed_col: str | None = "_removed", broadcast_lines: int = BROADCAST_LINES) -> DataFrame:
    """The rows without lines whose hash is in ``bad`` (column line) and, as ``removed_col``, how many each has lost.

    Null texts stay null and lose nothing. A text of which every line but empty ones would go is left as it is.
    Other columns stay as they are; with ``removed_col`` None no column is added, and one of that name that the
    table has already gets underscores before the new one's name.
    """
    text_batches(docs.sparkSession)
    bad = cut_lineage(bad.select("line").distinct())
    count, added = bad.count(), free_name(docs, removed_col or "_removed")
    if not count:
        out = docs.withColumn(added, F.lit(0).cast("long"))
    elif count <= broadcast_lines:
        hashes = np.sort(bad.toArrow().column(0).to_numpy().view(np.uint64))
        known = docs.sparkSession.sparkContext.broadcast(hashes)
        place = docs.columns.index(text_col)
        schema = T.StructType([*docs.schema.fields, T.StructField(added, T.LongType())])

        def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                done = [_cut(t, known.value) if t else (t, 0) for t in batch.column(place).to_pylist()]
                columns = list(batch.columns)
                columns[place] = pa.array([t for t, _ in done], columns[place].type)
                yield pa.RecordBatch.from_arrays([*columns, pa.array([n for _, n in done], pa.int64())], names=schema.names)

        out = docs.mapInArrow(tidied(cut), schema)
    else:
        text = free_name(docs, "_of")
        parts = F.split(F.col(text_col), "\n", -1)
        key: list[Column] = [F.xxhash64(text_col).alias("of"), F.length(text_col).alias("size")]
        at = docs.select(*key, F.posexplode(F.transform(parts, lambda line: F.xxhash64(line))).alias("at", "line"))
        hits = at.join(bad, "line", "left_semi").groupBy("of", "size").agg(F.collect_set("at").alias("hits")).select(F.struct("of", "size", "hits").alias(text))
        joined = docs.join(hits, (F.xxhash64(text_col) == F.col(f"{text}.of")) & (F.length(text_col) == F.col(f"{text}.size")), "left")
        gone = F.col(f"{text}.hits")
        kept = F.filter(parts, lambda line, i: ~F.array_contains(gone, i))
        ok = gone.isNotNull() & F.exists(kept, lambda line: line != "")
        out = joined.select(
            *(F.when(ok, F.array_join(kept, "\n")).otherwise(F.col(c)).alias(c) if c == text_col else F.col(c) for c in docs.columns),
            F.when(ok, F.size(gone)).otherwise(0).cast("long").alias(added),
        )
    return out if removed_col else out.drop(added)


def strip_boilerplate(docs: DataFrame, *, text_col: str = "text", site_col: str = "source", sites: int = SITES, removed_col: str | None = "_removed") -> DataFrame:
    """The rows without cross-site boilerplate lines, with the number of lines removed as one column more."""
    return remove_lines(docs, boilerplate(docs, text_col=text_col, site_col=site_col, sites=sites), text_col=text_col, removed_col=removed_col)
