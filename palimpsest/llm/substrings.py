"""Exact substring dedup: bytes that some 200-byte string covers which also starts elsewhere.

Suffix arrays decide which strings repeat. To build them in shards that need not know of each other, the
corpus is cut so that equal strings always meet in one shard: every string of ``length`` bytes is filed
under its anchor, the least of its 32-byte grams by hash (leftmost if tied). The anchor depends on the
string alone. Consecutive strings with one anchor make a segment, of less than 2 * length bytes.

1. All texts are scanned for segments: (anchor hash, segment hash, text, start). Anchors are counted with
   map-side partial sums; a string under an anchor that occurs once occurs once.
2. Equal segments are merged into one with a count. An anchor whose segments are all one and the same
   needs no array: there every string occurs as often as the segment.
3. The others' segments are fetched once each and dealt out by anchor. Each shard builds its suffix array
   by induced sorting, the permuted common prefixes, and from these the strings that occur twice or more.
4. The spans go back to every occurrence of the segments, and are cut out of the texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.llm.common import binary_of, cut_lineage, text_batches, tidied, written
from palimpsest.llm.suffixes import common_prefixes, suffix_array

LENGTH = 200
GRAM = 32
#: Bytes of segments in one suffix array, about 100 bytes of memory each; more only if one anchor has more.
SHARD = 2_000_000
#: Bytes of text that are scanned at once.
BLOCK = 2_000_000
#: Distinct segments of one anchor beyond which its strings are dealt out again, by a second anchor.
HOT = 5_000

_FACTOR = 0x9E3779B97F4A7C15
_WRAP = (1 << 64) - 1


def gram_hashes(raw: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of the GRAM bytes from each position on; positions too near the end have none."""
    h, width, factor = raw.astype(np.uint64) + np.uint64(1 + seed), 1, _FACTOR
    while width < GRAM:
        h = h[:-width] * np.uint64(factor) + h[width:]
        factor, width = factor * factor & _WRAP, 2 * width
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def anchored_runs(raw: np.ndarray, at: np.ndarray, length: int = LENGTH, seed: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Segments of the texts that begin at ``at[:-1]``: first string, last string, anchor hash of each.

    Strings (by their first byte) never reach over the end of a text.
    """
    n, span = len(raw), length - GRAM + 1
    if n < length:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    hashes = gram_hashes(raw, seed)
    low = np.uint64((1 << 24) - 1)
    packed = (hashes & ~low) | np.arange(len(hashes), dtype=np.uint64)  # BLOCK keeps positions under 2**24
    blocks = -(-len(packed) // span)
    padded = np.full(blocks * span, np.iinfo(np.uint64).max)
    padded[: len(packed)] = packed
    grid = padded.reshape(blocks, span)
    head = np.minimum.accumulate(grid, axis=1).ravel()
    tail = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    count = n - length + 1
    anchor = (np.minimum(tail[:count], head[span - 1 : span - 1 + count]) & low).astype(np.int64)
    ends = np.repeat(at[1:], np.diff(at))[:count]
    inside = np.arange(count) + length <= ends
    new = inside.copy()
    new[1:] &= (anchor[1:] != anchor[:-1]) | ~inside[:-1]
    stop = inside.copy()
    stop[:-1] &= (anchor[1:] != anchor[:-1]) | ~inside[1:]
    first, last = np.flatnonzero(new), np.flatnonzero(stop)
    return first, last, hashes[anchor[first]]


def _blocks(at: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
    """(first text, last text + 1, first byte, last byte + 1) of pieces of BLOCK bytes or so; long texts are
    cut into pieces that overlap by LENGTH - 1 bytes."""
    i, n = 0, len(at) - 1
    while i < n:
        j = i + 1
        while j < n and at[j + 1] - at[i] <= BLOCK:
            j += 1
        yield i, j, int(at[i]), int(at[j])
        i = j


def _segments(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """(h, n, text) to (key, seg, h, n, begs, size): a row for each segment of a text, with all places it begins at."""
    for batch in batches:
        h, n = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        at, raw = binary_of(batch.column(2))
        for i, j, lo, hi in _blocks(at):
            pieces = [(lo, hi)] if hi - lo <= 4 * BLOCK else [(a, min(hi, a + BLOCK + length - 1)) for a in range(lo, hi, BLOCK)]
            for a, b in pieces:
                inner = np.unique(np.clip(at[i : j + 1], a, b)) - a
                first, last, key = anchored_runs(raw[a:b], inner, length)
                if not len(first):
                    continue
                block = raw[a:b].tobytes()
                seg = np.fromiter((xxhash.xxh64_intdigest(block[x:y]) for x, y in zip(first.tolist(), (last + length).tolist(), strict=True)), np.uint64, len(first))
                text = np.searchsorted(at, first + a, side="right") - 1
                order = np.lexsort((first, seg, key, text))
                text, key, seg, first, size = text[order], key[order], seg[order], first[order], (last - first + length)[order]
                new = np.flatnonzero(np.concatenate([[True], (text[1:] != text[:-1]) | (key[1:] != key[:-1]) | (seg[1:] != seg[:-1])]))
                begs = pa.ListArray.from_arrays(pa.array(np.concatenate([new, [len(first)]]).astype(np.int32)), pa.array((first + a - at[text]).astype(np.int32)))
                text, key, seg, size = text[new], key[new], seg[new], size[new]
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(seg.view(np.int64)), pa.array(h[text]), pa.array(n[text]), begs, pa.array(size.astype(np.int32))], names=["key", "seg", "h", "n", "begs", "size"])


def repeated_in(segments: list[bytes], counts: list[int], length: int = LENGTH) -> list[list[tuple[int, int]]]:
    """Of each segment the spans (half-open) of strings that occur twice or more among all of them.

    counts: how often each segment itself occurs.
    """
    text = np.concatenate([np.frombuffer(b"".join(s + b"\0" for s in segments), np.uint8).astype(np.int64) + 2, [0]])
    size = np.array([len(s) for s in segments])
    ends = np.cumsum(size + 1) - 1
    text[ends] = 1
    limit = np.repeat(ends, size + 1) - np.arange(len(text) - 1)
    limit = np.concatenate([limit, [0]])
    array = suffix_array(text)
    shared = common_prefixes(text, array, limit)
    twice = shared >= length
    with_next = np.zeros(len(text), bool)
    with_next[array[:-1]] = twice[array[1:]]
    starts = (twice | with_next | np.repeat(np.concatenate([np.array(counts) > 1, [False]]), np.concatenate([size + 1, [1]]))) & (limit >= length)
    where = np.flatnonzero(starts)
    out: list[list[tuple[int, int]]] = [[] for _ in segments]
    if len(where):
        cuts = np.flatnonzero(np.diff(where) > 1)
        for a, b in zip(where[np.concatenate([[0], cuts + 1])].tolist(), where[np.concatenate([cuts, [len(where) - 1]])].tolist(), strict=True):
            s = int(np.searchsorted(ends, a))
            begins = int(ends[s] - size[s])
            out[s].append((a - begins, b - begins + length))
    return out


def worth_comparing(segments: list[tuple[bytes, int]], length: int = LENGTH) -> list[tuple[int, int] | None]:
    """Of each segment of one anchor the part that may hold a string that another one holds; None if there is none.

    A string that two segments share covers the anchor and (length - GRAM) / 2 bytes on one side of it at
    least, so one of these two neighbourhoods is the same, and the string lies on that side. A segment that
    occurs twice is kept whole. The anchor is the least gram of its segment.
    """
    side = (length - GRAM) // 2
    seen: dict[tuple[bool, bytes], int] = {}
    around = []
    grams = gram_hashes(np.frombuffer(b"".join(s for s, _ in segments), np.uint8)) & ~np.uint64((1 << 24) - 1)
    at = 0
    for data, _ in segments:
        first, last = len(data) - length, length - GRAM  # the anchor lies in the first and in the last string
        place = first + int(grams[at + first : at + last + 1].argmin())
        at += len(data)
        left = (False, data[place - side : place + GRAM]) if place >= side else None
        right = (True, data[place : place + GRAM + side]) if place + GRAM + side <= len(data) else None
        around.append((place, left, right))
        for b in (left, right):
            if b:
                seen[b] = seen.get(b, 0) + 1
    out: list[tuple[int, int] | None] = []
    for (data, times), (place, left, right) in zip(segments, around, strict=True):
        on_left, on_right = bool(left) and seen[left] > 1, bool(right) and seen[right] > 1
        if times > 1 or (on_left and on_right):
            out.append((0, len(data)))
        elif on_left:
            out.append((0, place - side + length))
        else:
            out.append((max(0, place - side), len(data)) if on_right else None)
    return out


_FOUND = "key long, seg long, spans array<struct<beg:int,end:int>>"


def _shards(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """(route, key, seg, shift, times, bytes), sorted by route, to the spans found in each segment."""
    held: dict[tuple[int, int, int], tuple[bytes, int]] = {}
    route, weight = None, 0

    def emit() -> Iterator[pa.RecordBatch]:
        names = list(held)
        found = repeated_in([held[k][0] for k in names], [held[k][1] for k in names], length)
        rows = [(key, seg, [{"beg": shift + a, "end": shift + b} for a, b in spans]) for (key, seg, shift), spans in zip(names, found, strict=True) if spans]
        if rows:
            kind = pa.list_(pa.struct([("beg", pa.int32()), ("end", pa.int32())]))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], kind)], names=["key", "seg", "spans"])

    group: dict[tuple[int, int, int], tuple[bytes, int]] = {}

    def settle() -> None:
        nonlocal weight
        plain = all(shift == 0 and len(data) < 2 * length for (_, _, shift), (data, _) in group.items())
        keep = worth_comparing(list(group.values()), length) if plain else [(0, len(data)) for data, _ in group.values()]
        for ((key, seg, shift), (data, times)), part in zip(group.items(), keep, strict=True):
            if part:
                held[key, seg, shift + part[0]] = (data[part[0] : part[1]], times)
                weight += part[1] - part[0]

    for batch in batches:
        for r, key, seg, shift, times, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if r != route:
                settle()
                group = {}
                if weight >= SHARD:
                    yield from emit()
                    held, weight = {}, 0
            route = r
            group.setdefault((key, seg, shift), (data, times))
    settle()
    if held:
        yield from emit()


def _fetched(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """(text, wanted, h, n, doc_id) to the wanted segments' bytes; those of hot anchors are filed under a second one.

    Copies of a text follow one another after the join, and one of them is enough.
    """
    sent = None
    for batch in batches:
        out: list[tuple] = []
        for text, wanted, *same in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            if same == sent:
                continue
            sent = same
            raw = text.encode("utf-8", "surrogatepass")
            for w in wanted:
                data = raw[w["beg"] : w["beg"] + w["size"]]
                if not w["hot"]:
                    out.append((w["key"], w["key"], w["seg"], 0, w["times"], data))
                    continue
                first, last, key = anchored_runs(np.frombuffer(data, np.uint8), np.array([0, len(data)]), length, seed=17)
                for a, b, k in zip(first.tolist(), last.tolist(), key.view(np.int64).tolist(), strict=True):
                    out.append((k ^ w["key"], w["key"], w["seg"], a, w["times"], data[a : b + length]))
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary()]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=["route", "key", "seg", "shift", "times", "bytes"])


def repeated_spans(rows: DataFrame, *, length: int = LENGTH, hot: int = HOT) -> DataFrame:
    """Of rows (doc_id, text, h, n): (h, n, spans), the repeated spans of each text that has any, not yet merged.

    Texts are dealt out by hash and size here just as ``remove_repeats`` does it, all columns included, so
    that one exchange serves both.
    """
    texts = rows.select("h", "n", "text").where(F.col("n") >= length)
    found = written(texts.mapInArrow(tidied(lambda b: _segments(b, length)), "key long, seg long, h long, n int, begs array<int>, size int"))  # read twice
    anchors = found.groupBy("key").agg(F.sum(F.size("begs")).alias("c"), F.min("seg").alias("a"), F.max("seg").alias("b")).where("c > 1").select("key", (F.col("a") != F.col("b")).alias("differ"))
    dup = cut_lineage(found.join(anchors, "key").groupBy("key", "seg", "h", "n", "begs", "size", "differ").agg(F.sum(F.size("begs")).alias("times")))

    each = dup.where("differ").groupBy("key", "seg").agg(F.sum("times").alias("times"), F.min(F.struct("h", "n", F.get("begs", F.lit(0)).alias("beg"), "size")).alias("at"))
    crowded = each.groupBy("key").count().where(F.col("count") > hot).select("key", F.lit(True).alias("hot"))
    each = each.join(crowded, "key", "left").select("at.h", "at.n", F.struct("key", "seg", "at.beg", "at.size", "times", F.coalesce("hot", F.lit(False)).alias("hot")).alias("w"))
    wanted = each.groupBy("h", "n").agg(F.collect_list("w").alias("wanted"))
    fetched = rows.join(wanted, ["h", "n"]).select("text", "wanted", "h", "n", "doc_id").mapInArrow(tidied(lambda b: _fetched(b, length)), "route long, key long, seg long, shift int, times long, bytes binary")
    dealt = fetched.repartition("route").sortWithinPartitions("route")
    decided = dealt.mapInArrow(tidied(lambda b: _shards(b, length)), _FOUND).groupBy("key", "seg").agg(F.flatten(F.collect_list("spans")).alias("spans"))

    shifted = F.flatten(F.transform("begs", lambda beg: F.transform("spans", lambda s: F.struct((s["beg"] + beg).alias("beg"), (s["end"] + beg).alias("end")))))
    some = dup.where("differ").join(decided, ["key", "seg"]).select("h", "n", shifted.alias("spans"))
    whole = dup.where("not differ").select("h", "n", F.transform("begs", lambda beg: F.struct(beg.alias("beg"), (beg + F.col("size")).alias("end"))).alias("spans"))
    return some.union(whole).groupBy("h", "n").agg(F.flatten(F.collect_list("spans")).alias("spans"))


def merged(spans: list[dict]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted((s["beg"], s["end"]) for s in spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def remove_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, hot: int = HOT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and the bytes that are left (kept) of each row.

    A text is its UTF-8 bytes, a null one empty; kept may end within a character. Matches never cross
    texts. Rows with equal texts are repeats of each other. Texts shorter than ``length`` lose nothing.
    """
    text_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("h"), F.coalesce(F.octet_length(text_col), F.lit(0)).alias("n"))
    spans = repeated_spans(rows, length=length, hot=hot)
    joined = rows.join(spans, ["h", "n"], "left").select("doc_id", "text", "spans")
    schema = T.StructType([joined.schema["doc_id"], *T.StructType.fromDDL("n_bytes long, n_removed long, n_spans long, kept binary").fields])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, found in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                raw = text.encode("utf-8", "surrogatepass") if text else b""
                gone = merged(found or [])
                at, kept = 0, []
                for a, b in gone:
                    kept.append(raw[at:a])
                    at = b
                rows.append((len(raw), sum(b - a for a, b in gone), len(gone), b"".join([*kept, raw[at:]])))
            columns = list(zip(*rows, strict=True)) if rows else [[], [], [], []]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in columns[:3]), pa.array(columns[3], pa.binary())], names=schema.names)

    return joined.mapInArrow(tidied(cut), schema)
