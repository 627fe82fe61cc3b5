"""Packing: documents to token sequences of a fixed window with little padding.

Method: best-fit decreasing. Overlong documents are first cut into full windows; what is left of
each document is placed, longest first, into the open window with the least room that still takes
it. A segment tree over remaining capacities finds that window in O(log window).

Packing is a narrow operation: every input partition is packed on its own, in chunks of a bounded
number of tokens, so nothing is shuffled, memory is bounded whatever the partition's size, and a
task that is run again gives the same windows. The price is a few windows per chunk that are not
full; those that the last short pieces leave open are cut at powers of two (see ``close_windows``).
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import text_batches, tidied

WINDOW = 2048
END_ID = 1
#: Tokens that a task holds at once.
CHUNK_TOKENS = 8_000_000

SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"

#: Characters on which every Unicode version and both tokenizer libraries agree: the fast encoder
#: takes texts of these only, all others go through the reference encoder.
_COMMON = re.compile("[^\\t\\n\\r\\x20-\\x7e\\xa1-\\xac\\xae-\\u017f\\u2010-\\u2027\\u20ac]")


class Encoder:
    """Token ids of a text by the vocabulary of a ``tokenizers`` file.

    With ``ranks`` (the same vocabulary as byte ranks) texts of common characters that hold no
    special token take a faster encoder that gives the same ids; ``tests/llm`` compares the two.
    """

    def __init__(self, path: str, ranks: str | None = None, pattern: str | None = None) -> None:
        from tokenizers import Tokenizer

        self.reference = Tokenizer.from_file(path)
        self.special = [t.content for t in self.reference.get_added_tokens_decoder().values()]
        self.fast = None
        if ranks:
            import base64

            import tiktoken

            with open(ranks, "rb") as lines:
                merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            self.fast = tiktoken.Encoding("palimpsest", pat_str=pattern, mergeable_ranks=merges, special_tokens={})

    def encode(self, text: str) -> np.ndarray:
        if self.fast is None or _COMMON.search(text) or any(s in text for s in self.special):
            return np.array(self.reference.encode(text, add_special_tokens=False).ids, np.uint32)
        return np.asarray(self.fast.encode_to_numpy(text, disallowed_special=()), np.uint32)


class CapacityTree:
    """Open windows by remaining capacity: a segment tree over 0..window that knows where any are."""

    def __init__(self, window: int) -> None:
        self.base = 1 << window.bit_length()
        self.any = bytearray(2 * self.base)
        self.open: list[list[int]] = [[] for _ in range(window + 1)]

    def put(self, capacity: int, window_id: int) -> None:
        self.open[capacity].append(window_id)
        at = capacity + self.base
        while at and not self.any[at]:
            self.any[at] = 1
            at >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """The tightest open window with room for ``need``, removed from the tree; None if there is none."""
        some, at = self.any, need + self.base
        if not some[at]:
            while at > 1 and (at & 1 or not some[at ^ 1]):
                at >>= 1
            if at <= 1:
                return None
            at ^= 1
            while at < self.base:
                at = 2 * at if some[2 * at] else 2 * at + 1
        capacity = at - self.base
        found = self.open[capacity].pop()
        if not self.open[capacity]:
            some[at] = 0
            at >>= 1
            while at and not (some[2 * at] or some[2 * at + 1]):
                some[at] = 0
                at >>= 1
        return capacity, found


def best_fit_decreasing(lengths: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Window and offset of each item (1..window long), and the number of windows."""
    where, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    tree, windows = CapacityTree(window), 0
    for item in np.argsort(-lengths, kind="stable").tolist():
        need = int(lengths[item])
        got = tree.take(need)
        capacity, w = got if got else (window, windows)
        windows += got is None
        where[item], offset[item] = w, window - capacity
        if capacity > need:
            tree.put(capacity - need, w)
    return where, offset, windows


def close_windows(pieces: list[tuple[int, int, int, int, int]], window: int, windows: int, most: int) -> list[tuple[int, int, int, int, int]]:
    """Cut windows that more than ``most`` tokens of padding would fill into runs of powers of two.

    pieces: (document, start, length, window, offset). A sequence whose length is a power of two needs
    no padding, so an open window of, say, 1,324 tokens becomes sequences of 1,024, 256 and 32 and 12 more.
    """
    fill: dict[int, int] = {}
    for _, _, length, w, _ in pieces:
        fill[w] = fill.get(w, 0) + length
    runs: dict[int, list[tuple[int, int, int]]] = {}
    for w, full in fill.items():
        if window - full > most and full & (full - 1):
            at, parts = 0, []
            while full - at:
                size = 1 << ((full - at).bit_length() - 1)
                parts.append((at, at + size, w if not parts else windows))
                windows += len(parts) > 1
                at += size
            runs[w] = parts
    if not runs:
        return pieces
    out = []
    for doc, start, length, w, offset in pieces:
        for lo, hi, new in runs.get(w, ((0, window, w),)):
            a, b = max(lo, offset), min(hi, offset + length)
            if a < b:
                out.append((doc, start + a - offset, b - a, new, a - lo))
    return out


def _pack_chunk(ids: list[int | None], tokens: list[np.ndarray], window: int, first: int, most: int) -> tuple[list[dict], int]:
    """Rows for a chunk of documents whose sequences are numbered from ``first``, and the next number."""
    pieces, rest, windows = [], [], 0
    for d, t in enumerate(tokens):
        full = len(t) // window * window
        for at in range(0, full, window):
            pieces.append((d, at, window, windows, 0))
            windows += 1
        if full < len(t):
            rest.append((d, full, len(t) - full))
    where, offset, n = best_fit_decreasing(np.array([r[2] for r in rest], np.int64), window)
    tail = [(d, at, length, windows + int(w), int(o)) for (d, at, length), w, o in zip(rest, where, offset, strict=True)]
    pieces += close_windows(tail, window, windows + n, most)
    rows, top = [], windows + n - 1
    for d, start, length, w, o in pieces:
        top = max(top, w)
        rows.append({"doc_id": ids[d], "start": start, "length": length, "ids": tokens[d][start : start + length].tobytes(), "doc_tokens": len(tokens[d]), "sequence_id": first + w, "offset": o})
    return rows, first + top + 1


def pack(
    docs: DataFrame, tokenizer: str, ranks: str | None = None, pattern: str | None = None, *, id_col: str = "doc_id", text_col: str = "text",
    window: int = WINDOW, end_id: int = END_ID, chunk_tokens: int = CHUNK_TOKENS, most_padding: int = WINDOW // 16,
) -> DataFrame:
    """Pieces of documents with their place in a sequence.

    tokenizer: path of a ``tokenizers`` file on every machine (see ``Encoder`` for ranks and pattern).
    Returns per piece doc_id, start, length, ids (little-endian unsigned 32-bit), doc_tokens,
    sequence_id, offset. A null or empty text is the end id alone; repeated rows are packed as often as
    they occur; a null id is kept as null; an empty table gives no rows; other columns are ignored.
    """

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder, end = Encoder(tokenizer, ranks, pattern), np.array([end_id], np.uint32)
        next_id = TaskContext.get().partitionId() << 40
        ids: list[int | None] = []
        tokens: list[np.ndarray] = []
        held = 0
        kind = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal next_id
            rows, next_id = _pack_chunk(ids, tokens, window, next_id, most_padding)
            for at in range(0, len(rows), 2000):
                yield pa.RecordBatch.from_pylist(rows[at : at + 2000], kind)

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                t = np.concatenate([encoder.encode(text), end]) if text else end
                ids.append(doc_id)
                tokens.append(t)
                held += len(t)
                if held >= chunk_tokens:
                    yield from flush()
                    ids, tokens, held = [], [], 0
        if ids:
            yield from flush()

    text_batches(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(tidied(packed), SCHEMA)
