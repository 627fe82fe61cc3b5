"""Benchmark decontamination by a generalised suffix automaton of normalised test items.

The automaton holds every run of words of every item. Documents stream through it word by word; it
tracks the longest run that ends at the current word and occurs in some item. Where that run reaches
the window, the last ``window`` words are a window of an item; items shorter than the window count
when they occur whole. Matched spans are removed, and documents of which more than a given share is
matched go altogether.

The scan is a narrow operation over the documents. The benchmark is split into automata of a bounded
number of words, each of which is broadcast; one worker holds several, some 350 bytes a word. A benchmark of
more than ``worker_words`` words is scanned for in several passes over the documents, written one after
another. A cut needs the matches of all automata on the same text, so it waits for the last pass; only
texts that were cut are scanned again. The result is the same for any number of automata and passes.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.llm.common import free_name, in_turn, text_batches, tidied

WINDOW = 10
#: Words of test items in one broadcast automaton: some 100 MB in a worker at most.
AUTOMATON_WORDS = 300_000
#: Words of test items in all automata that a worker holds at once: some 1 GB.
WORKER_WORDS = 3_000_000

#: Words are runs of digits, letters a-z (A-Z lower-cased) and non-ASCII characters. On UTF-8 bytes
#: this table maps letters to lower case and every other ASCII character to a space.
_NORMAL = bytes(b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))
_WORD = re.compile(rb"[^ ]+")


def words_of(text: str | None) -> list[bytes]:
    """The normalised words of a text; null has none."""
    return text.encode("utf-8", "surrogatepass").translate(_NORMAL).split() if text else []


class SuffixAutomaton:
    """All runs of words of a set of items, with the items in which each window occurs."""

    def __init__(self, items: list[tuple[int, list[bytes]]], window: int = WINDOW) -> None:
        self.window = window
        self.vocabulary: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        coded = [(item, [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words]) for item, words in items if words]
        for _, ids in coded:
            last = 0
            for w in ids:
                last = self._extend(last, w)
        #: Items by the state that stands for one of their windows; short items by theirs, with their length.
        self.items: dict[int, set[int]] = {}
        self.short: dict[int, set[tuple[int, int]]] = {}
        for item, ids in coded:
            state = 0
            for i, w in enumerate(ids):
                state = self.next[state][w]
                if i >= window - 1:
                    state = self._shortest(state)
                    self.items.setdefault(state, set()).add(item)
            if len(ids) < window:
                self.short.setdefault(state, set()).add((len(ids), item))
        #: The nearest state at or above each one (by suffix links) where a short item ends, or -1.
        self.ends = [-1] * len(self.link)
        for s in sorted(range(len(self.link)), key=self.length.__getitem__):
            self.ends[s] = s if s in self.short else self.ends[self.link[s]] if s else -1

    def _clone(self, of: int, length: int) -> int:
        self.next.append(dict(self.next[of]))
        self.link.append(self.link[of])
        self.length.append(length)
        return len(self.link) - 1

    def _redirect(self, state: int, w: int, old: int, new: int) -> None:
        while state != -1 and self.next[state].get(w) == old:
            self.next[state][w] = new
            state = self.link[state]

    def _extend(self, last: int, w: int) -> int:
        """Append a word after the run that ``last`` stands for; the state of the longer run."""
        known = self.next[last].get(w)
        if known is not None:
            if self.length[known] == self.length[last] + 1:
                return known
            clone = self._clone(known, self.length[last] + 1)
            self.link[known] = clone
            self._redirect(last, w, known, clone)
            return clone
        self.next.append({})
        self.link.append(0)
        self.length.append(self.length[last] + 1)
        state, p = len(self.link) - 1, last
        while p != -1 and w not in self.next[p]:
            self.next[p][w] = state
            p = self.link[p]
        if p != -1:
            q = self.next[p][w]
            if self.length[q] == self.length[p] + 1:
                self.link[state] = q
            else:
                clone = self._clone(q, self.length[p] + 1)
                self.link[state] = self.link[q] = clone
                self._redirect(p, w, q, clone)
        return state

    def _shortest(self, state: int) -> int:
        """The state of the last ``window`` words of a run that is at least that long."""
        while self.length[self.link[state]] >= self.window:
            state = self.link[state]
        return state

    def scan(self, words: list[bytes]) -> tuple[list[list[int]], set[int]]:
        """Matched word intervals (half-open, disjoint, ascending) and the items matched."""
        following, link, length, window, ends = self.next, self.link, self.length, self.window, self.ends
        anchors, any_short = self.items, bool(self.short)
        found: list[list[int]] = []
        items: set[int] = set()
        state = run = 0
        for i, w in enumerate(map(self.vocabulary.get, words)):
            if w is None:
                state = run = 0
                continue
            to = following[state].get(w)
            while to is None:  # every word of the vocabulary leaves the root, so this ends
                state = link[state]
                run = length[state]
                to = following[state].get(w)
            state = to
            run += 1
            if run >= window:
                if length[link[state]] >= window:
                    state = self._shortest(state)
                    run = min(run, length[state])
                items |= anchors[state]
                self._cover(found, i + 1 - window, i + 1)
            if any_short and (at := ends[state]) != -1:
                while at != -1:
                    for size, item in self.short[at]:
                        if size <= run:
                            items.add(item)
                            self._cover(found, i + 1 - size, i + 1)
                    at = ends[link[at]] if at else -1
        return found, items

    @staticmethod
    def _cover(found: list[list[int]], a: int, b: int) -> None:
        while found and found[-1][1] >= a:
            last = found.pop()
            a, b = min(a, last[0]), max(b, last[1])
        found.append([a, b])


def automata(items: DataFrame, *, id_col: str = "item_id", text_col: str = "text", window: int = WINDOW, most_words: int = AUTOMATON_WORDS) -> Iterator[SuffixAutomaton]:
    """The benchmark, read twice (once for its size), as automata of about ``most_words`` words each; items without id or words take no part."""
    rows = items.select(F.col(id_col).alias("item_id"), F.col(text_col).alias("text")).where("item_id is not null and text is not null").distinct()
    total = rows.agg(F.sum(F.length("text"))).head()[0] or 0
    shards = max(1, -(-total // (5 * most_words)))
    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("item_id", "text"), F.lit(shards))).sort("shard", "item_id", "text")
    own, at = [], 0
    for row in dealt.toLocalIterator():
        if row["shard"] != at and own:
            yield SuffixAutomaton(own, window)
            own = []
        at = row["shard"]
        own.append((row["item_id"], words_of(row["text"])))
    yield SuffixAutomaton(own, window)


def _union(spans: list[list[int]]) -> list[list[int]]:
    found: list[list[int]] = []
    for a, b in sorted(spans):
        SuffixAutomaton._cover(found, a, b)
    return found


def _scanned(known: list[SuffixAutomaton], words: list[bytes]) -> tuple[list[list[int]], set[int]]:
    """Matched word intervals (disjoint, ascending) and items of all automata."""
    each = [one.scan(words) for one in known]
    if len(each) == 1:
        return each[0]
    return _union([span for spans, _ in each for span in spans]), set().union(*(items for _, items in each))


def _groups(items: DataFrame, window: int, most_words: int, worker_words: int) -> list[list[Broadcast]]:
    """The automata, broadcast, in groups that a worker holds together."""
    shared = [items.sparkSession.sparkContext.broadcast(one) for one in automata(items, window=window, most_words=most_words)]
    size = max(1, worker_words // most_words)
    return [shared[i : i + size] for i in range(0, len(shared), size)]


def _matched(docs: DataFrame, place: int, groups: list[list[Broadcast]], *, keep_text: bool) -> tuple[DataFrame, str, str, str]:
    """The documents with three more columns, and their names: words, matched intervals of words, items, of all groups."""
    names = tuple(free_name(docs, name) for name in ("n_words", "hits", "item_ids"))
    kinds = ("long", "array<array<int>>", "array<long>")
    rows = docs.withColumns({names[0]: F.lit(0).cast(kinds[0]), **{n: F.array().cast(k) for n, k in zip(names[1:], kinds[1:], strict=True)}})
    arrow = [pa.int64(), pa.list_(pa.list_(pa.int32())), pa.list_(pa.int64())]
    kept_fields = [f for i, f in enumerate(docs.schema.fields) if keep_text or i != place]

    def by(group: list[Broadcast], last: bool) -> Callable[[DataFrame], DataFrame]:
        drop = last and not keep_text
        fields = [*(kept_fields if drop else docs.schema.fields), *T.StructType.fromDDL(", ".join(f"{n} {k}" for n, k in zip(names, kinds, strict=True))).fields]

        def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known = [one.value for one in group]
            for batch in batches:
                counts, hits, ids = [], [], []
                for text, spans, had in zip(*(batch.column(c).to_pylist() for c in (place, -2, -1)), strict=True):
                    words = words_of(text)
                    found, matched = _scanned(known, words)
                    counts.append(len(words))
                    hits.append(_union(spans + found) if spans else found)
                    ids.append(sorted(matched.union(had)))
                before = [c for i, c in enumerate(batch.columns[:-3]) if not (drop and i == place)]
                yield pa.RecordBatch.from_arrays([*before, *(pa.array(c, k) for c, k in zip((counts, hits, ids), arrow, strict=True))], names=[f.name for f in fields])

        return lambda df: df.mapInArrow(tidied(scanned), T.StructType(fields))

    steps = [by(group, group is groups[-1]) for group in groups]
    return steps[0](rows) if len(steps) == 1 else in_turn(rows, steps), *names


def _n_hit(hits: str) -> Column:
    return F.aggregate(hits, F.lit(0).cast("long"), lambda n, span: n + span[1] - span[0])


def find_contamination(
    docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, most_words: int = AUTOMATON_WORDS, worker_words: int = WORKER_WORDS
) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, hits (word intervals), item_ids (matched, distinct, ascending).

    A null or empty text has no words; repeated rows are reported as often as they occur; an empty
    benchmark matches nothing; other columns of either table are ignored.
    """
    text_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    found, words, hits, ids = _matched(rows, 1, _groups(items, window, most_words, worker_words), keep_text=False)
    return found.select("doc_id", words, _n_hit(hits).alias("n_hit"), hits, ids)


def _cut(raw: bytes, found: list[list[int]]) -> bytes:
    """The text without the words of the intervals, and what lies between them."""
    spans, kept, at = [m.span() for m in _WORD.finditer(raw.translate(_NORMAL))], [], 0
    for a, b in found:
        kept.append(raw[at : spans[a][0]])
        at = spans[b - 1][1]
    return b"".join([*kept, raw[at:]])


def clean_text(text: str, automata: list[SuffixAutomaton]) -> tuple[str, int, int]:
    """The text without spans that any automaton matches, its words, and how many of them were matched at first.

    What is left is scanned again until nothing matches, since a cut brings words together.
    """
    raw, first = text.encode("utf-8", "surrogatepass"), None
    while True:
        words = raw.translate(_NORMAL).split()
        found, _ = _scanned(automata, words)
        if first is None:
            first = (len(words), sum(b - a for a, b in found))
        if not found:
            return raw.decode("utf-8", "surrogatepass"), *first
        raw = _cut(raw, found)


def decontaminate(
    docs: DataFrame, items: DataFrame, *, text_col: str = "text", window: int = WINDOW, most_coverage: float = 0.5, most_words: int = AUTOMATON_WORDS, worker_words: int = WORKER_WORDS
) -> DataFrame:
    """The documents without matched spans; those matched over more than ``most_coverage`` of their words go.

    All columns are kept as they are but the text. Null and empty texts stay.
    """
    names, place = docs.columns, docs.columns.index(text_col)
    docs = docs.toDF(*(f"c{i}" for i in range(len(names))))  # names that clash can neither be written nor mapped
    text_batches(docs.sparkSession)
    groups = _groups(items, window, most_words, worker_words)
    if len(groups) > 1:
        return _decontaminated_in_passes(docs, place, groups, most_coverage).toDF(*names)
    shared = groups[0]

    def cleaned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = [one.value for one in shared]
        for batch in batches:
            texts, keep = [], []
            for text in batch.column(place).to_pylist():
                new, n, hit = clean_text(text, known) if text else (text, 0, 0)
                texts.append(new)
                keep.append(hit <= most_coverage * n)
            batch = batch.set_column(place, batch.schema.field(place), pa.array(texts, batch.schema.field(place).type))
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(tidied(cleaned), docs.schema).toDF(*names)


def _decontaminated_in_passes(docs: DataFrame, place: int, groups: list[list[Broadcast]], most_coverage: float) -> DataFrame:
    """As ``decontaminate``; each round scans for all groups, then cuts, and goes on with the texts that were cut."""
    schema, done, rest, first = docs.schema, [], docs, True

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [_cut(text.encode("utf-8", "surrogatepass"), found).decode("utf-8", "surrogatepass") for text, found in zip(batch.column(place).to_pylist(), batch.column(-2).to_pylist(), strict=True)]
            columns = list(batch.columns[:-3])
            columns[place] = pa.array(texts, columns[place].type)
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    while True:
        seen, words, hits, ids = _matched(rest, place, groups, keep_text=True)
        done.append(seen.where(F.size(hits) == 0).drop(words, hits, ids))
        struck = seen.where(F.size(hits) > 0)
        if first:
            struck, first = struck.where(_n_hit(hits) <= most_coverage * F.col(words)), False
        rest = struck.mapInArrow(tidied(cut), schema)
        if rest.isEmpty():
            return reduce(DataFrame.unionAll, done)
