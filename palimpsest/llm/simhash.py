"""Near-duplicate detection by SimHash and covering locality-sensitive hashing.

Fingerprints have 64 bits. Two of them are linked if they differ in at most ``radius`` bits. Every bit
gets a vector of radius + 1 bits; each non-zero vector v gives a mask of the bits whose vector has an
odd product with v. Any ``radius`` bits span too little to meet every v, so for each pair within the
radius some mask misses all bits in which they differ: they collide in that table for certain.

Copies collapse to one fingerprint before anything is dealt out, so buckets hold distinct fingerprints
only; a bucket emits a spanning forest of its links, never its pairs. Large buckets are dealt out again by
masks of another assignment, with the same guarantee.

Texts whose word shingles have a similarity of 0.8 differ in some ten bits of 64 and often in twenty, for which
masks would be a million tables. So ``keep_one`` has the masks find what lies within the radius and adds bands of
min-hashes for what lies beyond it; fingerprints say which texts are compared first, and the shingles themselves which
are linked.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import cut_lineage, release, text_batches, tidied

RADIUS = 4
SEED = 42
#: Buckets beyond this many fingerprints are split by further masks before pairs are compared.
BUCKET = 2048
#: Seeds of the assignments of vectors to bits, the first one and those that split what is crowded.
ASSIGNMENTS = (7, 21, 22, 23)
#: Rows of ids that may be broadcast when documents are filtered: some 50 MB.
BROADCAST_ROWS = 500_000


def shingle_hashes(text: str | None, words: int) -> list[int]:
    """XXH64 of each run of ``words`` words; fewer words make one run, none make none."""
    parts = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not parts:
        return []
    joined = b" ".join(parts)
    if len(parts) <= words:
        return [xxhash.xxh64_intdigest(joined, SEED)]
    gaps = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    starts = [0, *(gaps[: len(parts) - words] + 1).tolist()]
    ends = [*gaps[words - 1 :].tolist(), len(joined)]
    digest = xxhash.xxh64_intdigest
    return [digest(joined[a:b], SEED) for a, b in zip(starts, ends, strict=True)]


def _majority(hashes: list[int] | np.ndarray, sizes: list[int]) -> np.ndarray:
    """A fingerprint for each of the runs of hashes."""
    out = np.zeros(len(sizes), np.uint64)
    count = np.array(sizes)
    if not len(hashes):
        return out
    full = np.flatnonzero(count)
    starts = (np.cumsum(count) - count)[full]
    bits = np.unpackbits(np.asarray(hashes, np.uint64).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    ones = np.add.reduceat(bits, starts, axis=0, dtype=np.int32)
    set_ = (2 * ones > count[full, None]).astype(np.uint8)
    out[full] = np.packbits(set_, axis=1, bitorder="little").view(np.uint64).ravel()
    return out


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = 4) -> DataFrame:
    """doc_id and fingerprint (long) of each document; a text without words has fingerprint 0."""

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints, hashes, sizes = [], [], []
            for text in batch.column(1):
                h = shingle_hashes(text.as_py(), words)
                hashes += h
                sizes.append(len(h))
                if len(hashes) > 200_000:
                    prints.append(_majority(hashes, sizes))
                    hashes, sizes = [], []
            prints.append(_majority(hashes, sizes))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(prints).view(np.int64))], names=["doc_id", "fingerprint"])

    text_batches(docs.sparkSession)
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return source.mapInArrow(tidied(signed), "doc_id long, fingerprint long")


def covering_masks(radius: int = RADIUS, seed: int = 7, bits: range = range(64)) -> list[int]:
    """Masks of some bits such that any ``radius`` of them lie outside at least one mask."""
    rng, all_ = np.random.default_rng(seed), (1 << radius + 1) - 1
    vectors = 1 + np.concatenate([rng.permutation(all_) for _ in range(-(-len(bits) // all_))])[: len(bits)]
    return [sum(1 << bit for bit, own in zip(bits, vectors.tolist(), strict=True) if (own & v).bit_count() & 1) for v in range(1, 1 << radius + 1)]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _forest(group: np.ndarray, radius: int, depth: int = 0) -> tuple[list[int], list[int]]:
    """A spanning forest of the links within one bucket of distinct fingerprints."""
    a, b = [], []
    if len(group) > BUCKET and depth < 2:
        for mask in covering_masks(radius, seed=11 + depth):
            key = group & np.uint64(mask)
            order = np.argsort(key, kind="stable")
            cuts = np.flatnonzero(np.diff(key[order])) + 1
            for part in np.split(group[order], cuts):
                if len(part) > 1:
                    x, y = _forest(part, radius, depth + 1)
                    a += x
                    b += y
        return _spanning(a, b)
    for at in range(0, len(group), 512):
        near = np.bitwise_count(group[at : at + 512, None] ^ group[None, :]) <= radius
        i, j = np.nonzero(near)
        later = j > i + at
        x, y = _spanning(group[i[later] + at].tolist(), group[j[later]].tolist())
        a += x
        b += y
    return _spanning(a, b)


def _spanning(a: list[int], b: list[int]) -> tuple[list[int], list[int]]:
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = parent[up]
            x = parent[x]
        return x

    kept: tuple[list[int], list[int]] = ([], [])
    for x, y in zip(a, b, strict=True):
        if (p := root(x)) != (q := root(y)):
            parent[p] = q
            kept[0].append(x)
            kept[1].append(y)
    return kept


def links(prints: DataFrame, radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """Links (a, b) between distinct fingerprints that connect whatever is within the radius.

    Buckets beyond ``bucket`` fingerprints are dealt out again by masks of the next assignment. Each leaves half of
    the bits open, so that what still shares a bucket after the last one differs in a few bits only.
    """

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_key, held = np.zeros(0, np.int64), np.zeros(0, np.uint64)
        for batch in batches:
            key = np.concatenate([held_key, batch.column(0).to_numpy()])
            value = np.concatenate([held, batch.column(1).to_numpy().view(np.uint64)])
            if not len(key):
                continue
            last = int(np.searchsorted(key, key[-1]))
            held_key, held = key[last:], value[last:]
            yield from emit(key[:last], value[:last])
        yield from emit(held_key, held)

    def emit(key: np.ndarray, value: np.ndarray) -> Iterator[pa.RecordBatch]:
        if len(key) < 2:
            return
        starts = np.concatenate([[0], np.flatnonzero(np.diff(key)) + 1])
        sizes = np.diff(np.concatenate([starts, [len(key)]]))
        two = starts[sizes == 2]
        x, y = value[two], value[two + 1]
        near = np.bitwise_count(x ^ y) <= radius
        a, b = x[near].tolist(), y[near].tolist()
        for at, n in zip(starts[sizes > 2].tolist(), sizes[sizes > 2].tolist(), strict=True):
            p, q = _forest(value[at : at + n], radius)
            a += p
            b += q
        if a:
            yield pa.RecordBatch.from_arrays([pa.array(np.array(v, np.uint64).view(np.int64)) for v in (a, b)], names=["a", "b"])

    rows, found = prints.select("fingerprint", F.lit(0).cast("long").alias("of")), None
    for level, seed in enumerate(ASSIGNMENTS):
        keys = F.array(*(F.xxhash64(F.lit(t), "of", F.col("fingerprint").bitwiseAND(F.lit(_signed(m)))) for t, m in enumerate(covering_masks(radius, seed))))
        dealt = rows.select(F.explode(keys).alias("key"), "fingerprint")
        crowded, crowds = None, 0
        if level < len(ASSIGNMENTS) - 1:
            crowded = cut_lineage(dealt.groupBy("key").count().where(F.col("count") > bucket).select("key"))
            crowds = crowded.count()
            crowded = F.broadcast(crowded) if crowds <= BROADCAST_ROWS else crowded
        small = dealt.join(crowded, "key", "left_anti") if crowds else dealt
        edges = small.repartition("key").sortWithinPartitions("key").mapInArrow(tidied(linked), "a long, b long")
        found = edges if found is None else found.union(edges)
        if not crowds:
            break
        rows = cut_lineage(dealt.join(crowded, "key", "left_semi").select("fingerprint", F.col("key").alias("of")))
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def connected(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the links (a, b): root is the smallest node of its component.

    Large-star and small-star rounds: each joins every node to the smallest one in its neighbourhood,
    and a logarithmic number of rounds ends in stars. Minima are aggregated before they are joined back.
    """
    edges = cut_lineage(edges.select("a", "b").where("a <> b"))
    before = None
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("u"), F.col("m").alias("v")).where("u <> v")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("b"), F.col("m").alias("a")), F.struct(F.col("u").alias("b"), F.col("m").alias("a")))).alias("e"))
        edges = cut_lineage(small.select("e.a", "e.b").where("a <> b").distinct())
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).head()
        if now == before:
            break
        before = now
        release(edges.sparkSession)
    return edges.select(F.col("b").alias("node"), F.col("a").alias("root"))


def components(prints: DataFrame, radius: int = RADIUS) -> tuple[DataFrame, DataFrame]:
    """Of (doc_id, fingerprint) rows: the rows, computed once, and each fingerprint's component_id.

    component_id is the smallest doc_id of the component.
    """
    prints = cut_lineage(prints)
    each = cut_lineage(prints.groupBy("fingerprint").agg(F.min("doc_id").alias("first")))
    stars = connected(links(each.select("fingerprint"), radius))
    rooted = each.join(stars, each.fingerprint == stars.node, "left").select("fingerprint", "first", F.coalesce("root", "fingerprint").alias("root"))
    best = cut_lineage(rooted.groupBy("root").agg(F.min("first").alias("component_id")))  # a shuffle of its own, which can be split where a component is large
    return prints, rooted.join(best, "root").select("fingerprint", "component_id")


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = 4, radius: int = RADIUS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id of each row.

    Null and empty texts have fingerprint zero and link like any other; repeated rows come back as often
    as they occur; null ids never name a component unless it has no other; an empty table gives no rows.
    """
    prints, found = components(fingerprints(docs, id_col=id_col, text_col=text_col, words=words), radius)
    return prints.join(found, "fingerprint").select("doc_id", F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), "component_id")


# Documents whose word shingles are similar, beyond what lies within a small radius


#: Min-hashes of a band, and bands of a text. A pair of similarity 0.8 shares no band with a chance of
#: (1 - 0.8 ** 6) ** 40: 5 pairs in a million.
BAND, BANDS = 6, 40
#: Bits of the four fingerprints, of 256, in which candidates may differ, and where a text has fewer than FEW shingles.
#: Texts of similarity 0.8 differ in 39 on average, with a standard deviation of 6.
CANDIDATE_BITS, CANDIDATE_BITS_FEW, FEW = 68, 110, 8
#: Candidates that each text of a bucket gives in the first round after that of the forests; eight times as many in the next.
MOST_FIRST = 16
#: Parts of a crowd, of BUCKET texts or CROWD_SHINGLES shingles each, up to which all its texts are compared with all.
CROWD_PARTS, CROWD_SHINGLES = 8, 1_000_000
#: Candidate links that one task holds while it thins them out.
CANDIDATES = 500_000
#: Shingles that are measured at once.
SHINGLES = 200_000

_PRINTS = ("f0", "f1", "f2", "f3")
_TURNS = np.random.default_rng(SEED).integers(1 << 32, size=(2, BANDS, BAND), dtype=np.uint32) | np.array([0, 1], np.uint32)[:, None, None]


def band_keys(hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """BANDS keys of each of the sets of shingle hashes that begin at ``starts``; none of them is empty."""
    short, out = (hashes >> np.uint64(32)).astype(np.uint32), np.empty((len(starts), BANDS), np.uint64)
    for band in range(BANDS):
        key = np.full(len(starts), band + 1, np.uint64)
        for salt, turn in _TURNS[:, band].T:
            key = (key ^ np.minimum.reduceat((short ^ salt) * turn, starts)) * np.uint64(0x9E3779B97F4A7C15)
            key ^= key >> np.uint64(29)
        out[:, band] = key
    return out


def _four_prints(hashes: np.ndarray, sizes: list[int]) -> list[np.ndarray]:
    """Four fingerprints from one hash of each distinct shingle."""
    mixed = [(hashes * np.uint64(2 * k + 1) * np.uint64(0x9E3779B97F4A7C15)) ^ (hashes >> np.uint64(7 * k + 3)) if k else hashes for k in range(4)]
    return [_majority(h, sizes) for h in mixed]


def _measured(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    """(doc_id, text_hash, text) to those without the text, a hash of its words, the number of its distinct shingles, fingerprints and bands."""

    def row(ids: list[pa.Array], names: list[bytes], sets: list[np.ndarray]) -> pa.RecordBatch:
        sizes, hashes = [len(h) for h in sets], np.concatenate(sets)
        full = np.flatnonzero(sizes)
        keys = np.zeros((0, BANDS), np.uint64)
        if len(full):
            keys = band_keys(hashes, (np.cumsum(sizes) - sizes)[full])
        offsets = np.concatenate([[0], np.cumsum(np.where(np.array(sizes) > 0, BANDS, 0))]).astype(np.int32)
        listed = pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys.view(np.int64).ravel()))
        prints = [pa.array(f.view(np.int64)) for f in _four_prints(hashes, sizes)]
        return pa.RecordBatch.from_arrays([*ids, pa.array(names, pa.binary()), pa.array(sizes, pa.int32()), *prints, listed], names=["doc_id", "text_hash", "w", "n", *_PRINTS, "keys"])

    for batch in batches:
        names, sets, begun, held = [], [], 0, 0
        for at, text in enumerate(batch.column(2)):
            one = text.as_py()
            names.append(xxhash.xxh3_128_digest(b" ".join(one.encode("utf-8", "surrogatepass").lower().split()) if one else b""))
            sets.append(np.unique(np.array(shingle_hashes(one, words), np.uint64)))
            held += len(sets[-1])
            if held > SHINGLES or at + 1 == batch.num_rows:
                yield row([batch.column(i).slice(begun, len(sets)) for i in (0, 1)], names, sets)
                names, sets, begun, held = [], [], at + 1, 0


def _shingled(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    """(t, text) to t and the distinct shingles."""
    for batch in batches:
        for at in range(0, batch.num_rows, 500):
            some = batch.slice(at, 500)
            sets = [np.unique(np.array(shingle_hashes(text.as_py(), words), np.uint64)).view(np.int64) for text in some.column(1)]
            yield pa.RecordBatch.from_arrays([some.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["t", "shingles"])


def _bits(f: np.ndarray, g: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """In how many bits rows of fingerprints differ, of texts of n and m shingles; 1 << 15 for what is no candidate."""
    bits = np.bitwise_count(f ^ g).sum(axis=-1, dtype=np.int64)
    return np.where(bits <= np.where(np.minimum(n, m) < FEW, CANDIDATE_BITS_FEW, CANDIDATE_BITS), bits, 1 << 15)


def _nearest_first(f: np.ndarray, size: np.ndarray) -> list[tuple[int, int, int]]:
    """A minimum spanning forest of the candidates among rows of fingerprints: (row, row, bits), by Prim's algorithm."""
    n = len(f)
    best, parent, open_ = np.full(n, 1 << 16), np.zeros(n, np.int64), np.ones(n, bool)
    out, at = [], 0
    for _ in range(n):
        open_[at] = False
        bits = _bits(f, f[at], size, size[at])
        closer = open_ & (bits < best)
        best[closer], parent[closer] = bits[closer], at
        left = np.flatnonzero(open_)
        if not len(left):
            break
        at = int(left[best[left].argmin()])
        if best[at] < 1 << 15:
            out.append((int(parent[at]), at, int(best[at])))
    return out


def _thinned(a: list[int], b: list[int], w: list[int]) -> tuple[list[int], list[int], list[int]]:
    """The links that stay when of each circle the weakest goes."""
    order = sorted(range(len(a)), key=lambda i: (w[i], a[i], b[i]))
    x, y = _spanning([a[i] for i in order], [b[i] for i in order])
    weight = {(a[i], b[i]): w[i] for i in reversed(order)}
    return x, y, [weight[e] for e in zip(x, y, strict=True)]


def _links_of(rows: list[tuple[list[int], list[int], list[int]]]) -> Iterator[pa.RecordBatch]:
    a, b, w = _thinned(*(sum(c, []) for c in zip(*rows, strict=True))) if rows else ([], [], [])
    if a:
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(w, pa.int32())], names=["a", "b", "w"])


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, t, n, f0..f3), sorted by key, to candidate links (a, b, w): a thinned forest of all buckets of the task."""
    rows: list[tuple[list[int], list[int], list[int]]] = []
    held: list[np.ndarray] = [np.zeros(0, np.int64)] * 7
    size = 0

    def add(t: np.ndarray, i: np.ndarray, j: np.ndarray, w: np.ndarray) -> None:
        nonlocal size
        low, high = np.minimum(t[i], t[j]), np.maximum(t[i], t[j])
        rows.append((low.tolist(), high.tolist(), w.tolist()))
        size += len(low)

    def buckets(columns: list[np.ndarray]) -> None:
        key, t, n = columns[:3]
        if len(key) < 2:
            return
        f = np.stack(columns[3:], axis=1).view(np.uint64)
        starts = np.concatenate([[0], np.flatnonzero(np.diff(key)) + 1, [len(key)]])
        sizes = np.diff(starts)
        two = starts[:-1][sizes == 2]
        bits = _bits(f[two], f[two + 1], n[two], n[two + 1])
        near = bits < 1 << 15
        add(t, two[near], two[near] + 1, bits[near])
        for at, many in zip(starts[:-1][sizes > 2].tolist(), sizes[sizes > 2].tolist(), strict=True):
            found = _nearest_first(f[at : at + many], n[at : at + many])
            if found:
                i, j, w = np.array(found).T
                add(t[at : at + many], i, j, w)

    for batch in batches:
        columns = [np.concatenate([h, batch.column(i).to_numpy()]) for i, h in enumerate(held)]
        if not len(columns[0]):
            continue
        last = int(np.searchsorted(columns[0], columns[0][-1]))
        buckets([c[:last] for c in columns])
        held = [c[last:] for c in columns]
        if size > CANDIDATES:
            rows = [_thinned(*(sum(c, []) for c in zip(*rows, strict=True)))]
            size = len(rows[0][0])
            if size > CANDIDATES // 2:
                yield from _links_of(rows)
                rows, size = [], 0
    buckets(held)
    yield from _links_of(rows)


def _thin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield from _links_of([tuple(c.to_pylist() for c in batch.columns) for batch in batches])


def _crossing(batches: Iterator[pa.RecordBatch], most: int, similarity: float) -> Iterator[pa.RecordBatch]:
    """(key, part, asks, t, root, n, f0..f3), sorted by the first three, to candidates (a, b) of different roots; nulls where there are more.

    Each row that asks gives its ``most`` nearest ones among those of its bucket that do not. Sizes that rule the
    similarity out are left out.
    """
    here, held = None, [np.zeros(0, np.int64)] * 7

    def asked(rows: list[np.ndarray]) -> tuple[np.ndarray, bool]:
        f, own, found, more = np.stack(held[3:], axis=1).view(np.uint64), held[2], [], False
        for at in range(0, len(rows[0]), 256):
            t, root, n, *prints = (c[at : at + 256] for c in rows)
            bits = _bits(np.stack(prints, axis=1).view(np.uint64)[:, None], f[None], n[:, None], own[None])
            small, large = np.minimum(n[:, None], own[None]), np.maximum(n[:, None], own[None])
            ok = (bits < 1 << 15) & (root[:, None] != held[1][None]) & (small >= similarity * large - 1e-9)
            if ok.sum(axis=1).max(initial=0) > most:
                more = True
                place = np.where(ok, bits * len(own) + np.arange(len(own)), 1 << 60)
                ok &= place <= np.partition(place, most - 1, axis=1)[:, most - 1 : most]
            x, y = np.nonzero(ok)
            found.append(np.stack([np.minimum(t[x], held[0][y]), np.maximum(t[x], held[0][y])], axis=1))
        return np.unique(np.concatenate(found), axis=0), more

    for batch in batches:
        key, part, asks, *rows = (c.to_numpy() for c in batch.columns)
        edges = np.flatnonzero((np.diff(key) != 0) | (np.diff(part) != 0) | (np.diff(asks) != 0)) + 1
        for a, b in zip([0, *edges.tolist()], [*edges.tolist(), len(key)], strict=True):
            if a == b:
                continue
            if here != (key[a], part[a]):
                here, held = (key[a], part[a]), [c[:0] for c in rows]
            if not asks[a]:
                held = [np.concatenate([h, c[a:b]]) for h, c in zip(held, rows, strict=True)]
            elif len(held[0]):
                pairs, more = asked([c[a:b] for c in rows])
                if len(pairs):
                    yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])
                if more:
                    yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64())] * 2, names=["a", "b"])


def _within(batches: Iterator[pa.RecordBatch], similarity: float) -> Iterator[pa.RecordBatch]:
    """(crowd, part, asks, t, root, shingles), sorted by the first three, to links (a, b) of different roots.

    Each row that asks is compared with those of its part that do not, and gives one link to each root that it is similar
    to. Of any n - similarity * n + 1 of its n shingles a partner has one: its rarest ones say who is looked at.
    """
    here: tuple | None = None
    t, root, sets = [], [], []
    index: tuple[np.ndarray, ...] | None = None

    def postings(shingles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return np.searchsorted(index[0], shingles, "left"), np.searchsorted(index[0], shingles, "right")

    def owners(low: np.ndarray, high: np.ndarray) -> np.ndarray:
        long = high - low
        return index[1][np.repeat(low - np.cumsum(long) + long, long) + np.arange(long.sum())]

    def partners(own: int, shingles: np.ndarray) -> np.ndarray:
        n = len(shingles)
        low, high = postings(shingles)
        few = np.argsort(high - low, kind="stable")[: n - int(np.ceil(similarity * n - 1e-9)) + 1]
        seen = np.unique(owners(low[few], high[few]))
        fits = (index[3][seen] != own) & (np.minimum(index[4][seen], n) >= similarity * np.maximum(index[4][seen], n) - 1e-9)
        if not fits.any():
            return seen[:0]
        both = np.bincount(owners(low, high), minlength=len(index[2]))[seen]
        seen = seen[fits & (both >= similarity * (index[4][seen] + n - both) - 1e-9)]
        return seen[np.unique(index[3][seen], return_index=True)[1]]

    for batch in batches:
        crowd, part, asks, ids, roots = (batch.column(i).to_numpy() for i in range(5))
        lists = batch.column(5)
        offsets, values = lists.offsets.to_numpy(), lists.values.to_numpy().view(np.uint64)
        links: list[np.ndarray] = []
        for i in range(len(crowd)):
            own = values[offsets[i] : offsets[i + 1]]
            if here != (crowd[i], part[i]):
                here, t, root, sets, index = (crowd[i], part[i]), [], [], [], None
            if not asks[i]:
                t.append(ids[i])
                root.append(roots[i])
                sets.append(own.copy())
            elif t:
                if index is None:
                    sizes = np.array([len(x) for x in sets])
                    every = np.concatenate(sets)
                    order = np.argsort(every, kind="stable")
                    index = every[order], np.repeat(np.arange(len(sets)), sizes)[order], np.array(t), np.array(root), sizes
                found = index[2][partners(roots[i], own)]
                links.append(np.stack([np.minimum(found, ids[i]), np.maximum(found, ids[i])], axis=1))
        pairs = np.unique(np.concatenate(links), axis=0) if links else np.zeros((0, 2), np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])


def _asked(rows: DataFrame, by: str, *columns: str) -> DataFrame:
    """Rows (by, main, parts, t, root, ...) dealt over the parts of each group, with those outside its main root as asking in every part."""
    own = F.pmod(F.xxhash64("t", by), F.col("parts"))
    read = rows.select(by, own.alias("part"), F.lit(0).alias("asks"), "t", "root", *columns)
    asks = rows.where("root <> main").select(by, F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), F.lit(1).alias("asks"), "t", "root", *columns)
    return read.union(asks).repartition(by, "part").sortWithinPartitions(by, "part", "asks")


def _groups(rows: DataFrame, by: str, shingles: bool = False) -> DataFrame:
    """(by, main, parts) of rows (by, root, n): of each group with several roots the most frequent one, and over how many parts it is dealt."""
    counted = rows.groupBy(by, "root").agg(F.count("*").alias("count"), F.sum("n").alias("n"))
    counted = counted.groupBy(by).agg(F.sum("count").alias("size"), F.sum("n").alias("n"), F.count("*").alias("roots"), F.max_by("root", F.struct("count", "root")).alias("main"))
    parts = F.greatest(F.ceil(F.col("size") / BUCKET), F.ceil(F.col("n") / CROWD_SHINGLES) if shingles else F.lit(1)).cast("long")
    return cut_lineage(counted.where("roots > 1").select(by, "main", parts.alias("parts")))


def _pick(docs: DataFrame, rows: DataFrame, id_col: str, text_col: str, how: str) -> DataFrame:
    """Join documents to a few rows (_id, _hash, ...) by id and text; broadcast only up to BROADCAST_ROWS."""
    same = docs[id_col].cast("long").eqNullSafe(rows["_id"]) & (F.xxhash64(docs[text_col]) == rows["_hash"])
    return docs.join(F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows, same, how)


def _rarest(rows: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """(t, key): of each row (t, crowd) its shingles that are rarest in the crowd and not its own alone.

    Of n shingles a partner has similarity * n at least: so one of any other n - similarity * n + 1, and if these are the
    first ones by an order that both texts follow, it is among the partner's first ones as well.
    """
    each = rows.join(sets, "t").select("t", F.explode("shingles").alias("s"), F.size("shingles").alias("n"), "crowd").select("t", "n", F.xxhash64("crowd", "s").alias("key"))
    known = cut_lineage(each.groupBy("key").count().where("count > 1"))
    ordered = F.array_sort(F.collect_list(F.struct(F.coalesce("count", F.lit(1)).alias("count"), "key")))
    found = each.join(known, "key", "left").groupBy("t", "n").agg(ordered.alias("all")).select("t", F.explode(F.slice("all", 1, (F.col("n") - F.ceil(similarity * F.col("n") - 1e-9) + 1).cast("int"))).alias("one"))
    return cut_lineage(found.where("one.count > 1").select("t", F.col("one.key").alias("key")))


def _masked(texts: DataFrame) -> DataFrame:
    """Links (a, b) of texts (t, n, f0) that connect whatever has fingerprints f0 within the radius, by covering masks.

    A text without shingles has no partner but those without any, which are one text.
    """
    prints = texts.where("n > 0").groupBy(F.col("f0").alias("fingerprint")).agg(F.min("t").alias("t"), F.count("*").alias("count"))
    prints = cut_lineage(prints)
    same = texts.where("n > 0").join(prints.where("count > 1").select(F.col("fingerprint").alias("f0"), F.col("t").alias("a")), "f0").where("a < t").select("a", F.col("t").alias("b"))
    one, other = (prints.select(F.col("fingerprint").alias(c), F.col("t").alias("t" + c)) for c in "ab")
    near = links(prints.select("fingerprint")).join(one, "a").join(other, "b")
    return cut_lineage(near.select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b")).union(same))


def similar_links(docs: DataFrame, texts: DataFrame, *, id_col: str, text_col: str, words: int, similarity: float) -> DataFrame:
    """Links (a, b) of texts that connect whatever has a Jaccard similarity of ``similarity`` or more.

    texts: (t, winner, n, f0..f3, keys), a row for each different text. 1. Covering masks connect the texts whose
    fingerprints lie within the radius, none left out. 2. Beyond it, texts that share a band meet in a bucket, which gives
    a minimum spanning forest by the distance of the fingerprints. Buckets beyond BUCKET texts are dealt over parts.
    3. The links of both are checked by the exact similarity. What they join is a crowd.
    4. A crowd that is still in pieces is dealt over parts of BUCKET texts, and what lies outside its largest piece is
    compared with each part. 5. In crowds of more than CROWD_PARTS parts texts meet by each of their rarest shingles in
    the crowd: so many that two texts of the similarity share one. Candidates are checked, the nearest of each text first
    and more in each round, until every one is checked or joins nothing; places where more than BUCKET texts meet are
    dealt over parts as well.
    """
    masked = _masked(texts)
    size = F.col("n").cast("long").alias("n")
    banded = texts.select(F.explode("keys").alias("key"), "t", size, *_PRINTS)
    crowded = cut_lineage(banded.groupBy("key").count().where(F.col("count") > BUCKET).select("key", F.ceil(F.col("count") / BUCKET).alias("parts")))
    crowds = crowded.count()
    hubs = None
    if crowds:
        crowded = F.broadcast(crowded) if crowds <= BROADCAST_ROWS else crowded
        part = F.xxhash64("key", F.pmod(F.xxhash64("t", "key"), F.col("parts")))
        hot = banded.select("key", "t").join(crowded, "key").select("key", "t")
        hub = hot.groupBy("key").agg(F.min("t").alias("a"))
        hubs = hot.join(F.broadcast(hub) if crowds <= BROADCAST_ROWS else hub, "key").where("a < t").select("a", F.col("t").alias("b")).distinct()
        banded = banded.join(crowded, "key", "left").select(F.when(F.col("parts").isNull(), F.col("key")).otherwise(part).alias("key"), "t", "n", *_PRINTS)
    dealt = banded.repartition("key").sortWithinPartitions("key", "t")
    found = cut_lineage(dealt.mapInArrow(tidied(_compared), "a long, b long, w int").groupBy("a", "b").agg(F.min("w").alias("w")))
    parts = max(1, -(-found.count() // CANDIDATES))
    forest = found.repartition(parts, "a", "b").mapInArrow(tidied(_thin), "a long, b long, w int").select("a", "b")
    forest = cut_lineage(masked.union(forest).distinct())
    near = connected(forest if hubs is None else forest.union(hubs))
    crowd = near.select(F.col("node").alias("t"), F.col("root").alias("crowd"))
    crowd = crowd.union(crowd.select("crowd", "crowd").distinct())  # a root is no node of its own star
    crowd = cut_lineage(texts.join(crowd, "t").select("t", "crowd", size, F.col("winner.doc_id").alias("_id"), F.col("winner.text_hash").alias("_hash")))

    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    chosen = crowd.select("t", "_id", "_hash")
    sets = _pick(narrow, chosen, "doc_id", "text", "inner").select("t", "text").mapInArrow(tidied(lambda b: _shingled(b, words)), "t long, shingles array<long>")
    sets = cut_lineage(sets.dropDuplicates(["t"]))

    def similar(candidates: DataFrame) -> DataFrame:
        one, other = (sets.select(F.col("t").alias(c), F.col("shingles").alias("s" + c)) for c in "ab")
        both = F.size(F.array_intersect("sa", "sb"))
        joined = candidates.join(one, "a").join(other, "b")
        return cut_lineage(joined.where(both >= similarity * (F.size("sa") + F.size("sb") - both)).select("a", "b"))

    def apart(linked: DataFrame) -> DataFrame:
        """(t, crowd, n, root) of crowds of several roots."""
        each = crowd.join(connected(linked).withColumnRenamed("node", "t"), "t", "left").select("t", "crowd", "n", F.coalesce("root", "t").alias("root"))
        open_ = each.groupBy("crowd").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("crowd")
        return cut_lineage(each.join(open_, "crowd").select("t", "crowd", "n", "root"))

    def met(rows: DataFrame, groups: DataFrame, by: str) -> DataFrame:
        return rows.join(F.broadcast(groups) if groups.count() <= BROADCAST_ROWS else groups, by)

    linked = similar(forest)
    rows = apart(linked)
    groups = _groups(rows, "crowd", shingles=True)
    inner = _asked(met(rows, groups.where(F.col("parts") <= CROWD_PARTS), "crowd").join(sets, "t"), "crowd", "shingles")
    linked = cut_lineage(linked.union(inner.mapInArrow(tidied(lambda b: _within(b, similarity)), "a long, b long")).distinct())
    large = groups.where(F.col("parts") > CROWD_PARTS).select("crowd")
    if not large.limit(1).count():
        return linked
    checked, most, rare = forest, MOST_FIRST, None
    while True:
        rows = apart(linked).join(large, "crowd")
        if not rows.limit(1).count():
            return linked
        rare = _rarest(rows, sets, similarity) if rare is None else rare
        members = rows.select("t", "root", "n").join(rare, "t").join(texts.select("t", *_PRINTS), "t")
        dealt = _asked(met(members, _groups(members, "key"), "key"), "key", "n", *_PRINTS)
        found = cut_lineage(dealt.mapInArrow(tidied(lambda b, most=most: _crossing(b, most, similarity)), "a long, b long").distinct())
        new = cut_lineage(found.where("a is not null").join(checked, ["a", "b"], "left_anti"))
        more = found.where("a is null").limit(1).count()
        if new.limit(1).count():
            linked, checked = cut_lineage(linked.union(similar(new))), cut_lineage(checked.union(new))
        elif not more:
            return linked
        if more:
            most *= 8


def keep_one(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = 5, similarity: float = 0.8) -> DataFrame:
    """The documents, one of each group of near-duplicates: that with the smallest id (null ids first), in full.

    Near-duplicates share ``similarity`` of their runs of ``words`` words (distinct ones, A-Z lower-cased) or are
    connected by others that do. Fingerprints within the radius are found by covering masks, others by bands; the runs of
    words decide. Texts with the same words (by a hash of 128 bits) are one text; those without any,
    null or not, as well.
    """
    text_batches(docs.sparkSession)
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text"))
    prints = cut_lineage(source.mapInArrow(tidied(lambda b: _measured(b, words)), "doc_id long, text_hash long, w binary, n int, f0 long, f1 long, f2 long, f3 long, keys array<long>"))
    texts = prints.groupBy("w").agg(F.min(F.struct("doc_id", "text_hash")).alias("winner"), F.first(F.struct("n", *_PRINTS, "keys")).alias("m"))
    texts = cut_lineage(texts.select(F.monotonically_increasing_id().alias("t"), "w", "winner", "m.*"))
    stars = connected(similar_links(docs, texts, id_col=id_col, text_col=text_col, words=words, similarity=similarity))
    rooted = texts.join(stars, texts.t == stars.node, "left").select("w", "winner", F.coalesce("root", "t").alias("root"))
    best = cut_lineage(rooted.groupBy("root").agg(F.min("winner").alias("best")))
    rows = prints.select("doc_id", "text_hash", "w").join(rooted.join(best, "root").select("w", "best"), "w")
    wins: Column = F.struct("doc_id", "text_hash").eqNullSafe(F.col("best"))
    lost = cut_lineage(rows.where(~wins).select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).distinct())
    twice = rows.where(wins).groupBy("doc_id", "text_hash").count().where("count > 1").limit(1).count()
    kept = _pick(docs, lost, id_col, text_col, "left_anti")
    return kept.dropDuplicates([id_col, text_col]) if twice else kept
