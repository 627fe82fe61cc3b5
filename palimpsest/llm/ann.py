"""Approximate nearest neighbours by balanced posting lists.

Centroids come from a bounded sample by k-means that splits crowded clusters. They stay in memory on
every executor, linked to their nearest centroids in a graph; a best-first walk over that graph finds the
lists near a vector. Every vector is filed under several lists: the nearest one and, as it lies on a
boundary with them, up to ``replicas`` - 1 others within a distance ratio. A query reads the lists whose
centroids are within a ratio of its nearest one.

Nearness is the largest inner product; for distances each vector gets one coordinate more, which makes
all of them as long as the longest (queries get zero there), so that order by distance is order by
inner product. Scores are exact, of the original vectors in double precision.

Lists beyond ``list_cap`` rows are dealt over several parts, each of which every query of the list reads:
no list, and no crowd of equal vectors, ends in one task.

A query whose lists hold too few candidates asks again: first the nearest lists that together hold enough rows,
then, if their rows were of too few ids, all lists. So a query gets fewer than it wants only if there are fewer.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.llm.common import cut_lineage, fraction_of, tidied

#: Vectors that the centroids are fitted on, at most about; drawn by a hash.
SAMPLE = 20_000
LIST_SIZE = 200
LIST_CAP = 4_000
MOST_LISTS = 2_048
REPLICAS = 4
FILE_RATIO = 1.3
SEARCH_RATIO = 1.12
#: A query that asks again reads its nearest lists until they hold as many rows as so many lists of usual size.
WIDER = 10
NEIGHBOURS = 20


def usable(column: str) -> Column:
    """Whether a vector is not null or zero and has no null or non-finite component."""
    v = F.col(column)
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(fine & F.exists(v, lambda x: x != 0), F.lit(False))


@dataclass
class Centroids:
    """Centroids (in the lengthened space) and the graph that a search walks."""

    points: np.ndarray
    graph: np.ndarray
    entry: np.ndarray
    longest: float
    usual: float = 0.0

    def lengthened(self, x: np.ndarray, query: bool) -> np.ndarray:
        rest = np.zeros(len(x)) if query else np.sqrt(np.maximum(self.longest**2 - np.einsum("ij,ij->i", x, x), 0))
        return np.concatenate([x, rest[:, None]], axis=1)

    def near(self, x: np.ndarray, ratio: float, most: int | None = None) -> list[np.ndarray]:
        """Of each row the centroids within ``ratio`` of its nearest one, nearest first (at most ``most``).

        In a crowd the nearest centroid is next to nothing away, and a ratio of that would leave out whatever
        lies around the crowd: no less than the usual distance of a vector to its centroid counts. A walk from
        the entry points expands, wave by wave, all centroids in view within the ratio of the nearest one seen
        and, where only ``most`` are wanted, among the four times as many nearest; it ends where none is left.
        """
        out: list[np.ndarray] = []
        beam, k = 4 * (most or 0), len(self.points)
        squares = np.einsum("ij,ij->i", self.points, self.points)
        for at in range(0, len(x), 256):
            block = x[at : at + 256]
            n = len(block)
            distance, unexpanded = np.full((n, k), np.inf), np.zeros((n, k), bool)
            own = np.einsum("ij,ij->i", block, block)
            live, rows, nodes = np.arange(n), np.repeat(np.arange(n), len(self.entry)), np.tile(self.entry, n)
            while len(live):
                reached = np.zeros((n, k), bool)
                reached[rows, nodes] = True
                rows, nodes = np.divmod(np.flatnonzero(reached & np.isinf(distance)), k)
                d = own[rows] + squares[nodes] - 2 * np.einsum("ij,ij->i", block[rows], self.points[nodes])
                distance[rows, nodes] = np.sqrt(np.maximum(d, 0))
                unexpanded[rows, nodes] = True
                seen = distance[live]
                bound = np.maximum(seen.min(axis=1), self.usual) * ratio + 1e-12
                if most and beam < k:
                    bound = np.minimum(bound, np.partition(seen, beam - 1, axis=1)[:, beam - 1])
                rows, nodes = np.nonzero(unexpanded[live] & (seen <= bound[:, None]))
                rows = live[rows]
                unexpanded[rows, nodes] = False
                live = np.unique(rows)  # a row without a centroid to expand is done
                rows, nodes = np.repeat(rows, self.graph.shape[1]), self.graph[nodes].ravel()
            order = np.argsort(distance, axis=1, kind="stable")
            count = (distance <= np.maximum(distance.min(axis=1, keepdims=True), self.usual) * ratio + 1e-12).sum(axis=1)
            out += [order[i, : min(int(count[i]), most or k)] for i in range(n)]
        return out

    def file_under(self, x: np.ndarray, replicas: int, ratio: float) -> list[np.ndarray]:
        return self.near(x, ratio, replicas)


def fit_centroids(x: np.ndarray, lists: int, longest: float, seed: int = 0, rounds: int = 10) -> Centroids:
    """Balanced k-means: in each round the emptiest clusters move into the fullest ones."""
    rng = np.random.default_rng(seed)
    shell = Centroids(np.zeros((0, 0)), np.zeros((0, 0), int), np.zeros(0, int), longest)
    x = shell.lengthened(x, query=False)
    lists = max(1, min(lists, len(np.unique(x, axis=0))))
    points = x[rng.choice(len(x), lists, replace=False)]
    for step in range(rounds):
        owner = np.concatenate([np.argmax(b @ points.T - 0.5 * np.einsum("ij,ij->i", points, points), axis=1) for b in np.array_split(x, max(1, len(x) // 2000))])
        size = np.bincount(owner, minlength=lists)
        points = np.stack([np.bincount(owner, x[:, j], lists) for j in range(x.shape[1])], axis=1) / np.maximum(size, 1)[:, None]
        if step < rounds - 2:
            fair = len(x) / lists
            for empty, full in zip(np.flatnonzero(size < 0.25 * fair), np.argsort(-size), strict=False):
                members = x[owner == full]
                if size[full] > 2 * fair and len(members) > 1:
                    points[empty] = members[rng.integers(len(members))]
    points = points[size > 0]
    near = np.concatenate([np.sqrt(np.maximum(np.einsum("ij,ij->i", b, b) - 2 * np.max(b @ points.T - 0.5 * np.einsum("ij,ij->i", points, points), axis=1), 0)) for b in np.array_split(x, max(1, len(x) // 2000))])
    usual = float(np.median(near))
    kept: list[int] = []  # of centroids in one crowd a single one stays, else a vector's replicas would all go there
    for i in range(len(points)):
        if not kept or np.min(np.linalg.norm(points[kept] - points[i], axis=1)) > 0.3 * usual:
            kept.append(i)
    points = points[kept]
    degree = min(len(points), 24)
    square = np.einsum("ij,ij->i", points, points)
    graph = np.empty((len(points), degree), np.int64)
    for at in range(0, len(points), 512):
        d = square[None, :] - 2 * points[at : at + 512] @ points.T
        graph[at : at + 512] = np.argsort(d, axis=1)[:, :degree]
    if len(points) > degree:  # far links keep the graph in one piece
        graph[:, -2] = (np.arange(len(points)) + 1) % len(points)
        graph[:, -1] = rng.permutation(len(points))
    entry = rng.choice(len(points), min(len(points), 16), replace=False)
    return Centroids(points, graph, entry, longest, usual)


def _inner(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Inner products row by row, summed from the first component to the last: equal vectors score alike wherever they lie."""
    out = np.empty(len(x))
    for at in range(0, len(x), 8192):
        out[at : at + 8192] = np.ascontiguousarray((x[at : at + 8192] * y[at : at + 8192]).T).sum(axis=0)
    return out


def _matrix(column: pa.Array) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(len(column), -1).astype(np.float64)


def compared(batches: Iterator[pa.RecordBatch], stored: np.dtype, dimension: int, neighbours: int, longest: float) -> Iterator[pa.RecordBatch]:
    """Of rows (list, part, asks, id, vector), sorted by the first three, the nearest found of each asker: query_id, vec_id, score."""
    best: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    held = 0
    at, ids, points = None, [], []
    posted: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None

    def shrunk() -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        q, v, s = (np.concatenate(c) for c in zip(*best, strict=True))
        order = np.lexsort((v, -s, q))
        q, v, s = q[order], v[order], s[order]
        same = np.concatenate([[False], (q[1:] == q[:-1]) & (v[1:] == v[:-1])])
        q, v, s = q[~same], v[~same], s[~same]
        first = np.concatenate([[0], np.flatnonzero(np.diff(q)) + 1])
        place = np.arange(len(q)) - np.repeat(first, np.diff(np.concatenate([first, [len(q)]])))
        keep = place < neighbours
        return [(q[keep], v[keep], s[keep])]

    def flush() -> Iterator[pa.RecordBatch]:
        for q, v, s in shrunk() if best else []:
            yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(v), pa.array(s)], names=["query_id", "vec_id", "score"])

    for batch in batches:
        lists, pieces, asks = (batch.column(i).to_numpy() for i in range(3))
        every, raw = batch.column(3).to_numpy(), batch.column(4).to_pylist()
        edges = np.flatnonzero((np.diff(lists) != 0) | (np.diff(pieces) != 0) | (np.diff(asks) != 0)) + 1
        for a, b in zip([0, *edges.tolist()], [*edges.tolist(), len(lists)], strict=True):
            if a == b:
                continue
            x = np.frombuffer(b"".join(raw[a:b]), stored).reshape(b - a, dimension).astype(np.float64)
            if at != (lists[a], pieces[a]):
                at, ids, points, posted = (lists[a], pieces[a]), [], [], None
            if not asks[a]:
                ids.append(every[a:b])
                points.append(x)
                continue
            if not ids:
                continue
            if posted is None:  # rows of one id lie together
                own = np.concatenate(ids)
                order = np.argsort(own, kind="stable")
                names, first = np.unique(own[order], return_index=True)
                posted = names, np.concatenate(points)[order], first
            for lo in range(0, b - a, 256):
                who = every[a + lo : min(b, a + lo + 256)]
                score = x[lo : lo + 256] @ posted[1].T
                if len(posted[0]) < score.shape[1]:
                    score = np.maximum.reduceat(score, posted[2], axis=1)
                score[who[:, None] == posted[0][None, :]] = -np.inf
                k = min(neighbours + 8, score.shape[1])
                top = np.argpartition(-score, k - 1, axis=1)[:, :k] if k < score.shape[1] else np.broadcast_to(np.arange(k), score.shape)
                asker = x[lo : lo + 256]
                slack = 4 * dimension * np.finfo(float).eps * longest * np.linalg.norm(asker, axis=1)  # matrix products round by block
                cutoff = np.take_along_axis(score, top, 1).min(axis=1) - slack
                row, col = np.nonzero((score >= cutoff[:, None]) & (score > -np.inf))  # ties with the last one too
                begin, end = posted[2][col], np.append(posted[2][1:], len(posted[1]))[col]
                exact = np.full(len(row), -np.inf)
                for step in range(int((end - begin).max(initial=0))):  # an id's rows, mostly one
                    has = np.flatnonzero(begin + step < end)
                    exact[has] = np.maximum(exact[has], _inner(asker[row[has]], posted[1][begin[has] + step]))
                best.append((who[row], posted[0][col], exact))
                held += len(row)
            if held > 1_000_000:
                best = shrunk()
                held = len(best[0][0])
                if held > 500_000:
                    yield from flush()
                    best, held = [], 0
    yield from flush()


def search(
    vectors: DataFrame, is_query: Column, *, id_col: str = "vec_id", vector_col: str = "embedding", neighbours: int = NEIGHBOURS, sample: int = SAMPLE, list_size: int = LIST_SIZE,
    list_cap: int = LIST_CAP, replicas: int = REPLICAS, file_ratio: float = FILE_RATIO, search_ratio: float = SEARCH_RATIO,
) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the nearest found of each row for which ``is_query`` holds.

    Candidates are all rows but those with the query's own id. Vectors that are null, zero or hold null or
    non-finite components take no part, nor do null ids, nor vectors of another dimension than most have.
    Rows with one id count as one candidate (with the best score) and one query. Ties go to the smaller id.
    Runs at once: the rows found are checkpointed, to see which queries have to ask again.
    """
    spark = vectors.sparkSession
    rows = vectors.withColumn("_query", F.coalesce(is_query, F.lit(False)))
    kind = vectors.schema[vector_col].dataType
    single = isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.FloatType)  # shuffled as they are; all sums are in double precision
    stored = np.dtype("<f4" if single else "<f8")
    v = F.col(vector_col).cast("array<float>" if single else "array<double>")
    rows = rows.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v"), "_query").where(F.col("vec_id").isNotNull() & usable("v"))
    sizes = rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n"), F.max(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))).alias("long2")).orderBy(F.desc("n"), "d").head()
    result = "query_id long, rank int, vec_id long, score double"
    if sizes is None:
        return spark.createDataFrame([], result)
    dimension, count, longest = sizes["d"], sizes["n"], float(np.sqrt(sizes["long2"]))
    rows = rows.where(F.size("v") == dimension)
    drawn = rows.where(fraction_of([F.col("vec_id"), F.col("v")]) < F.lit(min(1.0, sample / count))).select("vec_id", "v").distinct().toArrow().column("v").combine_chunks()
    lists = max(1, min(count // list_size, MOST_LISTS, len(drawn) // 8))
    learned = _matrix(drawn) if len(drawn) else np.ones((1, dimension))
    index = fit_centroids(learned, lists, longest)
    shared = spark.sparkContext.broadcast(index)
    filings = index.file_under(index.lengthened(learned, query=False), replicas, file_ratio)
    share = count / len(learned)  # how long a list is, is judged by the sample: it decides only over how many tasks the list is dealt
    parts = np.maximum(1, np.ceil(np.bincount(np.concatenate(filings), minlength=len(index.points)) * share / list_cap)).astype(np.int32)
    homes = np.bincount([f[0] for f in filings], minlength=len(index.points)) * share

    def filed(batches: Iterator[pa.RecordBatch], lists_of: Callable[[np.ndarray], list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            x = _matrix(batch.column(1))
            found = lists_of(x)
            which = np.repeat(np.arange(len(x)), [len(f) for f in found])
            lists = np.concatenate(found)
            data = pa.array([r.tobytes() for r in x.astype(stored)], pa.binary()).take(pa.array(which))
            columns = [pa.array(lists.astype(np.int32)), pa.array(parts[lists]), batch.column(0).take(pa.array(which)), data]
            yield pa.RecordBatch.from_arrays(columns, names=["list", "parts", "vec_id", "v"])

    def posting(x: np.ndarray) -> list[np.ndarray]:
        return shared.value.file_under(shared.value.lengthened(x, query=False), replicas, file_ratio)

    def within_ratio(x: np.ndarray) -> list[np.ndarray]:
        return shared.value.near(shared.value.lengthened(x, query=True), search_ratio)

    schema = "list int, parts int, vec_id long, v binary"
    postings = rows.select("vec_id", "v").distinct().mapInArrow(tidied(lambda b: filed(b, posting)), schema)
    askers = rows.where("_query").select("vec_id", "v").distinct()
    dealt = postings.select("list", F.pmod(F.xxhash64("vec_id", "v"), F.col("parts")).cast("int").alias("part"), F.lit(0).alias("asks"), "vec_id", "v")

    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))

    def answered(who: DataFrame, lists_of: Callable[[np.ndarray], list[np.ndarray]]) -> DataFrame:
        asked = who.mapInArrow(tidied(lambda b: filed(b, lists_of)), schema)
        asking = asked.select("list", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(1).alias("asks"), "vec_id", "v")
        together = dealt.union(asking).repartition("list", "part").sortWithinPartitions("list", "part", "asks")
        found = together.mapInArrow(tidied(lambda b: compared(b, stored, dimension, neighbours, longest)), "query_id long, vec_id long, score double")
        once = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
        return cut_lineage(once.withColumn("rank", place.cast("int")).where(F.col("rank") <= neighbours).select("query_id", "rank", "vec_id", "score"))

    answers = answered(askers, within_ratio)
    if len(index.points) == 1:  # all was read
        return answers

    def with_enough(x: np.ndarray) -> list[np.ndarray]:
        long, points = shared.value.lengthened(x, query=True), shared.value.points
        square, out = np.einsum("ij,ij->i", points, points), []
        for q in long:
            far = np.sqrt(np.maximum(q @ q + square - 2 * points @ q, 0))
            order = np.argsort(far, kind="stable")
            enough = int(np.searchsorted(np.cumsum(homes[order]), WIDER * list_size)) + 1
            out.append(order[: max(enough, int((far <= max(far.min(), shared.value.usual) * search_ratio + 1e-12).sum()))])
        return out

    def every_list(x: np.ndarray) -> list[np.ndarray]:
        return [np.arange(len(homes))] * len(x)

    for wider in (with_enough, every_list):
        full = answers.where(F.col("rank") == neighbours).select(F.col("query_id").alias("vec_id"))
        short = askers.join(full, "vec_id", "left_anti")
        if short.isEmpty():
            break
        again = answered(short, wider)
        answers = answers.join(full.withColumnRenamed("vec_id", "query_id"), "query_id", "left_semi").select(again.columns).union(again)
    return answers
