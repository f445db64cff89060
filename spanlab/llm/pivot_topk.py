"""Exact top-k by inner product with a pivot-distance index.

Vectors are moved by a fixed centre, which changes all products of a query by the same amount, and get one more
coordinate, sqrt(M^2 - |x|^2) with M the largest norm; queries get a 0. Then |q - x|^2 = |q|^2 + M^2 - 2 q.x, and the
largest products are the nearest vectors. Every vector is keyed by its nearest pivot and its distance to it;
sorted by that key, blocks of rows are short annuli around pivots.

Search: a query first reads the annuli of its own nearest pivot, which gives a first k-th score. Then the
search is expanded to all annuli that the triangle inequality |d(q, p) - d(x, p)| <= d(q, x) can't rule out for
this query, and no others are compared; each task carries its k best along, so that the limit gets narrower while it
reads. Results are exact; ties go to the smaller id.

Queries are taken in blocks of at most ``QUERY_BYTES``, which every task holds; the vectors stay where they are, and what
is shuffled is k rows a query and task. Of equal vectors only the k + 1 smallest ids are candidates (no more can be in a
result without one query's own), so copies make no large group. Pivots are a bounded sample, as many as
the square root of the rows, at most ``MOST_PIVOTS``; every vector is indexed.

Defined results: rows with a null id, and vectors null or with null or non-finite components, take no part; those of
another length than the most usual one (ties: the longer) neither; rows equal in id and
vector count once; a query never finds its own id; with fewer candidates than k all are returned.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written

BLOCK_ROWS = 256
QUERY_BYTES = 16 << 20
LEAST_PIVOTS, MOST_PIVOTS = 32, 1024
_SLACK = 1e-9


def quantised(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(id, x): components floor(256 c) as doubles, rows that take no part left out."""
    c = F.col(vector)
    usable = F.forall(c, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    rows = vectors.where(c.isNotNull() & F.col(key).isNotNull()).where(usable & (F.size(c) > 0)).select(
        F.col(key).cast("long").alias("id"),
        F.transform(c, lambda v: F.floor(v.cast("double") * 256).cast("double")).alias("x"))
    return rows


def _matrix(column) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def _lift(x: np.ndarray, m2: float) -> np.ndarray:
    return np.sqrt(np.maximum(m2 - (x * x).sum(axis=1), 0))


@dataclass(frozen=True)
class Space:
    """Centre, pivots (moved by it, with their last coordinate) and the square of the largest norm."""
    centre: np.ndarray
    pivots: np.ndarray
    lift: np.ndarray
    m2: float

    def of_rows(self, x: np.ndarray) -> np.ndarray:
        """Distances of vectors to all pivots."""
        x = x - self.centre
        d2 = (x * x).sum(axis=1)[:, None] + (self.pivots * self.pivots).sum(axis=1) - 2 * (x @ self.pivots.T)
        return np.sqrt(np.maximum(d2 + (_lift(x, self.m2)[:, None] - self.lift) ** 2, 0))

    def of_queries(self, q: np.ndarray, pivots: slice | np.ndarray = slice(None)) -> np.ndarray:
        return np.sqrt(np.maximum((q * q).sum(axis=1)[:, None] + self.m2 - 2 * (q @ self.pivots[pivots].T), 0))

    def limit(self, q: np.ndarray, score: np.ndarray) -> np.ndarray:
        """The distance within which a vector has at least this product with the query."""
        d2 = (q * q).sum(axis=1) + self.m2 - 2 * (score - q @ self.centre)
        return np.sqrt(np.maximum(d2, 0)) * (1 + _SLACK) + 1e-6


def _keyed(space: Space):
    def run(batches):
        for batch in batches:
            if batch.num_rows == 0:
                continue
            d = space.of_rows(_matrix(batch.column("x")))
            home = d.argmin(axis=1)
            yield pa.record_batch([batch.column("id"), batch.column("x"), pa.array(home.astype(np.int32)),
                                   pa.array(d[np.arange(len(d)), home])], names=["id", "x", "pivot", "dist"])
    return run


def _blocks(rows_of):
    """Task function: packs sorted rows into blocks of one pivot."""
    def run(batches):
        from pyspark import TaskContext

        part, made = TaskContext.get().partitionId(), 0
        held: list[tuple] = []

        def block(ids, x, pivot, dist):
            nonlocal made
            made += 1
            return pa.record_batch(
                [pa.array([part << 32 | made]), pa.array([pivot], pa.int32()), pa.array([float(dist[0])]),
                 pa.array([float(dist[-1])]), pa.array([ids.tobytes()], pa.binary()), pa.array([x.tobytes()], pa.binary())],
                names=["block", "pivot", "lo", "hi", "ids", "x"])

        for batch in batches:
            if batch.num_rows:
                held.append((batch.column("id").to_numpy(), _matrix(batch.column("x")),
                             batch.column("pivot").to_numpy(), batch.column("dist").to_numpy()))
            ids, x, pivot, dist = (np.concatenate(c) for c in zip(*held)) if held else ([],) * 4
            while len(ids):
                n = min(rows_of, int(np.searchsorted(pivot, pivot[0], "right")))
                if n == len(ids) and n < rows_of:
                    break  # more of this pivot may follow
                yield block(ids[:n], x[:n], int(pivot[0]), dist[:n])
                ids, x, pivot, dist = ids[n:], x[n:], pivot[n:], dist[n:]
            held = [(ids, x, pivot, dist)] if len(ids) else []
        if held:
            ids, x, pivot, dist = held[0]
            yield block(ids, x, int(pivot[0]), dist)
    return run


_BLOCK = "block long, pivot int, lo double, hi double, ids binary, x binary"


def build_index(rows: DataFrame, space: Space, rows_of: int = BLOCK_ROWS) -> DataFrame:
    """Annuli: blocks of up to ``rows_of`` vectors of one pivot with the range of their distances, written."""
    keyed = rows.mapInArrow(_keyed(space), "id long, x array<double>, pivot int, dist double")
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by = ["pivot", "dist", "id"]
    return written(keyed.repartitionByRange(n, *by).sortWithinPartitions(*by).mapInArrow(_blocks(rows_of), _BLOCK), "annuli")


def _scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Integer products; exact in doubles while they stay under 2 ** 53, else with whole numbers."""
    bound = np.abs(q).max(initial=0) * np.abs(x).max(initial=0) * q.shape[1]
    if bound < 1 << 53:
        return (q @ x.T).astype(np.int64)
    return q.astype(np.int64) @ x.astype(np.int64).T


class Best:
    """The k best of each query so far, ties to the smaller id."""

    def __init__(self, n: int, k: int):
        self.score = np.full((n, k), np.iinfo(np.int64).min)
        self.id = np.full((n, k), np.iinfo(np.int64).max)
        self.found = np.zeros((n, k), bool)

    def add(self, rows: np.ndarray, ids: np.ndarray, score: np.ndarray, usable: np.ndarray) -> None:
        """Compare ``rows`` (queries) with ``ids``, given their products and which of them count."""
        k = self.score.shape[1]
        order = np.argsort(ids, kind="stable")  # equal scores: smaller id first
        score, usable = np.where(usable, score, np.iinfo(np.int64).min)[:, order], usable[:, order]
        # ~s is -s - 1, which can't overflow: what doesn't count comes last
        top = np.argsort(~score, axis=1, kind="stable")[:, :k]
        score, usable = np.take_along_axis(score, top, 1), np.take_along_axis(usable, top, 1)
        score, found = np.hstack([self.score[rows], score]), np.hstack([self.found[rows], usable])
        ids = np.hstack([self.id[rows], ids[order][top]])
        best = np.lexsort((ids, ~score, ~found), axis=1)[:, :k]
        self.score[rows], self.id[rows], self.found[rows] = (np.take_along_axis(v, best, 1) for v in (score, ids, found))


_HITS = "nth int, query_id long, vec_id long, score long"


def _scan(space: Space, k: int, shared, near: bool, compared=None):
    """Task function: the k best vectors of a task's annuli for each query of a block, those around its own pivot
    (``near``) or all others that its limit leaves. ``compared`` counts the pairs whose product was taken."""
    def run(batches):
        qid, q, home, limit = shared.value
        limit = limit.copy()
        best, last, dist = Best(len(qid), k), None, None
        for batch in batches:
            for row in batch.to_pylist():
                if row["pivot"] != last:
                    last = row["pivot"]
                    dist = space.of_queries(q, np.array([last]))[:, 0]
                mine = home == last
                if not near:
                    gap = np.maximum(dist - row["hi"], row["lo"] - dist)
                    mine = ~mine & (gap <= limit)
                at = np.flatnonzero(mine)
                if not len(at):
                    continue
                ids, x = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["x"]).reshape(-1, q.shape[1])
                if compared is not None:
                    compared.add(len(at) * len(ids))
                best.add(at, ids, _scores(q[at], x), qid[at][:, None] != ids)
                full = at[best.found[at, -1]]
                limit[full] = np.minimum(limit[full], space.limit(q[full], best.score[full, -1]))
        query, _ = np.nonzero(best.found)
        yield pa.record_batch([pa.array(query.astype(np.int32)), pa.array(qid[query]), pa.array(best.id[best.found]),
                               pa.array(best.score[best.found])], names=["nth", "query_id", "vec_id", "score"])
    return run


def top_k(vectors: DataFrame, is_query, k: int = 5, n_pivots: int | None = None, key: str = "vec_id",
          vector: str = "embedding", compared=None) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k largest integer products. ``is_query``: a
    condition on ``id``; ``compared``: an accumulator of the pairs that the index left to compare."""
    spark = vectors.sparkSession
    rows = quantised(vectors, key, vector).dropDuplicates(["id", "x"])
    rows = written(rows, "vectors")
    usual = rows.groupBy(F.size("x").alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).first()
    schema = "query_id long, rank int, vec_id long, score long"
    if usual is None:
        return spark.createDataFrame([], schema)
    dim = usual["dim"]
    rows = rows.where(F.size("x") == dim)
    n_pivots = n_pivots or min(max(math.isqrt(usual["count"]), LEAST_PIVOTS), MOST_PIVOTS)
    chosen = rows.select("x").orderBy(F.xxhash64("x", F.lit(3)), "x").limit(4 * n_pivots).collect()
    sample = np.array(list(dict.fromkeys(tuple(r["x"]) for r in chosen)))
    centre = sample.mean(axis=0)
    moved = F.zip_with("x", F.array(*[F.lit(float(v)) for v in centre]), lambda a, b: (a - b) * (a - b))
    m2 = float(rows.agg(F.max(F.aggregate(moved, F.lit(0.0), lambda a, v: a + v))).first()[0]) * (1 + _SLACK)
    pivots = sample[:n_pivots] - centre
    space = Space(centre, pivots, _lift(pivots, m2), m2)
    few = F.row_number().over(Window.partitionBy("x").orderBy("id")) <= k + 1
    index = build_index(rows.withColumn("few__", few).where("few__").select("id", "x"), space)

    best = Window.partitionBy("nth").orderBy(F.desc("score"), "vec_id")  # an id may stand for several queries

    def ranked(hits):
        return hits.withColumn("rank", F.row_number().over(best).cast("int")).where(F.col("rank") <= k)

    asked = rows.where(is_query).select("id", "x").distinct()
    blocks = -(-asked.count() * (dim + 2) * 8 // QUERY_BYTES)
    out = spark.createDataFrame([], schema)
    for b in range(blocks):
        got = asked.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == b).toArrow()  # about QUERY_BYTES
        qid, q = got.column("id").to_numpy(), _matrix(got.column("x"))
        home = np.concatenate([np.zeros(0, np.int64), *(space.of_queries(q[i:i + 1024]).argmin(axis=1) for i in range(0, len(q), 1024))])

        def scan(near, limit):
            shared = spark.sparkContext.broadcast((qid, q, home, limit))
            return ranked(written(index.mapInArrow(_scan(space, k, shared, near, compared), _HITS), "hits"))

        near = written(scan(True, np.full(len(q), np.inf)), "near")
        limit = np.full(len(q), np.inf)
        for r in near.where(F.col("rank") == k).select("nth", "score").collect():  # at most a row a query
            limit[r["nth"]] = space.limit(q[r["nth"]][None], np.array([r["score"]]))[0]
        found = ranked(near.drop("rank").unionByName(scan(False, limit).drop("rank"))).select("query_id", "rank", "vec_id", "score")
        out = out.unionByName(written(found, "found") if blocks > 1 else found)
    return out
