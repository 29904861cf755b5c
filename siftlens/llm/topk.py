"""Exact top-k search by inner product, in three phases with a uniform threshold.

The dimensions are cut into slices; a slice of a block of vectors is a node that knows a part of every score. Queries go
out in groups of at most GROUP_BYTES, which are broadcast; the vectors never move. Each task goes through its blocks and
keeps the k best of each query so far, so what it sends does not grow with its rows.

1. One node of each block, slices in turn, gathers its local list of the highest parts of each query. The exact scores of
   the vectors on the lists give, over all blocks, a cutoff that the k-th best score reaches at least. This costs the
   share of one slice.
2. The cutoff is broadcast. A vector whose score reaches it must reach a uniform share of it in some slice. Slice after
   slice, the nodes collect the entries that reach the share; an entry that does not counts as the share at most, and what
   the slices not yet looked at can add is bounded by the norms of what is left of both vectors. Pairs that stay below the
   cutoff are dropped, and once few are left no further slice is multiplied.
3. The scores of what is left are resolved exactly, and the k highest stay.
"""

from collections.abc import Iterator
from operator import mul

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftlens.llm.common import quoted, released, stored, table

K, EVERY, SCALE = 5, 50, 256
#: Slices of the dimensions; most vectors of a block, and bytes; queries multiplied at a time; bytes of queries broadcast.
SLICES, BLOCK, BLOCK_BYTES, QUERIES, GROUP_BYTES = 4, 4096, 8 << 20, 512, 64 << 20
#: Below this share of pairs the rest is resolved pair by pair, so many pairs at a time.
FEW, PAIRS = 0.04, 1 << 15
#: Up to this, sums of products are exact in double precision.
_EXACT = float(1 << 53)
#: Scores below this by their vectors' lengths are added as longs; others as Python integers, held to +-_MOST.
_PLAIN, _MOST = float(1 << 60), (1 << 63) - 1


def quantised(vector: Column, scale: int = SCALE) -> Column:
    """floor(scale * x) of each component, a whole number held as a double, as it may be beyond a long; null for vectors
    that take no part."""
    x = lambda c: F.lit(float(scale)) * c.cast("double")
    whole = F.transform(vector, lambda c: F.when(F.abs(x(c)) < F.lit(_EXACT), F.floor(x(c)).cast("double")).otherwise(x(c)))
    bad = F.exists(vector, lambda c: c.isNull() | F.isnan(c.cast("double")) | (F.abs(c.cast("double")) == F.lit(float("inf"))))
    return F.when(vector.isNotNull() & ~F.coalesce(bad, F.lit(False)), whole)


def _beyond(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Which pairs' products or sums might not be longs."""
    most = lambda x: np.abs(x).max(axis=1, initial=0)
    with np.errstate(over="ignore", invalid="ignore"):
        own, other = most(queries)[:, None], most(vectors)[None, :]
        return (own > 0) & (other > 0) & ~(np.maximum(own, 1) * np.maximum(other, 1) * max(queries.shape[1], vectors.shape[1], 1) < _PLAIN)


def _large(queries: np.ndarray, vectors: np.ndarray, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, column and score, in Python integers held to +-_MOST, of the pairs."""
    wide = min(queries.shape[1], vectors.shape[1])
    there = np.flatnonzero(pairs.any(axis=0))
    ints = dict(zip(there.tolist(), ([int(x) for x in v] for v in vectors[there, :wide]), strict=True))
    rows, cols, scores = [], [], []
    for i in np.flatnonzero(pairs.any(axis=1)).tolist():
        q, col = [int(x) for x in queries[i, :wide]], np.flatnonzero(pairs[i])
        score = np.array([max(-_MOST, min(_MOST, sum(map(mul, q, ints[j])))) for j in col.tolist()], np.int64)
        rows.append(np.full(len(col), i))
        cols.append(col)
        scores.append(score)
    return np.concatenate(rows), np.concatenate(cols), np.concatenate(scores)


def _matrix(vectors: pa.Array) -> np.ndarray:
    """A list column as a matrix; zeros follow shorter vectors."""
    flat, sizes = vectors.flatten().to_numpy(zero_copy_only=False), np.diff(vectors.offsets.to_numpy())
    wide = int(sizes.max(initial=0))
    matrix = np.zeros((len(sizes), wide))
    if wide:
        matrix[np.arange(wide) < sizes[:, None]] = flat
    return matrix


class _Block:
    """Vectors by ascending id, repeated rows once; how many follow each other with one id."""

    def __init__(self, ids: np.ndarray, matrix: np.ndarray):
        order = np.argsort(ids, kind="stable")
        ids, matrix = ids[order], matrix[order]
        same = np.append(False, (ids[1:] == ids[:-1]) & (matrix[1:] == matrix[:-1]).all(axis=1)) if len(ids) else np.zeros(0, bool)
        self.ids, self.matrix = ids[~same], matrix[~same]
        self.left = _left(self.matrix)


def _left(matrix: np.ndarray, slices: int = SLICES) -> list[np.ndarray]:
    """Norms of what is left of each row from each slice on, a little more than exact."""
    with np.errstate(over="ignore", invalid="ignore"):
        return [np.sqrt((matrix[:, a:] ** 2).sum(axis=1)) * (1 + 1e-9) for a, _ in _cuts(matrix.shape[1], slices)]


def _cuts(wide: int, slices: int) -> list[tuple[int, int]]:
    at = [k * wide // slices for k in range(slices + 1)]
    return list(zip(at, at[1:], strict=False))


def _sliced(q: np.ndarray, v: np.ndarray, cut: tuple[int, int]) -> np.ndarray:
    """What a slice adds to the scores, nearly."""
    a, b = cut
    return q[:, a:b] @ v[:, a:b].T


def _resolved(q: np.ndarray, v: np.ndarray, row: np.ndarray, col: np.ndarray) -> np.ndarray:
    """The exact scores of pairs."""
    most = float(np.abs(q).max(initial=0)) * float(np.abs(v).max(initial=0)) * max(1, q.shape[1])
    if most >= _EXACT:
        fits = lambda x: np.where(np.abs(x) < _PLAIN, x, 0).astype(np.int64)
        q, v = fits(q), fits(v)
    parts = [np.einsum("nd,nd->n", q[row[a : a + PAIRS]], v[col[a : a + PAIRS]]).astype(np.int64) for a in range(0, len(row), PAIRS)]
    return np.concatenate([np.zeros(0, np.int64), *parts])


def _listed(q: np.ndarray, v: np.ndarray, other: np.ndarray, k: int, cut: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Phase 1: the pairs on the list of one node."""
    if other.shape[1] <= k:
        return np.nonzero(other)
    part = np.where(other, _sliced(q, v, cut), -np.inf)
    top = np.argpartition(-part, k - 1, axis=1)[:, :k]
    row = np.repeat(np.arange(len(q)), k)
    col = top.ravel()
    there = other[row, col]
    return row[there], col[there]


def _reaching(q: np.ndarray, v: np.ndarray, other: np.ndarray, floor: np.ndarray, left: tuple[list[np.ndarray], list[np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Phase 2: the pairs whose entries reach the share of the cutoff in some slice, as far as slices were looked at, and
    whose score can still reach the cutoff."""
    cuts = _cuts(q.shape[1], len(left[0]))
    floor = (floor - 1 - np.abs(floor) * 1e-9)[:, None]
    share = floor / len(cuts)
    alive, sent = other, np.zeros(other.shape, bool)
    known = np.zeros(other.shape)
    for s, cut in enumerate(cuts):
        part = _sliced(q, v, cut)
        reach = part >= share
        sent |= reach
        known += np.where(reach, part, share)
        most = known if s + 1 == len(cuts) else known + left[0][s + 1][:, None] * left[1][s + 1][None, :]
        alive = alive & (most >= floor)
        if np.count_nonzero(alive) <= FEW * alive.size:
            break
    else:
        alive = alive & sent
    return np.nonzero(alive)


class _Best:
    """The k best items of each query of a group so far, of distinct ids."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.score, self.id = np.full((n, k), -_MOST), np.full((n, k), -1)

    def put(self, row: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        keep = score >= self.score[row, -1]
        row, ids, score = row[keep], ids[keep], score[keep]
        if not len(row):
            return
        some = np.unique(row)
        held = self.score[some] > -_MOST
        row = np.concatenate([row, np.repeat(some, held.sum(axis=1))])
        ids, score = np.concatenate([ids, self.id[some][held]]), np.concatenate([score, self.score[some][held]])
        # The highest score of each item, then the order of items.
        order = np.lexsort((-score, ids, row))
        row, ids, score = row[order], ids[order], score[order]
        first = np.append(True, (row[1:] != row[:-1]) | (ids[1:] != ids[:-1]))
        row, ids, score = row[first], ids[first], score[first]
        order = np.lexsort((ids, -score, row))
        row, ids, score = row[order], ids[order], score[order]
        begin = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
        nth = np.arange(len(row)) - np.repeat(begin, np.diff(np.append(begin, len(row))))
        top = nth < self.k
        self.score[some], self.id[some] = -_MOST, -1
        self.score[row[top], nth[top]], self.id[row[top], nth[top]] = score[top], ids[top]


def _visits(group, k: int, cutoffs):
    """The best of each query of a group over all blocks of a task: of the listed pairs, or of those that may reach the
    cutoff and do."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qid, queries, left = group.value
        best, turn = _Best(len(qid), k), 0
        floors = None if cutoffs is None else cutoffs.value
        for batch in batches:
            matrix = _matrix(batch.column("vector"))
            ids = batch.column("id").to_numpy(zero_copy_only=False)
            size = max(1, min(BLOCK, BLOCK_BYTES // (8 * max(1, matrix.shape[1]))))
            for a in range(0, len(ids), size):
                block, turn = _Block(ids[a : a + size], matrix[a : a + size]), turn + 1
                for b in range(0, len(qid), QUERIES):
                    _visit(best, b, qid[b : b + QUERIES], queries[b : b + QUERIES], [x[b : b + QUERIES] for x in left], block, k, floors, turn)
        row, nth = np.nonzero(best.score > -_MOST)
        if floors is not None:
            keep = best.score[row, nth] >= floors[row]
            row, nth = row[keep], nth[keep]
        yield pa.RecordBatch.from_arrays([pa.array(row), pa.array(qid[row]), pa.array(best.id[row, nth]), pa.array(best.score[row, nth])], names=["q", "query_id", "vec_id", "score"])

    return released(run)


def _visit(best: _Best, first: int, qid: np.ndarray, q: np.ndarray, left: list[np.ndarray], block: _Block, k: int, floors, turn: int) -> None:
    wide = max(q.shape[1], block.matrix.shape[1])
    fit = lambda m: m if m.shape[1] == wide else np.pad(m, ((0, 0), (0, wide - m.shape[1])))
    same = q.shape[1] == wide == block.matrix.shape[1]
    q, v = fit(q), fit(block.matrix)
    other = qid[:, None] != block.ids[None, :]
    large = _beyond(q, v) if not _small(q, v) else None
    plain = other if large is None else other & ~large
    if floors is None:
        cuts = _cuts(wide, SLICES)
        row, col = _listed(q, v, plain, k, cuts[turn % SLICES])
    else:
        # What the task holds already is a cutoff as well.
        floor = np.maximum(floors[first : first + len(qid)], best.score[first : first + len(qid), -1]).astype(np.float64)
        row, col = _reaching(q, v, plain, floor, (left, block.left) if same else (_left(q), _left(v)))
    score = _resolved(q, v, row, col)
    if large is not None and (large := large & other).any():
        row, col, score = map(np.concatenate, zip((row, col, score), _large(q, v, large), strict=True))
    best.put(first + row, block.ids[col], score)


def _small(q: np.ndarray, v: np.ndarray) -> bool:
    most = lambda x: max(1.0, float(np.abs(x).max(initial=0)))
    return most(q) * most(v) * max(1, q.shape[1]) < _EXACT


_SCORES = "q long, query_id long, vec_id long, score long"


def top_k(vectors: DataFrame, k: int = K, every: int = EVERY, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """The k highest-scoring other vectors of each query: query_id, rank, vec_id, score. Queries are the rows whose id is
    divisible by `every`; ties go to the smaller id.

    Vectors that are null, or hold a null or a component that is not finite, take no part, nor do rows without an id.
    Scores are exact whatever the components; one among the k highest that is not a long is an error.
    Rows that share an id are one item, whose score is the highest of theirs. Vectors of unequal length are taken as if
    zeros followed. Other columns are not read; an empty table gives no rows."""
    spark = vectors.sparkSession
    rows = vectors.select(quoted(id_col).cast("long").alias("id"), quantised(quoted(vector_col), scale).alias("vector")).dropna()
    rows = stored(rows, "vectors")
    asked = stored(rows.where(F.col("id") % every == 0).distinct(), "queries")
    groups = max(1, -(-(asked.agg(F.sum(8 * F.size("vector") + 8)).first()[0] or 0) // group_bytes))
    found = [_group(rows, asked.where(F.pmod(F.xxhash64("id", "vector"), F.lit(groups)) == g), k) for g in range(groups)]
    found = [x for x in found if x is not None]
    if not found:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    every_ = found[0]
    for x in found[1:]:
        every_ = every_.union(x)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    items = every_.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    top = items.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    fits = F.when(F.abs("score") < _MOST, F.col("score")).otherwise(F.raise_error(F.lit("a score is beyond a long")).cast("long"))
    return top.select("query_id", "rank", "vec_id", fits.alias("score"))


def _group(rows: DataFrame, asked: DataFrame, k: int) -> DataFrame | None:
    """Scores of a group of queries, the k best of each among them, as a stored table; None where there is no query. What
    reaches the driver is the group itself and a cutoff for each of its queries."""
    context = rows.sparkSession.sparkContext
    own = asked.orderBy("id", "vector").toArrow()
    if not own.num_rows:
        return None
    qid = own.column("id").combine_chunks().to_numpy(zero_copy_only=False)
    queries = _matrix(own.column("vector").combine_chunks())
    group = context.broadcast((qid, queries, _left(queries)))
    best = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    listed = rows.mapInArrow(_visits(group, k, None), _SCORES).groupBy("q", "vec_id").agg(F.max("score").alias("score"))
    listed = listed.withColumn("rank", F.row_number().over(best)).where(F.col("rank") == k)
    cutoffs = np.full(len(qid), -_MOST)  # a query with fewer than k candidates collects everything
    told = listed.select("q", "score").toArrow()
    cutoffs[told.column("q").to_numpy()] = told.column("score").to_numpy()
    return stored(rows.mapInArrow(_visits(group, k, context.broadcast(cutoffs)), _SCORES), "found").drop("q")


def op1_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"))
