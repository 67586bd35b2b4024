"""Nearest neighbours by cosine, exact, as a block matrix join over int8 tiles.

Vectors are packed into blocks where they are read: ids, the original components, int8 codes of the unit vector with
one scale, and the norm of what the codes miss. Query blocks and candidate groups form a grid, each cell one task.
A cell multiplies tiles of codes; a product's distance from the cosine is at most the two code errors, so a pair whose
upper bound stays under the k-th best lower bound of its query cannot be among the k nearest and goes. Surviving pairs
are recomputed from the original components in double precision and kept in a heap of k for each query; cells' heaps
meet in one ranking. The bounds are never cut short, so the result is that of brute force.

Copies of one vector beyond the k + 1 of smallest id leave a block when it is packed, as they are nearest to nobody.
A cell holds at most GROUP candidates and one query block, whatever the size of the table; candidates are dealt by
hash, so no source or group of copies meets in a cell. Query blocks are replicated once for each candidate group.

Vectors that are null, empty, zero or have null or non-finite components take no part. Only vectors of equal length
meet. Rows of the query's own vec_id are never its neighbours; repeated vec_ids are candidates each. Ties go to the
smaller vec_id. Components keep the precision of the column. An empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from srcloom.functions.shared import even_partitions, written

GROUP, QUERY_BLOCK, TILE = 4096, 1024, 1024
#: Components of vectors that are rescored at once.
SLICE = 1 << 21

_BLOCK = "dim int, part int, ids binary, vectors binary, codes binary, scales binary, errors binary"


def _first_copies(ids: np.ndarray, x: np.ndarray, most: int) -> np.ndarray:
    """Places of the `most` rows of smallest id of each distinct vector: no query has use for more of its copies."""
    _, which = np.unique(np.ascontiguousarray(x).view(np.dtype((np.void, x.dtype.itemsize * x.shape[1]))).ravel(), return_inverse=True)
    order = np.lexsort((ids, which))
    ranks = np.arange(len(order)) - np.searchsorted(which[order], which[order])
    return np.sort(order[ranks < most])


def _packed(rows_each: int, copies: int | None = None):
    """Packs rows (part, vec_id, vector) of a task, which come sorted by part, into blocks of up to rows_each rows, with at most
    `copies` rows of one vector in a block, if given."""

    def block(dim: int, part: int, ids: np.ndarray, x: np.ndarray) -> pa.RecordBatch:
        if copies is not None:
            keep = _first_copies(ids, x, copies)
            ids, x = ids[keep], x[keep]
        wide = x.astype(np.float64)
        top = np.abs(wide).max(axis=1, keepdims=True)
        unit = wide / top
        unit /= np.sqrt((unit * unit).sum(axis=1, keepdims=True))
        scale = np.abs(unit).max(axis=1) / 127
        codes = np.rint(unit / scale[:, None]).astype(np.int8)
        errors = np.sqrt(((unit - codes * scale[:, None]) ** 2).sum(axis=1))
        cells = [ids.tobytes(), x.tobytes(), codes.tobytes(), scale.tobytes(), errors.tobytes()]
        return pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), pa.array([part], pa.int32()), *[pa.array([c], pa.binary()) for c in cells]], ["dim", "part", "ids", "vectors", "codes", "scales", "errors"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], list] = {}
        for batch in batches:
            part, ids, vectors = batch.column("part").to_numpy(), batch.column("vec_id").to_numpy(), batch.column("vector")
            lengths = np.diff(vectors.offsets.to_numpy())
            flat, cuts = vectors.values.to_numpy(), vectors.offsets.to_numpy()
            for key in sorted(set(zip(lengths.tolist(), part.tolist(), strict=True))):
                at = np.flatnonzero((lengths == key[0]) & (part == key[1]))
                rows = flat[cuts[at][:, None] + np.arange(key[0])]
                some = held.setdefault(key, [])
                some.append((ids[at], rows))
                if sum(len(i) for i, _ in some) >= rows_each:
                    i, x = np.concatenate([s[0] for s in some]), np.concatenate([s[1] for s in some])
                    for a in range(0, len(i) - rows_each + 1, rows_each):
                        yield block(*key, i[a : a + rows_each], x[a : a + rows_each])
                    rest = len(i) % rows_each
                    held[key] = [(i[len(i) - rest :], x[len(i) - rest :])] if rest else []
        for key, some in held.items():
            if some:
                yield block(*key, np.concatenate([s[0] for s in some]), np.concatenate([s[1] for s in some]))

    return run


def _unpacked(table: pa.Table) -> Iterator[tuple[np.ndarray, ...]]:
    for row in table.to_pylist():
        d, ids = row["dim"], np.frombuffer(row["ids"], dtype=np.int64)
        kind = np.float32 if len(row["vectors"]) == 4 * d * len(ids) else np.float64
        yield ids, np.frombuffer(row["vectors"], dtype=kind).reshape(-1, d), np.frombuffer(row["codes"], dtype=np.int8).reshape(-1, d), np.frombuffer(row["scales"]), np.frombuffer(row["errors"])


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row-wise cosine in double precision, each sum in the order of the components.

    Rows of doubles are first divided by a power of two near their largest component, which rounds nothing and keeps
    squares in range.
    """
    a, b = (np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, initial=0.0))[1][:, None]) if x.dtype == np.float64 else x for x in (a, b))
    dot, x, y = np.zeros(len(a)), np.zeros(len(a)), np.zeros(len(a))
    for k in range(a.shape[1]):
        p, q = a[:, k].astype(np.float64), b[:, k].astype(np.float64)
        dot += p * q
        x += p * p
        y += q * q
    return np.clip(dot / np.sqrt(x * y), -1.0, 1.0)


class Heaps:
    """The k best (score, then smaller id) of each query."""

    def __init__(self, n: int, k: int):
        self.k, self.heaps = k, [[] for _ in range(n)]
        self.floor = np.full(n, -np.inf)  # the k-th best score of a full heap

    def push(self, query: int, score: float, vec_id: int) -> None:
        heap = self.heaps[query]
        if len(heap) < self.k:
            heapq.heappush(heap, (score, -vec_id))
        elif (score, -vec_id) > heap[0]:
            heapq.heapreplace(heap, (score, -vec_id))
        if len(heap) == self.k:
            self.floor[query] = heap[0][0]


def _cell(k: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple[int, int, float]] = []
        for q_ids, q_vectors, q_codes, q_scales, q_errors in _unpacked(left):
            heaps = Heaps(len(q_ids), k)
            q_wide = q_codes.astype(np.float32)
            dim = q_codes.shape[1]
            rounding = 1e-6 if 127 * 127 * dim < 1 << 24 else 1e-6 + dim * 2.0**-22  # sums of codes are whole in float32 up to 2^24
            for ids, vectors, codes, scales, errors in _unpacked(right):
                for t in range(0, len(ids), TILE):
                    cut = slice(t, t + TILE)
                    near = (q_wide @ codes[cut].astype(np.float32).T).astype(np.float64) * q_scales[:, None] * scales[cut]
                    slack = q_errors[:, None] * (1 + errors[cut]) + errors[cut] + rounding
                    own = q_ids[:, None] == ids[cut]
                    low = np.where(own, -np.inf, near - slack)
                    floor = heaps.floor
                    if low.shape[1] >= k:
                        floor = np.maximum(floor, np.partition(low, low.shape[1] - k, axis=1)[:, low.shape[1] - k])
                    left_query, left_at = np.nonzero((near + slack >= floor[:, None]) & ~own)
                    above = (near + slack)[left_query, left_at]
                    # pairs are rescored in slices, and those that the slices before have ruled out by then are not
                    for a in range(0, len(left_query), max(1, SLICE // dim)):
                        query, at = left_query[a : a + max(1, SLICE // dim)], left_at[a : a + max(1, SLICE // dim)]
                        some = above[a : a + max(1, SLICE // dim)] >= heaps.floor[query]
                        query, at = query[some], at[some]
                        score = cosine(q_vectors[query], vectors[cut][at])
                        found = ids[cut][at]
                        order = np.lexsort((found, -score, query))
                        query, score, found = query[order], score[order], found[order]
                        place = np.arange(len(query)) - np.searchsorted(query, query)
                        for q, s, i in zip(query[place < k].tolist(), score[place < k].tolist(), found[place < k].tolist(), strict=True):
                            heaps.push(q, s, i)
            out += [(int(q), -i, s) for q, heap in zip(q_ids, heaps.heaps, strict=True) for s, i in heap]
        return pa.table({"query_id": pa.array([r[0] for r in out], pa.int64()), "vec_id": pa.array([r[1] for r in out], pa.int64()), "score": pa.array([r[2] for r in out], pa.float64())})

    return run


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and vector (array<float> where the column is that, else array<double>) of the rows that take part."""
    kind = "array<float>" if vectors.schema["embedding"].dataType.simpleString() == "array<float>" else "array<double>"
    finite = ~F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vectors.select("vec_id", F.col("embedding").cast(kind).alias("vector")).filter(F.col("vec_id").isNotNull() & F.col("vector").isNotNull() & finite & F.exists("vector", lambda x: x != 0))


def nearest(vectors: DataFrame, queries_each: int = 50, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id and score of the k nearest of each vector whose vec_id is divisible by queries_each."""
    spark = vectors.sparkSession
    rows = usable(vectors)
    n, n_queries = rows.agg(F.count("*"), F.count_if(F.pmod("vec_id", F.lit(queries_each)) == 0)).first()
    groups, blocks = even_partitions(n, GROUP), even_partitions(n_queries, QUERY_BLOCK)
    dealt = lambda df, parts, rows_each, copies=None: df.withColumn("part", F.pmod(F.xxhash64("vec_id"), F.lit(parts)).cast("int")).repartition("part").sortWithinPartitions("part", "vec_id").mapInArrow(_packed(rows_each, copies), _BLOCK)
    asked = written(dealt(rows.filter(F.pmod("vec_id", F.lit(queries_each)) == 0), blocks, QUERY_BLOCK), "queries")
    held = dealt(rows, groups, GROUP, k + 1)
    asked = asked.withColumnRenamed("part", "q").withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    held = held.withColumnRenamed("part", "c").withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    found = asked.groupBy("dim", "q", "c").cogroup(held.groupBy("dim", "q", "c")).applyInArrow(_cell(k), "query_id long, vec_id long, score double")
    by = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


#: The same rows in DuckDB.
SQL = """
WITH v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_cosine_similarity(q.e, c.e) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 50 = 0
)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score
FROM pairs QUALIFY rank <= 5
"""
