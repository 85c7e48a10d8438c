"""Exact nearest neighbours by a block matrix join in 8-bit integers.

Queries are dealt into blocks of bounded size, each of which is broadcast for one pass over all rows.
A pass multiplies tiles of 8-bit codes, exactly, in single precision. With v = s * code + r, the
product of two vectors differs from s * t * <code, code> by at most |r_q| |c| + |s code_q| |r_c|.
Pairs whose upper bound reaches the query's threshold are recomputed in double precision, added in the
order of the components; each query keeps its best in a heap of k. The threshold starts from the k-th
best among the queries of the table itself, so that no pass sends more than a few rows for each query.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orrery.llm.common import checkpoint

TILE_ROWS, TILE_QUERIES = 2048, 512
#: Dimensions whose products of codes stay below 2**24, so that single precision adds them exactly.
EXACT_DIMENSIONS = (1 << 24) // 127**2
#: Bytes of query vectors (double precision) that are broadcast at once.
BLOCK_BYTES = 48 << 20
#: Products of components that are summed at once for pairs that the bounds leave.
PAIR_VALUES = 1 << 22
SCHEMA = "query bigint, query_id bigint, vec_id bigint, score double"


class Codes:
    """8-bit codes of the rows of a matrix, with what their bounds need."""

    def __init__(self, x: np.ndarray):
        top = np.abs(x).max(1)
        self.scale = np.where(top > 0, top / 127, 1.0)
        codes = np.rint(x / self.scale[:, None])
        self.codes = codes.astype(np.int8)
        rest = x - codes * self.scale[:, None]
        slack = 1 + 1e-6  # for the rounding of the bounds themselves
        self.norm = np.linalg.norm(x, axis=1) * slack
        self.rest = np.linalg.norm(rest, axis=1) * slack + (1e-12 + 4e-16 * x.shape[1]) * self.norm
        self.coded = np.linalg.norm(codes * self.scale[:, None], axis=1) * slack


def matrix(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, vectors in double precision) for each length of vector in the batch."""
    ids, lists = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1)
    lengths = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
    for d in np.unique(lengths).tolist():
        at = np.flatnonzero(lengths == d)
        part = lists.take(pa.array(at))
        yield ids[at], part.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(at), d)


class Block:
    """Queries of one length, with the heap and threshold of each."""

    def __init__(self, numbers: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int, least: np.ndarray):
        self.numbers, self.ids, self.x, self.k = numbers, ids, x, k
        self.codes = Codes(x)
        self.float_codes = self.codes.codes.astype(np.float32)
        self.heaps: list[list[tuple[float, int]]] = [[] for _ in ids]
        self.least = least.copy()

    def meet(self, ids: np.ndarray, x: np.ndarray) -> None:
        for at in range(0, len(ids), TILE_ROWS):
            self._tile(ids[at : at + TILE_ROWS], x[at : at + TILE_ROWS])

    def _tile(self, ids: np.ndarray, x: np.ndarray) -> None:
        c, q = Codes(x), self.codes
        columns = np.ascontiguousarray(c.codes.astype(np.float32).T)
        pieces = [slice(d, d + EXACT_DIMENSIONS) for d in range(0, len(columns), EXACT_DIMENSIONS)]
        for at in range(0, len(self.ids), TILE_QUERIES):
            own = slice(at, at + TILE_QUERIES)
            products = sum((self.float_codes[own, d] @ columns[d]).astype(np.float64) for d in pieces)
            products *= q.scale[own, None]
            products *= c.scale
            bound = q.rest[own, None] * c.norm + q.coded[own, None] * c.rest
            same = self.ids[own, None] == ids
            if len(ids) > self.k:
                low = np.where(same, -np.inf, products - bound)
                self.least[own] = np.maximum(self.least[own], np.partition(low, -self.k, axis=1)[:, -self.k])
            row, column = np.nonzero((products + bound >= self.least[own, None]) & ~same)
            step = max(1, PAIR_VALUES // x.shape[1])
            for a in range(0, len(row), step):
                r, j = row[a : a + step] + at, column[a : a + step]
                scores = np.cumsum(self.x[r] * x[j], axis=1)[:, -1]
                keep = scores >= self.least[r]
                for i, s, v in zip(r[keep].tolist(), scores[keep].tolist(), ids[j[keep]].tolist(), strict=True):
                    self._push(i, s, v)

    def _push(self, i: int, score: float, vec_id: int) -> None:
        heap = self.heaps[i]
        if len(heap) < self.k:
            heapq.heappush(heap, (score, -vec_id))
        elif (score, -vec_id) > heap[0]:
            heapq.heapreplace(heap, (score, -vec_id))
        if len(heap) == self.k and heap[0][0] > self.least[i]:
            self.least[i] = heap[0][0]

    def rows(self) -> pa.RecordBatch:
        n = [len(h) for h in self.heaps]
        flat = [x for h in self.heaps for x in h]
        return pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(self.numbers, n)), pa.array(np.repeat(self.ids, n)), pa.array([-v for _, v in flat], pa.int64()), pa.array([s for s, _ in flat], pa.float64())],
            names=["query", "query_id", "vec_id", "score"],
        )


def usable(vector: Column) -> Column:
    """Not null, no null or non-finite component, and not zero."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & ~bad & F.exists(vector, lambda x: x != 0)


def _pass(rows: DataFrame, blocks, k: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = {x.shape[1]: Block(numbers, ids, x, k, least) for numbers, ids, x, least in blocks.value}
        for batch in batches:
            for ids, x in matrix(batch):
                if x.shape[1] in own:
                    own[x.shape[1]].meet(ids, x)
        yield from (b.rows() for b in own.values())

    return rows.mapInArrow(run, SCHEMA)


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, vec_id: str = "vec_id", vector: str = "embedding", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The k rows of largest inner product for each query row: query_id, rank, vec_id, score.

    Candidates are all rows with another vec_id than the query's; vectors that are null, zero or hold a
    null or non-finite component take no part on either side, nor do rows with a null id. Only vectors of
    one length meet. Ties go to the smaller vec_id. Equal rows count each, as queries and as candidates.
    score adds the products in the order of the components, so that it is the same wherever it is computed.
    Exact: bounds only save work. An empty table gives no rows.
    """
    spark = vectors.sparkSession
    rows = vectors.where(usable(F.col(vector)) & F.col(vec_id).isNotNull())
    query = is_query & F.lit(True)
    rows = rows.select(F.col(vec_id).cast("bigint").alias("vec_id"), F.col(vector).alias("vector"), query.alias("is_query"))
    queries, candidates = rows.where("is_query").select("vec_id", "vector"), rows.select("vec_id", "vector")
    size = queries.agg(F.sum(F.size("vector") * 8 + 64)).first()[0] or 0
    n_blocks = int(-(-size // block_bytes))
    found = None
    for k_block in range(n_blocks):
        part = queries if n_blocks == 1 else queries.where(F.pmod(F.xxhash64("vec_id", "vector"), F.lit(n_blocks)) == k_block)
        table = part.toArrow()  # about block_bytes
        parts, n = [], 0
        for batch in table.combine_chunks().to_batches():
            for ids, x in matrix(batch):
                parts.append((np.arange(n, n + len(ids)), ids, x))
                n += len(ids)
        by_length: dict[int, list] = {}
        for p in parts:
            by_length.setdefault(p[2].shape[1], []).append(p)
        joined = [tuple(np.concatenate([p[i] for p in ps]) for i in range(3)) for ps in by_length.values()]
        # Thresholds from the queries alone: a sample of the candidates, so they can only be too low.
        seeded = _pass(queries, spark.sparkContext.broadcast([(*j, np.full(len(j[1]), -np.inf)) for j in joined]), k)
        kth = _best(seeded, k).where(F.col("rank") == k).select("query", "score").toArrow()
        least = np.full(n, -np.inf)
        least[kth["query"].to_numpy()] = kth["score"].to_numpy()
        blocks = spark.sparkContext.broadcast([(*j, least[j[0]]) for j in joined])
        own = _best(_pass(candidates, blocks, k), k).select("query_id", "rank", "vec_id", "score")
        if n_blocks > 1:
            own = checkpoint(own)
        found = own if found is None else found.unionByName(own)
    return found if found is not None else spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
