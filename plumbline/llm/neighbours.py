"""Nearest neighbours by a block matrix join over int8 product tiles.

Queries and candidates are dealt into blocks by a hash of their id. A pair of
blocks is one tile: both are quantised to int8, one matrix product of the
codes gives all distances of the tile up to known quantisation errors, and
only pairs whose lower bound is within the k-th smallest upper bound are
recomputed from the original vectors. Each tile leaves a heap of k per query;
heaps merge into the result. The bounds make the result exact.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.session import cut, table

#: Rows of a block of queries, and of candidates.
QUERY_ROWS, CANDIDATE_ROWS = 1024, 8192
#: Columns of codes whose products still add up exactly in float32.
EXACT_COLUMNS = 1024
#: Pairs that are recomputed at once.
PAIRS = 1 << 15


def usable(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(id, vec): one vector for each id; of several usable ones the smallest. Unusable vectors and null ids are left out."""
    v = F.col(vec_col)
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return vectors.where(v.isNotNull() & F.col(id_col).isNotNull() & (F.size(v) > 0) & fine).groupBy(F.col(id_col).alias("id")).agg(F.min(v).alias("vec"))


def _codes(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes, the scale of each row, and the length of each row's quantisation error."""
    scale = np.abs(x).max(1) / 127
    code = np.rint(x / scale[:, None]).astype(np.int8)
    return code, scale, np.sqrt(np.square(x - code * scale[:, None]).sum(1))


def _distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances of rows, summed column by column."""
    total = np.zeros(len(a))
    for j in range(a.shape[1]):
        d = a[:, j] - b[:, j]
        total += d * d
    return np.sqrt(total)


def tile(qid: np.ndarray, q: np.ndarray, cid: np.ndarray, c: np.ndarray, k: int) -> list[tuple]:
    """(query, candidate, distance) of each query's ``k`` nearest candidates but itself; ties to the smaller id."""
    qc, qs, qe = _codes(q)
    cc, cs, ce = _codes(c)
    dot = np.zeros((len(q), len(c)))
    for j in range(0, q.shape[1], EXACT_COLUMNS):  # whole numbers below 2**24: exact
        dot += qc[:, j : j + EXACT_COLUMNS].astype(np.float32) @ cc[:, j : j + EXACT_COLUMNS].astype(np.float32).T
    qn, cn = (np.square(x.astype(np.float64)).sum(1) for x in (qc, cc))
    norms = (qs**2 * qn)[:, None] + (cs**2 * cn)[None]
    square = norms - 2 * qs[:, None] * cs[None] * dot
    # a difference of squares: its rounding error is in proportion to the norms, so near 0 that of its root is a 1e-7th of these
    loose = 16 * np.finfo(np.float64).eps * norms
    error = qe[:, None] + ce[None] + 1e-12 * np.sqrt(norms)
    low = np.sqrt(np.maximum(square - loose, 0)) * (1 - 1e-12) - error
    high = np.sqrt(np.maximum(square, 0) + loose) * (1 + 1e-12) + error
    same = qid[:, None] == cid[None]
    high = np.where(same, np.inf, high)
    limit = np.partition(high, k - 1, axis=1)[:, k - 1] if len(c) > k else np.full(len(q), np.inf)
    row, col = np.nonzero(~same & (low <= limit[:, None]))
    dist = np.empty(len(row))
    for i in range(0, len(row), PAIRS):
        dist[i : i + PAIRS] = _distance(q[row[i : i + PAIRS]], c[col[i : i + PAIRS]])
    order = np.lexsort((cid[col], dist, row))
    row, col, dist = row[order], col[order], dist[order]
    first = np.searchsorted(row, np.arange(len(q)))
    keep = np.arange(len(row)) - first[row] < k
    return [(qid[r], cid[s], d) for r, s, d in zip(row[keep], col[keep], dist[keep], strict=True)]


def _merge(k: int):
    """A pass over (query_id, vec_id, score) that keeps a heap of ``k`` for each query of the partition."""

    def run(frames):
        heaps: dict = {}
        for f in frames:
            for q, v, s in zip(f.query_id, f.vec_id, f.score, strict=True):
                heap, entry = heaps.setdefault(q, []), (-s, -v)
                if len(heap) < k:
                    heapq.heappush(heap, entry)
                elif entry > heap[0]:
                    heapq.heapreplace(heap, entry)
        rows = [(q, i, -v, -s) for q, heap in heaps.items() for i, (s, v) in enumerate(sorted(heap, reverse=True), 1)]
        yield pd.DataFrame(rows, columns=["query_id", "rank", "vec_id", "score"]).astype({"query_id": "int64", "rank": "int32", "vec_id": "int64", "score": "float64"})

    return run


def nearest(vectors: DataFrame, is_query: Callable[[Column], Column], k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest of all other vectors to each vector whose id satisfies ``is_query``.

    * Vectors that are null, empty, zero or hold null or non-finite components
      take no part, nor do rows without id; ids are whole numbers.
    * Rows that repeat an id count once, with the smallest of their vectors.
    * Only vectors of the same length are compared.
    * With no more than ``k`` candidates all are returned; equal distances are
      ordered by id. Other columns of ``vectors`` aren't read.
    """
    rows = cut(usable(vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("vec")), "id", "vec"))
    queries = rows.where(is_query(F.col("id")))
    n, m = rows.count(), queries.count()
    down, across = max(1, -(-m // QUERY_ROWS)), max(1, -(-n // CANDIDATE_ROWS))
    deal = lambda seed, parts: F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(parts)).cast("int")
    size = F.size("vec").alias("dim")
    q = queries.select("id", "vec", size, deal(1, down).alias("down"), F.explode(F.sequence(F.lit(0), F.lit(across - 1))).alias("across"))
    c = rows.select("id", "vec", size, deal(2, across).alias("across"), F.explode(F.sequence(F.lit(0), F.lit(down - 1))).alias("down"))
    keys = ["down", "across", "dim"]

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out: list = []
        if len(left) and len(right):
            a, b = (np.stack(x.vec.to_numpy()).astype(np.float64) for x in (left, right))
            out = tile(left.id.to_numpy(), a, right.id.to_numpy(), b, k)
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"]).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})

    found = q.groupBy(keys).cogroup(c.groupBy(keys)).applyInPandas(run, "query_id long, vec_id long, score double")
    return found.repartition("query_id").mapInPandas(_merge(k), "query_id long, rank int, vec_id long, score double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op1: the ten nearest of all vectors to each with a vec_id divisible by 100."""
    return nearest(table(spark, sf_dir, "embeddings"), lambda i: i % 100 == 0)


ORACLE = """
WITH v AS (
  SELECT vec_id, min(CAST(embedding AS DOUBLE[])) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
  GROUP BY vec_id
), p AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_distance(q.e, c.e) AS score
  FROM v q JOIN v c ON len(q.e) = len(c.e) AND q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS rank FROM p) WHERE rank <= 10
"""
