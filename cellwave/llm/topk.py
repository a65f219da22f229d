"""Exact top-k by inner product: columnar branch-and-bound.

Queries and candidates are dealt to the cells of a grid; a cell holds its
candidates dimension by dimension. A query visits the dimensions in the order of
its own largest components, a block at a time, and adds up each candidate's
score and how much of the candidate's mass (squared length) it has seen. What
the dimensions to come can add is at most the product of the two remaining
lengths, so a candidate whose score and bound together are below a score that k
others are sure to reach is out, and the arrays are compacted to the survivors.
The sure score starts from exact scores against a sample that all cells share
and rises with the lower bounds in the cell. A candidate too short to reach the
sure score of any query of a row of cells is not sent there at all. The cells'
best k are merged by a window per query.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cellwave.llm.store import cut

#: Whole numbers up to this are exact as doubles; bounds are widened by SLACK, far more than doubles round.
EXACT, SLACK = 2.0**53, 1e-9
#: Scores beyond the range of a long are that range's ends.
LEAST, MOST = -(2**63), 2**63 - 1


def largest(x: np.ndarray) -> int:
    """The largest magnitude, 1 at least."""
    return max(1, int(x.max(initial=0)), -int(x.min(initial=0)))


def query_top_k(q: np.ndarray, columns: np.ndarray, squares: np.ndarray, mass: np.ndarray, own: slice, sure: float, k: int, dims: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Positions and scores of the candidates that may be among a query's best k, and how many products were summed.

    ``columns`` is (d, n), ``squares`` its squares, ``mass`` their sums;
    candidates ``own`` are left out; ``sure`` is a score that k others reach.
    """
    d, n = columns.shape
    order = np.argsort(-np.abs(q), kind="stable")
    ahead = np.sqrt(np.append(np.cumsum(q[order[::-1]] ** 2)[::-1], 0.0)) * (1 + SLACK)
    part, left = np.zeros(n), mass * (1 + SLACK)
    part[own] = -np.inf
    alive, done = None, 0
    for s in range(0, d, dims):
        at = order[s : s + dims]
        part += q[at] @ (columns[at] if alive is None else columns[at[:, None], alive])
        done += len(at) * len(part)
        if s + dims >= d:
            break
        left -= (squares[at] if alive is None else squares[at[:, None], alive]).sum(0)
        rest = ahead[s + dims] * np.sqrt(np.maximum(left, 0.0))
        if len(part) > k:
            sure = max(sure, np.partition(part - rest, len(part) - k)[len(part) - k])
        stays = part + rest >= sure
        if 5 * np.count_nonzero(stays) < 4 * len(part):
            alive = np.flatnonzero(stays) if alive is None else alive[stays]
            part, left = part[stays], left[stays]
    real = part > -np.inf
    return (np.arange(n) if alive is None else alive)[real], part[real], done


def cell_top_k(queries: np.ndarray, query_ids: np.ndarray, sure: np.ndarray, columns: np.ndarray, ids: np.ndarray, k: int, dims: int = 8) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """The best k of a cell for each query: arrays of query id, candidate id, score; and the share of all products that was summed.

    ``queries`` is (q, d); ``columns`` is (d, n): one row a dimension; ``sure``
    is a score for each query that k candidates reach. All are whole numbers.
    Doubles are used as long as no sum can leave their exact range, else
    Python's integers and no bounds.
    """
    d, n = columns.shape
    by_id = np.argsort(ids, kind="stable")
    ids, columns = ids[by_id], columns[:, by_id]
    small = largest(queries) * largest(columns) * max(1, d) < EXACT
    if small:
        queries, columns = queries.astype(np.float64), np.ascontiguousarray(columns, np.float64)
        squares = columns**2
        mass = squares.sum(0)
    else:
        queries, columns = queries.astype(object), columns.astype(object)
    out, done = [], 0
    for q, own, least in zip(queries, query_ids.tolist(), sure.tolist()):
        mine = slice(*np.searchsorted(ids, [own, own + 1]).tolist())
        if small:
            at, score, products = query_top_k(q, columns, squares, mass, mine, least, k, dims)
            done += products
            if len(score) > 4 * k:
                high = score >= np.partition(score, len(score) - k)[len(score) - k]
                at, score = at[high], score[high]
            best = np.lexsort((at, -score))[:k]
            at, score = at[best], score[best]
        else:
            whole = [min(MOST, max(LEAST, int(x))) for x in (q @ columns if d else [0] * n)]
            done += d * n
            at = np.array(sorted((j for j in range(n) if not mine.start <= j < mine.stop), key=lambda j: (-whole[j], j))[:k], np.int64)
            score = np.array([whole[j] for j in at], np.int64)
        out.append((np.full(len(at), own), ids[at], score.astype(np.int64)))
    found = [np.concatenate([x[j] for x in out]).astype(np.int64) if out else np.zeros(0, np.int64) for j in range(3)]
    return found[0], found[1], found[2], done / max(1, d * n * len(queries))


def sample_scores(queries: np.ndarray, query_ids: np.ndarray, sample: np.ndarray, sample_ids: np.ndarray, k: int) -> np.ndarray:
    """For each query a score that k rows of the sample reach, minus infinity where the sample does not say."""
    out = np.full(len(queries), -np.inf)
    if largest(queries) * largest(sample) * max(1, queries.shape[1]) < EXACT and len(sample) > k:
        for s in range(0, len(queries), 256):
            score = queries[s : s + 256].astype(np.float64) @ sample.T.astype(np.float64)
            score[query_ids[s : s + 256, None] == sample_ids[None, :]] = -np.inf
            out[s : s + 256] = np.partition(score, len(sample) - k, axis=1)[:, len(sample) - k]
    return out


def quantise(df: DataFrame, id_col: str, vector: str, scale: int = 256) -> DataFrame:
    """vec_id, v: floor(scale * x) of every component. Vectors that are null or hold null or non-finite components are left out; a component beyond the range of a long is the end of that range."""
    v = F.col(vector)
    fit = v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    whole = F.transform(v, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("long"))
    return df.filter(F.col(id_col).isNotNull() & fit).select(F.col(id_col).cast("long").alias("vec_id"), whole.alias("v"))


def matrix(ids: pa.ChunkedArray | pa.Array, vectors: pa.ChunkedArray | pa.Array, wide: int) -> tuple[np.ndarray, np.ndarray]:
    """ids and the vectors, one row each; shorter vectors are filled up with zeros."""
    values = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
    sizes = np.diff(values.offsets.to_numpy())
    flat = values.flatten().to_numpy()
    out = np.zeros((len(sizes), wide), np.int64)
    out[np.arange(wide)[None, :] < sizes[:, None]] = flat
    return ids.to_numpy(), out


def top_k(vectors: DataFrame, is_query, k: int = 5, cell_numbers: int = 1 << 19) -> DataFrame:
    """query_id, rank, vec_id, score of each query's k best; all where there are fewer.

    ``vectors`` has vec_id and v (whole numbers). Every row counts, those with
    one vec_id too: each is a candidate for all queries of other ids, and those
    that are queries share the one list of k. Vectors of unlike length are
    filled up with zeros. Equal scores go to the smaller vec_id. A score beyond
    the range of a long is the end of that range. ``cell_numbers`` bounds the
    numbers a cell holds of its candidates, half as many of its queries; a
    sample of half as many, at most, is sent to all tasks for the first bounds.
    """
    spark = vectors.sparkSession
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    vectors = cut(vectors.select("vec_id", "v", norm.alias("norm"), F.monotonically_increasing_id().alias("row_no")), "topk")
    told = vectors.agg(F.count("*").alias("n"), F.count(F.when(is_query, 1)).alias("queries"), F.max(F.size("v")).alias("wide")).first()
    n, wide = told["n"], told["wide"] or 0
    per_cell = max(256, cell_numbers // max(1, wide))
    across, down = max(1, -(-told["queries"] // (per_cell // 2))), max(1, -(-n // per_cell))
    rows = vectors.orderBy(F.xxhash64(F.lit(3), "row_no"), "row_no").limit(per_cell // 2).select("vec_id", "v").toArrow()
    sample = spark.sparkContext.broadcast(matrix(rows.column("vec_id"), rows.column("v"), wide))

    def first_bounds(batches):
        for batch in batches:
            query_ids, q = matrix(batch.column(0), batch.column(1), wide)
            ids, c = sample.value
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sample_scores(q, query_ids, c, ids, k), pa.float64())], names=["vec_id", "v", "row_no", "norm", "sure"])

    asked = vectors.filter(is_query).select("vec_id", "v", "row_no", "norm").mapInArrow(first_bounds, "vec_id long, v array<long>, row_no long, norm double, sure double")
    asked = cut(asked.withColumn("row", F.pmod(F.xxhash64("row_no"), F.lit(across))), "topk-queries")
    # the shortest a candidate can be that matters to a query of the row of cells
    reach = F.when(F.col("sure") > 0, F.col("sure") / F.greatest("norm", F.lit(1e-300)) * (1 - SLACK)).otherwise(0.0)
    shortest = asked.groupBy("row").agg(F.min(reach).alias("_shortest"))
    columns = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(down - 1).cast("long")))
    left = asked.select("row", columns.alias("column"), "vec_id", "v", "sure")
    right = vectors.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(across - 1).cast("long"))).alias("row"), F.pmod(F.xxhash64(F.lit(7), "row_no"), F.lit(down)).alias("column"), "vec_id", "v", "norm")
    right = right.join(shortest, "row").filter(F.col("norm") >= F.col("_shortest")).select("row", "column", "vec_id", "v")

    def cell(a: pa.Table, b: pa.Table) -> pa.Table:
        query_ids, q = matrix(a.column("vec_id"), a.column("v"), wide)
        ids, c = matrix(b.column("vec_id"), b.column("v"), wide)
        who, found, score, _ = cell_top_k(q, query_ids, a.column("sure").to_numpy(), c.T, ids, k)
        return pa.table({"query_id": who, "vec_id": found, "score": score})

    near = left.groupBy("row", "column").cogroup(right.groupBy("row", "column")).applyInArrow(cell, "query_id long, vec_id long, score long")
    best = W.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return near.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op2_exact_top_k(spark, sf_dir: str) -> DataFrame:
    vectors = quantise(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "vec_id", "embedding")
    return top_k(vectors, F.col("vec_id") % 50 == 0)


OP2_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v::DOUBLE[], c.v::DOUBLE[])::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM pairs
)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM ranked WHERE rank <= 5
"""
