"""Nearest neighbours by a block matrix join: int8 product tiles with error bounds, survivors recomputed in double."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK = 2048


def usable(vector: Column) -> Column:
    """A vector that is not null, empty or zero and holds finite components alone."""
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    return F.coalesce(F.forall(vector, fine) & F.exists(vector, lambda x: x != 0), F.lit(False))


def blocks(df: DataFrame, most: int) -> DataFrame:
    """Rows of up to `most` vectors: n, dims, ids and the double vectors as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("id").to_numpy(zero_copy_only=False)
            vectors = batch.column("v")
            dims = pa.compute.list_value_length(vectors).to_numpy(zero_copy_only=False)
            for d in np.unique(dims):
                rows = np.flatnonzero(dims == d)
                for at in range(0, len(rows), most):
                    own = rows[at : at + most]
                    flat = vectors.take(pa.array(own)).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
                    yield pa.RecordBatch.from_arrays([pa.array([int(d)]), pa.array([ids[own].astype(np.int64).tobytes()], pa.binary()), pa.array([flat.tobytes()], pa.binary())], ["dims", "ids", "vectors"])

    return df.mapInArrow(run, "dims long, ids binary, vectors binary")


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes, scales, norms of the coded vectors and norms of what coding loses."""
    scale = np.abs(x).max(axis=1) / 127
    scale[scale == 0] = 1
    codes = np.rint(x / scale[:, None]).astype(np.int8)
    near = codes * scale[:, None]
    return codes, scale, np.linalg.norm(near, axis=1), np.linalg.norm(x - near, axis=1)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of paired rows in double precision, components added in order."""
    total = np.zeros(len(a))
    for k in range(a.shape[1]):
        total += a[:, k] * b[:, k]
    return total


def tile(q: np.ndarray, q_ids: np.ndarray, x: np.ndarray, x_ids: np.ndarray, top: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each query of a tile, the ids and exact products of its `top` nearest vectors there.

    Codes multiply exactly (a product of int8 codes over up to 1,000 dimensions fits a float32's integers). With q = q' + e and
    x = x' + f, |qx - q'x'| <= |q||f| + |e||x'|, so a vector whose upper bound lies under the top-th largest lower
    bound is out; the others, ties included, are recomputed.
    """
    qc, qs, qn, qe = quantise(q)
    xc, xs, xn, xe = quantise(x)
    kind = np.float32 if q.shape[1] <= 1000 else np.float64
    near = (qc.astype(kind) @ xc.astype(kind).T).astype(np.float64) * qs[:, None] * xs[None, :]
    slack = ((qn + qe)[:, None] * xe[None, :] + qe[:, None] * xn[None, :]) * (1 + 1e-9) + 1e-12 * (qn + qe)[:, None] * (xn + xe)[None, :]
    low, high = near - slack, near + slack
    own = q_ids[:, None] == x_ids[None, :]
    low[own] = high[own] = -np.inf
    least = np.partition(low, -top, axis=1)[:, -top] if low.shape[1] > top else np.full(len(q), -np.inf)
    for i in range(len(q)):
        rest = np.flatnonzero((high[i] >= least[i]) & ~own[i])
        scores = products(np.broadcast_to(q[i], (len(rest), q.shape[1])), x[rest])
        best = np.lexsort((x_ids[rest], -scores))[:top]
        yield i, x_ids[rest][best], scores[best]


def dealt(asked: DataFrame, held: DataFrame, most: int) -> DataFrame:
    """Every pair of blocks of equal dims, once: dims, q_ids, q, ids, vectors. `most` is about the number of blocks held.

    Vector blocks are dealt evenly to keys of which each hashes to a partition of its own, and query blocks are copied to
    each key. So a task joins all queries with its part of the vectors, and pairs move no further.
    """
    spark = held.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ids = spark.range(32 * parts).groupBy(F.pmod(F.hash("id"), F.lit(parts)).alias("at")).agg(F.min("id").alias("id"))
    keys = F.array(*(F.lit(r.id).cast("long") for r in ids.orderBy("at").limit(max(1, most)).collect()))
    n = min(parts, max(1, most))
    x = held.repartition(n).select(F.element_at(keys, F.spark_partition_id() % F.size(keys) + 1).alias("key"), "dims", "ids", "vectors")
    q = asked.select(F.explode(keys).alias("key"), F.col("dims").alias("q_dims"), F.col("ids").alias("q_ids"), F.col("vectors").alias("q"))
    met = q.repartition(parts, "key").hint("merge").join(x.repartition(parts, "key"), "key")
    # Written as a difference, so that the keys alone deal the rows.
    return met.where("q_dims - dims = 0").select("dims", "q_ids", "q", "ids", "vectors")


def nearest(vectors: DataFrame, queries: DataFrame, top: int = 20, block: int = BLOCK) -> DataFrame:
    """Each query's `top` rows of `vectors` of largest inner product, its own id left out: query_id, rank, vec_id, score.

    Both frames hold vec_id and embedding. Exact: every vector is in the index, and bounds only skip vectors that can't be
    among the nearest. Ties go to the smaller vec_id; vectors of another length than the query's are no candidates;
    rows without an id and vectors that are null, zero or hold null or non-finite components take no part. Of repeated
    ids each row is a candidate. Fewer candidates than `top` are all returned; an empty side gives no rows.

    Vectors travel as blocks; each block of queries meets each block of vectors once, where `dealt` joins them, and
    hands on `top` rows a query, merged by a heap for each query over its tiles' sorted lists. The exchanges carry the
    vectors twice and the queries once for each part of the vectors, of which there are as many as shuffle partitions.
    """
    clean = lambda df: df.where(F.col("vec_id").isNotNull() & usable(F.col("embedding"))).select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").alias("v"))
    pairs = dealt(blocks(clean(queries), block), blocks(clean(vectors), block), -(-vectors.count() // block))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                dims, q_ids, q, x_ids, x = (batch.column(c)[row].as_py() for c in ("dims", "q_ids", "q", "ids", "vectors"))
                q_ids, x_ids = np.frombuffer(q_ids, np.int64), np.frombuffer(x_ids, np.int64)
                found = list(tile(np.frombuffer(q).reshape(-1, dims), q_ids, np.frombuffer(x).reshape(-1, dims), x_ids, top))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([int(q_ids[i]) for i, _, _ in found], pa.int64()), pa.array([i.tolist() for _, i, _ in found], pa.list_(pa.int64())), pa.array([s.tolist() for _, _, s in found], pa.list_(pa.float64()))],
                    ["query_id", "near", "scores"],
                )

    def merge(key: tuple, lists: pd.DataFrame) -> pd.DataFrame:
        sorted_lists = [[(-s, i) for s, i in zip(scores, near, strict=True)] for scores, near in zip(lists["scores"], lists["near"], strict=True)]
        best = [x for x, _ in zip(heapq.merge(*sorted_lists), range(top), strict=False)]
        return pd.DataFrame({"query_id": key[0], "rank": np.arange(1, len(best) + 1, dtype=np.int32), "vec_id": [i for _, i in best], "score": [-s for s, _ in best]})

    tiles = pairs.mapInArrow(run, "query_id long, near array<long>, scores array<double>")
    return tiles.groupBy("query_id").applyInPandas(merge, "query_id long, rank int, vec_id long, score double")
