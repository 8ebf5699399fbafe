"""Bootstrap resamples of exactly n draws with replacement, split over buckets of rows, and their statistics."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rounds that share a seed; the most rounds for statistics that are dear to recompute; distinct rows in a bucket, about.
CHUNK, FEW, BUCKET = 1000, {"bleu": 100, "chrf": 100, "ter": 100}, 4096


def rounds_of(metric: str, asked: int) -> int:
    """The rounds that a metric gets: at most FEW's, and whole chunks only."""
    least = min(asked, FEW.get(metric, asked))
    size = min(CHUNK, least)
    return least // size * size if size else 0


def node_draws(path: list[int], bucket: int, drawn: int, rounds: int, seed: list[int]) -> np.ndarray:
    """How many of `drawn` draws fall to a bucket in each round. `path` holds the rows of each node from the root down to the bucket; a
    node deals its draws to its halves by a binomial whose seed names the node, so all buckets below agree on it."""
    n, depth = np.full(rounds, drawn, dtype=np.int64), len(path) - 1
    for level in range(depth):
        node = bucket >> (depth - level)
        right = bucket >> (depth - level - 1) & 1
        left_rows = path[level] - path[level + 1] if right else path[level + 1]
        left = np.random.default_rng([*seed, level, node]).binomial(n, left_rows / path[level])
        n = n - left if right else left
    return n


def row_sums(n: np.ndarray, times: np.ndarray, values: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """For each round, the sums of values over n draws from rows that stand for `times` rows each."""
    out = np.zeros((len(n), values.shape[1]))
    if times.sum() * 4 < len(times) * 5 and len(times) > 64:
        # Hardly any repeats: a draw picks a place, rounds in turn.
        rows = np.repeat(np.arange(len(times)), times)
        step = max(1, 1_000_000 // max(1, int(n.max(initial=0))))
        for at in range(0, len(n), step):
            m = n[at : at + step]
            some = np.flatnonzero(m)
            if len(some):
                picked = values[rows[rng.integers(0, len(rows), int(m.sum()))]]
                out[at + some] = np.add.reduceat(picked, np.concatenate([[0], np.cumsum(m[some])[:-1]]), axis=0)
        return out
    step = max(1, 2_000_000 // len(times))
    for at in range(0, len(n), step):
        out[at : at + step] = rng.multinomial(n[at : at + step], times / times.sum()) @ values
    return out


def resampled(df: DataFrame, group: str, values: Sequence[str], rounds: int, seed: int = 0) -> DataFrame:
    """(group, round, n, values): for rounds 1 .. `rounds` of each group, n rows drawn with replacement from its n rows, summed.

    Rows with a null value are left out; a null group is a group. Equal rows count once with their number, so a metric of few
    values is drawn in one step. Distinct rows are dealt to 2**k buckets by hash; a bucket learns its share of each
    round's draws from k binomials, and no row is repeated by round. Rounds go in chunks with a seed each. Sums of a
    round meet by (group, round), added up before the exchange. Results depend on the rows and the seed alone.
    """
    names = list(values)
    plain = df.select(F.col(group).alias("g"), *[F.col(v).cast("double").alias(f"v{i}") for i, v in enumerate(names)]).dropna(subset=[f"v{i}" for i in range(len(names))])
    v = [f"v{i}" for i in range(len(names))]
    rows = plain.groupBy("g", *v).agg(F.count(F.lit(1)).alias("times"))
    # The widest group's distinct rows set the number of buckets of all groups: one number.
    widest = rows.groupBy("g").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 1
    depth = max(0, (-(-widest // BUCKET) - 1).bit_length())
    dealt = rows.withColumn("b", F.pmod(F.xxhash64(F.lit("bucket"), *v), F.lit(2**depth)).cast("int"))
    held = dealt.groupBy("g", "b").agg(F.array_sort(F.collect_list(F.struct(*v, "times"))).alias("rows"), F.sum("times").alias("own"))
    for level in range(depth + 1):
        held = held.withColumn(f"w{level}", F.sum("own").over(Window.partitionBy("g", F.shiftright("b", depth - level))))
    size = min(CHUNK, rounds)
    chunks = held.withColumn("path", F.array(*[f"w{i}" for i in range(depth + 1)])).select("g", "b", "rows", "path", F.xxhash64("g").alias("h"), F.explode(F.sequence(F.lit(0), F.lit(rounds // size - 1))).alias("chunk"))

    def draw(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for r in frame.itertuples():
                data = np.array([[x[k] for k in (*v, "times")] for x in r.rows], dtype=np.float64)
                named = [seed, r.h & 0xFFFFFFFFFFFFFFFF, r.chunk]
                n = node_draws([int(x) for x in r.path], r.b, int(r.path[0]), size, named)
                sums = row_sums(n, data[:, -1].astype(np.int64), data[:, :-1], np.random.default_rng([*named, 1 << 20, r.b]))
                yield pd.DataFrame({"g": [r.g] * size, "round": np.arange(size) + r.chunk * size + 1, "n": n} | {k: sums[:, i] for i, k in enumerate(v)})

    kind = df.select(group).schema[0].dataType.simpleString()
    parts = chunks.repartition("g", "b", "chunk").mapInPandas(draw, f"g {kind}, round long, n long, {', '.join(f'{k} double' for k in v)}")
    whole = parts.groupBy("g", "round").agg(F.sum("n").alias("n"), *[F.sum(k).alias(k) for k in v])
    return whole.select(F.col("g").alias(group), "round", "n", *[F.col(k).alias(name) for k, name in zip(v, names, strict=True)])


def bootstrap(df: DataFrame, group: str, values: Sequence[str], statistic: Column, rounds: int, seed: int = 0, interval: float = 0.95) -> DataFrame:
    """(group, stderr, low, high): the sample deviation and the interval of a statistic of the sums of `values` (and of n) over resamples."""
    each = resampled(df, group, values, rounds, seed).select(group, statistic.alias("s"))
    tail = (1 - interval) / 2
    return each.groupBy(group).agg(F.stddev_samp("s").alias("stderr"), F.percentile("s", F.lit(tail)).alias("low"), F.percentile("s", F.lit(1 - tail)).alias("high"))
