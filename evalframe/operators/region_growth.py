"""Greedy merging of regions across layers, and growth of placebo regions; a task works on many keys at once, each key's cells whole."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evalframe.operators.regions import neighbours, overlaps, roots, whole_maps
from evalframe.sources.io import durable

#: Neighbours in the order in which a region grows into them: down, up, right, left.
STEPS = ((1, 0), (-1, 0), (0, 1), (0, -1))


def seeds(ranks: DataFrame, pairs: DataFrame, key: str) -> DataFrame:
    """(key, rank, seed): which ranks a greedy pass in rank order starts a cluster from; `pairs` (key, lo, hi) says which ranks join.

    A rank is a seed unless a lower one that it pairs with is. A key's ranks and pairs are gathered and passed once.
    """
    kinds = ranks.select(key, "rank").schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            told = []
            for ranked, joined in zip(batch.column("ranks").to_pylist(), batch.column("pairs").to_pylist(), strict=True):
                below, first = defaultdict(list), set()
                for p in joined or ():
                    below[p["hi"]].append(p["lo"])
                for rank in sorted(ranked):
                    if first.isdisjoint(below[rank]):
                        first.add(rank)
                told.append([rank in first for rank in ranked])
            rows = pc.list_parent_indices(batch.column("ranks"))
            seed = pa.array([x for t in told for x in t], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("key").take(rows), batch.column("ranks").flatten(), seed], ["key", "rank", "seed"])

    every = ranks.groupBy(F.col(key).alias("key")).agg(F.collect_list("rank").alias("ranks"))
    joins = pairs.groupBy(F.col(key).alias("key")).agg(F.collect_list(F.struct("lo", "hi")).alias("pairs"))
    out = T.StructType([T.StructField("key", kinds[key].dataType), kinds["rank"], T.StructField("seed", T.BooleanType())])
    return every.join(joins, "key", "left").mapInArrow(run, out).withColumnRenamed("key", key)


def merged_layers(cells: DataFrame, key: str, layer: str, comp: str, iou: float, layers: int, top: int, least_area: int = 1) -> tuple[DataFrame, DataFrame]:
    """(regions, cells) of a key's regions merged across layers: (key, region, area, votes, weight) and (key, region, r, c).

    Regions of `least_area` cells or more come by area, descending, then by layer and number. The first that is left takes all later
    ones left that it overlaps by more than `iou` of their union. A cluster keeps the cells that half of its members
    or more have, or all cells if none is such; its votes are its members' layers, its weight votes / layers. The
    `top` largest stay, numbered from 1; of equal areas the earlier cluster comes first.
    """
    area = cells.groupBy(key, layer, comp).agg(F.count(F.lit(1)).alias("area")).where(F.col("area") >= least_area)
    order = Window.partitionBy(key).orderBy(F.desc("area"), layer, comp)
    ranks = durable(area.withColumn("rank", F.row_number().over(order)))
    side = lambda s, rank: ranks.select(key, F.col(layer).alias(f"{s}_layer"), F.col(comp).alias(s), F.col("rank").alias(rank))
    met = overlaps(cells, key, layer, comp, iou).join(side("a", "x"), [key, "a_layer", "a"]).join(side("b", "y"), [key, "b_layer", "b"])
    pairs = durable(met.select(key, F.least("x", "y").alias("lo"), F.greatest("x", "y").alias("hi")))
    state = seeds(ranks, pairs, key)
    first = pairs.join(state.where("seed").select(key, F.col("rank").alias("lo")), [key, "lo"]).groupBy(key, F.col("hi").alias("rank")).agg(F.min("lo").alias("of"))
    cluster = state.join(first, [key, "rank"], "left").select(key, "rank", F.when(F.col("seed"), F.col("rank")).otherwise(F.col("of")).alias("of"))
    members = durable(ranks.join(cluster, [key, "rank"]).select(key, layer, comp, "of"))
    sizes = members.groupBy(key, "of").agg(F.count(F.lit(1)).alias("members"), F.count_distinct(layer).alias("votes"))
    held = cells.join(members, [key, layer, comp]).groupBy(key, "of", "r", "c").agg(F.count(F.lit(1)).alias("n")).join(sizes, [key, "of"])
    held = held.withColumn("half", 2 * F.col("n") >= F.col("members")).withColumn("some", F.max("half").over(Window.partitionBy(key, "of")))
    kept = durable(held.where("half or not some").select(key, "of", "r", "c", "votes"))
    found = kept.groupBy(key, "of").agg(F.count(F.lit(1)).alias("area"), F.first("votes").alias("votes"))
    found = found.withColumn("region", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("area"), "of"))).where(F.col("region") <= top)
    regions = found.select(key, "region", "area", "votes", (F.col("votes") / layers).alias("weight"))
    return regions, kept.join(found.select(key, "of", "region"), [key, "of"]).select(key, "region", "r", "c")


def beside(cells: DataFrame, key: str, *more: str) -> DataFrame:
    """Each cell's four neighbours as r and c, with `step` their place in STEPS and the columns `more`."""
    steps = F.array(*[F.struct(F.lit(k).alias("step"), F.lit(i).alias("i"), F.lit(j).alias("j")) for k, (i, j) in enumerate(STEPS)])
    sent = cells.select(key, "r", "c", *more, F.explode(steps).alias("o"))
    return sent.select(key, (F.col("r") + F.col("o.i")).alias("r"), (F.col("c") + F.col("o.j")).alias("c"), "o.step", *more)


def grown(row: np.ndarray, beside: np.ndarray, starts: np.ndarray, area: int) -> np.ndarray:
    """The first `area` places of each map in breadth-first order from its start, neighbours in the order of `beside` (-1: none).
    One round for each distance from the start, all maps at once."""
    taken, have = np.zeros(len(row), bool), np.bincount(row[starts], minlength=row.max(initial=-1) + 1)
    taken[starts] = True
    edge = starts
    while len(edge):
        met = beside[edge].reshape(-1)
        met = met[met >= 0]
        met = met[~taken[met]]
        # The first to reach a place puts it there; maps follow one another, so a place's number in its map is told by a count.
        met = met[np.sort(np.unique(met, return_index=True)[1])]
        met = met[np.argsort(row[met], kind="stable")]
        at = np.arange(len(met)) - np.searchsorted(row[met], row[met])
        edge = met[have[row[met]] + at < area]
        taken[edge] = True
        have += np.bincount(row[edge], minlength=len(have))
    return np.flatnonzero(taken)


def placebo_blobs(cells: DataFrame, exclude: DataFrame, key: str, area: int, blobs: int, below: float, draw: Callable[[int], Column]) -> DataFrame:
    """(key, blob, r, c): up to `blobs` connected regions of exactly `area` cells each, apart from each other, in the zone where p is
    under `below` and neither the cell nor a cell beside it is excluded.

    `draw(blob)` is a number by cell: the blob grows from the cell with the least one (then by row and column) from which it can
    reach its size. A key whose zone has fewer than area * blobs cells has none; one that can't host another blob ends.
    """
    near = exclude.select(key, "r", "c").union(beside(exclude, key).select(key, "r", "c"))
    zone = cells.where(F.col("p") < below).select(key, "r", "c").join(near, [key, "r", "c"], "left_anti")
    draws = [draw(blob).alias(f"d{blob}") for blob in range(1, blobs + 1)]
    maps = zone.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("key")).agg(F.sort_array(F.collect_list(F.struct("r", "c", *draws))).alias("cells"))
    kinds = cells.select(key, "r", "c").schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, row, cell in whole_maps(batch, "cells"):
                r, c = (cell.field(x).to_numpy().astype(np.int64) for x in ("r", "c"))
                for blob in range(1, blobs + 1):
                    beside = neighbours(row, r, c, STEPS)
                    root = roots(beside)
                    large = np.flatnonzero(np.bincount(root, minlength=len(root))[root] >= area)
                    # Cells come by row and column, and so do those with the same draw.
                    large = large[np.lexsort((large, cell.field(f"d{blob}").to_numpy()[large], row[large]))]
                    made = grown(row, beside, large[np.unique(row[large], return_index=True)[1]], area)
                    picked = pa.array(made)
                    yield pa.RecordBatch.from_arrays([part.column("key").take(pa.array(row[made])), pa.array(np.full(len(made), blob, np.int32)), cell.field("r").take(picked), cell.field("c").take(picked)], ["key", "blob", "r", "c"])
                    left = np.ones(len(row), bool)
                    left[made] = False
                    row, r, c, cell = row[left], r[left], c[left], cell.filter(pa.array(left))

    out = T.StructType([T.StructField("key", kinds[key].dataType), T.StructField("blob", T.IntegerType()), kinds["r"], kinds["c"]])
    return maps.where(F.size("cells") >= area * blobs).mapInArrow(run, out).withColumnRenamed("key", key)
