"""Region tables: cells of probability maps, their components and removal actions."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def grid(df: DataFrame, key: str, values: str, width: int) -> DataFrame:
    """(key, r, c, p): a flat array as cells of rows of `width`."""
    cells = df.select(key, F.posexplode(values).alias("i", "p"))
    return cells.select(key, F.floor(F.col("i") / width).cast("int").alias("r"), F.pmod("i", F.lit(width)).cast("int").alias("c"), F.col("p").cast("double").alias("p"))


def smooth(cells: DataFrame, key: str, size: int, sigma: float, height: int, width: int) -> DataFrame:
    """Gaussian smoothing with reflected edges; size <= 1 or sigma <= 0 leaves cells as they are. Each cell sends size * size shares."""
    if size <= 1 or sigma <= 0:
        return cells
    half = size // 2
    spread = F.exp(-(F.col("dr") ** 2 + F.col("dc") ** 2) / (2 * sigma * sigma))
    whole = sum(2.718281828459045 ** (-(i * i + j * j) / (2 * sigma * sigma)) for i in range(-half, half + 1) for j in range(-half, half + 1))
    steps = F.array(*[F.struct(F.lit(i).alias("dr"), F.lit(j).alias("dc")) for i in range(-half, half + 1) for j in range(-half, half + 1)])
    asked = cells.select(key, "r", "c", F.explode(steps).alias("o")).select(key, "r", "c", "o.*")
    back = lambda x, n: F.when(x < 0, -x).when(x >= n, 2 * (n - 1) - x).otherwise(x)
    at = asked.select(key, F.col("r").alias("r0"), F.col("c").alias("c0"), back(F.col("r") + F.col("dr"), height).alias("r"), back(F.col("c") + F.col("dc"), width).alias("c"), (spread / whole).alias("w"))
    met = at.join(cells, [key, "r", "c"])
    return met.groupBy(key, F.col("r0").alias("r"), F.col("c0").alias("c")).agg(F.sum(F.col("w") * F.col("p")).alias("p"))


def peak_gate(cells: DataFrame, key: str, ratio: float, least_peak: float | None = None, least_ratio: float | None = None) -> DataFrame:
    """Cells at `ratio` of their map's peak or more; maps under a least peak or a least peak-to-mean ratio, if given, have none."""
    w = Window.partitionBy(key)
    rows = cells.withColumn("peak", F.max("p").over(w)).withColumn("mean", F.avg("p").over(w))
    kept = rows.where(F.col("p") >= ratio * F.col("peak"))
    kept = kept if least_peak is None else kept.where(F.col("peak") >= least_peak)
    kept = kept if least_ratio is None else kept.where(F.col("peak") >= least_ratio * F.col("mean"))
    return kept.drop("peak", "mean")


#: Cells that a Python worker takes at a time; a larger map stands alone.
CELLS = 1_000_000


def whole_maps(batch: pa.RecordBatch, column: str, most: int = CELLS) -> Iterator[tuple[pa.RecordBatch, np.ndarray, pa.StructArray]]:
    """Row ranges of a batch of maps with about `most` cells each: the rows, each cell's row in them, and the cells."""
    sizes, first = pc.list_value_length(batch.column(column)).to_numpy(zero_copy_only=False), 0
    cuts = np.flatnonzero(np.diff(np.cumsum(sizes) // most)) + 1
    for end in [*cuts.tolist(), batch.num_rows]:
        if end > first:
            part = batch.slice(first, end - first)
            yield part, np.repeat(np.arange(end - first), sizes[first:end]), part.column(column).flatten()
        first = end


def neighbours(row: np.ndarray, r: np.ndarray, c: np.ndarray, steps: Sequence[tuple[int, int]]) -> np.ndarray:
    """For each cell and step the place of the cell there in the same map, -1 if there is none. No two cells of a map are the same."""
    rs, cs = np.unique(r), np.unique(c)
    n, m = max(len(rs), 1), max(len(cs), 1)
    code = (row * n + np.searchsorted(rs, r)) * m + np.searchsorted(cs, c)
    order = np.argsort(code, kind="stable")
    have = code[order]
    out = np.full((len(code), len(steps)), -1)
    for k, (i, j) in enumerate(steps):
        x, y = np.searchsorted(rs, r + i).clip(max=n - 1), np.searchsorted(cs, c + j).clip(max=m - 1)
        want = (row * n + x) * m + y
        at = np.searchsorted(have, want).clip(max=max(len(have) - 1, 0))
        met = (rs[x] == r + i) & (cs[y] == c + j) & (have[at] == want) if len(have) else np.zeros(0, bool)
        out[met, k] = order[at[met]]
    return out


def roots(beside: np.ndarray) -> np.ndarray:
    """The first place that each place reaches over neighbours (-1: none): smallest labels spread, and labels of labels."""
    a, k = np.nonzero(beside >= 0)
    b = beside[a, k]
    root = np.arange(len(beside))
    while True:
        low = np.minimum(root[a], root[b])
        up = root.copy()
        np.minimum.at(up, root[a], low)
        np.minimum.at(up, root[b], low)
        while not np.array_equal(up, up[up]):
            up = up[up]
        if np.array_equal(up, root):
            return root
        root = up


def label_components(cells: DataFrame, key: str, diagonal: bool = False) -> DataFrame:
    """Adds comp: connected components numbered from 1 by their first cell in row order. Cells are dealt out by map once; a
    task labels many maps together, each cell once. Cells without a key or a place take no part."""
    steps = [(0, 1), (1, 0)] + [(1, 1), (1, -1)] * diagonal
    kinds = cells.select(key, "r", "c").schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, row, cell in whole_maps(batch, "cells"):
                # In order of maps, rows and columns, a component's first place is its first cell.
                r, c = (cell.field(x).to_numpy().astype(np.int64) for x in ("r", "c"))
                root = roots(neighbours(row, r, c, steps))
                number = np.cumsum(root == np.arange(len(root)))
                before = np.searchsorted(row, np.arange(part.num_rows))
                comp = number[root] - (number[before] - 1)[row] if len(row) else number
                yield pa.RecordBatch.from_arrays([part.column("key").take(pa.array(row)), cell.field("r"), cell.field("c"), pa.array(comp.astype(np.int32))], ["key", "r", "c", "comp"])

    maps = cells.where(F.col(key).isNotNull() & F.col("r").isNotNull() & F.col("c").isNotNull()).groupBy(F.col(key).alias("key"))
    maps = maps.agg(F.sort_array(F.collect_set(F.struct("r", "c"))).alias("cells"))
    out = T.StructType([T.StructField("key", kinds[key].dataType), kinds["r"], kinds["c"], T.StructField("comp", T.IntegerType())])
    return maps.mapInArrow(run, out).withColumnRenamed("key", key)


def component_stats(cells: DataFrame, key: str, top: float, n_cells: int | None = None, beta: float = 0.0, gamma: float = 0.0) -> DataFrame:
    """(key, comp, area, half-open box, score): the score is the mean of the top share of p, one cell at least, less
    beta * max(0, area / n_cells - gamma)."""
    w = Window.partitionBy(key, "comp")
    ranked = cells.withColumn("n", F.count(F.lit(1)).over(w)).withColumn("k", F.row_number().over(w.orderBy(F.desc("p"), "r", "c")))
    high = F.avg(F.when(F.col("k") <= F.greatest(F.lit(1), F.bround(top * F.col("n")).cast("int")), F.col("p")))
    penalty = F.lit(0.0) if n_cells is None else beta * F.greatest(F.lit(0.0), F.count(F.lit(1)) / n_cells - gamma)
    return ranked.groupBy(key, "comp").agg(F.count(F.lit(1)).alias("area"), F.min("r").alias("r1"), F.min("c").alias("c1"), (F.max("r") + 1).alias("r2"), (F.max("c") + 1).alias("c2"), (high - penalty).alias("score"))


def removal_actions(components: DataFrame, key: str, comp: str) -> DataFrame:
    """(key, discard): nothing, each one (of two or more), each pair (of three or more); never all."""
    n = components.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    none = n.select(key, F.array().cast("array<int>").alias("discard"))
    own = components.select(key, F.col(comp).cast("int").alias("i")).join(n, key)
    one = own.where("n > 1").select(key, F.array("i").alias("discard"))
    other = components.select(key, F.col(comp).cast("int").alias("j"))
    two = own.where("n > 2").join(other, key).where("i < j").select(key, F.array("i", "j").alias("discard"))
    return none.union(one).union(two)


def overlaps(cells: DataFrame, key: str, layer: str, comp: str, least: float) -> DataFrame:
    """(key, a_layer, a, b_layer, b, iou): regions of two layers of a key whose cells overlap by more than `least` of their union.

    Cells meet by place, so the work is in proportion to the layers that hold a cell; pairs that share none never arise.
    """
    area = cells.groupBy(key, layer, comp).agg(F.count(F.lit(1)).alias("area"))
    left = cells.select(key, "r", "c", F.col(layer).alias("a_layer"), F.col(comp).alias("a"))
    right = cells.select(key, "r", "c", F.col(layer).alias("b_layer"), F.col(comp).alias("b"))
    shared = left.join(right, [key, "r", "c"]).where("a_layer < b_layer").groupBy(key, "a_layer", "a", "b_layer", "b").agg(F.count(F.lit(1)).alias("n"))
    of = lambda side: area.select(key, F.col(layer).alias(f"{side}_layer"), F.col(comp).alias(side), F.col("area").alias(f"{side}_area"))
    met = shared.join(of("a"), [key, "a_layer", "a"]).join(of("b"), [key, "b_layer", "b"])
    iou = F.col("n") / (F.col("a_area") + F.col("b_area") - F.col("n"))
    return met.select(key, "a_layer", "a", "b_layer", "b", iou.alias("iou")).where(F.col("iou") > least)


def voted(cells: DataFrame, key: str, layer: str, votes: int) -> DataFrame:
    """Cells (key, r, c) that at least `votes` layers hold."""
    return cells.groupBy(key, "r", "c").agg(F.count_distinct(layer).alias("n")).where(F.col("n") >= votes).drop("n")


def dilated(cells: DataFrame, key: str, size: int, height: int, width: int) -> DataFrame:
    """Cells within size // 2 rows and columns of one given, inside the grid."""
    half = size // 2
    steps = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in range(-half, half + 1) for j in range(-half, half + 1)])
    near = cells.select(key, "r", "c", F.explode(steps).alias("o")).select(key, (F.col("r") + F.col("o.i")).alias("r"), (F.col("c") + F.col("o.j")).alias("c"))
    return near.where((F.col("r") >= 0) & (F.col("r") < height) & (F.col("c") >= 0) & (F.col("c") < width)).distinct()


def vote_gate(cells: DataFrame, key: str, comp: str, votes: DataFrame) -> DataFrame:
    """A region's voted cells; all of them where none is voted."""
    marked = cells.join(votes.select(key, "r", "c").distinct().withColumn("__v", F.lit(True)), [key, "r", "c"], "left")
    marked = marked.withColumn("__some", F.max("__v").over(Window.partitionBy(key, comp)))
    return marked.where(F.col("__v") | F.col("__some").isNull()).drop("__v", "__some")


def outside(cells: DataFrame, other: DataFrame, key: str) -> DataFrame:
    """Cells that the other table lacks."""
    return cells.join(other.select(key, "r", "c"), [key, "r", "c"], "left_anti")


def bounding_boxes(keys: DataFrame, cells: DataFrame, key: str, height: int, width: int) -> DataFrame:
    """(key, r1, c1, r2, c2), half open; the whole grid for a key without cells."""
    box = cells.groupBy(key).agg(F.min("r").alias("r1"), F.min("c").alias("c1"), (F.max("r") + 1).alias("r2"), (F.max("c") + 1).alias("c2"))
    whole = {"r1": 0, "c1": 0, "r2": height, "c2": width}
    return keys.select(key).distinct().join(box, key, "left").select(key, *[F.coalesce(c, F.lit(v)).alias(c) for c, v in whole.items()])


def resampled(cells: DataFrame, key: str, source: tuple[int, int], target: tuple[int, int]) -> DataFrame:
    """Cells on another grid: each takes the value of the nearest source cell, floor(place * source / target)."""
    rows = cells.sparkSession.range(target[0] * target[1]).select(F.expr(f"int(id div {target[1]})").alias("r2"), F.expr(f"int(id % {target[1]})").alias("c2"))
    asked = rows.select("r2", "c2", F.expr(f"int(r2 * {source[0]} div {target[0]})").alias("r"), F.expr(f"int(c2 * {source[1]} div {target[1]})").alias("c"))
    met = cells.join(F.broadcast(asked), ["r", "c"])  # One row a cell of the target grid.
    return met.select(key, F.col("r2").alias("r"), F.col("c2").alias("c"), "p")


def rounded(df: DataFrame, digits: int = 4) -> DataFrame:
    """Every float of a record, however deep in structs, arrays and map values, rounded."""

    def walk(c, kind):
        if isinstance(kind, (T.DoubleType, T.FloatType)):
            return F.round(c, digits)
        if isinstance(kind, T.ArrayType):
            return F.transform(c, lambda x: walk(x, kind.elementType))
        if isinstance(kind, T.StructType):
            return F.when(c.isNotNull(), F.struct(*[walk(c[f.name], f.dataType).alias(f.name) for f in kind.fields]))
        if isinstance(kind, T.MapType):
            return F.transform_values(c, lambda k, v: walk(v, kind.valueType))
        return c

    return df.select(*[walk(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema.fields])


def sample_dump(regions: DataFrame, actions: DataFrame, key: str) -> DataFrame:
    """One nested record for each key: its regions by number and its actions in order, empty lists where there are none."""
    listed = lambda df, order, name: df.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(order, *[c for c in df.columns if c not in (key, order)]))).alias(name))
    met = listed(regions, "comp", "regions").join(listed(actions, "discard", "actions"), key, "full")
    return met.select(key, F.coalesce("regions", F.array()).alias("regions"), F.coalesce("actions", F.array()).alias("actions"))
