"""Label grids from probability maps: single-region labels with an ignored halo, pseudo-labels with sinks and a ratio guard."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evalframe.operators.regions import label_components, smooth

FOREGROUND, BACKGROUND, IGNORE = 1, 0, -100


def padded_blur(cells: DataFrame, key: str, size: int, sigma: float, height: int, width: int) -> DataFrame:
    """Gaussian blur with zeros outside the grid and wherever a cell is missing; every cell sends size * size shares. Cells that
    receive nothing are missing; sigma <= 0 leaves cells as they are."""
    if sigma <= 0:
        return cells.select(key, "r", "c", "p")
    half = size // 2
    one = [math.exp(-(i * i) / (2 * sigma * sigma)) for i in range(-half, half + 1)]
    steps = [F.struct(F.lit(i - half).alias("i"), F.lit(j - half).alias("j"), F.lit(one[i] * one[j] / sum(one) ** 2).alias("w")) for i in range(size) for j in range(size)]
    sent = cells.select(key, "r", "c", "p", F.explode(F.array(*steps)).alias("o"))
    at = sent.select(key, (F.col("r") + F.col("o.i")).alias("r"), (F.col("c") + F.col("o.j")).alias("c"), (F.col("p") * F.col("o.w")).alias("p"))
    return at.where((F.col("r") >= 0) & (F.col("r") < height) & (F.col("c") >= 0) & (F.col("c") < width)).groupBy(key, "r", "c").agg(F.sum("p").alias("p"))


def single_region_labels(maps: DataFrame, key: str, token: str, height: int, width: int, skip: int = 5, ratio: float = 3.0, fraction: float = 0.3, sigma: float = 0.0, halo_sigma: float = 1.0, halo: float = 0.3, ignore_empty: bool = True) -> DataFrame:
    """(key, r, c, label) of whole grids from maps (key, token, r, c, p) of tokens numbered from 0.

    A token's map, from `skip` on, is divided by its peak and blurred (5 by 5). It survives if its peak is `ratio` times
    its mean or more and its cells over `fraction` of the peak touch, corners included, as one region. The survivors'
    union is 1; cells where the blurred union exceeds `halo` of its largest value are -100 around it; others are 0.
    A key without survivors is -100 throughout (0 if `ignore_empty` is off).
    """
    each = F.struct(key, token)
    w = Window.partitionBy("map")
    late = maps.where(F.col(token) >= skip).select(each.alias("map"), "r", "c", F.col("p").cast("double").alias("p"))
    even = late.withColumn("p", F.col("p") / F.greatest(F.max("p").over(w), F.lit(1e-12)))
    even = padded_blur(even, "map", 5, sigma, height, width)
    gated = even.withColumn("peak", F.max("p").over(w)).withColumn("mean", F.sum("p").over(w) / (height * width))
    kept = gated.where((F.col("peak") / (F.col("mean") + 1e-8) >= ratio) & (F.col("p") > F.col("peak") * fraction)).select("map", "r", "c")
    labelled = label_components(kept, "map", True)
    one = labelled.withColumn("parts", F.max("comp").over(w)).where("parts = 1")
    union = one.select(F.col(f"map.{key}").alias(key), "r", "c").distinct().withColumn("p", F.lit(1.0))
    spread = padded_blur(union, key, 5, halo_sigma, height, width)
    near = spread.withColumn("near", F.col("p") > halo * F.max("p").over(Window.partitionBy(key))).where("near").select(key, "r", "c", "near")
    places = F.explode(F.expr(f"transform(sequence(0, {height * width - 1}), i -> struct(int(i div {width}) as r, int(i % {width}) as c))"))
    whole = maps.select(key).distinct().select(key, places.alias("o")).select(key, "o.r", "o.c")
    met = whole.join(union.select(key, "r", "c", F.lit(True).alias("hit")), [key, "r", "c"], "left").join(near, [key, "r", "c"], "left")
    some = F.max("hit").over(Window.partitionBy(key))
    label = F.when(some.isNull(), IGNORE if ignore_empty else BACKGROUND).when(F.col("hit"), FOREGROUND).when(F.col("near"), IGNORE).otherwise(BACKGROUND)
    return met.select(key, "r", "c", label.alias("label"))


def letter_box(width: Column, height: Column, side: int, least: int = 1) -> Column:
    """The half-open box (r1, c1, r2, c2) that an image of this size fills in a square of `side`, its longer side fitted and the
    shorter one padded on both sides, the odd cell after it. Null for sizes that aren't positive."""
    longest = F.greatest(width, height).cast("double")
    fit = lambda x: F.greatest((x.cast("double") / longest * side).cast("int"), F.lit(least))
    h, w = fit(height), fit(width)
    before, after = (lambda x: F.floor((side - x) / 2).cast("int")), (lambda x: F.least(x + F.ceil((side - x) / 2).cast("int"), F.lit(side)))
    box = lambda r1, c1, r2, c2: F.struct(r1.alias("r1"), c1.alias("c1"), r2.alias("r2"), c2.alias("c2"))
    zero, full = F.lit(0), F.lit(side)
    return F.when((width > 0) & (height > 0), F.when(w > h, box(before(h), zero, after(h), w)).when(h > w, box(zero, before(w), h, after(w))).otherwise(box(zero, zero, full, full)))


def pseudo_labels(cells: DataFrame, key: str, height: int, width: int, known: Column | None = None, sink: float = 1e-2, strong: float = 0.2, weak: float = 0.1, most: float = 0.5, blur: int = 3, smoothing: bool = False) -> DataFrame:
    """Adds label (1, 0 or -100) to whole grids (key, r, c, sink, p).

    Sinks (`sink` at the bound or more, or outside the `known` box of struct r1, c1, r2, c2) lose their p. What is then over
    `strong` of the key's largest value is foreground. Its box, wider by half the blur's size, leaves the cells outside
    it as candidates; those with p (0 at sinks by bound) under `weak` of the largest value are background, and so is
    all outside the known box. A key is -100 throughout if the box fills `most` of the grid or more or the largest value is
    under 0.005. With `smoothing`, foreground must also pass the mean of both bounds in a 5 by 5 blur.
    """
    w = Window.partitionBy(key)
    inside = F.lit(True) if known is None else (F.col("r") >= known["r1"]) & (F.col("r") < known["r2"]) & (F.col("c") >= known["c1"]) & (F.col("c") < known["c2"])
    rows = cells.withColumn("__in", inside).withColumn("__low", F.col("sink") < sink)
    rows = rows.withColumn("__g", F.when(F.col("__in") & F.col("__low"), F.col("p").cast("double")).otherwise(0.0))
    if smoothing:
        soft = smooth(rows.select(key, "r", "c", F.col("__g").alias("p")), key, 5, 1.0, height, width).withColumnRenamed("p", "__soft")
        rows = rows.join(soft, [key, "r", "c"])
        rows = rows.withColumn("__g", F.when(F.col("__soft") > F.max("__soft").over(w) * (strong + weak) / 2, F.col("__g")).otherwise(0.0))
    rows = rows.withColumn("__g", F.when(F.col("__g") > F.max("__g").over(w) * strong, F.col("__g")).otherwise(0.0))
    fg, half = F.col("__g") > 0, blur // 2
    edge = lambda f, c: f(F.when(fg, F.col(c))).over(w)
    rows = rows.withColumns({
        "__top": F.max("__g").over(w),
        "__r1": F.coalesce(F.greatest(edge(F.min, "r") - half, F.lit(0)), F.lit(0)), "__c1": F.coalesce(F.greatest(edge(F.min, "c") - half, F.lit(0)), F.lit(0)),
        "__r2": F.coalesce(F.least(edge(F.max, "r") + half, F.lit(height - 1)), F.lit(height - 1)), "__c2": F.coalesce(F.least(edge(F.max, "c") + half, F.lit(width - 1)), F.lit(width - 1)),
    })
    boxed = F.col("r").between(F.col("__r1"), F.col("__r2")) & F.col("c").between(F.col("__c1"), F.col("__c2"))
    faint = F.when(F.col("__low"), F.col("p").cast("double")).otherwise(0.0) < F.col("__top") * weak
    usable = ((F.col("__c2") - F.col("__c1") + 1) * (F.col("__r2") - F.col("__r1") + 1) < most * height * width) & (F.col("__top") >= 5e-3)
    label = F.when(~usable, IGNORE).when(fg, FOREGROUND).when((~boxed & faint) | ~F.col("__in"), BACKGROUND).otherwise(IGNORE)
    return rows.select(*cells.columns, label.alias("label"))
