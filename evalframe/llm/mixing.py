"""Mixing sources to target weights by entropy balancing. DataFrame and SQL functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evalframe.llm.common import WORD, durable

#: No row is taken more often than this; targets stop at so many times their source's size.
CAP = 3
#: Fixed-point units of a rate's fraction: sums of integers don't depend on the order of rows.
UNITS = 2**24


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """(source, source_size, target) from (source, size, n): shares by repeating weights over sources in code-point order,
    null last. A target over CAP times its source's size stops there and the excess is shared anew by weight.

    Sources that stop do so in order of cap over weight, so the level where it ends is found by running sums; these
    windows see one row for each source.
    """
    by = sizes.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(order) - 1) % len(weights)
    by = by.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), turn + 1).cast("double")).withColumn("cap", CAP * F.col("source_size").cast("double"))
    rising = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    all_rows = rising.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    stopped = F.coalesce(F.sum("cap").over(rising.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    left = F.sum("weight").over(rising.rowsBetween(0, Window.unboundedFollowing))
    total = F.sum("source_size").over(all_rows)
    level = by.withColumn("level", (total - stopped) / left)
    # Sources stop while the level exceeds their cap over weight; the first that doesn't sets the level for the rest.
    level = level.withColumn("at", F.first(F.when(F.col("level") <= F.col("cap") / F.col("weight"), F.col("level")), ignorenulls=True).over(all_rows))
    target = F.when(F.col("source_size") == 0, 0.0).otherwise(F.least("cap", F.coalesce("at", F.lit(float("inf"))) * F.col("weight")))
    return level.select("source", "source_size", target.alias("target"))


def solve(sizes: DataFrame, targets: DataFrame, tolerance: float = 1e-9, rounds: int = 80) -> DataFrame:
    """(source, source_size, target, tilt): the tilt t at which rates min(CAP, exp(t * size / mean size)) meet each target.

    One dual variable for each source; every round is one aggregation over (source, size) counts that gives each
    dual's gradient and curvature. A Newton step that leaves its bracket is replaced by the bracket's middle, for the
    cap bends the gradient. Sources at CAP need no tilt and take the cap; sources of size 0 keep 0.
    """
    rows = sizes.where("size > 0").groupBy("source").agg(F.sum("n").alias("rows")).withColumnRenamed("source", "s")
    state = targets.join(rows, F.col("source").eqNullSafe(F.col("s")), "left").drop("s")
    full = F.col("target") >= CAP * F.col("source_size") * (1 - 1e-12)
    state = durable(
        state.select(
            "source", "source_size", "target", (F.col("source_size") / F.coalesce("rows", F.lit(1))).alias("mean"),
            F.lit(0.0).alias("tilt"), F.lit(-200.0).alias("low"), F.lit(200.0).alias("high"), (full | (F.col("source_size") == 0)).alias("done"),
        )
    )
    for _ in range(rounds):
        if not state.where("not done").limit(1).count():
            break
        active = state.where("not done").select(F.col("source").alias("s"), "tilt", "mean")
        z = F.col("size") / F.col("mean")
        raw = F.exp(F.least(F.col("tilt") * z, F.lit(50.0)))
        mass = F.col("n") * F.col("size")
        # Whole units add up alike in any order, so reruns take the same steps.
        total = lambda c: F.sum(F.round(c * UNITS).cast("decimal(38,0)")).cast("double") / UNITS
        sums = (
            sizes.where("size > 0").join(active, F.col("source").eqNullSafe(F.col("s")))
            .groupBy("s").agg(total(mass * F.least(F.lit(float(CAP)), raw)).alias("g"), total(F.when(raw < CAP, mass * z * raw).otherwise(0.0)).alias("h"))
        )
        joined = state.join(sums, F.col("source").eqNullSafe(F.col("s")), "left").drop("s")
        gap = F.col("g") - F.col("target")
        low, high = F.when(gap < 0, F.col("tilt")).otherwise(F.col("low")), F.when(gap > 0, F.col("tilt")).otherwise(F.col("high"))
        newton = F.col("tilt") - gap / F.col("h")
        inside = (F.col("h") > 0) & (newton > low) & (newton < high)
        met = F.col("done") | (F.abs(gap) <= tolerance * F.greatest("target", F.lit(1.0))) | (high - low < 1e-13)
        state = durable(
            joined.select(
                "source", "source_size", "target", "mean",
                F.when(met, F.col("tilt")).when(inside, newton).otherwise((low + high) / 2).alias("tilt"),
                F.when(met, F.col("low")).otherwise(low).alias("low"), F.when(met, F.col("high")).otherwise(high).alias("high"), met.alias("done"),
            )
        )
    return state.select("source", "source_size", "target", "mean", F.when(full, F.lit(None)).otherwise(F.col("tilt")).alias("tilt"))


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """Adds size, source_size, target, rate, copies and taken to the documents (columns of these names are replaced).

    Size is the number of words; a null text has none. Rates tilt exponentially with a document's size so that each
    source's expected words are its target; copies are whole: rows stand in order of source, size and doc_id, rates
    add up along it, and a row takes the whole numbers its rate steps over. Rows of like size take turns, so a
    source's taken words miss its target by about one of its longest documents. No row is taken more than CAP times.
    Rows of size 0 take no words and have rate 1. Null doc_ids come first; rows equal in source, size and doc_id take
    their turns in arbitrary order, so reruns agree on all rows that differ in these. An empty table gives no rows.

    The text stays out of the ordered exchange (one row of three columns a document); running sums are taken within range
    partitions and joined by one offset for each partition.
    """
    spark = docs.sparkSession
    made = ["size", "source_size", "target", "rate", "copies", "taken"]
    docs = docs.drop(*made)
    meta = ordered_sizes(docs)
    sizes = durable(meta.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")))
    solved = solve(sizes, durable(source_targets(sizes, weights)))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rate = F.when(F.col("size") == 0, 1.0).when(F.col("tilt").isNull(), float(CAP)).otherwise(F.least(F.lit(float(CAP)), F.exp(F.least(F.col("tilt") * F.col("size") / F.col("mean"), F.lit(50.0)))))
    rated = meta.join(solved.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s").withColumn("rate", rate).withColumn("units", F.round(F.col("rate") * UNITS).cast("long"))
    keys = [F.col("source").asc_nulls_last(), F.col("size"), F.col("doc_id"), F.col("crc")]
    line = durable(rated.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).withColumn("__at", F.monotonically_increasing_id()))
    part = F.shiftright("__at", 33)
    sums = line.groupBy(part.alias("__part")).agg(F.sum("units").alias("__sum"))
    starts = sums.select("__part", (F.sum("__sum").over(Window.orderBy("__part")) - F.col("__sum")).alias("__start"))
    running = F.sum("units").over(Window.partitionBy("__part").orderBy("__at"))
    # One row for each range partition is broadcast.
    placed = line.withColumn("__part", part).join(F.broadcast(starts), "__part").withColumn("__end", F.col("__start") + running)
    half = UNITS // 2
    whole = lambda c: F.expr(f"({c} + {half}) div {UNITS}")
    return placed.withColumn("__begin", F.col("__end") - F.col("units")).select(
        "doc_id", "source", "crc", "size", "source_size", "target", "rate",
        (whole("__end") - whole("__begin")).alias("copies"), ((whole("__end") - whole("__begin")) * F.col("size")).alias("taken"),
    )


def ordered_sizes(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size, crc) of each document."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select("doc_id", "source", F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("crc"))


def repeat(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """The documents as the mix takes them: each row as often as it has copies, with the input's columns.

    Rows that share doc_id, source and text count as one here, with the sum of their copies.
    """
    taken = mix(docs, weights).groupBy("doc_id", "source", "crc").agg(F.sum("copies").alias("__copies")).where("__copies > 0").toDF("__doc", "__source", "__crc", "__copies")
    single = docs.withColumn("__text_crc", F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary"))).dropDuplicates(["doc_id", "source", "__text_crc"])
    same = F.col("doc_id").eqNullSafe(F.col("__doc")) & F.col("source").eqNullSafe(F.col("__source")) & (F.col("__text_crc") == F.col("__crc"))
    return single.join(taken, same).withColumn("__turn", F.explode(F.sequence(F.lit(1).cast("long"), "__copies"))).select(*docs.columns)
