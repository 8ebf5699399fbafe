"""Selection of training rows: splits, priorities, resumption, ranked and stratified choice, retention."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evalframe.sources.io import durable


def unit(seed: int, *keys: str) -> Column:
    """A number in [0, 1) drawn from a row's keys and a seed alone."""
    return F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(2**40)) / 2.0**40


def first_wins(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row for each key: the first in the given order."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__n = 1").drop("__n")


def top_by_group(df: DataFrame, group: str, order: Sequence[Column], n: int) -> DataFrame:
    """The first n rows of each group, all if there are fewer; rank starts at 1."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("rank") <= n)


def top_fraction_sample(df: DataFrame, group: str, order: Sequence[Column], share: float, n: int, seed: int, key: str) -> DataFrame:
    """Of each group's top max(n, round-half-even(share * rows)), n rows drawn by a seeded hash."""
    w = Window.partitionBy(group)
    ranked = df.withColumn("__r", F.row_number().over(w.orderBy(*order))).withColumn("__all", F.count(F.lit(1)).over(w))
    pool = ranked.where(F.col("__r") <= F.greatest(F.lit(n), F.bround(share * F.col("__all")).cast("int")))
    return top_by_group(pool.withColumn("__u", unit(seed, key)), group, [F.col("__u"), F.col(key)], n).drop("__r", "__all", "__u", "rank")


def interleave(df: DataFrame, group: str, key: str, seed: int) -> DataFrame:
    """Round-robin over sorted groups, each in seeded random order: (turn, group) sorts the rows."""
    return df.withColumn("turn", F.row_number().over(Window.partitionBy(group).orderBy(unit(seed, key), key)))


def priority_join(left: DataFrame, right: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Each left row with its key's first right row in the given order."""
    return left.join(first_wins(right, keys, order), list(keys))


def record_key(dataset: Column, image: Column, question: Column) -> Column:
    """(dataset, last part of the image's path, question without outer blanks) as one value; null fields are equal to each other."""
    return F.struct(dataset.alias("dataset"), F.substring_index(F.coalesce(image, F.lit("")), "/", -1).alias("image"), F.regexp_replace(F.coalesce(question, F.lit("")), r"(?U)^\s+|\s+$", "").alias("question"))


def with_responses(pool: DataFrame, responses: DataFrame, order: Sequence[str], value: str) -> tuple[DataFrame, DataFrame]:
    """(met, missed): rows of the pool with `value` of the first response of their record in the given order (source, then line), and
    the rows of the pool without one.

    Both tables have dataset, image and question. The first response is a minimum, combined before the exchange, so a record with very
    many responses makes no large group. Of responses equal in `order` the one with the least value is taken.
    """
    key = record_key(F.col("dataset"), F.col("image"), F.col("question")).alias("__key")
    firsts = responses.select(key, F.struct(*order, F.col(value)).alias("__row")).groupBy("__key").agg(F.min("__row")[value].alias(value))
    keyed = pool.drop(value).withColumn("__key", record_key(F.col("dataset"), F.col("image"), F.col("question")))
    return keyed.join(firsts, "__key").drop("__key"), keyed.join(firsts, "__key", "left_anti").drop("__key")


def duplicates(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that more than one row has, with their number n; null keys count as equal."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def unique(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The same rows; raises ValueError, naming one such key, if two rows share one. Counts at once, one row reaches the driver."""
    found = duplicates(df, keys).limit(1).collect()
    if found:
        raise ValueError(f"{found[0]['n']} rows have the key {tuple(found[0][k] for k in keys)}")
    return df


def resume(todo: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose key isn't done."""
    return todo.join(done.select(*keys).distinct(), list(keys), "left_anti")


def retain(df: DataFrame, single: Column, spread: Column, share: float, least: float) -> DataFrame:
    """All rows with a single component, and the others at or above the (1 - share) quantile of spread, which is `least` at least."""
    cut = df.where(~single).agg(F.greatest(F.coalesce(F.percentile(spread, F.lit(1 - share)), F.lit(float("inf"))), F.lit(least)).alias("cut"))
    return df.join(F.broadcast(cut)).where(single | (spread >= F.col("cut")))


def indexed(df: DataFrame, order: str, skip: int = 0, limit: int | None = None, shards: int = 1, shard: int = 0) -> DataFrame:
    """Skip, then limit, then every shards-th row, by a row number column that starts at 0."""
    i = F.col(order)
    rows = df.where(i >= skip) if limit is None else df.where((i >= skip) & (i < skip + limit))
    return rows.where(F.pmod(i - skip, F.lit(shards)) == shard)


def positions(df: DataFrame, keys: Sequence[str], name: str = "position") -> DataFrame:
    """Adds each row's place from 0 in the order of `keys`, nulls first; rows equal in all of them are ordered arbitrarily.

    Range partitions are sorted and made durable, so that places can't change, and each adds the rows of those before it.
    Only these counts, one row a partition, meet in one task.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = durable(df.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).withColumn("__at", F.monotonically_increasing_id()))
    rows = ordered.withColumn("__part", F.shiftright("__at", 33))
    counts = rows.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    starts = counts.select("__part", (F.sum("__n").over(Window.orderBy("__part")) - F.col("__n")).alias("__start"))
    placed = rows.join(F.broadcast(starts), "__part")
    return placed.withColumn(name, F.col("__start") + F.col("__at").bitwiseAND(F.lit(2**33 - 1))).drop("__part", "__at", "__start")


def positions_in(df: DataFrame, group: Sequence[str], keys: Sequence[str], name: str = "position") -> DataFrame:
    """Adds each row's place from 0 in its group in the order of `keys`, nulls first; rows equal in all of them are ordered arbitrarily.
    A null is a group like others.

    Rows are range-partitioned over all groups and made durable, so that a group of any size lies in many partitions. Each
    partition adds the group's rows in those before it; only these counts, one row a partition and group that meet, are summed up.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = durable(df.repartitionByRange(parts, *group, *keys).sortWithinPartitions(*group, *keys).withColumn("__at", F.monotonically_increasing_id()))
    rows = ordered.withColumn("__part", F.shiftright("__at", 33))
    counts = rows.groupBy("__part", *group).agg(F.count(F.lit(1)).alias("__n"), F.min("__at").alias("__first"))
    before = F.sum("__n").over(Window.partitionBy(*group).orderBy("__part")) - F.col("__n")
    starts = counts.select(F.col("__part").alias("__in"), *[F.col(g).alias(f"__{g}") for g in group], "__first", before.alias("__start"))
    same = F.col("__part") == F.col("__in")
    for g in group:
        same &= F.col(g).eqNullSafe(F.col(f"__{g}"))
    return rows.join(starts, same).select(*df.columns, (F.col("__start") + F.col("__at") - F.col("__first")).alias(name))


def shard_manifest(df: DataFrame, key: str, shards: int) -> DataFrame:
    """(shard, place, key): ids dealt round by round, key modulo the number of shards; a row for each, placed from 0 in its shard by key.
    Rows without a key have no shard and stay out."""
    rows = df.select(F.pmod(key, F.lit(shards)).cast("long").alias("shard"), key).where(F.col(key).isNotNull())
    return positions_in(rows, ["shard"], [key], "place").select("shard", "place", key)


def area_share(boxes: Column, width: Column, height: Column) -> Column:
    """Sum of box areas (overlaps count twice) over the image's, at most 1; 1 without boxes or size."""
    area = F.aggregate(boxes, F.lit(0.0), lambda a, b: a + F.greatest(b[2] - b[0], F.lit(0.0)) * F.greatest(b[3] - b[1], F.lit(0.0)))
    usable = (F.size(boxes) > 0) & (width * height > 0)
    return F.when(usable, F.least(F.lit(1.0), area / (width * height))).otherwise(1.0)
