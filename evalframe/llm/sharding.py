"""Sharding by a Hilbert curve over several metadata dimensions. DataFrame and SQL functions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evalframe.llm.common import durable


def curve_tables(dims: int) -> tuple[list[int], list[int]]:
    """The Hilbert curve as a state machine, by the rule of entry points and directions of sub-cubes.

    A state is direction * 2**dims + entry. Both lists are indexed by state * 2**dims + orthant: the orthant's place
    along the curve, and the state inside it.
    """
    size = 2**dims
    gray = lambda i: i ^ (i >> 1)
    rank = {gray(i): i for i in range(size)}
    rotate = lambda x, by: ((x << by % dims) | (x >> (dims - by % dims))) & (size - 1)
    trailing = lambda i: (~i & (i + 1)).bit_length() - 1
    place, state = [], []
    for direction in range(dims):
        for entry in range(size):
            for orthant in range(size):
                w = rank[rotate(orthant ^ entry, dims - (direction + 1) % dims)]
                first = 0 if w == 0 else gray(2 * ((w - 1) // 2))
                turn = 0 if w == 0 else trailing(w - 1 + w % 2) % dims if w % 2 == 0 else trailing(w) % dims
                place.append(w)
                state.append((direction + turn + 1) % dims * size + (entry ^ rotate(first, direction + 1)))
    return place, state


def hilbert_index(cells: Sequence[Column], bits: int) -> Column:
    """The place along the curve of a cell given by one coordinate of `bits` bits for each dimension."""
    dims = len(cells)
    place, state = (F.array(*map(F.lit, table)) for table in curve_tables(dims))

    def step(acc: Column, level: Column) -> Column:
        bit = lambda c: F.call_function("shiftright", c, level).bitwiseAND(1)
        orthant = sum((bit(c) * 2**k for k, c in enumerate(cells)), F.lit(0))
        at = acc["state"] * 2**dims + orthant + 1
        return F.struct(F.element_at(state, at).alias("state"), (acc["index"] * 2**dims + F.element_at(place, at)).alias("index"))

    levels = F.array(*[F.lit(i) for i in reversed(range(bits))])
    return F.aggregate(levels, F.struct(F.lit(0).alias("state"), F.lit(0).cast("long").alias("index")), step, lambda acc: acc["index"])


def quantised(df: DataFrame, dims: Sequence[tuple[str, str]], bits: int) -> list[Column]:
    """Coordinates of `bits` bits: `hash` deals a label by its CRC-32, `log2` takes half-octaves of a size; null counts as 0."""
    top = 2**bits - 1
    of = {
        "hash": lambda c: F.coalesce(F.crc32(c.cast("string").cast("binary")) % (top + 1), F.lit(0)),
        "log2": lambda c: F.least(F.lit(top), F.floor(2 * F.log2(F.greatest(F.coalesce(c, F.lit(0)), F.lit(0)).cast("double") + 1))),
    }
    return [of[kind](df[name]).cast("int") for name, kind in dims]


def hilbert_shards(df: DataFrame, dims: Sequence[tuple[str, str]], ties: Sequence[str], shards: int, bits: int = 5) -> DataFrame:
    """Adds curve_index, global position along the curve, shard and slot; shard row counts differ by one at most.

    Rows are sorted by (curve index, ties) over range partitions, which split any hot cell as long as `ties` part its
    rows. The sorted rows are made durable, so that a lost executor can't change positions; the only other exchange
    counts rows by partition, and its result has one row for each of the range partitions. Columns of the input
    named as the new ones are replaced. Null dimensions share coordinate 0; null ties come first; rows equal in all
    of these are ordered arbitrarily. An empty input gives no rows.
    """
    spark = df.sparkSession
    df = df.drop("curve_index", "position", "shard", "slot")
    keys = [F.col("curve_index"), *map(F.col, ties)]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    indexed = df.withColumn("curve_index", hilbert_index(quantised(df, dims, bits), bits))
    ordered = durable(indexed.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).withColumn("__at", F.monotonically_increasing_id()))
    part, local = F.shiftright("__at", 33), F.col("__at").bitwiseAND(F.lit(2**33 - 1))
    counts = ordered.groupBy(part.alias("__part")).agg((F.max(local) + 1).alias("__n"))
    # One row for each range partition, so at most `parts` rows to order and to broadcast.
    every = Window.orderBy("__part")
    starts = counts.select(
        "__part",
        (F.sum("__n").over(every) - F.col("__n")).alias("__start"),
        F.sum("__n").over(every.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("__total"),
    )
    placed = ordered.withColumn("__part", part).join(F.broadcast(starts), "__part").withColumn("position", F.col("__start") + local)
    shard = F.expr(f"cast(position * {shards} div __total as int)")
    first = F.expr(f"(shard * __total + {shards - 1}) div {shards}")
    return placed.withColumn("shard", shard).withColumn("slot", F.col("position") - first).drop("__part", "__at", "__start", "__total")


#: Dimensions of the documents' shards: two labels and a size.
DOCUMENT_DIMS = (("source", "hash"), ("lang", "hash"), ("size", "log2"))


def shard_documents(docs: DataFrame, shards: int = 40) -> DataFrame:
    """Documents' metadata in `shards` runs of the curve over source, language and size; copies of a text lie together.

    Returns doc_id, source, lang, size (UTF-8 bytes + 16; a null text has none), text_crc32, curve_index, position,
    shard and slot. The text itself takes no part in the exchange.
    """
    meta = docs.select(
        "doc_id", "source", "lang",
        (F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 16).alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
    )
    return hilbert_shards(meta, DOCUMENT_DIMS, ("text_crc32", "doc_id"), shards)
