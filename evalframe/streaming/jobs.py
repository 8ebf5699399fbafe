"""Streams of scored samples: tolerant ingest, resumption, windowed means, carried averages, counters, stage timings."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

BAD = "_corrupt_record"


def ingest(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """A stream of JSON lines; lines that don't parse (a writer's partial last line) carry their text in `_corrupt_record`."""
    return spark.readStream.schema(f"{schema}, {BAD} string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", BAD).json(folder)


def new_keys(stream: DataFrame, keys: list[str], ts: str, late: str) -> DataFrame:
    """Each key once within the lateness bound."""
    return stream.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)


def window_means(stream: DataFrame, ts: str, group: str, value: str, width: str, late: str) -> DataFrame:
    """Mean and count by tumbling window and group; a window closes `late` after its end."""
    rows = stream.withWatermark(ts, late).groupBy(F.window(ts, width), group)
    return rows.agg(F.avg(value).alias("mean"), F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), group, "mean", "n")


def counters(stream: DataFrame, group: str) -> DataFrame:
    """Running counts by branch (update or complete mode)."""
    return stream.groupBy(group).count()


def carried_average(stream: DataFrame, key: str, order: str, value: str, keep: float) -> DataFrame:
    """The moving average of each key after every batch of its rows: keep * state + (1 - keep) * value from 0. Rows count in the order
    of their batches, within a batch by `order`; a null value leaves the state as it is."""

    def step(of: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now, n = state.get if state.exists else (0.0, 0)
        for v in pd.concat(list(batches)).sort_values(order, kind="stable")[value].dropna():
            now, n = keep * now + (1 - keep) * float(v), n + 1
        state.update((now, n))
        yield pd.DataFrame({key: [of[0]], "average": [now], "n": [n]})

    rows = stream.select(key, order, value).groupBy(key)
    kind = stream.schema[key].dataType.simpleString()
    return rows.applyInPandasWithState(step, f"{key} {kind}, average double, n long", "average double, n long", "update", GroupStateTimeout.NoTimeout)


def after_warm_up(stream: DataFrame, run: str, order: str, warm_up: int) -> DataFrame:
    """The rows of each run but its first `warm_up`, counted over all batches; within a batch the least by `order` come first. Rows of a
    null run count as one run. The state of a run is one number."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in stream.schema.fields)

    def step(of: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen = state.get[0] if state.exists else 0
        if seen >= warm_up:
            yield from batches
            return
        rows = pd.concat(list(batches)).sort_values(order, kind="stable")
        state.update((min(warm_up, seen + len(rows)),))
        yield rows.iloc[warm_up - seen :]

    return stream.groupBy(run).applyInPandasWithState(step, fields, "seen long", "append", GroupStateTimeout.NoTimeout)


def timings(stream: DataFrame, run: str, ts: str, stages: list[str], total: str, width: str, slide: str, late: str, warm_up: int = 0) -> DataFrame:
    """Sliding-window stage sums and residuals by run; missing stages count 0. A run's first `warm_up` rows are left out."""
    rows = after_warm_up(stream, run, ts, warm_up) if warm_up else stream
    spent = sum((F.coalesce(F.col(s), F.lit(0.0)) for s in stages), F.lit(0.0))
    rows = rows.withColumn("stage_sum", spent).withColumn("residual", F.col(total) - spent).withWatermark(ts, late)
    made = rows.groupBy(F.window(ts, width, slide), run).agg(F.count(F.lit(1)).alias("n"), F.avg("stage_sum").alias("stage_sum"), F.percentile_approx(total, 0.95).alias("p95"), F.avg("residual").alias("residual"))
    return made.select(F.col("window.start").alias("start"), run, "n", "stage_sum", "p95", "residual")


def run_once(stream: DataFrame, sink: str, checkpoint: str, mode: str = "append", name: str | None = None):
    """Processes all that is available and stops; a restart from the same checkpoint goes on where it ended."""
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    q = writer.format("memory").queryName(name).start() if name else writer.format("json").start(sink)
    q.awaitTermination()
    return q
