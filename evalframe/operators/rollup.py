"""Roll-ups of row scores: micro, macro, fixed keys, consistency, cubes and group hierarchies."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalframe.functions.aggregates import pooled_stderr, stderr
from evalframe.sources.io import durable


def micro(df: DataFrame, key: str, score: Column) -> DataFrame:
    """key, level, accuracy in percent, stderr and n: one row for each key and one overall (null key)."""
    rows = df.select(F.col(key).alias("key"), score.cast("double").alias("s"))
    return rows.groupingSets([["key"], []], "key").agg(F.grouping("key").cast("int").alias("overall"), (100 * F.avg("s")).alias("accuracy"), (100 * stderr(F.col("s"))).alias("stderr"), F.count("s").alias("n")).select("key", "overall", "accuracy", "stderr", "n")


def macro(df: DataFrame, keys: Sequence[str], score: Column) -> DataFrame:
    """Mean by all keys, then unweighted means level by level to one row."""
    level = df.groupBy(*keys).agg(F.avg(score.cast("double")).alias("score"))
    for k in range(len(keys) - 1, 0, -1):
        level = level.groupBy(*keys[:k]).agg(F.avg("score").alias("score"))
    return level.agg(F.avg("score").alias("score"))


def macro_fixed(df: DataFrame, key: str, score: Column, keys: DataFrame) -> DataFrame:
    """Unweighted mean over a given key list; keys without rows count 0."""
    means = df.groupBy(key).agg(F.avg(score.cast("double")).alias("m"))
    return keys.join(means, key, "left").agg(F.avg(F.coalesce("m", F.lit(0.0))).alias("score"))


def consistent(df: DataFrame, keys: Sequence[str], correct: Column) -> DataFrame:
    """Share of groups all of whose rows are correct."""
    return df.groupBy(*keys).agg(F.bool_and(correct).alias("ok")).agg(F.avg(F.col("ok").cast("int")).alias("accuracy"), F.count("ok").alias("groups"))


def closure(edges: DataFrame, parent: str, child: str) -> DataFrame:
    """(ancestor, node) pairs of a group hierarchy. Each round extends only the pairs that the last one found, leaves out those known, and
    is durable; cycles end, as nothing in them stays new. Rounds are as many as the longest shortest path."""
    step = durable(edges.select(F.col(parent).alias("node"), F.col(child).alias("next")).distinct())
    paths = fresh = step.toDF("ancestor", "node")
    while True:
        fresh = durable(fresh.join(step, "node").select("ancestor", F.col("next").alias("node")).subtract(paths))
        if not fresh.limit(1).count():
            return paths
        paths = paths.union(fresh)


def consolidate(results: DataFrame, pairs: DataFrame) -> DataFrame:
    """Group results from children: size-weighted and plain means, pooled stderr (null if a child has none)."""
    met = pairs.join(results, "node")
    pooled = F.when(F.count("stderr") == F.count(F.lit(1)), pooled_stderr(F.col("stderr"), F.col("n")))
    return met.groupBy("ancestor").agg((F.sum(F.col("value") * F.col("n")) / F.sum("n")).alias("weighted"), F.avg("value").alias("plain"), pooled.alias("stderr"), F.sum("n").alias("n"))


def consolidate_metrics(results: DataFrame, pairs: DataFrame, configured: Sequence[tuple[str, bool]]) -> DataFrame:
    """Group results by metric from (node, metric, value, stderr, n) of children, for metrics whose name contains a configured one.

    `configured` lists (name, whether children weigh by size); of several that a metric's name contains, the last holds. The error
    is pooled, and null if a child of that metric has none. Other metrics are left out before the join.
    """
    weighs = F.coalesce(*[F.when(F.contains("metric", F.lit(name)), F.lit(by_size)) for name, by_size in reversed(configured)], F.lit(None).cast("boolean"))
    met = results.withColumn("by_size", weighs).where("by_size is not null").join(pairs, "node")
    mean = F.when(F.bool_or("by_size"), F.sum(F.col("value") * F.col("n")) / F.sum("n")).otherwise(F.avg("value"))
    pooled = F.when(F.count("stderr") == F.count(F.lit(1)), pooled_stderr(F.col("stderr"), F.col("n")))
    return met.groupBy("ancestor", "metric").agg(mean.alias("value"), pooled.alias("stderr"), F.sum("n").alias("n"))


def nested_accuracy(df: DataFrame, task: Column, subtask: Column, category: Column, answer: Column, gold: Column, abstained: str = "E") -> DataFrame:
    """Accuracy by task, subtask and category, by task and subtask, by task, and of all (level 3 down to 0; columns below a level are null).

    An answer is right if the folded gold is in it. Categories are folded, and those with `attribute` in their name become one for each
    part before the first slash. `abstained` counts answers that are exactly that. A null answer or gold is wrong.
    """
    folded = F.lower(category)
    merged = F.when(F.contains(folded, F.lit("attribute")), F.concat(F.split_part(folded, F.lit("/"), F.lit(1)), F.lit("/attribute"))).otherwise(folded)
    right = F.coalesce(F.contains(F.lower(answer), F.lower(gold)), F.lit(False)).cast("int")
    rows = df.select(task.alias("task"), subtask.alias("subtask"), merged.alias("category"), right.alias("right"), F.coalesce(answer == abstained, F.lit(False)).cast("int").alias("e"))
    level = 3 - F.grouping("task") - F.grouping("subtask") - F.grouping("category")
    cells = rows.rollup("task", "subtask", "category").agg(level.cast("int").alias("level"), F.count(F.lit(1)).alias("n"), F.sum("right").alias("hits"), F.sum("e").alias("abstained"))
    return cells.select("level", "task", "subtask", "category", "n", "hits", "abstained", (F.col("hits") / F.col("n")).alias("accuracy"))


def refinement_scores(df: DataFrame, keys: Sequence[str], outcome: Column, label: Column) -> DataFrame:
    """Shares of refinement outcomes for each group: failures, detections, corrections and successes of the rows not labelled `correct`,
    false detections and validations of those labelled so.

    Corrections include successes, and detections include corrections so raised. ref_score is successes less false detections, recall
    the mean of detections and of 1 less false detections. An outcome that never occurs has share 0; one that occurs
    without any row of its label has none (null).
    """
    sound = F.coalesce(label == "correct", F.lit(False))
    names = {"failure": "Refinement Failure", "detection": "Error Detection Success", "correction": "Error Correction Success", "success": "Refinement Success", "false_detection": "False Error Detection", "validation": "Validation Success"}
    rows = df.select(*keys, outcome.alias("outcome"), sound.alias("sound"))
    counts = rows.groupBy(*keys).agg(F.count_if("sound").alias("good"), F.count_if(~F.col("sound")).alias("bad"), *[F.count_if(F.col("outcome") == v).alias(k) for k, v in names.items()])
    share = lambda k, of: F.when(F.col(k) == 0, 0.0).otherwise(F.try_divide(F.col(k), F.col(of)))
    shares = counts.select(*keys, *[share(k, "good" if k in ("false_detection", "validation") else "bad").alias(k) for k in names])
    raised = shares.withColumn("correction", F.col("correction") + F.col("success"))
    raised = raised.withColumn("detection", F.col("detection") + F.col("correction"))
    return raised.withColumn("ref_score", F.col("success") - F.col("false_detection")).withColumn("recall", (F.col("detection") + (1 - F.col("false_detection"))) / 2)
