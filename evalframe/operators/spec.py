"""A task as Column expressions: what is asked, what is right, which requests a row makes, and how results add up."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class EvalSpec:
    """`text`, `target` and `choices` build a row's prompt, gold answer and options; `process_docs` changes the documents first;
    `process_results` scores a response. Aggregates take a score column and `arguments`. With `predict_only` responses
    are collected and nothing is scored."""

    name: str
    text: Callable[[], Column]
    target: Callable[[], Column]
    choices: Callable[[], Column] | None = None
    process_docs: Callable[[DataFrame], DataFrame] = lambda df: df
    process_results: Callable[[Column, Column], Column] = lambda response, target: (response == target).cast("double")
    metrics: Mapping[str, Callable[..., Column]] = field(default_factory=lambda: {"mean": lambda c: F.avg(c)})
    arguments: Mapping[str, Mapping[str, object]] = field(default_factory=dict)
    predict_only: bool = False

    def docs(self, df: DataFrame) -> DataFrame:
        rows = self.process_docs(df).withColumn("prompt", self.text()).withColumn("target", self.target())
        return rows if self.choices is None else rows.withColumn("choices", self.choices())

    def requests(self, df: DataFrame, key: str) -> DataFrame:
        """(key, idx, request, continuation): one request for each choice, or one of the whole prompt."""
        rows = self.docs(df)
        if self.choices is None:
            return rows.select(key, F.lit(0).alias("idx"), F.col("prompt").alias("request"), F.lit(None).cast("string").alias("continuation"))
        return rows.select(key, F.posexplode("choices").alias("idx", "continuation"), F.col("prompt").alias("request")).select(key, "idx", "request", "continuation")

    def results(self, df: DataFrame, key: str, response: Callable[[], Column]) -> DataFrame:
        """(key, response, target, score); the score is null under `predict_only`."""
        rows = self.docs(df).withColumn("__r", response())
        score = F.lit(None).cast("double") if self.predict_only else self.process_results(F.col("__r"), F.col("target"))
        return rows.select(key, F.col("__r").alias("response"), "target", score.alias("score"))

    def aggregate(self, results: DataFrame) -> DataFrame:
        """One row of all metrics; none but the number of rows under `predict_only`."""
        made = {} if self.predict_only else {n: f(F.col("score"), **self.arguments.get(n, {})) for n, f in self.metrics.items()}
        return results.agg(F.count(F.lit(1)).alias("n"), *[c.alias(n) for n, c in made.items()])
