"""Aggregate columns of the evaluation tables, and the registries through which users add their own."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

METRICS: dict[str, Callable[..., Column]] = {}
AGGREGATIONS: dict[str, Callable[..., Column]] = {}
FILTERS: dict[str, Callable[..., Column]] = {}


def _registered(table: dict[str, Callable[..., Column]], name: str) -> Callable:
    def add(f: Callable[..., Column]) -> Callable[..., Column]:
        if name in table:
            raise ValueError(f"{name} is registered")
        table[name] = f
        return f

    return add


def metric(name: str) -> Callable:
    """Registers a row metric: columns -> column."""
    return _registered(METRICS, name)


def aggregation(name: str) -> Callable:
    """Registers an aggregation: columns -> aggregate column."""
    return _registered(AGGREGATIONS, name)


def response_filter(name: str) -> Callable:
    """Registers a response filter: column -> column."""
    return _registered(FILTERS, name)


@aggregation("mean")
def mean(c: Column) -> Column:
    return F.avg(c)


@aggregation("middle")
def middle(c: Column, order: Column) -> Column:
    """The value at place n // 2 in the given order (not sorted by value)."""
    rows = F.sort_array(F.collect_list(F.struct(order.alias("o"), c.alias("v"))))
    return F.element_at(rows, F.floor(F.size(rows) / 2).cast("int") + 1)["v"]


@aggregation("perplexity")
def perplexity(ll: Column) -> Column:
    return F.exp(-F.avg(ll))


@aggregation("weighted_perplexity")
def weighted_perplexity(ll: Column, weight: Column) -> Column:
    return F.exp(-F.sum(ll) / F.sum(weight))


@aggregation("bits_per_byte")
def bits_per_byte(ll: Column, text: Column) -> Column:
    return -(F.sum(ll) / F.sum(F.octet_length(text))) / F.log(F.lit(2.0))


def counts(pred: Column, gold: Column) -> dict[str, Column]:
    return {"tp": F.count_if(pred & gold), "fp": F.count_if(pred & ~gold), "fn": F.count_if(~pred & gold), "tn": F.count_if(~pred & ~gold)}


@aggregation("f1")
def f1(pred: Column, gold: Column) -> Column:
    c = counts(pred, gold)
    return 2 * c["tp"] / (2 * c["tp"] + c["fp"] + c["fn"])


@aggregation("matthews")
def matthews(pred: Column, gold: Column) -> Column:
    c = {k: v.cast("double") for k, v in counts(pred, gold).items()}
    root = F.sqrt((c["tp"] + c["fp"]) * (c["tp"] + c["fn"]) * (c["tn"] + c["fp"]) * (c["tn"] + c["fn"]))
    return F.when(root == 0, 0.0).otherwise((c["tp"] * c["tn"] - c["fp"] * c["fn"]) / root)


@metric("brier")
def brier(p: Column, gold: Column) -> Column:
    """Sum over classes of (probability - [class is gold]) squared, for one row."""
    return F.aggregate(F.transform(p, lambda x, i: F.pow(x - F.when(i == gold, 1.0).otherwise(0.0), 2)), F.lit(0.0), lambda a, x: a + x)


@aggregation("stderr")
def stderr(c: Column) -> Column:
    """Sample deviation over root n; null for one row."""
    return F.stddev_samp(c) / F.sqrt(F.count(c))


@aggregation("pooled_stderr")
def pooled_stderr(se: Column, n: Column) -> Column:
    """Of groups' standard errors and sizes."""
    return F.sqrt(F.sum((n - 1) * se * se * n) / (F.sum(n) - F.count(n)) / F.sum(n))


@aggregation("weighted_mean")
def weighted_mean(value: Column, weight: Column) -> Column:
    return F.sum(value * weight) / F.sum(weight)


@aggregation("ema")
def ema(value: Column, order: Column, keep: float, start: float) -> Column:
    """Carried over rows in the given order: keep * state + (1 - keep) * value."""
    rows = F.sort_array(F.collect_list(F.struct(order.alias("o"), value.alias("v"))))
    return F.aggregate(rows, F.lit(start), lambda a, x: keep * a + (1 - keep) * x["v"])


@aggregation("combined_stderr")
def combined_stderr(mean_: Column, se: Column, n: Column, order: Column) -> Column:
    """Pairwise fold of means and variances in the given order (depends on it)."""
    rows = F.sort_array(F.collect_list(F.struct(order.alias("o"), mean_.cast("double").alias("m"), (se * se).cast("double").alias("v"), n.cast("double").alias("n"))))

    def step(a: Column, x: Column) -> Column:
        total = a["n"] + x["n"]
        spread = ((a["n"] - 1) * a["v"] + (x["n"] - 1) * x["v"]) / (total - 1)
        between = a["n"] * x["n"] * F.pow(a["m"] - x["m"], 2) / (total * (total - 1))
        return F.struct(x["o"].alias("o"), ((a["m"] * a["n"] + x["m"] * x["n"]) / total).alias("m"), (spread + between).alias("v"), total.alias("n"))

    return F.sqrt(F.aggregate(F.slice(rows, 2, F.greatest(F.size(rows) - 1, F.lit(0))), F.element_at(rows, 1), step)["v"])
