"""Scores of multiple-choice rows from the losses of their choices."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _first_at(values: Column, best: Column) -> Column:
    """The place from 0 of the first value that equals `best`; null without one."""
    return F.nullif(F.array_position(values, best), F.lit(0)) - 1


def gold_places(choices: Column, gold: Column, kind: str = "places") -> Column:
    """Places of gold choices from 0: `places` is an array of places, `place` one, `text` a choice's text (the first that equals it).
    What isn't among the choices is left out."""
    if kind == "text":
        gold = F.array(_first_at(choices, gold).cast("int"))
    elif kind == "place":
        gold = F.array(gold.cast("int"))
    return F.filter(gold, lambda i: i.isNotNull() & (i >= 0) & (i < F.size(choices)))


def choice_by_loss(losses: Column, choices: Column, gold: Column, greedy: Column) -> Column:
    """A struct of pred, pred_norm, acc, acc_norm, exact_match, acc_mutual and gold_missing for a row with its choices' losses.

    The choice of least loss is predicted, and the one of least loss per character; of equal ones the first. With twice as
    many losses as choices, each is followed by its loss without the question, and acc_mutual asks whether the largest difference
    of the two is gold; else it is null. `gold` holds places as `gold_places` gives them: none scores 0 and sets
    gold_missing. exact_match asks whether any gold choice would be decoded greedily. A choice without a character
    has no loss per character; rows without losses or choices predict nothing and score 0.
    """
    n = F.size(choices)
    paired = F.size(losses) == 2 * n
    every = lambda first: F.filter(losses, lambda x, i: i % 2 == first)
    own = F.when(paired, every(0)).otherwise(losses)
    by_length = F.zip_with(own, choices, lambda x, c: F.try_divide(x, F.length(c).cast("double")))
    gain = F.zip_with(own, every(1), lambda c, u: c - u)
    pred, norm, mutual = _first_at(own, F.array_min(own)), _first_at(by_length, F.array_min(by_length)), _first_at(gain, F.array_max(gain))
    hit = lambda p: F.coalesce(F.array_contains(gold, p.cast("int")), F.lit(False)).cast("double")
    exact = F.exists(gold, lambda i: F.coalesce(F.get(greedy, i), F.lit(False)))
    return F.struct(
        pred.cast("int").alias("pred"), norm.cast("int").alias("pred_norm"), hit(pred).alias("acc"), hit(norm).alias("acc_norm"),
        F.coalesce(exact, F.lit(False)).cast("int").alias("exact_match"), F.when(paired & (n > 0), hit(mutual)).alias("acc_mutual"), (F.size(gold) == 0).alias("gold_missing"),
    )
