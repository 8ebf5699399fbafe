"""Group-relative statistics of action tables: one group for each sample."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def relative(df: DataFrame, group: str, reward: str, reg: float = 0.0, eps: float = 1e-6) -> DataFrame:
    """Adds advantage: (reward - mean) / (population deviation + reg + eps); 0 in groups of one."""
    w = Window.partitionBy(group)
    score = (F.col(reward) - F.avg(reward).over(w)) / (F.stddev_pop(reward).over(w) + reg + eps)
    return df.withColumn("advantage", F.when(F.count(reward).over(w) < 2, 0.0).otherwise(score))


def baselined(df: DataFrame, group: str, reward: str, base: Column, bar: float = 0.0, reg: float = 0.0, eps: float = 1e-6) -> DataFrame:
    """Adds advantage against the group's baseline row, which itself drops out: no centring, the others' population deviation."""
    w = Window.partitionBy(group)
    base_value = F.max(F.when(base, F.col(reward))).over(w)
    spread = F.stddev_pop(F.when(~base, F.col(reward))).over(w)
    return df.withColumn("advantage", (F.col(reward) - (base_value - bar)) / (spread + reg + eps)).where(~base)


def supplement(df: DataFrame, group: str, gain: str, eps: float = 1.0) -> DataFrame:
    """Adds advantage: gain / (sample deviation + eps); a single row has deviation 0."""
    spread = F.coalesce(F.stddev_samp(gain).over(Window.partitionBy(group)), F.lit(0.0))
    return df.withColumn("advantage", F.col(gain) / (spread + eps))


def log_policy(df: DataFrame, group: str, score: str, temperature: float) -> DataFrame:
    """Adds log_prob: log-softmax of score over temperature within the group."""
    w = Window.partitionBy(group)
    s = F.col(score) / temperature
    top = F.max(s).over(w)
    rows = df.withColumn("__s", s - top)
    return rows.withColumn("log_prob", F.col("__s") - F.log(F.sum(F.exp("__s")).over(w))).drop("__s")


def gumbel_top_k(df: DataFrame, group: str, log_prob: str, key: list[str], k: int, seed: int) -> DataFrame:
    """k actions of each group without replacement, by noise drawn from the row's keys; all of a smaller group."""
    u = (F.pmod(F.xxhash64(F.lit(seed), *key), F.lit(2**40)) + 0.5) / 2.0**40
    w = Window.partitionBy(group).orderBy(F.desc("__g"), *key)
    return df.withColumn("__g", F.col(log_prob) - F.log(-F.log(u))).withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= k).drop("__g", "__r")
