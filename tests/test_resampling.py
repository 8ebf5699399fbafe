"""Resamples draw as many rows as there are, whatever the buckets; errors of a mean agree with its closed form."""

import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from evalframe.operators import resampling


@pytest.fixture
def rows(spark):
    rng = random.Random(3)
    made = [("a", rng.gauss(5, 2), 1.0) for _ in range(3000)] + [("b", float(rng.random() < 0.3), 1.0) for _ in range(5000)] + [(None, 2.0, 1.0)] * 7 + [("c", None, 1.0), ("d", 4.0, 1.0)]
    return made, spark.createDataFrame(made, "k string, v double, one double")


@pytest.mark.parametrize("bucket", [4096, 50])
def test_every_round_draws_n(rows, monkeypatch, bucket):
    monkeypatch.setattr(resampling, "BUCKET", bucket)
    made, df = rows
    got = resampling.resampled(df, "k", ["v", "one"], 400).toPandas()
    sizes = {"a": 3000, "b": 5000, None: 7, "d": 1}
    assert len(got) == 400 * len(sizes)
    for k, n in sizes.items():
        part = got[got.k.isna()] if k is None else got[got.k == k]
        assert sorted(part["round"]) == list(range(1, 401)) and (part.n == n).all() and (part.one == n).all()
    assert (got[got.k.isna()].v == 14).all() and (got[got.k == "d"].v == 4).all()
    for k in "ab":
        v = [x for g, x, _ in made if g == k]
        means = got[got.k == k].v / len(v)
        assert abs(means.mean() - statistics.mean(v)) < 4 * statistics.stdev(v) / np.sqrt(len(v) * 400) + 1e-9
        assert means.std() == pytest.approx(statistics.pstdev(v) / np.sqrt(len(v)), rel=0.15)
        assert means.nunique() > 100
    again = resampling.resampled(df.repartition(7).orderBy(F.desc("v")), "k", ["v", "one"], 400).toPandas()
    key = ["k", "round"]
    assert np.allclose(got.sort_values(key).v, again.sort_values(key).v)
    assert not np.allclose(got.sort_values(key).v, resampling.resampled(df, "k", ["v", "one"], 400, seed=1).toPandas().sort_values(key).v)


def test_interval_and_any_statistic(rows):
    made, df = rows
    got = {r.k: r for r in resampling.bootstrap(df, "k", ["v", "one"], F.sqrt(F.col("v") / F.col("n")), 1000).collect()}
    v = [x for g, x, _ in made if g == "a"]
    mean, error = statistics.mean(v), statistics.pstdev(v) / np.sqrt(len(v))
    assert got["a"].stderr == pytest.approx(error / 2 / np.sqrt(mean), rel=0.1)
    assert got["a"].low == pytest.approx(np.sqrt(mean - 1.96 * error), rel=0.005) and got["a"].high == pytest.approx(np.sqrt(mean + 1.96 * error), rel=0.005)
    assert got["d"].stderr == 0.0 and got["d"].low == got["d"].high == 2.0
    assert resampling.bootstrap(df.where("k = 'z'"), "k", ["v"], F.col("v"), 10).count() == 0


def test_rounds():
    assert [resampling.rounds_of("acc", n) for n in (100_000, 1500, 999, 1)] == [100_000, 1000, 999, 1]
    assert resampling.rounds_of("bleu", 100_000) == 100


def test_draws_agree_between_buckets():
    """All buckets' draws of a round come to the draws of the whole."""
    rng = random.Random(1)
    own = [rng.randrange(1, 50) for _ in range(8)]
    path = lambda b: [sum(x for i, x in enumerate(own) if i >> (3 - level) == b >> (3 - level)) for level in range(4)]
    drawn = sum(resampling.node_draws(path(b), b, sum(own), 500, [7]) for b in range(8))
    assert (drawn == sum(own)).all()
