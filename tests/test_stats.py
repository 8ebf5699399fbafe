"""Word distances against a sequential table."""

import random

from pyspark.sql import functions as F

from evalframe.operators import stats


def distance(r, h):
    row = list(range(len(h) + 1))
    for i, x in enumerate(r, 1):
        new = [i]
        for j, y in enumerate(h, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_word_distance(spark):
    rng = random.Random(8)
    word = lambda: rng.choice(["a", "A", "b,", "é", "猫", "longer", "ab", "b", "w" * 40])
    rows = [(rng.choice([" ", "  ", "\n", " "]).join(word() for _ in range(rng.randrange(15))), " ".join(word() for _ in range(rng.randrange(15)))) for _ in range(80)]
    rows += [(None, "a"), ("a", None), ("", ""), (" ", "a b"), (" ".join(map(str, range(700))), " ".join(map(str, range(5, 900))))]
    for r in spark.createDataFrame(rows, "r string, h string").select("r", "h", stats.word_distance(F.col("r"), F.col("h")).alias("d")).collect():
        assert r.d == (None if r.r is None or r.h is None else distance(r.r.split(), r.h.split())), (r.r, r.h)

