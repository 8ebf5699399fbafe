"""Corpus BLEU and character F against counts by hand; plans that hold no table in the driver."""

import math
import random
from collections import Counter

import pytest

from evalframe.operators import captions, ngrams, shape


def runs(tokens, k):
    return Counter(tuple(tokens[i : i + k]) for i in range(len(tokens) - k + 1))


def test_bleu(spark, monkeypatch):
    monkeypatch.setattr(ngrams, "TOKENS", 50)
    rng = random.Random(3)
    rows = [(rng.choice("xy"), *(" ".join(rng.choice(["a", "B", "b", "é", "c"]) for _ in range(rng.randrange(12))) for _ in range(2))) for _ in range(80)]
    # 40,000 words, few of them equal: comparing each with each takes minutes.
    rows += [("x", " ".join(map(str, range(40_000))), " ".join(map(str, range(20_000, 60_000)))), ("z", "a b c d e", "a b c d e"), ("z", "", "a")]
    got = {r.k: r.bleu for r in ngrams.bleu(spark.createDataFrame(rows, "k string, h string, r string").repartition(3), "k", "h", "r").collect()}
    for key in "xyz":
        pairs = [(h.lower().split(), r.lower().split()) for k, h, r in rows if k == key]
        hn, rn = (sum(len(p[i]) for p in pairs) for i in (0, 1))
        logs = sum(math.log(max(sum((runs(h, k) & runs(r, k)).total() for h, r in pairs), 1e-9) / max(sum(runs(h, k).total() for h, _ in pairs), 1)) for k in (1, 2, 3, 4)) / 4
        assert got[key] == pytest.approx(100 * math.exp(logs + (0 if hn >= rn else 1 - rn / hn)), abs=2e-6)


def test_char_fscore(spark):
    rng = random.Random(4)
    text = lambda: rng.choice([None, "", "".join(rng.choice("ab é猫😀") for _ in range(rng.randrange(30)))])
    rows = [(i if i % 5 else rng.choice([None, 1, 2]), text(), text()) for i in range(200)]
    df = spark.createDataFrame(rows, "i int, g string, r string").repartition(3)
    sides = {}
    for n, (i, *texts) in enumerate(rows):
        for side, t in enumerate(texts):
            for k in range(1, 7):
                # Rows that share a key count as one; those without a key meet nothing.
                sides.setdefault((i if i is not None else ("none", n, side), k), [Counter(), Counter()])[side].update(runs((t or "").replace(" ", ""), k))
    p, r = [], []
    for k in range(1, 7):
        both = [c for (_, x), c in sides.items() if x == k]
        m, mine, theirs = sum((a & b).total() for a, b in both), sum(a.total() for a, _ in both), sum(b.total() for _, b in both)
        p.append(m / mine)
        r.append(m / theirs)
    p, r = sum(p) / 6, sum(r) / 6
    found = shape.char_fscore(df, "i", "g", "r")
    assert found.first().chrf == pytest.approx(100 * 5 * p * r / (4 * p + r))
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString()


def test_consensus_holds_nothing_in_the_driver(spark):
    guesses = spark.createDataFrame([(i, f"a b c{i} d".split()) for i in range(9)], "k int, w array<string>")
    refs = spark.createDataFrame([(i, j, f"a c{i} d e{j}".split()) for i in range(9) for j in range(2)], "k int, ref int, w array<string>")
    found = captions.consensus(guesses, refs, "k", "w", "ref")
    assert len(found.collect()) == 9
    assert "BroadcastHashJoin" not in found._jdf.queryExecution().executedPlan().toString()
