"""Caption scores on known cases; blank fills against the matcher called run by run."""

import random
import re
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from evalframe.operators import captions


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(max(new[-1], row[j + 1], row[j] + (x == y)))
        row = new
    return row[-1]


def test_rouge_l(spark):
    rng = random.Random(1)
    rows = [(i, [rng.choice("abcde") for _ in range(rng.randrange(12))], [[rng.choice("abcdf") for _ in range(rng.randrange(9))] for _ in range(rng.randrange(4))]) for i in range(40)]
    rows += [(100, None, [["a"]]), (101, ["a"], None), (102, [], [[]]), (103, ["x"], [["y"], []])]
    df = spark.createDataFrame(rows, "i int, g array<string>, refs array<array<string>>")
    for r in df.select("i", "g", "refs", captions.rouge_l(F.col("g"), F.col("refs")).alias("s")).collect():
        p = max((lcs(r.g, x) / len(r.g) for x in r.refs or []), default=0) if r.g else 0
        q = max((lcs(r.g, x) / len(x) for x in r.refs or [] if x), default=0) if r.g else 0
        assert r.s == pytest.approx((1 + 1.44) * p * q / (q + 1.44 * p) if p and q else 0)


def test_consensus(spark):
    guesses = spark.createDataFrame([(1, "a b c d e".split()), (2, "x y".split()), (3, []), (4, "q r s t".split())], "k int, w array<string>")
    refs = spark.createDataFrame([(1, 0, "a b c d e".split()), (1, 1, "z z".split()), (2, 0, "x y".split()), (3, 0, ["a"])], "k int, ref int, w array<string>")
    got = {r.k: r.cider for r in captions.consensus(guesses, refs, "k", "w", "ref").collect()}
    # A copy scores 10 by each reference it copies; of two words only two of four orders exist.
    assert got == {1: pytest.approx(5.0), 2: pytest.approx(5.0), 3: 0.0, 4: 0.0}


def brute(said, gold):
    none = ("", 0, 0, 0, 0, 0, 0, 0)
    if not said or not gold or "sorry" in said.lower() or "I can't" in said:
        return none
    a, g = (re.findall(r"\w+|[^\w\s]", x) for x in (said, gold))
    best, found = 0, None
    for i in range(len(a) - len(g) + 1):
        w = a[i : i + len(g)]
        if set(w) & set(g) and (s := SequenceMatcher(None, " ".join(w), gold).ratio()) > best:
            best, found = s, w
    if not found:
        return none
    both = len(set(found) & set(g))
    p, r = both / len(set(found)), both / len(set(g))
    return " ".join(found), best, p, r, 2 * p * r / (p + r), both / len(set(found) | set(g)), sum(min(found.count(x), g.count(x)) for x in set(found)) / len(found), float(found == g)


def test_filled_blanks(spark):
    rng = random.Random(6)
    words = ["the", "cat", "sat", "on", "a", "mat", ",", "é", "猫", "The"]
    rows = [(" ".join(rng.choice(words) for _ in range(rng.randrange(30))), " ".join(rng.choice(words) for _ in range(rng.randrange(7)))) for _ in range(60)]
    rows += [(None, "a"), ("a", None), ("", ""), ("a", "a b"), ("x y z", "a"), ("Sorry, a cat", "a cat"), ("I can't: a", "a"), ("a cat a cat", "a cat"), ("a a b", "a a"), ("the mat " * 500, "on the mat")]
    df = spark.createDataFrame([(i, *r, "old") for i, r in enumerate(rows)], "i int, r string, g string, found string")
    got = captions.filled_blanks(df, "r", "g").orderBy("i").collect()
    assert len(got) == len(rows)
    for x, (said, gold) in zip(got, rows, strict=True):
        assert tuple(x[3:]) == pytest.approx(brute(said, gold)), (said, gold)


def test_matching_blocks():
    """The tabled runs of letters give the library's ratios, with letters that it leaves out as too frequent too."""
    rng = random.Random(8)
    for n in range(400):
        letters = rng.choice(["ab", "abcdefgh ", "etaoin shrdlué猫"])
        target = "".join(rng.choice(letters) for _ in range(rng.choice([1, 5, 40, 199, 200, 320])))
        text = "".join(rng.choice([rng.choice(letters), target[k : k + 9]]) for k in (rng.randrange(len(target)) for _ in range(rng.randrange(60))))
        found = captions.common_runs(text, target)
        lo = rng.randrange(len(text) + 1)
        hi = rng.randrange(lo, len(text) + 1)
        if found is not None and lo < hi:
            blocks = SequenceMatcher(None, text[lo:hi], target).get_matching_blocks()
            assert captions.matched(*found, text, target, lo, hi) == sum(b.size for b in blocks), (text, target, lo, hi)
    assert captions.common_runs("a" * 100, "a" * 100) is None
