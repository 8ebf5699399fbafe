"""Counting quotient filters as exact round trips; phrases against brute force."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from evalframe.llm import collocations as co


def drawn(rng, width, n):
    hi = np.array([rng.getrandbits(2 * width) for _ in range(n)], np.uint64)
    return hi, np.array([rng.getrandbits(width) for _ in range(n)], np.uint64)


@pytest.mark.parametrize("width", [4, 17, 21, 22, 32])
def test_permutation(width):
    hi, lo = drawn(random.Random(width), width, 2000)
    a, b = co.permuted(hi, lo, width)
    assert (a >> np.uint64(2 * width - 1)).max() <= 1 and (b >> np.uint64(width - 1)).max() <= 1
    x, y = co.restored(a, b, width)
    assert (x == hi).all() and (y == lo).all()
    if width == 4:
        every = np.arange(2**12, dtype=np.uint64)
        a, b = co.permuted(every >> np.uint64(4), every & np.uint64(15), 4)
        assert len(set((a << np.uint64(4) | b).tolist())) == 2**12


@pytest.mark.parametrize("width,prefix,n", [(4, 0, 1), (4, 3, 50), (17, 6, 3000), (21, 1, 7), (22, 9, 5000), (32, 20, 900)])
def test_filters_lose_nothing(width, prefix, n):
    rng = random.Random(n)
    hi, lo = drawn(rng, width, n)
    shard = rng.getrandbits(prefix) if prefix else 0
    rest = 2 * width - prefix
    hi = hi & np.uint64(2**rest - 1) | np.uint64(shard << rest)
    times = np.array([rng.choice([1, 1, 2, 127, 128, 16384, 2**40]) for _ in range(n)], np.int64)
    want = Counter()
    for a, b, t in zip(hi.tolist(), lo.tolist(), times.tolist(), strict=True):
        want[a, b] += t
    hi, lo, times = co.added(hi, lo, times, width)
    assert list(zip(hi.tolist(), lo.tolist(), strict=True)) == sorted(want)
    bits, data = co.filled(hi, lo, times, width, prefix)
    x, y, z = co.emptied(data, len(hi), bits, width, prefix, shard)
    assert (x == hi).all() and (y == lo).all() and (z == times).all()
    two = co.added(*(np.concatenate([v, v[:1]]) for v in (x, y, z)), width)
    assert two[2].sum() == times.sum() + times[0] and len(two[0]) == len(hi)


def brute(rows, least, share, top):
    counts, n = {}, Counter()
    for _, text, lang, _ in rows:
        lang = lang or "und"
        low = (text or "").translate({c: c + 32 for c in range(65, 91)})
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", low):
            words = [w for w in re.split("[ \t]+", piece) if w]
            n[lang] += len(words)
            for k in (1, 2, 3):
                for i in range(len(words) - k + 1):
                    at = counts.setdefault(lang, Counter())
                    at[tuple(words[i : i + k])] += 1
    out = []
    for lang, f in counts.items():
        found = {g: a for g, a in f.items() if len(g) > 1 and a >= least}
        gone = {s for g, a in found.items() if len(g) == 3 for s in (g[:2], g[1:]) if s in found and 100 * a >= share * found[s]}
        rows = []
        for g, a in found.items():
            if g not in gone:
                score, k = min((10**6 * a * a // (f[g[:k]] * f[g[k:]]), k) for k in range(1, len(g)))
                rows.append((-score, -a, " ".join(g).encode(), f[g[:k]], f[g[k:]]))
        out += [(lang, i + 1, p.decode(), -a, x, y, n[lang], -s) for i, (s, a, p, x, y) in enumerate(sorted(rows)[:top])]
    return sorted(out)


@pytest.mark.parametrize("shard", [1_000_000, 40])
def test_phrases(spark, docs_of, monkeypatch, shard):
    monkeypatch.setattr(co, "SHARD", shard)
    rng, rows = random.Random(shard), []
    words = ["The", "the", "of", "é", "Éa", " x", "|", "q-r", "New", "york", "city", *(f"w{i}" for i in range(30))]
    for i in range(300):
        text = "".join(rng.choice(words) + rng.choice([" ", " ", "  ", "\t", ". ", ",", "\n", "\x0b", "!"]) for _ in range(rng.randrange(0, 60)))
        rows.append((i, text + rng.choice(["", "New York City ", "New York "]) * rng.randrange(3), rng.choice(["en", "fr", "und", None]), "s"))
    rows += [(1, None, "en", "s"), (2, "", None, "s"), (None, "the of " * 30000, "xx", "s"), rows[3], rows[3]]
    docs = docs_of(rows).repartition(5).withColumns({"word": F.lit(1), "block": F.lit("b"), "id": F.lit(2)})
    got = co.phrases(docs, least=4, share=50, top=60)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    want = brute(rows, 4, 50, 60)
    assert sorted(tuple(r) for r in got.collect()) == want
    assert max(r[1] for r in want) == 60 and {r[0] for r in want} == {"en", "fr", "und", "xx"}


def test_wide_keys(spark, docs_of):
    """66,000 words have ids of 17 bits, so a shard's number stands above the first 32 bits of a key."""
    rng = random.Random(5)
    rows = [(i, " ".join(f"v{2 * k} v{2 * k + 1}" for k in rng.sample(range(33_000), 33_000)), "en", "s") for i in range(4)]
    got = co.phrases(docs_of(rows).repartition(4), least=4, top=40_000)
    assert {(r.phrase, r.a, r.l, r.r, r.n) for r in got.collect()} == {(f"v{2 * k} v{2 * k + 1}", 4, 4, 4, 264_000) for k in range(33_000)}


def test_empty(docs_of):
    assert co.phrases(docs_of([])).count() == 0
    assert co.phrases(docs_of([(1, "once upon a time"), (2, None)])).count() == 0


def test_scores_past_64_bits(spark):
    rows = [(10**12, 10**12 + 7, 10**12 + 13), (123456789012, 999999999999, 123456789013), (10, 10, 10)]
    got = spark.createDataFrame(rows, "a long, l long, r long").select(F.expr(co.SCORE.format(l="l", r="r"))).collect()
    assert [r[0] for r in got] == [10**6 * a * a // (l * r) for a, l, r in rows]
