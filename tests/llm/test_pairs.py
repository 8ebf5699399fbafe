"""The n-gram join against brute force."""

import random
import re

import pytest

from evalframe.llm import ngram_join
from evalframe.llm.common import connected


def brute_components(rows, k=5, percent=80):
    sets = []
    for _, t in rows:
        words = re.findall(rb"[^\x20\x09-\x0d]+", (t or "").encode().lower())
        sets.append({tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if len(words) >= k else {tuple(words)} if words else set())
    own = list(range(len(rows)))

    def root(i):
        while own[i] != i:
            i = own[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                own[max(root(i), root(j))] = min(root(i), root(j))
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(least.get(root(i), d), d)
    return sorted(((d, len(sets[i]), least.get(root(i))) for i, (d, _) in enumerate(rows)), key=str)


def text(rng, n, words=4000):
    return [f"w{rng.randrange(words)}" for _ in range(n)]


def edited(rng, base, edits):
    out = list(base)
    for _ in range(edits):
        out[rng.randrange(len(out))] = f"e{rng.randrange(10**6)}"
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_components(docs_of, seed):
    rng = random.Random(seed)
    rows = []
    passage = text(rng, 60)
    for _ in range(40):  # families of near copies, on both sides of the bound
        base = text(rng, rng.choice([3, 4, 5, 6, 12, 60, 70, 200, 500]))
        rows += [edited(rng, base, rng.randrange(0, 1 + len(base) // 25)) for _ in range(rng.randrange(1, 6))]
    base = text(rng, 120)
    rows += [edited(rng, base, rng.randrange(0, 4)) for _ in range(150)]  # one large family, longer than a block
    rows += [text(rng, 30) + passage + text(rng, 30) for _ in range(80)]  # a passage that many share
    rows += [passage + text(rng, rng.randrange(1, 12)) for _ in range(80)]
    rows += [base] * 20 + [[rng.choice("ab") for _ in range(40)] for _ in range(40)]
    rows = [(i, " ".join(r).title() if i % 2 else "\n".join(r)) for i, r in enumerate(rows)]
    rng.shuffle(rows)
    rows += [(9001, None), (9002, ""), (9003, " \x0b"), (9004, "A b"), (9005, "a B"), (None, "a b"), (None, None), (7, "a b"), (7, "a b")]
    docs = docs_of(rows).selectExpr("*", "0 as n", "0 as component_id")
    got = ngram_join.components(docs).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == brute_components(rows)


@pytest.mark.parametrize("stars", [0, 1])
def test_blocks_alone(docs_of, stars, monkeypatch):
    """Chunks of a list and repeated meetings lose no pair, on short sets too, where few ranks pass the bounds."""
    monkeypatch.setattr(ngram_join, "BLOCK", 8)
    monkeypatch.setattr(ngram_join, "BEFORE", 2)
    rng = random.Random(4)
    rows = []
    for size in (8, 9, 12, 14, 14, 16, 20, 60, 200):
        base = text(rng, size)
        rows += [edited(rng, base, rng.randrange(0, 2 + size // 40)) for _ in range(12)]
        rows += [base[: rng.randrange(size - 2, size + 1)] + text(rng, rng.randrange(0, 2)) for _ in range(12)]
    rows = [(i, " ".join(r)) for i, r in enumerate(rows)]
    signed, named = ngram_join.similar_classes(docs_of(rows), stars=stars)
    got = {r.doc_id: r.component_id for r in signed.join(named, ["s1", "s2", "n"]).collect()}
    assert got == {d: c for d, _, c in brute_components(rows)}


def test_no_rows(docs_of):
    assert ngram_join.components(docs_of([])).count() == 0
    assert ngram_join.components(docs_of([(1, None), (2, "")])).count() == 2


def test_keep_one(docs_of):
    rng = random.Random(9)
    base = text(rng, 80)
    rows = [(5, " ".join(base)), (3, " ".join(edited(rng, base, 1))), (8, "else where"), (9, None), (8, "else where")]
    docs = docs_of(rows)
    kept = ngram_join.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [3, 8, 9]


def test_rows_that_share_an_id(docs_of):
    """Texts without an id, or with the same one, and a row repeated often are told apart by their texts."""
    rng = random.Random(6)
    families = [text(rng, 60) for _ in range(60)]
    rows = [(None if i % 3 else 5, " ".join(edited(rng, base, rng.randrange(0, 3)))) for i, base in enumerate(families * 5)]
    rows += [rows[0]] * 200
    got = ngram_join.components(docs_of(rows)).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == brute_components(rows)


@pytest.mark.parametrize("most", [7, 1_000_000])
def test_connected_equals_union_find(spark, most):
    rng = random.Random(most)
    edges = [(i, i + 1) for i in range(1000, 1040)] + [(rng.randrange(300), rng.randrange(300)) for _ in range(160)] + [(5, 5), (-9, 2**40), (2**40, -9), (2**40, -9)]
    least = {n: n for e in edges for n in e}
    for _ in edges:
        for a, b in edges:
            least[a] = least[b] = min(least[a], least[b])
    found = connected(spark.createDataFrame(edges, "a long, b long").repartition(5), most).collect()
    assert sorted(map(tuple, found)) == sorted(least.items())


def test_connected_of_no_edges(spark):
    assert connected(spark.createDataFrame([], "a long, b long")).collect() == []
