"""The manifest's trees, proofs and folds against brute force, in blocks of several levels and of one block."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from evalframe.llm import merkle


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(doc, source, lang, n, text):
    return sha(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc, source, lang, n, text)))


def tree(level):
    """All levels, lowest first."""
    out = [level]
    while len(out[-1]) > 1:
        out.append([sha(*out[-1][i : i + 3]) for i in range(0, len(out[-1]), 3)])
    return out


def path(levels, at):
    out = []
    for level in levels[:-1]:
        run = at // 3 * 3
        out.append((level[run:at], level[at + 1 : run + 3]))
        at //= 3
    return out


def brute(rows):
    by = {}
    for r in rows:
        by.setdefault(r[3], []).append((r, leaf(r[0], r[3], r[2], r[4], r[1])))
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: tree([x for _, x in sorted(by[s], key=lambda p: (p[0][0] is not None, p[0][0] or 0, p[1]))]) for s in names}
    over, out = tree([trees[s][-1][0] for s in names]), []
    for k, s in enumerate(names):
        order = sorted(by[s], key=lambda p: (p[0][0] is not None, p[0][0] or 0, p[1]))
        for at, (r, x) in enumerate(order):
            beside = path(trees[s], at) + path(over, k)
            tampered = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 and r[1] is not None
            now = leaf(r[0], r[3], r[2], r[4], r[1].replace("\n", "")) if tampered else x
            for a, b in beside:
                now = sha(*a, now, *b)
            out.append((r[0], x, trees[s][-1][0], over[-1][0], sha(*(y for a, b in beside for y in a + b)), now, now == over[-1][0]))
    return sorted(out, key=str)


@pytest.mark.parametrize("height", [1, 2, 6])
def test_manifest(spark, monkeypatch, height):
    monkeypatch.setattr(merkle, "HEIGHT", height)
    monkeypatch.setattr(merkle, "SPAN", 3**height)
    rng, rows = random.Random(height), []
    for source, n in ((None, 4), ("", 1), ("a", 3), ("ä", 10), ("b" * 40, 28), ("hot", 200), ("z", 2)):
        rows += [(rng.randrange(10**6), rng.choice(["a\nb\n", "é\n", "", None, "x" * 5000 + "\n"]), rng.choice([None, "en"]), source, rng.choice([None, 7])) for _ in range(n)]
    rows += [rows[30], rows[30], (None, "a\nb", "en", "hot", 3), (None, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").selectExpr("*", "0 as tree", "1 as size", "2 as digest")
    got = merkle.proofs(docs)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    want = brute(rows)
    assert sorted((tuple(r) for r in got.collect()), key=str) == want
    assert {r[-1] for r in want} == {True, False}


def test_one_row_and_none(docs_of):
    row = (5, "a\nb", "en", "s", 3)
    assert [tuple(r) for r in merkle.proofs(docs_of([row[:4]])).collect()] == brute([row])
    assert merkle.proofs(docs_of([])).count() == 0


@pytest.mark.parametrize("levels", [1, 2, 3, 5, 7])
def test_addresses(levels):
    """Every node has a place of its own, and each subtree of the lower half of the levels is one run of places."""
    places = [merkle.addresses(levels, d, np.arange(3**d)) for d in range(levels)]
    assert sorted(np.concatenate(places).tolist()) == list(range(merkle.nodes_of(levels)))
    assert places[0][0] == 0
    top = levels // 2
    for k in range(3**top if levels > 1 else 0):
        below = np.concatenate([places[d][k * 3 ** (d - top) : (k + 1) * 3 ** (d - top)] for d in range(top, levels)])
        assert below.max() - below.min() + 1 == len(below)
