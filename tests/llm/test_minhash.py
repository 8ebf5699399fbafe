"""MinHash near-duplicates against brute force; stars against a sequential union."""

import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from evalframe.llm import common, minhash
from tests.llm.test_pairs import brute_components, edited, text


@pytest.mark.parametrize("stars,block", [(2, 512), (0, 8)])
def test_near_duplicates(docs_of, monkeypatch, stars, block):
    """With no star round, blocks of few members must find all links."""
    monkeypatch.setattr(minhash, "BLOCK", block)
    rng = random.Random(stars)
    rows, passage = [], text(rng, 60)
    for _ in range(40):
        base = text(rng, rng.choice([1, 3, 4, 5, 8, 12, 60, 200, 500]))
        rows += [edited(rng, base, rng.randrange(0, 1 + len(base) // 25)) for _ in range(rng.randrange(1, 6))]
    base = text(rng, 120)
    rows += [edited(rng, base, rng.randrange(0, 4)) for _ in range(150)]
    rows += [passage + text(rng, rng.randrange(1, 12)) for _ in range(60)] + [base] * 20
    rows = [(i, " ".join(r).title() if i % 2 else "\n".join(r)) for i, r in enumerate(rows)]
    rng.shuffle(rows)
    rows += [(9001, None), (9002, ""), (9003, " \x0b"), (9004, "A b"), (9005, "a B"), (None, "a b"), (None, None), (7, "a b"), (7, "a b"), (8000, " ".join(text(rng, 90000)))]
    rows += [(None, " ".join(base)), (None, " ".join(base[1:])), (None, "q r s t u"), (None, "q r s t u")]
    docs = docs_of(rows).withColumns({"version": F.lit("x"), "n": F.lit(0), "cid": F.lit(1)})
    signed, named = minhash.near_classes(docs, stars=stars)
    got = signed.join(named, ["s1", "s2", "n"], "left").selectExpr("doc_id", "n", "if(n > 0, component_id, doc_id)").collect()
    want = [r for r in brute_components(rows, k=4) if r[0] is not None]
    assert sorted((tuple(r) for r in got if r[0] is not None), key=str) == want
    assert len(got) == len(rows)
    if stars:
        out = minhash.near_duplicates(docs)
        assert out.columns == ["doc_id", "n_shingles", "component_id", "kept"]
        for r in out.collect():
            assert r.kept == (r.doc_id == r.component_id)


def test_no_rows(docs_of):
    assert minhash.near_duplicates(docs_of([])).count() == 0
    assert [r.kept for r in minhash.near_duplicates(docs_of([(1, None), (2, ""), (3, "one")])).collect()] == [True] * 3


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**63, 20000, dtype=np.uint64)
    for share in (0.2, 0.5, 0.8):
        m = int(10000 * share)
        a, b = np.unique(base[:10000]), np.unique(base[10000 - m : 20000 - m])
        x, y = minhash.minima([a, b])
        assert abs((x == y).mean() - m / (20000 - m)) < 0.12
    assert 145 < minhash.agreeing(80) < 165


def test_stars(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1001 + i) for i in range(300)] + [(rng.randrange(2000, 2400), rng.randrange(2000, 2400)) for _ in range(300)] + [(5000, 5000)]
    own = {x: x for e in edges for x in e}

    def root(x):
        while own[x] != x:
            x = own[x]
        return x

    for a, b in edges:
        own[max(root(a), root(b))] = min(root(a), root(b))
    got = {r.node: r.component for r in minhash.starred(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: root(x) for e in edges if e[0] != e[1] for x in e}
    assert minhash.starred(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("most", [40, 5000])
def test_stars_after_contraction(spark, monkeypatch, most):
    """Edges that fit one task need no round; of more than that, stars join what the runs have left."""
    rng = random.Random(5)
    edges = [(i, i + 1) for i in range(200)] + [(rng.randrange(1000, 1400), rng.randrange(1000, 1400)) for _ in range(300)] + [(5000, 5000), (7, 7), (200, 199)]
    rounds, small_star = [], minhash.small_star
    monkeypatch.setattr(minhash, "small_star", lambda e: rounds.append(1) or small_star(e))
    got = minhash.starred(spark.createDataFrame(edges, "a long, b long").repartition(4), **({"most": most} if most == 40 else {})).collect()
    nodes = {x for a, b in edges if a != b for x in (a, b)}
    own = {x: x for x in nodes}
    for _ in range(len(edges)):
        now = dict(own)
        for a, b in edges:
            if a != b:
                own[a] = own[b] = min(own[a], own[b])
        if now == own:
            break
    assert len(got) == len(nodes) and {r.node: r.component for r in got} == own
    assert bool(rounds) == (most == 40)


def test_exchanges_leave_nothing_on_disk(docs_of, spark):
    """The files of an exchange are gone once the stage that it fed is durable."""

    def held():
        files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n")
        return {f for f in files.split("\n") if "/shuffle_" in f}

    rng = random.Random(9)
    base = text(rng, 120)
    docs = docs_of([" ".join(edited(rng, base, rng.randrange(0, 4))) for _ in range(60)] + [" ".join(text(rng, 50)) for _ in range(20)])
    before, stay = held(), spark.conf.get(common.CLEANUP)
    signed, named = minhash.near_classes(docs)
    for _ in range(50):
        if held() <= before:
            break
        time.sleep(0.2)
    assert held() <= before
    assert spark.conf.get(common.CLEANUP) == stay
    assert signed.join(named, ["s1", "s2", "n"]).groupBy("component_id").count().count() < 80
