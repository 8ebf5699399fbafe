"""Substring dedup against brute force, with one batch and many."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from evalframe.llm import substring_dedup

LAST = 2**63 - 1


def brute(rows, n=13):
    first = {}
    own = lambda d: LAST if d is None else d
    split = lambda t: (t or "").encode().split()
    for d, t in rows:
        w = split(t)
        for i in range(len(w) - n + 1):
            k = tuple(w[i : i + n])
            first[k] = min(first.get(k, own(d)), own(d))
    out = []
    for d, t in rows:
        w = split(t)
        gone = {i + j for i in range(len(w) - n + 1) if first[tuple(w[i : i + n])] < own(d) for j in range(n)}
        out.append((d, b" ".join(x for i, x in enumerate(w) if i not in gone).decode(), len(w), len(gone)))
    return sorted(out, key=str)


@pytest.mark.parametrize("batches", [1, 2, 6])
def test_dedup(docs_of, batches):
    rng = random.Random(batches)
    word = lambda: f"w{rng.randrange(500)}"
    shared = [[word() for _ in range(n)] for n in (12, 13, 14, 30, 60)]
    rows = []
    for i in range(120):
        body = [word() for _ in range(rng.randrange(0, 60))]
        for _ in range(rng.randrange(0, 3)):
            at = rng.randrange(len(body) + 1)
            body[at:at] = rng.choice(shared)
        rows.append((i, rng.choice([" ", "\n", "\x0b "]).join(body)))
    rows += [(200 + i, " ".join(shared[4])) for i in range(40)]
    rows += [(300, None), (301, ""), (302, "a " * 12), (303, "a " * 30), (304, "a " * 30), (None, " ".join(shared[3])), (None, "a " * 20), (305, "b " * 90 + "é ß"), (305, "b " * 90 + "é ß"), (50, "b " * 20)]
    long = [f"v{rng.randrange(10**6)}" for _ in range(90_000)]  # longer than a slice
    rows += [(400, " ".join(long)), (401, " ".join(long[:70_000] + ["x"] + long[70_000:]))]
    rng.shuffle(rows)
    got = substring_dedup.dedup_substrings(docs_of(rows).selectExpr("*", "1 as n_words", "2 as doc"), batches).collect()
    assert sorted(((r.doc_id, r.text, r.n_words, r.n_removed) for r in got), key=str) == brute(rows)


def test_no_rows(docs_of):
    assert substring_dedup.dedup_substrings(docs_of([])).count() == 0


def test_runs_are_sorted_and_merge(spark):
    index = substring_dedup.Index(spark, fan_in=4)
    made = [[(g, k) for g in range(50 - k, 0, -1)] for k in range(5)]
    for k, rows in enumerate(made):
        index.add(spark.createDataFrame(rows, "g long, doc long"))
        assert len(index.runs) == (1, 2, 3, 1, 2)[k]
        assert sorted(map(tuple, index.rows().collect())) == sorted(r for m in made[: k + 1] for r in m)
    for run in index.runs:
        gs = [r.g for r in index.read([run]).coalesce(1).collect()]
        assert gs == sorted(gs)
    index.drop()
    assert index.rows() is None


def test_run_lists_what_it_met(spark):
    index = substring_dedup.Index(spark, fan_in=3)
    rows = lambda *pairs: spark.createDataFrame(list(pairs), "g long, doc long")
    index.add(rows((1, 1), (2, 1), (2, 2), (3, 2), *((g, g) for g in range(100, 400))))
    found = index.add(rows((2, 5), (3, 5), (4, 5), *((g, g) for g in range(500, 800))))
    assert {(2, 1), (2, 2), (2, 5), (3, 2), (3, 5)} <= set(map(tuple, found.collect()))
    assert len(set(map(tuple, index.rows().collect()))) == index.rows().count() == 607
    again = substring_dedup.Index(spark, index.folder, 3)  # read from its folder, given a third batch, merged into one run
    assert sorted(again.runs) == sorted(index.runs)
    met = set(map(tuple, again.add(rows((1, 9), (4, 9), (150, 9))).collect()))
    assert {(1, 1), (1, 9), (4, 5), (4, 9), (150, 150), (150, 9)} <= met and (2, 5) not in met
    assert len(again.runs) == 1 and again.rows().count() == 610


def test_a_later_batch_of_a_stored_index_equals_brute_force(spark, docs_of):
    rng = random.Random(4)
    body = lambda n: " ".join(f"w{rng.randrange(300)}" for _ in range(n))
    rows = [(i, body(60)) for i in range(40)]
    rows += [(40 + i, body(20) + " " + rows[i][1] + " " + body(20)) for i in range(20)]
    index = substring_dedup.Index(spark)
    table = lambda some: docs_of(some).selectExpr("doc_id as doc", "text")
    for lo, hi in ((0, 20), (20, 40)):
        substring_dedup.candidates(table(rows[lo:hi]), index)
    index = substring_dedup.Index(spark, index.folder)
    listed = substring_dedup.candidates(table(rows[40:]), index)
    per = listed.groupBy("doc").agg(F.collect_set("g").alias("gs"))
    corpus = substring_dedup.squeezed(docs_of(rows).selectExpr("doc_id", "doc_id as doc", "0L as version", "text"))
    got = substring_dedup.strip(corpus, substring_dedup.repeats(corpus, per)).collect()
    assert sorted(((r.doc_id, r.text, r.n_words, r.n_removed) for r in got), key=str) == brute(rows)


@pytest.mark.parametrize("size", [1, 2, 3, 50])
def test_marks_do_not_depend_on_arrow_batches(size):
    rows = sorted((g, not new, d) for g, new, d in [(1, True, 5), (2, False, 1), (2, False, 2), (2, False, 9), (3, True, 4), (3, False, 1), (3, False, 2), (5, False, 1), (6, True, 1), (7, True, 1)])
    table = pa.table({"g": [r[0] for r in rows], "new": [not r[1] for r in rows], "doc": [r[2] for r in rows]})
    got = [(r["g"], r["shared"]) for b in substring_dedup.beside_equals(iter(table.to_batches(size))) for r in b.to_pylist()]
    assert got == [(1, True), *[(2, False)] * 3, *[(3, True)] * 3, (5, False), (6, False), (7, True)]
