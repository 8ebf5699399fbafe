"""Places in a global order are taken without bringing all rows to one task."""

import hashlib

import pytest
from pyspark.sql import functions as F

from evalframe.operators import curate, ngrams, rollup, stats
from evalframe.plans import registry


def test_positions_follow_the_order_over_partitions(spark):
    df = spark.createDataFrame([(None if i == 5 else i * 7 % 1000, i) for i in range(1000)], "k long, v long")
    placed = curate.positions(df, ["k", "v"])
    got = sorted(placed.collect(), key=lambda r: r.position)
    assert [r.position for r in got] == list(range(1000)) and placed.columns == ["k", "v", "position"]
    assert [(r.k, r.v) for r in got] == sorted(((r.k, r.v) for r in got), key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    loads = placed.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()
    assert max(loads) < 500
    assert curate.positions(df.where("k < 0"), ["k"]).count() == 0


@pytest.mark.parametrize("name", ["w16_length_batches", "j18_splice_subset", "p09_running_ids", "p15_shard_manifest"])
def test_windows_hold_counts_alone(spark, name):
    plan = registry.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window [" in line]
    assert windows and all("__part" in line for line in windows)


def test_positions_in_groups_of_which_one_is_hot(spark):
    rows = [(None if i % 10 == 0 else "hot" if i % 10 < 8 else f"g{i % 7}", i * 7919 % 1000, "x") for i in range(1000)]
    placed = curate.positions_in(spark.createDataFrame(rows, "g string, k long, __x string"), ["g"], ["k"], "place")
    assert placed.columns == ["g", "k", "__x", "place"]
    by = {}
    for g, k, _ in sorted(rows, key=lambda r: r[1]):
        by.setdefault(g, []).append(k)
    assert sorted(((r.g, r.k, r.place) for r in placed.collect()), key=str) == sorted(((g, k, i) for g, ks in by.items() for i, k in enumerate(ks)), key=str)


def test_manifest_leaves_out_rows_without_a_key(spark):
    got = curate.shard_manifest(spark.createDataFrame([(4,), (None,), (1,), (3,), (-1,), (4,)], "id long"), "id", 3).collect()
    assert sorted(map(tuple, got)) == [(0, 0, 3), (1, 0, 1), (1, 1, 4), (1, 2, 4), (2, 0, -1)]


def test_fingerprint_equals_nested_hashes(spark):
    def sha(x):
        return hashlib.sha256("".join(x).encode()).hexdigest()

    rows = [(k, None if k == 13 else f"t{k}") for k in (*range(25), 900, 901)] + [(7, "a"), (None, "n")]
    level = sorted(((k, s or "") for k, s in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    for _ in range(2):
        blocks = {}
        for k, s in level:
            blocks.setdefault(None if k is None else k // 10, []).append(s)
        level = [(k, sha(v)) for k, v in blocks.items()]
    df = spark.createDataFrame(rows, "k long, s string")
    for parts in (1, 4):
        got = stats.fingerprint(df.repartition(parts), "k", F.col("s"), 10).first()
        assert tuple(got) == (len(rows), sha(s for _, s in level))
    assert tuple(stats.fingerprint(df.where("k < 0"), "k", F.col("s")).first()) == (0, sha(""))


def test_closure_with_a_cycle_and_a_null(spark):
    edges = [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "e"), (None, "a"), ("a", "b")]
    got = {tuple(r) for r in rollup.closure(spark.createDataFrame(edges, "p string, c string"), "p", "c").collect()}
    want = set(edges)
    while more := {(x, w) for x, y in want for z, w in edges if y == z} - want:
        want |= more
    assert got == want and len(got) == rollup.closure(spark.createDataFrame(edges, "p string, c string"), "p", "c").count()


def test_contaminated_counts_distinct_runs_by_row(spark):
    docs = spark.createDataFrame([(1, "a b c d A B C x"), (1, "b C d"), (2, "c b a"), (3, None), (4, "a b")], "id long, text string")
    found = ngrams.contaminated(docs, "id", spark.createDataFrame([("A b c D",), (None,), ("a b",)], "text string"), 3)
    assert {tuple(r) for r in found.collect()} == {(1, 3)}
