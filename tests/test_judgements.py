"""Judge replies, refinement outcomes, nested accuracy, group metrics and record keys, case by case."""

import json

import pytest
from pyspark.sql import functions as F

from evalframe.functions import judging as J
from evalframe.operators import curate, rollup, shape
from evalframe.sources import io


def test_replies(spark):
    rows = [("Score: -2.5 of 10", 1, False, -2.5, 1.0, (-2.5, 10.0)), ("9\n3 4", 0, False, 9.0, 5.0, (-1.0, -1.0)), ("\n 3,4;5\n6", 0, False, 3.0, 3.0, (3.0, 4.0)), (" YES 1", 1, True, 1.0, 1.0, (-1.0, -1.0)), ("", 0, False, 0.0, 1.0, (-1.0, -1.0)), ("none", 0, False, 0.0, 1.0, (-1.0, -1.0))]
    df = spark.createDataFrame([r[:1] for r in rows], "r string")
    r = F.col("r")
    got = df.select(r, J.binary_score(r), J.says_yes(r), J.score_in(r), J.score_in(r, 1, 5), J.score_pair(r)).collect()
    assert [(*x[:5], tuple(x[5])) for x in got] == rows
    null = df.limit(1).select(J.score_in(F.lit(None).cast("string"), 1, 5), J.score_pair(F.lit(None).cast("string"))).first()
    assert null[0] == 1.0 and list(null[1]) == [-1.0, -1.0]


def test_json_block(spark):
    said = ['a {"x": {"y": 1},\n "z": "}"} b', '{"x": }', "no", "", None]
    got = [x[0] for x in spark.createDataFrame([(s,) for s in said], "r string").select(F.to_json(J.json_block(F.col("r")))).collect()]
    assert json.loads(got[0]) == {"x": {"y": 1}, "z": "}"} and got[1:] == [None] * 4


def test_judge_question(spark):
    df = spark.createDataFrame([("<image>Q? Select from the following choices.\n A \n", "v"), ("<image>Q? Select from the following choices.", "w"), (None, "v")], "p string, b string")
    got = [x[0] for x in df.select(J.question_for_judge(F.col("p"), F.col("b"), ["v"])).collect()]
    assert got == ["Q?\n A\nAnswer with the option's letter from the given choices directly.", "Q? Select from the following choices.", None]


def test_rules(spark):
    rows = [
        ("open", "3.0", "<answer> 3 </answer>", "equal"), ("open", "Red car", "red CAR ", "equal"), ("mcq", "B. red", "so (B)", "first letter"), ("open", "B. red", "so (B)", "pending"),
        ("zoom", "B. red", "red", "pending"), ("zoom", "red  car", "It is a Red car.", "contained"), ("mcq", "red car", "It is a red car.", "pending"), ("zoom", "", "", "pending"), ("zoom", None, "x", "pending"), ("mcq", "A", None, "pending"),
    ]
    df = spark.createDataFrame(rows, "k string, g string, r string, want string")
    assert all(x.got == x.want for x in df.withColumn("got", J.rule_source(F.col("k"), F.col("g"), F.col("r"))).collect())


def test_nested_accuracy(spark):
    rows = [("t", "s", "A/Attribute/x", "E", "e"), ("t", "s", "a/ATTRIBUTE/y", "it is B", "b"), ("t", "s", "ocr", None, "A"), ("t", "r", "ocr", "A", "B"), ("u", "s", "ocr", "E", "C")]
    df = spark.createDataFrame(rows, "t string, s string, c string, a string, g string")
    got = {tuple(x[:4]): tuple(x[4:]) for x in rollup.nested_accuracy(df, *map(F.col, "tscag")).collect()}
    assert got[(3, "t", "s", "a/attribute")] == (2, 2, 1, 1.0)
    assert got[(2, "t", "s", None)] == (3, 2, 1, pytest.approx(2 / 3))
    assert got[(1, "t", None, None)] == (4, 2, 1, 0.5)
    assert got[(0, None, None, None)] == (5, 2, 2, 0.4)
    assert len(got) == 4 + 3 + 2 + 1


def test_refinement(spark):
    said = [("m", "Refinement Success", "incorrect"), ("m", "Error Correction Success", "incorrect"), ("m", "Error Detection Success", "incorrect"), ("m", "Refinement Failure", None), ("m", "False Error Detection", "correct"), ("m", "Validation Success", "correct"), ("k", "Validation Success", "incorrect")]
    df = spark.createDataFrame(said, "m string, o string, l string")
    got = {r.m: r for r in rollup.refinement_scores(df, ["m"], F.col("o"), F.col("l")).collect()}
    m = got["m"]
    assert (m.failure, m.success, m.correction, m.detection, m.false_detection, m.validation) == (0.25, 0.25, 0.5, 0.75, 0.5, 0.5)
    assert (m.ref_score, m.recall) == (-0.25, 0.625)
    assert got["k"].validation is None and got["k"].false_detection == 0.0 and got["k"].recall == 0.5


def test_group_metrics(spark):
    results = spark.createDataFrame([("a", "acc,none", 1.0, 0.1, 1), ("b", "acc,none", 0.0, None, 3), ("a", "acc_norm,none", 1.0, 0.2, 2), ("b", "acc_norm,none", 0.0, 0.2, 4), ("a", "f1", 1.0, 0.1, 9)], "node string, metric string, value double, stderr double, n long")
    pairs = spark.createDataFrame([("g", "a"), ("g", "b")], "ancestor string, node string")
    got = {r.metric: r for r in rollup.consolidate_metrics(results, pairs, [("acc", True), ("norm", False)]).collect()}
    assert set(got) == {"acc,none", "acc_norm,none"}
    assert (got["acc,none"].value, got["acc,none"].stderr, got["acc,none"].n) == (0.25, None, 4)
    assert got["acc_norm,none"].value == 0.5 and got["acc_norm,none"].stderr == pytest.approx(((1 * 0.04 * 2 + 3 * 0.04 * 4) / 4 / 6) ** 0.5)


def test_records(spark):
    kind = "dataset string, image string, question string"
    pool = spark.createDataFrame([("d", "x/a.jpg", " q ", 1), ("d", "b.jpg", "q", 2), (None, None, None, 3)], f"{kind}, id int").withColumn("v", F.lit("old"))
    said = spark.createDataFrame([("d", "y/z/a.jpg", "q", 1, 0, "late"), ("d", "a.jpg", "q\n", 0, 7, "line 7"), ("d", "a.jpg", "q", 0, 3, "line 3"), (None, "", "", 0, 0, "null")], f"{kind}, file int, line int, v string")
    met, missed = curate.with_responses(pool, said, ["file", "line"], "v")
    assert {(r.id, r.v) for r in met.collect()} == {(1, "line 3"), (3, "null")}
    assert [r.id for r in missed.collect()] == [2]


def test_unique(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (None, "b"), (None, "b")], "k int, v string")
    assert curate.unique(df.where("k is not null"), ["k"]).count() == 2
    with pytest.raises(ValueError, match="2 rows have the key"):
        curate.unique(df, ["k"])
    assert {tuple(r) for r in curate.duplicates(df, ["k", "v"]).collect()} == {(None, "b", 2)}


def test_battles(spark):
    df = spark.createDataFrame([("base", "m", "model_b", "Better"), ("base", "m", "tie", "Tie"), ("base", "m", None, None), ("base", "k", "model_a", "Worse++")], "a string, b string, w string, j string")
    got = {(r.model, r.side): (r.n, r.rate) for r in shape.battle_rates(df, "a", "b", "w").collect()}
    assert got == {("base", "model_a"): (4, 25.0), ("m", "model_b"): (3, pytest.approx(100 / 3)), ("k", "model_b"): (1, 0.0)}
    m = {r.b: r for r in shape.verdict_shares(df, ["b"], "j").collect()}
    assert (m["m"].better, m["m"].tie, m["m"].unclear, m["k"].worse_plus, m["k"].worse) == (50.0, 50.0, 0.0, 100.0, 0.0)
    assert shape.verdict_shares(df.where("j is null"), ["b"], "j").first().better == 0.0


def test_request_key(spark, tmp_path):
    df = spark.createDataFrame([("t", 5, "q")], "task string, shots int, q string")
    plain, told = (df.select(io.request_key(F.col("task"), F.col("shots"), **o)).first()[0] for o in ({}, {"chat_template": True, "system_prompt": "x", "tokenizer": "k"}))
    assert plain == "requests-t-5shot-rank0-world_size1-tokenizer"
    assert told == "requests-t-5shot-rank0-world_size1-chat_template-system_prompt_hash2d711642b726b04401627ca9fbac32f5c8530fb1903cc4db02258717921a4881-tokenizerk"
    built = []
    for shots in (5, 0, 5):
        asked = df.withColumn("shots", F.lit(shots)).withColumn("key", io.request_key(F.col("task"), F.col("shots")))
        io.cached(asked, f"{tmp_path}/requests", ["key"], lambda x: x.withColumn("made", F.lit(built.append(x.count())).cast("string")))
    assert built == [1, 1, 0]
