"""Sample logs found and written, nested files as rows, the same shots for all, and choices by loss."""

import json

from pyspark.sql import functions as F

from evalframe.functions import choices
from evalframe.operators import shape
from evalframe.sources import io


def test_logs_are_found_however_deep(spark, tmp_path):
    for name in ("a/mme_cn_1.jsonl", "a/b/c/mme_2.jsonl", "x.jsonl", "a/other.txt"):
        path = tmp_path / "logs" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text('{"id": 1}\n{"id": 2}\n')
    rows = io.discover(spark, f"{tmp_path}/logs", "id long")
    kind = io.first_match(F.col("file_name"), [("mme_cn", "cn"), ("mme", "en")])
    assert sorted(((r.file_name, r.kind, r.n) for r in rows.groupBy("file_name", kind.alias("kind")).agg(F.sum("id").alias("n")).collect()), key=str) == [("mme_2.jsonl", "en", 3), ("mme_cn_1.jsonl", "cn", 3), ("x.jsonl", None, 3)]


def test_nested_files(spark, tmp_path):
    (tmp_path / "qa.json").write_text(json.dumps({"set": "s", "questions": [{"id": 1, "q": "a\nb"}, {"id": 2}]}, indent=1))
    (tmp_path / "none.json").write_text(json.dumps({"set": "t", "questions": []}))
    rows = io.explode_nested(spark, f"{tmp_path}/*.json", "set string, questions array<struct<id:long,q:string>>", "questions")
    assert rows.columns == ["set", "id", "q"] and sorted(map(tuple, rows.collect())) == [("s", 1, "a\nb"), ("s", 2, None)]


def test_sample_logs(spark, tmp_path):
    df = spark.createDataFrame(
        [("m", "t", 1, ["x"], ["x"], ["in", "more"], "d"), ("m", "t", 2, ["x", "y"], ["x"], [], "d"), ("m", "u", 3, None, None, None, "d")],
        "model string, task string, id long, resps array<string>, filtered_resps array<string>, arguments array<string>, doc string",
    )
    io.write_samples(df, f"{tmp_path}/out")
    assert sorted(p.name for p in (tmp_path / "out" / "model=m").iterdir()) == ["task=t", "task=u"]
    got = {r.id: r for r in spark.read.schema("id long, resps string, filtered_resps string, input string, doc string, arguments string").json(f"{tmp_path}/out").collect()}
    assert [(got[i].resps, got[i].filtered_resps, got[i].input) for i in (1, 2, 3)] == [(None, '["x"]', "in"), ('["x","y"]', '["x"]', None), (None, None, None)]
    assert all(r.doc is None and r.arguments is None for r in got.values())


def test_first_shots(spark):
    docs = spark.createDataFrame([(1,), (2,)], "d int")
    pool = spark.createDataFrame([(2, "c"), (0, "a"), (1, "b")], "i int, x string")
    assert {(r.d, r.context) for r in shape.first_shots(docs, pool, "i", "x", 2, "|").collect()} == {(1, "a|b"), (2, "a|b")}
    assert {r.context for r in shape.first_shots(docs, pool.where("i > 9"), "i", "x", 2).collect()} == {""}


def test_choices(spark):
    rows = [
        (1, [3.0, 1.0, 1.0], ["a", "bb", "cccc"], [1], [False, True, False]),
        (2, [1.0, 0.5, 2.0, 1.9], ["a", "b"], [0, 1], [False, False]),
        (3, [2.0, 1.0], ["", "b"], [0], [True, False]),
        (4, [2.0, 1.0], ["a", "b"], [5, -1], [True, True]),
        (5, [], [], [0], []),
        (6, None, ["a"], [0], None),
    ]
    df = spark.createDataFrame(rows, "i int, l array<double>, c array<string>, g array<int>, y array<boolean>")
    got = {r.i: tuple(r.s) for r in df.select("i", choices.choice_by_loss(F.col("l"), F.col("c"), choices.gold_places(F.col("c"), F.col("g")), F.col("y")).alias("s")).collect()}
    assert got[1] == (1, 2, 1.0, 0.0, 1, None, False)
    assert got[2] == (0, 0, 1.0, 1.0, 0, 1.0, False)
    assert got[3] == (1, 1, 0.0, 0.0, 1, None, False)
    assert got[4] == (1, 1, 0.0, 0.0, 0, None, True)
    assert got[5][2:] == (0.0, 0.0, 0, None, True) and got[6][2:] == (0.0, 0.0, 0, None, False)
    text = df.where("i = 1").select(choices.gold_places(F.col("c"), F.lit("bb"), "text"), choices.gold_places(F.col("c"), F.lit("x"), "text"), choices.gold_places(F.col("c"), F.lit(3), "place")).first()
    assert [list(x) for x in text] == [[1], [], []]
