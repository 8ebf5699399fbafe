"""Round trips of the sources and batch equality of the streams."""

import json
import random
import time
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from evalframe.sources import io
from evalframe.streaming import jobs

EVENTS = "/root/testdata/sf0.001/events.parquet"


def test_json_lines_with_bad_ones(spark, tmp_path):
    (tmp_path / "stats_shard0_v1.jsonl").write_text('{"id": 1, "x": "a"}\n\n{"id": 2, "x"\n')
    (tmp_path / "stats_shard1_v2.jsonl").write_text('{"id": 3, "x": null}\n')
    path = f"{tmp_path}/stats_shard*.jsonl"
    assert {r.id for r in io.read_jsonl(spark, path, "id long, x string").collect()} == {1, 3}
    every = io.read_jsonl(spark, path, "id long, x string", True)
    assert len([r for r in every.collect() if r._corrupt_record]) == 1
    assert {(r.id, r.v) for r in every.where("id is not null").select("id", io.from_file_name(r"_(v\d)").alias("v")).collect()} >= {(1, "v1"), (3, "v2")}
    kinds = [("shard1", "one"), ("shard", "any")]
    assert {r.k for r in every.select(io.first_match(F.col("file_name"), kinds).alias("k")).collect()} == {"any", "one"}


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", None), (2, None, 3)], "id long, x string, y int")
    io.write_jsonl(df, f"{tmp_path}/out", ["id", "x", "nope"])
    lines = [json.loads(x) for p in (tmp_path / "out").glob("*.json") for x in p.read_text().splitlines()]
    assert sorted(lines, key=str) == [{"id": 1, "x": "a"}, {"id": 2}]
    io.write_typed(df, f"{tmp_path}/typed", df.select("id", "x").schema)
    assert spark.read.parquet(f"{tmp_path}/typed").columns == ["id", "x"]
    made = []
    build = lambda d: (made.append(d.count()), d.withColumn("r", F.upper("x")))[1]
    assert io.cached(df.where("id = 1"), f"{tmp_path}/cache", ["id"], build).count() == 1
    assert io.cached(df, f"{tmp_path}/cache", ["id"], build).count() == 2
    assert made == [1, 1]


def test_lists_and_result_files(spark, tmp_path):
    (tmp_path / "list.json").write_text(json.dumps([{"id": 1, "source": "a", "n": 2}, {"id": 2, "source": "b"}, {"id": "x", "source": "a", "n": 3}]))
    rows = io.read_json_list(spark, f"{tmp_path}/list.json", "id long, source string, n int", F.col("source") == "a")
    assert sorted(rows.collect(), key=str) == [(1, "a", 2), (None, "a", 3)]
    for folder, value in (("b", 2), ("a/deep", 1)):
        (tmp_path / "runs" / folder).mkdir(parents=True)
        (tmp_path / "runs" / folder / "x_results.json").write_text(json.dumps({"value": value}))
    assert [r.value for r in io.first_results(spark, f"{tmp_path}/runs", "value int").collect()] == [1]


def test_records_never_raise(spark, tmp_path):
    df = spark.createDataFrame([(1, None)], "id long, x string")
    assert io.append_records(df, f"{tmp_path}/log") is None and io.append_records(df, f"{tmp_path}/log") is None
    assert spark.read.json(f"{tmp_path}/log").count() == 2
    (tmp_path / "file").write_text("")
    assert io.append_records(df, f"{tmp_path}/file/log")
    with pytest.raises(Exception, match="no such row"):
        io.append_records(df.select(F.raise_error(F.lit("no such row")).alias("x")), f"{tmp_path}/log")


def test_results_and_summary(spark, tmp_path):
    samples = spark.createDataFrame([("t", 1, "a"), ("t", 2, None), ("u", 1, "b")], "task string, doc_id long, resp string")
    metrics = spark.createDataFrame([("t", "acc", 0.5, 0.1), ("t", "f1", 0.25, None), ("v", "acc", 1.0, None)], "task string, metric string, value double, stderr double")
    table = io.results_table(metrics, samples, "task", "doc_id")
    got = {(r.task, r.metric): r for r in table.collect()}
    assert got["t", "acc"].n == 2 and got["t", "acc"].task_hash == got["t", "f1"].task_hash and got["v", "acc"].task_hash is None
    again = io.results_table(metrics, samples.repartition(3).orderBy(F.desc("doc_id")), "task", "doc_id")
    assert {r.task_hash for r in again.collect()} == {r.task_hash for r in got.values()}
    other = io.results_table(metrics, samples.where("doc_id = 1"), "task", "doc_id").where("task = 't'").first()
    assert other.task_hash != got["t", "acc"].task_hash
    io.write_results(table, f"{tmp_path}/results", {"model": "m"})
    told = {r.task: r for r in spark.read.json(f"{tmp_path}/results/results").collect()}
    assert told["t"].results.acc == 0.5 and told["t"].results.f1 == 0.25 and told["t"].config.model == "m"
    df = spark.createDataFrame([(1.0, "a"), (3.0, "a"), (2.0, None), (None, "b")], "score double, kind string")
    one = io.summary(df, F.col("score") > 1, ["kind"], "score", [0.5]).first()
    assert (one.n, one.kept, one.cut_off, one.quantiles, one.by_kind) == (4, 2, 2.0, [2.5], {"a": 1, "null": 1})
    none = io.summary(df.limit(0), F.col("score") > 1, ["kind"], "score").first()
    assert (none.n, none.kept, none.cut_off, none.by_kind) == (0, 0, None, {})


def test_submissions_and_boards(spark, tmp_path):
    df = spark.createDataFrame([(1, 'say "a", b'), (2, None)], "id long, said string")
    io.write_submission(df, f"{tmp_path}/sub", "id", "said")
    assert {tuple(r) for r in spark.read.schema("question_id long, answer string").json(f"{tmp_path}/sub").collect()} == {(1, 'say "a", b'), (2, "")}
    io.write_board(df, f"{tmp_path}/board")
    assert {tuple(r) for r in io.read_board(spark, f"{tmp_path}/board", "id long, said string").collect()} == {tuple(r) for r in df.collect()}


def test_streams_match_batches(spark, tmp_path):
    events = spark.read.parquet(EVENTS).withColumn("ts", F.col("ts").cast("timestamp"))
    events.repartition(3).write.json(f"{tmp_path}/in")
    stream = jobs.ingest(spark, f"{tmp_path}/in", "event_id long, ts timestamp, user_id long, event_type string, value double")
    good = stream.where("_corrupt_record is null")
    jobs.run_once(jobs.counters(good, "event_type"), "", f"{tmp_path}/c1", "complete", "counted")
    assert {tuple(r) for r in spark.sql("select * from counted").collect()} == {tuple(r) for r in events.groupBy("event_type").count().collect()}
    jobs.run_once(jobs.carried_average(good, "user_id", "event_id", "value", 0.9), "", f"{tmp_path}/c2", "update", "carried")
    got = {r.user_id: r.n for r in spark.sql("select user_id, max(n) n from carried group by 1").collect()}
    assert got == {r.user_id: r["count"] for r in events.groupBy("user_id").count().collect()}
    jobs.run_once(jobs.window_means(good, "ts", "event_type", "value", "1 day", "0 seconds"), f"{tmp_path}/out", f"{tmp_path}/c3")
    want = {(str(r.s), r.event_type): (r.m, r.n) for r in events.groupBy(F.window("ts", "1 day").start.alias("s"), "event_type").agg(F.avg("value").alias("m"), F.count(F.lit(1)).alias("n")).collect()}
    closed = {(str(r.start), r.event_type): (r["mean"], r.n) for r in spark.read.schema("start timestamp, event_type string, mean double, n long").json(f"{tmp_path}/out").collect()}
    assert closed and all(closed[k][1] == want[k][1] and abs(closed[k][0] - want[k][0]) < 1e-9 for k in closed)
    # All windows but those that the newest rows keep open are out.
    newest = max(k[0] for k in want)
    assert {k for k in want if k not in closed} <= {k for k in want if k[0] == newest}
    jobs.run_once(jobs.new_keys(good, ["user_id"], "ts", "3650 days"), "", f"{tmp_path}/c4", "append", "firsts")
    assert spark.sql("select * from firsts").count() == events.select("user_id").distinct().count()


def test_carried_average_over_batches(spark, tmp_path):
    """Two batches, each in its own order: the state goes on from the first to the second."""
    rng = random.Random(2)
    batches = [[(k, i, None if rng.random() < 0.1 else rng.uniform(-5, 5)) for k in (1, 2, None) for i in rng.sample(range(100), 20)] for _ in range(2)]
    want = {}
    for n, rows in enumerate(batches):
        spark.createDataFrame(rows, "k long, i long, v double").coalesce(1).write.json(f"{tmp_path}/in/{n}")
        for k, _, v in sorted(rows, key=lambda r: (str(r[0]), r[1])):
            a, m = want.get(k, (0.0, 0))
            want[k] = (0.9 * a + 0.1 * v, m + 1) if v is not None else (a, m)
        time.sleep(1.1)  # files come by time
    stream = spark.readStream.schema("k long, i long, v double").option("maxFilesPerTrigger", 1).json(f"{tmp_path}/in/*")
    q = jobs.run_once(jobs.carried_average(stream, "k", "i", "v", 0.9), "", f"{tmp_path}/c", "update", "carried_twice")
    assert len([x for x in q.recentProgress if x.numInputRows]) == 2
    got = {r.k: (r.average, r.n) for r in spark.sql("select k, max_by(average, n) average, max(n) n from carried_twice group by k").collect()}
    assert set(got) == set(want) and all(got[k][1] == want[k][1] and abs(got[k][0] - want[k][0]) < 1e-9 for k in want)


def test_timings_leave_warm_up_out(spark, tmp_path):
    rng = random.Random(5)
    start = datetime(2024, 1, 1)
    rows = [(run, start + timedelta(seconds=40 * i + rng.randrange(30)), rng.random(), rng.choice([None, rng.random()]), 1 + rng.random()) for run in ("a", "b", "c") for i in range({"a": 50, "b": 12, "c": 2}[run])]
    schema, late = "run string, ts timestamp, x double, y double, total double", datetime(2024, 2, 1)
    cut = start + timedelta(seconds=200)
    for part in ([r for r in rows if r[1] < cut], [r for r in rows if r[1] >= cut], [("z", late + timedelta(minutes=i), 0.0, 0.0, 0.0) for i in range(5)]):
        spark.createDataFrame(part, schema).repartition(2).write.mode("append").json(f"{tmp_path}/in")
        stream = spark.readStream.schema(schema).json(f"{tmp_path}/in")
        jobs.run_once(jobs.timings(stream, "run", "ts", ["x", "y"], "total", "10 minutes", "5 minutes", "1 minute", 3), f"{tmp_path}/out", f"{tmp_path}/c")
    kept = [r for run in ("a", "b", "c") for r in sorted(x for x in rows if x[0] == run)[3:]]
    df = spark.createDataFrame(kept, schema)
    spent = F.col("x") + F.coalesce("y", F.lit(0.0))
    batch = df.groupBy(F.window("ts", "10 minutes", "5 minutes").start.alias("start"), "run").agg(F.count(F.lit(1)).alias("n"), F.avg(spent).alias("s"), F.avg(F.col("total") - spent).alias("r"), F.percentile_approx("total", 0.95).alias("p"))
    want = {(r.start, r.run): (r.n, round(r.s, 9), round(r.r, 9), r.p) for r in batch.collect()}
    made = spark.read.schema("start timestamp, run string, n long, stage_sum double, p95 double, residual double").json(f"{tmp_path}/out")
    assert {(r.start, r.run): (r.n, round(r.stage_sum, 9), round(r.residual, 9), r.p95) for r in made.where("run <> 'z'").collect()} == want
    assert {k[1] for k in want} == {"a", "b"}
