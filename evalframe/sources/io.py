"""Scans and sinks: JSON lines with bad lines apart, provenance from file names, run logs, fixed-schema writes, keyed caches."""

from __future__ import annotations

import hashlib
import re
import tempfile
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BAD = "_corrupt_record"


def durable(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the folder the session names. Where it names none, a local session gets a temporary one and a cluster an
    error, for its executors don't share the driver's folders."""
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        path = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not path and not re.match(r"local(\[|$)", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(path or tempfile.mkdtemp(prefix="spark-"))
    return df.checkpoint(eager=True)


def read_jsonl(spark: SparkSession, path: str | list[str], schema: str, keep_bad: bool = False) -> DataFrame:
    """JSON lines of one or many files; blank lines are skipped. Lines that don't parse are dropped, or kept with their
    text in `_corrupt_record`. `file_name` says where each row comes from."""
    rows = spark.read.schema(f"{schema}, {BAD} string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", BAD).json(path)
    rows = rows.withColumn("file_name", F.col("_metadata.file_name"))
    return rows if keep_bad else rows.where(F.col(BAD).isNull()).drop(BAD)


def discover(spark: SparkSession, root: str, schema: str, glob: str = "*.jsonl") -> DataFrame:
    """All log files under a folder, however deep."""
    rows = spark.read.schema(schema).option("recursiveFileLookup", "true").option("pathGlobFilter", glob).json(root)
    return rows.withColumn("file_name", F.col("_metadata.file_name"))


def from_file_name(pattern: str, group: int = 1) -> Column:
    return F.nullif(F.regexp_extract("file_name", pattern, group), F.lit(""))


def first_match(name: Column, kinds: Sequence[tuple[str, str]]) -> Column:
    """The value of the first substring, in the given order, that the name contains."""
    return F.coalesce(*[F.when(F.contains(name, F.lit(part)), F.lit(value)) for part, value in kinds])


def explode_nested(spark: SparkSession, path: str, schema: str, field: str) -> DataFrame:
    """A JSON document with a list field as one row for each element."""
    rows = spark.read.schema(schema).option("multiLine", "true").json(path)
    return rows.select(*[c for c in rows.columns if c != field], F.explode(field).alias("item")).select(*[c for c in rows.columns if c != field], "item.*")


def read_json_list(spark: SparkSession, path: str, schema: str, source: Column | None = None) -> DataFrame:
    """A file that holds one JSON list, as rows of the given columns and types; `source` keeps the elements of one source only.
    Elements that don't fit a column's type have null there."""
    rows = spark.read.schema(schema).option("multiLine", "true").json(path)
    return rows if source is None else rows.where(source)


def first_results(spark: SparkSession, root: str, schema: str, glob: str = "*results.json") -> DataFrame:
    """The content of one result file anywhere under a folder: of the files that match, the one whose path comes first."""
    rows = spark.read.schema(schema).option("multiLine", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).json(root)
    rows = rows.withColumn("file_path", F.col("_metadata.file_path"))
    return rows.join(rows.agg(F.min("file_path").alias("file_path")), "file_path", "left_semi")


def read_board(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A leaderboard written by `write_board`; columns are told by the header, in any order."""
    return spark.read.schema(schema).option("header", "true").option("enforceSchema", "false").option("escape", '"').csv(path)


def write_jsonl(df: DataFrame, path: str, keep: Sequence[str], mode: str = "error") -> None:
    """The listed columns that exist; null fields stay out of each line."""
    df.select(*[c for c in keep if c in df.columns]).write.mode(mode).option("ignoreNullFields", "true").json(path)


def append_records(df: DataFrame, path: str) -> str | None:
    """Adds rows as JSON lines to a log. A log that can't be written must not end the run that it tells of: if a write of no rows fails
    there, that error's text comes back in place of an exception, None if all went well. Errors of the rows' own
    computation rise, so that a failed job doesn't look like a full log."""
    put = lambda rows: rows.write.mode("append").option("ignoreNullFields", "false").json(path)
    try:
        put(df.sparkSession.createDataFrame([], df.schema))
    except Exception as e:  # noqa: BLE001
        return str(e).splitlines()[0]
    put(df)
    return None


def results_table(metrics: DataFrame, samples: DataFrame, task: str, key: str) -> DataFrame:
    """(task, metric, value, stderr, n, task_hash) of long metrics (task, metric, value, stderr). A task's hash covers the keys and
    rows of its samples in any order, so equal samples have equal hashes wherever they ran."""
    rows = samples.select(F.col(task).alias("task"), F.sha2(F.to_json(F.struct(key, *sorted(c for c in samples.columns if c not in (task, key)))), 256).alias("row"))
    halves = [F.sum(F.conv(F.substring("row", at, 12), 16, 10).cast("decimal(20,0)")).alias(f"part{at}") for at in (1, 13, 25, 37)]
    hashed = rows.groupBy("task").agg(F.count(F.lit(1)).alias("n"), *halves)
    hashed = hashed.select("task", "n", F.sha2(F.concat_ws("|", "n", "part1", "part13", "part25", "part37"), 256).alias("task_hash"))
    return metrics.select("task", "metric", "value", "stderr").join(hashed, "task", "left").select("task", "metric", "value", "stderr", "n", "task_hash")


def write_results(table: DataFrame, path: str, config: dict[str, str]) -> None:
    """The table of results as Parquet, and as JSON with a task's metrics in one map beside the run's configuration."""
    table.write.parquet(f"{path}/table")
    told = F.create_map(*[F.lit(x) for pair in sorted(config.items()) for x in pair]) if config else F.lit(None).cast("map<string,string>")
    metrics = F.map_from_entries(F.array_sort(F.collect_list(F.struct("metric", "value"))))
    table.groupBy("task", "n", "task_hash").agg(metrics.alias("results")).withColumn("config", told).write.json(f"{path}/results")


def summary(df: DataFrame, kept: Column, by: Sequence[str], score: str, cuts: Sequence[float] = (0.1, 0.5, 0.9)) -> DataFrame:
    """One row that tells what a selection did: rows in and kept, quantiles and the lowest score of the kept, and for each column
    of `by` a map from its values to how many rows were kept. An empty table gives counts of 0 and empty maps."""
    rows = df.withColumn("__kept", F.coalesce(kept, F.lit(False)))
    chosen = F.when(F.col("__kept"), F.col(score))
    out = rows.agg(F.count(F.lit(1)).alias("n"), F.count_if("__kept").alias("kept"), F.min(chosen).alias("cut_off"), F.percentile(chosen, F.array(*[F.lit(c) for c in cuts])).alias("quantiles"))
    for column in by:
        counts = rows.where("__kept").groupBy(F.coalesce(F.col(column).cast("string"), F.lit("null")).alias("k")).agg(F.count(F.lit(1)).alias("v"))
        out = out.crossJoin(counts.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "v")))).alias(f"by_{column}")))
    return out


def write_submission(df: DataFrame, path: str, key: str, answer: str) -> None:
    """(question_id, answer) lines as a judging server takes them; a null answer is an empty one."""
    df.select(F.col(key).alias("question_id"), F.coalesce(F.col(answer).cast("string"), F.lit("")).alias("answer")).write.json(path)


def write_board(df: DataFrame, path: str) -> None:
    """A leaderboard as CSV with a header; quotes inside values are doubled."""
    df.write.option("header", "true").option("escape", '"').csv(path)


def write_typed(df: DataFrame, path: str, schema: object) -> None:
    """Columns, order and types of a fixed schema."""
    df.to(schema).write.parquet(path)


def write_samples(df: DataFrame, path: str) -> None:
    """Sample logs by model and task. `input` is the first argument; responses equal to the filtered ones, raw documents and the
    arguments stay out; lists become JSON texts."""
    same = F.col("resps").eqNullSafe(F.col("filtered_resps"))
    rows = df.withColumn("resps", F.when(~same, F.col("resps")))
    rows = rows.withColumn("input", F.get("arguments", F.lit(0))) if "arguments" in df.columns else rows
    lists = [f.name for f in rows.schema.fields if isinstance(f.dataType, T.ArrayType) and f.name not in ("doc", "arguments")]
    rows.withColumns({c: F.to_json(c) for c in lists}).drop("doc", "arguments").write.partitionBy("model", "task").json(path)


def latest_runs(df: DataFrame, keys: Sequence[str], when: str) -> DataFrame:
    """Rows of each key's latest run."""
    last = df.groupBy(*keys).agg(F.max(when).alias(when))
    return df.join(last, [*keys, when], "left_semi")


def nested_submission(df: DataFrame, key: str, fields: Sequence[str], order: str) -> DataFrame:
    """One row for each task with its samples as an ordered array."""
    rows = F.array_sort(F.collect_list(F.struct(order, *[f for f in fields if f != order])))
    return df.groupBy(key).agg(rows.alias("samples"))


def request_key(task: Column, shots: Column, rank: int = 0, world: int = 1, chat_template: bool = False, multiturn: bool = False, system_prompt: str | None = None, tokenizer: str = "") -> Column:
    """What a run's cached requests go by: task, number of shots and all settings that change the requests. A system prompt counts by its SHA-256."""
    told = "-chat_template" * chat_template + "-fewshot_as_multiturn" * multiturn
    if system_prompt is not None:
        told += "-system_prompt_hash" + hashlib.sha256(system_prompt.encode()).hexdigest()
    return F.concat(F.lit("requests-"), task, F.lit("-"), shots.cast("string"), F.lit(f"shot-rank{rank}-world_size{world}{told}-tokenizer{tokenizer}"))


def cached(df: DataFrame, cache_path: str, keys: Sequence[str], build) -> DataFrame:
    """Rows of a keyed cache; keys it lacks are built, appended and returned with the hits."""
    spark = df.sparkSession
    asked = df.withColumn("cache_key", F.sha2(F.concat_ws("|", *keys), 256))
    try:
        held = spark.read.parquet(cache_path)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        held = None
    missing = asked if held is None else asked.join(held, "cache_key", "left_anti")
    build(missing).write.mode("append").parquet(cache_path)
    return spark.read.parquet(cache_path).join(asked.select("cache_key"), "cache_key", "left_semi")
