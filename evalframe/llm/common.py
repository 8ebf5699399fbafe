"""Helpers that several operators share: durable stages, whole-text word hashing, connected components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Bytes that part two words: space, tab, line feed, vertical tab, form feed, carriage return.
SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"
WORD = r"[^\x20\x09-\x0D]+"

IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[list(SPACES)] = True
TO_LOWER = np.arange(256, dtype=np.uint8)
TO_LOWER[65:91] += 32

#: An odd multiplier, and its inverse modulo 2**64, of the rolling word hash.
BASE = 0x9E3779B97F4A7C15
BASE_INVERSE = pow(BASE, -1, 2**64)
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
BATCHES = "spark.sql.execution.arrow.maxBytesPerBatch"
#: Text bytes that a Python worker takes at a time; each byte costs some dozens in passing arrays.
SLICE_BYTES = 512 << 10
#: Edges of a graph that a Python worker takes at a time.
EDGES = 1_000_000


def shared_dir(spark: SparkSession) -> str:
    """The folder for durable stages: the session's spark.checkpoint.dir, or a new temporary one where none is set."""
    sc = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not path:
        path = tempfile.mkdtemp(prefix="spark-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(path)
    return path


def small_batches(spark: SparkSession) -> None:
    """Sets the session's Arrow batches to 4 MB where it names no size: a Python worker and the JVM beside it each hold a batch,
    and rows of whole texts fill the default of 64 MB."""
    spark.conf.set(BATCHES, "4m" if spark.conf.get(BATCHES) == "67108864b" else spark.conf.get(BATCHES))


@contextmanager
def cleaned(spark: SparkSession, clean: bool) -> Iterator[None]:
    """With `clean` the files of an execution's exchanges go as soon as it ends. Else they stay on the executors' disks until the driver
    happens to collect its garbage, beside the stage that holds the same rows."""
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true" if clean else before)
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


def durable(df: DataFrame, clean: bool = False) -> DataFrame:
    """The same rows from a reliable checkpoint, so that no lost executor can change what later steps read. For `clean`, see `cleaned`."""
    shared_dir(df.sparkSession)
    with cleaned(df.sparkSession, clean):
        # A frame keeps the setting under which it was made.
        return (df.select("*") if clean else df).checkpoint(eager=True)


def written(df: DataFrame, name: str, clean: bool = False) -> DataFrame:
    """The same rows from a compressed Parquet table in the shared folder; for stages that carry texts or long arrays. For `clean`, see
    `cleaned`."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    with cleaned(spark, clean):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, folder: str) -> None:
    """Deletes a folder of durable stages that nothing reads any more."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(folder))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def subfolders(spark: SparkSession, folder: str) -> list[str]:
    """The finished tables in a folder, by name."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(folder))
    system = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = [f.getPath() for f in system.listStatus(path)] if system.exists(path) else []
    return sorted(f"{folder}/{p.getName()}" for p in found if system.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))


def discard(table: DataFrame) -> None:
    """Deletes a table made by `written`, once all that was computed from it is itself durable."""
    for folder in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
        remove(table.sparkSession, folder)


def ranked(rows: DataFrame, tree: str, keys: list[str]) -> DataFrame:
    """Adds pos, a row's place from 0 in its tree by `keys` (nulls first), and size, its tree's rows.

    Rows are range-partitioned and sorted over all trees, made durable, and counted by partition and tree, so a tree
    of any size is spread over partitions. Only these counts are summed up.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = durable(rows.repartitionByRange(parts, tree, *keys).sortWithinPartitions(tree, *keys).withColumn("__at", F.monotonically_increasing_id()))
    ordered = ordered.withColumn("__part", F.shiftright("__at", 33))
    counts = ordered.groupBy("__part", tree).agg(F.count(F.lit(1)).alias("__n"), F.min("__at").alias("__first"))
    # One row for each partition and tree that meet.
    each = Window.partitionBy(tree)
    starts = counts.select("__part", tree, "__first", (F.sum("__n").over(each.orderBy("__part")) - F.col("__n")).alias("__start"), F.sum("__n").over(each).alias("size"))
    placed = ordered.join(starts, ["__part", tree])
    return placed.withColumn("pos", F.col("__start") + F.col("__at") - F.col("__first")).drop("__part", "__at", "__first", "__start")


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers (the splitmix64 finaliser)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, 1 << 16), base, dtype=np.uint64)
        have[0] = 1
        np.cumprod(have, out=have)
        _powers[base] = have if len(have) <= 2 * SLICE_BYTES else have[: 2 * SLICE_BYTES].copy()
    return have[:n]


def slices(batch: pa.RecordBatch, column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Row ranges of a batch that hold about `most` bytes of a text column each; a longer text stands alone."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    first, total = 0, 0
    for i, size in enumerate(sizes.tolist()):
        if i > first and total + size > most:
            yield batch.slice(first, i - first)
            first, total = i, 0
        total += size
    if batch.num_rows > first:
        yield batch.slice(first)


def squeezed(docs: DataFrame, level: int = 3) -> DataFrame:
    """The rows with `text` replaced by `packed`, its UTF-8 bytes as a zstd frame (a null text is empty): whole texts that an
    exchange must carry take less than half of their bytes so."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=level)
        for batch in batches:
            rest = [n for n in batch.schema.names if n != "text"]
            for part in slices(batch, "text"):
                frames = pa.array([squeeze.compress((t or "").encode()) for t in part.column("text").to_pylist()], pa.binary())
                yield pa.RecordBatch.from_arrays([*(part.column(n) for n in rest), frames], [*rest, "packed"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields if f.name != "text")
    return docs.mapInArrow(run, f"{fields}, packed binary")


def restored(batches: Iterator[pa.RecordBatch], most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of about `most` text bytes each, with `packed` turned back into `text`; a longer text stands alone."""
    inflate = zstandard.ZstdDecompressor()
    for batch in batches:
        rest = [n for n in batch.schema.names if n != "packed"]
        frames = batch.column("packed")
        first, texts, total = 0, [], 0
        for i in range(batch.num_rows + 1):
            text = inflate.decompress(frames[i].as_py()).decode() if i < batch.num_rows else None
            if texts and (text is None or total + len(text) > most):
                part = batch.slice(first, len(texts))
                yield pa.RecordBatch.from_arrays([*(part.column(n) for n in rest), pa.array(texts, pa.string())], [*rest, "text"])
                first, texts, total = i, [], 0
            if text is not None:
                texts.append(text)
                total += len(text)


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts in a row and the offsets of each text in them; a null text is empty."""
    texts = pc.fill_null(texts, "").cast(pa.large_binary())
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    buffer = texts.buffers()[2]
    data = np.frombuffer(buffer, dtype=np.uint8)[offsets[0] : offsets[-1]] if buffer is not None else np.empty(0, np.uint8)
    return data, offsets - offsets[0]


def word_spans(data: np.ndarray, offsets: np.ndarray, blank: np.ndarray = IS_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text number of each word; no word crosses from one text into the next. `blank` marks the bytes between words."""
    n = len(data)
    inside = ~blank[data]
    edges = offsets[(offsets > 0) & (offsets < n)]
    before = np.zeros(n, dtype=bool)
    before[1:] = inside[:-1]
    before[edges] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.zeros(n, dtype=bool)
    after[:-1] = inside[1:]
    after[edges - 1] = False
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


def hash_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word, from prefix sums of byte values weighted by powers of an odd base."""
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(BASE, len(data)), out=sums[1:])
    hashes = (sums[ends] - sums[starts]) * powers(BASE_INVERSE, len(data))[starts] if len(starts) else np.empty(0, np.uint64)
    return mix(hashes + (ends - starts).astype(np.uint64))


def hash_runs(words: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """A hash of each k consecutive words: entry i covers words i .. i+k-1."""
    n = len(words) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    total, weight, by = np.full(n, seed, dtype=np.uint64), 1, 0xD6E8FEB86659FD93
    for j in range(k):
        total += words[j : j + n] * np.uint64(weight)
        weight = weight * by % 2**64
    return mix(total)


def trees(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of edges (a, b), ascending, and for each the smallest node that these edges reach."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[x], root[y])
        up = root.copy()
        np.minimum.at(up, root[x], low)
        np.minimum.at(up, root[y], low)
        while not np.array_equal(up, up[up]):
            up = up[up]
        if np.array_equal(up, root):
            return nodes, nodes[root]
        root = up


def contracted(edges: DataFrame, most: int) -> DataFrame:
    """(a, b): the nodes of each run of up to `most` edges of a partition, hung on the smallest node that the run's edges reach (itself
    too). The same nodes are connected as before; a run gives a row for each of its nodes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def told() -> pa.RecordBatch:
            node, least = trees(*(np.concatenate([batch.column(c).to_numpy() for batch in held]) for c in ("a", "b")))
            return pa.RecordBatch.from_arrays([pa.array(node), pa.array(least)], ["a", "b"])

        for whole in batches:
            for lo in range(0, whole.num_rows, most):
                batch = whole.slice(lo, most)
                if held and n + batch.num_rows > most:
                    yield told()
                    held, n = [], 0
                held.append(batch)
                n += batch.num_rows
        if n:
            yield told()

    return edges.select("a", "b").mapInArrow(run, "a long, b long")


def gathered(edges: DataFrame, most: int, clean: bool = False) -> tuple[DataFrame, bool]:
    """(a, b) of every node in `edges`, hung on the smallest node that its part sees, and whether one part saw all edges, so that these
    are final. Each partition contracts its own edges first, then partitions are joined up to `most` rows and do so again."""
    now = durable(contracted(edges, most), clean)
    with cleaned(now.sparkSession, clean):
        parts = now.coalesce(now.sparkSession.sparkContext.defaultParallelism).count() // most + 1
    return durable(contracted(now.coalesce(parts), most), clean), parts == 1


def connected(edges: DataFrame, most: int = EDGES) -> DataFrame:
    """(node, component) of every node in `edges` (columns a, b; repeats and loops are allowed): the smallest node reachable.

    Each partition first hangs its nodes on the smallest ones that it sees itself, which leaves a row for each node of a partition.
    Then partitions are joined up to `most` rows and do so again; if all rows fit one, its labels are final. If not,
    labels spread over the edges that are left and then along labels (node -> label -> label of label), so chains halve in
    each round; each round is a durable table. Work per round is in proportion to the edges.
    """
    now, whole = gathered(edges, most)
    if whole:
        return now.toDF("node", "component")
    both = durable(now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = durable(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("component")))
    while True:
        near = both.join(labels, both.b == labels.node).groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        step = labels.join(near, "node").select("node", "component", F.least("component", "near").alias("next"))
        jump = labels.select(F.col("node").alias("next"), F.col("component").alias("far"))
        step = step.join(jump, "next", "left").select("node", "component", F.least("next", F.coalesce("far", "next")).alias("next"))
        step = durable(step)
        labels = step.select("node", F.col("next").alias("component"))
        if not step.where("next < component").limit(1).count():
            break
    return labels


def fold(text: Column) -> Column:
    """Lower-cases A-Z alone."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
