"""Media columns as content-defined chunks: gear-hash cuts, one stored copy of each chunk, verified reconstruction."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalframe.llm.common import discard, mix, restored, slices, squeezed, written

UNIT = 192
LEAST, MASK_BITS, MOST = 1024, 11, 16384
#: Compression of texts on their way and of stored frames.
LEVEL = 9

#: Parts in which the texts move, so that an exchange holds that share of them beside the media written so far.
RUNS = 2

#: One random 64-bit number for each byte value.
GEAR = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def pad(text: str | None) -> tuple[int, bytes]:
    raw = (text or "").encode()
    return len(raw), raw + b" " * (UNIT - len(raw) if not raw else -len(raw) % UNIT)


def cuts(payload: bytes) -> list[int]:
    """Ends of the chunks. The gear hash of the last 64 bytes is summed by doubling windows; a chunk ends where its top
    bits are 0, after LEAST bytes at least and MOST at most."""
    n = len(payload)
    if n <= LEAST:
        return [n]
    h = GEAR[np.frombuffer(payload, dtype=np.uint8)]
    for k in (1, 2, 4, 8, 16, 32):
        h[k:] += h[:-k].copy() << np.uint64(k)
    ends, last = [], 0
    for i in (np.flatnonzero(h >> np.uint64(64 - MASK_BITS) == 0) + 1).tolist():
        while i - last > MOST:
            last += MOST
            ends.append(last)
        if i - last >= LEAST:
            ends.append(i)
            last = i
    while n - last > MOST:
        last += MOST
        ends.append(last)
    return ends if last == n else [*ends, n]


def chunks(payload: bytes) -> list[bytes]:
    ends = cuts(payload)
    return [payload[a:b] for a, b in zip([0, *ends], ends, strict=False)]


def digest_of(chunk: bytes) -> bytes:
    """The first 128 bits of the SHA-256."""
    return hashlib.sha256(chunk).digest()[:16]


def kept(names: list[bytes], frames: list[bytes]) -> bytes:
    """The bytes that are written for one medium, those in the shared table included: all digests, then all frames."""
    return b"".join(names) + b"".join(frames)


def features(payload: bytes) -> str:
    """Mean, deviation, zero crossings about the mean and entropy of the samples, with fixed decimals."""
    x = np.frombuffer(payload, dtype=np.uint8).astype(np.int64)
    n, total, squares = len(x), int(x.sum()), int((x * x).sum())
    above = x * n > total
    p = np.bincount(x, minlength=256)
    p = p[p > 0] / n
    return f"mean={total / n:.4f};std={max(0.0, squares / n - (total / n) ** 2) ** 0.5:.4f};cross={int((above[1:] != above[:-1]).sum())};entropy={-float((p * np.log2(p)).sum()):.4f}"


def digests(docs: DataFrame) -> DataFrame:
    """(row, digest) of every chunk, without its bytes; `row` is a hash of doc_id and text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                rows = [(k, digest_of(c)) for k, t in zip(part.column("row").to_pylist(), part.column("text").to_pylist(), strict=True) for c in chunks(pad(t)[1])]
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], ["row", "digest"])

    return docs.select(F.xxhash64("doc_id", "text").alias("row"), "text").mapInArrow(run, "row long, digest binary")


STORED = "doc_id long, n_bytes long, digests array<binary>, frames array<binary>, handed array<struct<digest: binary, frame: binary>>"


def store(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The media column and the table of shared chunks, both as written tables.

    A media row holds the ordered chunk list (digests) and a zstd frame for each chunk that occurs once in the corpus;
    a chunk that occurs again anywhere has a null frame there and one row (digest, frame) in the shared table. Digests
    alone are counted, and one row that has it hands on each repeated one; they meet the rows in a join, and each text,
    as one compressed frame, meets the list of those it holds in another. Nothing is sent to the driver, and what an
    exchange carried stays on disk no longer than its write. Texts move in RUNS parts by their row hash, one after another.
    """
    every = written(digests(docs), "digests")
    common = written(every.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.min("row").alias("first")).where("n > 1").select("digest", "first"), "shared-digests", clean=True)
    # Rows of equal hash share a list, which then only holds more of the repeated digests than each needs.
    again = every.join(common.hint("merge"), "digest").groupBy("row").agg(F.collect_set("digest").alias("again"), F.collect_set(F.when(F.col("first") == F.col("row"), F.col("digest"))).alias("hands"))
    texts = docs.select(F.xxhash64("doc_id", "text").alias("row"), F.col("doc_id").cast("long"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=LEVEL)
        for part in restored(batches):
            rows = []
            for doc, text, again, hands in zip(*(part.column(c).to_pylist() for c in ("doc_id", "text", "again", "hands")), strict=True):
                size, payload = pad(text)
                own, shared, handed = chunks(payload), {*(again or ())}, {*(hands or ())}
                names = [digest_of(c) for c in own]
                new = {d: c for d, c in zip(names, own, strict=True) if d in handed}
                frames = [None if d in shared else squeeze.compress(c) for d, c in zip(names, own, strict=True)]
                rows.append((doc, size, names, frames, [{"digest": d, "frame": squeeze.compress(c)} for d, c in new.items()]))
            pair = pa.list_(pa.struct([("digest", pa.binary()), ("frame", pa.binary())]))
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.list_(pa.binary()), pa.list_(pa.binary()), pair))],
                ["doc_id", "n_bytes", "digests", "frames", "handed"],
            )

    runs = []
    for k in range(RUNS):
        some = F.pmod("row", F.lit(RUNS)) == k
        moved = squeezed(texts.where(some), LEVEL).join(again.where(some).hint("merge"), "row", "left")
        runs.append(written(moved.select("doc_id", "packed", "again", "hands").mapInArrow(run, STORED), "media", clean=True))
    media = reduce(DataFrame.unionByName, runs)
    discard(every)
    discard(common)
    # Repeated rows hand on equal chunks; any of them will do.
    return media.drop("handed"), written(media.select(F.explode("handed").alias("c")).select("c.*").dropDuplicates(["digest"]), "shared-chunks", clean=True)


def rebuild(media: DataFrame, unique: DataFrame) -> DataFrame:
    """Reads media rows back: (doc_id, n_bytes, digests, frames) with every frame present.

    Rows that hold all their frames pass as they are. The others explode into their missing chunks, take these from
    the shared table by a join on the digest, and gather them again by row.
    """
    whole = "not exists(frames, f -> f is null)"
    partial = media.where(f"not ({whole})").withColumn("__row", F.monotonically_increasing_id())
    wanted = partial.select("__row", F.posexplode(F.arrays_zip("digests", "frames")).alias("seq", "c")).where("c.frames is null")
    filled = (
        wanted.select("__row", "seq", F.col("c.digests").alias("digest"))
        .join(unique, "digest")
        .groupBy("__row")
        .agg(F.map_from_entries(F.collect_list(F.struct("seq", "frame"))).alias("m"))
    )
    done = partial.join(filled, "__row").select("doc_id", "n_bytes", "digests", F.expr("transform(frames, (f, i) -> coalesce(f, m[i]))").alias("frames"))
    return media.where(whole).unionByName(done)


def describe(media: DataFrame) -> DataFrame:
    """Decodes rebuilt rows, verifies each chunk against its digest, and returns the payloads with their features.

    Returns doc_id, n_bytes, payload, kept (the digests and frames that were read) and feature. A chunk that doesn't
    match fails the job.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        inflate = zstandard.ZstdDecompressor()
        for batch in batches:
            for at in range(0, batch.num_rows, 100):
                part = batch.slice(at, 100)
                rows = []
                for doc, size, names, frames in zip(*(part.column(c).to_pylist() for c in ("doc_id", "n_bytes", "digests", "frames")), strict=True):
                    parts = [inflate.decompress(f) for f in frames]
                    if [digest_of(p) for p in parts] != names:
                        raise ValueError(f"a chunk of document {doc} differs from its digest")
                    payload = b"".join(parts)
                    rows.append((doc, size, payload, kept(names, frames), features(payload)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.string()))],
                    ["doc_id", "n_bytes", "payload", "kept", "feature"],
                )

    return media.mapInArrow(run, "doc_id long, n_bytes long, payload binary, kept binary, feature string")


def media_column(docs: DataFrame) -> DataFrame:
    """Stores every text of `docs` as a chunked medium, reads it back, verifies it and computes features.

    Payload: UTF-8 with bytes 32 up to a positive multiple of 192; a null or empty text is 192 blanks. Repeated rows,
    and rows of null or equal doc_id, give a row each. Extra columns take no part. An empty table gives no rows.
    Repeated digests meet the texts in joins at every size.
    """
    return describe(rebuild(*store(docs)))


__all__ = ["chunks", "describe", "features", "media_column", "pad", "rebuild", "store"]
