"""Substring deduplication over a log-structured fingerprint index: sorted immutable runs, merge-joined with each new batch."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import reduce
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalframe.llm.common import discard, hash_runs, hash_words, mix, remove, restored, shared_dir, slices, squeezed, subfolders, text_bytes, word_spans, written

#: Words of a window, and of the grams among which a window's fingerprint is the least hash.
WINDOW, GRAM = 13, 6
#: Runs that an index may hold; the merge that would add one more than it makes a single run of all.
FAN_IN = 2
LAST = 2**63 - 1


def window_hashes(part: pa.RecordBatch, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For every window of a slice's texts: its text's row, its place there, its fingerprint (the least hash of its grams)
    and its own hash.

    Equal windows have equal fingerprints, and neighbouring windows mostly share one, so fingerprints are few.
    """
    data, offsets = text_bytes(part.column("text"))
    starts, ends, text = word_spans(data, offsets)
    words = hash_words(data, starts, ends)
    whole = hash_runs(words, window, seed=1)
    n = len(whole)
    least, width, want = hash_runs(words, gram), 1, window - gram + 1
    while width < want:
        step = min(width, want - width)
        least = np.minimum(least[:-step], least[step:])
        width += step
    own = text[:n] == text[window - 1 : window - 1 + n] if n else np.empty(0, bool)
    first = np.searchsorted(text, np.arange(part.num_rows + 1))
    return text[:n][own], (np.arange(n) - first[text[:n]])[own], least[:n][own], whole[own]


def postings(docs: DataFrame, window: int, gram: int) -> DataFrame:
    """(g, doc): the distinct fingerprints of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                row, _, g, _ = window_hashes(part, window, gram)
                # Neighbours mostly share a fingerprint; without those, there is less to sort.
                head = np.ones(len(g), bool)
                head[1:] = (g[1:] != g[:-1]) | (row[1:] != row[:-1])
                row, g = row[head], g[head]
                order = np.lexsort((g, row))
                row, g = row[order], g[order]
                new = np.ones(len(g), bool)
                new[1:] = (g[1:] != g[:-1]) | (row[1:] != row[:-1])
                ids = part.column("doc").to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays([pa.array(g[new].view(np.int64)), pa.array(ids[row[new]].astype(np.int64))], ["g", "doc"])

    return docs.mapInArrow(run, "g long, doc long")


def spans(docs: DataFrame, window: int, gram: int) -> DataFrame:
    """(g, s, doc, version, at, hs): spans of neighbouring windows with one fingerprint g of the document's list `gs`, the place of the first
    and the hashes of all. Equal windows have equal (g, h), equal spans equal (g, s): 128 bits each. Copies of a passage
    mostly have equal spans.
    """
    most = window - gram + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in restored(batches):
            row, at, g, h = window_hashes(part, window, gram)
            ids, versions = (part.column(c).to_numpy(zero_copy_only=False) for c in ("doc", "version"))
            lists = part.column("gs")
            owner = np.repeat(np.arange(part.num_rows), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
            # A window stays if its fingerprint is listed for its row. Pairs are told apart by one number; a chance
            # equality lets a window in that is then compared like the others.
            listed = np.unique(lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64) + mix(owner.astype(np.uint64)))
            head = np.ones(len(g), bool)
            head[1:] = (g[1:] != g[:-1]) | (row[1:] != row[:-1])
            asked = g[head] + mix(row[head].astype(np.uint64))
            known = listed[np.minimum(np.searchsorted(listed, asked), len(listed) - 1)] == asked if len(listed) else np.zeros(len(asked), bool)
            keep = known[np.cumsum(head) - 1]
            row, at, g, h = row[keep], at[keep], g[keep], h[keep]
            n = len(h)
            new = np.ones(n, bool)
            new[1:] = (row[1:] != row[:-1]) | (g[1:] != g[:-1]) | (at[1:] != at[:-1] + 1)
            place = np.arange(n)
            new |= (place - np.maximum.accumulate(np.where(new, place, 0))) % most == 0
            first = np.flatnonzero(new)
            length = np.diff(np.append(first, n))
            whole = mix(np.add.reduceat(mix(h + (place - np.repeat(first, length)).astype(np.uint64)), first) + length.astype(np.uint64)) if n else h
            hs = pa.ListArray.from_arrays(pa.array(np.append(first, n).astype(np.int32)), pa.array(h.view(np.int64)))
            row = row[first]
            yield pa.RecordBatch.from_arrays([pa.array(g[first].view(np.int64)), pa.array(whole.view(np.int64)), pa.array(ids[row].astype(np.int64)), pa.array(versions[row].astype(np.int64)), pa.array(at[first].astype(np.int32)), hs], ["g", "s", "doc", "version", "at", "hs"])

    return docs.select("doc", "version", "packed", "gs").mapInArrow(run, "g long, s long, doc long, version long, at int, hs array<long>")


def beside_equals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds `shared` to rows (g, new, doc) that come sorted by g, new ones first: another row has the same g and the first of them is new.

    Rows at a partition's edge, whose neighbours are elsewhere, count as shared. Only one batch is held at a time.
    """
    held, before, new_head = None, None, True
    for batch in chain((b for b in batches if b.num_rows), [None]):
        if held is not None:
            g, new = held.column("g").to_numpy(), held.column("new").to_numpy(zero_copy_only=False)
            after = None if batch is None else batch.column("g")[0].as_py()
            same = np.concatenate([[before is None or before == g[0]], g[1:] == g[:-1], [after is None or after == g[-1]]])
            head = np.maximum.accumulate(np.where(same[:-1], -1, np.arange(len(g))))
            by_new = np.where(head < 0, new_head, new[head])
            yield pa.RecordBatch.from_arrays([held.column("g"), held.column("doc"), held.column("new"), pa.array((same[:-1] | same[1:]) & by_new)], ["g", "doc", "new", "shared"])
            before, new_head = g[-1], by_new[-1]
        held = batch


class Index:
    """Runs of postings (g, doc) sorted by fingerprint, in a folder all executors share. A run is never changed: a batch adds one, and
    the merge that would make more than `fan_in` of them writes all postings as a single run, after which the others go.

    A run's file holds its own postings (`held`) and, beside them in the same order, the older ones that they met. An
    index on a folder that has runs goes on from them.
    """

    SCHEMA = "g long, doc long, held boolean, shared boolean"

    def __init__(self, spark: SparkSession, folder: str | None = None, fan_in: int = FAN_IN):
        self.spark, self.fan_in = spark, fan_in
        self.folder = folder or f"{shared_dir(spark)}/index-{uuid.uuid4().hex}"
        self.runs = subfolders(spark, self.folder) if folder else []

    def add(self, rows: DataFrame) -> DataFrame:
        """Merges rows (g, doc) with the postings of all runs and writes them as a run. Returns, as a written table, (g, doc) of all
        whose fingerprint another posting has and one of `rows`."""
        compact = bool(self.runs) and len(self.runs) + 1 >= self.fan_in
        path = f"{self.folder}/run-{len(self.runs)}-{uuid.uuid4().hex}"
        merge = rows.select("g", F.lit(True).alias("new"), "doc")
        if self.runs:
            merge = merge.union(self.rows().select("g", F.lit(False), "doc"))
        marked = merge.sort("g", F.desc("new"), "doc").mapInArrow(beside_equals, "g long, doc long, new boolean, shared boolean")
        held = F.lit(True) if compact else F.col("new")
        marked.select("g", "doc", held.alias("held"), "shared").where("held or shared").write.option("compression", "zstd").parquet(path)
        found = written(self.read([path]).where("shared").select("g", "doc"), "found")
        if compact:
            for run in self.runs:
                remove(self.spark, run)
            self.runs = []
        self.runs.append(path)
        return found

    def read(self, runs: list[str]) -> DataFrame:
        return self.spark.read.schema(self.SCHEMA).parquet(*runs)

    def rows(self) -> DataFrame | None:
        return self.read(self.runs).where("held").select("g", "doc") if self.runs else None

    def drop(self) -> None:
        """Deletes all runs."""
        remove(self.spark, self.folder)
        self.runs = []


def candidates(batch: DataFrame, index: Index, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(g, doc): fingerprints that a document of the batch shares with another one of the batch or of the index, with all documents that have
    them. A fingerprint that one document alone has rules its windows out. The batch's postings join the index.

    Batch and runs meet in one merge by fingerprint, so a fingerprint of many documents is spread over tasks. A few listed
    fingerprints may be of one document alone; that costs work, but doesn't change what is found.
    """
    return index.add(postings(batch, window, gram))


def repeats(corpus: DataFrame, per: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(doc, version, runs): places of windows whose words also start in a document with a smaller doc, as runs (at, n) of neighbours.

    `corpus` holds doc, packed text and version (a hash that parts the texts of rows which share a doc), `per` each
    document's candidates (doc, gs). The windows with listed fingerprints are made anew from the texts, in spans. A span
    that an earlier document has goes whole; windows are compared one by one only where spans of one fingerprint differ,
    and then for the first documents of each span, which have all there are.
    """
    rows = written(spans(corpus.join(per, "doc"), window, gram), "spans")
    # A table, so that the join meets rows and not the aggregation that made them: a span of very many documents is split there.
    firsts = written(rows.groupBy("g", "s").agg(F.min("doc").alias("low")), "firsts")
    several = firsts.groupBy("g").agg((F.min("s") < F.max("s")).alias("several"))
    met = rows.join(firsts.join(several, "g"), ["g", "s"]).where("doc > low or several")
    met = written(met.select("g", "doc", "version", "at", F.size("hs").alias("n"), F.when(F.col("doc") == F.col("low"), F.col("hs")).alias("hs")), "met")
    discard(rows)
    discard(firsts)
    copies = met.where("hs is null").select("doc", "version", "at", "n")
    single = met.where("hs is not null").select("g", "doc", "version", "at", F.posexplode("hs").alias("k", "h")).withColumn("at", F.expr("at + k")).drop("k")
    least = written(single.groupBy("g", "h").agg(F.min("doc").alias("low")), "least")
    later = single.join(least, ["g", "h"]).where("doc > low").select("doc", "version", "at", F.lit(1).alias("n"))
    return copies.union(later).groupBy("doc", "version").agg(F.collect_list(F.struct("at", "n")).alias("runs"))


def strip(docs: DataFrame, found: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents (doc, packed text and others) with covered words removed, as text: kept words joined by one blank. Adds n_words and n_removed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in restored(batches):
            texts, n_words, n_removed = [], [], []
            for text, runs in zip(batch.column("text"), batch.column("runs"), strict=True):
                words = (text.as_py() or "").encode().split()
                gone = np.zeros(len(words) + 1, np.int32)
                if runs.is_valid:
                    at, n = (runs.values.field(c).to_numpy() for c in ("at", "n"))
                    np.add.at(gone, at, 1)
                    np.add.at(gone, at + n - 1 + window, -1)
                kept = [w for w, g in zip(words, np.cumsum(gone[:-1]).tolist(), strict=True) if not g]
                texts.append(b" ".join(kept).decode())
                n_words.append(len(words))
                n_removed.append(len(words) - len(kept))
            rest = [n for n in batch.schema.names if n not in ("text", "runs")]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in rest), pa.array(texts), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64())], [*rest, "text", "n_words", "n_removed"])

    met = docs.join(found, ["doc", "version"], "left")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in met.schema.fields if f.name not in ("packed", "runs"))
    return met.mapInArrow(run, f"{fields}, text string, n_words long, n_removed long")


def dedup_substrings(docs: DataFrame, batches: int = 2, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """Removes each word that a window of `window` words covers if that sequence of words also starts in a document with a
    smaller doc_id. Windows are judged on the input.

    The corpus passes in `batches` ranges of doc_id from small to large, each against the index of those before, as it
    would arrive over time; the result doesn't depend on their number. Returns doc_id, text (kept words joined by one
    blank), n_words and n_removed. A null text has no words; a null doc_id counts as the largest; rows that share a
    doc_id count as one document and don't repeat each other. An empty table gives no rows.
    """
    corpus = docs.select("doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("doc"), F.xxhash64("text").alias("version"), "text")
    low, high = corpus.where("doc_id is not null").agg(F.min("doc"), F.max("doc")).first()
    index, listed = Index(docs.sparkSession), []
    edges = [(low or 0) + ((high or 0) - (low or 0)) * k // batches for k in range(1, batches)] + [LAST]
    for k, edge in enumerate(edges):
        batch = corpus.where(F.col("doc") <= edge)
        if k:
            batch = batch.where(F.col("doc") > edges[k - 1])
        listed.append(candidates(batch.select("doc", "text"), index, window, gram))
    index.drop()
    per = written(reduce(DataFrame.union, listed).groupBy("doc").agg(F.collect_set("g").alias("gs")), "listed")
    for found in listed:
        discard(found)
    packed = squeezed(corpus)
    return strip(packed, repeats(packed, per, window, gram), window).select("doc_id", "text", "n_words", "n_removed")
