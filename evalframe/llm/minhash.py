"""MinHash near-duplicates: universal hash minima in bands, checked by signature and on whole sets, joined within partitions, then by large-star and small-star."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalframe.llm.common import EDGES, cleaned, discard, durable, gathered, mix, restored, slices, squeezed, written
from evalframe.llm.ngram_join import differences, shingle_sets, sketch, with_rows

#: Bands and minima in each: two sets of similarity 0.8 miss each other in all bands in 5 of 10**9 cases.
BANDS, ROWS = 48, 5
#: Chance that the signatures of two sets at the bound agree in fewer places than `agreeing` asks for.
MISSED = 1e-9
#: Members of a bucket that make up one side of a block.
BLOCK = 4096
_seeds = np.random.default_rng(20260713)
#: Universal hashing of 64-bit numbers: x -> a * x + b modulo 2**64, a odd.
A = _seeds.integers(0, 2**63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
B = _seeds.integers(0, 2**64 - 1, BANDS * ROWS, dtype=np.uint64)


def agreeing(percent: int) -> int:
    """How many of the minima two sets at the bound have in common at least, but for a chance of MISSED."""
    n, p = BANDS * ROWS, percent / 100
    below, term = 0.0, (1 - p) ** n
    for k in range(n):
        below += term
        if below > MISSED:
            return k
        term *= (n - k) / (k + 1) * p / (1 - p)
    return n


def minima(sets: list[np.ndarray]) -> np.ndarray:
    """A row of 16-bit digests of the minima of each set's hashes; sets mustn't be empty."""
    out = np.empty((len(sets), len(A)), np.uint16)
    if sets:
        x = np.concatenate(sets)
        starts = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]])
        for j, (a, b) in enumerate(zip(A, B, strict=True)):
            out[:, j] = mix(np.minimum.reduceat(x * a + b, starts)) >> np.uint64(48)
    return out


FEATURES = "doc_id long, version long, n long, s1 long, s2 long, signature binary, sketch binary"


def features(docs: DataFrame, k: int) -> DataFrame:
    """Each row's id and a hash of its text, the size of its set, a 128-bit digest of the set, and its signature and parities (null if
    empty)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                sets = shingle_sets(part, k)
                n = np.array([len(s) for s in sets], dtype=np.int64)
                s1 = np.array([int(s.sum(dtype=np.uint64)) for s in sets], dtype=np.uint64).astype(np.int64)
                s2 = np.array([int(mix(s ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64)) for s in sets], dtype=np.uint64).astype(np.int64)
                found = iter(minima([s for s in sets if len(s)]))
                signatures = [next(found).tobytes() if m else None for m in n.tolist()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("version"), pa.array(n), pa.array(s1), pa.array(s2), pa.array(signatures, pa.binary()), pa.array([sketch(x) if len(x) else None for x in sets], pa.binary())], ["doc_id", "version", "n", "s1", "s2", "signature", "sketch"])

    return versioned(docs).mapInArrow(run, FEATURES)


def versioned(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("version"), "text")


def band_keys(signatures: list[bytes]) -> np.ndarray:
    """A 64-bit hash of each band's number and digests, for each signature."""
    weights = mix(np.arange(1, ROWS + 1, dtype=np.uint64)) | np.uint64(1)
    s = np.frombuffer(b"".join(signatures), np.uint16).reshape(-1, BANDS, ROWS).astype(np.uint64)
    return mix((mix(s + np.uint64(1)) * weights).sum(axis=2) + mix(np.arange(BANDS, dtype=np.uint64)))


def banded(classes: DataFrame) -> DataFrame:
    """(bucket, band, cid) of every class and band."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cid = batch.column("cid").to_numpy()
            for at in range(0, batch.num_rows, 2000):
                bucket = band_keys(batch.column("signature").slice(at, 2000).to_pylist())
                bands = np.tile(np.arange(BANDS, dtype=np.int32), len(bucket))
                yield pa.RecordBatch.from_arrays([pa.array(bucket.ravel().view(np.int64)), pa.array(bands), pa.array(np.repeat(cid[at : at + 2000], BANDS))], ["bucket", "band", "cid"])

    return classes.select("cid", "signature").mapInArrow(run, "bucket long, band int, cid long")


def can_link(percent: int) -> str:
    return f"100 * least(a_n, b_n) >= {percent} * greatest(a_n, b_n)"


def alike(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose signatures agree in enough places."""
    least = agreeing(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                part = batch.slice(lo, 1000)
                a, b = (np.frombuffer(b"".join(part.column(c).to_pylist()), np.uint16).reshape(part.num_rows, -1) for c in ("a_signature", "b_signature"))
                yield pa.RecordBatch.from_arrays([part.column("a"), part.column("b")], ["a", "b"]).filter(pa.array((a == b).sum(axis=1) >= least))

    met = with_rows(pairs, classes.select("cid", "n", "signature")).where(can_link(percent))
    return met.select("a", "b", "a_signature", "b_signature").mapInArrow(run, "a long, b long")


def block_pairs(open_: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of different components, from buckets that hold several, whose signatures agree in enough places and whose parities
    don't show that they differ too much.

    A bucket's members are dealt into chunks of about BLOCK, and each two chunks meet in one block, so no bucket makes a large
    group. In a block, those outside its commonest component meet the rest. A pair leaves the first band in which its
    signatures agree, and no other.
    """
    least = agreeing(percent)
    told = open_.join(classes.select("cid", "n", "signature", "sketch"), "cid").withColumn("chunks", F.expr(f"int(ceil(size / {BLOCK}))"))
    dealt = told.withColumn("own", F.expr("int(pmod(xxhash64(cid, bucket), chunks))")).selectExpr("bucket", "band", "struct(own, cid, component, n, signature, sketch) as m", "explode(sequence(0, chunks - 1)) as other")
    met = dealt.groupBy("bucket", "band", F.expr("least(m.own, other)").alias("i"), F.expr("greatest(m.own, other)").alias("j")).agg(F.collect_list("m").alias("ms")).select("band", "i", "j", "ms")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                ms = batch.column("ms")[row].values
                own, cid, part, n = (ms.field(c).to_numpy() for c in ("own", "cid", "component", "n"))
                signatures, sketches = ms.field("signature").to_pylist(), ms.field("sketch").to_pylist()
                s, keys = np.frombuffer(b"".join(signatures), np.uint16).reshape(len(cid), -1), band_keys(signatures)
                band, two = batch.column("band")[row].as_py(), batch.column("i")[row].as_py() != batch.column("j")[row].as_py()
                found, size = np.unique(part, return_counts=True)
                common = part == found[size.argmax()]
                rest = np.flatnonzero(~common)
                for lo in range(0, len(rest), 32):
                    x = rest[lo : lo + 32]
                    keep = (part[x, None] != part[None, :]) & (common[None, :] | (cid[x, None] < cid[None, :]))
                    keep &= 100 * np.minimum(n[x, None], n[None, :]) >= percent * np.maximum(n[x, None], n[None, :])
                    if two:
                        keep &= own[x, None] != own[None, :]
                    a, b = np.nonzero(keep)
                    a = x[a]
                    for at in range(0, len(a), 4000):
                        l, r = a[at : at + 4000], b[at : at + 4000]
                        good = (keys[l] == keys[r]).argmax(axis=1) == band
                        l, r = l[good], r[good]
                        good = (s[l] == s[r]).sum(axis=1) >= least
                        l, r = l[good], r[good]
                        if len(l):
                            good = differences(sketches, l, r) * (100 + percent) <= (100 - percent) * (n[l] + n[r])
                            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(cid[l], cid[r])[good]), pa.array(np.maximum(cid[l], cid[r])[good])], ["a", "b"])

    return met.mapInArrow(run, "a long, b long")


def candidate_texts(docs: DataFrame, needed: DataFrame) -> DataFrame:
    """(cid, packed): the text of one row of each class in `needed` (cid, rep), found by id and hash of text. Texts move as zstd frames,
    once for all rounds."""
    wanted = needed.select("cid", F.col("rep.doc_id").alias("__id"), F.col("rep.version").alias("__version"))
    met = squeezed(versioned(docs)).join(wanted, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("version") == F.col("__version")))
    # A row repeated whole gives its text once.
    return written(met.select("cid", "packed").dropDuplicates(["cid"]), "texts", clean=True)


def verified(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """Pairs whose whole sets link. Sets are made anew from the texts."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in restored(batches):
            found = shingle_sets(part, k)
            ends = np.cumsum([0, *(len(s) for s in found)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([part.column("cid"), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(found).view(np.int64)))], ["cid", "set"])

    asked = pairs.select(F.col("a").alias("cid")).union(pairs.select(F.col("b").alias("cid"))).distinct()
    made = written(texts.join(asked, "cid", "left_semi").mapInArrow(sets, "cid long, set array<long>"), "sets", clean=True)
    wide = with_rows(pairs, made).withColumn("common", F.expr("size(array_intersect(a_set, b_set))"))
    links = durable(wide.where(f"100 * common >= {percent} * (size(a_set) + size(b_set) - common)").select("a", "b"), clean=True)
    discard(made)
    return links


def large_star(edges: DataFrame) -> DataFrame:
    """Each node's larger neighbours hang on the least of itself and its neighbours."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy("a").agg(F.min("b").alias("m"))
    return both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.least("a", "m").alias("b")).where("a <> b").distinct()


def small_star(edges: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours hang on the least of these."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    low = down.groupBy("a").agg(F.min("b").alias("m"))
    return down.join(low, "a").where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b"))).distinct()


def starred(edges: DataFrame, most: int = EDGES) -> DataFrame:
    """(node, component) of every node of `edges` (columns a, b): the smallest node reachable.

    Partitions hang their nodes on the smallest ones that they see themselves; if all that is left fits one of `most` rows, that
    is final. If not, large-star and small-star take turns, each round durable, until the edges are stars that no round
    changes; edges stay as few as they were."""
    now, whole = gathered(edges.where("a <> b"), most, clean=True)
    if whole:
        return now.toDF("node", "component")
    now, before = durable(now.where("a <> b").distinct(), clean=True), None
    while True:
        now = durable(small_star(large_star(now)), clean=True)
        with cleaned(now.sparkSession, True):
            state = tuple(now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.bit_xor(F.xxhash64("b", "a"))).first())
        if state == before:
            break
        before = state
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct()


def near_classes(docs: DataFrame, k: int = 4, percent: int = 80, stars: int = 2) -> tuple[DataFrame, DataFrame]:
    """(features, classes): rows with their sets' digests, and classes of equal sets with their component.

    1. Rows with equal sets form a class; only classes meet, so copies never pair.
    2. Classes that agree in all minima of a band share a bucket.
    3. Star rounds: in each bucket that holds several components, the members meet one of them: first the one whose buckets have the
       most members, as the text has that near copies were made from, then the first in an order of all classes, so that
       a family meets the same one in all bands. Pairs that pass signatures and whole sets link, and links join
       components. A large family of near copies costs a multiple of its size.
    4. All pairs of different components in the buckets that still hold several meet in blocks.

    Each stage is durable, and what its exchanges carried goes from the executors' disks with it.
    """
    rows = written(features(docs, k), "features", clean=True)
    rep = F.min(F.struct("doc_id", "version"))
    groups = rows.where("n > 0").groupBy("s1", "s2", "n").agg(rep.alias("rep"), F.min("doc_id").alias("smallest"), F.first("signature").alias("signature"), F.first("sketch").alias("sketch"))
    classes = written(groups.withColumn("cid", F.monotonically_increasing_id()), "classes", clean=True)
    signed = written(rows.select("doc_id", "n", "s1", "s2"), "signed", clean=True)
    discard(rows)
    every = banded(classes)
    buckets = written(every.join(every.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).where("size > 1"), "bucket"), "buckets", clean=True)
    texts = candidate_texts(docs, buckets.select("cid").distinct().join(classes, "cid"))
    part_of = durable(classes.select("cid", F.col("cid").alias("component")), clean=True)
    met = durable(buckets.groupBy("cid").agg(F.sum("size").alias("met")), clean=True)
    for round_ in range(stars + 1):
        now = buckets.join(part_of, "cid").join(met, "cid")
        order = -F.col("met") if round_ == 0 else F.xxhash64(F.lit(round_), "cid")
        lead = F.min(F.struct(order.alias("order"), "cid", "component"))
        members = [F.bit_xor(F.xxhash64(F.lit(seed), "cid")).alias(f"m{seed}") for seed in (1, 2)]
        spans = now.groupBy("bucket", "band").agg(lead.alias("lead"), F.min("component").alias("first"), F.max("component").alias("last"), F.first("size").alias("size"), *members).where("first < last")
        # Of buckets with the same members the first band's is enough.
        spans = spans.groupBy("size", "m1", "m2").agg(F.min(F.struct("band", "bucket", "lead")).alias("one")).select("one.bucket", "one.lead")
        open_ = now.join(spans, "bucket")
        if round_ < stars:
            asked = open_.where("component <> lead.component").selectExpr("least(cid, lead.cid) as a", "greatest(cid, lead.cid) as b").distinct()
            near = durable(alike(asked, classes, percent), clean=True)
        else:
            near = durable(block_pairs(open_, classes, percent), clean=True)
        if not near.isEmpty():
            links = verified(near, texts, k, percent)
            crossing = links.join(part_of.toDF("a", "x"), "a").join(part_of.toDF("b", "y"), "b").selectExpr("x as a", "y as b")
            parted = starred(crossing).select(F.col("node").alias("component"), F.col("component").alias("c"))
            part_of = durable(part_of.join(parted, "component", "left").select("cid", F.coalesce("c", "component").alias("component")), clean=True)
    discard(buckets)
    discard(texts)
    named = classes.select("cid", "s1", "s2", "n", "smallest").join(part_of, "cid")
    least = named.groupBy("component").agg(F.min("smallest").alias("component_id"))
    return signed, named.join(least, "component").select("s1", "s2", "n", "component_id")


def near_duplicates(docs: DataFrame, k: int = 4, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row.

    Words are lower-cased in A-Z; a set holds the distinct k-word shingles, or the whole sequence if it has fewer words. Two rows
    link when 100 * intersection >= percent * union, confirmed on whole sets; component_id is the smallest doc_id
    reachable. A null, empty or blank text has an empty set and stands alone. Repeated rows link as equal sets do and are
    all kept if their id is the component's. A null doc_id takes its component's smallest id, null if there is none, and
    is kept where it stays null. An empty table gives no rows; other columns take no part. Shingles are compared by
    64-bit and sets by 128-bit hashes. A link at the bound shares no band, or fails the signatures' bound, in some 6 of 10**9 cases.
    """
    rows, named = near_classes(docs, k, percent)
    found = rows.join(named, ["s1", "s2", "n"], "left")
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return found.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))
