"""N-gram Jaccard join: a blocked sparse product of the document by n-gram incidence, with size-derived bounds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalframe.llm.common import TO_LOWER, connected, discard, durable, hash_runs, hash_words, mix, slices, text_bytes, word_spans, written

#: Sets of up to SMALL n-grams are indexed whole; of larger ones, the n-grams that hash into this share of the hash space
#: (never fewer than the prefix that the bound needs).
SMALL, SHARE = 64, 0.4
LIMIT = np.uint64(int(SHARE * 2**64))
#: Members of one n-gram's list that make up one side of a block of the product.
BLOCK = 1024
#: Lists that a member of a block names, first by rank, of those in which it met others before.
BEFORE = 8
#: N-grams of one block of columns when their holders are counted.
COLUMNS = 500_000


def shingle_sets(batch: pa.RecordBatch, k: int) -> list[np.ndarray]:
    """The sorted distinct k-word n-gram hashes of each text of a slice; of fewer words, one for the whole sequence."""
    data, offsets = text_bytes(batch.column("text"))
    data = TO_LOWER[data]
    starts, ends, text = word_spans(data, offsets)
    words = hash_words(data, starts, ends)
    runs = hash_runs(words, k)
    first = np.searchsorted(text, np.arange(batch.num_rows + 1))
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= k:
            out.append(np.unique(runs[a : b - k + 1]))
        else:
            out.append(hash_runs(words[a:b], b - a, seed=b - a) if b > a else np.empty(0, np.uint64))
    return out


def misses(n: np.ndarray | int, percent: int) -> np.ndarray | int:
    """How many n-grams of a set of n can be absent from a set it links with: n - ceil(percent n / 100)."""
    return n - (percent * n + 99) // 100


def sketch(grams: np.ndarray) -> bytes:
    """Parities of a set's n-grams in buckets, at least two for each n-gram. Two sets differ in at least as many n-grams as
    their parities do; a longer sketch folds to a shorter one's buckets."""
    buckets = 64
    while buckets < 2 * len(grams):
        buckets *= 2
    odd = np.bincount((grams & np.uint64(buckets - 1)).astype(np.int64), minlength=buckets) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def differences(sketches: list[bytes], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each pair of row numbers, a number of n-grams by which its sets differ at least."""
    widths = np.array([len(x) // 8 for x in sketches], dtype=np.int64)
    least, out = np.minimum(widths[a], widths[b]), np.zeros(len(a), np.int64)
    for width in np.unique(least).tolist():
        at = np.flatnonzero(least == width)
        used, own = np.unique(np.concatenate([a[at], b[at]]), return_inverse=True)
        rows = np.stack([np.bitwise_xor.reduce(np.frombuffer(sketches[i], np.uint64).reshape(-1, width), axis=0) for i in used.tolist()])
        x, y = own[: len(at)], own[len(at) :]
        step = max(1, 250_000 // width)
        for k in range(0, len(at), step):
            out[at[k : k + step]] = np.bitwise_count(rows[x[k : k + step]] ^ rows[y[k : k + step]]).sum(axis=1)
    return out


def met_before(before: pa.ListArray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each pair of row numbers, whether its lists of numbers have one in common."""
    values = before.flatten().to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(before)), np.diff(before.offsets.to_numpy()))
    _, number, count = np.unique(values, return_inverse=True, return_counts=True)
    shared = count > 1
    at = shared[number]
    columns = int(shared.sum())
    out = np.zeros(len(a), bool)
    if columns and len(a):
        marks = np.zeros((len(before), columns), bool)
        marks[row[at], (np.cumsum(shared) - 1)[number[at]]] = True
        packed = np.packbits(marks, axis=1)
        step = max(1, 2_000_000 // packed.shape[1])
        for k in range(0, len(a), step):
            out[k : k + step] = (packed[a[k : k + step]] & packed[b[k : k + step]]).any(axis=1)
    return out


FEATURES = "rid long, doc_id long, version long, n long, s1 long, s2 long, stored int, grams binary, sketch binary"


def features(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """Each document's row number, set size, a 128-bit signature and a sketch of its set, and its indexed n-grams in hash order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rid = TaskContext.get().partitionId() << 40
        for batch in batches:
            for part in slices(batch, "text"):
                sets = shingle_sets(part, k)
                n = np.array([len(s) for s in sets], dtype=np.int64)
                s1 = np.array([int(s.sum(dtype=np.uint64)) for s in sets], dtype=np.uint64).astype(np.int64)
                s2 = np.array([int(mix(s ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64)) for s in sets], dtype=np.uint64).astype(np.int64)
                held = [s if len(s) <= SMALL else s[: max(int(np.searchsorted(s, LIMIT)), misses(len(s), percent) + 1)] for s in sets]
                rids = pa.array(range(rid, rid + len(sets)), pa.int64())
                rid += len(sets)
                values = (rids, part.column("doc_id"), part.column("version"), pa.array(n), pa.array(s1), pa.array(s2), pa.array([len(h) for h in held], pa.int32()), pa.array([h.tobytes() for h in held], pa.binary()), pa.array([sketch(s) for s in sets], pa.binary()))
                yield pa.RecordBatch.from_arrays(list(values), ["rid", "doc_id", "version", "n", "s1", "s2", "stored", "grams", "sketch"])

    return versioned(docs).mapInArrow(run, FEATURES)


def versioned(docs: DataFrame) -> DataFrame:
    """Ids and texts with a hash of the text, which tells rows of one id, or of none, apart."""
    return docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("version"), "text")


def repeated_grams(classes: DataFrame, parts: int) -> DataFrame:
    """(g, df): n-grams that more than one class holds. Columns of the incidence go in blocks of the hash space, each block's part
    of a batch as one sorted array, summed within the batch before it moves."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4000):
                grams = [np.frombuffer(x.as_py(), np.uint64) for x in batch.column("grams").slice(at, 4000)]
                g, n = np.unique(np.concatenate(grams), return_counts=True)
                block = (g >> np.uint64(40)) * np.uint64(parts) >> np.uint64(24)
                edges = np.searchsorted(block, np.arange(parts + 1))
                rows = [(i, g[a:b].tobytes(), n[a:b].astype("<i4").tobytes()) for i, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)) if b > a]
                yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], t) for j, t in enumerate((pa.int32(), pa.binary(), pa.binary()))], ["block", "g", "n"])

    def add(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        g = np.concatenate([np.frombuffer(x, np.uint64) for x in rows["g"]])
        n = np.concatenate([np.frombuffer(x, "<i4") for x in rows["n"]])
        order = np.argsort(g, kind="stable")
        g, n = g[order], n[order].astype(np.int64)
        first = np.flatnonzero(np.append(True, g[1:] != g[:-1]))
        total = np.add.reduceat(n, first)
        return pd.DataFrame({"g": g[first].view(np.int64)[total > 1], "df": total[total > 1]})

    return classes.select("grams").mapInArrow(split, "block int, g binary, n binary").groupBy("block").applyInPandas(add, "g long, df long")


def explode_grams(classes: DataFrame) -> DataFrame:
    """(g, cid) of every indexed n-gram."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cid = batch.column("cid").to_numpy()
            sizes = batch.column("stored").to_numpy()
            for at in range(0, batch.num_rows, 2000):
                raw = b"".join(x.as_py() for x in batch.column("grams").slice(at, 2000))
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(raw, np.int64)), pa.array(np.repeat(cid[at : at + 2000], sizes[at : at + 2000]))], ["g", "cid"])

    return classes.select("cid", "stored", "grams").mapInArrow(run, "g long, cid long")


#: Whether an n-gram lies in the part of the hash space that large sets index; LIMIT is under 2**63, so hashes read as signed keep
#: their order there.
INSIDE = f"(g >= 0 and g < {int(LIMIT)})"


def prefixes(classes: DataFrame, held: DataFrame, percent: int) -> DataFrame:
    """(g, cid, n, r, own) of the n-grams at which linked classes must meet; r is the n-gram's rank in its class, own how many
    that class alone has.

    One order holds for all n-grams: inside the indexed part of the hash space by how many classes hold it, then by
    hash; the rest after them by hash. Two linked sets share an n-gram among the first misses + 1 of each. Ranks count
    the n-grams that no other class holds, which come first; where a small set's rank isn't known, a lower one is used.
    """
    ranked = held.withColumn("inside", F.expr(INSIDE)).selectExpr(
        "*",
        "count_if(inside) over (partition by cid) as dup",
        "row_number() over (partition by cid order by not inside, if(inside, df, 0), g < 0, g) as r",
    )
    single = F.col("within") - F.col("dup")
    allowed = F.expr(f"n - ({percent} * n + 99) div 100 + 1")
    met = ranked.join(classes.select("cid", "n", "within"), "cid").withColumn("own", single).withColumn("r", F.col("r") + single).where(F.col("r") <= allowed)
    return met.select("g", "cid", "n", "r", "own")


def can_link(percent: int) -> str:
    """Two sets whose first common n-gram has ranks a_r and b_r share at most it and what follows it in the shorter rest; that
    must reach the overlap which a link of sets of a_n and b_n needs."""
    return f"(1 + least(a_n - a_r, b_n - b_r)) * (100 + {percent}) >= {percent} * (a_n + b_n) and 100 * least(a_n, b_n) >= {percent} * greatest(a_n, b_n)"


def with_rows(pairs: DataFrame, rows: DataFrame) -> DataFrame:
    """Adds the columns of both classes' rows as a_* and b_*."""
    left = rows.select(*[F.col(c).alias(f"a_{c}") for c in rows.columns])
    right = rows.select(*[F.col(c).alias(f"b_{c}") for c in rows.columns])
    return pairs.join(left, F.col("a") == F.col("a_cid")).join(right, F.col("b") == F.col("b_cid"))


def bounded(pairs: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose sketches don't show that they differ too much to link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                part = batch.slice(lo, 1000)
                n, at = part.num_rows, np.arange(part.num_rows)
                apart = differences([*part.column("a_sketch").to_pylist(), *part.column("b_sketch").to_pylist()], at, at + n)
                both = part.column("a_n").to_numpy() + part.column("b_n").to_numpy()
                keep = pa.array(apart * (100 + percent) <= (100 - percent) * both)
                yield pa.RecordBatch.from_arrays([part.column("a"), part.column("b")], ["a", "b"]).filter(keep)

    return with_rows(pairs, sketches).select("a", "b", "a_n", "b_n", "a_sketch", "b_sketch").mapInArrow(run, "a long, b long")


def verified(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """Pairs whose whole sets link. Sets are made anew from `texts`, one text (cid, s1, text) of each class."""
    needed = pairs.select(F.explode(F.array("a", "b")).alias("cid")).distinct()
    asked = texts.join(needed, "cid", "left_semi")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                found = shingle_sets(part, k)
                sums = pa.array(np.array([int(s.sum(dtype=np.uint64)) for s in found], dtype=np.uint64).astype(np.int64))
                same = pc.equal(sums, part.column("s1"))
                ends = np.cumsum([0, *(len(s) for s in found)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(found).view(np.int64)))
                yield pa.RecordBatch.from_arrays([part.column("cid"), lists], ["cid", "set"]).filter(same)

    made = written(asked.mapInArrow(sets, "cid long, set array<long>"), "sets")
    wide = with_rows(pairs, made).withColumn("common", F.expr("size(array_intersect(a_set, b_set))"))
    links = durable(wide.where(f"100 * common >= {percent} * (size(a_set) + size(b_set) - common)").select("a", "b"))
    discard(made)
    return links


def similar_classes(docs: DataFrame, k: int = 5, percent: int = 80, stars: int = 2) -> tuple[DataFrame, DataFrame]:
    """(features, classes): documents with their set signatures, and classes of equal sets with their component.

    1. Documents with equal sets form a class; only classes are joined, so copies never pair.
    2. n-grams held by one class alone can't link anything; a class with more of them than it may miss is out. What is
       left is the incidence's lists of classes by n-gram, cut to the prefixes at which linked classes must meet.
    3. Star rounds: in each list that still spans components, one class meets the members of other components: first the one with
       the fewest n-grams of its own, as the text has that near copies were made from, then in each list one of its own by
       hash. A round makes at most one pair for each member of a list; pairs are bounded and verified, and links join components. A list whose members have come together is done, so a
       large family of near copies costs a multiple of its size and not its square.
    4. All pairs of different components in the lists that are left meet in blocks of BLOCK members, so that no link is
       missed.
    """
    spark = docs.sparkSession
    rows = written(features(docs, k, percent), "features")
    groups = rows.where("n > 0").groupBy("s1", "s2", "n").agg(F.min("doc_id").alias("rep"), F.min(F.struct("rid", "doc_id", "version")).alias("row")).select("s1", "s2", "n", "rep", "row", "row.rid")
    classes = durable(groups.withColumn("cid", F.monotonically_increasing_id()))
    # Any row of a class has its set.
    indexed = written(rows.select("rid", "stored", "grams", "sketch").join(classes.select("rid", "cid", "n"), "rid").select("cid", "n", "stored", "grams", "sketch"), "indexed")
    # From here on, documents go by their signatures, and each table goes when those made from it are durable.
    signed = written(rows.select("doc_id", "n", "s1", "s2"), "signatures")
    discard(rows)

    total = indexed.agg(F.sum("stored")).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(total // COLUMNS) + 1)
    many = repeated_grams(indexed, parts)
    held = written(explode_grams(indexed).join(many, "g"), "held")
    info = inside_counts(indexed)
    discard(indexed)
    for _ in range(2):
        # Out: classes with more n-grams of their own than a link may miss. Their n-grams no longer count for others.
        dup = held.groupBy("cid").agg(F.count_if(F.expr(INSIDE)).alias("dup"))
        alive = dup.join(info.select("cid", "n", "within"), "cid").where(f"within - dup <= n - ({percent} * n + 99) div 100").select("cid")
        own = held.join(alive, "cid").select("g", "cid")
        fewer = written(own.join(own.groupBy("g").agg(F.count(F.lit(1)).alias("df")).where("df > 1"), "g"), "held")
        discard(held)
        held = fewer
    sketches = written(info.join(held.select("cid").distinct(), "cid"), "sketches")
    discard(info)
    lists = written(prefixes(sketches.select("cid", "n", "within"), held, percent), "lists")
    discard(held)
    sketches = sketches.select("cid", "n", "sketch")

    part_of = durable(lists.select("cid").distinct().withColumn("component", F.col("cid")))
    # Texts of the classes that can still link move here once, so that no round moves those of all documents.
    # A class goes by one row's id and text hash, so rows without an id or with the same one don't all meet; of equal rows one is taken.
    keyed = F.coalesce("doc_id", F.lit(-(2**63))).alias("key")
    reps = lists.select("cid").distinct().join(classes.select("cid", "s1", "row.doc_id", "row.version"), "cid").select("cid", "s1", keyed, "version")
    texts = written(versioned(docs).select(keyed, "version", "text").join(reps, ["key", "version"]).dropDuplicates(["key", "version"]).select("cid", "s1", "text"), "texts")
    for round_ in range(stars + 1):
        now = lists.join(part_of, "cid")
        lead = F.min(F.struct("own" if round_ == 0 else F.xxhash64(F.lit(round_), "cid", "g").alias("own"), "cid", "component", "n", "r"))
        members = [F.bit_xor(F.xxhash64(F.lit(seed), "cid")).alias(f"m{seed}") for seed in (1, 2)]
        spans = now.groupBy("g").agg(lead.alias("lead"), F.min("component").alias("first"), F.max("component").alias("last"), F.count(F.lit(1)).alias("size"), F.min("r").alias("rank"), *members).where("first < last")
        # Lists with the same members ask the same; the first of them by rank is enough, for bounds hold where two sets meet first.
        spans = spans.groupBy("size", "m1", "m2").agg(F.min(F.struct("rank", "g", "lead")).alias("one")).select("size", "one.g", "one.lead")
        open_ = now.join(spans, "g")
        if round_ < stars:
            pairs = open_.where("component <> lead.component").selectExpr("least(cid, lead.cid) as a", "greatest(cid, lead.cid) as b", "n as a_n", "lead.n as b_n", "r as a_r", "lead.r as b_r").where(can_link(percent))
            near = durable(bounded(pairs.select("a", "b").distinct(), sketches, percent))
        else:
            near = durable(block_pairs(open_, sketches, percent).distinct())
        if near.limit(1).count():
            links = verified(near, texts, k, percent)
            # Components take the place of their classes.
            crossing = links.join(part_of.toDF("a", "x"), "a").join(part_of.toDF("b", "y"), "b").selectExpr("x as a", "y as b")
            parted = connected(crossing).select(F.col("node").alias("component"), F.col("component").alias("c"))
            part_of = durable(part_of.join(parted, "component", "left").select("cid", F.coalesce("c", "component").alias("component")))
    discard(texts)
    # A component goes by the smallest document of its classes.
    named = classes.join(part_of, "cid", "left").withColumn("component", F.coalesce("component", "cid"))
    smallest = named.groupBy("component").agg(F.min("rep").alias("component_id"))
    return signed, named.join(smallest, "component").select("s1", "s2", "n", "component_id")


def inside_counts(indexed: DataFrame) -> DataFrame:
    """(cid, n, within, sketch): how many of a class's n-grams lie in the indexed part of the hash space, and its sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            within = [int(np.searchsorted(np.frombuffer(x.as_py(), np.uint64), LIMIT)) for x in batch.column("grams")]
            yield pa.RecordBatch.from_arrays([batch.column("cid"), batch.column("n"), pa.array(within, pa.int64()), batch.column("sketch")], ["cid", "n", "within", "sketch"])

    return written(indexed.select("cid", "n", "grams", "sketch").mapInArrow(run, "cid long, n long, within long, sketch binary"), "info")


def block_pairs(open_: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of different components in the lists that can still link. Members of a list are dealt into chunks of about
    BLOCK and each two chunks of it meet in one block, so no list makes a large group. A block compares ranks and sizes,
    then sketches, and pairs below the bounds don't leave it. Neither do pairs that meet in an earlier list, as far as
    the first BEFORE lists of both tell; the list in which two classes meet first by rank always hands them on."""
    firsts = open_.groupBy("cid").agg(F.slice(F.array_sort(F.collect_list(F.struct("r", "g"))), 1, BEFORE).alias("firsts"))
    told = open_.join(sketches.select("cid", "sketch").join(firsts, "cid"), "cid").withColumn("before", F.expr("transform(filter(firsts, x -> x.r < r), x -> x.g)"))
    dealt = told.selectExpr("g", "cid", "n", "r", "component", "sketch", "before", f"cast(ceil(size / {BLOCK}) as int) as chunks", f"cast(pmod(xxhash64(cid, g), ceil(size / {BLOCK})) as int) as own")
    sent = dealt.selectExpr("g", "struct(own, cid, component, n, r, sketch, before) as m", "explode(sequence(0, chunks - 1)) as other").selectExpr("g", "least(m.own, other) as i", "greatest(m.own, other) as j", "m")
    met = sent.groupBy("g", "i", "j").agg(F.collect_list("m").alias("ms")).select("i", "j", "ms")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("ms")
            ends = lists.offsets.to_numpy()
            own, cid, component, n, r = (lists.values.field(c).to_numpy(zero_copy_only=False) for c in ("own", "cid", "component", "n", "r"))
            sketched, before = lists.values.field("sketch"), lists.values.field("before")
            crossing = (batch.column("i").to_numpy() != batch.column("j").to_numpy()).tolist()
            left, right = [], []
            for lo, hi, two in zip(ends[:-1].tolist(), ends[1:].tolist(), crossing, strict=True):
                n_, c_, p_, last = n[lo:hi], cid[lo:hi], component[lo:hi], n[lo:hi] - r[lo:hi]
                keep = (p_[:, None] != p_[None, :]) & (c_[:, None] < c_[None, :])
                keep &= (1 + np.minimum(last[:, None], last[None, :])) * (100 + percent) >= percent * (n_[:, None] + n_[None, :])
                keep &= 100 * np.minimum(n_[:, None], n_[None, :]) >= percent * np.maximum(n_[:, None], n_[None, :])
                if two:
                    keep &= own[lo:hi, None] != own[None, lo:hi]
                a, b = np.nonzero(keep)
                if len(a):
                    near = differences(sketched[lo:hi].to_pylist(), a, b) * (100 + percent) <= (100 - percent) * (n_[a] + n_[b])
                    a, b = a[near], b[near]
                    new = ~met_before(before[lo:hi], a, b)
                    left.append(c_[a[new]])
                    right.append(c_[b[new]])
            if left:
                # Pairs that several lists of the batch make leave it once.
                a, b = np.concatenate(left), np.concatenate(right)
                order = np.lexsort((b, a))
                a, b = a[order], b[order]
                first = np.ones(len(a), bool)
                first[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
                yield pa.RecordBatch.from_arrays([pa.array(a[first]), pa.array(b[first])], ["a", "b"])

    return met.mapInArrow(run, "a long, b long")


def components(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles and component_id of every document.

    Words are lower-cased in A-Z; a set holds the distinct k-word n-grams, or the whole sequence if it has fewer words. Two
    documents link when 100 * intersection >= percent * union; component_id is the smallest doc_id reachable. A null,
    empty or blank text has an empty set and stands alone. Repeated rows link as equal sets do. A null doc_id takes its
    component's smallest id, null if there is none. An empty table gives no rows. n-grams are compared by 64-bit and
    sets by 128-bit hashes.
    """
    rows, named = similar_classes(docs, k, percent)
    return rows.select("doc_id", "n", "s1", "s2").join(named, ["s1", "s2", "n"], "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def keep_one(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The documents with one of each group kept: the one with the smallest doc_id. A row repeated whole stays once;
    documents without a doc_id stay unless a document with one is in their group."""
    found = components(docs, k, percent).where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("__kept")).distinct()
    met = docs.join(found, F.col("doc_id").eqNullSafe(F.col("__kept")), "left_semi")
    return met.dropDuplicates(["doc_id", "text"])
