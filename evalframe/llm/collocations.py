"""Phrase collocations: n-grams counted in counting quotient filters, scored by their weakest cut."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evalframe.llm.common import TO_LOWER, discard, durable, mix, ranked, slices, text_bytes, word_spans, written

#: Bytes that end a piece, and those that part the words of one.
BREAKS, BLANKS = b".,;:!?\x0a\x0b\x0c\x0d", b"\x20\x09"
IS_BREAK = np.zeros(256, dtype=bool)
IS_BREAK[list(BREAKS)] = True
BETWEEN = IS_BREAK.copy()
BETWEEN[list(BLANKS)] = True
#: Counters that one shard of the merged filter holds at most, about.
SHARD = 1_000_000
ROUNDS = tuple(np.uint64(0x9E3779B97F4A7C15 * k % 2**64) for k in (1, 2, 3, 4))

BLOCK = "block long, langs array<string>, words array<string>, counts array<long>, codes binary"


def coded(docs: DataFrame) -> DataFrame:
    """Texts in blocks, one for each Arrow batch: the distinct (language, word) pairs of the block with their counts, commonest
    first, and all its words in order as a zstd frame of 32-bit numbers of these pairs from 1, with 0 between pieces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze, block = zstandard.ZstdCompressor(level=3), TaskContext.get().partitionId() << 32
        for batch in batches:
            words, langs, opens = [], [], []
            names = batch.column("lang").dictionary_encode()
            own, row = names.indices.to_numpy(), 0
            for part in slices(batch, "text"):
                data, offsets = text_bytes(part.column("text"))
                data = TO_LOWER[data]
                starts, ends, text = word_spans(data, offsets, BETWEEN)
                ends_ = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int32)
                words.append(pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(ends_), pa.py_buffer(data[~BETWEEN[data]])]))
                langs.append(own[row + text])
                piece = np.cumsum(IS_BREAK[data])[starts] if len(starts) else starts
                opens.append(np.append(True, (piece[1:] != piece[:-1]) | (text[1:] != text[:-1]))[: len(starts)])
                row += part.num_rows
            found = pa.chunked_array(words, pa.binary()).combine_chunks()
            if not len(found):
                continue
            found = (found.chunk(0) if isinstance(found, pa.ChunkedArray) else found).dictionary_encode()
            several = len(names.dictionary)
            pairs, code, n = np.unique(found.indices.to_numpy().astype(np.int64) * several + np.concatenate(langs), return_inverse=True, return_counts=True)
            order = np.argsort(-n, kind="stable")
            number = np.empty(len(order), np.uint32)
            number[order] = np.arange(1, len(order) + 1)
            at = np.arange(len(code)) + np.cumsum(np.concatenate(opens))
            sequence = np.zeros(at[-1] + 1, np.uint32)
            sequence[at] = number[code]
            columns = (names.dictionary.take(pa.array(pairs[order] % several)), found.dictionary.take(pa.array(pairs[order] // several)).cast(pa.string()), pa.array(n[order]))
            lists = [pa.ListArray.from_arrays(pa.array([0, len(order)], pa.int32()), c) for c in columns]
            yield pa.RecordBatch.from_arrays([pa.array([block]), *lists, pa.array([squeeze.compress(sequence.tobytes())], pa.binary())], ["block", "langs", "words", "counts", "codes"])
            block += 1

    return docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text").mapInArrow(run, BLOCK)


def permuted(hi: np.ndarray, lo: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Scrambles n-grams packed as (2 * width bits, width bits), one to one: each half in turn is changed by a hash of the other."""
    high, low = np.uint64(2 ** (2 * width) - 1), np.uint64(2**width - 1)
    for k in ROUNDS:
        lo = lo ^ (mix(hi + k) & low)
        hi = hi ^ (mix(lo ^ k) & high)
    return hi, lo


def restored(hi: np.ndarray, lo: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Undoes `permuted`."""
    high, low = np.uint64(2 ** (2 * width) - 1), np.uint64(2**width - 1)
    for k in reversed(ROUNDS):
        hi = hi ^ (mix(lo ^ k) & high)
        lo = lo ^ (mix(hi + k) & low)
    return hi, lo


def added(hi: np.ndarray, lo: np.ndarray, n: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct (hi, lo) with their counts summed. Sorted runs one after another merge in a stable sort."""
    if not len(hi):
        return hi, lo, n
    if 3 * width <= 64:
        order = np.argsort(hi << np.uint64(width) | lo, kind="stable")
    else:
        order = np.lexsort((lo, hi))
    hi, lo, n = hi[order], lo[order], n[order]
    first = np.flatnonzero(np.append(True, (hi[1:] != hi[:-1]) | (lo[1:] != lo[:-1])))
    return hi[first], lo[first], np.add.reduceat(n, first)


def planes(x: np.ndarray, bits: int) -> bytes:
    """The least bytes of each number that hold so many bits, byte by byte."""
    size = -(-bits // 8)
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :size].T).tobytes()


def joined(data: np.ndarray, bits: int, m: int) -> np.ndarray:
    """The numbers that `planes` laid out."""
    size = -(-bits // 8)
    out = np.zeros((m, 8), np.uint8)
    out[:, :size] = data[: size * m].reshape(size, m).T
    return out.reshape(-1).view("<u8").astype(np.uint64)


def filled(hi: np.ndarray, lo: np.ndarray, n: np.ndarray, width: int, prefix: int) -> tuple[int, bytes]:
    """(quotient bits, filter) of sorted distinct keys that agree in their first `prefix` bits.

    The next bits of a key are its quotient, of about as many values as there are keys; the rest is its remainder. The filter holds
    a bit for each quotient that occurs, a bit for each slot that ends its quotient's run, the remainders in slot
    order, and each slot's count in groups of seven bits. Nothing is lost: quotient and remainder make up the key.
    """
    m, rest = len(hi), 2 * width - prefix
    bits = min(rest, max(3, m.bit_length() - 1))
    quotient = (hi >> np.uint64(rest - bits)).astype(np.int64) & (2**bits - 1)
    occupied, ends = np.zeros(2**bits, bool), np.ones(m, bool)
    occupied[quotient] = True
    ends[:-1] = quotient[1:] != quotient[:-1]
    counters, left = [], n.astype(np.uint64)
    while len(left):
        more = left > 127
        counters.append(np.uint8(128) * more + (left & np.uint64(127)).astype(np.uint8))
        left = left[more] >> np.uint64(7)
    remainders = planes(hi & np.uint64(2 ** (rest - bits) - 1), rest - bits) + planes(lo, width)
    return bits, np.packbits(occupied).tobytes() + np.packbits(ends).tobytes() + remainders + b"".join(c.astype(np.uint8).tobytes() for c in counters)


def emptied(data: bytes, m: int, bits: int, width: int, prefix: int, shard: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The keys and counts of a filter of m slots, in order."""
    raw, rest = np.frombuffer(data, np.uint8), 2 * width - prefix
    cut = -(-(2**bits) // 8)
    quotients = np.flatnonzero(np.unpackbits(raw[:cut], count=2**bits))
    ends = np.unpackbits(raw[cut : cut + -(-m // 8)], count=m).astype(np.int64)
    raw = raw[cut + -(-m // 8) :]
    high = joined(raw, rest - bits, m)
    raw = raw[-(-(rest - bits) // 8) * m :]
    lo = joined(raw, width, m)
    raw = raw[-(-width // 8) * m :]
    hi = np.uint64(shard << rest) | quotients[np.cumsum(ends) - ends].astype(np.uint64) << np.uint64(rest - bits) | high
    n, at, shift = np.zeros(m, np.int64), np.arange(m), 0
    while len(at):
        part, raw = raw[: len(at)], raw[len(at) :]
        n[at] += (part & 127).astype(np.int64) << shift
        at, shift = at[part > 127], shift + 7
    return hi, lo, n


def filters(blocks: DataFrame, width: int, prefix: int) -> DataFrame:
    """One filter for each block and shard that meet: the block's bigrams and trigrams of words with an id, the absent third being 0.
    A shard holds the keys that share their first `prefix` bits after the permutation."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        inflate, w = zstandard.ZstdDecompressor(), np.uint64(width)
        for batch in batches:
            for row in range(batch.num_rows):
                codes = np.frombuffer(inflate.decompress(batch.column("codes")[row].as_py()), np.uint32)
                ids = batch.column("ids")[row].values
                number = np.zeros(batch.column("distinct")[row].as_py() + 1, np.uint64)
                number[ids.field("at").to_numpy()] = ids.field("id").to_numpy().astype(np.uint64)
                x = number[codes]
                two = (x[:-1] > 0) & (x[1:] > 0)
                three = two[:-1] & two[1:]
                pair = x[:-1] << w | x[1:]
                hi, lo = np.concatenate([pair[two], pair[:-1][three]]), np.concatenate([np.zeros(two.sum(), np.uint64), x[2:][three]])
                hi, lo, n = added(*permuted(hi, lo, width), np.ones(len(hi), np.int64), width)
                shards, first = np.unique(hi >> np.uint64(2 * width - prefix), return_index=True)
                made = [(int(s), b - a, *filled(hi[a:b], lo[a:b], n[a:b], width, prefix)) for s, a, b in zip(shards, first.tolist(), [*first[1:].tolist(), len(hi)], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in made], t) for i, t in enumerate((pa.int32(), pa.int32(), pa.int32(), pa.binary()))], ["shard", "m", "bits", "filter"])

    return blocks.mapInArrow(run, "shard int, m int, bits int, filter binary")


def merged(made: DataFrame, width: int, prefix: int, least: int) -> DataFrame:
    """(a, b, c, f): word ids and counts of the n-grams that occur `least` times or more in all filters together; c is 0 in bigrams."""

    def merge(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        # The key comes as a 32-bit number of numpy, which a shift to the top of a wider key would cut off.
        shard = int(key[0])
        parts = [emptied(r.filter, r.m, r.bits, width, prefix, shard) for r in rows.itertuples()]
        hi, lo, n = added(*(np.concatenate([p[i] for p in parts]) for i in range(3)), width)
        hi, lo = restored(hi[n >= least], lo[n >= least], width)
        return pd.DataFrame({"a": (hi >> np.uint64(width)).astype(np.int64), "b": (hi & np.uint64(2**width - 1)).astype(np.int64), "c": lo.astype(np.int64), "f": n[n >= least]})

    return made.groupBy("shard").applyInPandas(merge, "a long, b long, c long, f long")


def counted(docs: DataFrame, least: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(totals, words, grams): lang and n, its word occurrences; id, lang, word and f of words that occur `least` times or more; the
    n-grams of two and three such words that do, as `merged` gives them. Others can't be part of a phrase that does.

    Texts become blocks of numbers once. A block asks for the ids of its distinct words by a join, so the vocabulary is
    neither collected nor sent to all tasks; the answer to a block is no longer than the block.
    """
    blocks = written(coded(docs), "blocks")
    pairs = blocks.select("block", F.posexplode(F.arrays_zip("langs", "words", "counts")).alias("at", "p")).select("block", (F.col("at") + 1).alias("at"), F.col("p.langs").alias("lang"), F.col("p.words").alias("word"), F.col("p.counts").alias("n"))
    vocabulary = durable(pairs.groupBy("lang", "word").agg(F.sum("n").alias("f")))
    totals = vocabulary.groupBy("lang").agg(F.sum("f").alias("n"))
    words = durable(ranked(vocabulary.where(F.col("f") >= least).withColumn("all", F.lit("")), "all", ["lang", "word"]).select((F.col("pos") + 1).alias("id"), "lang", "word", "f"))
    last, occurrences = words.agg(F.max("id"), F.sum("f")).first()
    width = max(4, (last or 1).bit_length())
    if width > 32:
        raise ValueError(f"{last} words: n-grams of ids of over 32 bits don't fit the packed form")
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), 2 * (occurrences or 0) // SHARD + 1)
    prefix = min(2 * width - 1, (parts - 1).bit_length())
    answers = pairs.join(words.select("id", "lang", "word"), ["lang", "word"]).groupBy("block").agg(F.collect_list(F.struct("at", "id")).alias("ids"))
    asked = blocks.select("block", "codes", F.size("words").alias("distinct")).join(answers, "block")
    grams = durable(merged(filters(asked.select("codes", "distinct", "ids"), width, prefix), width, prefix, least))
    discard(blocks)
    return totals, words, grams


#: floor(1000000 * a * a / (l * r)) in exact integers of up to 38 digits.
SCORE = "cast(cast(1000000 as decimal(7, 0)) * cast(a as decimal(15, 0)) * cast(a as decimal(15, 0)) div (cast({l} as decimal(15, 0)) * cast({r} as decimal(15, 0))) as long)"


def phrases(docs: DataFrame, least: int = 10, share: int = 50, top: int = 2000) -> DataFrame:
    """Each language's first `top` phrases of two or three words: lang, rank, phrase, a, l, r, n and score.

    Words are lower-cased in A-Z and counted within pieces, per language (null: `und`). A phrase that occurs a >= `least` times is
    cut where 1000000 * a * a / (l * r), floored, is least (the first such cut), l and r being how often its parts occur.
    A phrase inside a longer one of at least `share` percent of its occurrences is dropped. Order: score, then a,
    descending, then the phrase by bytes. Null and empty texts hold no words; repeated rows count each; other columns take no part.
    An empty table, or one without such phrases, gives no rows.
    """
    totals, words, grams = counted(docs, least)
    of = lambda x: words.select(F.col("id").alias(x), F.col("word").alias(f"w{x}"), F.col("f").alias(f"f{x}"), *([F.col("lang")] if x == "a" else []))
    named = grams.join(of("a"), "a").join(of("b"), "b").join(of("c"), "c", "left").withColumnRenamed("f", "count")
    two, three = named.where("c = 0"), named.where("c > 0")
    first = grams.where("c = 0").select("a", "b", F.col("f").alias("fab"))
    second = grams.where("c = 0").select(F.col("a").alias("b"), F.col("b").alias("c"), F.col("f").alias("fbc"))
    longest = three.select("a", "b", "count").union(three.select("b", "c", "count")).groupBy("a", "b").agg(F.max("count").alias("longer"))
    two = two.join(longest, ["a", "b"], "left").where(f"longer is null or 100 * longer < {share} * count")
    short = two.selectExpr("lang", "concat(wa, ' ', wb) as phrase", "count as a", "fa as l", "fb as r").withColumn("score", F.expr(SCORE.format(l="l", r="r")))
    cuts = three.join(first, ["a", "b"]).join(second, ["b", "c"]).selectExpr("lang", "concat(wa, ' ', wb, ' ', wc) as phrase", "count as a", "fa", "fbc", "fab", "fc")
    cuts = cuts.withColumn("s1", F.expr(SCORE.format(l="fa", r="fbc"))).withColumn("s2", F.expr(SCORE.format(l="fab", r="fc")))
    long = cuts.selectExpr("lang", "phrase", "a", "if(s1 <= s2, fa, fab) as l", "if(s1 <= s2, fbc, fc) as r", "least(s1, s2) as score")
    best = short.unionByName(long).withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))).where(F.col("rank") <= top)
    return best.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
