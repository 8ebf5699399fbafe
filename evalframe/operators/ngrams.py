"""N-gram tables: contamination, BLEU sums."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evalframe.functions.text import words


def coded_grams(tokens: Column, n: int) -> Column:
    """The n-grams of a token list as pairs of 64-bit hashes, repeats kept."""
    run = lambda i: F.slice(tokens, i, n)
    made = F.transform(F.sequence(F.lit(1), F.size(tokens) - (n - 1)), lambda i: F.struct(F.xxhash64(run(i)).alias("x"), F.xxhash64(F.lit(n), run(i)).alias("y")))
    return F.when(F.size(tokens) >= n, made).otherwise(F.array().cast("array<struct<x:bigint,y:bigint>>"))


def contaminated(docs: DataFrame, key: str, targets: DataFrame, n: int) -> DataFrame:
    """(key, hits): documents with the number of distinct n-grams that also stand in a target text.

    n-grams meet in a semi join as 128-bit hashes, so that 16 bytes of each move and not its words; only matches are counted.
    """
    # Words are a column of their own, so that they aren't split again for every n-gram.
    split = lambda df, *c: df.select(*c, words(F.lower("text")).alias("w"))
    # Spark's array_distinct compares all pairs of structs; sorted, equal ones stand together.
    coded = lambda df, *c: split(df, *c).select(*c, F.sort_array(coded_grams(F.col("w"), n)).alias("s"))
    once = F.filter("s", lambda p, i: (i == 0) | (p != F.get("s", i - 1)))
    own = coded(docs, key).select(key, F.inline(once))
    known = coded(targets).select(F.inline(once)).distinct()
    return own.join(known, ["x", "y"], "left_semi").groupBy(key).agg(F.count(F.lit(1)).alias("hits"))


#: Tokens of both sides that a Python worker takes at a time; a longer row stands alone.
TOKENS = 1_000_000


def met_grams(words: np.ndarray, text: np.ndarray, row: np.ndarray, second: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For runs of 1 .. `most` words, by row: how many both sides have (the lesser count of each), and how many the first and the second
    side have. Words are numbers, runs don't cross texts; time grows with the words alone."""
    code, several, at, rows = words.astype(np.int64), int(words.max(initial=0)) + 1, np.arange(len(words)), int(row.max(initial=-1)) + 1
    for k in range(1, most + 1):
        if k > 1:
            inside = at + k - 1 < len(words)
            at, code = at[inside], code[inside]
            inside = text[at] == text[at + k - 1]
            at, code = at[inside], code[inside]
            code = np.unique(code * several + words[at + k - 1], return_inverse=True)[1]
        wide = int(code.max(initial=0)) + 1
        found, which = np.unique(row[at] * wide + code, return_inverse=True)
        second_ = second[at]
        theirs = np.bincount(which[second_], minlength=len(found))
        mine = np.bincount(which[~second_], minlength=len(found))
        of = found // wide
        yield tuple(np.bincount(of, weights=n, minlength=rows).astype(np.int64) for n in (np.minimum(mine, theirs), mine, theirs))


def gram_sums(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Clipped matches m1 .. and totals t1 .. of each row's lists of words h and r, with their lengths hn and rn, beside its key."""
    names = ["key", "hn", "rn", *(f"{x}{k}" for k in range(1, most + 1) for x in "mt")]
    for batch in batches:
        lengths = [pc.fill_null(pc.list_value_length(batch.column(x)), 0).to_numpy(zero_copy_only=False) for x in "hr"]
        cuts = np.flatnonzero(np.diff(np.cumsum(lengths[0] + lengths[1]) // TOKENS)) + 1
        for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows], strict=True):
            part, sizes = batch.slice(lo, hi - lo), [n[lo:hi] for n in lengths]
            every = pa.concat_arrays([part.column("h").flatten(), part.column("r").flatten()]).dictionary_encode().indices.to_numpy()
            row = np.concatenate([np.repeat(np.arange(hi - lo), n) for n in sizes])
            second = np.arange(len(every)) >= sizes[0].sum()
            sums = [np.pad(x, (0, hi - lo - len(x))) for m, t, _ in met_grams(every, 2 * row + second, row, second, most) for x in (m, t)]
            yield pa.RecordBatch.from_arrays([part.column("key"), *(pa.array(x.astype(np.int64)) for x in (*sizes, *sums))], names)


def bleu(pairs: DataFrame, key: str, hyp: str, ref: str, most: int = 4) -> DataFrame:
    """Corpus BLEU by key: clipped matches and totals of 1- to 4-grams are row-local, counted for many rows together, then summed."""
    rows = pairs.select(F.col(key).alias("key"), words(F.lower(hyp)).alias("h"), words(F.lower(ref)).alias("r"))
    numbers = ["hn", "rn", *(f"{x}{n}" for n in range(1, most + 1) for x in "mt")]
    out = T.StructType([rows.schema["key"], *(T.StructField(c, T.LongType()) for c in numbers)])
    counted = rows.mapInArrow(lambda batches: gram_sums(batches, most), out).withColumnRenamed("key", key)
    sums = counted.groupBy(key).agg(*[F.sum(c).alias(c) for c in numbers])
    logs = sum((F.log(F.greatest(F.col(f"m{n}"), F.lit(1e-9)) / F.greatest(F.col(f"t{n}"), F.lit(1))) for n in range(1, most + 1)), F.lit(0.0)) / most
    brevity = F.when(F.col("hn") >= F.col("rn"), 0.0).otherwise(1 - F.col("rn") / F.greatest(F.col("hn"), F.lit(1)))
    return sums.select(key, F.round(100 * F.exp(logs + brevity), 6).alias("bleu"))
