"""Caption scores: consensus of TF-IDF n-grams, longest common subsequences, and blank fills found in a response."""

from __future__ import annotations

from bisect import bisect_left
from difflib import SequenceMatcher
from itertools import accumulate

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evalframe.functions.text import REFUSALS, REFUSALS_IN_ANY_CASE
from evalframe.sources.io import durable

#: Width of the length penalty, weight of recall in the subsequence score.
SIGMA, BETA = 6.0, 1.2


def gram_counts(rows: DataFrame, keys: list[str], tokens: str, orders: int) -> DataFrame:
    """(keys, __k, __x, __y, __n): how often each run of k tokens, k = 1 .. orders, occurs in a row; runs go by 128-bit hashes."""
    starts = "filter(sequence(1, greatest(size({t}), 1)), i -> i <= size({t}) - k + 1)".format(t=tokens)
    run = f"slice({tokens}, i, k)"
    grams = f"inline(flatten(transform(sequence(1, {orders}), k -> transform({starts}, i -> struct(k as __k, xxhash64({run}) as __x, xxhash64(k, {run}) as __y)))))"
    return rows.selectExpr(*keys, grams).groupBy(*keys, "__k", "__x", "__y").agg(F.count(F.lit(1)).alias("__n"))


def consensus(guesses: DataFrame, references: DataFrame, key: str, tokens: str, ref: str, orders: int = 4) -> DataFrame:
    """(key, cider) of every guess (key, tokens), against the references (key, ref, tokens) of its key.

    An n-gram weighs its count times log(keys) - log(keys whose references hold it, at least 1). A pair's score is the mean over
    orders of the cosine of both vectors, each weight of the guess clipped to the reference's, times
    exp(-d * d / 72) for d the difference of their numbers of bigrams; a key's is ten times the mean over its references, 0
    without any. Vectors meet by key and n-gram, so no two keys' rows do. No join is a broadcast but that of the number of
    keys, so the driver holds no table.
    """
    texts = guesses.select(key, F.lit(True).alias("__own"), F.lit(None).cast(references.schema[ref].dataType).alias(ref), tokens)
    texts = texts.union(references.select(key, F.lit(False), ref, tokens)).where(F.col(key).isNotNull())
    counts = durable(gram_counts(texts, [key, "__own", ref], tokens, orders))
    # One row: the number of keys.
    keys = guesses.agg(F.log(F.count_distinct(key).cast("double")).alias("__all"))
    gram = ["__k", "__x", "__y"]
    held = counts.where("not __own").select(key, *gram).distinct().groupBy(*gram).agg(F.count(F.lit(1)).alias("__df"))
    rows = counts.join(held.hint("merge"), gram, "left").join(F.broadcast(keys))
    rows = rows.withColumn("__w", F.col("__n") * (F.col("__all") - F.log(F.greatest(F.coalesce("__df", F.lit(1)), F.lit(1)).cast("double"))))
    rows = rows.withColumn("__h", F.max(F.when(F.col("__own"), F.col("__w"))).over(Window.partitionBy(key, *gram)))
    length = F.sum(F.when(F.col("__k") == 2, F.col("__n")).otherwise(0))
    sums = rows.groupBy(key, "__own", ref, "__k").agg(F.sum(F.when(F.col("__h").isNotNull(), F.least("__h", "__w") * F.col("__w"))).alias("__dot"), F.count("__h").alias("__met"), F.sqrt(F.sum(F.col("__w") * F.col("__w"))).alias("__norm"), length.alias("__length"))
    # One row for each text and order; a text's length is that of its order 2.
    own = lambda c: F.max(F.when(F.col("__own"), F.col(c)))
    sums = sums.withColumn("__h_norm", own("__norm").over(Window.partitionBy(key, "__k"))).withColumn("__h_length", own("__length").over(Window.partitionBy(key)))
    sums = sums.withColumn("__r_length", F.max("__length").over(Window.partitionBy(key, "__own", ref)))
    gap = F.col("__h_length") - F.col("__r_length")
    pairs = sums.where("not __own and __met > 0 and __h_norm > 0 and __norm > 0").withColumn("__s", F.col("__dot") / (F.col("__h_norm") * F.col("__norm")) * F.exp(-gap * gap / (2 * SIGMA * SIGMA)))
    total = pairs.groupBy(key).agg((F.sum("__s") / orders).alias("__s"))
    many = references.groupBy(key).agg(F.count(F.lit(1)).alias("__refs"))
    met = guesses.select(key).join(total.hint("merge"), key, "left").join(many.hint("merge"), key, "left")
    return met.select(key, F.coalesce(10.0 * F.col("__s") / F.col("__refs"), F.lit(0.0)).alias("cider"))


def common_subsequence(a: Column, b: Column) -> Column:
    """The length of the longest common subsequence of two arrays of strings; a table row by row as a fold. Elements that the
    other array lacks take no part."""

    def length(x: Column, y: Column) -> Column:
        # A row's entry is the best up to that place: the entry before, or this place's, one more than the last row's before if it fits.
        cell = lambda row, v: lambda acc, z: F.struct((acc["j"] + 1).alias("j"), F.concat(acc["row"], F.array(F.greatest(F.element_at(acc["row"], -1), F.when(z == v, F.element_at(row, acc["j"]) + 1).otherwise(F.element_at(row, acc["j"] + 1))))).alias("row"))
        start = F.struct(F.lit(1).alias("j"), F.array(F.lit(0)).alias("row"))
        after = lambda row, v: F.aggregate(y, start, cell(row, v), lambda acc: acc["row"])
        return F.aggregate(x, F.array_repeat(F.lit(0), F.size(y) + 1), after, lambda row: F.element_at(row, -1))

    shared = F.array(F.struct(F.filter(a, lambda v: F.array_contains(b, v)).alias("x"), F.filter(b, lambda v: F.array_contains(a, v)).alias("y")))
    # The transform binds both arrays, so that they are made once.
    best = F.element_at(F.transform(shared, lambda s: F.when((F.size(s["x"]) > 0) & (F.size(s["y"]) > 0), length(s["x"], s["y"])).otherwise(0)), 1)
    return F.when(a.isNotNull() & b.isNotNull(), best)


def rouge_l(guess: Column, references: Column) -> Column:
    """F of the longest common subsequence with the best precision and the best recall over an array of references, recall
    weighing BETA squared; 0 if a side is empty or missing."""
    lengths = F.transform(references, lambda r: F.struct(common_subsequence(guess, r).alias("n"), F.size(r).alias("of")))
    p = F.array_max(F.transform(lengths, lambda x: x["n"])) / F.nullif(F.size(guess), F.lit(0))
    r = F.array_max(F.transform(lengths, lambda x: x["n"] / F.nullif(x["of"], F.lit(0))))
    return F.coalesce(F.when((p > 0) & (r > 0), (1 + BETA**2) * p * r / (r + BETA**2 * p)), F.lit(0.0))


#: Lengths of common runs of letters that are tabled; rows with longer ones are compared by the library's matcher.
LEVELS = 64


def common_runs(text: str, target: str) -> tuple[list[tuple[list[int], list[int]]], bool] | None:
    """For each length k the places where a run of k letters that both texts have ends in `text`, each with the bits of its ends in
    `target`; and whether letters are left out as too frequent, as the library's matcher does. None beyond LEVELS."""
    places: dict[str, int] = {}
    for i, letter in enumerate(target):
        places[letter] = places.get(letter, 0) | 1 << i
    most = len(target) // 100 + 1 if len(target) >= 200 else len(target)
    rare = {letter: bits for letter, bits in places.items() if bits.bit_count() <= most}
    one = {i: rare[letter] for i, letter in enumerate(text) if letter in rare}
    levels, now = [], one
    while now:
        if len(levels) == LEVELS:
            return None
        levels.append((list(now), list(now.values())))
        now = {i + 1: bits for i, old in now.items() if (bits := old << 1 & one.get(i + 1, 0))}
    return levels, len(rare) < len(places)


def matched(levels: list[tuple[list[int], list[int]]], frequent: bool, a: str, b: str, lo: int, hi: int, best: float = -1.0) -> int:
    """The letters in matching blocks of a[lo:hi] and b: the longest common run, the first in a and then in b, and so on at both of its sides.
    0 as soon as it is certain that their ratio can't exceed `best`."""
    total, rest, hope = 0, [(lo, hi, 0, len(b), len(levels))], min(hi - lo, len(b))
    least = best * (hi - lo + len(b)) / 2 - 1e-6
    while rest:
        alo, ahi, blo, bhi, longest = rest.pop()
        i, j, size = alo, blo, 0
        for k in range(min(longest, ahi - alo, bhi - blo), 0, -1):
            at, ends = levels[k - 1]
            window = (1 << bhi) - (1 << blo + k - 1)
            for x in range(bisect_left(at, alo + k - 1), bisect_left(at, ahi)):
                if bits := ends[x] & window:
                    i, j, size = at[x] - k + 1, (bits & -bits).bit_length() - k, k
                    break
            if size:
                break
        longest = size
        if frequent:
            while i > alo and j > blo and a[i - 1] == b[j - 1]:
                i, j, size = i - 1, j - 1, size + 1
            while i + size < ahi and j + size < bhi and a[i + size] == b[j + size]:
                size += 1
        # What the sides can still give, in place of what the whole could.
        hope -= min(ahi - alo, bhi - blo) - (size + min(i - alo, j - blo) + min(ahi - i - size, bhi - j - size) if size else 0)
        if hope < least:
            return 0
        if size:
            total += size
            rest += [(alo, i, blo, j, longest)] if alo < i and blo < j else []
            rest += [(i + size, ahi, j + size, bhi, longest)] if i + size < ahi and j + size < bhi else []
    return total


@F.pandas_udf(T.StructType([T.StructField("at", T.IntegerType()), T.StructField("similarity", T.DoubleType())]))
def most_alike(tokens: pd.Series, wanted: pd.Series, target: pd.Series, between: pd.Series) -> pd.DataFrame:
    """Where, from 1, the first run of a row's tokens starts that is most like its target by matching blocks, of the runs as long as `wanted`
    that share a token with it; null if none has a character in common.

    Runs are stretches of the joined tokens, so the runs of letters that these share with the target are found once for all.
    """
    out = []
    for row, gold, text, joint in zip(tokens, wanted, target, between, strict=True):
        best, at = 0.0, None
        if row is not None and gold is not None and 0 < len(gold) <= len(row):
            size, known, whole = len(gold), set(gold), joint.join(row)
            starts = [0, *accumulate(len(token) + len(joint) for token in row)]
            found, match = common_runs(whole, text), SequenceMatcher(None, "", text)
            last = -size
            for i, token in enumerate(row):
                last = i if token in known else last
                first = i + 1 - size
                if first < 0 or last < first:
                    continue
                lo, hi = starts[first], starts[i] + len(token)
                if found is not None:
                    ratio = 2.0 * matched(*found, whole, text, lo, hi, best) / (hi - lo + len(text))
                else:
                    match.set_seq1(whole[lo:hi])
                    ratio = match.ratio() if match.real_quick_ratio() > best and match.quick_ratio() > best else 0.0
                if ratio > best:
                    best, at = ratio, first + 1
        out.append((at, best))
    return pd.DataFrame(out, columns=["at", "similarity"]).astype({"at": "Int32"})


def filled_blanks(df: DataFrame, response: str, gold: str, word: str = r"(?U)\w+|[^\w\s]", between: str = " ") -> DataFrame:
    """Adds found, similarity, precision, recall, f1, jaccard, rouge1 and exact_match of the run of the response's tokens, as many as
    the gold text has, that is most like it among those that share a token.

    The sets of tokens give precision, recall, F1 and Jaccard, their counts rouge1. Refusals, null or empty sides, and responses
    without such a run score 0 with an empty text. Columns of these names are replaced.
    """
    names = ("found", "similarity", "precision", "recall", "f1", "jaccard", "rouge1", "exact_match")
    said, gold_text = F.coalesce(response, F.lit("")), F.coalesce(gold, F.lit(""))
    tokens = lambda c: F.regexp_extract_all(c, F.lit(word), F.lit(0))
    refused = F.lit(False)
    for mark in REFUSALS:
        refused = refused | F.contains(said, F.lit(mark))
    for mark in REFUSALS_IN_ANY_CASE:
        refused = refused | F.contains(F.lower(said), F.lit(mark))
    rows = df.drop(*names).withColumns({"__a": tokens(said), "__g": tokens(gold_text), "__no": refused})
    wanted = F.when(~F.col("__no"), F.col("__g"))
    rows = rows.withColumn("__best", most_alike(F.col("__a"), wanted, gold_text, F.lit(between)))
    rows = rows.withColumn("__w", F.coalesce(F.slice("__a", F.col("__best.at"), F.size("__g")), F.array().cast("array<string>")))
    both, own = F.size(F.array_intersect("__w", "__g")).cast("double"), F.array_distinct("__w")
    share = lambda n: F.coalesce(both / F.nullif(n, F.lit(0)), F.lit(0.0))
    p, r = share(F.size(own)), share(F.size(F.array_distinct("__g")))
    count = lambda c, x: F.size(F.filter(c, lambda y: y == x))
    clipped = F.aggregate(own, F.lit(0), lambda acc, x: acc + F.least(count(F.col("__w"), x), count(F.col("__g"), x)))
    return rows.withColumns({
        "found": F.array_join("__w", between), "similarity": F.coalesce(F.when(F.size("__w") > 0, F.col("__best.similarity")), F.lit(0.0)), "precision": p, "recall": r,
        "f1": F.coalesce(2 * p * r / F.nullif(p + r, F.lit(0.0)), F.lit(0.0)), "jaccard": share(F.size(F.array_union("__w", "__g"))),
        "rouge1": F.coalesce(clipped / F.nullif(F.size("__w"), F.lit(0)), F.lit(0.0)), "exact_match": ((F.size("__w") > 0) & (F.col("__w") == F.col("__g"))).cast("double"),
    }).drop("__a", "__g", "__no", "__best", "__w")

