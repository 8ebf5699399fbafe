"""Preparation of evaluation rows and reports: slices, few-shot contexts, shuffled options, samples by seed, overlap metrics, result tables.

Draws compare MD5 digests of a row's key and a seed, so they depend on nothing else.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evalframe.operators.curate import positions
from evalframe.operators.ngrams import met_grams


def draw(seed: int, *keys: Column | str) -> Column:
    """A digest of the keys and the seed: its order is a random one."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[(F.col(k) if isinstance(k, str) else k).cast("string") for k in keys]))


def below(digest: Column, share: float) -> Column:
    """Whether a digest, as a fraction of its range, is below `share`."""
    return F.lit(True) if share >= 1 else F.substring(digest, 1, 8) < F.lit(f"{int(max(share, 0.0) * 2**32):08x}")


def routed(df: DataFrame, fields: Mapping[str, Sequence[str]], error: str = "missing_qa") -> DataFrame:
    """Each field as the first of its aliases that isn't null or blank; `error` is set where one is missing."""
    found = {name: F.coalesce(*[F.nullif(F.trim(a), F.lit("")) for a in aliases]) for name, aliases in fields.items()}
    missing = F.exists(F.array(*[c.isNull() for c in found.values()]), lambda x: x)
    return df.select("*", *[c.alias(k) for k, c in found.items()], F.when(missing, F.lit(error)).alias("error"))


def labelled_by(df: DataFrame, key: str, table: Mapping[str, str], name: str, default: str) -> DataFrame:
    """Adds `name`: the key's value in a small look-up table, or the default; write.partitionBy(name) then parts the rows."""
    values = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    return df.withColumn(name, F.coalesce(F.try_element_at(values, F.col(key)), F.lit(default)))


def sliced(df: DataFrame, index: str, start: int = 0, stop: int | None = None) -> DataFrame:
    """Rows whose index column, which starts at 0, lies in start:stop."""
    i = F.col(index)
    return df.where(i >= start) if stop is None else df.where((i >= start) & (i < stop))


def without_suffix(text: Column, digest: Column, suffixes: Sequence[tuple[str, float]], master: float = 1.0) -> Column:
    """The text without the first listed suffix that it ends with, taken off with the lesser of that suffix's share and `master`."""
    out = text
    for suffix, share in reversed(suffixes):
        cut = F.substring(text, F.lit(1), F.length(text) - len(suffix))
        out = F.when(F.endswith(text, F.lit(suffix)), F.when(below(digest, min(share, master)), cut).otherwise(text)).otherwise(out)
    return out


def few_shot(docs: DataFrame, pool: DataFrame, key: str, text: str, n: int, seed: int, delimiter: str = "\n\n") -> DataFrame:
    """Adds `context`: n texts of the pool for each document, itself left out, joined by the delimiter.

    The pool stands in one random order; a document takes a run of n + 1 of it, wrapped at the end, from a place of its own, and
    drops itself or the last. So shots differ, and documents meet the pool by place in an equi-join. A pool of n or
    fewer gives all it has.
    """
    shots = positions(pool.select(F.col(key).alias("__shot"), F.col(text).alias("__text"), draw(seed, key).alias("__draw")), ["__draw", "__shot"], "__place")
    size = shots.count()
    start = F.pmod(F.conv(F.substring(draw(seed + 1, key), 1, 12), 16, 10).cast("long"), F.lit(max(size, 1)))
    asked = docs.select(key, F.posexplode(F.sequence(F.lit(0), F.lit(max(0, min(n, size - 1))))).alias("__turn", "__k")).withColumn("__place", F.pmod(start + F.col("__k"), F.lit(max(size, 1))))
    met = asked.join(shots, "__place").where(F.col("__shot") != F.col(key)).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("__turn", "__text"))).alias("__shots"))
    context = F.array_join(F.slice(F.transform("__shots", lambda s: s["__text"]), 1, n), delimiter)
    return docs.join(met, key, "left").withColumn("context", F.coalesce(context, F.lit(""))).drop("__shots")


def first_shots(docs: DataFrame, pool: DataFrame, index: str, text: str, n: int, delimiter: str = "\n\n") -> DataFrame:
    """Adds `context`: the pool's first n texts by index, the same for all documents."""
    shots = pool.where(F.col(index) < n).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(index, text))), lambda s: s[text]), delimiter).alias("context"))
    return docs.join(F.broadcast(shots))


def shuffled_options(df: DataFrame, key: str, options: str, gold: Column, seed: int) -> DataFrame:
    """Options in an order drawn for each row, and `letter`, the gold option's new letter (of equal options the first)."""
    drawn = F.array_sort(F.transform(options, lambda o, i: F.struct(draw(seed, F.col(key), i).alias("d"), o.alias("o"))))
    rows = df.withColumn("__gold", gold).withColumn(options, F.transform(drawn, lambda s: s["o"]))
    at = F.array_position(F.col(options), F.col("__gold"))
    return rows.withColumn("letter", F.when(at > 0, F.char(at + 64))).drop("__gold")


def sampled(df: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """n rows, the first in a random order by key and seed (a top-n, so no full sort)."""
    return df.orderBy(draw(seed, key), key).limit(n)


#: Rows whose characters a Python worker takes at a time.
ROWS = 10_000


def char_sums(batches: Iterator[pa.RecordBatch], orders: int) -> Iterator[pa.RecordBatch]:
    """(k, m, p, r) of each run of rows: character n-grams that both texts p and r of a row have, and those of either."""
    for whole in batches:
        for lo in range(0, whole.num_rows, ROWS):
            batch = whole.slice(lo, ROWS)
            texts = [batch.column(c).fill_null("").to_pylist() for c in ("p", "r")]
            chars = np.frombuffer("".join(texts[0] + texts[1]).encode("utf-32-le"), np.uint32)
            row = np.repeat(np.tile(np.arange(batch.num_rows), 2), [len(t) for side in texts for t in side])
            second = np.arange(len(chars)) >= sum(map(len, texts[0]))
            found = met_grams(chars, 2 * row + second, row, second, orders)
            rows = [(k, *(int(n.sum()) for n in sums)) for k, sums in enumerate(found, 1)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["k", "m", "p", "r"])


def char_fscore(df: DataFrame, key: str, guess: str, gold: str, orders: int = 6, beta: float = 2.0) -> DataFrame:
    """One row with chrf: character n-gram F over the whole table. Blanks don't count; counts of each order are summed over rows,
    precision and recall averaged over the orders that both sides have."""
    plain = lambda c: F.regexp_replace(c, r"\s", "")
    rows = df.select(F.col(key).alias("id"), plain(guess).alias("p"), plain(gold).alias("r"))
    rows = rows.withColumn("__rows", F.count(F.lit(1)).over(Window.partitionBy("id")))
    # A key's only row is counted where it stands; rows that share one meet by key and n-gram, and those without a key meet nothing.
    alone = rows.where("__rows = 1 and id is not null").select("p", "r").mapInArrow(lambda batches: char_sums(batches, orders), "k int, m long, p long, r long")
    starts = "filter(sequence(0, length(s)), i -> i > 0 and i <= length(s) - k + 1)"
    one = f"explode(flatten(transform(sequence(1, {orders}), k -> transform({starts}, i -> named_struct('k', k, 'g', substring(s, i, k)))))) as x"
    several = rows.where("__rows > 1 or id is null").selectExpr("id", "inline(array(struct(true as guess, p as s), struct(false as guess, r as s)))")
    counts = several.selectExpr("id", "guess", one).groupBy("id", "x.k", "x.g").agg(F.count_if("guess").alias("p"), F.count_if(~F.col("guess")).alias("r"))
    several = counts.groupBy("k").agg(F.sum(F.when(F.col("id").isNotNull(), F.least("p", "r")).otherwise(0)).alias("m"), F.sum("p").alias("p"), F.sum("r").alias("r"))
    sums = alone.unionByName(several).groupBy("k").agg(*[F.sum(c).alias(c) for c in ("m", "p", "r")]).where("p > 0 and r > 0")
    mean = sums.agg(F.avg(F.col("m") / F.col("p")).alias("p"), F.avg(F.col("m") / F.col("r")).alias("r"))
    f = (1 + beta**2) * F.col("p") * F.col("r") / (beta**2 * F.col("p") + F.col("r"))
    return mean.select(F.coalesce(F.when(F.col("p") + F.col("r") > 0, 100 * f), F.lit(0.0)).alias("chrf"))


def rouge_n(df: DataFrame, key: str, guess: Column, gold: Column, n: int) -> DataFrame:
    """(key, rouge): F1 of n-grams of tokens, repeats counted; 0 if a side has none."""

    def grams(tokens: Column) -> DataFrame:
        starts = F.filter(F.sequence(F.lit(1), F.greatest(F.size(tokens), F.lit(1))), lambda i: i <= F.size(tokens) - n + 1)
        rows = df.select(key, F.explode(F.transform(starts, lambda i: F.array_join(F.slice(tokens, i, n), "\n"))).alias("g"))
        return rows.groupBy(key, "g").agg(F.count(F.lit(1)).alias("n"))

    both = grams(guess).select(key, "g", F.col("n").alias("p")).join(grams(gold).select(key, "g", F.col("n").alias("r")), [key, "g"], "full")
    sums = both.groupBy(key).agg(F.sum(F.least(F.coalesce("p", F.lit(0)), F.coalesce("r", F.lit(0)))).alias("m"), (F.coalesce(F.sum("p"), F.lit(0)) + F.coalesce(F.sum("r"), F.lit(0))).alias("all"))
    return df.select(key).join(sums, key, "left").select(key, F.coalesce(2.0 * F.col("m") / F.col("all"), F.lit(0.0)).alias("rouge"))


def area_averages(df: DataFrame, kind: str, score: str, areas: Mapping[str, str]) -> DataFrame:
    """(area, score): the mean over an area's classes of each class's mean, and under null the mean over areas. Classes outside the
    table don't count."""
    classes = labelled_by(df, kind, areas, "area", "").where("area <> ''").groupBy("area", kind).agg(F.avg(score).alias("s"))
    by = classes.groupBy("area").agg(F.avg("s").alias("score"))
    return by.union(by.agg(F.lit(None).cast("string").alias("area"), F.avg("score").alias("score")))


def matrix_scores(df: DataFrame, key: str, cell: str, hit: str, categories: str) -> DataFrame:
    """(category, text, video, group) from rows that hold each key's four hits, whose cells are pos_text, neg_text, pos_video and
    neg_video: a pair counts if both are hit, the group if all are. Categories are an array; null stands for all keys."""
    one = {c: F.bool_and(F.when(F.col(cell) == c, F.col(hit))).alias(c) for c in ("pos_text", "neg_text", "pos_video", "neg_video")}
    items = df.groupBy(key).agg(*one.values(), F.first(categories).alias("cats"))
    items = items.select(F.expr("pos_text and neg_text").alias("t"), F.expr("pos_video and neg_video").alias("v"), F.explode(F.concat("cats", F.array(F.lit(None).cast("string")))).alias("category"))
    rate = lambda c: F.avg(F.expr(f"cast({c} as int)"))
    return items.groupBy("category").agg(rate("t").alias("text"), rate("v").alias("video"), rate("(t and v)").alias("group"))


def win_rates(ratings: DataFrame, model: str, rating: str) -> DataFrame:
    """(a, b, p) for each two models: the chance of a to beat b by their ratings, 400 points for ten to one. One row a model."""
    a, b = (ratings.select(F.col(model).alias(n), F.col(rating).alias(f"r{n}")) for n in "ab")
    return a.join(b, F.col("a") != F.col("b")).select("a", "b", (1 / (1 + F.pow(F.lit(10.0), (F.col("rb") - F.col("ra")) / 400))).alias("p"))


def battle_rates(battles: DataFrame, a: str, b: str, winner: str) -> DataFrame:
    """(model, side, n, rate): each model's battles on a side and the percentage of them that this side won.

    `winner` is model_a, model_b or something else, which nobody wins; null too. Both sides come from one pass over the battles. A
    reported model stands on side b and the baseline on side a; one that stands on both has a row for each.
    """
    sides = F.inline(F.array(*[F.struct(F.col(m).alias("model"), F.lit(f"model_{k}").alias("side")) for k, m in (("a", a), ("b", b))]))
    rows = battles.select(F.col(winner).alias("winner"), sides)
    return rows.groupBy("model", "side").agg(F.count(F.lit(1)).alias("n"), (100 * F.count_if(F.col("winner") == F.col("side")) / F.count(F.lit(1))).alias("rate"))


# The labels of a verdict, each with the name of its share.
JUDGEMENTS = {"Better": "better", "Better++": "better_plus", "Worse": "worse", "Worse++": "worse_plus", "Tie": "tie", "Unclear": "unclear"}


def verdict_shares(df: DataFrame, keys: Sequence[str], judgement: str) -> DataFrame:
    """Percentage of each label among a group's rows that have one, a column a label; 0 for a label or group without any."""
    share = lambda label: F.coalesce(100 * F.try_divide(F.count_if(F.col(judgement) == label), F.count(judgement)), F.lit(0.0))
    return df.groupBy(*keys).agg(*[share(label).alias(name) for label, name in JUDGEMENTS.items()])


def combined(df: DataFrame, group: str, scalars: Sequence[str], sizes: Sequence[str], counts: Sequence[str]) -> DataFrame:
    """Diagnostics of a group's parts: means of scalars, the largest sizes, sums of counts."""
    return df.groupBy(group).agg(*[F.avg(c).alias(c) for c in scalars], *[F.max(c).alias(c) for c in sizes], *[F.sum(c).alias(c) for c in counts])


def flat_results(df: DataFrame, task: str, metrics: str) -> DataFrame:
    """(name, value, text) of results held as a map from metric to text: names are task/metric; what is no number stands in `text`."""
    rows = df.select(F.col(task).alias("t"), F.explode(metrics).alias("m", "v"))
    number = F.col("v").try_cast("double")
    return rows.select(F.concat_ws("/", "t", "m").alias("name"), number.alias("value"), F.when(number.isNull(), F.col("v")).alias("text"))


def report_rows(df: DataFrame, key: str, kind: str, views: Mapping[str, Mapping[str, Callable[[], Column]]]) -> DataFrame:
    """Sample rows for a report: for each output type its own expressions, and null where a type lacks a column."""
    names = list(dict.fromkeys(n for view in views.values() for n in view))
    parts = [df.where(F.col(kind) == k).select(key, kind, *[(view[n]() if n in view else F.lit(None)).cast("string").alias(n) for n in names]) for k, view in views.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def spread_means(df: DataFrame, task: str, value: str) -> DataFrame:
    """(task, mean): the mean of a media length, rows without one left out."""
    return df.where(F.col(value).isNotNull()).groupBy(task).agg(F.avg(value).alias("mean"))


def changes(old: DataFrame, new: DataFrame, key: str, value: str) -> DataFrame:
    """(key, old, new, delta), largest rise first, then by key."""
    met = old.select(key, F.col(value).alias("old")).join(new.select(key, F.col(value).alias("new")), key)
    return met.withColumn("delta", F.col("new") - F.col("old")).orderBy(F.desc("delta"), key)

