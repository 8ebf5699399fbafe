"""Resampling, ratings and pairwise statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def matthews_many(df: DataFrame, pred: str, gold: str) -> DataFrame:
    """Multi-class correlation from the table of counts."""
    k = df.groupBy(F.col(gold).alias("g"), F.col(pred).alias("p")).agg(F.count(F.lit(1)).cast("double").alias("n"))
    gs = k.groupBy(F.col("g").alias("v")).agg(F.sum("n").alias("t"))
    ps = k.groupBy(F.col("p").alias("v")).agg(F.sum("n").alias("q"))
    m = gs.join(ps, "v", "full").na.fill(0.0)
    sums = m.agg(F.sum(F.col("t") * F.col("q")).alias("tq"), F.sum(F.col("t") ** 2).alias("tt"), F.sum(F.col("q") ** 2).alias("qq"))
    whole = k.agg(F.sum("n").alias("s"), F.sum(F.when(F.col("g") == F.col("p"), F.col("n")).otherwise(0.0)).alias("c"))
    s = F.col("s")
    # One row each side.
    return sums.join(whole).select(((F.col("c") * s - F.col("tq")) / F.sqrt((s * s - F.col("qq")) * (s * s - F.col("tt")))).alias("matthews"))


def two_player_rating(df: DataFrame, win: Column) -> DataFrame:
    """Closed form of the logistic rating against a baseline at 1000 (scale 400, base 10), and the win rate it predicts."""
    p = F.avg(win)
    rating = 400 * F.log10(p / (1 - p))
    return df.agg(F.round(1 - 1 / (1 + F.pow(F.lit(10.0), rating / 400)), 6).alias("wins"), F.round(1000 + rating, 4).alias("rating"))


def battles(orders: DataFrame) -> DataFrame:
    """(a, b, w): a customer's consecutive orders as battles of their priorities; the dearer wins, equal prices tie."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    rows = orders.select(F.lag("o_orderpriority").over(w).alias("a"), F.col("o_orderpriority").alias("b"), F.lag("o_totalprice").over(w).alias("x"), F.col("o_totalprice").alias("y"))
    return rows.where("a is not null and a <> b").select("a", "b", F.when(F.col("x") > F.col("y"), 1.0).when(F.col("x") < F.col("y"), 0.0).otherwise(0.5).alias("w"))


def bradley_terry(rows: DataFrame, a: str, b: str, w: str, baseline: str) -> DataFrame:
    """Maximum-likelihood ratings (scale 400, base 10, baseline at 1000) by a logistic fit without intercept.

    Battles are summed to one row for each ordered pair of models first; a tie is half a win for either side.
    """
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    spark = rows.sparkSession
    pairs = rows.groupBy(F.col(a).alias("i"), F.col(b).alias("j")).agg(F.sum(w).alias("won"), F.sum(1 - F.col(w)).alias("lost"))
    models = [r.m for r in pairs.select(F.col("i").alias("m")).union(pairs.select("j")).distinct().orderBy("m").collect()]
    signs = [(F.col("i") == m).cast("double") - (F.col("j") == m).cast("double") for m in models]
    both = pairs.select("*", F.explode(F.array(F.struct(F.lit(1.0).alias("y"), F.col("won").alias("k")), F.struct(F.lit(0.0).alias("y"), F.col("lost").alias("k")))).alias("o"))
    data = both.where("o.k > 0").select(F.col("o.y").alias("label"), F.col("o.k").alias("weight"), *[s.alias(f"f{n}") for n, s in enumerate(signs)])
    data = VectorAssembler(inputCols=[f"f{n}" for n in range(len(models))], outputCol="features").transform(data)
    fit = LogisticRegression(fitIntercept=False, regParam=0.0, weightCol="weight", maxIter=200, tol=1e-12, standardization=False).fit(data)
    scale = 400 / 2.302585092994046
    base = float(fit.coefficients[models.index(baseline)])
    made = [(m, round(1000 + scale * (float(c) - base), 2)) for m, c in zip(models, fit.coefficients, strict=True)]
    return spark.createDataFrame(made, "model string, rating double")


def turn_pairs(conversations: DataFrame) -> DataFrame:
    """Each turn with the one before it in its conversation."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    return conversations.select("role", F.lag("text").over(w).alias("prev"), "text").where("prev is not null and text is not null")


def word_distance(ref: Column, hyp: Column) -> Column:
    """Edit distance between two texts' words, blanks aside: each distinct word of the row becomes one character, and the texts of these
    characters are compared. Null if a side is null."""
    words = lambda c: F.filter(F.split(c, r"(?U)\s+"), lambda w: w != "")
    # Characters beyond the first plane, one for each word; a transform binds the words, so that they are made once.
    sign = lambda i: F.decode(F.unhex(F.lpad(F.hex(i + 65536), 8, "0")), "UTF-32")
    row = F.array(F.struct(words(ref).alias("r"), words(hyp).alias("h"), F.array_distinct(F.concat(words(ref), words(hyp))).alias("all")))
    coded = lambda s, c: F.array_join(F.transform(s[c], lambda w: sign(F.array_position(s["all"], w))), "")
    return F.element_at(F.transform(row, lambda s: F.levenshtein(coded(s, "r"), coded(s, "h")).cast("long")), 1)


def cosine_to_centroid(embeddings: DataFrame) -> DataFrame:
    """100 x the mean cosine of each label's vectors with their centroid."""
    cells = embeddings.select("vec_id", "label", F.posexplode("embedding").alias("i", "x")).withColumn("x", F.col("x").cast("double"))
    centre = cells.groupBy("label", "i").agg(F.avg("x").alias("m"))
    dots = cells.join(centre, ["label", "i"]).groupBy("vec_id", "label").agg((F.sum(F.col("x") * F.col("m")) / (F.sqrt(F.sum(F.col("x") ** 2)) * F.sqrt(F.sum(F.col("m") ** 2)))).alias("c"))
    return dots.groupBy("label").agg(F.round(100 * F.avg("c"), 5).alias("cosine"))


def k_centres(embeddings: DataFrame, k: int) -> DataFrame:
    """Greedy coreset: from the smallest id on, each time the vector farthest from all chosen ones (ties to the smaller id).

    Each round reads the kept distances and one chosen vector; distances are made durable every few rounds.
    """
    from evalframe.sources.io import durable

    rows = embeddings.select("vec_id", F.col("embedding").cast("array<double>").alias("e")).where("e is not null")
    state = rows.withColumn("d", F.lit(float("inf")))
    chosen: list[tuple[int, int]] = []
    for n in range(k):
        best = state.agg(F.max(F.struct("d", (-F.col("vec_id")).alias("neg"), "e"))).first()[0]
        if best is None or best.d == 0:
            break
        chosen.append((n, -best.neg))
        centre = F.array(*map(F.lit, best.e))
        far = F.sqrt(F.aggregate(F.zip_with("e", centre, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda a, x: a + x))
        state = state.withColumn("d", F.least("d", far))
        if n % 5 == 4:
            state = durable(state)
    return embeddings.sparkSession.createDataFrame(chosen, "pick int, vec_id long")


def fingerprint(df: DataFrame, key: str, part: Column, fan: int = 1000, levels: int = 3) -> DataFrame:
    """(n, fingerprint): one SHA-256 over the rows' texts in the order of a whole-number key, whatever their partitions.

    Texts are hashed in blocks of `fan` consecutive keys, these hashes in blocks of `fan` blocks, and so on; the last level takes
    what is left. So no group holds more than `fan` keys, below fan**levels of them. Rows of one key come by text, those without
    one first, as a block of their own; a null text is an empty one. An empty table has n = 0 and the hash of nothing.
    """
    now = df.select(F.col(key).cast("long").alias("k"), F.coalesce(part, F.lit("")).alias("s"), F.lit(1).cast("long").alias("n"))
    joined = F.sha2(F.array_join(F.array_sort(F.collect_list(F.struct("k", "s")))["s"], ""), 256)
    for _ in range(levels - 1):
        now = now.groupBy(F.floor(F.col("k") / fan).cast("long").alias("__k")).agg(joined.alias("s"), F.sum("n").alias("n")).withColumnRenamed("__k", "k")
    return now.agg(F.coalesce(F.sum("n"), F.lit(0).cast("long")).alias("n"), joined.alias("fingerprint"))
