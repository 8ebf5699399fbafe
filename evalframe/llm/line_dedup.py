"""Line deduplication by overlapping three-line windows. DataFrame and SQL functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The place of rows without an id: after all ids.
LAST = 2**63 - 1


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def dedup_lines(docs: DataFrame, span: int = 3) -> DataFrame:
    """Removes later occurrences of every run of `span` consecutive lines that occurs more than once.

    The first occurrence by (doc_id, line number) stays; all lines that a later occurrence covers go, overlapping
    occurrences merged. Windows are judged on the input. Returns the input's columns with `text` rewritten, and
    n_lines and n_removed (columns of these names are replaced). Lines part at line feeds; an empty text is one empty
    line; a null text stays null with no lines; a text of fewer than `span` lines stays whole. A null doc_id counts
    as the largest; rows that share a doc_id count as one document, so a repeated row is not a later occurrence of
    itself. A text all of whose lines go becomes empty.

    Windows travel as two 64-bit hashes, pre-aggregated before the exchange to their first occurrence; only repeated
    windows go back to their documents, in a join that splits a hot window's rows.
    """
    docs = docs.drop("n_lines", "n_removed")
    key = F.coalesce(F.col("doc_id"), F.lit(LAST))
    each = ",".join(f"element_at(l, i + {k})" for k in range(span))
    windows = (
        docs.select(key.alias("__doc"), F.xxhash64("text").alias("__version"), lines_of(F.col("text")).alias("l"))
        .where(F.size("l") >= span)
        .select("__doc", "__version", F.explode(F.expr(f"transform(sequence(1, size(l) - {span - 1}), i -> struct(i as at, xxhash64({each}) as h1, xxhash64(17, {each}) as h2))")).alias("w"))
        .select("__doc", "__version", "w.*")
    )
    repeated = (
        windows.groupBy("h1", "h2")
        .agg(F.min(F.struct("__doc", "at")).alias("first"), F.max(F.struct("__doc", "at")).alias("last"))
        .where("first < last")
        .select("h1", "h2", "first")
    )
    later = windows.join(repeated, ["h1", "h2"]).where(F.struct("__doc", "at") > F.col("first"))
    covered = later.groupBy("__doc", "__version").agg(F.collect_set("at").alias("__starts"))
    found = docs.withColumn("__doc", key).withColumn("__version", F.xxhash64("text")).join(covered, ["__doc", "__version"], "left").withColumn("__lines", lines_of(F.col("text")))
    # Covered and kept positions by hashing, so a text takes time in proportion to its lines; the lambda's variable holds its lines, split once.
    found = found.withColumn("__gone", F.expr(f"array_distinct(flatten(transform(coalesce(__starts, array()), s -> sequence(s, s + {span - 1}))))"))
    kept = F.expr(r"transform(array(__lines), l -> array_join(transform(array_except(sequence(1, size(l)), __gone), i -> element_at(l, i)), '\n'))[0]")
    some = F.size("__gone") > 0
    return found.select(
        *[F.when(some, kept).otherwise(F.col("text")).alias("text") if c == "text" else F.col(c) for c in docs.columns],
        F.when(F.col("text").isNull(), 0).otherwise(F.size("__lines")).cast("long").alias("n_lines"),
        F.size("__gone").cast("long").alias("n_removed"),
    )
