"""Language identification by nearest centroids of normalised TF-IDF n-gram vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalframe.llm.common import durable, slices

#: Hashed n-gram dimensions; documents per language that a fit takes at most; centroids per language.
DIMS, FIT_ROWS, CENTROIDS = 8192, 1500, 4
#: A text is rejected when its cosine falls below this share of what the fit's own documents of its length reach at the 1% point.
REJECT_SHARE = 0.4
#: Counts of up to so many languages (some 100 kB) are sent to every task; more meet the rows in an exchange.
SENT_LANGUAGES = 2000
#: Length classes (powers of two of letters) of the rejection distances.
LENGTHS = 16


def letters_of(text: str | None) -> str:
    """Lower-cased words of letters, parted by blanks; other characters take no part."""
    return "" if not text else " ".join("".join(c if c.isalpha() else " " for c in text.lower()).split()) if not text.isascii() else " ".join(text.lower().translate(ASCII).split())


ASCII = {i: " " for i in range(128) if not chr(i).isalpha()}


def counts_of(text: str) -> np.ndarray:
    """Damped counts of hashed byte n-grams (1 to 3 bytes) of a text of letters and blanks, word edges included."""
    b = np.frombuffer(f" {text} ".encode(), dtype=np.uint8).astype(np.uint32)
    two = b[:-1] * np.uint32(257) + b[1:]
    three = two[:-1] * np.uint32(263) + b[2:]
    grams = np.concatenate([b * np.uint32(40503), two * np.uint32(2654435761 & 0xFFFFFFFF) >> np.uint32(7), three * np.uint32(2246822519) >> np.uint32(9)])
    return np.log1p(np.bincount(grams % DIMS, minlength=DIMS)).astype(np.float32)


def vectors(texts: list[str], idf: np.ndarray) -> np.ndarray:
    x = np.empty((len(texts), DIMS), np.float32)
    for i, t in enumerate(texts):
        x[i] = counts_of(t) * idf
        x[i] /= max(float(np.linalg.norm(x[i])), 1e-12)
    return x


def length_class(text: str) -> int:
    return min(LENGTHS - 1, max(1, len(text)).bit_length())


def cluster(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Spherical k-means; the first centroid is the mean, each next one the row least like those before."""
    centres = [x.mean(axis=0)]
    best = x @ centres[0]
    while len(centres) < min(k, len(x)):
        centres.append(x[int(best.argmin())])
        best = np.maximum(best, x @ centres[-1])
    c = np.stack(centres)
    for _ in range(rounds):
        own = (x @ (c / np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)).T).argmax(axis=1)
        one = (own == np.arange(len(c))[:, None]).astype(x.dtype)
        c = np.where(one.any(axis=1, keepdims=True), one @ x / np.maximum(one.sum(axis=1, keepdims=True), 1), c)
    return c / np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)


def fit_sample(docs: DataFrame, trains: Column, most: int) -> DataFrame:
    """Up to `most` training rows of each language: those whose id hashes lowest. The counts cover all rows."""
    rows = docs.where(trains & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")).select("text", "lang", F.xxhash64(F.lit("fit"), F.col("doc_id"), F.col("text")).alias("h"))
    # One row a language; texts only move once their hash has passed.
    counts = durable(rows.groupBy("lang").count())
    if counts.count() <= SENT_LANGUAGES:
        counts = F.broadcast(counts)
    share = F.lit(float(2**64)) * F.least(F.lit(1.0), F.lit(1.2 * most) / F.col("count")) - float(2**63)
    near = rows.join(counts, "lang").where(F.col("h").cast("double") <= share)
    ranked = near.withColumn("rank", F.expr("row_number() over (partition by lang order by h)"))
    return durable(ranked.where(F.col("rank") <= most).select("lang", "text"))


class Model:
    def __init__(self, idf: np.ndarray, langs: list[str], centres: np.ndarray, owner: np.ndarray, least: np.ndarray):
        self.idf, self.langs, self.centres, self.owner, self.least = idf, langs, centres, owner, least

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """For letters_of() texts that aren't empty: language, cosine, and whether it is too far off."""
        near = vectors(texts, self.idf) @ self.centres.T
        at = near.argmax(axis=1)
        score = np.clip(near[np.arange(len(texts)), at], 0, 1).astype(float)
        owner = self.owner[at]
        far = score < self.least[owner, [length_class(t) for t in texts]]
        return [self.langs[i] for i in owner], score, far


def fit(docs: DataFrame, trains: Column, most: int = FIT_ROWS, centroids: int = CENTROIDS, reject_share: float = REJECT_SHARE) -> Model:
    """Fits on at most `most` rows a language (the documented bound): document frequencies of the hashed dimensions, then
    `centroids` centroids for each language, each language in one task, and the least cosine by length class."""
    sample = fit_sample(docs, trains, most)

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(DIMS, np.int64), 0
        for batch in batches:
            for text in batch.column("text").to_pylist():
                df += counts_of(letters_of(text)) > 0
                n += 1
        yield pa.RecordBatch.from_arrays([pa.array([df.tolist()], pa.list_(pa.int64())), pa.array([n], pa.int64())], ["df", "n"])

    df, n = np.zeros(DIMS), 0
    for row in sample.select("text").mapInArrow(frequencies, "df array<long>, n long").toLocalIterator():
        df, n = df + np.array(row.df), n + row.n
    idf = (np.log((1 + n) / (1 + df)) + 1).astype(np.float32)

    def centre(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("text")
        texts = [letters_of(t) for t in rows["text"]]
        x = vectors(texts, idf)
        c = cluster(x, centroids)
        best, size = (x @ c.T).max(axis=1), np.array([length_class(t) for t in texts])
        # A class's limit also looks at longer texts' neighbours one class off; classes without rows take the limit of the whole.
        least = [float(np.quantile(best[near] if (near := abs(size - k) <= 1).sum() >= 20 else best, 0.01)) * reject_share for k in range(LENGTHS)]
        return pd.DataFrame({"lang": key[0], "centre": list(c.astype(np.float32)), "least": [least] * len(c)})

    found = sample.groupBy("lang").applyInPandas(centre, "lang string, centre array<float>, least array<double>").collect()
    langs = sorted({r.lang for r in found})
    found.sort(key=lambda r: (r.lang, r.centre))
    owner = np.array([langs.index(r.lang) for r in found], dtype=int)
    least = np.array([next(r.least for r in found if r.lang == l) for l in langs]).reshape(len(langs), LENGTHS)
    return Model(idf, langs, np.array([r.centre for r in found], np.float32).reshape(len(found), DIMS), owner, least)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """Adds lang_pred, score (cosine with the nearest centroid, 0 to 1) and rejected (columns of these names are replaced).

    Reads whole texts and nothing else of a row. A null text, or one without a letter, is `und` with score 0 and
    rejected; so is any text if the model saw no training rows. A text too far from every centroid keeps the nearest
    language and is marked rejected; of equally near centroids the first in order of language wins. Equal texts, repeated
    rows too, get equal answers. Row-local.
    """
    docs = docs.drop("lang_pred", "score", "rejected")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                texts = [letters_of(t) for t in part.column("text").to_pylist()]
                langs, scores, far = ["und"] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
                own = [i for i, t in enumerate(texts) if t] if model.langs else []
                for at in range(0, len(own), 250):
                    some = own[at : at + 250]
                    found, scores[some], far[some] = model.predict([texts[i] for i in some])
                    for i, lang in zip(some, found, strict=True):
                        langs[i] = lang
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(langs), pa.array(scores), pa.array(far)], [*part.schema.names, "lang_pred", "score", "rejected"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(run, f"{fields}, lang_pred string, score double, rejected boolean")
