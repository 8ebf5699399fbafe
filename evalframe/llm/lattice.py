"""Language-model scores from a subword lattice: all segmentations of a word over a given unigram vocabulary."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalframe.llm.common import slices, written

BLOCK_BYTES = 16 << 20
#: Stands for the end of a text in the word table; no word holds white space.
END = b"\n"
MULTIPLIER = np.uint64(0x100000001B3)


class Vocabulary:
    """Subword pieces as bytes with log probabilities. A blank opens a word; every single byte is a piece, so every word has a
    segmentation; the last entry closes a word."""

    def __init__(self, pieces: list[bytes], logp: np.ndarray):
        self.pieces, self.logp, self.longest = pieces, logp, max(map(len, pieces))
        hashes = np.array([hash_piece(p) for p in pieces], dtype=np.uint64)
        self.order = np.argsort(hashes, kind="stable")
        self.hashes = hashes[self.order]

    @staticmethod
    def load(path: str) -> Vocabulary:
        """Pieces of a sentencepiece model that lower-cased words can use. Its scores order pieces by rank; Zipf's law turns the rank
        into a first probability."""
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        weights = {bytes([b]): 1e-4 for b in range(256)}
        for i in range(model.get_piece_size()):
            if model.is_control(i) or model.is_unknown(i) or model.is_byte(i):
                continue
            piece = model.id_to_piece(i).replace("▁", " ").encode()
            if b" " not in piece[1:] and piece == piece.lower():
                weights[piece] = max(weights.get(piece, 0), 1 / (2.7 - model.get_score(i)))
        weights[b""] = 0.2 * sum(weights.values())
        p = np.array(list(weights.values()))
        return Vocabulary(list(weights), np.log(p / p.sum()))

    def find(self, hashes: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, self.order[at], -1)


def hash_piece(piece: bytes) -> int:
    h = 0
    for b in piece:
        h = (h * int(MULTIPLIER) + b + 1) % 2**64
    return h


def arcs(words: list[bytes], vocabulary: Vocabulary) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Words in groups of like length: their row numbers, lengths (blank included) and, for each start and piece length,
    the piece's number or -1."""
    sizes = np.array([len(w) + 1 for w in words], dtype=np.int64)
    rounded = np.where(sizes <= 32, sizes, 1 << np.ceil(np.log2(np.maximum(sizes, 2))).astype(np.int64))
    for size in np.unique(rounded).tolist():
        rows = np.flatnonzero(rounded == size)
        step = max(1, 200_000 // size)
        for at in range(0, len(rows), step):
            own = rows[at : at + step]
            raw = b"".join((b" " + words[i]).ljust(size, b"\0") for i in own.tolist())
            data = np.frombuffer(raw, dtype=np.uint8).reshape(len(own), size).astype(np.uint64) + np.uint64(1)
            found = np.full((len(own), size, min(size, vocabulary.longest)), -1, dtype=np.int32)
            h = np.zeros_like(data)
            for k in range(found.shape[2]):
                n = size - k
                h = h[:, :n] * MULTIPLIER + data[:, k:]
                found[:, :n, k] = vocabulary.find(h)
            yield own, sizes[own], found


def forward(found: np.ndarray, logp: np.ndarray) -> np.ndarray:
    """alpha[:, j]: log probability of all segmentations of the first j bytes."""
    rows, size, longest = found.shape
    alpha = np.full((rows, size + 1), -np.inf)
    alpha[:, 0] = 0
    weights = np.append(logp, -np.inf)
    for j in range(1, size + 1):
        terms = np.stack([alpha[:, j - k] + weights[found[:, j - k, k - 1]] for k in range(1, min(j, longest) + 1)])
        top = terms.max(axis=0)
        with np.errstate(invalid="ignore", divide="ignore"):
            alpha[:, j] = np.where(np.isfinite(top), top + np.log(np.exp(terms - np.where(np.isfinite(top), top, 0)).sum(axis=0)), -np.inf)
    return alpha


def word_logp(words: list[bytes], vocabulary: Vocabulary) -> np.ndarray:
    """Natural log of the marginal probability of each word: the sum over all its segmentations, closed by the end piece."""
    out = np.zeros(len(words))
    for own, sizes, found in arcs(words, vocabulary):
        out[own] = forward(found, vocabulary.logp)[np.arange(len(own)), sizes] + vocabulary.logp[-1]
    return out


def expected(words: list[bytes], counts: np.ndarray, vocabulary: Vocabulary) -> np.ndarray:
    """Expected uses of each piece over all segmentations of the words (forward and backward sums)."""
    total = np.zeros(len(vocabulary.pieces))
    weights = np.append(vocabulary.logp, -np.inf)
    for own, sizes, found in arcs(words, vocabulary):
        rows, size, longest = found.shape
        alpha = forward(found, vocabulary.logp)
        whole = alpha[np.arange(rows), sizes]
        beta = np.full((rows, size + 1), -np.inf)
        beta[np.arange(rows), sizes] = 0
        for i in range(size - 1, -1, -1):
            most = min(size - i, longest)
            terms = np.stack([beta[:, i + k] + weights[found[:, i, k - 1]] for k in range(1, most + 1)])
            top = terms.max(axis=0)
            safe = np.where(np.isfinite(top), top, 0)
            with np.errstate(divide="ignore"):
                beta[:, i] = np.maximum(beta[:, i], safe + np.log(np.exp(terms - safe).sum(axis=0)))
            use = np.exp(alpha[:, i] + terms - whole) * counts[own]
            ids = found[:, i, :most].T
            total += np.bincount(ids[ids >= 0], weights=use[ids >= 0], minlength=len(total))
    total[-1] += counts.sum()
    return total


STORED = "block long, ids array<long>, held array<boolean>, ends array<int>, tokens binary, words array<binary>, counts array<int>"


def tokenise(docs: DataFrame, held_out: Column) -> DataFrame:
    """Blocks of documents: their tokens as numbers in the block's own word list, and that list with training counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        for batch in batches:
            for part in slices(batch, "text", BLOCK_BYTES):
                number: dict[bytes, int] = {}
                texts, held = part.column("text").to_pylist(), part.column("held").to_pylist()
                rows = [np.array([number.setdefault(w, len(number)) for w in [*(t or "").encode().lower().split(), END]], dtype="<i4") for t in texts]
                learnt = [r for r, h in zip(rows, held, strict=True) if not h]
                counts = np.bincount(np.concatenate(learnt), minlength=len(number)) if learnt else np.zeros(len(number), int)
                values = (block, part.column("doc_id").to_pylist(), held, np.cumsum([len(r) for r in rows]).tolist(), np.concatenate(rows).tobytes(), list(number), counts.tolist())
                kinds = (pa.int64(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int32()), pa.binary(), pa.list_(pa.binary()), pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], ["block", "ids", "held", "ends", "tokens", "words", "counts"])
                block += 1

    rows = docs.select(F.col("doc_id").cast("long"), "text", F.coalesce(held_out, F.lit(False)).alias("held"))
    return rows.mapInArrow(run, STORED)


def learn(vocab: DataFrame, start: Vocabulary, rounds: int) -> Vocabulary:
    """Re-estimates piece probabilities from all distinct training words, each counted once, for the lattice speaks for rare words:
    in each round every task sums expected uses, and one sum for each piece of the fixed vocabulary reaches the driver."""
    for _ in range(rounds):

        def run(batches: Iterator[pa.RecordBatch], now: Vocabulary = start) -> Iterator[pa.RecordBatch]:
            total = np.zeros(len(now.pieces))
            for batch in batches:
                total += expected(batch.column("word").to_pylist(), np.ones(batch.num_rows), now)
            used = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(total[used])], ["piece", "uses"])

        sums = vocab.where("c > 0").mapInArrow(run, "piece int, uses double").groupBy("piece").agg(F.sum("uses").alias("uses")).collect()
        uses = np.full(len(start.pieces), 1e-3)
        for r in sums:
            uses[r.piece] += r.uses
        start = Vocabulary(start.pieces, np.log(uses / uses.sum()))
    return start


def score(docs: DataFrame, held_out: Column, vocabulary_path: str, rounds: int = 2) -> DataFrame:
    """Log10 probability of every text under a word model that backs off to a subword lattice, both learnt from the rows that
    are not held out.

    A token is a word with A-Z lower-cased, or the end of the text. With c its training count, N all training tokens,
    V distinct ones and d the absolute discount n1 / (n1 + 2 n2), its probability is (c - d) / N (0 if c = 0) plus d V / N
    times the lattice's: the sum over all segmentations into pieces of the given vocabulary. Without training tokens
    the lattice stands alone. Also returns the add-one unigram score. A null text is empty; a null held-out flag
    means training; repeated rows count and score as they stand. Returns doc_id, held_out, n_tokens, n_known,
    train_tokens, base_score and score.

    Each block's word list meets the counted words in one join (a word has one row a block), and a block's answers gather
    with its tokens: memory is bounded by a block of BLOCK_BYTES, or one longer text.
    """
    blocks = written(tokenise(docs, held_out), "tokens")
    uses = blocks.select("block", F.posexplode(F.arrays_zip("words", "counts")).alias("pos", "w")).select("block", "pos", F.col("w.words").alias("word"), F.col("w.counts").alias("n"))
    vocab = written(uses.groupBy("word").agg(F.sum("n").alias("c")), "words")
    stats = vocab.agg(F.sum("c").alias("n"), F.count_if(F.col("c") > 0).alias("v"), F.count_if(F.col("c") == 1).alias("n1"), F.count_if(F.col("c") == 2).alias("n2")).first()
    n, v = stats.n or 0, stats.v
    discount = min(0.9, max(0.1, stats.n1 / (stats.n1 + 2 * stats.n2))) if stats.n1 + stats.n2 else 0.5
    model = learn(vocab, Vocabulary.load(vocabulary_path), rounds)

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c = batch.column("c").to_numpy().astype(float)
            inner = word_logp(batch.column("word").to_pylist(), model) / np.log(10)
            with np.errstate(divide="ignore"):
                known = np.log10(np.maximum(c - discount, 0) / n) if n else np.full(len(c), -np.inf)
            back = inner + (np.log10(discount * v / n) if n else 0)
            top = np.maximum(known, back)
            logp = top + np.log10(10 ** (known - top) + 10 ** (back - top))
            yield pa.RecordBatch.from_arrays([batch.column("word"), batch.column("c"), pa.array(logp)], ["word", "c", "logp"])

    rated = vocab.mapInArrow(rate, "word binary, c long, logp double")
    answers = uses.select(F.col("block").alias("of"), "pos", "word").join(rated, "word").select("of", "pos", "c", "logp")

    def add(key: tuple, own: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        block = own.iloc[0]
        c, logp = np.zeros(len(found)), np.zeros(len(found))
        c[found["pos"]], logp[found["pos"]] = found["c"], found["logp"]
        tokens, ends = np.frombuffer(block["tokens"], "<i4"), np.asarray(block["ends"])
        sums = lambda x: np.add.reduceat(x[tokens], np.append(0, ends[:-1]))
        return pd.DataFrame({
            "doc_id": pd.array(block["ids"], dtype="Int64"), "held_out": block["held"], "n_tokens": np.diff(ends, prepend=0), "n_known": sums((c > 0).astype(np.int64)),
            "train_tokens": n, "base_score": sums(np.log10((c + 1) / (n + v + 1))), "score": sums(logp),
        })

    lists = blocks.select("block", "ids", "held", "ends", "tokens").groupBy("block")
    return lists.cogroup(answers.groupBy("of")).applyInPandas(add, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
