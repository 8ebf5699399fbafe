"""Packing by power-of-two decomposition: every piece of a document is a sequence of its own."""

from __future__ import annotations

import os
import re
import unicodedata
from collections.abc import Iterator
from itertools import chain, pairwise, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalframe.llm.common import IS_SPACE, slices

#: Words whose ids each worker remembers; with more it starts anew.
REMEMBERED = 500_000
#: Letters that are lower case and composed, so the tokenizer takes a word of them alone as it is and in one piece.
LETTERS = re.compile(r"[a-z\u00df-\u00f6\u00f8-\u00ff]+")
#: What a byte is: nothing (a blank), a letter, an ASCII symbol other than the apostrophe, anything else.
LETTER, SYMBOL, OTHER = 1, 2, 4
KINDS = np.full(256, OTHER, dtype=np.uint8)
KINDS[list(b"abcdefghijklmnopqrstuvwxyz")] = LETTER
KINDS[list(b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~")] = SYMBOL
KINDS[IS_SPACE] = 0

_known: dict[str, Words] = {}


def lowered(text: str) -> str:
    """Lower case, as the tokenizer makes it; texts it would treat otherwise (not composed, special tokens) stay.

    The tokenizer goes character by character, so no capital sigma becomes a final one, and it composes before it lowers,
    so a text whose lower case would compose anew (H and a macron below) stays as well.
    """
    if text.isascii():
        return text if "<|" in text else text.lower()
    low = text.replace("\u03a3", "\u03c3").lower()
    plain = "<|" not in text and unicodedata.is_normalized("NFC", text) and unicodedata.is_normalized("NFC", low)
    return low if plain else text


class Words:
    """The ids of the words that a worker has met, one after another in an array; a word's slot tells where."""

    def __init__(self, path: str):
        # Spark's tasks are the threads.
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, pre_tokenizers

        self.whole, self.letters = Tokenizer.from_file(path), Tokenizer.from_file(path)
        self.letters.normalizer = None
        self.letters.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.CharDelimiterSplit(" "), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocabulary = self.whole.get_vocab()
        self.closes = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.closes[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.clear()

    def clear(self) -> None:
        self.slots: dict[str, int] = {}
        self.ids, self.starts, self.used = np.empty(1 << 16, "<u4"), np.zeros(1 << 14, np.int64), 0

    def add(self, words: list[str], ids: np.ndarray, ends: np.ndarray) -> None:
        """Takes the ids of new words; `ends` are those of each word in `ids`."""
        n, most = len(self.slots), len(self.slots) + len(words)
        if self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids[: self.used], np.empty(self.used + len(ids), "<u4")])
        if most >= len(self.starts):
            self.starts = np.concatenate([self.starts[: n + 1], np.empty(most + 1, np.int64)])
        self.ids[self.used : self.used + len(ids)] = ids
        self.starts[n + 1 : most + 1] = self.used + ends
        self.used += len(ids)
        self.slots.update(zip(words, range(n, most), strict=True))

    def find(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Where the ids of each of these distinct words start, and their number. New words of letters are encoded in one call, for
        the token that closes a word shows where it ends; others one by one."""
        if len(self.slots) >= REMEMBERED:
            self.clear()
        slots = np.fromiter(map(self.slots.get, words, repeat(-1)), np.int64, len(words))
        plain: list[int] = []
        odd: list[int] = []
        for i in np.flatnonzero(slots < 0).tolist():
            (plain if LETTERS.fullmatch(words[i]) else odd).append(i)
        slots[plain + odd] = np.arange(len(self.slots), len(self.slots) + len(plain) + len(odd))
        if plain:
            fresh = [words[i] for i in plain]
            ids = np.asarray(self.letters.encode_batch_fast([" ".join(fresh)], add_special_tokens=False)[0].ids, dtype="<u4")
            self.add(fresh, ids, np.flatnonzero(self.closes[ids]) + 1)
        if odd:
            fresh = [words[i] for i in odd]
            codes = [c.ids for c in self.whole.encode_batch_fast(fresh, add_special_tokens=False)]
            self.add(fresh, np.fromiter(chain.from_iterable(codes), "<u4"), np.cumsum([len(c) for c in codes]))
        return self.starts[slots], self.starts[slots + 1] - self.starts[slots]


def encode(texts: list[str], path: str) -> list[bytes]:
    """Token ids of each text as little-endian 32-bit integers.

    The tokenizer ignores case, drops white space and joins nothing across it, and it parts letters from symbols other than the
    apostrophe as well. So each run between blanks is cut there, each distinct word of all texts is encoded once and its ids are
    remembered. Texts that may hold special tokens are cut at blanks alone.
    """
    if path not in _known:
        _known[path] = Words(path)
    raw = [lowered(t).encode() for t in texts]
    edges = np.cumsum([0, *map(len, raw)])
    data = np.frombuffer(b"".join(raw), dtype=np.uint8)
    kinds = KINDS[data]
    kinds[1:][(data[:-1] == 0xC3) & (data[1:] >= 0x9F) & (data[1:] != 0xB7)] = LETTER  # the second byte of a letter from 0xDF to 0xFF
    for i, text in enumerate(texts):
        if "<|" in text:
            own = kinds[edges[i] : edges[i + 1]]
            own[own > 0] = OTHER
    before = np.zeros(len(data) + 1, dtype=np.uint8)
    before[1:] = kinds
    before[edges] = 0
    before = before[:-1]
    begins = np.flatnonzero((kinds > 0) & ((before == 0) | (before ^ kinds == LETTER ^ SYMBOL)))
    solid = kinds > 0
    offsets = np.append(np.cumsum(solid)[begins] - 1, np.count_nonzero(solid))
    words = pa.Array.from_buffers(pa.large_string(), len(begins), [None, pa.py_buffer(offsets), pa.py_buffer(data[solid])]).dictionary_encode()
    known = _known[path]
    starts, counts = (x[words.indices.to_numpy()] for x in known.find(words.dictionary.to_numpy(zero_copy_only=False).tolist()))
    ends = np.cumsum(np.append(0, counts))
    ids = known.ids[np.repeat(starts - ends[:-1], counts) + np.arange(ends[-1])]
    of_texts = ends[np.searchsorted(begins, edges)].tolist()
    return [ids[a:b].tobytes() for a, b in pairwise(of_texts)]


def piece_lengths(n: int, most: int) -> list[int]:
    """Full sequences, then the binary digits of what is left, from the largest."""
    rest = n % most
    return [most] * (n // most) + [1 << k for k in reversed(range(rest.bit_length())) if rest >> k & 1]


def pack(docs: DataFrame, tokenizer_path: str, end_id: int = 1, most: int = 2048) -> DataFrame:
    """Cuts each document's token ids, closed by `end_id`, into pieces of power-of-two length of at most `most`.

    `most` is a power of two. Each piece is a sequence, so none crosses documents and none holds padding; sequences
    of equal length (`bucket`) batch together. Returns one row per piece: doc_id, start, length, bucket (log2 of
    the length), doc_tokens, sequence_id (unique, arbitrary), offset (0) and ids (little-endian 32-bit). A null or
    empty text has the end id alone; repeated rows and rows of null or equal doc_id are packed row by row; extra columns take no part.
    Row-local: no exchange, memory bounded by slices of a batch and the longest document.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end = np.array([end_id], dtype="<u4").tobytes()
        for batch in batches:
            for part in slices(batch, "text"):
                out: list[list] = [[], [], [], [], []]
                texts = [t or "" for t in part.column("text").to_pylist()]
                for doc, ids in zip(part.column("doc_id").to_pylist(), encode(texts, tokenizer_path), strict=True):
                    ids += end
                    total, start = len(ids) // 4, 0
                    for length in piece_lengths(total, most):
                        for column, value in zip(out, (doc, start, length, total, ids[4 * start : 4 * (start + length)]), strict=True):
                            column.append(value)
                        start += length
                kinds = (part.schema.field("doc_id").type, pa.int64(), pa.int64(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], ["doc_id", "start", "length", "doc_tokens", "ids"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    pieces = docs.select("doc_id", "text").mapInArrow(cut, f"doc_id {kind}, start long, length long, doc_tokens long, ids binary")
    return pieces.select(
        "doc_id", "start", "length", F.log2("length").cast("int").alias("bucket"), "doc_tokens",
        F.monotonically_increasing_id().alias("sequence_id"), F.lit(0).cast("long").alias("offset"), "ids",
    )
