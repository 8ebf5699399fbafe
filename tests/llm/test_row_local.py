"""Sharding, line dedup, packing, media and neighbours against brute force on small tables."""

import hashlib
import itertools
import random
import time
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from evalframe.llm import common, line_dedup, media, neighbours, packing, queries, sharding

ODD = [(0, None), (1, ""), (2, "a"), (2, "a"), (None, "x y\nz"), (3, "é ß " * 4000), (4, "a\nb\nc"), (5, "a\nb\nc"), (6, "\n\n\n\n"), (2, "a\nb\nc\nd")]


@pytest.mark.parametrize("dims,bits", [(2, 4), (3, 3)])
def test_curve_steps_to_neighbours(dims, bits):
    place, state = sharding.curve_tables(dims)
    at = {}
    for cell in itertools.product(range(2**bits), repeat=dims):
        s = index = 0
        for level in reversed(range(bits)):
            k = s * 2**dims + sum((c >> level & 1) << j for j, c in enumerate(cell))
            index, s = index * 2**dims + place[k], state[k]
        at[index] = cell
    assert len(at) == 2 ** (bits * dims)
    assert all(sum(abs(a - b) for a, b in zip(at[i], at[i + 1], strict=True)) == 1 for i in range(len(at) - 1))


def test_curve_index_column_follows_the_tables(spark):
    place, state = sharding.curve_tables(3)
    rows = spark.createDataFrame([(i, j, k) for i in range(8) for j in range(8) for k in range(8)], "a int, b int, c int")
    for r in rows.withColumn("h", sharding.hilbert_index([rows.a, rows.b, rows.c], 3)).collect():
        s = index = 0
        for level in (2, 1, 0):
            at = s * 8 + sum((c >> level & 1) << j for j, c in enumerate((r.a, r.b, r.c)))
            index, s = index * 8 + place[at], state[at]
        assert r.h == index


def test_shards(docs_of):
    for rows in (ODD, ODD * 30, []):
        docs = docs_of(rows)
        got = sharding.shard_documents(docs, 4).collect()
        assert len(got) == len(rows)
        counts = {s: sorted(r.slot for r in got if r.shard == s) for s in range(4)}
        assert all(v == list(range(len(v))) for v in counts.values())
        assert max(map(len, counts.values())) - min(map(len, counts.values())) <= 1
        assert sorted(r.position for r in got) == list(range(len(rows)))
        by = sorted(got, key=lambda r: r.position)
        assert [r.curve_index for r in by] == sorted(r.curve_index for r in by)
        sizes = sorted((len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for _, t in rows)
        assert sorted((r["size"], r.text_crc32) for r in got) == sizes


def brute_lines(rows, span=3):
    first = {}
    key = lambda d: 2**63 - 1 if d is None else d
    for d, t in rows:
        lines = (t or "").split("\n")
        for i in range(len(lines) - span + 1):
            w = tuple(lines[i : i + span])
            first[w] = min(first.get(w, (key(d), i)), (key(d), i))
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        gone = {i + k for i in range(len(lines) - span + 1) if (key(d), i) > first[tuple(lines[i : i + span])] for k in range(span)}
        kept = "\n".join(x for i, x in enumerate(lines) if i not in gone)
        out.append((d, None if t is None else kept, 0 if t is None else len(lines), len(gone)))
    return sorted(out, key=str)


def test_line_dedup(docs_of):
    rng = random.Random(3)
    mixed = [(i, "\n".join(rng.choice("abcd") for _ in range(rng.randrange(0, 30)))) for i in range(60)]
    hot = [(i, "p\nq\nr\ns" if i % 3 == 0 else f"{i}\np\nq\nr\n{i}") for i in range(200)]
    for rows in (ODD, mixed, hot, []):
        docs = docs_of(rows).selectExpr("*", "7 as n_removed")
        got = sorted(((r.doc_id, r.text, r.n_lines, r.n_removed) for r in line_dedup.dedup_lines(docs).collect()), key=str)
        assert got == brute_lines(rows)


def test_line_dedup_of_long_texts(docs_of):
    """A text of 200,000 lines takes time in proportion to them: a quadratic step would take minutes."""
    lines = [str(i) for i in range(200_000)]
    docs = docs_of([(1, "\n".join(lines)), (2, "\n".join(["x", *lines, "y"])), (3, "\n".join(["z"] * 100_000))])
    start = time.monotonic()
    got = {r.doc_id: r for r in line_dedup.dedup_lines(docs).collect()}
    assert time.monotonic() - start < 60
    assert (got[1].n_removed, got[1].text) == (0, "\n".join(lines))
    assert (got[2].n_removed, got[2].text) == (200_000, "x\ny")
    assert (got[3].n_removed, got[3].text) == (99_999, "z")


def test_pack(docs_of):
    path = public_tokenizers.path("word_bpe_49k.json")
    plain = Tokenizer.from_file(path)
    texts = [t for _, t in ODD] + ["don't STOP now\x1cso <|endoftext|> á ΣΣ İ", "one two three " * 3000, "x" * 5000]
    rows = list(enumerate(texts))
    got = packing.pack(docs_of(rows), path).collect()
    assert len({r.sequence_id for r in got}) == len(got)
    for doc, text in rows:
        ids = [*plain.encode(text or "", add_special_tokens=False).ids, 1]
        own = sorted((r for r in got if r.doc_id == doc), key=lambda r: r.start)
        assert b"".join(r.ids for r in own) == np.array(ids, "<u4").tobytes()
        assert all(r.doc_tokens == len(ids) and r.offset == 0 and r.length & (r.length - 1) == 0 and r.length <= 2048 and 2**r.bucket == r.length for r in own)
        assert [r.start for r in own] == list(np.cumsum([0, *(r.length for r in own)])[:-1])
    assert packing.pack(docs_of([]), path).count() == 0


def test_pack_lowers_like_the_tokenizer(docs_of):
    path = public_tokenizers.path("word_bpe_49k.json")
    plain = Tokenizer.from_file(path)
    rows = list(enumerate(["ΟΔΟΣ", "ΟΔΟΣ, ΑΣ ΟΔΟς", "H\u0331 T\u0308 W\u030a J\u030c", "Α\u0342 Υ\u0313", "İ É ẞ"]))
    got = sorted(packing.pack(docs_of(rows), path).collect(), key=lambda r: r.start)
    for doc, text in rows:
        ids = [*plain.encode(text, add_special_tokens=False).ids, 1]
        assert b"".join(r.ids for r in got if r.doc_id == doc) == np.array(ids, "<u4").tobytes()


def test_words_of_letters_are_encoded_in_one_call(monkeypatch):
    """The tokenizer as a whole gets symbols and odd words alone, each once."""
    path = public_tokenizers.path("word_bpe_49k.json")
    known = packing.Words(path)
    monkeypatch.setitem(packing._known, path, known)
    plain, asked = Tokenizer.from_file(path), []

    class Whole:
        def encode_batch_fast(self, words, **more):
            asked.extend(words)
            return plain.encode_batch_fast(words, **more)

    known.whole = Whole()
    texts = ["Seven words, (been) seen; été, straße.", "seen: WORDS, been. don't,", "Words seven été straße"]
    got = packing.encode(texts, path)
    assert got == [np.array(plain.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert sorted(asked) == sorted([",", "(", ")", ";", ".", ":", "don't"])


def test_cut_words_have_the_ids_of_whole_texts(monkeypatch):
    path = public_tokenizers.path("word_bpe_49k.json")
    plain, rng = Tokenizer.from_file(path), random.Random(4)
    bits = "a B é É ß ÿ ÷ × µ e\u0301 \u0301 \u0338 Σ ς İ ' 's 't ’ , . ( ) < | > = _ - * 1 23 ² 한 я 😀 <|endoftext|> <| the ing".split() + [" ", " ", " ", "\n", "\t", "\x0b", "\x1c", "\x85", "\xa0", "\u3000"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(14))) for _ in range(6000)]
    want = [np.array(plain.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    for most in (packing.REMEMBERED, 100):
        monkeypatch.setattr(packing, "REMEMBERED", most)
        monkeypatch.setitem(packing._known, path, packing.Words(path))
        assert [ids for i in range(0, len(texts), 50) for ids in packing.encode(texts[i : i + 50], path)] == want


def test_media_round_trip(docs_of):
    rng = random.Random(5)
    long = "".join(rng.choice("abcdefgh \n") for _ in range(600_000))  # longer than a slice
    rows = [*ODD, (10, long), (11, long[:300_000] + "X" + long[300_000:]), (12, long), (13, "z" * 50_000)]
    stored, unique = media.store(docs_of(rows).selectExpr("*", "1 as row", "2 as digest", "'x' as packed"))
    held = [r.digest for r in unique.collect()]
    once = [d for r in stored.collect() for d, f in zip(r.digests, r.frames, strict=True) if f is not None]
    assert len({*map(bytes, held), *map(bytes, once)}) == len(held) + len(once)  # every chunk is stored once
    got = media.describe(media.rebuild(stored, unique)).collect()
    want = sorted((d is None, d or 0, media.pad(t)) for d, t in rows)
    assert sorted((r.doc_id is None, r.doc_id or 0, (r.n_bytes, bytes(r.payload))) for r in got) == want
    for r in got:
        assert len(r.payload) % 192 == 0 and len(r.payload) > 0
    same = {(r.feature, bytes(r.kept)) for r in got if r.doc_id in (10, 12)}
    assert len(same) == 1
    assert media.media_column(docs_of([])).count() == 0


def test_media_column_sends_no_digests_to_the_driver(docs_of, monkeypatch):
    long = "".join(random.Random(6).choice("abcdefgh") for _ in range(20_000))
    docs = docs_of([*ODD, (10, long), (11, long), (12, None), (12, long)])
    sent = []
    broadcast = type(docs.sparkSession.sparkContext).broadcast
    monkeypatch.setattr(type(docs.sparkSession.sparkContext), "broadcast", lambda self, value: sent.append(value) or broadcast(self, value))
    got = sorted((r.doc_id is None, r.doc_id or 0, (r.n_bytes, bytes(r.payload))) for r in media.media_column(docs).collect())
    assert got == sorted((r.doc_id is None, r.doc_id or 0, media.pad(r.text)) for r in docs.collect())
    assert not any(sent)


def test_media_exchanges_leave_nothing_on_disk(docs_of, spark, monkeypatch):
    """Texts move in parts, and the files of an exchange are gone once what it carried is written."""

    def held():
        files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n")
        return {f for f in files.split("\n") if "/shuffle_" in f}

    rng = random.Random(8)
    long = ["".join(rng.choice("abcdefgh") for _ in range(6000)) for _ in range(40)]
    docs = docs_of([*enumerate(long), *enumerate(long[:20], 100), (7, None), (7, None)])
    parts, written = [], media.written

    def watched(df, name, **more):
        out = written(df, name, **more)
        if name == "media":
            parts.append(len(out.collect()))
        return out

    monkeypatch.setattr(media, "written", watched)
    before, stay = held(), spark.conf.get(common.CLEANUP)
    stored, unique = media.store(docs)
    for _ in range(50):
        if held() <= before:
            break
        time.sleep(0.2)
    assert held() <= before
    assert spark.conf.get(common.CLEANUP) == stay
    assert len(parts) == media.RUNS and sum(parts) == 62 and max(parts) < 50
    assert media.describe(media.rebuild(stored, unique)).count() == 62


def test_media_columns_tell_of_the_stored_bytes(docs_of, spark, tmp_path):
    long = "".join(random.Random(7).choice("abcdefgh") for _ in range(20_000))
    docs = docs_of([(1, long), (2, long), (3, "a" * 5000), (4, None)])
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    stored, unique = media.store(docs)
    shared = {bytes(r.digest): bytes(r.frame) for r in unique.collect()}
    want = {}
    for r in stored.collect():
        names = [bytes(d) for d in r.digests]
        held = b"".join(names) + b"".join(shared[d] if f is None else bytes(f) for d, f in zip(names, r.frames, strict=True))
        want[r.doc_id] = (len(held), hashlib.sha256(held).hexdigest())
    assert {r.doc_id: (r.media_bytes, r.media_sha256) for r in queries.op4_chunked_media(spark, str(tmp_path)).collect()} == want


def test_chunks_follow_content():
    rng = random.Random(1)
    a = bytes(rng.randrange(256) for _ in range(100_000))
    b = a[:500] + b"inserted" + a[500:]
    left, right = media.chunks(a), media.chunks(b)
    assert b"".join(left) == a and len(set(left) & set(right)) > 0.8 * len(left)
    assert all(media.LEAST <= len(c) <= media.MOST for c in left[:-1])
    h = 0
    for byte in a[:3000]:
        h = (h << 1) + int(media.GEAR[byte]) & 2**64 - 1
    assert media.cuts(a[:3000])[-1] == 3000 and h < 2**64


def brute_nearest(rows, top):
    fine = [(i, np.array(v, float)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = []
    for q, v in ((i, v) for i, v in fine if i % 20 == 0):
        near = []
        for i, x in fine:
            if i != q and len(x) == len(v):
                total = 0.0
                for a, b in zip(v, x, strict=True):
                    total += a * b
                near.append((-total, i))
        out += [(q, k + 1, i, -s) for k, (s, i) in enumerate(sorted(near)[:top])]
    return sorted(out)


def test_neighbours(spark):
    rng = np.random.default_rng(2)
    base = [(i, rng.normal(size=16).astype("f4").tolist()) for i in range(300)]
    same = [(i, [1.0] * 16) for i in range(300, 420)]
    odd = [(500, None), (520, []), (540, [0.0] * 16), (560, [float("nan")] * 16), (580, [float("inf")] * 16), (600, [1.0, 2.0]), (None, [1.0] * 16), (501, [None] * 16), (502, [3.0, 4.0]), (620, [1e-30] * 16)]
    for rows in (base + same + odd, odd[:1], []):
        df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
        wide = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
        for block in (64, 2048):
            got = sorted(tuple(r) for r in neighbours.nearest(df, df.where("vec_id % 20 = 0"), 20, block).collect())
            assert got == brute_nearest(wide, 20)


def test_neighbours_deal_blocks_evenly(spark):
    held = spark.range(64).selectExpr("8L as dims", "cast(cast(id as string) as binary) as ids", "cast('x' as binary) as vectors").repartition(3)
    asked = spark.range(3).selectExpr("8L as dims", "cast(cast(id as string) as binary) as ids", "cast('q' as binary) as vectors")
    met = neighbours.dealt(asked, held.union(asked.selectExpr("9L as dims", "ids", "vectors")), 64)
    pairs = [(bytes(r.q_ids), bytes(r.ids)) for r in met.collect()]
    assert len(pairs) == len({*pairs}) == 3 * 64
    loads = met.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()
    assert len(loads) == 8 and max(loads) <= 2 * 3 * 64 / 8


def test_neighbours_move_no_pairs(spark):
    df = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(40)], "vec_id long, embedding array<float>")
    plan = neighbours.nearest(df, df)._jdf.queryExecution().executedPlan().toString()
    above = plan[: plan.index("SortMergeJoin")]
    assert "hashpartitioning(dims" not in plan and "RoundRobin" not in above and above.count("Exchange") == 1
