"""Language ID, mixing and lattice scores against brute force, closed forms and held-out accuracy."""

import math
import random
import re
import zlib
from collections import Counter

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from evalframe.llm import language, lattice, mixing, queries

WORDS = {"aa": "the and with for water house street people", "bb": "der und mit für wasser haus straße leute", "cc": "le et avec pour eau maison rue gens"}


def prose(rng, lang, n):
    return " ".join(rng.choice(WORDS[lang].split()) for _ in range(n))


def test_language_id(docs_of):
    rng = random.Random(1)
    rows = [(i, prose(rng, lang, rng.randrange(3, 200)), lang, "s") for i, lang in enumerate(rng.choice(list(WORDS)) for _ in range(400))]
    odd = [(900, None, "aa", "s"), (901, "", "aa", "s"), (902, "12 !!", "bb", "s"), (903, "ÜÖ " * 50_000, None, None), (None, "the people and the water", None, "s"), (904, "жщю ъыь", None, "s")]
    docs = docs_of(rows + odd).selectExpr("*", "'x' as score", "1 as rejected")
    train = F.col("doc_id") % 4 != 2
    got = language.identify(docs, language.fit(docs, train, 100, 2))
    assert got.columns == ["doc_id", "text", "lang", "source", "n_chars", "lang_pred", "score", "rejected"]
    got = {r.doc_id: r for r in got.collect()}
    held = [(got[i].lang_pred, lang) for i, _, lang, _ in rows if i % 4 == 2]
    assert sum(a == b for a, b in held) > 0.97 * len(held)
    for i in (900, 901, 902):
        assert (got[i].lang_pred, got[i].score, got[i].rejected) == ("und", 0.0, True)
    assert got[904].rejected and got[None].lang_pred == "aa" and not got[None].rejected
    assert all(0 <= r.score <= 1 for r in got.values())
    assert sum(got[i].rejected for i, *_ in rows) <= 0.02 * len(rows)
    empty = docs_of([])
    model = language.fit(empty, F.lit(True))
    assert language.identify(empty, model).count() == 0
    assert language.identify(docs_of(["some text"]), model).first().lang_pred == "und"


def test_language_id_on_held_out_documents(spark):
    got = queries.op3_language_id(spark, "/root/testdata/sf0.01").where("held_out")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    assert got.join(docs, "doc_id").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.97


def brute_targets(size):
    order = sorted((s for s in size if s is not None)) + [None] * (None in size)
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(order)}
    target, free, left = {}, set(size), sum(size.values())
    while True:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 3 * size[s]}
        if not over:
            return target | share
        target |= {s: 3.0 * size[s] for s in over}
        left -= sum(3 * size[s] for s in over)
        free -= over
        if not free:
            return target


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_mix(docs_of, seed):
    rng = random.Random(seed)
    names = ["a", "b", "Z", "é", None, "c"]
    rows = [(i, " ".join(["w"] * rng.randrange(0, 60)) if rng.random() > 0.05 else None, "en", s) for i, s in enumerate(rng.choices(names, [50, 1, 20, 20, 5, 4], k=600))]
    docs = docs_of(rows).selectExpr("*", "1 as size")
    got = mixing.mix(docs).collect()
    size = Counter()
    for _, t, _, s in rows:
        size[s] += len((t or "").split())
    want = brute_targets(size)
    taken = Counter()
    for r in got:
        assert r.source_size == size[r.source] and math.isclose(r.target, want[r.source], rel_tol=1e-9, abs_tol=1e-9)
        assert r.taken == r.copies * r["size"] <= 3 * r["size"]
        taken[r.source] += r.taken
    assert len(got) == len(rows) and all(abs(taken[s] - want[s]) <= 2 * 60 for s in size)
    # The rates meet the constraint and are an exponential of the size.
    for s in size:
        own = [r for r in got if r.source == s]
        assert math.isclose(sum(r.rate * r["size"] for r in own), want[s], rel_tol=1e-6, abs_tol=1e-6)
        tilts = {round(math.log(r.rate) / r["size"], 9) for r in own if r["size"] and r.rate < 3}
        assert len(tilts) <= 1
    assert sorted(map(str, mixing.mix(docs).collect())) == sorted(map(str, got))
    counts = Counter(r.doc_id for r in mixing.repeat(docs_of(rows)).collect())
    assert counts == Counter({r.doc_id: r.copies for r in got if r.copies})


def test_mix_of_odd_rows(docs_of):
    assert mixing.mix(docs_of([])).count() == 0
    got = mixing.mix(docs_of([(1, None), (2, ""), (None, "a b"), (None, "a b"), (3, "x " * 50_000)])).collect()
    assert sorted(r["size"] for r in got) == [0, 0, 2, 2, 50_000]
    assert mixing.mix(docs_of([(1, None), (2, "")])).agg(F.sum("taken")).first()[0] == 0


def brute_word(word, vocabulary):
    p = dict(zip(vocabulary.pieces, vocabulary.logp, strict=True))
    w = b" " + word
    alpha = [1.0] + [0.0] * len(w)
    for j in range(1, len(w) + 1):
        alpha[j] = sum(alpha[i] * math.exp(p[w[i:j]]) for i in range(max(0, j - vocabulary.longest), j) if w[i:j] in p)
    return math.log(alpha[-1]) + vocabulary.logp[-1] if alpha[-1] else -math.inf


def test_word_probability_sums_all_segmentations():
    v = lattice.Vocabulary.load(public_tokenizers.path("piece_bpe_32k.model"))
    words = [b"the", b"a", b"straightforward", "über".encode(), b"x" * 45, b"\n"]
    for w, p in zip(words, lattice.word_logp(words, v), strict=True):
        assert math.isclose(p, brute_word(w, v), rel_tol=1e-9)
    assert math.isfinite(lattice.word_logp([b"ab" * 3000], v)[0])
    # Expected uses: every segmentation covers every byte once, and closes once.
    e = lattice.expected(words, __import__("numpy").ones(len(words)), v)
    assert math.isclose(sum(n * len(p) for n, p in zip(e, v.pieces, strict=True)), sum(len(w) + 1 for w in words), rel_tol=1e-9)


def test_scores(docs_of):
    rng = random.Random(4)
    rows = [(i, prose(rng, "aa", rng.randrange(0, 40)).title()) for i in range(80)] + [(100, None), (101, ""), (102, "zzz\x0bqq " * 9000), (103, " É the"), (103, " É the"), (None, "water")]
    path = public_tokenizers.path("piece_bpe_32k.model")
    got = lattice.score(docs_of(rows), queries.fold(7), path).collect()
    held = lambda d: d is not None and zlib.crc32(str(d).encode()) % 7 == 2
    tokens = lambda t: [*(w.lower() for w in re.findall(rb"[^\x20\x09-\x0d]+", (t or "").encode())), b"\n"]
    c = Counter(w for d, t in rows if not held(d) for w in tokens(t))
    n, v = sum(c.values()), len(c)
    want = sorted((str(d), held(d), len(tokens(t)), sum(c[w] > 0 for w in tokens(t)), round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in tokens(t)), 5)) for d, t in rows)
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, round(r.base_score, 5)) for r in got) == want
    assert {r.train_tokens for r in got} == {n} and all(r.score < 0 for r in got)
    assert lattice.score(docs_of([]), F.lit(False), path).count() == 0
    assert math.isfinite(lattice.score(docs_of(["only held out"]), F.lit(True), path).first().score)
