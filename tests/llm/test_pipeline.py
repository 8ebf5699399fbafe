"""The pipeline's stages against brute force, each on what the one before kept."""

import random
from collections import Counter

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from tests.llm.test_models import brute_targets, prose
from tests.llm.test_pairs import brute_components
from tests.llm.test_row_local import brute_lines


def test_stages(spark, docs_of, tmp_path):
    rng = random.Random(11)
    rows = []
    for i in range(150):
        lang = rng.choice(["aa", "bb", "cc"])
        rows.append((i, "\n".join(prose(rng, lang, rng.randrange(2, 9)) for _ in range(rng.randrange(1, 12))), lang, rng.choice(["s0", "s0", "s1", None])))
    rows += [(200 + i, rows[i][1], *rows[i][2:]) for i in range(20)]  # copies
    rows += [(300 + i, rows[i][1] + " extra", *rows[i][2:]) for i in range(20)]  # near copies
    rows += [(400, None, "aa", "s0"), (401, "", None, "s1"), (402, "12 34", "bb", None)]
    docs_of(rows).write.parquet(f"{tmp_path}/documents.parquet")
    docs, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        if name != "packing":
            assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        seen[name] = [r.asDict() for r in docs.collect()]
    assert {r["doc_id"] for r in seen["language_id"]} == {d for d, *_ in rows if d < 400}
    want = [(d, t) for d, t, n, gone in brute_lines([(r["doc_id"], r["text"]) for r in seen["language_id"]]) if not gone or t]
    assert sorted((r["doc_id"], r["text"]) for r in seen["line_dedup"]) == sorted(want)
    assert all(r["n_chars"] == len(r["text"]) for r in seen["line_dedup"])
    groups = brute_components(want)
    assert sorted(r["doc_id"] for r in seen["near_duplicates"]) == sorted({c for _, _, c in groups})
    size = Counter()
    for r in seen["near_duplicates"]:
        size[r["source"]] += len(r["text"].split())
    taken = Counter()
    for r in seen["mixing"]:
        taken[r["source"]] += len(r["text"].split())
    assert all(abs(taken[s] - t) <= 2 * 110 for s, t in brute_targets(size).items())
    plain = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ids = Counter()
    for r in seen["mixing"]:
        ids[r["doc_id"]] += len(plain.encode(r["text"], add_special_tokens=False).ids) + 1
    got = Counter()
    for r in seen["packing"]:
        got[r["doc_id"]] += r["length"]
    assert got == ids and len({r["sequence_id"] for r in seen["packing"]}) == len(seen["packing"])
    assert all(np.log2(r["length"]) % 1 == 0 for r in seen["packing"])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(seen["packing"])


def test_no_documents(spark, docs_of, tmp_path):
    docs_of([]).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


CLASHING = ["score", "Lang_Pred", "rejected", "n_lines", "n_removed", "size", "target", "copies", "cid", "rep", "component_id", "length", "start"]


def test_columns_named_as_a_stage_makes_them(spark, docs_of, tmp_path):
    """Such columns of the input, of any type, come through every stage unchanged; a very long text too."""
    rng = random.Random(5)
    rows = [(i, "\n".join(prose(rng, "aa" if i % 2 else "bb", 6) for _ in range(6)), "aa" if i % 2 else "bb", "s0") for i in range(40)]
    rows += [(50, rows[0][1] + "\nend", "bb", "s0"), (51, "\n".join(prose(rng, "aa", 8) for _ in range(30_000)), "aa", "s1")]
    docs = docs_of(rows).selectExpr("*", *[f"concat('own ', doc_id) as {c}" for c in CLASHING])
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        if name == "packing":
            assert out.where("doc_id = 51").count() > 0
            return
        assert out.schema.simpleString() == docs.schema.simpleString()
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        kept = docs.collect()
        assert 51 in {r.doc_id for r in kept}
        assert all(r[c] == f"own {r.doc_id}" for r in kept for c in CLASHING)
