"""The registered queries of the numbered operators and the SQL that some can be checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evalframe.llm import collocations, language, lattice, line_dedup, media, merkle, minhash, mixing, neighbours, ngram_join, packing, sharding, substring_dedup
from evalframe.llm.common import small_batches


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 40 runs of the Hilbert curve; law `rows`."""
    placed = sharding.shard_documents(table(spark, sf_dir, "documents"), 40)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"),
        "curve_index", "position",
    )


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without later occurrences of three-line windows."""
    kept = line_dedup.dedup_lines(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents by five-word shingles at a Jaccard similarity of 0.8."""
    return ngram_join.components(table(spark, sf_dir, "documents"))


def fold(modulus: int) -> Column:
    """Whether a document is held out: crc32(doc_id as text) mod `modulus` is 2."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus == 2, F.lit(False))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of all documents; the model learns from those that are not held out."""
    docs = table(spark, sf_dir, "documents")
    found = language.identify(docs.select("doc_id", "text"), language.fit(docs, ~fold(4)))
    return found.select("doc_id", fold(4).alias("held_out"), "lang_pred", "score", "rejected")


def op5_entropy_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed to weights 1, 2, 3, repeating, over their sources."""
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source", "rate", "copies")


def op7_subword_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents; the model learns from those that are not held out."""
    import public_tokenizers

    return lattice.score(table(spark, sf_dir, "documents"), fold(7), public_tokenizers.path("piece_bpe_32k.model"))


def op4_chunked_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All texts stored as content-defined chunks and read back; media_bytes and media_sha256 are those of the digests and frames read."""
    read = media.media_column(table(spark, sf_dir, "documents"))
    return read.select(
        "doc_id", "n_bytes", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -16, 16)).alias("tail_crc32"), F.octet_length("kept").cast("long").alias("media_bytes"),
        F.sha2("kept", 256).alias("media_sha256"), "feature",
    )


def op6_pack_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents cut into power-of-two pieces, each a sequence."""
    import public_tokenizers

    pieces = packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "bucket")


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without 13-word windows that start in a smaller document."""
    kept = substring_dedup.dedup_substrings(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op9_block_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of embeddings whose vec_id is divisible by 20, against all rows."""
    rows = table(spark, sf_dir, "embeddings")
    return neighbours.nearest(rows, rows.where("vec_id % 20 = 0"), 20)


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaves, proofs and folded roots of all documents."""
    return merkle.proofs(table(spark, sf_dir, "documents"))


def op12_phrase_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 2000 collocations of each language of all documents."""
    return collocations.phrases(table(spark, sf_dir, "documents"))


def op13_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents by four-word shingles at a Jaccard similarity of 0.8."""
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


OP10_SQL = """
with lines as (select doc_id, string_split(text, chr(10)) l from documents),
pos as (select doc_id, l, unnest(range(1, len(l) - 1)) i from lines where len(l) >= 3),
w as (select doc_id, i, l[i] a, l[i + 1] b, l[i + 2] c from pos),
f as (select a, b, c, min({'d': doc_id, 'i': i}) first from w group by a, b, c having count(*) > 1),
later as (select w.doc_id, w.i from w join f on w.a = f.a and w.b = f.b and w.c = f.c where {'d': w.doc_id, 'i': w.i} > f.first),
gone as (select distinct doc_id, unnest([i, i + 1, i + 2]) i from later),
g as (select doc_id, list(i) gone from gone group by doc_id)
select d.doc_id, cast(coalesce(len(n.l), 0) as bigint) n_lines, cast(coalesce(len(g.gone), 0) as bigint) n_removed,
  sha256(case when g.gone is null then coalesce(d.text, '')
    else array_to_string([x for x, i in n.l if not list_contains(g.gone, i)], chr(10)) end) kept_sha256
from documents d left join lines n on d.doc_id = n.doc_id left join g on d.doc_id = g.doc_id
"""

OP9_SQL = """
with v as (select vec_id, list_transform(embedding, lambda x: cast(x as double)) e from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
s as (select q.vec_id query_id, x.vec_id, list_reduce(list_transform(list_zip(q.e, x.e), lambda p: p[1] * p[2]), lambda a, b: a + b, cast(0 as double)) score
  from v q join v x on q.vec_id <> x.vec_id and len(q.e) = len(x.e) where q.vec_id % 20 = 0)
select query_id, cast(row_number() over (partition by query_id order by score desc, vec_id) as int) "rank", vec_id, score from s
qualify row_number() over (partition by query_id order by score desc, vec_id) <= 20
"""

OP8_SQL = r"""
with t as (select doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') ws from documents),
p as (select doc_id, ws, unnest(range(1, len(ws) - 11)) i from t where len(ws) >= 13),
w as (select doc_id, i, array_to_string(ws[i:i + 12], ' ') s from p),
f as (select s, min(doc_id) low, max(doc_id) high from w group by s having min(doc_id) < max(doc_id)),
gone as (select distinct w.doc_id, unnest(range(i, i + 13)) i from w join f on w.s = f.s where w.doc_id > f.low),
g as (select doc_id, list(i) gone from gone group by doc_id)
select t.doc_id, cast(len(ws) as bigint) n_words, cast(coalesce(len(gone), 0) as bigint) n_removed,
  sha256(array_to_string(case when gone is null then ws else list_filter(ws, lambda x, i: not list_contains(gone, i)) end, ' ')) kept_sha256
from t left join g on t.doc_id = g.doc_id
"""

def _field(c: str) -> str:
    return f"coalesce(cast(strlen(cast({c} as varchar)) as varchar) || ':' || cast({c} as varchar), '-')"


_LEAF = "sha256(" + " || ".join(_field(c) for c in ("doc_id", "source", "lang", "n_chars")) + " || {})"
# Each document's path follows the levels of its source's tree and then those of the tree over sources, numbered on.
OP11_SQL = f"""
with recursive l as (select doc_id, coalesce('=' || source, '') tree, {_LEAF.format(_field("text"))} leaf, {_LEAF.format(_field("replace(text, chr(10), '')"))} other from documents),
crc as (select d.doc_id, list_reduce(list_prepend(cast(4294967295 as bigint), list_transform(range(1, strlen(cast(d.doc_id as varchar)) + 1), lambda i: cast(ascii(cast(d.doc_id as varchar)[i]) as bigint))),
  lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, z: xor(x // 2, (x % 2) * 3988292384))) % 2 = 1 as even from (select distinct doc_id from documents where doc_id is not null) d),
p as (select l.*, coalesce(even, false) even, row_number() over (partition by tree order by l.doc_id nulls first, leaf) - 1 pos from l left join crc on l.doc_id = crc.doc_id),
t as (select tree, 0 lev, pos, leaf h from p
  union all select tree, lev + 1, pos // 3, sha256(string_agg(h, '' order by pos)) from (select *, count(*) over (partition by tree) n from t) where n > 1 group by tree, lev, pos // 3),
tops as (select tree, max(lev) height, max_by(h, lev) subroot from t group by tree),
u as (select 0 lev, row_number() over (order by tree) - 1 pos, subroot h from tops
  union all select lev + 1, pos // 3, sha256(string_agg(h, '' order by pos)) from (select *, count(*) over () n from u) where n > 1 group by lev, pos // 3),
top as (select max(lev) height, max_by(h, lev) root from u),
place as (select tree, height, subroot, row_number() over (order by tree) - 1 spot from tops),
own as (select row_number() over () id, p.*, height, subroot, spot from p join place using (tree)),
beside as (select id, lev, string_agg(h, '' order by t.pos) filter (t.pos < own.pos // cast(3 ** lev as bigint)) a, string_agg(h, '' order by t.pos) filter (t.pos > own.pos // cast(3 ** lev as bigint)) b
  from own join t on own.tree = t.tree and lev < height and t.pos // 3 = own.pos // cast(3 ** (lev + 1) as bigint) group by id, lev
  union all select id, own.height + lev, string_agg(h, '' order by u.pos) filter (u.pos < spot // cast(3 ** lev as bigint)), string_agg(h, '' order by u.pos) filter (u.pos > spot // cast(3 ** lev as bigint))
  from own join u on lev < (select height from top) and u.pos // 3 = spot // cast(3 ** (lev + 1) as bigint) group by id, own.height, lev),
f as (select id, 0 lev, case when even then other else leaf end h from own
  union all select f.id, f.lev + 1, sha256(coalesce(a, '') || f.h || coalesce(b, '')) from f join beside on f.id = beside.id and f.lev = beside.lev),
g as (select id, max_by(h, lev) folded_root from f group by id),
q as (select id, sha256(string_agg(coalesce(a, '') || coalesce(b, ''), '' order by lev)) proof from beside group by id)
select doc_id, leaf, subroot, root, coalesce(proof, sha256('')) proof_sha256, folded_root, folded_root = root verified
from own cross join top join g on own.id = g.id left join q on own.id = q.id
"""

OP12_SQL = r"""
with d as (select coalesce(lang, 'und') lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') t from documents),
p as (select lang, unnest(string_split_regex(t, '[.,;:!?\x0A-\x0D]')) t from d),
w as (select lang, list_filter(string_split_regex(t, '[\x20\x09]+'), lambda x: x <> '') ws from p),
g as (select lang, k, unnest(list_transform(range(1, len(ws) - k + 2), lambda i: ws[i:i + k - 1])) g from w, (values (1), (2), (3)) v(k) where len(ws) >= k),
f as (select lang, k, g, count(*) f from g group by all),
n as (select lang, sum(f) n from f where k = 1 group by 1),
c as (select * from f where k > 1 and f >= 10),
held as (select lang, g[1:2] g, max(f) f from c where k = 3 group by all union all select lang, g[2:3], max(f) from c where k = 3 group by all),
kept as (select * from c where not exists (from held where held.lang = c.lang and held.g = c.g and 100 * held.f >= 50 * c.f)),
cut as (select c.lang, c.g, cut, c.f a, x.f l, y.f r, (cast(1000000 as hugeint) * c.f * c.f) // (cast(x.f as hugeint) * y.f) score
  from kept c, (values (1), (2)) v(cut), f x, f y where cut < c.k and x.lang = c.lang and x.g = c.g[1:cut] and y.lang = c.lang and y.g = c.g[cut + 1:]),
best as (select * from cut qualify row_number() over (partition by lang, g order by score, cut) = 1),
named as (select lang, array_to_string(g, ' ') phrase, a, l, r, score from best)
select lang, row_number() over (partition by lang order by score desc, a desc, phrase) "rank", phrase, a, l, r, cast(n as bigint) n, cast(score as bigint) score
from named join n using (lang) qualify row_number() over (partition by lang order by score desc, a desc, phrase) <= 2000
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_hilbert_shards": op1_hilbert_shards,
    "op2_ngram_join": op2_ngram_join,
    "op3_language_id": op3_language_id,
    "op5_entropy_mix": op5_entropy_mix,
    "op7_subword_lattice": op7_subword_lattice,
    "op4_chunked_media": op4_chunked_media,
    "op6_pack_binary": op6_pack_binary,
    "op8_substring_dedup": op8_substring_dedup,
    "op9_block_neighbours": op9_block_neighbours,
    "op10_line_dedup": op10_line_dedup,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_phrase_filters": op12_phrase_filters,
    "op13_minhash_dedup": op13_minhash_dedup,
}
ORACLE_SQL: dict[str, str] = {"op8_substring_dedup": OP8_SQL, "op9_block_neighbours": OP9_SQL, "op10_line_dedup": OP10_SQL, "op11_merkle_manifest": OP11_SQL, "op12_phrase_filters": OP12_SQL}
