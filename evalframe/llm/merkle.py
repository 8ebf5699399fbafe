"""Merkle dataset manifest: hash trees over documents, stored as aligned subtrees in van Emde Boas order."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalframe.llm.common import durable, ranked, written

ARITY = 3
#: Height of a block: it spans up to ARITY**HEIGHT nodes of the level that it stands on.
HEIGHT = 6
SPAN = ARITY**HEIGHT
BYTES = 32


def nodes_of(levels: int) -> int:
    """Nodes of a whole tree of so many levels."""
    return (ARITY**levels - 1) // (ARITY - 1)


def addresses(levels: int, depth: int, index: np.ndarray) -> np.ndarray:
    """Where the nodes `index` of a depth (0: the root) stand in a tree of so many levels: the upper half of its levels comes
    first, then each subtree that hangs below it, and each of these parts is laid out by the same rule."""
    if levels == 1:
        return np.zeros(len(index), dtype=np.int64)
    top = levels // 2
    if depth < top:
        return addresses(top, depth, index)
    under = ARITY ** (depth - top)
    return nodes_of(top) + index // under * nodes_of(levels - top) + addresses(levels - top, depth - top, index % under)


def widths(n: int, height: int) -> list[int]:
    """How many nodes a block over n nodes has at each depth, the root's first."""
    out = [n]
    for _ in range(height):
        out.append(-(-out[-1] // ARITY))
    return out[::-1]


def height_of(n: int) -> int:
    """Levels above n nodes until one remains."""
    height = 0
    while n > 1:
        n, height = -(-n // ARITY), height + 1
    return height


def hashed(parts: list[str]) -> bytes:
    return hashlib.sha256("".join(parts).encode()).digest()


def stored(digests: list[bytes], height: int) -> bytes:
    """A block's nodes in van Emde Boas order, from the digests it stands on; places of absent nodes hold zeros."""
    cells = np.zeros((nodes_of(height + 1), BYTES), dtype=np.uint8)
    cells[addresses(height + 1, height, np.arange(len(digests)))] = np.frombuffer(b"".join(digests), np.uint8).reshape(-1, BYTES)
    counts = widths(len(digests), height)
    for depth in range(height, 0, -1):
        kids = [k.tobytes().hex() for k in cells[addresses(height + 1, depth, np.arange(counts[depth]))]]
        made = [hashed(kids[i : i + ARITY]) for i in range(0, len(kids), ARITY)]
        cells[addresses(height + 1, depth - 1, np.arange(len(made)))] = np.frombuffer(b"".join(made), np.uint8).reshape(-1, BYTES)
    return cells.tobytes()


def siblings(nodes: bytes, n: int, height: int) -> list[list[tuple[str, str]]]:
    """For each of a block's n lowest nodes, what stands left and right of its path in its run at each level, lowest first."""
    cells = np.frombuffer(nodes, np.uint8).reshape(-1, BYTES)
    beside = []
    for depth, count in enumerate(widths(n, height)):
        row = [c.tobytes().hex() for c in cells[addresses(height + 1, depth, np.arange(count))]]
        beside.append([("".join(row[i - i % ARITY : i]), "".join(row[i + 1 : i - i % ARITY + ARITY])) for i in range(count)])
    return [[beside[height - k][i // ARITY**k] for k in range(height)] for i in range(n)]


def folded(digest: bytes, path: list[tuple[str, str]]) -> str:
    """The root that a node and the nodes beside its path give."""
    for left, right in path:
        digest = hashed([left, digest.hex(), right])
    return digest.hex()


def grown(leaves: DataFrame, name: str) -> list[DataFrame]:
    """The blocks of all trees, one table for each level of blocks, the lowest first: tree, block, size (nodes of the tree at the
    level that the block stands on), height, nodes, and members (the lowest level's rows without tree, pos and size).

    `leaves` has tree, pos, size, digest and any other columns. A block's root is a node that the next level's blocks
    stand on, until every tree has one root; a tree of n leaves takes log(n) / log(SPAN) rounds.
    """

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column("size").to_pylist()
            lists = [[m["digest"] for m in x] for x in batch.column("members").to_pylist()]
            heights = [HEIGHT if size > SPAN else height_of(size) for size in sizes]
            nodes = [stored(x, h) for x, h in zip(lists, heights, strict=True)]
            columns = [batch.column("tree"), batch.column("block"), batch.column("size"), pa.array(heights, pa.int32()), pa.array(nodes, pa.binary()), batch.column("members")]
            yield pa.RecordBatch.from_arrays(columns, ["tree", "block", "size", "height", "nodes", "members"])

    out, level = [], leaves
    while True:
        kept = F.struct("pos", *[c for c in level.columns if c not in ("tree", "pos", "size")])
        grouped = level.groupBy("tree", F.expr(f"pos div {SPAN}").alias("block")).agg(F.first("size").alias("size"), F.array_sort(F.collect_list(kept)).alias("members"))
        fields = grouped.schema["members"].dataType.simpleString()
        out.append(written(grouped.select("tree", "block", "size", "members").mapInArrow(store, f"tree string, block long, size long, height int, nodes binary, members {fields}"), f"{name}-{len(out)}"))
        open_ = out[-1].where(F.col("size") > SPAN)
        if not open_.limit(1).count():
            return out
        level = open_.select("tree", F.col("block").alias("pos"), F.expr(f"(size + {SPAN - 1}) div {SPAN}").alias("size"), F.substring("nodes", 1, BYTES).alias("digest"))


PATH = "lefts array<string>, rights array<string>, roots array<string>"


def descended(levels: list[DataFrame], outer: DataFrame, emit: Callable, schema: str) -> DataFrame:
    """What `emit(member, path, roots)` makes of every leaf, as rows of `schema`. `path` holds the nodes beside the leaf's path, up to its
    tree's root and on along the outer path; `roots` holds its tree's root, then the outer ones.

    `outer` has tree, lefts, rights and roots. From the highest blocks down, each block reads the nodes beside its lowest
    nodes by address and hands them to the blocks below, so a path's upper part is made once for a block.
    """

    def down(lowest: bool) -> Callable:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                # A few blocks at a time: their leaves' paths are some dozen times the blocks' bytes.
                for at in range(0, batch.num_rows, 8):
                    rows = []
                    for b in batch.slice(at, 8).to_pylist():
                        above = list(zip(b["lefts"], b["rights"], strict=True))
                        roots = ([b["nodes"][:BYTES].hex()] if b["size"] <= SPAN else []) + b["roots"]
                        for m, own in zip(b["members"], siblings(b["nodes"], len(b["members"]), b["height"]), strict=True):
                            path = own + above
                            rows.append(emit(m, path, roots) if lowest else (b["tree"], m["pos"], [x for x, _ in path], [x for _, x in path], roots))
                    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(wanted[lowest])], schema=wanted[lowest])

        return run

    schemas = {True: schema, False: f"tree string, block long, {PATH}"}
    spark = outer.sparkSession
    wanted = {k: spark.createDataFrame([], s).toArrow().schema for k, s in schemas.items()}
    handed = None
    for level in reversed(range(len(levels))):
        blocks = levels[level]
        met = blocks.where(F.col("size") <= SPAN).join(outer, "tree")
        if handed is not None:
            met = met.unionByName(blocks.where(F.col("size") > SPAN).join(handed, ["tree", "block"]))
        handed = met.mapInArrow(down(level == 0), schemas[level == 0])
        handed = durable(handed) if level else handed
    return handed


def field(c: Column) -> Column:
    """`-` for null, else the UTF-8 bytes' number, a colon and the value."""
    value = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def digest(docs: DataFrame, text: Column) -> Column:
    return F.unhex(F.sha2(F.concat(*[field(docs[c]) for c in ("doc_id", "source", "lang", "n_chars")], field(text)), 256))


def manifest(docs: DataFrame) -> tuple[list[DataFrame], list[DataFrame]]:
    """(blocks of the sources' trees, blocks of the tree over their roots) as `grown` gives them, all durable.

    A source's leaves ascend by doc_id (nulls first, then by digest); sources ascend by name (null first, bytewise). The
    lowest members carry doc_id, the leaf's digest and the digest of the tampered row (null where it doesn't differ).
    """
    changed = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, digest(docs, F.replace(docs["text"], F.lit("\n"), F.lit(""))))
    # A null source sorts before all names.
    tree = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit(""))
    rows = docs.select("doc_id", tree.alias("tree"), digest(docs, docs["text"]).alias("digest"), changed.alias("changed"))
    rows = written(rows.withColumn("changed", F.nullif("changed", "digest")), "leaves")
    inner = grown(ranked(rows, "tree", ["doc_id", "digest"]), "blocks")
    tops = [level.where(F.col("size") <= SPAN).select(F.col("tree").alias("name"), F.substring("nodes", 1, BYTES).alias("digest")) for level in inner]
    roots = tops[0]
    for more in tops[1:]:
        roots = roots.unionByName(more)
    return inner, grown(ranked(roots.withColumn("tree", F.lit("")), "tree", ["name"]), "sources")


def proofs(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified of every row, all digests lowercase hex.

    The leaf's path goes through its source's tree and the tree over sources. `folded_root` is folded from the tampered
    row's leaf (rows whose crc32(doc_id) is even lose their line feeds) and the untampered nodes beside the path. A null doc_id
    is never tampered. Rows repeated whole are leaves each. An empty table gives no rows; columns other than
    doc_id, source, lang, n_chars and text take no part.
    """
    inner, outer = manifest(docs)
    spark = docs.sparkSession
    start = spark.range(1).select(F.lit("").alias("tree"), *[F.array().cast("array<string>").alias(c) for c in ("lefts", "rights", "roots")])
    paths = durable(descended(outer, start, lambda m, path, roots: (m["name"], [x for x, _ in path], [x for _, x in path], roots), f"tree string, {PATH}"))

    def proof(m: dict, path: list[tuple[str, str]], roots: list[str]) -> tuple:
        got = folded(m["changed"] or m["digest"], path)
        return m["doc_id"], m["digest"].hex(), roots[0], roots[1], hashed([x for pair in path for x in pair]).hex(), got, got == roots[1]

    return descended(inner, paths, proof, "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")
