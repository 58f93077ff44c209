"""A Merkle manifest of a dataset, with a proof for every row, by cogrouped subtree exchange.

Per source, leaves in ascending doc_id; every 3 consecutive nodes make one of the next level. Leaves are
dealt into superblocks of 3^DEPTH. Upwards, each superblock is reduced to one node by itself, and these
nodes are dealt into superblocks again, until a source has one; the sources' roots then go through the same
steps. Downwards, the nodes of a superblock are cogrouped with the siblings that its own node needs
from there to the root (a few dozen digests), and one applyInPandas call reduces the block,
joins each node's siblings inside to those outside, and folds.

Scale: a group never exceeds a superblock, however large its source. Places within a source come from ranges of
(source, doc_id) and their sizes, not from one sorted task per source. The driver sees one count per level.
"""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quillmark.llm.common import cut

WAYS, DEPTH = 3, 7
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def _h(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(fields: dict[str, Column]) -> Column:
    """Digest of the fields in order: `-` for null, else the UTF-8 bytes, a colon and the value."""
    def one(c: Column) -> Column:
        c = c.cast("string")
        return F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-"))

    return F.sha2(F.concat(*map(one, fields.values())), 256)


def source_key(source: Column) -> Column:
    """A source as a key that is never null and sorts null first, then by UTF-8 bytes."""
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit(""))


def placed(nodes: DataFrame, order: list[str]) -> DataFrame:
    """Adds pos and n, a row's place (from 0) in its ``tree`` by ``order`` and the rows of the tree."""
    parted = cut(nodes.repartitionByRange("tree", *order).withColumn("range", F.spark_partition_id()))
    sizes = parted.groupBy("tree", "range").agg(F.count("*").alias("rows"))
    sizes = sizes.select("tree", "range", (F.sum("rows").over(W.partitionBy("tree").orderBy("range")) - F.col("rows")).alias("before"), F.sum("rows").over(W.partitionBy("tree")).alias("n"))
    here = F.row_number().over(W.partitionBy("tree", "range").orderBy(*order))
    return parted.withColumn("pos", here - 1).join(sizes, ["tree", "range"]).withColumn("pos", F.col("pos") + F.col("before")).drop("range", "before")


def _levels(hashes: list[str], n: int, depth: int) -> list[list[str]]:
    """The nodes of a superblock level by level, up to ``depth`` levels or the end of a tree of n nodes."""
    out = [hashes]
    while len(out) <= depth and n > 1:
        below = out[-1]
        out.append([_h("".join(below[k : k + WAYS])) for k in range(0, len(below), WAYS)])
        n = -(-n // WAYS)
    return out


def climb(nodes: DataFrame, depth: int = DEPTH) -> list[DataFrame]:
    """Tables of nodes (tree, block, pos, n, hash) from ``nodes`` (tree, pos, n, hash) up to one node per tree."""
    def reduce(pdf: pd.DataFrame) -> pd.DataFrame:
        top = _levels(pdf.sort_values("pos").hash.tolist(), int(pdf.n.iloc[0]), depth)[-1]
        return pd.DataFrame({"tree": pdf.tree.iloc[:1], "pos": pdf.block.iloc[:1], "n": -(-pdf.n.iloc[:1] // WAYS**depth), "hash": top})

    block = F.expr(f"pos div {WAYS**depth}")
    out = [nodes.withColumn("block", block)]
    while (out[-1].agg(F.max("n").alias("n")).first().n or 0) > 1:
        above = out[-1].select("tree", "block", "pos", "n", "hash").groupBy("tree", "block").applyInPandas(reduce, "tree string, pos long, n long, hash string")
        out.append(cut(above.withColumn("block", block)))
    return out


OUTER = "tree string, block long, before array<string>, after array<string>, subroot string, root string"


def _walk(inner: pd.DataFrame, outer: pd.DataFrame, depth: int):
    """Each node of a superblock in order, with its siblings before and after it from its level to the root."""
    inner = inner.sort_values("pos")
    levels = _levels(inner.hash.tolist(), int(inner.n.iloc[0]), depth)
    before, after = list(outer.before.iloc[0]), list(outer.after.iloc[0])
    for at in range(len(inner)):
        b, a, k = [], [], at
        for nodes in levels[:-1]:
            first = k - k % WAYS
            b.append("".join(nodes[first:k]))
            a.append("".join(nodes[k + 1 : first + WAYS]))
            k //= WAYS
        yield b + before, a + after


def _outer(tree, block, paths: list, subroot, above: pd.DataFrame) -> pd.DataFrame:
    """Rows of OUTER; none where one side of the cogroup is missing."""
    root = above.root.iloc[0] if paths else None
    out = pd.DataFrame({"tree": tree, "block": block, "before": None, "after": None, "subroot": subroot, "root": root})[: len(paths)]
    return out.assign(before=[b for b, _ in paths], after=[a for _, a in paths])


def descend(levels: list[DataFrame], tops: DataFrame, depth: int = DEPTH) -> DataFrame:
    """The outer siblings of the superblocks of the lowest table; ``tops``: those of whole trees (OUTER)."""
    def lower(inner: pd.DataFrame, outer: pd.DataFrame) -> pd.DataFrame:
        paths = list(_walk(inner, outer, depth)) if len(inner) and len(outer) else []
        inner = inner.sort_values("pos")
        return _outer(inner.tree, inner.pos, paths, outer.subroot.iloc[0] if paths else None, outer)

    for table in reversed(levels[1:]):
        inner = table.select("tree", "block", "pos", "n", "hash").groupBy("tree", "block")
        tops = cut(inner.cogroup(tops.groupBy("tree", "block")).applyInPandas(lower, OUTER))
    return tops


def prove(leaves: DataFrame, depth: int = DEPTH) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root for every row of ``leaves``: doc_id, source, leaf and
    claim, the leaf to fold with the tree's siblings.

    Leaves of equal doc_id and source stand by leaf, then claim; null ids come first. An empty table gives no rows.
    """
    nodes = cut(leaves.select(source_key(F.col("source")).alias("tree"), "doc_id", F.col("leaf").alias("hash"), "claim"))
    nodes = cut(placed(nodes, ["doc_id", "hash", "claim"]).withColumn("doc_id", F.col("doc_id").cast("string")))  # pandas holds null numbers as floats
    inside = climb(nodes, depth)
    roots = inside[-1].select(F.col("tree").alias("of"), "hash")
    above = placed(roots.withColumn("tree", F.lit("")), ["of"])
    above = climb(cut(above), depth)
    blank = F.array().cast("array<string>")
    top = above[-1].select("tree", F.lit(0).cast("long").alias("block"), blank.alias("before"), blank.alias("after"), F.col("hash").alias("subroot"), F.col("hash").alias("root"))
    outer = descend(above, top, depth)

    def spread(inner: pd.DataFrame, out: pd.DataFrame) -> pd.DataFrame:
        paths = list(_walk(inner, out, depth)) if len(inner) and len(out) else []
        inner = inner.sort_values("pos")
        return _outer(inner["of"], 0, paths, inner.hash, out)

    sources = above[0].select("tree", "block", "pos", "n", "hash", "of").groupBy("tree", "block").cogroup(outer.groupBy("tree", "block")).applyInPandas(spread, OUTER)
    outer = descend(inside, cut(sources), depth)

    def fold(inner: pd.DataFrame, out: pd.DataFrame) -> pd.DataFrame:
        inner, rows = inner.sort_values("pos"), []
        if len(inner) and len(out):
            for (b, a), claim in zip(_walk(inner, out, depth), inner.claim):
                for x, y in zip(b, a):
                    claim = _h(x + claim + y)
                rows.append((_h("".join(x + y for x, y in zip(b, a))), claim))
        part = inner[: len(rows)]
        return pd.DataFrame({"doc_id": part.doc_id, "leaf": part.hash, "subroot": out.subroot.iloc[0] if rows else None, "root": out.root.iloc[0] if rows else None,
                             "proof_sha256": [p for p, _ in rows], "folded_root": [f for _, f in rows]})

    below = inside[0].select("tree", "block", "pos", "n", "hash", "doc_id", "claim").groupBy("tree", "block")
    done = below.cogroup(outer.groupBy("tree", "block")).applyInPandas(fold, "doc_id string, leaf string, subroot string, root string, proof_sha256 string, folded_root string")
    return done.withColumn("doc_id", F.col("doc_id").cast("long"))


def manifest(docs: DataFrame, shown: Column | None = None, depth: int = DEPTH) -> DataFrame:
    """The proofs of all rows of ``docs`` (FIELDS), and ``verified``: whether the text ``shown`` in place of a row's
    own (by default its own) folds to the root.

    Nulls are values of their own; very long texts are hashed whole; repeated rows are leaves each. Further columns are not read.
    """
    own = {c: F.col(c) for c in FIELDS}
    leaves = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", leaf(own).alias("leaf"), *([] if shown is None else [leaf(own | {"text": shown}).alias("claim")]))
    out = prove(leaves if shown is not None else leaves.withColumn("claim", F.col("leaf")), depth)
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
