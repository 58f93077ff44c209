"""Exact dedup by an extendible-hash index on shared files, on built-in functions only.

Texts are equal when they are after every run of ASCII white space became one blank. A text's key is
a 64-bit hash. The directory maps the leading bits of keys to buckets; while a bucket holds more
distinct keys than its capacity, the directory doubles (one more bit), and neighbours that fit
together keep one bucket. A bucket is thus a range of keys, which one owner task sorts and writes. Keys that
several rows share are settled by their bytes: rows are grouped by key and whole text, and the
different texts of a key form its chain. Rows then find their link of the chain by key and digest.

Scale: copies are summed by key before they are dealt to buckets, and by (key, text) within
each map task before texts are shuffled, so a group with a third of all rows sends one text per
task. Only texts whose key recurs are shuffled at all. Rows of a hot key are dealt over tasks.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quillmark.llm.common import SPACE, cut, spread_join

#: Distinct keys a bucket holds; recurring keys up to which they are broadcast (16 bytes each).
CAPACITY, MAX_SMALL, BITS = 1 << 16, 1_000_000, 64


def normal(text: Column) -> Column:
    """Every run of white space as one blank; null as empty. Texts with single blanks alone stay as they are."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    return F.when(text.rlike(r"[\x09-\x0D]|\x20\x20"), F.regexp_replace(text, SPACE, " ")).otherwise(text)


def _key(text: Column, bits: int) -> Column:
    return F.shiftrightunsigned(F.xxhash64(text), 64 - bits) if bits < 64 else F.xxhash64(text)


def _leading(key: Column, bits: int, depth: int) -> Column:
    """The first ``depth`` bits of a key of ``bits`` bits."""
    return F.shiftrightunsigned(key, bits - depth) if depth else F.lit(0).cast("long")


def directory(keys: DataFrame, bits: int = BITS, capacity: int = CAPACITY) -> tuple[DataFrame, int]:
    """slot, bucket for all slots in use, and the directory's depth. ``keys``: distinct column ``key``.

    A bucket is named by a one followed by the leading bits that its keys share."""
    total = keys.count()
    depth = min(bits, max(0, math.ceil(math.log2(max(1, total) / capacity))))
    while True:
        slots = keys.groupBy(_leading(F.col("key"), bits, depth).alias("slot")).agg(F.count("*").alias("n"))
        if depth >= bits or slots.where(F.col("n") > capacity).isEmpty():
            break
        depth += 1  # a bucket is overfull: the directory doubles
    slots = cut(slots)
    near = slots.select("slot", "n", F.explode(F.sequence(F.lit(0), F.lit(depth))).alias("local"))
    near = near.withColumn("bucket", F.expr(f"shiftleft(1L, local) + shiftrightunsigned(slot, {depth} - local)"))
    held = near.groupBy("bucket").agg(F.sum("n").alias("held"))
    fits = near.join(held, "bucket").where((F.col("held") <= capacity) | (F.col("local") == depth))
    return cut(fits.groupBy("slot").agg(F.min("bucket").alias("bucket"))), depth


def build_index(docs: DataFrame, bits: int = BITS, capacity: int = CAPACITY, max_small: int = MAX_SMALL) -> tuple[DataFrame, DataFrame]:
    """The index and the entries of ``docs``, both on shared files.

    Index: bucket, key, link (place in the key's chain, from 0), keep_id, group_size, text_sha256; one row per distinct
    text, each bucket in one task, sorted by key. Entries: doc_id, key, text_sha256 per row of ``docs``.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), normal(F.col("text")).alias("norm")).withColumn("key", _key(F.col("norm"), bits))
    entries = cut(texts.select("doc_id", "key", F.sha2("norm", 256).alias("text_sha256")))
    keys = cut(entries.groupBy("key").agg(F.count("*").alias("n"), F.min("doc_id").alias("keep_id"), F.min("text_sha256").alias("text_sha256")))
    slots, depth = directory(keys.select("key"), bits, capacity)
    again = keys.where("n > 1").select("key")
    again = F.broadcast(again) if again.count() <= max_small else again
    # whole texts are the grouping key: rows meet in a group only if their bytes are equal
    same = texts.join(again, "key", "left_semi").groupBy("key", "norm").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    chained = same.select("key", "keep_id", "group_size", F.sha2("norm", 256).alias("text_sha256"))
    once = keys.where("n = 1").select("key", "keep_id", F.col("n").alias("group_size"), "text_sha256")
    owned = once.unionByName(chained).withColumn("slot", _leading(F.col("key"), bits, depth)).join(slots, "slot").drop("slot")
    order = W.partitionBy("bucket", "key").orderBy(F.col("keep_id").asc_nulls_last(), "text_sha256")
    return cut(owned.repartition("bucket").select("bucket", "key", (F.row_number().over(order) - 1).alias("link"), "keep_id", "group_size", "text_sha256")), entries


def exact_duplicates(docs: DataFrame, bits: int = BITS, capacity: int = CAPACITY, max_small: int = MAX_SMALL) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row of ``docs``.

    Null texts count as empty; very long ones are compared whole. A null doc_id is greater than all others, so keep_id is null only
    where all ids of a group are. Repeated rows count each in group_size; those that share the smallest doc_id all
    stay, as doc_id names the document. An empty table gives no rows; other columns are not read.
    """
    index, entries = build_index(docs, bits, capacity, max_small)
    counts = index.groupBy("key", "text_sha256").agg(F.sum("group_size").alias("n"))
    found = spread_join(entries, index.select("key", "text_sha256", "keep_id", "group_size"), ["key", "text_sha256"], counts, ["doc_id"], least=500)
    return found.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")
