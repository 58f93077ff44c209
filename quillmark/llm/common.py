"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a maximal run of characters other than ASCII white space.
SPACE = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bytes of text that one numpy step works on.
SLICE_BYTES = 4 << 20


def words(text: Column) -> Column:
    """Array of the words of a text; null and empty texts have none. Blanks alone need no pattern."""
    text = F.coalesce(text, F.lit(""))
    return F.array_remove(F.when(text.rlike(r"[\x09-\x0D]"), F.split(text, SPACE)).otherwise(F.split(text, " ")), "")


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z only, as both Spark and other engines do alike; a text of ASCII alone takes the short way."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share; a local one only in local mode, where none is named, as in tests."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        if held.isDefined():
            return held.get()
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(named)
    return named


def cut(df: DataFrame) -> DataFrame:
    """Writes a result to the shared folder and reads it back: later steps neither repeat
    the work nor depend on the executors that did it."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread_join(left: DataFrame, right: DataFrame, keys: list[str], counts: DataFrame, by: list[str], how: str = "inner", least: int = 1000) -> DataFrame:
    """Join of ``left`` with ``right`` on keys that ``right`` holds once, without hot tasks.

    ``counts``: keys and n, the rows of ``left`` under each key. Keys of a thousandth of all rows
    (``least`` at the least), of which there can be a thousand, are dealt over several tasks by
    ``by``; their rows of ``right`` are repeated for each. Only these keys are broadcast.
    """
    facts = counts.agg(F.sum("n").alias("total"), F.max("n").alias("top")).first()
    share = max(least, (facts.total or 0) // 1000)
    if (facts.top or 0) < share:
        return left.join(right, keys, how)
    hot = F.broadcast(counts.where(F.col("n") >= share).select(*keys, F.ceil(F.col("n") / share).cast("int").alias("_of")))
    l_side = left.join(hot, keys, "left").withColumn("_salt", F.pmod(F.xxhash64(*by), F.coalesce("_of", F.lit(1))).cast("int")).drop("_of")
    r_side = right.join(hot, keys, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_of", F.lit(1)) - 1))).drop("_of")
    return l_side.join(r_side, [*keys, "_salt"], how).drop("_salt")


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Bounds what a Python worker holds at once when texts are long, for the whole session: the
    results are lazy, so the bound must outlast the call."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)


def slices(batch: pa.RecordBatch, column: str):
    """Pieces of a batch with about SLICE_BYTES of text each."""
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    group = np.cumsum(size) // SLICE_BYTES
    cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:]):
        if b > a:
            yield batch.slice(a, b - a)


def split_words(text: pa.Array, lower: bool = False) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts in a row, and where each text's words begin (one more entry than texts)."""
    text = pc.fill_null(text, "")
    lists = pc.ascii_split_whitespace(pc.ascii_lower(text) if lower else text)
    flat, at = lists.flatten(), lists.offsets.to_numpy()
    full = pc.greater(pc.binary_length(flat), 0)
    kept = np.concatenate([[0], np.cumsum(full.to_numpy(zero_copy_only=False))])
    return flat.filter(full), kept[at - at[0]].astype(np.int64)


def hash_words(flat: pa.Array) -> np.ndarray:
    """A 64-bit hash of each word; every distinct word of the batch is hashed once."""
    coded = flat.dictionary_encode()
    table = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in coded.dictionary.to_pylist()), np.uint64, len(coded.dictionary))
    return table[coded.indices.to_numpy()] if len(flat) else np.zeros(0, np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """Bit mixer on 64-bit words (a multiply-xorshift finaliser)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def grams(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of every n consecutive word hashes; entry i covers words i to i+n-1."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(h) - n + 1, np.uint64)
    for k in range(n):
        out = mix(out + h[k : len(h) - n + 1 + k] + np.uint64(k + 1))
    return out


def signed(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint64).view(np.int64)
