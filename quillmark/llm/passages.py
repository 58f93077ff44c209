"""Passages that repeat across documents, found by FM-indexes over shards.

A word is removed if a window of WINDOW consecutive words that covers it also starts in a
document with a smaller doc_id.

1. Each document's windows are dealt by their minimizer: the least hash among the windows'
   short word grams. A run is the windows that share one minimizer; equal windows of two
   documents lie in runs of equal minimizer. A run carries hashes only.
2. Equal runs are merged, so a passage that was copied thousands of times is one run. A window
   leaves at least half of its other words on one side of its minimizer; runs that share neither
   side with another document cannot repeat and go.
3. The words of the remaining distinct runs are fetched. Where a minimizer has very many
   distinct runs (a short passage in many surroundings), these are cut down to the windows whose
   fingerprint two documents share, and equal parts are merged. A minimizer that still has very many
   parts has them taken apart into single windows, which are dealt by their words: equal windows
   meet, and no shard grows with them.
4. The pieces of a shard (a hash range of minimizers) are put into an FM-index, whose wavelet
   matrix is packed; suffix classes and owners stay plain arrays. Every piece goes
   through backward search, which gives for each window the least doc_id that holds it.
5. Intervals return to all runs, and by doc_id to the documents.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmark.llm.common import cut, grams, hash_words, mix, signed, slices, small_batches, split_words, spread_join
from quillmark.llm.fmindex import FmIndex

WINDOW, GRAM = 50, 8
#: Pieces that one FM-index holds, about; distinct runs of one minimizer beyond which they are first cut
#: down to their shared windows (as many take about 150 MB in an index).
SHARD, HOT = 3000, 20_000
#: Bytes of a word's hash that an FM-index gets.
CODE = 6
_BASE = np.uint64(0x9E3779B97F4A7C15)


def span_hash(h: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Hash of the words start .. start + size - 1 for many spans of fewer than 4 * WINDOW words.

    Word hashes are summed by blocks, so that no sum runs longer than needed.
    """
    out = np.zeros(len(start), np.uint64)
    for k in range(int(size.max(initial=0))):
        live = k < size
        out[live] = out[live] * _BASE + mix(h[start[live] + k])
    return mix(out + size.astype(np.uint64))


def least_in_window(key: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` consecutive entries, by doubling."""
    out, span = key, 1
    while span * 2 <= width:
        out = np.minimum(out[:-span], out[span:])
        span *= 2
    if span < width:
        out = np.minimum(out[: len(key) - width + 1], out[width - span :][: len(key) - width + 1])
    return out


def runs_of(h: np.ndarray, at: np.ndarray, window: int = WINDOW):
    """Runs of the texts whose word hashes lie in ``h`` between the bounds ``at``:
    (text, first window's place in its text, number of windows, minimizer hash, run hash, hashes of the
    minimizer with the words before and after it; 0 where the text has too few)."""
    place = np.arange(len(h) - GRAM + 1, dtype=np.uint64)
    empty = tuple(np.zeros(0, np.int64) for _ in range(3)) + tuple(np.zeros(0, np.uint64) for _ in range(4))
    if len(h) < window:
        return empty
    g = grams(h, GRAM)
    low = np.uint64((1 << 32) - 1)  # no text has as many words
    best = (least_in_window((g & ~low) | place, window - GRAM + 1) & low).astype(np.int64)
    doc = np.repeat(np.arange(len(at) - 1), np.diff(at))
    ok = doc[: len(best)] == doc[window - 1 :][: len(best)]
    start = np.flatnonzero(ok)
    if not len(start):
        return empty
    new = np.concatenate([[True], (np.diff(start) > 1) | (best[start][1:] != best[start][:-1]) | (doc[start][1:] != doc[start][:-1])])
    first = start[new]
    n = np.diff(np.append(np.flatnonzero(new), len(start)))
    # a window leaves at least half of its other words on one side of its minimizer
    spot, aside = best[first], (window - GRAM + 1) // 2
    context = []
    for begin, salt in ((spot - aside, 1), (spot, 2)):
        ok = (begin >= at[doc[first]]) & (begin + aside + GRAM <= at[doc[first] + 1])
        x = span_hash(h, np.where(ok, begin, 0), np.where(ok, aside + GRAM, 0))
        context.append(np.where(ok, mix(x + np.uint64(salt)) | np.uint64(1), 0))
    return doc[first], first - at[doc[first]], n, g[spot], span_hash(h, first, n + window - 1), *context


def _runs(docs: DataFrame, window: int) -> DataFrame:
    def work(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                flat, at = split_words(part.column("text"))
                doc, start, n, *keys = runs_of(hash_words(flat), at, window)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").take(pa.array(doc)), pa.array(start.astype(np.int32)), pa.array(n.astype(np.int32)), *(pa.array(signed(x)) for x in keys)],
                    names=["doc_id", "start", "n", "g", "r", "before", "after"])

    return docs.mapInArrow(work, "doc_id long, start int, n int, g long, r long, before long, after long")


def _contents(docs: DataFrame, lists: DataFrame, window: int) -> DataFrame:
    """Words (six bytes each) of each distinct run, from the text of its first holder; of hot ones also the window fingerprints."""

    def work(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                flat, at = split_words(part.column("text"))
                h = hash_words(flat)
                runs = part.column("runs")
                first = at[pc.list_parent_indices(runs).to_numpy()]
                runs = pc.list_flatten(runs)
                start, n = (pc.struct_field(runs, c).to_numpy().astype(np.int64) for c in ("start", "n"))
                begin, size = first + start, n + window - 1
                ends = np.cumsum(size)
                word = np.repeat(begin - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)
                packed = np.ascontiguousarray(h[word].view(np.uint8).reshape(-1, 8)[:, :CODE])
                bounds = np.concatenate([[0], ends]).astype(np.int32) * CODE
                codes = pa.BinaryArray.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(packed)])
                hot = pc.struct_field(runs, "hot").to_numpy(zero_copy_only=False).astype(bool)
                k = np.where(hot, n, 0)
                ends = np.concatenate([[0], np.cumsum(k)])
                each = np.repeat(begin - ends[:-1], k) + np.arange(ends[-1])
                spans = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32), mask=np.append(~hot, False)), pa.array(signed(span_hash(h, each, np.full(len(each), window)))))
                yield pa.RecordBatch.from_arrays(
                    [*(pc.struct_field(runs, c) for c in ("g", "r", "lo", "hi")), spans, codes], names=["g", "r", "lo", "hi", "spans", "codes"])

    return docs.join(lists, "doc_id").select("text", "runs").mapInArrow(work, "g long, r long, lo long, hi long, spans array<long>, codes binary")


def _search(window: int):
    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        raw = np.frombuffer(b"".join(pdf.codes), np.uint8).reshape(-1, CODE)
        wide = np.zeros((len(raw), 8), np.uint8)
        wide[:, :CODE] = raw
        codes = np.unique(wide.view(np.uint64)[:, 0], return_inverse=True)[1].astype(np.int64) + 1
        at = np.cumsum([0, *(len(c) // CODE for c in pdf.codes)])
        pieces = [codes[a:b] for a, b in zip(at, at[1:])]
        found = FmIndex(pieces, pdf.lo.to_numpy(), window).matching(pieces)
        return pd.DataFrame({"g": pdf.g, "p": pdf.p, "least": [f.tolist() for f in found]})

    return work


def _shared_parts(hot: DataFrame, window: int) -> DataFrame:
    """g, r, a, lo, p, codes: the stretches of hot runs whose windows two documents share."""
    spans = hot.select("g", "r", "lo", "hi", F.posexplode("spans").alias("o", "s"))
    shared = spans.groupBy("g", "s").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).where("lo < hi").select("g", "s")
    hits = spans.join(shared, ["g", "s"], "left_semi").groupBy("g", "r").agg(F.sort_array(F.collect_set("o")).alias("os"))
    hits = hits.withColumn("z", F.expr("transform(array(os), os -> arrays_zip(filter(os, o -> not array_contains(os, o - 1)), filter(os, o -> not array_contains(os, o + 1))))[0]"))
    hits = hits.select("g", "r", F.explode("z").alias("z")).select("g", "r", F.col("z")["0"].alias("a"), F.col("z")["1"].alias("b"))
    part = hits.join(hot.select("g", "r", "lo", "codes"), ["g", "r"])
    part = part.withColumn("codes", F.expr(f"substring(codes, a * {CODE} + 1, (b - a + {window}) * {CODE})"))
    return part.select("g", "r", "a", "lo", F.xxhash64("codes").alias("p"), "codes")


def _apart(part: DataFrame, window: int) -> DataFrame:
    """``part`` with sub, by which the pieces of a minimizer are dealt: 0, or for minimizers of more than HOT parts the
    words of each window, which is then a part of its own."""
    many = part.groupBy("g").agg(F.count("*").alias("n")).where(F.col("n") > HOT).select("g")
    some = cut(many)
    if some.isEmpty():
        return part.withColumn("sub", F.lit(0).cast("long"))
    rest = part.join(some, "g", "left_anti").withColumn("sub", F.lit(0).cast("long"))
    each = part.join(some, "g", "left_semi").withColumn("o", F.explode(F.expr(f"sequence(0, length(codes) div {CODE} - {window})")))
    each = each.withColumn("a", (F.col("a") + F.col("o")).cast("int")).withColumn("codes", F.expr(f"substring(codes, cast(o * {CODE} + 1 as int), {window * CODE})"))
    each = each.withColumn("p", F.xxhash64("codes")).withColumn("sub", F.col("p"))
    return rest.unionByName(each.select(*rest.columns))


def _dealt(docs: DataFrame, window: int) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """runs of all documents; g, r, n of the distinct ones; their pieces by shard; g, r, a, p: where the pieces lie in them."""
    runs = cut(_runs(docs, window))
    distinct = cut(runs.groupBy("g", "r").agg(
        F.min(F.struct("doc_id", "start", "n")).alias("f"), F.max("doc_id").alias("hi"), F.count("*").alias("held"), F.first("before").alias("before"), F.first("after").alias("after")))
    # a window that two documents have lies in runs that share the words on one side of their minimizer
    sides = distinct.select("g", "r", F.col("f.doc_id").alias("lo"), "hi", F.explode(F.filter(F.array("before", "after"), lambda x: x != 0)).alias("side"))
    shared = cut(sides.groupBy("side").agg(F.min("lo").alias("least"), F.max("hi").alias("most"), F.count("*").alias("n")).where("least < most").select("side", "n"))
    alive = spread_join(sides, shared.select("side"), ["side"], shared, ["g", "r"]).select("g", "r").distinct()
    distinct = cut(distinct.drop("before", "after").join(alive, ["g", "r"]))
    crowded = distinct.groupBy("g").agg(F.count("*").alias("n")).where(F.col("n") > HOT).select("g", "n")
    hot = spread_join(distinct, crowded.select("g", F.lit(True).alias("hot")), ["g"], crowded, ["r"], "left") if not crowded.isEmpty() else distinct.withColumn("hot", F.lit(False))
    distinct = cut(hot.select("g", "r", "f", "hi", "held", F.coalesce("hot", F.lit(False)).alias("hot")))
    at = distinct.select(
        F.col("f.doc_id").alias("doc_id"), F.struct(F.col("f.start").alias("start"), F.col("f.n").alias("n"), "g", "r", F.col("f.doc_id").alias("lo"), "hi", "hot").alias("run"))
    content = _contents(docs, at.groupBy("doc_id").agg(F.collect_list("run").alias("runs")), window)
    pieces = content.where("spans is null").select("g", F.col("r").alias("p"), "lo", "codes", F.lit(0).cast("long").alias("sub"))
    places = distinct.where("not hot").select("g", "r", F.lit(0).alias("a"), F.col("r").alias("p"))
    more = 0
    if not crowded.isEmpty():
        part = cut(_apart(cut(_shared_parts(cut(content.where("spans is not null")), window)), window))
        crowd = cut(part.groupBy("g", "p", "sub").agg(F.min("lo").alias("lo"), F.first("codes").alias("codes")))
        pieces = pieces.unionByName(crowd)
        places = places.unionByName(part.select("g", "r", "a", "p"))
        more = crowd.count()
    shards = max(1, (distinct.count() + more) // SHARD)
    shard = F.pmod(F.when(F.col("sub") == 0, F.col("g")).otherwise(F.xxhash64("g", "sub")), F.lit(shards))
    return runs, distinct.select("g", "r", F.col("held").alias("n")), pieces.withColumn("shard", shard), places


def repeated_intervals(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, start, stop (word numbers, stop exclusive) of passages that windows in smaller documents cover."""
    runs, counts, pieces, places = _dealt(docs, window)
    least = pieces.drop("sub").groupBy("shard").applyInPandas(_search(window), "g long, p long, least array<long>")
    # a run that is cut down may have several parts
    found = cut(places.join(least, ["g", "p"]).groupBy("g", "r").agg(F.collect_list(F.struct("a", "least")).alias("parts")))
    back = spread_join(runs.select("doc_id", "start", "g", "r"), found, ["g", "r"], counts, ["doc_id", "start"])
    back = back.select("doc_id", "start", F.explode("parts").alias("part")).select("doc_id", "start", "part.*")
    # windows held by a smaller document, as intervals of this run
    mine = back.select("doc_id", "start", "a", F.expr("transform(array(doc_id), d -> transform(least, m -> m >= 0 and m < d))[0]").alias("gone"))
    mine = mine.where(F.array_contains("gone", True))
    mine = mine.withColumn("z", F.expr(
        "if(array_contains(gone, false), transform(filter(transform(gone, (x, k) -> if(x, k, -1)), k -> k >= 0), k -> struct(k as x, k as y)), array(struct(0 as x, size(gone) - 1 as y)))"))
    mine = mine.select("doc_id", (F.col("start") + F.col("a")).alias("first"), F.explode("z").alias("z"))
    return mine.select("doc_id", (F.col("first") + F.col("z.x")).cast("long").alias("start"), (F.col("first") + F.col("z.y") + window).cast("long").alias("stop"))


def dedup_passages(docs: DataFrame, window: int = WINDOW, with_text: bool = True) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and, if asked for, the kept words joined by blanks.

    One row per input row; very long texts are taken whole. Null, empty and short texts lose nothing. Windows are judged on the
    input. Rows with equal doc_id are one document here: they do not remove each other's words,
    and places found in one apply to all of them; ids should be unique. A null doc_id neither loses nor
    removes words. Other columns are ignored; an empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    named = docs.where("doc_id is not null")
    spans = repeated_intervals(named, window)
    lists = spans.groupBy("doc_id").agg(F.collect_set(F.struct("start", "stop")).alias("spans"))

    def work(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                flat, at = split_words(part.column("text"))
                spans = part.column("spans")
                owner = pc.list_parent_indices(spans).to_numpy()
                flat_spans = pc.list_flatten(spans)
                step = np.zeros(len(flat) + 1, np.int64)
                for name, sign in (("start", 1), ("stop", -1)):
                    place = at[owner] + pc.struct_field(flat_spans, name).to_numpy(zero_copy_only=False)
                    np.add.at(step, np.minimum(place, at[owner + 1]), sign)
                stays = np.cumsum(step[:-1]) <= 0
                ends = np.concatenate([[0], np.cumsum(stays)])[at]
                kept = pc.binary_join(pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), flat.filter(pa.array(stays))), " ")
                sha = [hashlib.sha256(x.as_buffer()).hexdigest() for x in kept.cast(pa.binary())]
                n = np.diff(at)
                cols = [part.column("doc_id"), pa.array(n), pa.array(n - np.diff(ends)), pa.array(sha, pa.string()), kept.cast(pa.string())]
                yield pa.RecordBatch.from_arrays(cols[: 4 + with_text], names=["doc_id", "n_words", "n_removed", "kept_sha256", "text"][: 4 + with_text])

    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", text string" * with_text
    bare = docs.where("doc_id is null").withColumn("spans", F.lit(None).cast("array<struct<start:long,stop:long>>"))
    # the texts' exchange by doc_id is the one that fetches the runs' words, and is made once
    return named.join(lists, "doc_id", "left").unionByName(bare).mapInArrow(work, schema)
