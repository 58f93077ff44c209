"""Divergence of sources within a language, by chunk factorization.

White-space chunks are counted per document in Arrow batches, and summed over the documents of a
(lang, source) group before anything is shuffled. Rows of one chunk then meet; it is split into terms
once, and its groups take the terms from there. A document never crosses the network: a shuffled row is
a chunk of a group in a piece of a task.

Distinct documents of a term: the chunk that most documents of a group hold bounds them from below
(summed over groups, which share no document), the sum over its chunks from above. Terms that the
bounds leave open have only chunks of fewer than ``least_docs`` documents; a second scan finds
these documents, and they are counted one by one. Nothing is estimated.

Pairs of sources: each task takes a shard of a language's terms and two blocks of its sources as a
matrix of p; terms that neither block holds add the same amount each and are added as a product.
So a language or source with a third of all rows is dealt over tasks by its terms.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quillmark.llm.common import ascii_lower, cut, slices, small_batches, split_words

TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
LEAST_DOCS, TOP = 10, 10
#: Bytes of text counted at once, terms of a shard, sources of a block, chunks of open terms up to which they are broadcast.
STEP_BYTES, SHARD, BLOCK, MAX_SMALL = 32 << 20, 8192, 48, 1_000_000
#: Sums that are added and go to Spark at once, about, and how many of them one is looked at to part them.
OUT_ROWS, SPARSE = 65_536, 256
COUNTS = pa.schema([("lang", pa.string()), ("source", pa.string()), ("chunk", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])


def _coded(pieces: list[pa.RecordBatch]) -> tuple:
    """The words of these documents: their dictionary, and by piece its codes and where each document's begin. Takes the
    pieces off the list, as their texts are not needed after."""
    coded, starts = [], []
    while pieces:
        flat, at = split_words(pieces.pop(0).column("text"))
        coded.append(flat.dictionary_encode())
        starts.append(at)
    chunks = pa.chunked_array(coded).unify_dictionaries().chunks
    return chunks[0].dictionary, [c.indices.to_numpy() for c in chunks], starts


def _summed(key: np.ndarray, n: np.ndarray, docs: np.ndarray) -> tuple:
    """The distinct keys, ascending, and the sums of both counts."""
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.flatnonzero(np.concatenate([np.ones(min(1, len(key)), bool), key[1:] != key[:-1]]))
    return (key[first], np.add.reduceat(n[order], first), np.add.reduceat(docs[order], first)) if len(first) else (key, n, docs)


def _count(pieces: list[pa.RecordBatch]):
    """lang, source, chunk, n, docs of these documents. A document lies in one piece, so pieces are counted one after the other
    and their sums are added: only these, not an entry for each word, are held for the whole step."""
    names_of = pa.Table.from_batches([p.select(["lang", "source"]) for p in pieces])
    lang, source = (names_of.column(c).combine_chunks().dictionary_encode() for c in ("lang", "source"))
    group = lang.indices.to_numpy().astype(np.int64) * len(source.dictionary) + source.indices.to_numpy()
    names, codes, starts = _coded(pieces)
    width, base, parts = max(1, len(names)), 0, []
    for code, at in zip(codes, starts):
        row = np.repeat(np.arange(base, base + len(at) - 1), np.diff(at))
        held, times = np.unique(row * width + code, return_counts=True)
        key, n, docs = _summed(group[held // width] * width + held % width, times, np.ones(len(held), np.int64))
        parts.append((key, n.astype(np.int32), docs.astype(np.int32)))
        base += len(at) - 1
    del codes, starts
    # the sums of all pieces are in order, so they are added range by range of their keys
    bounds = np.sort(np.concatenate([key[::SPARSE] for key, _, _ in parts]))[:: OUT_ROWS // SPARSE][1:]
    ends = [[0, *np.searchsorted(key, bounds).tolist(), len(key)] for key, _, _ in parts]
    for k in range(len(bounds) + 1):
        key, n, docs = _summed(*(np.concatenate([part[c][at[k] : at[k + 1]] for part, at in zip(parts, ends)]) for c in range(3)))
        every, name = key // width, key % width
        yield pa.RecordBatch.from_arrays(
            [lang.dictionary.take(pa.array(every // len(source.dictionary))), source.dictionary.take(pa.array(every % len(source.dictionary))), names.take(pa.array(name)),
             pa.array(n.astype(np.int64)), pa.array(docs.astype(np.int64))], schema=COUNTS)


def _steps(batches):
    """Pieces of batches, of STEP_BYTES together, and the number of the first document of each step."""
    base, held, size = TaskContext.get().partitionId() << 40, [], 0
    for batch in batches:
        for piece in slices(batch, "text"):
            held.append(piece)
            size += piece.nbytes
            if size >= STEP_BYTES:
                rows = sum(x.num_rows for x in held)
                yield held, base
                base, held, size = base + rows, [], 0
    if held:
        yield held, base


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])


def chunk_terms(docs: DataFrame) -> DataFrame:
    """lang, source, chunk, term, times, n, docs: each chunk of a group with each term in it and how often it is there; the chunk's occurrences and documents.

    A chunk is split at its first group; the others take the terms from there. Written to the shared folder.
    """
    small_batches(docs.sparkSession)
    counts = _texts(docs).mapInArrow(lambda batches: (b for pieces, _ in _steps(batches) for b in _count(pieces)), "lang string, source string, chunk string, n long, docs long")
    # tasks have summed their chunks: rows are dealt first, as summing once more before that finds nothing to sum
    counts = counts.repartition("lang", "source", "chunk").groupBy("lang", "source", "chunk").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    whole = W.partitionBy("chunk")
    counts = counts.withColumn("place", F.row_number().over(whole.orderBy("lang", "source")))
    split = F.when(F.col("place") == 1, F.regexp_extract_all(ascii_lower(F.col("chunk")), F.lit(TERM), F.lit(0)))
    counts = counts.withColumn("split", split).withColumn("split", F.first("split", ignorenulls=True).over(whole.orderBy("lang", "source")))
    each = counts.select("lang", "source", "chunk", "n", "docs", "split", F.explode(F.array_distinct("split")).alias("term"))
    times = F.when(F.size("split") == 1, 1).otherwise(F.size("split") - F.size(F.array_remove("split", F.col("term"))))
    return cut(each.select("lang", "source", "chunk", "term", times.alias("times"), "n", "docs"))


def _chunk_documents(docs: DataFrame, spots: DataFrame, max_small: int) -> DataFrame:
    """lang, chunk, id: the documents that hold chunks of ``spots`` (lang, chunk, ...). Up to ``max_small`` chunks are known
    to the tasks by hash, which spares the other chunks their way to the join."""
    wanted = spots.select(F.xxhash64("chunk").alias("h")).distinct()
    known = np.sort(wanted.toPandas().h.to_numpy()) if wanted.count() <= max_small else None

    def find(batches):
        for pieces, base in _steps(batches):
            lang = [p.column("lang") for p in pieces]
            names, codes, starts = _coded(pieces)
            held = np.ones(len(names), bool)
            for k in range(0, len(names) if known is not None else 0, OUT_ROWS):
                some = names.slice(k, OUT_ROWS).to_pylist()
                h = np.fromiter((xxhash.xxh64_intdigest(x, 42) for x in some), np.uint64, len(some))
                held[k : k + OUT_ROWS] = np.isin(h.view(np.int64), known)
            width = max(1, len(names))
            for langs, code, at in zip(lang, codes, starts):
                row = np.repeat(np.arange(len(at) - 1), np.diff(at))
                row, code = np.divmod(np.unique(row[held[code]] * width + code[held[code]]), width)
                yield pa.RecordBatch.from_arrays([langs.take(pa.array(row)), names.take(pa.array(code)), pa.array(base + row, pa.int64())], names=["lang", "chunk", "id"])
                base += len(at) - 1

    return _texts(docs).mapInArrow(find, "lang string, chunk string, id long")


def _p(n: str, total: str, terms: str) -> Column:
    """1 + floor(10^9 (n + 2) / (total + 2 terms)); null without terms."""
    return F.expr(f"if({terms} > 0, 1 + (cast(1000000000 as decimal(10,0)) * cast({n} + 2 as decimal(20,0))) div cast({total} + 2 * {terms} as decimal(20,0)), null)")


def _gap(p: str, q: str) -> Column:
    return F.expr(f"(({p} - {q}) * ({p} - {q})) div ({p} + {q})")


def kept_terms(docs: DataFrame, least_docs: int = LEAST_DOCS, max_small: int = MAX_SMALL) -> tuple[DataFrame, DataFrame]:
    """Counts of terms (lang, source, term, n), and the terms in enough documents (lang, term, n)."""
    forms = chunk_terms(docs)
    by_group = cut(forms.groupBy("lang", "source", "term").agg(F.sum(F.col("n") * F.col("times")).alias("n"), F.max("docs").alias("low"), F.sum("docs").alias("high")))
    by_lang = cut(by_group.groupBy("lang", "term").agg(F.sum("n").alias("n"), F.sum("low").alias("low"), F.sum("high").alias("high")))
    open_ = by_lang.where((F.col("low") < least_docs) & (F.col("high") >= least_docs)).select("lang", "term", "n")
    spots = cut(forms.where(F.col("docs") < least_docs).select("lang", "chunk", "term").join(open_, ["lang", "term"]).distinct())
    small = spots.count() <= max_small
    found = cut(_chunk_documents(docs, spots, max_small).join(F.broadcast(spots) if small else spots, ["lang", "chunk"]).select("lang", "term", "n", "id"))
    settled = found.groupBy("lang", "term", "n").agg(F.count_distinct("id").alias("docs")).where(F.col("docs") >= least_docs)
    kept = cut(by_lang.where(F.col("low") >= least_docs).select("lang", "term", "n").unionByName(settled.select("lang", "term", "n")))
    return by_group.select("lang", "source", "term", "n"), kept


def _matrix(pdf: pd.DataFrame) -> pd.DataFrame:
    """Summed gaps between the sources of two blocks over the terms of a shard. Rows without term name the sources."""
    marks, rows = pdf[pdf.term.isna()], pdf[pdf.term.notna()]
    names, blocks = marks.source.tolist(), marks.block.to_numpy()
    at = {s: i for i, s in enumerate(names)}
    term, _ = pd.factorize(rows.term)
    p = np.tile(marks.p.to_numpy(np.int64), (term.max() + 1 if len(term) else 0, 1))
    p[term, rows.source.map(at).to_numpy(np.int64)] = rows.p.to_numpy(np.int64)
    out, apart = [], pdf.b1.iloc[0] != pdf.b2.iloc[0]
    for i in range(len(names) if len(p) else 0):
        others = np.flatnonzero(blocks[i + 1 :] != blocks[i]) + i + 1 if apart else np.arange(i + 1, len(names))
        one, rest = p[:, i : i + 1], p[:, others]
        sums = ((one - rest) ** 2 // (one + rest)).sum(axis=0)
        out += [(pdf.lang.iloc[0], names[i], names[j], int(x), len(p)) for j, x in zip(others, sums)]
    return pd.DataFrame(out, columns=["lang", "a", "b", "value", "seen"])


def _pairs(groups: DataFrame, scored: DataFrame) -> DataFrame:
    """lang, source, item, value of all ordered pairs of sources of a language."""
    blocks = groups.withColumn("blocks", F.ceil(F.col("sources") / BLOCK)).withColumn("shards", F.ceil(F.col("terms") / SHARD))
    place = F.pmod(F.xxhash64("source"), F.col("blocks"))
    cols = ["lang", "shard", "block", "blocks", "source", "term", "p"]
    marks = blocks.where("terms > 0").withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shards") - 1)))
    marks = marks.withColumn("block", place).withColumn("term", F.lit(None).cast("string")).withColumn("p", F.col("p0")).select(*cols)
    rows = scored.join(blocks.select("lang", "source", "blocks", "shards"), ["lang", "source"])
    rows = rows.withColumn("shard", F.pmod(F.xxhash64("term"), F.col("shards"))).withColumn("block", place).select(*cols)
    dealt = marks.unionByName(rows).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    dealt = dealt.select("lang", "shard", F.least("block", "other").alias("b1"), F.greatest("block", "other").alias("b2"), "block", "source", "term", "p")
    sums = dealt.groupBy("lang", "shard", "b1", "b2").applyInPandas(_matrix, "lang string, a string, b string, value long, seen long")
    sums = sums.groupBy("lang", F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).agg(F.sum("value").alias("sum"), F.sum("seen").alias("seen"))
    one = groups.select("lang", "source", "terms", F.col("p0").alias("pa"))
    two = groups.select("lang", F.col("source").alias("item"), F.col("p0").alias("pb"))
    both = one.join(two, "lang").where("source <> item").withColumn("lo", F.least("source", "item")).withColumn("hi", F.greatest("source", "item"))
    both = both.join(sums, ["lang", "lo", "hi"], "left")
    rest = (F.col("terms") - F.coalesce("seen", F.lit(0))) * _gap("pa", "pb")
    return both.select("lang", "source", "item", F.coalesce(F.coalesce("sum", F.lit(0)) + rest, F.lit(0)).cast("long").alias("value"))


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP, max_small: int = MAX_SMALL) -> DataFrame:
    """lang, source, part, item, value, rank: how far each source's smoothed term shares lie from the other sources'
    (part ``pair``, all of them) and, term by term, above its language's (part ``term``, the ``top`` first).

    Null text, lang and source are read as ''. A row is a document, whatever its doc_id, so repeated rows count
    each. Very long texts count whole. A group without terms stands with the smoothing alone; a language without kept
    terms has pairs of value 0; an only source has no pairs; an empty table gives no rows. Ties are ranked by
    item. Columns other than these three are not read.
    """
    found = _texts(docs).select("lang", "source").distinct()
    by_group, kept = kept_terms(docs, least_docs, max_small)
    langs = kept.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("n").alias("lang_total"))
    held = cut(by_group.join(kept.withColumnRenamed("n", "lang_n").hint("shuffle_hash"), ["lang", "term"]))
    totals = held.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    sources = found.groupBy("lang").agg(F.count("*").alias("sources"))
    groups = found.join(totals, ["lang", "source"], "left").join(sources, "lang").join(langs, "lang", "left")
    groups = groups.na.fill(0, ["total", "terms", "lang_total"]).withColumn("none", F.lit(0))
    groups = cut(groups.withColumn("p0", _p("none", "total", "terms")).drop("none"))
    scored = held.join(groups, ["lang", "source"]).select("lang", "source", "term", _p("n", "total", "terms").alias("p"), _p("lang_n", "lang_total", "terms").alias("q"))
    above = scored.where("p > q").select("lang", "source", F.col("term").alias("item"), _gap("p", "q").alias("value"))
    ranked = F.row_number().over(W.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    cols = ["lang", "source", "part", "item", "value", "rank"]
    terms = above.withColumn("rank", ranked).where(F.col("rank") <= top).withColumn("part", F.lit("term")).select(*cols)
    return _pairs(groups, scored).withColumn("rank", ranked).withColumn("part", F.lit("pair")).select(*cols).unionByName(terms)
