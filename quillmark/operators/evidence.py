"""Mechanical verification of quotes against their document's pages.

The page is the claimed one if it holds the quote; else the last page that does; else the
first page with a fuzzy or segment score of 90; else the first pair of adjacent pages with that
coverage. Quotes meet pages by doc_id; only those without an exact page go to the fuzzy step.

The fuzzy score is either the containment of word shingles, on built-in functions, or (``aligned``) the
best alignment of the quote with any offset of the page, which also finds quotes with slips of letters.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quillmark.functions import text as T
from quillmark.functions.align import partial_ratio
from quillmark.sources.tables import kept

#: Shortest quote, length from which segments count, and the scores that pass.
LEAST, LONG, PASS, SEGMENT_PASS = 12, 300, 90.0, 0.88


def prepared_quotes(quotes: DataFrame) -> DataFrame:
    """Adds needle, its shingles and segments, and the gates."""
    out = quotes.withColumn("needle", T.normalise(F.coalesce("quote", F.lit(""))))
    out = out.withColumn("long", (F.length("needle") > LONG) | F.coalesce(F.col("quote").rlike(r"\.\.\.|…"), F.lit(False)))
    return out.withColumn("checkable", F.length("needle") >= LEAST).withColumn("qs", T.word_shingles(F.col("needle"))).withColumn("segs", F.when(F.col("long"), T.segments(F.col("quote"))))


def prepared_pages(pages: DataFrame) -> DataFrame:
    return pages.select("doc_id", "page_no", T.normalise(F.col("text")).alias("hay"))


def quoted(pages: DataFrame, quotes: DataFrame) -> DataFrame:
    """The pages of documents that quotes cite; no others are normalised."""
    return pages.join(quotes.select("doc_id").distinct(), "doc_id", "left_semi")


def exact_pages(quotes: DataFrame, pages: DataFrame, key: list[str]) -> DataFrame:
    """key, found_on_page of quotes that a page holds word for word."""
    at = quotes.where("checkable").select(*key, "page", "needle").join(pages, "doc_id").where(F.instr(F.col("hay"), F.col("needle")) > 0)
    return at.groupBy(*key).agg(F.coalesce(F.max(F.when(F.col("page_no") == F.col("page"), F.col("page_no"))), F.max("page_no")).alias("found_on_page"))


def _coverage(segs, hay, shingles):
    """Percent of segments found, any order."""
    ok = F.filter(segs, lambda s: (F.instr(hay, s) > 0) | (T.containment(T.word_shingles(s), shingles) >= SEGMENT_PASS))
    return F.coalesce(100.0 * F.try_divide(F.size(ok).cast("double"), F.size(segs).cast("double")), F.lit(0.0))


def page_scores(quotes: DataFrame, pages: DataFrame, key: list[str]) -> DataFrame:
    """key, page_no, fuzzy, coverage of every checkable quote on every page of its document."""
    at = quotes.where("checkable").select(*key, "qs", "segs").join(pages.withColumn("hs", T.word_shingles(F.col("hay"))), "doc_id")
    fuzzy = 100.0 * T.containment(F.col("qs"), F.col("hs"))
    cover = F.when(F.size("segs") > 0, _coverage(F.col("segs"), F.col("hay"), F.col("hs"))).otherwise(0.0)
    return at.select(*key, "page_no", F.round(fuzzy, 6).alias("fuzzy"), F.round(cover, 6).alias("coverage"))


def _aligned(rows: DataFrame, key: list[str], passing: float) -> DataFrame:
    """key, page_no, start_page, fuzzy, coverage, from rows with needle, segs, hay and (for pairs of pages) next."""
    segment = 100 * SEGMENT_PASS

    def score(batches):
        for batch in batches:
            out = []
            for needle, segs, hay, after, page in zip(*(batch.column(c).to_pylist() for c in ("needle", "segs", "hay", "next", "page_no"))):
                both = hay if after is None else f"{hay} {after}"
                found = [partial_ratio(s, both, segment) > 0 for s in segs or ()]
                # of a pair, the second page is named if the first segment is there and not on the first
                second = bool(after and segs) and partial_ratio(segs[0], after, segment) > 0 and not partial_ratio(segs[0], hay, segment)
                out.append((page + second, round(partial_ratio(needle, both, passing), 6) if hay and after is None else 0.0, round(100.0 * sum(found) / len(found), 6) if found else 0.0))
            start, fuzzy, cover = zip(*out) if out else ((), (), ())
            keys = [batch.column(c) for c in (*key, "page_no")]
            yield pa.RecordBatch.from_arrays([*keys, pa.array(start, pa.int32()), pa.array(fuzzy, pa.float64()), pa.array(cover, pa.float64())], names=[*key, "page_no", "start_page", "fuzzy", "coverage"])

    rows = rows.select(*key, "page_no", "needle", "segs", "hay", "next")
    kinds = ", ".join(f"{c} {t}" for c, t in rows.dtypes if c in (*key, "page_no"))
    return rows.mapInArrow(score, f"{kinds}, start_page int, fuzzy double, coverage double")


def aligned_scores(quotes: DataFrame, pages: DataFrame, key: list[str], passing: float = PASS) -> DataFrame:
    """As ``page_scores``, by alignment: fuzzy is the score of the best offset, 0 if below ``passing``; a
    segment counts from SEGMENT_PASS on. With ``passing`` 0 every offset is aligned and every score exact."""
    at = quotes.where("checkable").select(*key, "needle", "segs").join(pages, "doc_id")
    return _aligned(at.withColumn("next", F.lit(None).cast("string")), key, passing).drop("start_page")


def aligned_pairs(quotes: DataFrame, pages: DataFrame, key: list[str]) -> DataFrame:
    """As ``pair_scores``, by alignment; only quotes with segments take part."""
    pairs = pages.withColumn("next", F.lead("hay").over(W.partitionBy("doc_id").orderBy("page_no"))).where("next is not null")
    at = quotes.where("checkable and size(segs) > 0").select(*key, "needle", "segs").join(pairs, "doc_id")
    return _aligned(at, key, PASS).select(*key, "page_no", "start_page", F.col("coverage").alias("score"))


def pair_scores(quotes: DataFrame, pages: DataFrame, key: list[str]) -> DataFrame:
    """key, page_no (of the pair's start), score over two adjacent pages; the second page is named
    if the first segment is there and not on the first."""
    w = W.partitionBy("doc_id").orderBy("page_no")
    pairs = pages.withColumn("next", F.lead("hay").over(w)).where("next is not null")
    pairs = pairs.withColumn("both", F.concat_ws(" ", "hay", "next")).withColumn("hs", T.word_shingles(F.col("both")))
    at = quotes.where("checkable").select(*key, "needle", "qs", "segs").join(pairs, "doc_id")
    segs = F.when(F.size("segs") > 0, F.col("segs")).otherwise(F.array("needle"))
    at = at.withColumn("parts", segs)
    head = F.element_at("parts", 1)
    second = (F.instr(F.col("next"), head) > 0) & (F.instr(F.col("hay"), head) == 0)
    score = F.greatest(100.0 * T.containment(F.col("qs"), F.col("hs")), _coverage(F.col("parts"), F.col("both"), F.col("hs")))
    return at.select(*key, "page_no", (F.col("page_no") + F.when(second, 1).otherwise(0)).alias("start_page"), F.round(score, 6).alias("score"))


def verify(quotes: DataFrame, pages: DataFrame, key: list[str], aligned: bool = False) -> DataFrame:
    """quotes plus found_on_page, exact, best_score, status. ``key`` names a quote and holds doc_id.

    The prepared quotes and pages and the pages found so far are written to the shared folder, as each of the later steps reads them."""
    on_pages, on_pairs = (aligned_scores, aligned_pairs) if aligned else (page_scores, pair_scores)
    quotes = kept(quotes)
    q, p = kept(prepared_quotes(quotes)), kept(prepared_pages(quoted(pages, quotes)))
    exact = kept(exact_pages(q, p, key))
    open_ = q.where("checkable").join(exact, key, "left_anti")
    on_page = on_pages(open_, p, key).withColumn("score", F.greatest("fuzzy", "coverage"))
    fuzzy = kept(on_page.groupBy(*key).agg(F.max("score").alias("best"), F.min(F.when(F.col("score") >= PASS, F.col("page_no"))).alias("fuzzy_page")))
    still = open_.join(fuzzy.where("fuzzy_page is not null"), key, "left_anti")
    pair = on_pairs(still, p, key).where(F.col("score") >= PASS).groupBy(*key).agg(F.min(F.struct("page_no", "start_page", "score")).alias("pair"))
    out = quotes.join(exact, key, "left").join(fuzzy, key, "left").join(pair, key, "left")
    found = F.coalesce("found_on_page", "fuzzy_page", "pair.start_page")
    score = F.when(F.col("found_on_page").isNotNull(), 100.0).otherwise(F.coalesce(F.greatest("best", "pair.score"), F.lit(0.0)))
    out = out.select(*quotes.columns, found.alias("found_on_page"), F.col("found_on_page").isNotNull().alias("exact"), F.round(score, 1).alias("best_score"))
    return out.withColumn("status", status())


def status():
    return (F.when(~F.col("present"), "absent").when(F.coalesce(F.trim("quote"), F.lit("")) == "", "no_quote")
            .when(F.col("found_on_page").isNull(), "unverified").when(F.col("found_on_page") == F.col("page"), "verified").otherwise("wrong_page"))


def rates(verified: DataFrame, by: list[str]) -> DataFrame:
    """Counts by status, groundedness and hallucination (null if nothing was asserted)."""
    n = lambda *s: F.count_if(F.col("status").isin(*s))
    asserted = n("verified", "wrong_page", "unverified", "no_quote")
    return verified.groupBy(*by).agg(
        *[n(s).alias(s) for s in ("verified", "wrong_page", "unverified", "no_quote", "absent")], asserted.alias("asserted"),
        F.round(F.try_divide(n("verified", "wrong_page"), asserted), 3).alias("groundedness"),
        F.round(F.try_divide(n("unverified", "no_quote"), asserted), 3).alias("hallucination"))


def flags(verified: DataFrame) -> DataFrame:
    return verified.where(F.col("status").isin("unverified", "no_quote"))


def rescored(stored: DataFrame, pages: DataFrame, key: list[str]) -> DataFrame:
    """key, before, after, changed: the stored status of each quote, and that of a new verification."""
    old = stored.withColumnRenamed("status", "before")
    new = verify(old, pages, key).withColumnRenamed("status", "after")
    return new.select(*key, "before", "after", (F.col("before") != F.col("after")).alias("changed"))
