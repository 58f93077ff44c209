"""Page retrieval: keyword and vector scores, rank fusion, selection under a budget.

Keyword lists and field vectors are dimensions of a few dozen rows; they are collected into
one row per cluster or field and broadcast, so that pages are scored in place and shuffled only for ranking.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quillmark.functions.vectors import cosine

#: Fixed values of the fusion and the budget.
FUSION, HITS, PHRASE_WEIGHT, PER_FIELD, SPARE, PINNED, CAP = 60, 5, 3.0, 5, 5, 2, 14


def keyword_scores(pages: DataFrame, keywords: DataFrame, by: list[str]) -> DataFrame:
    """doc_id, *by, page_no, score: weighted hits of each page, at most HITS a keyword; zeros dropped.

    ``keywords``: *by, keyword. A phrase weighs PHRASE_WEIGHT, a word 1; a keyword listed twice counts twice.
    """
    one = F.struct(F.lower("keyword").alias("k"), F.when(F.instr("keyword", " ") > 0, PHRASE_WEIGHT).otherwise(1.0).alias("weight"))
    lists = keywords.groupBy(*by).agg(F.collect_list(one).alias("kws")).agg(F.collect_list(F.struct(*by, "kws")).alias("lists"))
    at = pages.where(F.trim("text") != "").select("doc_id", "page_no", F.lower("text").alias("t")).join(F.broadcast(lists), F.lit(True))
    # as many bytes go as the hits have, so that no characters are counted
    hits = lambda k: F.floor((F.octet_length("t") - F.octet_length(F.replace(F.col("t"), k, F.lit("")))) / F.octet_length(k))
    score = lambda kws: F.aggregate(kws, F.lit(0.0), lambda s, x: s + x["weight"] * F.least(hits(x["k"]), F.lit(HITS)))
    scored = F.transform("lists", lambda x: F.struct(*[x[c].alias(c) for c in by], score(x["kws"]).alias("score")))
    found = at.select("doc_id", "page_no", F.inline(F.filter(scored, lambda x: x["score"] > 0)))
    return found.select("doc_id", *by, "page_no", "score")


def vector_scores(page_vectors: DataFrame, field_vectors: DataFrame, by: list[str]) -> DataFrame:
    """doc_id, *by, page_no, score by cosine. ``field_vectors``: *by, q."""
    return page_vectors.join(F.broadcast(field_vectors), F.lit(True)).select("doc_id", *by, "page_no", cosine(F.col("v"), F.col("q")).alias("score"))


def ranked(scores: DataFrame, by: list[str]) -> DataFrame:
    """Adds rank from 0, best score first, ties by page."""
    w = W.partitionBy("doc_id", *by).orderBy(F.desc("score"), "page_no")
    return scores.withColumn("rank", F.row_number().over(w) - 1)


def fusion_scores(a: DataFrame, b: DataFrame, by: list[str]) -> DataFrame:
    """Reciprocal-rank fusion of two rankings: pages of either, sum of 1 / (FUSION + rank)."""
    keys = ["doc_id", *by, "page_no"]
    part = F.coalesce(1.0 / (FUSION + F.col("ra")), F.lit(0.0)) + F.coalesce(1.0 / (FUSION + F.col("rb")), F.lit(0.0))
    both = a.select(*keys, F.col("rank").alias("ra")).join(b.select(*keys, F.col("rank").alias("rb")), keys, "full")
    return both.select(*keys, part.alias("score"))


def fused(a: DataFrame, b: DataFrame, by: list[str]) -> DataFrame:
    """The ranking that follows from two others."""
    return ranked(fusion_scores(a, b, by), by)


def top(rows: DataFrame, k: int = PER_FIELD) -> DataFrame:
    return rows.where(F.col("rank") < k)


def top_ranked(scores: DataFrame, by: list[str], k: int = PER_FIELD) -> DataFrame:
    """The first ``k`` rows of ``ranked``. The bound stands on the row number itself, so that every task keeps k rows of
    a document and field before anything is shuffled."""
    w = W.partitionBy("doc_id", *by).orderBy(F.desc("score"), "page_no")
    return scores.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k).withColumn("rank", F.col("place") - 1).drop("place")


def priorities(field_top: DataFrame) -> DataFrame:
    """doc_id, cluster, page_no, priority: the best rank over the cluster's fields."""
    return field_top.groupBy("doc_id", "cluster", "page_no").agg(F.min("rank").alias("priority"))


def budget(fields: DataFrame, k: int = 8) -> DataFrame:
    return fields.groupBy("cluster").agg(F.greatest(F.lit(k), F.count("*") + SPARE).alias("k"))


def continued(field_top: DataFrame, tables: DataFrame) -> DataFrame:
    """Pages on which a table goes on: up to two after a table field's top page, while all are tables."""
    w = W.partitionBy("doc_id").orderBy("page_no")
    ahead = tables.select("doc_id", "page_no", "is_table", F.lead("is_table", 1).over(w).alias("one"), F.lead("is_table", 2).over(w).alias("two"))
    start = field_top.where("rank = 0 and type = 'table'").join(ahead.where("is_table and one"), ["doc_id", "page_no"])
    step = F.explode(F.when(F.col("two"), F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    steps = start.select("doc_id", "cluster", "page_no", step.alias("step"))
    return steps.select("doc_id", "cluster", (F.col("page_no") + F.col("step")).alias("page_no")).distinct()


def with_gaps(chosen: DataFrame) -> DataFrame:
    """The chosen pages and, with ``keep``, single pages that are missing between two of them."""
    here = F.struct("page_no", "priority", "keep")
    gap = F.struct((F.col("page_no") + 1).alias("page_no"), F.lit(None).cast("int").alias("priority"), F.lit(True).alias("keep"))
    after = F.lead("page_no").over(W.partitionBy("doc_id", "cluster").orderBy("page_no"))
    both = F.when(F.col("next") - F.col("page_no") == 2, F.array(here, gap)).otherwise(F.array(here))
    return chosen.withColumn("next", after).select("doc_id", "cluster", F.inline(both))


def select_pages(pages: DataFrame, fields: DataFrame, scores: DataFrame, field_top: DataFrame, tables: DataFrame, k: int = 8, cap: int | None = None) -> DataFrame:
    """doc_id, cluster, pages: the pages to show, ascending.

    Field winners and table continuations, the first PINNED pages, the cluster's keyword ranking while the budget
    lasts, single gaps; ``pages`` are numbers only, ``scores`` those of the fields' keywords. If ``cap`` is set, pinned and gap pages stay and the rest goes by priority, ties by page.
    """
    keys = ["doc_id", "cluster", "page_no"]
    clusters = F.broadcast(fields.select("cluster").distinct())
    front = pages.where(F.col("page_no") <= PINNED).select("doc_id", "page_no").join(clusters, F.lit(True))
    row = lambda rows, base, rank=None, score=None: rows.select(*keys, F.lit(base).alias("base"), F.lit(rank).cast("int").alias("priority"), F.lit(score).cast("double").alias("score"))
    rows = row(field_top, True, rank=F.col("rank")).unionByName(row(continued(field_top, tables), True)).unionByName(row(front, True)).unionByName(row(scores, False, score=F.col("score")))
    # a document's pages meet once; all steps from here on find them together
    rows = rows.repartition("doc_id", "cluster").groupBy(*keys).agg(F.max("base").alias("base"), F.min("priority").alias("priority"), F.sum("score").alias("score"))
    rows = rows.join(F.broadcast(budget(fields, k)), "cluster", "left")
    by_score = W.partitionBy("doc_id", "cluster").orderBy(F.desc_nulls_last("score"), "page_no")
    free = F.col("score").isNotNull() & ~F.col("base")
    upto, whole = by_score.rowsBetween(W.unboundedPreceding, W.currentRow), by_score.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    rows = rows.select("*", F.row_number().over(by_score).alias("place"), F.count_if(free).over(upto).alias("filled"), F.count_if("base").over(whole).alias("n"))
    # a null doc_id is no document, so it has no room
    room = F.when(F.col("doc_id").isNotNull() & (F.col("n") > 0), F.col("k") - F.col("n"))
    chosen = rows.where(F.col("base") | F.coalesce(free & (F.col("filled") <= room), F.lit(False)))
    priority = F.when(F.col("base"), F.when(F.col("doc_id").isNotNull(), F.col("priority"))).otherwise(F.col("place") - 1)
    chosen = with_gaps(chosen.select(*keys, priority.alias("priority"), (F.col("page_no") <= PINNED).alias("keep")))
    if cap is not None:
        w = W.partitionBy("doc_id", "cluster")
        order = w.orderBy(F.col("keep").desc(), F.coalesce("priority", F.lit(999)), "page_no")
        chosen = chosen.withColumn("place", F.row_number().over(order)).where((F.col("place") <= cap) | F.col("keep"))
    return chosen.groupBy("doc_id", "cluster").agg(F.array_sort(F.collect_set("page_no")).alias("pages"))


def question_pages(questions: DataFrame, pages: DataFrame, question_vectors: DataFrame, page_vectors: DataFrame, by: list[str], k: int = PER_FIELD) -> DataFrame:
    """doc_id, *by, page_no, score, rank: the best pages of a document for each question put to it.

    ``questions``: doc_id, *by, ws (its words). Word hits and cosine are fused; a document or question without
    vectors is ranked by words alone. Questions meet the pages of their own document only.
    """
    at = pages.where(F.trim("text") != "").select("doc_id", "page_no", F.lower("text").alias("t")).join(questions.where(F.size("ws") > 0), "doc_id")
    hits = lambda w: F.floor((F.length("t") - F.length(F.replace(F.col("t"), w, F.lit("")))) / F.length(w))
    words = at.select("doc_id", *by, "page_no", F.aggregate("ws", F.lit(0.0), lambda s, w: s + F.least(hits(w), F.lit(HITS))).alias("score")).where("score > 0")
    near = page_vectors.join(question_vectors, "doc_id").select("doc_id", *by, "page_no", cosine(F.col("v"), F.col("q")).alias("score"))
    return top_ranked(fusion_scores(ranked(near, by), ranked(words, by), by), by, k)


def cluster_subset(rows: DataFrame, fields: DataFrame, wanted: list[str]) -> DataFrame:
    """Rows of the wanted clusters; a name that no field has is an error."""
    known = {r.cluster for r in fields.select("cluster").distinct().collect()}  # a dimension of a few rows
    if unknown := sorted(set(wanted) - known):
        raise ValueError(f"unknown clusters: {', '.join(unknown)}")
    return rows.where(F.col("cluster").isin(*wanted))


def shown_pages(selected: DataFrame, pages: DataFrame, modality: str, full_text: bool = False, cap: int = CAP) -> DataFrame:
    """doc_id, cluster, page_no: text may take every page; pictures are held to ``cap`` pages, the lowest numbers first."""
    rows = selected.select("doc_id", "cluster", F.explode("pages").alias("page_no"))
    if modality == "text" and full_text:
        return selected.select("doc_id", "cluster").join(pages.select("doc_id", "page_no"), "doc_id")
    if modality == "vision":
        w = W.partitionBy("doc_id", "cluster").orderBy("page_no")
        rows = rows.withColumn("place", F.row_number().over(w)).where(F.col("place") <= cap).drop("place")
    return rows
