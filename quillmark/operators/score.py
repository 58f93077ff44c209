"""Roll-ups of verdicts, calls and latencies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quillmark.sources.tables import kept

VERDICTS = ("correct", "partial", "wrong", "missing")


def verdict_counts(graded: DataFrame, by: list[str]) -> DataFrame:
    n = lambda v: F.count_if(F.col("verdict") == v)
    total = F.count("*")
    return graded.groupBy(*by).agg(
        *[n(v).alias(v) for v in VERDICTS], total.alias("total"), F.round(n("correct") / total, 4).alias("accuracy"),
        F.round((n("correct") + 0.5 * n("partial")) / total, 4).alias("adjusted"))


def grounded_credit(graded: DataFrame, by: list[str]) -> DataFrame:
    got = F.count_if(F.col("verdict") == "correct") + F.count_if((F.col("verdict") == "partial") & (F.col("status") == "verified"))
    return graded.groupBy(*by).agg(F.round(got / F.count("*"), 4).alias("grounded_accuracy"))


def multi_grain(graded: DataFrame, grains: list[str]) -> DataFrame:
    """Overall and by each grain, in one pass over the rows."""
    n = lambda v: F.count_if(F.col("verdict") == v)
    sets = [[], *[[F.col(g)] for g in grains]]
    return graded.groupingSets(sets, *grains).agg(*[n(v).alias(v) for v in VERDICTS], F.count("*").alias("total"), F.grouping_id().cast("int").alias("grain"))


def agreement(answers: DataFrame) -> DataFrame:
    """doc_id, field_key, n, agree of fields that at least two backends answered."""
    return answers.groupBy("doc_id", "field_key").agg(F.count("*").alias("n"), (F.count_distinct("shown") == 1).alias("agree")).where("n >= 2")


def call_cost(prompt: Column, completion: Column, price_in: Column, price_out: Column) -> Column:
    return F.coalesce((prompt * price_in + completion * price_out) / 1e6, F.lit(0.0))


def band(percent: Column) -> Column:
    return F.when(percent >= 65, "good").when(percent >= 55, "mid").otherwise("low")


def confidence_bucket(c: Column) -> Column:
    c = F.coalesce(c, F.lit(0.5))
    return F.when(c >= 0.8, "high").when(c >= 0.5, "medium").otherwise("low")


def confidence_percent(c: Column) -> Column:
    return F.bround(F.coalesce(c, F.lit(0.5)) * 100).cast("int")


def field_status(present: Column, status: Column, bucket: Column) -> Column:
    return F.when(~present, "not_found").when((status == "verified") & (bucket != "low"), "found").otherwise("needs_review")


#: Why a field is to be reviewed.
REASONS = {"verified": "low confidence", "wrong_page": "found on another page", "unverified": "quote not found", "no_quote": "no quote given"}


def review_reason(status: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in REASONS.items() for x in kv])
    return F.coalesce(F.element_at(table, F.coalesce(status, F.lit(""))), F.lit("manual review"))


def nested_accuracy(graded: DataFrame, outer: str, inner: str) -> DataFrame:
    """outer, breakdown: a map from each inner value to its counts and accuracy."""
    rows = verdict_counts(graded, [outer, inner])
    entry = F.struct(inner, F.struct("correct", "total", "accuracy"))
    return rows.groupBy(outer).agg(F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("breakdown"))


def exact_median(rows: DataFrame, by: list[str], value: str, bins: int = 1024) -> DataFrame:
    """*by, median: exactly, by narrowing the range that holds the middle values until it is one value.

    Each round counts the values of the range in ``bins`` bins before anything is shuffled, and goes on with the bin in
    which the middle falls, between its own least and greatest value. State: ``bins`` counts a group, whatever its size.
    Nulls are left out; values must be finite."""
    v = F.col(value).cast("double")
    rows = rows.where(v.isNotNull()).select(*by, v.alias("v"))
    at = rows.groupBy(*by).agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    half = lambda k: F.floor((F.col("n") - k) / 2)
    at = kept(at.select(*by, "lo", "hi", F.explode(F.array(F.struct(F.lit(0).alias("middle"), half(1).alias("rank")), F.struct(F.lit(1).alias("middle"), half(0).alias("rank")))).alias("m")).select(*by, "lo", "hi", "m.*"))
    done = None
    while True:
        closed, open_ = at.where("lo = hi"), at.where("lo < hi")
        done = closed if done is None else done.unionByName(closed)
        if open_.isEmpty():
            return done.groupBy(*by).agg(F.avg("lo").alias("median"))
        same = [rows[c].eqNullSafe(open_[c]) for c in by]
        inside = rows.join(open_, [*same, rows.v.between(open_.lo, open_.hi)] if by else rows.v.between(open_.lo, open_.hi))
        spot = F.least(F.floor((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins), F.lit(bins - 1))
        counted = inside.groupBy(*[open_[c] for c in by], "middle", "rank", spot.alias("bin")).agg(F.count("*").alias("k"), F.min("v").alias("lo"), F.max("v").alias("hi"))
        upto = F.sum("k").over(W.partitionBy(*by, "middle").orderBy("bin"))
        hit = counted.withColumn("before", upto - F.col("k")).where("rank >= before and rank < before + k")
        at = kept(hit.select(*by, "lo", "hi", "middle", (F.col("rank") - F.col("before")).alias("rank")))


def agreement_ratio(agreed: DataFrame, by: list[str]) -> DataFrame:
    """*by, fields, agreeing, ratio of the rows of ``agreement``."""
    return agreed.groupBy(*by).agg(F.count("*").alias("fields"), F.count_if("agree").alias("agreeing"), F.round(F.count_if("agree") / F.count("*"), 4).alias("ratio"))


def disagreements(answers: DataFrame) -> DataFrame:
    """doc_id, field_key, values: what each backend says where they differ, by backend."""
    said = F.array_sort(F.collect_list(F.struct("backend", "shown")))
    rows = answers.groupBy("doc_id", "field_key").agg(F.count_distinct("shown").alias("kinds"), said.alias("said")).where("kinds > 1")
    return rows.select("doc_id", "field_key", F.array_join(F.transform("said", lambda x: F.concat(x["backend"].cast("string"), F.lit(": "), x["shown"])), "; ").alias("values"))


def run_summary(per_doc: DataFrame, calls: DataFrame, by: list[str]) -> DataFrame:
    """One row per run: documents, present and absent fields, mean rates of the documents that have any, cost and latency a document.

    ``per_doc``: by, doc_id, asserted, absent, groundedness, hallucination. ``calls``: by, doc_id, cost, latency; calls are summed
    before they meet the documents. A document without calls costs nothing; calls without a document do not count.
    """
    spent = calls.groupBy(*by, "doc_id").agg(F.sum("cost").alias("cost"), F.sum("latency").alias("latency"))
    rows = per_doc.join(spent, [*by, "doc_id"], "left")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0.0))
    return rows.groupBy(*by).agg(
        F.count("*").alias("docs"), F.sum("asserted").alias("present"), F.sum("absent").alias("absent"), F.round(F.avg("groundedness"), 4).alias("groundedness"),
        F.round(F.avg("hallucination"), 4).alias("hallucination"), F.round(total("cost"), 2).alias("cost"), F.round(total("latency") / F.count("*"), 4).alias("latency_per_doc"))


def tiles(served: DataFrame, pages: DataFrame, by: list[str]) -> DataFrame:
    """Found, missing and open fields, the percentage of high confidence and the pages of the documents served (each document once)."""
    n = lambda s: F.count_if(F.col("status") == s)
    per_doc = served.groupBy(*by, "doc_id").agg(
        n("found").alias("found"), n("not_found").alias("missing"), n("needs_review").alias("review"), F.count_if(F.col("bucket") == "high").alias("top"), F.count("*").alias("n"))
    rows = per_doc.join(pages.groupBy("doc_id").agg(F.count("*").alias("pages")), "doc_id", "left")
    total = lambda c: F.sum(c).alias(c)
    return rows.groupBy(*by).agg(
        total("found"), total("missing"), total("review"), F.round(100.0 * F.sum("top") / F.sum("n"), 2).alias("high"), F.coalesce(F.sum("pages"), F.lit(0)).alias("pages"))
