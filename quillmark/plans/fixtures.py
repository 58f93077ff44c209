"""Views over the stored tables that stand in for answers, truths, quotes and calls.

Each is derived by Spark from the tables at hand, so that it grows with them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.functions import text as T
from quillmark.sources.tables import kept, line_pages, page_numbers, table

#: Demonstration fields over words that occur: (field, number, type, cluster, keywords).
FIELDS = (
    ("opening", 1, "text", "alpha", ("the", "on the")),
    ("closing", 2, "list", "alpha", ("tion", "of the", "re")),
    ("weights", 3, "table", "beta", ("of", "and the")),
    ("contact", 4, "contact", "beta", ("and", "@", "contact")),
    ("terms", 5, "text", "gamma", ("license", "licensed under", "version")),
)


def fields(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([f[:4] for f in FIELDS], "field_key string, number int, type string, cluster string")


def keywords(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(f[0], f[3], k) for f in FIELDS for k in f[4]], "field_key string, cluster string, keyword string")


def pages(spark, d):
    return line_pages(table(spark, d, "documents"))


def pages_of(docs, rows):
    """Pages of the documents that ``rows`` name; the others are left out before they are cut."""
    return line_pages(docs.join(rows.select("doc_id").distinct(), "doc_id", "left_semi"))


def numbers(spark, d):
    return page_numbers(table(spark, d, "documents"))


def hits(spark, d):
    """item_id, doc_id, page_no, quote: passages that stand on a page. Candidates share the passage's second to
    sixth word with the page, as its first and last may be parts of longer ones there; only those are searched. Passages
    of fewer than seven words are searched on every page."""
    b = table(spark, d, "benchmark").select("item_id", F.col("text").alias("quote"), T.normalise(F.col("text")).alias("needle"))
    w = F.split("needle", " ")
    inner = b.where(F.size(w) > 6).select("item_id", F.xxhash64(*[F.get(w, F.lit(k)) for k in range(1, 6)]).alias("k"))
    brief = b.where(F.size(w) <= 6).select("item_id", "needle")
    p = pages(spark, d).select("doc_id", "page_no", T.normalise(F.col("text")).alias("hay"))
    key = ["doc_id", "page_no", "item_id"]
    at = kept(runs(p, "hay").join(inner, "k").select(*key).union(p.join(brief, F.instr("hay", F.col("needle")) > 0).select(*key)).distinct())
    # texts are fetched for the candidates only
    at = pages_of(table(spark, d, "documents"), at).join(at, ["doc_id", "page_no"]).join(b, "item_id")
    return at.where(F.instr(T.normalise(F.col("text")), F.col("needle")) > 0).select("item_id", "doc_id", "page_no", "quote")


def runs(rows, text: str, size: int = 5):
    """doc_id, page_no, k: hash of every run of five words of a text of single blanks."""
    w = rows.select("doc_id", "page_no", F.split(text, " ").alias("w"))
    zipped = F.arrays_zip(*[F.slice("w", F.lit(1 + k), F.size("w")).alias(f"w{k}") for k in range(size)])
    return w.select("doc_id", "page_no", F.inline(zipped)).select("doc_id", "page_no", F.xxhash64(*[f"w{k}" for k in range(size)]).alias("k"))


def quotes(spark, d):
    """Hits cited by three backends, some absent, without quote, on a wrong page, garbled, altered in
    their last word, or going on to the next page."""
    found = kept(hits(spark, d))
    after = pages_of(table(spark, d, "documents"), found).select("doc_id", (F.col("page_no") - 1).alias("page_no"), F.array_join(F.slice(F.split("text", " "), 1, 10), " ").alias("on"))
    q = found.join(after, ["doc_id", "page_no"], "left").select("*", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("b"))
    r = F.pmod(7 * F.col("item_id") + 3 * F.col("doc_id") + 5 * F.col("b"), F.lit(10))
    q = q.withColumn("r", r)
    return q.select(
        "b", "doc_id", "item_id", (F.col("r") != 0).alias("present"),
        F.when(F.col("r") == 0, None).when(F.col("r") == 2, F.col("page_no") + 1).otherwise(F.col("page_no")).cast("int").alias("page"),
        F.when(F.col("r").isin(0, 1), None).when(F.col("r") == 3, F.reverse("quote")).when(F.col("r") == 4, F.regexp_replace("quote", r"\S+$", "altered"))
        .when(F.col("r") == 5, F.concat_ws(" ", "quote", "on")).otherwise(F.col("quote")).alias("quote"))


def truth(spark, d):
    k = F.pmod("doc_id", F.lit(3))
    return table(spark, d, "labels").select(
        "doc_id", F.lit("quality").alias("field_key"), (F.col("quality") == 1).alias("v"), (F.pmod("doc_id", F.lit(7)) != 0).alias("present"),
        F.when(k == 0, "easy").when(k == 1, "hard").alias("difficulty"))


def answers(spark, d):
    a = table(spark, d, "labels").select("doc_id", "quality", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("backend"))
    s = F.col("doc_id") + F.col("backend")
    flip = F.pmod(s, F.lit(5)) == 0
    return a.where(F.pmod(3 * F.col("doc_id") + F.col("backend"), F.lit(11)) != 0).select(
        "backend", "doc_id", F.lit("quality").alias("field_key"), ((F.col("quality") == 1) != flip).alias("a"), (F.pmod(s, F.lit(13)) != 0).alias("a_present"))


def two_truths(spark, d):
    """Truth of two fields of each labelled document."""
    rows = table(spark, d, "labels").select("doc_id", F.explode(F.array(
        F.struct(F.lit("quality").alias("field_key"), (F.col("quality") == 1).alias("v"), (F.pmod("doc_id", F.lit(7)) != 0).alias("present")),
        F.struct(F.lit("toxic").alias("field_key"), (F.col("toxic") == 1).alias("v"), (F.pmod("doc_id", F.lit(5)) != 0).alias("present")))).alias("t"))
    k = F.pmod("doc_id", F.lit(3))
    return rows.select("doc_id", "t.*", F.when(k == 0, "easy").when(k == 1, "hard").alias("difficulty"))


def two_answers(spark, d):
    """Answers to both fields; of the second every fourth is missing, and likeness bands its verdict."""
    t = table(spark, d, "labels").select("doc_id", "toxic", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("backend"))
    s = F.col("doc_id") + F.col("backend")
    t = t.where(F.pmod(F.col("doc_id") + 2 * F.col("backend"), F.lit(4)) != 0).select(
        "backend", "doc_id", F.lit("toxic").alias("field_key"), ((F.col("toxic") == 1) != (F.pmod(s, F.lit(7)) == 0)).alias("a"), (F.pmod(s, F.lit(6)) != 0).alias("a_present"),
        F.pmod(11 * F.col("doc_id") + 17 * F.col("backend"), F.lit(100)).cast("double").alias("likeness"))
    return answers(spark, d).withColumn("likeness", F.lit(None).cast("double")).unionByName(t)


def calls(spark, d):
    return table(spark, d, "lineitem").select(
        F.col("l_returnflag").alias("backend"), F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("cluster"),
        F.col("l_quantity").cast("double").alias("tokens"), F.col("l_extendedprice").cast("double").alias("cost"), (F.col("l_tax") != 0).alias("ok"))


def served(spark, d):
    """One row per backend and labelled document, as a reader would see it."""
    a = answers(spark, d)
    return a.select("backend", "doc_id", F.col("a_present").alias("present"), F.col("a").cast("string").alias("value"), (F.pmod(37 * F.col("doc_id"), F.lit(101)) / 100.0).alias("confidence"),
                    F.when(F.pmod("doc_id", F.lit(4)) == 0, "wrong_page").when(F.pmod("doc_id", F.lit(4)) == 1, "unverified").otherwise("verified").alias("evidence"),
                    F.when(F.pmod("doc_id", F.lit(2)) == 0, "deadline").otherwise("scope").alias("category"), F.concat(F.lit("Field "), F.col("doc_id").cast("string")).alias("label"))


def page_vectors(spark, d):
    return table(spark, d, "embeddings").select(F.floor(F.col("vec_id") / 10).cast("long").alias("doc_id"), (F.pmod("vec_id", F.lit(10)) + 1).cast("int").alias("page_no"), F.col("embedding").alias("v"))


def field_vectors(spark, d):
    e = table(spark, d, "embeddings")
    return e.groupBy(F.col("label").cast("string").alias("field_key")).agg(F.min_by("embedding", "vec_id").alias("q"))


def dates(spark, d):
    """Order dates written two ways, and answers that are late, or invent a time."""
    o = table(spark, d, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("day"))
    k = lambda n: F.pmod("o_orderkey", F.lit(n))
    written = lambda c: F.date_format(c, "MMMM d, yyyy")
    a = F.when(k(6) == 0, F.date_add("day", 1)).otherwise(F.col("day"))
    return o.select("o_orderkey", F.when(k(2) == 0, F.col("day").cast("string")).otherwise(written("day")).alias("truth"),
                    F.concat(F.when(k(3) == 0, a.cast("string")).otherwise(written(a)), F.when(k(5) == 0, " 2.00 PM MST").otherwise("")).alias("answer"))
