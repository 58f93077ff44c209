"""Document fingerprints by I-Match over randomised lexica, on built-in functions only.

Terms are lower-cased words. The lexicon holds the terms whose document frequency lies
between LOW and HIGH of all documents (a band of inverse document frequency). A document
keeps its distinct terms from the lexicon, sorted, and hashes them once whole and once for
each of several random subsets of the lexicon. Two texts are the more alike the more of
these hashes agree.

A term in the lexicon occurs in LOW of all documents, so the lexicon has at most (distinct
terms a document, on average) / LOW entries, however large the corpus. Up to MAX_INLINE terms become a
constant of the plan, looked up as a hash set; a larger lexicon stays a table that the texts' terms are joined with.
Texts are shuffled once, to bring each next to its successor.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quillmark.llm.common import ascii_lower, cut, words

LOW, HIGH = 0.001, 0.10
#: Terms of a lexicon that becomes a constant of the plan.
MAX_INLINE = 50_000
#: Draws of subsets: the k-th takes the terms whose md5 has a zero as its digit 2k + 1, and the 16 after
#: them those among these whose next digit is below 4.
DRAWS = 16
#: The same as (first digit, mark below which the digits from there on are).
SUBSETS = tuple((2 * k + 1, mark) for mark in ("10", "04") for k in range(DRAWS))


def terms(text: Column) -> Column:
    return F.array_distinct(words(ascii_lower(text)))


def lexicon(docs: DataFrame, low: float = LOW, high: float = HIGH) -> DataFrame:
    """term, df of the terms in the band."""
    each = docs.select(F.explode(terms(F.col("text"))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    return each.withColumn("n", docs.agg(F.count("*")).scalar()).where((F.col("df") >= F.greatest(F.lit(2), low * F.col("n"))) & (F.col("df") <= high * F.col("n"))).select("term", "df")


def _quoted(lex: list[str]) -> str:
    """The terms as SQL strings; one text reaches the planner sooner than as many column objects."""
    return ", ".join("'" + t.replace("\\", "\\\\").replace("'", "\\'") + "'" for t in lex)


def with_hashes(rows: DataFrame, text: str, lex: DataFrame, inline: list[str] | None) -> DataFrame:
    """Adds ``hashes``: sorted md5s of a text's terms in the lexicon, of all its terms if it has none there."""
    rows = rows.withColumn("mine", terms(F.col(text)))
    if inline is None:
        # equal texts have equal terms: each distinct one is looked up once
        rows = rows.withColumn("_sha", F.sha2(text, 256))
        each = rows.select("_sha", F.explode("mine").alias("term")).distinct().join(lex.select("term"), "term")
        rows = rows.join(each.groupBy("_sha").agg(F.collect_list("term").alias("inside")), "_sha", "left").drop("_sha")
        rows = rows.withColumn("inside", F.coalesce("inside", F.array().cast("array<string>")))
    else:
        rows = rows.withColumn("inside", F.expr(f"filter(mine, t -> t in ({_quoted(inline)}))") if inline else F.col("mine"))
    rows = rows.withColumn("used", F.when(F.size("inside") > 0, F.col("inside")).otherwise(F.col("mine"))).drop("mine", "inside")
    return rows.withColumn("hashes", F.array_sort(F.transform("used", lambda t: F.md5(t.cast("binary"))))).drop("used")


def fingerprint(hashes: str) -> Column:
    """Eight hex digits of the whole and of each subset, joined by dots; a dash where nothing is left."""
    short = lambda h: f"if(size({h}) > 0, substring(md5(cast(array_join({h}, ' ') as binary)), 1, 8), '-')"
    draws = ", ".join(f"filter({hashes}, t -> substring(t, {2 * k + 1}, 1) = '0')" for k in range(DRAWS))
    # the draws are bound once; the rarer ones are taken from them
    rare = f"transform(d, (h, k) -> filter(h, t -> substring(t, 2 * k + 2, 1) < '4'))"
    each = f"transform(array(array({draws})), d -> array_join(transform(concat(array({hashes}), d, {rare}), h -> {short('h')}), '.'))"
    return F.expr(f"{each}[0]")


def likeness(a: Column, b: Column) -> Column:
    """Share of equal hashes among those that either text has; 1 for equal fingerprints."""
    x, y = F.split(a, r"\."), F.split(b, r"\.")
    pairs = F.arrays_zip(x.alias("x"), y.alias("y"))
    full = F.size(F.filter(pairs, lambda p: (p["x"] != "-") | (p["y"] != "-")))
    same = F.size(F.filter(pairs, lambda p: (p["x"] != "-") & (p["x"] == p["y"])))
    return F.when(a == b, 1.0).otherwise(F.coalesce(F.try_divide(same.cast("double"), full.cast("double")), F.lit(0.0)))


def with_next(docs: DataFrame, order: list[str], carry: list[str], per_bucket: int = 5_000) -> DataFrame:
    """Each row with ``next_*`` of the row that follows by ``order``, the first after the last.

    Ranges of the first order column come from its quantiles, which are values that occur; the
    first row of a range is also sent to the range before it. So no window spans the table. A row
    finds its range in two steps, among the square root of their number each. Of more than 100,000
    times ``per_bucket`` rows the ranges grow; they are sorted, not held.
    """
    key = order[0]
    # the number of bounds grows with the rows; ids only, no texts
    n, low = docs.agg(F.count("*"), F.min(key)).first()
    parts = max(1, min(100_000, n // per_bucket))
    if n == 0 or parts == 1:
        bounds = [low]
    else:
        q = [k / parts for k in range(1, parts)]
        bounds = sorted({low, *docs.where(F.col(key).isNotNull()).agg(F.percentile_approx(key, q, max(10_000, 10 * parts))).first()[0]})
    k = len(bounds)
    if low is None:
        place, first = F.lit(1), F.lit(False)
    else:
        step = max(1, math.isqrt(k))
        shown = lambda values: "array(" + ", ".join(f"{v}L" for v in values) + ")"
        here = F.col(key)
        coarse = F.size(F.filter(F.expr(shown(bounds[::step])), lambda b: b <= here))
        fine = F.get(F.expr("array(" + ", ".join(shown(bounds[a : a + step]) for a in range(0, k, step)) + ")"), coarse - 1)
        place = F.coalesce((coarse - 1) * step + F.size(F.filter(fine, lambda b: b <= here)), F.lit(0))
        first = F.array_contains(fine, here)
    own = F.when(F.col(key).isNull(), 1).otherwise(place).cast("int")
    starts = F.col(key).isNull() | first
    prior = F.when(F.col("own") == 1, F.lit(k)).otherwise(F.col("own") - 1)
    rows = docs.withColumn("own", own).withColumn("starts", F.coalesce(starts, F.lit(True)))
    rows = rows.withColumn("spare", F.explode(F.when(F.col("starts"), F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))))
    # a null key is the first of all: it is sent to the last range, and leads the first
    rows = rows.withColumn("part", F.when(F.col("spare"), prior).otherwise(F.col("own")))
    w = W.partitionBy("part").orderBy("spare", *[F.col(c).asc_nulls_first() for c in order])
    rows = rows.select("*", *[F.lead(c).over(w).alias(f"next_{c}") for c in carry])
    return rows.where("not spare").drop("own", "starts", "spare", "part")


def imatch(docs: DataFrame, low: float = LOW, high: float = HIGH, max_inline: int = MAX_INLINE) -> DataFrame:
    """doc_id, n_chars, text, edited, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text is the text with its last floor(n / 2) characters replaced by as many from
    the start of the next document (or all it has), by ascending doc_id, the first after the last. Null texts count
    as empty; texts without terms have the empty fingerprint, alike only with itself. Rows with equal doc_id follow each other by
    text; a null doc_id comes first. Very long texts are taken whole. Other columns are ignored; an empty table gives no rows.
    """
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    lex = cut(lexicon(base, low, high))
    inline = [r.term for r in lex.select("term").collect()] if lex.count() <= max_inline else None
    one = with_hashes(base, "text", lex, inline)
    one = one.select("doc_id", "text", fingerprint("hashes").alias("fingerprint"))
    both = with_next(one, ["doc_id", "text"], ["text", "fingerprint"])
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.col("next_text"), F.lit(1), half))
    both = both.select("doc_id", n.cast("long").alias("n_chars"), "text", edited.alias("edited"), "fingerprint", "next_fingerprint")
    both = with_hashes(both, "edited", lex, inline)
    both = both.withColumn("edited_fingerprint", fingerprint("hashes"))
    return both.select("doc_id", "n_chars", "text", "edited", "fingerprint", "edited_fingerprint",
                       likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
                       likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"))
