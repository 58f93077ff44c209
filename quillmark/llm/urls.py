"""URL filter: host and path rules, then a character language-model ratio for the rest.

Two smoothed variable-order Markov models, one of accepted and one of rejected URLs, are
counted from the URLs that the rules decide. A URL's score is the mean over its characters
of log P_accepted - log P_rejected; the cut is calibrated on decided URLs held out of the
counts. Built-in functions only. The models are tables of at most SYMBOLS ** (order + 1)
numbers whatever the input, so they travel as one bounded array value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quillmark.llm.common import ascii_lower

#: Characters that the models tell apart; digits count as 0, all others as one symbol.
ALPHABET = "abcdefghijklmnopqrstuvwxyz0/.-_?=&%:#"
SYMBOLS = len(ALPHABET) + 2
#: (verdict, host, path)
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
#: Weight of the shorter context's estimate, in characters.
BACKOFF = 4.0
#: Scores are whole millionths, so that sums do not depend on their order.
UNIT = 1_000_000


def host_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty without ``://`` or for null."""
    url = F.coalesce(url, F.lit(""))
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(url) + 1), r"^[^?#]*", 0)
    return ascii_lower(host), path


def matching(host: Column, path: Column, rules) -> tuple[Column, Column]:
    """Name and verdict of the longest rule whose host and path fit, the earlier listed of equally long ones; null without one."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for said, h, p in sorted(reversed(rules), key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(said)).otherwise(verdict)
    return name, verdict


def grams_of(url: str, order: int) -> Column:
    """For each character the number of (preceding ``order`` characters, character); the array
    of symbols is bound once, as the only element of an array."""
    s = f"translate(lower(coalesce({url}, '')), '123456789', '000000000')"
    one = f"transform(filter(split({s}, ''), c -> c <> ''), c -> instr('{ALPHABET}', c))"
    code = "a[i]"
    for k in range(1, order + 1):
        code = f"({code} * {SYMBOLS} + a[i + {k}])"
    every = f"if(size(a) > {order}, transform(sequence(0, greatest(size(a) - {order + 1}, 0)), i -> {code}), cast(array() as array<int>))"
    return F.expr(f"transform(array(concat(array_repeat({SYMBOLS - 1}, {order}), {one})), a -> {every})[0]")


def model_table(counts: DataFrame, order: int) -> DataFrame:
    """gram, llr (whole units) for every possible gram, from counts(gram, a, r).

    P_k(c | context of k) = (n(context c) + BACKOFF * P_(k-1)) / (n(context) + BACKOFF), down to
    the even distribution: a context that was seen often speaks for itself, a rare one defers.
    All tables here are bounded by SYMBOLS ** (order + 1) rows.
    """
    spark = counts.sparkSession
    full = spark.range(SYMBOLS ** (order + 1)).select(F.col("id").cast("int").alias("gram"))
    pa = pr = F.lit(1.0 / SYMBOLS)
    for k in range(order + 1):
        size, ctx = SYMBOLS ** (k + 1), SYMBOLS**k
        tail = F.pmod("gram", F.lit(size))
        here = counts.groupBy(tail.alias(f"g{k}")).agg(F.sum("a").alias(f"a{k}"), F.sum("r").alias(f"r{k}"))
        above = counts.groupBy(F.floor(tail / SYMBOLS).cast("int").alias(f"x{k}")).agg(F.sum("a").alias(f"ca{k}"), F.sum("r").alias(f"cr{k}"))
        full = full.join(F.broadcast(here), F.pmod("gram", F.lit(size)) == F.col(f"g{k}"), "left")
        full = full.join(F.broadcast(above), F.floor(F.pmod("gram", F.lit(size)) / SYMBOLS).cast("int") == F.col(f"x{k}"), "left")
        zero = lambda c: F.coalesce(F.col(c), F.lit(0))
        pa = (zero(f"a{k}") + BACKOFF * pa) / (zero(f"ca{k}") + BACKOFF)
        pr = (zero(f"r{k}") + BACKOFF * pr) / (zero(f"cr{k}") + BACKOFF)
        full = full.select("gram", pa.alias("pa"), pr.alias("pr"))
        pa, pr = F.col("pa"), F.col("pr")
    return full.select("gram", F.round((F.log("pa") - F.log("pr")) * UNIT).cast("long").alias("llr"))


def as_array(table: DataFrame) -> DataFrame:
    """The table as one array value, entry gram + 1."""
    return table.agg(F.transform(F.array_sort(F.collect_list(F.struct("gram", "llr"))), lambda x: x["llr"]).alias("llrs"))


def filter_urls(pages: DataFrame, rules=RULES, order: int = 2) -> DataFrame:
    """page_id, host, path, rule, verdict, score, cut_score for every page.

    Rules win, the longest first; of equally long ones the earlier listed. Other URLs are
    allowed if their score reaches the calibrated cut. Null and empty URLs have empty host and
    path and a score of 0. Repeated rows are judged alike; other columns are ignored. Without decided URLs of
    both kinds all scores and the cut come out even, so that what has no rule is allowed.
    """
    host, path = host_path(F.col("url"))
    base = pages.select("page_id", F.col("url").cast("string").alias("url")).select(
        "page_id", "url", host.alias("host"), path.alias("path"))
    name, verdict = matching(F.col("host"), F.col("path"), rules)
    base = base.select("*", name.alias("rule"), verdict.alias("said"), F.md5("url").substr(1, 1).isin("0", "1", "2", "3").alias("held"))

    learn = base.where("said is not null and not held").select("said", F.explode(grams_of("url", order)).alias("gram"))
    counts = learn.groupBy("gram").agg(F.count_if(F.col("said") == "allow").alias("a"), F.count_if(F.col("said") == "block").alias("r"))
    both = base.where("said is not null and not held").agg((F.count_if(F.col("said") == "allow") * F.count_if(F.col("said") == "block")).alias("n"))
    llrs = as_array(model_table(counts, order))

    scored = base.withColumn("llrs", llrs.scalar()).withColumn("both", both.scalar())
    total = F.aggregate(grams_of("url", order), F.lit(0).cast("long"), lambda s, g: s + F.element_at(F.col("llrs"), g + 1))
    n = F.greatest(F.length(F.coalesce("url", F.lit(""))), F.lit(1))
    scored = scored.withColumn("score", F.when(F.col("both") > 0, F.floor(total / n)).otherwise(F.lit(0)).cast("long")).drop("llrs", "both")

    # calibration: the cut with the best mean of both classes' rates; at most a few ten thousand cells
    cells = scored.where("said is not null and held").groupBy(F.floor(F.col("score") / (UNIT // 1000)).alias("cell")).agg(
        F.count_if(F.col("said") == "allow").alias("a"), F.count_if(F.col("said") == "block").alias("r"))
    up, whole = W.orderBy("cell"), W.partitionBy()
    rated = cells.select("cell", (F.sum("a").over(whole) - F.sum("a").over(up) + F.col("a")).alias("kept"), (F.sum("r").over(up) - F.col("r")).alias("out"),
                         F.sum("a").over(whole).alias("ta"), F.sum("r").over(whole).alias("tr"))
    best = rated.where("ta > 0 and tr > 0").agg(
        F.max_by("cell", F.struct(F.col("kept") * F.col("tr") + F.col("out") * F.col("ta"), -F.abs("cell"), -F.col("cell"))).alias("cell"))
    scored = scored.withColumn("cut_score", F.coalesce(best.scalar(), F.lit(0)) * (UNIT // 1000))
    return scored.select(
        "page_id", "host", "path", "rule",
        F.coalesce("said", F.when(F.col("score") >= F.col("cut_score"), "allow").otherwise("block")).alias("verdict"),
        "score", "cut_score")
