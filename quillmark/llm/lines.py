"""Line dedup by a deletion-neighbourhood join, on built-in functions only.

A line is removed if an earlier line (by doc_id, then place) lies within the edit bound: one
word inserted, deleted or replaced (an edit distance of one, in words) for lines of NEAR or more words,
none for shorter ones, of which one word is too large a part. Lines of every length take part; only blank ones stay.
For every eligible line all variants with one word left out are emitted as hashed keys, and
the line itself at each place where another may have one word more; lines that share a key are within the
bound. The earliest line of a key speaks for it, so a key's group is never paired out.

Scale: equal lines are merged by a 128-bit hash first. Two lines within the bound share
their first or their last half word for word, so only lines whose half occurs in another line
go to the neighbourhood join. Prefix and suffix hashes come from running XORs, so that a
line of n words costs n keys, not n * n words. Whole-table joins are by doc_id or hash; the
texts are shuffled by doc_id only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quillmark.llm.common import cut, spread_join, words

#: Lines of fewer words are compared exactly; lines of fewer than LEAST characters, here the blank ones, always stay.
NEAR, LEAST = 8, 1


def _numbered(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line_no", "line"))


def _halves(w, n):
    """Hashes of the first and last halves that a line shares with a line of one word more or less."""
    def both(k):
        return [F.xxhash64(F.lit("a"), k, F.slice(w, F.lit(1), k)), F.xxhash64(F.lit("z"), k, F.slice(w, n - k + 1, k))]

    # lengths n and n + 1 use half of n; so a line stands under its own half and that of n - 1
    here, less = F.floor(n / 2).cast("int"), F.floor((n - 1) / 2).cast("int")
    return F.array_distinct(F.array(*both(here), *both(less)))


def _line_words(docs: DataFrame, places: DataFrame) -> DataFrame:
    """doc_id, line_no, w: the words of the lines at these places."""
    lists = places.groupBy("doc_id").agg(F.sort_array(F.collect_set("line_no")).alias("nos"))
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(lists, "doc_id")
    # a text is split once and bound; picked from beside it, its lines would each split it again
    both = F.array(F.struct(F.split("text", "\n").alias("all"), F.col("nos")))
    picked = F.transform(both, lambda x: F.transform(x["nos"], lambda n: F.struct(n.alias("line_no"), F.get(x["all"], n).alias("line"))))
    at = texts.select("doc_id", F.explode(F.element_at(picked, 1)).alias("p")).where("p.line is not null")
    return at.select("doc_id", "p.line_no", words(F.trim("p.line")).alias("w"))


def near_lines(docs: DataFrame, near_words: int = NEAR, least: int = LEAST) -> DataFrame:
    """Places (doc_id, line_no) of eligible lines, and whether each stays: first (its exact line's
    earliest place), near (an earlier line within one edit)."""
    at = F.struct(F.col("doc_id"), F.col("line_no"))
    line = F.trim(F.col("line"))
    eligible = _numbered(docs).where(F.length(line) >= least).select("doc_id", "line_no", line.alias("line"))
    hashed = eligible.select(
        F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(17), "line").alias("h2"), at.alias("at"), words(F.col("line")).alias("w"))
    hashed = hashed.select("h1", "h2", "at", F.when(F.size("w") >= near_words, _halves(F.col("w"), F.size("w"))).alias("halves"))
    firsts = cut(
        hashed.groupBy("h1", "h2").agg(F.min("at").alias("at"), F.count("*").alias("n"), F.first("halves").alias("halves")))
    halves = firsts.where("halves is not null").select("h1", "at", F.explode("halves").alias("half"))
    shared = halves.groupBy("half").agg(F.count("*").alias("n")).where("n > 1").select("half")
    alike = halves.join(shared, "half", "left_semi").select("at.doc_id", "at.line_no").distinct()

    # word hashes of those lines, from the documents
    w = _line_words(docs, alike)
    w = w.withColumn("n", F.size("w"))
    each = w.select(
        "doc_id", "line_no", "n",
        # the words are bound once: an outer column in a lambda may be worked out for every element
        F.posexplode(F.expr("transform(array(w), w -> transform(w, (x, i) -> struct(xxhash64(x, i) as l, xxhash64(x, size(w) - i, 3) as r)))[0]")).alias("i", "h"))
    run = W.partitionBy("doc_id", "line_no").orderBy("i")
    upto = run.rowsBetween(W.unboundedPreceding, 0)
    whole = W.partitionBy("doc_id", "line_no")
    runs = each.select(
        "doc_id", "line_no", "n", "i", F.bit_xor("h.l").over(upto).alias("pl"), F.bit_xor("h.r").over(upto).alias("pr"),
        F.bit_xor("h.r").over(whole).alias("tr"), F.col("h.l").alias("l"), F.col("h.r").alias("r"))
    before = F.col("pl").bitwiseXOR(F.col("l"))  # of the words before i
    after = F.col("tr").bitwiseXOR(F.col("pr"))  # of the words after i
    keys = runs.select("doc_id", "line_no", F.explode(F.array(
        F.struct(F.xxhash64(F.col("n") - 1, before, after).alias("k"), F.col("i").alias("i"), F.lit(1).alias("cut")),
        F.struct(F.xxhash64(F.col("n"), before, after.bitwiseXOR(F.col("r"))).alias("k"), F.col("i").alias("i"), F.lit(0).alias("cut")),
        F.struct(F.when(F.col("i") == F.col("n") - 1, F.xxhash64(F.col("n"), F.col("pl"), F.lit(0).cast("long"))).alias("k"), F.col("n").alias("i"), F.lit(0).alias("cut")),
    )).alias("v")).where("v.k is not null").select("doc_id", "line_no", "v.k", "v.i", "v.cut")
    keys = cut(keys)
    lead = cut(keys.groupBy("k").agg(F.min(F.struct("doc_id", "line_no", "i", "cut")).alias("b"), F.count("*").alias("n")).where("n > 1"))
    near = spread_join(keys, lead.select("k", "b"), ["k"], lead.select("k", "n"), ["doc_id", "line_no"]).where("struct(doc_id, line_no) > struct(b.doc_id, b.line_no)")
    near = near.select("doc_id", "line_no", "i", "cut", F.col("b.doc_id").alias("bd"), F.col("b.line_no").alias("bl"), F.col("b.i").alias("bi"), F.col("b.cut").alias("bc"))
    near = near.groupBy("doc_id", "line_no", "bd", "bl").agg(F.min(F.struct("i", "cut", "bi", "bc")).alias("v"))

    def rest(arr, i, gone):
        a = F.col(arr)
        return F.concat(F.slice(a, F.lit(1), F.col(i)), F.slice(a, F.col(i) + 1 + F.col(gone), F.size(a)))

    # only the lines of candidate pairs are fetched again, once
    near = cut(near)
    both = near.select("doc_id", "line_no").unionByName(near.select(F.col("bd").alias("doc_id"), F.col("bl").alias("line_no")))
    wa = cut(_line_words(docs, both))
    wb = wa.select(F.col("doc_id").alias("bd"), F.col("line_no").alias("bl"), F.col("w").alias("wb"))
    sure = near.join(wa, ["doc_id", "line_no"]).join(wb, ["bd", "bl"]).select("doc_id", "line_no", "w", "wb", "v.*")
    sure = sure.where(rest("w", "i", "cut") == rest("wb", "bi", "bc")).select("doc_id", "line_no").distinct()
    kept = firsts.select("at.doc_id", "at.line_no", "n").join(sure.withColumn("near", F.lit(True)), ["doc_id", "line_no"], "left")
    return kept.select("doc_id", "line_no", F.coalesce("near", F.lit(False)).alias("near"))


def dedup_lines(docs: DataFrame, near_words: int = NEAR, least: int = LEAST) -> DataFrame:
    """All columns of ``docs`` with ``text`` without its repeated lines, and n_lines, n_removed.

    Lines end at line feeds and are compared without outer blanks. Lines of fewer than ``least`` characters
    (blank ones) always stay; lines of ``near_words`` or more go also if an earlier one is within one word. Very long texts
    and lines are taken whole. Null texts count as empty, keep none and come back as null.
    A doc_id should be unique: of rows that share one, the lines at equal places share a fate (and with a null id no
    line is removed). An empty table gives no rows. Input columns named n_lines or n_removed are replaced.
    """
    had = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    core = docs.where("doc_id is not null").select("doc_id", F.col("text").cast("string").alias("text"))
    stay = near_lines(core, near_words, least).where("not near").groupBy("doc_id").agg(F.collect_set("line_no").alias("stay"))
    # the input's own columns travel in one struct, whatever their names
    tagged = docs.select("doc_id", F.struct(*had).alias("row")).join(stay, "doc_id", "left")
    # the places that stay and the blank lines, in order; the split text is bound once for both
    whole = F.array(F.struct(F.split(F.col("row.text"), "\n").alias("all"), F.coalesce("stay", F.array().cast("array<int>")).alias("stay")))
    blank = lambda x: F.filter(F.transform(x["all"], lambda t, i: F.when(F.length(F.trim(t)) < least, i).otherwise(-1)), lambda i: i >= 0)
    some = lambda x: F.filter(F.transform(F.array_sort(F.array_union(x["stay"], blank(x))), lambda i: F.get(x["all"], i)), lambda t: t.isNotNull())
    left = lambda x: F.struct(x["all"].alias("lines"), F.when(F.col("doc_id").isNull(), x["all"]).otherwise(some(x)).alias("left"))
    tagged = tagged.withColumn("pair", F.when(F.col("row.text").isNotNull(), F.element_at(F.transform(whole, left), 1))).select("row", "pair.lines", "pair.left")
    size = lambda c: F.when(F.col(c).isNull(), 0).otherwise(F.size(c)).cast("long")
    return tagged.select(
        *[F.array_join("left", "\n").alias("text") if c == "text" else F.col("row")[c].alias(c) for c in had],
        size("lines").alias("n_lines"), (size("lines") - size("left")).alias("n_removed"))
