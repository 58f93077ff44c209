"""Benchmark decontamination by SimHash over item-sized windows, on built-in functions only.

A text and an item are word sequences (lower-cased runs of letters and digits); both are
compared by their shingles of five words, with multiplicity, wherever these stand. A window as
long as an item that has PERCENT similarity with it holds at least the share of their shingles
that PERCENT requires, so for each item every window start is laid from which a window holds that many
places of the item's shingles; no other window can reach PERCENT. Each window gets
a 64-bit SimHash. Fingerprints are cut into RADIUS + 1 blocks: two within RADIUS
bits agree in a block, so equal blocks of a window and an item whose shingles it holds find them all.
What is within RADIUS is verified by exact weighted-shingle similarity.

RADIUS: at a similarity of 0.8 the expected distance is 9.7 bits with a deviation of 2.9;
RADIUS lies five deviations above.

Scale: the items' shingles and fingerprints are counted first and broadcast while there are at
most MAX_SMALL shingles; beyond that, the same joins shuffle. Texts meet only items with which they share one of
the shingles that fewest items hold (about a fifth of an item's), so wording that many items share
brings nobody together, and a window is compared with such items alone, not with all of its length. Texts are shuffled once, by
doc_id, to meet the windows found in them; while at most MAX_SMALL have any, only those. Windows are few next to the texts: about a fifth of
an item's length for a whole copy of it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quillmark.llm.common import cut

SIZE, PERCENT, RADIUS, BITS = 5, 80, 24, 64
MAX_SMALL = 1_000_000
#: Bounds of the blocks: RADIUS + 1 of two or three bits.
BLOCKS = [(k * BITS // (RADIUS + 1), (k + 1) * BITS // (RADIUS + 1)) for k in range(RADIUS + 1)]
LANES = 0x0001000100010001


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters and digits; a text of ASCII alone needs no Unicode classes."""
    text = F.coalesce(text, F.lit(""))
    plain = F.octet_length(text) == F.char_length(text)
    low = F.lower(text)
    return F.array_remove(F.when(plain, F.split(low, "[^a-z0-9]+")).otherwise(F.split(low, r"[^\p{L}\p{N}]+")), "")


def shingle_rows(rows: DataFrame, w: str, size: int) -> DataFrame:
    """The rows with i and g, for each place the same hash as ``shingles`` has there."""
    sides = F.arrays_zip(*[F.slice(w, F.lit(1 + k), F.size(w)).alias(f"w{k}") for k in range(size)])
    each = rows.select("*", F.posexplode(sides).alias("i", "x")).where(F.col("i") <= F.size(w) - size)
    return each.withColumn("g", F.xxhash64(F.lit(size), *[F.col("x")[f"w{k}"] for k in range(size)])).drop("x")


def shingles(w: str, size: int) -> Column:
    """Hash of every ``size`` consecutive words of the array column; none if it has fewer.

    The words are bound once, as the only element of an array: an outer column inside a lambda
    may be replaced by its expression, and then be worked out for every element.
    """
    rest = "".join(f", get(w, i + {k})" for k in range(1, size))
    return F.expr(f"transform(array({w}), w -> slice(transform(w, (x, i) -> xxhash64({size}, x{rest})), 1, greatest(size(w) - {size - 1}, 0)))[0]")


def simhash(grams: str) -> Column:
    """Majority of each bit over an array column of hashes; 16-bit counters, four to a long."""
    votes = ", ".join(f"aggregate({grams}, 0L, (s, g) -> s + (shiftrightunsigned(g, {k}) & {LANES}L))" for k in range(16))
    bits = " | ".join(f"shiftleft(cast((shiftrightunsigned(v[{k}], {16 * j}) & 65535L) * 2 > size({grams}) as bigint), {16 * j + k})" for j in range(4) for k in range(16))
    # the counters are bound once, as the only element of an array
    return F.expr(f"transform(array(array({votes})), v -> {bits})[0]")


def similarity(a: Column, b: Column) -> Column:
    """Size of the intersection of two arrays as multisets."""
    common = F.array_intersect(a, b)
    plain = (F.size(F.array_distinct(a)) == F.size(a)) | (F.size(F.array_distinct(b)) == F.size(b))
    least = lambda g: F.least(F.size(F.filter(a, lambda x: x == g)), F.size(F.filter(b, lambda x: x == g)))
    return F.when(plain, F.size(common)).otherwise(F.aggregate(common, F.lit(0), lambda s, g: s + least(g)))


def item_shingles(benchmark: DataFrame) -> DataFrame:
    """item_id, n (words), grams and fingerprint of every item with words; short ones are one shingle."""
    items = benchmark.where("item_id is not null").select(F.col("item_id").cast("long").alias("item_id"), tokens(F.col("text").cast("string")).alias("w"))
    items = items.withColumn("n", F.size("w")).where("n > 0")
    grams = F.when(F.col("n") >= SIZE, shingles("w", SIZE))
    for k in range(1, SIZE):
        grams = F.when(F.col("n") == k, shingles("w", k)).otherwise(grams)
    return items.select("item_id", "n", grams.alias("grams")).distinct().withColumn("print", simhash("grams"))


def _marks(items: DataFrame, percent: int) -> DataFrame:
    """item, n, g, rare: the distinct shingles of each item of b; a text that has ``percent`` similarity
    lacks at most b - percent * b / 100 of them, so it holds one of the first so many and one more, taken
    in the order of how few items hold them. These are marked rare."""
    each = items.select("item", "n", F.size("grams").alias("b"), F.posexplode("grams").alias("at", "g"))
    each = each.join(each.groupBy("g").agg(F.count("*").alias("f")), "g")
    place = F.row_number().over(W.partitionBy("item").orderBy("f", "g", "at"))
    each = each.withColumn("rare", place <= F.col("b") - F.ceil(F.lit(percent) * F.col("b") / F.lit(100)) + 1)
    return each.groupBy("item", "n", "g").agg(F.max("rare").alias("rare"))


def _places(rows: DataFrame, items: DataFrame, sizes: list[int], small: bool, percent: int) -> DataFrame:
    """doc_id, starts: the windows (start, of a text of so many words) for each item of which they hold enough shingles.

    Texts meet the items with which they share a rare shingle; only for these are all shared places looked up.
    Of a and b shingles, a pair at ``percent`` shares m >= percent * (a + b) / (100 + percent). The
    windows that hold the j-th to the (j + m - 1)-th hit, but not the one before, start in one range;
    these ranges are disjoint, and together they are all windows of m hits.
    """
    marks = cut(_marks(items, percent))
    hint = F.broadcast if small else lambda x: x
    each = reduce(DataFrame.unionByName, [shingle_rows(rows, "w", k).select("doc_id", "words", "i", "g") for k in sizes])
    seen = cut(each.join(hint(marks.select("g").distinct()), "g", "left_semi"))
    pairs = seen.join(hint(marks.where("rare").select("item", "g")), "g").select("doc_id", "words", "item").distinct()
    held = pairs.join(hint(marks.select("item", "n", "g")), "item")
    hits = held.join(seen, ["doc_id", "words", "g"]).groupBy("doc_id", "words", "item", "n").agg(F.sort_array(F.collect_set("i")).alias("p"))
    k = F.least("n", F.lit(SIZE))
    hits = hits.withColumn("b", F.col("n") - k + 1).withColumn("a", F.least("b", F.col("words") - k + 1))
    hits = hits.withColumn("m", F.greatest(F.lit(1), F.ceil(F.lit(percent) * (F.col("a") + F.col("b")) / F.lit(100 + percent)).cast("int")))
    hits = hits.where(F.size("p") >= F.col("m")).withColumn("last", F.greatest(F.col("words") - F.col("n"), F.lit(0)))
    ranges = F.expr("transform(slice(p, 1, size(p) - m + 1), (x, j) -> struct(greatest(p[j + m - 1] - b + 1, if(j > 0, p[j - 1] + 1, 0), 0) as lo, least(x, last) as hi))")
    starts = F.flatten(F.transform(F.filter(ranges, lambda r: r["lo"] <= r["hi"]), lambda r: F.sequence(r["lo"], r["hi"])))
    found = hits.select("doc_id", "words", "item", "n", starts.alias("at")).where(F.size("at") > 0)
    return found.groupBy("doc_id").agg(F.collect_list(F.struct("words", "item", "n", "at")).alias("starts"))


def windows(docs: DataFrame, items: DataFrame, sizes: list[int], small: bool, percent: int = PERCENT, max_small: int = MAX_SMALL) -> DataFrame:
    """doc_id, item, start, part (shingles), mark (SimHash) of the windows that hold enough shingles of an item."""
    base = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def word_rows(rows):
        return rows.withColumn("w", tokens(F.col("text"))).drop("text").withColumn("words", F.size("w"))

    places = cut(_places(word_rows(base), items, sizes, small, percent))
    if places.count() <= max_small:
        # only the few texts with windows are shuffled
        base = base.join(F.broadcast(places.select("doc_id")), "doc_id", "left_semi")
    found = word_rows(base.join(places, "doc_id")).select("doc_id", "words", "starts", *[shingles("w", k).alias(f"g{k}") for k in sizes]).withColumn("s", F.explode("starts"))
    # texts of one doc_id may differ
    found = found.where(F.col("s.words") == F.col("words")).withColumn("start", F.explode("s.at")).withColumn("n", F.col("s.n"))
    part = F.lit(None).cast("array<long>")
    for k in sizes:
        # a window of n words has n - k + 1 shingles
        part = F.when(F.least("n", F.lit(SIZE)) == k, F.slice(f"g{k}", F.col("start") + 1, F.col("n") - k + 1)).otherwise(part)
    return found.select("doc_id", F.col("s.item").alias("item"), "start", part.alias("part")).distinct().withColumn("mark", simhash("part"))


def leaks(docs: DataFrame, benchmark: DataFrame, percent: int = PERCENT, max_small: int = MAX_SMALL) -> DataFrame:
    """doc_id, item_id, start (word of the best window), shared, total (shingles) of each document
    and benchmark item with a window of 100 * shared >= percent * total.

    Items without words match nothing, nor do null, empty and white-space texts; very long texts are taken whole. Texts shorter than an item
    are compared whole. Rows that repeat are reported once; rows with
    a null doc_id are not reported. Items of equal words are searched once and reported each. Other columns are ignored; empty tables give no rows.
    """
    every = cut(item_shingles(benchmark).withColumn("item", F.xxhash64("n", "grams")))
    items = cut(every.select("item", "n", "grams", "print").distinct())
    facts = items.agg(F.sum(F.size("grams")).alias("n"), F.count("*").alias("items"), F.collect_set(F.least("n", F.lit(SIZE))).alias("sizes")).first()
    sizes, small = sorted(facts.sizes) or [SIZE], (facts.n or 0) <= max_small
    hint = F.broadcast if small else lambda x: x

    def bits(c, a, b):
        return f"(shiftrightunsigned({c}, {a}) & {(1 << (b - a)) - 1}L)"

    def blocks(c):
        each = ", ".join(f"struct({k} as block, {bits(c, a, b)} as value)" for k, (a, b) in enumerate(BLOCKS))
        return F.expr(f"explode(array({each}))").alias("x")

    left = windows(docs, items, sizes, small, percent, max_small)
    left = left.select("*", blocks("mark")).select("doc_id", "item", "start", "part", "mark", "x.*")
    right = items.select("item", "print", blocks("print")).select("item", "print", "x.*")
    right = F.broadcast(right) if facts.items * len(BLOCKS) <= max_small else right
    pairs = left.join(right, ["item", "block", "value"]).withColumn("apart", F.expr("mark ^ print"))
    apart = F.col("apart")
    # a pair that agrees in several blocks is taken at the first of them
    first = F.expr("case " + " ".join(f"when {bits('apart', a, b)} = 0 then {k}" for k, (a, b) in enumerate(BLOCKS)) + " end")
    pairs = pairs.where((F.bit_count(apart) <= RADIUS) & (first == F.col("block"))).select("doc_id", "item", "start", "part")
    sure = pairs.join(hint(items.select("item", "grams")), "item")
    sure = sure.select("doc_id", "item", "start", similarity(F.col("part"), F.col("grams")).alias("shared"), F.size("part").alias("a"), F.size("grams").alias("b"))
    sure = sure.withColumn("total", F.col("a") + F.col("b") - F.col("shared")).where(F.col("shared") * 100 >= F.col("total") * percent)
    # the likest window of each pair, the earlier of equal ones
    likest = F.max(F.struct((F.col("shared") / F.col("total")).alias("q"), (-F.col("start")).alias("back"), "shared", "total")).alias("m")
    best = sure.groupBy("doc_id", "item").agg(likest).join(hint(every.select("item", "item_id")), "item")
    # an item_id may have several texts
    best = best.groupBy("doc_id", "item_id").agg(F.max("m").alias("m"))
    return best.select("doc_id", "item_id", (-F.col("m.back")).cast("long").alias("start"), F.col("m.shared").cast("long").alias("shared"), F.col("m.total").cast("long").alias("total"))


def keep_clean(docs: DataFrame, benchmark: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs`` that leak no benchmark item, unchanged; rows without doc_id are judged by their text."""
    bad = leaks(docs, benchmark, percent).select("doc_id").distinct()
    clean = docs.join(bad, "doc_id", "left_anti").select(*docs.columns)
    nameless = docs.where("doc_id is null").select(F.xxhash64("text").alias("doc_id"), "text").distinct()
    if nameless.isEmpty():
        return clean
    mark = "_mark"
    while mark in docs.columns:
        mark += "_"
    bad = leaks(nameless, benchmark, percent).select(F.col("doc_id").alias(mark)).distinct()
    rest = docs.where("doc_id is null").withColumn(mark, F.xxhash64("text")).join(bad, mark, "left_anti").select(*docs.columns)
    return clean.where("doc_id is not null").unionByName(rest)
