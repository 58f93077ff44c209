"""Near-duplicate documents by HyperMinHash.

Each distinct shingle is hashed once. The first bits of the hash choose one of 256 buckets;
of the least remaining value in a bucket the register keeps the count of leading zeros and
ten mantissa bits. Six registers make a band; documents of like size that agree in a band are
candidates (at a similarity of 0.8 a pair escapes all 42 bands once in 300,000 times).
A collision-corrected Jaccard estimate from the registers discards candidates that are far
from the threshold, the rest are confirmed on their full shingle sets.

Sets of fewer than 128 shingles fill a band with one or two, so that a line they all carry would put
them all in one bucket. They are indexed by their rarest shingles instead: in any one order of all shingles, two sets at
the threshold share one of the first n - 0.8 n + 1 of each. The order goes by how many sets hold a shingle, counted
over all sets in a table of fixed size; any order is exact, this one keeps frequent shingles out of the index.

Scale: identical sets are merged first, so thousands of copies cost one representative.
Inside a band bucket, members are linked to the bucket's least member only (a star). In buckets
that still span several components, the members outside the largest one are then asked
through a member of it, another one in each bucket, and what is open after that is searched
completely, in blocks of bounded size that return joining links only. So no link between different sets is
lost, no task holds a whole bucket, and rows stay in proportion to the members. A text is turned into its set once
for each of these steps, however many pairs it is in; ids in many pairs are dealt over tasks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmark.llm.common import cut, grams, hash_words, mix, signed, slices, small_batches, split_words, spread_join
from quillmark.llm.components import components

BUCKET_BITS, MANTISSA_BITS, BAND = 8, 10, 6
BUCKETS = 1 << BUCKET_BITS
BANDS = BUCKETS // BAND
#: What is kept of a bucket's member: its place in the list of its bands, the bucket's size class and its own lower one.
MEMBER = ("doc_id", "n_shingles", "pos", "class", "low")
#: Standard errors below the threshold at which an estimate still counts as a candidate.
SLACK = 4.0
#: Four-bit cells of the brief word pair.
CELLS = 32
#: Largest size class (power of two) that goes by rarest shingles, and the sizes below it.
SMALL_CLASS = 6
SMALL = 1 << (SMALL_CLASS + 1)
#: Bits of the table of shingle counts, one byte a cell (1 MB).
CELL_BITS = 20
#: Ids that a semi-join broadcasts at most (about 24 bytes each in a task's table); beyond it shuffles.
MAX_IDS = 2_000_000
#: Rows and shingles of a bucket that one block holds, about; hashes that a step of counting takes.
BLOCK, SET_BLOCK, COLUMNS = 1024, 2_000_000, 4096


def shingle_sets(text: pa.Array, size: int) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's word shingles; shorter texts are one shingle."""
    flat, at = split_words(text, lower=True)
    h = hash_words(flat)
    g = grams(h, size)
    out = []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
        if b - a >= size:
            out.append(np.unique(g[a : b - size + 1]))
        elif b > a:
            out.append(mix(grams(h[a:b], b - a) + np.uint64(b - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def registers(sets: list[np.ndarray]) -> np.ndarray:
    """One row of 256 registers for each set; 0 marks an empty bucket."""
    starts = np.arange(BUCKETS, dtype=np.uint64) << np.uint64(64 - BUCKET_BITS)
    rest = np.zeros((len(sets), BUCKETS), np.uint64)
    for row, s in zip(rest, sets):
        if len(s):
            k = np.searchsorted(s, starts)  # the first hash of a bucket is its least
            got = s[np.minimum(k, len(s) - 1)]
            mine = (k < len(s)) & ((got >> np.uint64(64 - BUCKET_BITS)) == np.arange(BUCKETS, dtype=np.uint64))
            row[mine] = (got[mine] << np.uint64(BUCKET_BITS)) | np.uint64(1 << (BUCKET_BITS - 1))
    full = rest > 0
    top = np.frexp(rest.astype(np.float64))[1].clip(1, 64)  # place of the highest bit
    zeros = 64 - top
    shift = (top - 1 - MANTISSA_BITS)
    low = np.where(shift >= 0, rest >> shift.clip(0).astype(np.uint64), rest << (-shift).clip(0).astype(np.uint64))
    mantissa = low & np.uint64((1 << MANTISSA_BITS) - 1)
    code = ((zeros + 1).astype(np.uint64) << np.uint64(MANTISSA_BITS)) | mantissa
    return np.where(full, code, 0).astype(np.uint16)


def band_keys(reg: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A key for each band, and which bands hold anything."""
    parts = reg[:, : BANDS * BAND].reshape(len(reg), BANDS, BAND)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), (len(reg), BANDS))
    for k in range(BAND):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, k])
    return key, parts.any(-1)


def brief(reg: np.ndarray) -> np.ndarray:
    """Two 64-bit words of 16 cells each: the least register of each eight, its mantissa reduced to 1 .. 15; 0 for none.
    Eight registers to a cell, so that those of short texts are not all empty."""
    mask = (1 << MANTISSA_BITS) - 1
    order = np.where(reg > 0, (reg.astype(np.int64) | mask) - (reg & mask), 0).reshape(len(reg), CELLS, -1).max(-1)
    cells = np.where(order > 0, (mask - (order & mask)) % 15 + 1, 0).astype(np.uint64).reshape(-1, 2, 16)
    return np.bitwise_or.reduce(cells << np.arange(0, 64, 4, dtype=np.uint64), axis=2)


def brief_limit(used, percent: int):
    """Cells of those used by either in which the words of sets at the threshold differ, and SLACK deviations more."""
    p = 1 - percent / 100
    return used * p + SLACK * (used * (p * (1 - p))) ** 0.5


def brief_alike(a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """Whether the brief word pairs (last axis) of two broadcast arrays are as like as the threshold asks."""
    def cells(x):
        x = x | (x >> np.uint64(2))
        return np.bitwise_count((x | (x >> np.uint64(1))) & np.uint64(0x1111111111111111)).sum(-1, dtype=np.int64)

    return cells(a ^ b) <= brief_limit(cells(a | b), percent)


def jaccard_estimate(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Estimated Jaccard similarity of register rows, and how many registers it rests on.

    Two different minima share a register with probability of about
    0.72 * 2**-mantissa * xy / (x + y)**2 for set sizes x and y; that share is taken off.
    """
    used = ((a != 0) | (b != 0)).sum(-1)
    same = ((a == b) & (a != 0)).sum(-1)
    chance = 0.72 / (1 << MANTISSA_BITS) * na * nb / np.maximum(na + nb, 1) ** 2.0
    return (same / np.maximum(used, 1) - chance) / (1 - chance), used


def likely(a, b, na, nb, percent: int) -> np.ndarray:
    t = percent / 100
    est, used = jaccard_estimate(a, b, na, nb)
    return est >= t - SLACK * np.sqrt(t * (1 - t) / np.maximum(used, 1))


def signatures(docs: DataFrame, size: int = 4) -> DataFrame:
    """doc_id, n_shingles, two checksums of the set, registers and band keys of every row, and the hashes of small sets."""
    small_batches(docs.sparkSession)

    def work(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                sets = shingle_sets(part.column("text"), size)
                reg = registers(sets)
                keys, full = band_keys(reg)
                sums = [(s.sum(dtype=np.uint64), mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)) for s in sets]
                pair = np.array(sums, np.uint64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array(signed(pair[:, 0])),
                        pa.array(signed(pair[:, 1])),
                        pa.array([r.tobytes() for r in reg], pa.binary()),
                        *(pa.array(signed(w)) for w in np.ascontiguousarray(brief(reg).T)),
                        pa.array([signed(k[f]) for k, f in zip(keys, full)], pa.list_(pa.int64())),
                        pa.array([signed(s) if len(s) < SMALL else None for s in sets], pa.list_(pa.int64())),
                    ],
                    names=["doc_id", "n_shingles", "sum_a", "sum_b", "reg", "w0", "w1", "bands", "few"],
                )

    schema = "doc_id long, n_shingles long, sum_a long, sum_b long, reg binary, w0 long, w1 long, bands array<long>, few array<long>"
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(work, schema)


def rarity(small: DataFrame) -> np.ndarray:
    """How frequent the shingles of each cell of the count table are, in quarter powers of two."""
    cell = F.col("h").bitwiseAND((1 << CELL_BITS) - 1).alias("cell")
    counts = small.select(F.explode("few").alias("h")).groupBy(cell).agg(F.count("*").alias("n")).toArrow()
    out = np.zeros(1 << CELL_BITS, np.uint8)
    out[counts.column("cell").to_numpy()] = (4 * np.log2(counts.column("n").to_numpy())).clip(0, 255)
    return out


def rarest(small: DataFrame, percent: int) -> DataFrame:
    """doc_id, n_shingles, shingle: the rarest of each set, of which a set at the threshold holds one at least."""
    rank = rarity(small)

    def work(batches):
        for t in batches:
            n = t.column("n_shingles").to_numpy()
            flat = t.column("few").flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            owner = np.repeat(np.arange(len(n)), n)
            order = np.lexsort((flat, rank[flat & np.uint64((1 << CELL_BITS) - 1)], owner))
            place = np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)
            first = place < (n - (percent * n + 99) // 100 + 1)[owner]
            yield pa.RecordBatch.from_arrays(
                [t.column("doc_id").take(pa.array(owner[first])), pa.array(n[owner[first]]), pa.array(signed(flat[order[first]]))],
                names=["doc_id", "n_shingles", "shingle"])

    return small.select("doc_id", "n_shingles", "few").mapInArrow(work, "doc_id long, n_shingles long, shingle long")


def bucket_rows(sig: DataFrame, percent: int) -> DataFrame:
    """key and MEMBER of every bucket a set is in: bands, and the rarest shingles of small sets, whose pos is -1.

    A set is up to 100 / percent times as large as its partner: it stands under its own power of
    two and that of its largest partner, so a pair meets under the larger one's.
    """
    power = lambda n: F.floor(F.log2(n)).cast("int")
    spread = F.array_distinct(F.array(power(F.col("n_shingles")), power(F.col("n_shingles") * (100 / percent) + 1)))
    low = power(F.col("n_shingles")).alias("low")
    bands = sig.select("doc_id", "n_shingles", low, "bands", F.explode(F.filter(spread, lambda c: c > SMALL_CLASS)).alias("class"))
    bands = bands.select("doc_id", "n_shingles", "low", "class", F.posexplode("bands").alias("pos", "band"))
    bands = bands.select(F.xxhash64("band", "class").alias("key"), *MEMBER)
    small = rarest(sig.where("few is not null"), percent)
    small = small.select("doc_id", "n_shingles", low, "shingle", F.lit(-1).alias("pos"), F.explode(F.filter(spread, lambda c: c <= SMALL_CLASS)).alias("class"))
    return bands.unionByName(small.select(F.xxhash64("shingle", "class", F.lit("rare")).alias("key"), *MEMBER))


def _with(pairs: DataFrame, side: str, table: DataFrame) -> DataFrame:
    """The pairs with the columns of ``table``, by its column ``side``; ids in many pairs are dealt over several tasks."""
    counts = pairs.groupBy(side).agg(F.count("*").alias("n"))
    return spread_join(pairs, table, [side], counts, ["a", "b"])


def _ends(pairs: DataFrame) -> DataFrame:
    """The ids in pairs a, b."""
    return pairs.select(F.col("a").alias("doc_id")).unionByName(pairs.select(F.col("b").alias("doc_id"))).distinct()


def _only(table: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of these distinct ids, without a shuffle of the table where there are at most MAX_IDS."""
    hint = F.broadcast if ids.count() <= MAX_IDS else lambda x: x
    return table.join(hint(ids), "doc_id", "left_semi")


def _probable(pairs: DataFrame, sig: DataFrame, percent: int) -> DataFrame:
    """Pairs a, b whose register estimate is not clearly below the threshold; their brief words are
    compared first, so that registers are shipped for few accidental pairs."""
    word = lambda side: sig.select(F.col("doc_id").alias(side), *[F.col(f"w{k}").alias(f"{side}{k}") for k in (0, 1)])

    def cells(how):
        x = [f"(a{k} {how} b{k})" for k in (0, 1)]
        x = [f"({w} | shiftrightunsigned({w}, 2))" for w in x]
        return F.expr(" + ".join(f"bit_count(({w} | shiftrightunsigned({w}, 1)) & 1229782938247303441L)" for w in x))

    used = cells("|")
    alike = cells("^") <= used * (1 - percent / 100) + SLACK * F.sqrt(used * (percent / 100 * (1 - percent / 100)))
    pairs = cut(_with(_with(pairs, "a", word("a")), "b", word("b")).where(alike).select("a", "b").distinct())
    sig = _only(sig, _ends(pairs))
    one = sig.select(F.col("doc_id").alias("a"), F.col("reg").alias("ra"), F.col("n_shingles").alias("na"))
    two = sig.select(F.col("doc_id").alias("b"), F.col("reg").alias("rb"), F.col("n_shingles").alias("nb"))

    def work(batches):
        for t in batches:
            if t.num_rows:
                ra, rb = (np.frombuffer(b"".join(t.column(c).to_pylist()), np.uint16).reshape(-1, BUCKETS) for c in ("ra", "rb"))
                na, nb = (t.column(c).to_numpy().astype(float) for c in ("na", "nb"))
                yield t.filter(pa.array(likely(ra, rb, na, nb, percent))).select(["a", "b"])

    return _with(_with(pairs, "a", one), "b", two).mapInArrow(work, "a long, b long").distinct()


def _sets(docs: DataFrame, ids: DataFrame, size: int) -> DataFrame:
    """doc_id and the packed shingle hashes of the texts of these ids; each text is read once."""

    def work(batches):
        for batch in batches:
            for t in slices(batch, "text"):
                sets = pa.array([s.tobytes() for s in shingle_sets(t.column("text"), size)], pa.binary())
                yield pa.RecordBatch.from_arrays([t.column("doc_id"), sets], names=["doc_id", "set"])

    return _only(docs, ids).mapInArrow(work, "doc_id long, set binary")


def confirm(pairs: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """Pairs a, b whose full sets have 100 * intersection >= percent * union."""
    pairs = cut(pairs)
    sets = cut(_sets(docs, _ends(pairs), size))

    def work(batches):
        for batch in batches:
            for t in slices(batch, "sb"):
                ok = []
                for x, y in zip(t.column("sa"), t.column("sb")):
                    one, two = (np.frombuffer(z.as_buffer(), np.uint64) for z in (x, y))
                    both = len(one) + len(two) - len(np.unique(np.concatenate([one, two])))
                    ok.append(both > 0 and 100 * both >= percent * (len(one) + len(two) - both))
                yield t.filter(pa.array(ok, pa.bool_())).select(["a", "b"])

    full = _with(_with(pairs, "a", sets.toDF("a", "sa")), "b", sets.toDF("b", "sb"))
    return full.select("a", "b", "sa", "sb").mapInArrow(work, "a long, b long").distinct()


def _open(buckets: DataFrame, comp: DataFrame) -> DataFrame:
    """The rows of buckets that span several components: key, doc_id, component, n_shingles, and
    of the bucket major (its largest component), hub (a member of it, another one in each bucket)
    and sizes."""
    at = buckets.join(comp, "doc_id")
    each = at.groupBy("key", "component").agg(
        F.count("*").alias("n"), F.sum("n_shingles").alias("weight"), F.min(F.struct(F.xxhash64("key", "doc_id").alias("h"), "doc_id")).alias("first"))
    spans = each.groupBy("key").agg(
        F.count("*").alias("parts"), F.sum("n").alias("n_all"), F.sum("weight").alias("weight"),
        F.max(F.struct("n", "component", "first")).alias("big"))
    spans = cut(spans.where("parts > 1").select(
        "key", "n_all", "weight", F.col("big.n").alias("n_major"), F.col("big.component").alias("major"), F.col("big.first.doc_id").alias("hub")))
    return cut(spread_join(at, spans, ["key"], spans.select("key", F.col("n_all").alias("n")), ["doc_id"]))


def _hub_pairs(rows: DataFrame) -> DataFrame:
    """In each open bucket, the pairs of its hub with the members outside the hub's component."""
    return rows.where("component <> major").select(F.least("hub", "doc_id").alias("a"), F.greatest("hub", "doc_id").alias("b")).where("a <> b").distinct()


def spanning_links(ids, component, asks, told, sets, percent: int) -> list[tuple[int, int]]:
    """Links of sets with 100 * intersection >= percent * union between the rows ``asks`` and
    ``told`` that join components: as few as joins them all, none inside a component."""
    sizes = np.array([len(s) for s in sets], np.int64)
    owner = np.repeat(np.arange(len(sets)), sizes)
    _, code, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner, code = owner[times[code] > 1], code[times[code] > 1]  # a hash of one set alone is in no intersection
    order = np.argsort(code, kind="stable")
    owner, code = owner[order], code[order]
    code = np.cumsum(np.concatenate([[0], code[1:] != code[:-1]])) if len(code) else code
    both = np.zeros((len(asks), len(told)), np.float32)
    for low in range(0, int(code[-1]) + 1 if len(code) else 0, COLUMNS):
        a, b = np.searchsorted(code, [low, low + COLUMNS])
        held = np.zeros((len(sets), COLUMNS), np.float32)
        held[owner[a:b], code[a:b] - low] = 1
        both += held[asks] @ held[told].T
    linked = (both > 0) & (100 * both >= percent * (sizes[asks][:, None] + sizes[told][None, :] - both))
    label = np.unique(component, return_inverse=True)[1]
    found = []
    while True:
        free = linked & (label[asks][:, None] != label[told][None, :])
        rows = np.flatnonzero(free.any(1))
        if not len(rows):
            return found
        # one link for each component that still has one, then the components are named anew
        to = np.arange(label.max() + 1)

        def root(x):
            while to[x] != x:
                to[x] = to[to[x]]
                x = to[x]
            return x

        for i, j in zip(asks[rows], told[free[rows].argmax(1)]):
            x, y = root(label[i]), root(label[j])
            if x != y:
                to[max(x, y)] = min(x, y)
                found.append((min(ids[i], ids[j]), max(ids[i], ids[j])))
        label = np.array([root(x) for x in range(len(to))])[label]


def _block_links(rows: DataFrame, sig: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """Links between components inside buckets that still span several, searched completely.

    Every member outside the largest component of its bucket meets all members of other
    components, block by block: first by brief words, then by registers, then those with a likely
    partner by their full sets. A block of either side has about BLOCK rows and SET_BLOCK shingles, and returns
    only the links that join components.
    """
    blocks = lambda n: F.ceil(F.greatest(n / F.lit(BLOCK), F.col("weight") * n / F.col("n_all") / F.lit(SET_BLOCK))).cast("int")
    rows = rows.select("key", "doc_id", "pos", "class", "low", "component", (F.col("component") != F.col("major")).alias("few"), blocks(F.col("n_all")).alias("all_blocks"), blocks(F.col("n_all") - F.col("n_major")).alias("few_blocks"))
    # a bucket of one block is one group; of more, each few-block meets each block
    h = F.xxhash64("doc_id", F.lit(7))
    mine, other = F.pmod(h, "few_blocks").cast("int"), F.pmod(h, "all_blocks").cast("int")
    spot = lambda x, y, few: F.struct(x.alias("x"), y.alias("y"), few.alias("asks"), (~few).alias("told"))
    told = F.transform(F.sequence(F.lit(0), F.col("few_blocks") - 1), lambda x: spot(x, other, F.lit(False)))
    asks = F.transform(F.sequence(F.lit(0), F.col("all_blocks") - 1), lambda y: spot(mine, y, F.lit(True)))
    one = F.array(F.struct(F.lit(0).alias("x"), F.lit(0).alias("y"), F.col("few").alias("asks"), F.lit(True).alias("told")))
    at_once = (F.col("all_blocks") == 1) & (F.col("few_blocks") == 1)
    spots = F.when(at_once, one).when(F.col("few"), F.concat(told, asks)).otherwise(told)
    dealt = rows.select("key", "doc_id", "pos", "class", "low", "component", F.explode(spots).alias("s")).select("key", "s.*", "doc_id", "pos", "class", "low", "component")
    together = lambda df: df.repartition("key", "x", "y").sortWithinPartitions("key", "x", "y")

    def glance(t, c, asks, told):
        """The rows of a block that have a partner with a like brief word in another component."""
        hit, step = np.zeros(t.num_rows, bool), max(1, (1 << 19) // len(told))
        words = np.stack([c["w0"], c["w1"]], 1).view(np.uint64)
        for q in range(0, len(asks), step):
            ok = brief_alike(words[asks[q : q + step]][:, None], words[told][None, :], percent)
            ok &= c["component"][asks[q : q + step]][:, None] != c["component"][told][None, :]
            hit[asks[q : q + step][ok.any(1)]] = hit[told[ok.any(0)]] = True
        return t.drop_columns(["w0", "w1"]).filter(pa.array(hit))

    def ask(t, c, asks, told):
        """The rows of a block that have a likely partner in another component, by their registers.
        A pair counts in the first band that both share (in any of their rare shingles), and there in the lower class."""
        reg = np.frombuffer(b"".join(t.column("reg").to_pylist()), np.uint16).reshape(-1, BUCKETS)
        hit, n, step = np.zeros(t.num_rows, bool), c["n_shingles"].astype(float), max(1, 8192 // len(told))
        keys, full = band_keys(reg)
        place = np.cumsum(full, 1) - 1
        for q in range(0, len(asks), step):
            i, j = (m.ravel() for m in np.meshgrid(asks[q : q + step], told, indexing="ij"))
            ok = c["component"][i] != c["component"][j]
            i, j = i[ok], j[ok]
            ok = likely(reg[i], reg[j], n[i], n[j], percent)
            i, j = i[ok], j[ok]
            band = ((keys[i] == keys[j]) & full[i] & full[j]).argmax(1)
            ok = ((c["pos"][i] < 0) | (place[i, band] == c["pos"][i])) & (c["class"][i] == np.maximum(c["low"][i], c["low"][j]))
            hit[i[ok]] = hit[j[ok]] = True
        return t.select(["key", "x", "y", "asks", "told", "doc_id", "component"]).filter(pa.array(hit))

    def link(t, c, asks, told):
        sets = [np.frombuffer(x, np.uint64) for x in t.column("set").to_pylist()]
        out = np.array(spanning_links(c["doc_id"], c["component"], asks, told, sets, percent), np.int64).reshape(-1, 2)
        return pa.table({"a": out[:, 0], "b": out[:, 1]})

    place = "key long, x int, y int, asks boolean, told boolean, doc_id long, pos int, class int, low int, component long"
    dealt = dealt.join(sig.select("doc_id", "w0", "w1"), "doc_id").select("key", "x", "y", "asks", "told", "doc_id", "pos", "class", "low", "component", "w0", "w1")
    dealt = cut(together(dealt).mapInArrow(_block_by_block(glance), place))
    prints = _only(sig.select("doc_id", "reg", "n_shingles"), dealt.select("doc_id").distinct())
    open_rows = cut(together(dealt.join(prints, "doc_id")).mapInArrow(_block_by_block(ask), "key long, x int, y int, asks boolean, told boolean, doc_id long, component long"))
    sets = _sets(docs, open_rows.select("doc_id").distinct(), size)
    return together(open_rows.join(sets, "doc_id")).mapInArrow(_block_by_block(link), "a long, b long").distinct()


def _block_by_block(meet):
    """Rows sorted by key, x, y are gathered block by block and given to ``meet``."""

    def each(t: pa.Table, k: np.ndarray):
        ends = [0, *(np.flatnonzero((k[1:] != k[:-1]).any(1)) + 1).tolist(), len(k)]
        for a, b in zip(ends, ends[1:]):
            part = t.slice(a, b - a)
            c = {n: part.column(n).to_numpy() for n in part.column_names if n not in ("reg", "set")}
            asks, told = np.flatnonzero(c["asks"]), np.flatnonzero(c["told"])
            if len(asks) and len(told):
                yield from meet(part, c, asks, told).to_batches()

    def stream(batches):
        held = None
        for batch in batches:
            t = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            if t.num_rows:
                k = np.stack([t.column(n).to_numpy() for n in ("key", "x", "y")], 1)
                other = np.flatnonzero((k != k[-1]).any(1))
                last = int(other[-1] + 1) if len(other) else 0
                yield from each(t.slice(0, last), k[:last]) if last else ()
                held = t.slice(last)  # its block may go on
        if held is not None and held.num_rows:
            yield from each(held, np.stack([held.column(n).to_numpy() for n in ("key", "x", "y")], 1))

    return stream


def near_duplicates(docs: DataFrame, size: int = 4, percent: int = 80) -> DataFrame:
    """Groups documents whose word-shingle sets have a Jaccard similarity of percent/100 or more.

    Returns doc_id, n_shingles, component_id (least doc_id reachable), kept
    (doc_id = component_id), one row per input row. Null, empty and white-space texts have an
    empty set and link with nothing; very long texts are compared whole. Rows that repeat a doc_id share a component; of rows
    with equal id all are kept or none. A null doc_id links with nothing: its component_id is
    null and it is kept. Other columns are ignored; an empty table gives no rows. Sets are held to be equal if
    their sizes and two 64-bit checksums of their 64-bit hashes are (two sets of equal size differ
    from that with a probability of 2**-128).
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = cut(signatures(docs, size))
    key = ["n_shingles", "sum_a", "sum_b"]
    real = rows.where("n_shingles > 0 and doc_id is not null")
    # an id with several texts stands for all of them, under its least set
    sig = cut(
        real.groupBy(*key).agg(F.min(F.struct("doc_id", "reg", "w0", "w1", "bands", "few")).alias("m"), F.count("*").alias("n"))
        .select(F.col("m.doc_id").alias("doc_id"), *key, "m.reg", "m.w0", "m.w1", "m.bands", "m.few", "n"))
    classes = sig.select(*key, F.col("doc_id").alias("rep"), "n")
    bands = bucket_rows(sig, percent)
    hubs = bands.groupBy("key").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("z"), F.count("*").alias("n")).where("a < z").select("key", "a", "n")
    hubs = cut(hubs)
    buckets = cut(spread_join(bands, hubs.drop("n"), ["key"], hubs.select("key", "n"), ["doc_id"]))
    star = buckets.where("doc_id <> a").select("a", F.col("doc_id").alias("b")).distinct()
    buckets = buckets.where("doc_id <> a").select("key", *MEMBER)  # the least member has met all others
    texts = docs.where("doc_id is not null")
    # ids that stand for several sets tie those sets' classes together
    repeated = real.groupBy("doc_id").agg(F.min("sum_a").alias("lo"), F.max("sum_a").alias("hi")).where("lo <> hi").select("doc_id")
    tied = real.select("doc_id", *key).join(repeated, "doc_id", "left_semi").join(classes, key).select(F.col("rep").alias("a"), F.col("doc_id").alias("b"))
    links = confirm(_probable(cut(star), sig, percent), texts, size, percent).unionByName(tied)
    ids = cut(sig.select("doc_id").distinct())

    def settle(links):
        found = components(links)
        return found, cut(ids.join(found.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("doc_id", F.coalesce("component", "doc_id").alias("component")))

    # buckets that still span several components are asked through hubs of their largest one, then completely
    found, comp = settle(links)
    for complete in (False, True):
        rest = _open(buckets, comp)
        if rest.isEmpty():
            break
        more = cut(_block_links(rest, sig, texts, size, percent) if complete else confirm(_probable(cut(_hub_pairs(rest)), sig, percent), texts, size, percent))
        buckets = rest.where("doc_id <> hub").select("key", *MEMBER)  # the hub has met all others
        if not more.isEmpty():
            held = comp.where("doc_id <> component").select(F.col("doc_id").alias("a"), F.col("component").alias("b"))
            found, comp = settle(held.unionByName(more).unionByName(tied))
    named = cut(classes.join(found.withColumnRenamed("node", "rep"), "rep", "left").select(*key, F.coalesce("component", "rep").alias("least"), "n"))
    out = spread_join(rows.select("doc_id", *key), named.drop("n"), key, named.select(*key, "n"), ["doc_id"], "left")
    out = out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("least", "doc_id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def keep_one(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """The documents without near copies: of each group the least doc_id stays."""
    drop = near_duplicates(docs, size, percent).where("not kept").select("doc_id").distinct()
    return docs.join(drop, "doc_id", "left_anti").select(*docs.columns)
