"""The source audit, the exact-dedup index and the Merkle manifest against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillmark.llm import divergence, exact, merkle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, tree string, bucket long"
TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def rows_of(seed=3, n=140):
    """Sources of very different size, nulls everywhere, repeated rows, a very long text, words that only differ by marks."""
    rng, out = random.Random(seed), []
    pool = [f"{a}{b}" for a in ("the", "Über", "cat", "naïve", "x") for b in "abcdef"]
    forms = ["{}", "{},", "({})", "{}.", "{}-{}", " {}", "{}7"]
    for i in range(n):
        ws = [rng.choice(forms).replace("{}", rng.choice(pool)).replace("x", "X" if rng.random() < 0.3 else "x") for _ in range(rng.randrange(0, 30))]
        text = "".join(w + rng.choice([" ", "\n", "\t ", "  "]) for w in ws)
        out.append((i, text, rng.choice(["en", "en", "de", None]), rng.choice(["a", "a", "a", "b", "c", "ü", "", None]), len(text)))
    out += [(n, None, None, None, None), (n + 1, "", "fr", "only", 0), (n + 2, "one two", "fr", "only", 7), (n + 3, "rare\n" * 20_000, "en", "a", 100_000)]
    out += [(n + 4, "123 !!", "xx", "p", 6), (n + 5, "123", "xx", "q", 3)] + out[:4]
    out += [(None, "no id", "en", "b", 5), (None, "no id", "en", "b", 5), (None, None, "en", None, None)]
    return [(*r, "k", "t", 1) for r in out]


@pytest.fixture(scope="module")
def rows():
    return rows_of()


@pytest.fixture(scope="module")
def table(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


def brute_audit(rows, least, top):
    count, held, groups = defaultdict(Counter), defaultdict(lambda: defaultdict(set)), set()
    for k, (_, text, lang, source, *_) in enumerate(rows):
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        for t in TERM.findall((text or "").translate(LOWER)):
            count[lang, source][t] += 1
            held[lang][t].add(k)
    out = []
    for lang in {g for g, _ in groups}:
        kept = [t for t, d in held[lang].items() if len(d) >= least]
        whole = Counter()
        for g in groups:
            if g[0] == lang:
                whole += count[g]
        def shares(c):
            total = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 2) // (total + 2 * len(kept)) for t in kept}

        q, own = shares(whole), {s: shares(count[lang, s]) for g, s in groups if g == lang}
        gap = lambda x, y: (x - y) ** 2 // (x + y)
        for s, p in own.items():
            parts = {"pair": [(o, sum(gap(p[t], r[t]) for t in kept)) for o, r in own.items() if o != s],
                     "term": [(t, gap(p[t], q[t])) for t in kept if count[lang, s][t] and p[t] > q[t]]}
            for part, items in parts.items():
                items.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, i, v, r) for r, (i, v) in enumerate(items, 1) if part == "pair" or r <= top]
    return sorted(out)


@pytest.mark.parametrize("least, step, shard, block", [(10, 16 << 20, 8192, 48), (4, 300, 3, 2), (1000, 16 << 20, 8192, 48)])
def test_audit(table, rows, least, step, shard, block, monkeypatch):
    monkeypatch.setattr(divergence, "STEP_BYTES", step)
    monkeypatch.setattr(divergence, "SHARD", shard)
    monkeypatch.setattr(divergence, "BLOCK", block)
    got = divergence.audit(table, least, top=5, max_small=0 if step < 1000 else 1000)
    assert got.dtypes == [("lang", "string"), ("source", "string"), ("part", "string"), ("item", "string"), ("value", "bigint"), ("rank", "int")]
    assert sorted(map(tuple, got.collect())) == brute_audit(rows, least, 5)


def test_terms_that_only_several_forms_bring_over_the_bound(spark):
    """No form of the word stands in enough documents; together they do, or do only if documents are counted twice."""
    both = [(i, f"(far{'!' * i} near{'?' * (i % 3)} near{';' * (i % 3)}", "en", "s") for i in range(6)]
    both += [(9, "twin, twin; twin: twin. twin! twin? twin", "en", "s")]
    docs = spark.createDataFrame(both, "doc_id long, text string, lang string, source string")
    for max_small in (0, 1000):
        _, kept = divergence.kept_terms(docs, 6, max_small)
        assert {(r.term, r.n) for r in kept.collect()} == {("far", 6), ("near", 12)}


def test_audit_of_an_empty_table(table):
    assert divergence.audit(table.where("doc_id < -1")).count() == 0


def brute_exact(rows):
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    same = defaultdict(list)
    for r in rows:
        same[norm(r[1])].append(r[0])
    out = []
    for t, ids in same.items():
        keep = min((i for i in ids if i is not None), default=None)
        out += [(i, keep, len(ids), i == keep, hashlib.sha256(t.encode()).hexdigest()) for i in ids]
    return Counter(out)


@pytest.mark.parametrize("bits, capacity, max_small", [(64, 1 << 16, 10**6), (64, 4, 0), (5, 2, 10**6), (1, 1, 0)])
def test_exact_duplicates(table, rows, bits, capacity, max_small):
    """With few key bits, different texts share keys and only their bytes tell them apart."""
    extra = [(500 + k, " ".join(f"w{k % 17}" for _ in range(3)) + (" " if k % 5 else "\t\n"), "en", "a", 9, "k", "t", 1) for k in range(90)]
    docs = table.unionByName(table.sparkSession.createDataFrame(extra, SCHEMA))
    got = exact.exact_duplicates(docs, bits, capacity, max_small)
    assert Counter(map(tuple, got.collect())) == brute_exact([*rows, *extra])


def test_the_index_splits_overfull_buckets(table, rows):
    index, entries = exact.build_index(table, capacity=8)
    found = index.collect()
    assert entries.count() == len(rows) and {r.text_sha256 for r in found} == {x[4] for x in brute_exact(rows)} and len(found) == len({r.text_sha256 for r in found})
    sizes = Counter(r.bucket for r in found)
    assert len(sizes) > 4 and max(sizes.values()) <= 8
    for r in found:  # a bucket's name is a one and the leading bits of its keys
        local = r.bucket.bit_length() - 1
        assert (r.key % (1 << 64)) >> (64 - local) == r.bucket - (1 << local)
    assert len({r.keep_id for r in found if r.keep_id is not None}) == sum(r.keep_id is not None for r in found)


def test_a_chain_of_texts_with_one_key(table):
    index, _ = exact.build_index(table, bits=1, capacity=1)
    links = defaultdict(list)
    for r in index.collect():
        links[r.key].append(r.link)
    assert len(links) == 2 and all(sorted(x) == list(range(len(x))) for x in links.values())


def test_exact_duplicates_of_an_empty_table(table):
    assert exact.exact_duplicates(table.where("doc_id < -1")).count() == 0


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def brute_leaf(r, text):
    one = lambda x: "-" if x is None else f"{len(str(x).encode())}:{x}"
    return sha(*map(one, (r[0], r[3], r[2], r[4], text)))


def path(level, at):
    """Siblings from a node to the root: for each level those before and those after it; and the root."""
    out = []
    while len(level) > 1:
        first = at - at % 3
        out.append((level[first:at], level[at + 1 : first + 3]))
        level, at = [sha(*level[k : k + 3]) for k in range(0, len(level), 3)], at // 3
    return out, level[0]


def brute_manifest(rows):
    trees = defaultdict(list)
    for r in rows:
        odd = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 and r[1] is not None
        trees[r[3]].append((r[0] is not None, r[0] or 0, brute_leaf(r, r[1]), brute_leaf(r, r[1].replace("\n", "") if odd else r[1])))
    order = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    for t in trees.values():
        t.sort()
    tops = [path([x[2] for x in trees[s]], 0)[1] for s in order]
    out = []
    for k, s in enumerate(order):
        above, root = path(tops, k)
        for at, (known, i, leaf, claim) in enumerate(trees[s]):
            inner, sub = path([x[2] for x in trees[s]], at)
            for a, b in inner + above:
                claim = sha(*a, claim, *b)
            out.append((i if known else None, leaf, sub, root, sha(*(h for a, b in inner + above for h in a + b)), claim, claim == root))
    return Counter(out)


@pytest.mark.parametrize("depth", [7, 2, 1])
def test_manifest(table, rows, depth):
    tampered = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(2)) == 0
    shown = F.when(tampered, F.translate("text", "\n", "")).otherwise(F.col("text"))
    got = Counter(map(tuple, merkle.manifest(table, shown, depth).collect()))
    want = brute_manifest(rows)
    assert got == want and 10 < sum(not x[-1] for x in got) < len(rows) - 10


@pytest.mark.parametrize("n", [1, 3, 4, 28])
def test_manifest_of_one_source(spark, n):
    rows = [(2**60 + k, f"text\n{k}", "en", "s", 6) for k in range(n)]
    got = merkle.manifest(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), depth=1)
    trees = brute_manifest(rows)
    assert {x[:5] for x in map(tuple, got.collect())} == {x[:5] for x in trees} and got.where("not verified").count() == 0


def test_manifest_of_an_empty_table(table):
    assert merkle.manifest(table.where("doc_id < -1")).count() == 0


def test_chunks_of_a_step_are_summed_piece_by_piece(monkeypatch):
    """A step counts as its documents do, and goes on in bounded batches, not as one of all its chunks."""
    monkeypatch.setattr(divergence, "OUT_ROWS", 512)
    rng = random.Random(5)
    docs = [(rng.choice("ab"), rng.choice("xyz"), " ".join(f"w{rng.randint(0, 1500)}" for _ in range(rng.randint(0, 60)))) for _ in range(600)]
    whole = pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*docs)], names=["lang", "source", "text"])
    got = list(divergence._count([whole.slice(k, 90) for k in range(0, 600, 90)]))
    n, held = Counter(), Counter()
    for lang, source, text in docs:
        n.update((lang, source, w) for w in text.split())
        held.update({(lang, source, w) for w in text.split()})
    rows = [tuple(r.values()) for b in got for r in b.to_pylist()]
    assert sorted(rows) == sorted((*k, n[k], held[k]) for k in n)
    assert len(got) > 5 and max(b.num_rows for b in got) < 2000 < len(rows)
