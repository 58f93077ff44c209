"""Every operator against brute force on a small corpus, and its null, empty, tied and repeated cases."""

import hashlib
import math
import random
import re
import time
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillmark.llm import chat, decontaminate, fingerprints, lines, minhash, mixing, passages, pii, quality, urls
from quillmark.llm.common import grams, hash_words, split_words, spread_join
from quillmark.llm.components import components
from quillmark.llm.fmindex import FmIndex

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(t):
    return t.translate({c: c + 32 for c in range(65, 91)})


def sets_of(rows, size):
    out = {}
    for i, t in rows:
        w = WORD.findall(lower(t or ""))
        out[i] = {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())
    return out


def groups(nodes, links):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def brute_groups(rows, size, percent):
    s = sets_of(rows, size)
    ids = sorted(s)
    return s, groups(ids, [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if s[a] & s[b] and 100 * len(s[a] & s[b]) >= percent * len(s[a] | s[b])])


def test_words_split_as_the_pattern_does():
    t = "a\x0bb\x0cc\x1cd e\u00a0f\r\n g"
    flat, at = split_words(pa.array([t, None, "", "  "]))
    assert flat.to_pylist() == WORD.findall(t) and at.tolist() == [0, 5, 5, 5, 5]


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000 + k, 1001 + k) for k in range(40)] + [(5, None), (7, 7)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    real = [(a, b) for a, b in edges if b is not None and a != b]
    want = groups({x for e in real for x in e}, real)
    assert got == want


@pytest.mark.parametrize("size", [4, 5])
def test_near_duplicates(docs, corpus, size):
    s, want = brute_groups(corpus, size, 80)
    got = {r.doc_id: r for r in minhash.near_duplicates(docs, size).collect()}
    assert {i: (len(s[i]), want[i], want[i] == i) for i in want} == {i: (r.n_shingles, r.component_id, r.kept) for i, r in got.items()}


@pytest.mark.parametrize("block", [8, 1024])
def test_near_duplicates_of_a_large_group_of_near_copies(spark, block, monkeypatch):
    """Copies whose edits differ, some beyond the threshold from the first: the open search finds their links."""
    monkeypatch.setattr(minhash, "BLOCK", block)
    rng = random.Random(3)
    base = [f"w{k}" for k in range(120)]
    rows = []
    for i in range(150):
        w = list(base)
        for _ in range(rng.randrange(1, 5)):
            w[rng.randrange(120)] = f"x{i}y{rng.randrange(99)}"
        rows.append((i, " ".join(w)))
    _, want = brute_groups(rows, 4, 80)
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 4).collect()}
    assert got == want


def test_spanning_links_join_what_links_join():
    """Chains and cliques of sets: as many links as components joined, and the same components as all pairs give."""
    rng = random.Random(11)
    for _ in range(30):
        sets, at = [], set(range(40))
        for k in range(25):
            at = set(range(1000 * k, 1000 * k + 40)) if rng.random() < 0.3 else (at - set(rng.sample(sorted(at), 3))) | {5000 + 97 * k + i for i in range(3)}
            sets.append(np.array(sorted(at), np.uint64))
        comp = np.array([rng.randrange(25) for _ in sets])
        asks = np.array([i for i in range(25) if rng.random() < 0.6] or [0])
        told = np.arange(25)
        got = minhash.spanning_links(np.arange(25), comp, asks, told, sets, 80)
        pairs = [(i, j) for i in asks.tolist() for j in told.tolist() if 100 * len(np.intersect1d(sets[i], sets[j])) >= 80 * len(np.union1d(sets[i], sets[j]))]
        old = [(i, int(np.flatnonzero(comp == comp[i])[0])) for i in range(25)]
        assert groups(range(25), old + [(int(a), int(b)) for a, b in got]) == groups(range(25), old + pairs)
        assert len(got) == len(set(groups(range(25), old).values())) - len(set(groups(range(25), old + pairs).values()))


def test_hot_keys_are_dealt_out(spark):
    left = spark.createDataFrame([(1 if i % 3 else i, i) for i in range(300)], "k long, i long")
    right = spark.createDataFrame([(i, 2 * i) for i in range(200)], "k long, v long")
    counts = left.groupBy("k").agg(F.count("*").alias("n"))
    for how in ("inner", "left"):
        want = sorted(left.join(right, "k", how).collect(), key=str)
        assert sorted(spread_join(left, right, ["k"], counts, ["i"], how, least=10).collect(), key=str) == want


def test_bands_find_pairs_at_the_threshold():
    """Sets at a similarity of 0.8 share a band: all of 400 pairs."""
    rng = np.random.default_rng(4)
    for _ in range(20):
        sets = []
        for _ in range(20):
            h = np.unique(rng.integers(0, 2**63, 1000).astype(np.uint64) * np.uint64(2))
            sets += [h[:900], np.concatenate([h[100:900], h[900:1000]])]
        key, full = minhash.band_keys(minhash.registers([np.sort(x) for x in sets]))
        assert all(((key[k] == key[k + 1]) & full[k]).any() for k in range(0, len(sets), 2))


def test_small_sets_share_a_rare_shingle(spark):
    """Every pair of small sets at 0.8 or more meets under one key; texts that share one shingle alone do not crowd it."""
    rng = random.Random(8)
    for copies in (300, 600):  # a shared line of four words is one shingle of all
        rows = [(i, " ".join([f"a{i}", f"b{i}", f"c{i}", "all", "rights", "are", "reserved"][: 7 if i % 2 else 5 + i % 3])) for i in range(copies)]
        rows = [(i, t + " all rights are reserved") for i, t in rows]
        sig = minhash.signatures(spark.createDataFrame(rows, "doc_id long, text string"))
        keys = minhash.bucket_rows(sig.where("n_shingles > 0"), 80)
        assert keys.groupBy("key").count().agg(F.max("count")).first()[0] <= 2
        assert keys.count() <= 6 * copies
    rows = []
    for k in range(60):
        base = [f"w{rng.randrange(40)}" for _ in range(rng.randrange(6, 120))]
        rows.append((2 * k, " ".join(base)))
        base[rng.choice([0, -1, rng.randrange(len(base))])] = "edit"
        rows.append((2 * k + 1, " ".join(base[rng.randrange(2) :])))
    sets, _ = brute_groups(rows, 4, 80)
    sig = minhash.signatures(spark.createDataFrame(rows, "doc_id long, text string"))
    held = {}
    for r in minhash.bucket_rows(sig.where("n_shingles > 0"), 80).collect():
        held.setdefault(r.doc_id, set()).add((r.key))
    near = [(i, j) for i in sets for j in sets if i < j and sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    assert len(near) > 20 and all(held[i] & held[j] for i, j in near)


@pytest.mark.parametrize("n", [6, 40, 300])
def test_brief_words_part_short_texts_too(n):
    rng = np.random.default_rng(n)
    draw = lambda k: rng.integers(0, 1 << 63, k, dtype=np.uint64) * np.uint64(2)
    shared, near, far = round(n * 8 / 9) + 1, [], []
    for _ in range(400):
        base = draw(n)
        near.append((base, np.concatenate([base[:shared], draw(n - shared)])))  # a similarity of 0.8 or more
        far.append((base, draw(n)))
    words = lambda sets: minhash.brief(minhash.registers([np.unique(s) for s in sets]))
    alike = lambda pairs: minhash.brief_alike(words([a for a, _ in pairs]), words([b for _, b in pairs]), 80)
    assert alike(near).mean() >= 0.995
    assert n < 40 or alike(far).mean() <= 0.01


def test_near_duplicates_edge_rows(spark, nothing):
    rows = [(1, "a b c d e"), (1, "a b c d e"), (None, "a b c d e"), (2, "a b c d e"), (3, None)]
    out = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").withColumn("component", F.lit("x"))).collect()
    assert sorted((str(r.doc_id), r.component_id, r.kept) for r in out) == [("1", 1, True), ("1", 1, True), ("2", 1, False), ("3", 3, True), ("None", None, True)]
    assert minhash.near_duplicates(nothing).count() == 0


def test_register_estimate_is_close():
    rng = np.random.default_rng(2)
    a = np.unique(rng.integers(0, 2**63, 4000).astype(np.uint64) * np.uint64(2))
    for j in (0.3, 0.8, 0.95):
        k = int(len(a) * 2 * j / (1 + j))
        b = np.unique(np.concatenate([a[rng.permutation(len(a))[:k]], rng.integers(0, 2**63, len(a) - k).astype(np.uint64) * np.uint64(2) + np.uint64(1)]))
        true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        reg = minhash.registers([a, b])
        est, used = minhash.jaccard_estimate(reg[:1], reg[1:], np.array([len(a)]), np.array([len(b)]))
        assert used[0] == minhash.BUCKETS and abs(est[0] - true) < 4 * math.sqrt(true * (1 - true) / minhash.BUCKETS) + 0.02


def brute_imatch(texts, low, high):
    """Fingerprint of a text from md5s of its terms in the band, whole and by randomly drawn lexica."""
    words_of = lambda t: set(WORD.findall(lower(t or "")))
    df = Counter(w for t in texts for w in words_of(t))
    lex = {w for w, n in df.items() if max(2, low * len(texts)) <= n <= high * len(texts)}
    md5 = lambda x: hashlib.md5(x.encode()).hexdigest()

    def of(t):
        h = sorted(md5(w) for w in (words_of(t) & lex or words_of(t)))
        sets = [h, *[[x for x in h if x[k - 1 : k - 1 + len(m)] < m] for k, m in fingerprints.SUBSETS]]
        return ".".join(md5(" ".join(x))[:8] if x else "-" for x in sets)

    return of


@pytest.mark.parametrize("max_inline", [0, 50_000])
def test_fingerprints(docs, corpus, nothing, max_inline):
    got = {r.doc_id: r for r in fingerprints.imatch(docs.withColumn("mine", F.lit("x")), low=0.02, high=0.5, max_inline=max_inline).collect()}
    order = sorted(corpus)
    of = brute_imatch([t for _, t in corpus], 0.02, 0.5)
    for i, t in corpus:
        assert (got[i].fingerprint, got[i].edited_fingerprint) == (of(t), of(got[i].edited))
    for k, (i, t) in enumerate(order):
        t, nxt = t or "", order[(k + 1) % len(order)][1] or ""
        h = len(t) // 2
        assert got[i].n_chars == len(t)
        assert got[i].edited == t[: len(t) - h] + nxt[:h]
        assert 0 <= got[i].near_edited <= 1 and 0 <= got[i].near_next <= 1
    assert got[901].fingerprint == got[902].fingerprint == got[903].fingerprint
    assert got[904].fingerprint == got[905].fingerprint
    assert got[901].near_next == 1.0
    assert fingerprints.imatch(nothing).count() == 0


def test_fingerprints_of_repeated_and_null_ids(spark):
    rows = [(1, "a b"), (1, "a b"), (1, "c d"), (None, "e f"), (2, "a b")]
    out = fingerprints.imatch(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((str(r.doc_id), r.text) for r in out) == sorted((str(i), t) for i, t in rows)
    assert len({r.fingerprint for r in out if r.text == "a b"}) == 1


def test_successors_across_ranges(spark):
    ids = [k * k for k in range(100)]
    df = spark.createDataFrame([(i, f"t{i}") for i in ids], "doc_id long, text string").repartition(5)
    got = {r.doc_id: r.next_text for r in fingerprints.with_next(df, ["doc_id", "text"], ["text"], per_bucket=7).collect()}
    assert got == {i: f"t{ids[(k + 1) % 100]}" for k, i in enumerate(ids)}


EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def brute_spans(t):
    digits = lambda m: [int(c) for c in m[0] if c in "0123456789"]

    def luhn(m):
        d = digits(m)[::-1]
        return 13 <= len(d) <= 19 and (sum(d[::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])) % 10 == 0

    return {
        "email": [m.span() for m in EMAIL.finditer(t)], "ip": [m.span() for m in IP.finditer(t) if all(int(p) <= 255 for p in m[0].split("."))],
        "card": [m.span() for m in CARD.finditer(t) if luhn(m)], "phone": [m.span() for m in PHONE.finditer(t) if 9 <= len(digits(m)) <= 15]}


def test_pii_patterns():
    rng = random.Random(4)
    parts = ["a@b.c", "x.y+z@host-1.example.org", "1.2.3.4", "300.1.1.1", "1.2.3.4.5.6.7.8", "4111 1111 1111 1111", "4111111111111112", "+1 (389) 555-5010", "+44 20", "..", "@", "@@b.c", "-", " ", "7", "word", "a@b..c", "é@x.io", "+", "0.0.0.0"]
    texts = ["".join(rng.choice(parts) + rng.choice(["", " ", ","]) for _ in range(12)) for _ in range(1500)] + ["", "9" * 3000, "a" * 5000 + "@", "1." * 2000]
    for t in texts:
        assert pii.base_spans(t) == brute_spans(t), t[:200]


def test_pii_terms(spark, nothing):
    rows = [(k, f"some plain words here Reachme: user{k}@mail.org and then more of the plain text") for k in range(40)]
    rows += [(100 + k, "some plain words here and then more of the plain text over and over " * 4) for k in range(40)] + [(900, None), (901, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("spans", F.lit(1))
    got = {r.doc_id: r for r in pii.sanitise(df).collect()}
    assert got[900].spans == [] and got[900].text == ""
    kinds = Counter(s.kind for s in got[3].spans)
    assert kinds["email"] == 1 and kinds["remove"] + kinds["generalise"] >= 1
    assert "user3@" not in got[3].text and "Reachme" not in got[3].text and "plain words" in got[3].text
    assert got[105].spans == [] and got[105].text == rows[45][1]
    assert pii.sanitise(nothing).count() == 0


@pytest.mark.parametrize("max_small", [pii.MAX_SMALL, 0])
def test_pii_terms_that_are_rare_in_a_large_corpus(spark, max_small):
    """6 of 12,000 context words, always beside an email: judged as in a small corpus."""
    rng = random.Random(14)
    plain = lambda n: " ".join(f"w{rng.randrange(200)}" for _ in range(n))
    rows = [(k, f"{plain(8)} {'Zanzi' if k < 6 else plain(1)} user{k}@mail.org {plain(9)}") for k in range(1000)] + [(2000 + k, plain(300)) for k in range(200)]
    rows += [(None, rows[0][1]), (0, rows[0][1])]
    got = pii.sanitise(spark.createDataFrame(rows, "doc_id long, text string"), max_small=max_small).collect()
    assert len(got) == len(rows)
    for r in got:
        assert "Zanzi" not in r.text and [s.kind for s in r.spans] == (["email"] if (r.doc_id or 0) < 2000 else []) + ["remove"] * ((r.doc_id or 0) < 6)


@pytest.mark.parametrize("max_small", [pii.MAX_SMALL, 0])
def test_pii_terms_away_from_matches(spark, max_small):
    """A term that discloses goes also far from a match, beside an unmatched form and in texts without one."""
    plain = "some plain words here and then more of the plain text"
    rows = [(k, f"{plain} Reachme: user{k}@mail.org {plain} {plain}") for k in range(40)] + [(100 + k, f"{plain} over and over " * 4) for k in range(40)]
    rows += [(200, f"{plain} reachme, user at mail dot org"), (201, f"a@b.org {plain} (ReachMe) {plain}"), (202, f"{plain} x.reachme@mail.org Reachme@mail.org")]
    got = {r.doc_id: r for r in pii.sanitise(spark.createDataFrame(rows, "doc_id long, text string"), max_small=max_small).collect()}
    assert got[200].text == f"{plain} , user at mail dot org" and [tuple(s) for s in got[200].spans] == [("remove", len(plain) + 1, len(plain) + 8)]
    assert got[201].text == f"[email] {plain} () {plain}"
    assert got[202].text == f"{plain} [email] [email]"
    assert got[120].text == rows[60][1] and got[120].spans == []


def test_urls(spark):
    rng = random.Random(6)
    rows = []
    for k in range(600):
        tld, path = rng.choice([("example.net", "/en/"), ("a.org", "/fr/"), ("example.com", "/de/"), ("b.net", "/x/"), ("c.com", "/y/")])
        word = "".join(rng.choice("aeiou") if tld in ("example.net", "a.org") else rng.choice("xzqjw") for _ in range(12))
        rows.append((k, f"https://{rng.choice(['', 'www.'])}{tld}{path}{word}?q=1"))
    odd = [(1000, None), (1001, ""), (1002, "no scheme"), (1003, "http://NET/"), (1004, "http://x.net"), (1005, "http://a.example.net/en/z#f"), (1006, "http://example.netx/en/"), (1007, "ftp://h?x://y/")]
    for word, k in (("aeiouaeiouaeiou", 2000), ("xzqjwxzqjwxzqjw", 2001)):
        odd.append((k, f"https://c.com/y/{word}"))
    got = {r.page_id: r for r in urls.filter_urls(spark.createDataFrame(rows + odd, "page_id long, url string")).collect()}
    for i, u in rows + odd:
        u = u or ""
        rest = u.split("://", 1)[1] if "://" in u else ""
        host = lower(re.match(r"[^/?#]*", rest)[0])
        path = re.match(r"[^?#]*", rest[len(host):])[0]
        fits = [(len(h + p), h + p, v) for v, h, p in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        want = max(fits)[1:] if fits else (None, got[i].verdict)
        assert (got[i].host, got[i].path, got[i].rule, got[i].verdict) == (host, path, *want), u
    assert got[2000].verdict == "allow" and got[2001].verdict == "block"
    assert urls.filter_urls(spark.createDataFrame([], "page_id long, url string")).count() == 0


def test_chat_round_trip(spark):
    rng = random.Random(8)
    rows = []
    for c in range(20):
        for t in range(rng.randrange(1, 12)):
            role = "system" if t == 0 and c % 3 == 0 else rng.choice(["user", "assistant", None])
            text = rng.choice([None, "", "&lt;| &amp; <|im_end|>\n", "plain " * rng.randrange(1, 60), "<|im_start|>assistant\nok<|im_end|>"])
            rows.append((c, t, role, text))
    rows += [(50, 0, "user", "same"), (50, 0, "user", "same"), (None, 0, "assistant", "lone")]
    wins = chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), budget=60, history=20)
    got = {r.conv_id: r for r in chat.read_back(wins).collect()}
    for c in {r[0] for r in rows}:
        mine = sorted(((t, r or "", x or "") for k, t, r, x in rows if k == c))
        said = "".join(f"{r}\n{x}\n" for _, r, x in mine)
        loss = "".join(x for _, r, x in mine if r == "assistant")
        r = got[c]
        assert (r.n_turns, r.turns_sha256) == (len(mine), hashlib.sha256(said.encode()).hexdigest())
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    for w in wins.collect():
        n = len(chat.TURN.findall(w.text))
        assert n > w.n_context and (w.tokens <= 60 or (n, w.n_context) == (1, 0))
    assert chat.format_chats(wins.where("false").selectExpr("conv_id", "window as turn", "text as role", "text")).count() == 0


def test_chat_spans_are_those_of_adding_up():
    """Prefix sums, beginning anywhere, choose the windows that adding up turn by turn gives."""
    rng = random.Random(21)
    for _ in range(300):
        turns = [(rng.choice(["system", "user", "assistant"]) if rng.random() < 0.3 else "user", str(k), rng.choice([0, 1, 3, 9, 40, 70])) for k in range(rng.randrange(1, 40))]
        budget, history, at = rng.randrange(20, 80), rng.randrange(0, 30), rng.randrange(1000)
        first = next((t for t in turns if t[0] == "system"), None)
        want, i = [], 0
        while i < len(turns):
            past, context = turns[:i], []
            if i:
                context = [first] if first in past and first[2] + turns[i][2] <= budget else []
                room = min(history, budget - turns[i][2] - sum(t[2] for t in context))
                older = [t for t in past if t is not first]
                back = next((k for k in range(len(older) + 1) if sum(t[2] for t in older[k:]) <= room), len(older))
                context = context + older[back:]
            used, j = sum(t[2] for t in context) + turns[i][2], i + 1
            while j < len(turns) and used + turns[j][2] <= budget:
                used, j = used + turns[j][2], j + 1
            want.append((context, turns[i:j], used))
            i = j
        sums = np.cumsum([t[2] for t in turns]) + at
        assert list(chat.spans([(*t, int(u)) for t, u in zip(turns, sums)], budget, history)) == want


def test_chat_budget_holds_beside_a_large_system_turn():
    """The window of a turn that fits alone, but not with the system turn, goes without it."""
    turns = [("system", "s" * 40), ("user", "u" * 10), ("assistant", "a" * 40), ("user", "v" * 15)]
    got = list(chat.windows_of(turns, len, 60, 20))
    assert [(len(c), [t[0][0] for t in n], used) for c, n, used in got] == [(0, ["s", "u"], 50), (1, ["a"], 50), (1, ["u"], 55)]
    assert [c[0][0] for c, _, _ in got[1:]] == ["user", "system"]


def test_url_rules_of_equal_length(spark):
    row = spark.createDataFrame([(1, "http://a.com/x/y")], "page_id long, url string")
    rules = [("block", "com", "/x/"), ("allow", "a.com", "/")]
    for order in (rules, rules[::-1]):
        host, path = urls.host_path(F.col("url"))
        name, verdict = urls.matching(host, path, order)
        assert row.select(name.alias("n"), verdict.alias("v")).first() == (order[0][1] + order[0][2], order[0][0])


def test_fm_index_matches_plain_search():
    rng = np.random.default_rng(9)
    pieces = [rng.integers(1, 4, rng.integers(40, 160)) for _ in range(30)] + [np.ones(100, int)]
    owners = rng.permutation(31)
    index = FmIndex(pieces, owners, 40)
    queries = pieces + [np.concatenate([pieces[0][:45], [9], pieces[1][:41]]), rng.integers(1, 4, 90), np.ones(10, int)]
    where = {}
    for p, o in zip(pieces, owners):
        for k in range(len(p) - 39):
            key = tuple(p[k : k + 40])
            where[key] = min(where.get(key, 99), o)
    for q, found in zip(queries, index.matching(queries)):
        assert found.tolist() == [where.get(tuple(q[k : k + 40]), -1) for k in range(len(q) - 39)]


@pytest.mark.parametrize("hot", [256, 0])
def test_passages(docs, corpus, nothing, hot, monkeypatch):
    monkeypatch.setattr(passages, "HOT", hot)
    w = {i: WORD.findall(t or "") for i, t in corpus}
    first = {}
    for i in sorted(w):
        for k in range(len(w[i]) - 49):
            first.setdefault(tuple(w[i][k : k + 50]), i)
    want = {}
    for i, ws in w.items():
        gone = {j for k in range(len(ws) - 49) if first[tuple(ws[k : k + 50])] < i for j in range(k, k + 50)}
        kept = " ".join(x for j, x in enumerate(ws) if j not in gone)
        want[i] = (len(ws), len(gone), hashlib.sha256(kept.encode()).hexdigest(), kept)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256, r.text) for r in passages.dedup_passages(docs).collect()}
    assert got == want
    assert passages.dedup_passages(nothing).count() == 0


def test_passages_of_one_phrase_in_many_surroundings(spark, monkeypatch):
    """Each surrounding of the phrase stands in two documents: one minimizer has hundreds of parts, no shard has."""
    monkeypatch.setattr(passages, "HOT", 50)
    monkeypatch.setattr(passages, "SHARD", 50)
    rng = random.Random(4)
    pool = [f"p{k}" for k in range(20_000)]
    at = int(np.argmin(grams(hash_words(pa.array(pool)), 8)))  # a phrase that is the minimizer wherever it stands
    phrase = pool[at : at + 8]
    word = lambda: f"u{rng.randrange(10**6)}"
    rows = []
    for k in range(200):
        around = [word() for _ in range(45)], [word() for _ in range(45)]
        rows += [(2 * k + c, " ".join([word() for _ in range(5)] + around[0] + phrase + around[1] + [word() for _ in range(5)])) for c in (0, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    _, _, pieces, _ = passages._dealt(docs, 50)
    sizes = [r["count"] for r in pieces.groupBy("shard").count().collect()]
    assert max(sizes) <= 3 * 50 and pieces.groupBy("g").count().agg(F.max("count")).first()[0] > 150
    got = {r.doc_id: r.n_removed for r in passages.dedup_passages(docs, with_text=False).collect()}
    assert got == {i: 98 if i % 2 else 0 for i, _ in rows}


def test_targets_and_routes():
    assert mixing.targets({"a": 10, "b": 1000, None: 5}) == pytest.approx({"a": 30.0, "b": 970.0, None: 15.0})
    supply = {("a",): 100, ("a", "b"): 100, ("b",): 10}
    got = mixing.route(supply, {"a": 100, "b": 150})
    assert sum(got.values()) == 250 and got[("a",)] == 100 and got[("a", "b")] + got[("b",)] == 150 and got[("b",)] <= 30
    # cheapest: every word once before any is repeated
    assert mixing.route({("a",): 50, ("a", "b"): 50}, {"a": 60, "b": 40}) == {("a",): 50, ("a", "b"): 50}
    assert mixing.route({("a",): 10}, {"a": 100}) == {("a",): 30}


def test_routes_are_cheapest():
    """Against all splits of small supplies: as many words as fit, at the least cost of repetition."""
    import itertools

    rng = random.Random(9)
    cost = lambda n, t: sum(max(0, t - k * n) for k in (1, 2))
    for _ in range(25):
        supply = {p: rng.randrange(1, 4) for p in rng.sample([("a",), ("b",), ("a", "b"), ("b", "c"), ("c",)], 3)}
        quota = {s: rng.randrange(0, 6) for s in "abc"}
        got = mixing.route(supply, quota)
        best = None
        for flows in itertools.product(*[[f for f in itertools.product(range(3 * n + 1), repeat=len(p)) if sum(f) <= 3 * n] for p, n in supply.items()]):
            taken = Counter()
            for p, f in zip(supply, flows):
                for s, x in zip(p, f):
                    taken[s] += x
            if all(taken[s] <= quota[s] for s in quota):
                key = (-sum(map(sum, flows)), sum(cost(n, sum(f)) for n, f in zip(supply.values(), flows)))
                best = key if best is None else min(best, key)
        assert (-sum(got.values()), sum(cost(n, got[p]) for p, n in supply.items())) == best


def test_routes_of_many_patterns():
    """All capacity is given out where quotas ask for more, in time that grows with the patterns."""
    rng = random.Random(18)
    names = [f"s{k:02d}" for k in range(30)]
    supply = {tuple(sorted(set(rng.choices(names, k=rng.randrange(1, 5))))): rng.randrange(0, 10_000) for _ in range(12_000)}
    whole = sum(supply.values())
    asked = {s: 3 * whole * (k % 5 + 1) // 90 for k, s in enumerate(names)}
    start = time.monotonic()
    got = mixing.route(supply, asked)
    assert time.monotonic() - start < 30
    assert got == mixing.route(dict(reversed(supply.items())), asked)
    assert all(0 <= got[p] <= 3 * n for p, n in supply.items())
    assert sum(got.values()) <= sum(asked.values())
    assert mixing.route(supply, {s: 10 * whole for s in names}) == {p: 3 * n for p, n in supply.items()}


def test_mixing_of_overlapping_sources_apart_and_on_the_driver(spark):
    rng = random.Random(10)
    names = [None, *"abcdefgh"]
    rows = [(i, sorted(rng.sample(names[: 4] if i % 2 else names[4:], rng.randrange(1, 3)), key=str), rng.randrange(0, 30)) for i in range(200)] + [(500, [], 5)]
    df = spark.createDataFrame(rows, "doc_id long, held array<string>, words long")
    runs = [sorted(mixing.mix(df, F.col("held"), F.col("words"), max_patterns=m).collect()) for m in (0, 1000)]
    assert [(r.doc_id, r.size, r.source_size, r.taken) for r in runs[0]] == [(r.doc_id, r.size, r.source_size, r.taken) for r in runs[1]]
    assert all(abs(a.target - b.target) < 1e-6 for a, b in zip(*runs))
    assert all(0 <= r.taken <= 3 * r.size for r in runs[0]) and sum(r.taken for r in runs[0]) > 0


def test_mixing(docs, corpus, nothing):
    rows = mixing.mix(docs).collect()
    size = {i: len(WORD.findall(t or "")) for i, t in corpus}
    src = {i: None if i % 7 == 0 else f"s{i % 3}" for i, _ in corpus}
    total = Counter()
    for i in size:
        total[src[i]] += size[i]
    want, taken = mixing.targets(dict(total)), Counter()
    for r in rows:
        assert r.size == size[r.doc_id] and r.source_size == total[src[r.doc_id]] and r.target == want[src[r.doc_id]]
        assert 0 <= r.taken <= 3 * r.size
        taken[src[r.doc_id]] += r.taken
    assert len(rows) == len(size) and all(abs(taken[s] - want[s]) <= 1 for s in want)
    assert sorted(rows) == sorted(mixing.mix(docs.repartition(2)).collect())
    assert mixing.mix(nothing).count() == 0


def near(a, b):
    a, b = WORD.findall(a), WORD.findall(b)
    if a == b:
        return True
    if min(len(a), len(b)) < lines.NEAR or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def test_lines(spark, docs, corpus, nothing):
    rng = random.Random(7)
    rows = list(corpus)
    base = [[f"w{rng.randrange(50)}" for _ in range(rng.randrange(6, 14))] for _ in range(15)]
    for i in range(2000, 2040):
        text = []
        for _ in range(5):
            w = list(rng.choice(base))
            what = rng.randrange(4)
            k = rng.randrange(len(w))
            if what == 0:
                w[k] = "new" + str(rng.randrange(9))
            elif what == 1:
                del w[k]
            elif what == 2:
                w.insert(k, "more" + str(rng.randrange(9)))
            text.append(" ".join(w))
        rows.append((i, "\n".join(text)))
    places = [(i, k, x.strip(" ")) for i, t in sorted(rows) for k, x in enumerate((t or "").split("\n")) if len(x.strip(" ")) >= lines.LEAST]
    gone = {(i, k) for n, (i, k, x) in enumerate(places) if any(y == x or near(x, y) for _, _, y in places[:n])}
    got = {r.doc_id: r for r in lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, t in rows:
        kept = [x for k, x in enumerate((t or "").split("\n")) if (i, k) not in gone]
        assert got[i].text == (None if t is None else "\n".join(kept)), i
        assert got[i].n_removed == sum(a == i for a, _ in gone)
    assert lines.dedup_lines(nothing).count() == 0


@pytest.mark.parametrize("least", [1, 12])
def test_short_lines(spark, least):
    rows = [(1, "ok\n\nshort one\nand a line of more length"), (2, "short one\n\nok\nfine"), (2, "short one"), (3, "and a line of more length")]
    got = sorted((r.doc_id, r.text) for r in lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), least=least).collect())
    want = [(1, rows[0][1]), (2, "\nfine"), (2, ""), (3, "")] if least == 1 else [(1, rows[0][1]), (2, rows[1][1]), (2, rows[2][1]), (3, "")]
    assert got == sorted(want)


def test_lines_keep_other_columns(spark):
    df = spark.createDataFrame([(1, "the same long line here", "x"), (2, "the same long line here\nand another line of its own", "y"), (None, "the same long line here", "z")], "doc_id long, text string, stay string")
    got = {r.doc_id: r for r in lines.dedup_lines(df).collect()}
    assert got[2].text == "and another line of its own" and got[2].stay == "y" and got[None].n_removed == 0


def test_ftrl_follows_its_definition():
    """Against weights that minimise the sum of all gradients, their proximal terms and both penalties."""
    rng = np.random.default_rng(12)
    model, zs, ns = quality.Ftrl(6), [0.0] * 6, [0.0] * 6
    for _ in range(200):
        at = np.sort(rng.permutation(6)[:3])
        x, y = rng.random(3) * 3, float(rng.random() < 0.5)
        w = [0.0 if abs(zs[i]) <= quality.L1 else -(zs[i] - math.copysign(quality.L1, zs[i])) / ((quality.BETA + math.sqrt(ns[i])) / quality.ALPHA + quality.L2) for i in at]
        p = 1 / (1 + math.exp(-sum(a * b for a, b in zip(w, x))))
        for k, i in enumerate(at):
            g = (p - y) * x[k]
            zs[i] += g - (math.sqrt(ns[i] + g * g) - math.sqrt(ns[i])) / quality.ALPHA * w[k]
            ns[i] += g * g
        model.learn(at, x, y)
    assert np.allclose(model.z, zs) and np.allclose(model.n, ns)


def test_quality(spark, nothing):
    rng = random.Random(11)
    rows, labels = [], []
    for i in range(600):
        good = i % 3 > 0
        w = [rng.choice(["plain", "word", "text", "line", "short"]) + rng.choice(["", "s", "ed"]) for _ in range(40)]
        rows.append((i, " ".join(w if good else [x + "%%%" for x in w])))
        labels.append((i, int(good), 0))
    rows += [(1000, ""), (1001, None)]
    d, l = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality.classify(d, l).collect()}
    import zlib

    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, _ in rows)
    held = [i for i, _, _ in labels if got[i].held_out]
    assert sum(got[i].predicted == labels[i][1] for i in held) >= 0.97 * len(held)
    assert got[1000].score == got[1001].score and all(0 <= r.score <= 1 for r in got.values())
    assert quality.classify(nothing.select("doc_id", "text"), l).count() == 0
    assert quality.classify(d, l.where("false")).where("score is null").count() == 0
    kept = {r.doc_id for r in quality.keep_good(d, l).collect()}
    assert kept == {i for i, r in got.items() if r.predicted}


def toks(t):
    return [w for w in re.split(r"[^\w]+|_", (t or "").lower()) if w]


def brute_leaks(rows, items):
    out = {}
    for i, t in rows:
        w = toks(t)
        for j, x in items:
            v = toks(x)
            n = len(v)
            if not n:
                continue
            k = min(5, n)
            want = Counter(tuple(v[a : a + k]) for a in range(n - k + 1))
            for s in range(max(1, len(w) - n + 1)):
                part = w[s : s + n]
                have = Counter(tuple(part[a : a + k]) for a in range(len(part) - k + 1))
                both, total = sum((have & want).values()), sum((have | want).values())
                if both and 100 * both >= 80 * total:
                    best = out.get((i, j))
                    if best is None or both * best[2] > best[1] * total:
                        out[i, j] = (s, both, total)
    return out


@pytest.mark.parametrize("max_small", [1_000_000, 0])
def test_decontamination(spark, corpus, nothing, max_small):
    rng = random.Random(13)
    items = [(k, " ".join(f"q{rng.randrange(300)}" for _ in range(rng.choice([2, 4, 5, 12, 30, 60])))) for k in range(25)] + [(90, ""), (91, None)]
    rows = list(corpus)[:20] + [(901, ""), (902, None)]
    for i in range(3000, 3040):
        v = (rng.choice(items[:25])[1]).split()
        if i % 3 == 0 and len(v) > 20:
            v[rng.randrange(5, len(v) - 5)] = "edited"
        rows.append((i, "Some opening words, " + " ".join(v).upper() + ". and a few more at the end " + " ".join(f"z{rng.randrange(99)}" for _ in range(20))))
    b = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.start, r.shared, r.total) for r in decontaminate.leaks(spark.createDataFrame(rows, "doc_id long, text string"), b, max_small=max_small).collect()}
    assert got == brute_leaks(rows, items)
    if max_small:
        assert decontaminate.leaks(nothing, b).count() == 0
        assert decontaminate.leaks(spark.createDataFrame(rows[:3], "doc_id long, text string"), b.where("false")).count() == 0


def test_texts_without_id_are_screened(spark):
    item = " ".join(f"q{k}" for k in range(30))
    rows = [(1, item, "a"), (2, "clean words only in this one here", "b"), (None, "so " + item, "c"), (None, "clean too", "d"), (None, None, "e"), (2, "clean words", "f")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start string")
    bench = spark.createDataFrame([(7, item), (7, item), (None, "clean too")], "item_id long, text string").withColumn("n", F.lit(1))
    kept = decontaminate.keep_clean(docs, bench)
    assert kept.columns == docs.columns and sorted(r.start for r in kept.collect()) == ["b", "d", "e", "f"]


@pytest.mark.parametrize("max_small", [1_000_000, 0])
def test_decontamination_of_reordered_items(spark, max_small):
    """Items whose first words or sentence stand at their end, inside longer texts."""
    rng = random.Random(15)
    plain = lambda c, n: [f"{c}{rng.randrange(500)}" for _ in range(n)]
    items = [(k, plain("q", n)) for k, n in enumerate([45, 45, 45, 60, 90, 45])] + [(6, ["r1", "r2", "r3"] * 15)]
    rows = []
    for k, v in items:
        for turn in (0, 1, 5, 10, 22, 44):
            rows.append((len(rows), " ".join(plain("z", 30) + v[turn:] + v[:turn] + plain("y", 30))))
        rows.append((len(rows), " ".join(v[9:] + v[:9])))
        rows.append((len(rows), " ".join(v[: len(v) - 3])))
    rows += [(0, rows[3][1]), (0, rows[-1][1])]
    items = [(k, " ".join(v)) for k, v in items]
    want = {}
    for row in rows:
        for key, best in brute_leaks([row], items).items():
            if key not in want or (best[1] * want[key][2], -best[0]) > (want[key][1] * best[2], -want[key][0]):
                want[key] = best
    out = decontaminate.leaks(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), max_small=max_small)
    assert {(r.doc_id, r.item_id): (r.start, r.shared, r.total) for r in out.collect()} == want
    assert len(want) > 45


@pytest.mark.parametrize("n_items", [20, 40])
def test_items_of_one_form_meet_only_their_own_windows(spark, n_items):
    """Items of one length share half of their words; windows laid must not grow with the items."""
    rng = random.Random(16)
    frame = [f"f{k}" for k in range(20)]
    items = [(k, " ".join(frame + [f"q{rng.randrange(9999)}" for _ in range(20)])) for k in range(n_items)]
    items += [(500, items[0][1]), (501, items[0][1].upper()), (3, "another text of the same id " + " ".join(frame))]
    rows = [(k, f"z{k} " + items[k][1] + " and more") for k in range(10)] + [(100 + k, " ".join([*frame, f"y{k}", *(f"x{rng.randrange(999)}" for _ in range(30))])) for k in range(30)]
    b = spark.createDataFrame(items, "item_id long, text string")
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.item_id): (r.start, r.shared, r.total) for r in decontaminate.leaks(docs, b).collect()}
    want = {}
    for item in items:
        want |= {k: v for k, v in brute_leaks(rows, [item]).items() if k not in want or v[1] * want[k][2] > want[k][1] * v[2]}
    assert got == want and {(0, 500), (0, 501), (0, 0)} <= set(got)
    every = decontaminate.item_shingles(b).withColumn("item", F.xxhash64("n", "grams")).select("item", "n", "grams", "print").distinct()
    # a copy and its shifts by up to a fifth of the item
    assert decontaminate.windows(docs, every, [5], True).count() <= 10 * 9 + 60


def brute_url_scores(urls_seen, said):
    """Score of each URL and the cut, from counted characters after every context of up to two."""
    n_symbols = urls.SYMBOLS

    def symbols(u):
        return [n_symbols - 1] * 2 + [urls.ALPHABET.find("0" if c in "123456789" else c) + 1 for c in u.lower()]

    held = {u: hashlib.md5(u.encode()).hexdigest()[0] in "0123" for u in urls_seen}
    seen = {"allow": Counter(), "block": Counter()}
    for u in urls_seen:
        if said[u] and not held[u]:
            a = symbols(u)
            for i in range(2, len(a)):
                for k in range(3):
                    seen[said[u]][(*a[i - k : i], "next", a[i])] += 1
                    seen[said[u]][(*a[i - k : i], "any")] += 1

    def p(kind, context, c):
        lower = p(kind, context[1:], c) if context else 1 / n_symbols
        return (seen[kind][(*context, "next", c)] + urls.BACKOFF * lower) / (seen[kind][(*context, "any")] + urls.BACKOFF)

    def score(u):
        a, total = symbols(u), 0
        for i in range(2, len(a)):
            ratio = (math.log(p("allow", a[i - 2 : i], a[i])) - math.log(p("block", a[i - 2 : i], a[i]))) * urls.UNIT
            total += int(math.copysign(math.floor(abs(ratio) + 0.5), ratio))
        return math.floor(total / max(1, len(u)))

    scores = {u: score(u) for u in set(urls_seen)}
    cells = [(scores[u] // 1000, said[u]) for u in urls_seen if said[u] and held[u]]
    n_allow, n_block = (sum(v == kind for _, v in cells) for kind in ("allow", "block"))
    gain = {x: sum(c >= x and v == "allow" for c, v in cells) * n_block + sum(c < x and v == "block" for c, v in cells) * n_allow for x, _ in cells}
    return scores, 1000 * max(gain, key=lambda x: (gain[x], -abs(x), -x))


def test_url_scores_are_those_of_counted_characters(spark):
    rng = random.Random(19)
    hosts = ["shop.example.net", "a.b.net", "www.example.com", "data.org", "other.io", "x9.example.net"]
    seen = [f"https://{rng.choice(hosts)}/{rng.choice(['en', 'de', 'fr', 'zz'])}/" + "".join(rng.choice("abcxyz-_%?=~0123456789") for _ in range(rng.randrange(0, 25))) for _ in range(300)]
    seen += seen[:20] + ["https://data.org/fr/" + "long" * 3000, "no scheme", "HTTPS://Data.ORG/fr/UP"]
    rows = [(None if k % 50 == 0 else k, u, k) for k, u in enumerate(seen)]
    # a null page_id, a column that clashes with a result, repeated rows
    got = urls.filter_urls(spark.createDataFrame(rows, "page_id long, url string, score long").withColumn("host", F.col("url"))).collect()
    assert len(got) == len(rows)
    said = {}
    for u in seen:
        host, _, path = (u.split("://", 1) + [""])[1].partition("/")
        host, path = host.lower(), "/" + path.split("?")[0]
        fits = [(len(h + p), v) for v, h, p in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        said[u] = max(fits)[1] if fits else None
    scores, cut = brute_url_scores(seen, said)
    assert cut != 0 and len({said[u] for u in seen}) == 3
    for r in got:
        if r.page_id is not None:
            u = seen[r.page_id]
            assert (r.score, r.cut_score) == (scores[u], cut), u
            assert r.verdict == (said[u] or ("allow" if scores[u] >= cut else "block"))


def test_the_driver_sees_only_the_classifiers_weights(spark, monkeypatch):
    """Features of the sample are learnt by a task that streams them; their size does not reach the driver."""
    rng = random.Random(3)
    texts = [(k, " ".join(f"{rng.choice('ab')}{rng.randint(0, 99999)}" for _ in range(2500))) for k in range(160)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(160)], "doc_id long, quality int")
    seen, real = [], type(docs).collect
    monkeypatch.setattr(type(docs), "collect", lambda self: [seen.extend(len(v) for r in x for v in r if isinstance(v, (bytes, bytearray))) or x for x in [real(self)]][0])
    weights, bias = quality.fit(docs, labels)
    assert len(weights) == 1 << quality.BITS and np.count_nonzero(weights)
    assert sum(seen) <= 4 << quality.BITS
    assert np.array_equal(quality.fit(docs.repartition(7), labels)[0], weights)
