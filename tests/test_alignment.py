"""Alignment of quotes with pages against a quadratic brute force."""

import random

import pytest
from pyspark.sql import functions as F

from quillmark.functions.align import partial_ratio
from quillmark.operators import evidence as E


def lcs(a, b):
    above = [0] * (len(b) + 1)
    for x in a:
        row = [0]
        for j, y in enumerate(b):
            row.append(above[j] + 1 if x == y else max(above[j + 1], row[j]))
        above = row
    return above[-1]


def brute(one, two):
    short, long = sorted((one, two), key=len)
    m, n = len(short), len(long)
    if not m:
        return 0.0 if n else 100.0
    windows = (long[max(i, 0) : min(i + m, n)] for i in range(1 - m, n))
    return max(200 * lcs(short, w) / (m + len(w)) for w in windows)


def pairs(n):
    rng = random.Random(11)
    for _ in range(n):
        letters = "abcde é\U0001d518z"[: rng.randrange(2, 10)]
        make = lambda k: "".join(rng.choice(letters) for _ in range(k))
        one, two = make(rng.randrange(22)), make(rng.randrange(50))
        if one and rng.random() < 0.6:  # a copy with slips inside the long one
            copy = list(one)
            for _ in range(rng.randrange(4)):
                copy[rng.randrange(len(copy))] = rng.choice(["", "#", rng.choice(letters)])
            two = two[:15] + "".join(copy) + two[15:]
        yield one, two


@pytest.mark.parametrize("floor", [0, 60, 88, 90])
def test_partial_ratio_equals_brute_force(floor):
    for one, two in pairs(500):
        want = brute(one, two)
        assert partial_ratio(one, two, floor) == pytest.approx(want if want >= floor else 0), (one, two)


@pytest.mark.parametrize("m", [63, 64, 65, 128, 150])
def test_texts_of_several_words_of_bits(m):
    rng = random.Random(m)
    one = "".join(rng.choice("abcdefgh ") for _ in range(m))
    two = "".join(rng.choice("abcdefgh ") for _ in range(80)) + one[:20] + "#" + one[22:] + "zz"
    assert partial_ratio(one, two) == pytest.approx(brute(one, two)) == partial_ratio(one, two, 88)


def test_scores_of_pages(spark):
    rows = [(k, a, b) for k, (a, b) in enumerate(pairs(60)) if len(a) >= 12]
    q = spark.createDataFrame([(k, a, True, None) for k, a, _ in rows], "doc_id int, needle string, checkable boolean, segs array<string>")
    p = spark.createDataFrame([(k, 1, b) for k, _, b in rows], "doc_id int, page_no int, hay string")
    got = {r.doc_id: r.fuzzy for r in E.aligned_scores(q, p, ["doc_id"], 0).collect()}
    assert got == {k: pytest.approx(brute(a, b), abs=1e-6) for k, a, b in rows}


PAGE = "the vendor shall provide quarterly reports on service levels and remedy every breach within ten days"


def test_misread_quotes_are_found(spark):
    """One letter changed in every third word: no shingle of three words is left, the alignment holds."""
    misread = " ".join(w[0] + "#" + w[2:] if i % 3 == 0 else w for i, w in enumerate(PAGE.split()))
    pages = spark.createDataFrame([(1, 1, "nothing here"), (1, 2, f"Before. {PAGE}. After"), (1, 3, "")], "doc_id int, page_no int, text string")
    quotes = spark.createDataFrame([(1, 2, True, misread), (1, 1, True, misread + " "), (1, 3, True, "quite another sentence that stands nowhere at all")], "doc_id int, page int, present boolean, quote string")
    key = ["doc_id", "page"]
    found = {a: {r.page: r.status for r in E.verify(quotes, pages, key, aligned=a).collect()} for a in (True, False)}
    assert found[True] == {2: "verified", 1: "wrong_page", 3: "unverified"}
    assert set(found[False].values()) == {"unverified"}


def test_misread_segments_over_two_pages(spark):
    parts = ["first cell of the evaluation table", "second cell with its weight of forty", "third cell that is on the next page", "fourth cell with the minimum score"]
    slip = lambda s: s.replace("e", "3", 1)
    pages = spark.createDataFrame([(1, 1, "intro"), (1, 2, f"{parts[1]} x {parts[0]}"), (1, 3, f"{parts[3]} y {parts[2]}")], "doc_id int, page_no int, text string")
    quote = " ... ".join(map(slip, parts))
    quotes = spark.createDataFrame([(1, 2, True, quote), (1, 3, True, " ... ".join(map(slip, parts[2:])))], "doc_id int, page int, present boolean, quote string")
    got = {r.page: r for r in E.verify(quotes, pages, ["doc_id", "page"], aligned=True).collect()}
    assert (got[2].status, got[2].found_on_page, got[2].best_score) == ("verified", 2, 100.0)
    assert got[3].status == "verified"


def test_empty_and_null_texts(spark):
    pages = spark.createDataFrame([(1, 1, ""), (1, 2, None)], "doc_id int, page_no int, text string")
    quotes = spark.createDataFrame([(1, 1, True, "a quote of some length"), (2, 1, True, "of a document without pages")], "doc_id int, page int, present boolean, quote string")
    assert {r.status for r in E.verify(quotes, pages, ["doc_id", "page"], aligned=True).collect()} == {"unverified"}
