"""Edge rules of the text, evidence, retrieval and grading expressions, on tiny frames."""

import datetime

import pytest
from pyspark.sql import functions as F

from quillmark.functions import text as T
from quillmark.operators import evidence as E
from quillmark.operators import grade as G
from quillmark.operators import retrieve as R
from quillmark.operators import review
from quillmark.sources import tables as S


def one(spark, expr, **cols):
    schema = ", ".join(f"{k} {'array<string>' if isinstance(v, list) else 'boolean' if isinstance(v, bool) else 'string'}" for k, v in cols.items())
    return spark.createDataFrame([tuple(cols.values())], schema).select(expr).first()[0]


@pytest.mark.parametrize("text, day", [
    ("June 3, 2026 2.00 PM MST", datetime.date(2026, 6, 3)), ("2026-06-03T23:30:00-07:00", datetime.date(2026, 6, 3)),
    ("due 3 June 2026", datetime.date(2026, 6, 3)), ("6/3/2026", datetime.date(2026, 6, 3)), ("in June", None), (None, None)])
def test_dates(spark, text, day):
    assert one(spark, T.extract_date(F.col("c")), c=text) == day


@pytest.mark.parametrize("truth, answer, verdict", [
    (None, "2026-01-01", "correct"), ("2026-01-01", "January 1, 2026", "correct"), ("2026-01-01", "January 1, 2026 2:00 PM", "partial"),
    ("January 1, 2026 at 2 pm", "2026-01-01T14:00", "correct"), ("2026-01-01", "2026-01-02", "wrong"), ("2026-01-01", "soon", "wrong")])
def test_date_verdicts(spark, truth, answer, verdict):
    assert one(spark, G.date_verdict(F.col("t"), F.col("a")), t=truth, a=answer) == verdict


def test_normalise(spark):
    n = lambda c: one(spark, T.normalise(F.col("c")), c=c)
    assert n("Cost " + "." * 19 + " 20") == n("Cost " + "." * 20 + " 20") == "cost 20"
    assert n("\U0001d45d x  ﬁt") == "p x fit"


def test_segments(spark):
    got = one(spark, T.segments(F.col("c")), c="First long enough sentence. Second long enough sentence; third part that is long ... tiny")
    assert got == ["first long enough sentence.", "second long enough sentence", "third part that is long"]


@pytest.mark.parametrize("value, ok", [(None, False), (" NULL ", False), ("n/a", False), ("x", True)])
def test_content(spark, value, ok):
    assert bool(one(spark, T.is_content(F.col("c")), c=value)) is ok


def test_contacts(spark):
    v = lambda t, a: one(spark, G.contact_verdict(F.col("t"), F.col("a")), t=t, a=a)
    assert v("Ann Bee. Buyer", '{"name":"ann bee"}') == "correct"
    assert v("Ann, ann@x.org", '{"email":"ANN@x.org"}') == "correct"
    assert v("Ann Bee", '{"name":"Carl"}') == "partial"


def test_similarity(spark):
    s = lambda a, b: one(spark, T.token_set_similarity(F.col("a"), F.col("b")), a=a, b=b)
    assert s("general liability cover", "cover general liability of 2m") == 100
    assert s("abc", "xyz") == 0
    assert s("", "") == 0 or s("", "") == 100


def quotes(spark, rows):
    return spark.createDataFrame([(1, k, p is not None or q is not None, p, q) for k, (p, q) in enumerate(rows)], "doc_id int, q int, present boolean, page int, quote string")


def test_verification(spark):
    pages = spark.createDataFrame(
        [(1, 1, "Alpha beta gamma delta epsilon."), (1, 2, "The table begins here with rows one and two"), (1, 3, "and goes on with rows three and four. Alpha beta gamma delta epsilon."), (2, 1, "elsewhere")],
        "doc_id int, page_no int, text string")
    rows = [(1, "alpha BETA gamma delta"), (2, "alpha beta gamma delta"), (1, "nothing of this kind is anywhere"), (2, None), (None, None),
            (2, "begins here with rows one and two and goes on with rows three"), (1, "short")]
    q = quotes(spark, rows).withColumn("page", F.coalesce("page", F.lit(-1)))
    got = {r.q: r for r in E.verify(q, pages, ["doc_id", "q", "page"]).collect()}
    assert [got[k].status for k in range(7)] == ["verified", "wrong_page", "unverified", "no_quote", "absent", "verified", "unverified"]
    assert got[1].found_on_page == 3, "of two exact pages the last"
    assert got[5].found_on_page == 2 and not got[5].exact


def test_rates_are_null_when_nothing_is_asserted(spark):
    df = spark.createDataFrame([("m", "absent"), ("m", "absent")], "b string, status string")
    r = E.rates(df, ["b"]).first()
    assert r.absent == 2 and r.groundedness is None and r.hallucination is None


def test_selection_keeps_pinned_and_gap_pages(spark):
    pages = spark.createDataFrame([(1, n, "key" if n in (4, 6, 9) else "none") for n in range(1, 10)], "doc_id int, page_no int, text string")
    fields = spark.createDataFrame([("f", "text", "c")], "field_key string, type string, cluster string")
    kw = spark.createDataFrame([("f", "c", "key")], "field_key string, cluster string, keyword string")
    scores = R.keyword_scores(pages, kw, ["field_key", "cluster"])
    top = R.top(R.ranked(scores, ["field_key"])).join(fields.select("field_key", "type"), "field_key")
    tables = pages.select("doc_id", "page_no", F.lit(False).alias("is_table"))
    assert R.select_pages(pages, fields, scores, top, tables).first().pages == [1, 2, 3, 4, 5, 6, 9]
    capped = R.select_pages(pages, fields, scores, top, tables, cap=5).first().pages
    assert set(capped) >= {1, 2, 3, 5} and len(capped) == 5


def test_salvage(spark):
    raw = spark.createDataFrame([(1, '{"a": {"x": 1}, "b": {"y": 2}, "c": {"z": ')], "id int, body string")
    assert [r.key for r in S.salvage(raw).orderBy("key").collect()] == ["a", "b"]


def test_unknown_clusters_are_an_error(spark):
    fields = spark.createDataFrame([("f", "c")], "field_key string, cluster string")
    assert R.cluster_subset(fields, fields, ["c"]).count() == 1
    with pytest.raises(ValueError, match="nowhere"):
        R.cluster_subset(fields, fields, ["c", "nowhere"])


def test_signs_that_fold_to_several(spark):
    df = spark.createDataFrame([("wait\u2026 for \u00bd of No\u2122",), ("a \ufb01ne",), ("plain ASCII ... text",)], "t string")
    assert [r.n for r in df.select(T.normalise(F.col("t")).alias("n")).collect()] == ["wait for 1\u20442 of notm", "a fine", "plain ascii text"]


def test_content_of_lists_and_maps(spark):
    rows = [(None, None, None), ("N/A", [" null ", ""], {}), ("x", None, None), (None, ["none", "y"], None), (None, [], {"k": ""})]
    df = spark.createDataFrame(rows, "t string, l array<string>, m map<string, string>")
    assert [r.c for r in df.select(T.has_content(F.col("t"), F.col("l"), F.col("m")).alias("c")).collect()] == [False, False, True, True, True]


def test_pages_of_empty_texts(spark):
    docs = spark.createDataFrame([(1, ""), (2, "a\nb\nc\nd\ne")], "doc_id int, text string")
    assert sorted(S.page_numbers(docs).collect()) == sorted(S.line_pages(docs).select("doc_id", "page_no").collect())
    got = S.line_pages(docs).orderBy("doc_id", "page_no").collect()
    assert [(r.doc_id, r.page_no, r.text) for r in got] == [(1, 1, ""), (2, 1, "a\nb\nc\nd"), (2, 2, "e")]


def test_expectation_fails_the_job(spark):
    df = spark.range(3)
    assert S.expect_rows(df, 3, "rows").first().state == "ok"
    with pytest.raises(Exception, match="4 rows expected"):
        S.expect_rows(spark.range(3), 4, "rows: 4 rows expected").collect()


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_a_form_of_a_date_searches_the_text_once(spark):
    """Groups are read from the match, and a verdict works both days out once."""
    df = spark.createDataFrame([("a", "b")], "t string, a string").repartition(2)
    assert _plan(df.select(T.extract_date(F.col("t")).alias("x"))).count("regexp_extract(") <= 4 * len(T.DATE_FORMS)
    assert _plan(df.select(G.date_verdict(F.col("t"), F.col("a")).alias("x"))).count("regexp_extract(") <= 8 * len(T.DATE_FORMS)


@pytest.mark.parametrize("text, day", [
    ("12/6/3/2026 then 6/3/2026", datetime.date(2026, 6, 3)), ("3 June 2026, 2026-06-04", datetime.date(2026, 6, 3)), ("2026-06-04 or 3 June 2026", datetime.date(2026, 6, 4)),
    ("2026-13-01 or June 3, 20261", None), ("31/12/99", datetime.date(1999, 12, 31)), ("20260603T10:00", datetime.date(2026, 6, 3)), ("no number", None)])
def test_dates_of_several_forms(spark, text, day):
    assert one(spark, T.extract_date(F.col("c")), c=text) == day


def test_similarity_is_worked_out_once(spark):
    df = spark.createDataFrame([("a", "b")], "a string, b string").repartition(2)
    assert _plan(df.select(T.token_set_similarity(F.col("a"), F.col("b")).alias("x"))).count("levenshtein(") == 1
    assert _plan(df.select(T.token_set_similarity(F.col("a"), F.col("b")).alias("x"))).count("array_distinct(") == 2


def test_similarity_equals_its_closed_form(spark):
    import random

    rng, rows = random.Random(2), [(None, "a"), ("", ""), ("a", "")]
    rows += [tuple(" ".join(rng.choice(("ab", "abc", "b", "Bd", "cde", "xyzzy")) for _ in range(rng.randint(1, 6))) for _ in "ab") for _ in range(150)]

    def edits(a, b):
        line = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            line, last = [i], line
            for j, y in enumerate(b, 1):
                line.append(min(last[j] + 1, line[j - 1] + 1, last[j - 1] + (x != y)))
        return line[-1]

    def want(a, b):
        if a is None or b is None:
            return None
        wa, wb = (set(x.lower().split(" ")) for x in (a, b))
        both, ra, rb = (" ".join(sorted(x)) for x in (wa & wb, wa - wb, wb - wa))
        n, whole = len(both), lambda m: len(both) + (1 if both and m else 0) + m
        if n and (not ra or not rb):
            return 100.0
        near = [200.0 * n / (n + whole(len(m))) if n else 0.0 for m in (ra, rb)]
        return max(*near, 100.0 * (1 - edits(ra, rb) / max(len(ra), len(rb), 1)))

    got = spark.createDataFrame(rows, "a string, b string").select("a", "b", T.token_set_similarity(F.col("a"), F.col("b")).alias("s")).collect()
    for r in got:
        assert (r.s is None) == (want(r.a, r.b) is None) and (r.s is None or abs(r.s - want(r.a, r.b)) < 1e-9), r


def test_tables_and_statements_stay_in_place(spark):
    """Lines of a page are neither dealt nor ordered again, and conditions on what is stated do not read it twice."""
    pages = spark.createDataFrame([(1, 1, "Due: 2026-06-03\n| a | b |\n|--|--|\n| x | 1 |\nText\n| c | d | e |\n| 1 | 2 | 3 |\n")], "doc_id int, page_no int, text string").repartition(2)
    cells = review.table_cells(pages)
    assert "Window" not in _plan(cells)
    got = sorted((r.table_no, r.row_no, r.col_no, r.header, r.cell, r.head) for r in cells.collect())
    assert got == [(1, 1, 0, "a", "x", "x"), (1, 1, 1, "b", "1", "x"), (5, 1, 0, "c", "1", "1"), (5, 1, 1, "d", "2", "1"), (5, 1, 2, "e", "3", "1")]
    dated = review.statements(pages).where("kind in ('date', 'amount')")
    assert _plan(dated).count("regexp_instr(") == len(T.DATE_FORMS)
    assert [(r.label, r.value) for r in dated.collect()] == [("due", "2026-06-03")]
