"""Dates, amounts, statements, cut records, medians and arriving records on small frames."""

import datetime
import itertools
import json
import random
import statistics

import pytest
from pyspark.sql import functions as F

from quillmark.functions import text as T
from quillmark.operators import review, score, serve
from quillmark.plans import fixtures as X
from quillmark.sources import tables as S
from quillmark.streaming import feeds

DAY = datetime.date(2026, 6, 3)


def written():
    """Some two hundred ways to write days, and texts that hold none."""
    out = []
    for day in (DAY, datetime.date(1999, 12, 31), datetime.date(2024, 2, 29), datetime.date(2031, 9, 1)):
        long, short, n, y = day.strftime("%B"), day.strftime("%b"), day.day, day.year
        nth = f"{n}{'th' if 10 < n % 100 < 14 else {1: 'st', 2: 'nd', 3: 'rd'}.get(n % 10, 'th')}"
        for m, d in itertools.product((long, short, short + ".", long.upper()), (str(n), nth, f"{n:02d}")):
            out += [(f"{m} {d}, {y}", day), (f"by {d} {m} {y} at noon", day), (f"{d} of {m}, {y}", day), (f"{y} {m} {d}", day)]
        out += [(f"{day:%Y-%m-%d}T23:30:00-07:00", day), (f"{day:%Y/%m/%d}", day), (f"{day:%Y%m%d}T101500", day), (f"{n}-{short}-{y % 100:02d}", day), (f"the {nth} day of {long} {y}", day),
                (f"{day.month}/{n}/{y}", day), (f"{short} {n} '{y % 100:02d} 2.00 PM MST", day), (f"Tuesday, {n}-{short}-{y}, 10:30 EST", day), (f"{y}.{day.month}.{n}", day)]
        out += [(f"{n}/{day.month}/{y}", day if n > 12 else datetime.date(y, n, day.month))]
    none = ["in June", "June 2026", "30 February 2026", "2026-13-01", "June 3, 10:30", "version 3.2.1", "call 555-12-2026-4", "31/31/2026", "", "12 monkeys 2026", "mayor 3, 2026", "20261301", None]
    return out + [(x, None) for x in none] + [("June 30, 2026, not 2025-01-01", datetime.date(2026, 6, 30)), ("2025-01-01, not June 30, 2026", datetime.date(2025, 1, 1))]


def test_written_dates(spark):
    forms = written()
    got = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(forms)], "k int, t string").select("k", T.extract_date(F.col("t")).alias("d")).collect()
    wrong = [(forms[r.k], r.d) for r in got if r.d != forms[r.k][1]]
    assert len(forms) > 200 and not wrong


@pytest.mark.parametrize("text, amount", [
    ("a fee of $1,200.5", "USD 1200.50"), ("USD 3 million", "USD 3000000.00"), ("1,500 CAD", "CAD 1500.00"), ("€12k", "EUR 12000.00"), ("5 million dollars", "USD 5000000.00"),
    ("no 12", None), ("12 of 13", None), (None, None), ("£0.99 each", "GBP 0.99"), ("C$7 and US$8", "CAD 7.00")])
def test_amounts(spark, text, amount):
    assert spark.createDataFrame([(text,)], "t string").select(T.extract_amount(F.col("t"))).first()[0] == amount


def closed(text):
    """Up to the last object that closes on the first level, character by character."""
    depth, quoted, escaped, good = 0, False, False, 0
    for i, c in enumerate(text):
        if quoted:
            escaped, quoted = (False, True) if escaped else (c == "\\", c != '"')
        elif c == '"':
            quoted = True
        elif c in "{[":
            depth += 1
        elif c in "}]":
            depth -= 1
            good = i + 1 if depth == 1 and c == "}" else good
    return text[:good] + "}" if text.startswith("{") and good else None


def test_records_cut_at_every_place(spark):
    whole = ['{"a": {"x": "}\\"{[", "l": [1, {"z": "\\\\"}]}, "é\U0001d518": {"y": {"q": []}}, "n": 7, "c": {"k": {"d": "]"}}}', '{"a": {"b": {"c": {"d": 1}}}, "e": [{"f": 2}], "g": {}}']
    cuts = [w[:k] for w in whole for k in range(len(w) + 1)]
    raw = spark.createDataFrame(list(enumerate(cuts)), "i int, body string")
    parts = {r.i: r.p for r in raw.select("i", T.closed_part(F.col("body")).alias("p")).collect()}
    assert parts == {i: closed(c) for i, c in enumerate(cuts)}
    got = {}
    for r in S.salvage_nested(raw).collect():
        got.setdefault(r.i, {})[r.key] = r.member
    for i, c in enumerate(cuts):
        try:
            want = json.loads(c)
        except ValueError:
            want = json.loads(closed(c)) if closed(c) else None
        assert {k: json.loads(v) for k, v in got.get(i, {}).items()} == (want or {}), c


@pytest.mark.parametrize("bins", [2, 1024])
def test_exact_median(spark, bins):
    rng = random.Random(2)
    groups = {"one": [3.5], "two": [1.0, 2.0], "ties": [5.0] * 40 + [6.0], "wide": [10.0 ** rng.randrange(-9, 9) for _ in range(101)], "many": [rng.gauss(0, 1) for _ in range(600)], None: [1.0, -4.0, 2.0]}
    rows = [(g, v) for g, vs in groups.items() for v in vs] + [("one", None), ("none", None)]
    got = score.exact_median(spark.createDataFrame(rows, "g string, v double"), ["g"], "v", bins)
    assert {r.g: r.median for r in got.collect()} == {g: statistics.median(v) for g, v in groups.items()}


PAPER = """Tender 12
Closing date: June 3, 2026
Contract value ..... $1.5 million
closing  DATE = 2026-06-03
Contact - Ann

| Criterion | Weight | Notes |
|-----------|--------|-------|
| Price | 40% | a |
| Quality | 35 % | b |
| Subtotal | 75% | |
| Team | 20% | c |

Minimum score: 96 points
Contract value: USD 1,500,000.00
Closing date: 4 June 2026"""


def test_statements_and_tables(spark):
    pages = spark.createDataFrame([(1, 1, PAPER), (2, 1, "Minimum score: 60\nItem\tPoints\nA\t50\nB\t50"), (3, 1, None), (4, 1, "")], "doc_id int, page_no int, text string")
    stated = review.statements(pages)
    assert {(r.label, r.kind, r.value) for r in stated.where("doc_id = 1").collect()} >= {("closing date", "date", "2026-06-03"), ("contract value", "amount", "USD 1500000.00"), ("minimum score", "number", "96.0"), ("contact", "text", "ann")}
    assert [(r.doc_id, r.label, r.n, r["values"]) for r in review.conflicts(stated).collect()] == [(1, "closing date", 2, ["2026-06-03", "2026-06-04"])]
    sums = review.weight_sums(review.table_cells(pages))
    assert {(r.doc_id, r.total) for r in sums.collect()} == {(1, 95.0), (2, 100.0)}
    assert [tuple(r) for r in review.minimum_breaches(stated, sums).collect()] == [(1, "minimum score", 96.0, 95.0)]


def test_contacts_are_compared_by_address_else_name(spark):
    rows = [("A@x.org", "Ann", "q"), ("", "Ann  Bee", "q"), (None, None, "Q")]
    df = spark.createDataFrame(rows, "e string, n string, t string")
    out = df.select(serve.comparable(F.lit("contact"), F.lit(True), F.col("t"), F.lit(None).cast("array<string>"), F.col("e"), F.col("n")).alias("s"))
    assert [r.s for r in out.collect()] == ["a@x.org", "ann bee", "q"]


def test_agreement(spark):
    a = spark.createDataFrame([(1, 0, "f", "x"), (1, 1, "f", "x"), (2, 0, "f", "x"), (2, 1, "f", "y"), (3, 0, "f", "x")], "doc_id int, backend int, field_key string, shown string")
    assert score.agreement_ratio(score.agreement(a), ["field_key"]).first()[1:] == (2, 1, 0.5)
    assert [tuple(r) for r in score.disagreements(a).collect()] == [(2, "f", "0: x; 1: y")]


def rows(spark, *said):
    return spark.createDataFrame(list(said), "k int, v string, version int")


def test_upserts_replay_and_compaction(spark, tmp_path):
    table = feeds.Upserts(spark, str(tmp_path / "t"), ["k"], "version")
    seen = lambda: sorted((r.k, r.v) for r in table.read().collect())
    table.put(rows(spark, (1, "a", 1), (2, "b", 1)), 0)
    table.put(rows(spark, (2, "old", 0), (3, "c", 1)), 1)
    want = [(1, "a"), (2, "b"), (3, "c")]
    assert seen() == want
    table.put(rows(spark, (2, "old", 0), (3, "c", 1)), 1)  # comes again
    assert seen() == want
    table.compact()
    table.put(rows(spark, (1, "late replay", 9)), 0)  # is in the base already
    assert seen() == want and table._numbers("batch") == [] and table._numbers("base") == [1]
    table.put(rows(spark, (1, "new", 1)), 2)  # equal version: the later batch
    (tmp_path / "t" / "batch-7").mkdir()  # a lost job left an unfinished one
    assert seen() == [(1, "new"), (2, "b"), (3, "c")]
    table.compact()
    table.compact()
    assert seen() == [(1, "new"), (2, "b"), (3, "c")] and table._numbers("base") == [2]


def test_scored_feed_equals_one_batch(spark, tmp_path):
    table = feeds.Upserts(spark, str(tmp_path / "t"), ["k"], "version")
    for n, part in enumerate([[(1, "a", 1), (2, "b", 1)], [(3, "c", 1)], [(1, "older", 0), (3, "newer", 2)]]):
        rows(spark, *part).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema("k int, v string, version int").parquet(str(tmp_path / "in"))
        feeds.scored_feed(stream, table, str(tmp_path / "log"), lambda b: b.withColumn("v", F.upper("v")), every=2)
    assert sorted((r.k, r.v) for r in table.read().collect()) == [(1, "A"), (2, "B"), (3, "NEWER")]


def test_summaries_of_documents_without_calls_or_pages(spark):
    rates = spark.createDataFrame([(1, 10, 2, 1, 1.0, 0.0), (1, 11, 0, 3, None, None), (2, 10, 4, 0, 0.5, 0.5)], "b int, doc_id long, asserted long, absent long, groundedness double, hallucination double")
    calls = spark.createDataFrame([(1, 10, 2.0, 4.0), (1, 10, 1.5, 2.0), (1, 99, 7.0, 7.0)], "b int, doc_id long, cost double, latency double")
    got = {r.b: tuple(r)[1:] for r in score.run_summary(rates, calls, ["b"]).collect()}
    assert got == {1: (2, 2, 4, 1.0, 0.0, 3.5, 3.0), 2: (1, 4, 0, 0.5, 0.5, 0.0, 0.0)}
    shown = spark.createDataFrame([("a", 1, "found", "high"), ("a", 1, "needs_review", "low"), ("a", 2, "not_found", "low"), ("b", 2, "found", "high")], "m string, doc_id long, status string, bucket string")
    pages = spark.createDataFrame([(1, 1), (1, 2), (3, 1)], "doc_id long, page_no int")
    got = {r.m: tuple(r)[1:] for r in score.tiles(shown, pages, ["m"]).collect()}
    assert got == {"a": (1, 1, 1, 33.33, 2), "b": (1, 0, 0, 100.0, 0)}
    assert score.run_summary(rates.where("false"), calls, ["b"]).count() == 0 and score.tiles(shown.where("false"), pages, ["m"]).count() == 0


def test_uncited_documents_are_left_out_before_they_are_cut(spark, capsys):
    docs = spark.createDataFrame([(k, "a\nb\nc\nd\ne") for k in (1, 2, 3)] + [(None, "x"), (4, None)], "doc_id long, text string")
    rows = spark.createDataFrame([(1,), (3,), (3,), (4,), (None,)], "doc_id long")
    got = X.pages_of(docs, rows)
    assert sorted(map(tuple, got.collect())) == [(k, n, t) for k in (1, 3) for n, t in ((1, "a\nb\nc\nd"), (2, "e"))]
    got.explain(extended=True)
    plan = capsys.readouterr().out.split("== Optimized Logical Plan ==")[1].split("== Physical Plan ==")[0]
    assert plan.index("Generate") < plan.index("LeftSemi")  # the join stands below
