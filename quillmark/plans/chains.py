"""Queries over texts that state things, records that were cut, and records that arrive one after another."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as Y

from quillmark.functions import text as T
from quillmark.operators import evidence as E
from quillmark.operators import grade as G
from quillmark.operators import retrieve as R
from quillmark.operators import review, score, serve
from quillmark.plans import catalog as C
from quillmark.plans import fixtures as X
from quillmark.plans.oracle import token_set
from quillmark.sources import tables as S
from quillmark.streaming import feeds

query = C.query


# --- salvage

#: A record of three members per order: nested, with brackets and quotation marks inside strings.
_MEMBERS = (
    """'"first": {"price": {"value": ' || o_totalprice || ', "note": "about {[' || o_orderpriority || ']}"}}'""",
    """'"second": {"rows": [{"k": 1}, {"k": ' || o_custkey || '}], "said": "so \\\\" } {"}'""",
    """'"third": {"state": "' || o_orderstatus || '"}'""",
)


def _cut_orders(spark, d):
    """Records of orders, cut after a number of characters that depends on the order; every fifth is whole."""
    body = "'{' || " + " || ', ' || ".join(m.replace("|| o_totalprice ||", "|| cast(o_totalprice as decimal(18,2)) ||") for m in _MEMBERS) + " || '}'"
    rows = S.table(spark, d, "orders").select("o_orderkey", F.expr(body).alias("body"))
    keep = F.when(F.col("o_orderkey") % 5 == 0, F.length("body")).otherwise(F.pmod(37 * F.col("o_orderkey"), F.length("body")).cast("int"))
    return rows.select("o_orderkey", F.substring("body", F.lit(1), keep).alias("body"))


_LENGTHS = ", ".join(f"length({m}) AS n{k}" for k, m in enumerate(_MEMBERS)).replace("|| o_totalprice ||", "|| CAST(o_totalprice AS DECIMAL(18,2)) ||").replace('\\\\"', '\\"')


@query(f"SELECT o_orderkey, whole AS complete, len(list_filter([1 + n0, 3 + n0 + n1, 5 + n0 + n1 + n2], lambda e: whole OR e <= cut)) AS members, CASE WHEN whole OR 3 + n0 + n1 <= cut THEN o_custkey END AS customer FROM (SELECT *, n0 + n1 + n2 + 6 AS n, o_orderkey % 5 = 0 AS whole, 37 * o_orderkey % (n0 + n1 + n2 + 6) AS cut FROM (SELECT o_orderkey, o_custkey, {_LENGTHS} FROM orders)) WHERE whole OR 1 + n0 <= cut")
def n19_nested(spark, d):
    """What is left of records that were cut, and a value from deep inside them."""
    out = S.salvage_nested(_cut_orders(spark, d))
    deep = F.max(F.when(F.col("key") == "second", F.get_json_object("member", "$.rows[1].k").cast("long")))
    return out.groupBy("o_orderkey", "complete").agg(F.count("*").alias("members"), deep.alias("customer"))


# --- statements

#: How a day is written, by number: pattern of Spark, of DuckDB.
WRITTEN = (("yyyy-MM-dd", "%Y-%m-%d"), ("MMMM d, yyyy", "%B %-d, %Y"), ("d MMM yyyy", "%-d %b %Y"), ("EEE, d-MMM-yy", "%a, %-d-%b-%y"), ("yyyy/M/d", "%Y/%-m/%-d"), ("M/d/yyyy", "%-m/%-d/%Y"), ("MMM d yy", "%b %-d %y"))


def _written(day, k):
    out = F.date_format(day, WRITTEN[0][0])
    for n, (form, _) in enumerate(WRITTEN[1:], 1):
        out = F.when(k == n, F.date_format(day, form)).otherwise(out)
    return out


@query("SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day FROM orders")
def n6_grammar(spark, d):
    """Order dates in seven written forms, read back."""
    o = S.table(spark, d, "orders").withColumn("k", F.pmod("o_orderkey", F.lit(len(WRITTEN))))
    said = F.concat(F.lit("No later than "), _written(F.to_date("o_orderdate"), F.col("k")), F.lit(" at 2.00 PM MST"))
    return o.select("o_orderkey", T.extract_date(said).alias("day"))


def _order_papers(spark, d):
    """A text per customer: a line for the date and one for the price of each order, written in turn in several ways."""
    o = S.table(spark, d, "orders").where("o_custkey is not null")
    k = F.pmod("o_orderkey", F.lit(len(WRITTEN)))
    price = F.col("o_totalprice").cast("decimal(18,2)")
    money = F.when(k % 2 == 0, F.concat(F.lit("$"), F.format_number(price, 2))).otherwise(F.concat(F.lit("USD "), price.cast("string")))
    lines = F.concat(F.lit("Closing date ("), F.col("o_orderpriority"), F.lit("): "), _written(F.to_date("o_orderdate"), k), F.lit("\nBudget for status "), F.col("o_orderstatus"), F.lit(" ..... "), money)
    text = F.array_join(F.array_sort(F.collect_list(lines)), "\n")
    return o.groupBy(F.col("o_custkey").alias("doc_id")).agg(text.alias("text")).withColumn("page_no", F.lit(1))


@query("SELECT doc_id, label, kind, CAST(count(*) AS INT) AS n, string_agg(value, ', ' ORDER BY value) AS stated FROM (SELECT DISTINCT o_custkey AS doc_id, 'closing date (' || lower(o_orderpriority) || ')' AS label, 'date' AS kind, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS value FROM orders UNION SELECT o_custkey, 'budget for status ' || lower(o_orderstatus), 'amount', 'USD ' || CAST(o_totalprice AS DECIMAL(24,2)) FROM orders) GROUP BY ALL HAVING count(*) > 1")
def v2_text_conflicts(spark, d):
    """Dates and amounts that a text states in more than one way under one label."""
    out = review.conflicts(review.statements(_order_papers(spark, d)))
    return out.select("doc_id", "label", "kind", "n", F.array_join("values", ", ").alias("stated"))


def _scoring_papers(spark, d):
    """A text per order: a table of parts and weights, with a total, and a minimum score."""
    q = F.col("l_quantity").cast("decimal(12,1)").cast("string")
    row = F.concat(F.lit("| part "), F.col("l_partkey").cast("string"), F.lit(" line "), F.col("l_linenumber").cast("string"), F.lit(" | "), q, F.lit("% |"))
    out = S.table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("doc_id")).agg(F.array_join(F.array_sort(F.collect_list(row)), "\n").alias("rows"))
    least = (F.pmod("doc_id", F.lit(3)) * 60).cast("string")
    text = F.concat(F.lit("Evaluation of offers\n\n| Criterion | Weight |\n|---|---|\n"), F.col("rows"), F.lit("\n| Total | 100% |\n\nMinimum score: "), least, F.lit(" points\n"))
    return out.select("doc_id", F.lit(1).alias("page_no"), text.alias("text"))


@query("SELECT l_orderkey AS doc_id, round(sum(CAST(l_quantity AS DECIMAL(12,1))), 6)::DOUBLE AS total FROM lineitem GROUP BY l_orderkey HAVING sum(CAST(l_quantity AS DECIMAL(12,1))) <> 100")
def v5_text_weights(spark, d):
    """Tables in texts of which the weights do not sum to 100."""
    sums = review.weight_sums(review.table_cells(_scoring_papers(spark, d)))
    return sums.where("total <> 100").select("doc_id", "total")


@query("SELECT l_orderkey AS doc_id, CAST(l_orderkey % 3 * 60 AS DOUBLE) AS minimum, round(sum(CAST(l_quantity AS DECIMAL(12,1))), 6)::DOUBLE AS most FROM lineitem GROUP BY l_orderkey HAVING l_orderkey % 3 * 60 > sum(CAST(l_quantity AS DECIMAL(12,1)))")
def v5_text_minimum(spark, d):
    """Stated minimum scores that the table beside them cannot reach."""
    papers = S.kept(_scoring_papers(spark, d))
    return review.minimum_breaches(review.statements(papers), review.weight_sums(review.table_cells(papers))).select("doc_id", "minimum", "most")


# --- agreement


def _shown(spark, d):
    """What three backends say of a document's contact and list fields, as it is compared."""
    a = X.answers(spark, d).where("a_present")
    k = F.pmod(F.col("doc_id") + 2 * F.col("backend"), F.lit(7))
    rows = a.select("backend", "doc_id", F.explode(F.array(
        F.struct(F.lit("contact").alias("field_key"), F.lit("contact").alias("kind"), F.when(k != 0, F.concat(F.lit("Desk"), F.col("doc_id").cast("string"), F.lit("@Mail.example"))).alias("email"), F.lit(None).cast("array<string>").alias("items")),
        F.struct(F.lit("items").alias("field_key"), F.lit("list").alias("kind"), F.lit(None).cast("string").alias("email"), F.when(k < 5, F.array(F.lit("Beta"), F.lit("alpha"))).otherwise(F.array(F.lit("ALPHA"), F.lit("gamma"))).alias("items")))).alias("f")).select("backend", "doc_id", "f.*")
    return rows.withColumn("shown", serve.comparable(F.col("kind"), F.lit(True), F.lit(""), F.col("items"), F.col("email"), F.concat(F.lit("Ann "), F.col("doc_id").cast("string"))))


SHOWN = "WITH shown AS (SELECT backend, doc_id, f AS field_key, CASE WHEN f = 'contact' THEN CASE WHEN k <> 0 THEN 'desk' || doc_id || '@mail.example' ELSE 'ann ' || doc_id END WHEN k < 5 THEN 'alpha | beta' ELSE 'alpha | gamma' END AS shown FROM (SELECT backend, doc_id, (doc_id + 2 * backend) % 7 AS k, unnest(['contact', 'items']) AS f FROM ({answers}) WHERE a_present))\n"


@query()
def a13_ratio(spark, d):
    """Share of fields on which all backends that answer agree."""
    return score.agreement_ratio(score.agreement(_shown(spark, d)), ["field_key"])


@query()
def a13_disagreements(spark, d):
    """The fields on which they do not, and what each says."""
    return score.disagreements(_shown(spark, d)).select("doc_id", "field_key", "values")


_ANSWERS = SHOWN.replace("{answers}", C.sql("SELECT * FROM answers", "answers"))
C.ORACLES["a13_ratio"] = _ANSWERS + "SELECT field_key, count(*) AS fields, count(*) FILTER (WHERE kinds = 1) AS agreeing, round(count(*) FILTER (WHERE kinds = 1) / count(*), 4) AS ratio FROM (SELECT doc_id, field_key, count(DISTINCT shown) AS kinds FROM shown GROUP BY ALL HAVING count(*) >= 2) GROUP BY field_key"
C.ORACLES["a13_disagreements"] = _ANSWERS + "SELECT doc_id, field_key, string_agg(backend || ': ' || shown, '; ' ORDER BY backend) AS values FROM shown GROUP BY doc_id, field_key HAVING count(DISTINCT shown) > 1"


# --- values of any type


def _values(spark, d):
    """Stored values of five types, one per part, as VARIANTs."""
    json = """case p_partkey % 5 when 0 then '{"name": "' || p_name || '", "email": "' || if(p_partkey % 2 = 0, upper(p_brand) || '@x.org', '') || '", "phone": null}'
      when 1 then '["' || p_type || '", {"criterion": "' || p_name || '", "weight": 5}, ""]' when 2 then '{"value": ' || p_size || ', "unit": "mm"}' when 3 then if(p_size > 25, 'true', 'false') else cast(p_size as string) || '.50' end"""
    return S.table(spark, d, "part").select("p_partkey", F.parse_json(F.expr(json)).alias("v"))


@query("SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN p_name || CASE WHEN p_partkey % 2 = 0 THEN ' — ' || upper(p_brand) || '@x.org' ELSE '' END WHEN 1 THEN p_type || '; ' || p_name WHEN 2 THEN p_size || ' mm' WHEN 3 THEN CASE WHEN p_size > 25 THEN 'Yes' ELSE 'No' END ELSE p_size || '.5' END AS shown, "
       "CASE p_partkey % 5 WHEN 0 THEN CASE WHEN p_partkey % 2 = 0 THEN lower(p_brand) || '@x.org' ELSE p_name END WHEN 1 THEN '| ' || array_to_string(list_sort([lower(p_type), lower(p_name)]), ' | ') WHEN 2 THEN p_size || ' mm' WHEN 3 THEN CASE WHEN p_size > 25 THEN 'yes' ELSE 'no' END ELSE p_size || '.5' END AS compared, CASE WHEN p_partkey % 5 = 1 THEN len(list_distinct([lower(p_type), lower(p_name)])) END AS items FROM part")
def p2_typed(spark, d):
    """Values shown, compared and listed by their own type."""
    v = F.col("v")
    compared = serve.typed_comparable(v, F.lit(True))
    items = F.when(F.col("p_partkey") % 5 == 1, F.size(G.variant_set(v))).cast("long")
    return _values(spark, d).select("p_partkey", serve.typed_text(v).alias("shown"), compared.alias("compared"), items.alias("items"))


#: The contract of a stored order: every member, at every depth.
ORDER_CONTRACT = {"id": "number", "state": {"code": "string", "paid": {"total": "number", "currency": "string|null"}}, "lines": [{"part": "number", "note": "string"}]}


@query("SELECT o_orderkey, unnest(list_filter([CASE WHEN o_orderkey % 3 = 0 THEN '$.state.paid.currency missing' END, CASE WHEN o_orderkey % 4 = 0 THEN '$.state.paid.rate extra' END, CASE WHEN o_orderkey % 5 = 0 THEN '$.state.paid.total wrong type' END, CASE WHEN o_orderkey % 7 = 0 THEN '$.lines[].part wrong type' END, CASE WHEN o_orderkey % 11 = 0 THEN '$.lines[].note missing' END], lambda x: x IS NOT NULL)) AS breach FROM orders")
def q2_nested(spark, d):
    """Members of stored orders that are missing, too many or of a wrong type, down to the third level."""
    json = """'{"id": ' || o_orderkey || ', "state": {"code": "' || o_orderstatus || '", "paid": {"total": ' || if(o_orderkey % 5 = 0, '"much"', '12.5') || if(o_orderkey % 3 = 0, '', ', "currency": null')
      || if(o_orderkey % 4 = 0, ', "rate": 1', '') || '}}, "lines": [{"part": ' || if(o_orderkey % 7 = 0, 'true', '3') || if(o_orderkey % 11 = 0, '', ', "note": "x"') || '}' || if(o_orderkey % 11 = 0, '', ', {"part": 4, "note": ""}') || ']}'"""
    rows = S.table(spark, d, "orders").select("o_orderkey", F.parse_json(F.expr(json)).alias("v"))
    return S.nested_breaches(rows, ["o_orderkey"], "v", ORDER_CONTRACT).select("o_orderkey", F.concat_ws(" ", "path", "breach").alias("breach"))


# --- files


def _text_files(docs, path: str) -> None:
    """A file for every sixteenth of a source."""
    rows = docs.where("text is not null").select(F.col("source").alias("s"), F.pmod("doc_id", F.lit(16)).alias("part"), "doc_id", "text")
    rows.repartition("s", "part").sortWithinPartitions("s", "part", "doc_id").select("s", "part", F.regexp_replace("text", "\n", " ").alias("value")).write.mode("overwrite").partitionBy("s", "part").text(path)


@query("SELECT key, CASE WHEN bool_and(doc_id % 16 = 3) THEN 'removed' WHEN bool_and(doc_id % 16 = 5) THEN 'added' WHEN bool_or(doc_id % 50 = 0) THEN 'changed' ELSE 'same' END AS change FROM (SELECT 's=' || source || '/part=' || doc_id % 16 AS key, doc_id FROM documents WHERE text IS NOT NULL) GROUP BY key")
def s9_file_drift(spark, d):
    """Two states of a folder of text files, held against each other by content."""
    docs = S.table(spark, d, "documents")
    one, two = (f"{S.shared_dir(spark).rstrip('/')}/files-{uuid.uuid4().hex}" for _ in range(2))
    _text_files(docs.where(F.pmod("doc_id", F.lit(16)) != 5), one)
    _text_files(docs.where(F.pmod("doc_id", F.lit(16)) != 3).withColumn("text", F.when(F.pmod("doc_id", F.lit(50)) == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))), two)
    key = F.regexp_extract("path", r"(s=[^/]*/part=[^/]*)/[^/]*$", 1)
    return S.drift(*[S.manifest(spark, p).withColumn("key", key) for p in (one, two)], "key")


# --- records that arrive

_KEY = ["b", "doc_id", "item_id", "page"]


def _chain(records, pages, truth):
    """Verified and graded answers of a batch: where the quote stands, and how near it comes to the passage asked for."""
    checked = S.kept(E.verify(records.withColumn("page", F.coalesce("page", F.lit(-1))), pages, _KEY))
    near = T.token_set_similarity(F.col("quote"), F.col("wanted"))
    compared = G.banded(F.coalesce(near, F.lit(0.0)), G.TEXT_GOOD, G.TEXT_SOME)
    verdict = G.presence(F.lit(True), F.lit(True), F.col("present"), T.has_content(F.col("quote"), F.lit(None).cast("array<string>"), F.lit(None).cast("map<string,string>")), compared)
    return checked.join(truth, "item_id").select("b", "doc_id", "item_id", "page", "version", "status", "found_on_page", "best_score", verdict.alias("verdict"))


@query(f"SELECT b, doc_id, e.item_id, status, best_score, CASE WHEN NOT present AND lower(trim(coalesce(quote, ''))) IN ('', 'null', 'none', 'n/a') THEN 'wrong' WHEN quote IS NULL THEN 'wrong' WHEN near >= 70 THEN 'correct' WHEN near >= 40 THEN 'partial' ELSE 'wrong' END AS verdict FROM (SELECT e.*, {token_set('e.quote', 't.text')} AS near FROM evidence e JOIN benchmark t ON t.item_id = e.item_id) e", "evidence")
def m1_chain(spark, d):
    """Records come in three files and are verified and graded as they come; then the first comes again in an
    older version, and part of it in a newer one. The table is compacted on the way."""
    top = f"{S.shared_dir(spark).rstrip('/')}/chain-{uuid.uuid4().hex}"
    records = S.kept(X.quotes(spark, d))
    # no batch goes through the documents that no record cites
    docs = S.kept(S.table(spark, d, "documents").select("doc_id", "text").join(records.select("doc_id").distinct(), "doc_id", "left_semi"))
    part = lambda n: records.where(F.pmod("doc_id", F.lit(3)) == n).withColumn("version", F.lit(1))
    spoilt = part(0).withColumn("quote", F.lit("an older and quite wrong quotation")).withColumn("version", F.lit(0))
    truth = S.table(spark, d, "benchmark").select("item_id", F.col("text").alias("wanted"))
    table = feeds.Upserts(spark, f"{top}/rows", _KEY, "version")
    schema = Y.StructType(part(0).schema.fields)
    for n, rows in enumerate((part(0), part(1), part(2), spoilt, part(0).where("item_id % 2 = 0").withColumn("version", F.lit(2)))):
        rows.write.mode("append").parquet(f"{top}/in")
        stream = spark.readStream.schema(schema).parquet(f"{top}/in")
        feeds.scored_feed(stream, table, f"{top}/log", lambda batch: _chain(batch, X.pages_of(docs, batch), truth), every=2)
    return table.read().select("b", "doc_id", "item_id", "status", "best_score", "verdict")


# --- views that reach every case of their operator


@query("SELECT b, doc_id, item_id, CASE WHEN item_id % 6 = 5 THEN 'manual review' ELSE CASE status WHEN 'verified' THEN 'low confidence' WHEN 'wrong_page' THEN 'found on another page' WHEN 'unverified' THEN 'quote not found' WHEN 'no_quote' THEN 'no quote given' ELSE 'manual review' END END AS reason FROM evidence", "evidence")
def p7_reasons(spark, d):
    """Why each verified answer is to be reviewed, also where no check was made."""
    checked = F.when(F.col("item_id") % 6 != 5, F.col("status"))
    return C._verified(spark, d).select("b", "doc_id", "item_id", score.review_reason(checked).alias("reason"))


@query(f"SELECT backend, difficulty, field_key, doc_id, {C.COUNTS}, CAST(grouping(backend, difficulty, field_key, doc_id) AS INT) AS grain FROM graded GROUP BY GROUPING SETS ((), (backend), (difficulty), (field_key), (doc_id))", "graded")
def a4_document_grain(spark, d):
    """Overall, by backend, difficulty, field and document in one pass."""
    return score.multi_grain(C._graded(spark, d), ["backend", "difficulty", "field_key", "doc_id"])


@query("SELECT doc_id, field_key, " + ", ".join(f"max(said) FILTER (WHERE backend = {k}) AS m{k}" for k in range(3)) + " FROM (SELECT *, verdict || ': ' || coalesce(CAST(a AS VARCHAR), 'no answer') || ', ' || CASE status WHEN 'verified' THEN 'low confidence' WHEN 'wrong_page' THEN 'found on another page' ELSE 'quote not found' END AS said FROM graded) GROUP BY doc_id, field_key", "graded")
def a20_answers(spark, d):
    """Verdict, answer and reason of every backend beside each other, by document and field."""
    said = F.concat("verdict", F.lit(": "), F.coalesce(F.col("a").cast("string"), F.lit("no answer")), F.lit(", "), score.review_reason(F.col("status")))
    rows = C._graded(spark, d).withColumn("said", said).groupBy("doc_id", "field_key").pivot("backend", [0, 1, 2]).agg(F.first("said"))
    return rows.select("doc_id", "field_key", *[F.col(str(k)).alias(f"m{k}") for k in range(3)])


@query("SELECT p.doc_id, p.page_no, p.page_no + s AS cited, n.doc_id IS NOT NULL AS inside FROM doc_pages p CROSS JOIN (SELECT unnest([-2, -1, 0, 1, 2]) AS s) LEFT JOIN (SELECT doc_id, page_no FROM doc_pages) n ON n.doc_id = p.doc_id AND n.page_no = p.page_no + s", "doc_pages")
def f13_both_bounds(spark, d):
    """Cited pages before, on and after each page, and whether the document has them."""
    last = F.max("page_no").over(C.W.partitionBy("doc_id"))
    at = X.numbers(spark, d).withColumn("last", last).select("doc_id", "page_no", "last", F.explode(F.array(*[F.col("page_no") + k for k in (-2, -1, 0, 1, 2)])).alias("cited"))
    return at.select("doc_id", "page_no", "cited", F.col("cited").between(1, F.col("last")).alias("inside"))


def _ruled(spark, d):
    """A text per customer: one sentence an order, of which the status decides between a firm and a loose modal."""
    modal = F.element_at(F.create_map(*[F.lit(x) for kv in {"F": "shall", "O": "may", "P": "should"}.items() for x in kv]), F.col("o_orderstatus"))
    said = F.concat(F.lit("Clause "), F.regexp_extract("o_orderpriority", r"^(\d)", 1), F.lit(" of the contract "), F.coalesce(modal, F.lit("must")), F.lit(" be met in full."))
    o = S.table(spark, d, "orders")
    return o.groupBy(F.col("o_custkey").alias("doc_id")).agg(F.array_join(F.array_sort(F.collect_list(said)), "\n").alias("text")).withColumn("page_no", F.lit(1))


@query("SELECT o_custkey AS doc_id, 'clause ' || left(o_orderpriority, 1) AS head, count(*) FILTER (WHERE coalesce(o_orderstatus, 'x') NOT IN ('O', 'P')) AS firm, count(*) FILTER (WHERE o_orderstatus IN ('O', 'P')) AS loose FROM orders GROUP BY ALL HAVING firm > 0 AND loose > 0")
def v4_rules(spark, d):
    """Clauses that a text puts once as a duty and once as a choice."""
    return review.modal_clashes(_ruled(spark, d), "shall|must", "should|may")


_NEAR = token_set("text", "nxt")


@query(f"SELECT conv_id, turn, verdict, verdict <> 'correct' AND (similarity BETWEEN 60 AND 99.999999 OR (coverage >= 0.8 AND coverage < 1)) AS mismatch FROM (SELECT *, CASE WHEN similarity >= 70 THEN 'correct' WHEN similarity >= 40 THEN 'partial' ELSE 'wrong' END AS verdict FROM (SELECT conv_id, turn, {_NEAR} AS similarity, CAST(len(list_filter(tw, x -> list_contains(nw, x))) AS DOUBLE) / nullif(len(tw), 0) AS coverage FROM (SELECT *, list_distinct(string_split(lower(text), ' ')) AS tw, list_distinct(string_split(lower(nxt), ' ')) AS nw FROM (SELECT conv_id, turn, text, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS nxt FROM conversations)) WHERE nxt IS NOT NULL))".replace("x -> ", "lambda x: "))
def g12_texts(spark, d):
    """Turns whose verdict against the next turn is at odds with their likeness or the share of their words there."""
    rows = S.table(spark, d, "conversations").withColumn("nxt", F.lead("text").over(C.W.partitionBy("conv_id").orderBy("turn"))).where("nxt is not null")
    words = lambda c: F.array_distinct(F.split(F.lower(c), " "))
    rows = rows.withColumn("similarity", T.token_set_similarity(F.col("text"), F.col("nxt"))).withColumn("coverage", T.containment(words("text"), words("nxt")))
    verdict = G.banded(F.col("similarity"), G.TEXT_GOOD, G.TEXT_SOME)
    return rows.select("conv_id", "turn", verdict.alias("verdict"), G.mismatch(verdict, F.col("similarity"), F.col("coverage")).alias("mismatch"))


@query("SELECT cluster, greatest(8, count(*) + 5) AS k, string_agg(field_key, ',' ORDER BY number) AS listed FROM (SELECT p_type AS cluster, p_name AS field_key, min(p_partkey) AS number FROM part GROUP BY ALL) GROUP BY cluster")
def r8_part_fields(spark, d):
    """Budgets and listings of clusters whose fields are the names of parts."""
    f = S.table(spark, d, "part").groupBy(F.col("p_type").alias("cluster"), F.col("p_name").alias("field_key")).agg(F.min("p_partkey").alias("number"))
    names = f.groupBy("cluster").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("number", "field_key"))), lambda x: x["field_key"]), ",").alias("listed"))
    return R.budget(f).join(names, "cluster").select("cluster", "k", "listed")


@query("SELECT doc_id, field_key, page_no, round(coalesce(1.0 / (60 + v.rank), 0) + coalesce(1.0 / (60 + k.rank), 0), 9) AS score FROM vrank v FULL JOIN (SELECT doc_id, CAST(number AS VARCHAR) AS field_key, page_no, rank FROM krank JOIN fields USING (field_key)) k USING (doc_id, field_key, page_no)", "vrank", "krank", "fields")
def r5_all_fields(spark, d):
    """Both rankings fused for every field; a field's number names its vector."""
    v = R.ranked(R.vector_scores(X.page_vectors(spark, d), X.field_vectors(spark, d), ["field_key"]), ["field_key"])
    k = R.ranked(C._kscores(spark, d), ["field_key"]).join(F.broadcast(X.fields(spark).select("field_key", "number")), "field_key")
    k = k.select("doc_id", F.col("number").cast("string").alias("field_key"), "page_no", "rank")
    return R.fusion_scores(v, k, ["field_key"]).select("doc_id", "field_key", "page_no", F.round("score", 9).alias("score"))


# --- summaries that span several tables


@query(f"SELECT b, count(*) AS docs, CAST(sum(asserted) AS BIGINT) AS present, CAST(sum(absent) AS BIGINT) AS absent, round(avg(groundedness), 4) AS groundedness, round(avg(hallucination), 4) AS hallucination, round(coalesce(sum(cost), 0), 2) AS cost, round(coalesce(sum(latency), 0) / count(*), 4) AS latency_per_doc FROM (SELECT b, doc_id, {C.RATES} FROM evidence GROUP BY b, doc_id) LEFT JOIN (SELECT l_linenumber % 3 AS b, l_orderkey AS doc_id, sum(CAST(l_extendedprice AS DOUBLE)) AS cost, sum(CAST(l_quantity AS DOUBLE)) AS latency FROM lineitem GROUP BY ALL) USING (b, doc_id) GROUP BY b", "evidence")
def a12_run_costs(spark, d):
    """The run summary with what each document's calls cost and took; order lines stand in for calls."""
    spent = S.table(spark, d, "lineitem").select((F.col("l_linenumber") % 3).cast("int").alias("b"), F.col("l_orderkey").alias("doc_id"),
                                                 F.col("l_extendedprice").cast("double").alias("cost"), F.col("l_quantity").cast("double").alias("latency"))
    return score.run_summary(E.rates(C._verified(spark, d), ["b", "doc_id"]), spent, ["b"])


@query("SELECT backend, CAST(sum(found) AS BIGINT) AS found, CAST(sum(missing) AS BIGINT) AS missing, CAST(sum(review) AS BIGINT) AS review, round(100.0 * sum(top) / sum(n), 2) AS high, CAST(coalesce(sum(pages), 0) AS BIGINT) AS pages FROM (SELECT backend, doc_id, count(*) FILTER (WHERE status = 'found') AS found, count(*) FILTER (WHERE status = 'not_found') AS missing, count(*) FILTER (WHERE status = 'needs_review') AS review, count(*) FILTER (WHERE bucket = 'high') AS top, count(*) AS n FROM served3 GROUP BY backend, doc_id) LEFT JOIN (SELECT doc_id, count(*) AS pages FROM doc_pages GROUP BY doc_id) USING (doc_id) GROUP BY backend", "served3", "doc_pages")
def a15_page_tiles(spark, d):
    """Tiles with the pages of the documents behind them."""
    return score.tiles(C._served(spark, d), X.pages(spark, d), ["backend"])
