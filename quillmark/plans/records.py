"""Queries over stored run records, served rows, requests, diagnostics and listings."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from quillmark.functions import text as T
from quillmark.operators import evidence as E
from quillmark.operators import grade as G
from quillmark.operators import retrieve as R
from quillmark.operators import review, score, serve
from quillmark.plans import catalog as C
from quillmark.plans import fixtures as X
from quillmark.sources import tables as S

query = C.query
LISTED = "SELECT backend, doc_id, field_key, a, a_present FROM answers2"


def _folder(spark, name: str) -> str:
    return f"{S.shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _stored_runs(spark, d) -> str:
    """The answers as stored records: arrays of up to a thousand documents' records, a file each."""
    a = X.two_answers(spark, d)
    answer = F.struct(F.col("a_present").alias("present"), F.col("a").alias("value"), F.pmod("doc_id", F.lit(9)).cast("int").alias("page"))
    one = a.groupBy("backend", "doc_id").agg(F.map_from_entries(F.collect_list(F.struct("field_key", answer))).alias("fields"))
    record = F.struct(F.col("doc_id").cast("string").alias("doc_id"), F.concat(F.lit("model:"), F.col("backend").cast("string")).alias("backend"), "fields")
    files = one.groupBy("backend", F.floor(F.col("doc_id") / 1000).alias("part")).agg(F.to_json(F.collect_list(record)).alias("value"))
    path = _folder(spark, "runs")
    files.select("backend", "value").write.option("maxRecordsPerFile", 1).partitionBy("backend").text(path)
    return path


def _runs(spark, d):
    return S.run_records(spark, _stored_runs(spark, d))


@query("SELECT 'backend=' || backend AS folder, count(DISTINCT doc_id) AS docs, count(*) AS fields FROM answers2 GROUP BY backend", "answers2")
def s1_results_scan(spark, d):
    return _runs(spark, d).groupBy("folder").agg(F.count_distinct("doc_id").alias("docs"), F.sum(F.size("fields")).cast("long").alias("fields"))


@query("SELECT 'model:' || backend AS backend, CAST(doc_id AS VARCHAR) AS doc_id, field_key, a_present AS present, CAST(a AS VARCHAR) AS value, CAST(doc_id % 9 AS INT) AS page FROM answers2", "answers2")
def p1_flatten(spark, d):
    return S.answers_of(_runs(spark, d)).select("backend", "doc_id", "field_key", "present", F.col("value").cast("string").alias("value"), "page")


@query("SELECT CAST(doc_id AS VARCHAR) AS doc_id, field_key, present, CAST(v AS VARCHAR) AS value, difficulty FROM truth2", "truth2")
def s2_truth_scan(spark, d):
    t = X.two_truths(spark, d)
    said = F.struct("present", F.col("v").alias("value"), "difficulty")
    one = t.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("field_key", said))).alias("fields"))
    record = F.struct(F.col("doc_id").cast("string").alias("doc_id"), "fields")
    path = _folder(spark, "truth")
    one.groupBy(F.floor(F.col("doc_id") / 1000).alias("part")).agg(F.to_json(F.collect_list(record)).alias("value")).select("value").write.option("maxRecordsPerFile", 1).text(path)
    rows = S.truth_records(spark, path).select("doc_id", F.explode("fields").alias("field_key", "t"))
    return rows.select("doc_id", "field_key", "t.present", F.col("t.value").cast("string").alias("value"), "t.difficulty")


@query("SELECT 'model-' || backend AS backend_key, count(DISTINCT doc_id) AS docs FROM answers2 GROUP BY backend", "answers2")
def s5_result_sink(spark, d):
    path = _folder(spark, "sink")
    S.save_runs(X.two_answers(spark, d).select("doc_id", F.concat(F.lit("model:"), F.col("backend").cast("string")).alias("backend")).distinct(), path)
    return spark.read.parquet(path).groupBy("backend_key").agg(F.count_distinct("doc_id").alias("docs"))


@query("SELECT b, doc_id, item_id, CASE WHEN item_id % 3 = 0 AND status = 'verified' THEN 'unverified' ELSE status END AS before, status AS after, item_id % 3 = 0 AND status = 'verified' AS changed FROM evidence", "evidence")
def s7_rescore(spark, d):
    """Stored statuses, some of them stale, against a new verification of the same quotes."""
    fresh = C._verified(spark, d)
    stale = fresh.withColumn("status", F.when((F.col("item_id") % 3 == 0) & (F.col("status") == "verified"), "unverified").otherwise(F.col("status")))
    path = _folder(spark, "rescored")
    stale.select("b", "doc_id", "item_id", "present", "page", "quote", "status").write.partitionBy("b").parquet(path)
    return E.rescored(spark.read.parquet(path), X.pages(spark, d), C.KEY).select("b", "doc_id", "item_id", "before", "after", "changed")


@query(f"SELECT CAST(backend AS INT) AS backend, {C.ACC} FROM graded GROUP BY backend", "graded")
def s8_graded_sink(spark, d):
    """The aggregates as one JSON text, read back."""
    rows = score.verdict_counts(C._graded(spark, d), ["backend"])
    path = _folder(spark, "graded")
    rows.agg(F.to_json(F.struct(F.array_sort(F.collect_list(F.struct(*rows.columns))).alias("backends"))).alias("value")).write.text(path)
    kinds = ", ".join(f"{f.name}: {f.dataType.simpleString()}" for f in rows.schema)
    return spark.read.text(path).select(F.explode(F.from_json("value", f"backends array<struct<{kinds}>>")["backends"]).alias("r")).select("r.*")


@query(r"SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN CASE WHEN trim(source) <> '' THEN source || ' — ' ELSE '' END || lang WHEN 1 THEN array_to_string(list_filter(string_split(source, 'r'), lambda x: trim(x) <> ''), '; ') WHEN 2 THEN CAST(doc_id AS VARCHAR) || CASE WHEN doc_id % 4 = 0 THEN '.5' ELSE '' END || ' ' || lang WHEN 3 THEN CASE WHEN doc_id % 9 = 0 THEN 'Yes' ELSE 'No' END WHEN 4 THEN CASE WHEN doc_id % 5 = 0 THEN 'raw ' || lang ELSE source END ELSE source END AS shown FROM documents")
def p2_display(spark, d):
    t, k = S.table(spark, d, "documents"), F.pmod("doc_id", F.lit(6))
    kind = F.element_at(F.array(*map(F.lit, ("contact", "list", "number", "boolean", "datetime", "text"))), (k + 1).cast("int"))
    number = F.when(k == 3, F.when(F.col("doc_id") % 9 == 0, 1.0).otherwise(0.0)).otherwise(F.col("doc_id") + F.when(F.col("doc_id") % 4 == 0, 0.5).otherwise(0.0))
    raw = F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit("raw "), "lang")).otherwise("")
    return t.select("doc_id", serve.display(kind, F.col("source"), F.split("source", "r"), F.array("source", F.lit(""), "lang"), number, F.col("lang"), raw).alias("shown"))


SPEC = (("quality", "Quality of the text", "scope"), ("toxic", "Toxic wording", "risk"))


def _spec(spark):
    return spark.createDataFrame(list(SPEC), "field_key string, label string, category string")


@query("SELECT backend, doc_id, field_key, CASE field_key WHEN 'quality' THEN 'Quality of the text' ELSE 'Toxic wording' END AS label, CASE field_key WHEN 'quality' THEN 'scope' ELSE 'risk' END AS category, CASE WHEN doc_id % 9 > 0 THEN 'p. ' || (doc_id % 9) END AS at FROM answers2", "answers2")
def p3_served_rows(spark, d):
    a = X.two_answers(spark, d).withColumn("page", F.nullif(F.pmod("doc_id", F.lit(9)), F.lit(0))).withColumn("quote", F.col("a").cast("string"))
    return serve.served_rows(a, _spec(spark)).select("backend", "doc_id", "field_key", "label", "category", "source.at")


@query("SELECT doc_id, 'Field ' || doc_id || '. ' || source AS text FROM documents")
def p10_field_query(spark, d):
    return S.table(spark, d, "documents").select("doc_id", serve.field_query(F.concat(F.lit("Field "), F.col("doc_id").cast("string")), F.col("source")).alias("text"))


@query("SELECT doc_id, field_key, page_no, CAST(score AS DOUBLE) AS score FROM kscore WHERE cluster IN ('alpha', 'gamma')", "kscore")
def f3_cluster_subset(spark, d):
    return R.cluster_subset(C._kscores(spark, d), X.fields(spark), ["alpha", "gamma"]).select("doc_id", "field_key", "page_no", "score")


@query("SELECT backend, doc_id, field_key FROM answers2 WHERE (doc_id + backend) % 8 <> 0", "answers2")
def f4_unknown_fields(spark, d):
    stray = F.pmod(F.col("doc_id") + F.col("backend"), F.lit(8)) == 0
    a = X.two_answers(spark, d).withColumn("field_key", F.when(stray, F.concat("field_key", F.lit("_x"))).otherwise(F.col("field_key")))
    return a.join(_spec(spark), "field_key", "left_semi").select("backend", "doc_id", "field_key")


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 AND avg(CASE WHEN length(trim(text)) >= 100 THEN 1.0 ELSE 0.0 END) < 0.5 THEN 'scanned input' END AS warning FROM doc_pages GROUP BY doc_id", "doc_pages")
def f6_scanned_warning(spark, d):
    modality = F.when(F.col("doc_id") % 2 == 0, "text").otherwise("vision")
    return C.f5_text_extractable(spark, d).select("doc_id", F.when((modality == "text") & ~F.col("extractable"), "scanned input").alias("warning"))


FINDINGS = "SELECT item_id // 3 AS finding_id, doc_id, CASE (item_id // 3) % 4 WHEN 0 THEN 'critical' WHEN 1 THEN 'high' WHEN 2 THEN 'medium' ELSE 'low' END AS severity, CASE WHEN (item_id // 3) % 2 = 0 THEN 'dates' ELSE 'scope' END AS category, (item_id // 3) % 5 = 0 AS potential FROM quotes GROUP BY ALL"


def _findings(spark, d):
    f = X.quotes(spark, d).select(F.floor(F.col("item_id") / 3).cast("long").alias("finding_id"), "doc_id").distinct()
    k = lambda n: F.pmod("finding_id", F.lit(n))
    severity = F.element_at(F.array(*map(F.lit, review.SEVERITIES)), (k(4) + 1).cast("int"))
    return f.select("*", severity.alias("severity"), F.when(k(2) == 0, "dates").otherwise("scope").alias("category"), (k(5) == 0).alias("potential"))


@query(f"SELECT finding_id, doc_id FROM ({FINDINGS}) WHERE severity = 'medium' AND category = 'dates'", "quotes")
def f9_finding_filter(spark, d):
    return review.finding_filter(_findings(spark, d), "medium", "dates").select("finding_id", "doc_id")


@query(f"SELECT doc_id, count(*) AS total, count(*) FILTER (WHERE severity = 'critical') AS critical, count(*) FILTER (WHERE severity = 'high') AS high, count(*) FILTER (WHERE severity = 'medium') AS medium, count(*) FILTER (WHERE severity = 'low') AS low, count(*) FILTER (WHERE potential) AS potential FROM ({FINDINGS}) GROUP BY doc_id", "quotes")
def a17_finding_counts(spark, d):
    return review.finding_counts(_findings(spark, d), ["doc_id"])


@query("SELECT backend, doc_id, field_key, CAST(v AS VARCHAR) AS truth, CAST(a AS VARCHAR) AS answer, verdict, CASE verdict WHEN 'missing' THEN 0 WHEN 'wrong' THEN 1 ELSE 2 END AS severity FROM graded WHERE verdict <> 'correct'", "graded")
def f12_diagnostics(spark, d):
    return G.diagnostics(C._graded(spark, d)).select("backend", "doc_id", "field_key", F.col("v").cast("string").alias("truth"), F.col("a").cast("string").alias("answer"), "verdict", "severity")


@query(r"SELECT doc_id, array_to_string(list_sort(list_distinct(list_filter(list_transform(string_split(text, chr(10)), lambda x: lower(trim(regexp_replace(x, '\s+', ' ', 'g')))), lambda x: x <> ''))), '|') AS items FROM documents")
def n3_item_set(spark, d):
    return S.table(spark, d, "documents").select("doc_id", F.array_join(F.array_sort(G.item_set(F.split("text", "\n"))), "|").alias("items"))


@query("SELECT doc_id, coalesce(CASE WHEN doc_id % 3 = 0 THEN '' WHEN doc_id % 5 = 0 THEN NULL ELSE source END <> '', false) AS truthy FROM documents")
def n11_truthiness(spark, d):
    v = F.when(F.col("doc_id") % 3 == 0, "").when(F.col("doc_id") % 5 == 0, None).otherwise(F.col("source"))
    return S.table(spark, d, "documents").select("doc_id", T.truthy(v).alias("truthy"))


SHORT = r"string_agg('===== PAGE ' || page_no || ' =====' || chr(10) || CASE WHEN length(trim(text)) > 3000 THEN left(trim(text), 3000) || chr(10) || '[... page truncated ...]' ELSE trim(text) END, chr(10) || chr(10) ORDER BY page_no)"


@query(f"SELECT doc_id, md5(CASE WHEN length(block) > 5000 THEN left(block, 5000) || chr(10) || '[... page truncated ...]' ELSE block END) AS h FROM (SELECT doc_id, {SHORT} AS block FROM doc_pages GROUP BY doc_id)", "doc_pages")
def n14_total_cap(spark, d):
    """The short page cut, and a total that the longer documents of these tables exceed."""
    blocks = serve.context_blocks(X.pages(spark, d), ["doc_id"], cut=serve.SHORT_CUT)
    return blocks.select("doc_id", F.md5(serve.capped(F.col("block"), 5_000)).alias("h"))


LONG = SHORT.replace("3000", "12000")


@query(f"SELECT doc_id, cluster, md5('Read the pages and fill the fields.' || chr(10) || chr(10) || 'Pages: ' || listed || chr(10) || chr(10) || asked || chr(10) || chr(10) || CASE WHEN length(block) > 100000 THEN left(block, 100000) || chr(10) || '[... page truncated ...]' ELSE block END) AS h FROM (SELECT doc_id, cluster, {LONG} AS block, string_agg(CAST(page_no AS VARCHAR), ', ' ORDER BY page_no) AS listed FROM (SELECT DISTINCT doc_id, cluster, page_no FROM krank WHERE rank < 2) k JOIN doc_pages USING (doc_id, page_no) GROUP BY ALL) JOIN (SELECT cluster, string_agg('- ' || field_key || ': ' || type, chr(10) ORDER BY number) AS asked FROM fields GROUP BY cluster) USING (cluster)", "krank", "fields")
def n15_requests(spark, d):
    f, p = X.fields(spark), X.pages(spark, d)
    chosen = R.top(R.ranked(C._kscores(spark, d), ["field_key"]), 2).select("doc_id", "cluster", "page_no").distinct()
    rows = serve.request_rows(chosen.join(p, ["doc_id", "page_no"]), f.withColumnRenamed("type", "guidance"), ["doc_id", "cluster"], "Read the pages and fill the fields.")
    return rows.select("doc_id", "cluster", F.md5("body").alias("h"))


@query("SELECT doc_id, cluster, page_no FROM (SELECT DISTINCT doc_id, cluster FROM krank WHERE rank < 5) JOIN (SELECT doc_id, page_no FROM doc_pages) USING (doc_id)", "krank")
def r16_full_text(spark, d):
    """Text may pass over the selection: every page of a selected document is shown."""
    return R.shown_pages(_chosen(spark, d), X.pages(spark, d), "text", full_text=True)


@query("SELECT doc_id, cluster, page_no FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, cluster ORDER BY page_no) AS n FROM (SELECT DISTINCT doc_id, cluster, page_no FROM krank WHERE rank < 5)) WHERE n <= 3", "krank")
def r17_vision_cap(spark, d):
    """Pictures are held to a cap; here three pages, which many documents exceed."""
    return R.shown_pages(_chosen(spark, d), X.pages(spark, d), "vision", cap=3)


def _chosen(spark, d):
    top = R.top(R.ranked(C._kscores(spark, d), ["field_key"]))
    return top.groupBy("doc_id", "cluster").agg(F.array_sort(F.collect_set("page_no")).alias("pages"))


@query("SELECT event_id, round(greatest(0.0, least(1.0, coalesce(CASE WHEN event_id % 7 = 0 THEN NULL ELSE value / 50.0 - 0.2 END, 0.0))), 9) AS coverage FROM events")
def g11_coverage_clamp(spark, d):
    raw = F.when(F.col("event_id") % 7 != 0, F.col("value") / 50.0 - 0.2)
    return S.table(spark, d, "events").select("event_id", F.round(G.share(raw), 9).alias("coverage"))


@query("SELECT backend, difficulty, count(*) FILTER (WHERE verdict = 'correct') AS correct, count(*) AS total, round(count(*) FILTER (WHERE verdict = 'correct') / count(*), 4) AS accuracy FROM graded GROUP BY ALL", "graded")
def a9_nested_breakdown(spark, d):
    """The nested map, opened again so that it can be compared."""
    nested = score.nested_accuracy(C._graded(spark, d), "backend", "difficulty")
    return nested.select("backend", F.explode("breakdown").alias("difficulty", "r")).select("backend", "difficulty", "r.*")


@query("SELECT backend, field_key, row_number() OVER (PARTITION BY backend ORDER BY accuracy DESC, field_key) AS place FROM (SELECT backend, field_key, count(*) FILTER (WHERE verdict = 'correct') / count(*) AS accuracy FROM graded GROUP BY ALL)", "graded")
def o1_listing(spark, d):
    """Fields of each backend, the best first."""
    rows = score.verdict_counts(C._graded(spark, d), ["backend", "field_key"]).withColumn("exact", F.col("correct") / F.col("total"))
    w = C.W.partitionBy("backend").orderBy(F.desc("exact"), "field_key")
    return rows.select("backend", "field_key", F.row_number().over(w).alias("place")).orderBy("backend", "place")


@query("SELECT doc_id, source FROM documents ORDER BY doc_id LIMIT 25")
def o2_first_documents(spark, d):
    """The feature is the limit: the first documents of a run."""
    return S.table(spark, d, "documents").orderBy("doc_id").limit(25).select("doc_id", "source")
