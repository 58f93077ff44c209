"""Queries over the stored tables, one for each operator or group of them, and their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quillmark.functions import text as T
from quillmark.functions import vectors as V
from quillmark.operators import evidence as E
from quillmark.operators import grade as G
from quillmark.operators import retrieve as R
from quillmark.operators import review, score, serve
from quillmark.plans import fixtures as X
from quillmark.plans.oracle import SEGS, cover, norm, runs, share, shingles, sql, token_set
from quillmark.sources import tables as S
from quillmark.streaming import feeds

QUERIES, ORACLES = {}, {}


def query(body: str | None = None, *views: str):
    def keep(f):
        QUERIES[f.__name__] = f
        if body is not None:
            ORACLES[f.__name__] = sql(body, *views)
        return f

    return keep


# --- sources, sinks, checks


@query("SELECT doc_id, page_no, length(text) AS n FROM doc_pages", "doc_pages")
def s3_page_scan(spark, d):
    return X.pages(spark, d).select("doc_id", "page_no", F.length("text").alias("n"))


@query("SELECT doc_id, page_no, md5(CASE WHEN page_no % 3 = 0 AND doc_id % 2 = 0 THEN text || '!' ELSE text END) AS h FROM doc_pages", "doc_pages")
def s4_page_fallback(spark, d):
    base = X.pages(spark, d)
    better = base.where("page_no % 3 = 0").select("doc_id", "page_no", F.when(F.pmod("doc_id", F.lit(2)) == 0, F.concat("text", F.lit("!"))).otherwise("").alias("text"))
    return S.preferred_text(base, better).select("doc_id", "page_no", F.md5("text").alias("h"))


@query("SELECT page_id, replace(replace(url, ':', '-'), '/', '-') AS file_key FROM pages")
def s6_file_key(spark, d):
    return S.table(spark, d, "pages").select("page_id", T.file_key(F.col("url")).alias("file_key"))


@query("SELECT CASE WHEN o.doc_id IS NULL THEN 'added' WHEN n.doc_id IS NULL THEN 'removed' WHEN o.h <> n.h THEN 'changed' ELSE 'same' END AS change, count(*) AS n FROM (SELECT doc_id, sha256(text) AS h FROM documents WHERE doc_id % 7 <> 0) o FULL JOIN (SELECT doc_id, sha256(CASE WHEN doc_id % 5 = 0 THEN text || '!' ELSE text END) AS h FROM documents WHERE doc_id % 11 <> 0) n USING (doc_id) GROUP BY 1")
def s9_manifest_drift(spark, d):
    docs = S.table(spark, d, "documents")
    old = docs.where("doc_id % 7 <> 0").select("doc_id", F.sha2("text", 256).alias("sha256"))
    new = docs.where("doc_id % 11 <> 0").select("doc_id", F.sha2(F.when(F.col("doc_id") % 5 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")), 256).alias("sha256"))
    return S.drift(old, new, "doc_id").groupBy("change").agg(F.count("*").alias("n"))


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def s10_cache_misses(spark, d):
    return S.table(spark, d, "documents").select("doc_id").join(S.table(spark, d, "labels").select("doc_id"), "doc_id", "left_anti")


@query("SELECT source, count(*) AS files, sum(length(text)) AS total, arg_min(doc_id, doc_id) FILTER (WHERE lang = 'en') AS first_en FROM documents GROUP BY source")
def s11_batch_summary(spark, d):
    return S.table(spark, d, "documents").groupBy("source").agg(
        F.count("*").alias("files"), F.sum(F.length("text")).alias("total"), F.min(F.when(F.col("lang") == "en", F.col("doc_id"))).alias("first_en"))


@query(r"""SELECT user_id, count(*) AS n FROM events WHERE regexp_matches(props, '^\{"') GROUP BY user_id""")
def n19_salvage(spark, d):
    """Records cut off after their first member; what was complete is kept and counted."""
    body = F.concat(F.lit('{"first": '), F.col("props"), F.lit(', "second": {"x": '))
    raw = S.table(spark, d, "events").where(F.col("props").rlike(r'^\{"')).select("user_id", body.alias("body"))
    return S.salvage(raw).where("key = 'first'").groupBy("user_id").agg(F.count("*").alias("n"))


# --- projections


@query("SELECT backend, doc_id, bucket, CAST(round_even(confidence * 100, 0) AS INT) AS pct FROM served2", "served2")
def p4_confidence(spark, d):
    return X.served(spark, d).select("backend", "doc_id", score.confidence_bucket(F.col("confidence")).alias("bucket"), score.confidence_percent(F.col("confidence")).alias("pct"))


def _served(spark, d):
    out = X.served(spark, d).withColumn("bucket", score.confidence_bucket(F.col("confidence")))
    return out.withColumn("status", score.field_status(F.col("present"), F.col("evidence"), F.col("bucket")))


@query("SELECT backend, doc_id, status, CASE WHEN status = 'needs_review' THEN CASE evidence WHEN 'verified' THEN 'low confidence' WHEN 'wrong_page' THEN 'found on another page' WHEN 'unverified' THEN 'quote not found' ELSE 'manual review' END END AS reason FROM served3", "served3")
def p6_field_status(spark, d):
    return _served(spark, d).select("backend", "doc_id", "status", F.when(F.col("status") == "needs_review", score.review_reason(F.col("evidence"))).alias("reason"))


@query(r"SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN '<absent>' ELSE substring(trim(regexp_replace(CASE WHEN doc_id % 2 = 0 THEN array_to_string(list_sort(list_transform(string_split(text, chr(10)), lambda x: lower(x))), ' | ') ELSE lower(text) END, '\s+', ' ', 'g')), 1, 120) END AS shown FROM documents")
def p8_comparable(spark, d):
    kind = F.when(F.col("doc_id") % 2 == 0, "list").otherwise("text")
    return S.table(spark, d, "documents").select("doc_id", serve.comparable(kind, F.col("doc_id") % 5 != 0, F.col("text"), F.split("text", "\n")).alias("shown"))


@query("SELECT l_returnflag AS backend, round(sum(coalesce((l_quantity * i + l_linenumber * o) / 1e6, 0.0)), 6) AS cost FROM lineitem LEFT JOIN (VALUES ('A', 3.0, 15.0), ('N', 0.5, 2.0)) AS p(k, i, o) ON k = l_returnflag GROUP BY 1")
def p9_call_cost(spark, d):
    price = spark.createDataFrame([("A", 3.0, 15.0), ("N", 0.5, 2.0)], "k string, i double, o double")
    rows = S.table(spark, d, "lineitem").join(F.broadcast(price), F.col("l_returnflag") == F.col("k"), "left")
    cost = score.call_cost(F.col("l_quantity").cast("double"), F.col("l_linenumber").cast("double"), F.col("i"), F.col("o"))
    return rows.groupBy(F.col("l_returnflag").alias("backend")).agg(F.round(F.sum(cost), 6).alias("cost"))


@query("SELECT doc_id, page_no, md5('Page ' || page_no || ': ' || left(text, 8000)) AS h FROM doc_pages WHERE trim(text) <> ''", "doc_pages")
def p11_embedding_input(spark, d):
    p = X.pages(spark, d).where(F.trim("text") != "")
    return p.select("doc_id", "page_no", F.md5(serve.embedding_input(F.col("page_no"), F.col("text"))).alias("h"))


# --- filters


@query("SELECT doc_id FROM documents WHERE contains(lower(source), 'src1') AND NOT contains(lower(source), 'src13') AND NOT contains(lower(source), 'src14')")
def f1_include_exclude(spark, d):
    s = F.lower("source")
    docs = S.table(spark, d, "documents").where(s.contains("src1"))
    for gone in ("src13", "src14"):
        docs = docs.where(~s.contains(gone))
    return docs.select("doc_id")


@query("SELECT doc_id, avg(CASE WHEN length(trim(text)) >= 100 THEN 1.0 ELSE 0.0 END) >= 0.5 AS extractable FROM doc_pages GROUP BY doc_id", "doc_pages")
def f5_text_extractable(spark, d):
    return X.pages(spark, d).groupBy("doc_id").agg((F.avg(F.when(F.length(F.trim("text")) >= 100, 1.0).otherwise(0.0)) >= 0.5).alias("extractable"))


@query("SELECT event_id, lower(trim(event_type)) NOT IN ('', 'null', 'none', 'n/a', 'click') AS content FROM events")
def f7_real_content(spark, d):
    v = F.when(F.col("event_type") == "click", F.lit(" N/A ")).otherwise(F.col("event_type"))
    return S.table(spark, d, "events").select("event_id", T.is_content(v).alias("content"))


@query("SELECT backend, doc_id FROM served3 WHERE category = 'deadline' AND status = 'needs_review' AND bucket = 'medium' AND (contains(lower(label), '1') OR contains(lower(value), '1'))", "served3")
def f8_field_filter(spark, d):
    return serve.field_filter(_served(spark, d).withColumn("confidence", F.col("bucket")), "deadline", "needs_review", "medium", "1").select("backend", "doc_id")


@query("SELECT backend, doc_id, n FROM (SELECT backend, doc_id, row_number() OVER (PARTITION BY backend ORDER BY doc_id) AS n FROM served3 WHERE status = 'found' AND category = 'scope') WHERE n <= 2", "served3")
def f10_first_found(spark, d):
    w = W.partitionBy("backend").orderBy("doc_id")
    return _served(spark, d).where("status = 'found' and category = 'scope'").withColumn("n", F.row_number().over(w)).where("n <= 2").select("backend", "doc_id", "n")


@query("SELECT p.doc_id, p.page_no, n.text IS NOT NULL AS inside FROM doc_pages p LEFT JOIN doc_pages n ON n.doc_id = p.doc_id AND n.page_no = p.page_no + 2", "doc_pages")
def f13_page_bounds(spark, d):
    w = W.partitionBy("doc_id")
    return X.pages(spark, d).select("doc_id", "page_no", (F.col("page_no") + 2 <= F.max("page_no").over(w)).alias("inside"))


# --- text functions


@query("SELECT doc_id, page_no, md5(hay) AS h FROM pn", "pn")
def n1_normalise(spark, d):
    return E.prepared_pages(X.pages(spark, d)).select("doc_id", "page_no", F.md5("hay").alias("h"))


SEGS_TEXT = SEGS.replace('{0}', 'text')


@query(f"SELECT item_id, array_to_string({SEGS_TEXT}, '|') AS segs, len({SEGS_TEXT}) AS n FROM benchmark")
def n4_segments(spark, d):
    s = T.segments(F.col("text"))
    return S.table(spark, d, "benchmark").select("item_id", F.array_join(s, "|").alias("segs"), F.size(s).cast("long").alias("n"))


@query("SELECT o_orderkey, d AS truth_day, a AS answer_day, o_orderkey % 5 = 0 AS timed FROM dates", "dates")
def n6_dates(spark, d):
    return X.dates(spark, d).select("o_orderkey", T.extract_date(F.col("truth")).alias("truth_day"), T.extract_date(F.col("answer")).alias("answer_day"), T.has_time(F.col("answer")).alias("timed"))


@query(r"SELECT doc_id, nullif(regexp_extract(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}', 0), '') AS email FROM documents")
def n8_email(spark, d):
    return S.table(spark, d, "documents").select("doc_id", T.first_email(F.col("text")).alias("email"))


@query("SELECT doc_id, trim(regexp_extract(text, '^[^,;.]*', 0)) AS name FROM documents")
def n9_leading_name(spark, d):
    return S.table(spark, d, "documents").select("doc_id", T.leading_name(F.col("text")).alias("name"))


@query("SELECT event_id, try_cast(CASE WHEN event_id % 3 = 0 THEN event_type ELSE CAST(value AS VARCHAR) END AS DOUBLE) AS n FROM events")
def n10_number(spark, d):
    raw = F.when(F.col("event_id") % 3 == 0, F.col("event_type")).otherwise(F.col("value").cast("string"))
    return S.table(spark, d, "events").select("event_id", T.to_number(raw).alias("n"))


STOPS = ", ".join(f"'{w}'" for w in T.STOP_WORDS)


@query(rf"SELECT conv_id, turn, array_to_string(list_filter(string_split(trim(regexp_replace(replace(lower(text), '?', ''), '\s+', ' ', 'g')), ' '), lambda w: w NOT IN ({STOPS}) AND w <> ''), ' ') AS words FROM conversations")
def n12_question_tokens(spark, d):
    return S.table(spark, d, "conversations").select("conv_id", "turn", F.array_join(T.question_tokens(F.col("text")), " ").alias("words"))


@query(r"SELECT doc_id, md5(string_agg('===== PAGE ' || page_no || ' =====' || chr(10) || CASE WHEN length(trim(text)) > 12000 THEN left(trim(text), 12000) || chr(10) || '[... page truncated ...]' ELSE trim(text) END, chr(10) || chr(10) ORDER BY page_no)) AS h FROM doc_pages GROUP BY doc_id", "doc_pages")
def n13_context(spark, d):
    return serve.context_blocks(X.pages(spark, d), ["doc_id"]).select("doc_id", F.md5("block").alias("h"))


@query("SELECT conv_id, turn, role, md5(CASE WHEN lead_text IS NOT NULL AND turn = first_user THEN lead_text || chr(10) || chr(10) || text ELSE text END) AS h FROM (SELECT *, min(turn) OVER w AS t0, max(CASE WHEN role = 'system' AND turn = t00 THEN text END) OVER w AS lead_text, min(CASE WHEN role = 'user' THEN turn END) OVER w AS first_user FROM (SELECT *, min(turn) OVER (PARTITION BY conv_id) AS t00 FROM conversations) WINDOW w AS (PARTITION BY conv_id)) WHERE NOT (lead_text IS NOT NULL AND first_user IS NOT NULL AND role = 'system' AND turn = t0)")
def n16_fold_system(spark, d):
    return serve.fold_system(S.table(spark, d, "conversations")).select("conv_id", "turn", "role", F.md5("text").alias("h"))


@query("SELECT conv_id, turn FROM (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations) WHERE n <= 6")
def n17_last_turns(spark, d):
    return serve.last_turns(S.table(spark, d, "conversations")).select("conv_id", "turn")


@query("SELECT doc_id, field_key, sha256('judge:2:' || field_key || ':' || CAST(v AS VARCHAR)) AS key FROM truth", "truth")
def n18_cache_key(spark, d):
    return X.truth(spark, d).select("doc_id", "field_key", T.cache_key(F.lit("judge"), F.lit("2"), F.col("field_key"), F.col("v").cast("string")).alias("key"))


# --- retrieval


def _kscores(spark, d):
    return R.keyword_scores(X.pages(spark, d), X.keywords(spark), ["field_key", "cluster"])


@query("SELECT doc_id, field_key, page_no, CAST(score AS DOUBLE) AS score FROM kscore", "kscore")
def r1_keyword_score(spark, d):
    return _kscores(spark, d).select("doc_id", "field_key", "page_no", "score")


@query("SELECT doc_id, field_key, page_no, round(greatest(0, least(1, score)), 6) AS score FROM vscore", "vscore")
def r2_cosine(spark, d):
    return R.vector_scores(X.page_vectors(spark, d), X.field_vectors(spark, d), ["field_key"]).select("doc_id", "field_key", "page_no", F.round(V.clamped(F.col("score")), 6).alias("score"))


@query("SELECT doc_id, field_key, page_no, CAST(rank AS INT) AS rank FROM vrank WHERE rank < 5", "vrank")
def r4_vector_rank(spark, d):
    return R.top_ranked(R.vector_scores(X.page_vectors(spark, d), X.field_vectors(spark, d), ["field_key"]), ["field_key"]).select("doc_id", "field_key", "page_no", "rank")


def _hybrid(spark, d):
    v = R.ranked(R.vector_scores(X.page_vectors(spark, d), X.field_vectors(spark, d), ["field_key"]), ["field_key"])
    k = _kscores(spark, d).where("field_key = 'opening'").select("doc_id", "page_no", "score").join(F.broadcast(X.field_vectors(spark, d).select("field_key")), F.lit(True))
    return R.fused(v, R.ranked(k, ["field_key"]), ["field_key"])


@query("SELECT doc_id, field_key, page_no, round(coalesce(1.0 / (60 + v.rank), 0) + coalesce(1.0 / (60 + k.rank), 0), 9) AS score FROM vrank v FULL JOIN krank2 k USING (doc_id, field_key, page_no)", "vrank", "krank2")
def r5_rank_fusion(spark, d):
    return _hybrid(spark, d).select("doc_id", "field_key", "page_no", F.round("score", 9).alias("score"))


@query("SELECT doc_id, field_key, page_no FROM krank WHERE rank < 5", "krank")
def r6_field_top(spark, d):
    return R.top_ranked(_kscores(spark, d), ["field_key"]).select("doc_id", "field_key", "page_no")


@query("SELECT doc_id, cluster, page_no, CAST(min(rank) AS INT) AS priority FROM krank WHERE rank < 5 GROUP BY ALL", "krank")
def r7_priority(spark, d):
    return R.priorities(R.top_ranked(_kscores(spark, d), ["field_key"]))


SELECTED = """, top5 AS (SELECT k.*, type FROM krank k JOIN fields f USING (field_key) WHERE rank < 5),
pri AS (SELECT doc_id, k.cluster, page_no, min(rank) AS priority FROM krank k WHERE rank < 5 GROUP BY ALL),
tab AS (SELECT doc_id, page_no, (doc_id + page_no) % 3 <> 0 AS t, lead((doc_id + page_no) % 3 <> 0, 1) OVER w AS t1, lead((doc_id + page_no) % 3 <> 0, 2) OVER w AS t2 FROM doc_pages WINDOW w AS (PARTITION BY doc_id ORDER BY page_no)),
cont0 AS (SELECT x.doc_id, x.cluster, x.page_no, t2 FROM krank x JOIN fields f USING (field_key) JOIN tab ON tab.doc_id = x.doc_id AND tab.page_no = x.page_no WHERE rank = 0 AND type = 'table' AND t AND t1),
base AS (SELECT doc_id, cluster, page_no FROM pri UNION SELECT doc_id, cluster, page_no + 1 FROM cont0 UNION SELECT doc_id, cluster, page_no + 2 FROM cont0 WHERE t2 UNION SELECT doc_id, cluster, page_no FROM doc_pages, (SELECT DISTINCT cluster FROM fields) WHERE page_no <= 2),
room AS (SELECT doc_id, b.cluster, greatest(8, f.n + 5) - count(*) AS room FROM base b JOIN (SELECT cluster, count(*) AS n FROM fields GROUP BY 1) f ON f.cluster = b.cluster GROUP BY doc_id, b.cluster, f.n),
cs AS (SELECT doc_id, cluster, page_no, sum(score) AS score FROM kscore GROUP BY ALL),
cr AS (SELECT *, row_number() OVER (PARTITION BY doc_id, cluster ORDER BY score DESC, page_no) - 1 AS rank FROM cs),
fill AS (SELECT *, row_number() OVER (PARTITION BY doc_id, cluster ORDER BY rank) AS place FROM cr ANTI JOIN base USING (doc_id, cluster, page_no)),
chosen AS (SELECT b.doc_id, b.cluster, b.page_no, priority, b.page_no <= 2 AS keep FROM base b LEFT JOIN pri USING (doc_id, cluster, page_no) UNION ALL SELECT f.doc_id, f.cluster, f.page_no, f.rank, f.page_no <= 2 FROM fill f JOIN room USING (doc_id, cluster) WHERE place <= room),
gap AS (SELECT doc_id, cluster, page_no + 1 AS page_no FROM (SELECT *, lead(page_no) OVER (PARTITION BY doc_id, cluster ORDER BY page_no) AS nxt FROM chosen) WHERE nxt - page_no = 2),
whole AS (SELECT * FROM chosen UNION ALL SELECT *, NULL, true FROM gap)
"""


def _oracle_select(cap: str) -> str:
    base = sql("", "krank", "fields").rstrip()
    return base + SELECTED + f"SELECT doc_id, cluster, array_to_string(list_sort(list_distinct(list(page_no))), ',') AS pages FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, cluster ORDER BY keep DESC, coalesce(priority, 999), page_no) AS place FROM whole) WHERE {cap} GROUP BY ALL"


def _selected(spark, d, cap):
    # texts are gone through once for the scores and once for the numbers; the steps read what is kept of them
    f, p, k = X.fields(spark), S.kept(X.numbers(spark, d)), S.kept(_kscores(spark, d))
    top = R.top_ranked(k, ["field_key"]).join(F.broadcast(f.select("field_key", "type")), "field_key")
    tables = p.select("doc_id", "page_no", ((F.col("doc_id") + F.col("page_no")) % 3 != 0).alias("is_table"))
    out = R.select_pages(p, f, k, top, tables, cap=cap)
    return out.select("doc_id", "cluster", F.array_join(F.transform("pages", lambda x: x.cast("string")), ",").alias("pages"))


@query()
def r14_selection(spark, d):
    return _selected(spark, d, None)


@query()
def r13_selection_capped(spark, d):
    return _selected(spark, d, R.CAP)


ORACLES["r14_selection"], ORACLES["r13_selection_capped"] = _oracle_select("true"), _oracle_select("place <= 14 OR keep")


@query("SELECT cluster, greatest(8, count(*) + 5) AS k, string_agg(field_key, ',' ORDER BY number) AS listed, (SELECT count(*) FROM documents) AS docs FROM fields GROUP BY cluster", "fields")
def r8_budget_listing(spark, d):
    f = X.fields(spark)
    names = f.groupBy("cluster").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("number", "field_key"))), lambda x: x["field_key"]), ",").alias("listed"))
    return R.budget(f).join(names, "cluster").join(S.table(spark, d, "documents").agg(F.count("*").alias("docs")), F.lit(True))


# --- evidence

KEY = ["b", "doc_id", "item_id", "page"]


def _verified(spark, d):
    # a null page is no key for joins
    q = X.quotes(spark, d).withColumn("page", F.coalesce("page", F.lit(-1)))
    return E.verify(q, X.pages(spark, d), KEY)


@query("SELECT b, doc_id, item_id, found AS found_on_page FROM exact0", "exact0")
def e1_exact(spark, d):
    q = E.prepared_quotes(X.quotes(spark, d))
    return E.exact_pages(q, E.prepared_pages(E.quoted(X.pages(spark, d), q)), KEY).select("b", "doc_id", "item_id", "found_on_page")


@query(f"SELECT b, doc_id, item_id, round(max(100.0 * len(list_intersect({shingles('needle')}, {shingles('hay')})) / len({shingles('needle')})), 6) AS fuzzy FROM qn JOIN pn USING (doc_id) WHERE length(needle) >= 12 GROUP BY ALL", "qn", "pn")
def e2_fuzzy(spark, d):
    q = E.prepared_quotes(X.quotes(spark, d))
    return E.page_scores(q, E.prepared_pages(X.pages(spark, d)), KEY).groupBy("b", "doc_id", "item_id").agg(F.max("fuzzy").alias("fuzzy"))


def _slipped(spark, d):
    """Passages with one letter misread in every third word, cited by document and page."""
    slip = F.transform(F.split("quote", " "), lambda w, i: F.when((i % 3 == 0) & (F.length(w) > 1), F.concat(F.substring(w, 1, 1), F.lit("#"), F.substr(w, F.lit(3)))).otherwise(w))
    q = X.hits(spark, d).withColumn("quote", F.array_join(slip, " "))
    return q.select("item_id", "doc_id", F.col("page_no").alias("page"), F.lit(True).alias("present"), "quote")


@query()
def e2_aligned(spark, d):
    """What character alignment finds of misread passages, and what word shingles find."""
    key = ["item_id", "doc_id", "page"]
    quotes, pages = S.kept(_slipped(spark, d)), X.pages(spark, d)
    both = [E.verify(quotes, pages, key, aligned=a).select(*key, "status", "found_on_page", "best_score") for a in (True, False)]
    shingled = both[1].select(*key, F.col("status").alias("shingled"), F.col("best_score").alias("shingle_score"))
    return both[0].join(shingled, key)


FALSE_PART = "Nothing of this kind was ever written down here."


def _segmented(spark, d):
    """Each quote stitched by ellipses; by document as it is, with a part that stands nowhere, or its last word altered."""
    q = X.hits(spark, d).groupBy("item_id", "doc_id").agg(F.min("quote").alias("quote"))
    k = F.pmod("doc_id", F.lit(3))
    quote = F.when(k == 2, F.regexp_replace("quote", r"\S+$", "altered")).otherwise(F.col("quote"))
    stitched = F.concat(F.array_join(F.split(quote, r"\. "), " ... "), F.lit(" ..."), F.when(k == 1, f" {FALSE_PART}").otherwise(""))
    return E.prepared_quotes(q.select("item_id", "doc_id", F.lit(1).alias("page"), F.lit(True).alias("present"), stitched.alias("quote")))


STITCHED = "array_to_string(string_split(CASE WHEN doc_id % 3 = 2 THEN regexp_replace(quote, '\\S+$', 'altered') ELSE quote END, '. '), ' ... ') || ' ...' || CASE WHEN doc_id % 3 = 1 THEN ' " + FALSE_PART + "' ELSE '' END"


@query(f"SELECT item_id, doc_id, max(round({cover('segs', 'hay', 'hs')}, 6)) AS coverage FROM (SELECT item_id, doc_id, {SEGS.replace('{0}', STITCHED)} AS segs FROM (SELECT item_id, doc_id, min(quote) AS quote FROM hit GROUP BY ALL)) q JOIN (SELECT doc_id, hay, {runs('hay')} AS hs FROM pn WHERE doc_id IN (SELECT doc_id FROM hit)) USING (doc_id) GROUP BY ALL", "hit")
def e3_segments(spark, d):
    q = _segmented(spark, d)
    p = E.prepared_pages(E.quoted(X.pages(spark, d), q))
    return E.page_scores(q, p, ["item_id", "doc_id"]).groupBy("item_id", "doc_id").agg(F.max("coverage").alias("coverage"))


BOTH = "(hay || ' ' || nxt)"


@query(f"SELECT item_id, doc_id, page_no, CAST(page_no + CASE WHEN contains(nxt, needle) AND NOT contains(hay, needle) THEN 1 ELSE 0 END AS INT) AS start_page, round(greatest({share('qs', 'bs')}, {cover('[needle]', 'two', 'bs')}), 6) AS score FROM (SELECT q.item_id, q.doc_id, needle, {runs('needle')} AS qs, page_no, hay, nxt, {BOTH} AS two, {runs(BOTH)} AS bs FROM (SELECT DISTINCT item_id, doc_id, {norm('quote')} AS needle FROM hit) q JOIN (SELECT doc_id, page_no, hay, lead(hay) OVER (PARTITION BY doc_id ORDER BY page_no) AS nxt FROM pn) USING (doc_id) WHERE nxt IS NOT NULL)", "hit")
def e4_page_pairs(spark, d):
    """Scores of passages over every two adjacent pages of their documents."""
    q = X.hits(spark, d).select("item_id", "doc_id", "quote").distinct()
    q = E.prepared_quotes(q.withColumn("page", F.lit(1)).withColumn("present", F.lit(True))).withColumn("segs", F.lit(None).cast("array<string>"))
    return E.pair_scores(q, E.prepared_pages(E.quoted(X.pages(spark, d), q)), ["item_id", "doc_id"])


@query("SELECT b, doc_id, item_id, status, found AS found_on_page, best_score FROM evidence", "evidence")
def e6_status(spark, d):
    return _verified(spark, d).select("b", "doc_id", "item_id", "status", "found_on_page", "best_score")


RATES = "count(*) FILTER (WHERE status = 'verified') AS verified, count(*) FILTER (WHERE status = 'wrong_page') AS wrong_page, count(*) FILTER (WHERE status = 'unverified') AS unverified, count(*) FILTER (WHERE status = 'no_quote') AS no_quote, count(*) FILTER (WHERE status = 'absent') AS absent, count(*) FILTER (WHERE status <> 'absent') AS asserted, round(count(*) FILTER (WHERE status IN ('verified', 'wrong_page')) / nullif(count(*) FILTER (WHERE status <> 'absent'), 0), 3) AS groundedness, round(count(*) FILTER (WHERE status IN ('unverified', 'no_quote')) / nullif(count(*) FILTER (WHERE status <> 'absent'), 0), 3) AS hallucination"


@query(f"SELECT b, doc_id, {RATES} FROM evidence GROUP BY b, doc_id", "evidence")
def e7_summary(spark, d):
    return E.rates(_verified(spark, d), ["b", "doc_id"])


@query(f"SELECT b, {RATES} FROM evidence GROUP BY b", "evidence")
def e8_pooled(spark, d):
    return E.rates(_verified(spark, d), ["b"])


@query("SELECT b, CASE WHEN item_id % 4 <> 0 THEN CASE WHEN status = 'absent' THEN 'missing' ELSE status END WHEN status = 'absent' THEN 'correctly absent' ELSE 'asserted' END AS cell, count(*) AS n FROM evidence GROUP BY ALL", "evidence")
def e9_cross_tab(spark, d):
    given = F.col("item_id") % 4 != 0
    cell = F.when(given, F.when(F.col("status") == "absent", "missing").otherwise(F.col("status"))).when(F.col("status") == "absent", "correctly absent").otherwise("asserted")
    return _verified(spark, d).groupBy("b", cell.alias("cell")).agg(F.count("*").alias("n"))


@query("SELECT b, doc_id, item_id, status FROM evidence WHERE status IN ('unverified', 'no_quote')", "evidence")
def f11_flags(spark, d):
    return E.flags(_verified(spark, d)).select("b", "doc_id", "item_id", "status")


# --- grading


def _graded(spark, d):
    j = G.with_truth(X.two_truths(spark, d), X.two_answers(spark, d))
    content = F.pmod(F.col("doc_id") + F.col("backend"), F.lit(4)) == 0
    compared = F.when(F.col("field_key") == "toxic", G.banded(F.col("likeness"), G.TEXT_GOOD, G.TEXT_SOME)).otherwise(G.boolean_verdict(F.col("v"), F.col("a")))
    v = G.presence(F.col("present"), F.coalesce("answered", F.lit(False)), F.col("a_present"), content, compared)
    k = F.pmod("doc_id", F.lit(4))
    status = F.when(k == 0, "wrong_page").when(k == 1, "unverified").otherwise("verified")
    return j.select("backend", "doc_id", "field_key", F.coalesce("difficulty", F.lit("medium")).alias("difficulty"), "v", "a", v.alias("verdict"), status.alias("status"))


@query("SELECT backend, doc_id, field_key, verdict FROM graded", "graded")
def g1_presence(spark, d):
    return _graded(spark, d).select("backend", "doc_id", "field_key", "verdict")


@query("SELECT o_orderkey, CASE WHEN a <> d THEN 'wrong' WHEN o_orderkey % 5 = 0 THEN 'partial' ELSE 'correct' END AS verdict FROM dates", "dates")
def g2_dates(spark, d):
    return X.dates(spark, d).select("o_orderkey", G.date_verdict(F.col("truth"), F.col("answer")).alias("verdict"))


@query("SELECT l_orderkey, CASE WHEN max(l_quantity) = max(l_quantity) + CASE WHEN l_orderkey % 4 = 0 THEN 1 ELSE 0 END THEN 'correct' ELSE 'wrong' END AS one, CASE WHEN list_contains(list(l_quantity), min(l_quantity) + CASE WHEN l_orderkey % 3 = 0 THEN 0.5 ELSE 0 END) THEN 'correct' ELSE 'wrong' END AS several FROM lineitem GROUP BY l_orderkey")
def g3_numbers(spark, d):
    q = F.col("l_quantity").cast("double")
    o = S.table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.max(q).alias("hi"), F.min(q).alias("lo"), F.collect_list(q).alias("all"))
    off = lambda n, x: F.when(F.col("l_orderkey") % n == 0, x).otherwise(0.0)
    return o.select("l_orderkey", G.number_verdict(F.col("hi"), F.col("hi") + off(4, 1.0)).alias("one"), G.any_number_verdict(F.col("all"), F.col("lo") + off(3, 0.5)).alias("several"))


@query(r"SELECT doc_id, email, CASE WHEN doc_id % 3 <> 0 THEN 'correct' ELSE 'partial' END AS verdict FROM (SELECT doc_id, nullif(regexp_extract(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}', 0), '') AS email FROM documents) WHERE email IS NOT NULL")
def g6_contacts(spark, d):
    c = S.table(spark, d, "documents").select("doc_id", T.first_email(F.col("text")).alias("email")).where("email is not null")
    answer = F.when(F.col("doc_id") % 3 != 0, F.to_json(F.struct(F.lit("n/a").alias("name"), F.upper("email").alias("email")))).otherwise(F.lit('{"name":"?"}'))
    return c.select("doc_id", "email", G.contact_verdict(F.concat(F.lit("@@ "), F.col("email")), answer).alias("verdict"))


WORDED = "CASE WHEN i % 3 = 1 THEN s || ' as said before' ELSE s END"


@query(f"SELECT item_id, round(recall, 6) AS recall, CASE WHEN recall >= 0.8 THEN 'correct' WHEN recall >= 0.4 THEN 'partial' ELSE 'wrong' END AS verdict FROM (SELECT t.item_id, CAST(count(*) FILTER (WHERE best >= 65) AS DOUBLE) / count(*) AS recall FROM (SELECT t.item_id, t.i, coalesce(max({token_set('t.s', 'a.w')}), 0) AS best FROM seg t LEFT JOIN (SELECT item_id, {WORDED} AS w FROM seg WHERE i % 3 <> 0) a USING (item_id) GROUP BY ALL) t GROUP BY t.item_id)")
def g7_list_recall(spark, d):
    """Truth: a passage's segments; the answer drops every third and words others anew."""
    b = S.table(spark, d, "benchmark").select("item_id", T.segments(F.col("text")).alias("truth")).where(F.size("truth") > 0)
    said = F.transform(F.col("truth"), lambda x, i: F.when((i + 1) % 3 == 1, F.concat(x, F.lit(" as said before"))).otherwise(x))
    b = b.withColumn("answer", F.filter(said, lambda x, i: (i + 1) % 3 != 0)).withColumn("recall", G.list_recall(F.col("truth"), F.col("answer")))
    return b.select("item_id", F.round("recall", 6).alias("recall"), G.banded(F.col("recall"), G.RECALL_GOOD, G.RECALL_SOME).alias("verdict"))


ORACLES["g7_list_recall"] = f"WITH seg AS (SELECT item_id, unnest({SEGS_TEXT}) AS s, generate_subscripts({SEGS_TEXT}, 1) AS i FROM benchmark)\n" + ORACLES["g7_list_recall"]


@query(f"SELECT conv_id, turn, round({token_set('text', 'nxt')}, 4) AS similarity, CASE WHEN {token_set('text', 'nxt')} >= 70 THEN 'correct' WHEN {token_set('text', 'nxt')} >= 40 THEN 'partial' ELSE 'wrong' END AS verdict FROM (SELECT conv_id, turn, text, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS nxt FROM conversations) WHERE nxt IS NOT NULL")
def g8_free_text(spark, d):
    """Each turn against the next one, whole: similarity and band."""
    w = W.partitionBy("conv_id").orderBy("turn")
    rows = S.table(spark, d, "conversations").withColumn("nxt", F.lead("text").over(w)).where("nxt is not null")
    s = T.token_set_similarity(F.col("text"), F.col("nxt"))
    return rows.select("conv_id", "turn", F.round(s, 4).alias("similarity"), G.banded(s, G.TEXT_GOOD, G.TEXT_SOME).alias("verdict"))


@query("SELECT count(*) FILTER (WHERE doc_id % 3 = 0) AS hits, count(*) FILTER (WHERE doc_id % 3 <> 0) AS misses FROM truth", "truth")
def g9_judge_cache(spark, d):
    rows = X.truth(spark, d).withColumn("key", T.cache_key(F.col("field_key"), F.col("doc_id").cast("string")))
    cache = rows.where("doc_id % 3 = 0").select("key", F.lit("correct").alias("verdict"))
    hit, miss = G.cached(rows, cache)
    return hit.agg(F.count("*").alias("hits")).join(miss.agg(F.count("*").alias("misses")), F.lit(True))


@query("SELECT backend, doc_id, field_key, verdict IN ('partial', 'wrong') AND ((doc_id % 101) BETWEEN 60 AND 99 OR (doc_id % 10) / 10.0 BETWEEN 0.8 AND 0.9) AS mismatch FROM graded", "graded")
def g12_mismatch(spark, d):
    return _graded(spark, d).select("backend", "doc_id", "field_key", G.mismatch(F.col("verdict"), (F.col("doc_id") % 101).cast("double"), F.col("doc_id") % 10 / 10.0).alias("mismatch"))


# --- scores

COUNTS = "count(*) FILTER (WHERE verdict = 'correct') AS correct, count(*) FILTER (WHERE verdict = 'partial') AS partial, count(*) FILTER (WHERE verdict = 'wrong') AS wrong, count(*) FILTER (WHERE verdict = 'missing') AS missing, count(*) AS total"
ACC = COUNTS + ", round(count(*) FILTER (WHERE verdict = 'correct') / count(*), 4) AS accuracy, round((count(*) FILTER (WHERE verdict = 'correct') + 0.5 * count(*) FILTER (WHERE verdict = 'partial')) / count(*), 4) AS adjusted"


@query(f"SELECT backend, {ACC} FROM graded GROUP BY backend", "graded")
def a1_by_backend(spark, d):
    return score.verdict_counts(_graded(spark, d), ["backend"])


@query("SELECT backend, round((count(*) FILTER (WHERE verdict = 'correct') + count(*) FILTER (WHERE verdict = 'partial' AND status = 'verified')) / count(*), 4) AS grounded_accuracy FROM graded GROUP BY backend", "graded")
def a2_grounded_credit(spark, d):
    return score.grounded_credit(_graded(spark, d), ["backend"])


@query(f"SELECT backend, difficulty, {ACC} FROM graded GROUP BY backend, difficulty", "graded")
def a3_by_difficulty(spark, d):
    return score.verdict_counts(_graded(spark, d), ["backend", "difficulty"])


@query(f"SELECT backend, difficulty, field_key, {COUNTS}, CAST(grouping(backend, difficulty, field_key) AS INT) AS grain FROM graded GROUP BY GROUPING SETS ((), (backend), (difficulty), (field_key))", "graded")
def a4_multi_grain(spark, d):
    return score.multi_grain(_graded(spark, d), ["backend", "difficulty", "field_key"])


@query("SELECT event_type, round(sum(value), 4) AS total, round(avg(value), 4) AS mean, round(median(value), 4) AS med, arg_min(event_id, (value, event_id)) AS fastest, arg_max(event_id, (value, event_id)) AS slowest FROM events GROUP BY event_type")
def a6_latency(spark, d):
    k = F.struct("value", "event_id")
    rows = S.table(spark, d, "events")
    rest = rows.groupBy("event_type").agg(
        F.round(F.sum("value"), 4).alias("total"), F.round(F.avg("value"), 4).alias("mean"), F.min_by("event_id", k).alias("fastest"), F.max_by("event_id", k).alias("slowest"))
    return rest.join(score.exact_median(rows, ["event_type"], "value").withColumn("med", F.round("median", 4)).drop("median"), "event_type")


@query("SELECT backend, sum(tokens) AS tokens, round(sum(tokens) / count(DISTINCT doc_id), 1) AS per_doc FROM calls GROUP BY backend", "calls")
def a7_tokens(spark, d):
    return X.calls(spark, d).groupBy("backend").agg(F.sum("tokens").alias("tokens"), F.round(F.sum("tokens") / F.count_distinct("doc_id"), 1).alias("per_doc"))


@query("SELECT backend, doc_id, sum(tokens) AS tokens, round(sum(cost), 2) AS cost, count(*) FILTER (WHERE NOT ok) AS errors FROM calls GROUP BY backend, doc_id", "calls")
def a10_call_totals(spark, d):
    return X.calls(spark, d).groupBy("backend", "doc_id").agg(F.sum("tokens").alias("tokens"), F.round(F.sum("cost"), 2).alias("cost"), F.count_if(~F.col("ok")).alias("errors"))


@query("SELECT backend, cluster, round(sum(cost), 2) AS cost, count(*) AS calls FROM calls GROUP BY ROLLUP (backend, cluster)", "calls")
def a11_grand_totals(spark, d):
    return X.calls(spark, d).rollup("backend", "cluster").agg(F.round(F.sum("cost"), 2).alias("cost"), F.count("*").alias("calls"))


@query(f"SELECT b, count(*) AS docs, CAST(sum(asserted) AS BIGINT) AS present, CAST(sum(absent) AS BIGINT) AS absent, round(avg(groundedness), 4) AS groundedness, round(avg(hallucination), 4) AS hallucination FROM (SELECT b, doc_id, {RATES} FROM evidence GROUP BY b, doc_id) GROUP BY b", "evidence")
def a12_macro_summary(spark, d):
    return E.rates(_verified(spark, d), ["b", "doc_id"]).groupBy("b").agg(F.count("*").alias("docs"), F.sum("asserted").alias("present"), F.sum("absent").alias("absent"), F.round(F.avg("groundedness"), 4).alias("groundedness"), F.round(F.avg("hallucination"), 4).alias("hallucination"))


@query("SELECT doc_id, field_key, count(*) AS n, count(DISTINCT a) = 1 AS agree FROM answers WHERE a_present GROUP BY doc_id, field_key HAVING count(*) >= 2", "answers")
def a13_agreement(spark, d):
    return score.agreement(X.answers(spark, d).where("a_present").withColumn("shown", F.col("a").cast("string")))


@query("SELECT backend, count(*) FILTER (WHERE status = 'found') AS found, count(*) FILTER (WHERE status = 'not_found') AS missing, count(*) FILTER (WHERE status = 'needs_review') AS review, round(100.0 * count(*) FILTER (WHERE bucket = 'high') / count(*), 2) AS high FROM served3 GROUP BY backend", "served3")
def a15_tiles(spark, d):
    n = lambda s: F.count_if(F.col("status") == s)
    return _served(spark, d).groupBy("backend").agg(n("found").alias("found"), n("not_found").alias("missing"), n("needs_review").alias("review"), F.round(100.0 * F.count_if(F.col("bucket") == "high") / F.count("*"), 2).alias("high"))


@query("SELECT category, status, count(*) AS n FROM served3 GROUP BY category, status", "served3")
def a16_category_counts(spark, d):
    return _served(spark, d).groupBy("category", "status").agg(F.count("*").alias("n"))


@query("SELECT CASE status WHEN 'no_quote' THEN 'gave no quote' ELSE status END AS reason, count(*) AS n FROM evidence GROUP BY 1", "evidence")
def a18_reasons(spark, d):
    reason = F.when(F.col("status") == "no_quote", "gave no quote").otherwise(F.col("status"))
    return _verified(spark, d).groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


@query(f"SELECT o.b, o.doc_id, round(n.groundedness - o.groundedness, 3) AS change FROM (SELECT b, doc_id, {RATES} FROM evidence GROUP BY ALL) n JOIN (SELECT b, doc_id, {RATES} FROM (SELECT b, doc_id, CASE WHEN item_id % 2 = 0 AND status = 'verified' THEN 'unverified' ELSE status END AS status FROM evidence) GROUP BY ALL) o USING (b, doc_id)", "evidence")
def a19_drift(spark, d):
    v = _verified(spark, d)
    before = v.withColumn("status", F.when((F.col("item_id") % 2 == 0) & (F.col("status") == "verified"), "unverified").otherwise(F.col("status")))
    o = E.rates(before, ["b", "doc_id"]).select("b", "doc_id", F.col("groundedness").alias("was"))
    return E.rates(v, ["b", "doc_id"]).join(o, ["b", "doc_id"]).select("b", "doc_id", F.round(F.col("groundedness") - F.col("was"), 3).alias("change"))


@query("SELECT doc_id, field_key, max(verdict) FILTER (WHERE backend = 0) AS m0, max(verdict) FILTER (WHERE backend = 1) AS m1, max(verdict) FILTER (WHERE backend = 2) AS m2 FROM graded GROUP BY doc_id, field_key", "graded")
def a20_by_model(spark, d):
    return _graded(spark, d).groupBy("doc_id", "field_key").pivot("backend", [0, 1, 2]).agg(F.first("verdict")).select("doc_id", "field_key", *[F.col(str(k)).alias(f"m{k}") for k in range(3)])


@query("SELECT backend, difficulty, CASE WHEN p >= 65 THEN 'good' WHEN p >= 55 THEN 'mid' ELSE 'low' END AS band FROM (SELECT backend, difficulty, 100.0 * count(*) FILTER (WHERE verdict = 'correct') / count(*) AS p FROM graded GROUP BY ALL)", "graded")
def a21_bands(spark, d):
    return score.verdict_counts(_graded(spark, d), ["backend", "difficulty"]).select("backend", "difficulty", score.band(100.0 * F.col("correct") / F.col("total")).alias("band"))


@query("SELECT (SELECT count(*) FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM answers)) AS truth_only, (SELECT count(*) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)) AS unlabelled", "answers")
def j10_skipped(spark, d):
    t = X.truth(spark, d).join(X.answers(spark, d), "doc_id", "left_anti").agg(F.count("*").alias("truth_only"))
    return t.join(S.table(spark, d, "documents").join(X.truth(spark, d), "doc_id", "left_anti").agg(F.count("*").alias("unlabelled")), F.lit(True))


QUESTIONS = rf"""WITH qs AS (SELECT conv_id, turn, list_filter(string_split(trim(regexp_replace(replace(lower(text), '?', ''), '\s+', ' ', 'g')), ' '), lambda w: w NOT IN ({STOPS}) AND w <> '') AS ws FROM conversations WHERE role = 'user'),
dp AS ({{pages}}),
k AS (SELECT conv_id, turn, page_no, sum(least((length(lower(text)) - length(replace(lower(text), w, ''))) // length(w), 5)) AS s FROM (SELECT conv_id, turn, unnest(ws) AS w FROM qs) JOIN dp ON doc_id = conv_id WHERE trim(text) <> '' GROUP BY ALL HAVING s > 0),
kr AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY s DESC, page_no) - 1 AS rank FROM k),
pv AS (SELECT CAST(vec_id // 10 AS BIGINT) AS doc_id, CAST(vec_id % 10 + 1 AS INT) AS page_no, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
v AS (SELECT conv_id, turn, p.page_no, list_sum(list_transform(list_zip(p.v, q.v), lambda x: x[1] * x[2])) / sqrt(list_sum(list_transform(p.v, lambda x: x * x))) / sqrt(list_sum(list_transform(q.v, lambda x: x * x))) AS s FROM qs JOIN pv q ON q.doc_id = conv_id AND q.page_no = turn % 10 + 1 JOIN pv p ON p.doc_id = conv_id),
vr AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY s DESC, page_no) - 1 AS rank FROM v)
SELECT conv_id, turn, page_no, CAST(rank AS INT) AS rank, rank < 3 AS is_reference FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY s DESC, page_no) - 1 AS rank FROM (SELECT conv_id, turn, page_no, coalesce(1.0 / (60 + v.rank), 0) + coalesce(1.0 / (60 + k.rank), 0) AS s FROM vr v FULL JOIN kr k USING (conv_id, turn, page_no))) WHERE rank < 5"""


@query()
def r15_questions(spark, d):
    """Five pages of the document that a conversation is about (the one of its number) for each user
    turn: question words and, where pages have vectors, the turn's vector, fused; three are references."""
    q = S.table(spark, d, "conversations").where("role = 'user'").select("conv_id", "turn", T.question_tokens(F.col("text")).alias("ws"))
    v = X.page_vectors(spark, d)
    qv = q.join(v.select(F.col("doc_id").alias("conv_id"), "page_no", F.col("v").alias("q")), "conv_id").where(F.col("page_no") == F.pmod("turn", F.lit(10)) + 1)
    out = R.question_pages(q.withColumnRenamed("conv_id", "doc_id"), X.pages(spark, d), qv.select(F.col("conv_id").alias("doc_id"), "turn", "q"), v, ["turn"])
    return out.select(F.col("doc_id").alias("conv_id"), "turn", "page_no", "rank", (F.col("rank") < 3).alias("is_reference"))


ORACLES["r15_questions"] = QUESTIONS.replace("{pages}", "SELECT doc_id, CAST(i // 4 + 1 AS INT) AS page_no, string_agg(line, chr(10) ORDER BY i) AS text FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents) GROUP BY doc_id, i // 4")


# --- review


def _findings(spark, d):
    q = X.quotes(spark, d)
    return q.select(F.floor(F.col("item_id") / 3).cast("long").alias("finding_id"), (F.col("item_id") * 3 + F.col("b")).alias("source_no"), "doc_id", "present", "page", "quote").distinct()


@query("SELECT item_id // 3 AS finding_id, doc_id FROM evidence GROUP BY ALL HAVING bool_or(status IN ('verified', 'wrong_page'))", "evidence")
def v1_findings(spark, d):
    return review.verified_findings(_findings(spark, d), X.pages(spark, d)).select("finding_id", "doc_id")


@query("SELECT o_custkey AS doc_id, o_orderpriority AS label, count(DISTINCT CAST(o_orderdate AS DATE)) AS n FROM orders GROUP BY ALL HAVING n > 1")
def v2_conflicts(spark, d):
    day = T.extract_date(F.date_format(F.to_date("o_orderdate"), "MMMM d, yyyy"))
    return review.conflicting(S.table(spark, d, "orders").select(F.col("o_custkey").alias("doc_id"), F.col("o_orderpriority").alias("label"), day.alias("value")))


@query(r"SELECT DISTINCT r.doc_id, ref FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), 'version [0-9]+|section [0-9]+')) AS ref FROM documents) r WHERE (doc_id, ref) NOT IN (SELECT doc_id, regexp_extract(lower(line), '^(version|section) [0-9]+', 0) FROM lines)", "lines")
def v3_missing_references(spark, d):
    return review.missing_references(X.pages(spark, d), r"version [0-9]+|section [0-9]+", r"^(version|section) [0-9]+")


@query(r"SELECT doc_id, head, firm, loose FROM (SELECT doc_id, head, count(*) FILTER (WHERE modal IN ('the', 'of')) AS firm, count(*) FILTER (WHERE modal IN ('and', 'to')) AS loose FROM (SELECT doc_id, regexp_extract(s, '^(\S+ \S+) .*?\b(the|of|and|to)\b', 1) AS head, regexp_extract(s, '^(\S+ \S+) .*?\b(the|of|and|to)\b', 2) AS modal FROM (SELECT doc_id, trim(unnest(string_split_regex(lower(text), '[.\n]'))) AS s FROM doc_pages)) WHERE head <> '' GROUP BY ALL) WHERE firm > 0 AND loose > 0", "doc_pages")
def v4_modals(spark, d):
    return review.modal_clashes(X.pages(spark, d), "the|of", "and|to")


@query("SELECT l_orderkey, round(sum(l_quantity), 6) AS total FROM lineitem GROUP BY l_orderkey HAVING round(sum(l_quantity), 6) <> 100")
def v5_weights(spark, d):
    return review.weights_off(S.table(spark, d, "lineitem").withColumn("q", F.col("l_quantity").cast("double")), "l_orderkey", "q")


@query(r"SELECT doc_id, n FROM (SELECT doc_id, len(list_distinct(regexp_extract_all(lower(CASE WHEN doc_id % 3 = 0 THEN text || ' Write to Help@Mail.example or see https://mail.example/x' ELSE text END), '[a-z0-9._%+-]+@[a-z0-9.-]+\.[a-z]{2,}|https?://[a-z0-9.-]+'))) AS n FROM documents) WHERE n > 1")
def v6_contacts(spark, d):
    """Documents, every third with two contacts more at its end."""
    more = F.when(F.col("doc_id") % 3 == 0, F.concat("text", F.lit(" Write to Help@Mail.example or see https://mail.example/x"))).otherwise(F.col("text"))
    return review.several_contacts(S.table(spark, d, "documents").select("doc_id", more.alias("text"))).select("doc_id", F.col("n").cast("long").alias("n"))


@query(r"SELECT DISTINCT doc_id, acronym FROM (SELECT doc_id, unnest(list_filter(string_split_regex(text, '[^A-Za-z0-9_]+'), lambda w: regexp_matches(w, '^[A-Z]{3,6}$'))) AS acronym FROM documents) WHERE (doc_id, acronym) NOT IN (SELECT doc_id, unnest(regexp_extract_all(text, '\(([A-Z]{3,6})\)', 1)) FROM documents)")
def v7_acronyms(spark, d):
    return review.undefined_acronyms(S.table(spark, d, "documents"))


@query("SELECT 'labelled documents' AS what, count(*) AS n, 'ok' AS state FROM labels")
def q1_row_counts(spark, d):
    """Every label has its document, once."""
    labels = S.table(spark, d, "labels")
    return S.expect_rows(S.table(spark, d, "documents").join(labels, "doc_id"), labels.count(), "labelled documents")


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'quote' ELSE '' END AS missing, CASE WHEN doc_id % 4 = 0 THEN 'note' ELSE '' END AS extra FROM documents WHERE doc_id % 3 = 0 OR doc_id % 4 = 0")
def q2_contract(spark, d):
    m = F.map_filter(F.create_map(*[x for k in ("page", "quote", "value", "note") for x in (F.lit(k), F.lit(1))]),
                     lambda k, v: ~((k == "quote") & (F.col("doc_id") % 3 == 0)) & ~((k == "note") & (F.col("doc_id") % 4 != 0)))
    out = S.contract_breaches(S.table(spark, d, "documents").select("doc_id", m.alias("m")), "m", ["page", "quote", "value"])
    return out.select("doc_id", F.array_join("missing", ",").alias("missing"), F.array_join("extra", ",").alias("extra"))


@query("SELECT b, doc_id, item_id FROM quotes WHERE present AND (page IS NULL OR quote IS NULL)", "quotes")
def q3_citations(spark, d):
    return X.quotes(spark, d).where("present and (page is null or quote is null)").select("b", "doc_id", "item_id")


# --- streams


@query("SELECT time_bucket(INTERVAL '15 seconds', ts) AS start, CASE WHEN value < 0 THEN 0 WHEN value >= 100 THEN 11 ELSE CAST(floor(value / 10) AS INT) + 1 END AS bucket, count(*) AS n FROM events GROUP BY ALL")
def m2_request_rates(spark, d):
    """The events read as a stream; each update of a window replaces the one before."""
    path = f"{d}/events.parquet"
    schema = spark.read.parquet(path).schema
    rates = feeds.request_rates(spark.readStream.schema(schema).parquet(f"{path}*"))
    out = feeds.drain(rates, spark, ["start", "bucket"], "batch", mode="update")
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "bucket", "n")


@query()
def m1_incremental(spark, d):
    """Labels arrive as a stream and are graded batch by batch."""
    path = f"{d}/labels.parquet"
    stream = spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{path}*")
    k = F.pmod("doc_id", F.lit(5)) == 0
    graded = stream.select("doc_id", G.boolean_verdict(F.col("quality") == 1, (F.col("quality") == 1) != k).alias("verdict"))
    return feeds.drain(graded, spark, ["doc_id"], "batch")


ORACLES["m1_incremental"] = "SELECT DISTINCT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'wrong' ELSE 'correct' END AS verdict FROM labels"


from quillmark.plans import chains, records  # noqa: E402,F401  register their queries here


def flagship(spark, d):
    """What share of quoted passages is really in the cited source?"""
    return e8_pooled(spark, d)
