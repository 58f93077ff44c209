"""Consistency review: rules over a document's pages, findings kept only with a verified source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmark.functions import text as T
from quillmark.operators import evidence

SEVERITIES = ("critical", "high", "medium", "low")


def verified_findings(sources: DataFrame, pages: DataFrame) -> DataFrame:
    """finding_id, doc_id, sources, verified: findings of which at least one quote stands in its document. A source may
    be cited on several pages, in other words on each; all of these quotes are judged."""
    # a null page is no key for joins
    sources = sources.withColumn("page", F.coalesce("page", F.lit(-1)))
    checked = evidence.verify(sources, pages, ["finding_id", "source_no", "doc_id", "page"])
    ok = F.col("status").isin("verified", "wrong_page")
    return checked.groupBy("finding_id", "doc_id").agg(F.count("*").alias("sources"), F.count_if(ok).alias("verified")).where("verified > 0")


#: A line that states something: a label, then a colon, an equals sign, a spaced dash or a leader, then the value.
STATEMENT = r"^\s*([\p{L}][\p{L}\d ()/&'-]{1,60}?)\s*(?:[:=]|\.{3,}|\s[–—-]\s)\s*(\S.*?)\s*$"
#: What parts the cells of a line, and rows that only repeat a sum or rule off a header.
CELLS, TOTALS, RULE = r"\s*\|\s*|\t+|\s{3,}", r"^(sub)?totals?\b", r"^[\s|:+=-]*$"


def statements(pages: DataFrame) -> DataFrame:
    """doc_id, page_no, line_no, label, kind, value: what the lines of documents state.

    Labels are squeezed and in lower case. kind: amount (currency and number), date, number (a percentage or a
    plain one) or text. Written differently, equal dates and amounts have one value. Label and values are made as the lines
    are taken apart, so that conditions on the result do not make them again."""
    parts = F.transform(F.split("text", "\n"), lambda line, i: F.struct(
        i.alias("line_no"), F.regexp_extract(line, STATEMENT, 1).alias("label"), F.regexp_extract(line, STATEMENT, 2).alias("raw")))
    rows = pages.select("doc_id", "page_no", F.inline(F.filter(parts, lambda x: x["label"] != "")))
    number = F.nullif(F.regexp_extract("raw", r"^([\d,]*\d(?:\.\d+)?)\s*(?:%|points?|percent)?$", 1), F.lit(""))
    read = F.struct(T.squeeze(F.col("label")).alias("label"), "raw", T.extract_amount(F.col("raw")).alias("amount"), T.extract_date(F.col("raw")).alias("day"),
                    F.replace(number, F.lit(",")).try_cast("double").alias("number"))
    rows = rows.select("doc_id", "page_no", "line_no", F.inline(F.array(read)))
    kind = F.when(F.col("amount").isNotNull(), "amount").when(F.col("day").isNotNull(), "date").when(F.col("number").isNotNull(), "number").otherwise("text")
    value = F.coalesce("amount", F.col("day").cast("string"), F.col("number").cast("string"), T.squeeze(F.col("raw")))
    return rows.select("doc_id", "page_no", "line_no", "label", kind.alias("kind"), value.alias("value"))


def conflicts(stated: DataFrame) -> DataFrame:
    """doc_id, label, kind, n, values: dates and amounts that a document states in more than one way under one label."""
    sets = stated.where(F.col("kind").isin("date", "amount")).groupBy("doc_id", "label", "kind").agg(F.array_sort(F.collect_set("value")).alias("values"))
    return sets.where(F.size("values") > 1).select("doc_id", "label", "kind", F.size("values").alias("n"), "values")


def table_cells(pages: DataFrame) -> DataFrame:
    """doc_id, page_no, table_no, row_no, col_no, header, cell of the tables in pages.

    Lines in a row with equally many cells (two at least) are a table; its first line is the header, rules are left
    out. table_no is the line of the header."""
    cells_of = lambda line: F.transform(F.split(F.trim(F.regexp_replace(F.trim(line), r"^\||\|$", "")), CELLS), lambda x: F.trim(x))
    lines = F.transform(F.split("text", "\n"), lambda line, i: F.struct(i.alias("line_no"), line.alias("line")))
    rows = F.transform(F.filter(lines, lambda x: ~x["line"].rlike(RULE)), lambda x: F.struct(x["line_no"].alias("line_no"), cells_of(x["line"]).alias("cells")))

    def tables(r: Column) -> Column:
        width = lambda i: F.size(F.get(r, i)["cells"])
        places = F.when(F.size(r) > 0, F.sequence(F.lit(0), F.size(r) - 1)).otherwise(F.array().cast("array<int>"))
        starts = F.filter(places, lambda i: (i == 0) | (width(i) != width(i - 1)))
        ended = T.bind(starts, lambda s: F.transform(s, lambda i, k: F.slice(r, i + 1, F.coalesce(F.get(s, k + 1), F.size(r)) - i)))
        return F.filter(ended, lambda t: (F.size(t) > 1) & (F.size(t[0]["cells"]) > 1))

    # a page is taken apart in place: lines are neither dealt nor ordered again
    found = pages.select("doc_id", "page_no", F.explode(T.bind(rows, tables)).alias("t"))
    found = found.select("doc_id", "page_no", F.col("t")[0]["line_no"].alias("table_no"), F.transform(F.col("t")[0]["cells"], T.squeeze).alias("names"),
                         F.posexplode(F.slice("t", F.lit(2), F.size("t") - 1)).alias("at", "r"))
    cells = found.select("doc_id", "page_no", "table_no", (F.col("at") + 1).alias("row_no"), T.squeeze(F.col("r.cells")[0]).alias("head"),
                         F.posexplode(F.arrays_zip(F.col("names").alias("header"), F.col("r.cells").alias("cell"))).alias("col_no", "c"))
    return cells.select("doc_id", "page_no", "table_no", "row_no", "col_no", F.col("c.header").alias("header"), F.col("c.cell").alias("cell"), "head")


def weight_sums(cells: DataFrame) -> DataFrame:
    """doc_id, page_no, table_no, col_no, total: sums of the columns that hold weights or points, without rows of totals."""
    number = F.replace(F.regexp_extract("cell", r"^\s*([\d,]*\d(?:\.\d+)?)\s*(?:%|points?)?\s*$", 1), F.lit(",")).try_cast("double")
    of = cells.where(F.col("header").rlike(r"weight|points|score|%")).where(~F.col("head").rlike(TOTALS)).withColumn("number", number)
    return of.groupBy("doc_id", "page_no", "table_no", "col_no").agg(F.round(F.sum("number"), 6).alias("total")).where("total is not null")


def minimum_breaches(stated: DataFrame, sums: DataFrame) -> DataFrame:
    """doc_id, label, minimum, most: stated minimum scores that no table of the document can reach."""
    least = stated.where((F.col("kind") == "number") & F.col("label").rlike(r"\bminimum\b")).select("doc_id", "label", F.col("value").cast("double").alias("minimum"))
    most = sums.groupBy("doc_id").agg(F.max("total").alias("most"))
    return least.join(most, "doc_id").where("minimum > most")


def conflicting(stated: DataFrame) -> DataFrame:
    """doc_id, label, n of values that a document states in more than one way."""
    return stated.groupBy("doc_id", "label").agg(F.count_distinct("value").alias("n")).where("n > 1")


def missing_references(pages: DataFrame, pattern: str, heading: str) -> DataFrame:
    """doc_id, ref: references for which the document has no heading line."""
    refs = pages.select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(pattern), F.lit(0)))).alias("ref")).distinct()
    heads = pages.select("doc_id", F.explode(F.split(F.lower("text"), "\n")).alias("line")).select("doc_id", F.regexp_extract("line", heading, 0).alias("ref")).where("ref <> ''").distinct()
    return refs.join(heads, ["doc_id", "ref"], "left_anti")


def modal_clashes(pages: DataFrame, hard: str, soft: str) -> DataFrame:
    """doc_id, head: sentences of a document that begin alike, once with a hard and once with a soft modal."""
    s = pages.select("doc_id", F.explode(F.split(F.lower("text"), r"[.\n]")).alias("s")).select("doc_id", F.trim("s").alias("s"))
    m = s.select("doc_id", F.regexp_extract("s", rf"^(\S+ \S+) .*?\b({hard}|{soft})\b", 1).alias("head"), F.regexp_extract("s", rf"^(\S+ \S+) .*?\b({hard}|{soft})\b", 2).alias("modal")).where("head <> ''")
    kinds = m.groupBy("doc_id", "head").agg(F.count_if(F.col("modal").rlike(f"^({hard})$")).alias("firm"), F.count_if(F.col("modal").rlike(f"^({soft})$")).alias("loose"))
    return kinds.where("firm > 0 and loose > 0")


def weights_off(rows: DataFrame, by: str, weight: str, total: float = 100.0) -> DataFrame:
    return rows.groupBy(by).agg(F.round(F.sum(weight), 6).alias("total")).where(F.col("total") != total)


def several_contacts(docs: DataFrame) -> DataFrame:
    """doc_id, n of documents that name more than one mail address or site."""
    found = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"[a-z0-9._%+-]+@[a-z0-9.-]+\.[a-z]{2,}|https?://[a-z0-9.-]+"), F.lit(0)))
    return docs.select("doc_id", F.size(found).alias("n")).where("n > 1")


def undefined_acronyms(docs: DataFrame) -> DataFrame:
    """doc_id, acronym: capitals that never stand in brackets, where they would be introduced."""
    runs = F.filter(F.split("text", "[^A-Za-z0-9_]+"), lambda w: w.rlike("^[A-Z]{3,6}$"))
    all_ = docs.select("doc_id", F.explode(F.array_distinct(runs)).alias("acronym"))
    known = docs.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(r"\(([A-Z]{3,6})\)"), F.lit(1))).alias("acronym")).distinct()
    return all_.join(known, ["doc_id", "acronym"], "left_anti")


def finding_filter(findings: DataFrame, severity: str | None = None, category: str | None = None) -> DataFrame:
    """Findings of a severity and a category, where these are set."""
    for name, value in (("severity", severity), ("category", category)):
        if value is not None:
            findings = findings.where(F.col(name) == value)
    return findings


def finding_counts(findings: DataFrame, by: list[str]) -> DataFrame:
    """Totals by severity, and the findings that are only potential."""
    n = lambda s: F.count_if(F.col("severity") == s).alias(s)
    return findings.groupBy(*by).agg(F.count("*").alias("total"), *[n(s) for s in SEVERITIES], F.count_if("potential").alias("potential"))
