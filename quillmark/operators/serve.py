"""Views for readers: served fields, filters, context blocks, conversations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quillmark.sources.tables import variant_kind

#: Cuts of page text for one block and for all pages, and the total.
PAGE_CUT, SHORT_CUT, TOTAL_CUT, TURNS = 12_000, 3_000, 100_000, 6
#: Fixed value: characters of a page that its vector is made from.
EMBED_CUT = 8_000
MARK = "\n[... page truncated ...]"


def context_blocks(pages: DataFrame, by: list[str], cut: int = PAGE_CUT) -> DataFrame:
    """by, block: numbered pages in order, long ones cut and marked."""
    body = F.trim("text")
    body = F.when(F.length(body) > cut, F.concat(F.left(body, F.lit(cut)), F.lit(MARK))).otherwise(body)
    part = F.concat(F.lit("===== PAGE "), F.col("page_no").cast("string"), F.lit(" =====\n"), body)
    lists = pages.select(*by, F.struct("page_no", part.alias("part")).alias("p")).groupBy(*by).agg(F.array_sort(F.collect_list("p")).alias("ps"))
    return lists.select(*by, F.array_join(F.transform("ps", lambda p: p["part"]), "\n\n").alias("block"))


def capped(block: Column, total: int = TOTAL_CUT) -> Column:
    return F.when(F.length(block) > total, F.concat(F.left(block, F.lit(total)), F.lit(MARK))).otherwise(block)


def last_turns(turns: DataFrame, n: int = TURNS) -> DataFrame:
    w = W.partitionBy("conv_id").orderBy(F.desc("turn"))
    return turns.withColumn("back", F.row_number().over(w)).where(F.col("back") <= n).drop("back")


def fold_system(turns: DataFrame) -> DataFrame:
    """A leading system text moves into the first user turn; its own row goes."""
    w = W.partitionBy("conv_id")
    s = F.min_by(F.when((F.col("role") == "system") & (F.col("turn") == F.col("first")), F.col("text")), "turn").over(w)
    rows = turns.withColumn("first", F.min("turn").over(w))
    rows = rows.withColumn("lead", F.max(F.when((F.col("role") == "system") & (F.col("turn") == F.col("first")), F.col("text"))).over(w))
    rows = rows.withColumn("user", F.min(F.when(F.col("role") == "user", F.col("turn"))).over(w))
    text = F.when((F.col("turn") == F.col("user")) & F.col("lead").isNotNull(), F.concat("lead", F.lit("\n\n"), "text")).otherwise(F.col("text"))
    folds = F.col("lead").isNotNull() & F.col("user").isNotNull() & (F.col("role") == "system") & (F.col("turn") == F.col("first"))
    return rows.where(~folds).select("conv_id", "turn", "role", text.alias("text"))


def field_filter(served: DataFrame, category=None, status=None, confidence=None, search=None) -> DataFrame:
    """Rows that pass every filter that is set; the search looks at label and value."""
    for name, value in (("category", category), ("status", status), ("confidence", confidence)):
        if value is not None:
            served = served.where(F.col(name) == value)
    if search:
        served = served.where(F.contains(F.lower("label"), F.lit(search.lower())) | F.contains(F.lower(F.coalesce("value", F.lit(""))), F.lit(search.lower())))
    return served


def comparable(kind: Column, present: Column, text: Column, items: Column, email: Column | None = None, name: Column | None = None) -> Column:
    """Form in which backends are held against each other; a contact is its address, else its name."""
    none = F.lit(None).cast("string")
    contact = F.lower(F.coalesce(F.nullif(none if email is None else email, F.lit("")), none if name is None else name, text))
    body = F.when(kind == "contact", contact).when(kind == "list", F.array_join(F.array_sort(F.transform(items, lambda x: F.lower(x))), " | ")).otherwise(F.lower(text))
    return F.when(~present, "<absent>").otherwise(F.substring(F.trim(F.regexp_replace(body, r"\s+", " ")), 1, 120))


#: Members that name a contact, in order, and that name a row of a table.
CONTACT, ROW_NAMES = ("name", "email", "phone"), ("category", "coverage_type", "criterion", "coverage")


def member(v: Column, name: str) -> Column:
    """A member of a VARIANT object as text; null where it is none, empty or no plain value."""
    return F.nullif(F.trim(F.try_variant_get(v, f"$.{name}", "string")), F.lit(""))


def variant_items(v: Column) -> Column:
    """The elements of a VARIANT array as VARIANTs; any other value stands alone."""
    return F.coalesce(F.try_variant_get(v, "$", "array<variant>"), F.array(v))


def row_name(v: Column) -> Column:
    """What a row of a table or an item of a list is called: its naming member, else its text, else all of it."""
    return F.coalesce(*[member(v, c) for c in ROW_NAMES], F.try_variant_get(v, "$", "string"), F.to_json(v))


def typed_text(v: Column, joined: str = "; ") -> Column:
    """A VARIANT as one string, by its own type: contacts by their members, lists by item, numbers with their unit."""
    kind, number = variant_kind(v), F.try_variant_get(v, "$", "double")
    plain = lambda n: F.when(n == F.floor(n), n.cast("long").cast("string")).otherwise(n.cast("string"))
    contact = F.filter(F.array(*[member(v, c) for c in CONTACT]), lambda x: x.isNotNull())
    inner = F.try_variant_get(v, "$.value", "double")
    listed = F.array_join(F.filter(F.transform(variant_items(v), row_name), lambda x: F.trim(x) != ""), joined)
    return (F.when(kind == "null", F.lit(None).cast("string")).when(kind == "array", listed).when(kind == "boolean", F.when(F.try_variant_get(v, "$", "boolean"), "Yes").otherwise("No"))
            .when(kind == "number", plain(number)).when((kind == "object") & (F.size(contact) > 0), F.array_join(contact, " — "))
            .when((kind == "object") & inner.isNotNull(), F.concat_ws(" ", plain(inner), member(v, "unit"))).when(kind == "object", row_name(v)).otherwise(F.try_variant_get(v, "$", "string")))


def typed_comparable(v: Column, present: Column) -> Column:
    """Form in which backends are held against each other, from a VARIANT: contacts by address, else name; lists sorted."""
    kind = variant_kind(v)
    items = F.array_sort(F.transform(variant_items(v), lambda x: F.lower(row_name(x))))
    body = F.when(kind == "array", F.array_join(items, " | ")).when(kind == "object", F.coalesce(member(v, "email"), member(v, "name"), typed_text(v))).otherwise(typed_text(v))
    return F.when(~present | body.isNull(), "<absent>").otherwise(F.substring(F.trim(F.regexp_replace(F.lower(body), r"\s+", " ")), 1, 120))


def embedding_input(page_no: Column, text: Column, cut: int = EMBED_CUT) -> Column:
    return F.concat(F.lit("Page "), page_no.cast("string"), F.lit(": "), F.left(text, F.lit(cut)))


def field_query(label: Column, guidance: Column) -> Column:
    """What a field is searched by."""
    return F.concat(label, F.lit(". "), guidance)


def display(kind: Column, text: Column, items: Column, parts: Column, number: Column, unit: Column, raw: Column) -> Column:
    """One string for a value of any type; parts are a contact's name, address and phone."""
    shown = F.when(number == F.floor(number), number.cast("long").cast("string")).otherwise(number.cast("string"))
    full = lambda a: F.filter(a, lambda x: F.coalesce(F.trim(x) != "", F.lit(False)))
    return (F.when(kind == "contact", F.array_join(full(parts), " — ")).when(kind.isin("list", "table"), F.array_join(full(items), "; "))
            .when(kind == "number", F.concat_ws(" ", shown, unit)).when(kind == "boolean", F.when(number == 1, "Yes").otherwise("No"))
            .when(kind == "datetime", F.coalesce(F.nullif(raw, F.lit("")), text)).otherwise(text))


def served_rows(answers: DataFrame, fields: DataFrame) -> DataFrame:
    """The answers with label and category of their field, and where their quote stands."""
    at = F.when(F.col("page").isNotNull(), F.concat(F.lit("p. "), F.col("page").cast("string")))
    return answers.join(fields, "field_key").withColumn("source", F.struct(at.alias("at"), F.col("quote").alias("quote")))


def request_rows(pages: DataFrame, fields: DataFrame, by: list[str], header: str) -> DataFrame:
    """by, body: header, listed pages, the cluster's fields, and the pages' context, for each selection.

    ``pages``: by (cluster among them), page_no, text. ``fields``: cluster, number, field_key, guidance.
    """
    blocks = context_blocks(pages, by).withColumn("block", capped(F.col("block")))
    listed = pages.groupBy(*by).agg(F.array_join(F.transform(F.array_sort(F.collect_set("page_no")), lambda x: x.cast("string")), ", ").alias("listed"))
    line = F.concat(F.lit("- "), "field_key", F.lit(": "), "guidance")
    asked = fields.groupBy("cluster").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("number", line.alias("line")))), lambda x: x["line"]), "\n").alias("asked"))
    body = F.concat_ws("\n\n", F.lit(header), F.concat(F.lit("Pages: "), "listed"), "asked", "block")
    return blocks.join(listed, by).join(asked, "cluster").select(*by, body.alias("body"))
