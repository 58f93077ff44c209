"""Page selection against its SQL on odd inputs, and how often it meets its rows."""

import duckdb
import pytest
from pyspark.sql import functions as F
from test_catalog import plain

from quillmark.operators import retrieve as R
from quillmark.plans import catalog

LINES = ["the license of the nation", "contact us @ home and the rest", "nothing here", "LICENSED under version 2 on the table", "é of the ünder and the", ""]


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """Documents without id, without text, and of many pages with few hits."""
    path = str(tmp_path_factory.mktemp("odd"))
    text = lambda n, step: "\n".join(LINES[(k * step + k // 5) % 6] for k in range(n))
    docs = [(None, text(30, 1)), (1, text(70, 1)), (2, None), (3, ""), (4, "nothing here\n" * 60 + text(24, 1)), (5, text(160, 7)), (6, "the")]
    spark.createDataFrame(docs, "doc_id long, text string").coalesce(1).write.parquet(f"{path}/documents.parquet")
    return path


@pytest.mark.parametrize("name", ["r14_selection", "r13_selection_capped", "r1_keyword_score"])
def test_odd_documents(spark, odd, name):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{odd}/documents.parquet/*.parquet')")
    assert plain(catalog.QUERIES[name](spark, odd).toPandas()) == plain(con.execute(catalog.ORACLES[name]).df())


def test_rows_meet_once(spark, capsys):
    """Only table continuations are joined by page, scores are used once, and no characters are counted."""
    pages = spark.range(40).select(F.lit(1).alias("doc_id"), (F.col("id") + 1).cast("int").alias("page_no"), F.lit("word").alias("text"))
    fields = spark.createDataFrame([("f", 1, "table", "c")], "field_key string, number int, type string, cluster string")
    scores = R.keyword_scores(pages, spark.createDataFrame([("f", "c", "word")], "field_key string, cluster string, keyword string"), ["field_key", "cluster"])
    top = R.top_ranked(scores, ["field_key"]).join(F.broadcast(fields.select("field_key", "type")), "field_key")
    chosen = R.select_pages(pages.select("doc_id", "page_no"), fields, scores, top, pages.select("doc_id", "page_no", F.lit(True).alias("is_table")), cap=R.CAP)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    spark.conf.set("spark.sql.adaptive.enabled", False)
    try:
        chosen.explain()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")
    plan = capsys.readouterr().out
    assert plan.count("SortMergeJoin") <= 1 and plan.count("BroadcastNestedLoopJoin") <= 4
    assert chosen.first().pages[:2] == [1, 2]
    scores.explain()
    assert "char_length" not in (plan := capsys.readouterr().out) and " length(" not in plan and "-length(" not in plan
