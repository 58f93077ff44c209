"""Findings against their SQL, where passages stand more than once or beside odd text."""

import duckdb
import pytest
from test_catalog import plain

from quillmark.plans import catalog

PASSAGE = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"
LONG, SHORT = " ".join(f"more{k}" for k in range(12)), "the end"


def written(spark, path, texts, passages):
    spark.createDataFrame(texts, "doc_id long, text string").coalesce(1).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(passages, "item_id long, text string").coalesce(1).write.parquet(f"{path}/benchmark.parquet")


def both(spark, path, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"create view {t} as select * from read_parquet('{path}/{t}.parquet/*.parquet')")
    return plain(catalog.QUERIES[name](spark, path).toPandas()), plain(con.execute(catalog.ORACLES[name]).df())


@pytest.mark.parametrize("order", [(LONG, SHORT), (SHORT, LONG)])
def test_every_page_of_a_source_counts(spark, tmp_path, order):
    """A passage on two pages; of the quotes that go on to the next page, only the one before a long page is found."""
    page = lambda *lines: [*lines, *[""] * (4 - len(lines))]
    text = "\n".join([line for on in order for line in page(f"x {PASSAGE} and so on") + page(on)][:-3])
    # of these, no other backend quotes the passage as it stands
    written(spark, str(tmp_path), [(d, text) for d in range(0, 60, 5)], [(0, PASSAGE)])
    got, want = both(spark, str(tmp_path), "v1_findings")
    assert got == want and len(got[1]) == 12


@pytest.mark.parametrize("name", ["v1_findings", "e6_status"])
def test_passages_within_words_and_brief_ones(spark, tmp_path, name):
    """A passage may begin and end within a word of the page, and may have any number of words."""
    around = ["({})", '"{}"', "un{}s", "on {} and", "{}", "a\tb {}.\nthe"]
    brief = ["seven", "en", "twelve thirteen", "ten eleven twelve", "two three four five", "six seven eight nine ten", "one two three four five six", "two three four five six seven eight", ""]
    texts = [(d, "before\n" + around[d % 6].format(PASSAGE) + "\nafter\n" * (d % 3)) for d in range(60)]
    written(spark, str(tmp_path), texts, [*enumerate([PASSAGE, *brief])])
    got, want = both(spark, str(tmp_path), name)
    assert got == want and len({r[got[0].index("doc_id")] for r in got[1]}) == 60
