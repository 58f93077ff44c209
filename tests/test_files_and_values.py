"""Manifests that read changed files only, the page cache, nested contracts and values of any type."""

import json
import os

import pytest
from pyspark.sql import functions as F

from quillmark.operators import grade as G
from quillmark.operators import retrieve as R
from quillmark.operators import serve
from quillmark.plans import chains
from quillmark.sources import tables as S
from quillmark.sources.cache import PageCache


def put(folder, name, text, when):
    path = folder / name
    path.write_text(text)
    os.utime(path, (when, when))


def state(df):
    return {r.path.rsplit("/", 1)[1]: r.sha256 for r in df.collect()}


def test_manifest_reads_changed_files_only(spark, tmp_path):
    for k in range(4):
        put(tmp_path, f"f{k}", f"text {k}", 1_700_000_000 + k)
    old = S.kept(S.manifest(spark, str(tmp_path)))
    put(tmp_path, "f0", "TEXT 0", 1_700_000_000)  # other content under the same length and time: not opened
    put(tmp_path, "f1", "text 1, longer", 1_700_000_001)
    put(tmp_path, "f4", "new", 1_700_000_900)
    (tmp_path / "f3").unlink()
    new = S.kept(S.manifest(spark, str(tmp_path), old))
    a, b = state(old), state(new)
    assert a["f0"] == b["f0"] and a["f1"] != b["f1"] and a["f2"] == b["f2"] and set(b) == {"f0", "f1", "f2", "f4"}
    name = F.regexp_extract("path", r"[^/]+$", 0)
    drift = {r.name: r.change for r in S.drift(old.withColumn("name", name), new.withColumn("name", name), "name").collect()}
    assert drift == {"f0": "same", "f1": "changed", "f2": "same", "f3": "removed", "f4": "added"}
    assert state(S.manifest(spark, str(tmp_path), new)) == b


def test_page_cache(spark, tmp_path):
    files, cache = tmp_path / "files", PageCache(spark, str(tmp_path / "cache"))
    files.mkdir()
    seen = lambda: sorted((r.path.rsplit("/", 1)[1], r.page_no, r.text) for r in cache.pages().collect())
    put(files, "a", "1\n2\n3\n4\n5", 1_700_000_000)
    put(files, "b", "one", 1_700_000_001)
    assert cache.refresh(str(files)) == 2 and cache.refresh(str(files)) == 0
    assert seen() == [("a", 1, "1\n2\n3\n4"), ("a", 2, "5"), ("b", 1, "one")]
    put(files, "b", "two\n", 1_700_000_700)
    put(files, "c", " ", 1_700_000_701)
    (files / "a").unlink()
    (tmp_path / "cache" / "manifest-9").mkdir()  # a lost run
    assert cache.refresh(str(files)) == 2
    assert seen() == [("b", 1, "two\n"), ("c", 1, " ")]


def breaches(row, spec, path="$"):
    """The contract walked on plain Python values."""
    # a member of an object of the wrong type is not looked at; so is one below a member that is too many
    kind = {dict: "object", list: "array", str: "string", bool: "boolean", int: "number", float: "number", type(None): "null"}[type(row)]
    want = "object" if isinstance(spec, dict) else "array" if isinstance(spec, list) else spec
    if kind not in want.split("|"):
        return {(path, "wrong type")}
    out = set()
    if isinstance(spec, dict):
        out |= {(f"{path}.{k}", "missing") for k in spec.keys() - row.keys()} | {(f"{path}.{k}", "extra") for k in row.keys() - spec.keys()}
        for k in spec.keys() & row.keys():
            out |= breaches(row[k], spec[k], f"{path}.{k}")
    if isinstance(spec, list):
        for x in row:
            out |= breaches(x, spec[0], f"{path}[]")
    return out


GOOD = {"id": 1, "state": {"code": "x", "paid": {"total": 2.5, "currency": None}}, "lines": [{"part": 1, "note": ""}]}


@pytest.mark.parametrize("change", [
    {}, {"id": "1"}, {"id": None}, {"more": 1}, {"state": 3}, {"state": {}}, {"lines": []}, {"lines": {}}, {"lines": [{"part": 1}, {"note": "x", "part": 2, "y": {}}]},
    {"lines": [3, {"part": True, "note": ""}]}, {"state": {"code": "x", "paid": {"total": "2", "rate": {"deep": 1}}}}, {"state": {"code": None, "paid": []}}])
def test_nested_contract(spark, change):
    row = GOOD | change
    df = spark.createDataFrame([(1, json.dumps(row))], "k int, j string").select("k", F.parse_json("j").alias("v"))
    got = {(r.path, r.breach) for r in S.nested_breaches(df, ["k"], "v", chains.ORDER_CONTRACT).collect()}
    assert got == breaches(row, chains.ORDER_CONTRACT)


def test_records_are_judged_in_place(spark, capsys):
    """Records are not shuffled, nor taken for one another if they share a key or have none."""
    rows = [(1, GOOD), (1, {"id": 1, "state": GOOD["state"]}), (None, GOOD | {"lines": [{"part": 1}, {"part": 2}]}), (2, None)]
    df = spark.createDataFrame([(k, r and json.dumps(r)) for k, r in rows], "k int, j string").select("k", F.parse_json("j").alias("v"))
    out = S.nested_breaches(df, ["k"], "v", chains.ORDER_CONTRACT)
    assert sorted((str(r.k), r.path, r.breach) for r in out.collect()) == [("1", "$.lines", "missing"), ("None", "$.lines[].note", "missing")]
    out.explain()
    plan = capsys.readouterr().out
    assert "Exchange" not in plan and "Join" not in plan
    loose = S.nested_breaches(df.where("k = 1").limit(1), ["k"], "v", {"id": "number|null", "state": "object", "lines": "array"})
    assert sorted((r.path, r.breach) for r in loose.collect()) == [("$.state.code", "extra"), ("$.state.paid", "extra")]


@pytest.mark.parametrize("value, shown, compared", [
    ({"name": "Ann Bee", "email": "A@x.org", "phone": "1"}, "Ann Bee — A@x.org — 1", "a@x.org"), ({"name": "Ann  Bee", "email": " "}, "Ann  Bee", "ann bee"),
    (["b", "A", {"category": "Cover", "limit": 2}], "b; A; Cover", "a | b | cover"), ({"value": 3.0, "unit": "months"}, "3 months", "3 months"), ({"value": 2.5}, "2.5", "2.5"),
    (True, "Yes", "yes"), (False, "No", "no"), (12, "12", "12"), ("Text\n here", "Text\n here", "text here"), (None, None, "<absent>"), ([], "", ""), ({"criterion": "Price"}, "Price", "price")])
def test_values_by_their_type(spark, value, shown, compared):
    df = spark.createDataFrame([(json.dumps(value),)], "j string").select(F.parse_json("j").alias("v"))
    assert tuple(df.select(serve.typed_text(F.col("v")), serve.typed_comparable(F.col("v"), F.lit(True))).first()) == (shown, compared)


def test_item_sets_of_tables(spark):
    value = [{"category": " Auto  Cover "}, {"coverage_type": "Auto cover"}, {"criterion": "Price"}, {"coverage": "Fire"}, "Price", "", {"other": 1}]
    sets = [(json.dumps(value),), ('"bare"',), ("null",)]
    df = spark.createDataFrame(sets, "j string").select(G.variant_set(F.parse_json("j")).alias("s"))
    assert [r.s for r in df.collect()] == [["auto cover", "price", "fire", '{"other":1}'], ["bare"], []]


def test_top_is_bounded_before_the_shuffle(spark):
    rows = spark.createDataFrame([(1, "f", p, float(p % 5)) for p in range(40)], "doc_id int, field_key string, page_no int, score double").repartition(3)
    got = R.top_ranked(rows, ["field_key"], 3)
    assert sorted((r.page_no, r.rank) for r in got.collect()) == [(4, 0), (9, 1), (14, 2)]
    assert "WindowGroupLimit" in got._jdf.queryExecution().executedPlan().toString()
