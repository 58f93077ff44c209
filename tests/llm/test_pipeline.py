"""The pipeline's stages, each on its predecessor's rows."""

import os

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")
DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables here")
def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    counts = [docs.count()]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, DATA)
        if k < 4:
            assert out.columns == docs.columns, name
        out.write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        counts.append(docs.count())
        assert docs.count() == docs.select("doc_id").distinct().count()
    assert counts == sorted(counts, reverse=True) and counts[-1] > counts[0] // 4
    assert docs.where("taken > 3 * size").count() == 0


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables here")
def test_stages_do_what_brute_force_does(spark):
    """Near copies, leaks and the mix, each on the rows that the stage before left."""
    from test_operators import WORD, brute_groups, brute_leaks, toks

    stages = dict(corpus_pipeline.STAGES)
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    _, group = brute_groups(rows, 5, 80)
    near = stages["near-duplicate documents"](spark, docs, DATA)
    assert {r.doc_id for r in near.collect()} == {i for i, g in group.items() if i == g}

    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    marks = {tuple(w[k : k + 5]) for _, t in items for w in [toks(t)] for k in range(len(w) - 4)}
    some = [(i, t) for i, t in rows if any(tuple(w[k : k + 5]) in marks for w in [toks(t)] for k in range(len(w) - 4))]
    bad = {i for i, _ in brute_leaks(some, items)}
    assert bad and {r.doc_id for r in stages["benchmark decontamination"](spark, docs, DATA).collect()} == {i for i, _ in rows} - bad

    mixed = stages["mixing to target weights"](spark, docs, DATA).collect()
    size = {i: len(WORD.findall(t or "")) for i, t in rows}
    taken, want = {}, {r.target for r in mixed}
    source = {r.doc_id: r.source for r in docs.collect()}
    for r in mixed:
        assert 0 < r.taken <= 3 * size[r.doc_id]
        taken[source[r.doc_id]] = taken.get(source[r.doc_id], 0) + r.taken
    assert sorted(taken.values()) == pytest.approx(sorted(next(r.target for r in mixed if source[r.doc_id] == s) for s in taken), abs=1)
