import os

import pytest

from tests.llm.test_joins import linked

SMALL = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="needs the test tables")
def test_stages_follow_each_other(spark):
    import corpus_pipeline
    from glyphloom.llm.common import materialise

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns, kept = docs.columns, {r["doc_id"] for r in docs.select("doc_id").collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = materialise(stage(spark, docs, SMALL), "stage")
        ids = [r["doc_id"] for r in docs.select("doc_id").collect()]
        assert docs.columns == columns and set(ids) <= kept and len(ids) == len(set(ids)), name
        kept = set(ids)
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, SMALL)
    assert {r["doc_id"] for r in pieces.collect()} == kept


@pytest.fixture
def tables(spark, tmp_path):
    rows = [(i, int(i % 9 != 0), 0) for i in range(0, 60, 2)]
    spark.createDataFrame(rows, "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    return str(tmp_path)


def written(df):
    return sorted(map(repr, df.collect()))


def test_line_and_copy_stages_keep_columns_of_any_name(spark, docs, tables):
    """Nulls, empty and long texts, ties, repeated rows and clashing names."""
    import corpus_pipeline

    clashing = docs.withColumnsRenamed({"n_lines": "n_removed", "rank": "gone"}).selectExpr("*", "doc_id AS kept", "gone AS n_chars")
    lean = corpus_pipeline.drop_lines(spark, clashing, tables)
    assert lean.schema == clashing.schema
    was = {(r["doc_id"], r["text"]): r for r in clashing.collect()}
    rows = lean.collect()
    assert {r["doc_id"] for r in rows} <= {i for i, _ in was} and any(r["doc_id"] is None and r["text"] is None for r in rows)
    same = [r for r in rows if (r["doc_id"], r["text"]) in was]
    assert len(same) > 40 and all(r == was[r["doc_id"], r["text"]] for r in same)
    assert all(r["n_chars"] == len(r["text"]) for r in rows if r["text"] and (r["doc_id"], r["text"]) not in was)

    single = corpus_pipeline.one_of_each(spark, clashing, tables)
    assert single.schema == clashing.schema
    roots = {i: root for i, _, root in linked(clashing.collect())}
    assert written(single) == sorted(repr(r) for r in clashing.collect() if r["doc_id"] is None or roots[r["doc_id"]] == r["doc_id"])


def test_stages_on_an_empty_table(spark, none, tables):
    import corpus_pipeline

    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, tables).count() == 0, name
