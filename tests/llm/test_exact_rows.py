"""The filtering form of exact deduplication on rows with null and repeated ids."""

import pytest

from strata.llm import common, exact_dedup
from strata.llm.exact_dedup import drop_exact_duplicates


def kept(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    return sorted(((r["doc_id"], r["text"] or "") for r in drop_exact_duplicates(docs).collect()), key=str)


def test_null_and_repeated_ids(spark):
    rows = [(None, "a", "x"), (None, "a", "y"), (None, "b", "x"), (3, "b", "x"), (1, "c", "x"), (0, "c", "x"), (1, "d", "x"), (7, None, "x"), (7, "", "x"), (9, "", "y")]
    assert kept(spark, rows) == sorted([(None, "a"), (3, "b"), (0, "c"), (1, "d"), (7, "")], key=str)


def test_one_row_and_empty(spark):
    assert kept(spark, [(5, "t", None)]) == [(5, "t")]
    assert kept(spark, []) == []


@pytest.mark.parametrize("few", [True, False])
def test_whole_texts_stay_out_of_the_shuffle_while_few_rows_go(spark, few, monkeypatch):
    if not few:
        monkeypatch.setattr(common.picked, "__defaults__", (1,))
        monkeypatch.setattr(exact_dedup, "PICKED", 4)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = [(i, f"text {i % 9}") for i in range(12)] + [(None, "text 1"), (5, None)]
        docs = spark.createDataFrame(rows, "doc_id long, text string")
        gone = docs.filter("doc_id in (3, 4) or doc_id is null").select("doc_id", common.row_key().alias("at"))
        for out, n in ((common.without(docs, gone), 11), (exact_dedup.drop_exact_duplicates(docs), 10)):
            plan = out._jdf.queryExecution().executedPlan().toString()
            assert out.count() == n and ("BroadcastHashJoin" in plan) == few and ("SortMergeJoin" in plan) != few
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
