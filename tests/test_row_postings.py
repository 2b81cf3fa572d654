"""Postings counted row by row: the sums of the shuffled ones, without their shuffle."""

from strata.operators import search as S
from strata.plans import catalogue


def test_row_postings_give_the_same_scores(spark):
    rows = [(1, "Tion the, the MENT"), (2, None), (3, ""), (4, "the nation's tion-al ment!"), (1, "the again tions"), (None, "ment the"), (5, "İstanbul thé \n the")]
    docs = spark.createDataFrame(rows, "id long, text string")
    a, b = S.postings(docs, "id", {"text": 1.0}), S.row_postings(docs, "id", "text")
    assert b.schema == a.schema or [f.dataType for f in b.schema] == [f.dataType for f in a.schema]
    assert "Exchange" not in b._jdf.queryExecution().executedPlan().toString()
    assert sorted(b.groupBy("id", "token").agg({"w": "sum", "n": "sum"}).collect(), key=str) == sorted(a.groupBy("id", "token").agg({"w": "sum", "n": "sum"}).collect(), key=str)
    scores = [sorted(S.bm25(x, len(rows), ["tion", "the", "ment"]).collect(), key=str) for x in (a, b)]
    assert scores[0] == scores[1] and scores[0]


def test_document_postings_are_not_shuffled(spark, monkeypatch):
    plans = []
    monkeypatch.setattr(catalogue, "once", lambda spark, name, d, build: plans.append(build()))
    catalogue.document_postings(spark, "/root/testdata/sf0.001")
    assert "Exchange" not in plans[0]._jdf.queryExecution().executedPlan().toString()
