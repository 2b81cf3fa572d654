"""Steps of the stored index whose tasks must not grow with the tables."""

from pyspark.sql import functions as F

from strata.operators import search as S
from strata.operators import text_index as X


def test_index_counts_its_postings_where_the_rows_are(spark, tmp_path, monkeypatch):
    """Rows are counted in place and dealt out by id before they are grouped: no task groups a table's exploded words first."""
    seen = []
    monkeypatch.setattr(X, "dealt", lambda df, *keys: seen.append(keys) or df.repartition(3, *keys), raising=False)
    docs = spark.createDataFrame([("a", "x Y x", "z"), ("a", "x", None), ("b", None, "..."), (None, "q", "q")], "id string, one string, two string")
    weights = {"one": 0.5, "two": 1.0}
    plain = S.field_postings(docs, "id", weights)
    assert "Aggregate" not in plain._jdf.queryExecution().executedPlan().toString()
    key = lambda r: (r["id"] or "", r["token"])
    summed = plain.filter("token <> ''").groupBy("id", "token").agg(F.sum("w").alias("w"), F.sum("n").alias("n")).collect()
    assert sorted(summed, key=key) == sorted(S.postings(docs, "id", weights).collect(), key=key)
    index = X.TextIndex(spark, str(tmp_path / "i"))
    index.build(docs.filter("id is not null"), weights)
    assert seen == [("id",), ("token", "grp")]
    assert sorted(map(tuple, index.store.read("docs").select("id", "len").collect())) == [("a", 5), ("b", 0)]
