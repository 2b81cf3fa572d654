"""What plans must not do however large their tables are, and the rows of the same queries on odd input."""

import re

from pyspark.sql import functions as F

from strata.operators import code as C
from strata.operators import incremental as I
from strata.operators.versions import VersionedStore

ENDPOINTS = "eid long, method string, path string, request_schema string, response_schema string"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_flows_are_not_gathered_after_they_are_listed(spark):
    calls = spark.createDataFrame([("/a", "GET", "/x", "f", 1), ("/a", "POST", "/x", None, 2), ("/b", "", "/x/", "g", 3), ("/c", "PUT", "/y", None, 4)], "page string, method string, path string, field string, ord long")
    endpoints = spark.createDataFrame([(1, "ANY", "/x", "M", None), (2, "PUT", "/y", None, None), (3, "ANY", "/x", None, None), (3, "GET", "/q", None, None)], ENDPOINTS)
    uses = spark.createDataFrame([(1, "M"), (1, "B")], "eid long, model string")
    flows = C.data_flows(calls, endpoints, uses)
    assert not re.search(r"Aggregate \[page#\d+, eid#\d+L?\]", plan(flows))
    assert sorted((r.page, r.eid, r.models) for r in flows.collect()) == [("/a", 1, ["B", "M"]), ("/a", 3, []), ("/b", 1, ["B", "M"]), ("/b", 3, []), ("/c", 2, [])]
    found = C.contracts(calls, endpoints.filter("eid <> 3"), spark.createDataFrame([("M", "f")], "name string, field string"))
    assert "min_by" not in plan(found)
    assert sorted((r.eid, r.callers) for r in found.collect()) == [(1, ["/a", "/b"]), (2, ["/c"])]


def test_contents_given_once_are_not_sorted(spark, tmp_path):
    plans = []

    def extract(work):
        plans.append(work._jdf.queryExecution().executedPlan().toString())
        return work.select("path", F.col("content").alias("v"))

    files = lambda rows: spark.createDataFrame(rows, "path string, content string").withColumn("hash", F.sha2("content", 256))
    store = VersionedStore(spark, f"file://{tmp_path}/store")
    I.extract_batch(store, files([("a", "1"), ("b", "2")]), extract, "c", 0)
    I.extract_batch(store, files([("a", "3"), ("a", "3"), ("b", None), ("d", "4"), ("d", "5")]), extract, "c", 1)
    assert "SortAggregate" not in plans[0]
    rows = sorted((r.path, r.v) for r in I.live_facts(store).collect())
    assert [p for p, _ in rows] == ["a", "d"] and rows[0][1] == "3"
