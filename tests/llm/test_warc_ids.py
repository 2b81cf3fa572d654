"""The archive round trip of pages with null and repeated ids, null urls and ties."""

from strata.llm import warc


def test_null_and_repeated_ids(spark):
    pages = [(1, "u", "a"), (None, None, "a"), (None, "v", "b"), (None, "w", "b"), (9007199254740993, "x", "a"), (4, None, None), (4, "y", None)]
    got = warc.warc_round_trip(spark.createDataFrame(pages, "page_id long, url string, html string").repartition(3)).collect()
    top = 9007199254740993
    rows = sorted(((r["page_id"], r["payload_bytes"], r["record_type"], r["refers_to"]) for r in got), key=str)
    assert rows == sorted([(1, 1, "revisit", top), (None, 1, "revisit", top), (None, 1, "response", None), (None, 1, "response", None), (top, 1, "response", None), (4, 0, "response", None), (4, 0, "response", None)], key=str)
