"""Octets of dotted numbers, compared with int() of each part."""

from strata.llm import pii

PARTS = ["0", "00", "0000", "7", "007", "0007", "255", "0255", "00255", "256", "0256", "999", "1000", "1234", "1001", "5000", "01000", "001234", "2024", "10255", "4294967297", "1" + "0" * 30, "0" * 30 + "9"]


def test_octets(spark):
    rows = [f"{p}.1.2.3" if at == 0 else f"1.2.3.{p}" if at == 3 else f"1.{p}.2.3" for p in PARTS for at in (0, 1, 3)]
    docs = spark.createDataFrame([(i, f"see {x} here") for i, x in enumerate(rows)], "doc_id long, text string")
    got = {r["doc_id"]: r["n_ip"] for r in pii.personal_data(docs).collect()}
    assert got == {i: int(all(int(p) <= 255 for p in x.split("."))) for i, x in enumerate(rows)}
    clean = {r["doc_id"]: r["text"] for r in pii.redact(docs).collect()}
    assert all(("[IP]" in clean[i]) == bool(n) for i, n in got.items())
