"""Distinct rows are found after they are dealt out, not in whole tables first."""

from strata.operators import symbols as Y
from strata.sources import staging


def steps(df):
    df.collect()
    lines = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1].splitlines()
    return [s for line in lines for s in ("Aggregate", "Exchange", "Scan") if s in line]


def test_class_names_are_grouped_after_their_exchange(spark):
    rows = [(f"f{i % 7}", n) for i in range(40) for n in ("a", "C.m", "C.n")] + [(None, "x"), ("f1", None)]
    names = Y.class_names(spark.createDataFrame(rows, "file string, name string"))
    assert steps(names)[:3] == ["Aggregate", "Aggregate", "Exchange"]
    assert sorted((r[0] or "", r[1] or "") for r in names.collect()) == sorted({(f or "", m or "") for f, n in rows if n for m in (n, n.split(".")[0])} | {("f1", "")})


def test_width_follows_the_rows(spark):
    df = spark.range(1_000)
    assert staging.dealt(df, "id", rows=100).rdd.getNumPartitions() == 11
    assert staging.dealt(df, "id").rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
