"""Kernels, sources, streams, and a sample of catalogue queries against DuckDB."""

import glob
import itertools
import os
import random

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from strata.functions import text as T
from strata.operators import graph as G
from strata.operators import reports as R
from strata.operators import store
from strata.plans import catalogue
from strata.sources import files, kernels
from strata.streaming import events

SF = "/root/testdata/sf0.001"


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize("name", ["f3_bm25_top10", "g2_degrees", "d2_duplicate_groups", "w1_growth", "j21_snapshot_diff", "c2_contracts", "b1_retrieval_metrics", "p6_module_of_file", "a18_feature_arcs", "j7_registry_merge", "c13_alerts", "c3_unmatched", "a21_majority", "p16_repo_paths", "j9_import_resolution", "c2_j15_contracts", "c5_j18_test_coverage", "a16_pattern_registry", "q5_j19_impact", "c9_c11_endpoint_changes", "r14_foreign_keys", "g22_unused_exports", "g7_g8_heatmap_bundle", "q10_evaluate_candidates", "f5_symbol_search", "f15_t5_categorical_search", "q2_p6_file_context", "r16_workflows"])
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from read_parquet('{f}')")
    got = catalogue.queries()[name](spark, SF)
    want = con.sql(catalogue.oracle_sql()[name])
    cols = sorted(got.columns)
    assert sorted(want.columns) == cols
    shown = lambda r: tuple(f"{v:.5f}" if isinstance(v, float) else str(v) for v in r)
    assert sorted(shown(r) for r in got.select(*cols).collect()) == sorted(shown(r) for r in con.sql(f"select {','.join(cols)} from ({catalogue.oracle_sql()[name]})").fetchall())


def test_entry_and_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_scalars(spark):
    x = spark.createDataFrame([("getHTTPResponse_code", -2.5, "/a//b/{id}/x?q=1")], "n string, v double, p string")
    r = x.select(T.split_identifiers(F.col("n")).alias("n"), T.half_up(F.col("v")).alias("v"), T.path_pattern(F.col("p")).alias("p"), T.path_suffixes(F.lit("a/b/c")).alias("s")).first()
    assert tuple(r)[:3] == ("get http response code", -2.0, "/a/b/:param/x") and r["s"] == ["a/b/c", "b/c", "c"]


def brute_scc(edges):
    nodes = {v for e in edges for v in e}
    reach = {v: {v} for v in nodes}
    for _ in nodes:
        for a, b in edges:
            for v in nodes:
                if a in reach[v]:
                    reach[v] |= {b}
    return sorted({tuple(sorted(w for w in reach[v] if v in reach[w])) for v in nodes})


def test_graph_kernels():
    random.seed(3)
    for _ in range(100):
        n = random.randint(1, 7)
        edges = [e for e in itertools.product(range(n), repeat=2) if random.random() < 0.25]
        assert sorted(map(tuple, G.strong_components(edges))) == brute_scc(edges)
    assert G.back_edge_cycles([("b", "a"), ("a", "b"), ("c", "d")]) == [["a", "b"]]
    assert G.back_edge_cycles([]) == [] and G.longest_path([]) == 0
    assert G.longest_path([(i, i + 1) for i in range(6)]) == 6
    assert G.modularity_gap(list(range(6)), [(0, 1), (1, 2), (2, 0), (3, 4), (4, 5), (5, 3)]) == pytest.approx(0.5)
    assert G.modularity_gap([], []) == 0


def test_pagerank_of_levels(spark):
    nodes = spark.createDataFrame([("a", i) for i in range(5)] + [("b", 7), ("b", 8)], "level string, id long")
    edges = spark.createDataFrame([("a", 0, 1), ("a", 1, 2), ("a", 2, 0), ("a", 3, 0), ("a", 0, 1), ("b", 7, 8), ("b", 7, 7)], "level string, src long, dst long")
    got = {(r["level"], r["id"]): r["rank"] for r in G.pagerank_levels(nodes, edges, rounds=3).collect()}
    for level, ids in (("a", range(5)), ("b", (7, 8))):
        want = G.ranks(list(ids), [(s, t) for k, s, t in ((r["level"], r["src"], r["dst"]) for r in edges.collect()) if k == level], 3, 0.85)
        for v in ids:
            assert got[level, v] == pytest.approx(want[v] / max(want.values()))
    cycles = {(r["level"], r["id"]): r["part"] for r in G.level_cycles(edges.withColumn("src", F.col("src").cast("string")).withColumn("dst", F.col("dst").cast("string"))).collect()}
    assert cycles == {("a", "0"): "2", ("a", "1"): "2", ("a", "2"): "2", ("b", "7"): "7"}


def test_store_and_reports(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    new = spark.createDataFrame([(2, "c"), (3, "d")], "id int, v string")
    assert rows(store.upsert(old, new, ["id"])) == [(1, "a"), (2, "c"), (3, "d")]
    assert {r["id"]: r["status"] for r in R.keyed_diff(old, new, "id", "v").collect()} == {1: "removed", 2: "changed", 3: "added"}
    s = spark.createDataFrame([(i, sorted(random.Random(i).sample(range(8), 4))) for i in range(40)], "k int, a array<int>")
    sets = {r["k"]: set(r["a"]) for r in s.collect()}
    want = {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.6}
    assert {(r["a"], r["b"]) for r in store.similar_sets(s, 0.6).collect()} == want


def test_sources_and_kernels(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "src/a.py").write_text("async def f(x):\n    return g.h(x, 'lit')\n")
    (tmp_path / "src/b.ts").write_text("export function foo(a) {\n  return bar(a)\n}\n")
    (tmp_path / "node_modules/c.ts").write_text("function no() {}\n")
    found = kernels.functions(files.scan_code(spark, str(tmp_path))).collect()
    assert sorted((r["name"], r["file"], r["calls"], r["is_async"]) for r in found) == [("f", "src/a.py", ["g.h"], True), ("foo", "src/b.ts", ["bar"], False)]
    (tmp_path / "t.jsonl").write_text('{"a": 1}\nbad\n')
    assert rows(files.json_lines(spark, str(tmp_path / "t.jsonl"), "a int")) == [(1,)]
    (tmp_path / "f").mkdir()
    (tmp_path / "f/x.yaml").write_text("feature: login\npattern: p1\nsprint: 3\n")
    (tmp_path / "f/y.yaml").write_text("{bad")
    assert [(r["feature"], r["pattern"], r["sprint"]) for r in files.feature_specs(spark, str(tmp_path / "f")).collect()] == [("login", ["p1"], "3")]


def test_streams(spark, tmp_path):
    e = spark.createDataFrame([(1, "a", "2024-01-01 00:00:00"), (1, "a", "2024-01-01 00:00:02"), (2, "b", "2024-01-01 01:00:00")], "id int, k string, t string").withColumn("ts", F.to_timestamp("t")).drop("t")
    e.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(e.schema).parquet(str(tmp_path / "in"))
    q = events.append_log(stream, str(tmp_path / "out"), str(tmp_path / "c1"))
    q.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3
    q = events.debounced(stream, "k").writeStream.format("memory").queryName("deb").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    assert ("a", 2) in {(r["k"], r["n"]) for r in spark.table("deb").collect()}


def test_level_kernels_keep_no_cycles():
    """A ring with chords has as many cycles as chords, each as long as the ring; their nodes must not be held."""
    import tracemalloc

    n = 4000
    edges = [(f"n{i:05}", f"n{(i + 1) % n:05}") for i in range(n)] + [(f"n{i:05}", "n00000") for i in range(n // 2, n - 1)]
    names, src, dst = G.sorted_numbers(edges)
    tracemalloc.start()
    found = G.back_edges(len(names), src, dst)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found == n // 2 and peak < 2_000_000


def test_level_kernels_count_as_the_lists(spark):
    r = random.Random(3)
    rows_ = list({(level, f"s{r.randrange(n)}", f"s{r.randrange(n)}") for level, n in (("a", 9), ("b", 12)) for _ in range(40)})
    got = {x["level"]: x for x in G.per_level(spark.createDataFrame(rows_, "level string, src string, dst string").selectExpr("level", "concat_ws('|', src, dst) as ord", "src", "dst")).collect()}
    for level in ("a", "b"):
        e = sorted(((a, b) for k, a, b in rows_ if k == level), key=lambda p: f"{p[0]}|{p[1]}")
        loops = {a for a, b in e if a == b}
        x = got[level]
        assert x["n_cycles"] == len(G.back_edge_cycles(e)) and x["longest"] == G.longest_path(e)
        assert x["n_scc"] == sum(len(p) > 1 or p[0] in loops for p in brute_scc(e))
        assert x["modularity_gap"] == G.modularity_gap(list(dict.fromkeys(v for p in e for v in p)), e)


def test_token_counts_equal_tokens(spark):
    texts = ["", " ", "a", "ab cd_e ÄÖ x.y/{z}-1", "İstanbul KK", "\x0b\x0c\r\n tab\tend ", "aaa bbb  cc dd", "--", None, "x" * 50 + " é " + "yz" * 3]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    for k in T.TOKENISERS:
        bad = df.filter(~T.token_count(F.col("text"), k).eqNullSafe(F.when(F.col("text").isNotNull(), F.size(T.tokens(F.col("text"), k)))))
        assert bad.collect() == [], k


def test_tokenisers_deal_out_one_split(spark, tmp_path):
    spark.range(2000).selectExpr("id as doc_id", "'some words here' as text").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    assert "hashpartitioning(doc_id" in catalogue.queries()["fn2_tokenisers"](spark, str(tmp_path))._jdf.queryExecution().toString()
