"""All queries of the engine's own operators, each beside the SQL that it must equal."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strata.functions import text as T
from strata.operators import graph as G
from strata.operators import reports as R
from strata.operators import search as S
from strata.operators import store
from strata.operators import vectors as V
from strata.operators.substrings import containing
from strata.sources.staging import once, staged

Query = Callable[[SparkSession, str], DataFrame]
FOUND: dict[str, tuple[Query, str | None]] = {}


def query(sql: str | None):
    def add(f: Query) -> Query:
        FOUND[f.__name__] = (f, sql)
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def r6(x):
    return T.half_up(x, 6)


# The trade graph: supplier nations to their three largest customer nations; regions are layers.
REV = "SELECT s_nationkey AS src, c_nationkey AS dst, sum(CAST(floor(l_extendedprice * (1 - l_discount) * 100 + 0.5) AS BIGINT)) AS rev FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2"
EDGES = f"rev AS ({REV}), e AS (SELECT src, dst FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY rev DESC, dst) AS k FROM rev) WHERE k <= 3), nodes AS (SELECT n_nationkey AS id, n_regionkey AS layer FROM nation)"
DEG = EDGES + ", deg AS (SELECT id, (SELECT count(*) FROM e WHERE dst = id) AS n_in, (SELECT count(*) FROM e WHERE src = id) AS n_out FROM nodes)"


def revenue(spark: SparkSession, d: str) -> DataFrame:
    cents = F.floor(F.col("l_extendedprice") * (1 - F.col("l_discount")) * 100 + 0.5).cast("long")
    x = table(spark, d, "lineitem").select("l_orderkey", "l_suppkey", cents.alias("c"))
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey").join(table(spark, d, "customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    s = table(spark, d, "supplier").select("s_suppkey", "s_nationkey")
    x = x.groupBy("l_orderkey", "l_suppkey").agg(F.sum("c").alias("c"))
    return x.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(s, F.col("l_suppkey") == F.col("s_suppkey")).groupBy(F.col("s_nationkey").alias("src"), F.col("c_nationkey").alias("dst")).agg(F.sum("c").alias("rev"))


def trade(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    w = Window.partitionBy("src").orderBy(F.desc("rev"), "dst")
    e = once(spark, "trade", d, lambda: revenue(spark, d).withColumn("k", F.row_number().over(w)).filter("k <= 3").select("src", "dst"))
    return table(spark, d, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_regionkey").alias("layer")), e


QUERY = ["tion", "the", "ment"]
TOK = "tok AS (SELECT doc_id AS id, unnest(regexp_split_to_array(lower(text), '[^a-z0-9]+')) AS token FROM documents), p AS (SELECT id, token, count(*) AS n FROM tok WHERE token <> '' GROUP BY 1, 2)"
BM = TOK + """, cfg AS (SELECT (SELECT count(*) FROM documents)::DOUBLE AS nd), len AS (SELECT id, sum(n) AS len FROM p GROUP BY 1), av AS (SELECT sum(n) / any_value(nd) AS avgdl FROM p, cfg),
q AS (SELECT unnest(['tion', 'the', 'ment']) AS q), f AS (SELECT id, q, sum(n)::DOUBLE AS f FROM p, q WHERE starts_with(token, q) GROUP BY 1, 2),
idf AS (SELECT q, CASE WHEN ln((any_value(nd) - count(*) + 0.5) / (count(*) + 0.5)) > 0 THEN ln((any_value(nd) - count(*) + 0.5) / (count(*) + 0.5)) ELSE 1e-6 END AS idf FROM f, cfg GROUP BY q),
b AS (SELECT id, -sum(idf * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * len / avgdl))) AS score, count(*) AS matched FROM f JOIN idf USING (q) JOIN len USING (id), av GROUP BY id)"""


def document_postings(spark: SparkSession, d: str) -> DataFrame:
    return once(spark, "document_postings", d, lambda: S.row_postings(table(spark, d, "documents"), "doc_id", "text"))


def bm25(spark: SparkSession, d: str) -> DataFrame:
    return S.bm25(document_postings(spark, d), table(spark, d, "documents").count(), QUERY)


@query(f"WITH {BM} SELECT id AS doc_id, floor(score * 1e6 + 0.5) / 1e6 AS score, matched FROM b ORDER BY score, id LIMIT 10")
def f3_bm25_top10(spark, d):
    return bm25(spark, d).orderBy("score", "id").limit(10).select(F.col("id").alias("doc_id"), r6(F.col("score")).alias("score"), "matched")


@query(f"WITH {BM}, g AS (SELECT source, count(*) AS n_in FROM documents GROUP BY 1), x AS (SELECT id, d.source, score * (0.7 + 0.3 * n_in / (n_in + 40)) * CASE WHEN lang = 'es' THEN 0.5 ELSE 1 END AS s FROM b JOIN documents d ON d.doc_id = id JOIN g ON g.source = d.source) SELECT id AS doc_id, source, floor(s * 1e6 + 0.5) / 1e6 AS combined FROM x ORDER BY s, id LIMIT 20")
def f4_authority_rerank(spark, d):
    docs = table(spark, d, "documents")
    g = docs.groupBy("source").agg(F.count(F.lit(1)).alias("n_in"))
    x = bm25(spark, d).join(docs.select(F.col("doc_id").alias("id"), "source", "lang"), "id").join(g, "source")
    s = F.col("score") * S.authority_quality(F.col("n_in"), F.lit(40), F.col("lang") == "es")
    return x.withColumn("s", s).orderBy("s", "id").limit(20).select(F.col("id").alias("doc_id"), "source", r6(F.col("s")).alias("combined"))


@query(f"WITH {BM}, pool AS (SELECT id, -score AS v, d.source FROM b JOIN documents d ON d.doc_id = id ORDER BY score, id LIMIT 60), deg AS (SELECT source, count(*)::DOUBLE AS c FROM pool GROUP BY 1), x AS (SELECT id, 0.7 * (v - min(v) OVER ()) / CASE WHEN max(v) OVER () > min(v) OVER () THEN max(v) OVER () - min(v) OVER () ELSE 1 END + 0.3 * c / max(c) OVER () AS s FROM pool JOIN deg USING (source)) SELECT id AS doc_id, floor(s * 1e6 + 0.5) / 1e6 AS score FROM x ORDER BY floor(s * 1e6 + 0.5) / 1e6 DESC, id LIMIT 10")
def f5_hybrid_symbols(spark, d):
    pool = bm25(spark, d).orderBy("score", "id").limit(60).join(table(spark, d, "documents").select(F.col("doc_id").alias("id"), "source"), "id").withColumn("v", -F.col("score"))
    w = Window.partitionBy(F.lit(1))  # the pool has at most 60 rows
    x = pool.withColumn("c", F.count(F.lit(1)).over(Window.partitionBy("source"))).withColumn("s", S.blended(S.min_max(F.col("v"), w), F.col("c") / F.max("c").over(w)))
    return x.select(F.col("id").alias("doc_id"), r6(F.col("s")).alias("score")).orderBy(F.desc("score"), "doc_id").limit(10)


@query(f"WITH {BM} SELECT floor(100 * (0.35 * (SELECT count(*) FROM idf) / 3 + 0.45 * least(1, greatest(0, -coalesce((SELECT min(score) FROM b WHERE matched = 3), 0) / 8)) + 0.2 * (SELECT max(c)::DOUBLE / sum(c) FROM (SELECT lang, count(*) AS c FROM b JOIN documents ON doc_id = id GROUP BY 1))) + 0.5) / 100 AS signal")
def f6_query_signal(spark, d):
    b = bm25(spark, d)
    langs = b.join(table(spark, d, "documents").select(F.col("doc_id").alias("id"), "lang"), "id").groupBy("lang").agg(F.count(F.lit(1)).alias("c"), F.min(F.when(F.col("matched") == 3, F.col("score"))).alias("best"))
    cover = document_postings(spark, d).agg(sum((F.max(F.col("token").startswith(t).cast("int")) for t in QUERY), F.lit(0)).alias("n"))
    one = langs.agg((F.max("c") / F.sum("c")).alias("cl"), F.coalesce(F.min("best"), F.lit(0.0)).alias("joint")).crossJoin(F.broadcast(cover))
    return one.select(T.half_up(S.signal(F.col("n") / 3, F.col("joint"), F.col("cl")), 2).alias("signal"))


@query("WITH q AS (SELECT list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings WHERE vec_id = 0) SELECT e.vec_id, floor(list_dot_product(list_transform(e.embedding, lambda x: x::DOUBLE), q.v) / sqrt(list_dot_product(q.v, q.v)) * 1e6 + 0.5) / 1e6 AS score FROM embeddings e, q ORDER BY list_dot_product(list_transform(e.embedding, lambda x: x::DOUBLE), q.v) DESC, vec_id LIMIT 20")
def f7_vector_topk(spark, d):
    e = table(spark, d, "embeddings")
    q = e.filter("vec_id = 0").select(F.col("embedding").alias("q"))  # the query vector, one row
    return e.crossJoin(F.broadcast(q)).withColumn("s", T.cosine(F.col("embedding"), F.col("q"))).orderBy(F.desc("s"), "vec_id").limit(20).select("vec_id", r6(F.col("s")).alias("score"))


@query("WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings), s AS (SELECT q.vec_id AS query_id, e.vec_id, list_dot_product(e.v, q.v) / sqrt(list_dot_product(q.v, q.v)) AS score FROM v q JOIN v e ON q.vec_id % 50 = 0) SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, floor(score * 1e6 + 0.5) / 1e6 AS score FROM s QUALIFY rank <= 20")
def f7_many_vectors_topk(spark, d):
    """Every vector whose id is divisible by 50 as a query against all rows."""
    e = table(spark, d, "embeddings")
    return V.exact_topk(e, e.filter("vec_id % 50 = 0"), 20).withColumn("score", V.rounded(F.col("score")))


@query(None)
def f7_inverted_lists_recall(spark, d):
    """The same queries through the inverted lists: each one's share of its exact first 20."""
    e = table(spark, d, "embeddings")
    lists = V.InvertedLists(e)
    q = e.filter("vec_id % 50 = 0")
    return V.recall(lists.topk(q, 20, max(1, math.ceil(0.7 * len(lists.centroids)))), V.exact_topk(e, q, 20))


@query("SELECT p_partkey, floor(least(1, ((CASE WHEN lower(p_name) = 'small' THEN 1 WHEN lower(p_name) LIKE '%small%' THEN 0.7 WHEN lower(p_type) LIKE '%small%' THEN 0.4 WHEN lower(p_brand) LIKE '%small%' THEN 0.2 ELSE 0 END) + (CASE WHEN lower(p_name) = 'brass' THEN 1 WHEN lower(p_name) LIKE '%brass%' THEN 0.7 WHEN lower(p_type) LIKE '%brass%' THEN 0.4 WHEN lower(p_brand) LIKE '%brass%' THEN 0.2 ELSE 0 END) + CASE WHEN lower(p_name) LIKE '%small brass%' THEN 0.15 ELSE 0 END) / 2) * 1e6 + 0.5) / 1e6 AS score FROM part")
def f12_item_score(spark, d):
    return table(spark, d, "part").select("p_partkey", r6(S.item_score(F.array("p_type"), F.col("p_name"), F.col("p_brand"), ["small", "brass"])).alias("score"))


@query("WITH x AS (SELECT p_partkey, lower(p_type) AS t, lower(p_brand) AS b FROM part), y AS (SELECT p_partkey, CASE WHEN t = 'small brass' THEN 1 WHEN t LIKE '%small brass%' THEN 0.8 WHEN t LIKE '%small%' AND t LIKE '%brass%' THEN 0.6 WHEN t LIKE '%small%' OR t LIKE '%brass%' THEN 0.3 ELSE 0 END AS a, 0.5 * CASE WHEN b LIKE '%small%' OR b LIKE '%brass%' THEN 0.3 ELSE 0 END AS c FROM x) SELECT p_partkey, floor(greatest(a, c) * 1e6 + 0.5) / 1e6 AS score FROM y")
def f14_field_score(spark, d):
    return table(spark, d, "part").select("p_partkey", r6(S.field_score([(F.col("p_type"), 1.0), (F.col("p_brand"), 0.5)], "small brass")).alias("score"))


@query(f"WITH {TOK} SELECT token, count(*) AS n_docs, sum(n)::BIGINT AS n FROM p GROUP BY token")
def a10_inverted_index(spark, d):
    return S.postings(table(spark, d, "documents"), "doc_id", {"text": 1.0}).groupBy("token").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n").alias("n"))


@query("SELECT l_partkey AS part, string_agg(s::VARCHAR, ',' ORDER BY s) AS suppliers FROM (SELECT DISTINCT l_partkey, l_suppkey AS s FROM lineitem) GROUP BY 1")
def a11_inverse_adjacency(spark, d):
    return table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("part")).agg(F.array_join(F.transform(F.array_sort(F.collect_set("l_suppkey")), lambda x: x.cast("string")), ",").alias("suppliers"))


@query("SELECT conv_id, string_agg(role || ':' || text, chr(10) ORDER BY turn, role, text) AS body, count(*) AS n FROM conversations GROUP BY conv_id")
def a4_rollup(spark, d):
    turns = F.array_sort(F.collect_list(F.struct("turn", "role", "text")))
    return table(spark, d, "conversations").groupBy("conv_id").agg(F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit(":"), t["text"])), "\n").alias("body"), F.count(F.lit(1)).alias("n"))


@query(f"WITH {DEG} SELECT id, n_in, n_out FROM deg")
def g2_degrees(spark, d):
    return G.degrees(*trade(spark, d))


@query(f"WITH {DEG} SELECT id, CASE WHEN n_in = 0 AND n_out = 0 THEN 'isolated' WHEN n_out = 0 THEN 'core' WHEN n_in = 0 THEN 'top' ELSE 'middle' END AS role FROM deg")
def g20_layers(spark, d):
    return G.degrees(*trade(spark, d)).select("id", G.layer_of(F.col("n_in"), F.col("n_out")).alias("role"))


@query(f"WITH {EDGES} SELECT id FROM nodes WHERE id NOT IN (SELECT dst FROM e)")
def g21_orphans(spark, d):
    nodes, e = trade(spark, d)
    return nodes.join(e.select(F.col("dst").alias("id")), "id", "left_anti").select("id")


@query(f"WITH {DEG}, c AS (SELECT n_in + n_out AS d, count(*)::DOUBLE AS c FROM deg GROUP BY 1), t AS (SELECT sum(c) AS n FROM c) SELECT floor(-sum(c / n * ln(c / n)) * 1e6 + 0.5) / 1e6 AS entropy FROM c, t")
def g13_degree_entropy(spark, d):
    return G.degree_entropy(G.degrees(*trade(spark, d))).select(r6(F.col("entropy")).alias("entropy"))


@query(f"WITH {EDGES} SELECT floor(avg(CASE WHEN a.layer = b.layer OR a.layer + 1 = b.layer THEN 0.0 ELSE 1.0 END) * 1e6 + 0.5) / 1e6 AS ratio FROM e JOIN nodes a ON a.id = src JOIN nodes b ON b.id = dst")
def g14_cross_layer_ratio(spark, d):
    nodes, e = trade(spark, d)
    r = table(spark, d, "region").select(F.col("r_regionkey").alias("a"))
    allowed = r.select("a", F.col("a").alias("b")).unionAll(r.select("a", (F.col("a") + 1).alias("b")))
    return G.cross_layer_ratio(e, nodes, allowed).select(r6(F.col("ratio")).alias("ratio"))


@query(f"WITH {EDGES}, b AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e), h1 AS (SELECT DISTINCT dst AS id FROM b WHERE src = 0), h2 AS (SELECT DISTINCT b.dst AS id FROM b JOIN h1 ON b.src = h1.id) SELECT id, min(hop) AS hop FROM (SELECT 0 AS id, 0 AS hop UNION ALL SELECT id, 1 FROM h1 UNION ALL SELECT id, 2 FROM h2) GROUP BY id")
def g9_two_hop(spark, d):
    nodes, e = trade(spark, d)
    return G.k_hop(e, nodes.filter("id = 0"), 2)


@query(f"WITH RECURSIVE {EDGES}, r(id) AS (SELECT 0 UNION SELECT e.dst FROM e JOIN r ON e.src = r.id) SELECT id FROM r")
def g12_reachable(spark, d):
    nodes, e = trade(spark, d)
    return G.reachable(e, nodes.filter("id = 0"))


PR = EDGES + ", k AS (SELECT count(*)::DOUBLE AS n FROM nodes), o AS (SELECT src, count(*)::DOUBLE AS out FROM e GROUP BY 1), r0 AS (SELECT id, 1 / n AS rank FROM nodes, k)" + "".join(f", r{i} AS MATERIALIZED (SELECT nodes.id, 0.15 / n + 0.85 * (coalesce((SELECT sum(q.rank / o.out) FROM e JOIN r{i - 1} q ON q.id = e.src JOIN o ON o.src = e.src WHERE e.dst = nodes.id), 0) + (SELECT coalesce(sum(rank), 0) FROM r{i - 1} WHERE id NOT IN (SELECT src FROM e)) / n) AS rank FROM nodes, k)" for i in range(1, 31))


@query(f"WITH {PR} SELECT id, floor(rank / (SELECT max(rank) FROM r30) * 1e6 + 0.5) / 1e6 AS rank FROM r30")
def g6_pagerank(spark, d):
    nodes, e = trade(spark, d)
    return G.pagerank(nodes.select("id"), e).select("id", r6(F.col("rank")).alias("rank"))


@query(None)
def g3_g4_g10_g15_kernels(spark, d):
    _, e = trade(spark, d)
    return G.per_level(e.select(F.lit("nation").alias("level"), (F.col("src") * 100 + F.col("dst")).alias("ord"), "src", "dst"))


@query(f"WITH {EDGES} SELECT sha1(string_agg(src || '->' || dst, '|' ORDER BY src || '->' || dst)) AS fingerprint, (SELECT sha1(string_agg(k::VARCHAR, '|' ORDER BY k)) FROM (SELECT n_in * 1000 + n_out AS k FROM (SELECT id, (SELECT count(*) FROM e WHERE dst = id) AS n_in, (SELECT count(*) FROM e WHERE src = id) AS n_out FROM nodes))) AS shape FROM e")
def g19_fingerprints(spark, d):
    nodes, e = trade(spark, d)
    names = e.agg(F.sha1(F.array_join(F.array_sort(F.collect_list(F.concat_ws("->", F.col("src").cast("string"), F.col("dst").cast("string")))), "|")).alias("fingerprint"))
    shape = G.degrees(nodes, e).agg(F.sha1(F.array_join(F.transform(F.array_sort(F.collect_list(F.col("n_in") * 1000 + F.col("n_out"))), lambda x: x.cast("string")), "|")).alias("shape"))
    return names.crossJoin(F.broadcast(shape))


@query("WITH p AS (SELECT date_trunc('day', ts)::TIMESTAMP AS day, count(*) AS edges FROM events GROUP BY 1), x AS (SELECT day, edges, edges - lag(edges) OVER (ORDER BY day) AS delta FROM p) SELECT strftime(day, '%Y-%m-%d') AS day, edges, coalesce(delta, 0) AS delta, CASE WHEN delta IS NULL THEN 'insufficient_data' WHEN delta > 0 THEN 'increasing' WHEN delta < 0 THEN 'decreasing' ELSE 'stable' END AS trend FROM x")
def w1_growth(spark, d):
    p = table(spark, d, "events").groupBy(F.date_trunc("day", "ts").alias("day")).agg(F.count(F.lit(1)).alias("edges")).withColumn("level", F.lit("all"))
    return R.growth(p, "level", "day", "edges").select(F.date_format("day", "yyyy-MM-dd").alias("day"), "edges", F.coalesce("delta", F.lit(0)).alias("delta"), "trend")


@query("WITH u AS (SELECT s_nationkey AS n, sum(CAST(floor(l_extendedprice * 100 + 0.5) AS BIGINT)) AS used FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1), m AS (SELECT avg(used) AS b FROM u) SELECT n AS nation, used::BIGINT AS used, CASE WHEN used / b >= 1 THEN 'critical' WHEN used / b >= 0.85 THEN 'warning' ELSE 'ok' END AS status FROM u, m")
def c12_capacity(spark, d):
    s = table(spark, d, "supplier").select("s_suppkey", "s_nationkey")
    by = table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.sum(F.floor(F.col("l_extendedprice") * 100 + 0.5).cast("long")).alias("c"))
    u = by.join(s, F.col("l_suppkey") == F.col("s_suppkey")).groupBy(F.col("s_nationkey").alias("nation")).agg(F.sum("c").alias("used"))
    return u.crossJoin(F.broadcast(u.agg(F.avg("used").alias("b")))).select("nation", "used", R.capacity_status(F.col("used"), F.col("b")).alias("status"))


CUT = "1995-06-01"


@query(f"WITH a AS (SELECT o_custkey AS k, count(*) AS v FROM orders WHERE o_orderdate < TIMESTAMP '{CUT}' GROUP BY 1), b AS (SELECT o_custkey AS k, count(*) AS v FROM orders WHERE o_orderdate >= TIMESTAMP '{CUT}' GROUP BY 1) SELECT coalesce(a.k, b.k) AS o_custkey, coalesce(a.v, 0) AS old, coalesce(b.v, 0) AS new, CASE WHEN a.k IS NULL THEN 'added' WHEN b.k IS NULL THEN 'removed' WHEN a.v = b.v THEN 'same' ELSE 'changed' END AS status FROM a FULL OUTER JOIN b ON a.k = b.k")
def j21_snapshot_diff(spark, d):
    o = table(spark, d, "orders")
    at = F.lit(CUT).cast("timestamp_ntz")
    side = lambda c: o.filter(c).groupBy("o_custkey").agg(F.count(F.lit(1)).alias("v"))
    return R.keyed_diff(side(F.col("o_orderdate") < at), side(F.col("o_orderdate") >= at), "o_custkey", "v").fillna(0, ["old", "new"])


@query("WITH s AS (SELECT l_partkey AS k, list_sort(list(DISTINCT l_returnflag)) AS a FROM lineitem GROUP BY 1) SELECT p_partkey, CASE WHEN a IS NULL THEN 'unverified' WHEN len(list_filter(['A', 'N'], lambda x: NOT list_contains(a, x))) > 0 THEN 'mismatched' ELSE 'ok' END AS status FROM part LEFT JOIN s ON k = p_partkey")
def c2_contracts(spark, d):
    s = table(spark, d, "lineitem").groupBy("l_partkey").agg(F.collect_set("l_returnflag").alias("a"))
    x = table(spark, d, "part").select("p_partkey").join(s, F.col("p_partkey") == F.col("l_partkey"), "left")
    return x.select("p_partkey", R.contract_status(F.coalesce("a", F.array().cast("array<string>")), F.array(F.lit("A"), F.lit("N"))).alias("status"))


@query("SELECT d.lang, count(*) AS n, count(l.doc_id) AS covered, floor(avg(CASE WHEN l.doc_id IS NULL THEN 0.0 ELSE 1.0 END) * 1e6 + 0.5) / 1e6 AS rate FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY 1")
def c6_coverage(spark, d):
    x = table(spark, d, "documents").select("doc_id", "lang").join(table(spark, d, "labels").select("doc_id", F.lit(1).alias("hit")), "doc_id", "left")
    return x.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.count("hit").alias("covered"), r6(F.avg(F.coalesce("hit", F.lit(0)))).alias("rate"))


@query("SELECT DISTINCT coalesce(nullif(regexp_replace(regexp_replace(regexp_replace(regexp_replace(url, '^[a-z]+://[^/]+', ''), '[?].*$', ''), '/+', '/', 'g'), '/$', ''), ''), '/') AS pattern FROM pages")
def c1_path_patterns(spark, d):
    return table(spark, d, "pages").select(T.path_pattern(T.url_path(F.col("url"))).alias("pattern")).distinct()


@query("SELECT user_id, list_contains(list(DISTINCT event_type), 'purchase') AND list_contains(list(DISTINCT event_type), 'view') AS p1, count(DISTINCT event_type) >= 4 AS p2 FROM events GROUP BY user_id")
def a16_patterns(spark, d):
    x = table(spark, d, "events").groupBy("user_id").agg(F.collect_set("event_type").alias("t"))
    return x.select("user_id", (F.array_contains("t", "purchase") & F.array_contains("t", "view")).alias("p1"), (F.size("t") >= 4).alias("p2"))


@query("SELECT event_type AS tool, count(*) AS calls, sum(CAST(ceil(length(props) / 3.5) AS BIGINT))::BIGINT AS tokens, count(DISTINCT user_id) AS users FROM events GROUP BY 1")
def a14_session_metrics(spark, d):
    return table(spark, d, "events").groupBy(F.col("event_type").alias("tool")).agg(F.count(F.lit(1)).alias("calls"), F.sum(T.token_estimate(F.col("props")).cast("long")).alias("tokens"), F.countDistinct("user_id").alias("users"))


GAPS = "SELECT user_id, ts, CASE WHEN lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) IS NULL OR ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) > INTERVAL 6 HOUR THEN 1 ELSE 0 END AS g FROM events"


@query(f"WITH g AS ({GAPS}) SELECT user_id, sum(g)::BIGINT AS sessions, count(*) AS events FROM g GROUP BY 1")
def st3_debounced_sessions(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    gap = F.col("ts") - F.lag("ts").over(w)
    x = table(spark, d, "events").withColumn("g", F.when(gap.isNull() | (gap > F.expr("INTERVAL '6' HOUR")), 1).otherwise(0))
    return x.groupBy("user_id").agg(F.sum("g").alias("sessions"), F.count(F.lit(1)).alias("events"))


@query("WITH t AS (SELECT doc_id, text FROM documents), r AS (SELECT b.item_id AS query, t.doc_id AS item FROM benchmark b JOIN t ON contains(t.text, b.text)), k AS (SELECT query, item, row_number() OVER (PARTITION BY query ORDER BY item) AS rank FROM r), h AS (SELECT query, count(*) AS relevant, least(count(*), 5) AS hits FROM k GROUP BY 1) SELECT query, hits::BIGINT AS hits, 1.0::DOUBLE AS precision, floor(hits / relevant * 1e6 + 0.5) / 1e6 AS recall, floor(2 * hits / relevant / (1 + hits / relevant) * 1e6 + 0.5) / 1e6 AS f1 FROM h")
def b1_retrieval_metrics(spark, d):
    # words two to four of a passage lie between spaces in every text that holds it; shorter passages
    # meet texts by their q-grams
    b = table(spark, d, "benchmark").select(F.col("item_id").alias("query"), F.col("text").alias("passage")).withColumn("w", F.split("passage", " "))
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("item"), "text")
    three = lambda i: F.concat_ws(" ", F.get("w", i), F.get("w", i + 1), F.get("w", i + 2))
    grams = F.transform(F.sequence(F.lit(0), F.greatest(F.size("w") - 3, F.lit(0))), three)
    keyed = docs.select("item", F.split("text", " ").alias("w")).select("item", F.explode(F.array_distinct(grams)).alias("key"))
    long = b.filter(F.size("w") >= 5).select("query", "passage", three(F.lit(1)).alias("key"))
    near = keyed.join(long, "key").select("query", "item", "passage").distinct()
    few = b.filter(F.size("w") < 5).select("query", F.col("passage").alias("pattern"))
    short = containing(docs.select(F.col("item").alias("id"), "text"), few.select("pattern")).join(few, "pattern").select("query", F.col("id").alias("item"), F.col("pattern").alias("passage"))
    near = near.unionByName(short)
    truth = near.join(docs, "item").filter(F.contains("text", "passage")).select("query", "item")
    ranked = truth.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy("item")))
    return R.retrieval_metrics(ranked, truth, 5)


@query("SELECT lang, floor(avg(n_chars) * 1e3 + 0.5) / 1e3 AS mean, floor(median(n_chars) * 1e3 + 0.5) / 1e3 AS med, floor(avg(CASE WHEN n_chars > 1500 THEN 1.0 ELSE 0.0 END) * 1e3 + 0.5) / 1e3 AS rate FROM documents GROUP BY 1")
def b5_a6_summary(spark, d):
    m = lambda c: T.half_up(c, 3)
    return table(spark, d, "documents").groupBy("lang").agg(m(F.avg("n_chars")).alias("mean"), m(F.percentile("n_chars", F.lit(0.5))).alias("med"), m(F.avg(F.when(F.col("n_chars") > 1500, 1.0).otherwise(0.0))).alias("rate"))


@query("SELECT sha1(text) AS hash, count(*) AS size, string_agg(doc_id::VARCHAR, ',' ORDER BY doc_id) AS members FROM documents GROUP BY 1 HAVING count(*) > 1")
def d2_duplicate_groups(spark, d):
    g = table(spark, d, "documents").groupBy(F.sha1("text").alias("hash")).agg(F.count(F.lit(1)).alias("size"), F.array_join(F.transform(F.array_sort(F.collect_list("doc_id")), lambda x: x.cast("string")), ",").alias("members"))
    return g.filter("size > 1")


@query("WITH s AS (SELECT l_orderkey AS k, list_sort(list(DISTINCT l_suppkey)) AS a FROM lineitem GROUP BY 1), t AS (SELECT k, a, len(a) AS n FROM s WHERE len(a) >= 4) SELECT x.k AS a, y.k AS b, floor(len(list_intersect(x.a, y.a)) / (x.n + y.n - len(list_intersect(x.a, y.a)))::DOUBLE * 1e6 + 0.5) / 1e6 AS similarity FROM t x JOIN t y ON x.n = y.n AND x.k < y.k WHERE len(list_intersect(x.a, y.a)) / (x.n + y.n - len(list_intersect(x.a, y.a)))::DOUBLE >= 0.6")
def d3_call_pattern_pairs(spark, d):
    return store.similar_sets(table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.array_sort(F.collect_set("l_suppkey")).alias("a")).filter(F.size("a") >= 4), 0.6)


@query("SELECT o_orderkey AS id, o_orderstatus AS status FROM orders WHERE o_orderkey % 7 <> 0 UNION ALL SELECT o_orderkey, 'NEW' FROM orders WHERE o_orderkey % 7 = 0")
def k2_upsert(spark, d):
    old = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"))
    return store.upsert(old, old.filter("id % 7 = 0").withColumn("status", F.lit("NEW")), ["id"])


@query("SELECT event_id, event_type FROM events ORDER BY event_id DESC LIMIT 1000")
def s18_log_tail(spark, d):
    return store.tail(table(spark, d, "events").select("event_id", "event_type"), "event_id", 1000)


@query("SELECT doc_id, source FROM documents WHERE NOT regexp_matches(lower(source), 'src1|src2') AND lang = 'en'")
def p2_negative_like(spark, d):
    return table(spark, d, "documents").filter(~F.lower("source").rlike("src1|src2") & (F.col("lang") == "en")).select("doc_id", "source")


@query("SELECT c_custkey, count(o_orderkey) AS n, count(CASE WHEN o_orderstatus = 'F' THEN 1 END) AS n_f FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def j1_a1_left_conditional_count(spark, d):
    o = table(spark, d, "orders").groupBy("o_custkey").agg(F.count("o_orderkey").alias("n"), F.count(F.when(F.col("o_orderstatus") == "F", 1)).alias("n_f"))
    return table(spark, d, "customer").select("c_custkey").join(o, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("n_f", F.lit(0)).alias("n_f"))


@query("SELECT l_suppkey, count(*) AS hits FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 30) GROUP BY 1 ORDER BY hits DESC, l_suppkey LIMIT 40")
def j2_a2_callee_expansion(spark, d):
    top = table(spark, d, "part").orderBy(F.desc("p_retailprice"), "p_partkey").limit(30).select("p_partkey")
    x = table(spark, d, "lineitem").select("l_partkey", "l_suppkey").join(F.broadcast(top), F.col("l_partkey") == F.col("p_partkey"), "left_semi")
    return x.groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("hits")).orderBy(F.desc("hits"), "l_suppkey").limit(40)


@query("SELECT s_suppkey, coalesce(string_agg(DISTINCT l_returnflag, ',' ORDER BY l_returnflag), '') AS flags FROM supplier LEFT JOIN lineitem ON l_suppkey = s_suppkey GROUP BY 1")
def j3_a3_group_concat(spark, d):
    f = table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.array_join(F.array_sort(F.collect_set("l_returnflag")), ",").alias("flags"))
    return table(spark, d, "supplier").select("s_suppkey").join(f, F.col("s_suppkey") == F.col("l_suppkey"), "left").select("s_suppkey", F.coalesce("flags", F.lit("")).alias("flags"))


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def j4_anti_join(spark, d):
    return table(spark, d, "customer").select("c_custkey").join(table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti")


@query("SELECT p_brand, p_partkey, p_retailprice FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS k FROM part) WHERE k <= 3")
def w8_top_k_per_group(spark, d):
    w = Window.partitionBy("p_brand").orderBy(F.desc("p_retailprice"), "p_partkey")
    return table(spark, d, "part").select("p_brand", "p_partkey", "p_retailprice").withColumn("k", F.row_number().over(w)).filter("k <= 3").drop("k")


@query("SELECT CAST(json_extract_string(props, '$.k') AS BIGINT) % 10 AS bucket, count(*) AS n FROM events GROUP BY 1")
def json_props(spark, d):
    k = F.get_json_object("props", "$.k").cast("long")
    return table(spark, d, "events").groupBy((k % 10).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier")
def set_intersect(spark, d):
    return table(spark, d, "customer").select(F.col("c_nationkey").alias("k")).intersect(table(spark, d, "supplier").select("s_nationkey"))


@query("SELECT n_nationkey AS k FROM nation EXCEPT SELECT s_nationkey FROM supplier WHERE s_suppkey < 12")
def set_except(spark, d):
    return table(spark, d, "nation").select(F.col("n_nationkey").alias("k")).subtract(table(spark, d, "supplier").filter("s_suppkey < 12").select("s_nationkey"))


@query("SELECT c_custkey, n, CASE WHEN n > 5 THEN 'HIGH' WHEN n > 2 THEN 'MED' ELSE 'LOW' END AS impact FROM (SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1)")
def q5_impact(spark, d):
    return j1_a1_left_conditional_count(spark, d).select("c_custkey", "n", R.impact_level(F.col("n")).alias("impact"))


@query("WITH x AS (SELECT l_suppkey, sum(CASE WHEN l_returnflag = 'A' THEN 1 ELSE 0 END) - sum(CASE WHEN l_returnflag = 'N' THEN 1 ELSE 0 END) AS d FROM lineitem GROUP BY 1), r AS (SELECT d, row_number() OVER (ORDER BY abs(d), d, l_suppkey) AS r FROM x WHERE d <> 0) SELECT sum(CASE WHEN d > 0 THEN r ELSE 0 END)::BIGINT AS w_plus, sum(CASE WHEN d < 0 THEN r ELSE 0 END)::BIGINT AS w_minus, count(*) AS n FROM r")
def a20_signed_rank(spark, d):
    x = table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.sum((F.col("l_returnflag") == "A").cast("long")).alias("x"), F.sum((F.col("l_returnflag") == "N").cast("long")).alias("y"))
    return R.signed_rank(x, "x", "y", ["d", "l_suppkey"])


def queries() -> dict[str, Query]:
    return {name: f for name, (f, _) in FOUND.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in FOUND.items() if sql}
