"""Queries of the fact roll-ups and look-ups, each beside the SQL that it must equal; part of the catalogue."""

from __future__ import annotations

from pyspark.sql import functions as F

from strata.operators import facts as X
from strata.operators import graph as G

from .catalogue import DEG, EDGES, query, r6, table, trade

SITE = r"^https?://[^/]+/[^/]+"


@query(rf"""WITH u AS (SELECT page_id, split_part(url, '?', 1) AS file FROM pages), m AS (SELECT regexp_extract(file, '{SITE}') AS path, min(page_id) AS ord FROM u GROUP BY 1)
SELECT page_id, (SELECT arg_min(path, ord) FROM m WHERE path <> '' AND (file = path OR starts_with(file, path || '/'))) AS path FROM u""")
def p6_module_of_file(spark, d):
    u = table(spark, d, "pages").select("page_id", F.split_part("url", F.lit("?"), F.lit(1)).alias("file"))
    m = u.groupBy(F.regexp_extract("file", SITE, 0).alias("path")).agg(F.min("page_id").alias("ord")).filter("path <> ''")
    return X.module_of(u, "file", m, "path", "ord").select("page_id", "path")


@query("SELECT doc_id, CASE WHEN source = 'src1' THEN 'one' WHEN starts_with(source, 'src1') THEN 'teens' WHEN starts_with(source, 's') THEN 'rest' END AS domain FROM documents")
def p13_domain_rules(spark, d):
    return table(spark, d, "documents").select("doc_id", X.domain_of(F.col("source"), [("src1", "one"), ("src1*", "teens"), ("s*", "rest")]).alias("domain"))


@query("SELECT p_partkey, CASE WHEN row_number() OVER (PARTITION BY p_brand || ' ' || p_type ORDER BY p_partkey) = 1 THEN p_brand || ' ' || p_type ELSE p_brand || ' ' || p_type || ' (' || p_partkey || ')' END AS id FROM part")
def w5_distinct_ids(spark, d):
    p = table(spark, d, "part").select("p_partkey", F.concat_ws(" ", "p_brand", "p_type").alias("signature"))
    return X.distinct_ids(p, "signature", "p_partkey").select("p_partkey", "id")


@query("SELECT user_id FROM events GROUP BY 1 HAVING bool_or(event_type = 'view') AND bool_or(event_type = 'purchase') AND bool_or(event_type IN ('error', 'click'))")
def a17_crud(spark, d):
    return X.crud_resources(table(spark, d, "events"), "user_id", "event_type", "VIEW", "PURCHASE", ("ERROR", "CLICK"))


@query("""WITH x AS (SELECT unnest([o_orderstatus, o_orderpriority]) AS tag, year(o_orderdate) AS sprint, o_custkey AS item FROM orders),
t AS (SELECT tag, count(DISTINCT item) AS total_items FROM x GROUP BY 1)
SELECT tag, CAST(sprint AS BIGINT) AS sprint, count(*) AS features, count(DISTINCT item) AS items, any_value(total_items) AS total_items FROM x JOIN t USING (tag) GROUP BY 1, 2""")
def a18_feature_arcs(spark, d):
    o = table(spark, d, "orders").select(F.array("o_orderstatus", "o_orderpriority").alias("tags"), F.year("o_orderdate").cast("long").alias("sprint"), "o_custkey")
    return X.feature_arcs(o, "tags", "sprint", "o_custkey")


@query("SELECT user_id, event_type, n FROM (SELECT user_id, event_type, count(*) AS n, row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, event_type) AS k FROM events GROUP BY 1, 2) WHERE k = 1")
def a21_majority(spark, d):
    return X.majority(table(spark, d, "events"), "user_id", "event_type")


@query("""WITH a AS (SELECT c_custkey AS k, 'N' || c_nationkey AS v FROM customer WHERE c_nationkey < 12), b AS (SELECT o_custkey AS k, min(o_orderstatus) AS v FROM orders GROUP BY 1)
SELECT coalesce(a.k, b.k) AS k, coalesce(b.v, a.v) AS v FROM a FULL OUTER JOIN b ON a.k = b.k""")
def j7_registry_merge(spark, d):
    a = table(spark, d, "customer").filter("c_nationkey < 12").select(F.col("c_custkey").alias("k"), F.concat(F.lit("N"), F.col("c_nationkey").cast("string")).alias("v"))
    b = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.min("o_orderstatus").alias("v"))
    return X.merged(a, b, ["k"], ["v"])


@query(f"""WITH {EDGES}, x AS (SELECT a.layer, count(*) AS edges, count(CASE WHEN a.layer <> b.layer THEN 1 END) AS cross_layer_out FROM e JOIN nodes a ON a.id = src JOIN nodes b ON b.id = dst GROUP BY 1)
SELECT layer, count(*) AS nodes, coalesce(any_value(edges), 0) AS edges, coalesce(any_value(cross_layer_out), 0) AS cross_layer_out FROM nodes LEFT JOIN x USING (layer) GROUP BY 1""")
def a12_layer_usage(spark, d):
    return X.layer_usage(*trade(spark, d))


@query("""WITH x AS (SELECT o_custkey, count(*) AS n, count(CASE WHEN o_orderstatus = 'F' THEN 1 END) AS f FROM orders GROUP BY 1)
SELECT o_custkey, concat_ws(',', CASE WHEN f > 8 THEN 'delta:drift' WHEN f > 5 THEN 'delta:critical' END, CASE WHEN f >= 6 THEN 'capacity:F:critical' WHEN f >= 5 THEN 'capacity:F:warning' END,
CASE WHEN n >= 20 THEN 'capacity:total:critical' WHEN n >= 17 THEN 'capacity:total:warning' END, CASE WHEN n > 12 THEN 'growth:edges' END) AS alerts FROM x""")
def c13_alerts(spark, d):
    x = table(spark, d, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("o_orderstatus") == "F", 1)).alias("f"))
    f, n = F.col("f"), F.col("n")
    status = lambda v, warn, crit: F.when(v >= crit, "critical").when(v >= warn, "warning").otherwise("ok")
    delta = F.when(f > 8, "drift").when(f > 5, "critical").otherwise("stable")
    found = X.alerts(delta, F.array(F.struct(F.lit("F").alias("layer"), status(f, 5, 6).alias("status"))), status(n, 17, 20), F.when(n > 12, "critical").otherwise("ok"))
    return x.select("o_custkey", F.array_join(found, ",").alias("alerts"))


@query("""WITH c AS (SELECT c_nationkey AS k, count(*) AS u FROM customer GROUP BY 1), s AS (SELECT s_nationkey AS k, count(*) AS r FROM supplier GROUP BY 1)
SELECT n_name, CAST(coalesce(u, 0) * 4 + coalesce(r, 0) * 2 + least(length(n_name), 10) AS BIGINT) AS weight FROM nation LEFT JOIN c ON c.k = n_nationkey LEFT JOIN s ON s.k = n_nationkey ORDER BY weight DESC, n_name LIMIT 8""")
def c16_core_models(spark, d):
    n = lambda name, key, to: table(spark, d, name).groupBy(F.col(key).alias("n_nationkey")).agg(F.count(F.lit(1)).alias(to))
    x = table(spark, d, "nation").join(n("customer", "c_nationkey", "u"), "n_nationkey", "left").join(n("supplier", "s_nationkey", "r"), "n_nationkey", "left").fillna(0, ["u", "r"])
    return x.select("n_name", X.model_weight(F.col("u"), F.col("r"), F.length("n_name")).cast("long").alias("weight")).orderBy(F.desc("weight"), "n_name").limit(8)


@query("""SELECT 'unused' AS status, c_custkey AS k FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')
UNION ALL SELECT DISTINCT 'unmatched', o_custkey FROM orders WHERE o_orderstatus = 'P' AND o_custkey NOT IN (SELECT c_custkey FROM customer)""")
def c3_unmatched(spark, d):
    calls = table(spark, d, "orders").filter("o_orderstatus = 'P'").select(F.col("o_custkey").alias("k"))
    return X.unmatched(calls, table(spark, d, "customer").select(F.col("c_custkey").alias("k")), "k")


@query(f"WITH {DEG} SELECT id, CAST(floor((n_in + n_out) / greatest(max(n_in + n_out) OVER (PARTITION BY layer)::DOUBLE, 1.0) * 1000000 + 0.5) / 1000000 AS DOUBLE) AS share FROM deg JOIN nodes USING (id)")
def w3_share_of_maximum(spark, d):
    nodes, e = trade(spark, d)
    deg = G.degrees(nodes, e).select("id", (F.col("n_in") + F.col("n_out")).alias("deg")).join(nodes, "id")
    return deg.select("id", r6(X.by_maximum(F.col("deg"), "layer")).alias("share"))


@query("SELECT DISTINCT p_brand, TRY_CAST(regexp_replace(p_brand, '[^0-9]', '', 'g') AS BIGINT) AS sprint FROM part")
def t12_numeric_key(spark, d):
    return table(spark, d, "part").select("p_brand").distinct().select("p_brand", X.numeric_key(F.col("p_brand")).alias("sprint"))
