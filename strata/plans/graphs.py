"""Queries of graph builders, drift and depth over the code base's facts, each beside the SQL that it must equal."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from strata.functions import text as T
from strata.operators import code as C
from strata.operators import facts as X
from strata.operators import graph as G
from strata.operators import reports as R
from strata.sources.staging import staged

from .catalogue import query, r6, table
from .code import MODULE_EDGES, module_edges
from .codebase import WITH, fact
from .find import SETS, structures

TEST = "regexp_matches(lower({0}), 'test|spec|mock')"
DOMAIN = "CASE WHEN {0} = 'service-1' THEN 'one' WHEN starts_with({0}, 'service-1') THEN 'teens' WHEN {0} IN ('service-2', 'service-3') THEN 'pair' END"
RULES = [("service-1", "one"), ("service-1*", "teens"), ("service-2", "pair"), ("service-3", "pair")]
LEVELS = f"""{MODULE_EDGES}, mp AS (SELECT DISTINCT from_module AS src, to_module AS dst FROM me), fe AS (SELECT src, dst FROM file_deps WHERE NOT {TEST.format('src')} AND NOT {TEST.format('dst')}), dm AS (SELECT id, {DOMAIN.format('id')} AS domain FROM modules),
de AS (SELECT DISTINCT coalesce(a.domain, 'unassigned') AS src, coalesce(b.domain, 'unassigned') AS dst FROM mp JOIN dm a ON a.id = src JOIN dm b ON b.id = dst),
nd AS (SELECT 'module' AS level, id, layer FROM modules UNION ALL SELECT 'file', f.path, layer FROM files f JOIN modules m ON m.id = f.module WHERE NOT {TEST.format('f.path')} UNION ALL SELECT 'domain', id, id FROM (SELECT domain AS id FROM dm WHERE domain IS NOT NULL UNION SELECT src FROM de UNION SELECT dst FROM de)
UNION ALL SELECT 'function', f.name, min(m.layer) FROM functions f JOIN files ON path = file JOIN modules m ON m.id = module GROUP BY f.name),
ed AS (SELECT 'module' AS level, src, dst FROM mp UNION ALL SELECT 'file', src, dst FROM fe UNION ALL SELECT 'domain', src, dst FROM de UNION ALL SELECT DISTINCT 'function', caller, callee FROM fn_calls)"""
DEGREES = LEVELS + ", dg AS (SELECT level, id, sum(i)::BIGINT AS n_in, sum(o)::BIGINT AS n_out FROM (SELECT level, dst AS id, 1 AS i, 0 AS o FROM ed UNION ALL SELECT level, src, 0, 1 FROM ed UNION ALL SELECT level, id, 0, 0 FROM nd) GROUP BY 1, 2)"
ALLOWED = [("api", "core"), ("api", "data"), ("core", "data"), ("ui", "api"), ("one", "pair"), ("teens", "pair")]
AL = ", al AS (SELECT unnest(['api', 'api', 'core', 'ui', 'one', 'teens']) AS a, unnest(['core', 'data', 'data', 'api', 'pair', 'pair']) AS b)"


def levels(spark, d, which=None):
    f = lambda n: fact(spark, d, n)
    nodes, edges = G.graph_levels(f("modules"), f("files"), f("file_deps"), module_edges(spark, d), X.domain_of(F.col("id"), RULES), f("fn_calls"), f("functions"))
    if which:
        nodes, edges = nodes.filter(F.col("level").isin(which)), edges.filter(F.col("level").isin(which))
    return staged(nodes, "nodes"), staged(edges, "edges")


@query(f"{LEVELS} SELECT level, 'node' AS kind, id AS a, coalesce(layer, '') AS b FROM nd UNION ALL SELECT level, 'edge', src, dst FROM ed")
def g17_g1_graph_builders(spark, d):
    nodes, edges = levels(spark, d)
    return nodes.select("level", F.lit("node").alias("kind"), F.col("id").alias("a"), F.coalesce("layer", F.lit("")).alias("b")).unionByName(edges.select("level", F.lit("edge").alias("kind"), F.col("src").alias("a"), F.col("dst").alias("b")))


CLOSE = "small AS (SELECT * FROM ed WHERE level IN ('module', 'domain')), rc(level, a, b) AS (SELECT level, src, dst FROM small UNION SELECT rc.level, rc.a, s.dst FROM rc JOIN small s ON s.level = rc.level AND s.src = rc.b), cyc AS (SELECT DISTINCT x.level, x.a AS id FROM rc x WHERE x.a = x.b), comp AS (SELECT DISTINCT x.level, least(x.a, min(y.b)) AS c FROM rc x JOIN rc y ON y.level = x.level AND y.a = x.a JOIN rc z ON z.level = x.level AND z.a = y.b AND z.b = x.a WHERE x.a = x.b GROUP BY x.level, x.a)"
REACH = "WITH RECURSIVE " + LEVELS[5:] + ", " + CLOSE


@query(f"{REACH} SELECT nd.level, nd.id, cyc.id IS NOT NULL AS in_cycle FROM nd LEFT JOIN cyc ON cyc.level = nd.level AND cyc.id = nd.id WHERE nd.level IN ('module', 'domain')")
def g5_cycle_members(spark, d):
    return G.ranked_levels(*levels(spark, d, ["module", "domain"]), rounds=1).select("level", "id", "in_cycle")


@query(f"{REACH} SELECT l.level, (SELECT count(*) FROM comp WHERE comp.level = l.level) AS cycles FROM (SELECT DISTINCT level FROM nd WHERE level IN ('module', 'domain')) l")
def g4_cycle_counts(spark, d):
    return G.cycle_counts(*levels(spark, d, ["module", "domain"]))


@query(f"{DEGREES}, c AS (SELECT level, n_in + n_out AS d, count(*) AS c FROM dg GROUP BY 1, 2), n AS (SELECT level, sum(c) AS n FROM c GROUP BY 1) SELECT level, any_value(n)::BIGINT AS nodes, floor(-sum(c / n * ln(c / n)) * 1e6 + 0.5) / 1e6 AS entropy FROM c JOIN n USING (level) GROUP BY 1")
def a13_level_entropy(spark, d):
    return G.level_entropy(G.level_degrees(*levels(spark, d))).select("level", "nodes", r6(F.col("entropy")).alias("entropy"))


@query(f"{DEGREES} SELECT level, floor(avg(n_out) * 1e6 + 0.5) / 1e6 AS fanout_avg, max(n_out) AS fanout_max, floor(sum(n_out) / count(*) * 1e6 + 0.5) / 1e6 AS density FROM dg GROUP BY 1")
def g11_fanout(spark, d):
    x = G.level_degrees(*levels(spark, d)).groupBy("level").agg(F.avg("n_out").alias("a"), F.max("n_out").alias("fanout_max"), (F.sum("n_out") / F.count(F.lit(1))).alias("b"))
    return x.select("level", r6(F.col("a")).alias("fanout_avg"), "fanout_max", r6(F.col("b")).alias("density"))


CROSS = f"{DEGREES}{AL}, cr AS (SELECT ed.level, count(*) AS edges, count(CASE WHEN al.a IS NULL THEN 1 END) AS cross_edges FROM ed LEFT JOIN nd x ON x.level = ed.level AND x.id = src LEFT JOIN nd y ON y.level = ed.level AND y.id = dst LEFT JOIN al ON al.a = x.layer AND al.b = y.layer GROUP BY 1)"
DRIFT = f"""WITH RECURSIVE {CROSS[5:]}, {CLOSE}, c AS (SELECT level, n_in + n_out AS d, count(*) AS c FROM dg GROUP BY 1, 2), n AS (SELECT level, sum(c)::DOUBLE AS n FROM c GROUP BY 1), en AS (SELECT level, any_value(n) AS n, -sum(c / n * ln(c / n)) AS e FROM c JOIN n USING (level) GROUP BY 1),
sc AS (SELECT en.level, n, edges, cross_edges, e, cross_edges / edges::DOUBLE AS x, (SELECT count(*) FROM comp WHERE comp.level = en.level) / n AS cy FROM en JOIN cr USING (level) WHERE en.level IN ('module', 'domain')),
dt AS (SELECT level, edges, cross_edges, 0.4 * e + 0.3 * x + 0.2 * cy AS d FROM sc), dl AS (SELECT *, ln(4) - ln(d + 1e-6) AS delta FROM dt), rp AS (SELECT level, edges, cross_edges, floor(d * 1e6 + 0.5) / 1e6 AS score, floor(delta * 1e6 + 0.5) / 1e6 AS delta, CASE WHEN delta < 0 THEN 'drift' WHEN delta < 0.25 THEN 'critical' ELSE 'stable' END AS status FROM dl)"""


def drift(spark, d):
    """Drift of two levels: degree entropy, edges that break the layers' rules, cycles; modularity has weight 0 here, as SQL can't state it."""
    nodes, edges = levels(spark, d, ["module", "domain"])
    allowed = spark.createDataFrame(ALLOWED, "a string, b string")
    cross = G.level_cross(nodes, edges, allowed).groupBy("level").agg(F.count(F.lit(1)).alias("edges"), F.sum("cross").alias("cross_edges"))
    x = G.level_entropy(G.level_degrees(nodes, edges)).join(cross, "level").join(G.cycle_counts(nodes, edges), "level")
    score = R.drift_score(F.col("entropy"), F.col("cross_edges") / F.col("edges"), F.col("cycles") / F.col("nodes"), F.lit(0.0))
    x = x.withColumn("score", score).withColumn("delta", R.drift_delta(F.col("score"), F.lit(4)))
    return x.select("level", "edges", "cross_edges", r6(F.col("score")).alias("score"), r6(F.col("delta")).alias("delta"), R.drift_status(F.col("delta")).alias("status"))


@query(f"{DRIFT} SELECT * FROM rp")
def g16_drift_by_level(spark, d):
    return drift(spark, d)


@query(f"{DRIFT} SELECT * FROM rp WHERE level = 'module'")
def g18_primary_level(spark, d):
    return R.primary_level(drift(spark, d))


MODULARITY = """me2 AS (SELECT level, id, coalesce(layer, '') AS c FROM nd), ends AS (SELECT ed.level, a.c AS ca, b.c AS cb FROM ed JOIN me2 a ON a.level = ed.level AND a.id = src JOIN me2 b ON b.level = ed.level AND b.id = dst WHERE src <> dst), tot AS (SELECT level, c, count(*) AS k FROM (SELECT level, ca AS c FROM ends UNION ALL SELECT level, cb FROM ends) GROUP BY 1, 2),
inn AS (SELECT level, ca AS c, 2 * count(*) AS i FROM ends WHERE ca = cb GROUP BY 1, 2), mm AS (SELECT level, sum(k)::DOUBLE AS two_m FROM tot GROUP BY 1), qq AS (SELECT tot.level, sum(coalesce(i, 0) / two_m - (k / two_m) ** 2) AS q FROM tot JOIN mm USING (level) LEFT JOIN inn ON inn.level = tot.level AND inn.c = tot.c GROUP BY 1),
mg AS (SELECT l.level, coalesce(q, 0.0) AS q, coalesce(1 - greatest(0.0, least(1.0, q)), 0.0) AS gap FROM (SELECT DISTINCT level FROM nd) l LEFT JOIN qq USING (level))"""


@query(f"{LEVELS}, {MODULARITY} SELECT level, floor(q * 1e6 + 0.5) / 1e6 AS modularity, floor(gap * 1e6 + 0.5) / 1e6 AS gap FROM mg")
def g15_modularity_of_layers(spark, d):
    """How well the layers part each level's graph."""
    nodes, edges = levels(spark, d)
    x = G.community_modularity(nodes.withColumnRenamed("layer", "community"), edges)
    return x.select("level", r6(F.col("modularity")).alias("modularity"), r6(F.col("gap")).alias("gap"))


ALL_DRIFT = f"""WITH RECURSIVE {CROSS[5:]}, {CLOSE.replace(" WHERE level IN ('module', 'domain')", "")}, {MODULARITY}, c AS (SELECT level, n_in + n_out AS d, count(*) AS c FROM dg GROUP BY 1, 2), n AS (SELECT level, sum(c)::DOUBLE AS n FROM c GROUP BY 1), en AS (SELECT level, any_value(n) AS n, -sum(c / n * ln(c / n)) AS e FROM c JOIN n USING (level) GROUP BY 1),
dl AS (SELECT en.level, edges, cross_edges, 0.4 * e + 0.3 * cross_edges / edges + 0.2 * (SELECT count(*) FROM comp WHERE comp.level = en.level) / n + 0.1 * gap AS d FROM en JOIN cr USING (level) JOIN mg USING (level)), rp AS (SELECT level, edges, cross_edges, floor(d * 1e6 + 0.5) / 1e6 AS score, floor((ln(4) - ln(d + 1e-6)) * 1e6 + 0.5) / 1e6 AS delta, CASE WHEN ln(4) - ln(d + 1e-6) < 0 THEN 'drift' WHEN ln(4) - ln(d + 1e-6) < 0.25 THEN 'critical' ELSE 'stable' END AS status FROM dl)"""


@query(f"{ALL_DRIFT} SELECT *, level = 'function' AS is_primary FROM rp")
def g16_g18_drift_of_all_levels(spark, d):
    """Drift of all four levels with all four terms; the layers are the communities of the modularity term."""
    nodes, edges = levels(spark, d)
    allowed = spark.createDataFrame(ALLOWED, "a string, b string")
    cross = G.level_cross(nodes, edges, allowed).groupBy("level").agg(F.count(F.lit(1)).alias("edges"), F.sum("cross").alias("cross_edges"))
    gap = G.community_modularity(nodes.withColumnRenamed("layer", "community"), edges)
    x = G.level_entropy(G.level_degrees(nodes, edges)).join(cross, "level").join(G.cycle_counts(nodes, edges), "level").join(gap, "level")
    x = x.withColumn("score", R.drift_score(F.col("entropy"), F.col("cross_edges") / F.col("edges"), F.col("cycles") / F.col("nodes"), F.col("gap")))
    x = x.withColumn("delta", R.drift_delta(F.col("score"), F.lit(4)))
    x = staged(x.select("level", "edges", "cross_edges", r6(F.col("score")).alias("score"), r6(F.col("delta")).alias("delta"), R.drift_status(F.col("delta")).alias("status")), "drift")
    return x.join(R.primary_level(x).select("level", F.lit(True).alias("is_primary")), "level", "left").fillna(False, ["is_primary"])


@query(None)
def g15_g10_g3_level_kernels(spark, d):
    _, edges = levels(spark, d, ["module", "domain", "file"])
    return G.per_level(edges.select("level", F.concat_ws("|", "src", "dst").alias("ord"), "src", "dst"))


HEAT = f"""WITH RECURSIVE {DEGREES[5:]}, {CLOSE}, k AS (SELECT level, count(*)::DOUBLE AS n FROM nd GROUP BY 1), hn AS (SELECT level, id FROM nd WHERE level IN ('module', 'domain')), o AS (SELECT level, src, count(*)::DOUBLE AS out FROM ed GROUP BY 1, 2), r0 AS (SELECT level, id, 1 / n AS rank FROM hn JOIN k USING (level))""" + "".join(
    f", r{i} AS MATERIALIZED (SELECT h.level, h.id, 0.15 / k.n + 0.85 * (coalesce((SELECT sum(q.rank / o.out) FROM ed e JOIN r{i - 1} q ON q.level = e.level AND q.id = e.src JOIN o ON o.level = e.level AND o.src = e.src WHERE e.level = h.level AND e.dst = h.id), 0) + (SELECT coalesce(sum(q.rank), 0) FROM r{i - 1} q WHERE q.level = h.level AND q.id NOT IN (SELECT src FROM ed WHERE ed.level = h.level)) / k.n) AS rank FROM hn h JOIN k USING (level))" for i in range(1, 31)
) + """, cx AS (SELECT level, id, avg(c) AS c FROM (SELECT ed.level, src AS id, CASE WHEN x.layer <> y.layer THEN 1.0 ELSE 0.0 END AS c FROM ed JOIN nd x ON x.level = ed.level AND x.id = src JOIN nd y ON y.level = ed.level AND y.id = dst UNION ALL SELECT ed.level, dst, CASE WHEN x.layer <> y.layer THEN 1.0 ELSE 0.0 END FROM ed JOIN nd x ON x.level = ed.level AND x.id = src JOIN nd y ON y.level = ed.level AND y.id = dst) GROUP BY 1, 2),
hm AS (SELECT h.level, h.id, floor((0.4 * rank / max(rank) OVER (PARTITION BY h.level) + 0.3 * (n_in + n_out) / greatest(max(n_in + n_out) OVER (PARTITION BY h.level), 1) + 0.2 * coalesce(c, 0) + 0.1 * CASE WHEN cyc.id IS NULL THEN 0 ELSE 1 END) * 1e4 + 0.5) / 1e4 AS score FROM r30 h JOIN dg ON dg.level = h.level AND dg.id = h.id LEFT JOIN cx ON cx.level = h.level AND cx.id = h.id LEFT JOIN cyc ON cyc.level = h.level AND cyc.id = h.id)"""


@query(f"{HEAT} SELECT * FROM hm")
def g7_g8_heatmap_bundle(spark, d):
    return G.heatmap(*levels(spark, d, ["module", "domain"]))


@query(f"{HEAT} SELECT id, score FROM hm WHERE level = 'module' ORDER BY score DESC, id LIMIT 5")
def t6_r18_heatmap_level(spark, d):
    h = G.heatmap(*levels(spark, d, ["module", "domain"]))
    return h.filter("level = 'module'").orderBy(F.desc("score"), "id").limit(5).select("id", "score")


@query(f"{DEGREES} SELECT dg.id, n_in, n_out, layer FROM dg JOIN nd ON nd.level = dg.level AND nd.id = dg.id WHERE dg.level = 'module' ORDER BY n_in + n_out DESC, dg.id LIMIT 10")
def t7_top_modules(spark, d):
    nodes, edges = levels(spark, d, ["module"])
    return G.level_degrees(nodes, edges).join(nodes, ["level", "id"]).orderBy(F.desc(F.col("n_in") + F.col("n_out")), "id").limit(10).select("id", "n_in", "n_out", "layer")


@query(f"{MODULE_EDGES} SELECT m.id, (SELECT count(*) FROM endpoints e WHERE e.module = m.id) * 3 + n_files + (SELECT count(DISTINCT to_module) FROM me WHERE from_module = m.id) AS score FROM modules m ORDER BY score DESC, id LIMIT 8")
def t8_c16_key_modules(spark, d):
    e = fact(spark, d, "endpoints").groupBy(F.col("module").alias("id")).agg(F.count(F.lit(1)).alias("e"))
    i = module_edges(spark, d).groupBy(F.col("from_module").alias("id")).agg(F.count_distinct("to_module").alias("i"))
    x = fact(spark, d, "modules").join(e, "id", "left").join(i, "id", "left").fillna(0, ["e", "i"])
    return x.select("id", (F.col("e") * 3 + F.col("n_files") + F.col("i")).alias("score")).orderBy(F.desc("score"), "id").limit(8)


@query(f"{WITH}, en AS (SELECT path FROM files WHERE fid % 17 = 0) SELECT path FROM files WHERE path NOT IN (SELECT dst FROM file_deps) AND path NOT IN (SELECT path FROM en)")
def g21_orphan_files(spark, d):
    f = fact(spark, d, "files")
    return f.join(fact(spark, d, "file_deps").select(F.col("dst").alias("path")), "path", "left_anti").join(f.filter("fid % 17 = 0").select("path"), "path", "left_anti").select("path")


@query(f"{WITH}, im AS (SELECT file, CASE WHEN fid % 10 = 0 THEN '*' ELSE name END AS symbol FROM functions WHERE fid % 3 = 0 OR fid % 10 = 0), en AS (SELECT path AS file FROM files WHERE fid % 17 = 0) SELECT file, name AS symbol FROM functions f WHERE file NOT IN (SELECT file FROM en) AND file NOT IN (SELECT file FROM im WHERE symbol = '*') AND (file, name) NOT IN (SELECT (file, symbol) FROM im)")
def g22_unused_exports(spark, d):
    f = fact(spark, d, "functions")
    imports = f.filter("fid % 3 = 0 or fid % 10 = 0").select("file", F.when(F.col("fid") % 10 == 0, "*").otherwise(F.col("name")).alias("symbol"))
    return G.unused_exports(f.select("file", F.col("name").alias("symbol")), imports, fact(spark, d, "files").filter("fid % 17 = 0").select(F.col("path").alias("file")))


@query(f"{LEVELS}, s AS (SELECT id FROM nd WHERE level = 'module' AND contains(id, '-1')) SELECT id FROM s UNION SELECT dst FROM ed WHERE level = 'module' AND src IN (SELECT id FROM s) UNION SELECT src FROM ed WHERE level = 'module' AND dst IN (SELECT id FROM s)")
def g23_focus_expansion(spark, d):
    nodes, edges = levels(spark, d, ["module"])
    return G.expanded(nodes.filter(F.col("id").contains("-1")), edges)


#: An acyclic graph: imports from files of smaller numbers to larger ones.
DAG = f"{WITH}, dag AS (SELECT DISTINCT src, dst FROM file_deps JOIN files a ON a.path = src JOIN files b ON b.path = dst WHERE a.fid < b.fid)"
DEPTH = f"""WITH RECURSIVE {DAG[5:]}, bo AS (SELECT src, dst FROM dag UNION SELECT dst, src FROM dag), sd AS (SELECT path AS id FROM files WHERE contains(path, 'handler1')), h1 AS (SELECT id FROM sd UNION SELECT dst FROM bo JOIN sd ON src = id), h2 AS (SELECT id FROM h1 UNION SELECT dst FROM bo JOIN h1 ON src = id),
sg AS (SELECT src, dst FROM dag WHERE src IN (SELECT id FROM h2) AND dst IN (SELECT id FROM h2)), lp(id, n) AS (SELECT DISTINCT dst, 1 FROM sg UNION SELECT sg.dst, n + 1 FROM lp JOIN sg ON src = id WHERE n < 20), fo AS (SELECT id, (SELECT count(*) FROM sg WHERE src = id) AS n FROM h2),
mt AS (SELECT (SELECT count(*) FROM h2) AS nodes, (SELECT count(*) FROM sg) AS edges, (SELECT coalesce(max(n), 0) FROM lp) AS depth, (SELECT avg(n) FROM fo) AS fa, (SELECT max(n) FROM fo) AS fm, (SELECT count(*) FROM sd) AS seeds, (SELECT count(*) FROM files) AS total)"""


@query(f"""{DEPTH}, cf AS (SELECT *, 0.35 * least(depth / 10, 1) + 0.2 * least(fa / 3, 1) + 0.15 * least(edges / nodes / 3, 1) + 0.15 * seeds / total AS c, CASE WHEN depth <= 2 THEN 'LOW' WHEN depth <= 5 THEN 'MEDIUM' ELSE 'HIGH' END AS dl, CASE WHEN fa > 2 OR fm > 5 THEN 'STRONG' WHEN fa > 1.2 OR fm > 2 THEN 'MODERATE' ELSE 'LOCAL' END AS pr FROM mt)
SELECT nodes, edges, depth::BIGINT AS depth, floor(fa * 100 + 0.5) / 100 AS fanout_avg, fm AS fanout_max, floor(c * 1000 + 0.5) / 1000 AS confidence, CASE WHEN c >= 0.8 THEN 'STRONG' WHEN c >= 0.6 THEN 'MODERATE' ELSE 'WEAK' END AS confidence_level, dl AS depth_level, pr AS propagation, CASE WHEN dl = 'HIGH' AND pr = 'STRONG' THEN 'NON_COMPRESSIBLE' WHEN dl = 'LOW' AND pr = 'LOCAL' THEN 'COMPRESSIBLE' ELSE 'PARTIAL' END AS compressible, CASE WHEN seeds / nodes < 0.1 THEN 'HIGH' WHEN seeds / nodes < 0.3 THEN 'MEDIUM' ELSE 'LOW' END AS ambiguity FROM cf""")
def q9_analyze_depth(spark, d):
    f = fact(spark, d, "files")
    at = lambda c: f.select(F.col("path").alias(c), F.col("fid").alias(f"f{c}"))
    dag = staged(fact(spark, d, "file_deps").join(at("src"), "src").join(at("dst"), "dst").filter("fsrc < fdst").select("src", "dst"), "dag")
    seeds = f.filter(F.col("path").contains("handler1")).select(F.col("path").alias("id"))
    kept = staged(G.k_hop(dag, seeds, 2).select("id"), "kept")
    sub = staged(G.induced(dag, kept), "sub")
    out = kept.join(sub.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("n")), "id", "left").fillna(0, ["n"]).agg(F.count(F.lit(1)).alias("nodes"), F.sum("n").alias("edges"), F.avg("n").alias("fa"), F.max("n").alias("fanout_max"))
    one = out.crossJoin(F.broadcast(G.dag_depth(sub))).crossJoin(F.broadcast(seeds.agg(F.count(F.lit(1)).alias("seeds")))).crossJoin(F.broadcast(f.agg(F.count(F.lit(1)).alias("total"))))
    c = R.confidence(F.col("depth"), F.col("fa"), F.col("edges") / F.col("nodes"), F.lit(0.0), F.col("seeds") / F.col("total"))
    level, spread = R.depth_level(F.col("depth")), R.propagation(F.col("fa"), F.col("fanout_max"))
    return one.select("nodes", "edges", "depth", T.half_up(F.col("fa"), 2).alias("fanout_avg"), "fanout_max", T.half_up(c, 3).alias("confidence"), R.confidence_level(c).alias("confidence_level"), level.alias("depth_level"), spread.alias("propagation"),
                      R.compressibility(level, spread, F.lit(False)).alias("compressible"), R.ambiguity(F.col("seeds"), F.col("nodes")).alias("ambiguity"))


@query(f"{DEPTH} SELECT src, dst FROM sg")
def g9_induced_subgraph(spark, d):
    f = fact(spark, d, "files")
    at = lambda c: f.select(F.col("path").alias(c), F.col("fid").alias(f"f{c}"))
    dag = fact(spark, d, "file_deps").join(at("src"), "src").join(at("dst"), "dst").filter("fsrc < fdst").select("src", "dst")
    return G.induced(dag, G.k_hop(dag, f.filter(F.col("path").contains("handler1")).select(F.col("path").alias("id")), 2))


EVAL = "SELECT o_custkey AS k, CASE WHEN o_custkey % 5 <> 0 THEN avg(CASE WHEN o_orderkey % 2 = 0 THEN o_totalprice END) / 1e5 END AS od, avg(CASE WHEN o_orderkey % 2 = 1 THEN o_totalprice END) / 1e5 AS nd, count(CASE WHEN o_orderkey % 2 = 0 THEN 1 END) AS oe, count(CASE WHEN o_orderkey % 2 = 1 THEN 1 END) AS ne FROM orders GROUP BY 1"


@query(f"""WITH x AS ({EVAL}), y AS (SELECT k, list_filter([CASE WHEN od IS NULL THEN 'baseline_missing' END, CASE WHEN nd < od THEN 'delta_regressed' END, CASE WHEN oe > 0 AND (ne - oe) / oe > 0.2 THEN 'edge_growth_ratio_exceeded' END, CASE WHEN ne > 9 THEN 'candidate_in_drift' END, CASE WHEN ne > 7 THEN 'capacity_critical' END, CASE WHEN oe % 3 = 1 THEN 'growth_critical' END, CASE WHEN oe % 4 <> ne % 4 THEN 'shape_changed' END], lambda v: v IS NOT NULL) AS r FROM x)
SELECT k, array_to_string(r, ',') AS reasons, CASE WHEN len(r) = 0 THEN 'accept' WHEN k % 2 = 0 THEN 'reject' ELSE 'warn' END AS decision FROM y""")
def q10_evaluate_candidates(spark, d):
    o = table(spark, d, "orders")
    side = lambda r, c: F.when(F.col("o_orderkey") % 2 == r, c)
    x = o.groupBy(F.col("o_custkey").alias("k")).agg((F.avg(side(0, F.col("o_totalprice"))) / 1e5).alias("od"), (F.avg(side(1, F.col("o_totalprice"))) / 1e5).alias("nd"), F.count(side(0, F.lit(1))).alias("oe"), F.count(side(1, F.lit(1))).alias("ne"))
    x = x.withColumn("od", F.when(F.col("k") % 5 != 0, F.col("od")))
    ne, oe = F.col("ne"), F.col("oe")
    r = R.candidate_reasons({"old_delta": F.col("od"), "delta": F.col("nd"), "old_edges": oe, "edges": ne, "status": F.when(ne > 9, "drift").otherwise("stable"), "capacity": F.when(ne > 7, "critical").otherwise("ok"), "growth": F.when(oe % 3 == 1, "critical").otherwise("ok"), "old_shape": oe % 4, "shape": ne % 4}, 0.2)
    return x.withColumn("r", r).select("k", F.array_join("r", ",").alias("reasons"), R.decision(F.col("r"), F.col("k") % 2 == 0).alias("decision"))


@query(f"WITH x AS ({EVAL}) SELECT k, coalesce(ne > 8, false) OR coalesce(abs(nd - od) > 0.15, false) AS failed FROM x")
def q11_verify_gate(spark, d):
    o = table(spark, d, "orders")
    side = lambda r, c: F.when(F.col("o_orderkey") % 2 == r, c)
    x = o.groupBy(F.col("o_custkey").alias("k")).agg((F.avg(side(0, F.col("o_totalprice"))) / 1e5).alias("od"), (F.avg(side(1, F.col("o_totalprice"))) / 1e5).alias("nd"), F.count(side(1, F.lit(1))).alias("ne"))
    return x.select("k", R.gate_fails(F.when(F.col("ne") > 8, "critical").otherwise("drift"), F.col("nd"), F.when(F.col("k") % 5 != 0, F.col("od"))).alias("failed"))


@query(f"{DEGREES}, l AS (SELECT layer, sum(n_out) AS used FROM dg JOIN nd ON nd.level = dg.level AND nd.id = dg.id WHERE dg.level = 'file' GROUP BY 1), s AS (SELECT layer, CASE layer WHEN 'api' THEN NULL WHEN 'core' THEN used ELSE used * 1.1 END AS b, used FROM l), t AS (SELECT layer, used, CASE WHEN b IS NULL THEN 'unbudgeted' WHEN used / b >= 1 THEN 'critical' WHEN used / b >= 0.85 THEN 'warning' ELSE 'ok' END AS st FROM s) SELECT count(*) AS layers, arg_max(st, CASE st WHEN 'critical' THEN 3 WHEN 'warning' THEN 2 WHEN 'ok' THEN 1 ELSE 0 END) AS status FROM t")
def c12_worst_capacity(spark, d):
    nodes, edges = levels(spark, d, ["file"])
    l = G.level_degrees(nodes, edges).join(nodes, ["level", "id"]).groupBy("layer").agg(F.sum("n_out").alias("used"))
    budget = F.when(F.col("layer") == "api", F.lit(None).cast("double")).when(F.col("layer") == "core", F.col("used").cast("double")).otherwise(F.col("used") * 1.1)
    return l.withColumn("st", R.capacity_status(F.col("used"), budget)).agg(F.count(F.lit(1)).alias("layers"), R.worst(F.col("st")).alias("status"))


@query("WITH p AS (SELECT date_trunc('day', ts) AS day, count(*) AS edges FROM events GROUP BY 1), x AS (SELECT day, edges, lag(edges) OVER (ORDER BY day) AS b, date_diff('second', lag(day) OVER (ORDER BY day), day) / 3600.0 AS h, row_number() OVER (ORDER BY day DESC) AS k FROM p) SELECT edges - b AS delta, floor((edges - b) / h * 1e6 + 0.5) / 1e6 AS per_hour, floor((edges - b) / h * 24 * 1e6 + 0.5) / 1e6 AS per_day FROM x WHERE k = 1")
def w1_st4_latest_growth(spark, d):
    p = table(spark, d, "events").groupBy(F.date_trunc("day", "ts").alias("day")).agg(F.count(F.lit(1)).alias("edges")).withColumn("level", F.lit("all"))
    last = R.growth(p, "level", "day", "edges").groupBy("level").agg(F.max_by(F.struct("delta", "per_hour"), "day").alias("r"))
    return last.select("r.delta", r6(F.col("r.per_hour")).alias("per_hour"), r6(F.col("r.per_hour") * 24).alias("per_day"))


#: A node's place in a breadth-first walk is that of its least path among the shortest.
WALK = f"""WITH RECURSIVE {LEVELS[5:]}, o AS MATERIALIZED (SELECT src, dst FROM ed WHERE level = 'file'), wk(id, depth, path) AS (SELECT min(src), 0, [min(src)] FROM o UNION ALL SELECT o.dst, wk.depth + 1, list_append(min(wk.path), o.dst) FROM wk JOIN o ON o.src = wk.id WHERE wk.depth < 19 GROUP BY o.dst, wk.depth),
fs AS (SELECT id, min(depth) AS depth, arg_min(path, depth) AS path FROM wk GROUP BY id), rk AS (SELECT *, row_number() OVER (ORDER BY depth, path) AS k FROM fs)"""


@query(f"{WALK} SELECT path[-2] AS src, id AS dst, (k - 2)::INTEGER AS ord FROM rk WHERE k BETWEEN 2 AND 20")
def r15_bounded_walk(spark, d):
    """The first twenty files that a breadth-first walk over imports reaches from the first file."""
    _, edges = levels(spark, d, ["file"])
    return G.walked_tree(edges, edges.agg(F.min("src")).first()[0], 20)


@query(f"{LEVELS} SELECT src, dst FROM ed WHERE level = 'module' AND src <> dst ORDER BY src, dst LIMIT 10")
def r11_t11_cross_module_edges(spark, d):
    _, edges = levels(spark, d, ["module"])
    return edges.filter("src <> dst").select("src", "dst").distinct().orderBy("src", "dst").limit(10)


WORDS = "list_distinct(list_filter(regexp_split_to_array(regexp_replace(lower(method || ' ' || path), '[^a-z0-9/]+', ' ', 'g'), '[/ ]+'), lambda t: t <> ''))"
OVER = "len(list_intersect(a.{0}, b.{0})) / (len(a.{0}) + len(b.{0}) - len(list_intersect(a.{0}, b.{0})))::DOUBLE"


@query(f"""{DRIFT}, {SETS}, ew AS (SELECT eid, method || ' ' || path AS name, {WORDS} AS t FROM endpoints), rel AS (SELECT a.eid AS a, b.eid AS b, a.name AS na, b.name AS nb, floor({OVER.format('t')} * 100 + 0.5) / 100 AS s FROM ew a JOIN ew b ON a.eid < b.eid WHERE {OVER.format('t')} >= 0.8 ORDER BY 1, 2 LIMIT 20),
sim AS (SELECT a.fid AS a, b.fid AS b, floor({OVER.format('k')} * 1000 + 0.5) / 1000 AS s FROM x a JOIN x b ON a.fid < b.fid AND abs(floor(a.size / 10) - floor(b.size / 10)) <= 1 AND a.h <> b.h WHERE {OVER.format('k')} >= 0.8 ORDER BY 3 DESC, 1, 2 LIMIT 20),
dup AS (SELECT sha1(text) AS hash, count(*) AS n, max(length(text)) AS size FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 1 ORDER BY size DESC, n DESC, hash LIMIT 20)
SELECT 'duplicate' AS section, row_number() OVER (ORDER BY size DESC, n DESC, hash)::INTEGER AS ord, hash || ':' || n || ':' || size AS item FROM dup UNION ALL SELECT 'similar', row_number() OVER (ORDER BY s DESC, a, b), a || ':' || b || ':' || printf('%.3f', s) FROM sim UNION ALL SELECT 'related_endpoints', row_number() OVER (ORDER BY a, b), na || ' ~ ' || nb || ' ~ ' || printf('%.3f', s) FROM rel
UNION ALL SELECT 'cycle_risk', 0, id FROM cyc WHERE level = 'module' UNION ALL SELECT 'module', 0, id FROM modules UNION ALL SELECT DISTINCT 'endpoint', 0, name FROM ew UNION ALL SELECT 'model', 0, name FROM models UNION ALL SELECT DISTINCT 'cross_layer', 0, src || ' -> ' || dst FROM ed LEFT JOIN nd p ON p.level = 'module' AND p.id = src LEFT JOIN nd q ON q.level = 'module' AND q.id = dst LEFT JOIN al ON al.a = p.layer AND al.b = q.layer WHERE ed.level = 'module' AND al.a IS NULL
UNION ALL SELECT 'status', 0, status FROM rp WHERE level = 'module'""")
def q8_constraints_packet(spark, d):
    nodes, edges = levels(spark, d, ["module"])
    docs = table(spark, d, "documents").filter("text is not null")
    duplicates = docs.groupBy(F.sha1("text").alias("hash")).agg(F.count(F.lit(1)).alias("n"), F.max(F.length("text")).alias("size")).filter("n > 1")
    cross = G.level_cross(nodes, edges, spark.createDataFrame(ALLOWED, "a string, b string")).filter("cross = 1").select("src", "dst")
    status = R.primary_level(drift(spark, d)).select("status")
    e = fact(spark, d, "endpoints").select("eid", F.concat_ws(" ", "method", "path").alias("name"))
    return X.constraints_packet(G.level_cycles(edges).select("id"), duplicates, C.similar_structure(structures(spark, d), 0.8, first=20), e, fact(spark, d, "modules").select("id"), fact(spark, d, "models").select("name"), cross, status)
