"""Queries of joins and roll-ups over the code base's facts, each beside the SQL that it must equal."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from strata.functions import text as T
from strata.operators import code as C
from strata.operators import facts as X
from strata.operators import sessions as P

from .catalogue import query, table
from .codebase import PATTERN, WITH, fact

PC = f"{WITH}, pc AS (SELECT page, CASE WHEN method = '' THEN 'GET' ELSE upper(method) END AS m, {PATTERN.format('path')} AS p, field, CAST(substr(page, 6) AS BIGINT) AS ord, path FROM page_calls), ee AS (SELECT *, upper(method) AS em, {PATTERN.format('path')} AS ep FROM endpoints)"
KEYS = ", ky AS (SELECT m, p, min(ord) AS ord FROM pc GROUP BY 1, 2), x1 AS (SELECT m, p, eid FROM ky JOIN ee ON em = m AND ep = p), x2 AS (SELECT m, p, eid FROM ky JOIN ee ON em = 'ANY' AND ep = p WHERE (m, p) NOT IN (SELECT (m, p) FROM x1))"
X3 = ", x3 AS (SELECT m, p, eid FROM ky JOIN ee ON em IN ('ANY', m) AND (ends_with(p, ep) OR ends_with(ep, p)) WHERE (m, p) NOT IN (SELECT (m, p) FROM x1 UNION ALL SELECT (m, p) FROM x2)), mt AS (SELECT * FROM x1 UNION ALL SELECT * FROM x2 UNION ALL SELECT * FROM x3)"


def page_calls(spark, d):
    return fact(spark, d, "page_calls").withColumn("ord", F.substring("page", 6, 20).cast("long"))


@query(f"{WITH} SELECT src AS file, dst AS target FROM file_deps")
def j9_import_resolution(spark, d):
    e = fact(spark, d, "file_deps")
    up = F.array_join(F.transform(F.sequence(F.lit(2), F.size(F.split("src", "/"))), lambda i: F.lit("..")), "/")
    spec = F.concat(up, F.lit("/./"), F.regexp_replace("dst", r"\.[a-z]+$", ""))
    return C.resolved_imports(e.select(F.col("src").alias("file"), spec.alias("spec")), fact(spark, d, "files")).select("file", "target")


MODULE_EDGES = f"{WITH}, me AS (SELECT DISTINCT a.module AS from_module, b.module AS to_module, e.src AS file FROM file_deps e JOIN files a ON a.path = e.src JOIN files b ON b.path = e.dst WHERE a.module <> b.module)"


def module_edges(spark, d):
    return C.module_edges(fact(spark, d, "file_deps"), fact(spark, d, "files"))


@query(f"{MODULE_EDGES} SELECT * FROM me")
def j10_module_edges(spark, d):
    return module_edges(spark, d)


@query(f"{WITH} SELECT e.eid, u.model, u.access FROM endpoints e JOIN (SELECT handler, file, model, access FROM uses JOIN endpoints USING (eid)) u ON u.handler = e.handler AND u.file = e.file")
def j11_model_access(spark, d):
    e = fact(spark, d, "endpoints").select("eid", "handler", "file")
    usage = fact(spark, d, "uses").join(e, "eid").select("handler", "file", "model", "access")
    return e.join(usage, ["handler", "file"]).select("eid", "model", "access")


@query(f"{WITH} SELECT DISTINCT eid, name FROM calls JOIN models ON regexp_matches(call, '\\b' || name || '\\b')")
def j12_names_in_text(spark, d):
    return C.names_in_text(fact(spark, d, "calls"), "eid", "call", fact(spark, d, "models"))


@query(f"{PC}{KEYS}{X3} SELECT * FROM mt")
def j13_j14_matched_endpoints(spark, d):
    return C.matched_endpoints(C.with_key(page_calls(spark, d)), fact(spark, d, "endpoints"))


@query(f"""{PC}{KEYS}{X3}, fg AS (SELECT eid, m, p FROM (SELECT mt.*, row_number() OVER (PARTITION BY eid ORDER BY ord, m, p) AS k FROM mt JOIN ky USING (m, p)) WHERE k = 1),
s AS (SELECT eid, coalesce(list_sort(list(DISTINCT field) FILTER (field IS NOT NULL)), []) AS sent, list_sort(list(DISTINCT page)) AS callers FROM fg JOIN pc USING (m, p) GROUP BY eid),
h AS (SELECT name, list_sort(list(DISTINCT field)) AS known FROM fields GROUP BY 1),
x AS (SELECT eid, request_schema AS rq, response_schema AS rs, sent, callers, known, coalesce(known, []) AS have FROM s JOIN endpoints USING (eid) LEFT JOIN h ON name = request_schema),
y AS (SELECT *, list_concat(list_concat(CASE WHEN rq IS NOT NULL AND known IS NULL THEN ['backend request schema ''' || rq || ''' not extracted'] ELSE [] END, CASE WHEN len(have) > 0 AND len(sent) = 0 THEN ['frontend request fields not inferred'] ELSE [] END),
CASE WHEN len(have) > 0 AND len(sent) > 0 THEN list_concat(list_transform(list_filter(have, lambda f: NOT list_contains(sent, f)), lambda f: 'frontend missing field ''' || f || ''''), list_transform(list_filter(sent, lambda f: NOT list_contains(have, f)), lambda f: 'frontend extra field ''' || f || '''')) ELSE [] END) AS issues FROM x)
SELECT eid, CASE WHEN len(list_filter(issues, lambda i: starts_with(i, 'frontend'))) > 0 THEN 'mismatched' WHEN (rq IS NOT NULL OR rs IS NOT NULL OR len(sent) > 0) AND NOT (len(have) > 0 AND len(issues) = 0) THEN 'unverified' ELSE 'ok' END AS status,
array_to_string(issues, '|') AS issues, array_to_string(callers, ',') AS callers FROM y""")
def c2_j15_contracts(spark, d):
    x = C.contracts(page_calls(spark, d), fact(spark, d, "endpoints"), fact(spark, d, "fields"))
    return x.select("eid", "status", F.array_join("issues", "|").alias("issues"), F.array_join("callers", ",").alias("callers"))


@query(f"{PC}{KEYS}, mt AS (SELECT * FROM x1 UNION ALL SELECT * FROM x2), us AS (SELECT eid, string_agg(DISTINCT model, ',' ORDER BY model) AS models FROM uses GROUP BY 1) SELECT DISTINCT page, eid, coalesce(models, '') AS models FROM pc JOIN mt USING (m, p) LEFT JOIN us USING (eid)")
def c4_j16_data_flows(spark, d):
    x = C.data_flows(page_calls(spark, d), fact(spark, d, "endpoints"), fact(spark, d, "uses"))
    return x.select("page", "eid", F.array_join("models", ",").alias("models"))


COVER = f"""{WITH}, tf AS (SELECT path AS test_file, regexp_replace(regexp_extract(path, '[^/]*$'), '^test_', '') AS name, regexp_replace(regexp_extract(path, '^(.*)/[^/]*$', 1), '/tests?(/|$)', '/') AS home FROM files WHERE contains(path, 'test_')),
sf AS (SELECT path AS source_file, fid, regexp_extract(path, '[^/]*$') AS name, regexp_extract(path, '^(.*)/[^/]*$', 1) AS dir FROM files WHERE NOT contains(path, 'test_')),
cm AS (SELECT test_file, coalesce(arg_min(source_file, fid) FILTER (home = dir), arg_max(source_file, fid)) AS source_file, CASE WHEN count(CASE WHEN home = dir THEN 1 END) > 0 THEN 'exact' WHEN count(source_file) > 0 THEN 'implicit' ELSE 'none' END AS match_type FROM tf LEFT JOIN sf USING (name) GROUP BY 1)"""


def coverage(spark, d):
    return C.tested_sources(fact(spark, d, "files").select("path", F.col("fid").alias("ord")))


@query(f"{COVER} SELECT * FROM cm")
def c5_j18_test_coverage(spark, d):
    return coverage(spark, d)


@query(f"{COVER}, t AS (SELECT source_file, string_agg(test_file, ',' ORDER BY test_file) AS tests FROM cm GROUP BY 1) SELECT fid, tests IS NOT NULL AS covered, CASE WHEN tests IS NULL THEN 'none' ELSE 'file' END AS coverage_type, coalesce(tests, '') AS tests FROM functions LEFT JOIN t ON source_file = file")
def c6_j17_function_coverage(spark, d):
    x = C.with_tests(fact(spark, d, "functions").select("fid", "file"), "file", coverage(spark, d))
    return x.select("fid", "covered", "coverage_type", F.array_join("test_files", ",").alias("tests"))


@query(f"{WITH}, r AS (SELECT path, module AS body FROM files UNION ALL SELECT substr(path, 9), handler FROM (SELECT file AS path, handler FROM endpoints) WHERE length(path) > 0), s AS (SELECT path, body || CASE WHEN x.h IS NULL THEN '' ELSE ' ' || x.h END AS body FROM files f JOIN (SELECT path AS pp, module AS body FROM files) b ON b.pp = f.path LEFT JOIN (SELECT file, handler AS h FROM endpoints) x ON x.file = f.path) SELECT path, body FROM s")
def j23_f11_suffix_merge(spark, d):
    long = fact(spark, d, "files").select("path", F.col("module").alias("body"))
    short = fact(spark, d, "endpoints").select(F.substring("file", 9, 1 << 20).alias("path"), F.col("handler").alias("body"))
    return C.merged_suffixes(long.unionByName(short), "path", "body")


@query(f"{WITH} SELECT coalesce(field, 'none') AS component, string_agg(DISTINCT page, ',' ORDER BY page) AS pages FROM page_calls GROUP BY 1")
def j24_component_pages(spark, d):
    x = fact(spark, d, "page_calls").select("page", F.explode(F.array(F.coalesce("field", F.lit("none")))).alias("component"))
    return x.groupBy("component").agg(F.array_join(F.array_sort(F.collect_set("page")), ",").alias("pages"))


@query(f"{WITH}, hm AS (SELECT name, arg_min(m.id, m.id) AS to_module FROM models o JOIN modules m ON starts_with(o.file, m.path || '/') GROUP BY 1) SELECT DISTINCT module AS from_module, to_module, name AS label FROM calls JOIN endpoints USING (eid) JOIN hm ON name = split_part(call, '.', 1) WHERE module <> to_module")
def j25_service_edges(spark, d):
    return C.service_edges(*(fact(spark, d, x) for x in ("models", "modules", "endpoints", "calls")))


SVC = "CASE WHEN regexp_matches(call, '^[A-Z][a-zA-Z]{3,}[.]') THEN regexp_extract(call, '^([A-Z][a-zA-Z]{3,})[.]', 1) WHEN regexp_matches(call, '^[A-Z][a-zA-Z]{4,}$') THEN call END"


@query(f"{WITH}, sv AS (SELECT eid, {SVC} AS s FROM calls), o AS (SELECT s, count(*) AS c FROM sv WHERE s IS NOT NULL GROUP BY 1), e AS (SELECT eid, module, regexp_extract(path, '^/api/v1/([^/]+)', 1) AS domain FROM endpoints), n AS (SELECT module, domain, count(*) AS endpoints FROM e GROUP BY 1, 2), u AS (SELECT DISTINCT module, domain, s FROM e JOIN sv USING (eid) WHERE s IS NOT NULL) SELECT module, domain, any_value(endpoints) AS endpoints, string_agg(s, ',' ORDER BY s) AS services, count(CASE WHEN c > 1 THEN 1 END) AS shared FROM u JOIN n USING (module, domain) JOIN o USING (s) GROUP BY 1, 2")
def a19_module_services(spark, d):
    x = C.module_services(fact(spark, d, "endpoints"), fact(spark, d, "calls"))
    return x.select("module", "domain", "endpoints", F.array_join("services", ",").alias("services"), "shared")


VERIFIED = "vf AS (SELECT DISTINCT eid FROM endpoints WHERE eid % 9 = 0), ai AS (SELECT DISTINCT eid FROM calls WHERE call = 'Payments')"
PAT = f"""{WITH}, {VERIFIED}, rs AS (SELECT regexp_replace(path, '/[{{][^}}]+[}}]$', '') AS r, bool_or(method = 'GET') AND bool_or(method = 'POST') AND bool_or(method IN ('PUT', 'PATCH')) AS p5 FROM endpoints GROUP BY 1),
cl AS (SELECT eid, bool_or(regexp_matches(lower(call), 'task|[.]delay[(]|[.]apply_async|background')) AS p4 FROM calls GROUP BY 1), wr AS (SELECT eid, count(CASE WHEN access IN ('write', 'read_write') THEN 1 END) AS w FROM uses GROUP BY 1),
pt AS (SELECT eid, method || ' ' || path AS name, list_filter([CASE WHEN p4 IS NOT NULL THEN 'P1' END, CASE WHEN regexp_matches(lower(file || handler), 'auth|permission|require_') THEN 'P2' END, CASE WHEN eid IN (SELECT eid FROM ai) THEN 'P3' END, CASE WHEN p4 THEN 'P4' END,
CASE WHEN p5 THEN 'P5' END, CASE WHEN w >= 3 THEN 'P6' END, CASE WHEN eid IN (SELECT eid FROM vf) THEN 'P7' END, CASE WHEN method = 'GET' AND regexp_matches(lower(path || handler), 'list|page|paginate') THEN 'P8' END], lambda x: x IS NOT NULL) AS ps
FROM endpoints JOIN rs ON r = regexp_replace(path, '/[{{][^}}]+[}}]$', '') LEFT JOIN cl USING (eid) LEFT JOIN wr USING (eid))"""


def patterns(spark, d):
    e, c = fact(spark, d, "endpoints"), fact(spark, d, "calls")
    return C.endpoint_patterns(e, c, fact(spark, d, "uses"), c.filter("call = 'Payments'"), e.filter("eid % 9 = 0"))


@query(f"{PAT} SELECT eid, array_to_string(ps, ',') AS patterns FROM pt")
def c7_endpoint_patterns(spark, d):
    return patterns(spark, d).select("eid", F.array_join("patterns", ",").alias("patterns"))


@query(f"{PAT}, u AS (SELECT eid, name, unnest(ps) AS pattern FROM pt), k AS (SELECT *, row_number() OVER (PARTITION BY pattern ORDER BY eid) AS k FROM u) SELECT pattern, count(*) AS occurrences, string_agg(CASE WHEN k <= 3 THEN name END, ',' ORDER BY k) AS examples FROM k GROUP BY 1")
def a16_pattern_registry(spark, d):
    x = C.pattern_registry(patterns(spark, d), fact(spark, d, "endpoints"))
    return x.select("pattern", "occurrences", F.array_join("examples", ",").alias("examples"))


REL = "(contains(t.path, x.file) OR contains(x.file, t.path) OR ends_with(x.file, regexp_extract(t.path, '[^/]*$')))"


@query(f"""{MODULE_EDGES}, t AS (SELECT path, module FROM files WHERE fid <= 24), e AS (SELECT t.path AS target, eid, x.path FROM t JOIN endpoints x ON {REL}), m AS (SELECT t.path AS target, name FROM t JOIN models x ON {REL}),
af AS (SELECT DISTINCT target, eid FROM m JOIN endpoints x ON x.request_schema = name OR x.response_schema = name), dm AS (SELECT DISTINCT t.path AS target, from_module FROM t JOIN me ON to_module = module), pg AS (SELECT DISTINCT target, page FROM e JOIN page_calls c ON contains(c.path, split_part(e.path, '{{', 1))),
n AS (SELECT t.path AS target, (SELECT count(*) FROM e WHERE e.target = t.path) AS endpoints, (SELECT count(*) FROM m WHERE m.target = t.path) AS models, (SELECT count(*) FROM af WHERE af.target = t.path) AS affected, (SELECT count(*) FROM dm WHERE dm.target = t.path) AS modules, (SELECT count(*) FROM pg WHERE pg.target = t.path) AS pages FROM t)
SELECT *, endpoints + affected + modules + pages AS total, CASE WHEN endpoints + affected + modules + pages > 5 THEN 'HIGH' WHEN endpoints + affected + modules + pages > 2 THEN 'MED' ELSE 'LOW' END AS risk FROM n""")
def q5_j19_impact(spark, d):
    f = fact(spark, d, "files").filter("fid <= 24")  # the stated targets
    return C.impact(f, fact(spark, d, "endpoints"), fact(spark, d, "models"), fact(spark, d, "modules"), module_edges(spark, d), fact(spark, d, "page_calls"))


@query(f"""{WITH}, e AS (SELECT *, method || ' ' || path AS key FROM endpoints), own AS (SELECT * FROM e WHERE key IN ('GET /api/v1/res0/{{id}}', 'POST /api/v1/res1', 'PUT /nowhere')), nm AS (SELECT request_schema AS name FROM own UNION SELECT response_schema FROM own UNION SELECT 'Model5'),
mo AS (SELECT name FROM models WHERE name IN (SELECT name FROM nm WHERE name IS NOT NULL)), en AS (SELECT unnest(['Status', 'Kind', 'Session', 'Colour']) AS enum)
SELECT DISTINCT 'declared' AS kind, key AS id FROM own UNION ALL SELECT DISTINCT 'neighbour', key FROM e WHERE key NOT IN (SELECT key FROM own) AND (request_schema IN (SELECT name FROM nm WHERE name IS NOT NULL) OR response_schema IN (SELECT name FROM nm WHERE name IS NOT NULL))
UNION ALL SELECT 'model', name FROM mo UNION ALL SELECT DISTINCT 'enum', enum FROM en JOIN fields ON contains(lower(field), lower(enum)) WHERE name IN (SELECT name FROM mo)""")
def q7_j20_feature_context(spark, d):
    enums = spark.createDataFrame([("Status",), ("Kind",), ("Session",), ("Colour",)], "enum string")
    return C.feature_context(fact(spark, d, "endpoints"), fact(spark, d, "models"), fact(spark, d, "fields"), enums, ["GET /api/v1/res0/{id}", "POST /api/v1/res1", "PUT /nowhere"], ["Model5"])


OLD, NEW = "unit % 11 <> 3", "unit % 13 <> 5"
SNAP = f"{WITH}, sn AS (SELECT unit, kind, item FROM (SELECT eid AS unit, 'endpoints' AS kind, method || ' ' || path AS item FROM endpoints UNION ALL SELECT unit, 'modules', module FROM files UNION ALL SELECT fid, 'files', path FROM files UNION ALL SELECT eid, 'models', model FROM uses)), ol AS (SELECT DISTINCT kind, item FROM sn WHERE {OLD}), nw AS (SELECT DISTINCT kind, item FROM sn WHERE {NEW})"


def snapshots(spark, d):
    e, f, u = fact(spark, d, "endpoints"), fact(spark, d, "files"), fact(spark, d, "uses")
    x = e.select(F.col("eid").alias("unit"), F.lit("endpoints").alias("kind"), F.concat_ws(" ", "method", "path").alias("item")).unionByName(f.select("unit", F.lit("modules").alias("kind"), F.col("module").alias("item")))
    x = x.unionByName(f.select(F.col("fid").alias("unit"), F.lit("files").alias("kind"), F.col("path").alias("item"))).unionByName(u.select(F.col("eid").alias("unit"), F.lit("models").alias("kind"), F.col("model").alias("item")))
    return x.filter(OLD).select("kind", "item").distinct(), x.filter(NEW).select("kind", "item").distinct()


@query(f"{SNAP} SELECT kind, item, 'added' AS change FROM (SELECT * FROM nw EXCEPT SELECT * FROM ol) UNION ALL SELECT kind, item, 'removed' FROM (SELECT * FROM ol EXCEPT SELECT * FROM nw)")
def c8_set_diff(spark, d):
    return C.set_diff(*snapshots(spark, d))


@query(f"{SNAP} SELECT kind, (SELECT count(*) FROM nw WHERE nw.kind = k.kind) - (SELECT count(*) FROM ol WHERE ol.kind = k.kind) AS delta FROM (SELECT DISTINCT kind FROM sn) k")
def c8_count_deltas(spark, d):
    return C.count_deltas(*snapshots(spark, d))


@query(f"{SNAP}, df AS (SELECT kind, item, '+' AS s FROM (SELECT * FROM nw EXCEPT SELECT * FROM ol) UNION ALL SELECT kind, item, '-' FROM (SELECT * FROM ol EXCEPT SELECT * FROM nw)), k AS (SELECT *, row_number() OVER (PARTITION BY kind, s ORDER BY item) AS k FROM df) SELECT kind, s || item AS change FROM k WHERE k <= CASE s WHEN '+' THEN 3 ELSE 2 END ORDER BY s, kind, k LIMIT 6")
def r17_diff_digest(spark, d):
    x = C.set_diff(*snapshots(spark, d)).withColumn("s", F.when(F.col("change") == "added", "+").otherwise("-"))
    k = x.withColumn("k", F.row_number().over(Window.partitionBy("kind", "s").orderBy("item")))
    return k.filter(F.col("k") <= F.when(F.col("s") == "+", 3).otherwise(2)).orderBy("s", "kind", "k").limit(6).select("kind", F.concat("s", "item").alias("change"))


@query(f"""{WITH}, a AS (SELECT method || ' ' || path || '#' || eid AS key, * FROM endpoints WHERE eid % 11 <> 3), sv AS (SELECT eid, list_sort(list(DISTINCT call) FILTER (k > 0)) AS n, list_sort(list(DISTINCT call) FILTER (k < 3)) AS o FROM calls GROUP BY 1),
x AS (SELECT key, CASE WHEN eid % 7 = 1 THEN 'handler: ' || handler || ' → renamed' END AS h, CASE WHEN eid % 4 = 1 AND request_schema IS NOT NULL THEN 'request_schema: ' || request_schema || ' → none' END AS q, list_filter(coalesce(n, []), lambda v: NOT list_contains(coalesce(o, []), v)) AS p, list_filter(coalesce(o, []), lambda v: NOT list_contains(coalesce(n, []), v)) AS m FROM a LEFT JOIN sv USING (eid)),
y AS (SELECT key, list_filter([h, q, CASE WHEN len(p) + len(m) > 0 THEN 'services: +' || CASE WHEN len(p) > 0 THEN array_to_string(p, ', ') ELSE 'none' END || ' -' || CASE WHEN len(m) > 0 THEN array_to_string(m, ', ') ELSE 'none' END END], lambda v: v IS NOT NULL) AS c FROM x)
SELECT key, array_to_string(c, '; ') AS changes FROM y WHERE len(c) > 0""")
def c9_c11_endpoint_changes(spark, d):
    e = fact(spark, d, "endpoints").withColumn("key", F.concat(F.concat_ws(" ", "method", "path"), F.lit("#"), F.col("eid").cast("string")))
    c = fact(spark, d, "calls")
    services = lambda f: c.filter(f).groupBy("eid").agg(F.collect_set("call").alias("services"))
    full = lambda f: e.join(services(f), "eid", "left").withColumn("services", F.coalesce("services", F.array().cast("array<string>")))
    after = full("k > 0").withColumn("handler", F.when(F.col("eid") % 7 == 1, "renamed").otherwise(F.col("handler"))).withColumn("request_schema", F.when(F.col("eid") % 4 != 1, F.col("request_schema")))
    x = C.endpoint_changes(full("k < 3").filter("eid % 11 <> 3"), after, ["handler", "module", "request_schema"])
    return x.select("key", F.array_join("changes", "; ").alias("changes"))


DISC = f"""{WITH}, st AS (SELECT 'endpoints' AS kind, method || ' ' || path AS item, min(eid) AS u, 0 AS n FROM endpoints GROUP BY 1, 2 UNION ALL SELECT 'models', name, mid, count(*) FROM fields GROUP BY 1, 2, 3 UNION ALL SELECT 'tasks', 'task' || mid, mid, 0 FROM models),
o AS (SELECT kind, item, n FROM st WHERE u % 5 <> 1), w AS (SELECT kind, item, n + CASE WHEN kind = 'models' AND u % 4 = 0 THEN 1 ELSE 0 END AS n FROM st WHERE u % 6 <> 2), sp AS (SELECT 'spec' || u AS spec, item AS endpoint FROM st WHERE kind = 'endpoints' AND u % 3 = 0),
ch AS (SELECT CASE WHEN o.item IS NULL THEN 'new_' || w.kind WHEN w.item IS NULL THEN 'removed_' || o.kind WHEN o.kind = 'models' AND o.n <> w.n THEN 'drifted_models' END AS c FROM o FULL OUTER JOIN w ON o.kind = w.kind AND o.item = w.item
UNION ALL SELECT 'untracked_endpoints' FROM w WHERE kind = 'endpoints' AND item NOT IN (SELECT endpoint FROM sp) UNION ALL SELECT 'orphan_specs' FROM (SELECT DISTINCT spec FROM sp WHERE endpoint NOT IN (SELECT item FROM w WHERE kind = 'endpoints'))), cn AS (SELECT c AS finding, count(*) AS n FROM ch WHERE c IS NOT NULL AND c <> 'removed_tasks' GROUP BY 1)"""


def checks(spark, d):
    e, f, m = fact(spark, d, "endpoints"), fact(spark, d, "fields"), fact(spark, d, "models")
    st = e.groupBy(F.lit("endpoints").alias("kind"), F.concat_ws(" ", "method", "path").alias("item")).agg(F.min("eid").alias("u"), F.lit(0).cast("long").alias("n"))
    st = st.unionByName(f.groupBy(F.lit("models").alias("kind"), F.col("name").alias("item"), F.col("mid").alias("u")).agg(F.count(F.lit(1)).alias("n")).select("kind", "item", "u", "n"))
    st = st.unionByName(m.select(F.lit("tasks").alias("kind"), F.concat(F.lit("task"), F.col("mid").cast("string")).alias("item"), F.col("mid").alias("u"), F.lit(0).cast("long").alias("n")))
    after = st.filter("u % 6 <> 2").withColumn("n", F.col("n") + F.when((F.col("kind") == "models") & (F.col("u") % 4 == 0), 1).otherwise(0))
    specs = st.filter("kind = 'endpoints' and u % 3 = 0").select(F.concat(F.lit("spec"), F.col("u").cast("string")).alias("spec"), F.col("item").alias("endpoint"))
    return C.discrepancies(st.filter("u % 5 <> 1"), after, specs)


@query(f'{DISC} SELECT * FROM cn')
def c10_discrepancies(spark, d):
    return checks(spark, d)


@query(f"""{DISC} SELECT sum(CASE WHEN finding <> 'untracked_endpoints' THEN n ELSE 0 END)::BIGINT AS total_issues, bool_or(finding IN ('removed_endpoints', 'removed_models', 'orphan_specs')) AS has_critical FROM cn""")
def c10_summary(spark, d):
    return C.discrepancy_summary(checks(spark, d))


@query(f"{WITH} SELECT m.name, CASE WHEN m.name IN (SELECT request_schema FROM endpoints WHERE request_schema IS NOT NULL) THEN 'API Request' WHEN m.name IN (SELECT response_schema FROM endpoints WHERE response_schema IS NOT NULL) THEN 'API Response' WHEN m.name IN (SELECT name FROM fields WHERE field = 'session_id') THEN 'Session State' WHEN framework <> 'pydantic' THEN 'Database Entity' ELSE '' END AS role FROM models m")
def c14_model_roles(spark, d):
    e = fact(spark, d, "endpoints")
    seen = lambda c, to: e.select(F.col(c).alias("name")).filter("name is not null").distinct().withColumn(to, F.lit(True))
    s = fact(spark, d, "fields").filter("field = 'session_id'").select("name", F.lit(True).alias("s")).distinct()
    x = fact(spark, d, "models").join(seen("request_schema", "rq"), "name", "left").join(seen("response_schema", "rs"), "name", "left").join(s, "name", "left").fillna(False, ["rq", "rs", "s"])
    return x.select("name", C.model_role(F.col("name"), F.col("framework"), F.col("s"), F.col("rq"), F.col("rs")).alias("role"))


@query(f"{WITH}, dg AS (SELECT id, count(*) AS n FROM (SELECT src AS id FROM file_deps UNION ALL SELECT dst FROM file_deps) GROUP BY 1) SELECT id, floor(n / (SELECT max(n) FROM dg)::DOUBLE * 1e6 + 0.5) / 1e6 AS score FROM dg ORDER BY n DESC, id LIMIT 10")
def c17_coupling_files(spark, d):
    return C.coupling_files(fact(spark, d, "file_deps"), 10).select("id", T.half_up(F.col("score"), 6).alias("score"))


@query(f"{WITH} SELECT model, string_agg(DISTINCT method || ' ' || path, ',' ORDER BY method || ' ' || path) AS endpoints FROM uses JOIN endpoints USING (eid) GROUP BY 1")
def c18_model_endpoints(spark, d):
    return C.model_endpoints(fact(spark, d, "uses"), fact(spark, d, "endpoints")).select("model", F.array_join("endpoints", ",").alias("endpoints"))


@query(f"{WITH} SELECT r || '/' || id AS id, r || '/' || path AS path, layer, n_files FROM modules, (VALUES ('one'), ('two')) AS t(r)")
def c19_merged_roots(spark, d):
    m = fact(spark, d, "modules")
    return C.prefixed(m, "one", ["id", "path"]).unionByName(C.prefixed(m, "two", ["id", "path"]))


@query(f"{WITH}, l AS (SELECT fid, file, name, lower(name) AS token FROM functions) SELECT token, file, name AS function, line FROM l JOIN functions f USING (file, name) WHERE contains(token, 'http')")
def j6_literal_hits(spark, d):
    f = fact(spark, d, "functions")
    index = f.select(F.lower("name").alias("token"), "file", F.col("name").alias("function"))
    return index.filter(F.col("token").contains("http")).join(f.select("file", F.col("name").alias("function"), "line"), ["file", "function"]).select("token", "file", "function", "line")


@query("SELECT item_id, text_len, CASE WHEN text_len > 100 THEN 'long' ELSE 'short' END AS kind, max(w) AS best FROM (SELECT item_id, length(text) AS text_len, unnest([0.3::DOUBLE, CASE WHEN contains(text, 'a') THEN 0.8::DOUBLE ELSE 0.1::DOUBLE END]) AS w FROM benchmark) GROUP BY 1, 2")
def a7_best_hit(spark, d):
    x = table(spark, d, "benchmark").select("item_id", F.length("text").cast("long").alias("text_len"), F.explode(F.array(F.lit(0.3), F.when(F.contains("text", F.lit("a")), 0.8).otherwise(0.1))).alias("w"))
    return x.groupBy("item_id", "text_len").agg(F.max("w").alias("best")).withColumn("kind", F.when(F.col("text_len") > 100, "long").otherwise("short"))


@query(f"{WITH} SELECT 'endpoints' AS category, count(*) AS n FROM endpoints UNION ALL SELECT 'models', count(*) FROM models UNION ALL SELECT 'pages', count(DISTINCT page) FROM page_calls UNION ALL SELECT 'modules', count(*) FROM modules")
def a15_category_counts(spark, d):
    n = lambda k, df: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(k).alias("category"), "n")
    return n("endpoints", fact(spark, d, "endpoints")).unionByName(n("models", fact(spark, d, "models"))).unionByName(n("pages", fact(spark, d, "page_calls").select("page").distinct())).unionByName(n("modules", fact(spark, d, "modules")))


def misses(key: str, seconds: int) -> str:
    """The chain of misses of each key: the first call, then the first one at least a TTL after the last miss."""
    return f"WITH RECURSIVE c AS (SELECT {key} AS k, ts, event_type, props FROM events), m(k, ts) AS (SELECT k, min(ts) FROM c GROUP BY k UNION ALL SELECT m.k, min(c.ts) FROM m JOIN c ON c.k = m.k AND c.ts >= m.ts + INTERVAL {seconds} SECOND GROUP BY m.k, m.ts)"


TOKENS = "sum(CAST(ceil(length(props) / 3.5) AS BIGINT))"
METRICS = f"count(*) AS calls, {TOKENS}::BIGINT AS tokens, greatest(0, count(*) * 400 - {TOKENS})::BIGINT AS saved, CAST(floor(greatest(0, count(*) * 400 - {TOKENS}) / (count(*) * 400)::DOUBLE * 100 + 0.5) AS BIGINT) || '%' AS ratio"


def session_calls(spark, d, key, seconds):
    e = table(spark, d, "events").select("event_id", "ts", "event_type", "props")
    return P.cache_hits(e, key, "ts", "event_id", seconds)


@query(f"{misses('(event_type, props)', 30)} SELECT {METRICS}, count(*) - (SELECT count(*) FROM m) AS cache_hits FROM c")
def a14_q6_session_summary(spark, d):
    return P.session_metrics(session_calls(spark, d, ["event_type", "props"], 30), T.token_estimate(F.col("props")).cast("long"), F.col("hit"))


@query(f"{misses('event_type', 1800)} SELECT event_type AS tool, {METRICS}, count(*) - (SELECT count(*) FROM m WHERE m.k = event_type) AS cache_hits FROM c GROUP BY event_type")
def st2_cache_hits_by_tool(spark, d):
    x = session_calls(spark, d, ["event_type"], 1800).withColumnRenamed("event_type", "tool")
    return P.session_metrics(x, T.token_estimate(F.col("props")).cast("long"), F.col("hit"), ["tool"])


@query("SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS k FROM events) WHERE k = 1")
def w4_first_wins(spark, d):
    return C.first_wins(table(spark, d, "events").select("user_id", "event_type", "event_id"), ["user_id", "event_type"], "event_id")


@query("SELECT conv_id, turn, last_value(CASE WHEN role = 'user' THEN text END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS current FROM conversations WHERE conv_id IN (SELECT conv_id FROM conversations GROUP BY conv_id HAVING count(*) = count(DISTINCT turn))")
def w6_carried_forward(spark, d):
    c = table(spark, d, "conversations")
    single = c.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("turn").alias("m")).filter("n = m").select("conv_id")
    x = c.join(single, "conv_id", "left_semi").withColumn("said", F.when(F.col("role") == "user", F.col("text")))
    return C.carried_forward(x, "conv_id", "turn", "said").select("conv_id", "turn", "current")


@query(f"{WITH}, fk AS (SELECT name, mid, split_part(foreign_key, '.', 1) AS tb FROM fields WHERE foreign_key IS NOT NULL), x AS (SELECT f.name, (SELECT m.name FROM models m WHERE starts_with(f.tb, lower(m.name)) ORDER BY m.mid LIMIT 1) AS t FROM fk f) SELECT DISTINCT t AS source, name AS target FROM x WHERE t IS NOT NULL AND t <> name")
def r14_foreign_keys(spark, d):
    return C.foreign_keys(fact(spark, d, "models"), fact(spark, d, "fields"))


@query("""SELECT lang, ceil((floor(sum(n_chars) * 0.4 + 0.5) + floor(count(*) * 1000 * 0.08 + 0.5)) / 3.5)::BIGINT AS answer_tokens, ceil(sum(n_chars) / 3.5)::BIGINT AS raw_tokens, floor(ceil((floor(sum(n_chars) * 0.4 + 0.5) + floor(count(*) * 1000 * 0.08 + 0.5)) / 3.5) / ceil(sum(n_chars) / 3.5) * 1000 + 0.5) / 1000 AS ratio,
greatest(0, ceil(sum(n_chars) / 3.5) - ceil((floor(sum(n_chars) * 0.4 + 0.5) + floor(count(*) * 1000 * 0.08 + 0.5)) / 3.5))::BIGINT AS saved FROM documents GROUP BY 1""")
def b2_token_efficiency(spark, d):
    x = table(spark, d, "documents").groupBy("lang").agg(F.sum("n_chars").alias("c"), (F.count(F.lit(1)) * 1000).alias("i"))
    return x.select("lang", *C.token_efficiency(F.col("c"), F.col("i"), F.col("c")))


PATCH = "'--- a/f' || (s_suppkey % 4) || chr(10) || '+++ b/f' || (s_suppkey % 5) || chr(10) || '+import x' || chr(10) || CASE WHEN s_suppkey % 2 = 0 THEN '-  from y import z' || chr(10) ELSE '+require(a)' || chr(10) END || CASE WHEN s_suppkey % 3 = 0 THEN '--- /dev/null' || chr(10) || '+++ b/new' ELSE ' important' END"


@query("SELECT s_suppkey AS id, CASE WHEN s_suppkey % 3 = 0 THEN 3 ELSE 2 END::BIGINT AS files, CASE WHEN s_suppkey % 2 = 0 THEN 1 ELSE 2 END::BIGINT AS imports_added, CASE WHEN s_suppkey % 2 = 0 THEN 1 ELSE 0 END::BIGINT AS imports_removed, (CASE WHEN s_suppkey % 2 = 0 THEN 0 ELSE 2 END + CASE WHEN s_suppkey % 3 = 0 THEN 1 ELSE 0 END)::BIGINT AS increase FROM supplier")
def b3_patch_drift(spark, d):
    return C.patch_drift(table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.expr(PATCH).alias("patch")))


@query(f"{WITH}, c AS (SELECT unit AS id, 'about handler' || unit || ' and ' || CASE WHEN unit % 2 = 0 THEN 'lib' ELSE 'nothing' END AS text FROM files GROUP BY unit), t AS (SELECT unit AS id, path FROM files), m AS (SELECT DISTINCT id, text, regexp_extract(path, '^(.*)/[^/]*$', 1) AS module FROM t JOIN c USING (id)), f AS (SELECT id, count(CASE WHEN contains(text, regexp_extract(path, '([^/]*)[.][a-z]+$', 1)) THEN 1 END) AS files_mentioned FROM t JOIN c USING (id) GROUP BY 1) SELECT id, floor(avg(CASE WHEN len(list_filter(string_split(module, '/'), lambda s: contains(text, s))) > 0 THEN 1.0 ELSE 0.0 END) * 1000 + 0.5) / 1000 AS coverage, any_value(files_mentioned) AS files_mentioned FROM m JOIN f USING (id) GROUP BY id")
def b4_context_coverage(spark, d):
    f = fact(spark, d, "files")
    text = F.concat(F.lit("about handler"), F.col("unit").cast("string"), F.lit(" and "), F.when(F.col("unit") % 2 == 0, "lib").otherwise("nothing"))
    return C.context_coverage(f.select(F.col("unit").alias("id"), "path"), f.select("unit").distinct().select(F.col("unit").alias("id"), text.alias("text")))


@query("WITH r AS (SELECT o_custkey AS query, o_orderkey AS item, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders), t AS (SELECT o_custkey AS query, o_orderkey AS item FROM orders WHERE o_orderkey % 3 = 0) SELECT query, count(rank) >= ceil(count(*) / 2.0) AS passed FROM t LEFT JOIN (SELECT * FROM r WHERE rank <= 10) r USING (query, item) GROUP BY 1")
def b6_golden(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("query"), F.col("o_orderkey").alias("item"), "o_totalprice")
    ranked = o.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("o_totalprice"), "item")))
    return C.golden(o.filter("item % 3 = 0").select("query", "item"), ranked, 10)


@query("WITH p AS (SELECT o_orderpriority AS metric, (o_orderkey % 17)::DOUBLE AS b, (o_orderkey % 23)::DOUBLE AS g FROM orders) SELECT metric, floor(avg(b) * 1000 + 0.5) / 1000 AS baseline, floor(avg(g) * 1000 + 0.5) / 1000 AS other, floor((avg(g) - avg(b)) * 1000 + 0.5) / 1000 AS delta, floor((avg(g) - avg(b)) / avg(b) * 100 * 10 + 0.5) / 10 AS pct_change FROM p GROUP BY 1")
def b7_paired_summary(spark, d):
    return C.paired_summary(table(spark, d, "orders").select(F.col("o_orderpriority").alias("metric"), (F.col("o_orderkey") % 17).cast("double").alias("b"), (F.col("o_orderkey") % 23).cast("double").alias("g")))
