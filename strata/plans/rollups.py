"""Queries of the roll-ups that reports are made of, each beside the SQL that it must equal."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from strata.functions import text as T
from strata.operators import facts as X

from .catalogue import query, table
from .code import PC, KEYS, X3
from .codebase import WITH, fact

MODS = "mods AS (SELECT id, path FROM modules UNION ALL SELECT 'deep-' || id, path || '/api' FROM modules)"
PART = "CASE WHEN contains(substr({0}, length('backend/' || module) + 2), '/') THEN split_part(substr({0}, length('backend/' || module) + 2), '/', 1) ELSE 'root' END"


@query(f"{WITH}, {MODS} SELECT f.path, (SELECT arg_max(m.id, length(m.path)) FROM mods m WHERE starts_with(f.path, m.path || '/')) AS id FROM files f")
def r1_longest_module(spark, d):
    m = fact(spark, d, "modules")
    deep = m.select(F.concat(F.lit("deep-"), "id").alias("id"), F.concat("path", F.lit("/api")).alias("module_path"))
    return X.longest_module(fact(spark, d, "files").select("path"), "path", m.select("id", F.col("path").alias("module_path")).unionByName(deep), "module_path").select("path", "id")


def parts(spark, d):
    part = lambda file: X.subsystem(F.concat(F.lit("backend/"), "module"), F.col(file)).alias("part")
    f, e = fact(spark, d, "files"), fact(spark, d, "endpoints")
    home = f.select(F.col("path").alias("file"), "module")
    return f.select("module", part("path")), e.select("eid", "module", part("file")), fact(spark, d, "models").join(home, "file").select("name", "file", "module", part("file"))


MODELS = f"mo AS (SELECT name, file, f.module, {PART.format('file')} AS part FROM models JOIN files f ON f.path = file), ep AS (SELECT eid, module, {PART.format('file')} AS part FROM endpoints)"


@query(f"{WITH}, {MODELS}, a AS (SELECT module, {PART.format('path')} AS part, 1 AS f, 0 AS e, 0 AS m FROM files UNION ALL SELECT module, part, 0, 1, 0 FROM ep UNION ALL SELECT module, part, 0, 0, 1 FROM mo) SELECT module, part, sum(f)::BIGINT AS files, sum(e)::BIGINT AS endpoints, sum(m)::BIGINT AS models FROM a GROUP BY 1, 2")
def r2_subsystems(spark, d):
    return X.subsystem_counts(*parts(spark, d))


@query(f"{WITH}, {MODELS}, x AS (SELECT e.module, e.part AS src, m.part AS dst, bool_or(access IN ('read', 'read_write')) AS r, bool_or(access IN ('write', 'read_write')) AS w FROM uses u JOIN ep e ON e.eid = u.eid JOIN mo m ON m.name = u.model WHERE e.part <> m.part GROUP BY 1, 2, 3) SELECT module, src, dst, CASE WHEN r AND w THEN 'read/write' WHEN w THEN 'write' ELSE 'read' END AS label FROM x")
def r3_access_edges(spark, d):
    _, e, m = parts(spark, d)
    u = fact(spark, d, "uses").join(e.select("eid", "module", F.col("part").alias("src")), "eid").join(m.select(F.col("name").alias("model"), F.col("part").alias("dst")), "model")
    return X.access_edges(u)


@query(f"{WITH}, {MODELS} SELECT module || '/' || part AS grp, count(*) AS models, count(DISTINCT file) AS files FROM mo GROUP BY 1")
def r4_data_domains(spark, d):
    return parts(spark, d)[2].groupBy(F.concat_ws("/", "module", "part").alias("grp")).agg(F.count(F.lit(1)).alias("models"), F.count_distinct("file").alias("files"))


@query("WITH p AS (SELECT date_trunc('day', ts) AS day, count(*) AS n, avg(event_id % 97) AS delta FROM events GROUP BY 1), l AS (SELECT *, row_number() OVER (ORDER BY day DESC) AS k FROM p) SELECT strftime(day, '%Y-%m-%d') AS day, floor(delta * 1000 + 0.5) / 1000 AS delta FROM l WHERE k <= 20")
def r5_trend(spark, d):
    p = table(spark, d, "events").groupBy(F.date_trunc("day", "ts").alias("day")).agg(F.avg(F.col("event_id") % 97).alias("delta"))
    return p.orderBy(F.desc("day")).limit(20).select(F.date_format("day", "yyyy-MM-dd").alias("day"), T.half_up(F.col("delta"), 3).alias("delta"))


@query(f"{WITH}, e AS (SELECT eid, '/api/v1' AS domain FROM endpoints), u AS (SELECT eid, count(DISTINCT model) AS n FROM uses GROUP BY 1) SELECT domain, count(*) AS endpoints, coalesce(sum(n), 0)::BIGINT AS models FROM e LEFT JOIN u USING (eid) GROUP BY 1")
def r6_integration_domains(spark, d):
    u = fact(spark, d, "uses").groupBy("eid").agg(F.count_distinct("model").alias("n"))
    e = fact(spark, d, "endpoints").select("eid", T.integration_domain(F.col("path")).alias("domain")).join(u, "eid", "left")
    return e.groupBy("domain").agg(F.count(F.lit(1)).alias("endpoints"), F.coalesce(F.sum("n"), F.lit(0)).alias("models"))


@query("WITH x AS (SELECT o_custkey % 20 AS k, CASE o_orderstatus WHEN 'F' THEN 'ok' WHEN 'O' THEN 'mismatched' ELSE 'unverified' END AS status FROM orders) SELECT k, count(CASE WHEN status IN ('ok', 'mismatched') THEN 1 END) AS verified, count(CASE WHEN status = 'mismatched' THEN 1 END) AS mismatched, count(CASE WHEN status = 'unverified' THEN 1 END) AS unverified FROM x GROUP BY 1")
def r7_contract_counts(spark, d):
    s = F.when(F.col("o_orderstatus") == "F", "ok").when(F.col("o_orderstatus") == "O", "mismatched").otherwise("unverified")
    x = table(spark, d, "orders").select((F.col("o_custkey") % 20).alias("k"), s.alias("status"))
    n = lambda *v: F.count(F.when(F.col("status").isin(*v), 1))
    return x.groupBy("k").agg(n("ok", "mismatched").alias("verified"), n("mismatched").alias("mismatched"), n("unverified").alias("unverified"))


@query(f"{WITH}, m AS (SELECT DISTINCT module, unit % 3 AS t FROM files), p AS (SELECT module AS id, CASE t WHEN 0 THEN 'backend/' || module || '/x' WHEN 1 THEN 'backend/src/core' ELSE 'src' END AS path FROM m) SELECT CASE WHEN contains(path, 'service-') THEN id WHEN contains(path, 'core') THEN 'core' ELSE id END AS grp, string_agg(DISTINCT id, ',' ORDER BY id) AS modules FROM p GROUP BY 1")
def r8_module_groups(spark, d):
    m = fact(spark, d, "files").select(F.col("module").alias("id"), (F.col("unit") % 3).alias("t")).distinct()
    path = F.when(F.col("t") == 0, F.concat(F.lit("backend/"), "id", F.lit("/x"))).when(F.col("t") == 1, "backend/src/core").otherwise("src")
    return m.groupBy(X.human_group(path, F.col("id")).alias("grp")).agg(F.array_join(F.array_sort(F.collect_set("id")), ",").alias("modules"))


@query(f"{WITH} SELECT file, count(*) AS tests FROM (SELECT caller_file AS file FROM fn_calls WHERE contains(caller_file, 'test_')) GROUP BY 1 ORDER BY tests DESC, file LIMIT 5")
def r9_tests_per_file(spark, d):
    t = fact(spark, d, "fn_calls").filter(F.col("caller_file").contains("test_"))
    return t.groupBy(F.col("caller_file").alias("file")).agg(F.count(F.lit(1)).alias("tests")).orderBy(F.desc("tests"), "file").limit(5)


@query(f"{WITH} SELECT count(CASE WHEN framework <> 'pydantic' THEN 1 END) AS orm, count(CASE WHEN framework = 'pydantic' THEN 1 END) AS schemas FROM models")
def r10_orm_split(spark, d):
    return fact(spark, d, "models").agg(F.count(F.when(F.col("framework") != "pydantic", 1)).alias("orm"), F.count(F.when(F.col("framework") == "pydantic", 1)).alias("schemas"))


TASKS = "ts AS (SELECT CASE unit % 4 WHEN 0 THEN 'jobs.send_task' WHEN 1 THEN 'mail.send' WHEN 2 THEN 'Payments' ELSE 'jobs.x' END AS name, path AS file FROM files WHERE fid % 7 = 0)"


def tasks(spark, d):
    k = F.col("unit") % 4
    return fact(spark, d, "files").filter("fid % 7 = 0").select(F.when(k == 0, "jobs.send_task").when(k == 1, "mail.send").when(k == 2, "Payments").otherwise("jobs.x").alias("name"), F.col("path").alias("file"))


@query(f"{WITH}, {TASKS} SELECT name, string_agg(DISTINCT file, ',' ORDER BY file) AS sources FROM ts GROUP BY 1")
def r12_tasks(spark, d):
    return tasks(spark, d).groupBy("name").agg(F.array_join(F.array_sort(F.collect_set("file")), ",").alias("sources"))


@query(f"{WITH}, {TASKS}, t AS (SELECT DISTINCT name, regexp_replace(name, '^[^.]+[.]', '') AS bare FROM ts) SELECT DISTINCT name AS task, eid FROM t JOIN calls ON call = name OR call = bare OR ends_with(call, '.' || bare)")
def r13_task_triggers(spark, d):
    return X.triggered_tasks(tasks(spark, d).select("name").distinct(), fact(spark, d, "calls"))


@query(f"""{WITH}, n AS (SELECT eid, count(*) AS n_calls FROM calls GROUP BY 1 HAVING count(*) > 2), t AS (SELECT eid, method, n_calls FROM endpoints JOIN n USING (eid) WHERE path <> '/health' ORDER BY n_calls DESC, eid LIMIT 8), a AS (SELECT eid, CASE WHEN contains(call, '.') THEN split_part(call, '.', 1) ELSE 'Service' END AS actor, min(k) AS k FROM calls JOIN t USING (eid) WHERE call <> 'str' GROUP BY 1, 2)
SELECT eid, any_value(n_calls) AS n_calls, string_agg(actor, ',' ORDER BY k) AS actors, any_value(method) = 'POST' AND count(*) >= 3 AS important FROM a JOIN t USING (eid) GROUP BY 1""")
def r16_workflows(spark, d):
    x = X.workflow_candidates(fact(spark, d, "endpoints"), fact(spark, d, "calls"))
    return x.select("eid", "n_calls", F.array_join("actors", ",").alias("actors"), "important")


@query(f"{WITH}, im AS (SELECT model AS name, 'app.m' || (eid % 4) AS specifier FROM uses WHERE eid % 3 <> 0), bs AS (SELECT name, specifier, row_number() OVER (PARTITION BY name ORDER BY count(*) DESC, specifier) AS k FROM im GROUP BY 1, 2) SELECT m.name, 'from ' || coalesce(specifier, replace(regexp_replace(file, '[.]py$', ''), '/', '.')) || ' import ' || m.name AS statement FROM models m LEFT JOIN bs ON bs.name = m.name AND k = 1")
def r20_import_statements(spark, d):
    im = fact(spark, d, "uses").filter("eid % 3 <> 0").select(F.col("model").alias("name"), F.concat(F.lit("app.m"), (F.col("eid") % 4).cast("string")).alias("specifier"))
    return X.import_statements(fact(spark, d, "models").select("name", "file"), im)


@query(f"{WITH}, n AS (SELECT name, count(*) AS n FROM (SELECT request_schema AS name FROM endpoints UNION ALL SELECT response_schema FROM endpoints) WHERE name IS NOT NULL GROUP BY 1), f AS (SELECT name, count(*) AS f FROM fields GROUP BY 1) SELECT m.name, coalesce(n, 0) * 3 + least(f, 8) AS score FROM models m LEFT JOIN n USING (name) LEFT JOIN f USING (name) WHERE framework = 'pydantic' ORDER BY score DESC, m.name LIMIT 5")
def c16_top_schemas(spark, d):
    n = fact(spark, d, "endpoints").select(F.explode(F.array_compact(F.array("request_schema", "response_schema"))).alias("name")).groupBy("name").agg(F.count(F.lit(1)).alias("n"))
    f = fact(spark, d, "fields").groupBy("name").agg(F.count(F.lit(1)).alias("f"))
    x = fact(spark, d, "models").filter("framework = 'pydantic'").join(n, "name", "left").join(f, "name", "left").fillna(0, ["n"])
    return x.select("name", (F.col("n") * 3 + F.least("f", F.lit(8))).alias("score")).orderBy(F.desc("score"), "name").limit(5)


@query(f"{PC}{KEYS}{X3} SELECT 'unused' AS status, CAST(eid AS STRING) AS id FROM endpoints WHERE eid NOT IN (SELECT eid FROM mt) UNION ALL SELECT 'unmatched', m || ' ' || p FROM ky WHERE (m, p) NOT IN (SELECT (m, p) FROM mt)")
def c3_contract_gaps(spark, d):
    from strata.operators import code as C

    e, k = fact(spark, d, "endpoints"), C.with_key(fact(spark, d, "page_calls")).select("m", "p").distinct()
    hit = C.matched_endpoints(k, e)
    unused = e.join(hit.select("eid").distinct(), "eid", "left_anti").select(F.lit("unused").alias("status"), F.col("eid").cast("string").alias("id"))
    return unused.unionByName(k.join(hit.select("m", "p").distinct(), ["m", "p"], "left_anti").select(F.lit("unmatched").alias("status"), F.concat_ws(" ", "m", "p").alias("id")))


@query(f"{WITH}, b AS (SELECT file, max(line) AS best, count(*) AS n FROM functions WHERE contains(lower(name), 'load') OR contains(lower(name), 'save') GROUP BY 1), t AS (SELECT * FROM b ORDER BY best DESC, file LIMIT 15), k AS (SELECT f.file, f.name, row_number() OVER (PARTITION BY f.file ORDER BY f.name) AS k FROM functions f JOIN t USING (file)) SELECT file, any_value(best) AS best, string_agg(name, ',' ORDER BY name) AS symbols FROM k JOIN t USING (file) WHERE k <= 6 GROUP BY 1")
def t3_compact_hits(spark, d):
    f = fact(spark, d, "functions")
    b = f.filter(F.lower("name").rlike("load|save")).groupBy("file").agg(F.max("line").alias("best")).orderBy(F.desc("best"), "file").limit(15)
    k = f.join(F.broadcast(b), "file").withColumn("k", F.row_number().over(Window.partitionBy("file").orderBy("name"))).filter("k <= 6")
    return k.groupBy("file").agg(F.max("best").alias("best"), F.array_join(F.array_sort(F.collect_list("name")), ",").alias("symbols"))
