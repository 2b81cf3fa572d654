"""Queries of diagram edges over the code base's facts, each beside the SQL that it must equal."""

from __future__ import annotations

from pyspark.sql import functions as F

from strata.operators import diagrams as D

from .catalogue import query
from .code import MODULE_EDGES, module_edges
from .codebase import fact

#: Calls of the facts, some renamed to what talks to stores and to others.
SAID = "said AS (SELECT eid, CASE WHEN call = 'db.query' AND eid % 3 = 0 THEN 'conn.fetch' WHEN call = 'Payments' AND eid % 4 <> 0 THEN 'self._proxy_to_openai' WHEN call = 'send_task' AND eid % 5 = 1 THEN 'httpx.AsyncClient.get' ELSE call END AS call FROM calls)"


def said(spark, d):
    call, eid = F.col("call"), F.col("eid")
    renamed = F.when((call == "db.query") & (eid % 3 == 0), "conn.fetch").when((call == "Payments") & (eid % 4 != 0), "self._proxy_to_openai").when((call == "send_task") & (eid % 5 == 1), "httpx.AsyncClient.get")
    return fact(spark, d, "calls").select("eid", F.coalesce(renamed, call).alias("call"))


def imports(spark, d):
    return module_edges(spark, d).select("from_module", "to_module").distinct()


@query(f"""{MODULE_EDGES}, {SAID}, im AS (SELECT DISTINCT from_module, to_module FROM me), sm AS (SELECT eid, module, regexp_replace(split_part(path, '{{', 1), '/$', '') AS stem FROM endpoints), pg AS (SELECT DISTINCT replace(path, '//', '/') AS path FROM page_calls WHERE page < '/page5'), hit AS (SELECT pg.path, arg_min(module, eid) AS module FROM pg JOIN sm ON contains(pg.path, stem) GROUP BY 1),
x AS (SELECT DISTINCT 'Pages' AS src, module AS dst, 'calls' AS kind FROM hit UNION ALL SELECT from_module, to_module, 'imports' FROM im UNION ALL SELECT DISTINCT module, 'Postgres', 'stores' FROM said JOIN endpoints USING (eid) WHERE contains(call, 'db_pool') OR contains(call, 'conn.') UNION ALL SELECT min(module), 'External', 'proxy' FROM said JOIN endpoints USING (eid) WHERE contains(call, '_proxy_to_') HAVING min(module) IS NOT NULL) SELECT * FROM x""")
def c15_system_edges(spark, d):
    """Pages, modules, the data store and what is outside, and what leads where."""
    f = lambda n: fact(spark, d, n)
    calls = f("page_calls").filter("page < '/page5'").select(F.replace("path", F.lit("//"), F.lit("/")).alias("path"))
    return D.system_edges(f("modules").select("id"), imports(spark, d), calls, f("endpoints").select("eid", "path", "module"), said(spark, d))


@query(f"""{MODULE_EDGES}, {SAID}, im AS (SELECT DISTINCT from_module, to_module FROM me), hm AS (SELECT name, min(m.id) AS home FROM models o JOIN modules m ON starts_with(o.file, m.path || '/') GROUP BY 1)
SELECT from_module AS src, to_module AS dst, 'imports' AS label FROM im UNION ALL SELECT DISTINCT module, CASE WHEN contains(call, 'openai') THEN 'LLM Provider' ELSE 'External API' END, 'proxy' FROM said JOIN endpoints USING (eid) WHERE regexp_matches(call, '_proxy_to_|httpx|AsyncClient') UNION ALL SELECT DISTINCT module, home, name FROM said JOIN endpoints USING (eid) JOIN hm ON name = split_part(call, '.', 1) WHERE module <> home""")
def c15_cross_service_edges(spark, d):
    """Imports, calls outside and classes of other modules."""
    f = lambda n: fact(spark, d, n)
    return D.cross_service_edges(f("modules").select("id", "path"), imports(spark, d), f("endpoints").select("eid", "module"), said(spark, d), f("models").select("name", "file"))


@query(f"""{MODULE_EDGES}, sq AS (SELECT name, mid FROM models WHERE framework <> 'pydantic'), fk AS (SELECT name, split_part(foreign_key, '.', 1) AS tb FROM fields JOIN sq USING (name) WHERE foreign_key IS NOT NULL), x AS (SELECT DISTINCT (SELECT m.name FROM sq m WHERE starts_with(f.tb, lower(m.name)) ORDER BY m.mid LIMIT 1) AS source, f.name AS target FROM fk f), e AS (SELECT * FROM x WHERE source IS NOT NULL AND source <> target),
kp AS (SELECT name FROM sq WHERE name IN (SELECT source FROM e UNION SELECT target FROM e) ORDER BY mid LIMIT 8) SELECT source, target FROM e WHERE source IN (SELECT name FROM kp) AND target IN (SELECT name FROM kp)""")
def c15_entity_edges(spark, d):
    """Foreign keys between stored models, among the first eight that have any."""
    m = fact(spark, d, "models").withColumn("framework", F.when(F.col("framework") != "pydantic", "stored"))
    return D.entity_edges(m, fact(spark, d, "fields").select("name", "foreign_key"), "stored", cap=8)
