"""Facts of a made-up code base, derived from the driver's tables in SQL that Spark and DuckDB both read.

Five parts make one unit: a test, a model, a plain, an API and a library file. Units belong to
twelve modules; API files hold endpoints, model files hold models, suppliers stand for pages.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from strata.sources.staging import once, once_at

BASE = ["part", "supplier", "lineitem"]
G, S = "CAST(floor(p_partkey / 5) AS BIGINT)", "CAST({} AS STRING)"
UNIT = f"{S.format(G)}"
MODULE = f"'service-' || {S.format(f'{G} % 12')}"
EXT = f"CASE WHEN {G} % 3 = 0 THEN '.ts' ELSE '.py' END"

FACTS = {
    "files": f"""SELECT p_partkey AS fid, {G} AS unit, {MODULE} AS module, 'backend/' || {MODULE} || CASE p_partkey % 5 WHEN 0 THEN CASE WHEN {G} % 2 = 0 THEN '/tests/lib/test_' ELSE '/tests/test_' END
        WHEN 1 THEN '/models/' WHEN 2 THEN '/' WHEN 3 THEN '/api/v1/' ELSE '/lib/' END || 'handler' || {UNIT} || {EXT} AS path FROM part""",
    "modules": "SELECT module AS id, 'backend/' || module AS path, CASE min(unit) % 4 WHEN 0 THEN 'api' WHEN 1 THEN 'core' WHEN 2 THEN 'data' ELSE 'ui' END AS layer, count(*) AS n_files FROM files GROUP BY module",
    "file_deps": """SELECT DISTINCT a.path AS src, b.path AS dst FROM (SELECT l_partkey AS s, (l_partkey * 7 + l_suppkey * 3) % (SELECT count(*) FROM part) + 1 AS t FROM lineitem WHERE l_quantity >= 45) e
        JOIN files a ON a.fid = e.s JOIN files b ON b.fid = e.t""",
    "endpoints": """SELECT unit AS eid, CASE unit % 5 WHEN 0 THEN 'GET' WHEN 1 THEN 'POST' WHEN 2 THEN 'PUT' WHEN 3 THEN 'DELETE' ELSE 'ANY' END AS method,
        '/api/v1/res' || CAST(unit % 40 AS STRING) || CASE WHEN unit % 3 = 0 THEN '/{id}' ELSE '' END AS path,
        CASE unit % 6 WHEN 0 THEN 'listItems' WHEN 1 THEN 'create_item' WHEN 2 THEN 'require_user' WHEN 3 THEN 'paginateAll' WHEN 4 THEN 'removeItem' ELSE 'authLogin' END AS handler, path AS file, module,
        CASE WHEN unit % 3 = 0 THEN 'Model' || CAST(unit % 37 AS STRING) END AS request_schema, CASE WHEN unit % 2 = 0 THEN 'Model' || CAST(unit % 17 AS STRING) END AS response_schema FROM files WHERE fid % 5 = 3""",
    "calls": """SELECT eid, k, CASE (eid + k) % 8 WHEN 0 THEN 'str' WHEN 1 THEN 'db.query' WHEN 2 THEN 'Model' || CAST((eid + k) % 30 AS STRING) || '.save' WHEN 3 THEN 'send_task' WHEN 4 THEN 'handler' || CAST(eid AS STRING) || '.run'
        WHEN 5 THEN 'EmailService.send' WHEN 6 THEN 'Payments' ELSE 'worker.delay(job)' END AS call FROM endpoints, (VALUES (0), (1), (2), (3), (4)) AS t(k) WHERE k < eid % 6""",
    "models": "SELECT 'Model' || CAST(unit % 30 AS STRING) AS name, min(unit % 30) AS mid, min(path) AS file, CASE min(unit % 30) % 3 WHEN 0 THEN 'pydantic' WHEN 1 THEN 'sqlalchemy' ELSE 'django' END AS framework FROM files WHERE fid % 5 = 1 GROUP BY unit % 30",
    "fields": """SELECT name, mid, k, CASE k WHEN 0 THEN 'id' WHEN 1 THEN 'session_id' WHEN 2 THEN 'status' WHEN 3 THEN 'owner' WHEN 4 THEN 'kind_flag' ELSE 'extra' || CAST(mid AS STRING) END AS field,
        CASE WHEN k = 3 THEN 'model' || CAST((mid * 7 + 3) % 33 AS STRING) || 's.id' END AS foreign_key FROM models, (VALUES (0), (1), (2), (3), (4), (5)) AS t(k) WHERE k <= mid % 6""",
    "uses": "SELECT eid, 'Model' || CAST((eid * 3 + k) % 33 AS STRING) AS model, CASE (eid + k) % 3 WHEN 0 THEN 'read' WHEN 1 THEN 'write' ELSE 'read_write' END AS access FROM endpoints, (VALUES (0), (1), (2), (3)) AS t(k) WHERE k < eid % 5",
    "page_calls": """SELECT '/page' || CAST(s_suppkey AS STRING) AS page, CASE s_suppkey % 6 WHEN 0 THEN 'get' WHEN 1 THEN 'POST' WHEN 2 THEN '' WHEN 3 THEN 'PUT' WHEN 4 THEN 'PATCH' ELSE 'DELETE' END AS method,
        CASE WHEN s_suppkey % 7 = 0 THEN '/res' ELSE '/api//v1/res' END || CAST(s_suppkey % 45 AS STRING) || CASE WHEN s_suppkey % 3 = 0 THEN '/$' || '{itemId}?q=1' ELSE '/' END AS path, CASE s_suppkey % 4 WHEN 0 THEN 'status' WHEN 1 THEN 'id' WHEN 2 THEN 'bogus' END AS field FROM supplier""",
    "functions": """SELECT fid, CASE fid % 6 WHEN 0 THEN 'getUserById' WHEN 1 THEN 'save_model' WHEN 2 THEN 'parseHTTPRequest' WHEN 3 THEN 'loadItem' WHEN 4 THEN 'render_page' ELSE 'auditLog' END || CAST(unit % 50 AS STRING) AS name, path AS file, fid % 90 + 1 AS line FROM files""",
    "fn_calls": "SELECT DISTINCT a.name AS caller, b.name AS callee, a.file AS caller_file FROM file_deps d JOIN functions a ON a.file = d.src JOIN functions b ON b.file = d.dst WHERE a.name <> b.name",
}
#: What stands before a SELECT over the facts.
WITH = "WITH " + ",\n".join(f"{k} AS ({v})" for k, v in FACTS.items())
#: Endpoints as the registry shows them, and the pattern of a path.
PATTERN = "coalesce(nullif(regexp_replace(regexp_replace(regexp_replace(regexp_replace({0}, '[?].*$', ''), '[$]?[{{][^}}]+[}}]|<[^>]+>|:[A-Za-z0-9_]+', ':param', 'g'), '/+', '/', 'g'), '/$', ''), ''), '/')"


def needs(name: str, known: list[str]) -> list[str]:
    return [t for t in known if re.search(rf"\b(?:FROM|JOIN) {t}\b", FACTS[name])]


def fact(spark: SparkSession, d: str, name: str) -> DataFrame:
    """A fact table, made once per application and folder from the base tables and facts that it names."""

    def build() -> DataFrame:
        places = {t: f"{d}/{t}.parquet" for t in needs(name, BASE)}
        for t in needs(name, list(FACTS)[: list(FACTS).index(name)]):
            fact(spark, d, t)
            places[t] = once_at(spark, f"fact_{t}", d)
        return spark.sql("WITH " + ", ".join(f"{t} AS (SELECT * FROM parquet.`{p}`)" for t, p in places.items()) + " " + FACTS[name])

    return once(spark, f"fact_{name}", d, build)
