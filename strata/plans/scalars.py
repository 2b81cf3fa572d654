"""Queries of predicates and scalar functions over the code base's facts, each beside the SQL that it must equal."""

from __future__ import annotations

from pyspark.sql import functions as F

from strata.functions import text as T
from strata.operators.substrings import related_paths

from .catalogue import query
from .codebase import PATTERN, WITH, fact

SPLIT = "lower(regexp_replace(regexp_replace(replace({0}, '_', ' '), '([a-z])([A-Z])', '\\1 \\2', 'g'), '([A-Z]+)([A-Z][a-z])', '\\1 \\2', 'g'))"
NAME = "regexp_extract({0}, '[^/]*$')"


@query(f"{WITH} SELECT t.path AS target, e.eid FROM files t, endpoints e WHERE t.fid <= 8 AND (contains(t.path, e.file) OR contains(e.file, t.path) OR ends_with(e.file, {NAME.format('t.path')}))")
def p5_related_paths(spark, d):
    targets = fact(spark, d, "files").filter("fid <= 8").select(F.col("path").alias("target"))  # a stated set of eight files
    e = fact(spark, d, "endpoints")
    return e.join(related_paths(targets, e.select("file")), "file").select("target", "eid")


@query(f"{WITH} SELECT a.path AS file, b.path AS other FROM files a JOIN files b ON (a.path = b.path OR ends_with(a.path, '/' || b.path) OR ends_with(b.path, '/' || a.path) OR {NAME.format('a.path')} = {NAME.format('b.path')}) AND a.fid < b.fid")
def p7_suffix_paths(spark, d):
    # whatever matches by a suffix has the same basename, so the join is one of basenames
    f = fact(spark, d, "files").select("fid", "path", T.basename(F.col("path")).alias("name"))
    g = f.select(F.col("fid").alias("fid2"), F.col("path").alias("other"), "name")
    return f.join(g, "name").filter("fid < fid2").select(F.col("path").alias("file"), "other")


@query(f"{WITH} SELECT 'endpoints' AS type, CAST(eid AS STRING) AS id FROM endpoints UNION ALL SELECT 'models', name FROM models")
def p8_types(spark, d):
    e = fact(spark, d, "endpoints").select(F.lit("endpoints").alias("type"), F.col("eid").cast("string").alias("id"))
    every = e.unionByName(fact(spark, d, "models").select(F.lit("models").alias("type"), F.col("name").alias("id"))).unionByName(fact(spark, d, "files").select(F.lit("files").alias("type"), F.col("path").alias("id")))
    return every.filter(F.col("type").isin(sorted(T.search_types([" Models,bogus", "ENDPOINTS"]))))


@query(f"""{WITH} SELECT fid, regexp_matches(lower({NAME.format('path')}), 'test|spec|bench|mock|fixture') OR regexp_matches(lower(path), '(^|/)(examples?|demos?|samples?)(/|$)') AS non_source,
regexp_matches(lower(path), 'test|spec|mock') AS test_node, regexp_matches(path, 'alembic/versions|migrations/[0-9]') AS skipped FROM files""")
def p9_p10_p12_file_predicates(spark, d):
    p = F.col("path")
    return fact(spark, d, "files").select("fid", T.non_source(p).alias("non_source"), T.test_node(p).alias("test_node"), T.asset_or_migration(p).alias("skipped"))


@query(f"{WITH} SELECT DISTINCT call, call IN ('str', 'dict', 'int', 'len', 'float', 'max', 'join', 'getattr', 'lower', 'open', 'params.append', 'updates.append') OR regexp_matches(lower(call), '^(service|self|db|session|response|request|app|router|logger|config|os|json|re|datetime|uuid)[.]') AS generic FROM calls")
def p11_generic_calls(spark, d):
    return fact(spark, d, "calls").select("call").distinct().select("call", T.generic_call(F.col("call")).alias("generic"))


@query(f"{WITH} SELECT DISTINCT name, {SPLIT.format('name')} AS words FROM functions")
def p15_identifiers(spark, d):
    return fact(spark, d, "functions").select("name", T.split_identifiers(F.col("name")).alias("words")).distinct()


@query(f"""{WITH}, p AS (SELECT fid, CASE fid % 4 WHEN 0 THEN 'repo/src/' || path WHEN 1 THEN 'backend/' || path WHEN 2 THEN 'repo/lib/' || path ELSE path END AS raw FROM files)
SELECT fid, CASE fid % 4 WHEN 0 THEN 'src/' || substr(raw, 10) WHEN 1 THEN substr(raw, 9) WHEN 2 THEN substr(raw, 6) ELSE raw END AS path FROM p""")
def p16_repo_paths(spark, d):
    p = F.col("path")
    raw = F.when(F.col("fid") % 4 == 0, F.concat(F.lit("repo/src/"), p)).when(F.col("fid") % 4 == 1, F.concat(F.lit("backend/"), p)).when(F.col("fid") % 4 == 2, F.concat(F.lit("repo/lib/"), p)).otherwise(p)
    return fact(spark, d, "files").select("fid", T.repo_path(raw).alias("path"))


@query("""SELECT doc_id, len(list_filter(regexp_split_to_array(lower(text), '[^a-z0-9_/.{}-]+'), lambda t: length(t) >= 1)) AS n_search, len(list_filter(regexp_split_to_array(lower(text), '[^a-z0-9_]+'), lambda t: length(t) >= 3)) AS n_literal,
len(list_filter(regexp_split_to_array(lower(text), '[^a-z0-9_]+'), lambda t: length(t) >= 1)) AS n_depth, len(list_filter(regexp_split_to_array(lower(text), '[ \\t\\n\\r\\f\\v]+'), lambda t: length(t) >= 1)) AS n_blank FROM documents""")
def fn2_tokenisers(spark, d):
    from .catalogue import table

    docs = table(spark, d, "documents").select("doc_id", "text").repartition("doc_id")  # a file may be one split
    return docs.select("doc_id", *(T.token_count(F.col("text"), k).cast("long").alias(f"n_{k}") for k in T.TOKENISERS))


@query(f"""{WITH} SELECT DISTINCT call, CASE WHEN regexp_matches(call, '[.][A-Za-z_][A-Za-z0-9_]*$') THEN regexp_extract(call, '[.]([A-Za-z_][A-Za-z0-9_]*)$', 1) ELSE call END AS bare FROM calls""")
def fn3_bare_callees(spark, d):
    return fact(spark, d, "calls").select("call", T.bare_callee(F.col("call")).alias("bare")).distinct()


@query(f"""{WITH} SELECT fid, {NAME.format('path')} AS base, regexp_extract(path, '^(.*)/[^/]*$', 1) AS dir, regexp_extract(path, '[.][a-z]+$') AS ext, substr(path, 9) AS rel,
array_to_string(list_transform(list_filter(regexp_split_to_array(regexp_extract(path, '^(.*)/[^/]*$', 1), '/'), lambda s: NOT list_contains(['src', 'lib', 'app', 'pkg', 'internal', 'cmd', 'api', 'test', 'tests', 'core'], s)), lambda s: {SPLIT.format('s')}), ' ') AS folders FROM files""")
def fn3_fn4_path_parts(spark, d):
    p = F.col("path")
    return fact(spark, d, "files").select("fid", T.basename(p).alias("base"), T.dirname(p).alias("dir"), T.extension(p).alias("ext"), T.relative_to(T.posix(p), "backend").alias("rel"), T.folder_words(p).alias("folders"))


@query(f"{WITH}, x AS (SELECT name, list(field ORDER BY k) AS a FROM fields GROUP BY name) SELECT name, array_to_string(a[1:3], ', ') || CASE WHEN len(a) > 3 THEN ' +' || (len(a) - 3) || ' more' ELSE '' END AS shown FROM x")
def fn5_format_list(spark, d):
    x = fact(spark, d, "fields").groupBy("name").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "field"))), lambda f: f["field"]).alias("a"))
    return x.select("name", T.format_list(F.col("a"), 3).alias("shown"))


@query(f"""{WITH} SELECT eid, regexp_extract(path, '^/api/v1/([^/]+)', 1) AS domain, module AS grp, '/api/v1' AS integration, {PATTERN.format('path')} AS pattern, '/root' || path AS joined FROM endpoints""")
def fn6_fn8_c1_route_parts(spark, d):
    p = F.col("path")
    return fact(spark, d, "endpoints").select("eid", T.path_domain(p).alias("domain"), T.file_group(F.col("file")).alias("grp"), T.integration_domain(p).alias("integration"), T.path_pattern(p).alias("pattern"), T.joined_route(F.lit("/root/"), p).alias("joined"))


@query(f"""{WITH} SELECT fid, '/tests' AS dummy, CASE fid % 3 WHEN 0 THEN '/' || module WHEN 1 THEN '/' || module || '/handler' || CAST(unit AS STRING) ELSE '/' END AS route FROM files""")
def fn7_file_routes(spark, d):
    f = fact(spark, d, "files")
    name = F.concat(F.lit("handler"), F.col("unit").cast("string"))
    page = F.when(F.col("fid") % 3 == 0, F.concat(F.lit("web/app/(tabs)/"), "module", F.lit("/index.tsx"))).when(F.col("fid") % 3 == 1, F.concat(F.lit("web/app/"), "module", F.lit("/(auth)/"), name, F.lit(".tsx"))).otherwise("web/app/index.tsx")
    return f.select("fid", F.lit("/tests").alias("dummy"), T.file_route(page, "web/app").alias("route"))


@query(f"""{WITH} SELECT name, sha256('{{"file":"' || file || '","framework":"' || framework || '","name":"' || name || '"}}') AS fingerprint FROM models""")
def fn12_stable_json(spark, d):
    return fact(spark, d, "models").select("name", F.sha2(T.stable_json({"name": F.col("name"), "file": F.col("file"), "framework": F.col("framework")}), 256).alias("fingerprint"))


@query(f"""{WITH}, x AS (SELECT module, method, count(*) AS n FROM endpoints GROUP BY 1, 2) SELECT module, string_agg(method || '=' || n, ',' ORDER BY method) AS entries, coalesce(max(CASE WHEN method = 'PUT' THEN n END), 0) AS puts, sum(n)::BIGINT AS total FROM x GROUP BY 1""")
def fn14_maps(spark, d):
    x = fact(spark, d, "endpoints").groupBy("module", "method").agg(F.count(F.lit(1)).alias("n")).groupBy("module").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("method", "n")))).alias("m"))
    shown = F.array_join(F.transform(F.map_entries("m"), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ",")
    return x.select("module", shown.alias("entries"), F.coalesce(F.try_element_at("m", F.lit("PUT")), F.lit(0)).cast("long").alias("puts"), F.aggregate(F.map_values("m"), F.lit(0).cast("long"), lambda a, b: a + b).alias("total"))


@query(f"""{WITH}, x AS (SELECT name, mid, list(field) AS a FROM fields GROUP BY 1, 2) SELECT x.name AS a, y.name AS b, floor(len(list_intersect(x.a, y.a)) / (len(x.a) + len(y.a) - len(list_intersect(x.a, y.a)))::DOUBLE * 1e6 + 0.5) / 1e6 AS similarity FROM x JOIN x y ON y.mid = x.mid + 1""")
def fn16_jaccard(spark, d):
    x = fact(spark, d, "fields").groupBy("name", "mid").agg(F.collect_set("field").alias("s"))
    y = x.select(F.col("name").alias("b"), (F.col("mid") - 1).alias("mid"), F.col("s").alias("t"))
    return x.join(y, "mid").select(F.col("name").alias("a"), "b", T.half_up(T.jaccard(F.col("s"), F.col("t")), 6).alias("similarity"))
