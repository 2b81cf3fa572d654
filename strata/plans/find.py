"""Queries of search and serving over the code base's facts, each beside the SQL that it must equal."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from strata.functions import text as T
from strata.operators import code as C
from strata.operators import search as S
from strata.operators.text_index import TextIndex
from strata.sources.staging import shared_dir, staged

from .catalogue import query, r6, table
from .codebase import WITH, fact
from .scalars import SPLIT

ASK = "getUserById model of_service"
TOKENS = ["get", "user", "by", "id", "model", "of", "service"]
QS = "q AS (SELECT unnest(['get', 'user', 'by', 'id', 'model', 'of', 'service']) AS q)"
SYM = f"sym AS (SELECT file AS id, {SPLIT.format('name')} AS symbol FROM functions)"
FD = f"fd AS (SELECT f.path AS id, f.path, coalesce(symbol, '') AS symbol, coalesce(e.method || ' ' || e.path, '') AS endpoint, coalesce(e.handler, '') AS body, f.module FROM files f LEFT JOIN sym ON sym.id = f.path LEFT JOIN endpoints e ON e.file = f.path)"


def bm(docs: str, fields: dict[str, float], id_: str) -> str:
    """The SQL of prefix BM25 with weighted fields: b(id, score)."""
    toks = " UNION ALL ".join(f"SELECT {id_} AS id, unnest(regexp_split_to_array(lower({c}), '[^a-z0-9]+')) AS token, {w}::DOUBLE AS w FROM {docs}" for c, w in fields.items())
    return f"""tk AS ({toks}), p AS (SELECT id, token, sum(w) AS w, count(*) AS n FROM tk WHERE token <> '' GROUP BY 1, 2), nn AS (SELECT count(*)::DOUBLE AS nd FROM {docs}), ln AS (SELECT id, sum(n) AS len FROM p GROUP BY 1), av AS (SELECT sum(n) / any_value(nd) AS avgdl FROM p, nn), {QS},
f AS (SELECT id, q, sum(w) AS f FROM p, q WHERE starts_with(token, q) GROUP BY 1, 2), ic AS (SELECT q, ln((any_value(nd) - count(*) + 0.5) / (count(*) + 0.5)) AS i FROM f, nn GROUP BY q), idf AS (SELECT q, CASE WHEN i > 0 THEN i ELSE 1e-6 END AS idf FROM ic),
b AS (SELECT id, -sum(idf * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * len / avgdl))) AS score FROM f JOIN idf USING (q) JOIN ln USING (id), av GROUP BY id)"""


FILE_BM = f"{WITH}, {SYM}, {FD}, {bm('fd', S.FILE_WEIGHTS, 'id')}"


def file_docs(spark, d):
    fn = fact(spark, d, "functions").select(F.col("file").alias("path"), T.split_identifiers(F.col("name")).alias("symbol"))
    e = fact(spark, d, "endpoints").select(F.col("file").alias("path"), F.concat_ws(" ", "method", "path").alias("endpoint"), F.col("handler").alias("body"))
    return fact(spark, d, "files").select("path", "module").join(fn, "path", "left").join(e, "path", "left").select(F.col("path").alias("id"), "path", *(F.coalesce(c, F.lit("")).alias(c) for c in ("symbol", "endpoint", "body")), "module")


#: Stored indexes by application, name and folder.
INDEXES: dict[tuple[str, str, str], TextIndex] = {}


def stored_index(spark, d, name, docs, weights):
    """An index that is built when first asked for and then read by all queries of the application."""
    at = (spark.sparkContext.applicationId, name, d)
    if at not in INDEXES:
        index = TextIndex(spark, f"{shared_dir(spark)}/strata/{uuid.uuid4().hex}/{name}")
        index.build(docs(spark, d), weights)
        INDEXES[at] = index
    return INDEXES[at]


def file_index(spark, d):
    return stored_index(spark, d, "file_index", file_docs, S.FILE_WEIGHTS)


@query(f"{FILE_BM} SELECT id, floor(score * 1e6 + 0.5) / 1e6 AS score FROM b ORDER BY floor(score * 1e9), id LIMIT 20")
def f3_weighted_file_search(spark, d):
    return file_index(spark, d).search(S.query_tokens(ASK), 20).orderBy(F.floor(F.col("score") * 1e9), "id").limit(20).select("id", r6(F.col("score")).alias("score"))


@query(f"""{FILE_BM}, pool AS (SELECT id, score FROM b ORDER BY round(score, 9), id LIMIT 60), x AS (SELECT id, score * CASE WHEN i + o = 0 THEN 1 ELSE 0.7 + 0.3 * i / (i + o) END AS c FROM (SELECT id, score, (SELECT count(*) FROM file_deps WHERE dst = id) AS i, (SELECT count(*) FROM file_deps WHERE src = id) AS o FROM pool)), t AS (SELECT * FROM x ORDER BY round(c, 9), id LIMIT 5)
SELECT t.id, floor(c * 1e6 + 0.5) / 1e6 AS combined, coalesce(string_agg(DISTINCT w, ',' ORDER BY w), '') AS matched FROM t LEFT JOIN (SELECT id, unnest(string_split(symbol, ' ')) AS w FROM sym) s ON s.id = t.id AND len(list_filter(['get', 'user', 'by', 'id', 'model', 'of', 'service'], lambda v: contains(w, v))) > 0 GROUP BY 1, 2""")
def f4_file_search_with_authority(spark, d):
    words = fact(spark, d, "functions").select(F.col("file").alias("id"), F.explode(F.split(T.split_identifiers(F.col("name")), " ")).alias("symbol"))
    x = S.file_search(file_index(spark, d), 0, S.query_tokens(ASK), fact(spark, d, "file_deps"), words)
    return x.select("id", r6(F.col("combined")).alias("combined"), F.array_join("matched", ",").alias("matched"))


BODY = f"trim(regexp_replace({SPLIT.format('name')} || ' ' || array_to_string(list_transform(list_filter(string_split(regexp_extract(file, '^(.*)/[^/]*$', 1), '/'), lambda s: NOT list_contains(['lib', 'api', 'tests'], s)), lambda s: lower(s)), ' ') || ' ' || coalesce(cs, ''), ' +', ' ', 'g'))"
FNDOC = f"cj AS (SELECT caller, string_agg(c, ' ' ORDER BY c) AS cs FROM (SELECT DISTINCT caller, {SPLIT.format('callee')} AS c FROM fn_calls) GROUP BY 1), fnd AS (SELECT fid AS id, name, {BODY} AS body FROM functions LEFT JOIN cj ON caller = name)"


def function_docs(spark, d):
    cs = fact(spark, d, "fn_calls").select(F.col("caller").alias("name"), T.split_identifiers(T.bare_callee(F.col("callee"))).alias("c")).groupBy("name").agg(F.array_join(F.array_sort(F.collect_set("c")), " ").alias("cs"))
    x = fact(spark, d, "functions").join(cs, "name", "left")
    body = F.concat_ws(" ", T.split_identifiers(F.col("name")), T.folder_words(F.col("file")), F.coalesce("cs", F.lit("")))
    return x.select(F.col("fid").alias("id"), "name", F.trim(F.regexp_replace(body, " +", " ")).alias("body"))


@query(f"{WITH}, {FNDOC} SELECT * FROM fnd")
def f10_function_documents(spark, d):
    return function_docs(spark, d)


def hybrid(vec: bool) -> str:
    b, a, v, c, cv = (0.5, 0.2, 0.3, 0.35, 0.3) if vec else (0.7, 0.3, 0.0, 0.45, 0.0)
    sims = "sims AS (SELECT vec_id AS id, list_dot_product(list_transform(embedding, lambda x: x::DOUBLE), qv) / sqrt(list_dot_product(qv, qv)) AS sim FROM embeddings, (SELECT list_transform(embedding, lambda x: x::DOUBLE) AS qv FROM embeddings WHERE vec_id = 0))" if vec else "sims AS (SELECT 0::BIGINT AS id, 0.0::DOUBLE AS sim WHERE false)"
    bad = "(regexp_matches(lower(regexp_extract(file, '[^/]*$')), 'test|spec|bench|mock|fixture'))"
    return f"""{WITH}, {FNDOC}, {bm('fnd', S.SYMBOL_WEIGHTS, 'id')}, {sims}, pool AS (SELECT b.id, -score AS v, name, file FROM b JOIN functions ON fid = b.id ORDER BY round(score, 9), b.id LIMIT 60), src AS (SELECT * FROM fn_calls WHERE NOT regexp_matches(lower(caller_file), 'test|spec|mock|fixture|example|demo|sample')),
dg AS (SELECT callee AS name, count(*) AS ind FROM src WHERE callee IN (SELECT name FROM pool) GROUP BY 1), hc AS (SELECT callee AS name, count(*) AS hits FROM src WHERE caller IN (SELECT name FROM (SELECT name FROM pool ORDER BY round(v, 9) DESC, id LIMIT 30)) GROUP BY 1), ce AS (SELECT fid AS id, name, file, hits FROM functions JOIN hc USING (name) ORDER BY hits DESC, fid LIMIT 40),
one AS (SELECT max(v) AS mx, min(v) AS mn, least(count(*), 30) AS cl FROM pool), x AS (SELECT id, file, name, (v - mn) / CASE WHEN mx > mn THEN mx - mn ELSE 1 END AS nm, coalesce(ind, 0)::DOUBLE / coalesce((SELECT max(ind) FROM dg), 1) AS au, coalesce(sim, 0) AS sim FROM pool LEFT JOIN dg USING (name) LEFT JOIN sims USING (id), one),
s AS (SELECT id, ({b} * nm + {a} * au + {v} * sim + CASE WHEN NOT {bad} AND name IN (SELECT name FROM ce) AND nm < 0.2 THEN 0.28 ELSE 0 END) * CASE WHEN {bad} THEN 0.5 ELSE 1 END AS score FROM x UNION ALL SELECT id, ({c} * hits / cl + {cv} * coalesce(sim, 0)) * CASE WHEN {bad} THEN 0.5 ELSE 1 END FROM ce LEFT JOIN sims USING (id), one WHERE name NOT IN (SELECT name FROM pool))
SELECT id, floor(score * 1e6 + 0.5) / 1e6 AS score FROM s ORDER BY round(score, 9) DESC, id LIMIT 10"""


def symbols(spark, d, vectors=None):
    index = stored_index(spark, d, "function_index", function_docs, S.SYMBOL_WEIGHTS)
    fn = fact(spark, d, "functions").select(F.col("fid").alias("id"), "name", "file", "line")
    return S.symbol_search(index, 0, S.query_tokens(ASK), fn, fact(spark, d, "fn_calls"), vectors).select("id", r6(F.col("score")).alias("score"))


@query(hybrid(False))
def f5_symbol_search(spark, d):
    return symbols(spark, d)


@query(hybrid(True))
def f5_j5_symbol_search_with_vectors(spark, d):
    e = table(spark, d, "embeddings")
    q = e.filter("vec_id = 0").select(F.col("embedding").alias("q"))  # one row
    sims = e.crossJoin(F.broadcast(q)).select(F.col("vec_id").alias("id"), T.cosine(F.col("embedding"), F.col("q")).alias("sim"))
    return symbols(spark, d, sims)


@query(f"{WITH} SELECT fid, CASE fid % 4 WHEN 0 THEN 'add ' WHEN 1 THEN '' WHEN 2 THEN 'see ' ELSE 'fix' END || CASE WHEN fid % 4 = 3 THEN '' ELSE regexp_replace(regexp_replace(replace(name, '_', ' '), '([a-z])([A-Z])', '\\1 \\2', 'g'), '([A-Z]+)([A-Z][a-z])', '\\1 \\2', 'g') END AS cleaned FROM functions")
def f2_clean_queries(spark, d):
    k = F.col("fid") % 4
    raw = F.when(k == 0, F.concat(F.lit("feat(core)!: add "), "name", F.lit(" (#12)"))).when(k == 1, F.concat(F.lit("Fixed #37 -- "), "name")).when(k == 2, F.concat(F.lit("see -- "), "name")).otherwise(F.lit("docs: fix #4  "))
    return fact(spark, d, "functions").select("fid", S.clean_query(raw).alias("cleaned"))


CATS = {"endpoints": 8, "models": 8, "modules": 5, "files": 8}
TIER = "CASE WHEN lower({0}) = 'model user' THEN 1.0 WHEN contains(lower({0}), 'model user') THEN 0.8 WHEN contains(lower({0}), 'model') AND contains(lower({0}), 'user') THEN 0.6 WHEN contains(lower({0}), 'model') OR contains(lower({0}), 'user') THEN 0.3 ELSE 0.0 END"


@query(f"""{WITH}, it AS (SELECT 'endpoints' AS category, eid AS ord, method || ' ' || path || ' [' || module || ']' AS label, path AS v, 1.0 AS w FROM endpoints UNION ALL SELECT 'endpoints', eid, method || ' ' || path || ' [' || module || ']', handler, 0.9 FROM endpoints
UNION ALL SELECT 'endpoints', eid, method || ' ' || path || ' [' || module || ']', call, 0.5 FROM endpoints JOIN calls USING (eid) WHERE call NOT IN ('str', 'db.query') UNION ALL SELECT 'models', mid, name, name, 1.0 FROM models UNION ALL SELECT 'models', mid, name, field, 0.6 FROM fields
UNION ALL SELECT 'modules', 0, id, id, 1.0 FROM modules UNION ALL SELECT 'files', fid, path, regexp_extract(path, '[^/]*$'), 1.0 FROM files UNION ALL SELECT 'files', fid, path, path, 0.5 FROM files), sc AS (SELECT category, ord, label, max(w * {TIER.format('v')})::DOUBLE AS score FROM it GROUP BY 1, 2, 3),
rk AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY score DESC, ord) AS place FROM sc WHERE score > 0) SELECT category, label, score, place::INTEGER AS place FROM rk WHERE place <= CASE category WHEN 'modules' THEN 5 ELSE 8 END""")
def f15_t5_categorical_search(spark, d):
    return S.categorical(category_items(spark, d), "model user", CATS)


def category_items(spark, d):
    field = lambda v, w: F.struct(v.alias("value"), F.lit(w).alias("weight"))
    e, f = fact(spark, d, "endpoints"), fact(spark, d, "files")
    told = fact(spark, d, "calls").filter(~T.generic_call(F.col("call"))).groupBy("eid").agg(F.collect_list(field(F.col("call"), 0.5)).alias("more"))
    item = lambda df, k, o, label, fields: df.select(F.lit(k).alias("category"), o.cast("long").alias("ord"), label.alias("label"), fields.alias("fields"))
    none = F.array().cast("array<struct<value:string,weight:double>>")
    out = item(e.join(told, "eid", "left"), "endpoints", F.col("eid"), F.concat(F.concat_ws(" ", "method", "path"), F.lit(" ["), "module", F.lit("]")), F.concat(F.array(field(F.col("path"), 1.0), field(F.col("handler"), 0.9)), F.coalesce("more", none)))
    m = fact(spark, d, "fields").groupBy("name", "mid").agg(F.collect_list(field(F.col("field"), 0.6)).alias("more"))
    out = out.unionByName(item(m, "models", F.col("mid"), F.col("name"), F.concat(F.array(field(F.col("name"), 1.0)), "more")))
    out = out.unionByName(item(fact(spark, d, "modules"), "modules", F.lit(0), F.col("id"), F.array(field(F.col("id"), 1.0))))
    return out.unionByName(item(f.filter(~T.asset_or_migration(F.col("path"))), "files", F.col("fid"), F.col("path"), F.array(field(T.basename(F.col("path")), 1.0), field(F.col("path"), 0.5))))


ITEM = "least(1, ({0} + CASE WHEN contains(lower(name), 'model item') THEN 0.15 ELSE 0 END) / 2)"
TOK = "CASE WHEN lower(name) = '{0}' THEN 1 WHEN contains(lower(name), '{0}') THEN 0.7 WHEN contains(lower(tx), '{0}') THEN 0.4 WHEN contains(lower(coalesce(file, '')), '{0}') THEN 0.2 ELSE 0 END"


@query(f"""{WITH}, it AS (SELECT 'models' AS type, name, file, framework AS tx FROM models UNION ALL SELECT 'endpoints', method || ' ' || path, file, handler || '|' || module FROM endpoints UNION ALL SELECT 'modules', id, path, layer FROM modules UNION ALL SELECT 'files', path, path, module FROM files UNION ALL SELECT 'functions', name || ':' || line, file, '' FROM functions),
sc AS (SELECT type, name, file, {ITEM.format(TOK.format('model') + ' + ' + TOK.format('item'))} AS s FROM it), dg AS (SELECT dst AS file, count(*) AS n FROM file_deps GROUP BY 1), rk AS (SELECT file, n / (SELECT max(n) FROM dg)::DOUBLE AS r FROM dg),
bl AS (SELECT type, name, CASE WHEN type IN ('files', 'functions') THEN 0.7 * s + 0.3 * coalesce(r, 0) ELSE s END AS s FROM sc LEFT JOIN rk USING (file) WHERE s > 0), tp AS (SELECT type, name, s FROM bl WHERE type <> 'functions' UNION ALL SELECT * FROM (SELECT type, name, s FROM bl WHERE type = 'functions' ORDER BY floor(s * 1e9) DESC, name LIMIT 10))
SELECT type, name, floor(s * 1e6 + 0.5) / 1e6 AS score FROM tp""")
def f13_t1_t2_snapshot_search(spark, d):
    dg = fact(spark, d, "file_deps").groupBy(F.col("dst").alias("file")).agg(F.count(F.lit(1)).alias("n"))
    ranks = dg.crossJoin(F.broadcast(dg.agg(F.max("n").alias("most")))).select("file", (F.col("n") / F.col("most")).alias("rank"))
    item = lambda df, k, name, file, *texts: df.select(F.lit(k).alias("type"), name.alias("name"), file.alias("file"), F.array(*texts).alias("texts"))
    f = lambda n: fact(spark, d, n)
    c = F.col
    items = item(f("models"), "models", c("name"), c("file"), c("framework")).unionByName(item(f("endpoints"), "endpoints", F.concat_ws(" ", "method", "path"), c("file"), c("handler"), c("module"))).unionByName(item(f("modules"), "modules", c("id"), c("path"), c("layer")))
    items = items.unionByName(item(f("files"), "files", c("path"), c("path"), c("module"))).unionByName(item(f("functions"), "functions", F.concat_ws(":", "name", c("line").cast("string")), c("file"), F.lit("")))
    x = S.snapshot_matches(items, ["model", "item"], ranks)
    return x.select("type", "name", r6(c("score")).alias("score"))


@query(f"{WITH} SELECT fid, floor((CASE WHEN lower(name) = 'save' THEN 1 WHEN contains(lower(name), 'save') THEN 0.8 WHEN contains(lower(file), 'save') THEN 0.55 ELSE 0 END + CASE WHEN contains(lower(name), 'lib') THEN 0.8 WHEN contains(lower(file), 'lib') THEN 0.55 ELSE 0 END + CASE WHEN contains(lower(name), 'word') THEN 0.8 WHEN contains(lower(file), 'word') THEN 0.55 ELSE 0.4 END) / 3 * 1e6 + 0.5) / 1e6 AS score FROM functions")
def f16_focus_score(spark, d):
    return fact(spark, d, "functions").select("fid", r6(S.focus_score(["save", "lib", "word"], F.col("name"), F.col("file"), F.array(F.lit("a Word")))).alias("score"))


@query(f"{FILE_BM.replace(QS, QS.replace('[' + QS.split('[')[1].split(']')[0] + ']', '[' + chr(39) + 'model' + chr(39) + ']'))} SELECT id FROM b ORDER BY floor(score * 1e9), id LIMIT 10")
def f17_f18_fallback_search(spark, d):
    """A query whose cleaned form finds nothing falls back to the keywords of a glob pattern, then to categories."""
    index = file_index(spark, d)
    top = lambda tokens: index.search(tokens, 10).orderBy(F.floor(F.col("score") * 1e9), "id").limit(10).select("id")
    return S.first_hits([lambda: top(S.query_tokens("zzqx #12")), lambda: top(S.glob_keywords("src/model*/**/*.ts")), lambda: S.categorical(category_items(spark, d), "model", CATS).select(F.col("label").alias("id"))])


@query(f"{WITH} SELECT (SELECT count(*) FROM endpoints) AS endpoints, (SELECT count(*) FROM models) AS models, (SELECT count(DISTINCT page) FROM page_calls) AS pages, (SELECT string_agg(id, ',' ORDER BY n_files DESC, id) FROM (SELECT * FROM modules ORDER BY n_files DESC, id LIMIT 5)) AS top")
def q1_orient(spark, d):
    n = lambda f, to: fact(spark, d, f).agg(F.count(F.lit(1)).alias(to))
    top = fact(spark, d, "modules").orderBy(F.desc("n_files"), "id").limit(5).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n_files")).alias("k"), "id"))), lambda m: m["id"]), ",").alias("top"))
    pages = fact(spark, d, "page_calls").agg(F.count_distinct("page").alias("pages"))
    return n("endpoints", "endpoints").crossJoin(F.broadcast(n("models", "models"))).crossJoin(F.broadcast(pages)).crossJoin(F.broadcast(top))


@query(f"""{WITH}, t AS (SELECT path, module, regexp_extract(path, '([^/]*)[.][a-z]+$', 1) AS stem FROM files WHERE fid IN (3, 6, 8, 13)), ep AS (SELECT t.path AS target, e.* FROM t JOIN endpoints e ON contains(t.path, e.file) OR contains(e.file, t.path) OR ends_with(e.file, regexp_extract(t.path, '[^/]*$'))), mo AS (SELECT t.path AS target, m.name, (SELECT count(*) FROM fields f WHERE f.name = m.name) AS n FROM t JOIN models m ON contains(t.path, m.file) OR contains(m.file, t.path) OR ends_with(m.file, regexp_extract(t.path, '[^/]*$')))
SELECT t.path AS target, module, coalesce((SELECT string_agg(method || ' ' || path, ',' ORDER BY eid) FROM ep WHERE target = t.path), '') AS endpoints, coalesce((SELECT string_agg(name || ':' || n, ',' ORDER BY name) FROM mo WHERE target = t.path), '') AS models, coalesce((SELECT string_agg(DISTINCT call, ',' ORDER BY call) FROM ep JOIN calls USING (eid) WHERE target = t.path AND call <> 'str'), '') AS calls,
coalesce((SELECT string_agg(k, ',' ORDER BY eid) FROM (SELECT DISTINCT eid, method || ' ' || path AS k FROM calls JOIN endpoints USING (eid) WHERE contains(lower(call), t.stem) ORDER BY eid LIMIT 8)), '') AS called_by FROM t""")
def q2_p6_file_context(spark, d):
    return C.file_context(fact(spark, d, "files").filter("fid in (3, 6, 8, 13)").select("path"), *(fact(spark, d, x) for x in ("endpoints", "models", "fields", "modules", "calls")))


@query(f"{WITH} SELECT eid, handler, file, module, request_schema, response_schema, coalesce((SELECT string_agg(call, ',' ORDER BY k) FROM calls c WHERE c.eid = e.eid AND call <> 'str'), '') AS calls FROM endpoints e WHERE method = 'POST' AND path = '/api/v1/res1'")
def q3_endpoint_context(spark, d):
    e = fact(spark, d, "endpoints").filter("method = 'POST' and path = '/api/v1/res1'")
    c = fact(spark, d, "calls").filter(~F.col("call").isin(T.GENERIC)).groupBy("eid").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "call"))), lambda x: x["call"]).alias("c"))
    return e.join(c, "eid", "left").select("eid", "handler", "file", "module", "request_schema", "response_schema", F.coalesce(F.array_join("c", ","), F.lit("")).alias("calls"))


@query(f"{WITH} SELECT name, framework, file, (SELECT string_agg(field, ',' ORDER BY k) FROM fields f WHERE f.name = m.name) AS fields, coalesce((SELECT string_agg(method || ' ' || path, ',' ORDER BY eid) FROM endpoints WHERE request_schema = m.name OR response_schema = m.name), '') AS used_by FROM models m WHERE name = 'Model3'")
def q4_model_context(spark, d):
    m = fact(spark, d, "models").filter("name = 'Model3'")
    listed = lambda df, k, v, to: df.groupBy().agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(k, v.alias("v")))), lambda x: x["v"]), ",").alias(to))
    f = listed(fact(spark, d, "fields").filter("name = 'Model3'"), "k", F.col("field"), "fields")
    u = listed(fact(spark, d, "endpoints").filter("request_schema = 'Model3' or response_schema = 'Model3'"), "eid", F.concat_ws(" ", "method", "path"), "used_by")
    return m.crossJoin(F.broadcast(f)).crossJoin(F.broadcast(u)).select("name", "framework", "file", "fields", "used_by")


SETS = "x AS (SELECT fid, len(list_distinct(k)) AS n, list_distinct(k) AS k, 12 + fid % 40 AS size, fid % 6 AS h FROM (SELECT fid, list('kind' || CAST((fid % 9 + i * (fid % 3 + 1)) % 24 AS STRING)) AS k FROM files, (VALUES (0), (1), (2), (3), (4), (5)) AS t(i) GROUP BY fid))"


def structures(spark, d):
    kinds = F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(5)), lambda i: F.concat(F.lit("kind"), ((F.col("fid") % 9 + i * (F.col("fid") % 3 + 1)) % 24).cast("string"))))
    return fact(spark, d, "files").select(F.col("fid").alias("id"), kinds.alias("kinds"), (F.lit(12) + F.col("fid") % 40).alias("size"), (F.col("fid") % 6).cast("string").alias("hash"))


@query(f"{WITH}, {SETS} SELECT a.fid AS a, b.fid AS b, floor(len(list_intersect(a.k, b.k)) / (a.n + b.n - len(list_intersect(a.k, b.k)))::DOUBLE * 1000 + 0.5) / 1000 AS similarity FROM x a JOIN x b ON a.fid < b.fid AND abs(floor(a.size / 10) - floor(b.size / 10)) <= 1 AND a.h <> b.h WHERE len(list_intersect(a.k, b.k)) / (a.n + b.n - len(list_intersect(a.k, b.k)))::DOUBLE >= 0.8")
def d4_similar_structure(spark, d):
    return C.similar_structure(structures(spark, d), 0.8)


@query(f"{WITH}, x AS (SELECT eid, list_distinct(list_filter(regexp_split_to_array(regexp_replace(lower(method || ' ' || path), '[^a-z0-9/]+', ' ', 'g'), '[/ ]+'), lambda t: t <> '')) AS t FROM endpoints) SELECT a.eid AS a, b.eid AS b, floor(len(list_intersect(a.t, b.t)) / (len(a.t) + len(b.t) - len(list_intersect(a.t, b.t)))::DOUBLE * 100 + 0.5) / 100 AS similarity FROM x a JOIN x b ON a.eid < b.eid WHERE len(list_intersect(a.t, b.t)) / (len(a.t) + len(b.t) - len(list_intersect(a.t, b.t)))::DOUBLE >= 0.8")
def d5_related_endpoints(spark, d):
    text = F.regexp_replace(F.lower(F.concat_ws(" ", "method", "path")), "[^a-z0-9/]+", " ")
    x = fact(spark, d, "endpoints").select(F.col("eid").alias("id"), F.array_distinct(F.filter(F.split(text, "[/ ]+"), lambda t: t != "")).alias("tokens"))
    return C.similar_tokens(x, 0.8, 2)


@query(f"{WITH}, s AS (SELECT l_orderkey AS k, list_sort(list(DISTINCT l_suppkey % 12)) AS a FROM lineitem GROUP BY 1) SELECT x.k AS a, y.k AS b, 1.0::DOUBLE AS similarity FROM s x JOIN s y ON len(x.a) = len(y.a) AND x.k < y.k WHERE len(x.a) >= 5 AND len(list_intersect(x.a, y.a)) / (len(x.a) + len(y.a) - len(list_intersect(x.a, y.a)))::DOUBLE >= 0.8 ORDER BY 1, 2 LIMIT 50")
def d3_t9_similar_calls(spark, d):
    from strata.operators import store

    sets = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.array_sort(F.collect_set(F.col("l_suppkey") % 12)).alias("a")).filter(F.size("a") >= 5)
    return store.similar_sets(sets, 0.8).select("a", "b", F.lit(1.0).alias("similarity")).orderBy("a", "b").limit(50)
