"""Queries of symbol resolution and the function graph, each beside the SQL that it must equal.

The code base's files re-export names in chains of one to six steps, some of which end in cycles,
and some files re-export others whole.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from strata.operators import components as K
from strata.operators import symbols as Y
from strata.sources.staging import once

from .catalogue import query
from .codebase import WITH, fact

N = "(SELECT count(*) FROM files)"
PARTS = {
    "sdefs": "SELECT path AS file, 'fn' || CAST(fid AS STRING) AS name, fid FROM files UNION ALL SELECT path, 'helper', fid FROM files WHERE fid % 7 = 0 UNION ALL SELECT path, 'Store' || CAST(fid % 5 AS STRING) || '.load', fid FROM files WHERE fid % 4 = 0",
    # step k of the chain to function t stands in file t + 31 k and points to step k - 1
    "steps": f"SELECT fid AS t, k, (fid * 13 + k * 31) % {N} + 1 AS spot, CASE WHEN k = 1 THEN fid ELSE (fid * 13 + (k - 1) * 31) % {N} + 1 END AS upon, 1 + CAST(floor(fid / 7) AS BIGINT) % 6 AS n FROM files, (VALUES (1), (2), (3), (4), (5), (6)) AS s(k) WHERE fid % 7 = 0 AND k <= 1 + CAST(floor(fid / 7) AS BIGINT) % 6",
    "sreexports": """SELECT a.path AS file, 'x' || CAST(t AS STRING) || '_' || CAST(k AS STRING) AS name, b.path AS to_file, CASE WHEN k = 1 THEN 'fn' || CAST(t AS STRING) ELSE 'x' || CAST(t AS STRING) || '_' || CAST(k - 1 AS STRING) END AS to_name, k AS ord FROM steps JOIN files a ON a.fid = spot JOIN files b ON b.fid = upon
        UNION ALL SELECT a.path, 'loop' || CAST(floor(a.fid / 2) AS STRING), b.path, 'loop' || CAST(floor(a.fid / 2) AS STRING), 0 FROM files a JOIN files b ON b.fid = a.fid + CASE WHEN a.fid % 2 = 0 THEN 1 ELSE -1 END WHERE floor(a.fid / 2) % 11 = 0""",
    "sstars": f"SELECT a.path AS file, b.path AS to_file, k AS ord FROM (SELECT fid, k, path, (fid * CASE WHEN k = 0 THEN 5 ELSE 3 END + k) % {N} + 1 AS other FROM files, (VALUES (0), (1)) AS s(k) WHERE fid % 3 = 1) a JOIN files b ON b.fid = a.other WHERE b.fid <> a.fid",
    "simports": """SELECT f.path AS file, 'chained' AS alias, h.path AS to_file, 'x' || CAST(s.t AS STRING) || '_' || CAST(s.n AS STRING) AS symbol FROM files f JOIN steps s ON s.k = s.n AND CAST(floor(f.fid / 3) AS BIGINT) * 7 = s.t JOIN files h ON h.fid = s.spot
        UNION ALL SELECT f.path, 'helper2', g.path, 'helper' FROM files f JOIN files g ON g.fid = f.fid + 2 UNION ALL SELECT f.path, 'whole', g.path, '*' FROM files f JOIN files g ON g.fid = f.fid + 4
        UNION ALL SELECT f.path, 'Store', g.path, 'Store' || CAST(g.fid % 5 AS STRING) FROM files f JOIN files g ON g.fid = f.fid + 3 UNION ALL SELECT f.path, 'again', g.path, 'loop' || CAST(floor(g.fid / 2) AS STRING) FROM files f JOIN files g ON g.fid = f.fid - 1""",
    "scalls": """SELECT path AS file, path || '#fn' || CAST(fid AS STRING) AS caller, CASE WHEN fid % 4 = 0 THEN 'Store' || CAST(fid % 5 AS STRING) END AS in_class, CASE k WHEN 0 THEN 'chained' WHEN 1 THEN 'helper2' WHEN 2 THEN 'whole.fn' || CAST(fid + 4 AS STRING) WHEN 3 THEN 'Store.load' WHEN 4 THEN 'this.load' WHEN 5 THEN 'again' WHEN 6 THEN 'helper' ELSE 'whole.helper' END AS text
        FROM files, (VALUES (0), (1), (2), (3), (4), (5), (6), (7)) AS s(k)""",
}
SYMBOLS = WITH[5:] + ",\n" + ",\n".join(f"{k} AS ({v})" for k, v in PARTS.items())
#: From (file, name) over named re-exports, else stars, to definitions; paths of star numbers order the hits.
WALK = """names AS (SELECT DISTINCT file AS f, name AS n FROM (SELECT file, name FROM sdefs UNION ALL SELECT file, split_part(name, '.', 1) FROM sdefs)), ptr AS (SELECT file AS f, name AS n, arg_min(to_file, (ord, to_file, to_name)) AS f2, arg_min(to_name, (ord, to_file, to_name)) AS n2 FROM sreexports WHERE (file, name) NOT IN (SELECT (f, n) FROM names) GROUP BY 1, 2),
walk(file, name, f, n, path, been, hit) AS (SELECT r.file, r.name, r.file, r.name, []::INTEGER[], [r.file || '#' || r.name], m.f IS NOT NULL FROM req r LEFT JOIN names m ON m.f = r.file AND m.n = r.name
  UNION ALL SELECT w.file, w.name, s.f2, s.n2, CASE WHEN s.ord IS NULL THEN w.path ELSE list_append(w.path, s.ord) END, list_append(w.been, s.f2 || '#' || s.n2), m.f IS NOT NULL
  FROM walk w JOIN (SELECT f, n, f2, n2, NULL::INTEGER AS ord FROM ptr UNION ALL SELECT a.file, c.n, a.to_file, c.n, a.ord::INTEGER FROM sstars a, (SELECT DISTINCT name AS n FROM req UNION SELECT n2 FROM ptr) c WHERE c.n <> 'default' AND (a.file, c.n) NOT IN (SELECT (f, n) FROM ptr)) s ON s.f = w.f AND s.n = w.n
  LEFT JOIN names m ON m.f = s.f2 AND m.n = s.n2 WHERE NOT w.hit AND NOT list_contains(w.been, s.f2 || '#' || s.n2)),
sym AS (SELECT file, name, arg_min(f, path) AS def_file, arg_min(n, path) AS def_name FROM walk WHERE hit GROUP BY 1, 2)"""


def part(spark, d, name):
    def build():
        known = {t: fact(spark, d, t) for t in ("files",)} | {t: part(spark, d, t) for t in ("steps",) if f" {t}" in PARTS[name] and name != "steps"}
        for t, df in known.items():
            df.createOrReplaceTempView(f"strata_{t}")
        return spark.sql("WITH " + ", ".join(f"{t} AS (SELECT * FROM strata_{t})" for t in known) + " " + PARTS[name])

    return once(spark, f"symbols_{name}", d, build)


REQUESTS = "req AS (SELECT DISTINCT to_file AS file, symbol AS name FROM simports WHERE symbol <> '*')"


@query(f"WITH RECURSIVE {SYMBOLS}, {REQUESTS}, {WALK} SELECT * FROM sym")
def j26_symbol_resolution(spark, d):
    asks = part(spark, d, "simports").filter("symbol <> '*'").select(F.col("to_file").alias("file"), F.col("symbol").alias("name"))
    return Y.resolved_symbols(asks, Y.class_names(part(spark, d, "sdefs")), part(spark, d, "sreexports"), part(spark, d, "sstars"))


CALLS = "cl AS (SELECT DISTINCT file, caller, in_class, text, split_part(text, '.', 1) AS head, CASE WHEN contains(text, '.') THEN substr(text, strpos(text, '.') + 1) ELSE '' END AS rest FROM scalls), ask AS (SELECT c.*, i.to_file, i.symbol, CASE WHEN symbol = '*' THEN rest ELSE symbol END AS wanted FROM cl c JOIN simports i ON i.file = c.file AND i.alias = c.head), req AS (SELECT DISTINCT to_file AS file, wanted AS name FROM ask WHERE wanted <> '')"


@query(f"WITH RECURSIVE {SYMBOLS}, {CALLS}, {WALK}, cand AS (SELECT file, caller, text, file AS kf, CASE WHEN head = 'this' AND in_class IS NOT NULL THEN in_class || '.' || rest ELSE text END AS kn, 1 AS rank FROM cl UNION ALL SELECT a.file, caller, text, def_file, CASE WHEN symbol <> '*' AND rest <> '' THEN def_name || '.' || rest ELSE def_name END, 2 FROM ask a JOIN sym s ON s.file = a.to_file AND s.name = a.wanted) SELECT DISTINCT caller, callee FROM (SELECT c.file, caller, text, arg_min(s.file || '#' || s.name, rank) AS callee FROM cand c JOIN sdefs s ON s.file = kf AND s.name = kn GROUP BY 1, 2, 3)")
def g24_function_graph(spark, d):
    p = lambda n: part(spark, d, n)
    return Y.script_call_edges(p("scalls"), p("sdefs"), p("simports"), p("sreexports"), p("sstars"))


# Components: one per file, in groups of forty that render each other, with cycles; a tenth are pages.
COMPONENTS = {
    "ccomps": "SELECT fid, path AS file, 'Card' || CAST(fid AS STRING) AS name, path || '#Card' || CAST(fid AS STRING) AS id FROM files",
    "ctags": """SELECT f.path AS file, f.path || '#Card' || CAST(f.fid AS STRING) AS component, 'Tag' || CAST(k AS STRING) AS tag, g.path AS to_file, 'Card' || CAST(g.fid AS STRING) AS symbol
        FROM (SELECT fid, path, k, fid - fid % 40 + (fid % 40 * (2 + k) + k) % 40 AS other FROM files, (VALUES (0), (1)) AS s(k) WHERE fid % 4 <> 3 OR k = 0) f JOIN files g ON g.fid = f.other WHERE f.fid % 5 <> 4""",
}
COMPONENT_SQL = WITH[5:] + ",\n" + ",\n".join(f"{k} AS ({v})" for k, v in COMPONENTS.items())


def component_part(spark, d, name):
    def build():
        fact(spark, d, "files").createOrReplaceTempView("strata_files")
        return spark.sql("WITH files AS (SELECT * FROM strata_files) " + COMPONENTS[name])

    return once(spark, name, d, build)


def component_graph(spark, d):
    tags, comps = component_part(spark, d, "ctags"), component_part(spark, d, "ccomps")
    none = tags.limit(0)
    # a barrel file re-exports every component under another name, so tags are resolved through it
    barrel = comps.select(F.lit("barrel").alias("file"), F.concat(F.lit("X"), "name").alias("name"), F.col("file").alias("to_file"), F.col("name").alias("to_name"), F.lit(0).alias("ord"))
    imports = tags.select("file", F.col("tag").alias("alias"), F.lit("barrel").alias("to_file"), F.concat(F.lit("X"), "symbol").alias("symbol"))
    return once(spark, "component_edges", d, lambda: K.component_edges(tags, comps.select("file", "name"), imports, barrel, none.select("file", "to_file", F.lit(0).alias("ord"))))


@query(f"WITH {COMPONENT_SQL} SELECT DISTINCT component AS src, to_file || '#' || symbol AS dst FROM ctags")
def g25_component_graph(spark, d):
    return component_graph(spark, d)


@query(f"""WITH RECURSIVE {COMPONENT_SQL}, ce AS (SELECT DISTINCT component AS src, to_file || '#' || symbol AS dst FROM ctags), pg AS (SELECT '/p' || CAST(fid AS STRING) AS page, id FROM ccomps WHERE fid % 10 = 0), rc(page, root, id) AS (SELECT page, id, id FROM pg UNION SELECT rc.page, rc.root, ce.dst FROM rc JOIN ce ON ce.src = rc.id),
facts AS (SELECT id, CASE fid % 3 WHEN 0 THEN 'state' WHEN 1 THEN 'call' ELSE 'nav' END AS kind, CAST(fid % 6 AS STRING) AS value FROM ccomps WHERE fid % 4 = 1)
SELECT page, coalesce((SELECT string_agg(DISTINCT c.name, ',' ORDER BY c.name) FROM rc JOIN ccomps c ON c.id = rc.id WHERE rc.page = pg.page AND rc.id <> rc.root), '') AS components, coalesce((SELECT string_agg(DISTINCT c.name, ',' ORDER BY c.name) FROM ce JOIN ccomps c ON c.id = ce.dst WHERE ce.src = pg.id AND ce.dst <> pg.id), '') AS direct,
coalesce((SELECT string_agg(DISTINCT f.kind || ':' || f.value, ',' ORDER BY f.kind || ':' || f.value) FROM rc JOIN facts f ON f.id = rc.id WHERE rc.page = pg.page), '') AS facts FROM pg""")
def g25_page_components(spark, d):
    comps = component_part(spark, d, "ccomps")
    pages = comps.filter("fid % 10 = 0").select(F.concat(F.lit("/p"), F.col("fid").cast("string")).alias("page"), "id")
    kind = F.when(F.col("fid") % 3 == 0, "state").when(F.col("fid") % 3 == 1, "call").otherwise("nav")
    facts = comps.filter("fid % 4 = 1").select("id", kind.alias("kind"), (F.col("fid") % 6).cast("string").alias("value"))
    x = K.page_components(pages, comps, component_graph(spark, d), facts)
    return x.select("page", *(F.array_join(c, ",").alias(c) for c in ("components", "direct", "facts")))
