"""Queries of manifests, Markdown sections and project roots over files derived from the driver's tables, each beside the SQL that it must equal."""

from __future__ import annotations

from pyspark.sql import functions as F

from strata.sources import documents as D
from strata.sources import roots as R

from .catalogue import query, table


def suppliers(spark, d):
    k = F.col("s_suppkey")
    return table(spark, d, "supplier").select(k.cast("long").alias("k"), k.cast("string").alias("t"))


@query("""WITH s AS (SELECT s_suppkey AS k, CAST(s_suppkey AS VARCHAR) AS t FROM supplier) SELECT 'npm' AS kind, 'scripts' AS section, 'dev' AS name, 'run ' || t AS value, 'p' || t || '/package.json' AS path FROM s WHERE k % 6 = 0 UNION ALL SELECT 'npm', 'dependencies', 'lib', t, 'p' || t || '/package.json' FROM s WHERE k % 6 = 0
UNION ALL SELECT 'make', 'targets', 'all', 'dep' || t, 'p' || t || '/Makefile' FROM s WHERE k % 6 = 1 UNION ALL SELECT 'go', 'dependencies', 'a/b' || t, 'v1.' || t, 'p' || t || '/go.mod' FROM s WHERE k % 6 = 2 UNION ALL SELECT 'docker', 'docker', unnest(['FROM', 'CMD']), unnest(['img' || t, 'go']), 'p' || t || '/Dockerfile' FROM s WHERE k % 6 = 3
UNION ALL SELECT 'compose', unnest(['services', 'depends_on']), 'db', unnest(['pg' || t, 'web']), 'p' || t || '/docker-compose.yml' FROM s WHERE k % 6 = 4 UNION ALL SELECT 'python', unnest(['scripts', 'dependencies', 'dependencies']), unnest(['run', 'lib' || t, 'web']), unnest(['a:main', 'lib' || t || '>=1', 'web[all]']), 'p' || t || '/pyproject.toml' FROM s WHERE k % 6 = 5""")
def s12_manifest_entries(spark, d):
    """A manifest per supplier, of six kinds."""
    s, t = suppliers(spark, d), F.col("t")
    kinds = {
        "package.json": F.concat(F.lit('{"scripts": {"dev": "run '), t, F.lit('"}, "dependencies": {"lib": "'), t, F.lit('"}}')), "Makefile": F.concat(F.lit("all: dep"), t, F.lit("\n\techo\nV := 1\n")), "go.mod": F.concat(F.lit("module x\n\nrequire a/b"), t, F.lit(" v1."), t, F.lit("\n")),
        "Dockerfile": F.concat(F.lit("FROM img"), t, F.lit("\nRUN x\nCMD go\n")), "docker-compose.yml": F.concat(F.lit("services:\n  db:\n    image: pg"), t, F.lit("\n    depends_on: [web]\n")),
        "pyproject.toml": F.concat(F.lit('[project]\nname = "x"\ndependencies = [\n  "lib'), t, F.lit('>=1",\n  "web[all]",\n]\n\n[project.scripts]\nrun = "a:main"\n\n[tool.x]\ny = "z"\n')),
    }
    pick = lambda values: F.element_at(F.array(*values), (F.col("k") % len(kinds) + 1).cast("int"))
    return D.manifests(s.select(F.concat(F.lit("p"), t, F.lit("/"), pick(map(F.lit, kinds))).alias("path"), pick(kinds.values()).alias("content")))


@query("SELECT s_suppkey AS k, CASE WHEN s_suppkey % 4 = 0 THEN '' ELSE 'step ' || CAST(s_suppkey AS VARCHAR) || chr(10) || '### More' || chr(10) || 'x' END AS section FROM supplier")
def s13_markdown_sections(spark, d):
    """The section Setup of a file per supplier; a quarter of the files have none."""
    head = F.when(F.col("k") % 4 == 0, "## Other").otherwise("## Setup  ")
    rest = F.when(F.col("k") % 3 == 0, "## Rest").otherwise("# End")
    text = F.concat(F.lit("# T\nintro\n"), head, F.lit("\n\nstep "), F.col("t"), F.lit("\n### More\nx\n"), rest, F.lit("\nlast"))
    return D.sections(suppliers(spark, d).select("k", text.alias("content")), "Setup").select("k", "section")


@query("""WITH s AS (SELECT s_suppkey AS k FROM supplier), c AS (SELECT k, 'backend' AS kind, 'backend' AS folder, 9 AS score FROM s WHERE k % 2 = 0 UNION ALL SELECT k, 'backend', 'api', 9 FROM s WHERE k % 12 = 2 UNION ALL SELECT k, 'backend', 'services', 14 + CAST(k % 8 = 1 AS INTEGER) FROM s WHERE k % 4 = 1 UNION ALL SELECT k, 'backend', 'srv', 4 FROM s WHERE k % 6 = 5
UNION ALL SELECT k, 'backend', '', 10 + 4 * CAST(k % 7 = 0 AS INTEGER) FROM s WHERE k % 6 = 0 AND k % 13 <> 4 UNION ALL SELECT k, 'frontend', 'web', 5 + 7 * CAST(k % 3 = 0 AS INTEGER) + 8 * CAST(k % 5 = 0 AS INTEGER) + 4 * CAST(k % 9 = 0 AS INTEGER) FROM s WHERE k % 13 <> 4 UNION ALL SELECT k, 'frontend', 'client', 13 FROM s WHERE k % 10 = 3 UNION ALL SELECT k, 'frontend', '', 7 FROM s WHERE k % 7 = 0),
b AS (SELECT *, row_number() OVER w AS n, lead(score) OVER w AS second FROM c WINDOW w AS (PARTITION BY k, kind ORDER BY score DESC, folder)), e AS (SELECT k, unnest(['backend', 'frontend']) AS kind FROM s)
SELECT 'w' || CAST(e.k AS VARCHAR) AS root, e.kind, CASE WHEN score = second OR score IS NULL THEN '' WHEN e.kind = 'backend' AND folder = '' THEN 'backend' ELSE folder END AS folder, CAST(coalesce(score, 0) AS BIGINT) AS score, CASE WHEN score IS NULL THEN 'none' WHEN score = second THEN 'ambiguous' ELSE 'found' END AS status FROM e LEFT JOIN b ON b.k = e.k AND b.kind = e.kind AND n = 1""")
def s15_project_roots(spark, d):
    """A workspace per supplier, with folders that its key decides on."""
    k = F.col("k")
    has_web = k % 13 != 4
    tree = [
        (F.lit(True), "README.md", ""), (k % 2 == 0, "backend/pyproject.toml", ""), (has_web & (k % 3 == 0), "web/package.json", '{"dependencies": {"react": "1"}}'), (has_web & (k % 3 != 0), "web/index.html", ""), (has_web & (k % 5 == 0), "web/next.config.js", ""),
        (k % 4 == 1, "services/a/requirements.txt", ""), (k % 4 == 1, "services/b/package.json", ""), (k % 8 == 1, "services/c/pyproject.toml", ""), (k % 7 == 0, "package.json", '{"dependencies": {"express": "1", "vue": "2"}}'), (k % 6 == 5, "srv/main.py", "app = FastAPI()"),
        (has_web & (k % 9 == 0), "web/src/pages/x.tsx", ""), (k % 10 == 3, "client/vite.config.ts", ""), (k % 10 == 3, "client/tsconfig.json", ""), (k % 11 == 0, "node_modules/pyproject.toml", ""), (k % 12 == 2, "api/manage.py", ""),
    ]
    files = F.array_compact(F.array(*(F.when(c, F.struct(F.lit(p).alias("path"), F.lit(t).alias("content"))) for c, p, t in tree)))
    return R.project_roots(suppliers(spark, d).select(F.concat(F.lit("w"), "t").alias("root"), F.explode(files).alias("f")).select("root", "f.*"))
