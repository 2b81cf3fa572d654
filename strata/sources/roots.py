"""Roots of the back end and front end of many workspaces, by scored folders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Names that tell what a folder is, and the weight of each sign.
BACKEND_NAMES, FRONTEND_NAMES = ["backend", "services", "api"], ["frontend", "web", "client", "ui"]
PYTHON_FILES, SERVICE_FILES = ["pyproject.toml", "requirements.txt", "manage.py"], ["pyproject.toml", "requirements.txt", "package.json"]
NEXT_FILES, VITE_FILES = ["next.config.js", "next.config.mjs", "next.config.ts"], ["vite.config.ts", "vite.config.js"]
MARKERS, ROUTES = ["main.py", "app.py", "server.py", "index.js", "server.js"], ["app/", "pages/", "src/app/", "src/pages/"]
NODE_BACKEND, NODE_FRONTEND, SERVER = "(?i)(express|fastify|nest|koa)", "(?i)(next|react|vue|svelte)", r"FastAPI|APIRouter|Flask|Django|express\(|NestFactory"
IGNORED = [".git", "node_modules", ".next", "dist", "build", "coverage", "__pycache__", ".venv", "venv", ".specs", ".pytest_cache", ".mypy_cache", ".turbo"]
#: A workspace itself needs this score to be a candidate.
LEAST = 5


def scored(files: DataFrame) -> DataFrame:
    """(root, kind, folder, score, homes): each workspace's top folder ('') and the folders in it that score at all.

    files (root, path, content), paths relative to the workspace; homes are the folders backend,
    services and src that a folder has. Null contents count as empty. Each file tells something
    about two folders at most; what it tells is summed by grouped aggregation.
    """
    parts = F.split("path", "/")
    top = F.struct(F.lit("").alias("folder"), F.col("path").alias("rest"))
    below = F.struct(F.get(parts, 0).alias("folder"), F.array_join(F.slice(parts, 2, 1_000_000), "/").alias("rest"))
    both = F.when((F.size(parts) > 1) & ~F.get(parts, 0).isin(IGNORED), F.array(top, below)).otherwise(F.array(top))
    x = files.select("root", F.coalesce("content", F.lit("")).alias("content"), F.explode(both).alias("x")).select("root", "content", "x.*").withColumn("p", F.split("rest", "/"))
    name, child = F.get("p", 0), F.when((F.size("p") > 1) & ~F.get("p", 0).isin(IGNORED), F.get("p", 0))
    is_file = F.size("p") == 1
    any_ = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    signs = x.groupBy("root", "folder").agg(
        any_(name.isin(PYTHON_FILES)).alias("python"), any_(name == "package.json").alias("package"), any_(is_file & (name == "package.json") & F.col("content").rlike(NODE_BACKEND)).alias("node"),
        any_(is_file & (name == "package.json") & F.col("content").rlike(NODE_FRONTEND)).alias("front"), any_(is_file & name.isin(MARKERS) & F.col("content").rlike(SERVER)).alias("marker"),
        F.count_distinct(F.when(F.get("p", 1).isin(SERVICE_FILES), child)).alias("services"), any_(name.isin(NEXT_FILES)).alias("next"), any_(name.isin(VITE_FILES)).alias("vite"), any_(name == "tsconfig.json").alias("tsconfig"),
        *(any_(F.col("rest").startswith(r)).alias(f"route{i}") for i, r in enumerate(ROUTES)), *(any_((F.size("p") > 1) & (name == h)).alias(f"has_{h}") for h in ("backend", "services", "src")),
    )
    base = F.lower(F.regexp_extract(F.when(F.col("folder") == "", F.col("root")).otherwise(F.col("folder")), "[^/]*$", 0))
    worth = lambda c, w: F.when(c, w).otherwise(0)
    back: Column = worth(base.isin(BACKEND_NAMES), 4) + worth(F.col("python"), 5) + worth(F.col("node"), 4) + worth(F.col("services") >= 2, F.col("services") + 8) + worth(F.col("marker"), 4)
    front: Column = worth(base.isin(FRONTEND_NAMES), 5) + worth(F.col("next"), 8) + worth(F.col("vite"), 7) + worth(F.col("package"), 3) + worth(F.col("front"), 4) + worth(F.col("tsconfig"), 1)
    for i in range(len(ROUTES)):
        front = front + worth(F.col(f"route{i}"), 4)
    homes = F.array_compact(F.array(*(F.when(F.col(f"has_{h}"), F.lit(h)) for h in ("backend", "services", "src"))))
    kinds = F.array(F.struct(F.lit("backend").alias("kind"), back.cast("long").alias("score")), F.struct(F.lit("frontend").alias("kind"), front.cast("long").alias("score")))
    y = signs.select("root", "folder", homes.alias("homes"), base.alias("base"), F.explode(kinds).alias("k")).select("root", "k.kind", "folder", "k.score", "homes", "base")
    return y.filter((F.col("score") > 0) & ((F.col("folder") != "") | (F.col("score") >= LEAST)))


def project_roots(files: DataFrame) -> DataFrame:
    """(root, kind, folder, score, status) of each workspace, for back end and front end.

    status is found, ambiguous (two folders share the best score) or none; then folder is '', the
    workspace itself. A back end that isn't itself a folder named backend, src or services is the first such folder in it.
    """
    w = Window.partitionBy("root", "kind").orderBy(F.desc("score"), "folder")  # the top folders of one workspace
    best = scored(files).withColumn("n", F.row_number().over(w)).withColumn("second", F.lead("score").over(w)).filter("n = 1")
    every = files.select("root").distinct().select("root", F.explode(F.array(F.lit("backend"), F.lit("frontend"))).alias("kind"))
    x = every.join(best, ["root", "kind"], "left")
    status = F.when(F.col("score").isNull(), "none").when(F.col("score") == F.col("second"), "ambiguous").otherwise("found")
    home = F.get("homes", 0)
    inner = F.when((F.col("kind") == "frontend") | F.col("base").isin("backend", "src", "services") | home.isNull(), F.col("folder")).otherwise(F.concat_ws("/", F.nullif(F.col("folder"), F.lit("")), home))
    return x.select("root", "kind", F.when(status == "found", inner).otherwise("").alias("folder"), F.coalesce("score", F.lit(0)).alias("score"), status.alias("status"))
