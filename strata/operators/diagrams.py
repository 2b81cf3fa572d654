"""Edges of the diagrams of a code base, as tables; drawing them is left to others."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .code import foreign_keys, service_edges
from .substrings import containing

# Parts of call names that tell what a call talks to, and the nodes outside the code.
PROXIES = ["_proxy_to_", "httpx", "AsyncClient"]
STORES = ["db_pool", "conn."]
PAGES, STORE, OUTSIDE, MODEL_PROVIDER, OTHER_API = "Pages", "Postgres", "External", "LLM Provider", "External API"


def any_of(call: Column, parts: list[str]) -> Column:
    """Whether a call's name has one of the parts; null names have none."""
    return F.coalesce(F.greatest(*(call.contains(p).cast("int") for p in parts), F.lit(0)) > 0, F.lit(False))


def enough(edges: DataFrame, modules: DataFrame, least: int = 2) -> DataFrame:
    """The edges if there are ``least`` modules, else none."""
    return edges.join(modules.agg((F.count(F.lit(1)) >= least).alias("__ok")), F.col("__ok")).drop("__ok")


def page_modules(calls: DataFrame, endpoints: DataFrame) -> DataFrame:
    """(module): modules of the endpoints that pages call.

    calls (path), endpoints (ord, path, module). A call is of the first endpoint by ``ord`` whose path
    up to its first parameter, without a slash at the end, is part of the call's path.
    """
    stem = F.regexp_replace(F.split_part("path", F.lit("{"), F.lit(1)), "/$", "")
    first = endpoints.groupBy(stem.alias("pattern")).agg(F.min(F.struct("ord", "module")).alias("first"))
    texts = calls.select("path").distinct().select(F.col("path").alias("id"), F.col("path").alias("text"))
    found = containing(texts, first.select("pattern")).join(first, "pattern").groupBy("id").agg(F.min("first").alias("first"))
    return found.select("first.module").distinct()


def system_edges(modules: DataFrame, imports: DataFrame, page_calls: DataFrame, endpoints: DataFrame, calls: DataFrame) -> DataFrame:
    """(src, dst, kind) of the whole system: pages, modules, the data store and what is outside.

    modules (id), imports (from_module, to_module), page_calls (path), endpoints (eid, path, module),
    calls (eid, call). Pages lead to the modules that they call, or, if no call is known, to every module
    with endpoints; without pages there are no such edges. The first module by id with a proxy call
    leads outside. Fewer than two modules give no edges.
    """
    known = modules.select(F.col("id").alias("module"))
    said = calls.join(endpoints.select("eid", "module"), "eid").join(known, "module", "left_semi")
    called = page_modules(page_calls, endpoints.select(F.col("eid").alias("ord"), "path", "module")).withColumn("found", F.lit(1))
    every = endpoints.select("module").distinct().join(known, "module", "left_semi").join(page_calls.select(F.lit(1).alias("p")).limit(1), how="cross").select("module", F.lit(0).alias("found"))
    pages = called.unionByName(every).withColumn("best", F.max("found").over(Window.partitionBy(F.lit(0)))).filter("found = best").select("module").distinct()  # a row per module
    edge = lambda df, src, dst, kind: df.select(src.alias("src"), dst.alias("dst"), F.lit(kind).alias("kind"))
    inner = imports.join(known.select(F.col("module").alias("from_module")), "from_module", "left_semi").join(known.select(F.col("module").alias("to_module")), "to_module", "left_semi").distinct()
    stores = said.filter(any_of(F.col("call"), STORES)).select("module").distinct()
    out = said.filter(any_of(F.col("call"), PROXIES[:1])).agg(F.min("module").alias("module")).filter("module is not null")
    parts = [
        edge(pages, F.lit(PAGES), F.col("module"), "calls"), edge(inner, F.col("from_module"), F.col("to_module"), "imports"),
        edge(stores, F.col("module"), F.lit(STORE), "stores"), edge(out, F.col("module"), F.lit(OUTSIDE), "proxy"),
    ]
    return enough(parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3]), modules)


def cross_service_edges(modules: DataFrame, imports: DataFrame, endpoints: DataFrame, calls: DataFrame, models: DataFrame) -> DataFrame:
    """(src, dst, label): imports between modules, calls outside ('proxy'), calls of classes that live in another module.

    modules (id, path), endpoints (eid, module), calls (eid, call), models (name, file); the rest as for ``system_edges``.
    """
    known = modules.select("id")
    inner = imports.join(known.toDF("from_module"), "from_module", "left_semi").join(known.toDF("to_module"), "to_module", "left_semi").distinct()
    proxied = calls.filter(any_of(F.col("call"), PROXIES)).join(endpoints.select("eid", "module"), "eid")
    outside = F.when(F.col("call").contains("openai"), MODEL_PROVIDER).otherwise(OTHER_API)
    parts = [
        inner.select(F.col("from_module").alias("src"), F.col("to_module").alias("dst"), F.lit("imports").alias("label")),
        proxied.select(F.col("module").alias("src"), outside.alias("dst"), F.lit("proxy").alias("label")).distinct(),
        service_edges(models, modules, endpoints, calls).select(F.col("from_module").alias("src"), F.col("to_module").alias("dst"), "label"),
    ]
    return enough(parts[0].unionByName(parts[1]).unionByName(parts[2]).distinct(), modules)


def entity_edges(models: DataFrame, fields: DataFrame, framework: str = "sqlalchemy", cap: int = 20) -> DataFrame:
    """(source, target): foreign keys between models of one framework, among the first ``cap`` connected models by ``mid``.

    models (mid, name, framework), fields (name, foreign_key). Fewer than two connected models give no edges.
    """
    some = models.filter(F.col("framework") == framework)
    edges = foreign_keys(some, fields.join(some.select("name"), "name", "left_semi"))
    ends = edges.select(F.explode(F.array("source", "target")).alias("name")).distinct()
    kept = some.join(ends, "name", "left_semi").select("mid", "name").orderBy("mid", "name").limit(cap).select("name")
    for c in ("source", "target"):
        edges = edges.join(kept.select(F.col("name").alias(c)), c, "left_semi")
    return edges.select("source", "target")
