"""Roll-ups and look-ups over extracted facts: endpoints, modules, imports, features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def path_prefixes(path: Column) -> Column:
    """The path itself and each of its directories, longest first."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.size(parts), F.lit(1), F.lit(-1)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))


def module_of(files: DataFrame, path: str, modules: DataFrame, module_path: str, order: str) -> DataFrame:
    """Each file with the first module (by ``order``) whose path is the file's or a directory above it.

    Prefixes are exploded, so the look-up is an equi join. Files without a module keep nulls.
    """
    at = files.select(F.col(path).alias("__file")).distinct().select("__file", F.explode(path_prefixes(F.col("__file"))).alias("__prefix"))
    first = at.join(modules, F.col("__prefix") == F.col(module_path)).groupBy("__file").agg(F.min_by(F.struct(*modules.columns), F.col(order)).alias("__module"))
    return files.join(first, F.col(path) == F.col("__file"), "left").select(*files.columns, *(F.col("__module")[c].alias(c) for c in modules.columns))


def domain_of(module: Column, rules: list[tuple[str, str]]) -> Column:
    """Domain of the first rule (pattern, domain) that fits; a pattern is exact or ends in ``*``."""
    fits = lambda p: module.startswith(p[:-1]) if p.endswith("*") else module == p
    return F.coalesce(*(F.when(fits(p), F.lit(d)) for p, d in rules), F.lit(None).cast("string"))


def distinct_ids(df: DataFrame, signature: str, file: str, to: str = "id") -> DataFrame:
    """Second and later occurrences of a signature get `` (file)`` added."""
    k = F.row_number().over(Window.partitionBy(signature).orderBy(file))
    return df.withColumn(to, F.when(k == 1, F.col(signature)).otherwise(F.concat(signature, F.lit(" ("), F.col(file).cast("string"), F.lit(")"))))


def crud_resources(endpoints: DataFrame, resource: str, method: str, read: str = "GET", create: str = "POST", update: tuple[str, ...] = ("PATCH", "PUT")) -> DataFrame:
    """Resources whose methods cover reading, creating and updating."""
    m = endpoints.groupBy(resource).agg(F.collect_set(F.upper(method)).alias("__m"))
    return m.filter(F.array_contains("__m", read) & F.array_contains("__m", create) & F.arrays_overlap("__m", F.array(*map(F.lit, update)))).select(resource)


def feature_arcs(specs: DataFrame, tags: str, sprint: str, item: str) -> DataFrame:
    """Per tag and sprint: features and distinct items; the tag's total counts an item of several sprints once.

    A spec counts once for a tag. Specs without tags are left out.
    """
    x = specs.select(F.explode(F.array_distinct(tags)).alias("tag"), F.col(sprint).alias("sprint"), F.col(item).alias("item"))
    each = x.groupBy("tag", "sprint").agg(F.count(F.lit(1)).alias("features"), F.count_distinct("item").alias("items"))
    return each.join(x.groupBy("tag").agg(F.count_distinct("item").alias("total_items")), "tag")


def majority(df: DataFrame, name: str, value: str) -> DataFrame:
    """The most frequent value of each name, ties to the smaller value."""
    n = df.groupBy(name, value).agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy(name).agg(F.min_by(F.struct(value, "n"), F.struct(-F.col("n"), F.col(value))).alias("b")).select(name, f"b.{value}", "b.n")


def merged(base: DataFrame, over: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Full outer join on ``keys`` in which the non-null columns of ``over`` win."""
    b = over.select(*keys, *(F.col(c).alias(f"__{c}") for c in columns))
    return base.join(b, keys, "full_outer").select(*keys, *(F.coalesce(f"__{c}", c).alias(c) for c in columns))


def layer_usage(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Per layer of nodes (id, layer): nodes, edges that leave them, and those into another layer."""
    a, b = nodes.select(F.col("id").alias("src"), F.col("layer").alias("la")), nodes.select(F.col("id").alias("dst"), F.col("layer").alias("lb"))
    e = edges.join(a, "src").join(b, "dst").groupBy(F.col("la").alias("layer")).agg(F.count(F.lit(1)).alias("edges"), F.count(F.when(F.col("la") != F.col("lb"), 1)).alias("cross_layer_out"))
    return nodes.groupBy("layer").agg(F.count(F.lit(1)).alias("nodes")).join(e, "layer", "full_outer").fillna(0, ["nodes", "edges", "cross_layer_out"])


def alerts(delta: Column, layers: Column, total: Column, growth: Column) -> Column:
    """Alert strings in order; ``layers`` is an array of (layer, status)."""
    bad = F.array(F.lit("warning"), F.lit("critical"))
    one = lambda when, text: F.when(when, F.array(text)).otherwise(F.array().cast("array<string>"))
    return F.concat(
        one(delta.isin("drift", "critical"), F.concat(F.lit("delta:"), delta)),
        F.transform(F.filter(layers, lambda x: F.array_contains(bad, x["status"])), lambda x: F.concat(F.lit("capacity:"), x["layer"], F.lit(":"), x["status"])),
        one(total.isin("warning", "critical"), F.concat(F.lit("capacity:total:"), total)),
        one(growth == "critical", F.lit("growth:edges")),
    )


def model_weight(usage: Column, relations: Column, fields: Column) -> Column:
    return usage * 4 + relations * 2 + F.least(fields, F.lit(10))


def unmatched(calls: DataFrame, endpoints: DataFrame, key: str) -> DataFrame:
    """(status, key): endpoints that nothing calls and calls without an endpoint."""
    a, b = calls.select(key).distinct(), endpoints.select(key).distinct()
    return b.join(a, key, "left_anti").select(F.lit("unused").alias("status"), key).unionByName(a.join(b, key, "left_anti").select(F.lit("unmatched").alias("status"), key))


def by_maximum(x: Column, level: str, floor: float = 1.0) -> Column:
    """``x`` over the maximum of its level, the maximum being ``floor`` at least."""
    return x / F.greatest(F.max(x).over(Window.partitionBy(level)).cast("double"), F.lit(floor))


def numeric_key(key: Column) -> Column:
    """Number formed by a key's digits, for sorting sprint keys."""
    return F.regexp_replace(key, r"\D", "").try_cast("long")


def longest_module(files: DataFrame, path: str, modules: DataFrame, module_path: str) -> DataFrame:
    """Each file with the module of the longest path that is a directory above it."""
    at = files.select(F.col(path).alias("__file")).distinct().select("__file", F.explode(F.slice(path_prefixes(F.col("__file")), F.lit(2), F.greatest(F.size(F.split("__file", "/")) - 1, F.lit(0)))).alias("__prefix"))
    best = at.join(modules, F.col("__prefix") == F.col(module_path)).groupBy("__file").agg(F.max_by(F.struct(*modules.columns), F.length("__prefix")).alias("__module"))
    return files.join(best, F.col(path) == F.col("__file"), "left").select(*files.columns, *(F.col("__module")[c].alias(c) for c in modules.columns))


def subsystem(module_path: Column, file: Column) -> Column:
    """The first folder of a file below its module; 'root' for files right there."""
    rel = F.when(F.startswith(file, F.concat(module_path, F.lit("/"))), F.substr(file, F.length(module_path) + 2)).otherwise(file)
    parts = F.filter(F.split(rel, "/"), lambda s: s != "")
    return F.when((F.size(parts) == 0) | ((F.size(parts) == 1) & F.get(parts, 0).contains(".")), "root").otherwise(F.get(parts, 0))


def subsystem_counts(files: DataFrame, endpoints: DataFrame, models: DataFrame) -> DataFrame:
    """(module, part, files, endpoints, models) from tables of (module, part)."""
    names = ["files", "endpoints", "models"]
    one = [df.select("module", "part", *(F.lit(int(n == to)).alias(n) for n in names)) for df, to in zip((files, endpoints, models), names, strict=True)]
    return one[0].unionByName(one[1]).unionByName(one[2]).groupBy("module", "part").agg(*(F.sum(n).alias(n) for n in names))


def access_edges(uses: DataFrame) -> DataFrame:
    """(module, src, dst, label): which parts of a module read or write models of another part; uses has (module, src, dst, access)."""
    x = uses.filter("src <> dst").groupBy("module", "src", "dst").agg(F.bool_or(F.col("access").isin("read", "read_write")).alias("r"), F.bool_or(F.col("access").isin("write", "read_write")).alias("w"))
    return x.select("module", "src", "dst", F.when(F.col("r") & F.col("w"), "read/write").when(F.col("w"), "write").otherwise("read").alias("label"))


def human_group(path: Column, id_: Column) -> Column:
    """The first service folder of a module's path, else the first that isn't backend or src, else its id."""
    parts = F.filter(F.split(path, "/"), lambda s: s != "")
    return F.coalesce(F.get(F.filter(parts, lambda s: s.startswith("service-")), 0), F.get(F.filter(parts, lambda s: ~s.isin("backend", "src")), 0), id_)


def triggered_tasks(tasks: DataFrame, calls: DataFrame) -> DataFrame:
    """(task, eid): calls that are a task's name, its bare name, or end in a dot and that; the ends of calls are joined by equality."""
    t = tasks.select(F.col("name").alias("task"), F.explode(F.array_distinct(F.array(F.col("name"), F.regexp_replace("name", r"^[^.]+\.", "")))).alias("key"), F.regexp_replace("name", r"^[^.]+\.", "").alias("bare"))
    parts = F.split("call", r"\.")
    ends = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts) - i + 1), "."))
    x = calls.select("eid", "call", F.explode(ends).alias("key")).join(t, "key")
    return x.filter((F.col("call") == F.col("key")) | (F.col("key") == F.col("bare"))).select("task", "eid").distinct()


def workflow_candidates(endpoints: DataFrame, calls: DataFrame, most: int = 8) -> DataFrame:
    """(eid, n_calls, actors, important): endpoints of more than two calls, the first call of each actor in order."""
    actor = F.when(F.col("call").contains("."), F.split_part("call", F.lit("."), F.lit(1))).otherwise("Service")
    n = calls.groupBy("eid").agg(F.count(F.lit(1)).alias("n_calls")).filter("n_calls > 2")
    top = endpoints.filter("path <> '/health'").join(n, "eid").orderBy(F.desc("n_calls"), "eid").limit(most).select("eid", "method", "n_calls")
    telling = calls.filter(~F.col("call").isin("str", "dict", "len", "int", "float", "join", "getattr", "max", "lower", "open") & ~F.col("call").rlike(r"^(params|updates)\."))
    first = telling.join(F.broadcast(top.select("eid")), "eid", "left_semi").groupBy("eid", actor.alias("actor")).agg(F.min("k").alias("k"))
    a = first.groupBy("eid").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "actor"))), lambda s: s["actor"]).alias("actors"))
    return top.join(a, "eid").select("eid", "n_calls", "actors", ((F.col("method") == "POST") & (F.size("actors") >= 3)).alias("important"))


def import_statements(names: DataFrame, imports: DataFrame) -> DataFrame:
    """(name, statement): the most frequent specifier of a name (ties to the smaller), else the module path of its file."""
    best = majority(imports.select("name", "specifier"), "name", "specifier").select("name", "specifier")
    derived = F.regexp_replace(F.regexp_replace("file", r"\.py$", ""), "/", ".")
    x = names.join(best, "name", "left")
    return x.select("name", F.concat(F.lit("from "), F.coalesce("specifier", derived), F.lit(" import "), "name").alias("statement"))


def constraints_packet(cycles: DataFrame, duplicates: DataFrame, similar: DataFrame, endpoints: DataFrame, modules: DataFrame, models: DataFrame, cross: DataFrame, status: DataFrame, most: int = 20) -> DataFrame:
    """(section, ord, item): what a change must respect, one row per item.

    cycles (id); duplicates (hash, n, size), largest first; similar (a, b, similarity), most similar first;
    endpoints (eid, name) in their order: pairs whose path words overlap by 0.8; modules (id);
    models (name); cross (src, dst): edges that leave the allowed flow; status (delta, status).
    Lists of pairs and duplicates are cut to ``most``; the cut is a top-k, all else is whole.
    """
    from .code import overlapping

    words = F.array_distinct(F.filter(F.split(F.regexp_replace(F.lower("name"), "[^a-z0-9/]+", " "), r"[/\s]+"), lambda w: w != ""))
    pairs = overlapping(endpoints.select(F.col("eid").alias("id"), words.alias("members")).filter(F.size("members") > 0), 0.8, 2, first=most)
    name = lambda c: endpoints.select(F.col("eid").alias(c), F.col("name").alias(f"name_{c}"))
    pairs = pairs.join(name("a"), "a").join(name("b"), "b")

    def section(to: str, df: DataFrame, item: Column, order: list[Column]) -> DataFrame:
        return df.select(F.lit(to).alias("section"), F.row_number().over(Window.partitionBy(F.lit(to)).orderBy(*order)).alias("ord"), item.alias("item"))

    top = lambda df, *order: df.orderBy(*order).limit(most)
    plain = lambda to, df, item: df.select(F.lit(to).alias("section"), F.lit(0).alias("ord"), item.alias("item")).distinct()
    big, near = (F.desc("size"), F.desc("n"), F.col("hash")), (F.desc("similarity"), F.col("a"), F.col("b"))
    parts = [
        section("duplicate", top(duplicates, *big), F.concat_ws(":", "hash", "n", "size"), list(big)),
        section("similar", top(similar, *near), F.concat_ws(":", "a", "b", F.format_string("%.3f", F.col("similarity").cast("double"))), list(near)),
        section("related_endpoints", pairs, F.concat_ws(" ~ ", "name_a", "name_b", F.format_string("%.3f", F.col("similarity").cast("double"))), [F.col("a"), F.col("b")]),
        plain("cycle_risk", cycles, F.col("id")), plain("module", modules, F.col("id")), plain("endpoint", endpoints, F.col("name")), plain("model", models, F.col("name")),
        plain("cross_layer", cross, F.concat_ws(" -> ", "src", "dst")), plain("status", status, F.col("status")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
