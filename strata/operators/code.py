"""Joins and roll-ups over the facts of a code base: imports, contracts, flows, coverage, diffs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strata.functions import text as T
from strata.sources.staging import DEALT, staged

from .components import joined
from .substrings import related_paths, texts_with

SUFFIXES = [".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs", ".py"]


def joined_path(folder: Column, spec: Column) -> Column:
    """``spec`` seen from ``folder``, with '.' and '..' resolved."""
    step = lambda acc, s: F.when(s.isin("", "."), acc).when(s == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(s)))
    parts = F.split(F.concat(folder, F.lit("/"), spec), "/")
    return F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/")


def resolved_imports(imports: DataFrame, files: DataFrame) -> DataFrame:
    """(file, target) of relative imports (file, spec): the first candidate that exists.

    Candidates are the path itself, with each suffix, and its index files; each is an equi join.
    """
    base = joined_path(T.dirname(F.col("file")), F.col("spec"))
    tried = F.array(base, *(F.concat(base, F.lit(s)) for s in SUFFIXES), *(F.concat(base, F.lit(f"/index{s}")) for s in SUFFIXES))
    each = imports.filter(F.col("spec").startswith(".")).select("file", "spec", F.posexplode(tried).alias("ord", "candidate"))
    hit = each.join(files.select(F.col("path").alias("candidate")).distinct(), "candidate")
    return hit.groupBy("file", "spec").agg(F.min_by("candidate", "ord").alias("target"))


def module_edges(deps: DataFrame, files: DataFrame) -> DataFrame:
    """(src, dst, file): edges between modules with the file that imports, once each."""
    a, b = files.select(F.col("path").alias("src"), F.col("module").alias("a")), files.select(F.col("path").alias("dst"), F.col("module").alias("b"))
    x = deps.join(a, "src").join(b, "dst").filter("a <> b")
    return x.select(F.col("a").alias("from_module"), F.col("b").alias("to_module"), F.col("src").alias("file")).distinct()


def names_in_text(texts: DataFrame, id_col: str, text_col: str, names: DataFrame) -> DataFrame:
    """(id, name) where a text has a name as a whole word; words are joined, no text meets all names."""
    words = F.array_distinct(F.regexp_extract_all(F.col(text_col), F.lit(r"\w+"), 0))
    return texts.select(id_col, F.explode(words).alias("name")).join(names.select("name").distinct(), "name").distinct()


def method_of(method: Column) -> Column:
    return F.when(F.coalesce(F.length(method), F.lit(0)) > 0, F.upper(method)).otherwise("GET")


def with_key(df: DataFrame) -> DataFrame:
    return df.withColumn("m", method_of(F.col("method"))).withColumn("p", T.path_pattern(F.col("path")))


def matched_endpoints(keys: DataFrame, endpoints: DataFrame, suffixes: bool = True) -> DataFrame:
    """(m, p, eid) for call keys (m, p): endpoints of the same key, else of ANY, else with compatible paths.

    Compatible paths end in each other. A pattern begins with a slash, so only a path's ends that do are joined, by equality.
    """
    e = with_key(endpoints).select("eid", F.col("m").alias("em"), F.col("p").alias("ep"))
    k = keys.select("m", "p").distinct()
    exact = k.join(e, (F.col("m") == F.col("em")) & (F.col("p") == F.col("ep")))
    rest = k.join(exact.select("m", "p"), ["m", "p"], "left_anti")
    wild = rest.join(e.filter("em = 'ANY'"), F.col("p") == F.col("ep"))
    found = exact.unionByName(wild)
    if suffixes:
        rest = rest.join(wild.select("m", "p"), ["m", "p"], "left_anti")
        parts = lambda c: F.split(c, "/")
        ends = lambda c: F.array_distinct(F.concat(F.array(c), F.transform(F.sequence(F.lit(2), F.greatest(F.size(parts(c)), F.lit(2))), lambda i: F.concat(F.lit("/"), F.array_join(F.slice(parts(c), i, F.size(parts(c))), "/")))))
        same = (F.col("em") == "ANY") | (F.col("em") == F.col("m"))
        short = rest.withColumn("t", F.explode(ends("p"))).join(e.withColumn("t", F.col("ep")), "t")
        long = rest.withColumn("t", F.col("p")).join(e.withColumn("t", F.explode(ends("ep"))), "t")
        found = found.unionByName(short.unionByName(long).filter(same).drop("t").distinct())
    return found.select("m", "p", "eid")


def contracts(calls: DataFrame, endpoints: DataFrame, fields: DataFrame) -> DataFrame:
    """(eid, status, issues, callers) of each endpoint that a page calls (page, method, path, field, ord).

    An endpoint that several keys reach belongs to the key that was called first. Model fields are
    (name, field); issues list what either side lacks.
    """
    keyed = with_key(calls)
    groups = keyed.groupBy("m", "p").agg(F.min("ord").alias("ord"), F.array_sort(F.array_compact(F.collect_set("field"))).alias("sent"), F.array_sort(F.collect_set("page")).alias("callers"))
    # the lists of pages are joined last, so that no aggregation or sort by endpoints carries them
    hit = matched_endpoints(groups, endpoints).join(groups.select("m", "p", "ord"), ["m", "p"])
    first = hit.groupBy("eid").agg(F.min(F.struct("ord", "m", "p")).alias("g")).select("eid", "g.m", "g.p")
    known = fields.groupBy(F.col("name").alias("request_schema")).agg(F.array_sort(F.collect_set("field")).alias("known"))
    x = endpoints.select("eid", "request_schema", "response_schema").join(first, "eid").join(known, "request_schema", "left").join(groups.select("m", "p", "sent", "callers"), ["m", "p"])
    none = F.array().cast("array<string>")
    x = x.withColumn("have", F.coalesce("known", none))
    both = (F.size("have") > 0) & (F.size("sent") > 0)
    say = lambda text, items: F.transform(items, lambda f: F.concat(F.lit(f"frontend {text} field '"), f, F.lit("'")))
    issues = F.concat(
        F.when(F.col("request_schema").isNotNull() & F.col("known").isNull(), F.array(F.concat(F.lit("backend request schema '"), "request_schema", F.lit("' not extracted")))).otherwise(none),
        F.when((F.size("have") > 0) & (F.size("sent") == 0), F.array(F.lit("frontend request fields not inferred"))).otherwise(none),
        F.when(both, F.concat(say("missing", F.array_except("have", "sent")), say("extra", F.array_except("sent", "have")))).otherwise(none),
    )
    x = x.withColumn("issues", issues)
    told = F.col("request_schema").isNotNull() | F.col("response_schema").isNotNull() | (F.size("sent") > 0)
    status = F.when(F.exists("issues", lambda i: i.startswith("frontend")), "mismatched").when(told & ((F.size("have") == 0) | (F.size("issues") > 0)), "unverified").otherwise("ok")
    return x.select("eid", status.alias("status"), "issues", "callers")


def data_flows(calls: DataFrame, endpoints: DataFrame, uses: DataFrame) -> DataFrame:
    """(page, eid, models): what a page reaches by exact or ANY keys, each flow once."""
    keyed = with_key(calls).select("page", "m", "p").distinct()
    models = uses.groupBy("eid").agg(F.array_sort(F.collect_set("model")).alias("models"))
    e = with_key(endpoints).select("eid", F.col("m").alias("em"), F.col("p").alias("ep")).distinct()
    # pages meet the keys of endpoints once each; only then flows are listed, whose number is no longer in step with the input
    ends = e.select("em", "ep").distinct()
    keys = keyed.select("m", "p").distinct()
    exact = keys.join(ends, (F.col("m") == F.col("em")) & (F.col("p") == F.col("ep")))
    wild = keys.join(exact.select("m", "p"), ["m", "p"], "left_anti").join(ends.filter("em = 'ANY'"), F.col("p") == F.col("ep"))
    met = keyed.join(exact.unionByName(wild), ["m", "p"]).select("page", "em", "ep").distinct()
    often = e.groupBy("eid").agg((F.count(F.lit(1)) > 1).alias("often"))  # an eid that is given with several keys
    told = e.join(often, "eid").join(models, "eid", "left").select("em", "ep", "eid", "often", F.coalesce("models", F.array().cast("array<string>")).alias("models"))
    flows = lambda which: met.join(told.filter(which), ["em", "ep"]).select("page", "eid", "models")
    return flows(~F.col("often")).unionByName(flows(F.col("often")).distinct())


def is_test(path: Column) -> Column:
    return path.rlike(r"\.test\.|\.spec\.|_test\.|test_|^tests/|/tests/")


def tested_sources(files: DataFrame) -> DataFrame:
    """(test_file, source_file, match_type) for files (path, ord).

    The source has the test's name without its test marks: exact in the folder that the test's
    folder stands for (the first), else implicit anywhere (the last), else none.
    """
    p = F.col("path")
    name = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(T.basename(p), r"\.test\.", "."), r"\.spec\.", "."), r"_test\.", "."), "^test_", "")
    tests = files.filter(is_test(p)).select(p.alias("test_file"), name.alias("name"), F.regexp_replace(T.dirname(p), r"/tests?(/|$)", "/").alias("home"))
    sources = files.filter(~is_test(p)).select(p.alias("source_file"), T.basename(p).alias("name"), T.dirname(p).alias("dir"), "ord")
    x = tests.join(sources, "name", "left").groupBy("test_file").agg(
        F.min_by(F.when(F.col("home") == F.col("dir"), F.col("source_file")), F.when(F.col("home") == F.col("dir"), F.col("ord"))).alias("exact"), F.max_by("source_file", "ord").alias("implicit"))
    return x.select("test_file", F.coalesce("exact", "implicit").alias("source_file"), F.when(F.col("exact").isNotNull(), "exact").when(F.col("implicit").isNotNull(), "implicit").otherwise("none").alias("match_type"))


def with_tests(items: DataFrame, file_col: str, coverage: DataFrame) -> DataFrame:
    """``items`` with covered, coverage_type and test_files by their file."""
    t = coverage.filter("source_file is not null").groupBy(F.col("source_file").alias(file_col)).agg(F.array_sort(F.collect_list("test_file")).alias("test_files"))
    x = items.join(t, file_col, "left")
    hit = F.col("test_files").isNotNull()
    return x.withColumn("covered", hit).withColumn("coverage_type", F.when(hit, "file").otherwise("none")).withColumn("test_files", F.coalesce("test_files", F.array().cast("array<string>")))


def merged_suffixes(rows: DataFrame, path: str, body: str) -> DataFrame:
    """Rows whose path is the end of another row's path go into that row, with their body if it lacks it.

    All ends of a path are exploded, so this is an equi join. Of several longer paths the first by name gets it.
    Paths pack well, so their tables look small and grow by the explosion: none is broadcast.
    """
    ends = rows.select(F.col(path).alias("longer"), F.explode(F.slice(T.path_suffixes(F.col(path)), F.lit(2), F.greatest(F.size(F.split(path, "/")) - 1, F.lit(0)))).alias(path))
    moved = staged(rows.join(ends.hint("merge"), path).groupBy(path, body).agg(F.min("longer").alias("longer")), "moved")
    got = moved.groupBy(F.col("longer").alias(path)).agg(F.transform(F.array_sort(F.collect_list(F.struct(path, body))), lambda r: r[body]).alias("more"))
    x = rows.join(moved.select(path).hint("merge"), path, "left_anti").join(got.hint("merge"), path, "left")
    add = lambda acc, b: F.when((b == "") | acc.contains(b), acc).when(acc == "", b).otherwise(F.concat(acc, F.lit(" "), b))
    return x.withColumn(body, F.aggregate(F.coalesce("more", F.array().cast("array<string>")), F.coalesce(body, F.lit("")), add)).drop("more")


def service_edges(models: DataFrame, modules: DataFrame, endpoints: DataFrame, calls: DataFrame) -> DataFrame:
    """(from_module, to_module, label): calls of a class that lives in another module, once each."""
    from strata.operators.facts import module_of

    home = module_of(models.select("name", "file"), "file", modules.select("id", "path"), "path", "id").select(F.col("name").alias("label"), F.col("id").alias("to_module")).filter("to_module is not null")
    named = calls.select("eid", F.split_part("call", F.lit("."), F.lit(1)).alias("label"))
    x = named.join(home, "label").join(endpoints.select("eid", F.col("module").alias("from_module")), "eid")
    return x.filter("from_module <> to_module").select("from_module", "to_module", "label").distinct()


# Names that are no services.
NO_SERVICE = "HTTPException str int bool dict list UUID Optional datetime db session response request None True False type cls self super object".split()


def service_of(call: Column) -> Column:
    """The class that a call belongs to: capitalised, four letters before a dot or five alone."""
    dotted, alone = F.regexp_extract(call, r"^([A-Z][a-zA-Z]{3,})\.", 1), F.regexp_extract(call, r"^[A-Z][a-zA-Z]{4,}$", 0)
    found = F.when(dotted != "", dotted).when(alone != "", alone)
    return F.when(~found.isin(NO_SERVICE), found)


def module_services(endpoints: DataFrame, calls: DataFrame) -> DataFrame:
    """(module, domain, endpoints, services, shared): services of a domain in a module; shared ones serve several calls."""
    e = endpoints.select("eid", "module", T.path_domain(F.col("path")).alias("domain"))
    s = calls.select("eid", service_of(F.col("call")).alias("service")).filter("service is not null")
    often = s.groupBy("service").agg((F.count(F.lit(1)) > 1).cast("int").alias("often"))
    n = e.groupBy("module", "domain").agg(F.count(F.lit(1)).alias("endpoints"))
    x = e.join(s, "eid").select("module", "domain", "service").distinct().join(often, "service").groupBy("module", "domain").agg(F.array_sort(F.collect_list("service")).alias("services"), F.sum("often").alias("shared"))
    return n.join(x, ["module", "domain"])


def resource_of(path: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(path, r"/\{[^}]+\}$", ""), "/:[^/]+$", "")


def endpoint_patterns(endpoints: DataFrame, calls: DataFrame, uses: DataFrame, ai: DataFrame, verified: DataFrame) -> DataFrame:
    """(eid, patterns): which of P1 to P8 an endpoint shows; ai and verified list endpoints by eid."""
    c = F.lower("call")
    told = calls.groupBy("eid").agg(F.max(c.rlike(r"task|\.delay\(|\.apply_async|background")).alias("p4"))
    writes = uses.groupBy("eid").agg(F.count(F.when(F.col("access").isin("write", "read_write"), 1)).alias("writes"))
    m = F.upper("method")
    crud = endpoints.groupBy(resource_of(F.col("path")).alias("r")).agg((F.max(m == "GET") & F.max(m == "POST") & F.max(m.isin("PATCH", "PUT"))).alias("p5"))
    x = endpoints.withColumn("r", resource_of(F.col("path"))).join(crud, "r").join(told.withColumn("p1", F.lit(True)), "eid", "left").join(writes, "eid", "left")
    x = x.join(ai.select("eid", F.lit(True).alias("p3")).distinct(), "eid", "left").join(verified.select("eid", F.lit(True).alias("p7")).distinct(), "eid", "left")
    p2 = F.lower(F.concat("file", "handler")).rlike(r"auth|permission|require_|depends\(get_current")
    p8 = (m == "GET") & F.lower(F.concat("path", "handler")).rlike("list|page|paginate")
    tests = [F.col("p1"), p2, F.col("p3"), F.col("p4"), F.col("p5"), F.col("writes") >= 3, F.col("p7"), p8]
    return x.select("eid", F.array_compact(F.array(*(F.when(t, f"P{i + 1}") for i, t in enumerate(tests)))).alias("patterns"))


def pattern_registry(patterns: DataFrame, endpoints: DataFrame) -> DataFrame:
    """(pattern, occurrences, examples): counts with the first three endpoints by id."""
    x = patterns.select("eid", F.explode("patterns").alias("pattern")).join(endpoints.select("eid", F.concat_ws(" ", "method", "path").alias("name")), "eid")
    k = F.row_number().over(Window.partitionBy("pattern").orderBy("eid"))
    few = F.collect_list(F.when(F.col("k") <= 3, F.struct("k", "name")))
    return x.withColumn("k", k).groupBy("pattern").agg(F.count(F.lit(1)).alias("occurrences"), F.transform(F.array_sort(few), lambda e: e["name"]).alias("examples"))


def impact(targets: DataFrame, endpoints: DataFrame, models: DataFrame, modules: DataFrame, imports: DataFrame, calls: DataFrame) -> DataFrame:
    """Per target file (a stated set): endpoints, models, affected endpoints, dependent modules, pages, total and risk.

    imports has (from_module, to_module); calls (page, path). Paths meet by ``related_paths``.
    """
    from strata.operators.facts import module_of

    files = endpoints.select("file").unionByName(models.select("file")).distinct()
    related = staged(related_paths(targets.select(F.col("path").alias("target")), files), "related")
    in_file = lambda df, *c: df.join(related, "file").select("target", *c)
    e, m = in_file(endpoints, "eid", "path"), in_file(models, "name")
    schemas = endpoints.select("eid", F.explode(F.array_compact(F.array("request_schema", "response_schema"))).alias("name"))
    hit = m.join(schemas, "name").select("target", "eid").distinct()
    home = module_of(targets.select("path"), "path", modules.select("id", F.col("path").alias("module_path")), "module_path", "id").select(F.col("path").alias("target"), F.col("id").alias("to_module"))
    dep = home.join(imports.select("from_module", "to_module").distinct(), "to_module").select("target", "from_module")
    heads = e.select("target", F.split_part("path", F.lit("{"), F.lit(1)).alias("head")).distinct()
    hold = texts_with(calls.select(F.col("path").alias("text")), heads.select(F.col("head").alias("pattern")))
    pages = calls.join(hold, F.col("path") == F.col("text")).join(heads, F.col("head") == F.col("pattern")).select("target", "page").distinct()
    n = lambda df, to: df.groupBy("target").agg(F.count(F.lit(1)).alias(to))
    x = targets.select(F.col("path").alias("target")).distinct()
    names = ["endpoints", "models", "affected", "modules", "pages"]
    for df, to in zip((e, m, hit, dep, pages), names, strict=True):
        x = x.join(n(df, to), "target", "left")
    x = x.fillna(0, names).withColumn("total", F.col("endpoints") + F.col("affected") + F.col("modules") + F.col("pages"))
    return x.withColumn("risk", F.when(F.col("total") > 5, "HIGH").when(F.col("total") > 2, "MED").otherwise("LOW"))


def feature_context(endpoints: DataFrame, models: DataFrame, fields: DataFrame, enums: DataFrame, wanted: list[str], declared: list[str]) -> DataFrame:
    """(kind, id) of a feature: declared endpoints ('METHOD /path'), their models, neighbours that share a model, enums named in fields."""
    e = endpoints.withColumn("key", F.concat_ws(" ", "method", "path"))
    own = e.filter(F.col("key").isin(wanted))
    schemas = lambda df: df.select("key", F.explode(F.array_compact(F.array("request_schema", "response_schema"))).alias("name"))
    names = schemas(own).select("name").unionByName(models.filter(F.col("name").isin(declared)).select("name")).distinct()
    if declared:
        names = names.unionByName(models.sparkSession.createDataFrame([(x,) for x in declared], "name string")).distinct()
    near = schemas(e.filter(~F.col("key").isin(wanted))).join(names, "name", "left_semi").select("key").distinct()
    hit = models.join(names, "name", "left_semi")
    used = fields.join(hit.select("name"), "name", "left_semi").select(F.lower("field").alias("field")).distinct()
    named = texts_with(used.select(F.col("field").alias("text")), enums.select(F.lower("enum").alias("pattern"))).select("pattern").distinct()
    named = enums.join(named, F.lower("enum") == F.col("pattern")).select("enum").distinct()
    parts = [("declared", own, "key"), ("neighbour", near, "key"), ("model", hit, "name"), ("enum", named, "enum")]
    out = [df.select(F.lit(k).alias("kind"), F.col(c).alias("id")).distinct() for k, df, c in parts]
    return out[0].unionByName(out[1]).unionByName(out[2]).unionByName(out[3])


def set_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """(kind, item, change): added and removed items of snapshots (kind, item)."""
    a, b = before.select("kind", "item").distinct(), after.select("kind", "item").distinct()
    return b.join(a, ["kind", "item"], "left_anti").withColumn("change", F.lit("added")).unionByName(a.join(b, ["kind", "item"], "left_anti").withColumn("change", F.lit("removed")))


def count_deltas(before: DataFrame, after: DataFrame) -> DataFrame:
    n = lambda df, s: df.select("kind", F.lit(s).alias("s"))
    return n(before, -1).unionByName(n(after, 1)).groupBy("kind").agg(F.sum("s").alias("delta"))


def endpoint_changes(before: DataFrame, after: DataFrame, columns: list[str]) -> DataFrame:
    """(key, changes): 'column: old → new' of endpoints in both snapshots, and services added and removed."""
    old = before.select("key", *(F.col(c).alias(f"old_{c}") for c in columns), F.col("services").alias("old_services"))
    x = after.select("key", *columns, "services").join(old, "key")
    shown = lambda c: F.coalesce(c, F.lit("none"))
    one = [F.when(~F.col(c).eqNullSafe(F.col(f"old_{c}")), F.concat(F.lit(f"{c}: "), shown(F.col(f"old_{c}")), F.lit(" → "), shown(F.col(c)))) for c in columns]
    more, less = F.array_sort(F.array_except("services", "old_services")), F.array_sort(F.array_except("old_services", "services"))
    text = lambda a: F.when(F.size(a) > 0, F.array_join(a, ", ")).otherwise("none")
    one.append(F.when((F.size(more) > 0) | (F.size(less) > 0), F.concat(F.lit("services: +"), text(more), F.lit(" -"), text(less))))
    return x.select("key", F.array_compact(F.array(*one)).alias("changes")).filter(F.size("changes") > 0)


def discrepancies(before: DataFrame, after: DataFrame, specs: DataFrame) -> DataFrame:
    """(finding, n) of eight checks on snapshots (kind, item, n); specs has (spec, endpoint). Untracked endpoints are no issue."""
    a, b = before.select("kind", "item", F.col("n").alias("old")), after.select("kind", "item", F.col("n").alias("new"))
    x = a.withColumn("a", F.lit(True)).join(b.withColumn("b", F.lit(True)), ["kind", "item"], "full_outer")
    status = F.when(F.col("a").isNull(), F.concat(F.lit("new_"), "kind")).when(F.col("b").isNull(), F.concat(F.lit("removed_"), "kind")).when((F.col("kind") == "models") & (F.col("old") != F.col("new")), "drifted_models")
    changed = x.select(status.alias("finding")).filter("finding is not null and finding <> 'removed_tasks'")
    now = after.filter("kind = 'endpoints'").select(F.col("item").alias("endpoint"))
    untracked = now.join(specs.select("endpoint"), "endpoint", "left_anti").select(F.lit("untracked_endpoints").alias("finding"))
    orphan = specs.join(now, "endpoint", "left_anti").select("spec").distinct().select(F.lit("orphan_specs").alias("finding"))
    return changed.unionByName(untracked).unionByName(orphan).groupBy("finding").agg(F.count(F.lit(1)).alias("n"))


def discrepancy_summary(found: DataFrame) -> DataFrame:
    total = F.sum(F.when(F.col("finding") != "untracked_endpoints", F.col("n")).otherwise(0))
    critical = F.max(F.col("finding").isin("removed_endpoints", "removed_models", "orphan_specs"))
    return found.agg(F.coalesce(total, F.lit(0)).alias("total_issues"), F.coalesce(critical, F.lit(False)).alias("has_critical"))


def prefixed(df: DataFrame, root: str, columns: list[str]) -> DataFrame:
    """One root of several: ids with the root before them."""
    return df.select(*(F.concat(F.lit(root + "/"), c).alias(c) if c in columns else F.col(c) for c in df.columns))


def model_role(name: Column, framework: Column, has_session: Column, as_request: Column, as_response: Column) -> Column:
    """What a model is for, by the first rule that fits."""
    n = F.lower(name)
    rules = [("request", "API Request"), ("response", "API Response"), ("login|signup|auth", "Authentication"), ("create", "Create Input"), ("update", "Update Input"), ("config|rules|settings", "Configuration"),
             ("safety|guardrail", "Safety Policy"), ("persona|profile", "Entity Profile"), ("schema|topic", "Domain Schema"), ("content|unit", "Content Entity")]
    role = None
    for pattern, said in rules:
        role = F.when(n.rlike(pattern), said) if role is None else role.when(n.rlike(pattern), said)
    return role.when(as_request, "API Request").when(as_response, "API Response").when(has_session | n.contains("session"), "Session State").when(framework != "pydantic", "Database Entity").otherwise("")


def coupling_files(deps: DataFrame, limit: int) -> DataFrame:
    """Files by degree over the largest degree; the highest ``limit``."""
    d = deps.select(F.explode(F.array("src", "dst")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("degree"))
    top = d.orderBy(F.desc("degree"), "id").limit(limit)
    return top.crossJoin(F.broadcast(d.agg(F.max("degree").alias("most")))).select("id", (F.col("degree") / F.greatest("most", F.lit(1))).alias("score"))


def model_endpoints(uses: DataFrame, endpoints: DataFrame) -> DataFrame:
    x = uses.join(endpoints.select("eid", F.concat_ws(" ", "method", "path").alias("name")), "eid")
    return x.groupBy("model").agg(F.array_sort(F.collect_set("name")).alias("endpoints"))


def foreign_keys(models: DataFrame, fields: DataFrame) -> DataFrame:
    """(source, target): a foreign key 'table.column' meets the model named like the table, its singular, or a beginning of it.

    Beginnings of a table's name are exploded, so the look-up is an equi join; the first model by order wins.
    """
    f = fields.filter("foreign_key is not null").select("name", F.regexp_replace(F.lower(F.split_part("foreign_key", F.lit("."), F.lit(1))), "_", "").alias("table")).distinct()
    heads = f.select("name", "table", F.explode(F.transform(F.sequence(F.lit(1), F.length("table")), lambda i: F.substring(F.col("table"), F.lit(1), i))).alias("low"))
    m = models.select(F.col("name").alias("target"), F.lower("name").alias("low"), F.col("mid").alias("ord"))
    x = heads.join(m, "low").groupBy("name", "table").agg(F.min_by("target", "ord").alias("target"))
    return x.filter("target <> name").select(F.col("target").alias("source"), F.col("name").alias("target")).distinct()


def token_efficiency(context_bytes: Column, intel_bytes: Column, raw_bytes: Column) -> list[Column]:
    """Tokens of an answer and of the raw files, their ratio and what is saved, from sizes in bytes."""
    answer = F.ceil((T.half_up(context_bytes * 0.4) + T.half_up(intel_bytes * 0.08)) / 3.5)
    raw = F.ceil(raw_bytes / 3.5)
    return [answer.alias("answer_tokens"), raw.alias("raw_tokens"), F.when(raw > 0, T.half_up(answer / raw, 3)).otherwise(0.0).alias("ratio"), F.greatest(raw - answer, F.lit(0)).alias("saved")]


def patch_drift(patches: DataFrame) -> DataFrame:
    """(id, files, imports_added, imports_removed, increase) from unified diffs (id, patch)."""
    line = patches.select("id", F.explode(F.split("patch", "\n")).alias("l"))
    head = F.col("l").rlike(r"^(--- |\+\+\+ )")
    name = F.trim(F.regexp_replace(F.substring("l", 5, 1 << 20), "\t.*", ""))
    imports = lambda s: F.count(F.when(F.col("l").rlike(rf"^{s}(?!{s}{s})\s*(import|from|require)\b"), 1))
    x = line.groupBy("id").agg(F.count_distinct(F.when(head & (name != "/dev/null"), name)).alias("files"), imports(r"\+").alias("imports_added"), imports("-").alias("imports_removed"))
    return x.withColumn("increase", F.greatest(F.col("imports_added") - F.col("imports_removed"), F.lit(0)) + F.floor(F.col("files") / 3))


def context_coverage(truth: DataFrame, contexts: DataFrame) -> DataFrame:
    """(id, coverage, files_mentioned) of ground-truth files (id, path) in a context (id, text): folders by any segment."""
    x = truth.join(contexts.select("id", F.lower("text").alias("text")), "id")
    base = F.lower(T.basename(F.col("path")))
    files = x.groupBy("id").agg(F.count(F.when(F.col("text").contains(base) | F.col("text").contains(F.regexp_replace(base, r"\.[^.]+$", "")), 1)).alias("files_mentioned"))
    folder = x.select("id", "text", T.dirname(F.col("path")).alias("module")).distinct()
    told = F.exists(F.filter(F.split(F.lower("module"), "/"), lambda s: s != ""), lambda s: F.col("text").contains(s))
    return folder.groupBy("id").agg(T.half_up(F.avg(told.cast("double")), 3).alias("coverage")).join(files, "id")


def golden(truth: DataFrame, ranked: DataFrame, top: int) -> DataFrame:
    """(query, passed): at least half of a query's files (rounded up) among its first ``top``."""
    hit = ranked.filter(F.col("rank") <= top).join(truth, ["query", "item"], "left_semi").groupBy("query").agg(F.count(F.lit(1)).alias("hits"))
    x = truth.groupBy("query").agg(F.count(F.lit(1)).alias("n")).join(hit, "query", "left")
    return x.select("query", (F.coalesce("hits", F.lit(0)) >= F.ceil(F.col("n") / 2)).alias("passed"))


def paired_summary(pairs: DataFrame) -> DataFrame:
    """(metric, baseline, other, delta, pct_change) of paired results (metric, b, g)."""
    x = pairs.groupBy("metric").agg(F.avg("b").alias("mb"), F.avg("g").alias("mg"))
    d = F.col("mg") - F.col("mb")
    return x.select("metric", T.half_up(F.col("mb"), 3).alias("baseline"), T.half_up(F.col("mg"), 3).alias("other"), T.half_up(d, 3).alias("delta"), F.when(F.col("mb") != 0, T.half_up(d / F.col("mb") * 100, 1)).alias("pct_change"))


def carried_forward(rows: DataFrame, group: str, order: str, value: str) -> DataFrame:
    """Each row with the last value that was told before it or by it in its group."""
    return rows.withColumn("current", F.last(value, ignorenulls=True).over(Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)))


def first_wins(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The first row of each key by ``order``, as an aggregate with map-side combining."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("r")).select(*keys, *(F.col(f"r.{c}").alias(c) for c in rest))


def file_context(targets: DataFrame, endpoints: DataFrame, models: DataFrame, fields: DataFrame, modules: DataFrame, calls: DataFrame) -> DataFrame:
    """Per target path (a stated set): its module, endpoints, models with field counts, calls, and who calls it (eight at most)."""
    from strata.operators.facts import module_of

    t = targets.select(F.col("path").alias("target"))
    related = staged(related_paths(t, endpoints.select("file").unionByName(models.select("file"))), "related")
    near = lambda df, *c: df.join(related, "file").select("target", *c)
    shown = lambda df, key, value, to: df.groupBy("target").agg(F.array_join(F.transform(F.array_sort(F.collect_set(F.struct(key, value.alias("v")))), lambda x: x["v"]), ",").alias(to))
    name = F.concat_ws(" ", "method", "path")
    e = near(endpoints.withColumn("label", name), "eid", "label")
    n = fields.groupBy("name").agg(F.count(F.lit(1)).alias("n"))
    m = near(models.join(n, "name", "left").fillna(0, ["n"]), "name", "n")
    told = e.join(calls.filter(~F.col("call").isin(T.GENERIC)), "eid").select("target", "call")
    stem = F.lower(F.regexp_replace(T.basename(F.col("target")), r"\.[^.]*$", ""))
    stems = t.select("target", stem.alias("pattern"))
    said = texts_with(calls.select(F.lower("call").alias("text")), stems).join(stems, "pattern")
    by = calls.join(said, F.lower("call") == F.col("text")).select("target", "eid").distinct().join(endpoints.select("eid", name.alias("label")), "eid")
    by = by.withColumn("k", F.row_number().over(Window.partitionBy("target").orderBy("eid"))).filter("k <= 8")
    home = module_of(targets.select("path"), "path", modules.select("id", F.col("path").alias("module_path")), "module_path", "id")
    lost = home.filter("id is null").select(F.col("path").alias("text"))
    inside = texts_with(lost, modules.select(F.col("id").alias("pattern"))).groupBy(F.col("text").alias("path")).agg(F.min("pattern").alias("other"))
    x = home.join(inside, "path", "left").select(F.col("path").alias("target"), F.coalesce("id", "other").alias("module"))
    parts = [shown(e, "eid", F.col("label"), "endpoints"), shown(m, "name", F.concat_ws(":", "name", F.col("n").cast("string")), "models"), shown(told, "call", F.col("call"), "calls"), shown(by, "eid", F.col("label"), "called_by")]
    for p in parts:
        x = x.join(p, "target", "left")
    return x.fillna("", ["endpoints", "models", "calls", "called_by"])


def named_sets(sets: DataFrame, *more: str) -> tuple[DataFrame, DataFrame]:
    """(id, set, more) of each row, and the distinct sets (id, members): set is the name of the row's members, in any order."""
    name = F.unhex(F.sha2(F.to_json(F.array_sort("members")), 256))
    return sets.select("id", name.alias("set"), *more), sets.select(name.alias("id"), "members").dropDuplicates(["id"])


def near_sets(sets: DataFrame, least: float, equal_sizes: bool = False) -> DataFrame:
    """(a, b, s) of sets (id, members), a < b, with Jaccard of at least ``least``: sets that share l members of their prefixes.

    Members are ordered by how rare they are, so prefixes meet seldom; whole sets travel with distinct pairs only. Sets of
    one size n share w = least * 2n / (1 + least) members at least, so l of the first n - w + l of each; l is 1, if sizes differ.
    """
    m = sets.select("id", F.size("members").alias("n"), F.explode("members").alias("t"))
    often = m.groupBy("t").agg(F.count(F.lit(1)).alias("c"))
    first = lambda k: F.transform(F.slice(F.array_sort(F.collect_list(F.struct("c", "t"))), F.lit(1), k), lambda e: e["t"])
    if equal_sizes:
        w = F.ceil(F.lit(2 * least / (1 + least)) * F.col("n") - 1e-9).cast("int")
        p = m.join(often, "t").groupBy("id", "n").agg(first(F.col("n") - w + F.least(w, F.lit(2))).alias("p")).withColumn("w", w)
        at = F.sequence(F.lit(0), F.size("p") - 1)
        two = F.flatten(F.transform(at, lambda i: F.transform(F.filter(at, lambda j: j > i), lambda j: F.struct(F.col("p")[i].alias("t"), F.col("p")[j].alias("u")))))
        one = F.transform("p", lambda t: F.struct(t.alias("t"), F.lit(None).alias("u")))
        p = p.select("id", "n", F.explode(F.when(F.col("w") >= 2, two).otherwise(one)).alias("k")).select("id", F.struct("n", "k").alias("k"))
        pairs = p.join(p.select(F.col("id").alias("b"), "k"), "k").filter(F.col("id") < F.col("b"))
    else:
        p = m.join(often, "t").groupBy("id", "n").agg(first((F.col("n") - F.ceil(F.lit(least) * F.col("n") - 1e-9) + 1).cast("int")).alias("p")).select("id", "n", F.explode("p").alias("t"))
        q = p.select(F.col("id").alias("b"), F.col("n").alias("n2"), "t")
        pairs = p.join(q, "t").filter((F.col("id") < F.col("b")) & (F.least("n", "n2") >= F.lit(least) * F.greatest("n", "n2") - 1e-9))
    pairs = pairs.select(F.col("id").alias("a"), "b").distinct()
    x = pairs.join(sets.select(F.col("id").alias("a"), F.col("members").alias("x")), "a").join(sets.select(F.col("id").alias("b"), F.col("members").alias("y")), "b")
    return x.withColumn("s", T.jaccard(F.col("x"), F.col("y"))).filter(F.col("s") >= least).select("a", "b", "s")


def near_classes(classes: DataFrame, distinct: DataFrame, least: float, places: int, equal_sizes: bool = False) -> DataFrame:
    """(a, b, similarity) both ways of classes (class, set) whose sets are near or equal, each with itself too."""
    one = near_sets(distinct, least, equal_sizes).withColumn("similarity", T.half_up(F.col("s"), places))
    both = one.select("a", "b", "similarity").unionByName(one.select(F.col("b").alias("a"), F.col("a").alias("b"), "similarity"))
    both = both.unionByName(distinct.filter(F.size("members") > 0).select(F.col("id").alias("a"), F.col("id").alias("b"), F.lit(1.0).alias("similarity")))
    of = lambda c, to: classes.select(F.col("set").alias(c), *(F.col(x).alias(f"{x}_{to}") for x in classes.columns if x != "set"))
    return both.join(of("a", "a"), "a").join(of("b", "b"), "b").drop("a", "b")


#: Rows of a block of a class and of a slice of a block, and pairs of rows that a task lists, about.
BLOCK, SLICE, LISTED = 4_096, 16, 1 << 28


def owners(near: DataFrame, of: DataFrame) -> DataFrame:
    """(a, b, similarity), a < b: classes (class_a, class_b, both ways) stand for all pairs of their rows (id, class).

    Rows of a class are dealt to blocks, and a pair of blocks is taken once: slices of one meet the whole other, as Spark holds all
    rows that it explodes from one row. Nothing that grows with the rows is broadcast, and tasks grow in number with the pairs, not in size.
    """
    wide = int(of.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counts = staged(of.groupBy("class").agg(F.count(F.lit(1)).alias("n")), "class_sizes")
    classes, rows = counts.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    place = F.pmod(F.xxhash64("id"), F.ceil(F.col("n") / BLOCK)).cast("int").alias("place")
    each = joined(of, counts, "class", rows=classes).select("class", place, "id").repartition(max(wide, rows // DEALT + 1), "class", "place")
    blocks = staged(each.groupBy("class", "place").agg(F.collect_list("id").alias("ids")).withColumn("m", F.size("ids").cast("long")), "blocks")
    n = blocks.count()
    named = lambda to, *more: blocks.select(*(F.col(c).alias(f"{c}_{to}") for c in ("class", "place", *more)))
    same = (F.col("class_a") == F.col("class_b")) & (F.col("place_a") == F.col("place_b"))
    once = same | (F.col("class_a") < F.col("class_b")) | ((F.col("class_a") == F.col("class_b")) & (F.col("place_a") < F.col("place_b")))
    pairs = joined(joined(near.filter("class_a <= class_b"), named("a", "m"), "class_a", rows=n), named("b", "m"), "class_b", rows=n).filter(once)
    pairs = staged(pairs.withColumn("same", same), "pairs")
    many, work = pairs.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.col("m_a") * F.col("m_b")), F.lit(0))).first()
    slices = F.transform(F.sequence(F.lit(0), F.floor((F.size("ids_a") - 1) / SLICE).cast("int")), lambda i: F.slice("ids_a", i * SLICE + 1, F.lit(SLICE)))
    x = joined(pairs.drop("m_a", "m_b"), named("a", "ids"), ["class_a", "place_a"], rows=rows).select("class_b", "place_b", "same", "similarity", F.explode(slices).alias("some"))
    x = x.repartition(max(wide, work // LISTED + many // DEALT + 1), "class_b", "place_b")
    x = joined(x, named("b", "ids"), ["class_b", "place_b"], rows=rows).select(F.explode("some").alias("p"), "ids_b", "same", "similarity")
    x = x.select("p", F.explode("ids_b").alias("q"), "same", "similarity")
    return x.filter("p < q or (p > q and not same)").select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b"), "similarity")


def first_owners(near: DataFrame, of: DataFrame, most: int, similar_first: bool) -> DataFrame:
    """The first ``most`` rows of ``owners`` by a and b, or by falling similarity before; the others are not listed.

    Rows of a class with an id below a row that has a partner have that partner too, so a class's ``most`` smallest
    rows are enough. Pairs among these give a bound, and only rows within it meet whole classes.
    """
    best = [F.desc("similarity")] * similar_first + [F.col("a"), F.col("b")]
    rows = of.select(F.col("id").alias("a"), F.col("class").alias("class_a"))
    few = staged(rows.withColumn("k", F.row_number().over(Window.partitionBy("class_a").orderBy("a"))).filter(F.col("k") <= most).drop("k"), "few")
    heads = few.join(near, "class_a")
    some = heads.join(few.toDF("b", "class_b"), "class_b").filter("a < b").orderBy(*best).limit(most).collect()  # most rows at most
    if len(some) == most:
        last = some[-1]
        heads = heads.filter((F.col("similarity") > last["similarity"]) | ((F.col("similarity") == last["similarity"]) & (F.col("a") <= last["a"])) if similar_first else F.col("a") <= last["a"])
    found = heads.join(rows.toDF("b", "class_b"), "class_b").filter("a < b")
    return found.select("a", "b", "similarity").orderBy(*best).limit(most)


def overlapping(sets: DataFrame, least: float, places: int, first: int | None = None) -> DataFrame:
    """(a, b, similarity) of sets (id, members) with Jaccard of at least ``least``, or the ``first`` of them by a, b.

    Rows of equal sets are one class while candidates are sought, so what is compared follows distinct sets; empty sets are like nothing.
    """
    of, distinct = (staged(x, n) for x, n in zip(named_sets(sets), ("set_of", "distinct_sets"), strict=True))
    near = staged(near_classes(distinct.select(F.col("id").alias("set"), F.col("id").alias("class")), distinct, least, places), "near_sets")
    of = of.withColumnRenamed("set", "class")
    return owners(near, of) if first is None else first_owners(near, of, first, False)


def similar_structure(prints: DataFrame, least: float, first: int | None = None) -> DataFrame:
    """Functions (id, kinds, size, hash) of twelve nodes or more in the same or next size bucket, of other shape, whose kinds overlap.

    first: only so many, the most similar first, then by a and b. A class is a set of kinds, a bucket and a hash.
    """
    x = prints.filter("size >= 12").select("id", F.array_distinct("kinds").alias("members"), F.floor(F.col("size") / 10).alias("bucket"), "hash")
    of, distinct = (staged(y, n) for y, n in zip(named_sets(x, "bucket", "hash"), ("set_of", "distinct_sets"), strict=True))
    of = of.withColumn("class", F.struct("set", "bucket", "hash"))
    classes = of.select("class", "set", "bucket", "hash").distinct()
    near = near_classes(classes, distinct, least, 3).filter((F.abs(F.col("bucket_a") - F.col("bucket_b")) <= 1) & (F.col("hash_a") != F.col("hash_b")))
    near = staged(near.select("class_a", "class_b", "similarity"), "near_classes")
    return owners(near, of.select("id", "class")) if first is None else first_owners(near, of.select("id", "class"), first, True)


def similar_tokens(rows: DataFrame, least: float, places: int) -> DataFrame:
    return overlapping(rows.select("id", F.array_distinct("tokens").alias("members")), least, places)
