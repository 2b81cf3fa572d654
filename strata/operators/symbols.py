"""Cross-file symbols: export chains followed to the declaration, and the call graph of functions.

Tables: ``definitions`` (file, name); ``reexports`` (file, name, to_file, to_name, ord), one row for
``export {to_name as name} from to_file``; ``stars`` (file, to_file, ord), one for
``export * from to_file``; ``requests`` (file, name), what importers ask a file for.
A definition in the file itself hides its re-exports, and those hide its stars; ``default`` doesn't
pass through a star; of several stars the first that has the name, depth first, wins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata.sources.staging import dealt, staged


def chain_ends(pointers: DataFrame) -> DataFrame:
    """(file, name, to_file, to_name) with each chain of pointers followed to its end; cycles are left out.

    Pointer doubling: a round doubles how far each row points, so a chain of n takes log2(n) rounds.
    The rows that can still go on become fewer in each round unless only cycles are left.
    """
    here, left = pointers.select("file", "name", "to_file", "to_name"), None
    while True:
        hop = here.select(F.col("file").alias("to_file"), F.col("name").alias("to_name"), F.col("to_file").alias("f2"), F.col("to_name").alias("n2"))
        x = here.select("file", "name", "to_file", "to_name").join(hop, ["to_file", "to_name"], "left")
        here = staged(x.select("file", "name", F.coalesce("f2", "to_file").alias("to_file"), F.coalesce("n2", "to_name").alias("to_name"), F.col("f2").isNotNull().alias("open")), "chains")
        n = here.filter("open").count()
        if n in (0, left):
            return here.filter("not open").drop("open")
        left = n


def resolved_symbols(requests: DataFrame, definitions: DataFrame, reexports: DataFrame, stars: DataFrame) -> DataFrame:
    """(file, name, def_file, def_name) of each request that leads to a definition.

    Named re-exports are followed for all chains at once; stars are expanded only for requested
    names that no definition or named re-export answers, one level of stars a round.
    """
    defs = definitions.select(F.col("file").alias("f"), F.col("name").alias("n")).distinct()
    own = reexports.groupBy("file", "name").agg(F.min_by(F.struct("to_file", "to_name"), F.struct("ord", "to_file", "to_name")).alias("t")).select("file", "name", "t.*")
    pointers = staged(own.join(defs, (own["file"] == defs["f"]) & (own["name"] == defs["n"]), "left_anti"), "pointers")
    ends = chain_ends(pointers).select(F.col("file").alias("f"), F.col("name").alias("n"), F.col("to_file").alias("f2"), F.col("to_name").alias("n2"))
    lost = pointers.select(F.col("file").alias("f"), F.col("name").alias("n")).join(ends, ["f", "n"], "left_anti")

    def forward(x: DataFrame) -> DataFrame:
        """To the ends of named chains; what leads into a cycle goes."""
        x = x.join(lost, ["f", "n"], "left_anti").join(ends, ["f", "n"], "left")
        x = x.withColumn("f", F.coalesce("f2", "f")).withColumn("n", F.coalesce("n2", "n"))
        x = x.groupBy("file", "name", "f", "n").agg(F.min("path").alias("path"))
        return x.join(defs.withColumn("hit", F.lit(True)), ["f", "n"], "left")

    start = requests.select("file", "name", F.col("file").alias("f"), F.col("name").alias("n"), F.array().cast("array<int>").alias("path")).distinct()
    seen = front = staged(forward(start), "symbols")
    next_star = stars.select(F.col("file").alias("f"), "to_file", F.col("ord").cast("int").alias("ord"))
    while not front.isEmpty():
        x = front.filter("hit is null and n <> 'default'").join(next_star, "f")
        x = forward(x.select("file", "name", F.col("to_file").alias("f"), "n", F.concat("path", F.array("ord")).alias("path")))
        known = seen.groupBy("file", "name", "f", "n").agg(F.min("path").alias("before"))
        front = staged(x.join(known, ["file", "name", "f", "n"], "left").filter("before is null or path < before").select(*seen.columns), "symbols")
        seen = seen.unionByName(front)
    return seen.filter("hit").groupBy("file", "name").agg(F.min_by(F.struct("f", "n"), "path").alias("t")).select("file", "name", F.col("t.f").alias("def_file"), F.col("t.n").alias("def_name"))


def function_id(file: Column, name: Column) -> Column:
    return F.concat(file, F.lit("#"), name)


def first_defined(candidates: DataFrame, keys: list[str], definitions: DataFrame) -> DataFrame:
    """Per ``keys`` the first candidate (k_file, k_name, rank) that is a definition (file, name, id)."""
    d = definitions.select(F.col("file").alias("k_file"), F.col("name").alias("k_name"), "id")
    return candidates.join(d, ["k_file", "k_name"]).groupBy(*keys).agg(F.min_by("id", "rank").alias("callee"))


def script_call_edges(calls: DataFrame, definitions: DataFrame, imports: DataFrame, reexports: DataFrame, stars: DataFrame) -> DataFrame:
    """(caller, callee) ids of calls (file, caller, in_class, text) in scripts.

    ``imports``: (file, alias, to_file, symbol); symbol '*' binds a whole file. A plain name is a
    definition of the file, else what its import resolves to; ``this.m`` is a method of the class
    around it; ``a.b`` a method of the local or imported class a, or a function of the file bound to a.
    """
    defs = staged(dealt(definitions.select("file", "name"), "file").distinct().select("file", "name", function_id(F.col("file"), F.col("name")).alias("id")), "definitions")
    head, rest = F.split_part("text", F.lit("."), F.lit(1)), F.regexp_extract("text", r"\.(.+)$", 1)
    c = dealt(calls.select("file", "caller", "in_class", "text"), "file", "caller").distinct()
    c = staged(c.select("*", head.alias("head"), rest.alias("rest")), "calls")
    bound = c.join(imports.select("file", F.col("alias").alias("head"), "to_file", "symbol"), ["file", "head"])
    # what each bound call asks of another file: the symbol itself, or a member of the whole file
    asks = bound.withColumn("wanted", F.when(F.col("symbol") == "*", F.col("rest")).otherwise(F.col("symbol")))
    known = resolved_symbols(asks.select(F.col("to_file").alias("file"), F.col("wanted").alias("name")).filter("name <> ''").distinct(), class_names(defs), reexports, stars)
    known = known.select(F.col("file").alias("to_file"), F.col("name").alias("wanted"), "def_file", "def_name")
    member = F.when((F.col("symbol") != "*") & (F.col("rest") != ""), F.concat("def_name", F.lit("."), "rest")).otherwise(F.col("def_name"))
    far = asks.join(known, ["to_file", "wanted"]).select("file", "caller", "text", F.col("def_file").alias("k_file"), member.alias("k_name"), F.lit(2).alias("rank"))
    own = F.when((F.col("head") == "this") & F.col("in_class").isNotNull(), F.concat("in_class", F.lit("."), "rest")).otherwise(F.col("text"))
    near = c.select("file", "caller", "text", F.col("file").alias("k_file"), own.alias("k_name"), F.lit(1).alias("rank"))
    return first_defined(near.unionByName(far), ["file", "caller", "text"], defs).select("caller", "callee").distinct()


def class_names(defs: DataFrame) -> DataFrame:
    """Definitions and the classes of their methods, as names that a file can export."""
    both = F.when(F.col("name").contains("."), F.array("name", F.split_part("name", F.lit("."), F.lit(1)))).otherwise(F.array("name"))
    return dealt(defs.select("file", "name"), "file").select("file", F.explode(both).alias("name")).distinct()


def absolute_module(spec: Column, package: Column) -> Column:
    """A module named from within ``package``: one leading dot is the package itself, each further one its parent."""
    dots = F.length(F.regexp_extract(spec, r"^\.*", 0))
    rest = F.filter(F.split(F.regexp_replace(spec, r"^\.+", ""), r"\."), lambda s: s != "")
    parts = F.when(package == "", F.array().cast("array<string>")).otherwise(F.split(package, r"\."))
    base = F.slice(parts, F.lit(1), F.greatest(F.size(parts) - F.greatest(dots - 1, F.lit(0)), F.lit(0)))
    return F.nullif(F.when(dots == 0, spec).otherwise(F.array_join(F.concat(base, rest), ".")), F.lit(""))


def module_aliases(imports: DataFrame, modules: DataFrame, definitions: DataFrame) -> DataFrame:
    """(file, alias, kind, module, function): what each imported name stands for; of equal aliases the last statement wins.

    ``imports``: (file, package, spec, name, alias, ord), name null for a plain ``import spec``.
    A name that is a module below the spec is a module; a dotted name may be a function of the
    module that it names, or that module; all else is a function of the spec's module.
    """
    x = imports.filter("coalesce(name, '') <> '*'").withColumn("base", F.when(F.col("name").isNull(), F.col("spec")).otherwise(absolute_module(F.col("spec"), F.col("package")))).filter("coalesce(base, '') <> ''")
    x = x.withColumn("alias", F.coalesce("alias", F.regexp_extract(F.coalesce("name", "spec"), r"[^.]*$", 0)))
    x = x.withColumn("below", F.concat_ws(".", "base", "name")).withColumn("fn", F.regexp_extract("name", r"[^.]*$", 0))
    x = x.withColumn("outer", F.concat_ws(".", "base", F.nullif(F.regexp_extract("name", r"^(.*)\.", 1), F.lit(""))))
    m = lambda c: modules.select(F.col("module").alias(c), F.lit(True).alias(f"is_{c}")).distinct()
    d = definitions.select(F.col("module").alias("outer"), F.col("name").alias("fn"), F.lit(True).alias("has")).distinct()
    x = x.join(m("below"), "below", "left").join(m("outer"), "outer", "left").join(d, ["outer", "fn"], "left")
    whole = F.col("name").isNull() | F.col("is_below") | (F.col("name").contains(".") & F.col("has").isNull() & F.col("is_outer"))
    module = F.when(F.col("name").isNull() | F.col("is_below"), F.when(F.col("name").isNull(), F.col("spec")).otherwise(F.col("below"))).when(F.col("name").contains(".") & (F.col("has").isNotNull() | F.col("is_outer")), F.col("outer")).otherwise(F.col("base"))
    whole = F.coalesce(whole, F.lit(False))
    x = x.select("file", "alias", F.when(whole, "module").otherwise("function").alias("kind"), module.alias("module"), F.when(~whole, F.col("fn")).alias("function"), "ord")
    return x.groupBy("file", "alias", "kind").agg(F.max_by(F.struct("module", "function"), F.struct("ord", "module", "function")).alias("t")).select("file", "alias", "kind", "t.*")


def python_call_edges(calls: DataFrame, definitions: DataFrame, aliases: DataFrame) -> DataFrame:
    """(caller, callee) ids of calls (file, caller, in_class, text); definitions are (file, module, name, ord).

    A plain name is a function of the file, else of the module that it was imported from. ``self.m``
    and ``cls.m`` are methods of the class around, ``C.m`` of a class of the file, and nothing else.
    Other dotted names go through a module alias (module and path, then its class, then its own
    function) or name the module in full. In a module the first file's definition counts.
    """
    ids = definitions.withColumn("id", function_id(F.col("file"), F.col("name")))
    here = ids.select("file", "name", "id").distinct()
    by_module = ids.groupBy(F.col("module").alias("file"), "name").agg(F.min_by("id", F.struct("ord", "file")).alias("id"))
    cut = lambda p, k: F.regexp_extract("text", p, k)
    c = calls.select("file", "caller", "in_class", "text").distinct()
    c = c.withColumn("head", cut(r"^[^.]*", 0)).withColumn("rest", cut(r"^[^.]*\.(.+)$", 1)).withColumn("object", cut(r"^(.*)\.", 1)).withColumn("last", cut(r"[^.]*$", 0)).withColumn("inner", cut(r"^[^.]*\.(.+)\.", 1))
    classes = here.filter(F.col("name").contains(".")).select("file", F.split_part("name", F.lit("."), F.lit(1)).alias("object"), F.lit(True).alias("is_class")).distinct()
    c = c.join(classes, ["file", "object"], "left")
    inside = F.col("in_class").isNotNull() & F.col("object").isin("self", "cls")
    bare = F.col("rest") == ""
    name = F.when(bare, F.col("text")).when(inside, F.concat("in_class", F.lit("."), "last")).when(F.col("is_class"), F.col("text"))
    a = aliases.select("file", F.col("alias").alias("head"), "kind", "module", "function")
    far = c.filter(bare).join(a.filter("kind = 'function'"), ["file", "head"]).select("file", "caller", "text", F.col("module").alias("k_file"), F.col("function").alias("k_name"), F.lit(2).alias("rank"))
    dotted = c.filter(~bare & ~inside & F.col("is_class").isNull()).join(a.filter("kind = 'module'"), ["file", "head"], "left")
    deep = F.when(F.col("inner") != "", F.concat_ws(".", "module", "inner")).otherwise(F.col("module"))
    tries = F.when(F.col("module").isNull(), F.array(F.struct(F.col("object").alias("k_file"), F.col("last").alias("k_name")))).otherwise(F.array(F.struct(deep.alias("k_file"), F.col("last").alias("k_name")), F.struct(F.col("module").alias("k_file"), F.col("rest").alias("k_name")), F.struct(F.col("module").alias("k_file"), F.col("last").alias("k_name"))))
    far = far.unionByName(dotted.select("file", "caller", "text", F.posexplode(tries).alias("rank", "t")).select("file", "caller", "text", "t.*", (F.col("rank") + 3).alias("rank")))
    near = c.filter(name.isNotNull()).select("file", "caller", "text", F.col("file").alias("k_file"), name.alias("k_name"), F.lit(1).alias("rank"))
    found = first_defined(near, ["file", "caller", "text"], here)
    more = first_defined(far.join(found.select("file", "caller", "text"), ["file", "caller", "text"], "left_anti"), ["file", "caller", "text"], by_module)
    return found.unionByName(more).select("caller", "callee").distinct()
