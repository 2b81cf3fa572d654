"""Component graphs: which component renders which, and what each page reaches.

Strongly connected components are found first, so that a cycle is one node of the walk; pages
then walk the condensed graph together, one level a round, and each (page, part) pair is met once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.sources.staging import staged

from .symbols import script_call_edges


def component_edges(tags: DataFrame, components: DataFrame, imports: DataFrame, reexports: DataFrame, stars: DataFrame) -> DataFrame:
    """(src, dst) ids of components whose tags (file, component, tag) name another component, here or by import.

    ``components`` (file, name); ids are 'file#name'. Lower-case tags are elements, not components.
    """
    calls = tags.filter(F.col("tag").rlike("^[A-Z]")).select("file", F.col("component").alias("caller"), F.lit(None).cast("string").alias("in_class"), F.col("tag").alias("text"))
    e = script_call_edges(calls, components, imports, reexports, stars)
    return e.select(F.col("caller").alias("src"), F.col("callee").alias("dst"))


#: Most edges of a graph whose rounds may broadcast; each broadcast goes through the driver, and there are many rounds.
BROADCAST = 10_000


def joined(a: DataFrame, b: DataFrame, on: str | list[str], how: str = "inner", rows: int = BROADCAST + 1) -> DataFrame:
    """``a`` joined with ``b``, without a broadcast if there are more than BROADCAST rows, whatever their files' size tells."""
    return a.join(b.hint("merge") if rows > BROADCAST else b, on, how)


def core(edges: DataFrame) -> DataFrame:
    """Edges between nodes that have both a way in and a way out, after all others were taken off, ends first."""
    left = None
    while True:
        n = edges.count()
        if n in (0, left):
            return edges
        left = n
        edges = joined(joined(edges, edges.select(F.col("dst").alias("src")).distinct(), "src", "left_semi", n), edges.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi", n)
        edges = staged(edges.select("src", "dst"), "core")


def cyclic_parts(edges: DataFrame) -> DataFrame:
    """(id, part) of nodes on cycles: nodes that reach each other have the same part, its largest id.

    Each round gives every node the largest id that reaches it and takes, backwards from each such
    id, the nodes of its colour that reach it: that is one strongly connected part per colour. A
    node that only points at itself is no part of more than itself and is left out.
    """
    rest = core(staged(edges.filter("src <> dst").select("src", "dst").distinct(), "core"))
    found = None
    while n := rest.count():
        color = staged(rest.select(F.explode(F.array("src", "dst")).alias("id")).distinct().withColumn("part", F.col("id")), "colors")
        while True:
            told = joined(rest, color.select(F.col("id").alias("src"), "part"), "src", rows=n).groupBy(F.col("dst").alias("id")).agg(F.max("part").alias("told"))
            color = staged(joined(color.select("id", "part"), told, "id", "left", n).select("id", F.greatest("part", F.coalesce("told", "part")).alias("part"), (F.col("told") > F.col("part")).alias("changed")), "colors")
            if color.filter("changed").isEmpty():
                break
        color = color.select("id", "part")
        inside = joined(joined(rest, color.select(F.col("id").alias("src"), "part"), "src", rows=n), color.select(F.col("id").alias("dst"), F.col("part").alias("p2")), "dst", rows=n).filter("part = p2").select("src", "dst", "part")
        inside = staged(inside, "inside")
        part = front = staged(color.filter("id = part"), "part")
        while not front.isEmpty():
            new = joined(inside, front.select(F.col("id").alias("dst"), "part"), ["dst", "part"], rows=n).select(F.col("src").alias("id"), "part").distinct()
            front = staged(joined(new, part, ["id", "part"], "left_anti", n), "part")
            part = part.unionByName(front)
        found = part if found is None else found.unionByName(part)
        gone = staged(part.select("id"), "gone")
        rest = core(staged(joined(joined(rest, gone.select(F.col("id").alias("src")), "src", "left_anti", n), gone.select(F.col("id").alias("dst")), "dst", "left_anti", n).select("src", "dst"), "core"))
    none = edges.select(F.col("src").alias("id"), F.col("dst").alias("part")).limit(0)
    if found is None:
        return none
    shared = found.groupBy("part").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return joined(found, shared.select("part"), "part").select("id", "part")


def reached(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """(root, id) of all that each root (id) reaches, itself included."""
    parts = staged(cyclic_parts(edges), "parts")
    of = lambda df, c: df.join(parts.select(F.col("id").alias(c), F.col("part").alias(f"{c}_part")), c, "left").withColumn(c, F.coalesce(f"{c}_part", c)).drop(f"{c}_part")
    flat = staged(of(of(edges.select("src", "dst"), "src"), "dst").filter("src <> dst").distinct(), "condensed")
    # roots of the same part walk once
    start = staged(of(roots.select(F.col("id").alias("root")).distinct().withColumn("at", F.col("root")), "at"), "roots")
    seen = front = start.select(F.col("at").alias("top"), F.col("at").alias("id")).distinct()
    while not front.isEmpty():
        front = staged(front.join(flat, front["id"] == flat["src"]).select("top", F.col("dst").alias("id")).distinct().join(seen, ["top", "id"], "left_anti"), "walk")
        seen = seen.unionByName(front)
    all_ = seen.join(parts.select(F.col("id").alias("member"), F.col("part").alias("id")), "id", "left").select("top", F.coalesce("member", "id").alias("id"))
    return start.select("root", F.col("at").alias("top")).join(all_, "top").select("root", "id")


def page_components(pages: DataFrame, components: DataFrame, edges: DataFrame, facts: DataFrame) -> DataFrame:
    """(page, components, direct, facts): per page (page, id) the names it reaches, those it renders itself, and the facts (id, kind, value) of all.

    Names and facts are sorted; each once. The page's own component is not among its components.
    """
    all_ = reached(edges, pages.select("id")).join(pages.select("page", F.col("id").alias("root")), "root")
    names = components.select("id", "name")
    sorted_ = lambda df, to: df.groupBy("page").agg(F.array_sort(F.collect_set("v")).alias(to))
    below = sorted_(all_.filter("id <> root").join(names, "id").select("page", F.col("name").alias("v")), "components")
    direct = sorted_(pages.join(edges.select(F.col("src").alias("id"), "dst"), "id").filter("dst <> id").select("page", F.col("dst").alias("id")).join(names, "id").select("page", F.col("name").alias("v")), "direct")
    told = sorted_(all_.join(facts, "id").select("page", F.concat_ws(":", "kind", "value").alias("v")), "facts")
    none = F.array().cast("array<string>")
    x = pages.select("page").distinct()
    for df, c in ((below, "components"), (direct, "direct"), (told, "facts")):
        x = x.join(df, "page", "left").withColumn(c, F.coalesce(c, none))
    return x
