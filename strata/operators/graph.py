"""Graph operators on edge tables (src, dst) and node tables (id, layer)."""

from __future__ import annotations


import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strata.sources.staging import staged

from .components import cyclic_parts, joined
from .numbering import numbered


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, n_in, n_out) of every node; isolated ones have zeros."""
    ends = edges.select(F.col("dst").alias("id"), F.lit(1).alias("i"), F.lit(0).alias("o")).unionAll(edges.select(F.col("src").alias("id"), F.lit(0).alias("i"), F.lit(1).alias("o")))
    ends = ends.unionAll(nodes.select("id", F.lit(0).alias("i"), F.lit(0).alias("o")))
    return ends.groupBy("id").agg(F.sum("i").alias("n_in"), F.sum("o").alias("n_out"))


def layer_of(n_in: Column, n_out: Column) -> Column:
    return F.when((n_in == 0) & (n_out == 0), "isolated").when(n_out == 0, "core").when(n_in == 0, "top").otherwise("middle")


def degree_entropy(deg: DataFrame) -> DataFrame:
    """Shannon entropy (natural log) of the distribution of total degrees."""
    share = deg.groupBy((F.col("n_in") + F.col("n_out")).alias("d")).agg(F.count(F.lit(1)).alias("c")).crossJoin(F.broadcast(deg.agg(F.count(F.lit(1)).alias("n"))))
    return share.agg((-F.sum(F.col("c") / F.col("n") * F.log(F.col("c") / F.col("n")))).alias("entropy"))


def cross_layer_ratio(edges: DataFrame, layers: DataFrame, allowed: DataFrame) -> DataFrame:
    """Share of edges whose (source layer, target layer) isn't in ``allowed``."""
    a, b = layers.select(F.col("id").alias("src"), F.col("layer").alias("a")), layers.select(F.col("id").alias("dst"), F.col("layer").alias("b"))
    ok = allowed.select("a", "b", F.lit(1).alias("ok"))
    return edges.join(a, "src", "left").join(b, "dst", "left").join(ok, ["a", "b"], "left").agg(F.avg(F.when(F.col("ok").isNull(), 1.0).otherwise(0.0)).alias("ratio"))


def k_hop(edges: DataFrame, seeds: DataFrame, k: int) -> DataFrame:
    """(id, hop) of nodes within k undirected steps, by k joins with the frontier only."""
    both = edges.select("src", "dst").unionAll(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    seen = seeds.select("id", F.lit(0).alias("hop")).distinct()
    front = seen
    for h in range(1, k + 1):
        front = both.join(front, both["src"] == front["id"]).select(F.col("dst").alias("id")).distinct().join(seen, "id", "left_anti").select("id", F.lit(h).alias("hop"))
        seen = seen.unionAll(front)
    return seen


def ranks(ids: list, edges: list[tuple], rounds: int, alpha: float) -> dict:
    """PageRank of one small graph."""
    n = len(ids)
    rank = dict.fromkeys(ids, 1.0 / max(n, 1))
    out: dict = {}
    for a, _ in edges:
        out[a] = out.get(a, 0) + 1
    for _ in range(rounds):
        lost = sum(r for v, r in rank.items() if v not in out)
        new = dict.fromkeys(ids, (1 - alpha) / max(n, 1) + alpha * lost / max(n, 1))
        for a, b in edges:
            new[b] += alpha * rank[a] / out[a]
        rank = new
    return rank


def pagerank_levels(nodes: DataFrame, edges: DataFrame, rounds: int = 30, alpha: float = 0.85) -> DataFrame:
    """(level, id, rank) after a fixed number of rounds, relative to each level's largest rank.

    Nodes are (level, id), edges (level, src, dst), all ends of edges among the nodes. Parallel edges
    count; the mass of nodes without outgoing edges is spread evenly. All levels are ranked together:
    a round is one join and one aggregation, in which the lost mass is the group without an id.
    """
    nodes = staged(nodes.select("level", "id").distinct().join(nodes.select("level", "id").distinct().groupBy("level").agg(F.count(F.lit(1)).alias("n")), "level"), "nodes")
    edges = staged(edges.select("level", "src", "dst"), "edges")
    out = edges.groupBy("level", "src").agg(F.count(F.lit(1)).alias("out"))
    share = edges.join(out, ["level", "src"]).select("level", "src", "dst", (1 / F.col("out")).alias("share"))
    sinks = nodes.select("level", F.col("id").alias("src")).join(out, ["level", "src"], "left_anti").select("level", "src", F.lit(None).cast(edges.schema["dst"].dataType).alias("dst"), F.lit(1.0).alias("share"))
    share = staged(share.unionByName(sinks), "shares")
    rank = nodes.select("level", "id", (1.0 / F.col("n")).alias("rank"))
    for _ in range(rounds):
        got = share.join(rank.withColumnRenamed("id", "src"), ["level", "src"]).groupBy("level", F.col("dst").alias("id")).agg(F.sum(F.col("rank") * F.col("share")).alias("got"))
        got = staged(got, "got")
        lost = got.filter("id is null").select("level", F.col("got").alias("lost"))
        x = nodes.join(got.filter("id is not null"), ["level", "id"], "left").join(lost, "level", "left")
        rank = x.select("level", "id", ((1 - alpha) / F.col("n") + alpha * (F.coalesce("got", F.lit(0.0)) + F.coalesce("lost", F.lit(0.0)) / F.col("n"))).alias("rank"))
    rank = staged(rank, "rank")
    return rank.join(rank.groupBy("level").agg(F.max("rank").alias("top")), "level").select("level", "id", (F.col("rank") / F.col("top")).alias("rank"))


def pagerank(nodes: DataFrame, edges: DataFrame, rounds: int = 30, alpha: float = 0.85) -> DataFrame:
    """(id, rank) of one graph: see ``pagerank_levels``."""
    one = lambda df: df.withColumn("level", F.lit(0))
    return pagerank_levels(one(nodes.select("id")), one(edges.select("src", "dst")), rounds, alpha).select("id", "rank")


def reachable(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """Nodes reached from roots; one join per step, staged, until nothing new comes."""
    edges = staged(edges.select("src", "dst"), "edges")
    seen = front = staged(roots.select("id").distinct(), "front")
    while True:
        front = staged(edges.join(front, edges["src"] == front["id"]).select(F.col("dst").alias("id")).distinct().join(seen, "id", "left_anti"), "front")
        if front.isEmpty():
            break
        seen = seen.unionAll(front)
    return seen


# Kernels on one graph per level; their results depend on the order of nodes and edges. Nodes are numbers from 0
# in their order, so that a kernel needs a few numbers per node and edge, whatever the names are.


def numbers_of(edges: list[tuple], names: list) -> tuple[np.ndarray, np.ndarray]:
    """Both ends of edges as places in ``names``."""
    at = {v: i for i, v in enumerate(names)}
    return np.array([at[a] for a, _ in edges], "int64"), np.array([at[b] for _, b in edges], "int64")


def sorted_numbers(edges: list[tuple]) -> tuple[list, np.ndarray, np.ndarray]:
    names = sorted({v for e in edges for v in e})
    return names, *numbers_of(edges, names)


def out_lists(n: int, src: np.ndarray, dst: np.ndarray) -> tuple[memoryview, memoryview]:
    """Where each node's edges begin, and what they lead to, in the order of the edges."""
    start = np.zeros(n + 1, "int64")
    np.cumsum(np.bincount(src, minlength=n), out=start[1:])
    return memoryview(start), memoryview(dst[np.argsort(src, kind="stable")].astype("int32"))


def distinct_edges(n: int, src: np.ndarray, dst: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    key = np.unique(src * n + dst)
    return key // max(n, 1), key % max(n, 1)


def strong_parts(n: int, src: np.ndarray, dst: np.ndarray) -> np.ndarray:
    """The strongly connected component of each node, by Tarjan's walk without recursion."""
    start, to = out_lists(n, src, dst)
    at = memoryview(np.array(start[:-1], "int64"))
    part = np.full(n, -1, "int32")
    parts, index, low = memoryview(part), memoryview(np.full(n, -1, "int32")), memoryview(np.zeros(n, "int32"))
    stack, count, found = [], 0, 0
    for root in range(n):
        if index[root] >= 0:
            continue
        work = [root]
        index[root] = low[root] = count
        count += 1
        stack.append(root)
        while work:
            v = work[-1]
            i = at[v]
            if i < start[v + 1]:
                at[v] = i + 1
                w = to[i]
                if index[w] < 0:
                    index[w] = low[w] = count
                    count += 1
                    stack.append(w)
                    work.append(w)
                elif parts[w] < 0 and index[w] < low[v]:
                    low[v] = index[w]
                continue
            work.pop()
            if work and low[v] < low[work[-1]]:
                low[work[-1]] = low[v]
            if low[v] == index[v]:
                while True:
                    w = stack.pop()
                    parts[w] = found
                    if w == v:
                        break
                found += 1
    return part


def strong_components(edges: list[tuple]) -> list[list]:
    """Strongly connected components of a small graph, each sorted."""
    names, src, dst = sorted_numbers(edges)
    found: dict = {}
    for v, p in zip(names, strong_parts(len(names), src, dst).tolist(), strict=True):
        found.setdefault(p, []).append(v)
    return [found[p] for p in sorted(found)]


def back_edges(n: int, src: np.ndarray, dst: np.ndarray) -> int:
    """How many cycles ``back_edge_cycles`` lists: each back edge of the walk closes another one, so none is kept."""
    start, to = out_lists(n, *distinct_edges(n, src, dst))
    at, state, found = memoryview(np.array(start[:-1], "int64")), bytearray(n), 0  # 1: on the path, 2: done
    for root in range(n):
        if state[root]:
            continue
        state[root], path = 1, [root]
        while path:
            v = path[-1]
            i = at[v]
            if i < start[v + 1]:
                at[v] = i + 1
                w = to[i]
                if state[w] == 1:
                    found += 1
                elif not state[w]:
                    state[w] = 1
                    path.append(w)
            else:
                state[v] = 2
                path.pop()
    return found


def back_edge_cycles(edges: list[tuple]) -> list[list]:
    """One cycle per back edge of a depth-first walk in sorted order, turned to start at its least node."""
    out: dict = {}
    for a, b in edges:
        out.setdefault(a, set()).add(b)
        out.setdefault(b, set())
    done, path, at, found = set(), [], {}, {}
    for root in sorted(out):
        if root in done:
            continue
        work = [(root, iter(sorted(out[root])))]
        at[root] = 0
        path.append(root)
        while work:
            v, rest = work[-1]
            for w in rest:
                if w in at:
                    c = path[at[w] :]
                    k = c.index(min(c))
                    c = c[k:] + c[:k]
                    found["->".join(map(str, c))] = c
                elif w not in done:
                    at[w] = len(path)
                    path.append(w)
                    work.append((w, iter(sorted(out[w]))))
                    break
            else:
                work.pop()
                path.pop()
                del at[v]
                done.add(v)
    return [found[k] for k in sorted(found)]


def modularity_gap(nodes: list, edges: list[tuple], passes: int = 10) -> float:
    """1 - Q of one level of local moving on a small graph; nodes are visited in the given order."""
    known = set(nodes)
    return moved_gap(len(nodes), *numbers_of([e for e in edges if e[0] in known and e[1] in known], nodes), passes)


def moved_gap(n: int, src: np.ndarray, dst: np.ndarray, passes: int = 10) -> float:
    """1 - Q of one level of local moving; nodes are visited by their numbers, neighbours by the first edge between them."""
    keep = src != dst
    a, b = np.concatenate([src[keep], dst[keep]]), np.concatenate([dst[keep], src[keep]])
    two_m = len(a)
    if not two_m:
        return 0.0
    key, first, often = np.unique(a * n + b, return_index=True, return_counts=True)
    v, u = key // n, key % n
    by = np.lexsort((first % (two_m // 2), v))
    start, to = out_lists(n, v[by], u[by])
    weight, degree = memoryview(often[by].astype("int32")), memoryview(np.bincount(a, minlength=n))
    del a, b, key, first, often, v, u, by
    home, total, inner = memoryview(np.arange(n)), memoryview(np.array(degree)), memoryview(np.zeros(n))
    value = lambda c, add_in=0.0, add=0.0: (inner[c] + add_in) / two_m - ((total[c] + add) / two_m) ** 2
    for _ in range(passes):
        moved = False
        for v in range(n):
            links: dict = {}
            for i in range(start[v], start[v + 1]):
                c = home[to[i]]
                links[c] = links.get(c, 0) + weight[i]
            old, k = home[v], degree[v]
            total[old] -= k
            inner[old] -= 2 * links.get(old, 0)
            best, gain = old, 0.0
            for c in dict.fromkeys([old, *links]):
                g = value(c, 2 * links.get(c, 0), k) - value(c) + (k / two_m) ** 2
                if g > gain:
                    best, gain = c, g
            home[v] = best
            total[best] += k
            inner[best] += 2 * links.get(best, 0)
            moved |= best != old
        if not moved:
            break
    q = sum(value(c) for c in range(n) if total[c])
    return 1 - min(1.0, max(0.0, q))


def longest_path(edges: list[tuple], cap: int = 20) -> int:
    """``longest_walk`` of a small graph."""
    names, src, dst = sorted_numbers(edges)
    return longest_walk(len(names), src, dst, cap)


def longest_walk(n: int, src: np.ndarray, dst: np.ndarray, cap: int = 20) -> int:
    """Edges on the longest walk of a memoised depth-first search; a node on the stack counts 0."""
    start, to = out_lists(n, src, dst)
    at, state, best = memoryview(np.array(start[:-1], "int64")), bytearray(n), memoryview(np.zeros(n, "int32"))  # 1: on the stack, 2: done
    for root in range(n):
        if state[root]:
            continue
        state[root], work = 1, [root]
        while work:
            v = work[-1]
            i = at[v]
            if i < start[v + 1]:
                at[v] = i + 1
                w = to[i]
                if state[w]:
                    best[v] = min(cap, max(best[v], 1 + best[w] if state[w] == 2 else 1))
                else:
                    state[w] = 1
                    work.append(w)
            else:
                state[v] = 2
                work.pop()
                if work:
                    u = work[-1]
                    best[u] = min(cap, max(best[u], 1 + best[v]))
    return max(best, default=0)


def per_level(edges: DataFrame) -> DataFrame:
    """(level, n_scc, n_cycles, modularity_gap, longest): the kernels on each level's graph.

    ``edges`` has level, ord, src, dst. A level is one graph of a code base, and one task walks it; names and
    the order of edges become numbers before, so that the task's memory is some numbers per node and edge.
    """
    edges = edges.select("level", "ord", "src", "dst")
    ids = staged(numbered(edges.select("level", F.explode(F.array("src", "dst")).alias("id")).distinct(), [F.col("level"), F.col("id")]), "ids")
    base = staged(ids.groupBy("level").agg(F.min("n").alias("base")), "base")
    end = lambda c: ids.select("level", F.col("id").alias(c), F.col("n").alias(f"n_{c}"))
    x = numbered(edges, [F.col("level"), F.col("ord"), F.col("src"), F.col("dst")], "at").join(end("src"), ["level", "src"]).join(end("dst"), ["level", "dst"]).join(F.broadcast(base), "level")
    x = x.select("base", "at", (F.col("n_src") - F.col("base")).cast("int").alias("src"), (F.col("n_dst") - F.col("base")).cast("int").alias("dst"))

    def run(key: tuple, x: pa.Table) -> pa.Table:
        by = np.argsort(x["at"].to_numpy())
        src, dst = x["src"].to_numpy()[by].astype("int64"), x["dst"].to_numpy()[by].astype("int64")
        del by
        n = int(max(src.max(), dst.max())) + 1
        sizes, loops = strong_parts(n, src, dst), np.zeros(n, "bool")
        loops[src[src == dst]] = True
        many = np.bincount(sizes)[sizes] > 1
        n_scc = len(np.unique(sizes[many | loops]))
        both = np.stack([src, dst], axis=1).ravel()  # nodes are visited in the order in which edges name them
        met, first = np.unique(both, return_index=True)
        place = np.empty(n, "int64")
        place[met[np.argsort(first)]] = np.arange(n)
        del both, met, first
        row = {"base": key[0].as_py(), "n_scc": n_scc, "n_cycles": back_edges(n, src, dst), "modularity_gap": moved_gap(n, place[src], place[dst]), "longest": longest_walk(n, src, dst)}
        return pa.Table.from_pylist([row])

    found = x.groupBy("base").applyInArrow(run, "base long, n_scc long, n_cycles long, modularity_gap double, longest long")
    return base.join(found, "base").select("level", "n_scc", "n_cycles", "modularity_gap", "longest")


def heat(rank: Column, degree: Column, cross: Column, cycle: Column) -> Column:
    """Heatmap score of normalised parts."""
    return 0.4 * rank + 0.3 * degree + 0.2 * cross + 0.1 * cycle


def graph_levels(modules: DataFrame, files: DataFrame, deps: DataFrame, module_edges: DataFrame, domain: Column, calls: DataFrame, functions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """nodes (level, id, layer) and edges (level, src, dst) of the module, file, domain and function graphs, once each.

    Tests, specs and mocks are left out of modules and files. ``domain`` maps a column ``id`` of
    modules; edges of modules without a domain end in 'unassigned'. module_edges has (from_module, to_module).
    """
    from strata.functions.text import test_node

    own = lambda df, *cols: df.filter(~sum((test_node(F.col(c)).cast("int") for c in cols), F.lit(0)).cast("boolean"))
    pairs = module_edges.select(F.col("from_module").alias("src"), F.col("to_module").alias("dst")).distinct()
    layer = modules.select(F.col("id").alias("module"), "layer")
    file_edges = own(deps.select("src", "dst").distinct(), "src", "dst")
    file_nodes = own(files.join(layer, "module").select(F.col("path").alias("id"), "layer"), "id")
    more = file_edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct().join(file_nodes, "id", "left_anti").withColumn("layer", F.lit(None).cast("string"))
    of = modules.select("id", domain.alias("domain"))
    named = of.filter("domain is not null").select(F.col("domain").alias("id")).distinct()
    end = lambda c: of.select(F.col("id").alias(c), F.coalesce("domain", F.lit("unassigned")).alias(f"d{c}"))
    domain_edges = pairs.join(end("src"), "src").join(end("dst"), "dst").select(F.col("dsrc").alias("src"), F.col("ddst").alias("dst")).distinct()
    domain_nodes = named.unionByName(domain_edges.select(F.explode(F.array("src", "dst")).alias("id"))).distinct().withColumn("layer", F.col("id"))
    fn_edges = calls.select(F.col("caller").alias("src"), F.col("callee").alias("dst")).distinct()
    fn_layer = joined(functions, files.select(F.col("path").alias("file"), "module"), "file").join(layer, "module").groupBy(F.col("name").alias("id")).agg(F.min("layer").alias("layer"))
    at = lambda level, df: df.select(F.lit(level).alias("level"), *df.columns)
    nodes = [at("module", own(modules.select("id", "layer"), "id")), at("file", file_nodes.unionByName(more)), at("domain", domain_nodes), at("function", fn_layer)]
    edges = [at("module", own(pairs, "src", "dst")), at("file", file_edges), at("domain", domain_edges), at("function", fn_edges)]
    together = lambda parts: parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])
    return together(nodes), together(edges)


def level_degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(level, id, n_in, n_out) of all nodes."""
    ends = edges.select("level", F.col("dst").alias("id"), F.lit(1).alias("i"), F.lit(0).alias("o")).unionAll(edges.select("level", F.col("src").alias("id"), F.lit(0).alias("i"), F.lit(1).alias("o")))
    return ends.unionAll(nodes.select("level", "id", F.lit(0).alias("i"), F.lit(0).alias("o"))).groupBy("level", "id").agg(F.sum("i").alias("n_in"), F.sum("o").alias("n_out"))


def level_cross(nodes: DataFrame, edges: DataFrame, allowed: DataFrame | None = None) -> DataFrame:
    """(level, src, dst, cross): whether an edge leaves its layer, or, with rules (a, b), isn't allowed or has no layer."""
    a, b = nodes.select("level", F.col("id").alias("src"), F.col("layer").alias("a")), nodes.select("level", F.col("id").alias("dst"), F.col("layer").alias("b"))
    x = joined(joined(edges, a, ["level", "src"], "left"), b, ["level", "dst"], "left")
    if allowed is None:
        return x.select("level", "src", "dst", F.coalesce(F.col("a") != F.col("b"), F.lit(False)).cast("int").alias("cross"))
    return x.join(allowed.select("a", "b", F.lit(1).alias("ok")).distinct(), ["a", "b"], "left").select("level", "src", "dst", F.when(F.col("ok").isNull(), 1).otherwise(0).alias("cross"))


def level_entropy(deg: DataFrame) -> DataFrame:
    """(level, nodes, entropy) of the distribution of total degrees."""
    c = deg.groupBy("level", (F.col("n_in") + F.col("n_out")).alias("d")).agg(F.count(F.lit(1)).alias("c"))
    n = c.groupBy("level").agg(F.sum("c").alias("nodes"))
    p = F.col("c") / F.col("nodes")
    return c.join(n, "level").groupBy("level").agg(F.max("nodes").alias("nodes"), (-F.sum(p * F.log(p))).alias("entropy"))


def level_cycles(edges: DataFrame) -> DataFrame:
    """(level, id, part) of nodes on cycles: nodes that reach each other share a part; a loop alone is a part of one."""
    named = lambda c: F.concat_ws("\x01", "level", F.col(c).cast("string"))
    e = staged(edges.select("level", "src", "dst").distinct(), "edges")
    parts = cyclic_parts(e.select(named("src").alias("src"), named("dst").alias("dst")))
    parts = staged(parts.select(F.split_part("id", F.lit("\x01"), F.lit(1)).alias("level"), F.split_part("id", F.lit("\x01"), F.lit(2)).alias("id"), F.split_part("part", F.lit("\x01"), F.lit(2)).alias("part")), "parts")
    loops = joined(e.filter("src = dst").select("level", F.col("src").cast("string").alias("id")), parts, ["level", "id"], "left_anti")
    return parts.unionByName(loops.select("level", "id", F.col("id").alias("part")))


def ranked_levels(nodes: DataFrame, edges: DataFrame, rounds: int = 30, alpha: float = 0.85) -> DataFrame:
    """(level, id, rank, in_cycle): PageRank over its largest value, and membership of a cycle, per level."""
    all_ = nodes.select("level", "id").unionByName(edges.select("level", F.explode(F.array("src", "dst")).alias("id"))).distinct()
    rank = pagerank_levels(all_, edges, rounds, alpha)
    return rank.join(level_cycles(edges).select("level", "id", F.lit(True).alias("in_cycle")), ["level", "id"], "left").withColumn("in_cycle", F.coalesce("in_cycle", F.lit(False)))


def heatmap(nodes: DataFrame, edges: DataFrame, rounds: int = 30) -> DataFrame:
    """(level, id, score): rank, degree over the level's largest, share of edges that leave the layer, cycles."""
    from strata.functions.text import half_up

    deg = level_degrees(nodes, edges).withColumn("deg", F.col("n_in") + F.col("n_out"))
    x = level_cross(nodes, edges)
    both = x.select("level", F.col("src").alias("id"), "cross").unionByName(x.select("level", F.col("dst").alias("id"), "cross"))
    cross = both.groupBy("level", "id").agg(F.avg("cross").alias("cross"))
    most = deg.join(cross, ["level", "id"], "left").groupBy("level").agg(F.greatest(F.max("deg"), F.lit(1)).alias("most_deg"))
    y = ranked_levels(nodes, edges, rounds).join(deg, ["level", "id"]).join(cross, ["level", "id"], "left").join(most, "level")
    return y.select("level", "id", half_up(heat(F.col("rank"), F.col("deg") / F.col("most_deg"), F.coalesce("cross", F.lit(0.0)), F.col("in_cycle").cast("double")), 4).alias("score"))


def cycle_counts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(level, cycles): strongly connected components of more than one node or with a loop."""
    found = level_cycles(edges).groupBy("level").agg(F.countDistinct("part").alias("cycles"))
    return nodes.select("level").distinct().join(found, "level", "left").fillna(0, ["cycles"])


def induced(edges: DataFrame, kept: DataFrame) -> DataFrame:
    """Edges with both ends among ``kept`` (id)."""
    return edges.join(kept.select(F.col("id").alias("src")), "src", "left_semi").join(kept.select(F.col("id").alias("dst")), "dst", "left_semi").select("src", "dst")


def dag_depth(edges: DataFrame, cap: int = 20) -> DataFrame:
    """One row: edges on the longest path of an acyclic graph, up to ``cap``, by one join a step."""
    edges = staged(edges.select("src", "dst"), "edges")
    front, depth = edges.select(F.col("dst").alias("id")).distinct(), 0
    while depth < cap:
        front = staged(front, "front")
        if front.isEmpty():
            break
        depth += 1
        front = edges.join(front, edges["src"] == front["id"]).select(F.col("dst").alias("id")).distinct()
    return edges.sparkSession.range(1).select(F.lit(depth).cast("long").alias("depth"))


def expanded(seeds: DataFrame, edges: DataFrame) -> DataFrame:
    """Seeds and what is one undirected step away."""
    both = edges.select("src", "dst").unionAll(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    return seeds.select("id").unionByName(both.join(seeds.select(F.col("id").alias("src")), "src", "left_semi").select(F.col("dst").alias("id"))).distinct()


def unused_exports(exports: DataFrame, imports: DataFrame, entrypoints: DataFrame) -> DataFrame:
    """(file, symbol) that nothing imports; files that are imported whole ('*') or are entry points count as used."""
    whole = imports.filter("symbol = '*'").select("file").unionByName(entrypoints.select("file")).distinct()
    return exports.join(whole, "file", "left_anti").join(imports.select("file", "symbol").distinct(), ["file", "symbol"], "left_anti").select("file", "symbol")


def walked_tree(edges: DataFrame, root: str, cap: int = 20) -> DataFrame:
    """(src, dst, ord): edges by which a breadth-first walk first reaches a node, at most ``cap`` nodes.

    A step takes all nodes of one distance at once: each new node hangs on its first parent, and new
    nodes stand in order of parent and name, which is the order of a walk node by node. There are
    fewer steps than ``cap``, and no step keeps more than ``cap`` rows.
    """
    edges = staged(edges.select("src", "dst").distinct(), "edges")
    reached = edges.sparkSession.range(1).select(F.lit(None).cast("string").alias("src"), F.lit(root).alias("dst"), F.lit(0).alias("ord"))
    front, n = reached, 1
    while n < cap:
        new = edges.join(front.select(F.col("dst").alias("src"), "ord"), "src").join(reached.select("dst"), "dst", "left_anti")
        new = new.groupBy("dst").agg(F.min(F.struct("ord", "src")).alias("by")).orderBy("by", "dst").limit(cap - n)
        place = (F.row_number().over(Window.orderBy("by", "dst")) + (n - 1)).cast("int")  # of at most cap rows
        front = staged(new.select(F.col("by.src").alias("src"), "dst", place.alias("ord")), "front")
        found = front.count()
        if not found:
            break
        reached, n = reached.unionByName(front), n + found
    return reached.filter("src is not null").select("src", "dst", (F.col("ord") - 1).alias("ord"))


def community_modularity(members: DataFrame, edges: DataFrame) -> DataFrame:
    """(level, modularity, gap) of given communities: members (level, id, community), edges (level, src, dst).

    Edges count without direction and as often as they are given; loops and edges with an end that is
    no member are left out. gap is 1 - modularity within 0 and 1; a level without edges has a
    modularity and a gap of 0. A level's sums are formed by grouped aggregation over its edges.
    """
    m = members.select("level", "id", F.coalesce(F.col("community").cast("string"), F.lit("")).alias("community"))
    end = lambda c: m.select("level", F.col("id").alias(c), F.col("community").alias(f"c{c}"))
    e = joined(joined(edges.filter("src <> dst"), end("src"), ["level", "src"]), end("dst"), ["level", "dst"])
    e = e.groupBy("level", "csrc", "cdst").agg(F.count(F.lit(1)).alias("n"))
    inside = F.when(F.col("csrc") == F.col("cdst"), F.col("n")).otherwise(0)
    sums = e.select("level", F.explode(F.array(F.struct(F.col("csrc").alias("c"), inside.alias("i"), "n"), F.struct(F.col("cdst").alias("c"), inside.alias("i"), "n"))).alias("x")).groupBy("level", "x.c").agg(F.sum("x.i").alias("i"), F.sum("x.n").alias("k"))
    two_m = F.sum("k").over(Window.partitionBy("level"))  # a row per community
    q = sums.withColumn("part", F.col("i") / two_m - (F.col("k") / two_m) ** 2).groupBy("level").agg(F.sum("part").alias("modularity"))
    x = members.select("level").distinct().join(q, "level", "left")
    return x.select("level", F.coalesce("modularity", F.lit(0.0)).alias("modularity"), F.coalesce(1 - F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("modularity"))), F.lit(0.0)).alias("gap"))
