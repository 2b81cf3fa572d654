"""Drift, capacity, growth, contracts, snapshots, coverage, retrieval metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strata.functions.text import clamp, half_up

from .numbering import numbered

# Weights of the drift score.
WEIGHTS = {"entropy": 0.4, "cross_layer": 0.3, "cycles": 0.2, "modularity": 0.1}


def drift_score(entropy: Column, cross_layer: Column, cycles: Column, modularity: Column) -> Column:
    return WEIGHTS["entropy"] * entropy + WEIGHTS["cross_layer"] * cross_layer + WEIGHTS["cycles"] * cycles + WEIGHTS["modularity"] * modularity


def drift_delta(score: Column, layers: Column, baseline: Column | None = None) -> Column:
    k = F.log(F.greatest(F.lit(2.0), layers.cast("double")))
    return (k if baseline is None else F.coalesce(baseline, k)) - F.log(score + 1e-6)


def drift_status(delta: Column, critical: float = 0.25) -> Column:
    return F.when(delta < 0, "drift").when(delta < critical, "critical").otherwise("stable")


def capacity_status(used: Column, budget: Column, warning: float = 0.85, critical: float = 1.0) -> Column:
    return F.when(budget.isNull() | (budget <= 0), "unbudgeted").when(used / budget >= critical, "critical").when(used / budget >= warning, "warning").otherwise("ok")


def growth(points: DataFrame, key: str, ts: str, value: str) -> DataFrame:
    """Per key: each point's difference to the one before, per hour, and the trend."""
    w = Window.partitionBy(key).orderBy(ts)
    before, when = F.lag(value).over(w), F.lag(ts).over(w)
    hours = (F.unix_micros(F.col(ts).cast("timestamp")) - F.unix_micros(when.cast("timestamp"))) / 3.6e9
    delta = F.col(value) - before
    x = points.withColumn("delta", delta).withColumn("per_hour", F.when(hours > 0, delta / hours))
    return x.withColumn("trend", F.when(F.col("per_hour").isNull(), "insufficient_data").when(F.col("delta") > 0, "increasing").when(F.col("delta") < 0, "decreasing").otherwise("stable"))


def keyed_diff(before: DataFrame, after: DataFrame, key: str, value: str) -> DataFrame:
    """(key, status): added, removed, changed or same, by one full outer join."""
    a, b = before.select(key, F.col(value).alias("old"), F.lit(True).alias("in_old")), after.select(key, F.col(value).alias("new"), F.lit(True).alias("in_new"))
    status = F.when(F.col("in_old").isNull(), "added").when(F.col("in_new").isNull(), "removed").when(F.col("old").eqNullSafe(F.col("new")), "same").otherwise("changed")
    return a.join(b, key, "full_outer").select(key, "old", "new", status.alias("status"))


def contract_status(backend: Column, frontend: Column) -> Column:
    """mismatched if the caller sends fields that aren't known, unverified without a schema, else ok."""
    return F.when(F.size(backend) <= 0, "unverified").when(F.size(F.array_except(frontend, backend)) > 0, "mismatched").otherwise("ok")


def prioritised_match(calls: DataFrame, targets: DataFrame, keys: list[tuple[str, str]], call_id: str) -> DataFrame:
    """Each call with its target by the first (call column, target column) that matches; equi joins only."""
    found = None
    for rank, (a, b) in enumerate(keys):
        one = calls.join(targets, calls[a] == targets[b]).withColumn("match_rank", F.lit(rank))
        found = one if found is None else found.unionByName(one)
    return found.withColumn("k", F.row_number().over(Window.partitionBy(call_id).orderBy("match_rank", *[c for c in targets.columns]))).filter("k = 1").drop("k")


def retrieval_metrics(ranked: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    """Per query: hits, precision, recall, f1 in the first k of ranked (query, item, rank); truth has (query, item)."""
    hits = ranked.filter(F.col("rank") <= k).join(truth, ["query", "item"], "left_semi").groupBy("query").agg(F.count(F.lit(1)).alias("hits"))
    shown = ranked.filter(F.col("rank") <= k).groupBy("query").agg(F.count(F.lit(1)).alias("shown"))
    x = truth.groupBy("query").agg(F.count(F.lit(1)).alias("relevant")).join(hits, "query", "left").join(shown, "query", "left").fillna(0, ["hits", "shown"])
    p = F.when(F.col("shown") > 0, F.col("hits") / F.col("shown")).otherwise(0.0)
    r = F.col("hits") / F.col("relevant")
    f1 = F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0)
    return x.select("query", F.col("hits").cast("long").alias("hits"), half_up(p, 6).alias("precision"), half_up(r, 6).alias("recall"), half_up(f1, 6).alias("f1"))


def signed_rank(pairs: DataFrame, a: str, b: str, ties: list[str] | None = None) -> DataFrame:
    """Signed-rank sums of paired results, ranks by |difference| without ties, zero differences left out.

    ``ties`` orders equal differences and should tell rows apart.
    """
    d = pairs.withColumn("d", F.col(a) - F.col(b)).filter("d <> 0")
    r = numbered(d, [F.abs("d"), *map(F.col, ties or [a, b])], "r")
    plus, minus = F.sum(F.when(F.col("d") > 0, F.col("r")).otherwise(0)), F.sum(F.when(F.col("d") < 0, F.col("r")).otherwise(0))
    return r.agg(plus.cast("long").alias("w_plus"), minus.cast("long").alias("w_minus"), F.count(F.lit(1)).alias("n"))


def impact_level(total: Column) -> Column:
    return F.when(total > 5, "HIGH").when(total > 2, "MED").otherwise("LOW")


def confidence(depth: Column, fanout: Column, density: Column, cycle: Column, share: Column) -> Column:
    return 0.35 * clamp(depth / 10, 0, 1) + 0.2 * clamp(fanout / 3, 0, 1) + 0.15 * clamp(density / 3, 0, 1) + 0.15 * cycle + 0.15 * share


def primary_level(levels: DataFrame, asked: str = "auto") -> DataFrame:
    """The row of the level asked for, if there; else function before module, file and domain."""
    order = [x for x in dict.fromkeys([asked, "function", "module", "file", "domain"]) if x != "auto"]
    rank = F.array_position(F.array(*map(F.lit, order)), F.col("level"))
    rest = [c for c in levels.columns if c != "level"]
    best = levels.groupBy().agg(F.min_by(F.struct("level", *rest), F.when(rank == 0, 99).otherwise(rank)).alias("r"))
    return best.filter("r is not null").select("r.*")


def worst(status: Column) -> Column:
    """The most severe of capacity statuses, as an aggregate."""
    order = F.when(status == "critical", 3).when(status == "warning", 2).when(status == "ok", 1).otherwise(0)
    return F.max_by(status, order)


def decision(reasons: Column, hard: Column) -> Column:
    return F.when(F.size(reasons) == 0, "accept").when(hard, "reject").otherwise("warn")


def candidate_reasons(x: dict[str, Column], most_growth: float) -> Column:
    """Why a change isn't accepted as it is: columns old_delta, delta, old_edges, edges, status, capacity, growth, old_shape, shape."""
    ratio = (x["edges"] - x["old_edges"]) / x["old_edges"]
    tests = [
        (x["old_delta"].isNull(), "baseline_missing"), (x["delta"] < x["old_delta"], "delta_regressed"), ((x["old_edges"] > 0) & F.lit(most_growth > 0) & (ratio > most_growth), "edge_growth_ratio_exceeded"),
        (x["status"] == "drift", "candidate_in_drift"), (x["capacity"] == "critical", "capacity_critical"), (x["growth"] == "critical", "growth_critical"), (x["old_shape"] != x["shape"], "shape_changed"),
    ]
    return F.array_compact(F.array(*(F.when(t, F.lit(r)) for t, r in tests)))


def gate_fails(status: Column, delta: Column, baseline: Column, threshold: float = 0.15) -> Column:
    """The verification gate: critical status, or a shift of delta over the threshold; drift alone passes."""
    return (status == "critical") | F.coalesce(F.abs(delta - baseline) > threshold, F.lit(False))


def depth_level(depth: Column) -> Column:
    return F.when(depth <= 2, "LOW").when(depth <= 5, "MEDIUM").otherwise("HIGH")


def propagation(avg: Column, most: Column) -> Column:
    return F.when((avg > 2) | (most > 5), "STRONG").when((avg > 1.2) | (most > 2), "MODERATE").otherwise("LOCAL")


def compressibility(depth: Column, spread: Column, cycles: Column) -> Column:
    return F.when(cycles | ((depth == "HIGH") & (spread == "STRONG")), "NON_COMPRESSIBLE").when((depth == "LOW") & (spread == "LOCAL"), "COMPRESSIBLE").otherwise("PARTIAL")


def confidence_level(x: Column) -> Column:
    return F.when(x >= 0.8, "STRONG").when(x >= 0.6, "MODERATE").otherwise("WEAK")


def ambiguity(seeds: Column, nodes: Column) -> Column:
    share = seeds / nodes
    return F.when(nodes == 0, "HIGH").when(share < 0.1, "HIGH").when(share < 0.3, "MEDIUM").otherwise("LOW")
