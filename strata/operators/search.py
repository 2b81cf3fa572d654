"""Full-text and hybrid search over posting tables."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strata.functions.text import clamp
from strata.sources.staging import staged

K1, B, LEAST_IDF = 1.2, 0.75, 1e-6


def postings(docs: DataFrame, id_col: str, weights: dict[str, float], token: str = r"[^a-z0-9]+") -> DataFrame:
    """(id, token, w, n): weighted and plain occurrences of each token in each document."""
    parts = None
    for column, weight in weights.items():
        one = docs.select(F.col(id_col).alias("id"), F.explode(F.split(F.lower(F.coalesce(column, F.lit(""))), token)).alias("token"), F.lit(float(weight)).alias("w")).filter("token <> ''")
        parts = one if parts is None else parts.unionByName(one)
    return parts.groupBy("id", "token").agg(F.sum("w").alias("w"), F.count(F.lit(1)).alias("n"))


def row_postings(docs: DataFrame, id_col: str, text: str, token: str = r"[^a-z0-9]+") -> DataFrame:
    """(id, token, w, n) of each row of ``docs``, counted where the row is: nothing is shuffled.

    Sums over it are those over ``postings``; rows that share an id have rows of their own.
    """
    x = docs.select(F.col(id_col).alias("id"), F.lower(F.coalesce(text, F.lit(""))).alias("text"))
    kind = x.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def packed(at, tokens, counts):
            ids = batch.column(0).take(pa.array(at, pa.int32()))
            return pa.RecordBatch.from_arrays([ids, pa.array(tokens, pa.string()), pa.array(counts, pa.float64()), pa.array(counts, pa.int64())], names=["id", "token", "w", "n"])

        for batch in batches:
            at, tokens, counts = [], [], []
            for i, one in enumerate(batch.column(1)):
                seen = Counter(re.split(token, one.as_py()))
                seen.pop("", None)
                at.extend([i] * len(seen))
                tokens.extend(seen.keys())
                counts.extend(seen.values())
                if len(at) > 100_000:
                    yield packed(at, tokens, counts)
                    at, tokens, counts = [], [], []
            yield packed(at, tokens, counts)

    return x.mapInArrow(run, f"id {kind}, token string, w double, n long")


def field_postings(docs: DataFrame, id_col: str, weights: dict[str, float], token: str = r"[^a-z0-9]+") -> DataFrame:
    """(id, token, w, n) of each row of ``docs`` over several columns, counted where the row is; a row has one of token '' and n 0 too.

    Sums over it without '' are ``postings``.
    """
    x = docs.select(F.col(id_col).alias("id"), *(F.lower(F.coalesce(c, F.lit(""))).alias(f"c{i}") for i, c in enumerate(weights)))
    kind, each = x.schema["id"].dataType.simpleString(), [float(w) for w in weights.values()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in range(0, batch.num_rows, 1_000):
                some = batch.slice(s, 1_000)
                at, tokens, ws, ns = [], [], [], []
                for i, texts in enumerate(zip(*(some.column(c + 1).to_pylist() for c in range(len(each))), strict=True)):
                    w, n = {"": 0.0}, {"": 0}
                    for weight, text in zip(each, texts, strict=True):
                        for t in re.split(token, text):
                            if t:
                                w[t] = w.get(t, 0.0) + weight
                                n[t] = n.get(t, 0) + 1
                    at.extend([i] * len(n))
                    tokens.extend(n)
                    ws.extend(w.values())
                    ns.extend(n.values())
                yield pa.RecordBatch.from_arrays([some.column(0).take(pa.array(at, pa.int32())), pa.array(tokens, pa.string()), pa.array(ws, pa.float64()), pa.array(ns, pa.int64())], names=["id", "token", "w", "n"])

    return x.mapInArrow(run, f"id {kind}, token string, w double, n long")


def in_order(key: str, part: Column) -> Column:
    """The sum of a few parts in the order of their keys, so that equal parts give equal sums in every group."""
    return F.aggregate(F.array_sort(F.collect_list(F.struct(key, part.alias("part")))), F.lit(0.0), lambda a, e: a + e["part"])


def bm25(index: DataFrame, n_docs: int, query: list[str]) -> DataFrame:
    """(id, score, matched): prefix BM25 over ``postings`` or ``row_postings``, more negative is better.

    Documents' lengths and the query's postings come from one scan of the index; token statistics
    are a handful of rows and are attached by a broadcast of that bounded table.
    """
    length = index.groupBy("id").agg(F.sum("n").alias("len"))
    mean = index.agg((F.sum("n") / F.lit(n_docs)).alias("avgdl"))
    q = F.explode(F.filter(F.array(*(F.lit(t) for t in query)), lambda t: F.col("token").startswith(t))).alias("q")
    near = " or ".join("token like '" + t.replace("'", "''") + "%'" for t in query)
    hits = index.filter(near).select("id", "w", q).groupBy("id", "q").agg(F.sum("w").alias("f"))
    idf = hits.groupBy("q").agg(F.count(F.lit(1)).alias("n_q")).withColumn("idf", F.log((F.lit(n_docs) - F.col("n_q") + 0.5) / (F.col("n_q") + 0.5)))
    idf = idf.select("q", F.when(F.col("idf") > 0, F.col("idf")).otherwise(LEAST_IDF).alias("idf"))
    part = F.col("idf") * F.col("f") * (K1 + 1) / (F.col("f") + K1 * (1 - B + B * F.col("len") / F.col("avgdl")))
    scored = hits.join(F.broadcast(idf), "q").join(length, "id").join(F.broadcast(mean))
    return scored.groupBy("id").agg((-in_order("q", part)).alias("score"), F.count(F.lit(1)).alias("matched"))


def authority_quality(n_in: Column, n_out: Column, example: Column) -> Column:
    """1 without edges, else 0.7 + 0.3 times the incoming share; halved for examples."""
    base = F.when(n_in + n_out == 0, 1.0).otherwise(0.7 + 0.3 * n_in / (n_in + n_out))
    return F.when(example, base * 0.5).otherwise(base)


def min_max(x: Column, over) -> Column:
    low, high = F.min(x).over(over), F.max(x).over(over)
    return (x - low) / F.when(high > low, high - low).otherwise(1.0)


def blended(bm25_norm: Column, authority: Column, vector: Column | None = None) -> Column:
    return 0.7 * bm25_norm + 0.3 * authority if vector is None else 0.5 * bm25_norm + 0.2 * authority + 0.3 * vector


def signal(coverage: Column, joint: Column, clustering: Column) -> Column:
    """Query quality from token coverage, the best joint match and its clustering."""
    return 0.35 * coverage + 0.45 * clamp(-joint / 8, 0, 1) + 0.2 * clustering


def level(x: Column) -> Column:
    return F.when(x >= 0.55, "high").when(x >= 0.25, "medium").otherwise("low")


def item_score(texts: Column, name: Column, file: Column, tokens: list[str]) -> Column:
    """Mean over tokens of exact 1, name .7, a text .4, file .2, with .15 more if the name holds the phrase; at most 1.

    texts: an array of strings.
    """
    n, f = F.lower(name), F.lower(F.coalesce(file, F.lit("")))
    held = lambda k: F.exists(texts, lambda t: F.lower(t).contains(k))
    total = F.lit(0.0)
    for k in tokens:
        total = total + F.when(n == k, 1.0).when(n.contains(k), 0.7).when(F.coalesce(held(k), F.lit(False)), 0.4).when(f.contains(k), 0.2).otherwise(0.0)
    phrase = F.when(n.contains(" ".join(tokens)), 0.15).otherwise(0.0) if tokens else F.lit(0.0)
    return F.least((total + phrase) / max(1, len(tokens)), F.lit(1.0))


def field_tier(value: Column, query: str) -> Column:
    """How a field answers a query: equal 1, contains .8, all of several tokens .6, two tokens of three letters .45, one .3."""
    tokens = query.lower().split()
    x = F.lower(F.coalesce(value, F.lit("")))
    hits = sum((x.contains(t).cast("int") for t in tokens), F.lit(0))
    long = sum((x.contains(t).cast("int") for t in tokens if len(t) >= 3), F.lit(0))
    some = F.when(x == query.lower(), 1.0).when(x.contains(query.lower()), 0.8).when((hits == len(tokens)) & F.lit(len(tokens) > 1), 0.6).when(long >= 2, 0.45).when(long == 1, 0.3).otherwise(0.0)
    return F.when(x == "", 0.0).otherwise(some)


def field_score(fields: list[tuple[Column, float]], query: str) -> Column:
    """The best weighted field."""
    scores = [weight * field_tier(field, query) for field, weight in fields]
    return F.greatest(*scores) if len(scores) > 1 else scores[0]


def best_field(fields: Column, query: str) -> Column:
    """The best weighted field of an array of (value, weight); 0 without fields."""
    return F.coalesce(F.array_max(F.transform(fields, lambda f: f["weight"] * field_tier(f["value"], query))), F.lit(0.0))


def focus_score(tokens: list[str], name: Column, file: Column, values: Column) -> Column:
    """Mean over tokens of exact 1, name .8, file .55, any value .4."""
    n, f = F.lower(name), F.lower(file)
    total = F.lit(0.0)
    for k in tokens:
        total = total + F.when(n == k, 1.0).when(n.contains(k), 0.8).when(f.contains(k), 0.55).when(F.exists(values, lambda v: F.lower(v).contains(k)), 0.4).otherwise(0.0)
    return total / max(1, len(tokens))


def query_tokens(query: str) -> list[str]:
    """Words of a query: identifiers split, single letters dropped, only letters and digits; nothing for what is left empty."""
    spaced = re.sub(r"([A-Z]+)([A-Z][a-z])", r"\1 \2", re.sub(r"([a-z])([A-Z])", r"\1 \2", query.replace("_", " "))).lower()
    return [x for t in spaced.split() if len(t) > 1 and (x := re.sub("[^a-z0-9]", "", t))]


# Words with which commit messages begin.
CLOSERS, KINDS = "Fixed Refs Closes Resolved".split(), "feat fix chore docs test refactor style perf ci build".split()


def clean_query(q: Column) -> Column:
    """A query without issue numbers, commit prefixes and dashes, its identifiers split."""
    steps = [(r"\(#\d+\)", ""), (r"#\d+\s*", ""), (rf"(?i)^(?:{'|'.join(CLOSERS)})\s*(?:#\d+\s*)?--?\s*", ""), (rf"(?i)^(?:{'|'.join(KINDS)})(?:\([^)]+\))?!?:\s*", ""), (r"\s*--\s*", " "),
             (r"([a-z])([A-Z])", "$1 $2"), (r"([A-Z]+)([A-Z][a-z])", "$1 $2"), ("_", " "), (r"\s+", " ")]
    for pattern, to in steps:
        q = F.regexp_replace(q, pattern, to)
    return F.trim(q)


def glob_keywords(pattern: str) -> list[str]:
    """The telling parts of a glob pattern."""
    bare = re.sub(r"[\[\]{}]", " ", re.sub(r"\.\w+$", "", re.sub(r"\*\*?", " ", pattern)))
    return [s for s in re.split(r"[/\s]+", bare) if len(s) > 2 and s not in ("src", "lib", "dist", "app", "index")]


def first_hits(attempts: list[Callable[[], DataFrame]]) -> DataFrame:
    """The first result that has rows, else the last one."""
    for attempt in attempts[:-1]:
        found = attempt()
        if not found.isEmpty():
            return found
    return attempts[-1]()


FILE_WEIGHTS = {"path": 1.0, "symbol": 0.5, "endpoint": 0.7, "body": 1.0, "module": 0.6}
SYMBOL_WEIGHTS = {"name": 0.5, "body": 1.0}


def best_documents(index, n_docs: int, query: list[str], k: int) -> DataFrame:
    """The k best of a stored index or of a table of postings: (id, score)."""
    found = bm25(index, n_docs, query) if isinstance(index, DataFrame) else index.search(query, k)
    return found.orderBy(F.round("score", 9), "id").limit(k).select("id", "score")


def file_search(index, n_docs: int, query: list[str], deps: DataFrame, symbols: DataFrame, k: int = 5) -> DataFrame:
    """(id, combined, matched) of the k best files: BM25 of a pool, weighted by how often files are imported.

    index: a TextIndex or postings of FILE_WEIGHTS; deps (src, dst); symbols (id, symbol) are words of names.
    """
    pool = staged(best_documents(index, n_docs, query, max(4 * k, 60)), "pool")  # used three times
    out = deps.select(F.col("src").alias("id"), "dst").distinct().join(F.broadcast(pool.select("id")), "id", "left_semi").groupBy("id").agg(F.count(F.lit(1)).alias("n_out"))
    into = deps.select(F.col("dst").alias("id"), "src").distinct().join(F.broadcast(pool.select("id")), "id", "left_semi").groupBy("id").agg(F.count(F.lit(1)).alias("n_in"))
    sample = F.col("id").rlike(r"(?i)(^|/)(examples?|demos?|samples?)(/|$)")
    x = pool.join(out, "id", "left").join(into, "id", "left").fillna(0, ["n_out", "n_in"]).withColumn("combined", F.col("score") * authority_quality(F.col("n_in"), F.col("n_out"), sample))
    best = x.orderBy(F.round("combined", 9), "id").limit(k).select("id", "combined")
    near = F.array_contains(F.transform(F.array(*map(F.lit, query)), lambda q: F.col("symbol").contains(q)), True)
    hit = symbols.filter(near).join(F.broadcast(best.select("id")), "id", "left_semi").groupBy("id").agg(F.slice(F.array_sort(F.collect_set("symbol")), 1, 6).alias("matched"))
    return best.join(hit, "id", "left").withColumn("matched", F.coalesce("matched", F.array().cast("array<string>")))


CALLERS, CALLEES = 30, 40


def symbol_search(index, n_docs: int, query: list[str], functions: DataFrame, calls: DataFrame, vectors: DataFrame | None = None, k: int = 10) -> DataFrame:
    """(id, score) of the k best functions: BM25, how often source files call them, callees of the best, vectors.

    index: a TextIndex or postings of SYMBOL_WEIGHTS over functions (id, name, file, line); calls (caller, callee,
    caller_file); vectors (id, sim). Pools are small and are broadcast; calls are aggregated once a use.
    """
    from strata.functions.text import non_source

    source = calls.filter(~F.lower("caller_file").rlike("test|spec|mock|fixture|example|demo|sample"))
    pool = best_documents(index, n_docs, query, max(5 * k, 60)).select("id", (-F.col("score")).alias("v"))
    pool = staged(pool.join(functions, "id"), "pool")  # used five times below
    degree = source.join(F.broadcast(pool.select(F.col("name").alias("callee")).distinct()), "callee", "left_semi").groupBy(F.col("callee").alias("name")).agg(F.count(F.lit(1)).alias("indegree"))
    callers = pool.orderBy(F.desc(F.round("v", 9)), "id").limit(CALLERS).select(F.col("name").alias("caller")).distinct()
    hits = source.join(F.broadcast(callers), "caller", "left_semi").groupBy(F.col("callee").alias("name")).agg(F.count(F.lit(1)).alias("hits"))
    callees = staged(functions.join(hits, "name").orderBy(F.desc("hits"), "id").limit(CALLEES), "callees")  # used twice
    one = pool.agg(F.max("v").alias("most"), F.min("v").alias("least"), F.least(F.count(F.lit(1)), F.lit(CALLERS)).alias("callers"))
    top = pool.select("name").distinct().join(degree, "name").agg(F.coalesce(F.max("indegree"), F.lit(1)).alias("most_in"))
    sims = vectors if vectors is not None else functions.sparkSession.createDataFrame([], "id long, sim double")
    b, a, v, c, cv = (0.5, 0.2, 0.3, 0.35, 0.3) if vectors is not None else (0.7, 0.3, 0.0, 0.45, 0.0)
    sim = F.coalesce("sim", F.lit(0.0))
    halved = lambda s: F.when(non_source(F.col("file")), s * 0.5).otherwise(s)
    x = pool.join(degree, "name", "left").join(callees.select("name", F.lit(True).alias("called")).distinct(), "name", "left").join(sims, "id", "left").crossJoin(F.broadcast(one)).crossJoin(F.broadcast(top))
    norm = (F.col("v") - F.col("least")) / F.when(F.col("most") > F.col("least"), F.col("most") - F.col("least")).otherwise(1.0)
    bonus = F.when(~non_source(F.col("file")) & F.coalesce("called", F.lit(False)) & (norm < 0.2), 0.28).otherwise(0.0)
    first = x.select("id", halved(b * norm + a * F.coalesce("indegree", F.lit(0)) / F.col("most_in") + v * sim + bonus).alias("score"))
    y = callees.join(F.broadcast(pool.select("name").distinct()), "name", "left_anti").join(sims, "id", "left").crossJoin(F.broadcast(one))
    second = y.select("id", halved(c * F.col("hits") / F.greatest("callers", F.lit(1)) + cv * sim).alias("score"))
    return first.unionByName(second).orderBy(F.desc(F.round("score", 9)), "id").limit(k)


def categorical(items: DataFrame, query: str, caps: dict[str, int]) -> DataFrame:
    """(category, label, score, place): the best items (category, ord, label, fields) of each category, as many as its cap."""
    x = items.withColumn("score", best_field(F.col("fields"), query)).filter("score > 0")
    x = x.withColumn("place", F.row_number().over(Window.partitionBy("category").orderBy(F.desc("score"), "ord")))
    cap = F.element_at(F.create_map(*(F.lit(v) for kv in caps.items() for v in kv)), F.col("category"))
    return x.filter(F.col("place") <= cap).select("category", "label", "score", "place")


def snapshot_matches(items: DataFrame, tokens: list[str], ranks: DataFrame, most_functions: int = 10) -> DataFrame:
    """(type, name, score) of items (type, name, file, texts); files and functions are blended with their file's rank (file, rank).

    Functions are cut to the best ``most_functions`` before they are merged.
    """
    score = item_score(F.col("texts"), F.col("name"), F.col("file"), tokens)
    x = items.withColumn("score", score).filter("score > 0").join(ranks, "file", "left")
    blend = F.col("type").isin("files", "functions")
    x = x.select("type", "name", F.when(blend, 0.7 * F.col("score") + 0.3 * F.coalesce("rank", F.lit(0.0))).otherwise(F.col("score")).alias("score"))
    best = x.filter("type = 'functions'").orderBy(F.desc("score"), "name").limit(most_functions)
    return x.filter("type <> 'functions'").unionByName(best)
