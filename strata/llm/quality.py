"""Document quality with hierarchical empirical Bayes over hosts and paths.

A logistic classifier on features of the whole text gives each document its log evidence. The
soft verdicts of all documents are summed by host and by path within host (grouped
aggregation, partial sums before the shuffle). A host's rate is shrunk to the global rate, a
path's rate to its host's, each by a strength found by the method of moments from the spread
between groups, so sparse sites fall back to the prior above them. A document's score combines
its own evidence with its path's rate without itself.

The classifier is fitted on at most ``LABELLED`` labelled ids, those with the smallest hash of
their id; everything else uses all rows.

Defined cases: null text counts as empty and gets the features of an empty text; null hosts and
paths form groups of their own; without labels all evidence is zero and everything is accepted;
labels other than 0 and 1 and labels of null ids are ignored, of several labels of an id the least
counts, and of several texts of an id the one with the smallest row key; rows with null ids are scored like others;
repeated rows each count and are each scored; an empty table gives an empty result; further
columns are ignored by the scorer and kept by the filter.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_rows, row_key, staged, without

LABELLED = 20_000
SALTS = 16
FEATURES = ["upper", "marks", "digits", "distinct", "repeats", "word_len", "n_words", "ends"]


def features(text: Column) -> list[Column]:
    """Eight numbers from the whole text; the word array is read from the column ``words``."""
    n = F.greatest(F.length(text), F.lit(1)).cast("double")
    words = F.col("words")
    k = F.greatest(F.size(words), F.lit(1)).cast("double")
    share = lambda chars: (F.length(text) - F.length(F.translate(text, chars, ""))) / n
    twice = F.size(F.filter(F.sequence(F.lit(1), F.greatest(F.size(words) - 1, F.lit(1))), lambda i: F.get(words, i) == F.get(words, i - 1)))
    return [
        share("ABCDEFGHIJKLMNOPQRSTUVWXYZÄÖÜÉÈÊÀÇÑÓÍÁÚ").alias("upper"),
        share("!#$%&*|<>{}[]=_~^").alias("marks"),
        share("0123456789").alias("digits"),
        (F.size(F.array_distinct(words)) / k).alias("distinct"),
        (twice / k).alias("repeats"),
        F.log1p(n / k).alias("word_len"),
        F.log1p(k).alias("n_words"),
        share(".,;:?").alias("ends"),
    ]


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 25) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Newton steps on standardised inputs: (means, deviations, weights with the constant first)."""
    mean, dev = x.mean(axis=0), x.std(axis=0) + 1e-9
    z = np.column_stack([np.ones(len(x)), (x - mean) / dev])
    w = np.zeros(z.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        h = (z * (p * (1 - p))[:, None]).T @ z + ridge * np.eye(len(w))
        w = w - np.linalg.solve(h, z.T @ (p - y) + ridge * w)
    return mean, dev, w


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", path_col: str = "lang", label_col: str = "quality") -> DataFrame:
    """One row per document: doc_id, evidence, host_rate, path_rate, score, accepted."""
    return scored(docs, labels, id_col, text_col, host_col, path_col, label_col).drop("at")


def scored(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, host_col: str, path_col: str, label_col: str) -> DataFrame:
    """``quality_scores`` with the row key ``at``."""
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), row_key(id_col, text_col).alias("at"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.col(host_col).cast("string").alias("host"), F.col(path_col).cast("string").alias("path"))
    base = base.withColumn("words", F.split("text", r"\s+"))
    rows = staged(base.select("doc_id", "at", "host", "path", *features(F.col("text"))), "features")

    marked = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("y")).filter("y in (0, 1) and doc_id is not null")
    # one label per id, and of rows that share an id one, so at most LABELLED rows come together
    some = staged(marked.groupBy("doc_id").agg(F.min("y").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(LABELLED), "quality_labels")
    sample = rows.join(some, "doc_id").groupBy("doc_id").agg(F.min_by(F.struct("y", *FEATURES), "at").alias("x")).select("x.*")
    sample = pd.DataFrame(bounded_rows(sample.orderBy(*FEATURES, "y"), LABELLED), columns=["y", *FEATURES])
    evidence = F.lit(0.0)
    if len(sample) and sample["y"].nunique() > 1:
        mean, dev, w = fit_logistic(sample[FEATURES].to_numpy(float), sample["y"].to_numpy(float))
        rate = float(sample["y"].mean())
        evidence = F.lit(float(w[0] - np.log(rate / (1 - rate))))
        for name, m, d, v in zip(FEATURES, mean, dev, w[1:], strict=True):
            evidence = evidence + (F.col(name) - float(m)) * float(v / d)
        prior = float(np.log(rate / (1 - rate)))
    else:
        prior = 0.0
    logistic = lambda c: 1 / (1 + F.exp(-c))
    rows = rows.select("doc_id", "at", "host", "path", evidence.alias("evidence")).withColumn("p", logistic(F.col("evidence") + prior))

    sums = [F.count(F.lit(1)).cast("double").alias("n"), F.sum("p").alias("s")]
    paths = staged(rows.groupBy("host", "path").agg(*sums), "paths")
    hosts = paths.groupBy("host").agg(F.sum("n").alias("host_n"), F.sum("s").alias("host_s"))

    def strength(groups: DataFrame, n: str, s: str) -> tuple[float, float]:
        """(mean rate, pseudo-count) by the method of moments, weighted by size."""
        r = groups.agg(F.sum(n).alias("n"), F.sum(s).alias("s"), F.sum(F.col(s) * F.col(s) / F.col(n)).alias("q"), F.count(F.lit(1)).alias("k")).first()
        if not r["n"]:
            return 0.5, 1.0
        mu = r["s"] / r["n"]
        within = mu * (1 - mu)
        between = max(0.0, (r["q"] - r["n"] * mu * mu - (r["k"] - 1) * within) / r["n"])
        return mu, min(1e4, max(1.0, within / between - 1)) if between > 1e-12 else 1e4

    mu, of_hosts = strength(hosts, "host_n", "host_s")
    _, of_paths = strength(paths, "n", "s")
    hosts = hosts.select(F.col("host").alias("h"), ((F.col("host_s") + of_hosts * mu) / (F.col("host_n") + of_hosts)).alias("host_rate"))
    sites = staged(paths.join(hosts, F.col("host").eqNullSafe(F.col("h"))).select("h", F.col("path").alias("q"), "n", "s", "host_rate"), "sites")
    # a host of a third of all rows is dealt to SALTS tasks; small site tables are broadcast by Spark's own threshold
    sites = sites.withColumn("t", F.explode(F.array(*(F.lit(i) for i in range(SALTS)))))
    placed = rows.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
    joined = placed.join(sites, F.col("host").eqNullSafe(F.col("h")) & F.col("path").eqNullSafe(F.col("q")) & (F.col("salt") == F.col("t")), "left")
    rest = (F.col("s") - F.col("p") + of_paths * F.col("host_rate")) / (F.col("n") - 1 + of_paths)
    rest = F.least(F.greatest(rest, F.lit(1e-6)), F.lit(1 - 1e-6))
    return joined.select("doc_id", "at", "evidence", "host_rate", rest.alias("path_rate"), logistic(F.col("evidence") + F.log(rest / (1 - rest))).alias("score")).withColumn("accepted", (F.col("score") >= 0.5).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the documents that the classifier rejects, whatever their ids."""
    verdicts = scored(docs, labels, id_col, text_col, "source", "lang", "quality")
    return without(docs, staged(verdicts.filter("accepted = 0").select("doc_id", "at"), "rejected"), id_col, text_col)
