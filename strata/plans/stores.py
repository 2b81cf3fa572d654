"""Queries of versioned tables and incremental extraction, each beside the SQL that it must equal."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from strata.operators import code as C
from strata.operators import incremental as I
from strata.operators.versions import VersionedStore
from strata.sources.staging import shared_dir

from .catalogue import query, table
from .codebase import WITH, fact


def new_store(spark):
    return VersionedStore(spark, f"{shared_dir(spark)}/strata/{uuid.uuid4().hex}/store")


SNAP = "SELECT kind, item FROM (SELECT 'endpoints' AS kind, method || ' ' || path || ' ' || file AS item, eid AS n FROM endpoints UNION ALL SELECT 'models', name || ' ' || field, mid + k FROM fields UNION ALL SELECT 'modules', id, n_files FROM modules) WHERE n % 5 <> {0}"


@query(f"{WITH}, a AS ({SNAP.format(1)}), b AS ({SNAP.format(2)}) SELECT DISTINCT kind, item, 'added' AS change FROM b WHERE (kind, item) NOT IN (SELECT (kind, item) FROM a) UNION ALL SELECT DISTINCT kind, item, 'removed' FROM a WHERE (kind, item) NOT IN (SELECT (kind, item) FROM b)")
def k1_c8_diff_of_versions(spark, d):
    """Two refreshes of a snapshot table; the versions before and after are read side by side."""
    e, f, m = fact(spark, d, "endpoints"), fact(spark, d, "fields"), fact(spark, d, "modules")
    all_ = e.select(F.lit("endpoints").alias("kind"), F.concat_ws(" ", "method", "path", "file").alias("item"), F.col("eid").alias("n"))
    all_ = all_.unionByName(f.select(F.lit("models").alias("kind"), F.concat_ws(" ", "name", "field").alias("item"), (F.col("mid") + F.col("k")).alias("n"))).unionByName(m.select(F.lit("modules").alias("kind"), F.col("id").alias("item"), F.col("n_files").alias("n")))
    store = new_store(spark)
    before, after = (store.refresh("snapshot", all_.filter(f"n % 5 <> {k}").select("kind", "item")) for k in (1, 2))
    return C.set_diff(store.read("snapshot", before), store.read("snapshot", after))


@query("SELECT CAST(doc_id AS VARCHAR) AS path, w AS word, count(*) AS n FROM (SELECT doc_id, unnest(regexp_split_to_array(CASE WHEN doc_id % 3 = 0 THEN 'edited ' || text ELSE text END, '[ \\t\\n]+')) AS w FROM documents WHERE text IS NOT NULL AND doc_id % 7 <> 0) WHERE w <> '' GROUP BY 1, 2")
def st6_k10_incremental_extraction(spark, d):
    """All documents as files; a second batch changes a third of them and deletes a seventh; it is sent twice."""
    docs = table(spark, d, "documents").filter("text is not null").select(F.col("doc_id").cast("string").alias("path"), F.col("text").alias("content"), "doc_id")
    edited = docs.withColumn("content", F.when(F.col("doc_id") % 7 == 0, F.lit(None)).when(F.col("doc_id") % 3 == 0, F.concat(F.lit("edited "), "content")).otherwise(F.col("content")))
    files = lambda x: x.select("path", "content", F.sha2("content", 256).alias("hash"))
    words = lambda w: w.select("path", F.explode(F.split("content", "[ \\t\\n]+")).alias("word")).filter("word <> ''").groupBy("path", "word").agg(F.count(F.lit(1)).alias("n"))
    store = new_store(spark)
    for number, batch in ((0, docs), (1, edited.filter("doc_id % 7 = 0 or doc_id % 3 = 0 or doc_id % 2 = 0")), (1, edited)):
        I.extract_batch(store, files(batch), words, "words", number)
    return I.live_facts(store).select("path", "word", "n")
