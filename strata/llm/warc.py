"""Conversion of legacy ARC archives to WARC.

Pages are written as ARC archives (version 1 and version 2, by turns), one gzip member per
record, into the shared folder. The converter reads archives with Spark's binary file source,
parses the record lines of the version that an archive declares and the declared lengths, and
writes one WARC archive per ARC archive: record identifiers follow from the page's id, dates
from the archive date, digests from the payload. Records with equal payloads of at least
``least`` bytes become one response, that with the largest id, and revisits; who is the response
is decided over all archives by the tree-merge of exact deduplication, on digests alone, so no
page text is shuffled. Decisions meet their archive by its path.

Archives are rolled at ``ARCHIVE_BYTES``, which bounds what a task holds. They are written under
a hidden name and then renamed, so a task that is run again replaces its files.

Defined cases: null html is an empty payload; null urls become ``urn:page:ID``; white space in
urls is percent-encoded; rows that repeat an id and payload are all responses if that id is the
largest; payloads shorter than ``least`` are all responses; rows with a null
id share one record name and are revisits of an equal payload with an id, else responses; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .archive_io import CRLF, arc_file_header, arc_record, base32, escaped, iso, member, parse_arc, parse_warc, record_id, unpacked, warc_record
from .common import shared_dir, staged
from .exact_dedup import tree_merge

ARCHIVE_BYTES = 16 << 20
RUNS = 64
#: Tasks that convert archives at most.
TASKS = 100_000
#: Fixed archive date of pages, which have none of their own.
DATE = "20240101000000"


def put(uri: str, data: bytes) -> None:
    from pyarrow import fs

    where, path = fs.FileSystem.from_uri(uri)
    folder, name = path.rsplit("/", 1)
    where.create_dir(folder, recursive=True)
    hidden = f"{folder}/_{name}.{uuid.uuid4().hex}"
    with where.open_output_stream(hidden, compression=None) as out:
        out.write(data)
    where.move(hidden, path)


def write_arcs(pages: DataFrame, folder: str) -> DataFrame:
    """Writes ARC archives; returns (path, records) of each."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, k, parts, size, done = TaskContext.get().partitionId(), 0, [], 0, []
        version = 1 + part % 2

        def close():
            nonlocal k, parts, size
            name = f"pages-{part:06d}-{k:04d}.arc.gz"
            put(f"{folder}/{name}", b"".join([member(arc_file_header(name, version, DATE)), *parts]))
            done.append((f"{folder}/{name}", len(parts)))
            k, parts, size = k + 1, [], 0

        for frame in frames:
            for page, url, html in zip(frame["page"], frame["url"], frame["html"], strict=True):
                body = html.encode("utf-8", "surrogatepass")
                block = b"HTTP/1.0 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n" + f"Content-Length: {len(body)}\r\nX-Page-Id: {page}".encode() + 2 * CRLF + body
                parts.append(member(arc_record(version, f"pages-{part:06d}-{k:04d}.arc.gz", size, escaped(url), DATE, block)))
                size += len(block)
                if size >= ARCHIVE_BYTES:
                    close()
        if parts:
            close()
        yield pd.DataFrame(done, columns=["path", "records"])

    page = F.coalesce(F.col("page_id").cast("long").cast("string"), F.lit(""))  # as text, since pandas turns numbers with nulls into floats
    clean = pages.select(page.alias("page"), F.coalesce("url", F.concat(F.lit("urn:page:"), page)).alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    return staged(clean.mapInPandas(run, "path string, records long"), "arcs")


def numbered(page: str) -> int | None:
    return int(page) if page else None


def table(rows: list[tuple], columns: list[str], nullable: list[str]) -> pd.DataFrame:
    """A frame whose integers with nulls stay integers."""
    by = dict(zip(columns, zip(*rows, strict=True) if rows else [[]] * len(columns), strict=True))
    return pd.DataFrame({c: pd.array(list(v), "Int64") if c in nullable else list(v) for c, v in by.items()})


def taken(uri: str) -> bytes:
    from pyarrow import fs

    where, path = fs.FileSystem.from_uri(uri)
    with where.open_input_stream(path, compression=None) as f:
        return f.read()


def archives(spark: SparkSession, folder: str, suffix: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", f"*{suffix}").load(folder).select("path", "content")


def arc_payloads(arcs: DataFrame) -> DataFrame:
    """(path, at, doc_id, run, digest, n_bytes, check) of each record; texts stay where they are."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path, content in zip(frame["path"], frame["content"], strict=True):
                rows = []
                for at, r in enumerate(parse_arc(unpacked(content))):
                    http, _, payload = r.http()
                    rows.append((path, at, numbered(http["x-page-id"]), base32(payload), len(payload), zlib.crc32(payload)))
                yield table(rows, ["path", "at", "doc_id", "digest", "n_bytes", "check"], ["doc_id"])

    rows = arcs.mapInPandas(run, "path string, at int, doc_id long, digest string, n_bytes long, check long")
    return rows.withColumn("run", F.pmod(F.xxhash64("doc_id"), F.lit(RUNS)).cast("int"))


def convert_arcs(spark: SparkSession, folder: str, to: str, least: int = 0) -> DataFrame:
    """Converts all ARC archives of a folder; returns (path, records) of the WARC archives."""
    arcs = archives(spark, folder, ".arc.gz")
    records = staged(arc_payloads(arcs), "records")
    long_enough = records.filter(F.col("n_bytes") >= least)
    best = tree_merge(long_enough.select("doc_id", "run", "digest", "n_bytes", "check", "path", "at"), "largest", RUNS)
    revisits = best.filter("not (doc_id <=> keep_id)").groupBy(F.regexp_extract("path", "[^/]*$", 0).alias("of")).agg(F.collect_list(F.struct("at", "keep_id")).alias("revisits"))  # bounded by an archive's records
    revisits = staged(revisits, "revisits")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            done = []
            for arc, found in zip(frame["arc"], frame["revisits"], strict=True):
                known = {r["at"]: r["keep_id"] for r in found} if found is not None else {}
                name, content = arc.replace(".arc.gz", ".warc.gz"), taken(f"{folder}/{arc}")
                info = f"software: strata\r\nformat: WARC File Format 1.0\r\nisPartOf: {name}\r\n".encode()
                parts = [member(warc_record("warcinfo", [("WARC-Record-ID", record_id(name)), ("WARC-Date", iso(DATE)), ("WARC-Filename", name), ("Content-Type", "application/warc-fields")], info))]
                for at, r in enumerate(parse_arc(unpacked(content))):
                    http, head, payload = r.http()
                    page = http["x-page-id"]
                    block = head + payload if at not in known else head
                    headers = [("WARC-Record-ID", record_id(f"page:{page}")), ("WARC-Date", iso(r.date)), ("WARC-Target-URI", r.url), ("WARC-IP-Address", r.ip), ("WARC-Payload-Digest", "sha1:" + base32(payload)), ("WARC-Block-Digest", "sha1:" + base32(block)), ("Content-Type", "application/http; msgtype=response")]
                    if at in known:
                        headers += [("WARC-Profile", "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"), ("WARC-Refers-To", record_id(f"page:{known[at]}")), ("WARC-Refers-To-Page", str(known[at]))]
                    parts.append(member(warc_record("revisit" if at in known else "response", headers, block)))
                put(f"{to}/{name}", b"".join(parts))
                done.append((f"{to}/{name}", len(parts) - 1))
            yield pd.DataFrame(done, columns=["path", "records"])

    # only names and decisions are joined; a task reads the archives of its names itself
    names = arcs.select(F.regexp_extract("path", "[^/]*$", 0).alias("arc"))
    # names are so small that they would be put together into few tasks, so they are dealt out by number
    joined = names.join(revisits, names["arc"] == revisits["of"], "left").select("arc", "revisits").repartition(max(1, min(names.count(), TASKS)), "arc")
    return staged(joined.mapInPandas(run, "path string, records long"), "warcs")


def read_warcs(spark: SparkSession, folder: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of each page record.

    A response's digests are computed from what was read; one that differs from its header is an error.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for content in frame["content"]:
                rows = []
                for h, block in parse_warc(unpacked(content)):
                    if h["warc-type"] not in ("response", "revisit"):
                        continue
                    head, _, payload = block.partition(2 * CRLF)
                    http = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode("latin-1").split("\r\n")[1:])}
                    digest = h["warc-payload-digest"].removeprefix("sha1:")
                    if h["warc-type"] == "response" and base32(payload) != digest or h["warc-block-digest"] != "sha1:" + base32(block):
                        raise ValueError(f"wrong digest of {h['warc-record-id']}")
                    rows.append((numbered(http["x-page-id"]), int(http["content-length"]), digest, h["warc-type"], int(h["warc-refers-to-page"]) if h["warc-type"] == "revisit" else None))
                yield table(rows, ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"], ["page_id", "refers_to"])

    return archives(spark, folder, ".warc.gz").mapInPandas(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def warc_round_trip(pages: DataFrame, least: int = 0) -> DataFrame:
    """Pages to ARC, ARC to WARC, and the WARC archives read back: one row per page."""
    spark = pages.sparkSession
    folder = f"{shared_dir(spark)}/strata/{uuid.uuid4().hex}"
    if write_arcs(pages, f"{folder}/arc").isEmpty():
        return spark.createDataFrame([], "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")
    convert_arcs(spark, f"{folder}/arc", f"{folder}/warc", least)
    return read_warcs(spark, f"{folder}/warc")
