"""Reading and writing ARC and WARC records as bytes."""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

# The field lists of ARC version 1 and version 2 record lines.
FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
SPACE = uuid.UUID("6f4f2b6e-1c9a-5d0e-9b57-0d6c4a1d7a10")
CRLF = b"\r\n"


@dataclass
class ArcRecord:
    url: str
    ip: str
    date: str
    kind: str
    status: str | None
    block: bytes

    def http(self) -> tuple[dict[str, str], bytes, bytes]:
        """(headers by lower-case name, header bytes, payload); no headers if it isn't HTTP."""
        if not self.block.startswith(b"HTTP/"):
            return {}, b"", self.block
        head, _, payload = self.block.partition(2 * CRLF)
        lines = head.decode("latin-1").split("\r\n")[1:]
        return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}, head + 2 * CRLF, payload


def member(data: bytes) -> bytes:
    """One gzip member; records stay readable one by one, and equal input gives equal bytes."""
    z = zlib.compressobj(1, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def escaped(url: str) -> str:
    """White space would end the field of a record line."""
    return "".join(c if c > " " and c not in "\x7f\x85\xa0" else "".join(f"%{b:02X}" for b in c.encode()) for c in url)


def arc_file_header(name: str, version: int, date: str) -> bytes:
    body = f"{version} 0 strata\n{FIELDS[version]}\n\n".encode()
    extra = "" if version == 1 else " 200 - - 0 " + name
    return f"filedesc://{name} 0.0.0.0 {date} text/plain{extra} {len(body)}\n".encode() + body + b"\n"


def arc_record(version: int, name: str, offset: int, url: str, date: str, block: bytes) -> bytes:
    extra = "" if version == 1 else f" 200 {hashlib.md5(block).hexdigest()} - {offset} {name}"
    return f"{url} 0.0.0.0 {date} text/html{extra} {len(block)}\n".encode() + block + b"\n"


def parse_arc(data: bytes) -> Iterator[ArcRecord]:
    """Records behind the version block; its lines tell the version and the field names.

    A record's length is the declared one; blank lines between records are skipped; a line whose
    number of fields doesn't fit the version, or a cut-off block, raises ValueError.
    """
    at, fields = 0, None
    while at < len(data):
        end = data.find(b"\n", at)
        line = data[at : end if end >= 0 else len(data)].rstrip(b"\r")
        at = (end if end >= 0 else len(data)) + 1
        if not line:
            continue
        values = line.decode("utf-8", "replace").split(" ")
        size = int(values[-1])
        block = data[at : at + size]
        if len(block) < size:
            raise ValueError(f"a block of {size} bytes is cut off")
        at += size
        if fields is None:
            said = block.decode("utf-8", "replace").split("\n")
            version = int(said[0].split(" ")[0])
            if version not in FIELDS:
                raise ValueError(f"unknown ARC version {version}")
            fields = (said[1].strip() or FIELDS[version]).split(" ")
        else:
            if len(values) != len(fields):
                raise ValueError(f"{len(values)} fields, {len(fields)} declared")
            x = dict(zip(fields, values, strict=True))
            yield ArcRecord(x["URL"], x["IP-address"], x["Archive-date"], x["Content-type"], x.get("Result-code"), block)


def iso(date: str) -> str:
    """YYYYMMDDhhmmss (shorter ones filled up) as YYYY-MM-DDThh:mm:ssZ."""
    d = (date + "00000101000000"[len(date) :])[:14]
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:]}Z"


def record_id(name: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(SPACE, name)}>"


def warc_record(kind: str, headers: list[tuple[str, str]], block: bytes) -> bytes:
    lines = [b"WARC/1.0", *(f"{k}: {v}".encode() for k, v in [("WARC-Type", kind), *headers, ("Content-Length", str(len(block)))])]
    return CRLF.join(lines) + 2 * CRLF + block + 2 * CRLF


def parse_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers by lower-case name, block) of each record."""
    at = 0
    while at < len(data):
        end = data.find(2 * CRLF, at)
        if end < 0 or not data.startswith(b"WARC/", at):
            raise ValueError(f"no WARC record at {at}")
        lines = data[at:end].decode().split("\r\n")[1:]
        h = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        at = end + 4 + int(h["content-length"])
        yield h, data[end + 4 : at]
        at += 4


def unpacked(data: bytes) -> bytes:
    """The members of a gzip file in one; read as a stream, as gzip.decompress copies the rest for each member."""
    return gzip.GzipFile(fileobj=io.BytesIO(data)).read() if data[:2] == b"\x1f\x8b" else data
