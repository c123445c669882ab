"""WARC records in ZIP packages: a writer, and a reader that ranges into stored members without extraction.

A package is a ZIP file with two stored members: ``archive/data.warc.gz``, one gzip member for each record, and
``indexes/index.jsonl``, a line for each record with its offset and length in the archive member. The reader takes the
end of the file, follows the ZIP64 locator where there is one, parses the central directory, finds where a stored
member's bytes begin from its local header, and reads the byte range of each record.

Of records with equal payloads of ``least`` bytes or more the one with the smallest page id is the response, others
are revisits that name it and carry no payload. Defined cases: null html is an empty payload; a null page id is never
the response of others and comes back null; of rows that repeat the smallest id those of the least url are responses; an
empty table gives no packages.
"""

from __future__ import annotations

import gzip
import hashlib
import json
import struct
import uuid
import zipfile
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenwatch.llm.common import table
from lumenwatch.session import scratch_path, settle

ARCHIVE, INDEX = "archive/data.warc.gz", "indexes/index.jsonl"
LEAST = 100
#: A package is closed when its records reach this many bytes.
PACKAGE_BYTES = 64 << 20
#: Fixed values of the ZIP format: signatures and the marks of 32-bit and 16-bit fields that ZIP64 replaces.
END, END64, LOCATOR64, ENTRY, LOCAL = b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07", b"PK\x01\x02", b"PK\x03\x04"
FULL32, FULL16 = 0xFFFFFFFF, 0xFFFF


class Member(NamedTuple):
    name: str
    method: int
    packed: int
    size: int
    header: int  # offset of the local header


def _filesystem(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def members(file, length: int) -> list[Member]:
    """The central directory of a ZIP file that can be read at any place."""

    def read(at: int, n: int) -> bytes:
        file.seek(at)
        return file.read(n)

    tail_at = max(0, length - (1 << 16) - 22)
    tail = read(tail_at, length - tail_at)
    at = tail.rfind(END)
    if at < 0:
        raise ValueError("no end of central directory")
    count, size, start = struct.unpack("<HII", tail[at + 10 : at + 20])
    if at >= 20 and tail[at - 20 : at - 16] == LOCATOR64 and (count == FULL16 or FULL32 in (size, start)):
        end64 = read(struct.unpack("<Q", tail[at - 12 : at - 4])[0], 56)
        if end64[:4] != END64:
            raise ValueError("broken ZIP64 locator")
        count, size, start = struct.unpack("<QQQ", end64[32:56])
    entries, found, at = read(start, size), [], 0
    while at < len(entries):
        if entries[at : at + 4] != ENTRY:
            raise ValueError("broken central directory")
        method, packed, whole, name_n, extra_n, comment_n = struct.unpack("<10xH8xIIHHH", entries[at : at + 34])
        header = struct.unpack("<I", entries[at + 42 : at + 46])[0]
        name = entries[at + 46 : at + 46 + name_n].decode()
        extra = entries[at + 46 + name_n : at + 46 + name_n + extra_n]
        while len(extra) >= 4:
            kind, n = struct.unpack("<HH", extra[:4])
            if kind == 1:  # the 64-bit values of those fields that are full, in this order
                wide = list(struct.unpack(f"<{n // 8}Q", extra[4 : 4 + n // 8 * 8]))
                whole = wide.pop(0) if whole == FULL32 else whole
                packed = wide.pop(0) if packed == FULL32 else packed
                header = wide.pop(0) if header == FULL32 else header
            extra = extra[4 + n :]
        found.append(Member(name, method, packed, whole, header))
        at += 46 + name_n + extra_n + comment_n
    if len(found) != count:
        raise ValueError("central directory is cut short")
    return found


def data_start(file, member: Member) -> int:
    """Where a stored member's bytes begin."""
    if member.method != zipfile.ZIP_STORED:
        raise ValueError(f"{member.name} is not stored")
    file.seek(member.header)
    head = file.read(30)
    if head[:4] != LOCAL:
        raise ValueError("broken local header")
    name_n, extra_n = struct.unpack("<HH", head[26:30])
    return member.header + 30 + name_n + extra_n


def record(kind: str, page_id: int | None, url: str, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC record. A revisit has no block; its payload's digest and length are in its header."""
    block = payload if kind == "response" else b""
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id} {url}')}>",
        f"WARC-Target-URI: {url}", "WARC-Date: 2024-01-01T00:00:00Z", f"WARC-Payload-Digest: sha256:{digest}",
        f"X-Page-ID: {'' if page_id is None else page_id}", f"X-Payload-Length: {len(payload)}", "Content-Type: text/html; charset=utf-8",
    ]
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"X-Refers-To-Page-ID: {refers_to}"]
    return "\r\n".join([*head, f"Content-Length: {len(block)}", "", ""]).encode() + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = raw.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError("no WARC record")
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines)
    return fields, rest[: int(fields["Content-Length"])]


class Package:
    """Writes one package to a temporary spool and hands it over whole."""

    def __init__(self, where, path: str, attempt: str):
        self.where, self.path, self.draft = where, path, f"{path}.{attempt}"
        self.out = where.open_output_stream(self.draft)
        self.zip = zipfile.ZipFile(self.out, "w", zipfile.ZIP_STORED, allowZip64=True)
        self.member = self.zip.open(ARCHIVE, "w", force_zip64=True)
        self.size, self.lines = 0, []

    def add(self, raw: bytes) -> None:
        packed = gzip.compress(raw, 5, mtime=0)
        self.member.write(packed)
        self.lines.append((self.size, len(packed)))
        self.size += len(packed)

    def close(self) -> int:
        self.member.close()
        index = "".join(json.dumps({"offset": at, "length": n}) + "\n" for at, n in self.lines)
        with self.zip.open(INDEX, "w", force_zip64=True) as f:
            f.write(index.encode())
        self.zip.close()
        self.out.close()
        self.where.move(self.draft, self.path)
        return len(self.lines)


def _one_line(url: str | None) -> str:
    return " ".join((url or "").split())


def with_originals(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """page_id, url, payload, digest, kind, refers_to. Equal payloads meet only as digests, folded before the shuffle."""
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.coalesce("url", F.lit("")).alias("url"), F.coalesce("html", F.lit("")).alias("html")
    )
    digests = rows.select("page_id", "url", F.sha2("html", 256).alias("digest"), F.octet_length("html").alias("bytes")).where(F.col("bytes") >= least)
    first = digests.where("page_id IS NOT NULL").groupBy("digest").agg(F.min(F.struct("page_id", "url")).alias("first"), F.count("*").alias("copies"))
    first = settle(first.where("copies > 1").select("digest", F.col("first.page_id").alias("original"), F.col("first.url").alias("original_url")), "originals")
    keyed = rows.withColumn("digest", F.sha2("html", 256))
    joined = keyed.join(first, "digest", "left")
    revisit = F.col("original").isNotNull() & ~(F.col("page_id").eqNullSafe(F.col("original")) & (F.col("url") == F.col("original_url")))
    return joined.select("page_id", "url", F.col("html").cast("binary").alias("payload"), "digest", F.when(revisit, F.col("original")).alias("refers_to"))


def write_packages(records: DataFrame, folder: str, package_bytes: int = PACKAGE_BYTES) -> DataFrame:
    """Write the records; one row for each package: path, n_records. A task that runs again writes the same names."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        where, inner = _filesystem(folder)
        where.create_dir(inner, recursive=True)
        part, attempt, number, package = TaskContext.get().partitionId(), uuid.uuid4().hex, 0, None
        done: list[tuple[str, int]] = []
        for batch in batches:
            for page_id, url, payload, digest, refers_to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if package is None:
                    name = f"part-{part:06d}-{number:04d}.zip"
                    package, number = Package(where, f"{inner}/{name}", attempt), number + 1
                package.add(record("response" if refers_to is None else "revisit", page_id, _one_line(url), payload, digest, refers_to))
                if package.size >= package_bytes:
                    done.append((f"{folder}/{name}", package.close()))
                    package = None
        if package:
            done.append((f"{folder}/{name}", package.close()))
        if done:
            yield pa.RecordBatch.from_pydict({"path": [d[0] for d in done], "n_records": [d[1] for d in done]})

    return settle(records.select("page_id", "url", "payload", "digest", "refers_to").mapInArrow(write, "path string, n_records long"), "packages")


def read_packages(packages: DataFrame, with_payload: bool = False) -> DataFrame:
    """One row for each record of the packages, from its own bytes; a response's payload is hashed anew."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                where, inner = _filesystem(path)
                with where.open_input_file(inner) as f:
                    found = {m.name: m for m in members(f, f.size())}
                    start, index = (data_start(f, found[n]) for n in (ARCHIVE, INDEX))
                    f.seek(index)
                    rows: list[tuple] = []
                    for line in f.read(found[INDEX].size).decode().splitlines():
                        place = json.loads(line)
                        f.seek(start + place["offset"])
                        fields, payload = parse_record(gzip.decompress(f.read(place["length"])))
                        response = fields["WARC-Type"] == "response"
                        digest = hashlib.sha256(payload).hexdigest() if response else fields["WARC-Payload-Digest"].removeprefix("sha256:")
                        if response and f"sha256:{digest}" != fields["WARC-Payload-Digest"]:
                            raise ValueError(f"{path}: payload of {fields['WARC-Target-URI']} is damaged")
                        page, refers = fields["X-Page-ID"], fields.get("X-Refers-To-Page-ID")
                        rows.append((
                            int(page) if page else None, fields["WARC-Target-URI"], len(payload) if response else int(fields["X-Payload-Length"]),
                            digest, fields["WARC-Type"], None if refers is None else int(refers), *([payload] * with_payload),
                        ))
                        if len(rows) == 512:
                            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                            rows = []
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    schema = pa.schema([
        ("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
        ("record_type", pa.string()), ("refers_to", pa.int64()), *([("payload", pa.binary())] * with_payload),
    ])
    ddl = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * with_payload
    n = int(packages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return packages.select("path").repartition(n, "path").mapInArrow(read, ddl)


def op9_warc_packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    packages = write_packages(with_originals(table(spark, sf_dir, "pages")), scratch_path(spark, "warc-packages"))
    return read_packages(packages).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT payload_digest, min(page_id) AS first FROM p WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN first < page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first < page_id THEN first END AS refers_to
FROM p LEFT JOIN f USING (payload_digest)
"""

QUERIES = {"op9_warc_packages": op9_warc_packages}
ORACLES = {"op9_warc_packages": ORACLE}
