"""WARC archives with revisit records.

Headers (page id and payload digest) are grouped by digest; of equal payloads of at least ``MIN_REVISIT`` bytes the largest page
id stays a response, and the others become revisit records that name it. Bodies stay where they lie unless their digest may be shared
(a bit map of the shared digests); of those, only bodies that may be the original's (a second bit map) travel to the join with the
originals, and a digest that many pages share is answered by a broadcast of few rows. Every record is written with fresh headers as a gzip member
of its own; tasks write their own archives of at most about ``roll_bytes`` each to a folder that driver and executors share, and only
archives in the committed manifest are read, so a lost or repeated attempt leaves nothing behind in the results.

A null html is an empty payload, a null url leaves the target out. Rows that repeat the largest page id are all responses; a null page
id never is the one referred to, and stays a response where no equal payload has an id.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from datetime import datetime, timezone
from typing import BinaryIO

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from hearthline.llm.common import marked, staged, thinned
from hearthline.operators.skew import attach_by_key
from hearthline.session import scratch_path

MIN_REVISIT = 1000
MOST_TASKS = 20_000
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: upper half of the record ids; the lower half is the page id
SPACE = uuid.uuid5(uuid.NAMESPACE_URL, "urn:page").int >> 64 << 64


def resolve(pages: DataFrame, min_bytes: int = MIN_REVISIT) -> DataFrame:
    """page_id, url, html, payload_bytes, payload_digest, refers_to (null: response) of every row; html may be null for a revisit."""
    body = F.coalesce(F.col("html").cast("string"), F.lit(""))
    own = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.col("url").cast("string").alias("url"),
        body.alias("html"),
        F.octet_length(body).cast("long").alias("payload_bytes"),
        F.sha1(body.cast("binary")).alias("payload_digest"),
    )
    heads = own.where(F.col("payload_bytes") >= min_bytes).groupBy("payload_digest").agg(F.max("page_id").alias("keeper"), F.count("*").alias("n"))
    heads = staged(heads.withColumn("__digest", F.xxhash64("payload_digest")), "heads")
    shared = heads.where("n > 1").select("__digest")
    # every digest that the map of shared ones lets through, also the few that it lets through by chance: their pages are their own originals
    originals = staged(thinned(heads, shared, "__digest"), "originals").drop("__digest")
    keepers = originals.select(F.xxhash64("payload_digest", "keeper").alias("__page"))
    seen = marked(own.withColumn("__digest", F.xxhash64("payload_digest")), shared, "__digest", "__shared")
    seen = seen.withColumn("__shared", F.col("__shared") & (F.col("payload_bytes") >= min_bytes))
    alone = seen.where("NOT __shared").select(*own.columns, F.lit(None).cast("long").alias("refers_to"))
    met = marked(seen.where("__shared").withColumn("__page", F.xxhash64("payload_digest", "page_id")), keepers, "__page", "__original")
    met = met.select(*[F.when(F.col("__original"), F.col(c)).alias(c) if c == "html" else F.col(c) for c in own.columns])
    named = attach_by_key(met, originals, ["payload_digest"], "n")
    other = F.when(~F.col("page_id").eqNullSafe(F.col("keeper")), F.col("keeper"))
    return alone.unionByName(named.select(*own.columns, other.alias("refers_to")))


def record_id(page_id: int | None) -> str:
    number = uuid.uuid4() if page_id is None else uuid.UUID(int=SPACE | (page_id & ((1 << 64) - 1)))
    return f"<urn:uuid:{number}>"


def page_of(urn: str) -> int:
    low = uuid.UUID(urn.strip("<>").removeprefix("urn:uuid:")).int & ((1 << 64) - 1)
    return low - (1 << 64) if low >> 63 else low


def record(row: dict, date: str) -> bytes:
    """One record: a response with its payload, or a revisit with the HTTP header alone."""
    revisit = row["refers_to"] is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: {row['payload_bytes']}\r\n\r\n".encode()
    block = http if revisit else http + row["html"].encode()
    head = {
        "WARC-Type": "revisit" if revisit else "response",
        "WARC-Record-ID": record_id(row["page_id"]),
        "WARC-Date": date,
        "WARC-Target-URI": "".join(c if c.isprintable() and c != " " else "".join(f"%{b:02X}" for b in c.encode()) for c in row["url"] or "") or None,
        "WARC-Payload-Digest": "sha1:" + base64.b32encode(bytes.fromhex(row["payload_digest"])).decode(),
        "WARC-Profile": PROFILE if revisit else None,
        "WARC-Refers-To": record_id(row["refers_to"]) if revisit else None,
        "X-Page-Id": None if row["page_id"] is None else str(row["page_id"]),
        "Content-Type": "application/http; msgtype=response",
        "Content-Length": str(len(block)),
    }
    lines = "".join(f"{k}: {v}\r\n" for k, v in head.items() if v is not None)
    return f"WARC/1.1\r\n{lines}\r\n".encode() + block + b"\r\n\r\n"


def write_archives(resolved: DataFrame, folder: str, date: str | None = None, roll_bytes: int = 128 << 20) -> DataFrame:
    """Write archives; the manifest (path, records). Runs a job."""
    stamp = date or datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, at = pafs.FileSystem.from_uri(folder)
        attempt, number, out, written, records = TaskContext.get().taskAttemptId(), 0, None, 0, 0

        def closed() -> pa.RecordBatch:
            out.close()
            return pa.RecordBatch.from_arrays([pa.array([f"part-{attempt}-{number}.warc.gz"]), pa.array([records])], names=["name", "records"])

        for batch in batches:
            for row in range(batch.num_rows):
                if out is None:
                    files.create_dir(at, recursive=True)
                    out, written, records = files.open_output_stream(f"{at}/part-{attempt}-{number}.warc.gz", compression=None), 0, 0
                member = gzip.compress(record({c: batch[c][row].as_py() for c in batch.schema.names}, stamp), 1)
                out.write(member)
                written, records = written + len(member), records + 1
                if written >= roll_bytes:
                    yield closed()
                    out, number = None, number + 1
        if out is not None:
            yield closed()

    return staged(resolved.mapInArrow(run, "name string, records long"), "archives")


class Members:
    """Bytes of a file of gzip members, read piece by piece."""

    def __init__(self, raw: BinaryIO, piece: int = 1 << 20):
        self.raw, self.piece, self.inflate, self.ready, self.rest = raw, piece, zlib.decompressobj(31), bytearray(), b""

    def more(self) -> bool:
        data = self.rest or self.raw.read(self.piece)
        if not data:
            return False
        if self.inflate.eof:
            self.inflate = zlib.decompressobj(31)
        self.ready += self.inflate.decompress(data)
        self.rest = self.inflate.unused_data
        return True

    def until(self, mark: bytes) -> bytes | None:
        """Everything before a mark, which is taken as well; None at the end of the file."""
        seen = 0
        while (at := self.ready.find(mark, seen)) < 0:
            seen = max(0, len(self.ready) - len(mark))
            if not self.more():
                if self.ready:
                    raise ValueError("the archive ends inside a record")
                return None
        out = bytes(self.ready[:at])
        del self.ready[: at + len(mark)]
        return out

    def take(self, n: int) -> bytes:
        while len(self.ready) < n:
            if not self.more():
                raise ValueError("the archive ends inside a record")
        out = bytes(self.ready[:n])
        del self.ready[:n]
        return out


def fields(head: bytes) -> dict[str, str]:
    pairs = (line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    return {k.lower(): v for k, v in pairs}


def records(raw: BinaryIO) -> Iterator[dict]:
    """Records of an archive; digests of payloads are taken again and must agree with the header."""
    source = Members(raw)
    while (head := source.until(b"\r\n\r\n")) is not None:
        warc = fields(head)
        http, _, payload = source.take(int(warc["content-length"])).partition(b"\r\n\r\n")
        source.take(4)
        named = base64.b32decode(warc["warc-payload-digest"].removeprefix("sha1:")).hex()
        kind = warc["warc-type"]
        size = int(fields(http)["content-length"])
        if kind == "response" and (hashlib.sha1(payload).hexdigest() != named or len(payload) != size):
            raise ValueError(f"payload of {warc['warc-record-id']} does not match its header")
        yield {
            "page_id": int(warc["x-page-id"]) if "x-page-id" in warc else None,
            "url": warc.get("warc-target-uri"),
            "payload_bytes": size,
            "payload_digest": named,
            "record_type": kind,
            "refers_to": page_of(warc["warc-refers-to"]) if kind == "revisit" else None,
            "html": payload.decode() if kind == "response" else None,
        }


READ = {"page_id": "long", "url": "string", "payload_bytes": "long", "payload_digest": "string", "record_type": "string", "refers_to": "long", "html": "string"}
ARROW = {"long": pa.int64(), "string": pa.string()}


def read_archives(manifest: DataFrame, folder: str, columns: tuple[str, ...] = tuple(READ), batch_bytes: int = 8 << 20) -> DataFrame:
    """Records of the archives in a manifest, one task per archive; only the asked columns leave Python."""
    schema = pa.schema([(c, ARROW[READ[c]]) for c in columns])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, at = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            for name in batch["name"].to_pylist():
                with files.open_input_stream(f"{at}/{name}", compression=None) as raw:
                    rows, size = [], 0
                    for r in records(raw):
                        rows.append({c: r[c] for c in columns})
                        size += 200 + (len(r["html"] or "") if "html" in columns else 0)
                        if size >= batch_bytes:
                            yield pa.RecordBatch.from_pylist(rows, schema=schema)
                            rows, size = [], 0
                    if rows:
                        yield pa.RecordBatch.from_pylist(rows, schema=schema)

    # a list this short would be coalesced to one task; a number given here is kept
    tasks = max(1, min(manifest.count(), MOST_TASKS))
    return manifest.select("name").repartition(tasks).mapInArrow(run, ", ".join(f"{c} {READ[c]}" for c in columns))


def archive_pages(spark: SparkSession, pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Write archives of all pages and return what is read back: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    folder = folder or scratch_path(spark, "warc")
    manifest = write_archives(resolve(pages), folder)
    return read_archives(manifest, folder, ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"))


SQL = """
WITH p AS (SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
k AS (SELECT payload_digest, max(page_id) AS keeper FROM p WHERE payload_bytes >= 1000 GROUP BY 1 HAVING count(*) > 1)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN keeper IS NULL OR keeper = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN keeper <> page_id THEN keeper END AS refers_to
FROM p LEFT JOIN k USING (payload_digest)
"""
