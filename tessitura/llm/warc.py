"""WARC archives with a two-level capture index.

Writing: pages go into gzip members, one per record, in a file per task; a page whose payload equals
that of another becomes a revisit of the one with the largest id. Captures are then sorted by
reversed-host URL key into blocks of lines, each compressed, one index file per range of keys. The
directory has one row per block: its first and last key, file, offset and length.

Reading: a search takes the directory rows whose keys enclose the one sought, reads that block by one
range, finds the lines by binary search and reads each record by another range. A full read walks all
blocks, a task some of them.

Files carry the number of the attempt that wrote them and are listed by the rows of that attempt, so a
task that runs again never changes a file that is listed.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import re
import uuid
import zlib
from bisect import bisect_left
from collections.abc import Iterator
from urllib.parse import quote, urlsplit

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessitura.llm.files import ranged, written
from tessitura.llm.wordhash import slices

BLOCK_LINES = 512
BLOCKS_PER_TASK = 8
DATE = "2024-01-01T00:00:00Z"
CAPTURE = "key string, page_id long, file string, offset long, length long"


def url_key(url: str | None) -> str:
    """The host's labels in reverse, then the path: com,example,www)/a?b. Empty for no URL."""
    if not url:
        return ""
    try:
        parts = urlsplit(url.strip())
        host, port = (parts.hostname or "").lower(), parts.port
    except ValueError:
        return _line(url)
    where = ",".join(reversed(host.split("."))) + (f":{port}" if port else "")
    return _line(f"{where}){parts.path or '/'}" + (f"?{parts.query}" if parts.query else ""))


def _line(text: str) -> str:
    """Without characters that end a line or separate fields."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: quote(m[0]), text)


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str = DATE) -> bytes:
    """One WARC record; a revisit keeps the HTTP head and leaves out the payload."""
    revisit = refers_to is not None
    digest = payload_digest(payload)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_name(page_id, digest)}", f"WARC-Date: {date}"]
    if url:
        head.append(f"WARC-Target-URI: {_line(url)}")
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
                 f"WARC-Refers-To: {_name(refers_to, digest)}", f"X-Refers-To-Page-ID: {refers_to}"]
    head += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _name(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'{page_id}/{digest}')}>"


def parsed(raw: bytes) -> dict:
    """A record's fields, its payload (None for a revisit) checked against its digest."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(line.split(": ", 1) for line in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(dict(line.split(": ", 1) for line in http.decode().split("\r\n")[1:])["Content-Length"])
    kind, digest = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if kind == "response" and (len(payload) != size or payload_digest(payload) != digest):
        raise ValueError("a payload does not have the length and digest its record names")
    number = lambda name: int(fields[name]) if name in fields else None
    return {"page_id": number("X-Page-ID"), "url": fields.get("WARC-Target-URI"), "payload_bytes": size, "payload_digest": digest,
            "record_type": kind, "refers_to": number("X-Refers-To-Page-ID"), "payload": payload if kind == "response" else None}


def write_archives(
    pages: DataFrame, folder: str, html: str = "html", url: str = "url", page_id: str = "page_id", least_bytes: int = 0, date: str = DATE,
) -> DataFrame:
    """Writes all pages into WARC files below `folder`, then their capture index; gives the directory.

    Of pages with equal payloads of at least `least_bytes`, the one with the largest id is a response and
    the others revisit it; smaller payloads are all responses. NULL html is an empty payload, NULL urls
    have an empty key and no target. A page without an id revisits an equal one that has one, else it is a
    response; repeated rows of the largest id are responses each. Other columns are ignored; an empty
    table gives an empty directory.
    """
    spark = pages.sparkSession
    plain = pages.select(
        F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.coalesce(F.col(html).cast("string"), F.lit("")).alias("html")
    ).withColumn("sha", F.sha1(F.encode("html", "UTF-8")))
    equal = plain.where(F.octet_length("html") >= least_bytes).groupBy("sha").agg(F.max("page_id").alias("newest"), F.count("*").alias("n"))
    decided = plain.join(equal.where("n > 1").select("sha", "newest"), "sha", "left")
    large = F.octet_length("html") >= least_bytes
    decided = decided.select("page_id", "url", "html", F.when(large & ~F.col("newest").eqNullSafe(F.col("page_id")), F.col("newest")).alias("newest"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next((b for b in batches if b.num_rows), None)
        if first is None:
            return
        context = TaskContext.get()
        file = f"{folder}/pages-{context.partitionId():06d}-{context.taskAttemptId()}.warc.gz"
        offset = 0
        rows: list[tuple] = []
        with written(file) as out:
            while first is not None:
                columns = [first.column(c).to_pylist() for c in ("page_id", "url", "newest")]
                for part in slices(first.column("html")):
                    for k in range(len(part.bounds) - 1):
                        number, address, newest = (c[part.first + k] for c in columns)
                        payload = part.data[part.bounds[k] : part.bounds[k + 1]].tobytes()
                        member = gzip.compress(record(number, address, payload, newest, date), mtime=0)
                        out.write(member)
                        rows.append((url_key(address), number, file, offset, len(member)))
                        offset += len(member)
                first = next(batches, None)
        for start in range(0, len(rows), 10_000):
            some = list(zip(*rows[start : start + 10_000]))
            kinds = (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(some, kinds)], names=["key", "page_id", "file", "offset", "length"])

    decided.mapInArrow(write, CAPTURE).write.mode("overwrite").parquet(f"{folder}/captures")
    captures = spark.read.parquet(f"{folder}/captures")

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next((b for b in batches if b.num_rows), None)
        if first is None:
            return
        context = TaskContext.get()
        file = f"{folder}/index-{context.partitionId():06d}-{context.taskAttemptId()}.cdx.z"
        out_rows, offset, held = [], 0, []

        def blocks(out, least: int) -> None:
            nonlocal offset, held
            while held and len(held) >= least:
                lines, held = held[:BLOCK_LINES], held[BLOCK_LINES:]
                block = zlib.compress("\n".join(f"{key} {json.dumps(rest)}" for key, *rest in lines).encode())
                out.write(block)
                out_rows.append((lines[0][0], lines[-1][0], file, offset, len(block), len(lines)))
                offset += len(block)

        with written(file) as out:
            while first is not None:
                held += zip(*(first.column(c).to_pylist() for c in ("key", "page_id", "file", "offset", "length")))
                blocks(out, BLOCK_LINES)
                first = next(batches, None)
            blocks(out, 1)
        kinds = (pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int32())
        names = ["first_key", "last_key", "file", "offset", "length", "lines"]
        yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*out_rows), kinds)], names=names)

    ordered = captures.repartitionByRange("key", "page_id").sortWithinPartitions("key", "page_id", "file", "offset")
    directory = "first_key string, last_key string, file string, offset long, length long, lines int"
    ordered.mapInArrow(index, directory).write.mode("overwrite").parquet(f"{folder}/directory")
    return spark.read.parquet(f"{folder}/directory")


def _lines(file: str, offset: int, length: int) -> list[str]:
    with ranged(file) as source:
        return zlib.decompress(source.read_at(length, offset)).decode().split("\n")


def _records(lines: list[str]) -> Iterator[dict]:
    """The records of index lines, each by one range read, file after file."""
    places = sorted((tuple(json.loads(line.split(" ", 1)[1])[1:]) for line in lines))
    source, name, opened = None, None, None
    try:
        for file, offset, length in places:
            if file != name:
                if opened is not None:
                    opened.__exit__(None, None, None)
                opened = ranged(file)
                source, name = opened.__enter__(), file
            yield parsed(gzip.decompress(source.read_at(length, offset)))
    finally:
        if opened is not None:
            opened.__exit__(None, None, None)


def read_archives(spark: SparkSession, folder: str, payloads: bool = False) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to (and url and payload if asked for) of
    every record, found through the capture index."""
    directory = spark.read.parquet(f"{folder}/directory")
    tasks = max(1, directory.count() // BLOCKS_PER_TASK)
    kinds = {"page_id": pa.int64(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "record_type": pa.string(), "refers_to": pa.int64()}
    kinds |= {"url": pa.string(), "payload": pa.binary()} if payloads else {}

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, offset, length in zip(*(batch.column(c).to_pylist() for c in ("file", "offset", "length"))):
                found = list(_records(_lines(file, offset, length)))
                yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in found], t) for n, t in kinds.items()], names=list(kinds))

    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
    return directory.repartition(tasks).mapInArrow(read, f"{schema}, url string, payload binary" if payloads else schema)


def find_captures(spark: SparkSession, folder: str, urls: list[str]) -> dict[str, list[dict]]:
    """The records of a few URLs."""
    out: dict[str, list[dict]] = {}
    directory = spark.read.parquet(f"{folder}/directory")
    for url in urls:
        key = url_key(url)
        lines: list[str] = []
        for row in directory.where((F.col("first_key") <= key) & (F.col("last_key") >= key)).collect():
            block = _lines(row["file"], row["offset"], row["length"])
            at = bisect_left(block, key + " ")
            while at < len(block) and block[at].startswith(key + " "):
                lines.append(block[at])
                at += 1
        out[url] = list(_records(lines))
    return out
