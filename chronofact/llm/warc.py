"""WARC archives: a writer that stores equal payloads once, and a reader that salvages what damaged archives still hold."""

from __future__ import annotations

import base64
import contextlib
import hashlib
import re
import uuid
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronofact.session import materialize, shared_dir

GZIP = b"\x1f\x8b\x08"
VERSION = re.compile(rb"WARC/1\.[01]\r?\n")
RECORD = "file string, kind string, start long, end long, reason string, warc_type string, record_id string, refers_to_id string, target_uri string, payload_digest string, payload_bytes long, payload binary"
NAMES = [x.split()[0] for x in RECORD.split(", ")]


def b32sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_bytes(kind: str, record_id: str, url: str | None, payload: bytes | None, size: int, digest: str, refers_to: str | None) -> bytes:
    """One record as a gzip member. A revisit's block is the HTTP header alone; size and digest are the payload's."""
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    if kind == "response":
        block += payload or b""
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <{record_id}>",
        "WARC-Date: 2020-01-01T00:00:00Z",
        *([] if url is None else ["WARC-Target-URI: " + re.sub(r"[\r\n]+", " ", url)]),
        *([] if refers_to is None else [f"WARC-Refers-To: <{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]),
        f"WARC-Payload-Digest: sha1:{digest}",
        f"WARC-Block-Digest: sha1:{b32sha1(block)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    packer = zlib.compressobj(5, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + packer.flush()


class Damaged(Exception):
    pass


def parse(data: bytes, at: int) -> tuple[dict, bytes, int]:
    """Headers, block and end of the record whose version line stands at ``at``; its header ends before the next one."""
    m = VERSION.match(data, at)
    if not m:
        raise Damaged("no version line")
    end = data.find(b"\r\n\r\n", m.end() - 2)
    if end < 0 or VERSION.search(data, m.end(), end):
        raise Damaged("header does not end")
    lines = data[m.end() : end].decode("utf-8", "replace").split("\r\n")
    head = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines if ":" in x)}
    if not head.get("content-length", "").isdigit():
        raise Damaged("no content length")
    start, stop = end + 4, end + 4 + int(head["content-length"])
    if data[stop : stop + 4] != b"\r\n\r\n":
        raise Damaged("block is not as long as stated")
    block = data[start:stop]
    stated = head.get("warc-block-digest", "")
    if stated.startswith("sha1:") and stated[5:] != b32sha1(block):
        raise Damaged("block digest differs")
    return head, block, stop + 4


def one_record(data: bytes, at: int, most: int | None) -> tuple[dict, bytes, int]:
    """The record at ``at``, checked, and where it ends: a gzip member or plain text."""
    if data[at : at + 3] != GZIP:
        return parse(data, at)
    reader, parts, size, end = zlib.decompressobj(31), [], 0, at
    try:
        while not reader.eof:
            if end >= len(data):
                raise Damaged("member is cut short")
            parts.append(reader.decompress(data[end : end + (1 << 16)]))
            size, end = size + len(parts[-1]), end + (1 << 16)
            if most is not None and size > most:
                raise Damaged("member is too long")
    except zlib.error as e:
        raise Damaged(f"member: {e}") from None
    head, block, stop = parse(b"".join(parts), 0)
    if stop != size:
        raise Damaged("member holds more than its record")
    return head, block, min(end, len(data)) - len(reader.unused_data)


def salvage(data: bytes, most: int | None = None) -> Iterator[tuple[str, int, int, str | None, dict, bytes]]:
    """(kind, start, end, reason, headers, block) of each record and each quarantined gap, in order; they tile data.

    After a check fails (CRC, length, digest, header), the bytes from there on are quarantined up to the next gzip
    member or version line that passes every check; reading goes on behind it. A member that unpacks to more than
    ``most`` bytes, where given (for archives of strangers), is damage too.
    """
    at, bad, why = 0, -1, ""
    while at < len(data):
        try:
            head, block, end = one_record(data, at, most)
        except Damaged as e:
            if bad < 0:
                bad, why = at, str(e)
            nexts = [data.find(GZIP, at + 1)]
            m = VERSION.search(data, at + 1)
            nexts.append(m.start() if m else -1)
            at = min((x for x in nexts if x >= 0), default=len(data))
            continue
        if bad >= 0:
            yield "gap", bad, at, why, {}, b""
            bad = -1
        yield "record", at, end, None, head, block
        at = end
    if bad >= 0:
        yield "gap", bad, len(data), why, {}, b""


def payload_of(block: bytes) -> tuple[bytes, int | None]:
    """The HTTP body and the length its header states."""
    head, _, body = block.partition(b"\r\n\r\n")
    m = re.search(rb"(?im)^content-length:\s*(\d+)", head)
    return body, int(m[1]) if m else None


def with_roles(pages: DataFrame, at_least: int = 0, digest: Callable[[Column], Column] = F.sha1) -> DataFrame:
    """Add _sha, _size and _keep (the id of the record that carries the payload; null where nothing is shared).

    Payloads are equal when SHA-256 and size are; ``digest``, the one that records state, has no part in it.
    """
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    hashed = pages.select("page_id", "url", payload.alias("payload")).withColumns(
        {"_sha": digest(F.col("payload")), "_same": F.unhex(F.sha2("payload", 256)), "_size": F.octet_length("payload").cast("long")}
    )
    groups = hashed.where(F.col("_size") >= at_least).groupBy("_same", "_size").agg(F.max("page_id").alias("_keep"))
    groups = materialize(groups, "payloads").withColumnRenamed("_same", "_gsame").withColumnRenamed("_size", "_gsize")
    return hashed.join(groups, (F.col("_same") == F.col("_gsame")) & (F.col("_size") == F.col("_gsize")), "left").drop("_gsame", "_gsize", "_same")


def open_store(folder: str):
    """The store of a folder and the folder's path in it, as a task opens it: Spark's names of a scheme that the client knows
    by another are told to it by that; its credentials are those of the worker's own surroundings."""
    from pyarrow import fs

    scheme, colon, rest = folder.partition("://")
    return fs.FileSystem.from_uri({"s3a": "s3", "s3n": "s3"}.get(scheme.lower(), scheme) + colon + rest)


def write_archives(pages: DataFrame, folder: str, at_least: int = 0, roll_bytes: int = 64 << 20, store_of: Callable = open_store) -> DataFrame:
    """Write a record for each row of (page_id, url, html) into archives under ``folder``; returns their manifest.

    Of records with equal payloads of at least ``at_least`` bytes, the one with the largest page_id is a response and
    the others are revisits of it; rows that share that largest id are all responses. A task writes its own archives,
    a new one every ``roll_bytes``, under a name no other attempt uses, and renames each when it is whole; the
    manifest lists the attempts that counted. A task that fails takes its files away; those of a lost executor stay, and are not
    in the manifest. ``store_of`` opens the folder in a task, for stores that need more than their address. Null html is an empty payload, null urls have no target line, null ids
    read "null". Other columns are ignored; empty tables give no archives.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = store_of(folder)
        store.create_dir(root, recursive=True)
        part, number = TaskContext.get().partitionId(), 0
        out, held, size, records, done = None, "", 0, 0, []

        def close() -> None:
            nonlocal out, number
            if out is not None:
                out.close()
                final = f"{root}/part-{part:05d}-{number:04d}-{uuid.uuid4().hex[:12]}.warc.gz"
                store.move(held, final)
                done.append((final, records, size))
                out, number = None, number + 1

        name = lambda x: "urn:page:null" if x is None else f"urn:page:{x}"
        try:
            for page, url, payload, sha, length, keep in (tuple(x.as_py() for x in row) for b in batches for row in zip(*b.columns, strict=True)):
                if out is None:
                    held, size, records = f"{root}/.open-{uuid.uuid4().hex}", 0, 0
                    out = store.open_output_stream(held)
                revisit = keep is not None and keep != page
                digest = base64.b32encode(bytes.fromhex(sha)).decode()
                data = record_bytes("revisit" if revisit else "response", name(page), url, payload, length, digest, name(keep) if revisit else None)
                out.write(data)
                size, records = size + len(data), records + 1
                if size >= roll_bytes:
                    close()
            close()
        except BaseException:
            if out is not None:
                out.close()
                done.append((held, 0, 0))
            for file, _, _ in done:
                with contextlib.suppress(OSError):
                    store.delete_file(file)
            raise
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done, strict=True)], ["file", "records", "bytes"])

    rows = with_roles(pages, at_least).select("page_id", "url", "payload", "_sha", "_size", "_keep")
    return materialize(rows.mapInArrow(task, "file string, records long, bytes long"), "manifest")


def read_archives(files: DataFrame, most: int | None = None) -> DataFrame:
    """Records and gaps of archives given as (path, content), as Spark's binaryFile source reads them.

    Columns: file, kind (record or gap), start and end in the file, reason of a gap, and of a record warc_type,
    record_id, refers_to_id, target_uri, payload_digest, payload_bytes, payload. For a response they are measured on
    the payload read; for a revisit they are those its header states. An empty or wholly damaged file gives no
    record, and the latter one gap. Where files has a column records, as ``archives`` with counted gives it, reading
    fails for a file that does not hold so many.
    """
    counted = "records" in files.columns
    strip = lambda x: None if x is None else x.strip("<>")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                file, rows, held, read = b.column(0)[i].as_py(), [], 0, 0
                for kind, start, end, why, head, block in salvage(b.column(1)[i].as_py() or b"", most):
                    row = [file, kind, start, end, why]
                    if kind == "record":
                        read += 1
                        body, stated = payload_of(block)
                        revisit = head.get("warc-type") == "revisit"
                        digest = head.get("warc-payload-digest", "").removeprefix("sha1:") if revisit else b32sha1(body)
                        row += [head.get("warc-type"), strip(head.get("warc-record-id")), strip(head.get("warc-refers-to")), head.get("warc-target-uri"), digest, stated if revisit else len(body), None if revisit else body]
                        held += len(body)
                    rows.append(row + [None] * (len(NAMES) - len(row)))
                    if held > 8 << 20 or len(rows) >= 5000:
                        yield batch(rows)
                        rows, held = [], 0
                if rows:
                    yield batch(rows)
                if counted and read != b.column(2)[i].as_py():
                    raise ValueError(f"{file}: {read} records read, {b.column(2)[i].as_py()} written")

    def batch(rows: list[list]) -> pa.RecordBatch:
        kinds = {"long": pa.int64(), "binary": pa.binary(), "string": pa.string()}
        types = [kinds[x.split()[1]] for x in RECORD.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], NAMES)

    return files.select("path", "content", *(["records"] if counted else [])).mapInArrow(task, RECORD)


def archives(manifest: DataFrame, folder: str, counted: bool = False) -> DataFrame:
    """(path, content) of the archives that the manifest lists; what failed attempts left in the folder is not read.

    ``counted`` adds records, the number written to each, and fails where a listed archive is not in the folder.
    """
    if manifest.isEmpty():
        return manifest.sparkSession.createDataFrame([], "path string, content binary, records long").drop(*([] if counted else ["records"]))
    found = manifest.sparkSession.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").schema("path string, modificationTime timestamp, length long, content binary").load(folder)
    name = lambda c: F.element_at(F.split(c, "/"), -1)
    listed = manifest.select(name("file").alias("_name"), "records")
    if not counted:
        return found.select("path", "content").join(listed, name("path") == F.col("_name"), "left_semi")
    there, asked = found.select("path").join(listed, name("path") == F.col("_name"), "left_semi").count(), manifest.count()
    if there != asked:
        raise FileNotFoundError(f"{folder}: {there} of {asked} archives")
    return found.select("path", "content").join(listed, name("path") == F.col("_name")).select("path", "content", "records")


def op3_warc(spark, sf_dir: str) -> DataFrame:
    """Writes all pages, then reads the archives back; page ids come from the record ids that were read."""
    folder = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    files = archives(write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), folder), folder, counted=True)
    number = lambda c: F.expr(f"try_cast(substring({c}, length('urn:page:') + 1) AS bigint)")
    return read_archives(files).where("kind = 'record'").select(
        number("record_id").alias("page_id"), "payload_bytes", "payload_digest", F.col("warc_type").alias("record_type"), number("refers_to_id").alias("refers_to")
    )


SQL = {
    "op3_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
h AS (SELECT page_id, body, CAST(octet_length(encode(body)) AS BIGINT) AS payload_bytes, sha1(body) AS hex, max(page_id) OVER (PARTITION BY body) AS keep FROM p)
SELECT page_id, payload_bytes,
  list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + CAST(CAST(('0x' || substr(hex, CAST(1 + 5 * (i // 4) AS INT), 5)) AS BIGINT) // CAST(power(32, 3 - i % 4) AS BIGINT) % 32 AS INT), 1)), 'string_agg', '') AS payload_digest,
  CASE WHEN page_id = keep THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = keep THEN NULL ELSE keep END AS refers_to
FROM h
""",
}
QUERIES = {"op3_warc": op3_warc}
