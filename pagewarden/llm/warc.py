"""WARC archives as a chunked record table.

A payload travels as rows of (record, chunk number, bytes), so neither the tasks that
write archives nor those that read them hold a whole record; every chunk row read back
carries the digest of the payload so far, and the last one that of the whole.
Archives are gzip members, one per record, in a folder that all executors share. A task
writes under a name of its own attempt, and only files of attempts that succeeded are
listed and read.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewarden.llm.common import columns_of, run_folder, stored

CHUNK_BYTES = 65_536
END = b"\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def with_roles(pages: DataFrame, *, id_col: str = "page_id", text_col: str = "html", url_col: str = "url", revisit_bytes: int = 1000) -> DataFrame:
    """Payload, size, digest and role of every page. Of equal payloads of at least
    ``revisit_bytes`` the largest id is the response, the others refer to it."""
    html = F.coalesce(F.col(text_col), F.lit(""))
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), html.cast("binary").alias("payload"))
    rows = rows.withColumns({"n": F.octet_length("payload").cast("bigint"), "digest": F.unhex(F.sha1("payload"))})
    same = rows.filter(F.col("n") >= revisit_bytes).groupBy("digest", "n").agg(F.max("page_id").alias("first"), F.count(F.lit(1)).alias("copies")).filter("copies > 1").drop("copies")
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return rows.join(same, ["digest", "n"], "left").select("page_id", "url", "payload", "n", "digest", F.when(revisit, F.col("first")).alias("refers_to"))


def chunk_rows(records: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """A row for each chunk of each payload, in order; revisits and empty payloads have one without bytes."""
    size = F.when(F.col("refers_to").isNull(), F.col("n")).otherwise(F.lit(0))
    last = F.greatest(F.lit(0).cast("bigint"), F.floor((size - 1) / chunk_bytes))
    rows = records.select("page_id", "url", "n", "digest", "refers_to", "payload", last.alias("last_chunk"), F.explode(F.sequence(F.lit(0).cast("bigint"), last)).alias("chunk_no"))
    data = F.when(F.col("refers_to").isNull(), F.substring("payload", (F.col("chunk_no") * chunk_bytes + 1).cast("int"), F.lit(chunk_bytes))).otherwise(F.lit(b""))
    return rows.select("page_id", "url", "n", "digest", "refers_to", "chunk_no", (F.col("chunk_no") == F.col("last_chunk")).alias("is_last"), data.alias("data"))


def record_id(page_id: object, digest: bytes) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page {page_id}' if page_id is not None else digest.hex())}>"


def record_head(page_id: object, url: str | None, n: int, digest: bytes, refers_to: object, date: str) -> bytes:
    """Record head and HTTP head; what follows is the payload, or nothing for a revisit."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n}\r\n\r\n".encode()
    uri = "".join(c if c > " " else "%%%02X" % ord(c) for c in url or "about:blank")
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {record_id(page_id, digest)}", f"WARC-Date: {date}", f"WARC-Target-URI: {uri}"]
    lines += [f"WARC-Payload-Digest: sha1:{base64.b32encode(digest).decode()}", "Content-Type: application/http; msgtype=response"]
    if page_id is not None:
        lines.append(f"X-Page-Id: {page_id}")
    if refers_to is not None:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to, digest)}", f"X-Refers-To-Page: {refers_to}"]
    lines.append(f"Content-Length: {len(http) + (n if refers_to is None else 0)}")
    return "\r\n".join(lines).encode() + END + END + http


def _writer(folder: str, date: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, packer, records, path = None, None, 0, ""
        for batch in batches:
            for page_id, url, n, digest, refers_to, chunk_no, is_last, data in zip(*columns_of(batch, "page_id", "url", "n", "digest", "refers_to", "chunk_no", "is_last", "data"), strict=True):
                if out is None:
                    store, base = fs.FileSystem.from_uri(folder)
                    store.create_dir(base, recursive=True)
                    name = f"part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.gz"
                    path = f"{folder}/{name}"
                    out = store.open_output_stream(f"{base}/{name}", compression=None)
                if chunk_no == 0:
                    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
                    out.write(packer.compress(record_head(page_id, url, n, digest, refers_to, date)))
                out.write(packer.compress(data))
                if is_last:
                    out.write(packer.compress(END + END) + packer.flush())
                    records += 1
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([records], pa.int64())], names=["file", "records"])

    return run


def write_archives(records: DataFrame, folder: str, *, chunk_bytes: int = CHUNK_BYTES, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Write one archive per task that has rows; the stored list of (file, records)."""
    uri = folder if "://" in folder else f"file://{folder.removeprefix('file:')}"
    return stored(chunk_rows(records, chunk_bytes).mapInArrow(_writer(uri, date), "file string, records bigint"), "warc-list")


def _head(stream: gzip.GzipFile) -> dict[str, str] | None:
    """Named fields up to the empty line; None at the end of the file."""
    first = stream.readline()
    if not first:
        return None
    fields = {}
    while (line := stream.readline()) not in (END, b"\n", b""):
        name, _, value = line.decode().partition(":")
        fields[name.strip().lower()] = value.strip()
    return fields


def read_records(stream: gzip.GzipFile, chunk_bytes: int) -> Iterator[tuple]:
    """Chunk rows of one archive: page_id, record_type, refers_to, chunk_no, offset, data,
    digest so far, payload_bytes and the payload's digest as the record states it, is_last."""
    while (head := _head(stream)) is not None:
        start = stream.tell()
        http = _head(stream) or {}
        left = int(head["content-length"]) - (stream.tell() - start)
        page, refers = head.get("x-page-id"), head.get("x-refers-to-page")
        stated = base64.b32decode(head["warc-payload-digest"].partition(":")[2]).hex()
        sha, offset, chunk_no = hashlib.sha1(), 0, 0
        while True:
            data = stream.read(min(chunk_bytes, left))
            if left and not data:
                raise OSError("the archive ends inside a record")
            left -= len(data)
            sha.update(data)
            yield page, head["warc-type"], refers, chunk_no, offset, data, sha.hexdigest(), int(http["content-length"]), stated, left == 0
            offset += len(data)
            chunk_no += 1
            if not left:
                break
        stream.read(4)


FIELDS = [
    ("page_id", pa.string()), ("record_type", pa.string()), ("refers_to", pa.string()), ("chunk_no", pa.int64()), ("offset", pa.int64()),
    ("data", pa.binary()), ("digest_so_far", pa.string()), ("stated_bytes", pa.int64()), ("stated_digest", pa.string()), ("is_last", pa.bool_()),
]


def _reader(chunk_bytes: int, with_data: bool) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fields = [f for f in FIELDS if with_data or f[0] != "data"]
        keep = [i for i, f in enumerate(FIELDS) if f in fields]

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], FIELDS[i][1]) for i in keep], names=[n for n, _ in fields])

        for batch in batches:
            for file in columns_of(batch, "file")[0]:
                store, path = fs.FileSystem.from_uri(file)
                with store.open_input_stream(path, compression=None) as raw, gzip.GzipFile(fileobj=raw) as stream:
                    rows, held = [], 0
                    for row in read_records(stream, chunk_bytes):
                        rows.append(row)
                        held += len(row[5]) if with_data else 1
                        if held >= 16 * chunk_bytes or len(rows) >= 4096:
                            yield batch_of(rows)
                            rows, held = [], 0
                    if rows:
                        yield batch_of(rows)

    return run


def read_archives(files: DataFrame, *, chunk_bytes: int = CHUNK_BYTES, with_data: bool = True) -> DataFrame:
    """The chunk table of the listed archives, a file per partition as far as there are files."""
    n = files.count()
    data = "data binary, " if with_data else ""
    schema = f"page_id string, record_type string, refers_to string, chunk_no bigint, offset bigint, {data}digest_so_far string, stated_bytes bigint, stated_digest string, is_last boolean"
    return files.repartition(max(1, n)).mapInArrow(_reader(chunk_bytes, with_data), schema)


def round_trip(pages: DataFrame, *, id_col: str = "page_id", text_col: str = "html", url_col: str = "url", revisit_bytes: int = 1000, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Write a record per page, read the archives back, one row per record.

    A response's size and digest are those of the bytes read, a revisit's are what its
    record states. Null html is an empty payload, null urls become about:blank; rows that
    repeat the largest id of a payload are responses too; a record without id is a
    revisit where its payload has a response with one. An empty table gives no rows.
    """
    records = with_roles(pages, id_col=id_col, text_col=text_col, url_col=url_col, revisit_bytes=revisit_bytes)
    files = write_archives(records, run_folder(pages.sparkSession, "warc"), chunk_bytes=chunk_bytes)
    rows = read_archives(files, chunk_bytes=chunk_bytes, with_data=False).filter("is_last")
    kind = pages.schema[id_col].dataType
    response = F.col("record_type") == "response"
    return rows.select(
        F.col("page_id").cast(kind).alias("page_id"),
        F.col("stated_bytes").alias("payload_bytes"),
        F.when(response, F.col("digest_so_far")).otherwise(F.col("stated_digest")).alias("payload_digest"),
        "record_type",
        F.col("refers_to").cast(kind).alias("refers_to"),
    )
