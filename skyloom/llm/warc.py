"""WARC archives of pages, and a reader that salvages what damage left.

A record is a gzip member of its own. Of equal payloads the one with the largest page id is written
in full, the others as revisits of it. The reader checks each record (gzip CRC, version line, length,
end mark, block digest). After a failed check it searches for the next gzip member or version line
that begins a sound record, goes on there, and logs the bytes in between as a gap. Foreign members of
many records are searched inside as well; a gap in one has the member's place in the file.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from skyloom.llm.common import bounded_batches, by_value, stored, table
from skyloom.session import workspace

by_value(__name__)

LEAST_BYTES = 1000  # smaller payloads are always written in full
FILE_BYTES = 16 << 20
ID = "urn:skyloom:page:"
DATE = "1970-01-01T00:00:00Z"  # archives depend on their pages only
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
END = b"\r\n\r\n"
CONTROL = re.compile(r"[\x00-\x20\x7f]")
LENGTH = re.compile(rb"(?im)^content-length:[ \t]*([0-9]+)[ \t]*\r?$")


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One record as a gzip member. A revisit has the HTTP head of the payload it leaves out."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <{ID}{'' if page_id is None else page_id}>",
        f"WARC-Date: {DATE}",
        f"WARC-Block-Digest: sha1:{hashlib.sha1(block).hexdigest()}",
        f"WARC-Payload-Digest: sha1:{digest}",
    ]
    if url is not None:
        quoted = CONTROL.sub(lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), url)
        head.append(f"WARC-Target-URI: {quoted}")
    if refers_to is not None:
        head += [f"WARC-Refers-To: <{ID}{refers_to}>", f"WARC-Profile: {PROFILE}"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress("\r\n".join(head).encode() + END + block + END) + pack.flush()


def parse(data: memoryview, at: int) -> tuple[dict, bytes, int] | None:
    """Headers, block and end of the record at ``at``; None if it isn't sound."""
    if bytes(data[at : at + 6]) != b"WARC/1":
        return None
    size = 4096
    while (stop := bytes(data[at : at + size]).find(END)) < 0:
        if at + size >= len(data):
            return None
        size *= 4
    try:
        lines = bytes(data[at : at + stop]).decode("utf-8").split("\r\n")
        headers = {k.strip().lower(): v.strip() for k, v in (x.split(":", 1) for x in lines[1:])}
        n = int(headers["content-length"])
    except (ValueError, KeyError):
        return None
    start = at + stop + len(END)
    block = bytes(data[start : start + n])
    if n < 0 or len(block) != n or bytes(data[start + n : start + n + 4]) != END:
        return None
    digest = headers.get("warc-block-digest")
    if digest is not None and digest != "sha1:" + hashlib.sha1(block).hexdigest():
        return None
    return headers, block, start + n + len(END)


def member(data: memoryview, at: int) -> tuple[bytes, int] | None:
    """Content and end of the gzip member at ``at``; None if it isn't whole."""
    unpack, out, begin = zlib.decompressobj(31), [], at
    try:
        while not unpack.eof and at < len(data):
            out.append(unpack.decompress(data[at : at + 65536]))
            at = min(at + 65536, len(data))
    except zlib.error:
        return None
    if not unpack.eof or at == begin:
        return None
    return b"".join(out), at - len(unpack.unused_data)


def records_in(content: bytes) -> Iterator[tuple[dict, bytes, int] | None]:
    """The sound records of a gzip member, and None for what lies before, between or behind them."""
    data, at, lost = memoryview(content), 0, False
    while at < len(content):
        if one := parse(data, at):
            yield one
            at, lost = one[2], False
            continue
        if not lost:
            yield None
        lost = True
        at = content.find(b"WARC/1", at + 1)
        if at < 0:
            return


def salvage(content: bytes) -> Iterator[tuple[str, int, int, dict, bytes]]:
    """('record', from, to, headers, block) and ('gap', from, to, {}, b'') over all bytes of an archive.

    All records and gaps of one gzip member have its place.
    """
    data, at, lost = memoryview(content), 0, None
    while at < len(content):
        found, end = [], at
        if content[at : at + 2] == b"\x1f\x8b":
            got = member(data, at)
            if got:
                found = list(records_in(got[0]))
                end = got[1]
                if not any(found):
                    found = []
        elif one := parse(data, at):
            found, end = [one], one[2]
        if found:
            if lost is not None:
                yield "gap", lost, at, {}, b""
                lost = None
            for one in found:
                yield ("record", at, end, *one[:2]) if one else ("gap", at, end, {}, b"")
            at = end
            continue
        lost = at if lost is None else lost
        nexts = [x for x in (content.find(b"\x1f\x8b\x08", at + 1), content.find(b"WARC/1", at + 1)) if x >= 0]
        at = min(nexts, default=len(content))
    if lost is not None:
        yield "gap", lost, len(content), {}, b""


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Write every row as a record; returns ``name, records`` of the archives.

    Null html is an empty payload. A null page id is never referred to; rows that repeat the largest
    page id of their payload are all written in full. Other columns are not looked at.
    """
    bounded_batches(pages.sparkSession)
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select("page_id", "url", payload.alias("payload"), F.sha1(payload).alias("digest"))
    large = F.octet_length("payload") >= LEAST_BYTES
    first = rows.where(large).groupBy(F.col("digest").alias("same")).agg(F.max("page_id").alias("largest"))
    placed = rows.join(first, F.col("digest") == F.col("same"), "left").select(
        "page_id",
        "url",
        "payload",
        "digest",
        F.when(large & ~F.col("page_id").eqNullSafe(F.col("largest")), F.col("largest")).alias("refers_to"),
    )

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        task, part, held, size = TaskContext.get().partitionId(), 0, [], 0

        def flush():
            name = f"pages-{task:06d}-{part:06d}.warc.gz"
            hidden = f"{root}/.tmp-{TaskContext.get().taskAttemptId()}-{name}"
            with store.open_output_stream(hidden, compression=None) as out:
                out.write(b"".join(held))
            store.move(hidden, f"{root}/{name}")
            return pa.RecordBatch.from_pylist(
                [{"name": name, "records": len(held)}], pa.schema([("name", pa.string()), ("records", pa.int64())])
            )

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "payload", "digest", "refers_to"))):
                held.append(record(*row))
                size += len(held[-1])
                if size >= FILE_BYTES:
                    yield flush()
                    part, held, size = part + 1, [], 0
        if held:
            yield flush()

    # sorted, so that a task that runs again writes the same files
    ordered = placed.sortWithinPartitions("page_id", "digest", "url")
    return stored(ordered.mapInArrow(write, "name string, records long"), "archive-list")


def number(name: str | None) -> int | None:
    """The page id in a record id, if it is one of ours."""
    text = (name or "").strip("<>")
    return int(text[len(ID) :]) if re.fullmatch(re.escape(ID) + r"-?[0-9]+", text) else None


def read_archives(spark, folder: str) -> tuple[DataFrame, DataFrame]:
    """(records, gaps) of all archives of a folder: the rows of ``read_rows`` apart."""
    every = read_rows(spark, folder)
    gap = F.col("record_type") == "gap"
    return every.where(~gap), every.where(gap).select("file", "start", "end")


def read_rows(spark, folder: str) -> DataFrame:
    """Records and gaps of all archives of a folder, a gap as a row of that ``record_type``.

    Records: ``page_id, url, payload_bytes, payload_digest, record_type, refers_to, file, start, end,
    payload`` (null for a revisit; its size and digest are those of the payload it refers to). A
    response whose payload does not have its digest is a gap. Gaps: ``file, start, end``.
    """
    bounded_batches(spark)
    content = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(folder).select("path", "content")
    schema = (
        "page_id long, url string, payload_bytes long, payload_digest string, record_type string,"
        " refers_to long, file string, start long, end long, payload binary"
    )
    names = [x.split()[0] for x in schema.split(",")]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]
    kinds += [pa.int64(), pa.int64(), pa.binary()]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

        for batch in batches:
            for path, body in zip(batch.column("path").to_pylist(), batch.column("content")):
                rows, size = [], 0
                for kind, start, end, headers, block in salvage(body.as_buffer().to_pybytes()):
                    rows.append(row(path, kind, start, end, headers, block))
                    size += len(block)
                    if size > FILE_BYTES // 2:
                        yield out(rows)
                        rows, size = [], 0
                if rows:
                    yield out(rows)

    def row(path, kind, start, end, headers, block):
        gap = (None, None, None, None, "gap", None, path, start, end, None)
        if kind == "gap":
            return gap
        head, _, payload = block.partition(END)
        digest = headers.get("warc-payload-digest", "").removeprefix("sha1:")
        revisit = headers.get("warc-type") == "revisit"
        size = LENGTH.search(head + b"\r\n")
        if not revisit and hashlib.sha1(payload).hexdigest() != digest:
            return gap
        return (
            number(headers.get("warc-record-id")),
            headers.get("warc-target-uri"),
            (int(size[1]) if size else None) if revisit else len(payload),
            digest,
            headers.get("warc-type"),
            number(headers.get("warc-refers-to")),
            path,
            start,
            end,
            None if revisit else payload,
        )

    return content.mapInArrow(read, schema)


def op8_warc(spark, sf_dir: str) -> DataFrame:
    folder = workspace(spark, "archives")
    folder = folder if "://" in folder or folder.startswith("file:") else f"file://{folder}"
    write_archives(table(spark, sf_dir, "pages"), folder)
    rows = read_rows(spark, folder)
    # the archives are its own: a gap would be a lost page and must not pass
    lost = F.raise_error(F.concat(F.lit("a record is lost in "), F.col("file"))).cast("string")
    kind = F.when(F.col("record_type") == "gap", lost).otherwise(F.col("record_type"))
    return rows.select("page_id", "payload_bytes", "payload_digest", kind.alias("record_type"), "refers_to")


OP8_SQL = f"""
WITH p AS (SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes,
                  sha1(coalesce(html, '')) AS payload_digest FROM pages),
r AS (SELECT *, CASE WHEN payload_bytes >= {LEAST_BYTES} THEN
                max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) END AS largest FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN largest <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN largest <> page_id THEN largest END AS refers_to
FROM r
"""
