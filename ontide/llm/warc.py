"""WARC archives: written as whole-file gzip streams, normalised to a gzip member per record, read by offset.

`write_archives` writes a record per page: a response with the page's HTML as HTTP payload, or a
revisit where another page with the same payload comes first. Each file is one gzip
stream, which can only be read from its start. `normalise_archives` inflates every such stream once,
in pieces, rewrites each record as its own gzip member and writes a sidecar of offsets.
`read_archives` seeks to the records of the sidecars, inflates and parses them.

Files go to a folder that all executors share, through pyarrow's file systems, so local, HDFS and
object-store addresses work. A task writes under a name of its own attempt and renames it at the
end, so a lost executor's work is simply done again.

Null HTML is an empty payload; a null url leaves the header out. Pages of the same payload with the
same smallest id are all responses. A null page_id never becomes a response that others revisit
while another id has the payload; where all ids are null, all are responses. Empty tables give no
files and no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import uuid
import zlib
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from ontide.llm.common import map_rows, raw
from ontide.session import shared_dir, stage

# The parts of the formats.
VERSION = b"WARC/1.1\r\n"
END = b"\r\n\r\n"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
GZIP = 31
LEAST_PAYLOAD = 100
READ_BYTES = 1 << 20


@dataclass(frozen=True)
class WarcParams:
    file_bytes: int = 256 << 20  # of record bytes in an archive, before compression
    level: int = 4
    date: str = "2024-01-01T00:00:00Z"


def file_system(address: str) -> tuple[arrow_fs.FileSystem, str]:
    """File system and path of an address with or without a scheme."""
    if "://" not in address and address.startswith("file:"):
        address = "file://" + address[5:]
    return arrow_fs.FileSystem.from_uri(address)


def record_id(page_id: int | None, number: int, url: str | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{number}:{url}')}>"


def record_bytes(page_id, url, payload: bytes, digest: str, refers_to, number: int, date: str) -> bytes:
    """A whole record, with the two line ends that close it."""
    headers = {
        "WARC-Type": "response" if refers_to is None else "revisit",
        "WARC-Record-ID": record_id(page_id, number, url),
        "WARC-Date": date,
        "Content-Type": "application/http; msgtype=response",
        "WARC-Payload-Digest": f"sha256:{digest}",
        "Page-Payload-Length": str(len(payload)),
    }
    if url is not None:
        headers["WARC-Target-URI"] = quote(url, safe=":/?#[]@!$&'()*+,;=%~")
    if page_id is not None:
        headers["Page-Id"] = str(page_id)
    http = (HTTP % len(payload)).encode()
    if refers_to is None:
        block = http + payload
    else:
        headers |= {"WARC-Profile": REVISIT_PROFILE, "Page-Refers-To": str(refers_to)}
        block = http
    headers["Content-Length"] = str(len(block))
    lines = "".join(f"{name}: {value}\r\n" for name, value in headers.items())
    return VERSION + lines.encode() + b"\r\n" + block + END


def lines_of(stream):
    rest = b""
    while data := stream.read(READ_BYTES):
        *whole, rest = (rest + data).split(b"\n")
        yield from whole
    if rest:
        yield rest


def parse_head(data: bytes) -> dict[str, str]:
    """Headers of a record, names in lower case."""
    lines = data.decode("utf-8").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
    pairs = (line.split(":", 1) for line in lines[1:] if line)
    return {name.strip().lower(): value.strip() for name, value in pairs}


def inflated(stream):
    """Pieces of a whole-file gzip stream, further members included."""
    engine = zlib.decompressobj(GZIP)
    while data := stream.read(READ_BYTES):
        while data:
            yield engine.decompress(data, READ_BYTES)
            while engine.unconsumed_tail:
                yield engine.decompress(engine.unconsumed_tail, READ_BYTES)
            data = engine.unused_data
            if engine.eof:
                engine = zlib.decompressobj(GZIP)
            else:
                break


def records(pieces):
    """Whole records of a stream of bytes, in order; holds one record and one piece at a time."""
    held = bytearray()
    for piece in pieces:
        held += piece
        while (head_end := held.find(END)) >= 0:
            length = int(parse_head(bytes(held[:head_end]))["content-length"])
            stop = head_end + len(END) + length + len(END)
            if len(held) < stop:
                break
            yield bytes(held[:stop])
            del held[:stop]
    if held.strip():
        raise ValueError("the archive ends inside a record")


class Output:
    """A file under the name of this attempt, renamed when it is complete."""

    def __init__(self, system, path: str):
        context = TaskContext.get()
        self.system, self.path = system, path
        self.own = f"{path}.{context.taskAttemptId() if context else 0}.part"
        self.stream, self.at = system.open_output_stream(self.own), 0

    def write(self, data: bytes) -> None:
        self.stream.write(data)
        self.at += len(data)

    def close(self) -> None:
        self.stream.close()
        self.system.move(self.own, self.path)


def with_first_pages(pages: DataFrame) -> DataFrame:
    """(page_id, url, html, digest, refers_to). Only digests and ids are grouped; the HTML moves in
    the join alone, and a payload that many pages share is split there by adaptive execution."""
    html = F.coalesce(pages["html"], F.lit(""))
    rows = pages.select(
        pages["page_id"].cast("bigint").alias("page_id"),
        pages["url"].alias("url"),
        html.alias("html"),
        F.sha2(html.cast("binary"), 256).alias("digest"),
        F.octet_length(html).alias("size"),
    )
    firsts = (
        rows.filter(F.col("size") >= LEAST_PAYLOAD)
        .groupBy("digest")
        .agg(F.min("page_id").alias("first_id"), F.count("*").alias("n"))
        .filter("n > 1")
        .select("digest", "first_id")
    )
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("first_id")), F.col("first_id"))
    return rows.join(firsts, "digest", "left").select(
        "page_id", "url", "html", "digest", refers.alias("refers_to")
    )


def write_archives(pages: DataFrame, folder: str, params: WarcParams = WarcParams()) -> DataFrame:
    """Write the pages to archives in `folder`; one row per file: path, records."""
    folder = folder.rstrip("/")

    def process(batches):
        system, base = file_system(folder)
        system.create_dir(base, recursive=True)
        task, number = TaskContext.get().partitionId(), 0
        out = engine = None
        size = count = 0
        done = []

        def finish():
            out.write(engine.flush())
            out.close()
            done.append((out.path, count))

        for batch in batches:
            ids, urls = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            digests, refers = batch.column(3).to_pylist(), batch.column(4).to_pylist()
            for i, payload in enumerate(raw(batch.column(2))):
                if out is None:
                    out = Output(system, f"{base}/pages-{task:06d}-{number:04d}.warc.gz")
                    engine, size, count = zlib.compressobj(params.level, zlib.DEFLATED, GZIP), 0, 0
                    number += 1
                data = record_bytes(
                    ids[i], urls[i], payload, digests[i], refers[i], count, params.date
                )
                out.write(engine.compress(data))
                size, count = size + len(data), count + 1
                if size >= params.file_bytes:
                    finish()
                    out = None
        if out is not None:
            finish()
        if done:
            yield pa.RecordBatch.from_pydict({"path": [d[0] for d in done], "records": [d[1] for d in done]})

    return with_first_pages(pages).mapInArrow(process, "path string, records bigint")


def normalise_archives(
    files: DataFrame, source: str, target: str, params: WarcParams = WarcParams()
) -> DataFrame:
    """Rewrite archives (column path) record by record; one row per file: path, index, records.

    Each file is a task of its own. The index is a line of JSON per record: offset, length,
    type and id.
    """
    target, n = target.rstrip("/"), max(1, files.count())

    def process():
        system, _ = file_system(source)
        out_system, base = file_system(target)
        out_system.create_dir(base, recursive=True)

        def rows(batch):
            for path in batch.column(0).to_pylist():
                name = path.rsplit("/", 1)[-1]
                out = Output(out_system, f"{base}/{name}")
                index = Output(out_system, f"{base}/{name}.index")
                count = 0
                with system.open_input_stream(path, compression=None) as stream:
                    for record in records(inflated(stream)):
                        engine = zlib.compressobj(params.level, zlib.DEFLATED, GZIP)
                        member = engine.compress(record) + engine.flush()
                        head = parse_head(record[: record.find(END)])
                        entry = {
                            "offset": out.at,
                            "length": len(member),
                            "type": head["warc-type"],
                            "id": head["warc-record-id"],
                        }
                        index.write(json.dumps(entry).encode() + b"\n")
                        out.write(member)
                        count += 1
                out.close()
                index.close()
                yield out.path, index.path, count

        return rows

    spread = files.select("path").repartition(n)
    return map_rows(spread, process, "path string, index string, records bigint")


RECORD_FIELDS = (
    "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, "
    "refers_to bigint, archive string, offset bigint"
)


def parse_record(record: bytes) -> tuple:
    """Values of a record; a response's payload is measured again and must meet its digest."""
    head_end = record.find(END)
    head = parse_head(record[:head_end])
    block = record[head_end + len(END) : -len(END)]
    digest, size = head["warc-payload-digest"].removeprefix("sha256:"), int(head["page-payload-length"])
    if head["warc-type"] == "response":
        payload = block[block.find(END) + len(END) :]
        if len(payload) != size or hashlib.sha256(payload).hexdigest() != digest:
            raise ValueError(f"payload of {head['warc-record-id']} doesn't meet its digest")
    page_id, refers_to = head.get("page-id"), head.get("page-refers-to")
    return (
        None if page_id is None else int(page_id),
        head.get("warc-target-uri"),
        size,
        digest,
        head["warc-type"],
        None if refers_to is None else int(refers_to),
    )


def read_archives(normal: DataFrame, folder: str) -> DataFrame:
    """A row per record of normalised archives (columns path, index), through their indexes."""
    n = max(1, normal.count())

    def process():
        system, _ = file_system(folder)

        def rows(batch):
            for path, index in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with (
                    system.open_input_file(path) as archive,
                    system.open_input_stream(index, compression=None) as entries,
                ):
                    for line in lines_of(entries):
                        entry = json.loads(line)
                        archive.seek(entry["offset"])
                        member = zlib.decompress(archive.read(entry["length"]), GZIP)
                        yield (*parse_record(member), path, entry["offset"])

        return rows

    return map_rows(normal.select("path", "index").repartition(n), process, RECORD_FIELDS)


def round_trip(spark: SparkSession, pages: DataFrame, params: WarcParams = WarcParams()) -> DataFrame:
    """Write pages, normalise the archives and read them back: one row per page."""
    base = f"{shared_dir(spark)}/ontide-warc/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    written = stage(write_archives(pages, f"{base}/whole", params))
    normal = stage(normalise_archives(written, f"{base}/whole", f"{base}/records", params))
    return read_archives(normal, f"{base}/records")
