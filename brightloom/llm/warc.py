"""WARC files: monolithic gzip streams made into one gzip member for each record.

A crawl file that was compressed as a single stream can only be read from its
beginning. The normaliser inflates such a stream once, in chunks, splits it into
records by their Content-Length, deflates each as a member of its own, and
writes the new file and a sidecar index (offset, length, type, target, digest)
by which any record can be read alone. Files that consist of several members
already are taken in the same way.

A file is one task; of it, a chunk, the record at hand (however long) and the
last few index rows are in memory. Both outputs are written under temporary names
and renamed when complete, so a task that runs twice leaves one whole file.

Files are reached by URI through Arrow's file systems, so that the shared folder
may be a cluster's.

Defined results: a stream that ends within a record, or goes on with what is no
gzip or WARC (zeros, a negative or unreadable Content-Length, a head of over
`MOST_HEAD` bytes), gives the whole records before that point, which are in the
output and its sidecar, and a last row with output and record_type null and the
reason in `error`; with no whole record there is no output. An empty file gives
no records and an empty output. An X-Page-Id that is no whole number of 64 bits
gives page_id null. Files are told apart by their path alone; further columns of
the list of files or of pages, whatever their names, are ignored. In crawl files made from pages, null or empty html is a
record with an empty body, a null url one without a target, a null page_id one
in file 0 without an id header; repeated rows are records of their own; an empty
table makes no files.
"""

from __future__ import annotations

import hashlib
import itertools
import json
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brightloom.llm.common import place

CHUNK = 1 << 18
LEVEL = 6
#: No record has a longer head.
MOST_HEAD = 1 << 20
INDEX_ROWS = 1024
PAGES_PER_FILE = 2048
INDEX = pa.schema(
    [(n, pa.string()) for n in ("path", "output")] + [("record", pa.int64()), ("offset", pa.int64()), ("length", pa.int64()), ("record_type", pa.string()), ("target_uri", pa.string()), ("page_id", pa.int64()), ("body_bytes", pa.int64()), ("digest", pa.string()), ("error", pa.string())]
)
INDEX_DDL = "path string, output string, record long, offset long, length long, record_type string, target_uri string, page_id long, body_bytes long, digest string, error string"
MADE_DDL = "path string, records long"


class BadFile(ValueError):
    pass


def inflate(source: pa.NativeFile) -> Iterator[bytes]:
    """The plain bytes of one or more gzip members, in chunks."""
    member = zlib.decompressobj(31)
    fresh = True
    while raw := source.read(CHUNK):
        while raw:
            try:
                plain = member.decompress(raw, 1 << 22)
            except zlib.error as e:
                raise BadFile(f"no gzip stream: {e}") from None
            fresh = False
            if plain:
                yield plain
            if member.eof:
                raw, member, fresh = member.unused_data, zlib.decompressobj(31), True
            else:
                raw = member.unconsumed_tail
    if not fresh:
        raise BadFile("the stream ends early")


def records(chunks: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (by lower-case name) and the bytes of each record, with the two line ends that close it."""
    held = bytearray()
    ended = False

    def fill(n: int) -> bool:
        nonlocal ended
        while len(held) < n and not ended:
            chunk = next(chunks, None)
            if chunk is None:
                ended = True
            else:
                held.extend(chunk)
        return len(held) >= n

    while True:
        at, seen = -1, 0
        while at < 0:
            at = held.find(b"\r\n\r\n", max(0, seen - 3))
            seen = len(held)
            if at < 0 and seen > MOST_HEAD:
                raise BadFile("no WARC record where one should begin")
            if at < 0 and not fill(seen + 1):
                if held.strip():
                    raise BadFile("the stream ends within a record's head")
                return
        lines = bytes(held[:at]).decode("utf-8", "replace").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise BadFile("no WARC record where one should begin")
        head = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        length = head.get("content-length", "")
        if not (length.isascii() and length.isdigit() and len(length) < 19):
            raise BadFile("a record without a valid Content-Length")
        size = at + 4 + int(length)
        if not fill(size + 4):
            raise BadFile("the stream ends within a record")
        yield head, bytes(held[: size + 4])
        del held[: size + 4]


def whole_number(text: str | None) -> int | None:
    """A number of 64 bits, None for anything else."""
    if text is None or not re.fullmatch(r"-?[0-9]{1,19}", text):
        return None
    return n if -(1 << 63) <= (n := int(text)) < 1 << 63 else None


def normalise_file(path: str, out_dir: str) -> Iterator[dict]:
    """Writes the file's records as members into out_dir, with the sidecar; rows of INDEX."""
    name = path.rsplit("/", 1)[-1]
    output = f"{name.removesuffix('.gz')}.members.gz"
    source_fs, source_path = place(path)
    target_fs, target_path = place(f"{out_dir}/{output}")
    target_fs.create_dir(target_path.rsplit("/", 1)[0], recursive=True)
    part = f"{target_path}.{uuid.uuid4().hex}.part"
    n, offset, error = 0, 0, None
    with source_fs.open_input_stream(source_path, compression=None) as source, target_fs.open_output_stream(part, compression=None) as target, target_fs.open_output_stream(part + ".idx", compression=None) as index:
        try:
            for head, raw in records(inflate(source)):
                packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
                member = packer.compress(raw) + packer.flush()
                target.write(member)
                body = memoryview(raw)[raw.index(b"\r\n\r\n") + 4 : -4]
                entry = {"offset": offset, "length": len(member), "record_type": head.get("warc-type"), "target_uri": head.get("warc-target-uri"), "digest": hashlib.sha1(body).hexdigest()}
                index.write(json.dumps(entry).encode() + b"\n")
                yield entry | {"path": name, "output": output, "record": n, "page_id": whole_number(head.get("x-page-id")), "body_bytes": len(body), "error": None}
                n, offset = n + 1, offset + len(member)
        except BadFile as e:
            error = str(e)
    if error:
        yield {"path": name, "output": None, "record": n, "error": error}
    if error and not n:
        target_fs.delete_file(part)
        target_fs.delete_file(part + ".idx")
    else:
        target_fs.move(part + ".idx", target_path + ".idx")
        target_fs.move(part, target_path)


def normalise(files: DataFrame, out_dir: str) -> DataFrame:
    """Normalises the files of column `path` into out_dir; rows of INDEX.

    One task takes one file at a time; the work is done when the rows are read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                rows = normalise_file(path, out_dir) if path is not None else iter(())
                while some := list(itertools.islice(rows, INDEX_ROWS)):
                    yield pa.RecordBatch.from_pylist(some, schema=INDEX)

    return files.select("path").mapInArrow(run, INDEX_DDL)


def read_record(uri: str, offset: int, length: int) -> bytes:
    """One record of a normalised file, by its place in the index."""
    files, path = place(uri)
    with files.open_input_file(path) as f:
        f.seek(offset)
        return zlib.decompress(f.read(length), 31)


def warc_record(page_id: int | None, url: str | None, html: str | None) -> bytes:
    body = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n" + (html or "").encode("utf-8", "replace")
    own = hashlib.md5(body + repr((page_id, url)).encode("utf-8", "replace")).hexdigest()
    head = ["WARC/1.0", "WARC-Type: response", f"WARC-Record-ID: <urn:uuid:{uuid.UUID(own)}>", "WARC-Date: 2024-01-01T00:00:00Z"]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", " ").replace("\n", " "))
    if page_id is not None:
        head.append(f"X-Page-Id: {page_id}")
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}"]
    return "\r\n".join(head).encode("utf-8", "replace") + b"\r\n\r\n" + body + b"\r\n\r\n"


def monoliths(pages: DataFrame, out_dir: str, pages_per_file: int = PAGES_PER_FILE) -> DataFrame:
    """Crawl files, each one gzip stream, made of pages (page_id, url, html): rows (path, records).

    The files that the normaliser is for. A page's file follows from a hash of
    its id, its place from its id.
    """
    n = max(1, -(-pages.count() // pages_per_file))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, packer, sink, count, files, part, final = None, None, None, 0, None, "", ""

        def close() -> list[dict]:
            if current is None:
                return []
            sink.write(packer.flush())
            sink.close()
            files.move(part, final)
            return [{"path": f"{out_dir}/crawl-{current:06d}.warc.gz", "records": count}]

        schema = pa.schema([("path", pa.string()), ("records", pa.int64())])
        for batch in batches:
            for file, page_id, url, html in zip(*(batch.column(c).to_pylist() for c in ("file", "page_id", "url", "html"))):
                if file != current:
                    yield pa.RecordBatch.from_pylist(close(), schema=schema)
                    files, final = place(f"{out_dir}/crawl-{file:06d}.warc.gz")
                    files.create_dir(final.rsplit("/", 1)[0], recursive=True)
                    part = f"{final}.{uuid.uuid4().hex}.part"
                    current, count, packer, sink = file, 0, zlib.compressobj(LEVEL, zlib.DEFLATED, 31), files.open_output_stream(part, compression=None)
                sink.write(packer.compress(warc_record(page_id, url, html)))
                count += 1
        yield pa.RecordBatch.from_pylist(close(), schema=schema)

    file = F.when(F.col("page_id").isNull(), 0).otherwise(F.pmod(F.xxhash64("page_id"), F.lit(n))).cast("int")
    placed = pages.select(file.alias("file"), F.col("page_id").cast("long").alias("page_id"), "url", "html")
    return placed.repartition(n, "file").sortWithinPartitions("file", F.col("page_id").asc_nulls_last(), "url").mapInArrow(run, MADE_DDL)
