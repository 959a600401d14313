"""WARC archives: writing, a normaliser for monolithic gzip files, reading by offset.

Writers make archives whose records share one gzip stream, as some crawlers
do. The normaliser inflates such a stream once, from front to back, writes every record
as a gzip member of its own and puts a sidecar index beside the archive (a line a record:
offset, length, type, record id). The reader seeks to members by that index.

Files go to a folder that all executors share, under names that are new for every attempt
of a task; a table of names counts, so files of lost or repeated attempts are never read.
Records stream: memory holds one record and the compressor's window.

Equal payloads of ``REVISIT_BYTES`` or more: the row with the largest id becomes
the response, others revisit it. Rows that share that id and payload are all responses.

Defined cases: a null payload counts as empty; a null url becomes a urn; rows with a null id
are written, and never referred to; an empty table gives no archive and an
empty result; extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm import common

#: Payloads from this size on are stored once.
REVISIT_BYTES = 1000
#: Bytes of records after which a writer starts another archive.
ARCHIVE_BYTES = 32 << 20
LEVEL = 3
CHUNK = 1 << 18


def record(page_id, url, payload: bytes, digest: str, kind: str, refers_to, size: int) -> bytes:
    """A WARC/1.1 record with its closing blank lines."""
    head = [f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()]
    block = head[0] + (payload if kind == "response" else b"")
    target = "".join(c if c.isprintable() and c != " " else f"%{ord(c) % 256:02X}" for c in url or f"urn:page:{page_id}")
    name = lambda i: f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'page:{i}')}>"
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {name(page_id)}", "WARC-Date: 2024-01-01T00:00:00Z", f"WARC-Target-URI: {target}"]
    lines.append(f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}")
    if kind == "revisit":
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {name(refers_to)}", f"X-Refers-To-Page: {refers_to}"]
    if page_id is not None:
        lines.append(f"X-Page-Id: {page_id}")
    lines += [f"X-Payload-Length: {size}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_head(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")
    return {"version": lines[0]} | {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}


def records(chunks: Iterator[bytes]) -> Iterator[bytes]:
    """Whole records of an inflated stream."""
    held = bytearray()
    chunks = iter(chunks)

    def more() -> bool:
        chunk = next(chunks, None)
        if chunk is None:
            return False
        held.extend(chunk)
        return True

    while True:
        while (end := held.find(b"\r\n\r\n")) < 0:
            if not more():
                if held.strip():
                    raise ValueError("a record without an end of its header")
                return
        need = end + 4 + int(parse_head(bytes(held[:end]))["content-length"]) + 4
        while len(held) < need:
            if not more():
                raise ValueError("a record that ends early")
        yield bytes(held[:need])
        del held[:need]


def inflated(stream) -> Iterator[bytes]:
    """The bytes of a gzip file, of one member or several, in pieces of bounded size."""
    state, data, full = zlib.decompressobj(31), b"", False
    while True:
        if not data and not full:
            data = stream.read(CHUNK)
            if not data:
                if not state.eof:
                    raise ValueError("a gzip stream that ends early")
                return
        if state.eof:
            state = zlib.decompressobj(31)
        out = state.decompress(data, 4 * CHUNK)
        full = len(out) == 4 * CHUNK and not state.eof  # there may be more without more input
        data = state.unused_data if state.eof else state.unconsumed_tail
        if out:
            yield out


def _place(folder: str):
    """(file system, path) of a folder named by a URI or a plain path."""
    if "://" in folder or folder.startswith("file:"):
        return fs.FileSystem.from_uri("file://" + folder[5:] if folder.startswith("file:/") and not folder.startswith("file://") else folder)
    return fs.LocalFileSystem(), folder


def _written(folder: str):
    schema = pa.schema([("archive", pa.string()), ("records", pa.int64())])

    def run(batches):
        store, root = _place(folder)
        store.create_dir(root, recursive=True)
        out = packer = name = None
        size = count = 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None:
                    name = f"{root}/{uuid.uuid4().hex}.warc.gz"
                    out, packer, size, count = store.open_output_stream(name, compression=None), zlib.compressobj(LEVEL, zlib.DEFLATED, 31), 0, 0
                data = record(*row)
                out.write(packer.compress(data))
                size, count = size + len(data), count + 1
                if size >= ARCHIVE_BYTES:
                    out.write(packer.flush())
                    out.close()
                    yield pa.record_batch([[name], [count]], schema=schema)
                    out = None
        if out is not None:
            out.write(packer.flush())
            out.close()
            yield pa.record_batch([[name], [count]], schema=schema)

    return run


def normalise(store, source: str, target: str) -> int:
    """Rewrite one gzip stream as a member a record, with ``target`` + ``.idx``; the number of records."""
    count = at = 0
    with store.open_input_stream(source, compression=None) as stream, store.open_output_stream(target, compression=None) as out, store.open_output_stream(f"{target}.idx") as index:
        for data in records(inflated(stream)):
            packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
            member = packer.compress(data) + packer.flush()
            head = parse_head(data[: data.find(b"\r\n\r\n")])
            out.write(member)
            index.write(f"{at}\t{len(member)}\t{head['warc-type']}\t{head['warc-record-id']}\n".encode())
            at, count = at + len(member), count + 1
    return count


def _normalised(folder: str):
    schema = pa.schema([("archive", pa.string()), ("records", pa.int64())])

    def run(batches):
        store, root = _place(folder)
        store.create_dir(root, recursive=True)
        for batch in batches:
            for source in batch.column(0).to_pylist():
                target = f"{root}/{uuid.uuid4().hex}.warc.gz"
                yield pa.record_batch([[target], [normalise(store, source, target)]], schema=schema)

    return run


_ROWS = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])


def read_member(member: bytes) -> tuple:
    """(page id, url, payload, its bytes, its SHA-1, type, page id referred to) of a record; a revisit has no payload."""
    data = zlib.decompress(member, 31)
    end = data.find(b"\r\n\r\n")
    head = parse_head(data[:end])
    block = data[end + 4 : end + 4 + int(head["content-length"])]
    payload = block[block.find(b"\r\n\r\n") + 4 :]
    number = lambda k: int(head[k]) if k in head else None
    said = base64.b32decode(head["warc-payload-digest"].removeprefix("sha1:")).hex()
    if head["warc-type"] == "revisit":
        return number("x-page-id"), head["warc-target-uri"], None, number("x-payload-length"), said, "revisit", number("x-refers-to-page")
    own = hashlib.sha1(payload).hexdigest()
    if own != said:
        raise ValueError(f"payload digest of {head['warc-record-id']} is wrong")
    return number("x-page-id"), head["warc-target-uri"], payload, len(payload), own, "response", None


def _read(folder: str, payloads: bool):
    def run(batches):
        store, _ = _place(folder)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                with store.open_input_stream(f"{name}.idx") as index, store.open_input_file(name) as archive:
                    rows = []
                    for line in index.read().decode().splitlines():
                        at, length, *_ = line.split("\t")
                        archive.seek(int(at))
                        row = read_member(archive.read(int(length)))
                        rows.append(row if payloads else (*row[:2], None, *row[3:]))
                        if len(rows) == 256:
                            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _ROWS.types, strict=True)], schema=_ROWS)
                            rows = []
                    if rows:
                        yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _ROWS.types, strict=True)], schema=_ROWS)

    return run


def marked(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, payload, digest, kind, refers_to, size) of the record of each page."""
    base = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.encode(F.coalesce(F.col(html_col), F.lit("")), "UTF-8").alias("payload"))
    base = base.withColumn("digest", F.sha1("payload")).withColumn("size", F.octet_length("payload").cast("long"))
    large = base.where(F.col("size") >= REVISIT_BYTES).select("page_id", "digest")
    shared = common.table(large.groupBy("digest").agg(F.max("page_id").alias("holder"), F.count("*").alias("n")).where("n > 1 and holder is not null").drop("n"), "shared")
    joined = base.join(F.broadcast(shared) if common.small(shared) else shared, "digest", "left")
    again = (F.col("size") >= REVISIT_BYTES) & F.col("holder").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("holder"))
    kind = F.when(again, "revisit").otherwise("response")
    return joined.select("page_id", "url", "payload", "digest", kind.alias("kind"), F.when(again, F.col("holder")).alias("refers_to"), "size")


def write_archives(pages: DataFrame, folder: str, **columns: str) -> DataFrame:
    """Write ``pages`` as monolithic archives below ``folder``; (archive, records)."""
    common.arrow_rows(pages.sparkSession)
    return common.table(marked(pages, **columns).mapInArrow(_written(folder), "archive string, records long"), "archives")


def normalise_archives(archives: DataFrame, folder: str) -> DataFrame:
    """Archives with a member a record, and their indexes, below ``folder``; (archive, records)."""
    common.arrow_rows(archives.sparkSession)
    spread = archives.select("archive").repartition(max(1, archives.count()))
    return common.table(spread.mapInArrow(_normalised(folder), "archive string, records long"), "archives")


def read_archives(archives: DataFrame, folder: str, payloads: bool = False) -> DataFrame:
    """Rows of the records of normalised archives, each found by its offset."""
    common.arrow_rows(archives.sparkSession)
    schema = "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long"
    return archives.select("archive").repartition(max(1, archives.count())).mapInArrow(_read(folder, payloads), schema)


def through_archives(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Write, normalise and read back ``pages``."""
    spark = pages.sparkSession
    folder = folder or f"{common.own_folder(spark)}/warc-{uuid.uuid4().hex}"
    raw = write_archives(pages, f"{folder}/raw")
    whole = normalise_archives(raw, f"{folder}/members")
    common.remove(spark, f"{folder}/raw")
    return read_archives(whole, folder)
