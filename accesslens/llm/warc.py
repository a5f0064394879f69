"""WARC archives: monolithic gzip streams, and their normaliser.

``write_monolithic`` writes records as one gzip stream for each file.
``normalise`` inflates every such stream once, rewrites each record as its own
gzip member and puts an offset index beside the file.  ``read_records`` reads
records back through that index, member by member.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import read_table, stage, work_dir

#: Uncompressed bytes after which a task starts another archive.
ROLL_BYTES = 32 << 20
CHUNK = 1 << 20
GZIP = 16 + zlib.MAX_WBITS
#: Fixed values of the format.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
STAMP = "2000-01-01T00:00:00Z"

WRITTEN = "archive string, position long, page_id long, payload_bytes long, payload_digest string"
PLACED = "archive string, records long"
READ = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, archive string, offset long"


def _open(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri) if "://" in uri else (pafs.LocalFileSystem(), uri)


def _id(page_id: int | None, salt: str) -> str:
    return f"<urn:page:{'null' if page_id is None else page_id}:{salt}>"


def record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    """One record: header lines, an empty line, the block, two line ends."""
    lines = ["WARC/1.1", *(f"{k}: {v}" for k, v in headers), f"Content-Length: {len(block)}"]
    return ("\r\n".join(lines) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


class Records:
    """Reads records from an inflating stream, holding one record at a time."""

    def __init__(self, raw):
        self.raw, self.inflate, self.held = raw, zlib.decompressobj(GZIP), bytearray()

    def _more(self) -> bool:
        data = self.inflate.unconsumed_tail or self.raw.read(CHUNK)
        if self.inflate.eof:  # another member follows, or nothing
            data = self.inflate.unused_data + data
            if not data:
                return False
            self.inflate = zlib.decompressobj(GZIP)
        if not data:
            return False
        self.held += self.inflate.decompress(data, CHUNK)
        return True

    def __iter__(self) -> Iterator[tuple[dict[str, str], bytes]]:
        while True:
            while (end := self.held.find(b"\r\n\r\n")) < 0:
                if not self._more():
                    if self.held.strip():
                        raise ValueError("the archive ends inside a record")
                    return
            head = parse_headers(bytes(self.held[:end]))
            start, length = end + 4, int(head["Content-Length"])
            while len(self.held) < start + length + 4:
                if not self._more():
                    raise ValueError("the archive ends inside a record")
            block = bytes(self.held[start : start + length])
            del self.held[: start + length + 4]
            yield head, block


def parse_headers(data: bytes) -> dict[str, str]:
    lines = data.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    return dict(line.split(": ", 1) for line in lines[1:])


def _uri_header(url: str | None) -> list[tuple[str, str]]:
    """The target URI; null has no header; others are kept exactly in base64 if they hold line ends."""
    if url is None:
        return []
    if url.isprintable() and url.strip() == url:
        return [("WARC-Target-URI", url)]
    return [("X-Target-URI-Base64", base64.b64encode(url.encode("utf-8", "surrogatepass")).decode())]


def _page_of(head: dict[str, str]) -> tuple[int | None, str | None]:
    page = head["X-Page-Id"]
    url = head.get("WARC-Target-URI")
    if "X-Target-URI-Base64" in head:
        url = base64.b64decode(head["X-Target-URI-Base64"]).decode("utf-8", "surrogatepass")
    return (None if page == "null" else int(page)), url


def _cells(column: pa.Array) -> list:
    return column.to_pylist()


def write_monolithic(pages: DataFrame, folder: str) -> DataFrame:
    """Write each row of ``pages`` as a record; one row for each record comes back, staged.

    Every archive is one gzip stream.  A file's name is new for each attempt of
    a task, so a lost attempt leaves a file that nothing refers to.  A task
    holds one batch of rows and one deflating stream.
    """

    def write(batches):
        fs = root = out = gz = name = None
        held = position = 0

        def close():
            out.write(gz.flush())
            out.close()

        for batch in batches:
            where, seq, ids, sizes, digests = [], [], [], [], []
            html = batch.column("html").cast(pa.binary())
            for page, url, body in zip(_cells(batch.column("page_id")), _cells(batch.column("url")), html, strict=True):
                block = body.as_py() or b""
                if out is None:
                    fs, root = _open(folder)
                    fs.create_dir(root, recursive=True)
                    name = f"{uuid.uuid4().hex}.warc.gz"
                    out, gz, held, position = fs.open_output_stream(f"{root}/{name}", compression=None), zlib.compressobj(1, zlib.DEFLATED, GZIP), 0, 0
                digest = hashlib.sha1(block).hexdigest()
                head = [("WARC-Type", "response"), ("WARC-Record-ID", _id(page, f"{name[:8]}-{position}")), ("WARC-Date", STAMP), ("X-Page-Id", "null" if page is None else str(page)), ("WARC-Payload-Digest", f"sha1:{digest}"), *_uri_header(url)]
                data = record(head, block)
                out.write(gz.compress(data))
                where.append(name)
                seq.append(position)
                ids.append(page)
                sizes.append(len(block))
                digests.append(digest)
                held, position = held + len(data), position + 1
                if held >= ROLL_BYTES:
                    close()
                    out = None
            yield pa.RecordBatch.from_arrays([pa.array(where, pa.string()), pa.array(seq, pa.int64()), pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(digests, pa.string())], ["archive", "position", "page_id", "payload_bytes", "payload_digest"])
        if out is not None:
            close()

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return stage(rows.mapInArrow(write, WRITTEN), "warc-written")


def decide(written: DataFrame, least_bytes: int = 1000) -> DataFrame:
    """``written`` with ``refers_to``: of equal payloads of at least ``least_bytes``, the largest page_id; and ``refers_id``, its record's.

    Both are null for that page itself, for smaller payloads and where no page of
    a group has an id.  Groups are combined before the shuffle and hold one
    number each, however many copies there are.
    """
    big = written.where(F.col("payload_bytes") >= least_bytes)
    owners = big.groupBy("payload_digest", "payload_bytes").agg(F.max(F.struct("page_id", "archive", "position")).alias("own"), F.count("*").alias("copies")).where("copies > 1").drop("copies")
    joined = written.join(owners, ["payload_digest", "payload_bytes"], "left")
    refers = joined.withColumn("refers_to", F.when(F.col("page_id").isNull() | (F.col("page_id") != F.col("own.page_id")), F.col("own.page_id")))
    return refers.withColumn("refers_id", F.when(F.col("refers_to").isNotNull(), F.concat(F.lit("<urn:page:"), "own.page_id", F.lit(":"), F.substring("own.archive", 1, 8), F.lit("-"), "own.position", F.lit(">")))).drop("own")


def normalise(decided: DataFrame, folder: str, to: str) -> DataFrame:
    """Rewrite each archive with a member for each record and a sidecar index.

    The index ``<archive>.idx`` has 16 bytes a record: offset and length of its
    member.  A record that refers to another page becomes a revisit without a
    block; its header keeps digest and length of the payload.  A task holds one
    archive's decisions (a few bytes a record, bounded by ``ROLL_BYTES``) and one
    record at a time.  Files are written under a name of the attempt and only
    the names of finished ones are returned.
    """

    def rewrite(table: pa.Table) -> pa.Table:
        name = table.column("archive")[0].as_py()
        refers = dict(zip(table.column("position").to_pylist(), zip(table.column("refers_to").to_pylist(), table.column("refers_id").to_pylist(), strict=True), strict=True))
        fs, root = _open(folder)
        fs_to, root_to = _open(to)
        fs_to.create_dir(root_to, recursive=True)
        new = f"{uuid.uuid4().hex}.warc.gz"
        offset, n, index = 0, 0, []
        with fs.open_input_stream(f"{root}/{name}", compression=None) as raw, fs_to.open_output_stream(f"{root_to}/{new}", compression=None) as out:
            for head, block in Records(raw):
                target, target_id = refers[n]
                kept = [(k, v) for k, v in head.items() if k not in ("WARC-Type", "Content-Length")]
                if target is None:
                    data = record([("WARC-Type", "response"), *kept], block)
                else:
                    data = record([("WARC-Type", "revisit"), *kept, ("WARC-Profile", PROFILE), ("WARC-Refers-To", target_id), ("X-Refers-To-Page", str(target)), ("X-Payload-Length", str(len(block)))], b"")
                gz = zlib.compressobj(3, zlib.DEFLATED, GZIP)
                member = gz.compress(data) + gz.flush()
                out.write(member)
                index.append(struct.pack("<QQ", offset, len(member)))
                offset, n = offset + len(member), n + 1
        if n != len(refers):
            raise ValueError(f"{name} holds {n} records, not {len(refers)}")
        with fs_to.open_output_stream(f"{root_to}/{new}.idx", compression=None) as out:
            out.write(b"".join(index))
        return pa.table({"archive": pa.array([new]), "records": pa.array([n], pa.int64())})

    small = decided.select("archive", "position", "refers_to", "refers_id")
    small = small.repartition(max(1, small.select("archive").distinct().count()), "archive")  # rows are few, their files large
    return stage(small.groupBy("archive").applyInArrow(rewrite, PLACED), "warc-placed")


def read_records(placed: DataFrame, folder: str) -> DataFrame:
    """Read every record through the index: one row each, columns as in ``READ``."""
    names = [x.split(" ")[0] for x in READ.split(", ")]
    kinds = {"long": pa.int64(), "string": pa.string()}
    schema = pa.schema([(n, kinds[x.split(" ")[1]]) for n, x in zip(names, READ.split(", "), strict=True)])

    def read(batches):
        for batch in batches:
            for name in batch.column("archive").to_pylist():
                fs, root = _open(folder)
                with fs.open_input_stream(f"{root}/{name}.idx", compression=None) as f:
                    index = list(struct.iter_unpack("<QQ", f.read()))
                rows = []
                with fs.open_input_file(f"{root}/{name}") as f:
                    for offset, length in index:
                        f.seek(offset)
                        [(head, block)] = Records(pa.BufferReader(f.read(length)))
                        page, url = _page_of(head)
                        if head["WARC-Type"] == "revisit":
                            size, digest, target = int(head["X-Payload-Length"]), head["WARC-Payload-Digest"].removeprefix("sha1:"), int(head["X-Refers-To-Page"])
                        else:
                            size, digest, target = len(block), hashlib.sha1(block).hexdigest(), None
                        rows.append((page, url, size, digest, head["WARC-Type"], target, name, offset))
                        if len(rows) == 4096:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)
                            rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

    spread = placed.select("archive").repartition(max(1, placed.count()))
    return spread.mapInArrow(read, READ)


def archive_pages(pages: DataFrame, least_bytes: int = 1000) -> tuple[DataFrame, str]:
    """Write ``pages`` to monolithic archives, normalise them and read them back.

    Returns the records (see ``READ``) and the folder of the archives.  Reads
    ``page_id``, ``url`` and ``html`` only; a null html is an empty payload, a
    null url has no header, a null page_id stays null and can only be a revisit
    of another page.  Repeated rows are records of their own; those with the
    largest page_id of a group are all responses.  An empty table gives no
    archive and no rows.
    """
    base = work_dir(pages.sparkSession, "warc")
    written = write_monolithic(pages, f"{base}/monolithic")
    placed = normalise(decide(written, least_bytes), f"{base}/monolithic", f"{base}/members")
    fs, root = _open(f"{base}/monolithic")
    if fs.get_file_info(root).type == pafs.FileType.Directory:
        fs.delete_dir(root)
    return read_records(placed, f"{base}/members"), f"{base}/members"


def op3_query(spark, sf_dir):
    records, _ = archive_pages(read_table(spark, sf_dir, "pages"))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP3_SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS d FROM pages),
o AS (SELECT d, n, max(page_id) AS owner, count(*) AS c FROM p WHERE n >= 1000 GROUP BY d, n)
SELECT p.page_id, p.n AS payload_bytes, p.d AS payload_digest,
       CASE WHEN c > 1 AND owner IS NOT NULL AND (p.page_id IS NULL OR p.page_id <> owner) THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN c > 1 AND (p.page_id IS NULL OR p.page_id <> owner) THEN owner END AS refers_to
FROM p LEFT JOIN o ON p.d = o.d AND p.n = o.n
"""
