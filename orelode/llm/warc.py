"""WARC archives as a PySpark Python data source (operator 7).

``spark.read.format("warc").load(path)`` plans its tasks from pieces of archives,
takes filters on record type, target URI, ids and digest into the scan, and reads
a record's header first: a record that the filters refuse is skipped, its block
neither decoded nor hashed. Without the option ``payload`` blocks are never
decoded; ``verify`` recomputes payload digests.

``df.write.format("warc").mode("append").save(path)`` writes one archive per
task and names the archives of finished tasks in a manifest, so files of lost or
repeated attempts are never read. Every record is a gzip member of its own whose
header tells the member's length in an extra field, which other readers pass
over: a refused record is skipped without being inflated. The manifest lists
places at which an archive can be cut. Archives of others, compressed or not, are
read from their beginning, and skipped by Content-Length.

Records: a warcinfo at the head of every archive, then ``response`` records with
an HTTP header block and the payload, and ``revisit`` records (identical payload
digest profile) with the HTTP header block alone, whose Content-Length is that
of the full payload. Paths may be of any file system that pyarrow opens.

Cases: null payloads are empty; null ids are written without a number and read
back as null; null or multi-line header values are left out or put on one line.
Payloads are written whole, whatever their length. Of equal payloads whose
page_id ties for the largest, all rows with it are responses, as are repeated
rows of it. An empty table gives an archive set without records. Other columns
are not read, whatever their names.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import json
import struct
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, In, InputPartition, IsNotNull, WriterCommitMessage

from orelode.llm.common import cut_lineage, delete_folder, shared_dir, table

#: Fixed values of the format.
VERSION = b"WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2000-01-01T00:00:00Z"

LEAST_BYTES = 1000
#: Rows of one payload that are joined by digest; payloads of more are broadcast, and are at most ``BROADCAST_DIGESTS``.
SHARED_ROWS = 10_000
BROADCAST_DIGESTS = 50_000
MANIFEST = "manifest-"
#: Fixed values of the compressed members: the gzip header up to its extra field, and that field's name and length.
GZIP_HEAD = b"\x1f\x8b\x08\x04\x00\x00\x00\x00\x00\xff"
EXTRA = b"LN\x08\x00"
HEAD_BYTES = len(GZIP_HEAD) + 2 + len(EXTRA) + 8
#: Bytes of an archive between places at which it can be cut.
CUT_BYTES = 4 << 20
WRITE_SCHEMA = "page_id bigint, url string, record_type string, refers_to bigint, digest string, payload binary"
READ_SCHEMA = "page_id bigint, target_uri string, record_type string, refers_to bigint, payload_bytes bigint, payload_digest string, payload binary"
#: The columns that a header alone decides, and the header fields they are read from.
HEADER_COLUMNS = {"record_type": "warc-type", "target_uri": "warc-target-uri", "page_id": "warc-record-id", "refers_to": "warc-refers-to", "payload_digest": "warc-payload-digest"}


def file_system(path: str):
    """pyarrow's file system of a path or URI, and the path in it."""
    import pyarrow.fs as pafs

    if "://" not in path and not path.startswith("file:"):
        return pafs.LocalFileSystem(), path
    if path.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return pafs.FileSystem.from_uri(path)


def hex_to_header(digest: str) -> str:
    return "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode()


def header_to_hex(value: str | None) -> str | None:
    return base64.b32decode(value[5:]).hex() if value and value.startswith("sha1:") else None


def record_urn(page_id: int | None) -> str:
    return f"<urn:page:{page_id}>" if page_id is not None else f"<urn:uuid:{uuid.uuid4()}>"


def urn_page(value: str | None) -> int | None:
    return int(value[10:-1]) if value and value.startswith("<urn:page:") else None


def record(fields: list[tuple[str, str | None]], block: bytes) -> bytes:
    lines = [f"{k}: {' '.join(v.split())}" for k, v in fields if v is not None]
    return b"\r\n".join([VERSION, *[x.encode() for x in lines], b"Content-Length: %d" % len(block), b"", block, b"", b""])


def page_record(page_id: int | None, url: str | None, kind: str, refers_to: int | None, digest: str, payload: bytes) -> bytes:
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    fields = [
        ("WARC-Type", kind),
        ("WARC-Record-ID", record_urn(page_id)),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", url),
        ("Content-Type", "application/http; msgtype=response"),
        ("WARC-Payload-Digest", hex_to_header(digest)),
    ]
    if kind == "revisit":
        fields += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", record_urn(refers_to))]
    return record(fields, http + (payload if kind == "response" else b""))


def member(data: bytes, level: int) -> bytes:
    """A gzip member that tells its own length."""
    deflate = zlib.compressobj(level, zlib.DEFLATED, -zlib.MAX_WBITS)
    body = deflate.compress(data) + deflate.flush()
    length = HEAD_BYTES + len(body) + 8
    return GZIP_HEAD + struct.pack("<H", len(EXTRA) + 8) + EXTRA + struct.pack("<Q", length) + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


def member_length(head: bytes) -> int | None:
    """The length that a member tells, or None where it doesn't."""
    if len(head) < HEAD_BYTES or head[:4] != GZIP_HEAD[:4] or head[12:16] != EXTRA:
        return None
    return struct.unpack_from("<Q", head, 16)[0]


def put(out, data: bytes) -> int:
    out.write(data)
    return len(data)


class WarcWriter(DataSourceArrowWriter):
    """One gzip member per record; archives count once their task is committed."""

    def __init__(self, path: str, level: int):
        self.path, self.level = path, level

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        fs, root = file_system(self.path)
        fs.create_dir(root, recursive=True)
        name, at, cuts = f"part-{uuid.uuid4().hex}.warc.gz", 0, [0]
        with fs.open_output_stream(f"{root}/{name}", compression=None, buffer_size=1 << 20) as out:
            info = record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", DATE), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n")
            at += put(out, member(info, self.level))
            for batch in iterator:
                cols = [batch.column(c) for c in ("page_id", "url", "record_type", "refers_to", "digest", "payload")]
                for values in zip(*cols):
                    page_id, url, kind, refers_to, digest, payload = (v.as_py() for v in values)
                    if at - cuts[-1] >= CUT_BYTES:
                        cuts.append(at)
                    at += put(out, member(page_record(page_id, url, kind, refers_to, digest, payload or b""), self.level))
        return Archive(name, [*cuts, at])

    def commit(self, messages: list[Archive | None]) -> None:
        fs, root = file_system(self.path)
        fs.create_dir(root, recursive=True)
        archives = {m.name: m.cuts for m in messages if m is not None}
        with fs.open_output_stream(f"{root}/{MANIFEST}{uuid.uuid4().hex}.json", compression=None) as out:
            out.write(json.dumps(archives).encode())

    def abort(self, messages: list[Archive | None]) -> None:
        fs, root = file_system(self.path)
        for m in messages:
            if m is not None:
                fs.delete_file(f"{root}/{m.name}")


class Archive(WriterCommitMessage):
    def __init__(self, name: str, cuts: list[int]):
        self.name, self.cuts = name, cuts


class Pieces(InputPartition):
    """Parts of archives as (path, first byte, byte behind the last); None for an archive that can't be cut."""

    def __init__(self, pieces: list[tuple[str, int, int | None]]):
        self.pieces = pieces


class WarcReader(DataSourceReader):
    def __init__(self, path: str, options: dict):
        self.path = path
        self.payload = str(options.get("payload", "false")).lower() == "true"
        self.verify = str(options.get("verify", "false")).lower() == "true"
        self.bytes_per_task = int(options.get("bytesPerTask", 16 << 20))
        self.wanted: dict[str, set] = {}
        self.present: set[str] = set()

    def pushFilters(self, filters):
        """Takes equality, membership and not-null on header columns; the rest goes back to Spark."""
        for f in filters:
            column = f.attribute[0] if isinstance(f, (EqualTo, In, IsNotNull)) and len(f.attribute) == 1 else None
            if column not in HEADER_COLUMNS:
                yield f
            elif isinstance(f, IsNotNull):
                self.present.add(column)
            else:
                values = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.wanted[column] = self.wanted.get(column, values) & values

    def partitions(self) -> list[Pieces]:
        import pyarrow.fs as pafs

        fs, root = file_system(self.path)
        found = {f.base_name: f for f in fs.get_file_info(pafs.FileSelector(root, allow_not_found=True)) if f.is_file}
        manifests = [n for n in found if n.startswith(MANIFEST)]
        cuts: dict[str, list[int] | None] = {n: None for n in found if n.endswith((".warc", ".warc.gz"))} if not manifests else {}
        for m in manifests:
            with fs.open_input_stream(found[m].path) as f:
                cuts |= json.loads(f.read())
        tasks: list[list[tuple[str, int, int | None]]] = []
        filled = self.bytes_per_task
        for name, at in sorted(cuts.items()):
            path = found[name].path
            for first, last, size in [(0, None, found[name].size)] if at is None else [(a, z, z - a) for a, z in zip(at, at[1:])]:
                if filled + size > self.bytes_per_task:
                    tasks.append([])
                    filled = 0
                tasks[-1].append((path, first, last))
                filled += size
        return [Pieces(t) for t in tasks] or [Pieces([])]

    def read(self, partition: Pieces) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("page_id", pa.int64()), ("target_uri", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary())])
        rows: list[tuple] = []
        held = 0
        for row in (r for p in partition.pieces for r in self.records(*p)):
            rows.append(row)
            held += 200 + len(row[-1] or b"")
            if held > 8 << 20:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
                rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    def records(self, path: str, first: int, last: int | None) -> Iterator[tuple]:
        fs, _ = file_system(self.path)
        if last is None:
            with fs.open_input_stream(path, compression=None) as raw:
                source = gzip.GzipFile(fileobj=raw) if path.endswith(".gz") else io.BufferedReader(raw, 1 << 16)
                while (head := read_header(source)) is not None:
                    row, used = self.one(head, source)
                    skip(source, int(head.get("content-length", 0)) - used + 4)
                    if row is not None:
                        yield row
            return
        with fs.open_input_file(path) as raw:
            at, ahead = first, Ahead(raw, last)
            while at < last:
                source = Inflated(ahead, at)
                at += source.length
                row, _ = self.one(read_header(source), source)
                if row is not None:
                    yield row

    def one(self, head: dict[str, str], source) -> tuple[tuple | None, int]:
        """A record's row, None where a filter refuses it, and the bytes of its block that were read."""
        row, length, used = self.from_header(head), int(head.get("content-length", 0)), 0
        if row is None:
            return None, 0
        kind, size, payload = row["record_type"], None, None
        if kind in ("response", "revisit"):
            http, used = read_http(source, length)
            size = int(http.get("content-length", length - used))
            if kind == "response" and (self.payload or self.verify):
                body = take(source, length - used)
                used = length
                if self.verify:
                    row["payload_digest"], size = hashlib.sha1(body).hexdigest(), len(body)
                payload = body if self.payload else None
        return (row["page_id"], row["target_uri"], kind, row["refers_to"], size, row["payload_digest"], payload), used

    def from_header(self, head: dict[str, str]) -> dict | None:
        """The header's columns, or None where a pushed filter refuses the record."""
        row = {c: head.get(h) for c, h in HEADER_COLUMNS.items()}
        row["page_id"], row["refers_to"], row["payload_digest"] = urn_page(row["page_id"]), urn_page(row["refers_to"]), header_to_hex(row["payload_digest"])
        if any(row[c] is None for c in self.present) or any(row[c] not in v for c, v in self.wanted.items()):
            return None
        return row


class Ahead:
    """Bytes of a file by place, read ``size`` at a time and sought where they lie further on."""

    def __init__(self, raw, last: int, size: int = 1 << 18):
        self.raw, self.last, self.size, self.first, self.held = raw, last, size, 0, b""

    def get(self, at: int, n: int) -> bytes:
        """At most n bytes from a place; empty only at the end."""
        if not self.first <= at < self.first + len(self.held):
            self.raw.seek(at)
            self.first, self.held = at, self.raw.read(min(self.size, self.last - at))
        return self.held[at - self.first : at - self.first + n]


class Inflated:
    """One member of an archive, inflated no further than it is read."""

    def __init__(self, source: Ahead, at: int):
        head = source.get(at, HEAD_BYTES)
        if len(head) < HEAD_BYTES:
            head += source.get(at + len(head), HEAD_BYTES - len(head))
        length = member_length(head)
        if length is None:
            raise ValueError("a member of the archive doesn't tell its length")
        self.source, self.length, self.at, self.end = source, length, at + HEAD_BYTES, at + length
        self.inflate, self.fed, self.held = zlib.decompressobj(-zlib.MAX_WBITS), b"", b""

    def _more(self, n: int) -> bool:
        """Inflates about n bytes; False at the end."""
        if self.inflate.eof:
            return False
        if not self.fed:
            self.fed = self.source.get(self.at, min(self.end - self.at, 1 << 16))
            self.at += len(self.fed)
        if not self.fed:
            raise EOFError("the archive ends within a record")
        self.held += self.inflate.decompress(self.fed, n)
        self.fed = self.inflate.unconsumed_tail
        return True

    def readline(self) -> bytes:
        while (at := self.held.find(b"\n")) < 0 and self._more(1024):
            pass
        return self.read(at + 1 if at >= 0 else len(self.held))

    def read(self, n: int) -> bytes:
        while len(self.held) < n and self._more(max(n - len(self.held), 1)):
            pass
        out, self.held = self.held[:n], self.held[n:]
        return out


def read_header(source) -> dict[str, str] | None:
    line = source.readline()
    while line in (b"\r\n", b"\n"):
        line = source.readline()
    if not line:
        return None
    if not line.startswith(b"WARC/"):
        raise ValueError(f"not a WARC record: {line[:40]!r}")
    return _fields(source)[0]


def _fields(source) -> tuple[dict[str, str], int]:
    """Header fields up to the empty line, and the bytes they took."""
    fields, used = {}, 0
    while True:
        line = source.readline()
        used += len(line)
        if line in (b"\r\n", b"\n", b""):
            return fields, used
        name, _, value = line.decode("utf-8", "replace").partition(":")
        fields[name.strip().lower()] = value.strip()


def read_http(source, length: int) -> tuple[dict[str, str], int]:
    status = source.readline()
    fields, used = _fields(source)
    return fields, used + len(status)


def take(source, n: int) -> bytes:
    data = source.read(n)
    if len(data) != n:
        raise EOFError("the archive ends within a record")
    return data


def skip(source, n: int) -> None:
    while n > 0:
        got = len(source.read(min(n, 1 << 20)))
        if not got:
            return
        n -= got


class WarcDataSource(DataSource):
    """Format name ``warc``; options: path, payload, verify, bytesPerTask, level."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return READ_SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(self.options["path"], self.options)

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        if overwrite:
            raise ValueError("archives are only appended to; choose a new folder")
        return WarcWriter(self.options["path"], int(self.options.get("level", 1)))


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcDataSource)


def plan_records(pages: DataFrame, least_bytes: int = LEAST_BYTES, shared_rows: int = SHARED_ROWS) -> DataFrame:
    """The rows to write: equal payloads of enough bytes revisit the one with the largest page_id.

    A digest may be that of a third of all pages. Digests of more than ``shared_rows``
    pages, or of one in ``BROADCAST_DIGESTS`` where that is more, can't be many and
    are broadcast; all others are joined, and no other page is dealt by its digest.
    """
    content = F.coalesce(F.col("html").cast("string").cast("binary"), F.lit(b""))
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), content.alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload"))
    large = F.octet_length("payload") >= least_bytes
    shared = rows.where(large).groupBy(F.col("digest").alias("of")).agg(F.count("*").alias("n"), F.max("page_id").alias("first")).where("n > 1")
    shared = cut_lineage(shared)
    many = max(shared_rows, (shared.agg(F.sum("n")).first()[0] or 0) // BROADCAST_DIGESTS)
    hot = F.broadcast(shared.where(F.col("n") > many).select(F.col("of").alias("hot"), F.col("first").alias("hot_first")))
    few = shared.where(F.col("n") <= many).select("of", "first")
    marked = rows.join(hot, large & (rows["digest"] == hot["hot"]), "left")
    alone = F.concat(F.lit("-"), F.coalesce(F.col("page_id").cast("string"), F.col("digest")))
    marked = marked.withColumn("key", F.when(large & F.col("hot").isNull(), F.col("digest")).otherwise(alone)).join(few, F.col("key") == F.col("of"), "left")
    first = F.coalesce("hot_first", "first")
    revisits = first.isNotNull() & ~F.col("page_id").eqNullSafe(first)
    return marked.select("page_id", "url", F.when(revisits, "revisit").otherwise("response").alias("record_type"), F.when(revisits, first).alias("refers_to"), "digest", "payload")


def write_archives(pages: DataFrame, path: str, level: int = 1) -> None:
    register(pages.sparkSession)
    plan_records(pages).write.format("warc").option("level", level).mode("append").save(path)


def read_archives(spark: SparkSession, path: str, kinds: tuple[str, ...] = ("response", "revisit"), **options: str) -> DataFrame:
    register(spark)
    return spark.read.format("warc").options(**options).load(path).where(F.col("record_type").isin(*kinds))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes every page as a WARC record and reads the archives back; they are deleted once the result is checkpointed."""
    path = f"{shared_dir(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"
    write_archives(table(spark, sf_dir, "pages"), path)
    found = cut_lineage(read_archives(spark, path, verify="true").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"))
    delete_folder(spark, path)
    return found


ORACLE = """
with p as (select page_id, encode(coalesce(html, '')) as b from pages),
d as (select page_id, octet_length(b) as n, sha1(b) as digest from p),
g as (select digest, max(page_id) as first from d where n >= 1000 group by digest)
select d.page_id, d.n as payload_bytes, d.digest as payload_digest,
       case when d.n >= 1000 and g.first <> d.page_id then 'revisit' else 'response' end as record_type,
       case when d.n >= 1000 and g.first <> d.page_id then g.first end as refers_to
from d left join g using (digest)
"""
