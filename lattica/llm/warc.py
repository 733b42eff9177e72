"""WARC as a PySpark Python data source, written and read.

Reading plans partitions by files, takes predicates on record type and headers, parses a record's headers first and
decodes its payload only if the predicates hold and payloads are asked for. Compressed archives hold one gzip member a
record; the writer notes the member's length in the gzip header (extra field "sl"), so a reader passes over an unwanted
payload without inflating it. Archives without that note are read too, by inflating, however many records a member
holds. What is inflated is held against its member's checksum; a record or member that is cut short is an error, never a
shorter payload.

Files are opened through pyarrow's file systems by URI on driver and executors alike. A write commits by one manifest
that names its files; what failed attempts leave is never read.

Defined results: a null payload is an empty one; a null url leaves out the header; ids are kept percent-encoded, a null
one under a name of its own; line ends in a url come back percent-encoded; a page whose payload nobody shares is a response; of equal payloads all rows with the least id are responses (normally
one), and where all ids are null all are; an empty table gives archives without records.
"""

from __future__ import annotations

import base64
import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, In, InputPartition, IsNotNull, WriterCommitMessage
from pyspark.sql.types import StructType

from lattica.llm.common import cut, fresh_path, own_columns

READ_SCHEMA = "record_type string, record_id string, target_uri string, date string, payload_digest string, refers_to string, payload_bytes bigint, payload binary"
#: Columns that the reader can test on headers alone, with the header they come from.
HEADERS = {"record_type": "warc-type", "record_id": "warc-record-id", "target_uri": "warc-target-uri", "date": "warc-date", "payload_digest": "warc-payload-digest", "refers_to": "warc-refers-to"}
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST = "_manifest-"
FILE_BYTES = 256 << 20
SPLIT_BYTES = 64 << 20
HEAD = 4096


def _open_fs(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri("file://" + uri.removeprefix("file:") if uri.startswith("file:/") and not uri.startswith("file://") else uri)


def _line(name: str, value: str) -> bytes:
    """A header line; line ends within the value, which no valid URL has, are percent-encoded."""
    return f"{name}: {value.replace(chr(13), '%0D').replace(chr(10), '%0A')}\r\n".encode()


def record(kind: str, headers: list[tuple[str, str]], block: bytes) -> bytes:
    head = b"".join(_line(k, v) for k, v in [("WARC-Type", kind), *headers, ("Content-Length", str(len(block)))])
    return b"".join((b"WARC/1.1\r\n", head, b"\r\n", block, b"\r\n\r\n"))


def member(data: bytes, level: int) -> bytes:
    """One gzip member; its extra field holds its own length and that of `data` (0: over 4 GB)."""
    deflate = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = deflate.compress(data) + deflate.flush()
    total = 24 + len(body) + 8
    sizes = (total, len(data)) if max(total, len(data)) < 1 << 32 else (0, 0)
    head = b"\x1f\x8b\x08\x04" + b"\0" * 5 + b"\xff" + struct.pack("<H2sHII", 12, b"sl", 8, *sizes)
    return head + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


class _Committed(WriterCommitMessage):
    def __init__(self, files: list[tuple[str, int]]):
        self.files = files


class WarcWriter(DataSourceArrowWriter):
    """Input columns: page_id, url, payload, payload_digest, record_type, refers_to (by name, any order)."""

    def __init__(self, options: dict, overwrite: bool):
        self.path = options["path"].rstrip("/")
        self.level = int(options.get("level", "1")) if options.get("compression", "gzip") == "gzip" else None
        self.file_bytes = int(options.get("file_bytes", FILE_BYTES))
        self.date = options.get("date", "1970-01-01T00:00:00Z")
        self.overwrite = overwrite

    def _record(self, page_id, url, payload, digest, kind, refers_to) -> bytes:
        payload = payload or b""
        http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
        headers = [("WARC-Record-ID", _urn(page_id)), ("WARC-Date", self.date), ("WARC-Payload-Digest", f"sha1:{digest}"), ("Content-Type", "application/http;msgtype=response")]
        if url is not None:
            headers.insert(2, ("WARC-Target-URI", url))
        if kind == "revisit":
            headers += [("WARC-Profile", PROFILE), ("WARC-Refers-To", _urn(refers_to))]
        return record(kind, headers, http if kind == "revisit" else http + payload)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        fs, root = _open_fs(self.path)
        fs.create_dir(root, recursive=True)
        files, out, n = [], None, 0
        for batch in iterator:
            at = {c: batch.column(i) for i, c in enumerate(batch.schema.names)}
            for i in range(batch.num_rows):
                if out is None:
                    name = f"part-{uuid.uuid4().hex}.warc{'' if self.level is None else '.gz'}"
                    out, n = fs.open_output_stream(f"{root}/{name}", compression=None), 0
                data = self._record(*(at[c][i].as_py() for c in ("page_id", "url", "payload", "payload_digest", "record_type", "refers_to")))
                data = data if self.level is None else member(data, self.level)
                out.write(data)
                n += len(data)
                if n >= self.file_bytes:
                    out.close()
                    files, out = [*files, (name, n)], None
        if out is not None:
            out.close()
            files.append((name, n))
        return _Committed(files)

    def commit(self, messages) -> None:
        fs, root = _open_fs(self.path)
        fs.create_dir(root, recursive=True)
        old = [x.path for x in fs.get_file_info(pafs.FileSelector(root)) if x.base_name.startswith(MANIFEST)]
        with fs.open_output_stream(f"{root}/{MANIFEST}{uuid.uuid4().hex}.json") as out:
            out.write(json.dumps([f for m in messages if m for f in m.files]).encode())
        if self.overwrite:
            for x in old:
                fs.delete_file(x)


def _urn(page_id) -> str:
    return "<urn:x-no-page>" if page_id is None else f"<urn:x-page:{quote(str(page_id), safe='')}>"


class _Files(InputPartition):
    def __init__(self, files: list[str]):
        super().__init__(files)


class WarcReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"].rstrip("/")
        self.payload = options.get("payload", "true") == "true"
        self.split = int(options.get("split_bytes", SPLIT_BYTES))
        self.tests: list[tuple[str, frozenset | None]] = []

    def pushFilters(self, filters):  # noqa: N802
        for f in filters:
            name = f.attribute[0] if isinstance(f, (EqualTo, In, IsNotNull)) and len(f.attribute) == 1 else None
            if name == "payload_bytes" and isinstance(f, IsNotNull):  # it never is
                continue
            if name not in HEADERS:
                yield f
            else:
                self.tests.append((name, None if isinstance(f, IsNotNull) else frozenset([f.value] if isinstance(f, EqualTo) else f.value)))

    def _listed(self) -> list[tuple[str, int]]:
        fs, root = _open_fs(self.path)
        info = fs.get_file_info(root)
        if info.type == pafs.FileType.File:
            return [(root, info.size)]
        found = {x.base_name: x for x in fs.get_file_info(pafs.FileSelector(root))}
        manifests = [x for n, x in found.items() if n.startswith(MANIFEST)]
        if not manifests:
            return sorted((x.path, x.size) for n, x in found.items() if n.endswith((".warc", ".warc.gz")))
        files = []
        for x in manifests:
            with fs.open_input_stream(x.path) as f:
                files += [(f"{root}/{name}", n) for name, n in json.loads(f.read())]
        return sorted(files)

    def partitions(self):
        parts, own, total = [], [], 0
        for path, n in self._listed():
            if own and total + n > self.split:
                parts, own, total = [*parts, _Files(own)], [], 0
            own, total = [*own, path], total + n
        return [*parts, _Files(own)] if own else parts or [_Files([])]

    def read(self, partition):
        fs, _ = _open_fs(self.path)
        rows, held = [], 0
        for path in partition.value:
            with fs.open_input_file(path) as f:
                for row in self._records((_Zipped if path.endswith(".gz") else _Plain)(_Buffer(f))):
                    rows.append(row)
                    held += len(row[-1] or b"")
                    if len(rows) >= 2000 or held > 8 << 20:
                        yield _batch(rows)
                        rows, held = [], 0
        if rows:
            yield _batch(rows)

    def _records(self, source: "_Plain | _Zipped"):
        while source.another():
            head = source.until(b"\r\n\r\n")
            lines = head.decode("utf-8", "replace").split("\r\n")
            headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:] if x)}
            length = int(headers.get("content-length", 0))
            own = {c: headers.get(h) for c, h in HEADERS.items()}
            if not all(own[c] is not None if among is None else own[c] in among for c, among in self.tests):
                source.skip(length)
                continue
            payload = None
            if headers.get("content-type", "").startswith("application/http"):
                http = source.until(b"\r\n\r\n", length)
                said = [x.partition(b":")[2] for x in http.split(b"\r\n") if x[:15].lower() == b"content-length:"]
                left = length - len(http) - 4
                size = int(said[0]) if own["record_type"] == "revisit" and said else left
            else:
                left = length
                size = length
            if self.payload and own["record_type"] != "revisit":
                payload = source.read(left)
            else:
                source.skip(left)
            yield (*own.values(), size, payload)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    names = [*HEADERS, "payload_bytes", "payload"]
    kinds = [*[pa.string()] * len(HEADERS), pa.int64(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)


class _Buffer:
    """Sequential reads in large pieces; a long skip seeks."""

    def __init__(self, f, piece: int = 1 << 20):
        self.f, self.piece, self.data, self.at, self.size = f, piece, b"", 0, f.size()

    def peek(self, n: int) -> bytes:
        if len(self.data) - self.at < n:
            self.data, self.at = self.data[self.at :] + self.f.read(max(n, self.piece)), 0
        return self.data[self.at : self.at + n]

    def read(self, n: int) -> bytes:
        out = self.peek(n)
        self.at += len(out)
        return out

    def skip(self, n: int) -> None:
        have = len(self.data) - self.at
        if n <= have:
            self.at += n
            return
        end = self.f.tell() + n - have
        if end > self.size:
            raise ValueError("an archive ends inside a record")
        self.f.seek(end)
        self.data, self.at = b"", 0

    def give_back(self, data: bytes) -> None:
        self.data, self.at = data + self.data[self.at :], 0


class _Plain:
    """Uncompressed records."""

    def __init__(self, f: _Buffer):
        self.f = f

    def another(self) -> bool:
        while self.f.peek(2) == b"\r\n":
            self.f.skip(2)
        return bool(self.f.peek(1))

    def until(self, mark: bytes, most: int | None = None) -> bytes:
        n = HEAD
        while True:
            seen = self.f.peek(n if most is None else min(n, most))
            at = seen.find(mark)
            if at >= 0:
                self.f.skip(at + len(mark))
                return seen[:at]
            if len(seen) < n:
                raise ValueError("a WARC header has no end")
            n *= 2

    def read(self, n: int) -> bytes:
        out = self.f.read(n)
        if len(out) < n:
            raise ValueError("an archive ends inside a record")
        return out

    def skip(self, n: int) -> None:
        self.f.skip(n)


class _Zipped:
    """Records in gzip members, one or several a member, or one over several members."""

    def __init__(self, f: _Buffer):
        self.f, self.z, self.data = f, None, b""

    def _open(self) -> bool:
        """The next member, if there is one; `left`: its compressed bytes that aren't read yet, `size`: of its data, if noted."""
        head = self.f.peek(24)
        if not head:
            return False
        if head[:3] != b"\x1f\x8b\x08":
            raise ValueError("not a gzip member")
        self.left = self.size = None
        if head[3] == 4 and head[12:14] == b"sl":
            total, size = struct.unpack("<II", head[16:24])
            at = 24
            if total:
                self.left, self.size = total - 24, size
        else:
            flags, at = head[3], 10
            data = self.f.peek(1 << 17)
            if flags & 4:
                at += 2 + struct.unpack("<H", data[at : at + 2])[0]
            for flag in (8, 16):
                if flags & flag:
                    at = data.index(b"\0", at) + 1
            at += 2 * bool(flags & 2)
        self.f.skip(at)
        self.z, self.z_read, self.made, self.crc = zlib.decompressobj(-15), 0, 0, 0
        return True

    def _close(self) -> None:
        """Past the end of an inflated member, whose checksum and length must be those of its data."""
        self.f.give_back(self.z.unused_data)
        end = self.f.read(8)
        if len(end) < 8 or struct.unpack("<II", end) != (self.crc, self.made & 0xFFFFFFFF):
            raise ValueError("a gzip member's data isn't what its checksum says")
        self.z = None

    def _more(self, want: int) -> bool:
        """Inflates until `want` bytes are there; False at the end of the file."""
        made, have = [self.data], len(self.data)
        while have < want:
            if self.z is None and not self._open():
                break
            piece = self.z.unconsumed_tail
            if not piece:
                piece = self.f.read(HEAD if want <= HEAD else 1 << 16)
                self.z_read += len(piece)
            if not piece:
                raise ValueError("a gzip member has no end")
            new = self.z.decompress(piece, max(want - have, HEAD))
            self.crc, self.made = zlib.crc32(new, self.crc), self.made + len(new)
            made.append(new)
            have += len(new)
            if self.z.eof:
                self._close()
        self.data = b"".join(made)
        return have >= want

    def another(self) -> bool:
        while self._more(2) and self.data[:2] == b"\r\n":
            self.data = self.data[2:]
        return bool(self.data)

    def until(self, mark: bytes, most: int | None = None) -> bytes:
        while (at := self.data.find(mark)) < 0:
            if not self._more(len(self.data) + 1):
                raise ValueError("a WARC header has no end")
        out, self.data = self.data[:at], self.data[at + len(mark) :]
        return out

    def read(self, n: int) -> bytes:
        if not self._more(n):
            raise ValueError("an archive ends inside a record")
        out, self.data = self.data[:n], self.data[n:]
        return out

    def skip(self, n: int) -> None:
        """Past `n` bytes; the rest of a member that holds nothing else (a record ends in two line ends) isn't inflated."""
        if self.z is not None and self.left is not None and n > len(self.data):
            inside = self.made - len(self.data) + n
            if self.made >= len(self.data) and self.size - 4 <= inside <= self.size:
                tail = self.z.unconsumed_tail
                read = self.z_read
                self.f.give_back(tail)
                self.f.skip(self.left - (read - len(tail)))
                self.z, self.data = None, b""
                return
        while n > len(self.data):
            n -= len(self.data)
            self.data = b""
            if not self._more(min(n, 1 << 16)):
                raise ValueError("an archive ends inside a record")
        self.data = self.data[n:]


class WarcDataSource(DataSource):
    """Format "warc". Read options: payload (true), split_bytes. Write options: compression (gzip, none), level, file_bytes, date."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return READ_SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return WarcReader(self.options)

    def writer(self, schema: StructType, overwrite: bool):
        return WarcWriter(self.options, overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(WarcDataSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def read_warc(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """Records of archives. The filter that is always there has Spark ask the reader anew for each plan; a plan without
    filters would take what the last one with filters planned."""
    register(spark)
    return spark.read.format("warc").options(**options).load(path).filter("payload_bytes is not null")


def base32_sha1(payload: bytes) -> str:
    import hashlib

    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _base32(hex40):
    """Base32 of a hexadecimal SHA-1, five bits a character, from 20-bit pieces (JVM only)."""
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    out = []
    for i in range(0, 40, 5):
        piece = F.conv(F.substring(hex40, i + 1, 5), 16, 10).cast("int")
        out += [F.substring(F.lit(letters), F.shiftright(piece, s).bitwiseAND(F.lit(31)) + 1, F.lit(1)) for s in (15, 10, 5, 0)]
    return F.concat(*out)


def deduplicated(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", min_bytes: int = 0) -> DataFrame:
    """The writer's rows: each page with its payload's digest, and a revisit where a smaller id has an equal payload."""
    base = own_columns(pages, page_id=page_id, url=url, html=html).select("page_id", "url", F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload")).select("*", F.sha2("payload", 256).alias("content"), F.octet_length("payload").alias("bytes"))
    slim = base.filter(F.col("bytes") >= min_bytes).select("page_id", F.col("content").alias("_content"), F.col("bytes").alias("_bytes"))
    shared = cut(slim.groupBy("_content", "_bytes").agg(F.count("*").alias("_n"), F.min("page_id").alias("_least")).filter("_n > 1"))
    joined = base.join(shared, (F.col("content") == F.col("_content")) & (F.col("bytes") == F.col("_bytes")), "left")
    revisit = F.coalesce(F.col("_least").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("_least")), F.lit(False)) & (F.col("bytes") >= min_bytes)
    return joined.select("page_id", "url", "payload", _base32(F.sha1("payload")).alias("payload_digest"), F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("_least")).alias("refers_to"))


def write_warc(pages: DataFrame, path: str, min_bytes: int = 0, **options: str) -> None:
    register(pages.sparkSession)
    deduplicated(pages, min_bytes=min_bytes).write.format("warc").mode("append").options(**options).save(path)


def round_trip(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Archives of all pages in the shared folder, read back whole: page_id, url, payload_bytes, payload_digest, record_type, refers_to.

    Length and digest of a response are those of the payload that was read, which must be as its header says; a revisit
    has no payload of its own, its headers say what it revisits.
    """
    spark = pages.sparkSession
    path = fresh_path(spark, "warc")
    write_warc(pages, path, min_bytes)
    kind = pages.schema["page_id"].dataType
    named = lambda c: F.when(F.col(c).startswith("<urn:x-page:"), F.url_decode(F.regexp_extract(c, r"^<urn:x-page:(.*)>$", 1)).cast(kind))
    said = F.substring("payload_digest", 6, 32)
    back = read_warc(spark, path).filter(F.col("record_type").isin("response", "revisit")).select("*", said.alias("said"), F.when(F.col("payload").isNull(), said).otherwise(_base32(F.sha1("payload"))).alias("found"))
    digest = F.when(F.col("found") == F.col("said"), F.col("found")).otherwise(F.raise_error(F.concat(F.lit("payload and digest differ in "), "record_id")))
    return back.select(named("record_id").alias("page_id"), F.col("target_uri").alias("url"), F.coalesce(F.octet_length("payload").cast("long"), "payload_bytes").alias("payload_bytes"), digest.alias("payload_digest"), "record_type", named("refers_to").alias("refers_to"))
