"""WARC archives as a Python data source: planned by byte ranges, filtered on headers, payloads decoded only where wanted.

    spark.dataSource.register(WarcSource)
    spark.read.format("warc").load(folder).where("record_type = 'response'")
    records.write.format("warc").mode("append").save(folder)

Options: payload (true), verify (true), split_bytes (64 MiB) for reading; compression (gzip or none), level (6),
max_file_bytes (1 GiB) for writing. Paths are those pyarrow opens (local and file:, hdfs:, s3:, gs:).
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
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as afs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, IsNotNull, StringStartsWith, WriterCommitMessage

from panelspark.llm import common

SCHEMA = (
    "record_id string, record_type string, target_uri string, date string, content_type string, payload_digest string, "
    "refers_to string, payload_bytes long, payload binary, headers map<string,string>"
)
#: Column of a header, and whether its value stands in angle brackets.
_HEADERS = {
    "record_id": ("WARC-Record-ID", True), "record_type": ("WARC-Type", False), "target_uri": ("WARC-Target-URI", False), "date": ("WARC-Date", False),
    "payload_digest": ("WARC-Payload-Digest", False), "refers_to": ("WARC-Refers-To", True),
}
_TEXTS = ["record_id", "record_type", "target_uri", "date", "content_type", "payload_digest", "refers_to"]
_LENGTH = "X-Payload-Length"  # an extension header: a revisit tells the size of the payload it leaves out
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_INDEX_BYTES = 1 << 20
_EXTRA = b"sl"  # gzip extra field with the lengths of the member and of its content: a reader steps over it unread


def _files(path: str) -> tuple[afs.FileSystem, str]:
    found, inner = afs.FileSystem.from_uri(path)
    return found, inner.rstrip("/")


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


# --- writing -------------------------------------------------------------------------------------------------------


def record_bytes(headers: list[tuple[str, str | None]], block: bytes) -> bytes:
    """One record. Line ends inside a value would open a new header, so they are percent-encoded."""
    lines = ["WARC/1.1"] + [f"{k}: {v}".replace("\r", "%0D").replace("\n", "%0A") for k, v in headers if v is not None]
    return "\r\n".join([*lines, f"Content-Length: {len(block)}", "", ""]).encode() + block + b"\r\n\r\n"


def member(content: bytes, level: int = 6) -> bytes:
    """content as one gzip member whose extra field holds both lengths."""
    packed = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = packed.compress(content) + packed.flush()
    head = b"\x1f\x8b\x08\x04" + bytes(5) + b"\xff" + struct.pack("<H2sH", 20, _EXTRA, 16)
    size = len(head) + 16 + len(body) + 8
    return head + struct.pack("<QQ", size, len(content)) + body + struct.pack("<II", zlib.crc32(content), len(content) & 0xFFFFFFFF)


def _row_record(row: dict) -> bytes:
    revisit = row["record_type"] == "revisit"
    payload = None if revisit else row["payload"] or b""
    size = row["payload_bytes"] if payload is None else len(payload)
    headers = [(name, (f"<{row[c]}>" if angled else row[c]) if row[c] is not None else None) for c, (name, angled) in _HEADERS.items() if c != "payload_digest"]
    digest = row["payload_digest"] or (None if payload is None else sha1_base32(payload))
    headers += [("WARC-Payload-Digest", digest and f"sha1:{digest}"), (_LENGTH, None if size is None else str(size))]
    if revisit:
        headers.append(("WARC-Profile", _PROFILE))
    if not (revisit or row["record_type"] == "response"):
        return record_bytes([*headers, ("Content-Type", row["content_type"])], payload)
    kind = (row["content_type"] or "application/octet-stream").replace("\r", " ").replace("\n", " ")
    http = f"HTTP/1.1 200 OK\r\nContent-Type: {kind}\r\nContent-Length: {size or 0}\r\n\r\n".encode()
    return record_bytes([*headers, ("Content-Type", "application/http; msgtype=response")], http + (payload or b""))


@dataclass
class _Written(WriterCommitMessage):
    files: list


class WarcWriter(DataSourceArrowWriter):
    """Each task writes files of its own name; the driver's commit lists those of the tasks that count in one manifest.

    Files of failed or repeated tasks are in no manifest, so readers never see them. Beside each file stands an index with the
    offsets of records at least 1 MiB apart, at which a reader can begin.
    """

    def __init__(self, options: dict, overwrite: bool):
        self.path, self.overwrite, self.job = options["path"], overwrite, uuid.uuid4().hex
        self.packed = options.get("compression", "gzip") == "gzip"
        self.level, self.most = int(options.get("level", 6)), int(options.get("max_file_bytes", 1 << 30))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        files, folder = _files(self.path)
        files.create_dir(folder, recursive=True)
        done, out, name, at, marks = [], None, "", 0, []

        def close() -> None:
            out.close()
            with files.open_output_stream(f"{folder}/{name}.idx") as index:
                index.write(struct.pack(f"<{len(marks)}Q", *marks))
            done.append((name, at))

        for batch in iterator:
            for a in range(0, batch.num_rows, 64):
                for row in batch.slice(a, 64).to_pylist():
                    if out is not None and at >= self.most:
                        close()
                        out = None
                    if out is None:
                        name, at, marks = f"{self.job}-{uuid.uuid4().hex}.warc{'.gz' if self.packed else ''}", 0, []
                        out = files.open_output_stream(f"{folder}/{name}", compression=None)
                        info = [("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", row["date"]), ("Content-Type", "application/warc-fields")]
                        at += self._put(out, record_bytes(info, b"format: WARC File Format 1.1\r\n"))
                    if not marks or at - marks[-1] >= _INDEX_BYTES:
                        marks.append(at if marks else 0)
                    at += self._put(out, _row_record(row))
        if out is not None:
            close()
        return _Written(done)

    def _put(self, out, content: bytes) -> int:
        made = member(content, self.level) if self.packed else content
        out.write(made)
        return len(made)

    def commit(self, messages: list) -> None:
        files, folder = _files(self.path)
        files.create_dir(folder, recursive=True)
        old = [f.path for f in files.get_file_info(afs.FileSelector(folder)) if f.base_name.startswith("_manifest-")] if self.overwrite else []
        listed = [f for m in messages if m is not None for f in m.files]
        with files.open_output_stream(f"{folder}/_manifest-{self.job}.json") as out:
            out.write(json.dumps({"files": listed}).encode())
        for path in old:  # the new rows count from here on, then the old ones go
            names = json.loads(files.open_input_stream(path).readall())["files"]
            files.delete_file(path)
            _remove(files, folder, names)

    def abort(self, messages: list) -> None:
        files, folder = _files(self.path)
        _remove(files, folder, [f for m in messages if m is not None for f in m.files])


def _remove(files: afs.FileSystem, folder: str, listed: list) -> None:
    for name, _ in listed:
        files.delete_file(f"{folder}/{name}")
        files.delete_file(f"{folder}/{name}.idx")


# --- reading -------------------------------------------------------------------------------------------------------


def parse_headers(raw: bytes) -> dict[str, str]:
    """Header lines after the version line; folded lines are joined, of a repeated header the last value counts."""
    lines = raw.decode("utf-8", "replace").replace("\r\n", "\n").split("\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
    out, name = {}, None
    for line in lines[1:]:
        if line[:1] in (" ", "\t") and name:
            out[name] += " " + line.strip()
        elif ":" in line:
            name, value = line.split(":", 1)
            name = name.strip()
            out[name] = value.strip()
    return out


class Record:
    """Headers of a record and a way to its block, which is read only when asked for."""

    def __init__(self, raw: bytes, block):
        self.headers = parse_headers(raw)
        self._lower = {k.lower(): v for k, v in self.headers.items()}
        self.size = int(self._lower["content-length"])
        self.block = block

    def get(self, name: str) -> str | None:
        return self._lower.get(name.lower())

    def column(self, name: str) -> str | None:
        header, angled = _HEADERS[name]
        value = self.get(header)
        if value is None:
            return None
        return value.strip("<>") if angled else value.removeprefix("sha1:") if name == "payload_digest" else value


def _dechunked(body: bytes) -> bytes:
    parts, at = [], 0
    while (end := body.find(b"\r\n", at)) >= 0 and (size := int(body[at:end].split(b";")[0], 16)):
        parts.append(body[end + 2 : end + 2 + size])
        at = end + 4 + size
    return b"".join(parts)


def payload_of(record: Record, block: bytes) -> tuple[str | None, bytes]:
    """(content type, payload): the body of an HTTP message without its chunk marks, else the block."""
    kind = record.get("Content-Type")
    if not (kind or "").lower().startswith("application/http"):
        return kind, block
    head, _, body = block.partition(b"\r\n\r\n")
    http = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode("utf-8", "replace").split("\r\n")[1:])}
    return http.get("content-type"), _dechunked(body) if http.get("transfer-encoding", "").lower() == "chunked" else body


class _Window:
    """Reads of a file through one window that moves forward; what is stepped over is not read."""

    def __init__(self, f):
        self.f, self.base, self.buf = f, 0, b""

    def get(self, at: int, size: int) -> bytes:
        if at < self.base or at + size > self.base + len(self.buf):
            self.f.seek(at)
            self.base, self.buf = at, self.f.read(max(size, 1 << 18))
        return self.buf[at - self.base : at - self.base + size]


def _sized_members(f, start: int, end: int) -> Iterator[Record]:
    """Records of gzip members that tell their length: the headers are inflated alone, the rest when the block is asked for."""
    window, at = _Window(f), start
    while at < end:
        head = window.get(at, 32)
        if len(head) < 32 or head[:4] != b"\x1f\x8b\x08\x04" or head[12:14] != _EXTRA:
            raise ValueError(f"no record at byte {at}")
        size, content = struct.unpack_from("<QQ", head, 16)
        first = window.get(at + 32, min(size - 32, 1 << 14))
        inflate = zlib.decompressobj(-15)
        raw, given = inflate.decompress(first, 2048), len(first)
        while (stop := raw.find(b"\r\n\r\n")) < 0:
            if len(raw) >= content:
                raise ValueError(f"no header end in the record at byte {at}")
            more = inflate.unconsumed_tail or window.get(at + 32 + given, min(size - 32 - given, 1 << 16))
            given += 0 if inflate.unconsumed_tail else len(more)
            raw += inflate.decompress(more, 1 << 16)

        def block(at=at, size=size, inflate=inflate, raw=raw, given=given, begin=stop + 4) -> bytes:
            whole = raw + inflate.decompress(inflate.unconsumed_tail) + inflate.decompress(window.get(at + 32 + given, size - 32 - given)) + inflate.flush()
            if zlib.crc32(whole) != struct.unpack("<I", window.get(at + size - 8, 4))[0]:
                raise ValueError(f"checksum of the record at byte {at} differs")
            return whole[begin:-4]

        yield Record(raw[:stop], block)
        at += size


def _streamed(stream, start: int, end: int | None) -> Iterator[Record]:
    """Records of a plain file, or of any gzip file as its content; a block that is not asked for is stepped over."""
    stream.seek(start)
    while end is None or stream.tell() < end:
        line = stream.readline()
        if not line:
            return
        if not line.strip():
            continue
        raw = [line]
        while (line := stream.readline()).strip():
            raw.append(line)
        begin = stream.tell()
        record = Record(b"".join(raw).rstrip(b"\r\n"), None)
        record.block = lambda: stream.read(record.size)  # noqa: B023  called before the next record
        yield record
        stream.seek(begin + record.size)


class WarcReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.payload = options.get("payload", "true").lower() == "true"
        self.verify = options.get("verify", "true").lower() == "true"
        self.split = int(options.get("split_bytes", 64 << 20))
        self.tests: list[tuple[str, str, object]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        """Takes =, in, is not null and starts-with on header columns; all else, and the digest once more, is left to Spark."""
        for f in filters:
            kind = {EqualTo: "=", In: "in", IsNotNull: "set", StringStartsWith: "starts"}.get(type(f))
            name = f.attribute[0] if kind and len(f.attribute) == 1 else None
            if name not in _HEADERS:
                yield f
                continue
            self.tests.append((name, kind, None if kind == "set" else f.value))
            if name == "payload_digest":
                yield f

    def wanted(self, record: Record) -> bool:
        for name, kind, value in self.tests:
            found = record.column(name)
            if found is None:
                if name == "payload_digest" and self.payload:
                    continue
                return False
            if not {"=": lambda: found == value, "in": lambda: found in value, "set": lambda: True, "starts": lambda: found.startswith(value)}[kind]():
                return False
        return True

    def partitions(self) -> list[InputPartition]:
        """Ranges of at most split_bytes, small files together. Files with an index are cut, others are read by one task each."""
        files, folder = _files(self.path)
        found = files.get_file_info(afs.FileSelector(folder, recursive=True)) if files.get_file_info(folder).type == afs.FileType.Directory else [files.get_file_info(folder)]
        manifests = [f.path for f in found if f.base_name.startswith("_manifest-")]
        if manifests:
            ranges = [(f"{folder}/{name}", size, True) for m in manifests for name, size in json.loads(files.open_input_stream(m).readall())["files"]]
        else:
            ranges = [(f.path, f.size, False) for f in found if f.base_name.endswith((".warc", ".warc.gz"))]
        out, held, size = [], [], 0
        for path, length, cut in sorted(ranges):
            step = self.split if cut else max(length, 1)
            for a in range(0, length, step):
                piece = min(step, length - a)
                if held and size + piece > self.split:
                    out.append(InputPartition(held))
                    held, size = [], 0
                held, size = [*held, (path, a, a + piece, cut)], size + piece
        return [*out, InputPartition(held)] if held else out

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        files, _ = _files(self.path)
        schema = pa.schema([*((c, pa.string()) for c in _TEXTS), ("payload_bytes", pa.int64()), ("payload", pa.binary()), ("headers", pa.map_(pa.string(), pa.string()))])
        rows, size = [], 0
        for path, start, end, cut in partition.value if partition is not None else []:
            try:
                for record in self._records(files, path, start, end, cut):
                    if self.wanted(record):
                        rows.append(self._row(record))
                        size += len(rows[-1]["payload"] or b"")
                        if len(rows) >= 2000 or size >= 4 << 20:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows, size = [], 0
            except (ValueError, KeyError, EOFError, OSError, zlib.error) as e:
                raise ValueError(f"{path}: {e}") from e
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)

    def _records(self, files: afs.FileSystem, path: str, start: int, end: int, cut: bool) -> Iterator[Record]:
        packed = path.endswith(".gz")
        if cut:  # records of the index groups that begin in this range
            raw = files.open_input_stream(f"{path}.idx").readall()
            marks = [*struct.unpack(f"<{len(raw) // 8}Q", raw), files.get_file_info(path).size]
            start, end = marks[bisect_left(marks, start)], marks[min(bisect_left(marks, end), len(marks) - 1)]
        with files.open_input_file(path) as f:
            if cut and packed:
                yield from _sized_members(f, start, end)
            else:
                yield from _streamed(gzip.GzipFile(fileobj=f) if packed else io.BufferedReader(f), start if cut else 0, end if cut else None)

    def _row(self, record: Record) -> dict:
        row = {c: record.column(c) for c in _HEADERS}
        told = record.get(_LENGTH)
        row |= {"content_type": record.get("Content-Type"), "payload": None, "payload_bytes": int(told) if told else None, "headers": list(record.headers.items())}
        if self.payload and row["record_type"] != "revisit":
            row["content_type"], payload = payload_of(record, record.block())
            row |= {"payload": payload, "payload_bytes": len(payload)}
            digest = sha1_base32(payload) if row["payload_digest"] is None or self.verify else row["payload_digest"]
            if self.verify and len(row["payload_digest"] or "") == 32 and digest != row["payload_digest"]:
                raise ValueError(f"payload digest of {row['record_id']} differs")
            row["payload_digest"] = row["payload_digest"] or digest
        return row


class WarcSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return WarcReader(self.options)

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options, overwrite)


def read_warc(spark: SparkSession, path: str, **options) -> DataFrame:
    """Records of all archives below a folder, or of one file, with the columns of SCHEMA.

    Filters on record_type, record_id, target_uri, date, refers_to and payload_digest reach the headers: a record that fails
    one is stepped over, its block neither inflated nor decoded. payload=False reads headers alone. A payload whose
    SHA-1 differs from its header, or a broken record, raises with the file's name. Turns filter pushdown into Python sources on for the session.
    """
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)
    return spark.read.format("warc").options(**{k: str(v) for k, v in options.items()}).load(path)


def write_warc(records: DataFrame, path: str, mode: str = "append", **options) -> None:
    """Records with the columns of SCHEMA but headers, which are made from the others. A revisit's payload is left out."""
    records.sparkSession.dataSource.register(WarcSource)
    writer = records.select(*SCHEMA_COLUMNS).write.format("warc").mode(mode).options(**{k: str(v) for k, v in options.items()})
    writer.save(path)


SCHEMA_COLUMNS = [*_TEXTS, "payload_bytes", "payload"]


def base32(sha1_hex: Column) -> Column:
    """The 40 hexadecimal digits of a SHA-1 as 32 base-32 characters, five digits to four."""
    parts = [F.lpad(F.conv(F.substring(sha1_hex, 1 + 5 * k, 5), 16, 32), 4, "0") for k in range(8)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def page_records(
    pages: DataFrame, id_col: str = "page_id", uri_col: str = "url", text_col: str = "html", min_bytes: int = 0, date: str = "1970-01-01T00:00:00Z"
) -> DataFrame:
    """A record per row: of equal payloads of min_bytes or more, that with the largest id is a response and the others revisit it.

    A missing text is an empty payload. A missing id is below all others, its record's id ends in a colon; rows that
    share a payload and the largest id are responses all. Payloads are equal if their SHA-1 and size are.
    Only payloads that repeat enter a join, which Spark broadcasts where they are few; payloads with more than a
    quarter of a partition's share of rows, of which there can be no more than four a partition, are always broadcast, so no
    task gets all copies of one.
    """
    body = F.encode(F.coalesce(F.col(text_col), F.lit("")), "utf-8")
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(uri_col).alias("target_uri"), body.alias("payload"))
    rows = rows.select("*", F.sha1("payload").alias("sha"), F.octet_length("payload").cast("long").alias("payload_bytes"))
    same = rows.where(F.col("payload_bytes") >= min_bytes).groupBy("sha", "payload_bytes").agg(F.max("id").alias("last"), F.count("*").alias("copies"))
    same = common.land(same.where("copies > 1 and last is not null"), "payloads")
    n = common.shuffle_partitions(pages.sparkSession)
    total = same.agg(F.sum("copies")).first()[0] or 0
    key = [F.col("sha").alias("key"), F.col("payload_bytes").alias("size")]
    often = F.col("copies") > max(1, total // (4 * n))
    hot = F.broadcast(same.where(often).select(*key, F.col("last").alias("hot")))
    cold = same.where(~often).select(*key, F.col("last").alias("cold"))
    found = rows.join(hot, (F.col("sha") == F.col("key")) & (F.col("payload_bytes") == F.col("size")), "left").drop("key", "size")
    spread = F.when(F.col("hot").isNull(), F.col("sha")).otherwise(F.concat(F.lit("-"), F.xxhash64("id", "target_uri").cast("string")))
    found = found.withColumn("spread", spread).join(cold, (F.col("spread") == F.col("key")) & (F.col("payload_bytes") == F.col("size")), "left")
    last = F.coalesce("hot", "cold")
    of = F.when(last.isNotNull() & ~F.col("id").eqNullSafe(last), last)
    name = lambda c: F.concat(F.lit("urn:page:"), F.coalesce(c.cast("string"), F.lit("")))
    return found.select(
        name(F.col("id")).alias("record_id"), F.when(of.isNull(), "response").otherwise("revisit").alias("record_type"), "target_uri",
        F.lit(date).alias("date"), F.lit("text/html; charset=utf-8").alias("content_type"), base32(F.col("sha")).alias("payload_digest"),
        F.when(of.isNotNull(), name(of)).alias("refers_to"), "payload_bytes", F.when(of.isNull(), F.col("payload")).alias("payload"),
    )


def op11_warc_archive(spark, sf_dir: str) -> DataFrame:
    folder = common.fresh_folder(spark, "warc")
    write_warc(page_records(common.table(spark, sf_dir, "pages")), folder)
    number = lambda c: F.expr(f"try_cast(substring({c}, 10) as bigint)")  # noqa: E731  after urn:page:
    records = read_warc(spark, folder).where(F.col("record_type").isin("response", "revisit"))
    return records.select(number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to").alias("refers_to"))


OP11_SQL = r"""
WITH p AS (
  SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS h,
    max(page_id) OVER (PARTITION BY sha1(coalesce(html, ''))) AS last
  FROM pages
)
SELECT page_id, payload_bytes,
  array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + ((('0x' || substr(h, i * 5 // 4 + 1, 2))::INT >> (3 - i * 5 % 4)) & 31), 1) FOR i IN range(32)], '') AS payload_digest,
  CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id < last THEN last END AS refers_to
FROM p
"""
