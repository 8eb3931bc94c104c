"""Legacy archives (ARC 1 and 2) and their conversion to WARC.

An ARC file opens with a version block: a `filedesc://` line, then a body that names
the version and the fields of each later record's header line. Version 1 lines hold
URL, IP, date, type and length; version 2 lines also result code, checksum, location,
offset and file name. The declared length alone says where a record ends.

Conversion makes of every record what WARC asks for: an identifier (a UUID of URL, date,
digest and page), a timestamp from the 14 (or 12, or 8) digits, a type (warcinfo for
the version block, response for HTTP, resource for all else) and payload digests.
Of records with equal payloads of at least `least` bytes, that with the smallest page
id is the response and the others revisit it, and name its identifier, URL and date.

Both kinds of archive are written by Spark's text writer, gzipped, into the shared folder
(the payload's bytes go through unchanged) and read back whole, file by file, as a stream
of inflated bytes. Records are gathered into rows of about ROW bytes, and a file ends
after `file_bytes`: empty rows fill it up to the writer's count of rows, so that no
file is longer than that and one record. Digests are checked when a response is read back.

Damaged parts are never passed over in silence. A line that is no header, however long, and a
record whose length goes past the end give one row with `error`; reading goes on at the
next line that is a header (its fields, an address, a date and a length), so the sound
records after it are kept. `errors` counts them; `convert` fails on the first one, unless
told to leave them out.

Null html is an empty payload. Null page ids are kept as null and never chosen as the
response if another is there; rows that repeat the smallest page id are responses too.
White space and control characters in a URL are percent-encoded; a null URL is `urn:none`.
Header lines have no greatest length. A payload is held whole, one at a time. An empty
table makes no archive. Other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import delete, fresh, read, stored

LEAST, DATE = 100, "20000101000000"
#: Bytes of a row of records, about; rows of a file at most; bytes of a file before compression, about.
ROW, PER_FILE, FILE_BYTES = 128 << 10, 1024, 128 << 20
FIELDS = {1: "URL IP-address Archive-date Content-type Archive-length", 2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length"}
#: Repeated digests up to this many (some 300 bytes each) are sent to every executor.
BROADCAST_DIGESTS = 100_000
_UNSAFE = re.compile(r"[\x00-\x20\x7f]")


def _rolled(batches: Iterator[pa.RecordBatch], sep: bytes, opening: bytes | None, per_file: int, file_bytes: int) -> Iterator[pa.RecordBatch]:
    """Records (a column of bytes) in rows, `per_file` of them a file; each file's first
    row starts with opening."""
    part: list[bytes] = []
    held = rows = written = 0

    def row() -> pa.RecordBatch:
        nonlocal held, rows, written
        out = [sep.join(part)]
        rows, written = rows + 1, written + held
        part.clear()
        held = 0
        if written >= file_bytes:
            out += [b""] * (per_file - rows)
            rows = per_file
        if rows == per_file:
            rows = written = 0
        return pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["record"])

    for batch in batches:
        for value in batch.column(0):
            if not part and not rows and opening:
                part.append(opening)
            record = value.as_py()
            part.append(record)
            held += len(record) + len(sep)
            if held >= ROW:
                yield row()
    if part:
        yield row()


def _write(records: DataFrame, path: str, sep: str, opening: bytes | None, per_file: int, file_bytes: int) -> None:
    """record (binary) as gzipped files; a partition's rows and the writer's files begin together."""
    rows = records.mapInArrow(lambda batches: _rolled(batches, sep.encode(), opening, per_file, file_bytes), "record binary")
    rows.select(F.col("record").cast("string")).write.option("lineSep", sep).option("maxRecordsPerFile", per_file).option("compression", "gzip").text(path)


def write_arc(pages: DataFrame, path: str, version: int = 1, per_file: int = PER_FILE, file_bytes: int = FILE_BYTES, date: str = DATE) -> None:
    """pages (page_id, url, html) as ARC files under path."""
    if version not in FIELDS:
        raise ValueError("version is 1 or 2")
    body = f"{version} 0 sightline\n{FIELDS[version]}\n".encode()
    opening = (f"filedesc://sightline.arc 0.0.0.0 {date} text/plain " + ("" if version == 1 else "200 - - 0 sightline.arc ")).encode() + b"%d\n" % len(body) + body

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for page, url, html in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                payload = (html or "").encode()
                head = b"HTTP/1.0 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n" + (b"" if page is None else b"X-Page-Id: %d\r\n" % page) + b"Content-Length: %d\r\n\r\n" % len(payload)
                where = _UNSAFE.sub(lambda m: f"%{ord(m[0]):02X}", url or "") or "urn:none"
                line = f"{where} 0.0.0.0 {date} text/html " + ("" if version == 1 else "200 - - 0 sightline.arc ")
                out.append(line.encode() + b"%d\n" % (len(head) + len(payload)) + head + payload)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["record"])

    kinds = pages.select(F.col("page_id").cast("long"), "url", "html")

    def both(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _rolled(run(batches), b"\n", opening, per_file, file_bytes)

    kinds.mapInArrow(both, "record binary").select(F.col("record").cast("string")).write.option("lineSep", "\n").option("maxRecordsPerFile", per_file).option("compression", "gzip").text(path)


class _Stream:
    """Inflated bytes of a gzip file (of one or many members) or plain ones, read in steps."""

    def __init__(self, data: bytes):
        self.data, self.at, self.held, self.seen = data, 0, bytearray(), 0
        self.inflate = zlib.decompressobj(31) if data[:2] == b"\x1f\x8b" else None

    def more(self) -> bool:
        if self.at >= len(self.data):
            return False
        part = self.data[self.at : self.at + (1 << 18)]
        self.at += len(part)
        if self.inflate is None:
            self.held += part
            return True
        try:
            self.held += self.inflate.decompress(part)
        except zlib.error:  # the rest can't be inflated: what was read stands, and the file ends here
            self.at = len(self.data)
            return False
        if self.inflate.eof:
            self.at -= len(self.inflate.unused_data)
            self.inflate = zlib.decompressobj(31)
        return True

    def until(self, mark: bytes) -> bytes | None:
        """The bytes before mark, which is read too; None if it doesn't come."""
        seen = 0
        while (at := self.held.find(mark, seen)) < 0:
            seen = max(0, len(self.held) - len(mark) + 1)
            if not self.more():
                return None
        return self.take(at + len(mark))[:at]

    def take(self, n: int) -> bytes | None:
        """n bytes, or None, and nothing read, if there are fewer."""
        while len(self.held) < n:
            if not self.more():
                return None
        out = bytes(self.held[:n])
        del self.held[:n]
        return out

    def rest(self) -> bytes:
        while self.more():
            pass
        return self.take(len(self.held))

    def skip(self, marks: bytes) -> bool:
        """Drops these bytes; whether any other follows."""
        run = re.compile(b"[" + marks + b"]*")
        while True:
            del self.held[: run.match(self.held).end()]
            if self.held:
                return True
            if not self.more():
                return False


_ADDRESS = re.compile(r"[0-9a-fA-F:.]+|-")


def _header_line(line: bytes, fields: list[str], after_damage: bool) -> dict | None:
    """The fields of a record's header line by name; None if it is none. After damage it also needs an address."""
    said = line.decode("utf-8", "replace").rstrip("\r")
    if said.startswith("filedesc://"):  # its line may have either version's fields; the length is last
        cells = said.split(" ")
        names = dict(zip(FIELDS[1 if len(cells) <= 5 else 2].lower().split(), cells, strict=False))
    else:  # a URL may hold spaces: fields are told from the right
        cells = said.rsplit(" ", len(fields) - 1)
        names = dict(zip([f.lower() for f in fields], cells, strict=False))
    if len(cells) < 5 or not re.fullmatch(r"\d{1,18}", names.get("archive-length", "")):
        return None
    sound = re.fullmatch(r"\d{8,14}", names.get("archive-date", "")) and (not after_damage or _ADDRESS.fullmatch(names.get("ip-address", "")))
    return names if sound else None


def parse_arc(data: bytes) -> Iterator[dict]:
    """The records of one ARC file: version, url, ip, date, mime, block, opening, or error."""
    s, fields, version, lost = _Stream(data), FIELDS[1].split(), 1, None
    while s.skip(b"\n\r"):
        line = s.until(b"\n")
        line = s.rest() if line is None else line
        names = _header_line(line, fields, lost is not None)
        if names is None:
            if lost is None:
                lost = {"version": version, "error": f"bad header line: {line[:200].decode('utf-8', 'replace')}"}
            continue
        block = s.take(int(names["archive-length"]))
        if lost is not None:
            yield lost
            lost = None
        if block is None:
            lost = {"version": version, "url": names.get("url"), "error": f"the declared length goes past the end: {line[:200].decode('utf-8', 'replace')}"}
            continue
        opening = line.startswith(b"filedesc://")
        if opening:
            said = block.decode("utf-8", "replace").splitlines()
            version = 2 if said and said[0].startswith("2") else 1
            fields = said[1].split() if len(said) > 1 and said[1].strip() else FIELDS[version].split()
        yield {"version": version, "url": names.get("url"), "ip": names.get("ip-address"), "date": names.get("archive-date"), "mime": names.get("content-type"), "block": block, "opening": opening}
    if lost is not None:
        yield lost


def _http(block: bytes) -> tuple[bytes, bytes]:
    """(headers with their empty line, payload); no headers if the block isn't HTTP."""
    if not block.startswith(b"HTTP/"):
        return b"", block
    for mark in (b"\r\n\r\n", b"\n\n"):
        if (at := block.find(mark)) >= 0:
            return block[: at + len(mark)], block[at + len(mark) :]
    return block, b""


def _header(head: bytes, name: bytes) -> bytes | None:
    m = re.search(rb"(?im)^" + re.escape(name) + rb":[ \t]*([^\r\n]*)", head)
    return m and m[1]


def read_arc(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """The records of all ARC files under path: version, url, date, kind (warcinfo, response,
    resource; null for a damaged part), page_id, payload_bytes, payload_digest, head, payload (null
    without payloads), error."""
    import hashlib

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("version", pa.int32()), ("url", pa.string()), ("date", pa.string()), ("kind", pa.string()), ("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("head", pa.binary()), ("payload", pa.binary()), ("error", pa.string())])
        for batch in batches:
            for i in range(batch.num_rows):
                out, size = [], 0
                for r in parse_arc(batch.column(0)[i].as_py()):
                    head, payload = _http(r.get("block") or b"")
                    page = _header(head, b"X-Page-Id")
                    kind = None if "error" in r else "warcinfo" if r["opening"] else "response" if head else "resource"
                    out.append((r["version"], r.get("url"), r.get("date"), kind, int(page) if page else None, len(payload), hashlib.sha256(payload).hexdigest(), head if payloads else None, payload if payloads else None, r.get("error")))
                    size += len(payload) * payloads
                    if len(out) >= 5000 or size > 8 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
                        out, size = [], 0
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt*").load(path).select("content")
    return files.mapInArrow(run, "version int, url string, date string, kind string, page_id long, payload_bytes long, payload_digest string, head binary, payload binary, error string")


def _uuid(hexes: Column) -> Column:
    cut = lambda a, n: F.substring(hexes, a, n)
    return F.concat(F.lit("<urn:uuid:"), cut(1, 8), F.lit("-"), cut(9, 4), F.lit("-5"), cut(14, 3), F.lit("-a"), cut(18, 3), F.lit("-"), cut(21, 12), F.lit(">"))


def _identity(page: Column, url: Column, date: Column) -> Column:
    return _uuid(F.sha2(F.concat_ws("|", url, date, "payload_digest", F.coalesce(page.cast("string"), F.lit("-"))).cast("binary"), 256))


def errors(records: DataFrame) -> DataFrame:
    """How often each damage was met: error, n."""
    return records.where(F.col("error").isNotNull()).groupBy("error").agg(F.count(F.lit(1)).alias("n"))


def convert(records: DataFrame, again: DataFrame, least: int = LEAST, skip_errors: bool = False) -> DataFrame:
    """record: WARC records, without the blank lines that end them. again: as records, without
    payloads. Damaged parts fail the job, unless skip_errors leaves them out (see `errors`)."""
    sound = again.where((F.col("payload_bytes") >= least) & F.col("error").isNull() & (F.col("kind") != "warcinfo"))
    # the smallest page id, nulls last; its row names what revisits refer to
    held = F.min(F.struct(F.col("page_id").isNull().alias("none"), "page_id", "url", "date")).alias("r")
    first = sound.groupBy("payload_digest").agg(held, F.count(F.lit(1)).alias("n")).where("n > 1")
    first = stored(first.select("payload_digest", F.col("r.page_id").alias("first"), F.col("r.url").alias("first_url"), F.col("r.date").alias("first_date")), "repeated-payloads")
    if first.count() <= BROADCAST_DIGESTS:  # then no payload moves; beyond, payloads are joined by digest
        first = F.broadcast(first)
    if skip_errors:
        records = records.where(F.col("error").isNull())
    else:
        records = records.withColumn("url", F.when(F.col("error").isNotNull(), F.raise_error(F.concat(F.lit("damaged archive: "), "error")).cast("string")).otherwise(F.col("url")))
    d = records.join(first, "payload_digest", "left")
    revisit = F.coalesce((F.col("page_id") != F.col("first")) | (F.col("page_id").isNull() & F.col("first").isNotNull()), F.lit(False)) & (F.col("payload_bytes") >= least) & (F.col("kind") != "warcinfo")
    block = F.when(F.col("revisit"), F.col("head")).otherwise(F.concat("head", "payload"))
    line = lambda name, value: F.concat(F.lit(f"\r\n{name}: "), value.cast("string"))
    date = lambda c: F.regexp_replace(F.rpad(c, 14, "0"), r"^(\d{4})(\d\d)(\d\d)(\d\d)(\d\d)(\d\d).*$", "$1-$2-$3T$4:$5:$6Z")
    kind = F.when(F.col("revisit"), "revisit").otherwise(F.col("kind"))
    seen_before = F.concat(
        line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.0/revisit/identical-payload-digest")),
        line("WARC-Refers-To", _identity(F.col("first"), F.col("first_url"), F.col("first_date"))),
        line("WARC-Refers-To-Target-URI", F.col("first_url")),
        line("WARC-Refers-To-Date", date(F.col("first_date"))),
        line("X-Payload-Length", F.col("payload_bytes")),
        line("X-Refers-To-Page-Id", F.col("first")),
    )
    head = F.concat(
        F.lit("WARC/1.0"),
        line("WARC-Type", kind),
        line("WARC-Record-ID", _identity(F.col("page_id"), F.col("url"), F.col("date"))),
        line("WARC-Date", date(F.col("date"))),
        F.when(F.col("kind") == "warcinfo", line("WARC-Filename", F.regexp_replace("url", "^filedesc://", ""))).otherwise(line("WARC-Target-URI", F.col("url"))),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), "payload_digest")),
        F.when(F.col("page_id").isNotNull(), line("X-Page-Id", F.col("page_id"))).otherwise(""),
        F.when(F.col("revisit"), seen_before).otherwise(""),
        line("Content-Type", F.when(F.col("kind") == "response", "application/http; msgtype=response").when(F.col("kind") == "warcinfo", "text/plain").otherwise("application/octet-stream")),
        line("Content-Length", F.length("block")),
        F.lit("\r\n\r\n"),
    )
    d = d.withColumn("revisit", revisit).withColumn("block", block)
    return d.select(F.concat(head.cast("binary"), "block").alias("record"))


def write_warc(records: DataFrame, path: str, per_file: int = PER_FILE, file_bytes: int = FILE_BYTES) -> None:
    """record (binary) as .gz WARC files; the two blank lines after a record are the writer's line end."""
    _write(records, path, "\r\n\r\n", None, per_file, file_bytes)


def parse_warc(data: bytes) -> Iterator[tuple[bytes, bytes]]:
    """(header, block) of every record of one WARC file; raises on a damaged one."""
    s = _Stream(data)
    while s.skip(b"\r\n"):
        head = s.until(b"\r\n\r\n")
        length = head is not None and _header(head, b"Content-Length")
        if not length or not head.startswith(b"WARC/"):
            raise ValueError("not a WARC record")
        block = s.take(int(length))
        if block is None:
            raise ValueError("the record is cut short")
        yield head, block


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, record_id, url,
    warc_date, refers_to_id of every record; one whose payload doesn't have its digest fails the job."""
    import hashlib

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("record_id", pa.string()), ("url", pa.string()), ("warc_date", pa.string()), ("refers_to_id", pa.string())])
        for batch in batches:
            for i in range(batch.num_rows):
                out = []
                for head, block in parse_warc(batch.column(0)[i].as_py()):
                    get = lambda name, h=head: (v := _header(h, name)) and v.decode("utf-8", "replace")
                    payload, digest, kind = _http(block)[1], get(b"WARC-Payload-Digest").removeprefix("sha256:"), get(b"WARC-Type")
                    if kind != "revisit" and hashlib.sha256(payload).hexdigest() != digest:
                        raise ValueError(f"payload of {get(b'WARC-Record-ID')} doesn't have its digest")
                    page, first = get(b"X-Page-Id"), get(b"X-Refers-To-Page-Id")
                    out.append((int(page) if page else None, int(get(b"X-Payload-Length")) if kind == "revisit" else len(payload), digest, kind, int(first) if first else None, get(b"WARC-Record-ID"), get(b"WARC-Target-URI"), get(b"WARC-Date"), get(b"WARC-Refers-To")))
                    if len(out) >= 20_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
                        out = []
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt*").load(path).select("content")
    return files.mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, record_id string, url string, warc_date string, refers_to_id string")


def op2(spark, sf_dir: str) -> DataFrame:
    arc, warc = fresh(spark, "arc"), fresh(spark, "warc")
    write_arc(read(spark, sf_dir, "pages").select("page_id", "url", "html"), arc)
    write_warc(convert(read_arc(spark, arc), read_arc(spark, arc, payloads=False)), warc)
    delete(spark, arc)
    return read_warc(spark, warc).where("record_type <> 'warcinfo'")


OP2_SQL = """
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END AS refers_to
FROM (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest,
  min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first FROM pages)
"""
