"""Legacy archives to WARC: ARC files of version 1 and 2 are read by their declared lengths and written anew.

An ARC file begins with a version block, which says the version and the fields of
the header lines. A header line has a URL (with spaces in old files), fields of
its version and, last, the length of the document that follows. The converter
makes WARC records of them: identifiers from place in the archive, timestamps
from 14 digits, types from what the document is, SHA-1 digests of the payload.
Of equal payloads one record stays a response, the others become revisits of it.

Files are gzip streams, written by Spark's text writer (each record ends with the
line end that the writer puts) and read whole by its binary reader, so that they
can lie in any store. Python reads one record after the other from a stream.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import MB, saved, scratch

# The fields of header lines, as the two versions of the format say them.
FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "20000101000000"
#: Payloads of fewer bytes are never revisits.
LEAST = 1000
#: A digest is heavy with more than one of so many records; there are at most so many heavy ones.
HEAVY = 1024


def new_path(spark: SparkSession, name: str) -> str:
    return f"{scratch(spark)}/{spark.range(1).select(F.uuid()).first()[0]}-{name}"


def _first_of_file() -> Column:
    """The first row of a task: what is written by one task is one file."""
    return F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1) == 0


def _bytes(c: Column) -> Column:
    return F.octet_length(c).cast("string")


# ------------------------------------------------------------------------ ARC
def arc_lines(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", captured: str = DATE) -> DataFrame:
    """(value): the pages as records of ARC files, as servers would have sent them. Tasks take turns with versions 1 and 2.

    A null or empty url is urn:page:<id>; white space in it is %20. A null html is an empty body.
    """
    body = F.coalesce(F.col(html).cast("string"), F.lit(""))
    where = F.coalesce(F.nullif(F.regexp_replace(F.col(url).cast("string"), r"[\x00-\x20]", "%20"), F.lit("")), F.concat(F.lit("urn:page:"), F.coalesce(F.col(key).cast("string"), F.lit("null"))))
    number = F.coalesce(F.concat(F.lit("X-Page-Id: "), F.col(key).cast("string"), F.lit("\r\n")), F.lit(""))
    sent = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), _bytes(body), F.lit("\r\n"), number, F.lit("\r\n"), body)
    rows = pages.select(where.alias("url"), sent.alias("document"), (F.spark_partition_id() % 2 + 1).alias("version"), F.spark_partition_id().cast("string").alias("file"), _first_of_file().alias("first"))
    file = F.concat(F.lit("pages-"), "file", F.lit(".arc"))
    line = {1: lambda u, mime, n: F.concat(u, F.lit(f" 0.0.0.0 {captured} {mime} "), n), 2: lambda u, mime, n: F.concat(u, F.lit(f" 0.0.0.0 {captured} {mime} 200 - - 0 "), file, F.lit(" "), n)}
    made = {}
    for v, said in line.items():
        block = F.lit(f"{v} 0 tallywood\n{FIELDS[v]}\n")
        head = F.concat(said(F.concat(F.lit("filedesc://"), file), "text/plain", _bytes(block)), F.lit("\n"), block, F.lit("\n"))
        made[v] = F.concat(F.when(F.col("first"), head).otherwise(""), said(F.col("url"), "text/html", _bytes(F.col("document"))), F.lit("\n"), F.col("document"))
    return rows.select(F.when(F.col("version") == 1, made[1]).otherwise(made[2]).alias("value"))


def write_lines(lines: DataFrame, path: str) -> str:
    """Write records, a gzip file for each task, and return the path. Level 4 takes a third of the time of the usual 6, for some 4 % more bytes of HTML."""
    lines.write.option("compression", "gzip").option("zlib.compress.level", "FOUR").option("lineSep", "\n").text(path)
    return path


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "content")


def _stream(content: bytes):
    """The bytes of a file, unpacked as they are read; gzip files may have a member for each record."""
    return gzip.GzipFile(fileobj=io.BytesIO(content)) if content[:2] == b"\x1f\x8b" else io.BytesIO(content)


def _http(document: bytes) -> tuple[dict[str, str], bytes, bytes] | None:
    """(header fields in lower case, header block, payload) of an HTTP response; None for what isn't one."""
    if not document.startswith(b"HTTP/"):
        return None
    ends = [(document.find(mark), len(mark)) for mark in (b"\r\n\r\n", b"\n\n")]
    at, size = min(((a, n) for a, n in ends if a >= 0), default=(len(document), 0))
    return _fields(document[:at].splitlines()[1:]), document[: at + size], document[at + size :]


def _fields(lines: list[bytes]) -> dict[str, str]:
    parts = [line.decode("utf-8", "replace").partition(":") for line in lines]
    return {name.strip().lower(): value.strip() for name, _, value in parts}


def _number(text: str | None) -> int | None:
    return int(text) if text and text.lstrip("-").isdigit() else None


def arc_documents(content: bytes) -> Iterator[dict]:
    """The records of an ARC file: offset, version, fields of the header line and the document.

    What is left behind a line that is no header, or that declares more bytes than
    there are, is one record with a ``problem``: nothing is lost and nothing guessed.
    """
    stream, fields, version = _stream(content), FIELDS[1].split(" "), 1
    while True:
        offset = stream.tell()
        line = stream.readline()
        if not line:
            return
        if not line.strip():  # between records
            continue
        cells = line.decode("utf-8", "replace").rstrip("\r\n").rsplit(" ", len(fields) - 1)
        if cells[0].startswith("filedesc://"):
            # The version block names the fields of all lines, its own among them.
            length = _number(line.split()[-1].decode("ascii", "replace")) or 0
            block = stream.read(length).decode("utf-8", "replace").splitlines()
            version = _number(block[0].split(" ")[0]) if block else None
            fields = block[1].strip().split(" ") if len(block) > 1 else FIELDS.get(version or 1, FIELDS[1]).split(" ")
            continue
        got = dict(zip([f.lower() for f in fields], cells, strict=False))
        length = _number(got.get("archive-length"))
        common = {"offset": offset, "version": version, "url": None, "ip": None, "captured": None, "mime": None, "status": None}
        if len(cells) != len(fields) or length is None or length < 0:
            yield common | {"document": line + stream.read(), "problem": "header"}
            return
        document = stream.read(length)
        common |= {"url": got.get("url"), "ip": got.get("ip-address"), "captured": got.get("archive-date"), "mime": got.get("content-type"), "status": _number(got.get("result-code"))}
        yield common | {"document": document, "problem": None if len(document) == length else "truncated"}


_ARC = "file string, offset long, version int, url string, ip string, captured string, mime string, status int, problem string, page_id long, http binary, payload binary, payload_bytes long, sha1 string, sha1_base32 string, sha256 string"


def _arc_rows(path: str, content: bytes, bodies: bool) -> Iterator[tuple[int, dict]]:
    for r in arc_documents(content):
        document = r.pop("document")
        found = _http(document) if r["problem"] != "header" else None
        fields, http, payload = found or ({}, b"", document)
        digest = hashlib.sha1(payload)
        row = r | {"file": path, "page_id": _number(fields.get("x-page-id")), "payload_bytes": len(payload), "sha1": digest.hexdigest(), "sha1_base32": base64.b32encode(digest.digest()).decode(), "sha256": hashlib.sha256(payload).hexdigest()}
        yield len(document), row | {"http": (http if found else None) if bodies else None, "payload": payload if bodies else None}


def _read(rows_of: Callable[[str, bytes, bool], Iterator[tuple[int, dict]]], ddl: str, bodies: bool):
    """Files to records, in batches of some MB."""
    names = [c.split()[0] for c in ddl.split(", ")]
    kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "boolean": pa.bool_()}
    schema = pa.schema([(n, kinds[c.split()[1]]) for n, c in zip(names, ddl.split(", "), strict=True)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                rows, size = [], 0
                for n, row in rows_of(batch.column("path")[i].as_py(), batch.column("content")[i].as_py(), bodies):
                    rows.append(row)
                    size += n * bodies + 500
                    if size > 4 * MB:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, size = [], 0
                yield pa.RecordBatch.from_pylist(rows, schema)

    return run


def arc_records(spark: SparkSession, path: str, bodies: bool = True) -> DataFrame:
    """A row for each record of the ARC files at a path (a folder or a pattern); without ``bodies`` http and payload are null."""
    return _files(spark, path).mapInArrow(_read(_arc_rows, _ARC, bodies), _ARC)


# ----------------------------------------------------------------------- WARC
def lookup(rows: DataFrame, table: DataFrame, key: str, counts: DataFrame, total: int) -> DataFrame:
    """``rows`` left joined to ``table`` by key, with heavy keys apart.

    ``counts`` has (key, n). Fewer than HEAVY keys can have more than one of HEAVY of
    ``total`` rows, so their part of the table has a proven bound and is broadcast.
    """
    heavy = F.broadcast(counts.where(F.col("n") * HEAVY > total).select(F.col(key)))
    large = F.broadcast(table.join(heavy, key))
    at_once = rows.join(large, key)
    light = rows.join(heavy, key, "left_anti")
    return at_once.unionByName(light.join(table, key, "left"))


def decided(records: DataFrame, least: int = LEAST) -> DataFrame:
    """(file, offset, refers_file, refers_offset, refers_url, refers_captured) of the records that revisit another; ``records`` without bodies.

    Equal payloads (length and SHA-256) of ``least`` bytes or more are one group, and
    the record with the largest page_id stays; of rows that repeat the id the last in
    the archives. Null ids come before all others. Responses alone are compared.
    """
    can = records.where((F.col("payload_bytes") >= least) & F.col("problem").isNull() & F.col("url").isNotNull())
    own = F.struct("page_id", "file", "offset", "url", "captured")
    groups = can.groupBy("sha256", "payload_bytes").agg(F.max(own).alias("kept"), F.count(F.lit(1)).alias("n")).where("n > 1")
    groups = saved(groups.select(F.concat_ws(":", "sha256", "payload_bytes").alias("payload_key"), "kept", "n"), "groups")
    rows = can.select("file", "offset", F.concat_ws(":", "sha256", "payload_bytes").alias("payload_key"))
    met = lookup(rows, groups.select("payload_key", "kept"), "payload_key", groups.select("payload_key", "n"), records.count()).where("kept IS NOT NULL")
    revisits = met.where((F.col("file") != F.col("kept.file")) | (F.col("offset") != F.col("kept.offset")))
    return revisits.select("file", "offset", F.col("kept.file").alias("refers_file"), F.col("kept.offset").alias("refers_offset"), F.col("kept.url").alias("refers_url"), F.col("kept.captured").alias("refers_captured"))


def record_id(file: Column, offset: Column) -> Column:
    """An identifier from a record's place in the archives."""
    h = F.md5(F.concat_ws("#", file, offset.cast("string")).cast("binary"))
    part = lambda a, n: F.substring(h, a, n)
    return F.concat(F.lit("urn:uuid:"), F.concat_ws("-", part(1, 8), part(9, 4), F.concat(F.lit("5"), part(14, 3)), F.concat(F.lit("8"), part(18, 3)), part(21, 12)))


def timestamp(captured: Column) -> Column:
    """14 digits as a WARC date; what is shorter is filled with the first moment it allows, what is none is 1970."""
    n = F.length(captured)
    whole = F.when(captured.rlike(r"^\d{4,14}$"), F.concat(captured, F.substring(F.lit("00000101000000"), n + 1, F.lit(14)))).otherwise("19700101000000")
    return F.regexp_replace(whole, r"^(\d{4})(\d\d)(\d\d)(\d\d)(\d\d)(\d\d)$", "$1-$2-$3T$4:$5:$6Z")


def warc_lines(records: DataFrame, revisits: DataFrame) -> DataFrame:
    """(value): records of ARC files as records of WARC files.

    HTTP responses become responses, or revisits where ``revisits`` says so; other
    documents become resources, as does what couldn't be read as a record. A document
    shorter than declared is marked as truncated.
    """
    rows = records.join(revisits, ["file", "offset"], "left")
    revisit = F.col("refers_file").isNotNull()
    response = F.col("http").isNotNull()
    field = lambda name, value: F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit(""))
    kind = F.when(revisit, "revisit").when(response, "response").otherwise("resource")
    http, payload = F.coalesce(F.col("http"), F.lit("").cast("binary")), F.when(revisit, F.lit("").cast("binary")).otherwise(F.col("payload"))
    block = F.concat(http, payload)
    target = F.coalesce("url", F.concat(F.lit("urn:arc:"), "file", F.lit("#"), F.col("offset").cast("string")))
    head = F.concat(
        F.lit("WARC/1.1\r\n"), field("WARC-Type", kind), field("WARC-Record-ID", F.concat(F.lit("<"), record_id(F.col("file"), F.col("offset")), F.lit(">"))), field("WARC-Date", timestamp(F.col("captured"))), field("WARC-Target-URI", target),
        field("WARC-IP-Address", F.nullif(F.col("ip"), F.lit("0.0.0.0"))), field("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "sha1_base32")), field("WARC-Truncated", F.when(F.col("problem") == "truncated", "unspecified")),
        F.when(revisit, F.concat(field("WARC-Profile", F.lit(PROFILE)), field("WARC-Refers-To", F.concat(F.lit("<"), record_id(F.col("refers_file"), F.col("refers_offset")), F.lit(">"))), field("WARC-Refers-To-Target-URI", F.col("refers_url")), field("WARC-Refers-To-Date", timestamp(F.col("refers_captured"))))).otherwise(""),
        field("Content-Type", F.when(response, "application/http;msgtype=response").otherwise(F.coalesce("mime", F.lit("application/octet-stream")))), field("Content-Length", _bytes(block)), F.lit("\r\n"),
    )
    info = F.lit("software: tallywood\r\nformat: WARC File Format 1.1\r\n")
    about = F.concat(F.lit("WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <"), record_id(F.lit("warcinfo"), F.spark_partition_id()), F.lit(">\r\nWARC-Date: 1970-01-01T00:00:00Z\r\nContent-Type: application/warc-fields\r\nContent-Length: "), _bytes(info), F.lit("\r\n\r\n"), info, F.lit("\r\n\r\n"))
    made = F.concat(head.cast("binary"), block, F.lit("\r\n\r").cast("binary"))  # and the writer's line end
    return rows.select(F.concat(F.when(_first_of_file(), about).otherwise("").cast("binary"), made).cast("string").alias("value"))


def warc_documents(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields in lower case, block) of the records of a WARC file."""
    stream = _stream(content)
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError("not a WARC record")
        lines = []
        while (line := stream.readline()).strip():
            lines.append(line)
        fields = _fields(lines)
        yield fields, stream.read(int(fields["content-length"]))


_WARC = "record_id string, record_type string, page_id long, url string, date string, refers_id string, payload_bytes long, payload_digest string, intact boolean, payload binary"


def _warc_rows(path: str, content: bytes, bodies: bool) -> Iterator[tuple[int, dict]]:
    for fields, block in warc_documents(content):
        kind = fields["warc-type"]
        if kind == "warcinfo":
            continue
        http, _, payload = _http(block) or ({}, b"", block)
        said = fields.get("warc-payload-digest", "").partition(":")[2]
        said = base64.b32decode(said).hex() if said else None
        whole = kind != "revisit"
        digest = hashlib.sha1(payload).hexdigest() if whole else said
        name = lambda f: fields.get(f, "").strip("<> ") or None
        yield len(block), {"record_id": name("warc-record-id"), "record_type": kind, "page_id": _number(http.get("x-page-id")), "url": fields.get("warc-target-uri"), "date": fields.get("warc-date"), "refers_id": name("warc-refers-to"), "payload_bytes": len(payload) if whole else None, "payload_digest": digest, "intact": digest == said, "payload": payload if bodies and whole else None}


def warc_records(spark: SparkSession, path: str, bodies: bool = True) -> DataFrame:
    """A row for each record of the WARC files at a path, warcinfo apart. ``intact``: the payload's SHA-1 is the one recorded."""
    return _files(spark, path).mapInArrow(_read(_warc_rows, _WARC, bodies), _WARC)


def convert(spark: SparkSession, arc_path: str, warc_path: str, least: int = LEAST) -> str:
    """Convert the ARC files at a path; returns the folder of the WARC files."""
    revisits = decided(saved(arc_records(spark, arc_path, bodies=False), "records"), least)
    return write_lines(warc_lines(arc_records(spark, arc_path), revisits), warc_path)


def read_back(spark: SparkSession, path: str) -> DataFrame:
    """What the archives say of each page: page_id, payload_bytes, payload_digest, record_type, refers_to, intact.

    A revisit has no payload; its length is that of the record it refers to, its digest the recorded one.
    """
    rows = saved(warc_records(spark, path, bodies=False).drop("payload"), "read")
    revisits = rows.where("record_type = 'revisit'").select("page_id", "payload_digest", "record_type", "intact", "refers_id")
    table = rows.where("record_type <> 'revisit'").select(F.col("record_id").alias("refers_id"), F.col("page_id").alias("refers_to"), "payload_bytes")
    counts = revisits.groupBy("refers_id").agg(F.count(F.lit(1)).alias("n"))
    met = lookup(revisits, table, "refers_id", counts, rows.count())
    others = rows.where("record_type <> 'revisit'").withColumn("refers_to", F.lit(None).cast("long"))
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "intact"]
    return others.select(names).unionByName(met.select(names))


def archive_pages(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", least: int = LEAST) -> DataFrame:
    """Pages through a legacy archive into WARC files and back: one row per page, as :func:`read_back` says.

    A null html is an empty payload. Rows that repeat a page_id have a record each; of
    those that repeat the payload too, one is the response. A null page_id is the
    smallest, and refers_to is null where the response has none. An empty table gives
    an empty one; other columns are ignored. The files stay in the shared folder.
    """
    spark = pages.sparkSession
    arc = write_lines(arc_lines(pages, key, url, html), new_path(spark, "arc"))
    return read_back(spark, convert(spark, arc, new_path(spark, "warc"), least))
