"""WARC archives: writing captures, reading records, and assembling transactions through concurrent-to identifiers."""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyline.session import materialize, scratch_path

SALTS = 16
_END = "\r\n\r\n"
_READ = 1 << 20
#: Records leave a task in batches of about this many bytes of payload.
_BATCH_BYTES = 8 << 20
_BATCH_ROWS = 5000
_ANCHORS = ("response", "revisit", "resource", "conversion")
_REVISIT_PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"


def base32_sha1(value: Column) -> Column:
    """Upper-case base32 of the SHA-1 of a binary column: 40 hex digits in groups of 10, which are 8 digits of base 32."""
    digest = F.sha1(value)
    groups = [F.lpad(F.conv(F.substring(digest, at, 10), 16, 32), 8, "0") for at in (1, 11, 21, 31)]
    return F.translate(F.concat(*groups), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _urn(kind: str, *parts: Column) -> Column:
    """A record id that depends on its parts alone, nulls told from empty texts."""
    told = [F.coalesce(F.concat(F.lit("="), p.cast("string")), F.lit("-")) for p in parts]
    digits = F.md5(F.concat_ws("\u0001", F.lit(kind), *told).cast("binary"))
    cut = [F.substring(digits, at, n) for at, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cut), F.lit(">"))


def _headed(fields: list[tuple[str, Column]], block: Column) -> Column:
    """One record without its closing blank lines; fields that are null are left out."""
    lines = [F.concat(F.lit(f"{name}: "), F.regexp_replace(value, "[\r\n]", " "), F.lit("\r\n")) for name, value in fields]
    known = [F.coalesce(line, F.lit("")) for line in lines]
    return F.concat(F.lit("WARC/1.0\r\n"), *known, F.lit("Content-Length: "), F.octet_length(block).cast("string"), F.lit(_END), block)


def captures_to_write(pages: DataFrame, id_column: str = "page_id", url_column: str = "url", html_column: str = "html", least_bytes: int = 0) -> DataFrame:
    """``page_id``, ``url``, ``payload`` (text), ``digest``, ``capture`` (record id), ``refers`` (record id or null).

    Of pages with equal payloads of at least ``least_bytes`` bytes, that with the largest id is the response (all of them
    if rows share that id) and the others refer to it. The largest id of a payload is a partial aggregate, and it meets
    the pages in a salted join, so copies of one page are spread over several tasks.
    """
    payload = F.coalesce(F.col(f"`{html_column}`").cast("string"), F.lit(""))
    rows = pages.select(F.col(f"`{id_column}`").alias("page_id"), F.col(f"`{url_column}`").cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("digest", base32_sha1(F.col("payload").cast("binary")))
    first = rows.where(F.octet_length("payload") >= least_bytes).groupBy("digest").agg(F.max(F.struct("page_id", "url")).alias("first"), F.count(F.lit(1)).alias("n"))
    first = first.where("n > 1 and first.page_id is not null").select("digest", "first", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int"))
    known = salted.join(first, ["digest", "salt"], "left")
    own = _urn("capture", F.col("page_id"), F.col("url"), F.col("digest"))
    refers = F.when(
        (F.col("first").isNotNull()) & ~F.col("page_id").eqNullSafe(F.col("first.page_id")), _urn("capture", F.col("first.page_id"), F.col("first.url"), F.col("digest"))
    )
    return known.select("page_id", "url", "payload", "digest", own.alias("capture"), refers.alias("refers"))


def write_archives(captures: DataFrame, path: str, date: str = "2024-01-01T00:00:00Z") -> None:
    """Write request, response or revisit, and metadata record of every capture as gzipped WARC files below ``path``.

    A record ends in two empty lines, which is the line separator of Spark's text writer: files are written by its
    commit protocol to any store it reaches, so a lost executor leaves no torn or double file.
    """
    digest = F.concat(F.lit("sha1:"), F.col("digest"))
    uri, when, capture = F.col("url"), F.lit(date), F.col("capture")
    head = F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8" + _END)
    host, target = F.regexp_extract("url", "^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1), F.regexp_extract("url", "^[^?#/]*//[^/?#]*([^#\r\n ]*)", 1)
    asked = F.concat(F.lit("GET "), F.when(target == "", "/").otherwise(target), F.lit(" HTTP/1.1\r\nHost: "), F.regexp_replace(host, "[\r\n]", ""), F.lit(_END))
    request = _headed(
        [
            ("WARC-Type", F.lit("request")),
            ("WARC-Record-ID", _urn("request", capture)),
            ("WARC-Concurrent-To", capture),
            ("WARC-Target-URI", uri),
            ("WARC-Date", when),
            ("Content-Type", F.lit("application/http; msgtype=request")),
        ],
        F.coalesce(asked, F.lit("")),
    )
    common = [
        ("WARC-Record-ID", capture),
        ("WARC-Target-URI", uri),
        ("WARC-Date", when),
        ("WARC-Payload-Digest", digest),
        ("Content-Type", F.lit("application/http; msgtype=response")),
    ]
    response = _headed([("WARC-Type", F.lit("response")), *common], F.concat(head, F.col("payload")))
    revisit = _headed([("WARC-Type", F.lit("revisit")), ("WARC-Profile", F.lit(_REVISIT_PROFILE)), ("WARC-Refers-To", F.col("refers")), *common], head)
    metadata = _headed(
        [
            ("WARC-Type", F.lit("metadata")),
            ("WARC-Record-ID", _urn("metadata", capture)),
            ("WARC-Concurrent-To", capture),
            ("WARC-Target-URI", uri),
            ("WARC-Date", when),
            ("Content-Type", F.lit("application/warc-fields")),
        ],
        F.coalesce(F.concat(F.lit("page-id: "), F.col("page_id").cast("string"), F.lit("\r\n")), F.lit("")),
    )
    records = captures.select(F.explode(F.array(request, F.when(F.col("refers").isNull(), response).otherwise(revisit), metadata)).alias("value"))
    records.write.option("lineSep", _END).option("compression", "gzip").text(path)


class _Stream:
    """Bytes of a file, plain or gzip (any number of members), read in bounded pieces."""

    def __init__(self, file, gzipped: bool):
        self._file, self._gzipped = file, gzipped
        self._unzip = zlib.decompressobj(31) if gzipped else None
        self._left, self._held, self._ended = b"", bytearray(), False

    def _more(self) -> bool:
        if not self._gzipped:
            part = self._file.read(_READ)
            self._held += part
            return bool(part)
        while True:
            raw = self._left or self._file.read(_READ)
            self._left = b""
            if not raw:
                return False
            if self._unzip.eof:
                self._unzip = zlib.decompressobj(31)
            part = self._unzip.decompress(raw, 4 * _READ)
            self._left = self._unzip.unconsumed_tail or self._unzip.unused_data
            if part:
                self._held += part
                return True

    def line(self) -> bytes:
        """The next line with its end; empty at the end of the file."""
        at = 0
        while (found := self._held.find(b"\n", at)) < 0:
            at = len(self._held)
            if not self._more():
                found = len(self._held) - 1
                break
        own = bytes(self._held[: found + 1])
        del self._held[: found + 1]
        return own

    def take(self, n: int) -> bytes:
        while len(self._held) < n and self._more():
            pass
        own = bytes(self._held[:n])
        del self._held[:n]
        return own


def parse_records(stream: _Stream) -> Iterator[tuple[list[tuple[str, str]], bytes]]:
    """(header fields with lower-case names, block) of every record; raises on what is no record."""
    while True:
        line = stream.line()
        while line in (b"\r\n", b"\n"):
            line = stream.line()
        if not line:
            return
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {line[:80]!r}")
        fields: list[tuple[str, str]] = []
        while (line := stream.line()) not in (b"\r\n", b"\n", b""):
            text = line.decode("utf-8", "replace").rstrip("\r\n")
            if text[:1] in " \t" and fields:
                fields[-1] = (fields[-1][0], f"{fields[-1][1]} {text.strip()}")
            else:
                name, _, value = text.partition(":")
                fields.append((name.strip().lower(), value.strip()))
        length = int(dict(fields).get("content-length", "0"))
        block = stream.take(length)
        if len(block) < length:
            raise ValueError("the file ends within a record")
        yield fields, block


_RECORD = pa.schema(
    [
        ("file", pa.string()),
        ("position", pa.int64()),
        ("type", pa.string()),
        ("record_id", pa.string()),
        ("concurrent_to", pa.list_(pa.string())),
        ("refers_to", pa.string()),
        ("target_uri", pa.string()),
        ("date", pa.string()),
        ("payload_digest", pa.string()),
        ("payload_bytes", pa.int64()),
        ("fields", pa.map_(pa.string(), pa.string())),
        ("payload", pa.binary()),
    ]
)
_RECORD_DDL = (
    "file string, position bigint, type string, record_id string, concurrent_to array<string>, refers_to string, target_uri string, date string, "
    "payload_digest string, payload_bytes bigint, fields map<string,string>, payload binary"
)


def _record(file: str, position: int, fields: list[tuple[str, str]], block: bytes, with_payload: bool) -> dict:
    named = dict(reversed(fields))
    kind, content = named.get("warc-type"), named.get("content-type", "")
    payload = block
    if content.startswith("application/http"):
        head = re.search(rb"\r?\n\r?\n", block)
        payload = block[head.end() :] if head else b""
    own: dict[str, str] = {}
    if content.startswith("application/warc-fields"):
        for line in block.decode("utf-8", "replace").splitlines():
            name, colon, value = line.partition(":")
            if colon:
                own.setdefault(name.strip().lower(), value.strip())
    stated = named.get("warc-payload-digest", "")
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode() if kind != "revisit" else stated.rpartition(":")[2] or None
    return {
        "file": file,
        "position": position,
        "type": kind,
        "record_id": named.get("warc-record-id"),
        "concurrent_to": [v for n, v in fields if n == "warc-concurrent-to"],
        "refers_to": named.get("warc-refers-to"),
        "target_uri": named.get("warc-target-uri"),
        "date": named.get("warc-date"),
        "payload_digest": digest,
        "payload_bytes": None if kind == "revisit" else len(payload),
        "fields": list(own.items()),
        "payload": payload if with_payload else None,
    }


def read_records(spark: SparkSession, path: str, with_payload: bool = False) -> DataFrame:
    """The records of all archives below ``path``, plain or gzipped; ``position`` is the record's number in its file.

    Spark lists the files; a task streams one file at a time and holds one record and one batch. Digest and length are
    those of the payload (of an HTTP record, what follows its header); a revisit has the digest it states and no length.
    A torn file raises.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column(0).to_pylist():
                store, inner = fs.FileSystem.from_uri(re.sub("^file:/+", "file:///", name))
                with store.open_input_stream(inner, compression=None) as file:
                    rows, held = [], 0
                    for position, (fields, block) in enumerate(parse_records(_Stream(file, name.endswith(".gz")))):
                        rows.append(_record(name, position, fields, block, with_payload))
                        held += len(block) if with_payload else 0
                        if held >= _BATCH_BYTES or len(rows) >= _BATCH_ROWS:
                            yield pa.RecordBatch.from_pylist(rows, schema=_RECORD)
                            rows, held = [], 0
                    if rows:
                        yield pa.RecordBatch.from_pylist(rows, schema=_RECORD)

    return files.mapInArrow(read, _RECORD_DDL)


def assemble_transactions(records: DataFrame) -> DataFrame:
    """One nested row per capture: ``capture_id``, ``copies``, ``response``, ``requests``, ``metadata``.

    A capture is a response, revisit, resource or conversion record with the request and metadata records that are
    concurrent to it, whichever side names the other, or to a request or metadata record of it. A record that is near
    several captures goes to that with the smallest id, and to a nearer one first. Records without any capture form rows
    with a null ``response``, under the id of their request, so nothing is lost. Records with one id are one record (the
    first by file and position); ``copies`` tells how many the capture had. A record without an id is its own.
    ``requests`` and ``metadata`` are sorted by record id.
    """
    body = F.struct("type", "record_id", "concurrent_to", "refers_to", "target_uri", "date", "payload_digest", "payload_bytes", "fields", "payload")
    named = records.withColumn("id", F.coalesce("record_id", F.concat_ws(":", "file", "position")))
    own = named.groupBy("id").agg(F.min_by(body, F.struct("file", "position")).alias("body"), F.count(F.lit(1)).alias("copies"))
    kind = F.col("body.type")
    rank = F.when(kind.isin(*_ANCHORS), 0).when(kind == "request", 1).when(kind == "metadata", 2).otherwise(3)
    own = own.withColumn("rank", rank)
    told = own.select(F.col("id").alias("a"), F.explode("body.concurrent_to").alias("b"))
    edges = told.unionByName(told.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    heads = own.select("id", F.struct("rank", "id").alias("head"))
    for _ in range(2):
        near = edges.join(heads.select(F.col("id").alias("b"), "head"), "b").groupBy(F.col("a").alias("id")).agg(F.min("head").alias("near"))
        heads = heads.join(near, "id", "left").select("id", F.when((F.col("head.rank") == 0) | F.col("near").isNull(), F.col("head")).otherwise(F.least("head", "near")).alias("head"))
    member = own.join(heads, "id").withColumn("capture_id", F.col("head.id"))
    of = lambda wanted: F.sort_array(F.collect_list(F.when(wanted, F.struct("body.record_id", "body.type", "body.target_uri", "body.date", F.to_json("body.fields").alias("fields")))))
    anchor = (F.col("id") == F.col("capture_id")) & (F.col("rank") == 0)
    return member.groupBy("capture_id").agg(
        F.max(F.when(F.col("id") == F.col("capture_id"), F.col("copies"))).alias("copies"),
        F.first(F.when(anchor, F.col("body")), ignorenulls=True).alias("response"),
        of(F.col("rank") == 1).alias("requests"),
        of(~anchor & (F.col("rank") != 1)).alias("metadata"),
    )


def resolve_revisits(captures: DataFrame) -> DataFrame:
    """``captures`` with ``original``: the capture a revisit refers to (``capture_id``, ``payload_bytes``, ``metadata``), else null.

    Only captures that are referred to take part, in salted copies, so a page that a third of all captures revisit is
    spread over several tasks. A revisit of a capture that is not there keeps a null.
    """
    sought = captures.where("response.refers_to is not null").select(F.col("response.refers_to").alias("capture_id")).distinct()
    known = captures.join(sought, "capture_id", "left_semi").select(
        F.col("capture_id").alias("sought"),
        F.struct("capture_id", F.col("response.payload_bytes").alias("payload_bytes"), "metadata").alias("original"),
        F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"),
    )
    salted = captures.withColumn("salt", F.pmod(F.xxhash64("capture_id"), F.lit(SALTS)).cast("int")).withColumn("sought", F.col("response.refers_to"))
    return salted.join(known, ["sought", "salt"], "left").drop("sought", "salt")


def _page_id(metadata: Column) -> Column:
    return F.get_json_object(F.get(metadata, 0)["fields"], "$.page-id").cast("bigint")


def round_trip(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Write ``pages`` (``page_id``, ``url``, ``html``) as archives, read them back, and return a row per page.

    ``page_id``, ``payload_bytes``, ``payload_digest``, ``record_type``, ``refers_to`` (the response's page). Null html is an
    empty payload; a null id stays null and is never referred to; rows that repeat a page are one record with copies and
    come back as often as they went in; other columns are ignored; no pages give no rows.
    """
    spark = pages.sparkSession
    if not pages.take(1):
        return spark.createDataFrame([], "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint")
    path = scratch_path(spark, "warc")
    write_archives(captures_to_write(pages, least_bytes=least_bytes), path)
    records = materialize(read_records(spark, path), "records")
    found = resolve_revisits(materialize(assemble_transactions(records), "captures"))
    return found.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies")))).select(
        _page_id(F.col("metadata")).alias("page_id"),
        F.coalesce("response.payload_bytes", "original.payload_bytes").alias("payload_bytes"),
        F.col("response.payload_digest").alias("payload_digest"),
        F.col("response.type").alias("record_type"),
        _page_id(F.col("original.metadata")).alias("refers_to"),
    )
