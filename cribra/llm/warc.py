"""WARC archives written and read by Spark as chunked records.

Writing: every page is a ``response`` record or, if another page has the same
payload, a ``revisit`` of the page with the largest id. A payload over ``chunk``
bytes is cut into WARC segments (one ``response``, then ``continuation`` records), so
a row of the archive table is one segment and no row is longer than a chunk and its
header. The rows go through Spark's text writer, whose line separator is the record
end, into gzip files: a WARC file per task, committed like any Spark output.

Reading: the gzip files are read as a stream of pieces between blank lines; a small
state machine follows Content-Length, hands out ``(record, chunk number)`` rows and
carries the running byte count and SHA-1 of the payload from chunk to chunk. No
record is held whole.

Defined cases: a null payload is empty; an empty payload takes part in the search
for equal payloads if ``min_bytes`` is 0; rows that repeat the largest id of a payload
are all responses; a null id is smaller than any other; a null URL is left out, line
breaks in a URL are percent-encoded; an empty table writes and reads nothing. Other
columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cribra.llm.common import small_batches, texts

CHUNK = 1 << 20
END = "\r\n\r\n"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"


def _name(page) -> str:
    return f"<urn:page:{'' if page is None else page}>"


def _header(fields: list[tuple[str, object]]) -> str:
    return "WARC/1.1\r\n" + "\r\n".join(f"{k}: {v}" for k, v in fields if v is not None)


def cuts(payload: bytes, first: int, chunk: int) -> Iterator[bytes]:
    """Parts of at most ``chunk`` bytes (the first of ``first``) that end between characters."""
    at, size = 0, max(first, 4)
    while True:
        end = min(at + size, len(payload))
        while end < len(payload) and payload[end] & 0xC0 == 0x80:
            end -= 1
        yield payload[at:end]
        at, size = end, chunk
        if at >= len(payload):
            return


def record(page, url, payload: bytes, digest: str, refers_to, is_revisit: bool,
           chunk: int = CHUNK, date: str = DATE) -> Iterator[str]:
    """The WARC records (segments) of one page, without the blank lines that end them."""
    uri = None if url is None else url.replace("\r", "%0D").replace("\n", "%0A")
    common = [("WARC-Record-ID", _name(page)), ("WARC-Date", date), ("WARC-Target-URI", uri),
              ("WARC-Payload-Digest", f"sha1:{digest}"), ("WARC-Payload-Length", len(payload))]
    if is_revisit:
        yield _header([("WARC-Type", "revisit"), *common, ("WARC-Refers-To", _name(refers_to)),
                       ("WARC-Profile", PROFILE), ("Content-Length", 0)]) + END
        return
    http = (HTTP + END).encode()
    parts = list(cuts(payload, chunk - len(http), chunk)) if len(payload) + len(http) > chunk else [payload]
    for k, part in enumerate(parts, 1):
        block = http + part if k == 1 else part
        segment = [("WARC-Segment-Number", k)] if len(parts) > 1 else []
        if k > 1:
            head = [("WARC-Type", "continuation"), ("WARC-Record-ID", f"<urn:page:{page}:{k}>"),
                    ("WARC-Date", date), ("WARC-Segment-Origin-ID", _name(page))]
            if k == len(parts):
                segment.append(("WARC-Segment-Total-Length", len(http) + len(payload)))
        else:
            head = [("WARC-Type", "response"), *common,
                    ("Content-Type", "application/http; msgtype=response")]
        yield _header([*head, *segment, ("Content-Length", len(block))]) + END + block.decode()


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str | None = "url",
                   payload_col: str = "html", min_bytes: int = 0, chunk: int = CHUNK) -> None:
    """Write a record per page to gzip WARC files under ``path``.

    Equal payloads are found by their digests: only digests that occur twice join
    back, one row each, so payloads shuffle only if that table is too large to
    broadcast, and a payload of a third of all pages is then split by the skew join.
    """
    small_batches(pages.sparkSession)
    payload = F.coalesce(F.col(payload_col), F.lit(""))
    rows = pages.select(
        F.col(id_col).cast("long").alias("page"),
        (F.col(url_col) if url_col else F.lit(None)).cast("string").alias("url"),
        payload.alias("payload"), F.unhex(F.sha1(payload.cast("binary"))).alias("digest"))
    same = (rows.where(F.octet_length("payload") >= min_bytes).groupBy("digest")
            .agg(F.count("*").alias("n"), F.max("page").alias("last")).where("n > 1")
            .select("digest", "last"))
    typed = rows.join(same, "digest", "left").select(
        "payload", "page", "url", "digest", "last",
        (F.col("last").isNotNull() & ~F.col("page").eqNullSafe(F.col("last"))).alias("revisit"))

    def run(batches):
        for b in batches:
            ids, urls, digests, lasts, revisits = (c.to_pylist() for c in b.columns[1:])
            out, size = [], 0
            for t, i, u, d, last, rev in zip(texts(b.column(0)), ids, urls, digests, lasts, revisits,
                                             strict=True):
                code = base64.b32encode(d).decode()
                for part in record(i, u, t, code, last, rev, chunk):
                    out.append(part)
                    size += len(part)
                    if size > 8 * chunk:
                        yield pa.RecordBatch.from_pydict({"value": out})
                        out, size = [], 0
            if out:
                yield pa.RecordBatch.from_pydict({"value": out})

    (typed.mapInArrow(run, "value string").write.option("lineSep", END)
     .option("compression", "gzip").option("maxRecordsPerFile", 0).text(path))


class Reader:
    """Follows records through the pieces between blank lines of WARC files."""

    def __init__(self, with_data: bool):
        self.with_data = with_data
        self.fields: dict[str, str] | None = None
        self.left = 0           # bytes of the block still to come
        self.http = False       # the next piece is the HTTP header
        self.skip = 0           # bytes of a record end that the next piece begins with
        self.page = None        # the response whose payload is open
        self.sha = None
        self.size = self.chunk = 0

    def piece(self, data: bytes) -> Iterator[tuple]:
        if self.fields is None:
            data = data[self.skip:].lstrip(b"\r\n")
            self.skip = 0
            if data:
                yield from self._open(data)
            return
        body, self.left = data, self.left - len(data)
        ended = self.left <= 0
        if not ended:
            self.left -= len(END)
            # The blank line is part of the block, as far as the block reaches.
            body += END.encode()[:len(END) + min(0, self.left)]
            if self.left < 0:
                self.skip, ended = len(END) + self.left, True
        if self.http:
            self.http, body = False, b""
        if body:
            self.sha.update(body)
            self.size += len(body)
            if self.with_data:
                yield self._row(body, None)
        if ended:
            yield from self._close()

    def _open(self, data: bytes) -> Iterator[tuple]:
        head, *lines = data.decode().split("\r\n")
        if not head.startswith("WARC/"):
            raise ValueError(f"not a WARC header: {head[:80]!r}")
        self.fields = {k.strip().lower(): v.strip() for k, v in (x.split(":", 1) for x in lines)}
        self.left = int(self.fields["content-length"])
        kind = self.fields["warc-type"]
        if kind != "continuation":
            self.page, self.sha, self.size, self.chunk = self.fields, hashlib.sha1(), 0, 0
        self.http = kind == "response"
        return iter(())

    def _close(self) -> Iterator[tuple]:
        fields, self.fields = self.fields, None
        more = "warc-segment-number" in fields and "warc-segment-total-length" not in fields
        if not more:
            yield self._row(None, base64.b32encode(self.sha.digest()).decode())

    def _row(self, body: bytes | None, digest: str | None) -> tuple:
        p = self.page
        n, self.chunk = self.chunk, self.chunk + 1
        so_far = digest or base64.b32encode(self.sha.copy().digest()).decode()
        return (p["warc-record-id"], n, body, self.size, so_far, digest is not None, p["warc-type"],
                p.get("warc-refers-to"), p.get("warc-target-uri"),
                p.get("warc-payload-digest", "").removeprefix("sha1:") or None,
                int(p["warc-payload-length"]) if "warc-payload-length" in p else None)


_COLUMNS = ("record_id string, chunk int, data binary, bytes_so_far long, digest_so_far string, "
            "last boolean, record_type string, refers_to string, target_uri string, "
            "declared_digest string, declared_bytes long")
_KINDS = [pa.string(), pa.int32(), pa.binary(), pa.int64(), pa.string(), pa.bool_(), pa.string(),
          pa.string(), pa.string(), pa.string(), pa.int64()]
_NAMES = [x.split()[0] for x in _COLUMNS.split(", ")]


def read_chunks(spark: SparkSession, path: str, with_data: bool = True) -> DataFrame:
    """The archives as rows of record and chunk number.

    Each row has the payload's byte count and base32 SHA-1 so far; the row with
    ``last`` closes the record and has those of the whole payload, without data. With
    ``with_data=False`` only those rows come.
    """
    small_batches(spark)

    def run(batches):
        reader = Reader(with_data)
        for b in batches:
            rows, size = [], 0
            for t in texts(b.column(0)):
                for row in reader.piece(t):
                    rows.append(row)
                    size += len(row[2] or b"")
                if size > 8 * CHUNK:
                    yield _batch(rows)
                    rows, size = [], 0
            if rows:
                yield _batch(rows)

    return spark.read.option("lineSep", END).text(path).mapInArrow(run, _COLUMNS)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), _KINDS, strict=True)], names=_NAMES)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """One row per record: ``page_id``, ``payload_bytes``, ``payload_digest``, ``record_type``,
    ``refers_to``, ``verified``.

    Bytes and digest of a response are those of the payload read back (``verified``:
    they equal the declared ones); a revisit has the declared ones of its payload.
    """
    def page(c: str) -> F.Column:
        return F.nullif(F.regexp_extract(c, "<urn:page:(-?[0-9]*)>", 1), F.lit("")).cast("long")

    own = F.col("record_type") == "response"
    return read_chunks(spark, path, with_data=False).where("last").select(
        page("record_id").alias("page_id"),
        F.when(own, F.col("bytes_so_far")).otherwise(F.col("declared_bytes")).alias("payload_bytes"),
        F.when(own, F.col("digest_so_far")).otherwise(F.col("declared_digest")).alias("payload_digest"),
        "record_type", page("refers_to").alias("refers_to"),
        F.when(own, (F.col("digest_so_far") == F.col("declared_digest"))
               & (F.col("bytes_so_far") == F.col("declared_bytes"))).alias("verified"))
