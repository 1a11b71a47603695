"""WARC archives: writing captures, reading archives back, and transaction assembly.

Each capture becomes three records: request, response (or revisit) and metadata, tied together by
WARC-Concurrent-To.  Archives are written by Spark's own text writer with the records' terminator as
line separator, so they go to any store that Spark can write and bytes pass through unchanged; they are
read with the ``binaryFile`` source (gzip-compressed or plain).  Payloads equal to an earlier response's (by SHA-256, of
``least`` bytes or more) become revisits without a body.

Edge cases: null html is an empty payload; null urls are written as ``urn:none``; payloads may hold any
bytes, among them record separators (lengths, not separators, bound a body); pages with equal payloads tie
on the smallest page_id; each row is a capture, also where it repeats a page_id or has none (a header tells such captures apart;
a row without an id is always a response, for none can be smaller); rows equal in all three columns come back as often as they
are there; extra columns are ignored; an empty table gives an empty archive and result.
"""

from __future__ import annotations

import gzip
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .workspace import Workspace

LEAST = 100
#: Captures in one archive file at most, and payload bytes that it should hold; a reader holds one archive in memory, which is at
#: most four times as large, or one capture.
PER_FILE, FILE_BYTES = 1000, 64_000_000
#: Payload bytes that a reader passes on at once, but for one larger capture.
BATCH_BYTES = 16_000_000
END = "\r\n\r\n"
DATE = "2020-01-01T00:00:00Z"
EMPTY_DIGEST = hashlib.sha256(b"").hexdigest()


def plan_revisits(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least: int = LEAST) -> DataFrame:
    """page_id, url, payload, payload_digest, payload_bytes and refers_to (null for responses) of each page.

    The least page_id by digest is found from (digest, page_id) alone; the payload joins once.
    """
    payload = F.coalesce(F.col(payload_col).cast("binary"), F.lit("").cast("binary"))
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload")).withColumns(
        {"payload_digest": F.sha2("payload", 256), "payload_bytes": F.octet_length("payload").cast("long")})
    firsts = rows.where(F.col("payload_bytes") >= least).groupBy("payload_digest").agg(F.min("page_id").alias("first"), F.count("*").alias("copies"))
    joined = rows.join(firsts.where("copies > 1").select("payload_digest", "first"), "payload_digest", "left")
    return joined.select("page_id", "url", "payload", "payload_digest", "payload_bytes", F.when(F.col("first") != F.col("page_id"), F.col("first")).alias("refers_to"))


def _record(kind: str, record_id, headers: list, body) -> F.Column:
    """One record as a string column: header lines, an empty line and the body (its terminator is the line separator)."""
    body = body.cast("binary")
    row = F.lower(F.hex(F.xxhash64("page_id", "url", "payload_digest")))  # tells captures of one page_id apart
    head = [F.lit(f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <"), record_id, F.lit(f">\r\nWARC-Date: {DATE}\r\nX-Capture-Row: "), row, F.lit("\r\n")]
    for name, value in headers:
        head += [F.lit(f"{name}: "), value, F.lit("\r\n")]
    text = F.concat(*head, F.lit("Content-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"))
    return F.concat(text.cast("binary"), body)


def records(planned: DataFrame, *more: F.Column) -> DataFrame:
    """The three records of each capture, as one column ``value`` of record bytes, and further columns."""
    page = F.coalesce(F.col("page_id").cast("string"), F.lit("none"))
    urn = lambda part, of=page: F.concat(F.lit(f"urn:capture:{part}:"), of)
    target = F.coalesce(F.regexp_replace("url", r"[\r\n]", ""), F.lit("urn:none"))
    bracket = lambda x: F.concat(F.lit("<"), x, F.lit(">"))
    first = F.col("refers_to").isNull()
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("payload_bytes").cast("string"), F.lit("\r\n\r\n"))
    digest = ("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("payload_digest")))
    uri, id_ = ("WARC-Target-URI", target), urn("response")
    request = _record("request", urn("request"), [uri, ("WARC-Concurrent-To", bracket(id_)), ("Content-Type", F.lit("application/http;msgtype=request"))],
                      F.concat(F.lit("GET "), target, F.lit(" HTTP/1.1\r\n\r\n")))
    response = _record("response", id_, [uri, digest, ("Content-Type", F.lit("application/http;msgtype=response"))], F.concat(http.cast("binary"), F.col("payload")))
    revisit = _record("revisit", id_, [uri, digest, ("WARC-Profile", F.lit("http://netpreserve.org/warc/1.0/revisit/identical-payload-digest")),
                                       ("WARC-Refers-To", bracket(urn("response", F.col("refers_to").cast("string")))), ("Content-Type", F.lit("application/http;msgtype=response"))], http)
    metadata = _record("metadata", urn("metadata"), [uri, ("WARC-Concurrent-To", bracket(id_)), ("Content-Type", F.lit("application/warc-fields"))],
                       F.concat(F.lit("page-id: "), page, F.lit("\r\npayload-bytes: "), F.col("payload_bytes").cast("string"), F.lit("\r\n")))
    one = F.concat(request, F.lit(END).cast("binary"), F.when(first, response).otherwise(revisit), F.lit(END).cast("binary"), metadata)
    return planned.select(one.cast("string").alias("value"), *more)


def file_limits(pages: DataFrame, payload_col: str = "html") -> tuple[int, int | None]:
    """(captures in a file, payload bytes from which captures are laid apart) for a table; None if there are no such captures."""
    size = F.octet_length(F.col(payload_col).cast("binary"))
    found = pages.agg(F.avg(size).alias("mean"), F.max(size).alias("most")).first()
    per_file = max(1, min(PER_FILE, int(FILE_BYTES / max(found["mean"] or 1, 1))))
    large = 4 * FILE_BYTES // per_file
    return per_file, large if (found["most"] or 0) > large else None


def write(planned: DataFrame, path: str, per_file: int = PER_FILE, large: int | None = None) -> None:
    """Compressed archives of ``per_file`` captures at most; those of ``large`` payload bytes or more share a file with the fewer the larger they are."""
    rows, keys = records(planned), []
    if large is not None:
        double = F.floor(F.log2(F.col("payload_bytes") / large)).cast("int")
        slot = F.expr(f"shiftright(monotonically_increasing_id(), greatest(0, {max(0, per_file.bit_length() - 3)} - double))")
        planned = planned.withColumn("double", double)
        rows = records(planned, F.when(F.col("payload_bytes") >= large, F.concat(F.lit("large-"), slot.cast("string"))).otherwise(F.lit("all")).alias("part"))
        keys = ["part"]
    rows.write.partitionBy(*keys).option("lineSep", END).option("maxRecordsPerFile", per_file).option("compression", "gzip").text(path)


RECORD = "record_id string, capture_row string, kind string, uri string, date string, concurrent_to string, refers_to string, declared_digest string, fields string, payload_bytes long, payload_digest string, payload binary"


def parse(data: bytes) -> Iterator[tuple[dict[str, str], memoryview]]:
    """Headers (names in lower case) and body of each record; bodies are bounded by Content-Length."""
    at, view = 0, memoryview(data)
    while at < len(data):
        if data[at : at + 2] == b"\r\n":
            at += 2
            continue
        end = data.find(b"\r\n\r\n", at)
        if end < 0 or data[at : at + 5] != b"WARC/":
            raise ValueError(f"no WARC record at byte {at}")
        lines = data[at:end].decode("utf-8", "replace").split("\r\n")[1:]
        headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        size = int(headers["content-length"])
        if end + 4 + size > len(data):
            raise ValueError(f"the record at byte {at} is cut off")
        yield headers, view[end + 4 : end + 4 + size]
        at = end + 4 + size


def _bare(x: str | None) -> str | None:
    return x.strip("<>") if x is not None else None


def _reader(with_payload: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in RECORD.split(", ")]
        kinds = [pa.string()] * 9 + [pa.int64(), pa.string(), pa.binary()]

        def out(rows: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

        for batch in batches:
            for content in batch.column(0):
                rows, held = [], 0
                data = content.as_py()
                for h, body in parse(gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data):
                    kind, size, digest, payload, fields = h.get("warc-type"), None, None, None, None
                    if kind == "response":
                        whole = bytes(body)
                        payload = whole[whole.find(b"\r\n\r\n") + 4 :] if "msgtype=response" in h.get("content-type", "") else whole
                        size, digest = len(payload), hashlib.sha256(payload).hexdigest()
                    elif kind == "metadata":
                        fields = bytes(body).decode("utf-8", "replace")
                    declared = h.get("warc-payload-digest")
                    rows.append((_bare(h.get("warc-record-id")), h.get("x-capture-row"), kind, h.get("warc-target-uri"), h.get("warc-date"), _bare(h.get("warc-concurrent-to")), _bare(h.get("warc-refers-to")),
                                 declared.partition(":")[2] if declared else None, fields, size, digest, payload if with_payload else None))
                    held += len(payload) if payload and with_payload else 0
                    if len(rows) >= 2000 or held >= BATCH_BYTES:
                        yield out(rows)
                        rows, held = [], 0
                if rows:
                    yield out(rows)

    return run


def read(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """A row for each record of the archives in a folder; responses' payloads are digested from the bytes read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("content")
    return files.mapInArrow(_reader(with_payload), RECORD)


def assemble(found: DataFrame) -> DataFrame:
    """One nested row for each capture: request, response (or revisit) and metadata joined through concurrent-to ids.

    A capture without a request or metadata record keeps nulls there; requests or metadata whose
    response is missing are kept too, with a null response.  Captures that share an id are told apart by their row header; those
    that don't differ in it either are the same and come as often as they were written.
    """
    whole = F.struct(*found.columns)
    key = F.when(F.col("kind").isin("response", "revisit"), F.col("record_id")).otherwise(F.coalesce("concurrent_to", "record_id"))
    kinds = {"request": ("request",), "response": ("response", "revisit"), "metadata": ("metadata",)}
    of = lambda names: F.max(F.when(F.col("kind").isin(*names), whole))
    times = F.greatest(*(F.count_if(F.col("kind").isin(*names)) for names in kinds.values()), F.lit(1))
    met = found.groupBy(key.alias("capture_id"), "capture_row").agg(*(of(names).alias(k) for k, names in kinds.items()), times.cast("int").alias("times"))
    return met.withColumn("time", F.explode(F.sequence(F.lit(1), "times"))).drop("capture_row", "times", "time")


def captures(assembled: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to; what a revisit lacks comes from its metadata and header."""
    field = lambda name: F.regexp_extract("metadata.fields", rf"(?m)^{name}: (-?[0-9]+)", 1).try_cast("long")
    return assembled.select(
        field("page-id").alias("page_id"), F.coalesce("response.payload_bytes", field("payload-bytes")).alias("payload_bytes"),
        F.coalesce("response.payload_digest", "response.declared_digest").alias("payload_digest"), F.col("response.kind").alias("record_type"),
        F.regexp_extract("response.refers_to", r"(-?[0-9]+)$", 1).try_cast("long").alias("refers_to"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    ws = Workspace(spark, "warc")
    path = f"{ws.root}/archives"
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    write(plan_revisits(pages), path, *file_limits(pages))
    return captures(assemble(read(spark, path, with_payload=False)))


ORACLE = """
WITH p AS (SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT payload_digest, min(page_id) AS first FROM p WHERE payload_bytes >= 100 GROUP BY 1)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN first IS NOT NULL AND first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN first <> page_id THEN first END AS refers_to
FROM p LEFT JOIN f USING (payload_digest)
"""
