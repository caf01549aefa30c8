"""WARC archives: records of page captures written, read back and assembled.

Every page is written as a request, a response (or revisit) and a metadata record, the first
and last pointing to the second by WARC-Concurrent-To.  The archives are
gzip files written by Spark's text sink: a record is text (the payload is UTF-8), and the two
line ends that close it are the sink's separator.  Reading is general: whole-file or per-record
gzip or plain, any record types; records are framed by Content-Length, never by content.
Assembly joins the requests and metadata to their responses by identifier and gives one
nested row per capture.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldhub.llm.common import cut
from fieldhub.session import Scratch

ENDS = "\r\n"
PER_FILE = 6_000  # records of a file, at most; a reader holds one file
FILE_BYTES = 64 << 20  # payload bytes of a file, about
BASE32 = ("0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")
SAME = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
EPOCH = "1970-01-01T00:00:00Z"

_RECORD = (
    "record_id string, type string, concurrent_to string, refers_to string, uri string, "
    "payload_digest string, payload_bytes long, digest_fits boolean, block binary, fields map<string,string>"
)
_SCHEMA = pa.schema([
    ("record_id", pa.string()), ("type", pa.string()), ("concurrent_to", pa.string()), ("refers_to", pa.string()),
    ("uri", pa.string()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()),
    ("digest_fits", pa.bool_()), ("block", pa.binary()), ("fields", pa.map_(pa.string(), pa.string())),
])


def base32_sha1(payload: Column) -> Column:
    """The SHA-1 of a binary or string column in upper-case base 32 (32 characters)."""
    return _base32(F.sha1(payload))


def _base32(digits: Column) -> Column:
    """40 hexadecimal digits in upper-case base 32."""
    groups = (F.lpad(F.conv(F.substring(digits, 5 * g + 1, 5), 16, 32), 4, "0") for g in range(8))
    return F.translate(F.concat(*groups), *BASE32)


def _urn(kind: str, *identity: Column) -> Column:
    """A record id from what identifies the record; nulls differ from empty texts."""
    known = (F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit("-")) for c in identity)
    digits = F.md5(F.concat_ws("\u0001", F.lit(kind), *known))
    return F.regexp_replace(digits, r"^(.{8})(.{4})(.{4})(.{4})(.{12})$", "<urn:uuid:$1-$2-$3-$4-$5>")


def _record(kind: str, record_id: Column, uri: Column, block: Column, **headers: Column | str) -> Column:
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value if isinstance(value, Column) else F.lit(value), F.lit(ENDS))
    return F.concat(
        F.lit(f"WARC/1.1{ENDS}WARC-Type: {kind}{ENDS}"), line("WARC-Record-ID", record_id),
        line("WARC-Date", EPOCH), line("WARC-Target-URI", uri),
        *(line(name.replace("_", "-"), value) for name, value in headers.items()),
        line("Content-Length", F.octet_length(block).cast("string")), F.lit(ENDS), block,
    )


def _one_line(text: Column) -> Column:
    """A header value cannot hold line ends."""
    return F.translate(F.coalesce(text.cast("string"), F.lit("")), "\r\n", "  ")


def _captures_of(pages: DataFrame, id_col: str, url_col: str, payload_col: str, min_bytes: int) -> tuple[DataFrame, DataFrame]:
    """(rows with their payload, light rows): the pages, and per capture its owner and repeats."""
    payload = F.coalesce(F.col(payload_col).cast("string"), F.lit(""))
    named = pages.select(
        F.col(id_col).cast("long").alias("_id"), F.col(url_col).cast("string").alias("_url"), payload.alias("_payload"),
        F.sha1(payload).alias("_hex"), F.octet_length(payload).cast("long").alias("_bytes"),
    )
    rows = named.withColumn("_capture", _urn("capture", F.col("_id"), F.col("_url"), F.col("_hex")))
    light = rows.groupBy("_capture", "_id", "_url", "_hex", "_bytes").agg(
        F.count(F.lit(1)).alias("_repeats")).withColumn("_digest", _base32(F.col("_hex")))
    owners = light.groupBy(F.col("_digest").alias("_same"), F.col("_bytes").alias("_long")).agg(
        F.max(F.struct("_id", "_url", "_capture")).alias("_owner")
    )
    met = light.join(owners, (F.col("_digest") == F.col("_same")) & (F.col("_bytes") == F.col("_long")))
    own = (F.col("_capture") == F.col("_owner._capture")) | (F.col("_bytes") < min_bytes)
    return rows.select("_capture", "_payload"), met.withColumn("_own", own)


def _records(pages: DataFrame, id_col: str, url_col: str, payload_col: str, min_bytes: int) -> DataFrame:
    """(_capture, value): the three records of each capture, one after the other."""
    texts, light = _captures_of(pages, id_col, url_col, payload_col, min_bytes)
    met = texts.groupBy("_capture").agg(F.first("_payload").alias("_payload")).join(light, "_capture")
    capture, uri = F.col("_capture"), _one_line(F.col("_url"))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{ENDS}Content-Type: text/html; charset=utf-8{ENDS}Content-Length: "),
                    F.col("_bytes").cast("string"), F.lit(ENDS * 2))
    digest = F.concat(F.lit("sha1:"), F.col("_digest"))
    http_type = "application/http;msgtype=response"
    response = _record("response", capture, uri, F.concat(http, F.col("_payload")), Content_Type=http_type,
                       WARC_Payload_Digest=digest)
    revisit = _record("revisit", capture, uri, http, Content_Type=http_type, WARC_Payload_Digest=digest,
                      WARC_Profile=SAME, WARC_Refers_To=F.col("_owner._capture"))
    asked = _record("request", _urn("request", capture), uri, F.concat(F.lit("GET "), uri, F.lit(f" HTTP/1.1{ENDS * 2}")),
                    Content_Type="application/http;msgtype=request", WARC_Concurrent_To=capture)
    noted = F.concat(F.lit("page-id: "), F.coalesce(F.col("_id").cast("string"), F.lit("")),
                     F.lit(f"{ENDS}repeats: "), F.col("_repeats").cast("string"), F.lit(ENDS))
    about = _record("metadata", _urn("metadata", capture), uri, noted, Content_Type="application/warc-fields",
                    WARC_Concurrent_To=capture)
    return met.select("_capture", F.explode(F.array(asked, F.when(F.col("_own"), response).otherwise(revisit), about)).alias("value"))


def records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html",
            min_bytes: int = 0) -> DataFrame:
    """One text column ``value``: three records per capture, without the line ends that close them.

    Of pages with equal payloads of at least ``min_bytes`` the one with the largest id is a
    response, the others are revisits of it; a null id is smaller than any.  Records are named by
    the page's id, URL and payload; pages that repeat in all three are one capture, whose
    metadata says how many there were.
    """
    return _records(pages, id_col, url_col, payload_col, min_bytes).select("value")


def _files(pages: DataFrame, payload_col: str) -> int:
    """So many parts that each holds about ``FILE_BYTES``; above the number of shuffle partitions a
    multiple of it, so that a task's rows fall in few parts."""
    total = pages.agg(F.sum(F.octet_length(F.col(payload_col).cast("string")))).first()[0] or 0
    parts = max(1, -(-total // FILE_BYTES))
    tasks = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return parts if parts <= tasks else -(-parts // tasks) * tasks


def write(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html",
          min_bytes: int = 0) -> None:
    """Write the records of ``pages`` as gzip archives below the folder ``path``.

    A file holds about ``FILE_BYTES`` of payload, or one longer record, and ``PER_FILE`` records at most.
    """
    part = F.pmod(F.hash("_capture"), F.lit(_files(pages, payload_col)))
    (
        _records(pages, id_col, url_col, payload_col, min_bytes).select("value", part.alias("part"))
        .write.mode("overwrite").partitionBy("part").option("compression", "gzip")
        .option("lineSep", ENDS * 2).option("maxRecordsPerFile", PER_FILE).text(path)
    )


def _parse(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers by lower-case name, block) of each record of an archive."""
    plain = io.BytesIO(content)
    stream = io.BufferedReader(gzip.GzipFile(fileobj=plain)) if content[:2] == b"\x1f\x8b" else plain
    while version := stream.readline():
        if not version.strip():
            continue  # the line ends between records
        if not version.startswith(b"WARC/"):
            raise ValueError(f"no WARC record begins with {version[:40]!r}")
        headers = {}
        while line := stream.readline().rstrip(b"\r\n"):
            name, _, value = line.decode("utf-8", "replace").partition(":")
            headers[name.lower()] = value.strip()
        size = int(headers["content-length"])
        block = stream.read(size)
        if len(block) < size:
            raise ValueError(f"the record {headers.get('warc-record-id')} is cut off")
        yield headers, block


def _read(kinds: frozenset[str]):
    def row(headers: dict[str, str], block: bytes) -> tuple:
        kind = headers.get("warc-type", "")
        http = headers.get("content-type", "").startswith("application/http")
        payload = block.partition(b"\r\n\r\n")[2] if http else block
        digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        said = headers.get("warc-payload-digest", "").rpartition(":")[2]
        fields = []
        if headers.get("content-type") == "application/warc-fields":
            lines = block.decode("utf-8", "replace").splitlines()
            fields = sorted({k.strip(): v.strip() for k, _, v in (x.partition(":") for x in lines) if k.strip()}.items())
        return (headers.get("warc-record-id"), kind, headers.get("warc-concurrent-to"), headers.get("warc-refers-to"),
                headers.get("warc-target-uri"), said if kind == "revisit" else digest, len(payload),
                not said or kind == "revisit" or said == digest, block, fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                rows, held = [], 0
                for headers, block in _parse(batch.column(0)[i].as_py()):
                    if headers.get("warc-type") in kinds:
                        rows.append(row(headers, block))
                        held += len(block)
                    if held > 8 << 20:
                        yield _batch(rows)
                        rows, held = [], 0
                yield _batch(rows)

    return run


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[]] * len(_SCHEMA)
    return pa.RecordBatch.from_arrays(
        [pa.array(values, field.type) for values, field in zip(columns, _SCHEMA, strict=True)], schema=_SCHEMA
    )


def read(spark: SparkSession, path: str, *kinds: str) -> DataFrame:
    """The records of the given types in all archives of a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("content")
    return files.mapInArrow(_read(frozenset(kinds)), _RECORD)


def captures(spark: SparkSession, path: str) -> DataFrame:
    """(capture_id, response, request, metadata): one nested row per response or revisit.

    A request or metadata record belongs to the record it is concurrent to; of several the
    smallest identifier is nested.  A capture without them has nulls there, and records that
    are concurrent to nothing known are left out.  A record that an archive repeats is read once.
    """
    values = ("type", "uri", "refers_to", "payload_digest", "payload_bytes", "digest_fits", "block")
    answers = read(spark, path, "response", "revisit").select("record_id", *values).dropDuplicates(["record_id"])
    sides = read(spark, path, "request", "metadata").filter("concurrent_to IS NOT NULL")
    names = ("record_id", "uri", "block", "fields")
    of = {kind: F.when(F.col("type") == kind, F.col("record_id")) for kind in ("request", "metadata")}
    # a column of its own for each value, so that values nobody asks for are not carried
    first = [F.min_by(name, of[kind]).alias(f"{kind}_{name}") for kind in of for name in names]
    grouped = sides.groupBy(F.col("concurrent_to").alias("capture_id")).agg(*first)
    side = lambda kind: F.when(F.col(f"{kind}_record_id").isNotNull(), F.struct(*(F.col(f"{kind}_{n}").alias(n) for n in names)))
    met = answers.withColumnRenamed("record_id", "capture_id").join(grouped, "capture_id", "left")
    return met.select("capture_id", F.struct(*values).alias("response"), side("request").alias("request"), side("metadata").alias("metadata"))


def round_trip(pages: DataFrame, label: str = "warc", **columns) -> DataFrame:
    """(_id, _bytes, _digest, _type, _refers_to) of each row of ``pages``, read back from written archives.

    Pages that repeat in id, URL and payload have a row each, all of the one capture's type.  Sizes and digests are of the full payload: a revisit takes them from the response it refers to.
    Null payloads are empty ones.  A capture whose payload doesn't fit its digest stops the run.
    """
    spark = pages.sparkSession
    path = Scratch(spark, label).base  # a new folder of the shared one
    write(pages, path, **columns)
    found = captures(spark, path)
    sound = F.when(F.col("response.digest_fits"), F.col("response.payload_digest")).otherwise(
        F.raise_error(F.concat(F.lit("payload and digest differ: "), F.col("capture_id"))))
    light = found.select(
        "capture_id", F.try_element_at("metadata.fields", F.lit("page-id")).try_cast("long").alias("_id"),
        F.col("response.type").alias("_type"), F.col("response.refers_to").alias("_first"),
        F.col("response.payload_bytes").alias("_own_bytes"), sound.alias("_own_digest"),
        F.coalesce(F.try_element_at("metadata.fields", F.lit("repeats")).try_cast("int"), F.lit(1)).alias("_repeats"),
    )
    light = cut(light, "captures")
    first = light.filter("_type = 'response'").select(
        F.col("capture_id").alias("_at"), F.col("_id").alias("_refers_to"), F.col("_own_bytes").alias("_first_bytes"),
        F.col("_own_digest").alias("_first_digest"),
    )
    met = light.join(first, F.col("_first") == F.col("_at"), "left")
    return met.withColumn("_time", F.explode(F.sequence(F.lit(1), "_repeats"))).select(
        "_id", F.when(F.col("_type") == "revisit", F.col("_first_bytes")).otherwise(F.col("_own_bytes")).alias("_bytes"),
        F.when(F.col("_type") == "revisit", F.col("_first_digest")).otherwise(F.col("_own_digest")).alias("_digest"),
        "_type", "_refers_to",
    )
