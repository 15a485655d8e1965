"""A content-addressed web archive.

Payload bytes are stored once, under their SHA-256, which is checked whenever
they are read.  Record headers are stored apart, byte for byte, one row per
record.  A join of the two gives the original records back; a payload that
many records share is stored by the first of them (a ``response``), the others
are ``revisit`` records that refer to it.
"""

from __future__ import annotations

import gzip
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm.skew import join_groups
from larkspur.llm.workspace import Scratch, shared_dir

#: Payloads that are broadcast to a hot group's records: fewer than this.
HOT_PAYLOADS = 64


@dataclass(frozen=True)
class Archive:
    """Where an archive's two tables lie."""

    path: str

    @property
    def payloads(self) -> str:
        return f"{self.path}/payloads"

    @property
    def headers(self) -> str:
        return f"{self.path}/headers"


def base32_sha1(data: Column) -> Column:
    """Bare upper-case base32 of the SHA-1: five hex digits at a time become four base32 digits."""
    digits = F.sha1(data)
    parts = [F.lpad(F.conv(F.substring(digits, 1 + 5 * i, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def record_id(page_id: Column) -> Column:
    return F.concat(F.lit("<urn:larkspur:page:"), F.coalesce(page_id.cast("string"), F.lit("none")), F.lit(">"))


#: The profile of a revisit record whose payload is that of the record it refers to.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: The date of records of which none is known.
NO_DATE = "1970-01-01T00:00:00Z"


def _header(row_type: Column, refers: Column, date: str) -> Column:
    """The header block of a record, up to its empty line; a url with line ends has them escaped, and stands in a field of its own as well."""
    def line(name: str, value: Column) -> Column:
        return F.when(value.isNotNull(), F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))).otherwise("")

    broken = F.col("url").rlike(r"[\r\n]")
    target = F.replace(F.replace(F.col("url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    return F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", row_type),
        line("WARC-Record-ID", record_id(F.col("page_id"))),
        line("WARC-Date", F.lit(date)),
        line("WARC-Target-URI", target),
        line("Target-URI-Base64", F.when(broken, F.base64(F.encode("url", "UTF-8")))),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))),
        line("WARC-Profile", F.when(row_type == "revisit", PROFILE)),
        line("WARC-Refers-To", F.when(refers.isNotNull(), record_id(refers))),
        line("Content-Type", F.lit("text/html")),
        line("Content-Length", F.col("size").cast("string")),
        F.lit("\r\n"),
    )


def write(pages: DataFrame, path: str | None = None, least: int = 0, date: str = NO_DATE) -> Archive:
    """Writes an archive of ``pages`` (page_id, url, html).

    The payload is html in UTF-8, null counting as empty.  Of records with
    equal payloads of at least ``least`` bytes the one with the smallest
    page_id is the response (null ids come last; of repeated ids the one with
    the least url, a null url counting as empty, and of rows alike in both any
    one); smaller payloads are stored once too, but all their records are
    responses.  Very long payloads and urls are kept whole; other columns are
    ignored.  An empty table gives an empty archive.
    """
    spark = pages.sparkSession
    at = Archive(path or f"{shared_dir(spark)}/larkspur/warc-{uuid.uuid4().hex}")
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    rows = pages.select("page_id", "url", payload.alias("payload")).select("*", F.sha2("payload", 256).alias("sha256"))
    with Scratch(spark) as scratch:
        slim = scratch.stage(rows.select("page_id", "url", "sha256", base32_sha1(F.col("payload")).alias("sha1"), F.octet_length("payload").cast("long").alias("size")))
        # copies fold before the one shuffle of payloads
        rows.select("sha256", "payload").dropDuplicates(["sha256"]).write.option("compression", "zstd").parquet(at.payloads)
        url = F.coalesce("url", F.lit(""))
        order = F.struct(F.col("page_id").isNull().alias("none"), "page_id", url.alias("url"))
        firsts = slim.groupBy("sha256").agg(F.min(order).alias("first"), F.count("*").alias("n")).select("sha256", F.col("first.page_id").alias("first"), F.col("first.url").alias("first_url"), "n")
        placed = scratch.stage(join_groups(slim, scratch.stage(firsts), ["sha256"], "n", slim.count()))
        is_first = F.col("page_id").eqNullSafe(F.col("first")) & (url == F.col("first_url")) & (F.col("size") >= least)
        alike = placed.filter(is_first).groupBy("sha256").agg(*[F.first(c).alias(c) for c in placed.columns if c != "sha256"], F.count("*").alias("alike"))
        alike = scratch.stage(alike.select(*placed.columns, "alike"))  # one row for each payload
        again = alike.filter("alike > 1").select(*placed.columns, F.explode(F.sequence(F.lit(2).cast("long"), F.col("alike"))).alias("again")).drop("again")
        response = alike.drop("alike").unionByName(placed.filter(F.col("size") < least)).withColumn("kind", F.lit("response"))
        revisit = again.unionByName(placed.filter(~is_first & (F.col("size") >= least))).withColumn("kind", F.lit("revisit"))
        refers = F.when(F.col("kind") == "revisit", F.col("first"))
        heads = response.unionByName(revisit).select("sha256", F.encode(_header(F.col("kind"), refers, date), "UTF-8").alias("header"))
        heads.write.option("compression", "zstd").parquet(at.headers)
    return at


def records(spark: SparkSession, archive: Archive) -> DataFrame:
    """The archive's records: header (bytes), payload (bytes) and sha256; each payload is checked against its digest.

    A payload of a large part of the records is broadcast, the others are shuffled.
    """
    headers = spark.read.schema("sha256 string, header binary").parquet(archive.headers)
    payloads = spark.read.schema("sha256 string, payload binary").parquet(archive.payloads)
    checked = payloads.withColumn("payload", F.when(F.sha2("payload", 256) == F.col("sha256"), F.col("payload")).otherwise(F.raise_error(F.lit("a payload does not have its digest")).cast("binary")))
    sizes = headers.groupBy("sha256").agg(F.count("*").alias("n"))
    return join_groups(headers, checked.join(sizes, "sha256"), ["sha256"], "n", headers.count(), HOT_PAYLOADS).select("sha256", "header", "payload")


def field(name: str) -> Column:
    """A named field of the record's header; null if it has none."""
    found = F.regexp_extract(F.col("head"), rf"(?:^|\r\n){name}: ([^\r\n]*)", 1)
    return F.when(F.col("head").contains(f"\r\n{name}: "), found)


def page_of(value: Column) -> Column:
    return F.regexp_extract(value, r"^<urn:larkspur:page:(-?\d+)>$", 1).try_cast("long")


def read(spark: SparkSession, archive: Archive) -> DataFrame:
    """Parses the records: page_id, url, html, payload, payload_bytes, payload_digest, record_type, refers_to.

    The digest is computed from the payload that was read, and must be the header's, as must the length.
    """
    rows = records(spark, archive).withColumn("head", F.decode("header", "UTF-8"))
    rows = rows.withColumns({"payload_digest": base32_sha1(F.col("payload")), "payload_bytes": F.octet_length("payload").cast("long")})
    true = (field("WARC-Payload-Digest") == F.concat(F.lit("sha1:"), F.col("payload_digest"))) & (field("Content-Length").cast("long") == F.col("payload_bytes"))
    checked = F.when(true, field("WARC-Type")).otherwise(F.raise_error(F.lit("a record does not match its header")).cast("string"))
    return rows.select(
        page_of(field("WARC-Record-ID")).alias("page_id"), F.coalesce(F.decode(F.unbase64(field("Target-URI-Base64")), "UTF-8"), field("WARC-Target-URI")).alias("url"), F.decode("payload", "UTF-8").alias("html"),
        "payload", "payload_bytes", "payload_digest", checked.alias("record_type"), page_of(field("WARC-Refers-To")).alias("refers_to"),
    )


def export(spark: SparkSession, archive: Archive, path: str, per_file: int = 20_000) -> None:
    """Writes WARC files of at most ``per_file`` records: each one's header, and its payload unless it is a revisit, then two line ends."""
    rows = records(spark, archive).withColumn("head", F.decode("header", "UTF-8"))
    revisit = field("WARC-Type") == "revisit"
    head = F.when(revisit, F.regexp_replace("head", r"\r\nContent-Length: \d+", "\r\nContent-Length: 0")).otherwise(F.col("head"))
    body = F.when(revisit, "").otherwise(F.decode("payload", "UTF-8"))
    out = rows.select(F.concat(head, body).alias("value")).write.option("lineSep", "\r\n\r\n").option("compression", "gzip")
    out.option("maxRecordsPerFile", per_file).text(path)


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cuts files into records by the length that each header states."""
    for batch in batches:
        for packed in batch["content"]:
            data, at, heads, bodies = gzip.decompress(packed.as_py()), 0, [], []
            while at < len(data):
                end = data.index(b"\r\n\r\n", at) + 4
                size = int(data[at:end].rpartition(b"\r\nContent-Length: ")[2].split(b"\r\n", 1)[0])
                heads.append(data[at:end])
                bodies.append(data[end : end + size])
                if data[end + size : end + size + 4] != b"\r\n\r\n":
                    raise ValueError("a record does not end where its header says")
                at = end + size + 4
            yield pa.RecordBatch.from_arrays([pa.array(heads, pa.binary()), pa.array(bodies, pa.binary())], ["header", "payload"])


def load(spark: SparkSession, path: str) -> DataFrame:
    """The records of exported WARC files: header and payload (empty for revisits)."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content").mapInArrow(_parse, "header binary, payload binary")
