"""A content-addressed WARC archive.

The archive is two Parquet tables in one folder: `payloads` holds the bytes of each payload
once, under their SHA-256, and `headers` holds one row per record with the exact bytes of its
header block. A record is rebuilt by joining the two; readers compute the SHA-256 of the
stored bytes again and never trust the recorded one.

Of records with equal payloads of REVISIT bytes or more, the one with the largest id is a
response and the others revisit it: their WARC block is empty, their payload is the one they
refer to. Shorter payloads are stored once too, but all their records are responses.
"""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .staging import new_path

REVISIT = 1000
VERSION = "WARC/1.1"
#: The date that records carry where the table has none: archives of equal pages are equal.
DATE = "2000-01-01T00:00:00Z"
CRLF = "\r\n"


@dataclass(frozen=True)
class Archive:
    spark: SparkSession
    path: str

    def headers(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/headers")

    def payloads(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/payloads")


def record_id(page_id: F.Column) -> F.Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page_id.cast("string"), F.lit("none")), F.lit(">"))


def _clean(url: F.Column) -> F.Column:
    """A header value has no line breaks."""
    return F.regexp_replace(F.coalesce(url, F.lit("")), r"[\r\n]+", " ")


def write_archive(pages: DataFrame, path: str | None = None) -> Archive:
    """Archives pages (page_id long, url, html) and returns where.

    A null html is an empty payload, a null url an empty target, and a null page_id makes a
    record that nothing refers to (it revisits the largest id of its group, if that has any).
    Repeated rows are records of their own: the rows of the largest id are all responses.
    Other columns are not read. An empty table makes empty archives.
    """
    spark = pages.sparkSession
    path = path or new_path(spark, "warc")
    html = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), _clean(F.col("url")).alias("url"), html.alias("payload")).withColumn("digest", F.sha2("payload", 256))
    stored = rows.groupBy("digest").agg(F.first("payload").alias("payload"), F.max("page_id").alias("holder"), F.count("*").alias("copies"))
    stored.withColumn("bytes", F.octet_length("payload").cast("long")).write.option("compression", "zstd").parquet(f"{path}/payloads")
    archive = Archive(spark, path)
    known = archive.payloads().select("digest", "holder", "bytes", F.sha1("payload").alias("sha1"))
    joined = rows.select("page_id", "url", "digest").join(known, "digest")
    revisit = (F.col("bytes") >= REVISIT) & F.col("holder").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("holder"))
    lines = [
        F.lit(VERSION),
        F.when(revisit, "WARC-Type: revisit").otherwise("WARC-Type: response"),
        F.concat(F.lit("WARC-Record-ID: "), record_id(F.col("page_id"))),
        F.concat(F.lit("WARC-Target-URI: "), "url"),
        F.lit(f"WARC-Date: {DATE}"),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), "sha1"),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: "), record_id(F.col("holder")))),
        F.when(revisit, "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
        F.lit("Content-Type: text/html; charset=utf-8"),
        F.concat(F.lit("Content-Length: "), F.when(revisit, "0").otherwise(F.col("bytes").cast("string"))),
    ]
    header = F.encode(F.concat(F.concat_ws(CRLF, *lines), F.lit(CRLF)), "UTF-8")
    joined.select("digest", header.alias("header")).write.option("compression", "zstd").parquet(f"{path}/headers")
    return archive


def _field(name: str) -> F.Column:
    """A header's value; header blocks have one field a line."""
    return F.regexp_extract(F.decode("header", "UTF-8"), rf"\r\n{name}: ?([^\r\n]*)\r\n", 1)


def _page(value: F.Column) -> F.Column:
    return F.regexp_extract(value, r"^<urn:page:(-?\d+)>$", 1).try_cast("long")


def read_archive(archive: Archive) -> DataFrame:
    """The records, rebuilt: page_id, url, record_type, refers_to, payload, payload_bytes, payload_digest, verified, record.

    record is the whole WARC record: header block, empty line, block, two line breaks. verified
    says that the stored bytes have the SHA-256 they are filed under, and the header's SHA-1.
    Facts of a payload are computed once where it is stored; a plan that selects no payload
    does not move any.
    """
    stored = archive.payloads().select("digest", "payload", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha1("payload").alias("payload_digest"), (F.sha2("payload", 256) == F.col("digest")).alias("intact"))
    heads = archive.headers().select(
        "digest",
        "header",
        _page(_field("WARC-Record-ID")).alias("page_id"),
        _field("WARC-Target-URI").alias("url"),
        _field("WARC-Type").alias("record_type"),
        _page(_field("WARC-Refers-To")).alias("refers_to"),
        _field("WARC-Payload-Digest").alias("noted"),
    )
    block = F.when(F.col("record_type") == "response", F.col("payload")).otherwise(F.lit(b""))
    line = F.encode(F.lit(CRLF), "UTF-8")
    return heads.join(stored, "digest").select(
        "page_id",
        "url",
        "record_type",
        "refers_to",
        "payload",
        "payload_bytes",
        "payload_digest",
        (F.col("intact") & (F.concat(F.lit("sha1:"), "payload_digest") == F.col("noted"))).alias("verified"),
        F.concat("header", line, block, line, line).alias("record"),
    )


def export_warc(archive: Archive, path: str, files: int) -> None:
    """Writes the records as WARC files (*.txt of the text writer), whose record separator is the line separator."""
    whole = read_archive(archive).select(F.expr(f"substring(record, 1, octet_length(record) - {2 * len(CRLF)})").alias("r"))
    whole.select(F.decode("r", "UTF-8").alias("value")).repartition(files).write.option("lineSep", CRLF * 2).text(path)


def parse_warc(content: bytes) -> list[tuple[dict[str, str], bytes]]:
    """The records of one WARC file by their Content-Length: (fields, block)."""
    out, at = [], 0
    while at < len(content):
        end = content.index(b"\r\n\r\n", at)
        first, *lines = content[at:end].decode().split(CRLF)
        if not first.startswith("WARC/"):
            raise ValueError(f"no WARC record at byte {at}")
        fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines)
        start = end + 4
        at = start + int(fields["Content-Length"])
        out.append((fields, content[start:at]))
        if content[at : at + 4] != b"\r\n\r\n":
            raise ValueError(f"a record is cut short at byte {at}")
        at += 4
    return out


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, url, record_type, refers_to, block) of exported WARC files; a file is read by one task."""

    def parse(batches):  # noqa: ANN001, ANN202
        for batch in batches:
            rows = []
            for content in batch["content"]:
                for fields, block in parse_warc(content):
                    rows.append((fields["WARC-Record-ID"], fields["WARC-Target-URI"], fields["WARC-Type"], fields.get("WARC-Refers-To"), block))
            yield pd.DataFrame(rows, columns=["id", "url", "record_type", "to", "block"])

    files = spark.read.format("binaryFile").load(path).select("content")
    out = files.mapInPandas(parse, "id string, url string, record_type string, to string, block binary")
    return out.select(_page(F.col("id")).alias("page_id"), "url", "record_type", _page(F.col("to")).alias("refers_to"), "block")
