"""Content-addressed web archive.

Payload bytes are stored once per SHA-256 digest, record headers byte for byte in
a table of their own.  Reading joins the two again; every stored payload is
hashed anew, and one that differs from its digest or length stops the job.  Of
the records with one payload the one with the smallest page id is the response,
the others are revisits that name it.

WARC files come from the same records: `write_warc` lets Spark's text writer put
the records, each ended by two line breaks, into .warc files, and `read_warc`
cuts such files by their records' Content-Length.

Defined results: a null payload counts as an empty one, a very long one is stored
whole; null ids come last, so
that such a page is the response only if all its copies lack an id; of repeated
rows with one id and payload one is the response and the others revisit that id;
an empty table gives an empty archive; other columns, whatever their names, are
not archived.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Alphabet of base 32; fixed values.
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
#: Fixed values of the format.
VERSION, END = "WARC/1.1", "\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32_sha1(data: Column) -> Column:
    """SHA-1 of bytes in upper-case base 32: each five hexadecimal digits are four letters."""
    digits = F.sha1(data)
    letters = []
    for group in range(8):
        value = F.conv(F.substring(digits, 5 * group + 1, 5), 16, 10).cast("int")
        for shift in (15, 10, 5, 0):
            at = F.shiftright(value, shift).bitwiseAND(F.lit(31)) + 1
            letters.append(F.substring(F.lit(BASE32), at, F.lit(1)))
    return F.concat(*letters)


def records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """One record per page: page_id, url, digest (SHA-256), payload_digest, payload_bytes and the payload."""
    payload = F.coalesce(F.col(payload_col).cast("binary"), F.lit("").cast("binary"))
    return pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"), F.lit(date).alias("date"), payload.alias("payload")).select(
        "*",
        F.sha2("payload", 256).alias("digest"),
        base32_sha1(F.col("payload")).alias("payload_digest"),
        F.octet_length("payload").cast("long").alias("payload_bytes"),
    )


def typed(found: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Records without payload, with record_type and refers_to.

    Payloads of fewer than least_bytes bytes are never revisited.  The rows that
    are shuffled carry digests, not payloads.
    """
    slim = found.drop("payload")
    big = F.col("payload_bytes") >= least_bytes
    holders = slim.groupBy(F.col("digest").alias("_digest")).agg(F.min("page_id").alias("_holder"))
    ties = Window.partitionBy("digest", "page_id").orderBy(F.xxhash64("url"), "url")
    numbered = slim.withColumn("_copy", F.row_number().over(ties) - 1)
    is_response = ~big | (F.col("page_id").eqNullSafe(F.col("_holder")) & (F.col("_copy") == 0))
    return (
        numbered.join(holders, F.col("digest") == F.col("_digest"))
        .withColumn("record_type", F.when(is_response, "response").otherwise("revisit"))
        .withColumn("refers_to", F.when(~is_response, F.col("_holder")))
        .drop("_digest", "_holder")
    )


def clean(value: Column) -> Column:
    """A header value: line breaks and percent signs are percent-encoded, null is empty."""
    text = F.coalesce(value.cast("string"), F.lit(""))
    return F.replace(F.replace(F.replace(text, F.lit("%"), F.lit("%25")), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))


def record_id(page: Column, copy: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page.cast("string"), F.lit("null")), F.when(copy > 0, F.concat(F.lit(":"), copy.cast("string"))).otherwise(""), F.lit(">"))


def header(rows: DataFrame) -> Column:
    """The exact header of each typed record, with its closing empty line."""
    revisit = F.col("record_type") == "revisit"
    lines = [
        F.lit(VERSION),
        F.concat(F.lit("WARC-Type: "), F.col("record_type")),
        F.concat(F.lit("WARC-Record-ID: "), record_id(F.col("page_id"), F.col("_copy"))),
        F.concat(F.lit("WARC-Date: "), F.col("date")),
        F.concat(F.lit("WARC-Target-URI: "), clean(F.col("url"))),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("payload_digest")),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: "), record_id(F.col("refers_to"), F.lit(0)))),
        F.when(revisit, F.lit(f"WARC-Profile: {PROFILE}")),
        F.lit("Content-Type: text/html; charset=utf-8"),
        F.concat(F.lit("Content-Length: "), F.when(revisit, F.lit(0)).otherwise(F.col("payload_bytes")).cast("string")),
        F.lit(END),
    ]
    return F.concat_ws(END, *lines).cast("binary")


def archive(pages: DataFrame, path: str, **columns: str) -> None:
    """Write pages to the archive at path: `headers` per record and `payloads` per digest."""
    spark = pages.sparkSession
    found = records(pages, **columns)
    rows = typed(found)
    rows.select("digest", F.col("payload_bytes"), header(rows).alias("header")).write.parquet(f"{path}/headers")
    # any payload of a digest will do, as it is checked when read; copies go before the shuffle already
    found.groupBy("digest").agg(F.any_value("payload").alias("payload")).write.parquet(f"{path}/payloads")


def field(name: str) -> Column:
    """A header line's value, null where the line is missing."""
    found = F.regexp_extract(F.col("header").cast("string"), rf"\n{name}: ([^\r\n]*)\r\n", 1)
    return F.when(found != "", found)


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """The records of an archive, rebuilt by joining headers and payloads.

    header and payload give a record's original bytes; the other columns are read
    from the header or computed from the stored payload, which is verified first; a
    header whose digest or length does not fit its block stops the job.
    """
    stored = spark.read.parquet(f"{path}/payloads")
    sound = F.sha2("payload", 256) == F.col("digest")
    checked = stored.select(
        F.when(sound, F.col("digest")).otherwise(F.raise_error(F.concat(F.lit("payload differs from its digest "), F.col("digest")))).alias("_digest"),
        "payload",
        base32_sha1(F.col("payload")).alias("payload_digest"),
        F.octet_length("payload").cast("long").alias("stored_bytes"),
    )
    page = F.regexp_extract(field("WARC-Record-ID"), r"^<urn:page:([^:>]*)", 1)
    refers = F.regexp_extract(field("WARC-Refers-To"), r"^<urn:page:([^:>]*)", 1)
    heads = spark.read.parquet(f"{path}/headers").select(
        "digest", "header", "payload_bytes", page.alias("page"), field("WARC-Type").alias("record_type"), refers.alias("refers"),
        F.substring(field("WARC-Payload-Digest"), 6, 32).alias("_declared"), field("Content-Length").cast("long").alias("_length"),
    )
    found = heads.join(checked, F.col("digest") == F.col("_digest"), "left")
    block = F.when(F.col("record_type") == "response", F.col("stored_bytes")).otherwise(F.lit(0))
    intact = (F.col("stored_bytes") == F.col("payload_bytes")) & (F.col("_declared") == F.col("payload_digest")) & (F.col("_length") == block)
    return found.select(
        F.when(F.col("page") != "null", F.col("page")).alias("page_id"),
        F.when(intact, F.col("stored_bytes")).otherwise(F.raise_error(F.concat(F.lit("no sound payload for "), F.col("digest")))).alias("payload_bytes"),
        "payload_digest",
        "record_type",
        F.when(F.col("refers") != "null", F.col("refers")).alias("refers_to"),
        "header",
        "payload",
    )


def write_warc(spark: SparkSession, archive_path: str, path: str, records_per_file: int = 2000, compression: str = "none") -> None:
    """Export an archive as WARC files; a revisit's block is empty."""
    rows = read_archive(spark, archive_path)
    block = F.when(F.col("record_type") == "response", F.col("payload")).otherwise(F.lit("").cast("binary"))
    text = F.concat(F.col("header"), block).cast("string")
    rows.select(text.alias("value")).write.option("lineSep", END * 2).option("maxRecordsPerFile", records_per_file).option("compression", compression).text(path)


def split_records(data: bytes) -> Iterator[tuple[bytes, bytes]]:
    """Header (with its closing empty line) and block of every record in the bytes of a WARC file."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at) + 4
        head = data[at:end]
        sizes = [x for x in head.split(b"\r\n") if x.lower().startswith(b"content-length:")]
        size = int(sizes[0].split(b":")[1])
        if data[end + size : end + size + 4] != b"\r\n\r\n":
            raise ValueError(f"record at byte {at} does not end where its length says")
        yield head, data[end : end + size]
        at = end + size + 4


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Records of WARC files, plain or gzip: header and block, each as bytes.  A task holds one file at a time."""
    import gzip

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                data = content.as_py()
                found = list(split_records(gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data))
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.binary()) for k in (0, 1)], names=["header", "block"])

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(cut, "header binary, block binary")
