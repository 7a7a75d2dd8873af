"""WARC records kept as a content-addressed archive: payloads once, exact headers apart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabloom.llm.common import text_of
from tabloom.operators.shared import quoted

#: RFC 4648.
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
END = "\r\n"


def base32_sha1(payload: Column) -> Column:
    """SHA-1 of bytes as 32 base-32 letters: five hex digits are four letters."""
    digest, letters = F.sha1(payload), []
    for group in range(8):
        value = F.conv(F.substring(digest, 5 * group + 1, 5), 16, 10).cast("int")
        for shift in (15, 10, 5, 0):
            at = F.shiftright(value, shift).bitwiseAND(F.lit(31)) + F.lit(1)
            letters.append(F.lit(BASE32).substr(at, F.lit(1)))
    return F.concat(*letters)


def _record_id(key: Column, url: Column, digest: Column, copy: Column) -> Column:
    """A urn:uuid (version 5 form) that the record decides: key, URL, payload, and number among equal rows."""
    named = F.to_json(F.struct(key.cast("string").alias("key"), url.alias("url"), digest.alias("digest"), copy.alias("copy")))
    d = F.sha1(F.concat(F.lit("record:"), named))
    parts = [F.substring(d, 1, 8), F.substring(d, 9, 4), F.concat(F.lit("5"), F.substring(d, 14, 3)), F.concat(F.lit("a"), F.substring(d, 18, 3)), F.substring(d, 21, 12)]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))


def _field(name: str, value: Column) -> Column:
    """A header line, or nothing for a null value; control characters are percent-coded."""
    clean = F.regexp_replace(F.regexp_replace(F.regexp_replace(value, "\r", "%0D"), "\n", "%0A"), r"[\x00-\x1F\x7F]", "%20")
    return F.coalesce(F.concat(F.lit(f"{name}: "), clean, F.lit(END)), F.lit(""))


def write_archive(
    pages: DataFrame, folder: str, key: str = "page_id", url: str = "url", payload: str = "html", date: str = "2024-01-01T00:00:00Z", least: int = 0
) -> None:
    """Write one WARC record for every row below ``folder``: ``payloads`` and ``headers``.

    ``payloads`` (digest, n_bytes, payload) holds the bytes of every different payload once,
    found by SHA-256. A digest is verified before its bytes are shared: rows of one digest
    must agree in length and in two further hashes, or the write fails. ``headers`` (key, digest, header) holds each record's exact header text: the
    WARC fields and, after them, the HTTP header. Of rows with equal payloads of at
    least ``least`` bytes the one with the smallest key is a response and the others
    revisit it; rows below that are all responses.

    A null payload is empty. Null URLs leave out the field. Null keys sort last. Rows that
    repeat a key are records of their own (a repeated first key is a response each time) with
    ids of their own, also where they are equal in all.
    An empty table gives empty tables. Extra columns are ignored. Copies of
    one payload are combined before the shuffle, so a payload that a third of all pages
    share moves once per task.
    """
    body = F.encode(text_of(payload), "UTF-8")
    rows = pages.select(quoted(key).alias("_tl_key"), (quoted(url).cast("string") if url in pages.columns else F.lit(None).cast("string")).alias("_tl_url"), body.alias("payload"))
    stamped = rows.select("*", F.sha2("payload", 256).alias("digest"), F.octet_length("payload").cast("long").alias("n_bytes"))
    checks = [F.crc32("payload"), F.xxhash64("payload")]
    seal = F.struct("n_bytes", *[c.alias(f"h{i}") for i, c in enumerate(checks)])
    kept = stamped.groupBy("digest").agg(F.min(seal).alias("low"), F.max(seal).alias("high"), F.first("payload").alias("payload"))
    sealed = F.when(F.col("low") == F.col("high"), F.col("payload")).otherwise(F.raise_error(F.concat(F.lit("two payloads have the digest "), F.col("digest"))).cast("binary"))
    kept.select("digest", F.col("low.n_bytes").alias("n_bytes"), sealed.alias("payload")).write.option("compression", "zstd").parquet(f"{folder}/payloads")

    narrow = stamped.select("_tl_key", "_tl_url", "digest", "n_bytes", base32_sha1(F.col("payload")).alias("sha1"))
    # Equal rows are numbered without a window: they are counted, and as many made of each.
    equal = narrow.groupBy(*narrow.columns).agg(F.count(F.lit(1)).alias("n"))
    numbered = equal.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("n").cast("int")))).drop("n")
    lowest = F.min(F.struct(F.col("_tl_key").isNull().alias("none"), "_tl_key", "_tl_url"))
    firsts = narrow.groupBy("digest").agg(lowest.alias("f")).select("digest", F.col("f._tl_key").alias("first"), F.col("f._tl_url").alias("first_url"))
    joined = numbered.join(firsts, "digest")
    again = (F.col("n_bytes") >= least) & ~F.col("_tl_key").eqNullSafe(F.col("first"))
    kind = F.when(again, "revisit").otherwise("response")
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{END}Content-Type: text/html; charset=utf-8{END}Content-Length: "), F.col("n_bytes").cast("string"), F.lit(END + END))
    length = F.octet_length(http) + F.when(again, F.lit(0)).otherwise(F.col("n_bytes"))
    header = F.concat(
        F.lit(f"WARC/1.1{END}"), _field("WARC-Type", kind), _field("WARC-Record-ID", _record_id(F.col("_tl_key"), F.col("_tl_url"), F.col("digest"), F.col("copy"))), _field("WARC-Date", F.lit(date)),
        _field("WARC-Target-URI", F.col("_tl_url")), _field("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))),
        _field("WARC-Profile", F.when(again, F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))),
        _field("WARC-Refers-To", F.when(again, _record_id(F.col("first"), F.col("first_url"), F.col("digest"), F.lit(1)))), _field("Key", F.col("_tl_key").cast("string")),
        _field("Refers-To-Key", F.when(again, F.col("first").cast("string"))), _field("Content-Type", F.lit("application/http; msgtype=response")),
        _field("Content-Length", length.cast("string")), F.lit(END), http,
    )
    joined.select(F.col("_tl_key").alias("key"), "digest", header.alias("header")).write.option("compression", "zstd").parquet(f"{folder}/headers")


def read_archive(spark: SparkSession, folder: str, key_type: str = "bigint") -> DataFrame:
    """One row per record: key, digest, header and what the header's fields say.

    Columns: key, record_type, refers_to (null for responses), payload_digest, url,
    payload_bytes, header. Every stored payload is hashed again and measured: a
    payload that is not that of its digest, or not that of the header, fails the read.
    """
    schema = T.StructType([T.StructField("digest", T.StringType()), T.StructField("n_bytes", T.LongType()), T.StructField("payload", T.BinaryType())])
    stored = spark.read.schema(schema).parquet(f"{folder}/payloads")
    same = (F.sha2("payload", 256) == F.col("digest")) & (F.octet_length("payload") == F.col("n_bytes"))
    stored = stored.select("digest", "n_bytes", F.when(same, base32_sha1(F.col("payload"))).otherwise(F.raise_error(F.concat(F.lit("a payload has changed: "), F.col("digest")))).alias("sha1"))
    headers = spark.read.schema(f"key {key_type}, digest string, header string").parquet(f"{folder}/headers")

    def said(name: str) -> Column:
        value = F.regexp_extract("header", rf"\r\n{name}: ([^\r\n]*)\r\n", 1)
        return F.when(value != "", value)

    fits = F.col("payload_digest") == F.concat(F.lit("sha1:"), F.col("sha1"))
    rows = headers.join(stored, "digest").withColumn("payload_digest", said("WARC-Payload-Digest"))
    digest = F.when(fits, F.col("sha1")).otherwise(F.raise_error(F.concat(F.lit("header and payload differ: "), F.col("digest"))))
    return rows.select(
        said("Key").cast(key_type).alias("key"), said("WARC-Type").alias("record_type"), said("Refers-To-Key").cast(key_type).alias("refers_to"),
        digest.alias("payload_digest"), said("WARC-Target-URI").alias("url"), F.col("n_bytes").alias("payload_bytes"), "digest", "header",
    )


def records(spark: SparkSession, folder: str, key_type: str = "bigint") -> DataFrame:
    """(key, record): the exact bytes of every WARC record, header joined to payload.

    Revisits carry no payload. Concatenated in any order the records are a WARC file.
    """
    headers = spark.read.schema(f"key {key_type}, digest string, header string").parquet(f"{folder}/headers")
    stored = spark.read.schema("digest string, n_bytes bigint, payload binary").parquet(f"{folder}/payloads")
    whole = F.col("header").contains("\r\nWARC-Type: response\r\n")
    body = F.when(whole, F.col("payload")).otherwise(F.lit(b""))
    return headers.join(stored, "digest").select("key", F.concat(F.encode("header", "UTF-8"), body, F.lit((END + END).encode())).alias("record"))
