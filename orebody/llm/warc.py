"""Content-addressed web archive.

Two tables make an archive: ``payloads`` holds each distinct payload once under its
SHA-256, ``headers`` holds the exact record headers of every record together with that
address.  Records are rebuilt by joining the two, and the payload's digests are computed
again on the way out and held against the stored ones.

Defined results: a null html is an empty payload and an ordinary payload like any other;
a null page_id or url is kept as null (the header line of a url is empty, control
characters of one are percent-encoded there); of equal payloads the largest page_id is the
response, so rows that repeat both page_id and payload are all responses, each a record
with an id of its own; an empty table gives an empty archive.  Columns other than page_id,
url and html are ignored.
"""

from __future__ import annotations

import uuid
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import columns, scratch

#: Digits of base 32 as Spark's conv() writes them and as RFC 4648 does.
CONV_DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUV"
BASE32_DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
CRLF = "\r\n"
#: Fixed value: the profile of a revisit whose payload is the same.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 of SHA-1: eight runs of five hex digits are four base-32 digits each."""
    hexed = F.sha1(payload)
    runs = [F.lpad(F.conv(F.substring(hexed, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*runs), CONV_DIGITS, BASE32_DIGITS)


def record_id(address: Column, number: Column, run: str) -> Column:
    """A name that no other record has: a hash of the archive, the payload's address and the record's number, as a UUID."""
    hexed = F.md5(F.concat_ws("|", F.lit(run), address, number.cast("string")))
    groups = [F.substring(hexed, at, size) for at, size in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *groups), F.lit(">"))


def one_line(text: Column) -> Column:
    """A header's value: line ends and other control characters are percent-encoded, so that none ends the line."""
    out = F.coalesce(text, F.lit(""))
    for code in (*range(32), 127):
        out = F.replace(out, F.lit(chr(code)), F.lit(f"%{code:02X}"))
    return out


def http_text() -> Column:
    """The header block of the response that stands before the payload."""
    return F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=UTF-8{CRLF}Content-Length: "), F.col("payload_bytes").cast("string"), F.lit(CRLF * 2))


def header_text(kind: Column, captured: str) -> Column:
    """The WARC/1.1 header block of a record, as it stands in a file."""
    def line(name: str, value: Column) -> Column:
        return F.concat(F.lit(f"{name}: "), F.coalesce(value, F.lit("")), F.lit(CRLF))

    revisit = F.col("refers_id").isNotNull()
    block = F.octet_length("http") + F.when(kind == "response", F.col("payload_bytes")).otherwise(0)
    return F.concat(
        F.lit("WARC/1.1" + CRLF),
        line("WARC-Type", kind),
        line("WARC-Record-ID", F.col("record_id")),
        line("WARC-Date", F.lit(captured)),
        line("WARC-Target-URI", one_line(F.col("url"))),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        F.when(revisit, F.concat(line("WARC-Refers-To", F.col("refers_id")), line("WARC-Profile", F.lit(PROFILE)))).otherwise(F.lit("")),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", block.cast("string")),
        F.lit(CRLF),
    )


def write_archive(pages: DataFrame, path: str, minimum: int = 0, captured: str | None = None) -> None:
    """Write ``pages`` (page_id, url, html) as an archive below ``path``; ``captured`` is the date of its records, now if none is given.

    Only addresses are grouped, never payloads: the digests are aggregated (with partial
    sums, so a payload with a third of all rows costs no more), and the payload rows that
    stand for their group are then picked by a semi-join on page_id.
    """
    spark = pages.sparkSession
    captured = captured or datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    rows = columns(pages, page_id="long", url="string", html="string")
    payload = F.encode(F.coalesce(F.col("html"), F.lit("")), "UTF-8")
    rows = rows.select("page_id", "url", payload.alias("payload"))
    # numbers need only differ; they are written once
    records = rows.select("page_id", "url", F.sha2("payload", 256).alias("address"), base32_sha1(F.col("payload")).alias("payload_digest"), F.length("payload").cast("long").alias("payload_bytes"), F.monotonically_increasing_id().alias("number"))
    records.write.option("compression", "zstd").parquet(f"{path}/records")
    records = spark.read.schema(records.schema).parquet(f"{path}/records")
    firsts = records.groupBy("address").agg(F.max(F.struct("page_id", "number")).alias("first")).select("address", F.col("first.page_id").alias("first_id"), F.col("first.number").alias("first_number"))
    firsts.write.option("compression", "zstd").parquet(f"{path}/addresses")
    firsts = spark.read.schema(firsts.schema).parquet(f"{path}/addresses")

    # the row of the first id brings the bytes; rows that repeat it fall together on the same key
    kept = rows.withColumn("address", F.sha2("payload", 256))
    chosen = firsts.select("address", F.col("first_id").alias("page_id"))
    known, unknown = kept.where("page_id IS NOT NULL"), kept.where("page_id IS NULL")
    stored = known.join(chosen, ["address", "page_id"], "left_semi").dropDuplicates(["address", "page_id"]).select("address", "payload")
    # payloads of which no record has an id
    orphans = unknown.join(firsts.where("first_id IS NULL"), "address", "left_semi").dropDuplicates(["address"]).select("address", "payload")
    stored.unionByName(orphans).write.option("compression", "zstd").parquet(f"{path}/payloads")

    # both sides are plain shuffles on the address, so AQE splits the partition of a hot payload
    heads = records.join(firsts, "address", "left")
    same = F.col("page_id").eqNullSafe(F.col("first_id")) | (F.col("payload_bytes") < F.lit(minimum))
    kind = F.when(same, F.lit("response")).otherwise(F.lit("revisit"))
    run = uuid.uuid4().hex
    heads = heads.withColumns({"refers_to": F.when(~same, F.col("first_id")), "refers_id": F.when(~same, record_id(F.col("address"), F.col("first_number"), run)), "record_id": record_id(F.col("address"), F.col("number"), run), "http": http_text()})
    heads = heads.select("page_id", "url", "address", "payload_digest", "payload_bytes", kind.alias("record_type"), "refers_to", "record_id", header_text(kind, captured).alias("header"), "http")
    heads.write.option("compression", "zstd").parquet(f"{path}/headers")


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """Every record rebuilt by the join of its headers with its payload.

    record: the bytes of a response as they stand in a file; of a revisit, with the payload
    that it refers to in place.  The payload is cut from those bytes, measured again and held
    against the stored address and digest (``sound``); a record whose payload is missing is not.
    """
    heads = spark.read.parquet(f"{path}/headers")
    payloads = spark.read.parquet(f"{path}/payloads").withColumnRenamed("payload", "stored")
    # AQE splits the partition of a hot payload
    whole = heads.join(payloads, "address", "left")
    before = F.concat(F.encode("header", "UTF-8"), F.encode("http", "UTF-8"))
    whole = whole.withColumn("record", F.concat(before, F.col("stored"), F.encode(F.lit(CRLF * 2), "UTF-8"))).drop("stored")
    start = F.octet_length("header") + F.octet_length("http")
    whole = whole.withColumn("payload", F.substring(F.col("record"), start + 1, F.octet_length("record") - start - 4))
    whole = whole.withColumns({"found_digest": base32_sha1(F.col("payload")), "found_bytes": F.length("payload").cast("long")})
    sound = (F.sha2("payload", 256) == F.col("address")) & (F.col("found_digest") == F.col("payload_digest")) & (F.col("found_bytes") == F.col("payload_bytes"))
    return whole.withColumn("sound", F.coalesce(sound, F.lit(False)))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "warc")
    write_archive(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    back = read_archive(spark, path)
    # what a broken record measures is not reported
    digest, size = F.when(F.col("sound"), F.col("found_digest")), F.when(F.col("sound"), F.col("found_bytes"))
    return back.select("page_id", size.alias("payload_bytes"), digest.alias("payload_digest"), "record_type", "refers_to")


#: DuckDB has no base 32; the digits are cut from SHA-1's hex, five bits at a time.
ORACLE = f"""
WITH p AS (
  SELECT page_id, octet_length(encode(COALESCE(html, '')))::BIGINT AS payload_bytes, sha1(COALESCE(html, '')) AS hexed, sha256(COALESCE(html, '')) AS address FROM pages),
d AS (
  SELECT page_id, payload_bytes, address,
         list_reduce(list_transform(range(32), lambda i:
           '{BASE32_DIGITS}'[1 + ((('0x' || substr(hexed, 1 + 5 * (i // 4)::INT, 5))::BIGINT >> (15 - 5 * (i % 4)::INT)) & 31)::INT]), lambda a, b: a || b) AS payload_digest
  FROM p),
f AS (SELECT address, MAX(page_id) AS first_id FROM d GROUP BY address)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = first_id THEN NULL ELSE first_id END AS refers_to
FROM d JOIN f USING (address)
"""
