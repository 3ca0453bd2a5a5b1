"""WARC archives: written by Spark, read back by verifying the chain of record boundaries."""

from __future__ import annotations

import base64
import gzip
import hashlib
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliate.llm.common import cut

#: Records and bytes of payload in an archive at most; a task holds one archive, and its chain takes ten rounds of pointer jumping.
ARCHIVE_RECORDS, ARCHIVE_BYTES = 1000, 256 << 20
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MAGIC = re.compile(rb"WARC/1\.[01]\r\n")


def base32(hex_digest: Column) -> Column:
    """Base32 (RFC 4648) of 40 hexadecimal digits: every 5 of them are 4 signs."""
    parts = [F.lpad(F.conv(F.substring(hex_digest, i, 5), 16, 32), 4, "0") for i in range(1, 41, 5)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def write_warc(pages: DataFrame, path: str, *, page_id: str = "page_id", url: str = "url", html: str = "html", min_bytes: int = 0, archive_records: int = ARCHIVE_RECORDS, archive_bytes: int = ARCHIVE_BYTES) -> None:
    """Writes a record a page. Of equal payloads of ``min_bytes`` or more the page with the least id is a response, the others revisit it.

    The text writer ends each row with the two line ends that end a WARC
    record, so executors write the archives, gzipped, and Spark commits them. Payloads
    are grouped by digest before anything is shuffled, and only digests that
    occur twice are joined back; a digest of a third of all pages is split by
    the skew handling of the join.

    Archives hold ``archive_records`` at most. Where pages are so large that as
    many might pass ``archive_bytes``, larger pages are written apart, fewer to
    an archive; only a page beyond ``archive_bytes`` has an archive of its own.

    A null html is an empty payload. A null url is left out, line ends in it
    become blanks. A page with a null id revisits the least id of its payload,
    and is a response where there is none; rows that share the least id are all
    responses. An empty table writes no record. Extra columns are not written.
    """
    payload = F.coalesce(F.col(html), F.lit(""))
    rows = pages.select(F.col(page_id).alias("id"), F.col(url).alias("url"), payload.alias("payload"))
    rows = rows.withColumn("digest", base32(F.sha1(F.col("payload")))).withColumn("n", F.octet_length("payload"))
    twice = rows.where(F.col("n") >= min_bytes).groupBy("digest").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("c")).where("c > 1").drop("c")
    rows = rows.join(twice, "digest", "left")
    refers = F.when((F.col("n") >= min_bytes) & F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first")), F.col("first"))

    def urn(c: Column) -> Column:
        return F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("null")), F.lit(">"))

    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("n").cast("string"), F.lit("\r\n\r\n"))
    block = F.concat(http, F.when(refers.isNull(), F.col("payload")).otherwise(""))
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), F.when(refers.isNull(), "response").otherwise("revisit"),
        F.lit("\r\nWARC-Record-ID: "), urn(F.col("id")),
        F.lit(f"\r\nWARC-Date: {DATE}"),
        F.coalesce(F.concat(F.lit("\r\nWARC-Target-URI: "), F.regexp_replace("url", r"[\r\n]+", " ")), F.lit("")),
        F.lit("\r\nWARC-Payload-Digest: sha1:"), F.col("digest"),
        F.when(refers.isNull(), "").otherwise(F.concat(F.lit("\r\nWARC-Refers-To: "), urn(refers), F.lit(f"\r\nWARC-Profile: {PROFILE}"))),
        F.lit("\r\nContent-Type: application/http;msgtype=response\r\nContent-Length: "),
    )
    record = rows.select(head.alias("head"), block.alias("block"), "n").select("n", F.concat("head", F.octet_length("block").cast("string"), F.lit("\r\n\r\n"), "block").alias("value"))
    largest = pages.agg(F.max(F.octet_length(html))).first()[0] or 0
    above, many, part = -1, archive_records, 0
    while above < largest or not part:
        upto = archive_bytes // many if many > 1 else largest
        some = record if part == 0 and upto >= largest else record.where((F.col("n") > above) & (F.col("n") <= upto))
        some.select("value").write.option("lineSep", "\r\n\r\n").option("maxRecordsPerFile", many).option("compression", "gzip").text(f"{path}/{part}")
        above, many, part = upto, max(1, many // 10), part + 1


def scan(content: bytes) -> Iterator[dict]:
    """Every place with a record's magic and a length that leads to a record's end; payloads may hold such places too."""
    for found in MAGIC.finditer(content):
        at = found.start()
        end = content.find(b"\r\n\r\n", at)
        if end < 0:
            continue
        fields: dict[str, str] = {}
        for line in content[found.end() : end].split(b"\r\n"):
            name, _, value = line.partition(b":")
            fields[name.decode("utf-8", "replace").lower()] = value.strip().decode("utf-8", "replace")
        if not fields.get("content-length", "").isdigit():
            continue
        start, size = end + 4, int(fields["content-length"])
        if content[start + size : start + size + 4] != b"\r\n\r\n":
            continue
        block = memoryview(content)[start : start + size]
        head = content.find(b"\r\n\r\n", start, start + size)
        yield {"at": at, "next": start + size + 4, "fields": fields, "http": bytes(block[: head - start]) if head >= 0 else b"", "payload": block[head + 4 - start :] if head >= 0 else block}


SCHEMA = "file string, offset long, next long, record_type string, record_id string, refers_to string, url string, payload_bytes long, payload_digest string"


def candidates(spark: SparkSession, path: str, payload: bool = False) -> DataFrame:
    """Candidate records of all archives below the path, with the offset of what follows each; with ``payload``, its text too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, content in zip(batch.column(0), batch.column(1), strict=True):
                rows = []
                data = content.as_py()
                # gzip members, one for a file or one for a record, are one stream; offsets count its bytes
                for c in scan(gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data):
                    f = c["fields"]
                    response = f.get("warc-type") != "revisit"
                    if response:
                        size, digest = len(c["payload"]), base64.b32encode(hashlib.sha1(c["payload"]).digest()).decode()
                    else:  # the block has the headers of the payload that was seen before
                        told = re.search(rb"(?i)^content-length:\s*(\d+)", c["http"], re.M)
                        size, digest = int(told[1]) if told else None, f.get("warc-payload-digest", "").removeprefix("sha1:")
                    text = [bytes(c["payload"]).decode("utf-8", "replace") if response else None] if payload else []
                    rows.append((file.as_py(), c["at"], c["next"], f.get("warc-type"), f.get("warc-record-id"), f.get("warc-refers-to"), f.get("warc-target-uri"), size, digest, *text))
                kinds = [pa.string(), pa.int64(), pa.int64(), *[pa.string()] * 4, pa.int64(), pa.string(), *[pa.string()] * payload]
                columns = list(zip(*rows, strict=True)) or [[]] * len(kinds)
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, kinds, strict=True)], names=names)

    schema = SCHEMA + (", payload string" if payload else "")
    names = [x.split()[0] for x in schema.split(", ")]
    archives = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{txt,warc,gz}").load(path)
    return archives.select("path", "content").mapInArrow(run, schema)


def reachable(links: DataFrame) -> DataFrame:
    """File and offset of the candidates on the chain that starts at each file's first byte, by pointer jumping.

    Each round marks what the marked jump to, then doubles every jump; a chain
    of n records takes log2(n) rounds, and each ends in the shared folder.
    """
    nodes = cut(links.select("file", "offset", F.col("next").alias("jump"), (F.col("offset") == 0).alias("seen")))
    longest = nodes.groupBy("file").count().agg(F.max("count")).first()[0] or 1
    for _ in range(math.ceil(math.log2(longest)) + 1 if longest > 1 else 0):
        marked = nodes.where("seen and jump is not null").select("file", F.col("jump").alias("offset"), F.lit(True).alias("_new")).distinct()
        ahead = nodes.select("file", F.col("offset").alias("jump"), F.col("jump").alias("_far"))
        nodes = cut(
            nodes.join(marked, ["file", "offset"], "left")
            .join(ahead, ["file", "jump"], "left")
            .select("file", "offset", F.col("_far").alias("jump"), (F.col("seen") | F.coalesce("_new", F.lit(False))).alias("seen"))
        )
    return nodes.where("seen").select("file", "offset")


def read_warc(spark: SparkSession, path: str, payload: bool = False) -> DataFrame:
    """The records of all archives below the path; what looks like a record inside a payload is none."""
    found = candidates(spark, path, payload)
    if not payload:
        found = cut(found)
    links = found.select(F.xxhash64("file").alias("file"), "offset", "next")
    chain = reachable(links).withColumnRenamed("file", "_file")
    return found.join(chain, (F.xxhash64(found["file"]) == chain["_file"]) & (found["offset"] == chain["offset"]), "left_semi")
