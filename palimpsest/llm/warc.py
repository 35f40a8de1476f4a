"""WARC archives as a chunked record table (operator 6).

A record is rows (record_id, chunk_no, chunks, data, running_sha1): the WARC header, block and closing blank lines, cut
after every CHUNK bytes of payload and gzipped as one member that is flushed at each cut. Records of one row are read
where they lie; the rows of longer ones are dealt out by record_id and sorted. A
payload is cut natively where it is read, and from there on only pieces move: writer and reader hold one piece and the
running state of SHA-1 and gzip, whatever the record's size. Each row carries the digest of the payload up to and with
its piece, so a reader finds the first damaged piece.

Payloads of at least min_bytes that are equal by digest have one response, that of the smallest page_id (rows without one
come last); the others are revisits without a payload that name it. Smaller ones are all responses. Pages are known by
page_id, digest and url; these are summed before they are shuffled, so a payload that a third of all pages have is a row a
task. Revisits are made from those facts alone. Pieces of payloads meet the facts by all three, never by digest alone, so
no digest is one large group; pieces of one row come from one task, and stay together where a large group is split.

Null html is an empty payload; null urls are empty. Each row gives a record, also where rows repeat a page_id or have none:
record_id, and the record's URN, are made of page_id, digest, url and a number among equal rows. Extra columns are not
read. An empty table gives no record.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm import common as c

CHUNK = 1 << 20
DATE = "2026-01-01T00:00:00Z"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
TABLE = "record_id string, chunk_no bigint, chunks bigint, data binary, running_sha1 string"
_HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {}\r\n\r\n"


def _urn(record_id: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'record:{record_id}')}>"


def _bare(url: str) -> str:
    return "".join(x if x.isprintable() and x != " " else "".join(f"%{b:02X}" for b in x.encode()) for x in url)


def _header(row: dict) -> bytes:
    digest = base64.b32encode(bytes.fromhex(row["sha1"])).decode()
    http = _HTTP.format(row["size"]).encode()
    fields = [("WARC-Type", row["type"]), ("WARC-Record-ID", _urn(row["record_id"])), ("WARC-Date", DATE), ("WARC-Target-URI", _bare(row["url"])), ("WARC-Payload-Digest", f"sha1:{digest}")]
    if row["type"] == "revisit":
        fields += [("WARC-Profile", REVISIT), ("WARC-Refers-To", _urn(row["refers_to_record"]))]
    fields += [(k, row[v]) for k, v in (("X-Refers-To-Page", "refers_to"), ("X-Page-ID", "page_id")) if row[v] is not None]
    fields += [("X-Payload-Length", row["size"]), ("Content-Type", "application/http; msgtype=response"), ("Content-Length", len(http) + (row["size"] if row["type"] == "response" else 0))]
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n").encode() + http


def write_records(batches):
    """From the pieces of payloads, those of a record together and in order, the rows of its record."""
    packer = digest = None
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            head = b""
            if row["piece"] == 0:
                packer, digest, head = zlib.compressobj(6, zlib.DEFLATED, 31), hashlib.sha1(), _header(row)
            data = row["data"] or b""
            digest.update(data)
            last = row["piece"] == row["pieces"] - 1
            packed = packer.compress(head + data + (b"\r\n\r\n" if last else b""))
            out.append((row["record_id"], row["piece"], row["pieces"], packed + packer.flush(zlib.Z_FINISH if last else zlib.Z_SYNC_FLUSH), digest.hexdigest()))
        types = (pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.string())
        yield pa.record_batch([pa.array([r[k] for r in out], t) for k, t in enumerate(types)], ["record_id", "chunk_no", "chunks", "data", "running_sha1"])


class _Record:
    """One record that is being read, piece by piece."""

    def __init__(self, record_id: str):
        self.id, self.unpacker, self.digest = record_id, zlib.decompressobj(31), hashlib.sha1()
        self.head, self.fields, self.left, self.seen, self.next = b"", None, 0, 0, 0

    def add(self, row: dict) -> None:
        if row["chunk_no"] != self.next:
            raise ValueError(f"record {self.id}: chunk {self.next} is missing")
        self.next += 1
        data = self.unpacker.decompress(row["data"])
        if self.fields is None:
            self.head += data
            if self.head.count(b"\r\n\r\n") < 2:
                return
            warc, http, data = self.head.split(b"\r\n\r\n", 2)
            lines = warc.decode().split("\r\n")
            if lines[0] != "WARC/1.1":
                raise ValueError(f"record {self.id}: not a WARC record")
            self.fields = dict(x.split(": ", 1) for x in lines[1:])
            self.left = int(self.fields["Content-Length"]) - len(http) - 4
        own = data[: self.left]
        self.left -= len(own)
        self.seen += len(own)
        self.digest.update(own)
        if self.digest.hexdigest() != row["running_sha1"] and self.fields["WARC-Type"] == "response":
            raise ValueError(f"record {self.id}: damaged in chunk {row['chunk_no']}")

    def row(self) -> tuple:
        f = self.fields
        if f is None or self.left or not self.unpacker.eof:
            raise ValueError(f"record {self.id}: cut short")
        digest = f["WARC-Payload-Digest"].removeprefix("sha1:")
        if f["WARC-Type"] == "response" and (self.seen != int(f["X-Payload-Length"]) or base64.b32encode(self.digest.digest()).decode() != digest):
            raise ValueError(f"record {self.id}: payload and digest differ")
        own, to = (None if k not in f else int(f[k]) for k in ("X-Page-ID", "X-Refers-To-Page"))
        return own, int(f["X-Payload-Length"]), digest, f["WARC-Type"], to, f["WARC-Target-URI"]


def read_pieces(batches):
    """From the rows of records, those of a record together and in order, a row for each record."""
    now = None
    types = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string())
    names = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url")
    pack = lambda out: pa.record_batch([pa.array([r[k] for r in out], t) for k, t in enumerate(types)], names)
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            if now is None or row["record_id"] != now.id:
                out += [now.row()] if now else []
                now = _Record(row["record_id"])
            now.add(row)
        yield pack(out)
    yield pack([now.row()] if now else [])


def records(pages: DataFrame, min_bytes: int = 0, chunk: int = CHUNK) -> DataFrame:
    """The chunked record table of pages (page_id, url, html)."""
    key = ["page_id", "sha1", "url"]
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("sha1", F.sha1("payload"))
    record = lambda page, url, place: F.concat_ws("-", F.coalesce(page.cast("string"), F.lit("none")), "sha1", F.lower(F.hex(F.xxhash64(url))), place.cast("string"))
    own = rows.groupBy(*key, F.octet_length("payload").cast("bigint").alias("size")).agg(F.count("*").alias("n"))
    # the order of pages with one digest: by page_id, none last, then by url
    own = c.saved(own.withColumn("at", F.struct(F.col("page_id").isNull().alias("none"), F.col("page_id").alias("page_id"), F.col("url").alias("url"))))
    firsts = own.filter(F.col("size") >= min_bytes).groupBy("sha1").agg(F.min("at").alias("first"))
    known = own.join(firsts, "sha1", "left").withColumn("own", F.coalesce(F.col("at") == F.col("first"), F.lit(True)))
    # how many of equal rows are responses: all, if too small to be revisited
    known = known.withColumn("responses", F.when(F.col("first").isNull(), F.col("n")).when(F.col("own"), 1).otherwise(0))
    places = F.sequence(F.col("responses") + 1, F.col("n"))
    revisits = known.filter("n > responses").withColumn("place", F.explode(places)).withColumn("to", record(F.col("first")["page_id"], F.col("first")["url"], F.lit("1")))
    revisits = revisits.select(record(F.col("page_id"), F.col("url"), F.col("place")).alias("record_id"), "page_id", "url", "sha1", "size", F.lit("revisit").alias("type"), F.col("first")["page_id"].alias("refers_to"), F.col("to").alias("refers_to_record"), F.lit(0).cast("bigint").alias("piece"), F.lit(1).cast("bigint").alias("pieces"), F.lit(None).cast("binary").alias("data"))
    if (own.agg(F.max("n")).first()[0] or 0) > 1:  # of equal rows one is enough
        rows = rows.dropDuplicates(key)
    pieces = F.greatest(F.lit(1), F.ceil(F.octet_length("payload") / chunk)).cast("bigint")
    cut = F.transform(F.sequence(F.lit(0).cast("bigint"), pieces - 1), lambda k: F.struct(k.alias("piece"), pieces.alias("pieces"), F.substring("payload", (k * chunk + 1).cast("int"), F.lit(chunk)).alias("data")))
    # what is exploded is a column of its own, so that no piece carries the whole
    cut = rows.select(*key, cut.alias("cut")).select(*key, F.explode("cut").alias("p")).select(*key, "p.*")
    wanted = known.filter("responses > 0").select(F.col("page_id").alias("__page"), F.col("sha1").alias("__sha1"), F.col("url").alias("__url"), "size", "responses")
    on = [F.col("page_id").eqNullSafe(F.col("__page")), F.col("sha1") == F.col("__sha1"), F.col("url") == F.col("__url")]
    responses = cut.join(wanted, on).withColumn("place", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("responses").cast("bigint"))))
    responses = responses.select(record(F.col("page_id"), F.col("url"), F.col("place")).alias("record_id"), "page_id", "url", "sha1", "size", F.lit("response").alias("type"), F.lit(None).cast("bigint").alias("refers_to"), F.lit(None).cast("string").alias("refers_to_record"), "piece", "pieces", "data")
    return responses.sortWithinPartitions("record_id", "piece").mapInArrow(write_records, TABLE).unionByName(revisits.mapInArrow(write_records, TABLE))


def read_records(table: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to and url of each record of the table."""
    schema = "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, url string"
    long = table.filter("chunks > 1").repartition("record_id").sortWithinPartitions("record_id", "chunk_no")
    return table.filter("chunks = 1").mapInArrow(read_pieces, schema).unionByName(long.mapInArrow(read_pieces, schema))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_records(c.saved(records(spark.read.parquet(f"{sf_dir}/pages.parquet")))).drop("url")


QUERIES = {"op6_warc": op6_warc}

#: Base32 of a digest: its 20 bytes are four groups of 40 bits, eight letters each.
_GROUPS = " || ".join(
    "substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST((('0x' || substr(sha1, %d, 10))::BIGINT >> %d) & 31 AS INTEGER), 1)" % (10 * g + 1, 35 - 5 * k) for g in range(4) for k in range(8)
)
SQL = {
    "op6_warc": f"""
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS sha1 FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY sha1) AS first FROM p)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, {_GROUPS} AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to FROM f""",
}
