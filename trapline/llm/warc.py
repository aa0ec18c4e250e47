"""WARC archives of pages, and a two-level index of what they hold."""

from __future__ import annotations

import base64
import hashlib
import json
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import in_arrow, shared_dir, written

#: Captures in one compressed block of the index.
BLOCK = 3000
#: Payloads of fewer bytes are written so many to an archive file; so are, of those beyond, larger ones.
FILE_RECORDS = [(1 << 16, 2000), (1 << 22, 32), (1 << 40, 1)]
#: Groups that one payload's rows are dealt over.
RUNS = 256
#: Verdicts on payloads that occur again which are broadcast at most; more are joined by a shuffle.
BROADCAST_VERDICTS = 500_000
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32_sha1(binary: Column) -> Column:
    """SHA-1 in upper-case base32 without a prefix, as WARC-Payload-Digest has it."""
    hexed = F.sha1(binary)
    letters = []
    for group in range(4):  # 40 bits are 10 hex digits and 8 letters
        bits = F.conv(F.substring(hexed, 10 * group + 1, 10), 16, 10).cast("long")
        for k in range(8):
            letters.append(F.substring(F.lit(BASE32), (F.shiftright(bits, 35 - 5 * k).bitwiseAND(F.lit(31)) + 1).cast("int"), F.lit(1)))
    return F.concat(*letters)


def host(url: Column) -> Column:
    """Between the first ``://`` and ``/``, ``?``, ``#`` or the end; A-Z lower-cased; else empty."""
    at = F.locate("://", url)
    rest = F.substring(url, at + 3, F.length(url))
    return F.when(at > 0, F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).otherwise("")


def after_host(url: Column) -> Column:
    at = F.locate("://", url)
    rest = F.substring(url, at + 3, F.length(url))
    return F.when(at > 0, F.regexp_replace(rest, r"^[^/?#]*", "")).otherwise("")


def clean(url: Column) -> Column:
    """The url as an archive holds it: white space and control characters would end a header."""
    return F.regexp_replace(url, r"[\x00-\x20\x7F]", "%20")


def surt(url: Column) -> Column:
    """Reversed-host key of a clean url: ``com,example,www)/path?query``; the fragment goes."""
    return F.when(url.isNull(), F.lit("")).otherwise(
        F.concat(F.array_join(F.reverse(F.split(host(url), r"\.")), ","), F.lit(")"), F.regexp_replace(after_host(url), "(?s)#.*$", ""))
    )


def deduplicated(pages: DataFrame) -> DataFrame:
    """page_id, url, payload, payload_digest, payload_bytes, record_type, refers_to.

    Of equal payloads the smallest page_id is the response. The minimum is taken in runs
    and then over the runs, and told back the same way, so that a payload which a third of
    the pages share never meets in one task.
    """
    html = F.coalesce("html", F.lit(""))
    coded = pages.select(
        "page_id", "url", html.alias("payload"), base32_sha1(html.cast("binary")).alias("payload_digest"),
        F.octet_length(html).cast("long").alias("payload_bytes"), F.pmod(F.xxhash64("page_id"), F.lit(RUNS)).alias("_run"),
    )
    runs = written(coded.groupBy("_run", "payload_digest").agg(F.min("page_id").alias("_low"), F.count("*").alias("_n")))
    low = runs.groupBy("payload_digest").agg(F.min("_low").alias("_first"), F.sum("_n").alias("_n")).where("_n > 1").drop("_n")
    told = written(runs.select("_run", "payload_digest").join(low, "payload_digest"))
    # payloads that occur once need no verdict; where the others are few, no page is shuffled
    hint = F.broadcast if told.count() <= BROADCAST_VERDICTS else (lambda x: x)
    first = F.col("_first").isNull() | F.col("page_id").eqNullSafe(F.col("_first"))
    return coded.join(hint(told), ["_run", "payload_digest"], "left").select(
        "page_id", "url", "payload", "payload_digest", "payload_bytes",
        F.when(first, "response").otherwise("revisit").alias("record_type"),
        F.when(~first, F.col("_first")).alias("refers_to"),
    )


def _record(date: str) -> Column:
    """A whole record but for its last line end, which the text writer adds."""
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    uid = lambda c: F.concat(F.lit("<urn:trapline:page:"), c.cast("string"), F.lit(">"))
    target = clean(F.col("url"))
    http = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"),
        line("Content-Length", F.col("payload_bytes").cast("string")),
        F.lit("\r\n"),
    )
    body = F.when(F.col("record_type") == "response", F.concat(http, "payload")).otherwise(http)
    none = F.lit("")
    return F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.col("record_type")),
        F.coalesce(line("WARC-Record-ID", uid(F.col("page_id"))), none),
        line("WARC-Date", F.lit(date)),
        F.coalesce(line("WARC-Target-URI", target), none),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        F.coalesce(line("WARC-Refers-To", uid(F.col("refers_to"))), none),
        F.when(
            F.col("record_type") == "revisit",
            F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\n"),
        ).otherwise(none),
        F.lit("Content-Type: application/http;msgtype=response\r\n"),
        line("Content-Length", F.octet_length(body).cast("string")),
        F.lit("\r\n"),
        body,
        F.lit("\r\n"),
    )


def write_warc(pages: DataFrame, path: str, date: str = "2024-01-01T00:00:00Z") -> None:
    """Writes uncompressed WARC/1.1 files below ``path``, one record per row of ``pages``.

    Spark's text writer does it, so files are committed task by task and a lost executor's
    are written again. Pages are written by size, so that a file of many records stays
    small and a very long page has one of its own. Null html is an empty payload; a null
    url has no target. Repeated rows of the smallest page_id are all responses. A record of
    a null page_id has no identifier, and none refers to it.
    """
    longest = pages.agg(F.max(F.octet_length("html"))).first()[0] or 0
    made = deduplicated(pages)
    low = -1
    for high, records in FILE_RECORDS:
        own = made.where((F.col("payload_bytes") > low) & (F.col("payload_bytes") <= high))
        own.select(_record(date).alias("value")).write.mode("append").option("lineSep", "\r\n").option("maxRecordsPerFile", records).text(path)
        low = high
        if longest <= high:
            break


def _headers(block: bytes) -> dict[str, str]:
    lines = block.decode("utf-8").split("\r\n")[1:]
    return dict(x.split(": ", 1) for x in lines if ": " in x)


def records(content: bytes) -> Iterator[tuple[int, int, dict[str, str], dict[str, str], bytes]]:
    """(offset, length, headers, HTTP headers, payload) of each record of an archive."""
    at = 0
    while at < len(content):
        end = content.index(b"\r\n\r\n", at)
        head = _headers(content[at:end])
        body = content[end + 4 : end + 4 + int(head["Content-Length"])]
        http, _, payload = body.partition(b"\r\n\r\n")
        after = end + 8 + int(head["Content-Length"])
        yield at, after - at, head, _headers(http), payload
        at = after


_CAPTURE = "page_id long, url string, file string, offset long, length long, record_type string, payload_bytes long, payload_digest string, refers_to long"


def _page(uid: str | None) -> int | None:
    return int(uid.rpartition(":")[2].rstrip(">")) if uid else None


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in _CAPTURE.split(", ")]
    for batch in batches:
        for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            rows = []
            for offset, length, head, http, payload in records(content.as_py()):
                digest = head["WARC-Payload-Digest"].removeprefix("sha1:")
                if head["WARC-Type"] == "response" and digest != base64.b32encode(hashlib.sha1(payload).digest()).decode():
                    raise ValueError(f"{path}, byte {offset}: the payload's digest differs")
                rows.append(
                    (_page(head.get("WARC-Record-ID")), head.get("WARC-Target-URI"), path, offset, length, head["WARC-Type"],
                     int(http["Content-Length"]), digest, _page(head.get("WARC-Refers-To")))
                )
            kinds = [pa.int64() if x.endswith("long") else pa.string() for x in _CAPTURE.split(", ")]
            columns = list(zip(*rows, strict=True)) or [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """One row per record with its file, offset and length; payload digests are checked."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    return files.select("path", "content").transform(in_arrow, _scan, _CAPTURE)


@dataclass
class CaptureIndex:
    """blocks (shard, block, first_key, last_key, n, data) and, for each shard, its key range.

    The blocks' keys without ``data`` are the sparse directory; Parquet reads them alone.
    """

    blocks: DataFrame

    @property
    def directory(self) -> DataFrame:
        return self.blocks.select("shard", "block", "first_key", "last_key")

    def captures(self) -> DataFrame:
        """All that the index holds, block by block."""
        return self.blocks.select("data").transform(in_arrow, _unpack, f"key string, {_CAPTURE}")

    def lookup(self, urls: DataFrame) -> DataFrame:
        """The captures of the urls (column ``url``): shard, then block, then entry.

        Only the shards' ranges, one for each partition of the index, reach the driver. A
        url's shard is found by bisecting them, its blocks by bisecting the shard's part of
        the directory, and its entries by unpacking those blocks alone. A null url has the
        captures without one. Each capture comes once, however often its url is asked for.
        """
        ranges = self.directory.groupBy("shard").agg(F.min("first_key").alias("k")).orderBy("k", "shard").collect()
        firsts, shards = [r["k"] for r in ranges], [r["shard"] for r in ranges]

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                # a key that ends one shard may begin the next
                found = [
                    (k, shards[a])
                    for k in batch.column(0).to_pylist()
                    for a in range(max(0, bisect_left(firsts, k) - 1), bisect_right(firsts, k))
                ]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([k for k, _ in found], pa.string()), pa.array([x for _, x in found], pa.int32())], names=["key", "shard"]
                )

        def search(keys: pa.Table, directory: pa.Table) -> pa.Table:
            """The blocks of one shard that may hold a key: those from the last that begins before it."""
            blocks = directory.sort_by("block").to_pydict()
            found: dict[int, list[str]] = {}
            for k in keys.column("key").to_pylist():
                for b in range(max(0, bisect_left(blocks["first_key"], k) - 1), bisect_right(blocks["first_key"], k)):
                    if k <= blocks["last_key"][b]:
                        found.setdefault(blocks["block"][b], []).append(k)
            shard = (keys.column("shard").to_pylist() or [0])[:1] * len(found)
            return pa.table({"shard": pa.array(shard, pa.int32()), "block": pa.array(list(found), pa.int32()), "keys": pa.array(list(found.values()), pa.list_(pa.string()))})

        keys = urls.select(surt(clean(F.col("url"))).alias("key")).distinct().transform(in_arrow, place, "key string, shard int")
        wanted = keys.groupBy("shard").cogroup(self.directory.groupBy("shard")).applyInArrow(search, "shard int, block int, keys array<string>")
        return self.blocks.join(wanted, ["shard", "block"]).select("data", "keys").transform(in_arrow, _unpack, f"key string, {_CAPTURE}")


def _unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks (data, and keys if only some are asked for) to captures."""
    for batch in batches:
        for data, keys in zip(batch.column(0), batch.column(1) if batch.num_columns > 1 else repeat(None), strict=False):
            rows = json.loads(zlib.decompress(data.as_py()))
            if keys is not None:
                asked = set(keys.as_py())
                rows = [r for r in rows if r["key"] in asked]
            yield pa.RecordBatch.from_pylist(
                rows, schema=pa.schema([(x.split()[0], pa.int64() if x.endswith("long") else pa.string()) for x in f"key string, {_CAPTURE}".split(", ")])
            )


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[dict] = []
    block = 0

    def out(rows: list[dict]) -> pa.RecordBatch:
        data = zlib.compress(json.dumps([{k: v for k, v in r.items() if k != "shard"} for r in rows]).encode(), 6)
        values = [[rows[0]["shard"]], [block], [rows[0]["key"]], [rows[-1]["key"]], [len(rows)], [data]]
        kinds = [pa.int32(), pa.int32(), pa.string(), pa.string(), pa.int32(), pa.binary()]
        return pa.RecordBatch.from_arrays(
            [pa.array(v, k) for v, k in zip(values, kinds, strict=True)], names=["shard", "block", "first_key", "last_key", "n", "data"]
        )

    for batch in batches:
        held += batch.to_pylist()
        while len(held) > BLOCK:
            yield out(held[:BLOCK])
            held, block = held[BLOCK:], block + 1
    if held:
        yield out(held)


def build_index(captures: DataFrame) -> CaptureIndex:
    """Sorts captures by reversed-host key into compressed blocks.

    The sort is by ranges of (key, page_id), so one host of a third of all pages is dealt
    over many shards; a key may go on in the next block or shard.
    """
    keyed = captures.withColumn("key", surt(F.col("url"))).select("key", *captures.columns)
    ranged = keyed.repartitionByRange("key", "page_id", "file", "offset").sortWithinPartitions("key", "page_id", "file", "offset")
    blocks = ranged.withColumn("shard", F.spark_partition_id()).transform(
        in_arrow,
        _pack, "shard int, block int, first_key string, last_key string, n int, data binary"
    )
    return CaptureIndex(written(blocks))


def fetch(captures: DataFrame) -> DataFrame:
    """captures with ``payload``: the bytes of each record's payload, read by its range alone.

    A revisit's payload is empty; look for its response. Captures are sorted by file and
    place first, so a task opens each file once and reads forward. Files are opened on the
    executors, so their folder must be one that all of them see. A response whose payload
    differs from its digest raises ValueError.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        held, file = None, None
        for batch in batches:
            for part in range(0, batch.num_rows, 256):
                rows = batch.slice(part, 256)
                payloads = []
                for row in rows.select(["file", "offset", "length", "record_type", "payload_digest"]).to_pylist():
                    if row["file"] != held:
                        if file is not None:
                            file.close()
                        store, name = fs.FileSystem.from_uri(row["file"])
                        held, file = row["file"], store.open_input_file(name)
                    payload = next(records(file.read_at(row["length"], row["offset"])))[4]
                    if row["record_type"] == "response" and row["payload_digest"] != base64.b32encode(hashlib.sha1(payload).digest()).decode():
                        raise ValueError(f"{held}, byte {row['offset']}: the payload's digest differs")
                    payloads.append(payload)
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(payloads, pa.binary())], names=[*rows.schema.names, "payload"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in captures.schema)
    ranged = captures.repartitionByRange("file", "offset").sortWithinPartitions("file", "offset")
    return in_arrow(ranged, read, f"{schema}, payload binary")


def archive_pages(pages: DataFrame, path: str | None = None) -> CaptureIndex:
    """Writes the archives, reads them back and indexes them.

    Null html is an empty payload, null urls are indexed under the empty key, and rows of a
    null page_id have a null page_id in the index. Repeated rows are records of their own;
    of equal payloads all rows of the smallest page_id are responses. No pages give an
    empty index. Very long pages have files of their own. Columns other than page_id, url
    and html are ignored.
    """
    spark = pages.sparkSession
    path = path or f"{shared_dir(spark)}-warc"
    write_warc(pages, path)
    return build_index(read_warc(spark, path))


ORACLE = f"""
WITH p AS (
  SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
b AS (
  SELECT page_id, payload_bytes, h,
    ('0x' || substr(h, 1, 10))::BIGINT AS g0, ('0x' || substr(h, 11, 10))::BIGINT AS g1,
    ('0x' || substr(h, 21, 10))::BIGINT AS g2, ('0x' || substr(h, 31, 10))::BIGINT AS g3
  FROM p),
d AS (
  SELECT page_id, payload_bytes,
    {' || '.join(f"substr('{BASE32}', 1 + ((g{g} >> {35 - 5 * k}) & 31)::INT, 1)" for g in range(4) for k in range(8))} AS payload_digest
  FROM b),
w AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS low FROM d)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN page_id = low THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> low THEN low END AS refers_to
FROM w
"""
