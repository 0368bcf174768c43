"""WARC archives: writing whole-file gzip, normalising to one gzip member per record, reading by a sidecar index.

Archives are plain files that Spark's own writers and readers move, so any file system that Spark knows will do:

* ``write_monolithic``: the text writer with ``\\r\\n\\r\\n`` as line separator ends every record as WARC asks, and its gzip
  codec makes each file a single stream.  A task begins a new file once one holds ``ARCHIVE_BYTES`` of records.
* ``normalise``: reads each file as one binary value, inflates the stream once, piece by piece, and emits every record
  deflated by itself, and its place as a line of the index.  One write puts both into files, in the task that inflated them:
  an archive is never dealt out again.  Members go through the text writer as raw bytes.  A gzip member ends with the high byte
  of its length, which is 0 below 16 MiB; longer records are cut over several members, as gzip allows, so that a NUL separator
  restores exactly that last byte.
* ``read``: takes members out of the normalised files by the index, without inflating what stands before them.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nubes.llm.blocks import bound_batches

CRLF = "\r\n"
PIECE = 1 << 20
MEMBER = (1 << 24) - 1
#: An archive that holds this many bytes of records, before compression, takes no further one; bounds what a task holds.
ARCHIVE_BYTES = 24 << 20
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
DIGITS32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV"


def base32_sha1(data: F.Column) -> F.Column:
    """Bare upper-case base32 of a binary column's SHA-1: 40 bits at a time through base 32 digits."""
    hexed = F.sha1(data)
    parts = [F.lpad(F.conv(F.substring(hexed, 1 + 10 * i, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.upper(F.concat(*parts)), DIGITS32, BASE32)


def records(pages: DataFrame) -> DataFrame:
    """page_id, url, html, payload_bytes, payload_digest and refers_to (null for responses) of every page.

    Of pages with equal payloads those with the smallest page_id are responses and the others revisit it.  A null html is an
    empty payload.  A row with a null page_id is a response unless a page with an id has its payload.
    """
    payload = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("html"))
    rows = rows.withColumns({"payload_bytes": F.octet_length("html").cast("long"), "payload_digest": base32_sha1(F.encode("html", "utf-8"))})
    first = rows.groupBy(F.col("payload_digest").alias("of")).agg(F.min("page_id").alias("first"))
    rows = rows.join(first, F.col("payload_digest") == F.col("of"))
    return rows.withColumn("refers_to", F.when(~F.col("first").eqNullSafe(F.col("page_id")), F.col("first"))).drop("of", "first")


def record_text(page_id: str = "page_id") -> F.Column:
    """A WARC/1.1 record without the two line ends that close it."""
    revisit = F.col("refers_to").isNotNull()
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.col("payload_bytes").cast("string"), F.lit(CRLF + CRLF))
    block = F.when(revisit, http).otherwise(F.concat(http, F.col("html")))
    url = F.regexp_replace(F.coalesce("url", F.lit("")), r"[\r\n]", "")
    name = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit(">"))
    head = F.concat(
        F.lit(f"WARC/1.1{CRLF}WARC-Type: "), F.when(revisit, F.lit("revisit")).otherwise(F.lit("response")),
        F.lit(f"{CRLF}WARC-Record-ID: "), name(page_id),
        F.lit(f"{CRLF}WARC-Target-URI: "), url,
        F.lit(f"{CRLF}WARC-Payload-Digest: sha1:"), F.col("payload_digest"),
        F.lit(f"{CRLF}WARC-Payload-Length: "), F.col("payload_bytes").cast("string"),
        F.when(revisit, F.concat(F.lit(f"{CRLF}WARC-Refers-To: "), name("refers_to"), F.lit(f"{CRLF}WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))).otherwise(""),
        F.lit(f"{CRLF}Content-Type: application/http; msgtype=response{CRLF}Content-Length: "), F.octet_length(block).cast("string"),
        F.lit(CRLF + CRLF),
    )
    return F.concat(head, block)


def write_monolithic(pages: DataFrame, path: str) -> None:
    """A WARC record per page; each file is one gzip stream of ``ARCHIVE_BYTES`` of records and one more at most."""

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, held = 0, 0
        for batch in batches:
            files = []
            for size in batch.column(1).to_pylist():
                file, held = (file + 1, 0) if held >= ARCHIVE_BYTES else (file, held)
                held += size
                files.append(file)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(files, pa.int32())], ["value", "file"])

    bound_batches(pages.sparkSession)
    rows = records(pages).select(record_text().alias("value")).select("value", F.octet_length("value").alias("bytes"))
    rows.mapInArrow(numbered, "value string, file int").write.mode("overwrite").partitionBy("file").option("lineSep", CRLF * 2).option("compression", "gzip").text(path)


def _inflate(content: memoryview) -> Iterator[bytes]:
    """The bytes of a gzip file, whether one member or many, in pieces."""
    stream = zlib.decompressobj(31)
    for i in range(0, len(content), PIECE):
        data = bytes(content[i : i + PIECE])
        while data:
            out = stream.decompress(data, 4 * PIECE)
            if out:
                yield out
            data = stream.unconsumed_tail
            if stream.eof:
                data = stream.unused_data
                if data:
                    stream = zlib.decompressobj(31)
    if out := stream.flush():
        yield out


def _headers(head: bytes) -> dict[str, str]:
    fields = (line.split(":", 1) for line in head.decode().split(CRLF)[1:] if ":" in line)
    return {k.strip().lower(): v.strip() for k, v in fields}


def _split(pieces: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """Every record of an inflated archive: its header fields and all its bytes, closing line ends included."""
    held = bytearray()
    for piece in pieces:
        held += piece
        start = 0
        while (cut := held.find(b"\r\n\r\n", start)) >= 0:
            fields = _headers(bytes(held[start:cut]))
            end = cut + 4 + int(fields.get("content-length", 0)) + 4
            if end > len(held):
                break
            yield fields, bytes(held[start:end])
            start = end
        del held[:start]
    if held.strip():
        raise ValueError(f"an archive ends inside a record; {len(held)} bytes are left")


def _member(record: bytes) -> bytes:
    """The record as one gzip member, or several of at most ``MEMBER`` bytes each."""
    out = []
    for i in range(0, len(record), MEMBER):
        z = zlib.compressobj(6, zlib.DEFLATED, 31)
        out.append(z.compress(record[i : i + MEMBER]) + z.flush())
    return b"".join(out)


MEMBERS = "kind string, archive string, seq long, value binary"
INDEX = "archive string, seq long, offset long, length long, record_type string, record_id string, digest string"


def members(spark, path: str) -> DataFrame:
    """For every record of the archives below ``path`` its gzip member without the last byte (kind members) and the line of the index (kind index)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                folder, file = name.split("/")[-2:]
                archive = f"{folder.removeprefix('file=')}-{file.split('.')[0]}"
                offset, rows, held = 0, [], 0
                for seq, (fields, record) in enumerate(_split(_inflate(memoryview(content.as_buffer())))):
                    member = _member(record)
                    line = (seq, offset, len(member), *(fields.get(f"warc-{k}", "") for k in ("type", "record-id", "payload-digest")))
                    rows += [("members", archive, seq, member[:-1]), ("index", archive, seq, "\t".join(map(str, line)).encode())]
                    offset += len(member)
                    held += len(member)
                    if held > PIECE:
                        yield _table(rows, MEMBERS)
                        rows, held = [], 0
                if rows:
                    yield _table(rows, MEMBERS)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.gz").load(path).select("path", "content")
    return files.mapInArrow(run, MEMBERS)


def _table(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
    fields = [f.strip().split(" ") for f in schema.split(",")]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(zip(*rows), fields)], [n for n, _ in fields])


def normalise(spark, source: str, target: str) -> DataFrame:
    """Rewrites the archives below ``source`` with a member per record and the offset index beside them; returns the index.

    The archive ``x`` becomes the one file below ``target/kind=members/archive=x``, its index that below ``kind=index/archive=x``.
    """
    # bytes as they are; the separator is the last one of a member, and ends a line of the index
    rows = members(spark, source).sortWithinPartitions("kind", "archive", "seq").select("kind", "archive", F.col("value").cast("string").alias("value"))
    rows.write.mode("overwrite").partitionBy("kind", "archive").option("lineSep", "\0").text(target)
    return read_index(spark, target)


def read_index(spark, target: str) -> DataFrame:
    """The index beside normalised archives, with the columns of ``INDEX``."""
    lines = spark.read.schema("value string, archive string").option("basePath", f"{target}/kind=index").option("lineSep", "\0").text(f"{target}/kind=index")
    cells = F.split("value", "\t")
    names = [c.split(" ") for c in INDEX.split(", ")[1:]]
    return lines.select("archive", *(cells[k].cast(kind).alias(name) for k, (name, kind) in enumerate(names)))


READ = "archive string, record_type string, record_id string, refers_to string, digest string, payload_bytes long, payload binary"


def read(spark, target: str, index: DataFrame) -> DataFrame:
    """The records that ``index`` lists, each inflated from its own member."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive, content, places in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
                view, rows, held = memoryview(content.as_buffer()), [], 0
                for place in places:
                    record = b"".join(_inflate(view[place["offset"] : place["offset"] + place["length"]]))
                    head, _, rest = record.partition(b"\r\n\r\n")
                    fields = _headers(head)
                    payload = rest[: int(fields["content-length"])].partition(b"\r\n\r\n")[2]
                    kind = fields["warc-type"]
                    size = len(payload) if kind == "response" else int(fields["warc-payload-length"])
                    rows.append((archive, kind, fields["warc-record-id"], fields.get("warc-refers-to"), fields["warc-payload-digest"].removeprefix("sha1:"), size, payload if kind == "response" else None))
                    held += len(payload)
                    if held > PIECE:
                        yield _table(rows, READ)
                        rows, held = [], 0
                if rows:
                    yield _table(rows, READ)

    archive = F.regexp_extract("path", r"archive=([^/]+)/", 1)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "part-*").load(f"{target}/kind=members")
    places = index.groupBy("archive").agg(F.sort_array(F.collect_list(F.struct("offset", "length"))).alias("places"))
    # an archive's index is bounded, as write_monolithic limits its bytes
    joined = files.select(archive.alias("archive"), "content").join(places, "archive")
    return joined.select("archive", "content", "places").mapInArrow(run, READ)


def page_archive(pages: DataFrame, root: str) -> DataFrame:
    """Writes a record per page below ``root``, normalises the archives and reads every record back through the index.

    page_id, payload_bytes, payload_digest (recomputed from the payload read back for responses, from the header for
    revisits), record_type, refers_to.  An empty table gives an empty result; repeated rows give repeated records.
    """
    spark = pages.sparkSession
    write_monolithic(pages, f"{root}/monolithic")
    # without records nothing is written
    if pages.isEmpty():
        return spark.createDataFrame([], "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")
    index = normalise(spark, f"{root}/monolithic", f"{root}/members")
    number = lambda c: F.expr(f"try_cast(regexp_extract({c}, 'page:(-?[0-9]*)>', 1) AS bigint)")
    return read(spark, f"{root}/members", index).select(
        number("record_id").alias("page_id"), "payload_bytes",
        F.coalesce(base32_sha1(F.col("payload")), F.col("digest")).alias("payload_digest"), "record_type", number("refers_to").alias("refers_to"),
    )


ORACLE = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b, sha1(coalesce(html, '')) AS h FROM pages),
r AS (SELECT page_id, octet_length(b) AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 +
    ((CAST(('0x' || substr(h, CAST(1 + 10 * (i // 8) AS BIGINT), 10)) AS BIGINT) >> CAST(35 - 5 * (i % 8) AS INTEGER)) & 31) AS BIGINT), 1)), '') AS payload_digest,
  min(page_id) OVER (PARTITION BY h) AS f FROM p)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
  CASE WHEN page_id IS NOT DISTINCT FROM f THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id IS NOT DISTINCT FROM f THEN NULL ELSE f END AS refers_to FROM r
"""
