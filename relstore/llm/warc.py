"""WARC archives: writing, normalising monolithic gzip files, reading back by offset index.

1. `write_archives` turns pages into records. Spark's text writer, with the blank lines between records as its line
   separator and gzip as its codec, makes the archives: each file is one gzip stream over all its records.
2. `normalise` inflates such a file once, front to back, and rewrites each record as a gzip member of its own, with a
   sidecar index of offsets beside it. A task holds one record and a few buffers. Files appear under their name only when they are complete,
   and a repeated task writes the same bytes, so that lost executors do no harm.
3. `read_records` deals out index lines, seeks each member and reads it by itself.

Files are reached through pyarrow's filesystems, by the URI of the shared folder.
"""

from __future__ import annotations

import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace, read

CRLF = "\r\n"
#: Equal payloads of at least so many bytes are stored once.
REVISIT_BYTES = 1000
#: Records in one archive at most; bytes read at once; bytes of an archive that one task reads back.
FILE_RECORDS, CHUNK, SPAN = 20_000, 1 << 20, 8 << 20
#: WARC needs a date; pages have none.
DATE = "2000-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


# -- writing ---------------------------------------------------------------------------------------------------------


def _lines(*lines: Column | str) -> Column:
    return F.concat(*[x for line in lines for x in ((F.lit(line) if isinstance(line, str) else line), F.lit(CRLF))])


def with_roles(pages: DataFrame, page_id: str, html: str, least: int = REVISIT_BYTES) -> DataFrame:
    """Adds __payload, __bytes, __sha1 and __refers (the page that a revisit refers to, else null)."""
    payload = F.coalesce(F.col(html), F.lit(""))
    rows = pages.withColumn("__payload", payload).withColumn("__bytes", F.octet_length("__payload").cast("long")).withColumn("__sha1", F.sha1(F.col("__payload").cast("binary")))
    # SHA-1 goes in the header; SHA-256 decides what is equal, as collisions of the former are public.
    rows = rows.withColumn("__sha2", F.when(F.col("__bytes") >= least, F.sha2(F.col("__payload").cast("binary"), 256)).otherwise(F.col(page_id).cast("string")))
    # Copies meet as partial maxima, not as rows.
    shared = rows.filter(F.col("__bytes") >= least).groupBy("__sha2", "__bytes").agg(F.max(page_id).alias("__head"), F.count(F.lit(1)).alias("__n")).filter("__n > 1").drop("__n")
    joined = rows.join(shared, ["__sha2", "__bytes"], "left").drop("__sha2")
    return joined.withColumn("__refers", F.when(~F.col(page_id).eqNullSafe(F.col("__head")), F.col("__head"))).drop("__head")


def records(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """One column, `record`: a WARC record without the blank lines that end it."""
    rows = with_roles(pages, page_id, html)
    own = F.coalesce(F.col(page_id).cast("string"), F.lit(""))
    revisit = F.col("__refers").isNotNull()
    # Line breaks and other control characters would end the header.
    target = F.regexp_replace(F.coalesce(F.col(url), F.lit("")), r"[\x00-\x20\x7f]", "%20")
    http = _lines("HTTP/1.1 200 OK", "Content-Type: text/html; charset=utf-8", F.concat(F.lit("Content-Length: "), F.col("__bytes")), "")
    block = F.concat(http, F.when(revisit, F.lit("")).otherwise(F.col("__payload")))
    head = F.concat(
        _lines(
            "WARC/1.1",
            F.concat(F.lit("WARC-Type: "), F.when(revisit, "revisit").otherwise("response")),
            F.concat(F.lit("WARC-Record-ID: <urn:page:"), own, F.lit(">")),
            F.concat(F.lit("WARC-Target-URI: "), target),
            f"WARC-Date: {DATE}",
            F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("__sha1")),
        ),
        F.when(revisit, _lines(F.concat(F.lit("WARC-Refers-To: <urn:page:"), F.col("__refers").cast("string"), F.lit(">")), f"WARC-Profile: {PROFILE}")).otherwise(""),
        _lines("Content-Type: application/http; msgtype=response", F.concat(F.lit("Content-Length: "), F.octet_length(block)), ""),
    )
    return rows.select(F.concat(head, block).alias("record"))


def write_archives(pages: DataFrame, path: str, **columns: str) -> None:
    """Monolithic gzip archives, some for each partition, in the folder `path`."""
    records(pages, **columns).write.option("lineSep", CRLF * 2).option("compression", "gzip").option("maxRecordsPerFile", FILE_RECORDS).text(path)


# -- files -----------------------------------------------------------------------------------------------------------


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    return pafs.FileSystem.from_uri(uri)


def inflated(stream) -> Iterator[bytes]:
    """The content of a gzip file of one member or several, piece by piece."""
    z = zlib.decompressobj(31)
    while data := stream.read(CHUNK):
        while data:
            if z.eof:
                data = data.lstrip(b"\0")
                if not data:
                    break
                z = zlib.decompressobj(31)
            out = z.decompress(data, CHUNK)
            if out:
                yield out
            data = z.unconsumed_tail or (z.unused_data if z.eof else b"")
    if not z.eof:
        out = z.flush()
        if out:
            yield out
        if not z.eof:
            raise ValueError("the gzip stream ends early")


def header_fields(head: bytes) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in head.decode("utf-8", "replace").split(CRLF)[1:])}


def split_records(pieces: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """(fields, whole record with its two final line breaks) of a WARC stream."""
    buffer, at_end = bytearray(), False
    need = 0
    while True:
        cut = buffer.find(b"\r\n\r\n") if len(buffer) >= need else -1
        if cut >= 0:
            fields = header_fields(bytes(buffer[:cut]))
            total = cut + 4 + int(fields["content-length"]) + 4
            if len(buffer) >= total:
                record = bytes(buffer[:total])
                if not record.startswith(b"WARC/") or not record.endswith(b"\r\n\r\n"):
                    raise ValueError("not a WARC record")
                yield fields, record
                del buffer[:total]
                need = 0
                continue
            need = total
        if at_end:
            break
        piece = next(pieces, None)
        if piece is None:
            at_end = True
        else:
            buffer += piece
    if buffer.strip():
        raise ValueError("a WARC record ends early")


def _put(fs: pafs.FileSystem, path: str, write) -> None:
    """Write beside the place and move there, so that a file is there whole or not at all."""
    part = f"{path}.{uuid.uuid4().hex}.part"
    try:
        with fs.open_output_stream(part) as out:
            write(out)
    except BaseException:
        fs.delete_file(part)
        raise
    fs.move(part, path)


def normalise_file(source: str, folder: str) -> tuple[str, int]:
    """Rewrites one archive; (its new name, records). The index is `folder`/index/NAME.tsv: offset, length, type, record id, target."""
    name = source.rpartition("/")[2].removesuffix(".gz").removesuffix(".txt")
    fs, path = filesystem(source)
    to, root = filesystem(folder)
    for sub in ("archives", "index"):
        to.create_dir(f"{root}/{sub}", recursive=True)
    lines: list[str] = []

    def members(out) -> None:
        at = 0
        with fs.open_input_stream(path, compression=None) as stream:
            for fields, record in split_records(inflated(stream)):
                member = gzip.compress(record, 6, mtime=0)
                out.write(member)
                lines.append("\t".join((f"archives/{name}.warc.gz", str(at), str(len(member)), fields["warc-type"], fields["warc-record-id"], fields.get("warc-target-uri", ""))))
                at += len(member)

    _put(to, f"{root}/archives/{name}.warc.gz", members)
    _put(to, f"{root}/index/{name}.tsv", lambda out: out.write("".join(x + "\n" for x in lines).encode()))
    return f"{name}.warc.gz", len(lines)


def normalise(spark: SparkSession, source: str, folder: str) -> DataFrame:
    """archive, records: what was rewritten, by a task for each file (lazy; the files appear when it runs)."""
    files = spark.read.format("binaryFile").load(source).select("path")  # without content
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = [normalise_file(p, folder) for p in batch.column("path").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], pa.int64())], names=["archive", "records"])

    return files.repartition(n, "path").mapInArrow(run, "archive string, records long")


# -- reading ---------------------------------------------------------------------------------------------------------


def parse_member(member: bytes) -> dict:
    """page, type, bytes, sha1 and refers of one record; a response's digest is taken from its payload and must be the stated one."""
    record = gzip.decompress(member)
    head, _, block = record.partition(b"\r\n\r\n")
    fields = header_fields(head)
    block = block[: int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    stated = fields["warc-payload-digest"].removeprefix("sha1:")
    size = int(header_fields(http)["content-length"])
    if fields["warc-type"] == "response":
        if len(payload) != size or hashlib.sha1(payload).hexdigest() != stated:
            raise ValueError(f"payload of {fields['warc-record-id']} is damaged")
    page = lambda x: x.removeprefix("<urn:page:").removesuffix(">")
    return {"page": page(fields["warc-record-id"]), "type": fields["warc-type"], "bytes": size, "sha1": stated, "refers": page(fields["warc-refers-to"]) if "warc-refers-to" in fields else None, "payload": payload}


def read_records(spark: SparkSession, folder: str, id_type: str = "long", payloads: bool = False) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to and, if asked for, payload (null for revisits)."""
    schema = "archive string, at long, length long, type string, record string, target string"
    index = spark.read.schema(schema).option("sep", "\t").option("quote", "").option("escape", "").csv(f"{folder}/index")
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    spans = index.select("archive", "at", "length", F.floor(F.col("at") / SPAN).alias("span")).repartition(n, "archive", "span").sortWithinPartitions("archive", "at")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = filesystem(folder)
        name, file = None, None
        for batch in batches:
            rows, size = [], 0
            for archive, at, length in zip(*(batch.column(k).to_pylist() for k in ("archive", "at", "length")), strict=True):
                if archive != name:
                    if file is not None:
                        file.close()
                    name, file = archive, fs.open_input_file(f"{root}/{archive}")
                r = parse_member(file.read_at(length, at))
                if not payloads or r["type"] != "response":
                    r["payload"] = None
                rows.append(r)
                size += len(r["payload"] or b"")
                if size > CHUNK:
                    yield pack(rows)
                    rows, size = [], 0
            yield pack(rows)
        if file is not None:
            file.close()

    def pack(rows: list[dict]) -> pa.RecordBatch:
        keys = (("page", pa.string()), ("bytes", pa.int64()), ("sha1", pa.string()), ("type", pa.string()), ("refers", pa.string()), ("payload", pa.binary()))
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in keys], names=[k for k, _ in keys])

    got = spans.mapInArrow(run, "page string, bytes long, sha1 string, type string, refers string, payload binary")
    out = got.select(
        F.when(F.col("page") != "", F.col("page")).cast(id_type).alias("page_id"),
        F.col("bytes").alias("payload_bytes"),
        F.col("sha1").alias("payload_digest"),
        F.col("type").alias("record_type"),
        F.col("refers").cast(id_type).alias("refers_to"),
        "payload",
    )
    return out if payloads else out.drop("payload")


def archive_pages(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", payloads: bool = False) -> DataFrame:
    """Write, normalise, read back: one row per row of pages.

    Of pages with equal payloads of at least REVISIT_BYTES bytes the one with the largest id is the response and the others revisit it;
    rows that repeat that id are all responses; null ids are smaller than all others, and if all ids are null all are
    responses. Null html is an empty payload. Control characters and spaces of a URL become %20. Other columns are
    ignored. An empty table gives an empty result.
    """
    spark = pages.sparkSession
    ws = Workspace(spark, "warc")
    raw, folder = ws.path("monolithic"), ws.path("normalised")
    id_type = pages.schema[page_id].dataType.simpleString()
    write_archives(pages.select(page_id, url, html), raw, page_id=page_id, url=url, html=html)
    done = ws.table(normalise(spark, raw, folder), "normalised-files")
    if done.agg(F.sum("records")).first()[0] is None:
        return spark.createDataFrame([], f"page_id {id_type}, payload_bytes long, payload_digest string, record_type string, refers_to {id_type}")
    return read_records(spark, folder, id_type, payloads)


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_pages(read(spark, sf_dir, "pages"))


OP2_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
heads AS (SELECT h, max(page_id) AS head FROM p WHERE strlen(h) >= 1000 GROUP BY h)
SELECT page_id,
       CAST(strlen(p.h) AS BIGINT) AS payload_bytes,
       sha1(p.h) AS payload_digest,
       CASE WHEN head <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN head <> page_id THEN head END AS refers_to
FROM p LEFT JOIN heads ON p.h = heads.h
"""
