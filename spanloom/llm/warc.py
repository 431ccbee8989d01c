"""Operator 8: WARC archives, written from pages, read back and assembled into transactions.

Writing: each page makes a response or revisit record, a request and a metadata record, the last two
concurrent to the first. Every record is a gzip member of its own, as readers of .warc.gz files that
seek by offset need it. Spark's own writer makes the files, so they go to any store and a lost task's
files are written again: members of records under SPLIT bytes end with a zero byte (the top of their
length), which serves as the writer's line separator; a larger record has a file to itself. Files have
about FILE_BYTES. Of pages with equal payloads (of at least LEAST_BYTES), that with the largest page_id
holds the payload; the others are revisit records that refer to it.

Reading: a file is unpacked member by member and its records are cut by their Content-Length fields, wherever
the payload has blank lines. Files without compression, or compressed as a whole, are read as well.

Assembly: requests and metadata are joined to the capture that they name as concurrent, or that names
them, or that a record they name is concurrent to; each capture becomes one nested row. All joins
are on record identifiers, which no two captures share.

Defined cases: null html is an empty payload; a null url leaves out the target; pages with a null
page_id are written and read back with a null one, and hold the payload only if no page with an id has
it; a page_id may come with several payloads; of repeated rows one holds the payload and the others
revisit it; an empty table makes an empty archive and result; columns other than page_id, url and html
are not read. A record that names no capture is in no transaction.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm.common import Stash, shared_dir, small_batches, table, written

LEAST_BYTES = 0
FILE_BYTES, SPLIT = 64 << 20, 1 << 24
BROADCAST_PAYLOADS = 100_000
SALTS = 32
EMPTY = 20  # bytes of a gzip member of nothing
END = b"\r\n\r\n"
DATE = "2024-01-01T00:00:00Z"
RECORD = "record_id string, type string, concurrent_to array<string>, refers_to string, target_uri string, date string, payload_digest string, content_type string, headers map<string,string>, http_length long, payload_bytes long, payload_sha1 string, block binary"
CAPTURES, COMPANIONS = ("response", "revisit", "resource"), ("request", "metadata")
TARGET = re.compile(r"[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)(.*)", re.S)


def base32(sha1_hex: str) -> str:
    return base64.b32encode(bytes.fromhex(sha1_hex)).decode()


def record_id(kind: str, page_id: str | None, row: int, sha: str) -> str:
    name = f"{kind}|{row}|{'-' if page_id is None else page_id}|{sha}"
    return f"<urn:uuid:{uuid.UUID(hashlib.md5(name.encode()).hexdigest())}>"


def record(kind: str, own: str, fields: list[tuple[str, str | None]], block: bytes) -> bytes:
    """Header lines (those without a value are left out), a blank line, the block and the closing blank lines."""
    lines = [("WARC-Type", kind), ("WARC-Record-ID", own), ("WARC-Date", DATE), *fields, ("Content-Length", str(len(block)))]
    return b"".join([b"WARC/1.1\r\n", *(f"{k}: {v}\r\n".encode("utf-8", "replace") for k, v in lines if v is not None), b"\r\n", block, END])


def records(page_id: str | None, row: int, url: str | None, html: bytes, sha: str, holder: str | None) -> Iterator[bytes]:
    """A page's three records; holder: the record that has its payload, if it is another."""
    uri = None if url is None else re.sub(r"[\r\n]", "%0A", url)
    own, asked, about = (record_id(kind, page_id, row, sha) for kind in ("response", "request", "metadata"))
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(html)}\r\n\r\n".encode()
    fields = [("WARC-Target-URI", uri), ("WARC-Payload-Digest", f"sha1:{base32(sha)}"), ("Content-Type", "application/http; msgtype=response")]
    if holder is None:
        yield record("response", own, fields, http + html)
    else:
        yield record("revisit", own, [*fields, ("WARC-Refers-To", holder), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")], http)
    near = [("WARC-Target-URI", uri), ("WARC-Concurrent-To", own)]
    m = TARGET.match(uri or "")
    host, target = m.groups() if m else ("", "")
    yield record("request", asked, [*near, ("Content-Type", "application/http; msgtype=request")], f"GET {target or '/'} HTTP/1.1\r\nHost: {host}\r\n\r\n".encode("utf-8", "replace"))
    yield record("metadata", about, [*near, ("Content-Type", "application/warc-fields")], b"" if page_id is None else f"page-id: {page_id}\r\n".encode("utf-8", "replace"))


def member(data: bytes) -> bytes:
    """A gzip member without a time, so that it is the same in every run."""
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def write_warc(spark: SparkSession, pages: DataFrame, path: str, least_bytes: int = LEAST_BYTES) -> None:
    body = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select("page_id", F.col("url").cast("string").alias("url"), body.alias("html")).withColumn("sha", F.sha1("html"))
    slim = Stash(spark, "digests").put(rows.select("page_id", "sha", F.length("html").alias("bytes"), F.lit(0).cast("long").alias("row")))
    if slim.groupBy("page_id", "sha").count().where("count > 1").limit(1).count():  # only then rows need numbers, written so that they stay
        rows = Stash(spark, "pages").put(rows.withColumn("row", F.monotonically_increasing_id()))
        slim = rows.select("page_id", "sha", F.length("html").alias("bytes"), "row")
    else:
        rows = rows.withColumn("row", F.lit(0).cast("long"))
    rank = F.struct(F.col("page_id").isNotNull().alias("known"), "page_id", "row")
    shared = slim.where(F.col("bytes") >= least_bytes).groupBy("sha").agg(F.max(rank).alias("holder"), F.count("*").alias("n")).where("n > 1").select("sha", "holder")
    shared = Stash(spark, "payloads").put(shared)  # known before the pages are joined, which then stay where they are
    if shared.count() <= BROADCAST_PAYLOADS:
        joined = rows.join(F.broadcast(shared), "sha", "left")
    else:  # a payload may have a third of all rows: it is dealt to SALTS tasks
        salted = shared.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = rows.withColumn("salt", F.pmod(F.xxhash64("page_id", "row"), F.lit(SALTS)).cast("int")).join(salted, ["sha", "salt"], "left")
    held = F.col("holder").isNotNull() & ~(F.col("page_id").eqNullSafe(F.col("holder.page_id")) & (F.col("row") == F.col("holder.row")))
    parts = joined.select(F.col("page_id").cast("string").alias("page_id"), "row", "url", "html", "sha", held.alias("held"), F.col("holder.page_id").cast("string").alias("to_page"), F.col("holder.row").alias("to_row"))

    def members(batches):
        for b in batches:
            out, size = [], 0
            for page_id, row, url, html, sha, held, to_page, to_row in zip(*(b.column(i).to_pylist() if i != 3 else b.column(i) for i in range(8))):
                for data in records(page_id, row, url, html.as_py(), sha, record_id("response", to_page, to_row, sha) if held else None):
                    large = len(data) >= SPLIT
                    out.append((data[: -len(END)] if large else member(data)[:-1], large))
                    size += len(out[-1][0])
                if size > SPLIT:
                    yield pa.RecordBatch.from_pylist([{"value": v, "large": x} for v, x in out], pa.schema([("value", pa.binary()), ("large", pa.bool_())]))
                    out, size = [], 0
            yield pa.RecordBatch.from_pylist([{"value": v, "large": x} for v, x in out], pa.schema([("value", pa.binary()), ("large", pa.bool_())]))

    n, total, most = slim.agg(F.count("*"), F.sum("bytes"), F.max("bytes")).first()
    made = small_batches(parts).mapInArrow(members, "value binary, large boolean")
    text = lambda df, mode: df.select(F.col("value").cast("string").alias("value")).write.mode(mode)
    a_file = max(1, min(1_000_000, FILE_BYTES * 3 // max(1, (total or 0) // max(1, n) + 1500)))
    text(made.where("not large"), "errorifexists").option("lineSep", "\0").option("maxRecordsPerFile", a_file).text(path)
    if (most or 0) > SPLIT - (64 << 10):  # the closing blank lines are the separator, and the file's compression makes the one member
        text(made.where("large"), "append").option("lineSep", END.decode()).option("maxRecordsPerFile", 1).option("compression", "gzip").text(path)
    name_files(spark, path)


def name_files(spark: SparkSession, path: str) -> None:
    """Spark's part files get names that end with .warc.gz; those without a record go."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    for status in fs.listStatus(at):
        name = status.getPath().getName()
        if name.startswith("part-") and status.getLen() <= EMPTY:
            fs.delete(status.getPath(), False)
        elif name.startswith("part-"):
            fs.rename(status.getPath(), spark._jvm.org.apache.hadoop.fs.Path(at, re.sub(r"\.txt(\.gz)?$", "", name) + ".warc.gz"))


def unpacked(content: bytes, step: int = 1 << 14) -> Iterator[bytes]:
    """The gzip members of a file one after the other, or the file itself if it isn't compressed."""
    if content[:2] != b"\x1f\x8b":
        yield content
        return
    at = 0
    while at < len(content):
        reader, parts = zlib.decompressobj(31), []
        while not reader.eof:
            if at >= len(content):
                raise ValueError("a member is cut off")
            parts.append(reader.decompress(content[at : at + step]))
            at += step
        at = min(at, len(content)) - len(reader.unused_data)
        yield b"".join(parts)


def parse(data: bytes):
    """Yields (headers, block) of each record of a member."""
    at = 0
    while at < len(data):
        stop = data.find(END, at)
        if stop < 0:
            if data[at:].strip():
                raise ValueError("a record without a blank line")
            return
        head = data[at:stop].decode("utf-8", "replace").split("\r\n")
        if not head[0].startswith("WARC/"):
            raise ValueError(f"not a record: {head[0][:40]!r}")
        headers: list[tuple[str, str]] = []
        for line in head[1:]:
            name, _, value = line.partition(":")
            headers.append((name.strip().lower(), value.strip()))
        length = int(dict(headers)["content-length"])
        block = data[stop + 4 : stop + 4 + length]
        if len(block) < length:
            raise ValueError("a record is cut off")
        yield headers, block
        at = stop + 4 + length + 4


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """A row for each record; payload fields only where the block holds an HTTP response's payload."""
    names = [c.split()[0] for c in RECORD.split(", ")]

    def one(headers: list[tuple[str, str]], block: bytes) -> tuple:
        h = dict(headers)
        http, size, sha = None, None, None
        if h.get("content-type", "").startswith("application/http") and "response" in h["content-type"]:
            top, _, payload = block.partition(b"\r\n\r\n")
            for line in top.split(b"\r\n")[1:]:
                name, _, value = line.partition(b":")
                if name.strip().lower() == b"content-length" and value.strip().isdigit():
                    http = int(value)
            if h["warc-type"] == "response":
                size, sha = len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode()
        near = [v for k, v in headers if k == "warc-concurrent-to"]
        return (h.get("warc-record-id"), h.get("warc-type"), near, h.get("warc-refers-to"), h.get("warc-target-uri"), h.get("warc-date"), h.get("warc-payload-digest"), h.get("content-type"), h, http, size, sha, block)

    def rows(batches):
        for b in batches:
            for content in b.content:
                out, size = [], 0
                for headers, block in (r for data in unpacked(content) for r in parse(data)):
                    out.append(one(headers, block))
                    size += len(block)
                    if len(out) == 500 or size > SPLIT:
                        yield pd.DataFrame(out, columns=names)
                        out, size = [], 0
                if out:
                    yield pd.DataFrame(out, columns=names)

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(rows, RECORD)


def assemble(records: DataFrame, keep: tuple[str, ...] = ("record_id", "target_uri", "content_type", "block")) -> DataFrame:
    """One row for each capture, with its columns, `request` (that with the smallest identifier, if several) and `metadata`,
    structs of the columns in keep, and the number of each."""
    captures = records.where(F.col("type").isin(*CAPTURES))
    rest = records.where(F.col("type").isin(*COMPANIONS))
    ids = captures.select(F.col("record_id").alias("capture"))
    named = rest.select(F.col("record_id").alias("other"), F.explode("concurrent_to").alias("capture"))
    back = captures.select(F.explode("concurrent_to").alias("other"), F.col("record_id").alias("capture"))
    direct = named.join(ids, "capture", "left_semi").select("other", "capture").unionByName(back).distinct()
    through = named.select("other", F.col("capture").alias("by")).join(direct.select(F.col("other").alias("by"), "capture"), "by").select("other", "capture")
    links = direct.unionByName(through).distinct()
    body = rest.select(F.col("record_id").alias("other"), "type", F.struct(*keep).alias("body"))
    joined = links.join(body, "other")
    of = lambda kind: F.min_by(F.when(F.col("type") == kind, F.col("body")), F.when(F.col("type") == kind, F.col("other")))
    groups = joined.groupBy(F.col("capture").alias("record_id")).agg(
        of("request").alias("request"), of("metadata").alias("metadata"), F.count_if(F.col("type") == "request").alias("n_requests"), F.count_if(F.col("type") == "metadata").alias("n_metadata")
    )
    return captures.join(groups, "record_id", "left")


def archived(spark: SparkSession, pages: DataFrame, path: str | None = None, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """Writes the archive, reads it back, and returns a row for each page from what it holds."""
    if path is None:
        path = f"{shared_dir(spark)}/archive-{uuid.uuid4().hex}.warc"
        written(path)
    write_warc(spark, pages, path, least_bytes)
    slim = read_warc(spark, path).withColumn("block", F.when(F.col("type") == "metadata", F.col("block"))).drop("headers", "target_uri", "date", "content_type")
    seen = assemble(Stash(spark, "records").put(slim), ("block",))  # the files are parsed once
    kind = pages.schema["page_id"].dataType.simpleString()
    page = F.regexp_extract(F.col("metadata.block").cast("string"), r"^page-id: ([^\r\n]*)", 1)
    page = F.when(F.col("metadata.block").cast("string").startswith("page-id: "), page).cast(kind)
    flat = seen.select("record_id", page.alias("page_id"), "type", "refers_to", "http_length", "payload_bytes", "payload_sha1", F.regexp_replace("payload_digest", "^sha1:", "").alias("said"))
    flat = Stash(spark, "captures").put(flat)
    holders = flat.where("type = 'response'").select(F.col("record_id").alias("refers_to"), F.col("page_id").alias("holder_page"), F.col("payload_bytes").alias("holder_bytes"), F.col("payload_sha1").alias("holder_sha1"))
    revisits = flat.where("type = 'revisit'")  # responses need no holder and stay where they are
    wanted = holders.join(revisits.select("refers_to").distinct(), "refers_to", "left_semi")
    wanted = Stash(spark, "holders").put(wanted)  # few of the responses are revisited
    if wanted.count() <= BROADCAST_PAYLOADS:
        full = revisits.join(F.broadcast(wanted), "refers_to", "left")
    else:  # a payload may have a third of all rows: its holder is dealt to SALTS tasks
        salted = wanted.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        full = revisits.withColumn("salt", F.pmod(F.xxhash64("record_id"), F.lit(SALTS)).cast("int")).join(salted, ["refers_to", "salt"], "left")
    own = flat.where("type = 'response'").select("page_id", "payload_bytes", F.col("payload_sha1").alias("payload_digest"), F.col("type").alias("record_type"), F.lit(None).cast(kind).alias("refers_to"))
    return own.unionByName(full.select("page_id", F.col("holder_bytes").alias("payload_bytes"), F.col("holder_sha1").alias("payload_digest"), F.col("type").alias("record_type"), F.col("holder_page").alias("refers_to")))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archived(spark, table(spark, sf_dir, "pages"))


OP8_SQL = """
with p as (select page_id, octet_length(encode(coalesce(html, ''))) n, sha1(coalesce(html, '')) h from pages),
d as (select page_id, n, array_to_string(list_transform(range(32), lambda i:
        substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((cast('0x' || substr(h, cast(5 * (i // 4) + 1 as bigint), 5) as int) >> cast(15 - 5 * (i % 4) as int)) & 31), 1)), '') g from p),
m as (select g, max(page_id) top from d group by g)
select page_id, cast(n as bigint) payload_bytes, g payload_digest, case when page_id = top then 'response' else 'revisit' end record_type,
       case when page_id <> top then top end refers_to
from d join m using (g)
"""
