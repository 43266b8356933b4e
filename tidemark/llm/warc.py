"""WARC archives: segmented records written and read back, continuations joined, chunks decoded."""

from __future__ import annotations

import base64
import hashlib
import re
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialise, new_path

_DATE = "2024-01-01T00:00:00Z"
_REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def digest(payload: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


# ---------------------------------------------------------------- records


def chunked(payload: bytes, size: int) -> bytes:
    """Chunked transfer framing."""
    cut = [payload[i : i + size] for i in range(0, len(payload), size)]
    return b"".join(b"%x\r\n%s\r\n" % (len(c), c) for c in cut) + b"0\r\n\r\n"


def unchunked(body: bytes) -> bytes:
    """The payload of chunked framing; chunk extensions and trailers are skipped."""
    out, at = [], 0
    while True:
        line = body.index(b"\r\n", at)
        n = int(body[at:line].split(b";")[0], 16)
        if not n:
            return b"".join(out)
        out.append(body[line + 2 : line + 2 + n])
        if len(out[-1]) != n or body[line + 2 + n : line + 4 + n] != b"\r\n":
            raise ValueError(f"a chunk of {n} bytes is cut short")
        at = line + 4 + n


def record(kind: str, record_id: str, block: bytes, **fields: str | None) -> bytes:
    """A record without its last line end."""
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{record_id}>", f"WARC-Date: {_DATE}"]
    lines += [f"{k.replace('_', '-')}: {v}" for k, v in fields.items() if v is not None]
    lines.append(f"Content-Length: {len(block)}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n"


def segments(record_id: str, block: bytes, size: int, **fields: str | None) -> list[bytes]:
    """One response record, or a first segment and its continuation records."""
    if len(block) <= size:
        return [record("response", record_id, block, **fields)]
    cut = [block[i : i + size] for i in range(0, len(block), size)]
    out = [record("response", record_id, cut[0], WARC_Segment_Number="1", **fields)]
    for n, part in enumerate(cut[1:], 2):
        last = {"WARC_Segment_Total_Length": str(len(block))} if n == len(cut) else {}
        out.append(record("continuation", f"{record_id}:{n}", part, WARC_Segment_Origin_ID=f"<{record_id}>", WARC_Segment_Number=str(n), **last))
    return out


def parse(blob: bytes):
    """Header fields (lower-case names) and block of each record of an archive, plain or gzipped."""
    while blob[:2] == b"\x1f\x8b":  # any number of members
        plain, rest = [], blob
        while rest:
            member = zlib.decompressobj(31)
            plain.append(member.decompress(rest))
            rest = member.unused_data
        blob = b"".join(plain)
    at = 0
    while at < len(blob):
        end = blob.index(b"\r\n\r\n", at)
        first, *lines = blob[at:end].decode().split("\r\n")
        if not first.startswith("WARC/"):
            raise ValueError(f"no record at byte {at}")
        head = {k.strip().lower(): v.strip() for k, v in (x.split(":", 1) for x in lines)}
        n = int(head["content-length"])
        yield head, blob[end + 4 : end + 4 + n]
        at = end + 4 + n + 4


# ---------------------------------------------------------------- tables


def _record_id(page: int | None, said: str, copy: int) -> str:
    return f"urn:x-page:{'' if page is None else page}:{said}:{copy}"


def mark_revisits(pages: DataFrame, least_bytes: int = 0, id_col: str = "page_id", payload_col: str = "html") -> DataFrame:
    """page_id, url, payload, refers_to (null for responses) and copy of each row.

    Among payloads of at least `least_bytes` that are equal, the smallest id is the response. copy numbers the rows
    alike in id and payload from 0. Ids are reduced per SHA-1 before the join; a payload shared by very many
    pages is a skewed join that Spark splits. Rows that are repeated are few as a rule: they are told by a small written
    table, so that the others go without a window.
    """
    url = F.col("url").cast("string") if "url" in pages.columns else F.lit(None).cast("string")
    base = pages.select(F.col(f"`{id_col}`").cast("long").alias("page_id"), url.alias("url"), F.coalesce(F.col(f"`{payload_col}`").cast("binary"), F.lit(b"")).alias("payload"))
    keyed = base.withColumn("_sha", F.unhex(F.sha1("payload")))
    pairs = keyed.groupBy("_sha", "page_id").agg(F.count("*").alias("_n"))
    firsts = pairs.groupBy("_sha").agg(F.min("page_id").alias("_first"), F.sum("_n").alias("_all")).where("_all > 1").drop("_all")
    again = materialise(pairs.where("_n > 1").select(F.col("_sha").alias("_s"), F.col("page_id").alias("_p")), "repeated-pages")
    alike = (F.col("_sha") == F.col("_s")) & F.col("page_id").eqNullSafe(F.col("_p"))
    one = keyed.join(again, alike, "left_anti").withColumn("copy", F.lit(0))
    more = keyed.join(again, alike, "left_semi").withColumn("copy", F.row_number().over(Window.partitionBy("page_id", "_sha").orderBy("url")) - 1)
    other = F.col("page_id").isNull() | (F.col("page_id") > F.col("_first"))
    refers = F.when(other & F.col("_first").isNotNull() & (F.length("payload") >= least_bytes), F.col("_first"))
    return one.union(more).join(firsts, "_sha", "left").select("page_id", "url", "payload", refers.alias("refers_to"), "copy")


def write_archives(marked: DataFrame, path: str, segment_bytes: int = 4096, chunk_bytes: int = 1500, file_records: int = 20_000) -> None:
    """Writes one record per row (or one per segment) as gzipped archives of at most `file_records` records.

    The block is an HTTP response with chunked framing. A revisit keeps the header, with the full payload's
    length and digest. A record's id is made of its page's id, the payload's digest and the number of the copy, so it is
    the same in every run, and a revisit refers to the id of the response's record. Spark's text writer
    writes the bytes as they are and ends each record with its line end, so the files are committed like any table's;
    a file is one gzip member, without a warcinfo record.
    """

    def run(batches):
        for batch in batches:
            out = []
            for page, url, payload, refers, copy in zip(*(batch.column(i).to_pylist() for i in range(5))):
                said = digest(payload)
                record_id = _record_id(page, said, copy)
                fields = {"WARC_Target_URI": re.sub(r"\s", "%20", url) if url else None, "WARC_Payload_Digest": f"sha1:{said}", "Content_Type": "application/http;msgtype=response"}
                if refers is not None:
                    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
                    out.append(record("revisit", record_id, http, WARC_Profile=_REVISIT, WARC_Refers_To=f"<{_record_id(refers, said, 0)}>", **fields))
                else:
                    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n" + chunked(payload, chunk_bytes)
                    out += segments(record_id, http, segment_bytes, **fields)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["record"])

    records = marked.mapInArrow(run, "record binary").select(F.col("record").cast("string"))
    records.write.option("lineSep", "\r\n").option("compression", "gzip").option("maxRecordsPerFile", file_records).text(path)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to and payload (null for revisits).

    Records that stand whole are decoded where they are read. First segments and continuations are grouped by
    their origin's id and ordered by number; numbers must be 1 to n and the joined block as long as
    the last says, else the query fails. Digests are checked against the decoded payload.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).where("length > 0").select("content")
    plain = "record_id string, type string, digest string, refers string, number int, total long, block binary"

    def split(batches):
        for batch in batches:
            for blob in batch.column(0):
                rows, size = [], 0
                for head, block in parse(blob.as_py()):
                    bare = lambda k, h=head: h[k].strip("<>") if k in h else None
                    number = int(head["warc-segment-number"]) if "warc-segment-number" in head else None
                    total = int(head["warc-segment-total-length"]) if "warc-segment-total-length" in head else None
                    rows.append((bare("warc-segment-origin-id") or bare("warc-record-id"), head["warc-type"], head.get("warc-payload-digest"), bare("warc-refers-to"), number, total, block))
                    size += len(block)
                    if size > 8e6:
                        yield _batch(rows, _SPLIT)
                        rows, size = [], 0
                yield _batch(rows, _SPLIT)

    records = files.mapInArrow(split, plain)
    parts = records.where("number is not null").groupBy("record_id").agg(
        F.max("digest").alias("digest"), F.max("total").alias("total"), F.sort_array(F.collect_list(F.struct("number", "block"))).alias("parts")
    )
    joined = parts.selectExpr("record_id", "'response' as type", "digest", "cast(null as string) as refers", "total", "parts")
    whole = records.where("number is null").selectExpr("record_id", "type", "digest", "refers", "cast(null as bigint) as total", "array(struct(1 as number, block)) as parts")

    def decode(batches):
        for batch in batches:
            rows = []
            for record_id, kind, said, refers, total, parts in zip(*(batch.column(i).to_pylist() for i in range(6))):
                block = b"".join(p["block"] for p in parts)
                if [p["number"] for p in parts] != list(range(1, len(parts) + 1)) or total not in (None, len(block)) or (len(parts) > 1 and total is None):
                    raise ValueError(f"{record_id}: segments are missing or {len(block)} bytes are not {total}")
                http, _, body = block.partition(b"\r\n\r\n")
                fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in http.decode("latin-1").split("\r\n")[1:])}
                page = record_id.split(":")[2]
                if kind == "revisit":
                    rows.append((int(page) if page else None, int(fields["content-length"]), said[5:], kind, int(refers.split(":")[2]), None))
                    continue
                payload = unchunked(body) if fields.get("transfer-encoding") == "chunked" else body
                if f"sha1:{digest(payload)}" != said:
                    raise ValueError(f"{record_id}: the payload's digest is not {said}")
                rows.append((int(page) if page else None, len(payload), said[5:], kind, None, payload))
            yield _batch(rows, _PAGES)

    return joined.union(whole).mapInArrow(decode, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary")


_SPLIT = pa.schema([("record_id", pa.string()), ("type", pa.string()), ("digest", pa.string()), ("refers", pa.string()), ("number", pa.int32()), ("total", pa.int64()), ("block", pa.binary())])
_PAGES = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def round_trip(pages: DataFrame, path: str | None = None, least_bytes: int = 0, segment_bytes: int = 4096) -> DataFrame:
    """Writes `pages` (page_id, url if there, html) as archives under `path` and reads them back, one row per page row.

    Null html is an empty payload. Rows with the smallest id of equal payloads are responses, also where
    that id is repeated; a null id counts as larger than any, and rows of a payload that has only null ids are
    all responses. An empty table gives no rows; other columns are ignored whatever their names. A page must fit a
    task a few times over, whatever its length: it is written in segments and put together again.
    """
    path = path or new_path(pages.sparkSession, "warc")
    write_archives(mark_revisits(pages, least_bytes), path, segment_bytes)
    return read_archives(pages.sparkSession, path)
