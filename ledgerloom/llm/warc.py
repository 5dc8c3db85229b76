"""WARC archives: index first, then coalesced byte-range reads.

Writing makes gzip members, one for each record, in files of the shared folder, and an index
row (file, offset, length, URL, digest) for each record. A file gets its name when its task
ends, and only the rows of tasks that succeeded count, so retries leave whole archives.
Reading takes the index rows of the records wanted, sorted by file and offset, joins those that
lie near each other to ranges, and reads each range at once.

Of records with equal payloads (SHA-1 and length) of `least` bytes or more, the one with the
largest id is a response; others are revisits that refer to it.

Null html is an empty payload; a null URL has no header. Rows that share the largest id of a
payload are all responses. A null id is the smallest. Payloads of any length are kept whole.
Other columns don't matter.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._cluster import Scratch, partitions

FILE_BYTES = 256 << 20
RANGE_BYTES = 4 << 20
GAP_BYTES = 64 << 10
INDEX = "page_id long, url string, digest string, record_type string, file string, offset long, length long"
DATE = "2024-01-01T00:00:00Z"


def _name(page_id: int | None) -> str:
    return f"<urn:page:{'null' if page_id is None else page_id}>"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """A response, or a revisit: its HTTP headers only, which tell the length of the payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    head = ["WARC/1.0", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_name(page_id)}", f"WARC-Date: {DATE}"]
    if url is not None:
        safe = "".join(c if c.isprintable() and not c.isspace() else "".join(f"%{b:02X}" for b in c.encode()) for c in url)
        head.append(f"WARC-Target-URI: {safe}")
    head.append(f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}")
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.0/revisit/identical-payload-digest", f"WARC-Refers-To: {_name(refers_to)}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(head).encode() + block + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """WARC headers, HTTP headers and payload of one record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    own = dict(x.split(": ", 1) for x in lines[1:])
    block = rest[: int(own["Content-Length"])]
    if rest[len(block) :] != b"\r\n\r\n":
        raise ValueError("record of another length than its header tells")
    head, _, payload = block.partition(b"\r\n\r\n")
    return own, dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:]), payload


def file_system(folder: str) -> tuple[fs.FileSystem, str]:
    """The file system of a shared folder and the path in it; S3's schemes of Hadoop are read as s3."""
    if folder.startswith(("s3a://", "s3n://")):
        folder = "s3://" + folder.split("://", 1)[1]
    return fs.FileSystem.from_uri(folder)


def _write(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, root = file_system(folder)
        where.create_dir(root, recursive=True)
        task, part = TaskContext.get(), 0
        out = at = None

        def begin():
            nonlocal out, at, part
            at = f"part-{task.partitionId():05d}-{part:03d}-{uuid.uuid4().hex[:8]}.warc.gz"
            out, part = where.open_output_stream(f"{root}/{at}.tmp"), part + 1

        def finish():
            nonlocal out
            if out is not None:
                out.close()
                where.move(f"{root}/{at}.tmp", f"{root}/{at}")
                out = None

        for batch in batches:
            rows = []
            for page_id, url, html, digest, refers_to, kind in zip(*(batch.column(c) for c in ("page_id", "url", "html", "digest", "refers_to", "record_type"))):
                if out is None:
                    begin()
                kind = kind.as_py()
                raw = record(page_id.as_py(), url.as_py(), (html.as_py() or "").encode(), digest.as_py(), refers_to.as_py(), kind == "revisit")
                deflate = zlib.compressobj(3, wbits=31)
                member = deflate.compress(raw) + deflate.flush()
                rows.append((page_id.as_py(), url.as_py(), digest.as_py(), kind, at, out.tell(), len(member)))
                out.write(member)
                if out.tell() > FILE_BYTES:
                    finish()
            kinds = (pa.int64(), *[pa.string()] * 4, pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(list(zip(*rows)) or [[]] * 7, kinds)], names=[x.split()[0] for x in INDEX.split(", ")])
        finish()

    return run


def mark_revisits(pages: DataFrame, least: int = 1000) -> DataFrame:
    """page_id, url, html, digest, record_type, refers_to."""
    pages = pages.select("page_id", "url", "html", F.sha1(F.coalesce("html", F.lit(""))).alias("digest"), F.octet_length(F.coalesce("html", F.lit(""))).alias("n"))
    groups = pages.where(F.col("n") >= least).groupBy("digest", "n").agg(F.max("page_id").alias("kept"), F.count("*").alias("rows")).where("rows > 1").select("digest", "n", "kept")
    met = pages.join(groups, ["digest", "n"], "left")
    again = F.col("kept").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("kept"))
    return met.select("page_id", "url", "html", "digest", F.when(again, "revisit").otherwise("response").alias("record_type"), F.when(again, F.col("kept")).alias("refers_to"))


def write_archives(pages: DataFrame, scratch: Scratch, least: int = 1000) -> tuple[DataFrame, str]:
    """(index, folder) of archives with a record for each row of page_id, url, html."""
    folder = f"{scratch.path}/archives"
    return scratch.save(mark_revisits(pages, least).mapInArrow(_write(folder), INDEX), "index"), folder


READ = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload string"


def read_archives(index: DataFrame, folder: str, range_bytes: int = RANGE_BYTES, gap_bytes: int = GAP_BYTES) -> DataFrame:
    """Records of the index rows given. The payload of a revisit is null; its bytes and digest are told."""
    by = Window.partitionBy("file").orderBy("offset")
    near = index.select("file", "offset", "length").withColumn("gap", F.col("offset") - F.lag(F.col("offset") + F.col("length")).over(by))
    far = F.col("gap").isNull() | (F.col("gap") > gap_bytes) | (F.floor(F.col("offset") / range_bytes) != F.lag(F.floor(F.col("offset") / range_bytes)).over(by))
    ranges = near.withColumn("new", far.cast("int")).withColumn("range", F.sum("new").over(by))
    ranges = ranges.groupBy("file", "range").agg(F.array_sort(F.collect_list(F.struct("offset", "length"))).alias("at"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, root = file_system(folder)
        for batch in batches:
            for file, at in zip(batch.column("file").to_pylist(), batch.column("at").to_pylist()):
                rows, begin = [], at[0]["offset"]
                with where.open_input_file(f"{root}/{file}") as f:
                    data = f.read_at(at[-1]["offset"] + at[-1]["length"] - begin, begin)
                for x in at:
                    lo = x["offset"] - begin
                    own, http, payload = parse(zlib.decompress(data[lo : lo + x["length"]], wbits=31))
                    digest = base64.b32decode(own["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
                    whole = own["WARC-Type"] == "response"
                    if whole and (hashlib.sha1(payload).hexdigest() != digest or len(payload) != int(http["Content-Length"])):
                        raise ValueError(f"damaged record in {file} at {x['offset']}")
                    number = lambda s: None if s is None or s == "<urn:page:null>" else int(s[10:-1])
                    rows.append((number(own["WARC-Record-ID"]), own.get("WARC-Target-URI"), own["WARC-Type"], number(own.get("WARC-Refers-To")), int(http["Content-Length"]), digest, payload.decode() if whole else None))
                kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=[c.split()[0] for c in READ.split(", ")])

    return ranges.repartition(partitions(index.sparkSession), "file", "range").mapInArrow(run, READ)
