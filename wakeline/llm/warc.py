"""WARC archives, index first.

write() puts each page into gzip-per-record WARC files of the shared folder and returns an index (file, offset, length,
url, digest, ...) that is written as Parquet before anything is read. read() takes any selection of index rows, sorts
them by file and offset, joins near ranges into one read, and parses the records.

Of pages with equal payloads of at least `least` bytes the one of largest id is a response and the others are revisits,
which hold no payload: payload length and digest stand in their header. Payloads are not shuffled: digests are grouped
first, a bitmap of fixed size tells which pages may be revisits, and only these are checked by a join.

A task writes its files under names of its own and gives them their final names when it has written all of them, so
what a failed attempt leaves has no name of an archive; the index holds the files of the attempts that counted. Reading
is dealt out by stretches of STRETCH_BYTES of a file to as many tasks as the selected bytes need. A very long payload is
one record, in memory once in a task. Defined results: an empty table gives no records; null html is an empty payload, a null url is empty, control characters in a
url are percent-encoded in the record; a page without id is a revisit if its payload has a response, else a response;
repeated rows of a largest id are all responses; extra columns play no part.
"""

from __future__ import annotations

import base64
import hashlib
import math
import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import fresh_path, written

FILE_BYTES = 64 << 20
#: Ranges at most this far apart are read at once, up to READ_BYTES.
GAP_BYTES, READ_BYTES = 64 << 10, 8 << 20
#: Records that begin in one stretch of a file go to one task, and so many bytes of selected records are a task's share.
STRETCH_BYTES, TASK_BYTES = 4 << 20, 4 << 20
MOST_TASKS = 100_000
FILTER_BITS = 1 << 25
LEVEL = 1
INDEX = "file string, offset long, length long, page_id long, url string, digest string, payload_bytes long, record_type string"
RECORDS = "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long"
_DATE = "2024-01-01T00:00:00Z"


def digest32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id} {digest}')}>"


def _clean(url: str) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)


def record(page_id: int | None, url: str, digest: str, size: int, payload: bytes | None, refers_to: int | None) -> bytes:
    """One gzip member. payload None makes a revisit of refers_to."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: %d\r\n\r\n" % size
    body = http + (payload or b"")
    head = ["WARC/1.1", f"WARC-Type: {'response' if payload is not None else 'revisit'}", f"WARC-Target-URI: {_clean(url)}", f"WARC-Date: {_DATE}", f"WARC-Record-ID: {_record_id(page_id, digest)}", f"WARC-Payload-Digest: sha1:{digest}"]
    if payload is None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_record_id(refers_to, digest)}", f"Refers-To-Page: {refers_to}"]
    head += [f"Page: {'' if page_id is None else page_id}", f"Payload-Length: {size}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(body)}"]
    z = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return z.compress("\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n") + z.flush()


def parse(member: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields and payload of one record; raises ValueError where lengths don't agree."""
    raw = zlib.decompress(member, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
    fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(": "), "") for x in lines[1:])
    n = int(fields["Content-Length"])
    if rest[n:] != b"\r\n\r\n":
        raise ValueError("record length")
    return fields, rest[:n].partition(b"\r\n\r\n")[2]


def _writer(folder: str, response: bool):
    """Writes rows (page_id, url, html | digest, payload_bytes, refers_to) and gives their index rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pyarrow.fs.FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        out, name, offset, names = None, "", 0, []
        try:
            for b in batches:
                rows: list[tuple] = []
                for start in range(0, b.num_rows, 256):
                    for r in b.slice(start, 256).to_pylist():
                        if out is None or offset >= FILE_BYTES:
                            if out is not None:
                                out.close()
                            name, offset = f"{uuid.uuid4().hex}.warc.gz", 0
                            names.append(name)
                            out = fs.open_output_stream(f"{root}/_{name}", compression=None)
                        url = r["url"] or ""
                        if response:
                            payload = (r["html"] or "").encode()
                            digest, size = digest32(payload), len(payload)
                        else:
                            payload, size = None, r["payload_bytes"]
                            digest = base64.b32encode(bytes.fromhex(r["digest"])).decode()
                        member = record(r["page_id"], url, digest, size, payload, r.get("refers_to"))
                        out.write(member)
                        rows.append((name, offset, len(member), r["page_id"], url, digest, size, "response" if response else "revisit"))
                        offset += len(member)
                cols = list(zip(*rows, strict=True)) if rows else [()] * 8
                kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=[x.split()[0] for x in INDEX.split(", ")])
        finally:
            if out is not None:
                out.close()
        for name in names:
            fs.move(f"{root}/_{name}", f"{root}/{name}")

    return run


def _may_be(ids: DataFrame) -> np.ndarray:
    slot = f"pmod(xxhash64(page_id), {FILTER_BITS})"
    """A bitmap of fixed size, gathered as at most FILTER_BITS / 32 numbers."""
    out = np.zeros(FILTER_BITS // 32, np.uint32)
    words = ids.groupBy(F.expr(f"cast({slot} div 32 as int)").alias("word")).agg(F.expr(f"bit_or(shiftleft(1L, cast({slot} % 32 as int)))").alias("bits")).toArrow()
    out[words["word"].to_numpy()] = words["bits"].to_numpy()
    return out


def _where_bit(bits, wanted: bool):
    """Rows whose slot is set, or isn't; the last column is the slot and is left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = bits.value
        for b in batches:
            slot = b.column(b.num_columns - 1).to_numpy()
            is_set = (words[slot // 32] >> (slot % 32).astype(np.uint32)) & np.uint32(1) == 1
            yield b.select(list(range(b.num_columns - 1))).filter(pa.array(is_set == wanted))

    return run


def write(pages: DataFrame, folder: str | None = None, least: int = 0) -> tuple[DataFrame, str]:
    """Writes the archives; returns their index and the folder."""
    spark = pages.sparkSession
    folder = folder or fresh_path(spark, "warc")
    html = F.coalesce("html", F.lit(""))
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    narrow = own.select("page_id", "url", F.sha1(html).alias("digest"), F.octet_length(html).cast("long").alias("payload_bytes"))
    shared = narrow.where(F.col("payload_bytes") >= least).groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1 and refers_to is not null").drop("n")
    revisits = narrow.join(shared, "digest").where((F.col("payload_bytes") >= least) & (F.col("page_id").isNull() | (F.col("page_id") < F.col("refers_to"))))
    revisits = written(revisits.select("page_id", "url", "digest", "payload_bytes", "refers_to"), "revisits")
    bits = spark.sparkContext.broadcast(_may_be(revisits.select("page_id")))
    slotted = own.withColumn("slot", F.expr(f"pmod(xxhash64(page_id), {FILTER_BITS})"))
    sure = slotted.mapInArrow(_where_bit(bits, False), own.schema)
    # page_id and payload make sure of a revisit: an id may stand twice with different pages
    gone = revisits.select(F.col("page_id").alias("__id"), F.col("digest").alias("__digest")).distinct()
    checked = slotted.mapInArrow(_where_bit(bits, True), own.schema)
    checked = checked.join(gone, checked["page_id"].eqNullSafe(gone["__id"]) & (F.sha1(html) == gone["__digest"]), "left_anti")
    index = sure.union(checked).mapInArrow(_writer(folder, True), INDEX).union(revisits.mapInArrow(_writer(folder, False), INDEX))
    return written(index, "warc-index"), folder


def read(index: DataFrame, folder: str, payloads: bool = True) -> DataFrame:
    """The records of the selected index rows; a response's digest is computed anew from its bytes and compared."""

    def pieces(rows: list[dict]) -> Iterator[list[dict]]:
        """Runs of rows, sorted by offset, that one read serves."""
        run: list[dict] = []
        for r in rows:
            if run and (r["file"] != run[0]["file"] or r["offset"] - (run[-1]["offset"] + run[-1]["length"]) > GAP_BYTES or r["offset"] + r["length"] - run[0]["offset"] > READ_BYTES):
                yield run
                run = []
            run.append(r)
        if run:
            yield run

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pyarrow.fs.FileSystem.from_uri(folder)
        for b in batches:
            for part in pieces(b.to_pylist()):
                with fs.open_input_file(f"{root}/{part[0]['file']}") as f:
                    start = part[0]["offset"]
                    data = f.read_at(part[-1]["offset"] + part[-1]["length"] - start, start)
                out: list[tuple] = []
                for r in part:
                    fields, payload = parse(data[r["offset"] - start : r["offset"] - start + r["length"]])
                    kind, digest = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha1:")
                    if kind == "response" and digest32(payload) != digest:
                        raise ValueError(f"digest of {r['file']} at {r['offset']}")
                    refers = fields.get("Refers-To-Page")
                    size = len(payload) if kind == "response" else int(fields["Payload-Length"])
                    out.append((int(fields["Page"]) if fields["Page"] else None, fields["WARC-Target-URI"], payload if payloads and kind == "response" else None, size, digest, kind, int(refers) if refers is not None else None))
                kinds = (pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.string(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=[x.split()[0] for x in RECORDS.split(", ")])

    chosen = index.select("file", "offset", "length")
    # index rows are small, so the count of tasks is named: adaptive execution would put them all into one
    tasks = min(MOST_TASKS, max(1, math.ceil((chosen.agg(F.sum("length")).first()[0] or 0) / TASK_BYTES)))
    return chosen.repartition(tasks, "file", F.floor(F.col("offset") / STRETCH_BYTES)).sortWithinPartitions("file", "offset").mapInArrow(run, RECORDS)


def round_trip(pages: DataFrame, least: int = 0) -> DataFrame:
    """Writes all pages, reads all records back: (page_id, payload_bytes, payload_digest, record_type, refers_to)."""
    index, folder = write(pages, least=least)
    return read(index, folder, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
