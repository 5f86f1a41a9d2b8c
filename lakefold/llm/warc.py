"""WARC archives as a chunked record table.

Writing: each task streams its records into one .warc.gz file (a gzip member
per record) below a shared folder; a payload is written, and its SHA-1 taken, in
chunks. The file appears under its name only when it is complete, and only files
that the manifest of the successful attempts names are read.

Reading: each file is streamed, and a record comes out as rows of its number,
a chunk number and at most CHUNK bytes, with the digest of the payload so far:
the last chunk's digest is the payload's. No record is ever held as a whole.
"""

from __future__ import annotations

import base64
import hashlib
import io
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lakefold.llm.shared import cut, fresh_path, small, store_of, uri_of

#: Bytes of a payload that one row carries, and of compressed input read at once.
CHUNK = 1 << 16
#: Payloads with fewer bytes are never revisits.
LEAST_BYTES = 1000
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_MANIFEST = "path string, records long, bytes long"
_CHUNKS = "path string, record_no long, record_id string, record_type string, target_uri string, refers_to string, page_id long, block_digest string, payload_digest string, chunk_no long, chunk_bytes long, running_bytes long, running_digest string, last boolean, chunk binary"


def record_id(page_id: int | None, payload_sha1: str, copy: int = 0) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'{page_id}/{payload_sha1}/{copy}')}>"


def _digest(sha1: str) -> str:
    return "sha1:" + base64.b32encode(bytes.fromhex(sha1)).decode()


def _hex(digest: str | None) -> str | None:
    return base64.b32decode(digest[5:]).hex() if digest and digest.startswith("sha1:") else None


def _header(page_id, url, sha1: str, length: int, response: int | None, full: int, copy: int) -> bytes:
    own = record_id(page_id, sha1, copy)
    block = sha1 if response is None else hashlib.sha1().hexdigest()
    lines = ["WARC/1.1", f"WARC-Type: {'response' if response is None else 'revisit'}", f"WARC-Record-ID: {own}", "WARC-Date: 2024-01-01T00:00:00Z"]
    if url is not None:
        lines.append("WARC-Target-URI: " + "".join(c if c > " " else "%%%02X" % ord(c) for c in url))
    lines += [f"WARC-Payload-Digest: {_digest(sha1)}", f"WARC-Block-Digest: {_digest(block)}"]
    if response is not None:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(response, sha1)}", f"X-Refers-To-Page: {response}", f"X-Payload-Length: {full}"]
    if page_id is not None:
        lines.append(f"X-Page-Id: {page_id}")
    lines += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {length}", "", ""]
    return "\r\n".join(lines).encode("utf-8", "surrogatepass")


def _writer(folder: str, level: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get()
        store, at = store_of(folder)
        store.create_dir(at, recursive=True)
        part = f"{at}/.{task.partitionId():06d}-{task.taskAttemptId()}.part"
        done = f"{at}/{task.partitionId():06d}-{task.taskAttemptId()}.warc.gz"
        records = size = 0
        out = None
        for batch in batches:
            for row in range(batch.num_rows):
                page, url, response, copy = (batch.column(c)[row].as_py() for c in ("page_id", "url", "response_id", "copy"))
                raw = batch.column("html")[row].as_buffer()  # a view, not a copy
                view = memoryview(raw) if raw is not None else memoryview(b"")
                sha = hashlib.sha1()
                for k in range(0, len(view), CHUNK):
                    sha.update(view[k : k + CHUNK])
                body = view if response is None else memoryview(b"")
                if out is None:
                    out = store.open_output_stream(part)
                gz = zlib.compressobj(level, zlib.DEFLATED, 31)
                size += out.write(gz.compress(_header(page, url, sha.hexdigest(), len(body), response, len(view), copy))) or 0
                for k in range(0, len(body), CHUNK):
                    if piece := gz.compress(body[k : k + CHUNK]):
                        out.write(piece)
                out.write(gz.compress(b"\r\n\r\n") + gz.flush())
                records += 1
        if out is not None:
            size = out.tell()
            out.close()
            store.move(part, done)
            yield pa.RecordBatch.from_arrays([pa.array([folder + "/" + done.rsplit("/", 1)[1]]), pa.array([records]), pa.array([size])], ["path", "records", "bytes"])

    return run


def write_archives(pages: DataFrame, folder: str, level: int = 1) -> DataFrame:
    """Writes (page_id, url, html, response_id, copy) as archives, one a task, and returns the manifest (path, records, bytes).

    response_id null: a response record with the payload; else a revisit of that
    page, without payload. A null html is an empty payload. copy tells rows of
    one page and payload apart, whose records would have one id otherwise; a
    revisit refers to copy 0.
    """
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("binary"), F.col("response_id").cast("long"), F.col("copy").cast("long"))
    return cut(rows.mapInArrow(_writer(uri_of(folder), level), _MANIFEST))


class _Members:
    """A stream over the concatenated gzip members of a file, read piece by piece."""

    def __init__(self, raw):
        self.raw, self.gz, self.held, self.rest = raw, zlib.decompressobj(31), b"", b""

    def _more(self) -> bool:
        data = self.rest or self.raw.read(CHUNK)
        if not data:
            return False
        if self.gz.eof:
            self.gz = zlib.decompressobj(31)
        self.held += self.gz.decompress(data, CHUNK)
        self.rest = self.gz.unused_data if self.gz.eof else self.gz.unconsumed_tail
        return True

    def line(self) -> bytes:
        while b"\r\n" not in self.held:
            if not self._more():
                out, self.held = self.held, b""
                return out
        out, self.held = self.held.split(b"\r\n", 1)
        return out + b"\r\n"

    def take(self, most: int) -> bytes:
        """Up to most bytes, and at least one unless the file has ended."""
        while not self.held and self._more():
            pass
        out, self.held = self.held[:most], self.held[most:]
        return out


def read_chunks_of(stream) -> Iterator[tuple[dict, int, bytes, int, str, bool]]:
    """(header, chunk number, chunk, bytes so far, digest so far, whether it is the last) from a .warc.gz stream."""
    source = _Members(stream)
    while True:
        line = source.line()
        while line == b"\r\n":
            line = source.line()
        if not line:
            return
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {line[:40]!r}")
        header = {}
        while (line := source.line()) not in (b"\r\n", b""):
            name, _, value = line.decode("utf-8", "surrogatepass").partition(":")
            header[name.strip().lower()] = value.strip()
        left, sha, seen, number = int(header["content-length"]), hashlib.sha1(), 0, 0
        while True:
            want, piece = min(left, CHUNK), b""
            pieces = []
            while want and (piece := source.take(want)):
                pieces.append(piece)
                want -= len(piece)
            if want:
                raise EOFError("the record ends early")
            piece = b"".join(pieces)
            left -= len(piece)
            seen += len(piece)
            sha.update(piece)
            yield header, number, piece, seen, sha.hexdigest(), left == 0
            number += 1
            if left == 0:
                break


def _reader(with_bytes: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("path", pa.string()), ("record_no", pa.int64()), *((c, pa.string()) for c in ("record_id", "record_type", "target_uri", "refers_to")), ("page_id", pa.int64()), ("block_digest", pa.string()), ("payload_digest", pa.string()), ("chunk_no", pa.int64()), ("chunk_bytes", pa.int64()), ("running_bytes", pa.int64()), ("running_digest", pa.string()), ("last", pa.bool_()), ("chunk", pa.binary())])
        rows: list[tuple] = []
        held = 0

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

        for batch in batches:
            for path in batch.column(0).to_pylist():
                store, at = store_of(path)
                record = -1
                with store.open_input_stream(at, compression=None) as raw:
                    for h, k, piece, seen, digest, last in read_chunks_of(raw):
                        record += k == 0
                        page = h.get("x-page-id")
                        rows.append((path, record, h["warc-record-id"], h["warc-type"], h.get("warc-target-uri"), h.get("warc-refers-to"), int(page) if page is not None else None, _hex(h.get("warc-block-digest")), _hex(h.get("warc-payload-digest")), k, len(piece), seen, digest, last, piece if with_bytes else None))
                        held += len(piece) if with_bytes else 64
                        if held > 64 * CHUNK or len(rows) >= 4096:
                            yield out()
                            rows, held = [], 0
        if rows:
            yield out()

    return run


def read_archives(spark: SparkSession, manifest: DataFrame, with_bytes: bool = True) -> DataFrame:
    """The chunked record table of the manifest's files, each streamed by one task."""
    files = manifest.select("path")
    return files.repartition(max(1, files.count()), "path").mapInArrow(_reader(with_bytes), _CHUNKS)


def revisits(pages: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """(page_id, sha1, response_id) of the pages whose payload of at least least_bytes is equal to that of the page with the largest page_id."""
    html = F.coalesce(F.col("html").cast("binary"), F.lit(b""))
    own = pages.select("page_id", F.sha1(html).alias("sha1"), F.length(html).alias("n")).where(F.col("n") >= least_bytes)
    largest = own.groupBy("sha1", "n").agg(F.max("page_id").alias("response_id"), F.count("*").alias("copies")).where("copies > 1").drop("copies")
    return own.join(largest, ["sha1", "n"]).where("page_id IS NULL OR page_id <> response_id").where("response_id IS NOT NULL").select("page_id", "sha1", "response_id").distinct()


def numbered_copies(rows: DataFrame) -> DataFrame:
    """(page_id, url, html, sha1) with copy: rows of one page and payload are numbered from 0. Equal rows are counted first and made again."""
    several = cut(rows.groupBy("page_id", "sha1").agg(F.count("*").alias("n")).where("n > 1").select(F.col("page_id").alias("p"), F.col("sha1").alias("s")))
    if not several.limit(1).count():
        return rows.withColumn("copy", F.lit(0).cast("long"))
    few = small(several, 60)
    of = F.col("page_id").eqNullSafe(F.col("p")) & (F.col("sha1") == F.col("s"))
    counted = cut(rows.join(few, of, "left_semi").groupBy("page_id", "url", "html", "sha1").agg(F.count("*").alias("n")))
    before = Window.partitionBy("page_id", "sha1").orderBy("url", F.col("html").isNull()).rowsBetween(Window.unboundedPreceding, -1)
    made = counted.withColumn("first", F.coalesce(F.sum("n").over(before), F.lit(0)))
    made = made.select("page_id", "url", "html", "sha1", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("n") - 1)).alias("copy"))
    made = made.repartition(F.xxhash64("copy", "page_id"))  # a page that occurs very often is written by many tasks
    return rows.join(few, of, "left_anti").withColumn("copy", F.lit(0).cast("long")).unionByName(made)


def archive_round_trip(pages: DataFrame, folder: str | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_bytes: int = LEAST_BYTES) -> DataFrame:
    """Writes one record per page and reads the archives back: (page_id, payload_bytes, payload_digest, record_type, refers_to).

    Of pages with equal payloads of at least least_bytes bytes, the one with the
    largest page_id is a response and the others revisit it; others are all
    responses. Null payloads are empty. Rows with a null page_id are revisits of
    an equal payload that has an id, else responses; repeated rows of the largest
    page_id are all responses; every record has an id of its own. Other columns
    are ignored; an empty table gives no rows. A block whose digest differs from
    the header's raises, and so does a revisit of another payload.
    """
    spark = pages.sparkSession
    folder = folder or fresh_path(spark, "warc")
    own = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    again = small(cut(revisits(own, least_bytes)), 120).toDF("p", "s", "response_id")
    sha1 = F.sha1(F.coalesce(F.col("html").cast("binary"), F.lit(b"")))
    own = numbered_copies(own.withColumn("sha1", sha1))
    rows = own.join(again, F.col("page_id").eqNullSafe(F.col("p")) & (F.col("sha1") == F.col("s")), "left")
    chunks = read_archives(spark, write_archives(rows.select("page_id", "url", "html", "response_id", "copy"), folder), with_bytes=False)
    ends = chunks.where("last").select("page_id", "record_id", "record_type", "refers_to", "running_bytes", "running_digest", "payload_digest", "block_digest")
    same = F.col("running_digest") == F.col("block_digest")
    ends = cut(ends.withColumn("payload_digest", F.when(same, F.col("payload_digest")).otherwise(F.raise_error(F.lit("a block's digest differs from its header")))))
    answers = ends.where("record_type = 'response'").select(F.col("record_id").alias("r"), F.col("page_id").alias("response_page"), F.col("running_bytes").alias("full"), F.col("payload_digest").alias("answered"))
    first = ends.where("record_type = 'response'").select("page_id", F.col("running_bytes").alias("payload_bytes"), "payload_digest", "record_type", F.lit(None).cast("long").alias("refers_to"))
    digest = F.when(F.col("answered") == F.col("payload_digest"), F.col("payload_digest")).otherwise(F.raise_error(F.lit("a revisit's payload is not that of its response")))
    back = ends.where("record_type = 'revisit'").join(answers, F.col("refers_to") == F.col("r")).select("page_id", F.col("full").alias("payload_bytes"), digest.alias("payload_digest"), "record_type", F.col("response_page").alias("refers_to"))
    return first.union(back)
