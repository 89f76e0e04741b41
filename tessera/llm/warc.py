"""WARC archives of pages: written with an index, read back by coalesced byte ranges.

Writing deals the pages by payload digest, so a payload's rows stand in one partition and
its first row in id order is the response. Digests that many rows share are the ``HEAVY``
most frequent ones at most; their owner is broadcast and their revisits are spread. Every
task writes archives of its own below the shared folder, each record a gzip member, and
returns one index row per record: archive, offset, length, URL, digest. The index is
written by Spark's own commit, so the archive of a lost or repeated task is one that no
index row names.

Reading starts from the index alone: the selected rows are dealt by archive and block,
sorted by offset, and neighbours are read as one range of at most ``RANGE`` bytes.
Executors must reach the folder through ``pyarrow.fs`` (local and mounted paths, HDFS, S3).
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import scratch_path
from .common import cut_lineage, map_partitions, ship_by_value, text_of

#: Bytes of an archive, of the index block that one reader takes, of one read, and the gap read over.
ARCHIVE, BLOCK, RANGE, GAP = 64 << 20, 16 << 20, 8 << 20, 64 << 10
#: Payload digests whose revisits are spread, and the rows from which one is.
HEAVY, MANY = 4096, 1000
LEVEL = 6
# FIXED VALUES: record types and the least payload that is worth a revisit record.
RESPONSE, REVISIT, LEAST = "response", "revisit", 100
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

INDEX = ("page_id long, url string, record_type string, refers_to long, payload_bytes long, "
         "payload_digest string, file string, offset long, length long")


def store(path: str):
    """(file system, path in it) of a URI or local path."""
    from pyarrow import fs
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def record(page_id: int | None, url: str | None, kind: str, refers_to: int | None, payload: bytes,
           n_bytes: int, digest: str, date: str) -> bytes:
    """One WARC/1.1 record. Line ends in the URL are written as percent codes."""
    name = "none" if page_id is None else page_id
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n_bytes}\r\n\r\n".encode()
    block = head + payload if kind == RESPONSE else head
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{name}:{kind}>", f"WARC-Date: {date}",
             "WARC-Target-URI: " + (url or "").replace("\r", "%0D").replace("\n", "%0A"),
             f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http; msgtype=response",
             f"Content-Length: {len(block)}"]
    if kind == REVISIT:
        owner = "none" if refers_to is None else refers_to
        lines += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: <urn:page:{owner}:{RESPONSE}>"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _page(urn: str) -> int | None:
    name = urn.split(":")[2]
    return None if name == "none" else int(name)


def parse_record(data: bytes) -> dict:
    """page_id, url, record_type, refers_to, payload (None for a revisit), payload_bytes and
    payload_digest of a record; a record that does not add up is refused."""
    head, _, rest = data.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    field = dict(line.split(": ", 1) for line in lines)
    n = int(field["Content-Length"])
    if first != "WARC/1.1" or rest[n:] != b"\r\n\r\n":
        raise ValueError("not a WARC record of its stated length")
    http, _, payload = rest[:n].partition(b"\r\n\r\n")
    n_bytes = int(http.rsplit(b"Content-Length: ", 1)[1])
    digest = field["WARC-Payload-Digest"].removeprefix("sha256:")
    kind = field["WARC-Type"]
    if kind == RESPONSE and (len(payload) != n_bytes or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError("the payload does not match its digest")
    return {"page_id": _page(field["WARC-Record-ID"]), "url": field["WARC-Target-URI"], "record_type": kind,
            "refers_to": _page(field["WARC-Refers-To"]) if kind == REVISIT else None,
            "payload": payload if kind == RESPONSE else None, "payload_bytes": n_bytes, "payload_digest": digest}


def typed_rows(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html",
               least: int = LEAST, archive_bytes: int = ARCHIVE) -> DataFrame:
    """The pages dealt for writing, each with digest, record_type and refers_to."""
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"),
                        text_of(payload_col).cast("binary").alias("payload"))
    rows = rows.select("*", F.unhex(F.sha2("payload", 256)).alias("digest"), F.octet_length("payload").cast("long").alias("bytes"))
    groups = cut_lineage(rows.groupBy("digest").agg(
        F.count("*").alias("n"), F.min("page_id").alias("owner"), F.first("bytes").alias("bytes")))
    total = groups.agg(F.sum(F.col("n") * F.col("bytes"))).first()[0] or 0
    tasks = max(-(-total // archive_bytes), pages.sparkSession.sparkContext.defaultParallelism)
    heavy = (groups.where((F.col("bytes") >= least) & (F.col("n") > MANY))
             .orderBy(F.desc("n"), "digest").limit(HEAVY).select("digest", "owner", F.lit(True).alias("heavy")))
    known = rows.join(F.broadcast(heavy), "digest", "left")
    spread = F.pmod(F.xxhash64("page_id", "url"), F.lit(HEAVY)) + 1
    salt = (F.when(F.col("bytes") < least, spread)
            .when(F.col("heavy") & ~F.col("page_id").eqNullSafe(F.col("owner")), spread).otherwise(0))
    w = Window.partitionBy("digest", "salt").orderBy(F.asc_nulls_last("page_id"), "url")
    dealt = known.withColumn("salt", salt).repartition(int(tasks), "digest", "salt")
    first = dealt.withColumn("place", F.row_number().over(w)).withColumn(
        "first", F.first("page_id").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    is_response = (F.col("bytes") < least) | ((F.col("salt") == 0) & (F.col("place") == 1))
    return first.select(
        "page_id", "url", F.when(is_response, RESPONSE).otherwise(REVISIT).alias("record_type"),
        F.when(~is_response, F.when(F.col("salt") > 0, F.col("owner")).otherwise(F.col("first"))).alias("refers_to"),
        F.when(is_response, F.col("payload")).alias("payload"), F.col("bytes").alias("payload_bytes"),
        F.lower(F.hex("digest")).alias("payload_digest"))


def write_archives(pages: DataFrame, out_dir: str, id_col: str = "page_id", url_col: str = "url",
                   payload_col: str = "html", least: int = LEAST, archive_bytes: int = ARCHIVE,
                   date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Writes ``out_dir/archives/*.warc.gz`` and ``out_dir/index`` (Parquet); returns the index.

    Of rows with equal payloads of ``least`` bytes or more, that with the smallest page_id (ids
    before null, then the smallest URL) is the response, the others are revisits of it; smaller
    payloads are responses all. Null payload: empty. Null URL: empty in the record, null in the
    index. Null id: written as ``none``. Repeated rows are records of their own. Empty table: an
    empty index and no archive."""
    folder = f"{out_dir.rstrip('/')}/archives"

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = store(folder)
        name, sink, at = "", None, 0
        try:
            for batch in batches:
                if not batch.num_rows:
                    continue
                place: list[list] = [[], [], []]
                cols = [batch.column(c).to_pylist() for c in
                        ("page_id", "url", "record_type", "refers_to", "payload", "payload_bytes", "payload_digest")]
                for page_id, url, kind, refers_to, payload, n_bytes, digest in zip(*cols):
                    if sink is None or at >= archive_bytes:
                        if sink is not None:
                            sink.close()
                        system.create_dir(path, recursive=True)
                        name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                        sink = system.open_output_stream(f"{path}/{name}", compression=None)
                    press = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
                    data = press.compress(record(page_id, url, kind, refers_to, payload, n_bytes, digest, date)) + press.flush()
                    sink.write(data)
                    for col, v in zip(place, (f"{folder}/{name}", at, len(data))):
                        col.append(v)
                    at += len(data)
                keep = [batch.column(c) for c in batch.schema.names if c != "payload"]
                yield pa.RecordBatch.from_arrays(
                    [*keep, pa.array(place[0], pa.string()), *(pa.array(p, pa.int64()) for p in place[1:])],
                    [*(c for c in batch.schema.names if c != "payload"), "file", "offset", "length"])
        finally:
            if sink is not None:
                sink.close()

    rows = typed_rows(pages, id_col, url_col, payload_col, least, archive_bytes)
    map_partitions(rows, write, INDEX).write.parquet(f"{out_dir.rstrip('/')}/index")
    return read_index(pages.sparkSession, out_dir)


def read_index(spark: SparkSession, out_dir: str) -> DataFrame:
    return spark.read.schema(INDEX).parquet(f"{out_dir.rstrip('/')}/index")


def ranges(offset: np.ndarray, length: np.ndarray, file: list[str]) -> list[tuple[int, int]]:
    """Runs (from row, to row) of rows sorted by file and offset that are read at once."""
    runs, a = [], 0
    for i in range(1, len(file) + 1):
        if (i == len(file) or file[i] != file[a] or offset[i] - (offset[i - 1] + length[i - 1]) > GAP
                or offset[i] + length[i] - offset[a] > RANGE):
            runs.append((a, i))
            a = i
    return runs


def read_records(index: DataFrame, payloads: bool = True) -> DataFrame:
    """One row per index row, from the archives: page_id, url, record_type, refers_to,
    payload_bytes, payload_digest and (unless ``payloads`` is false) payload, null for a revisit.

    ``index`` may be any selection of index rows. A response's payload must have its digest, and
    a record the digest of its index row, else the job fails. URLs are those of the records."""
    spark = index.sparkSession
    total = index.agg(F.sum("length")).first()[0] or 0
    tasks = max(-(-total // BLOCK), spark.sparkContext.defaultParallelism)
    picked = (index.select("file", "offset", "length", "payload_digest")
              .repartition(int(tasks), "file", F.floor(F.col("offset") / BLOCK)).sortWithinPartitions("file", "offset"))
    kinds = [("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()),
             ("payload_bytes", pa.int64()), ("payload_digest", pa.string())] + [("payload", pa.binary())] * payloads

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, source = "", None
        for batch in batches:
            file, digest = batch.column("file").to_pylist(), batch.column("payload_digest").to_pylist()
            offset, length = (batch.column(c).to_numpy() for c in ("offset", "length"))
            for a, b in ranges(offset, length, file):
                if file[a] != name:
                    name = file[a]
                    system, path = store(name)
                    source = system.open_input_file(path)
                start = int(offset[a])
                data = source.read_at(int(offset[b - 1] + length[b - 1]) - start, start)
                found = []
                for i in range(a, b):
                    at = int(offset[i]) - start
                    found.append(parse_record(zlib.decompress(data[at:at + int(length[i])], 31)))
                    if found[-1]["payload_digest"] != digest[i]:
                        raise ValueError(f"{name}: not the record of the index at {offset[i]}")
                yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in found], t) for c, t in kinds],
                                                 [c for c, _ in kinds])

    sql = {pa.int64(): "long", pa.string(): "string", pa.binary(): "binary"}
    return map_partitions(picked, read, ", ".join(f"{c} {sql[t]}" for c, t in kinds))


def warc_digests(pages: DataFrame, out_dir: str | None = None) -> DataFrame:
    """Writes the pages, then reads every record back: page_id, payload_bytes, payload_digest,
    record_type, refers_to."""
    out_dir = out_dir or scratch_path(pages.sparkSession, "warc")
    back = read_records(write_archives(pages, out_dir), payloads=False)
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ship_by_value(__name__)
