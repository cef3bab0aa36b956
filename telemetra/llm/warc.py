"""WARC archives as seekable Zstandard bundles (operator 8).

Pages are written as WARC/1.1 records into bundles of about ``BUNDLE_BYTES``. Inside a
bundle, records are grouped into independent Zstandard frames of about
``FRAME_BYTES``; a skippable frame at the end holds the seek table of the seekable
format (compressed and plain size of each frame, and the footer that finds it). An
index table maps each record id to its bundle, frame and offset inside the frame, so
one record is read by decompressing one frame.

Equal payloads are stored once: among pages with the same SHA-1 and length (of
``min_bytes`` at least) the largest page_id is a response, the others are revisits
that refer to it. Groups are found by an aggregate and joined back from a table, so
AQE can split a payload that fills a third of the rows.

Bundles are files in the shared folder, opened through the file system its address
names. A task writes under a hidden name and renames; names and contents depend only
on the rows of the task's partition, which are sorted first, so a repeated task
writes the same files. The rows written and their index are one Parquet write.

Defined cases: null html is an empty payload; a null url is an empty target; of
repeated rows that tie for the largest page_id all are responses; a null page_id
counts as smaller than any other; an empty table gives no bundle. Extra columns
are not read.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from telemetra.llm.common import stored
from telemetra.plans.storage import job_path

FRAME_BYTES = 1 << 18
BUNDLE_BYTES = 8 << 20
LEVEL = 3
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
DATE = "2000-01-01T00:00:00Z"        # fixed, so that a repeated task writes equal bytes

INDEX = "page_id long, record_id string, record_type string, bundle string, frame int, offset long, length long"
RECORD = ("page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, "
          "url string, payload binary, bundle string")


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _id(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def _page(record_id: str) -> int | None:
    number = record_id[len("<urn:page:"):-1]
    return int(number) if number else None


def record(page_id: int | None, url: str, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC record; a revisit keeps the HTTP header only, and the length and digest of the payload."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if revisit else head + payload
    fields = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", _id(page_id)), ("WARC-Date", DATE),
              ("WARC-Target-URI", re.sub(r"[\x00-\x20]", "", url)), ("WARC-Payload-Digest", "sha1:" + digest(payload))]
    if revisit:
        fields += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
                   ("WARC-Refers-To", _id(refers_to))]
    fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n" + block + b"\r\n\r\n"


def parse(data: bytes, at: int = 0) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields and block of each record."""
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode().split("\r\n")
        if lines[0] != "WARC/1.1":
            raise ValueError(f"no WARC record at {at}")
        fields = dict(x.split(": ", 1) for x in lines[1:])
        size = int(fields["Content-Length"])
        yield fields, data[end + 4:end + 4 + size]
        at = end + 4 + size + 4


class Bundle:
    """Frames of records and, at the end, their seek table."""

    def __init__(self):
        self.zstd, self.parts, self.frames = zstandard.ZstdCompressor(level=LEVEL, write_checksum=True), [], []
        self.open, self.open_size, self.size = [], 0, 0

    def add(self, rec: bytes) -> tuple[int, int]:
        """Frame and offset in it where the record goes."""
        if self.open_size >= FRAME_BYTES:
            self._close()
        place = len(self.frames), self.open_size
        self.open.append(rec)
        self.open_size += len(rec)
        return place

    def _close(self):
        if self.open:
            frame = self.zstd.compress(b"".join(self.open))
            self.parts.append(frame)
            self.frames.append((len(frame), self.open_size))
            self.size += len(frame)
            self.open, self.open_size = [], 0

    def finish(self) -> bytes:
        self._close()
        rows = b"".join(struct.pack("<II", *f) for f in self.frames)
        table = rows + struct.pack("<IBI", len(self.frames), 0, SEEKABLE)
        return b"".join(self.parts) + struct.pack("<II", SKIPPABLE, len(table)) + table


def seek_table(data: bytes) -> list[tuple[int, int, int]]:
    """Place, compressed and plain size of each frame of a bundle."""
    count, _, magic = struct.unpack("<IBI", data[-9:])
    if magic != SEEKABLE:
        raise ValueError("no seek table")
    out, at = [], 0
    for size, plain in struct.iter_unpack("<II", data[-9 - 8 * count:-9]):
        out.append((at, size, plain))
        at += size
    return out


def frame(data: bytes, number: int) -> bytes:
    at, size, plain = seek_table(data)[number]
    return zstandard.ZstdDecompressor().decompress(data[at:at + size], max_output_size=max(plain, 1))


def _put(folder: str, name: str, data: bytes) -> None:
    fs, root = pyarrow.fs.FileSystem.from_uri(folder if "://" in folder else "file://" + folder)
    fs.create_dir(root, recursive=True)
    attempt = TaskContext.get().taskAttemptId() if TaskContext.get() else 0
    hidden = f"{root}/_{attempt}-{name}"
    with fs.open_output_stream(hidden, compression=None) as f:  # the name would have it compressed again
        f.write(data)
    fs.move(hidden, f"{root}/{name}")


def write(pages: DataFrame, min_bytes: int = 0) -> str:
    """Writes the archives of ``pages(page_id, url, html)``; returns their folder (``bundles``, ``index``)."""
    folder = job_path(pages.sparkSession, "llm", "warc", unique=True)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce("url", F.lit("")).alias("url"),
                        F.coalesce("html", F.lit("")).cast("binary").alias("payload"))
    rows = rows.select("*", F.sha1("payload").alias("sha"), F.octet_length("payload").alias("n"))
    same = stored(rows.where(F.col("n") >= min_bytes).groupBy("sha", "n").agg(F.max("page_id").alias("top"), F.count("*").alias("c"))
                  .where("c > 1").select("sha", "n", F.coalesce("top", F.lit(None).cast("long")).alias("top")), "warc-equal")
    marked = rows.join(same.withColumn("dup", F.lit(True)), ["sha", "n"], "left").select(
        "page_id", "url", "payload", "top", (F.coalesce("dup", F.lit(False)) & ~F.col("page_id").eqNullSafe(F.col("top"))).alias("revisit"))
    # a bundle's rows come from one partition, in a fixed order
    ready = marked.sortWithinPartitions("page_id", "url", "payload")

    def run(batches):
        part, bundle, number, index = TaskContext.get().partitionId(), None, 0, []

        def finish():
            name = index[0][3]
            _put(f"{folder}/bundles", name, bundle.finish())
            return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*index), (
                pa.int64(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int64()))],
                ["page_id", "record_id", "record_type", "bundle", "frame", "offset", "length"])

        for b in batches:
            for page_id, url, payload, top, revisit in zip(*(c.to_pylist() for c in b.columns)):
                if bundle is None:
                    bundle, index, name = Bundle(), [], f"{part:06d}-{number:06d}.warc.zst"
                rec = record(page_id, url, payload, top, revisit)
                index.append((page_id, _id(page_id), "revisit" if revisit else "response", name, *bundle.add(rec), len(rec)))
                if bundle.size >= BUNDLE_BYTES:
                    yield finish()
                    bundle, number = None, number + 1
        if bundle is not None:
            yield finish()

    ready.mapInArrow(run, INDEX).write.parquet(f"{folder}/index")
    return folder


def read(spark: SparkSession, folder: str) -> DataFrame:
    """Every record of the archives in ``folder``; the digest of a response is taken of its payload anew."""
    # only bundles the index names: what a task that failed may have left is not read
    named = spark.read.parquet(f"{folder}/index").select("bundle").distinct()
    if named.isEmpty():
        return spark.createDataFrame([], RECORD)
    files = (spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(f"{folder}/bundles")
             .select(F.element_at(F.split("path", "/"), -1).alias("bundle"), "content").join(named, "bundle", "left_semi"))

    def run(batches):
        for b in batches:
            for name, data in zip(b.column(0).to_pylist(), b.column(1)):
                data = data.as_py()
                for k in range(len(seek_table(data))):
                    rows = [_row(fields, block, name) for fields, block in parse(frame(data, k))]
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows), (
                        pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary(), pa.string()))],
                        [x.split()[0] for x in RECORD.split(", ")])

    return files.mapInArrow(run, RECORD)


def _row(fields: dict[str, str], block: bytes, bundle: str):
    head, payload = block.split(b"\r\n\r\n", 1)
    kind, said = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha1:")
    size = int(re.search(rb"Content-Length: (\d+)", head)[1])
    if kind == "revisit":
        return (_page(fields["WARC-Record-ID"]), size, said, kind, _page(fields["WARC-Refers-To"]), fields["WARC-Target-URI"], None, bundle)
    if digest(payload) != said or len(payload) != size:
        raise ValueError(f"payload of {fields['WARC-Record-ID']} does not match its digest")
    return (_page(fields["WARC-Record-ID"]), size, said, kind, None, fields["WARC-Target-URI"], payload, bundle)


def lookup(spark: SparkSession, folder: str, record_ids: DataFrame) -> DataFrame:
    """The records with the ids in ``record_ids(record_id)``, each from its own frame."""
    found = spark.read.parquet(f"{folder}/index").join(record_ids.distinct(), "record_id", "left_semi")
    schema = "record_id string, header map<string,string>, block binary"

    def run(batches):
        fs, root = pyarrow.fs.FileSystem.from_uri(folder if "://" in folder else "file://" + folder)
        for b in batches:
            out = []
            for rid, name, number, offset in zip(*(b.column(k).to_pylist() for k in range(4))):
                with fs.open_input_file(f"{root}/bundles/{name}") as f:
                    data = _Window(f).frame(number)
                fields, block = next(parse(data, offset))
                out.append((rid, list(fields.items()), block))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.string()),
                                                  pa.array([o[1] for o in out], pa.map_(pa.string(), pa.string())),
                                                  pa.array([o[2] for o in out], pa.binary())], ["record_id", "header", "block"])

    return found.select("record_id", "bundle", "frame", "offset").mapInArrow(run, schema)


class _Window:
    """Reads one frame of an open bundle by its seek table, without the rest."""

    def __init__(self, f):
        self.f, self.size = f, f.size()

    def frame(self, number: int) -> bytes:
        count = struct.unpack("<IBI", self.f.read_at(9, self.size - 9))[0]
        sizes = list(struct.iter_unpack("<II", self.f.read_at(8 * count, self.size - 9 - 8 * count)))
        data = self.f.read_at(sizes[number][0], sum(s for s, _ in sizes[:number]))
        return zstandard.ZstdDecompressor().decompress(data, max_output_size=max(sizes[number][1], 1))
