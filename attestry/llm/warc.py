"""WARC archives in seekable Zstandard bundles.

Records are grouped into independent frames; a bundle ends with a seek table in a skippable frame (the
public seekable format), and the index maps a record to its bundle, frame and offset in the frame.
"""

from __future__ import annotations

import base64
import hashlib
import os
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Fixed values of the seekable format.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
FRAME_BYTES = 1 << 20
#: Uncompressed bytes after which a bundle is closed; a record is never split.
BUNDLE_BYTES = 16 << 20
#: Payloads that recur are broadcast up to so many bytes of their names.
BROADCAST_BYTES = 32 << 20
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
INDEX = "page_id long, record_id string, bundle string, frame int, offset long, length long"
RECORD = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, record_id string, bundle string, frame int, offset long, payload binary"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _uri(url: str) -> str:
    return "".join(c if c.isprintable() and c != " " else "".join(f"%{b:02X}" for b in c.encode("utf-8", "surrogatepass")) for c in url)


def record(page_id: int | None, url: str | None, payload: bytes, kind: str, refers_to: int | None, number: int | str, refers_url: str | None = None) -> tuple[str, bytes]:
    """The record's identifier and bytes. number tells records apart that share page_id and url. A revisit keeps the HTTP head, with
    the payload's length, and no payload, and says what it refers to."""
    name = f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}/{number}/{url}')}"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    head = [("WARC-Type", kind), ("WARC-Record-ID", f"<{name}>"), ("WARC-Date", DATE), ("WARC-Payload-Digest", f"sha1:{digest(payload)}")]
    if url is not None:
        head.append(("WARC-Target-URI", _uri(url)))
    if page_id is not None:
        head.append(("X-Page-Id", str(page_id)))
    if kind == "revisit":
        head += [("WARC-Profile", PROFILE), ("WARC-Refers-To-Date", DATE)] + [("X-Refers-To-Page-Id", str(refers_to))] * (refers_to is not None)
        head += [("WARC-Refers-To-Target-URI", _uri(refers_url))] if refers_url is not None else []
    block = http + payload * (kind == "response")
    head += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return name, "WARC/1.1\r\n".encode() + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"


class Bundle:
    """Gathers records; bytes() gives the frames and the seek table."""

    def __init__(self, level: int = 3) -> None:
        self.packer = zstandard.ZstdCompressor(level=level)
        self.frames: list[tuple[bytes, int]] = []
        self.open, self.size, self.total = [], 0, 0

    def add(self, data: bytes) -> tuple[int, int]:
        """The frame and the offset in it where the record will lie."""
        if self.size and self.size + len(data) > FRAME_BYTES:
            self.close()
        at = len(self.frames), self.size
        self.open.append(data)
        self.size += len(data)
        self.total += len(data)
        return at

    def close(self) -> None:
        if self.open:
            self.frames.append((self.packer.compress(b"".join(self.open)), self.size))
            self.open, self.size = [], 0

    def bytes(self) -> bytes:
        self.close()
        table = b"".join(struct.pack("<II", len(data), size) for data, size in self.frames) + struct.pack("<IBI", len(self.frames), 0, SEEKABLE)
        return b"".join(data for data, _ in self.frames) + struct.pack("<II", SKIPPABLE, len(table)) + table


def seek_table(data: bytes) -> list[tuple[int, int, int]]:
    """(place, compressed size, size) of each frame, from the footer alone."""
    n, flags, magic = struct.unpack("<IBI", data[-9:])
    if magic != SEEKABLE:
        raise ValueError("no seek table")
    step = 12 if flags & 0x80 else 8
    at, out = 0, []
    for i in range(n):
        packed, size = struct.unpack_from("<II", data, len(data) - 9 - step * (n - i))
        out.append((at, packed, size))
        at += packed
    return out


def frame_bytes(data: bytes, frame: tuple[int, int, int]) -> bytes:
    at, packed, size = frame
    return zstandard.ZstdDecompressor().decompress(data[at : at + packed], max_output_size=max(size, 1))


def parse(frame: bytes) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """(offset, fields, block) of each record of a frame."""
    at = 0
    while at < len(frame):
        end = frame.index(b"\r\n\r\n", at)
        lines = frame[at:end].decode().split("\r\n")
        if lines[0] != "WARC/1.1":
            raise ValueError(f"no record at {at}")
        fields = dict(x.split(": ", 1) for x in lines[1:])
        n = int(fields["Content-Length"])
        yield at, fields, frame[end + 4 : end + 4 + n]
        at = end + 4 + n + 4


def _write(uri: str, data: bytes) -> None:
    """Under another name first, so that a lost task leaves no half file; a second attempt writes the same bytes."""
    other = f"{uri}.{uuid.uuid4().hex}.part"
    if uri.startswith(("file:", "/")):
        path, other = ("/" + x.removeprefix("file:").lstrip("/") for x in (uri, other))
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(other, "wb") as f:
            f.write(data)
        os.replace(other, path)
        return
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    other = f"{path}{other.removeprefix(uri)}"
    store.create_dir(os.path.dirname(path), recursive=True)
    with store.open_output_stream(other) as f:
        f.write(data)
    store.move(other, path)


def write_archives(pages: DataFrame, folder: str, min_bytes: int = 0, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Write a record for every row of pages in bundles under `folder`; returns the index, a staged table.

    Of records with equal payloads of at least `min_bytes`, that with the largest page_id is the response and the
    others revisit it; if repeated rows share it, each of them is a response. Null html is an empty payload. A row with a null
    page_id is a response only if no row with that payload has an id. Every record has an identifier of its own. A very long page
    is a frame of its own. An empty table writes nothing. Columns other than page_id, url and html take no part."""
    spark = pages.sparkSession
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    rows = pages.select(F.col("page_id").cast("long"), "url", payload.alias("payload")).withColumn("digest", F.sha1("payload"))
    # The response of each payload that more than one row has: combined before the shuffle, so a payload of a third of all rows is one row.
    owner = F.max(F.struct(F.col("page_id").cast("long").alias("page_id"), F.when(F.col("page_id").isNotNull(), F.col("url")).alias("url")))
    owners = pages.groupBy(F.sha1(payload).alias("owner_digest")).agg(owner.alias("owner"), F.count("*").alias("copies")).where("copies > 1")
    owners = common.staged(owners.select("owner_digest", F.col("owner.page_id").alias("owner"), F.col("owner.url").alias("owner_url")), "warc-owners")
    # Few of them go to the payloads; only many make the payloads move.
    bytes_ = owners.agg(F.sum(64 + F.octet_length(F.coalesce("owner_url", F.lit(""))))).first()[0] or 0
    rows = rows.join(F.broadcast(owners) if bytes_ <= broadcast_bytes else owners.hint("merge"), F.col("digest") == F.col("owner_digest"), "left")
    refers = (F.octet_length("payload") >= min_bytes) & F.col("owner").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("owner"))
    rows = rows.select("page_id", "url", "payload", F.when(refers, F.col("owner")).alias("refers_to"), F.when(refers, F.col("owner_url")).alias("refers_url"))
    rows = rows.sortWithinPartitions("page_id", "url", "refers_to")

    def task():
        part = TaskContext.get().partitionId()
        state = {"n": 0, "bundle": Bundle(), "file": 0}

        def f(x):
            out = {k: [] for k in ("page_id", "record_id", "bundle", "frame", "offset", "length")}
            for page_id, url, data, refers_to, refers_url in zip(*(x[k] for k in ("page_id", "url", "payload", "refers_to", "refers_url")), strict=True):
                if state["bundle"].total >= BUNDLE_BYTES:
                    flush()
                kind = "response" if refers_to is None else "revisit"
                name, raw = record(page_id, url, data, kind, refers_to, f"{part}-{state['n']}", refers_url)
                frame, offset = state["bundle"].add(raw)
                state["n"] += 1
                for k, v in zip(out, (page_id, name, path(), frame, offset, len(raw)), strict=True):
                    out[k].append(v)
            return out

        def path() -> str:
            return f"{folder}/part-{part:06d}-{state['file']:04d}.warc.zst"

        def flush() -> None:
            if state["bundle"].total:
                _write(path(), state["bundle"].bytes())
                state["bundle"], state["file"] = Bundle(), state["file"] + 1

        f.end = flush
        return f

    return common.staged(_with_end(rows, task, INDEX), "warc-index")


def _with_end(df: DataFrame, task, schema: str) -> DataFrame:
    """common.stream, and a call when a task's rows are over."""
    kinds = common.arrow_schema(schema)

    def run(batches):
        f = task()
        for batch in batches:
            out = f({name: batch.column(i).to_pylist() for i, name in enumerate(batch.schema.names)})
            yield pa.RecordBatch.from_arrays([pa.array(out[x.name], x.type) for x in kinds], schema=kinds)
        f.end()

    return df.mapInArrow(run, schema)


def _record(_: int, fields: dict[str, str], block: bytes, frame: int, offset: int) -> dict:
    """A parsed record as a row of RECORD without its bundle, checked against its digest."""
    head, _, payload = block.partition(b"\r\n\r\n")
    size = next(int(x.split(b": ")[1]) for x in head.split(b"\r\n") if x.startswith(b"Content-Length"))
    kind, name = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if kind == "response" and (len(payload) != size or digest(payload) != name):
        raise ValueError(f"{fields['WARC-Record-ID']} is damaged")
    ints = {k: int(fields[v]) if v in fields else None for k, v in (("page_id", "X-Page-Id"), ("refers_to", "X-Refers-To-Page-Id"))}
    return ints | {"url": fields.get("WARC-Target-URI"), "payload_bytes": size, "payload_digest": name, "record_type": kind, "record_id": fields["WARC-Record-ID"][1:-1], "frame": frame, "offset": offset, "payload": payload if kind == "response" else None}


def _fields(data: bytes) -> Iterator[dict]:
    for number, frame in enumerate(seek_table(data)):
        for offset, fields, block in parse(frame_bytes(data, frame)):
            yield _record(offset, fields, block, number, offset)


def read_archives(spark: SparkSession, folder: str, payloads: bool = False) -> DataFrame:
    """Every record of the bundles under `folder`, checked against its digest; payload is null unless asked for."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(folder).select("path", "content")

    def run(batches):
        for batch in batches:
            for path, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                for block in common.chunks(_fields(data.as_py()), 500):
                    rows = [x | {"bundle": path, "payload": x["payload"] if payloads else None} for x in block]
                    yield pa.RecordBatch.from_pylist(rows, schema=kinds)

    kinds = common.arrow_schema(RECORD)
    return files.mapInArrow(run, RECORD)


class _Ranges:
    """Reads ranges of a file in the shared folder."""

    def __init__(self, uri: str) -> None:
        if uri.startswith(("file:", "/")):
            self.file = open("/" + uri.removeprefix("file:").lstrip("/"), "rb")  # noqa: SIM115
            self.size = os.fstat(self.file.fileno()).st_size
        else:
            from pyarrow import fs

            store, path = fs.FileSystem.from_uri(uri)
            self.file = store.open_input_file(path)
            self.size = self.file.size()
        self.read_bytes = 0

    def read(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        self.read_bytes += n
        return self.file.read(n)

    def frames(self) -> list[tuple[int, int, int]]:
        """The seek table, from the footer."""
        n, flags, _ = struct.unpack("<IBI", self.read(self.size - 9, 9))
        table = n * (12 if flags & 0x80 else 8) + 9
        return seek_table(self.read(self.size - table, table))


def fetch(index: DataFrame, page_ids: list[int] | DataFrame) -> DataFrame:
    """The records of these pages (a list, or a table with page_id). The executors read a bundle's footer and of its frames only
    those that the index names; payload is that of responses. Ids without a record give none, null ids none."""
    if isinstance(page_ids, DataFrame):
        rows = index.join(page_ids.select("page_id").distinct(), "page_id", "left_semi")
    else:
        rows = index.where(F.col("page_id").isin(page_ids))
    rows = rows.select("bundle", "frame", "offset").repartition(common.partitions(index.sparkSession), "bundle").sortWithinPartitions("bundle", "frame", "offset")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bundle = file = table = number = frame = None
        for batch in batches:
            out = []
            for path, k, offset in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if path != bundle:
                    file = _Ranges(path)
                    bundle, table, number = path, file.frames(), None
                if k != number:
                    at, packed, size = table[k]
                    number, frame = k, zstandard.ZstdDecompressor().decompress(file.read(at, packed), max_output_size=max(size, 1))
                out.append(_record(*next(parse(frame[offset:])), k, offset) | {"bundle": path})
            yield pa.RecordBatch.from_pylist(out, schema=kinds)

    kinds = common.arrow_schema(RECORD)
    return rows.mapInArrow(run, RECORD)


def archive(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Write pages to archives in the shared folder and read them back: one row for each page. An empty table gives no rows."""
    spark = common.configure(pages.sparkSession)
    folder = common.new_path(spark, "warc")
    written = write_archives(pages, folder, min_bytes)
    if written.isEmpty():
        return spark.createDataFrame([], RECORD)
    return read_archives(spark, folder)
