"""A content-addressed store of token ids.

A rolling hash over the ids cuts each document's stream into chunks where the content says so, so equal
passages give equal chunks. Every unique chunk is stored once: with its document, or, if more than one place
holds it, under its digest. A document's row is its recipe, the digests in order, with the root of a Merkle
tree over them; packs of documents have roots of their own and the manifest has the root of all packs.

File format: Parquet rows in ascending doc_id order. kind `doc`: recipe and the chunks that no other place
holds; kind `chunk`: a shared chunk under its digest; kind `pack`: the root of a pack. Ids are little-endian unsigned integers of `width` bytes,
compressed by Zstandard.
"""

from __future__ import annotations

import hashlib
import json
import zlib
from collections.abc import Iterator
from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .substring import rolling
from .tokens import encoder

#: Chunk sizes in ids; the mean is about SMALLEST + MASK + 1.
SMALLEST, LARGEST, MASK, SPAN = 64, 2048, 255, 16
ENCODED = "doc_id long, n_tokens long, digests array<binary>, sizes array<int>, payload binary"
STORED = "kind string, pack int, doc_id long, start long, n_tokens long, digests array<binary>, sizes array<int>, shared array<int>, root binary, payload binary"


def marks_of(ids: np.ndarray) -> np.ndarray:
    """First places of the spans of ids whose hash ends in zeros."""
    if len(ids) < SPAN:
        return np.zeros(0, np.int64)
    h = rolling((ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15), SPAN, np.uint64(0xD6E8FEB86659FD93))
    return np.flatnonzero((h >> np.uint64(40)) & np.uint64(MASK) == 0)


def cuts_of(n: int, ends: list[int]) -> list[int]:
    """Ends of the chunks of n ids: after marked spans, within the size limits."""
    out, last = [], 0
    for m in ends:
        while m - last > LARGEST:
            last += LARGEST
            out.append(last)
        if m - last >= SMALLEST:
            last = m
            out.append(m)
    while n - last > LARGEST:
        last += LARGEST
        out.append(last)
    if last < n:
        out.append(n)
    return out


def cuts(ids: np.ndarray) -> list[int]:
    """Ends of the chunks of an id stream."""
    return cuts_of(len(ids), (marks_of(ids) + SPAN).tolist())


def digest(chunk: bytes) -> bytes:
    return hashlib.blake2b(chunk, digest_size=16).digest()


def merkle_root(leaves: list[bytes]) -> bytes:
    """Root of the binary tree over the leaves in order; inner nodes are marked apart from leaves, an odd node goes up as it is."""
    level = [hashlib.sha256(b"\0" + x).digest() for x in leaves]
    while len(level) > 1:
        up = [hashlib.sha256(b"\1" + a + b).digest() for a, b in zip(level[::2], level[1::2], strict=False)]
        level = up + level[len(level) & ~1 :]
    return level[0] if level else hashlib.sha256(b"").digest()


def encoded(docs: DataFrame, tokenizer: str, end_id: int, width: int) -> DataFrame:
    """Ids of each row's whole text (null: empty) and the end id, cut into chunks. An id that `width` bytes don't hold is an error."""

    def task():
        enc, packer = encoder(tokenizer), zstandard.ZstdCompressor(level=1)

        def f(x):
            out = {k: [] for k in ("n_tokens", "digests", "sizes", "payload")}
            ids, lengths = enc.encode_all(x["text"], end_id)
            if width < 4 and len(ids) and int(ids.max()) >> 8 * width:
                raise ValueError(f"id {ids.max()} doesn't fit in {width} bytes")
            data = ids.astype(f"<u{width}").tobytes()
            marks, at = marks_of(ids), 0  # of the whole batch; a span within a document doesn't see its neighbours
            for n in lengths.tolist():
                own = marks[np.searchsorted(marks, at) : np.searchsorted(marks, at + n - SPAN, "right")]
                ends = cuts_of(n, (own - at + SPAN).tolist())
                starts = [0, *ends[:-1]]
                chunk = [digest(data[width * (at + a) : width * (at + b)]) for a, b in zip(starts, ends, strict=True)]
                row = (n, chunk, [b - a for a, b in zip(starts, ends, strict=True)], packer.compress(data[width * at : width * (at + n)]))
                for k, v in zip(out, row, strict=True):
                    out[k].append(v)
                at += n
            return out | {"doc_id": x["doc_id"]}

        f.end = enc.rest
        return f

    return common.stream(docs.select(F.col("doc_id").cast("long"), "text"), task, ENCODED)


#: Bytes of a pack's ids; there are as many packs as shuffle partitions at least.
PACK_BYTES = 64 << 20


@dataclass(frozen=True)
class Manifest:
    """What a store holds. It lies beside the packs, so that any session can verify the store."""

    path: str
    width: int
    n_documents: int
    n_tokens: int
    packs: dict[str, str]
    root: str

    def save(self, spark: SparkSession) -> Manifest:
        line = json.dumps(asdict(self), sort_keys=True)
        spark.createDataFrame([(line,)], "value string").coalesce(1).write.text(f"{self.path}/manifest")
        return self

    @staticmethod
    def load(spark: SparkSession, path: str) -> Manifest:
        """The manifest of the store at a path; the store may have been moved there."""
        return Manifest(**(json.loads(spark.read.text(f"{path}/manifest").first().value) | {"path": path}))


def write_store(docs: DataFrame, path: str, tokenizer: str, end_id: int, width: int = 2) -> Manifest:
    """Write the store and its manifest; rows of equal doc_id follow one another, null ids come first.

    Packs are ranges of doc_id, dealt in that order, so part files are in order too. An empty table gives a store without
    rows; null and empty texts are the end id alone; a very long text is one row. Repeated rows are stored as often as they
    come, their chunks once. Columns other than doc_id and text take no part."""
    spark = common.configure(docs.sparkSession)
    # Payloads are compressed already; uid names a row of the staged table.
    rows = common.staged(encoded(docs, tokenizer, end_id, width).withColumn("uid", F.monotonically_increasing_id()), "encoded", compression="none")
    packs = max(common.partitions(spark), -(-width * (rows.agg(F.sum("n_tokens")).first()[0] or 0) // PACK_BYTES))
    cuts_ = [i / packs for i in range(1, packs)]
    bounds = sorted(set(rows.where(F.col("doc_id").isNotNull()).approxQuantile("doc_id", cuts_, 0.2 / packs))) if cuts_ else []
    pack = _pack(F.col("doc_id"), [int(x) for x in bounds])
    totals = rows.groupBy(pack.alias("pack")).agg(F.sum("n_tokens").alias("n"), F.count("*").alias("docs")).orderBy("pack").collect()  # one row a pack
    first, at = {}, 0
    for r in totals:
        first[r.pack], at = at, at + r.n
    places = rows.select("uid", "doc_id", pack.alias("pack"), F.posexplode("digests").alias("i", "digest"))
    # Staged, so that the join with a chunk that very many documents hold can be split.
    shared = common.staged(places.groupBy("digest").agg(F.count("*").alias("n"), F.min(F.struct("uid", "i")).alias("owner")).where("n > 1").select("digest", "owner"), "shared")
    marks = places.join(shared, "digest").select("uid", "doc_id", "pack", F.struct("i", (F.struct("uid", "i") == F.col("owner")).alias("owns")).alias("mark"))
    marks = marks.groupBy("pack", "doc_id", "uid").agg(F.collect_list("mark").alias("marks"))
    # A document's marks and its row are dealt by pack and meet in sorted order, so payloads are dealt out once.
    whole = rows.select(pack.alias("pack"), "doc_id", "uid", F.lit(1).alias("is_row"), "n_tokens", "digests", "sizes", "payload", F.lit(None).cast("array<struct<i:int,owns:boolean>>").alias("marks"))
    dealt = whole.unionByName(marks.withColumn("is_row", F.lit(0)), allowMissingColumns=True)
    dealt = dealt.repartitionById(packs, F.col("pack")).sortWithinPartitions("pack", F.col("doc_id").asc_nulls_first(), "uid", "is_row")

    def task():
        packer, opener = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()
        place = {"pack": None, "at": 0, "marks": None}
        roots: list[bytes] = []  # of the pack's documents so far

        def f(x):
            out = {k: [] for k in names}
            for p, doc_id, n, digests, sizes, payload, marked in zip(*(x[k] for k in ("pack", "doc_id", "n_tokens", "digests", "sizes", "payload", "marks")), strict=True):
                if marked is not None:
                    place["marks"] = marked
                    continue
                marked, place["marks"] = place["marks"], None
                if p != place["pack"]:
                    seal(out)
                    place.update(pack=p, at=first[p])
                if marked:
                    data, at, own = opener.decompress(payload), 0, []
                    elsewhere = {m["i"]: m["owns"] for m in marked}
                    for i, size in enumerate(sizes):
                        chunk = data[at : at + width * size]
                        at += width * size
                        if i not in elsewhere:
                            own.append(chunk)
                        elif elsewhere[i]:
                            put(out, ("chunk", p, None, None, size, [digests[i]], [size], None, None, packer.compress(chunk)))
                    payload = packer.compress(b"".join(own))
                roots.append(merkle_root(digests))
                put(out, ("doc", p, doc_id, place["at"], n, digests, sizes, sorted(m["i"] for m in marked or ()), roots[-1], payload))
                place["at"] += n
            return out

        def seal(out):
            if roots:
                put(out, ("pack", place["pack"], None, None, None, None, None, None, merkle_root(roots), None))
                roots.clear()

        def last():
            out = {k: [] for k in names}
            seal(out)
            return out

        def put(out, row):
            for k, v in zip(names, row, strict=True):
                out[k].append(v)

        f.last = last
        return f

    names = [x.split()[0] for x in STORED.split(", ")]
    columns = ["pack", "doc_id", "n_tokens", "digests", "sizes", "payload", "marks"]
    common.stream(dealt.select(*columns), task, STORED).write.option("compression", "none").parquet(f"{path}/packs")
    common.drop_staged(rows, shared)
    sealed = spark.read.schema(STORED).parquet(f"{path}/packs").where("kind = 'pack'").select("pack", "root").orderBy("pack")
    roots = {str(r.pack): bytes(r.root).hex() for r in sealed.collect()}  # one row a pack
    return Manifest(path, width, sum(r.docs for r in totals), at, roots, merkle_root([bytes.fromhex(x) for x in roots.values()]).hex()).save(spark)


def _pack(doc_id: Column, bounds: list[int]) -> Column:
    """The pack of a document: how many of the bounds its id is over."""
    if not bounds:
        return F.lit(0)
    return F.coalesce(F.size(F.filter(F.lit(bounds).cast("array<bigint>"), lambda b: b < doc_id)), F.lit(0))


def _pack_roots(store: DataFrame) -> dict[str, str]:
    """The Merkle root of each pack over its documents' roots, in order of start."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, roots = None, []
        for batch in batches:
            for pack, root in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if now is not None and pack != now:
                    yield row(now, roots)
                    roots = []
                now = pack
                roots.append(root)
        if roots:
            yield row(now, roots)

    def row(pack: int, roots: list[bytes]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([pack], pa.int32()), pa.array([merkle_root(roots).hex()])], ["pack", "root"])

    docs = store.where("kind = 'doc'").select("pack", "start", "root").repartition("pack").sortWithinPartitions("pack", "start")
    return {str(r.pack): r.root for r in docs.select("pack", "root").mapInArrow(run, "pack int, root string").orderBy("pack").collect()}


def read_store(spark: SparkSession, manifest: Manifest, ids: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 and, if asked for, ids (little-endian unsigned 32-bit integers) of every document.

    Every chunk is checked against its digest and every document against its Merkle root, and the packs against the
    manifest; a mismatch is an error."""
    store = spark.read.schema(STORED).parquet(f"{manifest.path}/packs")
    if (found := _pack_roots(store)) != manifest.packs or merkle_root([bytes.fromhex(x) for x in found.values()]).hex() != manifest.root:
        raise ValueError("the store differs from its manifest")
    docs = store.where("kind = 'doc'").select("doc_id", "start", "n_tokens", "digests", "sizes", "shared", "root", "payload")
    chunk = store.where("kind = 'chunk'").select(F.col("digests")[0].alias("digest"), F.col("payload").alias("chunk"))
    refs = docs.where(F.size("shared") > 0).select("start", F.explode("shared").alias("i"), "digests").select("start", "i", F.get("digests", F.col("i")).alias("digest"))
    fetched = refs.join(chunk, "digest").groupBy("start").agg(F.collect_list(F.struct("i", "chunk")).alias("chunks"))
    none = F.lit(None).cast("array<struct<i:int,chunk:binary>>")
    whole = docs.where(F.size("shared") == 0).withColumn("chunks", none)
    parts = docs.where(F.size("shared") > 0).join(fetched, "start", "left").select(*whole.columns)
    width = manifest.width

    def task():
        opener = zstandard.ZstdDecompressor()

        def f(x):
            crcs, out = [], []
            for start, n, digests, sizes, root, payload, chunks in zip(*(x[k] for k in ("start", "n_tokens", "digests", "sizes", "root", "payload", "chunks")), strict=True):
                others = {c["i"]: opener.decompress(c["chunk"]) for c in chunks or ()}
                own, at, data = opener.decompress(payload), 0, []
                for i, size in enumerate(sizes):
                    part = others.get(i)
                    if part is None:
                        part = own[at : at + width * size]
                        at += width * size
                    if digest(part) != digests[i]:
                        raise ValueError(f"chunk {i} of the document at {start} is damaged")
                    data.append(part)
                if merkle_root(digests) != root:
                    raise ValueError(f"the recipe of the document at {start} is damaged")
                whole = np.frombuffer(b"".join(data), f"<u{width}").astype("<u4").tobytes()
                if len(whole) != 4 * n:
                    raise ValueError(f"the document at {start} has another length")
                crcs.append(zlib.crc32(whole))
                out.append(whole if ids else None)
            return {"doc_id": x["doc_id"], "start": x["start"], "n_tokens": x["n_tokens"], "ids_crc32": crcs, "ids": out}

        return f

    return common.stream(whole.unionAll(parts), task, "doc_id long, start long, n_tokens long, ids_crc32 long, ids binary")


def round_trip(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """Write docs to a store in the shared folder and read it back by its manifest there: one row for each row of docs."""
    spark = common.configure(docs.sparkSession)
    path = common.new_path(spark, "tokens")
    write_store(docs, path, tokenizer, end_id)
    return read_store(spark, Manifest.load(spark, path))
