"""SimHash near-duplicates: pivot distance tables over distinct fingerprints.

Documents with equal fingerprints are one class, and only classes are compared. Each class has a row in the pivot
table, its Hamming distances to PIVOTS reference fingerprints, which is computed once and goes where the class goes. By the
triangle inequality a pair whose rows differ by more than r anywhere isn't within r bits: it is discarded, and what survives
is verified. Coordinates alone can't deal out 64-bit fingerprints (a window of r passes over half of all pairs), so classes meet in
cells: two fingerprints within r bits agree on at least k of r + k blocks, so each class goes to one cell for each choice of
k blocks, with k by the number of classes. A cell gives a spanning forest of its links, so links grow with the number of classes,
not with its square; a crowded cell is dealt out anew by blocks of the rotated fingerprint.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Accumulator
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common
from .components import connected_components

SEED = 42
#: Pivots of a table: eight distances to a column.
PIVOTS = 32
TABLE = [f"d{i}" for i in range(PIVOTS // 8)]
#: Classes of a cell, beyond which it is dealt out anew.
CROWDED = 4096
#: Classes up to which two blocks, or three, make a cell; the cells of four hold about as many classes at 2**33.
CELLS_OF = ((1 << 22, 2), (1 << 28, 3))
#: A column of ours beside those of docs.
HASH = "__attestry_text_hash"
#: Pairs looked at together.
BLOCK = 1 << 20


def shingle_hashes(text: str | None, width: int) -> np.ndarray:
    """Hashes of the text's word shingles, A-Z lower-cased; fewer words than the width: of the whole sequence; none for no words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    line = b" ".join(words)
    hashed = xxhash.xxh64_intdigest
    if len(words) <= width:
        return np.array([hashed(line, SEED)], np.uint64)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(sizes)
    starts = (ends - sizes)[: len(words) - width + 1].tolist()
    return np.array([hashed(line[a:b], SEED) for a, b in zip(starts, (ends[width - 1 :] - 1).tolist(), strict=True)], np.uint64)


def fingerprint(text: str | None, width: int = 4) -> int:
    """64-bit SimHash of the text's word shingles, A-Z lower-cased; 0 for no words (a signed number)."""
    h = shingle_hashes(text, width)
    counts = np.zeros(64, np.int64)
    for at in range(0, len(h), 1 << 16):
        bits = np.unpackbits(h[at : at + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(0, dtype=np.uint32)
    return int(np.packbits(counts * 2 > len(h), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, width: int = 4, *keep: str) -> DataFrame:
    """doc_id, fp, and the columns to keep."""

    def task():
        return lambda x: {c: x[c] for c in columns} | {"fp": [fingerprint(t, width) for t in x["text"]]}

    columns = ["doc_id", *keep]
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*columns).schema.fields)
    return common.stream(docs.select(*dict.fromkeys([*columns, "text"])), task, f"{kinds}, fp long")


def pivots(n: int = PIVOTS) -> np.ndarray:
    """Reference fingerprints, the same everywhere."""
    return np.random.default_rng(SEED).integers(0, 1 << 64, n, np.uint64)


def _root(parent: np.ndarray, x: np.ndarray) -> np.ndarray:
    up = parent[x]
    while True:
        far = parent[up]
        if (far == up).all():
            return up
        up = far


def _join(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Link all pairs; a parent is never larger than its child."""
    while len(a):
        ra, rb = _root(parent, a), _root(parent, b)
        apart = ra != rb
        a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
        np.minimum.at(parent, np.maximum(ra, rb), np.minimum(ra, rb))


def pivot_table(fp: Column) -> list[Column]:
    """Distances to the pivots, eight bytes in each column."""
    signed = pivots().view(np.int64).tolist()
    one = lambda i: F.bit_count(fp.bitwiseXOR(F.lit(signed[i]))).cast("long")
    columns = []
    for k, name in enumerate(TABLE):
        out = one(8 * k)
        for i in range(1, 8):
            out = out.bitwiseOR(F.shiftleft(one(8 * k + i), 8 * i))
        columns.append(out.alias(name))
    return columns


def bucket_links(key: np.ndarray, fp: np.ndarray, table: np.ndarray, radius: int, seen: list[int] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links among rows with equal keys (rows sorted by key and fp), as two arrays of fingerprints.

    table: the rows' distances to the pivots (signed bytes). seen: counts of pairs compared, discarded by the table, verified, linked."""
    n = len(key)
    parent = np.arange(n)
    shared = np.zeros(n, bool)
    if n > 1:
        same = key[1:] == key[:-1]
        shared[1:] |= same
        shared[:-1] |= same
    live = np.flatnonzero(shared)
    step = 1
    seen = [0, 0, 0, 0] if seen is None else seen
    while len(live):
        live = live[live + step < n]
        live = live[key[live] == key[live + step]]
        for at in range(0, len(live), BLOCK):
            a = live[at : at + BLOCK]
            b = a + step
            if step > 8:  # rows that are connected already need no link
                apart = _root(parent, a) != _root(parent, b)
                a, b = a[apart], b[apart]
            seen[0] += len(a)
            for p in range(table.shape[1]):
                near = np.abs(table[a, p] - table[b, p]) <= radius
                a, b = a[near], b[near]
            seen[2] += len(a)
            near = np.bitwise_count(fp[a] ^ fp[b]) <= radius
            _join(parent, a[near], b[near])
            seen[3] += int(near.sum())
        step += 1
        if step & (step - 1) == 0 and len(live):
            # A bucket that is one component is done.
            root = _root(parent, np.arange(n))
            start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            whole = np.minimum.reduceat(root, start) == np.maximum.reduceat(root, start)
            live = live[~np.repeat(whole, np.diff(np.r_[start, n]))[live]]
    seen[1] = seen[0] - seen[2]
    root = _root(parent, np.arange(n))
    hung = np.flatnonzero(root != np.arange(n))
    return fp[hung], fp[root[hung]]


def _cells(fp: Column, radius: int, agree: int, salt: Column | None = None) -> Column:
    """The cells of a fingerprint: one for each choice of `agree` of radius + agree blocks."""
    blocks = radius + agree
    cuts = [64 * i // blocks for i in range(blocks + 1)]
    part = [F.shiftrightunsigned(fp, x).bitwiseAND(F.lit((1 << (y - x)) - 1)) for x, y in zip(cuts, cuts[1:], strict=False)]
    return F.array(*[F.xxhash64(*([] if salt is None else [salt]), F.lit(n), *[part[i] for i in chosen]) for n, chosen in enumerate(combinations(range(blocks), agree))])


def links(classes: DataFrame, radius: int, agree: int | None = None, crowded: int = CROWDED, counts: list[Accumulator] | None = None) -> DataFrame:
    """edges(a, b) whose components are those of the graph on distinct fp that links fps within radius bits.

    classes: fp, of a table that is cheap to read again. agree: how many blocks make a cell; any number gives the same components.
    counts: accumulators of the pairs compared, discarded by the pivot table, verified, and linked."""
    spark = classes.sparkSession
    if agree is None:
        n = classes.count()
        agree = next((k for most, k in CELLS_OF if n <= most), 4)
    known = classes.select("fp", *pivot_table(F.col("fp")))
    dealt = known.withColumn("key", F.explode(_cells(F.col("fp"), radius, agree)))
    full = common.staged(classes.select(F.explode(_cells(F.col("fp"), radius, agree)).alias("key")).groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > crowded).select("key"), "crowded")
    if not full.isEmpty():
        # Within the radius the rotated fingerprints agree on as many of their blocks, so no pair is lost.
        turned = F.shiftleft("fp", 5).bitwiseOR(F.shiftrightunsigned("fp", 59))
        again = dealt.join(full, "key").withColumn("key", F.explode(_cells(turned, radius, agree, F.col("key"))))
        dealt = dealt.join(full, "key", "left_anti").select(*again.columns).unionAll(again)
    dealt = dealt.select("key", "fp", *TABLE).repartition(common.partitions(spark), "key").sortWithinPartitions("key", "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[list[np.ndarray]] = []

        def flush(columns: list[np.ndarray]) -> pa.RecordBatch:
            key, fp, *table = columns
            seen = [0, 0, 0, 0]
            a, b = bucket_links(key, fp.view(np.uint64), np.stack(table, 1).view(np.int8), radius, seen)
            for total, x in zip(counts or (), seen, strict=False):
                total.add(x)
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            rest.append([np.ascontiguousarray(c.to_numpy(zero_copy_only=False)) for c in batch.columns])
            last = rest[-1][0][-1]
            if last == rest[0][0][0] or sum(len(x[0]) for x in rest) < 1 << 16:
                continue
            whole = [np.concatenate(x) for x in zip(*rest, strict=True)]
            cut = int(np.searchsorted(whole[0], last))  # the last cell may go on
            rest = [[x[cut:] for x in whole]]
            if cut:
                yield flush([x[:cut] for x in whole])
        if rest:
            yield flush([np.concatenate(x) for x in zip(*rest, strict=True)])

    return dealt.mapInArrow(run, "a long, b long")


def _components(prints: DataFrame, radius: int, counts: list[Accumulator] | None = None) -> DataFrame:
    """fp, id (the smallest doc_id with it), label (equal within a component) of every fingerprint: a staged table."""
    classes = common.staged(prints.groupBy("fp").agg(F.min("doc_id").alias("id")), "prints")
    labels = connected_components(links(classes, radius, counts=counts))
    out = common.staged(classes.join(labels, F.col("fp") == F.col("node"), "left").select("fp", "id", F.coalesce("label", "fp").alias("label")), "classes")
    common.drop_staged(classes)
    return out


def near_duplicates(docs: DataFrame, radius: int = 4, width: int = 4, counts: list[Accumulator] | None = None) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id (the smallest doc_id reachable) of every row.

    Null and empty texts have fingerprint zero and link like any other. Rows with a null doc_id keep it and
    don't count for the smallest. Repeated rows give repeated rows. An empty table gives no rows. Other columns take no part.
    A bit that just half of the hashes have is not set. counts: see links."""
    common.configure(docs.sparkSession)
    prints = common.staged(fingerprints(docs, width), "fingerprints")
    grouped = _components(prints, radius, counts)
    least = grouped.groupBy("label").agg(F.min("id").alias("component_id"))
    members = grouped.join(least, "label").select("fp", "component_id")
    hexed = F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint")
    return prints.join(members, "fp").select("doc_id", hexed, "component_id")


def keep_first(docs: DataFrame, radius: int = 4, width: int = 5) -> DataFrame:
    """The rows of docs without near-duplicates: of each component one row stays, that with the smallest doc_id.

    Null ids come after all others; of rows with that id the one with the smallest hash of its text stays."""
    common.configure(docs.sparkSession)
    text = F.coalesce(F.xxhash64("text"), F.lit(0).cast("long"))
    prints = common.staged(fingerprints(docs.select("doc_id", "text", text.alias(HASH)), width, HASH), "fingerprints")
    return keep_rows(docs, prints.join(_components(prints, radius).select("fp", "label"), "fp"))


def keep_rows(docs: DataFrame, labelled: DataFrame) -> DataFrame:
    """Of the rows of docs one for each label. labelled: doc_id, hash of the text, label of every row."""
    text = F.coalesce(F.xxhash64("text"), F.lit(0).cast("long"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("late"), "doc_id", HASH))
    kept = labelled.groupBy("label").agg(first.alias("row"))
    kept = kept.select(F.col("row.doc_id").alias(f"{HASH}_id"), F.col(f"row.{HASH}").alias(f"{HASH}_kept"))
    marked = docs.withColumn(HASH, text)
    same = marked["doc_id"].eqNullSafe(F.col(f"{HASH}_id")) & (F.col(HASH) == F.col(f"{HASH}_kept"))
    return marked.join(kept, same, "left_semi").dropDuplicates(["doc_id", HASH]).drop(HASH)
