"""Best-two-fit packing of token documents into sequences of a fixed length.

Lengths are whole numbers up to the capacity, so the packing is planned on the histogram of lengths: a
bin is a pattern of lengths with a multiplicity. The plan has a few thousand patterns at any input size
and is made in the driver; pieces find their place by their rank among pieces of equal length.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common
from .tokens import encoder

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


@dataclass(frozen=True)
class Pattern:
    """`times` bins that each hold these (length, count) pairs, longest first."""

    items: tuple[tuple[int, int], ...]
    times: int


def best_two_fit(counts: dict[int, int], capacity: int) -> list[Pattern]:
    """Fill a bin greedily with the longest lengths that fit; then, if two unpacked lengths fill the gap that
    its smallest item leaves more tightly than that item, they take its place. Repeat the bin while its
    lengths last. An empty histogram gives no pattern; a length outside 1..capacity is an error."""
    if any(not 1 <= x <= capacity for x in counts):
        raise ValueError("lengths must be between 1 and the capacity")
    left = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        left[length] += n
    out: list[Pattern] = []
    sizes = np.arange(capacity + 1)
    top = capacity
    while True:
        while top and not left[top]:
            top -= 1
        if not top:
            return out
        fits = np.maximum.accumulate(np.where(left > 0, sizes, 0))  # the longest unpacked length up to each size
        gap, bin_ = capacity, {}
        while gap and (x := int(fits[gap])):
            n = min(int(left[x]), gap // x)
            bin_[x] = n
            gap -= n * x
            if gap >= x:
                fits = np.maximum.accumulate(np.where((left > 0) & (sizes < x), sizes, 0))
        if gap and sum(bin_.values()) > 1:
            small = min(bin_)
            pool = left.copy()
            for x, n in bin_.items():
                pool[x] -= n
            room = gap + small
            free = np.flatnonzero(pool[: room + 1] > 0)
            if len(free):
                longest = np.maximum.accumulate(np.where(pool > 0, sizes, 0))
                second = longest[room - free]
                alone = (second == free) & (pool[free] < 2)
                second = np.where(alone, longest[np.maximum(free - 1, 0)], second)
                sums = np.where(second > 0, free + second, 0)
                best = int(sums.argmax())
                if sums[best] > small:
                    bin_[small] -= 1
                    for x in (int(free[best]), int(second[best])):
                        bin_[x] = bin_.get(x, 0) + 1
        bin_ = {x: n for x, n in bin_.items() if n}
        times = min(int(left[x]) // n for x, n in bin_.items())
        for x, n in bin_.items():
            left[x] -= times * n
        out.append(Pattern(tuple(sorted(bin_.items(), reverse=True)), times))


def slots(plan: list[Pattern]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, end rank, count in a bin, first sequence, offset) for every length of every pattern."""
    used: dict[int, int] = {}
    first, out = 0, []
    for p in plan:
        offset = 0
        for length, n in p.items:
            lo = used.get(length, 0)
            used[length] = hi = lo + n * p.times
            out.append((length, lo, hi, n, first, offset))
            offset += n * length
        first += p.times
    return out


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int, end_id: int) -> DataFrame:
    """Encode whole texts (null: empty), append the end id, cut what is longer than the capacity.

    The first piece takes the remainder, all others have the capacity. Extra columns are dropped."""

    def task():
        enc, end = encoder(tokenizer), int(end_id).to_bytes(4, "little")

        def f(x):
            out = {k: [] for k in ("doc_id", "piece", "start", "length", "ids_crc32")}
            for doc_id, text in zip(x["doc_id"], x["text"], strict=True):
                ids = enc.encode(text) + end
                n = len(ids) // 4
                at, piece = 0, 0
                while at < n:
                    size = (n - at - 1) % capacity + 1 if at == 0 else capacity
                    for k, v in zip(out, (doc_id, piece, at, size, zlib.crc32(ids[4 * at : 4 * (at + size)])), strict=True):
                        out[k].append(v)
                    at, piece = at + size, piece + 1
            return out

        f.end = enc.rest
        return f

    return common.stream(docs.select(F.col("doc_id").cast("long"), "text"), task, PIECES)


def place(pieces: DataFrame, capacity: int) -> DataFrame:
    """Add sequence_id and offset to pieces, which must be cheap to read twice (a staged table).

    Ranks are counted in salted groups, so that a length of a third of all rows isn't one task's."""
    spark: SparkSession = pieces.sparkSession
    salts = max(32, common.partitions(spark))
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "start", "ids_crc32"), F.lit(salts)))
    counts = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    histogram = {r.length: r.n for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # capacity rows at most
    plan = slots(best_two_fit(histogram, capacity))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    own = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "start", "ids_crc32")
    ranked = salted.withColumn("own", F.row_number().over(own)).join(offsets, ["length", "salt"])
    ranked = ranked.withColumn("rank", F.col("before") + F.col("own") - 1)
    table = spark.createDataFrame(plan, "slot_length long, lo long, hi long, per_bin long, first_sequence long, first_offset long")
    placed = ranked.join(F.broadcast(table), (F.col("length") == F.col("slot_length")) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")))
    at = F.col("rank") - F.col("lo")
    return placed.select(
        *pieces.columns,
        (F.col("first_sequence") + F.floor(at / F.col("per_bin"))).alias("sequence_id"),
        (F.col("first_offset") + at % F.col("per_bin") * F.col("length")).alias("offset"),
    )


def pack(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """One row for each piece of each document: where it lies in which sequence.

    Null and empty texts hold the end id alone. Repeated rows are packed as often as they come. An empty
    table gives no rows. Columns other than doc_id and text take no part."""
    common.configure(docs.sparkSession)
    return place(common.staged(token_pieces(docs, tokenizer, capacity, end_id), "pieces"), capacity)
