"""Benchmark decontamination with DataFrame functions only.

Windows as long as a benchmark item get a SimHash fingerprint and look up the items that they were laid for in a multi-index of
radius + 1 Hamming blocks, which finds every one within the radius (two fingerprints within r bits agree on one of r + 1 blocks);
exact weighted-shingle similarity, the sum of smaller over the sum of larger counts, verifies. The radius that a similarity of
0.8 needs is wide, so blocks alone would let most pairs of windows and items through; with the item in the key they
let through what was laid.

A window that reaches the similarity has at least `needed` places with a shingle of the item, so every window
with that many is laid for it, whatever its alignment, and no other. Places are counted without the words; only the words of
windows are dealt out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: Shingles of items in one broadcast; a larger benchmark takes several passes over the documents.
BROADCAST_SHINGLES = 500_000


def words(text: Column) -> Column:
    """Lower-cased words between ASCII white space; null: none."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), "[\\x20\\x09-\\x0D]+"), "")


def shingles(words_: Column, width: Column | int) -> Column:
    """Word shingles joined by spaces, repeats included; fewer words than the width: the whole sequence; none: none."""
    last = F.greatest(F.size(words_) - width, F.lit(0))
    each = F.transform(F.sequence(F.lit(0), last), lambda i: F.array_join(F.slice(words_, i + 1, F.lit(width) if isinstance(width, int) else width), " "))
    return F.when(F.size(words_) > 0, each).otherwise(F.array().cast("array<string>"))


def simhash(hashes: Column) -> Column:
    """The 64-bit fingerprint of an array of hashes: a bit is set if over half of them have it."""
    bit = lambda b: F.size(F.filter(hashes, lambda h: F.expr("1L").bitwiseAND(_shift(h, b)) == 1)) * 2 > F.size(hashes)
    return F.aggregate(F.sequence(F.lit(0), F.lit(63)), F.lit(0).cast("long"), lambda acc, b: acc.bitwiseOR(F.when(bit(b), _left(b)).otherwise(F.lit(0).cast("long"))))


def _shift(h: Column, b: Column) -> Column:
    return F.call_function("shiftrightunsigned", h, b)


def _left(b: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), b)


def repeats(sorted_: Column) -> Column:
    """What a sorted array has besides the first of each value."""
    last = F.size(sorted_) - 1
    at = F.when(last > 0, F.filter(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.get(sorted_, i) == F.get(sorted_, i - 1))).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.get(sorted_, i))


def shared(a: Column, b: Column, more_a: Column, more_b: Column) -> Column:
    """How many values two arrays share, repeats included: values once, by hash, and then their repeats, which are few."""
    count = lambda x, s: F.size(F.filter(x, lambda y: y == s))
    return F.size(F.array_intersect(a, b)) + F.aggregate(F.array_intersect(more_a, more_b), F.lit(0), lambda acc, s: acc + F.least(count(more_a, s), count(more_b, s)))


def needed(n_shingles: Column, n_window: Column, threshold: float) -> Column:
    """The fewest shingles that an item and a window of so many share if the similarity reaches the threshold."""
    return F.greatest(F.lit(1), F.ceil(F.lit(threshold / (1 + threshold)) * (n_shingles + n_window) - 1e-9))


def contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.8, width: int = 5, radius: int = 24) -> DataFrame:
    """doc_id, item_id, start, n_words, similarity: for each document and item the most similar window, if it reaches the threshold.

    start is the window's first word; of equal windows the first counts. Items without words and null texts match
    nothing; a document shorter than an item is one window. Repeated rows are one; equal items each match. Very long texts are
    read whole, and long items take time with their length. Rows that share a doc_id, or have none, are told apart by text in `matches`; here
    the best of all of them counts. Empty tables give no rows. Columns other than doc_id and text, item_id and text take no part."""
    best = matches(docs, benchmark, threshold, width, radius).groupBy("doc_id", "item_id")
    top = best.agg(F.max(F.struct("similarity", (-F.col("start")).alias("minus"), "n")).alias("best"))
    return top.select("doc_id", "item_id", (-F.col("best.minus")).alias("start"), F.col("best.n").alias("n_words"), F.col("best.similarity").alias("similarity"))


def matches(docs: DataFrame, benchmark: DataFrame, threshold: float, width: int, radius: int) -> DataFrame:
    """doc_id, text_hash, item_id, start, n, similarity of every window that reaches the threshold."""
    spark = common.configure(docs.sparkSession)
    items = benchmark.select("item_id", words(F.col("text")).alias("item_words")).where(F.size("item_words") > 0)
    items = items.select("item_id", F.size("item_words").alias("n"), F.least(F.size("item_words"), F.lit(width)).alias("w"), "item_words")
    items = _printed(items, F.col("item_words"), F.col("w"), "item_")
    sizes = items.groupBy("w", "n").agg(F.sum(F.size("item_shingles")).alias("total")).collect()  # one row for each length
    if not sizes:
        return docs.sparkSession.createDataFrame([], "doc_id long, text_hash long, item_id long, start int, n int, similarity double")
    hint = F.broadcast if sum(r.total for r in sizes) <= BROADCAST_SHINGLES else (lambda x: x)
    shingle_hash = lambda c, at, w: F.xxhash64(*[F.get(c, F.col(at) + k) for k in range(w)])
    docs = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    # Passes over the documents: one, unless the benchmark's shingles are too many for one broadcast.
    passes = -(-sum(r.total for r in sizes) // BROADCAST_SHINGLES)
    found, owned = [], []
    for w in sorted({r.w for r in sizes}):
        own = items.where(F.col("w") == w).select("item_id", "n", "item_words", F.explode(F.sequence(F.lit(0), F.col("n") - w)).alias("at"))
        own = common.staged(own.select("item_id", "n", shingle_hash("item_words", "at", w).alias("item_h")).distinct(), "shingles")
        owned.append(own)
        # The outer form keeps Spark from splitting each text twice, once for a filter that it would infer. From here to the
        # join rows are variables of one generated loop, so the words are not copied for places without a hit.
        places = F.when(F.size("words") >= w, F.sequence(F.lit(0), F.size("words") - w))
        each = docs.select("doc_id", "text_hash", words(F.col("text")).alias("words")).select("doc_id", "text_hash", "words", F.explode_outer(places).alias("p"))
        each = each.select("doc_id", "text_hash", F.size("words").alias("size"), "p", shingle_hash("words", "p", w).alias("h"))
        for k in range(passes):
            part = F.broadcast(own.where(F.pmod("item_h", F.lit(passes)) == k))
            hits = each.join(part, (F.col("h") == F.col("item_h")) & F.col("p").isNotNull())
            found.append(hits.select("doc_id", "text_hash", "size", "item_id", "n", F.lit(w).alias("w"), "p"))
    hits = found[0]
    for more in found[1:]:
        hits = hits.unionAll(more)
    n_item, n_window = F.col("n") - F.col("w") + 1, F.least("n", "size") - F.col("w") + 1
    hits = hits.groupBy("doc_id", "text_hash", "size", "item_id", "n", "w").agg(F.collect_set("p").alias("places"))
    hits = hits.where(F.size("places") >= needed(n_item, n_window, threshold))
    # Every window over a place, one start if the document is shorter than the item.
    hits = hits.withColumn("p", F.explode("places")).drop("places")
    over = F.sequence(F.greatest(F.lit(0), F.col("p") - n_item + 1), F.least("p", F.greatest(F.lit(0), F.col("size") - F.col("n"))))
    laid = hits.withColumn("start", F.explode(over)).groupBy("doc_id", "text_hash", "size", "item_id", "n", "w", "start").count()
    laid = laid.where(F.col("count") >= needed(n_item, n_window, threshold))
    laid = laid.groupBy("doc_id", "text_hash", "start", "n", "w").agg(F.collect_set("item_id").alias("for_items"))
    laid = laid.groupBy("doc_id", "text_hash").agg(F.collect_list(F.struct("start", "n", "w", "for_items")).alias("laid"))
    laid = common.staged(laid.select(F.col("doc_id").alias("laid_id"), F.col("text_hash").alias("laid_hash"), "laid"), "laid")
    same = docs["doc_id"].eqNullSafe(F.col("laid_id")) & (F.col("text_hash") == F.col("laid_hash"))
    windows = docs.join(laid, same).dropDuplicates(["doc_id", "text_hash"]).select("doc_id", "text_hash", words(F.col("text")).alias("words"), "laid")
    texts = common.staged(windows, "texts")
    windows = texts.select("doc_id", "text_hash", "words", F.explode("laid").alias("at"))
    windows = windows.select("doc_id", "text_hash", "at.*", F.slice("words", F.col("at.start") + 1, F.col("at.n")).alias("window"))
    # Few rows with much to do for each: dealt out evenly.
    windows = windows.repartition(common.partitions(spark), F.xxhash64("doc_id", "text_hash", "start", "n"))
    windows = _printed(windows, F.col("window"), F.least(F.col("w"), F.size("window")), "").drop("window")
    common.drop_staged(texts, laid, *owned)

    blocks = radius + 1
    cuts = [64 * i // blocks for i in range(blocks + 1)]
    values = lambda c: F.array(*[_shift(F.col(c), F.lit(x)).bitwiseAND(F.lit((1 << (y - x)) - 1)) for x, y in zip(cuts, cuts[1:], strict=False)])
    index = items.select("item_id", "item_fp", "item_shingles", "item_more", F.posexplode(values("item_fp")).alias("block", "value"))
    probes = windows.withColumn("item_id", F.explode("for_items")).drop("for_items").select("*", F.posexplode(values("fp")).alias("block", "value"))
    near = probes.join(hint(index), ["item_id", "block", "value"])
    near = near.where(F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp"))) <= radius)
    # Of the blocks that agree, only the first counts, so that a pair comes once.
    differ = F.col("fp").bitwiseXOR(F.col("item_fp"))
    first = F.array_position(F.transform(F.array(*[_shift(differ, F.lit(x)).bitwiseAND(F.lit((1 << (y - x)) - 1)) for x, y in zip(cuts, cuts[1:], strict=False)]), lambda x: x == 0), True) - 1
    sizes_ = (F.size("shingles") + F.size("item_shingles")).alias("sizes")
    # Staged, as Spark would count anew wherever the count is used.
    pairs = near.where(F.col("block") == first).select("doc_id", "text_hash", "item_id", "start", "n", sizes_, shared(F.col("shingles"), F.col("item_shingles"), F.col("more"), F.col("item_more")).alias("both"))
    pairs = common.staged(pairs, "pairs").withColumn("similarity", F.col("both") / F.nullif(F.col("sizes") - F.col("both"), F.lit(0)))
    return pairs.where(F.col("similarity") >= threshold).select("doc_id", "text_hash", "item_id", "start", "n", "similarity")


def _printed(rows: DataFrame, words_: Column, width: Column, prefix: str) -> DataFrame:
    """rows with sorted shingles, their repeats (`more`) and fingerprint: a staged table. Arrays that lambdas use are columns of
    staged tables, as Spark would put their expressions into every lambda; a step is dropped when the next is there."""
    one = common.staged(rows.withColumn(f"{prefix}shingles", F.array_sort(shingles(words_, width))), "shingles")
    two = common.staged(one.withColumn("hashes", F.transform(f"{prefix}shingles", lambda s: F.xxhash64(s))).withColumn(f"{prefix}more", repeats(F.col(f"{prefix}shingles"))), "hashes")
    out = common.staged(two.withColumn(f"{prefix}fp", simhash(F.col("hashes"))).drop("hashes"), "prints")
    common.drop_staged(one, two)
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.8, width: int = 5, radius: int = 24) -> DataFrame:
    """docs without the rows that hold a benchmark item, whatever their doc_id: a null one, or one that other texts have too."""
    bad = matches(docs, benchmark, threshold, width, radius).select(F.col("doc_id").alias("__attestry_bad_id"), F.col("text_hash").alias("__attestry_bad_hash")).distinct()
    return docs.join(bad, docs["doc_id"].eqNullSafe(F.col("__attestry_bad_id")) & (F.xxhash64(docs["text"]) == F.col("__attestry_bad_hash")), "left_anti")
