"""Substring dedup by repeated-phrase automata.

1. Places. Of the phrases of `phrase` words in a window the one with the smallest hash is its anchor, so equal windows have equal
   anchors. Consecutive windows with one anchor are a run. Anchors whose hash more than one document has are places to look at.
2. Confirmed phrases. The words at those places are read, and what recurs in another document by its words is a phrase.
3. Automata. Phrases are dealt to the shards of documents (SHARD_CHARS of text) where they may occur; each shard compiles an
   Aho-Corasick automaton over its phrases (pyahocorasick) and every document of the shard is streamed through it. What the automaton
   locates, and nothing else, is compared further. Phrases are sent to documents since the other way, each document through
   each shard of phrases, costs documents times phrases.
4. Windows. Runs around located phrases that have equal words, by BLAKE2 digests of the words, are one class, led by its
   smallest document; later documents lose them. Leaders of a phrase's several classes compare their windows one by one.

Documents are dealt out once, into buckets; all later steps move places, phrases and digests to them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

WINDOW = 50
PHRASE = 12
#: Documents of a shard's automaton: by text up to about this many characters together.
SHARD_CHARS = 4 << 20
#: Bytes that are hashed together, and the length beyond which a word is hashed alone.
SPAN_BYTES, LONG_WORD = 1 << 20, 1 << 16
#: The row key of dealt documents.
ROW = "__attestry_row"

_A = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0x100000001B3


def rolling(x: np.ndarray, n: int, factor: np.uint64) -> np.ndarray:
    """Polynomial hash of every n consecutive values, by doubling: n of 50 takes 8 steps."""
    powers, spans = {1: x}, 1
    while spans * 2 <= n:
        half = powers[spans]
        shift = np.uint64(pow(int(factor), spans, 1 << 64))
        powers[spans * 2] = half[: len(x) - spans * 2 + 1] * shift + half[spans:]
        spans *= 2
    out, done = None, 0
    for span in sorted(powers, reverse=True):
        if n & span:
            part = powers[span][done : done + len(x) - n + 1]
            out = part if out is None else out * np.uint64(pow(int(factor), span, 1 << 64)) + part
            done += span
    return out


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


_powers: list[np.ndarray] = []


def _tables() -> list[np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, as far as a span goes."""
    if not _powers:
        for x in (_BASE, pow(_BASE, -1, 1 << 64)):
            out = np.full(SPAN_BYTES + 1, x, np.uint64)
            out[0] = 1
            _powers.append(np.multiply.accumulate(out))
    return _powers


def word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First bytes and hashes of the words of a text's bytes. Words are hashed all at once, from prefix sums over a span of bytes."""
    power, inverse = _tables()
    starts, hashed, at = [], [], 0
    space = (data == 32) | ((data >= 9) & (data <= 13))
    while at < len(data):
        end = min(len(data), at + SPAN_BYTES)
        if end < len(data) and not space[end]:
            gaps = np.flatnonzero(space[at:end])
            if len(gaps):
                end = at + int(gaps[-1]) + 1
            else:  # a word over a whole span, which is hashed alone
                rest = np.flatnonzero(space[end:])
                end = end + int(rest[0]) if len(rest) else len(data)
                starts.append(np.array([at]))
                hashed.append(np.array([xxhash.xxh64_intdigest(data[at:end].tobytes())], np.uint64))
                at = end
                continue
        part, gap = data[at:end], space[at:end]
        edge = np.diff(np.concatenate(([1], gap.view(np.int8), [1])))
        first, last = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum((part.astype(np.uint64) + np.uint64(1)) * power[: len(part)], out=sums[1:])
        h = (sums[last] - sums[first]) * inverse[first]
        for i in np.flatnonzero(last - first > LONG_WORD).tolist():
            h[i] = xxhash.xxh64_intdigest(part[first[i] : last[i]].tobytes())
        starts.append(first + at)
        hashed.append(h)
        at = end
    if not starts:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(starts), _mix(np.concatenate(hashed))


def anchor_of(x: np.ndarray, window: int, phrase: int) -> tuple[np.ndarray, np.ndarray]:
    """For each window its anchor's place (the last of equal smallest), and all phrase hashes."""
    h = _mix(rolling(x, phrase, _A))
    span = window - phrase + 1
    n = len(x) - window + 1
    # Minima of `span` consecutive hashes by doubling, with places.
    best, at, size = h, np.arange(len(h)), 1
    while size < span:
        step = min(size, span - size)
        a, b = best[: len(best) - step], best[step:]
        later = b <= a
        best, at = np.where(later, b, a), np.where(later, at[step:], at[: len(at) - step])
        size += step
    return at[:n], h


def split(text: str | None) -> list[str]:
    return common.WORD.findall(text) if text else []


def plain(text: str | None) -> str:
    """The words joined by one space each."""
    return b" ".join(text.encode("utf-8", "surrogatepass").split()).decode("utf-8", "surrogatepass") if text else ""


RUNS = "row long, doc_id long, run long, anchor long"
#: Bits of a run for its number of windows, and for the anchor's place after the first.
_N, _PLACE = 12, 12


def packed(first: np.ndarray, n: np.ndarray, place: np.ndarray) -> np.ndarray:
    """A run as one number: its first window, how many windows, the anchor's place."""
    return (first << (_N + _PLACE)) | (n << _PLACE) | (place - first)


def unpacked(runs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    first = runs >> (_N + _PLACE)
    return first, (runs >> _PLACE) & ((1 << _N) - 1), first + (runs & ((1 << _PLACE) - 1))


def runs_of(docs: DataFrame, window: int, phrase: int) -> DataFrame:
    """Each run of each document, with its anchor's hash. docs: row, doc_id (not null), text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, doc_id = (batch.column(i).to_numpy() for i in (0, 1))
            text = batch.column(2).cast(pa.large_binary())
            offsets = np.frombuffer(text.buffers()[1], np.int64, len(text) + 1, text.offset * 8)
            data = np.frombuffer(text.buffers()[2], np.uint8) if text.buffers()[2] else np.zeros(0, np.uint8)
            for a, b in _spans(offsets):
                out = _runs(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], window, phrase)
                if out is not None:
                    own, *columns = out
                    yield pa.RecordBatch.from_arrays([pa.array(row[a + own]), pa.array(doc_id[a + own]), *map(pa.array, columns)], names=names)

    names = [x.split()[0] for x in RUNS.split(", ")]
    return docs.select("row", "doc_id", "text").mapInArrow(run, RUNS)


def _spans(offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about a span of bytes, a longer row alone."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + SPAN_BYTES, "right")) - 1)
        yield a, min(b, n)
        a = b


def _runs(data: np.ndarray, offsets: np.ndarray, window: int, phrase: int) -> tuple | None:
    """(row, run, anchor) of the runs of the rows between the offsets."""
    # A row's end parts words, which a space between rows does.
    n = len(offsets) - 1
    spaced = np.full(len(data) + n, 32, np.uint8)
    moved = offsets + np.arange(n + 1)
    keep = np.ones(len(spaced), bool)
    keep[moved[1:] - 1] = False
    spaced[keep] = data
    starts, x = word_hashes(spaced)
    if len(x) < window:
        return None
    edges = np.searchsorted(starts, moved)  # each row's first word
    row = np.repeat(np.arange(n), np.diff(edges))
    at, h = anchor_of(x, window, phrase)
    whole = np.flatnonzero(row[: len(at)] == row[window - 1 :])  # windows within one row
    if not len(whole):
        return None
    at, own = at[whole], row[whole]
    begin = np.flatnonzero(np.r_[True, (at[1:] != at[:-1]) | (own[1:] != own[:-1])])
    size = np.diff(np.r_[begin, len(at)])
    own, at = own[begin], at[begin]
    return own, packed(whole[begin] - edges[own], size, at - edges[own]), h[at].view(np.int64)


def automaton(phrases: Iterable[str]) -> ahocorasick.Automaton:
    """Over phrases with a space at both ends, so that only whole words match."""
    out = ahocorasick.Automaton()
    for p in phrases:
        out.add_word(f" {p} ", len(p) + 2)
    if len(out):
        out.make_automaton()
    return out


def occurrences(line: str, words: list[str], machine: ahocorasick.Automaton) -> list[int]:
    """Word places of all phrases in ` word word ... `."""
    found = [end - size + 2 for end, size in machine.iter(line)] if len(machine) else []
    if not found:
        return []
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
    return np.unique(np.searchsorted(np.cumsum(sizes) - sizes + 1, np.array(found, np.int64))).tolist()


def _digest(words: str) -> int:
    return int.from_bytes(hashlib.blake2b(words.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def sha256(line: str) -> str:
    return hashlib.sha256(line.encode("utf-8", "surrogatepass")).hexdigest()


def phrases_at(docs: DataFrame, phrase: int) -> DataFrame:
    """The words at the places of each document, once a document. docs: row, doc_id, text, runs."""

    def task():
        def f(x):
            out = {"row": [], "doc_id": [], "phrase": []}
            for row, doc_id, text, runs in zip(x["row"], x["doc_id"], x["text"], x["runs"], strict=True):
                words = plain(text).split(" ")
                found = sorted({" ".join(words[p : p + phrase]) for p in unpacked(np.array(runs, np.int64))[2].tolist()})
                out["row"] += [row] * len(found)
                out["doc_id"] += [doc_id] * len(found)
                out["phrase"] += found
            return out

        return f

    return common.stream(docs.select("row", "doc_id", "text", "runs"), task, "row long, doc_id long, phrase string")


LOCATED = "row long, doc_id long, phrase long, class long, n int, firsts array<int>"


def located(docs: DataFrame, window: int, phrase: int) -> DataFrame:
    """Stream every document through its shard's automaton and describe the runs around what is located.

    docs: row, doc_id, text, phrases (that may occur; null: none of its own), runs. `class` is equal for runs of equal words with
    the phrase at the same place; `firsts` are the first windows of such runs in the document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _shards(batches):
            machine = automaton({p for *_, phrases, _ in rows for p in phrases or ()})
            out: dict[tuple, list[int]] = {}
            for row, doc_id, text, _, runs in rows:
                line = plain(text)
                words = line.split(" ")
                here = occurrences(f" {line} ", words, machine)
                if not here or not runs:
                    continue
                first_, n_, place_ = unpacked(np.array(runs, np.int64))
                use = np.isin(place_, here)
                names: dict[int, int] = {}
                for first, n, place in zip(first_[use].tolist(), n_[use].tolist(), place_[use].tolist(), strict=True):
                    if (name := names.get(place)) is None:
                        name = names[place] = _digest(" ".join(words[place : place + phrase]))
                    kind = _digest(f"{place - first} {' '.join(words[first : first + n + window - 1])}")
                    out.setdefault((row, doc_id, name, kind, n), []).append(first)
            if out:
                columns = [*zip(*out, strict=True), list(out.values())]
                yield pa.RecordBatch.from_arrays([pa.array(c, k.type) for c, k in zip(columns, kinds, strict=True)], schema=kinds)

    kinds = common.arrow_schema(LOCATED)
    return docs.select("row", "doc_id", "text", "phrases", "runs").mapInArrow(run, LOCATED)


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    rows: list[tuple] = []
    size = 0
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            rows.append(row)
            size += len(row[2] or "")
            if size >= SHARD_CHARS:
                yield rows
                rows, size = [], 0
    if rows:
        yield rows


def _windows(docs: DataFrame, window: int) -> DataFrame:
    """Each window of each leader's run. docs: row, doc_id, text, runs (phrase, n, firsts)."""

    def task():
        def f(x):
            out = {k: [] for k in ("row", "doc_id", "phrase", "w", "first")}
            for row, doc_id, text, runs in zip(x["row"], x["doc_id"], x["text"], x["runs"], strict=True):
                words = plain(text).split(" ")
                for r in runs:
                    for first in r["firsts"]:
                        for i in range(first, first + r["n"]):
                            for k, v in zip(out, (row, doc_id, r["phrase"], _digest(" ".join(words[i : i + window])), i), strict=True):
                                out[k].append(v)
            return out

        return f

    return common.stream(docs.select("row", "doc_id", "text", "runs"), task, "row long, doc_id long, phrase long, w long, first int")


def _cuts(dealt: DataFrame, window: int, phrase: int) -> DataFrame:
    """row, cuts (the first window, and in the lowest bits how many) of the rows that lose words. dealt: a table in buckets by ROW, with doc_id and text."""
    docs = dealt.select(F.col(ROW).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    usable = docs.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    found = common.staged(runs_of(usable, window, phrase), "runs")
    # What joins by anchor, phrase or class is staged first, so that a hot one can be split.
    again = common.staged(found.groupBy("anchor").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high").select("anchor"), "anchors")
    places = found.select("row", "run", "anchor").join(again, "anchor")
    # What goes to documents lies in the same buckets.
    runs = common.bucketed(places.groupBy("row").agg(F.collect_list("run").alias("runs")), "row", "places", dealt=True)
    common.drop_staged(found, again)
    said = common.staged(phrases_at(usable.join(runs, "row"), phrase), "phrases")
    known = common.staged(said.groupBy("phrase").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high").select("phrase"), "confirmed")
    routed = common.bucketed(said.select("row", "phrase").join(known, "phrase").groupBy("row").agg(F.collect_list("phrase").alias("phrases")), "row", "routed", dealt=True)
    common.drop_staged(said, known)
    rows = common.staged(located(usable.join(runs, "row", "left").join(routed, "row", "left"), window, phrase), "located")
    classes = common.staged(rows.groupBy("phrase", "class").agg(F.min("doc_id").alias("leader")), "classes")
    owned = common.staged(rows.join(classes, ["phrase", "class"]), "owned")
    common.drop_staged(runs, routed, rows)
    cut = lambda n: F.shiftleft(F.col("first").cast("long"), _N).bitwiseOR(n).alias("cut")
    later = owned.where("doc_id > leader").select("row", F.explode("firsts").alias("first"), "n").select("row", cut(F.col("n")))
    # A leader loses a window that another class of the phrase holds in a smaller document.
    several = common.staged(classes.groupBy("phrase").agg(F.count("*").alias("k")).where("k > 1").select("phrase"), "several")
    leaders = owned.where("doc_id = leader").join(several, "phrase").groupBy("row").agg(F.collect_list(F.struct("phrase", "n", "firsts")).alias("runs"))
    each = common.staged(_windows(usable.join(leaders, "row"), window), "windows")
    least = common.staged(each.groupBy("phrase", "w").agg(F.min("doc_id").alias("low"), F.count("*").alias("n")).where("n > 1").select("phrase", "w", "low"), "least")
    single = each.join(least, ["phrase", "w"]).where("low < doc_id").select("row", cut(F.lit(1)))
    cuts = common.bucketed(later.unionAll(single).groupBy("row").agg(F.collect_list("cut").alias("cuts")), "row", "cuts", dealt=True)
    common.drop_staged(classes, owned, several, each, least)
    return cuts


def _dealt(docs: DataFrame, window: int, phrase: int) -> DataFrame:
    if not 0 < phrase <= window < 1 << _PLACE:
        raise ValueError(f"a phrase has words and fits in a window, which is under {1 << _PLACE}")
    return common.bucketed(docs.withColumn(ROW, F.monotonically_increasing_id()), ROW, "documents")


def kept(text: str | None, cuts: list[int] | None, window: int) -> tuple[int, int, str]:
    """Words, words removed, and the others joined by one space each."""
    line = plain(text)
    n = line.count(" ") + 1 if line else 0
    if not cuts:
        return n, 0, line
    words, covered = line.split(" "), bytearray(n)
    for c in cuts:
        first = c >> _N
        end = min(n, first + (c & ((1 << _N) - 1)) + window - 1)
        covered[first:end] = b"\1" * (end - first)
    left = [w for w, c in zip(words, covered, strict=True) if not c]
    return n, n - len(left), " ".join(left)


def substring_dedup(docs: DataFrame, window: int = WINDOW, phrase: int = PHRASE) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every row.

    A word goes if a window of `window` words covers it whose words also start in a document with a smaller
    doc_id; windows are judged on the input. Null and empty texts have no words; a very long text is a shard of its own. Rows with
    a null doc_id lose nothing and take nothing. Rows that repeat a doc_id don't count as smaller. An empty table gives no rows.
    Columns other than doc_id and text take no part."""
    common.configure(docs.sparkSession)
    dealt = _dealt(docs.select(F.col("doc_id").cast("long"), "text"), window, phrase)
    cuts = _cuts(dealt, window, phrase).withColumnRenamed("row", ROW)

    def task():
        def f(x):
            found = [kept(text, c, window) for text, c in zip(x["text"], x["cuts"], strict=True)]
            return {"doc_id": x["doc_id"], "n_words": [n for n, _, _ in found], "n_removed": [n for _, n, _ in found], "kept_sha256": [sha256(t) for *_, t in found]}

        return f

    return common.stream(dealt.join(cuts, ROW, "left").select("doc_id", "text", "cuts"), task, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def without_repeats(docs: DataFrame, window: int = WINDOW, phrase: int = PHRASE) -> DataFrame:
    """docs with the repeated words gone from text, and documents that have no words left gone; texts that lose nothing are
    as they were, others are the kept words joined by spaces. Other columns stay as they are; see substring_dedup for odd rows."""
    common.configure(docs.sparkSession)
    dealt = _dealt(docs, window, phrase)
    cuts = _cuts(dealt, window, phrase).select(F.col("row").alias(ROW), F.col("cuts").alias("__attestry_cuts"))
    columns, kinds = docs.columns, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)

    def task():
        def f(x):
            keep = []
            for i, (text, cuts_) in enumerate(zip(x["text"], x["__attestry_cuts"], strict=True)):
                if cuts_:
                    x["text"][i] = kept(text, cuts_, window)[2]
                    if not x["text"][i]:
                        continue
                keep.append(i)
            return {c: [x[c][i] for i in keep] for c in columns}

        return f

    return common.stream(dealt.join(cuts, ROW, "left").select(*columns, "__attestry_cuts"), task, kinds)
