"""Toxic passages by maximum-scoring segments.

Words get the log-odds of toxic against clean texts under an informative Dirichlet prior (Monroe, Colaresi
and Quinn 2008); a word seen too rarely falls back to its first letters, and one whose odds can't be told from even costs
the drift. A linear scan (Ruzzo and Tompa 1999) finds every maximal segment of a text. Karlin and Altschul's extreme-value law
says how many segments of its score a clean text of that length has by chance: those of few are the toxic passages, and
together they give the text's score.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

WORD = re.compile(r"[^\W\d_]+")
#: Lengths of the word beginnings that stand in for rare words.
STEMS = (6, 5, 4)
#: Words remembered at most by a task.
MEMORY = 200_000
#: Segments of clean texts that show the tail of their scores.
TAIL = 100
#: Passages of which a clean text has more by chance aren't significant.
EXPECTED = 0.05


def units(word: str) -> list[str]:
    """The word, then its beginnings, longest first; beginnings are marked with `*`."""
    return [word, *(f"{word[:n]}*" for n in STEMS if len(word) > n)]


def segments(scores: list[float]) -> list[tuple[int, int, float]]:
    """All maximal scoring segments as (first, end, score), by Ruzzo and Tompa's linear scan."""
    # Each candidate: first, end, sum before, sum after, index of the nearest candidate left of it with a smaller sum before.
    total, out = 0.0, []
    for i, s in enumerate(scores):
        before, total = total, total + s
        if s <= 0:
            continue
        first, end, low, high = i, i + 1, before, total
        while True:
            k = len(out) - 1
            while k >= 0 and out[k][2] >= low:
                k = out[k][4]
            if k < 0 or out[k][3] >= high:
                out.append((first, end, low, high, k))
                break
            first, low = out[k][0], out[k][2]
            del out[k:]
    return [(x[0], x[1], x[3] - x[2]) for x in out]


class _Scores(dict):
    """Scores of words, remembered."""

    def __init__(self, model: Model) -> None:
        self.model = model

    def __missing__(self, word: str) -> float:
        if len(self) > MEMORY:
            self.clear()
        out = self[word] = self.model.word(word)
        return out


@dataclass
class Model:
    """odds: units with significant log-odds, toxic or clean; drift: the score of any other word; rate and chance: the
    extreme-value law's lambda and K for segments of clean texts; scale: K by the likelihood of the labels."""

    odds: dict[str, float] = field(default_factory=dict)
    drift: float = -0.05
    rate: float = 1.0
    scale: float = 1.0
    chance: float = 1.0

    def word(self, word: str) -> float:
        """Log-odds of the most specific known unit, or the drift."""
        for x in units(word):
            if x in self.odds:
                return self.odds[x]
        return self.drift

    def passages(self, text: str | None, memory: _Scores) -> tuple[int, list[tuple[int, int, float]]]:
        """The number of words, and all maximal segments as (first word, end, score)."""
        words = WORD.findall(text.lower()) if text else []
        scores = np.fromiter(map(memory.__getitem__, words), float, len(words))
        hits = np.flatnonzero(scores > 0)
        if not len(hits):
            return len(words), []
        # Runs of other words between two hits are one step each, so the scan is over the hits alone.
        total = np.concatenate(([0.0], np.cumsum(scores)))
        before, upto, own = total[hits].tolist(), total[hits + 1].tolist(), scores[hits].tolist()
        steps, places, last = [], [], None
        for k, i in enumerate(hits.tolist()):
            if last is not None and i - last > 1:
                steps.append(before[k] - upto[k - 1])
                places.append(last + 1)
            steps.append(own[k])
            places.append(i)
            last = i
        return len(words), [(places[a], places[b - 1] + 1, s) for a, b, s in segments(steps)]

    def expected(self, n: int, s: float) -> float:
        """How many segments of such a score or higher a clean text of n words has by chance (the E-value)."""
        return self.chance * max(n, 1) * math.exp(-self.rate * s)

    def score(self, n: int, found: list[tuple[int, int, float]]) -> float:
        """Chance that at least one segment isn't what a clean text of n words has by chance."""
        clean = 1.0
        for _, _, s in found:
            clean *= -math.expm1(-self.scale * max(n, 1) * math.exp(-self.rate * s))
        return min(1.0, max(0.0, 1.0 - clean))


def _counts(sample: DataFrame) -> DataFrame:
    """unit, toxic, clean: how many of the sample's texts hold the unit, added up in each batch before they are dealt out.

    A text counts once however often it repeats a word, so a burst in one text is no evidence."""

    def task():
        def f(x):
            both = Counter(), Counter()
            for text, label in {*zip(x["text"], x["toxic"], strict=True)}:
                both[0 if label else 1].update({u for w in {*WORD.findall((text or "").lower())} for u in units(w)})
            names = [*{**both[0], **both[1]}]
            return {"unit": names, "toxic": [both[0][u] for u in names], "clean": [both[1][u] for u in names]}

        return f

    parts = common.stream(sample.select("text", "toxic"), task, "unit string, toxic long, clean long")
    return parts.groupBy("unit").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def fit(labelled: DataFrame, docs: DataFrame, max_rows: int = 40_000, prior: float = 1000.0, z: float = 3.5) -> Model:
    """Learn from a bounded sample of labelled rows: the `max_rows` with the smallest hash of doc_id.

    Three quarters of it give the log-odds, the rest the calibration. All units of these rows are kept whose log-odds are over `z`
    standard deviations from even. labelled: doc_id, toxic (0 or 1, other values take no part); repeated rows count once, a
    document with both labels counts for either. No usable label gives a model that scores every text 0."""
    chosen = labelled.where(F.col("toxic").isin(0, 1)).select("doc_id", "toxic").distinct().orderBy(F.xxhash64("doc_id"), "doc_id", "toxic").limit(max_rows)
    sample = common.staged(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id"), "labelled")
    part = F.pmod(F.xxhash64(F.lit(7), F.col("doc_id")), F.lit(4))
    counts = common.staged(_counts(sample.where(part != 3)), "units")
    total = counts.where(~F.col("unit").endswith("*")).agg(F.sum("toxic"), F.sum("clean")).first()
    n_toxic, n_clean = (float(x or 0) for x in total)
    if not n_toxic or not n_clean:
        return Model()
    # The prior of a unit is its share of all words, `prior` words in all; a unit of toxic texts alone still has odds.
    share = prior * (F.col("toxic") + F.col("clean")) / (n_toxic + n_clean)
    t, c = F.col("toxic") + share, F.col("clean") + share
    odds = F.log(t / (n_toxic + prior - t)) - F.log(c / (n_clean + prior - c))
    deviation = F.sqrt(1 / t + 1 / c)
    kept = counts.select("unit", odds.alias("odds"), (odds / deviation).alias("z"), "toxic", "clean")
    # Few counts have wide deviations whatever the odds, so a unit absent from clean texts needs many counts in toxic ones.
    sure = (F.col("z") >= z) | ((F.col("clean") == 0) & (F.col("toxic") * math.log1p(n_clean / n_toxic) >= z * 4))
    toxic = (F.col("toxic") >= 4) & sure & (F.col("odds") > 1)
    # Beginnings of clean words say nothing of a rare word, so only whole words count against.
    clean = (F.col("z") <= -z) & (F.col("odds") < 0) & ~F.col("unit").endswith("*")
    rows = kept.where(toxic | clean).collect()  # units of max_rows texts at most
    model = Model({r.unit: float(r.odds) for r in sorted(rows, key=lambda r: r.unit)})
    # The share of toxic words in toxic texts sets what every other word costs.
    words = [r for r in rows if r.odds > 0 and not r.unit.endswith("*")]
    density = min(0.2, max(0.005, sum(r.toxic for r in words) / n_toxic))
    model.drift = math.log1p(-density)
    return _calibrated(model, sample.where(part == 3))


def _calibrated(model: Model, sample: DataFrame) -> Model:
    """Lambda and K from the segments of clean texts, by the tail of their scores; K for a text's score by the likelihood of the labels."""
    shared = sample.sparkSession.sparkContext.broadcast(model)

    def task():
        memory = _Scores(shared.value)

        def f(x):
            found = [shared.value.passages(t, memory) for t in x["text"]]
            return {"toxic": x["toxic"], "n": [n for n, _ in found], "s": [[s for *_, s in x] for _, x in found]}

        return f

    rows = common.stream(sample.select("text", "toxic"), task, "toxic int, n long, s array<double>").collect()  # bounded by max_rows
    clean = [r for r in rows if not r.toxic]
    hits = sorted(s for r in clean for s in r.s)
    length = sum(r.n for r in clean)
    if len(hits) >= 2 * TAIL:
        # Over a high score segments fall off as exp(-lambda * score), and K sets how many there are.
        start = hits[-TAIL]
        model.rate = 1 / max(1e-3, sum(s - start for s in hits[-TAIL:]) / TAIL)
        model.chance = TAIL / max(length, 1) * math.exp(model.rate * start)
    else:  # too few to show a tail: the law of a walk that goes up by the mean odds as often as clean words score
        up = [s for s in model.odds.values() if s > 0]
        height = sum(up) / max(1, len(up)) or 1.0
        chance = (len(hits) + 1) / (length + 2)
        low, high = 1e-6, 50.0
        for _ in range(80):  # sum of p * exp(lambda * s) is 1 at 0 and at lambda
            mid = (low + high) / 2
            if (1 - chance) * math.exp(mid * model.drift) + chance * math.exp(min(600.0, mid * height)) > 1:
                high = mid
            else:
                low = mid
        model.rate, model.chance = low, max(len(hits), 1) / max(length, 1)
    best = -math.inf
    for k in range(-40, 21):
        model.scale = math.exp(k / 4)
        fit_ = 0.0
        for r in rows:
            p = min(1 - 1e-6, max(1e-6, model.score(r.n, [(0, 0, s) for s in r.s])))
            fit_ += math.log(p if r.toxic else 1 - p)
        if fit_ > best:
            best, scale = fit_, model.scale
    model.scale = scale if rows else 1.0
    return model


def score(docs: DataFrame, model: Model, threshold: float = 0.3, expected: float = EXPECTED) -> DataFrame:
    """doc_id, score, predicted, passages (first word, end, score, expected) of every row.

    passages are the significant ones: a clean text of that length has at most `expected` by chance with such a score. Null and empty
    texts: score 0, no passages. Very long texts are scanned whole. Repeated rows give repeated rows, an empty table none.
    A score of just the threshold is predicted 1. Other columns take no part."""
    spark = common.configure(docs.sparkSession)
    shared = spark.sparkContext.broadcast(model)

    def task():
        memory = _Scores(shared.value)

        def f(x):
            m = shared.value
            found = [m.passages(t, memory) for t in x["text"]]
            scores = [m.score(n, s) for n, s in found]
            spans = [[{"first": a, "end": b, "score": s, "expected": e} for a, b, s in x if (e := m.expected(n, s)) <= expected] for n, x in found]
            return {"doc_id": x["doc_id"], "score": scores, "predicted": [int(s >= threshold) for s in scores], "passages": spans}

        return f

    return common.stream(docs.select("doc_id", "text"), task, "doc_id long, score double, predicted int, passages array<struct<first: long, end: long, score: double, expected: double>>")
