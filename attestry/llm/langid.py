"""Language identification by a string kernel.

Blended spectrum: two texts are as alike as the shares of n-grams, 1 to 4 letters long, that are present in
both, each length normalised and all lengths averaged. Nyström landmarks span the kernel's features,
one-versus-rest kernel ridge regression is fitted on them, and a batch of texts is scored by matrix products.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

ORDERS = 4
#: Hash buckets for the n-grams of one length.
WIDTH = 1 << 16
#: Letters by Unicode's categories L*, so numerals such as ½, ² and Ⅷ are none.
_LETTER = regex.compile(r"\p{L}")
_FACTORS = [np.uint32(x) for x in (1, 0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D)]
UNKNOWN = "und"


def _letters(text: str) -> np.ndarray:
    """Lower-case code points with every run of other characters as one space, and a space at both ends."""
    points = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    other = (points < 128) & ~((points >= 97) & (points <= 122)) | (points >= 0x80) & (points < 0xC0) & (points != 0xAA) & (points != 0xB5) & (points != 0xBA) | (points == 0xD7) | (points == 0xF7)
    keep = ~other
    keep[0] = True
    keep[1:] |= ~other[:-1]
    return np.where(other, np.uint32(32), points)[keep]


def grams(text: str, seen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash buckets of the n-grams present, and how many there are of each length. seen: zeros, left so."""
    points = _letters(text)
    code = np.zeros(len(points), np.uint32)
    for n in range(ORDERS):
        if len(points) <= n:
            break
        code = code[: len(points) - n] * np.uint32(0x01000193) + points[n:] * _FACTORS[n]
        seen[((code ^ (code >> np.uint32(15))) * np.uint32(0x2C1B3C6D) >> np.uint32(16)).astype(np.int64) + n * WIDTH] = True
    found = np.flatnonzero(seen)
    seen[found] = False
    return found, np.bincount(found // WIDTH, minlength=ORDERS)


@dataclass
class Model:
    """columns: bucket -> row of `landmarks`, or -1; landmarks: n-gram x landmark; weights: landmark x language."""

    languages: list[str]
    columns: np.ndarray
    landmarks: np.ndarray
    weights: np.ndarray
    sharpness: float = 6.0
    #: Share of a text's letters and letter pairs that the landmarks have, under which it is in no language that was learned. Longer
    #: n-grams don't tell, as a long text has ever more that are rare.
    floor: float = 0.0

    def kernel(self, texts: list[str]) -> np.ndarray:
        """Kernel of each text and each landmark."""
        return self._kernel(texts)[0]

    def _kernel(self, texts: list[str]) -> tuple[np.ndarray, list[float]]:
        """The kernel, and the share of each text's letters and pairs that the landmarks have."""
        rows, seen, shares = np.zeros((len(texts), len(self.landmarks)), np.float32), np.zeros(ORDERS * WIDTH, bool), []
        for i, text in enumerate(texts):
            found, counts = grams(text, seen)
            at = self.columns[found]
            known = at >= 0
            rows[i, at[known]] = (1 / (ORDERS * np.sqrt(np.maximum(counts, 1))))[found[known] // WIDTH]
            short = known[: counts[:2].sum()]
            shares.append(float(short.mean()) if len(short) else 0.0)
        return rows @ self.landmarks, shares

    def judge(self, texts: list[str | None]) -> tuple[list[str], list[float], list[float]]:
        """The language, its share of the softmax over all, and the share of known letters and pairs; `und`, 0 and 0 for null or no
        letters. Ties: the first by name."""
        names, scores, shares = [UNKNOWN] * len(texts), [0.0] * len(texts), [0.0] * len(texts)
        use = [i for i, x in enumerate(texts) if x and _LETTER.search(x)]
        for block in common.chunks(use if self.languages else [], 128):
            kernel, known = self._kernel([texts[i] for i in block])
            out = kernel @ self.weights
            share = np.exp(self.sharpness * (out - out.max(1, keepdims=True)).astype(np.float64))
            share /= share.sum(1, keepdims=True)
            for i, k, s, part in zip(block, share.argmax(1), share.max(1), known, strict=True):
                names[i], scores[i], shares[i] = self.languages[k], float(s), part
        return names, scores, shares

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """The language and its score of each text, as judged."""
        return self.judge(texts)[:2]


def fit_texts(texts: list[str], labels: list[str], landmarks_each: int = 24, ridge: float = 1e-3, max_landmarks: int = 1500) -> Model:
    """Fit on texts in memory; every language has a landmark at least. No text gives a model that answers `und`."""
    languages = sorted(set(labels))
    landmarks_each = max(1, min(landmarks_each, max_landmarks // max(1, len(languages))))
    if not languages:
        return Model([], np.zeros(0, np.int64), np.zeros((0, 0), np.float32), np.zeros((0, 0)))
    seen = np.zeros(ORDERS * WIDTH, bool)
    marks = [i for k in languages for i in [j for j, x in enumerate(labels) if x == k][:landmarks_each]]
    found = [grams(texts[i], seen) for i in marks]
    used = np.unique(np.concatenate([x for x, _ in found]))
    columns = np.full(ORDERS * WIDTH, -1, np.int64)
    columns[used] = np.arange(len(used))
    table = np.zeros((len(used), len(marks)), np.float32)
    for j, (x, counts) in enumerate(found):
        table[columns[x], j] = (1 / np.sqrt(np.maximum(counts, 1)))[x // WIDTH]
    model = Model(languages, columns, table, np.zeros((len(marks), len(languages))))
    blocks = [model._kernel(block) for block in common.chunks(texts, 128)]
    cross, shares = np.concatenate([x for x, _ in blocks]).astype(np.float64), [s for _, x in blocks for s in x]
    values, vectors = np.linalg.eigh(cross[marks])
    good = values > 1e-6 * values.max()
    root = vectors[:, good] / np.sqrt(values[good])
    features = cross @ root
    target = np.where(np.array(labels)[:, None] == np.array(languages)[None], 1.0, -1.0)
    balance = np.array([1 / labels.count(x) for x in labels]) * len(labels) / len(languages)
    gram = (features * balance[:, None]).T @ features + ridge * len(texts) * np.eye(features.shape[1])
    # Texts that aren't landmarks tell how much of a text is known; half of what almost all have is too little.
    model.floor = 0.5 * float(np.quantile([shares[i] for i in sorted(set(range(len(texts))) - set(marks)) or marks], 0.01))
    model.weights = (root @ np.linalg.solve(gram, (features * balance[:, None]).T @ target)).astype(np.float32)
    return model


def fit(labelled: DataFrame, rows_each: int = 250, max_chars: int = 20_000, long_each: int = 8, max_rows: int = 4000) -> Model:
    """Fit on a bounded sample of the labelled rows, in which every language has a text.

    The sample: at most `rows_each` texts of up to `max_chars` characters a language, those with the smallest hash of doc_id; of a
    language with long texts alone the `long_each` shortest. If all languages together would have over `max_rows`, each has its
    even share, one at least. labelled: doc_id, text, lang; rows with a null in text or lang and texts without letters take no part,
    repeated rows count once. No such row gives a model that answers `und`."""
    size = F.length("text")
    fits = labelled.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    late = F.when(size > max_chars, size).otherwise(0)
    first = Window.partitionBy("lang").orderBy("late", F.xxhash64(F.col("doc_id")), "doc_id")
    ids = fits.select("doc_id", "lang", late.alias("late")).withColumn("n", F.row_number().over(first)).where(F.col("n") <= rows_each)
    chosen = [r for r in ids.collect() if not r.late or r.n <= long_each]  # rows_each a language at most
    share = max(1, max_rows // max(1, len({r.lang for r in chosen})))
    chosen = [(r.doc_id, r.lang) for r in chosen if r.n <= share]
    wanted = labelled.sparkSession.createDataFrame(chosen, fits.select("doc_id", "lang").schema)
    same = fits["doc_id"].eqNullSafe(wanted["doc_id"]) & (fits["lang"] == wanted["lang"])
    rows = fits.select("doc_id", "text", "lang").join(F.broadcast(wanted), same, "left_semi").collect()
    rows = sorted({(r.doc_id, r.lang, r.text) for r in rows if _LETTER.search(r.text)}, key=lambda r: (r[1], -1 if r[0] is None else r[0], r[2]))
    return fit_texts([r[2] for r in rows], [r[1] for r in rows])


def identify(docs: DataFrame, model: Model, keep: bool = False) -> DataFrame:
    """doc_id, lang_pred, score of every row; with `keep`, all columns of docs and then these.

    Null and empty texts and texts without letters: `und`, score 0. Very long texts count whole. Ties go to the language that is
    first by name. Repeated rows give repeated rows, an empty table none. Columns of docs named lang_pred or score are replaced."""
    spark = common.configure(docs.sparkSession)
    shared = spark.sparkContext.broadcast(model)
    docs = common.without(docs, "lang_pred", "score")
    columns = docs.columns if keep else ["doc_id"]
    used = docs if keep else docs.select("doc_id", "text")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in used.select(*columns).schema.fields)

    def task():
        def f(x):
            names, scores = shared.value.predict(x["text"])
            return {c: x[c] for c in columns} | {"lang_pred": names, "score": scores}

        return f

    return common.stream(used, task, f"{kinds}, lang_pred string, score double")


def accepted(docs: DataFrame, model: Model, languages: list[str] | None = None) -> DataFrame:
    """The rows of docs in a language that was learned, or in one of `languages`; where `lang` is null it is the predicted one.

    Texts go that are null, have no letters, or of whose letters and pairs the landmarks have less than the model's floor. A model
    without languages is an error if there is a text with letters: nothing tells what to keep. Repeated rows stay, an
    empty table stays empty; other columns stay as they are."""
    spark = common.configure(docs.sparkSession)
    if not model.languages and not docs.where(F.col("text").rlike(r"\p{L}")).isEmpty():
        raise ValueError("no labelled text to learn languages from")
    shared = spark.sparkContext.broadcast(model)
    columns = docs.columns
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)

    def task():
        def f(x):
            m = shared.value
            names, _, shares = m.judge(x["text"])
            keep = [i for i, name in enumerate(names) if name != UNKNOWN and (languages is None or name in languages) and shares[i] >= m.floor]
            if "lang" in x:
                x["lang"] = [name if v is None else v for v, name in zip(x["lang"], names, strict=True)]
            return {c: [x[c][i] for i in keep] for c in columns}

        return f

    return common.stream(docs, task, kinds)
