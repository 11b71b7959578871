"""Annotator agreement report."""

from __future__ import annotations

from datetime import datetime, timezone

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.stats import percentile_bootstrap
from ..operators import agreement
from ..schemas import LABEL_COLUMNS


def alpha_of(m: np.ndarray, k: np.ndarray) -> float:
    """Krippendorff's alpha of binary items with m values, k of them ones."""
    m, k = m[m >= 2].astype(float), k[m >= 2].astype(float)
    n, ones = m.sum(), k.sum()
    if not len(m):
        return float("nan")
    mixed = 2 * ones * (n - ones)
    if mixed == 0:
        return 1.0
    return float(1 - (2 * k * (m - k) / (m - 1)).sum() / n / (mixed / (n * (n - 1))))


def alpha_interval(m: np.ndarray, k: np.ndarray, n_resamples: int = 1000, alpha: float = 0.05, seed: int | None = None) -> tuple[float, float]:
    """Percentile bootstrap over items, in their order."""
    return percentile_bootstrap(len(m), lambda i: alpha_of(m[i], k[i]), n_resamples, alpha, seed)


#: Items beyond which the exact bootstrap, which has a pair of numbers an item and label in the driver, is refused.
EXACT_ITEMS = 1_000_000


def scale_interval(pairs: DataFrame, n_resamples: int, alpha: float, seed: int | None) -> tuple[float, float]:
    """Percentile bounds of alpha over items (m, k) by Poisson weights drawn on the executors: each resample is three weighted sums."""
    usable = pairs.where("m >= 2").select(F.col("m").cast("double"), F.col("k").cast("double"), F.xxhash64(F.lit(seed or 0), "item").alias("h"))

    def run(batches):
        for batch in batches:
            m, k, h = (batch.column(i).to_numpy() for i in range(3))
            sums = np.zeros((n_resamples, 3))
            rng = np.random.default_rng([seed or 0, int(h.view(np.uint64)[0]) if len(h) else 0])
            values = np.stack([m, k, 2 * k * (m - k) / (m - 1)], 1)
            for b in range(n_resamples):
                sums[b] = rng.poisson(1.0, len(m)) @ values
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(n_resamples)), *(pa.array(sums[:, i].copy()) for i in range(3))], ["b", "n", "ones", "apart"])

    sums = usable.mapInArrow(run, "b long, n double, ones double, apart double").groupBy("b").agg(*[F.sum(c).alias(c) for c in ("n", "ones", "apart")]).collect()
    found = []
    for r in sums:
        mixed = 2 * r.ones * (r.n - r.ones)
        if r.n > 1:
            found.append(1.0 if mixed == 0 else 1 - r.apart / r.n / (mixed / (r.n * (r.n - 1))))
    if not found:
        return float("nan"), float("nan")
    low, high = np.percentile(found, [100 * alpha / 2, 100 * (1 - alpha / 2)])
    return float(low), float(high)


def _items(df: DataFrame, task: str) -> DataFrame:
    item = F.concat_ws(":", "record_uuid", "chunk_id") if task == "retrieval" else F.col("record_uuid")
    return df.withColumn("item", item)


def agreement_report(frames: dict[str, DataFrame], *, n_resamples: int = 1000, ci: float = 0.95, seed: int | None = None, exclude_annotators: list[str] | None = None, after: str | None = None, before: str | None = None, export_id: str = "", bootstrap: str = "exact") -> dict:
    """Alpha with its interval, percentage agreement and pairwise kappa for each task that has rows.

    frames: annotation rows (with ord) by task. bootstrap: exact, where the driver sees one (m, k) pair for each item and label and
    more than EXACT_ITEMS are an error, or scale, where items stay on the executors."""
    if not 0 < ci < 1:
        raise ValueError("ci must be between 0 and 1")
    if bootstrap not in ("exact", "scale"):
        raise ValueError(f"unknown bootstrap {bootstrap!r}")
    tasks, finite = [], lambda x: None if x is None or np.isnan(x) else float(x)
    for task, df in frames.items():
        rows = agreement.filtered(df, exclude_annotators, after, before)
        if "ord" not in rows.columns:
            rows = rows.withColumn("ord", F.monotonically_increasing_id())
        long = agreement.long_form(_items(rows, task), list(LABEL_COLUMNS[task])).persist()
        try:
            counts = agreement.item_counts(long)
            pct = {r.label: r.pct_agreement for r in agreement.percentage_agreement(counts).collect()}
            people = {r.label: r.n for r in long.groupBy("label").agg(F.count_distinct("annotator_id").alias("n")).collect()}
            if counts.isEmpty():
                continue
            alphas = {r.label: r.alpha for r in agreement.krippendorff(counts).collect()}
            usable = {r.label: r.n for r in counts.groupBy("label").agg(F.count_if(F.col("m") >= 2).alias("n")).collect()}
            bounds = {}
            if bootstrap == "scale":
                for label in LABEL_COLUMNS[task]:
                    bounds[label] = scale_interval(counts.where(F.col("label") == label), n_resamples, 1 - ci, seed)
            else:
                if (n := counts.select("item").distinct().count()) > EXACT_ITEMS:
                    raise ValueError(f"{n} items; ask for the bootstrap's scale mode")
                cells = counts.toPandas()
                every = sorted(set(cells["item"]))
                for label in LABEL_COLUMNS[task]:
                    own = cells[cells["label"] == label].set_index("item").reindex(every).fillna(0)
                    bounds[label] = alpha_interval(own["m"].to_numpy(float), own["k"].to_numpy(float), n_resamples, 1 - ci, seed)
            labels = [
                {"label": x, "alpha": finite(alphas.get(x)), "ci_lower": finite(bounds[x][0]), "ci_upper": finite(bounds[x][1]), "n_items": usable.get(x, 0), "n_annotators": people.get(x, 0), "pct_agreement": finite(pct.get(x))}
                for x in LABEL_COLUMNS[task]
            ]
            kappa = [r.asDict() for r in agreement.cohen_kappa(long).orderBy("annotator_a", "annotator_b").collect()]
        finally:
            long.unpersist()
        tasks.append({"task": task, "labels": labels, "pairwise_kappa": kappa})
    return {"export_id": export_id, "created_at": datetime.now(timezone.utc).isoformat(), "tasks": tasks, "n_bootstrap_resamples": n_resamples, "ci_level": ci}
