"""Inter-annotator agreement over long rows: one row for each (item, annotator, label)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def filtered(df: DataFrame, exclude: list[str] | None = None, after: str | None = None, before: str | None = None) -> DataFrame:
    """Calibration rows that were submitted by annotators not excluded, between both bounds, which count in. Times without a zone are UTC."""
    out = df.where(F.col("calibration") & (F.col("response_status") == "submitted"))
    if exclude:
        out = out.where(~F.col("annotator_id").isin(exclude))
    if after is not None:
        out = out.where(F.col("created_at") >= F.lit(after).cast("timestamp"))
    if before is not None:
        out = out.where(F.col("created_at") <= F.lit(before).cast("timestamp"))
    return out


def long_form(df: DataFrame, labels: list[str], ord_column: str = "ord") -> DataFrame:
    """item, annotator_id, label, value: the last row of each (item, annotator) counts; null labels are missing."""
    last = Window.partitionBy("item", "annotator_id").orderBy(F.desc(ord_column))
    rows = df.withColumn("__rank", F.row_number().over(last)).where("__rank = 1")
    each = F.array(*[F.struct(F.lit(x).alias("label"), F.col(x).cast("int").alias("value")) for x in labels])
    return rows.select("item", "annotator_id", F.explode(each).alias("x")).select("item", "annotator_id", "x.label", "x.value").where("value IS NOT NULL")


def item_counts(long: DataFrame) -> DataFrame:
    """label, item, m values of which k are ones: all that alpha, agreement and their bootstrap need."""
    return long.groupBy("label", "item").agg(F.count(F.lit(1)).alias("m"), F.sum("value").alias("k"))


def krippendorff(counts: DataFrame) -> DataFrame:
    """label, alpha, n_items: nominal alpha of binary labels over items with at least two values.

    alpha is 1 if all values are equal and null if no item has two values."""
    use = F.col("m") >= 2
    of = lambda x: F.coalesce(F.sum(F.when(use, x)), F.lit(0))
    sums = counts.groupBy("label").agg(
        of(2.0 * F.col("k") * (F.col("m") - F.col("k")) / F.nullif(F.col("m") - 1, F.lit(0))).cast("double").alias("observed"),
        of(F.col("m")).alias("n"),
        of(F.col("k")).alias("ones"),
        F.count(F.when(use, 1)).alias("n_items"),
    )
    mixed = 2.0 * F.col("ones") * (F.col("n") - F.col("ones"))
    expected = F.try_divide(mixed, F.col("n").cast("double") * (F.col("n") - 1))
    alpha = F.when(F.col("n_items") == 0, None).when(mixed == 0, 1.0).otherwise(1 - F.try_divide(F.try_divide("observed", "n"), expected))
    return sums.select("label", alpha.alias("alpha"), "n_items")


def krippendorff_nominal(long: DataFrame) -> DataFrame:
    """The same for any values: label, alpha, n_items from (item, label, value) rows."""
    cells = long.groupBy("label", "item", "value").agg(F.count(F.lit(1)).alias("c"))
    items = cells.groupBy("label", "item").agg(F.sum("c").alias("m"), F.sum(F.col("c") * F.col("c")).alias("cc")).where("m >= 2")
    used = cells.join(items.select("label", "item", "m"), ["label", "item"])
    totals = used.groupBy("label", "value").agg(F.sum("c").alias("t")).groupBy("label").agg(F.sum(F.col("t") * F.col("t")).alias("tt"), F.sum("t").alias("n"))
    seen = items.groupBy("label").agg(F.sum((F.col("m") * F.col("m") - F.col("cc")) / (F.col("m") - 1)).alias("observed"), F.count(F.lit(1)).alias("n_items"))
    both = long.select("label").distinct().join(seen, "label", "left").join(totals, "label", "left")
    mixed = F.col("n") * F.col("n") - F.col("tt")
    alpha = F.when(F.col("n_items").isNull(), None).when(mixed == 0, 1.0).otherwise(1 - F.try_divide(F.col("observed") * (F.col("n") - 1), mixed))
    return both.select("label", alpha.alias("alpha"), F.coalesce("n_items", F.lit(0)).alias("n_items"))


def percentage_agreement(counts: DataFrame) -> DataFrame:
    """label, pct_agreement: the mean over items with two values or more of the share of pairs that agree; null if there is none."""
    m, k = F.col("m"), F.col("k")
    pairs = lambda x: x * (x - 1) / 2
    share = F.when(m >= 2, F.try_divide(pairs(k) + pairs(m - k), pairs(m)))
    return counts.groupBy("label").agg(F.avg(share).alias("pct_agreement"))


def cohen_kappa(long: DataFrame) -> DataFrame:
    """annotator_a < annotator_b, kappa, n_shared_items: kappa is the mean over the labels for which it is defined; pairs for which
    none is are left out. Annotators of one item meet, so the pairs are those of a panel, not of all rows."""
    a = long.select("item", "label", F.col("annotator_id").alias("annotator_a"), F.col("value").alias("va"))
    b = long.select("item", "label", F.col("annotator_id").alias("annotator_b"), F.col("value").alias("vb"))
    met = a.join(b, ["item", "label"]).where("annotator_a < annotator_b")
    sums = met.groupBy("annotator_a", "annotator_b", "label").agg(
        F.count(F.lit(1)).alias("n"), F.sum((F.col("va") == F.col("vb")).cast("long")).alias("agree"), F.sum(F.col("va").cast("long")).alias("a1"), F.sum(F.col("vb").cast("long")).alias("b1")
    )
    n = F.col("n")
    chance = F.col("a1") * F.col("b1") + (n - F.col("a1")) * (n - F.col("b1"))
    kappa = F.when(chance != n * n, F.try_divide(F.col("agree") / n - chance / (n * n), 1 - chance / (n * n)))
    return sums.groupBy("annotator_a", "annotator_b").agg(F.avg(kappa).alias("kappa"), F.max("n").alias("n_shared_items")).where("kappa IS NOT NULL")
