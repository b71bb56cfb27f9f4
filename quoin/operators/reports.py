"""Evaluation reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def summary(df: DataFrame, by: list[str], metrics: list[str], digits: int | None = 3) -> DataFrame:
    """Means of the metrics by key, exact for decimals; null and NaN don't count; null where nothing is left."""
    clean = lambda c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c))
    mean = lambda c: F.avg(clean(c))
    return df.groupBy(*by).agg(*[(F.round(mean(c), digits) if digits is not None else mean(c)).alias(c) for c in metrics])


def mark_best(df: DataFrame, metrics: dict[str, bool], within: list[str] = (), tolerance: float = 1e-9) -> DataFrame:
    """Add best_<metric>: whether the row has the best value of the column (True: the larger the better)."""
    w = Window.partitionBy(*within)
    out = df
    for c, larger in metrics.items():
        top = (F.max if larger else F.min)(c).over(w)
        out = out.withColumn(f"best_{c}", F.coalesce(F.abs(F.col(c) - top) <= tolerance, F.lit(False)))
    return out


def nested_counts(df: DataFrame, by: str, what: str) -> DataFrame:
    """A map from each value of `what` to its count, by key."""
    seen = df.groupBy(by, what).agg(F.count("*").alias("n"))
    return seen.groupBy(by).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(what, "n")))).alias("counts"))


def pivot_gain(df: DataFrame, sample: str, config: str, metric: str, base: str, other: str, n: int) -> DataFrame:
    """The n samples that gain most from `base` to `other`, and the one that loses most; gain, rank and which."""
    wide = df.groupBy(sample).pivot(config, [base, other]).agg(F.avg(metric))
    wide = wide.select(sample, F.col(f"`{base}`").alias("base"), F.col(f"`{other}`").alias("other"), (F.col(f"`{other}`") - F.col(f"`{base}`")).alias("gain")).where("gain is not null")
    top = wide.orderBy(F.desc("gain"), sample).limit(n).withColumn("pick", F.lit("gain"))
    worst = wide.orderBy("gain", sample).limit(1).withColumn("pick", F.lit("loss"))
    return top.unionByName(worst)


def precision_recall(df: DataFrame, by: list[str], predicted: Column, actual: Column) -> DataFrame:
    """Counts, precision and recall by key; precision is 1 without predictions and without actuals, 0
    without predictions otherwise; recall is 1 without actuals."""
    n = lambda c: F.sum(c.cast("long"))
    agg = df.groupBy(*by).agg(n(predicted & actual).alias("tp"), n(predicted).alias("n_pred"), n(actual).alias("n_true"))
    p = F.when(F.col("n_pred") > 0, F.col("tp") / F.col("n_pred")).when(F.col("n_true") == 0, 1.0).otherwise(0.0)
    r = F.when(F.col("n_true") > 0, F.col("tp") / F.col("n_true")).otherwise(1.0)
    return agg.withColumn("precision", p).withColumn("recall", r)


def miss_category(cover: Column, best_cover_of_pred: Column, area_ratio: Column) -> Column:
    """Why a room was missed: missing (covered under 0.3), merged (over 0.6 by a prediction over 1.6
    times as large), split (covered under 0.6 by any one while covered over 0.6), else shifted."""
    return F.when(cover < 0.3, "missing").when((best_cover_of_pred > 0.6) & (area_ratio > 1.6), "merged").when((best_cover_of_pred < 0.6) & (cover > 0.6), "split").otherwise("shifted")


def percentage_error(predicted: Column, actual: Column) -> Column:
    return F.abs(predicted - actual) / F.abs(actual)


def iou(inter: Column, union: Column) -> Column:
    """Overlap; 1 where both are empty."""
    return F.when(union > 0, inter / union).otherwise(1.0)


def psnr(error: Column) -> Column:
    """Aggregate: peak signal to noise of squared errors, in decibels."""
    return 10 * F.log10(1 / F.greatest(F.avg(error), F.lit(1e-12)))


def tf_idf(tokens: DataFrame, doc: str, term: str) -> DataFrame:
    """tf times ln(N / df), each document's vector scaled to length one. Terms of every document weigh 0."""
    tf = tokens.groupBy(doc, term).agg(F.count("*").alias("tf"))
    df = tf.groupBy(term).agg(F.count("*").alias("df"))
    n = tf.agg(F.count_distinct(doc).alias("_n"))
    weighted = tf.join(df, term).crossJoin(F.broadcast(n)).withColumn("_w", F.col("tf") * F.log(F.col("_n") / F.col("df")))
    norm = F.sqrt(F.sum(F.col("_w") * F.col("_w")).over(Window.partitionBy(doc)))
    return weighted.withColumn("weight", F.when(norm > 0, F.col("_w") / norm).otherwise(0.0)).select(doc, term, "tf", "df", "weight")
