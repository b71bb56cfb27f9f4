"""Weighted fusion over cells, clustering by cell, and roll-ups by provenance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def weighted_mean(df: DataFrame, by: list, value: str, weight: str) -> DataFrame:
    """Sum of value times weight over the sum of weights, where that is positive."""
    total = F.sum(weight)
    return df.groupBy(*by).agg((F.sum(F.col(value) * F.col(weight)) / total).alias("fused"), total.alias("weight")).where("weight > 0")


def fuse_samples(samples: DataFrame, by: list[str], sdf: str, depth: str, colours: list[str] = (), truncation: float = 1.0, nearest: float = 0.3, farthest: float = 8.0) -> DataFrame:
    """Truncated signed distances of samples fused by voxel: weight 1 / max(depth, nearest); samples
    farther than `farthest` or behind the truncation are left out. Colours are averaged by the same
    weights over samples near the surface only, so space seen as free doesn't darken them."""
    ok = samples.where((F.col(depth) < farthest) & (F.col(sdf) >= -truncation))
    rows = ok.withColumn("_s", F.least(F.col(sdf) / truncation, F.lit(1.0))).withColumn("_w", 1 / F.greatest(F.col(depth), F.lit(nearest)))
    near = F.when(F.abs(F.col(sdf)) < truncation, F.col("_w"))
    colour = [(F.sum(near * F.col(c)) / F.sum(near)).alias(c) for c in colours]
    return rows.groupBy(*by).agg((F.sum(F.col("_s") * F.col("_w")) / F.sum("_w")).alias("tsdf"), F.sum("_w").alias("weight"), *colour)


def cell_cluster(df: DataFrame, by: list[str], axes: list[str], size: float | list[float], means: list[str] = ()) -> DataFrame:
    """Rows clustered by cell: the mean of the axes and of other columns, and how many."""
    sizes = size if isinstance(size, list) else [size] * len(axes)
    cells = [F.floor(F.col(a) / s).cast("long").alias(f"cell_{a}") for a, s in zip(axes, sizes, strict=True)]
    return df.groupBy(*by, *cells).agg(*[F.avg(c).alias(c) for c in (*axes, *means)], F.count("*").alias("n"))


def decimate(vertices: DataFrame, faces: DataFrame, by: list[str], cell: float, colours: list[str] = ()) -> tuple[DataFrame, DataFrame]:
    """A mesh with vertices clustered by cell: (vertices, faces); faces that lost an edge or repeat
    (in any turn) go. vertices: by, id, x, y, z and colours; faces: by, v0, v1, v2."""
    cells = [F.floor(F.col(a) / cell).cast("long").alias(f"_{a}") for a in ("x", "y", "z")]
    keyed = vertices.select("*", *cells)
    merged = keyed.groupBy(*by, "_x", "_y", "_z").agg(F.min("id").alias("new"), *[F.avg(c).alias(c) for c in ("x", "y", "z", *colours)])
    to = keyed.select(*by, "id", "_x", "_y", "_z").join(merged.select(*by, "_x", "_y", "_z", "new"), [*by, "_x", "_y", "_z"]).select(*by, "id", "new")
    out = faces
    for v in ("v0", "v1", "v2"):
        out = out.join(to.select(*by, F.col("id").alias(v), F.col("new").alias(f"n{v}")), [*by, v])
    out = out.select(*by, F.col("nv0").alias("v0"), F.col("nv1").alias("v1"), F.col("nv2").alias("v2")).where("v0 <> v1 and v1 <> v2 and v0 <> v2")
    out = out.withColumn("_k", F.array_sort(F.array("v0", "v1", "v2"))).dropDuplicates([*by, "_k"]).drop("_k")
    return merged.select(*by, F.col("new").alias("id"), "x", "y", "z", *colours), out


def class_shares(df: DataFrame, by: list[str], classes: dict[str, Column], weight: Column | None = None) -> DataFrame:
    """Weighted share of each class; a row belongs to the first class whose condition holds."""
    w = weight if weight is not None else F.lit(1.0)
    label = F.lit(None).cast("string")
    for name, condition in reversed(classes.items()):
        label = F.when(condition, name).otherwise(label)
    rows = df.withColumn("_label", label).withColumn("_w", w.cast("double"))
    return rows.groupBy(*by).agg(F.sum("_w").alias("weight"), *[(F.sum(F.when(F.col("_label") == n, F.col("_w")).otherwise(0.0)) / F.greatest(F.sum("_w"), F.lit(1e-9))).alias(n) for n in classes])


def roll_up(df: DataFrame, by: list[str], shares: list[str], area: str) -> DataFrame:
    """Area-weighted shares over all rows of a key."""
    total = F.greatest(F.sum(area), F.lit(1e-9))
    return df.groupBy(*by).agg(F.sum(area).alias(area), *[(F.sum(F.col(c) * F.col(area)) / total).alias(c) for c in shares])


def bounds(df: DataFrame, by: list[str], axes: list[str], tail: float = 0.005, pad: float = 0.1) -> DataFrame:
    """Robust bounds of each axis: the outer percentiles, widened by a tenth of their range and the pad."""
    out = []
    for a in axes:
        lo, hi = F.percentile(a, F.lit(tail)), F.percentile(a, F.lit(1 - tail))
        out += [(lo - (hi - lo) * 0.1 - pad).alias(f"{a}_min"), (hi + (hi - lo) * 0.1 + pad).alias(f"{a}_max")]
    return df.groupBy(*by).agg(*out)
