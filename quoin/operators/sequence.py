"""Operators on rows in order, always within a partition key (a plan, a scene, a user)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def islands(df: DataFrame, by: list[str], order: list[str], breaks, name: str = "island") -> DataFrame:
    """Number the runs of rows; `breaks` gets a function of a column giving its value one row before,
    and returns when a new run begins. The first row of each key always begins one."""
    w = Window.partitionBy(*by).orderBy(*order)
    flagged = df.withColumn("_new", F.coalesce(breaks(lambda c: F.lag(c).over(w)).cast("int"), F.lit(1)))
    return flagged.withColumn(name, F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def gap_islands(df: DataFrame, by: list[str], at: str, gap, order: list[str] | None = None, name: str = "island") -> DataFrame:
    """Runs whose neighbours are at most `gap` apart."""
    return islands(df, by, order or [at], lambda before: (F.col(at) - before(at)) > gap, name)


def ratio_clusters(df: DataFrame, by: list[str], value: str, ratio: float = 1.3, name: str = "cluster") -> DataFrame:
    """Clusters of sorted values; a new one begins where a value exceeds the one before by the ratio."""
    return islands(df, by, [value], lambda before: F.col(value) > before(value) * ratio, name)


def runs(df: DataFrame, by: list[str], at: str, centre: str, thickness: str, least: int) -> DataFrame:
    """Bands of consecutive columns: a run breaks at a missing column or where the centre jumps by more
    than max(2, half the median thickness of its key); runs shorter than `least` are left out."""
    typical = df.groupBy(*by).agg(F.median(thickness).alias("_t"))
    rows = df.join(typical, by)
    rows = islands(rows, by, [at], lambda before: (F.col(at) - before(at) != 1) | (F.abs(F.col(centre) - before(centre)) > F.greatest(F.lit(2.0), F.col("_t") / 2)))
    found = rows.groupBy(*by, "island").agg(F.min(at).alias("first"), F.max(at).alias("last"), F.count("*").alias("n"), F.median(centre).alias("centre"), F.median(thickness).alias("thickness"))
    return found.where(F.col("n") >= least)


def bin_argmax(df: DataFrame, by: list[str], order: list[str], score: str, bins: int) -> DataFrame:
    """The best row of each of `bins` equal stretches of each key's rows, the first on ties; keys of
    no more rows than that keep all."""
    w = Window.partitionBy(*by).orderBy(*order)
    rows = df.withColumn("pos", F.row_number().over(w) - 1).withColumn("_n", F.count("*").over(Window.partitionBy(*by)))
    rows = rows.withColumn("bin", F.when(F.col("_n") > bins, F.floor(F.col("pos") * bins / F.col("_n"))).otherwise(F.col("pos")).cast("long"))
    best = Window.partitionBy(*by, "bin").orderBy(F.desc(score), "pos")
    return rows.withColumn("_r", F.row_number().over(best)).where("_r = 1").drop("_r", "_n")


def holdout(position: Column, k: int) -> Column:
    """Whether a position is held out: every k-th, from k div 2 on."""
    return (position >= k // 2) & (position % k == k // 2)


def even_pick(df: DataFrame, by: list[str], order: list[str], n: int) -> DataFrame:
    """At most n rows of each key, evenly spaced and with the first and last."""
    w = Window.partitionBy(*by).orderBy(*order)
    rows = df.withColumn("_i", F.row_number().over(w) - 1).withColumn("_m", F.count("*").over(Window.partitionBy(*by)))
    # place i is picked if some j in [0, n) has floor(j * (m - 1) / (n - 1)) = i
    j = F.ceil(F.col("_i") * (n - 1) / F.greatest(F.col("_m") - 1, F.lit(1)))
    hit = (F.floor(j * (F.col("_m") - 1) / (n - 1)) == F.col("_i")) & (j < n)
    return rows.where((F.col("_m") <= n) | hit).drop("_i", "_m")


def jump_filter(df: DataFrame, by: list[str], order: list[str], value: str, factor: float = 3.0, index: str | None = None) -> DataFrame:
    """Rows within factor * median step * gap of a neighbour on either side; a lone row stays."""
    w = Window.partitionBy(*by).orderBy(*order)
    at = F.col(index) if index else F.row_number().over(w)
    rows = df.withColumn("_at", at).withColumn("_pv", F.lag(value).over(w)).withColumn("_nv", F.lead(value).over(w))
    rows = rows.withColumn("_pg", F.col("_at") - F.lag("_at").over(w)).withColumn("_ng", F.lead("_at").over(w) - F.col("_at"))
    step = rows.groupBy(*by).agg(F.median(F.abs(F.col(value) - F.col("_pv")) / F.col("_pg")).alias("_step"))
    rows = rows.join(step, by)
    near = lambda v, g: F.abs(F.col(value) - F.col(v)) <= factor * F.col("_step") * F.col(g)
    keep = F.col("_step").isNull() | F.coalesce(near("_pv", "_pg"), F.lit(False)) | F.coalesce(near("_nv", "_ng"), F.lit(False))
    return rows.where(keep).drop("_at", "_pv", "_nv", "_pg", "_ng", "_step")


def neighbour_agreement(df: DataFrame, by: list[str], order: list[str], value: str, reach: int = 3, tolerance: float = 0.04, least: int = 2) -> DataFrame:
    """Rows that at least `least` of their neighbours (`reach` on each side) agree with, or that have fewer neighbours."""
    w = Window.partitionBy(*by).orderBy(*order)
    around = F.concat(F.coalesce(F.collect_list(value).over(w.rowsBetween(-reach, -1)), F.array()), F.coalesce(F.collect_list(value).over(w.rowsBetween(1, reach)), F.array()))
    rows = df.withColumn("_near", around)
    agree = F.size(F.filter("_near", lambda v: F.abs(v - F.col(value)) <= tolerance * F.abs(F.col(value))))
    return rows.where((agree >= least) | (F.size("_near") < least)).drop("_near")


def keep_apart(values: Column, least: float) -> Column:
    """Of a sorted array, each value more than `least` after the last one kept."""
    kind = F.array().cast("array<double>")
    return F.aggregate(values, kind, lambda kept, v: F.when((F.size(kept) == 0) | (v - F.try_element_at(kept, F.lit(-1)) > least), F.concat(kept, F.array(v))).otherwise(kept))


def capitals(text: Column) -> Column:
    """Text in capitals, letter for letter. A letter whose capital is several letters gets its title form if that is one
    letter, and else stays (upper makes SS of ß, which has a capital of its own)."""
    one = lambda c: F.when(F.length(F.upper(c)) == 1, F.upper(c)).when(c == "ß", "ẞ").when(F.length(F.initcap(c)) == 1, F.initcap(c)).otherwise(c)
    letters = F.array_join(F.transform(F.split(text, ""), one), "")
    return F.when(F.length(F.upper(text)) == F.length(text), F.upper(text)).otherwise(letters)


def fold_labels(texts: Column, upper=F.upper) -> Column:
    """Texts in order joined by spaces, save those whose first five letters, put in capitals by `upper`, the label already holds."""
    each = F.transform(texts, lambda t: F.struct(t.alias("label"), upper(t).alias("known"), upper(F.left(t, F.lit(5))).alias("key")))

    def step(so_far, t):
        joined = F.struct(F.concat(so_far["label"], F.lit(" "), t["label"]).alias("label"), F.concat(so_far["known"], F.lit(" "), t["known"]).alias("known"))
        return F.when(so_far["label"].isNull(), F.struct(t["label"].alias("label"), t["known"].alias("known"))).when(F.contains(so_far["known"], t["key"]), so_far).otherwise(joined)

    none = F.lit(None).cast("string")
    return F.aggregate(each, F.struct(none.alias("label"), none.alias("known")), step, lambda found: F.coalesce(found["label"], F.lit("")))


def remap(points: DataFrame, knots: DataFrame, by: list[str], value: str, old: str = "old", new: str = "new", least: float = 0.5, into: str = "mapped") -> DataFrame:
    """Map values by the monotone piecewise-linear function through knots; rigid shifts outside.

    A knot is kept if its old place is more than `least` after the last kept one and its new place
    is after that one's new place. Keys without knots keep their values."""
    kind = F.array().cast("array<struct<old:double,new:double>>")

    def keep(kept, k):
        last = F.try_element_at(kept, F.lit(-1))
        ok = (F.size(kept) == 0) | ((k["old"] - last["old"] > least) & (k["new"] > last["new"]))
        return F.when(ok, F.concat(kept, F.array(k))).otherwise(kept)

    pairs = F.array_sort(F.collect_list(F.struct(F.col(old).cast("double").alias("old"), F.col(new).cast("double").alias("new"))))
    maps = knots.groupBy(*by).agg(F.aggregate(pairs, kind, keep).alias("_knots"))
    rows = points.join(maps, by, "left").withColumn("_v", F.col(value).cast("double"))
    below = F.size(F.filter("_knots", lambda k: k["old"] <= F.col("_v")))
    at = lambda i, f: F.try_element_at("_knots", i)[f]
    i, n = below, F.size("_knots")
    inside = at(i, "new") + (F.col("_v") - at(i, "old")) * (at(i + 1, "new") - at(i, "new")) / (at(i + 1, "old") - at(i, "old"))
    one = F.lit(1)
    mapped = (
        F.when(F.col("_knots").isNull() | (n == 0), F.col("_v"))
        .when(i == 0, F.col("_v") + F.try_element_at("_knots", one)["new"] - F.try_element_at("_knots", one)["old"])
        .when(i == n, F.col("_v") + F.try_element_at("_knots", F.lit(-1))["new"] - F.try_element_at("_knots", F.lit(-1))["old"])
        .otherwise(inside)
    )
    return rows.withColumn(into, mapped).drop("_knots", "_v")
