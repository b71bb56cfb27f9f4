"""Scores of predicted layouts against true ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quoin.functions import geometry as g
from quoin.operators import cells, matching, reports

KEY = ["plan_id"]


def room_cells(rooms: DataFrame) -> DataFrame:
    """Row runs (plan_id, id, y, lo, hi) of room polygons."""
    return cells.polygon_runs(rooms.select("plan_id", "id", "polygon"), ["plan_id", "id"], "polygon")


#: Types of rooms; any other counts as the last one.
ROOM_TYPES = ["Outdoor", "Kitchen", "Living Room", "Bed Room", "Bath", "Entry", "Storage", "Garage", "Undefined"]


def class_runs(rooms: DataFrame) -> DataFrame:
    """Row runs (plan_id, y, lo, hi, type) of the types of rooms (plan_id, id, polygon, type), smaller rooms over
    larger ones, of equal areas the later over the earlier."""
    kind = F.when(F.col("type").isin(ROOM_TYPES), F.col("type")).otherwise(ROOM_TYPES[-1])
    told = rooms.select("plan_id", "id", kind.alias("type"), (-F.abs(g.area(F.col("polygon")))).alias("_size"))
    runs = room_cells(rooms).join(told, ["plan_id", "id"])
    return cells.paint_runs(runs, ["plan_id", "y"], "type", ["_size", "id"])


def class_iou(predicted: DataFrame, true: DataFrame) -> DataFrame:
    """(plan_id, class_miou): the mean overlap of the types' cells over the types present on either side."""
    sums = cells.run_iou(class_runs(predicted), class_runs(true), ["plan_id", "type", "y"])
    by_type = sums.groupBy("plan_id", "type").agg((F.sum("inter") / F.sum("either")).alias("iou"))
    return by_type.groupBy("plan_id").agg(F.avg("iou").alias("class_miou"))


def wall_cells(walls: DataFrame) -> DataFrame:
    """Row runs (plan_id, y, lo, hi) of walls: of their polygon without its holes, or else of the axis with
    square caps; walls without length have none."""
    has = F.size(F.coalesce("polygon", F.array().cast("array<array<double>>"))) >= 3
    quad = g.wall_quad(F.col("p0"), F.col("p1"), F.col("thickness"))
    outer = walls.where(has | (g.length(F.col("p0"), F.col("p1")) > 0)).select("plan_id", "id", F.when(has, F.col("polygon")).otherwise(quad).alias("polygon"))
    inner = walls.where(has).select("plan_id", "id", F.posexplode("holes").alias("hole", "polygon"))
    by = ["plan_id", "id", "y"]
    full = cells.polygon_runs(outer, by[:2], "polygon")
    holes = cells.polygon_runs(inner, ["plan_id", "id", "hole"], "polygon").drop("hole")
    return cells.subtract_runs(full, holes, by).drop("id")


def match_rooms(predicted: DataFrame, true: DataFrame) -> DataFrame:
    """(plan_id, p, t, iou) of the best one-to-one matching of rooms by the overlap of their cells."""
    a, b = room_cells(predicted), room_cells(true).select("plan_id", F.col("id").alias("t"), "y", F.col("lo").alias("lo2"), F.col("hi").alias("hi2"))
    size = lambda df, key: df.groupBy("plan_id", key).agg(F.sum(df.columns[-1]).alias("n"))
    na = size(a.select("plan_id", F.col("id").alias("p"), (F.col("hi") - F.col("lo")).alias("w")), "p").withColumnRenamed("n", "np")
    nb = size(b.select("plan_id", "t", (F.col("hi2") - F.col("lo2")).alias("w")), "t").withColumnRenamed("n", "nt")
    over = a.join(b, ["plan_id", "y"]).where((F.col("lo") < F.col("hi2")) & (F.col("lo2") < F.col("hi")))
    inter = over.groupBy("plan_id", F.col("id").alias("p"), "t").agg(F.sum(F.least("hi", "hi2") - F.greatest("lo", "lo2")).alias("i"))
    iou = inter.join(na, ["plan_id", "p"]).join(nb, ["plan_id", "t"]).select("plan_id", "p", "t", (F.col("i") / (F.col("np") + F.col("nt") - F.col("i"))).alias("iou"))
    return matching.assign(iou, KEY, "p", "t", "iou", largest=True)


def match_openings(predicted: DataFrame, true: DataFrame, kind: str, least: float = 15.0) -> DataFrame:
    """(plan_id, tp) of openings of a kind: matched by least distance of centres; a match counts within
    the larger of `least` and half the true width."""
    mid = lambda a, b: F.array((F.col(a)[0] + F.col(b)[0]) / 2, (F.col(a)[1] + F.col(b)[1]) / 2)
    p = predicted.where(F.col("type") == kind).select("plan_id", F.col("id").alias("p"), mid("p0", "p1").alias("pc"))
    t = true.where(F.col("type") == kind).select("plan_id", F.col("id").alias("t"), mid("p0", "p1").alias("tc"), g.length(F.col("p0"), F.col("p1")).alias("w"))
    d = p.join(t, "plan_id").withColumn("d", g.length(F.col("pc"), F.col("tc")))
    found = matching.assign(d.select("plan_id", "p", "t", "d"), KEY, "p", "t", "d").join(t.select("plan_id", "t", "w"), ["plan_id", "t"])
    return found.groupBy("plan_id").agg(F.sum((F.col("d") <= F.greatest(F.lit(least), F.col("w") / 2)).cast("long")).alias("tp"))


def _ratio(top: Column, bottom: Column, empty: Column | float) -> Column:
    return F.when(bottom > 0, top / bottom).otherwise(empty)


def evaluate(predicted: DataFrame, true: DataFrame, at: float = 0.5) -> DataFrame:
    """One row of scores for each true plan. Both sides: layouts with plan_id and their own scale.

    A plan without a prediction scores as an empty layout, and a true plan without rooms has recall
    and mean overlap 0. True rooms that nothing is matched with count 0 in the mean overlap; rooms
    whose short side is under half a metre are left out of the errors of sides and areas."""
    from quoin.plans.layouts import rooms
    from quoin.sources.files import entities

    p, t = (rooms(x).where(F.size("polygon") >= 3) for x in (predicted, true))
    m = match_rooms(p, t)
    plans = true.select("plan_id")
    n = lambda df, name: df.groupBy("plan_id").agg(F.count("*").alias(name))
    out = plans.join(n(p, "n_pred"), "plan_id", "left").join(n(t, "n_true"), "plan_id", "left")
    good = m.groupBy("plan_id").agg(F.sum("iou").alias("_sum"), F.sum((F.col("iou") >= at).cast("long")).alias("_tp"))
    out = out.join(good, "plan_id", "left").na.fill(0, ["n_pred", "n_true", "_sum", "_tp"])
    pd, td = (df.select("plan_id", F.col("id").alias(k), F.col("area_m2").alias(f"{k}_area"), F.col("short_m").alias(f"{k}_short"), F.col("long_m").alias(f"{k}_long")) for df, k in ((p, "p"), (t, "t")))
    both = m.where(F.col("iou") >= at).join(pd, ["plan_id", "p"]).join(td, ["plan_id", "t"]).where("t_short >= 0.5")
    sides = both.select("plan_id", F.explode(F.array(*[F.struct(F.col(f"p_{s}").alias("a"), F.col(f"t_{s}").alias("b")) for s in ("short", "long")])).alias("s"))
    dim = sides.groupBy("plan_id").agg(F.avg(reports.percentage_error(F.col("s.a"), F.col("s.b"))).alias("dim_mape"))
    area = both.where("t_area > 0").groupBy("plan_id").agg(F.avg(reports.percentage_error(F.col("p_area"), F.col("t_area"))).alias("area_mape"))
    total = t.groupBy("plan_id").agg(F.sum("area_m2").alias("_ta")).join(p.groupBy("plan_id").agg(F.sum("area_m2").alias("_pa")), "plan_id", "left")
    total = total.where("_ta > 0").select("plan_id", reports.percentage_error(F.coalesce("_pa", F.lit(0.0)), F.col("_ta")).alias("total_area_ape"))
    scale = true.select("plan_id", F.col("meters_per_px").alias("_ts")).join(predicted.select("plan_id", F.col("meters_per_px").alias("_ps"), "scale_source"), "plan_id", "left")
    scale = scale.select("plan_id", "scale_source", reports.percentage_error(F.col("_ps"), F.col("_ts")).alias("scale_ape"))
    foot = cells.run_iou(*[room_cells(x).select("plan_id", "y", "lo", "hi") for x in (p, t)], ["plan_id", "y"]).groupBy("plan_id").agg((F.sum("inter") / F.sum("either")).alias("footprint_iou"))
    walls = [wall_cells(entities(x.select("plan_id", "walls"), "walls")) for x in (predicted, true)]
    walls = cells.run_iou(*walls, ["plan_id", "y"]).groupBy("plan_id").agg((F.sum("inter") / F.sum("either")).alias("wall_iou"))
    for extra in (dim, area, total, scale, foot, walls, class_iou(p, t)):
        out = out.join(extra, "plan_id", "left")
    po, to = (entities(x.select("plan_id", "openings"), "openings") for x in (predicted, true))
    for kind in ("door", "window"):
        counts = match_openings(po, to, kind)
        np_, nt = (n(x.where(F.col("type") == kind), c) for x, c in ((po, "_np"), (to, "_nt")))
        out = out.join(counts, "plan_id", "left").join(np_, "plan_id", "left").join(nt, "plan_id", "left").na.fill(0, ["tp", "_np", "_nt"])
        out = out.withColumn(f"{kind}_precision", _ratio(F.col("tp"), F.col("_np"), F.when(F.col("_nt") == 0, 1.0).otherwise(0.0))).withColumn(f"{kind}_recall", _ratio(F.col("tp"), F.col("_nt"), 1.0))
        out = out.withColumnsRenamed({"tp": f"{kind}_tp", "_np": f"{kind}_n_pred", "_nt": f"{kind}_n_true"})
    out = out.withColumn("room_iou", _ratio(F.col("_sum"), F.col("n_true"), 0.0)).withColumn("room_recall", _ratio(F.col("_tp"), F.col("n_true"), 0.0))
    out = out.withColumn("room_precision", _ratio(F.col("_tp"), F.col("n_pred"), 0.0)).withColumn("count_error", F.abs(F.col("n_pred") - F.col("n_true")))
    out = out.withColumn("class_miou", F.coalesce("class_miou", F.lit(0.0))).withColumn("wall_iou", F.coalesce("wall_iou", F.lit(1.0)))
    return out.withColumn("footprint_iou", F.coalesce("footprint_iou", F.when((F.col("n_pred") == 0) & (F.col("n_true") == 0), 1.0).otherwise(0.0))).drop("_sum", "_tp")


def score_by_hand(rooms: DataFrame, annotations: DataFrame) -> DataFrame:
    """(plan_id, found, dim_mape, area_mape) against measured rooms (plan_id, n, point, width_m, length_m):
    each annotation takes the first room that holds its point, and a room serves the first annotation only.
    Where annotations carry total_area_m2, also total_area_ape: of all rooms but those outdoors."""
    pairs = annotations.join(rooms.select("plan_id", "id", "polygon", "area_m2", "short_m", "long_m"), "plan_id").where(g.inside(F.col("point"), F.col("polygon")))
    from pyspark.sql import Window

    first = pairs.withColumn("_r", F.row_number().over(Window.partitionBy("plan_id", "n").orderBy("id"))).where("_r = 1")
    used = first.withColumn("_r", F.row_number().over(Window.partitionBy("plan_id", "id").orderBy("n"))).where("_r = 1")
    s, l = F.least("width_m", "length_m"), F.greatest("width_m", "length_m")  # noqa: E741
    err = reports.percentage_error
    rows = annotations.select("plan_id", "n").join(used.select("plan_id", "n", ((err(F.col("short_m"), s) + err(F.col("long_m"), l)) / 2).alias("dim"), err(F.col("area_m2"), s * l).alias("area")), ["plan_id", "n"], "left")
    scores = rows.groupBy("plan_id").agg(F.avg(F.col("dim").isNotNull().cast("double")).alias("found"), F.avg("dim").alias("dim_mape"), F.avg("area").alias("area_mape"))
    if "total_area_m2" not in annotations.columns:
        return scores
    measured = annotations.groupBy("plan_id").agg(F.max("total_area_m2").alias("_m"))
    built = rooms.where(F.coalesce("type", F.lit("")) != "Outdoor").groupBy("plan_id").agg(F.sum("area_m2").alias("_b"))
    total = measured.join(built, "plan_id", "left").where("_m > 0").select("plan_id", err(F.coalesce("_b", F.lit(0.0)), F.col("_m")).alias("total_area_ape"))
    return scores.join(total, "plan_id", "left")


def scale_only(measured: DataFrame, by: list[str] = KEY, agree: float = 0.15) -> DataFrame:
    """(by, scale, n): the median of the ratios of measured sides (a, b) to a room's extents (wx, wy), taken
    the first way round in which the two ratios agree to `agree` in logarithm; other rooms have no say."""
    way = lambda a, b: F.when(F.abs(F.log((F.col(a) / F.col("wx")) / (F.col(b) / F.col("wy")))) < agree, F.array(F.col(a) / F.col("wx"), F.col(b) / F.col("wy")))
    ratios = measured.where("wx > 0 and wy > 0 and a > 0 and b > 0").select(*by, F.explode(F.coalesce(way("a", "b"), way("b", "a"))).alias("r"))
    return ratios.groupBy(*by).agg(F.median("r").alias("scale"), F.count("*").alias("n"))
