"""The scale of a plan from the texts on it: votes of room sizes, areas and single lengths between walls.

A text is (plan_id, idx, text, score, cx, cy, axis, turned): its place in the list, how sure the reader was, its
centre, the way it runs (x, y) and whether it was read on the turned image. Each text votes for the scales that would make
its value true of what it stands in or between; the scale that most votes agree on wins, if it is accepted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quoin.functions import dimensions
from quoin.functions import geometry as g
from quoin.operators import density
from quoin.operators.graph import checkpointed
from quoin.plans.layouts import PLAN, _by_plan, oriented

SCORE, TWICE, APART, LEAST_SPAN, EACH_SIDE = 0.6, 12.0, 1.5, 10.0, 12
BANDWIDTH, GATE, EXTENT = 0.02, 0.25, (3.0, 300.0)


def bare(text: Column) -> Column:
    """A text without white space."""
    return F.regexp_replace(text, r"\s+", "")


def read_once(texts: DataFrame, score: float = SCORE, reach: float = TWICE) -> DataFrame:
    """Texts read surely enough, without those that the second pass (turned) read again: the same letters, nearer than
    `reach` to a text before them that is itself kept. Unsure texts are left out last, so they hide copies of theirs."""
    item = F.struct(F.coalesce("turned", F.lit(False)).alias("turned"), "idx", "cx", "cy")
    rows = texts.groupBy("plan_id", bare(F.coalesce("text", F.lit(""))).alias("_t")).agg(F.array_sort(F.collect_list(item)).alias("_all"))
    seen = lambda kept, t: F.exists(kept, lambda k: F.hypot(k["cx"] - t["cx"], k["cy"] - t["cy"]) < reach)
    kept = F.aggregate("_all", F.filter("_all", lambda t: F.lit(False)), lambda kept, t: F.when(t["turned"] & seen(kept, t), kept).otherwise(F.concat(kept, F.array(t))))
    once = rows.select("plan_id", F.explode(kept).alias("_k")).select("plan_id", "_k.idx")
    return texts.join(once, ["plan_id", "idx"], "left_semi").where(F.col("score") >= score)


def axis_coordinates(walls: DataFrame, apart: float = APART) -> DataFrame:
    """(plan_id, axis, coords): for each axis the places of centre lines and faces of the walls across it, in order, each more
    than `apart` after the one before: an array of (at, wall, side), side in half thicknesses from the centre."""
    rows = oriented(walls).where("kind = 'wall' and way <> 'd'").select("plan_id", F.when(F.col("way") == "v", "x").otherwise("y").alias("axis"), F.col("id").alias("wall"), "axis.centre", "thickness")
    rows = rows.withColumn("side", F.explode(F.array(F.lit(-1.0), F.lit(0.0), F.lit(1.0)))).withColumn("at", F.col("centre") + F.col("side") * F.col("thickness") / 2)
    every = F.array_sort(F.collect_list(F.struct("at", "wall", "side")))
    thin = lambda kept, c: F.when((F.size(kept) == 0) | (c["at"] - F.try_element_at(kept, F.lit(-1))["at"] > apart), F.concat(kept, F.array(c))).otherwise(kept)
    return rows.groupBy("plan_id", "axis").agg(every.alias("_all")).select("plan_id", "axis", F.aggregate("_all", F.filter("_all", lambda c: F.lit(False)), thin).alias("coords"))


def hosts(texts: DataFrame, rooms: DataFrame, buffer: float = 2.0) -> DataFrame:
    """(plan_id, idx, room): the first room that, grown by the buffer, holds a text's centre. Rooms are met by cells of a grid, as
    wide as a plan's widest room."""
    box = lambda i, f: f(F.transform("polygon", lambda p: p[i]))
    rows = rooms.where(F.size("polygon") >= 3).select("plan_id", F.col("id").alias("room"), "polygon", *(c.alias(n) for n, c in (("x0", box(0, F.array_min) - buffer), ("x1", box(0, F.array_max) + buffer), ("y0", box(1, F.array_min) - buffer), ("y1", box(1, F.array_max) + buffer))))
    size = rows.groupBy("plan_id").agg(F.max(F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))).alias("_s"))
    span = lambda a, b: F.sequence(F.floor(F.col(a) / F.col("_s")), F.floor(F.col(b) / F.col("_s")))
    laid = rows.join(size, "plan_id").withColumn("_i", F.explode(span("x0", "x1"))).withColumn("_j", F.explode(span("y0", "y1"))).drop("_s")
    asked = texts.select("plan_id", "idx", "cx", "cy").join(size, "plan_id").withColumns({"_i": F.floor(F.col("cx") / F.col("_s")), "_j": F.floor(F.col("cy") / F.col("_s"))})
    found = asked.join(laid, ["plan_id", "_i", "_j"]).where(F.col("cx").between(F.col("x0"), F.col("x1")) & F.col("cy").between(F.col("y0"), F.col("y1")) & g.within(F.array("cx", "cy"), F.col("polygon"), buffer))
    return found.groupBy("plan_id", "idx").agg(F.min("room").alias("room"))


#: What a vote says beside its scale, in the columns of `refinement.DIMENSION`.
_SAYS = {"m": "double", "lo_wall": "int", "lo_side": "double", "hi_wall": "int", "hi_side": "double", "room": "int", "a": "double", "b": "double", "area": "double"}


def votes(texts: DataFrame, rooms: DataFrame, walls: DataFrame) -> DataFrame:
    """(plan_id, idx, n, kind, log_s, weight, explicit, value, text, cx, cy and what the vote says).

    A pair in a room votes by both ways of laying its sides along the room's (weight 3, where the sides' scales agree
    to 0.15); an area by its room (1.5) and by all rooms that aren't outdoors (1); a length by every two coordinates of
    its axis around it, of the nearest dozen to each side, more than 10 apart (one over the root of their number)."""
    none = {c: F.lit(None).cast(t) for c, t in _SAYS.items()}
    read = texts.withColumn("_d", dimensions.parse(F.col("text"))).where("_d.kind is not null").select("plan_id", "idx", "text", "cx", "cy", "axis", "_d.kind", F.col("_d.a").alias("_a"), F.col("_d.b").alias("_b"), "_d.explicit")
    read = checkpointed(read)  # texts are parsed once for the four kinds of votes
    sized = rooms.where(F.size("polygon") >= 3).withColumn("_box", g.least_rectangle(F.col("polygon"))).select("plan_id", F.col("id").alias("room"), "_box.short", "_box.long", g.area(F.col("polygon")).alias("px"), "type")
    sized = checkpointed(sized)
    housed = checkpointed(read.where("kind <> 'length'").join(hosts(read, rooms), ["plan_id", "idx"], "left").join(sized, ["plan_id", "room"], "left"))

    def made(df: DataFrame, kind: str, n: Column, log_s: Column, weight: Column, **says: Column) -> DataFrame:
        extra = [says.get(c, v).cast(_SAYS[c]).alias(c) for c, v in none.items()]
        return df.select("plan_id", "idx", n.cast("int").alias("n"), F.lit(kind).alias("kind"), log_s.alias("log_s"), weight.cast("double").alias("weight"), F.coalesce("explicit", F.lit(0)).alias("explicit"), F.col("_a").alias("value"), "text", "cx", "cy", *extra)

    ways = F.posexplode(F.array(F.struct((F.col("_a") / F.col("short")).alias("s"), (F.col("_b") / F.col("long")).alias("l")), F.struct((F.col("_b") / F.col("short")).alias("s"), (F.col("_a") / F.col("long")).alias("l")))).alias("way", "w")
    pairs = housed.where("kind = 'pair' and short > 0").select("*", ways).where(F.abs(F.log(F.col("w.s") / F.col("w.l"))) < 0.15)
    out = made(pairs, "pair", F.col("way"), F.log((F.col("w.s") + F.col("w.l")) / 2), F.lit(3.0), room=F.col("room"), a=F.col("_a"), b=F.col("_b"))
    areas = housed.where("kind = 'area'")
    out = out.unionByName(made(areas.where("px > 0"), "area", F.lit(0), F.log(F.col("_a") / F.col("px")) / 2, F.lit(1.5), room=F.col("room"), area=F.col("_a")))
    whole = sized.where("type is null or type <> 'Outdoor'").groupBy("plan_id").agg(F.sum("px").alias("_all"))
    out = out.unionByName(made(areas.join(whole, "plan_id").where("_all > 0"), "total_area", F.lit(1), F.log(F.col("_a") / F.col("_all")) / 2, F.lit(1.0), area=F.col("_a")))
    at = F.when(F.col("axis") == "x", F.col("cx")).otherwise(F.col("cy"))
    lengths = read.where("kind = 'length'").withColumn("_at", at).join(axis_coordinates(walls), ["plan_id", "axis"])
    below, above = F.filter("coords", lambda c: c["at"] < F.col("_at")), F.filter("coords", lambda c: c["at"] > F.col("_at"))
    lengths = lengths.withColumns({"_lo": F.reverse(F.slice(F.reverse(below), 1, EACH_SIDE)), "_hi": F.slice(above, 1, EACH_SIDE)})
    spans = F.filter(F.flatten(F.transform("_lo", lambda a: F.transform("_hi", lambda b: F.struct(a.alias("lo"), b.alias("hi"))))), lambda s: s["hi"]["at"] - s["lo"]["at"] > LEAST_SPAN)
    lengths = lengths.withColumn("_spans", spans).withColumn("_n", F.size("_spans")).select("*", F.posexplode("_spans").alias("pos", "s"))
    return checkpointed(out.unionByName(
        made(lengths, "length", F.col("pos"), F.log(F.col("_a") / (F.col("s.hi.at") - F.col("s.lo.at"))), 1 / F.sqrt("_n"), m=F.col("_a"), lo_wall=F.col("s.lo.wall"), lo_side=F.col("s.lo.side"), hi_wall=F.col("s.hi.wall"), hi_side=F.col("s.hi.side"))
    ))


def agreed(cast: DataFrame, priors: DataFrame | None = None, bandwidth: float = BANDWIDTH) -> DataFrame:
    """(plan_id, mode, and the votes that agree with it): one a text, the nearest (then the first). priors: plan_id, prior."""
    rows = cast.withColumn("prior", F.lit(None).cast("double")) if priors is None else cast.join(priors.select("plan_id", F.col("prior").cast("double").alias("prior")), "plan_id", "left")
    mode = density.kde_mode(rows, PLAN, "log_s", "weight", "idx", bandwidth, prior="prior").select("plan_id", "mode")
    near = cast.join(mode, "plan_id").withColumn("_off", F.round(F.abs(F.col("log_s") - F.col("mode")), 12)).where(F.col("_off") < 2 * bandwidth)
    rank = {"pair": 0, "area": 1, "total_area": 2, "length": 3}
    order = F.create_map(*[F.lit(x) for kv in rank.items() for x in kv])[F.col("kind")]
    return near.withColumn("_r", F.row_number().over(_by_plan("idx").orderBy("_off", order, "n"))).where("_r = 1").drop("_r", "_off")


def estimate(plans: DataFrame, cast: DataFrame, rule: str = "v2", gate: float = GATE) -> tuple[DataFrame, DataFrame]:
    """(estimates, dimensions). plans: plan_id, width, height, meters_per_px, scale_source.

    Estimates: plan_id, scale, source, reason, support, n_texts, n_independent. The votes' scale is taken where two
    independent texts agree (one value twice within 60 px is one) or a pair decides alone; under rule v1 two texts, or one
    pair or area with a unit; v3 is v2 without votes for the total area. It must lie within `gate` (log) of a scale
    that doors gave, and make the plan 3 to 300 metres wide. Else the plan's own scale stays, and the reason says why:
    none, few, gate or extent. Dimensions: the agreeing votes of plans whose scale was taken, for `refinement`."""
    if rule == "v3":
        cast = cast.where("kind <> 'total_area'")
    doors = plans.select("plan_id", F.when(F.col("scale_source") == "door_width", F.col("meters_per_px")).alias("prior"))
    near = checkpointed(agreed(cast, doors))
    alone = density.independent(near.select("plan_id", F.concat_ws(":", F.when(F.col("kind") == "total_area", "area").otherwise(F.col("kind")), F.round("value", 2).cast("string")).alias("_key"), "idx", "cx", "cy"), ["plan_id", "_key"], ["idx"], "cx", "cy")
    counted = alone.groupBy("plan_id").agg(F.count("*").alias("n_independent"))
    strong = (F.col("kind") == "pair") | (F.col("kind").isin("area", "total_area") & (F.col("explicit") > 0))
    told = near.groupBy("plan_id").agg(F.exp(F.sum(F.col("weight") * F.col("log_s")) / F.sum("weight")).alias("voted"), F.sum("weight").alias("support"), F.count("*").alias("n_texts"), F.bool_or(F.col("kind") == "pair").alias("_pair"), F.bool_or(strong).alias("_strong"))
    rows = plans.join(doors, "plan_id").join(told, "plan_id", "left").join(counted, "plan_id", "left")
    enough = (F.col("n_texts") >= 2) | (F.col("_strong") & (F.col("support") >= 1)) if rule == "v1" else (F.col("n_independent") >= 2) | F.col("_pair")
    extent = F.greatest("width", "height") * F.col("voted")
    reason = (
        F.when(F.col("voted").isNull(), "none").when(~enough, "few")
        .when(F.abs(F.log(F.col("voted") / F.col("prior"))) > gate, "gate").when(~extent.between(*EXTENT), "extent").otherwise("accepted")
    )
    rows = rows.withColumn("reason", reason)
    taken = F.col("reason") == "accepted"
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    estimates = rows.select("plan_id", F.when(taken, F.col("voted")).otherwise(F.col("meters_per_px")).alias("scale"), F.when(taken, "ocr").otherwise(F.col("scale_source")).alias("source"), "reason", F.coalesce("support", F.lit(0.0)).alias("support"), zero("n_texts"), zero("n_independent"))
    said = near.join(rows.where(taken).select("plan_id"), "plan_id", "left_semi").select("plan_id", F.col("idx").cast("int").alias("seq"), "kind", "text", *_SAYS)
    return estimates, said
