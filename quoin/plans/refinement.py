"""Walls, thicknesses and the scale of plans, moved to agree with what is written on them.

Each level or upright wall has a centre, two ends and a thickness, and each plan the logarithm of its
scale. Soft terms hold them: the places where they were found, ends that touch another wall, walls in one
line, walls of one thickness, and lengths, sides and areas in metres. Terms are rows, made by joins
of a plan's entities; their residuals, in units of sigma, are weighed by Huber's loss.

The solution is a bounded loop over all plans at once. A round evaluates every term at its plan's
values, sums the normal equations by (plan, row, column), and lets a small kernel solve each plan's system and
propose its next values; plans that have settled leave the loop. What the driver keeps is how many are left.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quoin.functions import geometry as g
from quoin.operators import sequence
from quoin.operators.graph import checkpointed
from quoin.plans.layouts import _by_plan, oriented

FAMILIES = ("data", "junction", "align", "thickness", "scale", "span", "room", "area", "total_area")
CENTRE, LO, HI, THICKNESS = range(4)
TOUCH, FACE, ROUNDS, CLOSE = 1.5, 4.0, 40, 1e-10
#: A table of dimension texts: kind is length (between two faces of walls; a side is -1, 0 or 1 half thicknesses from the
#: centre), pair (a room's two sides), area (a room's) or total_area.
DIMENSION = "plan_id, seq, kind, text, m double, lo_wall int, lo_side double, hi_wall int, hi_side double, room int, a double, b double, area double"


@dataclass
class Refined:
    """Tables like those given, and the reports: by_family (plan_id, family, n, rms_before, rms_after), annotations
    (plan_id, family, seq, text, value, residual_before, residual_after, units, inconsistent) and plans (plan_id,
    scale, settled, rounds). Plans with fewer than two usable walls or without a scale are left as they are,
    and aren't in the reports."""

    walls: DataFrame
    rooms: DataFrame
    openings: DataFrame
    furniture: DataFrame
    by_family: DataFrame
    annotations: DataFrame
    plans: DataFrame


def model(walls: DataFrame) -> DataFrame:
    """(plan_id, wall, way, centre, lo, hi, thickness, slot): the walls that move, numbered within their plan by id."""
    rows = oriented(walls).where("kind = 'wall' and way <> 'd'")
    return rows.select("plan_id", F.col("id").alias("wall"), "way", "axis.centre", "axis.lo", "axis.hi", F.col("thickness").cast("double").alias("thickness"), (F.row_number().over(_by_plan().orderBy("id")) - 1).alias("slot"))


def _near(at: Column, width: Column | float, spread: bool = False) -> Column:
    """The bucket of a coordinate, or it and both neighbours: what is nearer than `width` shares one."""
    bucket = F.floor(at / width)
    return F.explode(F.array(bucket - 1, bucket, bucket + 1)) if spread else bucket


def junctions(walls: DataFrame, touch: float = TOUCH) -> DataFrame:
    """(plan_id, slot, field, other): ends nearer than `touch` to the centre line of a crossing wall that reaches there.
    `walls` is a model."""
    ends = walls.select("plan_id", "way", "slot", "centre", F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(c).alias("at")) for f, c in ((LO, "lo"), (HI, "hi"))])).alias("e"))
    ends = ends.select("plan_id", F.when(F.col("way") == "h", "v").otherwise("h").alias("way"), "slot", F.col("centre").alias("across"), "e.field", "e.at").withColumn("bucket", _near(F.col("at"), touch))
    lines = walls.select("plan_id", "way", F.col("slot").alias("other"), F.col("centre").alias("line"), (F.col("lo") - F.col("thickness")).alias("from"), (F.col("hi") + F.col("thickness")).alias("to"), _near(F.col("centre"), touch, True).alias("bucket"))
    found = ends.hint("merge").join(lines, ["plan_id", "way", "bucket"]).where((F.abs(F.col("at") - F.col("line")) < touch) & F.col("across").between(F.col("from"), F.col("to")))
    return found.select("plan_id", "slot", "field", "other")


def in_line(walls: DataFrame) -> DataFrame:
    """(plan_id, slot, other): parallel walls whose centres are apart, but by less than half the thinner. `walls` is a model."""
    wide = F.nullif(F.max("thickness").over(_by_plan()) / 2, F.lit(0.0))
    rows = walls.withColumn("wide", wide).where("wide is not null")
    a = rows.select("plan_id", "way", "slot", "centre", "thickness", _near(F.col("centre"), F.col("wide")).alias("bucket"))
    b = rows.select("plan_id", "way", F.col("slot").alias("other"), F.col("centre").alias("line"), F.col("thickness").alias("thick"), _near(F.col("centre"), F.col("wide"), True).alias("bucket"))
    gap = F.abs(F.col("centre") - F.col("line"))
    return a.hint("merge").join(b, ["plan_id", "way", "bucket"]).where("slot < other").where((gap < F.least("thickness", "thick") / 2) & (gap > 1e-6)).select("plan_id", "slot", "other")


def _boxes(rooms: DataFrame) -> DataFrame:
    of = lambda i, f: f(F.transform("polygon", lambda p: p[i]))
    return rooms.where(F.size("polygon") >= 3).select("plan_id", F.col("id").alias("room"), *(of(i, f).alias(n) for n, i, f in (("x0", 0, F.array_min), ("x1", 0, F.array_max), ("y0", 1, F.array_min), ("y1", 1, F.array_max))))


def room_faces(rooms: DataFrame, walls: DataFrame, reach: float = FACE) -> DataFrame:
    """(plan_id, room, side, slot, off): for each side (l, r, t, b) of a room's bounding box the wall whose inner face
    is nearest to it, nearer than `reach`, of those that pass the room's middle. The first wall on ties. `walls` is a model."""
    side = lambda name, way, off, face, a, b: F.struct(F.lit(name).alias("side"), F.lit(way).alias("way"), F.lit(off).alias("off"), F.col(face).alias("face"), ((F.col(a) + F.col(b)) / 2).alias("middle"))
    sides = F.explode(F.array(side("l", "v", 1.0, "x0", "y0", "y1"), side("r", "v", -1.0, "x1", "y0", "y1"), side("t", "h", 1.0, "y0", "x0", "x1"), side("b", "h", -1.0, "y1", "x0", "x1")))
    asked = _boxes(rooms).select("plan_id", "room", sides.alias("s")).select("plan_id", "room", "s.*").withColumn("bucket", _near(F.col("face"), reach))
    faces = walls.withColumn("off", F.explode(F.array(F.lit(1.0), F.lit(-1.0)))).withColumn("at", F.col("centre") + F.col("off") * F.col("thickness") / 2)
    faces = faces.select("plan_id", "way", "off", "slot", "lo", "hi", "at", _near(F.col("at"), reach, True).alias("bucket"))
    found = asked.hint("merge").join(faces, ["plan_id", "way", "off", "bucket"]).withColumn("d", F.abs(F.col("at") - F.col("face"))).where((F.col("d") < reach) & F.col("middle").between(F.col("lo"), F.col("hi")))
    return found.withColumn("_n", F.row_number().over(_by_plan("room", "side").orderBy("d", "slot"))).where("_n = 1").select("plan_id", "room", "side", "slot", "off")


def _term(df: DataFrame, family: str, entries: list[tuple[Column, Column | float]], target: Column, sigma: Column, metric: bool = False, note: bool = False, cluster: Column | None = None, members: tuple[Column, Column] | None = None) -> DataFrame:
    lit = lambda c: c if isinstance(c, Column) else F.lit(c)
    vars_, coefs = members or (F.array(*[v for v, _ in entries]), F.array(*[lit(c).cast("double") for _, c in entries]))
    told = lambda c, kind: (F.col(c) if note else F.lit(None)).cast(kind).alias(c)
    own = entries[0][0] if cluster is not None else F.lit(None)
    return df.select(
        "plan_id", F.lit(family).alias("family"), vars_.cast("array<int>").alias("vars"), coefs.alias("coefs"), lit(target).cast("double").alias("target"), lit(sigma).cast("double").alias("sigma"),
        F.lit(metric).alias("metric"), lit(cluster).cast("long").alias("cluster"), own.cast("int").alias("own"), told("seq", "long"), told("text", "string"), told("value", "double"),
    )


def _at(slot: str | Column, field) -> Column:
    return (F.col(slot) if isinstance(slot, str) else slot) * 4 + field


def _span(hi: str, hi_side: str, lo: str, lo_side: str) -> list[tuple[Column, Column | float]]:
    return [(_at(hi, CENTRE), 1.0), (_at(hi, THICKNESS), F.col(hi_side) / 2), (_at(lo, CENTRE), -1.0), (_at(lo, THICKNESS), -F.col(lo_side) / 2)]


def _metres(m: str = "value") -> Column:
    return 0.01 * F.col(m) + 0.02


def terms(walls: DataFrame, rooms: DataFrame, dimensions: DataFrame, scales: DataFrame, families=FAMILIES) -> DataFrame:
    """One row for each soft term: plan_id, family, vars and coefs (wall `slot`'s field f is variable 4 slot + f, the logarithm
    of the scale comes last), target, sigma, metric (the sum times the scale should be the target), and for
    terms from a dimension text seq, text and value. scales: plan_id, scale.

    Dimension texts that name a wall that doesn't move, a room without walls at its sides, or nothing that has an
    area, make no term. Plans with fewer than two walls that move, or without a positive scale, have no terms."""
    moving = model(walls)
    size = moving.groupBy("plan_id").agg(F.count("*").alias("n_walls")).where("n_walls >= 2").hint("merge").join(scales.where("scale > 0").select("plan_id", F.log("scale").alias("log_s")), "plan_id")
    typical = walls.groupBy("plan_id").agg(F.greatest(F.lit(1.0), 0.3 * F.median("thickness")).alias("sd"))
    moving = checkpointed(moving.hint("merge").join(size.select("plan_id", "n_walls"), "plan_id"))  # nine kinds of terms are made from it
    plan, last = size, F.col("n_walls") * 4

    found = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(c).alias("at"), (F.lit(2.0) if f == THICKNESS else F.col("sd")).alias("s")) for f, c in ((CENTRE, "centre"), (LO, "lo"), (HI, "hi"), (THICKNESS, "thickness"))]))
    data = moving.hint("merge").join(typical, "plan_id").select("plan_id", "slot", found.alias("d"))
    out = {"data": [_term(data, "data", [(_at("slot", F.col("d.field")), 1.0)], F.col("d.at"), F.col("d.s"))]}
    out["junction"] = [_term(junctions(moving), "junction", [(_at("slot", F.col("field")), 1.0), (_at("other", CENTRE), -1.0)], 0.0, 0.5)]
    out["align"] = [_term(in_line(moving), "align", [(_at("slot", CENTRE), 1.0), (_at("other", CENTRE), -1.0)], 0.0, 1.0)]

    alike = sequence.ratio_clusters(moving, ["plan_id"], "thickness", 1.3)
    members = alike.groupBy("plan_id", "cluster").agg(F.sort_array(F.collect_list("slot")).alias("slots")).where(F.size("slots") > 1)
    alike = alike.hint("merge").join(members, ["plan_id", "cluster"])
    shares = F.transform("slots", lambda s: F.when(s == F.col("slot"), 1.0).otherwise(0.0) - 1.0 / F.size("slots"))
    out["thickness"] = [_term(alike, "thickness", [(_at("slot", THICKNESS), 1.0)], 0.0, 3.0, cluster=F.col("cluster"), members=(F.transform("slots", lambda s: s * 4 + THICKNESS), shares))]
    out["scale"] = [_term(plan, "scale", [(last, 1.0)], F.col("log_s"), 0.15)]

    slots = lambda name: moving.select("plan_id", F.col("wall").alias(f"{name}_wall"), F.col("slot").alias(f"{name}_slot"))
    span = dimensions.where("kind = 'length'").withColumn("value", F.col("m")).hint("merge").join(slots("lo"), ["plan_id", "lo_wall"]).hint("merge").join(slots("hi"), ["plan_id", "hi_wall"])
    out["span"] = [_term(span, "span", _span("hi_slot", "hi_side", "lo_slot", "lo_side"), F.col("m"), _metres(), metric=True, note=True)]

    pairs = dimensions.where("kind = 'pair'").select("plan_id", "seq", "text", "room", "a", "b").hint("merge").join(_boxes(rooms), ["plan_id", "room"]).hint("merge").join(plan, "plan_id")
    s = F.exp("log_s")
    off = lambda m, lo, hi: F.abs(F.log(F.col(m) / ((F.col(hi) - F.col(lo)) * s)))
    straight = off("a", "x0", "x1") + off("b", "y0", "y1") <= off("b", "x0", "x1") + off("a", "y0", "y1")
    pairs = pairs.withColumn("mx", F.when(straight, F.col("a")).otherwise(F.col("b"))).withColumn("my", F.when(straight, F.col("b")).otherwise(F.col("a")))
    faces = room_faces(rooms, moving)
    face = lambda name, slot, o: faces.where(F.col("side") == name).select("plan_id", "room", F.col("slot").alias(slot), F.col("off").alias(o))
    out["room"] = []
    for lo, hi, m in (("l", "r", "mx"), ("t", "b", "my")):
        both = pairs.withColumn("value", F.col(m)).hint("merge").join(face(lo, "lo_slot", "lo_side"), ["plan_id", "room"]).hint("merge").join(face(hi, "hi_slot", "hi_side"), ["plan_id", "room"])
        out["room"].append(_term(both, "room", _span("hi_slot", "hi_side", "lo_slot", "lo_side"), F.col("value"), _metres(), metric=True, note=True))

    areas = rooms.select("plan_id", F.col("id").alias("room"), "type", F.when(F.size("polygon") >= 3, g.area(F.col("polygon"))).alias("px"))
    all_ = areas.where("type is null or type <> 'Outdoor'").groupBy("plan_id").agg(F.sum("px").alias("all_px"))
    asked = dimensions.where("kind in ('area', 'total_area')").withColumn("value", F.col("area")).withColumn("room", F.when(F.col("kind") == "area", F.col("room")))
    asked = asked.hint("merge").join(areas.select("plan_id", "room", "px", F.lit(True).alias("hosted")), ["plan_id", "room"], "left").hint("merge").join(all_, "plan_id", "left").hint("merge").join(plan, "plan_id")
    asked = asked.withColumn("px", F.when(F.col("hosted"), F.col("px")).otherwise(F.col("all_px"))).where("px > 0 and area > 0")
    for kind in ("area", "total_area"):
        out[kind] = [_term(asked.where(F.col("kind") == kind), kind, [(last, 2.0)], F.log(F.col("area") / F.col("px")), 0.03, note=True)]

    made = None
    for name in FAMILIES:
        for part in out[name] if name in families else []:
            made = part if made is None else made.unionByName(part)
    return made.hint("merge").join(plan.select("plan_id"), "plan_id", "left_semi")


def _residuals(rows: DataFrame, x: str = "x") -> DataFrame:
    """The terms with `px` (their sum), `s` (the scale, 1 for terms that aren't metric) and `r`, at their plan's values."""
    px = F.aggregate(F.zip_with("vars", "coefs", lambda v, c: F.element_at(x, v + 1) * c), F.lit(0.0), lambda a, b: a + b)
    rows = rows.withColumn("px", px).withColumn("s", F.when(F.col("metric"), F.exp(F.element_at(x, -1))).otherwise(1.0))
    return rows.withColumn("r", (F.col("px") * F.col("s") - F.col("target")) / F.col("sigma"))


def _normal_equations(rows: DataFrame) -> DataFrame:
    """(plan_id, i, j, v): sums over terms of squares under Huber's weights, of its slopes (j is -1) and of the loss (both are -1).

    A thickness term has its whole cluster as variables; the cluster's terms are summed as one, by what each adds to
    the differences from the mean, so that a cluster makes as many rows as it has pairs of walls."""
    rows = _residuals(rows)
    inner = F.abs("r") <= 1
    rows = rows.withColumn("h", F.when(inner, 1.0).otherwise(1 / F.abs("r"))).withColumn("d", F.when(inner, F.col("r")).otherwise(F.signum("r"))).withColumn("loss", F.when(inner, F.col("r") * F.col("r") / 2).otherwise(F.abs("r") - 0.5))
    cell = lambda i, j, v: F.struct(i.cast("int").alias("i"), j.cast("int").alias("j"), v.cast("double").alias("v"))
    none = F.lit(-1)
    single = rows.where("cluster is null")
    entries = F.zip_with("vars", "coefs", lambda v, c: F.struct(v.alias("v"), (c * F.col("s") / F.col("sigma")).alias("c")))
    own_scale = F.when(F.col("metric"), F.array(F.struct((F.size("x") - 1).alias("v"), (F.col("px") * F.col("s") / F.col("sigma")).alias("c")))).otherwise(F.array().cast("array<struct<v:int,c:double>>"))
    single = single.withColumn("e", F.concat(entries, own_scale))
    second = F.flatten(F.transform("e", lambda a: F.transform("e", lambda b: cell(a["v"], b["v"], F.col("h") * a["c"] * b["c"]))))
    first = F.transform("e", lambda a: cell(a["v"], none, a["c"] * F.col("d")))
    cells = single.select("plan_id", F.explode(F.concat(second, first, F.array(cell(none, none, F.col("loss"))))).alias("q"))

    groups = rows.where("cluster is not null").groupBy("plan_id", "cluster").agg(F.collect_list(F.struct("own", "h", "d")).alias("e"), F.sum("h").alias("hs"), F.sum("d").alias("ds"), F.sum("loss").alias("loss"), F.first("sigma").alias("sigma"))
    n, two = F.size("e"), F.col("sigma") * F.col("sigma")
    second = F.flatten(F.transform("e", lambda a: F.transform("e", lambda b: cell(a["own"], b["own"], (F.when(a["own"] == b["own"], a["h"]).otherwise(0.0) - (a["h"] + b["h"]) / n + F.col("hs") / n / n) / two))))
    first = F.transform("e", lambda a: cell(a["own"], none, (a["d"] - F.col("ds") / n) / F.col("sigma")))
    cells = cells.unionByName(groups.select("plan_id", F.explode(F.concat(second, first, F.array(cell(none, none, F.col("loss"))))).alias("q")))
    return cells.select("plan_id", "q.*").groupBy("plan_id", "i", "j").agg(F.sum("v").alias("v"))


def _propose(x, best, cost, damp, now, kept):
    """The next values of one plan: from those just tried if they cost less, else from the best with shorter steps.

    now, kept: (i, j, v) of the sums at `x` and at `best`. Returns x, best, cost, damp, kept, settled."""
    i, j, v = now
    loss = v[(i < 0)].sum()
    gain = cost - loss
    if gain > 0 or cost == np.inf:
        settled = cost < np.inf and gain <= CLOSE * (1 + loss)
        best, cost, damp, kept = x, loss, max(damp / 10, 1e-12), now
    else:
        damp *= 10
        settled = -gain <= CLOSE * (1 + loss) or damp > 1e10
    if not settled:
        i, j, v = kept
        size = len(best)
        square, slope = np.zeros((size, size)), np.zeros(size)
        at = (i >= 0) & (j >= 0)
        square[i[at], j[at]] = v[at]
        at = (i >= 0) & (j < 0)
        slope[i[at]] = v[at]
        scale = np.diag(square)
        step = np.linalg.solve(square + damp * np.diag(scale + 1e-6 * max(scale.max(), 1.0)), -slope)
        x = best + step
    return (best if settled else x), best, cost, damp, kept, settled


_STATE = "plan_id {kind}, start array<double>, x array<double>, best array<double>, cost double, damp double, ki array<int>, kj array<int>, kv array<double>, settled boolean, rounds int"


def _advance(frames):
    for frame in frames:
        out = []
        for row in frame.itertuples(index=False):
            if row.settled:
                out.append((row.plan_id, row.start, row.x, row.best, row.cost, row.damp, row.ki, row.kj, row.kv, True, row.rounds))
                continue
            arrays = lambda *names: tuple(np.asarray(getattr(row, n)) for n in names)  # noqa: B023, E731
            x, best, cost, damp, kept, settled = _propose(np.asarray(row.x), np.asarray(row.best), row.cost, row.damp, arrays("i", "j", "v"), arrays("ki", "kj", "kv"))
            out.append((row.plan_id, row.start, x, best, cost, damp, *kept, settled, row.rounds + 1))
        yield pd.DataFrame(out, columns=[part.split()[0] for part in _STATE.split(", ")])


def starts(soft: DataFrame, walls: DataFrame, scales: DataFrame) -> DataFrame:
    """(plan_id, start): the values before the first round, of each plan that has terms."""
    moving = model(walls).hint("merge").join(soft.select("plan_id").distinct(), "plan_id", "left_semi")
    flat = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("slot", F.array("centre", "lo", "hi", "thickness").alias("at")))), lambda w: w["at"]))
    return moving.groupBy("plan_id").agg(flat.alias("at")).hint("merge").join(scales, "plan_id").select("plan_id", F.concat("at", F.array(F.log("scale"))).alias("start"))


def solve(soft: DataFrame, walls: DataFrame, scales: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(plan_id, start, x, settled, rounds): the values that cost least, of each plan that has terms; `soft` is a table of terms."""
    start = starts(soft, walls, scales)
    kind = start.schema["plan_id"].dataType.simpleString()
    none = lambda t: F.array().cast(f"array<{t}>")
    state = start.select("plan_id", "start", F.col("start").alias("x"), F.col("start").alias("best"), F.lit(float("inf")).alias("cost"), F.lit(1e-6).alias("damp"), none("int").alias("ki"), none("int").alias("kj"), none("double").alias("kv"), F.lit(False).alias("settled"), F.lit(0).alias("rounds"))
    state = checkpointed(state)
    for _ in range(rounds):
        sums = _normal_equations(soft.hint("merge").join(state.where("not settled").select("plan_id", "x"), "plan_id")).groupBy("plan_id").agg(F.collect_list(F.struct("i", "j", "v")).alias("q"))
        tried = state.hint("merge").join(sums.select("plan_id", "q.i", "q.j", "q.v"), "plan_id", "left")
        state = checkpointed(tried.mapInPandas(_advance, _STATE.format(kind=kind)))
        if state.where("not settled").isEmpty():
            break
    return checkpointed(state.select("plan_id", "start", F.col("best").alias("x"), "settled", "rounds"))


def report(soft: DataFrame, solved: DataFrame) -> tuple[DataFrame, DataFrame]:
    """by_family and annotations of `Refined`. Residuals of lengths and sides are in metres, others in units of sigma."""
    rows = soft.hint("merge").join(solved.select("plan_id", "start", "x"), "plan_id")
    rows = _residuals(_residuals(rows, "start").withColumn("before", F.col("r")))
    root = lambda c: F.sqrt(F.avg(F.col(c) * F.col(c)))
    by_family = rows.groupBy("plan_id", "family").agg(F.count("*").alias("n"), root("before").alias("rms_before"), root("r").alias("rms_after"))
    length = F.col("family").isin("span", "room")
    unit = F.when(length, F.col("sigma")).otherwise(1.0)
    told = rows.where("text is not null").select(
        "plan_id", "family", "seq", "text", "value", (F.col("before") * unit).alias("residual_before"), (F.col("r") * unit).alias("residual_after"),
        F.when(length, "m").otherwise("sigma").alias("units"), (F.abs("r") > 3).alias("inconsistent"),
    )
    return by_family, told


def _knots(moving: DataFrame, solved: DataFrame) -> DataFrame:
    """(plan_id, axis, old, new): centres, both faces and ends of the walls that moved."""
    at = lambda f: F.element_at("x", _at("slot", f) + 1)
    rows = moving.hint("merge").join(solved.select("plan_id", "x"), "plan_id").select("*", at(CENTRE).alias("c1"), at(LO).alias("l1"), at(HI).alias("h1"), at(THICKNESS).alias("t1"))
    across, along = F.when(F.col("way") == "h", "y").otherwise("x"), F.when(F.col("way") == "h", "x").otherwise("y")
    face = lambda k: F.struct(across.alias("axis"), (F.col("centre") + k * F.col("thickness") / 2).alias("old"), (F.col("c1") + k * F.col("t1") / 2).alias("new"))
    end = lambda a, b: F.struct(along.alias("axis"), F.col(a).alias("old"), F.col(b).alias("new"))
    return rows.select("plan_id", F.explode(F.array(face(-1), face(0), face(1), end("lo", "l1"), end("hi", "h1"))).alias("k")).select("plan_id", "k.*")


def _followed(shapes: DataFrame, knots: DataFrame) -> DataFrame:
    """(plan_id, of, id, moved): points of shapes (plan_id, of, id, points) after the maps of x and y."""
    points = shapes.select("plan_id", "of", "id", F.posexplode("points").alias("n", "p")).select("plan_id", "of", "id", "n", F.col("p")[0].alias("px"), F.col("p")[1].alias("py"))
    for axis in ("x", "y"):
        points = sequence.remap(points, knots.where(F.col("axis") == axis), ["plan_id"], f"p{axis}", into=f"n{axis}")
    return points.groupBy("plan_id", "of", "id").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", F.array("nx", "ny").alias("p")))), lambda s: s["p"]).alias("moved"))


def refine(walls: DataFrame, rooms: DataFrame, openings: DataFrame, furniture: DataFrame, dimensions: DataFrame, scales: DataFrame, families=FAMILIES, rounds: int = ROUNDS) -> Refined:
    """Solve all plans, then move rooms, openings, furniture and the walls that have no axis of their own along with the
    walls, by a monotone map of each axis. walls, rooms, openings and furniture are entity tables with plan_id; dimensions has
    the columns of DIMENSION; scales: plan_id, scale."""
    soft = checkpointed(terms(walls, rooms, dimensions, scales, families))
    solved = solve(soft, walls, scales, rounds)
    moving = checkpointed(model(walls))
    ends = lambda df, of: df.select("plan_id", F.lit(of).alias("of"), "id", F.array("p0", "p1").alias("points"))
    ring = lambda df, of: df.select("plan_id", F.lit(of).alias("of"), "id", F.col("polygon").alias("points"))
    others = walls.hint("merge").join(moving.select("plan_id", F.col("wall").alias("id")), ["plan_id", "id"], "left_anti")
    shapes = ends(others, "wall").unionByName(ring(rooms, "room")).unionByName(ends(openings, "opening")).unionByName(ring(furniture, "furniture"))
    moved = checkpointed(_followed(shapes, _knots(moving, solved)))
    of = lambda name: moved.where(F.col("of") == name).drop("of")

    x = lambda f: F.element_at("x", _at("slot", f) + 1)
    across, lo, hi = x(CENTRE), x(LO), x(HI)
    new = moving.hint("merge").join(solved.select("plan_id", "x"), "plan_id")
    upright = F.col("way") == "v"
    new = new.select("plan_id", F.col("wall").alias("id"), F.when(upright, F.array(across, lo)).otherwise(F.array(lo, across)).alias("_a"), F.when(upright, F.array(across, hi)).otherwise(F.array(hi, across)).alias("_b"), x(THICKNESS).alias("_t"))
    back = walls.hint("merge").join(new, ["plan_id", "id"], "left").hint("merge").join(of("wall"), ["plan_id", "id"], "left")
    back = back.withColumns({"p0": F.coalesce("_a", F.col("moved")[0], "p0"), "p1": F.coalesce("_b", F.col("moved")[1], "p1"), "thickness": F.coalesce("_t", "thickness")}).select(*walls.columns)
    ringed = lambda df, name: df.hint("merge").join(of(name), ["plan_id", "id"], "left").withColumn("polygon", F.coalesce("moved", "polygon")).select(*df.columns)
    host = back.select("plan_id", F.col("id").alias("wall_id"), F.col("thickness").alias("_t"))
    opened = openings.hint("merge").join(of("opening"), ["plan_id", "id"], "left").hint("merge").join(host, ["plan_id", "wall_id"], "left").hint("merge").join(solved.select("plan_id", F.lit(True).alias("_moved")), "plan_id", "left")
    opened = opened.withColumns({"p0": F.coalesce(F.col("moved")[0], "p0"), "p1": F.coalesce(F.col("moved")[1], "p1"), "thickness": F.when(F.col("_moved"), F.coalesce("_t", "thickness")).otherwise(F.col("thickness"))}).select(*openings.columns)
    plans = solved.select("plan_id", F.exp(F.element_at("x", -1)).alias("scale"), "settled", "rounds")
    by_family, annotations = report(soft, solved)
    return Refined(back, ringed(rooms, "room"), opened, ringed(furniture, "furniture"), by_family, annotations, plans)
