"""Hand-computed cases of the layout operators. QUOIN_SAMPLES may name a folder of stored layouts
(<plan>/layout.json at any one depth, as a glob), which are then held against their own scales."""

from __future__ import annotations

import json
import math
import os

import pytest
from pyspark.sql import functions as F

from quoin import schema
from quoin.functions import dimensions
from quoin.functions import geometry as g
from quoin.operators import cells, density, fusion, matching, nearest, sequence
from quoin.plans import evaluation, layouts
from quoin.sources import files

SAMPLES = os.environ.get("QUOIN_SAMPLES", "")
WALL = f"plan_id string, id int, p0 array<double>, p1 array<double>, thickness double, kind string"
OPENING = "plan_id string, id int, type string, p0 array<double>, p1 array<double>, thickness double, wall_id int, offset double, confidence double"


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()


def ring(*points):
    return F.array(*[F.array(F.lit(float(x)), F.lit(float(y))) for x, y in points])


def walls(spark, *rows):
    return spark.createDataFrame([("a", i, [float(x0), float(y0)], [float(x1), float(y1)], float(t), kind) for i, (x0, y0, x1, y1, t, kind) in enumerate(rows)], WALL)


def openings(spark, *rows):
    return spark.createDataFrame([("a", i, kind, [float(x0), float(y0)], [float(x1), float(y1)], float(t), None, None, c) for i, (kind, x0, y0, x1, y1, t, c) in enumerate(rows)], OPENING)


def plan(shift: float, rooms: int) -> dict:
    """A row of rooms 200 by 150 px with a door in each wall between them, at 0.78 m for 78 px."""
    p = lambda x, y: [x + shift, y + shift]
    walls = [{"id": i, "p0": p(200 * i, 0), "p1": p(200 * i, 150), "thickness": 10, "polygon": None, "kind": "wall", "holes": None} for i in range(rooms + 1)]
    walls += [{"id": rooms + 1 + k, "p0": p(0, y), "p1": p(200 * rooms, y), "thickness": 10, "polygon": None, "kind": "wall", "holes": None} for k, y in enumerate((0, 150))]
    doors = [{"id": i, "type": "door", "p0": p(200 * i, 40), "p1": p(200 * i, 118), "thickness": 10, "wall_id": i, "offset": 79.0, "confidence": 0.9} for i in range(rooms)]
    made = [{"id": i, "polygon": [p(200 * i + 5, 5), p(200 * i + 195, 5), p(200 * i + 195, 145), p(200 * i + 5, 145)], "type": "Kitchen" if i else "Bath", "label": None, "dims_text": []} for i in range(rooms)]
    return {"width": 260 * rooms, "height": 300, "meters_per_px": 0.01, "scale_source": "door_width", "walls": walls, "openings": doors, "rooms": made, "furniture": [], "meta": {"method": "full", "levels": None}}


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    top = tmp_path_factory.mktemp("plans")
    for name, shift, n in (("a", 10.0, 2), ("b", 33.3, 3)):
        (top / name).mkdir()
        (top / name / "layout.json").write_text(json.dumps(plan(shift, n), indent=1))
    return files.read_layouts(spark, f"{top}/*/layout.json").cache()


def test_polygon_measures(spark):
    r = one(spark, a=g.area(ring((0, 0), (400, 0), (400, 300), (0, 300))), b=g.least_rectangle(ring((0, 0), (400, 0), (400, 300), (0, 300))), c=g.centroid(ring((0, 0), (4, 0), (4, 2), (0, 2))), d=g.area(ring((0, 0), (1, 1))), e=g.least_rectangle(ring((0, 0), (3, 3), (2, 4), (-1, 1))))
    assert r.a == 120000 and (r.b.short, r.b.long) == (300, 400) and r.c == [2, 1] and r.d == 0
    assert (round(r.e.short, 9), round(r.e.long, 9)) == (round(math.sqrt(2), 9), round(3 * math.sqrt(2), 9))


def test_inside_and_distance(spark):
    square = ring((0, 0), (10, 0), (10, 10), (0, 10))
    p = lambda x, y: F.array(F.lit(float(x)), F.lit(float(y)))
    r = one(spark, a=g.inside(p(5, 5), square), b=g.inside(p(11, 5), square), c=g.within(p(11, 5), square, 2.0), d=g.ring_distance(p(13, 14), square))
    assert (r.a, r.b, r.c, r.d) == (True, False, True, 5.0)


@pytest.mark.parametrize(("ends", "way"), [(((0, 0), (100, 1)), "h"), (((0, 0), (1, 100)), "v"), (((0, 0), (50, 50)), "d"), (((0, 0), (0, 0)), "h")])
def test_orientation(spark, ends, way):
    a, b = (F.array(F.lit(float(x)), F.lit(float(y))) for x, y in ends)
    assert one(spark, w=g.orientation(a, b)).w == way


def test_camera_round_trip(spark):
    lit = lambda *v: F.array(*[F.lit(float(x)) for x in v])
    r = one(spark, r=g.rotation(lit(0.1, -0.2, 0.3))).r
    rows = spark.createDataFrame([(r, [0.5, 0.1, 2.0], [500.0, 510.0, 320.0, 240.0], [0.3, -0.4, 1.5])], "r array<double>, t array<double>, k array<double>, x array<double>")
    c = {n: F.col(n) for n in rows.columns}
    seen = rows.select("*", g.project(c["k"], c["r"], c["t"], c["x"]).alias("p"), g.camera_centre(c["r"], c["t"]).alias("c")).first()
    pixel = spark.createDataFrame([(*seen[:3], seen.p.u, seen.p.v, seen.p.z, seen.c)], "r array<double>, t array<double>, k array<double>, u double, v double, z double, c array<double>")
    got = pixel.select(g.backproject(*[F.col(n) for n in ("k", "r", "t", "u", "v", "z")]).alias("x"), g.rotation_vector(F.col("r")).alias("v"), g.rotate(F.col("r"), F.col("c")).alias("c")).first()
    assert got.x == pytest.approx([0.3, -0.4, 1.5]) and got.v == pytest.approx([0.1, -0.2, 0.3]) and got.c == pytest.approx([-0.5, -0.1, -2.0])


def test_door_scale(spark):
    rows = spark.createDataFrame([("a", float(w)) for w in (80, 80, 82, 12, 4)], "plan_id string, w double")
    r = density.robust_scale(rows, ["plan_id"], "w").first()
    assert r.scale == pytest.approx(0.00975) and r.n == 3


def test_kde_mode(spark):
    votes = [("a", math.log(0.01) + d, w, i) for i, (d, w) in enumerate(((0, 3.0), (0.004, 1.5), (-0.006, 1.0), (0.5, 1.0), (-0.7, 0.5)))]
    r = density.kde_mode(spark.createDataFrame(votes, "k string, x double, w double, src int"), ["k"], "x", "w", "src").first()
    assert r.scale == pytest.approx(0.01) and r.support == 5.5


def test_host_and_suppression(spark):
    w = walls(spark, (0, 100, 500, 100, 20, "wall"), (0, 400, 500, 400, 20, "wall"))
    r = layouts.attach_openings(openings(spark, ("door", 210, 104, 290, 104, 20, 0.9)), w).first()
    assert (r.wall_id, r.offset, r.p0, r.p1, r.thickness) == (0, 250.0, [210, 100], [290, 100], 20)
    two = openings(spark, ("door", 60, 100, 140, 100, 20, 0.9), ("door", 100, 100, 180, 100, 20, 0.8), ("window", 300, 600, 360, 600, 20, 0.9))
    got = layouts.attach_openings(two, w).collect()
    assert [(r.id, r.offset, r.confidence) for r in got] == [(0, 100.0, 0.9)]


def test_islands(spark):
    rows = spark.createDataFrame([("a", x, 5.0, 4.0) for x in (*range(10), *range(11, 21))], "k string, x int, c double, t double")
    got = sorted((r["first"], r["last"], r.n) for r in sequence.runs(rows, ["k"], "x", "c", "t", 4).collect())
    assert got == [(0, 9, 10), (11, 20, 10)]


def test_tracks_holdout_circle(spark):
    seen = spark.createDataFrame([(1, 1), (1, 2), (1, 1), (2, 1), (2, 3), (3, 1)], "t int, img int")
    assert [r.t for r in matching.valid_tracks(seen, "t", "img").collect()] == [2]
    held = spark.range(20).where(sequence.holdout(F.col("id"), 8)).collect()
    assert [r.id for r in held] == [4, 12]
    angles = spark.createDataFrame([(math.radians(2),), (math.radians(88),)], "a double")
    assert angles.agg(density.circular_mean(F.col("a"), F.lit(1.0)).alias("m")).first().m == pytest.approx(0, abs=1e-9)


def test_fusion_and_roll_up(spark):
    s = spark.createDataFrame([("v", 0.5, 1.0), ("v", 0.0, 2.0)], "k string, s double, d double")
    assert fusion.fuse_samples(s, ["k"], "s", "d").first().tsdf == pytest.approx(1 / 3)
    r = fusion.roll_up(spark.createDataFrame([("x", 2.0, 0.5), ("x", 6.0, 1.0)], "k string, area double, observed double"), ["k"], ["observed"], "area").first()
    assert r.observed == 0.875


def test_decimate(spark):
    v = spark.createDataFrame([("m", i, x, y, 0.0) for i, (x, y) in enumerate(((0.0, 0.0), (0.05, 0.02), (1.0, 0.0), (0.0, 1.0)))], "k string, id int, x double, y double, z double")
    f = spark.createDataFrame([("m", 0, 2, 3), ("m", 1, 3, 2), ("m", 0, 1, 2)], "k string, v0 int, v1 int, v2 int")
    verts, faces = fusion.decimate(v, f, ["k"], 0.5)
    assert verts.count() == 3 and faces.count() == 1


@pytest.mark.parametrize(
    ("text", "kind", "a", "b"),
    [
        ("5.66 m x 3.83 m", "pair", 5.66, 3.83), ("3400 x 4100", "pair", 3.4, 4.1), ("3.4 x 4.1 m", "pair", 3.4, 4.1), ("12'6\" x 10'", "pair", 3.81, 3.048), ("12'6\"", "length", 3.81, None),
        ("360 cm", "length", 3.6, None), ("7200", "length", 7.2, None), ("12 000", "length", 12.0, None), ("12:000", "length", 12.0, None), ("250", None, None, None), ("1O5O", "length", 1.05, None),
        ("3,60", "length", 3.6, None), ("ASH 16.5", "area", 16.5, None), ("16.5", "area", 16.5, None), ("12.4 m2", "area", 12.4, None), ("APK4,5", None, None, None), ("(+0.590)", None, None, None), ("15/12", None, None, None), (None, None, None, None),
        ("3.5 x 12'", "pair", 3.5, 3.6576), ("ROOM 12", None, None, None), ("APK 45", None, None, None), ("16", None, None, None), ("ROOM 3.2 x 4.1 m", None, None, None), ("3.2 x 410 cm", "pair", 3.2, 4.1),
        ("", None, None, None), ("3400 x 900", "pair", 3.4, 0.9), ("60 x 40", None, None, None), ("61.25", None, None, None), ("12.4 sq. m total", "area", 12.4, None), ("4 X 5 × 6", None, None, None),
    ],
)
def test_dimension_texts(spark, text, kind, a, b):
    d = one(spark, d=dimensions.parse(F.lit(text).cast("string"))).d
    assert d.kind == kind
    assert (d.a, d.b) == (pytest.approx(a) if a is not None else None, pytest.approx(b) if b is not None else None)


@pytest.mark.parametrize(("text", "key"), [("2. kerros", 2), ("Ground floor", 0), ("Basement", -1), ("ullakko", 9), ("Upper floor", 5), ("Bedroom", None), ("Floor", None), ("lower ground floor", -0.5), ("main floor", 0), ("2 etage", 2), ("Ground", None), ("Upper", None), ("Kellari 1. krs", 1), ("3rd floor", 3), (None, None)])
def test_storeys(spark, text, key):
    assert one(spark, k=dimensions.storey(F.lit(text).cast("string"))).k == key


def test_runs_and_overlap(spark):
    runs = lambda *r: spark.createDataFrame([("k", *x) for x in r], "k string, lo int, hi int")
    a, b = runs((0, 10), (5, 12), (20, 30)), runs((8, 22))
    got = lambda df: sorted((r.lo, r.hi) for r in df.collect())
    assert got(cells.union_runs(a, ["k"])) == [(0, 12), (20, 30)]
    assert got(cells.intersect_runs(a, b, ["k"])) == [(8, 12), (20, 22)] and got(cells.subtract_runs(a, b, ["k"])) == [(0, 8), (22, 30)]
    assert cells.run_iou(a, b, ["k"]).first().iou == pytest.approx(6 / 30)
    assert cells.run_iou(a, a, ["k"]).first().iou == 1 and cells.run_iou(runs((0, 2)), runs((2, 4)), ["k"]).first().iou == 0


def test_polygon_cells_and_components(spark):
    p = spark.createDataFrame([(1, [[0.0, 0.0], [4.0, 0.0], [4.0, 3.0], [0.0, 3.0]])], "id int, polygon array<array<double>>")
    runs = cells.polygon_runs(p, ["id"], "polygon")
    assert sorted((r.y, r.lo, r.hi) for r in runs.collect()) == [(y, 0, 5) for y in range(4)]
    two = spark.createDataFrame([("m", 0, 0, 3), ("m", 1, 2, 5), ("m", 1, 8, 9), ("m", 2, 9, 11)], "k string, y int, lo int, hi int")
    assert sorted({(r.component, r.cells) for r in cells.components(two, ["k"]).collect()}, key=lambda x: x[1])[-1][1] == 6
    assert len({r.component for r in cells.components(two, ["k"]).collect()}) == 3 and len({r.component for r in cells.components(two, ["k"], True).collect()}) == 2


def test_assignment():
    import itertools

    import numpy as np

    rng = np.random.default_rng(4)
    for n, m in ((1, 1), (3, 3), (3, 5), (5, 3)):
        cost = rng.random((n, m)).round(2)
        best = min(sum(cost[i, c] for i, c in enumerate(p)) for p in itertools.permutations(range(m), n)) if n <= m else min(sum(cost[r, i] for i, r in enumerate(p)) for p in itertools.permutations(range(n), m))
        assert sum(cost[i, j] for i, j in matching.least_cost(cost)) == pytest.approx(best)


def test_topology(spark):
    w = walls(spark, (0, 0, 100, 0, 10, "wall"), (110, 1, 200, 1, 10, "wall"), (205, 4, 205, 150, 10, "wall"), (0, 8, 0, 150, 10, "wall"), (2, 300, 5, 300, 10, "wall"))
    typical = spark.createDataFrame([("a", 10.0, 60.0)], "plan_id string, t_typ double, door_px double")
    got = layouts.clean_walls(w, openings(spark), typical).collect()
    assert len(got) == 3 and sorted(r.id for r in got) == [0, 1, 2]
    level = next(r for r in got if abs(r.p0[1] - r.p1[1]) < 1)
    assert level.p0[0] == pytest.approx(0) and level.p1[0] == pytest.approx(205)
    upright = [r for r in got if r is not level]
    assert all(min(r.p0[1], r.p1[1]) == pytest.approx(level.p0[1]) for r in upright)


def test_merging_over_an_opening(spark):
    w = walls(spark, (0, 0, 100, 0, 10, "wall"), (170, 0, 300, 0, 10, "wall"))
    limits = spark.createDataFrame([("a", 96.0, 15.0)], "plan_id string, gap_max double, noise_gap double")
    assert layouts.merge_collinear(w, openings(spark), limits).count() == 2
    assert layouts.merge_collinear(w, openings(spark, ("door", 105, 0, 165, 0, 10, 0.9)), limits).count() == 1


def test_exterior_walls(spark):
    rooms = spark.createDataFrame([("a", 0, [[0.0, 0.0], [100.0, 0.0], [100.0, 100.0], [0.0, 100.0]]), ("a", 1, [[110.0, 0.0], [210.0, 0.0], [210.0, 100.0], [110.0, 100.0]])], "plan_id string, id int, polygon array<array<double>>")
    w = walls(spark, (105, 0, 105, 100, 10, "wall"), (-5, 0, -5, 100, 10, "wall"), (0, -5, 100, -5, 10, "wall"), (0, 500, 100, 500, 10, "wall"))
    assert {r.id: r.exterior for r in layouts.exterior_walls(w, rooms).collect()} == {0: False, 1: True, 2: True, 3: True}
    o = openings(spark).unionByName(spark.createDataFrame([("a", 0, "door", [0.0, 500.0], [10.0, 500.0], 10.0, 3, 5.0, 0.9), ("a", 1, "door", [0.0, -5.0], [10.0, -5.0], 10.0, 2, 5.0, 0.9)], OPENING))
    kept, doors = layouts.prune_unbounded(w, rooms, o)
    assert sorted(r.id for r in kept.collect()) == [0, 1, 2] and [r.id for r in doors.collect()] == [1]


def test_extrusion_volume(spark):
    w = walls(spark, (0, 0, 400, 0, 20, "wall"))
    o = spark.createDataFrame([("a", 0, "door", [60.0, 0.0], [140.0, 0.0], 20.0, 0, 100.0, 0.9), ("a", 1, "window", [250.0, 0.0], [350.0, 0.0], 20.0, 0, 300.0, 0.9)], OPENING)
    solids = layouts.boxes(w, o, spark.createDataFrame([("a", 0.01)], "plan_id string, scale double"))
    assert layouts.volume(solids).first().volume == pytest.approx(1.584)


def test_labels_and_votes(spark):
    rooms = spark.createDataFrame([("a", 0, [[0.0, 0.0], [400.0, 0.0], [400.0, 300.0], [0.0, 300.0]], None, None)], "plan_id string, id int, polygon array<array<double>>, label string, dims_text array<string>")
    texts = spark.createDataFrame([("a", 0, "LIVING", 100.0, 100.0), ("a", 1, "LIVING ROOM", 100.0, 120.0), ("a", 2, "ROOM", 150.0, 120.0), ("a", 3, "4.0 x 3.0 m", 200.0, 200.0), ("a", 4, "12 m2", 200.0, 250.0), ("a", 5, "KITCHEN", 900.0, 100.0)], "plan_id string, idx int, text string, cx double, cy double")
    named = layouts.label_rooms(rooms, texts)
    r = named.first()
    assert r.label == "LIVING ROOM" and r.dims_text == ["4.0 x 3.0 m", "12 m2"]
    votes = sorted((v.kind, round(math.exp(v.log_s), 9), v.weight) for v in layouts.scale_votes(named).collect())
    assert votes == [("area", 0.01, 1.5), ("pair", 0.01, 3.0)]
    plan = spark.createDataFrame([("a", 400, 300, 0.02, [])], f"plan_id string, width int, height int, meters_per_px double, openings array<{schema.OPENING}>")
    got = layouts.estimate_scale(plan, layouts.scale_votes(named)).first()
    assert got.scale == pytest.approx(0.01) and got.source == "ocr" and got.reason == "accepted"


def test_storey_order_and_assignment(spark):
    f = spark.createDataFrame([("a", 0, 5.0, 1.0, 1), ("a", 1, 9.0, 2.0, 0)], "plan_id string, fid int, area double, y double, key int")
    assert {r.fid: r["index"] for r in layouts.order_storeys(f).collect()} == {1: 0, 0: 1}
    prints = spark.createDataFrame([("a", 0, [[0.0, 0.0], [10.0, 0.0], [10.0, 10.0], [0.0, 10.0]]), ("a", 1, [[50.0, 0.0], [60.0, 0.0], [60.0, 10.0], [50.0, 10.0]])], "plan_id string, level int, polygon array<array<double>>")
    items = spark.createDataFrame([("a", 7, 5.0, 5.0), ("a", 8, 40.0, 5.0)], "plan_id string, id int, x double, y double")
    assert {r.id: r.level for r in layouts.assign_storeys(items, prints).collect()} == {7: 0, 8: 1}


def test_stored_layouts(stored):
    assert [files.entities(stored, k).count() for k in ("walls", "openings", "rooms")] == [11, 5, 5]
    assert {r.plan_id for r in stored.collect()} == {"a", "b"} and json.loads(stored.first().meta)["method"] == "full"
    got = stored.join(layouts.door_scale(stored), "plan_id").select(F.max(F.abs(F.col("scale") / F.col("meters_per_px") - 1)).alias("e"), F.count("*").alias("n")).first()
    assert got.n == 2 and got.e < 1e-12
    w, r, o = (files.entities(stored, k) for k in ("walls", "rooms", "openings"))
    kept, doors = layouts.prune_unbounded(w, r, o)
    assert kept.count() == w.count() and doors.count() == o.count()
    types = {t.type: (t.n, t.area_m2) for t in layouts.rooms_by_type(stored).collect()}
    assert types == {"Bath": (2, 5.32), "Kitchen": (3, 7.98)}


@pytest.mark.skipif(not SAMPLES, reason="no samples named")
def test_sample_scales(spark):
    rows = files.read_layouts(spark, SAMPLES).where("scale_source = 'door_width'").withColumn("plan_id", F.col("path"))
    off = rows.join(layouts.door_scale(rows), "plan_id").where(F.abs(F.col("scale") / F.col("meters_per_px") - 1) > 1e-12)
    assert rows.count() and off.count() == 0


def test_writing_and_reading_back(stored, spark, tmp_path):
    files.write_layouts(stored, f"{tmp_path}/out")
    back = spark.read.schema(schema.LAYOUT).json(f"{tmp_path}/out")
    assert back.count() == 2 and back.select(F.sum(F.size("walls"))).first()[0] == 11


def test_scaling_keeps_metric_values(stored):
    some = stored
    key = lambda df: {(r.plan_id, r.id): (r.area_m2, r.short_m) for r in layouts.rooms(df).collect()}
    a, b = key(some), key(layouts.scaled(some, 2.0))
    assert a.keys() == b.keys() and all(b[k] == pytest.approx(v) for k, v in a.items())


def test_perfect_prediction(stored):
    some = stored
    for r in evaluation.evaluate(some, some).collect():
        assert (r.room_iou, r.room_recall, r.room_precision, r.footprint_iou) == (1, 1, 1, 1)
        assert (r.class_miou, r.wall_iou) == (1, 1) and r.door_tp == r.door_n_pred == r.door_n_true
        assert (r.door_precision, r.door_recall, r.window_recall) == (1, 1, 1) and r.count_error == 0 and (r.dim_mape or 0) < 1e-9
    gone = evaluation.evaluate(some.limit(0), some).first()
    assert gone.room_iou == 0 and gone.room_recall == 0 and gone.footprint_iou == 0 and gone.class_miou == 0 and gone.wall_iou == 0


def box(x0, y0, x1, y1):
    return [[float(x), float(y)] for x, y in ((x0, y0), (x1, y0), (x1, y1), (x0, y1))]


def test_types_of_cells(spark):
    """A small room shows over a large one; a type that is not known counts as the last one."""
    shape = "plan_id string, id int, polygon array<array<double>>, type string"
    true = spark.createDataFrame([("a", 1, box(0, 0, 9, 9), "Bath"), ("a", 2, box(0, 0, 9, 4), "Kitchen")], shape)
    size = lambda df: {r.type: r.n for r in df.groupBy("type").agg(F.sum(F.col("hi") - F.col("lo")).alias("n")).collect()}
    assert size(evaluation.class_runs(true)) == {"Bath": 50, "Kitchen": 50}
    other = spark.createDataFrame([("a", 1, box(0, 0, 9, 9), "Bath"), ("a", 2, box(0, 0, 9, 4), "Attic")], shape)
    assert size(evaluation.class_runs(other)) == {"Bath": 50, "Undefined": 50}
    assert evaluation.class_iou(other, true).first().class_miou == pytest.approx(1 / 3)
    assert evaluation.class_iou(true.limit(0), true).first().class_miou == 0


def test_cells_of_walls(spark):
    shape = "plan_id string, id int, p0 array<double>, p1 array<double>, thickness double, polygon array<array<double>>, holes array<array<array<double>>>"
    walls = [("a", 1, [2.0, 2.0], [10.0, 2.0], 2.0, None, None), ("a", 2, [5.0, 5.0], [5.0, 5.0], 2.0, None, None), ("a", 3, [0.0, 0.0], [1.0, 0.0], 1.0, box(20, 0, 29, 9), [box(22, 2, 27, 7)])]
    told = {(r.lo, r.hi): r.n for r in evaluation.wall_cells(spark.createDataFrame(walls, shape)).groupBy("lo", "hi").agg(F.count("*").alias("n")).collect()}
    assert told == {(1, 12): 3, (20, 30): 4, (20, 22): 6, (28, 30): 6}


def test_total_area_by_hand(spark):
    rooms = spark.createDataFrame([("a", 1, box(0, 0, 10, 10), "Bath", 12.0, 3.0, 4.0), ("a", 2, box(20, 0, 30, 10), "Outdoor", 50.0, 5.0, 10.0)], "plan_id string, id int, polygon array<array<double>>, type string, area_m2 double, short_m double, long_m double")
    notes = spark.createDataFrame([("a", 0, [5.0, 5.0], 4.0, 3.0, 10.0), ("a", 1, [6.0, 5.0], 4.0, 3.0, 10.0)], "plan_id string, n int, point array<double>, width_m double, length_m double, total_area_m2 double")
    r = evaluation.score_by_hand(rooms, notes).first()
    assert (r.found, r.dim_mape, r.area_mape) == (0.5, 0, 0) and r.total_area_ape == pytest.approx(0.2)


def test_reports(spark, tmp_path):
    for config, plan_id, seconds in (("base", "a", 1.0), ("base", "b", 2.0), ("+more", "a", 4.0)):
        d = tmp_path / config / plan_id
        d.mkdir(parents=True)
        (d / "run_report.json").write_text(json.dumps({"fallbacks": [{"stage": "x", "msg": "y"}], "timings_s": {"detect": seconds, "export": 0.5}, "total_s": seconds + 0.5}))
    got = {(r.config, r.stage): (r.seconds, r.n) for r in files.stage_means(files.read_reports(spark, f"{tmp_path}/*/*/run_report.json")).collect()}
    assert got["base", "total"] == (2.0, 2) and got["base", "detect"] == (1.5, 2) and got["+more", "export"] == (0.5, 1)
    events = spark.createDataFrame([("r", 1, "b", "m1"), ("r", 0, "a", "m0")], "run_id string, seq int, stage string, msg string")
    timings = spark.createDataFrame([("r", "a", 1.25), ("r", "b", 0.5)], "run_id string, stage string, seconds double")
    r = files.run_report(events, timings).first()
    assert r.total_s == 1.75 and [f.msg for f in r.fallbacks] == ["m0", "m1"]


def test_drawings_and_uploads(spark, tmp_path):
    (tmp_path / "model.svg").write_text('<svg><g id="Wall" class="Wall External"><polygon points="0,0 10,0 10,2 0,2 "/></g><g id="Door"><polygon points="1,0 4,0 4,2 1,2"/></g><g class="Space Kitchen"><polygon points="0,0 5,0 5,5"/><text>KITCHEN</text><text>2.5 m</text></g><g class="Space Bath"><polygon points="1,1"/></g></svg>')
    rows = {r.kind: r for r in files.read_drawings(spark, str(tmp_path)).collect()}
    assert set(rows) == {"wall", "door", "space"} and rows["space"].type == "Kitchen" and rows["space"].texts == ["KITCHEN", "2.5 m"]
    ends = one(spark, e=files.opening_ends(ring((1, 0), (4, 0), (4, 2), (1, 2))), l=files.label_of(F.array(F.lit("2.5 m"), F.lit("KITCHEN"))))
    assert sorted(ends.e) == [[1, 1], [4, 1]] and ends.l == "KITCHEN"
    content = lambda h: F.unhex(F.lit(h))
    got = one(spark, a=files.upload_problem(F.lit("x.png"), content("89504E470D0A1A0A00000000")), b=files.upload_problem(F.lit("x.png"), content("FFD8FF00")), c=files.upload_problem(F.lit("x.exe"), content("00")), d=files.upload_problem(F.lit("v.mp4"), content("000000186674797069736F6D")))
    assert (got.a, got.b, got.c, got.d) == (None, "content", "extension", None)


def test_obj_lines(spark, tmp_path):
    v = spark.createDataFrame([("walls", i, float(i), 0.0, 0.0) for i in (1, 2, 3)], "object string, id int, x double, y double, z double")
    f = spark.createDataFrame([("walls", 1, 2, 3)], "object string, v0 int, v1 int, v2 int")
    files.write_obj(v, f, f"{tmp_path}/m.obj")
    lines = [r.value for r in spark.read.text(f"{tmp_path}/m.obj").collect()]
    assert sorted(lines) == sorted(["o walls", "v 1.000000 0.000000 0.000000", "v 2.000000 0.000000 0.000000", "v 3.000000 0.000000 0.000000", "f 1 2 3"])


def test_mutual_nearest(spark):
    a = spark.createDataFrame([(0, i, [float(i * 10), 0.0]) for i in range(8)], "k int, a int, va array<double>")
    b = spark.createDataFrame([(0, i, [float(i * 10) + 1, 0.0]) for i in range(8)], "k int, b int, vb array<double>")
    assert sorted((r.a, r.b) for r in nearest.mutual_nearest(a, b, ["k"], "a", "b", "va", "vb").collect()) == [(i, i) for i in range(8)]


def test_rooms_from_walls(spark):
    w = walls(spark, (20, 20, 220, 20, 8, "wall"), (20, 120, 220, 120, 8, "wall"), (20, 20, 20, 120, 8, "wall"), (220, 20, 220, 120, 8, "wall"), (120, 20, 120, 60, 8, "wall"), (120, 90, 120, 120, 8, "wall"))
    frames = spark.createDataFrame([("a", 260, 160, 8.0)], "plan_id string, width int, height int, t_typ double")
    assert layouts.rooms_from_walls(w, openings(spark), frames).count() == 1
    got = layouts.rooms_from_walls(w, openings(spark, ("door", 120, 58, 120, 92, 8, 0.9)), frames).orderBy("id").collect()
    assert len(got) == 2 and all(len(r.polygon) == 4 and r.holes == [] for r in got)
    assert [r.cells for r in got] == [91 * 91, 91 * 91]


def test_trace_with_hole(spark):
    rows = [("r", y, 0, 10) for y in (0, 1, 4, 5)] + [("r", y, a, b) for y in (2, 3) for a, b in ((0, 4), (6, 10))]
    r = cells.trace(spark.createDataFrame(rows, "k string, y int, lo int, hi int"), ["k"]).first()
    assert sorted(map(tuple, r.polygon)) == [(0, 0), (0, 6), (10, 0), (10, 6)] and sorted(map(tuple, r.holes[0])) == [(4, 2), (4, 4), (6, 2), (6, 4)]
    assert cells.simplify([(0, 0), (5, 0.4), (10, 0), (10, 10), (0, 10)], 1.0) == [(0, 0), (10, 0), (10, 10), (0, 10)]
