"""Scales from the texts of plans."""

from __future__ import annotations

import math

import pytest

from quoin.plans import refinement, scaling

TEXT = "plan_id int, idx int, text string, score double, cx double, cy double, axis string, turned boolean"
WALL = "plan_id int, id int, p0 array<double>, p1 array<double>, thickness double, kind string"
ROOM = "plan_id int, id int, polygon array<array<double>>, type string"
PLAN = "plan_id int, width int, height int, meters_per_px double, scale_source string"


def ring(x0, y0, x1, y1):
    return [[float(a), float(b)] for a, b in ((x0, y0), (x1, y0), (x1, y1), (x0, y1))]


def walls(plan):
    up = [(plan, i, [x, 0.0], [x, 400.0], 10.0, "wall") for i, x in enumerate((0.0, 200.0, 500.0))]
    return [*up, (plan, 3, [0.0, 0.0], [500.0, 0.0], 10.0, "wall"), (plan, 4, [0.0, 400.0], [500.0, 400.0], 10.0, "wall"), (plan, 5, [0.0, 0.0], [90.0, 70.0], 10.0, "wall"), (plan, 6, [201.0, 0.0], [201.0, 90.0], 10.0, "railing")]


def test_read_once(spark):
    rows = [
        (0, 0, "7200", 0.9, 10.0, 10.0, "x", False), (0, 1, "72 00", 0.9, 15.0, 10.0, "y", True), (0, 2, "7200", 0.9, 30.0, 10.0, "y", True), (0, 3, "7200", 0.9, 36.0, 10.0, "y", True),
        (0, 4, "7200", 0.9, 12.0, 10.0, "x", False), (0, 5, "dim", 0.5, 0.0, 0.0, "x", None), (0, 6, "dim", 0.9, 1.0, 0.0, "y", True), (1, 0, None, 0.9, 0.0, 0.0, "x", False), (1, 1, "7200", 0.9, 10.0, 10.0, "y", True),
    ]
    got = scaling.read_once(spark.createDataFrame(rows, TEXT))
    assert sorted((r.plan_id, r.idx) for r in got.collect()) == [(0, 0), (0, 2), (0, 4), (1, 0), (1, 1)]


def test_coordinates(spark):
    got = {r.axis: [(c.at, c.wall, c.side) for c in r.coords] for r in scaling.axis_coordinates(spark.createDataFrame([*walls(0), (0, 9, [201.0, 0.0], [201.0, 9.0], 10.0, "wall")], WALL)).collect()}
    assert got["x"] == [(x + 5 * s, i, s) for i, x in enumerate((0.0, 200.0, 500.0)) for s in (-1.0, 0.0, 1.0)]  # the wall one further on is within 1.5
    assert [c[0] for c in got["y"]] == [-5, 0, 5, 395, 400, 405]


def votes_of(spark, texts, rooms=(), plan_walls=None):
    return scaling.votes(spark.createDataFrame(texts, TEXT), spark.createDataFrame(list(rooms), ROOM), spark.createDataFrame(plan_walls or walls(0), WALL))


def test_votes(spark):
    rooms = [(0, 0, ring(5, 5, 195, 395), "Room"), (0, 1, ring(205, 5, 495, 395), "Room"), (0, 2, ring(600, 5, 900, 395), "Outdoor"), (0, 3, [[0.0, 0.0]], "Room")]
    texts = [(0, 0, "1.90 x 3.90", 1.0, 100.0, 100.0, "x", False), (0, 1, "10.5 m2", 1.0, 196.0, 90.0, "x", False), (0, 2, "2.00 m", 1.0, 100.0, 50.0, "x", False), (0, 3, "KEITTIO", 1.0, 9.0, 9.0, "x", False), (0, 4, None, 1.0, 9.0, 9.0, "x", False), (0, 5, "9 x 9", 1.0, 100.0, 100.0, "x", False)]
    got = votes_of(spark, texts, rooms).collect()
    by = {k: [r for r in got if r.kind == k] for k in ("pair", "area", "total_area", "length")}
    assert [(r.idx, r.weight, r.room, r.log_s) for r in by["pair"]] == [(0, 3.0, 0, pytest.approx(math.log(0.01)))]  # 9 x 9 fits no room
    assert [(r.idx, r.weight, r.room, r.explicit) for r in by["area"]] == [(1, 1.5, 0, 1)]  # the buffer holds its centre
    assert by["area"][0].log_s == pytest.approx(math.log(10.5 / (190 * 390)) / 2)
    assert by["total_area"][0].log_s == pytest.approx(math.log(10.5 / (190 * 390 + 290 * 390)) / 2) and by["total_area"][0].weight == 1
    spans = {(r.lo_wall, r.lo_side, r.hi_wall, r.hi_side): r for r in by["length"]}
    assert len(spans) == 3 * 6 and all(r.weight == pytest.approx(1 / math.sqrt(18)) for r in spans.values())
    assert spans[0, 1.0, 1, -1.0].log_s == pytest.approx(math.log(2.0 / 190))


def plans(spark, *rows):
    return spark.createDataFrame([r if len(r) == 5 else (*r, 0.02, "default") for r in rows], PLAN)


def test_single_lengths_give_a_scale(spark):
    """A plan without room sizes: three lengths that agree on one scale between inner faces."""
    texts = [(0, 0, "1.90 m", 1.0, 100.0, 50.0, "x", False), (0, 1, "2.90 m", 1.0, 350.0, 50.0, "x", False), (0, 2, "3.90 m", 1.0, 20.0, 200.0, "y", False)]
    estimates, said = scaling.estimate(plans(spark, (0, 500, 400)), votes_of(spark, texts))
    got = estimates.first()
    assert (got.reason, got.source, got.n_texts, got.n_independent) == ("accepted", "ocr", 3, 3) and got.scale == pytest.approx(0.01, rel=0.05)
    rows = {r.seq: r for r in said.collect()}
    assert [(rows[i].kind, rows[i].m) for i in range(3)] == [("length", 1.9), ("length", 2.9), ("length", 3.9)]
    table = spark.createDataFrame(walls(0), WALL)
    rooms, scales = spark.createDataFrame([], ROOM), estimates.select("plan_id", "scale")
    spans = refinement.terms(table, rooms, said, scales).where("family = 'span'").collect()
    assert len(spans) == 3 and all(r.text for r in spans)  # the votes are the solver's texts


def test_acceptance(spark):
    room = lambda p, w: (p, 0, ring(5, 5, 5 + w, 395), "Room")
    pair = lambda p, t, i=0, x=100.0: (p, i, t, 1.0, x, 100.0, "x", False)
    texts = [pair(0, "1.90 x 3.90"), pair(1, "1.90 x 3.90"), pair(2, "20 m2"), pair(3, "20 m2"), pair(3, "20 m2", 1, 130.0), pair(4, "20 m2"), pair(4, "20 m2", 1, 190.0), pair(6, "45 x 50")]
    rooms = [room(p, 190) for p in range(5)] + [(6, 0, ring(80, 80, 125, 130), "Room")]
    given = plans(spark, (0, 500, 400), (1, 500, 400, 0.02, "door_width"), (2, 500, 400), (3, 500, 400), (4, 500, 400), (5, 500, 400), (6, 500, 400))
    cast = votes_of(spark, texts, rooms, [w for p in range(7) for w in walls(p)])
    reasons = lambda rule: {r.plan_id: r.reason for r in scaling.estimate(given, cast, rule)[0].collect()}
    # a pair alone; doors say twice as much; one area; one area read twice; two areas apart; nothing; 500 metres
    assert reasons("v2") == {0: "accepted", 1: "gate", 2: "few", 3: "few", 4: "accepted", 5: "none", 6: "extent"}
    assert reasons("v1") == {0: "accepted", 1: "gate", 2: "accepted", 3: "accepted", 4: "accepted", 5: "none", 6: "extent"}
    kept = {r.plan_id: (r.scale, r.source) for r in scaling.estimate(given, cast)[0].collect()}
    assert kept[1] == (0.02, "door_width") and kept[5] == (0.02, "default")


def test_prior_decides(spark):
    """Two scales of like support: doors tell which."""
    texts = [(0, 0, "1.90 x 3.90", 1.0, 100.0, 100.0, "x", False), (0, 1, "4.00 x 8.00", 1.0, 110.0, 300.0, "x", False)]
    rooms = [(0, 0, ring(5, 5, 195, 395), "Room")]
    for door, text in ((0.0101, 0), (0.0208, 1)):
        estimates, said = scaling.estimate(plans(spark, (0, 500, 400, door, "door_width")), votes_of(spark, texts, rooms))
        assert [r.seq for r in said.collect()] == [text] and estimates.first().reason == "accepted"


def test_empty(spark):
    cast = votes_of(spark, [], [])
    assert cast.count() == 0
    assert scaling.estimate(plans(spark, (0, 5, 5)), cast)[0].first().reason == "none"
