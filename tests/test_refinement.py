"""The wall solver against its own terms, worked out again in numpy."""

from __future__ import annotations

import random

import numpy as np
import pytest

from quoin.plans import refinement

WALL = "plan_id int, id int, p0 array<double>, p1 array<double>, thickness double, kind string"
ROOM = "plan_id int, id int, polygon array<array<double>>, type string"
OPENING = "plan_id int, id int, p0 array<double>, p1 array<double>, thickness double, wall_id int"
TEXT = "plan_id int, seq int, kind string, text string, m double, lo_wall int, lo_side double, hi_wall int, hi_side double, room int, a double, b double, area double"


def plans():
    rng = random.Random(1)
    walls, rooms, texts, openings = [], [], [], []
    for p in range(3):
        shake = lambda: rng.uniform(-0.7, 0.7)
        xs, ys = ([s + 130 * i + shake() for i in range(3)] for s in (60, 50))
        for i, x in enumerate(xs):
            walls.append((p, i, [x, ys[0] + shake()], [x, ys[2] + shake()], 8 + shake(), "wall"))
        for i, y in enumerate(ys):
            walls.append((p, 3 + i, [xs[0] + shake(), y], [xs[2] + shake(), y], 13 + shake(), "wall"))
        walls += [(p, 6, [xs[0], ys[0]], [xs[1], ys[1]], 6.0, "wall"), (p, 7, [xs[1], ys[0]], [xs[1], ys[1]], 2.0, "railing"), (p, 8, [xs[1] + 1, ys[2]], [xs[1] + 1, ys[2] + 90], 8.0, "wall")]
        for i in range(2):
            x0, x1, y0, y1 = xs[i] + 4, xs[i + 1] - 4, ys[0] + 6, ys[1] - 6
            rooms.append((p, i, [[x0, y0], [x1, y0], [x1, y1], [x0, y1]], "Room"))
            texts.append((p, i, "pair", "b", None, None, None, None, None, i, round((y1 - y0) * 0.01, 2), round((x1 - x0) * (0.014 if i else 0.01), 2), None))
        texts += [(p, 5, "length", "far", 2.6, 0, 0.0, 2, 0.0, None, None, None, None), (p, 6, "area", "c", *[None] * 5, 0, None, None, 1.4), (p, 7, "total_area", "d", *[None] * 8, 2.5)]
        texts += [(p, 8, "length", "no such wall", 2.0, 0, 0.0, 6, 0.0, *[None] * 4), (p, 9, "pair", "no such room", *[None] * 5, 77, 1.0, 1.0, None), (p, 10, "area", "no such room", *[None] * 5, 77, None, None, 2.6)]
        openings.append((p, 0, [xs[0] + 20, ys[0]], [xs[0] + 40, ys[0]], 9.0, 3))
    walls += [(7, 0, [0.0, 0.0], [50.0, 0.0], 5.0, "wall"), (8, 0, [0.0, 0.0], [50.0, 0.0], 5.0, "wall"), (8, 1, [0.0, 0.0], [0.0, 50.0], 5.0, "wall")]
    openings.append((7, 0, [1.0, 0.0], [9.0, 0.0], 3.0, 0))
    return walls, rooms, texts, openings, [(p, 0.0103) for p in range(3)] + [(7, 0.01), (8, None)]


@pytest.fixture(scope="module")
def tables(spark):
    walls, rooms, texts, openings, scales = plans()
    df = spark.createDataFrame
    return df(walls, WALL), df(rooms, ROOM), df(openings, OPENING), df([], ROOM), df(texts, TEXT), df(scales, "plan_id int, scale double")


@pytest.fixture(scope="module")
def refined(tables):
    return refinement.refine(*tables)


def loss(terms, x):
    total, r = 0.0, []
    for t in terms:
        px = sum(c * x[v] for v, c in zip(t.vars, t.coefs, strict=True))
        r.append((px * (np.exp(x[-1]) if t.metric else 1) - t.target) / t.sigma)
        total += r[-1] ** 2 / 2 if abs(r[-1]) <= 1 else abs(r[-1]) - 0.5
    return total, np.array(r)


def test_least_cost(tables, refined):
    """No coordinate can be moved a little either way at a gain, and reports are those of the values found."""
    walls, rooms, openings, _, texts, scales = tables
    soft = refinement.terms(walls, rooms, texts, scales)
    solved = {r.plan_id: r for r in refinement.solve(soft, walls, scales).collect()}
    terms = {}
    for t in soft.collect():
        terms.setdefault(t.plan_id, []).append(t)
    assert sorted(solved) == sorted(terms) == [0, 1, 2]
    report = {(r.plan_id, r.family): r for r in refined.by_family.collect()}
    for p, row in solved.items():
        assert row.settled
        x, start = np.array(row.x), np.array(row.start)
        best, r = loss(terms[p], x)
        assert best < loss(terms[p], start)[0]
        for i in range(len(x)):
            for h in (1e-3, -1e-3):
                y = x.copy()
                y[i] += h
                assert loss(terms[p], y)[0] > best - 1e-7
        assert best == pytest.approx(loss(terms[p], x + 0.0)[0])
        for family in {t.family for t in terms[p]}:
            at = [k for k, t in enumerate(terms[p]) if t.family == family]
            told = report[p, family]
            assert told.n == len(at)
            assert told.rms_after == pytest.approx(np.sqrt(np.mean(r[at] ** 2)), abs=1e-5)
            assert told.rms_before == pytest.approx(np.sqrt(np.mean(loss(terms[p], start)[1][at] ** 2)))


def test_annotations(refined):
    told = {(r.plan_id, r.seq, r.family, r.value): r for r in refined.annotations.collect()}
    assert {k[1] for k in told} == {0, 1, 5, 6, 7, 10}  # texts about what isn't there make no term, but for an area, taken as the plan's
    for (_, seq, family, _), r in told.items():
        assert r.units == ("m" if family in ("span", "room") else "sigma")
        if seq in (0, 5):
            assert not r.inconsistent
    assert any(r.inconsistent for (_, seq, _, _), r in told.items() if seq == 1)  # the side that is written 1.4 times too long


def test_shapes_follow(tables, refined):
    walls, rooms, openings, furniture, _, _ = tables
    key = lambda df: {(r.plan_id, r.id): r for r in df.collect()}
    before, after = key(walls), key(refined.walls)
    assert before.keys() == after.keys() and refined.walls.columns == walls.columns
    for k in ((7, 0), (8, 0), (8, 1)):
        assert after[k] == before[k]  # one wall, or no scale
    door, moved = key(openings), key(refined.openings)
    assert moved[7, 0] == door[7, 0]
    for p in range(3):
        host = after[p, 3]  # knots nearer than half a pixel are one, so shapes follow to that
        assert moved[p, 0].p0[1] == pytest.approx(host.p0[1], abs=0.5) and moved[p, 0].thickness == host.thickness
        for i in range(3):
            assert after[p, i].p0[0] == after[p, i].p1[0] and after[p, 3 + i].p0[1] == after[p, 3 + i].p1[1]
        assert after[p, 6].p0[0] == pytest.approx(after[p, 0].p0[0], abs=0.5) and after[p, 7].p0[0] == pytest.approx(after[p, 1].p0[0], abs=0.5)
        # the two walls nearly in one line came nearer
        assert abs(after[p, 8].p0[0] - after[p, 1].p0[0]) < abs(before[p, 8].p0[0] - before[p, 1].p0[0])
    assert {r.plan_id for r in refined.plans.collect()} == {0, 1, 2}
    assert key(refined.rooms).keys() == key(rooms).keys() and refined.furniture.count() == 0


def test_families(tables):
    """Terms can be left out; without any text the scale stays."""
    walls, rooms, _, _, texts, scales = tables
    some = refinement.terms(walls, rooms, texts, scales, ("data", "junction", "scale"))
    assert {r.family for r in some.select("family").distinct().collect()} == {"data", "junction", "scale"}
    assert all(np.exp(r.x[-1]) == pytest.approx(0.0103) for r in refinement.solve(some, walls, scales).collect())


def test_empty(tables):
    none = [t.limit(0) for t in tables]
    out = refinement.refine(*none)
    assert out.walls.count() == out.by_family.count() == out.annotations.count() == 0
