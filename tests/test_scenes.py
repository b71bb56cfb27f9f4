"""Scene operators and numeric kernels on small synthetic scenes."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quoin.operators import estimation, fusion
from quoin.plans import catalog, scenes
from quoin.streaming import runs

K = [100.0, 100.0, 50.0, 50.0]
EYE = [1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0]


def poses(spark, n=4):
    rows = [("s", i, EYE, [-0.1 * i, 0.0, 0.0], K, [0.1 * i, 0.0, 0.0], [0.0, 0.0, 1.0], 101, 101) for i in range(n)]
    return spark.createDataFrame(rows, "scene string, img int, r array<double>, t array<double>, k array<double>, c array<double>, fwd array<double>, width int, height int")


def test_similarity():
    rng = np.random.default_rng(0)
    a = rng.normal(size=(30, 3))
    q = np.linalg.qr(rng.normal(size=(3, 3)))[0]
    q *= np.sign(np.linalg.det(q))
    s, r, t = estimation.similarity(a, 2.5 * a @ q.T + [1, 2, 3])
    assert s == pytest.approx(2.5) and np.allclose(r, q) and np.allclose(t, [1, 2, 3])


def test_align_trajectories(spark):
    rng = np.random.default_rng(1)
    rows = [("s", *map(float, p), *map(float, p * 2 + 1)) for p in rng.normal(size=(8, 3))] + [("two", 0.0, 0.0, 0.0, 1.0, 1.0, 1.0)]
    got = estimation.align_trajectories(spark.createDataFrame(rows, "scene string, x double, y double, z double, tx double, ty double, tz double"), ["scene"]).collect()
    assert len(got) == 1 and got[0].scale == pytest.approx(2) and got[0].error < 1e-9


def test_triangulate_and_filter(spark):
    x = {0: (0.2, -0.1, 2.0), 1: (0.0, 0.3, 3.0)}
    p = poses(spark)
    seen = [("s", i, pt, 100 * (q[0] - 0.1 * i) / q[2] + 50 + (40.0 if (i, pt) == (3, 1) else 0.0), 100 * q[1] / q[2] + 50) for i in range(4) for pt, q in x.items()]
    obs = spark.createDataFrame(seen, "scene string, img int, pt int, u double, v double")
    got = {r.pt: r for r in estimation.triangulate(obs.join(p, ["scene", "img"]), ["scene", "pt"]).collect()}
    assert set(got) == {0} and (got[0].x, got[0].y, got[0].z) == pytest.approx(x[0])
    points = spark.createDataFrame([("s", pt, list(q)) for pt, q in x.items()], "scene string, pt int, x array<double>")
    kept = sorted((r.img, r.pt) for r in scenes.filter_outliers(obs, points, p).collect())
    assert kept == [(i, pt) for i in range(4) for pt in (0, 1) if (i, pt) != (3, 1)]
    assert {round(r.z, 6) for r in scenes.sparse_depths(obs, points, p).collect()} == {2.0, 3.0}
    assert [(r.pt, r.n) for r in scenes.best_observed(obs, 1).collect()] == [(0, 4)]


def test_tracks_and_pairs(spark):
    m = spark.createDataFrame([("s", 0, 0, 1, 0), ("s", 1, 0, 2, 0), ("s", 0, 5, 1, 5), ("s", 0, 6, 1, 5)], "scene string, img_a int, kp_a int, img_b int, kp_b int")
    got = scenes.build_tracks(m).collect()
    assert sorted((r.img, r.kp) for r in got) == [(0, 0), (1, 0), (2, 0)] and len({r.track for r in got}) == 1
    frames = spark.createDataFrame([("s", i, [1.0, float(i == 0 or i == 9)]) for i in range(10)], "scene string, img int, vector array<double>")
    pairs = {(r.i, r.j) for r in scenes.candidate_pairs(frames, 2, 1).collect()}
    assert (0, 9) in pairs and (0, 1) in pairs and (0, 2) in pairs and all(i < j for i, j in pairs)


def test_plausible(spark):
    rows = [("s", i, [0.1 * i + (9.0 if i == 5 else 0.0), 0.0, 0.0]) for i in range(10)]
    got = {r.img for r in scenes.plausible(spark.createDataFrame(rows, "scene string, img int, c array<double>")).collect()}
    assert 5 not in got and {0, 1, 2, 8, 9} <= got


def test_consistent_depths_and_sources(spark):
    p = poses(spark)
    rows = [("s", i, u, v, 2.0 if not (i == 0 and u == 50) else 1.2) for i in range(4) for u in range(20, 80, 5) for v in range(20, 80, 5)]
    got = scenes.consistent_depths(spark.createDataFrame(rows, "scene string, img int, u int, v int, d double"), p).collect()
    assert not [r for r in got if r.img == 0 and r.u == 50 and r.d == 1.2 and r.v == 20] or len(got) < len(rows) + 1
    depth = spark.createDataFrame([("s", i, 2.0) for i in range(4)], "scene string, img int, d double")
    first = {r.img: r.source for r in scenes.pick_sources(p, depth).where("rank = 1").collect()}
    assert first[0] in (2, 1) and len(first) == 4


def test_fused_plane(spark):
    p = poses(spark, 2)
    depth = spark.createDataFrame([("s", i, u, v, 1.0) for i in range(2) for u in range(45, 56) for v in range(45, 56)], "scene string, img int, u int, v int, d double")
    samples = scenes.voxel_samples(depth, p, 0.02, 4)
    out = fusion.fuse_samples(samples, ["scene", "i", "j", "k"], "sdf", "d", truncation=0.08)
    signs = {r.k: r.s for r in out.groupBy("k").agg(F.avg("tsdf").alias("s")).collect()}
    assert signs[46] > 0 > signs[53]


def test_mesh_operators(spark):
    v = spark.createDataFrame([("s", i, float(x), float(y), float(z)) for i, (x, y, z) in enumerate(((-1, -1, 2), (1, -1, 2), (0, 1, 2), (-1, -1, 4), (1, -1, 4), (0, 1, 4), (9, 9, 9), (9, 9, 8), (9, 8, 9)))], "scene string, id int, x double, y double, z double")
    f = spark.createDataFrame([("s", 0, 0, 1, 2), ("s", 1, 3, 4, 5), ("s", 2, 2, 1, 5), ("s", 3, 6, 7, 8)], "scene string, face int, v0 int, v1 int, v2 int")
    full = scenes.faces_with_corners(v, f)
    assert {r.face: round(r.area, 6) for r in full.collect()}[0] == 2.0
    assert sorted(r.face for r in scenes.drop_small_components(f, 2).collect()) == [0, 1, 2]
    image = {(r.u, r.v): r for r in scenes.rasterize(full, poses(spark, 1)).collect()}
    assert image[50, 50].face == 0 and image[50, 50].depth == pytest.approx(2.0)
    depth = spark.createDataFrame([("s", 0, 50, 50, 2.0)], "scene string, img int, u int, v int, d double")
    points = spark.createDataFrame([("s", 0, [0.0, 0.0, 2.0]), ("s", 1, [0.0, 0.0, 4.0])], "scene string, pt int, x array<double>")
    assert {r.pt: r.seen for r in scenes.visible(points, depth, poses(spark, 1)).collect()} == {0: True, 1: False}


def test_planes_snap_and_texels(spark):
    rng = np.random.default_rng(2)
    rows = [("s", float(x), float(y), 0.005 * float(z), 0.0, 0.0, 1.0, 0.01) for x, y, z in rng.normal(size=(200, 3))] + [("s", 3.0 + 0.002 * float(z), float(x), float(y), 1.0, 0.0, 0.0, 0.01) for x, y, z in rng.normal(size=(150, 3))]
    pts = spark.createDataFrame(rows, "scene string, x double, y double, z double, nx double, ny double, nz double, area double")
    planes = estimation.extract_planes(pts, ["scene"])
    got = planes.orderBy("plane").collect()
    assert len(got) == 2 and abs(got[0].nz) > 0.99 and abs(got[1].nx) > 0.99
    v = spark.createDataFrame([("s", 0, 0.0, 0.0, 0.03, 0.0, 0.0, 1.0), ("s", 1, 0.0, 0.0, 0.5, 0.0, 0.0, 1.0)], "scene string, id int, x double, y double, z double, nx double, ny double, nz double")
    z = {r.id: r.z for r in scenes.snap_to_planes(v, planes).collect()}
    assert abs(z[0]) < 0.01 and z[1] == 0.5
    s = spark.createDataFrame([("s", "floor", [0.0, 0.0, 0.0], [0.0, 0.0, 1.0], [1.0, 0.0, 0.0], [0.0, 1.0, 0.0])], "scene string, surface string, origin array<double>, normal array<double>, right array<double>, up array<double>")
    f = spark.createDataFrame([("s", 0.01, 0.01, 0.02, 0.0, 0.0, 1.0, 10.0), ("s", 0.02, 0.02, 0.0, 0.0, 0.0, 1.0, 20.0), ("s", 0.01, 0.01, 0.5, 0.0, 0.0, 1.0, 90.0)], "scene string, cx double, cy double, cz double, nx double, ny double, nz double, r double")
    t = scenes.accumulate_texels(f, s, colours=("r",)).collect()
    assert [(x.row, x.col, x.n, x.r) for x in t] == [(0, 0, 2, 15.0)]


def test_correction_grid(spark):
    rng = np.random.default_rng(3)
    uv = rng.random((300, 2))
    rows = [("f", float(u), float(v), 0.1 + 0.2 * float(u) + (3.0 if i % 40 == 0 else 0.0)) for i, (u, v) in enumerate(uv)] + [("few", 0.5, 0.5, 1.0)]
    got = {r.node: r.value for r in estimation.correction_grid(spark.createDataFrame(rows, "k string, u double, v double, y double"), ["k"], "u", "v", "y", rounds=4, ridge=0.01).where("k = 'f'").collect()}
    assert len(got) == 12 and got[0] == pytest.approx(0.1, abs=0.05) and got[3] == pytest.approx(0.3, abs=0.05)


def test_otsu(spark):
    h = spark.createDataFrame([("a", v, n) for v, n in ((10, 50), (12, 40), (200, 30), (210, 20))], "k string, value int, n int")
    assert estimation.otsu(h, ["k"]).first().threshold == 12


def test_image_scores(spark):
    rows = [("s", u, v, ((u + v) % 7) / 7) for u in range(16) for v in range(16)]
    df = spark.createDataFrame(rows, "scene string, u int, v int, a double").withColumn("b", F.col("a"))
    assert scenes.ssim(df, ["scene"]).first().ssim == pytest.approx(1) and scenes.psnr(df, ["scene"], "a", "b").first().psnr == pytest.approx(120)
    far = df.withColumn("b", F.col("a") + 0.1)
    assert scenes.psnr(far, ["scene"], "a", "b").first().psnr == pytest.approx(20)
    f = spark.createDataFrame([("s", math.cos(a), 0.0, math.sin(a), 1.0) for a in (0.1, 0.1 + math.pi / 2)], "scene string, nx double, ny double, nz double, area double")
    assert scenes.heading(f, F.array(F.lit(0.0), F.lit(1.0), F.lit(0.0))).first().heading == pytest.approx(0.1)


def test_stream_equals_batch(spark, sf_dir, tmp_path):
    source = spark.read.parquet(f"{sf_dir}/events.parquet")
    source.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(source.schema).parquet(f"{tmp_path}/in")
    q = runs.stage_progress(stream).writeStream.outputMode("complete").format("memory").queryName("progress").start()
    q.processAllAvailable()
    q.stop()
    key = lambda df: sorted((str(r.start), r.event_type, r.n, round(r.total, 6)) for r in df.collect())
    assert key(spark.table("progress")) == key(runs.stage_progress(source))
    assert runs.sessions(source, "user_id").count() > 0


def test_flagship(spark):
    import __spark_entry__

    found, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(sql) <= set(found) and set(catalog.QUERIES) <= set(found)
    assert __spark_entry__.entry(spark).count() > 0


def test_surface_of_a_ball(spark):
    rows = [("s", i, j, k, math.sqrt(i * i + j * j + k * k) - 5.3, 1.0) for i in range(-8, 9) for j in range(-8, 9) for k in range(-8, 9)]
    v, f = scenes.extract_surface(spark.createDataFrame(rows, "scene string, i int, j int, k int, tsdf double, weight double"), 1.0)
    pts = {r.id: np.array([r.x, r.y, r.z]) for r in v.collect()}
    assert all(abs(np.linalg.norm(p) - 5.3) < 0.35 for p in pts.values())
    tri = [(pts[r.v0], pts[r.v1], pts[r.v2]) for r in f.collect()]
    assert sum(np.dot(np.cross(b - a, c - a), a + b + c) > 0 for a, b, c in tri) == len(tri)
    volume = sum(np.dot(a, np.cross(b, c)) for a, b, c in tri) / 6
    assert volume == pytest.approx(4 / 3 * math.pi * 5.3**3, rel=0.06)
