"""Operators on reconstructed scenes: poses, observations, depth, meshes and texels as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quoin.functions import geometry as g
from quoin.operators import matching, nearest
from quoin.operators.graph import connected_components

SCENE = ["scene"]


def candidate_pairs(frames: DataFrame, window: int = 6, loops: int = 5) -> DataFrame:
    """(scene, i, j) with i < j: frames at most `window` apart, and each frame's `loops` most similar
    ones farther off. frames: scene, img, vector."""
    other = frames.select("scene", F.col("img").alias("j"))
    band = frames.select("scene", F.col("img").alias("i")).join(other, "scene").where((F.col("j") > F.col("i")) & (F.col("j") - F.col("i") <= window))
    far = nearest.top_outside_band(frames, SCENE, "img", "vector", window, loops).select("scene", F.least("img", "other").alias("i"), F.greatest("img", "other").alias("j"))
    return band.unionByName(far).distinct()


def seed_pairs(matches: DataFrame, by: list[str], first: str, second: str, n: str, least: int = 2, most: int = 18, top: int = 40) -> DataFrame:
    """The pairs of frames that a reconstruction may start from, best first: `least` to `most` frames apart,
    of the most matches (ties: the later frames), with their rank from 1 to `top`."""
    gap = F.col(second) - F.col(first)
    order = Window.partitionBy(*by).orderBy(F.desc(n), F.desc(first), F.desc(second))
    return matches.where((gap >= least) & (gap <= most)).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def build_tracks(matches: DataFrame) -> DataFrame:
    """(scene, track, img, kp) from verified matches (scene, img_a, kp_a, img_b, kp_b): components that
    see no image twice, of two observations or more."""
    key = lambda img, kp: F.xxhash64("scene", img, kp)
    named = matches.withColumn("a", key("img_a", "kp_a")).withColumn("b", key("img_b", "kp_b"))
    ends = named.select("scene", F.explode(F.array(F.struct(F.col("a").alias("id"), F.col("img_a").alias("img"), F.col("kp_a").alias("kp")), F.struct(F.col("b").alias("id"), F.col("img_b").alias("img"), F.col("kp_b").alias("kp")))).alias("e")).select("scene", "e.*").distinct()
    rows = ends.join(connected_components(named), "id").withColumnRenamed("component", "track")
    good = matching.valid_tracks(rows, "track", "img")
    return rows.join(good.select("track"), "track", "left_semi").select("scene", "track", "img", "kp")


def posed(observations: DataFrame, points: DataFrame, poses: DataFrame) -> DataFrame:
    """Observations (scene, img, pt, u, v) with what their point (x) projects to: p.u, p.v, p.z and the error."""
    rows = observations.join(points.select("scene", "pt", "x"), ["scene", "pt"]).join(poses.select("scene", "img", "r", "t", "k"), ["scene", "img"])
    rows = rows.withColumn("p", g.project(F.col("k"), F.col("r"), F.col("t"), F.col("x")))
    return rows.withColumn("error", F.hypot(F.col("p.u") - F.col("u"), F.col("p.v") - F.col("v")))


def filter_outliers(observations: DataFrame, points: DataFrame, poses: DataFrame, most: float = 6.0) -> DataFrame:
    """Observations in front of their camera and off by at most `most` pixels, of points that keep two."""
    ok = posed(observations, points, poses).where((F.col("error") <= most) & (F.col("p.z") > 0)).select(*observations.columns)
    two = ok.groupBy("scene", "pt").agg(F.count("*").alias("n")).where("n >= 2")
    return ok.join(two.select("scene", "pt"), ["scene", "pt"], "left_semi")


def sparse_depths(observations: DataFrame, points: DataFrame, poses: DataFrame) -> DataFrame:
    return posed(observations, points, poses).where("p.z > 0").select("scene", "img", "pt", "u", "v", F.col("p.z").alias("z"))


def best_observed(observations: DataFrame, most: int) -> DataFrame:
    """The points of each scene with most observations, the smaller id on ties."""
    seen = observations.groupBy("scene", "pt").agg(F.count("*").alias("n"))
    return seen.withColumn("_r", F.row_number().over(Window.partitionBy("scene").orderBy(F.desc("n"), "pt"))).where(F.col("_r") <= most).drop("_r")


def plausible(poses: DataFrame, factor: float = 3.0, gap: int = 4) -> DataFrame:
    """Poses (scene, img, c) within factor * median step * (gap + 1) of one of the registered neighbours before and after, at most `gap` frames off; a pose without such a neighbour stays."""
    w = Window.partitionBy("scene").orderBy("img")
    d = lambda a, b: F.sqrt(sum((F.col(a)[i] - F.col(b)[i]) ** 2 for i in range(3)))
    rows = poses.withColumn("_pc", F.lag("c").over(w)).withColumn("_nc", F.lead("c").over(w)).withColumn("_pg", F.col("img") - F.lag("img").over(w)).withColumn("_ng", F.lead("img").over(w) - F.col("img"))
    step = rows.where("_pg is not null").groupBy("scene").agg(F.median(d("c", "_pc") / F.col("_pg")).alias("_step"))
    rows = rows.join(step, "scene", "left")
    near = lambda c, n: F.when(F.col(n) <= gap, d("c", c) <= factor * F.col("_step") * (F.col(n) + 1))
    a, b = near("_pc", "_pg"), near("_nc", "_ng")
    return rows.where((a.isNull() & b.isNull()) | F.coalesce(a, F.lit(False)) | F.coalesce(b, F.lit(False))).select(*poses.columns)


def consistent_depths(depth: DataFrame, poses: DataFrame, neighbours: int = 6, tolerance: float = 0.04, least: int = 2) -> DataFrame:
    """Depth pixels that `least` of their frame's nearest frames agree with, or that fewer see.

    depth: scene, img, u, v (whole pixels), d. Each pixel is put into each neighbour and met with what
    lies there: an equi-join on the pixel."""
    frames = poses.select("scene", F.col("img").alias("other"), F.col("r").alias("r2"), F.col("t").alias("t2"), F.col("k").alias("k2"))
    ranked = poses.select("scene", "img", "r", "t", "k").join(frames, "scene").where("img <> other")
    ranked = ranked.withColumn("_n", F.row_number().over(Window.partitionBy("scene", "img").orderBy(F.abs(F.col("img") - F.col("other")), "other"))).where(F.col("_n") <= neighbours)
    pixel = depth.where("d > 0").join(ranked, ["scene", "img"])
    pixel = pixel.withColumn("_x", g.backproject(F.col("k"), F.col("r"), F.col("t"), F.col("u"), F.col("v"), F.col("d")))
    pixel = pixel.withColumn("_p", g.project(F.col("k2"), F.col("r2"), F.col("t2"), F.col("_x"))).where("_p.z > 0")
    there = depth.where("d > 0").select("scene", F.col("img").alias("other"), F.col("u").alias("u2"), F.col("v").alias("v2"), F.col("d").alias("d2"))
    seen = pixel.select("scene", "img", "u", "v", "other", F.rint("_p.u").cast("int").alias("u2"), F.rint("_p.v").cast("int").alias("v2"), F.col("_p.z").alias("z")).join(there, ["scene", "other", "u2", "v2"])
    votes = seen.groupBy("scene", "img", "u", "v").agg(F.count("*").alias("n"), F.sum((F.abs(F.col("z") - F.col("d2")) <= tolerance * F.col("d2")).cast("int")).alias("agree"))
    rows = depth.where("d > 0").join(votes, ["scene", "img", "u", "v"], "left")
    return rows.where((F.coalesce("agree", F.lit(0)) >= least) | (F.coalesce("n", F.lit(0)) < least)).select(*depth.columns)


def pick_sources(poses: DataFrame, depth: DataFrame, n: int = 4, low: float = 3.0, high: float = 25.0) -> DataFrame:
    """(scene, img, source, rank): the frames best placed to match each one: looking within 45 degrees of
    it, seen under 1.5 degrees or more at its median depth (scene, img, d); those between low and high first, then the nearer in time. poses: c, fwd."""
    other = poses.select("scene", F.col("img").alias("source"), F.col("c").alias("c2"), F.col("fwd").alias("f2"))
    rows = poses.join(depth, ["scene", "img"]).join(other, "scene").where("img <> source")
    dot = sum(F.col("fwd")[i] * F.col("f2")[i] for i in range(3))
    base = F.sqrt(sum((F.col("c")[i] - F.col("c2")[i]) ** 2 for i in range(3)))
    rows = rows.withColumn("_a", F.degrees(2 * F.atan(base / (2 * F.col("d"))))).where((dot > F.cos(F.radians(F.lit(45.0)))) & (F.col("_a") >= 1.5))
    off = F.greatest(F.lit(0.0), low - F.col("_a"), F.col("_a") - high)
    w = Window.partitionBy("scene", "img").orderBy(off, F.abs(F.col("img") - F.col("source")), "source")
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n).select("scene", "img", "source", "rank")


def voxel_samples(depth: DataFrame, poses: DataFrame, voxel: float = 0.02, truncation: int = 4) -> DataFrame:
    """(scene, i, j, k, sdf, d): depth pixels as samples along their rays, a voxel apart, to the
    truncation on either side of the surface; for fusion.fuse_samples."""
    rows = depth.where("d > 0").join(poses.select("scene", "img", "r", "t", "k"), ["scene", "img"])
    steps = F.explode(F.sequence(F.lit(-truncation), F.lit(truncation)))
    rows = rows.withColumn("_s", steps).withColumn("_z", F.col("d") + F.col("_s") * voxel).where("_z > 0")
    rows = rows.withColumn("_x", g.backproject(F.col("k"), F.col("r"), F.col("t"), F.col("u"), F.col("v"), F.col("_z")))
    cell = lambda i: F.floor(F.col("_x")[i] / voxel).cast("int")
    return rows.select("scene", cell(0).alias("i"), cell(1).alias("j"), cell(2).alias("k"), (-F.col("_s") * voxel).alias("sdf"), "d")


def faces_with_corners(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """Faces (scene, face, v0, v1, v2) with their corners a, b, c, normal and area."""
    at = lambda v, n: vertices.select("scene", F.col("id").alias(v), F.array("x", "y", "z").alias(n))
    rows = faces.join(at("v0", "a"), ["scene", "v0"]).join(at("v1", "b"), ["scene", "v1"]).join(at("v2", "c"), ["scene", "v2"])
    return rows.withColumn("_n", g.face_normal_area(F.col("a"), F.col("b"), F.col("c"))).select("*", "_n.*").drop("_n")


def drop_small_components(faces: DataFrame, least: int = 500) -> DataFrame:
    """Faces of mesh components of `least` faces or more."""
    vertex = lambda v: F.xxhash64("scene", v)
    edges = faces.select(F.explode(F.array(F.struct(vertex("v0").alias("a"), vertex("v1").alias("b")), F.struct(vertex("v1").alias("a"), vertex("v2").alias("b")))).alias("e")).select("e.*")
    rows = faces.withColumn("id", vertex("v0")).join(connected_components(edges), "id")
    big = rows.groupBy("scene", "component").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    return rows.join(big.select("scene", "component"), ["scene", "component"], "left_semi").select(*faces.columns)


def crop_to_room(faces: DataFrame, frames: DataFrame, margin: float = 0.25) -> DataFrame:
    """Faces (scene, cx, cy, cz) over a footprint (ring in x, z) grown by the margin and between floor and ceiling, likewise. frames: scene, polygon, floor_y, ceil_y."""
    rows = faces.join(frames, "scene")
    ok = g.within(F.array("cx", "cz"), F.col("polygon"), margin) & F.col("cy").between(F.col("floor_y") - margin, F.col("ceil_y") + margin)
    return rows.where(ok).select(*faces.columns)


def rasterize(faces: DataFrame, poses: DataFrame) -> DataFrame:
    """(scene, img, v, u, face, depth): the nearest face at each pixel of each pose (width, height).

    faces: scene, face, a, b, c. Every face is dealt over the pixels of its box, and the least
    (depth, face) of a pixel wins; depth is interpolated in its inverse."""
    rows = faces.join(poses.select("scene", "img", "r", "t", "k", "width", "height"), "scene")
    for n in ("a", "b", "c"):
        rows = rows.withColumn(f"p{n}", g.project(F.col("k"), F.col("r"), F.col("t"), F.col(n)))
    rows = rows.where("pa.z > 0.01 and pb.z > 0.01 and pc.z > 0.01")
    u = [F.col(f"p{n}.u") for n in ("a", "b", "c")]
    v = [F.col(f"p{n}.v") for n in ("a", "b", "c")]
    span = lambda c, top: F.sequence(F.greatest(F.lit(0), F.ceil(F.least(*c)).cast("int")), F.least(F.col(top) - 1, F.floor(F.greatest(*c)).cast("int")))
    rows = rows.where((F.floor(F.greatest(*u)) >= F.greatest(F.lit(0), F.ceil(F.least(*u)))) & (F.floor(F.greatest(*v)) >= F.greatest(F.lit(0), F.ceil(F.least(*v)))) & (F.ceil(F.least(*u)) < F.col("width")) & (F.ceil(F.least(*v)) < F.col("height")))
    rows = rows.withColumn("_v", F.explode(span(v, "height"))).withColumn("_u", F.explode(span(u, "width")))
    edge = lambda i, j: (u[j] - u[i]) * (F.col("_v") - v[i]) - (v[j] - v[i]) * (F.col("_u") - u[i])
    total = (u[1] - u[0]) * (v[2] - v[0]) - (v[1] - v[0]) * (u[2] - u[0])
    rows = rows.where(F.abs(total) > 1e-9).withColumn("_0", edge(1, 2) / total).withColumn("_1", edge(2, 0) / total).withColumn("_2", edge(0, 1) / total).where("_0 >= 0 and _1 >= 0 and _2 >= 0")
    depth = 1 / (F.col("_0") / F.col("pa.z") + F.col("_1") / F.col("pb.z") + F.col("_2") / F.col("pc.z"))
    near = rows.groupBy("scene", "img", F.col("_v").alias("v"), F.col("_u").alias("u")).agg(F.min(F.struct(F.round(depth, 9).alias("depth"), "face")).alias("n"))
    return near.select("scene", "img", "v", "u", "n.face", "n.depth")


def visible(points: DataFrame, depth: DataFrame, poses: DataFrame) -> DataFrame:
    """Points (scene, pt, x) with `seen`: whether any frame's depth at their pixel is theirs, to 3 cm and 1 %."""
    rows = points.join(poses.select("scene", "img", "r", "t", "k"), "scene").withColumn("_p", g.project(F.col("k"), F.col("r"), F.col("t"), F.col("x"))).where("_p.z > 0")
    rows = rows.select("scene", "pt", "img", F.rint("_p.u").cast("int").alias("u"), F.rint("_p.v").cast("int").alias("v"), F.col("_p.z").alias("z"))
    hit = rows.join(depth, ["scene", "img", "u", "v"]).where(F.abs(F.col("d") - F.col("z")) < 0.03 + 0.01 * F.col("z")).select("scene", "pt").distinct().withColumn("seen", F.lit(True))
    return points.join(hit, ["scene", "pt"], "left").withColumn("seen", F.coalesce("seen", F.lit(False)))


def accumulate_texels(faces: DataFrame, surfaces: DataFrame, cell: float = 0.03, band: float = 0.10, least: float = 0.5, colours: tuple[str, ...] = ("r", "g", "b")) -> DataFrame:
    """(scene, surface, row, col, n, colours): mean colour of the faces on each texel of a plane: within the
    band of it and facing its way. faces: scene, cx, cy, cz, nx, ny, nz; surfaces: scene, surface, origin, normal, right, up (arrays of 3)."""
    rows = faces.join(surfaces, "scene")
    off = [F.col(c) - F.col("origin")[i] for i, c in enumerate(("cx", "cy", "cz"))]
    along = lambda axis: sum(off[i] * F.col(axis)[i] for i in range(3))
    facing = sum(F.col(c) * F.col("normal")[i] for i, c in enumerate(("nx", "ny", "nz")))
    rows = rows.where((F.abs(along("normal")) <= band) & (facing > least))
    return rows.groupBy("scene", "surface", F.floor(along("up") / cell).cast("int").alias("row"), F.floor(along("right") / cell).cast("int").alias("col")).agg(F.count("*").alias("n"), *[F.avg(c).alias(c) for c in colours])


def snap_to_planes(vertices: DataFrame, planes: DataFrame, reach: float = 0.04, cosine: float = 0.85) -> DataFrame:
    """Vertices (scene, id, x, y, z, nx, ny, nz) moved onto the nearest plane within reach that faces their way. planes: scene, plane, nx, ny, nz, px, py, pz."""
    p = planes.select("scene", "plane", *[F.col(c).alias(f"_{c}") for c in ("nx", "ny", "nz", "px", "py", "pz")])
    rows = vertices.join(p, "scene")
    off = sum((F.col(a) - F.col(f"_p{a}")) * F.col(f"_n{a}") for a in ("x", "y", "z"))
    face = F.abs(sum(F.col(f"n{a}") * F.col(f"_n{a}") for a in ("x", "y", "z")))
    near = rows.withColumn("_off", off).where((F.abs(F.col("_off")) <= reach) & (face >= cosine))
    best = near.withColumn("_r", F.row_number().over(Window.partitionBy("scene", "id").orderBy(F.abs(F.col("_off")), "plane"))).where("_r = 1")
    moves = best.select("scene", "id", *[(F.col("_off") * F.col(f"_n{a}")).alias(f"_d{a}") for a in ("x", "y", "z")])
    out = vertices.join(moves, ["scene", "id"], "left")
    return out.select(*[(F.col(c) - F.coalesce(f"_d{c}", F.lit(0.0))).alias(c) if c in ("x", "y", "z") else F.col(c) for c in vertices.columns])


def heading(faces: DataFrame, up: Column) -> DataFrame:
    """(scene, heading): direction of upright faces, modulo a quarter turn, by area."""
    from quoin.operators.density import circular_mean

    level = F.abs(sum(F.col(c) * up[i] for i, c in enumerate(("nx", "ny", "nz")))) < 0.2
    return faces.where(level).groupBy("scene").agg(circular_mean(F.atan2("nz", "nx"), F.col("area")).alias("heading"))


def psnr(pairs: DataFrame, by: list[str], a: str, b: str, mask: Column | None = None) -> DataFrame:
    rows = pairs if mask is None else pairs.where(mask)
    return rows.groupBy(*by).agg((10 * F.log10(1 / F.greatest(F.avg((F.col(a) - F.col(b)) ** 2), F.lit(1e-12)))).alias("psnr"))


def ssim(pixels: DataFrame, by: list[str], a: str = "a", b: str = "b", window: int = 7) -> DataFrame:
    """Mean structural similarity over all square windows of pixels (u, v) that are whole; values in 0 to 1. Images
    smaller than the window, or with a gap in every window, are absent.

    Sums over windows are running sums along the rows, then along the columns: two windows, whatever their size."""
    x, y = F.col(a).cast("double"), F.col(b).cast("double")
    moments = {"_n": F.lit(1), "_x": x, "_y": y, "_xx": x * x, "_yy": y * y, "_xy": x * y}
    rows = pixels.where(x.isNotNull() & y.isNotNull()).select(*by, "u", "v", *(c.alias(n) for n, c in moments.items()))
    for across, along in (("v", "u"), ("u", "v")):
        w = Window.partitionBy(*by, across).orderBy(along).rangeBetween(1 - window, 0)
        rows = rows.select(*by, "u", "v", *(F.sum(n).over(w).alias(n) for n in moments))
    n = window * window
    mean = {c: F.col(c) / n for c in moments}
    spread = lambda c, p, q: (mean[c] - mean[p] * mean[q]) * n / (n - 1)
    c1, c2 = 0.01**2, 0.03**2
    s = (2 * mean["_x"] * mean["_y"] + c1) * (2 * spread("_xy", "_x", "_y") + c2) / ((mean["_x"] * mean["_x"] + mean["_y"] * mean["_y"] + c1) * (spread("_xx", "_x", "_x") + spread("_yy", "_y", "_y") + c2))
    return rows.where(F.col("_n") == n).groupBy(*by).agg(F.avg(s).alias("ssim"))


def extract_surface(voxels: DataFrame, voxel: float, least: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """(vertices, faces) of the zero level of fused distances (scene, i, j, k, tsdf, weight).

    Between neighbours of different signs lies a crossing. Each cell of eight voxels that has crossings on
    its edges gets a vertex at their mean, and each crossing a square of its four cells' vertices, as two
    triangles that face the positive side. Only equi-joins on neighbours and one aggregation."""
    v = voxels.where(F.col("weight") >= least).select("scene", "i", "j", "k", "tsdf")
    axes = ("i", "j", "k")
    crossings = None
    for n, axis in enumerate(axes):
        after = v.select("scene", *[(F.col(a) - int(a == axis)).alias(a) for a in axes], F.col("tsdf").alias("t2"))
        hit = v.join(after, ["scene", *axes]).where((F.col("tsdf") < 0) != (F.col("t2") < 0))
        part = F.col("tsdf") / (F.col("tsdf") - F.col("t2"))
        where = [F.col(a) + (part if a == axis else F.lit(0.0)) for a in axes]
        one = hit.select("scene", *axes, F.lit(n).alias("axis"), (F.col("tsdf") < 0).alias("out"), F.array(*where).alias("p"))
        crossings = one if crossings is None else crossings.unionByName(one)
    # the four cells about an edge, in turn
    turn = ((0, 0), (-1, 0), (-1, -1), (0, -1))

    def cell(n: int, d: tuple[int, int]) -> Column:
        others = [a for m, a in enumerate(axes) if m != n]
        move = dict(zip(others, d, strict=True))
        return F.struct(*[(F.col(a) + move.get(a, 0)).cast("int").alias(a) for a in axes])

    around = F.when(F.col("axis") == 0, F.array(*[cell(0, d) for d in turn])).when(F.col("axis") == 1, F.array(*[cell(1, d) for d in turn])).otherwise(F.array(*[cell(2, d) for d in turn]))
    rows = crossings.select("scene", "axis", "out", "p", around.alias("cells"))
    key = lambda c: F.xxhash64(F.col("scene"), c)
    touched = rows.select("scene", "p", F.explode("cells").alias("c"))
    vertices = touched.groupBy("scene", "c").agg(*[(F.avg(F.col("p")[n]) * voxel).alias(x) for n, x in enumerate(("x", "y", "z"))]).select("scene", key(F.col("c")).alias("id"), "x", "y", "z")
    q = [key(F.col("cells")[n]) for n in range(4)]
    flip = F.col("out") == (F.col("axis") == 1)  # the second axis turns the other way
    tri = lambda a, b, c: F.when(flip, F.struct(a.alias("v0"), c.alias("v1"), b.alias("v2"))).otherwise(F.struct(a.alias("v0"), b.alias("v1"), c.alias("v2")))
    faces = rows.select("scene", F.explode(F.array(tri(q[0], q[1], q[2]), tri(q[0], q[2], q[3]))).alias("f")).select("scene", "f.*")
    return vertices, faces
