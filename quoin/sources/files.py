"""Readers and writers of layouts, reports, annotations, drawings, trajectories and meshes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quoin import schema

KINDS = ("walls", "openings", "rooms", "furniture")


def read_layouts(spark: SparkSession, path: str) -> DataFrame:
    """One row for each layout.json: path, plan_id (its folder's name) and the record."""
    rows = spark.read.schema(schema.LAYOUT).option("multiLine", True).json(path)
    source = F.input_file_name()
    return rows.select(source.alias("path"), F.element_at(F.split(source, "/"), -2).alias("plan_id"), "*")


def entities(layouts: DataFrame, kind: str, key: str = "plan_id") -> DataFrame:
    """One row for each entity of a kind, with its place in the list; a missing level is 0."""
    rows = layouts.select(key, F.posexplode(kind).alias("pos", "e")).select(key, "pos", "e.*")
    return rows.withColumn("level", F.coalesce("level", F.lit(0)))


def write_layouts(layouts: DataFrame, path: str) -> None:
    """A JSON record on each line."""
    layouts.drop("path").write.mode("overwrite").json(path)


def read_reports(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.schema(schema.RUN_REPORT).option("multiLine", True).json(path)
    source = F.input_file_name()
    return rows.select(source.alias("path"), F.element_at(F.split(source, "/"), -2).alias("plan_id"), F.url_decode(F.replace(F.element_at(F.split(source, "/"), -3), F.lit("+"), F.lit("%2B"))).alias("config"), "*")


def stage_means(reports: DataFrame, by: str = "config") -> DataFrame:
    """Mean seconds of each stage and of the total."""
    stages = reports.select(by, F.explode("timings_s").alias("stage", "seconds"))
    total = reports.select(by, F.lit("total").alias("stage"), F.col("total_s").alias("seconds"))
    return stages.unionByName(total).groupBy(by, "stage").agg(F.round(F.avg("seconds"), 3).alias("seconds"), F.count("*").alias("n"))


def run_report(events: DataFrame, timings: DataFrame, by: str = "run_id") -> DataFrame:
    """fallbacks in order, timings as a map and their sum to three places."""
    falls = events.groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "stage", "msg"))), lambda e: F.struct(e["stage"].alias("stage"), e["msg"].alias("msg"))).alias("fallbacks"))
    times = timings.groupBy(by).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("stage", "seconds")))).alias("timings_s"), F.round(F.sum("seconds"), 3).alias("total_s"))
    return times.join(falls, by, "left")


def read_rows(spark: SparkSession, path: str) -> DataFrame:
    """Evaluation rows of a JSON array; names and configurations are text, the rest numbers."""
    rows = spark.read.option("multiLine", True).json(path)
    return rows.select(*[c if c in ("scene", "config") else F.col(c).cast("double").alias(c) for c in rows.columns])


def read_annotations(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schema.ANNOTATION).option("multiLine", True).json(path)


def read_demos(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schema.DEMO).option("multiLine", True).json(path)


def read_trajectory(spark: SparkSession, path: str) -> DataFrame:
    """frame, m (16 numbers, camera to world, row by row) of each line of a text file."""
    lines = spark.read.text(path).where("value <> ''").coalesce(1)  # one small file; its order is the frames' order
    rows = lines.withColumn("frame", F.monotonically_increasing_id())
    return rows.select("frame", F.transform(F.split(F.trim("value"), r"\s+"), lambda v: v.cast("double")).alias("m"))


def split_samples(spark: SparkSession, split_file: str, folders: DataFrame, n: int | None = None) -> DataFrame:
    """Ids of a split file that have a folder, sorted, the first n if given. folders: a column id."""
    ids = spark.read.text(split_file).select(F.trim("value", F.lit("/ ")).alias("id")).where("id <> ''").distinct()
    found = ids.join(folders.select("id"), "id", "left_semi").orderBy("id")
    return found if n is None else found.limit(n)


# --- drawings ---


def _points(text: Column) -> Column:
    """A ring of at least three points from an SVG points attribute, or null."""
    pairs = F.filter(F.split(F.trim(text), r"\s+"), lambda p: p.rlike(r"^-?[\d.eE+-]+,-?[\d.eE+-]+$"))
    ring = F.transform(pairs, lambda p: F.array(F.split(p, ",")[0].cast("double"), F.split(p, ",")[1].cast("double")))
    return F.when(F.size(ring) >= 3, ring)


def read_drawings(spark: SparkSession, path: str) -> DataFrame:
    """(path, kind, pos, type, ring, texts) of the walls, railings, doors, windows and spaces of SVG files.

    A group is a wall, railing, door or window by its id and a space by its class, whose second word is
    the type; texts are those within the group."""
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), "value")
    group = r'(?s)<g\b[^>]*?(?:\bid="(?:Wall|Railing|Door|Window)"|\bclass="Space )[^>]*>.*?(?=<g\b[^>]*?(?:\bid="(?:Wall|Railing|Door|Window)"|\bclass="Space )|\z)'
    rows = files.select("path", F.posexplode(F.regexp_extract_all("value", F.lit(group), F.lit(0))).alias("pos", "g"))
    head = F.regexp_extract("g", r"^<g\b[^>]*>", 0)
    name = F.regexp_extract(head, r'\bid="(Wall|Railing|Door|Window)"', 1)
    texts = F.transform(F.regexp_extract_all("g", F.lit(r"<text[^>]*>\s*(?:<[^>]*>)*([^<]*)"), F.lit(1)), lambda t: F.trim(t))
    return rows.select(
        "path", F.when(name != "", F.lower(name)).otherwise("space").alias("kind"), "pos",
        F.regexp_extract(head, r'\bclass="Space (\w+)', 1).alias("type"),
        _points(F.regexp_extract("g", r'<polygon\b[^>]*?\bpoints="([^"]*)"', 1)).alias("ring"), F.filter(texts, lambda t: t != "").alias("texts"),
    ).where("ring is not null")


def opening_ends(ring: Column) -> Column:
    """Ends of the centre line of a four-cornered opening: its longer pair of sides is its width."""
    side = lambda i, j: F.hypot(ring[j][0] - ring[i][0], ring[j][1] - ring[i][1])
    mid = lambda i, j: F.array((ring[i][0] + ring[j][0]) / 2, (ring[i][1] + ring[j][1]) / 2)
    return F.when(side(0, 1) + side(2, 3) >= side(1, 2) + side(3, 0), F.array(mid(1, 2), mid(3, 0))).otherwise(F.array(mid(0, 1), mid(2, 3)))


def label_of(texts: Column) -> Column:
    """The first upper-case text without digits."""
    return F.try_element_at(F.filter(texts, lambda t: (t == F.upper(t)) & t.rlike(r"\p{Lu}") & ~t.rlike(r"\d")), F.lit(1))


# --- uploads ---

# Leading bytes of the accepted kinds, in hex.
_MAGIC = {"png": "89504E470D0A1A0A", "jpg": "FFD8FF", "pdf": "25504446", "mkv": "1A45DFA3"}


def upload_problem(name: Column, content: Column, image_mb: int = 25, video_mb: int = 300) -> Column:
    """Why an uploaded file is refused, or null: extension, size and leading bytes."""
    ext = F.lower(F.regexp_extract(name, r"\.([A-Za-z0-9]+)$", 1))
    ext = F.when(ext == "jpeg", "jpg").otherwise(ext)
    start = F.hex(F.substring(content, 1, 12))
    video = ext.isin("mp4", "mov", "webm", "mkv", "m4v")
    box = F.substring(start, 9, 8) == "66747970"  # an ISO media file says ftyp
    magic = F.when(ext.isin("mp4", "mov", "m4v"), box).when(ext == "webm", F.startswith(start, F.lit(_MAGIC["mkv"])))
    for e, m in _MAGIC.items():
        magic = magic.when(ext == e, F.startswith(start, F.lit(m)))
    limit = F.when(video, video_mb).otherwise(image_mb) * 1_000_000
    return F.when(~(video | ext.isin("png", "jpg", "pdf")), "extension").when(F.length(content) > limit, "size").when(~F.coalesce(magic, F.lit(False)), "content")


# --- meshes ---


def obj_lines(vertices: DataFrame, faces: DataFrame, by: str = "object") -> DataFrame:
    """(part, seq, line) of a Wavefront file. vertices: by, id (1.. over all objects), x, y, z; faces: by, v0, v1, v2."""
    names = vertices.select(by).distinct().select(F.col(by).alias("part"), F.lit(0).alias("kind"), F.lit(0).cast("long").alias("seq"), F.concat(F.lit("o "), F.col(by)).alias("line"))
    v = vertices.select(F.col(by).alias("part"), F.lit(1).alias("kind"), F.col("id").cast("long").alias("seq"), F.format_string("v %.6f %.6f %.6f", "x", "y", "z").alias("line"))
    f = faces.select(F.col(by).alias("part"), F.lit(2).alias("kind"), F.monotonically_increasing_id().alias("seq"), F.format_string("f %d %d %d", "v0", "v1", "v2").alias("line"))
    return names.unionByName(v).unionByName(f)


def write_obj(vertices: DataFrame, faces: DataFrame, path: str, by: str = "object") -> None:
    """A folder of text parts, in order within each."""
    obj_lines(vertices, faces, by).repartitionByRange("part", "kind", "seq").sortWithinPartitions("part", "kind", "seq").select("line").write.mode("overwrite").text(path)


def write_by_provenance(rows: DataFrame, path: str, provenance: str = "provenance") -> None:
    """A folder for each provenance class."""
    rows.write.mode("overwrite").partitionBy(provenance).parquet(path)


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", True).csv(path)


MOST_LINES = 10_000


def markdown(summary: DataFrame, digits: int = 3) -> str:
    """A small summary as a Markdown table; missing values as a dash. More than MOST_LINES rows are an error."""
    rows = summary.limit(MOST_LINES + 1).collect()
    if len(rows) > MOST_LINES:
        raise ValueError(f"a table of more than {MOST_LINES} rows: write it with write_csv")
    cell = lambda v: "-" if v is None or v != v else f"{v:.{digits}f}" if isinstance(v, float) else str(v)
    head = f"| {' | '.join(summary.columns)} |\n|{'---|' * len(summary.columns)}\n"
    return head + "".join(f"| {' | '.join(cell(v) for v in r)} |\n" for r in rows)
