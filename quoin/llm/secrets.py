"""Secret scan: patterns, and a randomness test battery for strings that no pattern names.

Only DataFrame functions: everything runs in the JVM.

A candidate of the battery is an unbroken run of characters that keys are made of. Its encoding
is inferred from the characters that it uses (hex, base 32, letters and digits, base 64). Three
tests ask whether it could be a uniform draw from that alphabet: a chi-squared test over the
alphabet's classes, a runs test about the middle of the alphabet and the serial correlation of
neighbours. Fisher's method joins the three.

Two error rates are held, for each range of lengths over all strings of the corpus (short strings
are weaker evidence and must not set the bar for long ones). Keys called ordinary: the
Benjamini-Hochberg rule rejects uniformity. Ordinary strings called keys: p-values of keys are
uniform, those of ordinary strings crowd at zero, so the largest p-values tell how many keys there
are, and a bar on the p-value is set such that of the strings reported the share beyond the keys
expected there stays under ALARMS. What is not rejected and passes that bar is reported as random.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quoin.operators.graph import checkpointed

#: The three patterns, in the order in which kinds are listed.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{24,}"  # shorter runs of [0-9a-f]+ are dropped anyway
#: (kind, pattern, group whose length counts, least length)
KINDS = (("assign", ASSIGN, 2, 6), ("access", ACCESS, 0, 20), ("hex", HEX, 0, 24))

CANDIDATE = r"[A-Za-z0-9+/_-]{20,}"
LEVEL = 0.05  # share of false rejections allowed
ALARMS = 0.1  # share of ordinary strings allowed among those reported
BINS = 200  # of the p-values' histogram, a fixed size


_BLOCK = 256


def _let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.transform(F.array(value), body)[0]


def running(values: Column, zero: int, step) -> Column:
    """step over the values so far, for each place of an array of ints (sums, largest so far). A fold copies what
    it has built at each place, so it is done in blocks and then over the blocks' last values."""
    empty = F.array().cast("array<int>")
    last = lambda done: F.coalesce(F.try_element_at(done, F.lit(-1)), F.lit(zero))
    fold = lambda xs: F.aggregate(xs, empty, lambda done, x: F.concat(done, F.array(step(last(done), x))))

    def joined(blocks: Column) -> Column:
        heads = F.concat(F.array(F.lit(zero)), fold(F.transform(blocks, lambda b: F.element_at(b, -1))))
        return _let(heads, lambda h: F.flatten(F.zip_with(blocks, F.slice(h, F.lit(1), F.size(h) - 1), lambda b, x: F.transform(b, lambda v: step(x, v)))))

    def cut(xs: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(xs) - 1) / _BLOCK).cast("int")), lambda i: fold(F.slice(xs, i * _BLOCK + 1, F.lit(_BLOCK))))

    return _let(values, lambda xs: F.when(F.size(xs) > 0, _let(cut(xs), joined)).otherwise(empty))


def located(text: Column, pattern: str, group: int = 0, unit=F.length) -> Column:
    """array<struct<start, end, size, string>> of the leftmost non-overlapping matches, end exclusive; size is
    the length of `group`. Positions (code points, or bytes by F.octet_length) come from the lengths of
    what lies between; the work goes with the text's length."""
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    part = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else whole

    def placed(rows: Column) -> Column:
        ends = running(F.transform(rows, lambda r: unit(r["gap"]) + unit(r["whole"])), 0, lambda a, x: a + x)
        return F.zip_with(rows, ends, lambda r, e: F.struct((e - unit(r["whole"])).alias("start"), e.alias("end"), F.length(r["part"]).alias("size"), r["whole"].alias("string")))

    def zipped(found: Column) -> Column:
        rows = F.arrays_zip(F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found)).alias("gap"), found.alias("whole"), (part if group else found).alias("part"))
        return F.transform(rows, lambda r: F.struct(r["gap"].alias("gap"), r["whole"].alias("whole"), r["part"].alias("part")))

    return _let(_let(whole, zipped), placed)


def base_spans(text: Column, unit=F.length) -> Column:
    """array<struct<start, kind, end>> of all kinds, by start and then by kind; kind is its number."""
    def of(k: int, pattern: str, group: int, least: int, quick: str) -> Column:
        spans = F.filter(located(text, pattern, group, unit), lambda s: s["size"] >= least)
        typed = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(k).alias("kind"), s["end"].alias("end")))
        return F.when(text.rlike(quick), typed).otherwise(F.array().cast("array<struct<start:int,kind:int,end:int>>"))

    quick = (r"(?i)password|passwd|secret|token|api_?key", ACCESS[:4], r"[0-9a-f]{24}")  # most texts stop here
    found = [of(k, pattern, group, least, quick[k]) for k, (_, pattern, group, least) in enumerate(KINDS)]
    return F.array_sort(F.concat(*found))


def joined(spans: Column, names: tuple[str, ...]) -> Column:
    name = F.array(*[F.lit(n) for n in names])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(name, s["kind"] + 1), s["start"], s["end"])), ",")


def _erfc(x: Column) -> Column:
    """Complementary error function of x >= 0 (a standard rational approximation, to 1.5e-7)."""
    t = 1 / (1 + 0.3275911 * x)
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    return F.least(F.lit(1.0), F.greatest(F.lit(1e-30), poly * F.exp(-x * x)))


def _upper_chi2(x: Column, dof: Column) -> Column:
    """Upper tail of chi-squared by the cube-root normal approximation."""
    z = (F.cbrt(x / dof) - (1 - 2 / (9 * dof))) / F.sqrt(2 / (9 * dof))
    return F.when(z >= 0, _erfc(F.abs(z) / 2**0.5) / 2).otherwise(1 - _erfc(F.abs(z) / 2**0.5) / 2)


#: The order of characters for the tests, and for each encoding the classes of its
#: alphabet as (first place, places, share). Hex is taken in small letters.
ORDER = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz+-/_"
_HALVES = ((11, 13), (24, 13), (37, 13), (50, 13))
CLASSES = {
    "hex": tuple((k, 1, 1 / 16) for k in (*range(1, 11), *range(37, 43))),
    "base32": ((11, 13, 13 / 32), (24, 13, 13 / 32), (3, 6, 6 / 32)),
    "alphanumeric": tuple((k, n, n / 62) for k, n in (*_HALVES, (1, 10))),
    "base64": tuple((k, n, n / 64) for k, n in (*_HALVES, (1, 10))) + ((63, 4, 2 / 64),),
}


def battery(strings: DataFrame, column: str = "string") -> DataFrame:
    """Add encoding, p_uniform, p_runs, p_serial and p_value to rows with a string of 20 characters or more."""
    s = F.col(column)
    n = F.length(s).cast("double")
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda acc, v: acc + v)
    encoding = F.when(s.rlike("^([0-9a-f]+|[0-9A-F]+)$"), "hex").when(s.rlike("^[A-Z2-7]+$"), "base32").when(s.rlike("^[A-Za-z0-9]+$"), "alphanumeric").otherwise("base64")
    rows = strings.withColumn("encoding", encoding)
    place = F.transform(F.split(F.when(F.col("encoding") == "hex", F.lower(s)).otherwise(s), ""), lambda c: F.instr(F.lit(ORDER), c).cast("double"))
    rows = rows.withColumn("_v", F.filter(place, lambda v: v > 0))
    # chi-squared over the classes of the encoding's alphabet
    cells = F.create_map(*[F.lit(x) if isinstance(x, str) else x for name, parts in CLASSES.items() for x in (name, F.array(*[F.struct(F.lit(k).alias("k"), F.lit(k + m).alias("to"), F.lit(share).alias("share")) for k, m, share in parts]))])
    seen = lambda c: F.size(F.filter("_v", lambda v: (v >= c["k"]) & (v < c["to"])))
    rows = rows.withColumn("_cells", cells[F.col("encoding")])
    x = total(F.transform("_cells", lambda c: (seen(c) - n * c["share"]) * (seen(c) - n * c["share"]) / (n * c["share"])))
    rows = rows.withColumn("_x", x).withColumn("p_uniform", F.greatest(F.lit(1e-30), _upper_chi2(F.col("_x"), (F.size("_cells") - 1).cast("double"))))
    # runs about the mean place, and the correlation of neighbours
    rows = rows.withColumn("_m", total("_v") / n)
    rows = rows.withColumn("_d", F.transform("_v", lambda v: v - F.col("_m")))
    pairs = F.zip_with(F.slice("_d", F.lit(1), F.size("_d") - 1), F.slice("_d", F.lit(2), F.size("_d") - 1), lambda a, b: a * b)
    rows = rows.withColumn("_pairs", pairs).withColumn("_var", total(F.transform("_d", lambda v: v * v)))
    rows = rows.withColumn("_above", F.size(F.filter("_d", lambda v: v > 0)).cast("double")).withColumn("_turns", F.size(F.filter("_pairs", lambda v: v < 0)).cast("double"))
    mean = 1 + 2 * F.col("_above") * (n - F.col("_above")) / n
    rows = rows.withColumn("_runs", mean)
    spread = F.greatest(F.lit(1e-9), (F.col("_runs") - 1) * (F.col("_runs") - 2) / (n - 1))
    z_runs = F.when(F.col("_runs") <= 1, F.lit(9.0)).otherwise(F.abs(F.col("_turns") + 1 - F.col("_runs")) / F.sqrt(spread))
    z_serial = F.when(F.col("_var") <= 0, F.lit(9.0)).otherwise(F.abs(total("_pairs") / F.col("_var") + 1 / n) * F.sqrt(n))
    rows = rows.withColumn("_zr", z_runs / 2**0.5).withColumn("_zs", z_serial / 2**0.5)
    rows = rows.withColumn("p_runs", _erfc(F.col("_zr"))).withColumn("p_serial", _erfc(F.col("_zs")))
    rows = rows.withColumn("_h", -F.log("p_uniform") - F.log("p_runs") - F.log("p_serial"))
    rows = rows.withColumn("p_value", F.exp(-F.col("_h")) * (1 + F.col("_h") + F.col("_h") * F.col("_h") / 2))  # upper tail with six degrees of freedom
    return rows.drop("_v", "_cells", "_x", "_m", "_d", "_pairs", "_var", "_above", "_turns", "_runs", "_zr", "_zs", "_h")


def rejected(tested: DataFrame, level: float = LEVEL, alarms: float = ALARMS) -> DataFrame:
    """Add `ordinary` (uniformity is rejected, by Benjamini-Hochberg within each range of lengths) and `random`
    (not ordinary, and over the bar under which too many of the reported would not be keys).

    The p-values are counted in a histogram of fixed size for each range, so both rules see every
    string of the corpus and their tables stay small (4 ranges of BINS bins)."""
    reach = F.when(F.length("string") < 24, 0).when(F.length("string") < 32, 1).when(F.length("string") < 64, 2).otherwise(3)
    bin_of = F.least(F.lit(BINS - 1), F.floor(-8 * F.log10(F.greatest(F.col("p_value"), F.lit(1e-30))))).cast("int")
    tested = tested.withColumn("_reach", reach).withColumn("_bin", bin_of)
    counts = tested.groupBy("_reach", "_bin").agg(F.count("*").alias("_c"))
    up = Window.partitionBy("_reach").orderBy(F.desc("_bin"))
    down = Window.partitionBy("_reach").orderBy("_bin")
    every = Window.partitionBy("_reach")
    counts = counts.withColumn("_below", F.sum("_c").over(up)).withColumn("_all", F.sum("_c").over(every)).withColumn("_above", F.sum("_c").over(down))
    top = F.pow(F.lit(10.0), -F.col("_bin") / 8.0)  # the bin's largest p-value
    passed = top <= level * F.col("_below") / F.col("_all")
    # keys are uniform: the p-values over a half, or so, tell how many there are
    tail, half = 3, 10 ** (-3 / 8)
    keys = F.sum(F.when(F.col("_bin") < tail, F.col("_c")).otherwise(0)).over(every) / (1 - half)
    least = F.when(F.col("_bin") == BINS - 1, 0.0).otherwise(F.pow(F.lit(10.0), -(F.col("_bin") + 1) / 8.0))
    clear = (F.col("_above") - keys * (1 - least)) / F.col("_above") <= alarms
    bars = counts.select("_reach", "_bin", passed.alias("_passed"), clear.alias("_clear"))
    bars = bars.groupBy("_reach").agg(F.min(F.when(F.col("_passed"), F.col("_bin"))).alias("_bar"), F.max(F.when(F.col("_clear"), F.col("_bin"))).alias("_last"))
    out = tested.join(F.broadcast(bars), "_reach", "left").withColumn("ordinary", F.coalesce(F.col("_bin") >= F.col("_bar"), F.lit(False)))
    return out.withColumn("random", ~F.col("ordinary") & F.coalesce(F.col("_bin") <= F.col("_last"), F.lit(False))).drop("_reach", "_bin", "_bar", "_last")


def candidates(docs: DataFrame, owner: str, text: str = "_text", unit=F.length) -> DataFrame:
    """(owner, string, start, end) of runs of key characters with letters and digits both."""
    rows = docs.where(F.col(text).rlike(CANDIDATE)).select(owner, F.explode(located(F.col(text), CANDIDATE, 0, unit)).alias("_at"))
    rows = rows.select(owner, F.col("_at.start").alias("start"), F.col("_at.end").alias("end"), F.col("_at.string").alias("string"))
    return rows.where(F.col("string").rlike("[0-9]") & F.col("string").rlike("[A-Za-z]"))


_SPANS = "array<struct<start:int,kind:int,end:int>>"


def _scanned(docs: DataFrame, key: str, text: str, level: float, unit=F.length) -> DataFrame:
    """(_doc: the whole row as a struct, key, _text, base_spans, random_spans). Candidates are tested once and
    kept, with their p-values, in the checkpoint folder: there are few of them."""
    rows = docs.select(F.struct(*docs.columns).alias("_doc"), F.col(key).alias("_key"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    rows = rows.withColumn("_row", F.xxhash64("_key", "_text")).withColumn("_row2", F.xxhash64(F.lit(1), "_text", "_key"))
    tested = battery(candidates(rows.select(F.struct("_row", "_row2").alias("_owner"), "_text"), "_owner", unit=unit))
    found = rejected(checkpointed(tested.select("_owner", "start", "end", "string", "p_value")), level)
    flagged = found.where("random").select("_owner._row", "_owner._row2", "start", "end").distinct()
    flagged = flagged.groupBy("_row", "_row2").agg(F.array_sort(F.collect_list(F.struct("start", F.lit(len(KINDS)).alias("kind"), "end"))).alias("_random"))
    rows = rows.withColumn("base_spans", base_spans(F.col("_text"), unit)).join(flagged, ["_row", "_row2"], "left")
    return rows.withColumn("random_spans", F.when(F.col("_random").isNull(), F.array().cast(_SPANS)).otherwise(_outside(F.col("_random"), F.col("base_spans"))))


def _outside(spans: Column, base: Column) -> Column:
    """The spans that do not lie within a base span: in order of start, no base span before reaches their end."""
    far = lambda xs: running(F.transform(xs, lambda s: F.when(s["kind"] < len(KINDS), s["end"]).otherwise(0)), 0, lambda a, x: F.greatest(a, x))
    kept = lambda xs: F.filter(F.zip_with(xs, far(xs), lambda s, e: F.when(s["end"] > e, s)), lambda s: s.isNotNull() & (s["kind"] == len(KINDS)))
    return _let(F.array_sort(F.concat(base, spans)), kept)


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", level: float = LEVEL) -> DataFrame:
    """One row for each document: base_spans and random_spans (array<struct<start, kind, end>>; kind 3 is random).

    A random span that lies within a base span is left out. Null counts as an empty text, without spans.
    Repeated keys give repeated rows, each with the spans of its own text; no rows give no rows; other
    columns are ignored. The work goes with a text's length.
    """
    return _scanned(docs.select(key, text), key, text, level).select(F.col("_key").alias(key), "base_spans", "random_spans")


def redact(docs: DataFrame, key: str = "doc_id", text: str = "text", mark: str = "[secret]", level: float = LEVEL) -> DataFrame:
    """The documents with each span of their texts replaced by `mark`, once where spans overlap.

    All columns and rows stay, repeated ones included; texts without spans, null and empty ones included,
    stay as they are; no rows give no rows. The work goes with a text's length."""
    rows = _scanned(docs, key, text, level, F.octet_length).withColumn("_spans", F.array_sort(F.concat("base_spans", "random_spans")))

    def cleaned(reach: Column, raw: Column) -> Column:
        piece = lambda lo, hi: F.substring(raw, lo + 1, hi - lo).cast("string")
        before = F.concat(F.array(F.lit(0)), reach)  # the end of all spans so far, in bytes
        gaps = F.zip_with("_spans", F.slice(before, F.lit(1), F.size(reach)), lambda s, at: F.when(s["start"] >= at, F.concat(piece(at, s["start"]), F.lit(mark))).otherwise(F.lit("")))
        return F.concat(F.array_join(gaps, ""), piece(F.element_at(reach, -1), F.octet_length(raw)))

    ends = F.transform("_spans", lambda s: s["end"])
    clean = F.when(F.size("_spans") == 0, F.col("_doc")[text]).otherwise(_let(F.col("_text").cast("binary"), lambda raw: _let(running(ends, 0, lambda a, x: F.greatest(a, x)), lambda reach: cleaned(reach, raw))))
    return rows.select(*[clean.alias(c) if c == text else F.col("_doc")[c].alias(c) for c in docs.columns])


def digest(scanned: DataFrame, key: str = "doc_id") -> DataFrame:
    """The counts, the hash of the base spans and all spans as text."""
    names = tuple(k[0] for k in KINDS) + ("random",)
    base = F.col("base_spans")
    count = lambda k: F.size(F.filter(base, lambda s: s["kind"] == k)).cast("long")
    counts = [count(k).alias(f"n_{name}") for k, (name, *_) in enumerate(KINDS)]
    return scanned.select(key, *counts, F.sha2(joined(base, names), 256).alias("base_sha256"), joined(F.array_sort(F.concat(base, "random_spans")), names).alias("spans"))
