"""Dimension texts of plans, storey labels and the acceptance of a scale, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# A number, feet with a foot mark and perhaps inches, and the forms of lengths and areas.
_NUMBER = r"(\d+(?:[.,]\d+)?)"
_METRIC = rf"^\s*{_NUMBER}\s*(mm|cm|m)?\s*$"
_UNIT = rf"^\s*{_NUMBER}\s*(mm|cm|m)\s*$"
_FEET = r"^\s*(\d{1,3})\s*['’′]\s*-?\s*(?:(\d{1,2}(?:\.\d+)?)\s*(?:[\"”″]|''))?\s*$"
_MILLIMETRES = r"^\s*(\d{1,2}\s?\d{3}|\d{3,5})\s*$"
_TWO_DECIMALS = r"^\s*(\d{1,2}[.,]\d{2})\s*$"
_AREA_UNIT = r"(?i)(\d{1,4}(?:[.,]\d{1,2})?)\s*(?:m2|m²|sq\.?\s*m)"
_AREA = r"(?i)(?:^|\s)(\d{1,3}[.,]\d)\s*(?:m2|m²)?\s*$"
_TIMES = "[xX×*]"


def _number(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, ",", "."), r"\s", "").try_cast("double")


def _metres(value: Column, unit: Column) -> Column:
    return F.when(unit == "mm", value / 1000).when(unit == "cm", value / 100).otherwise(value)


def _within(value: Column, low: float, high: float) -> Column:
    return (value >= low) & (value <= high)


def parse(text: Column) -> Column:
    """struct<kind, a, b, explicit> of a dimension text, or nulls: `pair` of two sides, `length` or
    `area`, in metres. Sides lie in 0.5 to 50, lengths in 0.3 to 100 (bare ones with two decimals to 50),
    areas in 1 to 500.

    Each side of a pair is read by itself, in feet or metres; a side without a unit counts as written,
    two of them as millimetres if one is over 100. An area without a unit has one decimal; explicit tells
    whether a unit stands there. Null and texts of no dimension give nulls."""
    t = F.trim(F.regexp_replace(F.regexp_replace(text, r"(?<=\d)[:;](?=\d{3}\b)", ""), r"^\s+|\s+$", ""))
    t = F.when(t.rlike(r"^[\dO\s.,]+$"), F.translate(t, "O", "0")).otherwise(t)
    return F.transform(F.array(t), _parsed)[0]  # the cleaned text is computed once


def _side(text: Column) -> Column:
    """struct<v, bare> of one side of a pair, or of feet alone: metres, and whether it has no unit; v is null where it is none."""
    feet, inches = F.regexp_extract(text, _FEET, 1), F.regexp_extract(text, _FEET, 2)
    value, unit = F.regexp_extract(text, _METRIC, 1), F.regexp_extract(text, _METRIC, 2)
    in_feet = (12 * _number(feet) + F.coalesce(_number(inches), F.lit(0.0))) * 0.0254
    return F.struct(F.when(feet != "", in_feet).when(value != "", _metres(_number(value), unit)).alias("v"), ((value != "") & (unit == "")).alias("bare"))


def _parsed(t: Column) -> Column:
    refused = t.rlike(r"^[(+\-±]") | F.contains(t, F.lit("/"))
    group = lambda pattern, i: F.regexp_extract(t, pattern, i)
    sides = F.transform(F.split(t, _TIMES, -1), _side)
    is_pair = (F.size(sides) == 2) & F.forall(sides, lambda s: s["v"].isNotNull())
    a, b = sides[0]["v"], F.try_element_at(sides, F.lit(2))["v"]
    small = F.forall(sides, lambda s: s["bare"]) & (F.greatest(a, b) > 100)
    pa, pb = F.when(small, a / 1000).otherwise(a), F.when(small, b / 1000).otherwise(b)
    feet = F.when(t.rlike(_FEET), a)
    unit = _metres(_number(group(_UNIT, 1)), group(_UNIT, 2))
    mm, two = _number(group(_MILLIMETRES, 1)) / 1000, _number(group(_TWO_DECIMALS, 1))
    written, bare = _number(group(_AREA_UNIT, 1)), _number(group(_AREA, 1))

    def made(kind: str, a: Column, b: Column | None = None, explicit: Column | None = None) -> Column:
        return F.struct(F.lit(kind).alias("kind"), a.cast("double").alias("a"), (b if b is not None else F.lit(None)).cast("double").alias("b"), (explicit if explicit is not None else F.lit(None)).cast("int").alias("explicit"))

    none = F.lit(None).cast("struct<kind:string,a:double,b:double,explicit:int>")
    value = (
        F.when(t.isNull() | refused, none)
        .when(is_pair, F.when(_within(pa, 0.5, 50) & _within(pb, 0.5, 50), made("pair", pa, pb)))
        .when(feet.isNotNull(), F.when(_within(feet, 0.3, 100), made("length", feet)))
        .when(t.rlike(_UNIT), F.when(_within(unit, 0.3, 100), made("length", unit)))
        .when(t.rlike(_MILLIMETRES), F.when(_within(mm, 0.3, 100), made("length", mm)))
        .when(t.rlike(_TWO_DECIMALS), F.when(_within(two, 0.3, 50), made("length", two)))
        .when(t.rlike(_AREA_UNIT), F.when(_within(written, 1, 500), made("area", written, None, F.lit(1))))
        .when(t.rlike(_AREA), F.when(_within(bare, 1, 500), made("area", bare, None, F.lit(0))))
    )
    return F.coalesce(value, F.struct(F.lit(None).cast("string").alias("kind"), F.lit(None).cast("double").alias("a"), F.lit(None).cast("double").alias("b"), F.lit(None).cast("int").alias("explicit")))


# Words of storey labels and their place from the ground up, the longer of two that begin
# alike first; words without which a text is no storey label; words that follow a number.
STOREYS = {
    "basement": -1.0, "cellar": -1.0, "kellari": -1.0, "lower ground": -0.5, "ground": 0.0, "pohja": 0.0, "main": 0.0, "first": 1.0, "1st": 1.0,
    "second": 2.0, "2nd": 2.0, "third": 3.0, "3rd": 3.0, "upper": 5.0, "attic": 9.0, "ullakko": 9.0, "loft": 9.0,
}
_STOREY_WORDS = r"(?i)kerros|krs\b|floor|storey|story|etage|level|basement|cellar|kellari|attic|ullakko|loft"
_STOREY_NUMBER = r"(?i)(?:^|\D)(\d)\s*[.:]?\s*(?:kerros|krs|floor|fl\b|storey|story|etage|og\b|level)"


def storey(text: Column) -> Column:
    """The ordinal of a storey label as a double, or null: a digit before a word for storey wins, else the first
    word of place counts; a text without a word for storey is no label."""
    number = F.regexp_extract(text, _STOREY_NUMBER, 1)
    word = F.lower(F.regexp_extract(text, f"(?i)({'|'.join(STOREYS)})", 1))
    places = F.create_map(*[F.lit(x) for pair in STOREYS.items() for x in pair])
    return F.when(text.rlike(_STOREY_WORDS), F.when(number != "", number.try_cast("double")).when(word != "", F.try_element_at(places, word)))


def acceptance(votes: Column, any_pair: Column, scale: Column, door_scale: Column, extent: Column) -> Column:
    """Why a voted scale is refused, or `accepted`: two independent votes or a pair; within 0.25 (log)
    of the doors' scale; an extent of 3 to 300 metres."""
    return (
        F.when((votes < 2) & ~any_pair, "few").when(F.abs(F.log(scale / door_scale)) > 0.25, "gate")
        .when((extent < 3) | (extent > 300), "extent").otherwise("accepted")
    )


def sample_id(path: Column) -> Column:
    """The last two parts of a path, joined by an underscore."""
    return F.replace(F.substring_index(F.rtrim(path, F.lit("/")), "/", -2), F.lit("/"), F.lit("_"))


def safe_name(name: Column) -> Column:
    """A file name with other characters than word, dot, dash and space as underscores, 80 at most."""
    return F.left(F.regexp_replace(name, r"[^\w. -]", "_"), F.lit(80))


def cache_key(*parts: Column) -> Column:
    """Ten hex digits of the MD5 of values as JSON."""
    return F.left(F.md5(F.to_json(F.array(*[p.cast("string") for p in parts]))), F.lit(10))
