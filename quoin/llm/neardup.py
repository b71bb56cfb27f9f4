"""Near-duplicate groups by fast similarity sketching, banding and exact verification.

Sketch: 2t rounds place a set's elements in t bins. In the first t rounds a hash chooses the bin;
in round t + i everything goes to bin i, so every bin is filled at last. A bin keeps its least
(round, hash), and rounds end as soon as all bins are filled, mostly after a few. Two sets agree in
a bin with the probability of their Jaccard similarity, and the number of agreeing bins is as
concentrated as with independent hashes.

Groups: documents of equal sets are one class. Classes that agree in a whole band of bins share a
bucket. Stars link the members of a bucket to one of its members, of the most similar sketch,
and links are verified on the full sets; then what is left between different components of a
bucket is compared by sketch, and verified. So pairs within a component are never listed.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quoin.llm.arrays import NOT_SPACE, U64, chunks, mix, prefix_sums, release, stretch_hash, utf8
from quoin.llm.exchange import known_id, row_key, shown_id, small_batches
from quoin.operators.graph import checkpointed, connected_components

WORDS = 5
PERCENT = 80
BINS = 128
BANDS = 32  # of 4 bins: a pair of similarity 0.8 shares no band once in 20 million
#: A pair whose sketches agree in fewer bins than this share is not verified: five standard
#: deviations under the threshold.
SLACK = 0.18
SPLIT = 1024  # members of a bucket that one task compares with the others
STARS = 1  # rounds of stars before buckets are compared in full

_ROUND = [mix(np.array([i + 1], dtype=U64) * U64(0x9E3779B97F4A7C15))[0] for i in range(2 * BINS)]


def sketch(elements: np.ndarray, bins: int = BINS) -> np.ndarray:
    """uint16 sketch of a set of distinct 64-bit hashes; zeros for the empty set. Two bins that differ
    have equal digests once in 65,536, far below the sketch's own error."""
    best = np.full(bins, np.iinfo(np.uint64).max, dtype=U64)
    if not len(elements):
        return np.zeros(bins, dtype=np.uint16)
    for i in range(2 * bins):
        h = mix(elements ^ _ROUND[i])
        if i < bins:
            place = (h % U64(bins)).astype(np.int64)
            np.minimum.at(best, place, (U64(i) << U64(48)) | (h >> U64(16)))
        else:
            best[i - bins] = min(best[i - bins], (U64(i) << U64(48)) | (h.min() >> U64(16)))
        if i + 1 < bins and (best >> U64(48) <= U64(i)).all():
            break
    return (mix(best) >> U64(48)).astype(np.uint16)


def shingle_sets(texts: list[bytes], words: int = WORDS) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's shingles (A-Z lower-cased, words between white space)."""
    out = []
    for chunk in chunks(texts, lower=True):
        h, _, _, first = chunk.words(NOT_SPACE)
        sums = prefix_sums(h)
        n = len(h)
        full = stretch_hash(sums, np.arange(max(0, n - words + 1)), np.arange(max(0, n - words + 1)) + words)
        for lo, hi in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            if hi - lo >= words:
                out.append(np.unique(full[lo : hi - words + 1]))
            elif hi > lo:
                out.append(stretch_hash(sums, np.array([lo]), np.array([hi])))
            else:
                out.append(np.zeros(0, dtype=U64))
    return out


SKETCHED = "doc_id long, row long, n_shingles long, set_hi long, set_lo long, sketch binary"


def sketches(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id, the row's key, n_shingles, a 128-bit hash of the set, and the sketch. No shuffle."""

    small_batches(docs.sparkSession)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            sets = shingle_sets(utf8(batch.column(2)), words)
            hi = [int(mix(s).sum().view(np.int64)) if len(s) else 0 for s in sets]
            lo = [int(mix(s ^ U64(0xA5A5A5A5A5A5A5A5)).sum().view(np.int64)) if len(s) else 0 for s in sets]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(list(map(len, sets)), pa.int64()), pa.array(hi, pa.int64()), pa.array(lo, pa.int64()), pa.array([sketch(s).tobytes() if len(s) else b"" for s in sets], pa.binary())],
                names=["doc_id", "row", "n_shingles", "set_hi", "set_lo", "sketch"],
            )
        release()

    return docs.select(known_id().alias("doc_id"), row_key().alias("row"), "text").mapInArrow(run, SKETCHED)


def _bands(classes: DataFrame) -> DataFrame:
    """(bucket, id) for each band of each class."""

    def run(batches):
        import pyarrow as pa

        width = BINS // BANDS
        number = np.arange(BANDS, dtype=U64)
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            if not len(ids):
                continue
            v = np.frombuffer(b"".join(batch.column(1).to_pylist()), dtype=np.uint16).reshape(len(ids), BANDS, width).astype(U64)
            h = np.broadcast_to(mix(number + U64(1)), (len(ids), BANDS)).copy()
            for i in range(width):
                h = mix(h ^ v[:, :, i])
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64).ravel()), pa.array(np.repeat(ids, BANDS))], names=["bucket", "id"])

    return classes.select("id", "sketch").mapInArrow(run, "bucket long, id long")


def _estimate():
    @F.pandas_udf("double")
    def agree(a, b):
        import pandas as pd

        if not len(a):
            return pd.Series([], dtype=float)
        x = np.frombuffer(b"".join(a), dtype=np.uint16).reshape(len(a), BINS)
        y = np.frombuffer(b"".join(b), dtype=np.uint16).reshape(len(b), BINS)
        return pd.Series((x == y).mean(axis=1))

    return agree


def _verify(pairs: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """Pairs (a, b) with 100 * |A & B| >= percent * |A | B| on the full sets."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            left, right = (shingle_sets(utf8(batch.column(i)), words) for i in (2, 3))
            linked = []
            for x, y in zip(left, right, strict=True):
                both = len(np.intersect1d(x, y, assume_unique=True)) if 100 * min(len(x), len(y)) >= percent * max(len(x), len(y)) else 0
                linked.append(both > 0 and 100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([pa.array([v for v, k in zip(c, linked, strict=True) if k], pa.int64()) for c in (a, b)], names=["a", "b"])
        release()

    rows = pairs.join(texts.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b")
    rows = rows.join(texts.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a")
    return rows.select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long")


def _relabel(members: DataFrame, links: DataFrame) -> DataFrame:
    """(id, label): the component of each class under the links so far."""
    found = connected_components(links)
    return checkpointed(members.join(found, "id", "left").select("id", F.coalesce("component", "id").alias("label")))


def _shared(one: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    """How many elements of a sorted set each of other sets has."""
    size = np.fromiter(map(len, others), dtype=np.int64, count=len(others))
    flat = np.concatenate(others)
    hit = one[np.minimum(np.searchsorted(one, flat), len(one) - 1)] == flat
    return np.add.reduceat(hit, np.cumsum(size) - size, dtype=np.int64)


def _across(buckets: DataFrame, labels: DataFrame, marks: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """Links (a, b) between members of one bucket and different components, one for each member and component.

    Buckets are gathered by their largest component. Members outside it are compared with all members
    of those buckets in blocks of bounded size, by sketch first and then on the full sets. Pairs never
    become rows, only links do."""
    rows = buckets.join(labels, "id")
    sizes = rows.groupBy("bucket", "label").agg(F.count("*").alias("n"))
    top = sizes.groupBy("bucket").agg(F.max(F.struct("n", "label")).alias("top"), F.count("*").alias("labels")).where("labels > 1")
    placed = rows.join(top.select("bucket", F.col("top.label").alias("main")), "bucket").select("main", "id", "label").distinct()
    count = placed.groupBy("main").agg(F.count("*").alias("n"), F.sum((F.col("label") != F.col("main")).cast("int")).alias("m"))
    blocks = lambda n: F.ceil(F.col(n) / SPLIT).cast("int")
    full = placed.join(count, "main").join(marks, "id").join(texts, "id")
    own = lambda n: F.pmod(F.xxhash64("id"), blocks(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), blocks(n) - 1))
    kept = ("id", "label", "sketch", "text")
    strays = full.where("label <> main").select("main", every("n").alias("part"), own("m").alias("block"), *kept, F.lit(True).alias("stray"))
    others = full.select("main", own("n").alias("part"), every("m").alias("block"), *kept, F.lit(False).alias("stray"))
    least = percent / 100 - SLACK

    def run(table):
        import pyarrow as pa

        ids, label, stray = (table.column(c).to_numpy() for c in ("id", "label", "stray"))
        v = np.frombuffer(b"".join(table.column("sketch").to_pylist()), dtype=np.uint16).reshape(len(ids), BINS)
        sets = shingle_sets(utf8(table.column("text").combine_chunks()), words)
        size = np.fromiter(map(len, sets), dtype=np.int64, count=len(sets))
        other = np.flatnonzero(~stray)
        a, b = [], []
        for i in np.flatnonzero(stray) if len(other) else ():
            hit = other[(label[other] != label[i]) & (100 * np.minimum(size[other], size[i]) >= percent * np.maximum(size[other], size[i]))]
            hit = hit[(v[hit] == v[i]).mean(axis=1) >= least]
            if not len(hit):
                continue
            both = _shared(sets[i], [sets[k] for k in hit])
            hit = hit[100 * both >= percent * (size[hit] + size[i] - both)]
            for k in np.unique(label[hit], return_index=True)[1]:
                a.append(int(ids[i]))
                b.append(int(ids[hit[k]]))
        release()
        return pa.table([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return strays.unionByName(others).groupBy("main", "part", "block").applyInArrow(run, "a long, b long")


def _groups(docs: DataFrame, words: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """The sketched rows, and for each class (set_hi, set_lo) its least row (doc_id, then key) as `least`
    and `id`, and those of its component as `component_id` and `head`. Classes go by the key of a row,
    not by its doc_id, which rows of other texts may have too."""
    sketched = checkpointed(sketches(docs, words))
    classes = sketched.where("n_shingles > 0").groupBy("set_hi", "set_lo").agg(F.min(F.struct("doc_id", "row")).alias("s"), F.first("sketch").alias("sketch"))
    classes = checkpointed(classes.select("set_hi", "set_lo", F.col("s.row").alias("id"), F.col("s.doc_id").alias("least"), "sketch"))
    banded = _bands(classes)
    shared = banded.groupBy("bucket").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo < hi").select("bucket")
    buckets = checkpointed(banded.join(shared, "bucket"))
    members = checkpointed(buckets.select("id").distinct())
    marks = checkpointed(classes.join(members, "id").groupBy("id").agg(F.first("sketch").alias("sketch")))
    texts = docs.select(row_key().alias("id"), "text").join(members, "id")
    texts = checkpointed(texts.groupBy("id").agg(F.max("text").alias("text")))  # rows of one key have one text
    least = percent / 100 - SLACK
    agree = _estimate()
    labels = members.select("id", F.col("id").alias("label"))
    links = None
    for turn in range(STARS):
        at = buckets.join(labels, "id")
        star = at.groupBy("bucket").agg(F.min(F.struct("label", F.xxhash64("id", F.lit(turn)).alias("draw"), "id")).alias("s"), F.max("label").alias("hi"))
        star = star.where("s.label < hi").select("bucket", F.col("s.id").alias("b"), F.col("s.label").alias("to"))
        pairs = at.join(star, "bucket").where("label <> to").select(F.col("id").alias("a"), "b").distinct()
        near = pairs.join(marks.select(F.col("id").alias("a"), F.col("sketch").alias("x")), "a").join(marks.select(F.col("id").alias("b"), F.col("sketch").alias("y")), "b")
        near = near.select("a", "b", agree("x", "y").alias("share")).where(F.col("share") >= least)
        best = near.withColumn("r", F.row_number().over(Window.partitionBy("a").orderBy(F.desc("share"), "b"))).where("r <= 2").select("a", "b")
        found = checkpointed(_verify(best, texts, words, percent))
        links = found if links is None else links.unionByName(found)
        labels = _relabel(members, links)
    found = checkpointed(_across(buckets, labels, marks, texts, words, percent))
    labels = _relabel(members, links.unionByName(found))
    labelled = classes.select("set_hi", "set_lo", "id", "least").join(labels, "id", "left").withColumn("label", F.coalesce("label", "id"))
    heads = labelled.groupBy("label").agg(F.min(F.struct("least", "id")).alias("s")).select("label", F.col("s.least").alias("component_id"), F.col("s.id").alias("head"))
    return sketched, labelled.join(heads, "label")


def components(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id (the least doc_id reachable over links), kept (is it that one).

    Null and empty texts have no shingles and are linked with nothing; equal sets of one shingle or
    more are linked; a missing doc_id is the least of all; of rows with one doc_id each gets a row, by
    its own text. Links are exact on full sets; only
    which pairs are looked at rests on the sketch (a pair at the threshold is missed less than once
    in a million).
    """
    sketched, classes = _groups(docs, words, percent)
    rows = sketched.select("doc_id", "n_shingles", "set_hi", "set_lo")
    out = rows.join(classes.select("set_hi", "set_lo", "component_id"), ["set_hi", "set_lo"], "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    told = out.select("doc_id", "n_shingles", component.alias("component_id"), (F.col("doc_id") == component).alias("kept"))
    return told.select(shown_id(), "n_shingles", shown_id("component_id"), "kept")


def deduplicate(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """The documents with one of each group of near duplicates, of the least doc_id; all columns stay.
    Rows are told apart by doc_id and text: of rows with one doc_id and equal texts one stays, and
    of those with other texts each that is no near duplicate. Rows without words are linked with
    nothing and all stay, repeated ones too; an empty table gives none."""
    _, classes = _groups(docs, words, percent)
    key, worded = "_near_duplicates_row", F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    kept = classes.where("id = head").select(F.col("id").alias(key))
    one = docs.where(worded).withColumn(key, row_key()).join(kept.distinct(), key)
    return one.dropDuplicates([key]).select(*docs.columns).unionByName(docs.where(~worded))
