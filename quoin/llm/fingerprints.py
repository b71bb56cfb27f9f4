"""Lempel-Ziv phrase fingerprints.

A text is parsed into dictionary phrases: each phrase is the longest one seen before plus one
byte. The set of phrases is hashed and its `size` smallest hashes are the fingerprint, so the
share of common smallest hashes estimates how many phrases two texts have in common, which is
what makes one text help to compress the other.
"""

from __future__ import annotations

import bisect
import gc
import hashlib
import math
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quoin.llm.arrays import prefix_sums, release, stretch_hash
from quoin.llm.exchange import MOST_BYTES, known_id, shown_id, small_batches

SIZE = 128
SLICE_BYTES = 16 << 20
START = 64  # characters of a text that take part in cutting the rows of one doc_id


def _parse(data: bytes, at: int, node: dict, root: dict, ends: list[int], grown: list | None) -> dict:
    """Parse data[at:] on from `node`; append the ends of new phrases, and to `grown` what to undo."""
    end, start, note = ends.append, root, grown.append if grown is not None else None
    for at, c in enumerate(data[at:] if at else data, at + 1):
        if c in node:
            node = node[c]
        else:
            node[c] = {}
            end(at)
            if note:
                note((node, c))
            node = start
    return node


def _common(a: bytes, b: bytes) -> int:
    """Length of the common prefix, in steps of halves."""
    lo, hi = 0, min(len(a), len(b))
    while lo < hi:
        mid = (lo + hi + 1) // 2
        if a[lo:mid] == b[lo:mid]:
            lo = mid
        else:
            hi = mid - 1
    return lo


def phrase_ends(text: bytes, edited: bytes | None = None) -> tuple[list[int], list[int]]:
    """Ends of the phrases of a text and of an edited version of it, whose common start is parsed once."""
    root: dict = {}
    shared: list[int] = []
    if edited is None:
        _parse(text, 0, root, root, shared, None)
        return shared, []
    cut = _common(text, edited)
    node = _parse(text[:cut], 0, root, root, shared, None)
    grown: list = []
    own = list(shared)
    _parse(text, cut, node, root, own, grown)
    for parent, c in reversed(grown):
        del parent[c]
    _parse(edited, cut, node, root, shared, None)
    return own, shared


def smallest(texts: list[bytes], ends: list[list[int]], size: int = SIZE) -> list[np.ndarray]:
    """The `size` smallest 32-bit hashes of each text's set of phrases, ascending."""
    base = np.cumsum([0, *map(len, texts)])
    sums = prefix_sums(np.frombuffer(b"".join(texts), dtype=np.uint8))
    count = np.fromiter(map(len, ends), dtype=np.int64, count=len(ends))
    flat = np.fromiter(chain.from_iterable(ends), dtype=np.int64, count=int(count.sum()))
    row = np.repeat(np.arange(len(ends)), count)
    start = np.concatenate([[0], flat[:-1]])[: len(flat)]
    first = np.cumsum(count) - count
    start[first[count > 0]] = 0
    h = stretch_hash(sums, start + base[row], flat + base[row]) >> np.uint64(32)
    keys = np.sort((row.astype(np.uint64) << np.uint64(32)) | h)
    keys = keys[np.append(True, keys[1:] != keys[:-1])] if len(keys) else keys
    owner = (keys >> np.uint64(32)).astype(np.int64)
    bound = np.searchsorted(owner, np.arange(len(ends) + 1))
    low = (keys & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    return [low[bound[i] : min(bound[i + 1], bound[i] + size)] for i in range(len(ends))]


def likeness(a: np.ndarray, b: np.ndarray, size: int = SIZE) -> float:
    """Estimated share of common phrases; 1 for two empty fingerprints."""
    union = np.union1d(a, b)[:size]
    if not len(union):
        return 1.0
    return float(np.isin(union, np.intersect1d(a, b, assume_unique=True), assume_unique=True).mean())


def to_hex(fingerprint: np.ndarray) -> str:
    return fingerprint.astype(">u4").tobytes().hex()


def from_hex(text: str) -> np.ndarray:
    return np.frombuffer(bytes.fromhex(text or ""), dtype=">u4").astype(np.uint32)


def fingerprint(docs: DataFrame, text: str = "text", into: str = "fingerprint", size: int = SIZE) -> DataFrame:
    """Add a column with each row's fingerprint. Null and empty texts get an empty one; no shuffle."""

    small_batches(docs.sparkSession, 500)

    @F.pandas_udf("string")
    def of(texts):
        import pandas as pd

        raw = [(x or "").encode() for x in texts]
        return pd.Series([to_hex(x) for x in smallest(raw, [phrase_ends(x)[0] for x in raw], size)])

    return docs.withColumn(into, of(F.col(text)))


def _cuts(docs: DataFrame, slice_bytes: int) -> tuple[list[int], list[str]]:
    """Keys (~doc_id, start of the text) of the first row of every slice, ascending; none without rows.

    Cuts after the first are every fourth of about four rows a slice, drawn by a hash of the row, so they are
    the same whatever the partitioning, and an id of very many rows is cut by its texts."""
    key = F.struct(F.bitwise_not("doc_id").alias("rank"), F.substring("text", 1, START).alias("start"))
    told = docs.agg(F.sum(F.octet_length("text")).alias("bytes"), F.count("*").alias("n"), F.min(key).alias("least")).first()
    if not told.n:
        return [], []
    size = max(slice_bytes, min(MOST_BYTES, math.isqrt(told.bytes * 4096)))
    slices = max(math.ceil(told.bytes / size), min(24, math.ceil(told.bytes / (1 << 18))), 1)
    every = max(1, told.n // (4 * slices))
    drawn = docs.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(every)) == 0) if slices > 1 else docs.limit(0)
    drawn = drawn.groupBy(key.alias("key")).agg(F.count("*").alias("n")).select("key.rank", "key.start", "n").toArrow()
    keys = sorted(zip(drawn.column(0).to_pylist(), drawn.column(1).to_pylist(), drawn.column(2).to_pylist(), strict=True))
    step = max(1, sum(n for _, _, n in keys) // slices)
    found, passed = [tuple(told.least)], 0
    for rank, start, n in keys:
        if passed >= step and (rank, start) > found[-1]:
            found.append((rank, start))
            passed = 0
        passed += n
    return [rank for rank, _ in found], [start for _, start in found]


def in_descending_order(docs: DataFrame, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """Rows (slice, extra, doc_id, text), so that sorting a slice puts each row's successor after it.

    The successor is the next row by descending doc_id (ties: by text), the first row after the
    last. Slices are ranges of (doc_id, start of the text) of a size that grows with the square root of the
    input; each slice also gets the first row of the one after it, marked extra. The driver holds about four keys a
    slice. Rows of one doc_id that begin with the same START characters share a slice, and stream through it."""
    docs = docs.select(known_id().alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    ranks, starts = _cuts(docs, slice_bytes)
    n = len(ranks)
    if not n:
        return docs.select(F.lit(0).alias("slice"), F.lit(False).alias("extra"), "doc_id", "text")
    order = np.array(ranks, dtype=np.int64)

    @F.pandas_udf("array<int>")
    def places(rank, start):
        import pandas as pd

        key = rank.to_numpy(dtype=np.int64)
        lo, hi = np.searchsorted(order, key, "left"), np.searchsorted(order, key, "right")
        at = hi - 1
        first = np.zeros(len(key), dtype=bool)
        for i in np.flatnonzero(lo < hi):  # ids that are a cut's: their texts decide
            at[i] = bisect.bisect_right(starts, start.iat[i], lo[i], hi[i]) - 1
            first[i] = at[i] >= lo[i] and starts[at[i]] == start.iat[i]
        return pd.Series([[k, (k or n) - 1] if f else [k] for k, f in zip(at.tolist(), first.tolist(), strict=True)], dtype=object)

    at = places(F.bitwise_not("doc_id"), F.substring("text", 1, START))
    rows = docs.select(F.posexplode(at).alias("extra", "slice"), "doc_id", "text").select("slice", (F.col("extra") > 0).alias("extra"), "doc_id", "text")
    return rows.repartitionById(n, F.col("slice")).sortWithinPartitions("slice", "extra", F.desc("doc_id"), "text")


RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def with_edits(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """Fingerprints of each text and of its edit, whose last half comes from the row that follows.

    Null counts as an empty text, a missing doc_id as the least of all; repeated rows are each given a result; a single row follows
    itself. Rows stream through a range-partitioned sort, so no group is held in memory.
    """

    small_batches(docs.sparkSession, 500)

    def run(batches):
        import pyarrow as pa

        gc.disable()  # tries are trees: counting references frees them
        held: list = []

        def emit(rows):
            out: dict[str, list] = {c.split()[0]: [] for c in RESULT.split(", ")}
            texts, edits, ends, edit_ends, used = [], [], [], [], []
            for (_, extra, doc_id, text, raw), after in zip(rows, rows[1:], strict=False):
                if extra:
                    continue
                cut = len(text) - len(text) // 2
                edit = (text[:cut] + after[3][: len(text) // 2]).encode()
                a, b = phrase_ends(raw, edit)
                texts.append(raw), edits.append(edit), ends.append(a), edit_ends.append(b), used.append((doc_id, len(text)))
            marks = smallest(texts, ends, size)
            other = smallest(edits, edit_ends, size)
            tail = smallest([rows[-1][4]], [phrase_ends(rows[-1][4])[0]], size)[0]
            at = -1
            for i, row in enumerate(rows[:-1]):
                if row[1]:
                    continue
                at += 1
                if i + 1 == len(rows) - 1:
                    nxt = tail
                elif rows[i + 1][1]:
                    nxt = smallest([rows[i + 1][4]], [phrase_ends(rows[i + 1][4])[0]], size)[0]
                else:
                    nxt = marks[at + 1]
                out["doc_id"].append(used[at][0])
                out["n_chars"].append(used[at][1])
                out["edited_sha256"].append(hashlib.sha256(edits[at]).hexdigest())
                out["fingerprint"].append(to_hex(marks[at]))
                out["edited_fingerprint"].append(to_hex(other[at]))
                out["near_edited"].append(likeness(marks[at], other[at], size))
                out["near_next"].append(likeness(marks[at], nxt, size))
            kinds = {"doc_id": pa.int64(), "n_chars": pa.int64(), "near_edited": pa.float64(), "near_next": pa.float64()}
            return pa.RecordBatch.from_arrays([pa.array(v, kinds.get(k, pa.string())) for k, v in out.items()], names=list(out))

        limit = 4 << 20
        size_now = 0
        try:
            for batch in batches:
                columns = [batch.column(i).to_pylist() for i in range(batch.num_columns)]
                for part, extra, doc_id, text in zip(*columns, strict=True):
                    raw = text.encode()
                    held.append((part, extra, doc_id, text, raw))
                    size_now += len(raw)
                    if size_now > limit and len(held) > 1:
                        yield emit(held)
                        held, size_now = held[-1:], len(raw)
            if len(held) > 1:
                yield emit(held)
        finally:
            gc.enable()
            release()

    return in_descending_order(docs).mapInArrow(run, RESULT).withColumn("doc_id", shown_id())
