"""Best-fit packing into sequences of several permitted lengths.

Only how many pieces there are of each length decides the plan, and a length is at most the
largest permitted sequence. So the plan is made on the driver from that bounded histogram
(best fit, longest first, opening the bin size of least cost), and rows find their place in it
by their rank among pieces of equal length.
"""

from __future__ import annotations

import bisect
from collections.abc import Callable, Sequence
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quoin.operators.graph import checkpointed

LENGTHS = (512, 1024, 2048, 4096)
GROUP_ROWS = 50_000


class Pattern(NamedTuple):
    """`count` equal bins: the permitted length, and the pieces' lengths in order."""

    capacity: int
    pieces: tuple[int, ...]
    count: int


def padded_cost(capacity: int) -> float:
    """Cost of a sequence: its tokens, padding included, and a fixed share for starting one."""
    return capacity + 32.0


def plan(histogram: dict[int, int], lengths: Sequence[int], cost: Callable[[int], float] = padded_cost) -> list[Pattern]:
    """Bins for all pieces. Pieces go, longest first, to the open bin with least room that holds
    them; if there is none, a bin opens of the size whose cost is least for each token that it can
    be expected to hold (its piece and shorter ones still to come). At last each bin shrinks to
    the least permitted length that holds its pieces. Equal bins stay together, so the work goes
    with the number of different lengths, not with the number of pieces."""
    lengths = sorted(lengths)
    left = sorted(((n, c) for n, c in histogram.items() if c > 0), reverse=True)
    rooms: list[int] = []  # ascending
    open_bins: dict[int, list[list]] = {}  # room: [pieces, bins, capacity]
    waiting = sum(n * c for n, c in left)

    def put(room: int, pieces: tuple[int, ...], count: int, capacity: int) -> None:
        if room not in open_bins:
            bisect.insort(rooms, room)
            open_bins[room] = []
        open_bins[room].append([pieces, count, capacity])

    done: list[tuple[tuple[int, ...], int, int]] = []
    shortest = left[-1][0] if left else 0
    for n, count in left:
        waiting -= n * count
        while count:
            i = bisect.bisect_left(rooms, n)
            if i < len(rooms):
                room = rooms[i]
                pieces, bins, capacity = open_bins[room].pop()
                if not open_bins[room]:
                    del open_bins[room]
                    rooms.pop(i)
                fit = room // n
                full = min(bins, count // fit)
                rest = bins - full
                if full:
                    after = room - fit * n
                    (put(after, pieces + (n,) * fit, full, capacity) if after >= shortest else done.append((pieces + (n,) * fit, full, capacity)))
                    count -= full * fit
                if rest and count and count < fit:
                    after = room - count * n
                    (put(after, pieces + (n,) * count, 1, capacity) if after >= shortest else done.append((pieces + (n,) * count, 1, capacity)))
                    rest, count = rest - 1, 0
                if rest:
                    put(room, pieces, rest, capacity)
            else:
                ahead = waiting + n * count
                best = min((c for c in lengths if c >= n), key=lambda c: (cost(c) / max(n, min(c, ahead)), c))
                put(best, (), max(1, -(-count // (best // n))), best)
    for room, bins in open_bins.items():
        done += [(pieces, count, capacity) for pieces, count, capacity in bins if pieces]
    merged: dict[tuple[int, ...], int] = {}
    for pieces, count, _ in done:
        merged[pieces] = merged.get(pieces, 0) + count
    fitted = lambda pieces: next(c for c in lengths if c >= sum(pieces))
    return [Pattern(fitted(p), p, c) for p, c in sorted(merged.items(), key=lambda x: (-sum(x[0]), x[0]))]


def token_count(text: str = "text"):
    """Words between white space; null has none. The default count of a text's tokens."""
    return F.coalesce(F.size(F.filter(F.split(F.col(text), r"[\x20\x09-\x0D]+"), lambda w: w != "")), F.lit(0))


def pack(docs: DataFrame, lengths: Sequence[int] = LENGTHS, n_tokens=None, key: str = "doc_id", cost: Callable[[int], float] = padded_cost) -> DataFrame:
    """One row for each piece: its bin, the bin's permitted length and the piece's place in it.

    Returns key, piece, start_token, piece_tokens, bin_id, bin_tokens (the permitted length),
    bin_start (the piece's first place in the bin). A text longer than the largest length is cut
    into pieces of that length and a rest; a text without tokens (null, empty) is one piece of no tokens,
    in bin -1 of length 0. Repeated keys, and rows without one, are packed as so many rows; no rows
    give no rows; other columns are ignored. Nothing is dropped. Texts are split into tokens once:
    pieces, without texts, are kept in the checkpoint folder.
    """
    largest = max(lengths)
    count = (token_count() if n_tokens is None else n_tokens).cast("long")
    rows = docs.select(F.col(key).alias(key), count.alias("_n"))
    rows = rows.select(key, "_n", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.ceil(F.col("_n") / largest) - 1, F.lit(0)).cast("long"))).alias("piece"))
    rows = rows.select(
        key, "piece", (F.col("piece") * largest).alias("start_token"),
        F.least(F.lit(largest).cast("long"), F.col("_n") - F.col("piece") * largest).alias("piece_tokens"),
        F.pmod(F.xxhash64(key, "piece"), F.lit(1 << 16)).cast("int").alias("_salt"),
    )
    rows = checkpointed(rows)
    salted = rows.groupBy("piece_tokens", "_salt").agg(F.count("*").alias("_c"))
    return _placed(rows, salted, lengths, key, cost)


def _placed(rows: DataFrame, salted: DataFrame, lengths: Sequence[int], key: str, cost) -> DataFrame:
    histogram = {r[0]: r[1] for r in rows.groupBy("piece_tokens").count().collect()}  # at most max(lengths) + 1 rows
    most = max(histogram.values(), default=1)
    splits = max(1, -(-most // GROUP_ROWS), min(64, -(-most // 500)))  # some groups for each core, of a bounded size
    splits = min(1 << 16, splits)
    patterns = plan({n: c for n, c in histogram.items() if n}, lengths, cost)

    # Ranges of ranks: the pieces of length n with ranks in [lo, hi) fill the same slot of equal bins, `fit` to
    # a bin. Each length opens or splits at most a few groups of equal bins and a bin has at most about
    # sqrt(2 * largest) different lengths, so their number is bounded by the largest length alone.
    ranges, first, taken = [], 0, dict.fromkeys(histogram, 0)
    for p in patterns:
        at = 0
        for n in dict.fromkeys(p.pieces):
            fit = p.pieces.count(n)
            ranges.append((n, taken[n], fit, first, at, p.capacity))
            taken[n] += fit * p.count
            at += fit * n
        first += p.count
    ranges.append((0, 0, 1 << 60, -1, 0, 0))
    table = np.array(sorted(ranges), dtype=np.int64)
    # one number for (length, rank): ranks of a length go on from those of all shorter ones
    sizes = np.unique(table[:, 0])
    shorter = np.append(0, np.cumsum([histogram.get(n, 0) for n in sizes.tolist()]))[:-1]
    start = shorter[np.searchsorted(sizes, table[:, 0])] + table[:, 1]

    @F.pandas_udf("bin_id long, bin_tokens long, bin_start long")
    def place(tokens, rank):
        import pandas as pd

        n, r = tokens.to_numpy(dtype=np.int64), rank.to_numpy(dtype=np.int64)
        _, lo, fit, first, at, capacity = table[np.searchsorted(start, shorter[np.searchsorted(sizes, n)] + r, side="right") - 1].T
        return pd.DataFrame({"bin_id": first + (r - lo) // fit, "bin_tokens": capacity, "bin_start": at + (r - lo) % fit * n})

    # rank among equal lengths: groups of a bounded size by a salt, then the counts of the salts before
    rows = rows.withColumn("_salt", F.col("_salt") % splits)
    before = Window.partitionBy("piece_tokens").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = salted.groupBy("piece_tokens", (F.col("_salt") % splits).alias("_salt")).agg(F.sum("_c").alias("_c"))
    offsets = offsets.select("piece_tokens", "_salt", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_before"))
    within = Window.partitionBy("piece_tokens", "_salt").orderBy(key, "piece")
    ranked = rows.withColumn("_r", F.row_number().over(within) - 1).join(offsets, ["piece_tokens", "_salt"])
    ranked = ranked.withColumn("_rank", F.col("_r") + F.col("_before"))
    told = ranked.withColumn("_told", place("piece_tokens", "_rank"))
    return told.select(key, "piece", "start_token", "piece_tokens", "_told.bin_id", "_told.bin_tokens", "_told.bin_start")
