"""Benchmark decontamination with a positional inverted index of the training text.

The index is cut by document: a segment holds the sorted terms of some whole documents with the
positions of each, so building needs no shuffle and a segment's size is bounded whatever the
frequency of a term. It is stored, with the postings of all terms, before it is searched: each block of
the benchmark, or another benchmark later, reads it and not the texts. A query is a benchmark window. In each segment its terms are taken from the
rarest up: the rarest term's positions, less its offset, are the candidate places; every further
list, offset-adjusted, is intersected with them.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quoin.llm.arrays import ALNUM, U64, Chunk, chunks, release, utf8
from quoin.llm.exchange import known_id, small_batches
from quoin.operators.graph import checkpointed

WINDOW = 10
BLOCK_WORDS = 2_000_000  # of benchmark text, broadcast at once; larger benchmarks take several blocks

INDEX = "doc_ids array<long>, first array<long>, terms binary, sizes binary, positions binary"


def _terms(text: bytes) -> np.ndarray:
    return Chunk([text], 0, lower=True).words(ALNUM)[0]


def build_index(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Segments of about half a megabyte of text: doc_ids; each document's first word (one more at the
    end); terms (sorted distinct 64-bit hashes), how many postings each has, and the postings' positions
    (of words, ascending, in the terms' order). Write it anywhere, or give it to `search` at once."""

    small_batches(docs.sparkSession)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), utf8(batch.column(1))
            for chunk in chunks(texts, lower=True):
                h, _, _, first = chunk.words(ALNUM)
                order = np.argsort(h, kind="stable").astype(np.uint32)
                terms, sizes = np.unique(h, return_counts=True)
                row = [ids[chunk.first : chunk.first + len(chunk.texts)]], [first.tolist()], [terms.tobytes()], [sizes.astype(np.uint32).tobytes()], [order.tobytes()]
                kinds = (pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(row, kinds, strict=True)], names=["doc_ids", "first", "terms", "sizes", "positions"])
        release()

    return docs.select(F.col(key).cast("long"), text).mapInArrow(run, INDEX)


class Queries:
    """Windows of benchmark items: terms[window, offset] (0 past the end of a short one), width and item of each."""

    def __init__(self, items: list[tuple[int, str | None]], window: int = WINDOW):
        rows, width, owner = [], [], []
        for item, text in items:
            h = _terms((text or "").encode())
            for s in range(max(1, len(h) - window + 1) if len(h) else 0):
                part = h[s : s + window]
                rows.append(np.pad(part, (0, window - len(part))))
                width.append(len(part))
                owner.append(item)
        self.terms = np.array(rows, dtype=U64).reshape(len(rows), window)
        self.width, self.item = np.array(width, dtype=np.int64), np.array(owner, dtype=np.int64)


class Segment:
    """One row of the index, ready to be searched."""

    def __init__(self, first, terms: bytes, sizes: bytes, positions: bytes):
        self.first = np.asarray(first, dtype=np.int64)
        self.position = np.frombuffer(positions, dtype=np.uint32).astype(np.int64)
        self.term = np.frombuffer(terms, dtype=U64)
        size = np.frombuffer(sizes, dtype=np.uint32).astype(np.int64)
        self.lo = np.append(0, np.cumsum(size))
        self.posting = (np.repeat(np.arange(len(size), dtype=np.int64), size) << 32) | self.position

    def ranks(self, terms: np.ndarray) -> np.ndarray:
        """The place of each term among the segment's, -1 where it isn't."""
        if not len(self.term):
            return np.full(terms.shape, -1)
        at = np.minimum(np.searchsorted(self.term, terms), len(self.term) - 1)
        return np.where(self.term[at] == terms, at, -1)

    def _candidates(self, queries: Queries, of_first: bool = False):
        """The windows all of whose terms are here, their terms' ranks and order from the rarest up, and for each
        posting of the rarest term, or of the first, the window (as its place among those) and the position."""
        width = queries.terms.shape[1]
        rank = self.ranks(queries.terms)
        used = np.arange(width) < queries.width[:, None]
        alive = np.flatnonzero(((rank >= 0) | ~used).all(axis=1)) if len(rank) else np.zeros(0, dtype=np.int64)
        if not len(alive):
            return alive, rank[:0], rank[:0], alive, alive
        rank = rank[alive]
        count = np.where(used[alive], np.diff(self.lo)[rank], np.iinfo(np.int64).max)
        order = np.argsort(count, axis=1, kind="stable")
        at = rank[:, 0] if of_first else rank[np.arange(len(alive)), order[:, 0]]
        n = np.diff(self.lo)[at]
        which = np.repeat(np.arange(len(alive)), n)
        inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        return alive, rank, order, which, self.position[self.lo[at][which] + inside]

    def phrases(self, queries: Queries) -> tuple[np.ndarray, np.ndarray]:
        """(window, position) of every exact occurrence; windows don't cross documents."""
        alive, rank, order, which, position = self._candidates(queries)
        if not len(alive):
            return alive, alive
        width = queries.width[alive]
        start = position - order[which, 0]
        for step in range(1, queries.terms.shape[1]):
            off = order[which, step]
            wanted = (rank[which, off] << 32) | np.maximum(start + off, 0)
            hit = np.minimum(np.searchsorted(self.posting, wanted), len(self.posting) - 1)
            ok = (start >= 0) & ((off >= width[which]) | (self.posting[hit] == wanted))
            which, start = which[ok], start[ok]
        doc = np.searchsorted(self.first, start, side="right")
        last = np.searchsorted(self.first, start + width[which] - 1, side="right")
        ok = (start >= 0) & (doc == last)
        return alive[which[ok]], start[ok]

    def near(self, queries: Queries, within: int) -> tuple[np.ndarray, np.ndarray]:
        """(window, position) of each posting of a window's first term that has every other term of the window
        at most `within` words away, in any order, in the same document; the rarest are looked for first."""
        alive, rank, order, which, position = self._candidates(queries, True)
        if not len(alive):
            return alive, alive
        width = queries.width[alive]
        for step in range(queries.terms.shape[1]):
            doc = np.searchsorted(self.first, position, side="right")
            lo = np.maximum(position - within, self.first[doc - 1])
            hi = np.minimum(position + within, self.first[doc] - 1)
            off = order[which, step]
            term = rank[which, off] << 32
            hit = np.minimum(np.searchsorted(self.posting, term | lo), len(self.posting) - 1)
            ok = (off >= width[which]) | ((self.posting[hit] >= term | lo) & (self.posting[hit] <= term | hi))
            which, position = which[ok], position[ok]
        return alive[which], position


def item_blocks(benchmark: DataFrame, block_words: int = BLOCK_WORDS, key: str = "item_id", text: str = "text"):
    """The benchmark in blocks of bounded size, streamed to the driver one partition at a time."""
    block, words = [], 0
    for item, body in benchmark.select(known_id(key), text).toLocalIterator():
        block.append((item, body))
        words += len(body or "") // 4 + 1
        if words >= block_words:
            yield block
            block, words = [], 0
    if block:
        yield block


FOUND = "ordinal int, doc_id long, n_words long, spans array<struct<start:long,end:long>>, items array<long>, near array<long>"


def search(index: DataFrame, queries: Queries, within: int | None = None) -> DataFrame:
    """One row for each document of the index: its place in its segment, its words, the merged spans hit, the items
    found there, and with `within` those that have a window with all its terms so near each other."""
    kept = [c for c in index.columns if c not in [x.split()[0] for x in INDEX.split(", ")]]

    def run(batches):
        import pyarrow as pa

        def by_doc(segment, n, window, start):
            doc = np.searchsorted(segment.first, start, side="right") - 1
            order = np.lexsort([start, doc])
            return window[order], start[order], np.searchsorted(doc[order], np.arange(n + 1))

        for batch in batches:
            columns = {name: batch.column(i).to_pylist() for i, name in enumerate(batch.schema.names)}
            for row in zip(*(columns[c] for c in ("doc_ids", "first", "terms", "sizes", "positions", *kept)), strict=True):
                ids, segment, n = row[0], Segment(*row[1:5]), len(row[0])
                window, start, bound = by_doc(segment, n, *segment.phrases(queries))
                close, _, edge = by_doc(segment, n, *segment.near(queries, within)) if within is not None else (window, start, np.zeros(n + 1, dtype=np.int64))
                spans, items, near = [], [], []
                for d in range(n):
                    s = slice(bound[d], bound[d + 1])
                    items.append(np.unique(queries.item[window[s]]).tolist())
                    near.append(np.unique(queries.item[close[edge[d] : edge[d + 1]]]).tolist())
                    merged: list[dict] = []
                    for a, w in zip(start[s] - segment.first[d], queries.width[window[s]], strict=True):
                        if merged and a <= merged[-1]["end"]:
                            merged[-1]["end"] = max(merged[-1]["end"], int(a + w))
                        else:
                            merged.append({"start": int(a), "end": int(a + w)})
                    spans.append(merged)
                kinds = (pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.list_(pa.int64()), pa.list_(pa.int64()), *[pa.int64()] * len(kept))
                values = (range(n), ids, np.diff(segment.first).tolist(), spans, items, near, *[[x] * n for x in row[5:]])
                yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds, strict=True)], names=[*[x.split()[0] for x in FOUND.split(", ")][:6], *kept])
        release()

    return index.mapInArrow(run, ", ".join([FOUND, *(f"{c} long" for c in kept)]))


def find_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS, within: int | None = None, index: DataFrame | None = None) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of each document; with `within`, near_items, too:
    the items that have a window all of whose words stand there at most so far from its first word.

    Null and empty texts have no words; items without words hit nothing; equal items are all
    listed; items without an id go by the least number. Repeated doc_ids, and missing ones, give a
    row each. No documents give no rows, no items leave all clean; other columns are ignored; a very long
    text is a segment by itself. The index (a stored one may be given in place of that of docs) is kept in
    the checkpoint folder. The driver holds one block of the benchmark at a time; each is searched for
    in the whole index, and what blocks find is joined by segment and place, so rows never mix.
    """
    index = checkpointed(build_index(docs)) if index is None else index
    index = index.withColumn("_segment", F.monotonically_increasing_id())
    parts: list[DataFrame] = []
    blocks = item_blocks(benchmark, block_words)
    block = next(blocks, [])
    while block is not None:
        after = next(blocks, None)
        part = search(index, Queries(block, window), within)
        parts.append(part if after is None and not parts else checkpointed(part))
        block = after
    found = parts[0]
    if len(parts) > 1:
        for part in parts[1:]:
            found = found.unionByName(part)
        every = lambda c: F.array_distinct(F.flatten(F.collect_list(c))).alias(c)
        found = found.groupBy("_segment", "ordinal").agg(F.max("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"), F.flatten(F.collect_list("spans")).alias("spans"), every("items"), every("near"))
        found = found.withColumn("spans", _merged("spans"))
    hits = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    names = F.array_join(F.array_sort(F.transform("items", lambda i: i.cast("string"))), ",")
    near = [F.array_sort("near").alias("near_items")] if within is not None else []
    return found.select("doc_id", "n_words", hits.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(names, 256).alias("items_sha256"), (hits > 0).alias("contaminated"), *near)


def _merged(column: str):
    """Sorted spans with those that overlap or touch joined."""
    empty = F.array().cast("array<struct<start:bigint,end:bigint>>")

    def step(done, s):
        last = F.try_element_at(done, F.lit(-1))
        grown = F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"))
        return F.when((F.size(done) > 0) & (s["start"] <= last["end"]), F.concat(F.slice(done, 1, F.size(done) - 1), F.array(grown))).otherwise(F.concat(done, F.array(s)))

    return F.aggregate(F.array_sort(column), empty, step)


def sha(items: list[int]) -> str:
    """items_sha256 of some items, as find_contaminated gives it."""
    return hashlib.sha256(",".join(sorted(map(str, items))).encode()).hexdigest()
