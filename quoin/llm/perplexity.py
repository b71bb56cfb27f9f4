"""Scoring by an interpolated modified Kneser-Ney bigram model.

Counts are gathered in Spark and never on the driver. Batches of documents ask shards of
bigrams for their counts, then shards of words for the words' counts, continuations and numbers
of followers; a shard keeps what it has counted as sorted arrays of hashes in memory-mapped files
and looks up there what each batch asked for. A word that ends up in every text is one entry in
each batch. The few sums over the whole corpus (tokens, words, how many bigrams were seen once,
twice, ...) ride on each shard's answers.
"""

from __future__ import annotations

import struct
import tempfile
import zlib
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame

from quoin.llm.arrays import NOT_SPACE, U64, chunks, get_ints, mix, put_ints, width_of
from quoin.llm.exchange import NO_ID, batched, ordered, shown_id, shuffle_parts
from quoin.llm.repeats import _cut, _table

BATCH_BYTES = 8 << 20
SLICE = 1 << 17  # tokens scored at once
BEGIN, END = U64(0x1F83D9ABFB41BD6B), U64(0x5BE0CD19137E2179)
_KEY_BYTES = 6


def _pack(*columns: tuple[np.ndarray, int | None]) -> bytes:
    """Columns of whole numbers, each in as many bytes as its largest needs, or in a given number."""
    n = len(columns[0][0])
    widths = [w or width_of(int(c.max()) if n else 0) for c, w in columns]
    return struct.pack(f"<IB{len(widths)}B", n, len(widths), *widths) + b"".join(put_ints(c.astype(np.int64) if c.dtype != U64 else c, w) for (c, _), w in zip(columns, widths, strict=True))


def _unpack(blob: bytes, at: int = 0) -> list[np.ndarray]:
    n, k = struct.unpack_from("<IB", blob, at)
    widths = struct.unpack_from(f"<{k}B", blob, at + 5)
    at += 5 + k
    out = []
    for w in widths:
        out.append(get_ints(blob, n, w, at))
        at += n * w
    return out


class Tokens:
    """A batch's tokens with the one before each, its document, and the distinct bigrams and words."""

    def __init__(self, ids: np.ndarray, texts: list[bytes], is_training, shards: int):
        word, before, doc = [], [], []
        for chunk in chunks(texts, lower=True):
            h, _, _, first = chunk.words(NOT_SPACE)
            w = np.insert(h, first[1:], END)
            n = np.diff(first) + 1
            p = np.append(BEGIN, w[:-1])
            p[np.cumsum(n)[:-1]] = BEGIN
            word.append(w), before.append(p), doc.append(np.repeat(np.arange(len(n)) + chunk.first, n))
        empty = np.zeros(0, dtype=U64)
        self.word, self.before = (np.concatenate(x) if x else empty for x in (word, before))
        self.doc = np.concatenate(doc) if doc else np.zeros(0, dtype=np.int64)
        self.training = np.fromiter((is_training(i) for i in ids.tolist()), dtype=bool, count=len(ids))
        self.counts = self.training[self.doc] if len(self.doc) else np.zeros(0, dtype=bool)
        self.shards = shards
        self.bigram = Keys(mix(self.before * U64(0x9FB21C651E98DF25) + self.word), self.counts, shards)
        begins = np.array([BEGIN], dtype=U64)
        self.single = Keys(np.concatenate([begins, self.word]), np.concatenate([[False], self.counts]), shards)
        self.single.count[self.single.place[0]] += int(self.training.sum())


class Keys:
    """Distinct keys by shard; `place` is each token's, `count` how often it stands in training texts."""

    def __init__(self, keys: np.ndarray, counted: np.ndarray, shards: int):
        order = np.argsort(keys, kind="stable")
        s = keys[order]
        new = np.append(True, s[1:] != s[:-1]) if len(s) else np.zeros(0, dtype=bool)
        run = np.cumsum(new) - 1
        distinct = s[new]
        shard = ((distinct & U64(0xFFFF)) % U64(shards)).astype(np.int64)
        by = np.argsort(shard, kind="stable")
        rank = np.empty(len(by), dtype=np.int64)
        rank[by] = np.arange(len(by))
        self.place = np.empty(len(keys), dtype=np.int64)
        self.place[order] = rank[run]
        self.key, self.shard, self.first = distinct[by], shard[by], order[new][by]
        self.count = np.bincount(self.place, weights=counted, minlength=len(by)).astype(np.int64)


class Sorted:
    """Sums of counts by key, as sorted arrays in files that are memory-mapped for look-ups."""

    def __init__(self, folder: str, keys: np.ndarray, *values: np.ndarray):
        order = np.argsort(keys, kind="stable")
        k = keys[order]
        new = np.flatnonzero(np.append(True, k[1:] != k[:-1])) if len(k) else np.zeros(0, dtype=np.int64)
        self.first = order[new]
        self.key = self._mapped(folder, "key", k[new])
        self.value = [self._mapped(folder, f"value{i}", np.add.reduceat(v[order].astype(np.int64), new) if len(new) else v[:0].astype(np.int64)) for i, v in enumerate(values)]

    @staticmethod
    def _mapped(folder: str, name: str, data: np.ndarray) -> np.ndarray:
        path = Path(folder) / f"{name}.npy"
        np.save(path, data)
        return np.load(path, mmap_mode="r")

    def look_up(self, keys: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.key, keys)


def _seen(counts: np.ndarray) -> np.ndarray:
    """How many are 1, 2, 3, 4, and 3 or more."""
    b = np.bincount(np.minimum(counts, 5), minlength=6)
    return np.array([b[1], b[2], b[3], b[4], b[3:].sum()], dtype=np.int64)


def _answer_bigrams(blobs: list[bytes]) -> list[bytes]:
    """Each entry's count in all, and whether it is the one that reports the bigram (the first that counted it)."""
    parts = [_unpack(b) for b in blobs]
    size = [len(p[0]) for p in parts]
    key, count = (np.concatenate([p[i] for p in parts]) for i in range(2))
    with tempfile.TemporaryDirectory() as folder:
        table = Sorted(folder, key, count)
        at = table.look_up(key)
        total = np.asarray(table.value[0])[at]
        trained = np.flatnonzero(count > 0)
        reports = np.zeros(len(key), dtype=np.int64)
        _, first = np.unique(at[trained], return_index=True)
        reports[trained[first]] = 1
        head = _pack((_seen(np.asarray(table.value[0])), 8))
        del table
    cut = np.cumsum(size)[:-1]
    return [head + _pack((t, None), (r, 1)) for t, r in zip(np.split(total, cut), np.split(reports, cut), strict=True)]


def _answer_words(blobs: list[bytes]) -> list[bytes]:
    """Each entry's count, followers seen once, twice and more, and continuations, in all."""
    parts = [_unpack(b) for b in blobs]
    size = [len(p[0]) for p in parts]
    key, *values = (np.concatenate([p[i] for p in parts]) for i in range(6))
    with tempfile.TemporaryDirectory() as folder:
        table = Sorted(folder, key, *values)
        at = table.look_up(key)
        own = np.asarray(table.key) != (BEGIN >> U64(64 - 8 * _KEY_BYTES))
        count, continued = np.asarray(table.value[0])[own], np.asarray(table.value[4])[own]
        sums = np.array([count.sum(), (count > 0).sum(), continued.sum()], dtype=np.int64)
        head = _pack((np.concatenate([sums, _seen(continued)]), 8))
        found = [np.asarray(v)[at] for v in table.value]
        del table
    cut = np.cumsum(size)[:-1]
    return [head + _pack(*[(c, None) for c in columns]) for columns in zip(*[np.split(v, cut) for v in found], strict=True)]


def _discounts(n1: float, n2: float, n3: float, n4: float) -> np.ndarray:
    """Discounts for counts of 0, 1, 2, and 3 or more, from how many were seen 1 to 4 times."""
    y = n1 / (n1 + 2 * n2) if n1 else 0.0
    d = [0.0]
    for i, (a, b) in enumerate(((n1, n2), (n2, n3), (n3, n4)), 1):
        d.append(min(max(i - (i + 1) * y * b / a, 0.05 * i), 0.95 * i) if a and y else 0.5 * i)
    return np.array(d)


def log_probability(c: np.ndarray, before: list[np.ndarray], word: list[np.ndarray], bigrams: np.ndarray, words: np.ndarray) -> np.ndarray:
    """log10 of the interpolated probability of each token after the one before it.

    c: counts of the bigrams; before, word: count, followers seen once, twice, more, and
    continuations of the two; bigrams, words: the sums over the corpus."""
    d = _discounts(*bigrams[:4])
    _, distinct, types, m1, m2, m3, m4, more = words
    e = _discounts(m1, m2, m3, m4)
    uniform = 1.0 / (distinct + 1)
    if types:
        again = word[4].astype(float)
        low = (again - e[np.minimum(again, 3).astype(int)]) / types + (e[1] * m1 + e[2] * m2 + e[3] * more) / types * uniform
    else:
        low = np.full(len(c), uniform)
    n = before[0].astype(float)
    free = d[1] * before[1] + d[2] * before[2] + d[3] * before[3]
    with np.errstate(divide="ignore", invalid="ignore"):
        high = (c - d[np.minimum(c, 3)]) / n + free / n * low
    return np.log10(np.where(n > 0, high, low))


_SENT = "shard int, batch int, sort int, blob binary"
_TOLD = "batch int, sort int, shard int, blob binary"
RESULT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def score(docs: DataFrame, folds: int = 5, held: int = 1) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of each row.

    Training texts are those whose crc32 of the doc_id as text leaves another remainder by `folds`
    than `held`; so are rows without a doc_id. Null and empty texts are one token, the end; without training texts all words are
    unknown. Repeated rows are trained on and scored each. Extra columns are ignored.
    """
    rows, n = batched(docs, BATCH_BYTES)
    shards = min(1 << 16, max(n, shuffle_parts(docs.sparkSession)))
    high = U64(64 - 8 * _KEY_BYTES)

    def tokens(table) -> tuple[np.ndarray, Tokens]:
        ids, texts = ordered(table)
        return ids, Tokens(ids, texts, lambda i: i == NO_ID or zlib.crc32(str(i).encode()) % folds != held, shards)

    def send(keys: Keys, sort: int, batch: int, *columns: np.ndarray) -> list[tuple]:
        """A blob to every shard, empty or not: each answer carries the shard's sums."""
        cut = dict(_cut(keys.shard))
        return [(s, batch, sort, _pack((keys.key[c := cut.get(s, slice(0, 0))] >> high, _KEY_BYTES), *[(v[c], None) for v in columns])) for s in range(shards)]

    def ask(table):
        _, t = tokens(table)
        return _table(_SENT, send(t.bigram, 0, table.column("batch")[0].as_py(), t.bigram.count))

    def answer(table):
        sort, shard = table.column("sort")[0].as_py(), table.column("shard")[0].as_py()
        rows = sorted(zip(table.column("batch").to_pylist(), table.column("blob").to_pylist(), strict=True))
        told = (_answer_words if sort else _answer_bigrams)([b for _, b in rows])
        return _table(_TOLD, [(b, sort, shard, t) for (b, _), t in zip(rows, told, strict=True)])

    def read(told, sort: int) -> tuple[np.ndarray, list[np.ndarray]]:
        """The shards' sums and the answers in the order of the keys."""
        blobs = [b for _, k, b in sorted(zip(*(told.column(c).to_pylist() for c in ("shard", "sort", "blob")), strict=True)) if k == sort]
        heads = [_unpack(b)[0] for b in blobs]
        skip = 6 + 8 * len(heads[0])
        bodies = [_unpack(b, skip) for b in blobs]
        return np.sum([h.astype(np.int64) for h in heads], axis=0), [np.concatenate(c).astype(np.int64) for c in zip(*bodies, strict=True)]

    def ask_words(table, told):
        _, t = tokens(table)
        _, (total, reports) = read(told, 0)
        place = t.single.place
        after, ahead = place[1:][t.bigram.first], _before(t)[t.bigram.first]
        n = len(t.single.key)
        mine = reports > 0
        followers = [np.bincount(ahead[mine & which], minlength=n) for which in (total == 1, total == 2, total >= 3)]
        return _table(_SENT, send(t.single, 1, table.column("batch")[0].as_py(), t.single.count, *followers, np.bincount(after[mine], minlength=n)))

    def finish(table, told):
        import pyarrow as pa

        ids, t = tokens(table)
        bigrams, (total, _) = read(told, 0)
        words, values = read(told, 1)
        word, before = t.single.place[1:], _before(t)
        sums = np.zeros((3, len(ids)))
        for lo in range(0, len(word), SLICE):
            s = slice(lo, lo + SLICE)
            w, b = word[s], before[s]
            c = values[0][w]
            p = log_probability(total[t.bigram.place[s]], [v[b] for v in values], [v[w] for v in values], bigrams, words)
            base = np.log10((c + 0.5) / (words[0] + 0.5 * (words[1] + 1)))
            for row, x in zip(sums, (c > 0, base, p), strict=True):
                row += np.bincount(t.doc[s], weights=x, minlength=len(ids))
        columns = (ids, ~t.training, np.bincount(t.doc, minlength=len(ids)), sums[0].astype(np.int64), np.full(len(ids), words[0]), sums[1], sums[2])
        return pa.table([pa.array(x) for x in columns], names=[x.split()[0] for x in RESULT.split(", ")])

    told = rows.groupBy("batch").applyInArrow(ask, _SENT).groupBy("shard").applyInArrow(answer, _TOLD)
    told_words = rows.groupBy("batch").cogroup(told.groupBy("batch")).applyInArrow(ask_words, _SENT).groupBy("shard").applyInArrow(answer, _TOLD)
    done = rows.groupBy("batch").cogroup(told.unionByName(told_words).groupBy("batch")).applyInArrow(finish, RESULT)
    return done.withColumn("doc_id", shown_id())


def _before(t: Tokens) -> np.ndarray:
    """The place, among the words, of the token before each token."""
    place = t.single.place
    return np.where(t.before == BEGIN, place[0], place[:-1])
