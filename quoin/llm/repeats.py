"""Exact removal of repeated stretches: the machinery shared by suffix-array and substring dedup.

A gram is a stretch of `gram` tokens (bytes or words). It is removed where an equal gram starts
earlier. Neither operator has a row for each position:

1. Winnowing: each gram is assigned to its least `anchor`-token hash, so equal grams have equal
   anchors at equal places. The grams of one anchor are neighbours; they and the tokens that they
   cover are its context. Batches tell each shard their anchors; an anchor that stands nowhere else
   with the same tokens to its left or to its right ends here, for none of its grams can be repeated.
   This is a filter and decides no removal.
2. What is left goes to the anchors' shards as text, each different context of a batch once, at its
   first place. So all equal grams of the corpus meet in one shard. Op 4 puts a shard's stretches in
   suffix order and takes from the previous and next smaller documents the longest previous factors
   (`longest_previous_factor`); op 5 joins the stretches on their anchors and extends the matches
   word by word both ways (`earlier_by_extension`). The answers are one bit a gram.
3. A batch applies the answers to all equals of what it sent, and joins what is removed to spans.

A context that a third of all documents share is one entry in each batch, so no shard's load follows
the size of a group of copies. Anchors with very many contexts, whose grams would meet in one shard,
are dealt out by their grams' own hashes.
"""

from __future__ import annotations

import struct
from itertools import compress
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quoin.llm.arrays import NOT_SPACE, U64, chunks, get_ints, mix, prefix_sums, put_ints, release, sliding_min, stretch_hash, width_of, window_hash
from quoin.llm.exchange import batched, ordered, shown_id, shuffle_parts

SHARED, MANY = 1, 2
ENTRY = 9  # bytes of an anchor's entry: five of its hash, two of its mark, one for each side
SLICE = 1 << 16  # tokens, or bytes of text, worked on at once: numpy's columns of them stay in a core's cache
MANY_CONTEXTS = 2048  # of an anchor; beyond them its grams are dealt out by their own hashes
_HEAD = struct.Struct("<qIBB")


class Kind(NamedTuple):
    gram: int
    anchor: int
    words: bool  # tokens are words, and earlier places in the same document count


def ranges(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... for count[0] numbers, then from start[1], ..."""
    last = np.cumsum(count)
    return np.repeat(start - last + count, count) + np.arange(last[-1] if len(last) else 0)


def distinct(key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The first place of each different key, which of them each key is, and how often it stands there."""
    n = len(key)
    bits = U64(max(1, (n - 1).bit_length()))
    order = np.sort((key >> bits << bits) | np.arange(n, dtype=U64))  # many times faster than a sort of places
    order = (order & ((U64(1) << bits) - U64(1))).astype(np.int64)
    key = key[order]
    top = key >> bits
    new = np.append(True, key[1:] != key[:-1])[:n]
    if np.any(new[1:] & (top[1:] == top[:-1])):  # keys that differ in their last bits only
        return np.unique(key[np.argsort(order)], return_index=True, return_inverse=True, return_counts=True)[1:]
    which = np.empty(n, dtype=np.int64)
    which[order] = np.cumsum(new) - 1
    at = np.flatnonzero(new)
    return order[at], which, np.diff(np.append(at, n))


def by_shard(shard: np.ndarray) -> np.ndarray:
    """The stable order of shards; numbers of 16 bits are counted into place, not compared."""
    return np.argsort(shard.astype(np.uint16) if int(shard.max(initial=0)) < 1 << 16 else shard, kind="stable")


class Part:
    """A chunk's tokens, each document's first and last + 1, and the tokens' bytes."""

    def __init__(self, chunk, kind: Kind):
        self.chunk = chunk
        if kind.words:
            self.tokens, self.byte, self.byte_end, first = chunk.words(NOT_SPACE)
            self.start, self.end = first[:-1], first[1:]
        else:
            self.tokens, self.start, self.end = chunk.buf, chunk.start, chunk.end
            self.byte = self.byte_end = None
        self.n = len(self.tokens)

    def slices(self):
        """Runs of whole documents (first, last + 1) of about SLICE tokens."""
        first = 0
        while first < len(self.start):
            last = max(first + 1, int(np.searchsorted(self.end, self.start[first] + SLICE, side="right")))
            yield first, last
            first = last

    def span(self, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the bytes of tokens[lo:hi] of each pair begin and end."""
        return (lo, hi) if self.byte is None else (self.byte[lo], self.byte_end[hi - 1])


class Outline:
    """The contexts of a batch, in order of document and place, and what it tells the shards of anchors
    (`asking`; else it doesn't look at the anchors' sides)."""

    def __init__(self, ids: np.ndarray, texts: list[bytes], kind: Kind, shards: int, asking: bool = True):
        self.kind, self.ids, self.shards, self.asking = kind, ids, shards, asking
        self.parts = [Part(c, kind) for c in chunks(texts)]
        columns: list[list[np.ndarray]] = []
        for i, part in enumerate(self.parts):
            columns.extend(self._contexts(i, part, *docs) for docs in part.slices())
        self.part, self.doc, self.at, self.count, self.hash, self.context, self.lead, self.sides = (np.concatenate(c) for c in zip(*columns, strict=True)) if columns else (np.zeros(0, dtype=np.int64),) * 8
        # the first of equal contexts is at the earliest place
        first, which, times = distinct(self.context)
        order = by_shard(shard := (self.hash[first] & U64(0xFFFFFF)) % U64(max(1, shards)))
        self.shard = shard[order].astype(np.int64)
        self.first, self.times = first[order], times[order]
        place = np.empty(len(order), dtype=np.int64)
        place[order] = np.arange(len(order))
        self.entry = place[which]  # of each context

    def _contexts(self, number: int, part: Part, first: int, last: int) -> list[np.ndarray]:
        """Those of the part's documents from `first` up to `last`."""
        kind, base = self.kind, part.start[first]
        start, end = part.start[first:last] - base, part.end[first:last] - base
        n = int(end[-1])
        size = np.maximum(end - start - kind.gram + 1, 0)
        grams = ranges(start, size)
        if not len(grams):
            return [np.zeros(0, dtype=np.int64)] * 4 + [np.zeros(0, dtype=U64)] * 2 + [np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint16)]
        sums = prefix_sums(part.tokens[base : base + n])
        h = window_hash(sums, kind.anchor)
        bits = U64(max(24, n.bit_length()))
        least = sliding_min((h >> bits << bits) | np.arange(len(h), dtype=U64), kind.gram - kind.anchor + 1)
        anchor = (least[grams] & ((U64(1) << bits) - U64(1))).astype(np.int64)
        doc = np.repeat(np.arange(len(size)), size)
        new = np.flatnonzero(np.append(True, (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])))
        lo, count, doc, anchor = grams[new], np.diff(np.append(new, len(grams))), doc[new], anchor[new]
        context = mix(stretch_hash(sums, lo, lo + count + kind.gram - 1) + (anchor - lo).astype(U64))
        # a gram reaches so far to the left of its anchor, or else at least so far to the right of it
        sides = np.zeros((len(lo), 2), dtype=np.uint8)
        reach = kind.gram - kind.anchor
        half = reach // 2
        for side, has, back, on in ((0, anchor - lo >= half, half, 0), (1, anchor - lo - count + 1 < half, 0, reach - half)) if self.asking else ():
            at = anchor[has]
            sides[has, side] = stretch_hash(sums, at - back, at + kind.anchor + on) % U64(255) + U64(1)
        return [np.full(len(lo), number), doc + first + part.chunk.first, lo - start[doc], count, h[anchor], context, anchor - lo, sides.view(np.uint16).ravel()]

    def place(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Document id and place of contexts, by which they are ordered."""
        return self.ids[self.doc[i]], self.at[i] if self.kind.words else np.zeros(len(i), dtype=np.int64)

    def earlier_here(self) -> np.ndarray:
        """Contexts whose equal lies earlier in this batch."""
        first = self.first[self.entry] if len(self.entry) else self.entry
        mine, his = self.ids[self.doc], self.ids[self.doc[first]] if len(first) else self.ids[self.doc]
        return (mine > his) | ((mine == his) & (self.at > self.at[first]) if self.kind.words else np.zeros(len(mine), dtype=bool))

    def sent(self):
        """(shard, blob) of the anchors: one entry for each different context."""
        entries = np.empty((len(self.first), ENTRY), dtype=np.uint8)
        entries[:, :5] = (self.hash[self.first] >> U64(24)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]
        mark = (self.context[self.first] >> U64(49) << U64(1)) | (self.times > 1).astype(U64)
        entries[:, 5:7] = mark.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :2]
        entries[:, 7:] = self.sides[self.first].astype(np.uint16).view(np.uint8).reshape(-1, 2)
        for shard, s in _cut(self.shard):
            yield shard, entries[s].tobytes()

    def token(self, i: np.ndarray) -> np.ndarray:
        """First token, in its part, of contexts."""
        out = np.zeros(len(i), dtype=np.int64)
        for number, part in enumerate(self.parts):
            of = np.flatnonzero(self.part[i] == number)
            out[of] = part.start[self.doc[i[of]] - part.chunk.first] + self.at[i[of]]
        return out

    def texts(self, i: np.ndarray, token: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of `size` tokens from `token` on, in the parts of contexts i: end to end, and how many of each."""
        begin, length = np.zeros(len(i), dtype=np.int64), np.zeros(len(i), dtype=np.int64)
        of_part = [np.flatnonzero(self.part[i] == number) for number in range(len(self.parts))]
        for part, of in zip(self.parts, of_part, strict=True):
            begin[of], end = part.span(token[of], token[of] + size[of])
            length[of] = end - begin[of]
        to = np.cumsum(length) - length
        out = np.empty(int(length.sum()), dtype=np.uint8)
        for part, of in zip(self.parts, of_part, strict=True):
            out[ranges(to[of], length[of])] = part.chunk.buf[ranges(begin[of], length[of])]
        return out, length


def _cut(shard: np.ndarray):
    if not len(shard):
        return
    bound = np.flatnonzero(np.append(True, shard[1:] != shard[:-1]))
    for lo, hi in zip(bound, np.append(bound[1:], len(shard)), strict=True):
        yield int(shard[lo]), slice(lo, hi)


class Stretches(NamedTuple):
    """Some stretches of text: document and place of each, the number of grams that start in it, how
    many tokens stand before its anchor, its bytes, and all texts end to end."""

    doc: np.ndarray
    at: np.ndarray
    count: np.ndarray
    lead: np.ndarray
    size: np.ndarray
    text: bytes

    def packed(self) -> bytes:
        n = len(self.doc)
        base = int(self.doc.min()) if n else 0
        w_doc, w_at = (width_of(int(x.max())) if n else 1 for x in (self.doc - base, self.at))
        columns = ((self.doc - base, w_doc), (self.at, w_at), (self.count, 2), (self.lead, 2), (self.size, 4))
        return _HEAD.pack(base, n, w_doc, w_at) + b"".join(put_ints(c, w) for c, w in columns) + self.text


def unpacked(blobs: list[bytes]) -> Stretches:
    """The stretches of some blobs, one after the other."""
    rows: list[list[np.ndarray]] = [[], [], [], [], []]
    text = []
    for blob in blobs:
        base, n, w_doc, w_at = _HEAD.unpack_from(blob)
        at = _HEAD.size
        for row, w in zip(rows, (w_doc, w_at, 2, 2, 4), strict=True):
            row.append(get_ints(blob, n, w, at).astype(np.int64))
            at += n * w
        rows[0][-1] += base
        text.append(memoryview(blob)[at:])
    return Stretches(*(np.concatenate(r) for r in rows), b"".join(text))


class Asked:
    """The grams of shared anchors, and where each is asked about."""

    def __init__(self, outline: Outline, status: np.ndarray):
        self.outline = outline
        kind = outline.kind
        left = np.flatnonzero(status & SHARED)
        alone = status[left] & MANY > 0
        self.whole = outline.first[left[~alone]]  # contexts sent whole, already in the order of their shards
        self.whole_shard = outline.shard[left[~alone]]
        # grams sent by themselves, the first of equal ones only
        single, _ = self._all_of(left[alone])
        count = outline.count[single]
        self.owner = np.repeat(single, count)
        self.offset = ranges(np.zeros(len(single), dtype=np.int64), count)
        self.token = np.repeat(outline.token(single), count) + self.offset
        gram = np.zeros(len(self.token), dtype=U64)
        for number, part in enumerate(outline.parts):
            of = np.flatnonzero(outline.part[self.owner] == number)
            if len(of):
                gram[of] = stretch_hash(prefix_sums(part.tokens), self.token[of], self.token[of] + kind.gram)
        _, first, which = np.unique(gram, return_index=True, return_inverse=True)
        order = by_shard(shard := (gram[first] & U64(0xFFFFFF)) % U64(max(1, outline.shards)))
        self.first, self.shard = first[order], shard[order].astype(np.int64)
        place = np.empty(len(order), dtype=np.int64)
        place[order] = np.arange(len(order))
        self.entry = place[which]

    def _all_of(self, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Every context of some entries, but for those whose equal lies earlier, and which of the entries it is of."""
        which = np.full(len(self.outline.first), -1)
        which[entries] = np.arange(len(entries))
        which = which[self.outline.entry]
        at = np.flatnonzero((which >= 0) & ~self.outline.earlier_here())
        return at, which[at]

    def sent(self):
        """(shard, sort, blob): whole contexts (1) and single grams (2)."""
        o, gram = self.outline, self.outline.kind.gram

        def blobs(sort, shards, i, offset, count):
            doc, at = o.place(i)
            at, lead = at + (offset if o.kind.words else 0), o.lead[i] - offset
            text, size = o.texts(i, o.token(i) + offset, count + gram - 1)
            end = np.cumsum(size)
            for shard, s in _cut(shards):
                held = text[end[s.start] - size[s.start] : end[s.stop - 1]].tobytes()
                yield shard, sort, Stretches(doc[s], at[s], count[s], lead[s], size[s], held).packed()

        yield from blobs(1, self.whole_shard, self.whole, np.zeros(len(self.whole), dtype=np.int64), o.count[self.whole])
        yield from blobs(2, self.shard, self.owner[self.first], self.offset[self.first], np.ones(len(self.first), dtype=np.int64))

    def removed(self, whole: np.ndarray, single: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(part, first token, last + 1) of what goes, from the shards' answers and from equals within the batch."""
        o = self.outline
        # what is told of a context holds for all its equals in the batch
        count = o.count[self.whole]
        at, which = self._all_of(o.entry[self.whole])
        told_from, count = (np.cumsum(count) - count)[which], count[which]
        ask = np.repeat(at, count)
        token = np.repeat(o.token(at), count) + ranges(np.zeros(len(count), dtype=np.int64), count)
        hit = whole.astype(bool)[ranges(told_from, count)]
        told = single.astype(bool)[self.entry] if len(self.entry) else np.zeros(0, dtype=bool)
        first = self.first[self.entry] if len(self.entry) else self.entry
        mine, his = o.ids[o.doc[self.owner]], o.ids[o.doc[self.owner[first]]] if len(first) else o.ids[o.doc[self.owner]]
        later = mine > his
        if o.kind.words:
            at = o.at[self.owner] + self.offset
            later |= (mine == his) & (at > at[first])
        told |= later
        gone = np.flatnonzero(o.earlier_here())
        lo = np.concatenate([token[hit], self.token[told], o.token(gone)])
        size = np.concatenate([np.ones(hit.sum() + told.sum(), dtype=np.int64), o.count[gone]])
        return np.concatenate([o.part[ask[hit]], o.part[self.owner[told]], o.part[gone]]), lo, lo + size + o.kind.gram - 1


def shared_anchors(blobs: list[bytes]) -> list[bytes]:
    """For each entry of each blob, whether grams of it can stand elsewhere, too (SHARED), and whether its anchor
    does so in MANY contexts. Equal grams have equal anchors and agree on what lies to the left of them or on
    what lies to the right: short anchors that meet by chance, more of them the larger the input, end here."""
    sizes = [len(b) // ENTRY for b in blobs]
    raw = np.zeros((sum(sizes), 16), dtype=np.uint8)
    raw[:, [0, 1, 2, 3, 4, 8, 9, 10, 11]] = np.frombuffer(b"".join(blobs), dtype=np.uint8).reshape(-1, ENTRY)
    anchor, mark = raw.view("<u8").astype(U64).T
    rank, _ = dense_rank(anchor, np.zeros(len(anchor), dtype=U64), 0)
    shared = mark & U64(1) > 0
    near = np.flatnonzero(np.bincount(rank)[rank] > 1)
    for shift in (16, 24):
        side = mark[near] >> U64(shift) & U64(255)
        alike, _ = dense_rank(rank[near], side, 8)
        shared[near] |= (np.bincount(alike)[alike] > 1) & (side > 0)
    near = np.flatnonzero(shared)
    context, _ = dense_rank(rank[near], mark[near] >> U64(1) & U64((1 << 15) - 1), 15)
    of = np.zeros(int(context.max(initial=0)) + 1, dtype=np.int64)
    of[context] = rank[near]
    out = shared.astype(np.uint8) * np.uint8(SHARED)
    out[near[np.bincount(of[1:], minlength=int(rank.max(initial=0)) + 1)[rank[near]] > MANY_CONTEXTS]] |= MANY
    told, ends = out.tobytes(), np.cumsum(sizes).tolist()
    return [told[end - n : end] for n, end in zip(sizes, ends, strict=True)]


def dense_rank(high: np.ndarray, low: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Ranks from 1 of the pairs (high, low), low being of so many bits, and the order (ties by place)."""
    n = len(high)
    key = (high.astype(U64) << U64(bits)) | low.astype(U64)
    place = max(1, (n - 1).bit_length())
    if n and (int(high.max()).bit_length() + bits + place) <= 64:  # sorting keys with their places is many times faster
        key = np.sort((key << U64(place)) | np.arange(n, dtype=U64))
        order, key = (key & U64((1 << place) - 1)).astype(np.int64), key >> U64(place)
    else:
        order = np.argsort(key, kind="stable")
        key = key[order]
    rank = np.empty(n, dtype=np.uint32)
    rank[order] = np.cumsum(np.append(True, key[1:] != key[:-1])[:n])
    return rank, order


class SuffixOrder:
    """Suffix order of some strings laid end to end, by doubling: the ranks of 4, 8, 16, ... bytes from
    each position on, up to half of `length` or more; a string's end ranks before any byte."""

    BYTES, BITS = 4, 9  # of a word; a byte counts one more than its value, a place past the end counts 0

    def __init__(self, text: np.ndarray, size: np.ndarray, length: int):
        n = len(text)
        self.end = np.repeat(np.cumsum(size + 1) - 1, size + 1)  # one place more for the end of each
        body = np.ones(n + len(size), dtype=bool)
        body[np.cumsum(size + 1) - 1] = False
        m = n + len(size)
        value = np.zeros(m + self.BYTES, dtype=np.uint16)
        value[:m][body] = text.astype(np.uint16) + 1
        word = np.zeros(m, dtype=U64)
        for i in range(self.BYTES):
            word = (word << U64(self.BITS)) | value[i : i + m]
        for k in range(self.BYTES):  # a word has nothing of the string that comes next
            word[(self.end[~body] - k)[size >= k]] &= U64(((1 << self.BITS * k) - 1) << self.BITS * (self.BYTES - k))
        self.word, self.levels = word, []
        rank, _ = dense_rank(word, np.zeros(m, dtype=U64), 0)
        width = self.BYTES
        while True:
            rank[~body] = 0
            self.levels.append((width, rank))
            if 2 * width > length:
                break
            after = rank[np.minimum(np.arange(m) + width, self.end)]
            rank, _ = dense_rank(rank, after, int(rank.max(initial=1)).bit_length())
            width *= 2

    def sorted(self, start: np.ndarray, length: int | None = None) -> np.ndarray:
        """The order of the suffixes that begin at some positions, by their first `length` bytes at least; ties as they are given."""
        width, rank = self.levels[-1]
        key, order = rank[start], np.argsort(rank[start], kind="stable")
        for turn in range(1, -(-int(length or (self.end[start] - start).max(initial=1)) // width)):
            after = rank[np.minimum(start + turn * width, self.end[start])]
            key, order = dense_rank(key, after, int(after.max(initial=1)).bit_length())
        return order

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the longest common prefix of the suffixes at a and at b."""
        done = np.zeros(len(a), dtype=np.int64)
        here = lambda row: (row[np.minimum(a + done, self.end[a])], row[np.minimum(b + done, self.end[b])])
        room = np.minimum(self.end[a] - a, self.end[b] - b)
        width, rank = self.levels[-1]
        for _ in range(int(room.max(initial=0)) // width):
            x, y = here(rank)
            done += np.where((x == y) & (x > 0), width, 0)
        for width, rank in self.levels[-2::-1]:
            x, y = here(rank)
            done += np.where((x == y) & (x > 0), width, 0)
        x, y = here(self.word)
        for i in range(1, self.BYTES):
            done += (x ^ y) < (U64(1) << U64(self.BITS * i))
        return np.minimum(done, room)


def smaller_neighbour(doc: np.ndarray, lcp: np.ndarray, floor: int) -> tuple[np.ndarray, np.ndarray]:
    """For each place of a suffix order, the nearest one before it of a smaller document (-1: none)
    and the longest prefix common to both; those under `floor` end the search. lcp[i] is that of
    i - 1 and i. Pointers jump over what their targets have jumped over."""
    before = np.arange(len(doc)) - 1
    common = lcp.copy()
    active = np.flatnonzero(before >= 0)
    while len(active):
        common_here = common[active]
        target = before[active]
        gone = common_here < floor
        before[active[gone]] = -1
        more = ~gone & (doc[target] >= doc[active])
        active, target = active[more], target[more]
        step = before[target].copy()
        depth = np.minimum(common[active], common[target])
        dead = step < 0
        before[active], common[active] = step, np.where(dead, 0, depth)
        active = active[~dead]
    common[before < 0] = 0
    return before, common


def factors(text: bytes, size: np.ndarray, count: np.ndarray, doc: np.ndarray, floor: int, exact: bool = True) -> np.ndarray:
    """For each gram of different strings end to end, the length of the longest prefix of its suffix, at least
    `floor` or else 0, that a suffix of a smaller document also has; without `exact`, any length from `floor` up to it.
    In suffix order the previous and the next place of a smaller document hold the two longest candidates."""
    suffixes = SuffixOrder(np.frombuffer(text, dtype=np.uint8), size, floor)
    start = ranges(np.cumsum(size + 1) - size - 1, count)
    doc = np.repeat(doc, count)
    order = suffixes.sorted(start, None if exact else floor)
    at, d = start[order], doc[order]
    lcp = np.zeros(len(at), dtype=np.int64)
    lcp[1:] = suffixes.common(at[:-1], at[1:])
    _, left = smaller_neighbour(d, lcp, floor)
    _, right = smaller_neighbour(d[::-1], np.append(0, lcp[1:][::-1]), floor)
    found = np.empty(len(at), dtype=np.int64)
    found[order] = np.maximum(left, right[::-1])
    return found


def longest_previous_factor(strings: Stretches, floor: int, anchor: int = 0) -> np.ndarray:
    """For each gram of the strings, the length of the longest prefix of its suffix, at least `floor` or
    else 0, that a suffix of a smaller document also has.

    Equal strings would be neighbours in suffix order, at every one of their suffixes. They are laid down
    once, for the least of their documents; in the others the whole rest of the string is an earlier match.

    With `anchor`, the strings have anchors of so many bytes, and equal grams have equal ones: each block of
    strings of some anchors has its suffix order, a string that alone has its anchor needs none, and lengths
    from `floor` on may be less than the longest."""
    bounds = np.cumsum(strings.size)
    least: dict[bytes, int] = {}
    slices = [strings.text[a:b] for a, b in zip((bounds - strings.size).tolist(), bounds.tolist(), strict=True)]
    by_doc = np.argsort(strings.doc, kind="stable")
    own = np.empty(len(by_doc), dtype=np.int64)
    for i in by_doc.tolist():
        own[i] = least.setdefault(slices[i], i)
    by = np.fromiter(least.values(), dtype=np.int64, count=len(least))  # by document
    group = np.zeros(len(by), dtype=np.int64)
    if anchor:
        number: dict[bytes, int] = {}
        group[:] = [number.setdefault(slices[i][a : a + anchor], len(number)) for i, a in zip(by.tolist(), strings.lead[by].tolist(), strict=True)]
        many = np.bincount(group, minlength=1) > 1
        order = np.argsort(group, kind="stable")
        order = order[many[group[order]]]
        new = np.append(True, np.diff(group[order]) > 0)[: len(order)]
        before = np.cumsum(strings.size[by[order]]) - strings.size[by[order]]
        block = before[np.flatnonzero(new)[np.cumsum(new) - 1]] // SLICE if len(order) else before
    else:
        order = np.arange(len(by))
        block = np.zeros(len(by), dtype=np.int64)
    count = strings.count[by]
    first_of = np.cumsum(count) - count
    found = np.zeros(int(count.sum()), dtype=np.int64)
    for _, s in _cut(block):
        mine = order[s]
        i = by[mine]
        text = b"".join([slices[k] for k in i.tolist()])
        found[ranges(first_of[mine], count[mine])] = factors(text, strings.size[i], count[mine], strings.doc[i], floor, exact=not anchor)
    first = np.empty(len(strings.doc), dtype=np.int64)
    first[by] = first_of
    offset = ranges(np.zeros(len(own), dtype=np.int64), strings.count)
    owner = np.repeat(np.arange(len(own)), strings.count)
    rest = strings.size[owner] - offset
    return np.where((strings.doc > strings.doc[own])[owner], np.where(rest >= floor, rest, 0), found[first[own[owner]] + offset])


def _classes(before: np.ndarray, token: np.ndarray) -> np.ndarray:
    """One number for each different pair (class so far, next token)."""
    _, token = np.unique(token, return_inverse=True)
    return np.unique((before.astype(U64) << U64(32)) | token.astype(U64), return_inverse=True)[1]


def earlier_by_extension(strings: Stretches, gram: int, anchor: int) -> np.ndarray:
    """For each gram of the strings (of words), whether an equal one starts earlier.

    Seeds are equal anchors. From a seed all its matches are extended at once, a word at a time to the
    left and to the right: strings stay in one class for as long as their words agree. A gram that
    reaches `k` words to the left of the anchor and `gram - anchor - k` to the right is matched by
    those of its classes on both sides; the first of them stays."""
    if not len(strings.doc):
        return np.zeros(0, dtype=bool)
    bounds = np.cumsum(strings.size)
    word, first = [], []
    base = 0
    for chunk in chunks([strings.text[a:b] for a, b in zip((bounds - strings.size).tolist(), bounds.tolist(), strict=True)]):
        h, _, _, at = chunk.words(NOT_SPACE)
        word.append(h), first.append(at[:-1] + base)
        base += len(h)
    word, first = np.concatenate(word), np.concatenate(first)
    last = np.append(first[1:], len(word))
    seed_at = first + strings.lead
    seed = np.unique(stretch_hash(prefix_sums(word), seed_at, seed_at + anchor), return_inverse=True)[1]
    reach = gram - anchor
    left, right = [seed], [seed]
    for k in range(1, reach + 1):
        for sides, at in ((left, seed_at - k), (right, seed_at + anchor + k - 1)):
            inside = (at >= first) & (at < last)
            grown = np.full(len(seed), -1)
            grown[inside] = _classes(sides[-1][inside], word[at[inside]])
            sides.append(grown)
    left, right = np.array(left), np.array(right)
    owner = np.repeat(np.arange(len(seed)), strings.count)
    offset = ranges(np.zeros(len(seed), dtype=np.int64), strings.count)
    k = strings.lead[owner] - offset
    one, other = left[k, owner], right[reach - k, owner]
    doc, at = strings.doc[owner], strings.at[owner] + offset
    order = np.lexsort((at, doc, other, one, k))
    new = np.ones(len(order), dtype=bool)
    new[1:] = np.any([x[order][1:] != x[order][:-1] for x in (k, one, other)], axis=0)
    head = order[np.flatnonzero(new)[np.cumsum(new) - 1]]
    out = np.empty(len(order), dtype=bool)
    out[order] = (doc[order] > doc[head]) | ((doc[order] == doc[head]) & (at[order] > at[head]))
    return out


def settled(blobs: list[bytes], kind: Kind) -> list[bytes]:
    """For each gram of the stretches sent, whether it goes: one bit each."""
    strings = unpacked(blobs)
    hit = earlier_by_extension(strings, kind.gram, kind.anchor) if kind.words else longest_previous_factor(strings, kind.gram, kind.anchor) >= kind.gram
    sizes = [struct.unpack_from("<qI", b)[1] for b in blobs]
    owner = np.repeat(np.arange(len(blobs)), sizes)
    grams = np.bincount(owner, weights=strings.count, minlength=len(blobs)).astype(np.int64)
    return [np.packbits(x).tobytes() for x in np.split(hit, np.cumsum(grams)[:-1])]


_SENT = "shard int, batch int, sort int, blob binary"
_TOLD = "batch int, sort int, shard int, blob binary"


def _table(schema: str, rows: list[tuple]):
    import pyarrow as pa

    release()
    kinds = [pa.binary() if c.split()[1] == "binary" else pa.int32() for c in schema.split(", ")]
    columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
    return pa.table([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[c.split()[0] for c in schema.split(", ")])


def _told(table, sort: int) -> list[tuple[int, bytes]]:
    """The answers of one sort, in the order of the shards."""
    return sorted((s, b) for s, k, b in zip(*(table.column(c).to_pylist() for c in ("shard", "sort", "blob")), strict=True) if k == sort)


def _bits(rows: list[tuple[int, bytes]], sizes: dict[int, int]) -> np.ndarray:
    parts = [np.unpackbits(np.frombuffer(b, dtype=np.uint8), count=sizes[s]) for s, b in rows]
    return np.concatenate(parts) if parts else np.zeros(0, dtype=np.uint8)


def _sizes(shard: np.ndarray, weight: np.ndarray | None = None) -> dict[int, int]:
    return {s: int(weight[c].sum()) if weight is not None else c.stop - c.start for s, c in _cut(shard)}


def remove_repeats(docs: DataFrame, kind: Kind) -> DataFrame:
    """doc_id, n_tokens, n_removed, spans (the maximal runs of removed tokens, end exclusive) and kept
    (what is left, as bytes; of words, joined by one space) of each row."""
    rows, n = batched(docs)
    shards = 2 * max(n, shuffle_parts(docs.sparkSession))

    def ask(table):
        batch = table.column("batch")[0].as_py()
        return _table(_SENT, [(shard, batch, 0, blob) for shard, blob in Outline(*ordered(table), kind, shards).sent()])

    def answer(table):
        blobs = table.column("blob").to_pylist()
        sorts = table.column("sort").to_pylist()
        told = settled(blobs, kind) if sorts[0] else shared_anchors(blobs)
        return _table(_TOLD, list(zip(table.column("batch").to_pylist(), sorts, table.column("shard").to_pylist(), told, strict=True)))

    def asked(table, told) -> Asked:
        status = b"".join(b for _, b in _told(told, 0))
        return Asked(Outline(*ordered(table), kind, shards, asking=False), np.frombuffer(status, dtype=np.uint8))

    def ask_more(table, told):
        batch = table.column("batch")[0].as_py()
        return _table(_SENT, [(shard, batch, sort, blob) for shard, sort, blob in asked(table, told).sent()])

    def finish(table, told):
        more = asked(table, told)
        whole = _bits(_told(told, 1), _sizes(more.whole_shard, more.outline.count[more.whole]))
        single = _bits(_told(told, 2), _sizes(more.shard))
        return _result(more.outline, *more.removed(whole, single))

    anchors = rows.groupBy("batch").applyInArrow(ask, _SENT)
    told = anchors.groupBy("shard").applyInArrow(answer, _TOLD)
    stretches = rows.groupBy("batch").cogroup(told.groupBy("batch")).applyInArrow(ask_more, _SENT)
    told_more = stretches.groupBy("shard").applyInArrow(answer, _TOLD)
    done = rows.groupBy("batch").cogroup(told.unionByName(told_more).groupBy("batch")).applyInArrow(finish, RESULT)
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return done.select(shown_id(), "n_tokens", removed.alias("n_removed"), "spans", "kept")


RESULT = "doc_id long, n_tokens long, spans array<struct<start:long,end:long>>, kept binary"


def _result(outline: Outline, part: np.ndarray, lo: np.ndarray, hi: np.ndarray):
    import pyarrow as pa

    ids, sizes, kept, starts, ends, counts = [], [], [], [], [], []
    for number, p in enumerate(outline.parts):
        mine = part == number
        cover = np.bincount(lo[mine], minlength=p.n + 1) - np.bincount(hi[mine], minlength=p.n + 1)
        gone = np.cumsum(cover[: p.n]) > 0
        edge = np.zeros(p.n + 1, dtype=bool)
        edge[p.start], edge[p.end] = True, True  # runs end with their document
        begin = np.flatnonzero(gone & (np.append(True, ~gone[:-1])[: p.n] | edge[:-1]))
        end = np.flatnonzero(gone & (np.append(~gone[1:], True)[: p.n] | edge[1:])) + 1
        of = np.searchsorted(begin, np.append(p.start, p.n + 1))
        of[-1] = len(begin)
        counts.append(np.diff(of))
        owner = np.repeat(p.start, counts[-1])
        starts.append(begin - owner), ends.append(end - owner)
        some = counts[-1] > 0
        for i, (a, b, any_gone) in enumerate(zip(p.start.tolist(), p.end.tolist(), some.tolist(), strict=True)):
            text = p.chunk.texts[i]
            if outline.kind.words:
                words = text.split()
                kept.append(b" ".join(compress(words, ~gone[a:b]) if any_gone else words))
            else:
                kept.append(p.chunk.buf[a:b][~gone[a:b]].tobytes() if any_gone else text)
        sizes.append(p.end - p.start)
        ids.append(outline.ids[p.chunk.first : p.chunk.first + len(p.start)])
    whole = lambda x: np.concatenate(x) if x else np.zeros(0, dtype=np.int64)
    spans = pa.StructArray.from_arrays([pa.array(whole(starts), pa.int64()), pa.array(whole(ends), pa.int64())], names=["start", "end"])
    offsets = pa.array(np.append(0, np.cumsum(whole(counts))).astype(np.int32))
    columns = [pa.array(whole(ids), pa.int64()), pa.array(whole(sizes), pa.int64()), pa.ListArray.from_arrays(offsets, spans), pa.array(kept, pa.binary())]
    release()
    return pa.table(columns, names=["doc_id", "n_tokens", "spans", "kept"])


BYTES_50 = Kind(gram=50, anchor=20, words=False)
WORDS_20 = Kind(gram=20, anchor=10, words=True)


def suffix_dedup(docs: DataFrame, length: int = 50, anchor: int = 20) -> DataFrame:
    """doc_id, n_bytes, n_removed, spans (maximal removed runs of bytes) and kept (the bytes left): each byte
    covered by a `length`-byte string that also starts in a document of a smaller id goes.

    Decided by longest previous factors in suffix order. Null is empty; texts shorter than `length`
    lose nothing; of rows with one id, and of repeated rows, neither is earlier than the other. A
    missing doc_id is the least of all. No rows give no rows; other columns are ignored. A very long
    text is worked on in one piece, its stretches stay of bounded size.
    """
    return remove_repeats(docs, Kind(length, anchor, False)).withColumnRenamed("n_tokens", "n_bytes")


def substring_dedup(docs: DataFrame, words: int = 20, anchor: int = 10) -> DataFrame:
    """doc_id, n_words, n_removed, spans (maximal repeats removed, in words) and kept (words left, joined by
    one space, as UTF-8): each word covered by a window of `words` words that also starts earlier, in
    a smaller doc_id or before it in the same document, goes.

    Seeds are winnowed anchors; matches are extended word by word both ways. Null has no words;
    shorter texts lose nothing; of rows with one id, windows at one place are not earlier than each
    other. A missing doc_id is the least of all. No rows give no rows; other columns are ignored.
    """
    return remove_repeats(docs, Kind(words, anchor, True)).withColumnRenamed("n_tokens", "n_words")
