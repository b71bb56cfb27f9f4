"""Vectorised text kernels shared by the operators of this subpackage.

Texts are laid end to end in one byte buffer per chunk, so hashing, tokenising and window
minima are a handful of numpy passes instead of a loop over characters or words.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers = {"n": 0}

LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))

#: True for bytes of a word. All bytes of a multi-byte UTF-8 character are 0x80 or more.
NOT_SPACE = np.array([b != 0x20 and not 0x09 <= b <= 0x0D for b in range(256)])
ALNUM = np.array([48 <= b <= 57 or 97 <= b <= 122 or b >= 0x80 for b in range(256)])


def _power_table(n: int) -> tuple[np.ndarray, np.ndarray]:
    if _powers["n"] < n:
        size = max(n, 1 << 16)
        up = np.full(size, _BASE, dtype=U64)
        down = np.full(size, _INVERSE, dtype=U64)
        up[0] = down[0] = 1
        _powers.update(n=size, up=np.cumprod(up), down=np.cumprod(down))
    return _powers["up"], _powers["down"]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit words; makes low and high bits equally good."""
    h = h ^ (h >> U64(31))
    h *= U64(0x7FB5D329728EA185)
    h ^= h >> U64(27)
    h *= U64(0x81DADEF4BC2DD44D)
    h ^= h >> U64(33)
    return h


def prefix_sums(tokens: np.ndarray) -> np.ndarray:
    """Running polynomial sums; the hash of any stretch of tokens is then one subtraction."""
    n = len(tokens)
    up, _ = _power_table(n + 1)
    out = np.zeros(n + 1, dtype=U64)
    np.cumsum((tokens.astype(U64) + U64(1)) * up[:n], out=out[1:])
    return out


def stretch_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of tokens[start:end], equal for equal stretches wherever they lie."""
    _, down = _power_table(len(sums))
    h = (sums[end] - sums[start]) * down[start]
    return mix(h + (end - start).astype(U64) * U64(0xD6E8FEB86659FD93))


def window_hash(sums: np.ndarray, width: int) -> np.ndarray:
    """Hash of every stretch of `width` tokens."""
    n = len(sums) - width
    if n <= 0:
        return np.zeros(0, dtype=U64)
    _, down = _power_table(len(sums))
    return mix((sums[width:] - sums[:-width]) * down[:n])


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of `width` values, in log2(width) passes."""
    done = 1
    while done < width and len(values):
        step = min(done, width - done)
        values = np.minimum(values[:-step], values[step:])
        done += step
    return values


def word_spans(buf: np.ndarray, in_word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of word bytes."""
    edge = np.flatnonzero(np.diff(in_word[buf].view(np.int8), prepend=np.int8(0), append=np.int8(0)))
    return edge[::2], edge[1::2]


class Chunk:
    """Some whole documents end to end, with one space between them."""

    def __init__(self, texts: Sequence[bytes], first: int, lower: bool = False):
        joined = b" ".join(texts)
        self.first, self.texts = first, texts
        self.buf = np.frombuffer(joined.translate(LOWER) if lower else joined, dtype=np.uint8)
        size = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
        self.start = np.concatenate([[0], np.cumsum(size + 1)[:-1]]).astype(np.int64)
        self.end = self.start + size

    def words(self, in_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(hash, start, end) of each word and, for each document, its first word's index (one more at the end)."""
        start, end = word_spans(self.buf, in_word)
        first = np.searchsorted(start, np.append(self.start, len(self.buf) + 1))
        return stretch_hash(prefix_sums(self.buf), start, end), start, end, first


def chunks(texts: Sequence[bytes], lower: bool = False, limit: int = 1 << 19) -> Iterator[Chunk]:
    """Cut a list of texts into chunks of about `limit` bytes; a longer text is a chunk by itself."""
    lo = size = 0
    for i, text in enumerate(texts):
        if i > lo and size + len(text) > limit:
            yield Chunk(texts[lo:i], lo, lower)
            lo, size = i, 0
        size += len(text) + 1
    if lo < len(texts):
        yield Chunk(texts[lo:], lo, lower)


def release() -> None:
    """Give freed memory back to the system: a worker lives on between tasks, and other stages need it."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


def _find_trim():
    import ctypes

    try:
        return ctypes.CDLL(None).malloc_trim
    except (OSError, AttributeError):  # not this C library
        return None


_trim = _find_trim()


def utf8(column) -> list[bytes]:
    """An Arrow string or binary column as bytes; null is empty."""
    import pyarrow as pa

    if pa.types.is_string(column.type) or pa.types.is_large_string(column.type):
        column = column.cast(pa.binary() if pa.types.is_string(column.type) else pa.large_binary())
    return [x or b"" for x in column.to_pylist()]


def put_ints(values: np.ndarray, width: int) -> bytes:
    """The low `width` bytes of each value, as byte planes (planes compress better than rows)."""
    raw = np.ascontiguousarray(values.astype("<u8")).view(np.uint8).reshape(-1, 8)
    return np.ascontiguousarray(raw[:, :width].T).tobytes()


def get_ints(blob, count: int, width: int, at: int = 0) -> np.ndarray:
    """The reverse of put_ints."""
    raw = np.zeros((count, 8), dtype=np.uint8)
    raw[:, :width] = np.frombuffer(blob, dtype=np.uint8, count=count * width, offset=at).reshape(width, count).T
    return raw.view("<u8").ravel().astype(U64)


def width_of(largest: int) -> int:
    return max(1, (int(largest).bit_length() + 7) // 8)
