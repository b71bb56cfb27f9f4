"""Language identification with one bit-sliced Bloom filter for all languages.

Each slot of the filter holds a bit for every language. An n-gram's slots, joined by AND, give all
languages that contain it in one look-up. A text's hits are counted for each language and freed
from the false positives that the filter's fill predicts; the language with most hits is chosen.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quoin.llm.arrays import ALNUM, U64, chunks, prefix_sums, release, utf8, window_hash

from quoin.llm.exchange import small_batches

WIDTHS = (3, 4, 5)  # bytes of an n-gram
SLOTS = 1 << 20
LOOKUPS = 2
DOCS_PER_LANGUAGE = 2000  # of training, chosen by hash; a bound on fitting only
LANGUAGES = 4096  # at most: of more distinct values of lang the commonest are learned (a bound on fitting only)

_LETTER = ALNUM.copy()
_LETTER[48:58] = False


def _grams(chunk) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each width, hashes of the n-grams of letters and single spaces, and the document of each."""
    size = np.fromiter(map(len, chunk.texts), dtype=np.int64, count=len(chunk.texts))
    doc = np.repeat(np.arange(len(size), dtype=np.int32), size + 1)[: len(chunk.buf)]
    letter = _LETTER[chunk.buf]
    keep = letter | np.append(True, letter[:-1])  # the first of a run of others stays, as a space
    keep[chunk.start[size > 0]] = True  # so does the space that each text is given in front; another closes it
    buf, doc = np.where(letter, chunk.buf, np.uint8(32))[keep], doc[keep]
    sums = prefix_sums(buf)
    out = []
    for width in WIDTHS:
        if len(buf) < width:
            continue
        h = window_hash(sums, width)
        ok = doc[: len(h)] == doc[width - 1 :]
        out.append((h[ok], doc[: len(h)][ok]))
    return out


def _slots(h: np.ndarray, slots: int) -> list[np.ndarray]:
    return [((h >> U64(20 * i)) & U64(slots - 1)).astype(np.int64) for i in range(LOOKUPS)]


class Filter:
    """masks: bits[slot, slice], one bit a language; languages: names in the bits' order."""

    def __init__(self, masks: np.ndarray, languages: list[str]):
        self.masks, self.languages = masks, languages
        fill = [np.count_nonzero((masks[:, i // 64] >> U64(i % 64)) & U64(1)) / len(masks) for i in range(len(languages))]
        self.false_rate = np.array(fill) ** LOOKUPS

    def hits(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """n-grams of each text, and for each language the corrected number that it contains."""
        n = np.zeros(len(texts))
        hits = np.zeros((len(texts), len(self.languages)))
        for chunk in chunks(texts, lower=True):
            here = slice(chunk.first, chunk.first + len(chunk.texts))
            for h, doc in _grams(chunk):
                at = np.searchsorted(doc, np.arange(len(chunk.texts) + 1))
                n[here] += np.diff(at)
                found = None
                for slot in _slots(h, len(self.masks)):
                    bits = self.masks[slot]
                    found = bits if found is None else found & bits
                for i in range(len(self.languages)):
                    one = (found[:, i // 64] >> found.dtype.type(i % 64)) & found.dtype.type(1)
                    hits[here, i] += np.diff(np.append(0, np.cumsum(one, dtype=np.int64))[at])
        false = n[:, None] * self.false_rate
        return n, np.clip((hits - false) / np.maximum(1e-9, 1 - self.false_rate), 0, None)


def train(docs: DataFrame, per_language: int = DOCS_PER_LANGUAGE, slots: int = SLOTS) -> Filter:
    """Fit on rows (text, lang): about `per_language` texts of each language, by their hash.

    Every n-gram that a language's texts hold sets that language's bit: a look-up returns all
    languages that contain it. What comes to the driver is the filter, whose size is fixed.
    Rows without a language are left out, as are those of languages beyond the LANGUAGES commonest; no rows give a filter without languages."""
    small_batches(docs.sparkSession)
    docs = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("text", "lang")
    common = docs.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(LANGUAGES)
    counts = dict(sorted((r[0], r[1]) for r in common.collect()))
    languages = list(counts)
    if not languages:
        return Filter(np.zeros((slots, 1), dtype=U64), [])
    share = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, min(1.0, per_language / n))])
    draw = F.pmod(F.xxhash64("text"), F.lit(1 << 20)) / float(1 << 20)
    number = F.create_map(*[F.lit(x) for i, lang in enumerate(languages) for x in (lang, i)])
    chosen = docs.where(draw < share[F.col("lang")]).select("text", number[F.col("lang")].alias("lang"))

    def grams(batches):
        import pyarrow as pa

        for batch in batches:
            texts, langs = [b" " + x + b" " for x in utf8(batch.column(0))], np.asarray(batch.column(1).to_pylist(), dtype=np.int64)
            for chunk in chunks(texts, lower=True):
                for h, doc in _grams(chunk):
                    lang = langs[chunk.first + doc]
                    for i in np.unique(lang):
                        gram = np.unique(h[lang == i])
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(gram), i, dtype=np.int32)), pa.array(gram.view(np.int64))], names=["lang", "gram"])
        release()

    seen = chosen.mapInArrow(grams, "lang int, gram long").distinct()
    spots = F.explode(F.array(*[F.shiftrightunsigned("gram", 20 * i).bitwiseAND(slots - 1) for i in range(LOOKUPS)]))
    rows = seen.select(spots.alias("slot"), (F.col("lang") / 64).cast("int").alias("slice"), F.expr("shiftleft(1L, lang % 64)").alias("bit"))
    filled = rows.groupBy("slot", "slice").agg(F.bit_or("bit").alias("bits")).toPandas()
    masks = np.zeros((slots, (len(languages) + 63) // 64), dtype=U64)
    masks[filled["slot"].to_numpy(dtype=np.int64), filled["slice"].to_numpy(dtype=np.int64)] = filled["bits"].to_numpy(dtype=np.int64).view(U64)
    return Filter(masks, languages)


def identify(docs: DataFrame, model: Filter, text: str = "text") -> DataFrame:
    """Add lang_pred, score, known and n_grams to each row (in place of columns of these names), from its whole text alone.

    score is the chosen language's share of all languages' hits; known is the share of the text's
    n_grams that it contains. A text that is null or has no letter is `und` with 0; so is every
    text if the model has no language. A text with letters but no hit gets the first language, with 0.
    """
    small_batches(docs.sparkSession)
    small = model.masks
    if small.shape[1] == 1:  # a narrow table stays in the processor's cache
        width = next(w for w in (8, 16, 32, 64) if len(model.languages) <= w)
        small = small.astype(f"u{width // 8}")
    languages, false_rate = model.languages, model.false_rate

    @F.pandas_udf("lang_pred string, score double, known double, n_grams long")
    def run(column):
        import pandas as pd

        this = Filter.__new__(Filter)
        this.masks, this.languages, this.false_rate = small, languages, false_rate
        texts = [f" {x or ''} ".encode() for x in column]
        letters = np.array([bool(x) and any(c.isalpha() for c in x) for x in column], dtype=bool)
        if not languages:
            return pd.DataFrame({"lang_pred": ["und"] * len(texts), "score": 0.0, "known": 0.0, "n_grams": 0})
        n, hits = this.hits(texts)
        release()
        best = hits.argmax(axis=1) if len(texts) else np.zeros(0, dtype=int)
        top = hits[np.arange(len(texts)), best]
        score = np.where(letters, np.clip(top / np.maximum(hits.sum(axis=1), 1e-9), 0, 1), 0.0)
        known = np.where(letters, np.clip(top / np.maximum(n, 1), 0, 1), 0.0)
        return pd.DataFrame({"lang_pred": np.where(letters, np.array(languages, dtype=object)[best], "und"), "score": score, "known": known, "n_grams": n.astype("int64")})

    told = docs.select(F.struct(*docs.columns).alias("_doc"), run(F.col(text)).alias("_told"))
    kept = [F.col("_doc")[c].alias(c) for c in docs.columns if c not in ("lang_pred", "score", "known", "n_grams")]
    return told.select(*kept, "_told.lang_pred", "_told.score", "_told.known", "_told.n_grams")
