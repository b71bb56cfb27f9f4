"""Counts of subword tokens without merging every word.

A model of pieces whose merges never cross from a letter to a space mark cuts a text, before any
merge, into pre-tokens: a run of marks and what follows up to the next mark. The driver asks the
library, once for each piece of the vocabulary, whether that string alone encodes as one token; a
pre-token found among those strings counts as one. Only the rest is merged, and that once for each
distinct pre-token of a batch. `Shortcut` holds the proof; where the model's own description doesn't
allow the cut, whole texts go to the library.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
#: Longest pre-token whose count is remembered, and how many counts a task remembers at most.
SHORT, REMEMBERED = 64, 1 << 18
LIMIT = 4096


class Shortcut:
    """What is known of a model before any text is read: whether it cuts at marks, and the
    pre-tokens that are one token. It is as large as the vocabulary and goes to the tasks by value."""

    def __init__(self, model: bytes):
        from sentencepiece import SentencePieceProcessor
        from sentencepiece.sentencepiece_model_pb2 import ModelProto

        self.model = model
        told = ModelProto.FromString(model)
        spec = told.normalizer_spec
        kinds = told.SentencePiece
        plain = spec.name == "identity" and not spec.precompiled_charsmap and spec.add_dummy_prefix and not spec.remove_extra_whitespaces and spec.escape_whitespaces
        own = any(p.type in (kinds.USER_DEFINED, kinds.UNUSED) for p in told.pieces)  # strings that are cut out first, or merged and split again
        normal = [p.piece for p in told.pieces if p.type == kinds.NORMAL]
        crossing = any(re.search(f"[^{MARK}]{MARK}", p) for p in normal)
        self.cuts = bool(plain and not own and not crossing and MARK in normal and told.trainer_spec.model_type == told.trainer_spec.BPE and not told.trainer_spec.treat_whitespace_as_suffix)
        library = SentencePieceProcessor(model_proto=model)
        words = [p for p in normal if p != MARK and re.fullmatch(f"{MARK}+[^{MARK}]*", p)] if self.cuts else []
        alone = {p for p, ids in zip(words, library.encode([as_text(p) for p in words], num_threads=1), strict=True) if len(ids) == 1}
        self.single = frozenset(alone | {MARK})  # one mark alone has nothing to merge, and no text of its own


def as_text(pre_token: str) -> str:
    """The text that the library turns into this pre-token: it puts one mark before any text itself."""
    return pre_token[1:].replace(MARK, " ")


def pre_tokens(text: str) -> list[str]:
    return re.findall(f"{MARK}+[^{MARK}]*", MARK + text.replace(" ", MARK)) if text else []


class Counting:
    """Counts one batch of texts after another, with a memory of the pre-tokens that had to be merged."""

    def __init__(self, shortcut: Shortcut):
        from sentencepiece import SentencePieceProcessor

        self.library = SentencePieceProcessor(model_proto=shortcut.model)
        self.cuts, self.single = shortcut.cuts, shortcut.single
        self.merged: dict[str, int] = {}

    def lengths(self, texts: list[str]) -> list[int]:
        return [len(x) for x in self.library.encode(texts, num_threads=1)] if texts else []

    def count(self, texts: Iterable[str | None]) -> list[int]:
        if not self.cuts:
            return [self.lengths([t or ""])[0] for t in texts]
        sums, rest, long = [], [], {}
        for text in texts:
            found = Counter(pre_tokens(text or ""))
            known = found.keys() & self.single
            more = [(w, found[w]) for w in found.keys() - known]
            sums.append(sum(found[w] for w in known))
            rest.append(more)
        if len(self.merged) > REMEMBERED:
            self.merged.clear()
        new = list({w for more in rest for w, _ in more if w not in self.merged})
        for at in range(0, len(new), 4096):
            part = new[at : at + 4096]
            for w, n in zip(part, self.lengths([as_text(w) for w in part]), strict=True):
                (self.merged if len(w) <= SHORT else long)[w] = n
        of = lambda w: long[w] if w in long else self.merged[w]
        return [n + sum(times * of(w) for w, times in more) for n, more in zip(sums, rest, strict=True)]


def read_model(path: str | None = None) -> bytes:
    """The bytes of a model file at `path`, by default the public one of 32,000 pieces; read by the
    driver alone, so executors need no copy."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    with open(path, "rb") as f:
        return f.read()


def count_tokens(docs: DataFrame, model: bytes | None = None, text: str = "text", limit: int = LIMIT) -> DataFrame:
    """`docs` with n_bytes (UTF-8), n_tokens (as the model's library counts: no begin, end or added
    special tokens, special strings as ordinary text) and over_limit (n_tokens > limit).

    Null and empty texts have no tokens. Repeated rows are counted each; an empty table gives none; columns
    named like the new ones are replaced. Nothing is shuffled: each row is counted where it is read, whole."""
    shortcut = docs.sparkSession.sparkContext.broadcast(Shortcut(read_model() if model is None else model))

    @F.pandas_udf("long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        counting = Counting(shortcut.value)
        for texts in batches:
            yield pd.Series(counting.count(None if t is None else str(t) for t in texts), dtype="int64")

    out = docs.withColumn("n_bytes", F.coalesce(F.octet_length(text), F.lit(0)).cast("long")).withColumn("n_tokens", count(F.col(text)))
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
