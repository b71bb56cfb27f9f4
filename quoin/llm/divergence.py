"""How far the sources of a language differ in their words: exact sums over all terms, for all pairs.

A source's share of a term is p, its smoothed and scaled frequency, a whole number; two sources
differ in a term by floor((p - q)^2 / (p + q)). Summed over every kept term of the language for every
pair of its sources this would be terms x pairs, so terms are split by how many sources have them:

- heavy terms (in more than HEAVY sources) are laid out as dense tiles of numpy, terms by sources, and every
  pair of rows of a tile is summed;
- light terms need no tile. If a source lacks the term its share is the same p0 for all of them, so a pair's sum is
  the number of light terms at (p0, q0), corrected by each source's own shares against the others' p0 (how
  many terms have which share is enough) and by the terms that both have (pairs of short postings).

Both partial sums are whole numbers and are added as such.
"""

from __future__ import annotations

import uuid
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quoin.llm.exchange import shared_folder

LEAST_DOCS = 10
#: Terms of more sources than this go into tiles; postings of light terms are no longer than it.
HEAVY = 8
#: Size of a tile: terms, and sources on each side; and postings of light terms in one group.
TILE_TERMS, TILE_GROUPS, GROUP_POSTINGS = 4096, 256, 1 << 18
#: Distinct terms that a task counts before it sends what it has.
COUNTED = 200_000
SCALE = 1_000_000_000

_LETTERS = bytes(c if c >= 128 or 97 <= c <= 122 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))


def share(count, total, terms):
    """p = 1 + floor(SCALE * (count + 2) / (total + 2 * terms)), exact at any size."""
    wide = lambda c: F.col(c).cast("decimal(38,0)")
    return F.when(F.col(terms) == 0, 1).otherwise(F.call_function("div", F.lit(SCALE).cast("decimal(11,0)") * (F.col(count).cast("decimal(20,0)") + 2), F.col(total).cast("decimal(20,0)") + 2 * F.col(terms).cast("decimal(16,0)")) + 1).cast("long")


def apart(p, q):
    """floor((p - q)^2 / (p + q)); p and q are at most SCALE + 1, so squares fit a long."""
    return F.expr(f"(({p}) - ({q})) * (({p}) - ({q})) div (({p}) + ({q}))")


def _apart(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    d = p - q
    return d * d // (p + q)


def term_counts(docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text") -> DataFrame:
    """(lang, source, term, n, docs): how often, and in how many documents of the group, each term stands. A row
    of the empty term names each group, so that groups without terms are there too.

    Tasks add up what they read before anything is shuffled, a bounded number of terms at a time."""

    def run(batches):
        import pyarrow as pa

        groups: dict[tuple[str, str], tuple[Counter, Counter]] = {}

        def sent():
            for (of, where), (n, docs_with) in groups.items():
                terms = list(n)
                for at in range(0, len(terms), 1 << 15):
                    part = terms[at : at + (1 << 15)]
                    names = pa.array([t.decode("utf-8", "replace") for t in part], pa.string())
                    fixed = [pa.array([v] * len(part), pa.string()) for v in (of, where)]
                    yield pa.RecordBatch.from_arrays([*fixed, names, pa.array([n[t] for t in part], pa.int64()), pa.array([docs_with[t] for t in part], pa.int64())], names=["lang", "source", "term", "n", "docs"])
            groups.clear()

        held = 0
        for batch in batches:
            for of, where, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                n, docs_with = groups.setdefault((of, where), (Counter({b"": 0}), Counter({b"": 0})))
                words = (text or "").encode().translate(_LETTERS).split()
                held -= len(n)
                n.update(words)
                docs_with.update(set(words))
                held += len(n)
                if held > COUNTED:
                    yield from sent()
                    held = 0
        yield from sent()

    named = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in (lang, source)), F.col(text).cast("string"))
    counted = named.mapInArrow(run, "lang string, source string, term string, n long, docs long")
    # one shuffle serves the sums over tasks and those over a language's sources; names of groups are spread by source
    counted = counted.withColumn("spread", F.when(F.col("term") == "", F.col("source")).otherwise(F.col("term")))
    return counted.repartition("lang", "spread").groupBy("lang", "spread", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _written(df: DataFrame, folder: str, name: str) -> DataFrame:
    df.write.parquet(f"{folder}/{name}")
    return df.sparkSession.read.parquet(f"{folder}/{name}")


def postings(docs: DataFrame, folder: str, least_docs: int = LEAST_DOCS, **columns) -> tuple[DataFrame, DataFrame]:
    """Kept terms and groups, both written to `folder`.

    Terms: lang, term, of (the group's number within its language), source, p, p0 (share where the term is
    absent), q (the language's share), spread (how many sources have it). Groups: lang, source, of, p0,
    heavy and light (kept terms of the language of either kind), total, terms."""
    counted = term_counts(docs, **columns)
    by_term = Window.partitionBy("lang", "spread", "term")
    kept = counted.withColumn("all_docs", F.sum("docs").over(by_term)).withColumn("all_n", F.sum("n").over(by_term)).withColumn("wide", F.count("*").over(by_term))
    kept = kept.withColumn("first", F.row_number().over(by_term.orderBy("source")) == 1)
    kept = _written(kept.where((F.col("all_docs") >= least_docs) | (F.col("term") == "")).drop("spread", "docs", "all_docs"), folder, "kept")
    named = F.col("term") == ""
    of_term = lambda c: F.coalesce(F.sum(F.when(~named & c, 1)), F.lit(0))
    langs = kept.groupBy("lang").agg(of_term(F.col("first") & (F.col("wide") > HEAVY)).alias("heavy"), of_term(F.col("first") & (F.col("wide") <= HEAVY)).alias("light"), F.sum(F.when(~named, F.col("n")).otherwise(0)).alias("lang_total"))
    groups = kept.groupBy("lang", "source").agg(F.sum(F.when(~named, F.col("n")).otherwise(0)).alias("total")).join(langs, "lang")
    groups = groups.withColumn("terms", F.col("heavy") + F.col("light")).withColumn("zero", F.lit(0))
    groups = groups.withColumn("of", F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1).withColumn("p0", share("zero", "total", "terms"))
    groups = _written(groups.drop("zero"), folder, "groups")
    # groups are a small table, which Spark broadcasts if its size allows; else the join is sorted, and hot groups split by AQE
    terms = kept.where(~named).join(groups, ["lang", "source"]).select("lang", "source", "term", "of", share("n", "total", "terms").alias("p"), "p0", share("all_n", "lang_total", "terms").alias("q"), "wide", "heavy", "light")
    return _written(terms, folder, "terms"), groups


_PAIR = T.StructType([T.StructField("lang", T.StringType()), *(T.StructField(c, T.LongType()) for c in ("a", "b", "value"))])


def _rows(lang: list, a: np.ndarray, b: np.ndarray, value: np.ndarray):
    import pyarrow as pa

    return pa.table({"lang": pa.array(lang, pa.string()), "a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "value": pa.array(value, pa.int64())})


def _tile(table):
    """Sums over the terms of one tile, for every pair of a group of its rows with one of its columns."""
    import pyarrow.compute as pc

    lang = table.column("lang")[0].as_py()
    column = {c: table.column(c).to_numpy() for c in ("of", "p", "rows", "cols")}
    absent = table.column("term").is_null().to_numpy(zero_copy_only=False)
    i, j = int(column["rows"][0]), int(column["cols"][0])
    names = pc.dictionary_encode(table.column("term")).combine_chunks()
    term = names.indices.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    groups, p0 = column["of"][absent], column["p"][absent]
    order = np.argsort(groups)
    groups, p0 = groups[order], p0[order]
    dense = np.repeat(p0[:, None], len(names.dictionary), axis=1)
    dense[np.searchsorted(groups, column["of"][~absent]), term[~absent]] = column["p"][~absent]
    row, col = np.flatnonzero(groups // TILE_GROUPS == i), np.flatnonzero(groups // TILE_GROUPS == j)
    a, b, value = [], [], []
    for r in row:
        others = col[col > r]
        if len(others):
            a.append(np.full(len(others), groups[r]))
            b.append(groups[others])
            value.append(_apart(dense[r], dense[others]).sum(axis=1))
    join = lambda x: np.concatenate(x) if x else np.zeros(0, dtype=np.int64)
    return _rows([lang] * sum(map(len, a)), join(a), join(b), join(value))


def heavy_sums(terms: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, a, b, value) with a < b, over heavy terms: one row a pair and tile."""
    tiles = lambda heavy: F.greatest(F.lit(1), F.ceil(F.col(heavy) / TILE_TERMS))
    block = F.expr(f"of div {TILE_GROUPS}")
    blocks = groups.groupBy("lang").agg(F.count("*").alias("n_groups"))
    last = F.expr(f"(n_groups - 1) div {TILE_GROUPS}")
    ours = terms.where(F.col("wide") > HEAVY).select("lang", F.pmod(F.xxhash64("term"), tiles("heavy").cast("long")).alias("tile"), "of", "term", "p")
    lacking = groups.where("heavy > 0").select("lang", F.explode(F.sequence(F.lit(0).cast("long"), (tiles("heavy") - 1).cast("long"))).alias("tile"), "of", F.lit(None).cast("string").alias("term"), F.col("p0").alias("p"))
    both = ours.unionByName(lacking).join(blocks, "lang").withColumn("block", block)
    # a block of sources meets every other once: as rows with those after it, as columns with those before
    pairs = F.transform(F.sequence(F.lit(0).cast("long"), last.cast("long")), lambda other: F.struct(F.least(F.col("block"), other).alias("rows"), F.greatest(F.col("block"), other).alias("cols")))
    both = both.withColumn("pair", F.explode(pairs)).select("lang", "tile", F.col("pair.rows").cast("long").alias("rows"), F.col("pair.cols").cast("long").alias("cols"), F.col("of").cast("long").alias("of"), "term", "p")
    return both.groupBy("lang", "tile", "rows", "cols").applyInArrow(_tile, _PAIR)


def _postings(table):
    """Corrections for the pairs of sources that have a light term, summed over the terms of one group."""
    import pyarrow.compute as pc

    lang, term = (pc.dictionary_encode(table.column(c)).combine_chunks() for c in ("lang", "term"))
    key = lang.indices.to_numpy().astype(np.int64) * (len(term.dictionary) + 1) + term.indices.to_numpy()
    of, p, p0 = (table.column(c).to_numpy() for c in ("of", "p", "p0"))
    order = np.lexsort((of, key))
    key, of, p, p0, lang_of = key[order], of[order].astype(np.int64), p[order], p0[order], lang.indices.to_numpy()[order]
    found = []
    for step in range(1, HEAVY):
        at = np.flatnonzero(key[:-step] == key[step:]) if step < len(key) else np.zeros(0, dtype=np.int64)
        if not len(at):
            break
        to = at + step
        value = _apart(p[at], p[to]) - _apart(p[at], p0[to]) - _apart(p0[at], p[to]) + _apart(p0[at], p0[to])
        found.append(np.stack([lang_of[at].astype(np.int64), of[at], of[to], value]))
    if not found:
        return _rows([], *np.zeros((3, 0), dtype=np.int64))
    found = np.concatenate(found, axis=1)
    found = found[:, np.lexsort(found[2::-1])]
    new = np.flatnonzero(np.append(True, (found[:3, 1:] != found[:3, :-1]).any(axis=0)))
    names = lang.dictionary.to_pylist()
    return _rows([names[k] for k in found[0, new]], found[1, new], found[2, new], np.add.reduceat(found[3], new))


def light_sums(terms: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, a, b, value) with a < b, over light terms: the sum as if no source had one, then corrections."""
    light = terms.where(F.col("wide") <= HEAVY)
    shards = max(1, -(-light.count() // GROUP_POSTINGS))
    dealt = light.select("lang", "term", F.col("of").cast("long").alias("of"), "p", "p0", F.pmod(F.xxhash64("lang", "term"), F.lit(shards)).alias("shard"))
    common = dealt.groupBy("shard").applyInArrow(_postings, _PAIR)
    side = lambda name: groups.select("lang", F.col("of").cast("long").alias(name), F.col("p0").alias(f"{name}0"), *(["light"] if name == "a" else []))
    none = side("a").join(side("b"), "lang").where("a < b").select("lang", "a", "b", (F.col("light") * apart("a0", "b0")).alias("value"))
    shares = light.groupBy("lang", F.col("of").cast("long").alias("x"), "p", "p0").agg(F.count("*").alias("n"))
    own = shares.join(groups.select("lang", F.col("of").cast("long").alias("y"), F.col("p0").alias("y0")), "lang").where("x <> y")
    own = own.select("lang", F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), (F.col("n") * (apart("p", "y0") - apart("p0", "y0"))).alias("value"))
    return common.unionByName(none).unionByName(own)


def pair_divergence(terms: DataFrame, groups: DataFrame) -> DataFrame:
    """lang, source, item (another source of the lang), value, rank: the sum over all kept terms."""
    summed = heavy_sums(terms, groups).unionByName(light_sums(terms, groups)).groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    both = summed.select("lang", "value", F.explode(F.array(F.struct(F.col("a").alias("of"), F.col("b").alias("other")), F.struct(F.col("b").alias("of"), F.col("a").alias("other")))).alias("pair"))
    both = both.select("lang", "value", "pair.of", "pair.other")
    names = groups.select("lang", F.col("of").cast("long").alias("of"), "source")
    named = both.join(names, ["lang", "of"]).join(names.select("lang", F.col("of").alias("other"), F.col("source").alias("item")), ["lang", "other"])
    return named.select("lang", "source", "item", "value", _rank())


def term_divergence(terms: DataFrame, top: int = 10) -> DataFrame:
    """lang, source, item (a term that the source has more of than its language), value, rank up to `top`."""
    ours = terms.where("p > q").select("lang", "source", F.col("term").alias("item"), apart("p", "q").alias("value"))
    return ours.withColumn("rank", _rank()).where(F.col("rank") <= top)


def _rank():
    return F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")).alias("rank")


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = 10, lang: str = "lang", source: str = "source", text: str = "text") -> DataFrame:
    """lang, source, part, item, value, rank. Part `pair`: every other source of the language, by how far it is from
    this one, summed over all terms in at least `least_docs` documents of the language. Part `term`: the terms that
    set a source off from its language, the first `top`.

    Terms are runs of letters (every character but ASCII ones that are none), only A-Z lower-cased. Null text,
    lang and source count as empty, and an empty lang or source is a group as any other. A language
    without kept terms has pairs of value 0; equal values go by item. Repeated rows count each; an empty table
    gives no rows; other columns are ignored. Tables of terms are written to the shared folder."""
    folder = f"{shared_folder(docs.sparkSession)}/divergence-{uuid.uuid4().hex}"
    terms, groups = postings(docs, folder, least_docs, lang=lang, source=source, text=text)
    part = lambda df, name: df.select("lang", "source", F.lit(name).alias("part"), "item", "value", "rank")
    return part(pair_divergence(terms, groups), "pair").unionByName(part(term_divergence(terms, top), "term"))
