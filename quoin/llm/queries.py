"""The queries over the given tables, one for each operator of this subpackage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quoin.llm import contamination, conversations, divergence, fingerprints, html, language, neardup, packing, perplexity, repeats, secrets, tokens


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _remainder(n: int):
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(n))


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"))


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = language.train(docs.where(_remainder(3) != 1))
    told = language.identify(docs.select("doc_id", "text"), model)
    return told.select("doc_id", F.coalesce(_remainder(3) == 1, F.lit(False)).alias("held_out"), "lang_pred", "score", "known")


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination.find_contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = repeats.suffix_dedup(_table(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = repeats.substring_dedup(_table(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.components(_table(spark, sf_dir, "documents"), words=4)


def op7_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = html.extract(_table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return pages.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.scan(_table(spark, sf_dir, "documents")))


def op9_perplexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return perplexity.score(_table(spark, sf_dir, "documents"))


def op10_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.with_edits(_table(spark, sf_dir, "documents"))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(_table(spark, sf_dir, "documents"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.reports(conversations.damage(_table(spark, sf_dir, "conversations")), live="live")


def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.count_tokens(_table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_bytes", "n_tokens", "over_limit")


_ALL = (
    op1_packing, op2_language, op3_decontamination, op4_suffix_dedup, op5_substring_dedup, op6_near_duplicates, op7_main_text,
    op8_secrets, op9_perplexity, op10_fingerprint, op11_source_divergence, op12_conversation_repair, op13_token_counts,
)
QUERIES = {f.__name__: f for f in _ALL}

#: Words of op3's kind, from a lower-cased text.
_WORDS3 = "list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')"

ORACLES = {
    "op3_decontamination": f"""
WITH d AS (SELECT doc_id, {_WORDS3} AS w FROM documents),
b AS (SELECT item_id, {_WORDS3} AS w FROM benchmark),
q AS (SELECT item_id, s, CASE WHEN len(w) < 10 THEN len(w) ELSE 10 END AS k,
             array_to_string(w[s + 1 : s + (CASE WHEN len(w) < 10 THEN len(w) ELSE 10 END)], ' ') AS phrase
      FROM (SELECT item_id, w, unnest(range(0, greatest(1, len(w) - 9))) AS s FROM b WHERE len(w) > 0)),
widths AS (SELECT DISTINCT k FROM q),
g AS (SELECT doc_id, s, k, array_to_string(w[s + 1 : s + k], ' ') AS phrase
      FROM (SELECT doc_id, w, k, unnest(range(0, len(w) - k + 1)) AS s FROM d, widths WHERE len(w) >= k)),
m AS (SELECT g.doc_id, g.s, g.k, q.item_id FROM g JOIN q ON g.phrase = q.phrase AND g.k = q.k),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + k)) AS p FROM m) GROUP BY doc_id),
i AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
      FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item_id FROM m) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h ON d.doc_id = h.doc_id LEFT JOIN i ON d.doc_id = i.doc_id
""",
    "op4_suffix_dedup": """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
g AS (SELECT doc_id, s, substr(h, 2 * s + 1, 100) AS p FROM (SELECT doc_id, h, unnest(range(0, len(h) // 2 - 49)) AS s FROM d WHERE len(h) >= 100)),
f AS (SELECT p, min(doc_id) AS first FROM g GROUP BY p),
c AS (SELECT DISTINCT g.doc_id, unnest(range(g.s, g.s + 50)) AS i FROM g JOIN f ON g.p = f.p WHERE g.doc_id > f.first),
n AS (SELECT doc_id, count(*) AS n_removed, sum(CASE WHEN i = before + 1 THEN 0 ELSE 1 END) AS n_spans
      FROM (SELECT doc_id, i, coalesce(lag(i) OVER (PARTITION BY doc_id ORDER BY i), -2) AS before FROM c) GROUP BY doc_id),
b AS (SELECT d.doc_id, i, substr(h, 2 * i + 1, 2) AS x FROM (SELECT doc_id, h, unnest(range(0, len(h) // 2)) AS i FROM d WHERE doc_id IN (SELECT doc_id FROM n)) d),
k AS (SELECT b.doc_id, string_agg(b.x, '' ORDER BY b.i) AS kept FROM b ANTI JOIN c ON b.doc_id = c.doc_id AND b.i = c.i GROUP BY b.doc_id)
SELECT d.doc_id, CAST(len(d.h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
       sha256(unhex(CASE WHEN n.doc_id IS NULL THEN d.h ELSE coalesce(k.kept, '') END)) AS kept_sha256
FROM d LEFT JOIN n ON d.doc_id = n.doc_id LEFT JOIN k ON d.doc_id = k.doc_id
""",
    "op5_substring_dedup": """
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
g AS (SELECT doc_id, s, array_to_string(w[s + 1 : s + 20], ' ') AS p FROM (SELECT doc_id, w, unnest(range(0, len(w) - 19)) AS s FROM d WHERE len(w) >= 20)),
f AS (SELECT doc_id, s, row_number() OVER (PARTITION BY p ORDER BY doc_id, s) AS r FROM g),
c AS (SELECT DISTINCT doc_id, unnest(range(s, s + 20)) AS i FROM f WHERE r > 1),
n AS (SELECT doc_id, count(*) AS n_removed FROM c GROUP BY doc_id),
b AS (SELECT doc_id, unnest(range(0, len(w))) AS i, unnest(w) AS x FROM d WHERE doc_id IN (SELECT doc_id FROM n)),
k AS (SELECT b.doc_id, string_agg(b.x, ' ' ORDER BY b.i) AS kept FROM b ANTI JOIN c ON b.doc_id = c.doc_id AND b.i = c.i GROUP BY b.doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
       sha256(CASE WHEN n.doc_id IS NULL THEN array_to_string(d.w, ' ') ELSE coalesce(k.kept, '') END) AS kept_sha256
FROM d LEFT JOIN n ON d.doc_id = n.doc_id LEFT JOIN k ON d.doc_id = k.doc_id
""",
    "op6_near_duplicates": """
WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(w) < 4 THEN array_to_string(w, ' ') ELSE array_to_string(w[i + 1 : i + 4], ' ') END AS g FROM (SELECT doc_id, w, unnest(range(0, greatest(1, len(w) - 3))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * i >= 80 * (nx.n + ny.n - i)),
t AS (SELECT x AS a, y AS b FROM e UNION ALL SELECT y, x FROM e),
c AS (SELECT a AS id, a AS root FROM t UNION SELECT t.b, c.root FROM c JOIN t ON c.id = t.a),
k AS (SELECT id, min(root) AS component FROM c GROUP BY id)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, coalesce(k.component, d.doc_id) AS component_id, coalesce(k.component, d.doc_id) = d.doc_id AS kept
FROM d LEFT JOIN n ON d.doc_id = n.doc_id LEFT JOIN k ON d.doc_id = k.id
""",
    "op11_source_divergence": """
WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                  list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS w FROM documents),
g AS (SELECT DISTINCT lang, source FROM d),
t AS (SELECT id, lang, source, term, count(*) AS n FROM (SELECT id, lang, source, unnest(w) AS term FROM d) GROUP BY ALL),
kept AS (SELECT lang, term, CAST(sum(n) AS BIGINT) AS n FROM t GROUP BY lang, term HAVING count(*) >= 10),
v AS (SELECT lang, count(*) AS v, sum(n) AS total FROM kept GROUP BY lang),
c AS (SELECT g.lang, g.source, k.term, coalesce(s.n, 0) AS n, k.n AS lang_n
      FROM g JOIN kept k ON g.lang = k.lang LEFT JOIN (SELECT lang, source, term, sum(n) AS n FROM t GROUP BY ALL) s ON s.lang = g.lang AND s.source = g.source AND s.term = k.term),
p AS (SELECT c.lang, c.source, c.term, c.n, CAST(1 + (1000000000 * (CAST(c.n AS HUGEINT) + 2)) // (sum(c.n) OVER (PARTITION BY c.lang, c.source) + 2 * v.v) AS BIGINT) AS p,
             CAST(1 + (1000000000 * (CAST(c.lang_n AS HUGEINT) + 2)) // (v.total + 2 * v.v) AS BIGINT) AS q
      FROM c JOIN v ON c.lang = v.lang),
f AS (SELECT a.lang, a.source, b.source AS item, CAST(sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS BIGINT) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pair AS (SELECT a.lang, a.source, b.source AS item, coalesce(f.value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
         LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source),
term AS (SELECT lang, source, term AS item, (p - q) * (p - q) // (p + q) AS value FROM p WHERE n > 0 AND p > q),
r AS (SELECT *, 'pair' AS part FROM pair UNION ALL SELECT *, 'term' AS part FROM term)
SELECT lang, source, part, item, value, CAST(rank AS INTEGER) AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS rank FROM r) WHERE part = 'pair' OR rank <= 10
""",
}
