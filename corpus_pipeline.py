"""A corpus pipeline of five stages, each a table written and read again by the next."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quoin.llm import contamination, language, neardup, packing, secrets
from quoin.llm.exchange import row_key

#: A text of so many n-grams or more is rejected if no language contains this share of them.
LEAST_GRAMS, LEAST_KNOWN = 20, 0.25

#: No SQL expresses these stages; tests hold them against plain versions.
ORACLE_SQL = None


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop texts of no language (null, without letters, or of mostly unknown n-grams); fill in a missing lang.

    The filter learns from the rows that name their language; if none does, only texts without
    letters go."""
    model = language.train(docs)
    told = language.identify(docs.select(F.struct(*docs.columns).alias("row"), F.col("text")), model)
    kept = F.col("lang_pred") != "und" if model.languages else F.col("text").rlike(r"\p{L}")
    known = (F.col("known") >= LEAST_KNOWN) | (F.col("n_grams") < LEAST_GRAMS) if model.languages else F.lit(True)
    rows = told.where(kept & known)
    fill = lambda c: F.coalesce(F.col("row")[c], F.col("lang_pred")) if c == "lang" and model.languages else F.col("row")[c]
    return rows.select(*[fill(c).alias(c) for c in docs.columns])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document of the least doc_id of each group of near duplicates. Rows of one doc_id, or of
    none, are told apart by their texts."""
    return neardup.deduplicate(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold ten consecutive words of a benchmark item, or a shorter item whole; of rows with one
    doc_id, or none, only those that do."""
    rows = docs.withColumn("_contaminated_row", row_key())
    found = contamination.find_contaminated(rows.select(F.col("_contaminated_row").alias("doc_id"), "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    bad = found.where("contaminated").select(F.col("doc_id").alias("_contaminated_row")).distinct()
    return rows.join(bad, "_contaminated_row", "left_anti").select(*docs.columns)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace secrets in texts; n_chars follows the new text."""
    clean = secrets.redact(docs)
    return clean.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else clean


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of all texts in sequences of the permitted lengths."""
    return packing.pack(docs)


STAGES = [
    ("language", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("secrets", redact_secrets),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str, folder: str | None = None) -> DataFrame:
    """The last stage's rows. Each stage is written as Parquet under `folder` (by default under the
    session's spark.checkpoint.dir, or the warehouse where that is unset) and read by the next."""
    if folder is None:
        shared = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.sql.warehouse.dir")
        folder = f"{shared.rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{number}_{name}"
        stage(spark, docs, sf_dir).write.mode("overwrite").parquet(path)
        docs = spark.read.parquet(path)
    return docs
