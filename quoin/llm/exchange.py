"""Rounds of compact messages between batches of documents and shards of keys.

Several operators ask the same question of every position of every text: "where else does this
key occur?". One row per position would make the shuffle many times the input. Here documents
are grouped once into batches of a few megabytes; a batch sends each shard one blob with its
sorted distinct keys (so a key that a third of all rows share costs one entry a batch), and the
shard's answer is an array aligned with what was sent. Batches are named by a hash of the
document, not by the task, so a lost executor's batches are rebuilt exactly as they were.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BATCH_BYTES = 8 << 20
MOST_BYTES = 256 << 20
#: Stands for a missing doc_id within the operators: the least of all. Results show it as null again.
NO_ID = -(1 << 63)


def known_id(column="doc_id"):
    return F.coalesce(F.col(column).cast("long"), F.lit(NO_ID))


def shown_id(column="doc_id"):
    return F.when(F.col(column) != NO_ID, F.col(column)).alias(column)


def row_key():
    """Names each different (doc_id, text): rows of one doc_id, or of none, stay apart by it."""
    return F.xxhash64(known_id(), "text")


def small_batches(spark, rows: int = 1000) -> None:
    """Texts go to Python in batches of so many rows, unless the session sets a number of its own:
    the default of 10,000 rows would hold tens of megabytes of text several times over."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == "10000":
        spark.conf.set(name, str(rows))


def shuffle_parts(spark) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def batched(docs: DataFrame, batch_bytes: int = BATCH_BYTES) -> tuple[DataFrame, int]:
    """(batch, doc_id, text as bytes) of every row, shuffled by batch once, and the number of batches.

    Batches and shards both grow in number with the input, and what one sends another must not
    shrink to nothing: a batch has as many bytes as the square root of the input's times 4096, from
    `batch_bytes` up to MOST_BYTES, so a blob stays near 1 kB up to some tens of terabytes."""
    small_batches(docs.sparkSession)
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    batch_bytes = max(batch_bytes, min(MOST_BYTES, math.isqrt(total * 4096)))
    n = max(math.ceil(total / batch_bytes), min(32, math.ceil(total / (1 << 18))), 1)
    rows = docs.select(
        F.pmod(F.xxhash64("doc_id", "text"), F.lit(n)).cast("int").alias("batch"),
        known_id().alias("doc_id"),
        F.col("text").cast("binary").alias("text"),
    )
    return rows.repartition("batch"), n


def ordered(table):
    """A group's documents in an order that doesn't hang on the shuffle."""
    import pyarrow as pa

    text = table.column("text").combine_chunks() if table.num_rows else table.column("text")
    if isinstance(text, pa.ChunkedArray):
        text = pa.array(text.to_pylist(), type=pa.binary())
    ids = table.column("doc_id").to_numpy()
    texts = [x or b"" for x in text.to_pylist()]
    order = sorted(range(len(ids)), key=lambda i: (ids[i], texts[i]))
    return ids[order], [texts[i] for i in order]


def shared_folder(spark) -> str:
    """A folder that all executors see: spark.checkpoint.dir, or the warehouse where that is unset."""
    return (spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.sql.warehouse.dir")).rstrip("/")
