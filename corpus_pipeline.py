"""The corpus pipeline: five stages over ``documents``, each written and read again.

``STAGES`` lists ``(name, function)``; each function takes ``(spark, docs,
sf_dir)`` and returns a DataFrame.  All but the last return the columns of
``documents``; the last returns the encoded corpus.  Nulls, empty texts, ties,
repeated rows, empty tables and further columns are treated as the operators'
docstrings say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from accesslens.llm.bpe import encode
from accesslens.llm.common import drop_staged, read_table, stage
from accesslens.llm.mixing import mixed_documents
from accesslens.llm.neardup import deduplicated
from accesslens.llm.pii import redacted
from accesslens.llm.quality import kept_documents


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep; the others go."""
    return kept_documents(docs)


#: Bytes of an Arrow batch, of which Python workers and the executors' buffers hold whole ones: rows are of any size.
BATCH = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Bound batches by bytes in this session; results don't depend on it, and frames run after their stage's function."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    small_batches(spark)
    return deduplicated(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data in their texts replaced by its kind; ``n_chars`` follows the text."""
    clean = redacted(docs)
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources to target weights: each document as often as the mix takes it."""
    return mixed_documents(docs)


#: Bytes of words that a worker remembers while it encodes: memory is short after four stages, time is not.
REMEMBERED = 16 << 20


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document of the mix with its token ids; of the text, digests of ids and of the decoded text stay."""
    import public_tokenizers

    small_batches(spark)
    keep = [c for c in docs.columns if c != "text"]
    return encode(docs, public_tokenizers.path("byte_bpe_50k.json"), keep=keep, with_ids=True, remembered=REMEMBERED)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("mixing", mixing),
    ("encoding", encoding),
]

#: Sketches, learned patterns and merges have no SQL form; tests compare with brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read by the next."""
    docs = read_table(spark, sf_dir, "documents")
    for i, (name, function) in enumerate(STAGES[:-1]):
        done = stage(function(spark, docs, sf_dir), f"pipeline-{name}")
        if i:
            drop_staged(docs)
        docs = done
    return STAGES[-1][1](spark, docs, sf_dir)
