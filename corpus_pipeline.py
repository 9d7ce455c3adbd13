"""A corpus pipeline: stages that each apply one training-data operator to all their predecessor kept.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame, which is
written and read again as the next one's ``docs``.  All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lanternql.llm import common, decontaminate, mixing, quality_rules, simhash, token_file


#: Bytes of a batch to Python: executors keep the workers of earlier stages, so those at work get by with less than
#: a query alone may take.
BATCH_BYTES = 3 << 20


def sparing(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    sparing(spark)
    return quality_rules.keep_good(docs)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays."""
    sparing(spark)
    return simhash.keep_one(docs)


def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    sparing(spark)
    return decontaminate.without_leaks(docs, common.table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents stand as often as their source's budget takes them."""
    return mixing.mix(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token file, as read back: doc_id, start, n_tokens, ids_crc32."""
    sparing(spark)
    import public_tokenizers

    path = common.shared_path(spark, "token-file")
    token_file.write(docs, public_tokenizers.path("byte_bpe_50k.json"), path)
    return token_file.read(spark, path)


STAGES = [
    ("quality_rules", good),
    ("simhash_near_dedup", one_of_each_group),
    ("benchmark_decontamination", uncontaminated),
    ("mix_to_weights", mixed),
    ("token_output", tokens),
]

#: XXH64 with a seed and byte-pair encoding are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs, _ = common.materialized(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
