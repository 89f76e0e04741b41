"""Training-data pipeline over ``documents``: five stages, each written and read again.

Toxicity (toxic documents go), exact dedup, SimHash near-dedup (one document of
each group stays), benchmark decontamination and packing. A stage works on what
its predecessor kept.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tessera.llm.common import table
from tessera.session import checkpoint_root


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    from tessera.llm.toxicity import drop_toxic, fit
    return drop_toxic(docs, fit(docs, table(spark, sf_dir, "labels")))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    from tessera.llm.exact_dedup import keep_unique
    return keep_unique(docs)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    from tessera.llm.simhash import keep_representatives
    return keep_representatives(docs, k=4, radius=4)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    from tessera.llm.decontam import drop_contaminated
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from tessera.llm.packing import harmonic_pack
    return harmonic_pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", toxicity),
    ("exact_dedup", exact_dedup),
    ("simhash_near_dedup", simhash_near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("packing", packing),
]

#: The toxicity model and the fingerprint components are beyond SQL; tests hold the stages
#: against brute force.
ORACLE_SQL = None


def _delete(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.sc().hadoopConfiguration()).delete(target, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces. Every stage is written to the shared checkpoint folder and read from
    there by the next; a stage's table goes when its successor is written."""
    docs = table(spark, sf_dir, "documents")
    out = f"{checkpoint_root(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    before = None
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{out}/{name}")
        docs = spark.read.parquet(f"{out}/{name}")
        if before is not None:
            _delete(spark, before)
        before = f"{out}/{name}"
    return docs
