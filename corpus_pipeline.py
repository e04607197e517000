"""A corpus pipeline of five stages over ``documents``; each keeps all columns but the last, which packs.

Stages: language ID (rejected documents go), exact dedup, SimHash near-dedup (five words, similarity 0.8;
the smallest doc_id of each group stays), benchmark decontamination (hit documents go), packing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lakeloom.llm.common import discard, materialise, read
from lakeloom.llm.decontaminate import drop_contaminated
from lakeloom.llm.exact_dedup import drop_copies
from lakeloom.llm.language_id import keep_told
from lakeloom.llm.packing import pack, vocabulary
from lakeloom.llm.simhash import keep_one


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_told(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_one(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_contaminated(docs, read(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs, vocabulary())


STAGES = [("language_id", language), ("exact_dedup", exact), ("simhash_near_dedup", near), ("decontamination", benchmark), ("packing", packed)]

#: The tokenizer, the fingerprints and the language model can't be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    before = None
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
        if before is not None:
            discard(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
