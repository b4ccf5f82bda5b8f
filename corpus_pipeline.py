"""Training-data pipeline over ``documents``: toxic and poor documents go, one
document of each group of near copies stays, contaminated documents go, and
the rest is packed into token sequences.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run``
writes it as Parquet to the shared folder and rereads it for the next one.
All stages but the last return the columns of their input. An empty table
passes through; extra columns stay; what a stage does with nulls and repeated
rows is stated in its operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.llm import decontaminate, minhash, packing, quality, toxicity
from ledgerlens.llm.common import stored, table
from ledgerlens.llm.queries import KEEP_QUALITY, TOXIC_FROM, rated_documents, tokenizer_path, toxic_labelled

NEAR_COPY_PERCENT = 80


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.fit(toxic_labelled(spark, sf_dir, docs))
    return docs.where(toxicity.score(docs, model) < TOXIC_FROM)


def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = quality.fit(rated_documents(spark, sf_dir, docs))
    return docs.where(quality.grade_column(docs, model)["tail"] >= KEEP_QUALITY)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash.keep_one(docs, percent=NEAR_COPY_PERCENT)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.remove_documents(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, tokenizer_path())


STAGES = [("toxicity", drop_toxic), ("quality", drop_poor), ("near_dedup", drop_near_copies),
          ("decontamination", drop_contaminated), ("packing", pack)]

#: Two stages are learned models, so there is no SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
