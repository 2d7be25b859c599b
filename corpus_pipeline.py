"""Cleaning a corpus, stage by stage.

Each stage takes (spark, docs, sf_dir), works on all that the stage before it
kept, and returns a DataFrame; ``run`` writes each stage's rows below
``spark.checkpoint.dir`` and rereads them as the next stage's ``docs``.  All
stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from batchwright.llm import bpe, decontaminate, jaccard, secrets, toxicity
from batchwright.llm.common import stored, table


def toxic_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the field scores 0.5 or more go.  It learns from the
    labelled rows of these documents that query op1 also learns from."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels").where(toxicity.learn_rows()))
    return toxicity.keep_clean(docs, model)


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts connected by a five-word Jaccard similarity of 0.8 or more, the smallest id stays."""
    return jaccard.keep_one(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of whose words a twentieth or more lies in benchmark windows go."""
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def secrets_masked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents stay; each secret in a text gives way to a mark.
    ``n_chars`` stays what it says of the original text."""
    return secrets.redact(docs)


def tokenised(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256, ids) of what is left."""
    return bpe.round_trip(docs, bpe.vocabulary(spark))


STAGES = [
    ("toxicity", toxic_out),
    ("near duplicates", one_of_near_copies),
    ("benchmark decontamination", decontaminated),
    ("secrets", secrets_masked),
    ("tokens", tokenised),
]

#: The field of the first stage, whose weights are learned, is beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return docs
