"""The corpus pipeline: quality rules, line dedup, n-gram Jaccard dedup,
benchmark decontamination and SentencePiece encoding, each by its operator.

Every stage takes (spark, docs, sf_dir), works on all that its predecessor
kept and returns a DataFrame; ``run`` writes it as Parquet in the shared folder
and rereads it for the next stage.  All but the last return the columns of
``documents``; the last adds ``ids``, the pieces of the text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from promolens.llm.common import documents, shared_table
from promolens.llm.jaccard_join import jaccard_stage
from promolens.llm.line_join import line_stage
from promolens.llm.quality_llr import quality_stage
from promolens.llm.sentencepiece_dropout import encoding_stage
from promolens.llm.template_decon import decontamination_stage

STAGES = [
    ("quality rules", quality_stage),
    ("line dedup", line_stage),
    ("n-gram Jaccard join", jaccard_stage),
    ("benchmark decontamination", decontamination_stage),
    ("SentencePiece encoding and decoding", encoding_stage),
]

#: no SQL form: hashed models, iterated joins and the encoder are tested against brute force instead
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = shared_table(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
