"""A training corpus in five stages, from documents to packed token ids.

Every stage is a function of (spark, docs, sf_dir); its result is written as Parquet and read as the
next one's docs. All but the last return the columns of documents, whatever further columns there are.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from probity.llm import decontaminate, jaccard_join, mixing, token_packing, toxicity
from probity.llm.textbatch import hidden
from probity.storage import materialise

NEAR_WORDS, NEAR_SIMILARITY = 5, Fraction(8, 10)


def drop_toxic(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose restored text is not scored toxic."""
    own = hidden(docs, "doc_id", "text")
    model = toxicity.trained(own, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.scored(own, model).filter(F.col("score") < toxicity.CUT).select(own.columns).toDF(*docs.columns)


def drop_near_duplicates(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates one row, that of the least doc_id, and all others."""
    return jaccard_join.single(docs, NEAR_WORDS, NEAR_SIMILARITY)


def drop_contaminated(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by the benchmark."""
    own = hidden(docs, "doc_id", "text")
    judged = decontaminate.decontaminate(own, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), keep=tuple(own.columns))
    return judged.filter(~F.col("contaminated")).select(own.columns).toDF(*docs.columns)


def mix_sources(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The words that the mix takes, a row for each document and epoch; rows of an output shard lie in one file."""
    own = hidden(docs, "doc_id", "text", "source", "n_chars")
    return mixing.mixed_texts(own).repartition("shard").select(own.columns).toDF(*docs.columns)


def pack_tokens(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packed rows of token ids."""
    return token_packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("token_packing", pack_tokens),
]

#: models and a tokenizer stand in the way of SQL; the stages are tested one by one against plain Python
ORACLE_SQL = None


def run(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
