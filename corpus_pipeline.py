"""Corpus pipeline over ``documents``: five stages, each on all rows that the
one before it kept.

1. language_id: rows whose language is not recognised go.
2. near_dedup: one document of each near-duplicate group stays.
3. decontamination: documents that hold a passage of ``benchmark`` go.
4. mixing: a token budget is shared out over domains, languages and sources;
   each source's seeded token prefix stays.
5. sharding: the rest is dealt to shards of nearly equal bytes, documents of a
   source together.  (Stage 2 left no equal texts, so the source, which stands
   for the host, is the link; a source larger than a shard fills one, and its
   rest and documents without a source are laid out by hash.)

Null ids and texts: a null text has no language and goes in stage 1; rows with
a null id have no duplicates, and rows that share an id stay or go together.
Empty tables pass through.  Stages 1 to 4 return the columns of their input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.decontaminate import decontaminate
from tessera.llm.langid import keep_identified
from tessera.llm.mixing import select_mixture
from tessera.llm.neardup import drop_near_duplicates
from tessera.llm.queries import WEIGHTS, domain_of
from tessera.llm.sharding import shard_documents
from tessera.llm.tables import staged, table

#: Share of the tokens that reach the mixing stage.
BUDGET = 0.8


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_identified(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return select_mixture(docs, domain_of(), F.floor(F.col("n") * BUDGET), WEIGHTS)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    source = F.col("source").cast("string")
    return shard_documents(docs, link=F.when(source != "", F.xxhash64(source)))


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("sharding", sharding),
]

#: The language model and the hashes of the order keys have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written as Parquet and reread as the next one's docs."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = staged(docs, f"stage-{name}")
    return docs
