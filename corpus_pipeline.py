"""The corpus pipeline: from raw documents to encoded training text.

Each stage takes (spark, docs, sf_dir) and returns the documents it kept, with the columns of
``documents``; the last returns token ids.

1. language: documents without letters go; ``lang`` becomes the predicted language.
2. near_duplicates: of each group of near copies the document of least id stays.
3. private_data: personal data in texts is replaced by its kind.
4. mixing: sources are mixed to their target weights; a document taken in part keeps its
   taken words, one taken twice comes twice.
5. encoding: texts become token ids.

Cases: a null or empty text, and one without letters, goes in the first stage; a null id or
source is a value like any other; repeated rows are near copies of each other, so one stays;
texts of any length are taken whole; an empty table gives an empty table; columns beyond
those of ``documents`` are dropped by the first stage, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tessera.llm import bpe, jaccard_join, language, mixing, pii
from tessera.llm.queries import table, vocabulary
from tessera.llm.staging import Stage

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    named = language.identify(docs.select(*COLUMNS)).filter(F.col("lang_pred") != language.UNKNOWN)
    return named.withColumn("lang", F.col("lang_pred")).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.keep_one(docs.select(*COLUMNS))


def redact_private_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = pii.find(docs.select(*COLUMNS))
    clean = found.withColumn("text", pii.redact(F.col("text"), F.col("entities")))
    return clean.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    mixed = mixing.take_pieces(docs.select(*COLUMNS))
    return mixed.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def encode_text(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encode(docs.select(*COLUMNS), vocabulary()).select("doc_id", "lang", "source", "n_chars", "n_tokens", "token_ids")


STAGES = [
    ("language", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("private_data", redact_private_data),
    ("mixing", mix_sources),
    ("encoding", encode_text),
]

# Neither expectation-maximisation nor byte-pair merges can be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what lies between two is a staged table."""
    stage = Stage(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, f in STAGES[:-1]:
        docs = stage.put(name, f(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
