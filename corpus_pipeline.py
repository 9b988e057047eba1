"""Corpus pipeline: documents in, packed token sequences out.

``STAGES`` are (name, function); a function takes (spark, docs, sf_dir) and returns a
DataFrame that is written as Parquet and read again as the next one's docs.  All but
the last return the columns of ``documents``.

1. language ID: learned from the docs given; without a letter, or with a best
   language of less than ``MIN_SCORE``, a document goes; where no row has a language
   to learn from, every document with a letter stays
2. line dedup: repeated chunks of lines go, but for their first place
3. SimHash near-dedup: of each group the document of smallest doc_id stays
4. PII: surrogates for personal data
5. best-fit packing: token pieces in sequences

``n_chars`` follows the text where a stage changes it.  What null, empty, repeated and
very long texts, ties, empty tables and extra columns mean is told with each operator.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitewatch.llm import langid, linededup, packing, pii, simhash
from sitewatch.llm.common import free_name
from sitewatch.session import materialize

MIN_SCORE = 0.5
KEY = b"surrogates of the corpus pipeline"      # an own secret key for real use


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = langid.train(docs)
    if not model.langs:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    lang, score = free_name(docs, "lang_"), free_name(docs, "score_")
    found = langid.predict(docs, model, lang_out=lang, score_out=score)
    return found.where((F.col(lang) != langid.UNKNOWN) & (F.col(score) >= MIN_SCORE)).select(*[F.col(f"`{c}`") for c in docs.columns])


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _counted(linededup.remove_repeated_chunks(docs), docs)


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs)


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _counted(pii.replace_entities(docs, KEY), docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.packed_documents(docs)


def _counted(out: DataFrame, docs: DataFrame) -> DataFrame:
    if "n_chars" not in docs.columns:
        return out
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", identify_language),
    ("line_dedup", dedup_lines),
    ("simhash_near_dedup", dedup_documents),
    ("pii", replace_personal_data),
    ("packing", pack),
]

# SQL expresses neither the trained classifier nor the tokenizer: tests/llm/test_pipeline.py
# holds the stages against brute-force versions instead.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
