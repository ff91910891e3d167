"""A training corpus from raw documents: STAGES, each one operator of tallymark.llm, written and read again in between.

language_id drops documents whose language can't be told; exact_dedup and near_dedup keep one of equal and of similar
documents (five-word shingles, similarity 0.8); mix_sources repeats and leaves out documents towards the target weights;
pack lays what is left into sequences and returns the pieces.

Edge cases: a null text and one without a letter go in the first stage, the latter also where no row is labelled and so no language
can be told; rows alike in doc_id and text count as one another's copies, and a null doc_id is kept like any other; a null source is
a source of its own; an empty table goes through every stage and gives no pieces; texts of any length are read whole; columns may
have any names, all but the last stage return them as they came.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallymark.llm import curve_packing, exact_dedup, language_crf, mixing, ngram_join
from tallymark.llm.shared import keep_rows, materialise, ship

#: A trained model decides stage 1 and a random offset stage 4, so no SQL gives run()'s rows.
ORACLE_SQL = None


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return language_crf.keep_identified(docs, language_crf.train(docs))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return keep_rows(docs, exact_dedup.dedup(docs).filter("kept").select("doc_id", "h"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return ngram_join.one_of_each(docs, n=5, num=4, den=5)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return mixing.mix(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    ship(spark)
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("word_bpe_49k.json")
    return curve_packing.pack(docs, tokenizer)


STAGES = [("language_id", language_id), ("exact_dedup", exact_copies), ("near_dedup", near_copies), ("mix_sources", mix_sources), ("pack", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table; the last one's rows."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = materialise(docs, name)
    return docs
