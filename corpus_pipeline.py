"""A training-data pipeline of five stages, each one operator of zonehour.llm.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
as Parquet and read again as the next stage's docs. All but the last return the
columns of documents. Every stage takes an empty table to an empty one, passes on
columns that it doesn't know, whatever their names, treats repeated rows alike
and reads texts whole, however long; what it does with nulls, its docstring says.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from zonehour.llm.common import fold, staged


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts without letters (null and empty ones too) and those that no language is likely for; fills in a missing lang.

    A tie of languages goes to the first by name.
    """
    from zonehour.llm.language_id import UNDETERMINED, identify, learn

    x = identify(docs, learn(docs, fold("doc_id", 3) != 1))
    unlikely = (F.col("lang_pred") == UNDETERMINED) | (F.col("ambiguous") & (F.col("score") < 0.4))
    return x.where(~unlikely).select(*[F.coalesce("lang", "lang_pred").alias("lang") if c == "lang" else F.col(c) for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of the smallest id of each group of near copies.

    Near copies share 80 % of their five-word shingles or more. Of repeated rows
    one stays; null, empty and blank texts are one group; a group without any id
    keeps one of its rows.
    """
    from zonehour.llm.simhash import one_of_each

    return one_of_each(docs)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that hold a benchmark item, or a stretch within a fifth of its words in edits. Null texts stay."""
    from zonehour.llm.decontaminate import decontaminated

    return decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by surrogates; n_chars is that of the new text. Null texts stay null."""
    from zonehour.llm.pii import pseudonymise

    x = pseudonymise(docs)
    length = F.when(F.col("n_entities") > 0, F.char_length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return x.select(*[length.alias(c) if c == "n_chars" else F.col(c) for c in docs.columns])


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, with the words taken of each, repeats counted.

    Null and wordless texts have no words to take; a null source is one of its
    own; ties of finish times go by source and id.
    """
    from zonehour.llm.mixing import mix_sources

    return mix_sources(docs).where("taken > 0")


STAGES = [
    ("language", language),
    ("near duplicates", near_duplicates),
    ("benchmark passages", benchmark_passages),
    ("personal data", personal_data),
    ("mix", mix),
]

#: Fingerprints, edit distance and learned models are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each stage's result as a table in the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), "pipeline")
    return STAGES[-1][1](spark, docs, sf_dir)
