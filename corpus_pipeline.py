"""From raw documents to token files: the corpus operators as a pipeline of stages.

Every stage takes (spark, docs, sf_dir) and gives a DataFrame, which is written as Parquet and read
again as the next one's ``docs``; all but the last keep the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from strataloom.llm.common import materialize, shared_path
from strataloom.llm.decontaminate import remove_contaminated
from strataloom.llm.mixing import mix_sources, repeat_documents
from strataloom.llm.simhash import drop_near_duplicates
from strataloom.llm.token_files import read_token_files, write_token_files
from strataloom.llm.toxicity import filter_toxic, fit_toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores below 0.7; it learns from the labels that aren't held out.

    Null and empty texts have no toxic words and stay, as do rows with a null in any other column;
    equal texts stay or go together, repeated rows too. An empty table gives an empty one.
    """
    return filter_toxic(docs, fit_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose five-word shingles are 0.8 or more alike: that of least id.

    Null and empty texts are one group, null ids come last, and rows that repeat another leave one.
    An empty table gives an empty one.
    """
    return drop_near_duplicates(docs)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of ten words, or whole shorter item, of the benchmark.

    Null and empty texts stay, repeated rows stay or go alike, and an empty table or benchmark drops
    nothing.
    """
    return remove_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix of sources takes it.

    A null source is a source, null and empty texts have size 0 and come as their place in the order
    says, and the copies of an id that repeats are dealt to its rows in turn. An empty table gives
    an empty one.
    """
    return repeat_documents(docs, mix_sources(docs))


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' places in the token files, as read from them.

    Null and empty texts are an end alone, null ids come first, each of repeated rows has a place of
    its own, and an empty table gives no rows.
    """
    import public_tokenizers

    folder = shared_path(spark, "pipeline-tokens")
    write_token_files(docs, folder, public_tokenizers.path("byte_bpe_50k.json"))
    return read_token_files(spark, folder)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_copies),
    ("benchmark_decontamination", drop_benchmark_leaks),
    ("mix_sources", mix),
    ("token_files", write_tokens),
]

#: Toxicity scores, near copies and tokens are beyond SQL; tests/llm compare with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
