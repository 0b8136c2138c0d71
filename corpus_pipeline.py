"""A training corpus from raw documents: five stages, each written as Parquet and read back as the next one's input."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from weftgraph.llm.common import new_folder, table
from weftgraph.llm.decontaminate import without_contaminated
from weftgraph.llm.exact import without_copies
from weftgraph.llm.near import without_near_copies
from weftgraph.llm.pieces import encode_decode
from weftgraph.llm.queries import piece_model
from weftgraph.llm.toxicity import without_toxic


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't predicted toxic; the model is fitted on the labelled ones among ``docs``."""
    return without_toxic(docs, table(spark, sf_dir, "labels"))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text, white space aside."""
    return without_copies(docs)


def unlike(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, similarity 0.8 or more."""
    return without_near_copies(docs, k=5, percent=80)


def unseen(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no benchmark item contaminates."""
    return without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their piece ids, and digests of the ids and of what they decode to."""
    return encode_decode(docs, piece_model(), keep=["doc_id", "lang", "source"], outputs=("n_tokens", "ids", "ids_sha256", "decoded_sha256"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", clean),
    ("exact dedup", distinct),
    ("near dedup", unlike),
    ("decontamination", unseen),
    ("pieces", pieces),
]

#: SQL can express neither the fitted model nor the encoding; tests hold the whole run against plain Python,
#: and every operator against brute force or held-out labels.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole ``documents`` table, each written to the shared folder and read back by the next.

    Rows with null texts or ids, repeated rows and an empty table go through as the stages' operators say.
    """
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = new_folder(spark, "stage-" + name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
