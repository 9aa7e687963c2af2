"""From raw documents to encoded training text.

Each stage takes (spark, docs, sf_dir) and gives what goes on; all but the last keep the columns of documents, whatever others
there are and whatever they are called. A null text is an empty one, which the first stage drops; very long texts are read whole; rows may
repeat and doc_ids may be null: of rows that repeat doc_id and text, the one with the smallest hash of all its columns stays or is taken first. An
empty table gives an empty one at every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from trawl.llm.common import materialise, ship_package, table
from trawl.llm.exact_dedup import drop_copies
from trawl.llm.language_id import keep_identified
from trawl.llm.mixing import mixed_documents
from trawl.llm.near_dedup import drop_near_copies
from trawl.llm.sentencepiece import encode_decode


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told go on; texts without a letter and texts that no known language covers do not."""
    ship_package(spark)
    return keep_identified(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the largest doc_id goes on, null last; of rows that are equal in both, one."""
    ship_package(spark)
    return drop_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near copies the one with the smallest doc_id goes on, null last; of texts that share it, the one with the first sha256."""
    ship_package(spark)
    return drop_near_copies(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents go on as often as the mix of sources takes them: not at all, or up to three times."""
    ship_package(spark)
    return mixed_documents(docs)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, piece_ids, n_pieces and the text that they decode to."""
    import public_tokenizers

    ship_package(spark)
    return encode_decode(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("mixing", mixing),
    ("sentencepiece", sentencepiece),
]

#: Filters, signatures, seeded draws and pieces are no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet in the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = materialise(docs)
    return docs
