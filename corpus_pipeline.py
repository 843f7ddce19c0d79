"""The corpus pipeline: quality rules, near-dedup, secret scans, source mixing and SentencePiece encoding, in order."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from lading.llm.common import settle_alone, shared_dir, table
from lading.llm.mixing import mixed
from lading.llm.quality import quality_filter
from lading.llm.secrets import redact
from lading.llm.sentencepiece import encoded
from lading.llm.similar import one_of_each

#: Words of a shingle, and the Jaccard similarity of two sets of shingles from which documents are near duplicates.
SHINGLE_WORDS, SIMILAR = 5, 0.8


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the rules reject: null, empty and very short texts, and outliers of their language and
    source, a null one being a group too. Repeated rows are judged alike; an empty table gives no rows; other columns stay."""
    return quality_filter(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of near duplicates, that of the smallest id, null last; of rows that repeat an id the
    first by file and place. Null and empty texts are one group; an empty table gives no rows; other columns stay."""
    return one_of_each(docs, SHINGLE_WORDS, SIMILAR)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces the secrets in texts; n_chars follows. Null and empty texts stay as they are; repeated rows are cleaned
    each; very long texts take time in proportion; an empty table gives no rows; other columns stay."""
    return redact(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes whole documents, some more than once, some not at all, so that sources' words meet their targets; each
    partition, so each file, is a shuffled shard. Texts without words are in none; null is a source; repeated rows are
    drawn each; an empty table gives no rows; other columns stay."""
    return mixed(docs)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each text's ids instead of the text; a null or empty text has none. Repeated rows are encoded each; very long texts
    are encoded whole; an empty table gives no rows; other columns stay."""
    return encoded(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality),
    ("SimHash near-dedup", near_dedup),
    ("secret scans", secrets),
    ("source mixing", mixing),
    ("SentencePiece encoding", pieces),
]

#: Fingerprints, draws and pieces can't be had in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each one's rows written and read again for the next; what came before is then deleted."""
    docs, begun = table(spark, sf_dir, "documents"), shared_dir(spark)
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = settle_alone(docs, begun)
    return docs
