"""From raw documents to packed training sequences, in five stages. Each takes (spark, docs, sf_dir) and returns a DataFrame,
which is written as Parquet and read again for the next; all but the last return the columns of documents.

What every stage does with odd input: columns beyond doc_id, text, lang, source and n_chars are carried along unchanged, whatever
their names; null and empty texts, null ids, repeated rows and ties are documents like others; texts are read whole, however
long; an empty table gives an empty table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import mixing, packing, quality, simhash, suffix
from quarry.llm.common import discard, read, shielded, stored


@shielded
def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go. Null and empty texts are scored as empty, repeated rows alike. A
    rejected one scores under 0.5; without labels of both classes, all score the share of good ones among the labels (0.5
    without any), so documents stay unless all labels are bad."""
    params = quality.QualityParams()
    model = quality.fit(docs, read(spark, sf_dir, "labels"), params)
    return quality.score(docs, model).where(F.col("quality_score") >= params.threshold).select(*docs.columns)


@shielded
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: five-word shingles, similarity of 0.8 or more, the least doc_id first
    and null ids last. Texts without words (null ones too) are copies of each other."""
    return simhash.drop_near_copies(docs)


@shielded
def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Byte strings of 200 or more that repeat are cut from the texts, everywhere they stand. All rows stay; null stays null."""
    return suffix.cut_documents(docs)


@shielded
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the target weights ask for, once per epoch, to the token that each leaf's budget ends in. Texts
    without words cost no budget; null lang and source are the leaf "unknown"."""
    return mixing.taken(docs, mixing.QUERY)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in windows of 2048 tokens, with their ids, so the sequences can be put together from these rows
    (packing.sequences does). A null or empty text is its end token; a document taken twice is packed twice."""
    return packing.pieces(docs, packing.PackingParams(public_tokenizers.path("word_bpe_49k.json")), keep_ids=True)


STAGES = [
    ("quality", keep_good),
    ("near copies", drop_near_copies),
    ("repeats", cut_repeats),
    ("mixing", mix_sources),
    ("packing", pack),
]

#: Classifiers, byte-level cuts and tokenizers are beyond SQL; tests compare each stage with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; the table between two stages stands in the shared folder until the next one does."""
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        out = stored(stage(spark, docs, sf_dir))
        discard(docs)
        docs = out
    return STAGES[-1][1](spark, docs, sf_dir)
