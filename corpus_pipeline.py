"""The corpus pipeline: language ID, quality, near-duplicates, source mixing, packing.

Each stage takes (spark, docs, sf_dir), works on every row its predecessor kept, and returns a
DataFrame; all but the last keep the columns of ``documents``, extra ones too. An empty table gives
an empty result in every stage. Very long texts are read whole.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from roadweave.llm import langid, mixing, neardup, packing, quality
from roadweave.llm.common import stored, table

#: Below this certainty a text has no language; sure texts score near 1, a guess among two 0.5.
LEAST_CERTAIN = 0.3


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without a recognisable language (``und``, or too uncertain).

    Null texts, empty ones and those without a letter go; repeated rows are judged alike. Where no row
    has a language to learn from, none can be recognised and all go.
    """
    model = langid.train(langid.learnable(docs))
    names = docs.columns
    sure = langid.with_language(docs, model).where(f"_rw_lang.lang_pred <> 'und' and _rw_lang.score >= {LEAST_CERTAIN}")
    return sure.select(*names)


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents whose quality score is below the threshold.

    Null texts are scored like empty ones, repeated rows alike. Without labels every score is 0.5 and all stay.
    """
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    names = docs.columns
    return quality.with_quality(docs, model).where(f"_rw_quality >= {quality.THRESHOLD}").select(*names)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each near-duplicate group: the smallest doc_id, of several texts with it the least hash.

    Of rows that repeat doc_id and text one stays. Empty texts are copies of each other; rows without
    text or without id stand alone and stay.
    """
    return neardup.deduplicate(docs, repeats=False)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat or leave out documents so that sources meet their targets.

    Null and empty texts have no words: they appear as often as the whole part of their source's ratio.
    Null sources are one source, the last.
    """
    return mixing.mix(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of at most 1024 tokens; null texts are one end id, repeated rows are packed each."""
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("language_id", language), ("quality", good), ("near_dedup", distinct), ("mixing", mixed), ("packing", packed)]

#: SQL cannot express the stages; tests run them one by one and as a whole, and hold the links, targets and places of
#: the operators against brute force and the classifiers against labels.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each result but the last stored and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
