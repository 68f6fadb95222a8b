"""From documents to training files: language ID, near-dedup, decontamination, mixing, token output.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but the last return the
columns of documents, whatever others there are beside doc_id, text and lang.

Defined cases: a null text, or one without letters, is of no known language and goes in the first stage; a null doc_id
stays a row, after all others where one of near copies is chosen and before all others in the token files; a null lang
never trains; of repeated rows and near copies one stays, that with the smallest id; very long texts are read whole in
every stage; an empty table of documents gives no rows, an empty benchmark takes none, and without labels all rates are
one.  Each stage's rows are written before the next one starts.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from burnish.llm import decontaminate, language_id, mixing, near_copies, token_output
from burnish.llm.common import table, work_dir, written
from burnish.llm.queries import id_remainder, public_path


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told with a posterior of one half at least; und goes."""
    model = language_id.fit(docs, id_remainder(3) != 1, public_path("piece_bpe_32k.model"))
    return language_id.accepted(docs, model)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: that with the smallest id.

    Operator 10's signatures over fingerprints of five-word shingles, MinHash bands for pairs beyond their reach, and
    every link verified at a Jaccard similarity of 0.8.
    """
    return near_copies.representatives(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no window of words with a benchmark item."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def to_target_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the fitted rates say."""
    return mixing.mixed(docs, table(spark, sf_dir, "labels"))


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token shards of what is left, and each document's place in them as read back."""
    shards = token_output.write_shards(docs, public_path("word_bpe_49k.json"))
    return token_output.read_documents(shards, id_type=docs.schema["doc_id"].dataType.simpleString())


STAGES = [
    ("language ID", known_language),
    ("near-dedup", one_of_each),
    ("decontamination", without_benchmark),
    ("mixing", to_target_weights),
    ("token output", token_files),
]

#: Classifiers, fingerprints and tokenizers are beyond SQL; tests hold run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    where = f"{work_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for i, (_, stage) in enumerate(STAGES):
        docs = written(stage(spark, docs, sf_dir), f"{where}/{i}")
    return docs
