"""From raw documents to packed token sequences, in five stages.

Each stage takes what its predecessor kept and returns the columns of documents
(the last: packed pieces). ``run`` writes every stage's rows as Parquet under the
cluster's checkpoint folder and reads them again, so a lost executor costs a
reread and stages do not replay each other.

Edge cases. Null and empty texts pass the first four stages and become one piece that
holds the end token alone; very long texts are worked on whole. Of rows that repeat,
with one id or none, near_duplicates keeps one if they have words. Rows without an id
are treated like any others. Extra columns come along to the last stage, whatever their
names. An empty table gives an empty result.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tillroll.llm import decontaminate, jaccard_join, packing, suffix_dedup, toxicity
from tillroll.llm.common import ship_package, table
from tillroll.session import ensure_checkpoint_dir


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the clause grammar scores below one half; it learns from the labelled ones among them."""
    return toxicity.keep_clean(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest doc_id of each group of near-duplicates."""
    ship_package(spark)
    return jaccard_join.keep_one_per_group(docs)


#: The repeated passages that are cut: of so many words, whose bytes are at least so many (50 words of two letters have
#: 149), or of 400 bytes with any number of words.
PASSAGE_WORDS, PASSAGE_BYTES = 50, 160


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the passages of 50 words and more, or of 400 bytes, that stand elsewhere too."""
    ship_package(spark)
    return suffix_dedup.remove_repeats(docs, PASSAGE_BYTES, PASSAGE_WORDS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth is benchmark text."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 2048 tokens."""
    ship_package(spark)
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json")).drop("sequence_length")


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("repeated_strings", cut_repeats),
    ("decontamination", drop_contaminated),
    ("packing", pack),
]

#: Learnt scores, suffix matching and a tokenizer's ids have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packed pieces of the documents that all stages keep."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
