"""From raw documents to encoded training data: clean, deduplicate, mix, encode.

``STAGES`` are applied in order; each is written as Parquet in the shared folder and
read again, so a lost executor costs a re-read and no stage runs twice.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.line_dedup import line_dedup
from tidemark.llm.mixing import mix_rows
from tidemark.llm.pieces import encode_documents
from tidemark.llm.quality import clean_by_lines
from tidemark.llm.queries import PIECE_MODEL
from tidemark.llm.shared import shared_table
from tidemark.llm.similarity import one_of_similar

#: Words from which a passage is long however few lines it has; op8's window.
LONG_WORDS = 13


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Failing lines go; documents that lose too much, or fail the base rules, go whole.

    Null, empty and blank texts fail the base. Rows that repeat are judged alike.
    """
    return clean_by_lines(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later repeats of runs of three lines, or of fewer with 13 words or more, go.

    A document of nothing else goes with them, as do null and blank texts; rows that
    repeat id and text lose the same lines and not each other's.
    """
    return line_dedup(docs, long_words=LONG_WORDS).where(F.col("text").rlike(r"[^\x20\x09-\x0D]"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents whose five-word shingles are alike to 0.8 the smallest id stays.

    Null ids are larger than any other; rows that repeat id and text stay once.
    """
    return one_of_similar(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources in their target proportions; what is taken more than once is repeated.

    A null source is one of its own. Better documents (``quality_weights``) are drawn first.
    """
    return mix_rows(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids (little-endian unsigned 32-bit, begin and end included) of each document.

    A null text has begin and end alone; rows may repeat.
    """
    narrow = docs.select("doc_id", "source", "text")
    coded = encode_documents(narrow, public_tokenizers.path(PIECE_MODEL))
    n_tokens = (F.octet_length("ids") / 4).cast("long")
    return coded.select("doc_id", "source", n_tokens.alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality rules", quality),
    ("line dedup", lines),
    ("near-duplicates", near_duplicates),
    ("mix", mix),
    ("encode", encode),
]

#: Merging by vocabulary cannot be expressed in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = shared_table(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
