"""A corpus pipeline of training-data operators.

``STAGES`` are (name, function); a function takes the session, the documents that its predecessor has kept, and
the folder of the tables. What a stage returns is written and read again before the next one. All stages but
the last return the columns of ``documents``; rows may have nulls in any column, see the operators.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fityard.llm import byte_bpe, line_dedup, minhash_join, mixing, toxicity
from fityard.llm.queries import VOCABULARY, table
from fityard.runtime import written

# Mixture of the last but one stage. With a fifth more tokens than there are, documents of the domain that is
# to grow get rates of at least 1, so that none of them is lost.
MIXTURE = {"good": 0.9, "poor": 0.1}
BUDGET = 1.2


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below 0.5, with all columns.

    Null and empty texts get the score of a text without known words; equal texts get equal scores, so copies stay or go
    together; repeated rows stay repeated. Without labels of both kinds nothing reaches 0.5 unless most labels are 1.
    An empty table stays empty. Columns travel as one, so their names don't matter.
    """
    return toxicity.clean_documents(docs, table(spark, sf_dir, "labels"))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that match an earlier one; ``n_chars`` follows the text.

    Null texts stay null (and ``n_chars`` becomes null), empty ones empty; a document that loses all its lines stays with an
    empty text. Rows with a null id are kept as they are. Rows that repeat an id lose the same line numbers.
    Of equal lines the first one by (id, line number) stays. An empty table stays empty.
    """
    cut = line_dedup.deduplicated_documents(docs)
    return cut.withColumn("n_chars", F.length("text").cast("bigint")).select(docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group of near copies; all with a null id.

    Null and empty texts are near copies of nothing and stay. Rows that repeat an id are one document and stay or go
    together. Other columns, nulls in them too, are carried along. An empty table stays empty.
    """
    gone = minhash_join.near_duplicates(docs).filter(~F.col("kept")).select("doc_id")
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)


def mix_domains(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture wants them; some not at all, some repeated.

    A rate is rounded by a hash of id and tokens, so rows that repeat an id get equal copies each. Null and empty texts have no
    tokens and follow the rate of their posteriors. Without labels all rates are equal. An empty table stays empty.
    """
    return mixing.mixed_documents(docs, table(spark, sf_dir, "labels"), targets=MIXTURE, budget=BUDGET)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``(doc_id, n_tokens, ids, decoded)`` of every row, null ids and repeated rows too; null texts count as empty."""
    coded = byte_bpe.encode_documents(docs, VOCABULARY)
    return coded.select("doc_id", (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"), "ids", "decoded")


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_repeated_lines),
    ("minhash near-dedup", drop_near_copies),
    ("mixing sources to target weights", mix_domains),
    ("bpe encoding and decoding", encode),
]

# Fits, similarity joins and BPE aren't expressible in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
