"""The corpus pipeline: five stages over ``documents``, each written as Parquet and read again as the next one's input.

Every stage works on an empty table (and returns one), on texts of any length, and ignores columns beyond COLUMNS. Ties are
settled as the operators' docstrings say.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from canongraph.functions.shared import remove, scope
from canongraph.llm import decontam, ngramjoin, packing, suffixdedup, toxicity
from canongraph.llm.common import fresh_dir, remainder, small, stored

#: Columns of documents, as every stage but the last returns them.
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below 0.7; labels are learned from the learning folds only.

    Every row is judged by its text: repeated rows and null ids alike. Null and empty texts have no evidence and stay, unless
    nearly all labels are toxic; without labels of both kinds the score is the share of toxic ones.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").filter(remainder("doc_id", 3) != 1).select("doc_id", "toxic")
    model = toxicity.fit(docs.select("doc_id", "text"), labels)
    return toxicity.score(docs, model, keep=list(COLUMNS)).filter("score < 0.7").drop("score")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies one document, that with the smallest doc_id; null ids come last, and of rows that repeat an
    id the one whose text has the smallest hash counts. Documents without words all stay."""
    return ngramjoin.first_documents(docs.select(*COLUMNS))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the bytes of strings of 200 bytes that start more than once; letters cut in half go as well.

    All rows stay, those whose text is gone too; a null text becomes an empty one. Repeated rows lose what they share.
    """
    out = suffixdedup.deduplicate(docs, keep=list(COLUMNS), as_text=True).drop("text", "n_chars")
    return out.withColumnRenamed("kept", "text").withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item. Rows are told apart by id and text, so a clean row stays beside a contaminated
    one of the same id, and null ids are judged like any other. Null and empty texts stay; without items, all do."""
    rows = docs.select(*COLUMNS, F.xxhash64("doc_id", "text").alias("row"))
    found = decontam.contaminated(rows, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), id_col="row")
    found = stored(found.select(F.col("doc_id").alias("row")).distinct(), "contaminated")
    return rows.join(small(found), "row", "left_anti").select(*COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of what is left; an empty text is its end id alone, and
    repeated or null ids are packed row by row."""
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_copies", drop_near_copies),
    ("repeats", cut_repeats),
    ("decontamination", drop_contaminated),
    ("packing", pack_sequences),
]

#: SQL cannot express these stages (learned scores, alignments, a packing search): tests compare them with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. A stage's own tables go when its result is written, and that goes when the next one's is."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        path = fresh_dir(spark, name)
        with scope():
            out = stage(spark, docs, sf_dir)
            out.write.option("compression", "zstd").parquet(path)
        if before:
            remove(spark, before)
        docs, before = spark.read.schema(out.schema).parquet(path), path
    return docs
