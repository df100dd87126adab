"""Corpus preparation: five stages over whole texts, each working on what the one before it kept.

quality classifier, near duplicates, repeated passages, personal data, packing. Every stage but the last returns
the columns of ``documents``; the last returns the packed pieces. Each result is written as Parquet and read back.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.llm.minhash import minhash_groups
from tallyspark.llm.packing import packed_batches, word_pieces
from tallyspark.llm.pii import pseudonym_key, pseudonymise
from tallyspark.llm.quality import without_junk
from tallyspark.llm.suffix import PASSAGE, Windows, without_repeats
from tallyspark.session import cut_lineage, scratch_path

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
SIMILAR = 80


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the classifier takes for junk go; each is judged by its own whole text, whatever its id.

    Texts that are null, empty or without words stay; repeated rows are judged alike; an empty table stays empty.
    """
    return without_junk(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of every group of near duplicates stays: the one with the smallest doc_id, or any if all are null.

    Groups are joined by a similarity of SIMILAR percent or more of the five-word shingles of whole texts, however long.
    Rows are compared whatever their ids, so repeated and null ids take part. Texts without words are no near
    duplicates; of those only rows that repeat both doc_id and text are one, and null ids repeat nothing. Other
    columns may have any names; an empty table stays empty.
    """
    rows, key = _numbered(docs, "near")
    ids = rows.select(F.col(key).alias("id"), "doc_id", F.sha2("text", 256).alias("sha"))
    found = minhash_groups(rows, key, percent=SIMILAR).select("id", "n_shingles", "component_id").join(ids, "id")
    alone = F.col("n_shingles") == 0
    same = [F.when(~alone | F.col("doc_id").isNull(), F.col("component_id")).alias("c"), F.when(alone, F.col("doc_id")).alias("d"), F.when(alone, F.col("sha")).alias("t")]
    first = found.groupBy(*same).agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "id")).getField("id").alias(key))
    return rows.join(first.select(key), key, "left_semi").select(_named(docs))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of PASSAGE bytes or more that also stand earlier, in another text or the same one, are removed.

    The first copy stays; a character cut in half goes with the rest. A document of which nothing is left goes; one
    that was null or empty before stays as it was. Every row is a text of its own, null and repeated ids too. Other
    columns may have any names; an empty table stays empty; very long texts are searched in overlapping pieces.
    """
    rows, key = _numbered(docs, "passages")
    rest = _free(rows, "rest")
    found = without_repeats(rows, key, characters=True, windows=Windows(length=PASSAGE, first=True)).where("n_removed > 0")
    joined = rows.join(found.select(F.col("id").alias(key), F.col("kept").cast("string").alias(rest)), key, "left")
    joined = joined.where(F.col(rest).isNull() | (F.col(rest) != ""))
    return _with_text(joined, docs.columns, F.coalesce(F.col(rest), F.col("text")))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data becomes pseudonyms under the session's key, so equal values stay linked.

    Null and empty texts, ids, repeated rows and other columns, whatever their names, stay as they are.
    """
    return _with_text(pseudonymise(docs, pseudonym_key(spark), count_col=_free(docs, "private")), docs.columns, F.col("text"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the remaining texts in length buckets and batches of a token budget.

    A null or empty text is one piece without a bucket, a very long one several pieces; null and repeated ids give
    pieces of their own; other columns are left out; an empty table gives no rows.
    """
    return packed_batches(cut_lineage(word_pieces(docs), "pieces")).withColumnRenamed("id", "doc_id")


def _free(docs: DataFrame, name: str) -> str:
    """A name that no column of ``docs`` has."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return name


def _named(docs: DataFrame) -> list[Column]:
    return [F.col(f"`{c}`") for c in docs.columns]


def _numbered(docs: DataFrame, label: str) -> tuple[DataFrame, str]:
    """``docs`` with a row key, written so that every later read finds the same keys, and the key's name."""
    key = _free(docs, "row_key")
    return cut_lineage(docs.withColumn(key, F.monotonically_increasing_id()), label), key


def _with_text(docs: DataFrame, columns: list[str], text: Column) -> DataFrame:
    """``docs`` with a new text and, if there is one, the matching n_chars."""
    new = {"text": text.alias("text"), "n_chars": F.length(text).cast("long").alias("n_chars")}
    return docs.select(*[new.get(c, F.col(f"`{c}`")) for c in columns])


STAGES: list[tuple[str, Stage]] = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("personal_data", personal_data),
    ("packing", packing),
]

# The classifier is trained and the pseudonyms are keyed: no SQL states these rows; tests hold each stage to brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch_path(spark, name)
        stage(spark, docs, sf_dir).write.mode("overwrite").parquet(path)
        docs = spark.read.parquet(path)
    return docs
