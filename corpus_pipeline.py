"""Corpus pipeline: rate, remove repeated lines, keep one of each group of near copies, pack into sequences.

Each stage reads what the one before has kept. The first three return documents with the columns of the input; the
last returns the packed pieces.
"""

from __future__ import annotations

import functools
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphloom.llm.common import Scratch, forget, kept, modest_batches, scratch_dir, table
from glyphloom.llm.op1_ordinal import keep_rated
from glyphloom.llm.op2_bin_completion import pack
from glyphloom.llm.op7_heavy_light import linked
from glyphloom.llm.op10_line_join import dedup_lines

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _stage(work: Stage) -> Stage:
    """A stage that deletes the scratch tables of the stage before, whose result has been written by then."""

    @functools.wraps(work)
    def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        forget(set(_left))
        modest_batches(spark)
        before = kept()
        out = work(spark, docs, sf_dir)
        _left[:] = kept() - before
        return out

    return stage


_left: list[str] = []


@_stage
def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject, as they are.

    A null text counts as empty and is rated as one without words. A document that has a null id, or an id that comes
    again, is rated by its text too. An empty table gives no rows; without labels every document stays.
    """
    return keep_rated(docs, table(spark, sf_dir, "labels"))


@_stage
def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that repeat an earlier one; ``n_chars`` follows the text, and a text left empty goes.

    Null and empty texts stay. Of equal lines the first by document id and line number stays, null ids first; rows with equal id and text
    are one document and all stay. An empty table gives no rows.
    """
    lean = dedup_lines(docs.select(F.struct("*").alias("was"), "doc_id", "text"), counts=False)
    columns = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        changed = ~F.col("text").eqNullSafe(F.col("was.text"))
        columns["n_chars"] = F.when(changed, F.length("text")).otherwise(F.col("was.n_chars")).cast(docs.schema["n_chars"].dataType)
    left = lean.where("text is null or text <> '' or was.text = ''")
    return left.select(*(columns.get(c, F.col("was").getField(c)).alias(c) for c in docs.columns))


@_stage
def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each component of near copies.

    Documents with null ids, and null or empty texts, stay. Rows that share an id stay or go together. An empty table
    gives no rows.
    """
    with Scratch(spark) as own:
        links = linked(docs).where("doc_id <> component_id").select(F.struct(F.col("doc_id").alias("copy")).alias("gone")).distinct()
        links = own.keep(own.table(links, "copies"))
    return docs.select(F.struct("*").alias("was")).join(links, F.col("was.doc_id").cast("long") == F.col("gone.copy"), "left_anti").select("was.*")


@_stage
def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of what is left, in as few sequences as the search finds; every row is packed, as ``pack`` says."""
    return pack(docs)


STAGES = [
    ("quality classifier", keep_good),
    ("line dedup", drop_lines),
    ("n-gram Jaccard join", one_of_each),
    ("best-fit packing", packed),
]

#: The classifier is fitted and the packing is a search; neither is expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each stage's rows written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = f"{scratch_dir(spark)}/stage-{name.replace(' ', '-')}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
