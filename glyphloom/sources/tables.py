"""Readers for Parquet tables, corpus text files, manifests and Python sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MANIFEST_SCHEMA = T.StructType(
    [
        T.StructField("generated_at", T.StringType()),
        T.StructField(
            "results",
            T.MapType(
                T.StringType(),
                T.StructType([T.StructField("ipa_characters", T.LongType()), T.StructField("lines_written", T.LongType()), T.StructField("output_file", T.StringType())]),
            ),
        ),
    ]
)


def parquet_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def newlines(text: str | Column) -> Column:
    """Line ends as text mode reads them: carriage returns become line feeds."""
    return F.regexp_replace(text, "\r\n?", "\n")


def corpus_files(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """Whole text files by language, as documents: doc_id, lang, text."""
    frames = [
        spark.read.text(path, wholetext=True).select(F.lit(i).cast("long").alias("doc_id"), F.lit(lang).alias("lang"), newlines("value").alias("text"))
        for i, (lang, path) in enumerate(paths.items())
    ]
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents table as a corpus: a language's text is its documents in id order, nothing between them."""
    return parquet_table(spark, sf_dir, "documents").where("doc_id is not null and text is not null and lang is not null").select("doc_id", "lang", newlines("text").alias("text"))


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """One row per language of a corpus manifest: lang, ipa_characters, lines_written, output_file."""
    rows = spark.read.json(path, schema=MANIFEST_SCHEMA, multiLine=True)
    return rows.select(F.explode("results").alias("lang", "r")).select("lang", "r.*")


def python_sources(spark: SparkSession, root: str) -> DataFrame:
    """Python files below src, tests and scripts of a folder: path, source (a byte order mark is taken off)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.py")
    read = files.load(root).select(F.regexp_replace("path", "^file:(//)?", "").alias("path"), F.decode("content", "UTF-8").alias("source"))
    base = root.rstrip("/")
    kept = read.where(F.substring("path", len(base) + 2, 1_000_000).rlike("^(src|tests|scripts)/"))
    return kept.select("path", F.regexp_replace("source", "^﻿", "").alias("source"))
