"""Run names, checkpoint paths and versions, as expressions over a table of experiments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Languages with names, and the limits of fine-tuning.
LANGUAGES = {"tr": "Turkish", "az": "Azerbaijani", "kk": "Kazakh", "ky": "Kyrgyz", "uz": "Uzbek", "ug": "Uyghur", "fi": "Finnish"}
FINE_TUNE_LR = 5e-5
DEFAULT_LR = 1e-4
EXPERIMENTS = [
    ("tr", None, False), ("fi", "checkpoints/tr_best.pt", True), ("kk", "checkpoints/tr_best.pt", True), ("az", "checkpoints/tr_best.pt", True),
    ("uz", None, False), ("fi", "checkpoints/uz_best.pt", True), ("kk", "checkpoints/uz_best.pt", True), ("ug", "checkpoints/uz_best.pt", True),
    ("kk", None, False), ("fi", "checkpoints/kk_best.pt", True), ("ky", "checkpoints/kk_best.pt", True), ("tr", "checkpoints/kk_best.pt", True),
]


def experiments(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, *row) for i, row in enumerate(EXPERIMENTS)], "run_no int, lang string, from_checkpoint string, freeze_embed boolean")


def stem(path: Column) -> Column:
    """A file's name without its last suffix."""
    return F.regexp_replace(F.regexp_extract(path, "([^/]+)$", 1), r"(.)\.[^.]*$", "$1")


def suffix(path: Column) -> Column:
    return F.regexp_extract(F.regexp_extract(path, "([^/]+)$", 1), r".(\.[^.]*)$", 1)


def folder(path: Column) -> Column:
    """What comes before a file's name, with the last slash."""
    return F.regexp_extract(path, "^(.*/)?[^/]+$", 1)


def run_registry(runs: DataFrame) -> DataFrame:
    """Names and paths of each run: from scratch ``lang-train``, fine-tuned ``base->lang`` with a capped learning rate."""
    spark = runs.sparkSession
    names = spark.createDataFrame(list(LANGUAGES.items()), "lang string, lang_name string")
    tuned = F.col("from_checkpoint").isNotNull()
    base = F.replace(stem(F.col("from_checkpoint")), F.lit("_best"), F.lit(""))
    return runs.join(F.broadcast(names), "lang").select(
        "run_no", "lang", "lang_name", F.coalesce("from_checkpoint", F.lit("")).alias("from_checkpoint"), "freeze_embed",
        F.when(tuned, F.concat(base, F.lit("->"), "lang")).otherwise(F.concat("lang", F.lit("-train"))).alias("run_name"),
        F.when(tuned, F.concat(F.lit("checkpoints/"), base, F.lit("_to_"), "lang", F.lit(".pt"))).otherwise(F.concat(F.lit("checkpoints/"), "lang", F.lit("_best.pt"))).alias("checkpoint_path"),
        F.lit("checkpoints/vocab.json").alias("vocab_path"),
        F.lit(DEFAULT_LR).alias("requested_lr"),
        F.when(tuned, F.least(F.lit(DEFAULT_LR), F.lit(FINE_TUNE_LR))).otherwise(F.lit(DEFAULT_LR)).alias("effective_lr"),
    )


def _versions(existing: DataFrame) -> DataFrame:
    """base and i of every path there is: it is version 0 of itself and, by its name, maybe version i of another."""
    name, end, number = stem(F.col("path")), suffix(F.col("path")), r"\.ft([1-9][0-9]*)$"
    # The version of a name without a suffix has its number where others have their suffix.
    bare = end.rlike("^" + number)
    i = F.when(bare, F.regexp_extract(end, number, 1)).otherwise(F.regexp_extract(name, number, 1)).try_cast("bigint")
    base = F.concat(folder(F.col("path")), F.when(bare, name).otherwise(F.concat(F.regexp_replace(name, number, ""), end)))
    own = existing.select(F.col("path").alias("base"), F.lit(0).cast("bigint").alias("i"))
    return own.unionByName(existing.select(base.alias("base"), i.alias("i")).where("i is not null")).distinct()


def next_version(wanted: DataFrame, existing: DataFrame) -> DataFrame:
    """The first free path for each ``base``: itself, else ``stem.ft1.suffix``, ``stem.ft2.suffix`` and so on, gaps first."""
    wanted = wanted.select("base").distinct()
    held = _versions(existing).join(wanted, "base", "left_semi")
    # Versions count up without a gap as long as each is its own rank.
    ranked = held.withColumn("rank", F.row_number().over(Window.partitionBy("base").orderBy("i")) - 1)
    taken = ranked.where("i = rank").groupBy("base").agg(F.count(F.lit(1)).alias("i"))
    path = F.col("base")
    version = F.concat(folder(path), stem(path), F.lit(".ft"), F.col("i").cast("string"), suffix(path))
    return wanted.join(taken, "base", "left").select("base", F.when(F.col("i") > 0, version).otherwise(path).alias("path"))
