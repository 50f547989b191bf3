"""Commands: ``train`` a model on a language, ``guard`` a project folder, run a ``query`` and print its rows."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from glyphloom.operators.guard import run_guards
from glyphloom.plans import catalog, experiment
from glyphloom.sources.tables import documents


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="glyphloom", description=__doc__)
    commands = top.add_subparsers(dest="command", required=True)
    known = experiment.Request._field_defaults
    train = commands.add_parser("train", help="train or fine-tune a character model on one language")
    train.add_argument("--data", required=True, help="folder with documents.parquet")
    train.add_argument("--out", default=".", help="folder for checkpoints, vocabulary, metrics and settings")
    train.add_argument("--lang", required=True, help="a language of the documents")
    train.add_argument("--from-checkpoint", help="weights to fine-tune")
    train.add_argument("--freeze-embed", action="store_true", help="leave the embedding as it is")
    train.add_argument("--epochs", type=int, default=known["epochs"])
    train.add_argument("--lr", type=float, default=known["lr"])
    guard = commands.add_parser("guard", help="check the Python files of a folder")
    guard.add_argument("root")
    query = commands.add_parser("query", help="print the rows of a query")
    query.add_argument("name", choices=sorted(catalog.queries()))
    query.add_argument("--data", required=True)
    return top


def main(words: list[str] | None = None) -> int:
    """0 if all is well; ``guard`` has its own codes, and a language that the documents lack is an error of use (2)."""
    top = parser()
    asked = top.parse_args(words)
    spark = SparkSession.builder.appName("glyphloom").getOrCreate()
    if asked.command == "guard":
        return run_guards(spark, asked.root)
    if asked.command == "query":
        catalog.queries()[asked.name](spark, asked.data).show(truncate=False)
        return 0
    docs = documents(spark, asked.data)
    known = sorted(r[0] for r in docs.select("lang").distinct().collect())
    if asked.lang not in known:
        top.error(f"argument --lang: invalid choice: {asked.lang!r} (choose from {', '.join(known)})")
    request = experiment.Request(*(getattr(asked, name) for name in experiment.Request._fields))
    experiment.run(docs, request, asked.out)
    return 0


if __name__ == "__main__":
    sys.exit(main())
