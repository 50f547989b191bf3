"""Where a run's figures go: an append-only table of metrics, a table of settings, and lines on the console."""

from __future__ import annotations

import sys
from typing import TextIO

from pyspark.sql import SparkSession

METRICS = (
    "run string, kind string, epoch int, global_step bigint, loss double, ppl double, grad_norm double, learning_rate double, "
    "best_val_loss double, epochs_no_improve int"
)
#: What each line says, and with how many digits.
LINES = {
    "header": "{bar}\n{text}\n{bar}",
    "part": "\n{text}",
    "setting": "  {name}: {value}",
    "info": "{text}",
    "progress": "  [{percent:5.1f}%] Step {step:,} | Loss: {loss:.4f} | PPL: {ppl:.2f}",
    "epoch": "[Epoch {epoch}/{epochs}] Starting...",
    "validating": "[Epoch {epoch}/{epochs}] Validating...",
    "validated": "[Epoch {epoch}/{epochs}] Loss: {loss:.4f} | PPL: {ppl:.2f}",
    "saved": "  -> Saved best model to {path}",
    "idle": "  -> No improvement ({idle}/{patience})",
    "stopped": "Early stopping.",
    "tested": "\nFinal Test Loss: {loss:.4f} | Test PPL: {ppl:.2f}",
    "done": "Done!",
}
BAR = "=" * 60


class Console:
    """Prints the lines of ``LINES``; silent without a stream."""

    def __init__(self, out: TextIO | None = sys.stdout):
        self.out = out

    def say(self, line: str, **values: object) -> None:
        if self.out is not None:
            print(LINES[line].format(bar=BAR, **values), file=self.out)


class Tables:
    """Appends a run's metrics and settings below a folder that Spark can write; without a folder nothing is kept."""

    def __init__(self, spark: SparkSession, folder: str | None):
        self.spark, self.folder = spark, folder

    def metrics(self, rows: list[dict[str, object]]) -> None:
        """One append for many rows; a figure that a row lacks is null."""
        if self.folder and rows:
            names = [part.split()[0] for part in METRICS.split(", ")]
            self.spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], METRICS).write.mode("append").parquet(f"{self.folder}/metrics")

    def settings(self, run: str, held: dict[str, object]) -> None:
        """The settings of a run as text, one row each."""
        if self.folder:
            rows = [(run, name, None if value is None else str(value)) for name, value in held.items()]
            self.spark.createDataFrame(rows, "run string, name string, value string").write.mode("append").parquet(f"{self.folder}/settings")
