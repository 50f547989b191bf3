"""Training metrics as a stream: the fold over validation losses with state per run.

The batch fold needs a run's whole history; this one keeps best loss, idle epochs and a stop flag per run, and emits a row for
each epoch as it comes. Epochs of one run must arrive in order; those after a stop are dropped, as a stopped loop has none.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUT = "run string, epoch int, val_loss double, best_val_loss double, epochs_no_improve int, stopped boolean"
STATE = "best double, idle int, stopped boolean"


def early_stopping_stream(epochs: DataFrame, patience: int = 1) -> DataFrame:
    """``epochs`` (run, epoch, val_loss) with the fold's values after each epoch; batch or streaming input."""

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        best, idle, stopped = state.get if state.exists else (float("inf"), 0, False)
        rows = []
        for row in pd.concat(list(parts)).sort_values("epoch").itertuples(index=False):
            if stopped:
                break
            if row.val_loss < best:
                best, idle = row.val_loss, 0
            else:
                idle += 1
            stopped = idle >= patience
            rows.append((key[0], row.epoch, row.val_loss, best, idle, stopped))
        state.update((best, idle, stopped))
        yield pd.DataFrame(rows, columns=["run", "epoch", "val_loss", "best_val_loss", "epochs_no_improve", "stopped"])

    return epochs.groupBy("run").applyInPandasWithState(step, OUT, STATE, "append", GroupStateTimeout.NoTimeout)
