"""Training histories: flush windows, epoch summaries, early stopping, convergence, and gradient norms.

A history is a table of steps (run, step from 1, loss, grad_norm). Flush windows are plain groups, as a window ends at
every ``log_every``-th step and at the last step of an epoch; only the few rows of epochs need ordered windows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glyphloom.operators.ordering import running_total

EPOCH_STEPS = 250
LOG_EVERY = 100
PATIENCE = 1
LEARNING_RATE = 1e-4


def steps_of_events(events: DataFrame) -> DataFrame:
    """A deterministic stand-in for a training history: one run per event type, one step per event in id order."""
    rows = events.where("event_id is not null and event_type is not null and value is not null")
    ranked = running_total(rows, ["event_type"], "event_id", F.lit(1), "before", "total")
    return ranked.select(
        F.col("event_type").alias("run"), (F.col("before") + 1).alias("step"), "total", (F.col("value") / 100.0).alias("loss"),
        F.sqrt("value").alias("grad_norm"),
    ).withColumn("epoch", (F.floor((F.col("step") - 1) / EPOCH_STEPS) + 1).cast("int"))


def train_loss_windows(steps: DataFrame, log_every: int = LOG_EVERY) -> DataFrame:
    """Mean loss since the last flush; the gradient norm is the flushing step's."""
    group = F.floor((F.col("step") - 1) / log_every)
    out = steps.groupBy("run", "epoch", group.alias("g")).agg(
        F.max("step").alias("global_step"), F.count(F.lit(1)).alias("n_steps"), F.avg("loss").alias("m"), F.max_by("grad_norm", "step").alias("grad")
    )
    return out.select(
        "run", "epoch", "global_step", "n_steps", F.round("m", 6).alias("train_loss"), F.round(F.exp("m"), 6).alias("train_ppl"), F.round("grad", 6).alias("grad_norm")
    )


def epoch_losses(steps: DataFrame) -> DataFrame:
    """Train and validation loss of each epoch; every fifth step stands in for a validation batch."""
    out = steps.groupBy("run", "epoch").agg(
        (F.sum("loss") / F.greatest(F.lit(1), F.count(F.lit(1)))).alias("train_loss"),
        F.avg(F.when(F.col("step") % 5 == 0, F.col("loss"))).alias("val_loss"),
        F.max("step").alias("global_step"),
    )
    return out.withColumn("val_loss", F.coalesce("val_loss", F.lit(0.0)))


def folded(epochs: DataFrame, patience: int = PATIENCE) -> DataFrame:
    """Adds the fold over epochs: best_val_loss, epochs_no_improve, the counter before the update, and whether training still ran.

    An improvement is strictly below everything before, the first bound being infinite; NaN never improves.
    """
    order = Window.partitionBy("run").orderBy("epoch")
    before, upto = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(Window.unboundedPreceding, 0)
    usable = F.when(~F.isnan("val_loss"), F.col("val_loss"))
    best = F.coalesce(F.min(usable).over(before), F.lit(float("inf")))
    marked = epochs.withColumn("improved", (F.col("val_loss") < best) & ~F.isnan("val_loss"))
    marked = marked.withColumn("best_val_loss", F.coalesce(F.min(usable).over(upto), F.lit(float("inf"))))
    last = F.coalesce(F.max(F.when(F.col("improved"), F.col("epoch"))).over(upto), F.lit(0))
    marked = marked.withColumn("epochs_no_improve", (F.col("epoch") - last).cast("int"))
    marked = marked.withColumn("no_improve_before", F.lag("epochs_no_improve", 1, 0).over(order))
    stopped = F.max((F.col("epochs_no_improve") >= patience).cast("int")).over(before)
    return marked.withColumn("ran", F.coalesce(stopped, F.lit(0)) == 0).withColumn("stops", F.col("ran") & (F.col("epochs_no_improve") >= patience))


def epoch_summary(steps: DataFrame, patience: int = 10**6) -> DataFrame:
    """Eight columns per epoch and run; without early stopping unless ``patience`` says so."""
    rows = folded(epoch_losses(steps), patience).where("ran")
    rounded = (F.round(F.col(c), 6).alias(c) for c in ("train_loss", "val_loss", "best_val_loss"))
    return rows.select(
        "run", "epoch", *rounded, F.round(F.exp("train_loss"), 6).alias("train_ppl"), F.round(F.exp("val_loss"), 6).alias("val_ppl"),
        F.lit(LEARNING_RATE).alias("learning_rate"), "epochs_no_improve",
    )


def early_stopping(steps: DataFrame, patiences: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """For each patience and run: the last epoch that runs, whether it was stopped, and the best epoch."""
    epochs = epoch_losses(steps)
    parts = [
        folded(epochs, p).where("ran").groupBy("run").agg(
            F.max("epoch").alias("last_epoch"), F.max("stops").alias("stopped"), F.min_by("epoch", F.struct("val_loss", "epoch")).alias("best_epoch"),
            F.round(F.min("val_loss"), 6).alias("best_val_loss"),
        ).withColumn("patience", F.lit(p))
        for p in patiences
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def metric_log(steps: DataFrame) -> DataFrame:
    """Train, validation and test events as one append-only table; columns that an event lacks are null.

    A validation event has the counter from before its epoch's update and the best loss from after it.
    """
    void = F.lit(None)
    train = train_loss_windows(steps).select(
        "run", F.lit("train").alias("kind"), "epoch", "global_step", F.col("train_loss").alias("loss"), F.col("train_ppl").alias("ppl"), "grad_norm",
        F.lit(LEARNING_RATE).alias("learning_rate"), void.cast("double").alias("best_val_loss"), void.cast("int").alias("epochs_no_improve"),
    )
    rows = folded(epoch_losses(steps))
    val = rows.select(
        "run", F.lit("val").alias("kind"), "epoch", "global_step", F.round("val_loss", 6).alias("loss"), F.round(F.exp("val_loss"), 6).alias("ppl"),
        void.cast("double").alias("grad_norm"), void.cast("double").alias("learning_rate"), F.round("best_val_loss", 6).alias("best_val_loss"),
        F.col("no_improve_before").cast("int").alias("epochs_no_improve"),
    )
    test = rows.groupBy("run").agg(F.min("val_loss").alias("t")).select(
        "run", F.lit("test").alias("kind"), void.cast("int").alias("epoch"), void.cast("long").alias("global_step"), F.round("t", 6).alias("loss"),
        F.round(F.exp("t"), 6).alias("ppl"), *(void.cast("double").alias(c) for c in ("grad_norm", "learning_rate", "best_val_loss")),
        void.cast("int").alias("epochs_no_improve"),
    )
    # Counters that may be null are doubles, so that every reader shows the same values.
    counters = {c: F.col(c).cast("double") for c in ("epoch", "global_step", "epochs_no_improve")}
    return train.unionByName(val).unionByName(test).withColumns(counters)


def convergence_auc(steps: DataFrame) -> DataFrame:
    """Area under the validation loss over epochs, by trapezoids."""
    order = Window.partitionBy("run").orderBy("epoch")
    area = (F.col("val_loss") + F.lead("val_loss").over(order)) / 2
    return epoch_losses(steps).withColumn("area", area).groupBy("run").agg(
        F.count(F.lit(1)).alias("n_epochs"), F.round(F.coalesce(F.sum("area"), F.lit(0.0)), 6).alias("auc")
    )


def grad_norm(gradients: DataFrame, group: str, values: str, most: float = 1.0) -> DataFrame:
    """L2 norm of each parameter group and of all, before clipping, and the factor that clips the total to ``most``.

    A null gradient doesn't count, as a frozen parameter's doesn't.
    """
    squares = F.aggregate(F.col(values), F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    groups = gradients.groupBy(F.col(group).alias("param")).agg(F.sum(squares).alias("s"))
    total = groups.agg(F.sum("s").alias("t")).withColumn("one", F.lit(1))
    norm = F.sqrt("t")
    return groups.withColumn("one", F.lit(1)).join(F.broadcast(total), "one").select(
        "param", F.round(F.sqrt("s"), 6).alias("param_norm"), F.round(norm, 6).alias("total_norm"),
        F.round(F.least(F.lit(1.0), F.lit(most) / (norm + 1e-6)), 9).alias("clip_factor"),
    )
