"""Training and evaluating the character LSTM over tables of windows, and weights as tables.

Each optimisation step is one Spark job: tasks compute losses and gradients of their share of the batch, which are
averaged by token count, so a step equals that of one machine. The driver holds weights and optimiser.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphloom.functions import lstm
from glyphloom.operators.corpus import MAX_CHARS, SPLITS, UNK, encode, positioned, split_parts, windows
from glyphloom.operators.ordering import running_total

PARAMS = "name string, shape array<int>, values array<float>"
FROZEN = "embedding.weight"
HISTORY = "lang string, vocab_size int, n_params long, test_loss double, test_ppl double, epoch int, train_loss double, val_loss double, best_val_loss double"


class Config(NamedTuple):
    """Sizes and limits of a run; the defaults are small enough for a test machine."""

    seq_len: int = 16
    batch: int = 64
    embed: int = 16
    hidden: int = 32
    layers: int = 1
    lr: float = 1e-2
    epochs: int = 2
    patience: int = 1
    steps_per_epoch: int | None = None
    seed: int = 0


def params_table(spark: SparkSession, params: lstm.Params) -> DataFrame:
    return spark.createDataFrame([(n, list(p.shape), p.reshape(-1).astype(float).tolist()) for n, p in sorted(params.items())], PARAMS)


def save_checkpoint(spark: SparkSession, params: lstm.Params, path: str) -> None:
    """Weights only, replacing what is there."""
    params_table(spark, params).write.mode("overwrite").parquet(path)


def load_checkpoint(spark: SparkSession, path: str, like: lstm.Params | None = None) -> lstm.Params:
    """Weights of a checkpoint; if ``like`` is given, names and shapes must be the same."""
    try:
        rows = spark.read.schema(PARAMS).parquet(path).collect()
    except Exception as problem:
        raise FileNotFoundError(f"Checkpoint not found at {path}") from problem
    params = {r["name"]: np.array(r["values"], dtype=np.float64).reshape(r["shape"]) for r in rows}
    if like is not None:
        odd = {n for n in params.keys() | like.keys() if n not in params or n not in like or params[n].shape != like[n].shape}
        if odd:
            raise ValueError(f"checkpoint doesn't fit: {sorted(odd)}")
    return params


def _batch_jobs(samples: DataFrame, params: lstm.Params, gradients: bool) -> DataFrame:
    """Of each part of each batch: token count, summed loss, and pickled gradients weighted by tokens."""
    weights = pickle.dumps(params)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pickle.loads(weights)
        for rows in batches:
            number = rows.column("batch_id").to_numpy()
            x, y = (np.array(rows.column(c).to_pylist(), dtype=np.int64) for c in ("x", "y"))
            for one in np.unique(number):
                xs, ys = x[number == one], y[number == one]
                if gradients:
                    loss, grads = lstm.loss_and_gradients(own, xs, ys)
                    packed = pickle.dumps({n: g * ys.size for n, g in grads.items()})
                else:
                    loss, packed = lstm.cross_entropy(lstm.forward(own, xs)[0], ys)[0], b""
                yield pa.RecordBatch.from_arrays([pa.array([one]), pa.array([ys.size]), pa.array([loss * ys.size]), pa.array([packed])], ["batch_id", "tokens", "loss", "grads"])

    return samples.select("batch_id", "x", "y").mapInArrow(run, "batch_id bigint, tokens bigint, loss double, grads binary")


def evaluate(samples: DataFrame, params: lstm.Params) -> tuple[float, float]:
    """Unweighted mean of batch means and its exponential; (0, 1) without samples."""
    parts = _batch_jobs(samples, params, gradients=False).groupBy("batch_id").agg((F.sum("loss") / F.sum("tokens")).alias("m"))
    mean = parts.agg(F.avg("m")).first()[0]
    return (0.0, 1.0) if mean is None else (mean, float(np.exp(mean)))


def step_gradients(batch: DataFrame, params: lstm.Params) -> tuple[float, lstm.Params]:
    """Loss and gradients of one batch, from any number of tasks. One small row per task comes to the driver."""
    rows = _batch_jobs(batch, params, gradients=True).collect()
    tokens = sum(r["tokens"] for r in rows)
    total: lstm.Params = {}
    for r in rows:
        for n, g in pickle.loads(r["grads"]).items():
            total[n] = total.get(n, 0.0) + g
    return sum(r["loss"] for r in rows) / tokens, {n: g / tokens for n, g in total.items()}


def batched(samples: DataFrame, batch: int, shuffle_seed: int | None = None) -> DataFrame:
    """Adds batch_id. Samples keep their order, or are shuffled by a seeded hash; a short last batch is kept."""
    if shuffle_seed is None:
        return samples.withColumn("batch_id", F.floor(F.col("i") / batch).cast("long"))
    drawn = F.pmod(F.xxhash64("i", F.lit(shuffle_seed)), F.lit(1 << 22)) * (1 << 40) + F.col("i")
    placed = running_total(samples.withColumn("_drawn", drawn).withColumn("_all", F.lit(0)), ["_all"], "_drawn", F.lit(1), "_place", "_n", 1 << 50)
    return placed.withColumn("batch_id", F.floor(F.col("_place") / batch).cast("long")).drop("_drawn", "_all", "_place", "_n")


def train(train_set: DataFrame, val_set: DataFrame, vocab_size: int, config: Config, start: lstm.Params | None = None, freeze: bool = False) -> tuple[lstm.Params, list[dict]]:
    """Best weights and a row per epoch. Stops after ``patience`` epochs without a strictly lower validation loss."""
    params = start or lstm.init_params(vocab_size, config.embed, config.hidden, config.layers, config.seed)
    optimiser, best, best_loss, idle, history, steps = lstm.Adam(config.lr), params, float("inf"), 0, [], 0
    held = train_set.persist()
    val = batched(val_set, config.batch).persist()
    for epoch in range(1, config.epochs + 1):
        rows = batched(held, config.batch, config.seed + epoch).persist()
        last = rows.agg(F.max("batch_id")).first()[0]
        count = 0 if last is None else last + 1
        losses = []
        for k in range(min(count, config.steps_per_epoch or count)):
            loss, grads = step_gradients(rows.where(F.col("batch_id") == k), params)
            if freeze:
                grads.pop(FROZEN)
            params = optimiser.step(params, lstm.clipped(grads))
            losses.append(loss)
            steps += 1
        rows.unpersist()
        val_loss, val_ppl = evaluate(val, params)
        if val_loss < best_loss:
            best, best_loss, idle = params, val_loss, 0
        else:
            idle += 1
        train_loss = sum(losses) / max(1, len(losses))
        history.append(
            {
                "epoch": epoch, "train_loss": train_loss, "train_ppl": float(np.exp(train_loss)), "val_loss": val_loss, "val_ppl": val_ppl,
                "best_val_loss": best_loss, "learning_rate": config.lr, "epochs_no_improve": idle,
            }
        )
        if idle >= config.patience:
            break
    held.unpersist()
    val.unpersist()
    return best, history


def language_samples(docs: DataFrame, lang: str, config: Config, max_chars: int) -> tuple[DataFrame, int]:
    """Windows of one language's corpus with split, and the vocabulary size."""
    from glyphloom.operators.corpus import vocabulary

    own = docs.where(F.col("lang") == lang)
    size = vocabulary(own, max_chars).count()
    return windows(own, config.seq_len, config.batch, max_chars).select("split", "i", "x", "y"), max(size, 1)


def samples_of(ids: np.ndarray, length: int) -> np.ndarray:
    """All runs of ``length`` ids and the one after them, stride 1."""
    return np.lib.stride_tricks.sliding_window_view(ids, length + 1) if len(ids) > length else np.zeros((0, length + 1), np.int64)


def mean_loss(params: lstm.Params, samples: np.ndarray, batch: int) -> tuple[float, float]:
    """Unweighted mean of batch means without dropout, and its exponential; (0, 1) without samples."""
    parts = [samples[at : at + batch] for at in range(0, len(samples), batch)]
    means = [lstm.cross_entropy(lstm.forward(params, rows[:, :-1])[0], rows[:, 1:])[0] for rows in parts]
    return (float(np.mean(means)), float(np.exp(np.mean(means)))) if means else (0.0, 1.0)


def train_texts(texts: dict[str, str], config: Config) -> tuple[int, lstm.Params, tuple[float, float], list[dict]]:
    """Train on the splits' texts in this process: vocabulary size, best weights, test loss and perplexity, and a row per epoch.

    The same as ``train``, with samples shuffled by a seeded permutation: one step after another needs the weights of
    the one before, so that a Spark job for each of a whole epoch's steps would only add its start.
    """
    alphabet = "".join(sorted(set("".join(texts.values()))))
    size = len(alphabet) + 1
    seen = {s: samples_of(encode(texts.get(s, ""), alphabet), config.seq_len) for s in SPLITS}
    params = lstm.init_params(size, config.embed, config.hidden, config.layers, config.seed)
    optimiser, best, best_loss, idle, history = lstm.Adam(config.lr), params, float("inf"), 0, []
    for epoch in range(1, config.epochs + 1):
        order = np.random.default_rng(config.seed + epoch).permutation(len(seen["train"]))
        losses = []
        for at in range(0, len(order), config.batch)[: config.steps_per_epoch]:
            rows = seen["train"][order[at : at + config.batch]]
            loss, grads = lstm.loss_and_gradients(params, rows[:, :-1], rows[:, 1:])
            params = optimiser.step(params, lstm.clipped(grads))
            losses.append(loss)
        val_loss, _ = mean_loss(params, seen["val"], config.batch)
        if val_loss < best_loss:
            best, best_loss, idle = params, val_loss, 0
        else:
            idle += 1
        history.append({"epoch": epoch, "train_loss": sum(losses) / max(1, len(losses)), "val_loss": val_loss, "best_val_loss": best_loss})
        if idle >= config.patience:
            break
    return size, best, mean_loss(best, seen["test"], config.batch), history


def lstm_histories(docs: DataFrame, config: Config, max_chars: int = MAX_CHARS) -> DataFrame:
    """Train on every language's corpus and return the epoch tables. A language's text, at most ``max_chars``, is in one task; languages run side by side."""
    names = [part.split()[0] for part in HISTORY.split(", ")]

    def run(group: pd.DataFrame) -> pd.DataFrame:
        own = group.sort_values("start", kind="stable")
        size, best, (test_loss, test_ppl), history = train_texts({s: "".join(rows) for s, rows in own.groupby("split")["piece"]}, config)
        head = (group["lang"].iat[0], size, lstm.count_params(best), test_loss, test_ppl)
        return pd.DataFrame([(*head, *(h[k] for k in names[5:])) for h in history], columns=names)

    return split_parts(positioned(docs, max_chars)).select("lang", "split", "start", "piece").groupBy("lang").applyInPandas(run, HISTORY)


def lstm_history(docs: DataFrame, lang: str, config: Config, max_chars: int) -> DataFrame:
    """Train on a language's capped corpus and return the epoch table; the cap is a parameter of the run."""
    spark = docs.sparkSession
    samples, size = language_samples(docs, lang, config, max_chars)
    held = samples.persist()
    parts = {s: held.where(F.col("split") == s) for s in ("train", "val", "test")}
    best, history = train(parts["train"], parts["val"], size, config)
    test_loss, test_ppl = evaluate(batched(parts["test"], config.batch), best)
    rows = [(lang, size, lstm.count_params(best), test_loss, test_ppl, *(float(h[k]) if k != "epoch" else int(h[k]) for k in ("epoch", "train_loss", "val_loss", "best_val_loss"))) for h in history]
    return spark.createDataFrame(rows, HISTORY)


__all__ = ["UNK", "Config", "evaluate", "load_checkpoint", "lstm_histories", "lstm_history", "params_table", "save_checkpoint", "step_gradients", "train", "train_texts"]
