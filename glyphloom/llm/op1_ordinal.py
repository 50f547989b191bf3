"""Quality classifier: ordinal cumulative-link regression on graded ratings.

Grades come from the labels: 0 for low quality, 1 for good but toxic, 2 for good and clean. One weight vector over
hashed text features gives a score s, and ordered thresholds t1 < t2 give P(grade >= k) = sigmoid(s - t_k). A
document is kept if P(grade >= 2) is at least one half, so neither low quality nor toxic text is wanted; the expected
grade and P(grade >= 1) rank what there is.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glyphloom.llm import words
from glyphloom.llm.common import table

SAMPLE = 4_096  # labelled documents that the model is fitted on, at most
BUCKETS = 1 << 18
GRADES = 3
LEAST_DOCS = 8  # sampled documents that must have a feature before it gets a weight
_SHAPE_SCALE = 8.0

_CLASS = np.arange(256, dtype=np.uint64)
_CLASS[97:123] = _CLASS[128:] = 1
_CLASS[65:91] = 2
_CLASS[48:58] = 3


class Model(NamedTuple):
    weights: np.ndarray  # by bucket
    thresholds: np.ndarray  # GRADES - 1, ascending


def features(own: words.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text number, bucket and value of each feature of the texts in ``own``, ordered by text.

    A word that occurs counts 1. The shape of words (kinds of their first two and last two characters) and words
    that repeat the one before count by their share of the text's words.
    """
    text = np.repeat(np.arange(len(own)), np.diff(own.begin))
    pairs = np.unique(text.astype(np.uint64) << np.uint64(20) | own.hashes % np.uint64(BUCKETS))
    kinds = _CLASS[own.raw]
    at, last = own.at, own.to - 1
    shape = kinds[at] | kinds[np.minimum(at + 1, last)] << np.uint64(8) | kinds[np.maximum(last - 1, at)] << np.uint64(16) | kinds[last] << np.uint64(24)
    same = np.zeros(len(text), dtype=bool)
    same[1:] = (own.hashes[1:] == own.hashes[:-1]) & (text[1:] == text[:-1])
    shape[same] = np.uint64(1) << np.uint64(40)
    shaped, count = np.unique(
        text.astype(np.uint64) << np.uint64(20) | words.mix(shape + np.uint64(77)) % np.uint64(BUCKETS), return_counts=True
    )
    key = np.concatenate([pairs, shaped])
    per_text = np.maximum(np.diff(own.begin), 1)
    value = np.concatenate([np.ones(len(pairs)), _SHAPE_SCALE * count / per_text[(shaped >> np.uint64(20)).astype(np.int64)]])
    order = np.argsort(key, kind="stable")
    key = key[order]
    return (key >> np.uint64(20)).astype(np.int64), (key & np.uint64((1 << 20) - 1)).astype(np.int64), value[order]


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def slope(w: np.ndarray, theta: np.ndarray, row: np.ndarray, local: np.ndarray, value: np.ndarray, grade: np.ndarray, decay: float) -> np.ndarray:
    """Gradient of the mean log likelihood less ``decay`` / 2 times the squared weights, by weights and ``theta``.

    ``theta`` is the first threshold and the logarithm of the second one's distance from it.
    """
    n = len(grade)
    score = np.bincount(row, value * w[local], minlength=n)
    gap = np.exp(theta[1])
    p1, p2 = sigmoid(score - theta[0]), sigmoid(score - theta[0] - gap)
    # d log P / d score through each threshold, by grade: P is 1 - p1, p1 - p2, p2.
    between = np.maximum(p1 - p2, 1e-9)
    d1 = np.where(grade == 0, -p1, np.where(grade == 1, p1 * (1 - p1) / between, 0.0))
    d2 = np.where(grade == 2, 1 - p2, np.where(grade == 1, -p2 * (1 - p2) / between, 0.0))
    by_weight = np.bincount(local, value * (d1 + d2)[row], minlength=len(w)) / n - decay * w
    return np.concatenate([by_weight, [-(d1 + d2).sum() / n, -d2.sum() / n * gap]])


def fit(row: np.ndarray, bucket: np.ndarray, value: np.ndarray, grade: np.ndarray, steps: int = 400, sparsity: float = 1e-4, decay: float = 0.0) -> Model:
    """Maximum likelihood less penalties on absolute and squared weights, by Adam over all rows; thresholds stay ordered.

    Most words say nothing of a grade; ``sparsity`` makes their weights 0, so that a few words that do aren't outweighed
    in a long text.

    ``row``, ``bucket``, ``value`` are the features and ``grade`` the grade of each row. Without rows, or with one
    grade only, the weights stay 0 and the thresholds follow the smoothed shares of the grades; without rows both
    tails are one half.
    """
    n = len(grade)
    if not n:
        return Model(np.zeros(BUCKETS), np.zeros(GRADES - 1))
    share = np.array([(np.count_nonzero(grade >= k) + 1) / (n + 2) for k in range(1, GRADES)])
    start = -np.log(share / (1 - share))
    theta = np.array([start[0], np.log(max(start[1] - start[0], 0.1))])
    weights = np.zeros(BUCKETS)
    if len(np.unique(grade)) < 2:
        return Model(weights, np.array([theta[0], theta[0] + np.exp(theta[1])]))
    often = np.bincount(bucket, minlength=BUCKETS) >= min(LEAST_DOCS, max(1, n // 16))
    own = often[bucket]
    row, bucket, value = row[own], bucket[own], value[own]
    used, local = np.unique(bucket, return_inverse=True)
    local = local.astype(np.int32)
    w = np.zeros(len(used))
    m, v = np.zeros(len(w) + 2), np.zeros(len(w) + 2)
    for step in range(1, steps + 1):
        gradient = slope(w, theta, row, local, value, grade, decay)
        m = 0.9 * m + 0.1 * gradient
        v = 0.99 * v + 0.01 * gradient**2
        rate = 0.05 / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        move = rate * m / (1 - 0.9**step)
        w = w + move[:-2]
        w = np.sign(w) * np.maximum(np.abs(w) - sparsity * rate[:-2], 0.0)
        theta += move[-2:]
    weights[used] = w
    return Model(weights, np.array([theta[0], theta[0] + np.exp(theta[1])]))


def tails(model: Model, own: words.Words) -> np.ndarray:
    """P(grade >= k) of each text, one column for each k from 1."""
    row, bucket, value = features(own)
    score = np.bincount(row, value * model.weights[bucket], minlength=len(own))
    return sigmoid(score[:, None] - model.thresholds[None, :])


def grades(labels: DataFrame) -> DataFrame:
    """doc_id and grade; the lowest grade of a document counts, and rows without id or quality don't."""
    toxic = F.coalesce(F.col("toxic"), F.lit(0))
    grade = F.when(F.col("quality") <= 0, 0).when(toxic > 0, 1).otherwise(2)
    known = labels.where("doc_id is not null and quality is not null")
    return known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min(grade).alias("grade"))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """A model fitted on up to ``sample`` labelled documents, chosen by a hash of their id; of rows with one id the smallest text counts."""
    chosen = grades(labels).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    texts = docs.select(F.col("doc_id").cast("long"), "text").join(F.broadcast(chosen), "doc_id")
    # One row for each chosen id, however often it comes, so that no more than ``sample`` rows go to the driver.
    rows = texts.groupBy("doc_id").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"), F.min("grade").alias("grade"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, own in words.chunks(batch.column(0)):
                row, bucket, value = features(own)
                cut = np.searchsorted(row, np.arange(len(own) + 1))
                parts = [(bucket[a:b].astype(np.int32), value[a:b].astype(np.float32)) for a, b in zip(cut[:-1], cut[1:])]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(1).slice(at, len(own)),
                        pa.array([x for x, _ in parts], pa.list_(pa.int32())),
                        pa.array([x for _, x in parts], pa.list_(pa.float32())),
                    ],
                    ["grade", "buckets", "amounts"],
                )

    own = rows.select("text", "grade").mapInArrow(run, "grade int, buckets array<int>, amounts array<float>").toArrow()
    if not own.num_rows:
        return fit(np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0, np.float32), np.zeros(0, np.int64))
    buckets, amounts = (own.column(c).combine_chunks() for c in ("buckets", "amounts"))
    grade = own.column("grade").to_numpy().astype(np.int64)
    row = np.repeat(np.arange(len(grade), dtype=np.int32), buckets.value_lengths().to_numpy(zero_copy_only=False))
    buckets, amounts = buckets.flatten().to_numpy(), amounts.flatten().to_numpy()
    del own
    return fit(row, buckets, amounts, grade)


SCORES = "expected_grade double, p_good double, p_clean double, kept boolean"


def score(docs: DataFrame, model: Model, extra: list[str] | None = None) -> DataFrame:
    """Every document with its expected grade, P(grade >= 1), P(grade >= 2) and whether it is kept.

    ``extra`` names the columns of ``docs`` to return instead of ``doc_id`` alone; a column of the same name as a
    score is not among them.
    """
    scores = [part.split()[0] for part in SCORES.split(", ")]
    names = ["doc_id"] if extra is None else [c for c in extra if c not in scores]
    rows = docs.select(*names, F.col("text").alias("_scored_text"))
    return rows.mapInArrow(_scorer(model, len(names), scores), _with_scores(rows.schema.fields[: len(names)]))


def _with_scores(fields: list[T.StructField]) -> T.StructType:
    return T.StructType([*fields, *T.StructType.fromDDL(SCORES).fields])


def _scorer(model: Model, width: int, scores: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Adds scores to batches of ``width`` columns followed by the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                p = np.concatenate([tails(model, own) for _, own in words.chunks(batch.column(width))])
                columns = [pa.array(p.sum(axis=1)), pa.array(p[:, 0]), pa.array(p[:, 1]), pa.array(p[:, 1] >= 0.5)]
                yield pa.RecordBatch.from_arrays([*batch.columns[:width], *columns], [*batch.schema.names[:width], *scores])

    return run


def keep_rated(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The rows of ``docs`` that ``rate`` keeps, with all their columns, whatever their names."""
    model = train(docs, labels, sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                text = batch.column(batch.schema.names.index("text"))
                good = np.concatenate([tails(model, own)[:, 1] for _, own in words.chunks(text)]) >= 0.5
                yield batch.filter(pa.array(good))

    return docs.mapInArrow(run, docs.schema)


def rate(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, extra: list[str] | None = None) -> DataFrame:
    """Fit on ``labels`` and score all of ``docs``; null texts count as empty and have the score 0.

    Null or repeated ids and repeated rows are scored each; empty documents give no rows; without labels every
    document has the same tails of one half.
    """
    return score(docs, train(docs, labels, sample), extra)


def op1_ordinal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
