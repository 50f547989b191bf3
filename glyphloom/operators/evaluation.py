"""Cross-entropy and perplexity the way a training loop evaluates: the unweighted mean of batch means, then exp.

The model here is a character bigram with add-one smoothing, a stand-in for a neural model that needs no training
loop. It shares split, vocabulary, unknown token, windows and aggregation with it, but is neither an LSTM nor fine-tuned.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphloom.operators.corpus import CHUNK_BATCHES, MAX_CHARS, SEQ_LEN, chunks, encode, packed_vocabulary, vocabulary

BATCH = 64


def bigram_models(docs: DataFrame, max_chars: int = MAX_CHARS) -> DataFrame:
    """One row per language: alphabet, and the counts of pairs in its train split (key = id * size + next id)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for lang, text, alphabet in zip(*(rows.column(k).to_pylist() for k in range(3))):
                ids, size = encode(text, alphabet), len(alphabet) + 1
                n = min(CHUNK_BATCHES * BATCH, len(ids) - 1)
                if n > 0:
                    key, k = np.unique(ids[:n] * size + ids[1 : n + 1], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(key)), pa.array(key), pa.array(k)], ["lang", "key", "k"])

    alphabets = packed_vocabulary(vocabulary(docs, max_chars))
    train = chunks(docs, 1, BATCH, max_chars, ("train",)).join(alphabets, "lang").select("lang", "text", "alphabet")
    pairs = train.mapInArrow(count, "lang string, key bigint, k bigint").groupBy("lang", "key").agg(F.sum("k").alias("k"))
    table = pairs.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("key", "k"))).alias("t"))
    return alphabets.join(table, "lang", "left").select("lang", "alphabet", F.col("t.key").alias("keys"), F.col("t.k").alias("counts"))


def bigram_losses(ids: np.ndarray, size: int, keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """-log of the smoothed probability of each next id."""
    if not len(keys):
        return np.full(max(len(ids) - 1, 0), np.log(size))
    firsts, at = np.unique(keys // size, return_index=True)
    totals = np.add.reduceat(counts, at)

    def looked_up(wanted: np.ndarray, known: np.ndarray, values: np.ndarray) -> np.ndarray:
        found = np.minimum(np.searchsorted(known, wanted), len(known) - 1)
        return np.where(known[found] == wanted, values[found], 0)

    pair = looked_up(ids[:-1] * size + ids[1:], keys, counts)
    return -np.log((pair + 1) / (looked_up(ids[:-1], firsts, totals) + size))


def transfer_matrix(docs: DataFrame, seq_len: int = SEQ_LEN, batch: int = BATCH, max_chars: int = MAX_CHARS, own_only: bool = False) -> DataFrame:
    """Loss and perplexity of every source language's model on every target's test split, in the source's vocabulary.

    A target without a full window has loss 0 and perplexity 1. The short last batch counts as much as any other.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            out = []
            for tgt, text, src, alphabet, keys, counts in zip(*(rows.column(k) for k in range(6))):
                ids, size = encode(text.as_py(), alphabet.as_py()), len(alphabet.as_py()) + 1
                n = min(CHUNK_BATCHES * batch, len(ids) - seq_len)
                if n <= 0:
                    continue
                table = (v.values.to_numpy() if v.is_valid else np.zeros(0, dtype=np.int64) for v in (keys, counts))
                sums = np.concatenate([[0.0], np.cumsum(bigram_losses(ids, size, *table))])
                means = (sums[seq_len : seq_len + n] - sums[:n]) / seq_len
                cuts = np.arange(0, n, batch)
                out.append((src.as_py(), tgt.as_py(), float((np.add.reduceat(means, cuts) / np.minimum(batch, n - cuts)).sum()), len(cuts)))
            if out:
                kinds = [pa.string(), pa.string(), pa.float64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], ["src", "tgt", "s", "k"])

    models = bigram_models(docs, max_chars)
    langs = models.select(F.col("lang").alias("src"))
    tests = chunks(docs, seq_len, batch, max_chars, ("test",)).select(F.col("lang").alias("tgt"), "text")
    if own_only:
        tests = tests.withColumn("src", F.col("tgt"))
        cells = langs.withColumn("tgt", F.col("src"))
    else:
        names = langs.agg(F.collect_set("src").alias("all")).withColumn("one", F.lit(1))
        tests = tests.withColumn("one", F.lit(1)).join(F.broadcast(names), "one").withColumn("src", F.explode("all"))
        cells = langs.withColumn("one", F.lit(1)).join(F.broadcast(names), "one").select("src", F.explode("all").alias("tgt"))
    scored = tests.join(models, F.col("src") == F.col("lang")).select("tgt", "text", "src", "alphabet", "keys", "counts")
    sums = scored.mapInArrow(run, "src string, tgt string, s double, k bigint").groupBy("src", "tgt").agg((F.sum("s") / F.sum("k")).alias("loss"))
    loss = F.coalesce("loss", F.lit(0.0))
    return cells.join(sums, ["src", "tgt"], "left").select("src", "tgt", F.round(loss, 6).alias("loss"), F.round(F.exp(loss), 6).alias("ppl"))


def eval_loss(docs: DataFrame, seq_len: int = SEQ_LEN, batch: int = BATCH, max_chars: int = MAX_CHARS) -> DataFrame:
    """Each language's model on its own test split."""
    return transfer_matrix(docs, seq_len, batch, max_chars, own_only=True).select(F.col("src").alias("lang"), "loss", "ppl")
