"""Corpora by language: size, cap, contiguous splits, vocabularies, encoding, windows and batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glyphloom.operators.ordering import running_total

MAX_CHARS = 10_000_000
TRAIN_RATIO, VAL_RATIO = 0.70, 0.15
UNK = "<unk>"
SEQ_LEN = 100
SPLITS = ("train", "val", "test")
CHUNK_BATCHES = 256


def positioned(docs: DataFrame, max_chars: int = MAX_CHARS) -> DataFrame:
    """Documents with their place in the language's text: off, len (code points), n (characters after the cap).

    Documents beyond the cap go, and the one that it cuts is shortened.
    """
    placed = running_total(docs.withColumn("len", F.length("text").cast("long")), ["lang"], "doc_id", F.col("len"), "off", "total", below=max_chars)
    kept = placed.where((F.col("off") < max_chars) & (F.col("len") > 0)).withColumn("keep", F.least(F.col("len"), F.lit(max_chars) - F.col("off")))
    text = F.when(F.col("keep") < F.col("len"), F.substring("text", F.lit(1), F.col("keep").cast("int"))).otherwise(F.col("text"))
    return kept.select("doc_id", "lang", text.alias("text"), "off", F.col("keep").alias("len"), F.least("total", F.lit(max_chars)).cast("long").alias("n"))


def corpus_stats(docs: DataFrame, max_chars: int = MAX_CHARS) -> DataFrame:
    out = docs.groupBy("lang").agg(F.count(F.lit(1)).alias("n_docs"), F.sum(F.length("text")).cast("long").alias("n_chars"))
    return out.withColumn("capped_chars", F.least("n_chars", F.lit(max_chars)).cast("long"))


def bounds(n: Column, train: float = TRAIN_RATIO, val: float = VAL_RATIO) -> tuple[Column, Column]:
    """Where the second and third part begin: products in double precision, cut to integers."""
    share = F.lit(train).cast("double")
    return (n * share).cast("long"), (n * (share + F.lit(val).cast("double"))).cast("long")


def split_parts(placed: DataFrame, train: float = TRAIN_RATIO, val: float = VAL_RATIO) -> DataFrame:
    """Each document's share of each split: lang, split, start (in the split), piece, len, m (the split's size)."""
    a, b = bounds(F.col("n"), train, val)
    edges = F.array(
        *(F.struct(F.lit(name).alias("split"), lo.cast("long").alias("lo"), hi.cast("long").alias("hi")) for name, lo, hi in zip(SPLITS, (F.lit(0), a, b), (a, b, F.col("n"))))
    )
    parts = placed.withColumn("e", F.explode(edges)).where((F.col("off") < F.col("e.hi")) & (F.col("off") + F.col("len") > F.col("e.lo")))
    lo, hi = F.greatest("off", F.col("e.lo")), F.least(F.col("off") + F.col("len"), F.col("e.hi"))
    return parts.select(
        "lang", F.col("e.split").alias("split"), (lo - F.col("e.lo")).alias("start"), (hi - lo).alias("len"), (F.col("e.hi") - F.col("e.lo")).alias("m"),
        F.substring("text", (lo - F.col("off") + 1).cast("int"), (hi - lo).cast("int")).alias("piece"),
    )


def split_sizes(docs: DataFrame, max_chars: int = MAX_CHARS) -> DataFrame:
    """Characters of every language's splits, empty ones included."""
    n = corpus_stats(docs, max_chars).select("lang", F.col("capped_chars").alias("n"))
    a, b = bounds(F.col("n"))
    sizes = F.array(*(F.struct(F.lit(s).alias("split"), k.cast("long").alias("n_chars")) for s, k in zip(SPLITS, (a, b - a, F.col("n") - b))))
    return n.select("lang", F.explode(sizes).alias("s")).select("lang", "s.split", "s.n_chars")


def corpus_split(docs: DataFrame, max_chars: int = MAX_CHARS) -> DataFrame:
    """Characters, documents touched and a position checksum of each split, from the documents' shares."""
    parts = split_parts(positioned(docs, max_chars))
    return parts.groupBy("lang", "split").agg(
        F.sum("len").cast("long").alias("n_chars"), F.count(F.lit(1)).alias("n_parts"), F.sum(F.col("start") % 1009).cast("long").alias("start_sum")
    )


def vocabulary(docs: DataFrame, max_chars: int = MAX_CHARS, unk: str = UNK) -> DataFrame:
    """lang, ch, id: the corpus's characters by code point from 0, and ``unk`` last, once."""
    chars = positioned(docs, max_chars).select("lang", F.explode(F.array_distinct(F.split("text", ""))).alias("ch")).distinct()
    known = chars.where((F.col("ch") != unk) & (F.col("ch") != "")).withColumn(
        "id", (F.row_number().over(Window.partitionBy("lang").orderBy("ch")) - 1).cast("int")
    )
    last = chars.groupBy("lang").agg(F.sum(F.when((F.col("ch") != unk) & (F.col("ch") != ""), 1).otherwise(0)).cast("int").alias("id"))
    return known.unionByName(last.select("lang", F.lit(unk).alias("ch"), "id"))


def char_counts(docs: DataFrame, max_chars: int = MAX_CHARS) -> DataFrame:
    """How often each character occurs in each language's capped text."""
    chars = positioned(docs, max_chars).select("lang", F.explode(F.split("text", "")).alias("ch")).where("ch <> ''")
    return chars.groupBy("lang", "ch").agg(F.count(F.lit(1)).alias("k"))


def encode_oov(docs: DataFrame, max_chars: int = MAX_CHARS) -> DataFrame:
    """For every source vocabulary and target text: how many characters become unknown."""
    counts = char_counts(docs, max_chars)
    vocab = vocabulary(docs, max_chars).where(F.col("ch") != UNK).select(F.col("lang").alias("src"), "ch")
    known = counts.select(F.col("lang").alias("tgt"), "ch", "k").join(vocab, "ch").groupBy("src", "tgt").agg(F.sum("k").alias("known"))
    total = counts.groupBy(F.col("lang").alias("tgt")).agg(F.sum("k").alias("n_chars"))
    langs = total.agg(F.sort_array(F.collect_set("tgt")).alias("langs"))
    pairs = total.withColumn("one", F.lit(1)).join(langs.withColumn("one", F.lit(1)), "one").select("tgt", "n_chars", F.explode("langs").alias("src"))
    unk = F.col("n_chars") - F.coalesce("known", F.lit(0))
    return pairs.join(known, ["src", "tgt"], "left").select(
        "src", "tgt", F.col("n_chars").cast("long"), unk.cast("long").alias("n_unk"), F.round(unk / F.col("n_chars"), 6).alias("unk_rate")
    )


def vocab_overlap(docs: DataFrame, max_chars: int = MAX_CHARS) -> DataFrame:
    """Characters that two languages share, and that only one of them has."""
    vocab = vocabulary(docs, max_chars).where(F.col("ch") != UNK).select("lang", "ch")
    sizes = vocab.groupBy("lang").agg(F.count(F.lit(1)).alias("k"))
    shared = (
        vocab.select(F.col("lang").alias("a"), "ch").join(vocab.select(F.col("lang").alias("b"), "ch"), "ch").where("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared"))
    )
    out = shared.join(sizes.select(F.col("lang").alias("a"), F.col("k").alias("ka")), "a").join(sizes.select(F.col("lang").alias("b"), F.col("k").alias("kb")), "b")
    return out.select("a", "b", "shared", (F.col("ka") - F.col("shared")).alias("only_a"), (F.col("kb") - F.col("shared")).alias("only_b"))


def dataset_lengths(docs: DataFrame, seq_len: int = SEQ_LEN, max_chars: int = MAX_CHARS) -> DataFrame:
    return split_sizes(docs, max_chars).withColumn("samples", F.greatest(F.lit(0), F.col("n_chars") - seq_len).cast("long"))


def batch_plan(docs: DataFrame, sizes: tuple[int, ...] = (64, 256), seq_len: int = SEQ_LEN, max_chars: int = MAX_CHARS) -> DataFrame:
    """Batches of each split for each batch size, and the size of the last one, which may be short."""
    rows = dataset_lengths(docs, seq_len, max_chars).withColumn("batch_size", F.explode(F.array(*map(F.lit, sizes))))
    batches = F.ceil(F.col("samples") / F.col("batch_size")).cast("long")
    last = F.when(F.col("samples") > 0, F.col("samples") - F.col("batch_size") * (batches - 1)).otherwise(F.lit(0)).cast("long")
    return rows.select("lang", "split", "batch_size", "samples", batches.alias("batches"), last.alias("last_batch"))


def chunks(docs: DataFrame, seq_len: int, batch: int, max_chars: int = MAX_CHARS, splits: tuple[str, ...] = SPLITS) -> DataFrame:
    """Each split's text in chunks of whole batches, each with the ``seq_len`` characters after it.

    lang, split, first (the chunk's first window), m (characters of the split), text. Windows of one chunk need
    nothing else, and no chunk has more than a fixed number of characters.
    """
    size = CHUNK_BATCHES * batch
    parts = split_parts(positioned(docs, max_chars)).where(F.col("split").isin(*splits))
    first = F.greatest(F.lit(0), F.floor((F.col("start") - seq_len) / size)).cast("long")
    last = F.floor((F.col("start") + F.col("len") - 1) / size).cast("long")
    cut = parts.withColumn("chunk", F.explode(F.sequence(first, last)))
    lo = F.greatest("start", F.col("chunk") * size)
    hi = F.least(F.col("start") + F.col("len"), (F.col("chunk") + 1) * size + seq_len)
    cut = cut.where(hi > lo).select("lang", "split", "chunk", "m", lo.alias("lo"), F.substring("piece", (lo - F.col("start") + 1).cast("int"), (hi - lo).cast("int")).alias("piece"))
    joined = cut.groupBy("lang", "split", "chunk", "m").agg(F.sort_array(F.collect_list(F.struct("lo", "piece"))).alias("parts"))
    return joined.select("lang", "split", (F.col("chunk") * size).alias("first"), "m", F.array_join(F.col("parts.piece"), "").alias("text"))


def packed_vocabulary(vocab: DataFrame, unk: str = UNK) -> DataFrame:
    """One row per language: all its characters but ``unk`` as one string in id order."""
    known = vocab.where(F.col("ch") != unk).groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("id", "ch"))).alias("v"))
    return known.select("lang", F.array_join(F.col("v.ch"), "").alias("alphabet"))


def encode(text: str, alphabet: str) -> np.ndarray:
    """Ids of a text: places in ``alphabet``, which is sorted by code point; others get its length."""
    known = np.frombuffer(alphabet.encode("utf-32-le"), dtype="<u4")
    points = np.frombuffer(text.encode("utf-32-le"), dtype="<u4")
    if not len(known):
        return np.zeros(len(points), dtype=np.int64)
    at = np.minimum(np.searchsorted(known, points), len(known) - 1)
    return np.where(known[at] == points, at, len(known)).astype(np.int64)


def windows(docs: DataFrame, seq_len: int, batch: int = 64, max_chars: int = MAX_CHARS) -> DataFrame:
    """All next-character samples with stride 1: lang, split, i, x and y, each an array of ``seq_len`` ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for lang, split, first, text, alphabet in zip(*(rows.column(k).to_pylist() for k in range(5))):
                ids = encode(text, alphabet).astype(np.int32)
                count = min(CHUNK_BATCHES * batch, len(ids) - seq_len)
                for at in range(0, count, 2048):
                    n = min(2048, count - at)
                    seen = np.lib.stride_tricks.sliding_window_view(ids[at : at + n + seq_len], seq_len)
                    starts = pa.array(np.arange(0, (n + 1) * seq_len, seq_len, dtype=np.int32))
                    x, y = (pa.ListArray.from_arrays(starts, pa.array(np.ascontiguousarray(v).reshape(-1))) for v in (seen[:n], seen[1 : n + 1]))
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * n), pa.array([split] * n), pa.array(np.arange(first + at, first + at + n)), x, y], ["lang", "split", "i", "x", "y"])

    rows = chunks(docs, seq_len, batch, max_chars).join(packed_vocabulary(vocabulary(docs, max_chars)), "lang")
    return rows.select("lang", "split", "first", "text", "alphabet").mapInArrow(run, "lang string, split string, i bigint, x array<int>, y array<int>")


def window_batches(docs: DataFrame, seq_len: int = 16, batch: int = 64, max_chars: int = MAX_CHARS) -> DataFrame:
    """Digests of the windows batch by batch: number of windows, and sums over them of x, of x weighted by place, and of y."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight = np.arange(1, seq_len + 1)
        for rows in batches:
            for lang, split, first, text, alphabet in zip(*(rows.column(k).to_pylist() for k in range(5))):
                ids = encode(text, alphabet)
                count = min(CHUNK_BATCHES * batch, len(ids) - seq_len)
                if count <= 0:
                    continue
                seen = np.lib.stride_tricks.sliding_window_view(ids[: count + seq_len], seq_len)
                sums, dots = seen.sum(axis=1), seen @ weight
                cuts = np.arange(0, count, batch)
                columns = [np.minimum(batch, count - cuts), *(np.add.reduceat(v, cuts) for v in (sums[:count], dots[:count], sums[1 : count + 1]))]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(cuts)), pa.array([split] * len(cuts)), pa.array((first + cuts) // batch), *(pa.array(c.astype(np.int64)) for c in columns)],
                    ["lang", "split", "batch_id", "n", "x_sum", "x_dot", "y_sum"],
                )

    rows = chunks(docs, seq_len, batch, max_chars).join(packed_vocabulary(vocabulary(docs, max_chars)), "lang")
    return rows.select("lang", "split", "first", "text", "alphabet").mapInArrow(
        run, "lang string, split string, batch_id bigint, n bigint, x_sum bigint, x_dot bigint, y_sum bigint"
    )


def balance(docs: DataFrame) -> DataFrame:
    """Every language cut to the smallest one's size: its characters, what stays, and the documents that it touches."""
    placed = running_total(docs.withColumn("len", F.length("text").cast("long")), ["lang"], "doc_id", F.col("len"), "off", "total")
    least = docs.groupBy("lang").agg(F.sum(F.length("text")).cast("long").alias("k")).agg(F.min("k").alias("least")).withColumn("one", F.lit(1))
    cut = placed.withColumn("one", F.lit(1)).join(F.broadcast(least), "one").where("off < least and len > 0")
    return cut.groupBy("lang").agg(
        F.max("total").alias("n_chars"), F.sum(F.least(F.col("len"), F.col("least") - F.col("off"))).alias("kept_chars"), F.count(F.lit(1)).alias("kept_docs")
    )
