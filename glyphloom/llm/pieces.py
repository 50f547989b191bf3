"""Documents cut into pieces of at most ``capacity`` tokens, and pieces placed by a plan over sizes.

A packing plan is made on the histogram of piece sizes, which has at most ``capacity`` entries however many
documents there are, and is carried out by rank: the k-th piece of a size goes where the plan puts the k-th
item of that size. No task sees more than its share of the pieces.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphloom.llm.common import rank_within, thrifty
from glyphloom.llm.word_ids import END_ID, WordEncoder

Plan = list[tuple[tuple[int, ...], int]]
PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"
_RANK_BITS = 44


def cut(docs: DataFrame, vocabulary: str, capacity: int, with_ids: bool = False) -> DataFrame:
    """One row per piece of every document's ids followed by ``END_ID``; only longer documents are cut.

    A null text counts as empty, and is one piece of one token. ``doc_id`` may be null or repeated. With
    ``with_ids`` the column ``ids`` holds a piece's ids as little-endian 16-bit integers.
    """
    end = np.array([END_ID], dtype="<u2").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # A task's own: idle workers, which later tasks take in turn, would each keep a memory of words.
        coder = None
        for batch in batches:
            coder = coder or WordEncoder(vocabulary)
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                rows: list[tuple] = []
                texts = [text or "" for text in part.column(1).to_pylist()]
                for doc, coded in zip(part.column(0).to_pylist(), coder.ids(texts), strict=True):
                    ids = np.frombuffer(coded + end, dtype="<u2")
                    for k, start in enumerate(range(0, len(ids), capacity)):
                        own = ids[start : start + capacity]
                        row = (doc, k, start, len(own), zlib.crc32(own.astype("<u4").tobytes()))
                        rows.append((*row, own.tobytes()) if with_ids else row)
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
                names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: 5 + with_ids]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds)], names)

    schema = PIECES + (", ids binary" if with_ids else "")
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(thrifty(run), schema)


def histogram(pieces: DataFrame, capacity: int) -> np.ndarray:
    """How many pieces there are of each length; at most ``capacity`` counts come to the driver."""
    counts = np.zeros(capacity + 1, dtype=np.int64)
    for length, n in pieces.groupBy("length").agg(F.count(F.lit(1))).toLocalIterator():
        counts[length] = n
    return counts


def places(plan: Plan) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each run of equal-sized items: size and first rank (as one sorted key), sequence of that rank, offset."""
    used: dict[int, int] = {}
    runs: list[tuple[int, int, int]] = []
    sequence = 0
    for sizes, times in plan:
        offset = 0
        for size in sizes:
            rank = used.get(size, 0)
            runs.append((size << _RANK_BITS | rank, sequence - rank, offset))
            used[size] = rank + times
            offset += size
        sequence += times
    key, shift, offset = (np.array(x, dtype=np.int64) for x in zip(*sorted(runs), strict=True)) if runs else [np.zeros(0, np.int64)] * 3
    return key, shift, offset


def place(pieces: DataFrame, plan: Plan, rows: int) -> DataFrame:
    """Pieces with ``sequence_id`` and ``offset`` as the plan says; ranks of equal sizes follow a hash order."""
    key, shift, at = places(plan)
    ranked = rank_within(pieces, ["length"], ["doc_id", "piece", "ids_crc32"], rows, "rank")
    names = [c for c in ranked.columns if c != "rank"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema) + ", sequence_id bigint, offset bigint"

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            rank = batch.column("rank").to_numpy(zero_copy_only=False)
            found = np.searchsorted(key, batch.column("length").to_numpy(zero_copy_only=False) << _RANK_BITS | rank, side="right") - 1
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in names), pa.array(shift[found] + rank), pa.array(at[found])], [*names, "sequence_id", "offset"]
            )

    return ranked.mapInArrow(thrifty(run), schema)
