"""Token-ID output: best-fit-decreasing packing with a segment tree, written as packed id matrices.

Documents are encoded, ended with an end id, and cut without loss where they are longer than a row. The packing is
planned on the histogram of piece lengths. A segment tree over capacities holds how many open rows have that much
space; the tightest row that takes a piece is the leftmost non-empty leaf from the piece's length on, found in
logarithmic time. Rows with equal contents are one entry of the plan, so its length follows the number of
distinct lengths, not of documents.

Each output row is one sequence: padded ids, cumulative segment lengths, and positions that start again at every
segment.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphloom.llm.common import materialise, table
from glyphloom.llm.pieces import Plan, cut, histogram, place
from glyphloom.llm.word_ids import vocabulary_path

CAPACITY = 2048
PAD_ID = 0


class CapacityTree:
    """Counts of open rows by free space, with the smallest free space of at least a given size."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.sums = [0] * (2 * self.leaves)

    def add(self, space: int, n: int) -> None:
        at = space + self.leaves
        while at:
            self.sums[at] += n
            at //= 2

    def tightest(self, size: int) -> int | None:
        """The smallest space of at least ``size`` that an open row has."""
        at = size + self.leaves
        if self.sums[at]:
            return size
        while at > 1:
            if not at & 1 and self.sums[at + 1]:
                at += 1
                while at < self.leaves:
                    at = 2 * at if self.sums[2 * at] else 2 * at + 1
                return at - self.leaves
            at //= 2
        return None


def best_fit_decreasing(counts: np.ndarray, capacity: int) -> Plan:
    """Rows (contents, number) for ``counts[s]`` pieces of each length ``s`` from 1 to ``capacity``."""
    tree = CapacityTree(capacity)
    rows: dict[int, list[tuple[tuple[int, ...], int]]] = {}

    def put(contents: tuple[int, ...], n: int, space: int) -> None:
        rows.setdefault(space, []).append((contents, n))
        tree.add(space, n)

    for size in np.flatnonzero(counts)[::-1].tolist():
        left = int(counts[size])
        while left:
            space = tree.tightest(size)
            if space is None:
                each = capacity // size
                full, rest = divmod(left, each)
                if full:
                    put((size,) * each, full, capacity - each * size)
                if rest:
                    put((size,) * rest, 1, capacity - rest * size)
                break
            # A row that takes a piece is the tightest for the next one of that length as long as it has the space.
            contents, n = rows[space].pop()
            tree.add(space, -n)
            each = space // size
            full = min(n, left // each)
            rest = left - full * each if full < n else 0
            for times, k in ((full, each), (1 if rest else 0, rest), (n - full - (1 if rest else 0), 0)):
                if times:
                    put((*contents, *(size,) * k), times, space - k * size)
            left -= full * each + rest
    return [row for own in rows.values() for row in own]


SCHEMA = (
    "sequence_id bigint, n_tokens int, n_segments int, doc_ids array<bigint>, pieces array<int>, "
    "input_ids array<int>, cu_seqlens array<int>, position_ids array<int>"
)

CHECKSUMS = ", input_ids_crc32 bigint, cu_seqlens_crc32 bigint, position_ids_crc32 bigint"
DIGESTS = (
    "sequence_id bigint, n_tokens int, n_segments int, doc_ids array<bigint>, pieces array<int>, "
    "input_ids_crc32 bigint, cu_seqlens_crc32 bigint, position_ids_crc32 bigint"
)
BROADCAST_PLACES = 500_000  # places at most that go to every executor; more are joined by shuffle


def _grouped(docs: DataFrame, capacity: int, vocabulary: str | None) -> DataFrame:
    """sequence_id and parts, the pieces of the sequence in order. Ids are moved once, to their sequence."""
    own = cut(docs, vocabulary or vocabulary_path(), capacity, with_ids=True).withColumn("key", F.monotonically_increasing_id())
    pieces = materialise(own, "pieces")
    counts = histogram(pieces, capacity)
    total = int(counts.sum())
    placed = place(pieces.select("doc_id", "piece", "ids_crc32", "length", "key"), best_fit_decreasing(counts, capacity), total)
    places = materialise(placed.select("key", "sequence_id", "offset"), "places")
    joined = pieces.join(F.broadcast(places) if total <= BROADCAST_PLACES else places, "key")
    parts = F.sort_array(F.collect_list(F.struct("offset", "length", "doc_id", "piece", "ids")))
    return joined.groupBy("sequence_id").agg(parts.alias("parts"))


def _built(rows: DataFrame, capacity: int, schema: str) -> DataFrame:
    names = [part.split()[0] for part in schema.split(", ")]
    matrices, digests = "input_ids" in names, "input_ids_crc32" in names
    last = [pa.list_(pa.int32())] * 3 * matrices + [pa.int64()] * 3 * digests
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int32()), *last]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                out: list[tuple] = []
                for sequence, own in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    lengths = np.array([x["length"] for x in own], dtype=np.int32)
                    total = int(lengths.sum())
                    ids, positions = np.full(capacity, PAD_ID, dtype=np.int32), np.zeros(capacity, dtype=np.int32)
                    ids[:total] = np.concatenate([np.frombuffer(x["ids"], dtype="<u2") for x in own])
                    starts = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
                    positions[:total] = np.arange(total, dtype=np.int32) - np.repeat(starts[:-1], lengths)
                    made = [ids, starts, positions] if matrices else []
                    made += [zlib.crc32(x.astype("<u4").tobytes()) for x in (ids, starts, positions)] if digests else []
                    out.append((sequence, total, len(own), [x["doc_id"] for x in own], [x["piece"] for x in own], *made))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*out), kinds, strict=True)], names)

    return rows.mapInArrow(run, schema)


def packed_rows(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str | None = None) -> DataFrame:
    """One row per packed sequence of all documents (``doc_id``, ``text``; other columns are ignored).

    ``input_ids`` and ``position_ids`` have ``capacity`` entries, padded by 0; ``cu_seqlens`` begins with 0 and ends
    with the number of tokens. A null text counts as empty and is one end id. Null or repeated ids and repeated rows
    are packed each; an empty table gives no rows.
    """
    return _built(_grouped(docs, capacity, vocabulary), capacity, SCHEMA)


def packed_digests(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str | None = None) -> DataFrame:
    """The same rows with each id matrix row, its boundaries and its positions as CRC-32 of little-endian unsigned 32-bit values."""
    return _built(_grouped(docs, capacity, vocabulary), capacity, DIGESTS)


def packed_matrices(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str | None = None) -> DataFrame:
    """The same rows with the id matrix, boundaries and positions, and the CRC-32 of each."""
    return _built(_grouped(docs, capacity, vocabulary), capacity, SCHEMA + CHECKSUMS)


def write_matrices(docs: DataFrame, path: str, capacity: int = CAPACITY, vocabulary: str | None = None) -> None:
    """Write packed rows and their digests as Parquet, one fixed-width row of ids per sequence."""
    packed_matrices(docs, capacity, vocabulary).write.parquet(path)


def op9_packed_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_matrices(table(spark, sf_dir, "documents"))
