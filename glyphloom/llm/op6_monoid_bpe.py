"""Byte-level BPE encoding and decoding as a monoid tree reduction.

An encoded text is a pair (text, ids). A text is encoded by halves: short leaves directly, and two neighbours
are joined by encoding again a window of text around their border. The window grows on each side until it ends
at a place where the splitting pattern must begin a new match whatever stands further away: between a letter or
digit and an ASCII blank or line break, since no match of the pattern has white space after anything else. From such a place on,
matching depends only on what follows it, and up to it only on what precedes it, so the ids outside the window
are final. Decoding concatenates the bytes of halves up the same tree. Both operations are associative, so a
text could also be reduced from parts that come from several tasks.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphloom.llm.common import table

LEAF = 2048
_WINDOW = 32
_BLANKS = frozenset(" \n")


class ByteBpe:
    """Encoder and decoder for a rank file of byte-level BPE."""

    def __init__(self, path: str, pattern: str = public_tokenizers.PATTERN, leaf: int = LEAF):
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.coder = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.leaf = leaf
        self.lengths = np.zeros(max(ranks.values()) + 1, dtype=np.int64)
        for token, rank in ranks.items():
            self.lengths[rank] = len(token)

    def encode(self, text: str) -> list[int]:
        """Ids of a whole text, without special tokens."""
        if len(text) <= self.leaf:
            return self.coder.encode_ordinary(text)
        middle = len(text) // 2
        left, right = text[:middle], text[middle:]
        return self.join(left, self.encode(left), right, self.encode(right))

    def join(self, left: str, left_ids: list[int], right: str, right_ids: list[int]) -> list[int]:
        """Ids of ``left + right`` from the ids of both."""
        before, after = self._stable_end(left), self._stable_start(right)
        kept = self._count(left_ids, len(left[before:].encode()), from_end=True)
        dropped = self._count(right_ids, len(right[:after].encode()), from_end=False)
        window = self.coder.encode_ordinary(left[before:] + right[:after])
        return left_ids[: len(left_ids) - kept] + window + right_ids[dropped:]

    @staticmethod
    def _stable_end(text: str) -> int:
        """The last place in ``text`` where a match must begin; 0 if there is none."""
        width = _WINDOW
        while True:
            at = max(0, len(text) - width)
            for i in range(len(text) - 1, at, -1):
                if text[i] in _BLANKS and text[i - 1].isalnum():
                    return i
            if not at:
                return 0
            width *= 2

    @staticmethod
    def _stable_start(text: str) -> int:
        """The first place in ``text`` where a match must begin; its length if there is none."""
        width = _WINDOW
        while True:
            to = min(len(text), width)
            for i in range(1, to):
                if text[i] in _BLANKS and text[i - 1].isalnum():
                    return i
            if to == len(text):
                return to
            width *= 2

    def _count(self, ids: list[int], size: int, from_end: bool) -> int:
        """How many ids at one end make up ``size`` bytes."""
        n = 0
        for i in reversed(ids) if from_end else ids:
            if size <= 0:
                break
            size -= int(self.lengths[i])
            n += 1
        assert size == 0, "a stable place is inside a token"
        return n

    def decode(self, ids: list[int], leaf: int = LEAF) -> bytes:
        """The bytes of ids, halves being concatenated."""
        if len(ids) <= leaf:
            return self.coder.decode_bytes(ids)
        middle = len(ids) // 2
        return self.decode(ids[:middle], leaf) + self.decode(ids[middle:], leaf)


_coders: dict[str, ByteBpe] = {}


def coder(path: str) -> ByteBpe:
    """The coder of this worker process."""
    if path not in _coders:
        _coders[path] = ByteBpe(path)
    return _coders[path]


def ranks_path() -> str:
    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def encode_texts(docs: DataFrame, ranks: str | None = None) -> DataFrame:
    """``doc_id`` and ``ids`` (array) of every document; a null text counts as empty and has no ids."""
    path = ranks or ranks_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                ids = [own.encode(t.as_py() or "") for t in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id bigint, ids array<int>")


def round_trip(docs: DataFrame, ranks: str | None = None) -> DataFrame:
    """Digests of every document's ids and of the bytes that decoding these ids gives.

    Columns: doc_id, n_tokens, ids_sha256 (of little-endian unsigned 32-bit ids), decoded_sha256. A null text
    counts as empty. Null or repeated ids and repeated rows are kept; an empty table gives no rows.
    """
    path = ranks or ranks_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(path)
        for batch in batches:
            n, first, second = [], [], []
            for text in batch.column(1):
                ids = own.encode(text.as_py() or "")
                n.append(len(ids))
                first.append(hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest())
                second.append(hashlib.sha256(own.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(first, pa.string()), pa.array(second, pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    schema = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)


def op6_monoid_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"))
