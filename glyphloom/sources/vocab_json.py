"""Vocabulary files: JSON with the characters in id order and the unknown token."""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from pathlib import Path
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = "itos array<string>, unk string"
DEFAULT_UNK = "<unk>"


def to_rows(vocab: DataFrame, unk: str = DEFAULT_UNK) -> DataFrame:
    """One JSON document per language."""
    listed = vocab.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("id", "ch"))).alias("v"))
    return listed.select("lang", F.to_json(F.struct(F.col("v.ch").alias("itos"), F.lit(unk).alias("unk"))).alias("json"))


def from_rows(rows: DataFrame) -> DataFrame:
    """lang, ch, id, vocab_size, unk of JSON documents. Of a repeated character the last place is its id; the size counts all."""
    parsed = rows.select("lang", F.from_json("json", SCHEMA, {"mode": "FAILFAST"}).alias("d")).select("lang", "d.*")
    listed = parsed.select("lang", F.size("itos").alias("vocab_size"), F.coalesce("unk", F.lit(DEFAULT_UNK)).alias("unk"), F.posexplode("itos").alias("id", "ch"))
    return listed.groupBy("lang", "ch", "vocab_size", "unk").agg(F.max("id").alias("id")).select("lang", "ch", "id", "vocab_size", "unk")


class Field(NamedTuple):
    """A field of the file: its type, that of its entries if it is a list, and its value where it is left out."""

    name: str
    kind: type
    entries: type | None = None
    default: str | None = None

    def faults(self, held: dict[str, object]) -> Iterator[Exception]:
        if self.name not in held:
            if self.default is None:
                yield KeyError(MISSING.format(self.name))
            return
        value = held[self.name]
        yield from mismatch(value, self.kind, f" for '{self.name}'")
        if self.entries and isinstance(value, self.kind):
            for place, entry in enumerate(value):
                yield from mismatch(entry, self.entries, f" at {self.name}[{place}]")


FIELDS = (Field("itos", list, str), Field("unk", str, default=DEFAULT_UNK))
#: How faults are worded.
MISSING = "Missing required key '{}'"
MISMATCH = "Expected {}{}, got {}"


def mismatch(value: object, kind: type, where: str = "") -> Iterator[Exception]:
    if not isinstance(value, kind):
        yield TypeError(MISMATCH.format(kind.__name__, where, type(value).__name__))


def faults(document: object) -> Iterator[Exception]:
    """Everything that keeps a parsed file from being a vocabulary, in the order of its fields."""
    if isinstance(document, dict):
        for field in FIELDS:
            yield from field.faults(document)
    else:
        yield from mismatch(document, dict)


def decode(document: object) -> tuple[list[str], str]:
    """Characters and unknown token of a parsed file; its first fault is raised."""
    for fault in faults(document):
        raise fault
    itos, unk = (document.get(f.name, f.default) for f in FIELDS)
    return itos, unk


def save(itos: dict[int, str], path: str | Path, unk: str = DEFAULT_UNK) -> None:
    """Write one vocabulary, and the folders above it; ids must be 0 to n - 1, else KeyError."""
    held = dict(zip((f.name for f in FIELDS), (list(map(itos.__getitem__, range(len(itos)))), unk), strict=True))
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    with open(path, "w", encoding="utf-8") as out:
        json.dump(held, out, ensure_ascii=False, indent=2)


def load(path: str | Path) -> tuple[dict[str, int], dict[int, str], int, str]:
    """Both maps, the size and the unknown token of one file."""
    with open(path, encoding="utf-8") as file:
        itos, unk = decode(json.load(file))
    by_id = dict(enumerate(itos))
    return {ch: i for i, ch in by_id.items()}, by_id, len(itos), unk
