"""Queries of the operators in this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline

from glyphloom.llm import op4_hnsw as vectors
from glyphloom.llm import op7_heavy_light as shingles
from glyphloom.llm import op10_line_join as lines
from glyphloom.llm.op1_ordinal import op1_ordinal
from glyphloom.llm.op2_bin_completion import op2_bin_completion
from glyphloom.llm.op3_lpt_shards import op3_lpt_shards
from glyphloom.llm.op5_ogg import op5_ogg
from glyphloom.llm.op6_monoid_bpe import op6_monoid_bpe
from glyphloom.llm.op8_wrapper import op8_wrapper
from glyphloom.llm.op9_packed_ids import op9_packed_ids

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    found = [op1_ordinal, op2_bin_completion, op3_lpt_shards, vectors.op4_hnsw, op5_ogg, op6_monoid_bpe, shingles.op7_heavy_light, op8_wrapper, op9_packed_ids, lines.op10_line_join]
    return {f.__name__: f for f in found} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    known = {"op4_hnsw": vectors.ORACLE, "op7_heavy_light": shingles.ORACLE, "op10_line_join": lines.ORACLE, "pipeline": corpus_pipeline.ORACLE_SQL}
    return {name: sql for name, sql in known.items() if sql}
