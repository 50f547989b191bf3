"""Sharding by longest-processing-time scheduling.

Documents with equal texts form a group and stay together. Groups go, largest first, to the shard that is
least loaded, which a heap yields. The schedule is made on the histogram of group sizes: groups of one size
are interchangeable, so the heap hands out counts, and each group takes its place by its rank among the groups
of its size. The histogram has at most sqrt(2 * total bytes) entries, since distinct sizes add up to no more
than the total; only it reaches the driver.
"""

from __future__ import annotations

import heapq

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphloom.llm.common import materialise, rank_within, table, utf8

SHARDS = 8


def schedule(sizes: np.ndarray, counts: np.ndarray, shards: int) -> list[tuple[int, int, int, int]]:
    """Runs (size, first rank, rank after the last, shard) of LPT over ``counts[i]`` groups of ``sizes[i]``.

    Ties between equally loaded shards go to the lower number. Whole rounds, in which each shard would get
    one group, are handed out at once while the loads differ by less than the size.
    """
    heap = [(0, k) for k in range(shards)]
    runs: list[tuple[int, int, int, int]] = []
    for i in np.argsort(-sizes, kind="stable").tolist():
        size, left = int(sizes[i]), int(counts[i])
        got = [0] * shards
        while left:
            low, high = heap[0][0], max(heap)[0]
            if high - low <= size and left >= shards:
                rounds = left // shards
                heap = [(load + rounds * size, k) for load, k in heap]
                got = [g + rounds for g in got]
                left -= rounds * shards
            else:
                load, k = heap[0]
                # The least loaded shard takes groups until it passes the next one.
                nearest = min(heap[1:3])[0] if shards > 1 else load
                now = min(left, max(1, (nearest - load) // size))
                heapq.heapreplace(heap, (load + now * size, k))
                got[k] += now
                left -= now
        at = 0
        for k, n in enumerate(got):
            if n:
                runs.append((size, at, at + n, k))
                at += n
    return runs


def shard(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """Every document (``doc_id``, ``text``) with the shard that its group of equal texts got, and its slot there.

    Columns: doc_id, size (UTF-8 bytes plus 1; a null text has 1 and groups with empty texts), text_crc32, law
    'bytes', shard, slot (gapless from 0 in each shard), grown_shard (null). Null or repeated ids and repeated
    rows are kept; an empty table gives no rows.
    """
    raw = utf8("text")
    narrow = materialise(
        docs.select(
            F.col("doc_id").cast("long"),
            (F.octet_length(raw).cast("long") + 1).alias("size"),
            F.crc32(raw).alias("text_crc32"),
            F.xxhash64(raw).alias("text_hash"),
        ),
        "sizes",
    )
    group = ["text_hash", "text_crc32", "size"]
    groups = narrow.groupBy(*group).agg(F.sum("size").alias("bytes"))
    ranked = materialise(rank_within(groups, ["bytes"], group, narrow.count(), "rank"), "groups")
    found = np.array(ranked.groupBy("bytes").agg(F.count(F.lit(1)).alias("n")).toPandas(), dtype=np.int64).reshape(-1, 2)
    runs = schedule(found[:, 0], found[:, 1], shards)
    key = np.array([(s, a) for s, a, _, _ in runs], dtype=[("size", "<i8"), ("rank", "<i8")])
    to = np.array([k for *_, k in runs], dtype=np.int32)
    order = np.argsort(key, order=["size", "rank"])
    key, to = key[order], to[order]

    def placed(batches):
        import pyarrow as pa

        # Runs of one size are few; positions are found first by size, then by rank among that size's runs.
        for batch in batches:
            size, rank = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("bytes", "rank"))
            at = np.searchsorted(key["size"], size, side="left")
            while True:
                more = at + 1 < len(key)
                nxt = np.minimum(at + 1, len(key) - 1)
                step = more & (key["size"][nxt] == size) & (key["rank"][nxt] <= rank)
                if not step.any():
                    break
                at = np.where(step, nxt, at)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in group), pa.array(to[at] if len(to) else np.zeros(0, np.int32))], [*group, "shard"]
            )

    shards_of = materialise(ranked.mapInArrow(placed, "text_hash bigint, text_crc32 bigint, size bigint, shard int"), "shards")
    spread = materialise(narrow.join(shards_of, group), "spread")
    out = rank_within(spread, ["shard"], ["text_hash", "doc_id"], narrow.count(), "slot")
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op3_lpt_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents"))
