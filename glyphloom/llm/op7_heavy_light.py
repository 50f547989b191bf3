"""N-gram Jaccard join, size-aware: subsets for small sets, inverted lists for large ones.

A document is the set of its five-word shingles. Documents with equal sets form a class, and one of them stands
for it. Two sets of sizes n and m link when they share ``need(n, m)`` shingles.

Light sets (up to a size that a cost estimate chooses) emit all their subsets of exactly the size that a partner
of each possible size needs; two sets that meet in a subset link without further ado. Heavy sets go to inverted
lists of their prefixes: the first shingles in a global order that leave too few others for a link. Shingles of
lines and passages that many texts share come last in that order, and so do those that still crowd the prefixes of a sample of
the documents; the others follow their hashes. Any order gives the same links, this one keeps lists short, however many
documents there are. Light sets that a heavy one may link to are in the lists too.

Long lists mostly belong to groups of near copies. They are first contracted: members are compared with one hub
of the list, and the components of the links found are what later rounds see, so that no pair within a
component is ever formed. At the end all pairs of different components that share a list, could have enough common
prefix shingles and aren't told apart by the parities of their shingles' last bits, are compared exactly.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glyphloom.llm import words
from glyphloom.llm.common import Scratch, table, thrifty
from glyphloom.llm.components import components

PERCENT = 80
FREQUENT = 16  # texts that share a line or passage before its shingles come last
SAMPLED = 16  # shingles with hashes divisible by this show where frequent passages are
AROUND = 48  # shingles to each side of one of these that come last with it
PASSAGES = 50_000  # such shingles at most
LINES = 20_000  # lines at most whose shingles come last: an order may leave any out
LATE = 2_000_000  # shingles at most that come last
BROADCAST_IDS = 500_000  # ids at most that are sent to every executor; more are joined by shuffle
DRAWN = 8  # documents with ids whose hashes are divisible by this show which shingles crowd the prefixes
CROWDED = 8  # drawn prefixes that hold a shingle before it comes last
PARITIES = 512  # bits of a set's parities
LONG = 24  # members of a list that is contracted first
ROUNDS = 5
LARGEST_LIGHT = 12
_SALT = np.uint64(0xA0761D6478BD642F)  # sets the second of two hashes apart


def need(n: int, m: int, percent: int = PERCENT) -> int:
    """Shingles that sets of sizes ``n`` and ``m`` must share: 100 * common >= percent * union."""
    return -(-percent * (n + m) // (100 + percent))


def prefix_length(n: int, percent: int = PERCENT) -> int:
    """Shingles of which a set shares one at least with any partner: all but as many as may be missing."""
    return n - -(-percent * n // 100) + 1


def partners(m: int, percent: int = PERCENT) -> range:
    """Sizes that a set of size ``m`` can link to."""
    return range(-(-percent * m // 100), 100 * m // percent + 1)


def subset_keys(m: int, largest: int, percent: int = PERCENT) -> int:
    """How many subsets a light set emits."""
    return sum(comb(m, need(m, n, percent)) for n in partners(m, percent) if n <= largest)


def _sets(texts: pa.Array) -> Iterator[np.ndarray]:
    for _, own in words.chunks(texts):
        for shingles in own.shingles():
            run = np.sort(shingles)  # np.unique takes three times as long
            yield run[np.concatenate([[True], run[1:] != run[:-1]])] if len(run) else run


class Members:
    """Which of many hashes are in a sorted set: a bit for their first bits rules out most others before the search.

    The search alone takes longer the larger the set is; the bits take 2 to 4 bytes a member.
    """

    def __init__(self, known: np.ndarray):
        width = max((16 * len(known)).bit_length(), 3)
        self.known, self.shift = known, np.uint64(64 - width)
        self.bits = np.zeros(1 << width - 3, dtype=np.uint8)
        if len(known):
            byte, bit = self._place(known)
            first = np.flatnonzero(np.concatenate([[True], byte[1:] != byte[:-1]]))
            self.bits[byte[first]] = np.bitwise_or.reduceat(np.uint8(1) << bit, first)

    def _place(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = (x >> self.shift).view(np.int64)
        return at >> 3, (at & 7).astype(np.uint8)

    def likely(self, x: np.ndarray) -> np.ndarray:
        """Positions of those that the bits don't rule out."""
        byte, bit = self._place(x)
        return np.flatnonzero(self.bits[byte] >> bit & np.uint8(1))

    def of(self, x: np.ndarray) -> np.ndarray:
        """For each hash whether it is a member."""
        hit = np.zeros(len(x), dtype=bool)
        at = self.likely(x)
        if len(at):
            few = x[at]
            hit[at] = self.known[np.minimum(np.searchsorted(self.known, few), len(self.known) - 1)] == few
        return hit


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


_DESCRIBED = "doc_id bigint, n int, s1 bigint, s2 bigint, some array<bigint>"


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Size and a 128-bit signature of each document's set, and its shingles with hashes of a fixed residue."""
    for batch in batches:
        n, one, two, some = [], [], [], []
        for own in _sets(batch.column(1)):
            n.append(len(own))
            some.append(_signed(own[own % np.uint64(SAMPLED) == 0]))
            one.append(own.sum(dtype=np.uint64))
            two.append(words.mix(own ^ _SALT).sum(dtype=np.uint64))
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0), pa.array(n, pa.int32()), *(pa.array(_signed(np.array(x, dtype=np.uint64))) for x in (one, two)),
                pa.array(some, pa.list_(pa.int64())),
            ],
            ["doc_id", "n", "s1", "s2", "some"],
        )


def passage_shingles(texts: DataFrame, sizes: DataFrame) -> np.ndarray:
    """Shingles of passages that many texts share, sorted.

    The numbers of texts are counted for all shingles of one hash residue, over all different sets; a passage of some
    length has one of these. Of the ``PASSAGES`` most frequent, one document each shows what stands around it.
    """
    hits = sizes.select("doc_id", F.explode("some").alias("shingle")).groupBy("shingle").agg(F.count(F.lit(1)).alias("c"), F.min("doc_id").alias("d"))
    top = hits.where(F.col("c") >= FREQUENT).orderBy(F.desc("c"), "shingle").limit(PASSAGES).select("shingle", "d").toPandas()
    known = np.sort(np.array(top["shingle"], dtype=np.int64).view(np.uint64))
    if not len(known):
        return known
    where = texts.sparkSession.createDataFrame(top[["d"]].drop_duplicates().astype("int64"), "doc_id bigint")

    def around(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        members = Members(known)
        for batch in batches:
            for _, own in words.chunks(batch.column(0)):
                for run in own.shingles():
                    hit = members.of(run)
                    if hit.any():
                        edge = np.zeros(len(run) + 1, dtype=np.int64)
                        at = np.flatnonzero(hit)
                        np.add.at(edge, np.maximum(at - AROUND, 0), 1)
                        np.add.at(edge, np.minimum(at + AROUND + 1, len(run)), -1)
                        yield pa.RecordBatch.from_arrays([pa.array(_signed(np.unique(run[np.cumsum(edge[:-1]) > 0])))], ["shingle"])

    shown = texts.join(F.broadcast(where), "doc_id", "left_semi").select("text").mapInArrow(thrifty(around), "shingle bigint")
    found = shown.distinct().limit(LATE).toPandas()["shingle"]
    return np.unique(np.concatenate([known, np.array(found, dtype=np.int64).view(np.uint64)]))


def late_shingles(texts: DataFrame, own: Scratch) -> np.ndarray:
    """Shingles of the lines that most texts share, sorted: at most ``LATE`` of at most ``LINES`` lines."""
    lines = texts.select("doc_id", F.explode(F.array_distinct(F.split("text", "\n"))).alias("line"))
    hashed = lines.where("length(line) > 8").select(F.xxhash64("line").alias("l"), "doc_id")
    often = hashed.groupBy("l").agg(F.count(F.lit(1)).alias("c"), F.min("doc_id").alias("d")).where(F.col("c") >= FREQUENT)
    top = own.table(often.orderBy(F.desc("c"), "l").limit(LINES), "lines")
    where = F.broadcast(top.select(F.col("d").alias("doc_id")).distinct())
    shown = texts.join(where, "doc_id", "left_semi").select(F.explode(F.array_distinct(F.split("text", "\n"))).alias("line"))
    shown = shown.select("line", F.xxhash64("line").alias("l")).join(F.broadcast(top.select("l", "c")), "l").dropDuplicates(["l"])

    def shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for count, own in zip(batch.column(0).to_pylist(), _sets(batch.column(1))):
                if len(own):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), count)), pa.array(_signed(own))], ["c", "shingle"])

    found = shown.select("c", "line").mapInArrow(thrifty(shingles), "c bigint, shingle bigint")
    most = found.groupBy("shingle").agg(F.max("c").alias("c")).orderBy(F.desc("c"), "shingle").limit(LATE)
    return np.sort(np.array(most.toPandas()["shingle"], dtype=np.int64).view(np.uint64))


def sketch(own: np.ndarray) -> bytes:
    """How many shingles of a set have each value of their first bits; empty if a number doesn't fit a byte."""
    bits = min(max((len(own) // 3).bit_length(), 4), 16)
    counts = np.bincount((own >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits)
    return counts.astype(np.uint8).tobytes() if counts.max(initial=0) < 256 else b""


def most_common(x: bytes, y: bytes) -> int | None:
    """At most so many shingles two sets share, by their sketches; None if these don't tell."""
    if not x or not y:
        return None
    a, b = (np.frombuffer(v, dtype=np.uint8).astype(np.int64) for v in (x, y))
    size = min(len(a), len(b))
    return int(np.minimum(a.reshape(size, -1).sum(axis=1), b.reshape(size, -1).sum(axis=1)).sum())


def parities(own: np.ndarray) -> np.ndarray:
    """Whether the number of shingles with each value of their last bits is odd, as 64-bit words.

    Two sets differ in at least as many shingles as their parities in bits.
    """
    odd = np.bincount((own % np.uint64(PARITIES)).astype(np.int64), minlength=PARITIES) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def prefixes(texts: DataFrame, late: np.ndarray, percent: int) -> DataFrame:
    """node, n, the prefix of each document's set as bytes, its sketch and its parities."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        members = Members(late)
        for batch in batches:
            n, out, sketches, odd = [], [], [], []
            for own in _sets(batch.column(1)):
                size = prefix_length(len(own), percent) if len(own) else 0
                sketches.append(sketch(own))
                odd.append(parities(own))
                if len(late) and len(own):
                    last = members.of(own)
                    own = np.concatenate([own[~last], own[last]]) if last.any() else own
                n.append(len(own))
                out.append(own[:size].tobytes())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), pa.array(n, pa.int32()), pa.array(out, pa.binary()), pa.array(sketches, pa.binary()),
                    pa.array(odd, pa.list_(pa.int64())),
                ],
                ["node", "n", "prefix", "sketch", "odd"],
            )

    return texts.select("doc_id", "text").mapInArrow(thrifty(run), "node bigint, n int, prefix binary, sketch binary, odd array<bigint>")


def _unfold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each shingle of a prefix."""
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            part = batch.slice(at, 512)
            sets = [np.frombuffer(x, dtype=np.int64) for x in part.column(2).to_pylist()]
            if sets:
                lengths = [len(x) for x in sets]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate(sets)),
                        pa.array(np.repeat(part.column(0).to_numpy(zero_copy_only=False), lengths)),
                        pa.array(np.repeat(part.column(1).to_numpy(zero_copy_only=False), lengths)),
                    ],
                    ["shingle", "node", "n"],
                )


def _entries(held: DataFrame) -> DataFrame:
    """shingle, node and n of each shingle of the prefixes."""
    return held.select("node", "n", "prefix").mapInArrow(thrifty(_unfold), "shingle bigint, node bigint, n int")


def thinned(texts: DataFrame, late: np.ndarray, percent: int, own: Scratch) -> DataFrame:
    """Prefixes in an order in which shingles that crowd the prefixes of drawn documents come last too.

    Only the drawn documents are read twice.
    """
    drawn = _entries(prefixes(texts.where(F.pmod(F.xxhash64("doc_id"), F.lit(DRAWN)) == 0), late, percent))
    known = F.count(F.lit(1)).alias("c")
    crowded = drawn.groupBy("shingle").agg(known).where(F.col("c") >= CROWDED).orderBy(F.desc("c"), "shingle").limit(LATE).select("shingle").toPandas()
    crowded = np.array(crowded["shingle"], dtype=np.int64).view(np.uint64)
    return own.table(prefixes(texts, np.union1d(late, crowded), percent), "prefixes")


def only(rows: DataFrame, ids: DataFrame, key: str, own: Scratch, how: str = "left_semi") -> DataFrame:
    """Rows whose ``key`` is (not) in the table ``ids``; a small one is broadcast, a larger one shuffled."""
    return rows.join(own.small(ids, F.col(key), most=BROADCAST_IDS), key, how)


def _paired(pairs: DataFrame, rows: DataFrame, value: str, own: Scratch) -> DataFrame:
    """a, b and both sides' n and ``value`` (as xn, yn, x, y) from ``rows`` (node, n, ``value``)."""
    ids = own.table(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "ids")
    chosen = only(rows.select("node", "n", value), ids, "node", own)
    left = chosen.select(F.col("node").alias("a"), F.col("n").alias("xn"), F.col(value).alias("x"))
    right = chosen.select(F.col("node").alias("b"), F.col("n").alias("yn"), F.col(value).alias("y"))
    return pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "xn", "yn", "x", "y")


def verified(texts: DataFrame, held: DataFrame, pairs: DataFrame, percent: int, own: Scratch) -> DataFrame:
    """The pairs (``a``, ``b``) whose sets link: those that sketches don't rule out are compared in full."""

    def links(x: int, y: int, common: int) -> bool:
        return 100 * common >= percent * (x + y - common)

    def plausible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, m, x, y = (batch.column(k).to_pylist() for k in range(2, 6))
            most = map(most_common, x, y)
            good = [c is None or links(i, j, c) for i, j, c in zip(n, m, most)]
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = list(_sets(batch.column(1)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(list(map(len, sets)), pa.int32()), pa.array([x.tobytes() for x in sets], pa.binary())], ["node", "n", "shingles"]
            )

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for x, y in zip(batch.column(4), batch.column(5)):
                x, y = (np.frombuffer(v.as_buffer(), dtype=np.uint64) for v in (x, y))
                at = np.minimum(np.searchsorted(y, x), len(y) - 1)
                good.append(links(len(x), len(y), int(np.count_nonzero(y[at] == x))))
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    left = own.table(_paired(pairs, held, "sketch", own).mapInArrow(thrifty(plausible), "a bigint, b bigint"), "plausible")
    ids = own.table(left.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), "ids")
    sets = own.table(only(texts, ids, "doc_id", own).mapInArrow(thrifty(whole), "node bigint, n int, shingles binary"), "sets")
    found = own.table(_paired(left, sets, "shingles", own).mapInArrow(thrifty(compare), "a bigint, b bigint"), "verified")
    own.drop(left, ids, sets)
    return found


def light_boundary(sizes: dict[int, int], list_length: float, percent: int) -> int:
    """The largest light size: where subsets cost no more rows than prefix entries and scans of their lists."""
    best, light, heavy = 0, 0.0, 0.0
    for size in range(1, LARGEST_LIGHT + 1):
        light += sizes.get(size, 0) * subset_keys(size, LARGEST_LIGHT, percent)
        heavy += sizes.get(size, 0) * prefix_length(size, percent) * (2 + list_length)
        if light <= heavy:
            best = size
    return best


def light_links(texts: DataFrame, nodes: DataFrame, largest: int, percent: int, own: Scratch) -> DataFrame:
    """Links between sets of at most ``largest`` shingles, each to the smallest node that it meets in a subset.

    A subset is known by two 64-bit hashes.
    """
    names = ["k1", "k2", "lo", "hi", "node", "m"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple[int, ...]] = []
            for node, found in zip(batch.column(0).to_pylist(), _sets(batch.column(1))):
                m = len(found)
                if not 0 < m <= largest:
                    continue
                both = list(zip(found.tolist(), words.mix(found ^ _SALT).tolist()))
                for n in partners(m, percent):
                    if n <= largest:
                        for part in combinations(both, need(m, n, percent)):
                            sums = np.array([sum(x) + (len(part) << 8) & (1 << 64) - 1 for x in zip(*part)], dtype=np.uint64)
                            rows.append((*words.mix(sums).view(np.int64).tolist(), min(m, n), max(m, n), node, m))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names)

    nodes = own.table(nodes, "light")
    keyed = own.table(only(texts, nodes, "doc_id", own).mapInArrow(thrifty(run), ", ".join(f"{x} bigint" for x in names)), "subsets")
    met = keyed.groupBy(*names[:4]).agg(F.min("node").alias("hub"), F.max("node").alias("top"), F.min("m").alias("m0"), F.max("m").alias("m1"))
    met = met.where("hub <> top and m0 = lo and m1 = hi").select(*names[:4], "hub")
    links = keyed.join(met, names[:4]).where("node <> hub").select(F.col("node").alias("a"), F.col("hub").alias("b")).distinct()
    return own.table(links, "links")


def _common_prefix(n: Column, m: Column, percent: int) -> Column:
    """Prefix shingles that sets of sizes n and m must share to link.

    What they share is in both prefixes, or in the part after the prefix that ends first.
    """
    rest = F.greatest(F.ceil(n * percent / 100), F.ceil(m * percent / 100)) - 1
    return F.ceil(percent * (n + m) / (100 + percent)) - rest


def _placed(long: DataFrame, labels: DataFrame, own: Scratch) -> DataFrame:
    """Entries of lists that still span several components, with their component (``comp``)."""
    known = long.join(labels, "node", "left").select("shingle", "node", "n", "e", "r", "l", F.coalesce("component", "node").alias("comp"))
    known = own.table(known, "known")
    open_lists = known.groupBy("shingle").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("shingle")
    placed = own.table(known.join(open_lists, "shingle", "left_semi"), "placed")
    own.drop(known)
    return placed


def contracted(texts: DataFrame, held: DataFrame, long: DataFrame, links: DataFrame, percent: int, own: Scratch) -> tuple[DataFrame, ...]:
    """Links found by comparing members of long lists with one hub each.

    Returns all links, the labels of their components, and the entries of lists that still span several components.
    Rounds with other hubs follow while at least half of what a round compares links, and there are ``ROUNDS`` at most;
    what is left is compared in full by the caller.
    """
    labels = components(links, own)
    placed = _placed(long, labels, own)
    for turn in range(ROUNDS):
        # The first hub is the set with the largest share of its prefix in lists: the middle of a group of near copies.
        middle = -F.col("e") / (F.col("n") - F.ceil(F.col("n") * percent / 100) + 1) if turn == 0 else F.lit(0.0)
        rank = F.struct(middle.alias("m"), F.xxhash64("node", F.lit(turn)).alias("r"), F.col("node"), F.col("n"), F.col("comp"), F.col("e"))
        hubs = placed.groupBy("shingle").agg(F.min(rank).alias("hub"))
        near = placed.join(hubs, "shingle").where(
            (F.col("comp") != F.col("hub.comp")) & (F.least("n", "hub.n") * 100 >= F.greatest("n", "hub.n") * percent)
            & (F.least("e", "hub.e") >= _common_prefix(F.col("n"), F.col("hub.n"), percent))
        )
        best = near.groupBy("node", F.col("hub.node").alias("b")).agg(F.count(F.lit(1)).alias("k"))
        best = best.groupBy("node").agg(F.max_by("b", F.struct("k", "b")).alias("b"))
        pairs = own.table(best.select(F.col("node").alias("a"), "b"), "pairs")
        compared = own.seen(pairs)["rows"]
        if not compared:
            break
        found = verified(texts, held, pairs, percent, own)
        links = own.table(links.unionByName(found), "links")
        own.drop(pairs, labels, placed)
        labels = components(links, own)
        placed = _placed(long, labels, own)
        if 2 * own.seen(found)["rows"] < compared:
            break
    return links, labels, placed


def _across(placed: DataFrame, held: DataFrame, largest: int, percent: int, own: Scratch) -> DataFrame:
    """Pairs of different components that share a long list and could share enough shingles.

    A pair whose parities (``odd`` of ``held``) differ in more bits than a link leaves different shingles is never formed. Of two components that meet in a list at most one is the list's largest, so the other's members are enough on one side.
    """
    ids = own.table(placed.select("node").distinct(), "ids")
    placed = own.table(placed.join(only(held.select("node", "odd"), ids, "node", own), "node"), "placed")
    largest_part = placed.groupBy("shingle", "comp").agg(F.count(F.lit(1)).alias("k")).groupBy("shingle").agg(F.max_by("comp", F.struct("k", "comp")).alias("big"))
    minor = placed.join(largest_part, "shingle").where("comp <> big")
    sides = {
        end: rows.select("shingle", F.col("comp").alias(part), F.col("node").alias(end), *(F.col(c).alias(f"{c}{end}") for c in ("n", "e", "r", "l", "odd")))
        for rows, part, end in ((minor, "p", "a"), (placed, "q", "b"))
    }
    least = _common_prefix(F.col("na"), F.col("nb"), percent)
    # Of the entries that both have in long lists at least ``most`` must agree, so the first that agrees comes early in both.
    most = F.greatest(least - F.least(F.col("ea") - F.col("la"), F.col("eb") - F.col("lb")), F.lit(1))
    early = (F.col("ra") <= F.col("la") - most + 1) & (F.col("rb") <= F.col("lb") - most + 1)
    fits = _fits(largest, percent) & (F.least("ea", "eb") >= least)
    apart = sum((F.bit_count(F.col("odda")[k].bitwiseXOR(F.col("oddb")[k])) for k in range(PARITIES // 64)), F.lit(0))
    near = apart <= F.col("na") + F.col("nb") - 2 * F.ceil(percent * (F.col("na") + F.col("nb")) / (100 + percent))
    pairs = sides["a"].join(sides["b"], "shingle").where("p <> q").where(fits & early & near)
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _within(short: DataFrame, long: DataFrame, largest: int, percent: int, own: Scratch) -> DataFrame:
    """Pairs that share a short list and could share enough shingles."""
    na, nb = F.col("na"), F.col("nb")
    shared = (
        short.select("shingle", F.col("node").alias("a"), F.col("n").alias("na"))
        .join(short.select("shingle", F.col("node").alias("b"), F.col("n").alias("nb")), "shingle").where("a < b").where(_fits(largest, percent))
        .groupBy("a", "b", "na", "nb").agg(F.count(F.lit(1)).alias("k"))
    )
    in_long = own.table(long.where("r = 1").select("node", "l"), "in-long")
    in_long = own.small(in_long, most=BROADCAST_IDS)
    for end in ("a", "b"):
        shared = shared.join(in_long.select(F.col("node").alias(end), F.col("l").alias(f"l{end}")), end, "left")
    common = F.col("k") + F.least(F.coalesce("la", F.lit(0)), F.coalesce("lb", F.lit(0)))
    return shared.where(common >= _common_prefix(na, nb, percent)).select("a", "b")


def _fits(largest: int, percent: int) -> Column:
    """Sizes that can link, and aren't both light."""
    na, nb = F.col("na"), F.col("nb")
    return (F.least(na, nb) * 100 >= F.greatest(na, nb) * percent) & (F.greatest(na, nb) > largest)


def class_links(texts: DataFrame, sizes: DataFrame, percent: int, own: Scratch) -> DataFrame:
    """Links, enough for all components, between documents with different sets.

    ``texts`` (doc_id, text) has each id once, ``sizes`` (doc_id, n, some) the same documents.
    """
    late = np.union1d(late_shingles(texts, own), passage_shingles(texts, sizes))
    held = thinned(texts, late, percent, own)
    entries = _entries(held)
    counts = entries.groupBy("shingle").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    lists = own.table(entries.join(counts, "shingle").select("shingle", "node", "n", "c"), "lists", F.avg("c").alias("mean"))

    small = {r["n"]: r["k"] for r in held.where(F.col("n") <= LARGEST_LIGHT).groupBy("n").agg(F.count(F.lit(1)).alias("k")).collect()}
    mean = own.seen(lists)["mean"] or 0.0
    largest = light_boundary(small, mean, percent)
    links = light_links(texts, held.where(F.col("n") <= largest).select(F.col("node").alias("doc_id")), largest, percent, own)

    if largest:
        lists = lists.where(F.col("n") >= percent * (largest + 1) // 100)
    # No pair shares more prefix shingles than one of its sets has in lists at all.
    degrees = lists.groupBy("node").agg(F.count(F.lit(1)).alias("e"))
    long = lists.where(F.col("c") > LONG).drop("c").join(degrees, "node")
    by_node = Window.partitionBy("node")
    long = long.withColumn("r", F.row_number().over(by_node.orderBy("shingle"))).withColumn("l", F.count(F.lit(1)).over(by_node))
    long = own.table(long.select("shingle", "node", "n", "e", "r", "l"), "long")
    links, labels, placed = contracted(texts, held, long, links, percent, own)
    pairs = _within(lists.where(F.col("c") <= LONG), long, largest, percent, own).unionByName(_across(placed, held, largest, percent, own)).distinct()
    for end in ("a", "b"):
        pairs = pairs.join(labels.select(F.col("node").alias(end), F.col("component").alias(f"of_{end}")), end, "left")
    pairs = own.table(pairs.where("of_a is null or of_b is null or of_a <> of_b").select("a", "b"), "pairs")
    return links.unionByName(verified(texts, held, pairs, percent, own))


def _linked_rows(docs: DataFrame, percent: int, own: Scratch) -> DataFrame:
    """doc_id, n, component of all rows of ``docs`` (doc_id, text); an id comes once, or not at all (null)."""
    sizes = own.table(docs.mapInArrow(thrifty(_describe), _DESCRIBED), "sizes")
    full = sizes.where("n > 0 and doc_id is not null")
    classes = full.groupBy("n", "s1", "s2").agg(F.min("doc_id").alias("node"), F.count(F.lit(1)).alias("k"))
    members = full.select("doc_id", "n", "s1", "s2").join(own.table(classes.where("k > 1"), "classes"), ["n", "s1", "s2"], "left")
    members = members.select("doc_id", "n", F.coalesce("node", "doc_id").alias("node"))
    members = own.table(members.unionByName(sizes.where("n = 0 or doc_id is null").select("doc_id", "n", F.col("doc_id").alias("node"))), "members")
    copies = own.table(members.where("doc_id <> node or n = 0").select("doc_id"), "copies")
    texts = only(docs.where("doc_id is not null"), copies, "doc_id", own, "left_anti")
    single = only(full.select("doc_id", "n", "some"), copies, "doc_id", own, "left_anti")
    labels = components(class_links(texts, single, percent, own), own)
    return members.join(labels, "node", "left").select("doc_id", "n", F.coalesce("component", "node").alias("component"))


def linked(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Every document with the size of its shingle set and its component of links.

    Columns: doc_id, n_shingles, component_id (smallest doc_id reachable by links, itself included). Null and
    empty texts have no shingles and are components of their own. Rows that share a doc_id count as one document
    when links are followed, and each is returned with its own size; a null doc_id is never linked and has a null
    component. An empty table gives no rows. Columns other than doc_id and text are ignored.
    """
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    with Scratch(docs.sparkSession) as own:
        named = docs.where("doc_id is not null").select("doc_id")
        if (named.groupBy("doc_id").agg(F.count(F.lit(1)).alias("k")).agg(F.max("k")).first()[0] or 0) <= 1:
            out = _linked_rows(docs, percent, own)
        else:
            # Each different row is known by a number of its own, and linked to the first row of its id.
            rows = docs.where("doc_id is not null").groupBy("doc_id", "text").agg(F.count(F.lit(1)).alias("k"))
            rows = own.table(rows.select(F.monotonically_increasing_id().alias("row"), "*"), "rows")
            found = own.table(_linked_rows(rows.select(F.col("row").alias("doc_id"), "text"), percent, own), "found")
            found = found.join(rows.select(F.col("row").alias("doc_id"), F.col("doc_id").alias("id"), "k"), "doc_id")
            found = own.table(found.select("id", "n", "component", "k"), "found")
            # Ids in one component are linked to its smallest id.
            hubs = found.groupBy("component").agg(F.min("id").alias("b"))
            joined = components(found.join(hubs, "component").select(F.col("id").alias("a"), "b"), own)
            each = found.select(F.col("id").alias("node"), "n", F.explode(F.sequence(F.lit(1), F.col("k"))))
            out = each.join(joined, "node", "left").select(F.col("node").alias("doc_id"), "n", F.coalesce("component", "node").alias("component"))
            unnamed = docs.where("doc_id is null").mapInArrow(thrifty(_describe), _DESCRIBED)
            out = out.unionByName(unnamed.select("doc_id", "n", F.col("doc_id").alias("component")))
        return own.keep(own.table(out.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.col("component").alias("component_id")), "linked"))


def op7_heavy_light(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH RECURSIVE worded AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[ \t\n\x0B\x0C\r]+'), lambda x: x <> '') AS w FROM documents
), sets AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM worded
), sizes AS (SELECT doc_id, len(s) AS n FROM sets
), tokens AS (SELECT doc_id, unnest(s) AS t FROM sets
), common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM tokens a JOIN tokens b ON a.t = b.t AND a.doc_id <> b.doc_id GROUP BY ALL
), links AS (SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)
), reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT doc_id, n AS n_shingles, least(doc_id, coalesce(m, doc_id)) AS component_id FROM sizes LEFT JOIN (SELECT a, min(b) AS m FROM reach GROUP BY a) ON a = doc_id
"""
