"""Embedding near-dedup by hierarchical navigable small-world graphs.

Vectors are dealt to shards by a hash of their id. Each shard's graph is built in one task, and every vector queries
every shard. A beam search that ends with links at its worst place is widened until it doesn't, so a crowd of
near copies is found in full. Queries drawn by hash are audited against all vectors of the shard; if links are
missing, the beam is widened for all queries and the shard is searched again. Each pair is decided by its
cosine in double precision. Links become components without any list of pairs: a query reports one vector of each of
the shard's own components that it links to.
"""

from __future__ import annotations

import pickle

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphloom.llm.common import Scratch, settings, table
from glyphloom.llm.components import components

COSINE = 0.9
SHARDS = 8  # at least; more so that a shard holds about SHARD_NUMBERS components of vectors, whatever their length
SHARD_NUMBERS = 6_400_000
QUERY_NUMBERS = 1 << 21  # components of the queries that go to a shard in one row; a shard's graph is sent once for each such row
BLOCK = 2_048  # queries searched together
GATHERED = 1 << 22  # components of neighbours that are gathered at a time when lists are selected anew
#: A row with a graph or a block of queries has a file of its own, so that a reader never holds several of them.
_APART = {"spark.sql.files.maxRecordsPerFile": "1"}
LINKS = 12  # neighbours kept on upper layers, twice as many at the bottom
BUILD_BEAM = 48
BEAM = 32
AUDITED = 64  # queries of a block or shard that are checked at a time against all vectors of a shard
AUDITED_LINKS = 64  # links to other ids that an audit checks, unless the queries have fewer
RECALL = 0.995


class Graph:
    """A hierarchical navigable small-world graph over unit vectors; many queries are searched in step."""

    def __init__(self, vectors: np.ndarray, seed: int = 7):
        self.vectors = np.ascontiguousarray(vectors, dtype=np.float32)
        n = len(vectors)
        rng = np.random.default_rng(seed)
        levels = np.minimum((-np.log(rng.random(n) + 1e-12) / np.log(LINKS)).astype(np.int64), 6)
        self.top = int(levels.max(initial=0))
        self.layers = [np.full((n, LINKS * (2 if k == 0 else 1)), -1, dtype=np.int32) for k in range(self.top + 1)]
        self.members = [np.flatnonzero(levels >= k) for k in range(self.top + 1)]
        order = np.argsort(-levels, kind="stable")
        self.entry = int(order[0]) if n else -1
        self.levels = levels
        done = 1
        while done < n:
            batch = order[done : done + max(1, min(512, done // 2))]
            self._insert(batch)
            done += len(batch)

    def __getstate__(self) -> dict:
        """Without the vectors, which whoever reads the graph has, and without rows of upper layers for vectors that aren't there."""
        return {**self.__dict__, "vectors": None, "layers": [layer[m] for layer, m in zip(self.layers, self.members)]}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        for k, own in enumerate(self.layers):
            self.layers[k] = np.full((len(self.levels), own.shape[1]), -1, dtype=np.int32)
            self.layers[k][self.members[k]] = own

    def _insert(self, batch: np.ndarray) -> None:
        """Add vectors: search the graph so far, and the batch itself, for neighbours on each layer."""
        queries = self.vectors[batch]
        among = queries @ queries.T
        np.fill_diagonal(among, -2)
        entry = np.full(len(batch), self.entry, dtype=np.int64)
        for layer in range(self.top, -1, -1):
            here = self.levels[batch] >= layer
            found, near = self.search_layer(queries, entry[:, None], layer, BUILD_BEAM if here.any() else 1)
            entry = np.where(found[:, 0] >= 0, found[:, 0], entry)
            rows = np.flatnonzero(here)
            if not len(rows):
                continue
            fellows = among[np.ix_(rows, rows)]
            k = min(len(rows), LINKS)
            best = np.argpartition(-fellows, k - 1, axis=1)[:, :k]
            ids = np.concatenate([found[rows], batch[rows][best]], axis=1)
            sims = np.concatenate([near[rows], np.take_along_axis(fellows, best, axis=1)], axis=1)
            ids[sims < -1.5] = -1
            chosen = self._select(ids, sims, self.layers[layer].shape[1] // 2)
            self.layers[layer][batch[rows], : chosen.shape[1]] = chosen
            self._link_back(layer, batch[rows], chosen)

    def _select(self, ids: np.ndarray, sims: np.ndarray, most: int) -> np.ndarray:
        """Neighbours by similarity, but none closer to one already taken than to the vector itself; then the nearest others."""
        order = np.argsort(-sims, axis=1, kind="stable")[:, : 3 * most]
        ids, sims = np.take_along_axis(ids, order, axis=1), np.take_along_axis(sims, order, axis=1)
        valid = ids >= 0
        valid[:, 1:] &= ids[:, 1:] != ids[:, :-1]
        vectors = self.vectors[np.maximum(ids, 0)]
        mutual = np.matmul(vectors, vectors.transpose(0, 2, 1))
        taken = np.zeros(ids.shape, dtype=bool)
        for j in range(ids.shape[1]):
            hidden = (taken[:, :j] & (mutual[:, j, :j] > sims[:, j, None])).any(axis=1)
            taken[:, j] = valid[:, j] & ~hidden & (taken[:, :j].sum(axis=1) < most)
        rank = np.where(taken, 0, np.where(valid, 1, 2)) * ids.shape[1] + np.arange(ids.shape[1])
        keep = np.argsort(rank, axis=1)[:, :most]
        out = np.take_along_axis(ids, keep, axis=1)
        out[~np.take_along_axis(valid, keep, axis=1)] = -1
        return out

    def _link_back(self, layer: int, sources: np.ndarray, chosen: np.ndarray) -> None:
        """Let the chosen neighbours know; a full list is selected anew."""
        table = self.layers[layer]
        ok = chosen >= 0
        target, source = chosen[ok].astype(np.int64), np.repeat(sources, ok.sum(axis=1))
        order = np.argsort(target, kind="stable")
        target, source = target[order], source[order]
        heads, starts, counts = np.unique(target, return_index=True, return_counts=True)
        width = int(min(counts.max(initial=0), 4 * table.shape[1]))
        fresh = np.full((len(heads), width), -1, dtype=np.int64)
        slot = np.arange(len(target)) - np.repeat(starts, counts)
        own = slot < width
        fresh[np.repeat(np.arange(len(heads)), counts)[own], slot[own]] = source[own]
        all_ids = np.concatenate([table[heads].astype(np.int64), fresh], axis=1)
        step = max(1, GATHERED // (all_ids.shape[1] * self.vectors.shape[1]))
        for at in range(0, len(heads), step):
            own_heads, ids = heads[at : at + step], all_ids[at : at + step]
            sims = np.einsum("ijk,ik->ij", self.vectors[np.maximum(ids, 0)], self.vectors[own_heads])
            sims[ids < 0] = -2
            table[own_heads] = self._select(ids, sims, table.shape[1])

    def search_layer(self, queries: np.ndarray, entries: np.ndarray, layer: int, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """The best ``beam`` vectors found for each query, with similarities, nearest first; -1 and -2 where there are fewer."""
        table, n, q = self.layers[layer], len(self.vectors), len(queries)
        seen = np.zeros((q, n), dtype=bool)
        rows = np.arange(q)
        ids = np.full((q, beam), -1, dtype=np.int64)
        sims = np.full((q, beam), -2, dtype=np.float32)
        spent = np.zeros((q, beam), dtype=bool)
        k = min(entries.shape[1], beam)
        ids[:, :k] = entries[:, :k]
        sims[:, :k] = np.einsum("ijk,ik->ij", self.vectors[np.maximum(ids[:, :k], 0)], queries)
        sims[ids < 0] = -2
        seen[rows[:, None], np.maximum(ids[:, :k], 0)] = True
        active = rows
        while len(active):
            open_sims = np.where(spent[active] | (ids[active] < 0), -3, sims[active])
            best = open_sims.argmax(axis=1)
            going = open_sims[np.arange(len(active)), best] > -3
            active, best = active[going], best[going]
            if not len(active):
                break
            spent[active, best] = True
            near = table[ids[active, best]].astype(np.int64)
            fresh = near >= 0
            safe = np.maximum(near, 0)
            fresh &= ~seen[active[:, None], safe]
            seen[active[:, None], safe] |= near >= 0
            some = fresh.any(axis=1)
            rows_on, near, fresh = active[some], safe[some], fresh[some]
            if not len(rows_on):
                continue
            new = np.einsum("ijk,ik->ij", self.vectors[near], queries[rows_on])
            new[~fresh] = -2
            every = np.concatenate([sims[rows_on], new], axis=1)
            order = np.argsort(-every, axis=1, kind="stable")[:, :beam]
            sims[rows_on] = np.take_along_axis(every, order, axis=1)
            ids[rows_on] = np.take_along_axis(np.concatenate([ids[rows_on], np.where(fresh, near, -1)], axis=1), order, axis=1)
            spent[rows_on] = np.take_along_axis(np.concatenate([spent[rows_on], np.zeros(new.shape, dtype=bool)], axis=1), order, axis=1)
        return ids, sims

    def search(self, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        entry = np.full((len(queries), 1), self.entry, dtype=np.int64)
        for layer in range(self.top, 0, -1):
            found, _ = self.search_layer(queries, entry, layer, 4)
            entry = np.where(found >= 0, found, entry[:, :1])
        return self.search_layer(queries, entry, 0, beam)

    def linked(self, queries: np.ndarray, least: float, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """(query, vector) pairs found with at least about ``least``; a beam whose worst place links is doubled."""
        found: list[tuple[np.ndarray, np.ndarray]] = []
        todo = np.arange(len(queries))
        while len(todo):
            width = min(beam, len(self.vectors))
            step = max(1, (64 << 20) // (len(self.vectors) + width * 64))
            wider = []
            for at in range(0, len(todo), step):
                own = todo[at : at + step]
                ids, sims = self.search(queries[own], width)
                full = (sims[:, -1] >= least) & (width < len(self.vectors))
                wider.append(own[full])
                i, j = np.nonzero((sims >= least) & (ids >= 0) & ~full[:, None])
                found.append((own[i], ids[i, j]))
            todo = np.concatenate(wider)
            beam *= 2
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate([a for a, _ in found]), np.concatenate([b for _, b in found])


def shard_components(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest member of each of ``n`` places' component."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def audited_pairs(
    graph: Graph, units: np.ndarray, ids: np.ndarray, queries: np.ndarray, query_ids: np.ndarray, least: float, beam: int
) -> tuple[np.ndarray, np.ndarray, int]:
    """Pairs (query, vector) with a cosine of at least ``least``, and the beam that the audit found wide enough.

    Queries in the order of a hash of their id, ``AUDITED`` at a time and ``BLOCK`` at most, are compared with every
    vector until ``AUDITED_LINKS`` links to other ids are known; the beam is doubled until the graph finds nearly all
    of these. Misses of queries that aren't compared are not repaired. Every pair is decided in double precision; an id doesn't link to itself.
    """
    mixed = query_ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    order = np.argsort(mixed >> np.uint64(20), kind="stable")[:BLOCK]
    truth, known = [], 0
    while beam < len(units) and known < AUDITED_LINKS and len(truth) * AUDITED < len(order):
        own = order[len(truth) * AUDITED : (len(truth) + 1) * AUDITED]
        i, j = np.nonzero((queries[own] @ units.T) >= least)
        other = query_ids[own[i]] != ids[j]
        truth.append(own[i[other]] * len(units) + j[other])
        known += int(other.sum())
    wanted = np.concatenate([np.zeros(0, np.int64), *truth])
    chosen = np.unique(wanted // len(units))  # queries without a link can't miss one
    narrow, loose = queries.astype(np.float32), least - 1e-4
    while beam < len(units) and known:
        i, j = graph.linked(narrow[chosen], loose, beam)
        if np.isin(wanted, chosen[i] * len(units) + j).sum() >= RECALL * known:
            break
        beam *= 2
    q, v = graph.linked(narrow, loose, beam)
    other = query_ids[q] != ids[v]
    q, v = np.divmod(np.unique(q[other] * len(units) + v[other]), len(units))
    good = [np.einsum("ij,ij->i", queries[q[i : i + 32768]], units[v[i : i + 32768]]) >= least for i in range(0, len(q), 32768)]
    good = np.concatenate(good) if good else np.zeros(0, dtype=bool)
    return q[good], v[good], beam


def _numbers(rows: pd.Series) -> np.ndarray:
    """Vectors as they are, in single precision if that holds every number exactly: half as much to send."""
    x = np.array(rows.tolist(), dtype=np.float64)
    with np.errstate(over="ignore"):
        short = x.astype(np.float32)
    return short if (short == x).all() else x


def _units(numbers: np.ndarray) -> np.ndarray:
    """Unit vectors in double precision."""
    x = numbers.astype(np.float64)
    x /= np.maximum(x.max(axis=1), -x.min(axis=1))[:, None]
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    return x


def _build(group: pd.DataFrame, least: float) -> pd.DataFrame:
    """One shard: its graph, the smallest member of each vector's component within the shard, and the beam."""
    group = group.sort_values("rep", kind="stable")
    ids, numbers = group["rep"].to_numpy(dtype=np.int64), _numbers(group["embedding"])
    units = _units(numbers)
    graph = Graph(units)
    q, v, beam = audited_pairs(graph, units, ids, units, ids, least, BEAM)
    root = ids[shard_components(len(ids), q, v)]
    state = pickle.dumps((graph, numbers, ids, group["w"].to_numpy(dtype=np.int64), root, beam))
    own = root != ids
    return pd.DataFrame(
        {"dim": [group["dim"].iat[0]], "shard": [group["shard"].iat[0]], "state": [state], "a": [ids[own].tolist()], "b": [root[own].tolist()]}
    )


def _pack(group: pd.DataFrame) -> pd.DataFrame:
    packed = pickle.dumps((group["rep"].to_numpy(dtype=np.int64), _numbers(group["embedding"])))
    return pd.DataFrame({"dim": [group["dim"].iat[0]], "block": [group["block"].iat[0]], "queries": [packed]})


def _search(left: pd.DataFrame, right: pd.DataFrame, least: float) -> pd.DataFrame:
    """A block's links into one shard: counts as rows (a, a, n), and (a, b, 0) for each component of the shard met."""
    if left.empty or right.empty:
        return pd.DataFrame({"a": [], "b": [], "n": []})
    query_ids, queries = pickle.loads(left["queries"].iat[0])
    graph, numbers, ids, weights, root, beam = pickle.loads(right["state"].iat[0])
    units = _units(numbers)
    graph.vectors = units.astype(np.float32)
    parts = []
    for at in range(0, len(queries), BLOCK):
        own_ids = query_ids[at : at + BLOCK]
        q, v, _ = audited_pairs(graph, units, ids, _units(queries[at : at + BLOCK]), own_ids, least, beam)
        n = np.bincount(q, weights[v], minlength=len(own_ids)).astype(np.int64)
        met = np.unique(np.stack([own_ids[q], root[v]]), axis=1)
        some = n > 0
        a, b = (np.concatenate([own_ids[some], met[k]]) for k in range(2))
        parts.append(pd.DataFrame({"a": a, "b": b, "n": np.concatenate([n[some], np.zeros(met.shape[1], np.int64)])}))
    return pd.concat(parts)


def linked(vectors: DataFrame, least: float = COSINE, shards: int = SHARDS) -> DataFrame:
    """Every vector (``vec_id``, ``embedding``; other columns are ignored) with its links and component.

    Columns: vec_id, n_links (other vectors with a cosine of ``least`` or more), component_id (smallest vec_id
    reachable by links, itself included), kept. Vectors that are null, empty or zero, or hold null or non-finite
    numbers, link with nothing, and vectors of different lengths don't link. Equal vectors are searched once. Rows
    that share a vec_id count as one vector, the largest valid one; a null vec_id is never linked and not kept. An
    empty table gives no rows.
    """
    with Scratch(vectors.sparkSession) as own:
        return own.keep(own.table(_linked(vectors, least, shards, own), "linked"))


def _linked(vectors: DataFrame, least: float, shards: int, own: Scratch) -> DataFrame:
    rows = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>"))
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    valid = rows.where("vec_id is not null and size(embedding) > 0").where(~bad & F.exists("embedding", lambda x: x != 0))
    single = own.table(valid.groupBy("vec_id").agg(F.max("embedding").alias("embedding")), "vectors")
    classes = single.groupBy("embedding").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("w"))
    classes = own.table(classes.withColumn("dim", F.size("embedding")), "classes")
    members = own.table(single.join(classes.select("embedding", "rep", "w"), "embedding").select("vec_id", "rep", "w"), "members")
    own.drop(single)
    numbers = classes.agg(F.sum("dim")).first()[0] or 0
    count, blocks = max(shards, -(-numbers // SHARD_NUMBERS)), max(1, -(-numbers // QUERY_NUMBERS))

    dealt = classes.withColumn("shard", F.pmod(F.xxhash64("rep"), F.lit(count)).cast("int"))
    graphs = dealt.groupBy("dim", "shard").applyInPandas(
        lambda g: _build(g, least), "dim int, shard int, state binary, a array<bigint>, b array<bigint>"
    )
    with settings(classes.sparkSession, _APART):
        graphs = own.table(graphs, "graphs")
    packed = classes.withColumn("block", F.pmod(F.xxhash64("rep", F.lit(1)), F.lit(blocks)).cast("int"))
    with settings(classes.sparkSession, _APART):
        packed = own.table(packed.groupBy("dim", "block").applyInPandas(_pack, "dim int, block int, queries binary"), "blocks")
    left = packed.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(count - 1))))
    right = graphs.select("dim", "shard", "state", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    key = ["dim", "shard", "block"]
    found = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInPandas(lambda x, y: _search(x, y, least), "a bigint, b bigint, n bigint")
    found = own.table(found, "found")

    counts = found.where("n > 0").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("n"))
    inside = graphs.select(F.explode(F.arrays_zip("a", "b")).alias("x")).select("x.a", "x.b")
    labels = components(found.where("n = 0").select("a", "b").unionByName(inside), own).withColumnRenamed("node", "rep")
    known = members.join(counts, "rep", "left").join(labels, "rep", "left")
    known = known.select(
        F.col("vec_id").alias("_id"), (F.coalesce("n", F.lit(0)) + F.col("w") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id")
    )
    out = rows.select("vec_id").join(known, F.col("vec_id") == F.col("_id"), "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"),
    )


def op4_hnsw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked(table(spark, sf_dir, "embeddings"))


#: Exact links; the graph's recall decides whether the query equals it.
ORACLE = """
WITH RECURSIVE usable AS (
  SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), units AS (SELECT vec_id, v, sqrt(list_dot_product(v, v)) AS norm FROM usable
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM units a JOIN units b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) AND list_dot_product(a.v, b.v) / (a.norm * b.norm) >= 0.9
), reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
), counted AS (SELECT a, count(*) AS n FROM links GROUP BY a
), least_of AS (SELECT a, min(b) AS m FROM reach GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, least(vec_id, coalesce(m, vec_id)) AS component_id, vec_id <= coalesce(m, vec_id) AS kept
FROM embeddings LEFT JOIN counted ON counted.a = vec_id LEFT JOIN least_of ON least_of.a = vec_id
"""
