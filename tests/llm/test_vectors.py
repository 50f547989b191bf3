import pickle
import tracemalloc

import numpy as np
import pandas as pd

from glyphloom.llm import op4_hnsw as hnsw


def brute(vectors, least):
    ids = sorted(i for i, v in vectors.items())
    units = np.array([np.array(vectors[i]) / np.linalg.norm(vectors[i]) for i in ids])
    links = units @ units.T >= least
    np.fill_diagonal(links, False)
    label = np.arange(len(ids))
    for _ in range(len(ids)):
        label = np.array([min([label[i], *label[links[i]]]) for i in range(len(ids))])
    return {i: (int(links[k].sum()), ids[label[k]]) for k, i in enumerate(ids)}


def clustered(n, seed=0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, 16))
    out = {}
    for i in range(n):
        base = centres[i % 12] if i % 3 else rng.normal(size=16)
        out[i] = (base + rng.normal(size=16) * (0.05 if i % 3 else 0)).astype(np.float32).astype(float).tolist()
    return out


def test_graph_finds_links():
    vectors = clustered(1500)
    units = np.array([np.array(v) / np.linalg.norm(v) for v in vectors.values()])
    ids = np.arange(len(units))
    graph = hnsw.Graph(units)
    q, v, _ = hnsw.audited_pairs(graph, units, ids, units, ids, 0.9, 8)
    truth = (units @ units.T >= 0.9) & ~np.eye(len(units), dtype=bool)
    assert len(set(zip(q.tolist(), v.tolist()))) == len(q) and truth[q, v].all()
    assert len(q) >= 0.99 * truth.sum()


def test_table_equals_brute_force(spark):
    vectors = clustered(400)
    vectors |= {1000 + i: vectors[i] for i in range(0, 40, 2)}
    odd = [(2000, None), (2001, [0.0] * 16), (2002, [None, *[1.0] * 15]), (2003, [float("nan"), *[1.0] * 15]), (2004, [float("inf"), *[1.0] * 15]), (2005, []), (None, vectors[1])]
    rows = [(i, v, "x") for i, v in [*vectors.items(), *odd, (3, vectors[3]), (3000, [1.0, 2.0]), (3001, [2.0, 4.0])]]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, n_links string")
    got = hnsw.linked(table, shards=3).collect()
    assert len(got) == len(rows)
    expected = brute(vectors, 0.9) | {i: (0, i) for i, _ in odd} | {3000: (1, 3000), 3001: (1, 3000)}
    for r in got:
        assert (r["n_links"], r["component_id"]) == expected[r["vec_id"]]
        assert r["kept"] == (r["vec_id"] is not None and r["vec_id"] == r["component_id"])
    assert hnsw.linked(table.where("vec_id < 0")).count() == 0


def test_audit_draws_queries_until_it_has_links_to_others(monkeypatch):
    rng = np.random.default_rng(4)
    units = rng.normal(size=(400, 16))
    ids = np.arange(400)
    mixed = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    a, b = np.argsort(mixed >> np.uint64(20), kind="stable")[[200, 300]]
    units[b] = units[a] + 0.1
    units /= np.linalg.norm(units, axis=1, keepdims=True)
    graph, own = hnsw.Graph(units), hnsw.Graph.linked

    def narrow(self, queries, least, beam):
        q, v = own(self, queries, least, beam)
        if beam >= 64:
            return q, v
        same = np.einsum("ij,ij->i", queries[q], units[v]) > 1 - 1e-6
        return q[same], v[same]

    monkeypatch.setattr(hnsw.Graph, "linked", narrow)
    q, v, beam = hnsw.audited_pairs(graph, units, ids, units, ids, 0.9, 8)
    assert beam == 64 and {(a, b), (b, a)} <= set(zip(q.tolist(), v.tolist()))


def test_graphs_are_sent_small_and_built_in_bounded_memory(monkeypatch):
    """Single precision is sent where it is exact, without a second copy of the vectors; wide vectors aren't gathered all at once."""
    rng = np.random.default_rng(2)
    single = rng.normal(size=(600, 256)).astype(np.float32).astype(float)
    group = pd.DataFrame({"rep": np.arange(600), "w": 1, "dim": 256, "shard": 0, "embedding": list(single)})
    monkeypatch.setattr(hnsw, "GATHERED", 1 << 17, raising=False)
    tracemalloc.start()
    state = hnsw._build(group, 0.9)["state"][0]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(state) < 1.4 * single.nbytes / 2 and peak < 40e6, (len(state), peak)
    block = hnsw._pack(group.assign(block=0))["queries"][0]
    assert len(block) < 1.1 * single.nbytes / 2
    exact = group.assign(embedding=list(single + 1e-12))
    numbers = pickle.loads(hnsw._pack(exact.assign(block=0))["queries"][0])[1]
    assert numbers.dtype == np.float64 and (numbers == single + 1e-12).all()
