from __future__ import annotations

import numpy as np
import pyarrow as pa

from quarry.llm import graph, simhash


def test_edges_lead_to_the_least_of_their_component():
    """A chain of fingerprints, each within the radius of the next only, gives one edge for each but the least."""
    prints, ids = [0, 1, 3, 7, 15, 7 << 40], [50, 40, 10, 30, 20, 60]
    batch = pa.RecordBatch.from_arrays([pa.array([7] * 6), pa.array(ids), pa.array(prints)], names=["key", "node", "fp0"])
    got = [tuple(r.values()) for b in simhash._search(1, 1)(iter([batch])) for r in b.to_pylist()]
    assert sorted(got) == [(20, 10), (30, 10), (40, 10), (50, 10)]


def test_stars_keep_components():
    rng = np.random.default_rng(2)
    for n in (1, 3, 40, 2000):
        u, v = rng.integers(0, 2 * n, n), rng.integers(0, 2 * n, n)
        x, y = simhash.stars(u, v)
        parent = {int(i): int(i) for i in np.concatenate([u, v])}

        def root(i):
            while parent[i] != i:
                i = parent[i]
            return i

        for a, b in zip(u.tolist(), v.tolist()):
            low, high = sorted((root(a), root(b)))
            parent[high] = low
        assert dict(zip(x.tolist(), y.tolist())) == {i: root(i) for i in parent if root(i) != i}
        assert len(x) == len(set(x.tolist()))


def test_edges_of_a_node_are_one_before_the_rounds(spark, monkeypatch):
    """Eighty nodes with an edge to each of twelve: the first table has an edge a node and a few between the twelve, not 960."""
    sizes, written = [], graph._written
    monkeypatch.setattr(graph, "_written", lambda e: (r := written(e), sizes.append(r[1][0]))[0])
    edges = [(100 + i, j) for i in range(80) for j in range(12)]
    found = graph.connected_components(spark.createDataFrame(edges, "u long, v long").repartition(7))
    assert {(r.node, r.component) for r in found.collect()} == {(n, 0) for n in [*range(12), *range(100, 180)]}
    assert sizes[0] == 91
