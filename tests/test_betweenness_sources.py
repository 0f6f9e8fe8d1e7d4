"""The registered betweenness query searches from as many sources as the operator's default."""

from collections import defaultdict

import pytest

from quillgraph import catalog
from quillgraph.sources.tables import load_graph


def brandes(edges):
    """Dependencies from every source; parallel edges count as separate ways."""
    adj = defaultdict(list)
    for a, b in edges:
        adj[a].append(b)
    score = dict.fromkeys(adj, 0.0)
    for s in adj:
        order, sigma, level = [], defaultdict(float, {s: 1.0}), {s: 0}
        queue = [s]
        for v in queue:
            order.append(v)
            for w in adj[v]:
                if w not in level:
                    level[w] = level[v] + 1
                    queue.append(w)
                if level[w] == level[v] + 1:
                    sigma[w] += sigma[v]
        delta = defaultdict(float)
        for w in reversed(order):
            for v in adj[w]:
                if level[v] == level[w] - 1:
                    delta[v] += sigma[v] / sigma[w] * (1 + delta[w])
            if w != s:
                score[w] += delta[w]
    return score


def test_betweenness_query_is_exact_up_to_300_nodes(spark, small):
    want = brandes([(r.a, r.b) for r in load_graph(spark, small).live().adjacency().where("a <> b").collect()])
    assert 50 < len(want) <= 300
    got = {r.id: r.score for r in catalog.QUERIES["gr07_betweenness"](spark, small).collect()}
    assert got == pytest.approx(want, abs=1e-6)
