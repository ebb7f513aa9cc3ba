"""Connected components on graphs where labels have far to go."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from redactrix.llm import embeddings
from redactrix.llm.common import Scratch, components

N = 3000


def shuffled_chain():
    order = list(range(N))
    random.Random(5).shuffle(order)
    return list(zip(order, order[1:], strict=False))


def far_end_chain():
    order = [*range(1, N), 0]
    return list(zip(order, order[1:], strict=False))


def mixed():
    """Chains of several lengths, a star, a ring, a doubled edge and a loop."""
    random.seed(6)
    ids = random.sample(range(10**12), 700)
    out, at = [], 0
    for n in (2, 3, 50, 300):
        out += list(zip(ids[at : at + n], ids[at + 1 : at + n], strict=False))
        at += n
    star, ring = ids[at : at + 200], ids[at + 200 : at + 260]
    out += [(star[0], x) for x in star[1:]] + list(zip(ring, ring[1:] + ring[:1], strict=True))
    return [*out, (ids[0], ids[1]), (ids[1], ids[0]), (ids[699], ids[699])]


def plainly(edges):
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for x in root}


@pytest.mark.parametrize("rounds", ["one task", "by rounds"])
@pytest.mark.parametrize("graph", [shuffled_chain, far_end_chain, mixed])
def test_components(spark, graph, rounds):
    edges = graph()
    limit = {} if rounds == "one task" else {"one_task": 0}
    got = components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "test"), **limit).collect()
    assert len(got) == len({x for e in edges for x in e})
    assert {r["id"]: r["component"] for r in got} == plainly(edges)


def test_no_edges(spark):
    for limit in (0, 10):
        assert components(spark.createDataFrame([], "a long, b long"), Scratch(spark, "test"), one_task=limit).collect() == []


def test_drift_chain_of_vectors(spark):
    """Each vector is near the next one only: one component of 300."""
    rng = np.random.default_rng(7)
    x, chain = np.eye(64)[0], []
    for _ in range(300):
        chain.append(x)
        side = rng.normal(size=64)
        side -= side @ x * x
        x = np.cos(0.19) * x + np.sin(0.19) * side / np.linalg.norm(side)
    ids = rng.permutation(300).tolist()
    rows = spark.createDataFrame([(i, 1, c.tolist()) for i, c in zip(ids, chain, strict=True)], "vec_id long, label int, embedding array<double>")
    got = embeddings.near_duplicates(rows)
    assert got.agg(F.max("component_id"), F.count("*")).first()[:] == (0, 300)
