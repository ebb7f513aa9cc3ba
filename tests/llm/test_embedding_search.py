"""The search for near vectors against every pair, where there are several cells."""

import numpy as np
import pytest

from redactrix.llm import embeddings


def links_plainly(x, label, min_cosine):
    u = x / np.linalg.norm(x, axis=1)[:, None]
    near = (u @ u.T >= min_cosine) & (label[:, None] == label[None, :])
    return near.sum(1) - 1


@pytest.mark.parametrize("min_cosine", [0.9, 0.98])
def test_links_across_cells(spark, monkeypatch, min_cosine):
    monkeypatch.setattr(embeddings, "PER_CELL", 20)
    rng = np.random.default_rng(11)
    x = rng.normal(size=(60, 8)).repeat(10, 0)
    x += rng.normal(size=x.shape) * 0.25
    label = rng.integers(0, 2, len(x))
    rows = spark.createDataFrame([(i, int(a), c.tolist()) for i, (a, c) in enumerate(zip(label, x, strict=True))], "vec_id long, label int, embedding array<double>")
    got = {r["vec_id"]: r["n_links"] for r in embeddings.near_duplicates(rows, min_cosine).collect()}
    assert [got[i] for i in range(len(x))] == links_plainly(x, label, min_cosine).tolist()
