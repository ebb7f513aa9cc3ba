"""Vectors of several lengths: each links within its own."""

from redactrix.llm import embeddings


def test_rarer_lengths_link(spark):
    vectors = [(1, 1, [1.0, 0.0]), (2, 1, [1.0, 0.01]), (3, 1, [0.0, 1.0]), (4, 1, [1.0, 0.0, 0.0]), (5, 1, [1.0, 0.0, 0.0]), (6, 2, [1.0, 0.0, 0.0]), (7, 1, [2.0]), (8, 1, [0.0, 0.0, 0.0]), (9, None, [1.0, 0.0]), (10, 1, None)]
    got = embeddings.near_duplicates(spark.createDataFrame(vectors, "vec_id long, label int, embedding array<double>")).collect()
    assert len(got) == len(vectors)
    linked = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in got}
    assert linked == {k: (0, k, True) for k, _, _ in vectors} | {1: (1, 1, True), 2: (1, 1, False), 4: (1, 4, True), 5: (1, 4, False)}
