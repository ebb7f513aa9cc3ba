"""Ids that repeat with different texts: no row is lost or cut by another's decision, in operators, stages and the whole pipeline."""

import hashlib

import pytest
from pyspark.sql import functions as F

from redactrix.llm import ngram_join, suffix_dedup

COPY = " ".join(f"word{i} of the first text" for i in range(30))
OTHER = " ".join(f"quite unlike{i} and its own" for i in range(30))
ROWS = [(1, COPY), (2, COPY), (2, OTHER), (3, OTHER + " tail"), (3, OTHER + " tail"), (4, None), (4, ""), (None, COPY)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = spark.createDataFrame(ROWS, "doc_id long, text string").withColumn("n_chars", F.length("text").cast("long"))
    return rows.withColumns({"lang": F.lit("en"), "source": F.lit("a"), "__id": F.lit("clash"), "component": F.lit(1)})


def test_one_of_each_group_stays(docs):
    kept = ngram_join.keep_one(docs)
    assert kept.columns == docs.columns
    # of the copies that of id 1 stays, of the others that of id 2; rows without words or id stay
    assert sorted(((r["doc_id"] or 0, r["text"]) for r in kept.collect()), key=str) == sorted([(1, COPY), (2, OTHER), (4, None), (4, ""), (0, COPY)], key=str)


def test_groups_of_rows(docs):
    got = ngram_join.similar_groups(docs, 5, 80).collect()
    assert len(got) == len(ROWS)
    assert sorted((r["doc_id"] or 0, r["n_shingles"] > 0, r["component_id"] or 0) for r in got) == [(0, True, 0), (1, True, 1), (2, True, 1), (2, True, 2), (3, True, 2), (3, True, 2), (4, False, 4), (4, False, 4)]


def removed_plainly(rows):
    """By (doc_id, text), in the order of ids and of nothing else that matters here."""
    seen, out = set(), {}
    for k, text in rows:
        data, gone = text.encode(), bytearray(len(text.encode()))
        for s in range(len(data) - 99):
            if data[s : s + 100] in seen:
                gone[s : s + 100] = b"\1" * 100
            seen.add(data[s : s + 100])
        out[k, text] = bytes(b for b, g in zip(data, gone, strict=True) if not g)
    return out


def test_each_row_is_cut_by_its_own_text(docs):
    want = removed_plainly([(1, COPY), (2, COPY), (2, OTHER), (3, OTHER + " tail")])
    cut = suffix_dedup.without_repeats(docs)
    assert cut.columns == docs.columns
    got = sorted(((r["doc_id"] or 0, r["text"]) for r in cut.collect()), key=str)
    assert got == sorted([(1, COPY), (2, want[2, COPY].decode()), (2, want[2, OTHER].decode()), (3, want[3, OTHER + " tail"].decode()), (3, want[3, OTHER + " tail"].decode()), (4, None), (4, ""), (0, COPY)], key=str)
    assert want[2, COPY] == b"" and want[2, OTHER].decode() == OTHER
    digests = suffix_dedup.dedup_digests(docs).collect()
    assert len(digests) == len(ROWS)
    assert sorted(r["kept_sha256"] for r in digests if r["doc_id"] == 2) == sorted(hashlib.sha256(want[2, t]).hexdigest() for t in (COPY, OTHER))


def test_pipeline_over_odd_rows(spark, docs, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    docs.write.parquet(f"{tmp_path}/odd/documents.parquet")
    out = corpus_pipeline.run(spark, f"{tmp_path}/odd").collect()
    assert {r["doc_id"] for r in out} <= {1, 2, 3, None} and {1, 2} <= {r["doc_id"] for r in out}
    docs.limit(0).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").collect() == []
    at = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        at = stage(spark, at, f"{tmp_path}/odd")
        assert at.columns == docs.columns, name
