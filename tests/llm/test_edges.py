"""Nulls in any column, empty and long texts, ties, repeated rows, empty tables, extra columns with clashing names."""

import pytest
from pyspark.sql import functions as F

from redactrix.llm import chat, embeddings, licenses, mixing, ngram_join, pieces, quality_model, quality_rules, suffix_dedup, warc
from redactrix.llm.queries_b import model_path

LONG = "das ist ein Satz von vielen " * 3000
DOCS = [(1, "", "en", "a"), (2, None, None, None), (None, "ein Text ohne Nummer und noch ein paar Worte mehr", "de", "a"), (3, LONG, "de", "b"), (4, LONG, "de", "b"), (4, LONG, "de", "b"), (5, "MIT License and the word", "en", None), (6, "é" * 300, "fr", "a"), (7, "x", "en", "a")]
#: Names that the operators use themselves.
CLASHING = {"size": 1, "rep": "r", "n_words": "n", "score": 0.5, "cluster": 1, "kept": "k"}


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(DOCS, "doc_id long, text string, lang string, source string").withColumn("n_chars", F.length("text").cast("long")).withColumns({k: F.lit(v) for k, v in CLASHING.items()})


def run_licenses(docs):
    return licenses.report(docs)


def run_embeddings(docs):
    return embeddings.near_duplicates(docs.select(F.col("doc_id").alias("vec_id"), F.lit(1).alias("label"), F.when(F.col("doc_id") > 2, F.array(F.lit(1.0), F.col("doc_id").cast("double"))).alias("embedding")))


def run_model(docs):
    return quality_model.score(docs, quality_model.train(docs, docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"))))


RUNS = {
    "licenses": (run_licenses, 1), "mix_plan": (mixing.plan_copies, 1), "suffix": (suffix_dedup.dedup_digests, None), "ngrams": (ngram_join.similar_groups, 1), "embeddings": (run_embeddings, 1), "model": (run_model, 1),
    "rules": (quality_rules.judge, 1), "pieces": (lambda d: pieces.round_trip_digests(d, model_path()), 1), "spans": (lambda d: pieces.encode(d, model_path()), 1),
    "warc": (lambda d: warc.round_trip(d.sparkSession, d.select(F.col("doc_id").alias("page_id"), F.lit(None).cast("string").alias("url"), F.col("text").alias("html"), "size")), 1),
    "chat": (lambda d: chat.digests(chat.format_records(chat.rows_to_records(d.select(F.col("doc_id").alias("conv_id"), F.lit(None).cast("long").alias("turn"), F.col("source").alias("role"), "text")))), None),
}


@pytest.mark.parametrize("name", sorted(RUNS))
def test_odd_rows(docs, name):
    run, rows = RUNS[name]
    got = run(docs).collect()
    if rows:
        assert len(got) == len(DOCS)


@pytest.mark.parametrize("name", sorted(RUNS))
def test_empty_table(docs, name):
    assert RUNS[name][0](docs.limit(0)).collect() == []


def test_filters_keep_columns(docs):
    for keep in (quality_rules.keep_good, ngram_join.keep_one, mixing.mix):
        assert keep(docs).columns == docs.columns
    assert sorted(r["doc_id"] for r in ngram_join.keep_one(docs).filter("doc_id is not null").collect()) == [1, 2, 3, 5, 6, 7]


def test_defined_results(docs):
    rules = {r["doc_id"]: r for r in quality_rules.judge(docs).collect()}
    assert rules[2]["n_words"] == 0 and rules[2]["base_failed"] and rules[3]["n_repeat_words"] == rules[3]["n_words"]
    found = {r["doc_id"]: r for r in licenses.report(docs).collect()}
    assert (found[5]["n_base"], found[5]["first_word"], found[5]["base_labels"]) == (1, 0, "mit") and found[2]["labels"] == ""
    cut = {r["doc_id"]: r for r in suffix_dedup.dedup_digests(docs).collect()}
    assert cut[4]["n_removed"] == cut[4]["n_bytes"] == len(LONG) and cut[6]["n_removed"] == 600 - 2 and cut[7]["n_removed"] == 0
    groups = {r["doc_id"]: r["component_id"] for r in ngram_join.similar_groups(docs).collect()}
    assert groups[4] == 3 and groups[1] == 1 and groups[None] is None


def test_sources_are_ranked_and_capped(spark):
    docs = spark.createDataFrame([(i, "w " * 10, s) for i, s in enumerate(["a"] * 4 + ["b"] * 90 + [None] * 6)], "doc_id long, text string, source string")
    plan = {r["source"]: r for r in mixing.plan_copies(docs).select("source", "source_size", "target").distinct().collect()}
    assert plan["a"]["target"] == 80 and plan[None]["target"] == 120 and plan["b"]["target"] == pytest.approx(1500 - 200)
    assert mixing.plan_copies(docs).exceptAll(mixing.plan_copies(docs)).count() == 0
