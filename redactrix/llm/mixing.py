"""Mixing sources to target weights: token totals a source, repetition rates, whole copies plus one Bernoulli copy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from redactrix.llm.common import WORD_CLASS, Scratch, fresh

WEIGHTS = (3, 1, 2)
#: The mix's size against the corpus, as a fraction of whole numbers, and how often a source may be taken at most.
SHARE = (3, 2)
CAP = 2
SEED = "mix-1"


def n_tokens(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD_CLASS)), F.lit(0)).cast("long")


def source_targets(sized: DataFrame, weights=WEIGHTS, share=SHARE, cap=CAP) -> DataFrame:
    """(source, source_size, target) from rows of (source, size).

    The budget, ``share`` of all sizes, is dealt by weight; a source whose part exceeds ``cap`` times its
    size stops there and the rest is dealt anew. In order of size by weight the stopped sources are a
    prefix, so running sums find the level at once; comparisons are on whole numbers. The windows run over
    one row a source (the grouped sums), never over documents.
    """
    num, den = share
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name, every = Window.orderBy(F.col("source").asc_nulls_last()), Window.partitionBy()
    wheel = F.array(*[F.lit(int(w)) for w in weights]).cast("array<bigint>")
    per = per.withColumn("rank", F.row_number().over(by_name)).withColumn("w", F.element_at(wheel, ((F.col("rank") - 1) % len(weights) + 1).cast("int")))
    lower = Window.orderBy(F.col("source_size").cast("double") / F.col("w"), "rank").rowsBetween(Window.unboundedPreceding, -1)
    per = per.select(
        "source", "source_size", "w",
        F.sum("source_size").over(every).alias("total"), F.sum("w").over(every).alias("all_w"),
        F.coalesce(F.sum("source_size").over(lower), F.lit(0)).alias("before"), F.coalesce(F.sum("w").over(lower), F.lit(0)).alias("before_w"),
    )
    full = (num * F.col("total") - den * cap * F.col("before")) * F.col("w") > den * cap * F.col("source_size") * (F.col("all_w") - F.col("before_w"))
    per = per.withColumn("full", full)
    rest = num * F.col("total") / F.lit(float(den)) - F.coalesce(F.sum(F.when(F.col("full"), cap * F.col("source_size"))).over(every), F.lit(0))
    rest_w = F.col("all_w") - F.coalesce(F.sum(F.when(F.col("full"), F.col("w"))).over(every), F.lit(0))
    return per.select("source", "source_size", F.when(F.col("full"), (cap * F.col("source_size")).cast("double")).otherwise(rest / rest_w * F.col("w")).alias("target"))


def uniform(key: Column, seed: str = SEED) -> Column:
    """A number in [0, 1) from the first 52 bits of the MD5 of seed and key: the same on every run and engine."""
    digest = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def _settled(docs: DataFrame, weights, share, cap) -> DataFrame:
    """source_targets of docs, written: a table of known size, so the planner broadcasts it only while it is small."""
    sized = docs.select("source", n_tokens(F.col("text")).alias("size"))
    return Scratch(docs.sparkSession, "mix").write(source_targets(sized, weights, share, cap), "targets")


def plan_copies(docs: DataFrame, weights=WEIGHTS, share=SHARE, cap=CAP, seed: str = SEED) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies) for each row of docs (doc_id, text, source).

    A row's rate is its source's target over the source's size; it gets floor(rate) copies, and one more with
    probability of the fraction. Null text: size 0. Null source: a source of its own, ranked last. A source
    without words: target 0 and no copies. Null or repeated ids: rows with equal ids get equal draws. Empty
    table: no rows. Other columns play no part.
    """
    sized = docs.select("doc_id", "source", n_tokens(F.col("text")).alias("size"))
    per = _settled(docs, weights, share, cap).withColumnRenamed("source", "of_source")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    copies = F.floor(rate) + F.when(uniform(F.col("doc_id"), seed) < rate - F.floor(rate), 1).otherwise(0)
    return sized.join(per, F.col("source").eqNullSafe(F.col("of_source")), "left").select("doc_id", "source", "size", "source_size", "target", copies.cast("long").alias("copies"))


def mix(docs: DataFrame, weights=WEIGHTS, share=SHARE, cap=CAP, seed: str = SEED) -> DataFrame:
    """The mixed documents: each row of docs as often as plan_copies says, with the columns of docs."""
    source, rate, copy = fresh(docs, "of_source", "copy_rate", "copy_number")
    per = _settled(docs, weights, share, cap).select(F.col("source").alias(source), F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0)).alias(rate))
    joined = docs.join(per, docs["source"].eqNullSafe(F.col(source)), "left")
    extra = F.when(uniform(docs["doc_id"], seed) < F.col(rate) - F.floor(rate), 1).otherwise(0)
    copies = (F.floor(rate) + extra).cast("int")
    each = F.when(copies > 0, F.sequence(F.lit(1), F.greatest(copies, F.lit(1)))).otherwise(F.array().cast("array<int>"))
    return joined.withColumn(copy, F.explode(each)).select(*[docs[c] for c in docs.columns])
