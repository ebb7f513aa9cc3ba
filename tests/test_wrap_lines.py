import random

from pyspark.sql import functions as F

from redactrix.functions import text as tx
from redactrix.operators import status


def test_texts_wrap_as_their_lines_do(spark):
    deal = random.Random(7)
    texts = ["", "\n", " ", "\n\n ", "a" * 8, "a" * 9, "ab " + "c" * 17 + " d", "a  b", " a b \n c", "один два три\nчетыре", "😀" * 9, "x\t y\r\n z", "a" * 16 + " b", "a\n" + "b" * 7 + " "]
    texts += ["".join(deal.choice(" \nabЖ " if deal.random() < 0.3 else "abcЖ") for _ in range(deal.randrange(60))) for _ in range(400)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    old = F.flatten(F.transform(F.split("t", "\n", -1), lambda x: tx.wrap(x, 8)))
    assert [r for r in rows.select("t", old.alias("a"), tx.wrap_lines(F.col("t"), 8).alias("b")).collect() if r.a != r.b] == []


def test_sheets_of_few_input_partitions_use_all_partitions(spark):
    pages = spark.range(100, numPartitions=1).select(F.col("id").alias("doc_id"), F.lit(1).alias("page_no"), F.lit("a b").alias("text"))
    assert status.rendered(pages).rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions")) > 1
