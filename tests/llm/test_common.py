from collections import defaultdict

from pyspark.sql import functions as F

from braggframe.llm.common import ranked, storage


def test_ranks_are_gapless_across_parts(spark):
    df = spark.range(1000).select(F.when(F.col("id") % 3 == 0, F.col("id") % 5).otherwise(7).alias("k"), (F.col("id") % 400).alias("x"), "id")
    got = defaultdict(list)
    for r in ranked(df, ["k"], [F.col("x"), F.col("id")], "r", rows_each=9).collect():
        got[r.k].append(r.r)
    assert all(sorted(v) == list(range(len(v))) for v in got.values()) and sum(map(len, got.values())) == 1000


def test_storage_is_the_configured_folder(spark):
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    assert storage(spark) == folder.rstrip("/") if folder else storage(spark).startswith("file:")
