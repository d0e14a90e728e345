"""The language sample of a table that is mostly copies."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkloom.llm import langid


def test_every_language_is_sampled_whatever_its_copies(spark):
    few = spark.range(60_000).select(F.lit("few").alias("lang"), F.concat(F.lit("text number "), (F.col("id") % 30).cast("string")).alias("text"))
    many = spark.range(3_000).select(F.lit("many").alias("lang"), F.concat(F.lit("another text "), F.col("id").cast("string")).alias("text"))
    taken = langid._sample(few.union(many), "text", "lang", 500)
    assert {r["lang"]: r["n"] for r in taken.groupBy("lang").agg(F.countDistinct("text").alias("n")).collect()} == {"few": 30, "many": 500}
