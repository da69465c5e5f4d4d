"""Streams give what the tables give."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from bintangle.operators.parse_rows import rejects
from bintangle.streaming.ingest import daily_totals, split_lines

SF = "/root/testdata/sf0.001"


def test_split_lines(spark, tmp_path):
    table = spark.read.parquet(f"{SF}/raw_lines.parquet")
    table.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    split_lines(stream, str(tmp_path / "valid"), str(tmp_path / "bad"), str(tmp_path / "state")).awaitTermination(120)
    bad = spark.read.parquet(str(tmp_path / "bad"))
    assert {r.line_id for r in bad.collect()} == {r.line_id for r in rejects(table).collect()}
    valid = spark.read.parquet(str(tmp_path / "valid"))
    assert valid.count() + bad.count() + table.where("line like '#%'").count() == table.count()


def test_daily_totals(spark, tmp_path):
    table = spark.read.parquet(f"{SF}/contacts.parquet").withColumn("loaded_at", F.col("loaded_at").cast("timestamp"))
    table.write.parquet(str(tmp_path / "in"))
    stream = daily_totals(spark.readStream.schema(table.schema).parquet(str(tmp_path / "in")))
    query = stream.writeStream.format("memory").queryName("totals").outputMode("update").start()
    query.processAllAvailable()
    query.stop()
    got = spark.table("totals").agg(F.sum("n"), F.sum("total")).first()
    expected = table.agg(F.count("*"), F.sum(F.when((F.col("v") > 0) & ~F.isnan("v"), F.col("v")))).first()
    assert got[0] == expected[0] and got[1] == pytest.approx(expected[1])
