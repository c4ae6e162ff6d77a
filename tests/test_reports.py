"""Reports: banner, lines, totals, what stands for nothing, and the console."""

from pyspark.sql import functions as F

from lumenframe.functions import boxes
from lumenframe.operators import detections
from lumenframe.sources import sinks


def lines(spark, many):
    return spark.range(many).select(F.col("id").alias("n"), F.concat(F.lit("row "), F.col("id").cast("string")).alias("line"))


def shown(spark, many):
    totals = {"Rows": F.count("*"), "Largest": F.coalesce(F.max("n"), F.lit(-1))}
    out = []
    sinks.print_report(sinks.report(lines(spark, many).repartition(3), "line", ["n"], "A TEST", "Nothing.", totals), out.append)
    return out


def test_report(spark):
    assert shown(spark, 12) == ["===== A TEST =====", *[f"row {k}" for k in range(12)], "Rows: 12", "Largest: 11", "=" * 18]
    assert shown(spark, 0) == ["===== A TEST =====", "Nothing.", "Rows: 0", "Largest: -1", "=" * 18]


def test_note_if_empty(spark):
    assert detections.note_if_empty(spark.range(0), "none").collect() == [("none",)]
    assert detections.note_if_empty(spark.range(5), "none").collect() == []


def test_console_of_a_stream(spark, tmp_path):
    for part in range(2):
        lines(spark, 3).withColumn("n", F.col("n") + 3 * part).coalesce(1).write.parquet(str(tmp_path / "in" / str(part)))
    stream = spark.readStream.schema("n long, line string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    out = []
    sinks.console(stream, lambda batch: sinks.report(batch, "line", ["n"], "B", "Nothing.", {"Rows": F.count("*")}), str(tmp_path / "ck"), out.append).awaitTermination()
    assert out.count("===== B =====") == 2 and out.count("Rows: 3") == 2 and out.count("row 1") == 2


def test_whole_ids(spark):
    row = spark.sql("select array(1.9D, -1.9D, 0D) as v, cast(null as array<double>) as none").select(boxes.to_ints(F.col("v")), boxes.to_ints(F.col("none"))).first()
    assert tuple(row) == ([1, -1, 0], None)
