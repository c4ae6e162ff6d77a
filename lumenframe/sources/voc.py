"""Pascal VOC annotations through Spark's own XML reader, with a fixed schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.schema import VOC


def read_annotations(spark: SparkSession, path: str) -> DataFrame:
    """One row per file; an empty depth is null.

    A file holds one annotation: its source holds a tag of the same name, at which
    Spark's reader loses count of rows where several stand in one file.
    """
    rows = spark.read.schema(VOC).option("rowTag", "annotation").xml(path)
    return rows.withColumn("size", F.col("size").withField("depth", F.nullif(F.col("size.depth"), F.lit(""))))


def annotation_objects(annotations: DataFrame) -> DataFrame:
    """One row per object with its box and its attributes by name."""
    named = F.map_from_entries(F.coalesce(F.col("o.attributes.attribute"), F.array().cast("array<struct<name:string,value:string>>")))
    return annotations.select("filename", "size", F.posexplode("object").alias("object_pos", "o")).select(
        "filename",
        "object_pos",
        F.col("size.width").alias("width"),
        F.col("size.height").alias("height"),
        F.col("o.name").alias("name"),
        *[F.col(f"o.bndbox.{c}").alias(c) for c in ("xmin", "ymin", "xmax", "ymax")],
        named.alias("attrs"),
    )


def plate_texts(objects: DataFrame, attribute: str = "number_plate_text") -> DataFrame:
    """Objects with the text attribute, which may be absent."""
    return objects.withColumn("text", F.try_element_at("attrs", F.lit(attribute)))
