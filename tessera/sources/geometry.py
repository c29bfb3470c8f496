"""Mesh text and panel specifications as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

PANELS = "spec string, panels map<string, struct<vertices: array<array<double>>>>"


def vertices(lines: DataFrame, mesh: str = "mesh_id") -> DataFrame:
    """(mesh, vertex, x, y, z) from rows (mesh, line number ``n``, ``value``) of ``v x y z`` text; other lines are skipped."""
    parts = F.split(F.trim("value"), r"\s+")
    found = lines.filter(F.col("value").startswith("v ")).select(mesh, "n", *(parts[i].try_cast("double").alias(c) for i, c in ((1, "x"), (2, "y"), (3, "z"))))
    return found.dropna(subset=["x", "y", "z"]).select(mesh, (F.row_number().over(Window.partitionBy(mesh).orderBy("n")) - 1).alias("vertex"), "x", "y", "z")


def read_vertices(spark: SparkSession, path: str) -> DataFrame:
    """Vertices of all mesh files under ``path``, a mesh per file; raises if a file has none."""
    text = spark.read.option("wholetext", True).text(path).select(F.regexp_extract(F.input_file_name(), r"([^/]+)$", 1).alias("mesh_id"), F.posexplode(F.split("value", "\r?\n")).alias("n", "value"))
    found = vertices(text)
    if not text.select("mesh_id").distinct().join(found, "mesh_id", "left_anti").isEmpty():
        raise ValueError("a mesh file has no vertices")
    return found


def panel_measures(specs: DataFrame) -> DataFrame:
    """Per spec: bust (sum of torso widths), length (mean torso height), sleeve (mean sleeve width), shoulder, missing panels.

    ``specs``: rows (spec, panels) of the type PANELS.  Torso panels hold "torso" in their name, sleeves "sleeve"; the
    shoulder is the widest top edge of a torso panel.
    """
    points = specs.filter(F.col("spec").isNotNull()).select("spec", F.explode("panels").alias("panel", "p")).select("spec", F.lower("panel").alias("panel"), F.explode("p.vertices").alias("v")).select("spec", "panel", F.col("v")[0].alias("x"), F.col("v")[1].alias("y"))
    # A panel's points meet once: its top edge is told where they lie.
    near = F.abs(F.col("y") - F.max("y").over(Window.partitionBy("spec", "panel"))) < 1e-6
    at_top = lambda f: f(F.when(F.col("near"), F.col("x")))
    box = points.withColumn("near", near).groupBy("spec", "panel").agg(
        (F.max("x") - F.min("x")).alias("dx"), (F.max("y") - F.min("y")).alias("dy"), (at_top(F.max) - at_top(F.min)).alias("edge"), F.count_if("near").alias("edged")
    ).filter("edged > 0")
    torso, sleeve = F.col("panel").contains("torso"), F.col("panel").contains("sleeve")
    return box.groupBy("spec").agg(
        F.sum(F.when(torso, F.col("dx"))).alias("bust"), F.avg(F.when(torso, F.col("dy"))).alias("length"), F.avg(F.when(sleeve, F.col("dx"))).alias("sleeve"), F.max(F.when(torso, F.col("edge"))).alias("shoulder"),
        (F.max(torso.cast("int")) == 0).alias("missing_torso"), (F.max(sleeve.cast("int")) == 0).alias("missing_sleeve"),
    )
