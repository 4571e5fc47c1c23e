"""Places of nodes in a picture."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Gap between hops, least radius and spread of a ring, radius of the field.
HOP_GAP, LEAST_RADIUS, SPREAD, FIELD = 30, 24, 24, 150


def rings(nodes: DataFrame) -> DataFrame:
    """group, id, hop, x, y, z of nodes (group, id, hop, pos): each hop of a group on a circle below the last."""
    n = F.count("*").over(Window.partitionBy("group", "hop"))
    i = F.row_number().over(Window.partitionBy("group", "hop").orderBy("pos")) - 1
    rows = nodes.withColumn("n", n).withColumn("i", i)
    radius = F.when(F.col("hop") == 0, F.when(F.col("n") == 1, 0.0).otherwise(F.greatest(F.lit(float(LEAST_RADIUS)), F.col("n") * SPREAD / (2 * math.pi)))).otherwise(F.greatest(F.lit(float(LEAST_RADIUS)), F.col("n") * SPREAD / (2 * math.pi)))
    angle = F.col("i") / F.col("n") * (2 * math.pi) + 0.4 * F.col("hop")
    return rows.select("group", "id", "hop", F.round(radius * F.cos(angle), 6).alias("x"), (-HOP_GAP * F.col("hop")).cast("double").alias("y"), F.round(radius * F.sin(angle), 6).alias("z"))


def spiral(nodes: DataFrame, by: str) -> DataFrame:
    """group, id, x, z of nodes (group, id, by): a golden-angle spiral, the largest inside."""
    w = Window.partitionBy("group")
    i = F.row_number().over(w.orderBy(F.desc(by), "id")) - 1
    n = F.count("*").over(w)
    rows = nodes.withColumn("i", i).withColumn("n", n)
    r = FIELD * F.sqrt(F.col("i") / F.col("n"))
    angle = F.col("i") * (math.pi * (3 - math.sqrt(5)))
    return rows.select("group", "id", F.round(r * F.cos(angle), 6).alias("x"), F.round(r * F.sin(angle), 6).alias("z"))
