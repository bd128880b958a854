"""Points that arrive as a stream, snapped to a fixed grid. An extension: batch snapping is the main form."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.model import Grid
from gridloom.operators.snap import crop, nearest


def snap_stream(points: DataFrame, grid: Grid, time: str, delay: str = "10 minutes") -> DataFrame:
    """The first point of each cell within the watermark's delay; points beyond the grid are left out."""
    inside = crop(points.withWatermark(time, delay), grid)
    i = (grid.ny - nearest(F.col("y"), grid.y0, grid.dy, grid.ny)).cast("int")
    j = (nearest(F.col("x"), grid.x0, grid.dx, grid.nx) + 1).cast("int")
    return inside.withColumn("i", i).withColumn("j", j).dropDuplicatesWithinWatermark(["i", "j"])


def snap_windows(points: DataFrame, grid: Grid, time: str, width: str, delay: str = "10 minutes") -> DataFrame:
    """Mean and count of each cell by tumbling windows of event time."""
    inside = crop(points.withWatermark(time, delay), grid)
    i = (grid.ny - nearest(F.col("y"), grid.y0, grid.dy, grid.ny)).cast("int")
    j = (nearest(F.col("x"), grid.x0, grid.dx, grid.nx) + 1).cast("int")
    return inside.groupBy(F.window(time, width).alias("window"), i.alias("i"), j.alias("j")).agg(F.avg("v").alias("v"), F.count("*").alias("n"))
