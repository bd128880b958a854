"""Grids from tables, matrices and rasters in tables, and back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.model import Grid, create, present, spine


def from_matrix(spark: SparkSession, rows: list[list[float | None]], **meta) -> Grid:
    """A matrix given row by row, top row first; None or NaN is missing."""
    df = spark.createDataFrame([(k, [None if v is None else float(v) for v in r]) for k, r in enumerate(rows, 1)], "i int, r array<double>")
    cells = df.select("i", F.posexplode("r").alias("p", "v")).select("i", (F.col("p") + 1).alias("j"), "v")
    return create(cells, dim=(len(rows), len(rows[0])), **meta)


def from_vector(values: DataFrame, dim: tuple[int, int], **meta) -> Grid:
    """A table (k, v) in column-vectorised order."""
    ny = dim[0]
    j = F.floor((F.col("k") - 1) / ny) + 1
    return create(values.select((F.col("k") - ny * (j - 1)).alias("i"), j.alias("j"), "v"), dim=dim, **meta)


def from_layers(cells: DataFrame, dim: tuple[int, int], n_layer: int, **meta) -> Grid:
    """A long table (i, j, layer, v) as one array a cell; a cell that misses a layer is an error."""
    one = cells.groupBy("i", "j").agg(F.array_sort(F.collect_list(F.struct("layer", "v"))).alias("p"), F.count("v").alias("n"))
    checked = F.when(F.col("n") == n_layer, F.col("p.v")).otherwise(F.raise_error(F.lit("layers do not miss the same cells")).cast("array<double>"))
    return create(one.select("i", "j", checked.alias("v")), dim=dim, check=False, **meta)


def from_raster(table: DataFrame, dy: float, dx: float, crs: str | None = None) -> Grid:
    """A raster in a table (y, x, v) of cell centres, in any order; its lines come from the least and greatest coordinates."""
    y1, y2, x1, x2 = table.agg(F.min("y"), F.max("y"), F.min("x"), F.max("x")).first()
    ny, nx = round((y2 - y1) / dy) + 1, round((x2 - x1) / dx) + 1
    cells = table.select((ny - F.rint((F.col("y") - y1) / dy)).cast("int").alias("i"), (F.rint((F.col("x") - x1) / dx) + 1).cast("int").alias("j"), "v")
    return create(cells, dim=(ny, nx), res=(dy, dx), origin=(y1, x1), crs=crs)


def aggregate(df: DataFrame, i, j, value, dim: tuple[int, int], **meta) -> Grid:
    """A grid whose cells are an aggregate of the rows with line numbers i and j (Columns)."""
    return create(df.groupBy(i.cast("int").alias("i"), j.cast("int").alias("j")).agg(value.alias("v")), dim=dim, check=False, **meta)


def coordinates(spark: SparkSession, grid: Grid, corner: bool = False, na_omit: bool = False) -> DataFrame:
    """(k, y, x[, v]) in index order of k; the corners only; or observed cells only."""
    if corner:
        ys, xs = grid.y, grid.x
        rows = [(n, float(y), float(x)) for n, y, x in (("top_left", ys[-1], xs[0]), ("top_right", ys[-1], xs[-1]), ("bottom_left", ys[0], xs[0]), ("bottom_right", ys[0], xs[-1]))]
        return spark.createDataFrame(rows, "corner string, y double, x double")
    if grid.cells is None:
        return spine(spark, grid).select(grid.k().alias("k"), grid.y_of().alias("y"), grid.x_of().alias("x"))
    cells = present(grid.cells) if na_omit else spine(spark, grid).join(grid.cells, ["i", "j"], "left")
    return cells.select(grid.k().alias("k"), grid.y_of().alias("y"), grid.x_of().alias("x"), "v")


def export(spark: SparkSession, grid: Grid, layer: int | None = None) -> DataFrame:
    """(row, y, x, v) in raster order: from the top, row by row; layers as an array unless one is asked for."""
    v = F.element_at("v", layer) if layer is not None else F.col("v")
    out = spine(spark, grid).join(grid.cells.select("i", "j", v.alias("v")), ["i", "j"], "left") if grid.cells is not None else spine(spark, grid).withColumn("v", F.lit(None).cast("double"))
    row = F.col("j") + grid.nx * (F.col("i") - 1)
    return out.select(row.cast("long").alias("row"), grid.y_of().alias("y"), grid.x_of().alias("x"), "v")


def write(df: DataFrame, path: str, kind: str = "parquet", order: tuple[str, ...] = ("row",)) -> None:
    """A table as parquet or CSV, in range-partitioned order."""
    out = df.repartitionByRange(*order).sortWithinPartitions(*order)
    getattr(out.write.mode("overwrite").options(**({"header": "true"} if kind == "csv" else {})), kind)(path)


def read_points(spark: SparkSession, path: str, kind: str = "parquet", schema: str = "pt_id long, y double, x double, v double") -> DataFrame:
    """Points from parquet or CSV in one common reference system; NaN values become missing."""
    df = getattr(spark.read.schema(schema).options(**({"header": "true"} if kind == "csv" else {})), kind)(path)
    return df.withColumn("v", F.when(~F.isnan("v"), F.col("v"))) if "v" in df.columns else df


def require_crs(*systems: str | None) -> str | None:
    """The one reference system of all inputs; reprojection is not offered, so two different ones are an error."""
    known = {c for c in systems if c}
    if len(known) > 1:
        raise ValueError("inputs have different coordinate reference systems")
    return known.pop() if known else None
