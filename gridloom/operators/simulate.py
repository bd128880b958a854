"""Gaussian simulation and repeated cross-validation."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridloom.model import Grid, Mean, Params, present, spine
from gridloom.operators.likelihood import evaluate
from gridloom.plans.linalg import N_MAX, Dense, covariance, normal_noise, separable_power
from gridloom.plans.strategy import Observed


def simulate(spark: SparkSession, grid: Grid, params: Params, n_layer: int = 1, seed: int = 0) -> Grid:
    """Draws from the model at all cells: the square root of V on independent noise; several layers as arrays."""
    cells = spine(spark, grid)
    layers = [separable_power(normal_noise(cells, grid, seed, k), params, grid, 0.5) for k in range(1, n_layer + 1)]
    if n_layer == 1:
        return grid.with_cells(layers[0])
    # one shuffle for all layers
    every = reduce(DataFrame.unionByName, [one.withColumn("lyr", F.lit(k)) for k, one in enumerate(layers)])
    both = every.groupBy("i", "j").agg(F.array_sort(F.collect_list(F.struct("lyr", "v"))).alias("v"))
    return grid.with_cells(both.select("i", "j", F.col("v.v").alias("v")))


def folds(grid: Grid, n_fold: int = 5, n_rep: int = 25, seed: int = 0, bucket_rows: int = 50_000) -> DataFrame:
    """(rep, i, j, v, fold): cells in a hash order, floor(n / n_fold) to a fold; what is left over is never held out (fold 0)."""
    cells = present(grid.cells)
    n = cells.count()
    per, bits = n // n_fold, max(0, math.ceil(math.log2(max(n, 1) / bucket_rows)))
    h = F.xxhash64(F.lit(seed), "rep", grid.k())
    reps = cells.select("i", "j", "v", F.explode(F.sequence(F.lit(1), F.lit(n_rep))).alias("rep")).withColumn("h", h)
    # ranks within ranges of the hash, and the rows of the ranges before: no repetition is sorted in one task
    reps = reps.withColumn("part", F.shiftright("h", 64 - bits) if bits else F.lit(0).cast("long"))
    sizes = reps.groupBy("rep", "part").agg(F.count("*").alias("c"))
    before = sizes.select("rep", "part", F.sum("c").over(Window.partitionBy("rep").orderBy("part")).alias("to"), "c").select("rep", "part", (F.col("to") - F.col("c")).alias("before"))
    nth = F.row_number().over(Window.partitionBy("rep", "part").orderBy("h", grid.k()))
    ranked = reps.withColumn("n", nth).join(before, ["rep", "part"]).withColumn("n", F.col("n") + F.col("before"))
    return ranked.select("rep", "i", "j", "v", F.when(F.col("n") <= per * n_fold, F.floor((F.col("n") - 1) / max(per, 1)) + 1).otherwise(0).cast("int").alias("fold"))


def cross_validate(grid: Grid, models: dict[str, Params], n_fold: int = 5, n_rep: int = 5, seed: int = 0, log_scale: bool = False) -> DataFrame:
    """(model, mspe, msdr, rmspe, aic, bic) of ordinary kriging, each held-out fold predicted from the others only.

    Every model and repetition is a group, so there may be N_MAX cells at most; log_scale: errors of exp(p + v / 2) against exp(z) as mspe_b as well.
    """
    n_obs = present(grid.cells).count()
    if n_obs > N_MAX:
        raise ValueError(f"{n_obs} observed cells are over {N_MAX}, the bound of a dense factor in a task; validate a sub-grid")
    meta = Grid(grid.ny, grid.nx, grid.dy, grid.dx, grid.y0, grid.x0)
    rows = folds(grid, n_fold, n_rep, seed)
    spark = rows.sparkSession
    names = spark.createDataFrame([(m,) for m in models], "model string")
    held = dict(models)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        model, rep = pdf["model"].iloc[0], pdf["rep"].iloc[0]
        params, out = held[model], []
        for f in sorted(set(pdf["fold"]) - {0}):
            train, test = pdf[pdf["fold"] != f].sort_values(["j", "i"]), pdf[pdf["fold"] == f]
            obs = Observed(meta, train["i"].to_numpy(), train["j"].to_numpy(), train["v"].to_numpy()[:, None], None, None)
            factor = Dense(covariance(params, meta, obs.i, obs.j))
            ij = np.concatenate([obs.i, test["i"].to_numpy()]), np.concatenate([obs.j, test["j"].to_numpy()])
            n = len(obs.i)
            c = covariance(Params(params.y, params.x, params.psill, 0.0), meta, *ij)[n:, :n]
            one = np.ones((n, 1))
            v1, vc = factor.power(one), factor.power(c.T)
            b = float((v1.T @ obs.z)[0, 0] / v1.sum())
            p = b + c @ factor.power(obs.z - b)[:, 0]
            var = params.psill - (c * vc.T).sum(1) + (1 - (c @ v1)[:, 0]) ** 2 / v1.sum()
            z = test["v"].to_numpy()
            lik = evaluate(obs, params, Mean.constant())
            back = (np.exp(p + var / 2) - np.exp(z)) ** 2 if log_scale else np.full(len(z), math.nan)
            out.append((model, int(rep), int(f), float(((z - p) ** 2).mean()), float(((z - p) ** 2 / (var + params.eps)).mean()), float(back.mean()), lik.aic, lik.bic))
        return pd.DataFrame(out, columns=["model", "rep", "fold", "mspe", "msdr", "mspe_b", "aic", "bic"])

    scores = rows.crossJoin(F.broadcast(names)).groupBy("model", "rep").applyInPandas(run, "model string, rep int, fold int, mspe double, msdr double, mspe_b double, aic double, bic double")
    mean = [F.avg(c).alias(c) for c in ("mspe", "msdr", "mspe_b", "aic", "bic")]
    return scores.groupBy("model").agg(*mean).withColumns({f"r{c}": F.sqrt(c) for c in ("mspe", "msdr", "mspe_b")})
