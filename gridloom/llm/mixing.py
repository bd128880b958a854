"""Raking of token weights to target marginals, and sampling by the calibrated probabilities.

Documents are first added up to cells, one for each combination of the dimensions (source, language, topic ...).
Iterative proportional fitting scales the cells until the shares of tokens along every dimension meet their
targets. A document's weight is its cell's factor; its probability is `min(1, scale * weight)`, with the scale
that gives the wanted number of tokens (found on the cells), and it is kept if a hash of its id and text falls
below that probability, so a lost task chooses the same documents again.

Cells are combinations of categories, not documents. Up to `driver_cells` of them are fitted on the driver and sent
to the documents; more are fitted as a table in the shared folder by the same rounds, and of them only the hottest (with
over a ten-thousandth of all documents, so ten thousand at most) are sent, so that no key of the join left has more. Targets that are missing for a category
that has tokens count as zero if `targets` names the dimension; targets for absent categories are spread over
the present ones in proportion. A null category is one of its own, written as None in the targets. A null text
has no tokens: it gets its cell's weight, and is kept by the same rule; a null number of tokens is 0. Equal rows are kept
or dropped together. Columns of documents called weight, probability or kept give way to the operator's own.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import meet, stored

Targets = dict[str, dict[str | None, float]]
_NULL = "\x00"


def n_tokens(text: Column) -> Column:
    """About the number of byte-pair tokens of a text: a third of its bytes, and one for its end."""
    return F.coalesce(F.floor((F.octet_length(text) + 2) / 3), F.lit(0)).cast("long") + 1


def topic(text: Column) -> Column:
    """A plain topic by form: list, noisy, lines or prose."""
    t = F.coalesce(text, F.lit(""))
    size = F.greatest(F.lit(1), F.char_length(t))
    share = lambda p: F.regexp_count(t, F.lit(p)) / size
    return F.when(share(r" \| ") > 0.02, "list").when(share(r"[#*$%&<>!]") > 0.03, "noisy").when(share("\n") > 0.012, "lines").otherwise("prose")


def tempered(shares: dict[str | None, float], temperature: float) -> dict[str | None, float]:
    """Shares raised to 1 / temperature, and normalised: above 1 they come closer to each other."""
    out = {k: v ** (1 / temperature) for k, v in shares.items() if v > 0}
    total = sum(out.values())
    return {k: v / total for k, v in out.items()}


def _normal(targets: Targets) -> dict[str, dict[str, float]]:
    return {d: {_NULL if k is None else k: float(v) for k, v in t.items()} for d, t in targets.items()}


def rake(codes: list[np.ndarray], tokens: np.ndarray, targets: list[np.ndarray], rounds: int = 100, tolerance: float = 1e-9) -> np.ndarray:
    """Factors of cells: codes[d] is each cell's category along dimension d, targets[d] the wanted shares."""
    factor = np.ones(len(tokens))
    wanted = []
    for c, t in zip(codes, targets):
        here = np.bincount(c, tokens, len(t)) > 0
        t = np.where(here, t, 0.0)
        wanted.append(t / t.sum() if t.sum() else here / here.sum())
    for _ in range(rounds):
        worst = 0.0
        for c, t in zip(codes, wanted):
            now = np.bincount(c, tokens * factor, len(t))
            now = now / max(now.sum(), 1e-300)
            worst = max(worst, float(np.abs(now - t).max()))
            factor = factor * np.where(now > 0, t / np.where(now > 0, now, 1), 0.0)[c]
        factor *= tokens.sum() / max(float((tokens * factor).sum()), 1e-300)
        if worst < tolerance:
            break
    return factor


def _rake_table(cells: DataFrame, targets: dict[str, dict[str, float]], rounds: int, tolerance: float) -> DataFrame:
    """`rake` for a table of cells (dimensions, tokens), each round written to the shared folder."""
    cells = stored(cells.withColumn("factor", F.lit(1.0)), "cells")
    spark = cells.sparkSession
    wanted = {}
    for d, t in targets.items():
        there = cells.groupBy(d).agg(F.sum("tokens").alias("n")).where("n > 0").select(d)
        table = spark.createDataFrame(list(t.items()), f"`{d}` string, _t double")
        both = there.join(table, d, "left").fillna(0.0, ["_t"])
        total, n = both.agg(F.sum("_t"), F.count("*")).first()
        wanted[d] = stored(both.withColumn("_t", F.col("_t") / total if total else F.lit(1.0 / max(n, 1))), "targets")
    all_tokens = cells.agg(F.sum("tokens")).first()[0] or 0
    for _ in range(rounds):
        worst = 0.0
        for d, t in wanted.items():
            now = cells.groupBy(d).agg(F.sum(F.col("tokens") * F.col("factor")).alias("_n"))
            total = now.agg(F.sum("_n")).first()[0] or 1e-300
            step = stored(now.join(t, d).select(d, (F.col("_n") / total).alias("_s"), "_t"), "step")
            worst = max(worst, step.agg(F.max(F.abs(F.col("_s") - F.col("_t")))).first()[0] or 0.0)
            scaled = cells.join(step, d, "left").withColumn("factor", F.coalesce(F.col("factor") * F.when(F.col("_s") > 0, F.col("_t") / F.col("_s")).otherwise(0.0), F.col("factor")))
            cells = stored(scaled.select(*cells.columns), "cells")
        sum_now = cells.agg(F.sum(F.col("tokens") * F.col("factor"))).first()[0] or 1e-300
        cells = cells.withColumn("factor", F.col("factor") * (all_tokens / sum_now))
        if worst < tolerance:
            break
    return stored(cells, "cells")


def _key(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(_NULL))


def tally(docs: DataFrame, dims: list[str], tokens: str = "n_tokens") -> DataFrame:
    """(k0, k1, ... for the dimensions as strings, null as \\x00, tokens, documents) of every cell, as a stored table."""
    counts = [F.sum(F.coalesce(F.col(tokens), F.lit(0))).alias("tokens"), F.count("*").alias("documents")]
    return stored(docs.groupBy(*(_key(d).alias(f"k{i}") for i, d in enumerate(dims))).agg(*counts), "cells")


def weights(cells: DataFrame, targets: Targets, rounds: int = 100, tolerance: float = 1e-9, driver_cells: int = 100_000) -> DataFrame:
    """The cells of `tally` with their factor."""
    want = {f"k{i}": t for i, t in enumerate(_normal(targets).values())}
    if cells.count() > driver_cells:
        return _rake_table(cells, want, rounds, tolerance)
    rows = sorted(cells.collect(), key=lambda r: tuple(r[d] for d in want))
    codes, goals = [], []
    for d, t in want.items():
        names = {n: i for i, n in enumerate(sorted({r[d] for r in rows}))}
        codes.append(np.array([names[r[d]] for r in rows], np.int64))
        goals.append(np.array([t.get(n, 0.0) for n in names]))
    factor = rake(codes, np.array([float(r.tokens) for r in rows]), goals, rounds, tolerance) if rows else []
    kinds = "".join(f"{d} string, " for d in want) + "tokens long, documents long, factor double"
    return cells.sparkSession.createDataFrame([(*r, float(f)) for r, f in zip(rows, factor)], kinds)


def _scale(cells: DataFrame, budget: float) -> float:
    """The scale at which the expected tokens, the sum of tokens * min(1, scale * factor), reach the budget.

    That sum is concave and piecewise linear in the scale, so Newton's steps from below end at the scale itself.
    """
    n, f = F.col("tokens"), F.col("factor")
    total, slope = cells.where("factor > 0").agg(F.sum(n), F.sum(n * f)).first()
    if not total or total <= budget or not slope:
        return float("inf")
    scale = budget / slope
    while True:
        full = f * scale >= 1
        done, slope = cells.where("factor > 0").agg(F.sum(F.when(full, n).otherwise(0)), F.sum(F.when(full, 0.0).otherwise(n * f))).first()
        new = (budget - done) / slope if slope > 0 else scale
        if new <= scale * (1 + 1e-12):
            return scale
        scale = new


def mix(docs: DataFrame, targets: Targets, tokens: str = "n_tokens", budget_share: float | None = None, seed: int = 7, by: tuple[str, ...] = ("doc_id", "text"), cells: DataFrame | None = None, driver_cells: int = 100_000, **fit) -> DataFrame:
    """docs with weight, probability and kept; a document's draw is a hash of the columns `by`.

    ``budget_share``: the share of all tokens to keep; without it, the largest at which every probability is at
    most one, so that the kept tokens meet the targets in expectation. ``cells``: the `tally` of docs, if it is known.
    """
    dims = list(targets)
    cells = weights(tally(docs, dims, tokens) if cells is None else cells, targets, driver_cells=driver_cells, **fit)
    if budget_share is None:
        top = cells.where("documents > 0").agg(F.max("factor")).first()[0]
        scale = 1 / top if top else 0.0
    else:
        scale = _scale(cells, budget_share * (cells.agg(F.sum("tokens")).first()[0] or 0))
    chance = F.when(F.col("factor") > 0, F.least(F.lit(1.0), F.col("factor") * scale)).otherwise(0.0)
    side = cells.select(F.struct(*(f"k{i}" for i in range(len(dims)))).alias("_cell"), F.struct(F.col("factor").alias("weight"), chance.alias("probability")).alias("_mix"), "documents")
    draw = F.pmod(F.xxhash64(F.lit(seed), *by), F.lit(1 << 52)) / float(1 << 52)
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"), F.struct(*(_key(d).alias(f"k{i}") for i, d in enumerate(dims))).alias("_cell"), draw.alias("_draw"))
    joined = meet(rows, side, "_cell", "documents", "left", driver_cells)
    own = ("weight", "probability", "kept")
    return joined.select(*(F.col("_row")[c].alias(c) for c in docs.columns if c not in own), F.col("_mix.weight").alias("weight"), F.col("_mix.probability").alias("probability"), (F.col("_draw") < F.col("_mix.probability")).alias("kept"))


def natural(cells: DataFrame, dims: list[str], temperature: float) -> Targets:
    """Targets from the token shares of the cells of `tally`, tempered; one row a category comes to the driver."""
    out: Targets = {}
    for i, d in enumerate(dims):
        rows = cells.groupBy(f"k{i}").agg(F.sum("tokens")).collect()
        total = sum(n for _, n in rows) or 1
        out[d] = tempered({None if k == _NULL else k: n / total for k, n in rows}, temperature)
    return out
