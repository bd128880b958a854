"""Robust multivariate outliers among documents' text statistics, in DataFrame functions only.

Each document gets counts of its whole text and, from them, a vector of transformed statistics. For each language and
source a minimum covariance determinant estimate is sought: the centre and covariance of the `share` of the vectors
whose covariance has the least determinant. Four starts (medians and quartiles, all vectors, two small subsets drawn
by hash) go through two concentration steps each; the one of least determinant goes on until a step lowers the
determinant of no group any more. A step takes the `share` of the vectors that are nearest under the current estimate:
distances are binned, sixteen bins an octave, and of the last bin all vectors count for as much as is wanted of it.
Counts, sums and cross products are added up by group and bin before the shuffle, so a source with a third of all rows
sends a row a bin and task.

The covariance gets the statistics' own sampling noise on its diagonal (`NOISE`, the group's median), as most documents
have no symbols or repeats at all. A document is rejected if its squared Mahalanobis distance is over the 1 - `tail`
quantile of chi-square. A group with fewer than `least` documents uses its language's estimate, then that of all.
Null languages and sources are groups of their own; a null text has no words and fails the base rules; repeated rows
count as often as they come.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm.common import meet, stored

SPACE = r"[\x20\x09-\x0D]+"
#: The transformed statistics and their sampling variances: of a log of a count, of a mean word length (half its spread
#: a word), and of arcsine roots of shares of so many characters, lines or windows.
FEATURES = ("x_words", "x_length", "x_symbols", "x_lines", "x_repeats")
NOISE = ("v_words", "v_length", "v_symbols", "v_lines", "v_repeats")
_N = len(FEATURES)
_PAIRS = [(i, j) for i in range(_N) for j in range(i + 1)]
_MODEL = [*(f"m{i}" for i in range(_N)), *(f"l{i}_{j}" for i, j in _PAIRS)]


def _gamma_p(a: float, x: float) -> float:
    """Regularised lower incomplete gamma function by its series."""
    term = total = 1 / a
    n = a
    while term > total * 1e-16:
        n += 1
        term *= x / n
        total += term
    return total * math.exp(a * math.log(x) - x - math.lgamma(a)) if x > 0 else 0.0


def quantile(p: int, share: float) -> float:
    """The quantile of chi-square with p degrees of freedom."""
    low, high = 0.0, 1000.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if _gamma_p(p / 2, mid / 2) < share else (low, mid)
    return low


def consistency(p: int, share: float) -> float:
    """The factor that makes the covariance of the nearest share of normal vectors unbiased."""
    return share / _gamma_p(p / 2 + 1, quantile(p, share) / 2)


def statistics(docs: DataFrame, window: int = 8, *keep: str) -> DataFrame:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and n_lines of each whole text, with doc_id and the columns kept."""
    text = F.coalesce(F.col("text"), F.lit(""))
    # \n and blank ends are cut first, so that splitting gives words only
    trimmed = F.btrim(text, F.lit(" \t\n\x0b\x0c\r"))
    one = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *keep, text.alias("t"), F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE)).alias("w"), F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"))
    two = one.select(
        "doc_id", *keep,
        F.size("w").cast("long").alias("n_words"),
        F.char_length(F.array_join("w", "")).cast("long").alias("word_chars"),
        F.regexp_count("t", F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.transform("w", lambda x: F.xxhash64(x)).alias("h"),
    )
    n = F.size("h")
    three = two.withColumn("h", F.when(n >= window, F.transform(F.sequence(F.lit(1), n - (window - 1)), lambda i: F.xxhash64(F.slice("h", i, window)))).otherwise(F.array().cast("array<long>")))
    # only documents with a repeated window sort their windows
    four = three.withColumn("s", F.when(F.size(F.array_distinct("h")) < F.size("h"), F.sort_array(F.transform("h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    here = lambda k: F.get("s", k)["h"]
    at = F.transform("s", lambda x, k: F.when(F.coalesce(x["h"] == here(k + 1), F.lit(False)) | F.coalesce(x["h"] == here(k - 1), F.lit(False)), x["i"]))
    five = four.withColumn("s", F.sort_array(F.filter(at, lambda x: x.isNotNull())))
    zero = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
    covered = F.aggregate("s", zero, lambda a, p: F.struct((p + window).alias("end"), (a["n"] + F.least(F.lit(window), p + window - a["end"])).alias("n")))["n"]
    return five.select("doc_id", *keep, "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"))


def vectors(stats: DataFrame, window: int = 8) -> DataFrame:
    """stats with the FEATURES and their NOISE; shares go through the arcsine root, which steadies their spread."""
    each = lambda x, n: x / F.greatest(F.lit(1), n)
    share = lambda a, b: F.asin(F.sqrt(F.least(F.lit(1.0), a / F.greatest(F.lit(1), b))))
    return stats.select(
        "*",
        F.log1p("n_words").alias("x_words"),
        F.log1p(F.col("word_chars") / F.greatest(F.lit(1), "n_words")).alias("x_length"),
        share(F.col("n_symbols"), F.col("word_chars")).alias("x_symbols"),
        share(F.col("n_dup_lines"), F.col("n_lines")).alias("x_lines"),
        share(F.col("n_repeat_words"), F.col("n_words")).alias("x_repeats"),
        *(each(F.lit(x), F.col(n)).alias(v) for v, x, n in zip(NOISE, (1.0, 0.25, 0.25, 0.25, 0.25 * window), ("n_words", "n_words", "word_chars", "n_lines", "n_words"))),
    )


def _cholesky(m: list[Column]) -> dict[str, Column]:
    """Columns of the covariance's lower factor: entry (i, j) is l{i}_{j}, its reciprocal diagonal r{i}."""
    out: dict[str, Column] = {}
    at = {p: c for p, c in zip(_PAIRS, m)}
    for i, j in _PAIRS:
        rest = at[i, j]
        for k in range(j):
            rest = rest - F.col(f"l{i}_{k}") * F.col(f"l{j}_{k}")
        out[f"l{i}_{j}"] = F.sqrt(rest) if i == j else rest / F.col(f"l{j}_{j}")
    return out


def _distance() -> Column:
    """The squared distance of the FEATURES under the columns m{i} and l{i}_{j}, by forward substitution."""
    z: list[Column] = []
    for i, x in enumerate(FEATURES):
        rest = F.col(x) - F.col(f"m{i}")
        for j in range(i):
            rest = rest - F.col(f"l{i}_{j}") * z[j]
        z.append(rest / F.col(f"l{i}_{i}"))
    total = F.lit(0.0)
    for c in z:
        total = total + c * c
    return total


def _factor(sums: DataFrame, factor: float, *by: str) -> DataFrame:
    """Centre, factor and log determinant of the covariance with its noise, from the columns n, s{i}, q{i}_{j} and v{i}."""
    n = F.col("n")
    out = sums.select(*by, "n", *(F.col(f"v{i}") for i in range(_N)), *((F.col(f"s{i}") / n).alias(f"m{i}") for i in range(_N)), *(F.col(f"q{i}_{j}") for i, j in _PAIRS))
    cov = [factor * F.greatest(F.lit(0.0) if i == j else F.lit(-math.inf), F.col(f"q{i}_{j}") / n - F.col(f"m{i}") * F.col(f"m{j}")) + (F.col(f"v{i}") if i == j else 0.0) for i, j in _PAIRS]
    out = out.select(*by, *(f"m{i}" for i in range(_N)), *(c.alias(f"c{i}_{j}") for c, (i, j) in zip(cov, _PAIRS)))
    for name, c in _cholesky([F.col(f"c{i}_{j}") for i, j in _PAIRS]).items():
        out = out.withColumn(name, c)
    logs = [2 * F.log(f"l{i}_{i}") for i in range(_N)]
    return out.select(*by, *_MODEL, sum(logs[1:], logs[0]).alias("logdet"))


def _sums(weight: Column | None = None) -> list[Column]:
    """Sums of the rows, or of those where weight holds."""
    x, one = [F.col(f) for f in FEATURES], F.lit(1.0)
    of = (lambda c: F.sum(c)) if weight is None else (lambda c: F.coalesce(F.sum(F.when(weight, c)), F.lit(0.0)))
    return [of(one).alias("n"), *(of(x[i]).alias(f"s{i}") for i in range(_N)), *(of(x[i] * x[j]).alias(f"q{i}_{j}") for i, j in _PAIRS)]


_SUMS = ["n", *(f"s{i}" for i in range(_N)), *(f"q{i}_{j}" for i, j in _PAIRS)]


def _step(rows: DataFrame, models: DataFrame, groups: DataFrame, share: float) -> DataFrame:
    """One concentration step of every model (key, start, m{i}, l{i}_{j}, all): the estimate of the nearest share of its group's rows."""
    at = meet(rows, models.groupBy("key").agg(F.collect_list(F.struct("start", *_MODEL)).alias("models"), F.first("all").alias("all")), "key", "all")
    near = at.select("key", *FEATURES, F.explode("models").alias("model")).select("key", *FEATURES, "model.*")
    binned = near.withColumn("bin", F.floor(16 * F.log2(_distance() + 1e-6))).groupBy("key", "start", "bin").agg(*_sums())
    whole = Window.partitionBy("key", "start")  # a row a bin
    before = F.coalesce(F.sum("n").over(whole.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    wanted = binned.select("*", (share * F.sum("n").over(whole) - before).alias("wanted")).where("wanted > 0")
    part = F.least(F.lit(1.0), F.col("wanted") / F.col("n"))
    nearest = wanted.groupBy("key", "start").agg(*(F.sum(part * F.col(c)).alias(c) for c in _SUMS))
    return _factor(nearest.join(groups, "key"), consistency(_N, share), "key", "start", "all")


def estimates(rows: DataFrame, share: float = 0.75, steps: int = 30, subset: int = 40) -> DataFrame:
    """A minimum covariance determinant estimate (key, all, m{i}, l{i}_{j}, logdet) for each key of rows (key, FEATURES, NOISE)."""
    marks = rows.groupBy("key").agg(
        F.count("*").alias("all"),
        *(F.percentile_approx(f, [0.25, 0.5, 0.75], 1000).alias(f"p{i}") for i, f in enumerate(FEATURES)),
        *(F.percentile_approx(f, 0.5, 1000).alias(f"v{i}") for i, f in enumerate(NOISE)),
    )
    marks = stored(marks, "groups")
    groups = marks.select("key", "all", *(f"v{i}" for i in range(_N)))
    # the starts: medians scaled by quartiles, all rows, and two subsets of about `subset` rows
    center, scale = [F.get(f"p{i}", F.lit(1)) for i in range(_N)], [(F.get(f"p{i}", F.lit(2)) - F.get(f"p{i}", F.lit(0))) / 1.349 for i in range(_N)]
    robust = marks.select("key", "all", F.lit(0).alias("start"), *(c.alias(f"m{i}") for i, c in enumerate(center)), *((F.sqrt(scale[i] * scale[i] + F.col(f"v{i}")) if i == j else F.lit(0.0)).alias(f"l{i}_{j}") for i, j in _PAIRS), F.lit(0.0).alias("logdet"))
    drawn = lambda k: F.pmod(F.xxhash64(*FEATURES, *NOISE, F.lit(k)), F.lit(1 << 30)) / float(1 << 30) < subset / F.col("rows")
    sized = meet(rows, groups.select("key", F.col("all").alias("rows"), "all"), "key", "all")
    kinds = sized.select("key", *FEATURES, F.explode(F.array(F.lit(1), *(F.when(drawn(k), F.lit(k)) for k in (2, 3)))).alias("start")).where("start is not null")
    plain = _factor(kinds.groupBy("key", "start").agg(*_sums()).where("n > 1").join(groups, "key"), 1.0, "key", "start", "all")
    models = stored(robust.unionByName(plain), "starts")
    for _ in range(2):
        models = stored(_step(rows, models, groups, share), "models")
    best = stored(_least(models), "models")
    for _ in range(steps):
        after = stored(_step(rows, best, groups, share), "models")
        new = stored(_least(best.unionByName(after)), "models")
        gain = best.select("key", F.col("logdet").alias("was")).join(new, "key").where("was - logdet > 1e-4").limit(1).count()
        best = new
        if not gain:
            break
    return best.drop("start")


def _least(models: DataFrame) -> DataFrame:
    """The model of least determinant of each key."""
    rest = [c for c in models.columns if c != "key"]
    return models.groupBy("key").agg(F.min_by(F.struct(*rest), F.struct("logdet", "start")).alias("m")).select("key", "m.*")


def judge(docs: DataFrame, window: int = 8, share: float = 0.75, steps: int = 30, least: int = 50, tail: float = 1e-6) -> DataFrame:
    """doc_id, the statistics, base_failed, distance (null where the base fails) and kept."""
    mark = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("-"))
    n, r = F.col("n_words"), F.col("n_repeat_words")
    stats = vectors(statistics(docs, window, "lang", "source"), window).withColumn("base_failed", (n < 20) | (100 * r > 30 * n))
    levels = [F.concat_ws("\x01", F.lit("0"), mark("lang"), mark("source")), F.concat_ws("\x01", F.lit("1"), mark("lang")), F.lit("2")]
    stats = stored(stats.select("*", *(k.alias(f"k{i}") for i, k in enumerate(levels))).drop("lang", "source", "n_lines"), "statistics")
    rows = stats.where(~F.col("base_failed")).select(F.explode(F.array("k0", "k1", "k2")).alias("key"), *FEATURES, *NOISE)
    fit = stored(estimates(rows, share, steps).where(F.col("all") >= least).select("key", "all", F.struct(*_MODEL).alias("f")), "estimates")
    out = stats
    for i in range(len(levels)):
        out = meet(out, fit.where(F.col("key").startswith(str(i))).select(F.col("key").alias(f"k{i}"), F.col("f").alias(f"f{i}"), "all"), f"k{i}", "all", "left")
    out = out.withColumn("f", F.coalesce("f0", "f1", "f2")).select(*stats.columns, "f.*")
    out = out.withColumn("distance", F.when(~F.col("base_failed"), _distance()))
    kept = ~F.col("base_failed") & (F.coalesce(F.col("distance"), F.lit(0.0)) <= quantile(_N, 1 - tail))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), "distance")
