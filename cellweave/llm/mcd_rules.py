"""Quality rules: robust multivariate outliers per language and source.  DataFrame functions only."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import SPACES, Stages

SYMBOLS = "#*$%&|<>"
WINDOW = 8
#: Dimensions of the vector; the names of its transformed statistics.
DIMS = ("log_words", "word_length", "symbols", "repeats")
#: Least standard deviation of a dimension: half of the rows are often equal in it, and then no spread can be estimated.
FLOOR = (1.0, 0.2, 0.1, 0.25)
#: Share of rows in the core, and the factor that makes the core's covariance consistent for four normal dimensions:
#: alpha / P(chi2_6 <= q), with q the alpha quantile of chi2_4.
ALPHA, CONSISTENT = 0.75, 1.486
#: chi2_4 quantiles: 0.975 for the reweighted estimate; the cut-off is the 0.999 quantile.
REWEIGHT, CUTOFF = 11.14, 18.47
STEPS = 4
#: Starts of the search for the least determinant: medians and median deviations, then thirds of the rows by hash.
STARTS = 4
#: Bins of a unit in histograms for quantiles, and digits that estimates keep: both make reruns agree, whatever the order of sums.
BINS, DIGITS = 1024, 9
#: A group with fewer rows, five a dimension, is judged by the estimate of its language, a language with fewer by that of all rows.
LEAST = 20
#: Cells whose estimates are sent to every task at most.
BROADCAST = 10_000


def statistics(docs: DataFrame) -> DataFrame:
    """``doc_id, lang, source`` and the base statistics of every row; a null text has no words.

    Windows of eight words are compared by 64-bit hashes within one text.  Only texts in which some hash occurs
    twice sort their windows.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    t = docs.select("doc_id", "lang", "source", text.alias("t"))
    squeezed = F.regexp_replace(F.translate("t", "\t\n\x0b\x0c\r", "     "), "^ +| +$", "")
    t = t.withColumn("w", F.when(F.length(F.translate("t", SPACES, "")) > 0, F.split(squeezed, " +")).otherwise(F.array().cast("array<string>")))
    bare = F.translate("t", SPACES, "")
    lines = F.filter(F.split("t", "\n"), lambda x: F.length(F.translate(x, SPACES, "")) > 0)
    n = F.size("w")
    hashes = F.when(n >= WINDOW, F.transform(F.sequence(F.lit(1), F.greatest(n - WINDOW + 1, F.lit(1))), lambda i: F.xxhash64(F.slice("w", i, WINDOW)))).otherwise(F.array().cast("array<bigint>"))
    t = t.select(
        "doc_id", "lang", "source",
        n.cast("long").alias("n_words"),
        F.length(bare).cast("long").alias("word_chars"),
        (F.length("t") - F.length(F.translate("t", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        lines.alias("lines"), hashes.alias("h"),
    )
    t = t.withColumn("n_dup_lines", (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long")).drop("lines")
    return t.withColumn("n_repeat_words", F.when(F.size(F.array_distinct("h")) < F.size("h"), _covered(F.col("h"))).otherwise(F.lit(0)).cast("long")).drop("h")


def _covered(h: Column) -> Column:
    """Words in windows whose hash occurs twice or more."""
    pairs = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
    # one lambda parameter holds the sorted array, so it is computed once
    def starts(s: Column) -> Column:
        n = F.size(s)
        twice = F.filter(s, lambda p, k: (F.get(s, k - 1)["x"] == p["x"]) | (F.get(s, k + 1)["x"] == p["x"]))
        return F.when(n > 1, F.array_sort(F.transform(twice, lambda p: p["i"])))

    def cover(p: Column) -> Column:
        return F.aggregate(p, F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("at")), lambda a, i: F.struct((a["n"] + F.least(i - a["at"], F.lit(WINDOW))).alias("n"), i.alias("at")))["n"]

    return F.get(F.transform(F.array(pairs), lambda s: cover(starts(s))), F.lit(0))


def vectors(stats: DataFrame) -> DataFrame:
    """Adds the transformed statistics ``x0..x3`` and ``base_failed``."""
    n = F.col("n_words").cast("double")
    one = F.greatest(n, F.lit(1.0))
    xs = (
        F.log1p(n),
        F.log1p(F.col("word_chars") / one),
        F.log1p(F.lit(10.0) * F.col("n_symbols") / F.greatest(F.col("word_chars"), F.lit(1)) / 1.0),
        F.log1p(F.lit(4.0) * F.col("n_repeat_words") / one + F.col("n_dup_lines") / one),
    )
    out = stats.withColumn("base_failed", (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")))
    return out.withColumns({f"x{i}": x for i, x in enumerate(xs)})


def _quantiles(rows: DataFrame, keys: list[str], columns: list[str], share: float) -> DataFrame:
    """Quantile of each column per key, as the middle of a histogram's bin; the histogram is a partial aggregate."""
    bins = F.array(*[F.floor(F.col(c) * BINS) for c in columns])
    counts = rows.select(*keys, F.posexplode(bins).alias("dim", "bin")).groupBy(*keys, "dim", "bin").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(*keys, "dim")
    counts = counts.withColumns({"below": F.sum("n").over(w.orderBy("bin")), "all": F.sum("n").over(w)}).where(F.col("below") >= F.lit(share) * F.col("all"))
    return counts.groupBy(*keys).agg(*[((F.min(F.when(F.col("dim") == i, F.col("bin"))) + 0.5) / BINS).alias(c) for i, c in enumerate(columns)])


def _moments(rows: DataFrame, keys: list[str], scale: float = 1.0) -> DataFrame:
    d = len(DIMS)
    aggs = [F.round(F.avg(f"x{i}"), DIGITS).alias(f"m{i}") for i in range(d)]
    aggs += [F.round(F.lit(scale) * F.coalesce(F.covar_pop(f"x{i}", f"x{j}"), F.lit(0.0)), DIGITS).alias(f"c{i}{j}") for i in range(d) for j in range(i + 1)]
    return _cholesky(rows.groupBy(*keys).agg(*aggs))


def _cholesky(g: DataFrame) -> DataFrame:
    """Lower factor ``l_ij`` of the covariance, whose variances are the floors' squares at least."""
    d = len(DIMS)
    g = g.withColumns({f"c{i}{i}": F.greatest(F.col(f"c{i}{i}"), F.lit(FLOOR[i] ** 2)) for i in range(d)})
    for i in range(d):
        for j in range(i + 1):
            s = F.col(f"c{i}{j}")
            for k in range(j):
                s = s - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
            # rounding may take the little that a variance leaves after the dimensions before it
            g = g.withColumn(f"l{i}{j}", F.sqrt(F.greatest(s, F.lit(1e-6))) if i == j else s / F.col(f"l{j}{j}"))
    return g.drop(*[f"c{i}{j}" for i in range(d) for j in range(i + 1)])


def _distance(rows: DataFrame, estimate: DataFrame, *more: str) -> DataFrame:
    """Squared Mahalanobis distance ``d2`` by forward substitution."""
    d = len(DIMS)
    out = rows.join(estimate, "cell")
    for i in range(d):
        y = F.col(f"x{i}") - F.col(f"m{i}")
        for k in range(i):
            y = y - F.col(f"l{i}{k}") * F.col(f"y{k}")
        out = out.withColumn(f"y{i}", y / F.col(f"l{i}{i}"))
    out = out.withColumn("d2", sum((F.col(f"y{i}") * F.col(f"y{i}") for i in range(1, d)), F.col("y0") * F.col("y0")))
    return out.select(*rows.columns, *more, F.round("d2", DIGITS).alias("d2"))


def judge(docs: DataFrame, stages: Stages | None = None) -> DataFrame:
    """``doc_id``, the base statistics, ``base_failed``, ``distance`` and ``kept`` of every row.

    The minimum-covariance-determinant estimate of each (language, source) cell is searched from several starts: medians
    and median deviations, and the moments of thirds of the rows by hash.  Each concentration step keeps the three
    quarters of the cell's rows nearest to the estimate and takes their mean and covariance.  Of the starts' ends, the one
    with the least determinant counts, and a final estimate comes from the rows within its 0.975 quantile.  Quantiles
    come from histograms, moments are partial aggregates: a cell with a third of all rows spreads over all tasks, and
    reruns agree.
    Rows that fail the base rules are judged but not learnt from.  Null language or source is a value of its own.
    """
    stages = stages or Stages(docs.sparkSession, "rules")
    rows = stages.save(vectors(statistics(docs)), "statistics")
    size = rows.where("not base_failed").groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n"))
    name = lambda *c: F.to_json(F.struct(*c), {"ignoreNullFields": "false"})
    by_lang = size.groupBy("lang").agg(F.sum("n").alias("n_lang"))
    cells = size.join(by_lang.withColumnRenamed("lang", "l"), F.col("lang").eqNullSafe(F.col("l"))).select(
        F.col("lang").alias("l"), F.col("source").alias("s"),
        F.when(F.col("n") >= LEAST, name("lang", "source")).when(F.col("n_lang") >= LEAST, name("lang")).otherwise("all").alias("cell"),
    )
    cells = stages.save(cells, "cells")
    placed = rows.join(cells, F.col("lang").eqNullSafe(F.col("l")) & F.col("source").eqNullSafe(F.col("s")), "left")
    placed = placed.withColumn("cell", F.coalesce("cell", F.lit("all"))).drop("l", "s")
    # a cell's estimate is learnt from every row that its name covers
    names = F.array(F.lit("all"), name("lang"), name("lang", "source"))
    used = stages.save(cells.select("cell").distinct(), "used")
    few = used.count() <= BROADCAST
    near = F.broadcast if few else (lambda x: x)  # a hot cell then stays spread; beyond, joins that Spark can split
    third = F.pmod(F.xxhash64("doc_id", *[f"x{i}" for i in range(len(DIMS))]), F.lit(STARTS - 1)).alias("third")
    learn = rows.where("not base_failed").select(F.explode(names).alias("cell"), *[f"x{i}" for i in range(len(DIMS))], third)
    learn = stages.save(learn.join(near(used), "cell", "left_semi"), "learn")

    d = len(DIMS)
    xs = [f"x{i}" for i in range(d)]
    mid = _quantiles(learn, ["cell"], xs, 0.5).withColumnsRenamed({x: f"m{i}" for i, x in enumerate(xs)})
    off = _quantiles(learn.join(near(mid), "cell").select("cell", *[F.abs(F.col(f"x{i}") - F.col(f"m{i}")).alias(f"a{i}") for i in range(d)]), ["cell"], [f"a{i}" for i in range(d)], 0.5)
    start = mid.join(near(off), "cell").withColumns({f"c{i}{j}": F.pow(1.4826 * F.col(f"a{i}"), F.lit(2)) if i == j else F.lit(0.0) for i in range(d) for j in range(i + 1)})
    start = _cholesky(start.drop(*[f"a{i}" for i in range(d)])).withColumn("start", F.lit(0))
    thirds = _moments(learn, ["cell", "third"]).withColumn("start", (F.col("third") + 1).cast("int")).drop("third")
    estimate = stages.save(start.unionByName(thirds), "estimate")
    for _ in range(STEPS):
        far = _distance(learn, near(estimate), "start").withColumn("level", F.log1p("d2"))
        limit = _quantiles(far, ["cell", "start"], ["level"], ALPHA).withColumnRenamed("level", "limit")
        core = far.join(near(limit), ["cell", "start"]).where((F.floor(F.col("level") * BINS) + 0.5) / BINS <= F.col("limit"))
        estimate = stages.save(_moments(core, ["cell", "start"], CONSISTENT), "estimate")
    size = functools.reduce(lambda a, b: a * b, [F.col(f"l{i}{i}") for i in range(d)])  # the determinant's root
    ends = [c for c in estimate.columns if c not in ("cell", "start")]
    least = estimate.groupBy("cell").agg(F.min_by(F.struct(*ends), F.struct(F.round(size, DIGITS), "start")).alias("e")).select("cell", "e.*")
    core = _distance(learn, near(stages.save(least, "least"))).where(F.col("d2") <= REWEIGHT)
    estimate = stages.save(_moments(core, ["cell"]), "estimate")
    out = _distance(placed, near(estimate))
    # rows of a cell without any row that passes the base rules
    missing = placed.join(near(estimate.select("cell")), "cell", "left_anti").withColumn("d2", F.lit(None).cast("double"))
    out = out.unionByName(missing)
    kept = ~F.col("base_failed") & F.coalesce(F.col("d2") <= CUTOFF, F.lit(False))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), F.col("d2").alias("distance"), "cell")
