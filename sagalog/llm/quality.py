"""Quality rules: word and line statistics, and robust multivariate outliers.

DataFrame and SQL functions only.  The text is read once into a small row of
statistics; everything after works on those rows.  Outliers are found by
minimum-covariance-determinant (MCD) estimates per language and source.  Every
group has several starts: medians with quartile spreads, all its rows, and
RANDOM_STARTS times five rows drawn by a hash.  Concentration steps repeat "keep
the nearest share H of the rows, estimate mean and covariance anew"; after
FIRST_STEPS of them the start of the smallest determinant goes on until the
determinant of no group falls any more.  One step is one grouped aggregation for
all groups and starts: distances go to logarithmic bins, count and moments are
summed per (group, start, bin), and the bins up to share H give the next
estimate.  So no group is ever sorted or gathered, whatever its size.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import attach, by_row, drop_scratch, filled, materialize

SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\x0b\x0c\r"
#: Least spread of each transformed statistic; it keeps covariances of constant statistics regular and lets each statistic alone reject.
FLOORS = (0.35, 0.10, 0.18, 0.15)
FEATURES = ("x0", "x1", "x2", "x3")
D = len(FEATURES)
H = 0.75
RANDOM_STARTS, FIRST_STEPS = 4, 2
#: A fall of the logarithm of the determinant that counts.
FALL = 1e-3
#: Distance bins per octave.
FINE = 16
#: Rows from which a language and source, or a language, is a population of its own.  All rows together always are one.
MIN_GROUP = 100
#: The squared floors grow by SMALL / n in a population of n rows, so that a handful of rows tells little.
SMALL = 20
_MEANS, _COV = [f"m{i}" for i in range(D)], [f"c{i}{j}" for i in range(D) for j in range(i + 1)]


def _chi2_cdf(x: float, dof: int) -> float:
    """For an even number of degrees of freedom."""
    return 1 - math.exp(-x / 2) * sum((x / 2) ** k / math.factorial(k) for k in range(dof // 2))


def _chi2_quantile(q: float, dof: int) -> float:
    lo, hi = 0.0, 200.0
    for _ in range(100):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if _chi2_cdf(mid, dof) < q else (lo, mid)
    return lo


def consistency(h: float = H, d: int = D) -> float:
    """The factor that makes the covariance of the nearest share h consistent for Gaussian rows."""
    return h / _chi2_cdf(_chi2_quantile(h, d), d + 2)


#: Squared Mahalanobis distance beyond which a document goes.
CUTOFF = _chi2_quantile(0.999, D)


def text_statistics(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Add n_words, word_chars, n_symbols, n_lines, n_dup_lines and n_repeat_words (long); null text counts as empty."""
    t = F.coalesce(F.col(text_col), F.lit(""))
    out = df.withColumns({"_t": t, "_words": F.expr(f"filter(split(coalesce(`{text_col}`, ''), '[\\\\x20\\\\x09-\\\\x0D]+'), w -> w != '')")})
    out = out.withColumns(
        {
            "_lines": F.expr("filter(split(_t, '\\n'), l -> l rlike '[^\\\\x20\\\\x09-\\\\x0D]')"),
            "_tri": F.expr("if(size(_words) < 3, cast(array() as array<struct<h:bigint,i:int>>), sort_array(transform(sequence(0, size(_words) - 3), i -> struct(xxhash64(_words[i], _words[i + 1], _words[i + 2]) as h, i as i))))"),
        }
    )
    out = out.withColumn("_again", F.expr("sort_array(transform(filter(_tri, (x, j) -> (j > 0 and _tri[greatest(j - 1, 0)].h = x.h) or (j < size(_tri) - 1 and _tri[least(j + 1, size(_tri) - 1)].h = x.h)), x -> x.i))"))
    out = out.withColumns(
        {
            "n_words": F.size("_words").cast("long"),
            "word_chars": F.length(F.translate("_t", BLANKS, "")).cast("long"),
            "n_symbols": (F.length("_t") - F.length(F.translate("_t", SYMBOLS, ""))).cast("long"),
            "n_lines": F.size("_lines").cast("long"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
            "n_repeat_words": F.expr("case size(_again) when 0 then 0L when 1 then 3L else cast(3 + aggregate(sequence(0, size(_again) - 2), 0, (a, k) -> a + least(3, _again[k + 1] - _again[k])) as bigint) end"),
        }
    )
    return out.drop("_t", "_words", "_lines", "_tri", "_again")


def _transformed() -> dict[str, Column]:
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    return {
        "x0": F.col("word_chars") / n,
        "x1": F.sqrt(F.col("n_symbols") / n),
        "x2": F.sqrt(F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1))),
        "x3": F.sqrt(F.col("n_repeat_words") / n),
    }


def _distance2() -> Column:
    """Squared distance by forward substitution with the Cholesky factor l00 .. l33."""
    ys: list[Column] = []
    for i in range(D):
        y = F.col(f"x{i}") - F.col(f"m{i}")
        for j in range(i):
            y = y - F.col(f"l{i}{j}") * ys[j]
        ys.append(y / F.col(f"l{i}{i}"))
    return sum((y * y for y in ys[1:]), ys[0] * ys[0])


def _factored(est: DataFrame) -> DataFrame:
    """(key, start, n, m, l, logdet): Cholesky factors of the covariances c00 .. c33, each with its floor added to the diagonal."""
    wider = 1 + SMALL / F.col("n")
    for i in range(D):
        for j in range(i + 1):
            s = F.col(f"c{i}{j}") + (wider * FLOORS[i] ** 2 if i == j else F.lit(0.0))
            for k in range(j):
                s = s - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
            est = est.withColumn(f"l{i}{j}", F.sqrt(F.greatest(s, F.lit(1e-12))) if i == j else s / F.col(f"l{j}{j}"))
    logdet = sum((2 * F.log(f"l{i}{i}") for i in range(1, D)), 2 * F.log("l00"))
    return est.select("key", "start", "n", *_MEANS, *[f"l{i}{j}" for i in range(D) for j in range(i + 1)], logdet.alias("logdet"))


def _sums(x=lambda i: F.col(f"x{i}")) -> list[Column]:
    return [F.count("*").alias("c")] + [F.sum(x(i)).alias(f"s{i}") for i in range(D)] + [F.sum(x(i) * x(j)).alias(f"p{i}{j}") for i in range(D) for j in range(i + 1)]


_SUMS = ["c", *[f"s{i}" for i in range(D)], *[f"p{i}{j}" for i in range(D) for j in range(i + 1)]]


def _moments(tot: DataFrame, factor: float = 1.0) -> DataFrame:
    """Means and covariances from count, sums and sums of products."""
    tot = tot.withColumns({f"m{i}": F.col(f"s{i}") / F.col("c") for i in range(D)})
    tot = tot.withColumns({f"c{i}{j}": (F.col(f"p{i}{j}") / F.col("c") - F.col(f"m{i}") * F.col(f"m{j}")) * factor for i in range(D) for j in range(i + 1)})
    return tot.select("key", "start", "n", *_MEANS, *_COV)


def _medians(rows: DataFrame) -> DataFrame:
    """Medians and quartile spreads from fixed bins (a quarter of the floor wide)."""
    bins = rows.select("key", F.explode(F.array(*[F.struct(F.lit(i).alias("f"), F.round(F.col(x) / (FLOORS[i] / 4)).cast("long").alias("bin")) for i, x in enumerate(FEATURES)])).alias("b"))
    bins = bins.select("key", "b.*").groupBy("key", "f", "bin").agg(F.count("*").alias("c"))
    w = W.partitionBy("key", "f")
    bins = bins.withColumns({"upto": F.sum("c").over(w.orderBy("bin").rowsBetween(W.unboundedPreceding, 0)), "n": F.sum("c").over(w)})
    at = [F.min(F.when(F.col("upto") >= F.col("n") * q, F.col("bin"))).alias(f"q{k}") for k, q in enumerate((0.25, 0.5, 0.75))]
    per = bins.groupBy("key", "f").agg(*at, F.max("n").alias("n"))
    aggs = [F.max("n").alias("n")]
    for i in range(D):
        width = FLOORS[i] / 4
        mine = F.col("f") == i
        aggs.append(F.max(F.when(mine, F.col("q1") * width)).alias(f"m{i}"))
        aggs.append(F.max(F.when(mine, F.pow((F.col("q2") - F.col("q0")) * (width / 1.349), F.lit(2.0)))).alias(f"c{i}{i}"))
    est = per.groupBy("key").agg(*aggs).withColumns({f"c{i}{j}": F.lit(0.0) for i in range(D) for j in range(i)})
    return est.select("key", F.lit(0).alias("start"), "n", *_MEANS, *_COV)


def _starts(rows: DataFrame) -> DataFrame:
    whole = _moments(rows.groupBy("key").agg(*_sums()).withColumns({"start": F.lit(1), "n": F.col("c")}))
    # five rows a start: of each fifth of the rows, by one hash, the one that another hash puts first
    which = F.explode(F.sequence(F.lit(2), F.lit(1 + RANDOM_STARTS)))
    drawn = rows.select("key", *FEATURES, which.alias("start"))
    fifth, place = F.pmod(F.xxhash64(*FEATURES, "start"), F.lit(D + 1)), F.xxhash64("start", *FEATURES, F.lit("place"))
    drawn = drawn.withColumns({"fifth": fifth, "place": place}).groupBy("key", "start", "fifth").agg(F.min_by(F.struct(*FEATURES), F.struct("place", *FEATURES)).alias("x"), F.count("*").alias("k"))
    few = drawn.groupBy("key", "start").agg(*_sums(lambda i: F.col(f"x.x{i}")), F.sum("k").alias("n"))
    return _factored(_medians(rows).unionByName(whole).unionByName(_moments(few)))


def _step(rows: DataFrame, est: DataFrame) -> DataFrame:
    """One concentration step for all groups and starts."""
    d = attach(rows, est, ["key"], "n", "inner").withColumn("d2", _distance2())
    d = d.withColumn("bin", F.greatest(F.lit(-25 * FINE), F.least(F.lit(50 * FINE), F.floor(F.log2(F.col("d2") + 1e-12) * FINE))).cast("int"))
    binned = d.groupBy("key", "start", "bin").agg(*_sums())
    w = W.partitionBy("key", "start")
    binned = binned.withColumns({"before": F.sum("c").over(w.orderBy("bin").rowsBetween(W.unboundedPreceding, 0)) - F.col("c"), "n": F.sum("c").over(w)})
    near = binned.where(F.col("before") < F.col("n") * H)
    tot = near.groupBy("key", "start").agg(F.max("n").alias("n"), *[F.sum(c).alias(c) for c in _SUMS])
    return _factored(_moments(tot, consistency()))


def _smallest(est: DataFrame) -> DataFrame:
    """Of each group the estimate of the smallest determinant (ties: the first start)."""
    return est.groupBy("key").agg(F.min_by(F.struct(*[c for c in est.columns if c != "key"]), F.struct("logdet", "start")).alias("e")).select("key", "e.*")


def estimates(rows: DataFrame) -> DataFrame:
    """(key, start, n, m, l, logdet), one row per key of ``rows`` (key, x0 .. x3): the MCD estimates."""
    est = materialize(_starts(rows), "starts")
    for _ in range(FIRST_STEPS):
        est = materialize(_step(rows, est), "starts")
    best = materialize(_smallest(est), "best")
    while True:
        new = materialize(_step(rows, best), "step")
        better = new.join(best.select("key", F.col("logdet").alias("old")), "key").where(F.col("logdet") < F.col("old") - FALL)
        if not filled(better):
            return best
        best = materialize(_smallest(best.unionByName(new)), "best")


def judge(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """One row of statistics, distance2 and kept per row of ``df``.

    base_failed: fewer than 50 words, or over half of the words in 3-word
    windows that occur twice or more in the text.  Rows that pass it are the
    population of the estimates.  A (language, source) with fewer than
    MIN_GROUP such rows is judged by its language, a language with fewer by all
    rows, however few they are.  Null language or source are values of their
    own; a null text has no words.  Texts of any length are read whole, rows
    with equal or null ids are judged each on its own, ties of distance fall
    alike.  Other columns are not read.  An empty table gives an empty result.
    """
    src = df.select(F.col(id_col).alias("doc_id"), F.col(lang_col).alias("lang"), F.col(source_col).alias("source"), F.col(text_col).alias("text"))
    stats = text_statistics(src).drop("text").withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
    stats = materialize(stats.withColumns(_transformed()), "stats")
    k0, k1 = F.to_json(F.struct(F.lit(0).alias("level"), "lang", "source")), F.to_json(F.struct(F.lit(1).alias("level"), "lang"))
    passed = stats.where("not base_failed")
    many = passed.groupBy(k0.alias("k0"), k1.alias("k1")).agg(F.count("*").alias("n0"))
    n1 = many.groupBy("k1").agg(F.sum("n0").alias("n1"))
    levels = materialize(many.join(n1, "k1").select("k0", "n0", F.filter(F.array(F.when(F.col("n0") >= MIN_GROUP, F.col("k0")), F.when(F.col("n1") >= MIN_GROUP, F.col("k1")), F.lit("all")), lambda k: k.isNotNull()).alias("keys")), "levels")
    rows = materialize(attach(passed.select(k0.alias("k0"), *FEATURES), levels, ["k0"], "n0", "inner").select(F.explode("keys").alias("key"), *FEATURES), "keyed")
    est = estimates(rows)
    drop_scratch(rows)
    counts = stats.groupBy(k0.alias("k0"), k1.alias("k1")).agg(F.count("*").alias("n0"))
    params = [c for c in est.columns if c[0] in "ml" and c != "logdet"]
    options = counts.select("k0", "n0", F.posexplode(F.array("k0", "k1", F.lit("all"))).alias("level", "key")).join(est.drop("n"), "key")
    own = options.groupBy("k0", "n0").agg(F.min_by(F.struct(*params), "level").alias("p"))
    own = materialize(own.select("k0", "n0", "p.*"), "own")
    out = attach(stats.withColumn("k0", k0), own, ["k0"], "n0").withColumn("distance2", _distance2())
    kept = ~F.col("base_failed") & F.coalesce(F.col("distance2") <= CUTOFF, F.lit(True))
    return out.select("doc_id", "lang", "source", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), "distance2")


def quality_filter(df: DataFrame) -> DataFrame:
    """The rows of ``df`` (doc_id, text, lang, source) that are kept, all columns as they were.

    Rows with equal or null ids are documents of their own.
    """

    def stay(rows: DataFrame) -> DataFrame:
        return rows.join(judge(rows).where("not kept").select("doc_id"), "doc_id", "left_anti")

    return by_row(stay, df)
