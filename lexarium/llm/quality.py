"""Quality rules: exact counts of each text, and robust multivariate outliers.

A minimum-covariance-determinant estimate of location and scatter is made per language and source from transformed
statistics; documents far from it by Mahalanobis distance are rejected. Estimates of groups with few documents are
drawn towards their language's, and those of languages with few towards the corpus's. Counts, estimates and distances
are Columns and aggregations; what is kept between steps is one row per document with its numbers, and one row per group.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WHITE, discard, let, lookup, materialise, pick, words

#: Share of a group's documents that the estimate fits, and the chi-square probability beyond which a document is an
#: outlier: one clean document in a million.
SHARE, TAIL = 0.75, 1e-6
#: Change of all log-determinants at which the concentration steps end (distances then change by less than 0.1%; the
#: cuts are percentiles to one in 10,000, which moves a determinant by a few 1e-4), and steps after which they end in any
#: case (each lowers a determinant or leaves it, so that they settle: in 6 steps on all tables measured).
SETTLED, STEPS = 1e-3, 30
#: Documents for each statistic that an estimate needs to stand by itself: five times as many as it has dimensions.
ROWS_EACH = 5
#: Least standard deviation of each transformed statistic; keeps the scatter regular where a statistic hardly varies.
FLOORS = {"log_words": 0.35, "log_word_len": 0.08, "symbols": 0.6, "dup_lines": 0.6, "repeats": 0.5}
FEATURES = list(FLOORS)


def repeat_words(ws: Column) -> Column:
    """Words inside 3-word windows that are found twice or more.

    Windows are compared by 64-bit hashes, sorted with their places; the places of equal neighbours are then
    walked once, each adding the words that the one before doesn't cover. n log n for a text of n words.
    """

    def windows(h: Column) -> Column:
        three = F.transform(h, lambda x, i: F.struct(F.xxhash64(x, F.get(h, i + 1), F.get(h, i + 2)).alias("h"), i.alias("i")))
        return F.sort_array(F.slice(three, F.lit(1), F.greatest(F.size(h) - 2, F.lit(0))))

    def repeated(s: Column) -> Column:
        same = lambda x, k: F.coalesce(x["h"] == F.get(s, k)["h"], F.lit(False))
        return F.sort_array(F.transform(F.filter(s, lambda x, k: same(x, k + 1) | (F.when(k > 0, same(x, k - 1)).otherwise(False))), lambda x: x["i"]))

    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-3).alias("last"))
    step = lambda a, p: F.struct((a["n"] + F.least(F.lit(3), p - a["last"])).alias("n"), p.alias("last"))
    places = let(let(F.transform(ws, lambda w: F.xxhash64(w)), windows), repeated)
    return F.aggregate(places, start, step, lambda a: a["n"])


def text_counts(text: Column) -> dict[str, Column]:
    """The counts of a whole text; null counts as empty."""
    text = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    of_words = let(words(text), lambda ws: F.struct(F.size(ws).cast("long").alias("n_words"), repeat_words(ws).alias("n_repeat_words")))
    return {
        "of_words": of_words,
        "word_chars": F.length(F.regexp_replace(text, WHITE, "")).cast("long"),
        "n_symbols": F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).cast("long"),
        "n_dup_lines": let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
    }


def transformed() -> dict[str, Column]:
    """Statistics of a document on scales where clean documents are about normal."""
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    return {
        "log_words": F.log(n),
        "log_word_len": F.log(F.greatest(F.col("word_chars"), F.lit(1)) / n),
        "symbols": F.log1p(100 * F.col("n_symbols") / n),
        "dup_lines": F.log1p(100 * F.col("n_dup_lines") / n),
        "repeats": F.log1p(100 * F.col("n_repeat_words") / n),
    }


def _gamma_p(a: float, x: float) -> float:
    """The regularised lower incomplete gamma function."""
    term = total = 1 / a
    k = a
    while term > 1e-17 * total:
        k += 1
        term *= x / k
        total += term
    return total * math.exp(a * math.log(x) - x - math.lgamma(a)) if x > 0 else 0.0


def chi2_quantile(p: float, degrees: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if _gamma_p(degrees / 2, mid / 2) < p else (low, mid)
    return high


def cholesky(groups: DataFrame, features: list[str]) -> DataFrame:
    """``groups`` with the Cholesky factor ``l_i_j`` of the covariance columns ``c_j_i``; each entry refers to those before it in one projection."""
    factor = []
    for i in range(len(features)):
        for j in range(i + 1):
            rest = " - ".join([f"c_{j}_{i}", *[f"l_{i}_{k} * l_{j}_{k}" for k in range(j)]])
            factor.append(F.expr(f"sqrt(greatest({rest}, 1e-9D)) AS l_{i}_{j}" if i == j else f"({rest}) / l_{j}_{j} AS l_{i}_{j}"))
    return groups.select("*", *factor)


def _d2(features: list[str]) -> Column:
    """Squared distance: forward substitution with the factor, each solved value bound once."""

    def solve(i: int, done: list[Column]) -> Column:
        if i == len(features):
            return sum((z * z for z in done[1:]), done[0] * done[0])
        z = F.col(features[i]) - F.col(f"m_{i}")
        for k, y in enumerate(done):
            z = z - F.col(f"l_{i}_{k}") * y
        return let(z / F.col(f"l_{i}_{i}"), lambda y: solve(i + 1, [*done, y]))

    return solve(0, [])


def _moments(rows: DataFrame, features: list[str], by: str, factor: float) -> DataFrame:
    """Mean and covariance of each group, the covariance times ``factor`` and with the floors added on its diagonal."""
    p = range(len(features))
    means = [F.avg(f).alias(f"m_{i}") for i, f in enumerate(features)]
    covs = [F.covar_pop(features[j], features[i]).alias(f"r_{j}_{i}") for i in p for j in range(i + 1)]
    out = rows.groupBy(by).agg(*means, *covs)
    floor = lambda i, j: FLOORS[features[i]] ** 2 if i == j else 0.0
    return out.select(by, *[f"m_{i}" for i in p], *[(F.col(f"r_{j}_{i}") * factor + floor(i, j)).alias(f"c_{j}_{i}") for i in p for j in range(i + 1)])


def _start(stats: DataFrame, features: list[str], by: str) -> DataFrame:
    """Medians, and interquartile ranges as standard deviations, of each group; with its number of rows."""
    p = range(len(features))
    quartiles = stats.groupBy(by).agg(F.count("*").alias("n"), *[F.percentile_approx(f, [0.25, 0.5, 0.75], 10_000).alias(f"q_{i}") for i, f in enumerate(features)])
    spread = lambda i: F.pow((F.get(f"q_{i}", F.lit(2)) - F.get(f"q_{i}", F.lit(0))) / 1.349, F.lit(2)) + FLOORS[features[i]] ** 2
    return quartiles.select(by, "n", *[F.get(f"q_{i}", F.lit(1)).alias(f"m_{i}") for i in p], *[(spread(i) if i == j else F.lit(0.0)).alias(f"c_{j}_{i}") for i in p for j in range(i + 1)])


def mcd(stats: DataFrame, features: list[str], by: str, share: float = SHARE, steps: int = STEPS) -> DataFrame:
    """Minimum-covariance-determinant estimate of each group ``by``: ``n`` rows, ``m_i``, ``c_j_i`` and its Cholesky factor ``l_i_j``.

    Deterministic start: medians and interquartile ranges. Each concentration step keeps the ``share`` of the group
    that is nearest by the last estimate and takes its mean and covariance, which never raises the determinant; steps
    end when no group's determinant changes any more. ``stats`` should be a written table. Groups are joined by
    ``lookup`` and aggregated in the map tasks first, so that a group of any size is spread over all tasks.
    """
    log_det = sum((F.log(F.col(f"l_{i}_{i}")) for i in range(1, len(features))), F.log(F.col("l_0_0")))
    salt = F.xxhash64(*features, F.monotonically_increasing_id())
    state = materialise(cholesky(_start(stats, features, by), features).withColumn("log_det", log_det), "mcd")
    n = state.count()
    # scatter of the nearest share of normal data is too small by this factor
    q = chi2_quantile(share, len(features))
    factor = share / _gamma_p(len(features) / 2 + 1, q / 2)
    for _ in range(steps):
        near = lookup(stats, state, by, salt, n=n).select(by, *features, _d2(features).alias("d2"))
        cuts = materialise(near.groupBy(by).agg(F.percentile_approx("d2", share, 10_000).alias("cut")), "mcd-cuts")
        half = lookup(stats, state.join(cuts, by), by, salt, n=n).filter(_d2(features) <= F.col("cut"))
        new = cholesky(_moments(half, features, by, factor), features).withColumn("log_det", log_det)
        before, state = state, materialise(new.join(state.select(by, "n", F.col("log_det").alias("was")), by), "mcd")
        change = state.agg(F.max(F.abs(F.col("log_det") - F.col("was")))).first()[0]
        discard(before, cuts)
        if change is None or change < SETTLED:
            break
    return state


def drawn(groups: DataFrame, parents: DataFrame, features: list[str], by: str, parent: str) -> DataFrame:
    """The estimates of ``groups`` (with a column ``parent``) with a share of their parents': ``1 - n / (ROWS_EACH * dimensions)``, none beyond that."""
    names = [f"m_{i}" for i in range(len(features))] + [f"c_{j}_{i}" for i in range(len(features)) for j in range(i + 1)]
    own = F.least(F.lit(1.0), F.col("n") / (ROWS_EACH * len(features)))
    both = groups.join(parents.select(F.col(by).alias(parent), *[F.col(c).alias(f"of_{c}") for c in names]), parent)
    return cholesky(both.select(by, "n", *[(own * F.col(c) + (1 - own) * F.col(f"of_{c}")).alias(c) for c in names]), features)


def estimates(stats: DataFrame, features: list[str]) -> DataFrame:
    """Estimate of each group ``own`` of a language ``of``, as a written table; ``stats`` has both as hashes, and the features.

    All three levels (own, language, corpus) take their steps together, each row in one group of each level.
    """
    levels = F.array(F.xxhash64(F.lit("own"), "own"), F.xxhash64(F.lit("language"), "of"), F.xxhash64(F.lit("all")))
    raw = mcd(stats.select(F.explode(levels).alias("group"), *features), features, "group")
    tree = stats.select("own", "of").distinct().select("own", *[F.get(levels, F.lit(i)).alias(c) for i, c in enumerate(("group", "language", "corpus"))])
    tree = materialise(tree, "quality-tree")
    languages = raw.join(tree.select(F.col("language").alias("group"), "corpus").distinct(), "group")
    corpus = raw.join(tree.select(F.col("corpus").alias("group")).distinct(), "group")
    languages = drawn(languages, corpus, features, "group", "corpus")
    out = drawn(raw.join(tree.drop("corpus"), "group"), languages, features, "group", "language")
    out = materialise(out.join(tree.select("group", "own"), "group").drop("group", "n"), "quality-estimates")
    discard(raw, tree)
    return out


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", tail: float = TAIL) -> DataFrame:
    """Counts and verdict of every document: ``id_col, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, distance2``.

    ``base_failed``: fewer than 50 words, or more than half of them in repeated 3-word windows. Of the others, those
    whose squared distance from the estimate of their language and source exceeds the chi-square quantile
    ``1 - tail`` aren't kept. A group of fewer than 25 such documents (five for each statistic) takes the missing share
    of its estimate from its language's, a language of fewer from the corpus's; there is no other rule by size.

    Nulls: a null text is empty (base_failed); a null language or source is a group value of its own; a null id is
    kept. Repeated rows each count and each get their row; a single document is its own estimate and stays. An empty
    table gives no rows. ``distance2`` is null where the base rules fail. Further columns are ignored.
    """
    rows = pick(docs, id=id_col, text=text_col, lang=lang_col, source=source_col)
    named = [F.coalesce(F.col(c), F.lit("\0")) for c in ("lang", "source")]
    counted = rows.select("id", F.xxhash64(*named).alias("own"), F.xxhash64(named[0]).alias("of"), *[c.alias(n) for n, c in text_counts(F.col("text")).items()])
    counted = counted.select("id", "own", "of", "of_words.n_words", "word_chars", "n_symbols", "n_dup_lines", "of_words.n_repeat_words")
    counted = materialise(counted, "quality-counts")  # one row of numbers for each document: the texts are read once
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    counted = counted.withColumn("base_failed", failed).withColumns(transformed())

    state = estimates(counted.filter(~F.col("base_failed")), FEATURES)
    judged = lookup(counted, state, "own", F.xxhash64("id", *FEATURES), "left")
    judged = judged.withColumn("distance2", F.when(~F.col("base_failed"), _d2(FEATURES)))
    near = F.coalesce(F.col("distance2") <= chi2_quantile(1 - tail, len(FEATURES)), F.lit(True))
    return judged.select(F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & near).alias("kept"), "distance2")
