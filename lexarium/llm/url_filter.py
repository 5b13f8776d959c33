"""URL filter: host and path rules, and gradient-boosted trees on lexical features for the rest.

Everything is a DataFrame plan. Training works on one table of distinct binned feature vectors with their counts,
so that every labelled row counts without being moved again; only histograms of a tree level (nodes x features x
bins rows) reach the driver. Label statistics of suffixes are out of fold: a labelled row has those of other folds.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, discard, let, lookup, materialise, pick, spread_join

#: Buckets that registered-domain suffixes are hashed into for their label statistics; bounds the table that is broadcast.
SUFFIX_BUCKETS = 2048
#: Upper bin edges of each feature: a value's bin is the number of edges that it exceeds.
EDGES: dict[str, list[float]] = {
    "n_chars": [20, 30, 40, 50, 65, 90, 140],
    "depth": [0, 1, 2, 3, 4, 6],
    "digit_ratio": [0.0, 0.03, 0.06, 0.1, 0.15, 0.25, 0.4],
    "entropy": [2.5, 3.2, 3.6, 3.9, 4.1, 4.3, 4.6],
    "n_params": [0, 1, 2, 4, 8],
    "n_labels": [1, 2, 3, 4, 6],
    "n_hyphens": [0, 1, 2, 4],
    "path_digits": [0.0, 0.1, 0.2, 0.3, 0.5],
    "suffix_rate": [0.1, 0.25, 0.4, 0.5, 0.6, 0.75, 0.9],
}
#: Rules that are written into the plan; more are met by joins. Parts that labelled rows are dealt into for their suffix statistics.
PLAN_RULES, FOLDS = 200, 5
#: What a rate of a suffix counts besides its rows: one row of each class.
PRIOR = 1.0


def host_path(url: Column) -> tuple[Column, Column]:
    """Host (after the first ``://`` up to ``/ ? #``, A-Z lower-cased) and path (then up to ``? #``); both empty without ``://`` or for null."""
    url = F.coalesce(url, F.lit(""))
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    return ascii_lower(F.regexp_extract(rest, r"^[^/?#]*", 0)), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest rule (``host/path`` text) that fits, and its verdict; nulls if none does. Of rules with one text, ``block`` counts."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for how, text in sorted(rules, key=lambda r: (len(r[1]), r[1], r[0])):
        own, _, rest = text.partition("/")
        fits = ((host == own) | host.endswith(f".{own}")) & path.startswith(f"/{rest}")
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(how)).otherwise(verdict)
    return rule, verdict


def join_rules(rows: DataFrame, rules: DataFrame) -> DataFrame:
    """``rows`` (a written table with ``host``, ``path``) with ``rule`` and ``decided``, for any number of rules (``how, text``).

    Each distinct host and path asks for the rules of all its suffixes at the lengths that those have, by equal text. Keys of
    many rows (a common suffix, one url in many rows) are broadcast or spread.
    """
    rules = rules.filter("text is not null").groupBy("text").agg(F.max("how").alias("how"))
    own = F.substring_index("text", "/", 1)
    lengths = materialise(rules.groupBy(own.alias("suffix")).agg(F.collect_set(F.length("text") - F.length(own)).alias("lengths")), "rule-lengths")
    rules = materialise(rules, "rules")
    asked = materialise(rows.groupBy("host", "path").agg(F.count("*").alias("size")), "rule-urls")
    parts = F.split("host", "[.]")
    suffixes = F.transform(parts, lambda x, i: F.array_join(F.slice(parts, i + 1, F.size(parts)), "."))
    salt = F.xxhash64("host", "path")
    each = lookup(asked.select("host", "path", F.explode(suffixes).alias("suffix")), lengths, "suffix", salt)
    each = each.select("host", "path", "suffix", F.explode("lengths").alias("n")).filter(F.col("n") <= F.length("path"))
    # a rule without a path part is the text of its host alone
    each = each.select("host", "path", F.concat("suffix", F.expr("substring(path, 1, n)")).alias("text"))
    hits = lookup(each, rules, "text", salt).groupBy("host", "path").agg(F.max_by(F.struct("text", "how"), F.struct(F.length("text"), F.col("text"))).alias("best"))
    found = materialise(asked.join(hits, ["host", "path"], "left").select("host", "path", "size", F.col("best.text").alias("rule"), F.col("best.how").alias("decided")), "rule-hits")
    out = spread_join(rows, found, ["host", "path"], rows.count()).drop("size")
    discard(lengths, rules, asked)
    return out


def _ratio(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern)) / F.greatest(F.length(text), F.lit(1))


def _entropy(text: Column) -> Column:
    """Shannon entropy of the characters, in bits: sum over distinct characters, each counted once."""

    def of(s: Column) -> Column:
        n = F.length(s).cast("double")
        share = lambda c: (n - F.length(F.replace(s, c, F.lit("")))) / n
        parts = F.transform(F.array_distinct(F.array_remove(F.split(s, ""), "")), lambda c: let(share(c), lambda p: -p * F.log2(p)))
        return F.coalesce(F.aggregate(parts, F.lit(0.0), lambda a, x: a + x), F.lit(0.0))

    return let(text, of)


def lexical_features(url: Column, host: Column, path: Column) -> dict[str, Column]:
    """Features of a url that need nothing but its characters."""
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    return {
        "n_chars": F.length(url).cast("double"),
        "depth": F.regexp_count(path, F.lit("/[^/]")).cast("double"),
        "digit_ratio": _ratio(url, "[0-9]"),
        "entropy": _entropy(url),
        "n_params": F.when(query == "", 0.0).otherwise(F.regexp_count(query, F.lit("&")) + 1.0),
        "n_labels": F.when(host == "", 0.0).otherwise(F.regexp_count(host, F.lit("[.]")) + 1.0),
        "n_hyphens": F.regexp_count(host, F.lit("-")).cast("double"),
        "path_digits": _ratio(path, "[0-9]"),
    }


def _bin(value: Column, edges: Sequence[float]) -> Column:
    return reduce(lambda a, e: a + (value > F.lit(float(e))).cast("int"), edges, F.lit(0))


def _suffix_bucket(host: Column) -> Column:
    return F.pmod(F.xxhash64(F.regexp_extract(host, r"[^.]*\.?[^.]*$", 0)), F.lit(SUFFIX_BUCKETS)).cast("int")


def fit_trees(vectors: DataFrame, features: Sequence[str], n_trees: int = 8, depth: int = 3, rate: float = 0.4, l2: float = 1.0) -> Column:
    """Boosted trees (logistic loss, Newton steps) on ``vectors``: binned features, ``n`` rows and ``y`` of them labelled 1.

    Returns the log-odds as a Column over the binned features. A constant if only one class or no row is there. A level of a
    tree is one aggregation; the sums of a split's sides are read off its histogram.
    """
    total = vectors.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("y"), F.lit(0)).alias("y")).first()
    base = math.log((total.y + 0.5) / (total.n - total.y + 0.5))
    score = F.lit(base)
    if total.y in (0, total.n):
        return F.lit(base if total.n else -1.0)
    pairs = F.explode(F.array(*[F.struct(F.lit(i).alias("feature"), F.col(f).alias("bin")) for i, f in enumerate(features)]))
    for _ in range(n_trees):
        p = 1 / (1 + F.exp(-score))
        grads = vectors.select(*features, (F.col("n") * p - F.col("y")).alias("g"), (F.col("n") * p * (1 - p)).alias("h"))
        leaves: dict[int, float] = {1: 0.0}
        splits: dict[int, tuple[str, int]] = {}
        open_ = {1}
        for _ in range(depth):
            node = _descend(splits, 1)
            rows = grads.select(node.alias("node"), "g", "h", pairs.alias("p")).filter(F.col("node").isin(*open_)).groupBy("node", "p.feature", "p.bin").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).collect()
            histogram: dict[int, dict[int, dict[int, tuple[float, float]]]] = {}
            for r in rows:
                histogram.setdefault(r.node, {}).setdefault(r.feature, {})[r.bin] = (r.g, r.h)
            open_ = set()
            for at, by_feature in histogram.items():
                g, h = (sum(by_feature[0][b][i] for b in sorted(by_feature[0])) for i in (0, 1))
                leaves[at] = -rate * g / (h + l2)
                gain, chosen = 1e-6, None
                for f, bins in sorted(by_feature.items()):
                    left_g = left_h = 0.0
                    for b in sorted(bins)[:-1]:
                        left_g, left_h = left_g + bins[b][0], left_h + bins[b][1]
                        own = left_g**2 / (left_h + l2) + (g - left_g) ** 2 / (h - left_h + l2) - g**2 / (h + l2)
                        if own > gain + 1e-9:
                            gain, chosen = own, (f, b, left_g, left_h)
                if chosen:
                    f, b, left_g, left_h = chosen
                    splits[at] = (features[f], b)
                    leaves |= {2 * at: -rate * left_g / (left_h + l2), 2 * at + 1: -rate * (g - left_g) / (h - left_h + l2)}
                    open_ |= {2 * at, 2 * at + 1}
            if not open_:
                break
        score = score + _leaf(splits, leaves, 1)
    return score


def _descend(splits: dict[int, tuple[str, int]], at: int) -> Column:
    if at not in splits:
        return F.lit(at)
    f, b = splits[at]
    return F.when(F.col(f) <= b, _descend(splits, 2 * at)).otherwise(_descend(splits, 2 * at + 1))


def _leaf(splits: dict[int, tuple[str, int]], leaves: dict[int, float], at: int) -> Column:
    if at not in splits:
        return F.lit(float(leaves.get(at, 0.0)))
    f, b = splits[at]
    return F.when(F.col(f) <= b, _leaf(splits, leaves, 2 * at)).otherwise(_leaf(splits, leaves, 2 * at + 1))


def _shaped(rows: DataFrame) -> DataFrame:
    """Rows with ``url`` as host, path, lexical features, suffix bucket and fold."""
    rows = rows.withColumn("url", F.coalesce("url", F.lit("")))
    host, path = host_path(F.col("url"))
    rows = rows.withColumns({"host": host, "path": path})
    fold = F.pmod(F.xxhash64(F.lit("fold"), "url"), F.lit(FOLDS)).cast("int")
    return rows.withColumns({**lexical_features(F.col("url"), F.col("host"), F.col("path")), "bucket": _suffix_bucket(F.col("host")), "fold": fold})


def _suffix_stats(labelled: DataFrame) -> DataFrame:
    """``bucket, n, y`` and the same of each fold as arrays: SUFFIX_BUCKETS rows at most, so fit to broadcast."""
    by_fold = [F.coalesce(F.sum(F.when(F.col("fold") == k, c)), F.lit(0)) for c in (F.lit(1), F.col("blocked")) for k in range(FOLDS)]
    stats = labelled.groupBy("bucket").agg(F.count("*").alias("n"), F.sum("blocked").alias("y"), F.array(*by_fold[:FOLDS]).alias("fold_n"), F.array(*by_fold[FOLDS:]).alias("fold_y"))
    return materialise(stats.coalesce(1), "suffix-stats")


def _binned(rows: DataFrame, stats: DataFrame, own_fold: bool) -> DataFrame:
    """Binned features; ``own_fold``: the rate of a suffix is that of rows of other folds, as it is for a labelled row that is learned from."""
    rows = rows.join(F.broadcast(stats), "bucket", "left")
    out = lambda c: F.col(c) - (F.get(f"fold_{c}", F.col("fold")) if own_fold else F.lit(0))
    rate = (F.coalesce(out("y"), F.lit(0)) + PRIOR) / (F.coalesce(out("n"), F.lit(0)) + 2 * PRIOR)
    rows = rows.withColumn("suffix_rate", rate).drop("n", "y", "fold_n", "fold_y")
    return rows.withColumns({f"bin_{f}": _bin(F.col(f), edges) for f, edges in EDGES.items()})


def _learn(labelled: DataFrame, n_trees: int, depth: int) -> tuple[DataFrame, Column]:
    """Suffix statistics and the trees' log-odds, from all labelled rows (shaped, with ``blocked`` 0 or 1)."""
    stats = _suffix_stats(labelled)
    features = [f"bin_{f}" for f in EDGES]
    vectors = materialise(_binned(labelled, stats, True).groupBy(*features).agg(F.count("*").alias("n"), F.sum("blocked").alias("y")), "url-vectors")
    score = fit_trees(vectors, features, n_trees, depth)
    discard(vectors)
    return stats, 1 / (1 + F.exp(-score))


def _judged(rows: DataFrame, rules: Sequence[tuple[str, str]] | DataFrame) -> DataFrame:
    """Rows with ``rule`` and ``decided``, its verdict."""
    if not isinstance(rules, DataFrame):
        if len(rules) <= PLAN_RULES:
            rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
            return rows.withColumns({"rule": rule, "decided": verdict})
        rules = rows.sparkSession.createDataFrame(list(rules), "how string, text string")
    return join_rules(materialise(rows, "urls"), rules)


def _labelled(judged: DataFrame) -> DataFrame:
    return judged.filter(F.col("decided").isNotNull()).withColumn("blocked", (F.col("decided") == "block").cast("long"))


def url_filter(pages: DataFrame, rules: Sequence[tuple[str, str]] | DataFrame, labels: DataFrame | None = None, id_col: str = "page_id", url_col: str = "url", n_trees: int = 8, depth: int = 3) -> DataFrame:
    """``id_col, host, path, rule, verdict, score`` of every row: the longest fitting rule's verdict, else the trees'.

    ``rules``: (``allow`` or ``block``, ``host/path``) pairs, or a table ``how, text`` of any size. ``labels`` (``url``,
    ``blocked`` boolean) are the labelled urls that the trees learn from; without them, the urls that a rule decides are.
    ``score`` is the trees' probability of ``block``. ``held_out`` measures the trees.

    Nulls: a null url has empty host and path and is scored as the empty url; a null id is kept. Repeated rows each
    get their row; ties between rules can't be (the longest text wins, of equal texts the one that blocks). Empty tables
    give no rows; if no url or one class only is labelled, the trees are a constant (``allow`` without labels). Urls of
    any length are read whole. Further columns are ignored.
    """
    judged = _judged(_shaped(pick(pages, id=id_col, url=url_col)), rules)
    if labels is None:
        labelled = _labelled(judged)
    else:
        labelled = _shaped(pick(labels, "url", "blocked")).filter(F.col("blocked").isNotNull()).withColumn("blocked", F.col("blocked").cast("long"))
    stats, score = _learn(labelled, n_trees, depth)
    out = _binned(judged, stats, False).withColumn("score", score)
    final = F.coalesce("decided", F.when(F.col("score") > 0.5, "block").otherwise("allow"))
    return out.select(F.col("id").alias(id_col), "host", "path", "rule", final.alias("verdict"), "score")


def held_out(labels: DataFrame, n_trees: int = 8, depth: int = 3) -> DataFrame:
    """``n, accuracy, majority`` of the trees on a fifth of labelled urls (``url, blocked``; by hash) that they didn't learn from.

    ``majority`` is the share of the commoner class there. Null labels are left out; an empty table gives n 0 and nulls.
    """
    rows = _shaped(pick(labels, "url", "blocked")).filter(F.col("blocked").isNotNull()).withColumn("blocked", F.col("blocked").cast("long"))
    rows = materialise(rows.withColumn("asked", F.pmod(F.xxhash64(F.lit("held out"), "url"), F.lit(5)) == 0), "url-labels")
    stats, score = _learn(rows.filter("not asked"), n_trees, depth)
    out = _binned(rows.filter("asked"), stats, False).withColumn("right", ((score > 0.5) == (F.col("blocked") == 1)).cast("double"))
    share = F.avg("blocked")
    return out.agg(F.count("*").alias("n"), F.avg("right").alias("accuracy"), F.greatest(share, 1 - share).alias("majority"))
