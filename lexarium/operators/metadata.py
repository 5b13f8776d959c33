"""Metadata: merging records by precedence, upserts, reviews, duplicate candidates, fuzzy titles."""

import difflib
import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..functions.names import CONFIDENCE, normalize_title
from ..shared import keep as _keep
from . import similarity

#: Origins from strongest to weakest, and the fields of a record: fixed values.
ORIGINS = ["manual", "curated", "resolved", "extracted", "unknown"]
FIELDS = ["title", "authors", "year", "venue", "doi", "arxiv_id", "url"]
SIMILAR = 0.85


def _has(field: str):
    present = F.size(field) > 0 if field == "authors" else F.col(field) > 0 if field == "year" else F.col(field) != ""
    return F.coalesce(present, F.lit(False)) | F.array_contains(F.coalesce("cleared_fields", F.array().cast("array<string>")), field)


def resolve_metadata(records: DataFrame, papers: DataFrame) -> DataFrame:
    """One row for each paper: every field from the strongest record that has it (or clears it), with its origin.

    The confidence is the lowest of the records that gave a field; author ids go with an author list, and come from
    another record only if its list is the same. ``records``: paper_id, origin, confidence, FIELDS, author_ids,
    author_orcids, cleared_fields.
    """
    order = F.array(*[F.lit(x) for x in ORIGINS])
    place = F.array_position(order, F.col("origin"))
    rank = F.struct(F.when(place > 0, place).otherwise(len(ORIGINS) + 1), F.col("origin"))
    picked = [F.min_by(F.struct(F.col(f).alias("v"), "origin", "confidence", "author_ids", "author_orcids"), F.when(_has(f), rank)).alias(f"_{f}") for f in FIELDS]
    lists = F.array_sort(F.collect_list(F.struct(rank.alias("rank"), "authors", "author_ids", "author_orcids", "origin"))).alias("_lists")
    rows = records.groupBy("paper_id").agg(*picked, lists)
    levels = F.array(*[F.lit(c) for c in CONFIDENCE])
    given = F.array_compact(F.array(*[F.col(f"_{f}.confidence") for f in FIELDS]))
    lowest = F.get(levels, (F.array_min(F.transform(given, lambda c: F.array_position(levels, c))) - 1).cast("int"))
    some = lambda a: F.exists(F.coalesce(a, F.array().cast("array<string>")), lambda x: x != "")
    same = F.get(F.filter("_lists", lambda x: x["authors"].eqNullSafe(F.col("_authors.v")) & (some(x["author_ids"]) | some(x["author_orcids"]))), F.lit(0))
    own = some(F.col("_authors.author_ids")) | some(F.col("_authors.author_orcids"))
    names = F.size(F.coalesce(F.col("_authors.v"), F.array().cast("array<string>"))) > 0
    ids = lambda c: F.when(names, F.when(own, F.col(f"_authors.{c}")).otherwise(same[c]))
    origins = F.map_filter(F.create_map(*[x for f in FIELDS for x in (F.lit(f), F.col(f"_{f}.origin"))]), lambda k, v: v.isNotNull())
    empty = {"authors": F.array().cast("array<string>"), "year": F.lit(0)}
    out = rows.select("paper_id", *[F.coalesce(F.col(f"_{f}.v"), empty.get(f, F.lit(""))).alias(f) for f in FIELDS], ids("author_ids").alias("author_ids"), ids("author_orcids").alias("author_orcids"), origins.alias("origins"), F.coalesce(lowest, F.lit("none")).alias("confidence"))
    return papers.select("paper_id").distinct().join(out, "paper_id", "left").withColumn("confidence", F.coalesce("confidence", F.lit("none")))


def upsert(existing: DataFrame, updates: DataFrame, keys: tuple[str, ...] = ("paper_id", "origin"), sequence: str = "seq") -> DataFrame:
    """Rows by key, updates before existing rows, the highest ``sequence`` among updates."""
    both = existing.withColumn("_new", F.lit(0)).withColumn(sequence, F.lit(0)).unionByName(updates.withColumn("_new", F.lit(1)))
    order = Window.partitionBy(*keys).orderBy(F.desc("_new"), F.desc(sequence))
    return both.withColumn("_r", F.row_number().over(order)).filter("_r = 1").drop("_r", "_new", sequence)


def without_rejected(records: DataFrame, rejections: DataFrame) -> DataFrame:
    """Records that no rejection of their paper names by DOI, arXiv id or title; three equi anti joins."""
    for column, key in (("doi", F.lower), ("arxiv_id", F.lower), ("title", normalize_title)):
        mine = rejections.select(F.col("paper_id"), key(F.col(column)).alias("_k")).filter("_k <> ''").distinct()
        records = records.withColumn("_k", key(F.coalesce(column, F.lit("")))).join(mine, ["paper_id", "_k"], "left_anti").drop("_k")
    return records


def unique_owners(papers: DataFrame) -> DataFrame:
    """``kind, value, paper_id``: identifiers (any case) that one paper alone has."""
    rows = papers.select("paper_id", F.explode("identifiers").alias("kind", "value")).select("paper_id", "kind", F.lower("value").alias("value")).distinct()
    return rows.groupBy("kind", "value").agg(F.count("*").alias("n"), F.min("paper_id").alias("paper_id")).filter("n = 1").drop("n")


@F.pandas_udf(DoubleType())
def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Matching characters of two texts by longest common blocks."""
    return pd.Series([difflib.SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b)], dtype="float64")


def title_matches(candidates: DataFrame, titles: DataFrame, threshold: float = SIMILAR) -> DataFrame:
    """``candidate_id, title_id, ratio``: the best fuzzy title of each candidate at the threshold or above; ties by id.

    Ratio is that of matching blocks (Ratcliff/Obershelp), so a pair at ratio r has c = r * (m + n) / 2 characters in common,
    in order: the shorter has at least r / (2 - r) of the longer's length. A character of one title that isn't matched breaks
    three of its 3-grams at most, one of the other title two, so 5c - 2(m + n) - 2 3-grams are common (counted as often as they
    are in both). They are counted in blocks by the grid of ``similarity``, without a row for each common 3-gram; pairs with fewer are
    left out; those that need none (24 characters together at 0.85) are met by length. Both are exact. Equal titles have ratio 1,
    which no other pair has, so they meet by a join. Empty titles match none.
    """
    left = _keep(candidates.select("candidate_id", normalize_title(F.col("title")).alias("x")).filter("x <> ''").distinct(), "asked")
    right = titles.select("title_id", normalize_title(F.col("title")).alias("y")).filter("y <> ''").groupBy("y").agg(F.min("title_id").alias("title_id"))
    right = _keep(right, "titles")
    asked = _keep(left.select("x").distinct().join(right.select(F.col("y").alias("x")), "x", "left_anti"), "unequal")
    m, n = F.length("x"), F.length("y")
    bound = threshold / (2 - threshold)
    need = 5 * F.ceil(threshold * (m + n) / 2 - 1e-9) - 2 * (m + n) - 2

    def grams(rows: DataFrame, text: str) -> DataFrame:
        each = F.transform(F.sequence(F.lit(1), F.length(text) - 2), lambda i: F.substring(F.col(text), i, F.lit(3)))
        some = rows.filter(F.length(text) >= 3).select(text, each.alias("g"))
        again = F.transform("g", lambda g, i: F.xxhash64(g, F.size(F.filter(F.slice("g", F.lit(1), i), lambda h: h == g))))
        return some.select(F.col(text).alias("paper_id"), F.array_sort(again).alias("terms"), F.transform("g", lambda g: F.lit(1.0)).alias("weights"))

    def enough(sums: np.ndarray) -> np.ndarray:
        both = sums + 4  # a title has two 3-grams less than characters
        least = 5 * np.ceil(threshold * both / 2 - 1e-9) - 2 * both - 2
        return np.where(least >= 1, least, np.inf)

    long = similarity.sharing(_keep(grams(right, "y"), "grams"), _keep(grams(asked, "x"), "grams"), enough, right.count(), asked.count())
    lengths = F.explode(F.sequence(F.ceil(bound * m - 1e-9), F.floor(m / bound + 1e-9))).alias("n")
    short = asked.select("x", lengths).join(right.select("y", n.cast("long").alias("n")), "n").filter(need < 1).select("x", "y")
    scored = long.toDF("x", "y").unionByName(short).withColumn("ratio", ratio("x", "y")).filter(F.col("ratio") >= threshold)
    near = scored.join(right, "y").select("x", "title_id", "ratio")
    equal = left.select("x").distinct().join(right, F.col("x") == F.col("y")).select("x", "title_id", F.lit(1.0).alias("ratio"))
    best = F.min_by(F.struct("title_id", "ratio"), F.struct(-F.col("ratio"), F.col("title_id"))).alias("b")
    of_text = near.groupBy("x").agg(best).select("x", "b.*").unionByName(equal)
    return left.join(of_text, "x").groupBy("candidate_id").agg(best).select("candidate_id", "b.title_id", "b.ratio")


def classify_candidates(candidates: DataFrame, owners: DataFrame, titles: DataFrame) -> DataFrame:
    """``candidate_id, status, match``: known by arXiv id, DOI or title, else fresh. The order of the tests is the contract."""
    rows = candidates.select("candidate_id", "title", F.lower(F.coalesce("doi", F.lit(""))).alias("doi"), F.lower(F.coalesce("arxiv_id", F.lit(""))).alias("arxiv"))
    by = lambda kind: owners.filter(F.col("kind") == kind).select(F.col("value").alias(kind), F.col("paper_id").alias(f"by_{kind}"))
    rows = rows.join(by("arxiv"), "arxiv", "left").join(by("doi"), "doi", "left").join(title_matches(candidates, titles).select("candidate_id", F.col("title_id").alias("by_title")), "candidate_id", "left")
    match = F.coalesce("by_arxiv", "by_doi", "by_title")
    return rows.select("candidate_id", F.when(F.col("by_arxiv").isNotNull(), "known_arxiv").when(F.col("by_doi").isNotNull(), "known_doi").when(F.col("by_title").isNotNull(), "known_title").otherwise("fresh").alias("status"), match.alias("match"))


def candidate_keys(arxiv_id: Column, doi: Column, title: Column) -> Column:
    """What candidates are the same by: arXiv id, DOI, and a title that is long enough."""
    plain = normalize_title(title)
    long = (F.length(plain) >= 30) & (F.size(F.split(plain, " ")) >= 5)
    named = lambda kind, c: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(f"{kind}:"), F.lower(c)))
    return F.array_compact(F.array(named("arxiv", arxiv_id), named("doi", doi), F.when(long, F.concat(F.lit("title:"), plain))))


def candidate_groups(candidates: DataFrame, keep=_keep) -> DataFrame:
    """``run_id, seq, label``: candidates that hang together by keys, in any number of steps, have the smallest of their numbers.

    In a round a candidate takes the smallest label among those that share a key with it, then that candidate's label: the
    way to the smallest is halved. Rounds end when no label falls.
    """
    keys = candidate_keys(F.col("arxiv_id"), F.col("doi"), F.col("title"))
    links = keep(candidates.select("run_id", "seq", F.explode(keys).alias("key")), "candidate-keys")
    labels = keep(candidates.select("run_id", "seq", F.col("seq").alias("label")), "candidate-labels")
    while True:
        lowest = links.join(labels, ["run_id", "seq"]).groupBy("run_id", "key").agg(F.min("label").alias("low"))
        near = links.join(lowest, ["run_id", "key"]).groupBy("run_id", "seq").agg(F.min("low").alias("low"))
        step = labels.join(near, ["run_id", "seq"], "left").select("run_id", "seq", F.col("label").alias("old"), F.coalesce("low", "label").alias("label"))
        step = keep(step, "candidate-step")
        jump = step.select("run_id", F.col("seq").alias("label"), F.col("label").alias("far"))
        step = keep(step.join(jump, ["run_id", "label"]).select("run_id", "seq", "old", F.col("far").alias("label")), "candidate-labels")
        labels = step.drop("old")
        if step.filter("label < old").isEmpty():
            return labels


CANDIDATE = "run_id string, seq long, title string, year int, sources array<string>, arxiv_id string, doi string, abstract string, url string"


def merge_candidates(candidates: DataFrame, keep=_keep) -> DataFrame:
    """Candidates of one run merged in order: each joins the first earlier one that it shares a key with.

    What a merge does depends on the order, but only within candidates that hang together by keys (``candidate_groups``):
    those are folded each on its own, in order, one row in hand at a time, so that a run isn't one task. Columns: run_id,
    seq, title, year, sources, arxiv_id, doi, abstract, url.
    """
    columns = [c.split()[0] for c in CANDIDATE.split(", ")]

    def keys(r: dict) -> list[str]:
        title = re.sub("[^a-z0-9]+", " ", r["title"].lower()).strip()
        named = [f"arxiv:{r['arxiv_id'].lower()}"] * bool(r["arxiv_id"]) + [f"doi:{r['doi'].lower()}"] * bool(r["doi"])
        return named + [f"title:{title}"] * (len(title) >= 30 and len(title.split()) >= 5)

    def add(out: list[dict], at: dict[str, int], row: dict) -> None:
        row["sources"] = list(row["sources"])
        hit = next((at[k] for k in keys(row) if k in at), None)
        if hit is None:
            hit = len(out)
            out.append(row)
        else:
            own = out[hit]
            years = [y for y in (own["year"], row["year"]) if y > 0]
            own["year"] = min(years, default=0)
            own["sources"] = sorted({*own["sources"], *row["sources"]}, key=str.lower)
            own["abstract"] = max(own["abstract"], row["abstract"], key=len)
            for f in ("arxiv_id", "doi", "url"):
                own[f] = own[f] or row[f]
        at.update({k: hit for k in keys(out[hit])})

    def fold(batches):
        group, out, at = None, [], {}
        for pdf in batches:
            done = []
            for row in pdf.to_dict("records"):
                own = (row["run_id"], row.pop("label"))
                if own != group:
                    done += out
                    group, out, at = own, [], {}
                add(out, at, row)
            yield pd.DataFrame(done, columns=columns)
        yield pd.DataFrame(out, columns=columns)

    rows = candidates.select(*columns).join(candidate_groups(candidates, keep), ["run_id", "seq"])
    rows = rows.repartition("run_id", "label").sortWithinPartitions("run_id", "label", "seq")
    return rows.select(*columns, "label").mapInPandas(fold, CANDIDATE)


def filter_recent(candidates: DataFrame, min_year: int) -> DataFrame:
    """Candidates of a year or later; unknown years pass."""
    return candidates.filter((F.col("year") == 0) | (F.col("year") >= min_year))


def index_report(metadata: DataFrame, papers: DataFrame, records: DataFrame) -> DataFrame:
    """The counts of a metadata build, one row: papers, with an identifier, citable, by origin of records, weak, full texts, those with strong authors, with author ids, and from stubs."""
    none = F.array().cast("array<string>")
    some = lambda c: F.size(F.coalesce(c, none)) > 0
    has = lambda c: F.coalesce(c, F.lit("")) != ""
    rows = metadata.join(papers.select("paper_id", F.col("document_kind").alias("_kind"), F.col("bibliography").isNotNull().alias("_stub")), "paper_id")
    full = F.col("_kind") == "full"
    counts = rows.agg(
        F.count("*").alias("n_papers"), F.count_if(has("doi") | has("arxiv_id") | has("url")).alias("n_with_identifier"), F.count_if(has("title") & some("authors") & (F.coalesce("year", F.lit(0)) > 0)).alias("n_citable"), F.count_if(F.col("confidence") == "weak").alias("n_weak"), F.count_if(full).alias("n_full_texts"),
        F.count_if(full & some("authors") & (F.col("confidence") == "strong")).alias("n_full_with_strong_authors"), F.count_if(some("author_ids")).alias("n_with_author_ids"), F.count_if(~full & F.col("_stub")).alias("n_from_stubs"),
    )
    origins = records.agg(*[F.count_if(F.col("origin") == o).alias(f"n_{o}") for o in ("curated", "resolved", "manual")])
    return counts.crossJoin(F.broadcast(origins))


def build_report(metadata: DataFrame) -> DataFrame:
    """Counts of the resolved metadata in one pass."""
    filled = lambda f: F.count_if(F.size(f) > 0 if f == "authors" else F.col(f) > 0 if f == "year" else F.coalesce(F.col(f), F.lit("")) != "").alias(f"with_{f}")
    return metadata.agg(F.count("*").alias("n_papers"), *[filled(f) for f in FIELDS], *[F.count_if(F.col("confidence") == c).alias(c) for c in CONFIDENCE])
