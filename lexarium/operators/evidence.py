"""Evidence on title pages, and what follows from it: triage, work lists, resolution, plans and downloads.

Everything that the network or a PDF parser gives is a table here: page texts, responses, page counts. So each step is a
join and a ladder of conditions, and a stored run can be replayed.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import ascii_fold, normalize_title, surname
from ..functions.text import printable
from .metadata import SIMILAR, ratio

#: Lines of a page that may be its title, authors whose surnames are looked for, least size of a title, pages of a full
#: text, licences that allow a download, and bytes that a PDF begins with: fixed values.
TITLE_LINES, SURNAMES, TITLE_CHARS, TITLE_WORDS, FULL_PAGES = 5, 10, 30, 5, 2
FREE_LICENSES = ["public-domain", "cc-by", "cc-by-sa"]
PDF_HEAD = "%PDF-"
EXCERPT = 1500


def title_candidates(page: Column, filename: Column | None = None) -> Column:
    """Normalised texts that may be a paper's title: the file's name, the page's first lines and each joined with the next, if long enough."""
    lines = F.slice(F.filter(F.transform(F.split(F.coalesce(page, F.lit("")), "\r?\n"), lambda x: F.trim(x)), lambda x: x != ""), 1, TITLE_LINES)
    pairs = F.transform(F.slice(lines, F.lit(2), F.greatest(F.size(lines) - 1, F.lit(0))), lambda x, i: F.concat_ws(" ", F.get(lines, i), x))
    stem = F.array(F.regexp_replace(filename, r"(?i)\.pdf$", "")) if filename is not None else F.array().cast("array<string>")
    every = F.transform(F.concat(stem, lines, pairs), lambda x: normalize_title(x))
    return F.array_distinct(F.filter(every, lambda x: (F.length(x) >= TITLE_CHARS) & (F.size(F.split(x, " ")) >= TITLE_WORDS)))


def _words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(ascii_fold(text)), F.lit("[a-z0-9]+"), F.lit(0))


def check_title_pages(rows: DataFrame) -> DataFrame:
    """``paper_id, readable, title_ratio, surnames_checked, surnames_found`` of records (``paper_id, page, title, authors``) against the text of page 1.

    The ratio is that of the title and the nearest candidate on the page; a surname counts if all its words are on the page.
    """
    page = F.coalesce("page", F.lit(""))
    own = rows.select("paper_id", page.alias("page"), normalize_title(F.coalesce("title", F.lit(""))).alias("title"), F.coalesce("authors", F.array().cast("array<string>")).alias("authors"))
    pairs = own.filter("title <> ''").select("paper_id", "title", F.explode(title_candidates(F.col("page"))).alias("candidate"))
    best = pairs.withColumn("ratio", ratio("candidate", "title")).groupBy("paper_id").agg(F.max("ratio").alias("title_ratio"))
    names = F.filter(F.transform(F.slice("authors", 1, SURNAMES), lambda a: _words(surname(a))), lambda w: F.size(w) > 0)
    counted = own.withColumns({"names": names, "words": _words(F.col("page"))})
    found = F.size(F.filter("names", lambda n: F.size(F.array_except(n, F.col("words"))) == 0))
    readable = F.trim("page") != ""
    zero = lambda c: F.when(readable, c).otherwise(0)
    out = counted.select("paper_id", readable.alias("readable"), zero(F.size("names")).alias("surnames_checked"), zero(found).alias("surnames_found")).join(best, "paper_id", "left")
    return out.select("paper_id", "readable", F.when(F.col("readable"), F.coalesce("title_ratio", F.lit(0.0))).otherwise(0.0).alias("title_ratio"), "surnames_checked", "surnames_found")


def verdict(min_share: float | None = None, max_share: float | None = None) -> Column:
    """``unreadable, confirmed, foreign`` or ``unconfirmed`` by the columns of a check. Without a bound, nothing is confirmed or foreign."""
    checked, share = F.col("surnames_checked") > 0, F.try_divide("surnames_found", "surnames_checked")
    title = F.col("title_ratio") >= SIMILAR
    yes = title & checked & (share >= min_share) if min_share is not None else F.lit(False)
    no = ~title & checked & (share <= max_share) if max_share is not None else F.lit(False)
    return F.when(~F.col("readable"), "unreadable").when(yes, "confirmed").when(no, "foreign").otherwise("unconfirmed")


def check_summary() -> Column:
    """The figures of a check in a few words."""
    figures = F.format_string("title %.2f, authors %d/%d on page 1", F.col("title_ratio"), F.col("surnames_found"), F.col("surnames_checked"))
    return F.when(F.col("readable"), figures).otherwise("page 1 without text")


def triage(papers: DataFrame, records: DataFrame, pages: DataFrame, today: str, min_share: float | None = None, max_share: float | None = None) -> dict[str, DataFrame]:
    """What becomes of the stored resolved records of weak papers: ``decisions`` (paper_id, action, verdict, note), ``records`` and ``rejections``.

    ``pages``: paper_id, page (the text of page 1 of files that are there). Confirmed records become strong, foreign ones go
    and are noted as rejected, others stay; without a full text, a record or a file nothing can be checked.
    """
    stored = records.filter("origin = 'resolved'").select("paper_id", F.col("title").alias("stored_title"), F.col("authors").alias("stored_authors"), "doi", "arxiv_id", F.lit(True).alias("has_record"))
    rows = papers.select("paper_id", "document_kind").join(stored, "paper_id", "left").join(pages.select("paper_id", "page", F.lit(True).alias("has_page")), "paper_id", "left")
    able = (F.col("document_kind") == "full") & F.col("has_record") & F.col("has_page")
    checks = check_title_pages(rows.filter(able).select("paper_id", "page", F.col("stored_title").alias("title"), F.col("stored_authors").alias("authors")))
    checks = checks.withColumns({"verdict": verdict(min_share, max_share), "summary": check_summary()})
    why = F.when(F.col("document_kind") != "full", "no full text").when(F.col("has_record").isNull(), "no resolved record").when(F.col("has_page").isNull(), "no file")
    out = rows.join(checks.select("paper_id", "verdict", "summary"), "paper_id", "left")
    action = F.when(why.isNotNull(), "not_checkable").when(F.col("verdict") == "confirmed", "upgraded").when(F.col("verdict") == "foreign", "rejected").otherwise("unchanged")
    out = out.withColumns({"action": action, "note": F.coalesce(why, "summary")})
    acted = out.filter(F.col("action").isin("upgraded", "rejected")).select("paper_id", "action", "note", F.lit("resolved").alias("origin"))
    both = records.join(acted, ["paper_id", "origin"], "left")
    up = F.col("action") == "upgraded"
    proof = F.concat_ws("; ", F.nullif(F.coalesce("evidence", F.lit("")), F.lit("")), F.concat(F.lit("title and authors on page 1 ("), "note", F.lit(")")))
    kept = both.filter("action is null or action = 'upgraded'").withColumns({"confidence": F.when(up, "strong").otherwise(F.col("confidence")), "evidence": F.when(up, proof).otherwise(F.col("evidence"))}).select(*records.columns)
    gone = out.filter("action = 'rejected'").select("paper_id", "doi", "arxiv_id", F.col("stored_title").alias("title"), F.concat(F.lit("another paper by page 1 ("), "note", F.lit(")")).alias("reason"), F.lit(today).alias("date"))
    return {"decisions": out.select("paper_id", "action", F.coalesce("verdict", F.lit("")).alias("verdict"), "note"), "records": kept, "rejections": gone}


def worklist(papers: DataFrame, pages: DataFrame, min_share: float | None = None, max_share: float | None = None) -> DataFrame:
    """``paper_id, filename, reason, check, verdict, title, authors, excerpt``: weak papers with what is known, for a person or a model to suggest from.

    The excerpt is foreign text: printable, cut, without the marks that fence a block.
    """
    rows = papers.select("paper_id", "source_uri", "document_kind", "title", "authors").join(pages.select("paper_id", "page", F.lit(True).alias("has_page")), "paper_id", "left")
    full = F.col("document_kind") == "full"
    rows = rows.withColumn("page", F.when(full, F.col("page")))
    checks = check_title_pages(rows.filter("has_page and page is not null")).withColumns({"verdict": verdict(min_share, max_share), "check": check_summary()})
    out = rows.join(checks.select("paper_id", "verdict", "check"), "paper_id", "left")
    reason = F.when(~full, "weak reference entry without a title page").when(F.col("has_page").isNull(), "no file to check").otherwise("weak, and not confirmed by page 1")
    name = F.url_decode(F.replace(F.element_at(F.split("source_uri", "/"), -1), F.lit("+"), F.lit("%2B")))
    excerpt = F.translate(printable(F.coalesce("page", F.lit("")), EXCERPT), "`~", "'-")
    return out.select("paper_id", name.alias("filename"), reason.alias("reason"), F.coalesce("check", F.lit("")).alias("check"), F.coalesce("verdict", F.lit("")).alias("verdict"), "title", F.slice("authors", 1, SURNAMES).alias("authors"), excerpt.alias("excerpt"))


def without_matches(rows: DataFrame, rejections: DataFrame) -> DataFrame:
    """``rows`` with ``rejected``: whether a rejection of the paper names the row's DOI, arXiv id or title."""
    flags = []
    for column, key in (("doi", F.lower), ("arxiv_id", F.lower), ("title", normalize_title)):
        mine = rejections.select("paper_id", key(F.trim(F.coalesce(column, F.lit("")))).alias(f"_{column}"), F.lit(True).alias(f"_is_{column}")).filter(F.col(f"_{column}") != "").distinct()
        rows = rows.withColumn(f"_{column}", key(F.trim(F.coalesce(column, F.lit(""))))).join(mine, ["paper_id", f"_{column}"], "left").drop(f"_{column}")
        flags.append(f"_is_{column}")
    return rows.withColumn("rejected", F.coalesce(*flags, F.lit(False))).drop(*flags)


def resolve_targets(attempts: DataFrame, rejections: DataFrame) -> DataFrame:
    """``paper_id, outcome, match, note`` and the chosen record's ``doi, arxiv_id, title, verdict`` of stored attempts.

    ``attempts``: paper_id, ordinal, match (``doi``, ``title`` or ``arxiv``), status (HTTP), found, doi, arxiv_id, title,
    verdict (of the title page, null if unchecked). They are tried in order: an exhausted quota (429) ends a paper's search,
    rejected and foreign hits are passed over, the first that is left is taken.
    """
    before = Window.partitionBy("paper_id").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, 0)
    rows = without_matches(attempts, rejections).withColumn("spent", F.max((F.col("status") == 429).cast("int")).over(before) == 1)
    good = F.col("found") & ~F.col("spent") & ~F.col("rejected") & (F.coalesce("verdict", F.lit("")) != "foreign")
    out = rows.groupBy("paper_id").agg(
        F.min_by(F.struct("match", "doi", "arxiv_id", "title", "verdict"), F.when(good, F.col("ordinal"))).alias("r"), F.max("spent").alias("spent"),
        F.max(F.col("found") & F.col("rejected")).alias("any_rejected"), F.max(F.col("found") & (F.coalesce("verdict", F.lit("")) == "foreign")).alias("any_foreign"),
    )
    done = F.col("r").isNotNull()
    note = F.when(done, F.concat(F.lit("by "), F.col("r.match"))).when(F.col("spent"), "quota exhausted").when(F.col("any_rejected"), "only rejected hits").when(F.col("any_foreign"), "only foreign hits").otherwise("no reliable hit")
    none = lambda c: F.coalesce(F.col(f"r.{c}"), F.lit("")).alias(c)
    return out.select("paper_id", F.when(done, "resolved").otherwise("unresolved").alias("outcome"), none("match"), note.alias("note"), none("doi"), none("arxiv_id"), none("title"), none("verdict"))


def import_suggestions(resolved: DataFrame, papers: DataFrame, pages: DataFrame) -> DataFrame:
    """``paper_id, outcome`` of suggestions that were resolved (``resolve_targets`` with ``verdict``): only what page 1 confirms is accepted."""
    able = papers.filter("document_kind = 'full'").select("paper_id").join(pages.select("paper_id").distinct(), "paper_id", "left_semi").withColumn("able", F.lit(True))
    rows = resolved.join(able, "paper_id", "left")
    outcome = F.when(F.col("able").isNull(), "not_checkable").when(F.col("outcome") != "resolved", "unresolved").when(F.col("verdict") == "confirmed", "accepted").otherwise("not_confirmed")
    return rows.select("paper_id", outcome.alias("outcome"))


def plan_references(requests: DataFrame, owners: DataFrame, stubs: DataFrame) -> DataFrame:
    """``line_no, kind, value, action, reason`` of a list of identifiers (``line_no, kind, value``), before anything is asked.

    ``owners``: kind, value, paper_id of the corpus; ``stubs``: kind, value, quarantined of files that wait. In order: no
    identifier, a line again, in the corpus, a stub is there, else pending.
    """
    rows = requests.withColumns({"k": F.col("kind"), "v": F.lower("value")})
    nth = F.row_number().over(Window.partitionBy("k", "v").orderBy("line_no"))
    own = owners.select(F.col("kind").alias("k"), F.lower("value").alias("v"), "paper_id").distinct()
    there = stubs.groupBy(F.col("kind").alias("k"), F.lower("value").alias("v")).agg(F.min("quarantined").alias("quarantined"))
    rows = rows.withColumn("nth", nth).join(own, ["k", "v"], "left").join(there, ["k", "v"], "left")
    step = lambda action, reason: F.struct(F.lit(action).alias("action"), F.lit(reason).alias("reason"))
    what = (
        F.when(F.col("kind") == "", step("invalid", "")).when(F.col("nth") > 1, step("skipped", "duplicate_line")).when(F.col("paper_id").isNotNull(), step("skipped", "in_corpus"))
        .when(F.col("quarantined"), step("skipped", "quarantined")).when(F.col("quarantined").isNotNull(), step("skipped", "stub_exists")).otherwise(step("pending", ""))
    )
    return rows.withColumn("x", what).select("line_no", "kind", "value", "x.action", "x.reason")


#: Fields that a service's answer gives to a stub, and the address that stands for an arXiv id where works are asked for by DOI: fixed values.
FOUND = ["title", "authors", "author_ids", "author_orcids", "year", "venue", "doi", "arxiv_id", "url", "abstract", "source", "source_url"]
ARXIV_DOI = "10.48550/arXiv."


def reference_requests(pending: DataFrame) -> DataFrame:
    """``line_no, source, identifier``: what is asked of each service for the pending lines of a plan (``line_no, kind, value``)."""
    arxiv = F.col("kind") == "arxiv"
    works = pending.select("line_no", F.lit("works").alias("source"), F.when(arxiv, F.concat(F.lit(ARXIV_DOI), "value")).otherwise(F.col("value")).alias("identifier"))
    return works.unionByName(pending.filter(arxiv).select("line_no", F.lit("feed").alias("source"), F.col("value").alias("identifier")))


def resolve_references(pending: DataFrame, works: DataFrame, feeds: DataFrame) -> DataFrame:
    """``line_no, kind, value, action, note`` and FOUND of the pending lines of a plan (``line_no, kind, value``): ``written`` or ``unresolved``.

    ``works`` and ``feeds`` are the services' answers by line (``line_no`` and FOUND, with ``note`` where nothing came).
    A work's record goes first. The feed is looked at where an arXiv id is known and the work lacks title or abstract:
    it lends its abstract to a work with a title, and its whole record to one without. Without a title there is no
    record; without an abstract there is, with a hint to add one.
    """
    empty = {"authors": F.array().cast("array<string>"), "author_ids": F.array().cast("array<string>"), "author_orcids": F.array().cast("array<string>"), "year": F.lit(0)}
    fields = [*FOUND, "note"]
    side = lambda df, s: df.select("line_no", F.struct(*[F.coalesce(c, empty.get(c, F.lit(""))).alias(c) for c in fields]).alias(s))
    rows = pending.select("line_no", "kind", "value").join(side(works, "w"), "line_no", "left").join(side(feeds, "f"), "line_no", "left")
    text = lambda c: F.trim(F.coalesce(F.col(c), F.lit("")))
    arxiv = F.when(F.col("kind") == "arxiv", F.col("value")).otherwise(text("w.arxiv_id"))
    asked = (arxiv != "") & ((text("w.title") == "") | (text("w.abstract") == ""))
    rows = rows.withColumns({"arxiv": arxiv, "f": F.when(asked, F.col("f"))})
    by_work, by_feed = text("w.title") != "", text("f.title") != ""
    own = lambda c: F.when(by_work, F.col(f"w.{c}")).when(by_feed, F.col(f"f.{c}")).otherwise(empty.get(c, F.lit("")))
    out = {c: own(c) for c in FOUND}
    out["abstract"] = F.when(by_work & (text("w.abstract") == ""), text("f.abstract")).otherwise(own("abstract"))
    given = lambda kind: F.when(F.col("kind") == kind, F.col("value")).otherwise("")
    out["doi"] = F.coalesce(F.nullif(own("doi"), F.lit("")), given("doi"))
    out["arxiv_id"] = F.coalesce(F.nullif(own("arxiv_id"), F.lit("")), F.when(by_feed & ~by_work, F.col("arxiv")).otherwise(given("arxiv")))
    rows = rows.withColumns(out).withColumn("found", by_work | by_feed)
    why = F.array_join(F.array_remove(F.array(text("w.note"), text("f.note")), ""), "; ")
    note = F.when(~F.col("found"), F.coalesce(F.nullif(why, F.lit("")), F.lit("no source gives a title"))).when(F.trim("abstract") == "", "add the abstract by hand").otherwise("")
    return rows.select("line_no", "kind", "value", F.when(F.col("found"), "written").otherwise("unresolved").alias("action"), note.alias("note"), *FOUND)


def process_references(resolved: DataFrame, inbox: str, retrieved_at: str) -> int:
    """Stub files in ``inbox`` of what was resolved (``resolve_references``); the number written."""
    from ..sources.sinks import build_stubs, write_files

    own = resolved.filter("action = 'written'").drop("line_no", "action").withColumn("retrieved_at", F.lit(retrieved_at))
    return write_files(build_stubs(own), inbox)


def download_outcomes(candidates: DataFrame, responses: DataFrame) -> DataFrame:
    """``candidate_id, outcome`` of candidates (``candidate_id, title, url, license``) and their responses (``candidate_id, status, head, n_pages, page``).

    Hopeless cases end before any response counts: no licence, one that isn't free, no link. Then the status, the signature,
    the number of pages and the title on page 1.
    """
    rows = candidates.join(responses, "candidate_id", "left")
    title = normalize_title(F.coalesce("title", F.lit("")))
    fits = rows.filter((F.length(title) >= TITLE_CHARS) & (F.size(F.split(title, " ")) >= TITLE_WORDS)).select("candidate_id", title.alias("t"), F.explode(title_candidates(F.col("page"))).alias("c"))
    best = fits.withColumn("ratio", ratio("c", "t")).groupBy("candidate_id").agg(F.max("ratio").alias("best"))
    license_ = F.lower(F.trim(F.coalesce("license", F.lit(""))))
    outcome = (
        F.when(license_ == "", "no_license").when(~license_.isin(FREE_LICENSES), "license_not_whitelisted").when(~F.coalesce("url", F.lit("")).rlike("^https?://"), "no_url")
        .when(F.coalesce("status", F.lit(0)) != 200, "http_error").when(~F.coalesce("head", F.lit("")).startswith(PDF_HEAD), "not_a_pdf").when(F.coalesce("n_pages", F.lit(0)) < FULL_PAGES, "too_short")
        .when(F.coalesce("best", F.lit(0.0)) < SIMILAR, "title_mismatch").otherwise("downloaded")
    )
    return rows.join(best, "candidate_id", "left").select("candidate_id", outcome.alias("outcome"))


def community_queries(communities: DataFrame, terms: int = 3) -> DataFrame:
    """``query_id, terms`` from the keywords of communities (``community_id, keywords``) that have any."""
    return communities.filter(F.size("keywords") > 0).select(F.concat(F.lit("C"), F.col("community_id").cast("string")).alias("query_id"), F.slice("keywords", 1, terms).alias("terms"))


def seed_queries(papers: DataFrame, stop: list[str], terms: int = 3) -> DataFrame:
    """``query_id, terms`` from the titles of papers (``paper_id, source_uri``) that have telling words."""
    from ..functions.names import title_from_uri, title_terms

    found = title_terms(title_from_uri(F.col("source_uri")), stop)
    return papers.select(F.concat(F.lit("S"), F.substring("paper_id", 1, 8)).alias("query_id"), F.slice(found, 1, terms).alias("terms")).filter(F.size("terms") > 0)


def request_urls(queries: DataFrame, limit: int = 10) -> DataFrame:
    """``query_id, source, url``: the addresses that two public services answer a query's terms at."""
    quoted = lambda c: F.replace(F.url_encode(c), F.lit("+"), F.lit("%20"))
    three = F.array_join(F.transform(F.slice("terms", 1, 3), lambda t: F.concat(F.lit('all:"'), t, F.lit('"'))), " AND ")
    arxiv = F.concat(F.lit("https://export.arxiv.org/api/query?search_query="), quoted(three), F.lit(f"&max_results={limit}&sortBy=relevance"))
    works = F.concat(F.lit("https://api.openalex.org/works?search="), quoted(F.array_join("terms", " ")), F.lit(f"&per-page={limit}"))
    both = F.explode(F.array(F.struct(F.lit("arxiv").alias("source"), arxiv.alias("url")), F.struct(F.lit("openalex").alias("source"), works.alias("url"))))
    return queries.select("query_id", both.alias("x")).select("query_id", "x.*")


def fetch(requests: DataFrame, get) -> DataFrame:
    """``query_id, source, url, status, payload, note`` of requests by a port ``get(url) -> (status, text)``, called in order on the driver: services allow one request at a time.

    A failure is a row with status 0 and its reason. The requests of a run are few (limits bound them).
    """
    out = []
    for r in requests.orderBy("query_id", "source").collect():
        try:
            status, payload = get(r.url)
            out.append((r.query_id, r.source, r.url, status, payload if status == 200 else "", "" if status == 200 else f"HTTP {status}"))
        except Exception as e:  # a port of the user's: reported, not fatal
            out.append((r.query_id, r.source, r.url, 0, "", f"{type(e).__name__}: {e}"))
    return requests.sparkSession.createDataFrame(out, "query_id string, source string, url string, status int, payload string, note string")


def discover(responses: DataFrame, owners: DataFrame, titles: DataFrame, min_year: int, run_id: str = "run") -> DataFrame:
    """Candidates of stored responses (``query, source, payload``), merged, recent and with their status (``fresh`` or known).

    Found, merged and known ones can be counted on the result, as no candidate is dropped but for its year.
    """
    from ..sources.readers import parse_arxiv, parse_openalex
    from .metadata import classify_candidates, filter_recent, merge_candidates

    columns = ["title", "year", "sources", "arxiv_id", "doi", "abstract", "url"]
    parts = [parse_arxiv(responses.filter("source = 'arxiv'")), parse_openalex(responses.filter("source = 'openalex'"))]
    found = reduce(DataFrame.unionByName, [p.select("query", *columns) for p in parts])
    order = Window.partitionBy("run_id").orderBy("query", "title", "arxiv_id", "doi")
    rows = found.withColumn("run_id", F.lit(run_id)).withColumn("seq", F.row_number().over(order).cast("long"))
    merged = filter_recent(merge_candidates(rows.select("run_id", "seq", *columns)), min_year)
    merged = merged.withColumn("candidate_id", F.concat_ws("-", "run_id", F.col("seq").cast("string")))
    return merged.join(classify_candidates(merged, owners, titles), "candidate_id")
