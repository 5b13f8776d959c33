"""The tools that a client calls: each answers with a dictionary, or with an error envelope.

A tool reads the published snapshot. Answers are bounded (50 rows of a list, 900,000 bytes), so they are collected.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .errors import DomainError, check_count, guard
from .operators import graph, lexical, persons, records, retrieval
from .plans import snapshot
from .sources import readers, sinks


def _rows(df: DataFrame, *order: str) -> list[dict]:
    return [r.asDict(recursive=True) for r in (df.orderBy(*order) if order else df).collect()]


class Tools:
    """``root``: where snapshots are published; ``store``: the metadata store that corrections are written to.

    The opened snapshot is held until another one is published.
    """

    def __init__(self, spark: SparkSession, root: str, store: str | None = None, provider: Callable[[str], str] | None = None):
        self.spark, self.root, self.store, self.provider = spark, root, store, provider
        self._pointer: str | None = None
        self._index: retrieval.Index | None = None

    def index(self) -> retrieval.Index:
        pointer = sinks.read_text(self.spark, f"{self.root}/{snapshot.POINTER}")
        if self._index is None or pointer != self._pointer:
            before, self._index = self._index, snapshot.preload(snapshot.open_index(self.spark, self.root))
            self._pointer = pointer
            if before is not None:
                snapshot.release(before)
        return self._index

    def _asked(self, query: str) -> tuple[retrieval.Index, DataFrame]:
        if not query.strip():
            raise DomainError("invalid_input", "empty query")
        queries = self.spark.createDataFrame([("q", query)], "query_id string, query string")
        return self.index(), queries

    def _citations(self, index: retrieval.Index, hits: DataFrame) -> list[dict]:
        return _rows(retrieval.cited(index, hits).drop("query_id"), "rank")

    def _call(self, produce: Callable[[], dict]) -> dict:
        result, error = guard(produce)
        lexical.let_go()
        return error if error is not None else result

    # --- search ---------------------------------------------------------------------------------------------------

    def search_basic(self, query: str, k: int = 5) -> dict:
        def run():
            index, queries = self._asked(query)
            return {"query": query, "citations": self._citations(index, retrieval.search_basic(index, queries, k))}

        return self._call(run)

    def search_local(self, query: str, k: int = 5, fan_out: int = 5) -> dict:
        def run():
            index, queries = self._asked(query)
            parts = retrieval.search_local(index, queries, k, fan_out=fan_out)
            fan = _rows(retrieval.cited(index, parts["fan_out"]).drop("query_id"), "neighbor") if fan_out else []
            return {"query": query, "seeds": self._citations(index, parts["seeds"]), "neighborhood": self._citations(index, parts["neighborhood"]), "fan_out": sorted(fan, key=lambda r: (-r["weight"], r["neighbor"]))}

        return self._call(run)

    def search_global(self, query: str, k: int = 5) -> dict:
        def run():
            index, queries = self._asked(query)
            return {"query": query, "communities": _rows(retrieval.search_global(index, queries, k).drop("query_id"), "rank")}

        return self._call(run)

    def search_drift(self, query: str, k: int = 6) -> dict:
        def run():
            index, queries = self._asked(query)
            parts = retrieval.search_drift_parts(index, queries, k)
            found = self._citations(index, parts["hits"])
            matches = _rows(retrieval.community_matches(index, parts["communities"]).drop("query_id"), "rank")
            return {"query": query, "communities": matches, "fallback": any(r["fallback"] for r in found), "citations": found}

        return self._call(run)

    def search_text(self, phrase: str | None = None, prefix: str | None = None, near: Sequence[str] | None = None, distance: int = 10, paper_ids: Sequence[str] | None = None, limit: int = 20) -> dict:
        def run():
            index = self.index()
            pos = index.need("positions")
            if sum(x is not None for x in (phrase, prefix, near)) != 1:
                raise DomainError("invalid_input", "one of phrase, prefix and near")
            hits = lexical.near_hits(pos, list(near), distance) if near is not None else lexical.phrase_hits(pos, phrase if phrase is not None else prefix, prefix is not None)
            only = self.spark.createDataFrame([(p,) for p in paper_ids], "paper_id string") if paper_ids is not None else None
            found = _rows(lexical.text_matches(pos, hits, index.chunks, only, limit, index.lengths), "rank")
            return {"matches": found, "total": found[0]["total"] if found else 0}

        return self._call(run)

    # --- papers ---------------------------------------------------------------------------------------------------

    def get_paper(self, paper_id: str) -> dict:
        return self._call(lambda: _rows(retrieval.get_paper(self.index(), paper_id))[0])

    def get_paper_file(self, paper_id: str) -> dict:
        return self._call(lambda: _rows(retrieval.get_paper_file(self.index(), paper_id))[0])

    def get_reference(self, paper_id: str) -> dict:
        return self._call(lambda: _rows(retrieval.get_reference(self.index(), paper_id))[0])

    def get_citations(self, paper_id: str, limit: int = 50) -> dict:
        def run():
            index = self.index()
            rows = _rows(graph.get_citations(index.need("citations"), index.need("papers"), paper_id, limit), "paper_id")
            part = lambda d: [r for r in rows if r["direction"] == d]
            return {"paper_id": paper_id, **{d: part(d) for d in ("cites", "cited_by")}, **{f"{d}_total": next((r["total"] for r in part(d)), 0) for d in ("cites", "cited_by")}}

        return self._call(run)

    def list_topics(self, min_size: int = 2, limit: int = 50, community_id: int | None = None) -> dict:
        def run():
            index = self.index()
            if community_id is not None:
                return _rows(retrieval.get_topic(index, community_id))[0]
            if min_size < 1:
                raise DomainError("invalid_input", "min_size is 1 at least")
            rows = _rows(graph.list_topics(index.need("communities"), min_size, limit))
            return {"topics": rows, "total": rows[0]["total"] if rows else 0, "truncated": bool(rows and rows[0]["truncated"])}

        return self._call(run)

    # --- persons --------------------------------------------------------------------------------------------------

    def _coverage(self) -> dict:
        index = self.index()
        return _rows(persons.coverage(index.need("authors"), index.need("papers")))[0]

    def search_authors(self, name: str, limit: int = 10) -> dict:
        def run():
            index = self.index()
            rows = _rows(persons.candidates(index.need("authors"), index.need("metadata"), name, limit), "rank")
            if not rows:
                raise DomainError("not_found", f"no person like {name!r}", coverage=self._coverage())
            return {"candidates": rows, "ambiguous": rows[0]["ambiguous"], "coverage": self._coverage()}

        return self._call(run)

    def get_author(self, person_key: str, limit: int = 50) -> dict:
        def run():
            index = self.index()
            parts = persons.profile(index.need("authors"), index.need("metadata"), person_key, index.members, index.communities, limit)
            return {**_rows(parts.pop("head"))[0], **{k: _rows(v) for k, v in parts.items()}, "coverage": self._coverage()}

        return self._call(run)

    def search_author_papers(self, person_key: str, query: str, k: int = 5) -> dict:
        def run():
            index = self.index()
            return {"person_key": person_key, "citations": self._citations(index, retrieval.search_author_papers(index, person_key, query, k)), "coverage": self._coverage()}

        return self._call(run)

    def get_author_citations(self, person_key: str, limit: int = 50) -> dict:
        def run():
            index = self.index()
            check_count("limit", limit)
            if index.need("authors").filter(F.col("person_key") == person_key).isEmpty():
                raise DomainError("not_found", f"no person {person_key}")
            rows = _rows(persons.person_citations(index.authors, index.need("citations"), person_key, limit))
            order = lambda d: sorted((r for r in rows if r["direction"] == d), key=lambda r: (-len(r["via"]), r["paper_id"]))
            return {"person_key": person_key, "cites": order("cites"), "cited_by": order("cited_by")}

        return self._call(run)

    # --- answers and corrections ----------------------------------------------------------------------------------

    def answer_question(self, query: str, mode: str = "auto", k: int = 5, synthesize: bool = False) -> dict:
        def run():
            index = self.index()
            out = retrieval.answer_question(index, query, mode, k, self.provider if synthesize else None)
            ids = list(dict.fromkeys(e["paper_id"] for e in out["evidence"]))
            found = {r["paper_id"]: r for r in _rows(retrieval.references(index.need("metadata").filter(F.col("paper_id").isin(ids))))} if ids else {}
            return out | {"references": [found[i] for i in ids if i in found]}

        return self._call(run)

    def correct_paper_metadata(self, paper_id: str, evidence: str, clear_fields: Sequence[str] = (), **fields) -> dict:
        """Set or clear fields of a paper's manual record in the store; it takes effect with the next build."""

        def run():
            if self.store is None:
                raise DomainError("unavailable", "no metadata store is set")
            have = sinks.exists(self.spark, self.store)
            old = readers.read_store(self.spark, self.store, sinks.STORE_VERSION) if have else self.spark.createDataFrame([], STORE_ROWS)
            given = {k: v for k, v in fields.items() if v is not None}
            new, said = records.correct(old, self.index().need("papers"), paper_id, given, evidence, clear_fields)
            sinks.save_records(new, self.store)
            return said | {"effective_after": "the next build of a snapshot"}

        return self._call(run)


#: Rows of a metadata store.
STORE_ROWS = "paper_id string, origin string, confidence string, title string, authors array<string>, year int, venue string, doi string, arxiv_id string, url string, author_ids array<string>, author_orcids array<string>, cleared_fields array<string>, evidence string"
