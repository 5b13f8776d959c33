"""A snapshot in SQL: its tables as views, and searches as table functions with typed columns.

A function may be called for each row of a table (``FROM questions q, LATERAL search_bm25(q.text, 5) s``): Spark turns that
into one plan for all rows, a join of the postings with all questions' terms and a limit for each question.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from ..operators.graph import both_ways
from ..operators.lexical import DECIMALS, TOKEN
from ..operators.retrieval import Index

#: Functions by name: their parameters, their columns, their query over the views, and the view that they need.
FUNCTIONS = {
    "search_bm25": (
        "question STRING, k INT",
        "rank INT, chunk_id STRING, paper_id STRING, score DOUBLE",
        f"""SELECT r.rank, r.chunk_id, c.paper_id, r.score FROM (
              SELECT row_number() OVER (ORDER BY s.score DESC, s.chunk_id) AS rank, s.chunk_id, s.score FROM (
                SELECT p.chunk_id, round(sum(p.w_bm25 * t.qtf), {DECIMALS}) AS score
                FROM (SELECT term, count(*) AS qtf FROM (SELECT explode(regexp_extract_all(lower(question), r'{TOKEN}', 0)) AS term) GROUP BY term) t
                JOIN {{0}}postings p ON p.term = t.term GROUP BY p.chunk_id) s WHERE s.score > 0) r
            JOIN {{0}}chunks c ON c.chunk_id = r.chunk_id WHERE r.rank <= k""",
        "weights",
    ),
    "neighbors_of": ("paper STRING, k INT", "rank INT, neighbor STRING, weight DOUBLE", "SELECT rank, neighbor, weight FROM (SELECT row_number() OVER (ORDER BY weight DESC, neighbor) AS rank, neighbor, weight FROM {0}links WHERE paper_id = paper) WHERE rank <= k", "edges"),
    "cited_by": ("paper STRING", "paper_id STRING, method STRING", "SELECT source_paper_id, method FROM {0}citations WHERE target_paper_id = paper", "citations"),
    "papers_of": ("person STRING", "paper_id STRING, name STRING", "SELECT paper_id, name FROM {0}authors WHERE person_key = person", "authors"),
    "topic_of": ("paper STRING", "community_id INT, centrality DOUBLE, is_representative BOOLEAN", "SELECT community_id, centrality, is_representative FROM {0}members WHERE paper_id = paper", "members"),
}


def register(spark: SparkSession, index: Index, prefix: str = "") -> list[str]:
    """Temporary views and functions of this session over the tables that ``index`` has; the names of the functions. ``prefix`` goes before every name."""
    tables = {"chunks": index.chunks, "postings": index.weights, "links": both_ways(index.edges) if index.edges is not None else None}
    tables |= {k: getattr(index, k) for k in ("citations", "members", "communities", "metadata", "authors", "papers")}
    for name, table in tables.items():
        if table is not None:
            table.createOrReplaceTempView(f"{prefix}{name}")
    made = []
    for name, (parameters, columns, body, needed) in FUNCTIONS.items():
        if getattr(index, needed) is not None:
            spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {prefix}{name}({parameters}) RETURNS TABLE ({columns}) RETURN {body.replace('{0}', prefix)}")
            made.append(f"{prefix}{name}")
    return made
