import random
import re

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from lexarium.operators import graph, lexical, retrieval
from lexarium.plans import snapshot
from lexarium.shared import keep_by


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(8)
    words = [f"w{i}" for i in range(60)]
    rows = [(f"p{i // 3:03d}", f"p{i // 3:03d}-c{i:04d}", i % 3, " ".join(rng.choices(words, k=rng.randint(1, 40)))) for i in range(400)]
    frame = spark.createDataFrame(rows, "paper_id string, chunk_id string, row_index int, text string")
    return frame.withColumns({"page_number": F.lit(1), "page_end": F.lit(1), "section_title": F.lit(""), "document_kind": F.lit("full")}).persist()


@pytest.fixture(scope="module")
def index(spark, corpus, tmp_path_factory):
    base = f"file://{tmp_path_factory.mktemp('index')}"
    weights = lexical.weighted(corpus).persist()
    snapshot.write_postings(weights, f"{base}/postings", weights.count())
    snapshot.write_forward(lexical.forward(weights), f"{base}/forward", 400)
    member = corpus.select("paper_id", (F.substring("paper_id", 2, 3).cast("int") % 5).alias("community_id")).distinct()
    members = member.select("community_id", "paper_id", F.lit(1.0).alias("centrality"), F.lit(False).alias("is_representative"))
    edges = spark.createDataFrame([("p000", "p001", 0.5)], "source string, target string, weight double")
    return retrieval.Index(corpus, spark.read.parquet(f"{base}/postings"), edges, members, forward=spark.read.parquet(f"{base}/forward"))


def queries(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "query_id int, query string")


@pytest.fixture
def narrow(monkeypatch):
    """Ranges of about 40 rows."""
    monkeypatch.setattr(lexical, "RANGE", 40)
    monkeypatch.setattr(lexical, "SAMPLED", 8)


def test_spread_ranks_are_row_numbers(spark, narrow):
    """Ties, a key with a third of all rows, keys of one row."""
    rng = random.Random(1)
    rows = [(i % 7 if i % 3 else 0, f"c{i:05d}", float(rng.randint(0, 20))) for i in range(3000)] + [(99, "x", 1.0)]
    frame = spark.createDataFrame(rows, "query_id int, chunk_id string, score double")
    want = frame.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")))
    got = lexical.spread_ranks(frame, ["query_id"], "score")
    assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(map(tuple, want.collect()))


def test_one_list_is_many_ranges(spark):
    """Ten million scored rows of one query are ranked by tasks that have a small share each."""
    rows = spark.range(10_000_000).select(F.lit(1).alias("query_id"), F.format_string("c%08d", "id").alias("chunk_id"), (F.xxhash64("id") % 1_000_003).cast("double").alias("score"))
    got = lexical.spread_ranks(rows, ["query_id"], "score")
    assert not [w for w in re.findall(r"windowspecdefinition\(([^)]*)\)", got._jdf.queryExecution().optimizedPlan().toString()) if "query_id" in w and "range" not in w and "UnboundedPreceding" not in w and "chunk_id" in w]
    sizes = got.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n"), F.min("rank").alias("a"), F.max("rank").alias("b")).collect()
    assert sum(r.n for r in sizes) == max(r.b for r in sizes) == 10_000_000 and min(r.a for r in sizes) == 1


def whole_list_windows(df) -> list[str]:
    """Windows over rows of one query alone that aren't cut to a first few (hits in order of their rank are the first few)."""
    plan = df._jdf.queryExecution().optimizedPlan().toString().splitlines()
    out = []
    for i, line in enumerate(plan):
        if re.search(r"[ -]Window \[row_number", line) and re.search(r"\], \[query_id#\d+\], ", line) and " rank#" not in line:
            below = next((x for x in plan[i + 1 :] if not re.search(r"Project|Filter", x)), "")
            if "WindowGroupLimit" not in below:
                out.append(line)
    return out


def test_no_mode_ranks_a_whole_list(spark, index, corpus, narrow):
    q = queries(spark, "w1 w2 w3")
    frames = [
        lexical.search(index.weights, q, 5, "hybrid", corpus, corpus.select("paper_id").limit(3)),
        lexical.scores_by_paper(index.weights, q, corpus),
        retrieval.rank_communities(index, q),
        retrieval.search_local(index, q)["fan_out"],
    ]
    for f in frames:
        assert whole_list_windows(f) == []


def test_modes_agree_with_plain_ranks(spark, index, corpus, narrow, monkeypatch):
    q = queries(spark, "w1 w2 w3", "w5 w59")
    rows = lambda df: sorted(map(tuple, df.collect()))
    scored = lexical.scores(index.weights, q).persist()
    plain = lambda s: scored.filter(F.col(s) > 0).select("query_id", "chunk_id", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(s), "chunk_id")).alias("rank"))
    want = lexical.fuse_rankings([plain("score_tfidf"), plain("score_bm25")])
    assert rows(lexical.hybrid(scored)) == rows(want)
    own = corpus.filter("row_index = 0 and paper_id < 'p050'").select("paper_id").distinct()
    kept = want.join(corpus.select("chunk_id", "paper_id"), "chunk_id").join(own, "paper_id", "left_semi")
    first = kept.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id"))).filter("rank <= 5")
    assert rows(lexical.search(index.weights, q, 5, "hybrid", corpus.drop("document_kind"), own)) == rows(first.select("query_id", "rank", "chunk_id", "score"))
    scored.unpersist()


def test_nothing_stays_cached(spark, index):
    held = lambda: spark.sparkContext._jsc.getPersistentRDDs().size()
    lexical.let_go()
    before = held()
    for i in range(3):
        q = queries(spark, f"w{i} w{i + 1}")
        retrieval.search_drift(index, q, 3, 2).collect()
        retrieval.search_local(index, q, 3)["neighborhood"].collect()
    assert held() <= before + lexical.HELD
    lexical.let_go()
    assert held() == before


def test_drift_falls_back_where_communities_have_nothing(spark, index):
    """A question whose best communities hold no hit of its own takes the whole corpus."""
    none = retrieval.Index(index.chunks, index.weights, index.edges, index.members.filter("false"), forward=index.forward)
    got = retrieval.search_drift(none, queries(spark, "w1 w2"), 3).collect()
    assert len(got) == 3 and all(r.fallback for r in got)
    assert not any(r.fallback for r in retrieval.search_drift(index, queries(spark, "w1 w2"), 3).collect())


def test_neighbours_from_vectors(spark, index, monkeypatch):
    seeds = index.chunks.filter("row_index = 1").select(F.col("chunk_id").alias("seed_id"))
    rows = lambda df: sorted(map(tuple, df.collect()))
    want = rows(lexical.chunk_neighbors(index.weights, seeds, 4))
    assert rows(lexical.chunk_neighbors(index.weights, seeds, 4, index.forward)) == want and len(want) > 400
    monkeypatch.setattr(lexical, "LITERALS", 5)
    assert rows(lexical.chunk_neighbors(index.weights, seeds, 4, index.forward)) == want


def test_local_search_reads_no_whole_postings(spark, index):
    plan = retrieval.search_local(index, queries(spark, "w1"), 3)["neighborhood"]._jdf.queryExecution().executedPlan().toString()
    scans = [x for x in plan.splitlines() if "Scan parquet" in x and "w_tfidf" in x]
    assert scans and all("PushedFilters: [" in x and "In(term" in x or "EqualTo(term" in x for x in scans)


def test_scores_are_added_up_where_the_index_lies(spark, corpus):
    """With an index dealt by chunk no scored row moves, neither for scores nor for the first few of a fused list."""
    q = queries(spark, "w1 w2 w3", "w5 w59", "unheard", "")
    moved = lambda df: re.findall(r"Exchange hashpartitioning\([^)]*chunk_id[^)]*\)", df._jdf.queryExecution().executedPlan().toString())
    index = lexical.with_weights(keep_by(lexical.weight_parts(corpus), "chunk_id"))
    scored = lexical.scores(index, q)
    assert moved(scored) == []
    rows = lambda df: sorted((r.query_id, r.chunk_id, pytest.approx(r.score_tfidf, abs=2e-9), pytest.approx(r.score_bm25, abs=2e-9)) for r in df.collect())
    assert rows(scored) == rows(lexical.scores(lexical.weighted(corpus).repartition(3, "term"), q)) and scored.count() > 300


def test_df_of_rare_and_frequent_terms(spark, corpus, monkeypatch):
    """Terms whose df is broadcast and terms that go for it, against a plain count."""
    want = {r.term: r.df for r in lexical.term_stats(lexical.postings(corpus)).collect()}
    for frequent in (1, 40, 100_000):
        monkeypatch.setattr(lexical, "FREQUENT", frequent)
        got = lexical.weighted(corpus).select("term", "df").distinct().collect()
        assert {r.term: r.df for r in got} == want and len(got) == len(want)


def test_scores_of_wanted_chunks_rank_no_list(spark, index, corpus):
    """The fan-out's chunks alone get their corpus ranks by counting; neighbours of many seeds need no row for each pair."""
    scored = lexical.scores(index.weights, queries(spark, "w1 w2 w3", "w5 w59")).persist()
    wanted = corpus.filter("row_index = 1").select(F.explode(F.array(F.lit(0), F.lit(1), F.lit(7))).alias("query_id"), "chunk_id")
    rows = lambda df: sorted(map(tuple, df.collect()))
    for scoring in lexical.SCORINGS:
        got = lexical.final_scores(scored, scoring, wanted=wanted)
        assert rows(got) == rows(lexical.final_scores(scored, scoring).join(wanted, ["query_id", "chunk_id"], "left_semi")) and got.count() > 20
    scored.unpersist()
    near = lexical.chunk_neighbors(index.weights, corpus.select(F.col("chunk_id").alias("seed_id")), 2)
    assert " Join" not in near._jdf.queryExecution().optimizedPlan().toString().replace("LeftSemi", "") or "term" not in "".join(x for x in near._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join Inner" in x)


def places(texts: dict[str, str]) -> dict[str, list[str]]:
    return {k: re.findall(r"\w+", v.lower()) for k, v in texts.items()}


def test_block_positions(spark, monkeypatch):
    """Stretches of four words and blocks of two chunks: phrases across both, against a search word by word."""
    monkeypatch.setattr(lexical, "STRETCH", 4)
    monkeypatch.setattr(lexical, "BLOCK_CHUNKS", 2)
    rng = random.Random(4)
    texts = {f"c{i}": " ".join(rng.choices(["a", "b", "ab", "abc", "d"], k=rng.randint(0, 60))) for i in range(25)}
    frame = spark.createDataFrame(list(texts.items()), "chunk_id string, text string")
    pos = lexical.positions(frame).persist()
    assert pos.count() == pos.select("term", "block").distinct().count() and pos.agg(F.sum("n")).first()[0] == sum(map(len, places(texts).values()))
    for phrase in ("a", "a b", "a b a", "d d d d", "abc a abc b"):
        w = phrase.split()
        want = {c: [i for i in range(len(t)) if t[i : i + len(w)] == w] for c, t in places(texts).items()}
        got = {r.chunk_id: (r.n_hits, r.first) for r in lexical.phrase_hits(pos, phrase).collect()}
        assert got == {c: (len(s), s[0]) for c, s in want.items() if s}
    want = {c: sum(t[i] == "d" and t[i + 1].startswith("abc") for i in range(len(t) - 1)) for c, t in places(texts).items()}
    assert {r.chunk_id: r.n_hits for r in lexical.phrase_hits(pos, "d abc", prefix=True).collect()} == {c: n for c, n in want.items() if n}
    pos.unpersist()


def test_keys_of_every_form_are_found(spark):
    """Old and new ids, parts of words, patterns that hold or overlap each other, against a search for each."""
    rng = random.Random(2)
    patterns = ["cs/0112017", "math/0309136", "2404.12345", "2404.1234", "10.1145/3.5", "10.1145/3", "a title inside words of a text", "side words", "x", "é", "10.1/ü", "aaaa", "aaaaaaaaaa", "", "[.*]", "a" * 300]
    texts = {f"t{i}": rng.choice(["", "see ", "µ"]) + "".join(rng.choices([p + rng.choice(["", " ", "v2"]) for p in patterns] + ["zz", "10.1145/"], k=rng.randint(0, 5))) for i in range(60)}
    frame = spark.createDataFrame([*texts.items(), ("none", None)], "id string, text string")
    keys = spark.createDataFrame([(p,) for p in [*patterns, "x"]], "pattern string")
    got = {tuple(r) for r in graph.texts_with(frame, keys).collect()}
    assert got == {(i, p) for i, t in texts.items() for p in patterns if p and p in t}
    assert graph.texts_with(frame, keys.limit(0)).collect() == []


def test_words_do_not_move_before_they_are_counted(spark, corpus):
    """Places and counts of words are made where the texts were dealt to: one exchange of texts, none by chunk and term."""
    plan = lexical.positions(corpus, 3)._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"Exchange hashpartitioning\(chunk_id#\d+, term", plan) and plan.count("Exchange") == 2
    docs = spark.createDataFrame([(1, "the cat the cat dog"), (2, "dog emu"), (3, "of"), (4, None), (5, "")], "doc_id int, text string")
    got = {r.doc_id: r.keywords for r in lexical.keyword_table(docs, 2, ["the", "of"]).collect()}
    assert got == {1: ["cat", "dog"], 2: ["emu", "dog"], 3: [], 4: [], 5: []}
