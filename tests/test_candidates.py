import random
import re

import pytest

from lexarium.operators import metadata

FIELDS = ["run_id", "seq", "title", "year", "sources", "arxiv_id", "doi", "abstract", "url"]


def keys(r):
    title = re.sub("[^a-z0-9]+", " ", r["title"].lower()).strip()
    return [f"a{r['arxiv_id'].lower()}"] * bool(r["arxiv_id"]) + [f"d{r['doi'].lower()}"] * bool(r["doi"]) + [f"t{title}"] * (len(title) >= 30 and len(title.split()) >= 5)


def one_after_another(rows):
    out, at = {}, {}
    for r in sorted((dict(zip(FIELDS, r, strict=True)) for r in rows), key=lambda r: (r["run_id"], r["seq"])):
        run = r["run_id"]
        hit = next((at[run, k] for k in keys(r) if (run, k) in at), None)
        if hit is None:
            hit = run, r["seq"]
            out[hit] = dict(r)
        else:
            own = out[hit]
            own["year"] = min((y for y in (own["year"], r["year"]) if y > 0), default=0)
            own["sources"] = sorted({*own["sources"], *r["sources"]}, key=str.lower)
            own["abstract"] = max(own["abstract"], r["abstract"], key=len)
            for f in ("arxiv_id", "doi", "url"):
                own[f] = own[f] or r[f]
        at.update({(run, k): hit for k in keys(out[hit])})
    return sorted(tuple(tuple(v) if isinstance(v, list) else v for v in r.values()) for r in out.values())


def random_rows(seed, n, n_keys):
    rng = random.Random(seed)
    title = lambda: rng.choice([f"A Title of {rng.randint(0, n_keys)} words that is LONG enough!", "short", f"a title of {rng.randint(0, n_keys)}: words, that is long enough"])
    some = lambda make: make() if rng.random() < 0.4 else ""
    return [(f"r{rng.randint(0, 1)}", i, title(), rng.choice([0, 2001, 2010]), rng.sample(["x", "Y", "z"], 1), some(lambda: f"24{rng.randint(0, n_keys):02d}.1"), some(lambda: rng.choice(["10.1/A", "10.1/a"]) + str(rng.randint(0, n_keys))), "a" * rng.randint(0, 5), some(lambda: f"u{rng.randint(0, 5)}")) for i in range(n)]


@pytest.mark.parametrize(("seed", "n", "n_keys"), [(1, 200, 60), (2, 150, 8)])
def test_groups_give_what_one_pass_gives(spark, seed, n, n_keys):
    rows = random_rows(seed, n, n_keys)
    got = metadata.merge_candidates(spark.createDataFrame(rows, metadata.CANDIDATE).repartition(5)).collect()
    assert sorted(tuple(tuple(v) if isinstance(v, list) else v for v in r) for r in got) == one_after_another(rows)


def test_a_long_chain_is_one_group(spark):
    """Each candidate shares a key with the next alone; the ends are found in few rounds."""
    rows = [("r", i, "t", 2000, ["x"], f"{i // 2}.1", f"10.1/{(i + 1) // 2}", "", "") for i in range(60)]
    rounds = []
    keep = lambda df, label: rounds.append(label) or metadata._keep(df, label)
    labels = metadata.candidate_groups(spark.createDataFrame(rows, metadata.CANDIDATE), keep).collect()
    assert {r.label for r in labels} == {0} and rounds.count("candidate-step") < 20
    assert metadata.merge_candidates(spark.createDataFrame([], metadata.CANDIDATE)).collect() == []


def test_title_query_asks_every_part(spark, tmp_path):
    """Parts are candidates like the items; equal numbers of both tables stay apart."""
    from lexarium import queries

    parts = [(1, "small ring"), (2, "cold rod"), (3, "small ring")]
    spark.createDataFrame(parts, "p_partkey long, p_name string").write.parquet(f"{tmp_path}/part.parquet")
    spark.createDataFrame([(1, "a quick and rather long text of an item")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r.candidate_id: (r.title_id, round(r.ratio, 3)) for r in queries.QUERIES["title_matches"](spark, str(tmp_path)).collect()}
    assert got.pop("i1")[0] == "i1"
    assert got == {"p1": ("p1", 0.9), "p2": ("p2", 0.875), "p3": ("p1", 0.9)}
