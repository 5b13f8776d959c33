import random

import public_tokenizers
import pytest

from lexarium.llm.tokens import CACHE_SCHEMA, UnitCounter, token_counts

FILES = ["byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"]


@pytest.fixture(scope="module")
def counter():
    return UnitCounter(str(public_tokenizers.path("byte_bpe_50k.json")))


def test_units_equal_whole_texts(counter):
    rng = random.Random(1)
    assert counter.by_unit
    parts = ["a", "b ", " ", "  ", "\n", "\n\n", "\t", "é", "1", "'s", "<|endoftext|>", " ", "　", "\x1c", "\r", "!", "The", " the", "ll", "'", "ß", "café,", "\U0001f600"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(20_000)]
    assert counter.count(texts) == counter.encode(texts)


@pytest.mark.parametrize("name", FILES)
def test_counts_and_cache(spark, odd_documents, tmp_path, name):
    path = str(public_tokenizers.path(name))
    cache = f"file://{tmp_path}/cache"
    out = token_counts(odd_documents, path, cache)
    rows = out.collect()
    whole = UnitCounter(path).encode
    texts = {r[0]: r[1] for r in odd_documents.collect()}
    assert len(rows) == odd_documents.count()
    for r in rows:
        text = texts[r.doc_id] or ""
        assert (r.n_bytes, r.n_tokens) == (len(text.encode()), whole([text])[0])
    stored = spark.read.schema(CACHE_SCHEMA).parquet(cache)
    n = stored.count()
    assert n == len({t or "" for t in texts.values()})
    assert sorted(map(tuple, token_counts(odd_documents, path, cache).collect()), key=str) == sorted(map(tuple, rows), key=str)
    assert stored.count() == n  # nothing was encoded again


def test_empty_table(spark):
    assert token_counts(spark.createDataFrame([], "doc_id long, text string"), str(public_tokenizers.path(FILES[0]))).count() == 0
